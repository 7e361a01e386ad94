"""Word lists, lookup tables, constants and patterns the results depend on."""

# ---- fixed values: intake -------------------------------------------------
HEADER_SYNONYMS = {
    "domain": ["domain", "website", "url", "company website", "website url", "web", "site"],
    "name": ["company", "company name", "name", "business name", "organization", "account name"],
    "industry": ["industry", "category", "sector", "vertical", "business type"],
    "email": ["email", "email address", "contact email", "owner email", "e-mail"],
    "phone": ["phone", "phone number", "telephone", "contact phone", "mobile", "tel"],
    "city": ["city", "town", "locality"],
    "state": ["state", "region", "province", "state/province"],
    "country": ["country", "country code", "nation"],
    "employees": ["employees", "employee count", "headcount", "company size", "size", "staff"],
    "revenue": ["revenue", "annual revenue", "revenue estimate", "est revenue", "sales volume"],
    "owner": ["owner", "owner name", "contact name", "contact", "full name", "decision maker"],
    "title": ["title", "job title", "owner title", "position", "role"],
    "linkedin": ["linkedin", "linkedin url", "company linkedin", "linkedin profile"],
}
DELIMITERS = [",", ";", "\t", "|"]
VENDOR_FIELDS = ["owner", "email", "industry"]
BLANK_WORDS = ["", "n/a", "na", "none", "null", "-"]

# ---- fixed values: names and hosts ----------------------------------------
LEGAL_SUFFIXES = [
    "inc", "incorporated", "llc", "ltd", "limited", "co", "company", "corp", "corporation",
    "pvt", "plc", "gmbh", "lp", "llp", "pllc", "pc", "sa", "ag", "bv",
]
FREE_MAIL = [
    "gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com", "icloud.com",
    "live.com", "msn.com", "protonmail.com", "comcast.net", "att.net", "verizon.net",
]
FUZZY_PERCENT = 92

# Public suffixes. Any alphabetic last label is one, but for the names below. Under a country code, the
# usual second labels belong to the suffix, unless the country registers directly under its code. Further
# rules are written as in public suffix lists: "*." stands for any label, "!" marks an exception. A full
# list can be passed to canonical_domain.
NOT_SUFFIXES = [
    "arpa", "corp", "example", "home", "internal", "invalid", "lan", "local", "localdomain", "localhost", "onion", "test",
    "asp", "aspx", "css", "csv", "doc", "docx", "gif", "htm", "html", "jpeg", "jpg", "js", "json", "jsp", "pdf", "php",
    "png", "svg", "txt", "xls", "xlsx", "xml",
]
SECOND_LABELS = ["ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "mil", "ne", "net", "or", "org"]
DIRECT_CODES = ["ai", "at", "be", "ca", "cc", "ch", "de", "dk", "eu", "fi", "io", "it", "me", "nl", "no", "se", "tv", "us"]
SUFFIX_RULES = [
    "ac.at", "co.at", "gv.at", "or.at", "ac.be", "gc.ca", "id.au", "asn.au", "firm.in", "gen.in", "ind.in", "govt.nz", "school.nz",
    "geek.nz", "maori.nz", "iwi.nz", "ltd.uk", "me.uk", "plc.uk", "nhs.uk", "police.uk", "*.sch.uk", "web.za", "law.za", "nom.za",
    "asso.fr", "nom.fr", "prd.fr", "tm.fr", "ad.jp", "ed.jp", "gr.jp", "lg.jp", "re.kr", "pe.kr", "art.br", "blog.br", "eco.br",
    "ind.br", "adv.br", "in.th", "web.id", "my.id", "sch.id", "*.bd", "*.ck", "!www.ck", "*.er", "*.fk", "*.jm", "*.kh", "*.mm",
    "*.np", "*.pg", "*.kawasaki.jp", "!city.kawasaki.jp", "k12.ca.us", "k12.ny.us", "k12.tx.us",
]

# ---- fixed values: e-mail -------------------------------------------------
ROLE_MAILBOXES = [
    "info", "sales", "contact", "admin", "support", "hello", "office", "billing", "careers",
    "jobs", "hr", "noreply", "no-reply", "service", "help", "team", "marketing", "accounts",
    "enquiries", "inquiries", "mail", "webmaster", "reception", "orders",
]
DISPOSABLE_HOSTS = [
    "mailinator.com", "guerrillamail.com", "10minutemail.com", "tempmail.com",
    "temp-mail.org", "trashmail.com", "yopmail.com", "getnada.com", "sharklasers.com",
    "throwawaymail.com", "maildrop.cc", "dispostable.com",
]
RESERVED_TLDS = ["arpa", "invalid", "local", "localhost", "onion", "test"]
EMAIL_SYNTAX = (
    r"^[\p{L}\p{N}!#$%&'*+/=?^_`{|}~-]+(\.[\p{L}\p{N}!#$%&'*+/=?^_`{|}~-]+)*"
    r"@([\p{L}\p{N}]([\p{L}\p{N}-]*[\p{L}\p{N}])?\.)+[\p{L}\p{N}-]*\p{L}[\p{L}\p{N}-]*$"
)
EMAIL_IN_TEXT = r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,24}"
MAILTO_TARGET = r"""(?i)mailto:([^"'?>\s]+)"""
JUNK_MAIL_TLDS = ["png", "jpg", "jpeg", "gif", "svg", "webp", "css", "js"]
JUNK_MAIL_HOSTS = [
    "sentry.io", "sentry-next.wixpress.com", "wixpress.com", "example.com", "domain.com",
    "email.com", "yourdomain.com", "godaddy.com",
]
JUNK_MAILBOXES = [
    "noreply", "no-reply", "donotreply", "user", "name", "email", "yourname", "your.name",
    "yourmail", "youremail", "test", "testing", "example", "someone", "johndoe", "john.doe",
    "janedoe", "jane.doe", "firstname", "first.last", "firstname.lastname",
]

# ---- fixed values: phone --------------------------------------------------
COUNTRY_ALIASES = {
    "usa": "US", "united states": "US", "united states of america": "US", "uk": "GB",
    "united kingdom": "GB", "england": "GB", "canada": "CA", "australia": "AU",
    "pakistan": "PK", "india": "IN", "germany": "DE",
}
# region -> (country code, trunk prefix, pattern of the national number without trunk prefix)
PHONE_PLANS = {
    "US": ("1", "1", r"[2-9][0-8][0-9][2-9][0-9]{6}"),
    "CA": ("1", "1", r"[2-9][0-8][0-9][2-9][0-9]{6}"),
    "GB": ("44", "0", r"(1[0-9]{8,9}|2[0-9]{9}|3[0-9]{9}|5[56][0-9]{8}|7[0-9]{9}|8[0-9]{9}|9[0-9]{9})"),
    "AU": ("61", "0", r"([23478][0-9]{8}|1[38]00[0-9]{6}|190[0-9]{7})"),
    "DE": ("49", "0", r"[1-9][0-9]{5,10}"),
    "IN": ("91", "0", r"[1-9][0-9]{9}"),
    "PK": ("92", "0", r"(3[0-9]{9}|[24-9][0-9]{8,9})"),
    "FR": ("33", "0", r"[1-9][0-9]{8}"),
    "IE": ("353", "0", r"(1[0-9]{7}|[2-79][0-9]{6,8}|8[35-9][0-9]{7})"),
    "ES": ("34", "", r"[6789][0-9]{8}"),
    "IT": ("39", "", r"(0[0-9]{5,10}|3[0-9]{8,9}|80[03][0-9]{3,6}|89[0-9]{4,7})"),
    "NL": ("31", "0", r"([1-57][0-9]{8}|6[1-58][0-9]{7}|8[58][0-9]{7}|800[0-9]{4,7}|90[069][0-9]{4,7})"),
    "BE": ("32", "0", r"(4[5-9][0-9]{7}|[1-9][0-9]{7})"),
    "CH": ("41", "0", r"[2-9][0-9]{8}"),
    "AT": ("43", "0", r"[1-9][0-9]{3,12}"),
    "SE": ("46", "0", r"[1-9][0-9]{5,9}"),
    "DK": ("45", "", r"[2-9][0-9]{7}"),
    "NO": ("47", "", r"[2-9][0-9]{7}"),
    "MX": ("52", "", r"[2-9][0-9]{9}"),
    "BR": ("55", "0", r"([1-9][1-9]9[0-9]{8}|[1-9][1-9][2-5][0-9]{7})"),
    "NZ": ("64", "0", r"(2[1279][0-9]{6,8}|20[0-9]{7,8}|[34679][0-9]{7}|800[0-9]{6,7})"),
    "ZA": ("27", "0", r"[1-8][0-9]{8}"),
    "SG": ("65", "", r"([3689][0-9]{7}|1800[0-9]{7})"),
    "PL": ("48", "", r"([1-9][0-9]{8})"),
    "PT": ("351", "", r"(2[1-9][0-9]{7}|3[0-9]{8}|9[1236][0-9]{7}|80[08][0-9]{6}|7[06][0-9]{7})"),
    "FI": ("358", "0", r"([1-9][0-9]{4,10})"),
    "CZ": ("420", "", r"([2-9][0-9]{8})"),
    "GR": ("30", "", r"(2[0-9]{9}|69[0-9]{8}|800[0-9]{7}|90[0-9]{8})"),
    "HU": ("36", "06", r"(1[0-9]{7}|[2-9][0-9]{7,8})"),
    "RO": ("40", "0", r"([237][0-9]{8}|80[0-9]{7}|90[0-9]{7})"),
    "TR": ("90", "0", r"([2-5][0-9]{9}|800[0-9]{7,9}|850[0-9]{7}|900[0-9]{7})"),
    "IL": ("972", "0", r"([2-489][0-9]{7}|5[0-9]{8}|7[2-9][0-9]{7}|1800[0-9]{6})"),
    "AE": ("971", "0", r"([2-4679][0-9]{7}|5[024-68][0-9]{7}|800[0-9]{2,9})"),
    "SA": ("966", "0", r"(1[1-467][0-9]{7}|5[0-9]{8}|800[0-9]{7})"),
    "JP": ("81", "0", r"([1-9][0-9]{8}|[5789]0[0-9]{8}|800[0-9]{7})"),
    "CN": ("86", "0", r"(1[3-9][0-9]{9}|10[0-9]{8}|[2-9][0-9]{8,10})"),
    "KR": ("82", "0", r"(2[0-9]{7,8}|[3-6][0-9]{7,9}|1[0-9]{8,9}|70[0-9]{8}|80[0-9]{7})"),
    "HK": ("852", "", r"([2-9][0-9]{7}|800[0-9]{6})"),
    "MY": ("60", "0", r"(1[0-9]{8,9}|[3-9][0-9]{7,8}|1800[0-9]{6})"),
    "PH": ("63", "0", r"(2[0-9]{8}|[3-8][0-9]{7,8}|9[0-9]{9}|1800[0-9]{7,9})"),
    "TH": ("66", "0", r"([2-7][0-9]{7}|[689][0-9]{8}|1800[0-9]{6})"),
    "AR": ("54", "0", r"(11[0-9]{8}|[23][0-9]{9}|9[0-9]{10}|800[0-9]{7})"),
    "CL": ("56", "", r"([2-9][0-9]{8})"),
    "CO": ("57", "0", r"(60[1-8][0-9]{7}|3[0-9]{9}|1800[0-9]{7})"),
    "RU": ("7", "8", r"([3489][0-9]{9})"),
    "UA": ("380", "0", r"([3-9][0-9]{8})"),
}
TOLL_FREE = {
    "1": r"^(800|822|833|844|855|866|877|888)",
    "44": r"^80[08]",
    "61": r"^1800",
    "49": r"^800",
    "91": r"^1800",
    "92": r"^800",
    "33": r"^80[0-5]",
    "353": r"^1800",
    "34": r"^[89]00",
    "39": r"^80[03]",
    "31": r"^800",
    "32": r"^800",
    "41": r"^800",
    "43": r"^800",
    "46": r"^20",
    "45": r"^80",
    "47": r"^80",
    "52": r"^800",
    "64": r"^800",
    "27": r"^80",
    "65": r"^1800",
    "48": r"^800",
    "351": r"^80[08]",
    "358": r"^800",
    "420": r"^800",
    "30": r"^800",
    "36": r"^80",
    "40": r"^800",
    "90": r"^800",
    "972": r"^1800",
    "971": r"^800",
    "966": r"^800",
    "81": r"^(120|800)",
    "82": r"^80",
    "852": r"^800",
    "60": r"^1800",
    "63": r"^1800",
    "66": r"^1800",
    "54": r"^800",
    "56": r"^800",
    "57": r"^1800",
    "7": r"^80[04]",
    "380": r"^800",
}
MOBILE = {
    "44": r"^7[1-57-9]", "61": r"^4", "49": r"^1[567]", "91": r"^[6-9]", "92": r"^3", "33": r"^[67]", "353": r"^8", "34": r"^[67]",
    "39": r"^3", "31": r"^6", "32": r"^4", "41": r"^7[4-9]", "43": r"^6", "46": r"^7", "47": r"^[49]", "55": r"^[1-9][1-9]9",
    "64": r"^2", "27": r"^[678]", "65": r"^[89]", "48": r"^(45|5[0137]|6[069]|7[2389]|88)", "351": r"^9", "358": r"^(4|50)", "420": r"^(60[1-8]|7)",
    "30": r"^69", "36": r"^[2357]0", "40": r"^7", "90": r"^5", "972": r"^5", "971": r"^5", "966": r"^5", "81": r"^[789]0", "86": r"^1[3-9].{9}$",
    "82": r"^1", "852": r"^[5679]", "60": r"^1", "63": r"^9", "66": r"^[689].{8}$", "54": r"^9", "56": r"^9", "57": r"^3", "7": r"^9",
    "380": r"^(39|50|6[36-8]|73|9[1-9])",
}
#: Numbers of other kinds (premium rate, shared cost, personal): valid, but of none of the kinds that are told apart.
OTHER_KINDS = {
    "1": r"^900", "44": r"^(9|70|8[47])", "61": r"^(190|130)", "49": r"^(900|13[78]|180)", "33": r"^(8[129])", "34": r"^(80|90[57])", "39": r"^89",
    "31": r"^90", "32": r"^90", "41": r"^90", "43": r"^9[03]", "46": r"^9[04]", "47": r"^82", "48": r"^70", "351": r"^[67]", "358": r"^[67]00",
    "420": r"^9", "30": r"^90", "40": r"^90", "90": r"^900", "380": r"^900", "7": r"^80[39]",
}
VOIP = {"44": r"^56", "33": r"^9", "353": r"^76", "34": r"^51", "31": r"^8[58]", "43": r"^720", "65": r"^3", "27": r"^87", "81": r"^50", "82": r"^70", "972": r"^7", "351": r"^30", "90": r"^850", "48": r"^39"}
PHONE_IN_TEXT = (
    r"(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,5}\)[ .\-]?)?\b\d{2,5}(?:[ .\-]\d{2,5}){1,4}\b"
    r"|\+?\b\d{7,14}\b"
)
TEL_TARGET = r"""(?i)tel:([^"'>]+)"""

# ---- fixed values: page signals -------------------------------------------
SUBPAGE_WORDS = [
    "about", "contact", "team", "staff", "people", "leadership", "careers", "jobs", "join",
    "our-story", "who-we-are", "history",
]
MAX_SUBPAGES = 4
MAX_BODY_BYTES = 2 * 1024 * 1024
ROBOTS_CHARS = 100_000
HOST_DELAY_SECONDS = 0.5
LEAD_TIMEOUT_MS = 25_000
FOUNDED = (
    r"(?i)\b(?:founded|established|est\.?|since|serving[\w\s,]{0,40}?since|in business since)"
    r"\s+(?:in\s+)?((?:19|20)\d{2})\b"
)
COPYRIGHT = r"(?i)(?:©|&copy;|\(c\)|copyright)\s*(?:\d{4}\s*[-–]\s*)?((?:19|20)\d{2})"
FAMILY = (
    r"(?i)\b(family[- ]owned|family[- ]run|family business|locally owned|owner[- ]operated|"
    r"second[- ]generation|third[- ]generation|husband and wife|father and son|mom and pop)\b"
)
HIRING = (
    r"(?i)\b(we'?re hiring|we are hiring|now hiring|join our team|open positions|"
    r"current openings|job openings|apply now|career opportunities)\b"
)
CAREERS_PATH = r"(?i)(careers?|jobs|join|employment|work-with-us)"
JOB_BOARD = r"(?i)(greenhouse\.io|lever\.co|workable\.com|bamboohr\.com|indeed\.com/cmp)"
# network -> (company page pattern, pages of that network that are no company pages)
SOCIAL = {
    "linkedin": (r"(?i)^https?://([a-z]{2,3}\.)?linkedin\.com/company/[\w\-%.]+", None),
    "facebook": (
        r"(?i)^https?://(www\.|m\.)?facebook\.com/[\w\-.]+",
        r"(?i)^https?://(www\.|m\.)?facebook\.com/(sharer|share|dialog|plugins|tr\b)",
    ),
    "instagram": (
        r"(?i)^https?://(www\.)?instagram\.com/[\w\-.]+",
        r"(?i)^https?://(www\.)?instagram\.com/(p/|explore)",
    ),
    "x": (
        r"(?i)^https?://(www\.)?(twitter|x)\.com/[\w]+",
        r"(?i)^https?://(www\.)?(twitter|x)\.com/(intent|share|home)",
    ),
    "youtube": (r"(?i)^https?://(www\.)?youtube\.com/(channel/|c/|user/|@)[\w\-.]+", None),
}
# product -> (marks in the page source, counts as a modern sales/marketing tool)
TECHNOLOGIES = {
    "WordPress": (["wp-content/", "wp-includes/"], False),
    "Wix": (["static.wixstatic.com", "wix.com"], False),
    "Squarespace": (["static1.squarespace.com", "squarespace.com"], False),
    "GoDaddy Builder": (["img1.wsimg.com"], False),
    "Weebly": (["weebly.com"], False),
    "Shopify": (["cdn.shopify.com"], True),
    "Webflow": (["webflow.com", "data-wf-page"], True),
    "Next.js": (["__NEXT_DATA__", "/_next/static"], True),
    "React": (["data-reactroot", "react-dom"], True),
    "HubSpot": (["js.hs-scripts.com", "js.hsforms.net"], True),
    "Salesforce Pardot": (["pi.pardot.com", "pardot.com/pd.js"], True),
    "Marketo": (["munchkin.marketo.net"], True),
    "Intercom": (["widget.intercom.io"], True),
    "Drift": (["js.driftt.com"], True),
    "Zendesk": (["static.zdassets.com"], True),
    "Calendly": (["assets.calendly.com"], True),
    "Google Analytics": (["gtag(", "google-analytics.com", "googletagmanager.com"], False),
    "Facebook Pixel": (["connect.facebook.net", "fbq("], False),
    "ServiceTitan": (["servicetitan.com"], True),
    "Housecall Pro": (["housecallpro.com"], True),
}
DECISION_TITLES = [
    "owner", "co-owner", "founder", "co-founder", "ceo", "chief executive officer",
    "president", "managing director", "managing partner", "principal", "proprietor",
    "general manager",
]
OTHER_TITLES = ["vice president", "vp", "coo", "cfo", "cto", "director", "manager", "partner"]
FOUNDER_TITLE = r"(?:co-)?(?:founder|owner)(?:\s*(?:&|and|/)\s*(?:ceo|president|owner))?"
TITLE_QUALIFIER = r"(?:[A-Z][a-z]+\s+)?"
PERSON_NAME = r"[A-Z][a-zA-Z'\-]+(?:\s+[A-Z]\.?)?(?:\s+[A-Z][a-zA-Z'\-]+){1,2}"
NAME_STOP_WORDS = [
    "Contact", "About", "Our", "The", "Meet", "Call", "Email", "Team", "Home", "Us",
]
NAME_UI_WORDS = [
    "Search", "Extended", "Read", "More", "Learn", "Sign", "Login", "Log", "Get", "Started",
    "Free", "Book", "Demo", "Download", "News", "Blog", "Events", "Donate", "Board",
    "Directors", "Advisory", "Privacy", "Policy", "Terms", "Services", "Careers", "Menu",
    "View", "Latest", "With", "You", "Your", "We", "Can", "Rely", "For", "And", "From",
    "Estimating",
]
MAX_EMAILS, MAX_PHONES, MAX_PEOPLE = 20, 10, 10

# ---- fixed values: scoring ------------------------------------------------
# rule -> (sales points, acquisition points), in strategy order
RULE_POINTS = {
    "industry_match": (20, 20),
    "location_match": (10, 10),
    "size_fit": (10, 15),
    "personal_email_valid": (15, 10),
    "decision_maker": (10, 15),
    "valid_phone": (5, 5),
    "site_healthy": (5, 5),
    "hiring": (10, -5),
    "modern_stack": (5, 0),
    "years_in_business": (0, 10),
    "stale_website": (-5, 5),
    "family_owned": (0, 5),
    "low_confidence_merge": (-5, -5),
    "role_only_emails": (-5, -5),
    "site_dead": (-20, -20),
}
MODES = ["sales", "acquisition"]
STALE_SITE_YEARS = 3
DEFAULT_MIN_YEARS = 10
ACQUISITION_SIZE = (5, 100)
GRADE_FLOORS = [(80, "A"), (60, "B"), (40, "C")]
GRADES = ["A", "B", "C", "D"]
STAGES = ["new", "qualified", "contacted", "disqualified"]
WEBSITE_STATES = ["alive", "dead", "blocked", "timeout"]
EMAIL_STATES = ["valid_mx", "no_mx", "invalid_syntax", "disposable", "unknown"]
EMAIL_TYPES = ["personal", "role"]
SORT_FIELDS = [
    "score", "name", "created_at", "last_enriched_at", "employee_count", "founded_year",
]
DEFAULT_INDUSTRIES = ["HVAC", "Plumbing", "Electrical", "Roofing", "Landscaping"]

# ---- fixed values: freshness (seconds) and export -------------------------
TTL_SECONDS = {"enrichment": 7 * 86400, "mx": 86400, "robots": 86400, "stats": 30}
EXPORT_HEADERS = [
    "Company Name", "Domain", "Website", "Score", "Grade", "Top Reasons", "Contact Name",
    "Title", "Email", "Email Status", "Phone", "LinkedIn", "Industry", "City", "State",
    "Country", "Employees", "Founded", "Stage", "Notes",
]

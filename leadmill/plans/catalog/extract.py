"""Page signal, enrichment and contact queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadmill import lexicons as lx
from leadmill.functions import text as tx
from leadmill.operators import contacts as ct
from leadmill.operators import extract as ex
from leadmill.plans import mart
from leadmill.plans.catalog.crawl import site_pages
from leadmill.plans.catalog.normalize import domain_sql, listed
from leadmill.plans.catalog.scoring import company, contact
from leadmill.plans.registry import query, table
from leadmill.session import checkpoint

YEAR = 2026


def blocks_sql(html: str) -> str:
    t = html
    for pattern, to in [(r"(?s)<!--.*?-->", ""), (r"(?is)<script\b.*?</script\s*>", "<s>"),
                        (r"(?is)<style\b.*?</style\s*>", "<s>"), (r"(?is)<head\b.*?</head\s*>", ""),
                        (r"(?is)<title\b.*?</title\s*>", "")]:
        t = f"regexp_replace({t}, '{pattern}', '{to}', 'g')"
    item = "x"
    for ref, ch in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&nbsp;", " "), ("&middot;", "·"), ("&mdash;", "—"), ("&#169;", "©"),
                    ("&#x27;", "'"), ("&eacute;", "é"), ("&amp;", "&")]:
        item = "replace({}, '{}', '{}')".format(item, ref, ch.replace("'", "''"))
    return (f"list_filter(list_transform(regexp_split_to_array({t}, '<[^>]*>'), lambda x: "
            f"trim({item}, ' ' || chr(9) || chr(13) || chr(10))), lambda x: x <> '')")


PAGES = f"""{mart.with_views(p=mart.PAGE)}, b AS (SELECT seq, url, html, {blocks_sql('html')} AS blocks, {domain_sql('url')} AS domain FROM p),
t AS (SELECT *, array_to_string(blocks, ' ') AS text FROM b)"""


def first_per_domain(kind: str) -> str:
    return f"arg_min({kind}, seq) FILTER ({kind} <> '')"


@query("page_text", f"""WITH b AS (SELECT page_id, {blocks_sql('html')} AS blocks FROM pages) SELECT page_id, array_to_string(blocks, ' ') AS text FROM b""")
def page_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.html_text("html").alias("text"))


@query("page_meta", """SELECT page_id, left(trim(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&')), 200) AS title FROM pages""")
def page_meta(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.substring(F.get(tx.head_texts("html"), F.lit(0)), 1, 200).alias("title"))


#: Pages with meta tags of either attribute order and quote, references, white space and tags that only look alike.
HEADS = """SELECT page_id, concat('<html><head><TITLE lang="en"> Mill &amp; Co ', page_id, ' </TITLE>',
  CASE page_id % 4 WHEN 0 THEN concat('<meta name="description" content=" We bind ', page_id, ' books &lt;here&gt; ">')
    WHEN 1 THEN concat('<META content=''Looms &#39;n'' Name="description" />', '<meta property="og:description" content="og ', page_id, '">')
    WHEN 2 THEN concat('<meta property="og:description" content="og ', page_id, '"><meta name="twitter:description" content="tw">')
    ELSE '<meta name="descriptions" content="no"><meta itemprop="description" content="no">' END,
  CASE page_id % 3 WHEN 0 THEN concat('<meta property="og:site_name" content="Site ', page_id % 7, '">') WHEN 1 THEN '<meta content="Caf&eacute;" property="og:site_name">' ELSE '' END,
  '</head><body>', html, '</body></html>') AS html FROM {pages}"""


@query("page_head_texts", """SELECT page_id, 'Mill & Co ' || page_id AS title,
  CASE page_id % 4 WHEN 0 THEN 'We bind ' || page_id || ' books <here>' WHEN 1 THEN 'Looms ''n' ELSE '' END AS description,
  CASE WHEN page_id % 4 IN (1, 2) THEN 'og ' || page_id ELSE '' END AS og_description, CASE WHEN page_id % 4 = 2 THEN 'tw' ELSE '' END AS twitter_description,
  CASE page_id % 3 WHEN 0 THEN 'Site ' || page_id % 7 WHEN 1 THEN 'Café' ELSE '' END AS site_name FROM pages""")
def page_head_texts(spark, sf):
    """Title, the three descriptions and the site name of every page."""
    texts = tx.head_texts("html")
    names = ("title", "description", "og_description", "twitter_description", "site_name")
    return mart.view(spark, sf, HEADS).select("page_id", texts.alias("t")).select("page_id", *[F.get("t", F.lit(i)).alias(n) for i, n in enumerate(names)])


def signals(spark, sf, *only):
    """Signals of the pages by site; a site's first page counts as its home page."""
    return ex.page_signals(site_pages(spark, sf), YEAR, list(only))


MAIL = "[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{2,24}"


EMAILS_FOUND = f"""found AS (SELECT seq, domain, generate_subscripts(l, 1) AS pos, unnest(l) AS e FROM (SELECT seq, domain, list_concat(
    list_transform(regexp_extract_all(html, '(?i)mailto:([^"''?>\\s]+)', 1), lambda x: url_decode(x)),
    regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(text,
    '(?i)\\s*[\\[({{]\\s*at\\s*[\\])}}]\\s*', '@', 'g'), '(?i)\\s+at\\s+([a-z0-9-]+\\s*[\\[({{]\\s*dot)', '@\\1', 'g'),
    '(?i)\\s*[\\[({{]\\s*dot\\s*[\\])}}]\\s*', '.', 'g'), '{MAIL}')) AS l FROM t)),
n AS (SELECT seq, domain, pos, lower(trim(e, '.')) AS e FROM found), s AS (SELECT *, split_part(e, '@', 1) AS l, split_part(e, '@', 2) AS h FROM n WHERE regexp_full_match(e, '{MAIL}')),
em AS (SELECT seq, domain, pos, e AS email FROM s WHERE split_part(h, '.', -1) NOT IN ({listed(lx.JUNK_MAIL_TLDS)})
  AND NOT list_has_any([h, regexp_extract(h, '([^.]+[.][^.]+)$', 1)], [{listed(lx.JUNK_MAIL_HOSTS)}])
  AND l NOT IN ({listed(lx.JUNK_MAILBOXES)}) AND len(l) <= 40 AND NOT regexp_full_match(l, '[0-9a-f]{{16,}}')
  AND (h = domain OR ends_with(h, '.' || domain) OR h IN ({listed(lx.FREE_MAIL)})))"""


@query("page_emails", f"{PAGES}, {EMAILS_FOUND} SELECT DISTINCT domain, email FROM em")
def page_emails(spark, sf):
    return signals(spark, sf, "emails").select("domain", F.col("value").alias("email")).distinct()


PHONES_FOUND = f"""c AS (SELECT seq, domain, generate_subscripts(l, 1) AS pos, unnest(l) AS raw FROM (SELECT seq, domain,
  list_concat(regexp_extract_all(html, '(?i)tel:([^"''>]+)', 1), regexp_extract_all(text, '{lx.PHONE_IN_TEXT}')) AS l FROM t)),
d AS (SELECT seq, domain, pos, starts_with(raw, '+') AS world, regexp_replace(regexp_extract(raw, '^[^+0-9]*(.*[0-9])', 1), '[^0-9]', '', 'g') AS n FROM c),
ph AS (SELECT seq, domain, pos, CASE WHEN world THEN '+' || n ELSE '+1' || right(n, 10) END AS phone FROM d
WHERE regexp_full_match(n, CASE WHEN world THEN '(1[2-9][0-8][0-9][2-9][0-9]{{6}}|440?(1[0-9]{{8,9}}|[237][0-9]{{9}}|8[0-9]{{9}})|610?([23478][0-9]{{8}}|1[38]00[0-9]{{6}})|490?[1-9][0-9]{{5,10}}|910?[1-9][0-9]{{9}}|920?(3[0-9]{{9}}|[24-9][0-9]{{8,9}}))' ELSE '1?[2-9][0-8][0-9][2-9][0-9]{{6}}' END))"""


@query("page_phones", f"{PAGES}, {PHONES_FOUND} SELECT DISTINCT seq, phone FROM ph")
def page_phones(spark, sf):
    return signals(spark, sf, "phones").select("seq", F.col("value").alias("phone")).distinct()


SOCIALS_FOUND = f"""hr AS (SELECT domain, seq, generate_subscripts(l, 1) AS pos, trim(unnest(l)) AS href FROM (
  SELECT *, regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a', 1) AS l FROM t)),
sf AS ({' UNION ALL '.join(f"SELECT domain, seq, pos, '{n}' AS network, regexp_extract(href, '{yes}') AS link FROM hr WHERE regexp_matches(href, '{yes}')" + (f" AND NOT regexp_matches(href, '{no}')" if no else '') for n, (yes, no) in lx.SOCIAL.items())}),
so AS (SELECT domain, network, regexp_replace(arg_min(link, seq * 100000 + pos), '[/.]+$', '') AS link FROM sf GROUP BY domain, network)"""


@query("page_socials", f"{PAGES}, {SOCIALS_FOUND} SELECT domain, network, link FROM so")
def page_socials(spark, sf):
    s = ex.domain_signals(signals(spark, sf, "socials"))
    return s.select("domain", F.col("value").alias("network"), F.col("note").alias("link"))


def _one(spark, sf, extractor, kind, name, kind_type="string"):
    s = ex.domain_signals(signals(spark, sf, extractor)).filter(F.col("kind") == kind)
    return s.select("domain", F.col("value").cast(kind_type).alias(name))


@query("founded_year", f"""{PAGES} SELECT domain, min(y) AS founded_year FROM (SELECT domain, CAST(unnest(regexp_extract_all(text, '{lx.FOUNDED}', 1)) AS INTEGER) AS y FROM t)
WHERE y BETWEEN 1850 AND {YEAR} GROUP BY domain""")
def founded_year(spark, sf):
    return _one(spark, sf, "founded", "founded", "founded_year", "int")


@query("copyright_year", f"""{PAGES} SELECT seq, max(y) AS copyright_year FROM (SELECT seq, CAST(unnest(regexp_extract_all(text, '{lx.COPYRIGHT}', 1)) AS INTEGER) AS y FROM t)
WHERE y BETWEEN 1990 AND {YEAR + 1} GROUP BY seq""")
def copyright_year(spark, sf):
    s = signals(spark, sf, "founded").filter("kind = 'copyright'")
    return s.groupBy("seq").agg(F.max(F.col("value").cast("int")).alias("copyright_year"))


#: Pages that open with a year and may end in words that need one; every eleventh has nothing else to say.
BORDERS = """SELECT page_id AS seq, url, concat('<html><body><p>', 1990 + page_id * 7 % 33, ' Mill Lane</p>', CASE WHEN page_id % 11 = 4 THEN '' ELSE html END,
  CASE page_id % 5 WHEN 1 THEN '<p>Weavers, founded in</p>' WHEN 2 THEN '<footer>&copy;</footer>' WHEN 3 THEN '<p>Serving all of Austin, </p>' ELSE '<p>End</p>' END, '</body></html>') AS html FROM {pages}"""


@query("site_years", f"""WITH p AS {mart.sql_text(BORDERS)}, b AS (SELECT seq, {blocks_sql('html')} AS blocks, {domain_sql('url')} AS domain FROM p),
s AS (SELECT domain, string_agg(array_to_string(blocks, ' '), chr(10) ORDER BY seq) AS text FROM b WHERE domain IS NOT NULL GROUP BY domain)
SELECT domain, list_min(list_filter(list_transform(regexp_extract_all(text, '{lx.FOUNDED}', 1), lambda y: CAST(y AS INTEGER)), lambda y: y BETWEEN 1850 AND {YEAR})) AS founded_year,
  list_max(list_filter(list_transform(regexp_extract_all(text, '{lx.COPYRIGHT}', 1), lambda y: CAST(y AS INTEGER)), lambda y: y BETWEEN 1990 AND {YEAR + 1})) AS copyright_year FROM s""")
def site_years(spark, sf):
    """Years of a site's pages read as one text, phrases over page borders included."""
    return ex.enrichment_rows(site_pages(spark, sf, BORDERS), YEAR, ["founded"]).filter("domain IS NOT NULL").select("domain", "founded_year", "copyright_year")


@query("family_owned", f"{PAGES} SELECT domain, {first_per_domain('m')} AS hint FROM (SELECT domain, seq, regexp_extract(text, '{lx.FAMILY}') AS m FROM t) GROUP BY domain HAVING hint IS NOT NULL")
def family_owned(spark, sf):
    return _one(spark, sf, "family", "family", "hint")


HIRING_SQL = lx.HIRING.replace("'", "''")


@query("hiring_signals", f"""{PAGES}, h AS (SELECT domain, seq, {'regexp_extract(url, ' + chr(39) + '^[a-z]+://[^/?#]*([^?#]*)' + chr(39) + ', 1)'} AS path,
  regexp_extract(text, '{HIRING_SQL}') AS m, regexp_matches(html, '{lx.JOB_BOARD}') AS board FROM t)
SELECT domain, coalesce(bool_or(regexp_matches(path, '{lx.CAREERS_PATH}')), false) AS careers_page, {first_per_domain('m')} AS phrase, bool_or(board) AS board FROM h GROUP BY domain""")
def hiring_signals(spark, sf):
    e = ex.enrichment_rows(site_pages(spark, sf), YEAR, ["hiring"])
    quoted = F.get(F.filter("hiring_evidence", lambda x: x.startswith('"')), F.lit(0))
    return e.select("domain", F.array_contains("hiring_evidence", "careers page").alias("careers_page"),
                    F.regexp_replace(quoted, '"', "").alias("phrase"), F.array_contains("hiring_evidence", "job board link").alias("board"))


TECH_SQL = " UNION ALL ".join(
    "SELECT domain, seq, {} AS pos, '{}' AS product, {} AS modern FROM t WHERE {}".format(
        i, name, str(modern).lower(), " OR ".join(f"contains(html, '{m}')" for m in marks))
    for i, (name, (marks, modern)) in enumerate(lx.TECHNOLOGIES.items()))


@query("tech_stack", f"""{PAGES}, f AS ({TECH_SQL}), d AS (SELECT domain, product, bool_or(modern) AS modern, min(seq * 100 + pos) AS o FROM f GROUP BY 1, 2)
SELECT domain, string_agg(product, ', ' ORDER BY o) AS stack, bool_or(modern) AS modern FROM d GROUP BY domain""")
def tech_stack(spark, sf):
    e = ex.enrichment_rows(site_pages(spark, sf), YEAR, ["tech_stack"]).filter(F.size("tech_stack") > 0)
    return e.select("domain", F.array_join("tech_stack", ", ").alias("stack"), F.col("modern_stack").alias("modern"))


TALK = """SELECT conv_id * 1000 + turn AS id, concat(CASE role WHEN 'user' THEN 'Meet Ingrid B. Solvay - President' WHEN 'assistant' THEN 'Finance Director: Moira D''Arcy'
  ELSE 'Search Extended - Owner' END, chr(10), text) AS text FROM {conversations}"""
_NAME = lx.PERSON_NAME.replace("'", "''")
_T = ex._TITLES
PEOPLE_SQL = f"""WITH talk AS {mart.sql_text(TALK)}, l AS (SELECT id, generate_subscripts(a, 1) AS no, trim(unnest(a)) AS line FROM (SELECT id, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS a FROM talk)),
m AS (SELECT id, no * 1000 + generate_subscripts(regexp_extract_all(line, '{ex.NAME_THEN_TITLE.replace("'", "''")}', 1), 1) AS o, unnest(regexp_extract_all(line, '{ex.NAME_THEN_TITLE.replace("'", "''")}', 1)) AS name, unnest(regexp_extract_all(line, '{ex.NAME_THEN_TITLE.replace("'", "''")}', 2)) AS title FROM l WHERE len(line) <= 200
  UNION ALL SELECT id, no * 1000 + 500 + generate_subscripts(regexp_extract_all(line, '{ex.TITLE_THEN_NAME.replace("'", "''")}', 2), 1), unnest(regexp_extract_all(line, '{ex.TITLE_THEN_NAME.replace("'", "''")}', 2)), unnest(regexp_extract_all(line, '{ex.TITLE_THEN_NAME.replace("'", "''")}', 1)) FROM l WHERE len(line) <= 200),
c AS (SELECT id, o, title, trim(regexp_replace(name, '^(?:(?:{'|'.join(lx.NAME_STOP_WORDS)})(?: |$))+', '')) AS name FROM m)
SELECT id, name, arg_min(title, o) AS title FROM c WHERE contains(name, ' ') AND len(list_filter(string_split(name, ' '), lambda w: w IN ({listed(lx.NAME_STOP_WORDS + lx.NAME_UI_WORDS)}) OR lower(w) IN ({listed(ex._TITLE_WORDS)}) OR (len(w) > 2 AND regexp_full_match(w, '[^a-z]*[A-Z][^a-z]*')))) = 0 GROUP BY id, name"""


@query("people", PEOPLE_SQL)
def people(spark, sf):
    t = mart.view(spark, sf, TALK).withColumn("lines", F.split("text", r"\r\n|\n|\r"))
    found = t.select("id", F.inline(ex.people_in(F.col("lines"))))
    return found.groupBy("id", "name").agg(F.min_by("title", "pos").alias("title"))


@query("page_people", f"""{PAGES} SELECT domain, name, title, leader FROM (VALUES ('Orla Quist', 'Owner', true), ('Petra Venn', 'Office Manager', false), ('Tomas Ekdal', 'Founder & CEO', true)) v(name, title, leader),
  (SELECT DISTINCT domain FROM t WHERE seq % 13 = 10)""")
def page_people(spark, sf):
    e = ex.enrichment_rows(site_pages(spark, sf), YEAR, ["people"])
    return e.select("domain", F.explode("people").alias("p")).select(
        "domain", F.col("p.full_name").alias("name"), F.col("p.title").alias("title"), F.col("p.is_decision_maker").alias("leader"))


SITE = """SELECT domain, CASE WHEN id % 2 = 0 THEN 'alive' ELSE 'dead' END AS website_status, id % 2 = 0 AS has_ssl, CAST(200 AS INT) AS http_status,
  CASE WHEN id % 2 = 0 THEN concat('https://www.', domain, '/') END AS final_url FROM {mart_company} WHERE domain IS NOT NULL AND industry <> 'BUILDING'"""
FOUND = """SELECT domain, CASE WHEN id % 3 = 0 THEN concat('about ', name) END AS description, CASE WHEN id % 4 = 0 THEN CAST(1999 AS INT) END AS founded_year,
  CAST(2020 AS INT) AS copyright_year, id % 5 = 0 AS hiring, id % 6 = 0 AS family_owned FROM {mart_company} WHERE domain IS NOT NULL AND industry <> 'BUILDING'"""


@query("enrichment_apply", f"""{mart.with_views(mart_company=mart.COMPANY)}, s AS ({SITE.format(mart_company='mart_company')}), e AS ({FOUND.format(mart_company='mart_company')})
SELECT c.id, CASE WHEN s.domain IS NULL THEN c.website_status ELSE s.website_status END AS website_status, s.final_url AS website_url, e.description,
  coalesce(e.founded_year, c.founded_year) AS founded_year, CASE WHEN s.domain IS NULL THEN c.copyright_year ELSE e.copyright_year END AS copyright_year,
  CASE WHEN s.domain IS NULL THEN c.has_ssl ELSE s.has_ssl END AS has_ssl, CASE WHEN s.domain IS NULL THEN c.hiring ELSE e.hiring END AS hiring, s.domain IS NOT NULL AS enriched
FROM mart_company c LEFT JOIN s USING (domain) LEFT JOIN e USING (domain)""")
def enrichment_apply(spark, sf):
    c = company(spark, sf).withColumn("hiring_evidence", F.array_compact(F.array("hiring_evidence")))
    found = spark.sql(FOUND, mart_company=c)
    none = F.array().cast("array<string>")
    found = found.withColumns({
        "tech_stack": none, "socials": F.create_map().cast("map<string,string>"), "hiring_evidence": none,
        "modern_stack": F.lit(False), "family_owned_hint": F.lit(None).cast("string"), "n_pages": F.lit(1).cast("bigint")})
    out = ex.apply_enrichment(c, found, spark.sql(SITE, mart_company=c), "2024-01-01 00:00:00")
    return out.select("id", "website_status", "website_url", "description", "founded_year", "copyright_year", "has_ssl",
                      "hiring", F.col("last_enriched_at").isNotNull().alias("enriched"))


#: Pages with a head of their own; every fourth is the home page of its site.
DOCUMENTS = f"""SELECT seq, CASE WHEN seq % 4 = 0 THEN concat('https://', regexp_extract(url, '//([^/?#]+)', 1), '/') ELSE url END AS url,
  concat('<html><head><title> Mill &amp; Co ', seq, '</title><meta name="description" content="We bind ', seq, ' books"><meta property="og:site_name" content="Site ', seq % 7, '"></head><body>', html) AS html
FROM ({mart.PAGE})"""
DOCUMENTS_SQL = f"""WITH p AS {mart.sql_text(DOCUMENTS)}, b AS (SELECT seq, url, html, {blocks_sql('html')} AS blocks, {domain_sql('url')} AS domain FROM p),
t AS (SELECT *, array_to_string(blocks, ' ') AS text FROM b), {EMAILS_FOUND}, {PHONES_FOUND}, {SOCIALS_FOUND}, tf AS ({TECH_SQL}),
mails AS (SELECT domain, string_agg(email, ' ' ORDER BY o) AS emails FROM (SELECT domain, email, min(seq * 100000 + pos) AS o FROM em GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY domain ORDER BY min(seq * 100000 + pos)) <= 20) GROUP BY domain),
calls AS (SELECT domain, string_agg(phone, ' ' ORDER BY o) AS phones FROM (SELECT domain, phone, min(seq * 100000 + pos) AS o FROM ph GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY domain ORDER BY min(seq * 100000 + pos)) <= 10) GROUP BY domain),
nets AS (SELECT domain, string_agg(network || '=' || link, ' ' ORDER BY network) AS socials FROM so GROUP BY domain),
stack AS (SELECT domain, string_agg(product, ', ' ORDER BY o) AS tech_stack, bool_or(modern) AS modern_stack FROM (SELECT domain, product, bool_or(modern) AS modern, min(seq * 100 + pos) AS o FROM tf GROUP BY 1, 2) GROUP BY domain),
whole AS (SELECT domain, count(*) AS n_pages, min(seq) FILTER (seq % 4 = 0) AS home, string_agg(text, chr(10) ORDER BY seq) AS text, string_agg(html, chr(10) ORDER BY seq) AS html,
  {first_per_domain("regexp_extract(text, '" + lx.FAMILY + "')")} AS hint, {first_per_domain("regexp_extract(text, '" + HIRING_SQL + "')")} AS phrase, bool_or(seq % 13 = 10) AS staffed,
  bool_or(seq % 4 <> 0 AND regexp_matches(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '{lx.CAREERS_PATH}')) AS careers, bool_or(regexp_matches(html, '{lx.JOB_BOARD}')) AS board FROM t GROUP BY domain),
y AS (SELECT *, {{found}} AS founded, coalesce({{shown}}, {{source}}) AS copyright FROM whole)
SELECT domain, n_pages, coalesce(emails, '') AS emails, coalesce(phones, '') AS phones,
  CASE WHEN staffed THEN 'Orla Quist/Owner/true, Tomas Ekdal/Founder & CEO/true, Petra Venn/Office Manager/false' ELSE '' END AS people,
  coalesce(tech_stack, '') AS tech_stack, coalesce(modern_stack, false) AS modern_stack, coalesce(socials, '') AS socials, 'Mill & Co ' || home AS title, 'We bind ' || home || ' books' AS description,
  'Site ' || home % 7 AS site_name, founded AS founded_year, copyright AS copyright_year, hint IS NOT NULL AS family_owned, hint AS family_owned_hint,
  careers OR phrase IS NOT NULL OR board AS hiring, concat_ws(', ', CASE WHEN careers THEN 'careers page' END, '"' || phrase || '"', CASE WHEN board THEN 'job board link' END) AS hiring_evidence
FROM y LEFT JOIN mails USING (domain) LEFT JOIN calls USING (domain) LEFT JOIN nets USING (domain) LEFT JOIN stack USING (domain)"""


def years_sql(text: str, pattern: str, best: str, low: int, high: int) -> str:
    return f"list_{best}(list_filter(list_transform(regexp_extract_all({text}, '{pattern}', 1), lambda y: CAST(y AS INTEGER)), lambda y: y BETWEEN {low} AND {high}))"


DOCUMENTS_SQL = DOCUMENTS_SQL.replace("{found}", years_sql("text", lx.FOUNDED, "min", 1850, YEAR)).replace(
    "{shown}", years_sql("text", lx.COPYRIGHT, "max", 1990, YEAR + 1)).replace("{source}", years_sql("html", lx.COPYRIGHT, "max", 1990, YEAR + 1))


@query("enrichment_json", DOCUMENTS_SQL)
def enrichment_json(spark, sf):
    """Everything found on a site, stored as one document and read back field by field."""
    rows = ex.enrichment_rows(site_pages(spark, sf, DOCUMENTS), YEAR)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema if f.name != "domain"}
    e = ex.document_rows(checkpoint(ex.enrichment_documents(rows)), kinds)
    people = F.transform("people", lambda p: F.concat_ws("/", p["full_name"], p["title"], p["is_decision_maker"].cast("string")))
    socials = F.array_sort(F.transform(F.map_entries("socials"), lambda x: F.concat_ws("=", x["key"], x["value"])))

    def words(c, sep):
        return F.coalesce(F.array_join(c, sep), F.lit(""))

    return e.withColumns({
        "emails": words("emails", " "), "phones": words("phones", " "), "people": words(people, ", "), "tech_stack": words("tech_stack", ", "),
        "socials": words(socials, " "), "hiring_evidence": words("hiring_evidence", ", ")})


@query("signals_merge", """SELECT c_custkey AS id, 'ssl=' || CASE WHEN c_acctbal > 0 THEN 'new' ELSE 'old' END || ',hiring=' || c_mktsegment AS signals FROM customer""")
def signals_merge(spark, sf):
    old = F.create_map(F.lit("ssl"), F.lit("old"), F.lit("hiring"), F.col("c_mktsegment"))
    new = F.when(F.col("c_acctbal") > 0, F.create_map(F.lit("ssl"), F.lit("new"))).otherwise(F.create_map().cast("map<string,string>"))
    m = ex.merge_signals(old, new)
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("ssl="), m["ssl"], F.lit(",hiring="), m["hiring"]).alias("signals"))


# ---- contacts ----



def found_rows(spark, sf):
    """What the site says per company: two people, three addresses, maybe a phone."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("company_id"), "s_acctbal")
    p = [F.struct(F.lit(n).alias("full_name"), F.lit(t).alias("title"), F.lit(d).alias("is_decision_maker"))
         for n, t, d in (("Jane Roe", "Owner", True), ("Al Smith", "Manager", False))]
    return s.select(
        "company_id", F.array(*p).alias("people"),
        F.array(*[F.lit(x) for x in ("jroe@x.com", "asmith@x.com", "info@x.com")]).alias("emails"),
        F.when(F.col("s_acctbal") > 0, F.array(F.lit("+15125550100"))).otherwise(F.array().cast("array<string>")).alias("phones"))


@query("contacts_merge", f"""{mart.with_views(c=mart.CONTACT)}, s AS (SELECT s_suppkey AS company_id, s_acctbal FROM supplier),
k AS (SELECT company_id, 0 AS phase, seq, full_name, title, email, phone_e164, is_decision_maker FROM c),
n AS (SELECT company_id, 1 AS phase, 0 AS seq, 'Jane Roe' AS full_name, 'Owner' AS title, 'jroe@x.com' AS email, NULL AS phone_e164, true AS is_decision_maker FROM s
  UNION ALL SELECT company_id, 1, 1, 'Al Smith', 'Manager', 'asmith@x.com', NULL, false FROM s
  UNION ALL SELECT company_id, 2, 2, NULL, NULL, 'info@x.com', NULL, false FROM s),
a AS (SELECT * FROM k UNION ALL SELECT * FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY phone_e164 IS NOT NULL, NOT is_decision_maker, phase, seq) AS g FROM a)
SELECT company_id, CAST(phase AS INTEGER) AS phase, CAST(seq AS BIGINT) AS seq, full_name, title, email,
  CASE WHEN g = 1 AND phone_e164 IS NULL AND s_acctbal > 0 THEN '+15125550100' ELSE phone_e164 END AS phone_e164, is_decision_maker
FROM r LEFT JOIN s USING (company_id)""")
def contacts_merge(spark, sf):
    return ct.merge_contacts(contact(spark, sf), found_rows(spark, sf)).drop("source")


@query("contacts_validated", f"""{mart.with_views(mart_company=mart.COMPANY, c=mart.CONTACT)}
SELECT contact_id, coalesce(is_decision_maker, false) OR (title IS NOT NULL AND regexp_matches(lower(title), 'owner|founder|president') AND NOT contains(lower(title), 'assistant')) AS is_decision_maker,
  CASE WHEN email IS NULL THEN 'unknown' WHEN m.has_mx IS NULL THEN 'unknown' WHEN m.has_mx THEN 'valid_mx' ELSE 'no_mx' END AS email_status,
  phone_e164, phone_e164 IS NOT NULL AS phone_valid
FROM c LEFT JOIN (SELECT domain, CASE WHEN id % 3 = 0 THEN true WHEN id % 3 = 1 THEN false END AS has_mx FROM mart_company WHERE domain IS NOT NULL) m ON m.domain = split_part(c.email, '@', 2)""")
def contacts_validated(spark, sf):
    from leadmill.plans.catalog.normalize import MX

    c = company(spark, sf)
    out = ct.validate_contacts(contact(spark, sf), spark.sql(MX, mart_company=c), c)
    return out.select("contact_id", "is_decision_maker", "email_status", "phone_e164", "phone_valid")

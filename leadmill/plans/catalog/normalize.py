"""Normalisation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadmill import lexicons as lx
from leadmill.functions import normalize as nz
from leadmill.functions import phones as ph
from leadmill.functions.similarity import lcs_udf
from leadmill.plans import mart
from leadmill.plans.catalog.scoring import company, contact
from leadmill.plans.registry import query, table


def listed(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def domain_sql(text: str) -> str:
    """Registrable domain of a URL or bare host, NULL if none (no mail addresses)."""
    host = f"regexp_extract(lower(trim({text})), '^(?:[a-z][a-z0-9+.-]*://)?([^/?#:]*)', 1)"
    parts = f"string_split(trim({host}, '.'), '.')"
    n = f"len({parts})"
    last2 = f"array_to_string({parts}[-2:], '.')"
    pair = f"(regexp_matches({last2}, '^(com|co|net|org|edu|gov|ac)[.](uk|fr|ec|au|nz|za|br|mx|jp|in|pk)$') OR {last2} IN ('ltd.uk', 'me.uk') OR {parts}[-1] = 'ck')"
    keep = f"CASE WHEN {pair} THEN array_to_string({parts}[-3:], '.') ELSE {last2} END"
    return (f"CASE WHEN regexp_matches({parts}[-1], '^[a-z]+$') AND {parts}[-1] NOT IN ('localhost', 'local', 'html') "
            f"AND {n} >= (CASE WHEN {pair} THEN 3 ELSE 2 END) AND NOT contains({host}, ' ') THEN {keep} END")


def name_key_sql(text: str) -> str:
    t = f"regexp_replace(strip_accents({text}), '[^\\x00-\\x7F]', '', 'g')"
    t = f"replace(replace(lower({t}), '&', ' and '), '''', '')"
    t = f"trim(regexp_replace(regexp_replace({t}, '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
    t = f"regexp_replace({t}, '( ({'|'.join(lx.LEGAL_SUFFIXES)}))+$', '')"
    return f"regexp_replace(regexp_replace({t}, '(^| )l l c$', ''), '^the (.)', '\\1')"


TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


@query("blank_to_null", f"""SELECT id, CASE WHEN lower(trim(v)) IN ({listed(lx.BLANK_WORDS)}) THEN NULL ELSE trim(v) END AS v
FROM (SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN ' N/A ' WHEN 'MACHINERY' THEN 'null' WHEN 'HOUSEHOLD' THEN ' - '
  ELSE concat('  ', c_mktsegment, ' ') END AS v FROM customer)""")
def blank_to_null(spark, sf):
    v = (F.when(F.col("c_mktsegment") == "BUILDING", " N/A ").when(F.col("c_mktsegment") == "MACHINERY", "null")
         .when(F.col("c_mktsegment") == "HOUSEHOLD", " - ").otherwise(F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), nz.blank_to_null(v).alias("v"))


SIZE_TEXT = """SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN concat('$', p_size, '.5M') WHEN 1 THEN concat(p_size, '-', p_size + 40)
  WHEN 2 THEN concat('1,', lpad(CAST(p_size AS VARCHAR(9)), 3, '0')) WHEN 3 THEN concat('about ', p_size, ' k') WHEN 4 THEN p_name
  ELSE concat(p_size, ' big') END AS v FROM {part}"""


@query("parse_number", f"""SELECT id, CAST(floor(CAST(regexp_extract(w, '([0-9]+([.][0-9]+)?)[ ]*([kmb])?', 1) AS DOUBLE) *
  CASE regexp_extract(w, '([0-9]+([.][0-9]+)?)[ ]*([kmb])?', 3) WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'b' THEN 1e9 ELSE 1 END) AS BIGINT) AS n
FROM (SELECT id, replace(lower(v), ',', '') AS w FROM {mart.sql_text(SIZE_TEXT)}) WHERE regexp_matches(w, '[0-9]')
UNION ALL SELECT id, NULL FROM {mart.sql_text(SIZE_TEXT)} WHERE NOT regexp_matches(v, '[0-9]')""")
def parse_number(spark, sf):
    return mart.view(spark, sf, SIZE_TEXT).select("id", nz.parse_number("v").alias("n"))


@query("canonical_domain", f"SELECT page_id, {domain_sql('url')} AS domain, 'https://' || {domain_sql('url')} AS website FROM pages")
def canonical_domain(spark, sf):
    return table(spark, sf, "pages").withColumn("domain", nz.canonical_domain("url")).select(
        "page_id", "domain", nz.website_url("domain").alias("website"))


SITE = """SELECT c_custkey AS id, concat(CASE c_custkey % 3 WHEN 0 THEN 'https://www.' WHEN 1 THEN 'shop.' ELSE '' END, 'c', c_custkey,
  CASE c_custkey % 9 WHEN 0 THEN '.ltd' WHEN 1 THEN '.com.fr' WHEN 2 THEN '.com.ec' WHEN 3 THEN '.dentist' WHEN 4 THEN '.any.ck'
    WHEN 5 THEN '.localhost' WHEN 6 THEN '.co.de' WHEN 7 THEN '.me.uk' ELSE '.html' END) AS url FROM {customer}"""


@query("domain_suffixes", """SELECT c_custkey AS id, CASE c_custkey % 9 WHEN 0 THEN 'c' || c_custkey || '.ltd' WHEN 1 THEN 'c' || c_custkey || '.com.fr'
  WHEN 2 THEN 'c' || c_custkey || '.com.ec' WHEN 3 THEN 'c' || c_custkey || '.dentist' WHEN 4 THEN 'c' || c_custkey || '.any.ck' WHEN 6 THEN 'co.de'
  WHEN 7 THEN 'c' || c_custkey || '.me.uk' END AS domain FROM customer""")
def domain_suffixes(spark, sf):
    return mart.view(spark, sf, SITE).select("id", nz.canonical_domain("url").alias("domain"))


@query("domain_counts", f"SELECT {domain_sql('url')} AS domain, count(*) AS pages FROM pages GROUP BY 1")
def domain_counts(spark, sf):
    return table(spark, sf, "pages").groupBy(nz.canonical_domain("url").alias("domain")).agg(F.count("*").alias("pages"))


@query("lead_domain_fallback", f"""SELECT contact_id, {domain_sql("split_part(email, '@', 2)")} AS domain
FROM {mart.sql_text(mart.CONTACT)} WHERE email IS NOT NULL""")
def lead_domain_fallback(spark, sf):
    t = contact(spark, sf).filter("email IS NOT NULL")
    return t.select("contact_id", nz.lead_domain(F.lit(None).cast("string"), "email").alias("domain"))


@query("company_name_key", f"SELECT page_id, {name_key_sql(TITLE)} AS name_key FROM pages")
def company_name_key(spark, sf):
    raw = mart.view(spark, sf, mart.PAGE_LEAD)
    return raw.select(F.col("seq").alias("page_id"), nz.company_name_key("name").alias("name_key"))


@query("document_name_key", f"SELECT doc_id, {name_key_sql('text')} AS name_key FROM documents")
def document_name_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", nz.company_name_key("text").alias("name_key"))


@query("display_name", r"""SELECT conv_id, turn, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^[ ,.\-]+|[ ,.\-]+$', '', 'g') AS shown FROM conversations""")
def display_name(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", nz.display_name("text").alias("shown"))


MX = """SELECT domain, CASE WHEN id % 3 = 0 THEN true WHEN id % 3 = 1 THEN false END AS has_mx FROM {mart_company} WHERE domain IS NOT NULL"""
MAIL = """SELECT contact_id, company_id, CASE title WHEN 'Owner' THEN concat('Temp', contact_id, '@Mailinator.com') WHEN 'Office Manager'
  THEN replace(email, '@', '@@') ELSE upper(email) END AS email FROM {mart_contact} WHERE email IS NOT NULL"""
MAIL_SQL = f"""{mart.with_views(mart_company=mart.COMPANY, mart_contact=mart.CONTACT)},
mx AS ({MX.format(mart_company='mart_company')}), mail AS ({MAIL.format(mart_contact='mart_contact')})"""


@query("email_checks", f"""{MAIL_SQL} SELECT contact_id, lower(m.email) AS email,
  CASE WHEN contains(m.email, '@@') THEN 'invalid_syntax' WHEN lower(split_part(m.email, '@', 2)) IN ({listed(lx.DISPOSABLE_HOSTS)}) THEN 'disposable'
    WHEN has_mx IS NULL THEN 'unknown' WHEN has_mx THEN 'valid_mx' ELSE 'no_mx' END AS email_status,
  CASE WHEN contains(m.email, '@@') THEN NULL WHEN split_part(split_part(lower(m.email), '@', 1), '+', 1) IN ({listed(lx.ROLE_MAILBOXES)}) THEN 'role' ELSE 'personal' END AS email_type
FROM mail m LEFT JOIN mx ON mx.domain = lower(split_part(m.email, '@', 2))""")
def email_checks(spark, sf):
    from leadmill.operators.contacts import check_emails

    mx = spark.sql(MX, mart_company=company(spark, sf))
    mail = spark.sql(MAIL, mart_contact=contact(spark, sf))
    return check_emails(mail, mx).select("contact_id", "email", "email_status", "email_type")


@query("email_types", f"""SELECT email_type, count(*) AS n FROM (SELECT CASE WHEN split_part(split_part(lower(email), '@', 1), '+', 1)
  IN ({listed(lx.ROLE_MAILBOXES)}) THEN 'role' ELSE 'personal' END AS email_type FROM {mart.sql_text(mart.CONTACT)} WHERE email IS NOT NULL) GROUP BY 1""")
def email_types(spark, sf):
    t = contact(spark, sf).filter("email IS NOT NULL")
    return t.groupBy(nz.mailbox_type("email").alias("email_type")).agg(F.count("*").alias("n"))


@query("mx_join", f"""{MAIL_SQL} SELECT host, bool_or(has_mx) AS has_mx FROM (
  SELECT DISTINCT lower(split_part(email, '@', 2)) AS host FROM mail WHERE NOT contains(email, '@@')) LEFT JOIN mx ON domain = host GROUP BY host""")
def mx_join(spark, sf):
    from leadmill.operators.contacts import mx_answers

    return mx_answers(spark.sql(MAIL, mart_contact=contact(spark, sf)), spark.sql(MX, mart_company=company(spark, sf)))


@query("person_emails", f"""SELECT contact_id, split_part(email, '@', 1) IN ('pat', 'patbuyer', 'pbuyer', 'buyerp', 'buyer') AS fits FROM (
  SELECT contact_id, CASE contact_id % 4 WHEN 1 THEN 'p.buyer@x.com' WHEN 2 THEN 'office@x.com' ELSE email END AS email, title
  FROM {mart.sql_text(mart.CONTACT)}) WHERE email IS NOT NULL AND NOT contains(email, '.buyer')
UNION ALL SELECT contact_id, true FROM {mart.sql_text(mart.CONTACT)} WHERE contact_id % 4 = 1""")
def person_emails(spark, sf):
    mail = F.when(F.col("contact_id") % 4 == 1, "p.buyer@x.com").when(F.col("contact_id") % 4 == 2, "office@x.com").otherwise(F.col("email"))
    t = contact(spark, sf).withColumn("email", mail).filter("email IS NOT NULL")
    return t.select("contact_id", nz.email_matches_person("email", F.lit("Pat Q7 Buyer")).alias("fits"))


@query("decision_makers", f"""SELECT title, count(*) AS n, bool_or(coalesce(regexp_matches(lower(title), '{'|'.join(lx.DECISION_TITLES)}')
  AND NOT contains(lower(title), 'assistant'), false)) AS leader FROM {mart.sql_text(mart.CONTACT)} GROUP BY title""")
def decision_makers(spark, sf):
    return contact(spark, sf).groupBy("title").agg(
        F.count("*").alias("n"), F.bool_or(nz.is_decision_maker("title")).alias("leader"))


PHONE_TEXT = """SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN concat('(512) 555-', lpad(CAST(o_orderkey % 10000 AS VARCHAR(9)), 4, '0'))
    WHEN 1 THEN concat('+44 20 7', lpad(CAST(o_orderkey % 1000 AS VARCHAR(9)), 3, '0'), ' 4567') WHEN 2 THEN concat('020 7123 ', lpad(CAST(o_orderkey % 10000 AS VARCHAR(9)), 4, '0'))
    WHEN 3 THEN concat('555-', lpad(CAST(o_orderkey % 10000 AS VARCHAR(9)), 4, '0')) WHEN 4 THEN 'call us' WHEN 5 THEN concat('1-800-555-', lpad(CAST(o_orderkey % 10000 AS VARCHAR(9)), 4, '0'))
    ELSE concat('tel. 512.155.', lpad(CAST(o_orderkey % 10000 AS VARCHAR(9)), 4, '0')) END AS raw,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'UK' WHEN '2-HIGH' THEN 'United States' WHEN '3-MEDIUM' THEN NULL WHEN '5-LOW' THEN 'gb' ELSE 'Narnia' END AS country FROM {orders}"""


@query("phone_checks", f"""SELECT id, region, e164, e164 IS NOT NULL AS valid, CASE WHEN e164 LIKE '+1800%' THEN 'toll_free' WHEN e164 LIKE '+1%' THEN 'fixed_line_or_mobile' WHEN e164 IS NOT NULL THEN 'fixed_line' END AS kind
FROM (SELECT id, region, CASE WHEN id % 7 = 1 THEN '+' || digits WHEN region = 'US' AND id % 7 IN (0, 5) THEN '+1' || right(digits, 10)
    WHEN region = 'GB' AND id % 7 = 2 THEN '+44' || substr(digits, 2) END AS e164
  FROM (SELECT id, regexp_replace(raw, '[^0-9]', '', 'g') AS digits, CASE WHEN country IN ('UK', 'gb') THEN 'GB' ELSE 'US' END AS region FROM {mart.sql_text(PHONE_TEXT)}))""")
def phone_checks(spark, sf):
    t = mart.view(spark, sf, PHONE_TEXT).withColumn("region", ph.region_for("country"))
    t = t.withColumn("e164", ph.to_e164("raw", "region"))
    return t.select("id", "region", "e164", F.col("e164").isNotNull().alias("valid"), ph.phone_kind("e164").alias("kind"))


#: Country, what is written before three digits, the E.164 form up to them, kind: expected values of their own, of 34 numbers.
PLANNED = [
    ("PL", "512 345 ", "+48512345", "mobile"), ("PT", "912 345 ", "+351912345", "mobile"), ("FI", "040 123 4", "+358401234", "mobile"),
    ("CZ", "222 345 ", "+420222345", "fixed_line"), ("GR", "21 0123 4", "+302101234", "fixed_line"), ("HU", "06 1 234 5", "+3612345", "fixed_line"),
    ("RO", "021 234 5", "+40212345", "fixed_line"), ("TR", "0532 123 4", "+905321234", "mobile"), ("IL", "072-234-5", "+972722345", "voip"),
    ("AE", "050 123 4", "+971501234", "mobile"), ("SA", "011 234 5", "+966112345", "fixed_line"), ("JP", "050-1234-5", "+815012345", "voip"),
    ("JP", "0120-123-", "+81120123", "toll_free"), ("CN", "138 0013 8", "+8613800138", "mobile"), ("KR", "070-1234-5", "+827012345", "voip"),
    ("HK", "2345 6", "+85223456", "fixed_line"), ("MY", "012-345 6", "+60123456", "mobile"), ("PH", "0917 123 4", "+639171234", "mobile"),
    ("TH", "02 123 4", "+6621234", "fixed_line"), ("AR", "011 4123-4", "+541141234", "fixed_line"), ("CL", "9 1234 5", "+56912345", "mobile"),
    ("CO", "310 123 4", "+573101234", "mobile"), ("RU", "8 (495) 123-4", "+74951234", "fixed_line"), ("UA", "050 123 4", "+380501234", "mobile"),
    ("DE", "0900 123 4", "+499001234", None), ("US", "900-555-0", "+19005550", None), ("GB", "056 1234 5", "+445612345", "voip"),
    ("GB", "0909 123 4", "+449091234", None), ("CA", "(416) 555-0", "+14165550", "fixed_line_or_mobile"), ("FR", "06 12 34 5", "+33612345", "mobile"),
    ("BR", "(11) 91234-5", "+5511912345", "mobile"), ("ES", "900 123 ", "+34900123", "toll_free"), ("IT", "06 1234 5", "+390612345", "fixed_line"),
    ("AU", "1800 123 ", "+611800123", "toll_free"),
]


def planned(column: int, key: str) -> str:
    """SQL: a column of PLANNED by a row's key."""
    return f"CASE {key} % {len(PLANNED)} " + " ".join(f"WHEN {i} THEN " + ("NULL" if p[column] is None else f"'{p[column]}'") for i, p in enumerate(PLANNED)) + " END"


PLANNED_TEXT = f"SELECT o_orderkey AS id, {planned(0, 'o_orderkey')} AS country, concat({planned(1, 'o_orderkey')}, lpad(CAST(o_orderkey % 1000 AS VARCHAR(9)), 3, '0')) AS raw FROM {{orders}}"


@query("phone_plans", f"""SELECT o_orderkey AS id, concat({planned(2, 'o_orderkey')}, lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0')) AS e164, {planned(3, 'o_orderkey')} AS kind FROM orders""")
def phone_plans(spark, sf):
    """Numbers under the plans of 30 and more regions, written as at home."""
    t = mart.view(spark, sf, PLANNED_TEXT)
    t = t.withColumn("e164", ph.to_e164("raw", ph.region_for("country")))
    return t.select("id", "e164", ph.phone_kind("e164").alias("kind"))


@query("phone_region", f"""SELECT country, CASE WHEN country IN ('UK', 'gb') THEN 'GB' ELSE 'US' END AS region, count(*) AS n
FROM {mart.sql_text(PHONE_TEXT)} GROUP BY 1, 2""")
def phone_region(spark, sf):
    t = mart.view(spark, sf, PHONE_TEXT)
    return t.groupBy("country", ph.region_for("country").alias("region")).agg(F.count("*").alias("n"))


@query("same_place", f"""SELECT a.seq, (a.city IS NULL OR b.city IS NULL OR lower(trim(a.city)) = lower(trim(b.city))) AS near
FROM {mart.sql_text(mart.PAGE_LEAD)} a JOIN {mart.sql_text(mart.PAGE_LEAD)} b ON b.seq = a.seq + 1""")
def same_place(spark, sf):
    raw = mart.view(spark, sf, mart.PAGE_LEAD)
    nxt = raw.select((F.col("seq") - 1).alias("seq"), F.col("city").alias("city_b"))
    return raw.join(nxt, "seq").select("seq", nz.same_place("city", "city_b").alias("near"))


@query("name_similarity", """WITH p AS (SELECT a.p_partkey AS id, list_aggregate(list_sort(string_split(a.p_name, ' ')), 'string_agg', ' ') AS x,
    list_aggregate(list_sort(string_split(b.p_name, ' ')), 'string_agg', ' ') AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
 d AS (SELECT DISTINCT x, y FROM p),
 l AS (SELECT x, y, list_last(list_reduce(list_prepend([0 FOR q IN range(length(y) + 1)], string_split(x, '')::VARCHAR[].list_transform(lambda c: [CAST(unicode(c) AS BIGINT)])),
    lambda acc, c: list_reduce(list_prepend([CAST(0 AS BIGINT)], list_transform(range(1, length(y) + 1), lambda j: [CAST(j AS BIGINT)])),
      lambda r, j: list_append(r, CASE WHEN unicode(y[j[1]:j[1]]) = c[1] THEN acc[j[1]] + 1 ELSE greatest(acc[j[1] + 1], r[len(r)]) END)))) AS lcs FROM d)
SELECT id, CAST(lcs AS INTEGER) AS lcs, 50 * lcs >= 23 * (length(x) + length(y)) AS similar FROM p JOIN l USING (x, y)""")
def name_similarity(spark, sf):
    from leadmill.functions.similarity import is_similar

    part = table(spark, sf, "part").select("p_partkey", nz.sorted_tokens("p_name").alias("x"))
    nxt = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("x").alias("y"))
    both = part.join(nxt, "p_partkey").withColumn("lcs", lcs_udf("x", "y"))
    return both.select(F.col("p_partkey").alias("id"), "lcs", is_similar(F.col("lcs"), F.length("x"), F.length("y")).alias("similar"))

"""Intake, entity resolution and update queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadmill import lexicons as lx
from leadmill.functions import normalize as nz
from leadmill.operators import dedupe as dd
from leadmill.operators import upsert as up
from leadmill.operators.namejoin import similar_pairs
from leadmill.plans import mart
from leadmill.plans.catalog.normalize import domain_sql, listed, name_key_sql
from leadmill.plans.catalog.scoring import company, contact
from leadmill.plans.registry import query, table
from leadmill.session import checkpoint
from leadmill.sources import delimited as dl

# ---- headers, delimiters, skipped rows: header lines made of the given rows ----

HEADERS = """SELECT concat('f', s_suppkey) AS file, concat_ws(CASE s_suppkey % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN '|' ELSE chr(9) END,
  CASE WHEN s_nationkey % 3 = 0 THEN ' Company_Name ' ELSE 'Brand' END, CASE WHEN s_nationkey % 5 = 0 THEN 'WEBSITE' ELSE 'Town' END, 'URL', 'E-Mail',
  CASE WHEN s_acctbal > 5000 THEN 'Owner Name' ELSE 'State/Province' END, 'Sector', s_name) AS header FROM {supplier}"""
FIELD_SQL = """CASE trim(regexp_replace(lower(h), '[^a-z0-9/]+', ' ', 'g')) WHEN 'company name' THEN 'name' WHEN 'website' THEN 'domain' WHEN 'url' THEN 'domain'
  WHEN 'town' THEN 'city' WHEN 'e mail' THEN 'email' WHEN 'owner name' THEN 'owner' WHEN 'state/province' THEN 'state' WHEN 'sector' THEN 'industry' END"""
HEADER_SQL = f"""WITH f AS {mart.sql_text(HEADERS)}, c AS (SELECT file, unnest(l) AS h, generate_subscripts(l, 1) - 1 AS pos FROM (
    SELECT file, regexp_split_to_array(header, '[,;|' || chr(9) || ']') AS l FROM f)),
 m AS (SELECT file, CAST(pos AS INTEGER) AS pos, h AS header, CASE WHEN row_number() OVER (PARTITION BY file, {FIELD_SQL} ORDER BY pos) = 1 THEN {FIELD_SQL} END AS field FROM c)"""


def looks(spark, sf):
    t = mart.view(spark, sf, HEADERS)
    return t.withColumns({"delimiter": dl.infer_delimiter(F.col("header")), "bytes": F.length("header").cast("bigint"),
                          "encoding": F.lit("UTF-8")})


@query("delimiter_inference", """SELECT concat('f', s_suppkey) AS file, CASE s_suppkey % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN '|' ELSE chr(9) END AS delimiter FROM supplier""")
def delimiter_inference(spark, sf):
    return looks(spark, sf).select("file", "delimiter")


@query("header_mapping", f"{HEADER_SQL} SELECT * FROM m WHERE field IS NOT NULL")
def header_mapping(spark, sf):
    return dl.map_headers(dl.header_table(looks(spark, sf))).filter("field IS NOT NULL")


@query("unmapped_headers", f"{HEADER_SQL} SELECT header, count(*) AS files FROM m WHERE field IS NULL GROUP BY header")
def unmapped_headers(spark, sf):
    m = dl.map_headers(dl.header_table(looks(spark, sf))).filter("field IS NULL")
    return m.groupBy("header").agg(F.count("*").alias("files"))


@query("file_reports", f"""{HEADER_SQL} SELECT file, CASE WHEN bool_or(field = 'owner') AND bool_or(field = 'email') AND bool_or(field = 'industry') THEN 'vendor_csv' ELSE 'csv' END AS source,
  CASE WHEN max(len(f.header)) > 60 THEN 'IMPORT_TOO_LARGE' WHEN NOT bool_or(field = 'domain') AND NOT bool_or(field = 'name') THEN 'IMPORT_INVALID_CSV' END AS error
FROM m JOIN f USING (file) GROUP BY file""")
def file_reports(spark, sf):
    k = looks(spark, sf)
    return dl.file_report(k, dl.map_headers(dl.header_table(k)), max_bytes=60).select("file", "source", "error")


@query("skipped_rows", """SELECT file, skipped, kept, CASE WHEN skipped > 0 THEN skipped || ' rows had no company name or website and were skipped.' END AS warning
FROM (SELECT c_mktsegment AS file, count(*) FILTER (c_acctbal < 0 AND c_nationkey < 5) AS skipped, count(*) FILTER (NOT (c_acctbal < 0 AND c_nationkey < 5)) AS kept FROM customer GROUP BY 1)""")
def skipped_rows(spark, sf):
    t = table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("file"), F.col("c_custkey").alias("row_number"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_name")).otherwise(" n/a ").alias("name"),
        F.when(F.col("c_nationkey") >= 5, F.concat("c_name", F.lit(".com"))).otherwise("NULL").alias("domain"))
    return dl.skip_nameless(dl.typed_rows(t))[1]


@query("domain_list_import", f"""WITH l AS (SELECT lang AS file, unnest(x) AS line, generate_subscripts(x, 1) AS row_number FROM (
  SELECT lang, regexp_split_to_array(string_agg(text, chr(10) ORDER BY doc_id), '\\r\\n|\\n|\\r') AS x FROM documents GROUP BY lang))
SELECT file, CAST(row_number AS INTEGER) AS row_number, trim(regexp_replace(line, '^\\s+|\\s+$', '', 'g')) AS website FROM l WHERE regexp_replace(line, '^\\s+|\\s+$', '', 'g') <> ''""".replace(
    "SELECT lang, regexp_split_to_array(string_agg(text, chr(10) ORDER BY doc_id), '\\r\\n|\\n|\\r') AS x FROM documents GROUP BY lang",
    "SELECT CAST(doc_id AS VARCHAR) AS lang, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS x FROM documents"))
def domain_list_import(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file"), "text")
    return dl.domain_list(docs)


@query("paste_domains", r"""SELECT file, token, min(pos) AS pos FROM (SELECT file, lower(unnest(x)) AS token, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS pos FROM (
  SELECT CAST(doc_id AS VARCHAR) AS file, regexp_split_to_array(text, '[\s,;]+') AS x FROM documents)) WHERE contains(token, '.') GROUP BY file, token""")
def paste_domains(spark, sf):
    return dl.pasted_domains(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file"), "text"))


@query("domain_import_dropped", f"""SELECT file, count(*) FILTER (d IS NULL) AS dropped, count(*) FILTER (d IS NOT NULL) AS kept,
  CASE WHEN count(*) FILTER (d IS NULL) > 0 THEN 'Skipped ' || count(*) FILTER (d IS NULL) || ' entries that aren''t valid domains.' END AS warning
FROM (SELECT file, {domain_sql('w')} AS d FROM (SELECT o_orderpriority AS file, CASE o_orderstatus WHEN 'F' THEN concat('www.c', o_custkey, '.co.uk') WHEN 'O' THEN 'localhost' ELSE concat('http://c', o_custkey, '.shop/x') END AS w FROM orders)) GROUP BY file""")
def domain_import_dropped(spark, sf):
    key = F.col("o_custkey").cast("string")
    site = (F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("www.c"), key, F.lit(".co.uk"))).when(F.col("o_orderstatus") == "O", "localhost")
            .otherwise(F.concat(F.lit("http://c"), key, F.lit(".shop/x"))))
    return dl.usable_domains(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("file"), site.alias("website")))[1]


# ---- entity resolution ----

RAW = f"""{mart.with_views(raw=mart.PAGE_LEAD)}, c AS (SELECT *, {domain_sql('website')} AS domain,
  trim(regexp_replace(name, '\\s+', ' ', 'g'), ' ,.-') AS shown FROM raw),
g AS (SELECT *, min(seq) OVER (PARTITION BY domain) AS keeper FROM c)"""


def page_leads(spark, sf):
    return mart.view(spark, sf, mart.PAGE_LEAD)


def decided(spark, sf, known=None):
    return dd.exact_decisions(dd.candidates(page_leads(spark, sf)), known)


@query("dedup_exact", f"""{RAW} SELECT keeper AS seq, domain, arg_min(shown, seq) FILTER (shown <> '') AS name, arg_min(city, seq) FILTER (city <> '') AS city,
  arg_min(state, seq) FILTER (state <> '') AS state, CAST(arg_min(employees, seq) FILTER (employees IS NOT NULL) AS INTEGER) AS employees, count(*) - 1 AS merged_count FROM g GROUP BY keeper, domain""")
def dedup_exact(spark, sf):
    out = dd.merged_leads(decided(spark, sf))
    return out.select("seq", "domain", "name", "city", "state", F.col("employees").cast("int").alias("employees"), "merged_count")


@query("dedup_existing_dropped", f"""{RAW} SELECT seq, CASE WHEN domain = 'example.net' THEN 'existing' WHEN seq = keeper THEN 'keep' ELSE 'exact' END AS decision,
  CASE WHEN domain = 'example.net' THEN NULL ELSE keeper END AS keeper FROM g""")
def dedup_existing_dropped(spark, sf):
    known = page_leads(spark, sf).filter("website LIKE '%example.net%'").select(nz.canonical_domain("website").alias("domain"))
    mail = contact(spark, sf).select(nz.canonical_domain("email").alias("domain"))
    return decided(spark, sf, known.unionByName(mail)).select("seq", "decision", "keeper")


@query("dedup_log", f"""{RAW} SELECT CASE WHEN seq = keeper THEN 'keep' ELSE 'exact' END AS decision, count(*) AS n FROM g GROUP BY 1""")
def dedup_log(spark, sf):
    return dd.dedupe(page_leads(spark, sf)).groupBy("decision").agg(F.count("*").alias("n"))


NAMES = "SELECT s_name AS name FROM {supplier} UNION ALL SELECT concat(p_name, ' ', p_brand, ' ', p_type, ' Co.') FROM {part}"

OWNED = """SELECT o_orderkey AS seq, concat('c', o_custkey, '.com') AS website, CASE o_orderstatus WHEN 'F' THEN concat('Buyer ', o_custkey % 7) WHEN 'O' THEN concat('BUYER ', o_custkey % 7) END AS owner,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Boss@x.com' WHEN '2-HIGH' THEN 'boss@x.com' END AS email, CASE WHEN o_totalprice > 250000 THEN '555-0100' END AS phone FROM {orders}"""


@query("dedup_contacts", f"""WITH o AS {mart.sql_text(OWNED)}, k AS (SELECT min(seq) OVER (PARTITION BY website) AS company_seq, * FROM o)
SELECT company_seq, min(seq) AS seq, arg_min(owner, seq) FILTER (owner IS NOT NULL) AS full_name, arg_min(email, seq) FILTER (email IS NOT NULL) AS email, max(phone) AS phone FROM k WHERE owner IS NOT NULL OR email IS NOT NULL OR phone IS NOT NULL
GROUP BY company_seq, lower(coalesce(email, '')), lower(coalesce(owner, '')), coalesce(phone, '')""")
def dedup_contacts(spark, sf):
    d = dd.exact_decisions(dd.candidates(mart.view(spark, sf, OWNED)))
    return dd.contact_seeds(d).select("company_seq", "seq", "full_name", "email", "phone")


def nodomain(spark, sf):
    return mart.view(spark, sf, mart.NODOMAIN_LEAD)


def name_table(spark, sf):
    key = nz.sorted_tokens(nz.company_name_key("name"))
    return checkpoint(mart.view(spark, sf, NAMES).select(key.alias("name")).distinct().withColumn("cand", F.lit(True)))


@query("dedup_fuzzy_pairs", f"""WITH n AS (SELECT DISTINCT list_aggregate(list_sort(string_split({name_key_sql('name')}, ' ')), 'string_agg', ' ') AS x FROM {mart.sql_text(NAMES)}),
p AS (SELECT a.x, b.x AS y FROM n a JOIN n b ON a.x < b.x AND 27 * least(len(a.x), len(b.x)) >= 23 * greatest(len(a.x), len(b.x)) AND levenshtein(a.x, b.x) <= 2 * (len(a.x) + len(b.x)) // 25),
l AS (SELECT x, y, list_last(list_reduce(list_prepend([0 FOR q IN range(length(y) + 1)], string_split(x, '')::VARCHAR[].list_transform(lambda c: [CAST(unicode(c) AS BIGINT)])),
    lambda acc, c: list_reduce(list_prepend([CAST(0 AS BIGINT)], list_transform(range(1, length(y) + 1), lambda j: [CAST(j AS BIGINT)])),
      lambda r, j: list_append(r, CASE WHEN unicode(y[j[1]:j[1]]) = c[1] THEN acc[j[1]] + 1 ELSE greatest(acc[j[1] + 1], r[len(r)]) END)))) AS lcs FROM p)
SELECT x AS a, y AS b, CAST(lcs AS INTEGER) AS lcs FROM l WHERE 50 * lcs >= 23 * (len(x) + len(y))""")
def dedup_fuzzy_pairs(spark, sf):
    return similar_pairs(name_table(spark, sf))


@query("dedup_fuzzy")
def dedup_fuzzy(spark, sf):
    return dd.dedupe(nodomain(spark, sf)).select("seq", "decision", "keeper")


# ---- changes ----

INCOMING = """SELECT 100000000 + s_suppkey AS id, s_name AS name, concat('c', s_suppkey, '-shop.com') AS domain, 'NEW INDUSTRY' AS industry, 'here' AS country, CAST(7 AS INT) AS employee_count, 99 AS import_id FROM {supplier}"""


@query("upsert_fill_gaps", f"""{mart.with_views(o=mart.COMPANY, n=INCOMING)} SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NOT NULL THEN o.name ELSE n.name END AS name,
  coalesce(o.domain, n.domain) AS domain, coalesce(o.industry, n.industry) AS industry, coalesce(o.employee_count, n.employee_count) AS employee_count,
  CASE WHEN n.id IS NOT NULL THEN 99 ELSE o.import_id END AS import_id FROM o FULL OUTER JOIN n ON o.domain = n.domain""")
def upsert_fill_gaps(spark, sf):
    fresh = mart.view(spark, sf, INCOMING).withColumn("import_id", F.col("import_id").cast("bigint"))
    out = up.upsert_companies(company(spark, sf), fresh, "2024-01-01 00:00:00")
    return out.select("id", "name", "domain", "industry", "employee_count", "import_id")


SEED = """SELECT contact_id + 100000000 AS contact_id, company_id, seq, full_name, upper(email) AS email FROM {c} WHERE title = 'Owner'
UNION ALL SELECT contact_id + 200000000, company_id + 1, seq, full_name, email FROM {c} WHERE title = 'Vice President'"""


@query("contact_insert", f"""{mart.with_views(c=mart.CONTACT)}, s AS (SELECT *, 1 AS r FROM ({SEED.format(c='c')})), a AS (SELECT contact_id, company_id, seq, full_name, email, 0 AS r FROM c UNION ALL SELECT contact_id, company_id, seq, full_name, lower(email), r FROM s)
SELECT contact_id, company_id, email FROM (SELECT *, row_number() OVER (PARTITION BY company_id, email ORDER BY r, seq) AS k FROM a) WHERE k = 1 OR email IS NULL""")
def contact_insert(spark, sf):
    c = contact(spark, sf)
    known = c.select("contact_id", "company_id", "seq", "full_name", "email")
    return up.insert_contacts(known, spark.sql(SEED, c=c)).select("contact_id", "company_id", "email")


def picked(spark, sf):
    return table(spark, sf, "orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("id"))


PICKED = "(SELECT o_custkey FROM orders WHERE o_totalprice > 450000)"


@query("bulk_set_stage", f"{mart.with_views(c=mart.COMPANY)} SELECT id, CASE WHEN id IN {PICKED} THEN 'contacted' ELSE stage END AS stage FROM c")
def bulk_set_stage(spark, sf):
    return up.bulk_set_stage(company(spark, sf), picked(spark, sf), "contacted")[0].select("id", "stage")


@query("bulk_affected", f"{mart.with_views(c=mart.COMPANY)} SELECT count(*) AS affected FROM c WHERE id IN {PICKED}")
def bulk_affected(spark, sf):
    return up.bulk_set_stage(company(spark, sf), picked(spark, sf), "contacted")[1]


@query("bulk_delete", f"""{mart.with_views(c=mart.COMPANY, t=mart.CONTACT)} SELECT 'company' AS kind, id AS key FROM c WHERE id NOT IN {PICKED}
UNION ALL SELECT 'contact', contact_id FROM t WHERE company_id NOT IN {PICKED}""")
def bulk_delete(spark, sf):
    left, people, _ = up.bulk_delete(company(spark, sf), contact(spark, sf), picked(spark, sf))
    return left.select(F.lit("company").alias("kind"), F.col("id").alias("key")).unionByName(
        people.select(F.lit("contact").alias("kind"), F.col("contact_id").alias("key")))


@query("patch_lead", f"""{mart.with_views(c=mart.COMPANY)} SELECT id, CASE WHEN s.s_acctbal > 0 THEN 'qualified' ELSE stage END AS stage,
  CASE WHEN s.s_suppkey IS NULL THEN industry WHEN s.s_acctbal > 5000 THEN NULL ELSE s.s_name END AS industry FROM c LEFT JOIN supplier s ON s.s_suppkey = c.id""")
def patch_lead(spark, sf):
    s = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.lit("qualified").alias("stage"), (F.col("s_acctbal") > 0).alias("has_stage"),
        F.when(F.col("s_acctbal") <= 5000, F.col("s_name")).alias("industry"), F.lit(True).alias("has_industry"))
    return up.patch_leads(company(spark, sf), s).select("id", "stage", "industry")


@query("orphan_jobs", f"""{mart.with_views(c=mart.COMPANY)} SELECT id, CASE WHEN import_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) THEN import_id END AS import_id FROM c""")
def orphan_jobs(spark, sf):
    jobs = table(spark, sf, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("job_id"))
    return up.detach_deleted_jobs(company(spark, sf), jobs).select("id", "import_id")


@query("distinct_selection", "SELECT DISTINCT o_custkey AS id FROM orders")
def distinct_selection(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("id")).distinct()

"""Lead list, search, contacts, export and dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadmill import lexicons as lx
from leadmill.operators import leads as ld
from leadmill.operators import scoring as sc
from leadmill.operators import stats as st
from leadmill.plans import mart
from leadmill.plans.catalog.scoring import (
    ACQUISITION, BASE, GRADE, SALES, SQL_ACQ, SQL_SALES, YEAR, company, contact,
)
from leadmill.plans.registry import query, table
from leadmill.sources.export import export_rows

TS = "CASE WHEN id % 4 <> 1 THEN TIMESTAMP '2024-01-01 00:00:00' END"
LEADS_SQL = f"""{BASE}, {SQL_SALES}, leads AS (
  SELECT c.*, s.score, {GRADE} AS grade, s.breakdown FROM mart_company c JOIN sales s USING (id))"""
CONTACT_TEXT = ["full_name", "title", "email", "phone_e164"]


def leads(spark, sf, profile=SALES):
    c = company(spark, sf)
    return sc.score_leads(sc.lead_facts(c, contact(spark, sf)), profile, YEAR).select(
        *c.columns, "score", "grade", "breakdown"
    )


def short(df):
    return df.select("id", "name", "score", "grade")


@query("lead_top_n", f"{LEADS_SQL} SELECT id, name, score, grade, breakdown FROM leads ORDER BY score DESC, id LIMIT 25")
def lead_top_n(spark, sf):
    from leadmill.plans.catalog.scoring import breakdown_text

    top = ld.page(leads(spark, sf), ld.LeadFilters())
    return top.select("id", "name", "score", "grade", breakdown_text().alias("breakdown"))


@query("lead_page_3", f"{LEADS_SQL} SELECT id, name, score, grade FROM leads ORDER BY founded_year ASC NULLS LAST, id LIMIT 25 OFFSET 50")
def lead_page_3(spark, sf):
    return short(ld.page(leads(spark, sf), ld.LeadFilters(sort="founded_year", order="asc"), 3))


@query("lead_seek_page", f"{LEADS_SQL} SELECT id, name, score, grade FROM leads WHERE id > 70 ORDER BY id LIMIT 500")
def lead_seek_page(spark, sf):
    return short(ld.seek(leads(spark, sf), 70))


@query("lead_total", f"{LEADS_SQL} SELECT count(*) AS total FROM leads WHERE grade IN ('A', 'B', 'C')")
def lead_total(spark, sf):
    f = ld.LeadFilters(grade=("a,b", "C"))
    return ld.page_rows(leads(spark, sf), contact(spark, sf), f)[1]


@query("lead_filter_all", f"""{LEADS_SQL} SELECT id, name, score, grade FROM leads
WHERE grade IN ('B', 'C') AND score >= 45 AND lower(industry) LIKE '%mach%' AND stage = 'qualified'
  AND lower(country) = 'nation_7' OR (import_id = 5 AND score >= 60)""")
def lead_filter_all(spark, sf):
    all_leads = leads(spark, sf)
    a = ld.filter_leads(all_leads, ld.LeadFilters(
        grade="b,C", min_score=45, industry=" mach", stage="qualified", country="Nation_7 "))
    b = ld.filter_leads(all_leads, ld.LeadFilters(import_id=5, min_score=60))
    return short(a.unionByName(b).dropDuplicates(["id"]))


@query("lead_filter_email", f"""{LEADS_SQL} SELECT id, name, score, grade FROM leads l
WHERE EXISTS (SELECT 1 FROM mart_contact t WHERE t.company_id = l.id AND t.email_status = 'no_mx')""")
def lead_filter_email(spark, sf):
    f = ld.LeadFilters(email_status="no_mx")
    return short(ld.filter_leads(leads(spark, sf), f, contact(spark, sf)))


@query("preset_top_prospects", f"""{LEADS_SQL} SELECT id, name, score, grade FROM leads l WHERE grade IN ('A', 'B')
 AND EXISTS (SELECT 1 FROM mart_contact t WHERE t.company_id = l.id AND t.email_status = 'valid_mx')
 ORDER BY score DESC, id LIMIT 25""")
def preset_top_prospects(spark, sf):
    f = ld.TOP_PROSPECTS
    return short(ld.page(ld.filter_leads(leads(spark, sf), f, contact(spark, sf)), f))


@query("preset_acquisition", f"""{BASE}, {SQL_ACQ} SELECT id, name, score, grade FROM (
  SELECT c.id, c.name, c.founded_year, s.score, {GRADE} AS grade FROM mart_company c JOIN acq s USING (id))
WHERE grade = 'A' ORDER BY founded_year ASC NULLS LAST, id LIMIT 25""")
def preset_acquisition(spark, sf):
    f = ld.ACQUISITION_TARGETS
    return short(ld.page(ld.filter_leads(leads(spark, sf, ACQUISITION), f), f))


@query("lead_selected_ids", f"""{LEADS_SQL} SELECT id, name, score, grade FROM leads
WHERE id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""")
def lead_selected_ids(spark, sf):
    ids = table(spark, sf, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("id"))
    return short(ld.selected(leads(spark, sf), ids))


WORDS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


@query("lead_search", f"""SELECT doc_id FROM documents
WHERE list_has_all({WORDS.format('text')}, ['the', 'of', 'and']) OR text ILIKE '%the of and%'""")
def lead_search(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.filter(ld.search("  The of-AND ", "text")).select("doc_id")


@query("lead_search_name", f"""{LEADS_SQL} SELECT id FROM leads
WHERE list_has_all({WORDS.format('name')}, ['customer', '000000042']) OR name ILIKE '%c_2-shop%' OR domain ILIKE '%c_2-shop%'""")
def lead_search_name(spark, sf):
    c = leads(spark, sf)
    a = ld.filter_leads(c, ld.LeadFilters(q="000000042 customer"))
    b = ld.filter_leads(c, ld.LeadFilters(q="C_2-shop"))
    return a.unionByName(b).select("id").distinct()


BEST_SQL = """best AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY company_id) AS contacts_count,
  row_number() OVER (PARTITION BY company_id ORDER BY
    coalesce(is_decision_maker AND email_status = 'valid_mx', false) DESC,
    coalesce(email_status = 'valid_mx' AND email_type = 'personal', false) DESC,
    is_decision_maker DESC, email_status = 'valid_mx' DESC, (email IS NOT NULL) DESC, phone_valid DESC, seq) AS rn
  FROM mart_contact) WHERE rn = 1)"""


@query("best_contact", f"""{mart.with_views(mart_contact=mart.CONTACT)}, {BEST_SQL}
SELECT company_id AS id, contacts_count, contact_id, full_name, title, email FROM best""")
def best_contact(spark, sf):
    best = ld.best_contacts(contact(spark, sf))
    return best.select("id", "contacts_count", "best_contact.contact_id", "best_contact.full_name",
                       "best_contact.title", "best_contact.email")


@query("contact_order", f"""{mart.with_views(mart_contact=mart.CONTACT)}
SELECT company_id, contact_id, CAST(row_number() OVER (PARTITION BY company_id ORDER BY NOT is_decision_maker,
  email_status <> 'valid_mx', coalesce(full_name, '~'), seq) AS INTEGER) AS pos FROM mart_contact""")
def contact_order(spark, sf):
    return ld.contacts_in_order(contact(spark, sf)).select("company_id", "contact_id", "pos")


def _flat(df):
    return df.select(
        "*", F.col("best_contact.full_name").alias("contact_name"),
        F.col("best_contact.email").alias("contact_email"),
    ).drop("best_contact")


@query("lead_rows", f"""{LEADS_SQL}, {BEST_SQL}, why AS (
  SELECT id, string_agg(reason, '; ' ORDER BY k) AS reasons FROM (
    SELECT id, reason, row_number() OVER (PARTITION BY id ORDER BY -points, pos) AS k FROM sales_fired WHERE points > 0)
  WHERE k <= 2 GROUP BY id)
SELECT l.id, l.name, l.domain, l.industry, l.state, l.country, l.employee_count, l.score, l.grade, l.stage,
  l.website_status, coalesce(b.contacts_count, 0) AS contacts_count, b.full_name AS contact_name,
  b.email AS contact_email, coalesce(w.reasons, '') AS reasons, CAST(NULL AS VARCHAR) AS website_url, CAST(NULL AS VARCHAR) AS city
FROM leads l LEFT JOIN best b ON b.company_id = l.id LEFT JOIN why w USING (id)""")
def lead_rows(spark, sf):
    out = _flat(ld.lead_rows(leads(spark, sf), contact(spark, sf)))
    return out.withColumn("reasons", F.array_join("top_reasons", "; ")).drop("top_reasons", "last_enriched_at", "created_at")


@query("lead_page_rows", f"""{LEADS_SQL}, {BEST_SQL}
SELECT l.id, l.name, l.score, l.grade, b.contacts_count, b.full_name AS contact_name, b.email AS contact_email
FROM (SELECT * FROM leads WHERE grade IN ('A', 'B') ORDER BY score DESC, id LIMIT 25 OFFSET 25) l
LEFT JOIN best b ON b.company_id = l.id""")
def lead_page_rows(spark, sf):
    f = ld.LeadFilters(grade="A,B")
    rows, _ = ld.page_rows(leads(spark, sf), contact(spark, sf), f, number=2)
    return _flat(rows).select("id", "name", "score", "grade", "contacts_count", "contact_name", "contact_email")


@query("lead_detail", f"""{LEADS_SQL}, {BEST_SQL}
SELECT l.id, l.name, l.score, l.grade, l.founded_year, l.copyright_year, l.import_id, l.breakdown,
  coalesce(b.contacts_count, 0) AS contacts_count, b.full_name AS contact_name, b.email AS contact_email
FROM leads l LEFT JOIN best b ON b.company_id = l.id""")
def lead_detail(spark, sf):
    from leadmill.plans.catalog.scoring import breakdown_text

    out = _flat(ld.lead_rows(leads(spark, sf), contact(spark, sf), detail=True))
    return out.select("id", "name", "score", "grade", "founded_year", "copyright_year", "import_id",
                      breakdown_text().alias("breakdown"), "contacts_count", "contact_name", "contact_email")


@query("lead_detail_columns", f"""{LEADS_SQL} SELECT l.id, 'About ' || l.name AS description, l.founded_year, l.copyright_year, l.id * 1000 AS revenue_estimate,
  'looms,' || coalesce(l.industry, '') AS tech_stack, 'https://social.example/' || l.id AS linkedin, CASE WHEN l.id % 2 = 0 THEN 'yes' ELSE 'no' END AS hiring, l.breakdown,
  CASE WHEN l.id % 3 = 0 THEN 'call back' END AS notes, CASE WHEN l.id % 2 = 0 THEN 'vendor_csv' ELSE 'csv' END AS source, l.import_id,
  CASE l.id % 4 WHEN 0 THEN 'Wick' END AS city FROM leads l""")
def lead_detail_columns(spark, sf):
    """All columns that the detail view adds, of leads that have them."""
    from leadmill.plans.catalog.scoring import breakdown_text

    key = F.col("id").cast("string")
    full = leads(spark, sf).withColumns({
        "description": F.concat(F.lit("About "), "name"), "revenue_estimate": F.col("id") * 1000, "tech_stack": F.array(F.lit("looms"), F.coalesce("industry", F.lit(""))),
        "socials": F.create_map(F.lit("linkedin"), F.concat(F.lit("https://social.example/"), key)),
        "signals": F.create_map(F.lit("hiring"), F.when(F.col("id") % 2 == 0, "yes").otherwise("no")),
        "notes": F.when(F.col("id") % 3 == 0, "call back"), "source": F.when(F.col("id") % 2 == 0, "vendor_csv").otherwise("csv"),
        "city": F.when(F.col("id") % 4 == 0, "Wick"),
    })
    out = ld.lead_rows(full, contact(spark, sf), detail=True)
    return out.select(
        "id", "description", "founded_year", "copyright_year", "revenue_estimate", F.array_join("tech_stack", ",").alias("tech_stack"),
        F.col("socials")["linkedin"].alias("linkedin"), F.col("signals")["hiring"].alias("hiring"), breakdown_text().alias("breakdown"), "notes", "source", "import_id", "city",
    )


@query("contacts_per_lead", f"""{mart.with_views(mart_company=mart.COMPANY, mart_contact=mart.CONTACT)}
SELECT c.id, count(t.contact_id) AS contacts_count FROM mart_company c
LEFT JOIN mart_contact t ON t.company_id = c.id GROUP BY c.id""")
def contacts_per_lead(spark, sf):
    n = contact(spark, sf).groupBy(F.col("company_id").alias("id")).agg(F.count("*").alias("contacts_count"))
    return company(spark, sf).select("id").join(n, "id", "left").na.fill(0, ["contacts_count"])


EXPORT_SQL = ", ".join(
    f'{expr} AS "{name}"'
    for name, expr in zip(
        lx.EXPORT_HEADERS,
        ["name", "coalesce(domain, '')", "coalesce('https://' || domain, '')", "CAST(score AS VARCHAR)", "grade",
         "coalesce(w.reasons, '')", "coalesce(b.full_name, '')", "coalesce(b.title, '')", "coalesce(b.email, '')",
         "CASE WHEN b.email <> '' THEN b.email_status ELSE '' END", "coalesce(b.phone_e164, '')", "''", "industry",
         "''", "state", "country", "coalesce(CAST(employee_count AS VARCHAR), '')",
         "coalesce(CAST(founded_year AS VARCHAR), '')", "stage", "''"],
        strict=True,
    )
)


@query("csv_export_rows", f"""{LEADS_SQL}, {BEST_SQL}, why AS (
  SELECT id, string_agg(reason, '; ' ORDER BY k) AS reasons FROM (
    SELECT id, reason, row_number() OVER (PARTITION BY id ORDER BY -points, pos) AS k FROM sales_fired WHERE points > 0)
  WHERE k <= 3 GROUP BY id)
SELECT {EXPORT_SQL} FROM leads l LEFT JOIN best b ON b.company_id = l.id LEFT JOIN why w USING (id)""")
def csv_export_rows(spark, sf):
    return export_rows(leads(spark, sf), contact(spark, sf), ld.LeadFilters())


# ---- dashboard and imports ----

JOB_SQL = mart.sql_text(mart.JOB)


def jobs(spark, sf):
    return mart.view(spark, sf, mart.JOB)


def with_enriched(df):
    return df.withColumn(
        "last_enriched_at",
        F.when(F.col("website_status").isNotNull(), F.lit("2024-01-01 00:00:00").cast("timestamp")),
    )


@query("dashboard_stats", f"""{LEADS_SQL}, job AS {JOB_SQL}, flags AS (
  SELECT l.id, bool_or(t.email_status = 'valid_mx') AS has_valid, bool_or(t.email IS NOT NULL) AS has_email
  FROM leads l LEFT JOIN mart_contact t ON t.company_id = l.id GROUP BY l.id)
SELECT (SELECT count(*) FROM leads) AS total_leads,
  CAST((SELECT coalesce(sum(duplicates_removed), 0) FROM job) AS BIGINT) AS duplicates_removed_total,
  (SELECT count(*) FROM leads WHERE website_status IS NOT NULL) AS enriched,
  (SELECT count(*) FROM flags WHERE has_email) AS leads_with_email,
  (SELECT round_even(count(*) FILTER (has_valid) / count(*), 3) FROM flags) AS valid_email_rate,
  (SELECT CAST(round(CAST(sum(score) AS DECIMAL(20,6)) / count(*), 1) AS DOUBLE) FROM leads) AS avg_score,
  {', '.join(f"(SELECT count(*) FROM leads WHERE grade = '{g}') AS grade_{g.lower()}" for g in lx.GRADES)},
  {', '.join(f"(SELECT count(*) FROM leads WHERE stage = '{s}') AS stage_{s}" for s in lx.STAGES)}""")
def dashboard_stats(spark, sf):
    return st.dashboard(with_enriched(leads(spark, sf)), contact(spark, sf), jobs(spark, sf))


@query("grade_distribution", f"""{LEADS_SQL} SELECT g.grade, count(l.id) AS n
FROM (VALUES ('A'), ('B'), ('C'), ('D')) g(grade) LEFT JOIN leads l ON l.grade = g.grade GROUP BY g.grade""")
def grade_distribution(spark, sf):
    return st.distribution(leads(spark, sf), "grade", lx.GRADES)


@query("stage_distribution", """SELECT CASE c_custkey % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'qualified'
  WHEN 2 THEN 'contacted' ELSE 'disqualified' END AS stage, count(*) AS n FROM customer GROUP BY 1""")
def stage_distribution(spark, sf):
    return st.distribution(company(spark, sf), "stage", lx.STAGES)


@query("website_counts_map", f"""{mart.with_views(mart_company=mart.COMPANY)}
SELECT string_agg(website_status || '=' || n, ',' ORDER BY website_status) AS counts FROM (
  SELECT website_status, count(*) AS n FROM mart_company WHERE website_status IS NOT NULL GROUP BY website_status)""")
def website_counts_map(spark, sf):
    m = st.distribution_map(company(spark, sf), "website_status", lx.WEBSITE_STATES)
    text = F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return m.select(F.array_join(F.array_sort(text), ",").alias("counts"))


@query("import_progress", f"""WITH job AS {JOB_SQL}, o AS {mart.sql_text(mart.OUTCOME)}, n AS (
  SELECT job_id, count(*) FILTER (outcome = 'processed' AND elapsed_ms <= 5000) AS processed,
    count(*) FILTER (outcome = 'failed' OR (outcome = 'processed' AND elapsed_ms > 5000)) AS failed
  FROM o GROUP BY job_id)
SELECT job_id, total_rows, duplicates_removed, processed, failed, total_rows - duplicates_removed AS target,
  processed + failed AS done, CASE WHEN processed + failed >= total_rows - duplicates_removed THEN 'completed' ELSE 'running' END AS status,
  CASE WHEN total_rows > duplicates_removed THEN CAST(least(100, floor((processed + failed) * 100 / (total_rows - duplicates_removed) + 0.5)) AS INTEGER) ELSE 100 END AS percent
FROM job JOIN n USING (job_id)""")
def import_progress(spark, sf):
    out = st.import_progress(jobs(spark, sf), mart.view(spark, sf, mart.OUTCOME), timeout_ms=5000)
    return out.select("job_id", "total_rows", "duplicates_removed", "processed", "failed", "target", "done",
                      "status", "percent")


@query("job_final_status", f"""WITH job AS {JOB_SQL}, crash AS (
  SELECT user_id AS job_id, arg_min(props, event_id) AS message FROM events
  WHERE event_type = 'error' AND value > 30 GROUP BY 1)
SELECT job_id, CASE WHEN message IS NULL THEN 'completed' ELSE 'failed' END AS final_status, message AS error
FROM job LEFT JOIN crash USING (job_id)""")
def job_final_status(spark, sf):
    crashes = table(spark, sf, "events").filter("event_type = 'error' AND value > 30").select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("ts"), F.col("props").alias("message"))
    return st.final_status(jobs(spark, sf), crashes).select("job_id", "final_status", "error")


@query("companies_per_job", f"{mart.with_views(mart_company=mart.COMPANY)} SELECT import_id, count(*) AS companies FROM mart_company GROUP BY 1")
def companies_per_job(spark, sf):
    return st.companies_per_job(company(spark, sf))


@query("recent_imports", f"WITH job AS {JOB_SQL} SELECT job_id, total_rows FROM job ORDER BY created_at DESC, job_id DESC LIMIT 20")
def recent_imports(spark, sf):
    return st.recent_imports(jobs(spark, sf)).select("job_id", "total_rows")


@query("import_summary", f"""{mart.with_views(mart_company=mart.COMPANY, job=mart.JOB)}
SELECT count(*) AS companies, {', '.join(f"count(*) FILTER (website_status = '{s}') AS {s}" for s in lx.WEBSITE_STATES)},
  count(founded_year) AS with_founding_year, min(founded_year) AS oldest, max(founded_year) AS newest,
  CAST((SELECT sum(total_rows) FROM job) AS BIGINT) AS total_rows,
  CAST((SELECT sum(duplicates_removed) FROM job) AS BIGINT) AS duplicates_removed FROM mart_company""")
def import_summary(spark, sf):
    return st.run_summary(company(spark, sf), jobs(spark, sf))


FAULTY_COMPANY = """SELECT id, CASE WHEN employee_count > 400 THEN 'archived' ELSE stage END AS stage, website_status,
  CASE WHEN country = 'NATION_3' THEN 'E' ELSE 'B' END AS grade, CASE WHEN employee_count > 450 THEN 101 ELSE 50 END AS score,
  CASE WHEN industry = 'BUILDING' THEN concat(country, '.com') ELSE domain END AS domain, import_id FROM {mart_company}"""
FAULTY_CONTACT = """SELECT contact_id, company_id + CASE WHEN title IS NULL THEN 1000000 ELSE 0 END AS company_id,
  CASE WHEN title = 'Owner' THEN 'boss@site.com' ELSE email END AS email, email_status, email_type FROM {mart_contact}"""


@query("quality_violations", f"""{mart.with_views(mart_company=mart.COMPANY, mart_contact=mart.CONTACT, job=mart.JOB)},
c AS ({FAULTY_COMPANY.format(mart_company='mart_company')}), t AS ({FAULTY_CONTACT.format(mart_contact='mart_contact')})
SELECT 'stage not allowed' AS rule, CAST(id AS VARCHAR) AS key, stage AS value FROM c WHERE stage = 'archived'
UNION ALL SELECT 'grade not allowed', CAST(id AS VARCHAR), grade FROM c WHERE grade = 'E'
UNION ALL SELECT 'score out of range', CAST(id AS VARCHAR), CAST(score AS VARCHAR) FROM c WHERE score > 100
UNION ALL SELECT 'domain not unique', domain, CAST(count(*) AS VARCHAR) FROM c WHERE domain IS NOT NULL GROUP BY domain HAVING count(*) > 1
UNION ALL SELECT 'contact e-mail not unique', company_id || '|' || email, CAST(count(*) AS VARCHAR) FROM t WHERE email IS NOT NULL GROUP BY company_id, email HAVING count(*) > 1
UNION ALL SELECT 'contact without company', CAST(contact_id AS VARCHAR), CAST(company_id AS VARCHAR) FROM t WHERE company_id NOT IN (SELECT id FROM c)
UNION ALL SELECT 'company of unknown import', CAST(id AS VARCHAR), CAST(import_id AS VARCHAR) FROM c WHERE import_id NOT IN (SELECT job_id FROM job WHERE duplicates_removed > 0)""")
def quality_violations(spark, sf):
    c = spark.sql(FAULTY_COMPANY, mart_company=company(spark, sf))
    t = spark.sql(FAULTY_CONTACT, mart_contact=contact(spark, sf))
    return st.quality_report(c, t, jobs(spark, sf).filter("duplicates_removed > 0"))

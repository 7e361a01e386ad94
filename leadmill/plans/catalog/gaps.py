"""Queries for operators that the other modules do not run: snapshots, export files, profiles, plug-ins, full logs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leadmill.operators import dedupe as dd
from leadmill.operators import extract as ex
from leadmill.operators import leads as ld
from leadmill.operators import scoring as sc
from leadmill.plans import mart
from leadmill.plans.catalog.crawl import site_pages
from leadmill.plans.catalog.leads import LEADS_SQL, leads
from leadmill.plans.catalog.scoring import BASE, SALES, SALES_POINTS, SQL_SALES, YEAR, company, contact, rules_sql
from leadmill.plans.registry import arriving, query, table
from leadmill.session import cut_folder
from leadmill.sources import pages as pg
from leadmill.sources.export import export_rows, write_export
from leadmill.streaming import incremental as inc

# ---- decisions without a domain and without any identity ----

THIN = """SELECT c_custkey AS seq, CASE c_custkey % 5 WHEN 0 THEN ' ,- ' WHEN 1 THEN NULL ELSE concat(c_mktsegment, ' ', c_name) END AS name,
  CASE c_custkey % 3 WHEN 0 THEN concat('https://c', c_custkey % 400, '-shop.com/x') WHEN 1 THEN 'n/a' END AS website,
  CASE WHEN c_custkey % 7 = 0 THEN concat('desk@m', c_custkey % 50, '-mail.com') WHEN c_custkey % 7 = 1 THEN concat('c', c_custkey, '@gmail.com') END AS email FROM {customer}"""
THIN_SQL = f"""WITH t AS (SELECT *, CASE WHEN website LIKE 'https%' THEN regexp_extract(website, '//([^/]+)', 1) WHEN email LIKE '%-mail.com' THEN split_part(email, '@', 2) END AS domain,
    coalesce(website LIKE 'https%' AND TRY_CAST(regexp_extract(website, 'c([0-9]+)', 1) AS INTEGER) BETWEEN 0 AND 99, false) AS known FROM {mart.sql_text(THIN)}),
d AS (SELECT seq, CASE WHEN domain IS NULL AND (name IS NULL OR name = ' ,- ') THEN 'no_identity' WHEN domain IS NULL THEN 'open' WHEN k THEN 'existing'
    WHEN seq = min(seq) FILTER (NOT k) OVER (PARTITION BY domain) THEN 'keep' ELSE 'exact' END AS decision
  FROM (SELECT *, bool_or(known) OVER (PARTITION BY domain) AS k FROM t))"""


def thin_log(spark, sf):
    raw = mart.view(spark, sf, THIN)
    known = table(spark, sf, "customer").filter("c_custkey < 100").select(F.concat(F.lit("c"), "c_custkey", F.lit("-shop.com")).alias("domain"))
    return dd.exact_decisions(dd.candidates(raw), known)


@query("dedup_no_identity", f"{THIN_SQL} SELECT seq, decision FROM d")
def dedup_no_identity(spark, sf):
    return thin_log(spark, sf).select("seq", "decision")


@query("removal_counts_exact", f"""{THIN_SQL} SELECT count(*) AS rows, count(*) FILTER (decision = 'keep') AS kept, count(*) FILTER (decision = 'open') AS open,
  count(*) FILTER (decision = 'no_identity') AS no_identity, count(*) FILTER (decision = 'existing') AS existing, count(*) FILTER (decision = 'exact') AS exact FROM d""")
def removal_counts_exact(spark, sf):
    """What the passes before the name pass decide; ``open`` rows are left to it."""
    log = thin_log(spark, sf)
    return log.agg(F.count("*").alias("rows"), *[F.count_if(F.col("decision") == d).alias(n) for d, n in (
        ("keep", "kept"), ("open", "open"), ("no_identity", "no_identity"), ("existing", "existing"), ("exact", "exact"))])


#: As THIN, with names of which those of four rows in a row are nearly equal.
NEAR = """SELECT c_custkey AS seq, CASE c_custkey % 5 WHEN 0 THEN ' ,- ' WHEN 1 THEN NULL ELSE concat('Mill ', substr(md5(CAST(c_custkey - c_custkey % 4 AS STRING)), 1, 28),
    CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE 'cc' END) END AS name,
  CASE c_custkey % 3 WHEN 0 THEN concat('https://c', c_custkey % 400, '-shop.com/x') WHEN 1 THEN 'n/a' END AS website,
  CASE WHEN c_custkey % 7 = 0 THEN concat('desk@m', c_custkey % 50, '-mail.com') WHEN c_custkey % 7 = 1 THEN concat('c', c_custkey, '@gmail.com') END AS email FROM {customer}"""
NEAR_SQL = f"""{THIN_SQL.replace(mart.sql_text(THIN), mart.sql_text(NEAR))},
e AS (SELECT d.seq, d.decision, t.domain, CASE WHEN t.seq % 5 > 1 THEN t.seq - t.seq % 4 END AS near FROM d JOIN t USING (seq)),
w AS (SELECT *, min(seq) FILTER (decision = 'keep') OVER (PARTITION BY near) AS firm, min(seq) FILTER (decision = 'open') OVER (PARTITION BY near) AS late,
  min(seq) FILTER (decision = 'keep') OVER (PARTITION BY domain) AS first FROM e),
f AS (SELECT seq, CASE WHEN decision <> 'open' THEN decision WHEN coalesce(firm, late) = seq THEN 'keep' ELSE 'fuzzy' END AS decision,
  CASE WHEN decision = 'open' THEN coalesce(firm, late) WHEN decision IN ('keep', 'exact') THEN first END AS keeper FROM w)"""


def near_log(spark, sf):
    known = table(spark, sf, "customer").filter("c_custkey < 100").select(F.concat(F.lit("c"), "c_custkey", F.lit("-shop.com")).alias("domain"))
    return dd.dedupe(mart.view(spark, sf, NEAR), known)


@query("dedup_log_full", f"{NEAR_SQL} SELECT seq, decision, keeper FROM f")
def dedup_log_full(spark, sf):
    """The whole log, name pass included: all five decisions with their keeper."""
    return near_log(spark, sf).select("seq", "decision", "keeper")


@query("removal_counts_full", f"""{NEAR_SQL} SELECT count(*) AS rows, count(*) FILTER (decision = 'keep') AS kept, count(*) FILTER (decision <> 'keep') AS removed,
  count(*) FILTER (decision = 'no_identity') AS no_identity, count(*) FILTER (decision = 'existing') AS existing, count(*) FILTER (decision = 'exact') AS exact,
  count(*) FILTER (decision = 'fuzzy') AS fuzzy FROM f""")
def removal_counts_full(spark, sf):
    """Removed rows of the whole dedup, name pass included."""
    return dd.removal_counts(near_log(spark, sf))


# ---- stored pages ----

FETCHED = """SELECT page_id, url, CASE page_id % 6 WHEN 0 THEN 404 WHEN 1 THEN 503 ELSE 200 END AS http_status,
  CASE page_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'TEXT/HTML; charset=utf-8' ELSE 'text/html' END AS content_type, html FROM {pages}"""
FETCH_ERROR = "CASE WHEN page_id % 6 = 0 THEN 'http_404' WHEN page_id % 6 = 1 THEN 'http_503' WHEN page_id % 4 = 0 THEN 'not_html' END"


@query("usable_pages", f"SELECT page_id FROM pages WHERE {FETCH_ERROR} IS NULL AND strlen(html) <= 2097152")
def usable_pages(spark, sf):
    return pg.usable_pages(mart.view(spark, sf, FETCHED)).select("page_id")


@query("fetch_errors", f"""SELECT regexp_extract(url, '(example[.][a-z]+)', 1) AS domain, url || ': ' || coalesce({FETCH_ERROR}, 'too_large') AS message
FROM pages WHERE {FETCH_ERROR} IS NOT NULL OR strlen(html) > 2097152""")
def fetch_errors(spark, sf):
    return pg.fetch_errors(mart.view(spark, sf, FETCHED))


@query("crawled_paths", r"""SELECT DISTINCT regexp_extract(url, '(example[.][a-z]+)', 1) AS domain,
  coalesce(nullif(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', ''), ''), '/') AS path FROM pages""")
def crawled_paths(spark, sf):
    return ex.crawled_paths(site_pages(spark, sf, None))


# ---- the export as written files ----


@query("csv_export_file", f"""{LEADS_SQL} SELECT name AS "Company Name", coalesce(domain, '') AS "Domain", CAST(score AS VARCHAR) AS "Score", grade AS "Grade" FROM leads""")
def csv_export_file(spark, sf):
    """Written, then read back as a spreadsheet would: the mark belongs to the first header."""
    path = f"{cut_folder(spark)}/export-{uuid.uuid4().hex}"
    write_export(export_rows(leads(spark, sf), contact(spark, sf), ld.LeadFilters()), path)
    back = spark.read.csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="\u0000")
    first = back.columns[0]
    return back.withColumnRenamed(first, first.lstrip("﻿")).select(
        "Company Name", F.coalesce("Domain", F.lit("")).alias("Domain"), "Score", "Grade"
    )


# ---- freshness, dashboards, plug-ins, profiles ----


@query("due_domains", """SELECT DISTINCT 'c' || c_custkey || '-shop.com' AS domain FROM customer WHERE c_custkey % 7 <> 0
  AND (c_custkey NOT IN (SELECT user_id FROM events GROUP BY user_id HAVING max(ts) > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY) OR c_custkey % 10 = 0)""")
def due_domains(spark, sf):
    name = lambda c: F.concat(F.lit("c"), c, F.lit("-shop.com")).alias("domain")
    stored = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("stored_at")).select(name("user_id"), "stored_at")
    batch = company(spark, sf).select("domain")
    forced = table(spark, sf, "customer").filter("c_custkey % 10 = 0").select(name("c_custkey"))
    return inc.due_domains(batch, stored, "2024-01-20 00:00:00", forced)


@query("throttled_dashboard", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def throttled_dashboard(spark, sf):
    events = table(spark, sf, "events")
    folder = f"{cut_folder(spark)}/dashboard-{uuid.uuid4().hex}"
    stream = arriving(spark, sf, "events", events.schema)
    run = inc.throttled(
        stream.groupBy("event_type").agg(F.count("*").alias("n")),
        lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/counts"), f"{folder}/state", 1,
    )
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    return spark.read.parquet(f"{folder}/counts")


@query("plugin_extractor", """SELECT page_id AS seq, CAST(length(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS VARCHAR) AS value FROM pages""")
def plugin_extractor(spark, sf):
    ex.register_extractor("title_length", lambda year: F.array(F.struct(
        F.lit("title_length").alias("kind"), F.length(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).cast("string").alias("value"),
        F.lit(None).cast("string").alias("note"), F.lit(0).cast("bigint").alias("first"), F.lit(0).alias("pos"))))
    try:
        return ex.page_signals(site_pages(spark, sf, None), 2026, ["title_length"]).select("seq", "value")
    finally:
        del ex.EXTRACTORS["title_length"]


DEFAULT_SQL = rules_sql("dflt", SALES_POINTS, ["hvac", "plumbing", "electrical", "roofing", "landscaping"], ["us"], (5, 200), 10)


@query("default_profile_scores", f"{BASE}, {DEFAULT_SQL} SELECT id, score FROM dflt")
def default_profile_scores(spark, sf):
    """The built-in profiles go through their table; the active one scores."""
    profile = sc.active_profile(sc.profiles_table(spark))
    return sc.score_leads(sc.lead_facts(company(spark, sf), contact(spark, sf)), profile, YEAR).select("id", "score")


@query("low_confidence_scores", f"{BASE}, {SQL_SALES} SELECT id, greatest(0, least(100, raw_total - CASE WHEN id % 3 = 0 THEN 5 ELSE 0 END)) AS score FROM sales")
def low_confidence_scores(spark, sf):
    facts = sc.lead_facts(company(spark, sf).withColumn("low_confidence_merge", F.col("id") % 3 == 0), contact(spark, sf))
    return sc.score_leads(facts, SALES, YEAR).select("id", "score")

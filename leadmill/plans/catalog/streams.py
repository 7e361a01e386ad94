"""Streaming queries replayed to the end, and whole pipelines."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leadmill.operators import dedupe as dd
from leadmill.operators import scoring as sc
from leadmill.plans import mart, pipeline
from leadmill.plans.catalog.crawl import site_pages
from leadmill.plans.catalog.imports import RAW
from leadmill.plans.registry import arriving, query, table
from leadmill.session import cut_folder
from leadmill.sources import delimited as dl
from leadmill.streaming import incremental as inc


@query("stream_progress", f"""SELECT job_id, count(*) FILTER (outcome = 'processed' AND elapsed_ms <= 25000) AS processed,
  count(*) FILTER (outcome = 'failed' OR (outcome = 'processed' AND elapsed_ms > 25000)) AS failed FROM {mart.sql_text(mart.OUTCOME)} GROUP BY job_id""")
def stream_progress(spark, sf):
    events = table(spark, sf, "events")
    stream = arriving(spark, sf, "events", events.schema)
    outcomes = spark.sql(mart.OUTCOME, events=stream)
    folder = f"{cut_folder(spark)}/progress-{uuid.uuid4().hex}"

    def keep(batch, _):
        batch.write.mode("overwrite").parquet(f"{folder}/counts")

    run = (
        inc.progress(outcomes).writeStream.outputMode("complete").foreachBatch(keep)
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/counts").select("job_id", "processed", "failed")


@query("stream_intake", f"{RAW} SELECT CASE WHEN seq = keeper THEN 'keep' ELSE 'exact' END AS decision, count(*) AS n FROM g GROUP BY 1")
def stream_intake(spark, sf):
    pages = table(spark, sf, "pages")
    stream = arriving(spark, sf, "pages", pages.schema)
    folder = f"{cut_folder(spark)}/intake-{uuid.uuid4().hex}"

    def make(batch):
        return dd.dedupe(batch.sparkSession.sql(mart.PAGE_LEAD, pages=batch)).select("seq", "decision")

    arrivals = stream.withColumn("file", F.col("_metadata.file_path"))
    inc.intake(arrivals, make, f"{folder}/state", folder).awaitTermination()
    return inc.imported(spark, folder, "seq bigint, decision string").groupBy("decision").agg(F.count("*").alias("n"))


LEAD_FILE = """SELECT c_mktsegment AS segment, c_name AS name, CASE WHEN c_custkey % 7 = 0 THEN 'n/a' ELSE concat('c', c_custkey, '-shop.com') END AS website,
  CASE WHEN c_custkey % 5 = 0 THEN concat('He said "', c_mktsegment, '",', chr(10), 'twice; or once') WHEN c_custkey % 5 = 1 THEN concat('Caf', chr(233), ' ', c_mktsegment) ELSE c_mktsegment END AS sector,
  concat(c_custkey % 90, '-99') AS staff FROM {customer}"""


def _lead_files(spark, sf, folder):
    """The customers as delimited files in two dialects and encodings, with breaks and delimiters inside quotes."""
    rows = mart.view(spark, sf, LEAD_FILE)
    for part, delimiter, encoding in (("segment < 'F'", ",", "UTF-8"), ("segment >= 'F'", ";", "ISO-8859-1")):
        rows.filter(part).select("name", "website", "sector", "staff").write.option("header", "true").option(
            "delimiter", delimiter).option("escape", '"').option("encoding", encoding).csv(f"{folder}/in/{encoding}")


FILE_ROWS = f"""SELECT name, CASE WHEN website <> 'n/a' THEN website END AS website, sector AS industry, CAST(regexp_extract(staff, '^[0-9]+') AS BIGINT) AS employees
FROM {mart.sql_text(LEAD_FILE)}"""


@query("file_rows", FILE_ROWS)
def file_rows(spark, sf):
    folder = f"{cut_folder(spark)}/files-{uuid.uuid4().hex}"
    _lead_files(spark, sf, folder)
    return dl.skip_nameless(dl.read_leads(spark, f"{folder}/in")[0])[0].select("name", "website", "industry", "employees")


@query("import_jobs", f"""SELECT 'csv' AS source, 'queued' AS status, count(*) AS rows FROM {mart.sql_text(LEAD_FILE)}""")
def import_jobs(spark, sf):
    folder = f"{cut_folder(spark)}/files-{uuid.uuid4().hex}"
    _lead_files(spark, sf, folder)
    rows, report = dl.read_leads(spark, f"{folder}/in")
    log = dd.exact_decisions(dd.candidates(dl.with_order(dl.skip_nameless(rows)[0])))
    jobs = dl.import_jobs(log, report)
    return jobs.groupBy("source", "status").agg(F.sum("total_rows").cast("bigint").alias("rows"))


@query("stream_file_intake", f"SELECT website AS domain, count(*) AS n FROM ({FILE_ROWS}) WHERE website IS NOT NULL GROUP BY 1")
def stream_file_intake(spark, sf):
    """The files arrive; then the state is lost and everything is offered again."""
    folder = f"{cut_folder(spark)}/files-{uuid.uuid4().hex}"
    _lead_files(spark, sf, folder)
    for state in ("first", "second"):
        arrivals = inc.file_arrivals(spark, f"{folder}/in", files_per_batch=3)
        inc.intake(arrivals, lambda b: inc.read_arrived(b).select("website"), f"{folder}/{state}", folder).awaitTermination()
    return inc.imported(spark, folder).groupBy(F.col("website").alias("domain")).agg(F.count("*").alias("n")).filter("domain IS NOT NULL")


@query("import_enrich_score")
def import_enrich_score(spark, sf):
    """Pages as raw leads: import, enrich from the stored pages, validate and score."""
    now, year = "2026-01-01 00:00:00", 2026
    raw = mart.view(spark, sf, mart.PAGE_LEAD)
    done = pipeline.run_import(
        raw, pipeline.empty(spark, pipeline.COMPANY_FIELDS), pipeline.empty(spark, pipeline.CONTACT_FIELDS), 1, now
    )
    pages = site_pages(spark, sf)
    sites = pages.groupBy("domain").agg(F.min_by("url", "seq").alias("final_url")).withColumns(
        {"website_status": F.lit("alive"), "has_ssl": F.col("final_url").startswith("https://"), "http_status": F.lit(200)}
    )
    mx = pages.select("domain").distinct().withColumn("has_mx", F.lit(True))
    profile = sc.Profile(states=("en", "de"), employee_min=5, employee_max=250)
    leads, _ = pipeline.process_companies(
        done.companies, done.contacts, pages.drop("url"), sites, mx, profile, now, year
    )
    return leads.select("domain", "score", "grade", F.size("breakdown").alias("reasons"))

"""Dashboard numbers, import progress, run summary and data-quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill import lexicons as lx


def email_flags(contacts: DataFrame) -> DataFrame:
    """Per company: any deliverable e-mail, any e-mail at all."""
    return contacts.groupBy(F.col("company_id").alias("id")).agg(
        F.bool_or(F.col("email_status") == "valid_mx").alias("has_valid"),
        F.bool_or(F.col("email").isNotNull()).alias("has_email"),
    )


def dashboard(companies: DataFrame, contacts: DataFrame, jobs: DataFrame) -> DataFrame:
    """All dashboard numbers in one row: one pass over companies, one over contacts."""
    scored = F.col("score")
    lead_part = companies.join(email_flags(contacts), "id", "left").agg(
        F.count("*").alias("total_leads"),
        F.count_if("has_valid").alias("valid"),
        F.count_if("has_email").alias("leads_with_email"),
        F.sum(scored.cast("bigint")).alias("points"),
        F.count(scored).alias("scored"),
        F.count("last_enriched_at").alias("enriched"),
        *[F.count_if(F.col("grade") == g).alias(f"grade_{g.lower()}") for g in lx.GRADES],
        *[F.count_if(F.col("stage") == s).alias(f"stage_{s}") for s in lx.STAGES],
        F.lit(None).cast("bigint").alias("dups"),
    )
    job_part = jobs.agg(F.sum(F.col("duplicates_removed").cast("bigint")).alias("dups"))
    # two one-row tables folded into one row
    both = lead_part.unionByName(job_part, allowMissingColumns=True)
    row = both.agg(*[F.max(c).alias(c) for c in lead_part.columns])
    average = F.round(
        F.col("points").cast("decimal(20,6)") / F.nullif(F.col("scored"), F.lit(0)).cast("decimal(20,0)"), 1
    )
    rate = F.bround(F.col("valid") / F.nullif(F.col("total_leads"), F.lit(0)), 3)
    return row.select(
        "total_leads",
        F.coalesce("dups", F.lit(0)).alias("duplicates_removed_total"),
        "enriched",
        "leads_with_email",
        F.coalesce(rate, F.lit(0.0)).alias("valid_email_rate"),
        average.cast("double").alias("avg_score"),
        *[f"grade_{g.lower()}" for g in lx.GRADES],
        *[f"stage_{s}" for s in lx.STAGES],
    )


def distribution(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """(value, n) for each expected value, zero where absent; NULLs and others not counted."""
    counts = df.agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])
    return counts.select(
        F.inline(F.array(*[F.struct(F.lit(v).alias(column), F.col(v).alias("n")) for v in values]))
    )


def distribution_map(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """One row with a map value -> count of the expected values that occur, else empty."""
    counts = df.agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])
    pairs = F.array(*[F.struct(F.lit(v).alias("key"), F.col(v).alias("value")) for v in values])
    return counts.select(F.map_from_entries(F.filter(pairs, lambda p: p["value"] > 0)).alias("counts"))


# ---- imports --------------------------------------------------------------


def job_counters(outcomes: DataFrame, timeout_ms: int = lx.LEAD_TIMEOUT_MS) -> DataFrame:
    """Processed and failed leads per job; a lead over the time limit has failed."""
    late = F.col("elapsed_ms") > timeout_ms
    failed = (F.col("outcome") == "failed") | ((F.col("outcome") == "processed") & late)
    return outcomes.groupBy("job_id").agg(
        F.count_if((F.col("outcome") == "processed") & ~late).alias("processed"),
        F.count_if(failed).alias("failed"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("finished_at"),
    )


def import_progress(jobs: DataFrame, outcomes: DataFrame, **kw) -> DataFrame:
    """Jobs with target, done, percent and status."""
    total = jobs.join(job_counters(outcomes, **kw), "job_id", "left")
    target = F.greatest(F.col("total_rows") - F.col("duplicates_removed"), F.lit(0))
    done = F.coalesce("processed", F.lit(0)) + F.coalesce("failed", F.lit(0))
    status = (
        F.when(F.col("started_at").isNull(), "queued")
        .when(done >= target, "completed")
        .otherwise("running")
    )
    out = total.withColumns({"target": target, "done": done, "status": status})
    percent = F.when(
        F.col("target") > 0,
        F.least(F.lit(100), F.floor(F.col("done") * 100 / F.col("target") + 0.5)),
    ).otherwise(F.when(F.col("status") == "running", 0).otherwise(100))
    return out.withColumn("percent", percent.cast("int"))


def final_status(jobs: DataFrame, crashes: DataFrame) -> DataFrame:
    """completed, or failed with the (first) crash text cut to 500 characters."""
    first = crashes.groupBy("job_id").agg(F.min_by("message", F.struct("ts", "message")).alias("message"))
    return jobs.join(first, "job_id", "left").select(
        *jobs.columns,
        F.when(F.col("message").isNull(), "completed").otherwise("failed").alias("final_status"),
        F.substring("message", 1, 500).alias("error"),
    )


def companies_per_job(companies: DataFrame) -> DataFrame:
    return companies.groupBy("import_id").agg(F.count("*").alias("companies"))


def recent_imports(jobs: DataFrame, limit: int = 20) -> DataFrame:
    return jobs.orderBy(F.col("created_at").desc(), F.col("job_id").desc()).limit(min(limit, 100))


def run_summary(companies: DataFrame, jobs: DataFrame) -> DataFrame:
    """Rows, duplicates, site states, founding-year coverage and span, in one row."""
    c = companies.agg(
        F.count("*").alias("companies"),
        *[F.count_if(F.col("website_status") == s).alias(s) for s in lx.WEBSITE_STATES],
        F.count("founded_year").alias("with_founding_year"),
        F.min("founded_year").alias("oldest"),
        F.max("founded_year").alias("newest"),
        F.lit(None).cast("bigint").alias("total_rows"),
        F.lit(None).cast("bigint").alias("duplicates_removed"),
    )
    j = jobs.agg(
        F.sum(F.col("total_rows").cast("bigint")).alias("total_rows"),
        F.sum(F.col("duplicates_removed").cast("bigint")).alias("duplicates_removed"),
    )
    both = c.unionByName(j, allowMissingColumns=True)
    return both.agg(*[F.max(x).alias(x) for x in c.columns])


# ---- quality --------------------------------------------------------------


def _violations(df: DataFrame, key: str, rule: str, bad: Column, shown: Column) -> DataFrame:
    return df.filter(bad).select(
        F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), shown.cast("string").alias("value")
    )


def enum_violations(df: DataFrame, key: str, column: str, allowed: list[str]) -> DataFrame:
    c = F.col(column)
    return _violations(df, key, f"{column} not allowed", ~c.isin(allowed), c)


def range_violations(df: DataFrame, key: str, column: str, low: int, high: int) -> DataFrame:
    c = F.col(column)
    return _violations(df, key, f"{column} out of range", ~c.between(low, high), c)


def duplicate_keys(df: DataFrame, columns: list[str], rule: str) -> DataFrame:
    """Key values held by more than one row; rows with a NULL in the key do not conflict."""
    full = F.lit(True)
    for c in columns:
        full = full & F.col(c).isNotNull()
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in columns])
    return (
        df.filter(full).groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")
        .select(F.lit(rule).alias("rule"), text.alias("key"), F.col("n").cast("string").alias("value"))
    )


def orphans(child: DataFrame, key: str, ref: str, parent: DataFrame, parent_key: str, rule: str) -> DataFrame:
    have = parent.select(F.col(parent_key).alias(ref))
    lost = child.filter(F.col(ref).isNotNull()).join(have, ref, "left_anti")
    return _violations(lost, key, rule, F.lit(True), F.col(ref))


def quality_report(companies: DataFrame, contacts: DataFrame, jobs: DataFrame) -> DataFrame:
    checks = [
        enum_violations(companies, "id", "stage", lx.STAGES),
        enum_violations(companies, "id", "website_status", lx.WEBSITE_STATES),
        enum_violations(companies, "id", "grade", lx.GRADES),
        range_violations(companies, "id", "score", 0, 100),
        enum_violations(contacts, "contact_id", "email_status", lx.EMAIL_STATES),
        enum_violations(contacts, "contact_id", "email_type", lx.EMAIL_TYPES),
        duplicate_keys(companies, ["domain"], "domain not unique"),
        duplicate_keys(contacts, ["company_id", "email"], "contact e-mail not unique"),
        orphans(contacts, "contact_id", "company_id", companies, "id", "contact without company"),
        orphans(companies, "id", "import_id", jobs, "job_id", "company of unknown import"),
    ]
    out = checks[0]
    for check in checks[1:]:
        out = out.unionByName(check)
    return out

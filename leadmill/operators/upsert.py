"""Changes to the lead tables as new snapshots: upsert, contact seeds, bulk actions, patches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: columns a re-import may fill but never overwrite
FILL_ON_CONFLICT = ["industry", "city", "state", "country", "employee_count", "revenue_estimate"]


def upsert_companies(companies: DataFrame, incoming: DataFrame, now: str) -> DataFrame:
    """Insert by domain; on conflict keep known values, fill the gaps, take the new import.

    One full outer join on domain. Rows without a domain never conflict and bypass it.
    ``incoming`` has one row per domain.
    """
    columns = companies.columns
    extra = [F.lit(None).cast(t).alias(c) for c, t in companies.dtypes if c not in incoming.columns]
    new = incoming.select(*[c for c in columns if c in incoming.columns], *extra).select(*columns)
    stamp = F.lit(now).cast("timestamp")
    o, n = companies.filter("domain IS NOT NULL").alias("o"), new.filter("domain IS NOT NULL").alias("n")
    joined = o.join(n, F.col("o.domain") == F.col("n.domain"), "full_outer")
    known, again = F.col("o.domain").isNotNull(), F.col("n.domain").isNotNull()

    def value(c):
        if c in FILL_ON_CONFLICT or c == "domain":
            return F.coalesce(f"o.{c}", f"n.{c}")
        if c == "import_id":
            return F.when(again, F.col("n.import_id")).otherwise(F.col("o.import_id"))
        if c == "updated_at":
            return F.when(again, stamp).otherwise(F.col("o.updated_at"))
        return F.when(known, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))

    merged = joined.select(*[value(c).alias(c) for c in columns])
    return merged.unionByName(companies.filter("domain IS NULL")).unionByName(new.filter("domain IS NULL"))


def insert_contacts(contacts: DataFrame, seeds: DataFrame) -> DataFrame:
    """Known contacts first; a second row for the same (company, e-mail) is ignored; rows
    without e-mail never conflict."""
    columns = contacts.columns
    old = contacts.withColumn("_round", F.lit(0))
    new = seeds.withColumn("email", F.lower("email")).select(*columns).withColumn("_round", F.lit(1))
    both = old.unionByName(new)
    keyed = both.filter("email IS NOT NULL").groupBy("company_id", "email").agg(
        F.min_by(F.struct(*columns), F.struct("_round", "seq")).alias("c")
    ).select("c.*")
    return keyed.unionByName(both.filter("email IS NULL").select(*columns))


def bulk_set_stage(companies: DataFrame, ids: DataFrame, stage: str) -> tuple[DataFrame, DataFrame]:
    """(companies, one-row affected count) for a list of ids, repeats ignored."""
    pick = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    out = companies.join(pick, "id", "left").withColumn(
        "stage", F.when(F.col("_hit"), stage).otherwise(F.col("stage"))
    )
    return out.drop("_hit"), out.agg(F.count("_hit").alias("affected"))


def bulk_delete(companies: DataFrame, contacts: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(companies, contacts, affected): contacts go with their company."""
    pick = ids.select("id").distinct()
    left = companies.join(pick, "id", "left_anti")
    orphaned = pick.withColumnRenamed("id", "company_id")
    affected = companies.join(pick, "id", "left_semi").agg(F.count("*").alias("affected"))
    return left, contacts.join(orphaned, "company_id", "left_anti"), affected


def patch_leads(companies: DataFrame, patches: DataFrame) -> DataFrame:
    """Only supplied fields change: ``patches`` has id and, per field, has_<field>."""
    fields = [c for c in patches.columns if c != "id" and not c.startswith("has_")]
    p = patches.select("id", *[F.col(f).alias(f"new_{f}") for f in fields], *[f"has_{f}" for f in fields])
    out = companies.join(p, "id", "left")
    for f in fields:
        out = out.withColumn(f, F.when(F.col(f"has_{f}"), F.col(f"new_{f}")).otherwise(F.col(f)))
    return out.select(*companies.columns)


def detach_deleted_jobs(companies: DataFrame, jobs: DataFrame) -> DataFrame:
    """Companies of an import that no longer exists live on without one."""
    live = jobs.select(F.col("job_id").alias("import_id")).distinct().withColumn("_live", F.lit(True))
    out = companies.join(live, "import_id", "left")
    return out.withColumn("import_id", F.when(F.col("_live"), F.col("import_id"))).drop("_live").select(
        *companies.columns
    )

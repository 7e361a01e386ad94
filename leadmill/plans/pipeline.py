"""Whole jobs: import of raw leads, and enrich-merge-validate-score over all companies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.functions.normalize import website_url
from leadmill.operators import contacts as ct
from leadmill.operators import dedupe as dd
from leadmill.operators import extract as ex
from leadmill.operators import scoring as sc
from leadmill.operators import upsert as up
from leadmill.operators.ranking import ranked
from leadmill.session import checkpoint

COMPANY_FIELDS = {
    "id": "bigint", "name": "string", "name_key": "string", "domain": "string", "website_url": "string",
    "industry": "string", "city": "string", "state": "string", "country": "string",
    "employee_count": "bigint", "revenue_estimate": "bigint", "description": "string",
    "founded_year": "int", "copyright_year": "int", "website_status": "string", "has_ssl": "boolean",
    "http_status": "int", "hiring": "boolean", "hiring_evidence": "array<string>", "modern_stack": "boolean",
    "family_owned": "boolean", "family_owned_hint": "string", "tech_stack": "array<string>",
    "socials": "map<string,string>", "n_pages": "bigint", "low_confidence_merge": "boolean", "stage": "string",
    "notes": "string", "source": "string", "import_id": "bigint", "created_at": "timestamp",
    "updated_at": "timestamp", "last_enriched_at": "timestamp",
}
CONTACT_FIELDS = {
    "company_id": "bigint", "seq": "bigint", "full_name": "string", "title": "string", "email": "string",
    "phone_e164": "string", "linkedin_url": "string", "is_decision_maker": "boolean", "source": "string",
}


def empty(spark, fields: dict) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"{k} {v}" for k, v in fields.items()))


@dataclass
class Imported:
    companies: DataFrame
    contacts: DataFrame
    decisions: DataFrame


def company_id(domain, import_id, seq):
    """Stable id: of the domain, or of the row for companies without one."""
    return F.when(domain.isNotNull(), F.xxhash64(F.lit("d"), domain)).otherwise(
        F.xxhash64(F.lit("r"), import_id, seq)
    )


def run_import(raw: DataFrame, companies: DataFrame, contacts: DataFrame, import_id: int, now: str,
               source: str = "csv", mark_fuzzy: bool = False) -> Imported:
    """Deduplicate raw rows, upsert the kept ones and seed their contacts."""
    decided = checkpoint(dd.dedupe(raw, companies))
    kept = dd.merged_leads(decided)
    key = company_id(F.col("domain"), F.lit(import_id).cast("bigint"), F.col("seq"))
    stamp = F.lit(now).cast("timestamp")
    kept = checkpoint(kept.withColumn("id", key))
    incoming = kept.select(
        "id", "name", "name_key", "domain", website_url("domain").alias("website_url"), "industry", "city", "state",
        "country", F.col("employees").cast("bigint").alias("employee_count"),
        F.col("revenue").cast("bigint").alias("revenue_estimate"), F.lit("new").alias("stage"),
        F.lit(source).alias("source"), F.lit(import_id).cast("bigint").alias("import_id"),
        stamp.alias("created_at"), stamp.alias("updated_at"),
        (F.col("fuzzy_merged") & F.lit(mark_fuzzy)).alias("low_confidence_merge"),
    )
    merged = up.upsert_companies(companies, incoming, now)
    # a company met again keeps its id: look it up by domain
    old = companies.filter("domain IS NOT NULL").select("domain", F.col("id").alias("old_id"))
    ids = kept.select("seq", "domain", "id").join(old, "domain", "left").select(
        F.col("seq").alias("company_seq"), F.coalesce("old_id", "id").alias("company_id")
    )
    # contacts of a company are numbered by (import, fuzzy last, row): no two imports share a number
    turn = ranked(dd.contact_seeds(decided).join(ids, "company_seq"), ["company_id"], [F.col("late"), F.col("seq"), F.xxhash64("email", "full_name", "phone")], "turn")
    seeds = turn.select(
        "company_id", (F.lit(import_id).cast("bigint") * F.lit(1 << 32) + F.col("turn")).alias("seq"), "full_name", "title",
        "email", F.col("phone").alias("phone_e164"), F.col("linkedin").alias("linkedin_url"),
        F.lit(False).alias("is_decision_maker"), F.lit("csv").alias("source"),
    )
    return Imported(checkpoint(merged), checkpoint(up.insert_contacts(contacts, seeds)), decided)


def process_companies(companies: DataFrame, contacts: DataFrame, pages: DataFrame, sites: DataFrame, mx: DataFrame,
                      profile: sc.Profile, now: str, as_of_year: int) -> tuple[DataFrame, DataFrame]:
    """Enrich, merge contacts, validate and score every company at once.

    ``pages`` has domain, path, seq, html; ``sites`` the fetch outcome per domain. Companies
    without a domain skip the enrichment.
    """
    places = companies.filter("domain IS NOT NULL").select("domain", "country", F.col("id").alias("company_id"))
    found = checkpoint(ex.enrichment_rows(pages, as_of_year, places=places))
    enriched = ex.apply_enrichment(companies, found, sites, now)
    mine = found.join(places, "domain").select("company_id", "people", "emails", "phones")
    mine = mine.withColumn("people", F.coalesce("people", F.array().cast(found.schema["people"].dataType)))
    merged = checkpoint(ct.merge_contacts(contacts, mine))
    checked = checkpoint(ct.validate_contacts(merged, mx, companies))
    # one order over known and found contacts for every "first contact" rule
    checked = checked.withColumn("seq", F.col("phase").cast("bigint") * F.lit(1 << 60) + F.col("seq"))
    scored = sc.score_leads(sc.lead_facts(enriched, checked), profile, as_of_year)
    facts = [c for c in scored.columns if c.startswith("ct_")]
    return scored.drop(*facts), checked

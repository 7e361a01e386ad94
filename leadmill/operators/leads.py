"""The lead query: filters, search, order, paging, best contact, list and detail rows."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill import lexicons as lx
from leadmill.operators.ranking import ranked
from leadmill.operators.scoring import top_reasons

CONTACT_FIELDS = [
    "contact_id", "full_name", "title", "email", "email_status", "email_type", "phone_e164",
    "phone_valid", "is_decision_maker",
]


@dataclass(frozen=True)
class LeadFilters:
    """All optional, AND-ed."""

    q: str | None = None
    grade: tuple = ()
    min_score: int | None = None
    industry: str | None = None
    country: str | None = None
    stage: str | None = None
    email_status: str | None = None
    import_id: int | None = None
    sort: str = "score"
    order: str = "desc"

    def __post_init__(self):
        given = [self.grade] if isinstance(self.grade, str) else self.grade
        grades = tuple(g.strip().upper() for item in given for g in str(item).split(",") if g.strip())
        if not set(grades) <= set(lx.GRADES):
            raise ValueError(f"unknown grade in {grades}")
        if self.sort not in lx.SORT_FIELDS or self.order not in ("asc", "desc"):
            raise ValueError("unknown sort or order")
        object.__setattr__(self, "grade", grades)


# fixed values: the quick presets
TOP_PROSPECTS = LeadFilters(grade=("A", "B"), email_status="valid_mx")
ACQUISITION_TARGETS = LeadFilters(grade=("A",), sort="founded_year", order="asc")


def contains_text(c: Column | str, text: str) -> Column:
    """Case-insensitive substring; % and _ in the text keep their LIKE meaning, a lone \\ is itself."""
    pattern = re.sub(r"\\(?![%_\\])", r"\\\\", re.sub(r"\\\\", r"\\\\", text))
    if len(pattern) - len(pattern.rstrip("\\")) & 1:
        pattern += "\\"
    return (F.col(c) if isinstance(c, str) else c).ilike(f"%{pattern}%")


def words_of(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def search(q: str, name: str = "name", description: str | None = None,
           domain: str | None = None) -> Column:
    """All words of q among the words of name + description, or q inside name or domain."""
    q = q.strip()
    text = F.col(name)
    if description:
        text = F.concat(text, F.lit(" "), F.coalesce(F.col(description), F.lit("")))
    words = words_of(F.lit(q))
    hit = (F.size(words) > 0) & F.forall(words, lambda w: F.array_contains(words_of(text), w))
    hit = hit | contains_text(name, q)
    return hit | F.coalesce(contains_text(domain, q), F.lit(False)) if domain else hit


def with_email_status(leads: DataFrame, contacts: DataFrame, status: str) -> DataFrame:
    """Leads having a contact with this e-mail status."""
    have = contacts.filter(F.col("email_status") == status).select(F.col("company_id").alias("id"))
    return leads.join(have, "id", "left_semi")


def filter_leads(leads: DataFrame, f: LeadFilters, contacts: DataFrame | None = None) -> DataFrame:
    out = leads
    if f.import_id is not None:
        out = out.filter(F.col("import_id") == f.import_id)
    if f.stage:
        out = out.filter(F.col("stage") == f.stage)
    if f.grade:
        out = out.filter(F.col("grade").isin(list(f.grade)))
    if f.min_score is not None:
        out = out.filter(F.col("score") >= f.min_score)
    if f.industry:
        out = out.filter(contains_text("industry", f.industry.strip()))
    if f.country:
        out = out.filter(F.lower("country") == f.country.strip().lower())
    if f.q:
        has = set(leads.columns)
        out = out.filter(search(f.q, "name", "description" if "description" in has else None,
                                "domain" if "domain" in has else None))
    if f.email_status:
        out = with_email_status(out, contacts, f.email_status)
    return out


def selected(leads: DataFrame, ids: DataFrame) -> DataFrame:
    """Only these ids (one column ``id``)."""
    return leads.join(ids.select("id").distinct(), "id", "left_semi")


def order_keys(f: LeadFilters) -> list[Column]:
    c = F.col(f.sort)
    return [c.asc_nulls_last() if f.order == "asc" else c.desc_nulls_last(), F.col("id").asc()]


def page(leads: DataFrame, f: LeadFilters, number: int = 1, size: int = 25) -> DataFrame:
    return leads.orderBy(*order_keys(f)).offset((number - 1) * size).limit(size)


def seek(leads: DataFrame, after_id, size: int = 500) -> DataFrame:
    """Keyset page: the next ids after the last one seen."""
    out = leads if after_id is None else leads.filter(F.col("id") > after_id)
    return out.orderBy("id").limit(size)


def _text(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


def best_contacts(contacts: DataFrame) -> DataFrame:
    """(id, contacts_count, best_contact): whom to reach out to first, ties by seq.

    An aggregation with map-side combine: no contact list, no sort of a whole company.
    """
    valid = F.coalesce(F.col("email_status") == "valid_mx", F.lit(False))
    leader = F.coalesce(F.col("is_decision_maker"), F.lit(False))
    personal = F.coalesce(F.col("email_type") == "personal", F.lit(False))
    rank = F.struct(
        (leader & valid).alias("a"),
        (valid & personal).alias("b"),
        leader.alias("c"),
        valid.alias("d"),
        _text("email").alias("e"),
        F.coalesce(F.col("phone_valid"), F.lit(False)).alias("f"),
        (-F.col("seq")).alias("g"),
    )
    fields = [c for c in [*CONTACT_FIELDS, "linkedin_url", "source"] if c in contacts.columns]
    return contacts.groupBy(F.col("company_id").alias("id")).agg(
        F.count("*").alias("contacts_count"),
        F.max_by(F.struct(*fields), rank).alias("best_contact"),
    )


def contacts_in_order(contacts: DataFrame, **kw) -> DataFrame:
    """Contacts with their position inside the company: decision makers first, then
    deliverable ones, then by name (missing names last)."""
    order = [
        (~F.coalesce(F.col("is_decision_maker"), F.lit(False))).asc(),
        (~F.coalesce(F.col("email_status") == "valid_mx", F.lit(False))).asc(),
        F.when(_text("full_name"), F.col("full_name")).otherwise("~").asc(),
        F.col("seq").asc(),
    ]
    return ranked(contacts, ["company_id"], order, **kw)


LIST_FIELDS = [
    "id", "name", "domain", "website_url", "industry", "city", "state", "country",
    "employee_count", "score", "grade", "stage", "website_status", "last_enriched_at",
    "created_at",
]
DETAIL_FIELDS = [
    "description", "founded_year", "copyright_year", "revenue_estimate", "tech_stack", "socials",
    "signals", "breakdown", "notes", "source", "import_id",
]

FIELD_TYPES = {
    "id": "bigint", "employee_count": "bigint", "score": "int", "last_enriched_at": "timestamp", "created_at": "timestamp",
    "founded_year": "int", "copyright_year": "int", "revenue_estimate": "bigint", "tech_stack": "array<string>",
    "socials": "map<string,string>", "signals": "map<string,string>", "import_id": "bigint",
    "breakdown": "array<struct<rule:string,points:int,reason:string>>",
}


def lead_rows(leads: DataFrame, contacts: DataFrame, detail: bool = False) -> DataFrame:
    """List (or detail) rows with best contact, contact count and the main reasons; a column that the
    leads do not have is NULL."""
    fields = [
        F.col(c) if c in leads.columns else F.lit(None).cast(FIELD_TYPES.get(c, "string")).alias(c)
        for c in LIST_FIELDS + (DETAIL_FIELDS if detail else [])
    ]
    reasons = top_reasons("breakdown", 3 if detail else 2)
    return (
        leads.select(*fields, reasons.alias("top_reasons"))
        .join(best_contacts(contacts), "id", "left")
        .withColumn("contacts_count", F.coalesce("contacts_count", F.lit(0).cast("bigint")))
    )


def page_rows(leads: DataFrame, contacts: DataFrame, f: LeadFilters, number: int = 1,
              size: int = 25) -> tuple[DataFrame, DataFrame]:
    """(rows of the page, one-row total). The page is cut first; only the contacts of its
    few ids are then aggregated."""
    hits = filter_leads(leads, f, contacts)
    cut = page(hits, f, number, size)
    ids = F.broadcast(cut.select(F.col("id").alias("company_id")))  # at most `size` rows
    mine = contacts.join(ids, "company_id", "left_semi")
    return lead_rows(cut, mine), hits.agg(F.count("*").alias("total"))



"""Delimited export of leads under the column names CRM importers know."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill import lexicons as lx
from leadmill.operators.leads import LeadFilters, best_contacts, filter_leads, order_keys, selected
from leadmill.operators.scoring import top_reasons


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def export_rows(leads: DataFrame, contacts: DataFrame, f: LeadFilters,
                ids: DataFrame | None = None) -> DataFrame:
    """The 20 export columns in list order; nothing is missing, empty text instead of NULL."""
    hits = filter_leads(leads, f, contacts)
    if ids is not None:
        hits = selected(hits, ids)
    best = best_contacts(contacts)
    rows = hits.join(best, "id", "left").orderBy(*order_keys(f))
    has, person = set(leads.columns), set(best.schema["best_contact"].dataType.names)

    def lead(c: str, default: Column | None = None) -> Column:
        return _text(F.col(c)) if c in has else (F.lit("") if default is None else default)

    def who(c: str) -> Column:
        return _text(F.col(f"best_contact.{c}")) if c in person else F.lit("")

    site = F.coalesce(F.concat(F.lit("https://"), F.col("domain")), F.lit(""))
    social = _text(F.col("socials")["linkedin"]) if "socials" in has else F.lit("")
    founded = F.when(F.col("founded_year") != 0, F.col("founded_year"))
    values = [
        F.col("name"), lead("domain"), lead("website_url", site), lead("score"), lead("grade"),
        F.array_join(top_reasons("breakdown", 3), "; "), who("full_name"), who("title"), who("email"),
        F.when(who("email") != "", who("email_status")).otherwise(""), who("phone_e164"),
        F.when(who("linkedin_url") != "", who("linkedin_url")).otherwise(social),
        lead("industry"), lead("city"), lead("state"), lead("country"), lead("employee_count"),
        _text(founded), lead("stage"), lead("notes"),
    ]
    return rows.select(*[v.alias(h) for h, v in zip(lx.EXPORT_HEADERS, values, strict=True)])


def write_export(rows: DataFrame, path: str) -> None:
    """One directory of part files in order, each with header and byte-order mark.

    Spark writes the mark as part of the first header name, so spreadsheets read UTF-8.
    """
    first = rows.columns[0]
    rows.withColumnRenamed(first, "﻿" + first).write.mode("errorifexists").csv(
        path, header=True, quote='"', escape='"', emptyValue="", encoding="UTF-8"
    )

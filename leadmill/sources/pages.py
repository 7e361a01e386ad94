"""Stored page snapshots: which rows are usable pages, and why the others are not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.functions.normalize import canonical_domain
from leadmill.operators.crawl import page_error, page_path


def checked_pages(fetched: DataFrame) -> DataFrame:
    """Adds domain, path and error to (url, http_status, content_type, html)."""
    size = F.octet_length("html")
    return fetched.withColumns(
        {
            "domain": canonical_domain("url"),
            "path": page_path("url"),
            "error": page_error(F.col("http_status"), F.col("content_type"), size),
        }
    )


def usable_pages(fetched: DataFrame) -> DataFrame:
    return checked_pages(fetched).filter("error IS NULL")


def fetch_errors(fetched: DataFrame) -> DataFrame:
    """(domain, message) 'url: error' per page that could not be used."""
    bad = checked_pages(fetched).filter("error IS NOT NULL")
    return bad.select("domain", F.concat("url", F.lit(": "), "error").alias("message"))

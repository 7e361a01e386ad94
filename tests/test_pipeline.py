from leadmill.operators import scoring as sc
from leadmill.operators import stats as st
from leadmill.plans import catalog
from leadmill.plans import pipeline as pl
from leadmill.plans.registry import QUERIES

HTML = """<html><head><title>Acme</title></head><body><p>Family-owned. Founded in 1998.</p><ul><li>John Smith, Owner</li></ul>
<a href="mailto:john@acme.com">mail</a><a href="tel:512-555-0100">call</a><footer>&copy; 2010</footer></body></html>"""


def test_import_enrich_validate_score(spark):
    now = "2026-01-01 00:00:00"
    raw = spark.createDataFrame(
        [(1, "Acme HVAC", "acme.com", "HVAC", "Austin", "US", 25, None), (2, "Acme", "https://www.acme.com/x", None, None, None, None, "info@acme.com"),
         (3, "Quiet Co", "quiet.com", "Plumbing", None, "US", 10, None), (4, "No Site LLC", None, "HVAC", None, "US", None, None)],
        "seq bigint, name string, website string, industry string, city string, country string, employees bigint, email string")
    done = pl.run_import(raw, pl.empty(spark, pl.COMPANY_FIELDS), pl.empty(spark, pl.CONTACT_FIELDS), 7, now)
    assert done.companies.count() == 3 and done.contacts.count() == 1
    pages = spark.createDataFrame([("acme.com", "/", 1, HTML)], "domain string, path string, seq bigint, html string")
    sites = spark.createDataFrame([("acme.com", "alive", True, 200, "https://acme.com/"), ("quiet.com", "dead", False, None, None)],
                                  "domain string, website_status string, has_ssl boolean, http_status int, final_url string")
    mx = spark.createDataFrame([("acme.com", True)], "domain string, has_mx boolean")
    leads, contacts = pl.process_companies(done.companies, done.contacts, pages, sites, mx, sc.DEFAULT_PROFILES[0], now, 2026)
    by_name = {r.name: r for r in leads.collect()}
    acme, quiet, other = by_name["Acme HVAC"], by_name["Quiet Co"], by_name["No Site LLC"]
    assert (acme.founded_year, acme.copyright_year, acme.family_owned_hint) == (1998, 2010, "Family-owned")
    assert acme.score == 20 + 10 + 10 + 15 + 10 + 5 + 5 - 5 and acme.grade == "B"
    assert quiet.score == 20 + 10 + 10 - 20 and quiet.website_status == "dead"
    assert other.score == 30 and other.last_enriched_at is None
    people = {r.email: r for r in contacts.filter(f"company_id = {acme.id}").collect()}
    assert people["john@acme.com"].full_name == "John Smith" and people["john@acme.com"].phone_e164 == "+15125550100"
    assert people["john@acme.com"].phone_valid and people["info@acme.com"].email_type == "role"
    again = pl.run_import(raw, done.companies, done.contacts, 8, now)
    assert again.companies.filter("domain IS NOT NULL").count() == 2
    assert {r.decision for r in again.decisions.filter("domain IS NOT NULL").collect()} == {"existing"}
    assert st.run_summary(leads, spark.createDataFrame([(4, 1)], "total_rows int, duplicates_removed int")).first().dead == 1


def test_streams_read_tables_of_several_files(spark, tmp_path):
    catalog.load()
    page = "<title>Quill {0}</title>"
    pages = spark.createDataFrame([(i, f"http://s{i % 4}.example.org/en/{i}", page.format(i)) for i in range(40)], "page_id bigint, url string, html string")
    pages.repartition(3).write.parquet(str(tmp_path / "many/pages.parquet"))
    got = {r.decision: r.n for r in QUERIES["stream_intake"](spark, str(tmp_path / "many")).collect()}
    assert got == {"exact": 39, "keep": 1}
    pages.limit(0).write.parquet(str(tmp_path / "none/pages.parquet"))
    assert QUERIES["stream_intake"](spark, str(tmp_path / "none")).collect() == []
    events = spark.createDataFrame([(i, "view" if i % 3 else "click") for i in range(30)], "event_id bigint, event_type string")
    events.repartition(3).write.parquet(str(tmp_path / "many/events.parquet"))
    got = {r.event_type: r.n for r in QUERIES["throttled_dashboard"](spark, str(tmp_path / "many")).collect()}
    assert got == {"view": 20, "click": 10}

import random
import re

from pyspark.sql import functions as F

from leadmill import lexicons as lx
from leadmill.operators import borders as bo
from leadmill.operators import contacts as ct
from leadmill.operators import crawl as cr
from leadmill.operators import dedupe as dd
from leadmill.operators import extract as ex
from leadmill.operators import leads as ld
from leadmill.operators import scoring as sc
from leadmill.operators import upsert as up
from leadmill.operators.ranking import ranked
from leadmill.sources import delimited as dl
from leadmill.sources.snapshots import read_snapshot, write_snapshot
from leadmill.streaming import incremental as inc

HTML = """<html><head><title>Quill &amp; Otter</title><meta name="description" content="Binding since 1931."></head><body>
<ul><li>Orla Quist, Owner</li><li>Petra Venn - Office Manager</li></ul><p>Founded in 1931. Locally owned. Now hiring!</p>
<a href="tel:+1-212-867-5309">call</a> <a href="mailto:orla@quillotter.nz?subject=Hi">mail</a> Office: desk [at] quillotter [dot] nz
<a href="https://www.facebook.com/sharer/x">s</a><a href="https://www.facebook.com/QuillOtter.">f</a>
<a href="/about-us">About</a><a href="https://www.quillotter.nz/contact/">Contact</a><a href="/services">S</a><a href="/team">Team</a>
<a href="/careers">C</a><a href="/blog/about-our-autumn-list">b</a><a href="/price-list-about.pdf">p</a><a href="../history#x">h</a>
<script src="/wp-content/a.js">var a = "Founded in 1900";</script><footer>&copy; 2008-2018 Quill</footer></body></html>"""


def pages(spark):
    return spark.createDataFrame([("quillotter.nz", "/", 1, "https://quillotter.nz/x/", HTML), ("quillotter.nz", "/careers", 2, "https://quillotter.nz/careers", HTML)],
                                 "domain string, path string, seq int, url string, html string")


def test_enrichment_row(spark):
    r = ex.enrichment_rows(pages(spark), 2026).first()
    assert r.emails == ["orla@quillotter.nz", "desk@quillotter.nz"] and r.phones == ["+12128675309"]
    assert [(p.full_name, p.title, p.is_decision_maker) for p in r.people] == [("Orla Quist", "Owner", True), ("Petra Venn", "Office Manager", False)]
    assert (r.founded_year, r.copyright_year, r.family_owned_hint) == (1931, 2018, "Locally owned")
    assert r.hiring_evidence == ["careers page", '"Now hiring"'] and r.tech_stack == ["WordPress"] and not r.modern_stack
    assert r.socials == {"facebook": "https://www.facebook.com/QuillOtter"} and r.title == "Quill & Otter" and r.description == "Binding since 1931."


def test_subpage_links(spark):
    links = cr.subpage_links(pages(spark).filter("seq = 1")).first().links
    assert links == [
        "https://quillotter.nz/about-us", "https://www.quillotter.nz/contact/", "https://quillotter.nz/team", "https://quillotter.nz/careers",
    ]


def test_merge_attaches_email_and_phone(spark):
    known = spark.createDataFrame([(2, 5, "Orla Quist", None, "orla@quillotter.nz", None, False)],
                                  "company_id bigint, seq bigint, full_name string, title string, email string, phone_e164 string, is_decision_maker boolean")
    found = ex.enrichment_rows(pages(spark), 2026).select(F.explode(F.expr("array(1L, 2L)")).alias("company_id"), "people", "emails", "phones")
    rows = ct.merge_contacts(known, found).collect()
    one = {r.full_name: r for r in rows if r.company_id == 1}
    assert one["Orla Quist"].email == "orla@quillotter.nz" and one["Orla Quist"].phone_e164 == "+12128675309" and one["Orla Quist"].is_decision_maker
    assert one[None].email == "desk@quillotter.nz" and len(one) == 3
    two = [r for r in rows if r.company_id == 2]
    assert [r.email for r in two].count("orla@quillotter.nz") == 1
    orla = next(r for r in two if r.full_name == "Orla Quist")
    assert orla.title == "Owner" and orla.is_decision_maker and orla.source == "csv"


def sequential_claims(contacts, emails):
    mail, out = dict(contacts), {}
    for e in emails:
        for seq, name in sorted(contacts):
            words = [w for w in name.lower().split() if w.isalpha()]
            first, last = words[0], words[-1]
            box = e.split("@")[0].replace(".", "").replace("_", "")
            if seq not in out.values() and box in {first, first + last, first[0] + last, last + first[0], last}:
                out[e] = seq
                break
    return out


def test_claims_equal_sequential_model(spark):
    rng = random.Random(3)
    people, mails, want = [], [], {}
    for company in range(40):
        mine = [(s, rng.choice(["Jane Roe", "Jan Roe", "J Roe", "Roe Jane", "Al Lee"])) for s in range(rng.randint(1, 30))]
        given = rng.sample(["jane@a.com", "jroe@a.com", "j.roe@a.com", "roe@a.com", "roej@a.com", "lee@a.com", "al@a.com", "x@a.com", "jane_roe@a.com"], 6)
        people += [(company, 0, s, n, None, None, None, False, "csv") for s, n in mine]
        mails += [(company, i, e) for i, e in enumerate(given)]
        want.update({(company, e): s for e, s in sequential_claims(mine, given).items()})
    c = spark.createDataFrame(people, "company_id bigint, phase int, seq bigint, full_name string, title string, email string, phone_e164 string, is_decision_maker boolean, source string")
    m = spark.createDataFrame(mails, "company_id bigint, pos int, email string")
    got = {(r.company_id, r.email): r.seq for r in ct.claim_emails(c, m).collect() if r.email and r.phase == 0}
    assert got == want


def test_ranks_do_not_depend_on_group_size(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaaaab"), rng.randint(0, 9), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, v int, i int")
    order = [F.col("v").desc(), F.col("i").asc()]
    got = {(r.k, r.i): r.pos for r in ranked(df, ["k"], order).collect()}
    groups = {k: sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2])) for k in "ab"}
    assert got == {(k, r[2]): at for k, g in groups.items() for at, r in enumerate(g, 1)} and max(got.values()) > 1500


def test_scores(spark):
    company = spark.createDataFrame([(1, "Plumbing and heating", "US", "VT", 31, 1931, 2018, "alive", True, True, ["careers page"], False, True, None)],
                                    "id bigint, industry string, country string, state string, employee_count int, founded_year int, copyright_year int, "
                                    "website_status string, has_ssl boolean, hiring boolean, hiring_evidence array<string>, modern_stack boolean, family_owned boolean, family_owned_hint string")
    contact = spark.createDataFrame([(1, 1, "Orla Quist", "Owner", "orla@quillotter.nz", "valid_mx", "personal", "+12128675309", True, True)],
                                    "company_id bigint, seq bigint, full_name string, title string, email string, email_status string, email_type string, phone_e164 string, phone_valid boolean, is_decision_maker boolean")
    facts = sc.lead_facts(company, contact)
    sales, search = sc.DEFAULT_PROFILES
    s = sc.score_leads(facts, sales, 2026).first()
    assert (s.score, s.grade) == (20 + 10 + 10 + 15 + 10 + 5 + 5 + 10 - 5, "A")
    assert [b.points for b in s.breakdown] == sorted((b.points for b in s.breakdown), reverse=True)
    assert "31 employees fits the 5-200 range" in [b.reason for b in s.breakdown]
    a = sc.score_leads(facts, search, 2026).first()
    assert a.score == min(100, 20 + 10 + 15 + 10 + 15 + 5 + 5 - 5 + 10 + 5 + 5)
    assert sc.score_leads(facts, sc.Profile(), 2026).first().score == 15 + 10 + 5 + 5 + 10 - 5
    sc.register_rule("has_state", lambda p, y: F.when(F.col("state").isNotNull(), "Has a state"))
    try:
        extra = sc.score_leads(facts, sc.Profile(weights={"has_state": 3, "hiring": 0}), 2026).first()
        assert ("has_state", 3) in [(b.rule, b.points) for b in extra.breakdown]
        assert "hiring" not in [b.rule for b in extra.breakdown]
    finally:
        del sc.RULES["has_state"]
    table = sc.profiles_table(spark)
    assert sc.active_profile(table) == sales and sc.active_profile(sc.activate(table, search.name)).name == search.name


def test_filters_reject_unknown_values():
    for bad in ({"grade": "E"}, {"sort": "id"}, {"order": "up"}):
        try:
            ld.LeadFilters(**bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_upsert_is_idempotent(spark):
    cols = "id bigint, name string, domain string, industry string, city string, state string, country string, employee_count bigint, revenue_estimate bigint, import_id bigint, updated_at timestamp"
    base = spark.createDataFrame([(1, "A", "a.com", None, "X", None, None, None, None, 1, None), (2, "B", None, None, None, None, None, None, None, 1, None)], cols)
    new = spark.createDataFrame([(9, "Z", "a.com", "HVAC", "Y", None, None, 5, None, 2, None), (10, "C", "c.com", None, None, None, None, None, None, 2, None)], cols)
    once = up.upsert_companies(base, new, "2024-01-01 00:00:00")
    twice = up.upsert_companies(once, new, "2024-01-01 00:00:00")
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str)
    a = once.filter("id = 1").first()
    assert (a.name, a.industry, a.city, a.employee_count, a.import_id) == ("A", "HVAC", "X", 5, 2)


def test_read_delimited_files(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.csv").write_bytes("﻿Company Name,Website,Industry,Owner Name,Email,Employees,Revenue\n\"Otter, LLC\",otter.nz,Books,Jo,j@a.com,11-50,$2.5M\n,,x,,,,\n".encode())
    (d / "b.csv").write_bytes("name;url;sector;headcount\nCafé;cafe.io;Food;8\n".encode("latin-1"))
    (d / "c.csv").write_bytes(b"foo,bar\n1,2\n")
    (d / "d.csv").write_bytes(b"\n\n")
    rows, report = dl.read_leads(spark, str(d))
    kept, skipped = dl.skip_nameless(rows)
    got = {(r.name, r.website, r.employees, r.revenue, r.row_number) for r in kept.collect()}
    assert got == {("Otter, LLC", "otter.nz", 11, 2500000, 2), ("Café", "cafe.io", 8, None, 2)}
    order = [(r.file, r.row_number) for r in dl.with_order(rows).orderBy("seq").collect()]
    assert order == sorted(order) and len(order) == 3
    log = dd.dedupe(dl.with_order(kept))
    jobs = {r.file.rsplit("/", 1)[1]: r for r in dl.import_jobs(log, report).collect()}
    assert (jobs["a.csv"].source, jobs["a.csv"].total_rows, jobs["a.csv"].duplicates_removed) == ("vendor_csv", 1, 0)
    rep = {r.file.rsplit("/", 1)[1]: r for r in report.collect()}
    assert rep["a.csv"].source == "vendor_csv" and rep["b.csv"].delimiter == ";" and rep["b.csv"].encoding == "ISO-8859-1"
    assert rep["c.csv"].error == "IMPORT_INVALID_CSV" and rep["d.csv"].error == "IMPORT_INVALID_CSV"
    nothing = spark.createDataFrame([("e.csv", 0, "UTF-8", ",", "")], "file string, bytes bigint, encoding string, delimiter string, header string")
    assert dl.file_report(nothing, dl.map_headers(dl.header_table(nothing))).first().error == "IMPORT_EMPTY_FILE"
    assert sum(r.skipped for r in skipped.collect()) == 1


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "snap")
    write_snapshot(spark.range(3), root, "t")
    write_snapshot(spark.range(5), root, "t")
    assert read_snapshot(spark, root, "t").count() == 5


def test_robots_groups(spark):
    body = "User-agent: other\nDisallow: /\n\nUser-agent: MillBot\nUser-agent: x\nAllow: /a/b\nDisallow: /a\n\nUser-agent: *\nDisallow: /"
    robots = spark.createDataFrame([("a.com", 200, body), ("b.com", 404, "User-agent: *\nDisallow: /"), ("c.com", 401, None)], "host string, http_status int, body string")
    urls = [("https://a.com/a/b/c", True), ("https://a.com/a/x", False), ("https://a.com/z", True), ("https://b.com/", True), ("https://c.com/", False), ("https://d.com", True)]
    df = spark.createDataFrame(urls, "url string, want boolean")
    assert all(r.allowed == r.want for r in cr.robots_allowed(df, robots, "millbot/2.0").collect())


def test_intake_handles_each_file_once(spark, tmp_path):
    src, seen = tmp_path / "src", []
    src.mkdir()

    def make(batch):
        names = sorted(r.file.rsplit("/", 1)[1] for r in batch.select("file").distinct().collect())
        seen.extend(names)
        if "bad.csv" in names and seen.count("bad.csv") == 1:
            raise ValueError("import failed")
        return inc.read_arrived(batch).select("name", "website")

    def run(state):
        inc.intake(inc.file_arrivals(spark, str(src), 1), make, str(tmp_path / state), str(tmp_path / "done")).awaitTermination()

    (src / "a.csv").write_text("name\nLantern\n")
    run("s1")
    (src / "b.csv").write_text("company;url\nOtter;otter.nz\n;\n")
    run("s2")  # the state is lost: b is new, a is done
    assert seen == ["a.csv", "b.csv"]
    (src / "bad.csv").write_text("name\nWren\n")
    try:
        run("s3")
    except Exception as exc:
        assert "import failed" in str(exc)
    run("s4")  # the failed import left no mark
    assert seen[2:] == ["bad.csv", "bad.csv"]
    got = sorted((r.name, r.website) for r in inc.imported(spark, str(tmp_path / "done")).collect())
    assert got == [("Lantern", None), ("Otter", "otter.nz"), ("Wren", None)]


def test_reader_takes_cut_characters_and_long_fields(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes(("name,city\n" + "Ä" * 600_000 + ",x\nOtter,y\n").encode())
    (tmp_path / "v.csv").write_bytes(("x" * 1_048_575 + "é,name\n1,Wren\n").encode())
    (tmp_path / "w.csv").write_bytes(b"name\n" + b"a\n" * 3 + b"\"\"\n" * 5)
    rows, report = dl.read_leads(spark, str(tmp_path), max_rows=3)
    kept = dl.skip_nameless(rows)[0]
    assert sorted(len(r.name) for r in kept.collect()) == [1, 1, 1, 4, 5, 600_000]
    assert report.filter("error IS NOT NULL").count() == 0


def test_search_text_with_backslashes(spark):
    df = spark.createDataFrame([("a\\q",), ("a_q",), ("aq",)], "name string")
    hits = lambda t: sorted(r[0] for r in df.filter(ld.contains_text("name", t)).collect())
    assert hits("\\q") == ["a\\q"] and hits("a_q") == ["a\\q", "a_q"] and hits("a\\_q") == ["a_q"] and hits("\\") == ["a\\q"]


def test_second_import_keeps_contacts_apart(spark):
    from leadmill.plans import pipeline

    cols = "seq bigint, name string, website string, owner string, email string"
    first = spark.createDataFrame([(1, "Otter", "otter.nz", "Orla Quist", "orla@otter.nz")], cols)
    one = pipeline.run_import(first, pipeline.empty(spark, pipeline.COMPANY_FIELDS), pipeline.empty(spark, pipeline.CONTACT_FIELDS), 1, "2026-01-01 00:00:00")
    again = spark.createDataFrame([(1, "Otter", None, "Petra Venn", "petra@otter.nz"), (2, "Otter", None, "Tomas Ekdal", "t@otter.nz")], cols)
    two = pipeline.run_import(again, one.companies, one.contacts, 2, "2026-01-02 00:00:00")
    rows = two.contacts.collect()
    assert two.companies.count() == 1 and len({(r.company_id, r.seq) for r in rows}) == len(rows) == 3
    found = spark.createDataFrame([(rows[0].company_id, [("Orla Quist", "Owner", True)], ["quist@otter.nz"], ["+12128675309"])],
                                  "company_id bigint, people array<struct<full_name:string,title:string,is_decision_maker:boolean>>, emails array<string>, phones array<string>")
    merged = {r.full_name: r for r in ct.merge_contacts(two.contacts, found).collect()}
    assert merged["Orla Quist"].title == "Owner" and merged["Petra Venn"].email == "petra@otter.nz" and merged["Petra Venn"].title is None
    assert [n for n, r in merged.items() if r.phone_e164] == ["Orla Quist"] and merged[None].email == "quist@otter.nz"


def test_page_bodies_are_not_shuffled(spark):
    places = spark.createDataFrame([("quillotter.nz", "NZ")], "domain string, country string")
    df = ex.enrichment_rows(pages(spark), 2026, places=places)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert all("html" not in line for line in plan.split("\n") if "Exchange" in line)
    assert df.first().phones == ["+12128675309"]


def years_of(spark, sites):
    rows = [(d, f"/{i}" if i else "/", i, f"https://{d}/{i}", f"<body><p>{t}</p></body>") for d, texts in sites.items() for i, t in enumerate(texts)]
    found = ex.enrichment_rows(spark.createDataFrame(rows, "domain string, path string, seq int, url string, html string"), 2026, ["founded"])
    return {r.domain: (r.founded_year, r.copyright_year) for r in found.collect()}


def test_years_over_page_borders(spark):
    long = "loom " * 400
    got = years_of(spark, {
        "two.nz": [long + "founded in", "1931 " + long],
        "three.nz": [long + "Founded", "in", "", "1944 " + long],
        "serving.nz": [long + "serving Otago, Southland", "and more since 1958 " + long],
        "mark.nz": [long + "copyright", "2001 - 2019 " + long],
        "cut.nz": [long + "founded in", "19311 " + long],
        "inside.nz": [long + "founded in " + long, "1931 " + long],
        "none.nz": [long, "1931 " + long],
        "white.nz": [long + "founded in", "<pre>in" + " " * 3000 + "1961</pre>" + long],
        "last.nz": [long + "founded in"],
    })
    assert got == {
        "two.nz": (1931, None), "three.nz": (1944, None), "serving.nz": (1958, None), "mark.nz": (None, 2019), "cut.nz": (None, None),
        "inside.nz": (None, None), "none.nz": (None, None), "white.nz": (None, None), "last.nz": (None, None),
    }


def test_years_over_borders_equal_one_joined_text(spark, monkeypatch):
    monkeypatch.setattr(bo, "SPAN", 200)
    draw = random.Random(11)
    words = ["founded", "in", "since", "serving", "1950", "1999", "2014", "©", "copyright", "x", "", "", "est.", "2001 -", "loom " * 300]
    sites = {f"s{i}.nz": [" ".join(draw.choice(words) for _ in range(draw.randint(0, 2))).strip() for _ in range(n)] for i, n in enumerate([2, 3, 9, 40, 700])}
    got = years_of(spark, sites)
    for site, texts in sites.items():
        text = "\n".join(t.strip() for t in texts)
        old = [int(y) for y in re.findall(lx.FOUNDED, text)]
        seen = [int(y) for y in re.findall(lx.COPYRIGHT, text) if 1990 <= int(y) <= 2027]
        assert got[site] == (min(old, default=None), max(seen, default=None)), site


def test_documents_outlive_their_fields(spark):
    rows = ex.enrichment_rows(pages(spark), 2026, ["emails", "founded"])
    docs = ex.enrichment_documents(rows)
    old = docs.select("domain", F.expr("parse_json('{\"founded_year\": \"soon\", \"emails\": [\"a@b.nz\"], \"fax\": 1}')").alias("doc"))
    read = ex.document_rows(docs.unionByName(old), {"founded_year": "int", "emails": "array<string>", "fax": "int"})
    assert [tuple(r)[1:] for r in read.collect()] == [(1931, ["orla@quillotter.nz", "desk@quillotter.nz"], None), (None, ["a@b.nz"], 1)]

"""Column functions on made-up companies, people and addresses."""

import pytest
from pyspark.sql import functions as F

from leadmill.functions import normalize as nz
from leadmill.functions import phones as ph
from leadmill.functions import text as tx
from leadmill.operators import crawl as cr
from leadmill.operators import extract as ex


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def check(spark, fn, cases):
    assert apply(spark, fn, [c[0] for c in cases]) == [c[1] for c in cases]


def test_hosts_of_urls_and_addresses(spark):
    check(spark, nz.canonical_domain, [
        ("ftp://files.tallowridge.org:21/x?y#z", "tallowridge.org"), ("Tallow-Ridge.IO.", "tallow-ridge.io"),
        ("mailto:desk@north.tallowridge.org", "tallowridge.org"), ("https://tallowridge.org?menu", "tallowridge.org"),
        ("user:pw@tallowridge.org/in", "tallowridge.org"), ("\ttallowridge.org\n", "tallowridge.org"),
        ("two words.org", None), ("192.168.7.20", None), ("intranet", None), ("dots..org", None), (" ", None), (None, None)])


def test_public_suffixes(spark):
    check(spark, nz.canonical_domain, [
        ("quarry.ltd", "quarry.ltd"), ("a.b.quarry.farm", "quarry.farm"), ("quarry.com.fr", "quarry.com.fr"), ("com.ec", None),
        ("x.quarry.com.ec", "quarry.com.ec"), ("quarry.any.ck", "quarry.any.ck"), ("any.ck", None), ("www.ck", "www.ck"), ("a.www.ck", "www.ck"),
        ("hill.kent.sch.uk", "hill.kent.sch.uk"), ("kent.sch.uk", None), ("co.de", "co.de"), ("city.kawasaki.jp", "city.kawasaki.jp"),
        ("ward.town.kawasaki.jp", "ward.town.kawasaki.jp"), ("page.html", None), ("xn--bcher-kva.xn--p1ai", "xn--bcher-kva.xn--p1ai")])
    own = lambda c: nz.canonical_domain(c, ("*.mill", "!dry.mill", "deep.down.under"))
    check(spark, own, [("a.b.c.mill", "b.c.mill"), ("a.dry.mill", "dry.mill"), ("x.y.deep.down.under", "y.deep.down.under")])


def test_company_names(spark):
    check(spark, nz.company_name_key, [
        ("Quill & Otter Ltd.", "quill and otter"), ("THE Lantern Works Limited", "lantern works"), ("Brücke Bau GmbH", "brucke bau"),
        ("Dunmore Corp. Inc.", "dunmore"), ("\tWren\u2019s   Nest LLP", "wrens nest"), ("L.L.C.", ""), ("北京", ""), (None, "")])
    check(spark, nz.display_name, [("- Wren's  Nest ,", "Wren's Nest"), (" ,. ", ""), (None, "")])


def test_numbers_and_blanks(spark):
    check(spark, nz.parse_number, [
        ("about 3,450 people", 3450), ("EUR 7.25m", 7250000), ("200-499", 200), ("1.5k", 1500), ("3 B", 3_000_000_000), ("many", None), (None, None)])
    check(spark, nz.blank_to_null, [("\tNone ", None), ("NULL", None), (" - ", None), (" nano ", "nano"), (None, None)])


def test_person_mailboxes(spark):
    rows = [("ingrid@q.org", "Ingrid Solvay", True), ("isolvay@q.org", "Ingrid Solvay", True), ("i_solvay@q.org", "Ingrid Solvay", True),
            ("solvay.i@q.org", "Ingrid Solvay", True), ("is@q.org", "Ingrid Solvay", False), ("ingrid@q.org", "Ingrid", False),
            ("moira@q.org", "Ingrid Solvay", False)]
    df = spark.createDataFrame(rows, "e string, n string, want boolean")
    assert all(r.got == r.want for r in df.select("want", nz.email_matches_person("e", "n").alias("got")).collect())


def test_email_verdict(spark):
    mx = {"quarry.ltd": True, "mute.org": False}
    cases = [("Moira@Quarry.LTD", "valid_mx", "personal"), ("billing+q3@quarry.ltd", "valid_mx", "role"), ("moira@mute.org", "no_mx", "personal"),
             ("moira@unasked.org", "unknown", "personal"), ("hr@yopmail.com", "disposable", "role"), ("moira@quarry@ltd", "invalid_syntax", None),
             ("moira.quarry.ltd", "invalid_syntax", None), (".moira@quarry.ltd", "invalid_syntax", None), ("moira@host.test", "invalid_syntax", None)]
    df = spark.createDataFrame([(e, mx.get(e.split("@")[-1].lower())) for e, _, _ in cases], "e string, mx boolean")
    got = df.select(nz.email_verdict("e", "mx"), nz.mailbox_type("e")).collect()
    assert [tuple(r) for r in got] == [(s, k) for _, s, k in cases]


def test_phones(spark):
    cases = [("212/867-5309 x12", None, "+12128675309", "fixed_line_or_mobile"), ("+49 (0)30 901820", "US", "+4930901820", "fixed_line"),
             ("0151 2345 6789", "Germany", "+4915123456789", "mobile"), ("+33 1 70 18 99 00", None, "+33170189900", "fixed_line"),
             ("06 39 98 12 34", "FR", "+33639981234", "mobile"), ("+353 1 496 0321", None, "+35314960321", "fixed_line"),
             ("09 72 10 10 10", "FR", "+33972101010", "voip"), ("+39 06 6982", None, "+39066982", "fixed_line"), ("+65 6123 4567", None, "+6561234567", "fixed_line"),
             ("(11) 96123-4567", "BR", "+5511961234567", "mobile"), ("888 555 0142", "CA", "+18885550142", "toll_free"), ("867-5309", "US", None, None),
             ("ring twice", "FR", None, None), ("+999 123456", None, None, None), (None, None, None, None)]
    df = spark.createDataFrame([c[:2] for c in cases], "p string, c string")
    got = df.select(ph.to_e164("p", ph.region_for("c")).alias("e")).withColumn("k", ph.phone_kind("e")).collect()
    assert [(r.e, r.k) for r in got] == [c[2:] for c in cases]
    check(spark, ph.region_for, [("", "US"), ("in", "IN"), ("ENGLAND", "GB"), ("Pakistan", "PK"), ("Atlantis", "US")])


def test_character_references(spark):
    check(spark, tx.decode_entities, [
        ("&#169; 2019", "© 2019"), ("We&#039;re &#x68;iring", "We're hiring"), ("Caf&eacute; &amp;eacute;", "Café &eacute;"), ("a&nbsp;b&#160;c", "a b c"),
        ("&#128512; &notathing; &#xD800; & &#0;", "😀 &notathing; &#xD800; & &#0;"), ("plain", "plain"), ("&lt;", "<"), (None, None)])


def test_references_of_html5(spark):
    cases = [
        ("info&commat;acme&period;com", "info@acme.com"), ("&lpar;512&rpar; 555-0100", "(512) 555-0100"), ("&plus;44 20", "+44 20"),
        ("&copy 2009", "\u00a9 2009"), ("&copy2009 &AMP &#169 2009 &#xA9.", "\u00a92009 & \u00a9 2009 \u00a9."), ("&#146;s &#x80; &#129;", "\u2019s \u20ac \x81"),
        ("a&NonBreakingSpace;b&nbsp c", "a b  c"), ("&Afr;&NotEqualTilde;", "\U0001d504\u2242\u0338"), ("&commat &#99999999999; &#;", "&commat &#99999999999; &#;"),
        ("&#00000000064;", "@")]
    check(spark, tx.decode_entities, cases)
    check(spark, lambda c: tx.decode_entities(c, attribute=True), [("?a=1&copy=2&reg &amp;&copy2", "?a=1&copy=2\u00ae &&copy2")])
    page = "<body><p>info&commat;acme&period;com</p><p>&copy 2009 Acme</p></body>"
    check(spark, tx.html_text, [(page, "info@acme.com \u00a9 2009 Acme")])


def test_deobfuscate_and_title_case(spark):
    check(spark, tx.deobfuscate, [
        ("moira {at} quarry {dot} ltd", "moira@quarry.ltd"), ("moira( AT )quarry[dot]co[dot]nz", "moira@quarry.co.nz"),
        ("look at us", "look at us"), ("moira at quarry (dot) ltd", "moira@quarry.ltd")])
    check(spark, tx.title_case, [("vice-president", "Vice-President"), ("d'arcy AND sons", "D'Arcy And Sons")])


@pytest.mark.parametrize("text, year", [
    ("Founded in 1911 by two sisters", 1911), ("in business since 1968, established 1970", 1968), ("EST 1999", 1999),
    ("since the 2004 season", None), ("Established 2150", None)])
def test_founded(spark, text, year):
    assert apply(spark, lambda c: F.array_min(ex.founded_years(c, 2026)), [text]) == [year]


def test_copyright(spark):
    check(spark, lambda c: F.array_max(ex.copyright_years(c, 2026)), [
        ("(c) 2001-2011 Quarry", 2011), ("COPYRIGHT 2003. © 2017", 2017), ("all rights reserved 2020", None)])


def test_people(spark):
    def names(c):
        return F.array_join(F.transform(ex.people_in(F.array(c)), lambda p: F.concat_ws("/", p["name"], p["title"])), ";")

    check(spark, names, [
        ("Orla Quist, President", "Orla Quist/President"), ("CEO Tomas Ekdal", "Tomas Ekdal/CEO"), ("Meet Petra Venn - General Manager", "Petra Venn/General Manager"),
        ("Our Team, Director", ""), ("Latest News - Partner", ""), ("Moira B. D'Arcy - Partner", "Moira B. D'Arcy/Partner")])


def test_socials_and_junk_mail(spark):
    check(spark, lambda c: ex.social_page(c, "instagram"), [
        ("https://instagram.com/p/C1x", None), ("https://www.instagram.com/quarry.ltd/", "https://www.instagram.com/quarry.ltd")])
    check(spark, lambda c: ex.social_page(c, "youtube"), [("https://youtube.com/watch?v=1", None), ("https://www.youtube.com/@quarry", "https://www.youtube.com/@quarry")])
    junk = ["banner@3x.webp", "k@o77.ingest.sentry.io", "donotreply@quarry.ltd", "first.last@quarry.ltd", "moira@rival.org", "yourname@yahoo.com"]
    check(spark, lambda c: ex.real_email(c, F.lit("quarry.ltd")), [(j, False) for j in junk] + [("moira@post.quarry.ltd", True), ("moira@icloud.com", True)])


def test_links_with_many_steps_up(spark):
    rows = [("https://q.org/1/2/3/4/5/x", "../../../../../about", "https://q.org/about"), ("https://q.org/a/b", "./c/./d", "https://q.org/a/c/d"),
            ("https://q.org/a/", "../../../team?x=../y", "https://q.org/team?x=../y"), ("https://q.org/a/b/c", "..", "https://q.org/a/"),
            ("https://q.org", "about.html#top", "https://q.org/about.html"), ("https://q.org/a/b", "c..d/e", "https://q.org/a/c..d/e")]
    df = spark.createDataFrame(rows, "base string, href string, want string")
    for r in df.withColumn("got", cr.resolve_url(F.col("base"), F.col("href"))).collect():
        assert r.got == r.want

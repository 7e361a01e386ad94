"""Business signals from stored pages.

Each extractor turns one page row into a small array of signals. All of them run in the
same pass over the page bodies; what is shuffled afterwards are the few short signals,
combined per task first, never the pages.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill import lexicons as lx
from leadmill.functions import normalize as nz
from leadmill.functions.phones import dialled, number_of, region_for
from leadmill.functions.text import (
    deobfuscate, head_texts, html_blocks, percent_decode, title_case,
)
from leadmill.operators.borders import border_years, page_edge
from leadmill.operators.crawl import anchors
from leadmill.operators.ranking import first_k
from leadmill.session import checkpoint

SIGNAL = "array<struct<kind:string,value:string,note:string,first:bigint,pos:int>>"


def prepare(pages: DataFrame) -> DataFrame:
    """Adds the text forms every extractor shares, computed once per page."""
    out = pages.withColumn("_blocks", html_blocks("html"))
    lines = F.split(F.array_join("_blocks", "\n"), r"\r\n|\n|\r")
    return out.withColumns(
        {
            "text": F.array_join("_blocks", " "),
            "lines": F.filter(F.transform(lines, lambda x: F.trim(x, F.lit(" \t\r\n"))), lambda x: x != ""),
            "links": anchors("html"),
            "head": F.when(F.col("path") == "/", head_texts("html")),
        }
    ).drop("_blocks")


def _signal(kind: str, value, note=None, first=None, pos=None) -> Column:
    """``first`` orders before page order (years); ``pos`` inside the page."""
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(kind).alias("kind"),
        value.cast("string").alias("value"),
        (none if note is None else note).alias("note"),
        (F.lit(0) if first is None else first).cast("bigint").alias("first"),
        (F.lit(0) if pos is None else pos).cast("int").alias("pos"),
    )


def _one(kind: str, value: Column, **kw) -> Column:
    return F.filter(F.array(_signal(kind, value, **kw)), lambda s: s["value"].isNotNull())


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


# ---- e-mails, phones, links ----


def real_email(e: Column, domain: Column) -> Column:
    """Plausible address of the company or of a free-mail host."""
    local, host = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    junk = F.lit(False)
    for d in lx.JUNK_MAIL_HOSTS:
        junk = junk | (host == d) | host.endswith("." + d)
    ours = (host == domain) | host.endswith(F.concat(F.lit("."), domain))
    return (
        e.rlike("^(?:" + lx.EMAIL_IN_TEXT + ")$")
        & ~F.substring_index(host, ".", -1).isin(lx.JUNK_MAIL_TLDS)
        & ~junk
        & ~local.isin(lx.JUNK_MAILBOXES)
        & (F.length(local) <= 40)
        & ~local.rlike("^[0-9a-f]{16,}$")
        & (ours | host.isin(lx.FREE_MAIL))
    )


def page_emails(html="html", text="text", domain="domain") -> Column:
    linked = F.transform(
        F.regexp_extract_all(F.col(html), F.lit(lx.MAILTO_TARGET), F.lit(1)), percent_decode
    )
    written = F.regexp_extract_all(deobfuscate(text), F.lit(lx.EMAIL_IN_TEXT), F.lit(0))
    found = F.transform(
        F.concat(linked, written),
        lambda e: F.lower(F.regexp_replace(F.trim(e), r"^\.+|\.+$", "")),
    )
    return F.filter(F.array_distinct(found), lambda e: real_email(e, F.col(domain)))


def dialled_phones(html="html", text="text") -> Column:
    """Numbers as dialled, digits only behind an optional +, distinct, in order."""
    linked = F.transform(
        F.regexp_extract_all(F.col(html), F.lit(lx.TEL_TARGET), F.lit(1)), percent_decode
    )
    written = F.regexp_extract_all(F.col(text), F.lit(lx.PHONE_IN_TEXT), F.lit(0))
    parts = F.transform(F.concat(linked, written), dialled)
    numbers = F.transform(parts, lambda p: F.concat(F.when(p["world"], "+").otherwise(""), p["digits"]))
    return F.array_distinct(F.filter(numbers, lambda p: p.rlike("[0-9]")))


def _emails() -> Column:
    return F.transform(page_emails(), lambda e, i: _signal("email", e, pos=i))


def _phones() -> Column:
    return F.transform(dialled_phones(), lambda p, i: _signal("phone", p, pos=i))


def social_page(href: Column, network: str) -> Column:
    """The company page this link points to on the network, else NULL."""
    yes, no = lx.SOCIAL[network]
    hit = F.regexp_replace(F.regexp_extract(href, yes, 0), "[/.]+$", "")
    ok = hit != ""
    return F.when(ok if no is None else ok & ~href.rlike(no), hit)


def _socials() -> Column:
    likely = F.filter("links", lambda a: a["href"].rlike(r"(?i)(linkedin|facebook|instagram|twitter|x|youtube)\.com/"))

    def pages_on(network):
        return F.transform(
            likely,
            lambda a, i: _signal("social", F.lit(network), note=social_page(a["href"], network), pos=i),
        )

    return F.filter(F.concat(*[pages_on(n) for n in lx.SOCIAL]), lambda s: s["note"].isNotNull())


# ---- years, ownership, hiring, technology ----


def founded_years(text: Column, this_year: int) -> Column:
    years = F.transform(F.regexp_extract_all(text, F.lit(lx.FOUNDED), F.lit(1)), lambda y: y.cast("int"))
    return F.filter(years, lambda y: y.between(1850, this_year))


def copyright_years(text: Column, this_year: int) -> Column:
    years = F.transform(F.regexp_extract_all(text, F.lit(lx.COPYRIGHT), F.lit(1)), lambda y: y.cast("int"))
    return F.filter(years, lambda y: y.between(1990, this_year + 1))


def _years(this_year: int) -> Column:
    old = F.array_min(founded_years(F.col("text"), this_year))
    seen = F.array_max(copyright_years(F.col("text"), this_year))
    source = F.array_max(copyright_years(F.col("html"), this_year))
    # bound, as each use of a column inside an array function is evaluated again
    return F.concat(
        nz.let(page_edge(F.col("text")), lambda e: F.array(_signal("edge", e["edge"], note=F.when(e["opens"], "opens")))),
        nz.let(old, lambda y: _one("founded", y, first=y)),
        nz.let(seen, lambda y: _one("copyright", y, first=-y)),
        nz.let(source, lambda y: _one("copyright_source", y, first=-y)),
    )


def _family() -> Column:
    return _one("family", _filled(F.regexp_extract("text", lx.FAMILY, 0)))


def _hiring() -> Column:
    careers = F.when((F.col("path") != "/") & F.col("path").rlike(lx.CAREERS_PATH), "careers page")
    board = F.when(F.col("html").rlike(lx.JOB_BOARD), "job board link")
    return F.concat(
        _one("hiring_path", careers),
        _one("hiring_phrase", _filled(F.regexp_extract("text", lx.HIRING, 0))),
        _one("hiring_board", board),
    )


def _technology() -> Column:
    # one SQL text instead of a hundred column calls
    def quoted(text):
        return "'" + text.replace("'", "''") + "'"

    items = [
        "named_struct('kind', 'tech', 'value', CASE WHEN {} THEN {} END, 'note', CAST(NULL AS STRING), "
        "'first', 0L, 'pos', {})".format(" OR ".join(f"contains(html, {quoted(m)})" for m in marks), quoted(name), i)
        for i, (name, (marks, _)) in enumerate(lx.TECHNOLOGIES.items())
    ]
    return F.expr(f"filter(array({', '.join(items)}), s -> s.value IS NOT NULL)")


def _meta() -> Column:
    def text(*places):
        found = F.filter(F.array(*[F.get("head", F.lit(i)) for i in places]), lambda x: x != "")
        return F.get(found, F.lit(0))

    return F.concat(
        _one("title", F.substring(text(0), 1, 200)),
        _one("description", F.substring(text(1, 2, 3), 1, 500)),
        _one("site_name", text(4)),
    )


# ---- people ----

_TITLES = "|".join(
    [lx.FOUNDER_TITLE]
    + [re.escape(t).replace(r"\ ", " ") for t in sorted(lx.DECISION_TITLES + lx.OTHER_TITLES, key=len, reverse=True)]
)
NAME_THEN_TITLE = (
    rf"({lx.PERSON_NAME})\s*(?:,|-|–|\||\()\s*({lx.TITLE_QUALIFIER}(?i:{_TITLES}))\b"
)
TITLE_THEN_NAME = rf"\b({lx.TITLE_QUALIFIER}(?i:{_TITLES}))\s*(?::|,|-|–)?\s+({lx.PERSON_NAME})"
_TITLE_WORDS = sorted({w for t in lx.DECISION_TITLES + lx.OTHER_TITLES for w in t.split()})
_NOT_NAME = lx.NAME_STOP_WORDS + lx.NAME_UI_WORDS
_ANY_TITLE = r"(?i)\b(?:" + "|".join(["founder", "owner", *lx.DECISION_TITLES, *lx.OTHER_TITLES]) + r")\b"


def person_name(raw: Column) -> Column:
    """Leading menu words dropped; NULL unless two or more words that can be names remain."""
    stop = "|".join(lx.NAME_STOP_WORDS)
    name = F.trim(F.regexp_replace(F.regexp_replace(raw, r"\s+", " "), rf"^(?:(?:{stop})(?: |$))+", ""))
    words = F.split(name, " ")
    bad = F.exists(
        words,
        lambda w: w.isin(_NOT_NAME)
        | F.lower(w).isin(_TITLE_WORDS)
        | ((F.length(w) > 2) & w.rlike("^[^a-z]*[A-Z][^a-z]*$")),
    )
    return F.when((F.size(words) >= 2) & ~bad, name)


def person_title(raw: Column) -> Column:
    t = title_case(F.trim(raw))
    for short in ("Ceo", "Coo", "Cfo"):
        t = F.replace(t, F.lit(short), F.lit(short.upper()))
    return t


def people_in(lines: Column) -> Column:
    """array<struct<name, title, pos>> over text lines, in match order."""
    usable = F.filter(
        F.transform(lines, lambda x, i: F.struct(x.alias("line"), i.alias("no"))),
        lambda x: (F.length(x["line"]) <= 200) & x["line"].rlike(_ANY_TITLE),
    )

    def matches(x, pattern, name_group, base):
        pairs = F.arrays_zip(
            F.regexp_extract_all(x["line"], F.lit(pattern), F.lit(name_group)).alias("name"),
            F.regexp_extract_all(x["line"], F.lit(pattern), F.lit(3 - name_group)).alias("title"),
        )
        return F.transform(
            pairs,
            lambda p, j: F.struct(
                person_name(p["name"]).alias("name"),
                person_title(p["title"]).alias("title"),
                (x["no"] * 400 + base + j).alias("pos"),
            ),
        )

    found = F.flatten(
        F.transform(
            usable,
            lambda x: F.concat(matches(x, NAME_THEN_TITLE, 1, 0), matches(x, TITLE_THEN_NAME, 2, 200)),
        )
    )
    return F.filter(found, lambda p: p["name"].isNotNull())


def _people() -> Column:
    return F.transform(
        people_in(F.col("lines")),
        lambda p: _signal(
            "person", p["name"], note=p["title"], first=(F.col("path") == "/").cast("int"), pos=p["pos"]
        ),
    )


# ---- registry and assembly ----

Extractor = Callable[[int], Column]
EXTRACTORS: dict[str, Extractor] = {
    "meta": lambda year: _meta(),
    "emails": lambda year: _emails(),
    "phones": lambda year: _phones(),
    "socials": lambda year: _socials(),
    "founded": _years,
    "family": lambda year: _family(),
    "hiring": lambda year: _hiring(),
    "tech_stack": lambda year: _technology(),
    "people": lambda year: _people(),
}


def register_extractor(name: str, extractor: Extractor) -> None:
    """Plug-in: a column of signals over the prepared page columns."""
    EXTRACTORS[name] = extractor


def page_signals(pages: DataFrame, this_year: int, only: list[str] | None = None,
                 places: DataFrame | None = None) -> DataFrame:
    """(domain, seq, kind, value, note, first, pos), one row per signal on a page.

    ``pages`` has domain, path, seq, html. ``places`` (domain, country), one row per domain, says
    where numbers without a country code are dialled, and only signals of its domains stay; it
    meets the short signals, never the page bodies.
    """
    arrays = [fn(this_year).cast(SIGNAL) for name, fn in EXTRACTORS.items() if only is None or name in only]
    found = prepare(pages).select("domain", "seq", F.inline(F.concat(*arrays)))
    if places is None:
        found = found.withColumn("country", F.lit(None).cast("string"))
    else:
        found = found.join(places.select("domain", "country"), "domain")
    parts = F.struct(F.col("value").startswith("+").alias("world"), F.replace("value", F.lit("+"), F.lit("")).alias("digits"))
    number = nz.let(parts, lambda p: number_of(p, region_for("country")))
    found = found.withColumn("value", F.when(F.col("kind") == "phone", number).otherwise(F.col("value"))).drop("country")
    return found.filter("kind <> 'phone' OR value IS NOT NULL")


def with_border_years(signals: DataFrame, this_year: int) -> DataFrame:
    """Signals with the years of phrases over page borders in place of the pages' edges.

    The signals are written once, as they are read twice; they are short.
    """
    signals = checkpoint(signals)
    edges = signals.filter("kind = 'edge'").select("domain", "seq", F.col("value").alias("edge"), F.col("note").isNotNull().alias("opens"))
    rest = signals.filter("kind <> 'edge'")
    if edges.filter("opens").isEmpty():
        return rest
    found = border_years(edges, this_year)
    rank = F.when(F.col("kind") == "founded", F.col("year")).otherwise(-F.col("year"))
    return rest.unionByName(
        found.select("domain", "seq", "kind", F.col("year").cast("string").alias("value"), F.lit(None).cast("string").alias("note"),
                     rank.cast("bigint").alias("first"), F.lit(0).alias("pos"))
    )


CAPS = {"email": lx.MAX_EMAILS, "phone": lx.MAX_PHONES, "person": lx.MAX_PEOPLE}
_SINGLE = ["title", "description", "site_name", "founded", "copyright", "copyright_source", "family",
           "hiring_path", "hiring_phrase", "hiring_board"]


def domain_signals(signals: DataFrame) -> DataFrame:
    """Distinct values per domain and kind in first-seen order, cut to what is kept.

    The first place of a value is a mergeable minimum; the cut to the kept number happens
    in the map tasks as well, so no domain gathers more than a few rows per task.
    """
    place = F.struct("first", "seq", "pos")
    own = F.when(F.col("kind").isin(*_SINGLE), F.lit("")).otherwise(F.col("value"))
    first = (
        signals.filter("kind <> 'edge'").withColumn("own", own)
        .groupBy("domain", "kind", "own")
        .agg(F.min_by(F.struct("value", "note", "first", "seq", "pos"), place).alias("s"))
        .select("domain", "kind", "s.*")
    )
    leader = F.when(F.col("kind") == "person", ~nz.is_decision_maker("note")).otherwise(F.lit(False))
    order = [F.col("first"), F.col("seq"), leader, F.col("pos"), F.col("value")]
    widest = max(len(lx.TECHNOLOGIES), *CAPS.values())
    cut = first_k(first, ["domain", "kind"], order, widest, "rank")
    keep = F.lit(True)
    for kind, cap in CAPS.items():
        keep = keep & ((F.col("kind") != kind) | (F.col("rank") <= cap))
    return cut.filter(keep)


def enrichment_rows(pages: DataFrame, this_year: int, only: list[str] | None = None,
                    places: DataFrame | None = None) -> DataFrame:
    """One row per domain with everything found on its pages (arrays of fixed maximum size);
    ``only`` limits the extractors that run, ``places`` the domains (see page_signals)."""
    sig = page_signals(pages, this_year, only, places)
    if only is None or "founded" in only:
        sig = with_border_years(sig, this_year)
    sig = domain_signals(sig)

    def listed(kind: str, item: Column) -> Column:
        got = F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", item.alias("item"))))
        return F.transform(F.array_sort(got), lambda x: x["item"])

    def single(kind: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col("value")))

    modern = [name for name, (_, m) in lx.TECHNOLOGIES.items() if m]
    person = F.struct(
        F.col("value").alias("full_name"),
        F.col("note").alias("title"),
        nz.is_decision_maker("note").alias("is_decision_maker"),
    )
    social = F.struct(F.col("value").alias("key"), F.col("note").alias("value"))
    found = sig.groupBy("domain").agg(
        listed("email", F.col("value")).alias("emails"),
        listed("phone", F.col("value")).alias("phones"),
        listed("person", person).alias("people"),
        listed("tech", F.col("value")).alias("tech_stack"),
        F.map_from_entries(listed("social", social)).alias("socials"),
        F.coalesce(F.bool_or((F.col("kind") == "tech") & F.col("value").isin(modern)), F.lit(False)).alias("modern_stack"),
        *[single(k).alias(k) for k in _SINGLE],
    )
    evidence = F.array_compact(
        F.array(
            F.col("hiring_path"),
            F.concat(F.lit('"'), F.col("hiring_phrase"), F.lit('"')),
            F.col("hiring_board"),
        )
    )
    found = found.select(
        "domain", "emails", "phones", "people", "tech_stack", "socials", "modern_stack", "title", "description",
        "site_name",
        F.col("founded").cast("int").alias("founded_year"),
        F.coalesce("copyright", "copyright_source").cast("int").alias("copyright_year"),
        F.col("family").isNotNull().alias("family_owned"),
        F.col("family").alias("family_owned_hint"),
        (F.size(evidence) > 0).alias("hiring"),
        evidence.alias("hiring_evidence"),
    )
    sites = pages.groupBy("domain").agg(F.count("*").alias("n_pages"))
    if places is not None:
        sites = sites.join(places.select("domain"), "domain", "left_semi")
    out = sites.join(found, "domain", "left")
    none = F.array().cast("array<string>")
    return out.withColumns(
        {
            **{c: F.coalesce(c, none) for c in ("emails", "phones", "tech_stack", "hiring_evidence")},
            **{c: F.coalesce(c, F.lit(False)) for c in ("modern_stack", "family_owned", "hiring")},
        }
    )


def enrichment_documents(rows: DataFrame) -> DataFrame:
    """(domain, doc): every row as one VARIANT, to be stored; fields may come and go between versions."""
    return rows.select("domain", F.to_variant_object(F.struct(*rows.columns)).alias("doc"))


def document_rows(docs: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Domain and ``fields`` (name to type) of stored documents; NULL where a document lacks the field or
    holds something else under its name."""
    return docs.select("domain", *[F.try_variant_get("doc", f"$.{name}", kind).alias(name) for name, kind in fields.items()])


def crawled_paths(pages: DataFrame) -> DataFrame:
    """(domain, path): which pages a domain's enrichment rests on."""
    return pages.select("domain", "path").distinct()


def apply_enrichment(companies: DataFrame, enrichment: DataFrame, sites: DataFrame, now: str) -> DataFrame:
    """Write findings onto companies; companies without a domain or finding stay as they are.

    ``sites`` holds (domain, website_status, has_ssl, http_status, final_url).
    """
    c, e, s = companies.filter("domain IS NOT NULL").alias("c"), enrichment.alias("e"), sites.alias("s")
    both = (
        c.join(s, F.col("c.domain") == F.col("s.domain"), "left")
        .join(e, F.col("c.domain") == F.col("e.domain"), "left")
    )
    done = F.col("s.domain").isNotNull()
    have = set(companies.columns)

    def old(name, kind="string"):
        return F.col(f"c.{name}") if name in have else F.lit(None).cast(kind)

    def new(value, before):
        return F.when(done, value).otherwise(before)

    text = F.array().cast("array<string>")
    pairs = F.create_map().cast("map<string,string>")
    no = F.lit(False)
    changed = {
        "website_status": new(F.col("s.website_status"), old("website_status")),
        "website_url": F.coalesce(F.nullif(F.col("s.final_url"), F.lit("")), old("website_url")),
        "description": F.when(
            F.coalesce(old("description"), F.lit("")) == "", F.coalesce(F.col("e.description"), old("description"))
        ).otherwise(old("description")),
        "founded_year": F.coalesce(F.col("e.founded_year"), old("founded_year", "int")),
        "copyright_year": new(F.col("e.copyright_year"), old("copyright_year", "int")),
        "tech_stack": new(F.coalesce("e.tech_stack", text), old("tech_stack", "array<string>")),
        "socials": new(F.coalesce("e.socials", pairs), old("socials", "map<string,string>")),
        "has_ssl": new(F.coalesce("s.has_ssl", no), old("has_ssl", "boolean")),
        "http_status": new(F.col("s.http_status"), old("http_status", "int")),
        "hiring": new(F.coalesce("e.hiring", no), old("hiring", "boolean")),
        "hiring_evidence": new(F.coalesce("e.hiring_evidence", text), old("hiring_evidence", "array<string>")),
        "modern_stack": new(F.coalesce("e.modern_stack", no), old("modern_stack", "boolean")),
        "family_owned": new(F.coalesce("e.family_owned", no), old("family_owned", "boolean")),
        "family_owned_hint": new(F.col("e.family_owned_hint"), old("family_owned_hint")),
        "n_pages": new(F.coalesce("e.n_pages", F.lit(0)), old("n_pages", "bigint")),
        "last_enriched_at": new(F.lit(now).cast("timestamp"), old("last_enriched_at", "timestamp")),
    }
    same = [F.col(f"c.{x}") for x in companies.columns if x not in changed]
    out = both.select(*same, *[v.alias(k) for k, v in changed.items()])
    return out.unionByName(companies.filter("domain IS NULL"), allowMissingColumns=True).select(*out.columns)


def merge_signals(old: Column, new: Column) -> Column:
    """Key-wise merge of two signal maps, the new value wins."""
    return F.map_zip_with(old, new, lambda k, a, b: F.coalesce(b, a))

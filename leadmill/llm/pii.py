"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base patterns find e-mail addresses, IP addresses, card and phone numbers. They are the seeds of the bootstrap:

1. Runs of words with a digit or ``@`` are cut at the borders of base spans and at ``MARKS``. Every base span is a
   mention and a seed of its kind; every other piece is a mention of its own, and so is a word with ``@``. Words of
   a piece that have the shape of a kind are tried too, where the whole piece does not become a span.
2. The words before and after a mention are its lexical patterns (two on the left, one on the left, two on the
   right, within ``CONTEXT`` characters). Neighbours in a run of the same class (with ``@`` or without) share the words
   around them; those of the other class count as the word ``@`` or ``0``. Distinct (pattern, instance) pairs form a
   bipartite graph.
3. For ``ROUNDS`` rounds a pattern's score for a kind is the mean of its instances' scores, with one instance of
   score 0 added, and the score of an instance of the kind's shape is that at least one of its patterns is right. Instances
   of ``CONFIDENT`` score count as seeds in the next round, and ``MIN_SEEDS`` make a pattern: so what one context
   yields opens others.
4. Mentions that fit the shape of a kind, beside a pattern whose score is at least ``CONFIDENT``, become spans of
   that kind, unless they overlap a base span.

Nothing is collected: scores are tables, joined to the edges. Null texts count as empty; rows are told apart by
their place in a written table, so repeated rows and ids do no harm; an empty table gives an empty result; other
columns are ignored, whatever their names. Texts of any length are scanned whole, in linear time; of spans that overlap
the first one's placeholder stays, and of kinds that score alike the first in ``KINDS``. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadmill.llm.common import Cuts, numbered

KINDS = ("email", "ip", "card", "phone")
# The base patterns. Runs are possessive and begin where a run begins (or the last match ended), which
# changes no match and keeps a run of any length linear.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
MENTION = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[^\s0-9@]*+[0-9@]\S*+)*+"
#: Marks that end a piece of a run; a colon between digits does not, a point or colon before a space does.
MARKS = r",;|<>\"\[\]{}=!?"
_CHAR = rf"(?:[^\s@:{MARKS}]|(?<=[0-9]):(?=[0-9]))"
PIECE = rf"{_CHAR}*+@(?:{_CHAR}|@)*+|{_CHAR}++(?!@)(?:(?<!\.)\x20{_CHAR}++(?!@))*+"
EDGE = "[\"'()\\[\\]{}<>.,;:!?=]"
CONTEXT = 64
ROUNDS = 4
MIN_SEEDS = 3
CONFIDENT = 0.6
#: Shapes that a found identifier of a kind must have.
SHAPES = {
    "email": r"^\S+@\S+$",
    "ip": r"^[0-9]{1,3}(\.[0-9]{1,3}){3}(:[0-9]+)?$",
    "card": r"^[0-9](?:[\x20.-]?[0-9]){11,18}$",
    "phone": r"^\+?\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,14}$",
}


def _sums(lengths: Column, join: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """Running sums (or another ``join`` that 0 leaves alone) of an integer array, in log2(size) passes over it."""
    steps = F.ceil(F.log2(F.size(lengths) + F.lit(0.0))).cast("int")
    shifted = lambda acc, i, s: F.when(i >= F.expr("0") + s, acc[F.greatest(i - s, F.lit(0))]).otherwise(F.lit(0))
    return F.when(F.size(lengths) < 2, lengths).otherwise(
        F.aggregate(
            F.transform(F.sequence(F.lit(0), F.greatest(steps - 1, F.lit(0))), lambda k: F.pow(F.lit(2), k).cast("int")),
            lengths, lambda acc, s: F.transform(acc, lambda x, i: join(x, shifted(acc, i, s))),
        )
    )


def _found(frame: DataFrame, name: str, pattern: str, needs: str) -> DataFrame:
    """Adds ``name``: array of (start, end, value, before, behind) of all matches in ``t``."""
    some = F.col("t").contains(needs) if needs == "@" else F.col("t").rlike(needs)
    parts, hits, starts = f"_{name}_p", f"_{name}_m", f"_{name}_s"
    none = F.array().cast("array<string>")
    return (
        frame.withColumn(hits, F.when(some, F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).otherwise(none))
        .withColumn(parts, F.when(F.size(hits) > 0, F.split("t", pattern, -1)).otherwise(none))
        .withColumn(starts, _sums(F.transform(hits, lambda m, i: F.length(m) + F.length(F.col(parts)[i]))))
        .withColumn(
            name,
            F.transform(hits, lambda m, i: F.struct(
                (F.col(starts)[i] - F.length(m)).alias("start"), F.col(starts)[i].alias("end"), m.alias("value"),
                F.right(F.col(parts)[i], F.lit(CONTEXT)).alias("before"), F.left(F.col(parts)[i + 1], F.lit(CONTEXT)).alias("behind"),
            )),
        )
        .drop(parts, hits, starts)
    )


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        double = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, double).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    digits = F.translate(value, " -+().", "")
    if kind == "ip":
        return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def base_spans(frame: DataFrame) -> DataFrame:
    """Adds ``base`` to rows with a text ``t``: array of (start, rank, end), rank being the kind's place in KINDS.

    Also adds ``held``, the same spans with their value and the text behind them.
    """
    def good(rank: int, kind: str) -> Column:
        held = F.filter(kind, lambda m: _holds(kind, m["value"]))
        return F.transform(held, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), m["value"].alias("value"), m["behind"].alias("behind")))

    arrays = []
    for rank, kind in enumerate(KINDS):
        frame = _found(frame, kind, PATTERNS[kind], NEEDS[kind])
        arrays.append(good(rank, kind))
    frame = frame.withColumn("held", F.sort_array(F.concat(*arrays))).drop(*KINDS)
    return frame.withColumn("base", F.transform("held", lambda m: F.struct(m["start"].alias("start"), m["rank"].alias("rank"), m["end"].alias("end"))))


def _low(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "\\s+", -1), lambda w: w != "")


def _runs(frame: DataFrame) -> DataFrame:
    """Adds ``runs``: array of (start, end, value, left words, right words, base spans that overlap it)."""
    frame = _found(frame, "runs", MENTION, "[0-9@]")
    return frame.withColumn("runs", F.transform("runs", lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"),
        _low(m["before"]).alias("left"), _low(m["behind"]).alias("right"),
        F.filter("held", lambda b: (b["start"] < m["end"]) & (b["end"] > m["start"])).alias("over"),
    ))).drop("held")


def _trimmed(start: Column, value: Column) -> Column:
    """(start, end, value) without punctuation at the edges."""
    begin = start + F.length(value) - F.length(F.regexp_replace(value, f"^{EDGE}+", ""))
    inner = F.regexp_replace(value, f"^{EDGE}+|{EDGE}+$", "")
    return F.struct(begin.alias("start"), (begin + F.length(inner)).alias("end"), inner.alias("value"))


def _shaped(value: Column) -> Column:
    return reduce(lambda a, b: a | b, (value.rlike(SHAPES[k]) for k in KINDS))


def _mentions(scanned: DataFrame) -> DataFrame:
    """row, piece, whole, counts, start, end, value, seed, left and right words of each mention.

    ``whole`` is false for the words of a piece, ``counts`` for those of a piece that has a shape itself: they are
    tried, but are no instances of a pattern.
    """
    runs = scanned.where(F.size("runs") > 0).select("row", F.explode("runs").alias("r")).select("row", "r.*")
    # base spans are masked, so that what lies beside them is found as pieces
    reach = runs.withColumn("reach", _sums(F.transform("over", lambda b: b["end"]), F.greatest))
    free = F.transform("over", lambda b, i: F.greatest(F.col("start"), F.when(i > 0, F.get("reach", i - 1)).otherwise(F.lit(0))))
    cut = lambda a, b: F.substring(F.col("value"), a - F.col("start") + 1, F.greatest(b - a, F.lit(0)))
    reach = reach.withColumn("free", free)
    fill = F.zip_with("over", "free", lambda b, f: F.concat(
        cut(f, b["start"]), F.repeat(F.lit("|"), F.greatest(F.least(b["end"], F.col("end")) - F.greatest(b["start"], f), F.lit(0)))
    ))
    last = F.element_at("reach", -1)
    masked = F.when(F.size("over") == 0, F.col("value")).otherwise(F.concat(F.array_join(fill, ""), cut(last, F.col("end"))))
    found = _found(reach.withColumn("t", masked), "pieces", PIECE, "[0-9@]")
    pieces = F.filter(
        F.transform("pieces", lambda m: _trimmed(F.col("start") + m["start"], m["value"])), lambda m: m["value"].rlike("[0-9@]")
    )
    none = lambda kind: F.lit(None).cast(kind)
    pieces = F.transform(pieces, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), none("int").alias("seed"), none("string").alias("behind")))
    seeds = F.transform(F.filter("over", lambda b: b["start"] >= F.col("start")), lambda b: F.struct(
        b["start"].alias("start"), b["end"].alias("end"), b["value"].alias("value"), b["rank"].alias("seed"),
        F.when(b["end"] > F.col("end"), b["behind"]).alias("behind"),
    ))
    found = found.select("row", "left", "right", F.sort_array(F.concat(pieces, seeds)).alias("all"))
    found = found.withColumn("kinds", F.transform("all", lambda m: F.when(m["value"].contains("@"), "@").otherwise("0")))
    found = found.withColumn("turns", _sums(F.transform("kinds", lambda k, i: F.when((i > 0) & (k != F.get("kinds", i - 1)), 1).otherwise(0))))
    own, turn, turns = F.col("own"), F.col("turn"), F.col("turns")
    each = found.select("row", "left", "right", F.element_at("turns", -1).alias("turns"), F.explode(F.arrays_zip("all", "kinds", F.col("turns").alias("turn"))).alias("m"))
    each = each.select("row", "left", "right", "turns", "m.all.*", F.col("m.kinds").alias("own"), F.col("m.turn").alias("turn"))
    other = F.when(own == "@", "0").otherwise("@")
    left = F.when(turn == 0, F.col("left")).when(turn == 1, F.concat("left", F.array(other))).otherwise(F.array(own, other))
    right = (
        F.when(F.col("behind").isNotNull(), _low(F.col("behind"))).when(turns == turn, F.col("right"))
        .when(turns == turn + 1, F.concat(F.array(other), "right")).otherwise(F.array(other, own))
    )
    each = each.select("row", "start", "end", "value", "seed", left.alias("left"), right.alias("right"), F.split("value", "\\x20", -1).alias("words"))
    each = each.withColumn("ends", _sums(F.transform("words", lambda w: F.length(w) + 1)))
    words = F.filter(F.zip_with("words", "ends", lambda w, e: _trimmed(F.col("start") + e - F.length(w) - 1, w)), lambda m: _shaped(m["value"]))
    mark = lambda m, whole, counts: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), F.lit(whole).alias("whole"), counts.alias("counts"))
    parts = F.array(mark(F.struct("start", "end", "value"), True, F.lit(True)))
    parts = F.when(
        F.col("seed").isNull() & (F.size("words") > 1), F.concat(parts, F.transform(words, lambda m: mark(m, False, ~_shaped(F.col("value")))))
    ).otherwise(parts)
    return each.select("row", F.col("start").alias("piece"), "seed", "left", "right", F.explode(parts).alias("p")).select("row", "piece", "seed", "left", "right", "p.*")


def _patterns(left: Column, right: Column) -> Column:
    """The lexical patterns of a mention."""
    n = F.size(left)
    word = lambda i: left[F.greatest(i, F.lit(0))]
    return F.array_compact(F.array(
        F.when(n >= 2, F.concat(F.lit("l2 "), word(n - 2), F.lit(" "), word(n - 1))),
        F.when(n >= 1, F.concat(F.lit("l1 "), word(n - 1))),
        F.when(F.size(right) >= 2, F.concat(F.lit("r2 "), right[0], F.lit(" "), F.when(F.size(right) >= 2, right[1]))),
    ))


def scan(docs: DataFrame, cuts: Cuts, doc_id: str = "doc_id", text: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """row, doc_id, ``keep``, base and runs of each row, as a written table. One pass over the texts."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("bigint").alias("doc_id"), *keep,
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"),
    )
    return cuts.write(_runs(base_spans(rows)).drop("t"), "scan")


def discover(scanned: DataFrame, cuts: Cuts) -> DataFrame:
    """row, start, rank, end of the spans that the bootstrap adds."""
    each = _mentions(scanned).select(
        "row", "piece", "whole", "counts", "start", "end", F.lower("value").alias("value"), "seed", _patterns(F.col("left"), F.col("right")).alias("patterns")
    )
    each = cuts.write(each, "mentions")
    edges = cuts.write(
        each.where("counts").select(F.explode("patterns").alias("pattern"), "value", "seed").groupBy("pattern", "value").agg(F.min("seed").alias("seed")), "edges"
    )
    per = lambda f: [f(r).cast("double").alias(f"k{r}") for r in range(len(KINDS))]
    score = edges.select("value", *per(lambda r: F.coalesce((F.col("seed") == r).cast("double"), F.lit(0.0)))).groupBy("value").agg(*(F.max(f"k{r}").alias(f"k{r}") for r in range(len(KINDS))))
    score = cuts.write(score, "instances-0")
    known = F.greatest(*(F.col(f"k{r}") for r in range(len(KINDS)))) >= CONFIDENT
    for turn in range(1, ROUNDS + 1):
        # of equal plans in each round only the last round's tables are kept; what the round before found counts as a seed
        mean = cuts.write(
            edges.join(score, "value").groupBy("pattern").agg(
                F.count_if(known).alias("seeds"), *per(lambda r: F.sum(f"k{r}") / (F.count("*") + 1))
            ).where(F.col("seeds") >= MIN_SEEDS).drop("seeds"),
            f"patterns-{turn}",
        )
        if turn < ROUNDS:
            right = edges.join(mean, "pattern").groupBy("value", "seed").agg(*per(lambda r: 1 - F.exp(F.sum(F.log1p(-F.least(F.col(f"k{r}"), F.lit(1 - 1e-9)))))))
            own = edges.groupBy("value").agg(F.min("seed").alias("seed"))
            right = right.groupBy("value").agg(*per(lambda r: F.max(f"k{r}")))
            fit = lambda r: F.when(F.col("value").rlike(SHAPES[KINDS[r]]), F.coalesce(f"k{r}", F.lit(0.0))).otherwise(F.lit(0.0))
            score = cuts.write(
                own.join(right, "value", "left").select(
                    "value", *per(lambda r: F.when(F.col("seed").isNotNull(), (F.col("seed") == r).cast("double")).otherwise(fit(r)))
                ),
                f"instances-{turn}",
            )
            cuts.drop(f"instances-{turn - 1}", f"patterns-{turn}")
    sure = mean.where(reduce(lambda a, b: a | b, (F.col(f"k{r}") >= CONFIDENT for r in range(len(KINDS)))))
    open_ = each.where("seed is null").select("row", "piece", "whole", "start", "end", "value", F.explode("patterns").alias("pattern"))
    fits = F.array_max(F.array(*(
        F.when(F.col("value").rlike(SHAPES[k]) & (F.col(f"k{r}") >= CONFIDENT), F.struct(F.col(f"k{r}").alias("score"), F.lit(-r).alias("rank")))
        for r, k in enumerate(KINDS)
    )))
    found = (
        open_.join(sure, "pattern").withColumn("fit", fits).where("fit is not null")
        .groupBy("row", "piece", "whole", "start", "end").agg((-F.max("fit")["rank"]).alias("rank"))
    )
    # the words of a piece give way to the whole
    best = F.max("whole").over(Window.partitionBy("row", "piece"))
    return found.withColumn("best", best).where(F.col("whole") == F.col("best")).select("row", "start", "rank", "end")


def text_of(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", names[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """row, doc_id, ``keep``, base and spans (base and discovered), both arrays of (start, rank, end) in order."""
    cuts = Cuts(docs.sparkSession, "pii")
    scanned = scan(docs, cuts, doc_id, text, keep)
    return with_added(scanned, cuts.write(discover(scanned, cuts), "added"))


def with_added(scanned: DataFrame, added: DataFrame) -> DataFrame:
    """The rows of a scan with ``spans``, base and added ones, in place of ``runs``."""
    extra = added.groupBy("row").agg(F.collect_set(F.struct("start", "rank", "end")).alias("extra"))
    return scanned.drop("runs").join(extra, "row", "left").withColumn(
        "spans", F.sort_array(F.concat("base", F.coalesce("extra", F.slice("base", 1, 0))))
    ).drop("extra")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, the digest of the base spans, and all spans."""
    count = lambda r: F.size(F.filter("base", lambda s: s["rank"] == r)).cast("bigint")
    return find(docs).select(
        "doc_id", *(count(r).alias(f"n_{k}") for r, k in enumerate(KINDS)),
        F.sha2(text_of(F.col("base")), 256).alias("base_sha256"), text_of(F.col("spans")).alias("spans"),
    )


def redact(text: Column, spans: Column) -> Column:
    """The text with a placeholder for each span; spans that overlap share the first one's."""
    marks = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    part = lambda a, b: F.substring(text, a + 1, F.greatest(b - a, F.lit(0)))

    def step(acc, s):
        apart = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(apart, F.concat(acc["out"], F.array(part(acc["at"], s["start"]), marks[s["rank"]]))).otherwise(acc["out"]).alias("out"),
        )

    def close(acc):
        return F.concat(F.concat_ws("", acc["out"]), part(acc["at"], F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, close)).otherwise(text)


def redacted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with personal data replaced. The rows go along with the scan; only those that hold a digit or ``@``
    meet the spans found, so all others pass through no shuffle."""
    cuts = Cuts(docs.sparkSession, "pii")
    plain, (own, body) = numbered(docs, doc_id, text)
    scanned = scan(plain, cuts, own, body, (F.struct("*").alias("whole"),))
    rest = scanned.where((F.size("runs") == 0) & (F.size("base") == 0)).select("whole.*")
    some = with_added(scanned.where((F.size("runs") > 0) | (F.size("base") > 0)), cuts.write(discover(scanned, cuts), "added"))
    rows = some.select("whole.*", "spans")
    changed = F.size("spans") > 0
    out = rows.withColumn(body, F.when(changed, redact(F.col(body).cast("string"), F.col("spans"))).otherwise(F.col(body)))
    if "n_chars" in docs.columns:
        n = numbered(docs, "n_chars")[1][0]
        out = out.withColumn(n, F.when(changed, F.length(F.col(body))).otherwise(F.col(n)).cast(docs.schema["n_chars"].dataType))
    return rest.unionByName(out.select(*plain.columns)).toDF(*docs.columns)

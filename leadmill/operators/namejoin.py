"""All pairs of similar names without comparing all pairs.

Two names of lengths l1 <= l2 with ratio >= 92 differ by at most k = floor(0.08 (l1 + l2))
insertions and deletions. Two lossless ways turn that into equi-join keys:

* Cuts, for longer names. Cut the shorter one into k + m pieces: at least m of them stand
  unchanged in the longer one, shifted by at most k (PASS-JOIN, Li et al., VLDB 2011). So
  the m - 1 most common pieces can be left out and one of the other k + 1 still matches.
  Of those k + 1 one, say number j from 0, has just j edits before it: it is shifted by j, j - 2, ...
  or -j letters, and the k - j edits after it must make up the rest of the difference in length.
  Names whose pieces are shared by very many ("and cooling heating") are cut finer, which
  lets them leave out more of the common text.
* Deletions, for names that differ by a letter on either side and for those still crowded. The names have a common
  subsequence of l1 - a letters, a = (k - (l2 - l1)) / 2, so the shorter one without some a
  letters equals the longer one without some a + l2 - l1 letters (FastSS, Bocek et al., 2007).
  These keys are as good as matches, however many names look alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill import lexicons as lx
from leadmill.functions.similarity import is_similar, lcs_udf, max_edits
from leadmill.session import checkpoint, spread

PARTNERS = 2_000
CUTS = (1, 4, 12)
#: The spots of a name that fits any place.
ANYWHERE = -1


def _who(df: DataFrame) -> list[str]:
    """Columns that say whose a key is: an id and spots are only there for the name pass."""
    return [c for c in ("id", "name", "cand", "spots") if c in df.columns]


def _longest(length: Column) -> Column:
    """Longest length a similar name can have: 200 l1 >= 92 (l1 + l2)."""
    p = lx.FUZZY_PERCENT
    return F.floor(length * (200 - p) / F.lit(p)).cast("int")


def _div(a: Column, b: Column) -> Column:
    return F.floor(a / b).cast("int")


def _edits(l1: Column, l2: Column) -> Column:
    """``max_edits``, less one where that many edits cannot lead from the one length to the other."""
    k = max_edits(l1, l2)
    return k - F.pmod(k - (l2 - l1), F.lit(2))


def _tasks(df: DataFrame) -> int:
    """Tasks for steps whose work is in what they make of few bytes; by bytes, Spark would put them into a few."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _piece(i: Column, parts: Column, l1: Column) -> tuple[Column, Column]:
    start = _div(i * l1, parts)
    return start, _div((i + 1) * l1, parts) - start


# ---- cuts ----


def shorter_pieces(todo: DataFrame, m: int) -> DataFrame:
    """(name, cand, l2, spare, key): pieces of ``name`` towards names of length l2; any
    ``spare`` of them can be left out."""
    l1, l2 = F.length("name"), F.col("l2")
    k = _edits(l1, l2)
    parts = F.least(k + m, l1)

    def one(i):
        start, size = _piece(i, parts, l1)
        return F.xxhash64(l1, l2, F.lit(m), i, F.substr("name", start + 1, size))

    pieces = F.transform(F.sequence(F.lit(0), parts - 1), one)
    return todo.select(*_who(todo), "l2", (parts - k - 1).alias("spare"), F.explode(pieces).alias("key"))


def longer_pieces(names: DataFrame, shapes: DataFrame, m: int) -> DataFrame:
    """(name, cand, key): where a name may hold the pieces of shorter names."""
    l1, l2 = F.col("l1"), F.col("l2")
    k = _edits(l1, l2)
    d = l2 - l1
    parts = F.least(k + m, l1)

    def one(i):
        start, size = _piece(i, parts, l1)
        # the piece's number j among the k + 1 in use; the widest shifts of all these j
        low, high = F.greatest(F.lit(0), i - (parts - k - 1)), F.least(i, k)
        at_left, at_right = (F.least(F.greatest(_div(x, F.lit(2)), low), high) for x in (k - d, k + d))
        left, right = F.greatest(-at_left, d - k + at_left), F.least(at_right, d + k - at_right)
        places = F.filter(
            F.sequence(left, right, F.when(low == high, F.lit(2)).otherwise(F.lit(1))),
            lambda s: (start + s >= 0) & (start + s + size <= l2),
        )
        return F.transform(
            places, lambda s: F.xxhash64(l1, l2, F.lit(m), i, F.substr("name", start + s + 1, size))
        )

    keys = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), parts - 1), one)))
    return _shaped(names, shapes).select(*_who(names), F.explode(keys).alias("key"))


def _shaped(names: DataFrame, shapes: DataFrame) -> DataFrame:
    # lengths are few, and a shuffle by length puts all names of the most common one into one task
    return names.repartition(_tasks(names), "name").withColumn("l2", F.length("name")).join(F.broadcast(shapes), "l2")


def _partners(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per (name, l2): the rarest keys that are enough and how many partners they bring. Keys that no longer name has
    are the rarest of all: they are not carried along, and names that have too few others are gone."""
    common = b.groupBy("key").agg(
        F.count("*").alias("any"), F.count_if("cand").alias("cands")
    )
    rated = a.join(spread(common), "key").withColumn("n", F.when(F.col("cand"), F.col("any")).otherwise(F.col("cands")))
    kept = rated.groupBy(*_who(rated), "l2").agg(
        F.array_sort(F.collect_list(F.struct("n", "key"))).alias("use"), F.max("spare").alias("spare")
    ).filter(F.size("use") > F.col("spare"))
    return kept.withColumn("use", F.slice("use", F.lit(1), F.size("use") - F.col("spare"))).drop("spare").withColumn(
        "cost", F.aggregate("use", F.lit(0).cast("bigint"), lambda x, y: x + y["n"])
    )


# ---- deletions ----


def _without(name: Column, count: Column) -> Column:
    """All texts left when ``count`` (0 to 2) letters are taken out."""
    n = F.length(name)

    def drop(text, i):
        return F.concat(F.substr(text, F.lit(1), i), F.substr(text, i + 2, F.length(text)))

    places = F.sequence(F.lit(0), n - 1)
    one = F.transform(places, lambda i: drop(name, i))
    two = F.flatten(
        F.transform(
            F.filter(places, lambda i: i > 0),
            lambda i: F.transform(F.sequence(F.lit(0), i - 1), lambda j: drop(drop(name, i), j)),
        )
    )
    return F.array_distinct(F.when(count == 0, F.array(name)).when(count == 1, one).otherwise(two))


def _taken(l1: Column, l2: Column) -> tuple[Column, Column]:
    """Letters to take out of the shorter and of the longer name."""
    a = _div(max_edits(l1, l2) - (l2 - l1), F.lit(2))
    return a, a + l2 - l1


def _deletion_keys(rows: DataFrame, side: int) -> DataFrame:
    """Names with ids leave theirs behind: the text tells for certain what its hash only makes likely."""
    l1, l2 = F.col("l1"), F.col("l2")
    who = [c for c in _who(rows) if c != "name" or "id" not in rows.columns]
    texts = rows.select(*who, "l1", "l2", F.explode(_without(F.col("name"), _taken(l1, l2)[side])).alias("text"))
    keys = [F.xxhash64("l1", "l2", "text").alias("key"), *(["text"] if "id" in who else [])]
    return texts.select(*who, *keys, *([(l1 == l2).alias("even")] if side == 0 else []))


def _deletion_matches(todo: DataFrame, names: DataFrame, whole: bool = False) -> DataFrame:
    """Pairs whose keys are as good as matches. ``whole``: ``todo`` has all names, so of equal lengths each finds the other."""
    short = todo.repartition(_tasks(todo), "name").withColumn("l1", F.length("name"))
    shapes = short.select("l1", "l2").distinct()
    met = _met(_deletion_keys(short, 0), _deletion_keys(_shaped(names, shapes), 1))
    return _ordered(met.filter((~F.col("even")) | (F.col("a") < F.col("b"))) if whole else met)


# ---- pairs ----


def _met(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs that share a key, of which one is ``cand`` and that may have a place in common."""
    n, me = _tasks(a), "id" if "id" in a.columns else "name"
    keys = [c for c in ("key", "text") if c in a.columns]
    x = a.withColumnsRenamed({me: "a", "cand": "ca", "spots": "sa"}).repartition(n, *keys)
    y = b.withColumnsRenamed({"name": "name_b", me: "b", "cand": "cb", "spots": "sb"}).repartition(n, *keys)
    met = x.join(spread(y), keys).filter((F.col("ca") | F.col("cb")) & (F.col("a") != F.col("b")))
    return met.filter(F.col("sa").bitwiseAND(F.col("sb")) != 0) if "spots" in a.columns else met


def _ordered(met: DataFrame, *more: Column) -> DataFrame:
    """(a, b) with a < b, and b's spots where names have some."""
    spots = [F.when(F.col("a") < F.col("b"), F.col("sb")).otherwise(F.col("sa")).alias("b_spots")] if "sa" in met.columns else []
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *spots, *more)


def _cut_matches(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs that share a piece, with their names as x and y where they have ids."""
    met = _met(a, b)
    x, y = ("name", "name_b") if "id" in a.columns else ("a", "b")
    # the plain edit distance never exceeds insertions plus deletions: a cheap first test
    met = met.withColumn("edits", max_edits(F.length(x), F.length(y))).filter(F.expr(f"levenshtein({x}, {y}, edits)") >= 0)
    return _ordered(met, *([F.least(x, y).alias("x"), F.greatest(x, y).alias("y")] if "id" in a.columns else []))


def _with_lcs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    found = pairs.distinct().repartition(_tasks(pairs), b).withColumn("lcs", lcs_udf(a, b))
    return found.filter(is_similar(F.col("lcs"), F.length(a), F.length(b)))


def similar_pairs(names: DataFrame, partners: int = PARTNERS, cuts: tuple = CUTS) -> DataFrame:
    """(a, b, lcs) with a < b for all similar distinct names of which at least one is ``cand``.

    ``names`` has distinct ``name`` (token-sorted) and boolean ``cand``.
    """
    sure, rest = _candidates(names.select("name", "cand"), partners, cuts)
    return _with_lcs(sure if rest is None else sure.unionAll(rest), "a", "b").select("a", "b", "lcs")


def spot(place: Column) -> Column:
    """One of 64 bits for a place; all of them where it is not known."""
    bit = F.pmod(F.xxhash64(place), F.lit(64)).cast("int")
    return F.when(place.isNull(), F.lit(ANYWHERE)).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))


def similar_ids(names: DataFrame, partners: int = PARTNERS, cuts: tuple = CUTS) -> DataFrame:
    """(a, b, b_spots) with a < b: ids of the similar names that have a ``spot`` in common.

    ``names`` is as above, with a unique ``id`` and the ``spots`` of its places in one number: names whose places all differ
    make no pair, but for places that happen to have the same bit.
    """
    sure, rest = _candidates(names.select("id", "name", "cand", "spots"), partners, cuts)
    if rest is not None:
        sure = sure.unionAll(_with_lcs(rest, "x", "y").select("a", "b", "b_spots"))
    return sure.distinct()


def _candidates(names: DataFrame, partners: int, cuts: tuple) -> tuple[DataFrame, DataFrame | None]:
    """Pairs that are certain (if they have ids), and pairs to be compared yet, or None."""
    n, l2 = F.length("name"), F.col("l2")
    k = max_edits(n, l2)
    few = _taken(n, l2)[1] <= 2
    lengths = checkpoint(names.select(n.alias("l2")).distinct())
    todo = (
        names.filter(n > 0)
        .select(*_who(names), F.explode(F.sequence(n, _longest(n))).alias("l2"))
        .filter(k > 0)
        .join(F.broadcast(lengths), "l2", "left_semi")
    )
    # where two letters of the longer name may go, its texts are over a hundred and its pieces a few: the cuts come first
    short = (k <= 2) & (_taken(n, l2)[1] <= 1)
    sure, rest = _deletion_matches(todo.filter(short), names, whole=True), None
    todo = todo.filter(~short)
    for step, m in enumerate(cuts):
        if todo.isEmpty():
            break
        last = step == len(cuts) - 1
        if last:
            sure = sure.unionAll(_deletion_matches(todo.filter((k <= 4) & few), names))
            todo = todo.filter((k > 4) | ~few)
        shapes = todo.select(n.alias("l1"), "l2").distinct()
        # only keys that the shorter side asks for are kept of the longer side, before anything is written
        asked = checkpoint(shorter_pieces(todo, m))
        wanted = asked.select("key").distinct()
        b = checkpoint(longer_pieces(names, shapes, m).join(spread(wanted), "key", "left_semi"))
        plan = checkpoint(
            _partners(asked, b).withColumn("done", (F.col("cost") <= partners) | F.lit(last))
        )
        a = plan.filter("done").select(*_who(plan), F.explode("use.key").alias("key"))
        more = _cut_matches(a, b)
        rest = more if rest is None else rest.unionAll(more)
        todo = plan.filter("NOT done").select(*_who(plan), "l2")
    return sure, rest

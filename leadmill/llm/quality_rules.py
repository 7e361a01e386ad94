"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each document is measured; mergeable quantile sketches of the measures per (lang, source) give the limits that
replace fixed cutoffs; the limits are joined back and decide. A (lang, source) pair with fewer than
``MIN_GROUP`` documents takes the limits of its language, whose sketches are merged from those of its sources,
and a small language those of the whole corpus, merged likewise.

Null texts have no words; null lang or source are groups of their own; repeated rows are judged alike, each in
its own row; a measure that ties with its limit is kept; texts are measured whole, however long; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.llm.common import Cuts

#: Fixed values of the base rules.
SPACE = "[\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PCT = 50
#: A limit lies SPREADS spreads beyond the FAR quantile of its group; a spread is the way from the median to that quantile.
FAR = 0.9
SPREADS = 4.0
MIN_GROUP = 200
SKETCH_K = 800
#: measure: (the least step that it can take in a text of MIN_WORDS words, lower side too). A spread is a step at least, so that what
#: a single word, window or line does in a short text is inside. A repeated line is a step of one in the group's median of lines.
MEASURES = {
    "word_len": (0.0, True),
    "symbol_share": (1 / MIN_WORDS, False),
    "dup_line_share": (None, False),
    "repeat_share": (6 / MIN_WORDS, False),
    "exclaim_share": (1 / MIN_WORDS, False),
}
SKETCHED = [*MEASURES, "lines"]


def _repeat_words(words: Column, wins: Column, order: Column) -> Column:
    """Words covered by a window that occurs twice or more. ``order`` holds (window, place), sorted."""
    same = lambda a, b: order[a]["h"] == order[b]["h"]
    last = F.size(order) - 1
    twice = F.filter(F.sequence(F.lit(0), last), lambda j: ((j > 0) & same(F.greatest(j - 1, F.lit(0)), j)) | ((j < last) & same(j, F.least(j + 1, last))))
    covered = F.flatten(F.transform(twice, lambda j: F.array(order[j]["i"], order[j]["i"] + 1, order[j]["i"] + 2)))
    return F.when(F.size(wins) == F.size(F.array_distinct(wins)), F.lit(0)).otherwise(F.size(F.array_distinct(covered)))


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_exclaim of ``text``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(F.col("t"), "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    chars = lambda drop: F.length(F.col("t")) - F.length(F.translate(F.col("t"), drop, ""))
    h = lambda i: F.xxhash64(F.col("w")[i], F.col("w")[i + 1], F.col("w")[i + 2])
    n = F.size("w")
    return (
        docs.select(*keep, text.alias("t"))
        .withColumn("w", F.filter(F.split("t", SPACE, -1), lambda x: x != ""))
        .withColumn("l", lines)
        .withColumn("wins", F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), h)).otherwise(F.array().cast("array<bigint>")))
        .withColumn("order", F.when(F.size("wins") > 0, F.sort_array(F.transform("wins", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
        .select(
            *keep,
            n.cast("bigint").alias("n_words"),
            (F.length("t") - chars(SPACES)).cast("bigint").alias("word_chars"),
            chars(SYMBOLS).cast("bigint").alias("n_symbols"),
            (F.size("l") - F.size(F.array_distinct("l"))).cast("bigint").alias("n_dup_lines"),
            F.when(F.size("wins") == 0, F.lit(0)).otherwise(_repeat_words(F.col("w"), F.col("wins"), F.col("order"))).cast("bigint").alias("n_repeat_words"),
            F.size("l").cast("bigint").alias("n_lines"),
            chars("!").cast("bigint").alias("n_exclaim"),
        )
    )


def shares(measured: DataFrame) -> DataFrame:
    """The measures that get adaptive limits; 0 where there is nothing to divide by."""
    of = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return measured.withColumns({
        "word_len": of("word_chars", "n_words"),
        "symbol_share": of("n_symbols", "n_words"),
        "dup_line_share": of("n_dup_lines", "n_lines"),
        "repeat_share": of("n_repeat_words", "n_words"),
        "exclaim_share": of("n_exclaim", "n_words"),
        "lines": F.col("n_lines").cast("double"),
    })


def limits(rows: DataFrame, cuts: Cuts, spreads: float = SPREADS, min_group: int = MIN_GROUP) -> DataFrame:
    """lang, source and low_/high_ limits of each measure, from sketches of the group or what it belongs to."""
    group = cuts.write(
        rows.groupBy("lang", "source").agg(
            F.count("*").alias("n"), *(F.kll_sketch_agg_double(m, F.lit(SKETCH_K)).alias(m) for m in SKETCHED)
        ),
        "sketches",
    )
    merged = [F.sum("n").alias("n"), *(F.kll_merge_agg_double(m, F.lit(SKETCH_K)).alias(m) for m in SKETCHED)]
    lang, whole = group.groupBy("lang").agg(*merged), group.agg(*merged)

    def bounds(table: DataFrame, keys: list[str], prefix: str) -> DataFrame:
        cols = []
        at = lambda m, p: F.kll_sketch_get_quantile_double(m, F.lit(p))
        for m, (step, _) in MEASURES.items():
            low, mid, high = at(m, 1 - FAR), at(m, 0.5), at(m, FAR)
            step = 1 / F.greatest(at("lines", 0.5), F.lit(1.0)) if step is None else F.lit(step)
            cols.append(F.struct(
                (low - spreads * F.greatest(mid - low, step)).alias("low"), (high + spreads * F.greatest(high - mid, step)).alias("high")
            ).alias(m))
        return table.select(*keys, F.col("n").alias(f"{prefix}_n"), F.struct(*cols).alias(prefix))

    own, of_lang = bounds(group, ["lang", "source"], "own"), bounds(lang, ["lang"], "lng").withColumnRenamed("lang", "l2")
    total = bounds(whole.where("n > 0"), [], "all").first()  # one row of ten numbers; none without documents
    total = total["all"] if total else {m: {"low": None, "high": None} for m in MEASURES}
    of_all = F.struct(*(F.struct(F.lit(total[m]["low"]).cast("double").alias("low"), F.lit(total[m]["high"]).cast("double").alias("high")).alias(m) for m in MEASURES))
    return own.join(of_lang, F.col("lang").eqNullSafe(F.col("l2"))).select(
        "lang", "source",
        F.when(F.col("own_n") >= min_group, F.col("own")).when(F.col("lng_n") >= min_group, F.col("lng")).otherwise(of_all).alias("limit"),
    )


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per document: the base measures, base_failed, and kept by the adaptive limits."""
    cuts = Cuts(docs.sparkSession, "quality-rules")
    src = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].alias("text"), docs[lang].alias("lang"), docs[source].alias("source"))
    rows = shares(cuts.write(measure(src, ["doc_id", "lang", "source"]), "measures"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    bound = cuts.write(limits(rows, cuts), "limits").withColumnsRenamed({"lang": "l2", "source": "s2"})
    inside = F.lit(True)
    for m, (_, both) in MEASURES.items():
        inside &= F.col(m) <= F.col("limit")[m]["high"]
        if both:
            inside &= F.col(m) >= F.col("limit")[m]["low"]
    return (
        rows.join(bound, F.col("lang").eqNullSafe(F.col("l2")) & F.col("source").eqNullSafe(F.col("s2")), "left")
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            failed.alias("base_failed"), (~failed & F.coalesce(inside, F.lit(True))).alias("kept"),
        )
    )

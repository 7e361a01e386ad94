"""Years of phrases that run from one page of a site into the next.

The texts of a site's pages count as one text, page after page with a break between them. Phrases
inside a page are found in the pass over the bodies; those over a border need only the ends of the
pages, so each page sends its first and last characters as one short signal. Pages are numbered
inside their site (a site of any size is split by range) and dealt to blocks of neighbouring
pages, each with the first pages of the next block behind it, so no block grows with the site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill import lexicons as lx
from leadmill.functions import normalize as nz
from leadmill.operators.ranking import ranked

#: Characters of a page that can take part in a phrase over its border: the longest phrase has 162 with white
#: space runs of at most ``RUN``; longer runs count as that many, which changes no year.
EDGE = 512
RUN = 48
#: Pages of a block, and pages of the next block that it sees; a phrase crosses fewer borders than it has characters.
SPAN = 1_024
HALO = 192
#: White space that stands for the border alone; a word character and a control character where a page is cut.
BORDER = "\x0b"
CUT = "_\x01_"
#: How a phrase with a year begins, and the year it ends in.
OPENING = r"(?i)founded|established|est|since|serving|©|&copy;|\(c\)|copyright"
YEAR = r"(?:19|20)\d{2}"


def page_edge(text: Column) -> Column:
    """struct<edge, opens>: what of a page can belong to a phrase over a border, whether one can begin in it.

    A short text is kept whole, as a phrase may run through it. Of others the first characters stay where they
    have a year and the last ones where a phrase can begin.
    """
    plain = F.regexp_replace(F.replace(text, F.lit(BORDER), F.lit(" ")), rf"\s{{{RUN},}}", " " * RUN)
    ends = nz.let(plain, lambda t: F.struct(
        F.when(F.length(t) <= 2 * EDGE, t).alias("whole"), F.substring(t, 1, EDGE).alias("head"), F.right(t, F.lit(EDGE)).alias("tail")
    ))
    marked = nz.let(ends, lambda e: F.struct(e.alias("e"), e["tail"].rlike(OPENING).alias("opens")))

    def edge(m):
        e = m["e"]
        cut = F.concat(F.when(e["head"].rlike(YEAR), e["head"]).otherwise(""), F.lit(CUT), F.when(m["opens"], e["tail"]).otherwise(""))
        return F.struct(F.coalesce(e["whole"], cut).alias("edge"), m["opens"].alias("opens"))

    return nz.let(marked, edge)


def _crossing(kind: str, pattern: str, low: int, high: int) -> Column:
    """Years of matches that hold a border, as (kind, year)."""
    both = F.arrays_zip(
        F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("all"),
        F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("year"),
    )
    found = F.transform(
        F.filter(both, lambda m: F.contains(m["all"], F.lit(BORDER))),
        lambda m: F.struct(F.lit(kind).alias("kind"), m["year"].cast("int").alias("year")),
    )
    return F.filter(found, lambda m: m["year"].between(low, high))


def border_years(edges: DataFrame, this_year: int) -> DataFrame:
    """(domain, seq, kind, year), kind founded or copyright, from (domain, seq, edge, opens), one row a page.

    Pages count in the order of ``seq``; ``seq`` of the result is that of the block's first page. Rows without a
    domain belong to no site. No edges give no rows.
    """
    asked = edges.filter("opens").select("domain").distinct()
    pages = ranked(edges.join(asked, "domain", "left_semi"), ["domain"], [F.col("seq"), F.col("edge")], "no")
    at = F.col("no") - 1
    home = F.floor(at / SPAN)
    blocks = F.when((home > 0) & (at % SPAN < HALO), F.array(home, home - 1)).otherwise(F.array(home))
    texts = (
        pages.select("domain", "seq", "no", "edge", F.explode(blocks).alias("block"))
        .groupBy("domain", "block")
        .agg(F.min("seq").alias("seq"), F.array_sort(F.collect_list(F.struct("no", "edge"))).alias("rows"))
        .withColumn("text", F.array_join(F.transform("rows", lambda r: r["edge"]), BORDER))
    )
    years = F.concat(
        _crossing("founded", lx.FOUNDED, 1850, this_year), _crossing("copyright", lx.COPYRIGHT, 1990, this_year + 1)
    )
    return texts.select("domain", "seq", F.inline(years))

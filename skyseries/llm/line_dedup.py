"""Line dedup by site-relative frequency: lines that too large a share of one host's pages hold are boilerplate.

How large a share is too large depends on the length of the line: a short one recurs by chance, a sentence does not. As
copies of a page share all its sentences, the lower ratios count only where the pages that hold the line differ: more than
half of them have a longest line of their own.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyseries.llm.frames import Written, free_name

#: A line goes if more than this share of its host's pages hold it.
RATIO = 0.1
#: And at least so many of them.
MIN_PAGES = 4
#: Smaller shares for lines of so many characters and more, among pages that differ.
LONGER = {30: 0.01, 200: 0.005}
#: So a host has at most (mean distinct lines of a page) / RATIO boilerplate lines of any kind, whatever its size.
_LINES = "_lines"


def _bare(line):
    """A line counts without white space around it."""
    return F.btrim(line, F.lit(" \t\x0b\x0c\r"))


def _line_hash(line):
    """64 bits per line."""
    return F.xxhash64(_bare(line), F.lit(7))


def _share(length, ratio: float, longer: dict[int, float]):
    """The share of a host's pages above which a line of this length is boilerplate."""
    return reduce(lambda out, at: F.when(length >= at, F.lit(longer[at])).otherwise(out), sorted(longer), F.lit(ratio))


def boilerplate(
    docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, longer: dict[int, float] | None = None
) -> DataFrame:
    """(host, boilerplate): the hashes of each host's boilerplate lines; hosts without any are absent.

    Only a hash and a length per line and page are shuffled, counted on the map side first. Rows count as pages, repeated
    ones too. The few lines that are frequent only for their length are looked up in their pages a second time.
    """
    longer = LONGER if longer is None else longer
    bare = F.transform(F.split(F.col(text_col), "\n"), _bare)
    each = F.transform(bare, lambda x: F.struct(F.xxhash64(x, F.lit(7)).alias("line"), F.length(x).alias("length")))
    pages = docs.select(F.col(host_col).alias("host"), F.array_distinct(each).alias(_LINES))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    held = pages.select("host", F.inline(_LINES)).where("length > 0").groupBy("host", "line").agg(F.count(F.lit(1)).alias("held"), F.max("length").alias("length"))
    # Before the totals are met, what occurs too seldom for any host is gone.
    often = held.where(F.col("held") >= min_pages).alias("l").join(totals.alias("t"), F.expr("l.host <=> t.host"))
    often = often.where(F.col("held") > F.col("pages") * _share(F.col("length"), ratio, longer))
    often = Written(docs.sparkSession, "frequent").put(often.select("l.host", "line", "held", (F.col("held") > F.col("pages") * F.lit(ratio)).alias("sure")))
    lists = often.where("not sure").groupBy("host").agg(F.collect_set("line").alias("asked"))
    longest = F.array_max(F.transform(bare, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))
    texts = docs.select(F.col(host_col).alias("host"), F.transform(bare, lambda x: F.xxhash64(x, F.lit(7))).alias(_LINES), F.xxhash64(longest["x"]).alias("longest"))
    found = texts.alias("d").join(lists.alias("a"), F.expr("d.host <=> a.host")).select("d.host", "longest", F.explode(F.array_intersect(_LINES, "asked")).alias("line"))
    differ = found.groupBy("host", "line").agg(F.count_distinct("longest").alias("differ")).alias("f")
    unsure = often.where("not sure").alias("o").join(differ, F.expr("o.host <=> f.host and o.line = f.line")).where("2 * differ > held").select("o.host", "o.line")
    lines = often.where("sure").select("host", "line").unionByName(unsure)
    return lines.groupBy("host").agg(F.array_sort(F.collect_set("line")).alias("boilerplate"))


def without_boilerplate(
    docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, longer: dict[int, float] | None = None,
    count_col: str | None = None,
) -> DataFrame:
    """``docs`` with the boilerplate lines of each row's host taken out of its text; all rows and columns stay.

    Lines are split at \\n and compared without blanks around them; empty lines are never boilerplate and stay. A null
    text stays null, a null host is a host of its own. ``count_col`` adds the number of lines taken out. Only line hashes
    and the short list per host are joined, never the texts of one host in one task.
    """
    host, found = free_name(docs, "_host"), free_name(docs, "_boilerplate")
    # Written, so that the planner knows its size: few hosts are broadcast, many are joined by shuffle, hot ones split.
    lists = Written(docs.sparkSession, "boilerplate").put(boilerplate(docs, host_col, text_col, ratio, min_pages, longer))
    lists = lists.select(F.col("host").alias(host), F.col("boilerplate").alias(found))
    joined = docs.join(lists, docs[host_col].eqNullSafe(lists[host]), "left")
    lines = F.split(docs[text_col], "\n")
    kept = F.filter(lines, lambda line: ~F.array_contains(found, _line_hash(line)))
    text = F.when(F.col(found).isNull(), docs[text_col]).otherwise(F.array_join(kept, "\n"))
    gone = F.when(F.col(found).isNull() | docs[text_col].isNull(), 0).otherwise(F.size(lines) - F.size(kept)).cast("bigint")
    extra = [] if count_col is None else [gone.alias(count_col)]
    return joined.select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns], *extra)

"""The N highest-scoring items of every group, with a consistent tie rule.

A histogram of each group's scores is built with partial aggregation, in bins
that follow the order of the scores. The highest bin edge above which a group
still has N items is a safe threshold: everything below it can be dropped.
Thresholds are kept for the groups that hold more than one in ``THRESHOLDS``
of all rows. There are at most ``THRESHOLDS`` such groups, whatever the data,
so all tasks get these and filter the rows they read before any shuffle. What
survives is ranked exactly, with the tie keys: each task first ranks the rows
it holds, and N rows of a group at most leave it, so that a group of millions of
equal scores is no heavier than any other.

Defined results: null, NaN and infinite scores are no scores and are left out,
as are rows of no group; a group with fewer than N items gives all of them;
null tie keys come after all others; a group is never cut by the histogram,
only rows that N better ones precede.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of a histogram in each power of two of the score.
BINS_PER_OCTAVE = 8
#: A group with more than one in so many rows has a threshold.
THRESHOLDS = 50_000
#: Parts in which the rows of a group are ranked first where the engine's own limit within tasks doesn't reach so far down.
PARTS = 64


def score_bin(score: Column) -> Column:
    """A whole number that never falls as the score rises: the logarithm of the magnitude in steps, signed."""
    d = score.cast("double")
    size = F.floor(F.log2(F.abs(d)) * BINS_PER_OCTAVE).cast("int") + 20_000
    return F.when(d == 0, F.lit(0)).when(d > 0, size).otherwise(-size)


def thresholds(scored: DataFrame, group: list[str], n: int) -> DataFrame:
    """(group, least): the lowest bin that can hold one of the ``n`` best of each group with more than one in ``THRESHOLDS`` rows of (group, bin)."""
    histogram = scored.groupBy(*group, "bin").agg(F.count(F.lit(1)).alias("n"))
    everything = histogram.agg(F.sum("n")).scalar()
    whole = Window.partitionBy(*group)
    placed = histogram.withColumn("from_top", F.sum("n").over(whole.orderBy(F.desc("bin")))).withColumn("size", F.sum("n").over(whole))
    enough = placed.filter((F.col("size") * THRESHOLDS > everything) & (F.col("from_top") >= n))
    return enough.groupBy(*group).agg(F.max("bin").alias("least"))


def top_n(items: DataFrame, group: list[str], score: str, ties: list[str], n: int) -> DataFrame:
    """The ``n`` rows of each group with the highest score, equal scores by ascending ``ties``.

    The result has the columns of ``items`` and ``rank``, which replaces an input column of that name. Each row travels
    as one value under names of its own, so that no column of ``items`` can clash with them.
    """
    g, t = [f"g{k}" for k in range(len(group))], [f"t{k}" for k in range(len(ties))]
    row = F.struct(*(F.col(f"`{c}`") for c in items.columns if c != "rank"))
    base = items.select(row.alias("item"), *(F.col(f"`{c}`").alias(x) for c, x in zip([*group, *ties], [*g, *t])), F.col(f"`{score}`").alias("v"))
    value = F.col("v").cast("double")
    ok = base.filter(" and ".join(f"{x} is not null" for x in g)).filter(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))).withColumn("bin", score_bin(F.col("v")))
    # at most THRESHOLDS rows, as their groups share all rows among them
    least = F.broadcast(thresholds(ok, g, n))
    kept = ok.join(least, g, "left").filter(F.col("least").isNull() | (F.col("bin") >= F.col("least"))).drop("least", "bin")
    best_first = [F.desc("v"), *(F.asc_nulls_last(x) for x in t)]

    def first(rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*best_first))).filter(F.col("place") <= n)

    if n >= int(items.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        part = F.pmod(F.xxhash64("v", *t), F.lit(PARTS))
        kept = first(kept.withColumn("part", part), [*g, "part"]).drop("place", "part")
    return first(kept, g).select("item.*", F.col("place").alias("rank"))

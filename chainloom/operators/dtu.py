"""Differential transcript usage between two groups of samples.

Group means are over the samples that have a record; a gene's proportions are
compared by a chi-square of the 2 by k table, whose p-value follows from the
Wilson-Hilferty transformation, and corrected by Benjamini and Hochberg. The
correction's ranks are built without one global sort in one task: a rank is the
number of p-values in smaller bins plus the rank in its bin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import chi2_p_value
from ..plans.durable import durable

#: Bins of distinct p-values, between their quantiles, for ranks.
P_BINS = 128


def usage(matched: DataFrame, quant: DataFrame, groups: DataFrame, a: str, b: str) -> DataFrame:
    """(gene_id, transcript_id, mean_a, mean_b, prop_a, prop_b, delta_proportion).

    ``matched`` has (transcript_id, gene_id, segment_id), ``quant`` (segment_id, sample_id, value), ``groups`` (sample_id, sample_group).
    """
    rows = matched.join(quant, "segment_id").join(groups.filter(F.col("sample_group").isin(a, b)), "sample_id")
    mean = rows.groupBy("gene_id", "transcript_id").agg(
        F.coalesce(F.avg(F.when(F.col("sample_group") == a, F.col("value"))), F.lit(0.0)).alias("mean_a"),
        F.coalesce(F.avg(F.when(F.col("sample_group") == b, F.col("value"))), F.lit(0.0)).alias("mean_b"),
    )
    total = mean.groupBy("gene_id").agg(F.sum("mean_a").alias("ta"), F.sum("mean_b").alias("tb"), F.count(F.lit(1)).alias("k"))
    joined = mean.join(total, "gene_id")
    prop = {f"prop_{x}": F.when(F.col(f"t{x}") > 0, F.col(f"mean_{x}") / F.col(f"t{x}")).otherwise(F.lit(0.0)) for x in ("a", "b")}
    return joined.withColumns(prop).withColumn("delta_proportion", F.col("prop_a") - F.col("prop_b"))


def gene_tests(used: DataFrame, exact: bool = False) -> DataFrame:
    """(gene_id, k, chi2, p_value) of genes with at least two transcripts and expression in both groups."""
    grand = F.col("ta") + F.col("tb")
    row = F.col("mean_a") + F.col("mean_b")
    ea, eb = row * F.col("ta") / grand, row * F.col("tb") / grand
    part = F.when(row > 0, F.pow(F.col("mean_a") - ea, 2) / ea + F.pow(F.col("mean_b") - eb, 2) / eb).otherwise(F.lit(0.0))
    ok = used.filter((F.col("k") >= 2) & (F.col("ta") > 0) & (F.col("tb") > 0))
    chi = ok.groupBy("gene_id", "k").agg(F.sum(part).alias("chi2"))
    return chi.withColumn("p_value", chi2_p_value(F.col("chi2"), (F.col("k") - 1).cast("double"), exact))


def corrected(tests: DataFrame, p: str = "p_value", threshold: float = 0.05) -> DataFrame:
    """``tests`` with ``fdr`` (Benjamini-Hochberg) and ``significant``; equal p-values share the largest rank's value.

    Works on the distinct p-values with their counts, so that a value that most genes have is one row, in bins between
    quantiles of them, so that no bin holds more than its part.
    """
    values = durable(tests.filter(F.col(p).isNotNull()).groupBy(F.col(p).alias("__p")).agg(F.count(F.lit(1)).alias("n")))
    edges = values.agg(F.percentile_approx("__p", [k / P_BINS for k in range(1, P_BINS)], 10 * P_BINS)).scalar()
    binned = values.withColumn("__edges", edges).withColumn("__bin", F.size(F.filter("__edges", lambda e: e < F.col("__p")))).drop("__edges")
    # at most P_BINS rows from here
    sizes = binned.groupBy("__bin").agg(F.sum("n").alias("in_bin"))
    smaller = Window.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__bin", F.coalesce(F.sum("in_bin").over(smaller), F.lit(0)).alias("before"), F.sum("in_bin").over(Window.partitionBy()).alias("all"))
    upwards = Window.partitionBy("__bin").orderBy("__p")
    raw = binned.join(F.broadcast(offsets), "__bin").withColumn("__raw", F.col("__p") * F.col("all") / (F.col("before") + F.sum("n").over(upwards)))
    least = raw.groupBy("__bin").agg(F.min("__raw").alias("m"))
    later = Window.orderBy(F.desc("__bin")).rowsBetween(Window.unboundedPreceding, -1)
    tail = least.select("__bin", F.min("m").over(later).alias("__tail"))
    here = F.min("__raw").over(upwards.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    fdr = raw.join(F.broadcast(tail), "__bin").select("__p", F.least(here, F.col("__tail"), F.lit(1.0)).alias("fdr"))
    out = tests.join(fdr, tests[p] == fdr["__p"], "left").drop("__p")
    return out.withColumn("significant", F.col("fdr") <= threshold)

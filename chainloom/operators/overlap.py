"""Joins of overlapping spans, and loci: connected groups of overlapping spans.

``overlap_join`` cuts both sides into bins of fixed width and joins on the bin,
so that neither side must fit in memory and no pair is compared that shares no
bin; a pair that shares several bins comes out in the first of them only. A hot
bin is an equi-join key, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import overlaps

BIN_BITS = 16


def _bins(start: str, end: str) -> Column:
    return F.sequence(F.shiftright(F.col(start), BIN_BITS), F.shiftright(F.col(end), BIN_BITS))


def overlap_join(a: DataFrame, b: DataFrame, on: list[str], a_span: tuple[str, str], b_span: tuple[str, str]) -> DataFrame:
    """Inner join of rows that agree on ``on`` and whose spans overlap; columns of both sides must differ but for ``on``."""
    (a0, a1), (b0, b1) = a_span, b_span
    left = a.filter(F.col(a0) <= F.col(a1)).withColumn("__bin", F.explode(_bins(a0, a1)))
    right = b.filter(F.col(b0) <= F.col(b1)).withColumn("__bin", F.explode(_bins(b0, b1)))
    joined = left.join(right, [*on, "__bin"])
    first = F.greatest(F.shiftright(F.col(a0), BIN_BITS), F.shiftright(F.col(b0), BIN_BITS))
    return joined.filter((F.col("__bin") == first) & overlaps(F.col(a0), F.col(a1), F.col(b0), F.col(b1))).drop("__bin")


def with_any_overlap(a: DataFrame, b: DataFrame, on: list[str], a_span: tuple[str, str], b_span: tuple[str, str], least: int = 0) -> DataFrame:
    """Rows of ``a`` that overlap any row of ``b``, by at least ``least``. A semi-join within bins, which ends at the first hit of a row; no pairs are made."""
    (a0, a1), (b0, b1) = a_span, b_span
    left = a.filter(F.col(a0) <= F.col(a1)).select(*on, F.col(a0).alias("__a0"), F.col(a1).alias("__a1")).distinct()
    binned = left.withColumn("__bin", F.explode(_bins("__a0", "__a1")))
    right = b.filter(F.col(b0) <= F.col(b1)).select(*on, F.col(b0).alias("__b0"), F.col(b1).alias("__b1")).distinct().withColumn("__bin", F.explode(_bins("__b0", "__b1")))
    x, y = binned.alias("x"), right.alias("y")
    same = F.lit(True)
    for c in (*on, "__bin"):
        same = same & (F.col(f"x.{c}") == F.col(f"y.{c}"))
    length = F.least(F.col("x.__a1"), F.col("y.__b1")) - F.greatest(F.col("x.__a0"), F.col("y.__b0"))
    hit = x.join(y, same & (length > 0) & (length >= least), "left_semi").select(*on, F.col("__a0").alias(a0), F.col("__a1").alias(a1)).distinct()
    return a.join(hit, [*on, a0, a1], "left_semi")


def overlap_length(a0: str, a1: str, b0: str, b1: str) -> Column:
    return F.least(F.col(a1), F.col(b1)) - F.greatest(F.col(a0), F.col(b0))


def first_by_span(a: DataFrame, b: DataFrame, on: list[str], b_id: str, a_span: tuple[str, str], b_span: tuple[str, str], order: Callable[[Column, Column], list[Column]], least: int = 0) -> DataFrame:
    """(on, a_span, b_id, overlap): for each distinct span of ``a`` the ``b_id`` of the first overlapping row of ``b``.

    ``order`` takes the overlap and the id. Equal spans of ``b`` are told apart by the id only, so that distinct spans are joined, and no pairs of rows.
    """
    (a0, a1), (b0, b1) = a_span, b_span
    spans = a.select(*on, F.col(a0).alias("__a0"), F.col(a1).alias("__a1")).distinct()
    others = b.groupBy(*on, F.col(b0).alias("__b0"), F.col(b1).alias("__b1")).agg(F.min(b_id).alias("__id"))
    length = overlap_length("__a0", "__a1", "__b0", "__b1")
    pairs = overlap_join(spans, others, on, ("__a0", "__a1"), ("__b0", "__b1")).withColumn("__length", length)
    if least:
        pairs = pairs.filter((F.col("__length") > 0) & (F.col("__length") >= least))
    best = pairs.groupBy(*on, "__a0", "__a1").agg(F.min_by(F.struct("__id", "__length"), F.struct(*order(F.col("__length"), F.col("__id")))).alias("__top"))
    return best.select(*on, F.col("__a0").alias(a0), F.col("__a1").alias(a1), F.col("__top.__id").alias(b_id), F.col("__top.__length").alias("overlap"))


def best_overlap(a: DataFrame, b: DataFrame, on: list[str], a_id: str, b_id: str, a_span: tuple[str, str], b_span: tuple[str, str]) -> DataFrame:
    """``a`` with the ``b_id`` of the longest overlap (ties: smallest ``b_id``), null where none overlaps."""
    best = first_by_span(a, b, on, b_id, a_span, b_span, lambda length, name: [-length, name])
    return a.join(best, [*on, *a_span], "left")


def locus_numbers(spans: DataFrame, on: list[str], start: str, end: str) -> DataFrame:
    """``spans`` with ``locus_start``: spans of one group that overlap or touch, directly or through others, share it.

    Equal spans are merged before they are ordered, and the order is taken within slices of the sequence first:
    a slice's spans are ordered by one task, and only the reach of each slice is ordered over the whole group.
    """
    marked = spans.withColumn("__slice", F.shiftright(F.col(start), 22))
    distinct = marked.select(*on, "__slice", start, end).groupBy(*on, "__slice", start).agg(F.max(end).alias("__end"))
    reach = distinct.groupBy(*on, "__slice").agg(F.max("__end").alias("__reach"))
    earlier = reach.withColumn("__before", F.max("__reach").over(Window.partitionBy(*on).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1))).drop("__reach")
    w = Window.partitionBy(*on, "__slice").orderBy(start)
    inner = distinct.withColumn("__inside", F.max("__end").over(w.rowsBetween(Window.unboundedPreceding, -1))).join(earlier, [*on, "__slice"])
    opens = inner.withColumn("__opens", F.coalesce(F.greatest("__inside", "__before") < F.col(start), F.lit(True)))
    first = F.last(F.when(F.col("__opens"), F.col(start)), ignorenulls=True)
    local = opens.withColumn("__locus", first.over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # a slice without an opening before a span continues the last locus of the slices before it
    last = local.groupBy(*on, "__slice").agg(F.max("__locus").alias("__last"))
    carried = last.withColumn("__carry", F.last("__last", ignorenulls=True).over(Window.partitionBy(*on).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1))).drop("__last")
    loci = local.join(carried, [*on, "__slice"]).select(*on, F.col(start), F.coalesce("__locus", "__carry").alias("locus_start"))
    return spans.join(loci, [*on, start])

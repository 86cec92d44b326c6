"""Unbroken periods and gaps of overlapping intervals, by compressed run bitmaps.

Positions are exact integer units. An interval is cut at shard borders (2^16
units); the whole shards between its two end pieces become one interval in
units of a shard, cut the same way, so that an interval of any length yields
at most seven pieces. The set positions of one entity in one shard form a
compressed bitmap: the sorted disjoint runs as pairs of 16-bit numbers.

Scan tasks union the pieces they read before anything is shuffled; equal
(entity, shard) bitmaps then meet and are united again, batch by batch. Clear
runs inside a shard are read off its bitmap, those between shards come from
the first and last set positions of neighbouring shards.

Defined results: rows with a null entity column or a null bound, or with
start > end, are left out; touching intervals form one period; repeated rows
change nothing; an entity with one period has no gaps; an empty table yields
empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BITS, _TOP = 16, 3
_MASK = (1 << _BITS) - 1
#: Positions of a slice within which one task puts the spans or periods of an entity in order, as a power of two.
SLICE_BITS = 26
#: Pieces a scan task holds before it emits their union.
HELD_PIECES = 400_000


def _piece(level: int, shard: Column, lo: Column, hi: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), shard.alias("shard"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def _pieces(level: int, start: Column, end: Column) -> Column:
    a, b = F.shiftright(start, _BITS), F.shiftright(end, _BITS)
    lo, hi = start.bitwiseAND(F.lit(_MASK).cast("long")), end.bitwiseAND(F.lit(_MASK).cast("long"))
    one = F.array(_piece(level, a, lo, hi))
    if level == _TOP:
        return one
    ends = F.array(_piece(level, a, lo, F.lit(_MASK)), _piece(level, b, F.lit(0), hi))
    middle = F.when(b - a > 1, _pieces(level + 1, a + 1, b - 1)).otherwise(F.slice(one, 1, 0))
    return F.when(a == b, one).otherwise(F.concat(ends, middle))


def _united(group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint, non-touching runs of each group, by group and position."""
    shift = group.astype(np.int64) << (_BITS + 1)
    left, right = shift + lo, shift + hi
    order = np.argsort(left, kind="stable")
    left, right = left[order], np.maximum.accumulate(right[order])
    opens = np.r_[True, left[1:] > right[:-1] + 1]
    at = np.flatnonzero(opens)
    starts, ends = left[at], right[np.r_[at[1:] - 1, len(left) - 1]]
    return starts >> (_BITS + 1), starts & (2 * _MASK + 1), ends & (2 * _MASK + 1)


def _packed(keys: pd.DataFrame, group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pd.DataFrame:
    """One row of ``keys`` and one bitmap for each group, the groups being numbered as the rows of ``keys``."""
    flat = np.stack([lo, hi], axis=1).astype("<u2")
    edges = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(group)]
    out = keys.iloc[group[edges[:-1]]].copy()
    out["runs"] = [flat[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]
    return out


def _numbered(pdf: pd.DataFrame, names: list[str]) -> tuple[np.ndarray, pd.DataFrame]:
    group = pdf.groupby(names, sort=False).ngroup().to_numpy()
    return group, pdf.drop_duplicates(names)[names].reset_index(drop=True)


def _combiner(names: list[str]):
    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def emit() -> pd.DataFrame:
            pdf = pd.concat(held, ignore_index=True)
            group, keys = _numbered(pdf, names)
            return _packed(keys, *_united(group, pdf["lo"].to_numpy(), pdf["hi"].to_numpy()))

        for pdf in batches:
            if len(pdf):
                held.append(pdf)
                n += len(pdf)
            if n >= HELD_PIECES:
                yield emit()
                held, n = [], 0
        if held:
            yield emit()

    return combine


def _unioner(names: list[str]):
    """Union of the sorted bitmaps of each key; the last key of a batch waits for the next one."""

    def rows(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
        group, keys = _numbered(pdf, names)
        flat = np.frombuffer(b"".join(pdf["runs"]), dtype="<u2").reshape(-1, 2).astype(np.int64)
        return keys, *_united(np.repeat(group, pdf["runs"].map(len).to_numpy() // 4), flat[:, 0], flat[:, 1])

    def spans(keys: pd.DataFrame, group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pd.DataFrame:
        """Level 0: a row per shard with its clear runs; higher levels: a row per run."""
        level, shard = keys["level"].to_numpy()[group].astype(np.int64), keys["shard"].to_numpy()[group].astype(np.int64)
        first = ((shard << _BITS) + lo) << (_BITS * level)
        last = (((shard << _BITS) + hi + 1) << (_BITS * level)) - 1
        opens = np.r_[True, (np.diff(group) != 0) | (level[1:] > 0)]
        at = np.flatnonzero(opens)
        until = np.r_[at[1:], len(group)]
        out = keys.iloc[group[at]].drop(columns=["level", "shard"]).copy()
        out["first"], out["last"] = first[at], last[until - 1]
        out["gap_starts"] = [last[a : b - 1] + 1 for a, b in zip(at, until)]
        out["gap_ends"] = [first[a + 1 : b] - 1 for a, b in zip(at, until)]
        return out

    def union(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: pd.DataFrame | None = None
        for pdf in batches:
            if pdf.empty:
                continue
            if waiting is not None:
                pdf = pd.concat([waiting, pdf], ignore_index=True)
            keys, group, lo, hi = rows(pdf)
            done = group < len(keys) - 1
            waiting = _packed(keys, group[~done], lo[~done], hi[~done])
            if done.any():
                yield spans(keys, group[done], lo[done], hi[done])
        if waiting is not None:
            yield spans(*rows(waiting))

    return union


def _spans(intervals: DataFrame, entity: list[str], start: str, end: str) -> DataFrame:
    """(k0, k1, ..., first, last, gap_starts, gap_ends, before): ``before`` is the last set position of all earlier spans.

    The entity's columns are called k0, k1, ... here, so that no name of theirs can clash with the others.
    """
    own = _own(entity)
    names = [*own, "level", "shard"]
    ok = intervals.select(*(F.col(c).alias(k) for c, k in zip(entity, own)), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e")).dropna().filter(F.col("s") <= F.col("e"))
    pieces = ok.select(*own, F.explode(_pieces(0, F.col("s"), F.col("e"))).alias("x")).select(*own, "x.*")
    kept = [pieces.schema[c] for c in names]
    text = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    bitmaps = pieces.mapInPandas(_combiner(names), f"{text}, runs binary")
    met = bitmaps.repartition(*names).sortWithinPartitions(*names)
    key = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept[:-2])
    spans = met.mapInPandas(_unioner(names), f"{key}, first bigint, last bigint, gap_starts array<bigint>, gap_ends array<bigint>")
    # in order within slices of an entity; only one row per slice is ordered over the whole entity
    sliced = spans.withColumn("slice", F.shiftright("first", SLICE_BITS))
    until = Window.unboundedPreceding, -1
    inside = F.max("last").over(Window.partitionBy(*own, "slice").orderBy("first", F.desc("last")).rowsBetween(*until))
    reach = sliced.groupBy(*own, "slice").agg(F.max("last").alias("reach")).withColumn("so_far", F.max("reach").over(Window.partitionBy(*own).orderBy("slice").rowsBetween(*until))).drop("reach")
    return sliced.withColumn("inside", inside).join(reach, [*own, "slice"]).withColumn("before", F.greatest("inside", "so_far")).drop("inside", "so_far", "slice")


def _own(entity: list[str]) -> list[str]:
    return [f"k{n}" for n in range(len(entity))]


def _named(df: DataFrame, entity: list[str]) -> DataFrame:
    return df.withColumnsRenamed(dict(zip(_own(entity), entity)))


def _gaps_of(spans: DataFrame, entity: list[str]) -> DataFrame:
    own = _own(entity)
    covered = F.coalesce(F.col("before") >= F.col("first"), F.lit(False))
    inner = F.when(covered, F.slice("gap_starts", 1, 0)).otherwise(F.col("gap_starts"))
    between = F.when(F.col("before") + 1 < F.col("first"), F.array("before")).otherwise(F.slice(F.array("first"), 1, 0))
    starts = F.concat(F.transform(between, lambda x: x + 1), inner)
    ends = F.concat(F.transform(between, lambda x: F.col("first") - 1), F.when(covered, F.slice("gap_ends", 1, 0)).otherwise(F.col("gap_ends")))
    return spans.select(*own, F.explode(F.arrays_zip(starts.alias("gap_start"), ends.alias("gap_end"))).alias("g")).select(*own, "g.gap_start", "g.gap_end")


def gaps(intervals: DataFrame, entity: list[str], start: str, end: str) -> DataFrame:
    """Every longest run of positions that no interval of the entity covers, with intervals on both sides."""
    return _named(_gaps_of(_spans(intervals, entity, start, end), entity), entity)


def periods(intervals: DataFrame, entity: list[str], start: str, end: str) -> DataFrame:
    """Every longest unbroken run of covered positions: (entity, period_start, period_end)."""
    own = _own(entity)
    spans = _spans(intervals, entity, start, end)
    # a period opens at the first position and after each gap; it closes before the next gap or at the last position
    marks = _gaps_of(spans, entity).select(*own, (F.col("gap_end") + 1).alias("opens"), (F.col("gap_start") - 1).alias("closed"), F.lit(None).cast("long").alias("last"))
    outer = spans.groupBy(*own).agg(F.min("first").alias("opens"), F.lit(None).cast("long").alias("closed"), F.max("last").alias("last"))
    rows = marks.unionByName(outer).withColumn("slice", F.shiftright("opens", SLICE_BITS))
    slices = rows.groupBy(*own, "slice").agg(F.min_by("closed", "opens").alias("first_closed"), F.max("last").alias("last_here"))
    later = Window.partitionBy(*own).orderBy("slice").rowsBetween(1, Window.unboundedFollowing)
    ends = slices.select(*own, "slice", F.coalesce(F.first("first_closed", ignorenulls=True).over(later), F.max("last_here").over(Window.partitionBy(*own))).alias("ends"))
    inside = F.lead("closed").over(Window.partitionBy(*own, "slice").orderBy("opens"))
    whole_rows = rows.withColumn("inside", inside).join(ends, [*own, "slice"]).select(*own, F.col("opens").alias("period_start"), F.coalesce("inside", "ends").alias("period_end"))
    return _named(whole_rows, entity)

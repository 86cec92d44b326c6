"""Sparse expression values by segment and sample: merging, remapping and dropping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import durable


def closure(remap: DataFrame) -> DataFrame:
    """(old_id, new_id) with every chain followed to its end, by pointer doubling.

    ``remap`` has one row per old_id. Rounds grow with the logarithm of the longest chain, whatever its length: no chain
    without a cycle has more steps than there are rows, so what still moves after that many doublings leads into a cycle.
    Such an id has no end and keeps its own ``new_id``; one that maps to itself keeps its place and is left out.
    """
    edges = durable(remap.filter("old_id <> new_id").select("old_id", "new_id"))
    state = edges
    for _ in range(edges.count().bit_length() + 1):
        step = state.select(F.col("old_id").alias("mid"), F.col("new_id").alias("next"))
        after = durable(state.join(step, state["new_id"] == step["mid"], "left").select("old_id", F.coalesce("next", "new_id").alias("new_id"), F.col("next").isNotNull().alias("moved")))
        state = after.drop("moved")
        if after.filter("moved").isEmpty():
            return state
    endless = after.filter("moved").select("old_id").join(edges, "old_id")
    return after.filter("not moved").drop("moved").unionByName(endless)


def merge(quant: DataFrame, remap: DataFrame, dropped: DataFrame) -> DataFrame:
    """(segment_id, sample_id, value): values move to their new segment, dropped ones vanish, duplicates are summed.

    A segment that is both remapped and dropped moves.
    """
    moved = quant.join(remap.withColumnRenamed("old_id", "segment_id"), "segment_id", "left")
    gone = dropped.select("segment_id").distinct().join(remap.select(F.col("old_id").alias("segment_id")), "segment_id", "left_anti")
    kept = moved.join(gone, "segment_id", "left_anti")
    return kept.select(F.coalesce("new_id", "segment_id").alias("segment_id"), "sample_id", "value").groupBy("segment_id", "sample_id").agg(F.sum("value").alias("value"))


def lookup(quant: DataFrame, segment_id: str, sample_ids: list[int] | None = None) -> DataFrame:
    """Values of one segment, of the wanted samples only if any are named; Parquet statistics prune the scan."""
    out = quant.filter(F.col("segment_id") == segment_id)
    return out if sample_ids is None else out.filter(F.col("sample_id").isin(sample_ids))


def save(quant: DataFrame, path: str) -> None:
    """Segment-major files, so that a lookup reads few row groups."""
    quant.repartitionByRange("segment_id").sortWithinPartitions("segment_id", "sample_id").write.mode("overwrite").parquet(path)

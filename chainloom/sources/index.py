"""A stored index: Parquet tables with a version, and its compaction."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
TABLES = ("segments", "segment_exons", "segment_samples", "segment_sources", "transcripts", "samples", "genes", "quant", "decisions", "counters")
PARTITIONED = ("segments", "segment_exons")


def save(tables: dict[str, DataFrame], path: str) -> None:
    """Write the given tables; large ones are split by sequence, so that a region reads its own files."""
    unknown = set(tables) - set(TABLES)
    if unknown:
        raise ValueError(f"not tables of an index: {sorted(unknown)}")
    for name, df in tables.items():
        writer = (df.sortWithinPartitions("start_pos") if name in PARTITIONED else df).write.mode("errorifexists")
        (writer.partitionBy("seqid") if name in PARTITIONED else writer).parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps({"version": VERSION, "tables": sorted(tables)}),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/_meta")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    meta = json.loads(spark.read.text(f"{path}/_meta").first()["value"])
    if meta["version"] != VERSION:
        raise ValueError(f"index version {meta['version']}, expected {VERSION}")
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in meta["tables"]}
    # folder names may look like numbers
    return {name: df.withColumn("seqid", F.col("seqid").cast("string")) if name in PARTITIONED else df for name, df in tables.items()}


def compact(spark: SparkSession, path: str, to: str, with_quant: bool = True) -> None:
    """Copy an index without its absorbed segments."""
    if path.rstrip("/") == to.rstrip("/"):
        raise ValueError("an index cannot be compacted onto itself")
    tables = load(spark, path)
    if with_quant and "quant" not in tables:
        raise ValueError("the index has no quant table")
    dead = tables["segments"].filter(F.coalesce("absorbed", F.lit(False))).select("segment_id")
    out = {}
    for name, df in tables.items():
        if name == "quant" and not with_quant:
            continue
        out[name] = df.join(dead, "segment_id", "left_anti") if "segment_id" in df.columns else df
    save(out, to)


def region(segments: DataFrame, text: str) -> DataFrame:
    """Segments that overlap ``chr:start-end``; the name prunes folders, the bounds prune row groups."""
    from ..functions.scalars import overlaps, parse_region

    seqid, start, end = parse_region(text)
    return segments.filter((F.col("seqid") == seqid) & overlaps(F.col("start_pos"), F.col("end_pos"), F.lit(start), F.lit(end)))

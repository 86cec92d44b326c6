"""Splicing hubs: exons that continue to many different next exons.

An edge leads from an exon to the next one of the same segment, 5' to 3'. All
figures are aggregations of edges with the samples of their segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import Structures
from .summary import EXON

HUB = ["gene_id", *EXON]


def edges(s: Structures) -> DataFrame:
    """(segment_id, gene_id, exon, next_start, next_end) in the direction of transcription."""
    chain = F.when(F.col("strand") == "+", F.col("chain")).otherwise(F.reverse("chain"))
    pairs = F.zip_with(F.slice(chain, F.lit(1), F.size("chain") - 1), F.slice(chain, F.lit(2), F.size("chain") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = s.segments.filter("n_exons > 1").select("segment_id", "gene_id", "seqid", "strand", F.explode(pairs).alias("e"))
    return rows.select("segment_id", "gene_id", "seqid", "strand", F.col("e.a.start_pos").alias("start_pos"), F.col("e.a.end_pos").alias("end_pos"), F.col("e.b.start_pos").alias("next_start"), F.col("e.b.end_pos").alias("next_end"))


def hubs(s: Structures, min_branches: int = 10) -> DataFrame:
    """(gene_id, exon, total_branches, total_transcripts) of exons with at least ``min_branches`` distinct next exons."""
    if min_branches < 2:
        raise ValueError("a hub has at least two branches")
    e = edges(s).join(s.segments.select("segment_id", "n_transcripts"), "segment_id")
    branch = e.groupBy(*HUB, "next_start", "next_end").agg(F.sum("n_transcripts").alias("t"))
    return branch.groupBy(*HUB).agg(F.count(F.lit(1)).alias("total_branches"), F.sum("t").alias("total_transcripts")).filter(F.col("total_branches") >= min_branches)


def hub_samples(s: Structures, min_branches: int = 10) -> DataFrame:
    """Per hub and sample: branches, those shared with others and unique to it, PSI and the entropy of the next exon."""
    kept = edges(s).join(hubs(s, min_branches).select(*HUB), HUB, "left_semi").join(s.segment_samples, "segment_id")
    use = kept.groupBy(*HUB, "next_start", "next_end", "sample_id").agg(F.count(F.lit(1)).alias("n"))
    carriers = use.groupBy(*HUB, "next_start", "next_end").agg(F.count(F.lit(1)).alias("k"))
    rows = use.join(carriers, [*HUB, "next_start", "next_end"])
    # entropy from sums: log2 N - sum(n log2 n) / N
    total = F.sum("n")
    figures = rows.groupBy(*HUB, "sample_id").agg(
        F.count(F.lit(1)).alias("branches"), F.count_if(F.col("k") > 1).alias("shared"), F.count_if(F.col("k") == 1).alias("unique"),
        F.round(F.abs(F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total), 4).alias("entropy"),
    )
    seg = s.segments.select("segment_id", "gene_id").join(s.segment_samples, "segment_id").groupBy("gene_id", "sample_id").agg(F.count(F.lit(1)).alias("all_segments"))
    with_hub = s.segment_exons.select("segment_id", *HUB).join(hubs(s, min_branches).select(*HUB), HUB, "left_semi").join(s.segment_samples, "segment_id").groupBy(*HUB, "sample_id").agg(F.count(F.lit(1)).alias("with_hub"))
    psi = with_hub.join(seg, ["gene_id", "sample_id"]).select(*HUB, "sample_id", F.round(F.col("with_hub") / F.col("all_segments"), 4).alias("psi"))
    return figures.join(psi, [*HUB, "sample_id"])


def branch_details(s: Structures, min_branches: int = 10) -> DataFrame:
    """One row per hub and next exon: segments, samples and summed expression."""
    kept = edges(s).join(hubs(s, min_branches).select(*HUB), HUB, "left_semi")
    on = [*HUB, "next_start", "next_end"]
    segs = kept.groupBy(*on).agg(F.count(F.lit(1)).alias("n_segments"))
    samples = kept.join(s.segment_samples, "segment_id").select(*on, "sample_id").distinct().groupBy(*on).agg(F.count(F.lit(1)).alias("n_samples"))
    value = kept.join(s.quant, "segment_id").groupBy(*on).agg(F.round(F.sum("value"), 3).alias("expression"))
    return segs.join(samples, on, "left").join(value, on, "left").fillna({"n_samples": 0, "expression": 0.0})


def exon_number_of_hub(s: Structures) -> DataFrame:
    """5' to 3' rank of each exon in its segment, with the segment's number of exons."""
    rank = F.when(F.col("strand") == "+", F.col("pos")).otherwise(F.col("n_exons") - F.col("pos") + 1)
    return s.segment_exons.select("segment_id", *EXON, rank.alias("exon_number"), F.col("n_exons").alias("total_exons"))

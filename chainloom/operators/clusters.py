"""Clustering of reads by their junctions, or by their start where they have none.

A cluster has a seed: the first read, by first donor and start, that no cluster
has. Reads of the same sequence, strand and number of junctions join the seed
if all their junctions are within the tolerance of the seed's; single-exon reads
if they start within a distance of the seed's start.

What a read does depends on its junctions (or its start) alone, so the sweep
runs over distinct ones, each with its reads already counted. Sweeps of runs that
are more than the tolerance apart are independent; a group is such a run.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import exons_of_junctions
from ..plans.grouped import fold_groups
from .overlap import locus_numbers


def _text(junctions: str):
    return F.array_join(F.transform(junctions, lambda j: F.concat_ws("-", j["donor"], j["acceptor"])), ",")


def _sweeper(tolerance: int):
    def sweep(key: tuple, rows: Iterable[tuple]) -> Iterator[tuple]:
        """Rows of (place, strand, n_junctions, locus_start, anchor, first_start, shape), sorted by the last three.

        Holds the seeds within the tolerance of the present anchor only: a seed behind it can take no more reads.
        """
        seeds: deque[tuple[int, list, str]] = deque()
        for place, strand, _, _, anchor, _, shape in rows:
            while seeds and anchor > seeds[0][0] + tolerance:
                seeds.popleft()
            js = [tuple(map(int, j.split("-"))) for j in shape.split(",")]
            for _, seed, name in seeds:
                if all(abs(a[0] - b[0]) <= tolerance and abs(a[1] - b[1]) <= tolerance for a, b in zip(seed, js)):
                    break
            else:
                seeds.append((anchor, js, shape))
                name = shape
            yield place, strand, shape, name

    return sweep


def _start_sweeper(distance: int):
    def sweep(key: tuple, rows: Iterable[tuple]) -> Iterator[tuple]:
        seed = None
        for place, strand, _, anchor in rows:
            if seed is None or anchor - seed > distance:
                seed = anchor
            yield place, strand, anchor, str(seed)

    return sweep


def cluster(reads: DataFrame, junction_tolerance: int = 5, single_exon_distance: int = 100, by: tuple[str, ...] = ()) -> DataFrame:
    """``reads`` (read_id, seqid, strand, start_pos, end_pos, junctions, ...) with ``cluster_key``, the seed's key.

    Reads that differ in a column of ``by`` (the sample, say) never share a cluster; all are clustered at once.
    """
    marked = reads.withColumn("n_junctions", F.size("junctions")).withColumn("shape", _text("junctions"))
    # one text for all that keeps reads apart, so that the sweeps needn't know about it
    apart = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by), "seqid")
    marked = marked.withColumn("place", apart)
    group = ["place", "strand", "n_junctions"]
    multi = marked.filter("n_junctions > 0").groupBy(*group, "shape").agg(F.min(F.col("junctions")[0]["donor"]).alias("anchor"), F.min("start_pos").alias("first_start"))
    # runs of first donors without a step beyond the tolerance
    runs = locus_numbers(multi.withColumn("reach", F.col("anchor") + junction_tolerance), group, "anchor", "reach")
    ordered = runs.select(*group, "locus_start", "anchor", "first_start", "shape")
    swept = fold_groups(ordered, [*group, "locus_start"], ["anchor", "first_start", "shape"], _sweeper(junction_tolerance), "place string, strand string, shape string, seed string")
    with_seed = marked.filter("n_junctions > 0").join(swept, ["place", "strand", "shape"])
    single = marked.filter("n_junctions = 0").select("place", "strand", F.col("start_pos").alias("anchor")).distinct()
    single_runs = locus_numbers(single.withColumn("reach", F.col("anchor") + single_exon_distance), ["place", "strand"], "anchor", "reach")
    alone = fold_groups(single_runs.select("place", "strand", "locus_start", "anchor"), ["place", "strand", "locus_start"], ["anchor"], _start_sweeper(single_exon_distance), "place string, strand string, start_pos bigint, seed string")
    without = marked.filter("n_junctions = 0").join(alone, ["place", "strand", "start_pos"])
    both = with_seed.select(*marked.columns, "seed").unionByName(without.select(*marked.columns, "seed"))
    return both.withColumn("cluster_key", F.concat_ws("|", F.translate("place", "\t", "|"), "strand", "n_junctions", "seed")).drop("seed", "shape", "place")


def bounds(clustered: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(cluster_key, cluster_id, seqid, strand, n_junctions, start_pos, end_pos, n_reads) and the columns of ``by``."""
    b = clustered.groupBy("cluster_key", *by, "seqid", "strand", "n_junctions").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.count(F.lit(1)).alias("n_reads"))
    return b.withColumn("cluster_id", F.format_string("%s_%s_%d_%d_n%d", "seqid", "strand", "start_pos", "end_pos", "n_reads"))


def consensus(clustered: DataFrame) -> DataFrame:
    """(cluster_key, junctions): the rounded mean of each junction over the reads of a cluster."""
    each = clustered.filter("n_junctions > 0").select("cluster_key", F.posexplode("junctions").alias("at", "j"))
    mean = each.groupBy("cluster_key", "at").agg(F.floor(F.avg("j.donor") + 0.5).alias("donor"), F.floor(F.avg("j.acceptor") + 0.5).alias("acceptor"))
    # as many rows per cluster as it has junctions
    return mean.groupBy("cluster_key").agg(F.array_sort(F.collect_list(F.struct("at", "donor", "acceptor"))).alias("x")).select("cluster_key", F.transform("x", lambda j: F.struct(j["donor"].alias("donor"), j["acceptor"].alias("acceptor"))).alias("junctions"))


def representatives(clustered: DataFrame) -> DataFrame:
    """(cluster_key, representative_read, mean_mapq): best mapping quality, then longest, then smallest id."""
    best = F.min_by("read_id", F.struct(-F.col("mapq"), F.col("start_pos") - F.col("end_pos"), F.col("read_id")))
    return clustered.groupBy("cluster_key").agg(best.alias("representative_read"), F.avg("mapq").alias("mean_mapq"))


def statistics(clusters: DataFrame) -> DataFrame:
    """One row: clusters, reads, multi- and single-exon clusters, largest and mean size."""
    return clusters.agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("n_reads").alias("reads"), F.count_if(F.col("n_junctions") > 0).alias("multi_exon"), F.count_if(F.col("n_junctions") == 0).alias("single_exon"),
        F.max("n_reads").alias("max_size"), F.round(F.avg("n_reads"), 4).alias("mean_size"),
    )


def as_transcripts(clustered: DataFrame, min_counts: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """Multi-exon clusters as structures: (transcript_id, seqid, strand, start_pos, end_pos, chain, value) and the columns of ``by``."""
    b = bounds(clustered, by).filter((F.col("n_junctions") > 0) & (F.col("n_reads") >= min_counts)).join(consensus(clustered), "cluster_key")
    return b.select(F.col("cluster_id").alias("transcript_id"), *by, "seqid", "strand", "start_pos", "end_pos", exons_of_junctions(F.col("start_pos"), F.col("end_pos"), F.col("junctions")).alias("chain"), F.col("n_reads").cast("double").alias("value"))

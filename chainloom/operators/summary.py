"""Counts over segments: per sample, source, biotype, gene; sharing, conservation and expression.

Sample sets are kept as bridge rows (segment, sample), so every count is an
aggregation with partial results and no row grows with the number of samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import conserved_threshold, entropy_term
from .model import Structures


def n_plain_samples(samples: DataFrame) -> Column:
    """Number of samples of kind ``sample``, as a scalar subquery."""
    return samples.agg(F.count_if(F.col("kind") == "sample")).scalar()


def _with_share_class(bridge: DataFrame, sizes: DataFrame, on: list[str], threshold: Column) -> DataFrame:
    """Bridge rows with n_samples and their class: exclusive, conserved or shared."""
    kind = F.when(F.col("n_samples") == 1, "exclusive").when(F.col("n_samples") >= threshold, "conserved").otherwise("shared")
    return bridge.join(sizes, on).withColumn("share", kind)


def segment_shares(s: Structures, fraction: float = 1.0) -> DataFrame:
    """(segment_id, sample_id, n_samples, share)."""
    sizes = s.segment_samples.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n_samples"))
    return _with_share_class(s.segment_samples, sizes, ["segment_id"], conserved_threshold(n_plain_samples(s.samples), fraction))


def exon_samples(s: Structures) -> DataFrame:
    """Distinct (seqid, strand, start_pos, end_pos, sample_id) over the exons of all segments."""
    return s.segment_exons.select("segment_id", "seqid", "strand", "start_pos", "end_pos").join(s.segment_samples, "segment_id").drop("segment_id").distinct()


EXON = ["seqid", "strand", "start_pos", "end_pos"]


def exon_shares(s: Structures, fraction: float = 1.0) -> DataFrame:
    bridge = exon_samples(s)
    sizes = bridge.groupBy(*EXON).agg(F.count(F.lit(1)).alias("n_samples"))
    return _with_share_class(bridge, sizes, EXON, conserved_threshold(n_plain_samples(s.samples), fraction))


def _class_counts(shares: DataFrame) -> list[Column]:
    return [F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("share") == k).alias(k) for k in ("exclusive", "shared", "conserved"))]


def sharing_per_sample(s: Structures, fraction: float = 1.0) -> DataFrame:
    """(sample_id, total, exclusive, shared, conserved) structures."""
    shares = segment_shares(s, fraction)
    return shares.groupBy("sample_id").agg(*_class_counts(shares))


def exon_sharing_per_sample(s: Structures, fraction: float = 1.0) -> DataFrame:
    shares = exon_shares(s, fraction)
    return shares.groupBy("sample_id").agg(*_class_counts(shares))


def sharing_matrix(per_sample: DataFrame, sample_ids: list[int]) -> DataFrame:
    """Metric by sample: one row per class, one column per listed sample."""
    long = per_sample.unpivot("sample_id", ["total", "exclusive", "shared", "conserved"], "metric", "n")
    return long.groupBy("metric").pivot("sample_id", sample_ids).agg(F.coalesce(F.sum("n"), F.lit(0)))


def gene_segments(s: Structures) -> DataFrame:
    return s.segments.groupBy("gene_id").agg(
        F.count(F.lit(1)).alias("n_segments"), F.sum("n_transcripts").alias("n_transcripts"), F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.count_if(F.col("n_exons") == 1).alias("n_single_exon")
    )


def overview(s: Structures) -> DataFrame:
    """(metric, value): the sixteen figures of an index."""
    seg = s.segments.agg(
        F.count(F.lit(1)).alias("segments"), F.sum("n_transcripts").alias("source_transcript_ids"), F.sum("n_exons").alias("segment_to_exon"), F.sum(F.col("n_exons") - 1).alias("exon_links"),
        F.count_if(F.col("n_exons") == 1).alias("single_exon_segments"), F.avg("n_exons").alias("mean_exons_per_segment"), F.median("n_exons").alias("median_exons_per_segment"), F.max("n_exons").alias("max_exons_per_segment"),
    )
    gene = gene_segments(s).agg(
        F.count(F.lit(1)).alias("genes"), F.count_if(F.col("n_segments") == 1).alias("single_isoform_genes"), F.count_if(F.col("n_segments") > 1).alias("multi_isoform_genes"),
        F.avg("n_segments").alias("mean_segments_per_gene"), F.median("n_segments").alias("median_segments_per_gene"), F.max("n_segments").alias("max_segments_per_gene"),
    )
    exons = s.segment_exons.select(*EXON).distinct().agg(F.count(F.lit(1)).alias("exons"))
    samples = s.samples.agg(F.count(F.lit(1)).alias("samples"))

    def long(df: DataFrame) -> DataFrame:
        return df.select(*(F.round(F.col(c).cast("double"), 2).alias(c) for c in df.columns)).unpivot([], df.columns, "metric", "value")

    return long(seg).unionByName(long(gene)).unionByName(long(exons)).unionByName(long(samples))


def per_sample(s: Structures, fraction: float = 1.0) -> DataFrame:
    """Genes, transcripts touched, segments and single-exon segments of each sample, with the sharing classes."""
    rows = segment_shares(s, fraction).join(s.segments.select("segment_id", "gene_id", "n_exons", "n_transcripts"), "segment_id")
    counts = rows.groupBy("sample_id").agg(*_class_counts(rows), F.sum("n_transcripts").alias("transcripts_touched"), F.count_if(F.col("n_exons") == 1).alias("single_exon_segments"))
    genes = rows.select("sample_id", "gene_id").distinct().groupBy("sample_id").agg(F.count(F.lit(1)).alias("genes"))
    return counts.join(genes, "sample_id").join(s.samples.select("sample_id", "id", "kind"), "sample_id", "left")


def per_source(s: Structures) -> DataFrame:
    """(source, genes, segments, exclusive_segments, exons, exclusive_exons)."""
    seg = s.segment_sources.join(s.segment_sources.groupBy("segment_id").agg(F.count(F.lit(1)).alias("k")), "segment_id").join(s.segments.select("segment_id", "gene_id"), "segment_id")
    a = seg.groupBy("source").agg(F.count(F.lit(1)).alias("segments"), F.count_if(F.col("k") == 1).alias("exclusive_segments"), F.countDistinct("gene_id").alias("genes"))
    ex = s.segment_exons.select("segment_id", *EXON).join(s.segment_sources, "segment_id").select(*EXON, "source").distinct()
    k = ex.groupBy(*EXON).agg(F.count(F.lit(1)).alias("k"))
    b = ex.join(k, EXON).groupBy("source").agg(F.count(F.lit(1)).alias("exons"), F.count_if(F.col("k") == 1).alias("exclusive_exons"))
    return a.join(b, "source")


def biotype_counts(s: Structures) -> DataFrame:
    """(level, biotype, sample_id, n): genes and transcripts by biotype, overall (sample_id null) and per sample."""
    bio = F.coalesce("biotype", F.lit("unknown"))
    tx = s.transcripts.select(bio.alias("biotype"), "sample_id", "gene_id")
    gene = s.transcripts.select("gene_id", "sample_id").join(s.genes.select("gene_id", F.col("gene_biotype").alias("b")), "gene_id", "left").select(F.coalesce("b", F.lit("unknown")).alias("biotype"), "sample_id", "gene_id").distinct()

    def counted(df: DataFrame, level: str, n: Column) -> DataFrame:
        whole = df.groupBy("biotype").agg(n.alias("n")).withColumn("sample_id", F.lit(None).cast("int"))
        each = df.filter("sample_id is not null").groupBy("biotype", "sample_id").agg(n.alias("n"))
        return whole.unionByName(each).select(F.lit(level).alias("level"), "biotype", "sample_id", "n")

    return counted(gene, "gene", F.countDistinct("gene_id")).unionByName(counted(tx, "transcript", F.count(F.lit(1))))


def exon_usage(s: Structures) -> DataFrame:
    """(gene_id, exon, n_with, n_segments): in how many of a gene's segments each of its exons occurs."""
    usage = s.segment_exons.groupBy("gene_id", *EXON).agg(F.count(F.lit(1)).alias("n_with"))
    return usage.join(s.segments.groupBy("gene_id").agg(F.count(F.lit(1)).alias("n_segments")), "gene_id")


def first_visits(s: Structures) -> DataFrame:
    """The first segment, in order of position, that visits each exon: (exon, segment_id, gene_id, pos)."""
    spans = s.segments.select("segment_id", F.col("start_pos").alias("s0"), F.col("end_pos").alias("s1"))
    visits = s.segment_exons.join(spans, "segment_id")
    first = F.min_by(F.struct("segment_id", "gene_id", "pos"), F.struct("s0", "s1", "segment_id", "pos"))
    return visits.groupBy(*EXON).agg(first.alias("v")).select(*EXON, "v.*")


def constitutive_exons(s: Structures) -> DataFrame:
    """(gene_id, constitutive, alternative): each exon judged once, in the gene that visits it first."""
    judged = first_visits(s).join(exon_usage(s), ["gene_id", *EXON])
    return judged.groupBy("gene_id").agg(F.count_if(F.col("n_with") >= F.col("n_segments")).alias("constitutive"), F.count_if(F.col("n_with") < F.col("n_segments")).alias("alternative"))


def gene_diversity(s: Structures) -> DataFrame:
    """(gene_id, n_segments, exon_entropy, effective_isoforms) of genes with at least two segments."""
    usage = exon_usage(s).filter("n_segments >= 2")
    total = usage.groupBy("gene_id").agg(F.sum("n_with").alias("all_uses"))
    entropy = usage.join(total, "gene_id").groupBy("gene_id", "n_segments").agg(F.sum(entropy_term(F.col("n_with") / F.col("all_uses"))).alias("h"))
    weight = s.segments.groupBy("gene_id").agg(F.sum("n_transcripts").alias("t"))
    p = s.segments.join(weight, "gene_id").groupBy("gene_id").agg(F.sum(entropy_term(F.col("n_transcripts") / F.col("t"))).alias("hi"))
    return entropy.join(p, "gene_id").select("gene_id", "n_segments", F.round("h", 6).alias("exon_entropy"), F.round(F.pow(F.lit(2.0), F.col("hi")), 6).alias("effective_isoforms"))


def expression_per_sample(s: Structures) -> DataFrame:
    """(sample_id, total_expression, expressed_segments, mean_expression)."""
    q = s.quant.groupBy("sample_id").agg(F.sum("value").alias("t"), F.count(F.lit(1)).alias("expressed_segments"))
    return q.select("sample_id", F.round("t", 3).alias("total_expression"), "expressed_segments", F.round(F.col("t") / F.col("expressed_segments"), 4).alias("mean_expression"))


def exon_expression(s: Structures) -> DataFrame:
    """(exon, sample_id, value): sum over the segments that contain the exon."""
    return s.segment_exons.select("segment_id", *EXON).join(s.quant, "segment_id").groupBy(*EXON, "sample_id").agg(F.round(F.sum("value"), 3).alias("value"))


def conserved_segments(s: Structures, fraction: float) -> DataFrame:
    """(segment_id, gene_id, coordinate, n_exons, n_transcripts, n_samples, sources) of segments in enough samples."""
    n = s.segment_samples.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n_samples"))
    kept = n.filter(F.col("n_samples") >= conserved_threshold(n_plain_samples(s.samples), fraction))
    sources = s.segment_sources.groupBy("segment_id").agg(F.array_join(F.array_sort(F.collect_set("source")), ";").alias("sources"))
    c = F.format_string("%s:%s:%d-%d", "seqid", "strand", "start_pos", "end_pos")
    return kept.join(s.segments, "segment_id").join(sources, "segment_id", "left").select("segment_id", "gene_id", c.alias("coordinate"), "n_exons", "n_transcripts", "n_samples", F.coalesce("sources", F.lit(".")).alias("sources"))


def conserved_exons(s: Structures, fraction: float) -> DataFrame:
    """(coordinate, gene_id, n_transcripts, n_samples) of exons in enough samples; the gene is the first to visit it."""
    bridge = exon_samples(s).groupBy(*EXON).agg(F.count(F.lit(1)).alias("n_samples"))
    kept = bridge.filter(F.col("n_samples") >= conserved_threshold(n_plain_samples(s.samples), fraction))
    counts = s.segment_exons.join(s.segments.select("segment_id", "n_transcripts"), "segment_id").groupBy(*EXON).agg(F.sum("n_transcripts").alias("n_transcripts"))
    c = F.format_string("%s:%s:%d-%d", "seqid", "strand", "start_pos", "end_pos")
    return kept.join(counts, EXON).join(first_visits(s).select(*EXON, "gene_id"), EXON).select(c.alias("coordinate"), "gene_id", "n_transcripts", "n_samples")


def with_min_samples(s: Structures, least: int) -> DataFrame:
    """Segments seen in an annotation or in at least ``least`` plain samples: (segment_id, n_plain, in_annotation)."""
    kinds = s.segment_samples.join(s.samples.select("sample_id", "kind", "is_annotation"), "sample_id", "left")
    n = kinds.groupBy("segment_id").agg(F.count_if(F.col("kind") == "sample").alias("n_plain"), F.coalesce(F.bool_or("is_annotation"), F.lit(False)).alias("in_annotation"))
    return n.filter(F.col("in_annotation") | (F.col("n_plain") >= least))


def build_summary_by_sequence(s: Structures) -> DataFrame:
    seg = s.segments.groupBy("seqid").agg(F.count(F.lit(1)).alias("segments"), F.countDistinct("gene_id").alias("genes"))
    ex = s.segment_exons.select(*EXON).distinct().groupBy("seqid").agg(F.count(F.lit(1)).alias("exons"))
    return seg.join(ex, "seqid")


def largest_gene(s: Structures) -> DataFrame:
    """The gene with most distinct transcripts; the smallest id of several."""
    g = gene_segments(s)
    return g.agg(F.min_by("gene_id", F.struct(-F.col("n_transcripts"), F.col("gene_id"))).alias("gene_id"), F.max("n_transcripts").alias("n_transcripts"))

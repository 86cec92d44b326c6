"""The tables that all structure operators work on, built from annotation tables.

A transcript's exons form its chain: distinct exons with both positions and
start <= end, ascending, on either strand. Transcripts of one sequence and
strand with equal chains are one segment, whose id is its smallest
transcript_id. Repeated rows change nothing; where rows of one transcript
differ, the smallest non-null value of each column counts. Transcripts without
id, gene key, sequence key, strand or exons are left out.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import gene_key, sequence_key
from ..functions.scalars import structure_key
from ..plans.tables import table

STRANDS = ("+", "-")


def transcript_rows(transcripts: DataFrame) -> DataFrame:
    """One row per transcript_id, without exons."""
    t = transcripts.select(
        "transcript_id", sequence_key(F.col("seqid")).alias("seqid"), "strand", gene_key(F.col("gene_id")).alias("gene_id"), "gene_name",
        F.nullif(F.col("transcript_biotype"), F.lit("")).alias("biotype"), "source", "sample_id", "segment_index",
    ).filter(F.col("transcript_id").isNotNull() & F.col("strand").isin(*STRANDS))
    rest = [c for c in t.columns if c != "transcript_id"]
    one = t.groupBy("transcript_id").agg(*(F.min(c).alias(c) for c in rest))
    return one.dropna(subset=["seqid", "gene_id"])


def exon_rows(exons: DataFrame) -> DataFrame:
    """Distinct usable (transcript_id, start_pos, end_pos), shuffled once for this and for the chains."""
    return exons.select("transcript_id", "start_pos", "end_pos").dropna().filter(F.col("start_pos") <= F.col("end_pos")).repartition("transcript_id").distinct()


def with_chains(transcripts: DataFrame, exons: DataFrame) -> DataFrame:
    """Transcripts with span, n_exons, chain and structure key; those without exons vanish."""
    chains = exons.groupBy("transcript_id").agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos"))).alias("chain"))
    out = transcripts.join(chains, "transcript_id")
    return out.withColumns({
        "start_pos": F.col("chain")[0]["start_pos"],
        "end_pos": F.array_max(F.transform("chain", lambda x: x["end_pos"])),
        "n_exons": F.size("chain").cast("long"),
        "structure": structure_key(F.col("seqid"), F.col("strand"), F.col("chain")),
    })


def segments_of(transcripts: DataFrame, *more: Column) -> DataFrame:
    """Exact structures, named after the smallest transcript that has the structure itself: (segment_id, seqid, strand, start_pos, end_pos, n_exons, gene_id, gene_name, n_transcripts, chain)."""
    keys = ["structure", "seqid", "strand", "start_pos", "end_pos", "n_exons"]
    # transcripts that only joined a segment do not name it, so that a segment keeps its id whatever it takes in
    named = F.coalesce(F.min(F.when(F.col("is_own"), F.col("transcript_id"))), F.min("transcript_id")) if "is_own" in transcripts.columns else F.min("transcript_id")
    return transcripts.groupBy(*keys).agg(
        named.alias("segment_id"), F.min("gene_id").alias("gene_id"), F.min("gene_name").alias("gene_name"), F.count(F.lit(1)).alias("n_transcripts"), F.min("chain").alias("chain"), *more
    )


@dataclass
class Structures:
    """Transcripts and segments with their bridges; each is a lazy DataFrame."""

    transcripts: DataFrame
    samples: DataFrame
    genes: DataFrame
    records: DataFrame | None = None

    def with_tables(self, **known: DataFrame | None) -> Structures:
        """The same with stored tables in place of those that would be derived."""
        self.__dict__.update({name: df for name, df in known.items() if df is not None})
        return self

    @cached_property
    def segments(self) -> DataFrame:
        return segments_of(self.transcripts)

    @cached_property
    def members(self) -> DataFrame:
        """Transcripts with the segment they belong to."""
        return self.transcripts.join(self.segments.select("structure", "segment_id", F.col("gene_id").alias("segment_gene_id")), "structure")

    @cached_property
    def segment_samples(self) -> DataFrame:
        return self.members.select("segment_id", "sample_id").dropna().distinct()

    @cached_property
    def segment_sources(self) -> DataFrame:
        return self.members.select("segment_id", "source").dropna().distinct()

    @cached_property
    def segment_exons(self) -> DataFrame:
        """(segment_id, gene_id, seqid, strand, n_exons, pos, start_pos, end_pos): pos from 1 in genomic order."""
        s = self.segments.select("segment_id", "gene_id", "gene_name", "seqid", "strand", "n_exons", F.posexplode("chain").alias("at", "x"))
        return s.select("segment_id", "gene_id", "gene_name", "seqid", "strand", "n_exons", (F.col("at") + 1).cast("long").alias("pos"), "x.start_pos", "x.end_pos")

    @cached_property
    def quant(self) -> DataFrame:
        """(segment_id, sample_id, value): the records of the segment numbers that a segment's transcripts carry, summed; without records, the transcripts' own values."""
        if self.records is None:
            own = self.members.filter("value is not null and sample_id is not null") if "value" in self.transcripts.columns else self.members.limit(0).withColumn("value", F.lit(0.0))
            return own.groupBy("segment_id", "sample_id").agg(F.sum("value").alias("value"))
        r = self.records.select("segment_index", "sample_id", F.col("value").cast("double").alias("value"))
        ok = r.filter("segment_index is not null and sample_id is not null and value >= 0 and value < double('infinity')").distinct()
        numbers = self.members.select("segment_index", "segment_id").dropna().distinct()
        return ok.join(numbers, "segment_index").groupBy("segment_id", "sample_id").agg(F.sum("value").alias("value"))


def sample_rows(samples: DataFrame) -> DataFrame:
    """Samples with both notions of annotation: strict by type, loose also by a named annotation source or version."""
    kind = F.lower(F.trim(F.coalesce(F.nullif(F.trim("entry_type"), F.lit("")), F.lit("sample"))))
    named = F.coalesce(F.nullif("annotation_source", F.lit("")), F.nullif("annotation_version", F.lit(""))).isNotNull()
    group = F.coalesce(F.col("sample_group"), F.when(kind == "sample", F.regexp_replace("id", "_rep[0-9]+$", "")), F.col("id"))
    out = samples.select("sample_id", "id", kind.alias("kind"), group.alias("sample_group"), "expr_type", "expression_attributes", (kind == "annotation").alias("is_annotation"), ((kind == "annotation") | named).alias("is_annotation_loose"))
    return out.dropDuplicates(["sample_id"])


def gene_rows(genes: DataFrame) -> DataFrame:
    """(gene_id, gene_name, gene_biotype): first non-blank value of each."""
    g = genes.select(gene_key(F.col("gene_id")).alias("gene_id"), F.nullif("gene_name", F.lit("")).alias("gene_name"), F.nullif(F.regexp_replace(F.lower("gene_biotype"), " ", "_"), F.lit("")).alias("gene_biotype"))
    return g.dropna(subset=["gene_id"]).groupBy("gene_id").agg(F.min("gene_name").alias("gene_name"), F.min("gene_biotype").alias("gene_biotype"))


def load(spark: SparkSession, folder: str) -> Structures:
    transcripts = with_chains(transcript_rows(table(spark, folder, "gtf_transcript")), exon_rows(table(spark, folder, "gtf_exon")))
    return Structures(transcripts, sample_rows(table(spark, folder, "sample_info")), gene_rows(table(spark, folder, "gtf_gene")), table(spark, folder, "stream_record"))

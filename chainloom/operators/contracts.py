"""Reports with all the columns their readers expect, one row per thing reported.

Columns per sample are made last, by ``sources.reports.wide``, from the long
tables beside these reports (``exon_expression``, ``quant``, ``event_psi``),
so that nothing grows with the number of samples before it is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import events, summary
from .model import Structures
from .summary import EXON


def judged_exons(s: Structures) -> DataFrame:
    """(exon, gene_id, constitutive): each exon judged once, in the gene that visits it first."""
    rows = summary.first_visits(s).join(summary.exon_usage(s), ["gene_id", *EXON])
    return rows.select(*EXON, "gene_id", (F.col("n_with") >= F.col("n_segments")).alias("constitutive"))


def per_sample(s: Structures, fraction: float = 1.0) -> DataFrame:
    """One row per sample with segments: genes, sharing classes of segments and exons, constitutive and alternative exons, diversity, expression."""
    seg = summary.per_sample(s, fraction).select(
        "sample_id", F.coalesce("id", F.col("sample_id").cast("string")).alias("sample"), F.col("kind").alias("type"), "genes", F.col("total").alias("segments"), *(F.col(c).alias(f"{c}_segments") for c in ("exclusive", "shared", "conserved")), "transcripts_touched", "single_exon_segments",
    )
    ex = summary.exon_sharing_per_sample(s, fraction).select("sample_id", F.col("total").alias("exons"), *(F.col(c).alias(f"{c}_exons") for c in ("exclusive", "shared", "conserved")))
    judged = summary.exon_samples(s).join(judged_exons(s), EXON).groupBy("sample_id").agg(F.count_if("constitutive").alias("constitutive_exons"), F.count_if(~F.col("constitutive")).alias("alternative_exons"))
    genes = s.segments.select("segment_id", "gene_id").join(s.segment_samples, "segment_id").select("sample_id", "gene_id").distinct()
    diverse = genes.join(summary.gene_diversity(s), "gene_id").groupBy("sample_id").agg(F.round(F.avg("exon_entropy"), 3).alias("mean_gene_exon_entropy"), F.round(F.avg("effective_isoforms"), 2).alias("mean_effective_isoforms"))
    value = s.quant.groupBy("sample_id").agg(F.count(F.lit(1)).alias("expressed_segments"), F.round(F.avg("value"), 3).alias("mean_expression"))
    out = seg.join(ex, "sample_id", "left").join(judged, "sample_id", "left").join(diverse, "sample_id", "left").join(value, "sample_id", "left")
    counts = ["exons", "exclusive_exons", "shared_exons", "conserved_exons", "constitutive_exons", "alternative_exons", "expressed_segments"]
    return out.fillna(0, counts).fillna(0.0, ["mean_gene_exon_entropy", "mean_effective_isoforms", "mean_expression"])


def exon_sharing(s: Structures, fraction: float = 1.0) -> DataFrame:
    """(metric, total, sample_id, n): exons of each class, over all and in each sample."""
    shares = summary.exon_shares(s, fraction).join(judged_exons(s).select(*EXON, "constitutive"), EXON, "left")
    judged = F.when(F.col("constitutive"), "constitutive").when(~F.col("constitutive"), "alternative")
    rows = shares.select(*EXON, "sample_id", F.explode(F.array_compact(F.array(F.lit("total"), "share", judged))).alias("metric"))
    each = rows.groupBy("metric", "sample_id").agg(F.count(F.lit(1)).alias("n"))
    # an exon is of one class in all samples, so that it counts once in the total
    whole = rows.select(*EXON, "metric").distinct().groupBy("metric").agg(F.count(F.lit(1)).alias("total"))
    return each.join(whole, "metric").select("metric", "total", "sample_id", "n")


def _named_genes(s: Structures) -> DataFrame:
    return s.genes.select("gene_id", "gene_name", "gene_biotype")


def conserved_segments(s: Structures, fraction: float = 1.0) -> DataFrame:
    """Conserved segments with name and biotype of their gene."""
    rows = summary.conserved_segments(s, fraction).join(s.segments.select("segment_id", F.col("seqid").alias("chromosome")), "segment_id").join(_named_genes(s), "gene_id", "left")
    return rows.select("segment_id", "gene_id", "gene_name", "gene_biotype", "chromosome", "coordinate", F.col("n_exons").alias("exon_count"), "n_transcripts", "n_samples", "sources")


def conserved_exons(s: Structures, fraction: float = 1.0) -> DataFrame:
    """Conserved exons with the name of their gene; an exon is called by its coordinate."""
    rows = summary.conserved_exons(s, fraction).join(_named_genes(s), "gene_id", "left")
    return rows.select(F.col("coordinate").alias("exon_id"), "gene_name", "gene_id", F.regexp_extract("coordinate", "^(.*):[+-]:[0-9]+-[0-9]+$", 1).alias("chromosome"), "coordinate", "n_transcripts", "n_samples")


def _exon(x: str) -> Column:
    return F.concat_ws("-", f"{x}.start_pos", f"{x}.end_pos")


def splicing_events(s: Structures, found: DataFrame | None = None) -> DataFrame:
    """(gene_id, gene_name, event_type, key, chromosome, upstream_exon, downstream_exon, affected_exons): one row per event.

    Flanks are 5' and 3' of the affected exons; events without flanks have none. ``found`` are the rows of ``events.events``, if they are there.
    """
    e = events.events(s) if found is None else found
    at = s.segment_exons.groupBy("gene_id", "start_pos", "end_pos").agg(F.min("seqid").alias("seqid"), F.min("strand").alias("strand"))
    rows = e.join(at, ["gene_id", "start_pos", "end_pos"], "left").groupBy("gene_id", "event_type", "key").agg(
        F.min("seqid").alias("chromosome"), F.min("strand").alias("strand"), F.array_sort(F.collect_set(F.struct("start_pos", "end_pos"))).alias("x")
    )
    flanked, parts = F.col("event_type").isin("cassette_exon", "mutually_exclusive"), F.split("key", r"\|")
    low, high = F.when(flanked, F.get(parts, F.lit(0))), F.when(flanked, F.get(parts, F.lit(1)))
    plus = F.col("strand") == "+"
    exons = F.transform("x", lambda x: F.concat_ws("-", x["start_pos"], x["end_pos"]))
    # the other exon of an exclusive pair stands in its key
    affected = F.array_join(F.when(F.col("event_type") == "mutually_exclusive", F.array_append(exons, F.get(parts, F.lit(2)))).otherwise(exons), ",")
    out = rows.join(s.genes.select("gene_id", "gene_name"), "gene_id", "left")
    return out.select("gene_id", "gene_name", "event_type", "key", "chromosome", F.when(plus, low).otherwise(high).alias("upstream_exon"), F.when(plus, high).otherwise(low).alias("downstream_exon"), affected.alias("affected_exons"))


def queried(s: Structures, found: DataFrame) -> DataFrame:
    """Classified transcripts as a report: names, figures, and in how many samples the segment is."""
    n = s.segment_samples.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n_samples"))
    rows = found.join(n, "segment_id", "left").join(s.genes.select("gene_id", "gene_name"), "gene_id", "left")
    return rows.select(
        F.col("query_id").alias("transcript_id"), "segment_id", "gene_id", "gene_name", F.col("category").alias("structural_category"), "subcategory", F.col("score").alias("junction_match_score"), F.col("n_matched").alias("matching_junctions"), "query_junctions", "ref_junctions",
        "known_donors", "known_acceptors", "novel_donors", "novel_acceptors", F.coalesce("n_samples", F.lit(0)).alias("n_samples"),
    )


def discovered(found: DataFrame, queries: DataFrame, bounds: DataFrame, representatives: DataFrame, novel: DataFrame) -> DataFrame:
    """Clusters as a report: place, class, reference, junctions and those not known, reads and the read that stands for them."""

    def text(donor: Column, acceptor: Column) -> Column:
        return F.concat_ws("-", donor, acceptor)

    own = queries.select("query_id", F.array_join(F.zip_with(F.slice("chain", F.lit(1), F.size("chain") - 1), F.slice("chain", F.lit(2), F.size("chain") - 1), lambda a, b: text(a["end_pos"], b["start_pos"])), ",").alias("junctions"))
    # as many as a cluster has junctions
    new = novel.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list(text(F.col("donor"), F.col("acceptor")))), ",").alias("novel_junctions"))
    place = bounds.join(representatives.select("cluster_key", "representative_read"), "cluster_key", "left").withColumnRenamed("cluster_id", "query_id")
    rows = found.join(place, "query_id").join(own, "query_id", "left").join(new, "query_id", "left")
    return rows.select(
        F.col("query_id").alias("isoform"), F.col("seqid").alias("chrom"), "strand", (F.col("end_pos") - F.col("start_pos")).alias("length"), (F.col("n_junctions") + 1).alias("exons"), F.col("category").alias("structural_category"), "subcategory",
        F.col("gene_id").alias("associated_gene"), F.col("segment_id").alias("associated_transcript"), F.lit(None).cast("long").alias("ref_length"), F.when(F.col("segment_id").isNotNull(), F.col("ref_junctions") + 1).alias("ref_exons"), "junctions", F.col("score").alias("junction_match_score"),
        F.col("n_matched").alias("matching_junctions"), "query_junctions", "ref_junctions", "known_donors", "known_acceptors", "novel_donors", "novel_acceptors", "novel_junctions", F.col("n_reads").alias("read_count"), "representative_read",
    )


def category_table(found: DataFrame) -> DataFrame:
    """(gene_id, category, n, share): how the classified transcripts of each gene are spread over the categories, for heat maps and bars."""
    n = found.filter("gene_id is not null").groupBy("gene_id", "category").agg(F.count(F.lit(1)).alias("n"))
    return n.join(n.groupBy("gene_id").agg(F.sum("n").alias("all_n")), "gene_id").select("gene_id", "category", "n", F.round(F.col("n") / F.col("all_n"), 6).alias("share"))


def fragment_table(found: DataFrame) -> DataFrame:
    """(segment_id, n_fsm, n_ism, ism_fsm_ratio, mean_retained, missing_junctions): full and partial matches of each reference structure, and how much of it the partial ones keep."""
    ism, fsm = F.col("category") == "ISM", F.col("category").isin("FSM", "ambiguous")
    rows = found.filter(ism | fsm).groupBy("segment_id").agg(
        F.count_if(fsm).alias("n_fsm"), F.count_if(ism).alias("n_ism"), F.round(F.avg(F.when(ism, F.col("query_junctions") / F.col("ref_junctions"))), 6).alias("mean_retained"), F.coalesce(F.sum(F.when(ism, F.col("ref_junctions") - F.col("query_junctions"))), F.lit(0)).alias("missing_junctions")
    )
    return rows.withColumn("ism_fsm_ratio", F.when(F.col("n_fsm") > 0, F.round(F.col("n_ism") / F.col("n_fsm"), 6)))

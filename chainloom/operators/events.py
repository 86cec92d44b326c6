"""Alternative splicing events of a gene, from the chains of its segments.

Every event is found by equi-joins on (gene, coordinates) and aggregation; no
pairs of exons or segments are enumerated beyond those that share a flank.
``upstream`` and ``downstream`` are 5' and 3' of the affected exon; events that
have no flanks carry nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import durable
from .model import Structures

#: Positions of a cell in which introns meet exons, as a power of two.
CELL_BITS = 10
_EVENT = ["gene_id", "event_type", "key", "start_pos", "end_pos"]


def placed(s: Structures) -> DataFrame:
    """Exons of segments with their neighbours (genomic order) and whether they are terminal."""
    chain = F.col("chain")
    at = F.transform(chain, lambda x, i: F.struct(x["start_pos"].alias("start_pos"), x["end_pos"].alias("end_pos"), F.get(chain, i - 1).alias("left"), F.get(chain, i + 1).alias("right"), (i + 1).cast("long").alias("pos")))
    rows = s.segments.select("segment_id", "gene_id", "seqid", "strand", "n_exons", F.explode(at).alias("x"))
    return rows.select("segment_id", "gene_id", "seqid", "strand", "n_exons", "x.*", ((F.col("x.pos") == 1) | (F.col("x.pos") == F.col("n_exons"))).alias("terminal"))


def _exon_text(x: Column) -> Column:
    return F.concat_ws("-", x["start_pos"], x["end_pos"])


def _row(kind: str, key: Column) -> list[Column]:
    return [F.lit(kind).alias("event_type"), key.alias("key")]


def cassette(p: DataFrame) -> DataFrame:
    """Exons that some segments include, never at an end, between flanks that another segment joins directly."""
    inner = p.groupBy("gene_id", "seqid", "start_pos", "end_pos").agg(F.bool_or("terminal").alias("t")).filter("not t").drop("t")
    triples = p.filter("not terminal").select("gene_id", "seqid", "start_pos", "end_pos", "left", "right").distinct().join(inner, ["gene_id", "seqid", "start_pos", "end_pos"])
    direct = p.filter("right is not null").select("gene_id", "seqid", F.struct("start_pos", "end_pos").alias("left"), "right").distinct()
    found = triples.join(direct, ["gene_id", "seqid", "left", "right"], "left_semi")
    return found.select("gene_id", *_row("cassette_exon", F.concat_ws("|", _exon_text(F.col("left")), _exon_text(F.col("right")))), "start_pos", "end_pos")


def alternative_sites(p: DataFrame) -> DataFrame:
    """Exons, internal in all segments, that share one boundary and differ in the other."""
    inner = p.groupBy("gene_id", "seqid", "strand", "start_pos", "end_pos").agg(F.bool_or("terminal").alias("t")).filter("not t")

    def side(shared: str, other: str, plus: str, minus: str) -> DataFrame:
        several = inner.groupBy("gene_id", "seqid", "strand", shared).agg(F.countDistinct(other).alias("n")).filter("n >= 2")
        rows = inner.join(several, ["gene_id", "seqid", "strand", shared], "left_semi")
        kind = F.when(F.col("strand") == "+", plus).otherwise(minus)
        return rows.select("gene_id", kind.alias("event_type"), F.concat_ws(":", F.lit(shared), F.col(shared)).alias("key"), "start_pos", "end_pos")

    return side("start_pos", "end_pos", "alt_5prime", "alt_3prime").unionByName(side("end_pos", "start_pos", "alt_3prime", "alt_5prime"))


def intron_retention(p: DataFrame) -> DataFrame:
    """Introns that some segments splice and that lie inside an exon of the same gene."""
    introns = p.filter("right is not null").select("gene_id", "seqid", F.col("end_pos").alias("donor"), F.col("right.start_pos").alias("acceptor")).filter("acceptor > donor").distinct()
    exons = p.select("gene_id", "seqid", "start_pos", "end_pos").distinct()
    # an exon that holds an intron holds its donor: one cell of the intron meets the cells of the exons, in which most of a gene's exons aren't
    at = introns.withColumn("cell", F.shiftright("donor", CELL_BITS))
    over = exons.withColumn("cell", F.explode(F.sequence(F.shiftright("start_pos", CELL_BITS), F.shiftright("end_pos", CELL_BITS))))
    found = at.join(over, ["gene_id", "seqid", "cell"]).filter((F.col("start_pos") <= F.col("donor")) & (F.col("end_pos") >= F.col("acceptor")))
    return found.select("gene_id", *_row("intron_retention", F.concat_ws("-", "donor", "acceptor")), "start_pos", "end_pos")


def alternative_ends(p: DataFrame) -> DataFrame:
    """First and last exons of genes that have several of them; 5' and 3' by strand."""

    def side(at_low: bool, plus: str, minus: str) -> DataFrame:
        ends = p.filter(F.col("pos") == (F.lit(1) if at_low else F.col("n_exons"))).select("gene_id", "seqid", "strand", "start_pos", "end_pos").distinct()
        several = ends.groupBy("gene_id", "seqid", "strand").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        kind = F.when(F.col("strand") == "+", plus).otherwise(minus)
        return ends.join(several, ["gene_id", "seqid", "strand"], "left_semi").select("gene_id", kind.alias("event_type"), F.concat_ws(":", "seqid", "strand").alias("key"), "start_pos", "end_pos")

    return side(True, "alt_first_exon", "alt_last_exon").unionByName(side(False, "alt_last_exon", "alt_first_exon"))


def mutually_exclusive(p: DataFrame) -> DataFrame:
    """Pairs of exons between the same flanks that no segment has both of: one row per pair and flanks."""
    exon = F.struct("start_pos", "end_pos")
    between = p.filter("not terminal").select("gene_id", "seqid", "left", "right", exon.alias("x")).distinct()
    a, b = between.withColumnRenamed("x", "a"), between.withColumnRenamed("x", "b")
    pairs = a.join(b, ["gene_id", "seqid", "left", "right"]).filter(F.col("a") < F.col("b"))
    wanted = pairs.select("gene_id", "a", "b").distinct()
    here = p.select("segment_id", "gene_id", exon.alias("x")).distinct()
    together = wanted.join(here.select("segment_id", "gene_id", F.col("x").alias("a")), ["gene_id", "a"]).join(here.select("segment_id", "gene_id", F.col("x").alias("b")), ["segment_id", "gene_id", "b"]).select("gene_id", "a", "b").distinct()
    found = pairs.join(together, ["gene_id", "a", "b"], "left_anti")
    key = F.concat_ws("|", _exon_text(F.col("left")), _exon_text(F.col("right")), _exon_text(F.col("b")))
    return found.select("gene_id", *_row("mutually_exclusive", key), F.col("a.start_pos").alias("start_pos"), F.col("a.end_pos").alias("end_pos"))


def events(s: Structures) -> DataFrame:
    """(gene_id, event_type, key, start_pos, end_pos): one row per event and affected exon."""
    # read by all six kinds, several times each
    p = durable(placed(s))
    parts = [cassette(p), alternative_sites(p), intron_retention(p), alternative_ends(p), mutually_exclusive(p)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.select(*_EVENT)


def event_types(s: Structures) -> DataFrame:
    """(event_type, n_rows, n_genes, percent)."""
    e = durable(events(s))
    total = e.agg(F.count(F.lit(1))).scalar()
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("gene_id").alias("n_genes")).withColumn("percent", F.round(F.col("n_rows") * 100.0 / total, 4))


def event_psi(s: Structures) -> DataFrame:
    """Per event and sample: segments of the gene in the sample, those with an affected exon, and their share."""
    e = durable(events(s))
    exons = s.segment_exons.select("segment_id", "gene_id", "start_pos", "end_pos").distinct()
    key = ["gene_id", "event_type", "key"]
    touched = e.join(exons, ["gene_id", "start_pos", "end_pos"]).select(*key, "segment_id").distinct()
    included = touched.join(s.segment_samples, "segment_id").groupBy(*key, "sample_id").agg(F.count(F.lit(1)).alias("included"))
    total = s.segments.select("segment_id", "gene_id").join(s.segment_samples, "segment_id").groupBy("gene_id", "sample_id").agg(F.count(F.lit(1)).alias("total"))
    rows = e.select(*key).distinct().join(total, "gene_id").join(included, [*key, "sample_id"], "left").fillna({"included": 0})
    return rows.select(*key, "sample_id", "included", "total", F.round(F.col("included") / F.col("total"), 6).alias("psi"))

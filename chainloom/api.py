"""Building, querying and exporting an index from files.

    index = Index.build(spark, "manifest.tsv", fuzzy_tolerance=5)
    index.save("/shared/index")
    reports = Index.load(spark, "/shared/index").inspect(min_hub_branches=10, with_events=True)

All methods return DataFrames (or dicts of them) and start no job of their own
but where a lineage cut is needed; sinks are in ``sources``.
"""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.keys import gene_key, normalize_name, sequence_key
from .functions.scalars import expression_value, is_main_chromosome, overlaps, parse_contrast, parse_region, structure_key
from .operators import absorb, clusters, contracts, dtu, events, hubs, matcher, model, summary
from .operators.overlap import best_overlap
from .plans.durable import durable
from .sources import bam, files, gtf, index, manifest, sam

log = logging.getLogger(__name__)

_COLUMNS = ["transcript_id", "sample_id", "gene_id", "gene_name", "seqid", "strand", "biotype", "source", "value", "chain", "start_pos", "end_pos", "n_exons", "structure", "segment_index", "block_line", "line_no"]
_BEFORE = "outcome string, n bigint"


def _empty(spark: SparkSession) -> DataFrame:
    chain = "array<struct<start_pos:bigint,end_pos:bigint>>"
    return spark.createDataFrame([], f"transcript_id string, sample_id int, gene_id string, gene_name string, seqid string, strand string, biotype string, source string, value double, chain {chain}, start_pos bigint, end_pos bigint, n_exons bigint, structure string, segment_index bigint, block_line bigint, line_no bigint")


def _placed(df: DataFrame, chromosomes: list[str] | None) -> DataFrame:
    """Rows on a named sequence, of the listed ones if any are; the list may be spelled as freely as the files."""
    out = df.withColumn("seqid", sequence_key(F.col("seqid"))).filter("seqid is not null")
    return out.filter(F.col("seqid").isin([normalize_name(c) for c in chromosomes])) if chromosomes else out


def _kept(df: DataFrame, include_scaffolds: bool, chromosomes: list[str] | None) -> DataFrame:
    out = _placed(df, chromosomes)
    return out if include_scaffolds else out.filter(is_main_chromosome(F.col("seqid")))


def file_headers(spark: SparkSession, paths: list[str]) -> dict[str, dict[str, str]]:
    """What the headers of files say of the columns of a manifest, by the full name of the file (``sources.files.located``)."""
    of_kind = {k: [p for p in paths if manifest.file_kind(p) == k] for k in set(manifest.KINDS.values())}
    out: dict[str, dict[str, str]] = {}
    if of_kind["annotation_text"]:
        found = gtf.headers(gtf.read_lines(spark, of_kind["annotation_text"])).filter(F.col("key").isin(manifest.COLUMNS))
        for r in found.toLocalIterator():
            out.setdefault(r["file_name"], {})[r["key"]] = r["value"]
    text, binary = of_kind["alignment_text"], of_kind["alignment_binary"]
    for lines in ([gtf.read_lines(spark, text)] if text else []) + ([bam.read_lines(spark, binary, records=False)] if binary else []):
        for r in sam.header(lines).toLocalIterator():
            out[r["file_name"]] = {"id": r["sample"], "platform": r["platform"], "pipeline": r["program"], "pipeline_version": r["version"]}
    return out


def sample_rows(spark: SparkSession, samples: str | list[dict | str]) -> list[dict]:
    """Rows of the manifests, rows and bare files that ``samples`` names; cells left open are taken from the header of the file, then by default."""
    rows: list[tuple[dict, bool]] = []
    for x in samples if isinstance(samples, list) else [samples]:
        if isinstance(x, dict):
            rows.append((x, False))
        elif manifest.file_kind(x):
            rows.append(({"file": x}, True))
        else:
            with open(x, encoding="utf-8") as f:
                own, infer = manifest.parse_open(f.read(), os.path.dirname(x))
            rows += [(r, infer) for r in own]
    names = files.located(spark, [r["file"] for r, _ in rows])
    heads = file_headers(spark, sorted(names))
    # files that do not exist are skipped
    return [manifest.completed(manifest.filled(r, heads.get(names[r["file"]], {})), infer) | {"file_name": names[r["file"]]} for r, infer in rows if r["file"] in names]


def annotation_transcripts(spark: SparkSession, paths: list[str], ids: DataFrame, thresholds: dict[str, float], include_scaffolds: bool = False, chromosomes: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Transcripts of GTF or GFF files with chain and value, and (outcome, n) of those left out: ``scaffold`` and ``discarded`` (below a threshold).

    ``ids`` has (file_name, sample_id, expression_attribute).
    """
    placed = _placed(gtf.features(gtf.read_lines(spark, paths)), chromosomes)
    feats = placed if include_scaffolds else placed.filter(is_main_chromosome(F.col("seqid")))
    scaffold = placed.filter((F.col("feature") == "transcript") & F.lit(not include_scaffolds) & ~is_main_chromosome(F.col("seqid"))).join(F.broadcast(ids.select("file_name")), "file_name")
    t, e = gtf.transcripts_and_exons(feats)
    key = F.concat_ws("/", "sample_id", "transcript_id")
    t = t.join(gtf.gene_blocks(feats), ["file_name", "line_no"], "left").join(F.broadcast(ids), "file_name").filter(F.col("strand").isin("+", "-"))
    # the first declared attribute that is there and has a number is the transcript's value; all must reach their threshold
    value = F.transform(F.coalesce("expression_attribute", F.expr("cast(array() as array<string>)")), lambda a: F.struct(a.alias("a"), expression_value(F.try_element_at("attributes", a)).alias("v")))
    t = t.withColumn("found", F.filter(value, lambda x: x["v"].isNotNull()))
    low = F.lit(False)
    if any(v >= 0 for v in thresholds.values()):
        least = F.create_map(*(F.lit(x) for k, v in thresholds.items() if v >= 0 for x in (k, float(v))))
        low = F.exists("found", lambda x: x["v"] < F.coalesce(F.try_element_at(least, x["a"]), F.lit(float("-inf"))))
    t = t.withColumn("low", low)
    one = t.filter("not low").groupBy(key.alias("transcript_id"), "sample_id").agg(
        F.min(gene_key(F.col("gene_id"))).alias("gene_id"), F.min("gene_name").alias("gene_name"), F.min("seqid").alias("seqid"), F.min("strand").alias("strand"), F.min("transcript_biotype").alias("biotype"), F.min("source").alias("source"),
        F.min_by(F.get("found", F.lit(0))["v"], "line_no").alias("value"), F.lit(None).cast("long").alias("segment_index"), F.min("block_line").alias("block_line"), F.min("line_no").cast("long").alias("line_no"),
    )
    ex = model.exon_rows(e.join(F.broadcast(ids.select("file_name", "sample_id")), "file_name").withColumn("transcript_id", key))
    discarded = t.filter("low").select(key.alias("transcript_id")).distinct().join(ex.select("transcript_id").distinct(), "transcript_id", "left_semi")
    before = scaffold.agg(F.count(F.lit(1)).alias("n")).select(F.lit("scaffold").alias("outcome"), "n").unionByName(discarded.agg(F.count(F.lit(1)).alias("n")).select(F.lit("discarded").alias("outcome"), "n"))
    return model.with_chains(one.filter("gene_id is not null"), ex).select(*_COLUMNS), before


def annotation_biotypes(spark: SparkSession, paths: list[str], ids: DataFrame, include_scaffolds: bool = False, chromosomes: list[str] | None = None) -> DataFrame:
    """(gene_id, gene_biotype): the first biotype that the lines of a gene name, by sample and line."""
    named = gtf.gene_biotypes(_kept(gtf.features(gtf.read_lines(spark, paths)), include_scaffolds, chromosomes)).join(F.broadcast(ids.select("file_name", "sample_id")), "file_name")
    return named.groupBy(gene_key(F.col("gene_id")).alias("gene_id")).agg(F.min_by("gene_biotype", F.struct("sample_id", "line_no")).alias("gene_biotype"))


def read_transcripts(spark: SparkSession, paths: list[str], ids: DataFrame, annotated: DataFrame, min_counts: int = 0, min_mapq: int = 0, include_scaffolds: bool = False, chromosomes: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Multi-exon read clusters of SAM or BAM files as transcripts, and (outcome, n) of those left out; their gene is that of the longest overlap in ``annotated``.

    The reads of all files are clustered at once, the sample being part of the key.
    """
    text, binary = [p for p in paths if manifest.file_kind(p) == "alignment_text"], [p for p in paths if manifest.file_kind(p) == "alignment_binary"]
    lines = ([gtf.read_lines(spark, text)] if text else []) + ([bam.read_lines(spark, binary)] if binary else [])
    both = lines[0].unionByName(lines[1]) if len(lines) == 2 else lines[0]
    reads = _placed(sam.reads(both, min_mapq, keep=("file_name",)), chromosomes).join(F.broadcast(ids.select("file_name", "sample_id")), "file_name").drop("file_name")
    by = ("sample_id",)
    found = clusters.as_transcripts(clusters.cluster(reads, by=by), 0, by).withColumn("main", F.lit(include_scaffolds) | is_main_chromosome(F.col("seqid")))
    t = found.filter(F.col("main") & (F.col("value") >= min_counts)).drop("main").withColumn("transcript_id", F.concat_ws("/", "sample_id", "transcript_id"))
    before = found.agg(F.count_if(~F.col("main")).alias("scaffold"), F.count_if(F.col("main") & (F.col("value") < min_counts)).alias("discarded")).unpivot([], ["scaffold", "discarded"], "outcome", "n")
    genes = annotated.select(F.col("transcript_id").alias("ref_id"), "seqid", "strand", F.col("start_pos").alias("r0"), F.col("end_pos").alias("r1"), F.col("gene_id").alias("ref_gene"))
    best = best_overlap(t, genes.drop("ref_gene"), ["seqid", "strand"], "transcript_id", "ref_id", ("start_pos", "end_pos"), ("r0", "r1")).join(genes.select("ref_id", "ref_gene"), "ref_id", "left")
    rows = best.withColumns({
        "gene_id": F.coalesce("ref_gene", F.format_string("novel_%s_%d", "seqid", "start_pos")), "gene_name": F.lit(None).cast("string"),
        "biotype": F.lit("unknown"), "source": F.lit("BAM"), "n_exons": F.size("chain").cast("long"), "structure": structure_key(F.col("seqid"), F.col("strand"), F.col("chain")),
        "segment_index": F.lit(None).cast("long"), "block_line": F.lit(None).cast("long"), "line_no": F.lit(None).cast("long"),
    })
    return rows.select(*_COLUMNS), before


@dataclass
class Index:
    """Structures after absorption, with the decision taken for every input transcript."""

    structures: model.Structures
    decisions: DataFrame | None = None
    #: (outcome, n) as ``operators.absorb.counters`` gives it
    outcomes: DataFrame | None = None
    #: structures that later ones absorbed, with what took them in
    tombstones: DataFrame | None = None

    @classmethod
    def build(
        cls, spark: SparkSession, samples: str | list[dict | str], absorb_structures: bool = True, fuzzy_tolerance: int = 5, annotated_loci_only: bool = False, include_scaffolds: bool = False,
        chromosomes: list[str] | None = None, min_expression: dict[str, float] | None = None, min_counts: int = 0, min_mapq: int = 0, prune_tombstones: bool = False,
    ) -> Index:
        """``samples`` is the path of a manifest or of one annotation or alignment file, or a list of such paths and of rows as ``sources.manifest.parse`` gives them.

        What they leave open is taken from the headers of the files. Files of unknown kinds that a row names and files that
        do not exist are skipped, with a warning. Files are told apart by their whole path.
        """
        rows = sorted(sample_rows(spark, samples), key=lambda r: not (r["type"] == "annotation" or r.get("annotation_source") or r.get("annotation_version")))
        listed = [(n, r) for n, r in enumerate(rows, 1) if manifest.file_kind(r["file"])]
        if not listed:
            raise ValueError("no readable files")
        ids = spark.createDataFrame([(r["file_name"], n, r.get("expression_attribute") or []) for n, r in listed], "file_name string, sample_id int, expression_attribute array<string>")
        told = [c for c in manifest.COLUMNS if c not in ("file", "id", "type", "group", "expression_attribute")]
        fields = ", ".join(f"{c} string" for c in told)
        sample_table = spark.createDataFrame(
            [(n, r["id"], r["type"], r.get("group"), r.get("expression_attribute") or [], r["type"] == "annotation", bool(r["type"] == "annotation" or r.get("annotation_source") or r.get("annotation_version")), *(r.get(c) for c in told)) for n, r in listed],
            f"sample_id int, id string, kind string, sample_group string, expression_attributes array<string>, is_annotation boolean, is_annotation_loose boolean, {fields}",
        )
        thresholds = {k: float(v) for k, v in (min_expression or {}).items()}
        for name in gtf.unused_filters(thresholds, sample_table):
            log.warning("no sample declares %s, its threshold has no effect", name)
        annotations = sorted({r["file"] for _, r in listed if manifest.file_kind(r["file"]) == "annotation_text"})
        alignments = sorted({r["file"] for _, r in listed if manifest.file_kind(r["file"]) != "annotation_text"})
        t, before = _empty(spark), spark.createDataFrame([], _BEFORE)
        if annotations:
            t, before = annotation_transcripts(spark, annotations, ids, thresholds, include_scaffolds, chromosomes)
        if alignments:
            more, left_out = read_transcripts(spark, alignments, ids, t, min_counts, min_mapq, include_scaffolds, chromosomes)
            t, before = t.unionByName(more), before.unionByName(left_out)
        t = durable(t)
        options = absorb.AbsorbOptions(absorb_structures, fuzzy_tolerance, annotated_loci_only)
        decided = durable(absorb.decide(t, sample_table, options))
        decisions = absorb.transcript_decisions(t, decided)
        shapes = t.groupBy(F.col("structure").alias("target")).agg(F.min("chain").alias("chain"))
        taken = t.drop("chain", "gene_id", "start_pos", "end_pos", "n_exons", "block_line", "line_no").join(decided.filter("target is not null").select("structure", "target", "gene_id"), "structure").withColumn("is_own", F.col("structure") == F.col("target")).drop("structure").join(shapes, "target")
        live = taken.withColumnRenamed("target", "structure").withColumns({"start_pos": F.col("chain")[0]["start_pos"], "end_pos": F.array_max(F.transform("chain", lambda x: x["end_pos"])), "n_exons": F.size("chain").cast("long")})
        # read for every report
        live = durable(live)
        genes = t.groupBy("gene_id").agg(F.min("gene_name").alias("gene_name"))
        if annotations:
            genes = genes.join(durable(annotation_biotypes(spark, annotations, ids, include_scaffolds, chromosomes)), "gene_id", "left")
        else:
            genes = genes.withColumn("gene_biotype", F.lit(None).cast("string"))
        built = model.Structures(live, sample_table, genes)
        return cls(built, decisions, absorb.counters(decisions, decided, before), None if prune_tombstones else absorb.tombstones(decided, t))

    def save(self, path: str) -> None:
        """Tables that can be read by other tools and by ``load``; absorbed segments stay among the segments, marked, until the index is compacted."""
        s = self.structures
        segments = s.segments.withColumns({"absorbed": F.lit(False), "absorbed_into": F.lit(None).cast("string")})
        if self.tombstones is not None:
            into = s.segments.select(F.col("structure").alias("absorbed_into"), F.col("segment_id").alias("into_id"))
            gone = self.tombstones.join(into, "absorbed_into", "left").withColumns({"absorbed": F.lit(True), "absorbed_into": F.col("into_id")})
            segments = segments.unionByName(gone.select(*(c for c in segments.columns if c in gone.columns)), allowMissingColumns=True)
        tables = {"segments": segments, "segment_samples": s.segment_samples, "segment_sources": s.segment_sources, "transcripts": s.transcripts, "samples": s.samples, "genes": s.genes, "quant": s.quant}
        index.save(tables | {k: v for k, v in (("decisions", self.decisions), ("counters", self.outcomes)) if v is not None}, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        """The stored tables are used as they are; absorbed segments are not among the live ones."""
        t = index.load(spark, path)
        live, gone = F.coalesce("absorbed", F.lit(False)), ["absorbed", "absorbed_into"]
        s = model.Structures(t["transcripts"], t["samples"], t["genes"]).with_tables(
            segments=t["segments"].filter(~live).drop(*gone), segment_samples=t["segment_samples"], segment_sources=t["segment_sources"], quant=t.get("quant"),
        )
        return cls(s, t.get("decisions"), t.get("counters"), t["segments"].filter(live))

    def counters(self) -> DataFrame:
        """(outcome, n): see ``operators.absorb.counters``."""
        if self.outcomes is None:
            raise ValueError("an index without counters")
        return self.outcomes

    def inspect(self, min_samples: int = 1, conserved_fraction: float = 1.0, min_hub_branches: int = 10, with_events: bool = False) -> dict[str, DataFrame]:
        """All reports in long form. ``min_samples`` keeps segments of annotations or of that many plain samples."""
        s = self.structures
        if min_samples > 1:
            kept = summary.with_min_samples(s, min_samples).select("segment_id")
            s = model.Structures(s.members.join(kept, "segment_id", "left_semi").drop("segment_id", "segment_gene_id"), s.samples, s.genes)
        out = {
            "overview": summary.overview(s), "per_sample": contracts.per_sample(s, conserved_fraction), "per_source": summary.per_source(s), "biotype": summary.biotype_counts(s), "segment_sharing": summary.sharing_per_sample(s, conserved_fraction),
            "exon_sharing": contracts.exon_sharing(s, conserved_fraction), "conserved_segments": contracts.conserved_segments(s, conserved_fraction), "conserved_exons": contracts.conserved_exons(s, conserved_fraction), "exon_expression": summary.exon_expression(s),
            "constitutive_exons": summary.constitutive_exons(s), "gene_diversity": summary.gene_diversity(s), "expression": summary.expression_per_sample(s), "splicing_hubs": hubs.hubs(s, min_hub_branches), "hub_samples": hubs.hub_samples(s, min_hub_branches), "branch_details": hubs.branch_details(s, min_hub_branches),
        }
        if with_events:
            found = durable(events.events(s))
            out |= {"splicing_events": contracts.splicing_events(s, found), "event_psi": events.event_psi(s), "event_types": events.event_types(s)}
        return out

    def query(self, transcripts: DataFrame, options: matcher.MatchOptions = matcher.MatchOptions(), contrasts: list[str] | None = None, fdr: float = 0.05) -> dict[str, DataFrame]:
        """Classify (query_id, seqid, strand, start_pos, end_pos, n_exons, chain), single-exon ones left out, and test usage for each ``a:b``."""
        s = self.structures
        found = matcher.classify(transcripts.filter("n_exons > 1"), s.segments, options)
        out = {"classification": found, "report": contracts.queried(s, found), "summary": matcher.summarise(found), "categories": contracts.category_table(found), "fragments": contracts.fragment_table(found), "presence": found.select("query_id", "segment_id").join(s.segment_samples, "segment_id").join(s.quant, ["segment_id", "sample_id"], "left")}
        for text in contrasts or []:
            a, b = parse_contrast(text)
            hit = found.filter(F.col("segment_id").isNotNull()).select(F.col("query_id").alias("transcript_id"), "gene_id", "segment_id")
            used = dtu.usage(hit, s.quant, s.samples.filter("kind = 'sample'").select("sample_id", "sample_group"), a, b)
            tests = dtu.corrected(dtu.gene_tests(used, exact=True), threshold=fdr)
            out[f"dtu {text}"] = used.join(tests.select("gene_id", "p_value", "fdr", "significant"), "gene_id", "left").select("gene_id", "transcript_id", "prop_a", "prop_b", "delta_proportion", "p_value", "fdr", "significant")
        return out

    def discover(self, reads: DataFrame, options: matcher.MatchOptions = matcher.MatchOptions(), min_novel_support: int = 3) -> dict[str, DataFrame]:
        """Cluster reads, classify the clusters, and count the support of segments. Nothing is stored; ``novel`` are candidates for a rebuild."""
        s = self.structures
        clustered = durable(clusters.cluster(reads, options.junction_tolerance))
        bounds = clusters.bounds(clustered)
        multi = clusters.as_transcripts(clustered)
        single = bounds.filter("n_junctions = 0").select(F.col("cluster_id").alias("transcript_id"), "seqid", "strand", "start_pos", "end_pos", F.array(F.struct("start_pos", "end_pos")).alias("chain"), F.col("n_reads").cast("double").alias("value"))
        q = multi.unionByName(single).withColumnRenamed("transcript_id", "query_id")
        found = matcher.classify(q, s.segments, options)
        weights = q.select("query_id", F.col("value").cast("long").alias("n_reads"))
        best, novel = clusters.representatives(clustered), matcher.novel_junctions(q, s.segments, options)
        report = contracts.discovered(found, q, bounds, best, novel)
        return {"clusters": bounds, "representatives": best, "classification": found, "report": report, "summary": matcher.summarise(found), "novel_junctions": novel, "read_coverage": matcher.read_support(q, s.segments, weights, options), "novel": matcher.novel_segments(found, weights, min_novel_support)}

    def export(self, sample_ids: list[int] | None = None, genes: list[str] | None = None, region: str | None = None, min_samples: int = 1, conserved_fraction: float | None = None, biotypes: list[str] | None = None, sources: list[str] | None = None, headers: bool = True) -> DataFrame:
        """GTF lines of each sample for the segments that pass all filters; write them with ``sources.gtf.write_per_sample``."""
        s = self.structures
        kept = s.segments.select("segment_id", "gene_id", "gene_name", "seqid", "start_pos", "end_pos")
        if region:
            seqid, start, end = parse_region(region)
            kept = kept.filter((F.col("seqid") == seqid) & overlaps(F.col("start_pos"), F.col("end_pos"), F.lit(start), F.lit(end)))
        if genes:
            kept = kept.filter(F.col("gene_id").isin(genes) | F.col("gene_name").isin(genes))
        if biotypes:
            kept = kept.join(s.genes.filter(F.col("gene_biotype").isin(biotypes)).select("gene_id"), "gene_id", "left_semi")
        if sources:
            kept = kept.join(s.segment_sources.filter(F.col("source").isin(sources)).select("segment_id"), "segment_id", "left_semi")
        n = s.segment_samples.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n"))
        if min_samples > 1:
            kept = kept.join(n.filter(F.col("n") >= min_samples).select("segment_id"), "segment_id", "left_semi")
        if conserved_fraction is not None:
            kept = kept.join(summary.conserved_segments(s, conserved_fraction).select("segment_id"), "segment_id", "left_semi")
        members = s.members.join(kept.select("segment_id"), "segment_id", "left_semi").select(F.regexp_replace("transcript_id", "^[0-9]+/", "").alias("name"), "segment_id", "seqid", "strand", "source", "start_pos", "end_pos", "gene_id", "biotype")
        # every transcript of a segment is written for every sample of the segment
        both = members.join(s.segment_samples, "segment_id").withColumnRenamed("name", "transcript_id").distinct()
        if sample_ids:
            both = both.filter(F.col("sample_id").isin(sample_ids))
        lines = gtf.export_lines(both, s.segment_exons, s.genes)
        head = gtf.header_lines(s.samples.join(both.select("sample_id").distinct(), "sample_id", "left_semi"))
        return head.unionByName(lines) if headers else lines

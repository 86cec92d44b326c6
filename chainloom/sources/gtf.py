"""GTF and GFF files: features, headers, and per-sample export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import LOCAL

#: name and value of one attribute, quoted or bare
_PAIR = r'([^\s";=]+)[\s=]+("[^"]*"|[^\s;"]+)'

#: Lines of a file that one task puts in order, as a power of two.
SLICE_BITS = 17

# The columns of a sample that the header of its exported lines names, where they are known.
HEADER_COLUMNS = ("description", "species", "annotation_source", "annotation_version", "assay", "biosample", "platform")


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file_name, line_no, line): lines in file order, numbered from 1; ``file_name`` is the whole path, as ``sources.files.located`` gives it.

    The reader gives the lines of a file in order within a split, and splits in order of their offset; numbers are
    made from both without gathering a file in one task: each split counts its lines, and the counts before it are added.
    """
    raw = spark.read.text(paths).select("_metadata.file_path", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    sizes = raw.groupBy("file_path", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = raw.join(before.drop("n"), ["file_path", "block"])
    return numbered.select(F.regexp_replace("file_path", LOCAL, "file:/").alias("file_name"), (F.col("at") - F.col("first_at") + F.col("before") + 1).cast("int").alias("line_no"), "line")


def gene_blocks(feats: DataFrame) -> DataFrame:
    """(file_name, line_no, block_line) of the lines with a gene: the first line of the run of lines of one gene that a line belongs to.

    A gene that appears again later opens another block. Lines are ordered within slices of a file; only one row per slice
    is ordered over the whole file.
    """
    lines = feats.select("file_name", F.col("line_no").cast("long"), attribute("gene_id").alias("gene_id")).filter("gene_id is not null").withColumn("slice", F.shiftright("line_no", SLICE_BITS))
    slice_ = ["file_name", "slice"]
    within, over_file = Window.partitionBy(*slice_).orderBy("line_no"), Window.partitionBy("file_name").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = lines.groupBy(*slice_).agg(F.max_by("gene_id", "line_no").alias("last_gene"))
    before = ends.withColumn("gene_before", F.last("last_gene", ignorenulls=True).over(over_file)).drop("last_gene")
    marked = lines.join(before, slice_).withColumn("opens", ~F.col("gene_id").eqNullSafe(F.coalesce(F.lag("gene_id").over(within), F.col("gene_before"))))
    own = marked.withColumn("own", F.last(F.when(F.col("opens"), F.col("line_no")), ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    # a slice that opens no block before a line continues the last one of the slices before it
    carried = own.groupBy(*slice_).agg(F.max("own").alias("last_own")).withColumn("carry", F.last("last_own", ignorenulls=True).over(over_file)).drop("last_own")
    return own.join(carried, slice_).select("file_name", "line_no", F.coalesce("own", "carry").alias("block_line"))


def attributes(c: Column) -> Column:
    """Column nine as a map; the first of repeated names counts."""
    names = F.regexp_extract_all(c, F.lit(_PAIR), 1)
    values = F.transform(F.regexp_extract_all(c, F.lit(_PAIR), 2), lambda v: F.btrim(v, F.lit('"')))
    first = F.filter(F.arrays_zip(names.alias("k"), values.alias("v"), F.sequence(F.lit(1), F.greatest(F.size(names), F.lit(1))).alias("i")), lambda x: F.array_position(names, x["k"]) == x["i"])
    return F.map_from_entries(F.transform(first, lambda x: F.struct(x["k"], x["v"])))


def features(lines: DataFrame) -> DataFrame:
    """Feature lines as (file_name, line_no, seqid, source, feature, start_pos, end_pos, strand, attributes); others are skipped."""
    body = lines.filter(~F.col("line").startswith("#")).withColumn("c", F.split("line", "\t")).filter(F.size("c") >= 9)
    return body.select(
        "file_name", "line_no", F.get("c", F.lit(0)).alias("seqid"), F.get("c", F.lit(1)).alias("source"), F.get("c", F.lit(2)).alias("feature"), F.expr("try_cast(regexp_extract(get(c, 3), '^[0-9]+$', 0) as bigint)").alias("start_pos"), F.expr("try_cast(regexp_extract(get(c, 4), '^[0-9]+$', 0) as bigint)").alias("end_pos"),
        F.when(F.get("c", F.lit(6)) == "-", "-").otherwise("+").alias("strand"), attributes(F.get("c", F.lit(8))).alias("attributes"),
    ).dropna(subset=["start_pos", "end_pos"])


def headers(lines: DataFrame) -> DataFrame:
    """(file_name, key, value) of ``##key: value`` lines before the first feature; keys are lower-cased, the last of repeated ones counts."""
    first = lines.filter(~F.col("line").startswith("#")).groupBy("file_name").agg(F.min("line_no").alias("first"))
    meta = lines.filter(F.col("line").rlike(r"^##[^:]+:")).join(first, "file_name", "left").filter(F.col("first").isNull() | (F.col("line_no") < F.col("first")))
    pairs = meta.select("file_name", "line_no", F.lower(F.trim(F.regexp_extract("line", r"^##([^:]+):", 1))).alias("key"), F.trim(F.regexp_extract("line", r"^##[^:]+:(.*)$", 1)).alias("value"))
    return pairs.groupBy("file_name", "key").agg(F.max_by("value", "line_no").alias("value"))


def attribute(*names: str) -> Column:
    """The first non-empty of several attributes."""
    return F.coalesce(*(F.nullif(F.try_element_at("attributes", F.lit(n)), F.lit("")) for n in names))


def transcripts_and_exons(feats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables in the shape of ``operators.model``: transcripts (with expression attributes) and exons of all files."""
    gene, tx = attribute("gene_id"), attribute("transcript_id", "Parent")
    t = feats.filter("feature = 'transcript'").select("file_name", "line_no", "seqid", "source", "strand", gene.alias("gene_id"), attribute("gene_name").alias("gene_name"), attribute("transcript_id").alias("transcript_id"), attribute("transcript_type", "transcript_biotype").alias("transcript_biotype"), "start_pos", "end_pos", "attributes")
    e = feats.filter("feature = 'exon'").select("file_name", "line_no", "seqid", "source", "strand", gene.alias("gene_id"), tx.alias("transcript_id"), "start_pos", "end_pos", F.coalesce(F.expr("try_cast(attributes['exon_number'] as int)"), F.lit(-1)).alias("exon_number"), attribute("ID", "exon_id").alias("exon_id"))
    return t.dropna(subset=["gene_id", "transcript_id"]), e.dropna(subset=["transcript_id"])


def gene_biotypes(feats: DataFrame) -> DataFrame:
    """(file_name, line_no, gene_id, gene_biotype) of the gene, transcript and exon lines that name a biotype of their gene."""
    lines = feats.filter(F.col("feature").isin("gene", "transcript", "exon")).select("file_name", "line_no", attribute("gene_id").alias("gene_id"), attribute("gene_type", "gene_biotype").alias("gene_biotype"))
    return lines.dropna(subset=["gene_id", "gene_biotype"])


def passes_expression(declared: list[str], thresholds: dict[str, float]) -> Column:
    """All declared attributes that a transcript has reach their threshold; negative thresholds are off, missing values pass."""
    from ..functions.scalars import expression_value

    ok = F.lit(True)
    for name in declared:
        least = thresholds.get(name, -1.0)
        if least >= 0:
            value = expression_value(F.try_element_at("attributes", F.lit(name)))
            ok = ok & F.coalesce(value >= least, F.lit(True))
    return ok


def unused_filters(thresholds: dict[str, float], declared: DataFrame) -> list[str]:
    """Active thresholds whose attribute no sample declares."""
    active = [k for k, v in thresholds.items() if v >= 0]
    names = {r["a"] for r in declared.select(F.explode("expression_attributes").alias("a")).filter(F.col("a").isin(active)).distinct().collect()}
    return sorted(k for k in active if k not in names)


def export_lines(members: DataFrame, exons: DataFrame, genes: DataFrame) -> DataFrame:
    """GTF lines of every sample: (sample_id, gene_start, gene_id, tx_start, transcript_id, rank, number, line).

    ``members`` has (transcript_id, sample_id, segment_id, gene_id, seqid, strand, source, start_pos, end_pos, biotype),
    ``exons`` (segment_id, pos, n_exons, start_pos, end_pos). Genes are keyed by gene_id; exon numbers run 5' to 3'.
    """
    m = members.join(genes.select("gene_id", "gene_name", "gene_biotype"), "gene_id", "left")
    bounds = m.groupBy("sample_id", "gene_id", "seqid", "strand").agg(F.min("start_pos").alias("gene_start"), F.max("end_pos").alias("gene_end"), F.max("source").alias("gene_source"), F.max("gene_name").alias("gene_name"), F.max("gene_biotype").alias("gene_biotype"))

    def quoted(*pairs: tuple[str, Column]) -> Column:
        return F.concat_ws(" ", *(F.when(v.isNotNull(), F.concat(F.lit(f'{k} "'), v.cast("string"), F.lit('";'))) for k, v in pairs))

    def line(source: Column, feature: str, start: str, end: str, attrs: Column) -> Column:
        return F.concat_ws("\t", "seqid", source, F.lit(feature), F.col(start).cast("string"), F.col(end).cast("string"), F.lit("."), "strand", F.lit("."), attrs)

    name = [("gene_id", F.col("gene_id")), ("gene_name", F.col("gene_name"))]
    order = ["sample_id", "seqid", "gene_start", "gene_id", "tx_start", "transcript_id", "rank", "number", "line"]
    g = bounds.withColumns({"tx_start": F.lit(-1).cast("long"), "transcript_id": F.lit(""), "rank": F.lit(0), "number": F.lit(0).cast("long")}).withColumn("line", line(F.coalesce("gene_source", F.lit(".")), "gene", "gene_start", "gene_end", quoted(*name, ("gene_biotype", F.col("gene_biotype")))))
    t = m.join(bounds.select("sample_id", "gene_id", "seqid", "strand", "gene_start"), ["sample_id", "gene_id", "seqid", "strand"])
    source = F.coalesce("source", F.lit("."))
    tx = t.withColumns({"tx_start": F.col("start_pos"), "rank": F.lit(1), "number": F.lit(0).cast("long")}).withColumn("line", line(source, "transcript", "start_pos", "end_pos", quoted(*name, ("transcript_id", F.col("transcript_id")), ("transcript_type", F.col("biotype")))))
    number = F.when(F.col("strand") == "+", F.col("pos")).otherwise(F.col("n_exons") - F.col("pos") + 1)
    e = t.withColumn("tx_start", F.col("start_pos")).drop("start_pos", "end_pos").join(exons.select("segment_id", "pos", "n_exons", "start_pos", "end_pos"), "segment_id").withColumns({"rank": F.lit(1), "number": number})
    ex = e.withColumn("line", line(source, "exon", "start_pos", "end_pos", quoted(*name, ("transcript_id", F.col("transcript_id")), ("exon_number", F.col("number")))))
    return g.select(*order).unionByName(tx.select(*order)).unionByName(ex.select(*order))


def header_lines(samples: DataFrame, provider: str = "chainloom") -> DataFrame:
    """Header lines of each sample in the shape of ``export_lines``, before all others; ``samples`` has (sample_id, id, kind) and any of ``HEADER_COLUMNS``."""
    known = [c for c in HEADER_COLUMNS if c in samples.columns]
    named = [F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), F.concat(F.lit(f"##{c}: "), F.col(c))) for c in known]
    top = F.array_compact(F.array(F.lit(f"##provider {provider}"), F.lit("##format GTF"), F.concat(F.lit("##id: "), F.coalesce("id", F.col("sample_id").cast("string"))), F.concat(F.lit("##type: "), F.coalesce("kind", F.lit("sample"))), *named))
    rows = samples.select("sample_id", F.posexplode(top).alias("at", "line"))
    none, start = F.lit(""), F.lit(-1).cast("long")
    return rows.select("sample_id", none.alias("seqid"), start.alias("gene_start"), none.alias("gene_id"), start.alias("tx_start"), none.alias("transcript_id"), F.lit(-1).alias("rank"), F.col("at").cast("long").alias("number"), "line")


def write_per_sample(lines: DataFrame, path: str) -> None:
    """One folder per sample; lines in order within each, also where a large sample takes several files."""
    keys = ["sample_id", "seqid", "gene_start", "gene_id", "tx_start", "transcript_id", "rank", "number"]
    lines.repartitionByRange(*keys).sortWithinPartitions(*keys).select("sample_id", "line").write.mode("overwrite").partitionBy("sample_id").text(path)


def inject_counts(lines: DataFrame, counts: DataFrame, id_attribute: str = "talon_transcript", header: dict[str, str] | None = None) -> DataFrame:
    """Lines whose ``transcript`` features carry ``counts`` of (transcript_id, n); old ``#`` lines go, ``header`` comes first.

    Transcripts without a count get none. Result: (file_name, line_no, line), header lines numbered from 1 - their number.
    """
    body = lines.filter(~F.col("line").startswith("#"))
    cells = body.withColumn("c", F.split("line", "\t"))
    key = F.when(F.get("c", F.lit(2)) == "transcript", F.try_element_at(attributes(F.get("c", F.lit(8))), F.lit(id_attribute)))
    n = counts.groupBy(F.col("transcript_id").alias("__id")).agg(F.sum("n").cast("long").alias("n"))
    keyed = cells.withColumn("__id", key)
    joined = keyed.join(n, "__id", "left")
    out = joined.select("file_name", "line_no", F.when(F.col("n").isNotNull(), F.concat(F.regexp_replace("line", r"[;\s]*$", ""), F.format_string('; counts "%d";', "n"))).otherwise(F.col("line")).alias("line"))
    pairs = list((header or {}).items())
    if not pairs:
        return out
    top = lines.select("file_name").distinct().withColumn("h", F.explode(F.array(*(F.struct(F.lit(k + 1 - len(pairs)).alias("line_no"), F.lit(f"##{a}: {b}").alias("line")) for k, (a, b) in enumerate(pairs)))))
    return out.unionByName(top.select("file_name", F.col("h.line_no").cast("int").alias("line_no"), "h.line"))

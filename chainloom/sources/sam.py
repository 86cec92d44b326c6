"""SAM text: records, headers and the junctions of a CIGAR string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the format.
_OPERATIONS = r"([0-9]+)([MIDNSHP=X])"
_ON_REFERENCE = ("M", "D", "N", "=", "X")
UNMAPPED, REVERSE, SECONDARY, SUPPLEMENTARY = 4, 16, 256, 2048


def cigar_walk(cigar: Column, start: Column) -> Column:
    """Struct (at, junctions): the reference position after the alignment and the skipped stretches."""
    sizes, kinds = F.regexp_extract_all(cigar, F.lit(_OPERATIONS), 1), F.regexp_extract_all(cigar, F.lit(_OPERATIONS), 2)
    ops = F.zip_with(sizes, kinds, lambda n, k: F.struct(n.cast("long").alias("n"), k.alias("k")))
    begin = F.struct(start.alias("at"), F.expr("cast(array() as array<struct<donor:bigint,acceptor:bigint>>)").alias("junctions"))

    def step(acc: Column, op: Column) -> Column:
        moved = F.when(op["k"].isin(*_ON_REFERENCE), acc["at"] + op["n"]).otherwise(acc["at"])
        skipped = F.when(op["k"] == "N", F.array_append(acc["junctions"], F.struct(acc["at"].alias("donor"), moved.alias("acceptor")))).otherwise(acc["junctions"])
        return F.struct(moved.alias("at"), skipped.alias("junctions"))

    return F.aggregate(ops, begin, step)


def reads(lines: DataFrame, min_mapq: int = 0, primary_only: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(read_id, seqid, strand, start_pos, end_pos, mapq, junctions) of mapped records and the columns ``keep`` of their line; start_pos counts from 0."""
    body = lines.filter(~F.col("line").startswith("@")).withColumn("c", F.split("line", "\t")).filter(F.size("c") >= 11)
    flag, pos, mapq = (F.expr(f"try_cast(get(c, {k}) as bigint)") for k in (1, 3, 4))
    rows = body.select(*keep, F.get("c", F.lit(0)).alias("read_id"), flag.alias("flag"), F.get("c", F.lit(2)).alias("seqid"), (pos - 1).alias("start_pos"), mapq.alias("mapq"), F.get("c", F.lit(5)).alias("cigar"))
    rows = rows.filter((F.col("flag").bitwiseAND(UNMAPPED) == 0) & (F.col("cigar") != "*") & (F.col("start_pos") >= 0))
    if primary_only:
        rows = rows.filter(F.col("flag").bitwiseAND(SECONDARY | SUPPLEMENTARY) == 0)
    rows = rows.filter(F.col("mapq") >= min_mapq).withColumn("w", cigar_walk(F.col("cigar"), F.col("start_pos")))
    strand = F.when(F.col("flag").bitwiseAND(REVERSE) != 0, "-").otherwise("+")
    return rows.select(*keep, "read_id", "seqid", strand.alias("strand"), "start_pos", F.col("w.at").alias("end_pos"), "mapq", F.col("w.junctions").alias("junctions"))


def header(lines: DataFrame) -> DataFrame:
    """(file_name, sample, platform, program, version) from @RG and @PG lines; the first of each counts."""

    def tag(name: str) -> Column:
        return F.nullif(F.regexp_extract("line", rf"\t{name}:([^\t]*)", 1), F.lit(""))

    h = lines.filter(F.col("line").startswith("@"))
    rg, pg = F.col("line").startswith("@RG"), F.col("line").startswith("@PG")

    def first(which: Column, name: str) -> Column:
        return F.min_by(F.when(which, tag(name)), F.when(which & tag(name).isNotNull(), F.col("line_no")))

    return h.groupBy("file_name").agg(first(rg, "SM").alias("sample"), first(rg, "PL").alias("platform"), first(pg, "PN").alias("program"), first(pg, "VN").alias("version"))

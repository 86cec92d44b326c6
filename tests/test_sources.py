import json

import pytest
from pyspark.sql import functions as F

from chainloom.functions.scalars import conserved_threshold
from chainloom.operators import model
from chainloom.sources import gtf, index, manifest, reports, sam
from chainloom.streaming import reads as streams

GTF = """##id: s1
##Type: annotation
#comment
##id: s2
chr1\tS\tgene\t3050\t9120\t.\t+\t.\tgene_id "G1"; gene_name "N1";
chr1\tS\ttranscript\t3050\t9120\t.\t+\t.\tgene_id "G1"; transcript_id "T1"; cov "12.5x"; gene_id "late";
chr1\tS\texon\t3050\t3310\t.\t+\t.\tgene_id "G1"; transcript_id "T1"; exon_number "1"; ID "E1"
chr1\tS\texon\t5140\t5405\t.\t+\t.\tgene_id "G1"; transcript_id "T1"; exon_number x;
chr1\tS\texon\t8760\t9120\t.\t+\t.\tgene_id "G1"; Parent "T1"
chr1\tS\texon\t1\t2\t.\t-\t.\tnote "no ids"
##late: header
truncated\tline
"""


def test_gtf_round_trip(spark, tmp_path):
    path = tmp_path / "a.gtf"
    path.write_text(GTF)
    lines = gtf.read_lines(spark, str(path))
    assert [r["line_no"] for r in lines.orderBy("line_no").collect()] == list(range(1, 13))
    heads = {r["key"]: r["value"] for r in gtf.headers(lines).collect()}
    assert heads == {"id": "s2", "type": "annotation"}
    t, e = gtf.transcripts_and_exons(gtf.features(lines))
    assert [r["gene_id"] for r in t.collect()] == ["G1"] and sorted(r["exon_number"] for r in e.collect()) == [-1, -1, 1]
    assert t.filter(gtf.passes_expression(["cov"], {"cov": 12.6})).count() == 0 and t.filter(gtf.passes_expression(["cov", "TPM"], {"cov": 12.5, "TPM": 3.0})).count() == 1
    chained = model.with_chains(t.withColumn("sample_id", F.lit(1)).withColumn("biotype", F.lit(None).cast("string")).drop("start_pos", "end_pos"), model.exon_rows(e))
    s = model.Structures(chained, spark.createDataFrame([], "sample_id int"), spark.createDataFrame([("G1", "N1", None)], "gene_id string, gene_name string, gene_biotype string"))
    out = gtf.export_lines(s.members.select("transcript_id", "sample_id", "segment_id", "gene_id", "seqid", "strand", "source", "start_pos", "end_pos", "biotype"), s.segment_exons, s.genes)
    gtf.write_per_sample(out, str(tmp_path / "out"))
    again = spark.read.text(str(tmp_path / "out" / "sample_id=1")).select(F.lit("b").alias("file_name"), F.lit(1).alias("line_no"), F.col("value").alias("line"))
    feats = sorted((r["feature"], r["start_pos"], r["end_pos"]) for r in gtf.features(again).collect())
    assert feats == [("exon", 3050, 3310), ("exon", 5140, 5405), ("exon", 8760, 9120), ("gene", 3050, 9120), ("transcript", 3050, 9120)]


def test_sam(spark):
    text = ["@HD\tVN:1", "@RG\tID:1\tSM:sam1\tPL:ONT", "@PG\tID:x\tPN:mm2\tVN:2.1"]
    text += [f"{n}\t{flag}\tchr22\t{pos}\t{q}\t{cigar}\t*\t0\t0\tA\t*" for n, flag, pos, q, cigar in [("three", 0, 40_322, 60, "147M913N61M2040N88M755N19M"), ("rev", 16, 11, 60, "5S10M2I3D5N1M2H"), ("sec", 256, 11, 60, "5M"), ("low", 0, 11, 5, "5M"), ("un", 4, 11, 60, "*")]]
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(text)], "file_name string, line_no int, line string")
    out = {r["read_id"]: r for r in sam.reads(lines, min_mapq=10).collect()}
    assert set(out) == {"three", "rev"}
    assert [tuple(j) for j in out["three"]["junctions"]] == [(40_468, 41_381), (41_442, 43_482), (43_570, 44_325)] and out["three"]["end_pos"] == 44_344
    assert out["rev"]["strand"] == "-" and [tuple(j) for j in out["rev"]["junctions"]] == [(23, 28)] and out["rev"]["end_pos"] == 29
    h = sam.header(lines).first()
    assert (h["sample"], h["platform"], h["program"], h["version"]) == ("sam1", "ONT", "mm2", "2.1")


def test_many_names_and_sequences_are_not_cut(spark):
    declared = spark.range(12_000).select(F.array(F.concat(F.lit("a"), F.col("id").cast("string"))).alias("expression_attributes"))
    assert gtf.unused_filters({f"a{k}": 1.0 for k in range(0, 12_000, 8)} | {"b": 1.0, "off": -1.0}, declared) == ["b"]
    by_sequence = spark.range(100_005).select(F.format_string("s%06d", "id").alias("seqid"), *(F.lit(1).alias(c) for c in ("genes", "segments", "exons")))
    text = reports.summary_text(spark.createDataFrame([("m", 1.0)], "metric string, value double"), spark.createDataFrame([("created", 1)], "outcome string, n int"), by_sequence)
    assert text.endswith("s100004\t1\t1\t1\n") and text.count("\t1\t1\t1\n") == 100_005


def test_manifest():
    rows = manifest.parse("# c\n\nFILE\tType\tspecies\texpression_attribute\na_rep2.gtf\tSample\t.\tcov, TPM\n/x/b.bam\t.\tfrog\t.\nc.gtf.gz\tannotation\t\t\n", "/m")
    assert [(r["file"], r["id"], r["type"], r["group"]) for r in rows] == [("/m/a_rep2.gtf", "a_rep2", "sample", "a"), ("/x/b.bam", "b", "sample", "b"), ("/m/c.gtf.gz", "c.gtf", "annotation", None)]
    assert rows[0]["expression_attribute"] == ["cov", "TPM"] and rows[0]["species"] is None and rows[1]["species"] == "frog"
    for text, line in (("id\n", 1), ("file\n.\n", 2), ("file\ttype\na\tb\n", 2)):
        with pytest.raises(ValueError, match=f"line {line}"):
            manifest.parse(text)
    with pytest.raises(ValueError):
        manifest.parse("# nothing\n")
    assert manifest.file_kind("a.GTF.gz") == "annotation_text" and manifest.file_kind("a.txt") is None


def test_index_save_load_compact(spark, tmp_path):
    seg = spark.createDataFrame([("a", "chr1", 10, 50, False), ("b", "chr1", 60, 90, True), ("c", "chr2", 5, 9, False)], "segment_id string, seqid string, start_pos bigint, end_pos bigint, absorbed boolean")
    quant = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 3.0)], "segment_id string, sample_id int, value double")
    old, new = str(tmp_path / "i"), str(tmp_path / "c")
    index.save({"segments": seg, "quant": quant}, old)
    back = index.load(spark, old)
    assert {r["segment_id"] for r in index.region(back["segments"], "chr1:45-60").collect()} == {"a"}
    index.compact(spark, old, new)
    done = index.load(spark, new)
    assert done["segments"].count() == 2 and done["quant"].count() == 1
    with pytest.raises(ValueError):
        index.compact(spark, old, old + "/")
    index.save({"segments": seg}, str(tmp_path / "noq"))
    with pytest.raises(ValueError):
        index.compact(spark, str(tmp_path / "noq"), str(tmp_path / "n2"))
    with pytest.raises(ValueError):
        index.save({"other": seg}, str(tmp_path / "x"))
    meta = tmp_path / "i" / "_meta"
    next(meta.glob("part-*")).write_text(json.dumps({"version": 9, "tables": []}) + "\n")
    for crc in meta.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError):
        index.load(spark, old)


def test_conserved_threshold(spark):
    df = spark.createDataFrame([(0,), (3,), (10,)], "n int")
    assert [r[0] for r in df.select(conserved_threshold(F.col("n"), 0.75)).collect()] == [1, 3, 8]
    with pytest.raises(ValueError):
        conserved_threshold(F.col("n"), 0.0)


def test_stream_matches_batch(spark, tmp_path):
    schema = "segment_index bigint, sample_id int, value float, made_at timestamp, loaded_at timestamp"
    src = "/root/testdata/sf0.001/stream_record.parquet"
    spark.read.parquet(src).selectExpr("segment_index", "sample_id", "value", "cast(made_at as timestamp) made_at", "cast(loaded_at as timestamp) loaded_at").repartition(4).write.parquet(str(tmp_path / "in"))
    df = streams.record_sums(streams.stream(spark, str(tmp_path / "in"), schema), lateness="400 days")
    q = df.writeStream.format("memory").queryName("sums").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.sql("select sum(n_records) n, round(sum(value), 2) v from sums").first()
    want = spark.read.parquet(src).filter("segment_index is not null and value >= 0 and value < double('infinity')").select("segment_index", "sample_id", "made_at", "value").distinct().selectExpr("count(*) n", "round(sum(cast(value as double)), 2) v").first()
    assert (got["n"], got["v"]) == (want["n"], want["v"])

import gzip
import struct

import pytest
from pyspark.sql import functions as F

from chainloom.api import Index, sample_rows
from chainloom.sources import bam, gtf, index, reports, sam
from chainloom.operators.matcher import MatchOptions

P4 = [(2100, 2260), (3400, 3710), (5020, 5290), (7750, 8200)]


def gtf_text(items, header=""):
    """items: (transcript, gene, chain, attributes)"""
    out = header
    for t, g, chain, extra in items:
        base = f'gene_id "{g}"; transcript_id "{t}";'
        out += f"chr1\tS\ttranscript\t{chain[0][0]}\t{chain[-1][1]}\t.\t+\t.\t{base} {extra}\n"
        out += "".join(f"chr1\tS\texon\t{s}\t{e}\t.\t+\t.\t{base}\n" for s, e in chain)
    return out


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    (d / "anno.gtf").write_text(gtf_text([("A1", "G1", P4, "")]) + 'GL1\tS\ttranscript\t1\t9\t.\t+\t.\tgene_id "X"; transcript_id "X";\nGL1\tS\texon\t1\t9\t.\t+\t.\tgene_id "X"; transcript_id "X";\n')
    (d / "s_rep1.gtf").write_text(gtf_text([("T1", "M1", P4[1:], 'counts "10";'), ("T2", "M2", [P4[0], P4[2]], 'counts "4";'), ("T3", "M3", P4, 'counts "1";')]))
    (d / "s_rep2.gtf").write_text(gtf_text([("T1", "N1", P4, 'counts "20";'), ("T9", "N2", [(12_000, 12_460)], 'counts "50";')]))
    text = "file\ttype\texpression_attribute\nanno.gtf\tannotation\t.\ns_rep1.gtf\tsample\tcounts\ns_rep2.gtf\tsample\tcounts\n"
    (d / "m.tsv").write_text(text)
    return Index.build(spark, str(d / "m.tsv"), min_expression={"counts": 2.0}), d


def test_build(built):
    ix, _ = built
    assert {r["outcome"]: r["n"] for r in ix.counters().collect()} == {"input": 6, "merged": 2, "absorbed": 0, "discarded": 2, "scaffold": 1}
    segs = {r["n_exons"]: r for r in ix.structures.segments.collect()}
    assert set(segs) == {4, 2} and segs[2]["gene_id"] == "G1"
    assert {(r["sample_id"], r["value"]) for r in ix.structures.quant.join(ix.structures.segments.filter("n_exons = 4"), "segment_id").collect()} == {(2, 10.0), (3, 20.0)}


def test_save_load_inspect_export(spark, built, tmp_path):
    ix, _ = built
    ix.save(str(tmp_path / "ix"))
    back = Index.load(spark, str(tmp_path / "ix"))
    reports_ = back.inspect(conserved_fraction=1.0, min_hub_branches=2, with_events=True)
    assert {r["metric"]: r["value"] for r in reports_["overview"].collect()}["segments"] == 2
    assert reports_["splicing_hubs"].count() == 1
    assert {r["event_type"] for r in reports_["splicing_events"].collect()} == {"cassette_exon", "alt_last_exon"}
    assert reports_["conserved_segments"].count() == 1
    lines = back.export(sample_ids=[3], conserved_fraction=1.0)
    assert {r["sample_id"] for r in lines.collect()} == {3} and lines.filter("rank >= 0").count() == 1 + 2 * 5
    assert [r["line"] for r in lines.filter("rank < 0").orderBy("number").collect()] == ["##provider chainloom", "##format GTF", "##id: s_rep2", "##type: sample"]
    assert back.export(region="chr1:1-900").count() == 0 and back.export(genes=["G1"], sources=["S"], min_samples=3).count() > 0
    index.compact(spark, str(tmp_path / "ix"), str(tmp_path / "c"))
    assert Index.load(spark, str(tmp_path / "c")).structures.segments.count() == 2
    reports.write_tsv(reports_["overview"], str(tmp_path / "t"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).count() == 16
    from chainloom.operators import summary

    text = reports.summary_text(reports_["overview"], ix.counters(), summary.build_summary_by_sequence(back.structures))
    assert "input\t6" in text and "chr1\t1\t2" in text
    w = reports.wide(back.structures.quant, ["segment_id"], [F.sum("value").alias("v")], [(2, "s_rep1"), (3, "s_rep2")])
    assert w.columns == ["segment_id", "s_rep1", "s_rep2"]
    assert sorted(map(tuple, back.counters().collect())) == sorted(map(tuple, ix.counters().collect()))


def test_query_and_contrast(spark, built):
    ix, _ = built
    chain = "array<struct<start_pos:bigint,end_pos:bigint>>"
    q = spark.createDataFrame([("q1", "chr1", "+", 2100, 8200, 4, P4), ("q2", "chr1", "+", 3400, 8200, 3, P4[1:]), ("q3", "chr1", "+", 1, 9, 1, [(1, 9)])], f"query_id string, seqid string, strand string, start_pos bigint, end_pos bigint, n_exons bigint, chain {chain}")
    out = ix.query(q, contrasts=["s:other"])
    assert {r["query_id"]: r["category"] for r in out["classification"].collect()} == {"q1": "FSM", "q2": "ISM"}
    assert out["dtu s:other"].count() == 2


def write_bam(path, records):
    name = b"chr1\0"
    body = b"BAM\1" + struct.pack("<i", 8) + b"@HD\tVN:1" + struct.pack("<i", 1) + struct.pack("<i", len(name)) + name + struct.pack("<i", 10**6)
    for qname, flag, pos, mapq, cigar in records:
        q = qname.encode() + b"\0"
        data = struct.pack("<iiBBHHHiiii", 0, pos, len(q), mapq, 0, len(cigar), flag, 0, -1, -1, 0) + q + b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(k)) for n, k in cigar)
        body += struct.pack("<i", len(data)) + data
    with open(path, "wb") as f:  # several members, as in a block-compressed file
        for k in range(0, len(body), 50):
            f.write(gzip.compress(body[k : k + 50]))


def test_bam_reads_discover_and_build(spark, built, tmp_path):
    ix, d = built
    skip = [(160, "M"), (1140, "N"), (310, "M"), (1310, "N"), (270, "M"), (2460, "N"), (450, "M")]
    novel = [(160, "M"), (1140, "N"), (510, "M"), (1110, "N"), (270, "M"), (2460, "N"), (450, "M")]
    records = [(f"r{k}", 0, 2100 + k % 2, 60, skip) for k in range(5)] + [(f"n{k}", 0, 2100, 60, novel) for k in range(3)] + [("one", 0, 30_000, 60, [(500, "M")])]
    path = str(tmp_path / "x.bam")
    write_bam(path, records)
    reads = sam.reads(bam.read_lines(spark, [path]))
    assert reads.count() == 9
    out = ix.discover(reads, MatchOptions())
    got = {r["category"]: r["n"] for r in out["summary"].groupBy("category").agg(F.sum("n").alias("n")).collect()}
    assert got == {"FSM": 1, "NNC": 1, "intergenic": 1}
    assert [r["read_coverage"] for r in out["read_coverage"].collect()] == [5] and out["novel"].count() == 1
    report = {r["structural_category"]: r for r in out["report"].collect()}
    assert set(report) == set(got) and report["FSM"]["read_count"] == 5 and report["FSM"]["junctions"] == "2260-3400,3710-5020,5290-7750" and report["FSM"]["ref_exons"] == 4 and report["FSM"]["novel_junctions"] is None
    assert report["NNC"]["novel_junctions"] == "3910-5020" and report["NNC"]["representative_read"] == "n0" and report["intergenic"]["associated_gene"] is None
    rows = [{"file": str(d / "anno.gtf"), "id": "anno", "type": "annotation"}, {"file": path, "id": "b", "type": "sample"}]
    again = Index.build(spark, rows)
    assert {r["gene_id"] for r in again.structures.segments.collect()} == {"G1"}


def test_gene_biotypes_of_files(spark, tmp_path):
    items = [("A1", "G1.2", P4, 'gene_type "protein_coding";'), ("A2", "G2", [(9300, 9400), (9900, 9980)], 'gene_type "";'), ("A3", "G3", [(21000, 21100), (22000, 22100)], "")]
    named = ['gene\t9300\t9980\t.\t+\t.\tgene_id "G2"; gene_biotype "lncRNA";', 'exon\t21000\t21100\t.\t+\t.\tgene_id "G3"; transcript_id "A3"; gene_type "snoRNA";']
    (tmp_path / "a.gtf").write_text(gtf_text(items) + "".join(f"chr1\tS\t{x}\n" for x in named))
    (tmp_path / "b.gtf").write_text(gtf_text([("B1", "G1", P4, 'gene_type "other";')]))
    ix = Index.build(spark, [{"file": str(tmp_path / "b.gtf"), "id": "b", "type": "sample"}, {"file": str(tmp_path / "a.gtf"), "id": "a", "type": "annotation"}])
    assert {r["gene_id"]: r["gene_biotype"] for r in ix.structures.genes.collect()} == {"G1": "protein_coding", "G2": "lncRNA", "G3": "snoRNA"}
    assert {(r["biotype"], r["n"]) for r in ix.inspect()["biotype"].filter("level = 'gene' and sample_id is null").collect()} == {("protein_coding", 1), ("lncRNA", 1), ("snoRNA", 1)}
    lines = [r["line"] for r in ix.export(biotypes=["protein_coding"], sample_ids=[1], headers=False).collect()]
    assert len(lines) == 1 + 2 * 5 and sum('gene_biotype "protein_coding";' in x for x in lines) == 1


def test_headers_fill_what_the_manifest_leaves_open(spark, tmp_path):
    single = [(12_000, 12_460)]
    (tmp_path / "a.gtf").write_text(gtf_text([("A1", "G1", P4, ""), ("A2", "G2", single, "")], "##Type: Annotation\n##id: ref\n"))
    (tmp_path / "s_rep1.gtf").write_text(gtf_text([("T1", "M1", P4, 'TPM "3";')], "##expression_attribute: TPM, cov\n##group: treated\n"))
    head = b"@RG\tID:1\tSM:liver_rep2\n"
    (tmp_path / "b.bam").write_bytes(gzip.compress(b"BAM\1" + struct.pack("<i", len(head)) + head + struct.pack("<i", 0)))
    (tmp_path / "m.tsv").write_text("file\ttype\na.gtf\t.\ns_rep1.gtf\t.\nb.bam\tsample\n")
    (tmp_path / "said.tsv").write_text("file\ttype\tid\na.gtf\tsample\town\n")
    files = [str(tmp_path / x) for x in ("s_rep1.gtf", "b.bam", "a.gtf")]
    for given in (str(tmp_path / "m.tsv"), files):
        rows = {r["id"]: r for r in sample_rows(spark, given)}
        assert {(k, r["type"], r["group"]) for k, r in rows.items()} == {("ref", "annotation", None), ("s_rep1", "sample", "treated"), ("liver_rep2", "sample", "liver")}
        assert rows["s_rep1"]["expression_attribute"] == ["TPM", "cov"]
    assert [(r["id"], r["type"]) for r in sample_rows(spark, [str(tmp_path / "said.tsv"), files[0]])] == [("own", "sample"), ("s_rep1", "sample")]
    ix = Index.build(spark, [files[0], files[2]])
    assert [(r["id"], r["is_annotation"]) for r in ix.structures.samples.orderBy("sample_id").collect()] == [("ref", True), ("s_rep1", False)]
    assert {(r["gene_id"], r["n_exons"]) for r in ix.structures.segments.collect()} == {("G1", 4), ("G2", 1)}
    (tmp_path / "bad.gtf").write_text("##type: other\n")
    with pytest.raises(ValueError, match="bad.gtf: type other"):
        sample_rows(spark, str(tmp_path / "bad.gtf"))


def test_injected_counts(spark):
    lines = spark.createDataFrame([("f", 1, "#old"), ("f", 2, 'c\ts\ttranscript\t1\t2\t.\t+\t.\ttalon_transcript "7"; x "y";'), ("f", 3, 'c\ts\texon\t1\t2\t.\t+\t.\ttalon_transcript "7";')], "file_name string, line_no int, line string")
    out = [r["line"] for r in gtf.inject_counts(lines, spark.createDataFrame([("7", 5)], "transcript_id string, n bigint"), header={"type": "sample"}).orderBy("line_no").collect()]
    assert out[0] == "##type: sample" and out[1].endswith('x "y"; counts "5";') and out[2].endswith('"7";') and len(out) == 3


def test_files_of_one_name_missing_files_and_samples_of_reads(spark, tmp_path, caplog):
    for d, t, chain in (("a", "T1", P4), ("b", "T2", [(21_000, 21_100), (22_000, 22_100)])):
        (tmp_path / d).mkdir()
        (tmp_path / d / "t.gtf").write_text(gtf_text([(t, "G" + t, chain, "")]))
    ix = Index.build(spark, [str(tmp_path / x) for x in ("a/t.gtf", "gone/t.gtf", "b/t.gtf")])
    assert "gone/t.gtf" in caplog.text
    assert sorted((r["sample_id"], r["transcript_id"]) for r in ix.structures.transcripts.select("sample_id", "transcript_id").collect()) == [(1, "1/T1"), (2, "2/T2")]
    for d in "ab":
        write_bam(str(tmp_path / d / "r.bam"), [(f"r{k}", 0, 5000, 60 if k < 3 else 5, [(100, "M"), (400, "N"), (100, "M")]) for k in range(4)])
    reads = [str(tmp_path / d / "r.bam") for d in "ab"]
    both = Index.build(spark, reads, min_mapq=10, min_counts=3)
    assert sorted((r["sample_id"], r["value"]) for r in both.structures.transcripts.collect()) == [(1, 3.0), (2, 3.0)]
    few = Index.build(spark, reads, min_counts=5, min_expression={"TPM": 1.0})
    assert {r["outcome"]: r["n"] for r in few.counters().collect()}["discarded"] == 2 and few.structures.transcripts.count() == 0
    assert "TPM" in caplog.text


def test_absorbed_segments_are_stored_until_compacted(spark, tmp_path):
    """A 3' fragment that a later structure absorbs: two come in, none is merged, one absorbed, one left."""
    (tmp_path / "short.gtf").write_text(gtf_text([("S", "G1", P4[1:], "")]))
    (tmp_path / "long.gtf").write_text(gtf_text([("L", "G1", P4, "")]))
    given = [str(tmp_path / "short.gtf"), str(tmp_path / "long.gtf")]
    ix = Index.build(spark, given)
    want = {"input": 2, "merged": 0, "absorbed": 1, "discarded": 0, "scaffold": 0}
    assert {r["outcome"]: r["n"] for r in ix.counters().collect()} == want
    assert ix.structures.segments.count() == 1 and ix.structures.segment_samples.count() == 2
    ix.save(str(tmp_path / "ix"))
    stored = index.load(spark, str(tmp_path / "ix"))["segments"]
    assert {(r["segment_id"], r["absorbed"], r["absorbed_into"]) for r in stored.collect()} == {("2/L", False, None), ("1/S", True, "2/L")}
    index.compact(spark, str(tmp_path / "ix"), str(tmp_path / "c"))
    assert index.load(spark, str(tmp_path / "c"))["segments"].filter("absorbed").count() == 0
    for path in ("ix", "c"):
        back = Index.load(spark, str(tmp_path / path))
        assert back.structures.segments.count() == 1 and back.inspect()["overview"].filter("metric = 'exons'").first()["value"] == 4
        assert {r["outcome"]: r["n"] for r in back.counters().collect()} == want
    pruned = Index.build(spark, given, prune_tombstones=True)
    pruned.save(str(tmp_path / "p"))
    assert index.load(spark, str(tmp_path / "p"))["segments"].count() == 1


def test_gene_blocks(spark, monkeypatch):
    monkeypatch.setattr(gtf, "SLICE_BITS", 2)
    genes = ["A", "A", None, "A", "B", "B", "A", "A", "A", "A", "A", "A", "C"]
    rows = [("f", n, "x", {"gene_id": g} if g else {}) for n, g in enumerate(genes, 1)] + [("g", 3, "x", {"gene_id": "A"})]
    feats = spark.createDataFrame(rows, "file_name string, line_no int, feature string, attributes map<string,string>").repartition(5)
    got = {(r["file_name"], r["line_no"]): r["block_line"] for r in gtf.gene_blocks(feats).collect()}
    assert got == {("f", 1): 1, ("f", 2): 1, ("f", 4): 1, ("f", 5): 5, ("f", 6): 5, **{("f", n): 7 for n in range(7, 13)}, ("f", 13): 13, ("g", 3): 3}

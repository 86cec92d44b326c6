"""Matcher, hubs, events, clusters and usage tests on small fixtures."""

import math
import random

import pytest
from pyspark.sql import functions as F

from chainloom.operators import clusters, dtu, events, hubs, matcher, model, overlap
from chainloom.functions import scalars

CHAIN = "array<struct<start_pos:bigint,end_pos:bigint>>"
A1 = [(10000, 10200), (11000, 11300), (12500, 12800), (14000, 14500)]
B1 = [(50000, 50300), (52000, 52400), (54000, 55000)]


def chains(spark, items, key):
    rows = [(i, "chr22", s, c[0][0], max(e for _, e in c), g, len(c), c) for i, s, g, c in items]
    return spark.createDataFrame(rows, f"{key} string, seqid string, strand string, start_pos bigint, end_pos bigint, gene_id string, n_exons bigint, chain {CHAIN}")


def mirrored(chain):
    return [(100_000 - e, 100_000 - s) for s, e in reversed(chain)]


CASES = [
    ("fsm", A1, "FSM", "none"), ("ism5", A1[:3], "ISM", "5prime_fragment"), ("ism3", A1[1:], "ISM", "3prime_fragment"), ("skip", [A1[0], A1[2], A1[3]], "NIC", None),
    ("donor", [A1[0], (11000, 11500), A1[2], A1[3]], "NNC", "novel_donor"), ("acceptor", [A1[0], (10800, 11300), *A1[2:]], "NNC", "novel_acceptor"),
    ("intron", [(10400, 10700)], "genic_intron", "none"), ("genomic", [(10100, 10400)], "genic_genomic", "none"), ("far", [(30000, 30500)], "intergenic", "none"), ("b", B1, "FSM", "none"), ("near", [(s + 4, e + 4) for s, e in A1], "FSM", "none"),
]


@pytest.mark.parametrize("strand", "+-")
def test_categories(spark, strand):
    turn = mirrored if strand == "-" else lambda c: c
    refs = chains(spark, [("TX_A1", strand, "GENE_A", turn(A1)), ("TX_A2", strand, "GENE_A", turn([A1[0], A1[1], (13000, 13100)])), ("TX_B1", strand, "GENE_B", turn(B1))], "segment_id")
    queries = chains(spark, [(k, strand, "", turn(c)) for k, c, _, _ in CASES], "query_id")
    out = {r["query_id"]: r for r in matcher.classify(queries, refs).collect()}
    for k, _, category, sub in CASES:
        assert out[k]["category"] == category, k
        # donor and acceptor are the lower and the upper end of an intron, on either strand
        want = {"novel_donor": "novel_acceptor", "novel_acceptor": "novel_donor"}.get(sub, sub) if strand == "-" else sub
        assert want is None or out[k]["subcategory"] == want, k
    assert out["fsm"]["n_matched"] == 3 and out["b"]["gene_id"] == "GENE_B" and out["donor"]["novel_donors" if strand == "+" else "novel_acceptors"] == 1


def test_ties_are_ambiguous_and_reads_count_for_all(spark):
    refs = chains(spark, [("R1", "+", "G", A1), ("R2", "+", "G", [(9990, 10200), *A1[1:]])], "segment_id")
    q = chains(spark, [("q", "+", "", A1)], "query_id")
    assert matcher.classify(q, refs).first()["category"] == "ambiguous"
    w = spark.createDataFrame([("q", 5)], "query_id string, n_reads bigint")
    assert {tuple(r) for r in matcher.read_support(q, refs, w).collect()} == {("R1", 5), ("R2", 5)}


def structures(spark, items, samples=None):
    """items: (id, strand, gene, chain); samples: id -> list of sample ids."""
    rows = [(i if n == 0 else f"{i}~{n}", g, "chr1", s, x) for i, s, g, _ in items for n, x in enumerate((samples or {}).get(i, [1]))]
    t = spark.createDataFrame(rows, "transcript_id string, gene_id string, seqid string, strand string, sample_id int")
    t = t.withColumns({c: F.lit(None).cast("string") for c in ("gene_name", "biotype", "source")}).withColumn("segment_index", F.lit(None).cast("long"))
    ex = [(r[0], a, b) for i, _, _, c in items for r in rows if r[0].split("~")[0] == i for a, b in c]
    e = spark.createDataFrame(ex, "transcript_id string, start_pos bigint, end_pos bigint")
    sm = spark.createDataFrame([(k, f"s{k}", "sample", "g") for k in range(1, 5)], "sample_id int, id string, kind string, sample_group string")
    return model.Structures(model.with_chains(t, e), sm, spark.createDataFrame([], "gene_id string, gene_name string, gene_biotype string"))


@pytest.mark.parametrize("strand", "+-")
def test_hub_psi_and_entropy(spark, strand):
    turn = mirrored if strand == "-" else lambda c: c
    items = [(f"t{k:02}", strand, "G", turn([(1000, 1200), (3000 + 500 * k, 3100 + 500 * k)])) for k in range(12)] + [("u", strand, "G", turn([(500, 600), (20000, 20100)]))]
    s = structures(spark, items)
    h = hubs.hubs(s, 10).collect()
    assert len(h) == 1 and h[0]["total_branches"] == 12
    r = hubs.hub_samples(s, 10).first()
    assert r["psi"] == round(12 / 13, 4) and r["entropy"] == round(math.log2(12), 4) and r["branches"] == 12 and r["unique"] == 12
    assert hubs.branch_details(s.__class__(s.transcripts, s.samples, s.genes, spark.createDataFrame([], "segment_index bigint, sample_id int, value float")), 10).count() == 12
    assert hubs.hubs(s, 13).count() == 0
    with pytest.raises(ValueError):
        hubs.hubs(s, 1)


def test_events(spark):
    x = [(100, 200), (300, 400), (500, 600), (700, 800)]
    items = [("a", "+", "C", x[:3]), ("b", "+", "C", [x[0], x[2]]), ("c", "+", "M", [x[0], (300, 340), x[3]]), ("d", "+", "M", [x[0], (500, 540), x[3]]), ("e", "-", "S", [x[0], (300, 400), x[3]]), ("f", "-", "S", [x[0], (300, 450), x[3]]), ("g", "+", "R", x[:2]), ("h", "+", "R", [(100, 400), (900, 950)])]
    got = {(r["gene_id"], r["event_type"]) for r in events.events(structures(spark, items)).collect()}
    assert {("C", "cassette_exon"), ("M", "mutually_exclusive"), ("S", "alt_3prime"), ("R", "intron_retention"), ("R", "alt_last_exon"), ("R", "alt_first_exon")} <= got
    assert not {g for g, k in got if k == "cassette_exon"} - {"C", "M"} and ("S", "alt_5prime") not in got and ("S", "mutually_exclusive") in got


def brute_clusters(reads, tol, dist):
    out, todo = {}, sorted(reads, key=lambda r: (r[1], r[2], len(r[5]), r[5][0][0] if r[5] else r[3], r[3], str(r[5])))
    while todo:
        seed, rest = todo[0], []
        for r in todo:
            same = r[1:3] == seed[1:3] and len(r[5]) == len(seed[5])
            near = all(abs(a - b) <= tol for p, q in zip(seed[5], r[5]) for a, b in zip(p, q)) if seed[5] else 0 <= r[3] - seed[3] <= dist
            if same and near:
                out[r[0]] = seed[0]
            else:
                rest.append(r)
        todo = rest
    return {frozenset(k for k, v in out.items() if v == s) for s in out.values()}


def test_clusters_against_brute_force(spark):
    rng, reads = random.Random(8), []
    for i in range(250):
        s = rng.choice([1000, 1003, 1006, 1009, 5000, 5060, 5120, 5300])
        js = [(s + 200 + rng.randrange(-4, 5), s + 800 + rng.randrange(-4, 5)) for _ in range(1)] if rng.random() < 0.7 else []
        reads.append((f"r{i}", rng.choice(["c1", "c2"]), rng.choice("+-"), s, s + 1000, js, rng.randrange(60)))
    df = spark.createDataFrame(reads, "read_id string, seqid string, strand string, start_pos bigint, end_pos bigint, junctions array<struct<donor:bigint,acceptor:bigint>>, mapq int")
    c = clusters.cluster(df)
    groups = {}
    for r in c.collect():
        groups.setdefault(r["cluster_key"], set()).add(r["read_id"])
    want = brute_clusters(reads, 5, 100)
    assert {frozenset(g) for g in groups.values()} == want
    best = {r["cluster_key"]: r["representative_read"] for r in clusters.representatives(c).collect()}
    by = {r[0]: r for r in reads}
    assert all(by[best[k]][6] == max(by[x][6] for x in g) for k, g in groups.items())
    stats = clusters.statistics(clusters.bounds(c)).first()
    assert stats["reads"] == 250 and stats["clusters"] == len(want)


def test_loci_match_a_single_ordered_pass(spark):
    rng = random.Random(6)
    spans = [(i, "a", s := rng.randrange(0, 40_000_000), s + rng.choice([10, 1000, 9_000_000 if i % 40 == 0 else 20])) for i in range(400)]
    df = spark.createDataFrame(spans, "i int, q string, s bigint, e bigint")
    got = {r["i"]: r["locus_start"] for r in overlap.locus_numbers(df, ["q"], "s", "e").collect()}
    reach, start, want = -1, None, {}
    for i, _, s, e in sorted(spans, key=lambda x: x[2:]):
        if s > reach:
            start = s
        reach, want[i] = max(reach, e), start
    assert got == want


def test_usage_tests(spark):
    m = spark.createDataFrame([("G", "t1", "s1"), ("G", "t2", "s2"), ("H", "t3", "s3")], "gene_id string, transcript_id string, segment_id string")
    q = spark.createDataFrame([("s1", 1, 90.0), ("s1", 2, 10.0), ("s2", 1, 10.0), ("s2", 2, 90.0), ("s3", 1, 5.0)], "segment_id string, sample_id int, value double")
    g = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "sample_id int, sample_group string")
    used = dtu.usage(m, q, g, "A", "B")
    assert {r["transcript_id"]: round(r["delta_proportion"], 3) for r in used.collect()} == {"t1": 0.8, "t2": -0.8, "t3": 1.0}
    tests = dtu.gene_tests(used, exact=True).collect()
    assert [(r["gene_id"], round(r["chi2"], 6)) for r in tests] == [("G", 128.0)] and tests[0]["p_value"] < 1e-15


def test_correction_against_brute_force(spark):
    rng = random.Random(7)
    ps = [rng.random() ** 4 for _ in range(300)] + [0.05] * 5 + [1.0, 1.0, 1e-300]
    out = dtu.corrected(spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p_value double")).collect()
    order, want, least = sorted(range(len(ps)), key=lambda i: ps[i]), {}, 1.0
    for k in range(len(ps), 0, -1):
        least = min(least, ps[order[k - 1]] * len(ps) / k)
        want[order[k - 1]] = least
    assert all(abs(r["fdr"] - want[r["i"]]) < 1e-12 for r in out)


def test_scalars():
    assert scalars.parse_region("chr1:5-9") == ("chr1", 5, 9) and scalars.parse_contrast("a:b:c") == ("a", "b:c")
    for bad in ("chr1:9-5", "chr1", "chr1:x-3"):
        with pytest.raises(ValueError):
            scalars.parse_region(bad)
    with pytest.raises(ValueError):
        scalars.parse_contrast("ab")


def test_main_chromosomes_and_values(spark):
    cases = {"chr1": True, "22": True, "chr23": False, "01": False, "X": True, "chrMT": True, "x": False, "GL0001": False, "chrUn_1": False, "": False}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "s string, want boolean")
    assert df.filter(scalars.is_main_chromosome(F.col("s")) != F.col("want")).count() == 0
    v = spark.createDataFrame([("15x",), (" 2.5e1",), ("abc",), (None,), ("-.5",)], "v string")
    assert [r[0] for r in v.select(scalars.expression_value(F.col("v"))).collect()] == [15.0, 25.0, None, None, -0.5]

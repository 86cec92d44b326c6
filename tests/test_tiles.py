"""Queries against segments in tiles: same answers as all pairs, and no pairs on the way."""

import random

import pytest
from pyspark.sql import functions as F

from chainloom.operators import matcher, overlap, tiles

O = matcher.MatchOptions()
KIND = "string, seqid string, strand string, start_pos long, end_pos long, gene_id string, chain array<struct<start_pos:long,end_pos:long>>"


def structures(n, seed, prefix):
    rng = random.Random(seed)
    exons = sorted({(s, s + rng.choice([20, 60, 200])) for s in (rng.randrange(60_000, 72_000, 40) for _ in range(14))})
    out = []
    for k in range(n):
        chain = sorted({(s + rng.choice([0, 0, 3, 8]), e + rng.choice([0, 0, 4, 9])) for s, e in rng.sample(exons, rng.randrange(1, 6))})
        out.append((f"{prefix}{k}", "chr1", "+", chain[0][0], max(e for _, e in chain), f"g{k}", chain))
    return out + [(f"{prefix}x{k}", *row[1:]) for k, row in enumerate(out[: n // 3])]


def plain(queries, segments):
    """Per query all (segment, matched, score) that overlap enough."""
    out = {}
    for q in queries:
        qj = [(a[1], b[0]) for a, b in zip(q[6], q[6][1:])]
        out[q[0]] = []
        for r in segments:
            length = min(q[4], r[4]) - max(q[3], r[3])
            if length > 0 and length >= O.min_overlap:
                rj = [(a[1], b[0]) for a, b in zip(r[6], r[6][1:])]
                n = sum(any(abs(x - d) <= 5 and abs(y - a) <= 5 for d, a in rj) for x, y in qj)
                out[q[0]].append(((r[3], r[4], r[0]), n, n / len(qj) if qj else 1.0))
    return out


@pytest.mark.parametrize("block", [3, 16_384])
def test_tiles_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(tiles, "BLOCK", block)
    q, r = structures(30, 1, "q"), structures(24, 1, "r")
    queries, segments = spark.createDataFrame(q, f"query_id {KIND}"), spark.createDataFrame(r, f"segment_id {KIND}")
    want = plain(q, r)
    got = {(x["query_id"], x["segment_id"]): (x["n_matched"], x["score"]) for x in matcher.candidates(queries, segments).collect()}
    assert got == {(k, p[2]): (n, s) for k, v in want.items() for p, n, s in v}
    tied = {k: {p[2] for p, n, s in v if max(x[2] for x in v) - s < matcher.TIE and s >= O.min_junction_score} for k, v in want.items()}
    assert {(x[0], x[1]) for x in matcher.ties(queries, segments).collect()} == {(k, p) for k, v in tied.items() for p in v}
    best = {x["query_id"]: (x["segment_id"], x["n_matched"]) for x in matcher.classify(queries, segments).collect()}
    assert best == {k: min(((-s, p, n) for p, n, s in v), default=None) and (lambda b: (b[1][2], b[2]))(min((-s, p, n) for p, n, s in v)) or (None, 0) for k, v in want.items()}


def test_no_pairs_of_equal_rows_are_shuffled(spark):
    """300 copies of a query and 300 of a segment are 90,000 pairs; only distinct spans and structures are met."""
    q = [(f"q{k}", "chr1", "+", 100, 900, "g", [(100, 300), (500, 900)]) for k in range(300)]
    r = [(f"r{k:03}", "chr1", "+", 100, 900, "g", [(100, 300), (500, 900 - k), (950 - k, 900)] if k else [(100, 300), (500, 900)]) for k in range(300)]
    queries, segments = spark.createDataFrame(q, f"query_id {KIND}"), spark.createDataFrame(r, f"segment_id {KIND}")
    spans = overlap.first_by_span(queries, segments, ["seqid", "strand"], "segment_id", ("start_pos", "end_pos"), ("start_pos", "end_pos"), lambda length, name: [-length, name])
    assert [tuple(x) for x in spans.collect()] == [("chr1", "+", 100, 900, "r000", 800)]
    answers = matcher._levels(matcher._distinct(queries), segments, O)
    assert [(x["n_matched"], x["segment_id"], x["n"]) for x in answers.collect()] == [(1, "r000", 300)]
    assert {x["n_ties"] for x in matcher.best_candidates(matcher._distinct(queries), segments).select(F.col("n_ties")).collect()} == {300}


def test_read_support_is_the_sum_over_ties(spark, monkeypatch):
    monkeypatch.setattr(tiles, "BLOCK", 5)
    queries, segments = spark.createDataFrame(structures(30, 2, "q"), f"query_id {KIND}"), spark.createDataFrame(structures(24, 2, "r"), f"segment_id {KIND}")
    weights = queries.select("query_id", F.pmod(F.xxhash64("query_id"), F.lit(5)).alias("n_reads"))
    want = matcher.ties(queries, segments).join(weights, "query_id").groupBy("segment_id").agg(F.sum("n_reads").alias("n")).collect()
    assert want and {tuple(x) for x in matcher.read_support(queries, segments, weights).collect()} == {tuple(x) for x in want}
    monkeypatch.setattr(matcher, "ties", None)
    assert len(matcher.read_support(queries, segments, weights).collect()) == len(want)

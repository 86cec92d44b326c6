"""One small case per absorption rule, both strands, and the pair relations against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from chainloom.operators import absorb, model, quant
from chainloom.operators.spans import Spans

P3 = [(4110, 4350), (5630, 5825), (7310, 7705)]
P4 = [*P3, (9052, 9401)]
P5 = [*P4, (11_240, 11_477)]


def arrive(*items, strand="+", **options):
    """items: (chain, strict, loose) or chain (of a sample); the outcome of each, and the locus."""
    locus, out = absorb.Locus(absorb.AbsorbOptions(**options)), []
    for n, x in enumerate(items):
        chain, strict, loose = x if isinstance(x, tuple) else (x, False, False)
        out.append(locus.arrive(f"s{n}", chain, strand, f"G{n}", strict, loose))
    return [d for d, _, _ in out], [s for _, s, _ in out], [g for _, _, g in out]


def live(segments):
    return len({id(s) for s in segments if s is not None and not s.absorbed})


def mirrored(chain):
    return [(20_000 - e, 20_000 - s) for s, e in reversed(chain)]


@pytest.mark.parametrize("strand", "+-")
@pytest.mark.parametrize(
    ("first", "second", "annotated", "decision", "n_live"),
    [
        (P4, P4[:3], False, "created", 2),  # lacks 3' exons: kept
        (P4, P4[1:], False, "merged_3prime", 1),
        (P5, P5[3:], False, "created", 2),  # lacks three 5' exons
        (P5, P5[3:], True, "dropped_degraded", 1),
        (P5, P5[1:4], False, "created", 2),
        (P5, P5[1:4], True, "dropped_internal", 1),
        (P3, [(4141, 4350), P3[1], (7310, 7688)], False, "merged_terminal", 1),
        (P3, [P3[0], P3[1], (7310, 7756)], False, "created", 2),
        (P3, [(s + 4, e + 4) for s, e in P3], False, "merged_fuzzy", 1),
        (P3, [(s + 9, e + 9) for s, e in P3], False, "created", 2),
        (P3, [(5660, 5790)], False, "dropped_mono_gene_overlap", 1),
        (P3, [(4290, 5700)], False, "created", 2),  # spans an intron
        (P3, [(15_300, 15_900)], False, "dropped_mono_intergenic", 1),
    ],
)
def test_forward_rules(first, second, annotated, decision, n_live, strand):
    turn = mirrored if strand == "-" else lambda c: c
    decisions, segments, _ = arrive((turn(first), annotated, annotated), turn(second), strand=strand)
    assert decisions[1] == decision and live(segments) == n_live


@pytest.mark.parametrize("strand", "+-")
def test_reverse_absorption_and_chains(strand):
    turn = mirrored if strand == "-" else lambda c: c
    _, segments, _ = arrive(turn(P5[2:]), turn(P5[1:]), turn(P5), strand=strand)
    assert live(segments) == 1 and segments[0].into is segments[1] and segments[1].into is segments[2] and segments[2].swallowed == 2
    _, segments, _ = arrive(turn(P5[1:4]), (turn(P5), True, True), strand=strand)
    assert segments[0].absorbed and segments[0].into is None


def test_longer_fragment_parent_shadows_a_shorter_suffix_parent():
    decisions, _, _ = arrive(P5, P4, P4[2:])
    assert decisions == ["created", "created", "created"]


def test_options_and_inheritance():
    assert arrive(P4, P4[1:], absorb=False)[0] == ["created", "created"]
    assert arrive(P3, [(4290, 5700)], absorb=False)[0] == ["created", "dropped_mono_noabsorb"]
    decisions, segments, genes = arrive([(31_000, 31_700), (33_200, 34_100)], [(31_350, 31_820), (33_260, 33_990)])
    assert decisions == ["created", "created"] and genes == ["G0", "G0"]
    assert arrive([(1, 5), (9, 12)], [(20, 25), (29, 32)], annotated_loci_only=True)[0] == ["dropped_unannotated_locus"] * 2


def tables(spark, chains, sample_of=lambda i: 1):
    tx = [(f"T{i:03}", f"G{i % 3}", "chr1" if i % 4 else "chr2", "+" if i % 2 else "-", sample_of(i)) for i in range(len(chains))]
    t = spark.createDataFrame(tx, "transcript_id string, gene_id string, seqid string, strand string, sample_id int")
    e = spark.createDataFrame([(f"T{i:03}", s, x) for i, c in enumerate(chains) for s, x in c], "transcript_id string, start_pos bigint, end_pos bigint")
    t = t.withColumns({c: F.lit(None).cast("string") for c in ("gene_name", "biotype", "source")}).withColumn("segment_index", F.lit(None).cast("long"))
    samples = spark.createDataFrame([(0, "annotation", True, True), (1, "sample", False, False), (2, "sample", False, False)], "sample_id int, kind string, is_annotation boolean, is_annotation_loose boolean")
    return model.with_chains(t, e), samples


def some_chains(n, seed):
    rng, out = random.Random(seed), []
    for _ in range(n):
        at, chain = 10_000 * rng.randrange(1, 5), []
        for k in range(rng.randrange(1, 6)):
            s = at + 1000 * k + rng.choice([0] * 12 + [3, 20])
            chain.append((s, s + 200 + rng.choice([0] * 12 + [4])))
        out.append(chain[rng.randrange(len(chain)) :] if rng.random() < 0.4 else chain)
    return out


def test_unrelated_loci_do_not_matter(spark):
    chains = some_chains(60, 1)
    far = [[(s + 10_000_000, e + 10_000_000) for s, e in c] for c in some_chains(40, 2)]
    t1, samples = tables(spark, chains, lambda i: i % 3)
    t2, _ = tables(spark, chains + far, lambda i: i % 3)

    def outcome(t):
        return {r["structure"]: (r["decision"], r["target"], r["gene_id"], r["absorbed"]) for r in absorb.decide(t, samples).collect()}

    one, both = outcome(t1), outcome(t2)
    assert {k: both[k] for k in one} == one and len(both) > len(one)


def test_counters_and_live_segments(spark):
    t, samples = tables(spark, [P4] * 2 + [[(s + 40_000, e + 40_000) for s, e in P4]] * 2)
    t = t.withColumn("strand", F.lit("+")).withColumn("seqid", F.lit("chr1"))
    decided = absorb.decide(t, samples)
    counts = {r["outcome"]: r["n"] for r in absorb.counters(absorb.transcript_decisions(t, decided), decided).collect()}
    assert counts == {"input": 4, "merged": 2, "absorbed": 0, "discarded": 0, "scaffold": 0}
    assert sum(r["n_transcripts"] for r in absorb.live_segments(decided, t).collect()) == 4


class Plain:
    """The rules by scanning all live segments for every arrival."""

    def __init__(self, o):
        self.o, self.all = o, []

    def arrive(self, structure, chain, strand, gene, strict, loose):
        lo, hi = chain[0][0], max(e for _, e in chain)
        live = sorted((s for s in self.all if not s.absorbed and s.start < hi and s.end > lo), key=lambda s: (s.start, s.end, s.creation))

        def merged(s, how):
            s.swallowed += 1
            s.loose = s.loose or loose
            return how, s, s.gene

        several = len(chain) > 1
        for s in live:
            if several and self.o.absorb and absorb.is_terminal_variant(chain, s.chain):
                return merged(s, "merged_terminal")
        if not several and not strict:
            kind = absorb.mono_exon_class(chain[0], [s.chain for s in live if len(s.chain) > 1])
            if not self.o.absorb or kind != "intron_retention":
                return "dropped_mono_" + (kind if self.o.absorb else "noabsorb"), None, gene
        if several and self.o.absorb:
            kinds = [(s, absorb.relation(chain, s.chain, strand, self.o.fuzzy_tolerance)) for s in live]
            for s, kind in kinds:
                if kind == "fsm":
                    return merged(s, "merged_fuzzy")
            parents = [(s, kind) for s, kind in kinds if kind not in (None, "ism5")]
            if parents:
                best, how = max(parents, key=lambda x: len(x[0].chain))
                if how == "ism3":
                    return merged(best, "merged_3prime")
                if best.loose:
                    return f"dropped_{how}", None, gene
        if not strict:
            known = [s for s in live if s.loose]
            gene = (known or live)[0].gene if live else gene
            if self.o.annotated_loci_only and not known:
                return "dropped_unannotated_locus", None, gene
        new = absorb.Segment(structure, chain, strand, gene, loose, len(self.all))
        for s in live if self.o.absorb and several else []:
            kind = "fsm" if absorb.is_terminal_variant(s.chain, chain) else absorb.relation(s.chain, chain, strand, self.o.fuzzy_tolerance)
            if kind in ("fsm", "ism3"):
                s.absorbed, s.into = True, new
                new.swallowed += s.swallowed + 1
                new.loose = new.loose or s.loose
            elif kind in ("degraded", "internal") and loose:
                s.absorbed = True
        self.all.append(new)
        return "created", new, gene


@pytest.mark.parametrize("options", [{}, {"absorb": False}, {"annotated_loci_only": True}, {"fuzzy_tolerance": 0}])
def test_fold_against_plain_scans(options, monkeypatch):
    monkeypatch.setattr(absorb.Spans, "BLOCK", 4)
    for seed in range(12):
        rng = random.Random(seed)
        o = absorb.AbsorbOptions(**options)
        fast, plain, outcome = absorb.Locus(o), Plain(o), []
        chains = {tuple(c) for c in some_chains(120, seed)}
        for n, chain in enumerate(sorted(chains, key=lambda c: rng.random())):
            loose = rng.random() < 0.2
            strict = loose and rng.random() < 0.7
            a, b = (x.arrive(f"s{n}", list(chain), "+-"[seed % 2], f"G{n}", strict, loose) for x in (fast, plain))
            assert (a[0], a[1] and a[1].structure, a[2]) == (b[0], b[1] and b[1].structure, b[2])
            outcome.append((a[1], b[1]))
        assert all((x.absorbed, x.loose, x.swallowed, x.into and x.into.structure) == (y.absorbed, y.loose, y.swallowed, y.into and y.into.structure) for x, y in outcome if x)
        assert {x.structure for x in fast.live.values()} == {x.structure for x in plain.all if not x.absorbed}


def test_spans_against_brute_force(monkeypatch):
    monkeypatch.setattr(Spans, "BLOCK", 8)
    rng = random.Random(1)
    for _ in range(10):
        spans, have = Spans(), set()
        for i in range(300):
            a = rng.randrange(300)
            if rng.random() < 0.6 or not have:
                have.add(x := (a, a + rng.randrange(1, 40), i))
                spans.add(x)
            else:
                have.remove(x := rng.choice(sorted(have)))
                spans.remove(x)
            q = rng.randrange(300)
            r = q + rng.randrange(1, 50)
            assert spans.overlapping(q, r) == min((h for h in have if h[0] < r and h[1] > q), default=None)
            assert spans.within(q, r) == min((h for h in have if h[0] > q and h[1] < r), default=None)


def test_order_of_arrival_follows_file_block_and_line(spark):
    """Of two structures that would each take the other's name first, the one in the earlier block of the file arrives first, whatever their ids."""
    one, two = [(100, 200), (300, 400)], [(150, 200), (300, 450)]
    t, samples = tables(spark, [one, two])
    t = t.withColumns({"seqid": F.lit("chr1"), "strand": F.lit("+"), "gene_id": F.when(F.col("transcript_id") == "T000", "Z").otherwise("A")})

    def target(first):
        lines = t.withColumn("block_line", F.when(F.col("transcript_id") == first, 5).otherwise(9).cast("long")).withColumn("line_no", F.col("block_line"))
        rows = absorb.decide(lines, samples).collect()
        assert {r["decision"] for r in rows} == {"created", "merged_terminal"}
        return next(r["gene_id"] for r in rows)

    assert target("T000") == "Z" and target("T001") == "A"


def test_pairs_against_brute_force(spark):
    t, _ = tables(spark, some_chains(80, 3))
    segments = model.segments_of(t)
    rows = [(r["segment_id"], r["seqid"], r["strand"], [tuple(x) for x in r["chain"]]) for r in segments.collect()]
    fuzzy, terminal, exact = set(), set(), set()
    for a, qa, sa, ca in rows:
        for b, qb, sb, cb in rows:
            if a == b or (qa, sa) != (qb, sb):
                continue
            n, m = len(ca), len(cb)
            if 2 <= n <= m and any(all(abs(x - y) <= 5 for p, q in zip(ca, cb[k : k + n]) for x, y in zip(p, q)) for k in range(m - n + 1)):
                fuzzy.add((a, b))
            if 2 <= n < m and any(cb[k : k + n] == ca for k in range(m - n + 1)):
                exact.add((a, b))
            if a < b and absorb.is_terminal_variant(ca, cb):
                terminal.add((a, b))
    assert {tuple(r) for r in absorb.pairs_fuzzy(segments).collect()} == fuzzy and fuzzy
    assert {tuple(r)[:2] for r in absorb.pairs_subsequence(segments).collect()} == exact and exact
    assert {tuple(r) for r in absorb.pairs_terminal(segments).collect()} == terminal and terminal


def test_values_move_along_chains(spark):
    q = spark.createDataFrame([("A", 1, 5.0), ("B", 1, 10.0), ("C", 1, 15.0), ("B", 2, 1.0), ("D", 1, 3.0), ("E", 1, 9.0)], "segment_id string, sample_id int, value double")
    remap = spark.createDataFrame([("A", "B"), ("B", "C"), ("E", "E"), ("X", "Y"), ("Y", "X")], "old_id string, new_id string")
    closed = quant.closure(remap)
    assert {r["old_id"]: r["new_id"] for r in closed.collect()} == {"A": "C", "B": "C", "X": "Y", "Y": "X"}
    ring = spark.createDataFrame([("P", "Q"), ("Q", "R"), ("R", "P"), ("O", "P"), *((f"n{k:04}", f"n{k + 1:04}") for k in range(700))], "old_id string, new_id string")
    ends = {r["old_id"]: r["new_id"] for r in quant.closure(ring).collect()}
    assert {k: ends.pop(k) for k in "OPQR"} == {"O": "P", "P": "Q", "Q": "R", "R": "P"} and set(ends.values()) == {"n0700"} and len(ends) == 700
    dropped = spark.createDataFrame([("D",), ("A",)], "segment_id string")
    assert {tuple(r) for r in quant.merge(q, closed, dropped).collect()} == {("C", 1, 30.0), ("C", 2, 1.0), ("E", 1, 9.0)}


def test_arrivals_are_compared_with_few_of_a_deep_locus(monkeypatch):
    """All structures share their first two exons; only runs of one another are compared."""
    calls = []
    real = absorb.relation
    monkeypatch.setattr(absorb, "relation", lambda *a: calls.append(1) or real(*a))
    locus = absorb.Locus(absorb.AbsorbOptions())
    first = [(100, 200), (300, 400)]
    for k in range(300):
        chain = [*first, (1000 + 50 * k, 1010 + 50 * k), (50_000 + 50 * k, 50_010 + 50 * k)]
        assert locus.arrive(f"s{k}", chain, "+", "g", False, False)[0] == "created"
    assert locus.arrive("part", [*first, (1000, 1010)], "+", "g", False, False)[0] == "created"
    # lacks the first two exons of the hundredth
    assert locus.arrive("end", [(6000, 6010), (55_000, 55_010)], "+", "g", False, False)[0] == "merged_3prime"
    assert len(calls) < 10


def test_fold_counters_are_the_counters(spark):
    t, samples = tables(spark, [c for c in some_chains(60, 3) for _ in range(2)])
    t = t.withColumn("strand", F.lit("+")).withColumn("seqid", F.lit("chr1"))
    decided = absorb.decide(t, samples).cache()
    both = [{r["outcome"]: r["n"] for r in df.collect()} for df in (absorb.counters(absorb.transcript_decisions(t, decided), decided), absorb.fold_counters(decided))]
    assert both[0] == both[1] and both[1]["input"] == 120

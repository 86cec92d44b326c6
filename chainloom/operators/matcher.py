"""Structural classification of transcripts against reference segments.

Chains are ascending on both strands and strand decides which end is 5'.
Candidates are the segments that overlap a query enough. Which of them share
junctions, and which splice sites are known, is found once for each distinct
structure of the queries, in tiles of both sides (``tiles``) that put out the
best of a query there, so that pairs are neither shuffled nor gathered. Ties go
to the smallest (start, end, segment_id).

Defined results: a query without candidate is intergenic; one without
junctions scores 1; a reference without junctions scores 0; repeated query
rows must be made distinct by the caller, as ``query_id`` identifies them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import junctions, same_junction, within
from ..plans.durable import durable
from . import overlap, tiles
from .overlap import overlap_join, overlap_length, with_any_overlap

# Fixed values of the classification.
PERFECT, TIE = 0.999, 0.001


@dataclass(frozen=True)
class MatchOptions:
    junction_tolerance: int = 5
    min_junction_score: float = 0.8
    min_overlap: int = 50
    splice_site_window: int = 10


_SPAN = ["seqid", "strand"]


def _wide_enough(o: MatchOptions) -> Column:
    length = overlap_length("q_start", "q_end", "start_pos", "end_pos")
    return (length > 0) & (length >= o.min_overlap)


def _query_junctions(queries: DataFrame) -> DataFrame:
    q = queries.select("query_id", *_SPAN, F.col("start_pos").alias("q_start"), F.col("end_pos").alias("q_end"), F.posexplode(junctions(F.col("chain"))).alias("at", "j"))
    return q.select("query_id", *_SPAN, "q_start", "q_end", "at", F.col("j.donor").alias("q_donor"), F.col("j.acceptor").alias("q_acceptor"))


def _segment_junctions(segments: DataFrame) -> DataFrame:
    return segments.select("segment_id", *_SPAN, "start_pos", "end_pos", F.explode(junctions(F.col("chain"))).alias("j")).select("segment_id", *_SPAN, "start_pos", "end_pos", "j.donor", "j.acceptor")


def _cells(position: str, width: int) -> Column:
    """The cell of a position and its neighbours, so that all positions within ``width`` - 1 are in one of them."""
    return F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(position) / width) + d))


def overlapping(queries: DataFrame, segments: DataFrame, o: MatchOptions = MatchOptions()) -> DataFrame:
    """(query_id, segment_id, start_pos, end_pos) of all candidates, without their chains."""
    q = queries.select("query_id", *_SPAN, F.col("start_pos").alias("q_start"), F.col("end_pos").alias("q_end"))
    r = segments.select("segment_id", *_SPAN, "start_pos", "end_pos")
    return overlap_join(q, r, _SPAN, ("q_start", "q_end"), ("start_pos", "end_pos")).filter(_wide_enough(o)).select("query_id", "segment_id", "start_pos", "end_pos")


def with_candidates(queries: DataFrame, segments: DataFrame, o: MatchOptions = MatchOptions()) -> DataFrame:
    """(query_id) of the queries that have any candidate; no pairs are made."""
    return with_any_overlap(queries.select("query_id", *_SPAN, "start_pos", "end_pos"), segments, _SPAN, ("start_pos", "end_pos"), ("start_pos", "end_pos"), o.min_overlap).select("query_id").distinct()


def candidates(queries: DataFrame, segments: DataFrame, o: MatchOptions = MatchOptions()) -> DataFrame:
    """All pairs that overlap enough: (query_id, segment_id, n_matched, score).

    ``queries`` has (query_id, seqid, strand, start_pos, end_pos, chain).
    """
    answer, schema = tiles.pairs(o.junction_tolerance, o.min_overlap, False)
    pairs = tiles.in_tiles(queries, segments, answer, schema)
    return pairs.select("query_id", "segment_id", "n_matched", F.when(F.col("nq") == 0, F.lit(1.0)).otherwise(F.col("n_matched") / F.col("nq")).alias("score"))


def site_flags(queries: DataFrame, segments: DataFrame, o: MatchOptions = MatchOptions()) -> DataFrame:
    """(query_id, known_donors, known_acceptors, novel_donors, novel_acceptors): sites near one of any candidate.

    Semi-joins on cells against distinct sites, which end at the first hit.
    """
    q = _query_junctions(queries)
    width = o.splice_site_window + 1

    def known(side: str) -> DataFrame:
        sites = _segment_junctions(segments).select(*_SPAN, "start_pos", "end_pos", side).distinct().withColumn("cell", F.floor(F.col(side) / width))
        a, b = q.withColumn("cell", _cells(f"q_{side}", width)).alias("a"), sites.alias("b")
        length = F.least(F.col("a.q_end"), F.col("b.end_pos")) - F.greatest(F.col("a.q_start"), F.col("b.start_pos"))
        on = (F.col("a.seqid") == F.col("b.seqid")) & (F.col("a.strand") == F.col("b.strand")) & (F.col("a.cell") == F.col("b.cell"))
        hit = a.join(b, on & within(F.col(f"a.q_{side}"), F.col(f"b.{side}"), o.splice_site_window) & (length > 0) & (length >= o.min_overlap), "left_semi")
        return hit.select("query_id", "at", F.lit(side).alias("side")).distinct()

    hits = known("donor").unionByName(known("acceptor")).groupBy("query_id").agg(F.count_if(F.col("side") == "donor").alias("known_donors"), F.count_if(F.col("side") == "acceptor").alias("known_acceptors"))
    with_any = with_candidates(queries, segments, o)
    all_q = queries.filter(F.size("chain") > 1).select("query_id", (F.size("chain") - 1).cast("long").alias("n")).join(with_any, "query_id", "left_semi").join(hits, "query_id", "left").fillna(0, ["known_donors", "known_acceptors"])
    return all_q.select("query_id", "known_donors", "known_acceptors", (F.col("n") - F.col("known_donors")).alias("novel_donors"), (F.col("n") - F.col("known_acceptors")).alias("novel_acceptors"))


def _distinct(queries: DataFrame) -> DataFrame:
    """One query of each structure."""
    return queries.groupBy(*_SPAN, "start_pos", "end_pos", "chain").agg(F.min("query_id").alias("query_id"))


def _levels(queries: DataFrame, segments: DataFrame, o: MatchOptions) -> DataFrame:
    answer, schema = tiles.levels(o.junction_tolerance, o.splice_site_window, o.min_overlap, TIE)
    return tiles.in_tiles(queries.filter(F.size("chain") > 1), segments.filter(F.size("chain") > 1), answer, schema)


def _judged(queries: DataFrame, segments: DataFrame, o: MatchOptions) -> DataFrame:
    """(query_id, top, at_top, donors, acceptors): of queries that share junctions or sites with a candidate; ``at_top`` has (n_matched, n) of the highest numbers of matched junctions in each tile."""
    place = F.struct((-F.col("n_matched")).alias("n"), "start_pos", "end_pos", "segment_id")
    return _levels(queries, segments, o).groupBy("query_id").agg(
        F.min(F.when(F.col("n_matched").isNotNull(), place)).alias("top"), F.collect_list(F.when(F.col("n_matched").isNotNull(), F.struct("n_matched", "n"))).alias("at_top"),
        F.size(F.array_distinct(F.flatten(F.collect_list("donors")))).cast("long").alias("known_donors"), F.size(F.array_distinct(F.flatten(F.collect_list("acceptors")))).cast("long").alias("known_acceptors"),
    )


def best_candidates(queries: DataFrame, segments: DataFrame, o: MatchOptions = MatchOptions()) -> DataFrame:
    """(query_id, segment_id, n_matched, n_ties, known and novel sites, ...): the best candidate of each query with both chains' junctions.

    Where no candidate shares a junction all score alike, and the first by (start, end, id) is the best; this one follows from the distinct spans.
    """
    judged = _judged(queries, segments, o)
    first = overlap.first_by_span(queries, segments, _SPAN, "segment_id", ("start_pos", "end_pos"), ("start_pos", "end_pos"), lambda _, name: [F.col("__b0"), F.col("__b1"), name], max(1, o.min_overlap))
    q = queries.select("query_id", *_SPAN, "start_pos", "end_pos", junctions(F.col("chain")).alias("qj")).join(first.withColumnRenamed("segment_id", "first_id").drop("overlap"), [*_SPAN, "start_pos", "end_pos"])
    r = segments.select("segment_id", "gene_id", "chain", junctions(F.col("chain")).alias("rj"))
    nq = F.size("qj")
    score = F.when(nq == 0, F.lit(1.0)).otherwise(F.col("n_matched") / nq)
    tied = F.filter("at_top", lambda x: (F.col("score") - x["n_matched"] / nq < TIE) & (x["n_matched"] / nq >= o.min_junction_score))
    n_ties = F.aggregate(tied, F.lit(0).cast("long"), lambda total, x: total + x["n"])
    chosen = q.join(judged, "query_id", "left").select("query_id", "strand", F.col("start_pos").alias("q_start"), F.col("end_pos").alias("q_end"), "qj", F.coalesce("top.segment_id", "first_id").alias("segment_id"), F.coalesce(-F.col("top.n"), F.lit(0)).cast("long").alias("n_matched"), "at_top", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("known_donors", "known_acceptors")))
    done = chosen.withColumn("score", score).withColumn("n_ties", F.coalesce(n_ties, F.lit(0))).drop("at_top")
    return done.withColumns({f"novel_{s}": nq - F.col(f"known_{s}") for s in ("donors", "acceptors")}).join(r, "segment_id")


def _least(queries: DataFrame, segments: DataFrame, o: MatchOptions) -> DataFrame:
    """(query_id, least): the smallest number of matched junctions that ties with the best, of queries that match well enough."""
    top = _levels(queries, segments, o).filter("n_matched is not null").groupBy("query_id").agg(F.max("n_matched").alias("top"))
    nq = F.size("chain") - 1
    ok = F.filter(F.sequence(F.lit(1).cast("long"), F.col("top")), lambda x: (F.col("top") / nq - x / nq < TIE) & (x / nq >= o.min_junction_score))
    return queries.join(top, "query_id").withColumn("least", F.array_min(ok)).filter("least is not null")


def ties(queries: DataFrame, segments: DataFrame, o: MatchOptions = MatchOptions()) -> DataFrame:
    """(query_id, segment_id) of every candidate that scores as well as the best one; for single-exon queries these are all."""
    queries = queries.select("query_id", *_SPAN, "start_pos", "end_pos", "chain")
    distinct = _distinct(queries.filter(F.size("chain") > 1))
    least = _least(distinct, segments, o).select(*_SPAN, "chain", "least")
    answer, schema = tiles.pairs(o.junction_tolerance, o.min_overlap, True)
    out = tiles.in_tiles(queries.join(least, [*_SPAN, "chain"]), segments.filter(F.size("chain") > 1), answer, schema, F.col("least"))
    return out.select("query_id", "segment_id").unionByName(overlapping(queries.filter(F.size("chain") == 1), segments, o).select("query_id", "segment_id"))


def _subcategories(best: DataFrame, o: MatchOptions) -> DataFrame:
    tol = o.junction_tolerance
    nq, nr = F.size("qj"), F.size("rj")
    low = F.exists("qj", lambda j: same_junction(j, F.col("rj")[0], tol))
    high = F.exists("qj", lambda j: same_junction(j, F.element_at("rj", -1), tol))
    plus = F.col("strand") == "+"
    first, last = F.when(plus, low).otherwise(high), F.when(plus, high).otherwise(low)
    ism = F.when(first & ~last, "5prime_fragment").when(last & ~first, "3prime_fragment").when(~first & ~last, "internal_fragment").otherwise("none")
    spanned = F.exists("rj", lambda r: (F.col("q_start") < r["donor"]) & (F.col("q_end") > r["acceptor"]) & ~F.exists("qj", lambda j: same_junction(j, r, tol)))
    nic = F.when(spanned, "intron_retention").when((nq > 0) & (nq < nr), "exon_skipping").otherwise("combination")
    nd, na = F.col("novel_donors") > 0, F.col("novel_acceptors") > 0
    nnc = F.when(nd & na, "novel_donor_and_acceptor").when(nd, "novel_donor").otherwise("novel_acceptor")
    exonic = F.exists("chain", lambda x: (x["start_pos"] < F.col("q_end")) & (x["end_pos"] > F.col("q_start")))
    full = F.col("score") >= PERFECT
    category = (
        F.when(nq == 0, F.when(exonic, "genic_genomic").otherwise("genic_intron"))
        .when(full & (nq == nr), F.when(F.col("n_ties") > 1, "ambiguous").otherwise("FSM"))
        .when(full & (nq < nr), "ISM").when(~nd & ~na, "NIC").otherwise("NNC")
    )
    sub = F.when(F.col("category") == "ISM", ism).when(F.col("category") == "NIC", nic).when(F.col("category") == "NNC", nnc).otherwise("none")
    return best.withColumn("category", category).withColumn("subcategory", sub)


RESULT = ["query_id", "category", "subcategory", "segment_id", "gene_id", "score", "n_matched", "query_junctions", "ref_junctions", "known_donors", "known_acceptors", "novel_donors", "novel_acceptors"]


def classify(queries: DataFrame, segments: DataFrame, o: MatchOptions = MatchOptions()) -> DataFrame:
    """One row per query: category, subcategory and figures of the best candidate.

    Both inputs are read many times, so their needed columns are written once first.
    """
    queries = durable(queries.select("query_id", *_SPAN, "start_pos", "end_pos", "chain"))
    segments = durable(segments.select("segment_id", *_SPAN, "start_pos", "end_pos", "gene_id", "chain"))
    counts = ["known_donors", "known_acceptors", "novel_donors", "novel_acceptors"]
    best = best_candidates(_distinct(queries), segments, o)
    done = _subcategories(best, o).select(F.col("query_id").alias("like_id"), "category", "subcategory", "segment_id", "gene_id", F.round("score", 6).alias("score"), F.col("n_matched").cast("long"), F.size("qj").cast("long").alias("query_junctions"), F.size("rj").cast("long").alias("ref_junctions"), *counts)
    alike = queries.join(_distinct(queries).withColumnRenamed("query_id", "like_id"), [*_SPAN, "start_pos", "end_pos", "chain"]).select("query_id", "like_id")
    rest = alike.join(done, "like_id", "left").drop("like_id")
    return rest.fillna({"category": "intergenic", "subcategory": "none", "score": 0.0, "n_matched": 0, "query_junctions": 0, "ref_junctions": 0, **dict.fromkeys(counts, 0)})


def novel_junctions(queries: DataFrame, segments: DataFrame, o: MatchOptions = MatchOptions()) -> DataFrame:
    """(query_id, donor, acceptor): junctions of a query with candidates that none of them has, within the tolerance."""
    width = o.junction_tolerance + 1
    q = _query_junctions(queries)
    r = _segment_junctions(segments).select(*_SPAN, "start_pos", "end_pos", "donor", "acceptor").distinct().withColumn("cell", F.floor(F.col("donor") / width))
    near = within(F.col("q_donor"), F.col("donor"), o.junction_tolerance) & within(F.col("q_acceptor"), F.col("acceptor"), o.junction_tolerance)
    known = q.withColumn("cell", _cells("q_donor", width)).join(r, [*_SPAN, "cell"]).filter(near & _wide_enough(o)).select("query_id", "at").distinct()
    some = with_candidates(queries, segments, o)
    return q.join(some, "query_id", "left_semi").join(known, ["query_id", "at"], "left_anti").select("query_id", F.col("q_donor").alias("donor"), F.col("q_acceptor").alias("acceptor"))


def summarise(classified: DataFrame) -> DataFrame:
    """(category, subcategory, n, percent)."""
    total = classified.agg(F.count(F.lit(1))).scalar()
    return classified.groupBy("category", "subcategory").agg(F.count(F.lit(1)).alias("n")).withColumn("percent", F.round(F.col("n") * 100.0 / total, 4))


def read_support(queries: DataFrame, segments: DataFrame, weights: DataFrame, o: MatchOptions = MatchOptions()) -> DataFrame:
    """(segment_id, read_coverage): the reads of a query count for every segment it ties on. ``weights`` is (query_id, n_reads)."""
    place = [*_SPAN, "start_pos", "end_pos"]
    weighed = queries.select("query_id", *place, "chain").join(weights, "query_id").groupBy(*place, "chain").agg(F.min("query_id").alias("query_id"), F.sum("n_reads").alias("weight"))
    several, parts = segments.filter(F.size("chain") > 1), weighed.filter(F.size("chain") > 1)
    answer, schema = tiles.support(o.junction_tolerance, o.min_overlap)
    shared = tiles.in_tiles(_least(parts, several, o), several, answer, schema, F.col("least"), F.col("weight"))
    # all candidates of single-exon queries tie: summed for each distinct span
    single = weighed.filter(F.size("chain") == 1).groupBy(*_SPAN, F.col("start_pos").alias("q_start"), F.col("end_pos").alias("q_end")).agg(F.sum("weight").alias("weight"))
    met = overlap_join(single, segments.select(*place).distinct(), _SPAN, ("q_start", "q_end"), ("start_pos", "end_pos")).filter(_wide_enough(o))
    alone = segments.select("segment_id", *place).join(met.groupBy(*place).agg(F.sum("weight").alias("weight")), place).select("segment_id", "weight")
    return shared.unionByName(alone).groupBy("segment_id").agg(F.sum("weight").alias("read_coverage"))


def novel_segments(classified: DataFrame, weights: DataFrame, min_support: int = 3) -> DataFrame:
    """Queries that become new segments: NIC or NNC with enough reads."""
    return classified.join(weights, "query_id").filter(F.col("category").isin("NIC", "NNC") & (F.col("n_reads") >= min_support)).select("query_id", "category", "subcategory", "n_reads")

"""Queries of overlap joins, structural matching, hubs, events and usage tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dtu, events, hubs, matcher, model, overlap
from ..plans.tables import table
from .structure import CORE_SQL

#: Annotation source whose structures are the reference; the transcripts of all others are the queries.
REFERENCE = "VELANN"
MIN_BRANCHES = 3
GROUPS = ("long-read RNA", "short-read RNA")


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, model.Structures]:
    s = model.load(spark, folder)
    queries = s.transcripts.filter(F.coalesce(F.col("source"), F.lit("")) != REFERENCE).withColumnRenamed("transcript_id", "query_id")
    known = model.segments_of(s.transcripts, F.coalesce(F.bool_or(F.col("source") == REFERENCE), F.lit(False)).alias("known")).filter("known").drop("known")
    return queries, known, s


def _m(fn):
    return lambda spark, folder: fn(*_sides(spark, folder)[:2])


def _s(fn):
    return lambda spark, folder: fn(model.load(spark, folder))


SPANS = ["seqid", "strand"]


def overlap_pairs(q: DataFrame, r: DataFrame) -> DataFrame:
    a = q.select("query_id", *SPANS, F.col("start_pos").alias("q_start"), F.col("end_pos").alias("q_end"))
    pairs = overlap.overlap_join(a, r.select("segment_id", *SPANS, "start_pos", "end_pos"), SPANS, ("q_start", "q_end"), ("start_pos", "end_pos"))
    return pairs.select("query_id", "segment_id", overlap.overlap_length("q_start", "q_end", "start_pos", "end_pos").alias("overlap"))


def best_gene(q: DataFrame, r: DataFrame) -> DataFrame:
    """Gene of the longest overlap; a made-up one where nothing overlaps."""
    a = q.select("query_id", *SPANS, F.col("start_pos").alias("q_start"), F.col("end_pos").alias("q_end"))
    best = overlap.best_overlap(a, r, SPANS, "query_id", "segment_id", ("q_start", "q_end"), ("start_pos", "end_pos"))
    found = best.join(r.select("segment_id", "gene_id"), "segment_id", "left")
    return found.select("query_id", F.coalesce("gene_id", F.format_string("novel_%s_%d", "seqid", "q_start")).alias("gene_id"), F.coalesce("overlap", F.lit(0)).alias("overlap"))


def annotated_only(q: DataFrame, r: DataFrame) -> DataFrame:
    """Queries that overlap the reference at all."""
    return overlap.with_any_overlap(q.select("query_id", *SPANS, "start_pos", "end_pos"), r, SPANS, ("start_pos", "end_pos"), ("start_pos", "end_pos")).select("query_id").distinct()


def gene_inheritance(spark: SparkSession, folder: str) -> DataFrame:
    """Gene a query takes over: that of the first overlapping reference segment (by start, end, id), else its own."""
    q, r, _ = _sides(spark, folder)
    spans = q.select(*SPANS, "start_pos", "end_pos")
    first = overlap.first_by_span(spans, r, SPANS, "segment_id", ("start_pos", "end_pos"), ("start_pos", "end_pos"), lambda _, name: [F.col("__b0"), F.col("__b1"), name])
    genes = first.join(r.select("segment_id", F.col("gene_id").alias("ref_gene")), "segment_id").select(*SPANS, "start_pos", "end_pos", "ref_gene")
    return q.select("query_id", *SPANS, "start_pos", "end_pos", F.col("gene_id").alias("own_gene")).join(genes, [*SPANS, "start_pos", "end_pos"], "left").select("query_id", F.coalesce("ref_gene", "own_gene").alias("gene_id"), F.col("ref_gene").isNotNull().alias("inherited"))


def match_candidates(q: DataFrame, r: DataFrame) -> DataFrame:
    return matcher.candidates(q, r).select("query_id", "segment_id", F.col("n_matched").cast("long"), F.round("score", 6).alias("score"))


def read_support(q: DataFrame, r: DataFrame) -> DataFrame:
    return matcher.read_support(q, r, q.select("query_id", F.col("n_exons").alias("n_reads")))


def novel_segments(q: DataFrame, r: DataFrame) -> DataFrame:
    return matcher.novel_segments(matcher.classify(q, r), q.select("query_id", F.col("n_exons").alias("n_reads")))


def presence(spark: SparkSession, folder: str) -> DataFrame:
    """Classified queries with the number of samples that carry the best segment and its summed expression."""
    q, r, s = _sides(spark, folder)
    n = s.segment_samples.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n_samples"))
    value = s.quant.groupBy("segment_id").agg(F.round(F.sum("value"), 3).alias("expression"))
    out = matcher.classify(q, r).join(n, "segment_id", "left").join(value, "segment_id", "left")
    return out.select("query_id", "segment_id", F.coalesce("n_samples", F.lit(0)).alias("n_samples"), "expression")


def _usage(s: model.Structures, spark: SparkSession, folder: str) -> DataFrame:
    groups = table(spark, folder, "sample_info").groupBy("sample_id").agg(F.min("assay").alias("sample_group"))
    return dtu.usage(s.segments.select(F.col("segment_id").alias("transcript_id"), "gene_id", "segment_id"), s.quant, groups, *GROUPS)


def dtu_props(spark: SparkSession, folder: str) -> DataFrame:
    used = _usage(model.load(spark, folder), spark, folder)
    return used.select("gene_id", "transcript_id", *(F.round(c, 6).alias(c) for c in ("prop_a", "prop_b", "delta_proportion")))


def dtu_chi2(spark: SparkSession, folder: str) -> DataFrame:
    return dtu.gene_tests(_usage(model.load(spark, folder), spark, folder)).select("gene_id", "k", F.round("chi2", 5).alias("chi2"), F.round("p_value", 6).alias("p_value"))


def dtu_fdr(spark: SparkSession, folder: str) -> DataFrame:
    tests = dtu.gene_tests(_usage(model.load(spark, folder), spark, folder))
    return dtu.corrected(tests).select("gene_id", F.round("p_value", 6).alias("p_value"), F.round("fdr", 6).alias("fdr"), "significant")


QUERIES = {
    "overlap_join": _m(overlap_pairs),
    "best_overlap_gene": _m(best_gene),
    "annotated_loci_only": _m(annotated_only),
    "gene_inheritance": gene_inheritance,
    "match_candidates": _m(match_candidates),
    "classify": _m(matcher.classify),
    "classify_summary": _m(lambda q, r: matcher.summarise(matcher.classify(q, r))),
    "known_sites": _m(matcher.site_flags),
    "novel_junctions": _m(matcher.novel_junctions),
    "ambiguous_ties": _m(matcher.ties),
    "read_support": _m(read_support),
    "novel_segments": _m(novel_segments),
    "query_presence": presence,
    "hub_fanout": _s(lambda s: hubs.hubs(s, MIN_BRANCHES)),
    "hub_samples": _s(lambda s: hubs.hub_samples(s, MIN_BRANCHES)),
    "branch_details": _s(lambda s: hubs.branch_details(s, MIN_BRANCHES)),
    "exon_numbers": _s(hubs.exon_number_of_hub),
    "ev_cassette": _s(lambda s: events.cassette(events.placed(s)).select(*events._EVENT)),
    "ev_alt_sites": _s(lambda s: events.alternative_sites(events.placed(s)).select(*events._EVENT)),
    "ev_intron_retention": _s(lambda s: events.intron_retention(events.placed(s)).select(*events._EVENT)),
    "ev_alt_terminal": _s(lambda s: events.alternative_ends(events.placed(s)).select(*events._EVENT)),
    "ev_mutex": _s(lambda s: events.mutually_exclusive(events.placed(s)).select(*events._EVENT)),
    "event_types": _s(events.event_types),
    "event_psi": _s(events.event_psi),
    "dtu_props": dtu_props,
    "dtu_chi2": dtu_chi2,
    "dtu_fdr": dtu_fdr,
}

MATCH_SQL = f"""{CORE_SQL},
q as (select transcript_id as query_id, seqid, strand, start_pos as q_start, end_pos as q_end, n_exons, gene_id as own_gene from tx where coalesce(source, '') <> '{REFERENCE}'),
r as (select * from seg where segment_id in (select segment_id from src where source = '{REFERENCE}')),
jn as (select transcript_id, n, end_pos as donor, nxt as acceptor from (select *, row_number() over w as n, lead(start_pos) over w as nxt from ex0 window w as (partition by transcript_id order by start_pos, end_pos)) where nxt is not null),
pr as (select query_id, segment_id, q_start, q_end, r.start_pos, r.end_pos, r.gene_id, q.n_exons - 1 as nq, r.n_exons - 1 as nr, strand, least(q_end, r.end_pos) - greatest(q_start, r.start_pos) as ov
       from q join r using (seqid, strand) where q_start < r.end_pos and q_end > r.start_pos),
c0 as materialized (select * from pr where ov > 0 and ov >= 50),
mt as materialized (select query_id, segment_id, count(distinct a.n) as m from c0 join jn a on a.transcript_id = query_id join jn b on b.transcript_id = segment_id and abs(a.donor - b.donor) <= 5 and abs(a.acceptor - b.acceptor) <= 5 group by 1, 2),
cd as (select c0.*, coalesce(m, 0) as n_matched, case when nq = 0 then 1.0 else coalesce(m, 0)::double / nq end as score from c0 left join mt using (query_id, segment_id)),
ti as (select query_id, segment_id from (select *, max(score) over (partition by query_id) as top from cd) where top - score < 0.001 and score >= 0.8),
kn as (select query_id, a.n, bool_or(abs(a.donor - b.donor) <= 10) as d, bool_or(abs(a.acceptor - b.acceptor) <= 10) as ac from cd join jn a on a.transcript_id = query_id left join jn b on b.transcript_id = segment_id group by 1, 2),
st as (select query_id, count(*) filter (where d) as known_donors, count(*) filter (where ac) as known_acceptors, count(*) filter (where d is not true) as novel_donors, count(*) filter (where ac is not true) as novel_acceptors from kn group by 1),
be as (select * from (select *, row_number() over (partition by query_id order by score desc, start_pos, end_pos, segment_id) as rk from cd) where rk = 1),
fl as (select be.query_id,
  exists (select 1 from jn a, jn b where a.transcript_id = be.query_id and b.transcript_id = be.segment_id and b.n = 1 and abs(a.donor - b.donor) <= 5 and abs(a.acceptor - b.acceptor) <= 5) as lo,
  exists (select 1 from jn a, jn b where a.transcript_id = be.query_id and b.transcript_id = be.segment_id and b.n = be.nr and abs(a.donor - b.donor) <= 5 and abs(a.acceptor - b.acceptor) <= 5) as hi,
  exists (select 1 from jn b where b.transcript_id = be.segment_id and q_start < b.donor and q_end > b.acceptor and not exists (select 1 from jn a where a.transcript_id = be.query_id and abs(a.donor - b.donor) <= 5 and abs(a.acceptor - b.acceptor) <= 5)) as spanned,
  exists (select 1 from ex0 e where e.transcript_id = be.segment_id and e.start_pos < q_end and e.end_pos > q_start) as exonic from be),
c1 as (select be.*, lo, hi, spanned, exonic, coalesce(known_donors, 0) as known_donors, coalesce(known_acceptors, 0) as known_acceptors, coalesce(novel_donors, 0) as novel_donors, coalesce(novel_acceptors, 0) as novel_acceptors,
  case when strand = '+' then lo else hi end as first5, case when strand = '+' then hi else lo end as last3, (select count(*) from ti where ti.query_id = be.query_id) as n_ties from be join fl using (query_id) left join st using (query_id)),
c2 as (select *, case when nq = 0 then case when exonic then 'genic_genomic' else 'genic_intron' end when score >= 0.999 and nq = nr then case when n_ties > 1 then 'ambiguous' else 'FSM' end when score >= 0.999 and nq < nr then 'ISM' when novel_donors = 0 and novel_acceptors = 0 then 'NIC' else 'NNC' end as category from c1),
cl as (select q.query_id, coalesce(category, 'intergenic') as category,
  case category when 'ISM' then case when first5 and not last3 then '5prime_fragment' when last3 and not first5 then '3prime_fragment' when not first5 and not last3 then 'internal_fragment' else 'none' end
   when 'NIC' then case when spanned then 'intron_retention' when nq > 0 and nq < nr then 'exon_skipping' else 'combination' end
   when 'NNC' then case when novel_donors > 0 and novel_acceptors > 0 then 'novel_donor_and_acceptor' when novel_donors > 0 then 'novel_donor' else 'novel_acceptor' end else 'none' end as subcategory,
  segment_id, gene_id, round(coalesce(score, 0.0), 6) as score, coalesce(n_matched, 0) as n_matched, coalesce(nq, 0) as query_junctions, coalesce(nr, 0) as ref_junctions,
  coalesce(known_donors, 0) as known_donors, coalesce(known_acceptors, 0) as known_acceptors, coalesce(novel_donors, 0) as novel_donors, coalesce(novel_acceptors, 0) as novel_acceptors from q left join c2 using (query_id))
"""

EDGE_SQL = f"""{CORE_SQL},
ed as (select segment_id, gene_id, seqid, strand, start_pos, end_pos, next_start, next_end from (select *, lead(start_pos) over w as next_start, lead(end_pos) over w as next_end from (select *, case when strand = '+' then pos else -pos end as rk from sx) window w as (partition by segment_id order by rk)) where next_start is not null),
hb as (select gene_id, seqid, strand, start_pos, end_pos, count(distinct (next_start, next_end)) as total_branches, cast(sum(n_transcripts) as bigint) as total_transcripts from ed join (select segment_id, n_transcripts from seg) using (segment_id) group by 1, 2, 3, 4, 5 having count(distinct (next_start, next_end)) >= {MIN_BRANCHES}),
hk as (select gene_id, seqid, strand, start_pos, end_pos from hb)
"""
_H = "gene_id, seqid, strand, start_pos, end_pos"

EVENT_SQL = f"""{CORE_SQL},
pl as (select *, pos = 1 or pos = n_exons as terminal, lag(start_pos || '-' || end_pos) over w as l, lead(start_pos || '-' || end_pos) over w as r, lead(start_pos) over w as nxt from sx window w as (partition by segment_id order by pos)),
inn as (select gene_id, seqid, strand, start_pos, end_pos from pl group by all having not bool_or(terminal)),
ca as (select distinct gene_id, 'cassette_exon' as event_type, l || '|' || r as key, start_pos, end_pos from pl semi join inn using (gene_id, seqid, start_pos, end_pos) where not terminal
       and exists (select 1 from pl d where d.gene_id = pl.gene_id and d.seqid = pl.seqid and d.start_pos || '-' || d.end_pos = pl.l and d.r = pl.r)),
a5 as (select gene_id, case when strand = '+' then 'alt_5prime' else 'alt_3prime' end as event_type, 'start_pos:' || start_pos as key, start_pos, end_pos from (select *, count(*) over (partition by gene_id, seqid, strand, start_pos) as k from inn) where k >= 2),
a3 as (select gene_id, case when strand = '+' then 'alt_3prime' else 'alt_5prime' end as event_type, 'end_pos:' || end_pos as key, start_pos, end_pos from (select *, count(*) over (partition by gene_id, seqid, strand, end_pos) as k from inn) where k >= 2),
nt as (select distinct gene_id, seqid, end_pos as donor, nxt as acceptor from pl where nxt > end_pos),
ir as (select nt.gene_id, 'intron_retention' as event_type, donor || '-' || acceptor as key, x.start_pos, x.end_pos from nt join (select distinct gene_id, seqid, start_pos, end_pos from sx) x on x.gene_id = nt.gene_id and x.seqid = nt.seqid and x.start_pos <= donor and x.end_pos >= acceptor),
t0 as (select distinct gene_id, seqid, strand, start_pos, end_pos, true as low from sx where pos = 1 union all select distinct gene_id, seqid, strand, start_pos, end_pos, false from sx where pos = n_exons),
alx as (select gene_id, case when low = (strand = '+') then 'alt_first_exon' else 'alt_last_exon' end as event_type, seqid || ':' || strand as key, start_pos, end_pos from (select *, count(*) over (partition by gene_id, seqid, strand, low) as k from t0) where k > 1),
bt as (select distinct gene_id, seqid, l, r, start_pos, end_pos from pl where not terminal),
mx as (select a.gene_id, 'mutually_exclusive' as event_type, a.l || '|' || a.r || '|' || b.start_pos || '-' || b.end_pos as key, a.start_pos, a.end_pos from bt a join bt b on a.gene_id = b.gene_id and a.seqid = b.seqid and a.l = b.l and a.r = b.r and (a.start_pos, a.end_pos) < (b.start_pos, b.end_pos)
       where not exists (select 1 from sx u join sx v on u.segment_id = v.segment_id and u.gene_id = a.gene_id and u.start_pos = a.start_pos and u.end_pos = a.end_pos and v.start_pos = b.start_pos and v.end_pos = b.end_pos)),
ev as (select * from ca union all select * from a5 union all select * from a3 union all select * from ir union all select * from alx union all select * from mx)
"""

DTU_SQL = f"""{CORE_SQL}, gr as (select sample_id, min(assay) as g from sample_info group by 1 having min(assay) in {GROUPS}),
mn as (select gene_id, segment_id as transcript_id, coalesce(avg(value) filter (where g = '{GROUPS[0]}'), 0) as mean_a, coalesce(avg(value) filter (where g = '{GROUPS[1]}'), 0) as mean_b from qt join gr using (sample_id) join seg using (segment_id) group by 1, 2),
us as (select *, sum(mean_a) over (partition by gene_id) as ta, sum(mean_b) over (partition by gene_id) as tb, count(*) over (partition by gene_id) as k from mn),
pp as (select *, case when ta > 0 then mean_a / ta else 0 end as prop_a, case when tb > 0 then mean_b / tb else 0 end as prop_b from us),
ch2 as (select gene_id, k, sum(case when mean_a + mean_b > 0 then pow(mean_a - (mean_a + mean_b) * ta / (ta + tb), 2) / ((mean_a + mean_b) * ta / (ta + tb)) + pow(mean_b - (mean_a + mean_b) * tb / (ta + tb), 2) / ((mean_a + mean_b) * tb / (ta + tb)) else 0 end) as chi2 from us where k >= 2 and ta > 0 and tb > 0 group by 1, 2),
zz as (select *, (pow(chi2 / (k - 1), 1.0 / 3) - (1 - 2 / (9.0 * (k - 1)))) / sqrt(2 / (9.0 * (k - 1))) / sqrt(2) as x from ch2),
tt as (select *, 1 / (1 + 0.3275911 * abs(x)) as t from zz),
ee as (select *, t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-abs(x) * abs(x)) as near from tt),
pv as (select gene_id, k, chi2, greatest(0.5 * case when x >= 0 then near else 2 - near end, 1e-300) as p_value from ee),
rk as (select *, rank() over (order by p_value) + count(*) over (partition by p_value) - 1 as r, count(*) over () as n from pv),
fd as (select *, least(1.0, min(p_value * n / r) over (order by p_value desc rows unbounded preceding)) as f0 from rk), fdr as (select *, min(f0) over (partition by p_value) as fdr from fd)
"""

ORACLE = {
    "overlap_join": f"{MATCH_SQL} select query_id, segment_id, ov as overlap from pr",
    "best_overlap_gene": f"{MATCH_SQL}, b as (select * from (select *, row_number() over (partition by query_id order by ov desc, segment_id) as k from pr) where k = 1) select q.query_id, coalesce(b.gene_id, 'novel_' || q.seqid || '_' || q.q_start) as gene_id, coalesce(ov, 0) as overlap from q left join b using (query_id)",
    "annotated_loci_only": f"{MATCH_SQL} select distinct query_id from pr",
    "gene_inheritance": f"{MATCH_SQL}, b as (select query_id, gene_id as g from (select *, row_number() over (partition by query_id order by start_pos, end_pos, segment_id) as k from pr) where k = 1) select query_id, coalesce(g, own_gene) as gene_id, g is not null as inherited from q left join b using (query_id)",
    "match_candidates": f"{MATCH_SQL} select query_id, segment_id, n_matched, round(score, 6) as score from cd",
    "classify": f"{MATCH_SQL} select * from cl",
    "classify_summary": f"{MATCH_SQL} select category, subcategory, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (), 4) as percent from cl group by 1, 2",
    "known_sites": f"{MATCH_SQL} select * from st",
    "novel_junctions": f"{MATCH_SQL} select distinct query_id, a.donor, a.acceptor from cd join jn a on a.transcript_id = query_id where not exists (select 1 from cd c join jn b on b.transcript_id = c.segment_id where c.query_id = cd.query_id and abs(a.donor - b.donor) <= 5 and abs(a.acceptor - b.acceptor) <= 5)",
    "ambiguous_ties": f"{MATCH_SQL} select * from ti",
    "read_support": f"{MATCH_SQL} select segment_id, cast(sum(n_exons) as bigint) as read_coverage from ti join q using (query_id) group by 1",
    "novel_segments": f"{MATCH_SQL} select query_id, category, subcategory, n_exons as n_reads from cl join q using (query_id) where category in ('NIC', 'NNC') and n_exons >= 3",
    "query_presence": f"{MATCH_SQL} select query_id, segment_id, coalesce(n, 0) as n_samples, expression from cl left join (select segment_id, count(*) as n from ss group by 1) using (segment_id) left join (select segment_id, round(sum(value), 3) as expression from qt group by 1) using (segment_id)",
    "hub_fanout": f"{EDGE_SQL} select * from hb",
    "hub_samples": f"""{EDGE_SQL}, us as (select {_H}, next_start, next_end, sample_id, count(*) as n from ed semi join hk using ({_H}) join ss using (segment_id) group by all),
w as (select *, count(*) over (partition by {_H}, next_start, next_end) as k, sum(n) over (partition by {_H}, sample_id) as t from us),
f as (select {_H}, sample_id, count(*) as branches, count(*) filter (where k > 1) as shared, count(*) filter (where k = 1) as "unique", round(abs(log2(max(t)) - sum(n * log2(n)) / max(t)), 4) as entropy from w group by all),
al as (select gene_id, sample_id, count(*) as al from seg join ss using (segment_id) group by 1, 2), wh as (select {_H}, sample_id, count(*) as wh from sx semi join hk using ({_H}) join ss using (segment_id) group by all)
select f.*, round(wh / al, 4) as psi from f join wh using ({_H}, sample_id) join al using (gene_id, sample_id)""",
    "branch_details": f"""{EDGE_SQL}, k as (select * from ed semi join hk using ({_H})), a as (select {_H}, next_start, next_end, count(*) as n_segments from k group by all),
b as (select {_H}, next_start, next_end, count(distinct sample_id) as n_samples from k join ss using (segment_id) group by all), c as (select {_H}, next_start, next_end, round(sum(value), 3) as expression from k join qt using (segment_id) group by all)
select {_H}, next_start, next_end, n_segments, coalesce(n_samples, 0) as n_samples, coalesce(expression, 0.0) as expression from a left join b using ({_H}, next_start, next_end) left join c using ({_H}, next_start, next_end)""",
    "exon_numbers": f"{CORE_SQL} select segment_id, seqid, strand, start_pos, end_pos, case when strand = '+' then pos else n_exons - pos + 1 end as exon_number, n_exons as total_exons from sx",
    "ev_cassette": f"{EVENT_SQL} select * from ca",
    "ev_alt_sites": f"{EVENT_SQL} select * from a5 union all select * from a3",
    "ev_intron_retention": f"{EVENT_SQL} select * from ir",
    "ev_alt_terminal": f"{EVENT_SQL} select * from alx",
    "ev_mutex": f"{EVENT_SQL} select * from mx",
    "event_types": f"{EVENT_SQL} select event_type, count(*) as n_rows, count(distinct gene_id) as n_genes, round(count(*) * 100.0 / sum(count(*)) over (), 4) as percent from ev group by 1",
    "event_psi": f"""{EVENT_SQL}, tch as (select distinct gene_id, event_type, key, segment_id from ev join (select segment_id, gene_id, start_pos, end_pos from sx) using (gene_id, start_pos, end_pos)),
inc as (select gene_id, event_type, key, sample_id, count(*) as included from tch join ss using (segment_id) group by all), tot as (select gene_id, sample_id, count(*) as total from seg join ss using (segment_id) group by all)
select gene_id, event_type, key, sample_id, coalesce(included, 0) as included, total, round(coalesce(included, 0) / total, 6) as psi from (select distinct gene_id, event_type, key from ev) join tot using (gene_id) left join inc using (gene_id, event_type, key, sample_id)""",
    "dtu_props": f"{DTU_SQL} select gene_id, transcript_id, round(prop_a, 6) as prop_a, round(prop_b, 6) as prop_b, round(prop_a - prop_b, 6) as delta_proportion from pp",
    "dtu_chi2": f"{DTU_SQL} select gene_id, k, round(chi2, 5) as chi2, round(p_value, 6) as p_value from pv",
    "dtu_fdr": f"{DTU_SQL} select gene_id, round(p_value, 6) as p_value, round(fdr, 6) as fdr, fdr <= 0.05 as significant from fdr",
}

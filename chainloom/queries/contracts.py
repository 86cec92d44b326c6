"""Queries of the reports with all their columns; their SQL is put together from that of the figures in them."""

from __future__ import annotations

from ..operators import contracts, matcher, model
from . import matching, structure
from .structure import CORE_SQL, FRACTION


def _s(fn):
    return lambda spark, folder: fn(model.load(spark, folder))


def _classified(fn):
    return lambda spark, folder: fn(matcher.classify(*matching._sides(spark, folder)[:2]))


def _query_report(spark, folder):
    q, r, s = matching._sides(spark, folder)
    return contracts.queried(s, matcher.classify(q, r))


QUERIES = {
    "per_sample_report": _s(lambda s: contracts.per_sample(s, FRACTION)),
    "exon_sharing_report": _s(lambda s: contracts.exon_sharing(s, FRACTION)),
    "conserved_segment_report": _s(lambda s: contracts.conserved_segments(s, FRACTION)),
    "conserved_exon_report": _s(lambda s: contracts.conserved_exons(s, FRACTION)),
    "event_report": _s(contracts.splicing_events),
    "query_report": _query_report,
    "category_table": _classified(contracts.category_table),
    "fragment_table": _classified(contracts.fragment_table),
}

_O = structure.ORACLE
_M = matching.ORACLE
_JUDGED = f"({CORE_SQL}, {structure._EXS}, {structure._FIRST}, {structure._USE} select seqid, strand, start_pos, end_pos, sample_id, n_with >= n_segments as constitutive from fv join us using (gene_id, seqid, strand, start_pos, end_pos) join xs using (seqid, strand, start_pos, end_pos) where v = 1)"
_GENES = f"({CORE_SQL} select gene_id, gene_name, gene_biotype from gn)"
_KEPT = f"({CORE_SQL} select distinct sample_id, gene_id from ss join seg using (segment_id))"
_CLASSED = f"({CORE_SQL}, {structure._EXS}, sh as (select xs.*, {structure._SHARE} as share from xs join (select seqid, strand, start_pos, end_pos, count(*) as k from xs group by 1, 2, 3, 4) using (seqid, strand, start_pos, end_pos)) select * from sh)"

ORACLE = {
    "per_sample_report": f"""
select a.sample_id, coalesce(a.id, a.sample_id::varchar) as sample, a.kind as type, a.genes, a.total as segments, a.exclusive as exclusive_segments, a.shared as shared_segments, a.conserved as conserved_segments, a.transcripts_touched, a.single_exon_segments,
  coalesce(b.total, 0) as exons, coalesce(b.exclusive, 0) as exclusive_exons, coalesce(b.shared, 0) as shared_exons, coalesce(b.conserved, 0) as conserved_exons, coalesce(constitutive_exons, 0) as constitutive_exons, coalesce(alternative_exons, 0) as alternative_exons,
  coalesce(h, 0.0) as mean_gene_exon_entropy, coalesce(i, 0.0) as mean_effective_isoforms, coalesce(expressed_segments, 0) as expressed_segments, coalesce(m, 0.0) as mean_expression
from ({_O['per_sample']}) a left join ({_O['exon_sharing']}) b using (sample_id)
left join (select sample_id, count(*) filter (where constitutive) as constitutive_exons, count(*) filter (where not constitutive) as alternative_exons from {_JUDGED} group by 1) c using (sample_id)
left join (select sample_id, round(avg(exon_entropy), 3) as h, round(avg(effective_isoforms), 2) as i from {_KEPT} join ({_O['gene_diversity']}) using (gene_id) group by 1) d using (sample_id)
left join (select sample_id, count(*) as expressed_segments, round(avg(value), 3) as m from ({CORE_SQL} select * from qt) group by 1) e using (sample_id)""",
    "exon_sharing_report": f"""
select metric, total, sample_id, n from (select metric, sample_id, count(*) as n from (select 'total' as metric, sample_id from {_CLASSED} union all select share, sample_id from {_CLASSED} union all select case when constitutive then 'constitutive' else 'alternative' end, sample_id from {_JUDGED}) group by 1, 2)
join (select metric, count(*) as total from (select distinct 'total' as metric, seqid, strand, start_pos, end_pos from {_CLASSED} union all select distinct share, seqid, strand, start_pos, end_pos from {_CLASSED}
  union all select distinct case when constitutive then 'constitutive' else 'alternative' end, seqid, strand, start_pos, end_pos from {_JUDGED}) group by 1) using (metric)""",
    "conserved_segment_report": f"""select segment_id, c.gene_id, g.gene_name, g.gene_biotype, split_part(coordinate, ':', 1) as chromosome, coordinate, n_exons as exon_count, n_transcripts, n_samples, sources from ({_O['conserved_segments']}) c left join {_GENES} g using (gene_id)""",
    "conserved_exon_report": f"""select coordinate as exon_id, g.gene_name, c.gene_id, split_part(coordinate, ':', 1) as chromosome, coordinate, n_transcripts, n_samples from ({_O['conserved_exons']}) c left join {_GENES} g using (gene_id)""",
    "event_report": f"""{matching.EVENT_SQL}, pe as (select gene_id, start_pos, end_pos, min(seqid) as seqid, min(strand) as strand from sx group by 1, 2, 3),
gv as (select gene_id, event_type, key, min(seqid) as chromosome, min(strand) as strand, string_agg(start_pos || '-' || end_pos, ',' order by start_pos, end_pos) as x from (select distinct * from ev) left join pe using (gene_id, start_pos, end_pos) group by 1, 2, 3),
fk as (select *, case when event_type in ('cassette_exon', 'mutually_exclusive') then split_part(key, '|', 1) end as lo, case when event_type in ('cassette_exon', 'mutually_exclusive') then split_part(key, '|', 2) end as hi from gv)
select fk.gene_id, gn.gene_name, event_type, key, chromosome, case when strand = '+' then lo else hi end as upstream_exon, case when strand = '+' then hi else lo end as downstream_exon, case when event_type = 'mutually_exclusive' then x || ',' || split_part(key, '|', 3) else x end as affected_exons from fk left join gn using (gene_id)""",
    "query_report": f"""select query_id as transcript_id, segment_id, c.gene_id, g.gene_name, category as structural_category, subcategory, score as junction_match_score, n_matched as matching_junctions, query_junctions, ref_junctions, known_donors, known_acceptors, novel_donors, novel_acceptors, coalesce(k, 0) as n_samples
from ({_M['classify']}) c left join {_GENES} g using (gene_id) left join ({CORE_SQL} select segment_id, count(*) as k from ss group by 1) using (segment_id)""",
    "category_table": f"""select gene_id, category, n, round(n / sum(n) over (partition by gene_id), 6) as share from (select gene_id, category, count(*) as n from ({_M['classify']}) where gene_id is not null group by 1, 2)""",
    "fragment_table": f"""select *, case when n_fsm > 0 then round(n_ism / n_fsm, 6) end as ism_fsm_ratio from (select segment_id, count(*) filter (where category <> 'ISM') as n_fsm, count(*) filter (where category = 'ISM') as n_ism, round(avg(query_junctions / ref_junctions) filter (where category = 'ISM'), 6) as mean_retained,
  cast(coalesce(sum(ref_junctions - query_junctions) filter (where category = 'ISM'), 0) as bigint) as missing_junctions from ({_M['classify']}) where category in ('ISM', 'FSM', 'ambiguous') group by 1)""",
}

"""SQL for the queries whose operators go step by step: absorption and read clustering.

The relations between pairs of structures do not depend on the order of arrival
and are computed for all pairs at once; a recursive query then takes one arrival
of every locus per step and keeps the live structures of each locus as a list.
Clustering takes one seed of every run per step.
"""

from __future__ import annotations

from .structure import CORE_SQL

_RECURSIVE = CORE_SQL.replace("with tx0", "with recursive tx0", 1)

#: Arrivals in order (``ar``), with what each is to others of its locus, the outcome of each step (``st``), and where each ends (``fin``).
ABSORB_SQL = f"""{_RECURSIVE},
fl as (select sample_id, kind = 'annotation' as strict, kind = 'annotation' or named as loose from sm),
t0 as (select tx.*, coalesce(fl.strict, false) as strict, coalesce(fl.loose, false) as loose from tx left join fl using (sample_id)),
sh as (select structure, min(seqid) as seqid, min(strand) as strand, min(start_pos) as s, min(end_pos) as e, min(n_exons) as n, bool_or(loose) as loose, min(transcript_id) as seg,
  arg_min({{'g': gene_id, 'strict': strict}}, (not loose, coalesce(sample_id, 2147483647), gene_id, -n_exons, transcript_id)) as f, min((not loose, coalesce(sample_id, 2147483647), gene_id, -n_exons, transcript_id)) as ord from t0 group by structure),
lo as (select *, sum(case when before is null or s > before then 1 else 0 end) over (partition by seqid, strand order by s, e, structure rows unbounded preceding) as island
  from (select *, max(e) over (partition by seqid, strand order by s, e, structure rows between unbounded preceding and 1 preceding) as before from sh)),
ar as materialized (select seqid || strand || island as locus, row_number() over (partition by seqid, strand, island order by ord, structure) as k, structure, seg, strand, s, e, n, f.g as gene, f.strict as strict, loose from lo),
ax as materialized (select locus, k, structure, ar.strand, n, pos, x.start_pos as xs, x.end_pos as xe from ar join sx x on x.segment_id = ar.seg),
al as (select c.locus, c.k as c, p.k as p, c.n as nc, p.n as np, p.pos - 1 as off, c.strand from ax c join ax p on c.locus = p.locus and c.k <> p.k and c.pos = 1 and abs(c.xs - p.xs) <= 5 and abs(c.xe - p.xe) <= 5 where c.n >= 2 and p.pos - 1 + c.n <= p.n),
mt as (select al.locus, al.c, al.p, al.nc, al.np, al.off, al.strand, bool_and(x.xs = y.xs and x.xe = y.xe) as exact from al join ax x on x.locus = al.locus and x.k = al.c join ax y on y.locus = al.locus and y.k = al.p and y.pos = x.pos + off
  where abs(x.xs - y.xs) <= 5 and abs(x.xe - y.xe) <= 5 group by all having count(*) = al.nc),
m1 as (select locus, c, p, nc, np, arg_min(off, (not (exact and nc < np), case when strand = '+' then off else -off end)) as low, any_value(strand) as strand from mt group by 1, 2, 3, 4, 5),
rl as (select locus, c, p, np, case when nc = np then 'fsm' when five = 0 then 'ism5' when three = 0 then case when five <= 2 then 'ism3' else 'degraded' end else 'internal' end as kind
  from (select *, case when strand = '+' then low else np - nc - low end as five, case when strand = '+' then np - nc - low else low end as three from m1)),
tk as (select locus, k, n, min(case when pos = 1 then xs end) as os, max(case when pos = n then xe end) as oe, string_agg(case when pos = 1 then 'x' else xs::varchar end || '-' || case when pos = n then 'x' else xe::varchar end, ',' order by pos) as key from ax where n >= 2 group by 1, 2, 3),
tv as (select a.locus, a.k as c, b.k as p from tk a join tk b on a.locus = b.locus and a.k <> b.k and a.n = b.n and a.key = b.key and abs(a.os - b.os) <= 50 and abs(a.oe - b.oe) <= 50),
mo as (select ar.locus, ar.k as c, x.k as p, bool_or(y.k is not null and ar.s < x.xe and ar.e > y.xs) as ir, bool_or(ar.s < x.xe and ar.e > x.xs) as ov from ar join ax x on x.locus = ar.locus and x.n > 1 left join ax y on y.locus = x.locus and y.k = x.k and y.pos = x.pos + 1 where ar.n = 1 group by 1, 2, 3),
pr as (select locus, c, p, bool_or(t) as term, max(kind) as kind, max(np) as np from (select locus, c, p, true as t, null as kind, null as np from tv union all select locus, c, p, false, kind, np from rl) group by 1, 2, 3),
li as (select pr.locus, c as k, list({{'s': b.s, 'e': b.e, 'a': p}}) filter (where term) as terms, list({{'s': b.s, 'e': b.e, 'a': p}}) filter (where kind = 'fsm') as fsm, list({{'m': -np, 's': b.s, 'e': b.e, 'a': p, 'kind': kind}}) filter (where kind in ('ism3', 'degraded', 'internal')) as parents
  from pr join ar b on b.locus = pr.locus and b.k = p group by 1, 2),
lb as (select locus, p as k, list(c) filter (where term or kind in ('fsm', 'ism3')) as takes, list(c) filter (where not term and kind in ('degraded', 'internal')) as drops from pr group by 1, 2),
lm as (select locus, c as k, list(p) filter (where ir) as irs, list(p) filter (where ov) as ovs from mo group by 1, 2),
aa as materialized (select ar.*, coalesce(terms, []) as terms, coalesce(fsm, []) as fsm, coalesce(parents, []) as parents, coalesce(takes, []) as takes, coalesce(drops, []) as drops, coalesce(irs, []) as irs, coalesce(ovs, []) as ovs
  from ar left join li using (locus, k) left join lb using (locus, k) left join lm using (locus, k)),
st as (
  select locus, 0::bigint as k, []::struct(s bigint, e bigint, a bigint, gene varchar, loose boolean)[] as live, null::varchar as decision, null::bigint as target, null::varchar as gene, []::struct(a bigint, "into" bigint)[] as gone from (select distinct locus from aa)
  union all
  select locus, k, case when decision like 'merged%' then case when loose then list_transform(live, lambda x: {{'s': x.s, 'e': x.e, 'a': x.a, 'gene': x.gene, 'loose': x.loose or x.a = target}}) else live end
      when decision = 'created' then list_sort(list_append(list_filter(live, lambda x: not list_contains(out, x.a)), {{'s': s, 'e': e, 'a': k, 'gene': gene, 'loose': loose or len(list_filter(live, lambda x: x.loose and list_contains(taken, x.a))) > 0}})) else live end,
    decision, target, gene, case when decision = 'created' then list_transform(out, lambda a: {{'a': a, 'into': case when list_contains(taken, a) then k end}}) else [] end
  from (
    select *, case when term is not null then term.a when decision = 'merged_fuzzy' then fuzzy.a when decision = 'merged_3prime' then best.a when decision = 'created' then k end as target,
      case when strict then own else coalesce(list_filter(lv, lambda x: x.loose)[1].gene, lv[1].gene, own) end as gene, list_filter(takes, lambda a: list_contains(ids, a)) as taken,
      list_concat(list_filter(takes, lambda a: list_contains(ids, a)), case when loose then list_filter(drops, lambda a: list_contains(ids, a)) else [] end) as out
    from (
      select *, case when term is not null then 'merged_terminal'
          when n = 1 and not strict and len(list_filter(irs, lambda a: list_contains(ids, a))) = 0 then case when len(list_filter(ovs, lambda a: list_contains(ids, a))) > 0 then 'dropped_mono_gene_overlap' else 'dropped_mono_intergenic' end
          when fuzzy is not null then 'merged_fuzzy' when best.kind = 'ism3' then 'merged_3prime'
          when best is not null and len(list_filter(live, lambda x: x.a = best.a and x.loose)) > 0 then 'dropped_' || best.kind else 'created' end as decision
      from (
        select *, list_sort(list_filter(terms, lambda x: list_contains(ids, x.a)))[1] as term, list_sort(list_filter(fsm, lambda x: list_contains(ids, x.a)))[1] as fuzzy, list_sort(list_filter(parents, lambda x: list_contains(ids, x.a)))[1] as best
        from (
          select *, list_transform(lv, lambda x: x.a) as ids from (
            select aa.locus, aa.k, aa.s, aa.e, aa.n, aa.gene as own, aa.strict, aa.loose, terms, fsm, parents, takes, drops, irs, ovs, st.live, list_filter(st.live, lambda x: x.s < aa.e and x.e > aa.s) as lv
            from st join aa on aa.locus = st.locus and aa.k = st.k + 1))))) ),
go as materialized (select locus, unnest(gone, recursive := true) from st),
ed as (select locus, k, k as last_k from st where decision = 'created' union all select ed.locus, ed.k, go."into" from ed join go on go.locus = ed.locus and go.a = ed.last_k where go."into" is not null),
la as (select locus, k, max(last_k) as last_k from ed group by 1, 2),
fin as materialized (select ar.structure, st.decision, x.structure as end_structure, dead.a is not null as lost, g.gene as end_gene, st.gene, self.a is not null as absorbed from st join ar using (locus, k)
  left join la on la.locus = st.locus and la.k = st.target left join ar x on x.locus = la.locus and x.k = la.last_k left join st g on g.locus = la.locus and g.k = la.last_k
  left join go dead on dead.locus = la.locus and dead.a = la.last_k left join go self on self.locus = st.locus and self.a = st.k and st.decision = 'created'),
dec as (select t0.transcript_id, t0.structure, t0.sample_id, case when fin.decision = 'created' and t0.transcript_id <> sh.seg then 'merged_exact' else fin.decision end as decision, case when lost then null else end_structure end as target, coalesce(end_gene, gene) as gene_id
  from t0 join fin using (structure) join sh using (structure))
"""

ORACLE = {
    "absorb_decisions": f"{ABSORB_SQL} select * from dec",
    "absorb_counters": f"""{ABSORB_SQL} select 'input' as outcome, count(*) as n from dec union all select 'merged', count(*) from dec where decision like 'merged%' union all select 'discarded', count(*) from dec where decision like 'dropped%'
union all select 'absorbed', count(*) from fin where absorbed union all select 'scaffold', 0""",
    "absorb_segments": f"{ABSORB_SQL} select target as structure, count(*) as n_transcripts, count(distinct sample_id) as n_samples, any_value(fin.gene) as gene_id from dec join fin on fin.structure = target where target is not null group by 1",
}

#: Reads (``rd``: transcripts as reads) with their cluster (``cu``) and the clusters (``cb``).
CLUSTER_SQL = f"""{_RECURSIVE},
jn as (select transcript_id, n, end_pos as d, nxt as a from (select *, row_number() over w as n, lead(start_pos) over w as nxt from ex0 window w as (partition by transcript_id order by start_pos, end_pos)) where nxt is not null),
js as (select transcript_id, count(*) as nj, string_agg(d || '-' || a, ',' order by n) as shape, list({{'d': d, 'a': a}} order by n) as js from jn group by 1),
rd as (select tx.transcript_id as read_id, seqid, strand, start_pos, end_pos, n_exons as mapq, coalesce(nj, 0) as nj, coalesce(shape, start_pos::varchar) as shape, coalesce(js, [{{'d': start_pos, 'a': start_pos}}]) as js from tx left join js using (transcript_id)),
dt as (select seqid, strand, nj, shape, min(js[1].d) as anchor, min(start_pos) as first_start, any_value(js) as js, any_value(case when nj = 0 then 100 else 5 end) as tol from rd group by 1, 2, 3, 4),
ru as (select *, sum(case when before is null or anchor > before then 1 else 0 end) over (partition by seqid, strand, nj order by anchor, first_start, shape rows unbounded preceding) as run
  from (select *, max(anchor + tol) over (partition by seqid, strand, nj order by anchor, first_start, shape rows between unbounded preceding and 1 preceding) as before from dt)),
sw as (
  select seqid, strand, nj, run, any_value(tol) as tol, list({{'shape': shape, 'js': js}} order by anchor, first_start, shape) as rest, null::varchar as seed, []::varchar[] as claimed from ru group by 1, 2, 3, 4
  union all
  select seqid, strand, nj, run, tol, list_filter(rest, lambda x: not list_contains(mine, x.shape)), rest[1].shape, mine from (
    select *, list_transform(list_filter(rest, lambda x: len(list_filter(range(1, len(x.js) + 1), lambda i: abs(x.js[i].d - rest[1].js[i].d) <= tol and abs(x.js[i].a - rest[1].js[i].a) <= tol)) = len(x.js)), lambda x: x.shape) as mine from sw where len(rest) > 0)),
cl as (select seqid, strand, nj, seed, unnest(claimed) as shape from sw where seed is not null),
cu as (select rd.*, concat_ws('|', seqid, strand, nj, seed) as cluster_key from rd join cl using (seqid, strand, nj, shape)),
cb as (select cluster_key, seqid, strand, nj as n_junctions, min(start_pos) as start_pos, max(end_pos) as end_pos, count(*) as n_reads, arg_min(read_id, (-mapq, start_pos - end_pos, read_id)) as representative_read, round(avg(mapq), 6) as mean_mapq from cu group by 1, 2, 3, 4)
"""

ORACLE |= {
    "read_clusters": f"{CLUSTER_SQL} select seqid || '_' || strand || '_' || start_pos || '_' || end_pos || '_n' || n_reads as cluster_id, * exclude (cluster_key) from cb",
    "consensus_junctions": f"""{CLUSTER_SQL}, me as (select cluster_key, n, cast(floor(avg(d) + 0.5) as bigint) || '-' || cast(floor(avg(a) + 0.5) as bigint) as j from cu join jn on jn.transcript_id = read_id group by 1, 2)
select cluster_key, string_agg(j, ',' order by n) as junctions from me group by 1""",
    "cluster_statistics": f"{CLUSTER_SQL} select count(*) as clusters, cast(sum(n_reads) as bigint) as reads, count(*) filter (where n_junctions > 0) as multi_exon, count(*) filter (where n_junctions = 0) as single_exon, max(n_reads) as max_size, round(avg(n_reads), 4) as mean_size from cb",
}

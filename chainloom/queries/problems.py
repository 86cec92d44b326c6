"""Queries of the general data problems, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import gene_key, sequence_key
from ..operators import drift, heavy_keys, periods, rejects
from ..plans.tables import table

#: Least share of a table's rows, in percent, that makes a key heavy.
HEAVY_PERCENT = 4


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    genes = heavy_keys.keys_above_share(table(spark, folder, "gtf_transcript"), gene_key(F.col("gene_id")), HEAVY_PERCENT)
    seqs = heavy_keys.keys_above_share(table(spark, folder, "gtf_gene"), sequence_key(F.col("seqid")), HEAVY_PERCENT)
    return genes.select(F.lit("gtf_transcript.gene_id").alias("key_field"), "key_text").unionByName(seqs.select(F.lit("gtf_gene.seqid").alias("key_field"), "key_text"))


def p1_transcripts_per_gene(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "gtf_transcript")
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.min("start_pos").alias("min_start"), F.max("end_pos").alias("max_end"), F.sum(F.col("exon_count").cast("long")).alias("sum_exons")]
    return heavy_keys.key_profile(t, gene_key(F.col("gene_id")), aggs, {"n_transcripts": F.col("transcript_id"), "n_samples": F.col("sample_id")})


def p1_genes_per_sequence(spark: SparkSession, folder: str) -> DataFrame:
    g = table(spark, folder, "gtf_gene")
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.min("start_pos").alias("min_start"), F.max("end_pos").alias("max_end"), F.count_if(F.col("strand") == "-").alias("n_minus")]
    return heavy_keys.key_profile(g, sequence_key(F.col("seqid")), aggs, {"n_genes": gene_key(F.col("gene_id"))})


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    gtf = rejects.rejected(rejects.judge_gtf(table(spark, folder, "raw_gtf")))
    manifest = rejects.rejected(rejects.judge_manifest(table(spark, folder, "raw_manifest")))
    return gtf.select(F.lit("raw_gtf").alias("raw_table"), "line_id", "reason").unionByName(manifest.select(F.lit("raw_manifest").alias("raw_table"), "line_id", "reason"))


def p2_loaded_gtf(spark: SparkSession, folder: str) -> DataFrame:
    loaded = rejects.loaded_gtf(rejects.judge_gtf(table(spark, folder, "raw_gtf")))
    return loaded.select("line_id", "seqid", "source", "entry_type", "start_pos", "end_pos", "strand", "gene_id", "transcript_id", F.size("attribute_names").cast("long").alias("n_attributes"))


def p2_loaded_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return rejects.loaded_manifest(rejects.judge_manifest(table(spark, folder, "raw_manifest"))).select("line_id", "source_file", "entry_type")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return drift.changes(table(spark, folder, "feed_file"), table(spark, folder, "feed_record")).select("file_id", "change_kind", "old_field", "new_field")


def p4_unified(spark: SparkSession, folder: str) -> DataFrame:
    return drift.unified(table(spark, folder, "feed_file"), table(spark, folder, "feed_record"))


def _exons(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "gtf_exon")
    return e.select(sequence_key(F.col("seqid")).alias("seqid"), gene_key(F.col("gene_id")).alias("gene_id"), "start_pos", "end_pos")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return periods.gaps(_exons(spark, folder), ["seqid", "gene_id"], "start_pos", "end_pos")


def p5_periods(spark: SparkSession, folder: str) -> DataFrame:
    return periods.periods(_exons(spark, folder), ["seqid", "gene_id"], "start_pos", "end_pos")


QUERIES = {f.__name__: f for f in (p1_found, p1_transcripts_per_gene, p1_genes_per_sequence, p2_found, p2_loaded_gtf, p2_loaded_manifest, p4_found, p4_unified, p5_found, p5_periods)}

_BLANKS = r"' ' || chr(9) || chr(13) || chr(10) || chr(160)"
GENE_KEY_SQL = f"nullif(regexp_replace(trim(gene_id, {_BLANKS}), '\\.[0-9]+$', ''), '')"
SEQ_KEY_SQL = f"nullif(case when trim(seqid, {_BLANKS}) like 'chr%' then trim(seqid, {_BLANKS}) when trim(seqid, {_BLANKS}) = 'MT' then 'chrM' when regexp_full_match(trim(seqid, {_BLANKS}), '[0-9]+|X|Y|M') then 'chr' || trim(seqid, {_BLANKS}) else trim(seqid, {_BLANKS}) end, '')"

_EXONS_SQL = f"select distinct {SEQ_KEY_SQL} as seqid, {GENE_KEY_SQL} as gene_id, start_pos, end_pos from gtf_exon"
_COVER_SQL = f"""
with e as ({_EXONS_SQL}), ok as (select * from e where seqid is not null and gene_id is not null and start_pos <= end_pos),
m as (select *, max(end_pos) over (partition by seqid, gene_id order by start_pos, end_pos rows between unbounded preceding and 1 preceding) as before from ok)
"""

ORACLE = {
    "p1_found": f"""
with t as (select {GENE_KEY_SQL} as k from gtf_transcript), g as (select {SEQ_KEY_SQL} as k from gtf_gene)
select 'gtf_transcript.gene_id' as key_field, k as key_text from t where k is not null group by k having count(*) * 100 >= {HEAVY_PERCENT} * (select count(*) from t)
union all
select 'gtf_gene.seqid', k from g where k is not null group by k having count(*) * 100 >= {HEAVY_PERCENT} * (select count(*) from g)""",
    "p1_transcripts_per_gene": f"""
select {GENE_KEY_SQL} as key_text, count(*) as n_rows, min(start_pos) as min_start, max(end_pos) as max_end, cast(sum(exon_count) as bigint) as sum_exons,
       count(distinct transcript_id) as n_transcripts, count(distinct sample_id) as n_samples
from gtf_transcript where {GENE_KEY_SQL} is not null group by 1""",
    "p1_genes_per_sequence": f"""
select {SEQ_KEY_SQL} as key_text, count(*) as n_rows, min(start_pos) as min_start, max(end_pos) as max_end, count(*) filter (where strand = '-') as n_minus, count(distinct {GENE_KEY_SQL}) as n_genes
from gtf_gene where {SEQ_KEY_SQL} is not null group by 1""",
    "p5_found": f"{_COVER_SQL} select seqid, gene_id, before + 1 as gap_start, start_pos - 1 as gap_end from m where start_pos > before + 1",
    "p5_periods": f"""{_COVER_SQL}, i as (select *, sum(case when before is null or start_pos > before + 1 then 1 else 0 end) over (partition by seqid, gene_id order by start_pos, end_pos rows unbounded preceding) as island from m)
select seqid, gene_id, min(start_pos) as period_start, max(end_pos) as period_end from i group by seqid, gene_id, island""",
}

_PAIR_SQL = r"""([^\s";]+)\s+("[^"]*"|[A-Za-z0-9_.:-]+)"""
_P2_SQL = rf"""
with g0 as (select line_id, regexp_replace(line, chr(13) || '$', '') as line from raw_gtf), g1 as (select line_id, string_split(line, chr(9)) as c from g0 where regexp_matches(line, '\S') and line not like '#%'),
g2 as (select line_id, c as cells, len(c) as n, c[3] as kind, c[4] as s, c[5] as e, c[7] as strand, coalesce(c[9], '') as a from g1),
g3 as (select *, regexp_full_match(a, '\s*{_PAIR_SQL}(\s*;\s*{_PAIR_SQL})*\s*;?\s*') as ok, regexp_extract_all(a, '{_PAIR_SQL}', 1) as ks, list_transform(regexp_extract_all(a, '{_PAIR_SQL}', 2), lambda v: trim(trim(v, '"'))) as vs, list_transform(regexp_extract_all(a, '{_PAIR_SQL}', 2), lambda v: case when v[1] = '"' then v[2:-2] else v end) as raw from g2),
g4 as (select line_id, cells, ks, raw, s, e, strand, kind, case when n <> 9 then 'columns' when not ok then 'quoting'
  when not (regexp_full_match(s, '[0-9]+') and regexp_full_match(e, '[0-9]+')) or try_cast(s as hugeint) < 1 or try_cast(s as hugeint) > try_cast(e as hugeint) or strand not in ('+', '-', '.') then 'value'
  when coalesce(vs[list_position(ks, 'gene_id')], '') in ('', '.') or (kind in ('transcript', 'exon') and coalesce(vs[list_position(ks, 'transcript_id')], '') in ('', '.')) then 'value' end as reason from g3),
m0 as (select line_id, file_name, line_no, regexp_replace(line, chr(13) || '$', '') as line from raw_manifest), m1 as (select * from m0 where regexp_matches(line, '\S') and line not like '#%'),
m2 as (select *, first_value(line) over w as head, row_number() over w as nth from m1 window w as (partition by file_name order by line_no, line_id)),
m3 as (select line_id, list_transform(string_split(lower(head), chr(9)), lambda h: trim(h)) as hs, string_split(line, chr(9)) as c from m2 where nth > 1),
m4 as (select *, list_transform(c, lambda v: case when regexp_full_match(v, '"([^"]|"")*"') then trim(replace(v[2:-2], '""', '"')) else trim(v) end) as vs from m3),
m5 as (select line_id, hs, vs, case when len(hs) <> len(c) then 'columns' when len(list_filter(c, lambda v: contains(v, '"') and not regexp_full_match(v, '"([^"]|"")*"'))) > 0 then 'quoting'
  when not regexp_matches(lower(coalesce(vs[list_position(hs, 'file')], '')), '\.(gtf|gff|gff3|bam|sam)(\.gz)?$') or lower(coalesce(vs[list_position(hs, 'type')], '')) not in ('sample', 'annotation', 'replicate', '.', '') then 'value' end as reason from m4)"""
ORACLE["p2_found"] = f"""{_P2_SQL}
select 'raw_gtf' as raw_table, line_id, reason from g4 where reason is not null union all select 'raw_manifest', line_id, reason from m5 where reason is not null"""
ORACLE["p2_loaded_gtf"] = f"""{_P2_SQL} select line_id, cells[1] as seqid, cells[2] as source, kind as entry_type, try_cast(s as bigint) as start_pos, try_cast(e as bigint) as end_pos, strand,
  raw[list_position(ks, 'gene_id')] as gene_id, raw[list_position(ks, 'transcript_id')] as transcript_id, len(ks) as n_attributes from g4 where reason is null"""
ORACLE["p2_loaded_manifest"] = f"""{_P2_SQL} select line_id, vs[list_position(hs, 'file')] as source_file, case when lower(coalesce(vs[list_position(hs, 'type')], '')) in ('', '.') then 'sample' else lower(vs[list_position(hs, 'type')]) end as entry_type from m5 where reason is null"""
_P4_SQL = f"""
with recursive f as (select file_id, lag(file_id) over (partition by provider, feature_kind order by delivered_at, file_id) as prev from feed_file),
k as (select record_id, file_id, rec_key, payload, unnest(json_keys(payload)) as field from feed_record),
l as (select file_id, rec_key, field, case json_type(payload, '$."' || field || '"') when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array' when 'OBJECT' then 'object' when 'NULL' then null else 'number' end as kind, json_extract_string(payload, '$."' || field || '"') as v from k),
s as (select file_id, field, coalesce(string_agg(distinct kind, ',' order by kind), '') as kinds from l group by 1, 2),
d as (select f.file_id, prev, field, now.kinds as now, was.kinds as was from (select file_id, prev, field from f join s using (file_id) where prev is not null union select f.file_id, prev, field from f join s on s.file_id = prev) f
      left join s now using (file_id, field) left join (select file_id as prev, field, kinds from s) was using (prev, field)),
c as (select o.file_id, o.field as old_field, n.field as new_field, count(*) as n, count(*) filter (where a.v = b.v) as same from d o join d n on o.file_id = n.file_id and o.now is null and n.was is null
      join l a on a.file_id = o.prev and a.field = o.field and a.v is not null and a.kind is not null join l b on b.file_id = n.file_id and b.field = n.field and b.rec_key = a.rec_key and b.v is not null and b.kind is not null group by 1, 2, 3),
b as (select *, row_number() over (partition by file_id, old_field order by same / n desc, n desc, new_field) as ro, row_number() over (partition by file_id, new_field order by same / n desc, n desc, old_field) as rn from c where same * 10 >= n * {drift.RENAME_TENTHS}),
r as (select file_id, old_field, new_field from b where ro = 1 and rn = 1)
"""
ORACLE["p4_found"] = f"""{_P4_SQL}
select file_id, 'renamed' as change_kind, old_field, new_field from r
union all select r.file_id, 'type_changed', old_field, new_field from r join d o on o.file_id = r.file_id and o.field = old_field join (select file_id as fid, field as nf, now as nn from d) n on fid = r.file_id and nf = new_field where o.was <> '' and nn <> '' and o.was <> nn
union all select file_id, 'removed', field, '' from d where now is null and (file_id, field) not in (select file_id, old_field from r)
union all select file_id, 'added', '', field from d where was is null and (file_id, field) not in (select file_id, new_field from r)
union all select file_id, 'type_changed', field, field from d where now <> '' and was <> '' and now <> was"""
ORACLE["p4_unified"] = f"""{_P4_SQL},
ed as (select distinct feature_kind, old_field as a, new_field as b from r join feed_file using (file_id)), bo as (select feature_kind, a, b from ed union select feature_kind, b, a from ed),
rc as (select feature_kind, a as field, a as other from bo union select rc.feature_kind, field, b from rc join bo on bo.feature_kind = rc.feature_kind and bo.a = rc.other), nm as (select feature_kind, field, min(other) as name from rc group by 1, 2),
va as (select feature_kind, k.file_id, record_id, rec_key, coalesce(name, k.field) as name, case json_type(payload, '$."' || k.field || '"') when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array' when 'OBJECT' then 'object' when 'NULL' then null else 'number' end as value_kind,
  json_extract_string(payload, '$."' || k.field || '"') as raw from k join feed_file using (file_id) left join nm using (feature_kind, field)),
ty as (select feature_kind, name, count(distinct value_kind) as k, bool_or(value_kind in ('array', 'object')) as deep, min(value_kind) as one from va group by 1, 2),
un as (select feature_kind, file_id, record_id, rec_key, name, case when k = 0 then 'null' when k = 1 then one when deep then 'variant' else 'string' end as kind, value_kind,
  case when value_kind is null then null when value_kind = 'number' then regexp_replace(cast(cast(raw as decimal(38, 9)) as varchar), '\\.?0+$', '') else raw end as text, raw from va join ty using (feature_kind, name))
select feature_kind, file_id, record_id, rec_key, name, kind, value_kind, text, case when kind = 'number' then try_cast(raw as double) end as number, case when kind = 'boolean' then try_cast(raw as boolean) end as truth from un
union all select feature_kind, file_id, record_id, rec_key, null, null, null, null, null, null from feed_record join feed_file using (file_id) where coalesce(len(json_keys(payload)), 0) = 0"""

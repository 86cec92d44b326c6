"""Queries of index building, expression merging, clustering, export and file parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import expression_value, junctions, parse_region
from ..operators import absorb, clusters, model, quant, summary
from ..plans.tables import table
from ..sources import gtf
from . import folds, structure
from .structure import CORE_SQL

REGION = "chr1:2000000-4000000"
LEAST_COVERAGE = 10.0


def _s(fn):
    return lambda spark, folder: fn(model.load(spark, folder))


def _decided(s: model.Structures) -> DataFrame:
    return absorb.decide(s.transcripts, s.samples)


def absorb_decisions(s: model.Structures) -> DataFrame:
    return absorb.transcript_decisions(s.transcripts, _decided(s))


def absorb_counters(s: model.Structures) -> DataFrame:
    return absorb.fold_counters(_decided(s))


def absorb_segments(s: model.Structures) -> DataFrame:
    return absorb.live_segments(_decided(s), s.transcripts)


def remap_edges(s: model.Structures) -> DataFrame:
    """Each segment that lacks one or two 5' exons of a longer one, with the longest such (then the smallest id)."""
    pairs = absorb.pairs_subsequence(s.segments).filter("missing_3 = 0 and missing_5 between 1 and 2")
    sizes = s.segments.select(F.col("segment_id").alias("parent_id"), "n_exons")
    best = pairs.join(sizes, "parent_id").groupBy("child_id").agg(F.min_by("parent_id", F.struct(-F.col("n_exons"), F.col("parent_id"))).alias("new_id"))
    return best.select(F.col("child_id").alias("old_id"), "new_id")


def quant_remap(s: model.Structures) -> DataFrame:
    return quant.closure(remap_edges(s))


def quant_merge(s: model.Structures) -> DataFrame:
    dropped = absorb.mono_exon_classes(s.segments).filter("mono_class = 'gene_overlap'")
    return quant.merge(s.quant, quant.closure(remap_edges(s)), dropped).select("segment_id", "sample_id", F.round("value", 3).alias("value"))


def quant_by_segment(s: model.Structures) -> DataFrame:
    q = s.quant.groupBy("segment_id").agg(F.round(F.sum("value"), 3).alias("value"), F.count(F.lit(1)).alias("n"))
    return s.segments.select("segment_id").join(q, "segment_id", "left").select("segment_id", "value", F.coalesce("n", F.lit(0)).alias("n"))


def _reads(s: model.Structures) -> DataFrame:
    return s.transcripts.select(F.col("transcript_id").alias("read_id"), "seqid", "strand", "start_pos", "end_pos", F.col("n_exons").alias("mapq"), junctions(F.col("chain")).alias("junctions"))


def read_clusters(s: model.Structures) -> DataFrame:
    c = clusters.cluster(_reads(s))
    return clusters.bounds(c).join(clusters.representatives(c), "cluster_key").select("cluster_id", "seqid", "strand", "n_junctions", "start_pos", "end_pos", "n_reads", "representative_read", F.round("mean_mapq", 6).alias("mean_mapq"))


def consensus_junctions(s: model.Structures) -> DataFrame:
    c = clusters.consensus(clusters.cluster(_reads(s)))
    return c.select("cluster_key", F.array_join(F.transform("junctions", lambda j: F.concat_ws("-", j["donor"], j["acceptor"])), ",").alias("junctions"))


def cluster_statistics(s: model.Structures) -> DataFrame:
    return clusters.statistics(clusters.bounds(clusters.cluster(_reads(s))))


def export_lines(s: model.Structures) -> DataFrame:
    members = s.members.select("transcript_id", "sample_id", "segment_id", "gene_id", "seqid", "strand", "source", "start_pos", "end_pos", "biotype").filter("sample_id is not null")
    return gtf.export_lines(members, s.segment_exons, s.genes).select("sample_id", "rank", F.col("number").alias("exon_number"), "line")


def export_filtered(s: model.Structures) -> DataFrame:
    """Segments in the region, of protein-coding genes, in at least one sample, from one of two sources."""
    seqid, start, end = parse_region(REGION)
    inside = s.segments.filter((F.col("seqid") == seqid) & (F.col("start_pos") < end) & (F.col("end_pos") > start))
    coding = s.genes.filter("gene_biotype = 'protein_coding'").select("gene_id")
    n = s.segment_samples.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n_samples"))
    sources = s.segment_sources.filter(F.col("source").isin("VELANN", "ISOCALL")).select("segment_id").distinct()
    return inside.join(coding, "gene_id", "left_semi").join(n, "segment_id").join(sources, "segment_id", "left_semi").select("segment_id", "gene_id", "start_pos", "end_pos", "n_samples")


def _features(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "raw_gtf").select("file_name", "line_no", F.regexp_replace("line", "\r$", "").alias("line"))
    return gtf.features(lines)


def gtf_features(spark: SparkSession, folder: str) -> DataFrame:
    f = _features(spark, folder)
    return f.groupBy("file_name", "feature").agg(F.count(F.lit(1)).alias("n"), F.min("start_pos").alias("min_start"), F.max("end_pos").alias("max_end"), F.count_if(F.col("strand") == "-").alias("n_minus"))


def gtf_headers(spark: SparkSession, folder: str) -> DataFrame:
    return gtf.headers(table(spark, folder, "raw_gtf").select("file_name", "line_no", F.regexp_replace("line", "\r$", "").alias("line")))


def expression_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Transcript lines that pass, by file: those whose coverage is missing or reaches the threshold."""
    t, _ = gtf.transcripts_and_exons(_features(spark, folder))
    ok = gtf.passes_expression(["cov"], {"cov": LEAST_COVERAGE})
    value = expression_value(F.try_element_at("attributes", F.lit("cov")))
    return t.groupBy("file_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("passed"), F.round(F.sum(value), 3).alias("coverage"))


def sample_groups(spark: SparkSession, folder: str) -> DataFrame:
    return model.sample_rows(table(spark, folder, "sample_info")).select("sample_id", "kind", "sample_group", "is_annotation", "is_annotation_loose")


def sharing_matrix(spark: SparkSession, folder: str) -> DataFrame:
    s = model.load(spark, folder)
    # the columns of the matrix: one for each sample
    ids = [r["sample_id"] for r in s.samples.select("sample_id").orderBy("sample_id").collect()]
    return summary.sharing_matrix(summary.sharing_per_sample(s, 0.1), ids)


QUERIES = {
    "absorb_decisions": _s(absorb_decisions),
    "absorb_counters": _s(absorb_counters),
    "absorb_segments": _s(absorb_segments),
    "pairs_subsequence": _s(lambda s: absorb.pairs_subsequence(s.segments)),
    "pairs_fuzzy": _s(lambda s: absorb.pairs_fuzzy(s.segments)),
    "pairs_terminal": _s(lambda s: absorb.pairs_terminal(s.segments)),
    "mono_exon_class": _s(lambda s: absorb.mono_exon_classes(s.segments)),
    "quant_remap": _s(quant_remap),
    "quant_merge": _s(quant_merge),
    "quant_by_segment": _s(quant_by_segment),
    "read_clusters": _s(read_clusters),
    "consensus_junctions": _s(consensus_junctions),
    "cluster_statistics": _s(cluster_statistics),
    "export_lines": _s(export_lines),
    "export_filtered": _s(export_filtered),
    "gtf_features": gtf_features,
    "gtf_headers": gtf_headers,
    "expression_filter": expression_filter,
    "sample_groups": sample_groups,
    "sharing_matrix": sharing_matrix,
}

_SC = "sc as (select segment_id, seqid, strand, n_exons, start_pos, end_pos, regexp_extract(structure, '[^:]*$') as chain_text from seg)"
_SUB = f"""{_SC}, f1 as (select segment_id, start_pos as fs, end_pos as fe from sx where pos = 1),
ps as (select c.segment_id as child_id, p.segment_id as parent_id, c.strand, c.n_exons as nc, p.n_exons as np, x.pos - 1 as k from sc c join f1 using (segment_id) join sx x on x.seqid = c.seqid and x.strand = c.strand and x.start_pos = fs and x.end_pos = fe join sc p on p.segment_id = x.segment_id
  where c.n_exons >= 2 and c.n_exons < p.n_exons and position(',' || c.chain_text || ',' in ',' || p.chain_text || ',') > 0),
pq as (select child_id, parent_id, case when strand = '+' then k else np - nc - k end as missing_5, case when strand = '+' then np - nc - k else k end as missing_3 from ps)"""
_MONO = """mp as (select a.segment_id, b.segment_id as other, a.start_pos as m0, a.end_pos as m1 from seg a join seg b on a.seqid = b.seqid and a.strand = b.strand and a.n_exons = 1 and b.n_exons > 1 and a.start_pos < b.end_pos and a.end_pos > b.start_pos),
mc as (select mp.segment_id, bool_or(m0 < x.end_pos and m1 > y.start_pos) as ir from mp join sx x on x.segment_id = other join sx y on y.segment_id = other and y.pos = x.pos + 1 group by 1),
mo as (select mp.segment_id, bool_or(m0 < x.end_pos and m1 > x.start_pos) as ov from mp join sx x on x.segment_id = other group by 1),
mk as (select segment_id, case when ir then 'intron_retention' when ov then 'gene_overlap' else 'intergenic' end as mono_class from seg left join mc using (segment_id) left join mo using (segment_id) where n_exons = 1)"""
_REMAP = "re as (select child_id as old_id, arg_min(parent_id, (-n_exons, parent_id)) as new_id from pq join (select segment_id as parent_id, n_exons from seg) using (parent_id) where missing_3 = 0 and missing_5 between 1 and 2 group by 1)"
_CLOSE = "wk as (select old_id, new_id, 1 as d from re union all select wk.old_id, re.new_id, d + 1 from wk join re on re.old_id = wk.new_id), cl as (select old_id, arg_max(new_id, d) as new_id from wk group by 1)"
_RECURSIVE = CORE_SQL.replace("with tx0", "with recursive tx0", 1)
_FEATURES = """with l as (select file_name, line_no, regexp_replace(line, chr(13) || '$', '') as line from raw_gtf), c as (select *, string_split(line, chr(9)) as c from l where line not like '#%'),
f as (select file_name, line_no, c[3] as feature, try_cast(regexp_extract(c[4], '^[0-9]+$') as bigint) as s, try_cast(regexp_extract(c[5], '^[0-9]+$') as bigint) as e, c[7] as strand, c[9] as attrs from c where len(c) >= 9 and try_cast(regexp_extract(c[4], '^[0-9]+$') as bigint) is not null and try_cast(regexp_extract(c[5], '^[0-9]+$') as bigint) is not null)"""
_GENE_LINE = "gene_id || '\"' || ';'"

ORACLE = {
    "pairs_subsequence": f"{CORE_SQL}, {_SUB} select * from pq",
    "pairs_fuzzy": f"""{CORE_SQL}, an as (select c.segment_id as child_id, p.segment_id as parent_id, p.pos - 1 as k, c.n_exons as nc from sx c join sx p on c.seqid = p.seqid and c.strand = p.strand and c.pos = 1 and abs(c.start_pos - p.start_pos) <= 5 and c.segment_id <> p.segment_id where c.n_exons >= 2 and p.n_exons >= 2 and p.pos - 1 + c.n_exons <= p.n_exons)
select distinct child_id, parent_id from (select child_id, parent_id, k, nc from an join sx c on c.segment_id = child_id join sx p on p.segment_id = parent_id and p.pos = c.pos + k where abs(c.start_pos - p.start_pos) <= 5 and abs(c.end_pos - p.end_pos) <= 5 group by all having count(*) = nc)""",
    "pairs_terminal": f"""{CORE_SQL}, t as (select segment_id, any_value(seqid) as seqid, any_value(strand) as strand, any_value(n_exons) as n, min(case when pos = 1 then start_pos end) as s, max(case when pos = n_exons then end_pos end) as e,
 string_agg(case when pos = 1 then 'x' else start_pos::varchar end || '-' || case when pos = n_exons then 'x' else end_pos::varchar end, ',' order by pos) as k from sx where n_exons >= 2 group by 1)
select a.segment_id as a_id, b.segment_id as b_id from t a join t b on a.seqid = b.seqid and a.strand = b.strand and a.n = b.n and a.k = b.k and a.segment_id < b.segment_id and abs(a.s - b.s) <= 50 and abs(a.e - b.e) <= 50""",
    "mono_exon_class": f"{CORE_SQL}, {_MONO} select segment_id, mono_class from mk",
    "quant_remap": f"{_RECURSIVE}, {_SUB}, {_REMAP}, {_CLOSE} select * from cl",
    "quant_merge": f"{_RECURSIVE}, {_SUB}, {_REMAP}, {_CLOSE}, {_MONO}, go as (select segment_id from mk where mono_class = 'gene_overlap' and segment_id not in (select old_id from cl)) select coalesce(new_id, segment_id) as segment_id, sample_id, round(sum(value), 3) as value from qt left join cl on old_id = segment_id where segment_id not in (select segment_id from go) group by 1, 2",
    "quant_by_segment": f"{CORE_SQL} select segment_id, round(sum(value), 3) as value, count(value) as n from seg left join qt using (segment_id) group by 1",
    "export_lines": f"""{CORE_SQL}, m as (select mem.transcript_id, mem.sample_id, mem.segment_id, mem.gene_id, mem.seqid, mem.strand, mem.source, mem.start_pos, mem.end_pos, mem.biotype, gn.gene_name as gname, gn.gene_biotype from mem left join gn on gn.gene_id = mem.gene_id where sample_id is not null),
b as (select sample_id, gene_id, seqid, strand, min(start_pos) as s, max(end_pos) as e, coalesce(max(source), '.') as src, max(gname) as gname, max(gene_biotype) as gb from m group by all),
nm as (select *, 'gene_id "' || gene_id || '";' || coalesce(' gene_name "' || gname || '";', '') as head from m)
select sample_id, 0 as rank, 0 as exon_number, concat_ws(chr(9), seqid, src, 'gene', s, e, '.', strand, '.', 'gene_id "' || gene_id || '";' || coalesce(' gene_name "' || gname || '";', '') || coalesce(' gene_biotype "' || gb || '";', '')) as line from b
union all select sample_id, 1, 0, concat_ws(chr(9), seqid, coalesce(source, '.'), 'transcript', start_pos, end_pos, '.', strand, '.', head || ' transcript_id "' || transcript_id || '";' || coalesce(' transcript_type "' || biotype || '";', '')) from nm
union all select sample_id, 1, case when nm.strand = '+' then pos else n_exons - pos + 1 end, concat_ws(chr(9), nm.seqid, coalesce(source, '.'), 'exon', sx.start_pos, sx.end_pos, '.', nm.strand, '.', head || ' transcript_id "' || transcript_id || '"; exon_number "' || case when nm.strand = '+' then pos else n_exons - pos + 1 end || '";') from nm join sx using (segment_id)""",
    "export_filtered": f"{CORE_SQL} select segment_id, gene_id, start_pos, end_pos, count(*) as n_samples from seg join ss using (segment_id) where seqid = 'chr1' and start_pos < 4000000 and end_pos > 2000000 and gene_id in (select gene_id from gn where gene_biotype = 'protein_coding') and segment_id in (select segment_id from src where source in ('VELANN', 'ISOCALL')) group by all",
    "gtf_features": f"{_FEATURES} select file_name, feature, count(*) as n, min(s) as min_start, max(e) as max_end, count(*) filter (where strand = '-') as n_minus from f group by 1, 2",
    "gtf_headers": r"""with l as (select file_name, line_no, regexp_replace(line, chr(13) || '$', '') as line from raw_gtf), b as (select file_name, min(line_no) as first from l where line not like '#%' group by 1)
select file_name, lower(trim(regexp_extract(line, '^##([^:]+):', 1))) as key, arg_max(trim(regexp_extract(line, '^##[^:]+:(.*)$', 1)), line_no) as value from l left join b using (file_name) where regexp_matches(line, '^##[^:]+:') and (first is null or line_no < first) group by 1, 2""",
    "expression_filter": _FEATURES + r""", p as (select *, regexp_extract_all(attrs, '([^\s";=]+)[\s=]+("[^"]*"|[^\s;"]+)', 1) as ks, list_transform(regexp_extract_all(attrs, '([^\s";=]+)[\s=]+("[^"]*"|[^\s;"]+)', 2), lambda v: trim(v, '"')) as vs from f where feature = 'transcript'),
q as (select file_name, nullif(vs[list_position(ks, 'gene_id')], '') as g, nullif(vs[list_position(ks, 'transcript_id')], '') as t, try_cast(nullif(regexp_extract(vs[list_position(ks, 'cov')], '^\s*([-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?)', 1), '') as double) as cov from p)
select file_name, count(*) as n, count(*) filter (where cov is null or cov >= 10.0) as passed, round(sum(cov), 3) as coverage from q where g is not null and t is not null group by 1""",
    "sample_groups": f"{CORE_SQL} select sample_id, kind, sample_group, kind = 'annotation' as is_annotation, kind = 'annotation' or named as is_annotation_loose from sm",
}
ORACLE |= folds.ORACLE
ORACLE["sharing_matrix"] = f"""pivot (select sample_id, metric, n from (unpivot ({structure.ORACLE['sharing_per_sample']}) on total, exclusive, shared, conserved into name metric value n)
  union all select distinct sample_id, metric, null from sample_info, (values ('total'), ('exclusive'), ('shared'), ('conserved')) as m(metric) where sample_id is not null) on sample_id using max(n) group by metric"""

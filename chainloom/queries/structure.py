"""Queries over transcript structures: counts, sharing, conservation, expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import model, overlap, summary
from .problems import GENE_KEY_SQL, SEQ_KEY_SQL

#: Share of samples from which a structure counts as conserved in the queries below.
FRACTION = 0.1

#: The tables of ``operators.model`` in SQL.
CORE_SQL = f"""
with tx0 as (select transcript_id, min({SEQ_KEY_SQL}) as seqid, min(strand) as strand, min({GENE_KEY_SQL}) as gene_id, min(gene_name) as gene_name, min(nullif(transcript_biotype, '')) as biotype,
                    min(source) as source, min(sample_id) as sample_id, min(segment_index) as segment_index
             from gtf_transcript where transcript_id is not null and strand in ('+', '-') group by transcript_id),
ex0 as (select distinct transcript_id, start_pos, end_pos from gtf_exon where transcript_id is not null and start_pos <= end_pos),
ch as (select transcript_id, min(start_pos) as start_pos, max(end_pos) as end_pos, count(*) as n_exons, string_agg(start_pos || '-' || end_pos, ',' order by start_pos, end_pos) as chain_text from ex0 group by transcript_id),
tx as (select *, seqid || ':' || strand || ':' || chain_text as structure from tx0 join ch using (transcript_id) where seqid is not null and gene_id is not null),
seg as (select min(transcript_id) as segment_id, structure, min(seqid) as seqid, min(strand) as strand, min(start_pos) as start_pos, min(end_pos) as end_pos, min(n_exons) as n_exons, min(gene_id) as gene_id, min(gene_name) as gene_name, count(*) as n_transcripts from tx group by structure),
mem as (select tx.*, seg.segment_id, seg.gene_id as segment_gene_id from tx join seg using (structure)),
ss as (select distinct segment_id, sample_id from mem where sample_id is not null),
src as (select distinct segment_id, source from mem where source is not null),
sx as (select segment_id, gene_id, gene_name, seqid, strand, seg.n_exons, e.start_pos, e.end_pos, row_number() over (partition by segment_id order by e.start_pos, e.end_pos) as pos from seg join ex0 e on e.transcript_id = seg.segment_id),
sm as (select sample_id, min(id) as id, min(lower(trim(coalesce(nullif(trim(entry_type), ''), 'sample')))) as kind, min(coalesce(sample_group, case when lower(trim(coalesce(nullif(trim(entry_type), ''), 'sample'))) = 'sample' then regexp_replace(id, '_rep[0-9]+$', '') else id end)) as sample_group,
              bool_or(coalesce(nullif(annotation_source, ''), nullif(annotation_version, '')) is not null) as named from sample_info group by sample_id),
gn as (select {GENE_KEY_SQL} as gene_id, min(nullif(gene_name, '')) as gene_name, min(nullif(replace(lower(gene_biotype), ' ', '_'), '')) as gene_biotype from gtf_gene where {GENE_KEY_SQL} is not null group by 1),
rec as (select distinct segment_index, sample_id, cast(value as double) as value from stream_record where segment_index is not null and sample_id is not null and value >= 0 and value < 'infinity'::float),
qt as (select segment_id, rec.sample_id, sum(value) as value from rec join (select distinct segment_index, segment_id from mem where segment_index is not null) using (segment_index) group by 1, 2),
thr as (select greatest(1, cast(ceil(count(*) filter (where kind = 'sample') * {FRACTION}) as bigint)) as t from sm)
"""

_load = model.load


def _q(fn):
    return lambda spark, folder: fn(_load(spark, folder))


def _segments_exact(s: model.Structures) -> DataFrame:
    n = s.segment_samples.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n_samples"))
    return s.segments.join(n, "segment_id", "left").select("segment_id", "structure", "gene_id", "n_exons", "n_transcripts", F.coalesce("n_samples", F.lit(0)).alias("n_samples"))


def _scalars(s: model.Structures) -> DataFrame:
    return s.transcripts.select(
        "transcript_id",
        scalars.format_coordinate(F.col("seqid"), F.col("strand"), F.col("start_pos"), F.col("end_pos")).alias("coordinate"),
        "structure",
        F.array_join(F.transform(scalars.junctions(F.col("chain")), lambda j: F.concat_ws("-", j["donor"], j["acceptor"])), ",").alias("junctions"),
        scalars.splice_signature(F.col("strand"), scalars.junctions(F.col("chain")), 10).alias("signature"),
        scalars.chromosome_order(F.col("seqid")).cast("long").alias("seq_order"),
    )


def _junction_round_trip(s: model.Structures) -> DataFrame:
    """Exons derived back from span and junctions; equal to the chain wherever exons do not overlap."""
    back = scalars.exons_of_junctions(F.col("start_pos"), F.col("chain")[F.size("chain") - 1]["end_pos"], scalars.junctions(F.col("chain")))
    return s.transcripts.select("transcript_id", F.array_join(F.transform(back, lambda x: F.concat_ws("-", x["start_pos"], x["end_pos"])), ",").alias("exons"))


def main_chromosomes(spark: SparkSession, folder: str) -> DataFrame:
    from ..functions.keys import sequence_key
    from ..plans.tables import table

    t = table(spark, folder, "gtf_transcript").select(sequence_key(F.col("seqid")).alias("seqid"))
    return t.filter("seqid is not null").groupBy("seqid", scalars.is_main_chromosome(F.col("seqid")).alias("is_main")).agg(F.count(F.lit(1)).alias("n"))


def exon_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct exons with the number of transcripts, samples and sources that carry them."""
    s = _load(spark, folder)
    rows = s.transcripts.select("transcript_id", "seqid", "strand", "sample_id", "source", F.explode("chain").alias("x")).select("*", "x.start_pos", "x.end_pos")
    return rows.groupBy(*summary.EXON).agg(F.count(F.lit(1)).alias("n_transcripts"), F.countDistinct("sample_id").alias("n_samples"), F.countDistinct("source").alias("n_sources"))


def frequency(s: model.Structures) -> DataFrame:
    """Share of all samples that carry a segment, with the specific and conserved marks."""
    n = s.segment_samples.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n_samples"))
    total = s.samples.agg(F.count(F.lit(1))).scalar()
    thr = scalars.conserved_threshold(summary.n_plain_samples(s.samples), FRACTION)
    return n.select("segment_id", F.round(F.col("n_samples") / total, 6).alias("frequency"), (F.col("n_samples") == 1).alias("is_specific"), (F.col("n_samples") >= thr).alias("is_conserved"))


QUERIES = {
    "sharing_per_sample": _q(lambda s: summary.sharing_per_sample(s, FRACTION)),
    "segments_exact": _q(_segments_exact),
    "scalar_functions": _q(_scalars),
    "exons_from_junctions": _q(_junction_round_trip),
    "main_chrom_filter": main_chromosomes,
    "exon_dedup": exon_dedup,
    "set_frequency": _q(frequency),
    "exon_sharing": _q(lambda s: summary.exon_sharing_per_sample(s, FRACTION)),
    "overview_metrics": _q(summary.overview),
    "per_sample": _q(lambda s: summary.per_sample(s, FRACTION)),
    "per_source": _q(summary.per_source),
    "biotype_breakdown": _q(summary.biotype_counts),
    "exon_usage": _q(summary.exon_usage),
    "exon_first_visit": _q(summary.first_visits),
    "constitutive_exons": _q(summary.constitutive_exons),
    "gene_diversity": _q(summary.gene_diversity),
    "gene_bounds": _q(summary.gene_segments),
    "expression_per_sample": _q(summary.expression_per_sample),
    "exon_expression": _q(summary.exon_expression),
    "conserved_segments": _q(lambda s: summary.conserved_segments(s, FRACTION)),
    "conserved_exons": _q(lambda s: summary.conserved_exons(s, FRACTION)),
    "inspect_min_samples": _q(lambda s: summary.with_min_samples(s, 2)),
    "build_summary_by_sequence": _q(summary.build_summary_by_sequence),
    "largest_gene": _q(summary.largest_gene),
    "loci": _q(lambda s: overlap.locus_numbers(s.segments.select("segment_id", "seqid", "strand", "start_pos", "end_pos"), ["seqid", "strand"], "start_pos", "end_pos")),
}

_SHARE = "case when k = 1 then 'exclusive' when k >= (select t from thr) then 'conserved' else 'shared' end"
_COUNTS = "count(*) as total, count(*) filter (where share = 'exclusive') as exclusive, count(*) filter (where share = 'shared') as shared, count(*) filter (where share = 'conserved') as conserved"
_SEG_SHARE = f"sh as (select ss.*, {_SHARE} as share from ss join (select segment_id, count(*) as k from ss group by 1) using (segment_id))"
_EXS = "xs as (select distinct seqid, strand, start_pos, end_pos, sample_id from sx join ss using (segment_id))"
_ENT = "case when {p} > 0 then -({p}) * log2({p}) else 0 end"
_COORD = "seqid || ':' || strand || ':' || start_pos || '-' || end_pos"
_FIRST = "fv as (select sx.seqid, sx.strand, sx.start_pos, sx.end_pos, sx.segment_id, sx.gene_id, sx.pos, row_number() over (partition by sx.seqid, sx.strand, sx.start_pos, sx.end_pos order by seg.start_pos, seg.end_pos, sx.segment_id, sx.pos) as v from sx join seg using (segment_id))"
_USE = "us as (select gene_id, seqid, strand, start_pos, end_pos, count(*) as n_with, max(n_segments) as n_segments from sx join (select gene_id, count(*) as n_segments from seg group by 1) using (gene_id) group by 1, 2, 3, 4, 5)"

ORACLE = {
    "sharing_per_sample": f"{CORE_SQL}, {_SEG_SHARE} select sample_id, {_COUNTS} from sh group by sample_id",
    "segments_exact": f"{CORE_SQL} select segment_id, structure, gene_id, n_exons, n_transcripts, coalesce(k, 0) as n_samples from seg left join (select segment_id, count(*) as k from ss group by 1) using (segment_id)",
    "scalar_functions": f"""{CORE_SQL}, o as (select transcript_id, start_pos, end_pos, lead(start_pos) over (partition by transcript_id order by start_pos, end_pos) as nxt from ex0),
j as (select transcript_id, string_agg(end_pos || '-' || nxt, ',' order by start_pos, end_pos) as js, string_agg((end_pos // 10 * 10) || '-' || (nxt // 10 * 10), ',' order by start_pos, end_pos) as sig from o where nxt is not null group by 1),
b as (select *, regexp_replace(seqid, '^chr', '') as bare from tx)
select transcript_id, {_COORD} as coordinate, structure, coalesce(js, '') as junctions, strand || ':' || coalesce(sig, 'SINGLE') as signature,
       case when regexp_full_match(bare, '[0-9]{{1,9}}') then cast(bare as bigint) when bare = 'X' then 1000000001 when bare = 'Y' then 1000000002 when bare in ('M', 'MT') then 1000000003 else 1000000004 end as seq_order
from b left join j using (transcript_id)""",
    "exons_from_junctions": f"{CORE_SQL} select transcript_id, chain_text as exons from tx",
    "main_chrom_filter": f"select {SEQ_KEY_SQL} as seqid, regexp_full_match({SEQ_KEY_SQL}, '(chr)?([1-9]|1[0-9]|2[0-2]|X|Y|M|MT)') as is_main, count(*) as n from gtf_transcript where {SEQ_KEY_SQL} is not null group by 1, 2",
    "exon_dedup": f"{CORE_SQL} select seqid, strand, e.start_pos, e.end_pos, count(*) as n_transcripts, count(distinct sample_id) as n_samples, count(distinct source) as n_sources from tx join ex0 e using (transcript_id) group by 1, 2, 3, 4",
    "set_frequency": f"{CORE_SQL}, n as (select segment_id, count(*) as k from ss group by 1) select segment_id, round(k / (select count(*) from sm), 6) as frequency, k = 1 as is_specific, k >= (select t from thr) as is_conserved from n",
    "exon_sharing": f"{CORE_SQL}, {_EXS}, sh as (select xs.*, {_SHARE} as share from xs join (select seqid, strand, start_pos, end_pos, count(*) as k from xs group by 1, 2, 3, 4) using (seqid, strand, start_pos, end_pos)) select sample_id, {_COUNTS} from sh group by sample_id",
    "overview_metrics": f"""{CORE_SQL}, g as (select gene_id, count(*) as n from seg group by 1),
w as (select (select count(*) from seg)::double as segments, (select sum(n_transcripts) from seg)::double as source_transcript_ids, (select sum(n_exons) from seg)::double as segment_to_exon, (select sum(n_exons - 1) from seg)::double as exon_links,
 (select count(*) from seg where n_exons = 1)::double as single_exon_segments, (select avg(n_exons) from seg)::double as mean_exons_per_segment, (select median(n_exons) from seg)::double as median_exons_per_segment, (select max(n_exons) from seg)::double as max_exons_per_segment,
 (select count(*) from g)::double as genes, (select count(*) from g where n = 1)::double as single_isoform_genes, (select count(*) from g where n > 1)::double as multi_isoform_genes, (select avg(n) from g)::double as mean_segments_per_gene, (select median(n) from g)::double as median_segments_per_gene, (select max(n) from g)::double as max_segments_per_gene,
 (select count(*) from (select distinct seqid, strand, start_pos, end_pos from sx))::double as exons, (select count(*) from sm)::double as samples)
select metric, round(value, 2) as value from (unpivot w on columns(*) into name metric value value)""",
    "per_sample": f"""{CORE_SQL}, {_SEG_SHARE}, r as (select sh.*, gene_id, n_exons, n_transcripts from sh join seg using (segment_id)),
c as (select sample_id, {_COUNTS}, cast(sum(n_transcripts) as bigint) as transcripts_touched, count(*) filter (where n_exons = 1) as single_exon_segments, count(distinct gene_id) as genes from r group by 1)
select c.*, sm.id, sm.kind from c left join sm using (sample_id)""",
    "per_source": f"""{CORE_SQL}, a as (select source, count(*) as segments, count(*) filter (where k = 1) as exclusive_segments, count(distinct gene_id) as genes from src join (select segment_id, count(*) as k from src group by 1) using (segment_id) join seg using (segment_id) group by 1),
e as (select distinct seqid, strand, start_pos, end_pos, source from sx join src using (segment_id)),
b as (select source, count(*) as exons, count(*) filter (where k = 1) as exclusive_exons from e join (select seqid, strand, start_pos, end_pos, count(*) as k from e group by 1, 2, 3, 4) using (seqid, strand, start_pos, end_pos) group by 1)
select * from a join b using (source)""",
    "biotype_breakdown": f"""{CORE_SQL}, t as (select coalesce(biotype, 'unknown') as biotype, sample_id from tx), g as (select distinct coalesce(gene_biotype, 'unknown') as biotype, sample_id, gene_id from tx left join gn using (gene_id))
select 'gene' as level, biotype, null::int as sample_id, count(distinct gene_id) as n from g group by biotype union all select 'gene', biotype, sample_id, count(distinct gene_id) from g where sample_id is not null group by biotype, sample_id
union all select 'transcript', biotype, null, count(*) from t group by biotype union all select 'transcript', biotype, sample_id, count(*) from t where sample_id is not null group by biotype, sample_id""",
    "exon_usage": f"{CORE_SQL}, {_USE} select * from us",
    "exon_first_visit": f"{CORE_SQL}, {_FIRST} select seqid, strand, start_pos, end_pos, segment_id, gene_id, pos from fv where v = 1",
    "constitutive_exons": f"{CORE_SQL}, {_FIRST}, {_USE} select gene_id, count(*) filter (where n_with >= n_segments) as constitutive, count(*) filter (where n_with < n_segments) as alternative from fv join us using (gene_id, seqid, strand, start_pos, end_pos) where v = 1 group by gene_id",
    "gene_diversity": f"""{CORE_SQL}, {_USE}, u as (select gene_id, n_segments, n_with / sum(n_with) over (partition by gene_id) as p from us where n_segments >= 2), h as (select gene_id, n_segments, sum({_ENT.format(p="p")}) as h from u group by 1, 2),
i as (select gene_id, n_transcripts / sum(n_transcripts) over (partition by gene_id) as p from seg), k as (select gene_id, sum({_ENT.format(p="p")}) as hi from i group by 1)
select gene_id, n_segments, round(h, 6) as exon_entropy, round(pow(2, hi), 6) as effective_isoforms from h join k using (gene_id)""",
    "gene_bounds": f"{CORE_SQL} select gene_id, count(*) as n_segments, cast(sum(n_transcripts) as bigint) as n_transcripts, min(start_pos) as start_pos, max(end_pos) as end_pos, count(*) filter (where n_exons = 1) as n_single_exon from seg group by 1",
    "expression_per_sample": f"{CORE_SQL} select sample_id, round(sum(value), 3) as total_expression, count(*) as expressed_segments, round(sum(value) / count(*), 4) as mean_expression from qt group by 1",
    "exon_expression": f"{CORE_SQL} select seqid, strand, start_pos, end_pos, sample_id, round(sum(value), 3) as value from sx join qt using (segment_id) group by 1, 2, 3, 4, 5",
    "conserved_segments": f"""{CORE_SQL}, n as (select segment_id, count(*) as n_samples from ss group by 1 having count(*) >= (select t from thr)), s as (select segment_id, string_agg(source, ';' order by source) as sources from src group by 1)
select segment_id, gene_id, {_COORD} as coordinate, n_exons, n_transcripts, n_samples, coalesce(sources, '.') as sources from n join seg using (segment_id) left join s using (segment_id)""",
    "conserved_exons": f"""{CORE_SQL}, {_EXS}, {_FIRST}, n as (select seqid, strand, start_pos, end_pos, count(*) as n_samples from xs group by 1, 2, 3, 4 having count(*) >= (select t from thr)),
c as (select sx.seqid, sx.strand, sx.start_pos, sx.end_pos, cast(sum(n_transcripts) as bigint) as n_transcripts from sx join seg using (segment_id) group by 1, 2, 3, 4)
select {_COORD} as coordinate, gene_id, n_transcripts, n_samples from n join c using (seqid, strand, start_pos, end_pos) join fv using (seqid, strand, start_pos, end_pos) where v = 1""",
    "inspect_min_samples": f"{CORE_SQL}, k as (select segment_id, count(*) filter (where kind = 'sample') as n_plain, coalesce(bool_or(kind = 'annotation'), false) as in_annotation from ss left join sm using (sample_id) group by 1) select * from k where in_annotation or n_plain >= 2",
    "build_summary_by_sequence": f"{CORE_SQL} select seqid, count(*) as segments, count(distinct gene_id) as genes, (select count(*) from (select distinct strand, start_pos, end_pos from sx where sx.seqid = seg.seqid)) as exons from seg group by seqid",
    "largest_gene": f"{CORE_SQL} select gene_id, cast(sum(n_transcripts) as bigint) as n_transcripts from seg group by gene_id order by 2 desc, 1 limit 1",
    "loci": f"""{CORE_SQL}, b as (select segment_id, seqid, strand, start_pos, end_pos, max(end_pos) over (partition by seqid, strand order by start_pos, end_pos, segment_id rows between unbounded preceding and 1 preceding) as before from seg)
select segment_id, seqid, strand, start_pos, end_pos, max(case when before is null or before < start_pos then start_pos end) over (partition by seqid, strand order by start_pos, end_pos, segment_id rows unbounded preceding) as locus_start from b""",
}

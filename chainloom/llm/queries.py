"""Queries of the training-data problems, over their whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import gene_key
from ..plans.durable import durable
from ..plans.tables import table
from ..queries.problems import GENE_KEY_SQL
from . import language, mixing, packing, topn
from .tokens import n_tokens

TOP = 5
CAPACITY = 2048


def scored_records(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct measurements with every gene key that carries their segment."""
    records = table(spark, folder, "stream_record").select("segment_index", "sample_id", "value").filter("segment_index is not null and value >= 0 and value < double('infinity')").distinct()
    genes = table(spark, folder, "gtf_transcript").select("segment_index", gene_key(F.col("gene_id")).alias("gene_id")).filter("segment_index is not null and gene_id is not null").distinct()
    return records.join(genes, "segment_index").select("gene_id", "segment_index", "sample_id", "value")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return topn.top_n(scored_records(spark, folder), ["gene_id"], "value", ["segment_index", "sample_id"], TOP).select("gene_id", "segment_index", "sample_id")


def p3_top_ranked(spark: SparkSession, folder: str) -> DataFrame:
    top = topn.top_n(scored_records(spark, folder), ["gene_id"], "value", ["segment_index", "sample_id"], TOP)
    return top.select("gene_id", "segment_index", "sample_id", F.col("value").cast("double").alias("value"), F.col("rank").cast("long").alias("rank"))


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("item_id"), "source", n_tokens(F.col("text")).alias("size"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_sizes(spark, folder), CAPACITY).filter("piece = 0 and pieces > 1").select(F.col("item_id").alias("doc_id"))


def p6_assignments(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_sizes(spark, folder), CAPACITY).withColumnRenamed("item_id", "doc_id")


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.containers(packing.pack(_sizes(spark, folder), CAPACITY), CAPACITY)


def p6_check(spark: SparkSession, folder: str) -> DataFrame:
    """One row about the whole packing, which SQL can foretell although it can't place items: documents, tokens and pieces
    that are in containers, documents split, containers above the capacity, documents not placed piece by piece, and whether
    at most a tenth of the space is unused."""
    sizes, packed = _sizes(spark, folder), durable(packing.pack(_sizes(spark, folder), CAPACITY))
    pieces = packed.groupBy("item_id").agg(F.sum("size").alias("placed"), F.countDistinct("piece").alias("distinct_pieces"), F.count(F.lit(1)).alias("n_pieces"), F.max("pieces").alias("pieces"))
    whole = (F.col("placed") == F.col("size")) & (F.col("distinct_pieces") == F.col("pieces")) & (F.col("n_pieces") == F.col("pieces"))
    items = sizes.select("item_id", "size").join(pieces, "item_id", "left").agg(
        F.count("placed").alias("n_documents"), F.sum("placed").alias("n_tokens"), F.sum("n_pieces").alias("n_pieces"), F.count_if(F.col("pieces") > 1).alias("n_split"), F.count_if(~F.coalesce(whole, F.lit(False))).alias("n_broken")
    )
    full = packing.containers(packed, CAPACITY).agg(F.count_if(F.col("used") > CAPACITY).alias("n_overfull"), (F.sum("unused") * 10 <= F.sum("used")).alias("tight"))
    return items.withColumns({c: full.select(c).scalar() for c in full.columns})


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_sizes(spark, folder), table(spark, folder, "mix_target"))[1].filter("outcome in ('repeat', 'short')").select("source", "outcome")


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_sizes(spark, folder), table(spark, folder, "mix_target"))[1]


def p7_check(spark: SparkSession, folder: str) -> DataFrame:
    """Of each target what SQL can foretell: goal and outcome, and whether the goal is met within one item of mean size (a short source: all its items are used as often as they may be)."""
    targets = table(spark, folder, "mix_target")
    report = mixing.mix(_sizes(spark, folder), targets)[1].join(targets.select("source", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("most")), "source")
    met = F.when(F.col("outcome") == "short", F.col("picked") == F.col("most") * F.col("held")).otherwise(F.abs(F.col("picked") - F.col("goal")) * F.col("n_items") <= F.col("held"))
    return report.select("source", "outcome", F.round("target_share", 6).alias("target_share"), F.round("goal", 3).alias("goal"), "held", "n_items", met.alias("met"))


def p7_sample(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_sizes(spark, folder), table(spark, folder, "mix_target"))[0].withColumnRenamed("item_id", "doc_id")


def _identified(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"), table(spark, folder, "lang_sample"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return language.corrections(_identified(spark, folder)).select("doc_id", "block_no", "lang")


def p8_languages(spark: SparkSession, folder: str) -> DataFrame:
    return _identified(spark, folder).select("doc_id", "label", "main", "confidence", "block", "lang", "block_confidence")


QUERIES = {f.__name__: f for f in (p3_found, p3_top_ranked, p6_found, p6_assignments, p6_containers, p6_check, p7_found, p7_report, p7_check, p7_sample, p8_found, p8_languages)}

_TOKENS_SQL = r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{0b}\x{85}\p{Z}]+'))"
_TOP_SQL = f"""
with r as (select distinct segment_index, sample_id, value from stream_record where segment_index is not null and value >= 0 and value < 'infinity'::float),
g as (select distinct segment_index, {GENE_KEY_SQL} as gene_id from gtf_transcript where segment_index is not null and {GENE_KEY_SQL} is not null),
o as (select gene_id, segment_index, sample_id, value, row_number() over (partition by gene_id order by value desc, segment_index, sample_id nulls last) as rank from r join g using (segment_index))
"""

_MIX_SQL = f"""
with t as (select source, weight, max_repeats, regexp_replace(lower(trim(source)), '[\\s_-]+', '_', 'g') as k, weight / sum(weight) over () as share from mix_target),
d as (select regexp_replace(lower(trim(source, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), '[\\s_-]+', '_', 'g') as k, sum({_TOKENS_SQL}) as held, count(*) as n_items from documents group by 1),
j as (select t.*, coalesce(d.held, 0) as held, coalesce(d.n_items, 0) as n_items from t left join d using (k)), g as (select *, share * sum(held) over () as goal from j)"""

ORACLE = {
    "p3_found": f"{_TOP_SQL} select gene_id, segment_index, sample_id from o where rank <= {TOP}",
    "p3_top_ranked": f"{_TOP_SQL} select gene_id, segment_index, sample_id, cast(value as double) as value, rank from o where rank <= {TOP}",
    "p6_found": f"select doc_id from documents where {_TOKENS_SQL} > {CAPACITY}",
    "p6_check": f"""with d as (select {_TOKENS_SQL} as n from documents)
select count(*) as n_documents, cast(sum(n) as bigint) as n_tokens, cast(sum(greatest(ceil(n / {CAPACITY}.0), 1)) as bigint) as n_pieces, count(*) filter (where n > {CAPACITY}) as n_split, 0 as n_broken, 0 as n_overfull, true as tight from d""",
    "p7_found": f"""{_MIX_SQL}
select source, case when goal <= max_repeats * held then 'repeat' else 'short' end as outcome from g where goal > held""",
    "p7_check": f"""{_MIX_SQL}
select source, case when goal <= held then 'sample' when goal <= max_repeats * held then 'repeat' else 'short' end as outcome, round(share, 6) as target_share, round(goal, 3) as goal, cast(held as bigint) as held, n_items, true as met from g""",
}

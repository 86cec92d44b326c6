"""Per-key results that no single key can hold up.

Every aggregate here is algebraic: each scan task combines its own rows in a
bounded hash table (spilling to sorted runs when it is full), so a key that
fills a third of the table reaches the shuffle as one partial row per task.
Distinct counts go through a first aggregation on (key, value), which spreads
a hot key over all tasks before its values are counted.

Null, empty and blank keys belong to no key: they count in the table's total
and yield no row of their own. An empty table yields no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import durable

_KEY = "__key"


def key_counts(df: DataFrame, key: Column) -> DataFrame:
    """(key_text, n_rows) of every key; the null key stays, so that the sum is the table's row count."""
    return df.select(key.alias("key_text")).groupBy("key_text").agg(F.count(F.lit(1)).alias("n_rows"))


def keys_above_share(df: DataFrame, key: Column, percent: int) -> DataFrame:
    """Keys that hold at least ``percent`` percent of all stored rows: (key_text, n_rows)."""
    # one row per key, read for the total and for the keys
    counts = durable(key_counts(df, key))
    total = counts.agg(F.sum("n_rows")).scalar()
    return counts.filter(F.col("key_text").isNotNull() & (F.col("n_rows") * 100 >= total * percent))


def key_profile(df: DataFrame, key: Column, aggregates: Sequence[Column], distinct: Mapping[str, Column] | None = None) -> DataFrame:
    """``aggregates`` per key, and for each name in ``distinct`` the number of distinct non-null values.

    The result has ``key_text`` and the aggregates' aliases.
    """
    rows = df.withColumn(_KEY, key).filter(F.col(_KEY).isNotNull())
    out = rows.groupBy(F.col(_KEY).alias("key_text")).agg(*aggregates)
    for name, value in (distinct or {}).items():
        pairs = rows.select(F.col(_KEY).alias("key_text"), value.alias("v")).groupBy("key_text", "v").agg(F.count(F.lit(1)).alias("n"))
        out = out.join(pairs.groupBy("key_text").agg(F.count("v").alias(name)), "key_text")
    return out

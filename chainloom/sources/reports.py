"""Tab-separated reports and the text summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wide(long: DataFrame, keys: list[str], values: list[Column], samples: list[tuple[int, str]]) -> DataFrame:
    """``long`` (keys, sample_id, ...) with one group of columns per sample, called ``<sample>.<value>``."""
    ids = dict(samples)
    out = long.groupBy(*keys).pivot("sample_id", [i for i, _ in samples]).agg(*values)
    return out.withColumnsRenamed({c: f"{ids[int(c.split('_', 1)[0])]}.{c.split('_', 1)[1]}" if "_" in c else ids[int(c)] for c in out.columns if c not in keys})


def write_tsv(df: DataFrame, path: str) -> None:
    """A folder of tab-separated files with a header; nulls and empty cells are dots."""
    cells = [F.coalesce(F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit(".")).alias(c) for c in df.columns]
    df.select(*cells).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").csv(path)


def summary_text(overview: DataFrame, counters: DataFrame, by_sequence: DataFrame) -> str:
    """Readable summary of a build; the three tables are small, bounded by metrics, outcomes and sequence names."""
    parts = ["# Build"]
    parts += [f"{r['outcome']}\t{r['n']}" for r in counters.orderBy("outcome").collect()]
    parts += ["# Index"] + [f"{r['metric']}\t{r['value']:g}" for r in overview.orderBy("metric").collect()]
    parts += ["# Sequences", "seqid\tgenes\tsegments\texons"] + [f"{r['seqid']}\t{r['genes']}\t{r['segments']}\t{r['exons']}" for r in by_sequence.orderBy("seqid").toLocalIterator()]
    return "\n".join(parts) + "\n"

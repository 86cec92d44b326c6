"""Folding of sorted groups in Python, many small groups to one Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of a result batch.
BATCH = 10_000


def fold_groups(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[tuple, Iterable[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """Apply ``fold(key, rows)`` to each group of ``keys``, its rows sorted by ``order``.

    Rows are tuples in the order of ``df``'s columns and come as an iterator over the sorted partition, so that a fold
    that needs one row at a time holds no group in memory, and a small group costs no DataFrame of its own.
    """
    at = [df.columns.index(k) for k in keys]
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for pdf in batches:
            yield from zip(*(pdf[c].tolist() for c in pdf.columns))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source = rows(batches)
        ahead = next(source, None)
        out: list[tuple] = []

        def group(key: tuple) -> Iterator[tuple]:
            nonlocal ahead
            while ahead is not None and tuple(ahead[k] for k in at) == key:
                row, ahead = ahead, next(source, None)
                yield row

        while ahead is not None:
            key = tuple(ahead[k] for k in at)
            members = group(key)
            for r in fold(key, members):
                out.append(r)
                if len(out) >= BATCH:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            for _ in members:  # a fold may stop early
                pass
        if out:
            yield pd.DataFrame(out, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def fold_batches(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[tuple, Iterable[tuple]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """As ``fold_groups``, for folds that give whole Arrow batches."""
    at = [df.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))

        for key, members in groupby(rows(), key=lambda r: tuple(r[k] for k in at)):
            yield from fold(key, members)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)

"""Comparison of queries with segments in tiles, so that pairs are looked at and not shuffled.

Both sides are cut into bins of their sequence, and a pair is met in the first
bin that both reach. A bin with many rows is split into blocks of each side; a
tile is one block of queries against one of segments, in one task. A tile holds
its rows only and puts out what is asked for: for a query its best score there,
or the pairs themselves.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import junctions
from ..plans.grouped import fold_batches
from .overlap import BIN_BITS, _bins

#: Rows of one side of a tile, bytes of kept junction rows in a task, pairs of an output batch.
BLOCK = 16_384
KEPT_BYTES = 64_000_000
PAIRS = 50_000

_KEYS = ["seqid", "strand", "bin", "q_block", "r_block"]


def _placed(df: DataFrame, name: str, extra: Column | None, weight: Column | None) -> DataFrame:
    sites = F.flatten(F.transform(junctions(F.col("chain")), lambda j: F.array(j["donor"], j["acceptor"])))
    rows = df.filter("start_pos <= end_pos").select("seqid", "strand", F.col(name).alias("id"), "start_pos", "end_pos", sites.alias("sites"), *((F.lit(0) if c is None else c).cast("long").alias(x) for x, c in (("extra", extra), ("weight", weight))))
    return rows.withColumn("bin", F.explode(_bins("start_pos", "end_pos")))


def _blocks(rows: DataFrame, own: str, other: str, own_heavy: DataFrame, other_heavy: DataFrame) -> DataFrame:
    at = ["seqid", "strand", "bin"]
    # bins with more than a block of rows are few by definition
    known = rows.join(F.broadcast(own_heavy.withColumnRenamed("n", "n_own")), at, "left").join(F.broadcast(other_heavy.withColumnRenamed("n", "n_other")), at, "left")
    mine = F.pmod(F.xxhash64("id"), F.coalesce("n_own", F.lit(1))).cast("long")
    return known.withColumn(own, mine).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("n_other", F.lit(1)).cast("long") - 1))).drop("n_own", "n_other")


def in_tiles(queries: DataFrame, segments: DataFrame, answer: Callable, schema: str, extra: Column | None = None, weight: Column | None = None) -> DataFrame:
    """``answer(tile, rows)`` for each tile, rows being (id, start, end, sites, extra, weight) of its queries in order of place."""
    q, r = _placed(queries, "query_id", extra, weight), _placed(segments, "segment_id", None, None)

    def heavy(rows: DataFrame) -> DataFrame:
        return rows.groupBy("seqid", "strand", "bin").count().filter(F.col("count") > BLOCK).select("seqid", "strand", "bin", F.ceil(F.col("count") / BLOCK).alias("n"))

    hq, hr = heavy(q.drop("sites")), heavy(r.drop("sites"))
    columns = [*_KEYS, "side", "start_pos", "end_pos", "id", "sites", "extra", "weight"]
    both = _blocks(r, "r_block", "q_block", hr, hq).withColumn("side", F.lit(0)).select(columns).unionByName(_blocks(q, "q_block", "r_block", hq, hr).withColumn("side", F.lit(1)).select(columns))

    def fold(key: tuple, rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        asked: list[tuple] = []
        for row in rows:
            if row[5] == 0:
                held.append(row)
            elif held:
                asked.append((row[8], row[6], row[7], *row[9:]))
        if held and asked:
            yield from answer(Tile(int(key[2]), held), asked)

    return fold_batches(both, _KEYS, ["side", "start_pos", "end_pos", "id"], fold, schema)


class Tile:
    """The segments of a tile in order of (start, end, id), with rows of bits for the sites asked about."""

    def __init__(self, number: int, rows: list[tuple]) -> None:
        self.bin = number
        self.ids = [r[8] for r in rows]
        self.starts, self.ends = (np.array([r[k] for r in rows], dtype=np.int64) for k in (6, 7))
        self.opens_here = (self.starts >> BIN_BITS) == number
        self.holders: tuple[dict, dict, dict] = ({}, {}, {})
        for k, r in enumerate(rows):
            s = [int(x) for x in r[9]]
            for d, a in zip(s[::2], s[1::2]):
                self.holders[0].setdefault((d, a), []).append(k)
                self.holders[1].setdefault(d, []).append(k)
                self.holders[2].setdefault(a, []).append(k)
        self.sorted = tuple(sorted(h) for h in self.holders)
        self.kept: dict[tuple, np.ndarray | None] = {}

    def _row(self, key: tuple, hits: list) -> np.ndarray | None:
        if (len(self.kept) + 1) * len(self.ids) > KEPT_BYTES:
            self.kept.clear()
        row = None
        if hits:
            row = np.zeros(len(self.ids), dtype=np.uint8)
            for h in hits:
                row[h] = 1
        self.kept[key] = row
        return row

    def sharing(self, d: int, a: int, tolerance: int) -> np.ndarray | None:
        """Which segments have a junction near (``d``, ``a``); None for none."""
        key = (0, d, a)
        if key in self.kept:
            return self.kept[key]
        known = self.sorted[0]
        near = known[bisect_left(known, (d - tolerance,)) : bisect_left(known, (d + tolerance + 1,))]
        return self._row(key, [self.holders[0][x] for x in near if abs(x[1] - a) <= tolerance])

    def with_site(self, side: int, at: int, window: int) -> np.ndarray | None:
        """Which segments have a donor (1) or acceptor (2) near ``at``; None for none."""
        key = (side, at, window)
        if key in self.kept:
            return self.kept[key]
        known = self.sorted[side]
        return self._row(key, [self.holders[side][x] for x in known[bisect_left(known, at - window) : bisect_right(known, at + window)]])

    def wide(self, start: int, end: int, least: int) -> np.ndarray:
        """Which segments overlap the span by ``least``, those met in another bin left out."""
        ok = np.minimum(self.ends, end) - np.maximum(self.starts, start) >= max(least, 1)
        return ok if start >> BIN_BITS == self.bin else ok & self.opens_here

    def matched(self, sites: list[int], tolerance: int) -> np.ndarray | None:
        """How many of the junctions each segment has; None for no segment any."""
        total = None
        for d, a in zip(sites[::2], sites[1::2]):
            if (row := self.sharing(d, a, tolerance)) is not None:
                if total is None:
                    total = row.astype(np.int32)
                else:
                    total += row
        return total


def levels(tolerance: int, window: int, least: int, tie: float):
    """Per query of a tile: the highest numbers of matched junctions, with the first segment and the number of segments that have each, and the known sites.

    A row without ``n_matched`` has known sites only."""

    def answer(tile: Tile, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        last, found = None, []
        for qid, start, end, sites, *_ in rows:
            sites = [int(x) for x in sites]
            if (key := (start, end, sites)) != last:
                last, found = key, _levels_of(tile, start, end, sites)
            out += [(qid, *x) for x in found]
            if len(out) >= PAIRS:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    def _levels_of(tile: Tile, start: int, end: int, sites: list[int]) -> list[tuple]:
        wide = tile.wide(start, end, least)
        if not sites or not wide.any():
            return []
        flags = wide.view(np.uint8)
        known = [[k for k, x in enumerate(sites[side - 1 :: 2]) if (row := tile.with_site(side, x, window)) is not None and (row & flags).any()] for side in (1, 2)]
        found = []
        if (total := tile.matched(sites, tolerance)) is not None:
            at = np.flatnonzero(total * flags)
            n = total[at]
            top, nq = int(n.max(initial=0)), len(sites) // 2
            for level in range(top, 0, -1):
                if (top - level) / nq >= 2 * tie:
                    break
                here = np.flatnonzero(n == level)
                if len(here):
                    k = int(at[here[0]])
                    found.append((level, int(tile.starts[k]), int(tile.ends[k]), tile.ids[k], len(here)))
        found = found or ([(None, None, None, None, None)] if known[0] or known[1] else [])
        return [(*x, *(known if k == 0 else ([], []))) for k, x in enumerate(found)]

    names = ["query_id", "n_matched", "start_pos", "end_pos", "segment_id", "n", "donors", "acceptors"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return answer, "query_id string, n_matched bigint, start_pos bigint, end_pos bigint, segment_id string, n bigint, donors array<int>, acceptors array<int>"


def pairs(tolerance: int, least: int, at_least_known: bool):
    """The pairs of a tile: all that overlap enough or, with ``at_least_known``, those of queries with junctions that match at least ``extra`` of them."""

    def answer(tile: Tile, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids = pa.array(tile.ids, pa.string())
        names: list[str] = []
        at, n, nq, size, last, found = [], [], [], 0, None, None

        def batch() -> pa.RecordBatch:
            which = np.repeat(np.arange(len(names)), [len(x) for x in at])
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(which)), ids.take(pa.array(np.concatenate(at))), pa.array(np.concatenate(n).astype(np.int64)), pa.array(np.repeat(np.array(nq, dtype=np.int64), [len(x) for x in at]))], names=["query_id", "segment_id", "n_matched", "nq"])

        for qid, start, end, sites, extra, _ in rows:
            sites = [int(x) for x in sites]
            if (key := (start, end, sites, extra)) != last:
                last, wide, total = key, tile.wide(start, end, least), tile.matched(sites, tolerance)
                total = np.zeros(len(tile.ids), dtype=np.int32) if total is None else total
                hit = np.flatnonzero(wide & (total >= extra) if at_least_known else wide)
                found = hit, total[hit]
            for low in range(0, len(found[0]), PAIRS):
                names.append(qid)
                at.append(found[0][low : low + PAIRS])
                n.append(found[1][low : low + PAIRS])
                nq.append(len(sites) // 2)
                size += len(at[-1])
                if size >= PAIRS:
                    yield batch()
                    names, at, n, nq, size = [], [], [], [], 0
        if size:
            yield batch()

    return answer, "query_id string, segment_id string, n_matched bigint, nq bigint"


def support(tolerance: int, least: int):
    """Per segment of a tile the summed ``weight`` of the queries that overlap it enough and match at least ``extra`` of their junctions."""

    def answer(tile: Tile, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        total, tied = np.zeros(len(tile.ids), dtype=np.int64), np.zeros(len(tile.ids), dtype=bool)
        for _, start, end, sites, extra, weight in rows:
            matched = tile.matched([int(x) for x in sites], tolerance)
            if matched is not None:
                here = tile.wide(start, end, least) & (matched >= extra)
                tied |= here
                total[here] += weight
        hit = np.flatnonzero(tied)
        if len(hit):
            yield pa.RecordBatch.from_arrays([pa.array(tile.ids, pa.string()).take(pa.array(hit)), pa.array(total[hit])], names=["segment_id", "weight"])

    return answer, "segment_id string, weight bigint"

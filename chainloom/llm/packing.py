"""Filling containers of fixed capacity with whole items, by bounded-space online packing.

Each partition keeps a fixed number of open windows. ``BLOCK`` items at a time
are taken from the scan and placed from the largest, each into the
window it leaves the least space in; if it fits none, the fullest window is
emitted and a new one takes its place. What is open at the end of a partition
are leftovers: whole containers, at most ``OPEN_WINDOWS`` of them per
partition. Leftovers are packed again as items, in a tree whose tasks merge
those of ``FAN_IN`` partitions each, until one partition is left.

An item longer than the capacity is split into full containers and one rest,
which is packed like any other item. Only such items are split.

Defined results: items of size 0 (null, empty or blank text; null or negative
sizes) are placed like others and take no space; repeated items are placed one by one; null ids are
kept; an empty table has no containers.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import durable

OPEN_WINDOWS = 64
#: Items that are put in order of size before they are placed.
BLOCK = 256
FAN_IN = 32


class Windows:
    """Open windows by free space; ``place`` returns the window of an item and the window emitted for it, if any."""

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.most = capacity, most
        self.free: list[tuple[int, int]] = []  # ascending free space, window number
        self.opened = 0

    def place(self, size: int) -> tuple[int, int | None]:
        at = bisect_left(self.free, (size, -1))
        emitted = None
        if at < len(self.free):
            space, window = self.free.pop(at)
        else:
            if len(self.free) >= self.most:
                emitted = self.free.pop(0)[1]
            space, window = self.capacity, self.opened
            self.opened += 1
        insort(self.free, (space - size, window))
        return window, emitted


def _placer(capacity: int):
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # partition and order follow the scan, so that a lost task gives the same rows when it runs again
        part = TaskContext.get().partitionId()
        windows, split = Windows(capacity, OPEN_WINDOWS), 0
        waiting: list[tuple] = []

        def settled() -> list[tuple]:
            rows = []
            for rest, item, full in sorted(waiting, key=lambda x: -x[0]):
                window, _ = windows.place(rest)
                rows.append((f"{part}/{window}", item, full, full + 1, full * capacity, rest))
            waiting.clear()
            return rows

        for pdf in batches:
            rows: list[tuple] = []
            for item, size in zip(pdf["item_id"], pdf["size"]):
                full = (size - 1) // capacity if size > capacity else 0
                for k in range(full):
                    rows.append((f"{part}/s{split}", item, k, full + 1, k * capacity, capacity))
                    split += 1
                waiting.append((size - full * capacity, item, full))
                if len(waiting) == BLOCK:
                    rows += settled()
            yield pd.DataFrame(rows, columns=["local_id", "item_id", "piece", "pieces", "first", "size"])
        yield pd.DataFrame(settled(), columns=["local_id", "item_id", "piece", "pieces", "first", "size"])
        # what each open window holds, as rows without an item
        yield pd.DataFrame([(f"{part}/{window}", None, -1, 0, 0, capacity - space) for space, window in windows.free], columns=["local_id", "item_id", "piece", "pieces", "first", "size"])

    return place


def _merge_node(capacity: int):
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        """At most FAN_IN * OPEN_WINDOWS leftovers meet here; the emptiest OPEN_WINDOWS results stay open for the next round."""
        pdf = pdf.sort_values(["size", "local_id"], ascending=[False, True])
        windows, name, to = Windows(capacity, len(pdf) + 1), {}, []
        for item, size in zip(pdf["local_id"], pdf["size"]):
            window, _ = windows.place(int(size))
            to.append(name.setdefault(window, item))
        used = {name[window]: capacity - space for space, window in windows.free}
        stays = {name[window] for _, window in windows.free[-OPEN_WINDOWS:]}
        return pd.DataFrame({"node": pdf["node"], "local_id": pdf["local_id"], "to_id": to, "to_size": [used[x] for x in to], "stays": [x in stays for x in to]})

    return merge


def _merge_leftovers(leftovers: DataFrame, partitions: int, capacity: int) -> DataFrame:
    """(local_id, merged_id): the container that takes each leftover, by rounds of FAN_IN partitions to a task."""
    assigned = leftovers.select("local_id", F.col("local_id").alias("merged_id"))
    still_open = leftovers.select("local_id", "size", F.split("local_id", "/")[0].cast("int").alias("node"))
    while True:
        partitions = -(-partitions // FAN_IN)
        nodes = still_open.withColumn("node", F.floor(F.col("node") / FAN_IN).cast("int"))
        placed = durable(nodes.groupBy("node").applyInPandas(_merge_node(capacity), "node int, local_id string, to_id string, to_size bigint, stays boolean"))
        assigned = assigned.join(placed.select(F.col("local_id").alias("merged_id"), "to_id"), "merged_id", "left").select("local_id", F.coalesce("to_id", "merged_id").alias("merged_id"))
        still_open = placed.filter("stays and local_id = to_id").select("local_id", F.col("to_size").alias("size"), "node")
        if partitions <= 1:
            return assigned


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """Place (item_id, size) into containers: (container_id, item_id, piece, pieces, first, size).

    ``piece`` counts the pieces of an item from 0, ``pieces`` is their number, ``first`` the offset of a piece in its item.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    # ids travel as text, because a batch with a null among them would turn the others into floating point
    kind = items.schema["item_id"].dataType
    sized = items.select(F.col("item_id").cast("string").alias("item_id"), F.greatest(F.coalesce(F.col("size").cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    placed = durable(sized.mapInPandas(_placer(capacity), "local_id string, item_id string, piece bigint, pieces bigint, first bigint, size bigint"))
    leftovers = placed.filter("pieces = 0").select("local_id", "size")
    merged = _merge_leftovers(leftovers, max(1, placed.rdd.getNumPartitions()), capacity)
    rows = placed.filter("pieces > 0").join(merged, "local_id", "left")
    return rows.select(F.coalesce("merged_id", "local_id").alias("container_id"), F.col("item_id").cast(kind).alias("item_id"), "piece", "pieces", "first", "size")


def containers(packed: DataFrame, capacity: int) -> DataFrame:
    """(container_id, n_items, used, unused) of every container."""
    return packed.groupBy("container_id").agg(F.count(F.lit(1)).alias("n_items"), F.sum("size").alias("used")).withColumn("unused", capacity - F.col("used"))

"""Combining sources to target shares of the total size, by the cube method.

A source's goal is its weight's share of all tokens of the listed sources. If
the goal is r times what the source holds, each of its items is used floor(r)
times and once more with probability r - floor(r); where r exceeds the source's
repeat limit, every item is used as often as the limit allows.

The fractional probabilities become 0 or 1 by the cube method's flight phase:
a direction in the null space of the constraints changes neither the sum of the
probabilities nor the expected size; the probabilities of a window of undecided
items move along it, one way or the other at random, until one is decided. Each partition does this for each source
and is left with at most ``LANDING`` undecided items; those of FAN_IN partitions are
decided together, in a tree. The last undecided items of a source are the
landing problem: of all their combinations the one that misses the goals in size
and number least is taken. An item that outweighs all
others is among these, together with smaller ones that make up for it.

Defined results: items of no listed source are left out; null sizes count 0;
null or negative weights count 0 and a null repeat limit is 1; a listed source
without items is ``short`` when its goal is positive; two targets that spell the
same source alike are an error; empty tables give an empty sample and a report
with nothing picked. Where a source is short, nothing else makes up for it: the
others keep their goals, and ``share_of_goals`` has what each reaches of all goals
beside ``share``, its part of all that is picked.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import checked_broadcast, durable

FAN_IN = 32
#: Undecided items that a task holds per source.
WINDOW = 24
#: Undecided items at which a flight ends and the landing begins.
LANDING = 10
#: Targets that are sent to all tasks; more are joined by a shuffle.
SENT_TARGETS = 10_000
_EPS = 1e-9


def source_key(c: Column) -> Column:
    """Spelling that ignores case, outer blanks and what stands between words."""
    bare = F.regexp_replace(c, r"^[\s\u00a0]+|[\s\u00a0]+$", "")
    return F.nullif(F.regexp_replace(F.lower(bare), r"[\s\u00a0_-]+", "_"), F.lit(""))


class Flight:
    """Decides the items of one source as they come, holding at most ``WINDOW`` of them.

    The direction is the part of the largest item's own axis that keeps both sums: that item moves most and all others
    a little, so that it is decided while there are others to make up for it.
    """

    def __init__(self, rng: np.random.Generator) -> None:
        self.random = rng.random
        self.items: list[tuple] = []
        self.p, self.size = np.zeros(WINDOW), np.zeros(WINDOW)

    def add(self, item: tuple, p: float, size: float) -> list[tuple]:
        """The items decided by the arrival of this one, as (item, size, 0 or 1)."""
        if p <= _EPS or p >= 1 - _EPS:
            return [(item, size, int(p > 0.5))]
        n = len(self.items)
        self.items.append(item)
        self.p[n], self.size[n] = p, size
        out: list[tuple] = []
        while len(self.items) == WINDOW:
            out += self._move()
        return out

    def finish(self) -> list[tuple]:
        """Go on without further items until at most ``LANDING`` are undecided."""
        out: list[tuple] = []
        while len(self.items) > LANDING:
            out += self._move()
        return out

    def left(self) -> list[tuple]:
        return [(item, float(p), int(s)) for item, p, s in zip(self.items, self.p, self.size)]

    def _direction(self, size: np.ndarray) -> np.ndarray:
        n = len(size)
        even = np.full(n, n**-0.5)
        slope = size - size.mean()
        norm = float(np.sqrt(slope @ slope))
        slope = slope / norm if norm > _EPS else np.zeros(n)
        k = int(size.argmax())
        free = 1 - 1 / n - slope * slope
        if free[k] < 1e-6:  # nothing can make up for it; take the item that can move most
            k = int(free.argmax())
        u = -even[k] * even - slope[k] * slope
        u[k] += 1
        return u

    def _move(self) -> list[tuple]:
        n = len(self.items)
        p, size = self.p[:n], self.size[:n]
        u = self._direction(size)
        up, down = u > 1e-12, u < -1e-12
        room = np.full(n, np.inf)
        room[up], room[down] = (1 - p[up]) / u[up], -p[down] / u[down]
        back = np.full(n, np.inf)
        back[up], back[down] = p[up] / u[up], (p[down] - 1) / u[down]
        most, least = float(room.min()), float(back.min())
        forward = self.random() * (most + least) < least
        p += (most if forward else -least) * u
        # the item that sets the step is decided, whatever rounding says
        k = int(room.argmin() if forward else back.argmin())
        p[k] = round(p[k])
        done = (p <= _EPS) | (p >= 1 - _EPS)
        out = [(self.items[i], int(size[i]), int(p[i] > 0.5)) for i in np.flatnonzero(done)]
        keep = np.flatnonzero(~done)
        self.items = [self.items[i] for i in keep]
        self.p[: len(keep)], self.size[: len(keep)] = p[keep], size[keep]
        return out


def _random(seed: int, part: int, key: str, round_no: int = 0) -> np.random.Generator:
    return np.random.default_rng([seed, part, zlib.crc32(key.encode()), round_no])


_COLUMNS = ["node", "key", "item_id", "size", "whole", "picked", "p"]
_SCHEMA = "node int, key string, item_id string, size bigint, whole int, picked int, p double"


def _flyer(seed: int):
    def fly(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        flights: dict[str, Flight] = {}
        for pdf in batches:
            rows: list[tuple] = []
            for item, k, size, whole, p in zip(pdf["item_id"], pdf["key"], pdf["size"], pdf["whole"], pdf["p"]):
                flight = flights.get(k)
                if flight is None:
                    flight = flights[k] = Flight(_random(seed, part, k))
                rows += [(part, k, i, s, w, x, None) for (i, w), s, x in flight.add((item, whole), p, size)]
            yield pd.DataFrame(rows, columns=_COLUMNS)
        last = [(part, k, i, s, w, x, None) for k, f in flights.items() for (i, w), s, x in f.finish()]
        yield pd.DataFrame(last + [(part, k, i, s, w, None, p) for k, f in flights.items() for (i, w), p, s in f.left()], columns=_COLUMNS)

    return fly


def landed(left: list[tuple]) -> list[int]:
    """0 or 1 for each undecided (item, p, size): the combination that misses least. A tenth of the mean size counts as much as one item in the number."""
    p, size = np.array([h[1] for h in left]), np.array([h[2] for h in left])
    choices = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    miss = 10 * np.abs(choices @ size - p @ size) / max(size.mean(), _EPS) + np.abs(choices.sum(axis=1) - p.sum())
    return choices[miss.round(6).argmin()].tolist()


def _decider(seed: int, round_no: int, land: bool):
    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        """At most LANDING * FAN_IN undecided items of one source meet here."""
        pdf = pdf.assign(known=pdf["item_id"].fillna("")).sort_values(["size", "known"], ascending=[False, True])
        k, node = pdf["key"].iloc[0], int(pdf["node"].iloc[0])
        flight = Flight(_random(seed, node, k, round_no))
        rows: list[tuple] = []
        for item, size, whole, p in zip(pdf["item_id"], pdf["size"], pdf["whole"], pdf["p"]):
            rows += [(node, k, i, s, w, x, None) for (i, w), s, x in flight.add((item, whole), p, size)]
        rows += [(node, k, i, s, w, x, None) for (i, w), s, x in flight.finish()]
        left = flight.left()
        if land and left:
            rows += [(node, k, h[0][0], h[2], h[0][1], x, None) for h, x in zip(left, landed(left))]
        else:
            rows += [(node, k, i, s, w, None, p) for (i, w), p, s in left]
        return pd.DataFrame(rows, columns=_COLUMNS)

    return decide


def plan(totals: DataFrame, targets: DataFrame) -> DataFrame:
    """(key, source, target_share, goal, held, n_items, outcome, whole, p) of each target: ``outcome`` is ``sample``, ``repeat`` or ``short``,
    each item is used ``whole`` times and once more with probability ``p``.

    ``totals`` has (key, held, n_items), ``targets`` (source, weight, max_repeats).
    """
    weight = F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))
    most = F.greatest(F.coalesce(F.col("max_repeats").cast("int"), F.lit(1)), F.lit(0))
    listed = targets.select(source_key(F.col("source")).alias("key"), "source", weight.alias("weight"), most.alias("most")).filter("key is not null")
    spelt = listed.groupBy("key").agg(F.count(F.lit(1)).alias("times"))
    twice = F.when(F.col("times") > 1, F.raise_error(F.concat(F.lit("targets that spell one source alike: "), "key")).cast("string")).otherwise(F.col("key"))
    single = listed.join(spelt, "key").withColumn("key", twice).drop("times")
    joined = single.join(totals, "key", "left").fillna(0, ["held", "n_items"])
    sums = joined.agg(F.sum("weight").alias("weights"), F.sum("held").alias("everything"))
    share = F.when(F.col("weights") > 0, F.col("weight") / F.col("weights")).otherwise(F.lit(0.0))
    goals = joined.withColumns({"weights": sums.select("weights").scalar(), "everything": sums.select("everything").scalar()}).withColumn("target_share", share).withColumn("goal", F.col("target_share") * F.col("everything"))
    outcome = F.when(F.col("goal") <= F.col("held"), "sample").when(F.col("goal") <= F.col("most") * F.col("held"), "repeat").otherwise("short")
    ratio = F.when(F.col("outcome") == "short", F.col("most").cast("double")).otherwise(F.least(F.when(F.col("held") > 0, F.col("goal") / F.col("held")).otherwise(F.lit(0.0)), F.col("most").cast("double")))
    planned = goals.withColumn("outcome", outcome).withColumn("ratio", ratio)
    return planned.select("key", "source", "target_share", "goal", F.col("held").cast("long").alias("held"), "n_items", "outcome", F.floor("ratio").cast("int").alias("whole"), (F.col("ratio") - F.floor("ratio")).alias("p"))


def mix(items: DataFrame, targets: DataFrame, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Sample of (item_id, source, size) against (source, weight, max_repeats).

    Returns the picks (source, item_id, size, copies), with copies > 0, and the report per target
    (source, outcome, target_share, goal, held, n_items, picked, picked_items, share, share_of_goals).
    """
    # ids travel as text, because a batch with a null among them would turn the others into floating point
    kind = items.schema["item_id"].dataType
    sized = durable(items.select(F.col("item_id").cast("string").alias("item_id"), source_key(F.col("source")).alias("key"), F.coalesce(F.col("size").cast("long"), F.lit(0).cast("long")).alias("size")).filter("key is not null"))
    totals = sized.groupBy("key").agg(F.sum("size").alias("held"), F.count(F.lit(1)).alias("n_items"))
    planned = durable(plan(totals, targets))
    small = checked_broadcast(planned.select("key", "whole", "p"), SENT_TARGETS)
    # large items first: the undecided ones at the end are small, and so is what the landing can miss
    ordered = sized.join(small, "key").select("item_id", "key", "size", "whole", "p").sortWithinPartitions(F.desc("size"), "item_id")
    flown = durable(ordered.mapInPandas(_flyer(seed), _SCHEMA))
    decided, undecided = flown.filter("picked is not null"), flown.filter("picked is null")
    partitions, round_no = max(1, flown.rdd.getNumPartitions()), 0
    while True:
        partitions, round_no = -(-partitions // FAN_IN), round_no + 1
        nodes = undecided.withColumn("node", F.floor(F.col("node") / FAN_IN).cast("int"))
        met = durable(nodes.groupBy("node", "key").applyInPandas(_decider(seed, round_no, partitions == 1), _SCHEMA))
        decided = decided.unionByName(met.filter("picked is not null"))
        if partitions == 1:
            break
        undecided = met.filter("picked is null")
    used = decided.withColumn("copies", F.col("whole") + F.col("picked")).filter("copies > 0")
    picks = used.join(checked_broadcast(planned.select("key", "source"), SENT_TARGETS), "key").select("source", F.col("item_id").cast(kind).alias("item_id"), "size", "copies")
    sums = used.groupBy("key").agg(F.sum(F.col("size") * F.col("copies")).alias("picked"), F.sum(F.col("copies").cast("long")).alias("picked_items"))
    whole = sums.agg(F.sum("picked")).scalar()
    goals = planned.agg(F.sum("goal")).scalar()
    rows = planned.join(sums, "key", "left").fillna(0, ["picked", "picked_items"])
    report = rows.select("source", "outcome", "target_share", "goal", "held", "n_items", "picked", "picked_items", F.coalesce(F.try_divide("picked", whole), F.lit(0.0)).alias("share"), F.coalesce(F.try_divide("picked", goals), F.lit(0.0)).alias("share_of_goals"))
    return picks, report

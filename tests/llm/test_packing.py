import random

import regex
from pyspark.sql import functions as F

from chainloom.llm import packing
from chainloom.llm.tokens import n_tokens

SCHEMA = "item_id bigint, size bigint, local_id string, pieces int"


def packed(spark, items, capacity, parts=3):
    df = spark.createDataFrame([(i, s, "x", 7) for i, s in items], SCHEMA).repartition(parts)
    return packing.pack(df, capacity).collect()


def check(rows, items, capacity):
    used, pieces = {}, {}
    for r in rows:
        used[r["container_id"]] = used.get(r["container_id"], 0) + r["size"]
        pieces.setdefault(r["item_id"], []).append(r)
    assert max(used.values(), default=0) <= capacity
    assert sorted(pieces, key=repr) == sorted({i for i, _ in items}, key=repr)
    for i, size in {i: s for i, s in items if [j for j, _ in items].count(i) == 1}.items():
        own = sorted(pieces[i], key=lambda r: r["piece"])
        assert sum(r["size"] for r in own) == max(size or 0, 0)
        assert [r["first"] for r in own] == [capacity * k for k in range(len(own))]
        assert (len(own) > 1) == ((size or 0) > capacity) and all(r["pieces"] == len(own) for r in own)
    return used


def test_whole_items_and_split_ones(spark):
    rng = random.Random(1)
    items = [(i, rng.choice([0, 1, 99, 100, 101, 250, 300]) if i % 5 == 0 else rng.randrange(1, 80)) for i in range(1500)] + [(10**18, None), (-1, -4)]
    used = check(packed(spark, items, 100), items, 100)
    total = sum(max(s or 0, 0) for _, s in items)
    assert len(used) * 100 < 1.06 * total


def test_leftovers_of_many_partitions_are_merged(spark):
    items = [(i, 10) for i in range(200)]
    used = check(packed(spark, items, 100, parts=70), items, 100)
    assert len(used) <= 40


def test_null_ids_repeats_and_empty_table(spark):
    items = [(None, 5), (None, 250), (3, 5), (3, 5), (2**62, 7)]
    rows = packed(spark, items, 100)
    assert sum(r["size"] for r in rows) == 272 and {r["item_id"] for r in rows} == {None, 3, 2**62}
    assert packed(spark, [], 100) == []


def test_tokens_match_the_public_pattern(spark):
    rng = random.Random(2)
    letters = "ab_9 ß\u00a0\u2003\u0085\n\t.,\\{}é日本😀\u0301-—"
    texts = [None, "", "  ", "a" * 100_000] + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    want = {i: len(regex.findall(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+", t or "")) for i, t in enumerate(texts)}
    assert {r[0]: r[1] for r in df.select("i", n_tokens(F.col("t"))).collect()} == want

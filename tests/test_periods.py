import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from chainloom.operators import periods

SCHEMA = "seqid string, gene_id string, start_pos bigint, end_pos bigint, level int, shard string, runs string"


def brute(rows):
    """(gaps, periods) by merging sorted intervals."""
    by, gaps, out = {}, [], []
    for q, g, s, e, *_ in rows:
        if None not in (q, g, s, e) and s <= e:
            by.setdefault((q, g), []).append((s, e))
    for k, spans in by.items():
        spans.sort()
        start, end = spans[0]
        for s, e in spans[1:]:
            if s > end + 1:
                gaps.append((*k, end + 1, s - 1))
                out.append((*k, start, end))
                start = s
            end = max(end, e)
        out.append((*k, start, end))
    return sorted(gaps), sorted(out)


def both(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    args = (["seqid", "gene_id"], "start_pos", "end_pos")
    return tuple(sorted(map(tuple, f(df, *args).collect())) for f in (periods.gaps, periods.periods))


def test_borders_of_shards_and_long_intervals(spark):
    b = 1 << 16
    rows = [
        ("a", "touch", 1, b - 1), ("a", "touch", b, b + 5), ("a", "gap", 5, b - 2), ("a", "gap", b + 1, 3 * b), ("a", "nest", 1, 10), ("a", "nest", 2, 3), ("a", "nest", 11, 12), ("a", "nest", 14, 14),
        ("a", "long", 100, 1 << 40), ("a", "long", (1 << 40) + 2, (1 << 40) + 2), ("a", "long", 7, 8), ("a", "over", 10, 20 * b), ("a", "over", 5 * b + 3, 5 * b + 4), ("a", "over", 5 * b + 9, 5 * b + 9), ("a", "end", 1, 2**62),
        ("a", "rev", 9, 3), ("a", "rev", 4, 4), ("b", "nest", 7, 7), (None, "x", 1, 2), ("a", None, 1, 2), ("a", "null", None, 4), ("a", "null", 5, None),
    ]
    assert both(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert both(spark, []) == ([], [])


def test_hot_entity_over_many_shards(spark):
    rng = random.Random(5)
    rows = [("s", "hot" if rng.random() < 0.5 else f"g{rng.randrange(40)}", s := rng.randrange(1, 3_000_000), s + int(rng.expovariate(1 / 900))) for _ in range(6000)]
    assert both(spark, rows + rows[:500]) == brute(rows)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from("xy"), st.integers(1, 1 << 20), st.integers(0, 1 << 18)), max_size=25))
def test_random_intervals(spark, data):
    rows = [(q, g, s, s + n) for q, g, s, n in data]
    assert both(spark, rows) == brute(rows)

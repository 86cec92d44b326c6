from pyspark.sql import functions as F

from chainloom.functions.keys import gene_key, sequence_key
from chainloom.operators import heavy_keys


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_keys_are_normalised(spark):
    df = spark.createDataFrame([(" G1.2 ", "1"), ("G1", "chr1 "), (" G1", "MT"), ("", "X"), (None, None), (" .5", "scf_1"), ("G.1.2", " ")], "gene_id string, seqid string")
    got = [tuple(r) for r in df.select(gene_key(F.col("gene_id")), sequence_key(F.col("seqid"))).collect()]
    assert got == [("G1", "chr1"), ("G1", "chr1"), ("G1", "chrM"), (None, "chrX"), (None, None), (None, "scf_1"), ("G.1", None)]


def test_share_counts_rows_without_key(spark):
    df = spark.createDataFrame([("a",)] * 4 + [("b",)] * 3 + [(None,)] * 93, "k string")
    assert rows(heavy_keys.keys_above_share(df, F.col("k"), 4)) == [("a", 4)]


def test_profile_of_a_hot_key_matches_brute_force(spark):
    data = [("hot" if i % 3 else f"k{i % 7}", i % 11, None if i % 5 == 0 else i % 4) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, v int, d int").repartition(4)
    got = {r["key_text"]: (r["n"], r["s"], r["u"]) for r in heavy_keys.key_profile(df, F.col("k"), [F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")], {"u": F.col("d")}).collect()}
    want = {}
    for k in {x[0] for x in data}:
        own = [x for x in data if x[0] == k]
        want[k] = (len(own), sum(x[1] for x in own), len({x[2] for x in own} - {None}))
    assert got == want


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "k string, key_text string, n_rows int")
    assert rows(heavy_keys.keys_above_share(empty, F.col("k"), 4)) == []
    clash = spark.createDataFrame([("a", "x", 7)], "k string, key_text string, n_rows int")
    assert rows(heavy_keys.keys_above_share(clash, F.col("k"), 4)) == [("a", 1)]
    assert rows(heavy_keys.key_profile(clash, F.col("k"), [F.sum("n_rows").alias("s")], {"u": F.col("key_text")})) == [("a", 7, 1)]

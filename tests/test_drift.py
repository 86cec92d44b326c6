import datetime as dt
import json

from chainloom.operators import drift

FILES = "file_id bigint, provider string, feature_kind string, delivered_at timestamp, kind string, n int, field string"
RECORDS = "record_id bigint, file_id bigint, rec_key string, payload string, field string, v string"


def setup(spark, payloads, files=None):
    """payloads: {file_id: {rec_key: object or text}}; files are delivered in the order given, an hour apart."""
    order = files or list(payloads)
    f = spark.createDataFrame([(i, "p", "exon", dt.datetime(2024, 1, 1, 20) + dt.timedelta(hours=n), "z", n, "f") for n, i in enumerate(order)], FILES)
    rows = [(n, i, k, p if p is None or isinstance(p, str) else json.dumps(p), "x", "y") for n, (i, k, p) in enumerate((i, k, p) for i, ps in payloads.items() for k, p in ps.items())]
    return f, spark.createDataFrame(rows, RECORDS)


def changes(spark, payloads, files=None):
    return sorted((r["file_id"], r["change_kind"], r["old_field"], r["new_field"]) for r in drift.changes(*setup(spark, payloads, files)).collect())


def test_rename_with_change_of_type(spark):
    a = {f"k{i}": {"id": i, "a": "x"} for i in range(10)}
    b = {f"k{i}": {"ID": str(i), "a": "x"} for i in range(10)}
    assert changes(spark, {9: a, 3: b}) == [(3, "renamed", "id", "ID"), (3, "type_changed", "id", "ID")]


def test_nine_of_ten(spark):
    a = {f"k{i}": {"id": f"v{i}"} for i in range(10)}
    nine = {f"k{i}": {"new": f"v{i}" if i else "other"} for i in range(10)}
    eight = {f"k{i}": {"new": f"v{i}" if i > 1 else "other"} for i in range(10)}
    assert changes(spark, {1: a, 2: nine}) == [(2, "renamed", "id", "new")]
    assert changes(spark, {1: a, 2: eight}) == [(2, "added", "", "new"), (2, "removed", "id", "")]


def test_nulls_bad_payloads_and_order(spark):
    out = changes(spark, {5: {"k": {"a": None, "b": 1}}, 1: {"k": {"a": "s", "b": [1]}, "bad": "{", "list": "[1]", "none": None}, 2: {"k": {"a": 2.5, "B": {"x": 1}}}}, files=[5, 1, 2, 7])
    assert out == [(1, "type_changed", "b", "b"), (2, "added", "", "B"), (2, "removed", "b", ""), (2, "type_changed", "a", "a"), (7, "removed", "B", ""), (7, "removed", "a", "")]


def test_odd_names_and_streams_are_apart(spark):
    assert changes(spark, {1: {"k": {"a'b.c": 1, "x y": "t", "back\\slash": 1}}, 2: {"k": {"a'b.c": "1", "x y": "t", "back\\slash": True}}}) == [(2, "type_changed", "a'b.c", "a'b.c"), (2, "type_changed", "back\\slash", "back\\slash")]


def test_empty_tables(spark):
    f, r = setup(spark, {1: {"k": {"a": 1}}})
    assert drift.changes(f.limit(0), r).count() == 0
    assert drift.changes(f, r.limit(0)).count() == 0
    assert drift.unified(f.limit(0), r.limit(0)).count() == 0


def test_unified_follows_renames_and_promotes(spark):
    a = {f"k{i}": {"id": i, "t": 1} for i in range(10)}
    b = {f"k{i}": {"ID": i, "t": "one"} for i in range(10)}
    out = drift.unified(*setup(spark, {1: a, 2: b})).collect()
    assert {r["name"] for r in out} == {"ID", "t"} and len(out) == 40
    assert {r["kind"] for r in out if r["name"] == "ID"} == {"number"} and {r["kind"] for r in out if r["name"] == "t"} == {"string"}


def test_unified_is_typed_and_keeps_records_without_fields(spark):
    out = drift.unified(*setup(spark, {1: {"k": {"n": 2.50, "b": True, "s": "7", "o": {"x": 1}, "m": 1}, "empty": {}, "list": "[1]", "bad": "{", "none": None}, 2: {"k": {"m": False}}})).collect()
    got = {(r["file_id"], r["name"]): (r["kind"], r["text"], r["number"], r["truth"]) for r in out if r["name"]}
    assert got == {(1, "n"): ("number", "2.5", 2.5, None), (1, "b"): ("boolean", "true", None, True), (1, "s"): ("string", "7", None, None), (1, "o"): ("object", '{"x":1}', None, None), (1, "m"): ("string", "1", None, None), (2, "m"): ("string", "false", None, None)}
    assert sorted(r["rec_key"] for r in out if r["name"] is None) == ["bad", "empty", "list", "none"]


def test_only_the_repeated_field_is_without_value(spark):
    payloads = {
        "twice": '{"a": 1, "x": "s\\u00e9", "a": 2, "n": null, "d": 5.0, "y": {"k": [1, {"q": "}"}]}}', "inner": '{"o": {"r": 1, "r": 2}, "b": true, "l" : [ ] }',
        "lenient": "{'a': 1, 'z': 2}", "big": '{"a": 1, "a": 1, "i": 12345678901234567890}',
    }
    _, records = setup(spark, {1: payloads})
    got = {(r["rec_key"], r["field"]): (r["kind"], r["text"]) for r in drift.fields(records).collect()}
    assert got == {
        ("twice", "a"): (None, None), ("twice", "x"): ("string", "sé"), ("twice", "n"): (None, None), ("twice", "d"): ("number", "5"), ("twice", "y"): ("object", '{"k":[1,{"q":"}"}]}'),
        ("inner", "o"): ("object", '{"r": 1, "r": 2}'), ("inner", "b"): ("boolean", "true"), ("inner", "l"): ("array", "[]"), ("lenient", "a"): (None, None), ("lenient", "z"): (None, None),
        ("big", "a"): (None, None), ("big", "i"): ("number", "12345678901234567890"),
    }
    a = {f"k{i}": f'{{"id": {i}, "r": 1, "r": 2}}' for i in range(10)}
    assert changes(spark, {1: a, 2: {k: v.replace('"id"', '"ID"') for k, v in a.items()}}) == [(2, "renamed", "id", "ID")]


def test_fields_of_equal_values_are_all_renamed(spark):
    a = {f"k{i}": {"A": 1, "B": 1, "C": i} for i in range(10)}
    b = {f"k{i}": {"X": 1, "Y": 1, "Z": i} for i in range(10)}
    assert changes(spark, {1: a, 2: b}) == [(2, "renamed", "A", "X"), (2, "renamed", "B", "Y"), (2, "renamed", "C", "Z")]
    c = {f"k{i}": {"X": 1, "Z": i} for i in range(10)}
    assert changes(spark, {1: a, 2: c}) == [(2, "removed", "B", ""), (2, "renamed", "A", "X"), (2, "renamed", "C", "Z")]


def test_previous_file_over_days_without_any(spark):
    f = spark.createDataFrame([(1, "p", "e", dt.datetime(2024, 1, 1), "", 0, ""), (2, "p", "e", dt.datetime(2024, 3, 1), "", 0, ""), (3, "p", "e", dt.datetime(2024, 3, 1), "", 0, ""), (4, "q", "e", dt.datetime(2024, 3, 1), "", 0, "")], FILES)
    assert sorted((r["file_id"], r["prev_id"] or 0) for r in drift.with_previous(f).collect()) == [(1, 0), (2, 1), (3, 2), (4, 0)]


def test_lattice(spark):
    cases = {(): "null", ("number",): "number", ("array",): "array", ("boolean", "number"): "string", ("number", "string"): "string", ("array", "number"): "variant", ("array", "object"): "variant"}
    df = spark.createDataFrame([(list(k), v) for k, v in cases.items()], "k array<string>, v string")
    assert all(r["v"] == r["p"] for r in df.withColumn("p", drift.promoted(df["k"])).collect())


def test_columns_follow_long_chains_of_renames_and_keep_own_kinds(spark):
    """Eight renames in a row, met in any order, are one column; a column of arrays and numbers is a variant, one without values null."""
    names = ["n5", "n8", "n2", "n7", "n1", "n9", "n3", "n6", "n4"]
    feed = {n: {f"k{i}": {name: f"v{i}", "mixed": [1] if n % 2 else i, "void": None} for i in range(4)} for n, name in enumerate(names, 1)}
    out = drift.unified(*setup(spark, feed)).collect()
    assert {r["name"] for r in out} == {"n1", "mixed", "void"}
    assert {(r["kind"], r["value_kind"]) for r in out if r["name"] == "mixed"} == {("variant", "array"), ("variant", "number")}
    assert {(r["kind"], r["text"]) for r in out if r["name"] == "void"} == {("null", None)}

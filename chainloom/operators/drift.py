"""One consistent table from files whose fields are added, renamed, removed or change type.

Each file's schema is folded from its payloads with partial aggregation: the
set of JSON kinds of every top-level field, as bits. Files are compared with the
one delivered just before for the same provider and feature kind; values are read
again only for the fields that may have been renamed. Kinds promote through a
lattice: null below all, boolean and number below string, array and object apart
from these, variant above all.

Defined results: a payload that is no JSON object names no fields; a payload
with a repeated field names it, but gives it no value (its other fields have
theirs; a value with a repeated field inside, or beyond the size of a variant,
counts as it is written); a payload that only a lenient reader takes (single
quotes, text after the object) names its fields without values; a field that is null
throughout has no kind and causes no ``type_changed``; a file without records
has no fields; records of unknown files are left out; of repeated rec_keys in
a file the record with the largest record_id counts; equal delivery times are
ordered by file_id. Of several possible renames of a field the one that agrees
most often counts, then the one with more common keys, then by name; fields whose
best match is taken go to the best one that is left.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import checked_broadcast, durable
from ..plans.grouped import fold_groups

#: Share of common non-null values, in tenths, from which a gone and a new field are the same.
RENAME_TENTHS = 9
#: Fields of files, of those that may have been renamed, that are sent to all tasks; more are joined by a shuffle.
SENT_FIELDS = 200_000
# The kinds of JSON values in alphabetical order; a set of kinds is a number with one bit for each.
KINDS = ("array", "boolean", "number", "object", "string")
STREAM = ["provider", "feature_kind"]


def _kind(v: Column) -> Column:
    """JSON kind of a variant; null for JSON null."""
    t = F.schema_of_variant(v)
    return (
        F.when(t == "VOID", F.lit(None))
        .when(t.startswith("OBJECT"), F.lit("object"))
        .when(t.startswith("ARRAY"), F.lit("array"))
        .when(t == "BOOLEAN", F.lit("boolean"))
        .when(t == "STRING", F.lit("string"))
        .otherwise(F.lit("number"))
    )


_KINDS = {"{": "object", "[": "array", '"': "string", "t": "boolean", "f": "boolean", "n": None}
_BLANKS = re.compile(r"[ \t\n\r]*")
_DECODER = json.JSONDecoder(strict=False, parse_int=str, parse_float=str)


def _utf8(s: str) -> str:
    return s.encode("utf-8", "replace").decode()


def _members(payload: str) -> list[tuple[str, str]]:
    """Names and values, as written, of the top-level fields of a JSON object; ValueError where it is none."""

    def skip(at: int, expected: str = "") -> int:
        at = _BLANKS.match(payload, at).end()
        if expected and payload[at : at + 1] not in expected.split("|"):
            raise ValueError(f"no {expected} at {at}")
        return at

    out = []
    at = skip(skip(0, "{") + 1, '"|}')
    while payload[at] != "}":
        name, at = scanstring(payload, skip(at, '"') + 1, False)
        begin = skip(skip(at, ":") + 1)
        try:
            _, end = _DECODER.raw_decode(payload, begin)
        except StopIteration as e:
            raise ValueError("no value") from e
        out.append((_utf8(name), payload[begin:end]))
        at = skip(end, ",|}")
        at += payload[at] == ","
    if skip(at + 1) < len(payload):
        raise ValueError("text after the object")
    return out


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Payloads to their fields with each value as written, its kind and its text; repeated fields and those of no strict JSON have none."""
    for pdf in batches:
        rows = []
        for *ids, names, payload in zip(*(pdf[c] for c in ("record_id", "file_id", "rec_key", "names", "payload"))):
            try:
                members = _members(payload)
            except (ValueError, RecursionError):
                members = []
            times = Counter(name for name, _ in members)
            single = {name: value for name, value in members if times[name] == 1}
            for name in names:
                value = single.get(name)
                kind = _KINDS.get(value[0], "number") if value else None
                text = None if kind is None else _utf8(scanstring(value, 1, False)[0]) if kind == "string" else value
                rows.append((*ids, name, value, kind, text))
        yield pd.DataFrame(rows, columns=["record_id", "file_id", "rec_key", "field", "written", "written_kind", "written_text"])


def _odd(payload: Column, parsed: Column) -> Column:
    """Whether a payload names fields but is no variant: it repeats a field, on whatever level, is too large, or only a lenient reader takes it."""
    return parsed.isNull() & F.json_object_keys(payload).isNotNull()


_IDS = ["record_id", "file_id", "rec_key"]


def _parsed(records: DataFrame) -> DataFrame:
    """(record_id, file_id, rec_key, is_odd, field, value) of the top-level fields of each payload; one row without field where there are none."""
    v = records.select(*_IDS, "payload", F.try_parse_json("payload").alias("v"))
    marked = v.select(*_IDS, _odd(F.col("payload"), F.col("v")).alias("is_odd"), "v")
    return marked.lateralJoin(records.sparkSession.tvf.variant_explode_outer(F.col("v").outer())).select(*_IDS, "is_odd", F.col("key").alias("field"), "value")


def _cut_out(records: DataFrame) -> DataFrame:
    """(record_id, file_id, rec_key, field, kind, text) of the odd payloads among ``records``, whose fields are cut out one by one."""
    odd = records.filter(_odd(F.col("payload"), F.try_parse_json("payload")))
    # ids pass as text, as pandas makes floats of integers with nulls
    named = odd.select(*(F.col(c).cast("string") for c in _IDS), F.array_distinct(F.json_object_keys("payload")).alias("names"), "payload")
    parts = named.mapInPandas(_cut, "record_id string, file_id string, rec_key string, field string, written string, written_kind string, written_text string").withColumns({c: F.col(c).cast(records.schema[c].dataType) for c in _IDS} | {"value": F.try_parse_json("written")})
    # the kind and text as written count where the value itself is no variant either
    bare = F.col("value").isNull()
    return parts.select(*_IDS, "field", F.when(bare, F.col("written_kind")).otherwise(_kind(F.col("value"))).alias("kind"), F.when(bare, F.col("written_text")).otherwise(F.col("value").cast("string")).alias("text"))


def fields(records: DataFrame, odd_files: DataFrame | None = None) -> DataFrame:
    """(record_id, file_id, rec_key, field, kind, text) of every top-level field; kind and text are null for JSON null.

    ``odd_files`` has the (file_id) of the files that hold odd payloads, if that is known; others needn't be read for them.
    """
    whole = _parsed(records).filter("field is not null").select(*_IDS, "field", _kind(F.col("value")).alias("kind"), F.col("value").cast("string").alias("text"))
    if odd_files is None:
        return whole.unionByName(_cut_out(records))
    return whole if odd_files.isEmpty() else whole.unionByName(_cut_out(records.join(odd_files, "file_id", "left_semi")))


def with_previous(files: DataFrame) -> DataFrame:
    """(file_id, provider, feature_kind, delivered_at, prev_id): the file delivered just before in the same stream.

    Deliveries are first ordered within a day; only the first file of a day
    looks to the last one of the day before it that has any, so that one
    provider's files needn't be ordered by a single task.
    """
    f = files.select("file_id", *STREAM, "delivered_at").dropDuplicates(["file_id"]).withColumn("day", F.to_date("delivered_at"))
    day = [*STREAM, "day"]
    within = f.withColumn("prev_id", F.lag("file_id").over(Window.partitionBy(*day).orderBy("delivered_at", "file_id")))
    last = f.groupBy(*day).agg(F.max_by("file_id", F.struct("delivered_at", "file_id")).alias("last_id"))
    before = last.withColumn("before_id", F.lag("last_id").over(Window.partitionBy(*STREAM).orderBy("day"))).drop("last_id")
    same = [within[c].eqNullSafe(before[c]) for c in day]
    return within.join(before, same[0] & same[1] & same[2]).select("file_id", *(within[c] for c in STREAM), "delivered_at", F.coalesce("prev_id", "before_id").alias("prev_id"))


def _bits(kind: Column) -> Column:
    bit = F.lit(0)
    for n, k in enumerate(KINDS):
        bit = F.when(kind == k, F.lit(1 << n)).otherwise(bit)
    return bit


def _named(bits: Column) -> Column:
    """The sorted kinds of a set given as bits."""
    return F.array_compact(F.array(*(F.when(bits.bitwiseAND(F.lit(1 << n)) != 0, F.lit(k)) for n, k in enumerate(KINDS))))


def file_schemas(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file_id, field, kinds): the sorted JSON kinds of each field of each file, and (file_id) of the files with odd payloads. Both are durable."""
    found = durable(_parsed(records).groupBy("file_id", "field").agg(F.bit_or(_bits(_kind(F.col("value")))).alias("bits"), F.bool_or("is_odd").alias("is_odd")))
    odd_files = durable(found.filter("is_odd and field is null").select("file_id"))
    whole = found.filter("field is not null").select("file_id", "field", "bits")
    if not odd_files.isEmpty():
        more = _cut_out(records.join(odd_files, "file_id", "left_semi")).groupBy("file_id", "field").agg(F.bit_or(_bits(F.col("kind"))).alias("bits"))
        whole = durable(whole.unionByName(more).groupBy("file_id", "field").agg(F.bit_or("bits").alias("bits")))
    return whole.select("file_id", "field", _named(F.col("bits")).alias("kinds")), odd_files


def _last_of_key(long: DataFrame) -> DataFrame:
    return long.groupBy("file_id", "rec_key", "field").agg(F.max_by("text", "record_id").alias("text"), F.max("record_id").alias("record_id"))


def _sides(files: DataFrame, schemas: DataFrame) -> DataFrame:
    """(file_id, prev_id, field, now, was): the kinds of each field in a file and in the one before it, null where it is absent."""
    pairs = with_previous(files).filter(F.col("prev_id").isNotNull()).select("file_id", "prev_id")
    now = pairs.join(schemas, "file_id").select("file_id", "prev_id", "field", F.col("kinds").alias("now"), F.lit(None).cast("array<string>").alias("was"))
    was = pairs.join(schemas.withColumnRenamed("file_id", "prev_id"), "prev_id").select("file_id", "prev_id", "field", F.lit(None).cast("array<string>").alias("now"), F.col("kinds").alias("was"))
    return now.unionByName(was).groupBy("file_id", "prev_id", "field").agg(F.first("now", ignorenulls=True).alias("now"), F.first("was", ignorenulls=True).alias("was"))


def _matched(key: tuple, pairs: Iterable[tuple]) -> Iterator[tuple]:
    """Pairs of a file, best first, to those whose fields are both free: what rounds of mutual-best pairs give in the end."""
    olds, news = set(), set()
    for _, old, new, *_ in pairs:
        if old not in olds and new not in news:
            olds.add(old)
            news.add(new)
            yield (*key, old, new)


def renames(records: DataFrame, sides: DataFrame, odd_files: DataFrame) -> DataFrame:
    """(file_id, old_field, new_field, was, now): gone fields that live on under a new name."""
    gone = sides.filter(F.col("now").isNull()).select("file_id", "prev_id", F.col("field").alias("old_field"), "was")
    new = sides.filter(F.col("was").isNull()).select("file_id", F.col("field").alias("new_field"), "now")
    # fields whose file has no counterpart of the other sort cannot be renamed; their values needn't be read
    gone_only = gone.join(new.select("file_id").distinct(), "file_id", "left_semi")
    new_only = new.join(gone.select("file_id").distinct(), "file_id", "left_semi")
    wanted = durable(gone_only.select(F.col("prev_id").alias("file_id"), F.col("old_field").alias("field")).unionByName(new_only.select("file_id", F.col("new_field").alias("field"))).distinct())
    touched = checked_broadcast(durable(wanted.select("file_id").distinct()), SENT_FIELDS)
    read = records.join(touched, "file_id", "left_semi")
    values = durable(fields(read, odd_files).filter("text is not null").join(checked_broadcast(wanted, SENT_FIELDS), ["file_id", "field"]).select("file_id", "rec_key", "field", "record_id", "text"))
    old_values = _last_of_key(values.join(gone_only, (values["file_id"] == gone_only["prev_id"]) & (values["field"] == gone_only["old_field"])).select(gone_only["file_id"], "rec_key", F.col("old_field").alias("field"), "record_id", "text"))
    new_values = _last_of_key(values.join(new_only, (values["file_id"] == new_only["file_id"]) & (values["field"] == new_only["new_field"])).select(values["file_id"], "rec_key", F.col("new_field").alias("field"), "record_id", "text"))
    both = old_values.select("file_id", "rec_key", F.col("field").alias("old_field"), F.col("text").alias("old_text")).join(new_values.select("file_id", "rec_key", F.col("field").alias("new_field"), F.col("text").alias("new_text")), ["file_id", "rec_key"])
    agree = both.groupBy("file_id", "old_field", "new_field").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("old_text") == F.col("new_text")).alias("same"))
    likely = agree.filter(F.col("same") * 10 >= F.col("n") * RENAME_TENTHS).withColumn("share", F.col("same") / F.col("n"))
    ranked = likely.select("file_id", "old_field", "new_field", (-F.col("share")).alias("worse"), (-F.col("n")).alias("fewer"))
    best = fold_groups(ranked, ["file_id"], ["worse", "fewer", "old_field", "new_field"], _matched, f"file_id {ranked.schema['file_id'].dataType.simpleString()}, old_field string, new_field string")
    return best.select("file_id", "old_field", "new_field").join(gone.select("file_id", "old_field", "was"), ["file_id", "old_field"]).join(new, ["file_id", "new_field"])


def changes(files: DataFrame, records: DataFrame) -> DataFrame:
    """(file_id, change_kind, old_field, new_field, old_kinds, new_kinds) of each file against the one before it."""
    return _changes(files, records, *file_schemas(records))


def _changes(files: DataFrame, records: DataFrame, schemas: DataFrame, odd_files: DataFrame) -> DataFrame:
    # both are small beside the records and read several times
    sides = durable(_sides(files, schemas))
    renamed = durable(renames(records, sides, odd_files))
    differs = (F.size("was") > 0) & (F.size("now") > 0) & (F.col("was") != F.col("now"))

    def log(df: DataFrame, kind: str, old: Column, new: Column) -> DataFrame:
        return df.select("file_id", F.lit(kind).alias("change_kind"), old.alias("old_field"), new.alias("new_field"), F.col("was").alias("old_kinds"), F.col("now").alias("new_kinds"))

    field, none = F.col("field"), F.lit("")
    old, new = F.col("old_field"), F.col("new_field")
    parted = sides.filter(F.col("now").isNull() | F.col("was").isNull())
    taken = renamed.select("file_id", F.explode(F.array(F.struct(old.alias("field"), F.lit(True).alias("is_old")), F.struct(new.alias("field"), F.lit(False).alias("is_old")))).alias("x")).select("file_id", "x.*")
    rest = parted.withColumn("is_old", F.col("now").isNull()).join(taken, ["file_id", "field", "is_old"], "left_anti")
    kept = sides.filter(F.col("now").isNotNull() & F.col("was").isNotNull() & differs)
    return (
        log(renamed, "renamed", old, new)
        .unionByName(log(rest.filter("is_old"), "removed", field, none))
        .unionByName(log(rest.filter(~F.col("is_old")), "added", none, field))
        .unionByName(log(kept, "type_changed", field, field))
        .unionByName(log(renamed.filter(differs), "type_changed", old, new))
    )


def canonical_names(files: DataFrame, log: DataFrame) -> DataFrame:
    """(feature_kind, field, name): names that renames connect are one column, called as the smallest of them.

    Each name takes the smallest name around it, then the name of that one, until nothing moves; so the rounds grow with
    the logarithm of the longest chain of renames, and names are never gathered.
    """
    pairs = log.filter(F.col("change_kind") == "renamed").join(files.select("file_id", "feature_kind"), "file_id").select("feature_kind", "old_field", "new_field").distinct()
    edges = durable(pairs.select("feature_kind", F.col("old_field").alias("field"), F.col("new_field").alias("other")).unionByName(pairs.select("feature_kind", F.col("new_field").alias("field"), F.col("old_field").alias("other"))).distinct())
    state = durable(edges.groupBy("feature_kind", "field").agg(F.least("field", F.min("other")).alias("name")))
    while True:
        around = edges.join(state.select("feature_kind", F.col("field").alias("other"), "name"), ["feature_kind", "other"]).groupBy("feature_kind", "field").agg(F.min("name").alias("near"))
        step = state.join(around, ["feature_kind", "field"]).select("feature_kind", "field", F.col("name").alias("was"), F.least("name", "near").alias("name"))
        jump = step.select("feature_kind", F.col("field").alias("name"), F.col("name").alias("further"))
        after = durable(step.join(jump, ["feature_kind", "name"]).select("feature_kind", "field", "was", F.col("further").alias("name")))
        state = after.drop("was")
        if after.filter("name <> was").isEmpty():
            return state


def promoted(kinds: Column) -> Column:
    """Least kind of the lattice that holds all of ``kinds``: null for none, the kind itself for one, string for several plain ones, variant where an array or object meets another kind."""
    structured = F.arrays_overlap(kinds, F.array(F.lit("array"), F.lit("object")))
    return F.when(F.size(kinds) == 0, "null").when(F.size(kinds) == 1, kinds[0]).when(structured, "variant").otherwise("string")


def union_schema(files: DataFrame, schemas: DataFrame, names: DataFrame) -> DataFrame:
    """(feature_kind, name, kind, n_files): the columns of the consistent table of each feature kind; ``schemas`` as ``file_schemas`` gives them."""
    by_file = schemas.join(files.select("file_id", "feature_kind"), "file_id").join(names, ["feature_kind", "field"], "left")
    own = by_file.select("feature_kind", F.coalesce("name", "field").alias("name"), "file_id", F.aggregate("kinds", F.lit(0), lambda a, k: a.bitwiseOR(_bits(k))).alias("bits"))
    return own.groupBy("feature_kind", "name").agg(promoted(_named(F.bit_or("bits"))).alias("kind"), F.countDistinct("file_id").alias("n_files"))


def unified(files: DataFrame, records: DataFrame) -> DataFrame:
    """All records as one long table cast to the union schema: (feature_kind, file_id, record_id, rec_key, name, kind, value_kind, text, number, truth).

    A value is cast to its column's promoted kind: ``number`` and ``truth`` hold those of kind number and boolean and are
    null for the others; strings, arrays and objects (as JSON) are in ``text``, which has the canonical text of numbers and
    booleans too, and ``value_kind`` is the value's own kind, by which a variant column is read. A record without a field
    has no row for it; one without any, or whose payload is no JSON object, has one row without name and value.
    """
    schemas, odd_files = file_schemas(records)
    names = canonical_names(files, _changes(files, records, schemas, odd_files))
    schema = union_schema(files, schemas, names)
    placed = fields(records, odd_files).withColumnRenamed("kind", "value_kind").join(files.select("file_id", "feature_kind"), "file_id").join(names, ["feature_kind", "field"], "left").withColumn("name", F.coalesce("name", "field")).drop("field")
    text = F.col("text")
    number, truth = (F.when(F.col("kind") == k, text.try_cast(t)) for k, t in (("number", "double"), ("boolean", "boolean")))
    valued = placed.join(schema.drop("n_files"), ["feature_kind", "name"]).select("feature_kind", "file_id", "record_id", "rec_key", "name", "kind", "value_kind", "text", number.alias("number"), truth.alias("truth"))
    without = records.filter(F.coalesce(F.size(F.json_object_keys("payload")), F.lit(-1)) <= 0).join(files.select("file_id", "feature_kind"), "file_id")
    return valued.unionByName(without.select("feature_kind", "file_id", "record_id", "rec_key"), allowMissingColumns=True)

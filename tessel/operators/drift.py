"""Schemas that drift between files (problem 6)."""

import hashlib
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.operators.nested import find_shape, record_objects

_FIELD = pa.struct([("path", pa.string()), ("types", pa.string()), ("sign", pa.string())])


def _kind(value: object) -> str | None:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string" if value.strip() else None
    if isinstance(value, list):
        return "array" if any(x is not None for x in value) else None
    return None


def fields_of(items: list) -> list[tuple[str, str, str]]:
    """(dotted path, sorted types joined by |, digest of the values and their places) of a record.

    Array positions are left out of the path and null elements do not count in places.
    """
    found: dict[str, list] = {}
    kinds: dict[str, set[str]] = {}
    stack = [("", (), x) for x in reversed([x for x in items if isinstance(x, dict)])]
    stack = [("", (i,), x) for i, (_, _, x) in enumerate(reversed(stack))]
    while stack:
        prefix, place, item = stack.pop()
        for key, value in item.items():
            path = f"{prefix}{key}"
            if isinstance(value, dict):
                stack.append((f"{path}.", (*place, 0), value))
            elif isinstance(value, list) and any(isinstance(x, dict) for x in value):
                kept = [x for x in value if x is not None]
                stack.extend((f"{path}.", (*place, i), x) for i, x in enumerate(kept) if isinstance(x, dict))
            elif kind := _kind(value):
                kinds.setdefault(path, set()).add(kind)
                if kind == "array":
                    value = [x for x in value if x is not None]
                found.setdefault(path, []).append((place, json.dumps(value, ensure_ascii=False, sort_keys=True)))
    return [(p, "|".join(sorted(kinds[p])), hashlib.md5(repr(sorted(v)).encode()).hexdigest()) for p, v in sorted(found.items())]


def changes_between(old: list[dict], new: list[dict]) -> list[tuple[str, str, str | None]]:
    """(field path, change, new path) from one version to the next.

    A path that goes and one that comes under the same parent with equal values in equal places are
    a rename; of several such paths the first of each in string order belong together.
    """
    a, b = ({f["path"]: f for f in fields} for fields in (old, new))
    out: list[tuple[str, str, str | None]] = [(p, "retyped", p) for p in sorted(a.keys() & b.keys()) if a[p]["types"] != b[p]["types"]]
    came: dict[tuple[str, str], list[str]] = {}
    for p in sorted(b.keys() - a.keys()):
        came.setdefault((p.rpartition(".")[0], b[p]["sign"]), []).append(p)
    for p in sorted(a.keys() - b.keys()):
        same = came.get((p.rpartition(".")[0], a[p]["sign"]))
        out.append((p, "renamed", same.pop(0)) if same else (p, "removed", None))
    out.extend((p, "added", p) for ps in came.values() for p in ps)
    return out


def file_schemas(files: DataFrame, root: str, *, file_id: str, series: str, version: str, payload: str) -> DataFrame:
    """One row per readable file with the fields its records hold and the types of each.

    The records are the objects of the payload's outermost array, called ``root`` (see nested.roots).

    Unreadable, null and empty payloads give no row; repeated deliveries of a file count once. A
    readable payload without records counts as a version without fields.
    """

    shape = find_shape(files, payload, root)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, fields = [], []
            for i, text in enumerate(batch.column(3).to_pylist()):
                if (items := record_objects(text, root, shape)) is not None:
                    keep.append(i)
                    fields.append([dict(zip(("path", "types", "sign"), f)) for f in fields_of(items)])
            kept = pa.RecordBatch.from_arrays([c.take(pa.array(keep, pa.int64())) for c in batch.columns[:3]], names=["file_id", "series", "version_no"])
            yield kept.append_column("fields", pa.array(fields, pa.list_(_FIELD)))

    source = files.select(F.col(file_id).cast("long").alias("file_id"), F.col(series).cast("string").alias("series"), F.col(version).cast("int").alias("version_no"), F.col(payload).alias("payload"))
    parsed = source.where(F.col("payload").isNotNull()).mapInArrow(run, "file_id long, series string, version_no int, fields array<struct<path:string,types:string,sign:string>>")
    return parsed.dropDuplicates(["series", "version_no", "file_id"])


def schema_changes(schemas: DataFrame) -> DataFrame:
    """(file_id, field_path, change_kind, new_path) of each version against the one before it in its series.

    change_kind is added, removed, renamed (field_path is the old path) or retyped. The first version
    of a series and files without series give no row.
    """
    w = Window.partitionBy("series").orderBy("version_no", "file_id")
    pairs = schemas.where(F.col("series").isNotNull()).withColumn("old", F.lag("fields").over(w)).where(F.col("old").isNotNull()).select("file_id", "old", "fields")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(f, *c) for f, old, new in zip(*(c.to_pylist() for c in batch.columns)) for c in changes_between(old, new)]
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], names=["file_id", "field_path", "change_kind", "new_path"])

    return pairs.mapInArrow(run, "file_id long, field_path string, change_kind string, new_path string")


def canonical_paths(changes: DataFrame, schemas: DataFrame) -> DataFrame:
    """(path, canonical_path): the names a field had through renames, mapped to the one most files use.

    Names are joined through renames, the most frequent first, unless they stand together in as many
    files as they were renamed in: then they are two fields that once changed places. The paths of a
    schema, not the rows, bound its size.
    """
    used = schemas.select(F.explode("fields.path").alias("path")).groupBy("path").agg(F.count("*").alias("n")).collect()
    links = changes.where(F.col("change_kind") == "renamed").groupBy("field_path", "new_path").agg(F.count("*").alias("n")).collect()
    renamed = sorted({p for r in links for p in (r["field_path"], r["new_path"])})
    own = schemas.select(F.array_sort(F.array_intersect("fields.path", F.array(*map(F.lit, renamed)).cast("array<string>"))).alias("p")).where(F.size("p") > 1).groupBy("p").agg(F.count("*").alias("n"))
    pairs = own.select("p", "n", F.explode("p").alias("a")).select("a", "n", F.explode("p").alias("b")).where("a <> b").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    both = {(r["a"], r["b"]): r["n"] for r in pairs}
    moved: dict[tuple[str, str], int] = {}
    for r in links:
        for k in ((r["field_path"], r["new_path"]), (r["new_path"], r["field_path"])):
            moved[k] = moved.get(k, 0) + r["n"]
    count = {r["path"]: r["n"] for r in used}
    group = {p: {p} for p in [*count, *renamed]}
    for r in sorted(links, key=lambda r: (-r["n"], r["field_path"], r["new_path"])):
        a, b = group[r["field_path"]], group[r["new_path"]]
        between = [(p, q) for p in a for q in b]
        if a is not b and sum(both.get(k, 0) for k in between) < sum(moved.get(k, 0) for k in between):
            for p in b:
                group[p] = a
            a |= b
    rows = [(p, min(g, key=lambda x: (-count.get(x, 0), x))) for p, g in sorted(group.items())]
    return schemas.sparkSession.createDataFrame(rows, "path string, canonical_path string")


def union_schema(schemas: DataFrame, canonical: DataFrame) -> DataFrame:
    """(field_path, types, n_files): the fused schema, each field with all types it was seen with."""
    each = schemas.select("file_id", F.explode("fields").alias("f")).select("file_id", F.col("f.path").alias("path"), F.explode(F.split("f.types", r"\|")).alias("type"))
    return (
        each.join(canonical, "path")
        .groupBy("canonical_path")
        .agg(F.array_join(F.array_sort(F.collect_set("type")), "|").alias("types"), F.countDistinct("file_id").alias("n_files"))
        .withColumnRenamed("canonical_path", "field_path")
    )


def unified(objects: DataFrame, names: dict[str, list[str]], types: dict[str, list[str]], levels: dict[str, str]) -> DataFrame:
    """Flattened objects of all levels as one table with one schema; an object fills its own level's columns.

    ``names`` gives for each canonical path its spellings, ``types`` the types it was seen with, and
    ``levels`` for each table path the start of its paths, such as rules and "rules."; the longest
    start that fits tells the level of a path. Renames never leave a level. A
    field of one type is one text column; a field of several also has one column per type, filled in
    the rows of that type, beside the canonical text. Dots in paths become underscores. Where an
    object has a field under two of its names, the value under the second is kept in ``other_names``.
    """
    cols = ["key", "table_path", "child_path", "parent_path"]
    second = []
    for path in sorted(names):
        level, start = max(((t, p) for t, p in levels.items() if path.startswith(p)), key=lambda x: len(x[1]))
        spelled = [n[len(start) :] for n in [path, *sorted(set(names[path]) - {path})]]
        if len(spelled) > 1:
            held = F.filter(F.array(*map(F.lit, spelled)), lambda n: F.map_contains_key("fields", n))
            second.append(F.when(F.col("table_path") == level, F.slice(held, 2, len(spelled))).otherwise(F.array().cast("array<string>")))
        value = F.when(F.col("table_path") == level, F.coalesce(*(F.col("fields")[n] for n in spelled)))
        text = F.when(value.startswith('"'), F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>")[0]).otherwise(value)
        name = path.replace(".", "_").replace("@", "")
        cols.append(text.alias(name))
        if len(types.get(path, [])) > 1:
            tag = {"string": value.startswith('"'), "array": value.startswith("["), "boolean": value.isin("true", "false"), "number": value.rlike("^-?[0-9]")}
            cast = {"string": text, "array": F.from_json(value, "array<string>"), "boolean": value == "true", "number": value.cast("double")}
            cols += [F.when(tag[t], cast[t]).alias(f"{name}__{t}") for t in sorted(types[path])]
    rest = F.concat(*second) if second else F.array().cast("array<string>")
    other = F.map_filter("fields", lambda k, _: F.array_contains("_second", k))
    kept = F.when(F.size("_second") > 0, F.array_sort(F.map_entries(other)))  # a map could not be compared
    return objects.withColumn("_second", rest).select(*cols, kept.alias("other_names"))

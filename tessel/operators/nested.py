"""Deeply nested records as related flat tables (problem 2).

A record is read as a stream of tokens into path-value-ordinal triples; paths are grouped by their
repeated ancestor, the innermost array of objects above them, and each group is one table. Which
arrays there are is found in the data: a path that is an array of objects in any record is repeated.
"""

import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRING = r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"'
# An optional key, then a scalar, an opening or a closing bracket, then an optional comma.
_TOKEN = re.compile(rf'[ \t\r\n]*+(?:({_STRING})[ \t\r\n]*+:[ \t\r\n]*+)?+(?:({_STRING}|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][-+]?[0-9]++)?+|true|false|null|NaN|-?Infinity)|([{{\[])|([}}\]]))(?:[ \t\r\n]*+(,))?+')


@dataclass
class Tree:
    """One record as flat lists: containers in the order they open, and scalars with their container.

    A name is a key in an object and a position in an array. A depth of any size is only a longer list.
    """

    text: str
    parent: list[int] = field(default_factory=list)
    name: list[str | int] = field(default_factory=list)
    many: list[bool] = field(default_factory=list)
    span: list[list[int]] = field(default_factory=list)
    holds: list[bool] = field(default_factory=list)  # of an array: whether an object or array is in it
    scalars: list[tuple[int, str | int, str]] = field(default_factory=list)
    gone: set[int] = field(default_factory=set)  # containers whose key comes again in their object


def parse(text: str) -> Tree | None:
    """A record as a Tree, or None when it is not readable JSON; nulls are left out but keep their position."""
    while text.lstrip(" \t\r\n").startswith('"'):  # text inside text, to any depth
        try:
            text = json.loads(text)
        except ValueError:
            return None
    tree = Tree(text)
    parent, name, many, span, holds, scalars = tree.parent, tree.name, tree.many, tree.span, tree.holds, tree.scalars
    step = _TOKEN.scanner(text).match
    at, inside, count = -1, False, 0  # container, whether it is an array, its elements so far
    counts: list[int] = []
    inner: dict[tuple[int, str], int] = {}
    state = 1  # 0 just opened, 1 a value must come, 2 the container must close
    while (m := step()) is not None:
        key, value, opened, closed, comma = m.groups()
        if closed is not None:
            if state == 1 or at < 0 or key is not None or (closed == "]") != inside:
                return None
            span[at][1] = m.end(4)
            at = parent[at]
            count = counts.pop()
            inside = at >= 0 and many[at]
        else:
            if state == 2 or (at >= 0 and inside == (key is not None)) or (at < 0 and key is not None):
                return None
            own: str | int
            if inside:
                own = count
                count += 1
            else:
                own = key if key is None else key[1:-1] if "\\" not in key else json.loads(key)
            if opened is None:
                if value != "null":
                    scalars.append((at, own, value))
                if inner and (at, own) in inner:
                    tree.gone.add(inner.pop((at, own)))
                if at < 0:
                    return None  # a lone scalar is no record
            else:
                if comma is not None:
                    return None
                if inside:
                    holds[at] = True
                elif at >= 0:
                    if (at, own) in inner:
                        tree.gone.add(inner[at, own])
                    inner[at, own] = len(parent)
                counts.append(count)
                parent.append(at)
                name.append(own if at >= 0 else "")
                at, inside, count, state = len(parent) - 1, opened == "[", 0, 0
                many.append(inside)
                span.append([m.start(3), 0])
                holds.append(False)
                continue
        if at < 0:
            return tree if comma is None and not text[m.end() :].strip(" \t\r\n") else None
        state = 2 if comma is None else 1
    return None


@dataclass(frozen=True)
class Shape:
    """What a set of records was found to hold: the paths below their items that are arrays of objects,
    and the keys their items have."""

    repeated: frozenset[str] = frozenset()
    fields: frozenset[str] = frozenset()


def _keys(tree: Tree) -> dict[int, set[str]]:
    """The keys with a value of each object."""
    keys: dict[int, set[str]] = {i: set() for i, m in enumerate(tree.many) if not m}
    for c, k, _ in tree.scalars:
        if not tree.many[c]:
            keys[c].add(k)
    for c, p in enumerate(tree.parent):
        if p >= 0 and not tree.many[p]:
            keys[p].add(tree.name[c])
    return keys


def roots(tree: Tree, root: str, shape: Shape | None) -> list[tuple[int, str]]:
    """(container, name) of a record's outermost arrays, or lone items, of objects; the root comes first.

    The root is the record if that is an array, else the container of that key below objects alone,
    else the record if most of its keys are those of items, else of the outermost arrays of objects
    the one whose objects share most keys with items, else an object inside that looks like an item.
    Other outermost arrays keep their own dotted name, so nothing is lost. Without a shape only the
    first two are taken.
    """
    if tree.many[0]:
        return [(0, root)]
    outer: list[tuple[int, str]] = []  # arrays below objects alone
    objects: list[tuple[int, str]] = []
    dotted = {0: ""}
    for c in range(1, len(tree.parent)):
        p = tree.parent[c]
        if p in dotted and c not in tree.gone:
            path = f"{dotted[p]}.{tree.name[c]}" if dotted[p] else str(tree.name[c])
            if tree.many[c]:
                outer.append((c, path))
            else:
                dotted[c] = path
                objects.append((c, path))
    named = [x for x in outer if tree.name[x[0]] == root] or [x for x in objects if tree.name[x[0]] == root and (shape is None or _looks(tree, x[0], shape))]
    first = named[:1]
    if not first and shape is not None:
        if _looks(tree, 0, shape):
            return [(0, root)]
        full = [x for x in outer if tree.holds[x[0]]]
        if full:
            keys = _keys(tree)
            shared = {c: sum(len(keys[i] & shape.fields) for i, p in enumerate(tree.parent) if p == c and i in keys) for c, _ in full}
            first = [max(full, key=lambda x: (shared[x[0]], -x[0]))]
        else:
            first = [x for x in objects if _looks(tree, x[0], shape)][:1]
    if not first:
        return []
    within: set[int] = set()  # what lies in the root is no table of its own
    for c in range(first[0][0], len(tree.parent)):
        if c == first[0][0] or tree.parent[c] in within:
            within.add(c)
    return [(first[0][0], root), *((c, p) for c, p in outer if tree.holds[c] and c not in within)]


def _looks(tree: Tree, c: int, shape: Shape) -> bool:
    keys = _keys(tree)[c]
    return len(keys & shape.fields) * 2 > len(keys)


def text_roots(text: str | None, root: str, shape: Shape | None) -> tuple[Tree, list[tuple[int, str]]] | None:
    """A record's tree and roots; where the only arrays are written as text inside it, those are read."""
    tree = parse(text) if text else None
    if tree is None:
        return None
    found = roots(tree, root, shape)
    if not found and not tree.many[0]:
        dotted = {c for c in range(len(tree.many)) if not tree.many[c]}
        for c, k, raw in tree.scalars:
            if c in dotted and raw[0] == '"' and raw[1:2] in ("[", "{") and (k == root or shape is not None):
                if (inner := text_roots(raw, root, shape)) and inner[1]:
                    return inner
    return tree, found


def _json(raw: str) -> str:
    return json.dumps(json.loads(raw), ensure_ascii=False) if "\\" in raw else raw


def items(tree: Tree, found: list[tuple[int, str]], repeated: Callable[[str], bool], with_fields: bool, wanted: frozenset[str] | None = None) -> list[tuple[str, str, str | None, int, dict[str, str] | None]]:
    """(table path, own path, parent path, ordinal, {path: JSON text}) of each object that stands in an array.

    This is the grouping of a record's triples by their repeated ancestor. An object that is no
    element of an array is an array of one where its path is ``repeated``, else its values belong to
    the object around it under dotted names. With ``wanted`` only values of these keys are kept.
    """
    out: list[tuple] = []
    start = dict(found)
    table: dict[int, str] = {}  # of a container inside a root: the table of its objects, or of its own item
    path: dict[int, str] = {}  # of an array its path, of an item its path with position
    item: dict[int, int | None] = {}  # place in out of the item a container belongs to
    under: dict[int, str] = {}  # dotted path from that item
    base = {n for _, n in found}

    def below(t: str, name: str) -> str:
        return name if t in base and t == found[0][1] else f"{t}.{name}"

    def add(c: int, t: str, p: str, ordinal: int, parent: int | None) -> None:
        item[c], table[c], path[c], under[c] = len(out), t, p, ""
        out.append((t, p, None if parent is None else out[parent][1], ordinal, {} if with_fields else None))

    for c in range(len(tree.parent)):
        if c in tree.gone:
            continue
        if c in start:
            if tree.many[c]:
                item[c], table[c], path[c], under[c] = None, start[c], start[c], ""
            else:
                add(c, start[c], f"{start[c]}[0]", 0, None)
            continue
        p = tree.parent[c]
        if p not in path:
            continue
        if tree.many[p]:
            here = f"{path[p]}[{tree.name[c]}]"
            if tree.many[c]:
                item[c], table[c], path[c], under[c] = item[p], f"{table[p]}[]", here, f"{under[p]}[{tree.name[c]}]"
            else:
                add(c, table[p], here, tree.name[c], item[p])
            continue
        name = f"{under[p]}{tree.name[c]}"
        here, t = f"{path[p]}.{tree.name[c]}", below(table[p], tree.name[c])
        if tree.many[c]:
            if tree.holds[c] or repeated(t):
                item[c], table[c], path[c], under[c] = item[p], t, here, name
            elif with_fields and (wanted is None or name in wanted):
                text = tree.text[tree.span[c][0] : tree.span[c][1]]
                out[item[p]][4][name] = json.dumps(json.loads(text), ensure_ascii=False)
        elif repeated(t):
            add(c, t, f"{here}[0]", 0, item[p])
        else:
            item[c], table[c], path[c], under[c] = item[p], t, here, f"{name}."
    if with_fields:
        for c, k, raw in tree.scalars:
            if (own := item.get(c)) is not None and (wanted is None or k in wanted):
                out[own][4][f"{under[c]}[{k}]" if tree.many[c] else f"{under[c]}{k}"] = _json(raw)
    return out


def _in_batches(names: list[str], kinds: list[pa.DataType], rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(list(zip(names, kinds)))
    emit = lambda held: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], schema=schema)
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= 5000:
            yield emit(held)
            held = []
    if held:
        yield emit(held)


def _source(df: DataFrame, key: Column | str, text: Column | str) -> DataFrame:
    column = lambda c, n: F.col(c).alias(n) if isinstance(c, str) else c.alias(n)
    source = df.select(column(key, "key"), column(text, "text"))
    return source.where(F.col("key").isNotNull() & F.col("text").isNotNull())


def find_shape(df: DataFrame, text: Column | str, root: str, most: int = 100_000) -> Shape:
    """The repeated paths and item keys of all records whose array needs no guess.

    One pass over the records; only distinct paths and keys leave a task, and at most ``most`` may
    come together, which a schema never has: more means that keys are data, and is an error.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, str]] = set()
        for batch in batches:
            for t in batch.column(1).to_pylist():
                read = text_roots(t, root, None)
                if read is None or not read[1]:
                    continue
                tree, found = read
                top = found[0][0]
                inside = {top: ""}
                for c in range(top + 1, len(tree.parent)):
                    p = tree.parent[c]
                    if p not in inside:
                        continue
                    if tree.many[p]:
                        inside[c] = inside[p] + ("[]" if tree.many[c] else "")
                    else:
                        inside[c] = f"{inside[p]}.{tree.name[c]}" if inside[p] else tree.name[c]
                        if (tree.parent[p] if tree.many[top] else p) == top:
                            seen.add(("key", tree.name[c]))
                    if not tree.many[c] and tree.many[p] and inside[p]:
                        seen.add(("array", inside[p]))
                seen.update(("key", k) for c, k, _ in tree.scalars if not tree.many[c] and (tree.parent[c] if tree.many[top] else c) == top)
        yield from _in_batches(["kind", "name"], [pa.string()] * 2, sorted(seen))

    rows = _source(df, F.lit(""), text).mapInArrow(run, "kind string, name string").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} paths: keys of these records are data")
    return Shape(frozenset(r["name"] for r in rows if r["kind"] == "array"), frozenset(r["name"] for r in rows if r["kind"] == "key"))


def path_triples(df: DataFrame, key: Column | str, text: Column | str) -> DataFrame:
    """(key, path, ordinals, value): every scalar of every record.

    ``path`` has [] for each array, ``ordinals`` the positions in them from the outermost, ``value``
    the JSON text, which tags its type. Nulls, and null, blank or unreadable records, give no row.
    """

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tree = parse(t)
                if tree is None:
                    continue
                where: list[tuple[str, tuple[int, ...]]] = []
                for c, p in enumerate(tree.parent):
                    where.append(("", ()) if p < 0 else _step(where[p], tree.many[p], tree.name[c]))
                dead = set(tree.gone)
                for c in range(len(tree.parent) if dead else 0):
                    if tree.parent[c] in dead:
                        dead.add(c)
                for c, name, raw in tree.scalars:
                    if c not in dead:
                        path, ordinals = _step(where[c], tree.many[c], name)
                        yield k, path, list(ordinals), _json(raw)

    run = lambda batches: _in_batches(["key", "path", "ordinals", "value"], [pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()], rows(batches))
    return _source(df, key, text).mapInArrow(run, "key string, path string, ordinals array<int>, value string")


def _step(at: tuple[str, tuple[int, ...]], many: bool, name: str | int) -> tuple[str, tuple[int, ...]]:
    path, ordinals = at
    return (f"{path}[]", (*ordinals, name)) if many else (f"{path}.{name}" if path else str(name), ordinals)


def flatten_json(df: DataFrame, key: Column | str, text: Column | str, root: str, with_fields: bool = True, shape: Shape | None = None, tables: Iterable[str] | None = None, fields: Iterable[str] | None = None) -> DataFrame:
    """One row per object found inside an array of a JSON text column.

    Returns (key, table_path, child_path, parent_path, ordinal[, fields]). The outermost array is
    called ``root``, whatever wrappers stand around it; ``table_path`` is ``root`` or the dotted path
    below its objects, ``parent_path`` null for the outermost. ``fields`` maps the dotted path of each
    other value of the object to its JSON text. ``shape`` is found in the records unless given. Each
    record's triples are grouped and pivoted in its own task, so this needs no shuffle.

    Null, empty or unreadable text and records without an array give no row. Null and non-object
    elements give no row but keep their position; a lone object is an array of one where its path is
    an array in some record; scalars beside objects are values of the object around them. Of a
    repeated key the last value counts. Rows with a null key give no row. Repeated rows are repeated.
    Where only some tables, or values of some keys, are asked for, the others never leave the task.
    """
    shape = shape or find_shape(df, text, root)
    only, wanted = (None if x is None else frozenset(x) for x in (tables, fields))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        repeated = shape.repeated.__contains__
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (read := text_roots(t, root, shape)) and read[1]:
                    for r in items(*read, repeated, with_fields, wanted):
                        if only is not None and r[0] not in only:
                            continue
                        yield (k, *r[:4], list(r[4].items())) if with_fields else (k, *r[:4])

    names, kinds = ["key", "table_path", "child_path", "parent_path", "ordinal"], [pa.string()] * 4 + [pa.int32()]
    if with_fields:
        names, kinds = [*names, "fields"], [*kinds, pa.map_(pa.string(), pa.string())]
    schema = "key string, table_path string, child_path string, parent_path string, ordinal int" + (", fields map<string,string>" if with_fields else "")
    return _source(df, key, text).mapInArrow(lambda batches: _in_batches(names, kinds, rows(batches)), schema)


def root_items(df: DataFrame, key: Column | str, text: Column | str, root: str, fields: Iterable[str], shape: Shape | None = None) -> DataFrame:
    """(key, items): each record's outermost objects as one array of (ordinal, fields), with the values of
    the keys asked for, for records whose objects are wanted together. Otherwise like flatten_json."""
    shape, wanted = shape or find_shape(df, text, root), frozenset(fields)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (read := text_roots(t, root, shape)) and read[1]:
                    own = [{"ordinal": r[3], "fields": list(r[4].items())} for r in items(*read, shape.repeated.__contains__, True, wanted) if r[0] == root]
                    if own:
                        yield k, own

    item = pa.struct([("ordinal", pa.int32()), ("fields", pa.map_(pa.string(), pa.string()))])
    return _source(df, key, text).mapInArrow(lambda batches: _in_batches(["key", "items"], [pa.string(), pa.list_(item)], rows(batches)), "key string, items array<struct<ordinal:int,fields:map<string,string>>>")


def load(tree: Tree, c: int) -> object:
    """A container as Python objects, however deep it is."""
    try:
        return json.loads(tree.text[tree.span[c][0] : tree.span[c][1]])
    except RecursionError:
        made: dict[int, object] = {}
        for i in range(c, len(tree.parent)):
            if i == c or tree.parent[i] in made:
                made[i] = {}
                if i != c and i not in tree.gone:
                    made[tree.parent[i]][tree.name[i]] = made[i]
        for i, k, raw in tree.scalars:
            if i in made:
                made[i][k] = json.loads(raw)
        for i in sorted(made, reverse=True):  # positions of arrays; those left out were null
            if tree.many[i]:
                own = made[i]
                made[i] = [own.get(k) for k in range(max(own, default=-1) + 1)]
                if i != c:
                    made[tree.parent[i]][tree.name[i]] = made[i]
        return made[c]


def record_objects(text: str | None, root: str, shape: Shape) -> list[dict] | None:
    """The items of a record as Python objects; None when it is unreadable or has no array.

    A plain record, an array or an object that holds the only ``root``, is read in one go.
    """
    if text and text.count(f'"{root}"') <= 1:
        try:
            value = json.loads(text)
        except ValueError:
            return None
        except RecursionError:
            value = None
        value = value.get(root) if isinstance(value, dict) else value
        if isinstance(value, list):
            return [x for x in value if isinstance(x, dict)]
    read = text_roots(text, root, shape)
    if read is None or not read[1]:
        return None
    tree, c = read[0], read[1][0][0]
    value = load(tree, c)
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else [value]


def flatten_typed(df: DataFrame, key: Column, name: str, with_fields: bool = True) -> DataFrame:
    """Like flatten_json for a column that already is an array of structs; stays in the JVM.

    Arrays of structs inside the structs are followed by the schema. Null arrays and null elements
    give no row; elements keep their position.
    """

    def level(source: DataFrame, kind: T.StructType, table: str) -> list[DataFrame]:
        inner = [f.name for f in kind.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
        cols = ["key", F.lit(table).alias("table_path"), "child_path", "parent_path", "ordinal"]
        if with_fields:
            pairs = [x for f in kind.fields if f.name not in inner for x in (F.lit(f.name), F.to_json(F.array(F.col(f"_item.{f.name}"))))]
            values = F.map_filter(F.create_map(*pairs), lambda _, v: v != "[null]")
            cols.append(F.transform_values(values, lambda _, v: v.substr(F.lit(2), F.length(v) - 2)).alias("fields"))
        out = [source.select(*cols)]
        for f in inner:
            below = source.select("key", F.col("child_path").alias("parent_path"), F.posexplode(F.col(f"_item.{f}")).alias("ordinal", "_item"))
            below = below.where(F.col("_item").isNotNull()).withColumn("child_path", F.concat("parent_path", F.lit(f".{f}["), F.col("ordinal").cast("string"), F.lit("]")))
            out += level(below, kind[f].dataType.elementType, f)
        return out

    top = df.select(key.alias("key"), F.posexplode(name).alias("ordinal", "_item")).where(F.col("_item").isNotNull() & F.col("key").isNotNull())
    top = top.withColumn("child_path", F.concat(F.lit(f"{name}["), F.col("ordinal").cast("string"), F.lit("]"))).withColumn("parent_path", F.lit(None).cast("string"))
    parts = level(top, df.schema[name].dataType.elementType, name)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def json_text(value: Column) -> Column:
    """A JSON value as plain text: strings without their quotes, other values as written."""
    return F.when(value.startswith('"'), F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>")[0]).otherwise(value)


def flat_table(objects: DataFrame, table_path: str, columns: dict[str, str | list[str]]) -> DataFrame:
    """One table of the flattened objects: key, child_path, parent_path, ordinal and the named columns.

    ``columns`` maps each column to its dotted path, or to several of which the first found counts; a
    path an object lacks gives null.
    """
    value = lambda p: F.coalesce(*(F.col("fields")[x] for x in ([p] if isinstance(p, str) else p)))
    return objects.where(F.col("table_path") == table_path).select(
        "key", "child_path", "parent_path", "ordinal", *(json_text(value(p)).alias(c) for c, p in columns.items())
    )

import json
from datetime import datetime

from tessel.operators import drift, nested, references, units

N = "models"


def _orphans(spark, child, parent, **kw):
    c = spark.createDataFrame(child, "k string, ref string, at timestamp, extra int")
    p = spark.createDataFrame(parent, "ref string, at timestamp, gone boolean, k string")
    out = references.orphan_references(c, p, child_table="c", child_key="k", ref="ref", parent_key="ref", child_time="at", parent_time="at", deleted=p["gone"], **kw)
    return {(r["child_key"], r["reason"], r["period"]) for r in out.collect()}


def test_orphans_by_reason_with_loose_keys_nulls_and_repeats(spark):
    a, b = datetime(2025, 1, 5), datetime(2025, 2, 5)
    child = [("1", " X ", a, 1), ("1", "x", a, 1), ("2", "y", a, 1), ("3", "z", a, 1), ("4", None, a, 1), ("5", "  ", a, 1), ("6", "nope", None, 1), ("7", "z", None, 1)]
    parent = [("X", a, False, "k"), ("Y", a, None, "k"), ("y", a, True, "k"), ("Z", b, False, "k"), (None, a, True, "k")]
    assert _orphans(spark, child, parent) == {("2", "deleted", "2025-01"), ("3", "late", "2025-01"), ("6", "missing", None)}


def test_orphans_of_empty_tables(spark):
    assert _orphans(spark, [], []) == set()
    assert _orphans(spark, [("1", "x", None, 1)], []) == {("1", "missing", None)}


def _paths(spark, rows):
    df = spark.createDataFrame(rows, "key string, text string, ordinal int")
    return sorted((r["key"], r["child_path"], r["parent_path"]) for r in nested.flatten_json(df, "key", "text", N).collect())


def test_flatten_positions_wrappers_lone_objects_and_bad_text(spark):
    rows = [
        ("a", '[null, {"model": "m", "trail": [3, {"i": 1}]}]', 1),
        ("b", '{"n": 2, "votes": [{"model": "m"}]}', 1),
        ("c", '{"model": "m", "trail": {"i": 1}}', 1),
        ("d", json.dumps('[{"model": "m"}]'), 1),
        ("e", "{broken", 1),
        ("f", None, 1),
        (None, '[{"model": "m"}]', 1),
        ("g", "", 1),
        ("h", "null", 1),
    ]
    assert _paths(spark, rows) == [
        ("a", "models[1]", None),
        ("a", "models[1].trail[1]", "models[1]"),
        ("b", "models[0]", None),
        ("c", "models[0]", None),
        ("c", "models[0].trail[0]", "models[0]"),
        ("d", "models[0]", None),
    ]
    assert _paths(spark, []) == []


def test_flat_table_keeps_values_and_types(spark):
    df = spark.createDataFrame([("a", '[{"model": "m\\"x", "p": {"q": 1.5}, "list": [1, 2]}]')], "key string, text string")
    row = nested.flat_table(nested.flatten_json(df, "key", "text", N), "models", {"model": "model", "q": "p.q", "l": "list", "none": "zip"}).first()
    assert (row["model"], row["q"], row["l"], row["none"]) == ('m"x', "1.5", "[1, 2]", None)


def test_flatten_typed_agrees_with_json(spark):
    df = spark.createDataFrame([("k", [(1, [("a",), None]), None, (2, None)]), ("n", None)], "key string, c array<struct<x:int,sub:array<struct<y:string>>>>")
    got = sorted((r["child_path"], r["parent_path"], r["table_path"]) for r in nested.flatten_typed(df, df["key"], "c").collect())
    assert got == [("c[0]", None, "c"), ("c[0].sub[0]", "c[0]", "sub"), ("c[2]", None, "c")]


def _changes(old, new):
    f = lambda g: [dict(zip(("path", "types", "sign"), x)) for x in drift.fields_of(g)]
    return {c[:2] for c in drift.changes_between(f(old), f(new))}


def test_schema_changes_of_each_kind():
    old = [{"a": "x", "t": {"op": "<"}, "gone": 1, "n": "5"}]
    assert _changes(old, [{"a": ["x"], "t": {"cmp": "<"}, "n": 5, "new": "z"}]) == {("a", "retyped"), ("t.op", "renamed"), ("n", "retyped"), ("gone", "removed"), ("new", "added")}
    assert _changes(old, old) == set()


def test_rename_needs_the_same_places_and_ignores_null_elements():
    old = [{"rules": [{"c": "1"}, {"c": "2"}]}]
    assert _changes(old, [{"rules": [None, {"d": "1"}, {"d": "2"}]}]) == {("rules.c", "renamed")}
    assert _changes(old, [{"rules": [{"d": "2"}, {"d": "1"}]}]) == {("rules.c", "removed"), ("rules.d", "added")}
    assert _changes([{"e": "", "f": None, "g": []}], [{"e": "x"}]) == {("e", "added")}


def test_schema_changes_skip_unreadable_versions_and_repeats(spark):
    rows = [(1, "s", 1, '{"@graph": [{"a": 1}]}'), (2, "s", 2, "broken"), (3, "s", 3, '{"@graph": [{"a": 1, "b": 2}]}'), (3, "s", 3, '{"@graph": [{"a": 1, "b": 2}]}'), (4, "s", 4, None), (5, None, 1, '{"@graph": []}')]
    schemas = drift.file_schemas(spark.createDataFrame(rows, "id long, series string, v int, payload string"), "@graph", file_id="id", series="series", version="v", payload="payload")
    assert [tuple(r)[:3] for r in drift.schema_changes(schemas).collect()] == [(3, "b", "added")]
    assert drift.schema_changes(schemas.limit(0)).count() == 0


UNITS = [("glucose", "mmol/l", "mmol/l", 1.0, 0.0), ("glucose", "mg/dl", "mmol/l", 0.0555, 0.0), ("body temperature", "degc", "degc", 1.0, 0.0), ("body temperature", "degf", "degc", 5 / 9, -160 / 9), ("body weight", "kg", "kg", 1.0, 0.0), ("body weight", "g", "kg", 0.001, 0.0)]


def test_bounds_in_many_notations():
    t = units.UnitTable(UNITS)
    read = lambda *a: units.read_bound(t, *a)[:2]
    assert [str(x) for x in read("Glucose", "1,5", " mg / dL. ", None, None, None)] == ["1.5", "mg/dl"]
    assert [str(x) for x in read("body weight", "1 403 – 1 500 grams", None, None, None, None)] == ["1403", "g"]
    assert [str(x) for x in read("body weight", "≥ 90.5-134", "Kg.", None, None, None)] == ["90.5", "kg"]
    assert [str(x) for x in read("glucose", "see text", "mmol/l", 101.0, "mg%", None)] == ["101.0", "mg/dl"]
    assert [str(x) for x in read("body temperature", None, None, None, None, "page 3: Body  temperature at least 100,4 ℉, within 24 hours")] == ["100.4", "degf"]
    assert read("glucose", None, None, None, None, "first 12 hours only") == (None, None)
    for text in ("glucose measured in plasma at least 7 mg/dl", "glucose level (fasting) at least 7 mg/dl", "Glucose, if fasting, above 7mg\u00b7dl\u207b\u00b9; body weight over 80 kg", "glucose is read daily. Keep glucose  from 7 mg\u00b7dl\u207b\u00b9 in 4 of 10 checks", "glucose over 3 days, then glucose > 7 mg/dl"):
        assert [str(x) for x in read("glucose", None, None, None, None, text)] == ["7", "mg/dl"], text
    assert read("glucose", None, None, None, None, "glucose and body weight above 80 kg") == (None, None)
    assert read("glucose", None, None, None, None, "glucose. Insulin above 80 mg/dl") == (None, None)
    assert read(None, None, None, None, None, None) == (None, None)
    assert units.thousandths(units.to_common(units.Decimal("101"), 0.0555, 0.0)) == 5606


def test_missing_units_are_assigned_by_posterior(spark):
    rows = [(i, "body weight", str(60 + i % 30), "kg", None, None, None) for i in range(60)]
    rows += [(i, "body weight", str(60000 + i), "g", None, None, None) for i in range(60, 90)]
    rows += [(100, "body weight", "71", None, None, None, None), (101, "body weight", "71000", None, None, None, None), (102, "body weight", None, None, None, None, None), (103, "unknown", "5", None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, m string, lo string, u string, ab double, au string, t string")
    table = spark.createDataFrame(UNITS, "measure string, unit_code string, common_unit string, factor double, offset_value double")
    read = units.read_bounds(df, table, row_id="id", measure="m", lower_bound="lo", unit="u", alternative_lower_bound="ab", alternative_unit="au", condition_text="t")
    got = {r["row_id"]: r for r in units.assign_units(read, table).collect()}
    assert (got[100]["assigned_unit"], got[101]["assigned_unit"]) == ("kg", "g")
    assert not got[100]["uncertain"] and got[102]["uncertain"] and got[103]["assigned_unit"] is None
    assert got[60]["posterior"] == 1.0 and units.read_bounds(df.limit(0), table, row_id="id", measure="m", lower_bound="lo", unit="u", alternative_lower_bound="ab", alternative_unit="au", condition_text="t").count() == 0


def test_hidden_units_are_found_again(spark):
    rows = [(i, "body weight", str(60 + i % 30), "kg", None, None, None) for i in range(120)] + [(i, "body weight", str(60000 + 7 * i), "g", None, None, None) for i in range(120, 200)]
    df = spark.createDataFrame(rows, "id long, m string, lo string, u string, ab double, au string, t string")
    table = spark.createDataFrame(UNITS, "measure string, unit_code string, common_unit string, factor double, offset_value double")
    read = units.read_bounds(df, table, row_id="id", measure="m", lower_bound="lo", unit="u", alternative_lower_bound="ab", alternative_unit="au", condition_text="t")
    got = units.holdout_accuracy(read, table).collect()
    assert [(r["measure"], r["n"], r["accuracy"], r["n_uncertain"]) for r in got] == [("body weight", 200, 1.0, 0)]
    assert units.holdout_accuracy(read.limit(0), table).count() == 0

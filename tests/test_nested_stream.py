import json

from hypothesis import given, settings
from hypothesis import strategies as st

from tessel.operators import drift, nested

VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-9, 9) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=4),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.sampled_from(["a", "b", 'q"\\', "é"]), inner, max_size=3),
    max_leaves=12,
)


def _triples(value, path="", at=()):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _triples(v, f"{path}.{k}" if path else k, at)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _triples(v, f"{path}[]", (*at, i))
    elif value is not None:
        yield path, at, json.dumps(value, ensure_ascii=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(VALUES, max_size=3) | st.dictionaries(st.text(max_size=3), VALUES, max_size=3), st.booleans(), st.sampled_from([None, 0, 1]))
def test_a_stream_of_tokens_reads_what_a_parser_reads(value, ascii_only, indent):
    tree = nested.parse(json.dumps(value, ensure_ascii=ascii_only, indent=indent))
    where = []
    for c, p in enumerate(tree.parent):
        where.append(("", ()) if p < 0 else nested._step(where[p], tree.many[p], tree.name[c]))
    got = [(*nested._step(where[c], tree.many[c], k), json.dumps(json.loads(raw), ensure_ascii=False)) for c, k, raw in tree.scalars]
    assert sorted(got) == sorted(_triples(value))
    assert nested.load(tree, 0) == value


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='[]{}:,"a1\\ -.e', max_size=12))
def test_only_json_is_readable(text):
    try:
        value = json.loads(text)
        while isinstance(value, str):
            value = json.loads(value)
    except ValueError:
        value = None
    assert (nested.parse(text) is not None) == isinstance(value, (dict, list))


def _rows(spark, texts, root="models"):
    df = spark.createDataFrame(list(enumerate(texts)), "key int, text string").selectExpr("CAST(key AS STRING) AS key", "text")
    return sorted((int(r["key"]), r["table_path"], r["child_path"], r["parent_path"], r["fields"]) for r in nested.flatten_json(df, "key", "text", root).collect())


SURE = '[{"model": "m", "verdict": "v", "trail": [{"i": 1}]}]'


def test_any_number_of_wrappers_and_layers_of_text(spark):
    wrapped, layered = '{"model": "m"}', SURE
    for k in range(20):
        wrapped = f'{{"w{k}": {"[" + wrapped + "]" if k == 0 else wrapped}}}'
    for _ in range(6):
        layered = json.dumps(layered)
    got = _rows(spark, [SURE, wrapped, layered, json.dumps({"models": SURE})])
    assert [(k, p) for k, _, p, _, _ in got] == [(0, "models[0]"), (0, "models[0].trail[0]"), (1, "models[0]"), (2, "models[0]"), (2, "models[0].trail[0]"), (3, "models[0]"), (3, "models[0].trail[0]")]


def test_undeclared_arrays_become_tables_and_both_lists_of_a_wrapper_are_kept(spark):
    got = _rows(spark, [SURE, '[{"model": "m", "p": {"deep": [{"x": 1}, 2, null, {"x": 3}]}, "contacts": [{"tel": "1", "at": {"h": 2}}]}]', '{"log": [{"x": 1}], "votes": [{"model": "m", "verdict": "v"}]}'])
    assert [(k, t, p, parent) for k, t, p, parent, _ in got if k] == [
        (1, "contacts", "models[0].contacts[0]", "models[0]"),
        (1, "models", "models[0]", None),
        (1, "p.deep", "models[0].p.deep[0]", "models[0]"),
        (1, "p.deep", "models[0].p.deep[3]", "models[0]"),
        (2, "log", "log[0]", None),
        (2, "models", "models[0]", None),
    ]
    fields = {p: f for k, _, p, _, f in got if k == 1}
    assert fields["models[0]"] == {"model": '"m"', "p.deep[1]": "2"} and fields["models[0].contacts[0]"] == {"tel": '"1"', "at.h": "2"}


def test_deep_records_and_repeated_keys(spark):
    deep = '{"a":' * 3000 + '[{"model": "m"}]' + "}" * 3000
    got = _rows(spark, [SURE, f'[{{"model": "m", "n": {deep}}}]', '[{"model": "x", "trail": [{"i": 1}], "trail": [{"i": 2}], "model": "y"}]'])
    assert [len(p) for k, _, p, _, _ in got if k == 1] == [9, 9 + 2 + 6000 + 3]
    assert [(p, f) for k, _, p, _, f in got if k == 2] == [("models[0]", {"model": '"y"'}), ("models[0].trail[0]", {"i": "2"})]


def test_lone_objects_follow_the_data(spark):
    assert [p for _, _, p, _, _ in _rows(spark, [SURE, '{"model": "m", "verdict": "v", "trail": {"i": 1}}', '[{"model": "m", "other": {"i": 1}}]'])] == ["models[0]", "models[0].trail[0]", "models[0]", "models[0].trail[0]", "models[0]"]
    assert _rows(spark, []) == _rows(spark, ["", "[", "7", '"x"', None]) == []


def test_triples_of_a_table(spark):
    df = spark.createDataFrame([("k", '{"a": [{"b": 1}, null, {"b": "x", "c": [true]}]}'), ("l", None), (None, SURE)], "key string, text string")
    assert sorted(map(tuple, nested.path_triples(df, "key", "text").collect())) == [("k", "a[].b", [0], "1"), ("k", "a[].b", [2], '"x"'), ("k", "a[].c[]", [2, 0], "true")]


def test_names_that_changed_places_stay_two_fields(spark):
    payload = lambda **f: json.dumps({"@graph": [f]})
    files = [(1, "s", 1, payload(a=1)), (2, "s", 2, payload(b=1)), (3, "t", 1, payload(a=1, b=2)), (4, "u", 1, payload(old=7)), (5, "u", 2, payload(new=7))]
    schemas = drift.file_schemas(spark.createDataFrame(files, "id long, series string, v int, payload string"), "@graph", file_id="id", series="series", version="v", payload="payload")
    got = dict(map(tuple, drift.canonical_paths(drift.schema_changes(schemas), schemas).collect()))
    assert got["a"] == "a" and got["b"] == "b" and got["old"] == got["new"]

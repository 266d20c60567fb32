import random

import pytest
from pyspark.sql import functions as F

from tessel.operators import linking, maintain, metrics, spans, text, votes
from tessel.plans import catalog
from tessel.sources import readers
from tessel.streaming import events


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_every_sql_has_its_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_overlap_join_finds_each_pair_once_across_buckets(spark):
    rng = random.Random(1)
    make = lambda n, tag: [("n%d" % (i % 2), s, s + rng.randrange(0, 400), f"{tag}{i}") for i in range(n) for s in [rng.randrange(0, 900)]]
    a, b = make(25, "a"), make(25, "b")
    schema = "note string, start int, end int, id string"
    got = rows(spans.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "note", 64), "id", "b_id")
    assert got == sorted((x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] < x[2] and y[1] < y[2] and x[1] < y[2] and x[2] > y[1])


def test_islands_merge_touching_spans(spark):
    df = spark.createDataFrame([("n", 0, 5), ("n", 5, 7), ("n", 6, 6), ("n", 9, 12), ("n", 10, 11)], "note string, start int, end int")
    assert rows(spans.islands(df, ["note"]), "start", "end") == [(0, 7), (9, 12)]


def test_best_overlap_breaks_ties_by_id(spark):
    a = spark.createDataFrame([("n", 0, 10, "a")], "note string, start int, end int, a_id string")
    b = spark.createDataFrame([("n", 0, 10, "z"), ("n", 0, 10, "b"), ("n", 9, 30, "c")], "note string, start int, end int, b_id string")
    assert rows(spans.best_overlap(a, b, "note", "a_id", "b_id"), "a_id", "b_id", "ratio") == [("a", "b", 1.0)]


def test_fuzzy_link_equals_brute_force(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(5, 9))) for _ in range(60)]
    v = spark.createDataFrame([(i, w) for i, w in enumerate(words[:40])], "id long, name string")
    p = spark.createDataFrame([(w,) for w in words[40:]], "q string")
    got = rows(linking.fuzzy_link(p, v, "q", "name", "id", k=100), "text", "id", "distance")
    brute = p.distinct().crossJoin(v).withColumn("d", F.levenshtein("q", "name")).where("d <= 2")
    assert got == rows(brute, "q", "id", "d")


def test_upsert_and_insert_ignore(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "k int, v string, at int")
    assert rows(maintain.upsert(old, new, ["k"], [F.col("at")]), "k", "v") == [(1, "a"), (2, "d"), (3, "e")]
    assert rows(maintain.insert_ignore(old, new, ["k"], [F.col("at")]), "k", "v") == [(1, "a"), (2, "b"), (3, "e")]
    assert maintain.upsert(old.limit(0), new.limit(0), ["k"], [F.col("at")]).count() == 0


def test_update_from_keeps_nulls_of_the_source(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    s = spark.createDataFrame([(1, None)], "k int, v string")
    assert {(r["k"], r["v"]) for r in maintain.update_from(t, s, ["k"], ["v"]).collect()} == {(1, None), (2, "b")}


def test_perfect_and_tied_scores(spark):
    perfect = spark.createDataFrame([(0.9, True), (0.8, True), (0.1, False)], "c double, y boolean")
    assert metrics.auroc(perfect, "c", "y").first()["auroc"] == 1.0
    assert metrics.average_precision(perfect, "c", "y").first()["average_precision"] == 1.0
    tied = spark.createDataFrame([(0.5, True), (0.5, False)], "c double, y boolean")
    assert metrics.auroc(tied, "c", "y").first()["auroc"] == 0.5
    assert metrics.auroc(tied.where("y"), "c", "y").first()["auroc"] is None
    bins = metrics.equal_mass_bins(spark.createDataFrame([(i / 100, i % 2 == 0) for i in range(100)], "c double, y boolean"), "c", "y")
    assert [r["n"] for r in bins.orderBy("bin").collect()] == [10] * 10


def test_running_sums_match_python(spark):
    df = spark.createDataFrame([(i * 7 % 50, i) for i in range(50)], "k int, v int")
    total, want = 0, []
    for k, v in sorted((i * 7 % 50, i) for i in range(50)):
        total += v
        want.append((k, total))
    assert rows(metrics.running_sums(df, [F.col("k")], {"s": F.col("v")}), "k", "s") == want


def test_plurality_ties_go_to_the_first(spark):
    v = spark.createDataFrame([("i", "b", 1), ("i", "a", 2), ("j", "a", 1), ("j", "a", 2)], "item string, label string, pos int")
    assert rows(votes.plurality(v, "item", "label", "pos"), "item", "label", "n") == [("i", "b", 1), ("j", "a", 2)]


def test_sections_and_dictionary_offsets(spark):
    t = "Plan:\nacute pain, no acuteness.\nHospital Course: left leg"
    df = spark.createDataFrame([(1, t), (2, None), (3, "")], "id long, text string")
    assert [t[s:e].strip() for _, s, e in rows(text.sections(df, "id", "text"), "name", "start", "end")] == ["left leg", "acute pain, no acuteness."]
    assert [(w, t[s:e]) for w, s, e in rows(text.dictionary_spans(df, "id", "text", ["acute", "left", "leg"]), "term", "start", "end")] == [("acute", "acute"), ("left", "left"), ("leg", "leg")]
    assert text.dictionary_spans(df, "id", "text", []).count() == 0


def test_expansion_offsets_go_back(spark):
    df = spark.createDataFrame([(1, "bp ok, bp low")], "id long, text string")
    e = text.expand(df, "id", "text", {"bp": "blood pressure"})
    place = lambda x, end: text.to_original(F.col("edits"), F.lit(x), end)
    row = e.select("expanded", place(0, False).alias("a"), place(5, True).alias("b"), place(15, False).alias("c"), place(19, False).alias("d")).first()
    assert tuple(row) == ("blood pressure ok, blood pressure low", 0, 2, 3, 7)


def test_compound_split_prefers_fewer_parts(spark):
    p = spark.createDataFrame([("a b c",), ("x y",), ("a b",), (None,)], "t string")
    known = spark.createDataFrame([("a",), ("b",), ("c",), ("b c",)], "name string")
    assert rows(text.compound_splits(p, known, "t"), "text", "parts") == [("a b", ["a", "b"]), ("a b c", ["a", "b c"])]


def test_repetition_and_lenient_json(spark):
    df = spark.createDataFrame([("a b c d e f " * 20,), (None,), ("one two",)], "t string")
    assert [r["loops"] for r in df.select(text.repetition(F.col("t")).alias("r")).select("r.*").collect()] == [True, False, False]
    j = spark.createDataFrame([('```json\n{"a": 1}\n```',), ('so {"a": 1} ok',), ("no",), ('{"a": 1} {"b": 2}',), (None,)], "t string")
    assert [r[0] for r in j.select(text.lenient_json(F.col("t"))).collect()] == ['{"a":1}', '{"a":1}', None, '[{"a":1},{"b":2}]', None]


def test_split_file(tmp_path):
    p = tmp_path / "s.csv"
    p.write_text("# made by hand\nnote_id,split\na,train\nb,test\n")
    assert readers.read_split_file(str(p)) == {"a": "train", "b": "test"}
    p.write_text("note_id,split\na,other\n")
    with pytest.raises(ValueError):
        readers.read_split_file(str(p))


def test_stream_equals_its_batch_twin(spark, tmp_path):
    src = tmp_path / "in"
    data = spark.createDataFrame([(f"2024-01-01 00:{m:02d}:00", m % 3, 1.0) for m in range(0, 60, 4)] + [("2024-01-02 00:00:00", 0, 1.0)], "ts string, k long, v double").withColumn("ts", F.to_timestamp("ts"))
    data.coalesce(1).write.parquet(str(src))
    stream = events.window_counts(spark.readStream.schema(data.schema).parquet(str(src)), "ts", ["k"], "v", "20 minutes")
    q = stream.writeStream.format("memory").queryName("st_twin").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("st_twin"), "window_start", "k", "n") == rows(events.window_counts(data, "ts", ["k"], "v", "20 minutes"), "window_start", "k", "n")


def test_foreach_batch_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    write = events.upsert_to(path, ["k"], "at", parts=4)
    frame = lambda *r: spark.createDataFrame(r, "k int, v string, at int")
    assert events.read_upserted(spark, path, frame((1, "", 1)).schema).count() == 0
    write(frame((1, "a", 1), (1, "b", 2), *[(k, "x", 0) for k in range(10, 30)]), 0)
    write(frame((2, "c", 1), (1, "d", 3)), 1)
    write(frame((2, "c", 1), (1, "d", 3)), 1)
    write(frame((3, "e", 1)), 5)  # numbers may be skipped
    write(frame((4, "lost", 1)), 6)
    write(frame((4, "f", 1)), 6)  # a batch that is run again replaces its own result
    want = sorted([(1, "d"), (2, "c"), (3, "e"), (4, "f"), *[(k, "x") for k in range(10, 30)]])
    assert rows(events.read_upserted(spark, path), "k", "v") == want
    events.free_upserted(spark, path)
    assert rows(events.read_upserted(spark, path), "k", "v") == want

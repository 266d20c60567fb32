import math
import re

import pytest
from pyspark.sql import functions as F

from tessel.operators import context as cx
from tessel.functions import registered
from tessel.operators import linking, maintain, votes
from tessel.operators.text import containment
from tessel.sources import readers


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_local_context_by_hand():
    s = [(0, 100), (101, 150), (151, 400), (401, 2000)]
    assert cx.window_around(s, 2000, 110, 115, 300, 800) == (0, 400, 1, "sentence+neighbours")
    assert cx.window_around(s, 2000, 200, 205, 200, 800) == (151, 400, 2, "sentence")
    left, right, own, basis = cx.window_around(s, 2000, 500, 510, 300, 800)
    assert (own, basis, right - left) == (3, "sentence+trimmed", 800) and left <= 500 and right >= 510
    assert cx.window_around([], 50, 20, 25, 300, 800) == (0, 50, None, "characters")
    assert cx.window_around([(0, 5), (9, 12)], 20, 7, 8, 0, 800)[2] == 1


def test_local_contexts_equal_a_scan_of_all_sentences(spark):
    from tessel.operators.text import SENTENCE

    texts = {1: "One acute pain. " * 30 + "No. Yes acute. So it is.\n\nacute", 2: "nothing", 3: "acute " * 300 + ". acute", 4: None, 5: ""}
    got = rows(cx.local_contexts(spark.createDataFrame(list(texts.items()), "id long, t string"), "id", "t", ["acute"]))
    want = []
    for i, t in texts.items():
        sentences = [(m.start(), m.end()) for m in SENTENCE.finditer(t or "")]
        for m in re.finditer(r"\bacute\b", t or ""):
            want.append((i, "acute", m.start(), m.end(), *cx.window_around(sentences, len(t), m.start(), m.end(), 300, 800)))
    assert got == sorted(want, key=str) and len(got) == 333


def test_guards_headers_and_noise(spark):
    t = "Mg-1.8 and Mg 2, 96%  RA; RA\nCV: RRR CV\nCV"
    terms = [cx.Guarded("Mg", "Lab Test", after=r"-\d"), cx.Guarded("RA", "Condition", before=r"%[ \t]*"), cx.Guarded("CV", "Procedure", before=r"(?:^|\n)[ \t]*", after=r"[ \t]*:"), cx.Guarded("RRR", "Condition")]
    got = rows(cx.guarded_spans(spark.createDataFrame([(1, t), (2, None)], "id long, t string"), "id", "t", terms).select("term", "start"))
    assert got == [("CV", t.index("CV:")), ("Mg", 0), ("RA", t.index("RA")), ("RRR", t.index("RRR"))]
    df = spark.createDataFrame([("MD", "Doe, ", False), ("md", "the ", False), ("None", "", False), ("Plan", "", True), ("MD", ",\n", None)], "text string, before string, head boolean")
    assert [r[0] for r in df.select(cx.noise_reason(F.col("text"), F.col("before"), F.col("head"))).collect()] == ["credential", None, "placeholder", "header", "credential"]


def test_growth_takes_the_fewest_words_left_first(spark):
    names = spark.createDataFrame([("congestive heart failure", 1), ("heart failure acute", 2), ("very bad heart failure acute", 3), ("Failure  now", 4), ("heart failure", 9)], "name string, entry long")
    m = spark.createDataFrame([(1, "heart failure", "of Congestive ", " acute"), (2, "heart failure", None, " acute today"), (3, "failure", "", " now"), (4, "heart failure", "x", "y"), (5, "", "a", "b")], "id long, text string, left string, right string")
    assert rows(cx.grow_spans(m, names, ["id"])) == [(1, "congestive heart failure", "left", 1, 1), (2, "heart failure acute", "right", 1, 2), (3, "failure now", "right", 1, 4)]


def test_confidence_of_the_tokens_that_spell_the_verdict(spark):
    tokens = [("{", -5.0), ('"', -0.1), ("SUP", -0.2), ("PORTED", -0.4), ('"', -7.0), ("x", -1.0)]
    df = spark.createDataFrame([(tokens, "SUPPORTED"), (tokens, "NONE"), ([], "X"), (None, "X"), (tokens, None), ([("so SUPPORTED", -1.0)], "SUPPORTED"), ([(" NO", -1.0), ("NE", -2.0)], "NONE")], "t array<struct<token:string,logprob:double>>, v string")
    assert [r[0] for r in df.select(cx.spelled_confidence("t", "v")).collect()] == [round(math.exp(-0.7 / 3), 6), None, None, None, None, None, round(math.exp(-1.5), 6)]


def test_excerpts_and_citations(spark):
    source = "First point. The panel found that early treatment with the drug lowers risk in adults. Last point."
    quote = "We say the panel found that early treatment with the drug lowers risk indeed"
    assert cx.recovered_excerpt(quote, source) == "The panel found that early treatment with the drug lowers risk in adults."
    assert cx.recovered_excerpt("short", source) is None and cx.recovered_excerpt("", "") is None
    cited = spark.createDataFrame([("d", "r1", "early treatment"), ("d", "r2", "anything"), ("e", "r1", "no such words at all"), ("f", "zz", "x"), ("g", "r3", "x")], "d string, rule_id string, quote string")
    shown = spark.createDataFrame([("d", "r1", "verbatim", source), ("d", "r2", "paraphrase", None), ("e", "r1", "verbatim", source), ("g", "r3", "pointer_unverifiable", source)], "d string, rule_id string, citation_type string, source string")
    got = {r["d"]: (r["n"], r["verified"], r["reasons"]) for r in cx.verify_citations(cited, shown, "d", containment("quote", "source")).collect()}
    assert got == {"d": (2, True, ["paraphrase", "quote found"]), "e": (1, False, ["quote not found"]), "f": (1, False, ["not shown"]), "g": (1, False, ["not citable"])}


def test_reasoning_that_names_another_candidate(spark):
    s = spark.createDataFrame([("a", 1, 1, 0.3), ("a", 1, 2, 0.9), ("b", 1, 1, 0.9), ("b", 1, 2, 0.9), ("c", 1, 1, 0.1), ("d", 5, 1, 0.1), ("d", 5, 2, 0.1)], "id string, chosen int, candidate int, share double")
    assert rows(cx.verdict_mismatch(s, ["id"], "chosen")) == [("a", True, 2), ("b", False, None)]


def test_free_verdicts(spark):
    names = ["heart failure", "acute heart failure", "angina"]
    df = spark.createDataFrame([(x, names) for x in ("None of them", "Angina", "it is acute heart failure", "candidate 3", "candidate 7", "???", "nonesuch")], "s string, n array<string>")
    assert [r[0] for r in df.select(cx.read_verdict(F.col("s"), F.col("n"))).collect()] == [0, 3, 2, 3, None, None, None]


def test_semantic_tier_needs_floor_and_margin(spark):
    v = spark.createDataFrame([(1, "chronic heart failure"), (2, "acute angina"), (3, "acute anginas"), (4, None)], "concept_id long, text string")
    p = spark.createDataFrame([("chronic heart failures",), ("acute anginax",), ("zzz",), (None,)], "text string")
    assert rows(linking.semantic_link(p, v, "text", "concept_id", linking.hashed_trigrams)) == [("chronic heart failures", 1)]
    c = spark.createDataFrame([(1, "Drug", "x"), (2, "Condition", "y"), (3, "Drug", "y")], "concept_id long, domain_id string, text string")
    q = spark.createDataFrame([("x", "L", "Condition"), ("y", "L", "Condition"), ("z", "L", "Condition")], "text string, label string, expected string")
    assert rows(linking.domain_conflicts(q, c)) == [("x", "L", "Condition", 1, "Drug")]


def test_files(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{"a": 1}')
    (tmp_path / "j" / "b.json").write_text("{broken")
    good, bad = readers.read_json_records(spark, str(tmp_path / "j"), "a int")
    assert [r["a"] for r in good.collect()] == [1] and [r["file"] for r in bad.collect()] == ["b.json"]
    (tmp_path / "l.json").write_text('{"chunk_id": "c", "entities": [{"snomed_cui": "7", "character_boundaries": {"start": 1, "end": 3}}, null]}\nbroken\n')
    assert rows(readers.read_linked_entities(spark, str(tmp_path / "l.json")).select("chunk_id", "snomed_cui", "start", "end")) == [("c", "7", 1, 3)]
    (tmp_path / "s.csv").write_text("# made by hand\nnote_id,split,n_gold_annotations\na,train,3\nb,odd,1\n")
    with pytest.raises(Exception, match="unknown split: odd"):
        readers.read_split_table(spark, str(tmp_path / "s.csv")).collect()
    path = str(tmp_path / "status.json")
    assert maintain.write_status(path, "j", 3, 12, 60.0)["eta_s"] == 180 and maintain.read_status(path)["done"] == 3
    assert not maintain.clear_status(path, "other") and maintain.clear_status(path, "j") and maintain.read_status(path) is None
    assert maintain.write_status(path, "j", 0, 5, 1.0)["eta_s"] is None


def test_held_out_splits_are_refused(spark):
    splits = spark.createDataFrame([("a", "val"), ("b", "test"), ("c", "val")], "note_id string, split string")
    have = spark.createDataFrame([("a",), ("a",), (None,)], "note_id string")
    assert rows(votes.notes_of_split(splits, have)) == [("a", True), ("c", False)]
    assert rows(votes.notes_of_split(splits, have, "test", unlock=True)) == [("b", False)]
    for name, kind in (("test", PermissionError), ("all", PermissionError), ("odd", ValueError)):
        with pytest.raises(kind):
            votes.notes_of_split(splits, have, name)


def test_sections_in_sql(spark):
    registered.register(spark)
    spark.createDataFrame([(1, "Plan:\nrest\nHistory Of: x"), (2, None), (3, "none")], "id int, text string").createOrReplaceTempView("some_texts")
    assert rows(spark.sql("SELECT id, s.* FROM some_texts, LATERAL sections_of(text) s")) == [(1, "History Of", 11, 22, 24), (1, "Plan", 0, 5, 11)]


def test_tables_that_grow(spark, tmp_path):
    path = str(tmp_path / "t")
    assert maintain.ensure_table(spark, path, {"a": ("int", None)}).count() == 0
    maintain.append_rows(spark.createDataFrame([(1,)], "a int"), path)
    grown = {"a": ("int", None), "b": ("boolean", False)}
    assert rows(maintain.ensure_table(spark, path, grown)) == [(1, False)]
    maintain.append_rows(spark.createDataFrame([(2, True), (3, None)], "a int, b boolean"), path)
    assert rows(maintain.ensure_table(spark, path, grown)) == [(1, False), (2, True), (3, False)]

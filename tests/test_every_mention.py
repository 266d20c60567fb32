import re

import pytest

from tessel.operators.text import CUES
from tessel.plans import catalog

TEXTS = {
    1: "5 mg then mg = 4 and again mg.\nİİ no acute pain. acute, if acute then mg",
    2: "mg 7 é" + "x " * 80 + "Überweisung denies any acute event, 12 mg; acute",
    3: "mgso4 5mg subacute acutely",
    4: None,
}


@pytest.fixture(scope="module")
def got(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("mentions")
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").coalesce(1).write.parquet(f"{d}/documents.parquet")
    return lambda name: sorted(map(tuple, catalog.queries()[name](spark, str(d)).collect()), key=lambda r: r[:2])


def places(word):
    return [(i, t, m.start(), m.end()) for i, t in TEXTS.items() if t for m in re.finditer(rf"(?<![^\W_]){word}(?![^\W_])", t)]


def kind(t, s, e):
    after, before = t[e : e + 12], t[max(s - 12, 0) : s]
    if re.match(r"\s*[<>=\-]\s*-?\d", after):
        return "lab_value"
    return "unit_value" if re.match(r"\s*\d", after) or re.search(r"\d\s*$", before) else None


def state(t, s):
    own = re.split(r"[.;\n]", t[max(s - 40, 0) : s])[-1]
    return next((name for name, cue in CUES if re.search(rf"(?i)\b(?:{cue})\b", own)), "PRESENT")


def test_every_number_context(got):
    assert got("tx04_numeric_context") == [(i, s, kind(t, s, e)) for i, t, s, e in places("mg")]
    assert [r[2] for r in got("tx04_numeric_context")] == ["unit_value", "lab_value", None, None, "unit_value", "unit_value"]


def test_words_on_both_sides_of_every_mention(got):
    words = lambda t: [w.lower() for w in re.findall("[A-Za-z]+", t)]
    assert got("tx14_context_words") == [(i, s, " ".join(words(t[max(s - 60, 0) : s])[-3:]), " ".join(words(t[e : e + 60])[:3])) for i, t, s, e in places("mg")]


def test_every_assertion(got):
    assert got("tx21_assertion") == [(i, s, state(t, s)) for i, t, s, _ in places("acute")]
    assert [r[2] for r in got("tx21_assertion")] == ["ABSENT", "PRESENT", "HYPOTHETICAL", "ABSENT", "PRESENT"]

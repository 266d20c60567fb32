"""Text queries over every text and phrase, against brute force and against their SQL where it reaches."""

import re

import duckdb
import pytest

from tessel.plans import catalog
from tessel.plans.text_queries import _EXPAND, TERMS

TEXTS = {
    1: "Plan: take 5 mg daily\nand rest. left mg",
    2: "Befund: 5 mg täglich, acute Schmerzen – stable\nMG daily daily left",
    3: "Labs:\tserum 3\r\nOther Notes: acute left leg Ν and 7 mg = 4",
    4: "боль acute в груди, 12 mg\n\nleft/right Daily éacute acute",
    5: None,
    6: "",
    7: "Left mg MG: daily",
    8: "слово\r\nпродолжение\r\n\r\nещё\nžluč",
}
PHRASES = ["acute pain", "acute heart pain", "heart pain left leg", "douleur aiguë", "of serum iron in", "iron, serum", "aiguë  acute", None]
NAMES = ["acute pain left", "heart leg", "Douleur aiguë acute", "iron", "pain"]
HEAD = re.compile(r"^[ \t]*([A-Z][A-Za-z0-9 /\-'&.]{2,45}?):", re.M)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("whole")
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").coalesce(1).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(p, n) for p in PHRASES for n in (*NAMES, None)], "expanded_text string, omop_concept_name string").coalesce(1).write.parquet(f"{d}/normalized_entities.parquet")
    spark.createDataFrame(list(enumerate(NAMES)), "concept_id long, concept_name string").coalesce(1).write.parquet(f"{d}/concept.parquet")
    return str(d)


@pytest.fixture(scope="module")
def got(spark, folder):
    return lambda name: sorted(tuple(r) for r in catalog.queries()[name](spark, folder).collect())


@pytest.fixture(scope="module")
def sql(folder):
    con = duckdb.connect()
    for name in ("documents", "normalized_entities", "concept"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    return lambda name: sorted(con.execute(catalog.oracle_sql()[name]).fetchall())


def texts():
    return [(i, t) for i, t in TEXTS.items() if t is not None]


def words(t):
    return [m for m in re.finditer(r"[A-Za-z0-9/]+", t) if m[0].lower() in _EXPAND]


def spans(t):
    found = [(w, m.start(), m.end()) for w in TERMS for m in re.finditer(re.escape(w), t)]
    return [(w, s, e) for w, s, e in found if not (t[s - 1 : s].isalnum() and s) and not t[e : e + 1].isalnum()]


def test_sections_of_every_text(got):
    assert got("tx01_section_counts") == [(i, len(HEAD.findall(t))) for i, t in texts() if HEAD.search(t)]


def test_every_text_is_expanded(got):
    def full(t):
        for m in reversed(words(t)):
            t = t[: m.start()] + _EXPAND[m[0].lower()] + t[m.end() :]
        return t

    assert got("tx03_expand_abbreviations") == [(i, full(t)) for i, t in texts()]
    assert got("tx06_offsets_to_original") == sorted((i, m.start(), m.start()) for i, t in texts() for m in words(t))


def test_dictionary_of_every_text(got):
    assert got("tx11_dictionary_scan") == sorted((i, w, n) for i, t in texts() for w in TERMS for n in [sum(x == w for x, _, _ in spans(t))] if n)
    heads = lambda t: [(m.start(1), m.end()) for m in HEAD.finditer(t)]
    new = [(i, s, e, w) for i, t in texts() for w, s, e in spans(t) if not any(s < b and a < e for a, b in heads(t))]
    assert sorted((r[0], r[1], r[2], r[3]) for r in got("tx12_new_spans_only")) == sorted(new)


def test_soft_wraps_of_every_text(got):
    assert got("tx05_soft_wraps") == [(1, 1), (8, 2)]


def test_contexts_reach_texts_with_accents(got):
    assert {r[0] for r in got("tx04_numeric_context")} == {1, 2, 3, 4, 7}
    assert {r[0] for r in got("tx14_context_words")} == {1, 2, 3, 4, 7}
    assert {r[0] for r in got("tx21_assertion")} == {2, 3, 4}


def test_every_phrase_is_asked(got):
    assert ("iron, serum", "iron,") in got("tx16_trim_connectors") and ("douleur aiguë", "douleur aiguë") in got("tx16_trim_connectors")
    assert got("tx17_compound_split") == [(t, "|".join(t.split())) for t in sorted(["acute pain", "acute heart pain", "heart pain left leg", "douleur aiguë", "aiguë  acute"])]
    assert got("jn17_token_subset") == [("acute pain", 0), ("aiguë  acute", 2), ("douleur aiguë", 2)]
    pairs = {(a, b) for a in PHRASES for b in NAMES if a is not None}
    assert {(a, b) for a, b, _ in got("tx23_token_set_ratio")} == pairs
    assert sum(n for _, n in got("tx24_name_agreement")) == len(pairs)


@pytest.mark.parametrize("name", ["tx01_section_counts", "tx03_expand_abbreviations", "tx05_soft_wraps", "tx11_dictionary_scan", "tx16_trim_connectors", "tx17_compound_split", "tx23_token_set_ratio", "jn17_token_subset"])
def test_sql_agrees_on_the_rows_it_covers(got, sql, name):
    assert sql(name) and set(sql(name)) <= set(got(name))

import math
import random
from collections import Counter

import pytest

from tessel.llm import mapping as mp

SYLLABLES = "gas dux bin lum nos mek pag cir fol tib ner sob".split()
SITES, KINDS = ["spleen", "liver", "neck"], ["syndrome", "disease", "palsy", "status"]


@pytest.fixture(scope="module")
def listed():
    rng = random.Random(2)
    words = sorted({"".join(rng.sample(SYLLABLES, 3)) for _ in range(60)})
    return [(k, "C", f"{w} {KINDS[k % 4]}" + (f" of {SITES[k % 3]}" if k % 2 else ""), True) for k, w in enumerate(words)]


def _map(spark, values, names, **kw):
    df = spark.createDataFrame([(v, "C") for v in values], "value string, kind string")
    out = mp.map_values(df, spark.createDataFrame(names, "entry_id long, kind string, name string, usable boolean"), **kw)
    return {r["value"]: (r["entry_id"], r["status"]) for r in out.collect()}


def _slip(w, rng):
    i = rng.randrange(1, len(w) - 2)
    return rng.choice([w[:i] + w[i + 1 :], w[:i] + w[i] + w[i:], w[:i] + w[i + 1] + w[i] + w[i + 2 :]])


def test_slips_are_mapped_and_strangers_are_not(spark, listed):
    rng = random.Random(3)
    want = {}
    for k, _, name, _ in listed:
        word, rest = name.split(" ", 1)
        want[f"hx {_slip(word, rng)} {rest}, known"] = k
        want[f"{rest} {word.upper()} 20 mg"] = k
    for k, kind in enumerate(KINDS * 3):
        want[f"{'yowhee' * 2}{'aeiou'[k % 5]} {kind} of liver"] = None
        want[f"{kind} of liver{k // 4}"] = None
    got = _map(spark, want, listed)
    assert {v: e for v, (e, _) in got.items()} == want
    assert {v: e for v, (e, _) in _map(spark, want, listed, block=300).items()} == want


def test_threshold_and_margin_decide(spark, listed):
    word, rest = listed[0][2].split(" ", 1)
    slipped = f"{word[0]}{word[2]}{word[1]}{word[3:]} {rest}"
    assert _map(spark, [slipped], listed)[slipped] == (0, "matched")
    assert _map(spark, [slipped], listed, threshold=0.95)[slipped] == (None, "unmatched")
    two = [*listed, (900, "C", f"{word} {'palsy' if 'palsy' not in rest else 'status'}", True)]
    assert _map(spark, [word], two)[word] == (None, "ambiguous")
    assert _map(spark, [f"{word} {rest}"], two, margin=0.0)[f"{word} {rest}"] == (0, "matched")
    assert _map(spark, [f"{word} {rest}"], two, margin=0.9)[f"{word} {rest}"] == (None, "ambiguous")


def test_general_words_do_not_depend_on_the_size_of_the_list(spark, listed):
    df = lambda rows: spark.createDataFrame(rows, "entry_id long, kind string, name string, usable boolean")
    few = mp.general_words(df(listed))
    more = [(k + 1000 * i, c, " ".join([f"{n.split()[0]}{'abcdefgh'[i]}", *n.split()[1:]]), u) for i in range(8) for k, c, n, u in listed]
    assert few == mp.general_words(df([*listed, *more])) == frozenset([*KINDS, *SITES, "of"])
    assert mp.general_words(df([])) == frozenset()


def test_remarks_are_learned_from_the_values(spark, listed):
    names = spark.createDataFrame(listed, "entry_id long, kind string, name string, usable boolean")
    lexicon = mp.Lexicon(mp.general_words(names))
    values = [f"hx {n}" for _, _, n, _ in listed[:8]] + [f"{n} acut" for _, _, n, _ in listed[:8]] + ["gaslumdxx syndrome", "rare " + listed[0][2], None]
    got = mp.remark_words(spark.createDataFrame([(v,) for v in values], "value string"), names, lexicon)
    assert got == {"hx"}


def test_the_index_finds_what_a_dense_cosine_finds(listed):
    lexicon = mp.Lexicon([*KINDS, *SITES, "of"])
    forms = sorted((" ".join(mp.words_of(n, lexicon)), [(k, c, u)]) for k, c, n, u in listed)
    grams = [mp.grams_of(f, lexicon.general) for f, _ in forms]
    df = Counter(g for s in grams for g in s)
    weight = {g: math.sqrt(math.log(1 + len(forms) / n)) for g, n in df.items()}
    index = mp.Index(forms, lexicon, {g: w for g, w in weight.items() if df[g] > 1}, math.sqrt(math.log(1 + len(forms))))
    rng = random.Random(5)
    w = lambda g: weight.get(g, index.unseen) * (mp.GENERAL if g[0] == "~" else 1)
    for f, _ in forms:
        asked = " ".join(_slip(x, rng) if x not in lexicon.general else x for x in f.split())
        own = mp.grams_of(asked, lexicon.general)
        norm = lambda s: math.sqrt(sum(w(g) ** 2 for g in s))
        dense = [sum(w(g) ** 2 for g in own & s) / norm(own) / norm(s) for s in grams]
        assert {i for _, i in index.search(asked, 0.2, 0.1)} == {i for i, c in enumerate(dense) if c >= max(0.2, max(dense) - 0.1)}


def test_odd_values(spark, listed):
    got = _map(spark, [None, "", "  ", "x" * 100_000, "\U0001f600", "of of of"], listed)
    assert (got[None][1], got[""][1]) == ("blank", "blank") and all(e is None for e, _ in got.values())
    assert _map(spark, ["x"], []) == {"x": (None, "unmatched")} and _map(spark, [], listed) == {}

import random

import numpy as np
from pyspark.sql import functions as F

from tessel.llm import confusables, consensus, leakage, looks, mapping, packing, splits


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# 1: mapping

NAMES = [(1, "C", "acute nitlumbin syndrome", True), (2, "C", "chronic nitlumbin syndrome", True), (3, "D", "gasgasdux", True), (4, "M", "serum lumbusnos level", True), (5, "C", "wrongold disease", False), (3, "D", "ZXL", True), (4, "M", "zxl", True)] + [
    (10 * k + i, "M", f"{a} {c}dux{c}nosmek {b}", True) for k, (a, b) in enumerate([("serum", "level"), ("acute", "syndrome"), ("chronic", "disease")], 1) for i, c in enumerate("bfgklt")
]


def _map(spark, values):
    names = spark.createDataFrame(NAMES, "entry_id long, kind string, name string, usable boolean")
    out = mapping.map_values(spark.createDataFrame(values, "value string, kind string"), names)
    return {(r["value"], r["kind"]): (r["entry_id"], r["status"]) for r in out.collect()}


def test_values_are_mapped_reported_and_kept_apart(spark):
    got = _map(spark, [("Ac. nitlubmin-syndrome, known", "C"), ("syndrome, chronic nitlumbin", "C"), ("nitlumbin syndrome", "C"), ("gasgasdxu 40 mg", "D"), ("serum lum busnos level", "M"), ("urine lumbusnos level", "M"), ("Z.X.L.", "D"), ("zxl", "M"), ("zxl", "C"), ("wrongold disease", "C"), ("syndrome", "C"), (None, "C"), ("  ", None), ("gasgasdux", None), ("gasgasdux", None)])
    assert got[("Ac. nitlubmin-syndrome, known", "C")][0] == 1
    assert got[("syndrome, chronic nitlumbin", "C")][0] == 2
    assert got[("nitlumbin syndrome", "C")][0] is None
    assert got[("gasgasdxu 40 mg", "D")][0] == 3
    assert got[("serum lum busnos level", "M")][0] == 4
    assert got[("urine lumbusnos level", "M")][0] is None
    assert (got[("Z.X.L.", "D")][0], got[("zxl", "M")][0], got[("zxl", "C")]) == (3, 4, (None, "ambiguous"))
    assert got[("wrongold disease", "C")] == (None, "withdrawn")
    assert got[("syndrome", "C")][0] is None
    assert got[(None, "C")][1] == got[("  ", None)][1] == "blank"
    assert got[("gasgasdux", None)][0] == 3


def test_mapping_of_nothing(spark):
    assert _map(spark, []) == {}


# 4: consensus


def test_reweighted_votes_beat_the_majority_and_single_votes_stand(spark):
    rng = random.Random(3)
    votes, truth = [], {}
    for i in range(600):
        t = rng.choice("abc")
        truth[str(i)] = t
        for m, p in (("good", 0.95), ("fair", 0.85), ("bad1", 0.4), ("bad2", 0.4), ("bad3", 0.4)):
            votes.append((str(i), m, t if rng.random() < p else rng.choice([x for x in "abc" if x != t])))
    votes.append(("lone", "good", "a"))
    df = spark.createDataFrame(votes, "item_id string, annotator string, label string")
    c = consensus.weigh_votes(df)
    got = {r["item_id"]: r["label"] for r in c.items.collect()}
    right = sum(got[i] == t for i, t in truth.items()) / len(truth)
    majority = sum(max("abc", key=[v[2] for v in votes if v[0] == i].count) == t for i, t in list(truth.items())[:150]) / 150
    assert right > 0.9 > majority and got["lone"] == "a"
    acc = {r["annotator"]: r["accuracy"] for r in c.annotators.collect()}
    assert acc["good"] > acc["fair"] > acc["bad1"]
    assert c.settled and set(r["settled"] for r in c.annotators.collect()) == {True}
    assert not consensus.weigh_votes(df, max_rounds=1).settled
    assert consensus.weigh_votes(df.limit(0)).items.count() == 0


def _plain_consensus(votes, smoothing=2.0, start=0.7, tolerance=1e-3):
    """The named method, vote by vote: accuracy on all items against the others' weighted vote."""
    import math

    labels, names = sorted({x for _, _, x in votes}), sorted({a for _, a, _ in votes})
    k = max(2, len(labels))
    items = {}
    for i, a, x in votes:
        items.setdefault(i, []).append((a, x))
    weight, acc = dict.fromkeys(names, math.log(start * (k - 1) / (1 - start))), dict.fromkeys(names, start)
    order = labels
    top = lambda s: max(order, key=lambda x: (s[x], -order.index(x)))
    while True:
        score = {i: {x: sum(weight[a] for a, y in v if y == x) for x in labels} for i, v in items.items()}
        share = {x: 1.0 + sum(top(s) == x for s in score.values()) for x in labels}
        hits, n = dict.fromkeys(names, 0), dict.fromkeys(names, 0)
        for i, v in items.items():
            for a, x in v if len(v) > 1 else ():
                s = dict(score[i])
                s[x] -= weight[a]
                n[a] += 1
                hits[a] += top(s) == x
        new = {a: (hits[a] + smoothing) / (n[a] + 2 * smoothing) for a in names}
        moved = max(abs(new[a] - acc[a]) for a in names)
        acc, weight = new, {a: math.log(new[a] * (k - 1) / (1 - new[a])) for a in names}
        if moved < tolerance:
            return {i: top({x: sum(weight[a] for a, y in v if y == x) for x in labels}) for i, v in items.items()}, acc


def test_the_plain_weighting_equals_brute_force(spark):
    rng = random.Random(11)
    votes = []
    for i in range(300):
        t = rng.choice("abc")
        for m, p in (("m1", 0.93), ("m2", 0.81), ("m3", 0.66), ("m4", 0.43)):
            if rng.random() < 0.8:
                votes.append((str(i), m, t if rng.random() < p else rng.choice([x for x in "abc" if x != t])))
    c = consensus.weigh_votes(spark.createDataFrame(votes, "item_id string, annotator string, label string"), per_label=False, sure=0.0)
    want, acc = _plain_consensus(votes)
    assert {r["item_id"]: r["label"] for r in c.items.collect()} == want
    assert {r["annotator"]: round(r["accuracy"], 9) for r in c.annotators.collect()} == {a: round(x, 9) for a, x in acc.items()}


def test_votes_are_cleaned(spark):
    raw = [("i", "M-7B (q8)", "Supported-1", 1, True), ("i", "m-7b@r2", "NONE_CORRECT", 2, True), ("i", "n-3b:q4", "RERANK_TO_3", 3, True), ("i", "o", None, 4, True), ("i", "p", "None correct", 5, False), (None, "q", "x", 1, True)]
    df = spark.createDataFrame(raw, "item_id string, a string, l string, position int, usable boolean")
    got = consensus.clean_votes(df.select("item_id", consensus.annotator_name(F.col("a")).alias("annotator"), consensus.verdict_name(consensus.verdict_letters(F.col("l"))).alias("label"), "position", "usable"))
    assert rows(got, "annotator", "label") == [("m-7b", "SUPPORTED_1"), ("n-3b", "RE_RANK_TO_CANDIDATE_3")]


def test_alpha_of_known_cases(spark):
    df = spark.createDataFrame([("1", "a", "x"), ("1", "b", "x"), ("2", "a", "y"), ("2", "b", "y"), ("3", "a", "x")], "item_id string, annotator string, label string")
    assert consensus.chance_corrected(df).first()["alpha"] == 1.0
    assert consensus.chance_corrected(df.limit(0)).first()["alpha"] is None


# 5: splits


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(45)] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(40)] + [("hub", f"h{i}") for i in range(50)] + [("x", None)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = dict(rows(splits.components(spark.createDataFrame(edges, "a string, b string")), "node", "component"))
    assert got == {n: find(n) for n in list(root)}
    assert splits.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_torn_groups_follow_subjects_encounters_and_copies(spark):
    index = spark.createDataFrame([("1-A", "E1", None), ("0001-B", None, None), ("2-A", " e1 ", None), ("3-A", None, "2-a "), ("4-A", "", None), ("5-A", "", None)], "note_id string, encounter_ref string, copied_from string")
    mentions = spark.createDataFrame([("1-A", True), ("0001-B", None), ("3-A", False), ("4-A", True), ("5-A", False), ("6-A", True), ("6-A", False), (None, True)], "note_id string, is_test boolean")
    assert rows(splits.torn_groups(splits.group_notes(mentions, index)), "group_note_id", "note_id") == [("0001-B", "1-A"), ("0001-B", "3-A")]


def test_split_keeps_shares_and_groups(spark):
    rng = np.random.default_rng(1)
    data = [(f"g{i}", int(n), int(n // 2)) for i, n in enumerate(rng.integers(1, 40, 400))] + [("huge", 900, 0)]
    sizes = spark.createDataFrame(data, "component string, n_rows long, x long")
    got = splits.split_components(sizes, {"train": 0.8, "test": 0.2}, labels=["x"], block=150)
    again = splits.split_components(sizes, {"train": 0.8, "test": 0.2}, labels=["x"], block=150)
    assert rows(got, "component", "split") == rows(again, "component", "split")
    placed = dict(rows(got, "component", "split"))
    assert len(placed) == len(data)
    total = sum(n for _, n, _ in data)
    assert abs(sum(n for c, n, _ in data if placed[c] == "test") / total - 0.2) < 0.01
    assert splits.split_components(sizes.limit(0), {"train": 0.8, "test": 0.2}, labels=["x"]).count() == 0


# 8: packing


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(8)
    data = [(i, rng.choice([0, 7, 50, 90, rng.randrange(1, 250)])) for i in range(500)]
    out = packing.pack(spark.createDataFrame(data, "doc_id long, n_tokens int"), 100, step_containers=8, salts=4).collect()
    used, by_doc = {}, {}
    for r in out:
        by_doc[r["doc_id"]] = by_doc.get(r["doc_id"], 0) + r["n_tokens"]
        if r["container"] is not None:
            used.setdefault(r["container"], []).append((r["container_offset"], r["n_tokens"], r["position"]))
    assert by_doc == dict(data)
    for items in used.values():
        items.sort()
        assert [p for _, _, p in items] == list(range(len(items)))
        assert all(a[0] + a[1] == b[0] for a, b in zip(items, items[1:])) and items[-1][0] + items[-1][1] <= 100
    assert sum(n for _, n in data) / (100 * len(used)) > 0.97
    assert all(sum(r["doc_id"] == d for r in out) == max(1, -(-n // 100)) for d, n in data)
    groups = {}
    for r in out:
        if r["container"] is not None:
            groups[r["step_group"]] = groups.get(r["step_group"], 0) + r["n_tokens"]
    assert max(groups.values()) - min(groups.values()) <= 200
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens int"), 100).count() == 0


def test_token_counts_handle_null_blank_and_long(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "a b " * 20000), (None, "x")], "doc_id long, text string")
    got = dict(rows(packing.token_counts(df), "doc_id", "n_tokens"))
    assert (got[1], got[2], got[3]) == (2, 0, 0) and got[4] >= 40000 and len(got) == 4


# 9: leakage


def _leaks(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    return {(r["doc_id"], r["item_id"]): r["stretch"] for r in leakage.find_leaks(d, spark.createDataFrame(items, "item_id long, text string"), **kw).collect()}


def test_leaks_equal_brute_force_alignment(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=60))) for i in range(12)]
    docs, want = [(900, None), (901, ""), (902, "w1 w2")], set()
    for n in range(60):
        i, text = rng.choice(items)
        words = text.split()
        length = rng.choice([10, 14, 26, 40])
        at = rng.randrange(0, 60 - length)
        part = words[at : at + length]
        bad = rng.choice([0, 1, 2])
        for k in rng.sample(range(4, length - 4), bad):
            part[k] = "other"
        filler = [f"f{rng.randrange(999)}" for _ in range(30)]
        docs.append((n, " ".join([*filler[:15], *part, *filler[15:]])))
        if length >= 20:
            want.add((n, i))
    assert {k for k, s in _leaks(spark, docs, items).items() if s} == want
    assert set(_leaks(spark, docs, items, block=1000)) == set(_leaks(spark, docs, items))


def test_leaks_see_through_layout_codes_and_odd_characters(spark):
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twentyone"
    text = "> " + words.replace(" nine", ",\n[SNOMED: 12] NINE").replace("six", "ѕіх").replace("two", "t​wo").replace("four ", "ｆｏｕｒ ")
    assert _leaks(spark, [(1, text)], [(1, words), (1, words), (2, None), (3, "")]) == {(1, 1): 21}
    assert _leaks(spark, [(1, text)], []) == {} and _leaks(spark, [], [(1, words)]) == {}


def test_reordered_passages_are_found_by_coverage(spark):
    w = [f"w{i}" for i in range(40)]
    moved = w[30:] + ["x"] * 12 + w[10:20] + ["y"] * 12 + w[:10]
    d, i = spark.createDataFrame([(1, " ".join(moved))], "doc_id long, text string"), spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    row = leakage.find_leaks(d, i).first()
    assert row["covered"] == 0.75 and row["stretch"] == 0


def test_short_items_and_small_tiles_are_found_by_coverage(spark):
    rng = random.Random(1)
    items, docs = [], []
    for n in range(5, 20):  # word for word, too short for a stretch
        w = [f"s{n}x{i}" for i in range(n)]
        items.append((n, " ".join(w)))
        docs.append((n, " ".join(["f"] * 9 + w + ["g"] * 9)))
    w = [f"t{i}" for i in range(30)]
    five = [w[i : i + 5] for i in range(0, 25, 5)]
    rng.shuffle(five)
    five.sort(key=lambda t: t[0], reverse=True)
    items += [(100, " ".join(w)), (101, "a b c d")]
    docs += [(100, " h ".join(map(" ".join, five))), (101, "a b c d")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (round(r["covered"], 4), r["stretch"]) for r in leakage.find_leaks(d, i).collect()}
    assert got == {(n, n): (1.0, 0) for n in range(5, 20)} | {(100, 100): (0.8333, 0)}


def test_a_stretch_is_found_beside_a_longer_copy_and_among_repeats(spark):
    w = [f"w{i}" for i in range(40)]
    near = [*w[:9], "x", *w[10:20], "y", *w[20:29]]  # 28 of 29 words with two edits
    both = [*w[2:15], *["f"] * 40, *near]  # the longest equal run stands elsewhere
    often = (w[:6] + ["z"]) * 500 + near
    assert _leaks(spark, [(1, " ".join(near)), (2, " ".join(both)), (3, " ".join(often))], [(1, " ".join(w))]) == {(1, 1): 29, (2, 1): 29, (3, 1): 29}


# 10: look-alikes


def test_pairs_equal_brute_force(spark):
    base = ["The serum level of naïve cells is 10³ µl", "Приём по плану, без изменений", "a plain text", "a  plain text", "A plain text", "a plain téxt", "m2", "m²"]
    rng = random.Random(10)
    docs = [(i, t) for i, t in enumerate(base)]
    swap = {"a": "а", "e": "е", "o": "ο", "c": "с", "i": "і", "S": "Ѕ", "µ": "μ", " ": " ", "p": "ｐ"}
    for n in range(60):
        t = rng.choice(base)
        t = "".join(swap[c] if c in swap and rng.random() < 0.3 else c for c in t)
        docs.append((100 + n, t.replace("ï", "ï") + ("​" if rng.random() < 0.3 else "")))
    docs += [(500, None), (501, "​ \n"), (502, " "), (None, "a plain text"), (2, "a plain text")]
    key = lambda t: looks.look(looks.plain_widths(t))
    live = list({(d, t) for d, t in docs if d is not None and t is not None and key(t).strip()})
    want = {(min(a, b), max(a, b)) for a, x in live for b, y in live if a != b and x != y and key(x) == key(y)}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert set(rows(confusables.same_look_pairs(confusables.unify_texts(df, False)), "doc_id_a", "doc_id_b")) == want
    assert (2, 3) not in want and (2, 4) not in want and (2, 5) not in want and (6, 7) not in want


def test_mixed_words_are_repaired_only_to_words_of_the_corpus(spark):
    df = spark.createDataFrame([(1, "serum level"), (2, "sеrum zzаz level"), (3, "Пaциент"), (4, "Пациент")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in confusables.unify_texts(df).collect()}
    assert got == {1: "serum level", 2: "serum zzаz level", 3: "Пациент", 4: "Пациент"}
    many = spark.createDataFrame([(1, "The РОСТ growth"), (2, "The POCT growth"), (3, "ребёнка РОСТ"), (4, "ребёнка POCT"), (5, "rаrelу word"), (6, "rаrely word"), (7, "ca\u0301s word"), (8, "cа\u0301s word")], "doc_id long, text string")
    pairs = lambda **kw: set(rows(confusables.same_look_pairs(confusables.unify_texts(many, False, **kw)), "doc_id_a", "doc_id_b"))
    assert pairs() == {(1, 2), (3, 4), (5, 6), (7, 8)} and pairs(repair=False) == set()
    texts = {r["doc_id"]: r["text"] for r in confusables.unify_texts(many).collect()}
    assert (texts[1], texts[3]) == ("The POCT growth", "ребёнка РОСТ")
    assert confusables.unify_texts(df.limit(0)).count() == 0

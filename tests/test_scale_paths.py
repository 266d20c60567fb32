import random

import numpy as np
from pyspark.sql import functions as F

from tessel.operators import guideline, linking, metrics, spans


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_islands_of_a_note_with_half_of_the_rows(spark):
    rng = random.Random(4)
    data = [("hot" if rng.random() < 0.5 else f"n{rng.randrange(9)}", s := rng.randrange(0, 4000), s + rng.randrange(0, 12)) for _ in range(3000)] + [(None, 1, 5), (None, 4, 9), ("long", 0, 5000), ("long", 10, 20), ("long", 4999, 5001)]
    want = {}
    for k, s, e in sorted((k, s, e) for k, s, e in data if k is not None and s < e):
        own = want.setdefault(k, [])
        if own and s <= own[-1][1]:
            own[-1][1] = max(own[-1][1], e)
        else:
            own.append([s, e])
    got = rows(spans.islands(spark.createDataFrame(data, "note string, start int, end int"), ["note"]))
    assert [r for r in got if r[0] is not None] == sorted(((k, s, e) for k, v in want.items() for s, e in v), key=str)
    assert [r for r in got if r[0] is None] == [(None, 1, 9)]
    assert spans.islands(spark.createDataFrame([], "note string, start int, end int"), ["note"]).count() == 0


def test_ten_thousand_and_one_probes_in_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(10_001, 3))
    v[17] = v[400]
    df = spark.createDataFrame([(i, i % 4, [float(c) for c in x]) for i, x in enumerate(v)] + [(20_000, 1, [0.0] * 3), (20_001, 1, None)], "id long, g int, v array<double>").withColumn("p", F.col("id"))
    near = linking.nearest(df, df.where("id < 300 OR id >= 20000"), "p", "id", "v", 2, block=9_000)
    got = {}
    for r in near.collect():
        got.setdefault(r["p"], []).append((r["rn"], r["id"]))
    assert len(got) == 10_001
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = np.round(u @ u[:300].T, 6)
    for p in range(0, 10_001, 97):
        s = sims[p].copy()
        if p < 300:
            s[p] = -9
        assert [i for _, i in sorted(got[p])] == sorted(range(300), key=lambda i: (-s[i], i))[:2]
    own = {r["p"]: r["id"] for r in linking.nearest(df.where("id < 50"), df, "p", "id", "v", 1, among="g").collect()}
    assert all(i % 4 == p % 4 and i != p for p, i in own.items())
    bound = df.where("id < 20").withColumn("t", F.lit(0.5))
    n = {r["p"]: r["n"] for r in linking.count_more_similar(bound, df, "p", "id", "v", "t", block=30).collect()}
    assert n == {p: int((np.round(u @ u[p], 6) > 0.5).sum() - 1) for p in range(20)}
    assert linking.nearest(df.limit(0), df, "p", "id", "v", 2).count() == 0


def _edits(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def test_fuzzy_links_lose_no_pair(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choices("abc", k=n))
    names = sorted({word(rng.randrange(3, 14)) for _ in range(150)})
    asked = sorted({word(rng.randrange(5, 14)) for _ in range(60)})
    p, v = spark.createDataFrame([(a,) for a in asked] + [(None,), ("",)], "t string"), spark.createDataFrame([(i, n) for i, n in enumerate(names)] + [(999, None)], "id long, n string")
    got = {(r["text"], r["id"], r["distance"]) for r in linking.fuzzy_link(p, v, "t", "n", "id", k=10_000).collect()}
    assert got == {(a, i, d) for a in asked for i, n in enumerate(names) if (d := _edits(a, n)) <= 2}


def test_ranks_within_groups_and_ancestors_of_cycles(spark):
    df = spark.createDataFrame([("a", 3), ("b", 1), ("a", 1), (None, 5), ("b", 7), ("a", 2)], "g string, x int")
    assert rows(metrics.rank_within(df, "g", [F.col("x")]).select("g", "x", "rank")) == sorted([("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 1, 1), ("b", 7, 2), (None, 5, 1)], key=str)
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    assert rows(linking.ancestors(spark.createDataFrame([(1,)], "node long"), e, 9)) == [(1, 2, 1), (1, 3, 2), (1, 4, 3)]


def test_crosswalk_prefers_the_equal_then_the_domain_then_the_smallest(spark):
    c = spark.createDataFrame([(1, "Drug", "RxNorm", "r1"), (2, "Procedure", "SNOMED", "s2"), (3, "Drug", "SNOMED", "s3"), (4, "Observation", "SNOMED", "s4"), (5, "Drug", "RxNorm", "r5"), (6, "Drug", "RxNorm", "r6")], "concept_id long, domain_id string, vocabulary_id string, concept_code string")
    e = spark.createDataFrame([(1, 2, "Mapped from"), (1, 3, "Mapped from"), (1, 4, "eq"), (5, 2, "Mapped from"), (5, 3, "Mapped from")], "src long, dst long, rel string")
    assert rows(linking.crosswalk(c, e, "SNOMED", "eq").select("concept_id", "code")) == [(1, "s4"), (2, "s2"), (3, "s3"), (4, "s4"), (5, "s3"), (6, None)]


def test_channels_rank_and_relation(spark):
    probes = spark.createDataFrame([("p", "acute lung failure", "Condition", "Condition", "7", "lung failure"), ("q", "odd thing", None, None, None, None)], "probe string, name string, label string, domain string, code string, concept_name string")
    nodes = spark.createDataFrame([(1, "n1", "Condition", "lung failure", "7"), (1, "n2", "Medication", "oxygen", "9"), (1, "n3", "Finding", "heart murmur", "7"), (1, "n4", "Finding", "odd thing", None), (1, "n5", "Condition", "organ failure", "70")], "file_id long, id string, type string, name string, code string")
    rules = spark.createDataFrame([(1, "n1", "REQUIRES_MEDICATION", "n2", "verbatim"), (1, "n3", "INDICATES", "n2", "verbatim"), (1, "n4", "INDICATES", "n1", "pointer_unverifiable"), (1, "n5", "INDICATES", None, None)], "file_id long, source string, predicate string, target string, citation_type string")
    a = guideline.by_code(probes, nodes, rules)
    assert rows(a.select("node", "direction", "other", "confidence")) == [("n1", "incoming", "n4", 1.0), ("n1", "outgoing", "n2", 1.0)]  # the heart murmur has the code but another name
    up = spark.createDataFrame([("7", "70", 2, "organ failure")], "code string, ancestor string, hops int, ancestor_name string")
    b = guideline.by_hierarchy(probes, nodes, rules, up)
    assert rows(b.select("node", "hops", "confidence")) == [("n5", 2, 0.81)]
    d = guideline.by_name(probes, nodes, rules)
    assert rows(d.select("probe", "node", "confidence")) == [("q", "n4", 0.8)]
    pool = guideline.only_if_nothing(a.unionByName(b), d)
    assert {r["probe"] for r in pool.collect()} == {"p", "q"}
    kept = guideline.rank_and_cap(pool, 2)
    assert rows(kept.select("probe", "rank", "node", "other")) == [("p", 1, "n1", "n2"), ("p", 2, "n1", "n4")]  # q's only rule cannot be checked
    related = spark.createDataFrame([("p", "treated with", "9"), ("p", "causes", "9")], "probe string, relation string, other_code string")
    e = guideline.by_relation(a, related, nodes, {"treated with": ["REQUIRES_MEDICATION"], "causes": []})
    assert rows(e.select("node", "other", "channel")) == [("n1", "n2", "E")]

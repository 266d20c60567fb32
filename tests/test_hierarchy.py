from tessel.operators import linking


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_nearest_ancestor_is_standard_and_some_levels_up(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "d"), ("c", "e"), ("e", "a"), ("x", "y")], "src string, dst string")
    start = spark.createDataFrame([("a",), ("c",), ("x",)], "node string")
    standard = spark.createDataFrame([("d",), ("c",), ("e",), ("a",)], "node string")
    # b is no standard node, c wins over d as the smaller one, a is not its own ancestor, y is no standard node
    assert rows(linking.nearest_ancestor(start, edges, standard, 5)) == [("a", "c", 2), ("c", "e", 1)]


def test_collapse_keeps_one_of_each_connected_set(spark):
    pool = [
        ("p", 1, "alt", 0.8, False, 0),
        ("p", 2, "alt test", 0.9, False, 1),
        ("p", 3, "mandible and maxilla", 0.7, False, 2),
        ("p", 4, "maxilla", 0.6, False, 3),
        ("p", 5, "other", 0.5, False, 4),
        ("p", 6, "alias", 0.1, True, 5),
        ("p", 7, "tie", 0.4, False, 6),
        ("p", 8, "tie too", 0.4, False, 7),
        ("q", 1, "alt", 0.8, False, 0),
        ("q", 9, "bandage", None, False, 1),
    ]
    df = spark.createDataFrame(pool, "m string, id long, name string, s double, cur boolean, at int")
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 3), (5, 6), (8, 7), (9, 99), (99, 1)], "src long, dst long")
    got = rows(linking.collapse_hierarchy(df, edges, ["m"], "id", "name", "s", "cur", "at").select("m", "at", "id"))
    # 1, 2 and 4 hang together through the compound 3, which stays; 6 is curated; 7 comes before 8; 99 is in no pool
    assert got == [("p", 0, 2), ("p", 2, 3), ("p", 4, 6), ("p", 6, 7), ("q", 0, 1), ("q", 1, 9)]


def test_context_rules_need_a_strict_winner(spark):
    mentions = [(1, "BP", ["high", "high"], ["mmhg"]), (2, "bp", ["skin"], ["blister"]), (3, "bp", ["mmhg"], []), (4, "bp", ["high"], ["blister"]), (5, "hr", None, [])]
    m = spark.createDataFrame(mentions, "id long, abbreviation string, before array<string>, after array<string>")
    rules = [("bp", "blood pressure", "high", "pre", 1.0), ("bp", "blood pressure", "mmhg", "post", 2.0), ("bp", "bullous pemphigoid", "skin", "pre", 0.5), ("bp", "bullous pemphigoid", "blister", "post", 1.0)]
    r = spark.createDataFrame(rules, "abbreviation string, meaning string, trigger_word string, position string, score double")
    assert rows(linking.context_rule_winner(m, r, "id")) == [(1, "blood pressure", 3.0), (2, "bullous pemphigoid", 1.5)]

import json

import pytest

from tessel.plans import catalog


def _payload(snomed, op, excerpt, kind, groundings=lambda g: g):
    rule = {"predicate": "treats", "target": "t", excerpt: "as said", kind: "guideline", "evidence": [{"kind": "trial", "grade": "A"}]}
    node = {"@id": "n1", "@type": "Finding", "name": "x", snomed: "123", "quantitative_threshold": {op: ">", "lower_bound": 5}, "rules": [rule], "grounding_provenance": groundings({"source": "s", "tier": "1"})}
    return json.dumps({"@graph": [node]})


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("guidelines")
    files = [
        (1, "g", 1, _payload("snomed", "operator", "citation_verbatim_excerpt", "citation_type", lambda g: [g])),
        (2, "g", 2, _payload("snomedId", "op", "excerpt", "cite_kind")),
        (3, "h", 1, _payload("snomed", "operator", "citation_verbatim_excerpt", "citation_type")),
        (4, "h", 2, "{unreadable"),
    ]
    spark.createDataFrame(files, "file_id long, series string, version_no int, payload string").coalesce(1).write.parquet(f"{d}/guideline_files.parquet")
    return str(d)


def test_unified_holds_every_field_of_every_level(spark, folder):
    out = catalog.queries()["p6_unified"](spark, folder)
    rows = {(r["key"], r["table_path"]): r.asDict() for r in out.collect()}
    assert len(rows) == out.count() == 3 * 4
    own = {
        "@graph": {"id": "n1", "type": "Finding", "name": "x", "snomed": "123", "quantitative_threshold_operator": ">", "quantitative_threshold_lower_bound": "5"},
        "rules": {"rules_predicate": "treats", "rules_target": "t", "rules_citation_verbatim_excerpt": "as said", "rules_citation_type": "guideline"},
        "rules.evidence": {"rules_evidence_kind": "trial", "rules_evidence_grade": "A"},
        "grounding_provenance": {"grounding_provenance_source": "s", "grounding_provenance_tier": "1"},
    }
    none = dict.fromkeys(c for fields in own.values() for c in fields)
    for (_, level), row in rows.items():
        assert {c: v for c, v in row.items() if c not in ("key", "table_path", "child_path", "parent_path", "other_names")} == none | own[level]


def test_flat_tables_read_drifted_names(spark, folder):
    rules = catalog.queries()["p2_rules"](spark, folder).collect()
    assert [(r["citation_verbatim_excerpt"], r["citation_type"]) for r in rules] == [("as said", "guideline")] * 3
    nodes = catalog.queries()["p2_nodes"](spark, folder).collect()
    assert [(r["snomed"], r["threshold_operator"]) for r in nodes] == [("123", ">")] * 3

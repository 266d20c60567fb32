"""Queries of the general data-preparation problems (2, 3, 6 and 7)."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions.keys import loose
from tessel.operators import drift, nested, units
from tessel.operators.references import orphan_counts, orphan_references
from tessel.sources.tables import materialize, table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    mentions = table(spark, d, "extracted_entities")
    gone = F.coalesce("superseded_by_split", F.lit(False)) | F.coalesce("superseded_by_growth", F.lit(False))
    to_mention = dict(ref="entity_id", parent_key="entity_id", child_time="created_at", parent_time="created_at", deleted=gone)
    out = orphan_references(table(spark, d, "normalized_entities"), mentions, child_table="normalized_entities", child_key="entity_id", **to_mention)
    out = out.unionByName(
        orphan_references(table(spark, d, "mollm_decisions"), mentions, child_table="mollm_decisions", child_key="mollm_call_id", **to_mention)
    )
    queue = table(spark, d, "hitl_review_queue").withColumn("_source", F.regexp_extract(loose("source_table"), r"([^.]+)$", 1))
    for source in ("mollm_decisions", "mollm_tier_gate_decisions"):
        out = out.unionByName(
            orphan_references(
                queue.where(F.col("_source") == source),
                table(spark, d, source),
                child_table="hitl_review_queue",
                child_key="hitl_case_id",
                ref="source_call_id",
                parent_key="mollm_call_id",
                child_time="created_at",
                parent_time="created_at",
            )
        )
    return out


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("child_table", "child_key", "reason").distinct()


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_counts(_orphans(spark, d))


#: What the outermost array of a record is called.
ROOTS = {"guideline_files": "@graph", "mollm_decisions": "models"}


def _objects(spark: SparkSession, d: str, source: str, with_fields: bool = True) -> DataFrame:
    rows = table(spark, d, source)
    if source == "guideline_files":
        return nested.flatten_json(rows, F.col("file_id").cast("string"), "payload", ROOTS[source], with_fields)
    if source == "mollm_decisions":
        return nested.flatten_json(rows, "mollm_call_id", "models", ROOTS[source], with_fields)
    key = F.concat("entity_id", F.lit("|"), "expanded_text")
    return nested.flatten_typed(rows, key, "candidates", with_fields)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for source in ("guideline_files", "mollm_decisions", "normalized_entities"):
        part = _objects(spark, d, source, False).select(F.lit(source).alias("parent_table"), F.col("key").alias("parent_key"), "child_path")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def _flat(source: str, table_path: str, columns: dict[str, str]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: nested.flat_table(_objects(spark, d, source), table_path, columns).distinct()


#: For each table path of a guideline graph, the start of its fields' paths in the schemas.
LEVELS = {"@graph": "", "rules": "rules.", "rules.evidence": "rules.evidence.", "grounding_provenance": "grounding_provenance."}


def _names(canonical: DataFrame) -> dict[str, list[str]]:
    names: dict[str, list[str]] = {}
    for r in canonical.collect():
        names.setdefault(r["canonical_path"], []).append(r["path"])
    return names


def _flat_drifted(table_path: str, columns: dict[str, str]) -> Callable[[SparkSession, str], DataFrame]:
    """Like _flat for guideline graphs, reading each column under all names its field had through renames."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        schemas = materialize(_schemas(spark, d), "schemas")
        start = LEVELS[table_path]
        groups = [sorted(g) for g in _names(drift.canonical_paths(drift.schema_changes(schemas), schemas)).values()]
        spelled = {p: [x[len(start) :] for g in groups if f"{start}{p}" in g for x in g if x != f"{start}{p}"] for p in columns.values()}
        return nested.flat_table(_objects(spark, d, "guideline_files"), table_path, {c: [p, *spelled[p]] for c, p in columns.items()}).distinct()

    return run


p2_nodes = _flat_drifted("@graph", {"id": "@id", "type": "@type", "name": "name", "snomed": "snomed", "icd10": "icd10", "quality_flag": "quality_flag", "source_document": "provenance.source_document", "threshold_operator": "quantitative_threshold.operator", "threshold_lower_bound": "quantitative_threshold.lower_bound", "threshold_unit": "quantitative_threshold.unit"})
p2_rules = _flat_drifted("rules", {"predicate": "predicate", "target": "target", "rationale": "rationale", "citation": "citation", "citation_type": "citation_type", "citation_verbatim_excerpt": "citation_verbatim_excerpt"})
p2_evidence = _flat_drifted("rules.evidence", {"kind": "kind", "grade": "grade"})
p2_groundings = _flat_drifted("grounding_provenance", {"source": "source", "tier": "tier", "grounded_at": "grounded_at"})
p2_votes = _flat("mollm_decisions", "models", {"model": "model", "verdict": "verdict", "logprob_confidence": "logprob_confidence", "degenerate_generation": "degenerate_generation", "reasoning": "reasoning"})
p2_trail = _flat("mollm_decisions", "eval_trail", {"candidate_index": "candidate_index", "accepted": "accepted", "error": "error"})
p2_candidates = _flat("normalized_entities", "candidates", {"omop_concept_id": "omop_concept_id", "concept_name": "concept_name", "domain_id": "domain_id", "vocabulary_id": "vocabulary_id", "match_tier": "match_tier", "similarity_score": "similarity_score", "match_basis": "match_basis"})


def p2_triples(spark: SparkSession, d: str) -> DataFrame:
    """Every scalar of the JSON records by its path: how often it stands there and in how many records."""
    out = None
    for source, (key, text) in {"guideline_files": (F.col("file_id").cast("string"), "payload"), "mollm_decisions": (F.col("mollm_call_id"), "models")}.items():
        part = nested.path_triples(table(spark, d, source), key, text).groupBy("path").agg(F.count("*").alias("n_values"), F.countDistinct("key").alias("n_records"), F.max(F.size("ordinals")).alias("depth"))
        part = part.select(F.lit(source).alias("parent_table"), "path", "depth", "n_values", "n_records")
        out = part if out is None else out.unionByName(part)
    return out


def _bounds(spark: SparkSession, d: str) -> DataFrame:
    thresholds = table(spark, d, "quantitative_threshold").drop("operator", "upper_bound", "alternative_upper_bound", "source_document", "created_at").distinct()
    return units.read_bounds(thresholds, table(spark, d, "measure_units"), row_id="threshold_id", measure="measure", lower_bound="lower_bound", unit="unit", alternative_lower_bound="alternative_lower_bound", alternative_unit="alternative_unit", condition_text="condition_text")


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    return units.assign_units(materialize(_bounds(spark, d), "bounds"), table(spark, d, "measure_units"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Of all bounds with their assigned unit, those whose unit is recorded, which the mixture keeps, and not the common one."""
    rows = _assigned(spark, d).where(F.col("common_milli").isNotNull() & (F.col("assigned_unit") == F.col("unit_code")) & (F.col("unit_code") != F.col("common_unit")))
    return rows.select(F.col("row_id").alias("threshold_id"), F.col("common_milli").alias("lower_bound_milli")).distinct()


def p3_units(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d).withColumnRenamed("row_id", "threshold_id")


def p3_holdout(spark: SparkSession, d: str) -> DataFrame:
    return units.holdout_accuracy(materialize(_bounds(spark, d), "bounds"), table(spark, d, "measure_units"))


def _schemas(spark: SparkSession, d: str) -> DataFrame:
    return drift.file_schemas(table(spark, d, "guideline_files"), ROOTS["guideline_files"], file_id="file_id", series="series", version="version_no", payload="payload")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(_schemas(spark, d)).select("file_id", "field_path", "change_kind").distinct()


def p6_schema(spark: SparkSession, d: str) -> DataFrame:
    schemas = materialize(_schemas(spark, d), "schemas")
    return drift.union_schema(schemas, drift.canonical_paths(drift.schema_changes(schemas), schemas))


def p6_unified(spark: SparkSession, d: str) -> DataFrame:
    schemas = materialize(_schemas(spark, d), "schemas")
    canonical = drift.canonical_paths(drift.schema_changes(schemas), schemas)
    types = {r["field_path"]: r["types"].split("|") for r in drift.union_schema(schemas, canonical).collect()}
    return drift.unified(_objects(spark, d, "guideline_files"), _names(canonical), types, LEVELS).distinct()


_P7 = r"""
WITH k AS (
  SELECT 'normalized_entities' AS child_table, entity_id AS child_key, 'extracted_entities' AS parent, lower(trim(entity_id, E' \t\r\n\f\x0B ')) AS ref, created_at FROM normalized_entities
  UNION ALL
  SELECT 'mollm_decisions', mollm_call_id, 'extracted_entities', lower(trim(entity_id, E' \t\r\n\f\x0B ')), created_at FROM mollm_decisions
  UNION ALL
  SELECT 'hitl_review_queue', hitl_case_id, regexp_extract(lower(trim(source_table, E' \t\r\n\f\x0B ')), '([^.]+)$', 1), lower(trim(source_call_id, E' \t\r\n\f\x0B ')), created_at FROM hitl_review_queue
), child AS (
  SELECT child_table, child_key, parent, ref, min(created_at) AS first_at FROM k
  WHERE ref <> '' AND parent IN ('extracted_entities', 'mollm_decisions', 'mollm_tier_gate_decisions') GROUP BY ALL
), p AS (
  SELECT 'extracted_entities' AS parent, lower(trim(entity_id, E' \t\r\n\f\x0B ')) AS ref, created_at, coalesce(superseded_by_split, false) OR coalesce(superseded_by_growth, false) AS gone FROM extracted_entities
  UNION ALL SELECT 'mollm_decisions', lower(trim(mollm_call_id, E' \t\r\n\f\x0B ')), created_at, false FROM mollm_decisions
  UNION ALL SELECT 'mollm_tier_gate_decisions', lower(trim(mollm_call_id, E' \t\r\n\f\x0B ')), created_at, false FROM mollm_tier_gate_decisions
), pk AS (SELECT parent, ref, min(created_at) AS known, bool_or(gone) AS gone FROM p GROUP BY ALL),
hit AS (
  SELECT child_table, child_key, first_at,
    CASE WHEN pk.ref IS NULL THEN 'missing' WHEN gone THEN 'deleted' WHEN known > first_at THEN 'late' END AS reason
  FROM child LEFT JOIN pk USING (parent, ref)
)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p2_triples": p2_triples,
    "p2_nodes": p2_nodes,
    "p2_rules": p2_rules,
    "p2_evidence": p2_evidence,
    "p2_groundings": p2_groundings,
    "p2_votes": p2_votes,
    "p2_trail": p2_trail,
    "p2_candidates": p2_candidates,
    "p3_found": p3_found,
    "p3_units": p3_units,
    "p3_holdout": p3_holdout,
    "p6_found": p6_found,
    "p6_schema": p6_schema,
    "p6_unified": p6_unified,
    "p7_found": p7_found,
    "p7_report": p7_report,
}
ORACLES: dict[str, str] = {
    "p7_found": _P7 + "SELECT DISTINCT child_table, child_key, reason FROM hit WHERE reason IS NOT NULL",
    "p7_report": _P7
    + "SELECT child_table, coalesce(strftime(first_at, '%Y-%m'), 'unknown') AS period, reason, count(*) AS n_references FROM hit WHERE reason IS NOT NULL GROUP BY ALL",
}

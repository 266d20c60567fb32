"""Queries of the training-data problems (1, 4, 5, 8, 9 and 10)."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import confusables, consensus, leakage, mapping, packing, splits
from tessel.operators.nested import Shape, root_items
from tessel.sources.tables import materialize, table

# What the labels of mentions are called in the reference list.
DOMAINS = {"Condition": "Condition", "Medication": "Drug", "Lab Test": "Measurement", "Procedure": "Procedure", "Observation": "Observation"}


def _unmapped(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "normalized_entities").where(F.coalesce("omop_concept_id", F.lit(0)) == 0)
    typed = F.col("omop_concept_name").isNotNull() & (F.lower(F.trim("omop_concept_name")) != "unmapped") & (F.trim("omop_concept_name") != "")
    domain = F.create_map(*(F.lit(x) for kv in DOMAINS.items() for x in kv))[F.col("gliner_label")]
    return rows.select("entity_id", F.when(typed, F.col("omop_concept_name")).otherwise(F.col("original_text")).alias("value"), domain.alias("kind"))


def _mapped(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    concept = table(spark, d, "concept").select("concept_id", "domain_id", "concept_name", F.col("invalid_reason").isNull().alias("usable"))
    names = concept.select("concept_id", "domain_id", "concept_name", "usable").unionByName(
        table(spark, d, "concept_synonym").join(concept.drop("concept_name"), "concept_id").select("concept_id", "domain_id", F.col("concept_synonym_name").alias("concept_name"), "usable")
    )
    return mapping.map_values(rows, names.toDF("entry_id", "kind", "name", "usable"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _unmapped(spark, d)
    mapped = _mapped(spark, d, rows).select("value", "kind", "entry_id")
    out = rows.alias("r").join(mapped.alias("m"), F.col("r.value").eqNullSafe(F.col("m.value")) & F.col("r.kind").eqNullSafe(F.col("m.kind")), "left")
    return out.select("entity_id", F.coalesce("entry_id", F.lit(0)).cast("long").alias("concept_id")).distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d, _unmapped(spark, d))


#: What the vote records hold; given, so that they are read once only.
VOTES = Shape(frozenset({"eval_trail"}), frozenset({"model", "verdict", "logprob_confidence", "degenerate_generation", "clinical_meaning", "reasoning", "eval_trail"}))


def _votes(spark: SparkSession, d: str) -> DataFrame:
    text = lambda v: F.regexp_replace(v, '^"|"$', "")
    vote = lambda model, verdict, at, bad: F.struct(model.alias("model"), consensus.verdict_letters(verdict).alias("plain"), at.alias("position"), F.coalesce(bad, F.lit(False)).alias("bad"))
    a = root_items(table(spark, d, "mollm_decisions"), "mollm_call_id", "models", "models", ["model", "verdict", "degenerate_generation"], VOTES)
    a = a.select(F.col("key").alias("item_id"), F.transform("items", lambda x: vote(text(x["fields"]["model"]), text(x["fields"]["verdict"]), x["ordinal"], x["fields"]["degenerate_generation"] == "true")).alias("v"))
    b = table(spark, d, "mollm_tier_gate_decisions").select(F.col("mollm_call_id").alias("item_id"), F.transform("models", lambda m, i: vote(m["model"], m["verdict"], i, m["degenerate_generation"])).alias("v"))
    named = F.transform(F.filter("v", lambda x: ~x["bad"] & x["plain"].isNotNull()), lambda x: F.struct(consensus.annotator_name(x["model"]).alias("annotator"), x["position"].alias("position"), consensus.verdict_name(x["plain"]).alias("label")))
    ballots = a.unionByName(b).select("item_id", named.alias("votes")).select("item_id", F.filter("votes", lambda x: x["annotator"].isNotNull() & x["label"].isNotNull()).alias("votes"))
    return consensus.clean_ballots(ballots)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    items = consensus.weigh_votes(_votes(spark, d)).items.where("n_annotators >= 3")
    return items.select(F.col("item_id").alias("mollm_call_id"), F.col("label").alias("verdict"))


def p4_items(spark: SparkSession, d: str) -> DataFrame:
    return consensus.weigh_votes(_votes(spark, d)).items.withColumnRenamed("item_id", "mollm_call_id")


def p4_models(spark: SparkSession, d: str) -> DataFrame:
    return consensus.weigh_votes(_votes(spark, d)).annotators.withColumnRenamed("annotator", "model")


def p4_weightings(spark: SparkSession, d: str) -> DataFrame:
    """One row: decisions with three models or more, and on how many of them both weightings give one verdict."""
    votes = materialize(_votes(spark, d), "votes")
    own = consensus.weigh_votes(votes).items.where("n_annotators >= 3")
    plain = consensus.weigh_votes(votes, per_label=False, sure=0.0).items.select("item_id", F.col("label").alias("plain"))
    return own.join(plain, "item_id").agg(F.count("*").alias("n_items"), F.count_if(F.col("label") == F.col("plain")).alias("n_same"))


def p4_agreement(spark: SparkSession, d: str) -> DataFrame:
    return consensus.chance_corrected(consensus.each_vote(_votes(spark, d)))


SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
LABELS = tuple(DOMAINS)


def _notes(spark: SparkSession, d: str) -> DataFrame:
    return splits.group_notes(table(spark, d, "extracted_entities"), table(spark, d, "note_index"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.torn_groups(_notes(spark, d))


def _assigned_notes(spark: SparkSession, d: str) -> DataFrame:
    """Each note with its component, split and rows per label."""
    rows = table(spark, d, "extracted_entities").where("note_id IS NOT NULL")
    per_note = rows.groupBy("note_id").agg(F.count("*").alias("n_rows"), *(F.count_if(F.col("entity_label") == x).alias(x) for x in LABELS))
    notes = materialize(_notes(spark, d).select("note_id", "component").join(per_note, "note_id"), "notes")
    sizes = notes.groupBy("component").agg(F.sum("n_rows").alias("n_rows"), *(F.sum(x).alias(x) for x in LABELS))
    return notes.join(splits.split_components(sizes, SHARES, labels=list(LABELS)), "component")


def p5_split(spark: SparkSession, d: str) -> DataFrame:
    return _assigned_notes(spark, d).select("note_id", "component", "split", "n_rows")


def p5_deviation(spark: SparkSession, d: str) -> DataFrame:
    """How far each split is from its share of all rows and of the rows of each label."""
    per = _assigned_notes(spark, d).groupBy("split").agg(F.sum("n_rows").alias("all rows"), *(F.sum(x).alias(x) for x in LABELS))
    names = ["all rows", *LABELS]
    long = per.select("split", F.explode(F.array(*(F.struct(F.lit(n).alias("of"), F.col(f"`{n}`").alias("n")) for n in names))).alias("x")).select("split", "x.*")
    total = long.groupBy("of").agg(F.sum("n").alias("total"))
    wanted = F.create_map(*(F.lit(x) for kv in SHARES.items() for x in kv))[F.col("split")]
    share = F.col("n") / F.col("total")
    return long.join(total.where("total > 0"), "of").select("split", "of", "n", F.round(share, 6).alias("share"), wanted.alias("wanted"), F.round(share - wanted, 6).alias("deviation"))


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    rows = p5_split(spark, d)
    return rows.groupBy("split").agg(F.count("*").alias("n_notes"), F.countDistinct("component").alias("n_groups"), F.sum("n_rows").alias("n_rows"))


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    sizes = materialize(packing.token_counts(table(spark, d, "documents")), "tokens")
    out = None
    for r in sorted(table(spark, d, "pack_budgets").where("capacity_tokens > 0").distinct().collect(), key=lambda r: r["capacity_tokens"]):
        part = packing.pack(sizes, r["capacity_tokens"]).withColumn("budget_name", F.lit(r["budget_name"]))
        out = part if out is None else out.unionByName(part)
    return out


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    used = p8_pack(spark, d).where("container IS NOT NULL").groupBy("budget_name", "container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"))
    fill = used.groupBy("budget_name").agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"), F.sum("items").alias("n_items"), F.max("used").alias("fullest"))
    return fill.join(table(spark, d, "pack_budgets").distinct(), "budget_name").withColumn("fill", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).where("stretch > 0").select("doc_id", "item_id").distinct()


def p9_covered(spark: SparkSession, d: str) -> DataFrame:
    """Pairs by the share of the item under tiles, in whatever order these stand."""
    return _leaks(spark, d).where("covered >= 0.5").groupBy("doc_id", "item_id").agg(F.round(F.max("covered"), 6).alias("covered"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    leaks = _leaks(spark, d).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.max("covered").alias("most_covered"), F.max("stretch").alias("longest_stretch"))
    items = table(spark, d, "eval_items").select("item_id", "suite").distinct()
    return items.join(leaks, "item_id", "left").fillna({"n_documents": 0, "most_covered": 0.0, "longest_stretch": 0})


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_items").select("item_id", "text"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return confusables.same_look_pairs(confusables.unify_texts(table(spark, d, "documents"), with_text=False))


def p10_unified(spark: SparkSession, d: str) -> DataFrame:
    return confusables.unify_texts(table(spark, d, "documents")).select("doc_id", "text", "repaired")


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    return confusables.look_classes(confusables.unify_texts(table(spark, d, "documents"), with_text=False))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p4_found": p4_found,
    "p4_items": p4_items,
    "p4_models": p4_models,
    "p4_weightings": p4_weightings,
    "p4_agreement": p4_agreement,
    "p5_found": p5_found,
    "p5_split": p5_split,
    "p5_shares": p5_shares,
    "p5_deviation": p5_deviation,
    "p8_pack": p8_pack,
    "p8_report": p8_report,
    "p9_found": p9_found,
    "p9_covered": p9_covered,
    "p9_report": p9_report,
    "p10_found": p10_found,
    "p10_unified": p10_unified,
    "p10_classes": p10_classes,
}
_P5 = r"""
WITH RECURSIVE raw AS (
  SELECT lower(trim(note_id)) AS n, lower(trim(encounter_ref)) AS e, lower(trim(copied_from)) AS c FROM note_index
), idx AS (
  SELECT coalesce(CAST(TRY_CAST(nullif(regexp_extract(n, '^([0-9]+)', 1), '') AS HUGEINT) AS VARCHAR), 'note:' || n) AS s, nullif(e, '') AS e,
    CASE WHEN c <> '' THEN coalesce(CAST(TRY_CAST(nullif(regexp_extract(c, '^([0-9]+)', 1), '') AS HUGEINT) AS VARCHAR), 'note:' || c) END AS c FROM raw
), ties AS (
  SELECT DISTINCT a.s AS x, b.s AS y FROM idx a JOIN idx b ON a.e = b.e AND a.s <> b.s
  UNION SELECT s, c FROM idx WHERE c IS NOT NULL AND c <> s UNION SELECT c, s FROM idx WHERE c IS NOT NULL AND c <> s
), reach AS (
  SELECT x AS node, x AS seen FROM ties UNION SELECT reach.node, ties.y FROM reach JOIN ties ON reach.seen = ties.x
), comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node),
notes AS (
  SELECT note_id, bool_or(coalesce(is_test, false)) AS t, bool_or(NOT coalesce(is_test, false)) AS o,
    coalesce(CAST(TRY_CAST(nullif(regexp_extract(lower(trim(note_id)), '^([0-9]+)', 1), '') AS HUGEINT) AS VARCHAR), 'note:' || lower(trim(note_id))) AS s
  FROM extracted_entities WHERE trim(note_id) <> '' GROUP BY note_id
), grouped AS (SELECT notes.*, coalesce(component, s) AS g FROM notes LEFT JOIN comp ON s = node),
torn AS (SELECT g, min(note_id) AS group_note_id FROM grouped GROUP BY g HAVING count(*) >= 2 AND bool_or(t) AND bool_or(o))
SELECT group_note_id, note_id FROM grouped JOIN torn USING (g) WHERE note_id <> group_note_id
"""
ORACLES: dict[str, str] = {"p5_found": _P5}

"""Queries of measures, votes, JSON columns and features."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessel.operators import metrics as mx
from tessel.operators import votes as vt
from tessel.plans.registry import Loader, Registry
from tessel.sources.tables import materialize

query = Registry()
_CO = "co AS (SELECT note_id, confidence AS c, (assertion_status = 'PRESENT') AS y, entity_label FROM extracted_entities WHERE confidence IS NOT NULL AND assertion_status IS NOT NULL)"


def _co(t: Loader):
    return t.extracted_entities.where("confidence IS NOT NULL AND assertion_status IS NOT NULL").select("note_id", F.col("confidence").alias("c"), (F.col("assertion_status") == "PRESENT").alias("y"), "entity_label")


@query("ag02_accuracy_by_bucket", f"WITH {_CO} SELECT coalesce(entity_label, 'all') AS bucket, count(*) AS n, count_if(y) AS correct, round(avg(y::INT), 4) AS accuracy FROM co WHERE entity_label IS NOT NULL GROUP BY ROLLUP (entity_label)")
def _(t: Loader):
    rows = _co(t).where("entity_label IS NOT NULL").rollup("entity_label").agg(F.count("*").alias("n"), F.count_if("y").alias("correct"), F.round(F.avg(F.col("y").cast("int")), 4).alias("accuracy"))
    return rows.select(F.coalesce("entity_label", F.lit("all")).alias("bucket"), "n", "correct", "accuracy")


_BIN = "least(floor(c * 10)::BIGINT, 9)"


@query("ag03_calibration_error", f"WITH {_CO}, b AS (SELECT {_BIN} AS bin, count(*) AS n, abs(avg(c) - avg(y::INT)) AS gap FROM co GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * gap) / sum(n), 6) AS ece, round(max(gap), 6) AS mce FROM b")
def _(t: Loader):
    return mx.calibration_error(_co(t), "c", "y")


@query("ag03_reliability_bins", f"WITH {_CO}, b AS (SELECT {_BIN} AS bin, count(*) AS n, round(avg(c), 6) AS confidence, round(avg(y::INT), 6) AS accuracy FROM co GROUP BY 1) SELECT r.bin, coalesce(n, 0) AS n, confidence, accuracy FROM range(10) r(bin) LEFT JOIN b USING (bin)")
def _(t: Loader):
    return mx.reliability(_co(t), "c", "y")


@query("ag04_equal_mass_bins")
def _(t: Loader):
    return mx.equal_mass_bins(_co(t), "c", "y")


@query("ag05_brier", f"WITH {_CO} SELECT round(avg(pow(c - y::INT, 2)), 6) AS brier FROM co")
def _(t: Loader):
    return mx.brier(_co(t), "c", "y")


@query("ag06_auroc", f"WITH {_CO}, r AS (SELECT y, rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2 AS r FROM co) SELECT count_if(y) AS n_pos, count_if(NOT y) AS n_neg, round((sum(r) FILTER (y) - count_if(y) * (count_if(y) + 1) / 2) / (count_if(y) * count_if(NOT y)), 6) AS auroc FROM r")
def _(t: Loader):
    return mx.auroc(_co(t), "c", "y")


@query("ag07_average_precision", f"WITH {_CO}, g AS (SELECT c, count(*) AS n, count_if(y) AS p FROM co GROUP BY 1), r AS (SELECT p, sum(p) OVER (ORDER BY c DESC) AS h, sum(n) OVER (ORDER BY c DESC) AS s FROM g) SELECT round(sum(p * h / s) / sum(p), 6) AS average_precision FROM r")
def _(t: Loader):
    return mx.average_precision(_co(t), "c", "y")


@query("ag08_null_model", f"WITH {_CO}, p AS (SELECT count(*) AS n, avg(y::INT) AS p FROM co) SELECT n, round(p, 6) AS base_rate, round(greatest(p, 1 - p), 6) AS majority_accuracy, round(p * (1 - p), 6) AS brier FROM p")
def _(t: Loader):
    return mx.null_model(_co(t), "y")


@query("ag09_threshold_sweep", f"WITH {_CO} SELECT t AS threshold, count_if(c >= t) AS admitted, round(count_if(c >= t) / count(*), 6) AS coverage, round(avg(y::INT) FILTER (c >= t), 6) AS precision FROM co, (SELECT unnest([0.3, 0.5, 0.7, 0.8, 0.9]::DOUBLE[]) AS t) GROUP BY t")
def _(t: Loader):
    return mx.threshold_sweep(_co(t), "c", "y", [0.3, 0.5, 0.7, 0.8, 0.9])


_PO = "CASE " + " ".join(f"WHEN u < {p} THEN {i}" for i, p in enumerate(mx.POISSON)) + f" ELSE {len(mx.POISSON)} END"


@query("ag10_bootstrap_interval", f"""WITH {_CO}, s AS (SELECT note_id, count_if(y) AS h, count(*) AS n FROM co WHERE note_id IS NOT NULL GROUP BY 1), d AS (SELECT draw, h, n, ('0x' || substr(md5('13:' || draw || ':' || note_id), 1, 8))::BIGINT / 4294967296.0 AS u FROM s, range(2000) r(draw)),
r AS (SELECT draw, sum(({_PO}) * h) / sum(({_PO}) * n) AS r FROM d GROUP BY 1), l AS (SELECT list_sort(list(r)) AS r FROM r) SELECT (SELECT count(*) FROM s) AS n_clusters, (SELECT round(sum(h) / sum(n), 6) FROM s) AS rate, round(r[51], 6) AS low, round(r[1951], 6) AS high FROM l""")
def _(t: Loader):
    return mx.bootstrap_rate(_co(t), "note_id", F.col("y"))


@query("ag10_bootstrap_difference", f"""WITH {_CO}, s AS (SELECT note_id, sum(y::INT - (c >= 0.5)::INT) AS h, count(*) AS n FROM co WHERE note_id IS NOT NULL GROUP BY 1), d AS (SELECT draw, h, n, ('0x' || substr(md5('13:' || draw || ':' || note_id), 1, 8))::BIGINT / 4294967296.0 AS u FROM s, range(2000) r(draw)),
r AS (SELECT draw, sum(({_PO}) * h) / sum(({_PO}) * n) AS r FROM d GROUP BY 1), l AS (SELECT list_sort(list(r)) AS r FROM r) SELECT (SELECT count(*) FROM s) AS n_clusters, (SELECT round(sum(h) / sum(n), 6) FROM s) AS difference, round(r[51], 6) AS low, round(r[1951], 6) AS high FROM l""")
def _(t: Loader):
    return mx.bootstrap_difference(_co(t), "note_id", F.col("y"), F.col("c") >= 0.5)


_CAND = "c AS (SELECT DISTINCT entity_id, omop_concept_id AS gold, x.omop_concept_id AS id, x.similarity_score AS s FROM (SELECT entity_id, omop_concept_id, unnest(candidates) AS x FROM normalized_entities WHERE omop_concept_id IS NOT NULL) WHERE x.omop_concept_id IS NOT NULL AND x.similarity_score IS NOT NULL)"


def _graded(t: Loader):
    rows = t.normalized_entities.where("omop_concept_id IS NOT NULL").select("entity_id", F.col("omop_concept_id").alias("gold"), F.explode("candidates").alias("x"))
    return rows.select("entity_id", "gold", F.col("x.omop_concept_id").alias("id"), F.col("x.similarity_score").alias("s")).where("id IS NOT NULL AND s IS NOT NULL").distinct()


@query("ag13_top1_headroom", f"WITH {_CAND}, g AS (SELECT entity_id, gold, arg_max(id = gold, (s, -id)) AS top, bool_or(id = gold) AS a FROM c GROUP BY 1, 2) SELECT count(*) AS n, round(avg(top::INT), 6) AS top1, round(avg(a::INT), 6) AS oracle, round(avg(a::INT) - avg(top::INT), 6) AS headroom FROM g")
def _(t: Loader):
    return mx.headroom(_graded(t), ["entity_id", "gold"], "s", F.col("id") == F.col("gold"), "id")


@query("ag14_error_catching", "SELECT coalesce(matched, false) AS matched, count_if(ensemble_agreement) AS agreed, count_if(NOT ensemble_agreement) AS deferred FROM mollm_decisions JOIN (SELECT entity_id, bool_or(matched) AS matched FROM normalized_entities GROUP BY 1) USING (entity_id) GROUP BY 1")
def _(t: Loader):
    m = t.normalized_entities.groupBy("entity_id").agg(F.max("matched").alias("matched"))
    rows = t.mollm_decisions.join(m, "entity_id")
    return rows.groupBy(F.coalesce("matched", F.lit(False)).alias("matched")).agg(F.count_if("ensemble_agreement").alias("agreed"), F.count_if(~F.col("ensemble_agreement")).alias("deferred"))


@query("ag15_single_against_ensemble", """WITH v AS (SELECT mollm_call_id, unnest(models) AS m FROM mollm_tier_gate_decisions), u AS (SELECT DISTINCT mollm_call_id, lower(trim(m.model)) AS model, upper(m.verdict) AS verdict FROM v WHERE m.model IS NOT NULL AND m.verdict IS NOT NULL), b AS (SELECT mollm_call_id, verdict, row_number() OVER (PARTITION BY mollm_call_id ORDER BY count(*) DESC, verdict) AS rn FROM u GROUP BY 1, 2)
SELECT model, count(*) AS n, round(avg((u.verdict = b.verdict)::INT), 6) AS agreement FROM u JOIN b USING (mollm_call_id) WHERE rn = 1 GROUP BY 1""")
def _(t: Loader):
    u = t.mollm_tier_gate_decisions.select("mollm_call_id", F.explode("models").alias("m")).where("m.model IS NOT NULL AND m.verdict IS NOT NULL").select("mollm_call_id", F.lower(F.trim("m.model")).alias("model"), F.upper("m.verdict").alias("verdict")).distinct()
    return vt.against_plurality(u, "mollm_call_id", "model", "verdict")


@query("ag16_trust_classes", "WITH h AS (SELECT DISTINCT lower(trim(source_call_id)) AS k FROM hitl_review_queue WHERE reviewer_decision IN ('APPROVED', 'CORRECTED')) SELECT CASE WHEN h.k IS NOT NULL THEN 'A' WHEN composite_confidence >= 0.6 THEN 'B' ELSE 'C' END AS trust, count(*) AS n FROM mollm_tier_gate_decisions LEFT JOIN h ON h.k = lower(trim(mollm_call_id)) GROUP BY 1")
def _(t: Loader):
    h = t.hitl_review_queue.where(F.col("reviewer_decision").isin("APPROVED", "CORRECTED")).select(F.lower(F.trim("source_call_id")).alias("k")).distinct()
    g = t.mollm_tier_gate_decisions.withColumn("j", F.lower(F.trim("mollm_call_id"))).join(h, F.col("k") == F.col("j"), "left")
    trust = F.when(F.col("k").isNotNull(), "A").when(F.col("composite_confidence") >= 0.6, "B").otherwise("C")
    return g.groupBy(trust.alias("trust")).agg(F.count("*").alias("n"))


@query("ag17_tiebreak_outcomes", f"WITH {_CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY entity_id, gold ORDER BY s DESC, id) AS rn FROM c), p AS (SELECT entity_id, gold, max(CASE WHEN rn = 1 THEN id END) AS a, max(CASE WHEN rn = 2 THEN id END) AS b, max(CASE WHEN rn = 1 THEN s END) - max(CASE WHEN rn = 2 THEN s END) AS gap FROM r WHERE rn <= 2 GROUP BY 1, 2) SELECT CASE WHEN a = gold THEN 'loss' WHEN b = gold THEN 'win' ELSE 'neutral' END AS outcome, count(*) AS n FROM p WHERE round(gap, 6) < 0.1 GROUP BY 1")
def _(t: Loader):
    w = Window.partitionBy("entity_id", "gold").orderBy(F.desc("s"), "id")
    r = _graded(t).withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    pick = lambda c, n: F.max(F.when(F.col("rn") == n, F.col(c)))
    p = r.groupBy("entity_id", "gold").agg(pick("id", 1).alias("a"), pick("id", 2).alias("b"), (pick("s", 1) - pick("s", 2)).alias("gap"))
    out = F.when(F.col("a") == F.col("gold"), "loss").when(F.col("b") == F.col("gold"), "win").otherwise("neutral")
    return p.where(F.round("gap", 6) < 0.1).groupBy(out.alias("outcome")).agg(F.count("*").alias("n"))


@query("ag19_error_breakdown", f"WITH {_CO} SELECT coalesce(entity_label, 'all') AS label, coalesce(CASE WHEN c < 0.5 THEN 'low' WHEN c < 0.8 THEN 'mid' ELSE 'high' END, 'all') AS band, count(*) AS n, count_if(NOT y) AS errors FROM co WHERE entity_label IS NOT NULL GROUP BY GROUPING SETS ((entity_label), (CASE WHEN c < 0.5 THEN 'low' WHEN c < 0.8 THEN 'mid' ELSE 'high' END))")
def _(t: Loader):
    rows = _co(t).where("entity_label IS NOT NULL").withColumn("band", F.when(F.col("c") < 0.5, "low").when(F.col("c") < 0.8, "mid").otherwise("high"))
    sets = rows.groupingSets([["entity_label"], ["band"]], "entity_label", "band").agg(F.count("*").alias("n"), F.count_if(~F.col("y")).alias("errors"))
    return sets.select(F.coalesce("entity_label", F.lit("all")).alias("label"), F.coalesce("band", F.lit("all")).alias("band"), "n", "errors")


@query("ag20_channel_coverage", """WITH d AS (SELECT DISTINCT omop_concept_id AS id FROM normalized_entities WHERE omop_concept_id IS NOT NULL), s AS (SELECT DISTINCT concept_id AS id FROM concept_synonym), b AS (SELECT id FROM d INTERSECT SELECT id FROM s), o AS (SELECT id FROM d EXCEPT SELECT id FROM s)
SELECT (SELECT count(*) FROM b) AS by_both, (SELECT count(*) FROM o) AS direct_only, (SELECT count(*) FROM (SELECT id FROM d UNION SELECT id FROM s)) AS combined""")
def _(t: Loader):
    d = t.normalized_entities.where("omop_concept_id IS NOT NULL").select(F.col("omop_concept_id").alias("id")).distinct().withColumn("d", F.lit(True))
    s = t.concept_synonym.select(F.col("concept_id").alias("id")).distinct().withColumn("s", F.lit(True))
    x, y = F.col("d").isNotNull(), F.col("s").isNotNull()
    return d.join(s, "id", "full").agg(F.count_if(x & y).alias("by_both"), F.count_if(x & ~y).alias("direct_only"), F.count("*").alias("combined"))


@query("ag21_flag_combinations", "WITH f AS (SELECT length(original_text) <= 4 AS short, original_text = upper(original_text) AS upper, regexp_matches(original_text, '[0-9]') AND regexp_matches(original_text, '[A-Za-z]') AS mixed FROM extracted_entities WHERE original_text IS NOT NULL) SELECT short, upper, mixed, count(*) AS n FROM f GROUP BY CUBE (short, upper, mixed)")
def _(t: Loader):
    x = F.col("original_text")
    f = t.extracted_entities.where("original_text IS NOT NULL").select((F.length(x) <= 4).alias("short"), (x == F.upper(x)).alias("upper"), (x.rlike("[0-9]") & x.rlike("[A-Za-z]")).alias("mixed"))
    return f.cube("short", "upper", "mixed").agg(F.count("*").alias("n"))


@query("ag22_latency_summary", "WITH q AS (SELECT reviewer_decision AS d, review_duration AS v FROM hitl_review_queue WHERE review_duration IS NOT NULL AND reviewer_decision IS NOT NULL), s AS (SELECT d, list_sort(list(v)) AS l FROM q GROUP BY 1) SELECT d AS reviewer_decision, len(l) AS n, round(list_avg(l), 6) AS mean, round(list_median(l), 6) AS p50, l[floor(0.95 * (len(l) - 1) + 0.5)::INT + 1] AS p95, l[-1] AS most FROM s")
def _(t: Loader):
    return mx.latency_summary(t.hitl_review_queue.where("reviewer_decision IS NOT NULL"), "review_duration", "reviewer_decision")


@query("ag26_approximate_profile", "SELECT entity_label, count(DISTINCT entity_id) AS n_exact, true AS keys_near, true AS median_near FROM extracted_entities WHERE entity_label IS NOT NULL AND confidence IS NOT NULL GROUP BY 1")
def _(t: Loader):
    rows = t.extracted_entities.where("entity_label IS NOT NULL AND confidence IS NOT NULL")
    exact = rows.groupBy("entity_label").agg(F.countDistinct("entity_id").alias("n_exact"), F.expr("percentile(confidence, 0.5)").alias("exact"))
    both = mx.approximate_profile(rows, "entity_label", "entity_id", "confidence").join(exact, "entity_label")
    near = lambda a, b, by: F.abs(F.col(a) / F.col(b) - 1) < by
    return both.select("entity_label", "n_exact", near("n_keys", "n_exact", 0.05).alias("keys_near"), near("median", "exact", 0.01).alias("median_near"))


@query("ag23_unnest_ids", "SELECT DISTINCT x.omop_concept_id AS concept_id FROM (SELECT unnest(candidates) AS x FROM normalized_entities) WHERE x.omop_concept_id IS NOT NULL")
def _(t: Loader):
    return t.normalized_entities.select(F.explode("candidates.omop_concept_id").alias("concept_id")).where("concept_id IS NOT NULL").distinct()


@query("ag25_best_by_rank_map", "SELECT entity_id, min(CASE regexp_extract(trim(match_tier), '^([0-9])', 1) WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '3' THEN 3 WHEN '4' THEN 4 ELSE 5 END) AS best_tier FROM normalized_entities GROUP BY 1")
def _(t: Loader):
    tier = F.regexp_extract(F.trim("match_tier"), "^([0-9])", 1)
    return t.normalized_entities.groupBy("entity_id").agg(F.min(F.when(tier.isin("1", "2", "3", "4"), tier.cast("int")).otherwise(5)).alias("best_tier"))


_USE = "u AS (SELECT DISTINCT mollm_call_id, pos, upper(m.verdict) AS verdict, m.logprob_confidence AS p FROM (SELECT mollm_call_id, unnest(models) AS m, generate_subscripts(models, 1) AS pos FROM mollm_tier_gate_decisions) WHERE m.verdict IS NOT NULL AND NOT coalesce(m.degenerate_generation, false))"


def _usable(t: Loader):
    v = t.mollm_tier_gate_decisions.select("mollm_call_id", F.posexplode("models").alias("pos", "m")).where("m.verdict IS NOT NULL AND NOT coalesce(m.degenerate_generation, false)")
    return v.select("mollm_call_id", (F.col("pos") + 1).cast("long").alias("pos"), F.upper("m.verdict").alias("verdict"), F.col("m.logprob_confidence").alias("p")).distinct()


@query("rk08_plurality", f"WITH {_USE}, g AS (SELECT mollm_call_id, verdict, count(*) AS n, min(pos) AS first FROM u GROUP BY 1, 2) SELECT mollm_call_id, verdict, n FROM (SELECT *, row_number() OVER (PARTITION BY mollm_call_id ORDER BY n DESC, first, verdict) AS rn FROM g) WHERE rn = 1")
def _(t: Loader):
    return vt.plurality(_usable(t), "mollm_call_id", "verdict", "pos")


@query("dc11_vote_features", f"WITH {_USE}, f AS (SELECT mollm_call_id, count(*) AS n_votes, count(DISTINCT verdict) AS n_verdicts, round(avg(p), 6) AS mean_p, min(p) AS low_p, max(p) AS high_p, round(max(p) - min(p), 6) AS spread FROM u GROUP BY 1) SELECT * FROM f")
def _(t: Loader):
    return vt.vote_features(_usable(t), "mollm_call_id", "verdict", "p")


@query("dc09_rejected_alternatives", f"WITH {_USE}, s AS (SELECT mollm_call_id, verdict, count(*) / sum(count(*)) OVER (PARTITION BY mollm_call_id) AS share FROM u GROUP BY 1, 2) SELECT mollm_call_id, count(*) AS n_alternatives FROM s WHERE share < 0.3 GROUP BY 1")
def _(t: Loader):
    g = _usable(t).groupBy("mollm_call_id", "verdict").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("mollm_call_id"))
    return g.withColumn("share", share).where("share < 0.3").groupBy("mollm_call_id").agg(F.count("*").alias("n_alternatives"))


@query("dc12_logistic_calibrator")
def _(t: Loader):
    gate = t.mollm_tier_gate_decisions.select("mollm_call_id", F.col("mollm_routing_decision").contains("RESOLVED").alias("y")).where("y IS NOT NULL").dropDuplicates(["mollm_call_id"])
    rows = materialize(vt.vote_features(_usable(t), "mollm_call_id", "verdict", "p").join(gate, "mollm_call_id"), "features")
    scored = vt.fit_logistic(rows, ["n_votes", "n_verdicts", "mean_p", "spread"], "y")(rows)
    return scored.select("mollm_call_id", F.round("score", 4).alias("score"))


@query("dc13_grading", """WITH g AS (SELECT DISTINCT entity_id, omop_concept_id FROM normalized_entities WHERE omop_concept_id IS NOT NULL), s AS (SELECT DISTINCT mollm_call_id, entity_id, composite_confidence FROM mollm_tier_gate_decisions), q AS (SELECT entity_id, count(*) AS n FROM g GROUP BY 1)
SELECT CASE WHEN q.n IS NULL THEN 'ungradable: no concept' WHEN q.n > 1 THEN 'ungradable: several' WHEN composite_confidence >= 0.5 THEN 'correct' ELSE 'incorrect' END AS grade, count(*) AS n FROM s LEFT JOIN q USING (entity_id) GROUP BY 1""")
def _(t: Loader):
    q = t.normalized_entities.where("omop_concept_id IS NOT NULL").groupBy("entity_id").agg(F.countDistinct("omop_concept_id").alias("k"))
    s = t.mollm_tier_gate_decisions.select("mollm_call_id", "entity_id", "composite_confidence").distinct().join(q, "entity_id", "left")
    grade = F.when(F.col("k").isNull(), "ungradable: no concept").when(F.col("k") > 1, "ungradable: several").when(F.col("composite_confidence") >= 0.5, "correct").otherwise("incorrect")
    return s.groupBy(grade.alias("grade")).agg(F.count("*").alias("n"))


@query("dc17_label_constraint", "WITH a(label, domain) AS (VALUES ('Condition', 'Condition'), ('Medication', 'Drug'), ('Procedure', 'Procedure')) SELECT entity_id, expanded_text FROM normalized_entities WHERE gliner_label IS NOT NULL AND omop_domain IS NOT NULL AND (gliner_label NOT IN (SELECT label FROM a) OR (gliner_label, omop_domain) IN (SELECT label, domain FROM a)) GROUP BY ALL")
def _(t: Loader):
    allowed = {"Condition": ["Condition"], "Medication": ["Drug"], "Procedure": ["Procedure"]}
    return t.normalized_entities.where(vt.allowed_pairs("gliner_label", "omop_domain", allowed)).select("entity_id", "expanded_text").distinct()


@query("dc22_paired_flips", "WITH a AS (SELECT mollm_call_id, composite_confidence >= 0.5 AS x, calibrated_score >= 0.5 AS y FROM mollm_tier_gate_decisions WHERE composite_confidence IS NOT NULL AND calibrated_score IS NOT NULL) SELECT x AS before, y AS after, count(*) AS n FROM a GROUP BY ALL")
def _(t: Loader):
    rows = t.mollm_tier_gate_decisions.where("composite_confidence IS NOT NULL AND calibrated_score IS NOT NULL")
    return rows.groupBy((F.col("composite_confidence") >= 0.5).alias("before"), (F.col("calibrated_score") >= 0.5).alias("after")).agg(F.count("*").alias("n"))


@query("dc23_invariants", "SELECT 'span order' AS invariant, count_if(orig_start >= orig_end) AS broken FROM extracted_entities UNION ALL SELECT 'confidence range', count_if(confidence < 0 OR confidence > 1) FROM extracted_entities UNION ALL SELECT 'mapped has id', count_if(matched AND omop_concept_id IS NULL) FROM normalized_entities")
def _(t: Loader):
    e = t.extracted_entities.agg(F.count_if(F.col("orig_start") >= F.col("orig_end")).alias("span order"), F.count_if((F.col("confidence") < 0) | (F.col("confidence") > 1)).alias("confidence range"))
    n = t.normalized_entities.agg(F.count_if(F.col("matched") & F.col("omop_concept_id").isNull()).alias("mapped has id"))
    long = lambda df: df.select(F.explode(F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(f"`{c}`"))])).alias("invariant", "broken"))
    return long(e).unionByName(long(n))


@query("js02_decode_with_default", "SELECT DISTINCT hitl_case_id, TRY_CAST(presented_suggestion::JSON->>'concept_id' AS BIGINT) AS concept_id, presented_suggestion::JSON->>'concept_name' AS concept_name FROM hitl_review_queue WHERE json_valid(presented_suggestion)")
def _(t: Loader):
    s = F.from_json("presented_suggestion", "concept_id long, concept_name string")
    return t.hitl_review_queue.where("presented_suggestion IS NOT NULL AND try_parse_json(presented_suggestion) IS NOT NULL").select("hitl_case_id", s.alias("s")).select("hitl_case_id", "s.concept_id", "s.concept_name").distinct()


@query("js03_indexed_pick", "SELECT DISTINCT g.mollm_call_id, n.candidates[g.final_candidate_index].omop_concept_id AS picked FROM mollm_tier_gate_decisions g JOIN normalized_entities n USING (entity_id) WHERE g.final_candidate_index >= 1 AND n.candidates IS NOT NULL")
def _(t: Loader):
    g = t.mollm_tier_gate_decisions.where("final_candidate_index >= 1").select("mollm_call_id", "entity_id", "final_candidate_index")
    n = t.normalized_entities.where("candidates IS NOT NULL").select("entity_id", "candidates")
    return g.join(n, "entity_id").select("mollm_call_id", F.try_element_at("candidates", F.col("final_candidate_index"))["omop_concept_id"].alias("picked")).distinct()


@query("js01_top_candidate_struct", "SELECT DISTINCT entity_id, expanded_text, candidates[1].omop_concept_id AS top_id, candidates[1].similarity_score AS top_score, len(candidates) AS n FROM normalized_entities WHERE len(candidates) >= 1")
def _(t: Loader):
    top = F.try_element_at("candidates", F.lit(1))
    return t.normalized_entities.where(F.size("candidates") >= 1).select("entity_id", "expanded_text", top["omop_concept_id"].alias("top_id"), top["similarity_score"].alias("top_score"), F.size("candidates").cast("long").alias("n")).distinct()


@query("js05_provenance_columns", "SELECT concept_id, substr(sha256('[[' || concept_id || ', \"' || domain_id || '\"]]'), 1, 16) AS candidates_hash FROM concept")
def _(t: Loader):
    return t.concept.select("concept_id", vt.pair_hash(F.col("concept_id"), F.col("domain_id")).alias("candidates_hash"))


@query("dc19_holdout_guard", "WITH s AS (SELECT note_id, CASE WHEN bool_or(is_test) THEN 'test' ELSE 'val' END AS split FROM extracted_entities WHERE note_id IS NOT NULL GROUP BY 1), d AS (SELECT DISTINCT note_id FROM mollm_decisions WHERE note_id IS NOT NULL) SELECT note_id, note_id IN (SELECT note_id FROM d) AS available FROM s WHERE split = 'val'")
def _(t: Loader):
    split = F.when(F.coalesce(F.max("is_test"), F.lit(False)), "test").otherwise("val")
    table = t.extracted_entities.where("note_id IS NOT NULL").groupBy("note_id").agg(split.alias("split"))
    return vt.notes_of_split(table, t.mollm_decisions.select("note_id"))


QUERIES, ORACLES = query.queries, query.oracles

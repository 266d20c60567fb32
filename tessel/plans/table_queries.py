"""Queries of sources, sinks, filters, equi-joins and set operations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessel.functions.keys import loose
from tessel.operators import context as cx
from tessel.operators import maintain as mt
from tessel.operators import text as tx
from tessel.plans.registry import Loader, Registry
from tessel.plans.text_queries import mentions_sql
from tessel.sources import readers
from tessel.sources.tables import new_path

query = Registry()
ACTIVE = "NOT coalesce(below_threshold, false) AND NOT coalesce(superseded_by_split, false) AND NOT coalesce(superseded_by_growth, false)"


@query("src01_vocabulary_scan", "SELECT concept_id, concept_name, concept_code FROM concept WHERE standard_concept = 'S' AND vocabulary_id IN ('SNOMED', 'LOINC') AND domain_id = 'Measurement'")
def _(t: Loader):
    return t.concept.where("standard_concept = 'S' AND vocabulary_id IN ('SNOMED', 'LOINC') AND domain_id = 'Measurement'").select("concept_id", "concept_name", "concept_code")


@query("src02_csv_spans", "SELECT DISTINCT note_id, orig_start AS start, orig_end AS \"end\", original_text AS span FROM extracted_entities WHERE is_test AND orig_start IS NOT NULL AND orig_end IS NOT NULL")
def _(t: Loader):
    path = new_path(t.spark, "csv")
    rows = t.extracted_entities.where("is_test").select("note_id", F.col("orig_start").cast("double").alias("start"), F.col("orig_end").cast("double").alias("end"), F.col("original_text").alias("span"), F.lit(1).cast("long").alias("concept_id"))
    rows.write.csv(path, header=True, quoteAll=True, escape='"', nullValue="\\N", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.read_spans(t.spark, path).select("note_id", "start", "end", "span").distinct()


@query("src03_note_text", "SELECT CAST(doc_id AS VARCHAR) AS note_id, text FROM documents WHERE doc_kind = 'note' AND text IS NOT NULL AND trim(text, E' \\n\\r\\t') <> ''")
def _(t: Loader):
    path = new_path(t.spark, "text")
    docs = t.documents.where("doc_kind = 'note' AND text IS NOT NULL AND trim(BOTH ' \n\r\t' FROM text) <> ''")
    docs.select(F.col("doc_id").cast("string").alias("note_id"), "text").write.csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.read_note_texts(t.spark, path)


@query("src07_json_lines", "SELECT vec_id, label, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def _(t: Loader):
    path = new_path(t.spark, "jsonl")
    t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("features")).write.json(path)
    rows = readers.read_training_rows(t.spark, path, "vec_id long, label int, features array<double>", 64)
    return rows.select("vec_id", "label", F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("src05_linked_entities", """SELECT DISTINCT note_id AS chunk_id, CAST(x.omop_concept_id AS VARCHAR) AS snomed_cui, x.concept_name AS preferred_name, expanded_text AS source_value, x.similarity_score AS confidence_score FROM (SELECT note_id, expanded_text, unnest(candidates) AS x FROM normalized_entities WHERE note_id IS NOT NULL) WHERE x IS NOT NULL""")
def _(t: Loader):
    x = t.normalized_entities.where("note_id IS NOT NULL").select("note_id", "expanded_text", "candidates")
    entity = lambda c: F.when(c.isNotNull(), F.struct(c["omop_concept_id"].cast("string").alias("snomed_cui"), c["concept_name"].alias("preferred_name"), F.col("expanded_text").alias("source_value"), c["similarity_score"].alias("confidence_score"), F.struct(F.lit(0).alias("start"), F.length("expanded_text").alias("end")).alias("character_boundaries")))
    path = new_path(t.spark, "linked")
    x.select(F.col("note_id").alias("chunk_id"), F.transform("candidates", entity).alias("entities")).write.json(path)
    return readers.read_linked_entities(t.spark, path).drop("start", "end").distinct()


@query("src06_split_file", "SELECT note_id, CASE WHEN bool_or(is_test) THEN 'test' ELSE 'train' END AS split FROM extracted_entities WHERE note_id IS NOT NULL AND NOT contains(note_id, '#') GROUP BY 1")
def _(t: Loader):
    split = F.when(F.coalesce(F.max("is_test"), F.lit(False)), "test").otherwise("train")
    rows = t.extracted_entities.where("note_id IS NOT NULL AND NOT contains(note_id, '#')").groupBy("note_id").agg(split.alias("split"), F.count("*").alias("n_gold_annotations"))
    path = new_path(t.spark, "splits")
    rows.write.csv(path, header=True)
    t.spark.range(1).select(F.lit("# split by hand, see the notes\nnote_id,split,n_gold_annotations").alias("value")).write.mode("append").text(path)
    return readers.read_split_table(t.spark, path)


@query("src08_catalog", "SELECT DISTINCT table_name, column_name FROM duckdb_columns() WHERE table_name IN ('concept', 'concept_synonym', 'documents', 'note_index')")
def _(t: Loader):
    names = ("concept", "concept_synonym", "documents", "note_index")
    return readers.describe_tables(t.spark, {n: getattr(t, n) for n in names} | {"concept_ancestor": readers.optional_table(t.spark, "concept_ancestor")}).select("table_name", "column_name")


@query("src10_sampled_profile", "WITH s AS (SELECT * FROM concept ORDER BY md5(concept_id || ':sample') LIMIT 700) SELECT vocabulary_id, domain_id, count(*) AS n, count(invalid_reason) AS n_withdrawn FROM s GROUP BY ALL HAVING count(*) > 25")
def _(t: Loader):
    sample = readers.sample_rows(t.concept, F.concat(F.col("concept_id").cast("string"), F.lit(":sample")), 700)
    return sample.groupBy("vocabulary_id", "domain_id").agg(F.count("*").alias("n"), F.count("invalid_reason").alias("n_withdrawn")).where("n > 25")


@query("snk01_additive_schema", "SELECT concept_id, concept_name, false AS reviewed, 0 AS use_count FROM concept WHERE domain_id = 'Drug' UNION ALL SELECT concept_id, concept_name, true, 7 FROM concept WHERE domain_id = 'Procedure'")
def _(t: Loader):
    path = new_path(t.spark, "concepts")
    first = {"concept_id": ("bigint", None), "concept_name": ("string", None)}
    mt.ensure_table(t.spark, path, first)
    mt.append_rows(t.concept.where("domain_id = 'Drug'").select(*first), path)
    grown = first | {"reviewed": ("boolean", False), "use_count": ("int", 0)}
    mt.ensure_table(t.spark, path, grown)
    mt.append_rows(t.concept.where("domain_id = 'Procedure'").select(*first, F.lit(True).alias("reviewed"), F.lit(7).alias("use_count")), path)
    return mt.ensure_table(t.spark, path, grown)


_LAST = "SELECT {c} FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY {o}) AS rn FROM {t}) WHERE rn = 1"


@query("snk02_upsert_last_wins", """WITH b AS (SELECT o_orderkey % 500 AS k, o_orderkey, o_totalprice, CASE WHEN o_orderdate >= TIMESTAMP '1997-01-01' THEN 1 ELSE 0 END AS n FROM orders)
SELECT k, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, o_orderkey DESC) AS rn FROM b) WHERE rn = 1""")
def _(t: Loader):
    rows = t.orders.select((F.col("o_orderkey") % 500).alias("k"), "o_orderkey", "o_totalprice", "o_orderdate")
    late = F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp")
    return mt.upsert(rows.where(~late).drop("o_orderdate"), rows.where(late).drop("o_orderdate"), ["k"], [F.col("o_orderkey")])


@query("snk03_insert_ignore", """WITH a AS (SELECT mollm_call_id, entity_id, created_at FROM mollm_decisions WHERE ensemble_agreement), b AS (SELECT mollm_call_id, entity_id, created_at FROM mollm_decisions WHERE NOT coalesce(ensemble_agreement, false))
SELECT * FROM a UNION ALL SELECT mollm_call_id, entity_id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY mollm_call_id ORDER BY created_at NULLS FIRST, entity_id NULLS FIRST) AS rn FROM b) WHERE rn = 1 AND mollm_call_id NOT IN (SELECT mollm_call_id FROM a WHERE mollm_call_id IS NOT NULL)""")
def _(t: Loader):
    rows = t.mollm_decisions
    agreed = F.coalesce("ensemble_agreement", F.lit(False))
    cols = ["mollm_call_id", "entity_id", "created_at"]
    return mt.insert_ignore(rows.where(agreed).select(*cols), rows.where(~agreed).select(*cols), ["mollm_call_id"], [F.col("created_at"), F.col("entity_id")])


@query("snk04_counting_upsert", "SELECT lower(original_text) AS term, coalesce(section_name, 'General') AS context, expanded_text AS expansion, count(*) AS hit_count FROM extracted_entities WHERE original_text <> expanded_text GROUP BY ALL")
def _(t: Loader):
    log = t.extracted_entities.where("original_text <> expanded_text")
    return mt.counting_upsert(log, [F.lower("original_text").alias("term"), F.coalesce("section_name", F.lit("General")).alias("context"), F.col("expanded_text").alias("expansion")])


@query("snk05_parquet_export", "SELECT hitl_case_id, source_table, reviewer_decision FROM hitl_review_queue")
def _(t: Loader):
    path = new_path(t.spark, "export")
    return readers.export_tables({"hitl_review_queue": t.hitl_review_queue}, path)["hitl_review_queue"].select("hitl_case_id", "source_table", "reviewer_decision")


@query("snk06_snapshot_without_vectors", "SELECT vec_id, label FROM embeddings")
def _(t: Loader):
    kept = t.embeddings.drop("embedding")
    return readers.export_tables({"embeddings": kept, "scratch": kept.limit(0)}, new_path(t.spark, "snapshot"), leave_out=("scratch",))["embeddings"]


@query("snk07_update_from", "SELECT concept_id, concept_name, coalesce(s, concept_code) AS concept_code FROM concept LEFT JOIN (SELECT concept_id, max(concept_synonym_name) AS s FROM concept_synonym GROUP BY 1) USING (concept_id)")
def _(t: Loader):
    source = t.concept_synonym.groupBy("concept_id").agg(F.max("concept_synonym_name").alias("concept_code"))
    return mt.update_from(t.concept.select("concept_id", "concept_name", "concept_code"), source, ["concept_id"], ["concept_code"])


@query("snk08_conditional_update", "SELECT hitl_case_id, CASE WHEN reviewer_decision IN ('APPROVED', 'CORRECTED') THEN 'HUMAN_VERIFIED' WHEN reviewer_decision = 'REJECTED' THEN NULL ELSE final_ingestion_path END AS final_ingestion_path FROM hitl_review_queue WHERE coalesce(source_call_id, '') <> ''")
def _(t: Loader):
    path = F.when(F.col("reviewer_decision").isin("APPROVED", "CORRECTED"), "HUMAN_VERIFIED").when(F.col("reviewer_decision") == "REJECTED", F.lit(None)).otherwise(F.col("final_ingestion_path"))
    return t.hitl_review_queue.where(F.coalesce("source_call_id", F.lit("")) != "").select("hitl_case_id", path.alias("final_ingestion_path"))


@query("snk09_rebuild_key", """WITH r AS (SELECT entity_id, note_id, original_text, min(match_tier) AS match_tier FROM normalized_entities GROUP BY 1, 2, 3), o AS (SELECT DISTINCT entity_id, note_id, original_text FROM extracted_entities WHERE note_id IS NOT NULL AND original_text IS NOT NULL),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY note_id, original_text ORDER BY entity_id) AS rn FROM r) WHERE rn = 1)
SELECT entity_id, note_id, original_text, match_tier FROM r UNION ALL SELECT o.entity_id, o.note_id, o.original_text, f.match_tier FROM o JOIN f USING (note_id, original_text) WHERE o.entity_id NOT IN (SELECT entity_id FROM r WHERE entity_id IS NOT NULL)""")
def _(t: Loader):
    rows = t.normalized_entities.groupBy("entity_id", "note_id", "original_text").agg(F.min("match_tier").alias("match_tier"))
    owners = t.extracted_entities.where("note_id IS NOT NULL AND original_text IS NOT NULL").select("entity_id", "note_id", "original_text").distinct()
    return mt.rekey(rows, owners, ["note_id", "original_text"], "entity_id")


@query("snk10_graph_merge", """SELECT omop_concept_id, arg_min(omop_concept_name, k) AS omop_concept_name, arg_max(match_tier, k) AS match_tier FROM (SELECT *, entity_id || '|' || expanded_text || '|' || coalesce(strftime(created_at, '%Y%m%d%H%M%S%f'), '') AS k FROM normalized_entities WHERE omop_concept_name IS NOT NULL AND match_tier IS NOT NULL) WHERE omop_concept_id IS NOT NULL GROUP BY 1""")
def _(t: Loader):
    rows = t.normalized_entities.where("omop_concept_name IS NOT NULL AND match_tier IS NOT NULL")
    order = F.concat("entity_id", F.lit("|"), "expanded_text", F.lit("|"), F.coalesce(F.date_format("created_at", "yyyyMMddHHmmssSSSSSS"), F.lit("")))
    return mt.merge_nodes(rows.withColumn("k", order), "omop_concept_id", ["omop_concept_name"], ["match_tier"], F.col("k"))


@query("snk11_snapshot_compare", """WITH s AS (SELECT strftime(created_at, '%Y-%m') AS month, count(*)::DOUBLE AS n_rows, count(omop_concept_id)::DOUBLE AS n_mapped FROM normalized_entities WHERE created_at IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 2)
SELECT 'n_rows' AS metric, arg_min(n_rows, month) AS before, arg_max(n_rows, month) AS after, arg_max(n_rows, month) < arg_min(n_rows, month) AS dropped FROM s UNION ALL SELECT 'n_mapped', arg_min(n_mapped, month), arg_max(n_mapped, month), arg_max(n_mapped, month) < arg_min(n_mapped, month) FROM s""")
def _(t: Loader):
    months = t.normalized_entities.where("created_at IS NOT NULL").groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n_rows"), F.count("omop_concept_id").alias("n_mapped"))
    return mt.compare_snapshots(months, "month", ["n_rows", "n_mapped"])


@query("snk12_duration_text", """WITH s AS (SELECT hitl_case_id, floor(review_duration * 97)::BIGINT AS s FROM hitl_review_queue WHERE review_duration IS NOT NULL)
SELECT DISTINCT hitl_case_id, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' ELSE '' END || CASE WHEN s >= 60 THEN (s % 3600 // 60) || 'm ' ELSE '' END || (s % 60) || 's' AS took FROM s""")
def _(t: Loader):
    return t.hitl_review_queue.where("review_duration IS NOT NULL").select("hitl_case_id", mt.duration_text(F.col("review_duration") * 97).alias("took")).distinct()


@query("snk12_heartbeat", "SELECT 'review' AS job, count(*) FILTER (reviewer_decision <> 'PENDING') AS done, count(*) AS total, CAST(round(120 * count(*) FILTER (coalesce(reviewer_decision, 'PENDING') = 'PENDING') / count(*) FILTER (reviewer_decision <> 'PENDING')) AS BIGINT) AS eta_s FROM hitl_review_queue")
def _(t: Loader):
    import tempfile

    r = t.hitl_review_queue.agg(F.count_if(F.col("reviewer_decision") != "PENDING").alias("done"), F.count("*").alias("total")).first()
    with tempfile.TemporaryDirectory() as own:  # the driver's own status file
        mt.write_status(f"{own}/status.json", "review", r["done"], r["total"], 120.0)
        s = mt.read_status(f"{own}/status.json")
        mt.clear_status(f"{own}/status.json", "review")
    return t.spark.createDataFrame([(s["job"], s["done"], s["total"], s["eta_s"])], "job string, done long, total long, eta_s long")


@query("flt02_namespace_exclusion", "SELECT concept_id, concept_code FROM concept WHERE concept_code NOT LIKE '%9____'")
def _(t: Loader):
    return t.concept.where(~F.col("concept_code").like("%9____")).select("concept_id", "concept_code")


@query("flt03_name_search", "SELECT concept_id, concept_name FROM concept WHERE concept_name ILIKE '%acute%' AND invalid_reason IS NULL ORDER BY (standard_concept = 'S') DESC NULLS LAST, (concept_name ILIKE 'acute%') DESC, length(concept_name), concept_id LIMIT 15")
def _(t: Loader):
    rows = t.concept.where(F.col("concept_name").ilike("%acute%") & F.col("invalid_reason").isNull())
    return rows.orderBy((F.col("standard_concept") == "S").desc_nulls_last(), F.col("concept_name").ilike("acute%").desc(), F.length("concept_name"), "concept_id").limit(15).select("concept_id", "concept_name")


@query("flt04_active_rows", f"SELECT note_id, count(*) AS n, count(DISTINCT entity_id) AS n_mentions FROM extracted_entities WHERE {ACTIVE} GROUP BY 1")
def _(t: Loader):
    return t.extracted_entities.where(ACTIVE).groupBy("note_id").agg(F.count("*").alias("n"), F.countDistinct("entity_id").alias("n_mentions"))


_NOISE = f"{mentions_sql(['mg', 'Plan', 'daily'])}, c AS (SELECT *, substr(text, greatest(start - 11, 1), least(start, 12)) AS before, substr(text, start + length(term) + 1, 3) AS after FROM m)"


@query("flt05_noise", f"WITH {_NOISE} SELECT doc_id, start, CASE WHEN term = 'daily' AND regexp_matches(before, ',\\s*$') THEN 'credential' WHEN regexp_matches(after, '^[ \\t]{{0,2}}:') THEN 'header' WHEN term = 'mg' THEN 'placeholder' END AS reason FROM c")
def _(t: Loader):
    # the texts hold no titles and no "None": other words of theirs take these parts
    m = tx.mentions(t.documents, "doc_id", "text", ["mg", "Plan", "daily"], 12)
    before = F.substring("near", F.lit(1), F.col("at"))
    reason = cx.noise_reason(F.col("term"), before, cx.is_header(F.col("near"), F.col("at"), F.length("term")), ("daily",), ("mg",))
    return m.select("doc_id", "start", reason.alias("reason"))


@query("flt06_confidence_flag", "SELECT CASE WHEN confidence IS NULL THEN 'unknown' WHEN confidence < 0.35 THEN 'below' ELSE 'kept' END AS band, count(*) AS n FROM extracted_entities GROUP BY 1")
def _(t: Loader):
    c = F.col("confidence")
    return t.extracted_entities.groupBy(F.when(c.isNull(), "unknown").when(c < 0.35, "below").otherwise("kept").alias("band")).agg(F.count("*").alias("n"))


@query("flt07_optional_filters", "SELECT DISTINCT hitl_case_id, created_at FROM hitl_review_queue WHERE reviewer_decision = 'PENDING' AND lower(trim(source_table)) LIKE '%tier_gate%' AND note_id IS NOT NULL")
def _(t: Loader):
    wanted = {"reviewer_decision": "PENDING", "note_id": None}
    rows = t.hitl_review_queue.where(loose("source_table").like("%tier_gate%"))
    for c, v in wanted.items():
        rows = rows.where(F.col(c) == v) if v is not None else rows.where(F.col(c).isNotNull())
    return rows.select("hitl_case_id", "created_at").distinct()


@query("flt08_class_filter", "SELECT entity_id, expanded_text, len(list_filter(list_filter(candidates, lambda c: c IS NOT NULL), lambda c: c.domain_id <> 'Drug')) AS n_kept FROM normalized_entities WHERE candidates IS NOT NULL GROUP BY ALL")
def _(t: Loader):
    kept = F.filter("candidates", lambda c: c.isNotNull() & (c["domain_id"] != "Drug"))
    return t.normalized_entities.where("candidates IS NOT NULL").select("entity_id", "expanded_text", F.size(kept).cast("long").alias("n_kept")).distinct()


@query("flt09_boilerplate", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\b(refer to|documentation of|evidence for)\b') AND doc_kind = 'guideline'")
def _(t: Loader):
    return t.documents.where(F.col("text").rlike(r"(?i)\b(refer to|documentation of|evidence for)\b") & (F.col("doc_kind") == "guideline")).select("doc_id")


@query("flt10_population_difference", "SELECT note_id FROM note_index EXCEPT SELECT note_id FROM extracted_entities WHERE is_test")
def _(t: Loader):
    return t.note_index.select("note_id").subtract(t.extracted_entities.where("is_test").select("note_id"))


@query("flt11_code_shape", "SELECT DISTINCT original_text FROM extracted_entities WHERE regexp_matches(original_text, '^[A-Za-z]{1,2}[0-9]{1,2}$') OR regexp_matches(original_text, '^[A-Z]{3,4}$')")
def _(t: Loader):
    c = F.col("original_text")
    return t.extracted_entities.where(c.rlike("^[A-Za-z]{1,2}[0-9]{1,2}$") | c.rlike("^[A-Z]{3,4}$")).select("original_text").distinct()


@query("flt12_resume_skip", "SELECT DISTINCT lower(trim(entity_id)) AS entity_key FROM normalized_entities WHERE trim(entity_id) <> '' EXCEPT SELECT lower(trim(entity_id)) FROM mollm_decisions")
def _(t: Loader):
    todo = t.normalized_entities.select(loose("entity_id").alias("entity_key")).where("entity_key IS NOT NULL").distinct()
    return todo.join(t.mollm_decisions.select(loose("entity_id").alias("entity_key")).distinct(), "entity_key", "left_anti")


@query("jn01_inner_equi", "SELECT d.mollm_routing_decision AS routing, e.entity_label AS label, count(*) AS n FROM mollm_decisions d JOIN extracted_entities e USING (entity_id) JOIN normalized_entities m USING (entity_id) GROUP BY ALL")
def _(t: Loader):
    d = t.mollm_decisions.select("entity_id", F.col("mollm_routing_decision").alias("routing"))
    return d.join(t.extracted_entities.select("entity_id", F.col("entity_label").alias("label")), "entity_id").join(t.normalized_entities.select("entity_id"), "entity_id").groupBy("routing", "label").agg(F.count("*").alias("n"))


@query("jn02_many_keys", "SELECT e.note_id, e.original_text, count(*) AS n FROM extracted_entities e JOIN normalized_entities m ON e.note_id = m.note_id AND e.original_text = m.original_text AND e.expanded_text = m.expanded_text AND e.entity_label = m.gliner_label GROUP BY ALL")
def _(t: Loader):
    keys = ["note_id", "original_text", "expanded_text", "label"]
    e = t.extracted_entities.withColumnRenamed("entity_label", "label").select(*keys)
    return e.join(t.normalized_entities.withColumnRenamed("gliner_label", "label").select(*keys), keys).groupBy("note_id", "original_text").agg(F.count("*").alias("n"))


@query("jn10_queue_candidates", """SELECT DISTINCT d.mollm_call_id, d.entity_id, e.entity_label FROM mollm_decisions d LEFT JOIN (SELECT entity_id, min(entity_label) AS entity_label FROM extracted_entities GROUP BY 1) e USING (entity_id)
WHERE NOT EXISTS (SELECT 1 FROM hitl_review_queue q WHERE lower(trim(q.source_call_id)) = lower(trim(d.mollm_call_id)) AND lower(trim(q.source_table)) LIKE '%mollm_decisions')""")
def _(t: Loader):
    queued = t.hitl_review_queue.where(loose("source_table").like("%mollm_decisions")).select(loose("source_call_id").alias("_k")).where("_k IS NOT NULL").distinct()
    label = t.extracted_entities.groupBy("entity_id").agg(F.min("entity_label").alias("entity_label"))
    todo = t.mollm_decisions.select("mollm_call_id", "entity_id").join(queued, loose("mollm_call_id") == F.col("_k"), "left_anti")
    return todo.join(label, "entity_id", "left").select("mollm_call_id", "entity_id", "entity_label").distinct()


@query("jn19_prior_confirmations", """WITH k AS (SELECT lower(trim(original_text)) AS text_key, omop_concept_id, count(*) AS n FROM normalized_entities WHERE coalesce(omop_concept_id, 0) <> 0 GROUP BY ALL)
SELECT DISTINCT e.entity_id, m.omop_concept_id, coalesce(k.n, 0) AS n FROM extracted_entities e JOIN (SELECT DISTINCT entity_id, omop_concept_id FROM normalized_entities WHERE omop_concept_id IS NOT NULL) m USING (entity_id) LEFT JOIN k ON k.text_key = lower(trim(e.original_text)) AND k.omop_concept_id = m.omop_concept_id""")
def _(t: Loader):
    text = F.lower(F.trim("original_text")).alias("text_key")
    known = t.normalized_entities.where("coalesce(omop_concept_id, 0) <> 0").groupBy(text, "omop_concept_id").agg(F.count("*").alias("n"))
    asked = t.extracted_entities.select("entity_id", text).join(t.normalized_entities.where("omop_concept_id IS NOT NULL").select("entity_id", "omop_concept_id").distinct(), "entity_id")
    return asked.join(known, ["text_key", "omop_concept_id"], "left").select("entity_id", "omop_concept_id", F.coalesce("n", F.lit(0)).alias("n")).distinct()


@query("jn20_cross_tab", """WITH a AS (SELECT entity_id, bool_or(matched) AS before FROM normalized_entities GROUP BY 1), b AS (SELECT entity_id, bool_or(ensemble_agreement) AS after FROM mollm_decisions GROUP BY 1)
SELECT CASE WHEN before AND after THEN 'CONFIRMED' WHEN NOT before AND after THEN 'FIXED' WHEN before AND NOT after THEN 'INTRODUCED' WHEN NOT before AND NOT after THEN 'MISSED' ELSE 'UNGRADABLE' END AS outcome, count(*) AS n FROM b LEFT JOIN a USING (entity_id) GROUP BY 1""")
def _(t: Loader):
    a = t.normalized_entities.groupBy("entity_id").agg(F.max("matched").alias("before"))
    b = t.mollm_decisions.groupBy("entity_id").agg(F.max("ensemble_agreement").alias("after"))
    x, y = F.col("before"), F.col("after")
    outcome = F.when(x & y, "CONFIRMED").when(~x & y, "FIXED").when(x & ~y, "INTRODUCED").when(~x & ~y, "MISSED").otherwise("UNGRADABLE")
    return b.join(a, "entity_id", "left").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("set01_union_forced", "WITH k AS (SELECT concept_id, length(concept_name) AS l FROM concept ORDER BY l DESC, concept_id LIMIT 20), f AS (SELECT concept_id, length(concept_name) AS l FROM concept WHERE concept_name LIKE 'acute %') SELECT * FROM k UNION SELECT * FROM f")
def _(t: Loader):
    rows = t.concept.select("concept_id", F.length("concept_name").alias("l"), "concept_name")
    return rows.orderBy(F.desc("l"), "concept_id").limit(20).drop("concept_name").union(rows.where("concept_name LIKE 'acute %'").drop("concept_name")).distinct()


@query("set02_contamination", "SELECT note_id FROM extracted_entities WHERE is_test INTERSECT SELECT note_id FROM extracted_entities WHERE NOT coalesce(is_test, false)")
def _(t: Loader):
    return t.extracted_entities.where("is_test").select("note_id").intersect(t.extracted_entities.where("NOT coalesce(is_test, false)").select("note_id"))


@query("set03_merge_with_cap", "SELECT DISTINCT entity_id, expanded_text, CAST(list_slice(list_concat(list_transform(list_filter(candidates, lambda c: c IS NOT NULL), lambda c: c.omop_concept_id), [omop_concept_id]), 1, 3) AS VARCHAR) AS ids FROM normalized_entities WHERE candidates IS NOT NULL AND omop_concept_id IS NOT NULL")
def _(t: Loader):
    ids = F.transform(F.filter("candidates", lambda c: c.isNotNull()), lambda c: c["omop_concept_id"])
    merged = F.slice(F.concat(ids, F.array("omop_concept_id")), 1, 3)
    rows = t.normalized_entities.where("candidates IS NOT NULL AND omop_concept_id IS NOT NULL")
    return rows.select("entity_id", "expanded_text", F.concat(F.lit("["), F.array_join(F.transform(merged, lambda x: x.cast("string")), ", ", "NULL"), F.lit("]")).alias("ids")).distinct()


@query("set04_best_of_chunks", "SELECT note_id, orig_start, orig_end, entity_label, max(confidence) AS confidence FROM extracted_entities WHERE confidence IS NOT NULL GROUP BY ALL")
def _(t: Loader):
    rows = t.extracted_entities.where("confidence IS NOT NULL")
    w = Window.partitionBy("note_id", "orig_start", "orig_end", "entity_label").orderBy(F.desc("confidence"), "entity_id")
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("note_id", "orig_start", "orig_end", "entity_label", "confidence")


@query("set05_triple_concat", "SELECT CAST(s_suppkey AS VARCHAR) AS head, 'IN' AS rel, n_name AS tail FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT n_name, 'IN', r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t: Loader):
    a = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").cast("string").alias("head"), F.lit("IN").alias("rel"), F.col("n_name").alias("tail"))
    return a.unionAll(t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", F.lit("IN"), "r_name"))


QUERIES, ORACLES = query.queries, query.oracles

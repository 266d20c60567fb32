"""Queries of text operators and of the guideline graph."""

from itertools import product

from pyspark.sql import functions as F

from tessel.functions.registered import register
from tessel.operators import text as tx
from tessel.operators.linking import top_k
from tessel.operators.nested import flat_table
from tessel.plans import training_queries as tq
from tessel.plans.registry import Loader, Registry

query = Registry()
TERMS = ["mg", "acute", "chronic", "serum", "daily", "left", "right", "stable"]


def mentions_sql(terms: list[str]) -> str:
    """m(doc_id, text, term, start): every occurrence of a term that stands in no longer word."""
    values = ", ".join(f"('{t}')" for t in terms)
    return f"""s AS (SELECT doc_id, text, term, string_split(text, term) AS p FROM documents, (VALUES {values}) v(term) WHERE contains(text, term)),
o AS (SELECT doc_id, text, term, CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + (k - 1) * length(term) AS INT) AS start FROM s, unnest(range(1, len(p))) u(k)),
m AS (SELECT * FROM o WHERE (start = 0 OR NOT regexp_matches(substr(text, start, 1), '[\\p{{L}}\\p{{N}}]')) AND NOT regexp_matches(substr(text, start + length(term) + 1, 1), '[\\p{{L}}\\p{{N}}]'))"""


@query("tx01_sections")
def _(t: Loader):
    return tx.sections(t.documents, "doc_id", "text")


@query("tx01_section_counts", r"SELECT doc_id, len(regexp_extract_all(text, '(?m)^[ \t]*([A-Z][A-Za-z0-9 /\-''&.]{2,45}?):')) AS n FROM documents WHERE regexp_matches(text, '(?m)^[ \t]*([A-Z][A-Za-z0-9 /\-''&.]{2,45}?):')")
def _(t: Loader):
    return tx.sections(t.documents, "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("tx01_sections_in_sql", r"SELECT doc_id, len(regexp_extract_all(text, '(?m)^[ \t]*([A-Z][A-Za-z0-9 /\-''&.]{2,45}?):')) AS n FROM documents WHERE regexp_matches(text, '(?m)^[ \t]*([A-Z][A-Za-z0-9 /\-''&.]{2,45}?):')")
def _(t: Loader):
    register(t.spark)
    t.documents.createOrReplaceTempView("tessel_documents")
    return t.spark.sql("SELECT doc_id, count(*) AS n FROM tessel_documents, LATERAL sections_of(text) GROUP BY doc_id")


@query("tx02_abbreviation_table", "SELECT lower(original_text) AS abbreviation, array_to_string(list_sort(list_distinct(list(expanded_text))), '|') AS meanings FROM extracted_entities WHERE length(original_text) <= 5 AND expanded_text IS NOT NULL GROUP BY 1")
def _(t: Loader):
    rows = t.extracted_entities.where("length(original_text) <= 5 AND expanded_text IS NOT NULL")
    return rows.groupBy(F.lower("original_text").alias("abbreviation")).agg(F.array_join(F.array_sort(F.collect_set("expanded_text")), "|").alias("meanings"))


@query("tx02_dictionary_version", "WITH d AS (SELECT DISTINCT lower(original_text) || chr(9) || expanded_text AS line FROM extracted_entities WHERE length(original_text) <= 5 AND expanded_text IS NOT NULL) SELECT count(*) AS n, CAST(sum(('0x' || substr(sha256(line), 1, 12))::BIGINT) AS VARCHAR) AS version FROM d")
def _(t: Loader):
    rows = t.extracted_entities.where("length(original_text) <= 5 AND expanded_text IS NOT NULL")
    return tx.table_version(rows.select(F.concat_ws("\t", F.lower("original_text"), "expanded_text").alias("line")).distinct(), "line")


_EXPAND = {"daily": "each day", "mg": "milligrams", "left": "left-sided"}


@query("tx03_expand_abbreviations", """SELECT doc_id, CASE WHEN text = '' THEN '' ELSE array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9/]+|[^A-Za-z0-9/]+'), lambda w: CASE w """ + " ".join(f"WHEN '{c}' THEN '{v}'" for k, v in _EXPAND.items() for c in sorted({"".join(x) for x in product(*((a, a.upper()) for a in k))})) + """ ELSE w END), '') END AS expanded FROM documents WHERE text IS NOT NULL""")
def _(t: Loader):
    return tx.expand(t.documents, "doc_id", "text", _EXPAND).select("doc_id", "expanded")


_CHANGED = ", ".join(f"'{k}'" for k in _EXPAND)


@query("tx06_offsets_to_original", f"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9/]+|[^A-Za-z0-9/]+') AS w FROM documents WHERE text <> ''), l AS (SELECT doc_id, w, list_transform(w, lambda x: length(x)) AS n FROM w)
SELECT doc_id, CAST(coalesce(list_sum(n[1:i - 1]), 0) AS INT) AS start, CAST(coalesce(list_sum(n[1:i - 1]), 0) AS INT) AS back FROM l, unnest(range(1, len(w) + 1)) u(i) WHERE lower(w[i]) IN ({_CHANGED}) AND regexp_matches(w[i], '^[A-Za-z0-9/]')""")
def _(t: Loader):
    e = tx.expand(t.documents, "doc_id", "text", _EXPAND).withColumn("edit", F.explode("edits"))
    return e.select("doc_id", F.col("edit.start").alias("start"), tx.to_original(F.col("edits"), F.col("edit.exp_start"), False).alias("back"))


@query("tx04_numeric_context", f"""WITH {mentions_sql(["mg"])}, c AS (SELECT doc_id, start, substr(text, start + 3, 12) AS after, substr(text, greatest(start - 11, 1), least(start, 12)) AS before FROM m)
SELECT doc_id, start, CASE WHEN regexp_matches(after, '^\\s*[<>=\\-]\\s*-?\\d') THEN 'lab_value' WHEN regexp_matches(after, '^\\s*\\d') OR regexp_matches(before, '\\d\\s*$') THEN 'unit_value' END AS kind FROM c""")
def _(t: Loader):
    m = tx.mentions(t.documents, "doc_id", "text", ["mg"], 12)
    return m.select("doc_id", "start", tx.numeric_context(F.col("near"), F.col("at"), F.col("at") + F.length("term")).alias("kind"))


@query("tx05_soft_wraps", r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), w AS (SELECT doc_id, len(list_filter(range(1, len(l)), lambda i: regexp_matches(l[i], '[^ \t\r][ \t]*\r?$') AND regexp_matches(l[i + 1], '^[ \t]*[\p{Ll}\x{AA}\x{BA}]'))) AS n FROM l) SELECT * FROM w WHERE n > 0""")
def _(t: Loader):
    d = t.documents.select("doc_id", (F.regexp_count("text", F.lit("\n")) - F.regexp_count(tx.join_soft_wraps(F.col("text")), F.lit("\n"))).cast("long").alias("n"))
    return d.where("n > 0")


@query("tx07_sentences")
def _(t: Loader):
    return tx.sentence_spans(t.documents, "doc_id", "text")


@query("tx08_chunks")
def _(t: Loader):
    return tx.chunks(t.documents, "doc_id", "text", 200, 30)


@query("tx10_span_ids", "SELECT DISTINCT entity_id, note_id || '-e' || substr(sha1(orig_start || ':' || orig_end || ':' || entity_label), 1, 10) AS made FROM extracted_entities WHERE note_id IS NOT NULL AND orig_start IS NOT NULL AND orig_end IS NOT NULL AND entity_label IS NOT NULL")
def _(t: Loader):
    rows = t.extracted_entities.where("note_id IS NOT NULL AND orig_start IS NOT NULL AND orig_end IS NOT NULL AND entity_label IS NOT NULL")
    return rows.select("entity_id", tx.span_id(F.col("note_id"), F.col("orig_start"), F.col("orig_end"), F.col("entity_label")).alias("made")).distinct()


@query("tx11_dictionary_scan", f"WITH {mentions_sql(TERMS)} SELECT doc_id, term, count(*) AS n FROM m GROUP BY ALL")
def _(t: Loader):
    return tx.dictionary_spans(t.documents, "doc_id", "text", TERMS).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@query("tx12_new_spans_only")
def _(t: Loader):
    found = tx.dictionary_spans(t.documents, "doc_id", "text", TERMS)
    return tx.drop_overlapping(found, tx.sections(t.documents, "doc_id", "text").select("doc_id", F.col("header_start").alias("start"), F.col("start").alias("end")), "doc_id")


@query("tx14_context_words", f"""WITH {mentions_sql(["mg"])}, w AS (SELECT doc_id, start, list_transform(regexp_extract_all(substr(text, greatest(start - 59, 1), least(start, 60)), '[A-Za-z]+'), lambda x: lower(x)) AS b, list_transform(regexp_extract_all(substr(text, start + 3, 60), '[A-Za-z]+'), lambda x: lower(x)) AS a FROM m)
SELECT doc_id, start, array_to_string(b[greatest(len(b) - 2, 1):len(b)], ' ') AS before, array_to_string(a[1:3], ' ') AS after FROM w""")
def _(t: Loader):
    m = tx.mentions(t.documents, "doc_id", "text", ["mg"], 60)
    w = tx.context_words(F.col("near"), F.col("at"), F.col("at") + F.length("term"))
    return m.select("doc_id", "start", F.array_join(w["before"], " ").alias("before"), F.array_join(w["after"], " ").alias("after"))


@query("tx15_log_odds", """WITH r AS (SELECT entity_label AS g, regexp_extract(lower(expanded_text), '^([a-z]+)', 1) AS w, assertion_status AS m FROM extracted_entities WHERE assertion_status IS NOT NULL AND entity_label IS NOT NULL AND regexp_matches(expanded_text, '^[A-Za-z]')), c AS (SELECT g, w, m, count(*) AS n FROM r GROUP BY ALL), a AS (SELECT g, w, sum(n) AS wn FROM c GROUP BY ALL), b AS (SELECT g, m, sum(n) AS mn FROM c GROUP BY ALL), t AS (SELECT g, sum(n) AS tn FROM c GROUP BY ALL)
SELECT g, w, m, n, round(ln(((n + 1) / (mn + 2)) / ((wn - n + 1) / (tn - mn + 2))), 6) AS log_odds FROM c JOIN a USING (g, w) JOIN b USING (g, m) JOIN t USING (g) WHERE n >= 2 AND round(ln(((n + 1) / (mn + 2)) / ((wn - n + 1) / (tn - mn + 2))), 6) > 0""")
def _(t: Loader):
    rows = t.extracted_entities.where(F.col("assertion_status").isNotNull() & F.col("entity_label").isNotNull() & F.col("expanded_text").rlike("^[A-Za-z]"))
    return tx.log_odds(rows.select(F.col("entity_label").alias("g"), F.regexp_extract(F.lower("expanded_text"), "^([a-z]+)", 1).alias("w"), F.col("assertion_status").alias("m")), "g", "w", "m")


@query("tx16_trim_connectors", "SELECT DISTINCT expanded_text, regexp_replace(regexp_replace(trim(expanded_text), '(?i)^((of|in|serum)\\s+)+', ''), '(?i)(\\s+(of|in|serum))+$', '') AS trimmed FROM normalized_entities WHERE expanded_text IS NOT NULL")
def _(t: Loader):
    return t.normalized_entities.where("expanded_text IS NOT NULL").select("expanded_text", tx.trim_words(F.col("expanded_text"), ["of", "in", "serum"]).alias("trimmed")).distinct()


@query("tx17_compound_split", """WITH k AS (SELECT lower(concept_name) AS x FROM concept UNION SELECT unnest(string_split(lower(concept_name), ' ')) FROM concept), q AS (SELECT DISTINCT lower(trim(expanded_text)) AS text, regexp_split_to_array(lower(trim(expanded_text)), '\\s+') AS w FROM normalized_entities WHERE lower(trim(expanded_text)) NOT IN (SELECT x FROM k)),
c AS (SELECT text, w, [a] AS cut FROM q, unnest(range(1, len(w))) u(a) UNION ALL SELECT text, w, [a, b] FROM q, unnest(range(1, len(w))) u(a), unnest(range(1, len(w))) v(b) WHERE a < b UNION ALL SELECT text, w, [a, b, c] FROM q, unnest(range(1, len(w))) u(a), unnest(range(1, len(w))) v(b), unnest(range(1, len(w))) x(c) WHERE a < b AND b < c),
p AS (SELECT text, list_transform(range(1, len(cut) + 2), lambda i: array_to_string(w[coalesce(cut[i - 1], 0) + 1:coalesce(cut[i], len(w))], ' ')) AS parts FROM c), f AS (SELECT text, parts FROM p, unnest(parts) u(x) JOIN k USING (x) GROUP BY ALL HAVING count(*) = len(parts))
SELECT text, array_to_string(arg_min(parts, (len(parts), list_transform(parts, lambda x: length(x)), parts)), '|') AS parts FROM f GROUP BY 1""")
def _(t: Loader):
    known = t.concept.select(F.lower("concept_name").alias("name")).union(t.concept.select(F.explode(F.split(F.lower("concept_name"), " "))))
    return tx.compound_splits(t.normalized_entities, known, "expanded_text").select("text", F.array_join("parts", "|").alias("parts"))


@query("tx19_strip_value", "SELECT DISTINCT original_text, regexp_replace(trim(original_text), '([A-Za-z]{2})(\\s*[-:=]\\s*|\\s+)?[<>]?\\d+([.,]\\d+)?\\s*%?$', '\\1') AS stripped FROM normalized_entities WHERE original_text IS NOT NULL")
def _(t: Loader):
    return t.normalized_entities.where("original_text IS NOT NULL").select("original_text", tx.strip_value(F.col("original_text")).alias("stripped")).distinct()


@query("tx20_structured_result", "SELECT doc_id FROM documents WHERE text IS NOT NULL AND (regexp_matches(trim(text), '^[A-Za-z][A-Za-z ]{1,30}\\s*[-:=]\\s*[<>]?\\d') OR len(regexp_extract_all(text, '[A-Za-z]{2,}\\s*[-:=]\\s*\\d')) >= 3)")
def _(t: Loader):
    return t.documents.where(tx.is_structured_result(F.col("text"))).select("doc_id")


_CUE = r"(^|[^\p{L}\p{M}\p{N}\p{Pc}])(%s)($|[^\p{L}\p{M}\p{N}\p{Pc}])"


@query("tx21_assertion", f"""WITH {mentions_sql(["acute"])}, w AS (SELECT doc_id, start, regexp_extract(substr(text, greatest(start - 39, 1), least(start, 40)), '([^.;\\n]*)$', 1) AS own FROM m)
SELECT doc_id, start, CASE """ + " ".join(f"WHEN regexp_matches(own, '(?i){_CUE % words}') THEN '{state}'" for state, words in tx.CUES) + " ELSE 'PRESENT' END AS state FROM w")
def _(t: Loader):
    m = tx.mentions(t.documents, "doc_id", "text", ["acute"], 40)
    return m.select("doc_id", "start", tx.assertion(F.col("near"), F.col("at"), F.col("at") + F.length("term")).alias("state"))


@query("tx22_section_priors", "SELECT entity_id, CASE WHEN lower(section_name) LIKE '%history%' AND assertion_status = 'PRESENT' THEN 'HISTORICAL' WHEN lower(section_name) LIKE '%allerg%' AND entity_label = 'Medication' THEN 'ALLERGY' ELSE assertion_status END AS state FROM extracted_entities")
def _(t: Loader):
    s = F.lower("section_name")
    state = F.when(s.like("%history%") & (F.col("assertion_status") == "PRESENT"), "HISTORICAL").when(s.like("%allerg%") & (F.col("entity_label") == "Medication"), "ALLERGY").otherwise(F.col("assertion_status"))
    return t.extracted_entities.select("entity_id", state.alias("state"))


_RATIO = """WITH p AS (SELECT DISTINCT expanded_text AS a, omop_concept_name AS b FROM normalized_entities WHERE omop_concept_name IS NOT NULL AND expanded_text IS NOT NULL), w AS (SELECT a, b, list_filter(list_distinct(regexp_extract_all(lower(a), '[a-z0-9]+')), lambda x: x NOT IN ('of', 'in')) AS x, list_filter(list_distinct(regexp_extract_all(lower(b), '[a-z0-9]+')), lambda x: x NOT IN ('of', 'in')) AS y FROM p), r AS (SELECT a, b, CASE WHEN least(len(x), len(y)) > 0 THEN round(len(list_intersect(x, y)) / least(len(x), len(y)), 4) ELSE 0 END AS ratio FROM w)"""


def _ratio(t: Loader):
    p = t.normalized_entities.where("expanded_text IS NOT NULL AND omop_concept_name IS NOT NULL").select(F.col("expanded_text").alias("a"), F.col("omop_concept_name").alias("b")).distinct()
    return p.withColumn("ratio", tx.token_set_ratio(F.col("a"), F.col("b"), ["of", "in"]))


@query("tx23_token_set_ratio", _RATIO + " SELECT * FROM r")
def _(t: Loader):
    return _ratio(t)


@query("tx24_name_agreement", _RATIO + " SELECT CASE WHEN ratio >= 0.75 THEN 'agree' WHEN ratio >= 0.45 THEN 'weak' ELSE 'reject' END AS verdict, count(*) AS n FROM r GROUP BY 1")
def _(t: Loader):
    return _ratio(t).groupBy(tx.name_agreement(F.col("ratio")).alias("verdict")).agg(F.count("*").alias("n"))


@query("tx26_containment")
def _(t: Loader):
    p = t.normalized_entities.where("omop_concept_name IS NOT NULL").select(F.col("expanded_text").alias("a"), F.col("omop_concept_name").alias("b")).distinct()
    return p.select("a", "b", tx.containment(F.col("b"), F.col("a")).alias("contained"))


@query("tx27_repetition", r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\s\p{Z}\x0B\x1c-\x1f\x85]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL), g AS (SELECT doc_id, len(w) AS n, list_transform(range(1, len(w) - 4), lambda i: array_to_string(w[i:i + 5], ' ')) AS g FROM w), r AS (SELECT doc_id, n, CASE WHEN len(g) > 0 THEN round(len(list_distinct(g)) / len(g), 6) END AS distinct_ratio FROM g)
SELECT doc_id, distinct_ratio, coalesce(n >= 40 AND distinct_ratio < 0.35, false) AS loops FROM r""")
def _(t: Loader):
    return t.documents.where("text IS NOT NULL").select("doc_id", tx.repetition(F.col("text")).alias("r")).select("doc_id", "r.distinct_ratio", "r.loops")


@query("tx28_lenient_json")
def _(t: Loader):
    return t.mollm_decisions.where("models IS NOT NULL").select("mollm_call_id", F.length(tx.lenient_json(F.concat(F.lit("```json\n"), "models", F.lit("\n```")))).alias("n"))


@query("tx32_doubt_reasons", "SELECT DISTINCT entity_id, expanded_text, array_to_string(list_filter([CASE WHEN coalesce(gliner_confidence, 0) < 0.7 THEN 'low_confidence' END, CASE WHEN coalesce(is_ambiguous, false) THEN 'ambiguous' END, CASE WHEN length(original_text) <= 4 THEN 'short_text' END, CASE WHEN length(original_text) <= 8 AND original_text = upper(original_text) THEN 'upper_case' END, CASE WHEN regexp_matches(original_text, '[0-9]') AND regexp_matches(original_text, '[A-Za-z]') THEN 'letters_and_digits' END], lambda x: x IS NOT NULL), ',') AS reasons FROM normalized_entities WHERE original_text IS NOT NULL")
def _(t: Loader):
    r = tx.doubt_reasons(F.col("original_text"), F.col("gliner_confidence"), F.col("is_ambiguous"))
    return t.normalized_entities.where("original_text IS NOT NULL").select("entity_id", "expanded_text", F.array_join(r, ",").alias("reasons")).distinct()


@query("tx34_release_signature", "SELECT count(*) || ':' || max(concept_id) || ':' || count(DISTINCT vocabulary_id) AS signature FROM concept")
def _(t: Loader):
    return t.concept.agg(F.concat_ws(":", F.count("*").cast("string"), F.max("concept_id").cast("string"), F.countDistinct("vocabulary_id").cast("string")).alias("signature"))


_NODES = """f AS (SELECT DISTINCT file_id, payload FROM guideline_files WHERE json_valid(payload)), n AS (SELECT file_id, unnest(from_json(payload->'$."@graph"', '["JSON"]')) AS x FROM f), node AS (SELECT file_id, x->>'@id' AS id, x->>'@type' AS type, lower(trim(x->>'name')) AS name, x->'rules' AS rules FROM n WHERE json_type(x) = 'OBJECT'),
rule AS (SELECT file_id, id AS source, r->>'predicate' AS predicate, r->>'target' AS target, r->>'citation_type' AS citation_type FROM (SELECT file_id, id, unnest(CASE json_type(rules) WHEN 'ARRAY' THEN from_json(rules, '["JSON"]') WHEN 'OBJECT' THEN [rules] END) AS r FROM node) WHERE json_type(r) = 'OBJECT')"""


def _graph(t: Loader):
    objects = tq._objects(t.spark, t.folder, "guideline_files")
    nodes = flat_table(objects, "@graph", {"id": "@id", "type": "@type", "name": "name"}).select(F.col("key").cast("long").alias("file_id"), "child_path", "id", "type", F.lower(F.trim("name")).alias("name"))
    rules = flat_table(objects, "rules", {"predicate": "predicate", "target": "target", "citation_type": "citation_type"}).select(F.col("key").cast("long").alias("file_id"), "child_path", F.col("parent_path"), "predicate", "target", "citation_type")
    nodes, rules = nodes.distinct(), rules.distinct()
    linked = rules.join(nodes.select("file_id", F.col("child_path").alias("parent_path"), F.col("id").alias("source")), ["file_id", "parent_path"])
    return nodes.drop("child_path"), linked.select("file_id", "source", "predicate", "target", "citation_type")


@query("src04_graph_edges", f"WITH {_NODES} SELECT file_id, source, predicate, target FROM rule")
def _(t: Loader):
    return _graph(t)[1].select("file_id", "source", "predicate", "target")


@query("src09_graph_match", f"WITH {_NODES} SELECT a.type AS source_type, predicate, b.type AS target_type, count(*) AS n FROM rule JOIN node a ON a.file_id = rule.file_id AND a.id = source LEFT JOIN node b ON b.file_id = rule.file_id AND b.id = target GROUP BY ALL")
def _(t: Loader):
    nodes, rules = _graph(t)
    a = nodes.select("file_id", F.col("id").alias("source"), F.col("type").alias("source_type"))
    b = nodes.select("file_id", F.col("id").alias("target"), F.col("type").alias("target_type"))
    return rules.join(a, ["file_id", "source"]).join(b, ["file_id", "target"], "left").groupBy("source_type", "predicate", "target_type").agg(F.count("*").alias("n"))


@query("kg01_rules_touching", f"WITH {_NODES} SELECT id, 'out' AS direction, count(*) AS n FROM (SELECT source AS id FROM rule) GROUP BY 1 UNION ALL SELECT id, 'in', count(*) FROM (SELECT target AS id FROM rule WHERE target IS NOT NULL) GROUP BY 1")
def _(t: Loader):
    rules = _graph(t)[1]
    both = rules.select(F.col("source").alias("id"), F.lit("out").alias("direction")).unionByName(rules.where("target IS NOT NULL").select(F.col("target").alias("id"), F.lit("in").alias("direction")))
    return both.groupBy("id", "direction").agg(F.count("*").alias("n"))


@query("kg02_vocabulary_context", "SELECT c.concept_id, c.concept_name, count(s.concept_synonym_name) AS n_synonyms, min(s.concept_synonym_name) AS first_synonym FROM concept c LEFT JOIN concept_synonym s USING (concept_id) GROUP BY 1, 2")
def _(t: Loader):
    s = t.concept_synonym.groupBy("concept_id").agg(F.count("concept_synonym_name").alias("n"), F.min("concept_synonym_name").alias("first_synonym"))
    return t.concept.join(s, "concept_id", "left").select("concept_id", "concept_name", F.coalesce("n", F.lit(0)).alias("n_synonyms"), "first_synonym")


@query("kg05_name_channel", f"WITH {_NODES}, p AS (SELECT DISTINCT lower(trim(expanded_text)) AS name FROM normalized_entities) SELECT p.name, count(*) AS n_rules FROM p JOIN node USING (name) JOIN rule ON rule.file_id = node.file_id AND rule.source = node.id GROUP BY 1")
def _(t: Loader):
    nodes, rules = _graph(t)
    p = t.normalized_entities.select(F.lower(F.trim("expanded_text")).alias("name")).distinct()
    hit = p.join(nodes, "name").select("name", "file_id", F.col("id").alias("source"))
    return hit.join(rules, ["file_id", "source"]).groupBy("name").agg(F.count("*").alias("n_rules"))


@query("kg08_evidence_text", f"WITH {_NODES}, r AS (SELECT source, predicate, target, row_number() OVER (PARTITION BY source ORDER BY predicate, target) AS rn FROM (SELECT DISTINCT source, predicate, target FROM rule WHERE predicate IS NOT NULL AND target IS NOT NULL)) SELECT source, string_agg(predicate || ' ' || target, '; ' ORDER BY rn) AS evidence FROM r WHERE rn <= 3 GROUP BY 1")
def _(t: Loader):
    rules = _graph(t)[1].where("predicate IS NOT NULL AND target IS NOT NULL").select("source", "predicate", "target").distinct()
    r = top_k(rules, ["source"], [F.col("predicate"), F.col("target")], 3)
    joined = F.transform(F.array_sort(F.collect_list(F.struct("rn", "predicate", "target"))), lambda x: F.concat_ws(" ", x["predicate"], x["target"]))
    return r.groupBy("source").agg(F.array_join(joined, "; ").alias("evidence"))


@query("kg09_graph_cleaning", f"WITH {_NODES} SELECT predicate, count(*) AS n, count_if(source = target) AS self_loops, count_if(target NOT IN (SELECT id FROM node WHERE id IS NOT NULL)) AS dangling FROM (SELECT DISTINCT file_id, source, predicate, target FROM rule WHERE target IS NOT NULL) GROUP BY 1")
def _(t: Loader):
    nodes, rules = _graph(t)
    known = nodes.where("id IS NOT NULL").select(F.col("id").alias("target"), F.lit(True).alias("known")).distinct()
    r = rules.where("target IS NOT NULL").select("file_id", "source", "predicate", "target").distinct().join(known, "target", "left")
    return r.groupBy("predicate").agg(F.count("*").alias("n"), F.count_if(F.col("source") == F.col("target")).alias("self_loops"), F.count_if(F.col("known").isNull()).alias("dangling"))


@query("kg11_vocabulary_ids", f"WITH {_NODES}, a AS (SELECT source AS x FROM rule UNION SELECT target FROM rule WHERE target IS NOT NULL) SELECT x AS entity, row_number() OVER (ORDER BY x) AS id FROM a WHERE x IS NOT NULL")
def _(t: Loader):
    from tessel.operators.metrics import global_rank

    rules = _graph(t)[1]
    a = rules.select(F.col("source").alias("entity")).union(rules.select("target")).where("entity IS NOT NULL").distinct()
    return global_rank(a, ["entity"]).select("entity", F.col("rank").alias("id"))


@query("kg12_vector_tiebreak", "WITH v AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) u(i)), c AS (SELECT label, i, avg(x) AS m FROM v GROUP BY 1, 2), d AS (SELECT label, vec_id, sqrt(sum(pow(x - m, 2))) AS d FROM v JOIN c USING (label, i) GROUP BY 1, 2) SELECT label, arg_min(vec_id, (round(d, 9), vec_id)) AS vec_id FROM d GROUP BY 1")
def _(t: Loader):
    v = t.embeddings.where("embedding IS NOT NULL").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    means = v.select("label", F.posexplode("x").alias("i", "value")).groupBy("label", "i").agg(F.avg("value").alias("m"))
    c = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
    squares = F.zip_with("x", "m", lambda a, b: F.pow(a - b, 2))
    d = v.join(c, "label").withColumn("d", F.round(F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, q: s + q)), 9)).where("d IS NOT NULL")
    return d.groupBy("label").agg(F.min_by("vec_id", F.struct("d", "vec_id")).alias("vec_id"))


@query("js04_relation_fan_in", f"WITH {_NODES} SELECT id, len(list(DISTINCT other)) AS n_others FROM (SELECT source AS id, target AS other FROM rule WHERE target IS NOT NULL UNION ALL SELECT target, source FROM rule WHERE target IS NOT NULL) GROUP BY 1")
def _(t: Loader):
    r = _graph(t)[1].where("target IS NOT NULL")
    both = r.select(F.col("source").alias("id"), F.col("target").alias("other")).union(r.select("target", "source"))
    return both.groupBy("id").agg(F.countDistinct("other").alias("n_others"))


QUERIES, ORACLES = query.queries, query.oracles

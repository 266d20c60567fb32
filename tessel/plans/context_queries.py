"""Queries of what stands around mentions, of cascades over names, and of citations."""

from pyspark.sql import functions as F

from tessel.operators import context as cx
from tessel.operators import guideline as gl
from tessel.operators import linking as lk
from tessel.operators import text as tx
from tessel.operators.nested import flat_table
from tessel.plans import guideline_queries as gq
from tessel.plans import training_queries as tq
from tessel.plans.registry import Loader, Registry
from tessel.plans.text_queries import TERMS, mentions_sql

query = Registry()


@query("tx09_local_context")
def _(t: Loader):
    return cx.local_contexts(t.documents, "doc_id", "text", ["acute", "chronic"])


GUARDED = [cx.Guarded("mg", "Dose", before=r"[0-9]\s*"), cx.Guarded("serum", "Lab Test", after=r"\s+\w"), cx.Guarded("acute", "Condition", before=r"(?:^|\n)[ \t]*"), cx.Guarded("daily", "Frequency")]


@query("tx13_guarded_terms", f"""WITH {mentions_sql([g.term for g in GUARDED])}, c AS (SELECT *, substr(text, greatest(start - 39, 1), least(start, 40)) AS before, substr(text, start + length(term) + 1, 40) AS after FROM m)
SELECT doc_id, start, term, CASE term WHEN 'mg' THEN 'Dose' WHEN 'serum' THEN 'Lab Test' WHEN 'acute' THEN 'Condition' ELSE 'Frequency' END AS label FROM c
WHERE CASE term WHEN 'mg' THEN regexp_matches(before, '\\d[\\s\\p{{Z}}\\x0B\\x1c-\\x1f\\x85]*$') WHEN 'serum' THEN regexp_matches(after, '^[\\s\\p{{Z}}\\x0B\\x1c-\\x1f\\x85]+[\\p{{L}}\\p{{N}}_]') WHEN 'acute' THEN regexp_matches(before, '(^|\\n)[ \\t]*$') ELSE true END""")
def _(t: Loader):
    return cx.guarded_spans(t.documents, "doc_id", "text", GUARDED).select("doc_id", "start", "term", "label")


_HEADS = ["insufficiency", "dystrophy", "syndrome", "sclerosis"]


def _sides(near, at, length):
    """The rest of a mention's own sentence on both sides."""
    before, after = F.substring(near, F.lit(1), at), F.substring(near, at + length + 1, F.length(near))
    return F.regexp_extract(before, r"([^.;!?\n]*)\z", 1), F.regexp_extract(after, r"\A([^.;!?\n]*)", 1)


@query("tx18_span_growth", f"""WITH {mentions_sql(_HEADS)}, c AS (SELECT doc_id, term, start, regexp_extract(substr(text, greatest(start - 119, 1), least(start, 120)), '([^.;!?\\n]*)$', 1) AS l, regexp_extract(substr(text, start + length(term) + 1, 120), '^([^.;!?\\n]*)', 1) AS r FROM m),
w AS (SELECT doc_id, term, start, list_filter(regexp_split_to_array(lower(l), '\\s+'), lambda x: x <> '') AS l, list_filter(regexp_split_to_array(lower(r), '\\s+'), lambda x: x <> '') AS r FROM c),
g AS (SELECT doc_id, term, start, n, 'left' AS side, array_to_string(l[len(l) - n + 1:len(l)], ' ') || ' ' || term AS grown FROM w, range(1, 6) x(n) WHERE len(l) >= n UNION ALL SELECT doc_id, term, start, n, 'right', term || ' ' || array_to_string(r[1:n], ' ') FROM w, range(1, 6) x(n) WHERE len(r) >= n),
k AS (SELECT DISTINCT array_to_string(list_filter(regexp_split_to_array(lower(concept_name), '\\s+'), lambda x: x <> ''), ' ') AS grown, concept_id AS entry FROM concept)
SELECT doc_id, start, term, arg_min(grown, (n, side, entry)) AS grown, arg_min(n, (n, side, entry)) AS n_words, arg_min(entry, (n, side, entry)) AS entry FROM g JOIN k USING (grown) GROUP BY 1, 2, 3""")
def _(t: Loader):
    m = tx.mentions(t.documents, "doc_id", "text", _HEADS, 120)
    left, right = _sides(F.col("near"), F.col("at"), F.length("term"))
    names = t.concept.select(F.col("concept_name").alias("name"), F.col("concept_id").alias("entry"))
    return cx.grow_spans(m.select("doc_id", "start", "term", F.col("term").alias("text"), left.alias("left"), right.alias("right")), names, ["doc_id", "start", "term"]).select("doc_id", "start", "term", "grown", F.col("n_words").cast("long").alias("n_words"), "entry")


@query("tx29_verdict_confidence", "SELECT DISTINCT mollm_call_id, pos, round(m.logprob_confidence, 6) AS confidence FROM (SELECT mollm_call_id, unnest(models) AS m, CAST(generate_subscripts(models, 1) - 1 AS INT) AS pos FROM mollm_tier_gate_decisions) WHERE trim(m.verdict) <> '' AND m.logprob_confidence > 0")
def _(t: Loader):
    # tokens of three characters, each as likely as the whole is sure, between quotes
    v = t.mollm_tier_gate_decisions.select("mollm_call_id", F.posexplode("models").alias("pos", "m")).where("trim(m.verdict) <> '' AND m.logprob_confidence > 0").select("mollm_call_id", "pos", "m.verdict", F.log("m.logprob_confidence").alias("lp")).distinct()
    piece = lambda i: F.struct(F.substring(F.col("verdict"), i * 3 + 1, F.lit(3)).alias("token"), F.col("lp").alias("logprob"))
    quote = F.array(F.struct(F.lit('"').alias("token"), F.col("lp").alias("logprob")))
    tokens = F.concat(quote, F.transform(F.sequence(F.lit(0), F.floor((F.length("verdict") - 1) / 3).cast("int")), piece), quote)
    return v.select("mollm_call_id", "pos", cx.spelled_confidence(tokens, F.col("verdict")).alias("confidence")).distinct()


def _rules(t: Loader):
    objects = tq._objects(t.spark, t.folder, "guideline_files")
    return flat_table(objects, "rules", {"rationale": "rationale", "citation": "citation", "citation_type": "citation_type", "excerpt": "citation_verbatim_excerpt"}).withColumnRenamed("key", "file_id")


@query("tx31_recovered_excerpts")
def _(t: Loader):
    source = F.concat_ws(" ", "rationale", "citation", "excerpt")
    return _rules(t).where("excerpt IS NOT NULL").select("file_id", "child_path", cx.recover_excerpt(F.col("excerpt"), source).alias("recovered"))


@query("tx33_header_context", f"WITH {mentions_sql(TERMS)} SELECT doc_id, term, start, regexp_matches(substr(text, start + length(term) + 1, 3), '^[ \\t]{{0,2}}:') AS is_header FROM m")
def _(t: Loader):
    m = tx.mentions(t.documents, "doc_id", "text", TERMS, 10)
    return m.select("doc_id", "term", "start", cx.is_header(F.col("near"), F.col("at"), F.length("term")).alias("is_header"))


_MINED = f"""{mentions_sql(["mg"])}, c AS (SELECT doc_id, start, substr(text, start + 3, 12) AS after, substr(text, greatest(start - 11, 1), least(start, 12)) AS before, list_transform(regexp_extract_all(substr(text, greatest(start - 59, 1), least(start, 60)), '[A-Za-z]+'), lambda x: lower(x)) AS b, list_transform(regexp_extract_all(substr(text, start + 3, 60), '[A-Za-z]+'), lambda x: lower(x)) AS a FROM m),
k AS (SELECT doc_id, start, b[greatest(len(b) - 2, 1):len(b)] AS b, a[1:3] AS a, CASE WHEN regexp_matches(after, '^\\s*[<>=\\-]\\s*-?\\d') THEN 'lab_value' WHEN regexp_matches(after, '^\\s*\\d') OR regexp_matches(before, '\\d\\s*$') THEN 'unit_value' ELSE 'word' END AS meaning FROM c),
w AS (SELECT doc_id, start, 'pre' AS g, unnest(list_distinct(b)) AS w, meaning AS m FROM k UNION ALL SELECT doc_id, start, 'post', unnest(list_distinct(a)), meaning FROM k), cnt AS (SELECT g, w, m, count(*) AS n FROM w GROUP BY ALL), wa AS (SELECT g, w, sum(n) AS wn FROM cnt GROUP BY ALL), mb AS (SELECT g, m, sum(n) AS mn FROM cnt GROUP BY ALL), tt AS (SELECT g, sum(n) AS tn FROM cnt GROUP BY ALL),
rules AS (SELECT g, w, m, round(ln(((n + 1) / (mn + 2)) / ((wn - n + 1) / (tn - mn + 2))), 6) AS score FROM cnt JOIN wa USING (g, w) JOIN mb USING (g, m) JOIN tt USING (g) WHERE n >= 2 AND round(ln(((n + 1) / (mn + 2)) / ((wn - n + 1) / (tn - mn + 2))), 6) > 0)"""


@query("rk10_context_rules", f"WITH {_MINED}, sc AS (SELECT doc_id, start, r.m AS meaning, round(sum(score), 9) AS score FROM w JOIN rules r USING (g, w) GROUP BY ALL), top AS (SELECT *, rank() OVER (PARTITION BY doc_id, start ORDER BY score DESC) AS rk FROM sc) SELECT doc_id, start, min(meaning) AS meaning, round(min(score), 6) AS score FROM top WHERE rk = 1 GROUP BY 1, 2 HAVING count(*) = 1")
def _(t: Loader):
    m = tx.mentions(t.documents, "doc_id", "text", ["mg"], 60)
    w = tx.context_words(F.col("near"), F.col("at"), F.col("at") + 2)
    k = m.select("doc_id", "start", w["before"].alias("before"), w["after"].alias("after"), F.coalesce(tx.numeric_context(F.col("near"), F.col("at"), F.col("at") + 2), F.lit("word")).alias("meaning"))
    side = lambda c, p: k.select(F.lit(p).alias("g"), F.explode(F.array_distinct(c)).alias("w"), "meaning")
    rules = tx.log_odds(side("before", "pre").unionByName(side("after", "post")), "g", "w", "meaning")
    rules = rules.select(F.lit("mg").alias("abbreviation"), "meaning", F.col("w").alias("trigger_word"), F.col("g").alias("position"), F.col("log_odds").alias("score"))
    won = lk.context_rule_winner(k.select(F.struct("doc_id", "start").alias("id"), F.lit("mg").alias("abbreviation"), "before", "after"), rules, "id")
    return won.select("id.doc_id", "id.start", "meaning", F.round("score", 6).alias("score"))


@query("rk11_cache_lookup", """WITH h AS (SELECT lower(original_text) AS abbreviation, coalesce(section_name, 'General') AS context, expanded_text AS expansion, count(*) AS n FROM extracted_entities WHERE original_text IS NOT NULL AND expanded_text IS NOT NULL GROUP BY ALL), best AS (SELECT *, row_number() OVER (PARTITION BY abbreviation, context ORDER BY n DESC, expansion) AS rn FROM h WHERE n >= 2),
legal AS (SELECT DISTINCT lower(original_text) AS abbreviation, expanded_text AS expansion FROM normalized_entities WHERE matched) SELECT abbreviation, context, expansion, n FROM best JOIN legal USING (abbreviation, expansion) WHERE rn = 1""")
def _(t: Loader):
    log = t.extracted_entities.where("original_text IS NOT NULL AND expanded_text IS NOT NULL")
    cache = log.groupBy(F.lower("original_text").alias("abbreviation"), F.coalesce("section_name", F.lit("General")).alias("context"), F.col("expanded_text").alias("expansion")).agg(F.count("*").alias("n"))
    best = lk.top_k(cache.where("n >= 2"), ["abbreviation", "context"], [F.desc("n"), F.col("expansion")], 1).drop("rn")
    legal = t.normalized_entities.where("matched").select(F.lower("original_text").alias("abbreviation"), F.col("expanded_text").alias("expansion")).distinct()
    return best.join(legal, ["abbreviation", "expansion"]).select("abbreviation", "context", "expansion", "n")


@query("kg10_node_grounding", f"""WITH {gq._GRAPH}, p AS (SELECT DISTINCT regexp_replace(name, '\\s+', ' ', 'g') AS text FROM nd WHERE name <> ''), a AS (SELECT text, min(concept_id) AS id FROM p JOIN concept ON lower(concept_name) = text WHERE standard_concept = 'S' GROUP BY 1), s AS (SELECT text, min(concept_id) AS id FROM p JOIN concept_synonym ON lower(concept_synonym_name) = text WHERE text NOT IN (SELECT text FROM a) GROUP BY 1),
fz AS (SELECT text, arg_min(concept_id, (d, concept_id)) AS id FROM (SELECT text, concept_id, levenshtein(text, lower(concept_name)) AS d FROM p JOIN concept ON abs(length(text) - length(concept_name)) <= 2 WHERE length(text) >= 5) WHERE d <= 2 AND text NOT IN (SELECT text FROM a UNION SELECT text FROM s) GROUP BY 1)
SELECT text AS name, id AS concept_id, 'auto_accept' AS status FROM a UNION ALL SELECT text, id, 'auto_accept' FROM s UNION ALL SELECT text, id, 'needs_review' FROM fz UNION ALL SELECT text, NULL, 'no_match' FROM p WHERE text NOT IN (SELECT text FROM a UNION SELECT text FROM s UNION SELECT text FROM fz)""")
def _(t: Loader):
    names = gq._graph(t)[0].select(lk.name_key("name").alias("text")).where("text <> ''").distinct()
    first = lambda df: df.where("rn = 1").select("text", F.col("concept_id").alias("entry_id"))
    tiers = [
        ("exact", lambda p: first(lk.exact_link(p, t.concept.where("standard_concept = 'S'"), "text", "concept_name", "concept_id", 1))),
        ("synonym", lambda p: first(lk.exact_link(p, t.concept_synonym, "text", "concept_synonym_name", "concept_id", 1))),
        ("fuzzy", lambda p: first(lk.fuzzy_link(p, t.concept, "text", "concept_name", "concept_id", k=1))),
    ]
    status = F.when(F.col("tier").isin("exact", "synonym"), "auto_accept").when(F.col("tier") == "fuzzy", "needs_review").otherwise("no_match")
    return lk.cascade(names, tiers, "text").select(F.col("text").alias("name"), F.col("entry_id").alias("concept_id"), status.alias("status"))


@query("dc01_cascade_semantic")
def _(t: Loader):
    """The cascade with a semantic tier; hashed character trigrams stand in for the encoder."""
    vocabulary = t.concept.where("invalid_reason IS NULL").select("concept_id", lk.name_key("concept_name").alias("text"))
    first = lambda df: df.where("rn = 1").select("text", F.col("concept_id").alias("entry_id"))
    tiers = [
        ("exact", lambda p: first(lk.exact_link(p, vocabulary.withColumnRenamed("text", "name"), "text", "name", "concept_id", 1))),
        ("synonym", lambda p: first(lk.exact_link(p, t.concept_synonym, "text", "concept_synonym_name", "concept_id", 1))),
        ("semantic", lambda p: lk.semantic_link(p, vocabulary, "text", "concept_id", lk.hashed_trigrams)),
        ("fuzzy", lambda p: first(lk.fuzzy_link(p, vocabulary, "text", "text", "concept_id", k=1))),
    ]
    probes = t.normalized_entities.select(lk.name_key("expanded_text").alias("text")).where("text <> ''").distinct()
    return lk.cascade(probes, tiers, "text")


_DOMAIN = "(VALUES ('Condition', 'Condition'), ('Medication', 'Drug'), ('Lab Test', 'Measurement'), ('Procedure', 'Procedure'), ('Observation', 'Observation')) d(label, expected)"


@query("dc02_domain_conflict", f"""WITH p AS (SELECT DISTINCT lower(trim(regexp_replace(expanded_text, '\\s+', ' ', 'g'))) AS text, gliner_label AS label FROM normalized_entities), m AS (SELECT text, label, expected, concept_id, domain_id FROM p JOIN {_DOMAIN} USING (label) JOIN concept ON lower(concept_name) = text WHERE invalid_reason IS NULL)
SELECT text, label, expected, min(concept_id) AS concept_id, string_agg(DISTINCT domain_id, '|' ORDER BY domain_id) AS found FROM m GROUP BY 1, 2, 3 HAVING NOT bool_or(domain_id = expected)""")
def _(t: Loader):
    allowed = {"Condition": "Condition", "Medication": "Drug", "Lab Test": "Measurement", "Procedure": "Procedure", "Observation": "Observation"}
    expected = F.create_map(*(F.lit(x) for kv in allowed.items() for x in kv))[F.col("label")]
    p = t.normalized_entities.select(lk.name_key("expanded_text").alias("text"), F.col("gliner_label").alias("label")).distinct().withColumn("expected", expected).where("expected IS NOT NULL")
    c = t.concept.where("invalid_reason IS NULL").select("concept_id", "domain_id", lk.name_key("concept_name").alias("text"))
    return lk.domain_conflicts(p, c)


@query("dc06_citation_checks")
def _(t: Loader):
    rules = _rules(t).withColumn("decision", F.concat_ws(":", "file_id", F.coalesce("parent_path", F.lit("")))).withColumn("rule_id", F.col("child_path"))
    cited = rules.select("decision", "rule_id", F.coalesce("excerpt", "citation", F.lit("")).alias("quote"))
    shown = rules.select("decision", "rule_id", "citation_type", F.concat_ws(" ", "rationale", "citation").alias("source"))
    checked = cx.verify_citations(cited, shown, "decision", tx.containment(F.col("quote"), F.col("source")))
    return checked.select("decision", "n", "verified", F.array_join("reasons", "|").alias("reasons"))


@query("dc07_reasoning_mismatch")
def _(t: Loader):
    votes = flat_table(tq._objects(t.spark, t.folder, "mollm_decisions"), "models", {"verdict": "verdict", "reasoning": "reasoning"}).select(F.col("key").alias("mollm_call_id"), F.col("ordinal").alias("pos"), F.regexp_extract("verdict", r"(\d+)\s*$", 1).alias("d"), F.lower("reasoning").alias("reasoning")).where("d <> '' AND reasoning IS NOT NULL").distinct()
    names = t.normalized_entities.select(F.lower(F.trim("entity_id")).alias("k"), F.posexplode("candidates").alias("c", "x")).select("k", (F.col("c") + 1).alias("candidate"), F.lower("x.concept_name").alias("name")).distinct()
    calls = t.mollm_decisions.select("mollm_call_id", F.lower(F.trim("entity_id")).alias("k")).distinct()
    met = votes.join(calls, "mollm_call_id").join(names, "k").select("mollm_call_id", "pos", F.col("d").cast("int").alias("chosen"), "candidate", "name", "reasoning")
    pairs = met.where("name IS NOT NULL").select("name", "reasoning").distinct().withColumn("share", tx.containment(F.col("name"), F.col("reasoning")))
    shares = met.join(pairs, ["name", "reasoning"], "left").fillna(0.0, ["share"]).groupBy("mollm_call_id", "pos", "chosen", "candidate").agg(F.max("share").alias("share"))
    return cx.verdict_mismatch(shares, ["mollm_call_id", "pos"], "chosen")


@query("dc08_more_rules", f"{gq._WITH}, {gq._A}, {gq._B}, {gq._D}, {gq._POOL.replace('rank <= 5', 'rank <= 15')} SELECT probe, count(*) AS n_rules, count_if(rank > 5) AS n_more FROM capped WHERE n > 1 OR coalesce(citation_type IN ({', '.join(repr(c) for c in gl.CITABLE)}), false) GROUP BY 1")
def _(t: Loader):
    return gq.ranked(t, 15).groupBy("probe").agg(F.count("*").alias("n_rules"), F.count_if(F.col("rank") > 5).alias("n_more"))


@query("dc21_read_verdicts", """WITH n AS (SELECT lower(trim(entity_id)) AS k, list_transform(candidates, lambda c: lower(trim(coalesce(c.concept_name, '')))) AS names FROM normalized_entities WHERE entity_id IS NOT NULL AND len(candidates) > 0), o AS (SELECT k, min(names) AS names FROM n GROUP BY 1), v AS (SELECT DISTINCT g.mollm_call_id, lower(trim(m.verdict)) AS said, o.names FROM (SELECT mollm_call_id, lower(trim(entity_id)) AS k, unnest(models) AS m FROM mollm_tier_gate_decisions) g JOIN o USING (k) WHERE m.verdict IS NOT NULL),
r AS (SELECT *, TRY_CAST(nullif(regexp_extract(said, '(^|[^0-9])([1-9])([^0-9]|$)', 2), '') AS INT) AS d, CAST(list_position(names, said) AS INT) AS e FROM v) SELECT mollm_call_id, said, CASE WHEN regexp_matches(said, '^(none|no match)($|[^a-z0-9_])') THEN 0 WHEN e > 0 THEN e WHEN d <= len(names) THEN d END AS candidate FROM r""")
def _(t: Loader):
    names = F.transform("candidates", lambda c: F.coalesce(F.lower(F.trim(c["concept_name"])), F.lit("")))
    n = t.normalized_entities.where("entity_id IS NOT NULL AND size(candidates) > 0").groupBy(F.lower(F.trim("entity_id")).alias("k")).agg(F.min(names).alias("names"))
    v = t.mollm_tier_gate_decisions.select("mollm_call_id", F.lower(F.trim("entity_id")).alias("k"), F.explode("models").alias("m")).where("m.verdict IS NOT NULL").select("mollm_call_id", "k", F.lower(F.trim("m.verdict")).alias("said"))
    return v.join(n, "k").select("mollm_call_id", "said", "names").distinct().select("mollm_call_id", "said", cx.read_verdict(F.col("said"), F.col("names")).alias("candidate"))


QUERIES, ORACLES = query.queries, query.oracles

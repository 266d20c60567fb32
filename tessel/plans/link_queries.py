"""Queries of span joins, linking, ranking and graph walks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessel.operators import linking as lk
from tessel.operators import spans as sp
from tessel.plans import vocabulary
from tessel.plans.registry import Loader, Registry

query = Registry()
_SPANS = "SELECT DISTINCT note_id, entity_id, entity_label, {0}_start AS s, {0}_end AS e, confidence FROM extracted_entities WHERE note_id IS NOT NULL AND {0}_start < {0}_end"
# two sets of spans that overlap: mentions at their places in the original and in the expanded text
_A = f"a AS ({_SPANS.format('orig')}), b AS ({_SPANS.format('exp')})"


def _spans(t: Loader, at: str, where: str = "true"):
    rows = t.extracted_entities.where(f"note_id IS NOT NULL AND {at}_start < {at}_end AND {where}")
    return rows.select("note_id", "entity_id", "entity_label", F.col(f"{at}_start").alias("start"), F.col(f"{at}_end").alias("end"), "confidence").distinct()


def _probes(t: Loader):
    return t.normalized_entities.select(lk.name_key("expanded_text").alias("text")).where("text <> ''").distinct()


@query("jn07_interval_overlap", f"WITH {_A} SELECT DISTINCT a.entity_id AS a_id, b.entity_id AS b_id FROM a JOIN b ON a.note_id = b.note_id AND a.s < b.e AND a.e > b.s")
def _(t: Loader):
    met = sp.overlap_join(_spans(t, "orig"), _spans(t, "exp"), "note_id")
    return met.select(F.col("entity_id").alias("a_id"), F.col("b_entity_id").alias("b_id")).distinct()


@query("jn08_best_overlap", f"""WITH {_A}, p AS (SELECT a.entity_id AS a_id, b.entity_id AS b_id, (least(a.e, b.e) - greatest(a.s, b.s)) / greatest(1, least(a.e - a.s, b.e - b.s)) AS r FROM a JOIN b ON a.note_id = b.note_id AND a.s < b.e AND a.e > b.s)
SELECT a_id, b_id, round(r, 4) AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY r DESC, b_id) AS rn FROM p) WHERE rn = 1 AND r >= 0.5""")
def _(t: Loader):
    a = _spans(t, "orig").withColumnRenamed("entity_id", "a_id")
    b = _spans(t, "exp").withColumnRenamed("entity_id", "b_id")
    return sp.best_overlap(a, b, "note_id", "a_id", "b_id")


@query("jn09_containing_section", """WITH s AS (SELECT DISTINCT note_id, section_name, orig_start AS s, orig_end AS e FROM extracted_entities WHERE section_name IS NOT NULL AND note_id IS NOT NULL AND orig_start < orig_end), p AS (SELECT DISTINCT note_id, exp_start FROM extracted_entities WHERE note_id IS NOT NULL AND exp_start IS NOT NULL)
SELECT p.note_id, p.exp_start, max(s.s) AS section_start FROM p LEFT JOIN s ON p.note_id = s.note_id AND p.exp_start >= s.s AND p.exp_start < s.e GROUP BY ALL""")
def _(t: Loader):
    e = t.extracted_entities.where("note_id IS NOT NULL")
    spans = e.where("section_name IS NOT NULL AND orig_start < orig_end").select("note_id", F.col("orig_start").alias("start"), F.col("orig_end").alias("end")).distinct().withColumn("section_start", F.col("start"))
    return sp.containing(e.where("exp_start IS NOT NULL").select("note_id", "exp_start").distinct(), spans, "note_id", "exp_start", "section_start")


_ISLANDS = """, m{x} AS (SELECT *, max(e) OVER (PARTITION BY note_id, entity_label ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM (SELECT DISTINCT note_id, entity_label, s, e FROM {x})), n{x} AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p THEN 1 ELSE 0 END) OVER (PARTITION BY note_id, entity_label ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM m{x}),
i{x} AS (SELECT note_id, entity_label, i, min(s) AS s, max(e) AS e FROM n{x} WHERE entity_label IS NOT NULL GROUP BY ALL)"""
_IOU = f"WITH {_A}" + _ISLANDS.format(x="a") + _ISLANDS.format(x="b") + """, ca AS (SELECT entity_label, sum(e - s) AS a FROM ia GROUP BY 1), cb AS (SELECT entity_label, sum(e - s) AS b FROM ib GROUP BY 1),
ci AS (SELECT ia.entity_label, sum(least(ia.e, ib.e) - greatest(ia.s, ib.s)) AS i FROM ia JOIN ib ON ia.note_id = ib.note_id AND ia.entity_label = ib.entity_label AND ia.s < ib.e AND ia.e > ib.s GROUP BY 1),
r AS (SELECT entity_label, CAST(coalesce(i, 0) AS BIGINT) AS shared, CAST(coalesce(a, 0) + coalesce(b, 0) - coalesce(i, 0) AS BIGINT) AS "either", round(coalesce(i, 0) / (coalesce(a, 0) + coalesce(b, 0) - coalesce(i, 0)), 6) AS iou, CAST(coalesce(a, 0) AS BIGINT) AS a_chars FROM ca FULL JOIN cb USING (entity_label) LEFT JOIN ci USING (entity_label))"""


def _iou(t: Loader):
    return sp.iou_by_class(_spans(t, "orig", "entity_label IS NOT NULL"), _spans(t, "exp", "entity_label IS NOT NULL"), "note_id", "entity_label")


@query("ag11_char_iou", _IOU + " SELECT * FROM r")
def _(t: Loader):
    return _iou(t)


@query("ag12_merged_iou_means", _IOU + " SELECT round(avg(iou), 6) AS macro, round(sum(iou * a_chars) / sum(a_chars), 6) AS weighted, count(*) AS n_classes FROM r")
def _(t: Loader):
    return sp.mean_iou(_iou(t))


@query("ag18_missed_spans", f"WITH {_A} SELECT DISTINCT entity_id, s AS start, e AS \"end\" FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.note_id = b.note_id AND a.s < b.e AND a.e > b.s)")
def _(t: Loader):
    gold, found = _spans(t, "orig"), _spans(t, "exp")
    met = sp.overlap_join(gold, found, "note_id").select("entity_id", "start", "end").distinct()
    return gold.select("entity_id", "start", "end").distinct().join(met, ["entity_id", "start", "end"], "left_anti")


@query("ag24_compound_spans", f"WITH {_A} SELECT b.entity_id, count(DISTINCT a.entity_id) AS n FROM b JOIN a ON a.note_id = b.note_id AND a.s < b.e AND a.e > b.s GROUP BY 1 HAVING count(DISTINCT a.entity_id) >= 2")
def _(t: Loader):
    met = sp.overlap_join(_spans(t, "exp"), _spans(t, "orig"), "note_id")
    return met.groupBy("entity_id").agg(F.countDistinct("b_entity_id").alias("n")).where("n >= 2")


@query("ag01_span_recall", f"""WITH {_A}, g AS (SELECT DISTINCT note_id, s, e, entity_label FROM a WHERE entity_label IS NOT NULL), h AS (SELECT g.note_id, g.s, g.e, max((g.entity_label = b.entity_label)::INT) AS l FROM g JOIN b ON g.note_id = b.note_id AND g.s < b.e AND g.e > b.s GROUP BY ALL), u AS (SELECT DISTINCT note_id, s, e FROM g)
SELECT note_id, count(*) AS n_gold, count(l) AS covered, CAST(coalesce(sum(l), 0) AS BIGINT) AS linked FROM u LEFT JOIN h USING (note_id, s, e) GROUP BY 1""")
def _(t: Loader):
    gold = _spans(t, "orig", "entity_label IS NOT NULL").select("note_id", "start", "end", "entity_label").distinct()
    return sp.span_recall(gold, _spans(t, "exp"), "note_id", "entity_label")


_KEY = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
_PROBES = f"p AS (SELECT DISTINCT {_KEY.format('expanded_text')} AS text FROM normalized_entities WHERE trim(expanded_text) <> '')"


@query("flt01_exact_link", f"WITH {_PROBES} SELECT text, concept_id FROM (SELECT text, concept_id, row_number() OVER (PARTITION BY text ORDER BY concept_id) AS rn FROM p JOIN (SELECT DISTINCT concept_id, {_KEY.format('concept_name')} AS k FROM concept WHERE standard_concept = 'S') ON k = text) WHERE rn <= 5")
def _(t: Loader):
    return lk.exact_link(_probes(t), t.concept.where("standard_concept = 'S'"), "text", "concept_name", "concept_id").select("text", "concept_id")


@query("jn03_synonym_link", f"WITH {_PROBES} SELECT DISTINCT text, c.concept_id, c.concept_name FROM p JOIN concept_synonym s ON {_KEY.format('s.concept_synonym_name')} = text JOIN concept c USING (concept_id) WHERE c.invalid_reason IS NULL")
def _(t: Loader):
    c = t.concept.where("invalid_reason IS NULL").select("concept_id", "concept_name")
    return lk.exact_link(_probes(t), t.concept_synonym, "text", "concept_synonym_name", "concept_id", k=None).join(c, "concept_id").select("text", "concept_id", "concept_name")


@query("jn04_relationship_walk", f"""WITH {vocabulary.REL}, r AS (SELECT * FROM relationship WHERE invalid_reason IS NULL)
SELECT DISTINCT p.concept_id_1 AS start, i.concept_id_2 AS node FROM r p JOIN r q ON p.concept_id_2 = q.concept_id_1 JOIN r i ON q.concept_id_2 = i.concept_id_1 JOIN concept c ON c.concept_id = i.concept_id_2 WHERE p.relationship_id = 'Brand name of' AND q.relationship_id = 'Tradename of' AND i.relationship_id = 'RxNorm has ing' AND c.standard_concept = 'S'""")
def _(t: Loader):
    hops = ["Brand name of", "Tradename of", "RxNorm has ing"]
    out = lk.walk(t.concept.select(F.col("concept_id").alias("node")), vocabulary.edges(t, *hops), hops)
    return out.join(t.concept.where("standard_concept = 'S'").select(F.col("concept_id").alias("node")), "node", "left_semi").select("start", "node")


_UP = f"{vocabulary.REL}, e AS (SELECT concept_id_1 AS src, concept_id_2 AS dst FROM relationship WHERE relationship_id = 'Is a' AND invalid_reason IS NULL), w AS (SELECT concept_id AS start, concept_id AS node, 0 AS hops FROM concept UNION SELECT start, dst, hops + 1 FROM w JOIN e ON node = src WHERE hops < {{n}}), up AS (SELECT start, node, min(hops) AS hops FROM w GROUP BY 1, 2 HAVING min(hops) > 0)"


def _nodes(t: Loader):
    return t.concept.select(F.col("concept_id").alias("node"))


@query("jn05_ancestors", f"WITH RECURSIVE {_UP.format(n=3)} SELECT d.concept_code AS code, a.concept_code AS ancestor_code, min(hops) AS hops FROM up JOIN concept d ON start = d.concept_id JOIN concept a ON node = a.concept_id WHERE d.vocabulary_id = 'SNOMED' AND a.vocabulary_id = 'SNOMED' AND node NOT IN (SELECT min(concept_id) FROM concept GROUP BY concept_id % 7) GROUP BY 1, 2")
def _(t: Loader):
    code = t.concept.where("vocabulary_id = 'SNOMED'").select("concept_id", "concept_code")
    tops = t.concept.groupBy((F.col("concept_id") % 7).alias("k")).agg(F.min("concept_id").alias("node")).select("node")
    up = lk.ancestors(_nodes(t), vocabulary.edges(t, "Is a"), 3).join(tops, "node", "left_anti")
    up = up.join(code.select(F.col("concept_id").alias("start"), F.col("concept_code").alias("code")), "start").join(code.select(F.col("concept_id").alias("node"), F.col("concept_code").alias("ancestor_code")), "node")
    return up.groupBy("code", "ancestor_code").agg(F.min("hops").alias("hops"))


@query("jn06_path_match", f"WITH RECURSIVE {_UP.format(n=6)} SELECT start, hops, count(*) AS n FROM up GROUP BY 1, 2")
def _(t: Loader):
    return lk.ancestors(_nodes(t), vocabulary.edges(t, "Is a"), 6).groupBy("start", "hops").agg(F.count("*").alias("n"))


_XW = """x AS (SELECT c.concept_id AS id, o.concept_id AS other, o.concept_code AS code, row_number() OVER (PARTITION BY c.concept_id ORDER BY (r.relationship_id = 'RxNorm - SNOMED eq') DESC, (o.domain_id = c.domain_id) DESC, o.concept_id) AS rn FROM relationship r JOIN concept c ON c.concept_id = r.concept_id_1 JOIN concept o ON o.concept_id = r.concept_id_2 WHERE o.vocabulary_id = 'SNOMED' AND r.invalid_reason IS NULL AND r.relationship_id IN ('Mapped from', 'RxNorm - SNOMED eq', 'Value mapped from', 'Maps to')),
xw AS (SELECT concept_id, CASE WHEN vocabulary_id = 'SNOMED' THEN concept_id ELSE other END AS snomed_id, CASE WHEN vocabulary_id = 'SNOMED' THEN concept_code ELSE code END AS code FROM concept LEFT JOIN x ON id = concept_id AND rn = 1)"""


def crosswalk(t: Loader):
    """(concept_id, snomed_id, code): the concept itself or, over a valid relation, the preferred one of SNOMED."""
    rel = vocabulary.edges(t, "Mapped from", "RxNorm - SNOMED eq", "Value mapped from", "Maps to")
    c = t.concept.select("concept_id", "domain_id", "vocabulary_id", "concept_code")
    return lk.crosswalk(c, rel, "SNOMED", "RxNorm - SNOMED eq")


@query("jn11_crosswalk", f"WITH {vocabulary.REL}, {_XW} SELECT concept_id, code FROM xw")
def _(t: Loader):
    return crosswalk(t).select("concept_id", "code")


_COS = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings), s AS (SELECT p.vec_id AS probe, i.vec_id AS vec_id, round(list_dot_product(p.x, i.x) / sqrt(list_dot_product(p.x, p.x)) / sqrt(list_dot_product(i.x, i.x)), 6) AS similarity FROM v p JOIN v i ON p.vec_id <> i.vec_id {w} WHERE p.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY similarity DESC, vec_id) AS rn FROM s)"


def _near(t: Loader, k: int, among: str | None = None):
    e = t.embeddings.withColumn("probe", F.col("vec_id"))
    return lk.nearest(e.where("vec_id % 20 = 0"), e, "probe", "vec_id", "embedding", k, among=among)


@query("jn12_semantic_top5", "WITH " + _COS.format(w="") + " SELECT probe, vec_id, similarity FROM r WHERE rn <= 5")
def _(t: Loader):
    return _near(t, 5).select("probe", "vec_id", "similarity")


@query("tx30_cosine_same_label", "WITH " + _COS.format(w="AND p.label = i.label") + " SELECT probe, vec_id, similarity FROM r WHERE rn = 1")
def _(t: Loader):
    return _near(t, 1, among="label").select("probe", "vec_id", "similarity")


@query("jn13_fuzzy_link", f"""WITH {_PROBES}, m AS (SELECT text, concept_id, min(levenshtein(text, lower(concept_name))) AS distance, length(text) AS l FROM p JOIN concept ON abs(length(text) - length(concept_name)) <= 2 WHERE length(text) >= 5 AND levenshtein(text, lower(concept_name)) <= 2 GROUP BY ALL)
SELECT text, concept_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY distance, concept_id) AS rn FROM m) WHERE rn <= 5""")
def _(t: Loader):
    return lk.fuzzy_link(_probes(t), t.concept, "text", "concept_name", "concept_id").select("text", "concept_id", F.col("distance").cast("long").alias("distance"))


_PAIRS = "c AS (SELECT DISTINCT entity_id, x.omop_concept_id AS id FROM (SELECT entity_id, unnest(candidates) AS x FROM normalized_entities) WHERE x.omop_concept_id IS NOT NULL), pairs AS (SELECT a.id AS a, b.id AS b, count(DISTINCT a.entity_id) AS n FROM c a JOIN c b ON a.entity_id = b.entity_id AND a.id < b.id GROUP BY ALL)"


def _candidate_pairs(t: Loader):
    """(a, b, n): pairs of candidates that some mention offers together, and for how many mentions."""
    c = t.normalized_entities.select("entity_id", F.explode("candidates").alias("x")).where("x.omop_concept_id IS NOT NULL").select("entity_id", F.col("x.omop_concept_id").alias("id")).distinct()
    per = c.groupBy("entity_id").agg(F.array_sort(F.collect_set("id")).alias("ids"))  # a mention's candidates are a handful
    pairs = per.select(F.explode(F.flatten(F.transform("ids", lambda a: F.transform(F.filter("ids", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    return pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


@query("jn14_candidate_relations", f"WITH {vocabulary.REL}, {_PAIRS}, r AS (SELECT concept_id_1 AS a, concept_id_2 AS b, relationship_id AS rel FROM relationship WHERE invalid_reason IS NULL UNION SELECT concept_id_2, concept_id_1, relationship_id FROM relationship WHERE invalid_reason IS NULL) SELECT a, b, n, string_agg(DISTINCT rel, '|' ORDER BY rel) AS relations FROM pairs JOIN r USING (a, b) GROUP BY ALL")
def _(t: Loader):
    r = vocabulary.relationship(t).where("invalid_reason IS NULL")
    both = r.select(F.col("concept_id_1").alias("a"), F.col("concept_id_2").alias("b"), "relationship_id").union(r.select("concept_id_2", "concept_id_1", "relationship_id")).distinct()
    return _candidate_pairs(t).join(both, ["a", "b"]).groupBy("a", "b", "n").agg(F.array_join(F.array_sort(F.collect_set("relationship_id")), "|").alias("relations"))


@query("jn15_name_collisions", "SELECT DISTINCT a.p_partkey AS a, min(b.p_partkey) AS b FROM part a JOIN part b ON lower(a.p_name) = lower(b.p_name) AND a.p_partkey <> b.p_partkey GROUP BY 1")
def _(t: Loader):
    ranked = lk.top_k(t.part.select("p_partkey", F.lower("p_name").alias("k")), ["k"], [F.col("p_partkey")], 2)
    low = ranked.groupBy("k").agg(F.min("p_partkey").alias("first"), F.max("p_partkey").alias("second")).where("first <> second")
    return t.part.select(F.col("p_partkey").alias("a"), F.lower("p_name").alias("k")).join(low, "k").select("a", F.when(F.col("a") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("b"))


@query("jn16_nearest_ancestor", f"WITH RECURSIVE {_UP.format(n=5)} SELECT start, arg_min(node, (hops, node)) AS node, min(hops) AS hops FROM up JOIN concept ON concept_id = node WHERE standard_concept = 'S' AND start <> node GROUP BY 1")
def _(t: Loader):
    return lk.nearest_ancestor(_nodes(t), vocabulary.edges(t, "Is a"), t.concept.where("standard_concept = 'S'").select(F.col("concept_id").alias("node")), 5)


@query("jn17_token_subset", """WITH w AS (SELECT concept_id, list_filter(list_distinct(regexp_split_to_array(lower(concept_name), '\\s+')), lambda x: x <> '') AS ws FROM concept), q AS (SELECT DISTINCT lower(expanded_text) AS text, list_filter(list_distinct(regexp_split_to_array(lower(expanded_text), '\\s+')), lambda x: x <> '') AS qs FROM normalized_entities)
SELECT text, concept_id FROM q JOIN w ON list_has_all(ws, qs) AND len(qs) >= 2""")
def _(t: Loader):
    words = lambda c: F.array_remove(F.array_distinct(F.split(F.lower(c), r"\s+")), "")
    c = t.concept.select("concept_id", words("concept_name").alias("ws"))
    q = t.normalized_entities.select(F.lower("expanded_text").alias("text")).distinct().withColumn("qs", words("text")).where(F.size("qs") >= 2)
    counts = c.select(F.explode("ws").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    # a name that has all words of a mention has its rarest one, so they meet on that
    asked = q.select("text", "qs", F.explode("qs").alias("word")).join(counts, "word", "left")
    rare = asked.groupBy("text", "qs").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"))
    return rare.join(c.select("concept_id", "ws", F.explode("ws").alias("word")), "word").where(F.size(F.array_except("qs", "ws")) == 0).select("text", "concept_id").distinct()


@query("jn18_code_resolve", f"""WITH {vocabulary.REL}, m AS (SELECT concept_id_1 AS id, min(concept_id_2) AS other FROM relationship JOIN concept ON concept_id = concept_id_2 WHERE relationship_id = 'Maps to' AND relationship.invalid_reason IS NULL AND standard_concept = 'S' GROUP BY 1)
SELECT concept_code AS code, min(CASE WHEN standard_concept = 'S' THEN concept_id ELSE other END) AS concept_id, bool_or(coalesce(standard_concept, '') <> 'S') AS mapped FROM concept LEFT JOIN m ON id = concept_id WHERE vocabulary_id = 'SNOMED' GROUP BY 1""")
def _(t: Loader):
    standard = t.concept.where("standard_concept = 'S'").select(F.col("concept_id").alias("dst"))
    mapped = vocabulary.edges(t, "Maps to").join(standard, "dst").groupBy(F.col("src").alias("concept_id")).agg(F.min("dst").alias("other"))
    own = F.coalesce(F.col("standard_concept") == "S", F.lit(False))
    rows = t.concept.where("vocabulary_id = 'SNOMED'").join(mapped, "concept_id", "left")
    return rows.groupBy(F.col("concept_code").alias("code")).agg(F.min(F.when(own, F.col("concept_id")).otherwise(F.col("other"))).alias("concept_id"), F.max(~own).alias("mapped"))


@query("rk01_multi_key_rank", """SELECT entity_label, note_id, entity_id, rn FROM (SELECT DISTINCT entity_label, note_id, entity_id, row_number() OVER (PARTITION BY entity_label ORDER BY CASE assertion_status WHEN 'PRESENT' THEN 0 WHEN 'POSSIBLE' THEN 1 ELSE 90 END, confidence DESC, entity_id) AS rn FROM (SELECT entity_label, note_id, entity_id, max(confidence) AS confidence, max(assertion_status) AS assertion_status FROM extracted_entities WHERE confidence IS NOT NULL GROUP BY 1, 2, 3)) WHERE rn <= 20""")
def _(t: Loader):
    rows = t.extracted_entities.where("confidence IS NOT NULL").groupBy("entity_label", "note_id", "entity_id").agg(F.max("confidence").alias("confidence"), F.max("assertion_status").alias("s"))
    rank = F.when(F.col("s") == "PRESENT", 0).when(F.col("s") == "POSSIBLE", 1).otherwise(90)
    return lk.top_k(rows, ["entity_label"], [rank, F.desc("confidence"), F.col("entity_id")], 20).select("entity_label", "note_id", "entity_id", "rn")


_BM25 = r"""t AS (SELECT concept_id, list_filter(regexp_split_to_array(lower(concept_name), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM concept), f AS (SELECT concept_id, len(ws) AS l, unnest(ws) AS term FROM t), tf AS (SELECT concept_id, l, term, count(*) AS tf FROM f GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM t WHERE len(ws) > 0), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), q AS (SELECT DISTINCT text, unnest(list_distinct(list_filter(regexp_split_to_array(text, '[^a-z0-9]+'), lambda x: x <> ''))) AS term FROM p),
sc AS (SELECT text, concept_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2), bm AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, concept_id) AS rn FROM sc)"""


@query("rk02_bm25_top5", f"WITH {_PROBES}, {_BM25} SELECT text, concept_id, score FROM bm WHERE rn <= 5")
def _(t: Loader):
    probes = _probes(t).withColumn("q", F.col("text"))
    return lk.bm25(t.concept, probes, "concept_id", "concept_name", "text", "q", 5).select("text", "concept_id", "score")


@query("rk03_rank_fusion", f"WITH {_PROBES}, {_BM25}, ex AS (SELECT text, concept_id, row_number() OVER (PARTITION BY text ORDER BY concept_id) AS rn FROM p JOIN concept ON lower(concept_name) = text), u AS (SELECT text, concept_id, 0.6 / (60 + rn) AS s FROM bm WHERE rn <= 20 UNION ALL SELECT text, concept_id, 0.4 / (60 + rn) FROM ex WHERE rn <= 20), fu AS (SELECT text, concept_id, round(sum(s), 9) AS score FROM u GROUP BY 1, 2) SELECT text, concept_id, score FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, concept_id) AS rn FROM fu) WHERE rn <= 5")
def _(t: Loader):
    probes = _probes(t).withColumn("q", F.col("text"))
    sparse = lk.bm25(t.concept, probes, "concept_id", "concept_name", "text", "q", 20)
    exact = lk.exact_link(_probes(t), t.concept, "text", "concept_name", "concept_id", 20)
    return lk.fuse_ranks({"sparse": (sparse, 0.6), "exact": (exact, 0.4)}, "text", "concept_id", 5).select("text", "concept_id", "score")


_CAND = "c AS (SELECT DISTINCT entity_id, expanded_text, x.omop_concept_id AS id, x.similarity_score AS s, x.domain_id AS d, x.match_basis AS b FROM (SELECT entity_id, expanded_text, unnest(candidates) AS x FROM normalized_entities) WHERE x.omop_concept_id IS NOT NULL AND x.similarity_score IS NOT NULL)"


def _candidates(t: Loader):
    rows = t.normalized_entities.select("entity_id", "expanded_text", F.explode("candidates").alias("x")).where("x.omop_concept_id IS NOT NULL AND x.similarity_score IS NOT NULL")
    return rows.select("entity_id", "expanded_text", F.col("x.omop_concept_id").alias("id"), F.col("x.similarity_score").alias("s"), F.col("x.domain_id").alias("d"), F.col("x.match_basis").alias("b")).distinct()


@query("rk04_adjusted_preference", f"WITH {_CAND} SELECT entity_id, expanded_text, id, s FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, expanded_text ORDER BY round(s - CASE WHEN d = 'Observation' THEN 0.1 ELSE 0 END, 6) DESC, id, coalesce(d, ''), coalesce(b, '')) AS rn FROM c) WHERE rn = 1")
def _(t: Loader):
    adjusted = F.round(F.col("s") - F.when(F.col("d") == "Observation", 0.1).otherwise(0.0), 6)
    return lk.top_k(_candidates(t), ["entity_id", "expanded_text"], [adjusted.desc(), F.col("id"), F.coalesce("d", F.lit("")), F.coalesce("b", F.lit(""))], 1).select("entity_id", "expanded_text", "id", "s")


_POOL = "pool AS (SELECT entity_id, expanded_text, x.omop_concept_id AS id, min(x.concept_name) AS name, max(x.similarity_score) AS s, bool_or(coalesce(x.match_basis = 'exact', false)) AS curated, min(pos) AS place FROM (SELECT entity_id, expanded_text, unnest(candidates) AS x, CAST(generate_subscripts(candidates, 1) - 1 AS INT) AS pos FROM normalized_entities) WHERE x.omop_concept_id IS NOT NULL AND entity_id IS NOT NULL AND expanded_text IS NOT NULL GROUP BY 1, 2, 3)"


@query("rk05_collapse_hierarchy", f"""WITH RECURSIVE {vocabulary.REL}, {_POOL}, e AS (SELECT concept_id_1 AS x, concept_id_2 AS y FROM relationship WHERE relationship_id IN ('Is a', 'Subsumes') AND invalid_reason IS NULL),
pe AS (SELECT DISTINCT a.entity_id, a.expanded_text, a.id AS x, b.id AS y FROM pool a JOIN e ON e.x = a.id JOIN pool b ON b.id = e.y AND a.entity_id = b.entity_id AND a.expanded_text = b.expanded_text WHERE a.id <> b.id),
both_ways AS (SELECT * FROM pe UNION SELECT entity_id, expanded_text, y, x FROM pe), reach AS (SELECT entity_id, expanded_text, id AS x, id AS y FROM pool UNION SELECT r.entity_id, r.expanded_text, r.x, b.y FROM reach r JOIN both_ways b ON r.entity_id = b.entity_id AND r.expanded_text = b.expanded_text AND r.y = b.x),
comp AS (SELECT entity_id, expanded_text, x AS id, min(y) AS root FROM reach GROUP BY 1, 2, 3), m AS (SELECT pool.*, root, regexp_matches(coalesce(name, ''), '(?i)\\band\\b|&') AS compound FROM pool JOIN comp USING (entity_id, expanded_text, id)),
k AS (SELECT *, min(place) OVER (PARTITION BY entity_id, expanded_text, root, compound) AS first, row_number() OVER (PARTITION BY entity_id, expanded_text, root, compound ORDER BY curated DESC, s DESC NULLS LAST, place, id) AS rn FROM m)
SELECT entity_id, expanded_text, id, CASE WHEN compound THEN place ELSE first END AS place FROM k WHERE compound OR rn = 1""")
def _(t: Loader):
    rows = t.normalized_entities.where("entity_id IS NOT NULL AND expanded_text IS NOT NULL").select("entity_id", "expanded_text", F.posexplode("candidates").alias("pos", "x")).where("x.omop_concept_id IS NOT NULL")
    pool = rows.groupBy("entity_id", "expanded_text", F.col("x.omop_concept_id").alias("id")).agg(F.min("x.concept_name").alias("name"), F.max("x.similarity_score").alias("s"), F.max(F.coalesce(F.col("x.match_basis") == "exact", F.lit(False))).alias("curated"), F.min("pos").alias("place"))
    kept = lk.collapse_hierarchy(pool, vocabulary.edges(t, "Is a", "Subsumes"), ["entity_id", "expanded_text"], "id", "name", "s", "curated", "place")
    return kept.select("entity_id", "expanded_text", "id", "place")


@query("rk06_rank_and_cap", f"WITH {_CAND}, k AS (SELECT entity_id, id, max(s) AS s FROM c GROUP BY 1, 2) SELECT entity_id, id, s FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY s DESC, id) AS rn FROM k) WHERE rn <= 3")
def _(t: Loader):
    best = _candidates(t).groupBy("entity_id", "id").agg(F.max("s").alias("s"))
    return lk.top_k(best, ["entity_id"], [F.desc("s"), F.col("id")], 3).select("entity_id", "id", "s")


@query("rk07_promote_within_margin", f"WITH {_CAND}, m AS (SELECT entity_id, max(s) AS top, max(CASE WHEN d = 'Condition' THEN s END) AS own FROM c GROUP BY 1) SELECT entity_id, CASE WHEN own >= top - 0.03 THEN own ELSE top END AS kept, coalesce(own >= top - 0.03, false) AS promoted FROM m")
def _(t: Loader):
    m = _candidates(t).groupBy("entity_id").agg(F.max("s").alias("top"), F.max(F.when(F.col("d") == "Condition", F.col("s"))).alias("own"))
    near = F.coalesce(F.col("own") >= F.col("top") - 0.03, F.lit(False))
    return m.select("entity_id", F.when(near, F.col("own")).otherwise(F.col("top")).alias("kept"), near.alias("promoted"))


@query("rk09_priority_margin", """WITH k AS (SELECT lower(original_text) AS a, expanded_text AS x, count(*) AS n FROM extracted_entities WHERE length(original_text) <= 5 GROUP BY 1, 2), s AS (SELECT *, sum(n) OVER (PARTITION BY a) AS total, row_number() OVER (PARTITION BY a ORDER BY n DESC, x) AS rn, lead(n) OVER (PARTITION BY a ORDER BY n DESC, x) AS nxt FROM k)
SELECT a AS abbreviation, x AS expansion, n FROM s WHERE rn = 1 AND total >= 3 AND (n - coalesce(nxt, 0)) / total >= 0.2""")
def _(t: Loader):
    k = t.extracted_entities.where("length(original_text) <= 5").groupBy(F.lower("original_text").alias("abbreviation"), F.col("expanded_text").alias("expansion")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("abbreviation").orderBy(F.desc("n"), F.col("expansion").asc_nulls_last())
    s = k.withColumn("total", F.sum("n").over(Window.partitionBy("abbreviation"))).withColumn("rn", F.row_number().over(w)).withColumn("nxt", F.coalesce(F.lead("n").over(w), F.lit(0)))
    return s.where("rn = 1 AND total >= 3 AND (n - nxt) / total >= 0.2").select("abbreviation", "expansion", "n")


@query("rk12_stratified_split", """WITH c AS (SELECT note_id, count(*) AS n FROM extracted_entities WHERE note_id IS NOT NULL GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n, note_id) - 1 AS i, count(*) OVER () AS total FROM c), s AS (SELECT *, least(i * 5 // total, 4) AS stratum FROM r), h AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(note_id), note_id) AS k, count(*) OVER (PARTITION BY stratum) AS m FROM s)
SELECT note_id, stratum, CASE WHEN k <= round(m * 0.2) THEN 'test' WHEN k <= round(m * 0.2) + round(m * 0.2) THEN 'val' ELSE 'train' END AS split FROM h""")
def _(t: Loader):
    from tessel.operators.metrics import stratified_split

    return stratified_split(t.extracted_entities.where("note_id IS NOT NULL").groupBy("note_id").agg(F.count("*").alias("n")), "note_id", "n", {"test": 0.2, "val": 0.2}, "train", 5)


@query("rk13_every_nth_group", "SELECT note_id, dense_rank() OVER (ORDER BY note_id) % 4 = 0 AS validation FROM (SELECT DISTINCT note_id FROM extracted_entities WHERE note_id IS NOT NULL)")
def _(t: Loader):
    from tessel.operators.metrics import global_rank

    return global_rank(t.extracted_entities.where("note_id IS NOT NULL").select("note_id").distinct(), ["note_id"]).select("note_id", (F.col("rank") % 4 == 0).alias("validation"))


@query("rk14_seeded_shuffle", "SELECT concept_id, row_number() OVER (PARTITION BY domain_id ORDER BY md5('7:' || concept_id), concept_id) AS place FROM concept")
def _(t: Loader):
    from tessel.operators.metrics import rank_within

    order = [F.md5(F.concat(F.lit("7:"), F.col("concept_id").cast("string"))), F.col("concept_id")]
    return rank_within(t.concept.select("concept_id", "domain_id"), "domain_id", order).select("concept_id", F.col("rank").alias("place"))


@query("rk15_link_prediction_rank", "WITH " + _COS.format(w="") + ", b AS (SELECT s.probe, max(similarity) AS best FROM s JOIN v i USING (vec_id) JOIN v p ON p.vec_id = s.probe WHERE i.label = p.label GROUP BY 1), k AS (SELECT s.probe, 1 + count_if(s.similarity > b.best) AS rank FROM s JOIN b USING (probe) GROUP BY 1) SELECT count(*) AS n, round(avg(1.0 / rank), 6) AS mrr, round(avg((rank <= 10)::INT), 6) AS hits_at_10 FROM k")
def _(t: Loader):
    from tessel.operators.metrics import rank_metrics

    e = t.embeddings.withColumn("probe", F.col("vec_id"))
    probes = e.where("vec_id % 20 = 0")
    best = lk.nearest(probes, e, "probe", "vec_id", "embedding", 1, among="label").select("probe", F.col("similarity").alias("best"))
    return rank_metrics(lk.count_more_similar(probes.join(best, "probe"), e, "probe", "vec_id", "embedding", "best"), 10)


@query("dc01_cascade", f"""WITH {_PROBES}, a AS (SELECT text, min(concept_id) AS id FROM p JOIN concept ON lower(concept_name) = text WHERE invalid_reason IS NULL GROUP BY 1), s AS (SELECT text, min(concept_id) AS id FROM p JOIN concept_synonym ON lower(concept_synonym_name) = text WHERE text NOT IN (SELECT text FROM a) GROUP BY 1),
f AS (SELECT text, arg_min(concept_id, (d, concept_id)) AS id FROM (SELECT text, concept_id, levenshtein(text, lower(concept_name)) AS d FROM p JOIN concept ON abs(length(text) - length(concept_name)) <= 2 WHERE length(text) >= 5) WHERE d <= 2 AND text NOT IN (SELECT text FROM a UNION SELECT text FROM s) GROUP BY 1)
SELECT text, id AS entry_id, 'exact' AS tier FROM a UNION ALL SELECT text, id, 'synonym' FROM s UNION ALL SELECT text, id, 'fuzzy' FROM f UNION ALL SELECT text, NULL, 'none' FROM p WHERE text NOT IN (SELECT text FROM a UNION SELECT text FROM s UNION SELECT text FROM f)""")
def _(t: Loader):
    first = lambda df: df.where("rn = 1").select("text", F.col("concept_id").alias("entry_id"))
    tiers = [
        ("exact", lambda p: first(lk.exact_link(p, t.concept.where("invalid_reason IS NULL"), "text", "concept_name", "concept_id", 1))),
        ("synonym", lambda p: first(lk.exact_link(p, t.concept_synonym, "text", "concept_synonym_name", "concept_id", 1))),
        ("fuzzy", lambda p: first(lk.fuzzy_link(p, t.concept, "text", "concept_name", "concept_id", k=1))),
    ]
    return lk.cascade(_probes(t), tiers, "text")


QUERIES, ORACLES = query.queries, query.oracles

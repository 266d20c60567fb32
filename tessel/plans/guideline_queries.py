"""Queries that find rules of the guideline graph for mentions."""

from pyspark.sql import functions as F

from tessel.operators import guideline as gl
from tessel.operators import linking as lk
from tessel.operators.nested import flat_table
from tessel.plans import link_queries as lq
from tessel.plans import training_queries as tq
from tessel.plans import vocabulary
from tessel.plans.registry import Loader, Registry
from tessel.sources.tables import materialize

query = Registry()
_GRAPH = """f AS (SELECT DISTINCT file_id, payload FROM guideline_files WHERE json_valid(payload)), n AS (SELECT file_id, unnest(from_json(payload->'$."@graph"', '["JSON"]')) AS x FROM f), nd AS (SELECT DISTINCT file_id, x->>'@id' AS id, x->>'@type' AS type, lower(trim(x->>'name')) AS name, x->>'snomed' AS code FROM n WHERE json_type(x) = 'OBJECT'),
rl AS (SELECT DISTINCT file_id, source, r->>'predicate' AS predicate, r->>'target' AS target, r->>'citation_type' AS citation_type FROM (SELECT file_id, x->>'@id' AS source, unnest(CASE json_type(x->'rules') WHEN 'ARRAY' THEN from_json(x->'rules', '["JSON"]') WHEN 'OBJECT' THEN [x->'rules'] END) AS r FROM n WHERE json_type(x) = 'OBJECT') WHERE json_type(r) = 'OBJECT'),
tc AS (SELECT file_id, source AS node, 'outgoing' AS direction, predicate, target AS other, citation_type FROM rl UNION ALL SELECT file_id, target, 'incoming', predicate, source, citation_type FROM rl WHERE target IS NOT NULL)"""
_PROBES = f"""{lq._XW}, pr AS (SELECT DISTINCT lower(trim(expanded_text)) AS name, gliner_label AS label, candidates[1].omop_concept_id AS id FROM normalized_entities WHERE trim(expanded_text) <> '' AND candidates[1].omop_concept_id IS NOT NULL),
p AS (SELECT name || '|' || coalesce(label, '') || '|' || id AS probe, name, label, domain_id AS domain, CAST(snomed_id AS VARCHAR) AS code, concept_name FROM pr JOIN concept ON concept_id = id JOIN xw USING (concept_id))"""


def _graph(t: Loader):
    objects = tq._objects(t.spark, t.folder, "guideline_files")
    nodes = flat_table(objects, "@graph", {"id": "@id", "type": "@type", "name": "name", "code": "snomed"}).select(F.col("key").cast("long").alias("file_id"), "child_path", "id", "type", F.lower(F.trim("name")).alias("name"), "code")
    rules = flat_table(objects, "rules", {"predicate": "predicate", "target": "target", "citation_type": "citation_type"}).select(F.col("key").cast("long").alias("file_id"), "parent_path", "predicate", "target", "citation_type")
    linked = rules.join(nodes.select("file_id", F.col("child_path").alias("parent_path"), F.col("id").alias("source")).distinct(), ["file_id", "parent_path"])
    return nodes.drop("child_path").distinct(), linked.select("file_id", "source", "predicate", "target", "citation_type").distinct()


def _probes(t: Loader):
    pr = t.normalized_entities.select(F.lower(F.trim("expanded_text")).alias("name"), F.col("gliner_label").alias("label"), F.try_element_at("candidates", F.lit(1))["omop_concept_id"].alias("concept_id")).where("name <> '' AND concept_id IS NOT NULL").distinct()
    pr = pr.join(t.concept.select("concept_id", F.col("domain_id").alias("domain"), "concept_name"), "concept_id").join(lq.crosswalk(t).select("concept_id", F.col("snomed_id").cast("string").alias("code")), "concept_id")
    return pr.select(F.concat_ws("|", "name", F.coalesce("label", F.lit("")), F.col("concept_id").cast("string")).alias("probe"), "name", "label", "domain", "code", "concept_name")


def _up(t: Loader):
    """(code, ancestor, hops, ancestor_name) of up to three levels."""
    up = lk.ancestors(t.concept.select(F.col("concept_id").alias("node")), vocabulary.edges(t, "Is a"), 3)
    return up.join(t.concept.select(F.col("concept_id").alias("node"), F.col("concept_name").alias("ancestor_name")), "node").select(F.col("start").cast("string").alias("code"), F.col("node").cast("string").alias("ancestor"), "hops", "ancestor_name")


def _words_sql(c: str) -> str:
    stop = ", ".join(f"'{w}'" for w in gl.STOP)
    return f"list_filter(list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+')), lambda w: w NOT IN ({stop}))"


def _ratio_sql(a: str, b: str) -> str:
    x, y = _words_sql(a), _words_sql(b)
    return f"CASE WHEN least(len({x}), len({y})) > 0 THEN round(len(list_intersect({x}, {y})) / least(len({x}), len({y})), 4) ELSE 0 END"


def _opinion_sql(key: str, allowed: dict[str, list[str]]) -> str:
    cases = " ".join(f"WHEN {key} = '{k}' THEN CASE WHEN type IN ({', '.join(repr(x) for x in kinds)}) THEN 'agree' ELSE 'mismatch' END" for k, kinds in allowed.items())
    return f"CASE WHEN type IS NULL THEN 'neutral' {cases} ELSE 'neutral' END"


_COLS = "probe, file_id, node, direction, predicate, other, citation_type, channel, hops, agreement, type_status, confidence"


def _channel_sql(name: str, met: str, ratio: str, base: str, channel: str) -> str:
    """A channel over ``met``, the probes with the nodes they met and hops."""
    front = "|".join(f"(?:{p})" for p in gl.BOILERPLATE)
    return f"""{name}_r AS (SELECT *, {ratio} AS ratio, {_opinion_sql('label', gl.TYPES_OF_LABEL)} AS ol, {_opinion_sql('domain', gl.TYPES_OF_DOMAIN)} AS od FROM ({met}) WHERE NOT coalesce(regexp_matches(node_name, '(?i){front}'), false)),
{name}_s AS (SELECT *, CASE WHEN ratio >= {gl.AGREE} THEN 'agree' ELSE 'weak' END AS agreement, CASE WHEN ol = 'mismatch' AND od = 'mismatch' THEN 'both_mismatch' WHEN ol = 'mismatch' OR od = 'mismatch' THEN 'mismatch' WHEN ol = 'agree' OR od = 'agree' THEN 'agree' ELSE 'neutral' END AS type_status FROM {name}_r WHERE ratio >= {gl.REJECT}),
{name} AS (SELECT DISTINCT probe, {name}_s.file_id, {name}_s.node, direction, predicate, other, citation_type, '{channel}' AS channel, hops, agreement, type_status, round({base} * CASE agreement WHEN 'weak' THEN {gl.WEAK} ELSE 1.0 END::DOUBLE * CASE WHEN type_status LIKE '%mismatch' THEN {gl.OTHER_TYPE} ELSE 1.0 END::DOUBLE, 4) AS confidence FROM {name}_s JOIN tc ON tc.file_id = {name}_s.file_id AND tc.node = {name}_s.node)"""


_MET = "SELECT p.*, nd.file_id, nd.id AS node, nd.type, nd.name AS node_name, {hops} AS hops{more} FROM p JOIN {join}"
_A = _channel_sql("ch_a", _MET.format(hops="0", more="", join="nd ON p.code = nd.code"), f"greatest({_ratio_sql('name', 'node_name')}, {_ratio_sql('concept_name', 'node_name')})", "1.0::DOUBLE", "A")
_B = _channel_sql("ch_b", _MET.format(hops="up.hops", more=", ac.concept_name AS ancestor_name", join="up ON p.code = CAST(up.start AS VARCHAR) JOIN nd ON nd.code = CAST(up.node AS VARCHAR) JOIN concept ac ON ac.concept_id = up.node"), _ratio_sql("ancestor_name", "node_name"), f"pow({gl.DECAY}::DOUBLE, hops)", "B")
_D = _channel_sql("ch_d", _MET.format(hops="0", more="", join="nd ON p.name = nd.name"), _ratio_sql("name", "node_name"), "0.8::DOUBLE", "D")
_WITH = f"WITH RECURSIVE {lq._UP.format(n=3)}, {_PROBES}, {_GRAPH}"


@query("kg03_channel_code", f"{_WITH}, {_A} SELECT * FROM ch_a")
def _(t: Loader):
    return gl.by_code(_probes(t), *_graph(t))


@query("kg04_channel_hierarchy", f"{_WITH}, {_B} SELECT * FROM ch_b")
def _(t: Loader):
    return gl.by_hierarchy(_probes(t), *_graph(t), _up(t))


_RANK = "CASE " + " ".join(f"WHEN citation_type = '{k}' THEN {v}" for k, v in gl.CITATION_RANK.items()) + " ELSE 4 END"
_ORDER = f"confidence DESC, {_RANK}, CASE type_status WHEN 'agree' THEN 0 WHEN 'neutral' THEN 1 WHEN 'mismatch' THEN 2 ELSE 3 END, file_id, node, predicate, coalesce(other, ''), direction, channel, hops, coalesce(citation_type, '')"
_POOL = f"""ab AS (SELECT {_COLS} FROM ch_a UNION ALL SELECT {_COLS} FROM ch_b), pool AS (SELECT * FROM ab UNION ALL SELECT {_COLS} FROM ch_d WHERE probe NOT IN (SELECT probe FROM ab)),
one AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY probe, file_id, node, direction, predicate, other ORDER BY {_ORDER}) = 1), best AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY {_ORDER}) AS rank FROM one), capped AS (SELECT *, count(*) OVER (PARTITION BY probe) AS n FROM best WHERE rank <= 5)"""


def ranked(t: Loader, cap: int = 5):
    probes = materialize(_probes(t), "probes")
    nodes, rules = (materialize(df, "graph") for df in _graph(t))
    sure = gl.by_code(probes, nodes, rules).unionByName(gl.by_hierarchy(probes, nodes, rules, _up(t)))
    return gl.rank_and_cap(gl.only_if_nothing(sure, gl.by_name(probes, nodes, rules)), cap)


@query("kg07_retrieve", f"{_WITH}, {_A}, {_B}, {_D}, {_POOL} SELECT {_COLS}, rank FROM capped WHERE n > 1 OR coalesce(citation_type IN ({', '.join(repr(c) for c in gl.CITABLE)}), false)")
def _(t: Loader):
    return ranked(t)


@query("kg07_retrieval_outcomes", f"""{_WITH}, {_A}, {_B}, {_D}, {_POOL}, k AS (SELECT probe, min(channel) AS channel FROM capped WHERE n > 1 OR coalesce(citation_type IN ({', '.join(repr(c) for c in gl.CITABLE)}), false) GROUP BY 1),
s AS (SELECT entity_id, bool_or(coalesce(upper(assertion_status) = 'ABSENT', false)) AS gone FROM extracted_entities GROUP BY 1), m AS (SELECT DISTINCT entity_id, lower(trim(expanded_text)) || '|' || coalesce(gliner_label, '') || '|' || candidates[1].omop_concept_id AS probe FROM normalized_entities WHERE trim(expanded_text) <> '' AND candidates[1].omop_concept_id IS NOT NULL)
SELECT CASE WHEN gone THEN 'skipped: not asserted' WHEN channel IS NOT NULL THEN 'found by ' || channel ELSE 'nothing found' END AS outcome, count(*) AS n FROM m LEFT JOIN s USING (entity_id) LEFT JOIN k USING (probe) GROUP BY 1""")
def _(t: Loader):
    found = ranked(t).groupBy("probe").agg(F.min("channel").alias("channel"))
    state = t.extracted_entities.groupBy("entity_id").agg(F.max(F.coalesce(F.upper("assertion_status") == "ABSENT", F.lit(False))).alias("gone"))
    first = F.try_element_at("candidates", F.lit(1))["omop_concept_id"]
    name = F.lower(F.trim("expanded_text"))
    m = t.normalized_entities.where((name != "") & first.isNotNull()).select("entity_id", F.concat_ws("|", name, F.coalesce("gliner_label", F.lit("")), first.cast("string")).alias("probe")).distinct()
    outcome = F.when(F.col("gone"), "skipped: not asserted").when(F.col("channel").isNotNull(), F.concat(F.lit("found by "), F.col("channel"))).otherwise("nothing found")
    return m.join(state, "entity_id", "left").join(found, "probe", "left").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("tx25_type_agreement", f"{_WITH}, o AS (SELECT label, domain, type, {_opinion_sql('label', gl.TYPES_OF_LABEL)} AS ol, {_opinion_sql('domain', gl.TYPES_OF_DOMAIN)} AS od FROM p JOIN nd ON p.name = nd.name) SELECT label, domain, type, CASE WHEN ol = 'mismatch' AND od = 'mismatch' THEN 'both_mismatch' WHEN ol = 'mismatch' OR od = 'mismatch' THEN 'mismatch' WHEN ol = 'agree' OR od = 'agree' THEN 'agree' ELSE 'neutral' END AS status, count(*) AS n FROM o GROUP BY ALL")
def _(t: Loader):
    nodes = _graph(t)[0].select(F.col("name").alias("_n"), "type", "file_id", "id", "code")
    met = _probes(t).drop("code").join(nodes, F.col("name") == F.col("_n"))
    return met.groupBy("label", "domain", "type", gl.type_status(F.col("label"), F.col("domain"), F.col("type")).alias("status")).agg(F.count("*").alias("n"))


QUERIES, ORACLES = query.queries, query.oracles

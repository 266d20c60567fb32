"""Finding the rules of a guideline graph that bear on a mention: by code, hierarchy, name and relation.

Probes are distinct (probe, name, label, domain, code, concept_name); nodes (file_id, id, type, name,
code) and rules (file_id, source, predicate, target, citation_type) make up the graph. Every channel
gives rows (probe, file_id, node, direction, predicate, other, citation_type, channel, hops,
agreement, type_status, confidence), so they can be put together, ranked and cut.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.operators.text import token_set_ratio

# The node types a label, and a domain, may be of.
TYPES_OF_LABEL = {
    "Condition": ["Condition", "Finding", "Acuity"],
    "Symptom": ["Finding", "Condition", "Acuity"],
    "Medication": ["Medication", "Intervention"],
    "Procedure": ["Intervention", "Medication"],
    "Lab Test": ["Finding", "Quantitative Threshold"],
}
TYPES_OF_DOMAIN = {
    "Condition": ["Condition", "Finding", "Acuity"],
    "Observation": ["Finding", "Acuity", "Quantitative Threshold"],
    "Drug": ["Medication", "Intervention"],
    "Procedure": ["Intervention"],
    "Measurement": ["Finding", "Quantitative Threshold"],
}
# The order of citation types, and those that can be checked.
CITATION_RANK = {"verbatim": 0, "paraphrase_with_recovered_excerpt": 1, "paraphrase": 2, "pointer_unverifiable": 3}
CITABLE = ["verbatim", "paraphrase_with_recovered_excerpt", "paraphrase"]
# Names of nodes that are front matter.
BOILERPLATE = ("annals of emergency medicine", "american college of emergency physicians", "key words?/phrases for literature searches", "^study selection", "^clinical policy$", "literature (search|classification)")
# Words that do not count in names; agreement, its weak factor; the factor of another type; decay per level.
STOP = ["the", "a", "an", "of", "in", "on", "for", "to", "and", "or", "with", "by", "at", "is", "was", "be", "as", "from"]
AGREE, REJECT, WEAK, OTHER_TYPE, DECAY = 0.75, 0.45, 0.6, 0.85, 0.9


def is_boilerplate(name: Column) -> Column:
    return F.coalesce(name.rlike("(?i)" + "|".join(f"(?:{p})" for p in BOILERPLATE)), F.lit(False))


def _opinion(key: Column, kind: Column, allowed: dict[str, list[str]]) -> Column:
    """agree, mismatch, or neutral where nothing is expected."""
    out = F.when(kind.isNull(), "neutral")
    for k, kinds in allowed.items():
        out = out.when(key == k, F.when(kind.isin(kinds), "agree").otherwise("mismatch"))
    return out.otherwise("neutral")


def type_status(label: Column, domain: Column, kind: Column) -> Column:
    """What label and domain say of a node's type: both_mismatch, mismatch, agree or neutral."""
    a, b = _opinion(label, kind, TYPES_OF_LABEL), _opinion(domain, kind, TYPES_OF_DOMAIN)
    both = (a == "mismatch") & (b == "mismatch")
    return F.when(both, "both_mismatch").when((a == "mismatch") | (b == "mismatch"), "mismatch").when((a == "agree") | (b == "agree"), "agree").otherwise("neutral")


def _touching(rules: DataFrame) -> DataFrame:
    """Each rule from both of its ends; a rule of a node with itself comes twice."""
    out = rules.select("file_id", F.col("source").alias("node"), F.lit("outgoing").alias("direction"), "predicate", F.col("target").alias("other"), "citation_type")
    return out.unionByName(rules.where("target IS NOT NULL").select("file_id", F.col("target").alias("node"), F.lit("incoming").alias("direction"), "predicate", F.col("source").alias("other"), "citation_type"))


def _scored(met: DataFrame, rules: DataFrame, names: list[str], base: Column, channel: str) -> DataFrame:
    """Rules of the nodes that probes met: the node's name must agree with one of the probe's names."""
    ratio = F.greatest(*[token_set_ratio(F.coalesce(F.col(n), F.lit("")), F.col("node_name"), STOP) for n in names]) if len(names) > 1 else token_set_ratio(F.coalesce(F.col(names[0]), F.lit("")), F.col("node_name"), STOP)
    agreement = F.when(F.col("ratio") >= AGREE, "agree").when(F.col("ratio") >= REJECT, "weak").otherwise("reject")
    kept = met.where(~is_boilerplate(F.col("node_name"))).withColumn("ratio", ratio).withColumn("agreement", agreement).where("agreement <> 'reject'")
    kept = kept.withColumn("type_status", type_status(F.col("label"), F.col("domain"), F.col("type")))
    factor = F.when(F.col("agreement") == "weak", WEAK).otherwise(1.0) * F.when(F.col("type_status").endswith("mismatch"), OTHER_TYPE).otherwise(1.0)
    kept = kept.withColumn("confidence", F.round(base * factor, 4)).withColumn("channel", F.lit(channel))
    cols = ["probe", "file_id", "node", "direction", "predicate", "other", "citation_type", "channel", "hops", "agreement", "type_status", "confidence"]
    return kept.join(_touching(rules), ["file_id", "node"]).select(*cols).distinct()


def _nodes(nodes: DataFrame, by: str) -> DataFrame:
    return nodes.select("file_id", F.col("id").alias("node"), "type", F.col("name").alias("node_name"), F.col(by).alias(f"_{by}")).where(f"_{by} IS NOT NULL").distinct()


def by_code(probes: DataFrame, nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules of nodes that have the probe's own code."""
    met = probes.join(_nodes(nodes, "code"), F.col("code") == F.col("_code")).withColumn("hops", F.lit(0))
    return _scored(met, rules, ["name", "concept_name"], F.lit(1.0), "A")


def by_hierarchy(probes: DataFrame, nodes: DataFrame, rules: DataFrame, up: DataFrame) -> DataFrame:
    """Rules of nodes with a code above the probe's; ``up`` is (code, ancestor, hops, ancestor_name).

    The node must agree with the name of the ancestor, as it is meant to be more general than the probe.
    """
    met = probes.join(up, "code").join(_nodes(nodes, "code"), F.col("ancestor") == F.col("_code"))
    return _scored(met, rules, ["ancestor_name"], F.pow(F.lit(DECAY), F.col("hops")), "B")


def by_name(probes: DataFrame, nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules of nodes that are called exactly as the probe."""
    met = probes.join(_nodes(nodes, "name"), F.col("name") == F.col("_name")).withColumn("hops", F.lit(0))
    return _scored(met, rules, ["name"], F.lit(0.8), "D")


def by_relation(found: DataFrame, related: DataFrame, nodes: DataFrame, predicates: dict[str, list[str]]) -> DataFrame:
    """Of rules found by code, those whose other end has the code of a related mention.

    ``related`` is (probe, relation, other_code); ``predicates`` names the predicates that fit a relation.
    """
    rows = [(r, p) for r, ps in predicates.items() for p in ps]
    fits = found.sparkSession.createDataFrame(rows, "relation string, predicate string")
    ends = related.join(fits, "relation").join(_nodes(nodes, "code").select("file_id", F.col("node").alias("other"), F.col("_code").alias("other_code")), "other_code")
    return found.join(ends.select("probe", "file_id", "predicate", "other").distinct(), ["probe", "file_id", "predicate", "other"], "left_semi").withColumn("channel", F.lit("E"))


def rank_and_cap(rules: DataFrame, cap: int = 5) -> DataFrame:
    """The best ``cap`` rules of each probe with their rank; a feature of the operator, as they go to a reader.

    Of rules with the same predicate and ends the surest stays. Order: confidence, citation, type,
    then the ids. A sole rule that cannot be checked is dropped.
    """
    rank = F.lit(4)
    for name, n in CITATION_RANK.items():
        rank = F.when(F.col("citation_type") == name, n).otherwise(rank)
    kind = F.when(F.col("type_status") == "agree", 0).when(F.col("type_status") == "neutral", 1).when(F.col("type_status") == "mismatch", 2).otherwise(3)
    order = [F.desc("confidence"), rank, kind, F.col("file_id"), F.col("node"), F.col("predicate"), F.coalesce("other", F.lit("")), F.col("direction"), F.col("channel"), F.col("hops"), F.coalesce("citation_type", F.lit(""))]
    one = rules.withColumn("_k", F.row_number().over(Window.partitionBy("probe", "file_id", "node", "direction", "predicate", "other").orderBy(*order))).where("_k = 1")
    best = one.withColumn("rank", F.row_number().over(Window.partitionBy("probe").orderBy(*order))).where(F.col("rank") <= cap).drop("_k")
    n = best.groupBy("probe").agg(F.count("*").alias("_n"))
    return best.join(n, "probe").where((F.col("_n") > 1) | F.coalesce(F.col("citation_type").isin(CITABLE), F.lit(False))).drop("_n")


def only_if_nothing(first: DataFrame, second: DataFrame) -> DataFrame:
    """``first``, and of ``second`` the rows of probes that ``first`` has none for."""
    return first.unionByName(second.join(first.select("probe").distinct(), "probe", "left_anti"))


"""Relationships between the concepts of the test tables, which hold none.

They are derived by rule from the ids, the same in SQL and in Spark: an Is-a hierarchy of several
levels with a second parent for some nodes and cycles at the top, crosswalks between vocabularies, and a three-step
walk between drugs; every sixth edge is withdrawn.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.plans.registry import Loader

REL = """h AS (SELECT concept_id AS id, min(concept_id) OVER (PARTITION BY concept_id % 211) AS a, min(concept_id) OVER (PARTITION BY concept_id % 37) AS b, min(concept_id) OVER (PARTITION BY concept_id % 7) AS t, max(concept_id) OVER (PARTITION BY concept_id % 7) AS z FROM concept),
isa AS (SELECT id AS x, a AS y FROM h WHERE id <> a UNION SELECT id, b FROM h WHERE (id = a OR id % 5 = 0) AND id <> b UNION SELECT id, t FROM h WHERE id = b AND id <> t UNION SELECT id, z FROM h WHERE id = t AND id <> z),
sn AS (SELECT concept_id AS id FROM concept WHERE vocabulary_id = 'SNOMED'), ot AS (SELECT concept_id AS id FROM concept WHERE vocabulary_id <> 'SNOMED'), rx AS (SELECT concept_id AS id FROM concept WHERE vocabulary_id = 'RxNorm'),
allrel AS (SELECT x, y, 'Is a' AS rel FROM isa UNION ALL SELECT y, x, 'Subsumes' FROM isa
UNION ALL SELECT ot.id, sn.id, 'Mapped from' FROM ot JOIN sn ON ot.id % 53 = sn.id % 53 UNION ALL SELECT ot.id, sn.id, 'RxNorm - SNOMED eq' FROM ot JOIN sn ON ot.id % 311 = sn.id % 311 UNION ALL SELECT sn.id, ot.id, 'Maps to' FROM sn JOIN ot ON sn.id % 53 = ot.id % 53
UNION ALL SELECT p.id, q.id, 'Brand name of' FROM rx p JOIN rx q ON p.id % 23 = q.id % 23 WHERE p.id % 3 = 0 AND q.id % 3 = 1 UNION ALL SELECT p.id, q.id, 'Tradename of' FROM rx p JOIN rx q ON p.id % 29 = q.id % 29 WHERE p.id % 3 = 1 AND q.id % 3 = 2 UNION ALL SELECT p.id, q.id, 'RxNorm has ing' FROM rx p JOIN rx q ON p.id % 41 = q.id % 41 WHERE p.id % 3 = 2 AND p.id <> q.id),
relationship AS (SELECT x AS concept_id_1, y AS concept_id_2, rel AS relationship_id, CASE WHEN (x + y) % 6 = 0 THEN 'D' END AS invalid_reason FROM allrel)"""


def relationship(t: Loader) -> DataFrame:
    """(concept_id_1, concept_id_2, relationship_id, invalid_reason)."""
    c = t.concept.select(F.col("concept_id").alias("id"), F.col("vocabulary_id").alias("v"))
    head = lambda m, f: f("id").over(Window.partitionBy(F.col("id") % m))
    h = c.select("id", head(211, F.min).alias("a"), head(37, F.min).alias("b"), head(7, F.min).alias("t"), head(7, F.max).alias("z"))
    up = lambda to, where: h.where(where).where(f"id <> {to}").select(F.col("id").alias("x"), F.col(to).alias("y"))
    isa = up("a", "true").union(up("b", "id = a OR id % 5 = 0")).union(up("t", "id = b")).union(up("z", "id = t")).distinct()
    sn, ot, rx = (c.where(w).select("id") for w in ("v = 'SNOMED'", "v <> 'SNOMED'", "v = 'RxNorm'"))

    def cross(left: DataFrame, right: DataFrame, m: int, rel: str, where: Column | None = None) -> DataFrame:
        met = left.select(F.col("id").alias("x"), (F.col("id") % m).alias("k")).join(right.select(F.col("id").alias("y"), (F.col("id") % m).alias("k")), "k")
        return (met.where(where) if where is not None else met).select("x", "y", F.lit(rel).alias("rel"))

    third = lambda c: F.col(c) % 3
    edges = isa.withColumn("rel", F.lit("Is a")).union(isa.select("y", "x", F.lit("Subsumes")))
    for part in (
        cross(ot, sn, 53, "Mapped from"),
        cross(ot, sn, 311, "RxNorm - SNOMED eq"),
        cross(sn, ot, 53, "Maps to"),
        cross(rx, rx, 23, "Brand name of", (third("x") == 0) & (third("y") == 1)),
        cross(rx, rx, 29, "Tradename of", (third("x") == 1) & (third("y") == 2)),
        cross(rx, rx, 41, "RxNorm has ing", (third("x") == 2) & (F.col("x") != F.col("y"))),
    ):
        edges = edges.union(part)
    withdrawn = F.when((F.col("x") + F.col("y")) % 6 == 0, "D")
    return edges.select(F.col("x").alias("concept_id_1"), F.col("y").alias("concept_id_2"), F.col("rel").alias("relationship_id"), withdrawn.alias("invalid_reason"))


def edges(t: Loader, *names: str) -> DataFrame:
    """Valid edges (src, dst, rel) of the named relations."""
    rows = relationship(t).where(F.col("invalid_reason").isNull() & F.col("relationship_id").isin(*names))
    return rows.select(F.col("concept_id_1").alias("src"), F.col("concept_id_2").alias("dst"), F.col("relationship_id").alias("rel"))

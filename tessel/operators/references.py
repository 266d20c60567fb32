"""References to records that do not exist, are deleted or arrive later (problem 7)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.keys import loose


def orphan_references(
    child: DataFrame,
    parent: DataFrame,
    *,
    child_table: str,
    child_key: str,
    ref: str,
    parent_key: str,
    child_time: str,
    parent_time: str,
    deleted: Column | None = None,
) -> DataFrame:
    """Every reference of ``child`` that ``parent`` does not answer in time.

    Returns (child_table, child_key, reason, period): ``missing`` when the parent has no such key,
    else ``deleted`` when a row of the key is flagged by ``deleted``, else ``late`` when the key's
    earliest time is after the child's earliest time. ``period`` is the child's first month or null.

    Keys are compared trimmed and without case; a null or blank reference is no reference and gives
    no row, a null child key is kept as null. Repeated deliveries count once. Null times never make
    a reference late. An empty parent makes every reference missing. Other columns are not read.

    The distinct references, one row per key with the earliest time it is used, meet the parent's keys
    once. Only keys with a fault are joined back to the child's rows, so a key that holds many rows
    costs its rows only where they are faulty, and is folded before it moves.
    """
    rows = child.select(F.col(child_key).alias("child_key"), loose(ref).alias("_ref"), F.col(child_time).alias("_at")).where(F.col("_ref").isNotNull())
    keys = rows.groupBy("_ref").agg(F.min("_at").alias("_first"))
    parents = (
        parent.select(
            loose(parent_key).alias("_ref"),
            F.col(parent_time).alias("_known"),
            F.coalesce(deleted if deleted is not None else F.lit(False), F.lit(False)).alias("_deleted"),
        )
        .where(F.col("_ref").isNotNull())
        .groupBy("_ref")
        .agg(F.min("_known").alias("_known"), F.max("_deleted").alias("_deleted"))
    )
    met = keys.join(parents, "_ref", "left")
    fault = F.when(F.col("_deleted").isNull(), "missing").when(F.col("_deleted"), "deleted").when(F.col("_known") > F.col("_first"), "late")
    faulty = met.select("_ref", "_known", fault.alias("reason")).where(F.col("reason").isNotNull())
    back = rows.join(faulty, "_ref").groupBy("_ref", "child_key", "reason", "_known").agg(F.min("_at").alias("_at"))
    back = back.where((F.col("reason") != "late") | (F.col("_known") > F.col("_at")))
    return back.select(F.lit(child_table).alias("child_table"), "child_key", "reason", F.date_format("_at", "yyyy-MM").alias("period"))


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Number of orphan references per table, month and reason."""
    return orphans.groupBy("child_table", F.coalesce("period", F.lit("unknown")).alias("period"), "reason").agg(
        F.count("*").alias("n_references")
    )

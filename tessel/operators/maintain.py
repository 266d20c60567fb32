"""Keeping tables: schemas that only grow, keyed writes, conditional changes."""

import json
import os
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def additive_schema(df: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """Columns a table lacks are added with their default; columns it has are kept as they are."""
    missing = {c: F.lit(v).cast(t) for c, (t, v) in columns.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def ensure_table(spark: SparkSession, path: str, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """The table at a path, created empty if it is absent, with the columns it lacks added under their defaults.

    What is stored is not rewritten: the added columns are filled when the table is read, and
    append_rows() stores them.
    """
    schema = ", ".join(f"`{c}` {t}" for c, (t, _) in columns.items())
    try:
        have = spark.read.parquet(path)
    except AnalysisException:
        spark.createDataFrame([], schema).write.parquet(path)
        have = spark.read.parquet(path)
    whole = spark.read.option("mergeSchema", True).parquet(path)
    new = {c: F.lit(v).cast(t) for c, (t, v) in columns.items() if c not in have.columns and c not in whole.columns}
    filled = {c: F.coalesce(F.col(c), F.lit(v).cast(t)) for c, (t, v) in columns.items() if c in whole.columns and v is not None}
    return whole.withColumns(new | filled).select(*columns, *[c for c in whole.columns if c not in columns])


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_status(path: str, job: str, done: int, total: int, elapsed: float) -> dict:
    """Replace a small JSON status file in one step; the estimate needs something done and something left."""
    eta = round(elapsed * (total - done) / done) if 0 < done < total else None
    status = {"job": job, "pid": os.getpid(), "done": done, "total": total, "elapsed_s": elapsed, "eta_s": eta}
    Path(f"{path}.tmp").write_text(json.dumps(status))
    Path(f"{path}.tmp").replace(path)
    return status


def read_status(path: str) -> dict | None:
    """The status, or None where there is none or it cannot be read."""
    try:
        return json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return None


def clear_status(path: str, job: str) -> bool:
    """Remove the status if it is this process's of that job."""
    status = read_status(path)
    own = status is not None and (status.get("job"), status.get("pid")) == (job, os.getpid())
    if own:
        Path(path).unlink()
    return own


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of both tables, one per key: a new row beats an old one, among new ones the last in ``order``.

    Columns only one side has are null on the other. One window over both sides, partitioned by key.
    """
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.col("_new").desc(), *[c.desc_nulls_last() for c in order])
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Old rows, and the first new row of each key the old table does not have."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = new.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return old.unionByName(first.join(old.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def counting_upsert(log: DataFrame, keys: list[Column], hits: Column | None = None) -> DataFrame:
    """Hits per key of an append-only log; partial sums form before the shuffle."""
    return log.groupBy(*keys).agg(F.sum(hits if hits is not None else F.lit(1)).alias("hit_count"))


def update_from(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Target rows with the source's values of ``columns`` where the key is found there."""
    values = source.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    out = target.join(values, keys, "left")
    return out.withColumns({c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).drop("_hit", *[f"_{c}" for c in columns])


def rekey(rows: DataFrame, owners: DataFrame, text_key: list[str], new_key: str) -> DataFrame:
    """Rows, and for each owner without one a copy of the row that shares its text key."""
    orphan = owners.join(rows.select(new_key).distinct(), new_key, "left_anti").select(new_key, *text_key)
    first = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*text_key).orderBy(new_key))).where("_rn = 1").drop("_rn", new_key)
    return rows.unionByName(orphan.join(first, text_key).select(*rows.columns))


def merge_nodes(rows: DataFrame, key: str, first: list[str], last: list[str], order: Column) -> DataFrame:
    """One node per key: ``first`` columns from its earliest row, ``last`` columns from its latest."""
    aggs = [F.min_by(c, order).alias(c) for c in first] + [F.max_by(c, order).alias(c) for c in last]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs)


def compare_snapshots(snapshots: DataFrame, order: str, metrics: list[str]) -> DataFrame:
    """(metric, before, after, dropped) of the last two snapshots; the table of snapshots is small."""
    last = snapshots.orderBy(F.col(order).desc()).limit(2)
    long = last.select(order, F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", "value"))
    out = long.groupBy("metric").agg(F.min_by("value", order).alias("before"), F.max_by("value", order).alias("after"))
    return out.withColumn("dropped", F.col("after") < F.col("before"))


def duration_text(seconds: Column) -> Column:
    """Seconds as 1h 2m 3s, without leading zero parts."""
    s = F.floor(seconds).cast("long")
    h, m = (s / 3600).cast("long"), (s % 3600 / 60).cast("long")
    tail = F.concat((s % 60).cast("string"), F.lit("s"))
    mid = F.when((h > 0) | (m > 0), F.concat(m.cast("string"), F.lit("m "), tail)).otherwise(tail)
    return F.when(h > 0, F.concat(h.cast("string"), F.lit("h "), mid)).otherwise(mid)


def empty_as(schema: T.StructType, df: DataFrame | None, spark) -> DataFrame:
    """A table that may be absent, as an empty one of its schema."""
    return df if df is not None else spark.createDataFrame([], schema)

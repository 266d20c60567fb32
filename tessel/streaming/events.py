"""Streams: counters, duplicates, sessions and windows over unbounded tables, each with a batch twin.

Each function takes a streaming or a batch table and returns the same plan over either, so the batch
result over all rows is what the stream has said once its watermark has passed everything.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def window_counts(events: DataFrame, time: str, keys: list[str], value: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(window_start, keys..., n, total) per tumbling or sliding window; later rows than ``late`` are dropped by a stream."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = events.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """(key, started, ended, n): runs of a key's events with no pause of ``gap`` or more."""
    s = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return s.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def first_seen(events: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Rows whose key was not seen before within the watermark; a batch table keeps one row per key."""
    if events.isStreaming:
        return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def running_hits(events: DataFrame, keys: list[Column]) -> DataFrame:
    """Hits per key so far: complete or update mode on a stream, a plain count on a batch table."""
    return events.groupBy(*keys).agg(F.count("*").alias("hit_count"))


def _pointers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that are complete."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_pointers")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    done = [p for p in names if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName()) for p in done)


def _places(spark: SparkSession, path: str, number: int | None) -> dict[int, int]:
    """{part: version that holds it} as of a batch."""
    if number is None:
        return {}
    return {r["part"]: r["version"] for r in spark.read.schema("part int, version long").json(f"{path}/_pointers/{number}").collect()}


def upsert_to(path: str, keys: list[str], order: str, parts: int = 64):
    """A foreachBatch writer that keeps one row per key, the latest by ``order``.

    The table lies in ``parts`` parts by a hash of the keys. A batch rewrites only the parts it has keys
    of, under its own number, and then writes a pointer that names the version of every part; readers
    follow the last pointer. A batch that is run again starts from the pointer before it and replaces
    its own result; batch numbers may be skipped.
    """

    def write(batch: DataFrame, number: int) -> None:
        from tessel.operators.maintain import upsert

        spark = batch.sparkSession
        before = max((n for n in _pointers(spark, path) if n < number), default=None)
        places = _places(spark, path, before)
        new = batch.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
        touched = [r["part"] for r in new.select("part").distinct().collect()]
        held = [f"{path}/v{places[k]}/part={k}" for k in touched if k in places]
        old = spark.read.schema(batch.schema).parquet(*held) if held else spark.createDataFrame([], batch.schema)
        merged = upsert(old, batch, keys, [F.col(order)]).withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
        merged.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/v{number}")
        now = places | dict.fromkeys(touched, number)
        spark.createDataFrame(sorted(now.items()), "part int, version long").coalesce(1).write.mode("overwrite").json(f"{path}/_pointers/{number}")

    return write


def read_upserted(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The table of upsert_to as of its last complete batch; an empty one of ``schema`` before the first."""
    done = _pointers(spark, path)
    places = _places(spark, path, done[-1] if done else None)
    if not places:
        return spark.createDataFrame([], schema or StructType([]))
    return spark.read.parquet(*[f"{path}/v{v}/part={k}" for k, v in sorted(places.items())])


def free_upserted(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Delete the versions and pointers that the last ``keep`` pointers do not need; returns the versions deleted."""
    done = _pointers(spark, path)
    needed = {v for n in done[-keep:] for v in _places(spark, path, n).values()}
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = [n for n in done if n not in needed]
    for n in gone:
        where = jvm.org.apache.hadoop.fs.Path(f"{path}/v{n}")
        where.getFileSystem(conf).delete(where, True)
    for n in done[:-keep]:
        where = jvm.org.apache.hadoop.fs.Path(f"{path}/_pointers/{n}")
        where.getFileSystem(conf).delete(where, True)
    return gone

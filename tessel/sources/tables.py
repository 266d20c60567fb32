"""Reading and cutting lineage through storage that every executor can reach."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder; columns and filters are pruned by the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only a local session without one, as in tests, gets an own temporary one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = tempfile.mkdtemp(prefix="tessel-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, also when the same query runs twice at once; release() frees it."""
    path = f"{shared_dir(spark)}/tessel-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as parquet into the shared folder and read it back.

    The result has no lineage, is computed once, and survives the loss of any executor.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, keep: int = 0) -> None:
    """Delete all but the last ``keep`` written steps; call only when no later action needs them."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while len(_written) > keep:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop(0))
        path.getFileSystem(conf).delete(path, True)

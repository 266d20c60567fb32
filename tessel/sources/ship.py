"""Making this package importable for the Python workers of any cluster."""

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

import tessel


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_tessel_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="tessel-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    root = Path(tessel.__file__).parent.parent
    sc.addPyFile(shutil.make_archive(f"{folder}/tessel_package", "zip", root, "tessel"))
    sc._tessel_shipped = True

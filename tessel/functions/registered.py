"""Functions and table functions that SQL can call by name once they are registered in a session."""

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tessel.operators.text import HEADER


@udtf(returnType="name string, header_start int, start int, end int", useArrow=True)
class SectionsOf:
    """The headed sections of a text; null gives none."""

    def eval(self, text: str):
        heads = [(m[1].strip(), m.start(1), m.end()) for m in re.finditer(HEADER, text, re.M)] if text is not None else []
        for i, (name, at, start) in enumerate(heads):
            yield name, at, start, heads[i + 1][1] if i + 1 < len(heads) else len(text)


def register(spark: SparkSession) -> None:
    """Make sections_of(text) known to SQL as a table function."""
    spark.udtf.register("sections_of", SectionsOf)

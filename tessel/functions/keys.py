"""Column helpers for keys and small text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII blanks and the no-break space, as they stand around keys.
BLANKS = " \t\r\n\f\u000b\u00a0"


def loose(col: Column | str) -> Column:
    """Trimmed, lower-cased key; null when nothing is left."""
    col = F.col(col) if isinstance(col, str) else col
    out = F.lower(F.trim(col, F.lit(BLANKS)))
    return F.when(out != "", out)

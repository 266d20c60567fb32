"""Set-based PySpark operators for linking text to a vocabulary and judging the result."""

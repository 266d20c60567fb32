import hashlib
import inspect

from pyspark.sql import functions as F

from tessel.operators import metrics

ROWS = [(f"n{i % 12}", (i * 7) % 5 < 3, (i * 11) % 4 < 1) for i in range(90)] + [(None, True, True), ("n1", None, True)]


def weight(draw, note):
    u = int(hashlib.md5(f"13:{draw}:{note}".encode()).hexdigest()[:8], 16) / 4294967296.0
    return next((i for i, p in enumerate(metrics.POISSON) if u < p), len(metrics.POISSON))


def brute(value, draws):
    rows = [(n, value(a, b)) for n, a, b in ROWS if n is not None and a is not None]
    notes = sorted({n for n, _ in rows})
    rates = []
    for d in range(draws):
        w = {n: weight(d, n) for n in notes}
        total = sum(w[n] for n, _ in rows)
        if total:
            rates.append(sum(w[n] * v for n, v in rows) / total)
    rates.sort()
    return len(notes), round(sum(v for _, v in rows) / len(rows), 6), round(rates[int(0.025 * draws)], 6), round(rates[int(0.975 * draws)], 6)


def test_two_thousand_draws_by_default(spark):
    df = spark.createDataFrame(ROWS, "note string, a boolean, b boolean")
    assert inspect.signature(metrics.bootstrap_rate).parameters["draws"].default == 2000
    assert tuple(metrics.bootstrap_rate(df, "note", F.col("a")).first()) == brute(lambda a, b: a, 2000)


def test_paired_difference_uses_the_same_draws(spark):
    df = spark.createDataFrame(ROWS, "note string, a boolean, b boolean")
    assert tuple(metrics.bootstrap_difference(df, "note", F.col("a"), F.col("b")).first()) == brute(lambda a, b: a - b, 2000)
    assert tuple(metrics.bootstrap_difference(df, "note", F.col("a"), F.col("a")).first())[1:] == (0.0, 0.0, 0.0)

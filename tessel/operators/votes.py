"""Votes: plurality, features, a logistic calibrator and label constraints."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plurality(votes: DataFrame, item: str, label: str, position: str) -> DataFrame:
    """(item, label, n): each item's most frequent label; ties go to the one seen first."""
    g = votes.groupBy(item, label).agg(F.count("*").alias("n"), F.min(position).alias("_first"))
    w = Window.partitionBy(item).orderBy(F.desc("n"), "_first", label)
    return g.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(item, label, "n")


def against_plurality(votes: DataFrame, item: str, voter: str, label: str) -> DataFrame:
    """(voter, n, agreement): how often each voter says what most voters of the item say."""
    g = votes.groupBy(item, label).agg(F.count("*").alias("n"))
    most = g.withColumn("_rn", F.row_number().over(Window.partitionBy(item).orderBy(F.desc("n"), label))).where("_rn = 1").select(item, F.col(label).alias("_most"))
    return votes.join(most, item).groupBy(voter).agg(F.count("*").alias("n"), F.round(F.avg((F.col(label) == F.col("_most")).cast("int")), 6).alias("agreement"))


def vote_features(votes: DataFrame, item: str, label: str, confidence: str) -> DataFrame:
    """(item, n_votes, n_verdicts, mean_p, low_p, high_p, spread) per item."""
    return votes.groupBy(item).agg(
        F.count("*").alias("n_votes"),
        F.countDistinct(label).alias("n_verdicts"),
        F.round(F.avg(confidence), 6).alias("mean_p"),
        F.min(confidence).alias("low_p"),
        F.max(confidence).alias("high_p"),
        F.round(F.max(confidence) - F.min(confidence), 6).alias("spread"),
    )


def fit_logistic(rows: DataFrame, features: list[str], label: str, least: int = 30, seed: int = 42) -> Callable[[DataFrame], DataFrame]:
    """Class-balanced logistic regression; returns a function that adds ``score``.

    Fewer than ``least`` labelled rows or a single class are refused. Null features count as zero.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    gather = VectorAssembler(inputCols=features, outputCol="_x")
    ready = rows.fillna(0, features).where(F.col(label).isNotNull()).withColumn("_y", F.col(label).cast("double"))
    counts = {r["_y"]: r["count"] for r in ready.groupBy("_y").count().collect()}
    total = sum(counts.values())
    if total < least or len(counts) < 2:
        raise ValueError(f"{total} labelled rows of {len(counts)} classes are too few")
    weight = F.when(F.col("_y") == 1, total / (2 * counts[1.0])).otherwise(total / (2 * counts[0.0]))
    model = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=1.0 / total, maxIter=100).fit(gather.transform(ready.withColumn("_w", weight)))

    def score(df: DataFrame) -> DataFrame:
        out = model.transform(gather.transform(df.fillna(0, features)))
        return out.withColumn("score", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")

    return score


def allowed_pairs(head: str, tail: str, allowed: dict[str, list[str]]) -> Column:
    """Whether a row's pair is allowed: heads without a rule pass, a missing side does not."""
    ok = ~F.col(head).isin(*allowed)
    for h, tails in allowed.items():
        ok = ok | ((F.col(head) == h) & F.col(tail).isin(*tails))
    return F.col(head).isNotNull() & F.col(tail).isNotNull() & ok


def pair_hash(number: Column, text: Column) -> Column:
    """Sixteen digits of the SHA-256 of [[number, "text"]]."""
    return F.substring(F.sha2(F.concat(F.lit("[["), number.cast("string"), F.lit(', "'), text, F.lit('"]]')), 256), 1, 16)


def notes_of_split(splits: DataFrame, available: DataFrame, split: str = "val", unlock: bool = False, names: tuple[str, ...] = ("train", "val", "test", "all")) -> DataFrame:
    """(note_id, available): the notes of a split and whether there is data for them.

    splits: (note_id, split). The test split, and all splits together, are only given with ``unlock``;
    an unknown split is an error. Both are refused before anything runs.
    """
    if split not in names:
        raise ValueError(f"unknown split: {split}")
    if split in ("test", "all") and not unlock:
        raise PermissionError(f"the {split} split is held out")
    wanted = (splits if split == "all" else splits.where(F.col("split") == split)).select("note_id").distinct()
    have = available.select("note_id").where("note_id IS NOT NULL").distinct().withColumn("_have", F.lit(True))
    return wanted.join(have, "note_id", "left").select("note_id", F.col("_have").isNotNull().alias("available"))

"""Measures of confidence, ranking and agreement."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.sources.tables import materialize


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Running totals over the whole table in ``order``, without one task seeing all rows.

    Rows are dealt to range partitions; within each a window runs, and the totals of the partitions
    before it, one row per partition, are added.
    """
    names = {f"_o{i}": c for i, c in enumerate(order)}
    ranged = df.withColumns({f"_s{i}": c for i, c in enumerate(sums.values())}).repartitionByRange(*names.values())
    ranged = materialize(ranged.withColumn("_pid", F.spark_partition_id()), "ranged")
    cols = [f"_s{i}" for i in range(len(sums))]
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    per = ranged.groupBy("_pid").agg(*[F.sum(c).alias(c) for c in cols])
    offset = per.select("_pid", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_b{c}") for c in cols])
    w = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(offset, "_pid")
    return out.withColumns({n: F.col(f"_b{c}") + F.sum(c).over(w) for n, c in zip(sums, cols)}).drop("_pid", *cols, *[f"_b{c}" for c in cols])


def global_rank(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows with their place ``rank`` in the order of the whole table."""
    return running_sums(df, [F.col(c) for c in order], {"rank": F.lit(1)})


def rank_within(df: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """Rows with their place ``rank`` in the order of their group, without one task seeing a whole group."""
    keyed = df.withColumns({f"_k{i}": c for i, c in enumerate(order)})
    ranked = global_rank(keyed, [by, *[f"_k{i}" for i in range(len(order))]])
    first = ranked.groupBy(by).agg(F.min("rank").alias("_first"))
    out = ranked.join(first.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")))
    return out.withColumn("rank", F.col("rank") - F.col("_first") + 1).drop("_first", "_by", *[f"_k{i}" for i in range(len(order))])


def stratified_split(sizes: DataFrame, key: str, size: str, shares: dict[str, float], rest: str, strata: int) -> DataFrame:
    """(key, stratum, split): equal strata by size, in each a hashed order cut by the shares."""
    total = sizes.count()
    cut = sizes.withColumn("rank", F.lit(1)) if total == 0 else global_rank(sizes, [size, key])
    cut = cut.withColumn("stratum", F.least(F.floor((F.col("rank") - 1) * strata / F.lit(max(total, 1))), F.lit(strata - 1)).cast("long"))
    m = cut.groupBy("stratum").agg(F.count("*").alias("m"))
    placed = cut if total == 0 else rank_within(cut.drop("rank"), "stratum", [F.md5(key), F.col(key)])
    placed = placed.join(m, "stratum").withColumnRenamed("rank", "k")
    split, edge = F.lit(rest), F.lit(0)
    edges = []
    for name, share in shares.items():
        edge = edge + F.round(F.col("m") * share)
        edges.append((name, edge))
    for name, edge in reversed(edges):
        split = F.when(F.col("k") <= edge, name).otherwise(split)
    return placed.select(key, "stratum", split.alias("split"))


def reliability(df: DataFrame, confidence: str, outcome: str, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy): equal-width bins of [0, 1]; empty bins have n 0; nulls are left out."""
    rows = df.where(F.col(confidence).isNotNull() & F.col(outcome).isNotNull())
    binned = rows.groupBy(F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).alias("bin"))
    got = binned.agg(F.count("*").alias("n"), F.round(F.avg(confidence), 6).alias("confidence"), F.round(F.avg(F.col(outcome).cast("double")), 6).alias("accuracy"))
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(got, "bin", "left").fillna(0, ["n"])


def calibration_error(df: DataFrame, confidence: str, outcome: str, bins: int = 10) -> DataFrame:
    """One row (n, ece, mce): expected and largest gap between confidence and accuracy."""
    rows = df.where(F.col(confidence).isNotNull() & F.col(outcome).isNotNull())
    b = rows.groupBy(F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg(confidence) - F.avg(F.col(outcome).cast("double"))).alias("gap"))
    return b.agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 6).alias("ece"), F.round(F.max("gap"), 6).alias("mce"))


def equal_mass_bins(df: DataFrame, confidence: str, outcome: str, bins: int = 10, digits: int = 4) -> DataFrame:
    """(bin, n, low, high, accuracy): bins of about equal counts in which equal scores stay together.

    Scores are rounded to ``digits`` first, so the driver cuts at most 10**digits + 1 counts.
    """
    rows = df.where(F.col(confidence).isNotNull() & F.col(outcome).isNotNull())
    got = rows.groupBy(F.round(confidence, digits).alias("c")).agg(F.count("*").alias("n"), F.sum(F.col(outcome).cast("long")).alias("hit")).collect()
    total = sum(r["n"] for r in got)
    size = max(1, total // bins)
    out: list[list] = []
    for r in sorted(got, key=lambda r: r["c"]):
        if not out or out[-1][0] >= size:
            out.append([0, r["c"], r["c"], 0])
        out[-1][0] += r["n"]
        out[-1][2] = r["c"]
        out[-1][3] += r["hit"]
    if len(out) > 1 and out[-1][0] < size:
        n, _, high, hit = out.pop()
        out[-1] = [out[-1][0] + n, out[-1][1], high, out[-1][3] + hit]
    return df.sparkSession.createDataFrame([(i, n, lo, hi, round(hit / n, 6)) for i, (n, lo, hi, hit) in enumerate(out)], "bin int, n long, low double, high double, accuracy double")


def brier(df: DataFrame, confidence: str, outcome: str) -> DataFrame:
    return df.agg(F.round(F.avg(F.pow(F.col(confidence) - F.col(outcome).cast("double"), 2)), 6).alias("brier"))


def _by_score(df: DataFrame, confidence: str, outcome: str) -> DataFrame:
    rows = df.where(F.col(confidence).isNotNull() & F.col(outcome).isNotNull())
    return rows.groupBy(F.col(confidence).alias("score")).agg(F.count("*").alias("n"), F.sum(F.col(outcome).cast("long")).alias("pos"))


def auroc(df: DataFrame, confidence: str, outcome: str) -> DataFrame:
    """One row (n_pos, n_neg, auroc) with average ranks for ties; null when one class is absent."""
    s = running_sums(_by_score(df, confidence, outcome), [F.col("score")], {"upto": F.col("n")})
    mean_rank = F.col("upto") - (F.col("n") - 1) / 2
    t = s.agg(F.sum("pos").alias("n_pos"), F.sum(F.col("n") - F.col("pos")).alias("n_neg"), F.sum(F.col("pos") * mean_rank).alias("r"))
    u = F.col("r") - F.col("n_pos") * (F.col("n_pos") + 1) / 2
    return t.select("n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.round(u / (F.col("n_pos") * F.col("n_neg")), 6)).alias("auroc"))


def average_precision(df: DataFrame, confidence: str, outcome: str) -> DataFrame:
    """One row (average_precision): precision at the end of each score group weighted by its positives."""
    s = running_sums(_by_score(df, confidence, outcome), [F.desc("score")], {"seen": F.col("n"), "hits": F.col("pos")})
    return s.agg(F.round(F.sum(F.col("pos") * F.col("hits") / F.col("seen")) / F.sum("pos"), 6).alias("average_precision"))


def null_model(df: DataFrame, outcome: str) -> DataFrame:
    """One row of what always predicting the base rate would score."""
    p = F.avg(F.col(outcome).cast("double"))
    return df.agg(F.count(outcome).alias("n"), F.round(p, 6).alias("base_rate"), F.round(F.greatest(p, 1 - p), 6).alias("majority_accuracy"), F.round(p * (1 - p), 6).alias("brier"))


def threshold_sweep(df: DataFrame, confidence: str, outcome: str, thresholds: list[float]) -> DataFrame:
    """(threshold, admitted, coverage, precision) in one pass over the rows."""
    hit = lambda t: F.col(confidence) >= t
    aggs = [F.struct(F.lit(t).alias("threshold"), F.count_if(hit(t)).alias("admitted"), F.round(F.count_if(hit(t)) / F.count("*"), 6).alias("coverage"), F.round(F.avg(F.when(hit(t), F.col(outcome).cast("double"))), 6).alias("precision")) for t in thresholds]
    return df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


#: The chance that a Poisson count of mean one is at most 0, 1, 2, ...
POISSON = (0.367879, 0.735759, 0.919699, 0.981012, 0.99634, 0.999406)


def _draws(sums: DataFrame, cluster: str, draws: int, seed: int, rate: Column) -> DataFrame:
    """One row (low, high): percentile interval of ``rate``, an aggregate over w, over the draws of the clusters."""
    spread = int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few clusters still make many draws
    each = sums.repartition(spread, cluster).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col(cluster).cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    each = each.withColumn("_u", u)  # a column of its own, so that the digest is made once for all cases
    weight = F.lit(len(POISSON))
    for i in reversed(range(len(POISSON))):
        weight = F.when(F.col("_u") < POISSON[i], i).otherwise(weight)
    drawn = each.withColumn("w", weight).groupBy("draw").agg(rate.alias("r"))
    lo, hi = int(0.025 * draws), min(draws - 1, int(0.975 * draws))
    return drawn.agg(F.array_sort(F.collect_list("r")).alias("r")).select(F.round(F.col("r")[lo], 6).alias("low"), F.round(F.col("r")[hi], 6).alias("high"))


def bootstrap_rate(df: DataFrame, cluster: str, hit: Column, draws: int = 2000, seed: int = 13) -> DataFrame:
    """One row (n_clusters, rate, low, high): percentile interval of a rate over resampled clusters.

    A cluster's weight in a draw is a Poisson count taken from a hash of seed, draw and cluster, so no
    draw needs to see all clusters and a re-run gives the same interval.
    """
    sums = df.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.sum(hit.cast("long")).alias("h"), F.count(hit).alias("n"))
    interval = _draws(sums, cluster, draws, seed, F.sum(F.col("w") * F.col("h")) / F.sum(F.col("w") * F.col("n")))
    return sums.agg(F.count("*").alias("n_clusters"), F.round(F.sum("h") / F.sum("n"), 6).alias("rate")).crossJoin(interval)


def bootstrap_difference(df: DataFrame, cluster: str, a: Column, b: Column, draws: int = 2000, seed: int = 13) -> DataFrame:
    """One row (n_clusters, difference, low, high): interval of rate a less rate b, both over the same draws.

    Rows where either outcome is null do not count, so both rates are over the same rows.
    """
    rows = df.where(F.col(cluster).isNotNull() & a.isNotNull() & b.isNotNull())
    sums = rows.groupBy(cluster).agg(F.sum(a.cast("long") - b.cast("long")).alias("h"), F.count("*").alias("n"))
    rate = lambda w: F.sum(w * F.col("h")) / F.sum(w * F.col("n"))
    return sums.agg(F.count("*").alias("n_clusters"), F.round(rate(F.lit(1)), 6).alias("difference")).crossJoin(_draws(sums, cluster, draws, seed, rate(F.col("w"))))


def headroom(df: DataFrame, group: list[str], score: str, outcome: Column, tie: str) -> DataFrame:
    """One row (n, top1, oracle, headroom): how often the best-scored row is right, and any row is."""
    per = df.groupBy(*group).agg(F.max_by(outcome, F.struct(F.col(score), -F.col(tie))).alias("top"), F.max(outcome).alias("any"))
    top, best = F.avg(F.col("top").cast("double")), F.avg(F.col("any").cast("double"))
    return per.where("top IS NOT NULL").agg(F.count("*").alias("n"), F.round(top, 6).alias("top1"), F.round(best, 6).alias("oracle"), F.round(best - top, 6).alias("headroom"))


def rank_metrics(above: DataFrame, k: int) -> DataFrame:
    """One row (n, mrr, hits_at_k); ``above`` has for each probe the number n of answers better than its best right one."""
    rank = F.col("n") + 1
    return above.agg(F.count("*").alias("n"), F.round(F.avg(1 / rank), 6).alias("mrr"), F.round(F.avg((rank <= k).cast("double")), 6).alias(f"hits_at_{k}"))


def latency_summary(df: DataFrame, value: str, by: str) -> DataFrame:
    """(by, n, mean, p50, p95, most): the p95 is the value at place round(0.95 * (n - 1))."""
    rows = df.where(F.col(value).isNotNull())
    n = rows.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.expr(f"percentile({value}, 0.5)").alias("p50"), F.max(value).alias("most"))
    counts = running_sums(rows.groupBy(by, value).agg(F.count("*").alias("c")), [F.col(by), F.col(value)], {"upto": F.col("c")})
    before = counts.groupBy(by).agg(F.min(F.col("upto") - F.col("c")).alias("before"))
    counts = counts.join(before, by).withColumn("upto", F.col("upto") - F.col("before"))
    p95 = counts.join(n.select(by, "n"), by).where(F.col("upto") > F.floor(F.lit(0.95) * (F.col("n") - 1) + 0.5)).groupBy(by).agg(F.min(value).alias("p95"))
    return n.join(p95, by).select(by, "n", "mean", F.round("p50", 6).alias("p50"), "p95", "most")


def approximate_profile(df: DataFrame, by: str, key: str, value: str) -> DataFrame:
    """(by, n_keys, median): distinct keys by a HyperLogLog sketch and the median by a quantile sketch.

    Sketches of partitions are merged, so no task sees all keys or values; the error is about 1 %.
    """
    return df.groupBy(by).agg(F.approx_count_distinct(key, 0.01).alias("n_keys"), F.percentile_approx(value, 0.5, 10_000).alias("median"))

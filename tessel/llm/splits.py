"""Splits that keep related records together (problem 5)."""


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.keys import loose
from tessel.sources.tables import materialize


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) of an edge list (a, b) of strings: the smallest node each node is connected to.

    Alternating large and small stars: in turn, every node's larger and its smaller-or-equal neighbours
    are tied to its smallest neighbour, until nothing moves. The rounds grow with the logarithm of the
    longest chain. Minima are aggregates joined back, so a node with very many neighbours is never
    gathered in one task. Edges with a null end are left out; loops give a component of one node.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b"))
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    count = None
    for _ in range(max_rounds):
        both = e.union(e.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        e = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(small).distinct()
        e = materialize(e, "stars")
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if count == tuple(now):
            break
        count = tuple(now)
    else:
        raise RuntimeError("the components did not settle")
    return nodes.distinct().join(e.toDF("node", "component"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def subject_of(note: Column) -> Column:
    """What a note id stands for: its subject number without leading zeros, else the id itself."""
    digits = F.regexp_extract(loose(note), r"^(\d+)", 1)
    number = F.when(F.length(F.ltrim(digits)) > 0, F.regexp_replace(digits, r"^0+(?=\d)", ""))
    return F.when(number.isNotNull(), number).otherwise(F.concat(F.lit("note:"), loose(note)))


def related_notes(index: DataFrame) -> DataFrame:
    """(subject, component) of the subjects that shared encounters or copied notes tie together.

    index: (note_id, encounter_ref, copied_from). Notes of one subject are one node from the start,
    and an encounter enters only if it has several subjects, so the edges are few however many notes
    there are. Blank and null references tie nothing; keys are compared trimmed and without case.
    """
    rows = index.select(subject_of(F.col("note_id")).alias("s"), loose("encounter_ref").alias("e"), F.when(loose("copied_from").isNotNull(), subject_of(F.col("copied_from"))).alias("c")).where("s IS NOT NULL")
    met = rows.where("e IS NOT NULL").select("e", "s").distinct()
    shared = met.groupBy("e").agg(F.min("s").alias("first"), F.max("s").alias("last")).where("first <> last").select("e", "first")
    edges = met.join(shared, "e").select(F.col("s").alias("a"), F.col("first").alias("b")).union(rows.where("c IS NOT NULL").select("s", "c"))
    return components(edges.where("a <> b").distinct()).withColumnRenamed("node", "subject")


def group_notes(mentions: DataFrame, index: DataFrame) -> DataFrame:
    """(note_id, component, n_rows, any_test, any_other) of each note that has mentions.

    mentions: (note_id, is_test); a note of very many rows is folded before it moves. Null notes give
    no row; null flags count as not test.
    """
    notes = mentions.where(loose("note_id").isNotNull()).groupBy("note_id").agg(
        F.count("*").alias("n_rows"),
        F.max(F.coalesce("is_test", F.lit(False))).alias("any_test"),
        F.max(~F.coalesce("is_test", F.lit(False))).alias("any_other"),
    )
    notes = notes.withColumn("subject", subject_of(F.col("note_id")))
    return notes.join(related_notes(index), "subject", "left").select("note_id", F.coalesce("component", "subject").alias("component"), "n_rows", "any_test", "any_other")


def torn_groups(notes: DataFrame) -> DataFrame:
    """(group_note_id, note_id): groups of several notes whose rows are partly test and partly not."""
    torn = notes.groupBy("component").agg(F.min("note_id").alias("group_note_id"), F.count("*").alias("n"), F.max("any_test").alias("t"), F.max("any_other").alias("o"))
    return notes.join(torn.where("n >= 2 AND t AND o"), "component").where("note_id <> group_note_id").select("group_note_id", "note_id")


def _cost(have: np.ndarray, want: np.ndarray) -> float:
    """Squared deviation of sizes (first column, counted double) and of labels, each against its total."""
    scale = np.maximum(want.sum(0), 1)
    d = ((have - want) / scale) ** 2
    return float(2 * d[:, 0].sum() + d[:, 1:].sum() / max(1, have.shape[1] - 1))


def anneal(sizes: np.ndarray, start: np.ndarray, want: np.ndarray, seed: int, steps: int) -> tuple[np.ndarray, float]:
    """Component swap search: move one component or exchange two, keep the best assignment seen.

    sizes: rows per component and label (first column all rows); want: the same per split.
    """
    rng = np.random.default_rng(seed)
    n, k = len(sizes), len(want)
    now = start.copy()
    have = np.stack([sizes[now == s].sum(0) if (now == s).any() else np.zeros(sizes.shape[1]) for s in range(k)])
    cost = best_cost = _cost(have, want)
    best = now.copy()
    heat = max(cost, 1e-9) * 0.1
    picks = rng.integers(0, n, (steps, 2))
    targets = rng.integers(0, k, steps)
    chance = rng.random(steps)
    swap = rng.random(steps) < 0.5
    for t in range(steps):
        i, j = picks[t]
        a, b = now[i], now[j] if swap[t] else targets[t]
        if a == b:
            continue
        delta = sizes[i] - (sizes[j] if swap[t] else 0)
        trial = have.copy()
        trial[a] -= delta
        trial[b] += delta
        c = _cost(trial, want)
        if c <= cost or chance[t] < np.exp((cost - c) / max(heat, 1e-12)):
            have, cost = trial, c
            now[i] = b
            if swap[t]:
                now[j] = a
            if c < best_cost:
                best_cost, best = c, now.copy()
        heat *= 0.998
    return best, best_cost


def split_components(
    sizes: DataFrame,
    shares: dict[str, float],
    *,
    labels: list[str],
    block: int = 2_000,
    chains: int = 4,
    steps: int = 4_000,
    seed: int = 42,
) -> DataFrame:
    """(component, split): whole components assigned to splits of the given shares.

    sizes: (component, n_rows, and a count per name in ``labels``). Every component starts in a split
    drawn by its hash. Components are hashed into blocks of about ``block``; for each block several
    annealing chains with own seeds run in parallel, and the best of the block is kept. A component
    of more than a thousandth of all rows is placed before, largest first, where most is missing;
    there are at most a thousand of those, whatever the data, and the blocks share what is then left
    of each split. So no task sees more than one block and the driver only those thousand.

    Null components give no row; shares need not sum to one; ties go by hash and name.
    """
    spark = sizes.sparkSession
    names = sorted(shares)
    part = np.array([shares[s] for s in names]) / sum(shares.values())
    cols = ["n_rows", *labels]
    own = materialize(sizes.where("component IS NOT NULL").select("component", *[F.col(c).cast("long").alias(f"c{i}") for i, c in enumerate(cols)]), "sizes")
    total = own.agg(*[F.coalesce(F.sum(f"c{i}"), F.lit(0)).alias(f"c{i}") for i in range(len(cols))], F.count("*").alias("n")).first()
    every = np.array([total[f"c{i}"] for i in range(len(cols))], float)
    large = own.where(F.col("c0") * 1000 > F.lit(int(total["c0"]))).collect()
    want = part[:, None] * every[None, :]
    have = np.zeros_like(want)
    placed = []
    for r in sorted(large, key=lambda r: (-r["c0"], r["component"])):
        size = np.array([r[f"c{i}"] for i in range(len(cols))], float)
        k = min(range(len(names)), key=lambda k: (_cost(have + np.eye(len(names))[k][:, None] * size[None, :], want), k))
        have[k] += size
        placed.append((r["component"], names[k]))
    left = np.maximum(want - have, 0)
    rest = own.where(F.col("c0") * 1000 <= F.lit(int(total["c0"])))
    spare = every - have.sum(0)
    goal = np.where(left.sum(0) > 0, left / np.maximum(left.sum(0), 1e-9), part[:, None])
    first = goal[:, 0] / max(goal[:, 0].sum(), 1e-9) if spare[0] > 0 else part
    blocks = max(1, -(-(total["n"] - len(placed)) // block))
    rest = rest.withColumn("block", F.pmod(F.xxhash64("component", F.lit(seed)), F.lit(blocks))).withColumn("draw", F.pmod(F.xxhash64(F.lit(seed + 1), "component"), F.lit(1_000_000)) / 1_000_000)

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("component").reset_index(drop=True)
        s = pdf[[f"c{i}" for i in range(len(cols))]].to_numpy(float)
        start = np.searchsorted(np.cumsum(first)[:-1], pdf["draw"].to_numpy(), side="right")
        best, cost = anneal(s, start, goal * s.sum(0)[None, :], seed + 7919 * int(pdf["block"].iloc[0]) + int(pdf["chain"].iloc[0]), steps)
        return pd.DataFrame({"block": pdf["block"], "chain": pdf["chain"], "cost": cost, "component": pdf["component"], "split": [names[k] for k in best]})

    tried = rest.withColumn("chain", F.explode(F.array(*(F.lit(c) for c in range(chains))))).groupBy("block", "chain").applyInPandas(chain, "block long, chain int, cost double, component string, split string")
    tried = materialize(tried, "chains")
    won = tried.groupBy("block").agg(F.min(F.struct("cost", "chain")).alias("w")).select("block", "w.chain")
    out = tried.join(won, ["block", "chain"]).select("component", "split")
    return out.unionByName(spark.createDataFrame(placed, "component string, split string"))

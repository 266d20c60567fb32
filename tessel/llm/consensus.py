"""Consensus from several annotators' labels (problem 4)."""

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.sources.tables import materialize


def annotator_name(col: Column) -> Column:
    """A model's name without case, version and quantisation marks; null when blank."""
    name = F.regexp_replace(F.lower(F.trim(col)), r"\s*[(@:\[].*$", "")
    name = F.trim(F.regexp_replace(name, r"[-_ ](?:q\d\w*|int\d+|fp\d+|bf16|awq|gptq|gguf|v\d+(?:\.\d+)*|r\d+)$", ""))
    return F.when(name != "", name)


def verdict_name(plain: Column) -> Column:
    """A verdict in its one spelling, or null when it is none; ``plain`` is verdict_letters() of it, as a
    column of its own, so that it is not made anew for each case."""
    number = F.regexp_extract(plain, r"(\d+)$", 1)
    return (
        F.when(plain.isin("SUPPORTED", "SUPPORTED1") | plain.rlike(r"^RERANK(TO)?(CANDIDATE)?1$"), "SUPPORTED_1")
        .when(plain.rlike(r"^RERANK(TO)?(CANDIDATE)?\d+$"), F.concat(F.lit("RE_RANK_TO_CANDIDATE_"), number))
        .when(plain.rlike(r"^NONE(OF.*)?CORRECT$"), "NONE_CORRECT")
    )


def verdict_letters(col: Column) -> Column:
    """The letters and digits of a verdict in capitals."""
    return F.regexp_replace(F.upper(col), r"[^A-Z0-9]", "")


def clean_votes(votes: DataFrame) -> DataFrame:
    """One row (item_id, annotator, label) per annotator of an item.

    votes: (item_id, annotator, label, position, usable). Rows with a null item, annotator or label,
    or not usable, are left out; of an annotator's repeated votes the first position counts, then the
    first label in string order.
    """
    kept = votes.where("item_id IS NOT NULL AND annotator IS NOT NULL AND label IS NOT NULL AND coalesce(usable, true)")
    return each_vote(clean_ballots(kept.select("item_id", F.array(F.struct("annotator", "position", "label")).alias("votes"))))


def clean_ballots(ballots: DataFrame) -> DataFrame:
    """One row (item_id, votes) per item, votes being (annotator, label) in the annotators' order.

    ballots: (item_id, votes), votes being (annotator, position, label) without nulls but positions,
    several rows per item if it was delivered several times. Equal deliveries are folded before they move.
    """
    per = ballots.where("item_id IS NOT NULL AND size(votes) > 0").groupBy("item_id").agg(F.collect_set("votes").alias("v"))
    per = per.select("item_id", F.array_sort(F.array_distinct(F.flatten("v"))).alias("v"))
    first = F.filter("v", lambda x, i: (i == 0) | (F.get("v", i - 1)["annotator"] != x["annotator"]))
    return per.select("item_id", F.transform(first, lambda x: F.struct(x["annotator"].alias("annotator"), x["label"].alias("label"))).alias("votes"))


def each_vote(ballots: DataFrame) -> DataFrame:
    """(item_id, annotator, label) of clean ballots."""
    return ballots.select("item_id", F.explode("votes").alias("x")).select("item_id", "x.annotator", "x.label")


class Consensus:
    """Result of weigh_votes: per-item labels lazily, per-annotator figures at hand."""

    def __init__(self, items: DataFrame, annotators: DataFrame, rounds: int, settled: bool):
        self.items, self.annotators, self.rounds, self.settled = items, annotators, rounds, settled


class _Weights:
    """What a round knows: labels in the order that settles ties, their log shares, and a weight per annotator and label."""

    def __init__(self, labels: list[str], pairs: list[tuple[str, str]], share: dict[str, float], weight: dict[tuple[str, str], float]):
        self.labels = sorted(labels, key=lambda x: (-share[x], x))
        place = {x: i for i, x in enumerate(self.labels)}
        self.pairs = pa.array([f"{a}\t{x}" for a, x in pairs], pa.string())
        self.label = np.array([place[x] for _, x in pairs], np.int64)
        self.weight = np.array([weight[k] for k in pairs])
        self.prior = np.log(np.array([share[x] for x in self.labels]))

    def score(self, batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, end, row of each vote, its pair, scores of each row's labels) of parts of a batch
        that are small enough for a table of votes by labels."""
        votes = batch.column(batch.schema.get_field_index("votes"))
        flat = votes.flatten()
        pair = pc.index_in(pc.binary_join_element_wise(flat.field("annotator"), flat.field("label"), "\t"), value_set=self.pairs).to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.diff(votes.offsets.to_numpy()))
        width = max(1, 4_000_000 // max(1, len(self.labels)))
        start = first = 0
        while start < len(ends):
            stop = max(start + 1, int(np.searchsorted(ends, first + width, side="right")))
            own = pair[first : ends[stop - 1]]
            row = np.repeat(np.arange(stop - start), np.diff(np.concatenate([[first], ends[start:stop]])))
            scores = np.tile(self.prior, (stop - start, 1))
            np.add.at(scores, (row, self.label[own]), self.weight[own])
            yield start, stop, row, own, scores
            start, first = stop, int(ends[stop - 1])


def _certainty(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = scores.argmax(1)
    return top, 1 / np.exp(scores - scores[np.arange(len(scores)), top][:, None]).sum(1)


def weigh_votes(
    votes: DataFrame,
    *,
    per_label: bool = True,
    smoothing: float = 2.0,
    sure: float = 0.9,
    tolerance: float = 1e-3,
    max_rounds: int = 100,
    most: int = 10_000,
) -> Consensus:
    """Iteratively reweighted voting over clean votes (item_id, annotator, label), or ballots (item_id, votes).

    In turn, each item's consensus is the label of the largest summed weight, and each annotator's
    accuracy is measured, smoothed, against the weighted vote of the others, without the own vote,
    on the items where the others are ``sure`` (0: on all). This ends when no accuracy moves by
    ``tolerance``; after ten rounds the counts are averaged over the rounds, so that figures which go
    back and forth settle too. ``settled`` tells whether they did within ``max_rounds``.

    A vote weighs the log odds of its annotator's accuracy. With ``per_label`` the leave-one-out
    accuracy is kept per label said, as some annotators say one label whenever they do not know: a
    vote weighs the log of how much oftener it is said when it is right than when it is not, and
    labels start with the log of their share of the consensus.

    ``items`` gives (item_id, label, n_annotators, support, agreement): the share of the weight behind
    the label and the share of annotators behind it; ``annotators`` the accuracy over all labels, the
    accuracy of the annotator's most and least trusted label, the number of votes, the rounds and
    whether they settled.

    Items with the same votes by the same annotators are counted once, so the rounds run over the
    distinct patterns; only figures per annotator and label reach the driver, at most ``most``
    labels and annotators. Ties go to the label more common in the consensus, then in string order.
    An item of one vote gets that vote and teaches nothing about its annotator. No votes give no rows.
    """
    pattern = votes if "votes" in votes.columns else votes.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("annotator", "label"))).alias("votes"))
    pattern = materialize(pattern.withColumn("pattern", F.md5(F.to_json("votes"))), "ballots")
    each = materialize(pattern.groupBy("pattern").agg(F.first("votes").alias("votes"), F.count("*").alias("n")), "patterns")
    used = each.select("n", F.explode("votes").alias("v")).groupBy("v.annotator", "v.label").agg(F.sum("n").alias("n")).limit(most * 10 + 1).collect()
    labels, names = sorted({r["label"] for r in used}), sorted({r["annotator"] for r in used})
    if len(labels) > most or len(names) > most or len(used) > most * 10:
        raise ValueError(f"more than {most} labels or annotators")
    pairs = sorted((r["annotator"], r["label"]) for r in used)
    k = max(2, len(labels))
    odds = lambda right: math.log(right * (k - 1) / (1 - right))
    share = dict.fromkeys(labels, 1 / k)
    weight = dict.fromkeys(pairs, odds(0.7))
    accuracy = dict.fromkeys(names, 0.7)
    trust = dict.fromkeys(pairs, 0.7)
    by_name: dict[str, list[str]] = {}
    for a, x in pairs:
        by_name.setdefault(a, []).append(x)

    def learner(now: _Weights):
        n_labels = len(now.labels)

        def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            told_n = np.zeros(len(pairs) * n_labels, np.int64)
            label_n = np.zeros(n_labels, np.int64)
            for batch in batches:
                n = batch.column(batch.schema.get_field_index("n")).to_numpy()
                for start, stop, row, own, scores in now.score(batch):
                    part = n[start:stop]
                    np.add.at(label_n, scores.argmax(1), part)
                    others = scores[row]
                    others[np.arange(len(row)), now.label[own]] -= now.weight[own]
                    told, p = _certainty(others)
                    counts = (p >= sure) & (np.bincount(row, minlength=stop - start)[row] > 1)
                    np.add.at(told_n, own[counts] * n_labels + told[counts], part[row[counts]])
            at = np.flatnonzero(told_n)
            rows = [(int(i // n_labels), int(i % n_labels), int(told_n[i])) for i in at] + [(-1, int(i), int(label_n[i])) for i in np.flatnonzero(label_n)]
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["pair", "told", "n"])

        return learn

    def decide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = _Weights(labels, pairs, share, weight)
        names = np.array(now.labels, object)
        for batch in batches:
            for start, stop, row, own, scores in now.score(batch):
                top, p = _certainty(scores)
                size = np.bincount(row, minlength=stop - start)
                behind = np.bincount(row, weights=now.label[own] == top[row], minlength=stop - start)
                cols = [batch.column(0).slice(start, stop - start), pa.array(names[top], pa.string()), pa.array(size, pa.int32()), pa.array(p), pa.array(behind / size)]
                yield pa.RecordBatch.from_arrays(cols, names=["pattern", "label", "n_annotators", "support", "agreement"])

    rounds, settled, last = 0, not used, ()
    while used and rounds < max_rounds and not settled:
        rounds += 1
        now = _Weights(labels, pairs, share, weight)
        rows = each.select("votes", "n").mapInArrow(learner(now), "pair long, told long, n long").groupBy("pair", "told").agg(F.sum("n").alias("n")).collect()
        seen: dict[tuple[str, str], float] = {}
        said: dict[tuple[str, str], float] = {}
        hits: dict[tuple[str, str], float] = {}
        counts = dict.fromkeys(labels, 1.0)
        for r in rows:
            t, n = now.labels[r["told"]], r["n"]
            if r["pair"] < 0:
                counts[t] += n
                continue
            a, x = pairs[r["pair"]]
            seen[a, t] = seen.get((a, t), 0) + n
            said[a, x] = said.get((a, x), 0) + n
            hits[a, x] = hits.get((a, x), 0) + n * (x == t)
        if rounds > 10:  # figures that go back and forth are averaged over the rounds, so they settle
            step = 1 / (rounds - 9)
            for new, old in zip((seen, said, hits, counts), last):
                for key in new.keys() | old.keys():
                    new[key] = old.get(key, 0) + step * (new.get(key, 0) - old.get(key, 0))
        last = (seen, said, hits, counts)
        total = sum(counts.values())
        share = {x: counts[x] / total if per_label else 1 / k for x in labels}
        moved = 0.0
        every, right_n = dict.fromkeys(names, 0), dict.fromkeys(names, 0)
        for (a, _), n in said.items():
            every[a] += n
        for (a, _), n in hits.items():
            right_n[a] += n
        for a in names:
            new = (right_n[a] + smoothing) / (every[a] + 2 * smoothing)
            moved = max(moved, abs(new - accuracy[a]))
            accuracy[a] = new
            for x in by_name[a]:
                h = hits.get((a, x), 0)
                right = (h + smoothing * new) / (seen.get((a, x), 0) + smoothing)
                wrong = (said.get((a, x), 0) - h + smoothing * (1 - new) / (k - 1)) / (every[a] - seen.get((a, x), 0) + smoothing)
                weight[a, x] = max(-6.0, min(8.0, math.log(right / wrong))) if per_label else odds(new)
                trust[a, x] = (h + smoothing * new) / (said.get((a, x), 0) + smoothing)
        settled = moved < tolerance
    done = each.select("pattern", "votes").mapInArrow(decide, "pattern string, label string, n_annotators int, support double, agreement double")
    items = pattern.select("item_id", "pattern").join(done, "pattern").drop("pattern")
    best, worst, cast = {}, {}, dict.fromkeys(names, 0)
    for (a, _), t in trust.items():
        best[a], worst[a] = max(t, best.get(a, 0.0)), min(t, worst.get(a, 1.0))
    for r in used:
        cast[r["annotator"]] += r["n"]
    rows = [(a, float(accuracy[a]), best[a], worst[a], cast[a], rounds, settled) for a in names]
    return Consensus(items, votes.sparkSession.createDataFrame(rows, "annotator string, accuracy double, best_label_accuracy double, worst_label_accuracy double, n_votes long, rounds int, settled boolean"), rounds, settled)


def chance_corrected(votes: DataFrame) -> DataFrame:
    """One row (n_items, n_votes, observed, expected, alpha): agreement beyond chance with missing ratings.

    Krippendorff's alpha for nominal labels over clean votes; items of one vote pair nothing and do
    not count. alpha is null without pairs and 1 when only one label was ever used.
    """
    per = votes.groupBy("item_id", "label").agg(F.count("*").alias("c"))
    unit = per.groupBy("item_id").agg(F.sum("c").alias("m"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same")).where("m > 1")
    observed = unit.agg(F.count("*").alias("n_items"), F.sum("m").alias("n_votes"), F.sum(F.col("same") / (F.col("m") - 1)).alias("agree"))
    paired = per.join(unit.select("item_id"), "item_id", "left_semi").groupBy("label").agg(F.sum("c").alias("t"))
    expected = paired.agg(F.sum(F.col("t") * (F.col("t") - 1)).alias("chance"))
    n = F.col("n_votes")
    both = observed.crossJoin(expected).withColumn("observed", F.col("agree") / n).withColumn("expected", F.col("chance") / (n * (n - 1)))
    alpha = F.when(F.col("expected") == 1, F.lit(1.0)).otherwise((F.col("observed") - F.col("expected")) / (1 - F.col("expected")))
    return both.select("n_items", F.coalesce(n, F.lit(0)).alias("n_votes"), "observed", "expected", alpha.alias("alpha"))

"""Linking text to a vocabulary: exact, synonym, edit-distance, vector and full-text search, and ranking."""

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.sources.tables import materialize


def name_key(col: Column | str) -> Column:
    """Lower-cased text with blanks collapsed and trimmed."""
    return F.lower(F.trim(F.regexp_replace(col if isinstance(col, Column) else F.col(col), r"\s+", " ")))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group in ``order``, with their rank rn; Spark prunes groups before the shuffle."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rn") <= k)


def exact_link(probes: DataFrame, vocabulary: DataFrame, text: str, name: str, entry: str, k: int | None = 5) -> DataFrame:
    """(probe columns, entry, rn): up to k entries whose name equals the probe's text, smallest id first;
    with k None (probe columns, entry) of all of them."""
    v = vocabulary.select(entry, name_key(name).alias("_k")).where("_k <> ''").distinct()
    met = probes.withColumn("_k", name_key(text)).join(v, "_k").drop("_k")
    return met if k is None else top_k(met, probes.columns, [F.col(entry)], k)


def _deletions(text: Column, most: int) -> Column:
    """The text and what is left of it without any 1..most of its characters."""
    out = F.array(text)
    for _ in range(most):
        without = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(F.filter(out, lambda s: F.length(s) > 0), without))))
    return out


def fuzzy_link(probes: DataFrame, vocabulary: DataFrame, text: str, name: str, entry: str, most: int = 2, least_length: int = 5, k: int = 5) -> DataFrame:
    """(text, entry, distance, score, rn): entries whose name is within ``most`` edits of the probe.

    Two texts within d edits agree in at least one of d + 1 equal stretches one is cut into, so names
    and probes meet on such pieces at nearby places instead of all meeting all; texts too short for
    stretches of three characters meet on what is left when d characters are left out of each. Every
    probe text is handled once. Texts shorter than ``least_length`` are not probed.
    """
    p = probes.select(name_key(text).alias("q")).where(F.length("q") >= least_length).distinct()
    v = vocabulary.select(entry, name_key(name).alias("n")).where("n <> ''").distinct()
    parts = most + 1
    short = 3 * parts  # from this length on, every stretch has three characters or more
    # long texts meet on stretches: same length of the name, same stretch, at nearby places
    step = F.floor(F.length("q") / parts).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.struct((i * step + 1).alias("at"), F.substring(F.col("q"), i * step + 1, F.when(i == parts - 1, F.length("q")).otherwise(step)).alias("piece")))
    asked = p.where(F.length("q") >= short).select("q", F.explode(pieces).alias("x")).select("q", "x.*").withColumn("len", F.length("piece")).withColumn("size", F.explode(F.sequence(F.length("q") - most, F.length("q") + most)))
    asked = asked.withColumn("place", F.explode(F.sequence(F.greatest(F.col("at") - most, F.lit(1)), F.col("at") + most)))
    sizes = asked.select("size", "len").distinct()
    offered = v.withColumn("size", F.length("n")).join(sizes, "size").where(F.col("size") >= F.col("len"))
    offered = offered.select(entry, "n", "size", "len", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("len") + 1)).alias("place")).withColumn("piece", F.substring(F.col("n"), F.col("place"), F.col("len")))
    met = asked.join(offered, ["piece", "place", "len", "size"]).select("q", entry, "n")
    # short ones meet where they are the same after leaving out up to ``most`` characters each
    less = lambda c, to: F.explode(_deletions(F.col(c), most)).alias(to)
    few = p.where(F.length("q") < short).select("q", less("q", "rest")).join(v.where(F.length("n") < short + most).select(entry, "n", less("n", "rest")), "rest").select("q", entry, "n")
    met = met.unionByName(few).where(F.abs(F.length("q") - F.length("n")) <= most).distinct()
    met = met.withColumn("distance", F.levenshtein("q", "n", most)).where("distance >= 0")
    best = met.groupBy("q", entry).agg(F.min(F.struct("distance", "n")).alias("b")).select("q", entry, "b.distance", "b.n")
    ranked = top_k(best, ["q"], [F.col("distance"), F.col(entry)], k)
    return ranked.select(F.col("q").alias("text"), entry, "distance", F.round(1 - F.col("distance") / F.greatest(F.length("q"), F.length("n")), 4).alias("score"), "rn")


def unit_vector(col: Column | str) -> Column:
    """A vector of length one; null for null, empty or zero vectors."""
    v = F.transform(col, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    once = F.transform(F.array(F.struct(v.alias("v"), norm.alias("n"))), lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: x / s["n"])))
    return once[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; rows of length zero become NaN."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


class _Probes:
    """A block of probes as a matrix of unit vectors."""

    def __init__(self, rows: list, among: bool, extra: bool):
        self.ids = np.array([r["_p"] for r in rows])
        self.matrix = _unit(np.array([r["_a"] for r in rows], float).reshape(len(rows), -1))
        self.group = np.array([r["_g"] for r in rows], object) if among else None
        self.bound = np.array([r["_t"] for r in rows], float) if extra else None

    def similarities(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(item ids, similarities of items by probes); -inf where a pair does not count."""
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        vectors = batch.column(1)
        items = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        sims = np.round(_unit(items) @ self.matrix.T, 6)
        sims[np.isnan(sims)] = -np.inf
        sims[ids[:, None] == self.ids[None, :]] = -np.inf
        if self.group is not None:
            sims[batch.column(2).to_numpy(zero_copy_only=False).astype(object)[:, None] != self.group[None, :]] = -np.inf
        return ids, sims


def _probe_blocks(probes: DataFrame, items: DataFrame, probe_id: str, item_id: str, vector: str, among: str | None, bound: str | None, block: int):
    """(block of probes, items) for each block; at most about ``block`` numbers are held at a time."""
    extra = [F.col(among).alias("_g")] if among else []
    bounds = [F.col(bound).alias("_t")] if bound else []
    numbers = F.col(vector).cast("array<double>")
    asked = probes.select(F.col(probe_id).alias("_p"), numbers.alias("_a"), *extra, *bounds).where("size(_a) > 0")
    right = items.select(F.col(item_id).alias("_i"), numbers.alias("_b"), *([F.col(among).alias("_g")] if among else []))
    blocks = max(1, -(-(asked.agg(F.sum(F.size("_a"))).first()[0] or 0) // block))
    for b in range(blocks):
        own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("_p"), F.lit(blocks)) == b)
        by_length: dict[int, list] = {}
        for r in own.collect():
            by_length.setdefault(len(r["_a"]), []).append(r)
        for n, rows in sorted(by_length.items()):  # vectors of other lengths have nothing in common
            yield _Probes(rows, among is not None, bound is not None), right.where(F.size("_b") == n)


def nearest(probes: DataFrame, items: DataFrame, probe_id: str, item_id: str, vector: str, k: int, block: int = 4_000_000, among: str | None = None) -> DataFrame:
    """(probe_id, item_id, similarity, rn): the k most similar items of each of a stated set of probes.

    Probes go to the items in blocks of at most ``block`` numbers, however many there are; the items
    stay where they are. Each task multiplies its vectors with the block and keeps the k best per
    probe before anything is shuffled. With ``among`` only items of the probe's value in that column
    count. Ties go to the smaller id. Null, empty and zero vectors, and null ids, meet nothing.
    """
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    probe_kind, item_kind = kind(probes, probe_id), kind(items, item_id)
    out = items.sparkSession.createDataFrame([], f"_p {probe_kind}, _i {item_kind}, similarity double")
    for own, right in _probe_blocks(probes.where(F.col(probe_id).isNotNull()), items.where(F.col(item_id).isNotNull()), probe_id, item_id, vector, among, None, block):
        out = out.unionByName(right.mapInArrow(_best_of(own, k), f"_p {probe_kind}, _i {item_kind}, similarity double"))
    return top_k(out, ["_p"], [F.desc("similarity"), F.col("_i")], k).select(F.col("_p").alias(probe_id), F.col("_i").alias(item_id), "similarity", "rn")


def _best_of(own: _Probes, k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sims, probe = np.array([]), np.array([]), np.array([], int)
        types = None
        for batch in batches:
            types = batch.schema.field(0).type
            got, s = own.similarities(batch)
            at, p = np.nonzero(s > -np.inf)
            if k < len(got):  # the k-th best of the batch bounds what can stay; ties at it stay for the id to settle
                least = -np.partition(-s, k - 1, axis=0)[k - 1]
                keep = s[at, p] >= least[p]
                at, p = at[keep], p[keep]
            ids = np.concatenate([ids, got[at]]) if len(ids) else got[at]
            sims, probe = np.concatenate([sims, s[at, p]]), np.concatenate([probe, p])
            order = np.lexsort((ids, -sims, probe))
            ids, sims, probe = ids[order], sims[order], probe[order]
            first = np.searchsorted(probe, probe, side="left")
            keep = np.arange(len(probe)) - first < k
            ids, sims, probe = ids[keep], sims[keep], probe[keep]
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.array(own.ids[probe]), pa.array(ids, types), pa.array(sims)], names=["_p", "_i", "similarity"])

    return run


def count_more_similar(probes: DataFrame, items: DataFrame, probe_id: str, item_id: str, vector: str, bound: str, block: int = 4_000_000) -> DataFrame:
    """(probe_id, n): how many items are more similar to each probe than its ``bound``; one number per probe and task is shuffled."""
    probe_kind = probes.schema[probe_id].dataType.simpleString()
    out = items.sparkSession.createDataFrame([], f"_p {probe_kind}, n long")

    def counter(own: _Probes):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(len(own.ids), np.int64)
            for batch in batches:
                n += (own.similarities(batch)[1] > own.bound[None, :]).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(own.ids), pa.array(n)], names=["_p", "n"])

        return run

    for own, right in _probe_blocks(probes.where(F.col(probe_id).isNotNull()), items.where(F.col(item_id).isNotNull()), probe_id, item_id, vector, None, bound, block):
        out = out.unionByName(right.mapInArrow(counter(own), f"_p {probe_kind}, n long"))
    return out.groupBy(F.col("_p").alias(probe_id)).agg(F.sum("n").alias("n"))


def hashed_trigrams(texts: list[str], size: int = 256) -> np.ndarray:
    """A stand-in for a text encoder: counts of hashed character trigrams."""
    import zlib

    out = np.zeros((len(texts), size))
    for i, t in enumerate(texts):
        for k in range(len(t) + 1):
            out[i, zlib.crc32(f" {t} "[k : k + 3].encode()) % size] += 1
    return out


def semantic_link(probes: DataFrame, vocabulary: DataFrame, text: str, entry: str, encode, floor: float = 0.72, margin: float = 0.05) -> DataFrame:
    """(text, entry_id): the entry whose vector is most like the text's, at ``floor`` or more and without
    another entry within ``margin``. ``encode`` makes an array of vectors of a list of texts."""

    def vectors(df: DataFrame, key: str) -> DataFrame:
        kind = df.schema[key].dataType.simpleString()

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(encode(batch.column(1).to_pylist())), pa.list_(pa.float64()))], names=["id", "v"])

        return df.select(F.col(key).alias("id"), F.col(text).alias("t")).where("t IS NOT NULL AND id IS NOT NULL").mapInArrow(run, f"id {kind}, v array<double>")

    asked = vectors(probes.select(text).distinct().withColumn("_own", F.col(text)), "_own").withColumnRenamed("id", "_p")
    near = nearest(asked, vectors(vocabulary, entry).withColumnRenamed("id", "_i"), "_p", "_i", "v", 2)
    best = near.groupBy("_p").agg(F.max_by("_i", F.col("similarity") - F.col("rn") / 1e9).alias("entry_id"), F.max("similarity").alias("top"), F.min("similarity").alias("next"), F.count("*").alias("n"))
    return best.where((F.col("top") >= floor) & ((F.col("n") == 1) | (F.col("top") - F.col("next") >= margin))).select(F.col("_p").alias(text), "entry_id")


def domain_conflicts(probes: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(text, label, expected, concept_id, found): texts that name no entry of the expected domain, but some of others.

    probes: (text, label, expected); vocabulary: (concept_id, domain_id, text).
    """
    met = probes.join(vocabulary, "text").groupBy("text", "label", "expected").agg(F.min("concept_id").alias("concept_id"), F.array_join(F.array_sort(F.collect_set("domain_id")), "|").alias("found"), F.max(F.coalesce(F.col("domain_id") == F.col("expected"), F.lit(False))).alias("_own"))
    return met.where("NOT _own").drop("_own")


def bm25(texts: DataFrame, probes: DataFrame, text_id: str, text: str, probe_id: str, probe: str, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(probe_id, text_id, score, rn): the k best texts by Okapi BM25 over an inverted index.

    Terms are runs of a-z and 0-9 of the lower-cased text; a probe's repeated term counts once.
    Counts are over all texts; only texts that share a term with a probe are scored. A term of more
    than a tenth of the texts is dealt over 16 tasks, so none holds all of its texts.
    """
    terms = lambda c: F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda x: x != "")
    flat = texts.select(text_id, F.size(terms(F.col(text))).alias("len"), F.explode(terms(F.col(text))).alias("term"))
    tf = flat.groupBy(text_id, "len", "term").agg(F.count("*").alias("tf"))
    stats = texts.select(F.size(terms(F.col(text))).alias("len")).where("len > 0").agg(F.count("*").alias("n"), F.avg("len").alias("mean")).first()
    n, mean = stats["n"] or 0, stats["mean"] or 1.0
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / mean))
    asked = probes.select(probe_id, F.explode(F.array_distinct(terms(F.col(probe)))).alias("term"))
    hot = F.col("df") * 10 > max(n, 1000)
    asked = asked.join(df, "term").withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(15))).otherwise(F.array(F.lit(0)))))
    tf = tf.join(df.where(hot).select("term", F.lit(True).alias("hot")), "term", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64(text_id), F.lit(16))).otherwise(F.lit(0)).cast("int")).drop("hot")
    scored = asked.join(tf, ["term", "salt"]).groupBy(probe_id, text_id).agg(F.round(F.sum(weight), 6).alias("score"))
    return top_k(scored, [probe_id], [F.desc("score"), F.col(text_id)], k)


def fuse_ranks(rankings: dict[str, tuple[DataFrame, float]], probe_id: str, item_id: str, k: int, constant: int = 60) -> DataFrame:
    """(probe_id, item_id, score, rn): weighted reciprocal rank fusion of rankings with a rank rn."""
    parts = None
    for df, weight in rankings.values():
        part = df.select(probe_id, item_id, (F.lit(weight) / (constant + F.col("rn"))).alias("s"))
        parts = part if parts is None else parts.unionByName(part)
    fused = parts.groupBy(probe_id, item_id).agg(F.round(F.sum("s"), 9).alias("score"))
    return top_k(fused, [probe_id], [F.desc("score"), F.col(item_id)], k)


def cascade(probes: DataFrame, tiers: list[tuple[str, object]], key: str) -> DataFrame:
    """(key, entry_id, tier): the first tier that finds each probe; a tier sees only what is left.

    ``tiers`` are (name, function from probes to (key, entry_id)), cheapest first; what a tier finds and
    leaves is written to the shared folder, so none is computed twice.
    """
    left, out = probes, None
    for name, find in tiers:
        found = materialize(find(left).select(key, F.col("entry_id"), F.lit(name).alias("tier")), "tier")
        out = found if out is None else out.unionByName(found)
        left = materialize(left.join(found.select(key), key, "left_anti"), "left")
    return out.unionByName(left.select(key, F.lit(None).cast("long").alias("entry_id"), F.lit("none").alias("tier")))


def walk(start: DataFrame, edges: DataFrame, hops: list[str]) -> DataFrame:
    """(start, node): nodes reached by following the named relations in turn; distinct after each hop."""
    now = start.select(F.col("node").alias("start"), "node").distinct()
    for rel in hops:
        now = now.join(edges.where(F.col("rel") == rel).select(F.col("src").alias("node"), "dst"), "node").select("start", F.col("dst").alias("node")).distinct()
    return now


def ancestors(start: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """(start, node, hops): nodes up to ``most`` steps along (src, dst), with the fewest steps.

    Each step goes on only from what was not reached before, so a cycle ends; no node is its own
    ancestor. Steps are written to the shared folder, so none is computed twice.
    """
    steps = materialize(edges.select(F.col("src").alias("node"), "dst").distinct(), "edges")
    now = materialize(start.select(F.col("node").alias("start"), "node").distinct(), "reached")
    seen = now.withColumn("hops", F.lit(0))
    for n in range(1, most + 1):
        now = now.join(steps, "node").select("start", F.col("dst").alias("node")).distinct().join(seen, ["start", "node"], "left_anti")
        now = materialize(now, "reached")
        seen = seen.unionByName(now.withColumn("hops", F.lit(n)))
    return seen.where("hops > 0")


def crosswalk(concepts: DataFrame, edges: DataFrame, vocabulary: str, preferred: str) -> DataFrame:
    """(concept_id, snomed_id, code): each concept's own id and code if it is of ``vocabulary``, else those
    of the one it leads to along valid ``edges`` (src, dst, rel): over the ``preferred`` relation first,
    then of its own domain, then the smallest id; null if there is none.

    concepts: (concept_id, domain_id, vocabulary_id, concept_code).
    """
    of = concepts.where(F.col("vocabulary_id") == vocabulary).select(F.col("concept_id").alias("dst"), F.col("domain_id").alias("_d"), F.col("concept_code").alias("_code"))
    met = edges.join(of, "dst").join(concepts.select(F.col("concept_id").alias("src"), "domain_id"), "src")
    order = F.struct((F.col("rel") != preferred).alias("a"), F.coalesce(F.col("_d") != F.col("domain_id"), F.lit(True)).alias("b"), "dst")
    best = met.groupBy("src").agg(F.min_by(F.struct("dst", "_code"), order).alias("x"))
    own = F.col("vocabulary_id") == vocabulary
    out = concepts.join(best, F.col("src") == F.col("concept_id"), "left")
    return out.select("concept_id", F.when(own, F.col("concept_id")).otherwise(F.col("x.dst")).alias("snomed_id"), F.when(own, F.col("concept_code")).otherwise(F.col("x._code")).alias("code"))


def nearest_ancestor(start: DataFrame, edges: DataFrame, standard: DataFrame, most: int) -> DataFrame:
    """(start, node, hops): the standard node fewest steps above each start, never itself; ties go to the smaller node."""
    up = ancestors(start, edges, most).where("start <> node").join(standard.select("node").distinct(), "node", "left_semi")
    return up.groupBy("start").agg(F.min_by(F.struct("node", "hops"), F.struct("hops", "node")).alias("x")).select("start", "x.node", "x.hops")


def collapse_hierarchy(pool: DataFrame, edges: DataFrame, keys: list[str], entry: str, name: str, score: str, curated: str, place: str) -> DataFrame:
    """``pool`` with one survivor for each set of candidates that edges inside their own pool connect.

    ``keys`` name a pool, ``edges`` are (src, dst) of parents and children in either direction. A
    curated candidate beats any score, else the highest score wins, then the earlier ``place``; the
    survivor takes the place of its set's first member. Names with "and" or "&" are all kept as they
    are and survive nothing else, but their edges still connect others.
    """
    ids = pool.select(*keys, F.col(entry).alias("src")).distinct()
    pairs = ids.join(edges.select("src", "dst").where("src <> dst").distinct(), "src").join(ids.withColumnRenamed("src", "dst"), [*keys, "dst"]).select(*[F.col(k).alias(f"_{k}") for k in keys], "src", "dst")

    def reduce(cands: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        root = {x: x for x in cands[entry]}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in zip(pairs["src"], pairs["dst"]):
            root[find(a)] = find(b)
        cands = cands.sort_values(place, kind="stable")
        compound = cands[name].fillna("").str.contains(r"\b(?:and|&)\b", case=False)
        plain = cands[~compound].assign(_root=[find(x) for x in cands[~compound][entry]], _cur=cands[curated].fillna(False).astype(bool))
        first = plain.groupby("_root")[place].min()
        best = plain.sort_values(["_cur", score], ascending=False, kind="stable", na_position="last").drop_duplicates("_root")
        best = best.assign(**{place: best["_root"].map(first)})
        return pd.concat([cands[compound], best[cands.columns]])

    tied = pairs.select(*[F.col(f"_{k}").alias(k) for k in keys]).distinct()  # pools without an edge stay as they are
    reduced = pool.join(tied, keys, "left_semi").groupBy(*keys).cogroup(pairs.groupBy(*[f"_{k}" for k in keys])).applyInPandas(reduce, pool.schema)
    return pool.join(tied, keys, "left_anti").unionByName(reduced)


def context_rule_winner(mentions: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, meaning, score): the meaning whose context rules score highest for a mention.

    ``mentions`` are (key, abbreviation, before, after) with arrays of words and ``rules`` are
    (abbreviation, meaning, trigger_word, position, score) with position pre or post. The scores of the
    rules whose word stands on their side are added up, each word once; a tie gives no row.
    """
    side = lambda c, p: mentions.select(key, F.lower("abbreviation").alias("abbreviation"), F.lit(p).alias("position"), F.explode(F.array_distinct(c)).alias("trigger_word"))
    words = side("before", "pre").unionByName(side("after", "post"))
    total = words.join(rules, ["abbreviation", "position", "trigger_word"]).groupBy(key, "meaning").agg(F.round(F.sum("score"), 9).alias("score"))
    best = total.groupBy(key).agg(F.max("score").alias("score"))
    return total.join(best, [key, "score"]).groupBy(key).agg(F.min("meaning").alias("meaning"), F.min("score").alias("score"), F.count("*").alias("n")).where("n = 1").drop("n")

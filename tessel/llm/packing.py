"""Filling fixed-capacity containers with items (problem 8)."""

import base64
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.sources.tables import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_READY: dict[tuple[str, str], object] = {}


def _encoder(path: str, pattern: str):
    if (path, pattern) not in _READY:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _READY[path, pattern] = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _READY[path, pattern]


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens) of whole texts; null texts have no tokens and null ids give no row.

    ``vocabulary`` is a file of merge ranks that stands at the same path on every worker.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary, pattern).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32())], names=["doc_id", "n_tokens"])

    return documents.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, n_tokens int")


@dataclass
class Template:
    """So many containers filled with the same sizes, in the order they were put in."""

    count: int
    left: int
    slots: list[tuple[int, int]] = field(default_factory=list)  # (size, first rank among the items of that size)


def pack_histogram(counts: dict[int, int], capacity: int, tiers: int = 4) -> list[Template]:
    """Hierarchical packing of items known by their sizes alone.

    Sizes are routed to tiers, each half as long as the one above. Tier by tier, from the longest,
    items first fill the gaps that longer tiers left, the tightest gap first, and then open containers
    of their own, the longest item first. Equal containers are kept together as one template, so the
    work depends on the number of different sizes, not of items.
    """
    open_by: dict[int, list[Template]] = {}
    gaps = np.zeros(capacity + 1, np.int64)  # containers by space left
    edges = [capacity >> (t + 1) for t in range(tiers - 1)] + [0]
    done: list[Template] = []

    def put(t: Template, n: int) -> None:
        if t.left:
            open_by.setdefault(t.left, []).append(t)
            gaps[t.left] += n
        else:
            done.append(t)

    above = capacity
    for floor in edges:
        for size in sorted((s for s in counts if floor < s <= above), reverse=True):
            rank, left = 0, counts[size]
            while left:
                fit = np.flatnonzero(gaps[size:])
                if len(fit):
                    space = int(fit[0]) + size
                    t = open_by[space].pop()
                    use = min(left, t.count)
                    gaps[space] -= t.count
                    if use < t.count:
                        rest = Template(t.count - use, space, [(s, r + use) for s, r in t.slots])
                        open_by[space].append(rest)
                        gaps[space] += rest.count
                    t = Template(use, space - size, [*t.slots, (size, rank)])
                    put(t, use)
                else:
                    # as many as one container holds side by side, over and over
                    each = min(capacity // size, left)
                    use = left // each
                    t = Template(use, capacity - each * size, [(size, rank + i * use) for i in range(each)])
                    put(t, use)
                    use *= each
                rank += use
                left -= use
        above = floor
    return done + [t for ts in open_by.values() for t in ts]


def pack(sizes: DataFrame, capacity: int, *, step_containers: int = 64, salts: int = 256) -> DataFrame:
    """Containers of ``capacity`` tokens for every item.

    sizes: (doc_id, n_tokens), one row per document. Returns (doc_id, part, token_from, n_tokens,
    container, position, container_tokens, step_group). A text longer than the capacity is cut into
    full containers and a rest; no other text is cut. Documents of no tokens take no space and have
    container null. ``step_group`` deals the containers, fullest first, back and forth over groups of
    about ``step_containers``, so that groups hold about the same tokens.

    The driver packs the histogram of sizes, at most ``capacity`` numbers. Each item finds its place
    by its size and its rank among the items of that size; ranks are counted within salted parts of
    a size and shifted by the parts before, so a size that a third of all items have is no one task.
    """
    pieces = sizes.select("doc_id", "n_tokens").where("n_tokens > 0").select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity).cast("int"))).alias("part"))
    pieces = pieces.select("doc_id", "part", (F.col("part") * capacity).alias("token_from"), F.least(F.lit(capacity), F.col("n_tokens") - F.col("part") * capacity).cast("int").alias("size"))
    pieces = materialize(pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "part"), F.lit(salts)).cast("int")), "pieces")
    by_salt = pieces.groupBy("size", "salt").agg(F.count("*").alias("n"))
    before = by_salt.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("size", "salt", "before")
    ranked = pieces.withColumn("r", F.row_number().over(Window.partitionBy("size", "salt").orderBy("doc_id", "part")) - 1).join(before, ["size", "salt"]).withColumn("rank", F.col("before") + F.col("r"))
    counts = {r["size"]: r["n"] for r in by_salt.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    templates = sorted(pack_histogram(counts, capacity), key=lambda t: (t.left, t.slots))
    total = sum(t.count for t in templates)
    groups = max(1, -(-total // step_containers))
    base, slots = 0, {}
    for t in templates:
        offset = 0
        for position, (size, rank) in enumerate(t.slots):
            slots.setdefault(size, []).append((rank, base, position, offset, capacity - t.left))
            offset += size
        base += t.count
    table = {s: tuple(np.array(c) for c in zip(*sorted(rows))) for s, rows in slots.items()}

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (np.array(batch.column(c)) for c in ("size", "rank"))
            out = np.zeros((4, len(size)), np.int64)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                first, start, position, offset, full = table[int(s)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                out[:, at] = start[k] + rank[at] - first[k], position[k], offset[k], full[k]
            c = out[0]
            lap, step = c // groups, c % groups
            group = np.where(lap % 2 == 0, step, groups - 1 - step)
            cols = [batch.column(x) for x in ("doc_id", "part", "token_from", "size")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(c), pa.array(out[1].astype(np.int32)), pa.array(out[2].astype(np.int32)), pa.array(out[3].astype(np.int32)), pa.array(group)], names=["doc_id", "part", "token_from", "n_tokens", "container", "position", "container_offset", "container_tokens", "step_group"])

    schema = "doc_id long, part int, token_from int, n_tokens int, container long, position int, container_offset int, container_tokens int, step_group long"
    placed = ranked.select("doc_id", "part", "token_from", "size", "rank").mapInArrow(place, schema)
    empty = sizes.where("n_tokens = 0").select("doc_id", F.lit(0).alias("part"), F.lit(0).alias("token_from"), F.lit(0).alias("n_tokens"), *(F.lit(None).cast(t).alias(c) for c, t in (("container", "long"), ("position", "int"), ("container_offset", "int"), ("container_tokens", "int"), ("step_group", "long"))))
    return placed.unionByName(empty)

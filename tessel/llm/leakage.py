"""Evaluation texts leaking into training text (problem 9)."""

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.looks import plain_words

_BASE = np.uint64(1_000_003)


def _rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin codes of every run of k ids; 0 where the run holds an unknown word (id 0)."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    code = np.zeros(n, np.uint64)
    known = np.ones(n, bool)
    for i in range(k):
        part = ids[i : i + n]
        code = code * _BASE + part
        known &= part > 0
    return np.where(known, code, np.uint64(0))


class Tests:
    """Test items as word numbers with an index of their seeds."""

    def __init__(self, items: list[tuple[int, str]], seed: int):
        self.seed = seed
        self.number: dict[str, int] = {}
        self.ids: list[int] = []
        self.words: list[list[int]] = []
        codes, where = [], []
        for item, text in items:
            words = [self.number.setdefault(w, len(self.number) + 1) for w in plain_words(text)]
            own = _rolling(np.array(words, np.uint64), seed)
            codes.append(own)
            where.append(np.stack([np.full(len(own), len(self.ids)), np.arange(len(own))], 1))
            self.ids.append(item)
            self.words.append(words)
        self.lengths = np.array([max(1, len(w)) for w in self.words])
        flat = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        places = np.concatenate(where) if where else np.zeros((0, 2), int)
        order = np.argsort(flat, kind="stable")
        self.codes, first, count = np.unique(flat[order], return_index=True, return_counts=True)
        self.places, self.first, self.count = places[order], first, count
        self.slot = np.repeat(np.arange(len(count)), count)  # the seed of each row of places

    def shared(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the text, number of the seed) of each seed of the text that an item has."""
        codes = _rolling(ids, self.seed)
        at = np.flatnonzero(codes)
        if not len(at) or not len(self.codes):
            return at[:0], at[:0]
        slot = np.searchsorted(self.codes, codes[at])
        slot[slot == len(self.codes)] = 0
        ok = self.codes[slot] == codes[at]
        return at[ok], slot[ok]

    def candidates(self, slots: np.ndarray, need: int, coverage: float) -> Iterator[tuple[int, np.ndarray, int]]:
        """(item, rows of its shared seeds in ``places``, number of them) of the items a text may leak.

        An item stays when it shares ``need`` seeds, or when its words under shared seeds, of which its
        tiles can only be a part, reach ``coverage``. Each seed of the items counts once here, however
        often the text repeats it.
        """
        n = self.count[slots]
        rows = np.repeat(self.first[slots], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        item, q = self.places[rows, 0], self.places[rows, 1]
        order = np.lexsort((q, item))
        rows, item, q = rows[order], item[order], q[order]
        step = np.full(len(q), self.seed)
        same = item[1:] == item[:-1]
        step[:-1][same] = np.minimum(self.seed, (q[1:] - q[:-1])[same])
        own, first, count = np.unique(item, return_index=True, return_counts=True)
        words = np.add.reduceat(step, first)
        for k in np.flatnonzero((count >= need) | (words >= coverage * self.lengths[own])):
            yield int(own[k]), rows[first[k] : first[k] + count[k]], int(count[k])


def matches(item: list[int], text: list[int], seeds: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(item place, text place, length) of the maximal equal runs that hold the seeds, longest first."""
    found = set(seeds)
    runs = []
    for q, p in seeds:
        if (q - 1, p - 1) in found:
            continue
        n = 0
        while q + n < len(item) and p + n < len(text) and item[q + n] == text[p + n]:
            n += 1
        if n:
            runs.append((q, p, n))
    return sorted(runs, key=lambda r: (-r[2], r[0], r[1]))


def tiles(item: list[int], text: list[int], runs: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling from maximal runs: (item place, text place, length), longest first, none overlapping.

    The longest unmarked run is marked in both texts; what it overlaps is cut down to what is left and
    competes again.
    """
    marked_item, marked_text = bytearray(len(item)), bytearray(len(text))
    out = []
    heap = [(-n, q, p) for q, p, n in runs if n >= least]
    heapq.heapify(heap)
    while heap:
        n, q, p = heapq.heappop(heap)
        n = -n
        free = [not (marked_item[q + i] or marked_text[p + i]) for i in range(n)]
        if all(free):
            marked_item[q : q + n] = b"\1" * n
            marked_text[p : p + n] = b"\1" * n
            out.append((q, p, n))
            continue
        i = 0
        while i < n:
            j = i
            while j < n and free[j]:
                j += 1
            if j - i >= least:
                heapq.heappush(heap, (i - j, q + i, p + i))
            i = j + 1
    return out


def _edits(a: list[int], b: list[int]) -> int:
    if not a or not b:
        return len(a) + len(b)
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def _ends(a: list[int], b: list[int], most: int) -> list[tuple[int, int]]:
    """(words of a, edits) of the ways to go on into a with at most so many edits, each ending in an equal word."""
    out = [(0, 0)]
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        best = None
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
            if x == y and (best is None or last[j - 1] < best):
                best = last[j - 1]
        if best is not None and best <= most:
            out.append((i, best))
        if min(row) > most:
            break
        last = row
    return out


def longest_stretch(item: list[int], text: list[int], runs: list[tuple[int, int, int]], share: float, least: int, seed: int) -> int:
    """Words of the longest stretch of the item that stands in the text with at most ``share`` edits.

    Every stretch is a chain of equal runs with edits between them. From each run all later ones are
    reached at the fewest edits, within the widest gap that so many edits can leave without a seed, and
    both ends go on as long as words agree. Returns 0 when no stretch of ``least`` words is near enough.
    """
    most = int(share * len(item) + 1e-9)
    gap = (seed - 1) * (most + 1) + most
    order = sorted(runs, key=lambda r: (r[1], r[0]))
    lefts: dict[int, list] = {}
    rights: dict[int, list] = {}
    best = 0
    for s, (q0, p0, _) in enumerate(order):
        cost = {s: 0}
        for t in range(s, len(order)):
            q, p, n = order[t]
            if p - p0 > len(item) + most:
                break
            if t != s:
                few = None
                for u, c in cost.items():
                    qu, pu, nu = order[u]
                    cut = max(qu + nu - q, pu + nu - p, 0)
                    if cut >= n or q < qu or max(q + cut - qu - nu, p + cut - pu - nu) > gap + most:
                        continue
                    between = _edits(item[qu + nu : q + cut], text[pu + nu : p + cut])
                    if c + between <= most and (few is None or c + between < few):
                        few = c + between
                if few is None:
                    continue
                cost[t] = few
            if s not in lefts:
                lefts[s] = _ends(item[max(0, q0 - gap) : q0][::-1], text[max(0, p0 - gap - most) : p0][::-1], most)
            if t not in rights:
                rights[t] = _ends(item[q + n : q + n + gap], text[p + n : p + n + gap + most], most)
            for kl, el in lefts[s]:
                for kr, er in rights[t]:
                    words = q + n - q0 + kl + kr
                    if words >= least and words > best and cost[t] + el + er <= share * words + 1e-9:
                        best = words
    return best


def find_leaks(
    documents: DataFrame,
    items: DataFrame,
    *,
    least: int = 20,
    share: float = 0.1,
    seed: int = 5,
    coverage: float = 0.5,
    block: int = 4_000_000,
) -> DataFrame:
    """Documents that hold passages of test items, fully or partly.

    documents: (doc_id, text); items: (item_id, text). Returns (doc_id, item_id, covered, stretch):
    ``covered`` is the share of the item's words under tiles, in whatever order they stand, and
    ``stretch`` the words of its longest stretch kept with at most ``share`` edits (0 if none has
    ``least`` words). A pair is returned when it has such a stretch or ``covered`` reaches ``coverage``.

    Words are compared without case, punctuation, line layout, bracketed codes and odd characters.
    Seeds of ``seed`` equal words, found by rolling hash, are joined with an index of the items' seeds.
    A stretch of ``least`` words with so few edits has at least
    ``least - edits - (seed - 1) * (edits + 1)`` of them, and tiles cover no word outside a shared
    seed; only pairs below both bounds are left out. The index goes to every task, for items of at most
    ``block`` characters at a time (or one longer item); more items take further passes over the
    documents, and nothing of the documents is moved.

    Null or blank texts and items of fewer than ``seed`` words give no row; items of fewer than
    ``least`` words are found by coverage only; repeated documents are each reported, repeated item
    rows once. A text may be of any length and may repeat a passage any number of times.
    """
    edits = int(least * share)
    need = max(1, least - edits - (seed - 1) * (edits + 1))
    items = items.select(F.col("item_id").cast("long"), F.col("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block))
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    out = None
    for b in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        tests = Tests(sorted((r["item_id"], r["text"]) for r in own.collect()), seed)
        part = docs.mapInArrow(_finder(tests, least, share, need, coverage), "doc_id long, item_id long, covered double, stretch int")
        out = part if out is None else out.unionByName(part)
    return out


def _finder(tests: Tests, least: int, share: float, need: int, coverage: float):
    number, seed = tests.number.get, tests.seed

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = [number(w, 0) for w in plain_words(text)]
                if len(words) < seed:
                    continue
                at, slot = tests.shared(np.array(words, np.uint64))
                if not len(at):
                    continue
                order = np.argsort(slot, kind="stable")
                slots, first, count = np.unique(slot[order], return_index=True, return_counts=True)
                places = at[order]
                of = None
                for item, where, n in tests.candidates(slots, need, coverage):
                    own = tests.words[item]
                    if of is None:
                        of = {int(x): places[f : f + c].tolist() for x, f, c in zip(slots, first, count)}
                    seeds = [(int(tests.places[r, 1]), p) for r in where for p in of[int(tests.slot[r])]]
                    runs = matches(own, words, seeds)
                    covered = sum(n for _, _, n in tiles(own, words, runs, seed)) / len(own)
                    stretch = longest_stretch(own, words, runs, share, least, seed) if n >= need else 0
                    if stretch or covered >= coverage:
                        rows.append((doc, tests.ids[item], covered, stretch))
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int32())], names=["doc_id", "item_id", "covered", "stretch"])

    return run

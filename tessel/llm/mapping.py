"""Mapping free-entered values to the entries of a reference list (problem 1)."""

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.sources.tables import materialize

# Digits typed for letters.
DIGITS = str.maketrans("01345789", "oleastbg")
# Words that set entries apart by the statement of the problem; a value and its entry must agree on them.
OPPOSITES = (frozenset({"acute", "chronic"}), frozenset({"serum", "urine"}))


class Lexicon:
    """What the words of the list and of the values are: general words of names, with their
    abbreviations, and remarks, which stand around names and name nothing."""

    def __init__(self, general: Iterable[str], remarks: Iterable[str] = ()):
        self.general = frozenset(general)
        self.remarks = frozenset(remarks) - self.general
        self.longer: dict[str, str | None] = {}
        for g in sorted(self.general):
            for n in range(2, len(g) - 1):
                self.longer[g[:n]] = None if g[:n] in self.longer else g


def words_of(text: str | None, lexicon: Lexicon) -> list[str]:
    """The words of a value or name in one spelling; abbreviated general words are written out."""
    text = unicodedata.normalize("NFKC", text or "").casefold().replace("’", "'")
    text = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", text)
    text = re.sub(r"'s\b", "", text)
    if re.fullmatch(r"\W*(?:[a-z]\W{0,2}){2,6}\W*", text) and re.search(r"[a-z][.\-_/][a-z]", text):
        return ["".join(re.findall("[a-z]", text))]
    out = []
    for word, dot in re.findall(r"([^\W_]+)(\.*)", text):
        if any(c.isdigit() for c in word):
            if sum(c.isalpha() for c in word) < 3:
                continue
            word = word.translate(DIGITS)
        if word not in lexicon.general and (dot or len(word) <= 5):
            word = lexicon.longer.get(word) or word
        out.append(word)
    return out


def forms_of(text: str | None, lexicon: Lexicon) -> list[str]:
    """Readings of a value: its words without remarks, these with neighbouring particular words joined,
    and all words so joined, as half a word can look like a remark."""
    words = words_of(text, lexicon)
    plain = [w for w in words if w not in lexicon.remarks]
    readings = [plain]
    for source in (plain, words):
        joined: list[str] = []
        for w in source:
            if joined and w not in lexicon.general and joined[-1] not in lexicon.general:
                joined[-1] += w
            else:
                joined.append(w)
        readings.append(joined)
    return [x for x in dict.fromkeys(map(" ".join, readings)) if x]


def grams_of(form: str, general: frozenset[str]) -> set[str]:
    """The character bigrams and trigrams of each word, its ends marked in the trigrams; those of general words are kept apart."""
    out = set()
    for w in form.split():
        mark = "~" if w in general else ""
        out.update(f"{mark}{g}" for g in [f"#{w}#"[i : i + 3] for i in range(len(w))] + [w[i : i + 2] for i in range(len(w) - 1)])
    return out


def _near(a: str, b: str, most: int) -> bool:
    """Whether two words are at most so many edits apart; neighbours swapped count as one."""
    if abs(len(a) - len(b)) > most:
        return False
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return False
        before, last = last, row
    return last[-1] <= most


def _meant(words: Iterable[str], group: frozenset[str]) -> set[str]:
    return {g for g in group for w in words if w == g or (len(w) >= 4 and _near(w, g, 1)) or (len(w) >= 2 and g.startswith(w) and len(w) < len(g))}


def sides_of(form: str) -> int:
    """Which of the opposite words a form has, as bits."""
    words = form.split()
    return sum(1 << (2 * i + j) for i, group in enumerate(OPPOSITES) if (meant := _meant(words, group)) for j, g in enumerate(sorted(group)) if g in meant)


def names_same(value: str, name: str, general: frozenset[str]) -> bool:
    """Exact check of an accepted pair: the particular words of a name stand in the value, give or take
    typing slips: one in words of five letters or more, two in words of nine."""
    mine, theirs = value.split(), name.split()
    own = [w for w in theirs if w not in general]
    if not own:
        return mine == theirs
    return all(any(_near(w, m, 0 if len(w) <= 4 else 1 + (len(w) >= 9)) for m in mine) for w in own)


class Index:
    """Inverted index of the grams of names, with their weights, for cosines."""

    def __init__(self, names: list[tuple], lexicon: Lexicon, weight: dict[str, float], unseen: float):
        """names: (form, [(entry id, kind, usable)])."""
        self.lexicon, self.weight, self.unseen = lexicon, weight, unseen
        self.names = names
        postings: dict[str, list[int]] = {}
        norms = []
        for i, (form, _) in enumerate(names):
            grams = grams_of(form, lexicon.general)
            norms.append(math.sqrt(sum(self._w(g) ** 2 for g in grams)) or 1.0)
            for g in grams:
                postings.setdefault(g, []).append(i)
        self.postings = {g: np.array(p, np.int32) for g, p in postings.items()}
        self.norms = np.array(norms)
        self.sides = np.array([sides_of(form) for form, _ in names], np.int32)

    def _w(self, gram: str) -> float:
        return self.weight.get(gram, self.unseen) * (GENERAL if gram[0] == "~" else 1.0)

    def search(self, form: str, threshold: float, margin: float) -> list[tuple[float, int]]:
        """(cosine, name) of the names that agree on opposite words, reach the threshold and are within
        the margin of the best of this index."""
        grams = grams_of(form, self.lexicon.general)
        norm = math.sqrt(sum(self._w(g) ** 2 for g in grams))
        hit = [(self.postings[g], self._w(g) ** 2) for g in grams if g in self.postings]
        if not hit:
            return []
        dots = np.bincount(np.concatenate([p for p, _ in hit]), np.repeat([w for _, w in hit], [len(p) for p, _ in hit]), len(self.names))
        cosine = np.where(self.sides == sides_of(form), dots / (self.norms * norm), 0.0)
        at = np.flatnonzero(cosine >= max(threshold, cosine.max() - margin))
        return [(min(1.0, round(float(cosine[i]), 9)), int(i)) for i in at]


#: How much less a gram of a general word weighs than one of a particular word.
GENERAL = 0.6


def general_words(names: DataFrame, *, beside: int = 5, most: int = 1_000_000) -> frozenset[str]:
    """Words that name nothing in particular: they stand beside ``beside`` different words each rarer than themselves.

    A particular word is the rarest of its names, whatever the size of the list. At most ``most`` are held.
    """
    each = names.select(F.monotonically_increasing_id().alias("id"), F.array_distinct(F.split(F.lower("name"), r"[^\p{L}\p{N}]+")).alias("ws"))
    words = each.select("id", F.explode("ws").alias("w")).where("w <> ''")
    words = words.join(words.groupBy("w").agg(F.count("*").alias("df")), "w")
    rarest = words.groupBy("id").agg(F.min(F.struct("df", "w")).alias("r"))
    rows = words.join(rarest, "id").where("r.df < df").groupBy("w").agg(F.countDistinct("r.w").alias("n")).where(F.col("n") >= beside).select("w").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} general words")
    return frozenset(r["w"] for r in rows)


def _words(df: DataFrame, text: str, lexicon: Lexicon) -> DataFrame:
    """(text, words) of each distinct text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t, lexicon) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], names=["text", "words"])

    return df.select(F.col(text).alias("text")).where("text IS NOT NULL").distinct().mapInArrow(run, "text string, words array<string>")


def remark_words(values: DataFrame, names: DataFrame, lexicon: Lexicon, *, beside: int = 5, most: int = 1_000_000) -> frozenset[str]:
    """Words of values that no name has and that stand around ``beside`` different names: status words,
    doses, marks, and frequent slips in general words. At most ``most`` are held.

    A value speaks for the first of the particular words it has exactly; a slip in a particular word
    stands beside none, so it is never taken for a remark. Words that may mean an opposite are none.
    """
    listed = _words(names, "name", lexicon).select(F.explode("words").alias("w")).distinct()
    particular = listed.where(~F.col("w").isin(sorted(lexicon.general))) if len(lexicon.general) < 1000 else listed.join(names.sparkSession.createDataFrame([(g,) for g in sorted(lexicon.general)], "w string"), "w", "left_anti")
    used = _words(values, "value", lexicon).select("text", F.explode(F.array_distinct("words")).alias("w"))
    about = used.join(particular, "w").groupBy("text").agg(F.min("w").alias("about"))
    rows = used.join(listed, "w", "left_anti").join(about, "text").groupBy("w").agg(F.countDistinct("about").alias("n")).where(F.col("n") >= beside).select("w").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} remark words")
    return frozenset(r["w"] for r in rows if not any(_meant([r["w"]], g) for g in OPPOSITES))


_FOUND = "value string, best double, entry_id long, kind string, usable boolean, score double, name string"


def _searcher(index: Index, threshold: float, margin: float):
    kinds = (pa.string(), pa.float64(), pa.int64(), pa.string(), pa.bool_(), pa.float64(), pa.string())
    columns = [c.split()[0] for c in _FOUND.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(0).to_pylist():
                near = [(score, i, form) for form in forms_of(value, index.lexicon) for score, i in index.search(form, threshold, margin)]
                if not near:
                    continue
                top = max(score for score, _, _ in near)
                best: dict[int, tuple] = {}
                for score, i, form in near:
                    name, entries = index.names[i]
                    if score >= top - margin and names_same(form, name, index.lexicon.general):
                        for entry, kind, usable in entries:
                            if entry not in best or (score, name) > best[entry][2:]:
                                best[entry] = (kind, usable, score, name)
                held: dict[str | None, int] = {}
                for entry, (kind, usable, score, name) in sorted(best.items(), key=lambda x: (-x[1][2], x[0])):
                    held[kind] = held.get(kind, 0) + 1
                    if held[kind] <= 2:  # the two best of each kind say all that the margin and the kind can ask
                        rows.append((value, top, entry, kind, usable, score, name))
                if not best:
                    rows.append((value, top, None, None, None, None, None))
            cols = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=columns)

    return run


def map_values(
    values: DataFrame,
    names: DataFrame,
    *,
    threshold: float = 0.25,
    margin: float = 0.05,
    block: int = 2_000_000,
    most_grams: int = 2_000_000,
) -> DataFrame:
    """Map each distinct value to the entry of the list it means.

    values: (value, kind). names: (entry_id, kind, name, usable), a row per name or second name.
    Returns (value, kind, entry_id, matched_name, score, status), a row per distinct (value, kind);
    status is matched, unmatched, ambiguous, withdrawn (the entry is not usable) or blank.

    Values are deduplicated and brought to one spelling. Which words are general is learned from the
    list, which are remarks from the values. Every value is scored against all names that share one
    of its character bigrams or trigrams, through an inverted index of the names, by the cosine
    weighted by the rarity of grams in the list; names that differ on an opposite word are no
    candidates. Entries at ``threshold`` or more and within ``margin`` of the best compete (0: only
    the best ones); of these, an exact check strikes out those whose particular words do not stand in
    the value. What is left is taken if it is one entry, or if one of them alone has the value's kind.

    The index goes to every task, for names of at most ``block`` characters at a time (or one longer
    name); a longer list takes further passes over the distinct values, and no values are moved for
    it. Weights of grams that several names have are held for all, at most ``most_grams``.

    Null and blank values have status blank; ties no kind settles are ambiguous; an empty list
    leaves every value unmatched; repeated rows count once; null kinds settle no tie.
    """
    names = materialize(names.select("entry_id", "kind", "name", "usable").where(F.col("name").isNotNull()).distinct(), "names")
    distinct = materialize(values.select("value", "kind").distinct(), "values")
    general = general_words(names).union(*OPPOSITES)
    lexicon = Lexicon(general, remark_words(distinct, names, Lexicon(general)))

    plain = Lexicon(general)
    listed = names.join(_words(names, "name", plain).select(F.col("text").alias("name"), F.array_join("words", " ").alias("form")), "name").where("form <> ''")
    listed = materialize(listed.groupBy("form").agg(F.array_sort(F.collect_set(F.struct("entry_id", "kind", "usable"))).alias("entries")), "forms")

    def grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([g for f in batch.column(0).to_pylist() for g in grams_of(f, general)], pa.string())], names=["gram"])

    size = listed.agg(F.count("*").alias("n"), F.sum(F.length("form")).alias("chars")).first()
    often = listed.select("form").mapInArrow(grams, "gram string").groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").limit(most_grams + 1).collect()
    if len(often) > most_grams:
        raise ValueError(f"more than {most_grams} character grams")
    unseen = math.sqrt(math.log(1 + (size["n"] or 1)))  # also the weight of a gram of one name
    weight = {r["gram"]: math.sqrt(math.log(1 + size["n"] / r["n"])) for r in often}

    asked = distinct.select("value").where("value IS NOT NULL").distinct().repartition("value")
    blocks = max(1, -(-(size["chars"] or 0) // block))
    hits = None
    for b in range(blocks):
        own = listed if blocks == 1 else listed.where(F.pmod(F.xxhash64("form"), F.lit(blocks)) == b)
        index = Index(sorted((r["form"], [tuple(e) for e in r["entries"]]) for r in own.collect()), lexicon, weight, unseen)
        part = asked.mapInArrow(_searcher(index, threshold, margin), _FOUND)
        hits = part if hits is None else hits.unionByName(part)
    best = hits.groupBy("value").agg(F.max("best").alias("best"))
    hits = hits.drop("best").join(best, "value").where("entry_id IS NULL OR score >= best - %r" % margin) if blocks > 1 else hits
    entries = hits.where("entry_id IS NOT NULL").groupBy("value", "entry_id", "kind", "usable").agg(F.max(F.struct("score", "name")).alias("top"))
    if blocks > 1:
        w = Window.partitionBy("value", "kind").orderBy(F.col("top.score").desc(), "entry_id")
        entries = entries.withColumn("rn", F.row_number().over(w)).where("rn <= 2").drop("rn")
    close = entries.groupBy("value").agg(F.collect_list(F.struct("entry_id", F.col("kind").alias("entry_kind"), "usable", "top.score", "top.name")).alias("close"))
    own = F.filter("close", lambda x: x["entry_kind"] == F.col("kind"))
    win = F.when(F.size("close") == 1, F.col("close")[0]).when(F.size("own") == 1, F.col("own")[0])
    taken = distinct.join(close, "value", "left").withColumn("own", own).withColumn("win", win)
    status = F.when(F.trim("value").isNull() | (F.trim("value") == ""), "blank").when(F.col("close").isNull(), "unmatched").when(F.col("win").isNull(), "ambiguous").when(F.col("win.usable"), "matched").otherwise("withdrawn")
    return taken.select("value", "kind", F.when(F.col("win.usable"), F.col("win.entry_id")).alias("entry_id"), F.col("win.name").alias("matched_name"), F.col("win.score").alias("score"), status.alias("status"))

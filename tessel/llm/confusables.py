"""Visually identical text with different characters (problem 10)."""

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.looks import TO_LATIN, look, plain_widths
from tessel.sources.tables import materialize

# The blocks of Greek and Cyrillic letters; a letter keeps the marks that follow it.
_GREEK_CYRILLIC = "\u0370-\u03ff\u0400-\u052f\u1f00-\u1fff"
_MARK = "\u0300-\u036f"
_LETTER = rf"(?:[^\W\d_][{_MARK}]*+)"
_WORD = re.compile(rf"{_LETTER}++")
_FOREIGN = re.compile(f"[{_GREEK_CYRILLIC}]")
_TWINS = frozenset(map(chr, TO_LATIN)) | frozenset("".join(TO_LATIN.values()))


def script_of(c: str) -> str:
    code = ord(c)
    if code < 0x250 or 0x1E00 <= code <= 0x1EFF:
        return "latin"
    if 0x370 <= code <= 0x3FF or 0x1F00 <= code <= 0x1FFF:
        return "common" if c == "μ" else "greek"
    return "cyrillic" if 0x400 <= code <= 0x52F else unicodedata.name(c, "other").split()[0].lower()


class _Letters(dict):
    """Character to (its script, whether it tells the script of its word); filled as characters come up.

    A letter tells nothing when a letter of another script looks the same, with or without marks.
    """

    def __missing__(self, c: str) -> tuple[str, bool]:
        script = script_of(c) if c.isalpha() else "common"
        self[c] = out = (script, script != "common" and unicodedata.normalize("NFD", c)[0] not in _TWINS)
        return out


_LETTERS = _Letters()


def dominant(text: str, otherwise: str) -> str:
    """The script of most letters that have no look-alike in another; ``otherwise`` if there are none or as many of it."""
    kinds: Counter = Counter()
    for c, n in Counter(text).items():
        script, tells = _LETTERS[c]
        if tells:
            kinds[script] += n
    if not kinds:
        return otherwise
    top = max(kinds.values())
    return otherwise if kinds[otherwise] == top else min(s for s, n in kinds.items() if n == top)


def _scripts(word: str) -> set[str]:
    return {s for s, _ in map(_LETTERS.__getitem__, word)} - {"common"}


def odd_words(text: str, words: set[str]) -> list[tuple[str, str]]:
    """(word, script it should be in) of the words of a text that hold letters of another script than their own.

    A word's script is the dominant one of its letters that could be of no other; a word all of whose
    letters could is of the text's script. So words that look the same in texts that look the same
    always get the same script.
    """
    if not _FOREIGN.search(text):
        return []
    main = dominant(text, "latin")
    found = []
    for w in sorted(words):
        if main == "latin" and w.isascii():
            continue
        own = _scripts(w)
        if own == {main}:
            continue
        script = dominant(w, main)
        if own - {script}:
            found.append((w, script))
    return found


_PAIR = pa.struct([("word", pa.string()), ("script", pa.string()), ("look", pa.string())])
_SCHEMA = "doc_id long, exact binary, look binary, body string, odd array<struct<word:string,script:string,look:string>>, seen array<struct<word:string,script:string,look:string>>"


def _digest(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()


def _first(with_text: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[str] = set()
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                plain = plain_widths(text)
                words = set(_WORD.findall(plain))
                odd = odd_words(plain, words)
                new = words - known - {w for w, _ in odd}
                if len(known) > 1_000_000:
                    known = set()
                known |= new
                seen = [{"word": w, "script": next(iter(k), "common") if len(k := _scripts(w)) < 2 else "mixed", "look": look(w)} for w in sorted(new)]
                shows = not plain.isspace() and plain != ""
                out.append((doc, _digest(text), _digest(plain) if shows and not odd else None, plain if odd or with_text else None, [{"word": w, "script": s, "look": look(w)} for w, s in odd] if shows else [], seen))
            cols = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.list_(_PAIR), pa.list_(_PAIR))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "exact", "look", "body", "odd", "seen"])

    return run


def _repair(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, exact, body, fixes in zip(*(c.to_pylist() for c in batch.columns)):
            swap = {f["word"]: f["right"] for f in fixes or []}
            text = _WORD.sub(lambda m: swap.get(m[0], m[0]), body) if swap else body
            out.append((doc, exact, _digest(text), text, len(swap)))
        cols = list(zip(*out)) or [()] * 5
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "exact", "look", "text", "repaired"])


def unify_texts(documents: DataFrame, with_text: bool = True, repair: bool = True) -> DataFrame:
    """Every text in one form in which equal looks mean equal strings.

    documents: (doc_id, text). Returns (doc_id, exact, look, text, repaired): digests of the text as
    written and of its unified form, that form, and how many of its words were repaired. Without
    ``with_text`` the text is only given where words had to be looked up; without ``repair`` words
    stay as they are.

    Widths, blanks, invisible characters and composed accents are folded per character. A word that
    holds letters foreign to its script (see odd_words) is replaced by the word of that script which
    looks the same, if the corpus has it; all words of the corpus are its vocabulary. Where the corpus
    has it in no pure form, the forms it has are written as the first of them in string order, so words
    of one look end up the same in either case. Raised figures, accents, case and line breaks count
    as visible.

    Null ids or texts give no row, texts without a visible character a null ``look``; repeated rows
    count once. Long texts are read whole. Only texts with doubtful words are shuffled.
    """
    source = documents.select(F.col("doc_id").cast("long"), F.col("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    first = materialize(source.mapInArrow(_first(with_text), _SCHEMA), "looks")
    odd = first.select(F.explode("odd").alias("o")).select("o.*").distinct()
    words = first.select(F.explode("seen").alias("s")).select("s.*").where("script <> 'mixed'").groupBy("script", "look").agg(F.min("word").alias("pure"))
    forms = odd.groupBy("script", "look").agg(F.min("word").alias("form"))
    best = forms.join(words, ["script", "look"], "left").select("script", "look", F.coalesce("pure", "form").alias("right"))
    right = odd.join(best, ["script", "look"]).where("word <> right").select("word", "script", "right")
    doubtful = first.where(F.size("odd") > 0).select("doc_id", "exact", "body", "odd").dropDuplicates(["doc_id", "exact"])
    each = doubtful.select("doc_id", "exact", F.explode("odd").alias("o")).select("doc_id", "exact", "o.word", "o.script")
    fixes = each.join(right if repair else right.limit(0), ["word", "script"]).groupBy("doc_id", "exact").agg(F.collect_list(F.struct("word", "right")).alias("fixes"))
    repaired = doubtful.join(fixes, ["doc_id", "exact"], "left").select("doc_id", "exact", "body", "fixes").mapInArrow(_repair, "doc_id long, exact binary, look binary, text string, repaired int")
    sound = first.where(F.size("odd") == 0).select("doc_id", "exact", "look", F.col("body").alias("text"), F.lit(0).alias("repaired"))
    return sound.dropDuplicates(["doc_id", "exact"]).unionByName(repaired)


def same_look_pairs(unified: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b) of documents that look the same but are not the same characters.

    Texts of equal characters form one class; classes of one look are paired, then their documents,
    so copies of one text never meet each other.
    """
    seen = unified.where("look IS NOT NULL").select("doc_id", "exact", "look")
    several = seen.groupBy("look").agg(F.min("exact").alias("a"), F.max("exact").alias("b")).where("a <> b").select("look")
    docs = materialize(seen.join(several, "look", "left_semi"), "alike")
    classes = docs.select("look", "exact").distinct()
    pairs = classes.withColumnRenamed("exact", "ea").join(classes.withColumnRenamed("exact", "eb"), "look").where("ea < eb")
    a = docs.select("look", F.col("exact").alias("ea"), F.col("doc_id").alias("a"))
    b = docs.select("look", F.col("exact").alias("eb"), F.col("doc_id").alias("b"))
    out = pairs.join(a, ["look", "ea"]).join(b, ["look", "eb"]).where("a <> b")
    return out.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).distinct()


def look_classes(unified: DataFrame) -> DataFrame:
    """(doc_id, class_id, spellings): the smallest id of each document's look class and its number of
    different character sequences."""
    seen = unified.where("look IS NOT NULL").select("doc_id", "exact", "look")
    groups = seen.groupBy("look", "exact").agg(F.min("doc_id").alias("m")).groupBy("look").agg(F.min("m").alias("class_id"), F.count("*").alias("spellings"))
    return seen.join(groups, "look").select("doc_id", "class_id", "spellings")

"""What stands around a mention: local context, guarded terms, growth into longer names, quotes and their sources."""

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.operators.text import SENTENCE, longest_common, spans_udtf, term_finder


def window_around(sentences: list[tuple[int, int]], size: int, start: int, end: int, least: int, most: int) -> tuple[int, int, int | None, str]:
    """(start, end, sentence, basis) of the context of a span in a text of ``size`` characters.

    The sentence that holds the span's start, else the nearest; with its neighbours if it is shorter
    than ``least``; cut to ``most`` from both sides in proportion to their room, never into the span.
    """
    if not sentences:
        return max(0, start - most // 2), min(size, end + most // 2), None, "characters"
    own = next((i for i, (s, e) in enumerate(sentences) if s <= start < e), None)
    if own is None:
        own = min(range(len(sentences)), key=lambda i: (abs(sentences[i][0] - start), i))
    left, right = sentences[own]
    basis = "sentence"
    if right - left < least:
        left, right = sentences[max(own - 1, 0)][0], sentences[min(own + 1, len(sentences) - 1)][1]
        basis = "sentence+neighbours"
    before, behind = max(0, start - left), max(0, right - end)
    over = min(right - left - most, before + behind)
    if right - left > most:
        cut = over * before // (before + behind) if over > 0 else 0
        left, right = left + cut, right - max(0, over - cut)
        basis += "+trimmed"
    return left, right, own, basis


def local_contexts(df: DataFrame, key: str, text: str, terms: list[str], least: int = 300, most: int = 800) -> DataFrame:
    """(key, term, start, end, context_start, context_end, sentence_id, basis) of each whole occurrence of a term.

    A text is cut into sentences once for all its mentions. Null texts and keys give no row.
    """
    find_terms = term_finder(terms)

    def find(t: str) -> Iterator[tuple]:
        found = list(find_terms(t))
        if not found:
            return
        sentences = [(m.start(), m.end()) for m in SENTENCE.finditer(t)]
        starts = [s for s, _ in sentences]
        for w, s, e in found:
            at = bisect_right(starts, s)
            lo = max(0, at - 3)  # the own sentence and its neighbours are among these
            left, right, own, basis = window_around(sentences[lo : at + 2], len(t), s, e, least, most)
            yield w, s, e, left, right, None if own is None else own + lo, basis

    return spans_udtf(df, key, text, find, "term string, start int, end int, context_start int, context_end int, sentence_id int, basis string")


@dataclass(frozen=True)
class Guarded:
    """A term that counts only where the text before it matches ``before`` (to its end) and the text behind it ``after``."""

    term: str
    label: str
    before: str = ""
    after: str = ""


def guarded_spans(df: DataFrame, key: str, text: str, terms: list[Guarded], reach: int = 40) -> DataFrame:
    """(key, term, label, start, end) of guarded terms; guards see ``reach`` characters, and the start of the text as ^."""
    rules = {}
    for g in terms:
        rules.setdefault(g.term, []).append((g.label, re.compile(rf"(?:{g.before})\Z") if g.before else None, re.compile(g.after) if g.after else None))
    find_terms = term_finder(list(rules))

    def find(t: str) -> Iterator[tuple]:
        for w, s, e in find_terms(t):
            for label, before, after in rules[w]:
                if (before is None or before.search(t[max(0, s - reach) : s])) and (after is None or after.match(t[e : e + reach])):
                    yield w, label, s, e

    return spans_udtf(df, key, text, find, "term string, label string, start int, end int")


def is_header(near: Column, at: Column, length: Column) -> Column:
    """Whether a mention is followed by a colon, with at most two blanks between: the head of a list, no finding."""
    return F.substring(near, at + length + 1, F.lit(3)).rlike(r"^[ \t]{0,2}:")


def noise_reason(text: Column, before: Column, in_header: Column, credentials: tuple[str, ...] = ("md",), placeholders: tuple[str, ...] = ("none",)) -> Column:
    """Why a span is no mention: a title after a comma, a section's own head, a word for nothing; else null."""
    word = F.lower(F.trim(text))
    return F.when(word.isin(*credentials) & F.coalesce(before.rlike(r",\s*\z"), F.lit(False)), "credential").when(F.coalesce(in_header, F.lit(False)), "header").when(word.isin(*placeholders), "placeholder")


def grow_spans(mentions: DataFrame, names: DataFrame, key: list[str], most: int = 5) -> DataFrame:
    """(key..., grown, side, n_words, entry): the first longer phrase around a mention that is a name.

    mentions: key columns, text, left, right: the mention and the rest of its own sentence on both
    sides; names: (name, entry). One to ``most`` words are taken in on one side, fewest first, left
    before right; names are compared lower-cased with single blanks; ties go to the smallest entry.
    """
    words = lambda c: F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda w: w != "")
    m = mentions.select(*key, F.array_join(words(F.col("text")), " ").alias("_t"), words(F.coalesce("left", F.lit(""))).alias("_l"), words(F.coalesce("right", F.lit(""))).alias("_r"))
    grown = lambda side: F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.struct(n.alias("n"), F.lit(side).alias("side"), F.when(F.size(f"_{side[0]}") >= n, F.concat_ws(" ", F.slice("_l", -n, n), F.col("_t")) if side == "left" else F.concat_ws(" ", F.col("_t"), F.slice("_r", 1, n))).alias("grown")))
    trials = m.where("_t <> ''").select(*key, F.explode(F.concat(grown("left"), grown("right"))).alias("x")).select(*key, "x.*").where("grown IS NOT NULL")
    listed = names.select(F.array_join(words(F.col("name")), " ").alias("grown"), "entry").where("grown <> ''")
    best = F.min(F.struct("n", "side", "entry", "grown"))
    return trials.join(listed, "grown").groupBy(*key).agg(best.alias("b")).select(*key, "b.grown", "b.side", F.col("b.n").alias("n_words"), "b.entry")


@F.pandas_udf(T.DoubleType())
def spelled_confidence(tokens: pd.Series, said: pd.Series) -> pd.Series:
    """exp of the mean log-probability of the first run of at most 24 tokens that spells a verdict.

    tokens: array of (token, logprob). Blanks and quotes around the run do not count. Null when the
    run is not there or there is nothing to look for.
    """

    blank = ' \t\r\n"'

    def one(run, target):
        target = (target or "").strip()
        if run is None or not len(run) or not target:
            return None
        pieces = [t["token"] or "" for t in run]
        ends = list(accumulate(map(len, pieces)))
        starts = [e - len(p) for e, p in zip(ends, pieces)]
        text = "".join(pieces)
        at = text.find(target)
        while at >= 0:
            stop = at + len(target)
            i = bisect_left(starts, len(text[:at].rstrip(blank)))  # the first token with nothing but blanks before the verdict
            j = bisect_left(ends, stop)
            if i < len(starts) and starts[i] <= at and not text[stop : ends[j]].strip(blank) and j - i < 24:
                return round(math.exp(sum(t["logprob"] for t in run[i : j + 1]) / (j + 1 - i)), 6)
            at = text.find(target, at + 1)
        return None

    return tokens.combine(said, one)


def recovered_excerpt(quote: str, source: str, least: int = 40, reach: int = 200) -> str | None:
    """The passage of a source that holds the longest run it shares with a quote.

    Runs of fewer than ``least`` characters recover nothing. The run is widened to the full stops
    within ``reach`` characters on each side, or by 40 characters where there is none.
    """
    quote, source = (re.sub(r"\s+", " ", x or "").strip() for x in (quote, source))
    start, n = longest_common(quote, source)
    if n < least:
        return None
    end = start + n
    _, opened, lead = source[max(0, start - reach) : start].rpartition(".")
    rest, closed, _ = source[end : end + reach].partition(".")
    return source[start - len(lead) if opened else max(0, start - 40) : end + (len(rest) + 1 if closed else 40)].strip()


@F.pandas_udf(T.StringType())
def recover_excerpt(quote: pd.Series, source: pd.Series) -> pd.Series:
    return quote.combine(source, lambda q, s: None if q is None or s is None else recovered_excerpt(q, s))


def verify_citations(citations: DataFrame, evidence: DataFrame, key: str, containment: Column, floor: float = 0.8) -> DataFrame:
    """(key, n, verified, reasons): whether all citations of a decision hold.

    citations: (key, rule_id, quote); evidence: (key, rule_id, citation_type, source), what was shown.
    A rule that was not shown fails; a quote must stand in its source, of which ``containment`` (over
    the columns quote and source) gives the share, unless the source is a paraphrase; other kinds fail.
    """
    kind = F.col("citation_type")
    met = citations.join(evidence.withColumn("_shown", F.lit(True)), [key, "rule_id"], "left").withColumn("_share", F.when(kind.isin("verbatim", "paraphrase_with_recovered_excerpt"), containment))
    reason = (
        F.when(F.col("_shown").isNull(), "not shown")
        .when(kind.isin("verbatim", "paraphrase_with_recovered_excerpt"), F.when(F.coalesce("_share", F.lit(0.0)) >= floor, "quote found").otherwise("quote not found"))
        .when(kind == "paraphrase", "paraphrase")
        .otherwise("not citable")
    )
    good = F.col("_reason").isin("quote found", "paraphrase")
    return met.withColumn("_reason", reason).groupBy(key).agg(F.count("*").alias("n"), F.min(good).alias("verified"), F.array_sort(F.collect_set("_reason")).alias("reasons"))


def verdict_mismatch(shares: DataFrame, key: list[str], chosen: str, floor: float = 0.8) -> DataFrame:
    """(key..., mismatch, named): whether the reasoning names another candidate more than the chosen one.

    shares: key columns, chosen (1-based), candidate (1-based), share: how much of the candidate's name
    stands in the reasoning. Decisions of fewer than two candidates, or with none of that number, are left out.
    """
    own = F.max(F.when(F.col("candidate") == F.col(chosen), F.col("share")))
    best = F.max(F.struct("share", (-F.col("candidate")).alias("c")))
    g = shares.groupBy(*key, chosen).agg(F.count("*").alias("n"), own.alias("own"), best.alias("best")).where("n >= 2 AND own IS NOT NULL")
    wrong = (-F.col("best.c") != F.col(chosen)) & (F.col("best.share") >= floor) & (F.col("best.share") > F.col("own"))
    return g.select(*key, wrong.alias("mismatch"), F.when(wrong, -F.col("best.c")).alias("named"))


def read_verdict(said: Column, names: Column) -> Column:
    """Which of the ``names`` (array) a free text means, as its 1-based place, 0 for none, null if unreadable.

    none or no match; a name exactly; the longest name in it; a single digit within range.
    """
    low = F.lower(F.trim(said))
    names = F.transform(names, lambda n: F.lower(F.trim(n)))
    within = F.filter(F.transform(names, lambda n, i: F.struct(F.length(n).alias("l"), (-i).alias("i"), n.alias("n"))), lambda x: (x["l"] > 0) & low.contains(x["n"]))
    digit = F.regexp_extract(low, r"(?<!\d)([1-9])(?!\d)", 1)
    number = F.when(digit != "", digit.cast("int"))
    exact = F.array_position(names, low).cast("int")
    return F.when(low.rlike(r"^(?:none|no match)\b"), 0).when(exact > 0, exact).when(F.size(within) > 0, 1 - F.array_max(within)["i"]).when(number <= F.size(names), number)

"""Text and spans within it: sections, tokens, dictionary scans, expansion, context and similarity.

Functions named *_spans run over Arrow batches where exact character offsets are needed, the others
are column expressions. Offsets are half-open and count characters of the text as stored.
"""

import json
import re
from collections.abc import Callable, Iterable, Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The form of a section header.
HEADER = r"^[ \t]*([A-Z][A-Za-z0-9 /\-'&.]{2,45}?):"
# A sentence ends at . ! ? before a blank, or at a blank line.
SENTENCE = re.compile(r"\S(?:.*?[.!?](?=\s|$)|.*?(?=\n\s*\n)|.*$)", re.S)
_SPAN = "start int, end int"


def spans_udtf(df: DataFrame, key: str, text: str, find: Callable[[str], Iterable[tuple]], columns: str) -> DataFrame:
    """(key, columns...) of the tuples ``find`` gives for each text; null texts and keys give no row."""
    names = [c.strip().split()[0] for c in columns.split(",")]
    kinds = {"int": pa.int32(), "string": pa.string(), "double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_()}
    types = [kinds[c.strip().split()[1]] for c in columns.split(",")]
    source = df.select(F.col(key), F.col(text)).where(F.col(key).isNotNull() & F.col(text).isNotNull())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, rows = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for r in find(t):
                    take.append(i)
                    rows.append(r)
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, types))], names=[key, *names])

    return source.mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {columns}")


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, header_start, start, end) of each headed section; it runs to the next header."""
    pattern = re.compile(HEADER, re.M)

    def find(t: str) -> Iterator[tuple]:
        heads = [(m[1].strip(), m.start(1), m.end()) for m in pattern.finditer(t)]
        for i, (name, at, start) in enumerate(heads):
            yield name, at, start, heads[i + 1][1] if i + 1 < len(heads) else len(t)

    return spans_udtf(df, key, text, find, "name string, header_start int, start int, end int")


def sentence_spans(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sentence_id, start, end): sentences end at . ! ? before a blank, or at a blank line."""

    def find(t: str) -> Iterator[tuple]:
        for i, m in enumerate(SENTENCE.finditer(t)):
            yield i, m.start(), m.end()

    return spans_udtf(df, key, text, find, "sentence_id int, " + _SPAN)


def chunks(df: DataFrame, key: str, text: str, budget: int = 1800, overlap: int = 128) -> DataFrame:
    """(key, chunk, start, end, n_words): sentences packed up to ``budget`` words; each next chunk goes
    back over whole sentences of at least ``overlap`` words, but always moves on."""

    def find(t: str) -> Iterator[tuple]:
        spans = [(m.start(), m.end(), len(m[0].split())) for m in SENTENCE.finditer(t)]
        first = n = 0
        while first < len(spans):
            last, words = first, spans[first][2]
            while last + 1 < len(spans) and words + spans[last + 1][2] <= budget:
                last += 1
                words += spans[last][2]
            yield n, spans[first][0], spans[last][1], words
            n += 1
            if last + 1 == len(spans):
                break
            back, again = last + 1, 0
            while back - 1 > first and again < overlap:
                back -= 1
                again += spans[back][2]
            first = back
    return spans_udtf(df, key, text, find, "chunk int, " + _SPAN + ", n_words int")


def dictionary_spans(df: DataFrame, key: str, text: str, terms: list[str], ignore_case: bool = False) -> DataFrame:
    """(key, term, start, end): every whole occurrence of a term, not inside a longer word.

    All terms are found in one pass over the text by an automaton; overlapping terms are all found.
    """
    return spans_udtf(df, key, text, term_finder(terms, ignore_case), "term string, " + _SPAN)


def term_finder(terms: list[str], ignore_case: bool = False) -> Callable[[str], Iterator[tuple]]:
    """A function from a text to the (term, start, end) of dictionary_spans."""
    words = sorted({t.lower() if ignore_case else t for t in terms if t})

    def find(t: str) -> Iterator[tuple]:
        import ahocorasick

        machine = find.__dict__.get("machine")
        if machine is None:
            machine = ahocorasick.Automaton()
            for w in words:
                machine.add_word(w, w)
            if words:
                machine.make_automaton()
            find.machine = machine
        low = t.lower() if ignore_case and len(t.lower()) == len(t) else t
        for end, w in machine.iter(low) if words else ():
            start, stop = end - len(w) + 1, end + 1
            if (start == 0 or not low[start - 1].isalnum()) and (stop == len(low) or not low[stop].isalnum()):
                yield w, start, stop

    return find


def mentions(df: DataFrame, key: str, text: str, terms: list[str], reach: int) -> DataFrame:
    """(key, term, start, end, near, at): dictionary_spans with the text up to ``reach`` characters around each.

    ``at`` is the mention's start within ``near``, so that a long text is not repeated per mention.
    """
    find_terms = term_finder(terms)

    def find(t: str) -> Iterator[tuple]:
        for w, start, stop in find_terms(t):
            left = max(start - reach, 0)
            yield w, start, stop, t[left : stop + reach], start - left

    return spans_udtf(df, key, text, find, "term string, " + _SPAN + ", near string, at int")


def drop_overlapping(spans: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """Spans that no span of ``taken`` overlaps."""
    from tessel.operators.spans import overlap_join

    hit = overlap_join(spans, taken.select(key, "start", "end"), key).select(key, "start", "end").distinct()
    return spans.join(hit, [key, "start", "end"], "left_anti")


def expand(df: DataFrame, key: str, text: str, meanings: dict[str, str]) -> DataFrame:
    """(key, expanded, edits): abbreviations written out, each with its place in both texts."""
    table = {k.lower(): v for k, v in meanings.items()}
    pattern = re.compile(r"[A-Za-z0-9/]+")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, logs = [], []
            for t in batch.column(1).to_pylist():
                parts, log, last, shift = [], [], 0, 0
                for m in pattern.finditer(t):
                    new = table.get(m[0].lower())
                    if new is not None:
                        parts += [t[last : m.start()], new]
                        log.append({"start": m.start(), "end": m.end(), "exp_start": m.start() + shift, "exp_end": m.start() + shift + len(new)})
                        shift += len(new) - len(m[0])
                        last = m.end()
                out.append("".join([*parts, t[last:]]))
                logs.append(log)
            kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "end", "exp_start", "exp_end")]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(logs, kind)], names=[key, "expanded", "edits"])

    return df.select(key, text).where(F.col(key).isNotNull() & F.col(text).isNotNull()).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, expanded string, edits array<struct<start:int,end:int,exp_start:int,exp_end:int>>")


def to_original(edits: Column, place: Column, is_end: bool) -> Column:
    """The place in the original text of a place in the expanded one; inside an expansion its own bound."""
    inside = F.filter(edits, lambda e: (place > e["exp_start"]) & (place < e["exp_end"]))
    done = F.filter(edits, lambda e: e["exp_end"] <= place)
    shift = F.aggregate(done, F.lit(0), lambda a, e: a + (e["exp_end"] - e["exp_start"]) - (e["end"] - e["start"]))
    return F.when(F.size(inside) > 0, inside[0]["end" if is_end else "start"]).otherwise(place - shift)


def span_id(note: Column, *parts: Column) -> Column:
    """A note id with -e and ten digits of the SHA-1 of the parts."""
    return F.concat(note, F.lit("-e"), F.substring(F.sha1(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 10))


def table_version(rows: DataFrame, line: str) -> DataFrame:
    """One row (n, version) that changes with any line and not with their order: a sum of digests, so no task sees all lines."""
    digest = F.conv(F.substring(F.sha2(F.col(line), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(digest), F.lit(0)).cast("string").alias("version"))


# The forms of numbers beside a mention, and how many characters are looked at.
LAB_VALUE, NUMBER_AFTER, NUMBER_BEFORE, BESIDE = r"^\s*[<>=\-]\s*-?\d", r"^\s*\d", r"\d\s*$", 12


def numeric_context(text: Column, start: Column, end: Column) -> Column:
    """lab_value before a comparison and number, unit_value beside a number, else null (12 characters each side)."""
    after = F.substring(text, end + 1, F.lit(BESIDE))
    before = F.substring(text, F.greatest(start - BESIDE + 1, F.lit(1)), F.least(start, F.lit(BESIDE)))
    return F.when(after.rlike(LAB_VALUE), "lab_value").when(after.rlike(NUMBER_AFTER) | before.rlike(NUMBER_BEFORE), "unit_value")


def join_soft_wraps(text: Column) -> Column:
    """Line breaks before a lower-case line of any script, not beside a blank line, as one blank."""
    return F.regexp_replace(text, r"(?<=[^ \t\r\n])[ \t]*\r?\n[ \t]*(?=\p{IsLowercase})", " ")


def context_words(text: Column, start: Column, end: Column, reach: int = 60, n: int = 3) -> Column:
    """(before, after): the nearest n words on each side within ``reach`` characters, lower-cased."""
    words = lambda part: F.transform(F.regexp_extract_all(part, F.lit("[A-Za-z]+"), F.lit(0)), F.lower)
    before = words(F.substring(text, F.greatest(start - reach + 1, F.lit(1)), F.least(start, F.lit(reach))))
    after = words(F.substring(text, end + 1, F.lit(reach)))
    return F.struct(F.when(F.size(before) > n, F.slice(before, -n, n)).otherwise(before).alias("before"), F.slice(after, 1, n).alias("after"))


def log_odds(rows: DataFrame, group: str, word: str, meaning: str, least: int = 2) -> DataFrame:
    """(group, word, meaning, n, log_odds): words that speak for a meaning of their group, add-one smoothed."""
    c = rows.groupBy(group, word, meaning).agg(F.count("*").alias("n"))
    wide = c.join(c.groupBy(group, word).agg(F.sum("n").alias("word_n")), [group, word])
    wide = wide.join(rows.groupBy(group, meaning).agg(F.count("*").alias("m_n")), [group, meaning]).join(rows.groupBy(group).agg(F.count("*").alias("all_n")), group)
    here = (F.col("n") + 1) / (F.col("m_n") + 2)
    there = (F.col("word_n") - F.col("n") + 1) / (F.col("all_n") - F.col("m_n") + 2)
    return wide.withColumn("log_odds", F.round(F.log(here / there), 6)).where((F.col("n") >= least) & (F.col("log_odds") > 0)).select(group, word, meaning, "n", "log_odds")


def trim_words(text: Column, words: list[str]) -> Column:
    """Text without leading and trailing words of the list."""
    alt = "|".join(re.escape(w) for w in words)
    return F.regexp_replace(F.regexp_replace(F.trim(text), rf"(?i)^(?:(?:{alt})\s+)+", ""), rf"(?i)(?:\s+(?:{alt}))+$", "")


def compound_splits(phrases: DataFrame, known: DataFrame, text: str, most_parts: int = 4) -> DataFrame:
    """(text, parts): the first cut of an unknown phrase into 2..most_parts known pieces.

    Cuts are tried with fewer parts first, then shorter first parts. No piece is longer than the
    longest known name, so a phrase has at most that many pieces per word, however long it is.
    """
    words = F.split(F.lower(F.trim(text)), r"\s+")
    p = phrases.select(F.lower(F.trim(text)).alias("text"), words.alias("w")).where(F.size("w") >= 2).distinct()
    names = known.select(F.lower("name").alias("piece")).distinct()
    longest = names.agg(F.max(F.size(F.split("piece", r"\s+")))).first()[0] or 1
    p = p.join(names, F.col("text") == F.col("piece"), "left_anti")
    place = F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("i")
    pieces = p.select("text", "w", place).select("text", F.size("w").alias("n"), "i", "w", F.explode(F.sequence(F.col("i") + 1, F.least(F.size("w"), F.col("i") + longest))).alias("j"))
    pieces = pieces.select("text", "n", "i", "j", F.array_join(F.slice("w", F.col("i") + 1, F.col("j") - F.col("i")), " ").alias("piece")).join(names, "piece")
    paths = pieces.where("i = 0").select("text", "n", "j", F.array("piece").alias("parts"))
    out = None
    for _ in range(most_parts - 1):
        paths = paths.join(pieces.select("text", F.col("i").alias("j"), F.col("j").alias("k"), "piece"), ["text", "j"]).select("text", "n", F.col("k").alias("j"), F.concat("parts", F.array("piece")).alias("parts"))
        done = paths.where("j = n").select("text", "parts")
        out = done if out is None else out.unionByName(done)
    order = F.struct(F.size("parts").alias("k"), F.transform("parts", F.length).alias("lengths"), F.col("parts").alias("parts"))
    return out.groupBy("text").agg(F.min(order)["parts"].alias("parts"))


def strip_value(text: Column) -> Column:
    """A test name without the value behind it: NAME-12, NAME 12.5, NAME12."""
    return F.regexp_replace(F.trim(text), r"(?<=[A-Za-z]{2})(?:\s*[-:=]\s*|\s+)?[<>]?\d+(?:[.,]\d+)?\s*%?$", "")


def is_structured_result(text: Column) -> Column:
    return F.trim(text).rlike(r"^[A-Za-z][A-Za-z ]{1,30}\s*[-:=]\s*[<>]?\d") | (F.regexp_count(text, F.lit(r"[A-Za-z]{2,}\s*[-:=]\s*\d")) >= 3)


# Cue words before a mention, in order of precedence.
CUES = (
    ("ABSENT", "no|denies|without|negative for|absence of"),
    ("HYPOTHETICAL", "if|should|in case of"),
    ("POSSIBLE", "possible|may|suspected|likely"),
)


def assertion(text: Column, start: Column, end: Column, reach: int = 40) -> Column:
    """The state a mention is given by the cue words of its own sentence before it, else PRESENT."""
    before = F.substring(text, F.greatest(start - reach + 1, F.lit(1)), F.least(start, F.lit(reach)))
    own = F.regexp_extract(before, r"([^.;\n]*)\z", 1)
    says = lambda words: own.rlike(rf"(?iU)\b(?:{words})\b")
    out = F.when(says(CUES[0][1]), CUES[0][0])
    for state, words in CUES[1:]:
        out = out.when(says(words), state)
    return out.otherwise("PRESENT")


def token_set_ratio(a: Column, b: Column, stop: list[str]) -> Column:
    """Shared content words over the smaller set; 0 when either has none."""
    words = lambda c: F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))), F.array(*map(F.lit, stop)))
    x, y = words(a), words(b)
    small = F.least(F.size(x), F.size(y))
    return F.when(small > 0, F.round(F.size(F.array_intersect(x, y)) / small, 4)).otherwise(0.0)


def name_agreement(ratio: Column) -> Column:
    """agree from 0.75, weak from 0.45, else reject."""
    return F.when(ratio >= 0.75, "agree").when(ratio >= 0.45, "weak").otherwise("reject")


def longest_common(needle: str, text: str) -> tuple[int, int]:
    """(place in the text, length) of the longest stretch both share; of equal ones the first in the text."""
    m = SequenceMatcher(None, text, needle, autojunk=False).find_longest_match()
    return m.a, m.size


@F.pandas_udf(T.DoubleType())
def containment(needle, text):
    """Length of the longest common stretch over the needle's length."""
    return needle.combine(text, lambda a, b: None if a is None or b is None else 0.0 if not a else 1.0 if a in b else round(longest_common(a, b)[1] / len(a), 4))


def repetition(text: Column, n: int = 6, least: int = 40) -> Column:
    """(distinct_ratio, loops): share of different n-word runs; loops when under 0.35 in ``least`` words or more."""

    @F.pandas_udf("distinct_ratio double, loops boolean")
    def measure(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            words = (t or "").lower().split()
            grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
            ratio = int(len(set(grams)) / len(grams) * 1e6 + 0.5) / 1e6 if grams else None
            out.append((ratio, ratio is not None and len(words) >= least and ratio < 0.35))
        return pd.DataFrame(out, columns=["distinct_ratio", "loops"])

    return measure(text)


@F.pandas_udf(T.StringType())
def lenient_json(text):
    """JSON as text: as is, without a code fence, or the widest {...} that parses; else null."""

    def read(t):
        if t is None:
            return None
        t = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", t)
        cut = t[t.find("{") : t.rfind("}") + 1]
        for c in (t, cut):
            try:
                return json.dumps(json.loads(c), sort_keys=True, separators=(",", ":"))
            except ValueError:
                pass
        whole = []
        depth = start = 0
        for i, ch in enumerate(t):
            if ch == "{":
                start = i if depth == 0 else start
                depth += 1
            elif ch == "}" and depth:
                depth -= 1
                if depth == 0:
                    try:
                        whole.append(json.loads(t[start : i + 1]))
                    except ValueError:
                        pass
        return json.dumps(whole, sort_keys=True, separators=(",", ":")) if whole else None

    return text.map(read)


def token_confidence(logprobs: Column) -> Column:
    """exp of the mean log-probability of a run of tokens; null for none."""
    return F.when(F.size(logprobs) > 0, F.round(F.exp(F.aggregate(logprobs, F.lit(0.0), lambda a, x: a + x) / F.size(logprobs)), 6))


def doubt_reasons(text: Column, confidence: Column, ambiguous: Column, least: float = 0.7) -> Column:
    """Reasons to doubt a mention, in fixed order; empty when there are none."""
    n = F.length(text)
    return F.array_compact(
        F.array(
            F.when(F.coalesce(confidence, F.lit(0.0)) < least, "low_confidence"),
            F.when(F.coalesce(ambiguous, F.lit(False)), "ambiguous"),
            F.when(n <= 4, "short_text"),
            F.when((n <= 8) & (text == F.upper(text)), "upper_case"),
            F.when(text.rlike("[0-9]") & text.rlike("[A-Za-z]"), "letters_and_digits"),
        )
    )

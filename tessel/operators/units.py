"""Quantities recorded in different units (problem 3)."""

import re
from collections.abc import Iterable, Iterator
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Spellings of each unit code, compared after fold_unit().
SPELLINGS = {
    "mmol/l": ["mmol/l", "mm", "millimoles per liter", "millimoles per litre", "millimoles/liter", "millimol/l"],
    "umol/l": ["umol/l", "um", "micromol/l", "micromoles per liter", "micromoles per litre", "micromoles/liter"],
    "mg/dl": ["mg/dl", "mg%", "mg per dl", "mg per deciliter", "mg per decilitre", "milligrams per deciliter", "milligrams/deciliter", "mg/100ml"],
    "g/l": ["g/l", "gm/l", "grams per liter", "grams per litre", "grams/liter", "gram per liter"],
    "g/dl": ["g/dl", "gm/dl", "gm%", "g%", "grams per deciliter", "grams per decilitre", "grams/deciliter"],
    "kg": ["kg", "kgs", "kilogram", "kilograms", "kilo", "kilos"],
    "g": ["g", "gm", "gms", "gram", "grams"],
    "lb": ["lb", "lbs", "pound", "pounds"],
    "cm": ["cm", "cms", "centimeter", "centimeters", "centimetre", "centimetres"],
    "m": ["m", "meter", "meters", "metre", "metres"],
    "in": ["in", "inch", "inches", '"'],
    "degc": ["degc", "°c", "c", "celsius", "deg c", "degrees c", "degrees celsius", "centigrade"],
    "degf": ["degf", "°f", "f", "fahrenheit", "deg f", "degrees f", "degrees fahrenheit"],
    "mmhg": ["mmhg", "mm hg", "torr", "millimeters of mercury", "millimetres of mercury"],
    "kpa": ["kpa", "kilopascal", "kilopascals"],
    "h": ["h", "hr", "hrs", "hour", "hours"],
    "min": ["min", "mins", "minute", "minutes"],
    "d": ["d", "day", "days"],
    "%": ["%", "percent", "per cent", "pct"],
    "fraction": ["fraction", "ratio", "(0-1)", "0-1"],
    "10^9/l": ["10^9/l", "x10^9/l", "10*9/l", "x10*9/l", "10e9/l", "giga/l", "g/l"],
    "10^3/ul": ["10^3/ul", "x10^3/ul", "10*3/ul", "x10*3/ul", "k/ul", "thou/ul", "thou/mm3", "k/mm3", "10^3/mm3", "thousand/ul", "thousand per microliter"],
    "/ul": ["/ul", "per ul", "/mm3", "per mm3", "/mcl", "per microliter", "per microlitre", "cells/ul"],
    "ml/kg/h": ["ml/kg/h", "ml/kg/hr", "ml/kg/hour", "ml per kg per hour", "cc/kg/h"],
    "ml/kg/d": ["ml/kg/d", "ml/kg/day", "ml/kg/24h", "ml/kg/24hr", "ml per kg per day", "cc/kg/d"],
}
# Characters of one meaning in units.
_UNIT_CHARS = str.maketrans({"µ": "u", "μ": "u", "⁰": "0", "¹": "1", "²": "2", "³": "3", "⁴": "4", "⁵": "5", "⁶": "6", "⁷": "7", "⁸": "8", "⁹": "9", "⁻": "-", "·": "*", "⋅": "*", "×": "x", "º": "°", "℃": "°c", "℉": "°f", "\u066a": "%", "\u00a0": " ", "\u2009": " ", "\u202f": " "})
_RAISED = re.compile(r"10([⁰¹²³⁴⁵⁶⁷⁸⁹]+)")
_NUMBER = r"[-+]?(?:\d{1,3}(?:[ \u00a0\u2007\u2009\u202f']\d{3})+(?!\d)|\d+)(?:[.,]\d+)?(?:[eE][-+]?\d+)?"
_FIRST = re.compile(rf"^\s*(?:>=|<=|=>|=<|[<>≥≤=~≈±]|approx\.?|about|circa|ca\.?|at least|from|over|above|more than|no less than)*\s*({_NUMBER})(.*)$", re.I | re.S)
_RANGE = re.compile(rf"^\s*(?:-|–|—|−|\.\.|to\b|through\b|until\b)\s*{_NUMBER}", re.I)
_CUE = r"(?:>=|=>|[>≥=]|at least|more than|no less than|not less than|above|over|from|exceeds|exceeding|minimum of|of)"

_BEHIND = re.compile(rf"([^\d]*?)(?<!\w){_CUE}\s*({_NUMBER})", re.I)


def fold_unit(text: str | None) -> str:
    """One spelling of a unit: lower case, plain characters, single blanks, no closing full stop."""
    if not text:
        return ""
    text = _RAISED.sub(lambda m: "10^" + m[1].translate(_UNIT_CHARS), text.strip()).translate(_UNIT_CHARS).lower()
    text = re.sub(r"\s+", " ", re.sub(r"\s*([/*^])\s*", r"\1", text)).strip().rstrip(".").strip()
    return re.sub(r"\*([a-z]+)-1(?![0-9])", r"/\1", text)


class UnitTable:
    """What each measure's unit codes mean: {measure: {code: (common unit, factor, offset)}}."""

    def __init__(self, rows: Iterable[tuple], spellings: dict[str, list[str]] = SPELLINGS):
        self.units: dict[str, dict[str, tuple[str, float, float]]] = {}
        for measure, code, common, factor, offset in rows:
            self.units.setdefault(fold_name(measure), {})[code.strip().lower()] = (common.strip().lower(), factor, offset)
        self.codes = {m: {fold_unit(s): c for c in u for s in [c, *spellings.get(c, [])]} for m, u in self.units.items()}
        for m, u in self.units.items():  # a code itself is never another code's spelling
            self.codes[m].update({fold_unit(c): c for c in u})
        self.longest = {m: sorted(c, key=len, reverse=True) for m, c in self.codes.items()}
        any_name = "|".join(_name_pattern(m) for m in sorted(self.units, key=len, reverse=True) if m)
        self.stops = re.compile(rf"(?i)[;!?\n]|\.(?!\d)|(?<!\w)(?:{any_name})(?!\w)") if any_name else re.compile(r"[;!?\n]")
        self.mentions = {m: re.compile(rf"(?i)(?<!\w){_name_pattern(m)}(?!\w)") for m in self.units if m}

    def code(self, measure: str, text: str | None) -> str | None:
        return self.codes.get(measure, {}).get(fold_unit(text))

    def leading(self, measure: str, text: str) -> str | None:
        """The unit a text begins with."""
        folded = fold_unit(" ".join(text.split(None, 24)[:24]))  # no spelling has so many words
        for s in self.longest.get(measure, ()):
            if folded.startswith(s) and not (s[-1].isalnum() and folded[len(s) : len(s) + 1].isalnum()) and folded[len(s) : len(s) + 1] not in ("/", "^"):
                return self.codes[measure][s]
        return None


def _name_pattern(name: str) -> str:
    return r"\s+".join(map(re.escape, name.split(" ")))


def fold_name(text: str | None) -> str:
    return re.sub(r"\s+", " ", text or "").strip().lower()


def number(text: str) -> Decimal | None:
    """A number in any of the notations read here; a comma is a decimal mark, a blank parts thousands."""
    text = re.sub(r"[ \u00a0\u2007\u2009\u202f']", "", text)
    if "," in text:
        text = text.replace(",", "") if "." in text and text.find(",") < text.find(".") else text.replace(",", ".")
    try:
        return Decimal(text)
    except InvalidOperation:
        return None


def read_bound(units: UnitTable, measure: str | None, bound: str | None, unit: str | None, alt_bound: float | None, alt_unit: str | None, condition: str | None) -> tuple[Decimal | None, str | None, str]:
    """(value, unit code or None, where it was read) of a lower bound."""
    m = fold_name(measure)
    if bound and (found := _FIRST.match(bound)):
        rest = found[2]
        if span := _RANGE.match(rest):
            rest = rest[span.end() :]
        return number(found[1]), (units.leading(m, rest) if rest.strip() else None) or units.code(m, unit), "lower_bound"
    if alt_bound is not None and alt_bound == alt_bound and (code := units.code(m, alt_unit)):
        return Decimal(repr(alt_bound)), code, "alternative"
    if condition and m in units.mentions:
        for found in units.mentions[m].finditer(condition):
            # the first number behind the measure, in its own clause and before any other measure's name
            first = _BEHIND.match(condition, found.end())
            if first and not units.stops.search(first[1]) and (code := units.leading(m, condition[first.end() :])):
                return number(first[2]), code, "condition_text"
    return None, None, "none"


def to_common(value: Decimal, factor: float, offset: float) -> Decimal:
    return value * Decimal(repr(factor)) + Decimal(repr(offset))


def thousandths(value: Decimal) -> int:
    return int((value * 1000).to_integral_value(ROUND_HALF_UP))


def _unit_rows(units: DataFrame, most: int) -> list[tuple]:
    rows = [tuple(r) for r in units.select("measure", "unit_code", "common_unit", "factor", "offset_value").where("measure IS NOT NULL AND unit_code IS NOT NULL").limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"the unit table has more than {most} rows")
    return rows


def read_bounds(df: DataFrame, units: DataFrame, *, row_id: str, measure: str, lower_bound: str, unit: str, alternative_lower_bound: str, alternative_unit: str, condition_text: str, max_units: int = 100_000) -> DataFrame:
    """(row_id, measure, value, unit_code, common_unit, common_milli, basis) of every row.

    ``value`` is the bound as recorded, null when no number can be read; ``unit_code`` is null when
    the row names no unit of its measure; ``common_milli`` is the value in the common unit times
    1000, rounded half up. The unit table goes to every task; it must hold at most ``max_units`` rows.
    Null cells count as not written; repeated rows are repeated; an empty table gives no rows.
    """
    table = UnitTable(_unit_rows(units, max_units))
    source = df.select(F.col(row_id).cast("long"), F.col(measure).cast("string"), F.col(lower_bound).cast("string"), F.col(unit).cast("string"), F.col(alternative_lower_bound).cast("double"), F.col(alternative_unit).cast("string"), F.col(condition_text).cast("string"))
    schema = pa.schema([("row_id", pa.int64()), ("measure", pa.string()), ("value", pa.float64()), ("unit_code", pa.string()), ("common_unit", pa.string()), ("common_milli", pa.int64()), ("basis", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, m, *cells in zip(*(c.to_pylist() for c in batch.columns)):
                value, code, basis = read_bound(table, m, *cells)
                own = table.units.get(fold_name(m), {})
                common, factor, offset = own.get(code, (None, None, None)) if code else (None, None, None)
                milli = thousandths(to_common(value, factor, offset)) if value is not None and code else None
                out.append((i, fold_name(m) or None, float(value) if value is not None else None, code, common, milli, basis))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * 7, schema)], schema=schema)

    return source.mapInArrow(run, "row_id long, measure string, value double, unit_code string, common_unit string, common_milli long, basis string")


def fit_unit_mixture(read: DataFrame, units: DataFrame, *, step: float = 0.02, rounds: int = 40, max_units: int = 100_000) -> dict[str, dict]:
    """For each measure a log-scale mixture whose components differ by the known conversions.

    All units of a measure share one log-normal of the common value; a unit's component is that curve
    moved by its conversion. Known units fix the curve and add to the shares, missing units are split
    by their posterior. The values of the measures of the unit table are counted in log bins of
    ``step`` first, so the driver sees one row per measure, unit and bin, however many rows there are.
    """
    table: dict[str, dict[str, tuple[float, float]]] = {}
    for measure, code, _, factor, offset in _unit_rows(units, max_units):
        table.setdefault(fold_name(measure), {})[code.strip().lower()] = (factor, offset)
    known = read.sparkSession.createDataFrame([(m,) for m in sorted(table)], "measure string")
    bins = (
        read.where(F.col("value") > 0)
        .join(known, "measure", "left_semi")
        .groupBy("measure", "unit_code", F.round(F.log("value") / step).cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
        .collect()
    )
    fits: dict[str, dict] = {}
    for measure, own in table.items():
        codes = sorted(own)
        rows = [(r["unit_code"], r["bin"] * step, r["n"]) for r in bins if r["measure"] == measure and (r["unit_code"] is None or r["unit_code"] in own)]
        if not rows:
            continue
        x = np.array([r[1] for r in rows])
        n = np.array([r[2] for r in rows], float)
        common = np.stack([np.exp(x) * own[c][0] + own[c][1] for c in codes], 1)
        usable = common > 0
        y = np.log(np.where(usable, common, 1))
        jac = np.log(np.maximum(np.stack([np.exp(x) * own[c][0] for c in codes], 1), 1e-300)) - y
        known = np.array([codes.index(r[0]) if r[0] else -1 for r in rows])
        post = np.where(usable, 1.0, 0.0)
        post[known >= 0] = 0
        post[known >= 0, known[known >= 0]] = 1
        post /= np.maximum(post.sum(1, keepdims=True), 1e-300)
        mu = sd = None
        share = np.full(len(codes), 1 / len(codes))
        for k in range(rounds):
            w = post * n[:, None] * usable
            if k == 0 and (known >= 0).any():
                w = w * (known >= 0)[:, None]
            total = w.sum()
            if total <= 0:
                break
            mu = (w * y).sum() / total
            sd = max(0.05, float(np.sqrt((w * (y - mu) ** 2).sum() / total)))
            share = (w.sum(0) + 1) / (total + len(codes))
            like = np.where(usable, np.log(share) - 0.5 * ((y - mu) / sd) ** 2 + jac, -np.inf)
            like -= np.maximum(like.max(1, keepdims=True), -1e300)
            new = np.exp(like)
            new /= np.maximum(new.sum(1, keepdims=True), 1e-300)
            new[known >= 0] = post[known >= 0]
            if k and np.abs(new - post).max() < 1e-6:
                break
            post = new
        if mu is not None:
            fits[measure] = {"mu": float(mu), "sd": sd, "units": {c: (float(share[i]), *own[c]) for i, c in enumerate(codes)}}
    return fits


def assign_units(read: DataFrame, units: DataFrame, *, sure: float = 0.9, **fit) -> DataFrame:
    """``read`` with the most probable unit where it was missing.

    Adds ``assigned_unit``, ``posterior``, ``common_value`` and ``uncertain`` (posterior under
    ``sure``). A recorded unit keeps posterior 1. Rows without a number, or of an unknown measure,
    get nulls and are uncertain.
    """
    spark = read.sparkSession
    fits = fit_unit_mixture(read, units, **fit)
    rows = [(m, c, float(np.log(s)), f, o, v["mu"], v["sd"]) for m, v in fits.items() for c, (s, f, o) in v["units"].items()]
    params = spark.createDataFrame(rows, "measure string, code string, log_share double, factor double, offset double, mu double, sd double")
    params = params.groupBy("measure").agg(F.array_sort(F.collect_list(F.struct("code", "log_share", "factor", "offset", "mu", "sd"))).alias("units"))
    common = lambda u: F.col("value") * u["factor"] + u["offset"]
    score = F.transform(
        "units",
        lambda u: F.struct(
            F.when(F.col("unit_code").isNotNull(), F.when(u["code"] == F.col("unit_code"), F.lit(0.0)))
            .when((F.col("value") > 0) & (common(u) > 0), u["log_share"] - F.lit(0.5) * F.pow((F.log(common(u)) - u["mu"]) / u["sd"], 2) + F.log(F.col("value") * u["factor"]) - F.log(common(u)))
            .alias("like"),
            u["code"].alias("code"),
            common(u).alias("common"),
        ),
    )
    best = F.array_max(F.filter("scores", lambda s: s["like"].isNotNull()))
    mass = F.aggregate("scores", F.lit(0.0), lambda a, s: a + F.coalesce(F.exp(s["like"] - F.col("best.like")), F.lit(0.0)))
    return (
        read.join(params, "measure", "left")
        .withColumn("scores", F.when(F.col("value").isNotNull(), score))
        .withColumn("best", best)
        .withColumn("posterior", F.when(F.col("best").isNotNull(), 1 / mass))
        .withColumn("assigned_unit", F.col("best.code"))
        .withColumn("common_value", F.col("best.common"))
        .withColumn("uncertain", F.coalesce(F.col("posterior") < sure, F.lit(True)))
        .drop("scores", "best", "units")
    )


def holdout_accuracy(read: DataFrame, units: DataFrame, *, folds: int = 2, **options) -> DataFrame:
    """(measure, n, accuracy, mean_posterior, n_uncertain, accuracy_of_sure) of units that were hidden and assigned.

    Every row whose unit is known is hidden once: in turn, a hashed part of the rows loses its units,
    the mixture is fitted to the rest and assigns them. Rows without a number are left out.
    """
    out = None
    usable = read.where("value > 0 AND unit_code IS NOT NULL")
    for k in range(folds):
        hidden = F.pmod(F.xxhash64("row_id", "value", "unit_code"), F.lit(folds)) == k
        rows = usable.withColumn("own_unit", F.when(hidden, F.col("unit_code"))).withColumn("unit_code", F.when(~hidden, F.col("unit_code")))
        part = assign_units(rows, units, **options).where("own_unit IS NOT NULL").select("measure", (F.col("assigned_unit") == F.col("own_unit")).alias("right"), "posterior", "uncertain")
        out = part if out is None else out.unionByName(part)
    mean = lambda c: F.round(F.avg(c), 4)
    right = F.coalesce("right", F.lit(False)).cast("int")
    return out.groupBy("measure").agg(F.count("*").alias("n"), mean(right).alias("accuracy"), mean("posterior").alias("mean_posterior"), F.count_if("uncertain").alias("n_uncertain"), mean(F.when(~F.col("uncertain"), right)).alias("accuracy_of_sure"))

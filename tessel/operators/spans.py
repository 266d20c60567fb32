"""Half-open character spans: overlaps, containment, islands and overlap measures."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.sources.tables import materialize


def overlap_join(a: DataFrame, b: DataFrame, key: str, width: int = 256) -> DataFrame:
    """Pairs of spans of one ``key`` with a.start < b.end and a.end > b.start.

    a: (key, start, end, ...), b: (key, start, end, ...); b's columns come with the prefix b_. Spans
    are cut into buckets of ``width`` characters, so a long text spreads over many join keys instead
    of pairing all its spans; a pair is kept in the first bucket both share. Empty spans meet nothing;
    null bounds give no row.
    """
    b = b.select(F.col(key), *[F.col(c).alias(f"b_{c}") for c in b.columns if c != key])
    a = a.where("start < end").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    b = b.where("b_start < b_end").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("b_start") / width), F.floor((F.col("b_end") - 1) / width))))
    met = a.join(b, [key, "_bin"]).where((F.col("start") < F.col("b_end")) & (F.col("end") > F.col("b_start")))
    return met.where(F.col("_bin") == F.floor(F.greatest("start", "b_start") / width)).drop("_bin")


def overlap_ratio() -> Column:
    """Shared characters over the shorter span, of the pairs of overlap_join."""
    shared = F.least("end", "b_end") - F.greatest("start", "b_start")
    return shared / F.greatest(F.lit(1), F.least(F.col("end") - F.col("start"), F.col("b_end") - F.col("b_start")))


def best_overlap(a: DataFrame, b: DataFrame, key: str, a_id: str, b_id: str, floor: float = 0.5) -> DataFrame:
    """(a_id, b_id, ratio): for each a-span the b-span that covers most of the shorter one.

    Ties go to the smallest b_id; ratios under ``floor`` link nothing; ratios have 4 digits.
    """
    pairs = overlap_join(a, b, key).select(a_id, F.col(f"b_{b_id}").alias(b_id), overlap_ratio().alias("ratio"))
    w = Window.partitionBy(a_id).orderBy(F.col("ratio").desc(), b_id)
    best = pairs.withColumn("rn", F.row_number().over(w)).where((F.col("rn") == 1) & (F.col("ratio") >= floor))
    return best.select(a_id, b_id, F.round("ratio", 4).alias("ratio"))


def containing(points: DataFrame, spans: DataFrame, key: str, at: str, label: str, width: int = 256) -> DataFrame:
    """Points with the label of the span of their key that holds them, null if none does.

    Of several the one that starts last counts.
    """
    s = spans.where("start < end").select(key, F.col("start").alias("_s"), F.col("end").alias("_e"), F.col(label).alias("_label"), F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("_bin"))
    keyed = points.withColumn("_bin", F.floor(F.col(at) / width))
    met = keyed.join(s, [key, "_bin"]).where((F.col(at) >= F.col("_s")) & (F.col(at) < F.col("_e")))
    found = met.groupBy(*points.columns).agg(F.max_by("_label", "_s").alias(label))
    return points.join(found, points.columns, "left")


def islands(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans of each key merged where they overlap or touch: (keys..., start, end).

    Spans are dealt to range partitions by key and start, so a key of very many spans is spread; the
    farthest end of the partitions before, one row per key and partition, is handed on, and what goes
    on from one partition into the next is joined to the last island there.
    """
    ranged = spans.where("start < end").select(*keys, "start", "end").repartitionByRange(*keys, "start", "end")
    ranged = materialize(ranged.withColumn("_pid", F.spark_partition_id()), "ranged")
    by = [*keys, "_pid"]
    far = ranged.groupBy(*by).agg(F.max("end").alias("_far"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = far.withColumn("_carry", F.max("_far").over(before)).drop("_far").alias("c")
    r = ranged.alias("r")
    rows = r.join(carry, [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in by]).select("r.*", "c._carry")
    order = Window.partitionBy(*by).orderBy("start", "end")
    ahead = F.greatest(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carry"))
    marked = rows.withColumn("_new", F.when(ahead.isNull() | (F.col("start") > ahead), 1).otherwise(0)).withColumn("_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = materialize(marked.groupBy(*by, "_no").agg(F.min("start").alias("start"), F.max("end").alias("end")), "islands")
    # of each key and partition, the last island that began there, and what goes on from before (_no = 0)
    last = parts.where("_no > 0").groupBy(*by).agg(F.max("_no").alias("_last"))
    each = parts.where("_no = 0").select(*by, F.col("end").alias("_on")).alias("o").join(last.alias("l"), [F.col(f"o.{k}").eqNullSafe(F.col(f"l.{k}")) for k in by], "full")
    each = each.select(*[F.coalesce(f"o.{k}", f"l.{k}").alias(k) for k in by], "_on", "_last")
    owner = F.last(F.when(F.col("_last").isNotNull(), F.struct(F.col("_pid").alias("p"), F.col("_last").alias("n"))), ignorenulls=True).over(before)
    on = each.withColumn("_owner", owner).where("_on IS NOT NULL").groupBy(*keys, F.col("_owner.p").alias("_pid"), F.col("_owner.n").alias("_no")).agg(F.max("_on").alias("_on"))
    full = [*by, "_no"]
    out = parts.where("_no > 0").alias("i").join(on.alias("o"), [F.col(f"i.{k}").eqNullSafe(F.col(f"o.{k}")) for k in full], "left")
    return out.select(*[F.col(f"i.{k}").alias(k) for k in keys], F.col("i.start").alias("start"), F.greatest("i.end", "_on").alias("end"))


def iou_by_class(a: DataFrame, b: DataFrame, text_key: str, cls: str) -> DataFrame:
    """(cls, shared, either, iou, a_chars): characters both sides mark with a class over those either does.

    Both sides are merged to islands first, so the measure never lists single characters.
    """
    keys = [text_key, cls]
    ia, ib = islands(a.select(*keys, "start", "end"), keys), islands(b.select(*keys, "start", "end"), keys)
    size = lambda df, name: df.groupBy(cls).agg(F.sum(F.col("end") - F.col("start")).alias(name))
    key = F.concat_ws("\t", text_key, cls)
    met = overlap_join(ia.withColumn("_k", key), ib.select(key.alias("_k"), "start", "end"), "_k")
    shared = met.groupBy(cls).agg(F.sum(F.least("end", "b_end") - F.greatest("start", "b_start")).alias("shared"))
    out = size(ia, "a_chars").join(size(ib, "b_chars"), cls, "full").join(shared, cls, "left").fillna(0, ["a_chars", "b_chars", "shared"])
    return out.select(cls, "shared", (F.col("a_chars") + F.col("b_chars") - F.col("shared")).alias("either"), F.round(F.col("shared") / (F.col("a_chars") + F.col("b_chars") - F.col("shared")), 6).alias("iou"), "a_chars")


def mean_iou(by_class: DataFrame) -> DataFrame:
    """One row (macro, weighted, n_classes): the plain mean and the mean weighted by the first side's characters."""
    return by_class.agg(F.round(F.avg("iou"), 6).alias("macro"), F.round(F.sum(F.col("iou") * F.col("a_chars")) / F.sum("a_chars"), 6).alias("weighted"), F.count("*").alias("n_classes"))


def span_recall(gold: DataFrame, found: DataFrame, key: str, concept: str) -> DataFrame:
    """(key, n_gold, covered, linked): gold spans, those some found span overlaps, and those some
    overlapping span gives the same concept. Texts without found spans count with zero."""
    met = overlap_join(gold, found, key)
    hit = met.groupBy(key, "start", "end").agg(F.max((F.col(concept) == F.col(f"b_{concept}")).cast("int")).alias("linked"))
    out = gold.select(key, "start", "end").distinct().join(hit, [key, "start", "end"], "left")
    return out.groupBy(key).agg(F.count("*").alias("n_gold"), F.count("linked").alias("covered"), F.coalesce(F.sum("linked"), F.lit(0)).alias("linked"))

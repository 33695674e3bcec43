"""Mixing sources to target weights with a time-varying curriculum.

Each source has a weight schedule over training time 0..1: weights at knots, linear between. The integral of its schedule is
the source's weight. Weights share the total size; a source whose share is more than `max_epochs` times its own size gets that
much, and the excess is shared by weight among the others until none is above (water-filling).

A source's documents, in the order of a hash of their id and text, are laid end to end, epoch after epoch, until the target is used up;
the last document is cut there. Cumulative demand of a source at time t is its target times the normalised integral of its
schedule up to t; inverting it at a document's start gives the document's training position, and sorting by position gives
the training order.

Running sums never put a source into one task: rows are summed by (source, hash bucket), the sums are accumulated over the
few buckets of a source, and only within a bucket rows are accumulated one by one. A source with a third of all rows is
spread over all buckets like any other.

Null text has size 0, null source is a source of its own, null and repeated ids are rows like any other (repeated rows follow
each other, ordered by size). A source without words has target 0. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankpulse.llm.common import WORD, cut, text_of

#: Hexadecimal digits of the hash that name a bucket: 4096 buckets a source.
BUCKET_DIGITS = 3
MAX_EPOCHS = 3

#: Weights 1, 2, 3, repeating, times the shape of a schedule: (time, factor) knots whose integral is 1.
WEIGHTS = (1, 2, 3)
SHAPES = (
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (1.0, 1.5)),
    ((0.0, 0.75), (0.5, 1.25), (1.0, 0.75)),
)


def _key(source: str) -> Column:
    """A source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))


def default_schedules(sources: DataFrame) -> DataFrame:
    """Schedules for sources in code point order, null last: weights and shapes repeat with period three."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    kind = F.pmod(place, F.lit(len(WEIGHTS)))
    knots = None
    for k, (weight, shape) in enumerate(zip(WEIGHTS, SHAPES, strict=True)):
        value = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(weight * f).alias("w")) for t, f in shape])
        knots = F.when(kind == k, value) if knots is None else knots.when(kind == k, value)
    return sources.select("source", knots.alias("knots"))


def _pieces(knots: Column) -> Column:
    """Linear pieces of a schedule with the area before each."""
    pieces = F.transform(
        F.slice(knots, 1, F.size(knots) - 1),
        lambda a, i: F.struct(
            a.t.alias("t0"),
            a.w.alias("w0"),
            (F.get(knots, i + 1).t - a.t).alias("dt"),
            (F.get(knots, i + 1).w - a.w).alias("dw"),
            ((F.get(knots, i + 1).t - a.t) * (F.get(knots, i + 1).w + a.w) / 2).alias("area"),
        ),
    )
    return pieces


def targets(sized: DataFrame, schedules: DataFrame | None = None, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """One row a source: source_size, weight, target, pieces of its schedule. sized has source and size.

    Water-filling in closed form: with sources in order of cap by weight, one is capped if its cap by weight is
    below what is left by weight when all before it are capped.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    schedules = default_schedules(sizes) if schedules is None else schedules
    knots = schedules.select(_key("source").alias("_k"), "knots")
    df = sizes.withColumn("_k", _key("source")).join(knots, "_k").select("source", "source_size", _pieces(F.col("knots")).alias("pieces"))
    df = df.withColumn("weight", F.aggregate("pieces", F.lit(0.0), lambda a, p: a + p.area))
    df = df.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    order = Window.orderBy(F.try_divide("cap", "weight").asc_nulls_last(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(all_rows)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    df = df.withColumns({"_left": left, "_weight_left": weight_left})
    df = df.withColumn("_level", F.try_divide("_left", "_weight_left"))
    df = df.withColumn("_capped", F.col("cap") <= F.col("_level") * F.col("weight"))
    # The level of the first source that isn't capped holds for it and all after it.
    level = F.min(F.when(~F.col("_capped"), F.struct(F.try_divide("cap", "weight").alias("o"), F.col("_level").alias("level")))).over(all_rows).level
    target = F.when(F.col("_capped"), F.col("cap")).otherwise(F.coalesce(F.col("weight") * level, F.lit(0.0)))
    return df.select("source", "source_size", "weight", target.alias("target"), "pieces")


def _position(pieces: Column, weight: Column, share: Column) -> Column:
    """The time at which a source's cumulative demand reaches this share of its target: the schedule's integral, inverted."""
    area = share * weight
    zero = F.struct(F.lit(0.0).alias("before"), F.lit(None).cast("double").alias("t"))

    def step(a: Column, p: Column) -> Column:
        inside = area - a.before
        slope = p.dw / p.dt
        # w0 x + slope x^2 / 2 = inside, in the form that also holds for slope 0
        x = F.try_divide(2 * inside, p.w0 + F.sqrt(F.greatest(p.w0 * p.w0 + 2 * slope * inside, F.lit(0.0))))
        here = a.t.isNull() & (inside <= p.area)
        return F.struct((a.before + p.area).alias("before"), F.when(here, p.t0 + F.least(F.coalesce(x, F.lit(0.0)), p.dt)).otherwise(a.t).alias("t"))

    return F.coalesce(F.aggregate(pieces, zero, step).t, F.lit(1.0))


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """The kept columns, size, the number of words, and key, by which documents of a source are dealt out and ordered."""
    return docs.select(*keep, F.regexp_count(text_of(text), F.lit(WORD)).cast("long").alias("size"), _order("doc_id", F.md5(text_of(text))).alias("key"))


def _order(doc_id: str, text_md5: Column) -> Column:
    """A hash of id and text, so that rows without an id, or with the same one, don't fall into one bucket."""
    return F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), text_md5))


def plan(sized: DataFrame, schedules: DataFrame | None = None, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """For each row of (doc_id, source, size, key): source_size, target, start (words of its source before it), taken, position.

    taken are the words that the mix takes of the row, repeats counted (the last repeat may be cut); position is the time of
    its first appearance, null if it never appears. pieces and weight are those of its source.
    """
    by_source = targets(sized, schedules, max_epochs).withColumn("_key", _key("source")).drop("source")
    rows = sized.withColumn("_key", _key("source")).withColumnRenamed("key", "_hash")
    rows = rows.withColumn("_bucket", F.substring("_hash", 1, BUCKET_DIGITS))
    ahead = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_key", "_bucket").agg(F.sum("size").alias("_sum"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).drop("_sum").join(by_source, "_key")
    inner = Window.partitionBy("_key", "_bucket").orderBy("_hash", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_within", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    df = rows.join(sums, ["_key", "_bucket"]).withColumn("start", F.col("_before") + F.col("_within"))
    goal = F.round("target").cast("long")
    epochs = F.coalesce(F.floor(F.try_divide(goal, F.col("source_size"))), F.lit(0)).cast("long")
    part = F.greatest(F.least(goal - epochs * F.col("source_size") - F.col("start"), F.col("size")), F.lit(0))
    df = df.withColumn("taken", (epochs * F.col("size") + part).cast("long"))
    position = F.when(F.col("taken") > 0, _position(F.col("pieces"), F.col("weight"), F.col("start") / F.col("target")))
    return df.select(*[c for c in sized.columns if c != "key"], "source_size", "target", "start", "taken", position.alias("position"), "pieces", "weight")


def mix(docs: DataFrame, schedules: DataFrame | None = None, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """The documents, with a column position and sorted by it, each as often as its plan says.

    Documents stay whole: the last repeat appears if at least half of it is within the target. Rows with the same doc_id,
    source and text are planned as one of their joint size, so that each text is joined once.
    """
    keys = ["_id", "_key", "_text"]
    marked = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_key": _key("source"), "_text": F.xxhash64(text_of())})
    one = F.regexp_count(text_of(), F.lit(WORD)).cast("long")
    order = _order("doc_id", F.md5(text_of())).alias("key")
    sized = marked.select("doc_id", "source", *keys, one.alias("_one"), order).groupBy("doc_id", "source", *keys, "_one", "key").agg((F.count(F.lit(1)) * F.col("_one")).alias("size"))
    planned = cut(plan(sized, schedules, max_epochs))
    times = F.round(F.col("taken") / F.col("_one")).cast("int")
    appear = planned.filter(F.col("taken") > 0).withColumn("_nth", F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1))))
    per_epoch = F.greatest((F.col("size") / F.col("_one")).cast("long"), F.lit(1))
    words_before = F.floor(F.col("_nth") / per_epoch) * F.col("source_size") + F.col("start") + F.pmod(F.col("_nth"), per_epoch) * F.col("_one")
    appear = appear.select(*keys, _position(F.col("pieces"), F.col("weight"), words_before / F.col("target")).alias("position"))
    texts = marked.groupBy(*keys).agg(*[F.first(c).alias(c) for c in docs.columns])
    return texts.drop("position").join(appear, keys).select(*[c for c in docs.columns if c != "position"], "position").orderBy("position", "doc_id")

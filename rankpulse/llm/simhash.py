"""SimHash fingerprints, and search for all within a Hamming radius by permuted block tables.

A term is a word and the one after it. Each occurrence votes on 128 bits with the bits of its hash, for or against, with a
weight of 1 to 3: how many of its words are longer than three characters, plus one. A bit is set if more than half of the
weight is for it. Votes are counted in the JVM by one aggregation over the exploded terms: a sum column holds two counters of
32 bits each, enough for any text, so 128 bits take 64 sums.

Search cuts fingerprints into blocks. Two within a radius below 8 agree in at least one of radius + 1 blocks; two within a larger
one differ in at most one bit in at least one of radius // 2 + 1 blocks (from 16 on: two bits and radius // 3 + 1, and so on). Each
fingerprint stands in a table for each block, keyed by it, and equal fingerprints stand there once with their number. Queries look
up their own block and those that differ in so few bits. A pair is taken only in the first table where it meets.

Null text is empty; texts without words have a fingerprint of zeros. Null doc ids come last in the order of documents, rows
that repeat an id follow each other by the hash of their text. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankpulse.llm.common import cut, text_of, words_of

BITS = 128
RADIUS = 3
#: The radius of compare: texts at a similarity of 0.8 by five-word shingles share about 0.9 of their terms and are about 12 bits
#: apart, give or take 3.
NEAR = 15
LONG_WORD = 3
#: Rows of a range of ids, and ranges at most.
RANGE_ROWS = 2000
MOST_RANGES = 16384


def _ranges(ids: DataFrame, column: str) -> Column:
    """The range of an id, counted from the largest ids; null ids are in the last. Bounds are estimated quantiles, looked up in two steps."""
    n = ids.count()
    count = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    if count == 1:
        return F.lit(0)
    found = ids.select(F.percentile_approx(column, [i / count for i in range(1, count)], 10 * count)).first()[0]
    bounds = sorted(set(found or ()), reverse=True)
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    heads = F.array(*[F.lit(b) for b in bounds[::step]])
    parts = F.array(*[F.array(*[F.lit(b) for b in bounds[i : i + step]]) for i in range(0, len(bounds), step)])
    part = F.size(F.filter(heads, lambda b: b > F.col(column))) - 1
    inside = F.size(F.filter(F.get(parts, part), lambda b: b > F.col(column)))
    return F.when(F.col(column).isNull(), len(bounds) + 1).when(part < 0, 0).otherwise(part * step + inside)


def with_next(df: DataFrame, value: str, key: str, tie: str, name: str) -> DataFrame:
    """Adds the value of the next row in the order of descending key (null last), then tie; after the last comes the first.

    Rows are dealt out by ranges of the key. The first row of each range is added to the end of the range before.
    """
    df = df.withColumn("_range", _ranges(df.select(key), key))
    heads = df.groupBy("_range").agg(F.max(key).alias("_top"))
    alone = F.row_number().over(Window.partitionBy("_range").orderBy(tie, value))
    # there are at most MOST_RANGES + 1 heads: without the broadcast all texts would be shuffled to find theirs
    first = df.withColumnRenamed("_range", "_r").join(F.broadcast(heads.withColumnRenamed("_range", "_h")), (F.col("_r") == F.col("_h")) & F.col(key).eqNullSafe(F.col("_top")))
    first = first.select(F.col("_r").alias("_range"), tie, value).withColumn("_n", alone).filter("_n = 1").drop("_n")
    line = Window.orderBy("_range")
    before = heads.select("_range", F.coalesce(F.lag("_range").over(line), F.max("_range").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_before"))
    ghosts = first.join(before, "_range").select(F.col("_before").alias("_range"), F.col(value), F.lit(True).alias("_ghost"))
    both = df.withColumn("_ghost", F.lit(False)).unionByName(ghosts, allowMissingColumns=True)
    order = Window.partitionBy("_range").orderBy("_ghost", F.col(key).desc_nulls_last(), tie, value)
    return both.withColumn(name, F.lead(value).over(order)).filter("not _ghost").drop("_ghost", "_range")


#: Two counters in one long.
_LANE = 0x0000000100000001


def fingerprints(df: DataFrame, texts: dict[str, str]) -> DataFrame:
    """Replaces each text column by a fingerprint column: {text column: name}. Columns without texts are kept."""
    keep = [c for c in df.columns if c not in texts]
    marked = df.withColumn("_row", F.monotonically_increasing_id())
    arrays = marked.select("_row", *keep, F.explode(F.array(*[F.struct(F.lit(i).alias("k"), words_of(F.coalesce(F.col(t), F.lit(""))).alias("w")) for i, t in enumerate(texts)])).alias("_x"))
    arrays = arrays.select("_row", *keep, F.col("_x.k").alias("_k"), F.col("_x.w").alias("_w"))
    w = F.col("_w")
    terms = F.transform(
        w,
        lambda x, i: F.struct(
            F.xxhash64(x, F.get(w, i + 1)).alias("a"),
            (1 + (F.length(x) > LONG_WORD).cast("int") + F.coalesce((F.length(F.get(w, i + 1)) > LONG_WORD).cast("int"), F.lit(0))).cast("long").alias("n"),
        ),
    )
    rows = arrays.select("_row", *keep, "_k", F.explode_outer(terms).alias("_t"))
    rows = rows.select("_row", *keep, "_k", F.col("_t.a").alias("_a"), F.xxhash64(F.lit(1), "_t.a").alias("_b"), F.coalesce(F.col("_t.n"), F.lit(0)).alias("_n"))
    sums = [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_LANE)) * F.col("_n")).alias(f"{h}{j}") for h in ("_a", "_b") for j in range(32)]
    voted = rows.groupBy("_row", *keep, "_k").agg(F.sum("_n").alias("_total"), *sums)

    def word(h: str) -> Column:
        bits = None
        for j in range(32):
            low = F.when(2 * F.col(f"{h}{j}").bitwiseAND(F.lit(0xFFFFFFFF)) > F.col("_total"), F.lit(1 << j)).otherwise(F.lit(0))
            top = 1 << (j + 32)
            high = F.when(2 * F.shiftrightunsigned(f"{h}{j}", 32) > F.col("_total"), F.lit(top if top < 1 << 63 else top - (1 << 64))).otherwise(F.lit(0))
            bits = low.bitwiseOR(high) if bits is None else bits.bitwiseOR(low).bitwiseOR(high)
        return F.lpad(F.hex(bits.cast("long")), 16, "0")

    printed = voted.select("_row", *keep, "_k", F.lower(F.concat(word("_a"), word("_b"))).alias("_f"))
    out = printed.groupBy("_row", *keep).agg(*[F.max(F.when(F.col("_k") == i, F.col("_f"))).alias(n) for i, n in enumerate(texts.values())])
    return out.drop("_row")


def _halves(column: Column) -> list[Column]:
    return [F.conv(F.substring(column, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(BITS // 32)]


def distance(a: Column, b: Column) -> Column:
    """Bits in which two fingerprints differ."""
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(_halves(a), _halves(b), strict=True)), F.lit(0))


def _key(column: Column, at: int, n: int) -> Column:
    """n hex digits from a place, as a number of as many bits."""
    return F.conv(F.substring(column, at, n), 16, -10).cast("long")


def within(index: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (query, found, n) of fingerprints of at most `radius` differing bits, equal ones included; n rows of the index have found."""
    flips = 0 if radius < 8 else radius // 16 + 1
    blocks = max(2, radius // (flips + 1) + 1)
    size = BITS // 4 // blocks
    cuts = [(1 + i * size, size if i < blocks - 1 else BITS // 4 - i * size) for i in range(blocks)]

    def tables(df: DataFrame, name: str, flips: int) -> DataFrame:
        """A row a table and key: the block itself, and all that differ from it in up to `flips` bits."""
        keys = []
        for i, (at, n) in enumerate(cuts):
            masks = [sum(1 << j for j in c) for k in range(flips + 1) for c in combinations(range(4 * n), k)]
            keys += [F.struct(F.lit(i).alias("t"), F.col(f"_block{i}").bitwiseXOR(F.lit(m).cast("long")).alias("key")) for m in masks]
        df = df.withColumns({f"_block{i}": _key(F.col(name), at, n) for i, (at, n) in enumerate(cuts)})
        words = [_key(F.col(name), at, 16).alias(f"_{name}{at}") for at in (1, 17)]
        return df.withColumn("_x", F.explode(F.array(*keys))).select(*words, *[c for c in df.columns if c != name and not c.startswith("_block")], F.col("_x.t").alias(f"_t_{name}"), F.col("_x.key").alias(f"_key_{name}"))

    # only the queries, the smaller side, are looked up under changed keys
    left = tables(queries.select(F.col("fingerprint").alias("query")).distinct(), "query", flips)
    right = tables(index.groupBy(F.col("fingerprint").alias("found")).agg(F.count(F.lit(1)).alias("n")), "found", 0)
    apart = sum((F.bit_count(F.col(f"_query{at}").bitwiseXOR(F.col(f"_found{at}"))) for at in (1, 17)), F.lit(0))
    on = (F.col("_t_query") == F.col("_t_found")) & (F.col("_key_query") == F.col("_key_found")) & (apart <= radius)
    text = lambda name: F.lower(F.concat(*[F.lpad(F.hex(f"_{name}{at}"), 16, "0") for at in (1, 17)])).alias(name)
    # Spark takes the keys of a query for no larger than the query itself, so by its size it would broadcast all of them
    pairs = left.join(right.hint("merge"), on).select(text("query"), text("found"), "n", F.col("_t_query").alias("_t"))
    earlier = F.lit(False)
    for i, (at, n) in enumerate(cuts):
        earlier = earlier | ((F.lit(i) < F.col("_t")) & (F.bit_count(_key(F.col("query"), at, n).bitwiseXOR(_key(F.col("found"), at, n))) <= flips))
    return pairs.filter(~earlier).select("query", "found", "n")


def compare(docs: DataFrame, search_every: int = 20) -> DataFrame:
    """For each document: its fingerprint, that of its edited text, likeness to that and to the next document.

    The edited text has its last third replaced by the beginning of the next document in descending doc_id. For documents
    whose id is divisible by search_every, n_near counts the other documents within NEAR bits, and near_ids has, of each other fingerprint
    among them, the smallest id in order, without null: documents of one fingerprint are one class, named by that column, and aren't listed.
    """
    df = docs.select("doc_id", text_of().alias("text")).withColumn("_sha", F.sha2("text", 256))
    df = with_next(df, "text", "doc_id", "_sha", "_next")
    n = F.length("text").cast("long")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n.cast("int") - third), F.substring(F.col("_next"), F.lit(1), third))
    df = df.withColumns({"n_chars": n, "edited": edited}).withColumn("edited_sha256", F.sha2("edited", 256)).drop("_next")
    prints = cut(fingerprints(df, {"text": "fingerprint", "edited": "edited_fingerprint"}))
    likeness = lambda a, b: 1 - distance(F.col(a), F.col(b)) / F.lit(float(BITS))
    out = with_next(prints, "fingerprint", "doc_id", "_sha", "_next")
    out = out.withColumns({"near_edited": likeness("fingerprint", "edited_fingerprint"), "near_next": likeness("fingerprint", "_next")})
    asked = F.col("doc_id") % search_every == 0
    pairs = cut(within(prints, prints.filter(asked), NEAR))
    classes = prints.groupBy(F.col("fingerprint").alias("found")).agg(F.min("doc_id").alias("_first"))
    # a file of pairs is many times smaller than its rows, so its size must not decide on a broadcast either
    ids = pairs.join(classes.hint("merge"), "found").groupBy("query").agg(F.sort_array(F.collect_set(F.when(F.col("query") != F.col("found"), F.col("_first")))).alias("near_ids"))
    near = pairs.groupBy("query").agg((F.sum("n") - 1).alias("_near")).join(ids, "query")
    # rows that ask nothing have keys that no fingerprint has, each its own: as nulls they would all meet in one task
    own = F.concat_ws("-", F.lit(""), F.col("doc_id").cast("string"), "_sha")
    out = out.withColumn("_query", F.when(asked, F.col("fingerprint")).otherwise(own)).join(near, F.col("_query") == F.col("query"), "left")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", F.col("_near").alias("n_near"), "near_ids")

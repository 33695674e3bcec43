"""Removal of repeated runs of lines, by suffix ranks over sequences of line ids.

A run is a sequence of consecutive lines (blank ones left out) of at least `min_words` words together. Every run that stood
earlier, in a document of smaller id or before in the same one, is removed; its first copy stays.

The lines of all documents are one sequence of ids, cut at lines that occur once, which no repeated run can hold. Prefix doubling
ranks suffixes by their first 1, 2, 4, ... lines: a suffix's new rank is its old rank plus the number of suffixes of that rank
whose continuation ranks lower. Suffixes that share a rank are an interval of the suffix array whose longest common
prefix is at least that long. As each line has a word, min_words words take at most min_words lines, so doubling ends there, after six
rounds for 50. From each line the least run of min_words words forwards, and to each line the least one backwards, is named by the
ranks of two overlapping blocks of a power of two; the smallest place of an interval is the first copy, and the others
are repeated. The union of these least runs is the union of all repeated runs, however long.

Ranks, counts and first copies are partial aggregates joined back by rank; no interval is gathered in one place, and the continuations of
one rank are summed in parts. Lines are equal if two hashes of 96 bits together are.

Null text has no lines and stays null. Null doc ids come last. Rows that repeat a doc_id and text get the same result as
their first. Extra columns pass through whatever their names, but n_lines and n_removed are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankpulse.llm.common import SPACE, WORD, cut, text_of

MIN_WORDS = 50
KEY = ["_d", "_t"]
LINE = ["line", "check"]
#: Parts of the ranks, by which the continuations of one rank are summed.
PARTS = 4096


def _least(words: Column, min_words: int) -> Column:
    """How many of these word counts, from the first, make min_words; null if all don't."""
    start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("lines"))

    def step(a: Column, n: Column) -> Column:
        return F.when(a.words >= min_words, a).otherwise(F.struct((a.words + n).alias("words"), (a.lines + 1).alias("lines")))

    return F.aggregate(words, start, step, lambda a: F.when(a.words >= min_words, a.lines))


def _lines(docs: DataFrame) -> DataFrame:
    """One row a line that isn't blank: document key, place among such lines, number among all lines, id, words."""
    raw = F.transform(F.split(text_of("_text"), "\n", -1), lambda x, p: F.struct(p.alias("pos"), F.xxhash64(x).alias("line"), F.hash(x).alias("check"), F.regexp_count(x, F.lit(WORD)).alias("n")))
    return docs.select(*KEY, F.posexplode(F.filter(raw, lambda x: x.n > 0)).alias("idx", "_l")).select(*KEY, "idx", "_l.pos", "_l.line", "_l.check", "_l.n")


def _with_runs(ranked: DataFrame, min_words: int) -> DataFrame:
    """Adds how many lines from (ahead) and up to (back) each have min_words words, among neighbours that are all here."""
    df = ranked.withColumn("_part", F.col("idx") - F.row_number().over(Window.partitionBy(*KEY).orderBy("idx")))
    order = Window.partitionBy(*KEY, "_part").orderBy("idx")
    ahead = F.collect_list("n").over(order.rowsBetween(0, min_words - 1))
    back = F.collect_list("n").over(order.rowsBetween(-(min_words - 1), 0))
    df = df.withColumns({"_ahead": ahead, "_back": back})
    return df.withColumns({"ahead": _least(F.col("_ahead"), min_words), "back": _least(F.reverse("_back"), min_words)}).drop("_part", "_ahead", "_back", "n")


def _first_ranks(lines: DataFrame) -> DataFrame:
    """Lines that occur twice or more with their rank: how many occurrences have a smaller id. Sums go over 4096 parts of the id space, then within."""
    counts = lines.groupBy(*LINE).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("_part", F.shiftright("line", 52))
    parts = counts.groupBy("_part").agg(F.sum("n").alias("s"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("_part").orderBy(*LINE).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_in", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(parts, "_part").select(*LINE, (F.col("_base") + F.col("_in")).alias("r0"))


def _double(ranked: DataFrame, k: int, all_lines: int) -> DataFrame:
    """Adds r<k+1>, the rank by 2^(k+1) lines, null where lines that occur once or the document's end come first or no other suffix has it. Ranks are below all_lines."""
    h, r = 1 << k, f"r{k}"
    order = Window.partitionBy(*KEY).orderBy("idx")
    after = F.when(F.lead("idx", h).over(order) == F.col("idx") + h, F.lead(r, h).over(order))
    df = ranked.withColumn("_after", F.when(F.col(r).isNotNull(), after))
    pairs = df.filter("_after is not null").groupBy(F.col(r).alias("_a"), F.col("_after").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    pairs = pairs.withColumn("_p", F.floor(F.col("_b") * PARTS / max(all_lines, 1)).cast("int"))
    smaller = Window.partitionBy("_a", "_p").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("_a").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = pairs.groupBy("_a", "_p").agg(F.sum("_n").alias("_s")).select("_a", "_p", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    pairs = pairs.withColumn("_in", F.coalesce(F.sum("_n").over(smaller), F.lit(0))).filter("_n > 1").join(parts, ["_a", "_p"])
    pairs = pairs.select("_a", "_b", (F.col("_a") + F.col("_base") + F.col("_in")).alias("_rank"))
    out = df.join(pairs, (F.col(r) == F.col("_a")) & (F.col("_after") == F.col("_b")), "left")
    return out.select(*ranked.columns, F.col("_rank").alias(f"r{k + 1}"))


def repeated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The line numbers to remove: key, and ranges, an array of (first, last). docs has the key columns and _text."""
    lines = cut(_lines(docs))
    # from here on only lines that occur twice or more; repeated rows of a document fall together
    all_lines = lines.count()
    lines = lines.join(_first_ranks(lines), LINE).drop(*LINE).dropDuplicates([*KEY, "idx"])
    ranked = cut(_with_runs(lines, min_words))
    lines = ranked
    levels = max(1, min_words).bit_length()
    for k in range(levels - 1):
        ranked = _double(ranked, k, all_lines)
        if k % 2:
            ranked = cut(ranked)
    ranked = cut(ranked)
    ahead = ranked.filter("ahead is not null").select(*KEY, "idx", F.col("ahead").alias("m"))
    back = ranked.filter("back is not null").select(*KEY, (F.col("idx") - F.col("back") + 1).alias("idx"), F.col("back").alias("m"))
    runs = ahead.unionByName(back).distinct().withColumn("_k", F.floor(F.log2("m") + 1e-9).cast("int"))
    rank = F.get(F.array(*[F.col(f"r{k}") for k in range(levels)]), F.col("_k"))
    places = ranked.select(*KEY, "idx", "pos", *[f"r{k}" for k in range(levels)])
    runs = runs.join(places.withColumnRenamed("pos", "_pos"), [*KEY, "idx"]).withColumn("_r1", rank).drop("_pos", *[f"r{k}" for k in range(levels)]).filter("_r1 is not null")
    runs = runs.withColumns({"_start": F.col("idx"), "idx": (F.col("idx") + F.col("m") - F.round(F.pow(F.lit(2.0), F.col("_k")))).cast("int")})
    runs = cut(runs.join(places, [*KEY, "idx"]).withColumn("_r2", rank).filter("_r2 is not null").select(*KEY, F.col("_start").alias("idx"), "m", "_r1", "_r2"))
    place = F.struct("_d", "_t", "idx")
    # written, so that the join below deals out anew and a very common run can be split
    firsts = cut(runs.groupBy("m", "_r1", "_r2").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"))
    later = runs.join(firsts, ["m", "_r1", "_r2"]).filter(place != F.col("_first")).select(*KEY, "idx", (F.col("idx") + F.col("m") - 1).cast("int").alias("_end")).distinct()
    order = Window.partitionBy(*KEY).orderBy("idx", "_end")
    reach = F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reach.isNull() | (F.col("idx") > reach + 1), 1).otherwise(0)
    islands = later.withColumn("_new", begins).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    islands = islands.groupBy(*KEY, "_island").agg(F.min("idx").alias("idx"), F.max("_end").alias("_end"))
    at = lines.select(*KEY, "idx", F.col("pos"))
    islands = islands.join(at.withColumnRenamed("pos", "_from"), [*KEY, "idx"]).drop("idx").withColumnRenamed("_end", "idx").join(at.withColumnRenamed("pos", "_to"), [*KEY, "idx"])
    return islands.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("_from", "_to"))).alias("_ranges"))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with repeated runs removed from text, and n_lines, n_removed (lines, blank ones within a run included)."""
    # the key: doc_id with null last, and a hash of the text; none of its parts is null
    id_ = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"))
    keyed = docs.select(id_.alias("_d"), F.xxhash64("text").alias("_t"), F.struct(*docs.columns).alias("_doc"))
    ranges = cut(repeated(keyed.select(*KEY, F.col("_doc.text").alias("_text")), min_words))
    # ranges grow with the documents: a broadcast would fit small tables only
    df = keyed.join(ranges.hint("merge"), KEY, "left")
    lines = F.split(text_of("_doc.text"), "\n", -1)
    kept = F.filter(lines, lambda x, p: ~F.exists("_ranges", lambda v: (p >= v["_from"]) & (p <= v["_to"])))
    text = F.when(F.col("_ranges").isNull(), F.col("_doc.text")).otherwise(F.array_join(kept, "\n"))
    removed = F.coalesce(F.aggregate("_ranges", F.lit(0).cast("long"), lambda a, v: a + v["_to"] - v["_from"] + 1), F.lit(0).cast("long"))
    kept_columns = [text.alias("text") if c == "text" else F.col("_doc")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return df.select(*kept_columns, F.size(lines).cast("long").alias("n_lines"), removed.alias("n_removed"))


def blank(text: Column) -> Column:
    """Whether a text has no words."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE)) == ""

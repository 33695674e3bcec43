"""Which stored item an incoming record is: by hard keys, else by similarity within a block."""

from __future__ import annotations

import functools
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from rankpulse.functions import text as T
from rankpulse.sources.shared import cut


def ratio(a: str, b: str) -> float:
    """SequenceMatcher(None, a, b).ratio(), the same number in less time for long texts.

    There, in b of 200 characters or more, frequent characters begin no match. So matches begin in runs of the others, which are short and few: a stretch is searched run by
    run, runs no longer than the match that is known are skipped, and characters of b outside of the stretch are never looked at.
    """
    if not a and not b:
        return 1.0
    places: dict[str, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    if len(b) >= 200:
        places = {x: js for x, js in places.items() if len(js) <= len(b) // 100 + 1}
    starts, ends = [], []
    for i, x in enumerate(a):
        if x in places:
            if ends and ends[-1] == i:
                ends[-1] = i + 1
            else:
                starts.append(i)
                ends.append(i + 1)
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        at, to, size = alo, blo, 0
        for r in range(bisect_right(ends, alo), len(starts)):
            first, last = starts[r], ends[r]
            if first >= ahi:
                break
            if last - first <= size:
                continue
            first, last = max(first, alo), min(last, ahi)
            if last - first <= size:
                continue
            known: dict[int, int] = {}
            for i in range(first, last):
                js = places[a[i]]
                js = js[bisect_left(js, blo) : bisect_left(js, bhi)]
                known = {j: known.get(j - 1, 0) + 1 for j in js} if known else dict.fromkeys(js, 1)
                if known and (most := max(known.values())) > size:
                    # the first of the longest is what one after the other would have kept
                    j = next(j for j, k in known.items() if k == most)
                    at, to, size = i - most + 1, j - most + 1, most
        while at > alo and to > blo and a[at - 1] == b[to - 1]:
            at, to, size = at - 1, to - 1, size + 1
        while at + size < ahi and to + size < bhi and a[at + size] == b[to + size]:
            size += 1
        if size:
            total += size
            if alo < at and blo < to:
                todo.append((alo, at, blo, to))
            if at + size < ahi and to + size < bhi:
                todo.append((at + size, ahi, to + size, bhi))
    return 2.0 * total / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def sequence_ratio(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp similarity of two texts, the first being the incoming one; two empty ones are equal."""
    for a, b in parts:
        yield pd.Series([1.0 if x == y else ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=float)


def match_score(intro: Column, chapters: Column, title: Column, same_category: Column) -> Column:
    return 0.65 * intro + 0.25 * chapters + 0.10 * title + F.when(same_category, 0.03).otherwise(0.0)


def priority_match(incoming: DataFrame, stored: DataFrame, key: str, uid: str, rules: Sequence[Sequence[str]]) -> DataFrame:
    """For each incoming key the smallest stored uid that agrees on the first set of columns that any agrees on, and that set's number.

    Values that are missing or empty agree with nothing.
    """
    out = incoming.select(key, *sorted({c for cols in rules for c in cols}))
    hits = []
    for i, cols in enumerate(rules):
        full = F.lit(True)
        for c in cols:
            full = full & (F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
        right = stored.filter(full).groupBy(*cols).agg(F.min(uid).alias(f"_hit{i}"))
        out = out.join(right, list(cols), "left")
        hits.append(f"_hit{i}")
    rule = F.coalesce(*[F.when(F.col(h).isNotNull(), F.lit(i)) for i, h in enumerate(hits)])
    return out.select(key, F.coalesce(*hits).alias("matched_uid"), rule.alias("matched_rule"))


#: Numbers of 64 bits in the signature of a set.
SIGNATURE = 16


def _ordered(sets: DataFrame) -> DataFrame:
    """Of each set (_h, _words): _h, _n, and _all, its words' hashes from the rarest on.

    Words go by a 64-bit hash: two that share one only add candidates. The empty set has the empty word.
    """
    n = F.size("_words")
    hashes = F.transform(F.when(n == 0, F.array(F.lit(""))).otherwise(F.col("_words")), lambda x: F.xxhash64(x))
    each = sets.select("_h", n.alias("_n"), F.explode(hashes).alias("_word"))
    often = each.groupBy("_word").agg(F.count(F.lit(1)).alias("_often"))
    return each.join(often, "_word").groupBy("_h", "_n").agg(F.sort_array(F.collect_list(F.struct("_often", "_word"))).alias("_all"))


def _first(ordered: DataFrame, least: float) -> DataFrame:
    """The rarest words of each set, so many that two sets of a Jaccard similarity of at least `least` share one: _h, _n, _word."""
    # the bound is a little lower than exact arithmetic has it: rounding must not lose a pair
    some = F.greatest(F.lit(1), F.col("_n") - F.ceil(least * F.col("_n") - 1e-6).cast("int") + 1)
    return ordered.select("_h", "_n", F.explode(F.transform(F.slice("_all", F.lit(1), some), lambda x: x["_word"])).alias("_word"))


def _prefixes(sets: DataFrame, least: float) -> DataFrame:
    return _first(_ordered(sets), least)


#: Texts of a tile: those of a block are dealt out by their number of words, and two tiles are compared in one task.
TILE = 1 << 13
#: Texts of one tile and of the other that are compared at once, so that what is in between stays in a core's cache.
STEP = 32, 2048
#: Texts that are fetched by sending their hashes to all executors; more are fetched by a shuffle of all texts.
FEW = 500_000


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces _hashes, those of a set's words, by _n and its signature: which of 64 * SIGNATURE groups of words it has an odd number of.

    Two sets differ in at least as many words as in groups. Large sets have the same for at least four groups a word too, in _wide; halves that are put together by
    exclusive or are the signature of half the groups.
    """
    for batch in batches:
        lists = batch.column("_hashes")
        sizes, values = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy()
        ends = np.cumsum(sizes)
        narrow, wide = np.empty((len(sizes), SIGNATURE), np.uint64), []
        for i in range(0, len(sizes), 512):
            n = sizes[i : i + 512]
            bits = 64 * SIGNATURE << np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) * 4 / (64 * SIGNATURE)))).astype(np.int64)
            start = np.cumsum(bits) - bits
            own = values[ends[i] - sizes[i] : ends[i] - sizes[i] + n.sum()]
            odd = np.bincount(np.repeat(start, n) + (own & np.repeat(bits - 1, n)), minlength=bits.sum()) & 1
            words = np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")
            for k, (at, size) in enumerate(zip(start // 64, bits // 64, strict=True)):
                whole = words[at : at + size]
                narrow[i + k] = np.bitwise_xor.reduce(whole.reshape(-1, SIGNATURE), axis=0)
                wide.append(whole.tobytes() if size > SIGNATURE else b"")
        kept = [x for x in batch.schema.names if x != "_hashes"]
        columns = [batch.column(x) for x in kept] + [pa.array(sizes, pa.int64())] + [pa.array(narrow[:, k].view(np.int64)) for k in range(SIGNATURE)] + [pa.array(wide, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, [*kept, "_n", *[f"_s{k}" for k in range(SIGNATURE)], "_wide"])


def _near(least: float) -> Callable[[pa.Table], pa.Table]:
    """Compares all texts of two tiles, or of one with itself: the pairs whose signatures allow a Jaccard similarity of `least`, from each incoming text to each stored one."""
    low = least - 1e-9
    # of sets of both words together, no more can be apart
    share = (1 - low) / (1 + low)

    def near(table: pa.Table) -> pa.Table:
        order = np.argsort(table["_n"].to_numpy(), kind="stable")
        column = lambda name: table[name].to_numpy()[order]
        n, side, h, asked, held = column("_n"), column("_side"), column("_h"), column("_asked"), column("_held")
        signs = np.stack([column(f"_s{k}") for k in range(SIGNATURE)]).view(np.uint64)
        wide = table["_wide"].to_pylist()
        width = np.array([len(wide[i]) // 8 for i in order], np.int64)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        alone = not len(b)
        if alone:
            b = a
        na, nb, sa, sb = n[a], n[b], np.ascontiguousarray(signs[:, a]), np.ascontiguousarray(signs[:, b])
        folds: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def folded(size: int) -> tuple[np.ndarray, np.ndarray]:
            """Signatures of so many numbers, and the place of each text's."""
            if size not in folds:
                rows = np.flatnonzero(width >= size)
                place = np.zeros(len(n), np.int64)
                place[rows] = np.arange(len(rows))
                folds[size] = np.array([np.bitwise_xor.reduce(np.frombuffer(wide[order[r]], "<u8").reshape(-1, size), axis=0) for r in rows], np.uint64), place
            return folds[size]

        def finer(p: np.ndarray, q: np.ndarray, least_apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Of pairs of places those that larger signatures allow too, and in how many words they differ at least."""
            size = 2 * SIGNATURE
            while (both := np.flatnonzero((width[p] >= size) & (width[q] >= size))).size:
                keep = np.ones(len(p), bool)
                prints, place = folded(size)
                for k in range(0, len(both), max(1, (1 << 21) // size)):
                    some = both[k : k + max(1, (1 << 21) // size)]
                    apart = np.bitwise_count(prints[place[p[some]]] ^ prints[place[q[some]]]).sum(1, dtype=np.int64)
                    least_apart[some], keep[some] = apart, apart <= (n[p[some]] + n[q[some]]) * share
                p, q, least_apart, size = p[keep], q[keep], least_apart[keep], 2 * size
            return p, q, least_apart

        found, waiting = [], []
        for i in range(0, len(a), STEP[0]):
            x, nx = sa[:, i : i + STEP[0]], na[i : i + STEP[0]]
            first = max(np.searchsorted(nb, low * nx[0] - 1e-6), i if alone else 0)
            last = np.searchsorted(nb, nx[-1] / low + 1e-6, "right") if low > 0 else len(nb)
            for j in range(first, last, STEP[1]):
                y, ny = sb[:, j : min(j + STEP[1], last)], nb[j : min(j + STEP[1], last)]
                most = ((nx[:, None] + ny[None, :]) * share).astype(np.int32)
                apart = np.zeros(most.shape, np.int32)
                for k in range(SIGNATURE // 2):
                    apart += np.bitwise_count(x[k][:, None] ^ y[k][None, :])
                p, q = np.nonzero(apart <= most)
                rest = np.bitwise_count(x[SIGNATURE // 2 :, p] ^ y[SIGNATURE // 2 :, q]).sum(0, dtype=np.int32)
                rest += apart[p, q]
                keep = rest <= most[p, q]
                if alone:
                    keep &= p + i < q + j
                waiting.append((a[p[keep] + i], b[q[keep] + j], rest[keep].astype(np.int64)))
                if sum(len(w[0]) for w in waiting) > 1 << 16:
                    found.append(finer(*map(np.concatenate, zip(*waiting, strict=True))))
                    waiting = []
        if waiting:
            found.append(finer(*map(np.concatenate, zip(*waiting, strict=True))))
        p, q, apart = map(np.concatenate, zip(*found, strict=True)) if found else (a[:0], a[:0], a[:0])
        one, two = asked[p] & held[q], asked[q] & held[p]
        left, right = np.concatenate([h[p[one]], h[q[two]]]), np.concatenate([h[q[one]], h[p[two]]])
        block = np.full(len(left), table["_block"][0].as_py(), np.int64)
        return pa.table({"_block": block, "_l": left, "_r": right, "_apart": np.concatenate([apart[one], apart[two]]).astype(np.int64)})

    return near


def _tiled(texts: DataFrame, least: float) -> DataFrame:
    """Pairs (_block, _l, _r, _apart) of different texts of a block, incoming (_asked) and stored (_held), whose signatures allow a similarity of `least`; they differ in _apart words or more.

    All texts of a block are compared that differ little enough in their number of words: the time grows with the square of a block, but only pairs that are left over are written, and a
    text is sent once for each tile that it is compared with.
    """
    sizes = texts.groupBy("_block", "_n").agg(F.count(F.lit(1)).alias("_texts"))
    before = Window.partitionBy("_block").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_texts").over(before), F.lit(0)))
    dealt = texts.join(sizes, ["_block", "_n"]).withColumn("_tile", F.floor((F.col("_before") + F.pmod("_h", "_texts")) / TILE).cast("long"))
    dealt = cut(dealt.drop("_before", "_texts", "_chars"))
    tiles = dealt.groupBy("_block", F.col("_tile").alias("_i")).agg(F.max("_n").alias("_most"))
    others = dealt.groupBy("_block", F.col("_tile").alias("_j")).agg(F.min("_n").alias("_least"))
    pairs = tiles.join(others, "_block").filter((F.col("_i") <= F.col("_j")) & (F.col("_most") >= least * F.col("_least") - 1e-6))
    both = F.array(F.struct(F.col("_i").alias("_tile"), F.lit(0).alias("_side")), F.struct(F.col("_j").alias("_tile"), F.lit(1).alias("_side")))
    asked = pairs.select("_block", "_i", "_j", F.inline(both)).filter("_side = 0 or _i < _j")
    # a pair of tiles is few bytes and long time: a given number of partitions isn't merged by size
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = dealt.join(asked, ["_block", "_tile"]).repartition(parts, "_block", "_i", "_j")
    return met.groupBy("_block", "_i", "_j").applyInArrow(_near(least), "_block long, _l long, _r long, _apart long")


def similarity_match(incoming: DataFrame, stored: DataFrame, block: Sequence[str], key: str, uid: str, text: str, seen: str, threshold: float = 0.84, cap: int | None = None, sequence: bool = True) -> DataFrame:
    """The best stored match of each incoming record in its block, if it scores at least the threshold.

    All rows of a block are compared, or the newest `cap`, where the data model limits them. With sequence=False only words count.
    Ties go to the newest, then the smallest uid. All texts of a block are compared by signatures; what these and lengths rule out goes before texts are fetched. Of each text the pair that can
    be best is scored first, and then those that can still be as good. Texts and blocks are told apart by a 64-bit hash. A table that is compared with itself is normalised once.
    """
    normal = T.normalize_text(F.col(text))
    words = F.array_distinct(F.filter(F.split(normal, " "), lambda t: t != ""))
    same = normal if sequence else F.array_join(F.sort_array(words), " ")
    schema = ", ".join(["_block long", "_h long", "_chars int", "_n long", *[f"_s{k} long" for k in range(SIGNATURE)], "_wide binary"])

    def prepared(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """The rows with their texts, and a row with the signature of each."""
        rows = df.select(F.col(name).alias("_id"), F.col(seen).alias("_seen"), F.xxhash64(F.to_json(F.struct(*block))).alias("_block"), same.alias("_text")).withColumn("_h", F.xxhash64("_text"))
        rows = cut(rows)
        hashes = F.transform(F.array_distinct(F.filter(F.split("_text", " "), lambda t: t != "")), lambda x: F.xxhash64(x))
        return rows, rows.select("_block", "_h", F.length("_text").alias("_chars"), hashes.alias("_hashes")).mapInArrow(_sign, schema)

    # a record's own row aside, one of the two best rows of a text is its best match among the rows of that text
    lefts, asked = prepared(incoming, key)
    rights, held = (lefts, asked) if incoming is stored and key == uid else prepared(stored, uid)
    known = rights.select("_block", "_h", "_id", "_seen")
    if cap is not None:
        newest = Window.partitionBy("_block").orderBy(F.desc("_seen"), "_id")
        known = cut(known.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= cap).drop("_n"))
        held = held.join(known.select("_block", "_h").distinct(), ["_block", "_h"], "left_semi")
    rows = known.groupBy("_block", F.col("_h").alias("_r"), F.col("_id").alias("_uid")).agg(F.max("_seen").alias("_seen"))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_block", "_r").orderBy(F.desc("_seen"), "_uid"))).filter("_n <= 2").drop("_n")

    least = (threshold - 0.35) / 0.65 if sequence else threshold
    marked = lambda df, a, b: df.withColumns({"_asked": F.lit(a), "_held": F.lit(b)})
    signed = marked(asked, True, True) if held is asked else marked(asked, True, False).unionByName(marked(held, False, True))
    signs = ["_n", "_chars", *[f"_s{k}" for k in range(SIGNATURE)]]
    signed = signed.groupBy("_block", "_h").agg(*[F.max(c).alias(c) for c in ("_asked", "_held")], *[F.first(c).alias(c) for c in [*signs, "_wide"]])
    signed = cut(signed)
    pairs = _tiled(signed, least)
    slim = signed.select("_block", F.col("_h").alias("_r"), "_n", "_chars", functools.reduce(lambda x, y: x.bitwiseXOR(y), [F.col(f"_s{k}") for k in range(SIGNATURE)]).alias("_odd"))
    pairs = pairs.join(slim.withColumnsRenamed({"_r": "_l", "_n": "_own_n", "_chars": "_own_chars", "_odd": "_own_odd"}), ["_block", "_l"]).join(slim, ["_block", "_r"])
    both = F.col("_n") + F.col("_own_n")
    words_at_most = lambda apart: F.when(both == 0, 1.0).otherwise((both - apart) / F.nullif(both + apart, F.lit(0)))
    # of texts of these lengths no more can be in sequence
    chars = F.col("_chars") + F.col("_own_chars")
    most = F.when(chars == 0, 1.0).otherwise(2 * F.least("_chars", "_own_chars") / F.nullif(chars, F.lit(0)))
    pairs = pairs.withColumn("_most", 0.65 * words_at_most(F.col("_apart")) + 0.35 * most if sequence else words_at_most(F.col("_apart"))).filter(F.col("_most") >= threshold - 1e-6)
    pairs = cut(pairs.select("_block", "_l", "_r", "_most", "_n", "_own_n", "_odd", "_own_odd"))

    parts = int(incoming.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both_sides = lefts.select("_h", "_text") if rights is lefts else lefts.select("_h", "_text").unionByName(rights.select("_h", "_text"))
    needed = pairs.select(F.col("_l").alias("_h")).unionByName(pairs.select(F.col("_r").alias("_h"))).distinct()
    texts = cut(both_sides.join(F.broadcast(needed) if needed.count() <= FEW else needed, "_h", "left_semi").dropDuplicates(["_h"]))
    words_of = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda t: t != ""))
    mine = lefts.select(F.col("_id").alias(key), "_block", F.col("_h").alias("_l"))

    def scored(pairs: DataFrame) -> DataFrame:
        """The pairs that score at least the threshold."""
        pairs = pairs.join(texts.select(F.col("_h").alias("_l"), F.col("_text").alias("_own_text")), "_l").repartition(parts, "_r").join(texts.withColumnRenamed("_h", "_r"), "_r")
        pairs = pairs.withColumn("_x", F.struct(words_of("_own_text").alias("a"), words_of("_text").alias("b")))
        common, n, m = F.size(F.array_intersect("_x.a", "_x.b")), F.size("_x.a"), F.size("_x.b")
        # exploded, so that the words aren't split again wherever the similarity is used
        pairs = pairs.withColumn("_jaccard", F.explode(F.array(F.when((n == 0) & (m == 0), 1.0).otherwise(common / F.nullif(n + m - common, F.lit(0)))))).filter(F.col("_jaccard") >= least)
        score = F.col("_jaccard")
        if sequence:
            a, b = F.length("_own_text"), F.length("_text")
            most = F.when(a + b == 0, 1.0).otherwise(2 * F.least(a, b) / F.nullif(a + b, F.lit(0)))
            pairs = pairs.filter(0.65 * F.col("_jaccard") + 0.35 * most >= threshold - 1e-6)
            score = 0.65 * F.col("_jaccard") + 0.35 * sequence_ratio("_own_text", "_text")
        return pairs.withColumn("score", score).filter(F.col("score") >= threshold).select("_block", "_l", "_r", "score")

    def given(scored: DataFrame) -> DataFrame:
        """Matches of records, from those of texts."""
        return scored.join(rows, ["_block", "_r"]).join(mine, ["_block", "_l"]).filter(F.col(key) != F.col("_uid"))

    # a text is as itself, and of the others the one that can be best is scored first: others that can't be as good needn't be
    order = Window.partitionBy("_block", "_l").orderBy(F.desc("_most"), "_r")
    ranked = pairs.withColumn("_place", F.row_number().over(order))
    same_text = signed.filter("_asked and _held").select("_block", F.col("_h").alias("_l"), F.col("_h").alias("_r"), F.lit(1.0).alias("score"))
    first = cut(scored(ranked.filter("_place = 1")).unionByName(same_text.filter(F.col("score") >= threshold)))
    reached = given(first).groupBy("_block", "_l", key).agg(F.max("score").alias("_score"))
    # what all records of a text have: one without a match has 0
    reached = mine.distinct().join(reached, ["_block", "_l", key], "left").groupBy("_block", "_l").agg(F.min(F.coalesce("_score", F.lit(0.0))).alias("_reached"))
    rest = ranked.filter("_place > 1").join(reached, ["_block", "_l"]).filter(F.col("_most") >= F.col("_reached") - 1e-9)
    # the signatures put together to 64 groups, which _most implies: a last check before texts are fetched
    rest = rest.filter(words_at_most(F.bit_count(F.col("_odd").bitwiseXOR(F.col("_own_odd")))) >= least - 1e-9)
    scored = given(first.unionByName(scored(rest)))
    best = Window.partitionBy(key).orderBy(F.desc("score"), F.desc("_seen"), "_uid")
    return scored.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select(key, F.col("_uid").alias("matched_uid"), "score")


@F.pandas_udf(DoubleType())
def best_title_ratio(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The highest Ratcliff-Obershelp similarity of a title to any of several; without a title or any it is 0."""
    for titles, known in parts:
        yield pd.Series([max((SequenceMatcher(None, t, k).ratio() for k in ks), default=0.0) if t and ks is not None else 0.0 for t, ks in zip(titles, known, strict=True)], dtype=float)


#: Novels of a chapter title (and author), beyond which candidates must share one of their introductions' rare words too.
FREQUENT = 64
KEYS = ["platform", "platform_novel_id"]


def least_jaccards(threshold: float) -> tuple[float, float]:
    """The least similarities of introductions' words and of chapter titles with which match_score can reach the threshold, all else being equal."""
    return ((threshold - 0.38) / 0.65 - 0.35) / 0.65, (threshold - 0.78) / 0.25


def _side(rows: DataFrame) -> DataFrame:
    """What candidates are found by: _node, platform, _author, _sig and _words."""
    words = F.array_distinct(T.tokenize(F.coalesce("intro_norm", F.lit(""))))
    return rows.select("_node", "platform", F.coalesce("author_norm", F.lit("")).alias("_author"), "_sig", words.alias("_words")).filter((F.size("_sig") > 0) & (F.size("_words") > 0))


def candidates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs (_left, _right) of nodes that can reach the threshold: a superset of the matches, without comparing all that share a frequent title.

    An entry of the index is a platform, an author or any, and a chapter title; items without an author use the entries of any author. Of an item's titles those
    of the shortest entries count, as many as the least similarity of titles needs. Entries of more than FREQUENT novels are split by the rare words of introductions,
    of which two that reach the threshold share one.
    """
    least_words, least_titles = least_jaccards(threshold)
    # a node of both sides counts once, else its words would take the places of others
    both = left.select("_node", "_words").unionByName(right.select("_node", "_words")).dropDuplicates(["_node"])
    rare = _prefixes(both.withColumnRenamed("_node", "_h"), least_words).select(F.col("_h").alias("_node"), "_word")
    entry = ["platform", "_by", "_title"]
    routes = F.explode(F.array(F.col("_author"), F.lit(None).cast("string")))
    held = right.select("_node", "platform", routes.alias("_by"), "_sig").select("_node", "platform", F.coalesce(F.concat(F.lit("="), "_by"), F.lit("")).alias("_by"), F.explode("_sig").alias("_title"))
    sizes = held.groupBy(*entry).agg(F.count(F.lit(1)).alias("_often"))
    by = F.when(F.col("_author") == "", "").otherwise(F.concat(F.lit("="), "_author"))
    asked = left.select(F.col("_node").alias("_left"), "platform", by.alias("_by"), F.size("_sig").alias("_n"), F.explode("_sig").alias("_title")).join(sizes, entry)
    order = Window.partitionBy("_left").orderBy("_often", "_title")
    # of titles that no stored item has all are missed, so they take none of the places
    needed = F.col("_n") - F.ceil(least_titles * F.col("_n") - 1e-6) + 1
    missed = F.col("_n") - F.count(F.lit(1)).over(Window.partitionBy("_left"))
    asked = asked.withColumns({"_at": F.row_number().over(order), "_some": needed - missed}).filter("_at <= _some").select("_left", *entry, "_often")
    few = asked.filter(F.col("_often") <= FREQUENT).join(held, entry).select("_left", F.col("_node").alias("_right"))
    many = asked.filter(F.col("_often") > FREQUENT)
    split = many.join(rare.withColumnRenamed("_node", "_left"), "_left")
    hold = held.join(many.select(*entry).distinct(), entry, "left_semi").join(rare, "_node")
    lots = split.join(hold, [*entry, "_word"]).select("_left", F.col("_node").alias("_right"))
    return few.unionByName(lots).distinct()


#: What a match's score depends on: records that agree on all of it are one class.
PARTS = ["platform", "author_norm", "intro_norm", "main_category", "_sig", "_titles"]


def _classed(rows: DataFrame) -> DataFrame:
    """Adds _class, a hash of the parts."""
    return rows.withColumn("_class", F.sha1(F.to_json(F.struct(*PARTS))))


def _records(items: DataFrame) -> DataFrame:
    rows = items.filter("platform_novel_id is not null")
    return _classed(rows.select(*KEYS, "author_norm", "intro_norm", "main_category", F.array_distinct("chapter_titles").alias("_sig"), F.array("title_norm").alias("_titles")))


def _stored(novels: DataFrame, titles: DataFrame) -> DataFrame:
    """The classes of stored novels that can match, each with its newest novel, of equal ones that of the smallest uid."""
    sig = F.array_distinct(F.from_json("signature_json", "chapter_title_sig array<string>").chapter_title_sig)
    rows = novels.withColumn("_sig", sig).filter("size(_sig) > 0 and intro_norm <> ''")
    known = titles.groupBy("novel_uid").agg(F.array_sort(F.collect_set("title_norm")).alias("_titles"))
    rows = _classed(rows.select("novel_uid", "last_seen_date", *PARTS[:-1]).join(known, "novel_uid", "left"))
    # of structs with a null the null is the least
    best = F.max(F.struct(F.col("last_seen_date").alias("seen"), (-F.col("novel_uid")).alias("less"))).alias("_best")
    classes = rows.groupBy("_class", *PARTS).agg(best)
    return classes.select(F.concat(F.lit("n"), "_class").alias("_node"), *PARTS, (-F.col("_best.less")).alias("_uid"), F.lit(None).cast("string").alias("_id"), F.col("_best.seen").alias("_seen"), F.lit(1).alias("_stored"))


def best_matches(items: DataFrame, novels: DataFrame, titles: DataFrame, threshold: float = 0.84, among: bool = False) -> DataFrame:
    """platform, platform_novel_id, and novel_uid or root_id, of the items whose best match scores at least the threshold.

    items are canonical records of new ids, one an id. With `among`, an item is also compared with the items of smaller ids: its match may be one of
    these, root_id, which may itself match another. Of equal scores the newest counts (items before stored novels), then the smallest uid or id.

    Records that agree on all that a score depends on are compared once, as a class (written, with a hash as its name). Of a class of novels only the newest can be a match, of
    one of items only the smallest id, so copies cost nothing and no match is lost.
    """
    if threshold <= 0.65 + 0.10 + 0.03:
        raise ValueError("a threshold of 0.78 or less can be reached without a common chapter title")
    own = _records(items)
    asked = own.groupBy("_class", *PARTS).agg(F.min("platform_novel_id").alias("_id"))
    asked = cut(asked.select(F.concat(F.lit("i"), "_class").alias("_node"), *PARTS, F.lit(None).cast("long").alias("_uid"), "_id", F.lit(None).cast("date").alias("_seen"), F.lit(0).alias("_stored")))
    held = cut(_stored(novels, titles))
    if among:
        held = held.unionByName(asked)
    found = candidates(_side(asked), _side(held), threshold)
    names = {"_node": "_right", "platform": "_platform", "author_norm": "_author", "intro_norm": "_intro", "main_category": "_category", "_sig": "_other", "_titles": "_known"}
    pairs = asked.drop("_uid", "_id", "_seen", "_stored").withColumnsRenamed({"_node": "_left", "_titles": "_own"}).join(found, "_left").join(held.withColumnsRenamed(names), "_right")
    pairs = pairs.filter((F.col("platform") == F.col("_platform")) & ((F.coalesce("author_norm", F.lit("")) == "") | (F.col("author_norm") == F.col("_author"))))
    words = T.jaccard(T.tokenize(F.coalesce("intro_norm", F.lit(""))), T.tokenize(F.coalesce("_intro", F.lit(""))))
    chapters = T.jaccard(F.col("_sig"), F.col("_other"))
    same = (F.col("main_category") != "") & (F.col("main_category") == F.col("_category"))
    # the parts that need Python are at most 1 each: pairs that can't reach the threshold don't go there
    most = match_score(0.65 * words + 0.35, chapters, F.lit(1.0), same)
    pairs = pairs.withColumns({"_jaccard": words, "_chapters": chapters, "_same": F.coalesce(same, F.lit(False))}).filter(most >= threshold - 1e-9)
    # a pair's bytes are few and its time is long: a given number of partitions isn't merged by size
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.select("_left", "_right", "_own", "_known", "intro_norm", "_intro", "_jaccard", "_chapters", "_same", "_stored", "_seen", "_uid", "_id").repartition(parts, "_left", "_right")
    both = (F.coalesce("intro_norm", F.lit("")) != "") & (F.coalesce("_intro", F.lit("")) != "")
    pairs = pairs.withColumns({"_ratio": F.when(both, sequence_ratio("intro_norm", "_intro")).otherwise(0.0), "_title": best_title_ratio(F.col("_own")[0], "_known")})
    scored = pairs.withColumn("score", match_score(0.65 * F.col("_jaccard") + 0.35 * F.col("_ratio"), F.col("_chapters"), F.col("_title"), F.col("_same"))).filter(F.col("score") >= threshold)
    order = [F.desc("score"), "_stored", F.desc("_seen"), "_uid", "_id"]
    # an item takes the first whose id is smaller than its own, or that is stored: what comes after a stored one, or after one of a smaller id, is never taken
    before = Window.partitionBy("_left").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = scored.withColumns({"_least": F.min("_id").over(before), "_done": F.coalesce(F.max("_stored").over(before), F.lit(0))})
    ahead = ahead.filter((F.col("_done") == 0) & ((F.col("_stored") == 1) | F.col("_least").isNull() | (F.col("_id") < F.col("_least"))))
    ahead = ahead.select(F.substring("_left", 2, 40).alias("_class"), "score", "_stored", "_seen", "_uid", "_id")
    taken = own.select(*KEYS, "_class").join(ahead, "_class").filter((F.col("_stored") == 1) | (F.col("_id") < F.col("platform_novel_id")))
    best = Window.partitionBy(*KEYS).orderBy(*order)
    return taken.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select(*KEYS, F.col("_uid").alias("novel_uid"), F.col("_id").alias("root_id"))


def follow(matches: DataFrame, once: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """Matches whose root_id is itself matched are given that one's match, until each has a stored novel or an item that is new. Each step doubles the reach."""
    step = 0
    while not matches.filter("root_id is not null").isEmpty():
        to = matches.select("platform", F.col("platform_novel_id").alias("root_id"), F.col("novel_uid").alias("_uid"), F.col("root_id").alias("_next"), F.lit(True).alias("_more"))
        joined = matches.join(to, ["platform", "root_id"], "left")
        moved = once(joined.select(*KEYS, F.coalesce("novel_uid", "_uid").alias("novel_uid"), F.when(F.col("_uid").isNull(), F.coalesce("_next", "root_id")).alias("root_id"), F.coalesce("_more", F.lit(False)).alias("_more")), f"followed{step}")
        more = not moved.filter("_more").isEmpty()
        matches, step = moved.drop("_more"), step + 1
        if not more:
            break
    return matches


def resolve_items(items: DataFrame, novels: DataFrame, titles: DataFrame, threshold: float = 0.84) -> DataFrame:
    """(platform, platform_novel_id, novel_uid, matched_by) of the items that are stored ones: by their id ("id"), else the most similar at or
    above the threshold ("similarity"). Others have no row; they are new.

    items are canonical records, one a key, with chapter_titles, an array of normalised titles or null. Candidates are of the same platform
    and author, or of any author if the item has none. All of them are scored that can reach the threshold: words, sequence, title and
    category alone give less than 0.84, so a match shares chapter titles and words of the introduction, and candidates are found by equi-joins on
    these. With a threshold that needs no chapters that would lose some, so it is refused. Of equal scores the newest, then the smallest uid counts.
    """
    by_id = items.select(*KEYS).join(novels.select(*KEYS, "novel_uid"), KEYS).withColumn("matched_by", F.lit("id"))
    rest = items.join(novels.select(*KEYS), KEYS, "left_anti")
    return by_id.unionByName(best_matches(rest, novels, titles, threshold).select(*KEYS, "novel_uid", F.lit("similarity").alias("matched_by")))

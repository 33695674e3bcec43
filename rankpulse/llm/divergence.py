"""Source divergence audit: how far the term frequencies of each source of a language are from those of the other sources and of the whole.

Two passes over the documents. The first counts in how many documents of its language each term stands and keeps those of MIN_DOCUMENTS or
more; tasks send one row a term, counts are exact. The kept terms of a language fall into shards by checksum, of some KEYS
terms and SHARD_BYTES bytes each, and for each shard a task builds a minimal perfect hash: levels of bits, in each of which a key that is alone at its place stays, the
others go on to the next; a key's slot is the number of set bits before its own. The second pass gets the shards as broadcasts of WAVE_BYTES
at most (if there is more, there are further passes), finds the slots of the distinct terms that a task has read, compares the key stored
there, as any term has some slot, and adds to dense arrays of slots, one for each group and shard. The arrays of a task hold HELD_SLOTS at most:
when full they are sent, as one row for each slot that isn't 0.

Shares are integers: p = 1 + floor(SCALE * (count + 1) / (N + V)). Sums over all kept terms for all pairs of a language's sources are made
in numpy for blocks of slots and tiles of TILE sources, so memory is bounded for any number of sources.

Null text, lang and source are read as ''. A group without terms, and one of a language without kept terms, takes part. Repeated rows are documents of their
own; ids and other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankpulse.llm.common import cut

MIN_DOCUMENTS = 3
SCALE = 1_000_000_000
TOP = 200
#: Terms of a shard, on average, and bytes of its terms.
KEYS = 32_768
SHARD_BYTES = 4 << 20
#: Bytes of shards that are broadcast together, unless one alone has more.
WAVE_BYTES = 64 << 20
#: Bits of a level for each key that is left.
GAMMA = 1.6
LEVELS = 48
#: Distinct terms that a task holds, and slots of its dense arrays.
HELD_TERMS = 700_000
HELD_SLOTS = 4_000_000
#: Bytes of a text that are split at once.
PIECE = 4 << 20
#: Bits of a cell's number that are its slot; a shard has fewer keys by far.
SLOT_BITS = 24
#: Slots and sources that are compared at once.
WIDTH = 2048
TILE = 512

#: Bytes of terms, with A-Z in lower case; all others are spaces.
_TERM = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """All terms of a text in UTF-8, in lists of a bounded part of it."""
    begin = 0
    while begin < len(text):
        part = text[begin : begin + PIECE].translate(_TERM)
        end = len(part)
        if begin + end < len(text):
            end = part.rfind(b" ") + 1
            if not end:  # a term longer than a piece goes on to the next byte that isn't one
                stop = next((i for i in range(begin + len(part), len(text)) if _TERM[text[i]] == 32), len(text))
                part = text[begin:stop].translate(_TERM)
                end = len(part)
        yield part[:end].split()
        begin += end


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Rows of these columns and the text as bytes, some at a time."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            part = batch.slice(begin, 256)
            yield from zip(*[part.column(c).to_pylist() for c in columns], part.column("text").to_pylist(), strict=True)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, term and in how many documents it is, of what a task has read; sent when HELD_TERMS are held."""
    held: dict[str, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, terms in held.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(terms), pa.string()), "term": pa.array(list(terms), pa.binary()), "n": pa.array(list(terms.values()), pa.int64())})
        held.clear()

    for k, (lang, text) in enumerate(_rows(batches, "lang")):
        held.setdefault(lang, Counter()).update(set().union(*terms_of(text)))
        if k % 64 == 63 and sum(map(len, held.values())) > HELD_TERMS:
            yield from out()
    yield from out()


def _hashes(keys: list[bytes], seed: int) -> np.ndarray:
    """Two 64-bit hashes of each key."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(k, seed) for k in keys]), dtype="<u8").reshape(-1, 2)


def _places(h: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h[:, 0] + np.uint64(level) * (h[:, 1] | np.uint64(1))
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(32)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Slots 0 to n - 1 for n keys; a key that isn't stored has any slot or none."""

    def __init__(self, seed: int, sizes: list[int], bits: bytes, keys: list[bytes] | None = None):
        self.seed, self.sizes, self.bits, self.keys = seed, list(sizes), bits, keys
        self.set = np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).astype(bool)
        self.before = np.r_[0, np.cumsum(self.set)].astype(np.int64)

    @classmethod
    def build(cls, keys: list[bytes]) -> PerfectHash:
        for seed in range(1 << 16):
            left, sizes, levels = _hashes(keys, seed), [], []
            while len(left) and len(sizes) < LEVELS:
                size = int(len(left) * GAMMA) + 8
                at = _places(left, len(sizes), size)
                alone = np.bincount(at, minlength=size) == 1
                sizes.append(size)
                levels.append(alone)
                left = left[~alone[at]]
            if not len(left):
                break
        else:
            raise ValueError("keys are repeated")
        made = cls(seed, sizes, np.packbits(np.concatenate(levels)).tobytes() if levels else b"")
        slots = made.slots(keys)
        made.keys = [keys[i] for i in np.argsort(slots)]
        return made

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """The slot that each key would have, -1 if none."""
        h, out = _hashes(keys, self.seed), np.full(len(keys), -1, dtype=np.int64)
        left, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = base + _places(h[left], level, size)
            found = self.set[at]
            out[left[found]] = self.before[at[found]]
            left, base = left[~found], base + size
            if not len(left):
                break
        return out

    def verified(self, keys: list[bytes]) -> np.ndarray:
        """The slot of each key that is stored, -1 for others."""
        if not self.keys:
            return np.full(len(keys), -1, dtype=np.int64)
        slots = self.slots(keys)
        same = np.fromiter(map(operator.eq, map(self.keys.__getitem__, slots.tolist()), keys), dtype=bool, count=len(keys))
        return np.where(same & (slots >= 0), slots, -1)


#: Keys are there one by one, and as one text with their ends, which is what is broadcast.
SHARD = "lang string, part int, size int, seed int, sizes array<int>, bits binary, keys array<binary>, joined binary, ends binary, bytes long"


def _shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    made = PerfectHash.build(sorted(map(bytes, rows["term"])))
    joined, ends = b"".join(made.keys), np.cumsum([len(k) for k in made.keys], dtype="<i8").tobytes()
    size = len(joined) + 64 * len(made.keys)
    return pd.DataFrame([(key[0], key[1], len(made.keys), made.seed, made.sizes, made.bits, made.keys, joined, ends, size)], columns=[c.split()[0] for c in SHARD.split(", ")])


def shards(kept: DataFrame, keys: int = KEYS) -> DataFrame:
    """Perfect hashes of the kept terms (lang, term) as a written table, with a number for each and the wave it is broadcast in."""
    sizes = kept.groupBy("lang").agg(F.greatest(F.ceil(F.count(F.lit(1)) / keys), F.ceil(F.sum(F.length("term")) / SHARD_BYTES)).alias("_parts"))
    dealt = kept.join(sizes, "lang").select("lang", "term", F.pmod(F.crc32("term"), F.col("_parts")).cast("int").alias("part"))
    # by both, as the join may have left all parts of a language together
    made = cut(dealt.repartition("lang", "part").groupBy("lang", "part").applyInPandas(_shard, SHARD))
    # a row for each shard: some thousands for each hundred million terms
    order = Window.orderBy("lang", "part")
    before = F.coalesce(F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = made.select("lang", "part", F.row_number().over(order).cast("long").alias("shard"), F.floor(before / WAVE_BYTES).cast("int").alias("wave"))
    return cut(made.join(placed, ["lang", "part"]))


def _split(joined: bytes, ends: bytes) -> list[bytes]:
    at = np.frombuffer(ends, dtype="<i8").tolist()
    return [joined[a:b] for a, b in zip([0, *at[:-1]], at, strict=True)]


def _recount(broadcast):
    """source_key, cell (shard and slot) and how often its term stands there, of what a task has read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[str, dict[int, tuple[int, PerfectHash]]] = {}
        parts: dict[str, int] = {}
        for r in broadcast.value:
            hashes.setdefault(r["lang"], {})[r["part"]] = r["shard"], PerfectHash(r["seed"], r["sizes"], r["bits"], _split(r["joined"], r["ends"]))
            parts[r["lang"]] = r["parts"]
        seen: dict[tuple[str, int], Counter] = {}
        slots: dict[tuple[int, int], np.ndarray] = {}

        def add() -> None:
            for (lang, source), terms in seen.items():
                at = np.fromiter(map(zlib.crc32, terms), dtype=np.int64, count=len(terms)) % parts[lang]
                keys, n = list(terms), np.fromiter(terms.values(), dtype=np.int64, count=len(terms))
                order = np.argsort(at, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(at[order])) + 1) if len(order) else ():
                    shard, found = hashes[lang].get(int(at[own[0]]), (0, None))
                    if found is None:  # in another wave
                        continue
                    slot = found.verified([keys[i] for i in own.tolist()])
                    known = slot >= 0
                    if known.any():
                        dense = slots.setdefault((source, shard), np.zeros(len(found.keys), dtype=np.int64))
                        dense[slot[known]] += n[own[known]]  # terms are distinct, and so are their slots
            seen.clear()

        def out() -> Iterator[pa.RecordBatch]:
            for (source, shard), dense in slots.items():
                at = np.flatnonzero(dense)
                yield pa.RecordBatch.from_pydict({"source_key": np.full(len(at), source, dtype=np.int64), "cell": (shard << SLOT_BITS) + at, "n": dense[at]})
            slots.clear()

        for k, (lang, source, text) in enumerate(_rows(batches, "lang", "source_key")):
            if lang not in hashes:
                continue
            group = seen.setdefault((lang, source), Counter())
            for terms in terms_of(text):
                group.update(terms)
            if k % 64 == 63 and sum(map(len, seen.values())) > HELD_TERMS:
                add()
                if sum(map(len, slots.values())) > HELD_SLOTS:
                    yield from out()
        add()
        yield from out()

    return run


def recount(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """source_key, cell and n of all kept terms that a group has, as a written table. docs: lang, source_key, a number of lang and source, and text."""
    spark, schema = docs.sparkSession, "source_key long, cell long, n long"
    found = spark.createDataFrame([], schema)
    parts = hashes.groupBy("lang").agg((F.max("part") + 1).alias("parts"))
    last = hashes.agg(F.max("wave")).first()[0]
    for wave in range(-1 if last is None else last, -1, -1):
        rows = hashes.filter(F.col("wave") == wave).join(parts, "lang").select("lang", "part", "parts", "shard", "seed", "sizes", "bits", "joined", "ends").collect()
        if not rows:
            continue
        sent = spark.sparkContext.broadcast([{k: bytes(v) if isinstance(v, bytearray) else v for k, v in r.asDict().items()} for r in rows])
        found = found.unionByName(cut(docs.mapInArrow(_recount(sent), schema).groupBy("source_key", "cell").agg(F.sum("n").alias("n"))))
        sent.unpersist()
    return found


def source_keys(docs: DataFrame) -> tuple[DataFrame, int]:
    """The groups (lang, source) of documents as a written table, and a seed with which a hash tells them apart."""
    groups = cut(docs.select("lang", "source").distinct())
    for seed in range(1 << 10):
        if not groups.groupBy(source_key(seed).alias("k")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
            return groups, seed
    raise RuntimeError("no seed tells the groups apart")


def source_key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "lang", F.length("lang"), "source")


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of longs that aren't negative."""
    return F.call_function("div", a, b)


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exactly."""
    big = lambda c: c.cast("decimal(19,0)")
    product, below = F.lit(SCALE).cast("decimal(10,0)") * big(count + 1), big(total + terms)
    wide = ((product - F.pmod(product, below)) / below).cast("long")
    return 1 + F.when(count < (1 << 63) // SCALE - 2, _div(F.lit(SCALE).cast("long") * (count + 1), total + terms)).otherwise(wide)


def apart(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / q) of shares: their squares fit in a long."""
    return _div((p - q) * (p - q), q)


def _compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Sums over a block of slots for all pairs of a source of tile a with one of tile b. Rows with slot -1 have the share of a source that a term isn't in."""
    base = rows[rows["slot"] < 0]
    width, least = int(base["width"].iloc[0]), int(base["first"].iloc[0])
    sides = []
    for tile in (key[1], key[2]):
        own = base[base["tile"] == tile].drop_duplicates("number").sort_values("number")
        numbers = own["number"].to_numpy()
        shares = np.repeat(own["p"].to_numpy()[:, None], width, axis=1)
        cells = rows[(rows["slot"] >= 0) & (rows["tile"] == tile)]
        shares[np.searchsorted(numbers, cells["number"].to_numpy()), cells["slot"].to_numpy() - least] = cells["p"].to_numpy()
        sides.append((numbers, shares))
    (a, p), (b, q) = sides
    sums = np.array([((row - q) ** 2 // q).sum(axis=1) for row in p])
    return pd.DataFrame({"lang": key[0], "a": np.repeat(a, len(b)), "b": np.tile(b, len(a)), "value": sums.ravel()}).query("a != b")


def pair_values(counts: DataFrame, groups: DataFrame, hashes: DataFrame) -> DataFrame:
    """lang, a, b (numbers of sources) and value of all pairs of a language's sources. counts: lang, number, cell, p; groups: lang, number, base."""
    tile = F.floor(F.col("number") / TILE).cast("int")
    tiles = groups.groupBy("lang").agg(F.max(tile).alias("_last"))
    others = F.sequence(F.lit(0), F.col("_last"))
    pairs = F.array_distinct(F.concat(F.transform(others, lambda x: F.struct(F.col("tile").alias("a"), x.alias("b"))), F.transform(others, lambda x: F.struct(x.alias("a"), F.col("tile").alias("b")))))
    shard, slot = F.shiftright("cell", SLOT_BITS).alias("shard"), F.col("cell").bitwiseAND((1 << SLOT_BITS) - 1).cast("int")
    cells = counts.withColumn("tile", tile).join(tiles, "lang").select("lang", F.explode(pairs).alias("t"), shard, F.floor(slot / WIDTH).cast("int").alias("block"), "tile", "number", slot.alias("slot"), "p", F.lit(0).alias("first"), F.lit(0).alias("width"))
    blocks = hashes.select("lang", "shard", "size", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / WIDTH).cast("int"))).alias("block"))
    base = groups.withColumn("tile", tile).join(tiles, "lang").select("lang", F.explode(pairs).alias("t"), "tile", "number", "base").join(blocks, "lang")
    first = F.col("block") * WIDTH
    base = base.select("lang", "t", "shard", "block", "tile", "number", F.lit(-1).alias("slot"), F.col("base").alias("p"), first.alias("first"), F.least(F.lit(WIDTH), F.col("size") - first).alias("width"))
    both = cells.unionByName(base).select("lang", F.col("t.a").alias("ta"), F.col("t.b").alias("tb"), "shard", "block", "tile", "number", "slot", "p", "first", "width")
    sums = both.groupBy("lang", "ta", "tb", "shard", "block").applyInPandas(_compare, "lang string, a long, b long, value long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = MIN_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank. docs: text, lang and source.

    part `pair`: how far a group is from each other source of its language; part `term`: the `top` kept terms that it has more of than its language.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))
    spoken = docs.filter(F.length("text") > 0)
    seen = spoken.select("lang", "text").mapInArrow(_frequencies, "lang string, term binary, n long")
    kept = cut(seen.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("lang", "term"))
    hashes = shards(kept)
    groups, seed = source_keys(docs)
    counts = recount(spoken.select("lang", source_key(seed).alias("source_key"), "text"), hashes)

    totals = counts.groupBy("source_key").agg(F.sum("n").alias("total"))
    terms = hashes.groupBy("lang").agg(F.sum("size").cast("long").alias("terms"))
    number = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")
    groups = groups.withColumn("source_key", source_key(seed)).join(totals, "source_key", "left").join(terms, "lang", "left")
    groups = cut(groups.select("lang", "source", "source_key", F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce("terms", F.lit(0)).cast("long").alias("terms")).withColumn("number", number))
    own = groups.select("source_key", "lang", "number", "total", "terms")
    shared = cut(counts.join(own, "source_key").select("lang", "source_key", "number", "cell", "n", share(F.col("n"), F.col("total"), F.col("terms")).alias("p")))

    base = groups.filter("terms > 0").select("lang", "number", share(F.lit(0).cast("long"), F.col("total"), F.col("terms")).alias("base"))
    values = pair_values(shared.select("lang", "number", "cell", "p"), base, hashes)
    names = groups.select("lang", "number", "source")
    every = names.join(names.select("lang", F.col("number").alias("b"), F.col("source").alias("item")), "lang").filter("number <> b").withColumnRenamed("number", "a")
    pairs = every.join(values, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))

    whole = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("terms").alias("terms"))
    of_lang = shared.groupBy("lang", "cell").agg(F.sum("n").alias("n")).join(whole, "lang").select("cell", share(F.col("n"), F.col("total"), F.col("terms")).alias("q"))
    more = shared.select("source_key", "cell", "p").join(of_lang, "cell").filter("p > q").select("source_key", "cell", apart(F.col("p"), F.col("q")).alias("value"))
    # those of the highest values, and all that are equal to the last of them, get their names
    rank = F.rank().over(Window.partitionBy("source_key").orderBy(F.desc("value")))
    words = hashes.select("shard", F.posexplode("keys").alias("slot", "term")).select((F.shiftleft("shard", SLOT_BITS) + F.col("slot")).alias("cell"), F.col("term").cast("string").alias("item"))
    found = more.withColumn("_rank", rank).filter(F.col("_rank") <= top).join(words, "cell").join(groups.select("source_key", "lang", "source"), "source_key")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    found = found.select("lang", "source", F.lit("term").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(found)

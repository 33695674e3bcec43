"""Exact Jaccard join of documents on word shingles, by prefixes of token combinations.

A token is a shingle. Tokens have one order: rare ones of a fixed part of the hash space, then the more frequent ones of that part
from class to class of their counts, then the rest; within a class by hash. Of two sets of similarity 0.8 or more, the one whose prefix ends first misses at most a fifth of its tokens
in the other, so a prefix that a fifth of missing tokens can't wholly spoil shares an index entry with the other's. Rare tokens, and
those of the lower classes, are entries alone. Frequent tokens fall into small groups by hash, and entries are pairs of tokens of a group; a group of c tokens is
spoilt by c - 1 missing ones, so each group lengthens the prefix by one. Short sets have no groups. Group sizes go by size class,
and a set is indexed for its class and the next, which covers all sizes that its partners can have.

Counts that tell frequent from rare are over all documents. At most MOST_FREQUENT tokens, those of the highest counts, have a class: only so
many are sent to the executors. Any such choice gives an exact join.

Equal sets are one node from the start. An index entry of m nodes could give m * m pairs, and a group of near copies has many
such entries. So entries of more than MANY nodes are replaced: their nodes are indexed once more among themselves, by all their tokens
from the rarest on, with exact counts, and leave entries where the tokens before the entry's leave too few for a link. Two nodes that link meet there as well, and a copy of a copy meets its own branch instead of the whole
group. Of entries with the same nodes one is kept. Then nodes of an entry are compared with one or two hubs of it, those that stand in most entries, and components are formed from
the links found. Entries within one component need no more. In the others the nodes outside the largest component are compared with all.
Two bounds drop pairs before their sets are read, both exact: sizes differ by a fifth at most, and the parity bitmaps of the sets
differ in at most as many bits as the sets may in tokens. What is left is verified on the whole sets. No link between different
components is lost; links within a component aren't all listed.

Sets are named by a 64-bit hash of their tokens, tokens by one of their words. Null or blank text has no words, no
shingles and no links. Null doc ids take part; a component's id is its smallest id that isn't null, or null. Repeated rows are
equal sets. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankpulse.llm.common import cut
from rankpulse.llm.graph import components

WIDTH = 5
#: Part of the hash space in which tokens are counted, as a signed hash below this.
COUNTED = -(1 << 63) + int(0.27 * (1 << 64))
#: Tokens of more documents than LEAST_CLASSED have a class, the binary logarithm of their number; those of more than LEAST_FREQUENT go in combinations.
LEAST_CLASSED = 32
LEAST_FREQUENT = 400
MOST_FREQUENT = 1_000_000
#: Nodes of an entry, beyond which they are indexed once more among themselves.
MANY = 64
#: Ratio of size classes, a little over 1 / 0.8; tokens to a group.
RATIO = 1.26
GROUP = 6
LEAST_BITS = 512
#: Up to so many ids of 16 bytes are sent to all executors to find their texts; beyond, texts are shuffled.
BROADCAST_IDS = 500_000
STAR_ROUNDS = 2
#: Hubs that a node is compared with in a round.
HUBS = 2
#: Tag that tells the second index's entries from the first's.
SECOND = 4


#: Bytes that are hashed at once, and the base of the words' polynomial hash with its inverse.
PIECE = 1 << 20
BASE = 0x9E3779B97F4A7C15
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _mix(*parts: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.uint64(BASE)
        for p in parts:
            h = (h ^ np.asarray(p).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h = h ^ (h >> np.uint64(29))
    return h


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    ones = np.ones(n, dtype=np.uint64)
    up, down = ones.copy(), ones.copy()
    up[1:], down[1:] = BASE, pow(BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words data[begin:end]: differences of a running polynomial, shifted back to power 0, piece by piece."""
    out = np.zeros(len(begins), dtype=np.uint64)
    i = 0
    while i < len(begins):
        j = max(i + 1, int(np.searchsorted(ends, begins[i] + PIECE)))
        base, stop = int(begins[i]), int(ends[j - 1])
        up, down = _powers(max(2 * PIECE, stop - base + 1))
        with np.errstate(over="ignore"):
            total = np.zeros(stop - base + 1, dtype=np.uint64)
            np.cumsum((data[base:stop].astype(np.uint64) + np.uint64(1)) * up[: stop - base], out=total[1:])
            a, e = begins[i:j] - base, ends[i:j] - base
            out[i:j] = (total[e] - total[a]) * down[a]
        i = j
    return _mix(out, (ends - begins).astype(np.uint64))


def token_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """For each text in UTF-8 the sorted distinct hashes of its shingles of WIDTH words with A-Z in lower case; of fewer words, one of all."""
    coded = [b"" if t is None else t.translate(_LOWER) for t in texts]
    at = np.cumsum([0] + [len(c) + 1 for c in coded])
    data = np.frombuffer(b"\n".join([*coded, b""]), dtype=np.uint8)
    blank = np.r_[True, _BLANK[data], True]
    begins, ends = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
    words = _word_hashes(data, begins, ends)
    first = np.searchsorted(begins, at)
    runs = _mix(*[words[k : len(words) - WIDTH + 1 + k] for k in range(WIDTH)]).view(np.int64) if len(words) >= WIDTH else np.zeros(0, dtype=np.int64)
    for i in range(len(texts)):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= WIDTH:
            yield np.unique(runs[a : b - WIDTH + 1])
        elif b > a:
            yield np.atleast_1d(_mix(3, *words[a:b])).view(np.int64)
        else:
            yield np.zeros(0, dtype=np.int64)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of batches of some million bytes at most, or one text, with their sets."""
    for batch in batches:
        text = batch.column("text")
        text = text.cast(pa.large_binary() if pa.types.is_large_string(text.type) else pa.binary())
        sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).cumsum() // (2 * PIECE)
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(text)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a), list(token_sets(text.slice(a, b - a).to_pylist()))


def set_key(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _class(n: int) -> int:
    return int(math.log(n) / math.log(RATIO))


def _groups(size_class: int) -> int:
    """Groups of frequent tokens for sets of this size class; 0 if all tokens are entries alone."""
    missing = int(RATIO**size_class) // 5
    return missing // GROUP if missing >= 2 * GROUP else 0


def entries(tokens: np.ndarray, classed: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Index entries of one set: sorted distinct tokens; sorted classed tokens of all sets, with their counts."""
    n = len(tokens)
    need = n // 5 + 1
    counted = tokens < COUNTED
    low, high = tokens[counted], tokens[~counted]
    at = np.minimum(np.searchsorted(classed, low), max(len(classed) - 1, 0))
    known = classed[at] == low if len(classed) else np.zeros(len(low), dtype=bool)
    single, common = low[~known], low[known]
    if len(single) >= need:
        return single[:need]
    if len(common):
        often = counts[at[known]]
        order = np.argsort(np.log2(often).astype(np.int8), kind="stable")
        common, often = common[order], often[order]
        single, common = np.r_[single, common[often <= LEAST_FREQUENT]], common[often > LEAST_FREQUENT]
        if len(single) >= need:
            return single[:need]
    found = []
    for size_class in (_class(n), _class(n) + 1):
        groups = _groups(size_class)
        if not groups:
            found.append(np.concatenate([single, common, high])[:need])
            continue
        group = _mix(common, 1) % np.uint64(groups)
        firsts = np.zeros(len(common), dtype=bool)
        firsts[np.unique(group, return_index=True)[1]] = True
        worth = np.cumsum(~firsts)  # of common tokens so far: all but one of each group
        k = int(np.searchsorted(worth, need - len(single))) + 1
        k = min(k, len(common))
        left = need - len(single) - (int(worth[k - 1]) if k else 0)
        found += [single, high[: max(left, 0)]]
        used, g = common[:k], group[:k]
        order = np.lexsort((used, g))
        used, g = used[order], g[order]
        for step in range(1, k):
            same = g[step:] == g[:-step]
            if not same.any():
                break
            found.append(_mix(used[:-step][same], used[step:][same], size_class).view(np.int64))
    return np.unique(np.concatenate(found))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, sets in _batches(batches):
        yield pa.RecordBatch.from_pydict({"token": np.concatenate([t[: np.searchsorted(t, COUNTED)] for t in sets])})


def _index(classed: np.ndarray, counts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _batches(batches):
            rows = [(entries(t, classed, counts), set_key(t)) for t in sets if len(t)]
            if rows:
                yield pa.RecordBatch.from_pydict({"entry": np.concatenate([e for e, _ in rows]), "key": np.repeat([k for _, k in rows], [len(e) for e, _ in rows])})

    return run


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows sorted by (entry, key): the distinct ones of entries that have two keys or more. Holds one row between batches."""
    held, open_entry = None, False
    for batch in batches:
        entry, key = batch["entry"].to_numpy(), batch["key"].to_numpy()
        if held is not None:
            entry, key = np.r_[held[0], entry], np.r_[held[1], key]
        if not len(entry):
            continue
        new = np.r_[True, (entry[1:] != entry[:-1]) | (key[1:] != key[:-1])]
        entry, key = entry[new], key[new]
        follows = np.r_[open_entry, entry[1:] == entry[:-1]]
        leads = np.r_[entry[1:] == entry[:-1], False]
        out = follows | leads
        # the last row waits for its successor, unless its entry is known to be shared
        yield pd.DataFrame({"entry": entry[:-1][out[:-1]], "key": key[:-1][out[:-1]]})
        held, open_entry = (entry[-1], key[-1]), bool(follows[-1])
    if held is not None and open_entry:
        yield pd.DataFrame({"entry": [held[0]], "key": [held[1]]})


def _parity(tokens: np.ndarray) -> np.ndarray:
    """Parity bitmap of a set as longs: about a bit for each token, a power of two, LEAST_BITS or more."""
    bits = LEAST_BITS << max(0, (len(tokens) - 1).bit_length() - LEAST_BITS.bit_length() + 1)
    count = np.bincount(_mix(tokens, 2) % np.uint64(bits), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8)).view(np.int64)


_LONGS = pa.list_(pa.int64())


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key, size and parity bitmap of each set."""
    for part, sets in _batches(batches):
        made = {"key": [set_key(t) for t in sets], "n": [len(t) for t in sets], "bits": pa.array([_parity(t) for t in sets], _LONGS)}
        yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "text_hash": part.column("text_hash")} | made)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets whose key is the wanted one, each once a task, however many rows repeat its id and text."""
    seen: set[int] = set()
    for part, sets in _batches(batches):
        found = []
        for k, t in zip(part.column("key").to_pylist(), sets, strict=True):
            if k not in seen and set_key(t) == k:
                seen.add(k)
                found.append((k, t))
        yield pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in found], pa.int64()), "tokens": pa.array([t for _, t in found], _LONGS)})


def _halved(bits: Column) -> Column:
    """A bitmap of half the length: places that are equal modulo it fall together, and their parities add."""
    half = (F.size(bits) / 2).cast("int")
    return F.zip_with(F.slice(bits, F.lit(1), half), F.slice(bits, half + 1, half), lambda x, y: x.bitwiseXOR(y))


def _possible(a: str, b: str) -> Column:
    """Whether sizes and bitmaps of two described sets (columns with these prefixes) allow a link. Sizes that allow one have bitmaps that
    differ in length by a factor of two at most."""
    n, m, x, y = F.col(f"{a}n"), F.col(f"{b}n"), F.col(f"{a}bits"), F.col(f"{b}bits")
    longer = [F.when(F.size(p) > F.size(q), _halved(p)).otherwise(p) for p, q in ((x, y), (y, x))]
    apart = F.aggregate(F.zip_with(*longer, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, c: t + F.coalesce(c, F.lit(0)))
    return F.when(100 * F.least(n, m) < 80 * F.greatest(n, m), False).otherwise(9 * apart <= n + m)


def _named(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def sets_of(keys: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, tokens) of the sets with these keys, each once. Their texts are found by the doc_id and the text's hash that each key has in sets."""
    ids = cut(sets.join(keys, "key").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "key"))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    found = docs.join(ids, (F.xxhash64("text") == F.col("_hash")) & docs.doc_id.eqNullSafe(ids["_id"])).select("key", "text")
    return found.mapInArrow(_tokens, "key long, tokens array<long>").groupBy("key").agg(F.first("tokens").alias("tokens"))


def verify(pairs: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose sets are linked. sets: the described sets, a row for each key."""
    wanted = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    tokens = sets_of(wanted, docs, sets)
    both = pairs.join(tokens.select(F.col("key").alias("a"), F.col("tokens").alias("x")), "a").join(tokens.select(F.col("key").alias("b"), F.col("tokens").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return cut(both.filter(100 * common >= 80 * (F.size("x") + F.size("y") - common)).select("a", "b").distinct())


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    out = linked_texts(docs)
    least_id = out.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("_least"))
    out = out.join(least_id, "component", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("_least")).alias("component_id"))


def _classed(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens of more than LEAST_CLASSED documents, and their counts; MOST_FREQUENT at most, those of the highest counts."""
    counts = docs.select("text").mapInArrow(_counted, "token long").groupBy("token").count().filter(F.col("count") > LEAST_CLASSED)
    top = cut(counts)
    if top.count() > MOST_FREQUENT:
        least = top.groupBy("count").agg(F.count(F.lit(1)).alias("n")).withColumn("above", F.sum("n").over(Window.orderBy(F.desc("count"))))
        top = top.filter(F.col("count") >= least.filter(F.col("above") <= MOST_FREQUENT).agg(F.min("count")).first()[0])
    rows = np.array([tuple(r) for r in top.select("token", "count").collect()], dtype=np.int64).reshape(-1, 2)
    rows = rows[np.argsort(rows[:, 0])]
    return rows[:, 0].copy(), rows[:, 1].copy()


def _second_index(keys: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(entry, key, at, n, most) of these sets among themselves: the rarest tokens of each that a fifth of missing tokens can't spoil, by exact counts.

    at is the token's place in the order of all tokens. Of two sets whose first common token this is, none before it is common: most is the largest
    size of a set that one can then be linked with. An entry keeps the sets that another's size allows, so sets that share a
    common part too short for a link, as pages of a template do, leave it before they are compared.
    """
    tokens = cut(sets_of(keys, docs, sets))
    rows = tokens.select("key", F.explode("tokens").alias("token"))
    counts = rows.groupBy("token").agg(F.count(F.lit(1)).alias("count")).filter("count > 1")
    shared = rows.join(counts, "token").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("count", "token"))).alias("_t"))
    both = tokens.select("key", F.size("tokens").alias("n")).join(shared, "key")
    # tokens of one set only come first in the order and are no entries
    need = F.floor(F.col("n") / 5) + 1 - (F.col("n") - F.size("_t"))
    left = (F.size("_t") - F.col("_p")).cast("long")  # tokens from this one on
    index = both.select("key", "n", "_t", F.posexplode(F.slice("_t", F.lit(1), F.greatest(need, F.lit(0)).cast("int"))).alias("_p", "_e"))
    index = index.select(F.xxhash64(F.lit(SECOND), "_e.token").alias("entry"), "key", F.col("_e").alias("at"), "n", (F.floor(9 * left / 4) - F.col("n")).cast("long").alias("most"))
    index = cut(index)
    sizes = index.groupBy("entry").agg(F.min("n").alias("_least"), F.max("most").alias("_most"))
    return index.join(sizes, "entry").filter((F.col("_least") <= F.col("most")) & (F.col("n") <= F.col("_most"))).select(*index.columns)


def linked_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (xxhash64 of text), n_shingles and component, the key of a group of linked texts, of every document; null without words."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    described = cut(docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_describe, "doc_id long, text_hash long, key long, n long, bits array<long>"))
    by = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    sets = described.filter("n > 0").groupBy("key").agg(F.min(by).alias("_b"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    sets = cut(sets.select("key", "_b.doc_id", "_b.text_hash", "n", "bits"))

    index = docs.select("text").mapInArrow(_index(*_classed(docs)), "entry long, key long")
    shared = index.repartition("entry").sortWithinPartitions("entry", "key").mapInPandas(_shared, "entry long, key long")
    shared = cut(shared).withColumns({"at": F.col("entry"), "most": F.lit(1 << 40)})  # nothing is known of the tokens before
    sizes = cut(_sizes(shared))
    many = sizes.filter(F.col("m") > MANY).select("entry")
    second = cut(_second_index(shared.join(many, "entry", "left_semi").select("key").distinct(), docs, sets))
    shared = cut(_weighed(_once(shared, sizes.filter(F.col("m") <= MANY)).unionByName(_once(second, _sizes(second)))))

    links, roots, stars = None, None, STAR_ROUNDS
    while True:
        rows = shared.withColumn("c", F.col("key")) if roots is None else shared.join(roots.withColumnRenamed("node", "key"), "key", "left").select("entry", "key", "w", "most", F.coalesce("root", "key").alias("c"))
        open_ = rows.groupBy("entry").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("entry")
        rows = cut(rows.join(open_, "entry", "left_semi"))
        found = verify(cut(_stars(rows, sets, stars) if stars else _rest(rows, sets)), docs, sets)
        some = not found.isEmpty()
        if some or links is None:
            links = found if links is None else links.unionByName(found)
            roots = components(links)
        if not stars:
            break
        # a round that links nothing is the last of its kind; the pairs that remain follow
        stars, shared = stars - 1 if some else 0, rows.select("entry", "key", "w", "most")
    out = described.select("doc_id", "text_hash", "key", F.col("n").alias("n_shingles")).join(roots.withColumnRenamed("node", "key"), "key", "left")
    return out.select("doc_id", "text_hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("root", "key")).alias("component"))


def _sizes(shared: DataFrame) -> DataFrame:
    """How many nodes each entry has, its place in the order, and two hashes of which nodes they are."""
    return shared.groupBy("entry").agg(F.count(F.lit(1)).alias("m"), F.min("at").alias("at"), F.bit_xor(F.xxhash64(F.lit(0), "key")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("y"))


def _once(shared: DataFrame, sizes: DataFrame) -> DataFrame:
    """The entries of two nodes or more in sizes, and of those with the same nodes the first, with how many nodes they have together. Copies of a text share most entries."""
    one = sizes.filter("m > 1").groupBy("m", "x", "y").agg(F.min_by("entry", "at").alias("entry"), F.count(F.lit(1)).alias("n"))
    return shared.join(one.select("entry", (F.col("m") * F.col("n")).alias("m")), "entry").select("entry", "key", "m", "most")


def _weighed(shared: DataFrame) -> DataFrame:
    """Adds w: how many nodes the entries of a node have together."""
    return shared.join(shared.groupBy("key").agg(F.sum("m").alias("w")), "key").select("entry", "key", "w", "most")


def _stars(rows: DataFrame, sets: DataFrame, round_: int) -> DataFrame:
    """For each node of an open entry, the other-component hubs that most of its entries name. An entry names its heaviest node in the first round, any in the others."""
    by = F.struct(F.col("w") if round_ == STAR_ROUNDS else F.lit(0), F.xxhash64(F.lit(round_), "key"))
    named = rows.groupBy("entry").agg(F.max_by(F.struct("key", "c"), by).alias("p"))
    pairs = rows.join(named, "entry").filter("c <> p.c").groupBy(F.col("key").alias("a"), F.col("p.key").alias("b")).count()
    pairs = pairs.join(_named(sets, "a_").withColumnRenamed("a_key", "a"), "a").join(_named(sets, "b_").withColumnRenamed("b_key", "b"), "b").filter(_possible("a_", "b_"))
    best = pairs.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("count", "b")), False), 1, HUBS).alias("_b"))
    return best.select("a", F.explode("_b").alias("_p")).select("a", "_p.b")


def _rest(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs of different components that share an entry and that the bounds allow."""
    main = rows.groupBy("entry", "c").count().groupBy("entry").agg(F.max_by("c", F.struct("count", "c")).alias("main"))
    full = rows.drop("w").join(main, "entry").join(sets.select("key", "n", "bits"), "key")
    left = _named(full.filter("c <> main"), "a_")
    right = _named(full, "b_")
    on = (F.col("a_entry") == F.col("b_entry")) & (F.col("a_c") != F.col("b_c")) & ((F.col("b_c") == F.col("b_main")) | (F.col("a_key") < F.col("b_key")))
    on = on & (F.col("a_n") <= F.col("b_most")) & (F.col("b_n") <= F.col("a_most")) & _possible("a_", "b_")
    return left.join(right, on).select(F.col("a_key").alias("a"), F.col("b_key").alias("b")).distinct()

"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is a row of code points in which letters and marks are in lower case and everything else is a space, with a space before and after.
Its n-grams are the runs of 1 to ORDERS points that hold a letter or mark and have a space at their ends only, so none goes beyond a word and
its borders. Each falls into one of 2 ** BITS buckets by hash. The model is the logarithm of each language's smoothed bucket shares,
and of its share of documents. Bucket counts are over all labelled documents: tasks count in arrays and send one row a bucket, Spark adds them.

The matrix of a language block (BLOCK languages at most, 8 MB) is broadcast; a further block of languages is a further matrix, and the
best language and the total are combined over the blocks, so any number of languages is exact. Scoring is a pass over all rows without a shuffle: the
n-grams of some documents are made together, counted by document and bucket, and multiplied with the matrix in numpy. Long texts are counted
piece by piece, with every n-gram once.

Text that is null, empty or has no letter is `und` with score 0; so is every text if nothing is learnt. Rows of such texts and rows without
a language teach nothing. Ties go to the language of the smallest name. Null ids and repeated rows pass through, other columns too, but
held_out, lang_pred and score are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankpulse.llm.common import cut
from rankpulse.llm.quality_model import fold

ORDERS = 4
BITS = 16
#: Added to every bucket's count.
SMOOTHING = 0.5
#: Languages of one matrix.
BLOCK = 32
#: Characters and documents whose n-grams are made at once.
PIECE = 1 << 18
TOGETHER = 64
UNKNOWN = "und"
#: The bucket under which a language's documents are counted.
DOCUMENTS = -1

_SPACE = 32


@functools.lru_cache(maxsize=1)
def _table() -> tuple[np.ndarray, np.ndarray]:
    """For each code point what it counts as, and whether it is a letter."""
    kind = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    mapped = [_SPACE if k not in "LM" else ord(x) if len(x := chr(c).lower()) == 1 else c for c, k in enumerate(kind)]
    return np.array(mapped, dtype=np.uint32), np.array([k == "L" for k in kind])


def _parts(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """Code points of some texts at a time, the text of each point, how many points n-grams begin at, and which texts have a letter here."""
    rows: list[tuple[int, str]] = []
    size = 0

    def made(starts: int | None = None):
        points = np.frombuffer("".join(t for _, t in rows).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        owner = np.repeat([i for i, _ in rows], [len(t) for _, t in rows])
        mapped, letters = _table()
        return mapped[points], owner, len(points) if starts is None else starts, np.unique(owner[letters[points]])

    for i, text in enumerate(texts):
        if not text:
            continue
        if len(text) <= PIECE:
            rows.append((i, f" {text} "))
            size += len(text)
            if size > PIECE or len(rows) == TOGETHER:
                yield made()
                rows, size = [], 0
            continue
        kept, text = rows, f" {text} "
        for begin in range(0, len(text), PIECE):
            # an n-gram belongs to the piece that it begins in
            rows = [(i, text[begin : begin + PIECE + ORDERS - 1])]
            yield made(min(PIECE, len(text) - begin))
        rows = kept
    if rows:
        yield made()


def _grams(x: np.ndarray, owner: np.ndarray, starts: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Owner and bucket of the n-grams of each order that begin at the first `starts` points."""
    inside = x != _SPACE
    h = np.zeros(len(x), dtype=np.uint64)
    middle = np.ones(len(x), dtype=bool)  # of the points between first and last
    for n in range(1, ORDERS + 1):
        m = len(x) - n + 1
        if m <= 0:
            return
        with np.errstate(over="ignore"):
            h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + x[n - 1 :].astype(np.uint64) + np.uint64(n)
            bucket = ((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)
        if n > 2:
            middle = middle[:m] & inside[n - 2 : n - 2 + m]
            good = middle[:m].copy()
        else:
            good = inside[:m] | inside[n - 1 :]
        good[starts:] = False
        at = np.flatnonzero(good)
        yield owner[at], bucket[at].astype(np.int64)


def counts_of(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Sparse counts of some texts at a time: text number, bucket and count, sorted by the first two, and the texts that have a letter.

    A long text comes in several parts, which add up.
    """
    for x, owner, starts, lettered in _parts(texts):
        least = int(owner[0])
        width = (int(owner[-1]) - least + 1) << BITS
        keys = np.concatenate([((o - least) << BITS) | b for o, b in _grams(x, owner, starts)])
        if len(keys) * 16 > width:
            dense = np.bincount(keys, minlength=width)
            found = np.flatnonzero(dense)
            n = dense[found]
        else:
            found, n = np.unique(keys, return_counts=True)
        yield (found >> BITS) + least, found & ((1 << BITS) - 1), n, lettered


def _teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, bucket and count of what a task has read; arrays of BLOCK languages at most are held."""
    held: dict[str, np.ndarray] = {}
    documents: dict[str, int] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * (len(at) + 1), pa.string()), "bucket": np.r_[DOCUMENTS, at].astype(np.int32), "n": np.r_[documents[lang], counts[at]].astype(np.int64)})
        held.clear()
        documents.clear()

    for batch in batches:
        for begin in range(0, batch.num_rows, 1024):
            part = batch.slice(begin, 1024)
            langs = part.column("lang").to_pylist()
            has: set[int] = set()
            for owner, bucket, n, lettered in counts_of(part.column("text").to_pylist()):
                has.update(lettered.tolist())
                cuts = np.flatnonzero(np.diff(owner)) + 1
                for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(owner)], strict=True):
                    if b > a:
                        lang = langs[owner[a]]
                        if lang not in held:
                            if len(held) == BLOCK:
                                yield from out()
                            held[lang], documents[lang] = np.zeros(1 << BITS, dtype=np.int64), 0
                        held[lang][bucket[a:b]] += n[a:b]
            for i in has:
                if langs[i] not in held:  # it has gone out meanwhile
                    if len(held) == BLOCK:
                        yield from out()
                    held[langs[i]], documents[langs[i]] = np.zeros(1 << BITS, dtype=np.int64), 0
                documents[langs[i]] += 1
    yield from out()


def learn(docs: DataFrame) -> DataFrame:
    """The counts of a model as a written table: lang, place (languages by name, from 0), bucket, n. docs: text and lang; null languages go."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang is not null and text <> ''")
    counts = cut(rows.mapInArrow(_teach, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).filter("n > 0"))
    # a marker that no document with a letter stands behind isn't a language
    langs = counts.filter(F.col("bucket") == DOCUMENTS).select("lang", (F.row_number().over(Window.orderBy("lang")) - 1).alias("place"))
    return cut(counts.join(langs, "lang").select("lang", "place", "bucket", "n"))


def matrices(model: DataFrame) -> list[tuple[list[str], Broadcast]]:
    """The languages of each block, and a broadcast matrix: a row of logarithms for each bucket, and a last one for the shares of documents."""
    spark = model.sparkSession
    heads = model.filter(F.col("bucket") == DOCUMENTS)
    size = heads.agg(F.count(F.lit(1)).alias("langs"), F.sum("n").alias("documents")).first()
    found = []
    for begin in range(0, size["langs"], BLOCK):
        rows = model.filter(F.col("place").between(begin, begin + BLOCK - 1)).toPandas()
        names = rows[rows["bucket"] == DOCUMENTS].sort_values("place")
        counts = np.zeros(((1 << BITS) + 1, len(names)))
        at = rows["bucket"].to_numpy()
        counts[np.where(at == DOCUMENTS, 1 << BITS, at), rows["place"].to_numpy() - begin] = rows["n"].to_numpy()
        grams = counts[:-1]
        logs = np.log(grams + SMOOTHING) - np.log(grams.sum(0) + SMOOTHING * (1 << BITS))
        prior = np.log(counts[-1:] / size["documents"])
        found.append((names["lang"].tolist(), spark.sparkContext.broadcast(np.vstack([logs, prior]).astype(np.float32))))
    return found


def scores(texts: list[str | None], matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The joint logarithm of each text with each language, and whether it has a letter."""
    out = np.tile(matrix[-1].astype(np.float64), (len(texts), 1))
    lettered = np.zeros(len(texts), dtype=bool)
    for owner, bucket, n, has in counts_of(texts):
        lettered[has] = True
        if not len(owner):
            continue
        # so many rows of the matrix at once that the product stays small
        step = max(1, (1 << 22) // matrix.shape[1])
        for begin in range(0, len(owner), step):
            o, b, c = owner[begin : begin + step], bucket[begin : begin + step], n[begin : begin + step]
            first = np.r_[0, np.flatnonzero(np.diff(o)) + 1]
            out[o[first]] += np.add.reduceat(matrix[b] * c[:, None], first, axis=0)
    return out, lettered


def _asked(matrix: Broadcast):
    @F.pandas_udf("lettered boolean, place int, best double, total double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts = [scores(texts.iloc[a : a + 1024].tolist(), matrix.value) for a in range(0, len(texts), 1024)]
            z = np.vstack([p[0] for p in parts]) if parts else np.zeros((0, 1))
            best = z.max(1)
            yield pd.DataFrame({"lettered": np.concatenate([p[1] for p in parts]) if parts else [], "place": z.argmax(1).astype(np.int32), "best": best, "total": best + np.log(np.exp(z - best[:, None]).sum(1))})

    return run


def predict(docs: DataFrame, model: DataFrame, text: str = "text") -> DataFrame:
    """Adds lang_pred and score, the language's posterior probability."""
    blocks = matrices(model)
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text).cast("string").alias("_text"))
    kept = [F.col("_doc")[c].alias(c) for c in docs.columns if c not in ("lang_pred", "score")]
    if not blocks:
        return packed.select(*kept, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    for k, (_, matrix) in enumerate(blocks):
        packed = packed.withColumn(f"_b{k}", _asked(matrix)("_text"))
    field = lambda name: [F.col(f"_b{k}.{name}") for k in range(len(blocks))]
    top = field("best")[0] if len(blocks) == 1 else F.greatest(*field("best"))
    lang: Column = F.coalesce(*[F.when(F.col(f"_b{k}.best") == top, F.element_at(F.array(*map(F.lit, names)), F.col(f"_b{k}.place") + 1)) for k, (names, _) in enumerate(blocks)])
    share = F.lit(0.0)
    for total in field("total"):
        share = share + F.exp(total - top)
    known = F.col("_b0.lettered")
    return packed.select(*kept, F.when(known, lang).otherwise(UNKNOWN).alias("lang_pred"), F.when(known, F.least(F.lit(1.0), 1 / share)).otherwise(0.0).alias("score"))


def classify(docs: DataFrame) -> DataFrame:
    """Adds held_out, lang_pred and score. Learns from the languages of documents outside the held-out fold."""
    model = learn(docs.filter(fold("doc_id", 4) != 2).select("text", "lang"))
    return predict(docs, model).withColumn("held_out", fold("doc_id", 4) == 2)

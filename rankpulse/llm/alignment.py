"""Alignment of two tokenizations of the same texts by the byte offsets at which both end a token.

A text with a space before it is encoded by a byte-level vocabulary (A) and by a sentence-piece vocabulary with byte fallback (B). Each stretch of it has two
dictionaries from end offset to token number; the offsets that both have, in order, cut the two id lists into groups, and the last tokens of a group
are linked, as they end together. Tokens of no bytes would end with the one before; they are linked with all that end there.

Neither vocabulary joins characters across the place where a space or line end follows anything but white space: A's word pattern has white space at the beginning of a
word only, and no piece of B has a space after another character, or a line end (`boundaries` looks B through, and if that fails texts are encoded whole). So texts are aligned by
stretches of white space and a word, and what is known of a stretch is kept by the worker.

How often a pair of ids is linked is counted over all documents. Texts of about CHUNK bytes are a chunk, written as one row: the documents' figures, which pairs each has, packed,
and the chunk's distinct pairs with their counts. Spark adds the counts by pair, takes the highest of each B id (a row for each id of the vocabulary), and
brings the sums back to the chunks, whose documents are then summed in numpy. No id list is shuffled and nothing is encoded twice.

Null and empty texts, and texts whose tokens' bytes are not the text with a space before it (as if it has U+2581), have no tokens: zeros and ''. Null ids and repeated rows are
documents like any other; other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankpulse.llm.common import cut
from rankpulse.llm.packing import Tokens, byte_characters

#: Bytes of text of a chunk, beyond which no further document joins it.
CHUNK = 4 << 20
#: Stretches that a worker knows, up to twice as many; longer ones than LONG characters aren't kept.
CACHE = 300_000
LONG = 48
#: B ids have so many bits in a pair.
SHIFT = 24

_PARTS = re.compile(r"[ \n]+[^ \n]*")
_PLAIN = re.compile("[ \n][^\\s\u180e]+")
_ODD_SPACE = re.compile("[^\\S \n]|\u180e")


def cut_ends(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int]]:
    """How many tokens of each side have ended at each offset where both end one, in order; of tokens that end at the same offset, the last."""
    at_a, at_b = dict(zip(ends_a, range(1, len(ends_a) + 1), strict=True)), dict(zip(ends_b, range(1, len(ends_b) + 1), strict=True))
    common = list(filter(at_b.__contains__, at_a))  # a dictionary keeps its order, so these are sorted
    return list(map(at_a.__getitem__, common)), list(map(at_b.__getitem__, common))


def linked(ids: list[np.ndarray], lengths: list[np.ndarray], cuts: list[np.ndarray]) -> np.ndarray:
    """The linked pairs of each group in order: of tokens that end at the group's end, which are the last and, before tokens of no bytes, those before them."""
    if all(x.all() for x in lengths):
        return ids[0][cuts[0] - 1] << SHIFT | ids[1][cuts[1] - 1]
    pairs = []
    for x, y in zip(*[c.tolist() for c in cuts], strict=True):
        ends = []
        for side, k in ((0, x), (1, y)):
            own = [int(ids[side][k - 1])]
            while k > 1 and not lengths[side][k - 1]:
                k -= 1
                own.append(int(ids[side][k - 1]))
            ends.append(own)
        pairs += [p << SHIFT | q for p in ends[0] for q in ends[1]]
    return np.array(pairs, dtype=np.int64)


def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of the numbers below size, and how many each has."""
    texts = np.arange(size).astype("S")
    return texts.view(np.uint8).reshape(size, -1), np.char.str_len(texts).astype(np.int64)


def groups_text(ids: list[np.ndarray], cuts: list[np.ndarray], digits: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The groups as bytes: ids with a comma between them, `|` between the sides and `;` after each group."""
    # where tokens go: each behind the tokens of both sides that are in earlier groups, B's also behind A's of its own
    group = [np.repeat(np.arange(len(c)), np.diff(c, prepend=0)) for c in cuts]
    place = np.concatenate([np.arange(len(ids[0])) + np.r_[0, cuts[1]][group[0]], np.arange(len(ids[1])) + cuts[0][group[1]]])
    both, after = np.empty(len(place), dtype=np.int64), np.full(len(place), ord(","), dtype=np.uint8)
    both[place] = np.concatenate(ids)
    after[cuts[0] + np.r_[0, cuts[1][:-1]] - 1] = ord("|")
    after[cuts[0] + cuts[1] - 1] = ord(";")
    shapes, lengths = digits
    own = lengths[both]
    ends = np.cumsum(own + 1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    begins = ends - own - 1
    for k in range(shapes.shape[1]):
        has = own > k
        out[begins[has] + k] = shapes[both[has], k]
    out[ends - 1] = after
    return out


class Aligner:
    """Both tokenizers, and the ids of known stretches: bytes of little-endian 32-bit numbers for A and for B, or None if their tokens aren't the stretch's bytes."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        tokens = Tokens(byte_path)
        self.a, self.fast = tokens.tokenizer, tokens.fast
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        of, vocabulary = byte_characters(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.a_bytes[i] = t.encode() if t in special else bytes(map(of.__getitem__, t))
        self.begins = np.array([t[:1] in (b" ", b"\n") for t in self.a_bytes])
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.lengths = [np.array([len(t) for t in side]) for side in (self.a_bytes, self.b_bytes)]
        self.digits = _digits(max(len(self.a_bytes), len(self.b_bytes)))
        self.space = self.b.piece_to_id("▁")
        self.boundaries = self.b.encode("") == [] and self.b.encode("\n")[:1] == [self.space] and not any("\n" in p or re.search("[^▁]▁", p) for i, p in enumerate(pieces) if not self.b.is_byte(i))
        self.known: dict[str, tuple[bytes, bytes] | None] = {}
        self.former: dict[str, tuple[bytes, bytes] | None] = {}

    def _encode_a(self, parts: list[str]) -> list[bytes]:
        """A's ids of stretches. Those of one space or line end and a word are encoded together and cut where a token begins with either."""
        plain = [_PLAIN.fullmatch(p) is not None for p in parts]
        ids = np.array(self.fast.encode_ordinary("".join(p for p, x in zip(parts, plain, strict=True) if x)), dtype="<u4")
        cuts, data = (4 * np.flatnonzero(self.begins[ids])).tolist(), ids.tobytes()
        fast = iter([data[i:j] for i, j in zip(cuts, [*cuts, len(data)][1:], strict=True)])
        others = iter(self.a.encode_batch([p for p, x in zip(parts, plain, strict=True) if not x], add_special_tokens=False))
        return [next(fast) if x else np.array(next(others).ids, dtype="<u4").tobytes() for x in plain]

    def _encode_b(self, parts: list[str]) -> list[bytes]:
        """B's ids of stretches. B puts a space before what it encodes, so a stretch that begins with one is encoded without it; others lose that token."""
        found = self.b.encode([p[1:] if p[0] == " " else p for p in parts], num_threads=1)
        # an empty text gets no space
        found = [([self.space] if p == " " else ids) if p[0] == " " else ids[1:] for p, ids in zip(parts, found, strict=True)]
        ends = (4 * np.cumsum([len(x) for x in found])).tolist()
        data = np.fromiter(itertools.chain.from_iterable(found), dtype="<u4", count=ends[-1] // 4 if ends else 0).tobytes()
        return [data[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]

    def _bytes(self, side: int, ids: bytes) -> bytes:
        return b"".join(map((self.a_bytes, self.b_bytes)[side].__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))

    def encoded(self, parts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """The ids of these stretches."""
        if not parts:
            return []
        sides = self._encode_a(parts), self._encode_b(parts)
        whole = "".join(parts).encode()
        if all(self._bytes(k, b"".join(side)) == whole for k, side in enumerate(sides)):
            return list(zip(*sides, strict=True))
        return [x if self._bytes(0, x[0]) == self._bytes(1, x[1]) == p.encode() else None for p, x in zip(parts, zip(*sides, strict=True), strict=True)]

    def parts_of(self, text: str) -> list[str]:
        """The stretches of a text, which begins with a space."""
        if not self.boundaries:
            return [text]
        parts = _PARTS.findall(text)
        if not _ODD_SPACE.search(text):
            return parts
        merged = [parts[0]]
        for p in parts[1:]:
            if merged[-1][-1].isspace() or merged[-1][-1] == "\u180e":
                merged[-1] += p
            else:
                merged.append(p)
        return merged

    def learn(self, parts: set[str]) -> dict[str, tuple[bytes, bytes] | None]:
        """The ids of these stretches. Those of short ones are kept: of the last CACHE to 2 * CACHE that were met."""
        if len(self.known) > CACHE:
            self.known, self.former = {}, self.known
        missing = parts - self.known.keys()
        self.known.update((p, self.former[p]) for p in missing & self.former.keys())
        new = sorted(missing - self.former.keys())
        made = dict(zip(new, self.encoded(new), strict=True))
        self.known.update((p, x) for p, x in made.items() if len(p) <= LONG)
        return {p: x for p, x in made.items() if len(p) > LONG} | self.known if any(len(p) > LONG for p in new) else self.known


@functools.lru_cache(maxsize=1)
def _aligner(byte_path: str, piece_path: str) -> Aligner:
    """One for each worker, so that later tasks know the stretches of earlier ones."""
    return Aligner(byte_path, piece_path)


CHUNKS = "chunk long, packed binary, pairs array<long>, counts array<long>"


def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays by name, those of small numbers in half the length."""
    small = {k: v.dtype == np.int64 and len(v) and -(1 << 31) <= v.min() and v.max() < 1 << 31 for k, v in arrays.items()}
    return zlib.compress(pickle.dumps({k: v.astype(np.int32) if small[k] else v for k, v in arrays.items()}), 1)


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    return pickle.loads(zlib.decompress(data))


def aligned(parts: list[str], known: dict[str, tuple[bytes, bytes] | None], aligner: Aligner) -> tuple[tuple[int, int, int], str, np.ndarray]:
    """Numbers of A and B tokens and of groups, the hash of the groups, and the linked pairs of a text of known stretches."""
    found = list(map(known.__getitem__, parts))
    if not found or None in found:
        return (0, 0, 0), "", np.zeros(0, dtype=np.int64)
    ids = [np.frombuffer(b"".join([x[side] for x in found]), dtype="<u4").astype(np.int64) for side in (0, 1)]
    lengths = [n[x] for n, x in zip(aligner.lengths, ids, strict=True)]
    cuts = [np.fromiter(c, dtype=np.int64, count=len(c)) for c in cut_ends(*[n.cumsum().tolist() for n in lengths])]
    text = groups_text(ids, cuts, aligner.digits)[:-1].tobytes()
    return (len(ids[0]), len(ids[1]), len(cuts[0])), hashlib.sha256(text).hexdigest(), linked(ids, lengths, cuts)


def _chunk(number: int, ids: list[int | None], texts: list[str | None], aligner: Aligner) -> dict:
    """A chunk's row. In `packed`: the documents' figures and hashes, and `of`, which pair each of their links is."""
    split = [aligner.parts_of(f" {t}") if t else [] for t in texts]
    known = aligner.learn(set().union(*split))
    rows = [aligned(parts, known, aligner) for parts in split]
    pairs, of = np.unique(np.concatenate([x for *_, x in rows]), return_inverse=True)
    packed = _pack(
        doc_id=np.array([0 if x is None else x for x in ids], dtype=np.int64), null=np.array([x is None for x in ids]),
        figures=np.array([(*x, len(links)) for x, _, links in rows], dtype=np.int64).ravel(), hashes=np.array([h for _, h, _ in rows], dtype="S64"), of=of.astype(np.int64),
    )
    return {"chunk": [number], "packed": [packed], "pairs": [pairs.tolist()], "counts": [np.bincount(of, minlength=len(pairs)).tolist()]}


def _encode(byte_path: str, piece_path: str):
    schema = pa.schema([("chunk", pa.int64()), ("packed", pa.binary()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = _aligner(byte_path, piece_path), TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                part = batch.slice(begin, 64)
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids.append(doc_id)
                    texts.append(text)
                    size += len(text or "") + 100
                    if size > CHUNK:
                        yield pa.RecordBatch.from_pydict(_chunk(number, ids, texts, aligner), schema)
                        ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield pa.RecordBatch.from_pydict(_chunk(number, ids, texts, aligner), schema)

    return run


ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of chunks, with the sums over their links."""
    for batch in batches:
        for k in range(batch.num_rows):
            x = _unpack(batch.column("packed")[k].as_py())
            known = batch.column("found")[k].values
            pair, count, best = (known.field(i).to_numpy() for i in range(3)) if known is not None else [np.zeros(0, dtype=np.int64)] * 3
            order = np.argsort(pair)
            figures = x["figures"].astype(np.int64).reshape(-1, 4).T
            to = np.r_[0, np.cumsum(figures[3])]
            # exact sums of a document's links, as differences of running ones
            sums = [np.diff(np.r_[0, np.cumsum(value[order][x["of"]])][to]) for value in (best, count)]
            columns = [pa.array(x["doc_id"].astype(np.int64), mask=x["null"]), *figures, *sums, pa.array([h.decode() for h in x["hashes"].tolist()], pa.string())]
            yield pa.RecordBatch.from_pydict(dict(zip([c.split()[0] for c in ROWS.split(", ")], columns, strict=True)))


def chunks(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """The chunks of all documents (doc_id, text) as a written table."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut(texts.mapInArrow(_encode(byte_path, piece_path), CHUNKS))


def pair_counts(made: DataFrame) -> DataFrame:
    """pair, a, b, count, and best, whether no other pair of its B id is linked more often, of all linked pairs of ids, as a written table."""
    each = made.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.counts").alias("count"))
    b = F.col("pair").bitwiseAND((1 << SHIFT) - 1).alias("b")
    counts = cut(each.groupBy("pair").agg(F.sum("count").alias("count")).select("pair", F.shiftright("pair", SHIFT).alias("a"), b, "count"))
    # a row for each id of B at most
    most = counts.groupBy("b").agg(F.max("count").alias("_most"))
    return counts.join(F.broadcast(most), "b").select("pair", "a", "b", "count", (F.col("count") == F.col("_most")).alias("best"))


def align(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    made = chunks(docs, byte_path, piece_path)
    counts = pair_counts(made).select("pair", "count", F.col("best").cast("long").alias("best"))
    asked = made.select("chunk", F.explode("pairs").alias("pair"))
    found = asked.join(counts, "pair").groupBy("chunk").agg(F.collect_list(F.struct("pair", "count", "best")).alias("found"))
    return made.select("chunk", "packed").join(found, "chunk", "left").select("packed", "found").mapInArrow(_sum, ROWS)

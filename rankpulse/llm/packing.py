"""Best-fit packing of tokenised documents into sequences of bounded length.

Documents become pieces of at most `size` tokens; pieces are packed by hierarchical residual packing. Each block of a partition
is packed best-fit, longest first; bins that are nearly full leave. Underfull bins are the items of the next round, in which
fewer partitions pack the bins of several former ones, up to a root. A round packs blocks of at most BLOCK items, so no task
holds more however many bins stay underfull; when a round closes no bin and saves none, the remaining bins are final.

Only lengths, places and checksums of pieces are packed. Tokens are made once, written as a table, and not shuffled;
sequences() joins them to the packing where the token ids themselves are wanted.

Null text is an empty document: the end id alone. Null or repeated doc ids and repeated rows are documents like any other.
Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankpulse.llm.common import cut, text_of

SIZE = 1024
END_ID = 2
#: Items that are packed together at most, and rounds' fan-in.
BLOCK = 200_000
ARITY = 8
#: A bin with at most this share of its length unused counts as nearly full.
SLACK = 0.004
#: Words whose ids a worker keeps.
CACHE = 800_000

PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, full boolean"


#: How texts fall into words before bytes are merged.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokens:
    """Token ids of texts as little-endian 32-bit bytes, as the tokenizers library gives them.

    A byte-level tokenizer of this kind never joins characters across a single space between two words, so the ids of a text
    are those of its first word and of each " word" after it. Words repeat, so their ids are kept. New words are merged
    together, by a faster library with the ranks of the same vocabulary, and cut where a token begins with a space. Texts with
    a word that begins or ends in white space, and words with a special token, go to the tokenizer itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        of, ranks = byte_characters(), {}
        for token, i in self.tokenizer.get_vocab().items():
            if token not in self.special:
                ranks[bytes(map(of.__getitem__, token))] = i
        self.fast = tiktoken.Encoding("own", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.begins = np.zeros(max(ranks.values()) + 2, dtype=bool)
        self.begins[[i for t, i in ranks.items() if t[:1] == b" "]] = True
        self.words: dict[str, bytes | None] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        self.words.update(dict.fromkeys(new))
        plain = [w for w in new if w and not (w[0].isspace() or w[-1].isspace() or "\u180e" in w)]
        odd = {w for w in plain if any(t in w for t in self.special)}
        self.words.update((w, self._whole(" " + w)) for w in odd)
        plain = [w for w in plain if w not in odd] if odd else plain
        for begin in range(0, len(plain), 5000):
            part = plain[begin : begin + 5000]
            ids = np.array(self.fast.encode_ordinary(" " + " ".join(part)), dtype="<u4")
            cuts, data = (4 * np.flatnonzero(self.begins[ids])).tolist(), ids.tobytes()
            self.words.update(zip(part, [data[i:j] for i, j in zip(cuts, [*cuts[1:], len(data)], strict=True)], strict=True))

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of a space and each of these words, which don't begin or end in white space. Nothing is kept."""
        self._learn(list(dict.fromkeys(words)))
        found = [self.words[w] for w in words]
        self.words.clear()
        return found

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        known = self.words
        if len(known) > CACHE:
            known.clear()
        split = [t.split(" ") for t in texts]
        new: set[str] = set()
        for w in split:
            new.update(w[1:])
        self._learn(list(new - known.keys()))
        for text, w in zip(texts, split, strict=True):
            try:
                yield self._whole(w[0]) + b"".join(map(known.__getitem__, w[1:]))
            except TypeError:
                yield self._whole(text)


@functools.lru_cache(maxsize=2)
def _tokens(path: str) -> Tokens:
    """One for each vocabulary and worker, so that later tasks know the words of earlier ones."""
    return Tokens(path)


def _tokeniser(path: str, size: int, end_id: int, keep_ids: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, end = _tokens(path), np.array([end_id], dtype="<u4").tobytes()
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            out = []
            for begin in range(0, len(batch), 512):
                part = batch.iloc[begin : begin + 512]
                for doc_id, ids in zip(part["doc_id"], tokens.encode(part["text"].tolist()), strict=True):
                    ids, doc_id = ids + end, None if pd.isna(doc_id) else int(doc_id)
                    n, start, piece = len(ids) // 4, 0, 0
                    while start < n:
                        # the first piece takes what doesn't fill a piece
                        length = (n - 1) % size + 1 if piece == 0 else size
                        data = ids[4 * start : 4 * (start + length)]
                        out.append((row, doc_id, piece, start, length, zlib.crc32(data), *([np.frombuffer(data, dtype="<u4").astype("int32")] if keep_ids else [])))
                        start, piece = start + length, piece + 1
                    row += 1
            columns = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * keep_ids
            yield pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})

    return run


def tokenise(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents as a written table: row (a number of the document), doc_id, piece, start, length, ids_crc32[, ids]."""
    texts = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    return cut(texts.mapInPandas(_tokeniser(path, size, end_id, keep_ids), PIECES + (", ids array<int>" if keep_ids else "")))


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, longest first: bin and place of each item, and the unused length of each bin."""
    bins, places = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    open_bins: dict[int, list[int]] = {}
    # bit r is set if a bin with r unused is open: the lowest bit from an item's length on is its best fit
    mask, unused = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fits = mask >> length
        if fits:
            left = length + (fits & -fits).bit_length() - 1
            b = open_bins[left].pop()
            if not open_bins[left]:
                mask ^= 1 << left
        else:
            left, b = size, len(unused)
            unused.append(size)
        bins[i], places[i] = b, size - left
        unused[b] = left = left - length
        if left:
            open_bins.setdefault(left, []).append(b)
            mask |= 1 << left
    return bins, places, np.array(unused, dtype=np.int64)


def _packer(size: int, level: int, slack: int):
    """Packs the bins of a partition, which come with their pieces together, in blocks of whole bins."""

    def pack(block: pd.DataFrame, first_bin: int) -> tuple[pd.DataFrame, int]:
        starts = np.flatnonzero(np.r_[True, block["bin"].to_numpy()[1:] != block["bin"].to_numpy()[:-1]])
        item = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(block)]))
        lengths = np.add.reduceat(block["length"].to_numpy(), starts)
        bins, places, unused = best_fit(lengths, size)
        block = block.assign(bin=first_bin + bins[item], offset=block["offset"].to_numpy() + places[item], full=unused[bins[item]] <= slack)
        return block, first_bin + len(unused)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        next_bin = (level << 57) | (TaskContext.get().partitionId() << 34)
        kept: list[pd.DataFrame] = []
        for batch in batches:
            kept.append(batch)
            if sum(map(len, kept)) >= BLOCK:
                rows = pd.concat(kept, ignore_index=True)
                # the last bin may go on in the next batch
                end = int(np.flatnonzero(rows["bin"].to_numpy() != rows["bin"].to_numpy()[-1])[-1]) + 1 if rows["bin"].nunique() > 1 else 0
                kept = [rows.iloc[end:]]
                if end:
                    out, next_bin = pack(rows.iloc[:end], next_bin)
                    yield out
        if kept and sum(map(len, kept)):
            yield pack(pd.concat(kept, ignore_index=True), next_bin)[0]

    return run


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """The pieces with sequence_id and offset: no sequence is longer than size, offsets are gapless from 0."""
    slack = int(size * SLACK)
    # level 0: every piece is a bin of its own; blocks need no shuffle
    df = pieces.select("row", "doc_id", "piece", "start", "length", "ids_crc32", F.monotonically_increasing_id().alias("bin"), F.lit(0).cast("long").alias("offset"), F.lit(False).alias("full"))
    level, done, groups, bins_before = 0, [], 0, 0
    df = cut(df.mapInPandas(_packer(size, level, slack), PACKED))
    while True:
        done.append(df.filter("full"))
        rest = df.filter("not full")
        n, bins, tasks = rest.agg(F.count(F.lit(1)), F.count_distinct("bin"), F.count_distinct(F.shiftright("bin", 34))).first()
        if not n or (level and (groups == 1 or bins == bins_before)):
            done.append(rest)
            break
        groups, bins_before, level = max(-(-tasks // ARITY), -(-n // BLOCK)), bins, level + 1
        mixed = rest.repartition(groups, F.xxhash64("bin", F.lit(level))).sortWithinPartitions("bin")
        df = cut(mixed.mapInPandas(_packer(size, level, slack), PACKED))
    packed = done[0]
    for more in done[1:]:
        packed = packed.unionByName(more)
    return packed.select("row", "doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")


def sequences(spark: SparkSession, docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, and the pieces they are made of, in order."""
    pieces = tokenise(docs, path, size, keep_ids=True)
    packed = pack(pieces.drop("ids"), size).join(pieces.select("row", "piece", "ids"), ["row", "piece"])
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length", "ids")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("p"))
    return rows.select("sequence_id", F.flatten(F.transform("p", lambda x: x.ids)).alias("ids"), F.transform("p", lambda x: x.dropFields("ids")).alias("pieces"))

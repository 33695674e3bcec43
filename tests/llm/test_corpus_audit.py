"""Source divergence, tokenizer alignment and language identification: brute-force versions, edge cases, recovery of planted structure."""

import bisect
import collections
import hashlib
import math
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankpulse.llm import alignment, divergence, langid, queries
from rankpulse.llm.packing import byte_characters

CLASHING = ("n", "term", "part", "slot", "pairs", "chunk", "found", "held_out", "lang_pred", "score", "_doc", "_b0", "total", "p")


def key(row):
    return tuple((x is None, "" if x is None else x) for x in row)


def fold(doc_id, parts):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % parts


# 11 source divergence

LONG_TERM = "äb" * 3000
AUDITED = [
    *[(i, f"Alpha beta GAMMA gamma {LONG_TERM} it's x{i}", "en", "s1") for i in range(4)],
    *[(10 + i, "alpha beta beta delta-delta 123 Éa éa", "en", "s2") for i in range(4)],
    (20, "only once here", "en", "s3"),
    (21, None, "en", "s4"),
    (22, "", None, None),
    (23, "zeta zeta zeta", None, "s1"),
    (24, "zeta zeta eta", None, "s2"),
    (25, "zeta", None, None),
    (26, "few terms", "de", "s1"),
    (27, "other things", "de", "s2"),
    (27, "other things", "de", "s2"),
    (None, "alpha alpha", "en", "s1"),
]


def brute_audit(rows, least=3, top=200):
    docs = [(lang or "", source or "", [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source in rows]
    within = collections.Counter((lang, t) for lang, _, terms in docs for t in set(terms))
    kept = collections.defaultdict(list)
    for (lang, t), n in within.items():
        if n >= least:
            kept[lang].append(t)
    counts = collections.defaultdict(collections.Counter)
    for lang, source, terms in docs:
        counts[lang, source].update(t for t in terms if t in set(kept[lang]))
    p = lambda c, lang: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept[lang])) for t in kept[lang]}
    out = []
    for lang, source in counts:
        own = p(counts[lang, source], lang)
        every = p(sum((counts[g] for g in counts if g[0] == lang), collections.Counter()), lang)
        pairs = []
        for other in (s for x, s in counts if x == lang and s != source):
            q = p(counts[lang, other], lang)
            pairs.append((-sum((own[t] - q[t]) ** 2 // q[t] for t in kept[lang]), other.encode()))
        terms = [(-((own[t] - every[t]) ** 2 // every[t]), t.encode()) for t in kept[lang] if counts[lang, source][t] and own[t] > every[t]]
        out += [(lang, source, "pair", item.decode(), -v, i + 1) for i, (v, item) in enumerate(sorted(pairs))]
        out += [(lang, source, "term", item.decode(), -v, i + 1) for i, (v, item) in enumerate(sorted(terms)[:top])]
    return sorted(out)


def audited(df, **more):
    return sorted(tuple(r) for r in divergence.audit(df, **more).select("lang", "source", "part", "item", "value", "rank").collect())


def test_audit(spark):
    df = spark.createDataFrame(AUDITED, "doc_id long, text string, lang string, source string")
    wide = df.withColumns({c: F.lit(1) for c in CLASHING})
    assert audited(wide) == brute_audit(AUDITED)
    assert audited(wide, top=1) == brute_audit(AUDITED, top=1)
    assert audited(wide.limit(0)) == []
    nulls = spark.createDataFrame([(None, None, None, None)] * 2, df.schema)
    assert audited(nulls) == []
    assert audited(df, least=100) == brute_audit(AUDITED, least=100)  # no term is kept: pairs have the value 0


def test_audit_in_parts(spark, monkeypatch):
    """Shards of a few keys in a wave each, tasks that hold little, narrow blocks and tiles of two sources, long texts in pieces: the same rows."""
    monkeypatch.setattr(divergence, "SHARD_BYTES", 200)
    monkeypatch.setattr(divergence, "WAVE_BYTES", 3000)
    monkeypatch.setattr(divergence, "WIDTH", 3)
    monkeypatch.setattr(divergence, "TILE", 2)
    rng = np.random.default_rng(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    rows = [(i, " ".join(rng.choice(words, 30)), "en" if i % 3 else "fr", f"s{rng.integers(5)}") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    assert audited(df) == brute_audit(rows)


def test_terms_in_pieces(monkeypatch):
    text = ("Aé x-y " * 50 + "z" * 500 + " b").encode()
    whole = [t for part in divergence.terms_of(text) for t in part]
    for size in (7, 64, 501):
        monkeypatch.setattr(divergence, "PIECE", size)
        assert [t for part in divergence.terms_of(text) for t in part] == whole
    assert whole == re.findall(rb"[a-z\x80-\xff]+", text.replace(b"A", b"a"))


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_perfect_hash(n):
    keys = [f"k{i}".encode() for i in range(n)]
    found = divergence.PerfectHash.build(keys)
    assert sorted(found.verified(keys).tolist()) == list(range(n)) and [found.keys[s] for s in found.slots(keys)] == keys
    assert (found.verified([f"other{i}".encode() for i in range(500)]) == -1).all()


# 12 tokenizer alignment

ODD = [
    "", None, " ", "  ", "\n", "a", "\n\nb c", " lead", "trail ", "tab\t  x", "x\t y", "a \t b", "a\x1cb c", "!\x1c d", "a　 b　c", "a᠎ b ", "▁x y", "one ▁ two", "<|endoftext|> q<|endoftext|>z", "<s>hi</s> <0x41>", "é à ü ß 字字 字。", "😀😃 x", "a\r\nb\r\n",
    "1234 5's don't we'll", "x" * 3000, "word " * 3000, "\x00 a", "﻿x", "  two  spaces  ", " \n \n x", "ﬁ ① é", "字" * 2000, "The same words, the same words.\nThe same words",
]
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def coders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(queries.byte_bpe())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=queries.pieces())
    of = byte_characters()
    bytes_a = {i: bytes(of.get(c, 0) for c in t) for t, i in a.get_vocab().items()}

    def bytes_b(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    return lambda t: [(i, bytes_a[i]) for i in a.encode(t, add_special_tokens=False).ids], lambda t: [(i, bytes_b(i)) for i in b.encode(t)]


def brute_align(rows, coders):
    """Whole texts encoded by the libraries themselves."""
    found, counts = [], collections.Counter()
    for doc_id, text in rows:
        a, b = (coders[0](f" {text}"), coders[1](text)) if text else ([], [])
        same = text and b"".join(x for _, x in a) == b"".join(x for _, x in b) == f" {text}".encode()
        groups, links = [], []
        if same:
            ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b)]
            i = j = 0
            for end in sorted({*ends[0]} & {*ends[1]}):
                x, y = bisect.bisect_right(ends[0], end), bisect.bisect_right(ends[1], end)
                groups.append(",".join(str(k) for k, _ in a[i:x]) + "|" + ",".join(str(k) for k, _ in b[j:y]))
                links.append((a[x - 1][0], b[y - 1][0]))
                i, j = x, y
        counts.update(links)
        found.append((doc_id, len(a) if same else 0, len(b) if same else 0, groups, links))
    most = collections.defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return sorted([(d, n, m, len(g), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, n, m, g, links in found], key=key)


def aligned(df):
    return sorted([tuple(r) for r in alignment.align(df, queries.byte_bpe(), queries.pieces()).select(*COLUMNS).collect()], key=key)


def test_alignment(spark, coders):
    rows = [*enumerate(ODD), (None, "no id here"), (3, "again  twice"), (3, "again  twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert aligned(df.withColumns({c: F.lit(1) for c in CLASHING}).repartition(3)) == brute_align(rows, coders)
    assert aligned(df.limit(0)) == []
    assert aligned(spark.createDataFrame([(None, None)], df.schema)) == [(None, 0, 0, 0, 0, 0, 0, "")]


def test_alignment_of_documents(spark, sf, coders, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK", 20_000)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert aligned(docs.repartition(3)) == brute_align([tuple(r) for r in docs.collect()], coders)


def test_stretches(coders):
    """Stretches encoded apart have the ids of the whole text; also when the vocabulary's boundaries aren't relied on, and when little is kept."""
    own = alignment.Aligner(queries.byte_bpe(), queries.pieces())
    assert own.boundaries
    for text in filter(None, ODD):
        parts, whole = own.parts_of(f" {text}"), [f" {text}"]
        assert "".join(parts) == whole[0]
        known = own.learn({*parts, *whole})
        assert [x.tolist() if hasattr(x, "tolist") else x for x in alignment.aligned(parts, known, own)] == [x.tolist() if hasattr(x, "tolist") else x for x in alignment.aligned(whole, known, own)]
        if "▁" in text:
            assert None in map(known.get, parts)
        else:
            a, b = (np.frombuffer(b"".join(known[p][k] for p in parts), dtype="<u4").tolist() for k in (0, 1))
            assert a == [i for i, _ in coders[0](f" {text}")] and b == [i for i, _ in coders[1](text)]


def test_little_is_kept(spark, sf, monkeypatch):
    rows = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(30).collect()]
    want = alignment._chunk(0, [0] * len(rows), rows, alignment.Aligner(queries.byte_bpe(), queries.pieces()))
    monkeypatch.setattr(alignment, "CACHE", 50)
    monkeypatch.setattr(alignment, "LONG", 5)
    own = alignment.Aligner(queries.byte_bpe(), queries.pieces())
    for k in (10, 20, 30):
        got = alignment._chunk(0, [0] * k, rows[:k], own)
    assert got == want


def test_tokens_of_no_bytes():
    """Of tokens that end together all are linked, and they stay in one group."""
    ids, lengths = [np.array([1, 2, 3]), np.array([7, 8])], [np.array([2, 0, 3]), np.array([2, 3])]
    cuts = [np.array(c) for c in alignment.cut_ends(*[n.cumsum().tolist() for n in lengths])]
    pairs = alignment.linked(ids, lengths, cuts)
    assert {(int(p) >> alignment.SHIFT, int(p) & 0xFFFFFF) for p in pairs} == {(1, 7), (2, 7), (3, 8)}
    assert alignment.groups_text(ids, cuts, alignment._digits(20)).tobytes() == b"1,2|7;3|8;"


# 13 language identification


def brute_bucket(points):
    n, h, mask = len(points), 0, (1 << 64) - 1
    for k, c in enumerate(points):
        h = (h * 0x9E3779B97F4A7C15 + c + k + 1) & mask
    assert n
    return (((h ^ (h >> 31)) * 0xBF58476D1CE4E5B9) & mask) >> (64 - langid.BITS)


def brute_grams(text):
    x = [ord(c.lower()) if unicodedata.category(c)[0] in "LM" and len(c.lower()) == 1 else ord(c) if unicodedata.category(c)[0] in "LM" else 32 for c in f" {text} "]
    out = collections.Counter()
    for n in range(1, langid.ORDERS + 1):
        for i in range(len(x) - n + 1):
            g = x[i : i + n]
            if all(c != 32 for c in g[1:-1]) and any(c != 32 for c in g):
                out[brute_bucket(g)] += 1
    return out


LANGS = {"en": "the cat and the dog were in the house with", "de": "der hund und die katze waren im haus mit straße", "fr": "le chien et le chat étaient dans la maison avec", "el": "Ο σκύλος και η γάτα ήταν στο ΣΠΙΤΙ", "hi": "कुत्ता और बिल्ली घर में थे"}


@pytest.fixture(scope="module")
def spoken():
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(LANGS[lang].split(), 12)) + ".", lang) for i, lang in enumerate(rng.choice(list(LANGS), 160))]
    return rows + [(1000, None, "en"), (1001, "", "en"), (1002, " 12 + 7 = 19!\n", "de"), (1003, "the house", None), (None, "der hund", "de"), (5, "Haus İ ß", None), (1004, "die katze " * 2000, None), (1005, "x" * 5000, None)]


def brute_langid(rows):
    grams = {i: brute_grams(t or "") for i, (_, t, _) in enumerate(rows)}
    letter = {i: any(unicodedata.category(c)[0] == "L" for c in t or "") for i, (_, t, _) in enumerate(rows)}
    taught = [i for i, (d, _, lang) in enumerate(rows) if lang is not None and fold(d, 4) != 2 and letter[i]]
    sums, docs = collections.defaultdict(collections.Counter), collections.Counter(rows[i][2] for i in taught)
    for i in taught:
        sums[rows[i][2]].update(grams[i])
    total = {lang: sum(c.values()) for lang, c in sums.items()}
    out = []
    for i, (d, _, _) in enumerate(rows):
        z = {}
        for lang in sorted(sums):
            z[lang] = math.log(docs[lang] / len(taught)) + sum(n * (math.log(sums[lang][g] + langid.SMOOTHING) - math.log(total[lang] + langid.SMOOTHING * (1 << langid.BITS))) for g, n in grams[i].items())
        best = max(z, key=z.get) if letter[i] and z else "und"
        out.append((d, fold(d, 4) == 2, best, 1 / sum(math.exp(x - z[best]) for x in z.values()) if best != "und" else 0.0))
    return out


def test_langid(spark, spoken, monkeypatch):
    df = spark.createDataFrame(spoken, "doc_id long, text string, lang string")
    wide = df.withColumns({c: F.lit(1) for c in CLASHING})
    want = sorted(brute_langid(spoken), key=key)
    for block, piece in ((32, 1 << 18), (2, 100)):  # one matrix; three matrices, and long texts in pieces
        monkeypatch.setattr(langid, "BLOCK", block)
        monkeypatch.setattr(langid, "PIECE", piece)
        got = sorted((tuple(r) for r in langid.classify(wide.repartition(3)).select("doc_id", "held_out", "lang_pred", "score").collect()), key=key)
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-3)
    out = langid.classify(wide)
    assert {"lang", "n", "_doc", "total"} <= set(out.columns) and len(out.columns) == len(set(out.columns))
    assert langid.classify(wide.limit(0)).count() == 0
    unknown = langid.classify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert all(r.lang_pred == "und" and r.score == 0 for r in unknown)


def test_langid_held_out(spark, sf):
    rows = queries.op13_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert rows and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)

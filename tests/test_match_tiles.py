"""Texts of a block are compared tile by tile: no match is lost, and only pairs that can match are written."""

import random
import time
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from rankpulse.operators import resolve

SCHEMA = "id long, b string, text string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("seen", F.lit("2026-01-01").cast("date"))


def matches(df, **more):
    out = resolve.similarity_match(df, df, ["b"], "id", "id", "text", "seen", threshold=0.7, sequence=False, **more)
    return {r.id: (r.matched_uid, round(r.score, 9)) for r in out.collect()}


def drawn(rng, n, vocabulary, change):
    """Twelve texts of about n words, each changed a little."""
    base = [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    return [" ".join(w if rng.random() > change else f"x{rng.randrange(vocabulary)}" for w in base) for _ in range(12)]


def test_no_match_is_lost_between_tiles(spark, monkeypatch):
    """Tiles of 8 texts, words by the ten and by the thousand, a block without a name, copies and empty texts."""
    monkeypatch.setattr(resolve, "TILE", 8)
    rng = random.Random(11)
    texts = [t for n in (1, 4, 20, 60, 300, 900, 1500) for t in drawn(rng, n, 3000, 0.06)] + ["", "", "same words", "same words"]
    rows = [(i, ("p", None)[rng.randrange(2)], t) for i, t in enumerate(texts)]
    sets = [set(t.split()) for t in texts]
    score = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    want = {}
    for i, block, _ in rows:
        best = min(((-score(sets[i], sets[j]), j) for j, other, _ in rows if j != i and block == other and score(sets[i], sets[j]) >= 0.7), default=None)
        if best:
            want[i] = (best[1], round(-best[0], 9))
    assert len(want) > 30 and max(len(sets[i]) for i in want) > 800
    assert matches(table(spark, rows)) == want


def test_only_possible_pairs_are_written(spark, monkeypatch):
    """200 texts of a small vocabulary, of which all share frequent words and four are alike: a row for each of the 19,900 pairs is nowhere written, nor one for each word."""
    written, plain = [], resolve.cut

    def cut(df):
        out = plain(df)
        written.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(resolve, "cut", cut)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(80)]
    texts = [" ".join(rng.sample(words, 40)) for _ in range(198)]
    texts += [texts[0] + " and", texts[1] + " or"]
    found = matches(table(spark, [(i, "p", t) for i, t in enumerate(texts)]))
    assert {i: found[i][0] for i in (0, 1, 198, 199)} == {0: 198, 1: 199, 198: 0, 199: 1}
    pairs = [n for columns, n in written if {"_l", "_r"} <= set(columns)]
    assert pairs and 4 <= max(pairs) < 400
    assert max(n for _, n in written) <= 400 and not any("_all" in columns for columns, _ in written)


def test_ratio_is_that_of_difflib():
    rng = random.Random(4)
    for length, letters in ((0, "ab"), (3, "ab"), (12, "abc"), (60, "abcd "), (190, "abcdefgh "), (260, "abcdefghijklmnopqrstuvwxyz é"), (900, "eeeeeeeeeeaaaaaaaooooooottttt   qxzjkvö")):
        for _ in range(40):
            a = "".join(rng.choice(letters) for _ in range(length))
            b = "".join(x if rng.random() > 0.1 else rng.choice(["", x + rng.choice(letters), rng.choice(letters)]) for x in a) + rng.choice(["", "q", a[: length // 3]])
            assert resolve.ratio(a, b) == SequenceMatcher(None, a, b).ratio() and resolve.ratio(b, a) == SequenceMatcher(None, b, a).ratio()


def test_long_texts_are_compared_in_little_time():
    """Two texts of 20,000 characters, whose difference takes difflib seconds."""
    rng = random.Random(9)
    words = ["".join(rng.choice("eeeeaaaooottinshrdlqxzjkvwybp") for _ in range(rng.randrange(2, 9))) for _ in range(1500)]
    a = [rng.choice(words) for _ in range(3000)]
    b = [w if rng.random() > 0.05 else rng.choice(words) for w in a]
    began = time.process_time()
    resolve.ratio(" ".join(a), " ".join(b))
    assert time.process_time() - began < 5

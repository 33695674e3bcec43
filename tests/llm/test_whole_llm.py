"""Searches whose work is not cut short."""

import collections

import numpy as np
import pytest

from rankpulse.llm import jaccard, simhash


@pytest.mark.parametrize("radius", [0, 7, 8, 15, 17])
def test_all_within_any_radius_meet(spark, radius):
    rng = np.random.default_rng(radius)
    base = [int.from_bytes(rng.bytes(16), "big") for _ in range(30)]
    prints = base + [b ^ sum(1 << int(x) for x in rng.choice(128, int(rng.integers(0, 2 * radius + 2)), replace=False)) for b in base for _ in range(9)]
    counts = collections.Counter(f"{p:032x}" for p in prints)
    df = spark.createDataFrame([(f"{p:032x}",) for p in prints], "fingerprint string")
    want = {(a, b, n) for a in counts for b, n in counts.items() if bin(int(a, 16) ^ int(b, 16)).count("1") <= radius}
    assert sorted(map(tuple, simhash.within(df, df, radius).collect())) == sorted(want)


def test_edited_texts_are_near(spark):
    """Copies of 200 words with one to four of them replaced are found, with their ids; other texts are not."""
    rng = np.random.default_rng(11)
    rows = []
    for group in range(12):
        base = [f"word{x}" for x in rng.integers(0, 5000, 200)]
        for k in range(5):
            w = list(base)
            for at in rng.choice(200, k, replace=False):
                w[at] = f"new{rng.integers(10**6)}"
            rows.append((20 * group + k, " ".join(w)))
    got = {r.doc_id: r for r in simhash.compare(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    asked = [got[20 * g] for g in range(12)]
    assert all(set(r.near_ids) <= set(range(r.doc_id + 1, r.doc_id + 5)) and r.n_near == len(r.near_ids) for r in asked)
    assert sum(r.n_near for r in asked) >= 0.9 * 48
    assert all(r.n_near is None and r.near_ids is None for i, r in got.items() if i % 20)


def test_template_pages_and_null_ids(spark, monkeypatch):
    """Pages of one template, too unlike for links, leave the index before they are compared; links among texts without ids, or of one id, are found once."""

    made = collections.Counter()
    rest = jaccard._rest
    monkeypatch.setattr(jaccard, "_rest", lambda rows, sets: (made.update(rows=rows.count()), rest(rows, sets))[1])
    common = [f"c{k}" for k in range(104)]
    pages = [(i, " ".join(common + [f"own{i}x{k}" for k in range(25)])) for i in range(300)]
    out = {r.doc_id: r.component_id for r in jaccard.link(spark.createDataFrame(pages, "doc_id long, text string")).collect()}
    assert out == {i: i for i in range(300)} and made["rows"] < 300
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words[:50] + [f"x{g}"] + words[50:] + [f"{g}y{k}" for k in range(30)]) for g in range(12)]
    rows = [(None if i % 2 else i // 24 * 24, texts[i % 12] + (" end" if i % 3 == 0 else "")) for i in range(120)]
    got = jaccard.linked_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 120
    groups = collections.defaultdict(set)
    for r in got:
        groups[r.component].add(r.text_hash)
    assert len(groups) == 12 and sorted(map(len, groups.values())) == sorted([2 if len({i % 3 == 0 for i in range(g, 120, 12)}) == 2 else 1 for g in range(12)])

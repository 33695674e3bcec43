"""Queries whose work is not cut short."""

from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from rankpulse.plans import registry
from rankpulse.sources.star import facts, star


def test_lists_are_whole(spark, sf):
    """All items of all lists are entries, and reach the queries."""
    n = facts(spark, sf).count()
    assert star(spark, sf)["rank_entries"].count() == n
    longest = facts(spark, sf).groupBy("platform", "rank_family", "snapshot_date").count().agg(F.max("count")).first()[0]
    ranks = registry.QUERIES["snapshot_listing"](spark, sf)
    assert ranks.count() == n and ranks.agg(F.max("rank")).first()[0] == longest > 30
    assert set(registry.QUERIES) - {"similarity_match"} <= set(registry.ORACLES)
    assert registry.QUERIES["entries_browse"](spark, sf).count() > 0


def test_long_texts_and_late_ids_match(spark, tmp_path):
    """In a block of 340 documents the last ones match too, also those of more than 1,500 characters."""
    rng = np.random.default_rng(12)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 400, 8)) for _ in range(310)]
    for size in (20, 600):
        base = [f"v{x}" for x in rng.integers(0, 3000, size)]
        texts += [" ".join(base[:-k] + [f"e{size}"] * k) for k in (1, 2, 3)] + [" ".join(base[: size * 3 // 4])] * 2
    texts += ["", " ", "...", "late copy", "Late copy!"] + ["one"] * 15
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    normal = [" ".join(t.lower().replace(".", " ").replace("!", " ").split()) for t in texts]
    bags = [set(t.split()) for t in normal]
    for name, sequence in (("word_match", False), ("similarity_match", True)):
        want = {}
        for i, a in enumerate(bags):
            scores = []
            for j, b in enumerate(bags):
                x = len(a & b) / len(a | b) if a | b else 1.0
                if i != j and x >= (0.35 / 0.65 if sequence else 0.7):
                    if sequence:
                        x = 0.65 * x + 0.35 * SequenceMatcher(None, normal[i], normal[j]).ratio()
                    if x >= 0.7:
                        scores.append((-x, j))
            if scores:
                want[i] = (min(scores)[1], round(-min(scores)[0], 6))
        assert len(want) >= 30
        assert {r.doc_id: (r.matched_uid, r.score) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()} == want

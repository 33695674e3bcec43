"""Pairs of texts that can't match are dropped by signatures, and no others."""

import random

from pyspark.sql import functions as F

from rankpulse.operators import resolve


def test_signatures_lose_no_match(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(60)}" for _ in range(n)] for n in (1, 3, 9, 30, 30, 30)]
    texts = [" ".join(w if rng.random() > 0.12 else f"x{rng.randrange(40)}" for w in b) for b in base for _ in range(12)] + ["", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumns({"b": F.lit("a"), "seen": F.lit("2026-01-01").cast("date")})
    out = resolve.similarity_match(df, df, ["b"], "id", "id", "text", "seen", threshold=0.7, sequence=False)
    assert "bit_count" in out._jdf.queryExecution().executedPlan().toString()
    sets = [set(t.split()) for t in texts]
    score = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    want = {}
    for i, a in enumerate(sets):
        best = min(((-score(a, b), j) for j, b in enumerate(sets) if j != i and score(a, b) >= 0.7), default=None)
        if best:
            want[i] = (best[1], round(-best[0], 9))
    assert {r.id: (r.matched_uid, round(r.score, 9)) for r in out.collect()} == want

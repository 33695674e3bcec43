"""Matches of items and novels of which many agree on all that counts."""

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from rankpulse.operators import resolve
from rankpulse.operators import upsert as U

ITEMS = "platform string, platform_novel_id string, title_norm string, author_norm string, intro_norm string, main_category string, chapter_titles array<string>"
CHAPTERS = ["the road", "the town", "the gate"]


def stored(spark, rows):
    """Novels (uid, author, intro, day, chapters) with a title each, (uid, title)."""
    df = spark.createDataFrame([(u, "alpha", f"n{u}", a, i, "c", d, ch) for u, a, i, d, ch, _ in rows], "novel_uid long, platform string, platform_novel_id string, author_norm string, intro_norm string, main_category string, day string, chapter_titles array<string>")
    novels = df.withColumns({"signature_json": U.signature(df), "last_seen_date": F.to_date("day")})
    return novels, spark.createDataFrame([(u, t) for u, _, _, _, _, t in rows], "novel_uid long, title_norm string")


def test_copies_are_compared_once(spark, monkeypatch):
    """300 items like 300 novels: one pair of classes, and the match is the newest novel of the smallest uid."""
    made, plain = [], resolve.candidates
    monkeypatch.setattr(resolve, "candidates", lambda *a: made.append(plain(*a).count()) or plain(*a))
    novels, titles = stored(spark, [(i + 1, "ann", "a long road to a town", None if i == 0 else f"2026-01-0{1 + i % 3}", CHAPTERS, "the road") for i in range(300)])
    items = spark.createDataFrame([("alpha", f"i{i:03}", "the road", "ann", "a long road to a town", "c", CHAPTERS) for i in range(300)], ITEMS)
    got = resolve.best_matches(items, novels, titles).collect()
    assert len(got) == 300 and {(r.novel_uid, r.root_id) for r in got} == {(3, None)}
    assert made == [1]
    among = {r.platform_novel_id: (r.novel_uid, r.root_id) for r in resolve.best_matches(items, novels, titles, among=True).collect()}
    assert among == {f"i{i:03}": (None, "i000") if i else (3, None) for i in range(300)}


def test_same_matches_as_all_pairs(spark):
    """Items with copies and near copies, some stored: each takes what comparing it with all novels and all smaller ids finds."""
    import random

    rng = random.Random(7)
    words = "a long road leads through mountains to the town that nobody has seen".split()
    draw = lambda: (rng.choice(["ann", "bob"]), " ".join(words[: rng.choice([11, 12, 13])]), rng.choice([CHAPTERS, CHAPTERS[:2]]), rng.choice(["road", "roads", "town"]))
    old = [(i + 1, a, t, rng.choice(["2026-01-01", "2026-01-02"]), ch, title) for i in range(12) for a, t, ch, title in [draw()]]
    new = [("alpha", f"i{i:02}", title, rng.choice([a, a, ""]), t, "c", ch) for i in range(40) for a, t, ch, title in [draw()]]

    def score(x, intro, chapters, title):
        jac = lambda a, b: len({*a} & {*b}) / len({*a} | {*b})
        return 0.65 * (0.65 * jac(x[4].split(), intro.split()) + 0.35 * SequenceMatcher(None, x[4], intro).ratio()) + 0.25 * jac(x[6], chapters) + 0.10 * SequenceMatcher(None, x[2], title).ratio() + 0.03

    want = {}
    for x in new:
        found = [(-round(score(x, i, ch, t), 12), 1, -int(d[-1]), u, None) for u, a, i, d, ch, t in old if x[3] in ("", a)]
        found += [(-round(score(x, y[4], y[6], y[2]), 12), 0, 0, 0, y[1]) for y in new if y[1] < x[1] and x[3] in ("", y[3])]
        found = sorted(f for f in found if f[0] <= -0.84)
        if found:
            want[x[1]] = (found[0][3] or None, found[0][4])
    novels, titles = stored(spark, old)
    got = {r.platform_novel_id: (r.novel_uid, r.root_id) for r in resolve.best_matches(spark.createDataFrame(new, ITEMS), novels, titles, among=True).collect()}
    assert len(want) > 30 and {v[0] is None for v in want.values()} == {True, False} and got == want


def test_node_of_both_sides(spark, monkeypatch):
    """An item among the right side too has its words counted once, so none of its rare words is left out."""
    monkeypatch.setattr(resolve, "FREQUENT", 0)
    schema = "_node string, platform string, _author string, _sig array<string>, _words array<string>"
    left = spark.createDataFrame([("i1", "alpha", "a", ["t"], ["p", "q", "x", "y", "z"]), ("i2", "alpha", "a", ["t"], ["r", "s", "x", "y", "z", "w"]), ("i3", "alpha", "a", ["t"], ["x", "y", "z", "p", "r", "v"])], schema)
    want = {(a, b) for a, b in (("i3", "i1"), ("i1", "i3"))}
    assert want <= {(r._left, r._right) for r in resolve.candidates(left, left, 0.84).collect()}

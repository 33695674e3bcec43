"""Identity of items on the way into the tables."""

import pytest

from rankpulse.operators import resolve
from rankpulse.operators import upsert as U
from rankpulse.sources import versions
from rankpulse.sources.star import read_tables, write_tables
from rankpulse.streaming import streams

ITEM = "platform string, platform_novel_id string, title string, author string, intro string, main_category string, tags array<string>, status string, total_words long, url string, rank int, total_recommend long, reading_count long, rank_family string, rank_sub_cat string, source_url string, snapshot_date string, chapter_titles array<string>"
INTRO = "a long road leads through the mountains to a town that nobody has seen for a hundred years"
CHAPTERS = ["The road", "The town", "The gate", "The well", "The end"]


def item(i, title, day, author="ann", intro=INTRO, category="travel", chapters=CHAPTERS):
    return ("alpha", i, title, author, intro, category, ["x"], "", 10, "u", 1, 5, None, "hot", "", "", day, chapters)


def saved(spark, folder, *days):
    tables = U.empty_tables(spark)
    for k, rows in enumerate(days):
        write_tables(U.save_snapshots(tables, spark.createDataFrame(rows, ITEM), work=f"{folder}/work{k}"), f"{folder}/{k}")
        tables = read_tables(spark, f"{folder}/{k}")
    novels = {r.platform_novel_id: r for r in tables["novels"].collect()}
    titles = {(r.novel_uid, r.title): r.is_primary for r in tables["novel_titles"].collect()}
    return novels, titles


def test_renamed_item_stays_one(spark, tmp_path):
    """A new id and title, the same author, introduction and chapters: the stored novel takes the id, and the title as an alias. Others are new."""
    first = [item("1", "The long road", "2026-01-01"), item("2", "Quite another", "2026-01-01", author="bob", intro="x y z", chapters=["One"])]
    second = [item("9", "The longer road", "2026-01-02"), item("8", "No", "2026-01-02", author="eve"), item("7", "Quite another", "2026-01-02", author="bob", intro="x y z", chapters=None)]
    novels, titles = saved(spark, tmp_path / "a", first, second)
    assert set(novels) == {"9", "2", "8", "7"} and len({r.novel_uid for r in novels.values()}) == 4
    uid = novels["9"].novel_uid
    assert titles[uid, "The long road"] == 1 and titles[uid, "The longer road"] == 0
    assert (str(novels["9"].created_date), str(novels["9"].last_seen_date)) == ("2026-01-01", "2026-01-02")
    again, same = saved(spark, tmp_path / "b", first, second, second)
    assert {k: r.novel_uid for k, r in again.items()} == {k: r.novel_uid for k, r in novels.items()} and same == titles


def test_no_low_threshold(spark):
    empty = U.empty_tables(spark)
    with pytest.raises(ValueError):
        resolve.best_matches(empty["novels"], empty["novels"], empty["novel_titles"], 0.7)


#: Item 1 comes as 9 and 5, then, as itself, again; 3 and 4 of one day are one, so is 6 of the next; 2 keeps its id, its category and words where later rows have none.
DAYS = [
    [item("1", "The long road", "2026-01-01"), item("2", "Quite another", "2026-01-01", author="bob", intro="x y z", chapters=["One"])],
    [item("9", "The longer road", "2026-01-02"), item("3", "Deep sea", "2026-01-02", author="cy", intro="under the waves lives a whale", chapters=["Dive", "Whale"]), item("4", "The deep sea", "2026-01-02", author="cy", intro="under the waves lives a whale", chapters=["Dive", "Whale"])],
    [item("5", "Longer roads", "2026-01-03", intro=INTRO + " or more"), item("6", "Deep deep sea", "2026-01-03", author="", intro="under the waves lives a whale", chapters=["Dive", "Whale"]), item("2", "Quite another", "2026-01-03", author="bob", intro="x y z", category="", chapters=None)],
    [item("1", "The long road", "2026-01-04"), item("7", "Not the road", "2026-01-04", author="dan")],
]


def novels_of(tables):
    """What tells novels apart, without their numbers: their last id and the titles, days, tags and entries that they have."""
    uid = {r.novel_uid: (r.platform_novel_id, r.main_category, str(r.created_date), str(r.last_seen_date), r.intro, r.signature_json) for r in tables["novels"].collect()}
    titles = sorted((uid[r.novel_uid], r.title, r.is_primary, str(r.first_seen_date), str(r.last_seen_date)) for r in tables["novel_titles"].collect())
    days = {r.snapshot_id: str(r.snapshot_date) for r in tables["rank_snapshots"].collect()}
    entries = sorted((uid[r.novel_uid], days[r.snapshot_id]) for r in tables["rank_entries"].collect())
    return sorted(uid.values()), titles, entries


def test_same_novels_however_days_are_cut(spark, tmp_path):
    def run(name, *batches):
        tables = U.empty_tables(spark)
        for k, rows in enumerate(batches):
            write_tables(U.save_snapshots(tables, spark.createDataFrame(rows, ITEM), work=f"{tmp_path}/{name}/work{k}"), f"{tmp_path}/{name}/{k}")
            tables = read_tables(spark, f"{tmp_path}/{name}/{k}")
        return novels_of(tables)

    one = run("one", sum(DAYS, []))
    assert [n[0] for n in one[0]] == ["1", "2", "6", "7"] and one == run("days", *DAYS)
    assert {t[1] for t in one[1] if t[0][0] == "1"} == {"The long road", "The longer road", "Longer roads"}
    assert next(n for n in one[0] if n[0] == "2")[1] == "travel"

    source, kept, checkpoint = (str(tmp_path / x) for x in ("source", "kept", "checkpoint"))
    for rows in (DAYS[0], DAYS[1] + DAYS[2], DAYS[3]):
        spark.createDataFrame(rows, ITEM).coalesce(1).write.mode("append").parquet(source)
        out = streams.ingest(streams.read_events(spark, source, ITEM), kept, checkpoint)
    assert novels_of(out) == one


def side(rows, spark):
    return spark.createDataFrame(rows, "_node string, platform string, _author string, _sig array<string>, _words array<string>")


def test_title_that_all_share(spark):
    """Five titles that all novels share, by many authors, by one, or by none: the pairs grow with the novels, and the alike are found."""
    made = {}
    for n in (200, 800):
        chapters = [f"chapter {k}" for k in range(5)]
        novels = side([(f"n{i}", "alpha", f"a{i % (n // 5)}" if i % 2 else "all", chapters, [f"w{i}x{k}" for k in range(20)] + ["the", "of"]) for i in range(n)], spark)
        items = side([(f"i{i}", "alpha", ("" if i % 3 == 0 else f"a{i % (n // 5)}" if i % 2 else "all"), chapters, [f"w{i}x{k}" for k in range(18)] + ["the", "of", "new"]) for i in range(n)], spark)
        found = {(r._left, r._right) for r in resolve.candidates(items, novels, 0.84).collect()}
        assert {(f"i{i}", f"n{i}") for i in range(n)} <= found
        made[n] = len(found)
    assert made[800] < 5 * made[200] + 1000


def test_candidates_lose_nothing(spark, monkeypatch):
    """All pairs that pass both bounds are candidates, whichever route they take."""
    import random

    rng = random.Random(4)
    titles, words = [f"t{k}" for k in range(8)], [f"w{k}" for k in range(12)]
    draw = lambda kind, n: [(f"{kind}{i}", "alpha", rng.choice(["", "a", "b"]), rng.sample(titles, rng.randint(1, 5)), rng.sample(words, rng.randint(1, 8))) for i in range(n)]
    left, right = draw("i", 60), draw("n", 60)
    least_words, least_titles = resolve.least_jaccards(0.84)
    alike = lambda a, b: len({*a} & {*b}) / len({*a} | {*b})
    want = {(a[0], b[0]) for a in left for b in right if a[2] in ("", b[2]) and alike(a[3], b[3]) >= least_titles and alike(a[4], b[4]) >= least_words}
    assert want
    for frequent in (64, 3, 0):
        monkeypatch.setattr(resolve, "FREQUENT", frequent)
        assert want <= {(r._left, r._right) for r in resolve.candidates(side(left, spark), side(right, spark), 0.84).collect()}


def test_ingest_goes_on(spark, tmp_path):
    """Two sessions over the same folder: the second goes on from the versions it finds, and a failed version is written anew."""
    source, kept, checkpoint = (str(tmp_path / x) for x in ("source", "kept", "checkpoint"))
    row = item("1", "The long road", "2026-01-01")
    spark.createDataFrame([row], ITEM).coalesce(1).write.parquet(source)
    stream = lambda: streams.read_events(spark, source, ITEM)
    assert streams.ingest(stream(), kept, checkpoint)["novels"].count() == 1
    spark.createDataFrame([item("2", "Other", "2026-01-02", author="bob", chapters=None)], ITEM).coalesce(1).write.mode("append").parquet(source)
    left = tmp_path / "kept" / "data" / "novels" / "v=1" / "bucket=0"
    left.mkdir(parents=True)
    (left / "part-left.parquet").write_text("x")
    out = streams.ingest(stream(), kept, checkpoint)
    assert sorted(r.platform_novel_id for r in out["novels"].collect()) == ["1", "2"] and versions.numbers(spark, kept) == [0, 1]


def test_versions_write_what_changes(spark, tmp_path, monkeypatch):
    """One more row writes one bucket of its table; a crash before the manifest leaves the version before; all versions stay readable."""
    folder = str(tmp_path / "kept")
    tags = lambda n: U.empty_tables(spark) | {"tags": spark.createDataFrame([(i, f"Tag {i}", f"tag {i}") for i in range(n)], "tag_id long, tag_name string, tag_norm string")}
    first = versions.write(spark, folder, 0, tags(100), None)
    assert len(first) == versions.BUCKETS and all(w.startswith("data/tags/v=0/") for w in first)
    assert len(versions.write(spark, folder, 3, tags(101), 0)) == 1 and versions.write(spark, folder, 4, tags(101).copy(), 3) == []
    commit = versions.commit
    monkeypatch.setattr(versions, "commit", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        versions.write(spark, folder, 5, tags(140), 4)
    monkeypatch.setattr(versions, "commit", commit)
    assert versions.numbers(spark, folder) == [0, 3, 4]
    assert [versions.read(spark, folder, v)["tags"].count() for v in (0, 3, 4)] == [100, 101, 101] and versions.read(spark, folder, 4)["novels"].count() == 0
    versions.write(spark, folder, 5, tags(90), 4)
    assert sorted(r.tag_id for r in versions.read(spark, folder, 5)["tags"].collect()) == list(range(90)) and versions.read(spark, folder, 4)["tags"].count() == 101

"""Hand-computed cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from rankpulse.functions import text as T
from rankpulse.operators import coverage, heat, pages, panel, resolve, unify
from rankpulse.operators import upsert as U
from rankpulse.schema import Platform
from rankpulse.streaming import streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_percentile_with_ties_and_gap(spark):
    rows = [("a", v) for v in (1, 2, 2, 3, None, 9)] + [("b", 5), ("b", 5)]
    df = spark.createDataFrame(rows, "platform string, m long")
    got = heat.add_heat(df, (Platform("a", "m", True, None),)).select("platform", "heat_raw", "heat_pct", "heat_rz").collect()
    pct = sorted((r["platform"], r["heat_raw"] if r["heat_raw"] is not None else -1, r["heat_pct"]) for r in got)
    assert pct == [("a", -1, None), ("a", 1, 0.2), ("a", 2, 0.5), ("a", 2, 0.5), ("a", 3, 0.8), ("a", 9, 1.0), ("b", 5, 0.75), ("b", 5, 0.75)]
    assert [r["heat_rz"] for r in got if r["platform"] == "b"] == [0, 0]


def test_robust_score_of_odd_and_even_counts(spark):
    rows = [("a", v) for v in (1, 2, 2, 3, None, 9)] + [("c", v) for v in (1, 2, 4, 10)] + [("d", None), (None, 3)]
    df = spark.createDataFrame(rows, "platform string, m long")
    got = heat.add_heat(df, (Platform("a", "m", True, None),)).collect()
    score = {(r["platform"], r["heat_raw"]): r["heat_rz"] for r in got}
    assert len(got) == 11
    assert score["a", 9] == pytest.approx(7 / 1.4826) and score["a", 2] == 0 and score["a", None] is None
    assert score["c", 10] == pytest.approx(7 / (1.4826 * 1.5)) and score["c", 2] == pytest.approx(-1 / (1.4826 * 1.5))
    assert score["d", None] == 0


def test_slope_with_gap(spark):
    rows = [("p", "f", "", datetime.date(2026, 1, d), "t", 1, 1.0, y, 1.0, 1.0, 1.0, 1, 1.0, 1.0, 1.0) for d, y in ((1, 1.0), (2, None), (3, 5.0), (4, 4.0))]
    names = "platform string, rank_family string, rank_sub_cat string, period date, tag_u string, book_count long, avg_rank double, avg_heat_raw double, median_heat_raw double, entry_threshold double, tag_share double, books_in_group long, concentration_index double, efficiency double, head_ratio double"
    got = panel.window_rollup(spark.createDataFrame(rows, names)).first()
    assert round(got["heat_slope"], 6) == 1.066667
    assert got["rank_slope"] == 0


def test_one_day_has_no_deviation(spark):
    rows = [("p", "f", "", datetime.date(2026, 1, 1), "t", 1, 1.0, 2.0, 1.0, 1.0, 1.0, 1, 1.0, 1.0, 1.0)]
    names = "platform string, rank_family string, rank_sub_cat string, period date, tag_u string, book_count long, avg_rank double, avg_heat_raw double, median_heat_raw double, entry_threshold double, tag_share double, books_in_group long, concentration_index double, efficiency double, head_ratio double"
    got = panel.window_rollup(spark.createDataFrame(rows, names)).first()
    assert (got["rank_std"], got["heat_slope"], got["stage"]) == (None, None, "unknown")


@pytest.mark.parametrize("text, number", [("12.3万", 123000), ("1.13万", 11299), ("1.2亿", 120000000), ("1,234", 1234), ("x", None)])
def test_unit_numbers(spark, text, number):
    assert one(spark, T.unit_number(F.lit(text))) == number


def test_texts(spark):
    assert one(spark, T.normalize_text(F.lit("《旧书名：风起,云涌》 A-b_c　x"))) == "旧书名 风起 云涌 a b_c x"
    assert [one(spark, unify.sub_category(F.lit(x))) for x in ("仙侠·修真文明", "科幻末世", " ", "·")] == ["修真文明", "科幻末世", None, None]
    assert [one(spark, unify.unified_category(F.lit(x))) for x in ("都市高武", "西方奇幻", "历史", " ")] == ["都市", "奇幻", "历史", ""]
    empty = F.array().cast("array<string>")
    assert one(spark, T.jaccard(empty, empty)) == 1 and one(spark, T.jaccard(empty, F.array(F.lit("a")))) == 0
    assert one(spark, T.date_from_text(F.lit("更新 2026年2月8日"))) == "2026-02-08"
    assert one(spark, T.cjk_count(F.lit("abc 汉字，"))) == 3
    assert one(spark, T.add_query_parameter(F.lit("https://x/a?b=1"), "c", "2")) == "https://x/a?b=1&c=2"
    assert one(spark, T.id_from_url(F.lit("https://x/a/1234567/z"))) == "1234567"
    assert one(spark, T.ordered_union(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")), without=F.lit("a"))) == ["b", "c"]
    name = one(spark, T.link_fields(F.lit("第一章 首发时间：2026-02-08 章节字数：3,021")))
    assert (name["name"], name["first_post"], name["words"]) == ("第一章", "2026-02-08", 3021)


def test_blocked_pages(spark):
    long = "<p>" + "word " * 300 + "</p>"
    rows = [(1, "<p>" + "x" * 93), (2, f"<title>404</title>{long}"), (3, f"{long}<p>验证码</p>"), (4, f"<meta http-equiv='refresh'>{long}"), (5, long), (6, None), (7, "<script>" + "x" * 900 + "</script>")]
    got = {r["page_id"]: r["reason"] for r in pages.page_quality(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert got == {1: "too_short", 2: "bad_title", 3: "keyword", 4: "refresh", 5: "ok", 6: "too_short", 7: "little_text"}


def item(title, words, reading, day="2026-02-08", **more):
    return {"platform": "p", "platform_novel_id": "n1", "title": title, "author": "某作者", "intro": "…", "main_category": "科幻", "tags": ["科幻", "末世"], "status": "ongoing", "total_words": words, "url": "https://x/book/123456", "rank": 1, "total_recommend": None, "reading_count": reading, "rank_family": "fake_rank", "rank_sub_cat": "", "source_url": "", "snapshot_date": day} | more


ITEM = "platform string, platform_novel_id string, title string, author string, intro string, main_category string, tags array<string>, status string, total_words long, url string, rank int, total_recommend long, reading_count long, rank_family string, rank_sub_cat string, source_url string, snapshot_date string"


def rows_of(tables):
    return {name: sorted(map(str, df.collect())) for name, df in tables.items()}


def kept(spark, tables):
    return {name: spark.createDataFrame(df.collect(), df.schema) for name, df in tables.items()}


def test_rename_keeps_one_item(spark):
    """The same id under two titles: one item, two titles, the newest primary; saving twice changes nothing."""
    first = kept(spark, U.save_snapshots(U.empty_tables(spark), spark.createDataFrame([item("旧书名：风起云涌", 123456, 1111)], ITEM), True))
    second = spark.createDataFrame([item("新书名：云涌风起", 123999, 2222, "2026-02-09")], ITEM)
    after = kept(spark, U.save_snapshots(first, second, True))
    assert after["novels"].count() == 1 and after["novel_titles"].count() == 2
    assert [r["title"] for r in after["novel_titles"].filter("is_primary = 1").collect()] == ["新书名：云涌风起"]
    novel = after["novels"].first()
    assert (novel["total_words"], str(novel["created_date"]), str(novel["last_seen_date"])) == (123999, "2026-02-08", "2026-02-09")
    assert rows_of(U.save_snapshots(after, second, True)) == rows_of(after)
    assert coverage.item_count_mismatch(after).count() == 0


def test_chapters_upsert(spark):
    def chapters(n, text):
        return spark.createDataFrame([(1, i, f"第{i}章", f"{text}{i}", "", None, datetime.date(2026, 2, 8)) for i in range(1, n + 1)], "novel_uid long, chapter_num int, chapter_title string, chapter_content string, chapter_url string, word_count int, publish_date date")

    once = U.upsert_chapters(U.empty_tables(spark)["first_n_chapters"], chapters(2, "内容"))
    twice = U.upsert_chapters(spark.createDataFrame(once.collect(), once.schema), chapters(4, "内容更新"))
    stats = coverage.chapter_stats(twice, spark.createDataFrame([(1,), (2,)], "novel_uid long"))
    assert sorted(map(tuple, stats.collect())) == [(1, 4, 4), (2, 0, 0)]


def test_invalid_items_are_set_aside(spark):
    good, bad = U.valid_items(spark.createDataFrame([item("a", 1, 1), item(" ", 1, 1), item("b", 1, 1, platform_novel_id=None)], ITEM))
    assert (good.count(), bad.count()) == (1, 2)


def test_sequence_ratio(spark):
    df = spark.createDataFrame([("abcd", "bcde"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(resolve.sequence_ratio("a", "b")).collect()] == [0.75, 1.0]


def test_stream_panel_and_dedupe_plans(spark, sf):
    """The streaming forms run: a daily panel in complete mode and a dedupe within the watermark."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    stream = streams.read_events(spark, sf, schema, "events.parquet")
    for name, df, mode in (("panel", streams.daily_panel(stream), "complete"), ("once", streams.dedupe(stream, ["event_id"]), "append")):
        query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
        query.awaitTermination()
    events = spark.read.parquet(f"{sf}/events.parquet")
    assert spark.table("panel").agg(F.sum("n_events")).first()[0] == events.count()
    assert spark.table("once").count() == events.select("event_id").distinct().count()


def test_panel_properties(spark, sf):
    from rankpulse.plans.star_queries import heated

    rows = panel.period_panel(heated(spark, sf))
    alpha = rows.filter("platform = 'alpha'").groupBy("rank_family", "period").agg(F.sum("tag_share").alias("s"), F.max("concentration_index").alias("c"), F.count(F.lit(1)).alias("n")).collect()
    assert alpha and all(abs(r["s"] - 1) < 1e-9 and r["c"] >= 1 / r["n"] - 1e-9 for r in alpha)

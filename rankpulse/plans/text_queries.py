"""Queries over documents, pages, conversations and events, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankpulse.functions import text as T
from rankpulse.operators import coverage, pages, resolve
from rankpulse.operators import upsert as U
from rankpulse.sources.shared import shared_folder
from rankpulse.streaming import streams


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    norm = T.normalize_text(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(norm).alias("norm_md5"), F.length(norm).cast("long").alias("norm_chars"))


def tokenize_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Word overlap of the first and the second half of a text."""
    half = F.floor(F.length("text") / 2).cast("int")
    a = T.tokenize(F.substring(F.col("text"), F.lit(1), half))
    b = T.tokenize(F.substring(F.col("text"), half + 1, F.length("text")))
    docs = table(spark, d, "documents").withColumns({"a": F.array_distinct(a), "b": F.array_distinct(b)})
    return docs.select("doc_id", F.size("a").cast("long").alias("n_first"), F.size("b").cast("long").alias("n_second"), F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("similarity"))


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.content_hash(F.col("source"), F.col("text")).alias("content_hash"))


def cn_number(spark: SparkSession, d: str) -> DataFrame:
    """Figures of documents, written with units and read again."""
    n = F.col("n_chars")
    text = F.when(n % 3 == 0, F.concat(F.format_string("%.2f", n / 100), F.lit("万字"))).when(n % 3 == 1, F.concat(F.format_string("%,d", n), F.lit(" 字"))).otherwise(F.concat(F.lit("约 "), (n % 90 + 1).cast("string"), F.lit("亿")))
    return table(spark, d, "documents").select("doc_id", T.unit_number(text).alias("number"))


def labelled_number(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    text = F.when(n % 2 == 0, F.concat(F.lit("总推荐："), n.cast("string"), F.lit(" 次"))).otherwise(F.concat(F.lit("共 "), F.format_string("%,d", n), F.lit(" 字 总推荐")))
    return table(spark, d, "documents").select("doc_id", T.labelled_number(text, "总推荐").alias("number"), T.word_count(F.col("lang"), F.col("text")).alias("words"))


def date_from_text(spark: SparkSession, d: str) -> DataFrame:
    """Dates of orders, written in three ways and read again."""
    day = F.col("o_orderdate").cast("date")
    y, m, dd = F.year(day).cast("string"), F.month(day).cast("string"), F.dayofmonth(day).cast("string")
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.concat(F.lit("on "), y, F.lit("-"), m, F.lit("-"), dd)).when(k == 1, F.concat(F.lit("更新于"), y, F.lit("年"), m, F.lit("月"), dd, F.lit("日"))).when(k == 2, F.concat(y, F.lit("/"), m, F.lit("/"), dd, F.lit(" end"))).otherwise(F.lit("no date"))
    return table(spark, d, "orders").select("o_orderkey", T.date_from_text(text).alias("found"), T.as_date(T.date_from_text(text)).alias("day"))


def status_norm(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("o_orderstatus") == "F", "Finished ").when(F.col("o_orderstatus") == "O", " 连载中").otherwise(F.lit(" "))
    return table(spark, d, "orders").select("o_orderkey", T.normalize_status(raw).alias("status"))


def url_fields(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    path = F.regexp_extract("url", r"^https?://[^/]*(.*)$", 1)
    return p.select("page_id", T.absolute_url(path, "https://example.org").alias("absolute"), T.id_from_url(F.col("url"), (r"/(\d{4})\?", r"/(\d+)$")).alias("found_id"), T.add_query_parameter(F.col("url"), "utm_source", "x").alias("tracked"), T.add_query_parameter(F.col("url"), "enter_from", "y").alias("marked"))


def char_map(spark: SparkSession, d: str) -> DataFrame:
    mapped = T.substitute(F.col("text"), "aeiouäöü", "43102AOU")
    return table(spark, d, "documents").select("doc_id", F.md5(mapped).alias("mapped_md5"))


def char_count(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("text", F.lit("，"), F.repeat(F.lit("字"), (F.col("doc_id") % 7).cast("int")))
    return table(spark, d, "documents").select("doc_id", T.cjk_count(text).alias("ideographs"))


def line_cleanup(spark: SparkSession, d: str) -> DataFrame:
    clean = T.clean_lines(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(clean).alias("clean_md5"), F.length(clean).cast("long").alias("chars"))


def first_n_turns(spark: SparkSession, d: str) -> DataFrame:
    return U.next_chunk(table(spark, d, "conversations"), "conv_id", ["turn"], 1, 4).select("conv_id", "turn", F.col("number").cast("long").alias("number"))


def merge_renumber(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role")
    out = U.merge_renumber(rows.filter("turn % 2 = 0"), rows.filter("turn % 2 = 1"), "conv_id", ["turn"], 5)
    return out.select("conv_id", "turn", "role", F.col("number").cast("long").alias("number"))


def work_list(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("novel_uid"), F.col("turn").alias("chapter_num"))
    stats = coverage.chapter_stats(rows, rows.select("novel_uid").distinct())
    return U.work_list(stats, stats, "novel_uid", "n_chapters", 5).withColumn("max_chapter", F.col("max_chapter").cast("long"))


def upsert_chapters(spark: SparkSession, d: str) -> DataFrame:
    """Turns as chapters: the even ones stored, then all, changed, upserted."""
    c = table(spark, d, "conversations")
    day = lambda x: F.lit(x).cast("date").alias("publish_date")
    of = lambda df, text, x: df.select(F.col("conv_id").alias("novel_uid"), F.col("turn").cast("int").alias("chapter_num"), F.col("role").alias("chapter_title"), text.alias("chapter_content"), F.lit("").alias("chapter_url"), F.lit(None).cast("int").alias("word_count"), day(x))
    start = spark.createDataFrame([], "chapter_id long, novel_uid long, chapter_num int, chapter_title string, chapter_content string, chapter_url string, word_count int, content_hash string, publish_date date")
    once = U.upsert_chapters(start, of(c.filter("turn % 2 = 0"), F.col("text"), "2026-01-01"))
    twice = U.upsert_chapters(once, of(c.filter("conv_id % 2 = 0"), F.concat("text", F.lit("!")), "2026-01-02"))
    return twice.select("novel_uid", "chapter_num", "word_count", "publish_date")


def signature_merge(spark: SparkSession, d: str) -> DataFrame:
    """Signatures of conversations from their first titles, filled where a stored one is absent."""
    c = table(spark, d, "conversations")
    opened = U.opening_titles(c.select("conv_id", F.col("turn").cast("int").alias("chapter_num"), F.col("role").alias("chapter_title"), F.lit(None).alias("publish_date"), F.lit("").alias("chapter_content")), ["conv_id"])
    new = opened.select("conv_id", F.to_json(F.struct(F.col("chapter_titles").alias("chapter_title_sig"))).alias("signature_json"))
    stored = c.select("conv_id").distinct().withColumn("signature_json", F.when(F.col("conv_id") % 3 == 0, F.lit('{"chapter_title_sig":["stored"]}')))
    return U.fill_signatures(stored, new, ["conv_id"])


def priority_match(spark: SparkSession, d: str) -> DataFrame:
    """Documents against the first half of the ids: by text, then by language, source and length."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", F.sha1("text").alias("text_hash"))
    middle = docs.agg(F.expr("percentile_disc(0.5) within group (order by doc_id)").alias("m")).first()["m"]
    stored = docs.filter(F.col("doc_id") < middle).withColumnRenamed("doc_id", "uid")
    return resolve.priority_match(docs.filter(F.col("doc_id") >= middle), stored, "doc_id", "uid", [["text_hash"], ["lang", "source", "n_chars"]])


def _match(spark: SparkSession, d: str, sequence: bool, cap: int | None = None) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "text", F.to_date(F.lit("2026-01-01")).alias("seen"))
    out = resolve.similarity_match(docs, docs, ["lang", "source"], "doc_id", "doc_id", "text", "seen", threshold=0.7, cap=cap, sequence=sequence)
    return out.withColumn("score", F.round("score", 6))


def similarity_match(spark: SparkSession, d: str) -> DataFrame:
    """Best match of each document within its language and source, by words and sequence."""
    return _match(spark, d, True)


def word_match(spark: SparkSession, d: str) -> DataFrame:
    return _match(spark, d, False)


def word_match_newest(spark: SparkSession, d: str) -> DataFrame:
    """Matches with the newest twenty documents of a block, as the data model's cap has it."""
    return _match(spark, d, False, cap=20)


def raw_dump_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Pages written as JSON by site and read back."""
    p = table(spark, d, "pages").withColumn("site", F.regexp_extract("url", r"^https?://([^/]*)", 1))
    folder = shared_folder(spark)
    p.write.partitionBy("site").json(folder)
    back = spark.read.schema("page_id long, url string, html string, site string").json(folder)
    return back.select("page_id", "site", F.md5("html").alias("html_md5"))


def page_text(spark: SparkSession, d: str) -> DataFrame:
    return pages.page_text(table(spark, d, "pages")).select("page_id", F.length("text").cast("long").alias("chars"), F.md5("text").alias("text_md5"))


def page_fields(spark: SparkSession, d: str) -> DataFrame:
    return pages.page_fields(table(spark, d, "pages"))


def page_quality(spark: SparkSession, d: str) -> DataFrame:
    return pages.page_quality(table(spark, d, "pages"))


def page_links(spark: SparkSession, d: str) -> DataFrame:
    return pages.page_links(table(spark, d, "pages"))


def page_items(spark: SparkSession, d: str) -> DataFrame:
    return pages.page_items(table(spark, d, "pages"))


def page_body(spark: SparkSession, d: str) -> DataFrame:
    return pages.page_body(table(spark, d, "pages"))


def page_category(spark: SparkSession, d: str) -> DataFrame:
    return pages.page_category(table(spark, d, "pages"), ("The", "and", "Nicht", "de", "la"))


def page_entries(spark: SparkSession, d: str) -> DataFrame:
    """Links of the menus as entries of list pages; the author of every third page stands in each entry."""
    author = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<i class="x author">A '), F.col("page_id"), F.lit("</i></li>"))).otherwise(F.lit("</li>"))
    p = table(spark, d, "pages").withColumn("html", F.replace("html", F.lit("</li>"), author))
    rows = pages.page_entries(p, (r"(?is)<ol(?:\s[^>]*)?>", r"(?is)<li(?:\s[^>]*)?>"), ("/",), base="https://base.example", id_patterns=(r"/([^/?#]+)$",), end="(?is)</ul>")
    return rows.select("page_id", "position", "rank", "title", "url", "id", "author", "status", "metric")


def page_detail(spark: SparkSession, d: str) -> DataFrame:
    """Fields of pages to which an author, two tags, a status, a number of words and a date have been added."""
    day = F.concat(F.lit("2026年1月"), F.col("page_id") % 28 + 1, F.lit("日"))
    extra = F.concat(F.lit('<b class="author">A '), F.col("page_id"), F.lit('</b><i class="info-label-yellow">'), F.when(F.col("page_id") % 2 == 0, "已完结").otherwise("连载中"),
        F.lit('</i><i class="info-label-grey">main</i><i class="info-label-grey">t'), F.col("page_id") % 5, F.lit("</i> 字数："), F.col("page_id") % 90 + 1, F.lit(".5万 发布日期："), day)
    p = table(spark, d, "pages").withColumn("html", F.replace(F.coalesce("html", F.lit("")), F.lit("</head><body>"), F.concat(F.lit("</head><body>"), extra)))
    rows = pages.page_detail(p, pages.DETAIL_FIELDS | {"intro": ("ad",)})
    return rows.withColumn("tags", F.array_join("tags", ","))


def _planted(spark: SparkSession, d: str, markup: object) -> DataFrame:
    return table(spark, d, "pages").withColumn("html", F.replace("html", F.lit("<body>"), F.concat(F.lit("<body>"), markup)))


def page_breadcrumb(spark: SparkSession, d: str) -> DataFrame:
    """The path of pages in which one has been put, with a box in a box; the pages' own links are outside of it."""
    path = F.concat(F.lit('<div class="x breadcrumb"><div><br><a href="/a">Top</a> &gt; <div><a href="/b/'), F.col("page_id"), F.lit('"><b>Shelf</b> '), F.col("page_id"), F.lit('</a></div></div><a href="/c">Here</a></div><a href="/d">Out</a>'))
    return pages.page_breadcrumb(_planted(spark, d, path), base="https://base.example")


def page_nested(spark: SparkSession, d: str) -> DataFrame:
    """Whole lists with lists inside: the visible text of each, in order."""
    lists = F.concat(F.lit('<ul class="o"><li>one<ul class="i"><li>two '), F.col("page_id"), F.lit("</li></ul><li>three</li></ul><ul class='o'></ul>"))
    stream = pages.tag_stream(_planted(spark, d, lists))
    found = pages.element_html(stream, pages.elements(stream, (F.col("tag") == "ul") & pages.has_class(["o", "i"])))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("first"))
    return found.select("page_id", place.alias("position"), pages.visible_text(F.col("html")).alias("text"))


def page_chapters(spark: SparkSession, d: str) -> DataFrame:
    """Links of the first list of five items or more as chapters."""
    return pages.page_chapters(table(spark, d, "pages"), r"(?is)<ul(?:\s[^>]*)?>", r"(?is)<li(?:\s[^>]*)?>", base="https://base.example", least=5)


def page_items_once(spark: SparkSession, d: str) -> DataFrame:
    """Items of all pages, each link once."""
    p = table(spark, d, "pages")
    items = pages.page_items(p).join(p.select("page_id", "url"), "page_id")
    return pages.first_across_pages(items).drop("url")


def chapter_items(spark: SparkSession, d: str) -> DataFrame:
    """Turns as chapters of items of which every third is stored: the items after them."""
    c = table(spark, d, "conversations")
    name = F.col("conv_id").cast("string")
    tables = U.empty_tables(spark)
    stored = c.filter("conv_id % 3 = 0").select("conv_id").distinct()
    blank = {k: F.lit("") for k in ("author", "author_norm", "intro", "intro_norm", "main_category", "status", "url", "signature_json")}
    day = F.lit("2026-01-01").cast("date")
    stored = stored.withColumns(blank | {"novel_uid": F.col("conv_id"), "platform": F.lit("alpha"), "platform_novel_id": name, "total_words": F.lit(0).cast("long"), "created_date": day, "last_seen_date": day})
    tables["novels"] = stored.select(*tables["novels"].columns)
    chapters = c.select(F.lit("alpha").alias("platform"), name.alias("platform_novel_id"), F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("talk "), name)).alias("title"), F.col("turn").cast("int").alias("chapter_num"), F.col("role").alias("chapter_title"),
        F.col("text").alias("chapter_content"), F.lit("").alias("chapter_url"), F.lit(None).cast("int").alias("word_count"), F.date_add(F.lit("2026-02-01"), F.col("turn").cast("int")).alias("publish_date"))
    out = U.save_chapters(tables, chapters)
    n = out["first_n_chapters"].groupBy("novel_uid").agg(F.count(F.lit(1)).alias("n_chapters"))
    rows = out["novels"].join(out["novel_titles"].select("novel_uid", "title", "is_primary"), "novel_uid", "left").join(n, "novel_uid", "left")
    return rows.select("platform_novel_id", "created_date", "title", "is_primary", "n_chapters")


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def _arriving(spark: SparkSession, d: str, parts: int = 4) -> list[DataFrame]:
    """Events in the parts that they arrive in, one after the other in time."""
    events = table(spark, d, "events")
    span = events.agg(F.min(F.to_date("ts")).alias("first"), (F.datediff(F.max("ts"), F.min("ts")) + 1).alias("days")).first()
    if span["days"] is None:
        return [events]
    part = F.floor(F.datediff("ts", F.lit(span["first"])) * parts / span["days"])
    return [events.filter(F.coalesce(part, F.lit(0)) == k) for k in range(parts)]


def _arrive(part: DataFrame, folder: str) -> None:
    """A part comes as files that many tasks write; a run of a stream takes all that are there as one batch."""
    part.write.mode("append").parquet(folder)


def stream_daily_panel(spark: SparkSession, d: str) -> DataFrame:
    """A daily panel with state, in a batch for each half, stopped in the middle and gone on with from its checkpoint: what its changes come to. Distinct users are exact."""
    source, kept, checkpoint = (shared_folder(spark) for _ in range(3))
    parts = _arriving(spark, d)
    for run in (parts[: len(parts) // 2], parts[len(parts) // 2 :]):
        for part in run:
            _arrive(part, source)
        if run:
            streams.keep_changes(streams.user_state(streams.read_events(spark, source, EVENTS)), kept, checkpoint)
    state = streams.latest(spark, kept, ["day", "event_type", "user_id"], "day date, event_type string, user_id long, n_events long, total double, n_values long")
    return streams.panel_of_users(state).withColumn("mean_value", F.round("mean_value", 6))


def stream_monthly_panel(spark: SparkSession, d: str) -> DataFrame:
    """The monthly panel merged from the daily states of a stream, without its events."""
    source, kept, checkpoint = (shared_folder(spark) for _ in range(3))
    for part in _arriving(spark, d, 2):
        _arrive(part, source)
        streams.keep_changes(streams.panel_state(streams.read_events(spark, source, EVENTS)), kept, checkpoint)
    state = streams.latest(spark, kept, ["day", "event_type"], "day date, event_type string, n_events long, total double, n_values long, users binary")
    return streams.merge_panels(state, "month").select(F.col("day").alias("month"), "event_type", "n_events", F.round("mean_value", 6).alias("mean_value"))


def stream_replays(spark: SparkSession, d: str) -> DataFrame:
    """Events of which every third comes once more with the next part: each once. A batch is compared with the events of the last days only. All files of a part are one
    batch, so parts are written and read by many tasks; the stream is stopped after each and gone on with."""
    source, kept, checkpoint = (shared_folder(spark) for _ in range(3))
    again = None
    for part in _arriving(spark, d):
        _arrive(part if again is None else part.unionByName(again), source)
        again = part.filter("event_id % 3 = 0").filter(F.col("ts") >= F.lit(part.agg(F.max("ts").cast("string")).first()[0]).cast("timestamp") - F.expr("interval 3 days"))
        stream = streams.read_events(spark, source, EVENTS).select("event_id", "ts", "user_id", "event_type")
        streams.dedupe_kept(stream, ["event_id"], kept, checkpoint, "event_id long, ts timestamp, user_id long, event_type string", "7 days")
    return spark.read.schema("event_id long, user_id long, event_type string").parquet(kept).select("event_id", "user_id", "event_type")


def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Per user and type the first event, by a stream whose batches write the keys that they change."""
    kept, schema = shared_folder(spark), "user_id long, event_type string, event_id long"
    first = streams.first_of(streams.read_events(spark, d, EVENTS, "events.parquet"), ["user_id", "event_type"], "event_id")
    streams.keep_changes(first, kept, shared_folder(spark))
    return streams.latest(spark, kept, ["user_id", "event_type"], schema)


def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The latest value of each user, in a batch for each half, stopped in the middle and gone on with."""
    source, kept, checkpoint = (shared_folder(spark) for _ in range(3))
    for part in _arriving(spark, d, 2):
        _arrive(part, source)
        streams.keep_changes(streams.last_of(streams.read_events(spark, source, EVENTS), ["user_id"], "event_id", "value"), kept, checkpoint)
    return streams.latest(spark, kept, ["user_id"], "user_id long, event_id long, value double")


def stream_late_days(spark: SparkSession, d: str) -> DataFrame:
    """The daily panel of a stream in which every fiftieth event comes last of all: those of the last 30 days count, and their days are computed anew, the others are in quarantine."""
    source, kept, checkpoint = (shared_folder(spark) for _ in range(3))
    late = F.coalesce(F.col("event_id") % 50 == 0, F.lit(False))
    for part in [*(p.filter(~late) for p in _arriving(spark, d)), table(spark, d, "events").filter(late)]:
        _arrive(part, source)
        streams.late_days(streams.read_events(spark, source, EVENTS), kept, checkpoint, EVENTS, 30)
    panel = spark.read.parquet(f"{kept}/panel").select("day", "event_type", "n_events", "n_users", F.round("mean_value", 6).alias("mean_value"), F.lit("panel").alias("side"))
    held = spark.read.schema(EVENTS).parquet(f"{kept}/quarantine")
    return panel.unionByName(streams.daily_panel(held, exact=True).select("day", "event_type", "n_events", "n_users", F.round("mean_value", 6).alias("mean_value"), F.lit("quarantine").alias("side")))


def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Events as list entries of their users, saved batch by batch: the items after the last batch."""
    day = F.to_date("ts")
    items = streams.read_events(spark, d, EVENTS, "events.parquet").select(
        F.lit("alpha").alias("platform"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("platform_novel_id"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("title"),
        F.lit("").alias("author"), F.lit("").alias("intro"), F.lit("").alias("main_category"), F.array("event_type").alias("tags"), F.lit("").alias("status"), F.lit(0).alias("total_words"), F.lit("").alias("url"),
        (F.col("event_id") % 1000).alias("rank"), F.col("value").alias("total_recommend"), F.lit(None).cast("long").alias("reading_count"), F.col("event_type").alias("rank_family"), F.lit("").alias("rank_sub_cat"), F.lit("").alias("source_url"), day.alias("snapshot_date"),
    )
    out = streams.ingest(items, shared_folder(spark), shared_folder(spark))
    n = out["rank_entries"].groupBy("novel_uid").agg(F.count(F.lit(1)).alias("n_entries"))
    return out["novels"].join(n, "novel_uid").select("platform_novel_id", "created_date", "last_seen_date", "n_entries")


def late_recompute(spark: SparkSession, d: str) -> DataFrame:
    """The daily panel of the events of the last 30 days and before, after late ones: only the days that these touch are computed anew."""
    events = table(spark, d, "events")
    late = events.filter("event_id % 50 = 0")
    rows = events.filter("event_id % 50 <> 0 or event_id is null")
    out = streams.recompute_days(streams.daily_panel(rows, exact=True), rows, late)
    return out.withColumn("mean_value", F.round("mean_value", 6))


def late_split(spark: SparkSession, d: str) -> DataFrame:
    """Events of the last 30 days, and those for quarantine, by type."""
    events = table(spark, d, "events")
    last = events.agg(F.max("ts").cast("string")).first()[0]
    good, late = streams.split_late(events, last, 30)
    count = lambda df, side: df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(side))
    return count(good, "kept").unionByName(count(late, "quarantine"))


QUERIES = {f.__name__: f for f in (
    text_normalize, tokenize_jaccard, content_hash, cn_number, labelled_number, date_from_text, status_norm, url_fields, char_map, char_count, line_cleanup,
    first_n_turns, merge_renumber, work_list, upsert_chapters, signature_merge, priority_match, similarity_match, word_match, word_match_newest, raw_dump_roundtrip,
    page_text, page_fields, page_quality, page_links, page_items, page_items_once, page_entries, page_detail, page_breadcrumb, page_nested, page_chapters, chapter_items, page_body, page_category, stream_ingest, late_recompute, stream_daily_panel, stream_monthly_panel, stream_dedupe, stream_replays, stream_upsert, stream_late_days, late_split,
)}

"""Typed rows from stored web pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankpulse.functions import text as T

# Entities that a visible text is freed of, ampersand last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
# Words of a visible text and of a title that mark a blocked page.
BLOCK_WORDS = ("captcha", "验证码", "access denied", "人机验证")
BAD_TITLES = ("404", "403", "forbidden", "not found")
LEAST_LENGTH = 800
LEAST_TEXT = 50


def visible_text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags, entities resolved, white space collapsed."""
    s = F.coalesce(html, F.lit(""))
    for pattern in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>"):
        s = F.regexp_replace(s, pattern, " ")
    for entity, char in ENTITIES:
        s = F.replace(s, F.lit(entity), F.lit(char))
    return T.collapse_blanks(s)


def element(html: Column, tag: str) -> Column:
    """Visible text of the first element of this name, empty without one."""
    return visible_text(F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1))


def meta(html: Column, name: str) -> Column:
    """Content of a meta tag by property or name."""
    return F.regexp_extract(html, rf"(?is)<meta\s+(?:property|name)=[\"']{name}[\"']\s+content=[\"'](.*?)[\"']", 1)


def page_text(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", visible_text(F.col("html")).alias("text"))


def page_fields(pages: DataFrame) -> DataFrame:
    """Title (meta tag, then the title up to ` - `, then the first heading), language, description and character counts."""
    html = F.coalesce("html", F.lit(""))
    title = element(html, "title")
    short = F.get(F.split(title, " - "), F.lit(0))
    blank = lambda c: F.when(c != "", c)
    return pages.select(
        "page_id",
        F.coalesce(blank(meta(html, "og:title")), blank(short), blank(element(html, "h1")), F.lit("")).alias("title"),
        F.regexp_extract(html, r"(?is)<html[^>]*\slang=[\"']([^\"']*)[\"']", 1).alias("lang"),
        meta(html, "description").alias("description"),
        F.length(html).cast("long").alias("html_chars"),
    )


def page_quality(pages: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """Whether a page is a real one, and if not, the first reason: too short, a block word, a bad title, a refresh, or little text."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", html.alias("_h"), F.lower(visible_text(F.col("html"))).alias("_t"), F.lower(element(html, "title")).alias("_title"))
    has = lambda c, words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w))
    reason = (
        F.when(F.length("_h") < least, "too_short")
        .when(has(F.col("_t"), BLOCK_WORDS), "keyword")
        .when(has(F.col("_title"), BAD_TITLES), "bad_title")
        .when(F.col("_h").rlike(r"(?i)http-equiv=[\"']refresh"), "refresh")
        .when(F.length("_t") < LEAST_TEXT, "little_text")
        .otherwise("ok")
    )
    return rows.select("page_id", reason.alias("reason"), (reason == "ok").alias("good"))


def page_links(pages: DataFrame) -> DataFrame:
    """Links of a page in order: position, address and text; of an address that repeats the first."""
    html = F.coalesce("html", F.lit(""))
    pattern = r"(?is)<a\s[^>]*?href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
    both = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("label"))
    rows = pages.select("page_id", F.posexplode(both).alias("_i", "_l"))
    first = Window.partitionBy("page_id", "href").orderBy("_i")
    rows = rows.select("page_id", "_i", F.col("_l.href").alias("href"), visible_text(F.col("_l.label")).alias("label"))
    rows = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    place = Window.partitionBy("page_id").orderBy("_i")
    return rows.select("page_id", F.row_number().over(place).alias("position"), "href", "label")


def page_items(pages: DataFrame, selectors: Sequence[str] = ("li", "p"), least: int = 3, per_page: int = 20) -> DataFrame:
    """Items of a list page, by the first selector that finds at least `least`: page number from the URL, position on the page, rank over pages,
    text and link."""
    html = F.coalesce("html", F.lit(""))
    found = F.lit(None).cast("array<string>")
    for tag in reversed(selectors):
        items = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))
        found = F.when(F.size(items) >= least, items).otherwise(found)
    number = F.coalesce(F.regexp_extract(F.col("url"), r"[?&]page=(\d+)", 1).try_cast("int"), F.lit(1))
    rows = pages.select("page_id", "url", number.alias("page_no"), found.alias("_f")).select("page_id", "url", "page_no", F.posexplode("_f").alias("_i", "_item"))
    link = F.regexp_extract("_item", r"(?is)href=[\"']([^\"']*)[\"']", 1)
    return rows.select("page_id", (F.col("_i") + 1).alias("position"), ((F.col("page_no") - 1) * per_page + F.col("_i") + 1).alias("rank"), visible_text(F.col("_item")).alias("title"), link.alias("href"))


def first_across_pages(items: DataFrame, key: str = "href", url: str = "url", order: Sequence[str] = ("rank", "page_id")) -> DataFrame:
    """Items of several pages, each once: of those with the same key, or without one the same URL, the first in this order."""
    same = F.coalesce(F.nullif(F.col(key), F.lit("")), F.col(url), F.lit(""))
    once = Window.partitionBy("_same").orderBy(*order)
    return items.withColumn("_same", same).withColumn("_n", F.row_number().over(once)).filter("_n = 1").drop("_same", "_n")


def page_body(pages: DataFrame, least: int = 10) -> DataFrame:
    """The paragraphs of a page with more than `least` characters, a blank line between them."""
    html = F.coalesce("html", F.lit(""))
    for tag in ("script", "style"):
        html = F.regexp_replace(html, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    parts = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1)), visible_text)
    return pages.select("page_id", F.array_join(F.filter(parts, lambda x: F.length(x) > least), "\n\n").alias("body"))


def page_category(pages: DataFrame, words: Sequence[str]) -> DataFrame:
    """The first of the given category names among a page's link texts, in the given order."""
    html = F.coalesce("html", F.lit(""))
    labels = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*>(.*?)</a>"), F.lit(1)), visible_text)
    return pages.select("page_id", F.try_element_at(F.array_intersect(F.array(*map(F.lit, words)), labels), F.lit(1)).alias("category"))


# Class names and texts by which list pages, detail pages and catalogues mark their parts.
ITEM_CLASSES = ("rank-book-item", "book-item", "book-list-item", "rank-item")
ITEM_LINKS = ("/page/", "/book/")
ITEM_FIELDS = {
    "author": ("author-name", "author", "writer"),
    "intro": ("desc", "intro", "description", "book-desc"),
    "category": ("category", "book-category"),
    "status": ("book-item-footer-status", "status", "state", "book-status"),
    "metric": ("book-item-count", "read-count", "count", "reading-count", "hot-num", "popularity"),
}
METRIC_WORDS = ("在读", "阅读")
DETAIL_METAS = {"title": "og:title", "author": "og:novel:author", "intro": "og:description"}
DETAIL_FIELDS = {
    "title": ("book-title",),
    "author": ("author-name", "author-name-text", "author"),
    "intro": ("intro", "description", "book-intro", "content", "book-desc", "desc"),
    "status": ("book-state", "status", "state", "book-status"),
}
TAG_CLASS, STATUS_CLASS, LABEL_CLASS, WORDS_CLASS = "info-label-grey", "info-label-yellow", "info-label", "info-count-word"
DATE_METAS = ("article:published_time", "publish_date", "date", "datePublished")
DATE_WORDS = ("发布日期", "更新时间", "发表时间", "首发时间", "上架时间")
NOTE_WORDS = ("作品相关",)
VOLUME_CLASS, CHAPTER_CLASS = "catalog-volume", "chapter-item"
UNKNOWN_AUTHOR = "未知"
LONGEST_TAG = 20


def opening(names: Sequence[str] | str, tag: str = r"\w+") -> str:
    """Pattern of an opening tag that has one of these classes."""
    names = [names] if isinstance(names, str) else names
    return rf"""(?is)<({tag})\s(?:[^>]*\s)?class=["'](?:[^"']*\s)?(?:{"|".join(names)})(?:\s[^"']*)?["'][^>]*>"""


def classed(html: Column, names: Sequence[str] | str) -> Column:
    """Visible text of the first element that has one of these classes, empty without one."""
    return visible_text(F.regexp_extract(html, opening(names) + r"(.*?)</\1>", 2))


def all_classed(html: Column, names: Sequence[str] | str) -> Column:
    """Visible texts of all elements that have one of these classes, in order."""
    return F.transform(F.regexp_extract_all(html, F.lit(opening(names) + r"(.*?)</\1>"), F.lit(2)), visible_text)


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def _status(text: Column) -> Column:
    """Finished or running, as a text says; else missing."""
    status = T.normalize_status(text)
    return F.when((text != "") & status.isin(T.DONE, T.RUNNING), status)


def page_entries(
    pages: DataFrame,
    openings: Sequence[str] = tuple(opening(c) for c in ITEM_CLASSES),
    links: Sequence[str] = ITEM_LINKS,
    fields: dict[str, Sequence[str]] = ITEM_FIELDS,
    base: str = "",
    id_patterns: Sequence[str] | None = None,
    end: str = r"(?is)<footer|</body",
    least: int = 3,
    per_page: int = 30,
) -> DataFrame:
    """Entries of list pages: a row an item with page_id, position, rank over pages, title, url, id, author, intro, category, tags, status, metric.

    The first pattern of an opening tag that finds `least` items or more is taken. An item runs to the next one's opening or to where the list ends; it needs a link
    whose address has one of `links`, and an id in it. Missing authors are unknown, missing states running, missing figures 0. The figure stands in an element of its own,
    else after its word anywhere in the item. Null pages have no rows.
    """
    html = F.get(F.split(F.coalesce("html", F.lit("")), end), F.lit(0))
    link = rf"""(?is)<a\s[^>]*?href=["']([^"']*(?:{"|".join(links)})[^"']*)["'][^>]*>(.*?)</a>"""
    number = rf"(?:{'|'.join(METRIC_WORDS)})[:：]?\s*([\d,.]+\s*[万亿]?)"

    def entry(item: Column, i: Column) -> Column:
        url = T.absolute_url(F.regexp_extract(item, link, 1), base)
        found = {name: classed(item, names) for name, names in fields.items()}
        own = found.get("metric", F.lit(""))
        loose = F.regexp_extract(visible_text(item), number, 1)
        category = found.get("category", F.lit(""))
        return F.struct(
            (i + 1).alias("position"),
            visible_text(F.regexp_extract(item, link, 2)).alias("title"),
            url.alias("url"),
            (T.id_from_url(url) if id_patterns is None else T.id_from_url(url, id_patterns)).alias("id"),
            F.coalesce(_filled(found.get("author", F.lit(""))), F.lit(UNKNOWN_AUTHOR)).alias("author"),
            found.get("intro", F.lit("")).alias("intro"),
            category.alias("category"),
            T.ordered_union(all_classed(item, TAG_CLASS), without=category).alias("tags"),
            F.coalesce(_status(found.get("status", F.lit(""))), F.lit(T.RUNNING)).alias("status"),
            F.coalesce(F.when(own != "", T.metric_number(own, METRIC_WORDS)).otherwise(T.unit_number(_filled(loose))), F.lit(0)).cast("long").alias("metric"),
        )

    def items(pattern: str) -> Column:
        parts = F.split(html, pattern)
        return F.filter(F.transform(F.slice(parts, F.lit(2), F.size(parts)), entry), lambda e: (e["url"] != "") & (e["id"] != ""))

    chosen = F.get(F.filter(F.array(*map(items, openings)), lambda x: F.size(x) >= least), F.lit(0))
    number_of_page = F.coalesce(F.regexp_extract("url", r"[?&]page=(\d+)", 1).try_cast("int"), F.lit(1))
    rows = pages.filter("html is not null").select("page_id", number_of_page.alias("_page"), F.explode(chosen).alias("_e"))
    return rows.select("page_id", ((F.col("_page") - 1) * per_page + F.col("_e.position")).alias("rank"), "_e.*")


def published(html: Column) -> Column:
    """Date of publication: of a meta tag, else after a word that announces it, else the first date of the visible text."""
    text = visible_text(html)
    names = "|".join(DATE_METAS)
    tagged = F.regexp_extract(html, rf"""(?is)<meta\s+(?:property|name|itemprop)=["'](?:{names})["']\s+content=["'](.*?)["']""", 1)
    announced = [T.date_from_text(F.regexp_extract(text, word + r"[:：]\s*(\S+)", 1)) for word in DATE_WORDS]
    return F.coalesce(T.date_from_text(tagged), *announced, T.date_from_text(F.regexp_extract(text, r"\d{4}[年./-]\d{1,2}[月./-]\d{1,2}日?", 0)))


def page_detail(pages: DataFrame, fields: dict[str, Sequence[str]] = DETAIL_FIELDS) -> DataFrame:
    """Fields of detail pages: title, author, intro (meta tag first, then body), category, tags, status, words, publish_date.

    The first tag is the category; tags of LONGEST_TAG characters or more are none. Missing texts are empty, missing status, words and date null.
    """
    html = F.coalesce("html", F.lit(""))
    texts = {name: F.coalesce(_filled(meta(html, tag)), _filled(element(html, "h1")) if name == "title" else F.lit(None), classed(html, fields[name])) for name, tag in DETAIL_METAS.items()}
    box = F.regexp_extract(html, r"(?is)<(\w+)\s(?:[^>]*\s)?class=[\"']" + LABEL_CLASS + r"[\"'][^>]*>(.*?)</\1>", 2)
    spans = F.transform(F.regexp_extract_all(F.regexp_replace(box, opening(STATUS_CLASS) + r".*?</\1>", ""), F.lit(r"(?is)<span[^>]*>(.*?)</span>"), F.lit(1)), visible_text)
    grey = all_classed(html, TAG_CLASS)
    tags = F.array_distinct(F.filter(F.when(F.size(grey) > 0, grey).otherwise(spans), lambda t: (t != "") & (F.length(t) < LONGEST_TAG)))
    said = F.regexp_extract(visible_text(html), r"字数[：:]\s*([0-9.]+[万亿]?)", 1)
    words = F.coalesce(T.unit_number(_filled(classed(html, WORDS_CLASS))), T.unit_number(_filled(said)))
    rows = pages.select("page_id", *[c.alias(name) for name, c in texts.items()], tags.alias("_tags"), F.coalesce(_status(classed(html, STATUS_CLASS)), _status(classed(html, fields["status"]))).alias("status"),
        F.when(words > 0, words).alias("words"), published(html).alias("publish_date"))
    category = F.coalesce(F.get("_tags", F.lit(0)), F.lit(""))
    return rows.select("page_id", *texts, category.alias("category"), F.slice("_tags", F.lit(2), F.size("_tags")).alias("tags"), "status", "words", "publish_date")


def page_chapters(pages: DataFrame, volume: str = opening(VOLUME_CLASS), item: str = opening(CHAPTER_CLASS), name: str = "h3", base: str = "", least: int = 10) -> DataFrame:
    """Chapters of catalogue pages, from the first volume that has `least` items and isn't named as notes: position, address and title; of an address the first.

    Volumes and items run from their opening tags to the next ones'. A page without such a volume has no rows.
    """

    def parts(html: Column, pattern: str) -> Column:
        found = F.split(html, pattern)
        return F.slice(found, F.lit(2), F.size(found))

    notes = lambda v: F.exists(F.array(*map(F.lit, NOTE_WORDS)), lambda w: F.contains(element(v, name), w))
    volumes = F.transform(F.filter(parts(F.coalesce("html", F.lit("")), volume), lambda v: ~notes(v)), lambda v: parts(v, item))
    chosen = F.get(F.filter(volumes, lambda x: F.size(x) >= least), F.lit(0))
    rows = pages.withColumn("_row", F.monotonically_increasing_id()).select("page_id", "_row", F.posexplode(chosen).alias("_i", "_item"))
    url = T.absolute_url(F.regexp_extract("_item", r"(?is)<a\s[^>]*?href=[\"']([^\"']*)[\"']", 1), base)
    rows = rows.select("page_id", "_row", "_i", url.alias("url"), element(F.col("_item"), "a").alias("title")).filter("url <> ''")
    rows = rows.groupBy("page_id", "_row", "url").agg(F.min_by(F.struct("_i", "title"), "_i").alias("_f"))
    place = Window.partitionBy("_row").orderBy("_f._i")
    return rows.select("page_id", F.row_number().over(place).alias("position"), "url", F.col("_f.title").alias("title"))


# Elements without an end, and classes of the path that leads to a page.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
PATH_CLASSES = ("breadcrumb", "breadcrumbs", "crumbs", "crumb-nav")
_TAG = r"(?s)<!--.*?-->|<[!?/a-zA-Z][^>]*>"


def tag_stream(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """The tags of pages in order: key, _row (a number of the page), at, tag (its name), ends (whether it is an end tag), markup, after (the characters up to the next
    tag) and level, how many elements of its name are open with it.

    An element's level is that of its end tag, so it is whole with elements of its own name inside; other elements that are never ended don't matter. Comments, elements
    without an end and what a script or style holds are no tags. Null pages have no rows.
    """
    html = F.regexp_replace(F.col("html"), r"(?is)(<(script|style)(?:\s[^>]*)?>).*?(</\2\s*>)", "$1$3")
    pieces = F.split("_html", _TAG)
    both = F.arrays_zip(F.regexp_extract_all("_html", F.lit(_TAG), F.lit(0)).alias("markup"), F.slice(pieces, F.lit(2), F.size(pieces)).alias("after"))
    rows = pages.filter("html is not null").select(key, F.monotonically_increasing_id().alias("_row"), html.alias("_html")).select(key, "_row", F.posexplode(both).alias("at", "_t"))
    rows = rows.select(key, "_row", "at", F.lower(F.regexp_extract("_t.markup", r"^</?([a-zA-Z][\w:-]*)", 1)).alias("tag"), F.startswith(F.col("_t.markup"), F.lit("</")).alias("ends"), F.col("_t.markup").alias("markup"), F.coalesce("_t.after", F.lit("")).alias("after"))
    open_ = F.when((F.col("tag") == "") | F.col("tag").isin(*VOID) | F.endswith(F.col("markup"), F.lit("/>")), 0).when(F.col("ends"), -1).otherwise(1)
    rows = rows.withColumn("_open", open_)
    so_far = F.sum("_open").over(Window.partitionBy("_row", "tag").orderBy("at"))
    return rows.withColumn("level", F.when(F.col("_open") == 0, None).otherwise(so_far + F.when(F.col("_open") < 0, 1).otherwise(0))).drop("_open")


def elements(stream: DataFrame, wanted: Column, key: str = "page_id") -> DataFrame:
    """Whole elements of a tag stream: key, _row, first and last (places of their tags; one that isn't ended goes to the end of its page), tag and markup. wanted is a condition on its columns."""
    ended = F.min(F.when(F.col("ends"), F.col("at"))).over(Window.partitionBy("_row", "tag", "level").orderBy("at").rowsBetween(1, Window.unboundedFollowing))
    found = stream.filter("level is not null").withColumn("last", F.coalesce(ended, F.lit((1 << 31) - 1)))
    return found.filter(~F.col("ends") & wanted).select(key, "_row", F.col("at").alias("first"), "last", "tag", "markup")


def inside(stream: DataFrame, found: DataFrame) -> DataFrame:
    """The tags inside of each of these elements, and its own: the stream's columns with first, the element's place."""
    return stream.join(found.select(F.col("_row").alias("_page"), "first", "last"), (F.col("_row") == F.col("_page")) & F.col("at").between(F.col("first"), F.col("last") - 1)).drop("_page", "last")


def element_html(stream: DataFrame, found: DataFrame, key: str = "page_id") -> DataFrame:
    """The elements with html, all that is between their tags."""
    part = F.struct("at", F.when(F.col("at") == F.col("first"), F.col("after")).otherwise(F.concat("markup", "after")).alias("s"))
    held = inside(stream, found).groupBy("_row", "first").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["s"]), "").alias("html"))
    return found.join(held, ["_row", "first"]).select(key, "_row", "first", "tag", "markup", "html")


def has_class(names: Sequence[str]) -> Column:
    """Whether a tag's markup has one of these classes."""
    return F.col("markup").rlike(rf"""(?is)\sclass=["'](?:[^"']*\s)?(?:{"|".join(names)})(?:\s[^"']*)?["']""")


def page_breadcrumb(pages: DataFrame, classes: Sequence[str] = PATH_CLASSES, base: str = "", key: str = "page_id") -> DataFrame:
    """The path that leads to a page: position, address and text of the links inside the first element of these classes, however deep they are. A page without one has no rows."""
    stream = tag_stream(pages, key)
    path = first_of_page(elements(stream, has_class(classes), key))
    links = element_html(stream, elements(inside(stream, path).drop("first"), F.col("tag") == "a", key), key)
    url = T.absolute_url(F.regexp_extract("markup", r"(?is)\shref=[\"']([^\"']*)[\"']", 1), base)
    place = Window.partitionBy("_row").orderBy("first")
    return links.select(key, F.row_number().over(place).alias("position"), url.alias("url"), visible_text(F.col("html")).alias("label"))


def first_of_page(found: DataFrame) -> DataFrame:
    """The first of a page's elements."""
    return found.withColumn("_n", F.row_number().over(Window.partitionBy("_row").orderBy("first"))).filter("_n = 1").drop("_n")

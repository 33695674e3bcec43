"""Text, number, date and URL expressions: each takes columns and returns a column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Not a letter, digit or underscore; white space of any script.
SEPARATORS = r"[^\p{L}\p{N}_]+"
BLANKS = r"(?U)\s+"
#: The characters of BLANKS.
BLANK_CHARACTERS = "".join(map(chr, (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

# Factors of number units.
UNITS = (("亿", 100_000_000), ("万", 10_000))
# Words that tell a finished from a running work.
DONE_WORDS = ("完本", "完结", "已完", "finished", "completed", "end")
RUNNING_WORDS = ("连载", "更新", "ongoing", "serial")
DONE, RUNNING = "完本", "连载"


def strip(s: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.btrim(s, F.lit(BLANK_CHARACTERS))


def normalize_text(s: Column) -> Column:
    """Lower case, everything but letters, digits and underscores as one space; missing is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), SEPARATORS, " "))


def collapse_blanks(s: Column) -> Column:
    """White space as single spaces, none at the ends; missing is empty."""
    return F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), BLANKS, " "))


def tokenize(s: Column) -> Column:
    """Array of the words of the normalised text."""
    return F.filter(F.split(normalize_text(s), " "), lambda t: t != "")


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets: 1 if both are empty, 0 if one is."""
    both, any_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(any_ == 0, F.lit(1.0)).otherwise(F.coalesce(both / F.nullif(any_, F.lit(0)), F.lit(0.0)))


def safe_int(s: Column, default: int | None = 0) -> Column:
    """A whole number, or the default where there is none."""
    return F.coalesce(s.try_cast("long"), F.lit(default).cast("long"))


def sha1_hex(s: Column) -> Column:
    return F.sha1(F.coalesce(s, F.lit("")).cast("binary"))


def content_hash(title: Column, content: Column) -> Column:
    """Hash of a chapter: its normalised title and the first 4000 characters of its text, normalised."""
    return sha1_hex(F.concat(normalize_text(title), F.lit("\n"), normalize_text(F.substring(F.coalesce(content, F.lit("")), 1, 4000))))


def normalize_status(s: Column) -> Column:
    """Finished, running, or the trimmed text itself; missing counts as running."""
    value = F.lower(strip(F.coalesce(s, F.lit(""))))
    out = F.when(value == "", F.lit(RUNNING)).otherwise(strip(s))
    for words, status in ((RUNNING_WORDS, RUNNING), (DONE_WORDS, DONE)):
        for w in reversed(words):
            out = F.when(F.contains(value, F.lit(w)), F.lit(status)).otherwise(out)
    return out


def as_date(s: Column) -> Column:
    """The date of an ISO text, of its first ten characters; anything else is missing."""
    return F.try_to_date(F.substring(s.cast("string"), 1, 10), "yyyy-MM-dd")


def unit_number(s: Column) -> Column:
    """A number with thousands separators and a unit, as an integer; fractions are cut."""
    text = F.regexp_replace(collapse_blanks(s), ",", "")
    number = F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    unit = F.regexp_extract(text, r"\d\s*([亿万])", 1)
    factor = F.lit(1.0)
    for name, value in reversed(UNITS):
        factor = F.when(unit == name, F.lit(float(value))).otherwise(factor)
    return (number * factor).cast("long")


def labelled_number(s: Column, label: str) -> Column:
    """The number after a label, else the one before it."""
    number = r"([\d,]+(?:\.\d+)?\s*[亿万]?)"
    after = F.regexp_extract(s, label + r"\s*[:：]?\s*" + number, 1)
    before = F.regexp_extract(s, number + r"\s*字?\s*" + label, 1)
    return F.coalesce(unit_number(F.when(after != "", after)), unit_number(F.when(before != "", before)))


def metric_number(s: Column, labels: Sequence[str]) -> Column:
    """A unit number among label words."""
    return unit_number(F.regexp_replace(s, "|".join(labels), " "))


def date_from_text(s: Column) -> Column:
    """The first date written with hyphens, else with the signs for year, month and day, else with dots or slashes; zero-padded."""
    out = F.lit(None).cast("string")
    for pattern in (r"(\d{4})[./](\d{1,2})[./](\d{1,2})", r"(\d{4})年(\d{1,2})月(\d{1,2})日", r"(\d{4})-(\d{1,2})-(\d{1,2})"):
        y, m, d = (F.regexp_extract(s, pattern, i) for i in (1, 2, 3))
        out = F.when(y != "", F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))).otherwise(out)
    return out


def absolute_url(url: Column, base: str) -> Column:
    """A URL made absolute against a base address."""
    value = strip(F.coalesce(url, F.lit("")))
    return (
        F.when(value == "", F.lit(""))
        .when(F.startswith(value, F.lit("http://")) | F.startswith(value, F.lit("https://")), value)
        .when(F.startswith(value, F.lit("//")), F.concat(F.lit("https:"), value))
        .when(F.startswith(value, F.lit("/")), F.concat(F.lit(base), value))
        .otherwise(F.concat(F.lit(base + "/"), value))
    )


def id_from_url(url: Column, patterns: Sequence[str] = (r"/page/(\d+)", r"/book/(\d+)", r"[?&]id=(\d+)")) -> Column:
    """The first pattern's group that matches, else the last part of the path with six digits or more."""
    value = F.coalesce(url, F.lit(""))
    path = F.split(F.regexp_extract(value, r"^(?:https?://[^/?#]*)?([^?#]*)", 1), "/")
    out = F.coalesce(F.try_element_at(F.filter(path, lambda p: p.rlike(r"^\d{6,}$")), F.lit(-1)), F.lit(""))
    for pattern in reversed(patterns):
        found = F.regexp_extract(value, pattern, 1)
        out = F.when(found != "", found).otherwise(out)
    return out


def add_query_parameter(url: Column, name: str, value: str) -> Column:
    """The URL with a parameter, unless it has it."""
    sign = F.when(F.contains(url, F.lit("?")), "&").otherwise("?")
    return F.when(F.contains(url, F.lit(name + "=")), url).otherwise(F.concat(url, sign, F.lit(f"{name}={value}")))


def split_tags(tags: Column, sub_category: Column | None = None) -> Column:
    """Tags of one text, trimmed, blanks dropped; a sub-category is added."""
    parts = F.split(F.coalesce(tags, F.lit("")), r"[,|/；;、\s]+")
    if sub_category is not None:
        parts = F.concat(parts, F.array(F.coalesce(sub_category, F.lit(""))))
    return F.filter(F.transform(parts, strip), lambda t: t != "")


def ordered_union(*arrays: Column, without: Column | None = None) -> Column:
    """Elements of the arrays in order, each once, without one value."""
    joined = F.array_distinct(F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays]))
    return joined if without is None else F.filter(joined, lambda t: ~t.eqNullSafe(without))


def substitute(s: Column, source: str, target: str) -> Column:
    """Characters replaced by a caller's table."""
    return F.translate(s, source, target)


def cjk_count(s: Column) -> Column:
    """Number of ideographs and their punctuation."""
    return F.length(F.regexp_replace(F.coalesce(s, F.lit("")), "[^\\u4e00-\\u9fff\\u3000-\\u303f\\uff00-\\uffef]", "")).cast("long")


def clean_lines(s: Column) -> Column:
    """Lines trimmed, blank ones dropped, an empty line between them."""
    lines = F.transform(F.split(F.coalesce(s, F.lit("")), "\n"), strip)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n\n")


def word_count(given: Column, content: Column) -> Column:
    """A given count, else the length of the content."""
    return F.coalesce(given.try_cast("long"), F.length(F.coalesce(content, F.lit(""))).cast("long"))


def days_span(first: Column, last: Column) -> Column:
    return (F.datediff(last, first) + 1).cast("long")


def link_fields(title: Column) -> Column:
    """Struct of name, first date and word count from a chapter link's title attribute."""
    name = F.regexp_extract(title, r"^(.*?)\s*(?:首发时间|发布于|$)", 1)
    return F.struct(strip(name).alias("name"), date_from_text(title).alias("first_post"), labelled_number(title, "字数").alias("words"))


def title_signature(titles: Column, k: int = 5) -> Column:
    """The first titles of an item's chapters, normalised, blanks dropped."""
    return F.filter(F.transform(F.slice(titles, 1, k), normalize_text), lambda t: t != "")


def ratio(x: Column, y: Column) -> Column:
    """x / y, missing where y is 0 or missing."""
    return x / F.nullif(y, F.lit(0).cast("double"))

"""Upserts: a table and incoming rows give the next version of the table. Nothing is changed in place."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankpulse.functions import text as T
from rankpulse.operators.resolve import KEYS, best_matches, follow
from rankpulse.schema import SCHEMAS, Tables

SIGNATURE = "struct<intro_sha1:string,chapter_title_sig:array<string>>"


def merge_signatures(old: Column, new: Column) -> Column:
    """A stored signature with the parts that it hasn't got from another; both are JSON texts, and what can't be read as such has no parts."""
    a, b = F.from_json(old, SIGNATURE), F.from_json(new, SIGNATURE)
    intro = F.coalesce(F.nullif(a.intro_sha1, F.lit("")), F.nullif(b.intro_sha1, F.lit("")))
    titles = F.coalesce(*[F.when(F.size(x.chapter_title_sig) > 0, x.chapter_title_sig) for x in (a, b)])
    return F.to_json(F.struct(intro.alias("intro_sha1"), titles.alias("chapter_title_sig")))


#: What becomes of a column when a key exists: the old and the new value.
RULES = {
    "overwrite": lambda old, new: new,
    "keep": lambda old, new: old,
    "if_given": lambda old, new: F.when(F.coalesce(new, F.lit("")) != "", new).otherwise(old),
    "if_positive": lambda old, new: F.when(F.coalesce(new, F.lit(0)) > 0, new).otherwise(old),
    "fill": lambda old, new: F.coalesce(old, new),
    "signature": merge_signatures,
    "min": lambda old, new: F.least(old, new),
    "max": lambda old, new: F.greatest(old, new),
}

NOVEL_RULES = {"platform_novel_id": "overwrite", "author": "overwrite", "author_norm": "overwrite", "intro": "overwrite", "intro_norm": "overwrite", "status": "overwrite", "main_category": "if_given", "url": "if_given", "total_words": "if_positive", "signature_json": "signature", "created_date": "keep", "last_seen_date": "overwrite"}
TITLE_RULES = {"title": "keep", "first_seen_date": "min", "last_seen_date": "max", "is_primary": "keep"}
LIST_RULES = {"source_url": "if_given"}
SNAPSHOT_RULES = {"item_count": "overwrite"}
TAG_RULES = {"tag_name": "overwrite"}
ENTRY_RULES = {"rank": "overwrite", "total_recommend": "overwrite", "reading_count": "overwrite", "extra_json": "overwrite"}
CHAPTER_RULES = {c: "overwrite" for c in ("chapter_title", "chapter_content", "chapter_url", "word_count", "content_hash", "publish_date")}


def newest(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """One row a key: the first in this order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], rules: Mapping[str, str]) -> DataFrame:
    """The next version: incoming rows (one a key) are merged by each column's rule, or added. Columns without a rule keep their old
    value. Missing columns of incoming are null. One full outer join."""
    new = incoming.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_new_{c}") for c in existing.columns if c in incoming.columns and c not in keys], F.lit(True).alias("_new"))
    old = existing.withColumn("_old", F.lit(True))
    both = old.join(new, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "full_outer")
    out = []
    for c in existing.columns:
        if c in keys:
            out.append(F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_k_{c}")).alias(c))
            continue
        given = F.col(f"_new_{c}") if c in incoming.columns else F.lit(None).cast(existing.schema[c].dataType)
        merged = RULES[rules.get(c, "keep")](F.col(c), given)
        out.append(F.when(F.col("_old").isNull(), given).when(F.col("_new").isNull(), F.col(c)).otherwise(merged).cast(existing.schema[c].dataType).alias(c))
    return both.select(*out)


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Existing rows, and incoming ones whose key is new."""
    fresh = incoming.select(*existing.columns).dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")
    return existing.unionByName(fresh)


def with_ids(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], id_column: str) -> DataFrame:
    """Incoming keys with their ids: the existing one, else numbers after the highest, in the order of the keys.

    New ids are numbered within hashed parts, whose sizes are summed before, so that no task numbers them all.
    """
    known = incoming.select(*keys).distinct().join(existing.select(*keys, id_column), list(keys), "left")
    old = known.filter(F.col(id_column).isNotNull())
    fresh = known.filter(F.col(id_column).isNull()).drop(id_column).withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(256)))
    sizes = fresh.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    top = existing.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("_top"))
    order = Window.partitionBy("_part").orderBy(*keys)
    fresh = fresh.withColumn("_n", F.row_number().over(order)).join(sizes, "_part").join(F.broadcast(top))  # top is one row
    return old.unionByName(fresh.select(*keys, (F.col("_top") + F.col("_base") + F.col("_n")).cast("long").alias(id_column)))


def one_primary(titles: DataFrame) -> DataFrame:
    """Exactly one primary title an item: the newest."""
    w = Window.partitionBy("novel_uid").orderBy(F.desc("last_seen_date"), F.desc("first_seen_date"), F.desc("title_id"))
    return titles.withColumn("is_primary", (F.row_number().over(w) == 1).cast("int"))


def empty_tables(spark) -> Tables:  # noqa: ANN001
    return {name: spark.createDataFrame([], ddl) for name, ddl in SCHEMAS.items()}


def valid_items(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with a platform, an id and a title, and the others."""
    good = F.lit(True)
    for c in ("platform", "platform_novel_id", "title"):
        good = good & (T.strip(F.coalesce(F.col(c), F.lit(""))) != "")
    return items.filter(good), items.filter(~good)


def canonical(items: DataFrame) -> DataFrame:
    """Items as records: texts trimmed, numbers parsed, tags as an array, defaults for what is missing."""
    text = lambda c: T.strip(F.coalesce(F.col(c).cast("string"), F.lit("")))
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), T.strip)
    chapters = T.title_signature(F.col("chapter_titles")) if "chapter_titles" in items.columns else F.lit(None).cast("array<string>")
    return items.select(
        text("platform").alias("platform"), text("platform_novel_id").alias("platform_novel_id"), text("title").alias("title"), T.normalize_text(F.col("title")).alias("title_norm"),
        text("author").alias("author"), T.normalize_text(F.col("author")).alias("author_norm"), text("intro").alias("intro"), T.normalize_text(F.col("intro")).alias("intro_norm"),
        text("main_category").alias("main_category"), F.filter(tags, lambda t: t != "").alias("tags"), T.normalize_status(F.col("status")).alias("status"),
        T.safe_int(F.col("total_words")).alias("total_words"), text("url").alias("url"), T.safe_int(F.col("rank"), -1).cast("int").alias("rank"),
        T.safe_int(F.col("total_recommend"), None).alias("total_recommend"), T.safe_int(F.col("reading_count"), None).alias("reading_count"),
        "rank_family", "rank_sub_cat", "source_url", F.col("snapshot_date").cast("date").alias("snapshot_date"), chapters.alias("chapter_titles"),
    )


def signature(novels: DataFrame) -> Column:
    """What a novel is recognised by: a hash of its introduction, if it has one, and, where known, the titles of its first chapters."""
    intro = F.when(F.coalesce("intro_norm", F.lit("")) != "", T.sha1_hex(F.col("intro_norm")))
    return F.to_json(F.struct(intro.alias("intro_sha1"), F.when(F.size("chapter_titles") > 0, F.col("chapter_titles")).alias("chapter_title_sig")))


def _newcomers(good: DataFrame, novels: DataFrame) -> DataFrame:
    """The first record of each id that isn't stored, if it has chapters: only such can match."""
    opened = good.filter(F.size("chapter_titles") > 0).select(*KEYS).distinct()
    first = newest(good.join(opened, KEYS, "left_semi").join(novels.select(*KEYS), KEYS, "left_anti"), KEYS, F.asc_nulls_first("snapshot_date"), "rank_list_id", "rank")
    return first.filter(F.size("chapter_titles") > 0)


def _folded(good: DataFrame) -> DataFrame:
    """One row for each novel_uid of resolved records, with what they come to if each is saved after the one before, by day, then id."""
    at = F.struct("snapshot_date", "platform_novel_id", -F.col("rank_list_id"), -F.col("rank"))
    last = [F.max_by(c, at).alias(c) for c in ("platform", "platform_novel_id", "author", "author_norm", "intro", "intro_norm", "status")]
    given = [F.max_by(c, F.when(F.col(c) != "", at)).alias(c) for c in ("main_category", "url")]
    filled = [F.min_by(F.when(full, F.col(c)), F.when(full, at)).alias(f"_{c}") for c, full in (("intro_norm", F.col("intro_norm") != ""), ("chapter_titles", F.size("chapter_titles") > 0))]
    days = [F.min("snapshot_date").alias("created_date"), F.max("snapshot_date").alias("last_seen_date")]
    rows = good.groupBy("novel_uid").agg(*last, *given, F.max_by("total_words", F.when(F.col("total_words") > 0, at)).alias("total_words"), *filled, *days)
    sig = rows.select("*", F.to_json(F.struct(T.sha1_hex(F.col("_intro_norm")).alias("intro_sha1"), F.col("_chapter_titles").alias("chapter_title_sig"))).alias("signature_json"))
    return sig.withColumns({"main_category": F.coalesce("main_category", F.lit("")), "url": F.coalesce("url", F.lit("")), "total_words": F.coalesce("total_words", F.lit(0).cast("long"))})


def save_snapshots(tables: Tables, items: DataFrame, make_title_primary: bool = False, threshold: float = 0.84, work: str | None = None) -> Tables:
    """All tables after one batch of items (crawl records with their list and date). Running it twice gives the same tables.

    Items are resolved by (platform, platform_novel_id), else by similarity (best_matches), else they are new. A novel that is
    recognised takes the platform id of its newest item, and the item's title as an alias. Days are saved one after the other: a new id is compared with the
    novels as they were when its day began, and with the new ids of that day before it, so a match may be in the same batch and lead on to another. Days
    on which nobody can be recognised are saved together. So the novels don't depend on how days are cut into batches.

    With a new folder `work`, which all executors see, what several tables are made from is written there once instead of being computed for
    each. The result is a set of lazy tables: write them all to a new folder, then point readers at it.
    """

    def once(df: DataFrame, name: str) -> DataFrame:
        if work is None:
            return df
        df.write.parquet(f"{work}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{work}/{name}")

    rest = once(canonical(valid_items(items)[0]), "items")
    list_keys = ["platform", "rank_family", "rank_sub_cat"]
    # what many records share is taken once, before it is put in order or normalised
    shared = rest.groupBy(*list_keys, "source_url").agg(F.max("snapshot_date").alias("snapshot_date"))
    lists = newest(shared, list_keys, F.desc("snapshot_date"), F.desc("source_url")).drop("snapshot_date")
    lists = once(lists.join(with_ids(tables["rank_lists"], lists, list_keys, "rank_list_id"), list_keys), "lists")
    rest = rest.join(lists.select(*list_keys, "rank_list_id"), list_keys)
    out = dict(tables) | {"rank_lists": upsert(tables["rank_lists"], lists, list_keys, LIST_RULES)}
    for step in range(1 << 20):
        stage = lambda df, name, step=step: once(df, f"{name}{step}")
        # without chapters nobody can be recognised, and records needn't be put in order
        opened = not rest.filter(F.size("chapter_titles") > 0).isEmpty()
        fresh = stage(_newcomers(rest, out["novels"]), "newcomers") if opened else rest.limit(0)
        days = [] if not opened else [r[0] for r in fresh.select("snapshot_date").distinct().orderBy(F.asc_nulls_first("snapshot_date")).collect()]
        first = rest.orderBy(F.asc_nulls_first("snapshot_date")).select("snapshot_date").first() if days else None
        matches, stop = None, days[0] if days else None
        if days and days[0] == first[0]:
            of_day = fresh.filter(F.col("snapshot_date").eqNullSafe(F.lit(first[0]).cast("date")))
            found = stage(best_matches(of_day, out["novels"], out["novel_titles"], threshold, among=True), "matches")
            matches = follow(found, lambda df, name, step=step: once(df, f"{name}_{step}"))
            # an id that a recognised novel loses is new again on a later day
            lost = out["novels"].join(matches.select("novel_uid").distinct(), "novel_uid", "left_semi").select(*KEYS)
            day = F.lit(first[0]).cast("date")
            again = rest.join(lost, KEYS, "left_semi").filter(F.col("snapshot_date").isNotNull() & (day.isNull() | (F.col("snapshot_date") > day))).agg(F.min("snapshot_date")).first()[0]
            stop = min((d for d in (days[1] if len(days) > 1 else None, again) if d is not None), default=None)
        last = stop is None
        now = rest if last else rest.filter(F.col("snapshot_date").isNull() | (F.col("snapshot_date") < F.lit(stop)))
        out = _save_days(out, now, matches, make_title_primary, stage)
        if last:
            return out
        out = {name: stage(df, f"table_{name}") for name, df in out.items()}
        rest = rest.filter(F.col("snapshot_date") >= F.lit(stop))
    raise RuntimeError("too many days")


def _save_days(tables: Tables, good: DataFrame, matches: DataFrame | None, make_title_primary: bool, once: Callable[[DataFrame, str], DataFrame]) -> Tables:
    """All tables after records with their list's id, of which those in matches (KEYS with novel_uid, or root_id of a new item) are known under another id."""
    out = dict(tables)
    snap_keys = ["rank_list_id", "snapshot_date"]
    snaps = good.groupBy(*snap_keys).agg(F.count(F.lit(1)).cast("int").alias("item_count"))
    snaps = once(snaps.join(with_ids(tables["rank_snapshots"], snaps, snap_keys, "snapshot_id"), snap_keys), "snapshots")
    out["rank_snapshots"] = upsert(tables["rank_snapshots"], snaps, snap_keys, SNAPSHOT_RULES)
    tags = good.groupBy("tags").agg(F.max("snapshot_date").alias("snapshot_date")).select("snapshot_date", F.explode("tags").alias("tag_name")).withColumn("tag_norm", T.normalize_text(F.col("tag_name"))).filter("tag_norm <> ''")
    tags = newest(tags, ["tag_norm"], F.desc("snapshot_date"), "tag_name").drop("snapshot_date")
    tags = once(tags.join(with_ids(tables["tags"], tags, ["tag_norm"], "tag_id"), "tag_norm"), "tags")
    out["tags"] = upsert(tables["tags"], tags, ["tag_norm"], TAG_RULES)
    keys = good.select(*KEYS).distinct()
    known = tables["novels"].select(*KEYS, "novel_uid")
    if matches is None:
        ids = with_ids(known, keys, KEYS, "novel_uid")
    else:
        roots = keys.join(matches, KEYS, "left").withColumn("root_id", F.coalesce("root_id", "platform_novel_id"))
        root_keys = roots.filter("novel_uid is null").select("platform", F.col("root_id").alias("platform_novel_id"))
        made = with_ids(known, root_keys, KEYS, "novel_uid").select("platform", F.col("platform_novel_id").alias("root_id"), F.col("novel_uid").alias("_made"))
        ids = roots.join(made, ["platform", "root_id"], "left").select(*KEYS, F.coalesce("novel_uid", "_made").alias("novel_uid"))
    good = once(good.join(once(ids, "ids"), KEYS), "resolved")
    out["novels"] = upsert(tables["novels"], _folded(good), ["novel_uid"], NOVEL_RULES)
    title_keys = ["novel_uid", "title_norm"]
    titles = good.groupBy(*title_keys).agg(F.min_by("title", F.struct("snapshot_date", "platform_novel_id")).alias("title"), F.min("snapshot_date").alias("first_seen_date"), F.max("snapshot_date").alias("last_seen_date"))
    titles = titles.join(with_ids(tables["novel_titles"], titles, title_keys, "title_id"), title_keys).withColumn("is_primary", F.lit(0))
    merged = upsert(tables["novel_titles"], titles, title_keys, TITLE_RULES)
    if not make_title_primary:
        primary = F.max("is_primary").over(Window.partitionBy("novel_uid")) == 1
        order = Window.partitionBy("novel_uid").orderBy("first_seen_date", "title_id")
        out["novel_titles"] = merged.withColumn("is_primary", F.when(primary, F.col("is_primary")).otherwise((F.row_number().over(order) == 1).cast("int")))
    else:
        out["novel_titles"] = one_primary(merged)
    pairs = good.select("novel_uid", "tags").distinct().select("novel_uid", F.explode("tags").alias("tag_name")).withColumn("tag_norm", T.normalize_text(F.col("tag_name"))).join(tags.select("tag_norm", "tag_id"), "tag_norm")
    out["novel_tag_map"] = insert_absent(tables["novel_tag_map"], pairs, ["novel_uid", "tag_id"])
    placed = good.filter("rank >= 0").join(snaps.select(*snap_keys, "snapshot_id"), snap_keys)
    entries = newest(placed, ["snapshot_id", "novel_uid"], "rank").withColumn("extra_json", F.to_json(F.struct("source_url")))
    out["rank_entries"] = upsert(tables["rank_entries"], entries, ["snapshot_id", "novel_uid"], ENTRY_RULES)
    return out


def upsert_chapters(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Chapters of items by number: invalid ones go, the last of a number counts, word counts and hashes are completed."""
    good = incoming.filter((F.col("chapter_num") >= 0) & (T.strip(F.coalesce("chapter_title", F.lit(""))) != ""))
    good = newest(good, ["novel_uid", "chapter_num"], F.desc("publish_date"), F.desc("chapter_content"))
    good = good.withColumns({"word_count": F.coalesce("word_count", F.length("chapter_content")), "content_hash": T.content_hash(F.col("chapter_title"), F.col("chapter_content"))})
    keys = ["novel_uid", "chapter_num"]
    good = good.join(with_ids(existing, good, keys, "chapter_id"), keys)
    return upsert(existing, good, keys, CHAPTER_RULES)


def opening_titles(chapters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and chapter_titles, the signature of the first chapters that each item has in this table, by number; a number's newest title counts."""
    rows = newest(chapters.filter((F.col("chapter_num") >= 0) & (T.strip(F.coalesce("chapter_title", F.lit(""))) != "")), [*keys, "chapter_num"], F.desc("publish_date"), F.desc("chapter_content"), "chapter_title")
    titles = F.transform(F.array_sort(F.collect_list(F.struct("chapter_num", "chapter_title"))), lambda x: x.chapter_title)
    return rows.groupBy(*keys).agg(titles.alias("_titles")).select(*keys, T.title_signature(F.col("_titles")).alias("chapter_titles"))


def fill_signatures(novels: DataFrame, signatures: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Novels whose signatures have got the parts they lacked from others: signatures has keys and signature_json, one row a key."""
    rules = dict.fromkeys(novels.columns, "keep") | {"signature_json": "signature"}
    return upsert(novels, signatures.join(novels.select(*keys), list(keys), "left_semi"), keys, rules)


def save_chapters(tables: Tables, chapters: DataFrame) -> Tables:
    """All tables after a batch of chapters of items named by platform and platform_novel_id, with the item's title if known (else null).

    Items that aren't stored are created with what a chapter says of them: the title, or "unknown", the day it was seen and the titles of
    its first chapters as signature. Stored items whose signature has no chapters get these titles too.
    """
    keys = KEYS
    ids = with_ids(tables["novels"], chapters, keys, "novel_uid")
    opened = opening_titles(chapters, keys)
    fresh = chapters.join(tables["novels"].select(*keys), keys, "left_anti").groupBy(*keys).agg(
        F.coalesce(F.max("title"), F.lit("unknown")).alias("title"), F.min("publish_date").alias("created_date"), F.max("publish_date").alias("last_seen_date"),
    ).join(ids, keys).join(opened, keys, "left")
    empty = {c: F.lit("") for c in ("author", "author_norm", "intro", "intro_norm", "main_category", "status", "url")}
    novels = fresh.withColumns(empty | {"total_words": F.lit(0).cast("long")})
    novels = novels.withColumn("signature_json", signature(novels))
    known = opened.withColumn("signature_json", F.to_json(F.struct(F.col("chapter_titles").alias("chapter_title_sig")))).select(*keys, "signature_json")
    titles = fresh.select("novel_uid", "title", T.normalize_text(F.col("title")).alias("title_norm"), F.col("created_date").alias("first_seen_date"), "last_seen_date", F.lit(1).alias("is_primary"))
    titles = titles.join(with_ids(tables["novel_titles"], titles, ["novel_uid", "title_norm"], "title_id"), ["novel_uid", "title_norm"])
    rows = chapters.join(ids, keys)
    return dict(tables) | {
        "novels": fill_signatures(tables["novels"], known, keys).unionByName(novels.select(*tables["novels"].columns)),
        "novel_titles": upsert(tables["novel_titles"], titles, ["novel_uid", "title_norm"], TITLE_RULES),
        "first_n_chapters": upsert_chapters(tables["first_n_chapters"], rows.select(*[c for c in tables["first_n_chapters"].columns if c in rows.columns])),
    }


def add_aliases(titles: DataFrame, aliases: DataFrame, make_primary: bool = False) -> DataFrame:
    """Titles after aliases (novel_uid, title, snapshot_date) of known items: new ones are no primary titles unless asked for; blank ones and null uids go."""
    good = aliases.select("novel_uid", T.strip(F.coalesce("title", F.lit(""))).alias("title"), F.col("snapshot_date").cast("date").alias("snapshot_date"))
    good = good.filter("novel_uid is not null and title <> ''").withColumn("title_norm", T.normalize_text(F.col("title")))
    keys = ["novel_uid", "title_norm"]
    new = good.groupBy(*keys).agg(F.min_by("title", "snapshot_date").alias("title"), F.min("snapshot_date").alias("first_seen_date"), F.max("snapshot_date").alias("last_seen_date"))
    new = new.join(with_ids(titles, new, keys, "title_id"), keys).withColumn("is_primary", F.lit(0))
    merged = upsert(titles, new, keys, TITLE_RULES)
    if not make_primary:
        return merged
    asked = new.select("novel_uid").distinct().withColumn("_asked", F.lit(True))
    return one_primary(merged.join(asked, "novel_uid", "left").filter("_asked").drop("_asked")).unionByName(merged.join(asked, "novel_uid", "left_anti"))


def merge_renumber(existing: DataFrame, new: DataFrame, group: str, order: Sequence[str], n: int) -> DataFrame:
    """Children of both tables in order, the first n of each group, numbered from 1; of the same place, existing ones come first."""
    both = existing.withColumn("_from", F.lit(0)).unionByName(new.withColumn("_from", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(group).orderBy(*order, "_from")
    return both.withColumn("number", F.row_number().over(w)).filter(F.col("number") <= n).drop("_from")


def next_chunk(df: DataFrame, group: str, order: Sequence[str], existing: int, target: int) -> DataFrame:
    """Children after the first `existing`, up to the target number."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("number", F.row_number().over(w)).filter(F.col("number").between(existing + 1, target))


def work_list(items: DataFrame, stats: DataFrame, key: str, count: str, n: int) -> DataFrame:
    """Items that have fewer than n children."""
    return items.join(stats.filter(F.col(count) >= n).select(key), key, "left_anti")


def needs_detail(status: Column, total_words: Column, metric: Column, category: Column, unknown: Sequence[str] = ("未知",)) -> Column:
    """Whether a listed record still needs its detail page: no status, no words, no audience figure, or no known category."""
    missing = needs_fill(status, "when_empty") | needs_fill(total_words, "when_zero") | metric.isNull()
    return missing | needs_fill(category, "when_unknown", 0, unknown)


def needs_fill(col: Column, rule: str, least: int = 0, unknown: Sequence[str] = ()) -> Column:
    """Whether a value should be taken from a detail record: when_empty, when_unknown, min_len or when_zero."""
    text = T.strip(F.coalesce(col.cast("string"), F.lit("")))
    if rule == "when_zero":
        return F.coalesce(col.cast("double"), F.lit(0.0)) == 0
    if rule == "min_len":
        return F.length(text) < least
    if rule == "when_unknown":
        return (text == "") | F.lower(text).isin(*[u.lower() for u in unknown])
    return text == ""


def merge_records(primary: DataFrame, detail: DataFrame, key: str, rules: Mapping[str, tuple]) -> DataFrame:
    """List records completed from detail records, field by field: rules give for each column a rule of needs_fill and its arguments."""
    other = detail.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_d_{c}") for c in rules])
    both = primary.join(other, F.col(key) == F.col("_key"), "left")
    given = lambda c: F.col(f"_d_{c}").isNotNull()
    return both.select(*[F.when(needs_fill(F.col(c), *rules[c]) & given(c), F.col(f"_d_{c}")).otherwise(F.col(c)).alias(c) if c in rules else F.col(c) for c in primary.columns])

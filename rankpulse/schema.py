"""Tables of the star schema, and what tells one platform from another."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

#: Columns of each table as DDL.
SCHEMAS = {
    "novels": "novel_uid long, platform string, platform_novel_id string, author string, author_norm string, intro string, intro_norm string, main_category string, status string, total_words long, url string, signature_json string, created_date date, last_seen_date date",
    "novel_titles": "title_id long, novel_uid long, title string, title_norm string, is_primary int, first_seen_date date, last_seen_date date",
    "tags": "tag_id long, tag_name string, tag_norm string",
    "novel_tag_map": "novel_uid long, tag_id long",
    "rank_lists": "rank_list_id long, platform string, rank_family string, rank_sub_cat string, source_url string",
    "rank_snapshots": "snapshot_id long, rank_list_id long, snapshot_date date, item_count int",
    "rank_entries": "snapshot_id long, novel_uid long, rank int, total_recommend long, reading_count long, extra_json string",
    "first_n_chapters": "chapter_id long, novel_uid long, chapter_num int, chapter_title string, chapter_content string, chapter_url string, word_count int, content_hash string, publish_date date",
}


@dataclass(frozen=True)
class Platform:
    """metric: column of its audience figure; by_sub_category: its topic is the sub-category, else the tag; new_families: families of new
    items, or None if an item is new when it was first seen in the window."""

    name: str
    metric: str
    by_sub_category: bool
    new_families: tuple[str, ...] | None


#: The two platforms of the test tables.
PLATFORMS = (
    Platform("alpha", "total_recommend", True, None),
    Platform("beta", "reading_count", False, ("1-URGENT",)),
)

Tables = dict[str, DataFrame]

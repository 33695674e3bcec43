"""DuckDB SQL of the star queries: common table expressions, and a final select for each query."""

STAR = """
fact as (
  select case when l_partkey % 2 = 0 then 'alpha' else 'beta' end as platform, o_orderpriority as rank_family, '' as rank_sub_cat,
    cast(date_trunc('year', o_orderdate) as date) as snapshot_date, l_partkey as novel_uid, cast(sum(l_quantity) as bigint) as metric
  from lineitem join orders on l_orderkey = o_orderkey group by all
), ranked as (
  select *, cast(row_number() over (partition by platform, rank_family, rank_sub_cat, snapshot_date order by metric desc, novel_uid) as integer) as rank from fact
), top as (select * from ranked),
rank_lists as (
  select cast(row_number() over (order by platform, rank_family, rank_sub_cat) as bigint) as rank_list_id, platform, rank_family, rank_sub_cat, 'https://example.org/' || platform as source_url
  from (select distinct platform, rank_family, rank_sub_cat from top)
), placed as (
  select t.*, l.rank_list_id, cast(l.rank_list_id * 1000000 + year(snapshot_date) * 100 + month(snapshot_date) as bigint) as snapshot_id
  from top t join rank_lists l using (platform, rank_family, rank_sub_cat)
), rank_snapshots as (
  select snapshot_id, rank_list_id, snapshot_date, cast(count(*) as integer) as item_count from placed group by all
), rank_entries as (
  select snapshot_id, novel_uid, rank, case when platform = 'alpha' then metric end as total_recommend, case when platform = 'beta' then metric end as reading_count, '{}' as extra_json from placed
), seen as (select novel_uid, platform, min(snapshot_date) as created_date, max(snapshot_date) as last_seen_date from top group by all
), novels as (
  select s.novel_uid, s.platform, 'pk' || s.novel_uid as platform_novel_id, p_brand as author, p_type || ' ' || p_name as intro,
    case when s.platform = 'alpha' then p_type || '·' || p_brand else p_type end as main_category, case when p_size > 25 then '完本' else '连载' end as status,
    cast(p_size * 10000 as bigint) as total_words, 'https://example.org/book/' || s.novel_uid as url, created_date, last_seen_date, p_name
  from seen s join part on p_partkey = s.novel_uid
), tagged as (
  select distinct novel_uid, unnest(case when platform = 'alpha' then [author] else list_append(list_filter(string_split(p_name, ' '), lambda x: x <> ''), author) end) as tag_name from novels
), tags as (
  select cast(row_number() over (order by tag_name) as bigint) as tag_id, tag_name, lower(tag_name) as tag_norm from (select distinct tag_name from tagged)
), novel_tag_map as (select distinct novel_uid, tag_id from tagged join tags using (tag_name)
), lt as (
  select s.snapshot_date, l.platform, l.rank_family, l.rank_sub_cat, l.rank_list_id, s.snapshot_id, e.novel_uid, e.rank, e.total_recommend, e.reading_count,
    n.main_category, n.status, n.total_words, n.created_date, n.last_seen_date, g.tag_name
  from rank_entries e join rank_snapshots s using (snapshot_id) join rank_lists l using (rank_list_id) join novels n using (novel_uid)
    left join tagged g on g.novel_uid = e.novel_uid
)
"""

UNIFIED = """
, raw as (
  select *, cast(case when platform = 'beta' then reading_count else total_recommend end as double) as heat_raw, snapshot_date as period,
    case when platform = 'alpha' then trim(string_split(main_category, '·')[-1]) else tag_name end as tag_u, main_category as cat_u
  from lt
)
"""


def _panel(dim: str, source: str = "raw", name: str = "tp") -> str:
    tag = dim == "tag_u"
    share = "tag_share" if tag else "cat_share"
    more = ", median(heat_raw) as median_heat_raw, count(distinct case when rank <= 10 then novel_uid end) as top_app_count" if tag else ""
    after = ", avg_heat_raw / nullif(avg_rank, 0) as efficiency, cast(top_app_count as double) / nullif(book_count, 0) as head_ratio" if tag else ""
    return f"""
, {name}0 as (
  select platform, rank_family, rank_sub_cat, period, {dim}, count(distinct novel_uid) as book_count, avg(rank) as avg_rank, avg(heat_raw) as avg_heat_raw, min(heat_raw) as entry_threshold {more}
  from {source} where {dim} is not null group by all
), {name}1 as (
  select platform, rank_family, rank_sub_cat, period, count(distinct novel_uid) as books_in_group from {source} where {dim} is not null group by all
), {name}2 as (select *, cast(book_count as double) / books_in_group as {share} from {name}0 join {name}1 using (platform, rank_family, rank_sub_cat, period)
), {name} as (
  select *, sum({share} * {share}) over (partition by platform, rank_family, rank_sub_cat, period) as concentration_index {after} from {name}2
)
"""


def _roll(dim: str, source: str = "tp", name: str = "roll") -> str:
    tag = dim == "tag_u"
    share = "tag_share" if tag else "cat_share"
    keys = f"platform, rank_family, rank_sub_cat, {dim}"
    means = ", ".join(f"avg({c}) over (partition by {keys}) as m_{k}" for k, c in (("rank", "avg_rank"), ("heat", "avg_heat_raw"), ("share", share)))
    slope = lambda k, c: f"case when max(n) >= 2 then sum((i - (n - 1) / 2.0) * ({c} - m_{k})) / max((cast(n as double) * n * n - n) / 12) end as {k}_slope"
    more = (
        "stddev_samp(avg_rank) as rank_std, median(median_heat_raw) as median_heat, stddev_samp(avg_heat_raw) as heat_volatility, avg(efficiency) as mean_efficiency, avg(head_ratio) as mean_head_ratio"
        if tag
        else "avg(concentration_index) as mean_concentration"
    )
    return f"""
, {name}0 as (
  select *, row_number() over (partition by {keys} order by period) - 1 as i, count(*) over (partition by {keys}) as n, {means} from {source}
), {name} as (
  select {keys}, count(distinct period) as days_seen, min(period) as first_date, max(period) as last_date, avg(avg_rank) as mean_rank, avg({share}) as mean_share, avg(avg_heat_raw) as avg_heat,
    avg(entry_threshold) as mean_entry_threshold, {more}, {slope("rank", "avg_rank")}, {slope("heat", "avg_heat_raw")}, {slope("share", share)},
    cast(date_diff('day', min(period), max(period)) + 1 as bigint) as days_span
  from {name}0 group by {keys}
)
"""


def _round(columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 as {c}" for c in columns.split())


FIRST = "order by snapshot_date nulls last, rank_family nulls last, rank_sub_cat nulls last, rank nulls last, tag_name nulls last"
NEW = "case when platform = 'alpha' then created_date between date '1993-01-01' and date '1997-12-31' else rank_family = '1-URGENT' end"
PANEL = "avg_rank avg_heat_raw entry_threshold concentration_index"
ROLL = "mean_rank mean_share avg_heat mean_entry_threshold rank_slope heat_slope share_slope"
COVER = """
, lc0 as (select platform, rank_family, rank_sub_cat, snapshot_date, count(distinct novel_uid) as n from lt group by all
), lc as (
  select platform, rank_family, rank_sub_cat, avg(n) as avg_daily_books, count(*) as days_seen, min(snapshot_date) as min_date, max(snapshot_date) as max_date,
    cast(date_diff('day', min(snapshot_date), max(snapshot_date)) + 1 as bigint) as days_span,
    (select count(distinct novel_uid) from lt x where x.platform = lc0.platform and x.rank_family = lc0.rank_family and x.rank_sub_cat = lc0.rank_sub_cat) as total_books
  from lc0 group by platform, rank_family, rank_sub_cat
)
"""
_U, _TP, _CP = STAR + UNIFIED, STAR + UNIFIED + _panel("tag_u"), STAR + UNIFIED + _panel("cat_u", name="cp")
_GROUPS = "platform, rank_family, rank_sub_cat, period"


def _structure(platform: str, books: bool) -> str:
    more, out = (", max(books_in_group) as b", ", round(avg(b), 6) as books_per_day") if books else ("", "")
    return _TP + COVER + f"""
, ls as (select rank_family, rank_sub_cat, period, avg(avg_heat_raw) as h, avg(entry_threshold) as t, avg(concentration_index) as c {more} from tp where platform = '{platform}' group by 1, 2, 3
), lo as (select rank_family, rank_sub_cat, round(avg(h), 6) as avg_heat, round(avg(t), 6) as avg_threshold, round(avg(c), 6) as avg_concentration {out} from ls group by 1, 2)
select lo.*, lc.total_books, round(lc.avg_daily_books, 6) as avg_daily_books from lo left join lc on lc.platform = '{platform}' and lc.rank_family = lo.rank_family and lc.rank_sub_cat = lo.rank_sub_cat"""


def _combine(k: int) -> str:
    t = [chr(97 + i) for i in range(k)]
    keys = "platform period rank_family rank_sub_cat novel_uid".split()
    joins = "".join(f" join one {x} on " + " and ".join(f"{x}.{c} = a.{c}" for c in keys) + f" and {x}.tag_u > {t[i]}.tag_u" for i, x in enumerate(t[1:]))
    names = ", ".join(f"{x}.tag_u as tag_{i + 1}" for i, x in enumerate(t))
    tags = ", ".join(f"tag_{i + 1}" for i in range(k))
    return _U + f", one as (select distinct platform, period, rank_family, rank_sub_cat, novel_uid, tag_u from raw where tag_u is not null), many as (select {names} from one a{joins}) select {tags}, count(*) as n from many group by {tags} order by n desc, {tags} limit 30"


SQL = {
    "long_table": STAR + "select * exclude (created_date, last_seen_date) from lt where platform = 'beta' and snapshot_date between date '1995-01-01' and date '1997-12-31'",
    "date_window": STAR + """select lookback, case when days is null then lo else greatest(lo, cast(date '1998-08-15' - to_days(days) as date)) end as start_date, date '1998-08-15' as end_date
from (select min(snapshot_date) as lo from rank_snapshots), (values ('week', 7), ('month', 30), ('quarter', 90), ('year', 365), ('all', null)) v(lookback, days)""",
    "heat_scores": _U + """
, v as (select platform, heat_raw, count(*) as n from raw where heat_raw is not null group by all
), w as (select platform, heat_raw, (coalesce(sum(n) over (partition by platform order by heat_raw rows between unbounded preceding and 1 preceding), 0) + (n + 1) / 2.0) / sum(n) over (partition by platform) as pct from v
), m as (select platform, median(heat_raw) as med from raw group by all
), q as (select platform, any_value(med) as med, median(abs(heat_raw - med)) as mad from raw join m using (platform) group by platform
), z as (select raw.*, pct, case when coalesce(mad, 0) > 0 then (heat_raw - med) / (1.4826 * mad) else 0 end as rz from raw join q using (platform) left join w using (platform, heat_raw))
select snapshot_id, novel_uid, tag_name, platform, heat_raw, round(pct, 6) as heat_pct, round(rz, 6) as heat_rz, round((tanh(rz / 3) + 1) / 2, 6) as heat_rz01, round(0.7 * pct + 0.3 * (tanh(rz / 3) + 1) / 2, 6) as heat_mix from z""",
    "unified_columns": _U + "select snapshot_id, novel_uid, tag_name, cast(date_trunc('month', snapshot_date) as date) as period, tag_u, cat_u from raw",
    "tag_panel": _TP + f"select {_GROUPS}, tag_u, book_count, median_heat_raw, top_app_count, books_in_group, {_round(PANEL + ' tag_share efficiency head_ratio')} from tp",
    "category_panel": _CP + f"select {_GROUPS}, cat_u, book_count, books_in_group, {_round(PANEL + ' cat_share')} from cp",
    "tag_rollup": _TP + _roll("tag_u") + f"""select platform, rank_family, rank_sub_cat, tag_u, days_seen, first_date, last_date, days_span,
  {_round(ROLL + ' rank_std median_heat heat_volatility mean_efficiency mean_head_ratio')},
  case when days_seen < 2 then 'unknown' when mean_share >= 0.08 and avg_heat >= median_heat then 'safe' when share_slope > 0 and heat_slope > 0 then 'chance' else 'stable' end as stage,
  round(heat_slope + share_slope - rank_slope, 6) + 0.0 as chance from roll""",
    "category_rollup": _CP + _roll("cat_u", "cp") + f"select platform, rank_family, rank_sub_cat, cat_u, days_seen, first_date, last_date, days_span, {_round(ROLL + ' mean_concentration')} from roll",
    "new_entry_ratio": _U + f""", f as (select *, row_number() over (partition by platform, tag_u, novel_uid {FIRST}) as n from raw where tag_u is not null)
select platform, tag_u, count(*) as total_books, cast(sum(({NEW})::int) as bigint) as new_books, round(sum(({NEW})::int) / count(*), 6) as new_entry_ratio from f where n = 1 group by platform, tag_u""",
    "new_book_heat": _U + f"select platform, tag_u, round(avg(case when {NEW} then heat_raw end), 6) as new_heat, count(case when {NEW} then 1 end) as new_rows from raw where tag_u is not null group by platform, tag_u",
    "opening_opportunities": _U + f"""
, r as (select * from raw where period between date '1993-01-01' and date '1997-12-31' and tag_u is not null and cat_u is not null
), t as (select platform, period, count(distinct novel_uid) as al from r group by all
), d0 as (select *, row_number() over (partition by platform, cat_u, tag_u, period, novel_uid {FIRST}) as n from r
), d as (select platform, cat_u, tag_u, period, count(*) as books, avg(heat_raw) as heat from d0 where n = 1 group by all
), e as (select *, cast(books as double) / al as share from d join t using (platform, period)
), s as (select platform, cat_u, tag_u, min(period) as first_date, max(period) as last_date, arg_min(share, period) as start_share, arg_max(share, period) as end_share, arg_min(heat, period) as start_heat, arg_max(heat, period) as end_heat from e group by all
), n0 as (select *, row_number() over (partition by platform, cat_u, tag_u, novel_uid {FIRST}) as n from r
), w as (select platform, cat_u, tag_u, count(*) as total_books, cast(sum(({NEW})::int) as bigint) as new_books, sum(({NEW})::int) / count(*) as new_entry_ratio from n0 where n = 1 group by platform, cat_u, tag_u
), x as (select *, end_share - start_share as share_delta, end_heat - start_heat as heat_delta from s join w using (platform, cat_u, tag_u) where total_books >= 5
), y as (select *, round((share_delta - avg(share_delta) over p) / (stddev_pop(share_delta) over p + 1e-12) + (heat_delta - avg(heat_delta) over p) / (stddev_pop(heat_delta) over p + 1e-12)
    + 0.8 * (new_entry_ratio - avg(new_entry_ratio) over p) / (stddev_pop(new_entry_ratio) over p + 1e-12), 6) as opportunity_score from x window p as (partition by platform))
select platform, cat_u, tag_u, first_date, last_date, cast(date_diff('day', first_date, last_date) + 1 as bigint) as days_span, total_books, new_books,
  {_round('start_share end_share start_heat end_heat share_delta heat_delta new_entry_ratio opportunity_score')} from y order by platform, opportunity_score desc, cat_u, tag_u limit 80""",
    "tag_pairs": _combine(2),
    "tag_triples": _combine(3),
    "platform_coverage": STAR + "select platform, min(snapshot_date) as min_date, max(snapshot_date) as max_date, count(distinct snapshot_date) as unique_snapshots, count(distinct novel_uid) as unique_novels, cast(date_diff('day', min(snapshot_date), max(snapshot_date)) + 1 as bigint) as days_span from lt group by platform",
    "list_coverage": STAR + COVER + "select * replace (round(avg_daily_books, 6) as avg_daily_books) from lc",
    "tag_summary_topk": _TP + _roll("tag_u") + "select tag_u, round(avg(mean_share), 6) as mean_share, round(avg(avg_heat), 6) as avg_heat, round(avg(mean_rank), 6) as mean_rank from roll where platform = 'beta' group by tag_u order by mean_share desc, tag_u limit 10",
    "list_structure_a": _structure("alpha", False),
    "list_structure_b": _structure("beta", True),
    "cross_platform_diff": _U + ", base as (select * replace (string_split(main_category, '·')[1] as cat_u) from raw)" + _panel("cat_u", "base", "cp") + _roll("cat_u", "cp") + """
, side as (select platform, cat_u, avg(mean_share) as s, avg(avg_heat) as h, avg(mean_rank) as r from roll group by platform, cat_u)
select cat_u, round(a.s, 6) as share_alpha, round(a.h, 6) as heat_alpha, round(a.r, 6) as rank_alpha, round(b.s, 6) as share_beta, round(b.h, 6) as heat_beta, round(b.r, 6) as rank_beta,
  case when a.s is not null and b.s is not null then 'both' when a.s is not null then 'alpha_only' else 'beta_only' end as presence,
  round(coalesce(a.s, 0) - coalesce(b.s, 0), 6) as share_diff, round(a.h - b.h, 6) as heat_diff, round(a.r - b.r, 6) as rank_diff
from (select * from side where platform = 'alpha') a full join (select * from side where platform = 'beta') b using (cat_u)""",
    "concentration_daily": _TP + "select platform, period, round(avg(concentration_index), 6) as concentration from tp group by platform, period",
    "bar_topk": _TP + "select tag_u as label, round(avg(tag_share), 6) as value from tp where tag_share is not null group by tag_u order by value desc, label limit 10",
    "line_topk": _TP + """, pt as (select period as x, tag_u as label, avg(avg_heat_raw) as y from tp where avg_heat_raw is not null group by all
), best as (select label, round(avg(y), 6) as m from pt group by label order by m desc, label limit 5) select x, label, round(y, 6) as y from pt where label in (select label from best)""",
    "table_counts": STAR + " union all ".join(f"select '{t}' as table_name, count(*) as n_rows from {s}" for t, s in (("novels", "novels"), ("novel_titles", "novels"), ("tags", "tags"), ("novel_tag_map", "novel_tag_map"), ("rank_lists", "rank_lists"), ("rank_snapshots", "rank_snapshots"), ("rank_entries", "rank_entries"))),
    "item_count_mismatch": STAR + """select snapshot_id, platform, rank_family, rank_sub_cat, snapshot_date, cast(item_count + 1 as bigint) as declared, cast(item_count as bigint) as actual
from rank_snapshots join rank_lists using (rank_list_id) where snapshot_id % 3 = 0 order by snapshot_date desc, snapshot_id desc limit 20""",
    "run_summary": STAR + "select platform, snapshot_date, count(distinct rank_list_id) as n_lists, count(*) as n_entries, count(distinct novel_uid) as n_novels from placed group by platform, snapshot_date",
    "browse_page": STAR + "select novel_uid, platform, author, main_category, status, total_words, url from novels order by novel_uid limit 50 offset 100",
    "list_browse": STAR + "select * from rank_lists where platform = 'alpha'",
    "snapshot_browse": STAR + "select * from rank_snapshots where rank_list_id = 3",
    "entries_browse": STAR + "select * exclude (extra_json) from rank_entries where snapshot_id = 3199501 order by rank limit 20",
    "novel_dossier": STAR + """select n.novel_uid, n.platform, n.author, n.main_category, [p_name] as titles, (select list(tag_name order by tag_name) from tagged g where g.novel_uid = n.novel_uid) as tags, r.n_ranks, r.best_rank, r.last_rank
from novels n left join (select novel_uid, count(*) as n_ranks, min(rank) as best_rank, arg_max(rank, (snapshot_date, snapshot_id)) as last_rank from placed group by novel_uid) r using (novel_uid)""",
    "snapshot_listing": STAR + "select e.snapshot_id, l.platform, l.rank_family, l.rank_sub_cat, s.snapshot_date, e.rank, e.novel_uid, p_name as title, author, main_category, total_recommend, reading_count from rank_entries e join rank_snapshots s using (snapshot_id) join rank_lists l using (rank_list_id) join novels n using (novel_uid)",
    "full_inspection": STAR + "select e.snapshot_id, e.rank, e.novel_uid, p_name as title, (select string_agg(tag_name, ',' order by tag_name) from tagged g where g.novel_uid = e.novel_uid) as tags from rank_entries e join novels n using (novel_uid)",
    "section_table": STAR + COVER + "select platform, rank_family, case when rank_sub_cat = '' then '-' else rank_sub_cat end as rank_sub_cat, printf('%.4f', avg_daily_books) as avg_daily_books, cast(days_seen as varchar) as days_seen, cast(min_date as varchar) as min_date from lc",
    "upsert_novels": STAR + """select novel_uid, platform, platform_novel_id, case when novel_uid % 2 = 0 then author || '+' else author end as author,
  case when novel_uid % 2 = 0 and novel_uid % 4 <> 0 then url || '/2' when novel_uid % 2 = 0 and novel_uid % 3 = 0 then '' else url end as url,
  case when novel_uid % 2 = 0 and novel_uid % 4 <> 0 then total_words + 1 when novel_uid % 2 = 0 and novel_uid % 3 = 0 then 0 else total_words end as total_words,
  case when novel_uid % 2 = 0 then date '1999-01-01' else last_seen_date end as last_seen_date from novels where novel_uid % 3 <> 0 or novel_uid % 2 = 0""",
    "upsert_entries": STAR + "select snapshot_id, novel_uid, case when novel_uid % 2 = 0 then rank + 100 else rank end as rank, total_recommend, reading_count from rank_entries where novel_uid % 3 <> 0 or novel_uid % 2 = 0",
    "upsert_snapshots": STAR + "select * replace (case when year(snapshot_date) >= 1995 then item_count + 1 else item_count end as item_count) from rank_snapshots",
    "upsert_lists": STAR + "select * replace (case when rank_list_id > 3 and rank_list_id % 2 = 1 then 'https://example.org/new' when rank_list_id > 7 then '' else source_url end as source_url) from rank_lists",
    "upsert_tags": STAR + "select * replace (case when tag_id % 2 = 0 then upper(tag_name) else tag_name end as tag_name) from tags where tag_id % 3 <> 0 or tag_id % 2 = 0",
    "upsert_tag_map": STAR + "select * from novel_tag_map where tag_id % 3 <> 0 or novel_uid % 2 = 0",
    "upsert_titles": STAR + """select novel_uid, p_name as title, case when novel_uid % 2 = 0 then 0 else 1 end as is_primary, last_seen_date from novels
union all select novel_uid, p_name || ' II', 1, date '2099-01-01' from novels where novel_uid % 2 = 0""",
    "save_snapshot": STAR + "select platform, snapshot_date, count(distinct rank_list_id) as n_lists, count(*) as n_entries, count(distinct novel_uid) as n_novels from placed group by platform, snapshot_date",
    "payload_validate": STAR + "select r.platform, snapshot_date, count(*) as n, case when length(p_name) % 5 = 0 then 'quarantine' else 'valid' end as side from placed r join novels n using (novel_uid) group by all",
    "list_detail_merge": STAR + """, p as (select novel_uid, case when novel_uid % 2 = 0 then '' else author end as author, substr(intro, 1, 12) as intro, case when novel_uid % 3 = 0 then '未知' else status end as status,
  case when novel_uid % 5 = 0 then 0 else total_words end as total_words from novels)
select p.novel_uid, case when trim(p.author) = '' and d.novel_uid is not null then d.author else p.author end as author, case when length(trim(p.intro)) < 15 and d.novel_uid is not null then d.intro else p.intro end as intro,
  case when p.status in ('', '未知') and d.novel_uid is not null then d.status else p.status end as status, case when p.total_words = 0 and d.novel_uid is not null then d.total_words else p.total_words end as total_words
from p left join (select * from novels where novel_uid % 7 <> 0) d using (novel_uid)""",
    "list_quota": STAR + "select rank_list_id, rank_family, case when starts_with(rank_family, '1-') then 2 else 5 end as quota, starts_with(rank_family, '1-') as is_new_list from rank_lists",
}
SQL |= {
    "list_identity": STAR + """select rank_list_id, platform, rank_family, coalesce(k.family, 'other') as family, coalesce(k.sub_cat, rank_sub_cat) as sub_cat from rank_lists
  left join (values ('alpha', '1-URGENT', 'new', 'urgent'), ('alpha', '2-HIGH', 'hot', 'high'), ('beta', '1-URGENT', 'new', 'fresh'), ('beta', '5-LOW', 'tail', 'low')) k(platform, rank_family, family, sub_cat) using (platform, rank_family)""",
    "new_entry_table": SQL["new_entry_ratio"] + " order by new_entry_ratio desc, platform, tag_u limit 30",
    "title_aliases": STAR + """select novel_uid, p_name as title, 1 as is_primary, case when novel_uid % 4 = 2 then greatest(last_seen_date, date '1999-06-01') else last_seen_date end as last_seen_date from novels
union all select novel_uid, p_name || ' II', 0, date '1999-06-01' from novels where novel_uid % 4 = 0""",
    # an introduction or title that isn't equal (but for the suffix) counts as its upper bound: it can neither win nor reach the threshold then
    "resolve_items": STAR + """, i as (select novel_uid, platform, author_norm, main_category, last_seen_date, list_distinct(list_filter(string_split(lower(p_name), ' '), lambda x: x <> '')[:5]) as sig, lower(p_name) as title, intro_norm,
    list_distinct(list_filter(string_split(intro_norm, ' '), lambda x: x <> '')) as words, novel_uid % 3 as kind,
    case when novel_uid % 3 = 0 then platform_novel_id else 'new' || platform_novel_id end as platform_novel_id from (select n.*, lower(intro) as intro_norm, lower(author) as author_norm from novels n)
), j as (select a.platform, a.platform_novel_id, b.novel_uid, b.last_seen_date, a.main_category = b.main_category as same, len(list_intersect(a.sig, b.sig)) / len(list_distinct(list_concat(a.sig, b.sig))) as chapters,
    case when a.kind = 1 then len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words))) else 0 end as jaccard,
    case when a.kind = 1 and a.intro_norm = b.intro_norm then 1.0 when a.kind = 1 then 2.0 * least(length(a.intro_norm), length(b.intro_norm)) / (length(a.intro_norm) + length(b.intro_norm)) else 2.0 * least(19, length(b.intro_norm)) / (19 + length(b.intro_norm)) end as ratio,
    case when a.title = b.title then 2.0 * length(a.title) / (2 * length(a.title) + 3) else 1.0 end as title
  from i a join i b on a.platform = b.platform and a.author_norm = b.author_norm and list_has_any(a.sig, b.sig) where a.kind > 0
), k as (select *, 0.65 * (0.65 * jaccard + 0.35 * ratio) + 0.25 * chapters + 0.10 * title + case when same then 0.03 else 0 end as score from j
), m as (select *, row_number() over (partition by platform, platform_novel_id order by round(score, 9) desc, last_seen_date desc, novel_uid) as n from k where score >= 0.84)
select i.platform, i.platform_novel_id, case when i.kind = 0 then i.novel_uid else m.novel_uid end as novel_uid, case when i.kind = 0 then 'id' when m.novel_uid is not null then 'similarity' end as matched_by
from i left join m on m.platform = i.platform and m.platform_novel_id = i.platform_novel_id and m.n = 1 and i.kind > 0""",
}
SQL = {k: "with " + v for k, v in SQL.items()}
SQL["category_split"] = """select p_partkey, case when p_partkey % 2 = 0 then p_type when starts_with(p_type, 'STANDARD') then 'STANDARD' when starts_with(p_type, 'SMALL') then 'SMALL' when starts_with(p_type, 'MEDIUM') then 'MEDIUM'
  when contains(p_type, 'BRUSHED') or contains(p_type, 'PLATED') then 'Surface' else p_type end as main,
  case when p_partkey % 2 = 0 then p_brand when starts_with(p_type, 'STANDARD') then nullif(trim(substr(p_type, 9)), '') when starts_with(p_type, 'SMALL') then nullif(trim(substr(p_type, 6)), '') when starts_with(p_type, 'MEDIUM') then nullif(trim(substr(p_type, 7)), '')
  when contains(p_type, 'BRUSHED') then 'BRUSHED' when contains(p_type, 'PLATED') then 'PLATED' end as sub from part"""
SQL["tag_split"] = r"""with t as (select p_partkey, p_brand, list_append(list_filter(regexp_split_to_array(replace(p_name, ' ', ',、|；') || ' , ' || p_type, '[,|/；;、\s]+'), lambda x: x <> ''), p_brand) as tags from part)
select p_partkey, array_to_string(list_filter(list_distinct_ordered, lambda x: x <> p_brand), '/') as tags, len(tags) as n_tags
from (select *, list_filter(tags, lambda x, i: list_position(tags, x) = i) as list_distinct_ordered from t)"""
SQL["cross_platform_both"] = f"select * from ({SQL['cross_platform_diff']}) where presence = 'both'"
SQL["report_sections"] = " union all ".join(f"select '{name}' as section, count(*) as n_rows, string_agg(coalesce({label}, '-'), ',' order by coalesce({label}, '-')) as labels from ({SQL[query]})"
  for name, query, label in (("tags", "tag_summary_topk", "tag_u"), ("lists", "list_structure_b", "rank_family"), ("platforms", "cross_platform_diff", "cat_u")))
SQL["detail_work_list"] = "with " + STAR + "select platform, novel_uid from novels where novel_uid % 4 = 1 or novel_uid % 5 = 0 or novel_uid % 6 = 0 or novel_uid % 7 = 0"
_ROWS = {
    "novels": ("novels", "platform, platform_novel_id, author, replace(lower(author), '#', ' '), intro, lower(intro), main_category, status, total_words, url, '{\"intro_sha1\":\"' || sha1(lower(intro)) || '\"}', created_date, last_seen_date"),
    "novel_titles": ("novels", "platform, platform_novel_id, p_name, lower(p_name), 1, created_date, last_seen_date"),
    "tags": ("tags", "tag_name, replace(tag_norm, '#', ' ')"),
    "novel_tag_map": ("novel_tag_map join novels using (novel_uid) join tags using (tag_id)", "platform, platform_novel_id, replace(tag_norm, '#', ' ')"),
    "rank_lists": ("rank_lists", "platform, rank_family, rank_sub_cat, source_url"),
    "rank_snapshots": ("rank_snapshots join rank_lists using (rank_list_id)", "platform, rank_family, rank_sub_cat, snapshot_date, item_count"),
    "rank_entries": ("placed p join novels n using (novel_uid)", "p.platform, platform_novel_id, rank_family, snapshot_date, rank, metric, '{\"source_url\":\"https://example.org/' || p.platform || '\"}'"),
}
SQL["save_snapshot_rows"] = "with " + STAR + " union all ".join(f"select '{name}' as table_name, count(*) as n_rows, cast(coalesce(sum(cast('0x' || substr(md5(concat_ws('|', {columns})), 1, 8) as bigint)), 0) as bigint) as checksum from {source}" for name, (source, columns) in _ROWS.items())
for _name, _of in (("tag_panel_merged", "tag_panel"), ("category_panel_merged", "category_panel")):
    # lists by month, panels by year
    SQL[_name] = SQL[_of].replace("date_trunc('year', o_orderdate)", "date_trunc('month', o_orderdate)").replace("snapshot_date as period", "cast(date_trunc('year', snapshot_date) as date) as period")

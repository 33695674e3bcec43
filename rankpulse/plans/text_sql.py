"""DuckDB SQL of the queries over documents, pages, conversations and events."""


def _norm(x: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


def _tokens(x: str) -> str:
    return f"list_distinct(list_filter(string_split({_norm(x)}, ' '), lambda t: t <> ''))"


def _collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _visible(x: str) -> str:
    s = f"coalesce({x}, '')"
    for pattern in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>"):
        s = f"regexp_replace({s}, '{pattern}', ' ', 'g')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        s = f"replace({s}, '{entity}', '{char}')"
    return _collapse(s)


def _element(tag: str) -> str:
    return _visible(rf"regexp_extract(coalesce(html, ''), '(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>', 1)")


def _meta(name: str) -> str:
    return rf"""regexp_extract(coalesce(html, ''), '(?is)<meta\s+(?:property|name)=["'']{name}["'']\s+content=["''](.*?)["'']', 1)"""


def _all(tag: str) -> str:
    return rf"regexp_extract_all(coalesce(html, ''), '(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>', 1)"


LINK = r"""(?is)<a\s[^>]*?href=["'']([^"'']*)["''][^>]*>(.*?)</a>"""

SQL = {
    "text_normalize": f"select doc_id, md5(t) as norm_md5, length(t) as norm_chars from (select doc_id, {_norm('text')} as t from documents)",
    "tokenize_jaccard": f"""select doc_id, len(a) as n_first, len(b) as n_second,
  round(case when len(a) = 0 and len(b) = 0 then 1.0 else len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::double end, 6) as similarity
from (select doc_id, {_tokens('substr(text, 1, length(text) // 2)')} as a, {_tokens('substr(text, length(text) // 2 + 1)')} as b from documents)""",
    "content_hash": f"select doc_id, sha1({_norm('source')} || chr(10) || {_norm('substr(text, 1, 4000)')}) as content_hash from documents",
    "cn_number": "select doc_id, case n_chars % 3 when 0 then cast(trunc(cast(printf('%.2f', n_chars / 100.0) as double) * 10000.0) as bigint) when 1 then n_chars else (n_chars % 90 + 1) * 100000000 end as number from documents",
    "labelled_number": "select doc_id, n_chars as number, length(text) as words from documents",
    "date_from_text": "select o_orderkey, case when o_orderkey % 4 = 3 then null else strftime(o_orderdate, '%Y-%m-%d') end as found, case when o_orderkey % 4 = 3 then null else cast(o_orderdate as date) end as day from orders",
    "status_norm": "select o_orderkey, case when o_orderstatus = 'F' then '完本' else '连载' end as status from orders",
    "url_fields": r"""with p as (select *, regexp_extract(url, '^https?://[^/]*(.*)$', 1) as path from pages)
select page_id, case when path = '' then '' when starts_with(path, '//') then 'https:' || path when starts_with(path, '/') then 'https://example.org' || path else 'https://example.org/' || path end as absolute,
  coalesce(nullif(regexp_extract(url, '/(\d{4})\?', 1), ''), nullif(regexp_extract(url, '/(\d+)$', 1), ''),
    list_filter(string_split(regexp_extract(url, '^(?:https?://[^/?#]*)?([^?#]*)', 1), '/'), lambda x: regexp_full_match(x, '\d{6,}'))[-1], '') as found_id,
  case when contains(url, 'utm_source=') then url else url || case when contains(url, '?') then '&' else '?' end || 'utm_source=x' end as tracked,
  case when contains(url, 'enter_from=') then url else url || case when contains(url, '?') then '&' else '?' end || 'enter_from=y' end as marked from p""",
    "char_map": "select doc_id, md5(translate(text, 'aeiouäöü', '43102AOU')) as mapped_md5 from documents",
    "char_count": r"select doc_id, length(regexp_replace(text, '[^\x{4e00}-\x{9fff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}]', '', 'g')) + 1 + doc_id % 7 as ideographs from documents",
    "line_cleanup": r"""select doc_id, md5(c) as clean_md5, length(c) as chars from (
  select doc_id, array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10) || chr(10)) as c from documents)""",
    "first_n_turns": "select conv_id, turn, n as number from (select conv_id, turn, row_number() over (partition by conv_id order by turn) as n from conversations) where n between 2 and 4",
    "merge_renumber": "select conv_id, turn, role, n as number from (select conv_id, turn, role, row_number() over (partition by conv_id order by turn, turn % 2) as n from conversations) where n <= 5",
    "work_list": "select conv_id as novel_uid, count(*) as n_chapters, max(turn) as max_chapter from conversations group by conv_id having count(*) < 5",
    "upsert_chapters": """select conv_id as novel_uid, cast(turn as integer) as chapter_num, cast(length(text) + case when conv_id % 2 = 0 then 1 else 0 end as integer) as word_count,
  case when conv_id % 2 = 0 then date '2026-01-02' else date '2026-01-01' end as publish_date from conversations where conv_id % 2 = 0 or turn % 2 = 0""",
    "signature_merge": f"""select conv_id, case when conv_id % 3 = 0 then '{{"chapter_title_sig":["stored"]}}'
  else '{{"chapter_title_sig":["' || array_to_string(list_filter(list_transform(list(role order by turn)[1:5], lambda x: {_norm('x')}), lambda x: x <> ''), '","') || '"]}}' end as signature_json from conversations group by conv_id""",
    "priority_match": """with d as (select doc_id, lang, source, n_chars, sha1(text) as h from documents), m as (select quantile_disc(doc_id, 0.5) as m from d),
s as (select d.* from d, m where doc_id < m), a as (select h, min(doc_id) as u from s group by h), b as (select lang, source, n_chars, min(doc_id) as u from s group by all)
select d.doc_id, coalesce(a.u, b.u) as matched_uid, case when a.u is not null then 0 when b.u is not null then 1 end as matched_rule from m, d left join a on a.h = d.h left join b on b.lang = d.lang and b.source = d.source and b.n_chars = d.n_chars where d.doc_id >= m""",
    "word_match": f"""with d as (select doc_id, lang, source, {_tokens('text')} as t from documents),
p as (select a.doc_id, b.doc_id as uid, case when len(a.t) = 0 and len(b.t) = 0 then 1.0 else len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))::double end as score
  from d a join d b on a.lang is not distinct from b.lang and a.source is not distinct from b.source and a.doc_id <> b.doc_id)
select doc_id, uid as matched_uid, round(score, 6) as score from (select *, row_number() over (partition by doc_id order by score desc, uid) as n from p where score >= 0.7) where n = 1""",
    "raw_dump_roundtrip": "select page_id, regexp_extract(url, '^https?://([^/]*)', 1) as site, md5(html) as html_md5 from pages",
    "page_text": f"select page_id, length(t) as chars, md5(t) as text_md5 from (select page_id, {_visible('html')} as t from pages)",
    "page_fields": f"""select page_id, coalesce(nullif({_meta('og:title')}, ''), nullif(string_split({_element('title')}, ' - ')[1], ''), nullif({_element('h1')}, ''), '') as title,
  regexp_extract(coalesce(html, ''), '(?is)<html[^>]*\\slang=["'']([^"'']*)["'']', 1) as lang, {_meta('description')} as description, length(coalesce(html, '')) as html_chars from pages""",
    "page_quality": f"""select page_id, reason, reason = 'ok' as good from (select page_id, case when length(coalesce(html, '')) < 800 then 'too_short'
  when contains(t, 'captcha') or contains(t, '验证码') or contains(t, 'access denied') or contains(t, '人机验证') then 'keyword'
  when contains(title, '404') or contains(title, '403') or contains(title, 'forbidden') or contains(title, 'not found') then 'bad_title'
  when regexp_matches(html, '(?i)http-equiv=["'']refresh') then 'refresh' when length(t) < 50 then 'little_text' else 'ok' end as reason
from (select page_id, html, lower({_visible('html')}) as t, lower({_element('title')}) as title from pages))""",
    "page_links": f"""with l as (select page_id, unnest(range(1, len(h) + 1)) as i, unnest(h) as href, unnest(t) as label
  from (select page_id, regexp_extract_all(coalesce(html, ''), '{LINK}', 1) as h, regexp_extract_all(coalesce(html, ''), '{LINK}', 2) as t from pages)),
f as (select *, row_number() over (partition by page_id, href order by i) as n from l)
select page_id, cast(row_number() over (partition by page_id order by i) as integer) as position, href, {_visible('label')} as label from f where n = 1""",
    "page_items": f"""with f as (select page_id, url, case when len({_all('li')}) >= 3 then {_all('li')} when len({_all('p')}) >= 3 then {_all('p')} end as items from pages),
r as (select page_id, coalesce(try_cast(nullif(regexp_extract(url, '[?&]page=(\\d+)', 1), '') as integer), 1) as page_no, unnest(range(1, len(items) + 1)) as i, unnest(items) as item from f where items is not null)
select page_id, cast(i as integer) as position, cast((page_no - 1) * 20 + i as integer) as rank, {_visible('item')} as title, regexp_extract(item, '(?is)href=["'']([^"'']*)["'']', 1) as href from r""",
    "page_body": f"""select page_id, array_to_string(list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'),
  '(?is)<p(?:\\s[^>]*)?>(.*?)</p>', 1), lambda x: {_visible('x')}), lambda x: length(x) > 10), chr(10) || chr(10)) as body from pages""",
    "page_category": f"""select page_id, list_filter(['The', 'and', 'Nicht', 'de', 'la'], lambda w: list_contains(labels, w))[1] as category
from (select page_id, list_transform(regexp_extract_all(coalesce(html, ''), '(?is)<a\\s[^>]*>(.*?)</a>', 1), lambda x: {_visible('x')}) as labels from pages)""",
    "stream_daily_panel": "select cast(ts as date) as day, event_type, count(*) as n_events, count(distinct user_id) as n_users, round(avg(value), 6) as mean_value from events group by 1, 2",
    "stream_monthly_panel": "select cast(date_trunc('month', ts) as date) as month, event_type, count(*) as n_events, round(avg(value), 6) as mean_value from events group by 1, 2",
    "stream_replays": "select event_id, user_id, event_type from events",
    "stream_late_days": """select cast(ts as date) as day, event_type, count(*) as n_events, count(distinct user_id) as n_users, round(avg(value), 6) as mean_value,
  case when event_id % 50 = 0 and ts < (select max(ts) from events where event_id % 50 <> 0) - interval 30 day then 'quarantine' else 'panel' end as side from events group by 1, 2, side""",
    "stream_dedupe": "select user_id, event_type, arg_min(event_id, (ts, event_id)) as event_id from events group by user_id, event_type",
    "stream_upsert": "select user_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(value, (ts, event_id)) as value from events group by user_id",
    "late_split": """select event_type, count(*) as n, case when ts < (select max(ts) from events) - interval 30 day then 'quarantine' else 'kept' end as side from events group by all""",
}
SQL["page_items_once"] = f"""select page_id, position, rank, title, href from (
  select i.*, row_number() over (partition by coalesce(nullif(href, ''), url, '') order by rank, i.page_id) as n from ({SQL['page_items']}) i join pages using (page_id)) where n = 1"""
SQL["chapter_items"] = """select cast(conv_id as varchar) as platform_novel_id, case when conv_id % 3 = 0 then date '2026-01-01' else cast(date '2026-02-01' + cast(min(turn) as integer) as date) end as created_date,
  case when conv_id % 3 <> 0 then coalesce(max(case when conv_id % 2 = 0 then 'talk ' || conv_id end), 'unknown') end as title, case when conv_id % 3 <> 0 then 1 end as is_primary,
  nullif(count(distinct case when turn >= 0 and trim(coalesce(role, '')) <> '' then turn end), 0) as n_chapters from conversations group by conv_id"""
SQL["stream_ingest"] = """select 'u' || user_id as platform_novel_id, cast(min(ts) as date) as created_date, cast(max(ts) as date) as last_seen_date, count(distinct (event_type, cast(ts as date))) as n_entries
from events where user_id is not null group by user_id"""
SQL["late_recompute"] = "select cast(ts as date) as day, event_type, count(*) as n_events, count(distinct user_id) as n_users, round(avg(value), 6) as mean_value from events group by 1, 2"
_URL = "case when href = '' then '' when starts_with(href, 'http://') or starts_with(href, 'https://') then href when starts_with(href, '//') then 'https:' || href when starts_with(href, '/') then 'https://base.example' || href else 'https://base.example/' || href end"
_ITEMS = "string_split_regex({}, '(?is)<li(?:\\s[^>]*)?>')"
SQL["page_entries"] = f"""with f as (select page_id, url, {_ITEMS.format("string_split_regex(html, '(?is)</ul>')[1]")}[2:] as items from pages where html is not null),
r as (select page_id, url as page_url, unnest(range(1, len(items) + 1)) as i, unnest(items) as item from f),
l as (select *, trim(regexp_extract(item, '(?is)<a\\s[^>]*?href=["'']([^"'']*/[^"'']*)["''][^>]*>(.*?)</a>', 1)) as href, {_visible("regexp_extract(item, '(?is)<a\\s[^>]*?href=[\"'']([^\"'']*/[^\"'']*)[\"''][^>]*>(.*?)</a>', 2)")} as title from r),
u as (select *, {_URL} as url from l), k as (select *, regexp_extract(url, '/([^/?#]+)$', 1) as id from u where url <> ''),
g as (select *, count(*) over (partition by page_id) as n from k where id <> '')
select page_id, cast(i as integer) as position, cast((coalesce(try_cast(nullif(regexp_extract(page_url, '[?&]page=(\\d+)', 1), '') as integer), 1) - 1) * 30 + i as integer) as rank, title, url, id,
  case when page_id % 3 = 0 then 'A ' || page_id else '未知' end as author, '连载' as status, cast(0 as bigint) as metric from g where n >= 3"""
SQL["page_detail"] = f"""with p as (select *, contains(coalesce(html, ''), '</head><body>') as more from pages)
select page_id, coalesce(nullif({_meta('og:title')}, ''), nullif({_element('h1')}, ''), '') as title, case when more then 'A ' || page_id else '' end as author,
  coalesce(nullif({_meta('og:description')}, ''), {_visible("regexp_extract(coalesce(html, ''), '(?is)<div class=\"ad\">(.*?)</div>', 1)")}) as intro,
  case when more then 'main' else '' end as category, case when more then 't' || page_id % 5 else '' end as tags, case when more then case when page_id % 2 = 0 then '完本' else '连载' end end as status,
  case when more then cast((page_id % 90 + 1) * 10000 + 5000 as bigint) end as words, case when more then strftime(date '2026-01-01' + cast(page_id % 28 as integer), '%Y-%m-%d') end as publish_date from p"""
SQL["page_chapters"] = f"""with v as (select page_id, unnest(range(1, len(l) + 1)) as k, unnest(l) as volume from (select page_id, string_split_regex(coalesce(html, ''), '(?is)<ul(?:\\s[^>]*)?>')[2:] as l from pages)),
w as (select page_id, k, {_ITEMS.format('volume')}[2:] as items, {_visible("regexp_extract(volume, '(?is)<h3(?:\\s[^>]*)?>(.*?)</h3>', 1)")} as name from v),
c as (select page_id, arg_min(items, k) as items from w where len(items) >= 5 and not contains(name, '作品相关') group by page_id),
r as (select page_id, unnest(range(1, len(items) + 1)) as i, unnest(items) as item from c),
l as (select page_id, i, trim(regexp_extract(item, '(?is)<a\\s[^>]*?href=["'']([^"'']*)["'']', 1)) as href, {_visible("regexp_extract(item, '(?is)<a(?:\\s[^>]*)?>(.*?)</a>', 1)")} as title from r),
u as (select page_id, i, {_URL} as url, title from l), o as (select page_id, url, min(i) as i, arg_min(title, i) as title from u where url <> '' group by page_id, url)
select page_id, cast(row_number() over (partition by page_id order by i) as integer) as position, url, title from o"""
SQL["word_match_newest"] = SQL["word_match"].replace("from d a join d b on", "from d a join (select * from (select *, row_number() over (partition by lang, source order by doc_id) as place from d) where place <= 20) b on")
_BODY = "pages where html is not null and contains(html, '<body>')"
SQL["page_breadcrumb"] = f"""select page_id, cast(p as integer) as position, ['https://base.example/a', 'https://base.example/b/' || page_id, 'https://base.example/c'][p] as url, ['Top', 'Shelf ' || page_id, 'Here'][p] as label
from (select page_id, unnest([1, 2, 3]) as p from {_BODY})"""
SQL["page_nested"] = f"select page_id, cast(p as integer) as position, ['one two ' || page_id || ' three', 'two ' || page_id, ''][p] as text from (select page_id, unnest([1, 2, 3]) as p from {_BODY})"

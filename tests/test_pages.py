"""Hand-made list, detail and catalogue pages."""

from rankpulse.operators import pages

LIST = """<body><div class="x rank-book-item"><h3><a href="/page/11">One</a></h3><span class="author">Ann</span><p class="desc abstract">An <b>intro</b></p>
<span class="status">已完结</span><i class="book-item-count">在读：12.5万人</i><em class="info-label-grey">city</em></div>
<div class="rank-book-item"><a href="/page/12">Two</a> 在读: 3,400</div><div class="rank-book-item">no link</div><div class="rank-book-item"><a href="/page/13?x=1">Three</a></div><footer><b class="author">no one</b></footer></body>"""
DETAIL = """<html><meta property="og:title" content="Meta title"><h1>Other</h1><div class="author">Ann</div><div class="intro">Text</div>
<div class="info-label"><span class="info-label-yellow">连载中</span><span class="info-label-grey">city</span><span class="info-label-grey">magic</span><span class="info-label-grey">city</span></div>
<div class="info-count-word"><span class="detail">12.5</span><span class="text">万字</span></div>更新时间：2026年1月5日 2020-01-01</html>"""


def test_list_page(spark):
    rows = [(1, "https://x/?page=2", LIST), (2, None, None), (3, "u", "<p>none</p>")]
    got = pages.page_entries(spark.createDataFrame(rows, "page_id long, url string, html string"), base="https://x").orderBy("position").collect()
    assert [(r["page_id"], r["position"], r["rank"], r["title"], r["url"], r["id"]) for r in got] == [
        (1, 1, 31, "One", "https://x/page/11", "11"), (1, 2, 32, "Two", "https://x/page/12", "12"), (1, 4, 34, "Three", "https://x/page/13?x=1", "13")]
    assert [(r["author"], r["intro"], r["status"], r["metric"], r["tags"]) for r in got] == [("Ann", "An intro", "完本", 125000, ["city"]), ("未知", "", "连载", 3400, []), ("未知", "", "连载", 0, [])]


def test_detail_page(spark):
    rows = [(1, DETAIL), (2, None), (3, '<div class="info-label"><span class="info-label-yellow">完本</span><span>a</span></div><i class="state">x</i>字数: 3.5万 2024.3.7')]
    got = {r["page_id"]: r.asDict() for r in pages.page_detail(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert got[1] == {"page_id": 1, "title": "Meta title", "author": "Ann", "intro": "Text", "category": "city", "tags": ["magic"], "status": "连载", "words": 125000, "publish_date": "2026-01-05"}
    assert got[2] == {"page_id": 2, "title": "", "author": "", "intro": "", "category": "", "tags": [], "status": None, "words": None, "publish_date": None}
    assert (got[3]["category"], got[3]["status"], got[3]["words"], got[3]["publish_date"]) == ("a", "完本", 35000, "2024-03-07")


def test_catalogue(spark):
    item = lambda i: f'<li class="chapter-item"><a href="/c/{i}">C {i}</a></li>'
    volume = lambda name, ids: f'<div class="catalog-volume"><h3>{name}</h3><ul>{"".join(map(item, ids))}</ul></div>'
    html = volume("作品相关", range(100, 112)) + volume("short", range(3)) + volume("body", [*range(10), 3, 10]) + volume("later", range(50, 70))
    got = pages.page_chapters(spark.createDataFrame([(1, html), (2, None), (3, volume("short", range(3)))], "page_id long, html string")).orderBy("position").collect()
    assert [(r["page_id"], r["position"], r["url"], r["title"]) for r in got] == [(1, i + 1, f"/c/{i}", f"C {i}") for i in range(11)]


def test_nested_elements(spark):
    """An element ends where its own end tag is; comments, scripts, elements that are never ended and unfinished pages don't disturb."""
    html = """<div class="a">x<div>y<p>z</div><!-- </div> --><script>"</div>"</script><br/>t</div><div class="a b">u<img src="q"><DIV>v</DIV></div><div class="a">open <b>end"""
    rows = [(1, html), (2, None), (3, ""), (4, "no tags"), (1, html)]
    stream = pages.tag_stream(spark.createDataFrame(rows, "page_id long, html string"))
    found = pages.element_html(stream, pages.elements(stream, pages.has_class(["a"]))).orderBy("_row", "first").collect()
    texts = ['x<div>y<p>z</div><!-- </div> --><script></script><br/>t', 'u<img src="q"><DIV>v</DIV>', "open <b>end"]
    assert [(r.page_id, r.html) for r in found] == [(1, t) for t in texts] * 2


def test_breadcrumb(spark):
    html = '<a href="/0">no</a><ul class="crumbs"><li><a href="/1">One</a><ul><li><a class="k" href="/2"> T<i>wo</i></a></li></ul></li></ul><div class="crumbs"><a href="/3">x</a></div>'
    got = pages.page_breadcrumb(spark.createDataFrame([(1, html), (2, "<a href='/9'>x</a>"), (3, None)], "page_id long, html string"), base="https://x").orderBy("position").collect()
    assert [(r.page_id, r.position, r.url, r.label) for r in got] == [(1, 1, "https://x/1", "One"), (1, 2, "https://x/2", "T wo")]

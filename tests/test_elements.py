"""Pages written by hand, nested and loose, through the element table."""

import datetime
import html.parser
import random

from pyspark.sql import functions as F

from fairground.sources import elements as E

D = datetime.date


def frame(spark, rows, kind="page_id long, kind string, url string, html string"):
    return spark.createDataFrame(rows, kind)


WEBINARS = """<ul><li class="bd-wrap x"><div class="cover"><div>img</div></div><div class="activity-info"><h3><a target=_blank href="/webinar/1.html?utm_source=a">芯片<b>研讨</b>会</a></h3>
<p>时间 <span>2026年9月14日</span></p></div><span class="status">报名中</span><li class="bd-wrap"><div class="activity-info"><h3><a href="/webinar/2.html">旧</a></h3><p><span>2026/9/1</span></p></div><i class="status">精彩回放</i></li>
<li class="bd-wrap"><h3>no info</h3></li></ul>"""
REGIONS = """<div class="hot"><div class="activity"><div class="card"><div class="card-meta"><a class="tag" href="#">t</a><a class="initial" href="e/5">硬件之夜</a></div><div class="card-times">9月14日</div></div></div></div>
<div class="regular-events-list"><div class="event-item"><div class="card-meta"><a href="/x/e/5" class="big initial">硬件之夜</a></div><div class="card-times">2026.9.14 - 9.15</div><span class="status">活动取消</span></div></div>
<div class="event-item"><div class="card-meta"><a class="initial" href="/x/e/6">outside</a></div></div>"""
TIMED = """<main><article><h3><a href="https://t.example.com/e/1">Show</a></h3><p>about<time datetime="2026-09-14T10:00:00+08:00">x</time><time datetime=2026-09-15>y</time><span><span>￥99</span></span><span>免费</span><span>送99元</span>
<a href="/org/7">Org</a><p>Hall <b>3</b></p></article><article><h3>no link</h3></article></main>"""


def test_cards_of_nested_layouts(spark):
    rows = [(1, "webinars", "https://w.example.com/list", WEBINARS), (2, "regions", "https://r.example.com/x/", REGIONS), (3, "timed", "https://t.example.com/", TIMED)]
    rows += [(4, "labelled", "https://l.example.com/", '<div data-url="/a/1" class="main-single-block"><div class="main-single-block-title">灯会</div><div><span class="main-single-block-des">活动时间</span> 2026年9月14日至16日</div><div><span class="main-single-block-des">活动地址</span>公园</div></div>')]
    rows += [(5, "icons", "https://i.example.com/", '<a href="/event/9"><h3>Meetup</h3><div><i i-carbon-calendar></i>2026-09-14</div><div><span i-carbon-location></span>深圳</div></a>')]
    rows += [(6, "entries", "https://d.example.com/", '<ul><li class="list-entry"><div class=title><a href="/event/12/">T</a></div><time content="2026-09-14" itemprop="startDate">x</time></li><li class="list-entry"><div class=title><a href="/people/1">P</a></div></li></ul>')]
    rows += [(7, "results", "https://h.example.com/", '<div class="search-tab-content-item"><div><div><a class="item-title" href="//h.example.com/e/1">R</a></div></div><div class="item-data">2026.9.14-9.16</div><div class="item-dress">here</div></div>')]
    rows += [(8, "posters", "https://p.example.com/", '<a href="/activity/poster?id=1"><div class="title">A</div>2026/09/14</a><a href="/activity/poster?id=2"><h3>B</h3>成都柴火 2026/09/14</a>'), (9, "unheard", "https://p/", "<a>"), (10, "timed", None, None)]
    got = [(r.page_id, r.title, r.link.rpartition("/")[2] if r.link else "", r.start, r.end, r.place, r.reject) for r in E.site_cards(frame(spark, rows)).orderBy("page_id", "pos").collect()]
    assert got == [
        (1, "芯片研讨会", "1.html", D(2026, 9, 14), D(2026, 9, 15), "线上", None), (1, "旧", "2.html", D(2026, 9, 1), D(2026, 9, 2), "线上", "ended"), (1, "", "", None, None, "线上", "title"),
        (2, "硬件之夜", "5", None, None, "", "repeated"), (2, "硬件之夜", "5", D(2026, 9, 14), D(2026, 9, 16), "", None),
        (3, "Show", "1", D(2026, 9, 14), D(2026, 9, 16), "Hall 3", None), (3, "", "", None, None, "", "title"),
        (4, "灯会", "1", D(2026, 9, 14), D(2026, 9, 17), "公园", None), (5, "Meetup", "9", D(2026, 9, 14), D(2026, 9, 15), "深圳", None),
        (6, "T", "", D(2026, 9, 14), D(2026, 9, 15), "", None), (6, "P", "1", None, None, "", "link"), (7, "R", "1", D(2026, 9, 14), D(2026, 9, 17), "here", None),
        (8, "A", "poster?id=1", D(2026, 9, 14), D(2026, 9, 15), "", None), (8, "B", "poster?id=2", D(2026, 9, 14), D(2026, 9, 15), "", "elsewhere"),
    ]
    assert [(r.organizer, r.fee, r.status) for r in E.site_cards(frame(spark, rows)).where("page_id in (2, 3) and reject is null").orderBy("page_id").collect()] == [("", "", "cancelled"), ("Org", "免费 / ￥99", "scheduled")]


def test_details_with_split_labels(spark):
    page = """<meta property="og:image" content="/own.png"><nav>主办方：not this</nav><article><div><p><b>主办</b>方<span>：</span>A<i>B</i></p><p>主办单位：later</p><dl><dt>协办单位</dt><dd>：C</dd></dl>
    <p>指导单位：</p><p>：</p><p>D</p><p>支持单位：活动费用：<p>活动费用：<span>199</span> 元</p><p>费用：扫码查看</p><img alt="QR" src="/qr.png"><img data-src="https://i.example.com/a.png" src="x"><img src="http://127.0.0.1/x.png"><img src="/own.png"></div></article>"""
    got = E.page_details(frame(spark, [(1, "", "https://a.example.com/e/1", page), (2, "", "https://a/", None)])).orderBy("page_id").collect()
    assert tuple(got[0])[:6] == (1, "AB", "C", "D", "", "199 元") and got[0].pictures == ["https://a.example.com/own.png", "https://i.example.com/a.png"]
    assert tuple(got[1])[:6] == (2, "", "", "", "", "") and got[1].pictures == []


def test_recurring_details(spark):
    body = '<div class="event-brief-info"><div class="card-items">2026.9.14 14:00-16:00</div><div class="card-items">深圳</div></div><div class="medium-editor-content correlation-center"><p>时间：2026年9月14日 {0}</p><p>地点：科技园</p><p>主办方：甲</p><p>主办：乙</p><h3>往届活动和嘉宾</h3><p>活动费用：99</p></div>'
    rows = [(1, "regions", body.format("14:00 - 16:00")), (2, "regions", body.format("15:00-17:00")), (3, "docs", '<div class="vp-doc"><p>参会费用：免费</div>'), (4, "regions", "<p>"), (5, "other", body)]
    got = E.recurring_details(frame(spark, rows, "page_id long, kind string, html string")).orderBy("page_id").collect()
    clock = datetime.datetime(2026, 9, 14, 14)
    assert [(r.organizer, r.fee, r.place, r.start, r.conflict, r.found) for r in got] == [("", "", "科技园", clock, False, True), ("", "", "科技园", None, True, True), ("", "免费", "", None, False, True), ("", "", "", None, False, False), ("", "", "", clock, False, False)]


def test_cancellation_scan(spark):
    card = '<li class="section-special-item" data-post-id="{0}"><div><a class="item-title" href="/e/{0}">T{0}</a></div><span class="event-status">{1}</span><div class="event-time">{2}</div></li>'
    notices = [("已取消", "活动时间：2026年9月14日 14:00-16:00 北京时间"), ("部分场次取消", ""), ("恢复举办后，本次9月14日活动再次取消", "报名时间：2026/9/1"), ("“已取消”不实", ""), ("取消", "2026年9月14日"), ("本次活动已取消举办！", "推广 9月1日"), ("取消", "9月1日 9月2日"), ("取消", "直播时间：2026年2月30日"), ("取消", "活动时间：2026年9月14日 16:00-14:00")]
    items = "".join(card.format(k, *n) for k, n in enumerate(notices)) + '<li><ul><li class="section-special-item"><a class="item-title" href="/e/99">nested</a><i class="status">取消</i></li></ul></li>'
    page = f'<div class="special-list big"><ul class="section-list-item-ul">{items}</ul></div><ul class="section-list-item-ul">{card.format(50, "取消", "")}</ul>'
    got = E.cancellation_scan(frame(spark, [(1, "", "https://c.example.com/", page), (2, "", "https://c/", None)])).orderBy("card_key").collect()
    assert [(r.card_key, r.again, r.occurrence and str(r.occurrence), r.role) for r in got] == [("0", False, "2026-09-14", "actual_occurrence"), ("2", True, None, "registration_window"), ("4", False, None, "unknown"), ("5", False, None, "promotion_window"), ("6", False, None, "discovery_window"), ("7", False, None, "unknown"), ("8", False, None, "unknown")]


def test_microdata_in_any_order(spark):
    page = '<h1>Head</h1><meta content="2026-09-14" itemprop="startDate"><time itemprop=endDate datetime=2026-09-15>x</time><div itemprop=location><div>Hall</div> <b>3</b></div>'
    got = E.microdata_fields(frame(spark, [(1, page), (2, "<b itemprop='name'>N</b>"), (3, None)], "page_id long, html string")).orderBy("page_id").collect()
    assert [tuple(r) for r in got] == [(1, "Head", "2026-09-14", "2026-09-15", "Hall 3"), (2, "N", "", "", ""), (3, "", "", "", "")]


class Plain(html.parser.HTMLParser):
    """Well-formed pages by plain recursion over a stack."""

    def __init__(self):
        super().__init__()
        self.stack, self.found = [], []

    def handle_starttag(self, tag, attrs):
        for above in self.stack:
            above["inside"] += 1
        self.found.append({"tag": tag, "inside": 0, "text": ""})
        self.stack.append(self.found[-1])

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        for above in self.stack:
            above["text"] += data


def test_intervals_of_random_pages(spark):
    rng = random.Random(4)

    def page(depth):
        tag = rng.choice(["div", "span", "section", "b"])
        return f"<{tag}>" + "".join(page(depth - 1) if depth and rng.random() < 0.6 else f" t{rng.randrange(99)} " for _ in range(rng.randrange(4))) + f"</{tag}>"

    pages = [(k, page(5)) for k in range(40)]
    got = {(r.page_id, r.pre): r for r in E.element_rows(frame(spark, pages, "page_id long, html string")).collect()}
    for k, text in pages:
        plain, own = Plain(), E.Page(text)
        plain.feed(text)
        assert [(e["tag"], e["last"] - e["pre"], "".join(own.raw(e).split())) for e in own.elements] == [(e["tag"], e["inside"], "".join(e["text"].split())) for e in plain.found]
        assert [(got[k, n].tag, got[k, n].last) for n in range(len(plain.found))] == [(e["tag"], e["last"]) for e in own.elements]


def test_broken_pages(spark):
    for text in ("</div>" * 1000, "<div>" * 3000, "<p>a<p>b<li>c", "<", "<a href=", "<script>x</script", "<ul><li>a<ul><li>b</ul><li>c</ul>", "<table><tr><td>a<td>b<tr><td>c</table>"):
        page = E.Page(text)
        assert all(e["pre"] <= e["last"] < len(page.elements) for e in page.elements)
    lists = E.Page("<ul><li>a<ul><li>b</ul><li>c</ul>")
    assert [lists.text(e) for e in lists.every(lists.whole, E.Where("li"))] == ["a b", "b", "c"]
    assert E.element_rows(frame(spark, [(1, None)], "page_id long, html string")).count() == 0 and E.site_cards(frame(spark, [])).count() == 0


def test_addresses(spark):
    base = "https://a.example.com/x/y?q=1"
    cases = {"/z": "https://a.example.com/z", "z?a=1#f": "https://a.example.com/x/z?a=1", "//b.example.com/": "https://b.example.com/", "http://c/": "http://c/", "javascript:x()": "", "#top": "", "": "", None: "", "mailto:a@b": ""}
    got = [r.v for r in spark.createDataFrame([(u,) for u in cases], "u string").select(E.absolute(F.col("u"), F.lit(base)).alias("v")).collect()]
    assert got == list(cases.values())

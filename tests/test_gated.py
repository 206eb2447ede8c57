"""Gated inventories and details, by pages written by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from fairground.functions import grammar as W
from fairground.sources import gated as K

HOST = "www.example.com"
LIST = f"https://{HOST}/event/"
T = datetime.datetime


def card(href, title, tags="", label="", place="", time="", more=""):
    spans = "".join(f'<span class="post-tag">{t}</span>' for t in tags.split())
    return f'<li class="section-special-item"><div><a class="item-title x" href="{href}">{title}</a></div>{spans}<i class="status">{label}</i><div class="event-location">{place}</div><b class="event-time">{time}</b>{more}</li>'


def page(cards, tag="main"):
    return f'<{tag} class="special-list"><ul class="section-list-item-ul">{"".join(cards)}</ul></{tag}>'


def inventory(spark, rows):
    return K.gated_inventory(spark.createDataFrame(rows, "page_id long, url string, html string"), HOST)


def test_cards_are_kept_with_their_reasons(spark):
    cards = [
        card("/event/1.html?a=1#b", "A", "线上活动", "报名中", "线上", "活动时间：2026年9月14日 14:00-16:00"),
        card("/event/1.html", "A again", "线上"), card("/event/2.html", "", "线上"), card("https://other.example.com/event/3.html", "B"), card("/event/x.html", "B"),
        card("/live/4.html", "C", "精彩回放"), card("/event/5.html", "福利领取"), card("/event/6.html", "D", "线下活动", "已取消", "地点：深圳 科技园", "2026/9/15", '<p class="event-organizer">主办方：E</p>'),
        card("/event/7.html", "F", "线上 线下", "", "", "2026年2月30日"), card("/event/8.html", "G", "线上 线下", "", "线下活动", "推广期 9月1日 2026年9月2日", '<p class="item-intro">同步直播</p>'),
        "<li><ul>" + card("/event/9.html", "nested") + "</ul></li>",
    ]
    got = inventory(spark, [(1, LIST, page(cards))]).orderBy("pos").collect()
    assert [(r.pos, r.title, r.reject) for r in got] == [(0, "A", None), (1, "A again", "repeated"), (2, "", "title_or_link"), (3, "B", "title_or_link"), (4, "B", "title_or_link"), (5, "C", "ended"), (6, "福利领取", "promotion"), (7, "D", None), (8, "F", None), (9, "G", None)]
    a, d, f, g = (got[k] for k in (0, 7, 8, 9))
    assert (a.link, a.attendance, a.city, a.start, a.end, a.zone, a.status, a.notes) == (LIST + "1.html", "online", "线上", T(2026, 9, 14), T(2026, 9, 15), "unconfirmed", "scheduled", ["clock_without_zone"])
    assert (d.place, d.city, d.organizer, d.start, d.zone, d.status, d.place_role) == ("深圳 科技园", "深圳", "E", T(2026, 9, 15), "venue_local", "cancelled", None)
    assert (f.attendance, f.start, f.status, f.notes) == ("unknown", None, "needs_review", ["attendance_conflict"])
    assert (g.attendance, g.place, g.start, g.role, g.status, g.notes) == ("hybrid", "", None, "list_promotion_window", "needs_review", ["shown_not_held"])


def test_publishers_lists_and_pages_that_are_none(spark):
    publisher = page([card("/event/1.html", "A", "线上", place="公司：甲", time="2026年9月1日 - 2026年9月30日"), card("/event/2.html", "B", "线上", place="深圳", time="2026年9月1日")], "div")
    empty = '<i data-fixture-empty-state="true"></i>' + page([])
    rows = [(1, LIST, publisher), (2, "http://www.example.com/event/", publisher), (3, LIST, page([]) * 2), (4, LIST, page([])), (5, LIST, empty), (6, LIST, None), (7, None, page([])), (8, LIST + "?p=1", publisher), (9, LIST, page([], "div") + empty.split("<main")[0])]
    got = inventory(spark, rows).orderBy("page_id", "pos").collect()
    assert [(r.page_id, r.pos, r.reject) for r in got] == [(1, 0, None), (1, 1, None), (2, 0, "origin"), (2, 1, "origin"), (3, None, "structure"), (4, None, "empty"), (6, None, "structure"), (7, None, "origin"), (8, 0, "origin"), (8, 1, "origin"), (9, None, "empty")]
    assert [(r.place, r.place_role, r.role, r.status) for r in got[:2]] == [("", "company", "list_promotion_window", "needs_review"), ("深圳", "venue_or_mode", "list_meeting_time", "scheduled")]
    assert inventory(spark, []).count() == 0


BODY = "<body><article><h1>{title}</h1><p>活动时间：{time}</p><p>活动地点：深圳科技园</p><p>主办方：{org}</p>{more}<aside><h1>x</h1><p>主办方：no</p></aside></article></body>"
URL = LIST + "1.html"
OK = [(URL, 200, None)]
CANDIDATE = (1, URL, "Café", "甲", "", "", "offline", "2026年9月14日", "list_meeting_time")
CANDIDATES = "id long, url string, title string, organizer string, place string, summary string, attendance string, date_evidence string, role string"
CAPTURES = "capture_id long, id long, final string, html string, trace array<struct<url string, status int, location string>>"


def body(title="Café", time="2026年9月14日 14:00–16:00", org="甲", more=""):
    return BODY.format(title=title, time=time, org=org, more=more)


LIVE = f"https://{HOST}/live/1.html"
SECTION = '<div class="section-body"><div class="section-medium"><div class="details-section-title"><h1 class="title">Café</h1></div><p>主办方：outside</p><div class="article-content"><p>直播时间：2026/9/14</p><p class="current-status">已恢复举办</p></div></div></div>'
BUTTON = '<div class="video-part live"><div class="section-left"><div class="section-action"><div class="action-right"><a class="sign-btn appt-button-trigger">看回放</a></div></div></div></div>'
CASES = [
    (body(), URL, OK, CANDIDATE, [], []),
    (body(title="Other"), URL, OK, CANDIDATE, ["title"], []),
    (body(org="乙"), URL, OK, CANDIDATE, ["organizer"], []),
    (body(time="2026年9月15日"), URL, OK, CANDIDATE, ["dates", "corroboration"], []),
    (body(time="2027年9月14日"), URL, OK, CANDIDATE, ["years"], []),
    (body(time="2026年9月14日至9月16日"), URL, OK, CANDIDATE, ["dates"], []),
    (body(time="2026年9月14日至9月16日"), URL, OK, (*CANDIDATE[:8], "list_promotion_window"), [], []),
    (body(more="<p>资料下载</p>"), URL, OK, CANDIDATE, ["semantics"], []),
    (body(more="<div class=related>资料下载</div>"), URL, OK, CANDIDATE, [], []),
    (body(more="<h1>two</h1>"), URL, OK, CANDIDATE, ["identity"], ["title"]),
    (body() * 2, URL, OK, CANDIDATE, ["identity"], ["title", "replay", "semantics", "organizer", "dates", "years", "corroboration"]),
    (None, URL, OK, CANDIDATE, ["identity"], ["title", "replay", "semantics", "organizer", "dates", "years", "corroboration"]),
    (body(), URL, [], CANDIDATE, ["trace"], []),
    (body(), URL, None, CANDIDATE, ["trace"], []),
    (body(), URL, [(URL, 404, None)], CANDIDATE, ["trace"], []),
    (body(), LIST + "2.html", [(URL, 302, "2.html"), (LIST + "2.html", 200, None)], CANDIDATE, [], []),
    (body(), LIST + "2.html", [(URL, 302, "2.html?utm_source=x"), (LIST + "2.html", 200, None)], CANDIDATE, ["trace"], []),
    (body(), LIST + "2.html", [(URL, 302, "https://other.example.com/event/2.html"), (LIST + "2.html", 200, None)], CANDIDATE, ["trace"], []),
    (body(), LIST + "3.html", [(URL, 302, "2.html"), (LIST + "3.html", 200, None)], CANDIDATE, ["trace"], []),
    (body(), URL, [(URL, 302, "1.html")] * 5 + OK, CANDIDATE, ["trace"], []),
    (SECTION, LIVE, [(LIVE, 200, None)], (1, LIVE, *CANDIDATE[2:]), [], []),
    (BUTTON + SECTION, LIVE, [(LIVE, 200, None)], (1, LIVE, *CANDIDATE[2:]), ["replay"], []),
    (SECTION, URL, OK, CANDIDATE, ["identity"], ["title", "replay", "semantics", "organizer", "dates", "years", "corroboration"]),
    (body(more="<p>场次甲</p>"), URL, OK, (*CANDIDATE[:5], "议题：场次甲；其他", "offline", "", ""), [], []),
    (body(), URL, OK, (*CANDIDATE[:5], "", "offline", "", ""), ["corroboration"], []),
]


def judged(spark, cases):
    candidates = spark.createDataFrame([(k, *c[3][1:]) for k, c in enumerate(cases)], CANDIDATES)
    captures = spark.createDataFrame([(k, k, c[1], c[0], c[2]) for k, c in enumerate(cases)] + [(999, -1, URL, body(), OK)], CAPTURES)
    return K.gated_details(candidates, captures, HOST)


def test_details_and_every_reason_against_them(spark):
    got = {r.id: r for r in judged(spark, CASES).collect()}
    assert len(got) == len(CASES)
    for k, (*_, failures, undecided) in enumerate(CASES):
        assert (k, got[k].failures, got[k].undecided) == (k, failures, undecided)
        assert got[k].verdict == ("rejected" if failures else "admitted") and (got[k].patch is None) == bool(failures)
    first = got[0]
    assert (first.patch.start, first.patch.end, first.patch.all_day, first.patch.zone, first.patch.organizer, first.patch.place, first.patch.status) == (T(2026, 9, 14, 14), T(2026, 9, 14, 16), False, "venue_local", "甲", "深圳科技园", None)
    assert (first.evidence.shared_days, first.evidence.occurrence_days, first.evidence.organizers) == (["9月14日"], [datetime.date(2026, 9, 14)], ["甲"])
    assert (got[20].patch.reinstated, got[20].patch.all_day, got[20].patch.zone, got[20].patch.organizer) == (True, True, "unconfirmed", None)


def test_faults_of_traces(spark):
    faults = {r.id: r.trace_fault for r in judged(spark, CASES).collect()}
    assert [faults[k] for k in range(12, 20)] == ["incomplete", "incomplete", "incomplete", None, "route", "route", "invalid", "incomplete"]


BASE = "id long, url string, organizer string, place string, start timestamp_ntz, end timestamp_ntz, all_day boolean, status string, attendance string, time_evidence array<string>, hold boolean, attendance_conflict boolean, time_conflict boolean, notes array<string>, extra string"
DAY = (T(2026, 9, 14), T(2026, 9, 15), True)


def base(id, start=DAY, status="needs_review", attendance="offline", hold=False, notes=(), evidence=("list",)):
    return (id, "u", "o", "p", *start, status, attendance, list(evidence), hold, False, False, list(notes), "e")


@pytest.mark.parametrize("order", [1, -1])
def test_admitted_details_are_merged(spark, order):
    cases = [(body(), URL, OK, CANDIDATE)] * 6 + [(body(more="<p>当前状态：已取消</p>"), URL, OK, CANDIDATE), (body(title="x"), URL, OK, CANDIDATE), (body(more="<p>举办时间：2026年9月14日 18:00-19:00</p>"), URL, OK, CANDIDATE)]
    rows = [
        base(0), base(1, (None, None, False), notes=["shown_not_held"]), base(2, (T(2026, 9, 13), T(2026, 9, 14), True)), base(3, (T(2026, 9, 14, 9), None, False)), base(4, status="cancelled"), base(5, hold=True),
        base(6), base(7), base(8), base(9, status="scheduled"),
    ]
    out = {r.id: r for r in K.merge_admitted(spark.createDataFrame(rows[::order], BASE), judged(spark, cases)).collect()}
    at = (T(2026, 9, 14, 14), T(2026, 9, 14, 16), False)
    assert [(out[k].status, (out[k].start, out[k].end, out[k].all_day) == at, out[k].time_conflict) for k in range(10)] == [
        ("scheduled", True, False), ("scheduled", True, False), ("needs_review", False, True), ("needs_review", False, True), ("cancelled", True, False), ("needs_review", True, False),
        ("cancelled", True, False), ("needs_review", False, False), ("needs_review", False, True), ("scheduled", False, False),
    ]
    assert out[0].time_evidence == ["list", "活动时间：2026年9月14日 14:00–16:00"] and out[1].notes == ["held_as_detailed"] and out[0].url == URL and out[0].extra == "e"
    assert (out[7].url, out[9].organizer, out[9].time_evidence) == ("u", "o", ["list"])


def test_spans_of_meetings(spark):
    texts = ["2026年9月14日 14:00-16:00 北京时间", "2026/9/14 14:00－16:00", "2026年9月14日 25:00-26:00 北京时间", "报名截止 2026年9月14日", "9月14日", "", None, "2026年2月30日", "2026年9月14日 16:00-14:00 北京时间"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", W.meeting_span(F.col("t"), F.lit("online"), F.lit("")).alias("a"), W.meeting_span(F.col("t"), F.lit("hybrid"), F.lit("深圳")).alias("b"), W.date_parts(F.col("t")).alias("d")).orderBy("k").collect()
    assert [r.a and (r.a.start.hour, r.a.all_day, r.a.zone) for r in rows] == [(14, False, "source_explicit"), (0, True, "unconfirmed"), (0, True, "source_explicit"), None, None, None, None, None, (0, True, "source_explicit")]
    assert (rows[1].b.start.hour, rows[1].b.zone) == (14, "venue_local") and [r.d for r in rows[:6]] == [["9月14日"]] * 5 + [[]]

"""Expressions and extractors by value: odd, empty and null texts."""

import datetime

import pytest
from pyspark.sql import functions as F

from fairground.functions import grammar as G
from fairground.operators import merges as M
from fairground.sources import records as R


def values(spark, texts, make, kind="string"):
    return [r.v for r in spark.createDataFrame([(t,) for t in texts], f"t {kind}").select(make(F.col("t")).alias("v")).collect()]


def test_explicit_range(spark):
    cases = {
        "2026年9月14日—16日": ("2026-09-14", "2026-09-17"),
        "9月14日至10月2日": ("2026-09-14", "2026-10-03"),
        "12月30日-1月2日": ("2026-12-30", "2027-01-03"),
        "9月14日至3月2日": None,
        "2026年2月30日": None,
        "2026年1月1日至2028年1月1日": None,
        "即日起至9月14日": None,
        "每周六 9月14日": None,
        "": None,
        None: None,
        "周六晚": None,
    }
    got = values(spark, list(cases), lambda c: G.explicit_range(c, F.lit(2026)))
    assert [(str(r.start), str(r.end)) if r else None for r in got] == list(cases.values())
    assert values(spark, ["9月14日"], G.explicit_range) == [None]


def test_clocks_and_dates(spark):
    got = values(spark, ["2026-09-14 9:00-11:30", "2026-09-14 11:00-9:30", "2026-09-14 25:00-26:00", "9:00-11:30", None], G.clock_range)
    assert [r and (r.start, r.end) for r in got] == [(datetime.datetime(2026, 9, 14, 9), datetime.datetime(2026, 9, 14, 11, 30)), None, None, None, None]
    assert values(spark, ["2026年2月30日 2026/3/1 2026-03-01", "", None], lambda c: F.transform(G.calendar_dates(c), lambda d: d.cast("string"))) == [["2026-03-01"], [], []]


@pytest.mark.parametrize(
    "text, mode",
    [("活动同步直播", "hybrid"), ("活动不会同步直播", "offline"), ("在线观看现场直播已取消", "offline"), ("没有任何线上直播", "offline"), ("没有录像，同时提供直播", "hybrid"), ("无需报名即可线上直播", "hybrid"), (None, "offline"), ("", "offline")],
)
def test_broadcasts(spark, text, mode):
    assert values(spark, [text], lambda c: G.mode_of(c, F.lit("科技园"))) == [mode]


def test_notices(spark):
    texts = ["本场活动已取消举办！", "活动没有取消", "本次活动恢复举行", "原定于2026年9月14日，延期至2026年9月20日。", "原定2026年9月14日改期至2026年2月30日", None]
    assert values(spark, texts, G.state_of) == ["cancelled", None, "reinstated", "moved", None, None]


def test_places(spark):
    texts = ["深圳市", "广东省深圳市,科技园3栋", "南山、福田", "ab", "Nanshan Science Park, Shenzhen China", "hong kong hall", None, ""]
    assert values(spark, texts, G.place_query) == ["", "科技园3栋", "", "", "Nanshan Science Park", "", "", ""]
    assert values(spark, ["Science", "Hall 科技园三栋", None], G.mostly_latin) == [True, False, None]


def test_cards_of_odd_pages(spark):
    html = '<li><a href="http://a.com/1">A</a><em>2026年9月14日</em><i>x</i></li><li><a href="http://a.com/1">B</a><em>2026年9月14日</em></li><li><a href="ftp://a">C</a><em>2026年9月14日</em></li><li></li>'
    rows = [(1, "list", html, 2026), (2, "list", None, 2026), (3, "unheard", html, 2026), (4, "list", "", None)]
    got = R.listing_cards(spark.createDataFrame(rows, "page_id long, kind string, html string, year int")).orderBy("pos").collect()
    assert [(r.page_id, r.title, r.reject) for r in got] == [(1, "A", None), (1, "B", "repeated"), (1, "C", "link"), (1, "", "title")]


def test_blocks_and_tables_of_odd_pages(spark):
    body = "1\nAlone\n场馆：A\n开展时间：9月14日\n2\n第一展\nFirst\n第二展\n场馆：B\n开展时间：12月30日-1月2日\n3\n没有场馆\n开展时间：9月14日"
    got = R.blocks(spark.createDataFrame([("p", 2026, body), ("q", 2026, None), ("r", None, body)], "page_id string, year int, body string")).orderBy("block", "title").collect()
    assert [(r.page_id, r.title, str(r.end)) for r in got] == [("p", "Alone", "2026-09-15"), ("p", "第一展 / First", "2027-01-03"), ("p", "第二展", "2027-01-03")]
    table = "<tr><td>1</td><td>early</td><td>9月1日-9月2日</td><td>x</td></tr><tr><th>2026年12月</th></tr><tr><td>2</td><td>late</td><td>12月30日-1月2日</td><td>x</td></tr><tr><td>x</td><td>no</td><td>12月1日-12月2日</td><td>x</td></tr>"
    got = R.schedule_rows(spark.createDataFrame([("p", table), ("q", None)], "page_id string, html string")).collect()
    assert [(r.title, str(r.start), str(r.end)) for r in got] == [("late", "2026-12-30", "2027-01-03")]


def test_posts_with_several_dates(spark):
    text = "<p>活动时间：2026年9月1日至30日</p><p>演出时间：2026年9月14日</p><p>票价：公益免费</p>"
    bodies = [
        ("a", '[{"title":{"rendered":"T"},"link":"http://a/1","date":"2026-08-01T00:00:00","content":{"rendered":"%s","protected":false}}]' % text),
        ("b", '[{"title":{"rendered":"九月汇总"},"link":"http://a/2","date":"2026-08-01","content":{"rendered":"%s"}}]' % text),
        ("c", '[{"title":{"rendered":"T"},"link":"http://a/3","date":"2026-01-01","content":{"rendered":"<p>活动时间：9月14日</p>"}}, null, {}]'),
        ("d", "no list"), ("e", None),
    ]
    got = R.posts(spark.createDataFrame(bodies, "source_id string, body string")).orderBy("source_id", "link").collect()
    assert [(r.source_id, r.start and str(r.start), r.fee, r.reject) for r in got if not r.reject] == [("a", "2026-09-01", "免费", None), ("b", None, "免费", None), ("c", None, "", None)]


def test_located_needs_one_district(spark):
    queries = spark.createDataFrame([("a hall",), ("b hall",), ("Latin Letters",), ("x",)], "query string")
    places = [("a hall", "a hall", "", "南山"), ("a hall", "a hall annex", "", "福田"), ("b hall", "b hall one", "", "南山"), ("b hall", "b hall two", "", "福田"), ("Latin Letters", "zz", "", "南山"), ("Latin Letters", "yy", "", "南山"), ("x", None, None, "南山")]
    got = M.located(queries, spark.createDataFrame(places, "query string, name string, address string, district string")).collect()
    assert {(r.query, r.district) for r in got} == {("a hall", "南山"), ("Latin Letters", "南山")}


def test_pictures(spark):
    html = "".join(f'<img src="https://i.example.com/{k}.png">' for k in range(12)) + '<img src="https://u@i.example.com/x.png"><img alt="Logo" src="https://i.example.com/l.png">'
    assert values(spark, [html, "", None], R.images) == [[f"https://i.example.com/{k}.png" for k in range(8)], [], None]

"""Every query against its SQL on the smallest tables, and plans and expressions on small literals."""

import datetime

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fairground import admissions, catalogue, extracts, upkeep  # noqa: F401  they register more queries
from fairground import queries as Q
from fairground.functions import text as X
from fairground.functions import times as T
from fairground.operators import evidence as E

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    plain = lambda x: None if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x) else str(round(float(x), 6)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(tuple(map(repr, map(plain, r))) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_matches_sql(spark, duck, name):
    got, want = Q.QUERIES[name](spark, SF).toPandas(), duck.sql(Q.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_dense_dates_lose_no_duplicates(spark, monkeypatch):
    import random

    rng = random.Random(1)
    letters = "abcdefgh 市"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(8, 60))) for _ in range(25)]
    rows = []
    for k in range(150):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(t) + 1)
            if rng.random() < 0.5 and len(t) > 1:
                t.pop(min(at, len(t) - 1))
            else:
                t.insert(at, rng.choice(letters))
        rows.append((k, datetime.datetime(2026, 1, 1 + k % 2), "".join(t), True))
    frame = spark.createDataFrame(rows, "id long, start_at timestamp_ntz, title string, all_day boolean")
    whole = {tuple(r) for r in E.duplicate_pairs(frame).collect()}
    monkeypatch.setattr(E, "DENSE", 10)
    assert {tuple(r) for r in E.duplicate_pairs(frame).collect()} == whole and len(whole) > 50


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        out = [0]
        for j, y in enumerate(b):
            out.append(row[j] + 1 if x == y else max(row[j + 1], out[-1]))
        row = out
    return row[-1]


def test_duplicate_pairs_brute_force(spark):
    got = {(r.a, r.b) for r in Q.QUERIES["dup_candidates"](spark, SF).collect()}
    acts, want = Q.V.activity(spark, SF).collect(), set()
    by = {}
    for r in acts:
        by.setdefault((r.start_at.date(), r.district, r.organizer), []).append(r)
    for group in by.values():
        for x in group:
            for y in group:
                if x.id < y.id and not (x.attendance != y.attendance and "online" in (x.attendance, y.attendance)):
                    if x.title == y.title or min(len(x.title), len(y.title)) >= 10 and 200 * common(x.title, y.title) / (len(x.title) + len(y.title)) >= 93:
                        want.add((x.id, y.id))
    assert got == want


def test_ratio(spark):
    pairs = [("abcdef", "abxdef"), ("", ""), ("a", ""), ("活动日程", "活动日")]
    got = [r.r for r in spark.createDataFrame(pairs, "a string, b string").select(X.ratio(F.col("a"), F.col("b")).alias("r")).collect()]
    assert got == [pytest.approx(v) for v in (200 * 5 / 12, 100.0, 0.0, 200 * 3 / 7)]


def test_date_range(spark):
    cases = {"2026年9月14日至16日": ("2026-09-14", "2026-09-17"), "2026.9.14 — 2026.10.2": ("2026-09-14", "2026-10-03"), "2026-13-40": None, "每周六": None, "2026/9/14": ("2026-09-14", "2026-09-15"), "2026年9月14日至2月3日": None}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", X.date_range(F.col("t")).alias("r")).collect()
    assert {r.t: (str(r.r.start), str(r.r.end)) if r.r else None for r in got} == cases


def test_places_urls_and_topics(spark):
    df = spark.createDataFrame([("深圳市南山区科技园", "HTTP://Ex.com/a?utm_x=1&id=2#top"), ("南山、福田", "ftp://x"), (None, None)], "p string, u string")
    got = df.select(X.district_of(F.coalesce("p", F.lit(""))).alias("d"), X.canon_url(F.col("u")).alias("u"), X.norm(F.col("p")).alias("n")).collect()
    assert [(r.d, r.u) for r in got] == [("南山", "http://ex.com/a?id=2"), ("待确认", ""), ("待确认", "")]
    assert got[0].n == "深圳市南山区科技园" and got[2].n == ""


@pytest.mark.parametrize("end, all_day, upcoming", [(None, True, [True, True, False]), ("1998-06-14 00:00:00", True, [True, True, False]), (None, False, [False, False, False])])
def test_time_boundaries(spark, end, all_day, upcoming):
    at = datetime.datetime(1998, 6, 15, 9)
    df = spark.createDataFrame([(at, datetime.datetime.fromisoformat(end) if end else None, all_day)], "start_at timestamp_ntz, end_at timestamp_ntz, all_day boolean")
    clocks = ["1998-06-15 12:00:00", "1998-06-15 23:59:59", "1998-06-16 00:00:00"]
    assert [df.select((T.upcoming_end() > T.at(c)).alias("x")).first().x for c in clocks] == upcoming


def test_redirects_of_long_chains_and_cycles(spark):
    chain = [(k, k + 1) for k in range(1000)]
    cycles = [(2001, 2002), (2002, 2001), (2010, 2011), (2011, 2012), (2012, 2010), (2100, 2011), (2101, 2100), (5000, 5000)]
    edges = spark.createDataFrame(chain + cycles, "alias_id long, target_id long")
    got = {r.alias_id: r.target_id for r in E.resolve_redirects(edges).collect()}
    assert got == {k: 1000 for k in range(1000)} | {2001: 2001, 2002: 2001, 2010: 2010, 2011: 2010, 2012: 2010, 2100: 2010, 2101: 2010, 5000: 5000}
    assert E.resolve_redirects(edges.limit(0)).count() == 0


def test_iso_offsets(spark):
    wrote = ["2026-03-01T10:00:00-05:30", "2026-03-01 10:00", "2026-03-01T23:30:00Z", "2026-03-01", "2026-13-01", "March", "", None]
    got = [r.t for r in spark.createDataFrame([(w,) for w in wrote], "w string").select(T.iso(F.col("w")).alias("t")).collect()]
    assert got == ["2026-03-01T23:30:00+08:00", "2026-03-01T10:00:00+08:00", "2026-03-02T07:30:00+08:00", "2026-03-01T00:00:00+08:00", None, None, None, None]


def test_refusals_and_queries(spark):
    row = spark.createDataFrame([("请完成安全验证", "http://a/b?page=1&x=2#f", "1.5, 2"), ("ok", "http://a/antispider", "1")], "title string, url string, p string")
    got = row.select(X.blocked(F.col("title"), F.col("url")).alias("b"), X.set_query(F.col("url"), "page", "3").alias("u"), X.coords(F.col("p")).alias("c")).collect()
    assert [(r.b, r.u, r.c and (r.c.lon, r.c.lat)) for r in got] == [(True, "http://a/b?x=2&page=3", (1.5, 2.0)), (True, "http://a/antispider?page=3", None)]


def test_plans(spark):
    def plan(name):
        return Q.QUERIES[name](spark, SF)._jdf.queryExecution().toString()

    assert "LeftSemi" in plan("semi_favorites") and "LeftAnti" in plan("anti_guarded")
    for name in ("overlap_pairs", "facets_one_pass", "dup_candidates"):
        assert "CartesianProduct" not in plan(name) and "BroadcastNestedLoopJoin" not in plan(name)


def test_stream_is_idempotent(spark, tmp_path):
    from fairground.streaming.jobs import stream_observations

    source = Q.V.observations(spark, SF)
    source.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream_observations(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == source.count()


def test_json_ld(spark):
    from fairground.sources.pages import json_ld_events

    page = '<script type="application/ld+json">{"@graph": [{"@type": ["Thing", "https://schema.org/MusicEvent"], "name": " A  b ", "startDate": "2026-09-14", "offers": [{"price": "30"}, {"lowPrice": 0}]}, {"@type": "Person", "name": "x"}]}</script><script type="application/ld+json">{bad</script>'
    got = json_ld_events(spark.createDataFrame([("u", page), ("v", None)], "url string, html string")).collect()
    assert [(r.url, r.event_type, r.title, r.start_at, r.all_day, r.cost_text) for r in got] == [("u", "MusicEvent", "A b", "2026-09-14", True, "免费 / 30")]


def test_feed(spark):
    from fairground.sources.pages import feed_entries

    feed = "<rss><channel><item><title>One</title><link>http://a/1</link><pubDate>Mon</pubDate></item><item><title/><link>http://a/2</link></item></channel></rss>"
    got = feed_entries(spark.createDataFrame([("s", feed)], "source_id string, body string")).collect()
    assert [(r.title, r.link, r.published) for r in got] == [("One", "http://a/1", "Mon")]


def test_duplicate_pairs_of_a_date(spark):
    long = "Evening concert of the city orchestra"
    when, other = datetime.datetime(2026, 9, 14, 19, 30), datetime.datetime(2026, 9, 14, 20, 0)
    rows = [
        (1, long, when, False, "A", "x", "offline", "深圳市南山区科技园会堂"),
        (2, long + "s", when, False, None, "y", "unknown", None),
        (3, long.upper() + " 2026", when, True, "A", None, None, None),
        (4, long, other, False, "A", "x", "offline", None),
        (5, long, when, False, "B", "x", "offline", None),
        (6, long, when, False, "A", "x", "online", None),
        (7, long, when, False, "A", "z", "hybrid", "深圳市南山区科技园会堂"),
        (8, long, when, False, "A", "x", "hybrid", "深圳市南山区"),
        (9, "Something else", when, False, "A", "x", "offline", None),
        (10, long, None, False, "A", "x", "offline", None),
    ]
    frame = spark.createDataFrame(rows, "id long, title string, start_at timestamp, all_day boolean, district string, organizer string, attendance string, location string")
    got = {(r.a, r.b) for r in E.duplicate_pairs(frame).collect()}
    assert got == {(1, 2), (1, 3), (1, 7), (2, 3), (2, 5), (2, 7), (2, 8), (3, 4), (3, 7), (3, 8), (7, 8)}


def test_duplicate_pairs_on_the_given_tables(spark):
    sf = "/root/testdata/sf0.01"
    by, want = {}, set()
    for r in Q.V.activity(spark, sf).collect():
        by.setdefault(r.start_at.date(), []).append(r)
    for day, group in by.items():
        named = [("".join(c for c in r.title.casefold() if c.isalnum()).replace(str(day.year), ""), r) for r in group]
        for s, x in named:
            for t, y in named:
                modes = {x.attendance, y.attendance}
                # No table has a venue, so a hybrid activity is none at a place.
                if x.id < y.id and x.district == y.district and not (len(modes) == 2 and ("online" in modes or modes == {"hybrid", "offline"})) and X.common(s, t) * 200 >= 93 * (len(s) + len(t)):
                    want.add((x.id, y.id))
    assert {(r.a, r.b) for r in Q.QUERIES["dup_candidates"](spark, sf).collect()} == want and len(want) > 11

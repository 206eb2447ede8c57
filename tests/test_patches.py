"""Patches, details, inventories and logs by value."""

from pyspark.sql import functions as F

from fairground.operators import merges as M
from fairground.operators import patches as P


def test_patches_judge_by_every_value(spark):
    rows = spark.createDataFrame([(1, "a", None, 5), (2, "b", "x", 6), (3, "c", "y", 7), (5, "e", "z", 8)], "id long, status string, organizer string, size int")
    asked = [(1, {"organizer": None}, {"status": "n"}), (2, {"status": "b", "organizer": None}, {"status": "n"}), (3, {}, {"status": "c", "organizer": "y"}), (4, {}, {"status": "n"}), (5, {"size": "8"}, {"organizer": None}), (5, {"size": "8"}, {"organizer": None}), (6, None, None)]
    patches = spark.createDataFrame(asked, "id long, guard map<string,string>, patch map<string,string>")
    assert {r.id: r.outcome for r in P.judge_patches(rows, patches).collect()} == {1: "applied", 2: "stale", 3: "already", 4: "stale", 5: "invalid", 6: "invalid"}
    assert sorted(map(tuple, P.apply_patches(rows, patches).collect())) == [(1, "n", None, 5), (2, "b", "x", 6), (3, "c", "y", 7), (5, "e", "z", 8)]
    other = spark.createDataFrame([(2, {"nope": "1"}, {"status": "n"}), (3, {}, {"size": "9"}), (1, {}, {})], patches.schema)
    assert {r.outcome for r in P.judge_patches(rows, other).collect()} == {"invalid"}


def test_fingerprints(spark):
    same = ['{"a":{"y":1,"x":[2,3]},"b":null}', '{ "b" : null, "a" : {"x":[2, 3], "y":1}, "checked_at": 5 }']
    rows = [r.f for r in spark.createDataFrame([(t,) for t in [*same, '{"a":{"y":1,"x":[3,2]},"b":null}', "[1]", "x", None]], "t string").select(P.fingerprint(F.col("t")).alias("f")).collect()]
    assert rows[0] == rows[1] and len(set(rows[:3])) == 2 and rows[3:] == [None] * 3
    flags = {'{"review_hold":true}': True, '{"review_hold":"yes"}': True, '{"review_hold":[1]}': True, '{"review_hold":0}': False, '{"review_hold":""}': False, '{"review_hold":[]}': False, '{"x":1}': False, "no": False, None: False}
    assert [r.f for r in spark.createDataFrame([(t,) for t in flags], "t string").select(P.flag(F.col("t"), "review_hold").alias("f")).collect()] == list(flags.values())


def test_inventories_add_up(spark):
    rows = [(1, k, k % 3 == 0) for k in (*range(50), *range(40000, 40010))] + [(2, 5, True), (2, 5, False), (2, None, True)]
    parts = [P.page_inventory(spark.createDataFrame(some, "source long, item long, recognised boolean"), "source") for some in (rows[:30], rows[20:])]
    got = {r.source: (r.recognised, r.excluded) for r in P.inventory_counts(P.merge_inventories(parts[0].union(parts[1]), "source"), "source").collect()}
    of = lambda s, kind: len({i for x, i, r in rows if x == s and r == kind and i is not None})
    assert got == {s: (of(s, True), of(s, False)) for s in (1, 2)}


def test_the_log_is_only_added_to(spark, tmp_path):
    kind = "kind string, started_at timestamp, finished_at timestamp, status string, details string"
    for n in (3, 9000):
        P.append_runs(spark.createDataFrame([("collect", None, None, "ok", "x" * n)], kind), str(tmp_path / "log"))
    assert sorted(len(r.details) for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [3, 8000]


def test_details_are_one_row_with_joined_costs(spark):
    base = [(k, f"https://a/{k}", "", "未知", None, None, False, False) for k in range(1, 5)]
    details = [
        (1, "https://a/1", 0, "A", "99元", "2026-01-02", None, True), (1, "https://a/1", 1, "B", "免费", "2026-01-01", None, True), (1, "https://b/1", 0, "C", "1元", None, None, True),
        (2, "https://b/2", 1, None, None, "2026-01-03", "2026-01-04", False), (2, "https://b/2", 0, "D", "待确认", None, None, True), (3, "https://b/3", 0, "E", "5元", None, None, True), (3, "https://c/3", 0, "F", "6元", None, None, True),
    ]
    frame = spark.createDataFrame(base, "id long, url string, organizer string, fee string, start string, end string, all_day boolean, hold boolean")
    got = M.fill_details(frame, spark.createDataFrame(details, "id long, url string, rank int, organizer string, fee string, start string, end string, all_day boolean")).orderBy("id").collect()
    assert [(r.id, r.organizer, r.fee, r.start, r.end) for r in got] == [(1, "A", "99元 / 免费", "2026-01-02", None), (2, "D", "未知", "2026-01-03", "2026-01-04"), (3, "", "未知", None, None), (4, "", "未知", None, None)]

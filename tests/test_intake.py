"""What a run takes up, by rows and pages written by hand."""

import datetime
import random
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from fairground.functions import text as X
from fairground.operators import intake as I
from fairground.sources import notices as N
from fairground.sources.resumed import CapturedPages

D, T = datetime.date, datetime.datetime
A, B = "a" * 64 + ".png", "b" * 64 + ".webp"


def test_approved_images(spark):
    details = spark.createDataFrame([(1, ["https://i/1", "https://i/2", None, "https://i/1"]), (2, ["http://i/3"]), (3, None), (4, ["https://i/4"]), (1, ["https://i/5"])], "id long, images array<string>")
    manifest = spark.createDataFrame([("https://i/1", A), ("https://i/1", B), ("http://i/3", A), ("https://i/4", "../x.png"), ("https://i/5", A), (None, A)], "url string, asset string")
    assert {r.id: r.images for r in I.approved_images(details, manifest).collect()} == {1: {"https://i/1": B, "https://i/5": A}, 2: {}, 3: {}, 4: {}}


def test_runs_resume_behind_their_cursors(spark):
    pages = [(s, k, f"https://h{s}/list?p={k}") for s in range(1, 7) for k in range(1, 6)]
    sources = [(s, f"https://h{s}/list") for s in range(1, 7)]
    cursors = [(1, "https://h1/list?p=4"), (2, "https://other/list?p=4"), (3, "https://h3/list?p=99"), (4, None), (5, "https://h5/list?p=2")]
    got = I.resumed(spark.createDataFrame(pages, "source_id int, seq int, url string"), spark.createDataFrame(sources, "source_id int, url string"), spark.createDataFrame(cursors, "source_id int, next_cursor string"), 3)
    rows = {}
    for r in got.orderBy("source_id", "seq").collect():
        rows.setdefault(r.source_id, []).append((r.seq, r.traversal_from_root, r.next_cursor and int(r.next_cursor[-1]), r.truncated))
    assert rows == {1: [(4, False, None, False), (5, False, None, False)], **{s: [(k, True, 4, True) for k in (1, 2, 3)] for s in (2, 4, 6)}, 5: [(k, False, 5, True) for k in (2, 3, 4)]}


def test_a_stream_of_captured_pages_resumes(spark):
    spark.dataSource.register(CapturedPages)
    folder, check, out = (tempfile.mkdtemp(prefix="spark-") for _ in range(3))

    def captured(name, numbers):
        pq.write_table(pa.table({"seq": pa.array(numbers, pa.int64()), "html": [f"<p>{n}" for n in numbers]}), f"{folder}/{name}.parquet")

    def run():
        stream = spark.readStream.format("captured_pages").option("path", folder).option("slice", 4).load()
        query = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r.seq, r.html, r.traversal_from_root) for r in spark.read.parquet(f"{out}/rows").collect())

    captured("a", list(range(1, 11)))
    first = run()
    assert first == [(n, f"<p>{n}", True) for n in range(1, 11)]
    assert run() == first
    captured("b", [15, 11, 12])
    captured("c", [3])
    assert run() == [*first, (11, "<p>11", False), (12, "<p>12", False), (15, "<p>15", False)]


def test_due_sources_run_within_the_time(spark):
    rng = random.Random(3)
    now = T(2026, 9, 14)
    rows = [(k, rng.choice([None, 10, 20, 50]), rng.choice([None, T(2026, 9, 1), T(2026, 9, 2)]), rng.choice([None, now, T(2026, 9, 13), T(2026, 9, 15)]), rng.choice([None, 5, 30, 90])) for k in range(40)]
    frame = spark.createDataFrame(rows, "source_id int, priority int, last_attempt timestamp_ntz, next_attempt timestamp_ntz, seconds int")
    for force in (False, True):
        want, left = {}, 380
        for k, _, _, following, seconds in sorted(rows, key=lambda r: (r[2] or T(1, 1, 1), 50 if r[1] is None else r[1], r[0])):
            if not force and following and following > now:
                want[k] = "waiting"
            elif left < 20:
                want[k] = "deferred"
            else:
                want[k], left = "running", left - (seconds or 160)
        assert {r.source_id: r.state for r in I.due_sources(frame, F.lit(now), force).collect()} == want and len(set(want.values())) == 3 - force


def test_admission_names_the_first_reason(spark):
    day, old = T(2026, 9, 20), T(2026, 7, 1)
    base = {"title": "T", "summary": "s" * 50, "place": "", "stated_city": "", "url": "https://e/1", "attendance": "offline", "start": day, "end": None, "status": "scheduled", "allow_online": False, "city_scope": "", "national": False, "strict": False, "structured": False, "detail_candidate": False, "city_extra": 1}
    cases = [
        ({"stated_city": "深圳"}, "深圳", None), ({"place": "Shen Zhen Bay"}, "深圳", None), ({"stated_city": "广州"}, None, "other_city"), ({}, "深圳", None), ({"strict": True}, None, "city_unsure"), ({"strict": True, "city_scope": "深圳"}, "深圳", None), ({"structured": True}, None, "city_unsure"),
        ({"national": True}, None, "city_unsure"), ({"national": True, "title": "in Shenzhen"}, "深圳", None), ({"attendance": "online"}, "深圳", None), ({"attendance": "online", "allow_online": True, "strict": True}, "线上", None), ({"attendance": "hybrid", "allow_online": True, "stated_city": "广州"}, "广州", None),
        ({"stated_city": "深圳", "start": old}, None, "past"), ({"stated_city": "深圳", "start": old, "end": day}, "深圳", None), ({"stated_city": "深圳", "start": None, "summary": "s"}, None, "short_lead"), ({"stated_city": "深圳", "start": None, "summary": None, "detail_candidate": True}, "深圳", None),
        ({"stated_city": "深圳", "url": "ftp://x"}, None, "no_title_or_link"), ({"stated_city": "深圳", "title": None}, None, "no_title_or_link"), ({"national": True, "title": "深圳", "summary": "s"}, None, "short_lead"),
    ]
    schema = "n int, title string, summary string, place string, stated_city string, url string, attendance string, start timestamp_ntz, end timestamp_ntz, status string, allow_online boolean, city_scope string, national boolean, strict boolean, structured boolean, detail_candidate boolean, city_extra int"
    rows = [(k, *(base | more).values()) for k, (more, *_) in enumerate(cases)]
    got = {r.n: r for r in I.admitted(spark.createDataFrame(rows, schema), F.lit(T(2026, 9, 14))).collect()}
    assert [(k, got[k].city, got[k].reject) for k in range(len(cases))] == [(k, *want) for k, (_, *want) in enumerate(cases)]
    assert (got[8].start, got[8].admitted_status, got[0].start, got[0].admitted_status) == (None, "needs_review", day, "scheduled")


def test_districts_by_words_codes_and_ranks(spark):
    places = ["深圳市南山区科技园", "Nanshan District hall", "Bao'an stadium", "Nan Shan park", "xnanshan", "南山区、福田区", "福田区 罗湖区", "大鹏新区", "南山", None, ""]
    found = [r.d for r in spark.createDataFrame([(k, p) for k, p in enumerate(places)], "k int, p string").select("k", X.named_district(F.col("p")).alias("d")).orderBy("k").collect()]
    assert found == ["南山", "南山", "宝安", "南山", "", "", "", "大鹏", "", "", ""]
    rows = [(1, "深圳市福田区会堂"), (2, "深圳博物馆历史馆"), (3, "深圳 / 万丽酒店大堂"), (4, "香港故宫博物馆"), (5, "深圳"), (6, "两地会馆"), (7, "无名会馆"), (8, "深圳博物馆历史馆"), (9, "Grand Hall Building"), (10, None)]
    geocodes = [("深圳博物馆历史馆", "福田区", "440304"), ("两地会馆", "福田区", "440304"), ("两地会馆", "南山区", "440305"), ("Grand Hall Building", "福田区", "440304"), ("无名会馆", "天河区", "440106")]
    answers = [("万丽酒店大堂", "万丽酒店大堂", "", "南山"), ("两地会馆", "两地会馆", "", "龙岗"), ("Grand Hall Building", "Grand Hall Building", "", "罗湖")]
    got = I.resolved_districts(spark.createDataFrame(rows, "id int, place string"), spark.createDataFrame(geocodes, "query string, district string, adcode string"), spark.createDataFrame(answers, "query string, name string, address string, district string"))
    assert {r.id: (r.district, r.method, r.outcome) for r in got.collect()} == {
        1: ("福田", "text", "ok"), 2: ("福田", "geocode", "ok"), 3: ("南山", "poi", "ok"), 4: ("", "skip", "skipped"), 5: ("", "skip", "skipped"), 6: ("龙岗", "poi", "ok"), 7: ("", "poi", "not_found"), 8: ("福田", "geocode", "ok"), 9: ("罗湖", "poi", "ok"), 10: ("", "skip", "skipped"),
    }


def test_announcements(spark):
    told = "第二十七届光博会（CIOE）将于2026年9月9-11日在会展中心举办"
    pages = [f"<p>他将于明日来。<b>{told}</b>。", told.replace("第二十七届", ""), told.replace("（CIOE）", ""), told.replace("11日", "31日"), told.replace("会展中心", "别处"), told.replace("9-11", "11-9"), None, told + told.replace("2026", "2027")]
    got = N.announcements(spark.createDataFrame(list(enumerate(pages)), "page_id int, html string"), "光博会", "CIOE", "会展中心").orderBy("page_id").collect()
    assert [(r.page_id, r.title, r.start, r.end, r.evidence) for r in got] == [(k, "第二十七届光博会（2026）", D(2026, 9, 9), D(2026, 9, 12), told) for k in (0, 7)]


def test_developer_rows(spark):
    def row(cls="row", mode="Online", name="PyDay", first="2026-09-14", last='"2026-09-15T10:00"', text="Python conference Online", more="", url="https://e.example.com/1?utm_source=x"):
        return f'<div class="{cls}"><div><time>Sep 14</time><script type="application/ld+json">{{"eventAttendanceMode":"https://schema.org/{mode}EventAttendanceMode","name":"{name}","url":"{url}","startDate":"{first}","endDate":{last},"location":{{"name":"Hall"}},"description":"{text}"{more}}}</script></div></div>'

    odd = [row(cls="row featured"), row(mode="Offline"), row(name=" "), row(first="2026-09-16"), row(first="2026-02-30"), row(url="x"), '<div class="row"><script type="application/ld+json">[1]</script><script type="application/ld+json">{</script><script>{}</script></div>', f"<div class=row>{row()}</div>"]
    good = row() + row(mode="Mixed", last="null", text="AI masterclass in Shenzhen") + "".join(odd[:-1])
    got = N.developer_rows(spark.createDataFrame([(1, good), (2, None), (3, odd[-1])], "page_id int, html string")).orderBy("page_id", "pos").collect()
    assert [(r.page_id, r.title, r.link, r.start, r.end, r.kind, r.place, r.attendance, r.category, r.topics, r.label) for r in got] == [
        (1, "PyDay", "https://e.example.com/1", D(2026, 9, 14), D(2026, 9, 16), "ConferenceEvent", "线上", "online", "Python", ["软件开发"], "Sep 14"),
        (1, "PyDay", "https://e.example.com/1", D(2026, 9, 14), D(2026, 9, 15), "CourseInstance", "Hall", "hybrid", "AI", [], "Sep 14"),
        (3, "PyDay", "https://e.example.com/1", D(2026, 9, 14), D(2026, 9, 16), "ConferenceEvent", "线上", "online", "Python", ["软件开发"], "Sep 14"),
    ]


def test_what_was_known_sticks(spark):
    rng = random.Random(5)
    names = ["title", "start", "end", "place", "district", "event_type", "event_type_state", "status"]
    pick = lambda: {"title": rng.choice("ab"), "start": None, "end": None, "place": rng.choice(["p", "q", None]), "district": rng.choice(["待确认", "南山", "福田"]), "event_type": rng.choice(["Event", "MusicEvent"]), "event_type_state": rng.choice(["source", "ai", "pending"]), "status": rng.choice(["scheduled", "cancelled", "needs_review"]), "content_hash": rng.choice("xyz")}
    stored = [{"id": k, **pick(), "hold": rng.choice([True, False, None]), "origin_priority": rng.randrange(4), "first_seen": T(2026, 1, 1), "last_seen": T(2026, 1, 2), "ai_state": "done"} for k in range(300)]
    new = [{"id": k, **pick(), "priority": rng.randrange(4), "gated": rng.choice([True, False, None]), "reinstated": rng.choice([True, False, None])} for k in range(100, 400)]
    kind = "id int, title string, start timestamp_ntz, end timestamp_ntz, place string, district string, event_type string, event_type_state string, status string, content_hash string"
    now, want, held = T(2026, 9, 14), {}, {r["id"]: r for r in stored}
    for k in range(400):
        old, e = held.get(k), dict(new[k - 100]) if k >= 100 else None
        if e is None:
            want[k] = {**old, "hold": bool(old["hold"]), "outcome": "absent"}
            continue
        if old:
            if old["place"] == e["place"] and e["district"] == "待确认":
                e["district"] = old["district"]
            if e["event_type"] == "Event" and old["event_type_state"] in ("source", "ai"):
                e["event_type"], e["event_type_state"] = old["event_type"], old["event_type_state"]
            if e["gated"] and old["status"] == "cancelled" and not e["reinstated"]:
                e["status"] = "cancelled"
            if old["hold"]:
                e["status"] = "cancelled" if e["gated"] and e["status"] == "cancelled" else "needs_review"
        ranks = bool(old) and e["priority"] <= old["origin_priority"]
        if not old or (ranks and e["content_hash"] != old["content_hash"]):
            row = {n: e[n] for n in names} | {"hold": bool(old and old["hold"]), "origin_priority": e["priority"], "first_seen": old["first_seen"] if old else now, "ai_state": "review" if old and old["hold"] else "pending", "outcome": "replaced" if old else "inserted"}
        else:
            row = {**old, "hold": bool(old["hold"]), "outcome": "seen"}
            if ranks and e["event_type_state"] == "source":
                row |= {"event_type": e["event_type"], "event_type_state": "source", "outcome": "typed"}
        want[k] = row | {"id": k, "last_seen": now, "content_hash": e["content_hash"]}
    frames = [spark.createDataFrame([tuple(r.values()) for r in rows], f"{kind}, {more}") for rows, more in ((stored, "hold boolean, origin_priority int, first_seen timestamp_ntz, last_seen timestamp_ntz, ai_state string"), (new, "priority int, gated boolean, reinstated boolean"))]
    got = {r.id: r.asDict() for r in I.ingested(frames[0], frames[1].union(frames[1]), F.lit(now)).collect()}
    assert got == want and {r["outcome"] for r in got.values()} == {"inserted", "replaced", "typed", "seen", "absent"}


def test_calendars(spark):
    day = (T(2026, 9, 14), None, True)
    rows = [
        (1, "A, B; C\\", "s\nt", "厅" * 30, "https://e/1", None, *day, "scheduled", True, T(2026, 9, 1, 8), [("n", "https://n/")]), (2, "x" * 200, None, None, "no address", "免费", T(2026, 9, 14, 9), None, False, "scheduled", True, T(2026, 9, 1), None),
        (3, "T", "", "", "", "", T(2026, 9, 14, 9), T(2026, 9, 14, 10), False, "scheduled", True, T(2026, 9, 1), []), (4, "held", "", "", "", "", *day, "scheduled", False, T(2026, 9, 1), []), (5, "off", "", "", "", "", *day, "cancelled", True, T(2026, 9, 1), []), (6, "undated", "", "", "", "", None, None, True, "scheduled", True, T(2026, 9, 1), []),
    ]
    frame = spark.createDataFrame(rows, "id int, title string, summary string, place string, url string, cost_text string, start timestamp_ntz, end timestamp_ntz, all_day boolean, status string, planning_eligible boolean, last_seen timestamp_ntz, sources array<struct<name string,url string>>")
    texts = [r.text for r in I.calendar_lines(frame, "all").orderBy("part", "id").collect()]
    whole = "\r\n".join(texts)
    assert all(len(line.encode()) <= 75 for line in whole.split("\r\n")) and len(texts) == 5 and "\n" not in whole.replace("\r\n", "")
    events = [dict(line.split(":", 1) for line in t.replace("\r\n ", "").split("\r\n")) for t in texts[1:4]]
    assert events[0] == {"BEGIN": "VEVENT", "UID": "1@fairground", "DTSTAMP": "20260901T080000Z", "LAST-MODIFIED": "20260901T080000Z", "DTSTART;VALUE=DATE": "20260914", "DTEND;VALUE=DATE": "20260915", "SUMMARY": "A\\, B\\; C\\\\", "LOCATION": "厅" * 30, "DESCRIPTION": "s\\nt\\n\\n费用：费用未注明\\n以主办方最新说明为准。\\nn: https://n/", "URL": "https://e/1", "STATUS": "CONFIRMED", "END": "VEVENT"}
    assert events[1]["SUMMARY"] == "x" * 200 and "URL" not in events[1] and not any(k.startswith("DTEND") for k in events[1]) and events[2]["DTEND;TZID=Asia/Shanghai"] == "20260914T100000"
    assert [e["DESCRIPTION"] for e in events[1:]] == ["费用：免费\\n以主办方最新说明为准。", "费用：\\n以主办方最新说明为准。"]
    assert [r.text[:9] for r in I.calendar_lines(frame.where("false"), "all").orderBy("part").collect()] == ["BEGIN:VCA", "END:VCALE"]

"""The life of guards against a plain loop over the notices, in batch and as a stream, and late targets by value."""

import datetime
import hashlib
import itertools
import random

import pytest

from fairground.operators import guards as G
from fairground.streaming import jobs

SCHEMA = "observation_id long, source_id long, event_id long, alias string, occurrence string, again boolean, ts timestamp, resolves boolean"
BASE = datetime.datetime(2026, 1, 1)


def loop(rows):
    """One notice after another, as a ledger would take them."""
    guards, seen, turned = [], set(), set()
    for r in sorted((r for r in rows if None not in (r[0], r[1], r[2], r[3], r[6])), key=lambda r: (r[6], r[0])):
        alias, occurrence = r[1:4], r[4] or ""
        if (alias, r[0]) in seen:
            continue
        seen.add((alias, r[0]))
        if r[7]:
            for g in guards:
                if g["of"] == (*alias, occurrence) and g["state"] == "active":
                    g["state"], g["revision"] = "resolved", g["revision"] + 1
                    turned.add(alias)
            continue
        reason = G.LATER_REASON if alias in turned else G.FIRST_REASON
        open_ = [g for g in guards if g["of"] == (*alias, occurrence) and g["reason"] == reason and g["state"] == "active" and not g["own"]]
        if r[5] or not open_:
            first = hashlib.sha256("|".join(map(str, (*alias, occurrence, r[0]))).encode()).hexdigest()[:20]
            g = {"id": first, "of": (*alias, occurrence), "reason": reason, "state": "active", "own": bool(r[5]), "revision": 0, "members": []}
            guards.append(g)
        else:
            g = open_[0]
        g["members"].append(r[0])
        g["revision"] += 1
    share = lambda o: int(hashlib.sha256(str(o).encode()).hexdigest()[:12], 16)
    return sorted((g["id"], *g["of"], g["reason"], len(g["members"]), g["revision"], str(sum(map(share, g["members"]))), g["state"]) for g in guards), {(g["id"], m) for g in guards for m in g["members"]}


def notices(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        ts = BASE + datetime.timedelta(hours=rng.randrange(24 * 12))
        rows.append((k, rng.randrange(2), rng.randrange(3), rng.choice("ab"), rng.choice(["d1", "d2", None]), rng.random() < 0.1, ts, rng.random() < 0.2))
    return rows + rows[:20] + [(None, 1, 1, "a", "d1", False, BASE, False), (9001, None, 1, "a", "d1", False, BASE, False), (9002, 1, 1, "a", "d1", False, None, False), (9003, 1, 1, "a", "d1", None, BASE, None)]


@pytest.mark.parametrize("unit", ["hour", "day", "year"])
def test_guard_life_equals_the_loop(spark, unit):
    for seed in range(2):
        rows = notices(seed)
        want, members = loop([r if r[0] != 9003 else (*r[:5], False, r[6], False) for r in rows])
        frame = spark.createDataFrame(rows, SCHEMA)
        assert sorted(map(tuple, G.guard_life(frame, unit).collect())) == want
        assert {tuple(r) for r in G.guard_members(frame, unit).collect()} == members
    assert G.guard_life(spark.createDataFrame([], SCHEMA)).collect() == []


def test_the_digest_is_a_sum(spark):
    rows = [(k, 1, 1, "a", "d", False, BASE, False) for k in range(5)]
    one, other = (G.guard_life(spark.createDataFrame(r, SCHEMA)).first() for r in (rows, rows[::-1]))
    assert one == other and one.notices == one.revision == 5


def test_guards_as_state_equal_the_fold_after_a_restart_and_a_replay(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source, target, state = (str(tmp_path / p) for p in ("in", "out", "state"))
        rows = sorted((r for r in notices(7, 200) if r[6] is not None and r[0] not in (None, 9003)), key=lambda r: (r[6], r[0]))
        parts = [rows[:80], rows[80:150] + rows[10:30], rows[150:]]  # the second one repeats some of the first
        for part in parts:  # the stream is stopped and begun again between the parts
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            jobs.guard_stream(spark, source, target, state).awaitTermination(300)
        got = sorted((r.guard_id, r.source_id, r.event_id, r.alias, r.occurrence, r.reason, r.notices, r.revision, r.digest, r.state) for r in jobs.newest_guards(spark, target).collect())
        assert got == loop(rows)[0] == sorted(map(tuple, G.guard_life(spark.createDataFrame(rows, SCHEMA)).collect()))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_late_targets_in_both_orders_and_after_the_watermark(spark, tmp_path):
    notice = "observation_id long, source_id long, alias string, day date, ts timestamp"
    anchor = "source_id long, alias string, event_id long, day date, ts timestamp"
    paths = [str(tmp_path / p) for p in ("notices", "anchors", "out", "state")]
    day, at = datetime.date(2026, 3, 1), lambda d: BASE + datetime.timedelta(days=d)
    land = lambda path, rows, kind: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)
    run = lambda: jobs.late_targets(spark, *paths, window="10 days").awaitTermination(300)
    # The first notice waits for its anchor; the second anchor waits for its notices; the third notice stays alone.
    land(paths[0], [(1, 1, "a", day, at(0)), (3, 1, "c", day, at(1))], notice)
    land(paths[1], [(1, "b", 20, day, at(1))], anchor)
    run()
    land(paths[0], [(2, 1, "b", day, at(2)), (4, 1, "b", datetime.date(2026, 3, 2), at(2)), (5, 1, "b", None, at(2)), (1, 1, "a", day, at(0))], notice)
    land(paths[1], [(1, "a", 10, day, at(3))], anchor)
    run()
    # Time goes on for both; an anchor of the third notice comes after its window.
    land(paths[0], [(9, 7, "z", day, at(40))], notice)
    land(paths[1], [(7, "y", 70, day, at(40))], anchor)
    run()
    land(paths[0], [(10, 7, "z", day, at(41))], notice)
    land(paths[1], [(1, "c", 30, day, at(2)), (7, "y", 71, day, at(41))], anchor)
    run()
    run()
    got = sorted((r.observation_id, r.event_id or 0, r.result) for r in spark.read.parquet(paths[2]).collect())
    assert got == [(1, 10, "applicable"), (2, 20, "applicable"), (3, 0, "pending"), (4, 20, "not_applicable"), (5, 20, "refused")]


def test_resolutions_are_all_or_nothing(spark):
    rows = [(1, 1, 1, "a", "d", False, BASE, False), (2, 1, 1, "b", "d", False, BASE, False), (3, 1, 2, "a", "d", False, BASE, False), (4, 1, 2, "a", "d", False, at_hour(1), True), (5, 1, 3, "a", "d", False, BASE, False)]
    guards = G.guard_life(spark.createDataFrame(rows, SCHEMA))
    g = {(r.event_id, r.alias): r for r in guards.collect()}
    ask = lambda i, r, **new: (i, *({**r.asDict(), **new}[c] for c in ("guard_id", *G.OCCURRENCE, "revision", "digest")))
    requests = [ask("both", g[1, "a"]), ask("both", g[1, "b"]), ask("stale", g[1, "a"]), ask("stale", g[1, "b"], revision=7), ask("done", g[2, "a"], revision=1)]
    requests += [ask("members", g[1, "a"], digest="1"), ask("alias", g[1, "a"], alias="b"), ask("none", g[1, "a"], guard_id="x"), ask("two", g[1, "a"]), ask("two", g[5 - 2, "a"])]
    frame = spark.createDataFrame(requests, "resolution_id string, guard_id string, source_id long, event_id long, alias string, occurrence string, revision long, digest string")
    got = {r.resolution_id: r.outcome for r in G.resolved_as_expected(frame, guards).collect()}
    assert got == {"both": "applied", "stale": "conflict", "done": "already", "members": "conflict", "alias": "conflict", "none": "conflict", "two": "invalid"}


def at_hour(h):
    return BASE + datetime.timedelta(hours=h)


def test_disassociation_needs_the_exact_scope(spark):
    rows = [(k, 1, 1, "a", "d1", False, at_hour(k), False) for k in range(3)]
    frame = spark.createDataFrame(rows, SCHEMA)
    guards, members = G.guard_life(frame), G.guard_members(frame)
    g = guards.first().asDict()
    reason = "seen by two of us, another date"
    asked = [("good", "me", reason, "other"), ("short", "me", "too short", "other"), ("nobody", "", reason, "other"), ("same", "me", reason, "own"), ("scope", "me", reason, "other"), ("more", "me", reason, "other"), ("old", "me", reason, "other"), ("unknown", "me", reason, "dateless"), ("empty", "me", reason, "other"), ("nothing", None, None, None)]
    seen = {"scope": [0, 1], "more": [0, 1, 2, 3], "empty": None}
    reviewed = [(i, g["guard_id"], 1, 1, "a", "d1", g["revision"] - (i == "old"), g["digest"], seen.get(i, [2, 1, 0, 0])) for i, *_ in asked if i != "nothing"]
    got = G.disassociated(
        spark.createDataFrame(asked, "resolution_id string, actor string, review_reason string, binding_id string"),
        spark.createDataFrame(reviewed, "resolution_id string, guard_id string, source_id long, event_id long, alias string, occurrence string, revision long, digest string, observations array<long>"),
        guards, members,
        spark.createDataFrame([("other", 1, 9, "a", "d2"), ("own", 1, 1, "a", "d2"), ("dateless", 1, 9, "a", "")], "binding_id string, source_id long, event_id long, alias string, occurrence string"),
    )
    want = {"good": "", "short": "reason", "nobody": "reason", "same": "anchor", "scope": "scope", "more": "scope", "old": "snapshot", "unknown": "occurrence", "empty": "scope", "nothing": "anchor,guard,occurrence,reason,scope,snapshot"}
    assert {r.resolution_id: r.failures for r in got.collect()} == want
    assert {r.resolution_id for r in got.where("outcome = 'applied'").collect()} == {"good"}


def test_anchors_name_every_failure(spark):
    day = datetime.date(2026, 3, 1)
    item = (1, "https://a/1", "Café  night", day, 5, 50)
    rows = [(f"i{k}", *item, [b]) for k, b in enumerate(["ok", "other source", "no body", "title", "day", "moved", "anchored", "anchored elsewhere", "unheard of"])] + [("none", *item, None), ("unlinked", 1, "https://a/2", "Café  night", day, 5, 50, ["ok2"])]
    one = lambda b, **new: tuple({"id": b, "source": 1, "url": "https://a/1", "title": "Café night", "body": "x", "days": ["2026-03-01"], "event": None, **new}.values())
    bindings = [one("ok"), one("ok2", url="https://a/2"), one("other source", source=2), one("no body", body=""), one("title", title="Cafe"), one("day", days=["2026-03-02"]), one("moved", event=6), one("anchored", event=5), one("anchored elsewhere")]
    got = G.anchor_checks(
        spark.createDataFrame(rows, "item string, source_id long, url string, title string, day date, event_id long, raw_id long, binding_ids array<string>"),
        spark.createDataFrame(bindings, "binding_id string, source_id long, canonical string, title string, body_digest string, days array<string>, event_id long"),
        spark.createDataFrame([(1, "https://a/1", 5, 50)], "source_id long, url string, event_id long, raw_id long"),
        spark.createDataFrame([("anchored", 5, 50, ["2026-03-01"]), ("anchored elsewhere", 5, 51, ["2026-03-01"])], "binding_id string, event_id long, raw_id long, days array<string>"),
    )
    want = ["", "binding", "evidence", "evidence", "occurrence", "retarget", "", "retarget", "binding,evidence,occurrence"]
    assert [r.failures for r in got.orderBy("item").collect()] == [*want, "binding,evidence,occurrence", "link"]


def test_orders_of_arrival_in_a_batch_do_not_matter(spark):
    rows = notices(3, 6)[:6]
    want = loop(rows)[0]
    for order in itertools.islice(itertools.permutations(rows), 0, 720, 240):
        assert sorted(map(tuple, G.guard_life(spark.createDataFrame(list(order), SCHEMA)).collect())) == want

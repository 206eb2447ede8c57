"""The life of cancellation guards: folded from all notices, kept as the state of a stream, resolved and disassociated.

Observations are (observation_id, source_id, event_id, alias, occurrence, again, ts, resolves): a notice that an occurrence
of an activity is off, or, if it ``resolves``, that it takes place after all.  They count in order of (ts, observation_id), each
id once for its activity and alias; one without an id, time, source, activity or alias opens nothing.  A null occurrence is an
unknown one, ''.

A notice joins the active guard of its source, activity, alias, occurrence and reason, or opens one; a repeated cancellation
(``again``) always opens one of its own.  Once anything of an alias was resolved, the reason of later notices is another one.
A resolution ends all active guards of its occurrence.  A guard's revision counts its members and its resolution; its
digest is a sum over its members, so it is the same in any order and can be added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fairground.operators.evidence import settled

ALIAS = ["source_id", "event_id", "alias"]
OCCURRENCE = [*ALIAS, "occurrence"]
#: Fixed values.
FIRST_REASON = "unconfirmed_cancellation_for_historical_identity"
LATER_REASON = "cancellation_generation_ambiguous_after_reinstatement"
GUARD = "guard_id string, source_id long, event_id long, alias string, occurrence string, reason string, notices long, revision long, digest string, state string"


def member_digest(observation: Column) -> Column:
    """A member's share of the digest: 48 bits of its hash."""
    return F.conv(F.substring(F.sha2(observation.cast("string"), 256), 1, 12), 16, 10).cast("decimal(38,0)")


def guard_id(first: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in OCCURRENCE), first.cast("string")), 256), 1, 20)


def complete(observations: DataFrame) -> DataFrame:
    """The observations that can count; what they may leave open is filled."""
    known = observations.dropna(subset=["observation_id", "ts", *ALIAS])
    return known.select("observation_id", *ALIAS, F.coalesce("occurrence", F.lit("")).alias("occurrence"), F.coalesce("again", F.lit(False)).alias("again"), "ts", F.coalesce("resolves", F.lit(False)).alias("resolves"))


def counted(observations: DataFrame) -> DataFrame:
    """The observations that count, each once, with their order as ``at``."""
    return complete(observations).dropDuplicates([*ALIAS, "observation_id"]).withColumn("at", F.struct("ts", "observation_id"))


GROUP = [*OCCURRENCE, "reason", "generation", "resolutions", "own"]


def placed(observations: DataFrame, unit: str = "day") -> DataFrame:
    """The notices that count with what makes up their guard (``GROUP``).

    The fold is put together from the units of time (``unit``): a unit adds so many resolutions, and these sums are carried over
    an occurrence's units.  Only the notices of one occurrence in one unit meet in a task.
    """
    rows = counted(observations).withColumn("unit", F.date_trunc(unit, "ts"))
    units = rows.groupBy(*OCCURRENCE, "unit").agg(F.count_if("resolves").alias("n"), F.min(F.when(~F.col("resolves"), F.col("at"))).alias("first"))
    line = Window.partitionBy(*OCCURRENCE)
    units = units.select(*OCCURRENCE, "unit", (F.sum("n").over(line.orderBy("unit")) - F.col("n")).alias("before"), F.sum("n").over(line).alias("resolutions"), F.min("first").over(line).alias("first"))
    rows = rows.join(units, [*OCCURRENCE, "unit"])

    # The first resolution that found a guard of its occurrence, for each alias.
    effective = rows.where(F.col("resolves") & (F.col("at") > F.col("first"))).groupBy(*ALIAS).agg(F.min("at").alias("turned"))
    inside = Window.partitionBy(*OCCURRENCE, "unit").orderBy("ts", "observation_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("generation", F.col("before") + F.sum(F.col("resolves").cast("long")).over(inside)).where("not resolves")
    reason = F.when(F.col("at") > F.col("turned"), LATER_REASON).otherwise(FIRST_REASON)
    return rows.join(effective, ALIAS, "left").withColumn("reason", reason).withColumn("own", F.when(F.col("again"), F.col("observation_id")))


def guard_life(observations: DataFrame, unit: str = "day") -> DataFrame:
    """(guard_id, source_id, event_id, alias, occurrence, reason, notices, revision, digest, state) of all guards; what one gathers is a sum."""
    return _lives(_gathered(placed(observations, unit)))


def _gathered(notices: DataFrame) -> DataFrame:
    """A row a guard of the notices that ``placed`` gives: how many it has, the first of them, and their digest."""
    return notices.groupBy(*GROUP).agg(F.count("*").alias("notices"), F.min("at")["observation_id"].alias("first"), F.sum(member_digest(F.col("at.observation_id"))).alias("sum"))


def _lives(found: DataFrame) -> DataFrame:
    active = F.col("generation") == F.col("resolutions")
    return found.select(
        guard_id(F.col("first")).alias("guard_id"),
        *OCCURRENCE,
        "reason",
        "notices",
        (F.col("notices") + (~active).cast("long")).alias("revision"),
        F.col("sum").cast("string").alias("digest"),
        F.when(active, "active").otherwise("resolved").alias("state"),
    )


def guard_members(observations: DataFrame, unit: str = "day") -> DataFrame:
    """(guard_id, observation_id): which guard each notice is of."""
    rows = placed(observations, unit).select(*GROUP, "at")
    return _members(rows, rows.groupBy(*GROUP).agg(F.min("at")["observation_id"].alias("first")))


def guards_and_members(observations: DataFrame, unit: str = "day") -> tuple[DataFrame, DataFrame]:
    """``guard_life`` and ``guard_members`` for what uses both, more than once: the notices are placed once, and both are kept."""
    rows = settled(placed(observations, unit).select(*GROUP, "at"))
    found = settled(_gathered(rows))
    return _lives(found), settled(_members(rows, found))


def _members(rows: DataFrame, found: DataFrame) -> DataFrame:
    first = found.select(*(F.col(c).alias(f"g_{c}") for c in GROUP), "first")
    same = [F.col(c).eqNullSafe(F.col(f"g_{c}")) for c in GROUP]
    return rows.join(first, same).select(guard_id(F.col("first")).alias("guard_id"), F.col("at.observation_id").alias("observation_id"))


class GuardState(StatefulProcessor):
    """The same fold as state of a stream, keyed by source, activity and alias.

    State: whether anything was resolved (a value), the active guards (a list), and the ids that were seen with their times (a
    map), so that a replay changes nothing.  A timer forgets ids once the watermark is ``days`` past them.
    """

    def __init__(self, days: int = 45):
        self._days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._turned = handle.getValueState("turned", "turned boolean")
        self._active = handle.getListState("active", "guard_id string, occurrence string, reason string, own boolean, notices long, digest string")
        self._seen = handle.getMapState("seen", "observation_id long", "at long")
        self._handle = handle

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turned = self._turned.exists() and self._turned.get()[0]
        active = [list(g) for g in self._active.get()] if self._active.exists() else []
        changed: dict[str, tuple] = {}
        frame = pd.concat(list(rows)).sort_values(["ts", "observation_id"])
        for r in frame.itertuples():
            if self._seen.containsKey((r.observation_id,)):
                continue
            self._seen.updateValue((r.observation_id,), (r.millis,))
            if r.resolves:
                ended = [g for g in active if g[1] == r.occurrence]
                active = [g for g in active if g[1] != r.occurrence]
                turned = turned or bool(ended)
                for g in ended:
                    changed[g[0]] = (*g[:3], g[4], g[4] + 1, g[5], "resolved")
                continue
            reason = LATER_REASON if turned else FIRST_REASON
            guard = None if r.again else next((g for g in active if g[1:4] == [r.occurrence, reason, False]), None)
            if guard is None:
                guard = [r.guard_id, r.occurrence, reason, bool(r.again), 0, "0"]
                active.append(guard)
            guard[4] += 1
            guard[5] = str(int(guard[5]) + int(r.share))
            changed[guard[0]] = (*guard[:3], guard[4], guard[4], guard[5], "active")
        self._handle.registerTimer(int(frame["millis"].max()) + self._days * 86_400_000)
        self._turned.update((turned,))
        if active:
            self._active.put([tuple(g) for g in active])
        else:
            self._active.clear()
        if changed:
            guards = pd.DataFrame(list(changed.values()), columns=["guard_id", "occurrence", "reason", "notices", "revision", "digest", "state"])
            for name, value in zip(ALIAS, key, strict=True):
                guards[name] = value
            yield guards[["guard_id", *OCCURRENCE, "reason", "notices", "revision", "digest", "state"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = expiredTimerInfo.getExpiryTimeInMs() - self._days * 86_400_000
        for observation in [k for k, (at,) in self._seen.iterator() if at <= last]:
            self._seen.removeKey(observation)
        yield from ()

    def close(self) -> None:
        pass


def guard_changes(observations: DataFrame, days: int = 45) -> DataFrame:
    """The guards that each batch of a stream of observations opens, changes or ends, as ``guard_life`` has them.

    Observations of an alias must arrive in order from batch to batch; inside a batch they may come in any.  What is more than
    ``days`` behind the watermark comes too late and is left aside.
    """
    known = complete(observations)
    known = known.withColumn("moment", F.col("ts").cast("timestamp")).withWatermark("moment", f"{days} days").withColumn("millis", F.unix_millis("moment"))
    known = known.withColumn("guard_id", guard_id(F.col("observation_id"))).withColumn("share", member_digest(F.col("observation_id")).cast("string"))
    return known.groupBy(*ALIAS).transformWithStateInPandas(GuardState(days), GUARD, "Update", "EventTime")


def resolved_as_expected(requests: DataFrame, guards: DataFrame) -> DataFrame:
    """(resolution_id, outcome, guards): applied if every guard that a request names is active and just as it expects.

    Requests are (resolution_id, guard_id, source_id, event_id, alias, occurrence, revision, digest), all or nothing; all of one
    request must be of one source and activity, else it is invalid.  ``already``: all are resolved, one revision on, with the same
    members.  Anything else is a conflict; nothing of it is applied.
    """
    named = requests.dropDuplicates()
    now = guards.select("guard_id", F.struct(*OCCURRENCE).alias("g_of"), F.col("revision").alias("g_revision"), F.col("digest").alias("g_digest"), "state")
    rows = named.join(now, "guard_id", "left").withColumn("same", F.coalesce((F.struct(*OCCURRENCE) == F.col("g_of")) & (F.col("digest") == F.col("g_digest")), F.lit(False)))
    ready = F.bool_and(F.coalesce(F.col("same") & (F.col("state") == "active") & (F.col("revision") == F.col("g_revision")), F.lit(False)))
    done = F.bool_and(F.coalesce(F.col("same") & (F.col("state") == "resolved") & (F.col("revision") + 1 == F.col("g_revision")), F.lit(False)))
    one = (F.count_distinct("source_id", "event_id") == 1) & F.bool_and(F.col("source_id").isNotNull() & F.col("event_id").isNotNull())
    outcome = F.when(~one, "invalid").when(ready, "applied").when(done, "already").otherwise("conflict")
    return rows.groupBy("resolution_id").agg(outcome.alias("outcome"), F.count("*").alias("guards"))


#: Letters that a reviewer's reason must have.
LEAST_REASON, MOST_REASON = 20, 2000


def disassociated(requests: DataFrame, reviewed: DataFrame, guards: DataFrame, members: DataFrame, anchors: DataFrame) -> DataFrame:
    """(resolution_id, outcome, failures) of reviewers' decisions that a guard's notices are about another activity.

    ``requests`` are (resolution_id, actor, review_reason, binding_id); ``reviewed`` (resolution_id, guard_id, source_id, event_id,
    alias, occurrence, revision, digest, observations): the guards as the reviewer saw them, with the ids of their notices.
    The binding must be an anchor of the same source and alias at another activity and another, known occurrence; the ids must be
    just those of the guards' members.  All failures are named; only a request without any is applied.
    """
    held = members.join(reviewed.select("guard_id").distinct(), "guard_id", "left_semi").groupBy("guard_id").agg(F.count_distinct("observation_id").alias("m_count"), F.sum(member_digest(F.col("observation_id"))).alias("m_sum"))
    now = guards.select("guard_id", F.struct(*OCCURRENCE).alias("g_of"), F.col("revision").alias("g_revision"), F.col("digest").alias("g_digest"), "state")
    anchor = anchors.select("binding_id", *(F.col(c).alias(f"a_{c}") for c in OCCURRENCE))
    named = F.array_distinct(F.coalesce("observations", F.array().cast("array<long>")))
    scope = F.aggregate(named, F.lit(0).cast("decimal(38,0)"), lambda s, o: (s + member_digest(o)).cast("decimal(38,0)"))
    rows = requests.join(anchor, "binding_id", "left").join(reviewed.withColumn("named", F.size(named)).withColumn("scope", scope), "resolution_id", "left").join(now, "guard_id", "left").join(held, "guard_id", "left")
    no = lambda condition: ~F.coalesce(condition, F.lit(False))
    text = F.length(F.trim("review_reason"))
    rules = {
        "reason": no((F.coalesce("actor", F.lit("")) != "") & text.between(LEAST_REASON, MOST_REASON)),
        "anchor": no((F.col("a_source_id") == F.col("source_id")) & (F.col("a_alias") == F.col("alias")) & (F.col("a_event_id") != F.col("event_id"))),
        "occurrence": no((F.col("a_occurrence") != "") & (F.col("occurrence") != "") & (F.col("a_occurrence") != F.col("occurrence"))),
        "guard": no(F.struct(*OCCURRENCE) == F.col("g_of")),
        "scope": no((F.col("named") == F.col("m_count")) & (F.col("scope") == F.col("m_sum"))),
        "snapshot": no((F.col("state") == "active") & (F.col("revision") == F.col("g_revision")) & (F.col("digest") == F.col("g_digest"))),
    }
    failures = F.array_compact(F.array(*(F.when(bad, name) for name, bad in rules.items())))
    every = rows.groupBy("resolution_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(failures)))).alias("failures"))
    return every.select("resolution_id", F.when(F.size("failures") == 0, "applied").otherwise("refused").alias("outcome"), F.array_join("failures", ",").alias("failures"))


def anchor_checks(items: DataFrame, bindings: DataFrame, links: DataFrame, anchors: DataFrame) -> DataFrame:
    """(item, binding_id, failures): whether an admitted item may be anchored by its bindings.

    ``items`` are (item, source_id, url, title, day, event_id, raw_id, binding_ids); ``bindings`` (binding_id, source_id, canonical, title,
    body_digest, days, event_id); ``links`` (source_id, url, event_id, raw_id); ``anchors`` (binding_id, event_id, raw_id, days).
    Titles must be equal after ``heading``; days are sorted arrays of text; a binding or anchor never moves to another activity.
    """
    from fairground.functions.text import heading

    rows = items.select("*", F.explode_outer(F.array_distinct("binding_ids")).alias("binding_id")).drop("binding_ids")
    b = bindings.select("binding_id", *(F.col(c).alias(f"b_{c}") for c in ("source_id", "canonical", "title", "body_digest", "days", "event_id")))
    a = anchors.select("binding_id", *(F.col(c).alias(f"a_{c}") for c in ("event_id", "raw_id", "days")))
    link = links.select("source_id", "url", "event_id", "raw_id").distinct().withColumn("linked", F.lit(True))
    rows = rows.join(b, "binding_id", "left").join(a, "binding_id", "left").join(link, ["source_id", "url", "event_id", "raw_id"], "left")
    days = F.when(F.col("day").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.col("day").cast("string")))
    no = lambda condition: ~F.coalesce(condition, F.lit(False))
    rules = {
        "binding": no((F.col("b_source_id") == F.col("source_id")) & (F.col("b_canonical") == F.col("url"))),
        "evidence": no((F.coalesce("b_body_digest", F.lit("")) != "") & (heading(F.col("b_title")) == heading(F.col("title")))),
        "occurrence": no(F.col("b_days") == days),
        "link": F.col("linked").isNull(),
        "retarget": F.coalesce(F.col("b_event_id") != F.col("event_id"), F.lit(False)) | (F.col("a_event_id").isNotNull() & no((F.col("a_event_id") == F.col("event_id")) & (F.col("a_raw_id") == F.col("raw_id")) & (F.col("a_days") == days))),
    }
    return rows.select("item", "binding_id", F.concat_ws(",", *(F.when(bad, name) for name, bad in rules.items())).alias("failures"))

"""The three ends of an activity, kept apart, and what is told from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_RUNNING_DAYS = 14


def known_end(start="start_at", end="end_at") -> Column:
    """The end if it is after the start."""
    return F.when(F.col(end) > F.col(start), F.col(end))


def all_day_end(start="start_at", end="end_at") -> Column:
    """At least one full date; the end is exclusive."""
    day = F.date_trunc("day", F.col(start)).cast("timestamp_ntz") + F.expr("interval 1 day")
    return F.greatest(F.coalesce(known_end(start, end), day), day)


def upcoming_end(start="start_at", end="end_at", all_day="all_day") -> Column:
    """For listings: an unknown end of a timed activity is three hours on."""
    return F.when(F.col(all_day), all_day_end(start, end)).otherwise(F.coalesce(known_end(start, end), F.col(start) + F.expr("interval 3 hours")))


def range_end(start="start_at", end="end_at", all_day="all_day") -> Column:
    """For intersections: an unknown end of a timed activity is a second on."""
    return F.when(F.col(all_day), all_day_end(start, end)).otherwise(F.coalesce(known_end(start, end), F.col(start) + F.expr("interval 1 second")))


def overlaps(lo: Column | None, hi: Column | None) -> Column:
    """Half-open intersection with [lo, hi); either side may be open."""
    out = F.lit(True)
    if lo is not None:
        out = out & (range_end() > lo)
    return out & (F.col("start_at") < hi) if hi is not None else out


def span_days(start="start_at", end="end_at") -> Column:
    return F.coalesce((F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))) / 86_400_000_000, F.lit(0.0))


def long_running() -> Column:
    return span_days() >= LONG_RUNNING_DAYS


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


ENDS_SQL = """ends as (select *, case when end_at > start_at then end_at end as known_end, date_trunc('day', start_at) + interval 1 day as day_end from activity),
timed as (select *, case when all_day then greatest(coalesce(known_end, day_end), day_end) else coalesce(known_end, start_at + interval 3 hours) end as upcoming_end,
  case when all_day then greatest(coalesce(known_end, day_end), day_end) else coalesce(known_end, start_at + interval 1 second) end as range_end,
  coalesce(epoch_us(end_at) - epoch_us(start_at), 0) / 86400000000 as span_days from ends)"""


def iso(c: Column) -> Column:
    """A written time as ISO text at +08:00: without zone it is local, a date is its midnight, anything else is null."""
    day, clock, zone = (F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2})?))?(Z|[+-]\d{2}:\d{2})?$", k) for k in (1, 2, 3))
    clock = F.when(clock == "", "00:00:00").when(F.length(clock) == 5, F.concat(clock, F.lit(":00"))).otherwise(clock)
    local = F.try_to_timestamp(F.concat_ws(" ", F.when(day != "", day), clock), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    hours, minutes = F.substring(zone, 2, 2).cast("int"), F.substring(zone, 5, 2).cast("int")
    ahead = F.when(zone == "Z", 0).when(zone == "", 480).otherwise((hours * 60 + minutes) * F.when(zone.startswith("-"), -1).otherwise(1))
    moved = F.timestamp_add("MINUTE", (F.lit(480) - ahead).cast("int"), local)
    return F.when(day != "", F.date_format(moved, "yyyy-MM-dd'T'HH:mm:ss'+08:00'"))

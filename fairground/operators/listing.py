"""Listing: filters, periods, orders, pages and contextual facets over one candidate set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairground.functions.times import all_day_end, at, known_end, long_running, upcoming_end

CLOSED = ("cancelled", "needs_review", "not_event")


def with_preferences(activities: DataFrame, preferences: DataFrame) -> DataFrame:
    """Left join of the owner's state, with its defaults."""
    own = preferences.withColumnRenamed("event_id", "id")
    return activities.join(own, "id", "left").withColumns({"favorite": F.coalesce("favorite", F.lit(False)), "hidden": F.coalesce("hidden", F.lit(False)), "feedback": F.coalesce("feedback", F.lit("")), "revision": F.coalesce("revision", F.lit(0))})


def only_favorites(activities: DataFrame, preferences: DataFrame) -> DataFrame:
    return activities.join(preferences.where("favorite").select(F.col("event_id").alias("id")), "id", "left_semi")


def without_guarded(activities: DataFrame, guards: DataFrame) -> DataFrame:
    return activities.join(guards.where("active").select(F.col("event_id").alias("id")).distinct(), "id", "left_anti")


def recommended() -> Column:
    return F.col("priority").isin("high", "medium") & (F.coalesce("commercial", F.lit("")) != "high")


def attends(mode: str) -> Column:
    return F.col("attendance").isin(*{"online": ["online", "hybrid"], "offline": ["offline", "hybrid"]}.get(mode, [mode]))


def any_of(column: str, values: list[str]) -> Column:
    """IN; an empty list has no rows."""
    return F.col(column).isin(values) if values else F.lit(False)


def searched(text: str, *columns: str) -> Column:
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.lower()))


def week_end(as_of: str) -> Column:
    return F.date_trunc("week", at(as_of)).cast("timestamp_ntz") + F.expr("interval 7 days")


def weekend(as_of: str) -> tuple[Column, Column]:
    """From now or Saturday, whichever is later, to Monday."""
    monday = week_end(as_of)
    return F.greatest(at(as_of), monday - F.expr("interval 2 days")), monday


def period(name: str, as_of: str) -> Column:
    now, open_ = at(as_of), ~F.col("status").isin(*CLOSED)
    upcoming = F.col("start_at").isNotNull() & open_ & (upcoming_end() > now)
    if name == "upcoming":
        return upcoming
    if name == "week":
        return upcoming & (F.col("start_at") < week_end(as_of))
    if name == "weekend":
        lo, hi = weekend(as_of)
        return upcoming & (F.col("start_at") < hi) & (upcoming_end() > lo)
    if name == "past":
        timed = F.coalesce(known_end() <= now, F.col("start_at") < now)
        return F.col("start_at").isNotNull() & F.when(F.col("all_day"), all_day_end() <= now).otherwise(timed)
    if name == "calendar":
        return F.col("start_at").isNotNull() & (F.col("status") == "scheduled")
    if name == "review":
        return F.col("status") == "needs_review"
    return F.lit(True)


def page(rows: DataFrame, order: list[Column], offset: int = 0, limit: int = 36) -> DataFrame:
    """One page; the position is told within the page's own bound of rows."""
    top = rows.orderBy(*order).limit(offset + limit)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order)) - 1).where(F.col("position") >= offset)


def summary(rows: DataFrame, offset: int = 0, limit: int = 36, shown_long: int = 12) -> DataFrame:
    """One row: total, first, has_more, excluded (long ones) and whether more of these are left out than are shown."""
    long = F.count_if(long_running())
    total = F.count_if(~long_running())
    return rows.agg(total.alias("total"), F.lit(offset).alias("first"), (total > offset + limit).alias("has_more"), long.alias("excluded"), (long > shown_long).alias("truncated"))


def favorites_first(rows: DataFrame, least: int) -> DataFrame:
    """All favorites, and others behind them up to ``least`` rows together."""
    order = [F.desc("favorite"), F.asc("start_at"), F.asc("id")]
    return rows.where("favorite").union(rows.orderBy(*order).limit(least).where("not favorite"))


def facets(candidates: DataFrame, types: list[str], topics: list[str], wanted_types: list[str] | None, wanted_topics: list[str] | None, wanted_districts: list[str] | None, vocabulary: DataFrame) -> DataFrame:
    """(facet, value, n): each value of the vocabulary under the other filters, zeros included, in one pass."""
    t = F.lit(True) if wanted_types is None else any_of("event_type", wanted_types) & (F.col("event_type_state") != "pending")
    p = F.lit(True) if wanted_topics is None else F.arrays_overlap("topics", F.array(*map(F.lit, wanted_topics)))
    d = F.lit(True) if wanted_districts is None else any_of("district", wanted_districts)
    cells = F.array_compact(
        F.concat(
            F.array(F.when(p & d & (F.col("event_type_state") != "pending"), F.struct(F.lit("type").alias("facet"), F.col("event_type").alias("value")))),
            F.array(F.when(t & p, F.struct(F.lit("district").alias("facet"), F.col("district").alias("value")))),
            F.when(t & d, F.transform(F.array_distinct("topics"), lambda x: F.struct(F.lit("topic").alias("facet"), x.alias("value")))).otherwise(F.expr("array()")),
        )
    )
    counts = candidates.select(F.explode(cells).alias("c")).groupBy("c.facet", "c.value").count()
    return vocabulary.join(counts, ["facet", "value"], "left").select("facet", "value", F.coalesce("count", F.lit(0)).alias("n"))


def calendar_days(rows: DataFrame) -> DataFrame:
    """A row for each date that a short activity covers; the end is exclusive."""
    last = F.greatest(F.to_date("start_at"), F.date_sub(F.to_date(all_day_end()), 1))
    last = F.when(F.col("all_day"), last).otherwise(F.to_date(F.coalesce(known_end() - F.expr("interval 1 microsecond"), F.col("start_at"))))
    return rows.where(~long_running() & F.col("start_at").isNotNull()).withColumn("day", F.explode(F.sequence(F.to_date("start_at"), last)))


def overlap_pairs(selected: DataFrame, bucket_days: int = 7) -> DataFrame:
    """Pairs a < b of timed activities that overlap, by an equi-join on the weeks that each touches.

    A pair is kept only in the first week that both touch, so none comes twice and nothing is a cross join.
    """
    end = F.coalesce(known_end(), F.col("start_at") + F.expr("interval 1 second"))
    week = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / (bucket_days * 86_400_000_000))
    timed = selected.select("id", "start_at", end.alias("until"))
    dealt = timed.withColumn("week", F.explode(F.sequence(week(F.col("start_at")), week(F.col("until") - F.expr("interval 1 microsecond")))))
    a, b = dealt.alias("a"), dealt.alias("b")
    meet = (F.col("a.week") == F.col("b.week")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.start_at") < F.col("b.until")) & (F.col("b.start_at") < F.col("a.until"))
    first = F.greatest(week(F.col("a.start_at")), week(F.col("b.start_at")))
    return a.join(b, meet).where(F.col("a.week") == first).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def lifecycle(as_of: str) -> Column:
    now = at(as_of)
    return (
        F.when(F.col("status") == "cancelled", "cancelled")
        .when(F.col("status") == "needs_review", "pending")
        .when(F.col("start_at") > now, "upcoming")
        .when(F.col("all_day") & (all_day_end() <= now), "ended")
        .when(~F.col("all_day") & (known_end() <= now), "ended")
        .when(~F.col("all_day") & known_end().isNull(), "started")
        .otherwise("ongoing")
    )


def overview(rows: DataFrame, as_of: str) -> DataFrame:
    lo, hi = weekend(as_of)
    soon = period("upcoming", as_of)
    return rows.agg(
        F.count_if(soon).alias("upcoming"),
        F.count_if(soon & recommended()).alias("recommended"),
        F.count_if(period("weekend", as_of) & ~long_running()).alias("weekend"),
        F.count_if(soon & long_running()).alias("long_running"),
        F.count_if(soon & (F.col("event_type_state") == "pending")).alias("type_pending"),
        F.count_if(period("review", as_of)).alias("review"),
    )


"""The registered queries of the library and their SQL, over the views of ``plans.views``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fairground.functions import text as X
from fairground.functions import times as T
from fairground.operators import evidence as E
from fairground.operators import listing as L
from fairground.plans import views as V

QUERIES, SQL = {}, {}
AS_OF, STREAM_AS_OF = V.AS_OF, V.STREAM_AS_OF
_A, _P, _O, _S, _R = V.ACTIVITY_SQL, V.PREFERENCES_SQL, V.OBSERVATIONS_SQL, V.SOURCE_LINKS_SQL, V.RUNS_SQL
_TIMED = f"{_A}, {T.ENDS_SQL}"
_UPCOMING = f"status not in ('cancelled', 'needs_review', 'not_event') and upcoming_end > timestamp '{AS_OF}'"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def text(c: str):
    """A time as text to the second."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


# --- listing -------------------------------------------------------------------------------------------------

_GUARDS_SQL = f"""{_O}, placed as (select *, sum(cast(resolves as integer)) over (partition by source_id, event_id order by ts, observation_id rows between unbounded preceding and current row) as generation from observations),
last as (select source_id, event_id, count(*) filter (resolves) as resolutions from observations group by all),
guards as (select p.source_id, p.event_id, reason, cast(generation as bigint) as generation, count(*) as notices,
  sha256(string_agg(cast(observation_id as varchar), ',' order by observation_id)) as digest, generation = any_value(resolutions) as active
  from placed p join last l on l.source_id = p.source_id and l.event_id = p.event_id where not resolves group by p.source_id, p.event_id, reason, generation)"""


@query(f"""with {_TIMED}, {_P}, {_GUARDS_SQL}
select row_number() over (order by start_at, id) - 1 as position, id, title, strftime(start_at, '%Y-%m-%d %H:%M:%S') as start_at, coalesce(favorite, false) as favorite
from timed left join preferences p on p.event_id = id where {_UPCOMING} and not coalesce(hidden, false) and id not in (select event_id from guards where active)
order by start_at, id limit 36""")
def listing_page(spark, sf):
    """The first page of upcoming activities that are neither hidden nor guarded."""
    rows = L.with_preferences(V.activity(spark, sf), V.preferences(spark, sf)).where(L.period("upcoming", AS_OF) & ~F.col("hidden"))
    rows = L.without_guarded(rows, E.guard_fold(V.observations(spark, sf)))
    return L.page(rows, [F.asc("start_at"), F.asc("id")]).select("position", "id", "title", text("start_at"), "favorite")


def _filter(name, column, condition):
    def run(spark, sf):
        return V.activity(spark, sf).where(column() if callable(column) else column).select("id", "status")

    run.__name__ = name
    query(f"with {_TIMED} select id, status from timed where {condition}")(run)


_filter("filter_free", lambda: F.col("cost_free"), "cost_free")
_filter("filter_recommended", L.recommended, "priority in ('high', 'medium') and coalesce(commercial, '') <> 'high'")
_filter("filter_district", lambda: L.any_of("district", ["NATION_1", "NATION_7"]), "district in ('NATION_1', 'NATION_7')")
_filter("filter_no_district", lambda: L.any_of("district", []), "false")
_filter("filter_types", lambda: L.any_of("event_type", ["1-URGENT", "5-LOW"]) & (F.col("event_type_state") != "pending"), "event_type in ('1-URGENT', '5-LOW') and event_type_state <> 'pending'")
_filter("filter_topics", lambda: F.arrays_overlap("topics", F.array(F.lit("BUILDING"), F.lit("FURNITURE"))), "len(list_intersect(topics, ['BUILDING', 'FURNITURE'])) > 0")
_filter("filter_attendance", lambda: L.attends("online"), "attendance in ('online', 'hybrid')")
_filter("filter_search", lambda: L.searched("OF customer#00000001", "title", "district", "organizer"), "contains(lower(title || ' ' || district || ' ' || organizer), 'of customer#00000001')")
_filter("period_upcoming", lambda: L.period("upcoming", AS_OF), _UPCOMING)
_filter("period_week", lambda: L.period("week", AS_OF), f"{_UPCOMING} and start_at < date_trunc('week', timestamp '{AS_OF}') + interval 7 days")
_filter("period_weekend", lambda: L.period("weekend", AS_OF), f"{_UPCOMING} and start_at < timestamp '1998-06-22' and upcoming_end > timestamp '1998-06-20'")
_filter("period_past", lambda: L.period("past", AS_OF), f"case when all_day then greatest(coalesce(known_end, day_end), day_end) <= timestamp '{AS_OF}' else coalesce(known_end <= timestamp '{AS_OF}', start_at < timestamp '{AS_OF}') end")
_filter("period_calendar", lambda: L.period("calendar", AS_OF), "status = 'scheduled'")
_filter("period_review", lambda: L.period("review", AS_OF), "status = 'needs_review'")
_filter("overlaps_range", lambda: T.overlaps(T.at("1998-06-01"), T.at("1998-07-01")), "range_end > timestamp '1998-06-01' and start_at < timestamp '1998-07-01'")
_filter("hide_long", lambda: ~T.long_running(), "span_days < 14")


@query(f"with {_A}, {_P} select id, favorite, hidden, coalesce(feedback, '') as feedback, revision from (select id, coalesce(favorite, false) as favorite, coalesce(hidden, false) as hidden, feedback, coalesce(revision, 0) as revision from activity left join preferences on event_id = id)")
def join_preferences(spark, sf):
    """Owner state with defaults."""
    return L.with_preferences(V.activity(spark, sf), V.preferences(spark, sf)).select("id", "favorite", "hidden", "feedback", "revision")


@query(f"with {_A}, {_P} select id from activity where id in (select event_id from preferences where favorite)")
def semi_favorites(spark, sf):
    """P2 J2"""
    return L.only_favorites(V.activity(spark, sf), V.preferences(spark, sf)).select("id")


@query(f"with {_A}, {_GUARDS_SQL} select id from activity where id not in (select event_id from guards where active)")
def anti_guarded(spark, sf):
    """J3"""
    return L.without_guarded(V.activity(spark, sf), E.guard_fold(V.observations(spark, sf))).select("id")


@query(f"with {_A}, {_P} select id, viewed_at is not null as seen, feedback from activity join preferences on event_id = id where viewed_at is not null and feedback in ('interested', 'attended')")
def filter_feedback(spark, sf):
    """P5 P6"""
    return L.with_preferences(V.activity(spark, sf), V.preferences(spark, sf)).where("viewed_at is not null and feedback in ('interested', 'attended')").select("id", F.lit(True).alias("seen"), "feedback")


@query(f"with {_S} select event_id, string_agg(source, ',' order by seq, source_id, seen_at) as sources, min(priority) as best, count(distinct source_id) as n from source_links group by event_id")
def source_links(spark, sf):
    """The sources of each activity in order."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "source_id", "seen_at", "source")))
    return V.source_links(spark, sf).groupBy("event_id").agg(F.array_join(F.transform(ordered, lambda x: x["source"]), ",").alias("sources"), F.min("priority").alias("best"), F.count_distinct("source_id").alias("n"))


_VOCABULARY_SQL = "vocabulary as (select 'type' as facet, unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) as value union all select 'topic', unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']) union all select 'district', n_name from nation)"


@query(f"""with {_TIMED}, {_VOCABULARY_SQL}, c as (select *, event_type in ('1-URGENT', '2-HIGH') and event_type_state <> 'pending' as t, list_contains(topics, 'BUILDING') as p, district in ('NATION_1', 'NATION_2', 'NATION_3') as d from timed where {_UPCOMING}),
n as (select 'type' as facet, event_type as value, count(*) as n from c where p and d and event_type_state <> 'pending' group by 2 union all select 'district', district, count(*) from c where t and p group by 2
 union all select 'topic', topic, count(*) from (select unnest(topics) as topic from c where t and d) group by 2)
select facet, value, coalesce(n, 0) as n from vocabulary left join n using (facet, value)""")
def facets_one_pass(spark, sf):
    """A1-A4: every value of the vocabulary under the other filters."""
    small = spark.createDataFrame([("type", v) for v in V.EVENT_TYPES] + [("topic", v) for v in V.TOPICS], "facet string, value string")
    vocabulary = small.union(V.table(spark, sf, "nation").select(F.lit("district"), "n_name"))
    return L.facets(V.activity(spark, sf).where(L.period("upcoming", AS_OF)), V.EVENT_TYPES, V.TOPICS, ["1-URGENT", "2-HIGH"], ["BUILDING"], ["NATION_1", "NATION_2", "NATION_3"], vocabulary)


@query(f"""with {_TIMED} select count(*) filter ({_UPCOMING}) as upcoming, count(*) filter ({_UPCOMING} and priority in ('high', 'medium') and coalesce(commercial, '') <> 'high') as recommended,
count(*) filter ({_UPCOMING} and start_at < timestamp '1998-06-22' and upcoming_end > timestamp '1998-06-20' and span_days < 14) as weekend, count(*) filter ({_UPCOMING} and span_days >= 14) as long_running,
count(*) filter ({_UPCOMING} and event_type_state = 'pending') as type_pending, count(*) filter (status = 'needs_review') as review from timed""")
def stats_overview(spark, sf):
    """A6"""
    return L.overview(V.activity(spark, sf), AS_OF)


@query(f"with {_TIMED} select event_type, topic, count(*) as n from (select event_type, unnest(topics) as topic from timed where {_UPCOMING}) group by all")
def stats_facets(spark, sf):
    """A7"""
    return V.activity(spark, sf).where(L.period("upcoming", AS_OF)).select("event_type", F.explode("topics").alias("topic")).groupBy("event_type", "topic").agg(F.count("*").alias("n"))


@query(f"with {_TIMED}, {_P} select count(*) as total, count(*) filter (status <> 'scheduled') as unscheduled, count(*) filter (status = 'scheduled' and span_days >= 14) as long_eligible from timed join preferences on event_id = id where favorite")
def calendar_summary(spark, sf):
    """A8"""
    rows = L.only_favorites(V.activity(spark, sf), V.preferences(spark, sf))
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("status") != "scheduled").alias("unscheduled"), F.count_if((F.col("status") == "scheduled") & T.long_running()).alias("long_eligible"))


@query(f"with {_S} select source_id, count(distinct event_id) as events from source_links group by source_id")
def events_per_source(spark, sf):
    """A9"""
    return V.source_links(spark, sf).groupBy("source_id").agg(F.count_distinct("event_id").alias("events"))


@query("select user_id as publisher, count(*) as hits, max_by(event_type, (ts, event_id)) as last_query, max(event_id) as last_id from events group by 1 order by hits desc, last_id desc limit 50")
def top_candidates(spark, sf):
    """Publishers by hits, with what they were last found by."""
    found = V.table(spark, sf, "events").groupBy(F.col("user_id").alias("publisher")).agg(F.count("*").alias("hits"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_query"), F.max("event_id").alias("last_id"))
    return found.orderBy(F.desc("hits"), F.desc("last_id")).limit(50)


@query(f"with {_A} select span_days, count(*) as n from (select case when end_at is null then 0 else (epoch_us(end_at) - epoch_us(start_at)) // 86400000000 end as span_days from activity) group by 1")
def span_days(spark, sf):
    """A17 F24"""
    return V.activity(spark, sf).groupBy(T.span_days().cast("long").alias("span_days")).agg(F.count("*").alias("n"))


@query(f"""with {_TIMED}, c as (select id, start_at, case when all_day then greatest(cast(start_at as date), cast(greatest(coalesce(known_end, day_end), day_end) as date) - 1) else cast(coalesce(known_end - interval 1 microsecond, start_at) as date) end as last from timed where span_days < 14)
select strftime(day, '%Y-%m-%d') as day, count(*) as n, min(id) as first_id from (select id, unnest(generate_series(cast(start_at as date), last, interval 1 day)) as day from c) group by 1""")
def calendar_explode(spark, sf):
    """What stands on each day of the calendar."""
    return L.calendar_days(V.activity(spark, sf)).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(f"""with {_TIMED}, {_P}, c as (select id, start_at, coalesce(known_end, start_at + interval 1 second) as until from timed where not all_day and status = 'scheduled' and id in (select event_id from preferences where favorite))
select a.id as a, b.id as b from c a join c b on a.id < b.id and a.start_at < b.until and b.start_at < a.until""")
def overlap_pairs(spark, sf):
    """Pairs of saved timed activities that conflict."""
    saved = L.only_favorites(V.activity(spark, sf), V.preferences(spark, sf)).where("not all_day and status = 'scheduled'")
    return L.overlap_pairs(saved)


@query(f"""with {_TIMED} select label, count(*) as n from (select case when status = 'cancelled' then 'cancelled' when status = 'needs_review' then 'pending' when start_at > timestamp '{AS_OF}' then 'upcoming'
when all_day and greatest(coalesce(known_end, day_end), day_end) <= timestamp '{AS_OF}' then 'ended' when not all_day and known_end <= timestamp '{AS_OF}' then 'ended' when not all_day and known_end is null then 'started' else 'ongoing' end as label from timed) group by 1""")
def lifecycle_label(spark, sf):
    """F27"""
    return V.activity(spark, sf).groupBy(L.lifecycle(AS_OF).alias("label")).agg(F.count("*").alias("n"))


@query(f"with {_A}, {_P} select id, row_number() over (order by viewed_at desc, id desc) as place from activity join preferences on event_id = id where viewed_at is not null order by viewed_at desc, id desc limit 100")
def sort_history(spark, sf):
    """The hundred last viewed."""
    rows = V.activity(spark, sf).join(V.preferences(spark, sf).withColumnRenamed("event_id", "id"), "id").where("viewed_at is not null")
    order = [F.desc("viewed_at"), F.desc("id")]
    return rows.orderBy(*order).limit(100).select("id", F.row_number().over(Window.orderBy(*order)).alias("place"))


@query(f"with {_A} select district, id, lag(id) over w as previous, lead(id) over w as next from activity where status = 'scheduled' window w as (partition by district order by start_at, id)")
def prev_next(spark, sf):
    """W15"""
    w = Window.partitionBy("district").orderBy("start_at", "id")
    return V.activity(spark, sf).where("status = 'scheduled'").select("district", "id", F.lag("id").over(w).alias("previous"), F.lead("id").over(w).alias("next"))


@query(f"""with {_A}, c as (select *, coalesce(cast(cast(start_at as date) <> lag(cast(start_at as date)) over w as integer), 1) as changed from activity window w as (partition by district order by cast(start_at as date), id))
select district, id, sum(changed) over (partition by district order by cast(start_at as date), id rows unbounded preceding) as g from c""")
def contiguous_date_groups(spark, sf):
    """W14"""
    return E.contiguous_groups(V.activity(spark, sf).withColumn("date", F.to_date("start_at")), "district", "date").select("district", "id", F.col("group").alias("g"))


# --- evidence, state and quality ---------------------------------------------------------------------------------


@query(f"with {_GUARDS_SQL} select source_id, event_id, reason, generation, notices, digest, active from guards")
def guard_fold(spark, sf):
    """M12 A14 """
    return E.guard_fold(V.observations(spark, sf))


@query(f"""with {_A}, {_GUARDS_SQL}, active as (select event_id, count(*) as guards, string_agg(distinct reason, ',' order by reason) as reasons from guards where active group by event_id)
select id, case when status = 'scheduled' and coalesce(guards, 0) > 0 then 'needs_review' else status end as effective_status, status = 'scheduled' and coalesce(guards, 0) = 0 as planning_eligible, coalesce(guards, 0) as guards, reasons from activity left join active on event_id = id""")
def safety_projection(spark, sf):
    """M11 J4 """
    shown = E.project_safety(V.activity(spark, sf), E.guard_fold(V.observations(spark, sf)))
    return shown.select("id", "effective_status", "planning_eligible", "guards", F.array_join("reasons", ",").alias("reasons"))


@query("""with links as (select event_id as observation_id, event_id % 97 as e from events union select event_id, cast(floor(value) as bigint) % 97 from events)
select state, count(*) as n from (select observation_id, case count(distinct e) when 1 then 'single' else 'ambiguous' end as state from links group by 1) group by 1""")
def targeting_state(spark, sf):
    """Observations by how many activities two rules name."""
    events = V.table(spark, sf, "events")
    links = events.select(F.col("event_id").alias("observation_id"), (F.col("event_id") % 97).alias("event_id")).union(events.select("event_id", (F.floor("value") % 97).alias("e"))).distinct()
    return E.targeting(links).groupBy("state").agg(F.count("*").alias("n"))


@query(f"""with {_A}, n as (select id, district, cost_free, (origin_priority + 7) % 50 as origin_priority from activity where id % 3 <> 1), m as (select id, case when id % 5 = 0 then 'NATION_0' else district end as district, cost_free, origin_priority from n),
s as (select id, district, cost_free, origin_priority from activity where id % 4 <> 2),
j as (select s.id as sid, m.id as mid, s.district as sd, m.district as md, s.cost_free as sc, m.cost_free as mc, s.origin_priority as sp, m.origin_priority as mp from s full join m on s.id = m.id),
t as (select *, (sd, sc) is distinct from (md, mc) as diff, sid is null or (mid is not null and (sd, sc) is distinct from (md, mc) and mp <= sp) as take from j)
select coalesce(sid, mid) as id, case when take then md else sd end as district, case when take then mc else sc end as cost_free, case when take then mp else sp end as origin_priority,
  case when sid is null then 'inserted' when mid is null then 'absent' when take then 'updated' when diff then 'outranked' else 'unchanged' end as outcome from t""")
def ingest_upsert(spark, sf):
    """A staged upsert by authority."""
    a = V.activity(spark, sf)
    new = a.where("id % 3 <> 1").select("id", F.expr("if(id % 5 = 0, 'NATION_0', district)").alias("district"), "cost_free", ((F.col("origin_priority") + 7) % 50).alias("origin_priority"))
    return E.upsert(a.where("id % 4 <> 2").select("id", "district", "cost_free", "origin_priority"), new, ["district", "cost_free"])


@query(f"""with {_P}, s as (select event_id % 700 as winner, event_id, favorite, hidden, viewed_at, revision, case when event_id % 9 <> 0 then feedback end as feedback, case when event_id % 3 <> 0 then feedback_updated_at end as told_at,
  case when event_id % 4 = 0 then 't' || (event_id % 7) end as tag from preferences),
n as (select winner, feedback, tag, row_number() over (partition by winner order by (told_at is not null) desc, told_at desc, (feedback is not null or tag is not null) desc, (event_id = winner) desc, event_id desc) as k from s)
select g.*, n.feedback, n.tag as tags from (select winner, bool_or(favorite) as favorite, bool_or(hidden) as hidden, epoch_us(max(viewed_at)) as viewed_us, max(revision) + 1 as revision from s group by 1) g join n on n.winner = g.winner and k = 1""")
def merge_preferences(spark, sf):
    """M3: states with and without a time of their feedback, with tags."""
    states = V.preferences(spark, sf).withColumns({"winner": F.col("event_id") % 700, "feedback": F.expr("if(event_id % 9 <> 0, feedback, null)"), "feedback_updated_at": F.expr("if(event_id % 3 <> 0, feedback_updated_at, null)"), "tags": F.expr("if(event_id % 4 = 0, array(concat('t', event_id % 7)), null)")})
    merged = E.merge_preferences(states, "winner")
    return merged.select("winner", "favorite", "hidden", "feedback", F.array_join("tags", ",").alias("tags"), F.unix_micros(F.col("viewed_at").cast("timestamp")).alias("viewed_us"), "revision")


@query(f"with {_P} select outcome, count(*) as n from (select case when revision is null and expected = 0 then 'created' when revision = expected then 'accepted' else 'conflict' end as outcome from (select o_orderkey as event_id, o_orderkey % 5 as expected from orders) left join preferences using (event_id)) group by 1")
def preference_update_cas(spark, sf):
    """M5"""
    patches = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"), (F.col("o_orderkey") % 5).alias("expected"))
    return E.classify_patches(V.preferences(spark, sf), patches).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"""with {_A}, {_P}, {_GUARDS_SQL} select id from activity where not coalesce(coalesce(end_at, start_at) < timestamp '{AS_OF}' - interval 45 days, false) or id in (select event_id from preferences where favorite or feedback is not null) or id in (select event_id from guards where active)""")
def retention(spark, sf):
    """M7 U1 T5"""
    protected = E.guard_fold(V.observations(spark, sf)).where("active").select(F.col("event_id").alias("id"))
    return E.retained(V.activity(spark, sf), V.preferences(spark, sf), protected, AS_OF).select("id")


@query(f"with {_A} select b.id, coalesce(b.district, o.district) as district, coalesce(b.organizer, o.organizer) as organizer, concat_ws(',', case when b.district is null then 'district' end, case when b.organizer is null then 'organizer' end) as filled from (select id, case when id % 3 <> 0 then district end as district, case when id % 2 = 0 then organizer end as organizer from activity) b join activity o on o.id = b.id")
def fill_missing(spark, sf):
    """Only what is unknown is filled, with its provenance."""
    a = V.activity(spark, sf)
    base = a.select("id", F.expr("if(id % 3 <> 0, district, null)").alias("district"), F.expr("if(id % 2 = 0, organizer, null)").alias("organizer"))
    return E.fill_missing(base, a.select("id", "district", "organizer"), "id", ["district", "organizer"])


@query("with recursive e as (select o_orderkey as alias_id, o_orderkey // 3 as target_id from orders where o_orderkey % 7 in (1, 2, 4) and o_orderkey > 0), r(alias_id, target_id, k) as (select alias_id, target_id, 0 from e union all select r.alias_id, e.target_id, k + 1 from r join e on e.alias_id = r.target_id) select alias_id, arg_max(target_id, k) as target_id from r group by alias_id")
def redirect_resolve(spark, sf):
    """Redirects followed to their ends."""
    edges = V.table(spark, sf, "orders").where("o_orderkey % 7 in (1, 2, 4) and o_orderkey > 0").select(F.col("o_orderkey").alias("alias_id"), F.expr("o_orderkey div 3").alias("target_id"))
    return E.resolve_redirects(edges)


@query()
def dup_candidates(spark, sf):
    """Duplicates by date block, place and title; tests hold it against brute force."""
    return E.duplicate_pairs(V.activity(spark, sf))


@query(f"with {_R}, w as (select *, row_number() over (partition by source_id order by day) as nth, sum(tokens) over (partition by source_id order by day rows unbounded preceding) as spent from runs) select source_id, strftime(day, '%Y-%m-%d') as day, nth, max(cast(nth > 25 or spent > 3000 as integer)) over (partition by source_id order by day rows unbounded preceding) = 0 as admitted from w")
def budget_admission(spark, sf):
    """A source's daily requests until the first that would go over."""
    return E.admit_within_budget(V.runs(spark, sf), 25, 3000.0).select("source_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "nth", "admitted")


@query(f"""with {_R}, m as (select *, cast(failed >= 2 as integer) as bad from runs), i as (select *, sum(1 - bad) over (partition by source_id order by day rows unbounded preceding) as island from m),
s as (select *, sum(bad) over (partition by source_id, island order by day rows unbounded preceding) as streak from i) select source_id, strftime(day, '%Y-%m-%d') as day, streak, cast(least(48, pow(2, least(streak, 4))) as bigint) as wait_hours from s""")
def failure_streak_backoff(spark, sf):
    """W9"""
    return E.failure_streaks(V.runs(spark, sf), F.col("failed") >= 2).select("source_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "streak", "wait_hours")


@query(f"with {_R}, w as (select *, lag(visible) over (partition by source_id order by day) as before from runs) select source_id, strftime(day, '%Y-%m-%d') as day, visible, coalesce(before >= 10 and visible < 0.5 * before, false) as partial from w")
def drop_detection(spark, sf):
    """W8"""
    return E.drops(V.runs(spark, sf)).select("source_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "visible", "partial")


@query(f"with {_R} select source_id, strftime(day, '%Y-%m-%d') as day, checked from runs qualify row_number() over (partition by source_id order by day desc) = 1")
def latest_job(spark, sf):
    """The last run of each source."""
    return V.runs(spark, sf).groupBy("source_id").agg(F.max_by(F.struct("day", "checked"), "day").alias("r")).select("source_id", F.date_format("r.day", "yyyy-MM-dd").alias("day"), "r.checked")


@query(f"with {_R} select source_id, strftime(day, '%Y-%m-%d') as day from runs order by day desc, source_id limit 400")
def keep_last_n_runs(spark, sf):
    """W5 O6"""
    return V.runs(spark, sf).orderBy(F.desc("day"), "source_id").limit(400).select("source_id", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query(f"""with {_R} select source_id, strftime(day, '%Y-%m-%d') as day, visible, case when visible = 0 then 'empty' when failed = visible then 'error' when failed > 0 then 'partial' else 'ok' end as status,
concat_ws(',', case when failed > 0 then 'page_failed' end, case when checked * 10 < visible then 'detail_deferred' end) as reasons, case when visible > 0 then greatest(0, visible - checked - failed) end as unaccounted from runs""")
def run_status(spark, sf):
    """Counters, status and reasons of each run."""
    v, f, c = F.col("visible"), F.col("failed"), F.col("checked")
    return V.runs(spark, sf).select(
        "source_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "visible",
        F.when(v == 0, "empty").when(f == v, "error").when(f > 0, "partial").otherwise("ok").alias("status"),
        F.array_join(F.array_compact(F.array(F.when(f > 0, "page_failed"), F.when(c * 10 < v, "detail_deferred"))), ",").alias("reasons"),
        F.when(v > 0, F.greatest(F.lit(0), v - c - f)).alias("unaccounted"),
    )


@query(f"with {_R} select source_id, strftime(day, '%Y-%m-%d') as day, last_value(case when checked > 1 then visible end ignore nulls) over (partition by source_id order by day rows unbounded preceding) as last_good from runs")
def last_good_sample(spark, sf):
    """Q6: the last sample with counters, up to each run."""
    w = Window.partitionBy("source_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return V.runs(spark, sf).select("source_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.last(F.when(F.col("checked") > 1, F.col("visible")), ignorenulls=True).over(w).alias("last_good"))


@query("with l as (select event_id, user_id, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as gap from events) select user_id, count(*) filter (gap < 120000000) as hasty, count(*) as requests from l group by 1")
def request_log_audit(spark, sf):
    """Requests less than two minutes after the one before."""
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = ts - F.lag(ts).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return V.table(spark, sf, "events").select("user_id", gap.alias("gap")).groupBy("user_id").agg(F.count_if(F.col("gap") < 120_000_000).alias("hasty"), F.count("*").alias("requests"))


@query(f"with {_A} select count(*) as n_rows, cast(sum(cast('0x' || substr(sha256(id || '|' || status || '|' || district), 1, 12) as bigint)) as varchar) as signature from activity")
def table_signature(spark, sf):
    """The same for the same rows in any order."""
    return E.signature(V.activity(spark, sf), ["id", "status", "district"])


# --- pages and texts ----------------------------------------------------------------------------------------------

_TITLE, _H1 = r"(?s)<title>(.*?)</title>", r"(?s)<h1>(.*?)</h1>"


@query(rf"select page_id, trim(regexp_replace(regexp_extract(html, '{_TITLE}', 1), '\s+', ' ', 'g')) as title, regexp_extract(html, '<html lang=\"(\w+)\"', 1) as lang, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) as links, len(regexp_extract_all(html, '<p>')) as paragraphs, regexp_matches(regexp_extract(html, '{_TITLE}', 1), '(?i)captcha') as blocked from pages")
def captured_pages(spark, sf):
    """A row a page with title, language, links and whether it is a refusal."""
    title = F.regexp_extract("html", _TITLE, 1)
    return V.table(spark, sf, "pages").select(
        "page_id", X.clean(title).alias("title"), F.regexp_extract("html", r'<html lang="(\w+)"', 1).alias("lang"), F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("links"),
        F.size(F.regexp_extract_all("html", F.lit("<p>"), F.lit(0))).alias("paragraphs"), title.rlike("(?i)captcha").alias("blocked"),
    )


@query(r"""with u as (select page_id, url, lower(regexp_extract(url, '^(https?)://', 1)) as s, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) as h, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) as p,
 list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' and not starts_with(string_split(x, '=')[1], 'utm_') and string_split(x, '=')[1] not in ('from', 'spm', 'chksm', 'scene', 'clicktime', 'enterid')) as q from pages)
select page_id, case when s <> '' and h <> '' then s || '://' || h || p || case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end else '' end as canonical from u""")
def canon_url(spark, sf):
    """F4 D1"""
    return V.table(spark, sf, "pages").select("page_id", X.canon_url(F.col("url")).alias("canonical"))


@query("with c as (select page_id, regexp_extract(url, '^[^:]+://([^/?#]*[^?#]*)', 1) as k, regexp_matches(url, '[?]') as dated from pages) select k as page, page_id from c qualify row_number() over (partition by k order by dated desc, page_id) = 1")
def first_seen_item(spark, sf):
    """One page an address, one with parameters first."""
    rows = V.table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[^:]+://([^/?#]*[^?#]*)", 1).alias("page"), F.contains("url", F.lit("?")).alias("dated"))
    return rows.groupBy("page").agg(F.min_by("page_id", F.struct(~F.col("dated"), "page_id")).alias("page_id"))


@query("select signature, count(*) as pages, min(page_id) as first_page from (select page_id, sha256(array_to_string(list_sort(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)), ' ')) as signature from pages) group by 1 having count(*) > 1")
def repeat_page(spark, sf):
    """Q3: pages with the same set of links."""
    links = F.array_sort(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)))
    return V.table(spark, sf, "pages").select("page_id", F.sha2(F.array_join(links, " "), 256).alias("signature")).groupBy("signature").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page")).where("pages > 1")


_KEYWORDS = {"motion": ["er", "tion"], "place": ["der", "la"], "group": ["and", "und", "et"], "accent": ["é", "ñ", "ü"]}
_HITS = ", ".join("case when " + " or ".join(f"contains(t, '{w}')" if not w.isascii() else f"regexp_matches(t, '(^|[^a-z0-9]){w}([^a-z0-9]|$)')" for w in ws) + f" then '{k}' end" for k, ws in _KEYWORDS.items())


@query(f"select doc_id, concat_ws(',', {_HITS}) as topics from (select doc_id, lower(text) as t from documents)")
def topic_rules(spark, sf):
    """topics of keywords at word boundaries."""
    return V.table(spark, sf, "documents").select("doc_id", F.array_join(X.topic_rules(F.col("text"), _KEYWORDS), ",").alias("topics"))


@query(r"select doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) as content_hash, substr(sha256(source || '|' || cast(doc_id as varchar)), 1, 20) as event_id, length(text) as n from documents")
def content_hash(spark, sf):
    """F1 F21 F22 """
    d = V.table(spark, sf, "documents")
    return d.select("doc_id", F.sha2(F.trim(F.regexp_replace("text", r"\s+", " ")), 256).alias("content_hash"), F.substring(F.sha2(F.concat_ws("|", "source", F.col("doc_id").cast("string")), 256), 1, 20).alias("event_id"), F.length("text").alias("n"))


@query(r"""select doc_id, count(*) as blocks, max(n) as longest from (select doc_id, block, count(*) as n from (select doc_id, sum(cast(length(line) < 40 as integer)) over (partition by doc_id order by pos rows unbounded preceding) as block
from (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(0, len(string_split(text, chr(10))))) as pos from documents)) group by all) group by 1""")
def block_ids(spark, sf):
    """A text's lines in blocks that a short line begins."""
    lines = V.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    block = F.sum((F.length("line") < 40).cast("int")).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return lines.select("doc_id", block.alias("block")).groupBy("doc_id", "block").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.count("*").alias("blocks"), F.max("n").alias("longest"))


@query("select conv_id, turn, role, last_value(case when role = 'system' or turn = 0 then turn end ignore nulls) over (partition by conv_id order by turn rows unbounded preceding) as section from conversations")
def carry_forward_section(spark, sf):
    """The last heading up to each row."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return V.table(spark, sf, "conversations").select("conv_id", "turn", "role", F.last(F.when((F.col("role") == "system") | (F.col("turn") == 0), F.col("turn")), ignorenulls=True).over(w).alias("section"))


@query("select kept, reason, count(*) as n from (select reason is null as kept, coalesce(reason, '') as reason from (select case when length(text) < 40 then 'short_lead' when lang not in ('en', 'de') then 'other_city' when n_chars > 20000 then 'too_long' end as reason from documents)) group by all")
def admission(spark, sf):
    """What is admitted, and why the rest is not."""
    reason = F.when(F.length("text") < 40, "short_lead").when(~F.col("lang").isin("en", "de"), "other_city").when(F.col("n_chars") > 20000, "too_long")
    return V.table(spark, sf, "documents").select(reason.isNull().alias("kept"), F.coalesce(reason, F.lit("")).alias("reason")).groupBy("kept", "reason").agg(F.count("*").alias("n"))


@query("select source, text_sha, count(*) as copies, min(doc_id) as keep from (select source, doc_id, sha256(text) as text_sha from documents) group by all having count(*) > 1")
def search_identity(spark, sf):
    """The same text of one source under several addresses."""
    rows = V.table(spark, sf, "documents").select("source", "doc_id", F.sha2("text", 256).alias("text_sha"))
    return rows.groupBy("source", "text_sha").agg(F.count("*").alias("copies"), F.min("doc_id").alias("keep")).where("copies > 1")


@query(f"with {_A}, {_P} select 'BEGIN:VEVENT' || chr(10) || 'UID:' || id || '@fairground' || chr(10) || 'DTSTART;VALUE=DATE:' || strftime(start_at, '%Y%m%d') || chr(10) || 'SUMMARY:' || title || chr(10) || 'END:VEVENT' as vevent from activity where all_day and status = 'scheduled' and id in (select event_id from preferences where favorite)")
def ics_events(spark, sf):
    """K2: calendar entries of saved activities of known days."""
    rows = L.only_favorites(V.activity(spark, sf), V.preferences(spark, sf)).where("all_day and status = 'scheduled'")
    return rows.select(F.concat_ws("\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), "id", F.lit("@fairground")), F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format("start_at", "yyyyMMdd")), F.concat(F.lit("SUMMARY:"), "title"), F.lit("END:VEVENT")).alias("vevent"))

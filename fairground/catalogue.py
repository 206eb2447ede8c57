"""More registered queries: listing completeness, time and text grammar, aliases, queues and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairground.functions import text as X
from fairground.functions import times as T
from fairground.operators import aliases as N
from fairground.operators import evidence as E
from fairground.operators import listing as L
from fairground.plans import views as V
from fairground.queries import _A, _GUARDS_SQL, _P, _R, _S, _TIMED, _UPCOMING, AS_OF, query, text


def _owned(spark, sf) -> DataFrame:
    return L.with_preferences(V.activity(spark, sf), V.preferences(spark, sf))


_VISIBLE = f"{_UPCOMING} and not coalesce(hidden, false)"
_OWNED_SQL = f"{_TIMED}, {_P}, owned as (select timed.*, coalesce(favorite, false) as favorite, coalesce(hidden, false) as hidden, viewed_at, feedback, feedback_updated_at from timed left join preferences on event_id = id)"


# --- listing -------------------------------------------------------------------------------------------------


@query(f"with {_OWNED_SQL} select count(*) filter (span_days < 14) as total, 0 as first, count(*) filter (span_days < 14) > 36 as has_more, count(*) filter (span_days >= 14) as excluded, count(*) filter (span_days >= 14) > 12 as truncated from owned where {_VISIBLE}")
def listing_summary(spark, sf):
    """K5 O3 A5: what a page of 36 is told with: total, offset, whether more follow, and how many long ones are left out."""
    return L.summary(_owned(spark, sf).where(L.period("upcoming", AS_OF) & ~F.col("hidden")))


@query(f"with {_OWNED_SQL} select row_number() over (order by start_at, id) - 1 as position, id from owned where {_VISIBLE} and span_days >= 14 order by start_at, id limit 12")
def excluded_long(spark, sf):
    """A5: the first twelve of the long activities that a listing leaves out."""
    rows = _owned(spark, sf).where(L.period("upcoming", AS_OF) & ~F.col("hidden") & T.long_running())
    return L.page(rows, [F.asc("start_at"), F.asc("id")], limit=12).select("position", "id")


@query(f"with {_OWNED_SQL}, long as (select *, row_number() over (order by favorite desc, start_at, id) as k from owned where {_VISIBLE} and span_days >= 14) select id, favorite from long where favorite or k <= 8")
def favorites_first(spark, sf):
    """Of the long activities all favorites, and at least eight."""
    return L.favorites_first(_owned(spark, sf).where(L.period("upcoming", AS_OF) & ~F.col("hidden") & T.long_running()), 8).select("id", "favorite")


@query(f"with {_OWNED_SQL} select id, case when feedback is null then 'none' else 'any' end as signal, coalesce(feedback = 'attended', false) as attended from owned")
def feedback_signals(spark, sf):
    """Any feedback, none, or an exact one."""
    return _owned(spark, sf).select("id", F.when(F.col("feedback").isin("interested", "attended"), "any").otherwise("none").alias("signal"), F.coalesce(F.col("feedback") == "attended", F.lit(False)).alias("attended"))


@query(f"""with {_OWNED_SQL} select 'saved' as period, id from owned where favorite union all select 'record', id from owned union all
select 'feedback', id from owned where feedback is not null union all select 'history', id from owned where viewed_at is not null""")
def personal_periods(spark, sf):
    """Periods without a rule of dates: saved ones are favorites, feedback means any, history is what was seen."""
    rows = _owned(spark, sf)
    parts = F.array_compact(F.array(F.when(F.col("favorite"), "saved"), F.lit("record"), F.when(F.col("feedback") != "", "feedback"), F.when(F.col("viewed_at").isNotNull(), "history")))
    return rows.select(F.explode(parts).alias("period"), "id")


@query(f"with {_A}, {_GUARDS_SQL} select id from activity where status = 'needs_review' or status = 'scheduled' and id in (select event_id from guards where active)")
def review_effective(spark, sf):
    """Stored reviews, and scheduled ones under an active guard."""
    rows = V.activity(spark, sf).where("status in ('needs_review', 'scheduled')")
    guarded = E.guard_fold(V.observations(spark, sf)).where("active").select(F.col("event_id").alias("id")).distinct().withColumn("guarded", F.lit(True))
    return rows.join(guarded, "id", "left").where((F.col("status") == "needs_review") | F.col("guarded")).select("id")


@query(f"with {_OWNED_SQL} select row_number() over (order by feedback_updated_at desc, start_at, id) - 1 as position, id, feedback from owned where feedback is not null order by feedback_updated_at desc, start_at, id limit 36")
def sort_feedback(spark, sf):
    """O2: the latest feedback first."""
    return L.page(_owned(spark, sf).where("feedback in ('interested', 'attended')"), [F.desc("feedback_updated_at"), F.asc("start_at"), F.asc("id")]).select("position", "id", "feedback")


@query(f"with {_TIMED} select * from (select 'up' as direction, row_number() over (order by end_at nulls last, id) - 1 as position, id from timed order by position limit 36) union all select * from (select 'down', row_number() over (order by end_at desc nulls last, id desc) - 1 as position, id from timed order by position limit 36)")
def sort_display(spark, sf):
    """O1: both directions, unknown times last in both, the id in the same direction."""
    rows = V.activity(spark, sf)
    up = L.page(rows, [F.asc_nulls_last("end_at"), F.asc("id")]).select(F.lit("up").alias("direction"), "position", "id")
    return up.union(L.page(rows, [F.desc_nulls_last("end_at"), F.desc("id")]).select(F.lit("down"), "position", "id"))


@query(f"with {_P} select event_id, strftime(viewed_at, '%Y-%m-%d %H:%M:%S') as viewed_at from preferences where viewed_at is not null")
def mark_viewed(spark, sf):
    """M6: the last view of each activity; no revision is made."""
    return V.table(spark, sf, "events").where("event_type = 'view'").groupBy((F.col("event_id") % 3000).alias("event_id")).agg(F.max("ts").alias("viewed_at")).select("event_id", text("viewed_at"))


# --- aliases and identity ------------------------------------------------------------------------------------

_ALIASES_SQL = "aliases as (select p_partkey as alias_id, p_partkey % 10 as url, date '1996-01-01' + cast(p_partkey % 900 as integer) as day from part)"
_HITS_SQL = f"{_A}, {_S}, {_ALIASES_SQL}, hits as (select distinct alias_id, id, title, start_at, origin_priority from activity join source_links on event_id = id join aliases on url = source_id % 10 and day = cast(start_at as date))"


def _aliases(spark, sf) -> DataFrame:
    return V.table(spark, sf, "part").select(F.col("p_partkey").alias("alias_id"), (F.col("p_partkey") % 10).alias("url"), F.expr("date_add(date '1996-01-01', cast(p_partkey % 900 as int))").alias("day"))


def _alias_links(spark, sf) -> DataFrame:
    return V.source_links(spark, sf).select("event_id", (F.col("source_id") % 10).alias("url"))


@query(f"with {_HITS_SQL} select id, coalesce('Alias ' || max(alias_id), any_value(activity.title)) as title from activity left join hits using (id) group by id")
def alias_override(spark, sf):
    """The last alias with the activity's date and one of its addresses gives the title."""
    return N.override(V.activity(spark, sf), _alias_links(spark, sf), _aliases(spark, sf)).select("id", "title")


@query(f"""with {_HITS_SQL}, {_P}, {_GUARDS_SQL},
ranked as (select *, count(*) over (partition by alias_id) as n, max(cast(id in (select event_id from guards where active) as integer)) over (partition by alias_id) as held,
  first_value(id) over (partition by alias_id order by case when coalesce(favorite, false) then 0 else 1 end, origin_priority, start_at, id) as winner from hits left join preferences on event_id = id)
select alias_id, id, winner, case when held = 1 then 'deferred' when id = winner then 'kept' else 'merged' end as outcome from ranked where n > 1""")
def alias_reconcile(spark, sf):
    """Activities that share an alias become one, favorites and better origins first; a guarded one defers the group."""
    guarded = E.guard_fold(V.observations(spark, sf)).where("active").select(F.col("event_id").alias("id")).distinct()
    favorites = V.preferences(spark, sf).select(F.col("event_id").alias("id"), "favorite")
    return N.reconcile(V.activity(spark, sf), _alias_links(spark, sf), _aliases(spark, sf), favorites, guarded)


@query(f"with {_A}, {_GUARDS_SQL} select title, bool_and(status <> 'cancelled' and id not in (select event_id from guards where active)) as eligible from activity group by title")
def not_blocked(spark, sf):
    """What may be classified: no linked activity is cancelled or guarded."""
    guarded = E.guard_fold(V.observations(spark, sf)).where("active").select(F.col("event_id").alias("id")).distinct().withColumn("guarded", F.lit(True))
    rows = V.activity(spark, sf).join(guarded, "id", "left")
    return rows.groupBy("title").agg(F.bool_and((F.col("status") != "cancelled") & F.col("guarded").isNull()).alias("eligible"))


@query(f"with {_S} select c_custkey as id from customer where c_custkey not in (select event_id from source_links)")
def not_linked_raw(spark, sf):
    """Raw rows that no link refers to."""
    return V.table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).join(V.source_links(spark, sf).select(F.col("event_id").alias("id")), "id", "left_anti")


# --- queues, sets and reconciliation -------------------------------------------------------------------------


@query(f"with {_R}, l as (select source_id, max(day) as day, arg_max(failed, day) as failed from runs group by 1) select source_id, strftime(day, '%Y-%m-%d') as last_run, day + cast(failed % 7 as integer) <= date '2024-01-20' as due from l")
def due_sources(spark, sf):
    """Sources whose next attempt, put off by their failures, has come."""
    last = V.runs(spark, sf).groupBy("source_id").agg(F.max("day").alias("day"), F.max_by("failed", "day").alias("failed"))
    return last.select("source_id", F.date_format("day", "yyyy-MM-dd").alias("last_run"), (F.date_add("day", (F.col("failed") % 7).cast("int")) <= F.lit("2024-01-20").cast("date")).alias("due"))


@query(f"with {_R}, l as (select source_id, max(day) as day, sum(checked) as checked from runs group by 1) select row_number() over (order by day, checked, source_id) - 1 as position, source_id from l order by position limit 12")
def rotating_queue(spark, sf):
    """The sources that were longest left alone, up to a budget of twelve."""
    last = V.runs(spark, sf).groupBy("source_id").agg(F.max("day").alias("day"), F.sum("checked").alias("checked"))
    return L.page(last, [F.asc("day"), F.asc("checked"), F.asc("source_id")], limit=12).select("position", "source_id")


@query(f"with {_R}, {_S} select distinct source_id % 40 as source_id, strftime(seen_at, '%m-%d') as day from source_links where (source_id % 40, strftime(seen_at, '%m-%d')) not in (select (source_id, strftime(day, '%m-%d')) from runs)")
def monthly_deferred(spark, sf):
    """What was to be visited and was not."""
    eligible = V.source_links(spark, sf).select((F.col("source_id") % 40).alias("source_id"), F.date_format("seen_at", "MM-dd").alias("day")).distinct()
    return eligible.join(V.runs(spark, sf).select("source_id", F.date_format("day", "MM-dd").alias("day")), ["source_id", "day"], "left_anti")


@query("""with d as (select l_orderkey as id, list_sort(coalesce(list(distinct cast(l_shipdate as date)) filter (l_linenumber % 2 = 1), [])) as a,
list_sort(coalesce(list(distinct cast(l_shipdate as date)) filter (l_linenumber % 2 = 0), [])) as b from lineitem group by 1) select id, len(list_intersect(a, b)) as shared, a = b as same from d""")
def date_set_compare(spark, sf):
    """The dates of a list against those of its body: how many are in both, and whether they are the same."""
    odd = F.col("l_linenumber") % 2 == 1
    dates = lambda rows: F.array_sort(F.collect_set(F.when(rows, F.to_date("l_shipdate"))))
    sets = V.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(dates(odd).alias("a"), dates(~odd).alias("b"))
    return sets.select("id", F.size(F.array_intersect("a", "b")).cast("long").alias("shared"), (F.col("a") == F.col("b")).alias("same"))


@query(f"with {_R} select source_id, cast(sum(visible) as bigint) as visible, cast(sum(checked) as bigint) as checked, cast(sum(failed) as bigint) as failed, cast(sum(visible - checked - failed) as bigint) as deferred from runs group by 1")
def collect_summary(spark, sf):
    """A12"""
    return V.runs(spark, sf).groupBy("source_id").agg(F.sum("visible").alias("visible"), F.sum("checked").alias("checked"), F.sum("failed").alias("failed"), F.sum(F.expr("visible - checked - failed")).alias("deferred"))


@query("select o_orderkey as id, count(l_orderkey) as observed, coalesce(max(l_linenumber), 0) as declared, coalesce(max(l_linenumber), 0) - count(l_orderkey) as gap, count(l_orderkey) > 0 as comparable from orders left join lineitem on o_orderkey = l_orderkey group by 1")
def source_total_reconcile(spark, sf):
    """Q4: declared against observed rows."""
    lines = V.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("observed"), F.max("l_linenumber").alias("declared"))
    rows = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")).join(lines, "id", "left").select("id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("observed", "declared")))
    return rows.select("*", (F.col("declared") - F.col("observed")).alias("gap"), (F.col("observed") > 0).alias("comparable"))


# --- pages, times and texts ----------------------------------------------------------------------------------


@query(f"select page_id, regexp_matches(lower(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), '{'|'.join(X.BLOCKED_TITLES)}') or contains(url, '/antispider') as blocked from pages")
def blocked_pages(spark, sf):
    """Refusals, by the words of their titles or their address."""
    return V.table(spark, sf, "pages").select("page_id", X.blocked(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1), F.col("url")).alias("blocked"))


@query(r"""with l as (select page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"[^>]*>([^<]*)</a>', 1)) as href, unnest(regexp_extract_all(html, '<a href="([^"]*)"[^>]*>([^<]*)</a>', 2)) as label, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"[^>]*>([^<]*)</a>', 1), 1) - 1 as pos from pages)
select page_id, href, arg_min(label, pos) as label, min(pos) as pos from l group by page_id, href""")
def page_cards(spark, sf):
    """The links of a listing page with their labels, each address once, at its first place."""
    return X.cards(V.table(spark, sf, "pages"))


@query(r"select page_id, regexp_matches(url, '^https://([a-z0-9-]+\.)*example\.(com|net)/(en|de)/\d+([?#].*)?$') as allowed from pages")
def same_origin(spark, sf):
    """P25: https, the host or one under it, no port, and a path of the known form."""
    return V.table(spark, sf, "pages").select("page_id", F.coalesce(X.same_origin(F.col("url"), [r"example\.com", r"example\.net"], r"/(en|de)/\d+"), F.lit(False)).alias("allowed"))


@query(r"""with u as (select page_id, url, regexp_extract(url, '^([^?#]*)', 1) as base, list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' and string_split(x, '=')[1] <> 'page') as q from pages)
select page_id, base || '?' || array_to_string(list_append(q, 'page=7'), '&') as url from u""")
def set_query(spark, sf):
    """an address with one parameter set."""
    return V.table(spark, sf, "pages").select("page_id", X.set_query(F.col("url"), "page", "7").alias("url"))


@query(f"with {_A} select id, strftime(start_at, '%Y-%m-%d') as start, case when end_at is null then strftime(start_at + interval 1 day, '%Y-%m-%d') when year(end_at) = year(start_at) then strftime(end_at + interval 1 day, '%Y-%m-%d') end as stop from activity where year(start_at) >= 2000 and (end_at is null or year(end_at) = year(start_at))")
def date_range(spark, sf):
    """ranges as pages write them, read again; a range into the next year has no year of its own, so it is none."""
    wrote = F.concat(F.lit("时间: "), F.date_format("start_at", "yyyy年M月d日"), F.when(F.col("end_at").isNotNull(), F.concat(F.lit("—"), F.date_format("end_at", "M月d日"))).otherwise(""))
    rows = V.activity(spark, sf).select("id", X.date_range(wrote).alias("r")).where("r is not null")
    return rows.select("id", F.date_format("r.start", "yyyy-MM-dd").alias("start"), F.date_format("r.end", "yyyy-MM-dd").alias("stop"))


@query("""select event_id, case event_id % 4 when 0 then strftime(ts, '%Y-%m-%dT%H:%M:%S+08:00') when 1 then strftime(ts + interval 8 hours, '%Y-%m-%dT%H:%M:%S+08:00')
when 2 then strftime(ts, '%Y-%m-%dT00:00:00+08:00') end as iso from events""")
def iso_times(spark, sf):
    """times without zone are local, others are converted, a date is its midnight, anything else is null."""
    wrote = F.expr("case event_id % 4 when 0 then date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") when 1 then date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") when 2 then date_format(ts, 'yyyy-MM-dd') else 'soon' end")
    return V.table(spark, sf, "events").select("event_id", T.iso(wrote).alias("iso"))


@query(f"with {_A} select id, case when id % 5 = 0 then case when id % 3 = 0 then 'online' when id % 3 = 1 then 'unknown' else 'offline' end else attendance end as attendance from activity")
def attendance_of(spark, sf):
    """the stated mode, or what the place says."""
    place = F.expr("case id % 3 when 0 then '线上' when 1 then '待确认' else '深圳湾' end")
    return V.activity(spark, sf).select("id", X.attendance(F.when(F.col("id") % 5 != 0, F.col("attendance")), place).alias("attendance"))


@query("select c_custkey as id, cast(c_acctbal as double) as lon, cast(c_nationkey as double) as lat from customer where c_custkey % 7 <> 0")
def coords(spark, sf):
    """two numbers of a text, or nothing."""
    wrote = F.when(F.col("c_custkey") % 7 != 0, F.concat_ws(",", F.col("c_acctbal").cast("string"), F.col("c_nationkey").cast("string"))).otherwise("113.9;22.5")
    return V.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), X.coords(wrote).alias("p")).where("p is not null").select("id", "p.lon", "p.lat")


@query("select c_custkey as id, case when c_custkey % 4 = 0 then '' else c_mktsegment || case when c_custkey % 2 = 0 and c_mktsegment <> 'BUILDING' then ',BUILDING' else '' end end as tags from customer")
def decode_tags(spark, sf):
    """known words of a JSON list, each once; a list that is none has none."""
    wrote = F.when(F.col("c_custkey") % 4 == 0, "[broken").otherwise(F.to_json(F.array("c_mktsegment", F.lit("other"), F.when(F.col("c_custkey") % 2 == 0, "BUILDING").otherwise(F.col("c_mktsegment")))))
    return V.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.array_join(X.decode_tags(wrote, V.TOPICS), ",").alias("tags"))


@query(f"with {_A} select id, list_min(list_transform(topics, lambda t: case when t = 'HOUSEHOLD' then 'HOME' else t end)) as first, len(topics) as n from activity")
def legacy_topic_migrate(spark, sf):
    """A topic under its new name."""
    return V.activity(spark, sf).select("id", X.renamed("topics", "HOUSEHOLD", "HOME").alias("t")).select("id", F.array_min("t").alias("first"), F.size("t").cast("long").alias("n"))


@query("select l_orderkey as id, l_linenumber as line, case when l_returnflag = l_linestatus then l_returnflag else l_returnflag || '; ' || l_linestatus end as note from lineitem")
def append_note(spark, sf):
    """notes, each once, in order."""
    return V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), X.append_note(F.array("l_returnflag", "l_linestatus", "l_returnflag")).alias("note"))


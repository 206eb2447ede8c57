"""Registered queries of what is let in: gated inventories and details, and what a run takes up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairground.operators import intake as I
from fairground.plans import views as V
from fairground.queries import _A, query
from fairground.sources import gated as K
from fairground.sources import notices as N
from fairground.upkeep import _DAY

HOST = "www.example.com"
_LIST = f"https://{HOST}/event/"
#: Days of the activities, within the years that pages write.
_ON = "add_months(to_date(start_at), 336)"


def _day_text(c: str, name: str):
    return F.date_format(c, "yyyy-MM-dd").alias(name)


@query(f"""with {_A}, c as (select *, id // 12 as page_id, case when id % 13 = 0 then '' else title end as head, case when id % 17 = 0 then '' else '{_LIST}' || (id - cast(id % 5 = 0 as integer)) || '.html' end as link,
  case when id % 7 <> 0 then {_DAY} end as day, id % 11 = 0 as ended from activity),
r as (select *, case when head = '' or link = '' then 'title_or_link' when ended then 'ended' end as bad from c),
n as (select *, row_number() over (partition by page_id, link order by bad is not null, id) as nth from r)
select page_id, row_number() over (partition by page_id order by id) - 1 as pos, head as title, link, '深圳 ' || district as place, organizer, ['offline', 'online', 'hybrid', 'unknown'][id % 4 + 1] as attendance, case id % 4 when 1 then '线上' else '深圳' end as city,
  strftime(day, '%Y-%m-%d') as start, case when status = 'cancelled' and not ended then 'cancelled' when day is null or id % 4 = 3 then 'needs_review' else 'scheduled' end as status,
  concat_ws(',', case when day is null then 'shown_not_held' end, case when id % 4 = 3 then 'attendance_conflict' end) as notes, coalesce(bad, case when nth > 1 then 'repeated' end) as reject from n""")
def gated_inventory(spark, sf):
    """Lists whose cards count only with title, address of the site and a way to attend that isn't contradicted."""
    day, label = f"if(id % 7 = 0, '推广期 9月1日 - 9月30日', date_format({_ON}, '活动时间：yyyy年M月d日'))", "if(id % 11 = 0, '精彩回放', if(status = 'cancelled', '已取消', '报名中'))"
    tags = "element_at(array('线下活动', '线上', '线上</span><span class=\"post-tag\">线下 同步直播', '线上</span><span class=\"post-tag\">线下'), cast(id % 4 as int) + 1)"
    card = f"""concat('<li class="section-special-item"><div><a href="', if(id % 17 = 0, '/people/', concat('/event/', id - if(id % 5 = 0, 1, 0))), '.html?from=list" class="item-title">', if(id % 13 = 0, '', concat('<b>', title, '</b>')), '</a></div><div><span class="post-tag">', {tags}, '</span></div>
      <p class="event-location">地点：深圳 ', district, '</p><i class="status">', {label}, '</i><div class="event-organizer">主办方：', organizer, '</div><div class="event-time"><em>', {day}, '</em></div></li>')"""
    cards = V.activity(spark, sf).groupBy(F.expr("id div 12").alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", F.expr(card).alias("p")))), lambda x: x["p"]), "").alias("body"))
    pages = cards.select("page_id", F.lit(_LIST).alias("url"), F.concat(F.lit('<main class="special-list"><ul class="section-list-item-ul">'), "body", F.lit("</ul></main>")).alias("html"))
    return K.gated_inventory(pages, HOST).select("page_id", "pos", "title", "link", "place", "organizer", "attendance", "city", _day_text("start", "start"), "status", F.array_join("notes", ",").alias("notes"), "reject")


def _judged(rows: DataFrame, title: str, host: str, day: str, more: str, status: str, html: str) -> DataFrame:
    """Captures of all rows, with what is given of each, and what the rules say of them."""
    at = f"concat('{_LIST}', id, '.html')"
    candidates = rows.select("id", F.expr(at).alias("url"), "title", "organizer", F.lit("").alias("place"), F.lit("").alias("summary"), F.lit("offline").alias("attendance"), F.expr(f"date_format({_ON}, 'yyyy年M月d日')").alias("date_evidence"), F.lit("list_meeting_time").alias("role"))
    page = f"""concat('<body><nav><h1>x</h1></nav><article><h1>', {title}, '</h1><p>主办方：<b>', {host}, '</b></p><p>活动时间：', date_format({day}, 'yyyy年M月d日'), ' 14:00–16:00</p><p>活动地点：深圳科技园</p>', {more}, '<aside><p>主办方：other</p></aside></article></body>')"""
    captures = rows.select(F.col("id").alias("capture_id"), "id", F.expr(at).alias("final"), F.expr(html.format(page)).alias("html"), F.expr(f"array(named_struct('url', {at}, 'status', {status}, 'location', cast(null as string)))").alias("trace"))
    return K.gated_details(candidates, captures, HOST)


@query(f"""with {_A}, d as (select *, {_DAY} as day from activity),
f as (select *, id % 23 = 0 as lost, case when id % 7 = 0 then day + 1 else day end as told from d)
select id, case when lost then concat_ws(',', case when id % 19 = 0 then 'trace' end, 'identity') else concat_ws(',', case when id % 19 = 0 then 'trace' end, case when id % 11 = 0 then 'title' end, case when id % 17 = 0 then 'semantics' end,
  case when id % 13 = 0 then 'organizer' end, case when id % 7 = 0 then 'dates' end, case when year(told) <> year(day) then 'years' end, case when id % 7 = 0 then 'corroboration' end) end as failures,
  case when lost then 7 else 0 end as undecided, case when id % 19 = 0 then 'incomplete' end as trace_fault from f""")
def gated_details(spark, sf):
    """Details held against their candidates by nine rules, with every reason against them."""
    judged = _judged(V.activity(spark, sf), "if(id % 11 = 0, 'another', title)", "if(id % 13 = 0, 'someone', organizer)", f"date_add({_ON}, if(id % 7 = 0, 1, 0))", "if(id % 17 = 0, '<p>回放</p>', '')", "if(id % 19 = 0, 404, 200)", "if(id % 23 = 0, null, {})")
    return judged.select("id", F.array_join("failures", ",").alias("failures"), F.size("undecided").alias("undecided"), "trace_fault")


@query(f"""with {_A}, d as (select *, {_DAY} as day, id % 4 <> 0 as has from activity)
select id, case when has then '深圳科技园' else district end as place, strftime(case when has and id % 3 <> 2 then day + interval 14 hours when id % 3 = 0 then null when id % 3 = 2 then day + interval 3 days else day end, '%Y-%m-%d %H:%M:%S') as start,
  case when not has then status when id % 10 = 5 or status = 'cancelled' then 'cancelled' when id % 3 = 2 then 'needs_review' else 'scheduled' end as status, has and id % 3 = 2 as time_conflict,
  case when has then 2 else 1 end as evidence, case when has and id % 3 <> 2 then 'held_as_detailed' else 'shown_not_held' end as notes from d""")
def admitted_details(spark, sf):
    """Admitted details merged: times appended, other days a conflict, cancelled wins."""
    rows = V.activity(spark, sf)
    judged = _judged(rows, "if(id % 4 = 0, 'another', title)", "organizer", _ON, "if(id % 10 = 5, '<p>当前状态：已取消</p>', '')", "200", "{}")
    on = f"cast({_ON} as timestamp_ntz)"
    base = rows.select("id", F.lit("u").alias("url"), "organizer", F.col("district").alias("place"), F.expr(f"case id % 3 when 1 then {on} when 2 then {on} + interval 3 days end").alias("start"), F.expr("cast(null as timestamp_ntz)").alias("end"), F.lit(True).alias("all_day"), "status", F.lit("offline").alias("attendance"),
                       F.array(F.lit("list")).alias("time_evidence"), F.lit(False).alias("hold"), F.lit(False).alias("attendance_conflict"), F.lit(False).alias("time_conflict"), F.array(F.lit("shown_not_held")).alias("notes"))
    merged = K.merge_admitted(base, judged)
    shown = F.array_join("notes", ",")
    return merged.select("id", "place", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "status", "time_conflict", F.size("time_evidence").alias("evidence"), shown.alias("notes"))


# --- intake --------------------------------------------------------------------------------------------------


@query("""with m as (select 'https://i.example.com/' || p_partkey as url, sha256(cast(p_partkey as varchar)) || '.png' as asset from part where p_partkey % 3 <> 0),
d as (select distinct l_orderkey as id, 'https://i.example.com/' || l_partkey as url from lineitem where l_linenumber % 5 <> 0),
n as (select id, string_agg(url || '=' || asset, ' ' order by url) as images from d join m using (url) group by 1) select id, coalesce(images, '') as images from (select distinct l_orderkey as id from lineitem) left join n using (id)""")
def approved_images(spark, sf):
    """Pictures of details that a reviewed manifest names."""
    lines, url = V.table(spark, sf, "lineitem"), "concat('{}://i.example.com/', {})"
    details = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.expr(f"if(l_linenumber % 5 = 0, {url.format('http', 'l_partkey')}, {url.format('https', 'l_partkey')})")).alias("images"))
    manifest = V.table(spark, sf, "part").select(F.expr(url.format("https", "p_partkey")).alias("url"), F.expr("concat(if(p_partkey % 3 = 0, '../', ''), sha2(cast(p_partkey as string), 256), '.png')").alias("asset"))
    return I.approved_images(details, manifest).select("id", F.array_join(F.transform(F.map_entries("images"), lambda e: F.concat_ws("=", e["key"], e["value"])), " ").alias("images"))


@query("""with p as (select page_id % 40 as source_id, page_id as seq, 'https://h' || (page_id % 40) || '.example.com/list?p=' || page_id as url from pages), f as (select source_id, min(seq) as a, max(seq) as z from p group by 1),
k as (select source_id, case when source_id % 4 = 0 then null when source_id % 4 = 1 then a + 40 * ((z - a) // 80) end as cut from f),
r as (select p.*, cut is null as root, row_number() over (partition by source_id order by seq) as k, lead(url, 5) over (partition by source_id order by seq) as after from p join k using (source_id) where cut is null or seq >= cut)
select source_id, seq, url, root as traversal_from_root, first_value(after) over (partition by source_id order by seq) as next_cursor, first_value(after) over (partition by source_id order by seq) is not null as truncated from r qualify k <= 5""")
def resumed_pages(spark, sf):
    """The pages that each source's next run visits, behind its cursor or from the root."""
    pages = V.table(spark, sf, "pages").selectExpr("page_id % 40 as source_id", "page_id as seq", "concat('https://h', page_id % 40, '.example.com/list?p=', page_id) as url")
    span = pages.groupBy("source_id").agg(F.min("seq").alias("a"), F.max("seq").alias("z"))
    at = "a + 40 * ((z - a) div 80)"
    cursors = span.where("source_id % 4 <> 0").selectExpr("source_id", f"concat(if(source_id % 4 = 1, concat('https://h', source_id), 'https://elsewhere'), '.example.com/list?p=', {at}) as next_cursor")
    return I.resumed(pages, span.selectExpr("source_id", "concat('https://h', source_id, '.example.com/list') as url"), cursors, 5)


@query("""with s as (select s_suppkey as source_id, s_suppkey % 50 as priority, case when s_suppkey % 5 <> 0 then s_suppkey % 17 end as last, case when s_suppkey % 7 <> 0 then s_suppkey % 3 end as following, 10 + s_suppkey % 40 as seconds from supplier),
d as (select *, coalesce(following <= 1, true) as due from s), o as (select source_id, 380 - coalesce(sum(seconds) over (order by coalesce(last, -1), priority, source_id rows between unbounded preceding and 1 preceding), 0) as remains from d where due)
select source_id, case when not due then 'waiting' when remains >= 20 then 'running' else 'deferred' end as state from d left join o using (source_id)""")
def due_in_order(spark, sf):
    """Due sources, longest left alone first, as long as the run's time lasts."""
    at = "timestamp_ntz '2026-09-14 00:00:00' + make_dt_interval(cast({} as int))"
    sources = V.table(spark, sf, "supplier").selectExpr("s_suppkey as source_id", "s_suppkey % 50 as priority", f"if(s_suppkey % 5 = 0, null, {at.format('s_suppkey % 17')}) as last_attempt", f"if(s_suppkey % 7 = 0, null, {at.format('s_suppkey % 3')}) as next_attempt", "10 + s_suppkey % 40 as seconds")
    return I.due_sources(sources, F.expr("timestamp_ntz '2026-09-15 00:00:00'"))


@query(f"""with {_A}, i as (select *, id % 6 as c, attendance in ('online', 'hybrid') and id % 5 <> 0 as net, case when id % 9 <> 0 then start_at end as first, case when id % 7 = 0 then title || ' in Shenzhen' else title end as head, repeat('s', 20 + id % 40) as lead from activity),
p as (select *, case c when 0 then '深圳' when 1 then '广州' when 2 then '外市' else '待确认' end as seen, id % 8 < 2 as national, id % 8 = 2 as strict, id % 8 = 3 as structured from i),
q as (select *, case when net then '深圳' else seen end as place, not net and seen = '待确认' and national as reviewed from p),
r as (select *, case when place not in ('深圳', '待确认') then 'other_city' when place = '待确认' and (strict or structured or (national and id % 7 <> 0)) then 'city_unsure' when not reviewed and coalesce(end_at, first) < timestamp '1996-01-01' - interval 45 days then 'past'
  when (reviewed or first is null) and length(lead) < 40 and id % 10 <> 0 then 'short_lead' when id % 13 = 0 then 'no_title_or_link' end as reject from q)
select id, case when reject is null then case when net then case c when 0 then '深圳' when 1 then '广州' else '线上' end else '深圳' end end as city, case when reviewed then 'needs_review' else status end as admitted_status, reject, reviewed or first is null as undated from r""")
def admitted_items(spark, sf):
    """What a run admits by city, source, age and substance, with the first reason against each row."""
    rows = V.activity(spark, sf).withColumn("c", F.expr("id % 6"))
    items = rows.select(
        "id", F.expr("if(id % 7 = 0, concat(title, ' in Shenzhen'), title)").alias("title"), F.expr("repeat('s', cast(20 + id % 40 as int))").alias("summary"), F.expr("if(c = 2, 'Kowloon Bay', '')").alias("place"), F.expr("case c when 0 then '深圳' when 1 then '广州' else '' end").alias("stated_city"), F.expr("if(id % 13 = 0, 'x', 'https://e.example.com/')").alias("url"),
        "attendance", F.expr("if(id % 9 = 0, null, start_at)").alias("start"), F.col("end_at").alias("end"), "status", F.expr("id % 5 <> 0").alias("allow_online"), F.lit("").alias("city_scope"), F.expr("id % 8 < 2").alias("national"), F.expr("id % 8 = 2").alias("strict"), F.expr("id % 8 = 3").alias("structured"), F.expr("id % 10 = 0").alias("detail_candidate"),
    )
    return I.admitted(items, F.expr("timestamp_ntz '1996-01-01 00:00:00'")).select("id", "city", "admitted_status", "reject", F.col("start").isNull().alias("undated"))


@query("""with c as (select c_custkey as id, c_custkey % 6 as k, c_custkey % 300 as n from customer)
select id, case k when 0 then '南山' when 1 then '宝安' when 2 then '福田' when 3 then '龙岗' else '' end as district, case k when 0 then 'text' when 1 then 'text' when 2 then 'geocode' when 5 then 'skip' else 'poi' end as method, case k when 4 then 'not_found' when 5 then 'skipped' else 'ok' end as outcome from c""")
def resolved_districts(spark, sf):
    """Districts by a place's own words, then one gazetteer district, then ranked places."""
    rows = V.table(spark, sf, "customer").selectExpr("c_custkey as id", "c_custkey % 6 as k", "concat('会馆', c_custkey % 300, '号楼') as hall").selectExpr("id", "k", "hall", "case k when 0 then concat('深圳市南山区', hall) when 1 then concat(hall, ' near Bao An') when 5 then concat('香港', hall) else concat('深圳 / ', hall) end as place")
    halls = rows.select("hall", "k").distinct()
    geocodes = halls.where("k in (2, 3)").selectExpr("hall as query", "explode(if(k = 2, array('福田区'), array('福田区', '南山区'))) as district", "'440304' as adcode")
    places = halls.where("k = 3").selectExpr("hall as query", "hall as name", "'' as address", "'龙岗' as district")
    return I.resolved_districts(rows.select("id", "place"), geocodes, places)


@query(f"""with {_A}, d as (select *, {_DAY} as day from activity) select id as page_id, '第二十届光博会（' || year(day) || '）' as title, strftime(day, '%Y-%m-%d') as start, strftime(day + 3, '%Y-%m-%d') as stop from d where id % 5 <> 0 and day(day) <= 20""")
def announcements(spark, sf):
    """The one sentence of a page that announces an edition, its days and its place."""
    told = f"concat('第二十届光博会（CIOE）将于', date_format({_ON}, 'yyyy年M月d'), if(day({_ON}) > 20, '', concat('-', day({_ON}) + 2)), '日在', if(id % 5 = 0, '别处', '会展中心'), '举办')"
    pages = V.activity(spark, sf).select(F.col("id").alias("page_id"), F.expr(f"concat('<nav>他将于明日来</nav><div><p>', title, '。<b>', {told}, '</b>。</p></div>')").alias("html"))
    return N.announcements(pages, "光博会", "CIOE", "会展中心").select("page_id", "title", _day_text("start", "start"), _day_text("end", "stop"))


@query(f"""with {_A}, d as (select *, {_DAY} as day from activity) select id as page_id, title, 'https://e.example.com/' || id as link, strftime(day, '%Y-%m-%d') as start, strftime(day + 1 + cast(id % 3 as integer), '%Y-%m-%d') as stop, case when id % 2 = 0 then 'ConferenceEvent' else 'CourseInstance' end as kind,
case id % 4 when 1 then '线上' else district end as place, attendance, ['Python', 'Hardware / IoT', 'Poetry'][id % 3 + 1] as category, ['软件开发', '硬件创客', ''][id % 3 + 1] as topics from d where id % 4 in (1, 2) and id % 7 <> 0 and id % 11 <> 0""")
def developer_rows(spark, sf):
    """Rows that declare activities had online, with the topics of their category."""
    text = "concat(element_at(array('Python', 'Hardware / IoT', 'Poetry'), cast(id % 3 as int) + 1), if(id % 2 = 0, ' conference', ' masterclass'), ' in Shenzhen')"
    mode = "element_at(array('Offline', 'Online', 'Mixed', 'Unknown'), cast(id % 4 as int) + 1)"
    page = f"""concat('<div class="x row', if(id % 7 = 0, ' featured', ''), '"><time>t</time><script type="application/ld+json">{{"eventAttendanceMode": "https://schema.org/', {mode}, 'EventAttendanceMode", "name": "', title, '", "url": "https://e.example.com/', id, '?utm_medium=x", "location": {{"name": "', district, '"}},
      "description": "', {text}, '", "startDate": "', date_format({_ON}, 'yyyy-MM-dd'), '", "endDate": "', date_format(date_add({_ON}, if(id % 11 = 0, -1, cast(id % 3 as int))), 'yyyy-MM-dd'), 'T10:00"}}</script></div>')"""
    found = N.developer_rows(V.activity(spark, sf).select(F.col("id").alias("page_id"), F.expr(page).alias("html")))
    return found.select("page_id", "title", "link", _day_text("start", "start"), _day_text("end", "stop"), "kind", "place", "attendance", "category", F.array_join("topics", ",").alias("topics"))


@query(f"""with {_A}, f as (select *, id % 4 <> 2 as was, id % 4 <> 3 as new, case when id % 5 = 0 then '南山' else '待确认' end as d from activity),
t as (select *, new and (not was or (id % 7 <> 0 and 25 <= origin_priority)) as takes, new and was and 25 <= origin_priority as ranks from f)
select id, case when takes then 'new ' || title else title end as title, case when takes and id % 3 = 0 then 'moved' else district end as place, case when takes and (not was or id % 3 = 0) then '待确认' else d end as district,
  case when not (takes or ranks) or (was and id % 2 = 0 and event_type_state = 'source') then event_type when id % 2 = 0 then 'Event' else 'MusicEvent' end as event_type,
  case when not takes then status when was and id % 8 < 4 and status = 'cancelled' and id % 9 <> 0 then 'cancelled' when was and id % 6 = 0 then 'needs_review' else 'scheduled' end as status,
  case when takes then 25 else origin_priority end as origin_priority, case when not was then 'inserted' when not new then 'absent' when takes then 'replaced' when ranks then 'typed' else 'seen' end as outcome, not was as first_seen_now from t""")
def sticky_ingest(spark, sf):
    """M1: rows of a run put in, with what sticks: district, type, hold, cancellation and first sight."""
    rows = V.activity(spark, sf).withColumnsRenamed({"start_at": "start", "end_at": "end", "district": "place"})
    then = F.expr("timestamp_ntz '2026-01-01 00:00:00'")
    stored = rows.where("id % 4 <> 2").select("id", "title", "start", "end", "place", F.expr("if(id % 5 = 0, '南山', '待确认')").alias("district"), "event_type", "event_type_state", "status", F.expr("id % 6 = 0").alias("hold"), "origin_priority", F.lit("h").alias("content_hash"), then.alias("first_seen"), then.alias("last_seen"), F.lit("done").alias("ai_state"))
    new = rows.where("id % 4 <> 3").select("id", F.expr("concat('new ', title)").alias("title"), "start", "end", F.expr("if(id % 3 = 0, 'moved', place)").alias("place"), F.lit("待确认").alias("district"), F.expr("if(id % 2 = 0, 'Event', 'MusicEvent')").alias("event_type"), F.lit("source").alias("event_type_state"), F.lit("scheduled").alias("status"),
                                           F.expr("if(id % 7 = 0 and id % 4 <> 2, 'h', 'n')").alias("content_hash"), F.lit(25).alias("priority"), F.expr("id % 8 < 4").alias("gated"), F.expr("id % 9 = 0").alias("reinstated"))
    out = I.ingested(stored, new, F.expr("timestamp_ntz '2026-09-14 00:00:00'"))
    return out.select("id", "title", "place", "district", "event_type", "status", "origin_priority", "outcome", (F.month("first_seen") == 9).alias("first_seen_now"))


@query(f"""with {_A}, e as (select * from activity where status = 'scheduled' and id % 3 <> 0),
t as (select 1 as part, cast(id as varchar) as id, concat_ws(chr(13) || chr(10), 'BEGIN:VEVENT', 'UID:' || id || '@fairground', 'DTSTAMP:20260901T000000Z', 'LAST-MODIFIED:20260901T000000Z',
  'DTSTART' || case when all_day then strftime(start_at, ';VALUE=DATE:%Y%m%d') else strftime(start_at, ';TZID=Asia/Shanghai:%Y%m%dT%H%M%S') end, case when all_day then strftime(coalesce(end_at, start_at + interval 1 day), 'DTEND;VALUE=DATE:%Y%m%d') when end_at is not null then strftime(end_at, 'DTEND;TZID=Asia/Shanghai:%Y%m%dT%H%M%S') end,
  'SUMMARY:' || title || '\\, x\\; y', 'LOCATION:' || district, 'DESCRIPTION:费用：' || case when cost_free then '免费' else '费用未注明' end || '\\n以主办方最新说明为准。\\n' || organizer || ': https://o.example.com/', case when id % 2 = 0 then 'URL:https://e.example.com/' || id end, 'STATUS:CONFIRMED', 'END:VEVENT') as text from e)
select * from t union all select 0, null, concat_ws(chr(13) || chr(10), 'BEGIN:VCALENDAR', 'VERSION:2.0', 'PRODID:-//fairground//activities//ZH-CN', 'X-WR-CALNAME:saved', 'X-WR-TIMEZONE:Asia/Shanghai') union all select 2, null, 'END:VCALENDAR'""")
def calendar_lines(spark, sf):
    """K2: a whole calendar, its lines unfolded again for the comparison."""
    rows = V.activity(spark, sf).select(
        "id", F.expr("concat(title, ', x; y')").alias("title"), F.lit(None).cast("string").alias("summary"), F.col("district").alias("place"), F.expr("if(id % 2 = 0, concat(' https://e.example.com/', id), 'none')").alias("url"), F.expr("if(cost_free, '免费', null)").alias("cost_text"), F.col("start_at").alias("start"), F.col("end_at").alias("end"),
        "all_day", "status", F.expr("id % 3 <> 0").alias("planning_eligible"), F.expr("timestamp_ntz '2026-09-01 00:00:00'").alias("last_seen"), F.expr("array(struct(organizer as name, 'https://o.example.com/' as url))").alias("sources"),
    )
    return I.calendar_lines(rows, "saved").select("part", "id", F.replace("text", F.lit("\r\n "), F.lit("")).alias("text"))

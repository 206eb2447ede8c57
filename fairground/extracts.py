"""Registered queries of extraction, grammar and merging.

Pages and texts are written from the activity tables by fixed rules, in Spark, and read again by the operators; the SQL says
what must come out, from the tables themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairground.functions import grammar as G
from fairground.functions.text import DISTRICTS
from fairground.operators import evidence as E
from fairground.operators import listing as L
from fairground.operators import merges as M
from fairground.plans import views as V
from fairground.queries import _A, _GUARDS_SQL, _P, query
from fairground.sources import elements as S
from fairground.sources import records as R

_W = f"{_A}, w as (select *, cast(start_at + interval 28 years as date) as day, cast(coalesce(end_at, start_at) + interval 28 years as date) as last from activity)"
_FEE = "if(cost_free, '免费', concat(id % 300, '元'))"
_FEE_SQL = "case when cost_free then '免费' else (id % 300) || '元' end"


def _written(spark, sf) -> DataFrame:
    """Activities with their first and last day, 28 years on, where weekdays and leap years are the same."""
    return V.activity(spark, sf).withColumn("day", F.expr("add_months(to_date(start_at), 336)")).withColumn("last", F.expr("add_months(to_date(coalesce(end_at, start_at)), 336)"))


def _iso(c, name: str):
    return F.date_format(c, "yyyy-MM-dd").alias(name)


def _pages(rows: DataFrame, page: str, piece: str, order: str = "id", between: str = "") -> DataFrame:
    """(page_id, html): the pieces of each page in order; a page has as many as its rule gives it, however large the table."""
    pieces = rows.groupBy(F.expr(page).alias("page_id")).agg(F.array_sort(F.collect_list(F.struct(F.expr(order).alias("k"), F.expr(piece).alias("p")))).alias("ps"))
    return pieces.select("page_id", F.array_join(F.transform("ps", lambda p: p["p"]), between).alias("html"))


# --- grammar -------------------------------------------------------------------------------------------------


@query(f"with {_W} select id, strftime(day, '%Y-%m-%d') as start, strftime((case when id % 6 < 3 then last else day end) + 1, '%Y-%m-%d') as stop from w where id % 6 in (0, 1, 2, 4)")
def explicit_ranges(spark, sf):
    """Ranges with and without years, across months and years, with blanks; open-ended ones and those without a year are none."""
    wrote = F.expr("""case id % 6 when 0 then concat(date_format(day, 'yyyy年M月d日'), '—', date_format(last, 'yyyy年M月d日')) when 1 then concat(date_format(day, 'M月d日'), '至', date_format(last, 'M月d日'))
    when 2 then concat(date_format(day, 'yyyy.M.d'), if(trunc(day, 'MM') = trunc(last, 'MM'), date_format(last, '-d'), date_format(last, '~yyyy.M.d'))) when 3 then concat('即日起至', date_format(last, 'M月d日'))
    when 4 then date_format(day, 'yyyy - MM - dd') else date_format(day, 'M月d日') end""")
    r = G.explicit_range(G.without_spaces(wrote), F.expr("if(id % 6 = 1, year(day), null)"))
    return _written(spark, sf).select("id", F.explode(F.array_compact(F.array(r))).alias("r")).select("id", _iso("r.start", "start"), _iso("r.end", "stop"))


@query(f"with {_W}, c as (select id, day, id % 24 * 60 + id % 60 as a, (id * 7 + 3) % 24 * 60 + 30 as b from w) select id, strftime(cast(day as timestamp) + to_minutes(cast(a as integer)), '%Y-%m-%d %H:%M') as start, strftime(cast(day as timestamp) + to_minutes(cast(b as integer)), '%Y-%m-%d %H:%M') as stop from c where b > a")
def clock_ranges(spark, sf):
    """two clocks on a date; a second one that is not later is none."""
    wrote = F.expr("concat(date_format(day, 'yyyy年M月d日'), ' ', id % 24, ':', lpad(cast(id % 60 as string), 2, '0'), ' — ', (id * 7 + 3) % 24, ':30')")
    rows = _written(spark, sf).select("id", G.clock_range(wrote).alias("r")).where("r is not null")
    return rows.select("id", *(F.date_format(f"r.{c}", "yyyy-MM-dd HH:mm").alias(n) for c, n in (("start", "start"), ("end", "stop"))))


@query(f"with {_W} select id, case when day = last then strftime(day, '%Y-%m-%d') else strftime(day, '%Y-%m-%d') || ',' || strftime(last, '%Y-%m-%d') end as dates from w")
def calendar_dates(spark, sf):
    """the full dates of a text that exist, each once."""
    wrote = F.expr("concat(date_format(last, 'yyyy/M/d'), ' and ', date_format(day, 'yyyy年M月d日'), ', 2026-02-30, ', date_format(day, 'yyyy-MM-dd'), ', 13/1')")
    return _written(spark, sf).select("id", F.array_join(F.transform(G.calendar_dates(wrote), lambda d: d.cast("string")), ",").alias("dates"))


@query(f"with {_A} select id, organizer || case when id % 2 = 0 then ',Second' else '' end as organizers, case when id % 3 <> 0 then district end as place from activity")
def labeled_fields(spark, sf):
    """values of labels at the beginnings of lines, each once."""
    wrote = F.expr("concat('主办方： ', organizer, '\n', if(id % 3 = 0, '', concat('活动地点:', district, '\n')), '非主办方：no\n主办单位：', if(id % 2 = 0, 'Second', organizer), '\n主办方：  ')")
    return V.activity(spark, sf).select("id", F.array_join(G.labeled(wrote, ["主办方", "主办单位"]), ",").alias("organizers"), F.get(G.labeled(wrote, ["活动地点"]), F.lit(0)).alias("place"))


@query(f"with {_A} select id, case when id % 3 <> 0 then district || ' hall' end as place, {_FEE_SQL} as fee, organizer as publisher from activity")
def inline_fields(spark, sf):
    """labels inside running text."""
    wrote = F.expr(f"concat('时间：9月 ', if(id % 3 = 0, '', concat('地点： ', district, ' hall ')), '费用：', {_FEE}, ' 发起:', organizer, ' ', id, '人参加')")
    return V.activity(spark, sf).select("id", *(G.inline_field(wrote, label, most).alias(n) for n, label, most in (("place", "地点", 250), ("fee", "费用", 100), ("publisher", "发起", 100))))


@query(f"with {_A} select id, ['hybrid', 'offline', 'hybrid', 'offline', 'unknown', 'offline'][id % 6 + 1] as mode from activity")
def broadcast_modes(spark, sf):
    """a live broadcast that a clause affirms; one that it denies, or that is off, is none."""
    wrote = F.expr("element_at(array('本次活动同步直播', '本次不提供线上直播', '上次没有直播，但本次会同步进行直播', '线上直播已取消', '同步直播', '现场活动'), cast(id % 6 as int) + 1)")
    return V.activity(spark, sf).select("id", G.mode_of(wrote, F.expr("if(id % 6 = 4, ' ', district)")).alias("mode"))


@query(f"with {_W} select id, ['cancelled', 'reinstated', 'moved', null, null][id % 5 + 1] as state, case when id % 5 = 2 then strftime(day, '%Y-%m-%d') end as old, case when id % 5 = 2 then strftime(last, '%Y-%m-%d') end as new from w")
def notice_states(spark, sf):
    """notices about the whole activity; those about a part, or quoted, say nothing."""
    wrote = F.expr("element_at(array('本次活动已取消。', '已恢复举办', concat('原定于', date_format(day, 'yyyy年M月d日'), '，现改期至', date_format(last, 'yyyy年M月d日')), '部分场次取消', '“活动已取消”不实'), cast(id % 5 as int) + 1)")
    return _written(spark, sf).select("id", G.state_of(wrote).alias("state"), _iso(G.moved(wrote)["old"], "old"), _iso(G.moved(wrote)["new"], "new"))


@query(f"with {_A} select id, ['ComedyEvent', 'MusicEvent', 'TheaterEvent', null][id % 4 + 1] as show, case when id % 3 < 2 then district else '' end as label, case when id % 3 = 1 then 'CourseInstance' else 'ConferenceEvent' end as kind from activity")
def stated_kinds(spark, sf):
    """kinds that a title or a fixed form of description states."""
    title = F.expr("concat(title, element_at(array(' 周末脱口秀', ' 新年音乐会', ' 话剧之夜', ' market'), cast(id % 4 as int) + 1))")
    about = G.course_or_conference(F.expr("concat(district, element_at(array(' conference in ', ' masterclass in ', ' meeting in '), cast(id % 3 as int) + 1), organizer)"))
    return V.activity(spark, sf).select("id", G.show_type(title).alias("show"), about["label"].alias("label"), about["kind"].alias("kind"))


@query(f"with {_A} select id, case id % 4 when 0 then '户外生活' when 1 then '文化艺术' when 2 then list_min(topics) else '其他' end as topic, case when id % 4 = 2 then len(topics) else 1 end as n from activity")
def resolved_topics(spark, sf):
    """topics that are stated, else the one of the kind, else the other one."""
    topics = F.expr("case id % 4 when 1 then array('其他') when 2 then array_append(topics, 'nonsense') end")
    kind = F.expr("element_at(array('SportsEvent', 'MusicEvent', 'SportsEvent', 'Event'), cast(id % 4 as int) + 1)")
    return V.activity(spark, sf).select("id", G.resolved_topics(topics, kind, V.TOPICS).alias("t")).select("id", F.array_min("t").alias("topic"), F.size("t").cast("long").alias("n"))


@query(f"with {_A} select id, case when id % 5 in (0, 2) then district || ' hall' else '' end as asked, list_value('南山', '大鹏', '', '', '')[id % 5 + 1] as district from activity")
def place_queries(spark, sf):
    """What a gazetteer is asked, and which districts are ones of the city."""
    place = F.expr("element_at(array(concat('广东省深圳市 · ', district, ' hall'), concat('香港 ', district), concat(district, ' hall（具体地址以原文为准）'), '地址待定', '报名成功后通知地址'), cast(id % 5 as int) + 1)")
    name = F.expr("element_at(array('南山区', '大鹏新区', '朝阳区', '南山', null), cast(id % 5 as int) + 1)")
    return V.activity(spark, sf).select("id", G.place_query(place).alias("asked"), G.district(name, F.expr("if(id % 5 = 3, '4401', '440305')")).alias("district"))


# --- pages ---------------------------------------------------------------------------------------------------

_CARDS_SQL = f"""{_W}, c as (select id, id // 20 as page_id, case when id % 13 = 0 then '' else title || ' & friends' end as title, case when id % 17 = 0 then '' else 'https://a.example.com/e/' || (id - cast(id % 23 = 0 as integer)) end as link,
  case when id % 19 <> 0 then day end as start, case when id % 19 <> 0 then last + 1 end as stop, district as place from w)"""


@query(f"""with {_CARDS_SQL} select page_id, row_number() over (partition by page_id order by id) - 1 as pos, title, link, strftime(start, '%Y-%m-%d') as start, strftime(stop, '%Y-%m-%d') as stop, place,
case when title = '' then 'title' when link = '' then 'link' when start is null then 'date' when row_number() over (partition by page_id, link order by title = '', start is null, id) > 1 then 'repeated' end as reject from c""")
def listing_cards(spark, sf):
    """The cards of listing pages of three kinds, each taken or rejected with its reason."""
    title, link = "if(id % 13 = 0, '', concat('<b>', title, '</b> &amp; friends'))", "if(id % 17 = 0, '', concat('https://a.example.com/e/', id - if(id % 23 = 0, 1, 0), '?utm_source=x#top'))"
    date = "if(id % 19 = 0, '', concat(date_format(day, 'yyyy年M月d日'), '—', date_format(last, 'M月d日')))"
    piece = f"""element_at(array(concat('<div class="card"><a href="', {link}, '"><h3>', {title}, '</h3></a><time>', {date}, '</time> <span class="place">', district, '</span></div>'),
    concat('<li><a href="', {link}, '">', {title}, '</a> <em>', {date}, '</em><i>', district, '</i></li>'), concat('<tr data-url="', {link}, '"><td>', {title}, '</td> <td>', {date}, '</td><td>', district, '</td></tr>')), cast(id div 20 % 3 as int) + 1)"""
    pages = _pages(_written(spark, sf), "id div 20", piece).select("page_id", F.expr("element_at(array('cards', 'list', 'rows'), cast(page_id % 3 as int) + 1)").alias("kind"), "html", F.lit(None).cast("int").alias("year"))
    return R.listing_cards(pages).select("page_id", "pos", "title", "link", _iso("start", "start"), _iso("end", "stop"), "place", "reject")


@query(f"""with {_W}, b as (select *, 'month ' || district || strftime(day, ' %Y-%m') as page_id, unnest(case when id % 3 = 0 then ['展会' || id || case when id % 2 = 0 then ' / Expo ' || id else '' end, '大会' || id] else ['展会' || id || case when id % 2 = 0 then ' / Expo ' || id else '' end] end) as name from w)
select page_id, name as title, district || ' hall' as venue, case when id % 4 <> 0 then organizer else '' end as organizer, strftime(day, '%Y-%m-%d') as start, strftime(last + 1, '%Y-%m-%d') as stop, substr(sha256(name || '|' || strftime(day, '%Y-%m-%d') || '|' || district || ' hall'), 1, 20) as record_id from b where id % 5 <> 0""")
def month_blocks(spark, sf):
    """The blocks of a month's page, titles with their aliases, one row a title."""
    piece = """concat_ws('\n', cast(id % 100 as string), concat('展会', id), if(id % 2 = 0, concat('Expo ', id), ''), if(id % 3 = 0, concat('大会', id), null), '— a note', if(id % 5 = 0, 'nowhere', concat('场 馆： ', district, ' hall')),
    concat('开展时间：', date_format(day, 'M月d日'), '至', date_format(last, 'M月d日')), if(id % 4 = 0, 'x', concat('主/承办单位:', organizer)))"""
    pages = _pages(_written(spark, sf), "concat('month ', district, date_format(day, ' yyyy-MM'))", piece, between="\n")
    found = R.blocks(pages.select("page_id", F.substring_index("page_id", " ", -1).substr(1, 4).cast("int").alias("year"), F.col("html").alias("body")))
    return found.select("page_id", "title", "venue", "organizer", _iso("start", "start"), _iso("end", "stop"), "record_id")


@query(f"with {_W} select district || ' ' || year(day) as page_id, title || ' ' || id as title, strftime(day, '%Y-%m-%d') as start, strftime(last + 1, '%Y-%m-%d') as stop, organizer from w where id % 7 <> 0")
def schedule_tables(spark, sf):
    """The rows of a year's table under the headings of its months."""
    rows = _written(spark, sf).withColumn("page", F.expr("concat(district, ' ', year(day))"))
    heads = rows.select("page", F.month("day").alias("month"), F.lit(-1).cast("long").alias("id"), F.concat(F.lit("<tr><td colspan=4>"), F.date_format("day", "yyyy年M月"), F.lit("</td></tr>")).alias("piece")).distinct()
    date = "concat(if(id % 7 = 0, concat(month(day) % 12 + 1, '月1日'), date_format(day, 'M月d日')), ' - ', date_format(last, 'M月d日'))"
    lines = rows.select("page", F.month("day").alias("month"), "id", F.expr(f"concat('<tr><td>', id, '</td><td>', title, ' ', id, '</td><td>', {date}, '</td><td><p>', organizer, '</p></td></tr>')").alias("piece"))
    pages = _pages(heads.union(lines), "page", "piece", "struct(month, id)")
    return R.schedule_rows(pages).select("page_id", "title", _iso("start", "start"), _iso("end", "stop"), "organizer")


@query(f"""with {_W} select id // 50 as source_id, title, case when id % 17 = 0 then '' else 'https://b.example.com/' || id end as link, case when year(day - cast(id % 30 as integer)) = year(day) then strftime(day, '%Y-%m-%d') end as start,
case when year(day - cast(id % 30 as integer)) = year(day) then strftime(last + 1, '%Y-%m-%d') end as stop, district as place, case when id % 4 = 0 then '' else organizer end as organizer, {_FEE_SQL} as fee, case when id % 11 = 0 then 'protected' when id % 17 = 0 then 'title or link' end as reject from w""")
def posts_feed(spark, sf):
    """The posts of feeds, with what their labels say; the year of a date is that of publication, or none."""
    post = F.struct(
        F.struct(F.expr("concat('<b>', title, '</b>')").alias("rendered")).alias("title"),
        F.expr("if(id % 17 = 0, null, concat('https://b.example.com/', id))").alias("link"),
        F.expr("concat(date_sub(day, cast(id % 30 as int)), 'T08:00:00')").alias("date"),
        F.struct(F.expr(f"concat('<script>var x;</script><p>活动时间：', date_format(day, 'M月d日'), '至', date_format(last, 'M月d日'), '</p><p>活动地点：<b>', district, '</b></p><p>主办方：', organizer, '</p>', if(id % 4 = 0, '<p>主办方：Other</p>', ''), '<p>票价：', {_FEE}, '</p>')").alias("rendered"), F.expr("id % 11 = 0").alias("protected")).alias("content"),
    )
    feeds = _written(spark, sf).groupBy(F.expr("id div 50").alias("source_id")).agg(F.to_json(F.collect_list(post)).alias("body"))
    return R.posts(feeds).select("source_id", "title", "link", _iso("start", "start"), _iso("end", "stop"), "place", "organizer", "fee", "reject")


@query(f"""with {_A} select id // 50 as page_id, null as error, id as item, title from activity where id // 50 % 7 > 2 union all
select distinct id // 50, ['not one literal', 'escapes', 'not a list'][id // 50 % 7 + 1], null, null from activity where id // 50 % 7 < 3""")
def embedded_inventory(spark, sf):
    """The one literal that a page embeds, checked against its form, or why there is none."""
    lists = V.activity(spark, sf).groupBy(F.expr("id div 50").alias("page_id")).agg(F.to_json(F.collect_list(F.struct("id", "title"))).alias("json"))
    html = F.expr("element_at(array(concat('JSON.parse(`', json, '`);JSON.parse(`[]`)'), concat('JSON.parse(`$', '{x}', json, '`)'), 'JSON.parse(`oops`)', concat('const a=JSON.parse(`', json, '`);')), least(cast(page_id % 7 as int) + 1, 4))")
    return R.inventory(lists.select("page_id", html.alias("html")), "id: long, title: string").select("page_id", "error", F.col("item.id").alias("item"), F.col("item.title").alias("title"))


@query(f"with {_A} select 'https://c.example.com/' || id || '.html' as link, title, cast(id % 3 = 0 and id % 9 <> 0 as bigint) as recaps, case when id % 6 = 0 and id % 9 <> 0 then 'needs_review' else 'scheduled' end as status from activity")
def recap_pairs(spark, sf):
    """Recaps with their announcements, by address, start and place."""
    a = V.activity(spark, sf).withColumn("until", F.expr("coalesce(end_at, start_at)"))
    own = a.select(F.expr("concat('https://c.example.com/', id, '.html')").alias("link"), "title", F.col("start_at").alias("start"), F.col("until").alias("end"), F.col("district").alias("address"))
    told = a.where("id % 3 = 0").select(F.expr("concat('https://c.example.com/', id, '-review.html')"), F.lit("Recap"), F.expr("if(id % 9 = 0, start_at + interval 1 hour, start_at)"), F.expr("if(id % 6 = 0, until + interval 1 hour, until)"), F.lower("district"))
    return R.recaps(own.union(told))


@query(f"with {_W} select id, title, strftime(day, '%Y-%m-%d') as start, case when id % 2 = 0 then strftime(last, '%Y-%m-%d') else '' end as stop, district as place from w")
def microdata(spark, sf):
    """Item properties, from attributes or texts."""
    html = F.expr("""concat('<h1 itemprop="name">', title, '</h1><time itemprop="startDate" datetime="', day, '">soon</time>', if(id % 2 = 0, concat('<meta itemprop="endDate" content="', last, '">'), ''), '<p itemprop="location"><b>', district, '</b></p>')""")
    return S.microdata_fields(_written(spark, sf).select(F.col("id").alias("page_id"), html.alias("html"))).select(F.col("page_id").alias("id"), "title", "start", F.col("end").alias("stop"), "place")


@query(f"with {_W}, l as (select id // 20 as page_id, id, 'https://d.example.com/' || (id - id % 2) as link, year(day) * 12 + month(day) - 2023 * 12 - 6 as ahead, row_number() over (partition by id // 20 order by id) - 1 as pos from w) select page_id, link, min(pos) as pos from l where ahead between -1 and 6 group by page_id, link")
def month_links(spark, sf):
    """Links to the pages of months near now."""
    piece = """concat('<a href="https://d.example.com/', id - id % 2, '">', date_format(day, 'yyyy年M月'), '展会</a>')"""
    return R.month_links(_pages(_written(spark, sf), "id div 20", piece), F.lit("2023-06-15").cast("date"))


@query(f"with {_A} select id, concat_ws(',', 'https://img.example.com/' || id || '.jpg', 'https://img.example.com/b' || (id % 5) || '.png') as images from activity")
def page_images(spark, sf):
    """Pictures of an activity, without codes, logos, repeats and hosts that are not public."""
    html = F.expr("""concat('<meta property="og:image" content="https://img.example.com/', id, '.jpg"><img alt="QR code" src="https://img.example.com/q.png"><img src="http://localhost/x.png"><img src="http://10.0.0.1/y.png">',
    '<img data-src="https://img.example.com/b', id % 5, '.png" src="x.gif"><img src="https://img.example.com/', id, '.jpg"><img src="https://me@img.example.com/z.png">')""")
    return V.activity(spark, sf).select("id", F.array_join(R.images(html), ",").alias("images"))


# --- merging, identity and results of others -----------------------------------------------------------------


def _listing(spark, sf) -> DataFrame:
    return V.activity(spark, sf).selectExpr("id", "if(id % 2 = 0, '', organizer) as organizer", "element_at(array('未知', null, '30元'), cast(id % 3 as int) + 1) as fee", "if(id % 5 = 0, null, start_at) as start", "if(id % 4 = 0 or id % 5 = 0, null, end_at) as end", "all_day", "id % 7 = 0 as hold")


def _details(spark, sf) -> DataFrame:
    return V.activity(spark, sf).where("id % 6 <> 0").selectExpr("id", "if(id % 10 = 0, null, organizer) as organizer", "if(id % 8 = 0, '未注明', '免费') as fee", "if(id % 9 = 0, start_at + interval 1 day, start_at) as start", "end_at as end", "id % 3 <> 0 as all_day")


@query(f"""with {_A}, m as (select id, case when id % 2 = 1 or id % 6 <> 0 and id % 10 <> 0 then organizer else '' end as organizer, case when id % 3 = 2 then '30元' when id % 6 <> 0 and id % 8 <> 0 then '免费' when id % 3 = 0 then '未知' end as fee,
  id % 5 = 0 and id % 6 <> 0 and id % 7 <> 0 as whole, id % 5 <> 0 and id % 4 = 0 and id % 6 <> 0 and id % 7 <> 0 and id % 9 <> 0 and all_day = (id % 3 <> 0) and end_at is not null as completes, start_at, end_at, all_day from activity)
select id, organizer, fee, strftime(case when whole and id % 9 = 0 then start_at + interval 1 day when whole or id % 5 <> 0 then start_at end, '%Y-%m-%d') as start, strftime(case when whole or completes or id % 4 <> 0 and id % 5 <> 0 then end_at end, '%Y-%m-%d') as stop, case when whole then id % 3 <> 0 else all_day end as all_day,
concat_ws(',', case when id % 2 = 0 and id % 6 <> 0 and id % 10 <> 0 then 'organizer' end, case when id % 3 <> 2 and id % 6 <> 0 and id % 8 <> 0 then 'fee' end, case when whole then 'start' end, case when whole and end_at is not null or completes then 'end' end, case when whole then 'all_day' end) as filled from m""")
def detail_merge(spark, sf):
    """Details fill what a listing doesn't know, a schedule only as a whole."""
    out = M.fill_details(_listing(spark, sf), _details(spark, sf))
    return out.select("id", "organizer", "fee", _iso("start", "start"), _iso("end", "stop"), "all_day", "filled")


@query(f"""with {_A}, b as (select id, start_at as a, case when id % 3 = 0 then start_at + interval 1 day else end_at end as e, all_day, status, case when id % 5 <> 0 then case when id % 4 = 0 then start_at + interval 2 days else start_at + interval 9 hours end end as da,
  case when id % 5 <> 0 then start_at + interval 3 days end as de from activity), c as (select *, da is not null and cast(a as date) = cast(da as date) as same, coalesce(e = a + interval 1 day, false) as single from b)
select id, strftime(case when same and single and all_day then da else a end, '%Y-%m-%d %H:%M') as start, strftime(case when same and single and all_day then de else e end, '%Y-%m-%d %H:%M') as stop,
case when status = 'cancelled' then status when da is not null and not (same and single and all_day) and (not same or all_day or a <> da or e is distinct from de) then 'needs_review' else status end as status from c""")
def detail_refine(spark, sf):
    """A listing of one whole day takes the details' clock; other differences go to review; cancelled stays so."""
    a = V.activity(spark, sf)
    listing = a.selectExpr("id", "start_at as start", "if(id % 3 = 0, start_at + interval 1 day, end_at) as end", "all_day", "status")
    details = a.where("id % 5 <> 0").selectExpr("id", "if(id % 4 = 0, start_at + interval 2 days, start_at + interval 9 hours) as start", "start_at + interval 3 days as end", "'scheduled' as status")
    return M.refine_listing(listing, details).select("id", *(F.date_format(c, "yyyy-MM-dd HH:mm").alias(n) for c, n in (("start", "start"), ("end", "stop"))), "status")


@query(f"""with {_A}, p as (select id, case when id % 2 = 0 then district else '' end as place, case when id % 3 = 0 then '未注明' else '5元' end as fee, id % 7 = 0 as hold, event_type_state = 'pending' and id % 4 = 0 as shown, event_type, district, {_FEE_SQL} as told from activity)
select id, case when place = '' then district else place end as place, case when id % 3 = 0 then told else fee end as fee, case when shown then 'MusicEvent' else event_type end as kind,
concat_ws(',', case when place = '' then 'place' end, case when id % 3 = 0 then 'fee' end, case when shown then 'kind' end) as changed from p where not hold and (place = '' or id % 3 = 0 or shown)""")
def event_patches(spark, sf):
    """Gaps of place, fee and kind filled from the kept text."""
    rows = V.activity(spark, sf).selectExpr("id", "if(id % 4 = 0, concat(title, ' 音乐会'), title) as title", f"concat('地点：', district, ' 费用：', {_FEE}) as summary", "if(id % 2 = 0, district, '') as place", "if(id % 3 = 0, '未注明', '5元') as fee", "event_type as kind", "event_type_state = 'pending' as pending", "id % 7 = 0 as hold")
    return M.patched(rows)


@query("""with n as (select c_custkey as row_id, c_nationkey as source_id, 'u' || (c_custkey % 400) as url from customer), l as (select s_nationkey as source_id, 'u' || (s_suppkey % 400) as url, min(s_suppkey) as e from supplier group by all),
a as (select 'u' || (p_partkey % 333) as url, min(p_partkey) as e from part where p_partkey % 3 = 0 group by all), d as (select o_custkey as row_id, min(o_orderkey) as e from orders where o_orderkey % 5 = 0 group by all)
select row_id, coalesce(cast(l.e as varchar), cast(a.e as varchar), cast(d.e as varchar), substr(sha256(n.source_id || '|' || n.url), 1, 20)) as event_id, case when l.e is not null then 'link' when a.e is not null then 'alias' when d.e is not null then 'duplicate' else 'new' end as by
from n left join l using (source_id, url) left join a on a.url = n.url left join d using (row_id)""")
def assign_events(spark, sf):
    """A row's activity by its link, an alias, the smallest duplicate, or a new id."""
    table = lambda name, *columns: V.table(spark, sf, name).selectExpr(*columns)
    new = table("customer", "c_custkey as row_id", "c_nationkey as source_id", "concat('u', c_custkey % 400) as url")
    links = table("supplier", "s_nationkey as source_id", "concat('u', s_suppkey % 400) as url", "s_suppkey as event_id")
    aliases = V.table(spark, sf, "part").where("p_partkey % 3 = 0").selectExpr("concat('u', p_partkey % 333) as url", "p_partkey as event_id")
    copies = V.table(spark, sf, "orders").where("o_orderkey % 5 = 0").selectExpr("o_custkey as row_id", "o_orderkey as event_id")
    return M.assigned(new, links, aliases, copies)


@query(f"""with {_A}, r as (select *, id % 50 < 25 as done, id % 40 as r_rank from activity where id % 3 <> 0)
select id, case when id % 4 = 0 then '其他' else 'BUILDING' end as topic, case when event_type_state = 'source' then event_type when id % 2 = 0 then '2-HIGH' else 'Event' end as kind, case when event_type_state = 'source' then 'source' else 'model' end as kind_state,
case when commercial = 'high' or id % 5 = 0 then 'normal' else priority end as priority, coalesce(commercial, 'unknown') as commercial, case when id % 10 = 1 then 'not_event' else status end as status from r where not (r_rank > origin_priority and done)""")
def apply_classification(spark, sf):
    """M9: results of a model for the very text, within the vocabularies and below the sources."""
    a = V.activity(spark, sf)
    rows = a.selectExpr("id", "sha2(title, 256) as digest", "event_type as kind", "event_type_state as kind_state", "status", "origin_priority as rank", "id % 50 < 25 as done")
    results = a.selectExpr("id", "sha2(if(id % 3 = 0, 'old', title), 256) as digest", "if(id % 4 = 0, array('x'), array('BUILDING', 'x')) as topics", "if(id % 2 = 0, '2-HIGH', 'x') as kind", "if(id % 5 = 0, 'x', priority) as priority", "commercial", "id % 10 <> 1 as local", "id % 40 as rank")
    return M.classified(rows, results, V.TOPICS, V.EVENT_TYPES).withColumn("topic", F.array_min("topics")).drop("topics")


_PLACES = ["c_custkey % 4 = 0", "c_custkey % 3 <> 0", "c_custkey % 5 <> 0", "true"]
_DISTRICT_OF = ["c_custkey % 11", "(c_custkey + c_custkey % 2) % 11", "c_custkey % 11", "(c_custkey + 1) % 11"]


@query(f"""with p as ({' union all '.join(f"select 'Hall number ' || c_custkey as query, {s} as score, {n} as name, {list(DISTRICTS)}[{d} + 1] as district from customer where {w}" for s, n, w, d in zip((100, 92, 85, 0), ("'Hall number ' || c_custkey", "'Hall number ' || c_custkey || ' annex'", "'zz'", "'zzz'"), _PLACES, _DISTRICT_OF, strict=True))}),
r as (select *, row_number() over k as i, lead(score) over k as s2, lead(district) over k as d2, count(*) over (partition by query) as n, count(*) over (partition by query, district) as m from p window k as (partition by query order by score desc, name))
select query, district, name, cast(score as double) as score from r where i = 1 and (score >= 58 or n > 1 and n = m) and not coalesce(s2 >= score - 3 and d2 <> district, false)""")
def locate_places(spark, sf):
    """The district of a place, from ranked answers."""
    customers = V.table(spark, sf, "customer").selectExpr("*", "concat('Hall number ', c_custkey) as query")
    names = ["query", "concat(query, ' annex')", "'zz'", "'zzz'"]
    parts = [customers.where(w).selectExpr("query", f"{n} as name", f"{'concat(\"near \", query)' if i == 2 else '\"\"'} as address", f"element_at(array({', '.join(map(repr, DISTRICTS))}), cast({d} as int) + 1) as district") for i, (n, w, d) in enumerate(zip(names, _PLACES, _DISTRICT_OF, strict=True))]
    places = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return M.located(customers, places)


_GEO_SQL = """g as (select c_custkey as id, case when c_custkey % 6 = 0 then '南山' else '待确认' end as district, 'P' || (c_custkey % 50) as place, 'P' || (case when c_custkey % 10 = 0 then (c_custkey + 1) % 50 else c_custkey % 50 end) as asked from customer),
cache as (select 'P' || (s_suppkey % 60) as query, max(date '2024-01-01' + cast(s_suppkey % 90 as integer)) as checked, arg_max(case when s_suppkey % 3 = 0 then '' else '福田' end, s_suppkey % 90) as answer from supplier where s_suppkey < 61 group by 1),
o as (select g.*, answer, case when district <> '待确认' then 'kept' when answer is null then 'missing' when date '2024-02-20' - checked >= 30 then 'stale' when place <> asked then 'changed' when answer = '' then 'not_found' else 'resolved' end as outcome from g left join cache on asked = query)"""


def _geocoded(spark, sf) -> DataFrame:
    rows = V.table(spark, sf, "customer").selectExpr("c_custkey as id", "if(c_custkey % 6 = 0, '南山', '待确认') as district", "concat('P', c_custkey % 50) as place", "concat('P', if(c_custkey % 10 = 0, (c_custkey + 1) % 50, c_custkey % 50)) as asked")
    cache = V.table(spark, sf, "supplier").where("s_suppkey < 61").selectExpr("concat('P', s_suppkey % 60) as query", "if(s_suppkey % 3 = 0, '', '福田') as district", "date_add(date '2024-01-01', cast(s_suppkey % 90 as int)) as checked_at")
    return M.with_districts(rows, cache, F.lit("2024-02-20").cast("date"))


@query(f"with {_GEO_SQL} select id, case when outcome = 'resolved' then answer else district end as district, outcome from o")
def geocode_apply(spark, sf):
    """Fresh answers for places that haven't changed, where the district is still unknown."""
    return _geocoded(spark, sf)


@query(f"with {_GEO_SQL} select outcome, count(*) as n from o group by 1")
def geocode_summary(spark, sf):
    """A13"""
    return _geocoded(spark, sf).groupBy("outcome").agg(F.count("*").alias("n"))


@query("""with l as (select l_suppkey % 20 as source_id, l_orderkey % 500 as alias, count(distinct l_linenumber % 2) as n from lineitem where l_orderkey % 3 <> 0 group by all), c as (select event_id as observation_id, user_id % 20 as source_id, event_id % 500 as alias, event_type = 'view' as seen from events)
select source_id, count(*) filter (not seen) as new, count(*) filter (seen) as replayed, count(*) filter (n is null) as unlinked, count(*) filter (n > 1) as ambiguous from c left join l using (source_id, alias) group by 1""")
def capture_receipts(spark, sf):
    """What a capture brought: new, seen before, without an activity, with several."""
    seen = V.table(spark, sf, "events").selectExpr("event_id as observation_id", "user_id % 20 as source_id", "event_id % 500 as alias", "event_type = 'view' as seen")
    links = V.table(spark, sf, "lineitem").where("l_orderkey % 3 <> 0").selectExpr("l_suppkey % 20 as source_id", "l_orderkey % 500 as alias", "l_linenumber % 2 as event_id")
    return M.receipts(seen.drop("seen"), seen.where("seen"), links)


@query(f"""with {_GUARDS_SQL}, g as (select source_id, event_id, reason, any_value(digest order by generation desc) as digest, any_value(active order by generation desc) as active from guards group by 1, 2, 3), q as (select *, event_id % 50 as resolution_id, event_id % 7 <> 0 as right from g where (source_id + event_id) % 4 = 0)
select resolution_id, case when bool_and(q.right and active) then 'applied' when bool_and(q.right and not active) then 'already' else 'conflict' end as outcome from q group by 1""")
def resolve_guards(spark, sf):
    """Resolutions whose every guard is as they expect."""
    folded = E.guard_fold(V.observations(spark, sf))
    guards = folded.groupBy("source_id", "event_id", "reason").agg(F.max_by("digest", "generation").alias("digest"), F.max_by("active", "generation").alias("active"))
    requests = guards.where("(source_id + event_id) % 4 = 0").selectExpr("event_id % 50 as resolution_id", "source_id", "event_id", "reason", "if(event_id % 7 <> 0, digest, 'x') as digest")
    return M.resolutions(requests, guards)


@query("""with b as (select distinct s_nationkey as source_id, unnest(case when p_partkey % 3 = 0 then ['f' || p_partkey % 300] else ['r' || p_partkey % 300, 'f' || p_partkey % 300] end) as alias, 'f' || p_partkey % 300 as canonical, 'proof ' || p_partkey % 7 as proof from part join supplier on p_partkey % 100 = s_suppkey % 100)
select sha256(source_id || alias || proof) as binding_id, source_id, alias, canonical, proof from b where source_id % 5 <> 0""")
def append_bindings(spark, sf):
    """Evidence for the address asked for and the final one, if it isn't there yet."""
    asked = V.table(spark, sf, "part").selectExpr("p_partkey % 100 as k", "concat(if(p_partkey % 3 = 0, 'f', 'r'), p_partkey % 300) as requested", "concat('f', p_partkey % 300) as final", "concat('proof ', p_partkey % 7) as proof").distinct()
    rows = asked.join(V.table(spark, sf, "supplier").selectExpr("s_suppkey % 100 as k", "s_nationkey as source_id").distinct(), "k").drop("k")
    none = rows.limit(0).selectExpr("'' as binding_id")
    known = M.bindings(rows.where("source_id % 5 = 0"), none)
    return M.bindings(rows, known)


@query(f"""with {_A}, {_P} select id, 'BEGIN:VEVENT' || chr(13) || chr(10) || 'UID:' || id || '@fairground' || chr(13) || chr(10) || 'DTSTART' || case when all_day then strftime(start_at, ';VALUE=DATE:%Y%m%d') else strftime(start_at, ';TZID=Asia/Shanghai:%Y%m%dT%H%M%S') end || chr(13) || chr(10)
|| case when all_day then strftime(greatest(coalesce(cast(end_at as date), cast(start_at as date) + 1), cast(start_at as date) + 1), 'DTEND;VALUE=DATE:%Y%m%d') || chr(13) || chr(10) when end_at > start_at then strftime(end_at, 'DTEND;TZID=Asia/Shanghai:%Y%m%dT%H%M%S') || chr(13) || chr(10) else '' end
|| 'SUMMARY:' || title || '\\, of ' || district || '\\; free' || chr(13) || chr(10) || 'END:VEVENT' as vevent from activity where status = 'scheduled' and id in (select event_id from preferences where favorite)""")
def calendar_entries(spark, sf):
    """K2: saved activities as calendar entries, timed and of whole days, escaped."""
    rows = L.only_favorites(V.activity(spark, sf), V.preferences(spark, sf)).where("status = 'scheduled'")
    return rows.withColumn("title", F.concat("title", F.lit(", of "), "district", F.lit("; free"))).select("id", M.calendar_entry())


@query(f"""with {_A} select id, title, 'https://e.example.com/' || id as url, strftime(case when id % 5 <> 0 then start_at end, '%Y-%m-%d') as start, strftime(case when id % 7 <> 0 then end_at end, '%Y-%m-%d') as stop, case id % 3 when 0 then '南山 hall' when 1 then '南山、福田' else district end as place,
case when id % 3 = 0 then '南山' else '待确认' end as district, case when id % 2 = 0 then '费用未注明' else '免费' end as fee, id % 2 = 1 as fee_free, case when id % 4 = 0 then 'Event' else event_type end as kind, case when id % 4 = 0 then 'pending' else 'source' end as kind_state,
case when id % 5 = 0 then 'needs_review' when id % 6 = 0 then 'scheduled' else status end as status from activity where id % 13 <> 0 and id % 11 <> 0""")
def normalize_events(spark, sf):
    """Rows as they come, within bounds and vocabularies."""
    rows = V.activity(spark, sf).selectExpr(
        "id", "if(id % 13 = 0, '  ', concat(' ', title, '\n')) as title", "if(id % 11 = 0, 'ftp://x', concat('https://e.example.com/', id, '#a')) as url", "if(id % 5 = 0, null, start_at) as start",
        "if(id % 7 = 0, if(id % 5 = 0, null, start_at - interval 1 day), end_at) as end", "element_at(array('南山  hall', '南山、福田', district), cast(id % 3 as int) + 1) as place", "if(id % 2 = 0, null, '免费') as fee", "if(id % 4 = 0, 'nonsense', event_type) as kind", "if(id % 6 = 0, null, status) as status",
    )
    return M.normalized(rows, V.EVENT_TYPES).select("id", "title", "url", _iso("start", "start"), _iso("end", "stop"), "place", "district", "fee", "fee_free", "kind", "kind_state", "status")


@query(f"""with {_A} select id // 3 as canonical, case when bool_or(status = 'cancelled') then 'cancelled' when count(distinct start_at) > 1 or bool_or(id % 9 = 0) or bool_or(status = 'needs_review') then 'needs_review' else 'scheduled' end as status, count(*) as n,
array_to_string(list_sort(list(distinct 'b' || (id % 5))), ',') as bindings from activity group by 1""")
def alias_items(spark, sf):
    """Items that lead to one address."""
    rows = V.activity(spark, sf).selectExpr("id div 3 as canonical", "start_at as start", "status", "id % 9 = 0 as conflict", "concat('b', id % 5) as binding")
    return M.same_canonical(rows).withColumn("bindings", F.array_join("bindings", ","))


@query("""with f as (select l_orderkey as raw_id, max_by('n' || l_linenumber, (l_shipdate, 'n' || l_linenumber)) as new_url from lineitem where l_returnflag = 'R' group by 1)
select o_orderkey as id, coalesce(new_url, 'u' || o_orderkey) as url, new_url is not null as refreshed from orders left join f on raw_id = o_orderkey""")
def rotated_urls(spark, sf):
    """The newest address under which an item was found again."""
    rows = V.table(spark, sf, "orders").selectExpr("o_orderkey as id", "o_orderkey as raw_id", "concat('u', o_orderkey) as url")
    return M.rotated(rows, V.table(spark, sf, "lineitem").where("l_returnflag = 'R'").selectExpr("l_orderkey as raw_id", "concat('n', l_linenumber) as new_url", "l_shipdate as seen_at"))


@query(f"with {_A}, {_P} select id, title, strftime(start_at, '%Y-%m-%d') as start, feedback, strftime(feedback_updated_at, '%Y-%m-%d %H:%M:%S') as updated, favorite, revision from activity join preferences on event_id = id where feedback is not null")
def feedback_export(spark, sf):
    """K3: all feedback with its activity, hidden ones too."""
    rows = V.activity(spark, sf).join(V.preferences(spark, sf).withColumnRenamed("event_id", "id"), "id").where("feedback is not null")
    return rows.select("id", "title", _iso("start_at", "start"), "feedback", F.date_format("feedback_updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated"), "favorite", "revision")


@query(f"with {_A} select id, ['深圳', district, '外市', '深圳', '外市', '待确认'][id % 6 + 1] as city from activity")
def city_evidence(spark, sf):
    """The city by what is stated, the place, and the scope of the source."""
    pick = lambda *values: F.expr(f"element_at(array({', '.join(values)}), cast(id % 6 as int) + 1)")
    stated = pick("district", "district", "'未知'", "null", "''", "'待确认'")
    place = pick("'Shen Zhen hall'", "'hall'", "'Kowloon'", "'hall'", "'成都市 hall'", "'hall'")
    return V.activity(spark, sf).select("id", G.city_of(stated, place, pick("''", "'深圳'", "'深圳'", "'深圳'", "'深圳'", "null")).alias("city"))


@query(f"""with {_A}, b as (select e.event_id as observation_id, a.id as event_id, case when e.value < 10 then null else e.event_id % 4 end as day, a.id % 4 as anchor from events e join activity a on e.user_id % 20 = a.id % 20 and e.event_id % 900 = a.id where not (e.event_id % 6 = 0))
select observation_id, event_id, case when day is null then 'refused' when day = anchor then 'applicable' else 'not_applicable' end as result from b""")
def late_anchors(spark, sf):
    """Retained observations decided when their anchor arrives, those decided before left out."""
    observations = V.table(spark, sf, "events").selectExpr("event_id as observation_id", "user_id % 20 as source_id", "event_id % 900 as alias", "if(value < 10, null, event_id % 4) as day")
    anchors = V.activity(spark, sf).selectExpr("id % 20 as source_id", "id as alias", "id as event_id", "id % 4 as day")
    done = observations.where("observation_id % 6 = 0").selectExpr("observation_id", "alias as event_id")
    return M.adjudicated(anchors, observations, done)


@query(f"""with {_W}, h as (select id // 4 as item, id % 7 = 0 and id % 3 <> 0 as o, id % 5 = 0 and id % 3 <> 0 and day <> last and id % 2 = 0 as d from w)
select item, not bool_or(o or d) as admitted, concat_ws(',', case when bool_or(d) then 'day' end, case when bool_or(o) then 'organizer' end) as reasons from h group by item""")
def history_conflicts(spark, sf):
    """Evidence against every stored binding of an item; a changed day needs a notice from the old to the new one."""
    rows = _written(spark, sf)
    new = rows.selectExpr("id div 4 as item", "id as alias", "organizer", "if(id % 5 = 0, last, day) as day", "if(id % 2 = 1, day, null) as old_day", "last as new_day")
    stored = rows.where("id % 3 <> 0").selectExpr("id div 4 as item", "id as alias", "if(id % 7 = 0, 'other', organizer) as organizer", "day")
    return M.histories(new, stored)

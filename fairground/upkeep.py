"""Registered queries of guards over time, identity, patches and inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairground.functions import grammar as W
from fairground.functions import text as X
from fairground.operators import evidence as E
from fairground.operators import guards as G
from fairground.operators import identity as I
from fairground.operators import patches as P
from fairground.plans import views as V
from fairground.queries import _A, query
from fairground.sources import elements as S
from fairground.sources import pages as D

# --- guards --------------------------------------------------------------------------------------------------


def ledger(spark, sf) -> DataFrame:
    """Notices about occurrences of activities under an alias, some of them repeated cancellations, some reinstatements."""
    rows = V.table(spark, sf, "events").where("event_type in ('error', 'purchase')")
    return rows.select(
        F.col("event_id").alias("observation_id"),
        (F.col("user_id") % 20).alias("source_id"),
        (F.col("event_id") % 60).alias("event_id"),
        F.expr("concat('a', user_id div 20 % 2)").alias("alias"),
        F.expr("case when floor(value) % 3 < 2 then concat('d', floor(value) % 3) end").alias("occurrence"),
        (F.col("event_id") % 13 == 0).alias("again"),
        "ts",
        (F.col("event_type") == "purchase").alias("resolves"),
    )


_LEDGER = f"""o as (select event_id as observation_id, user_id % 20 as source_id, event_id % 60 as event_id, 'a' || (user_id // 20 % 2) as alias,
  case when cast(floor(value) as bigint) % 3 < 2 then 'd' || (cast(floor(value) as bigint) % 3) else '' end as occurrence, event_id % 13 = 0 as again, event_type = 'purchase' as resolves,
  row_number() over (order by ts, event_id) as k from events where event_type in ('error', 'purchase')),
f as (select *, min(k) filter (not resolves) over w as first_k, count(*) filter (resolves) over (w order by k) as generation, count(*) filter (resolves) over w as resolutions from o window w as (partition by source_id, event_id, alias, occurrence)),
t as (select source_id, event_id, alias, min(k) as turned from f where resolves and k > first_k group by all),
n as (select f.*, case when k > turned then '{G.LATER_REASON}' else '{G.FIRST_REASON}' end as reason, case when again then observation_id end as own from f left join t using (source_id, event_id, alias) where not resolves),
g as (select source_id, event_id, alias, occurrence, reason, generation, own, resolutions, count(*) as notices, arg_min(observation_id, k) as first_id,
  cast(sum(cast(('0x' || substr(sha256(cast(observation_id as varchar)), 1, 12)) as bigint)) as varchar) as digest from n group by all),
life as (select substr(sha256(concat_ws('|', source_id, event_id, alias, occurrence, first_id)), 1, 20) as guard_id, source_id, event_id, alias, occurrence, reason, notices,
  notices + cast(generation < resolutions as bigint) as revision, digest, case when generation = resolutions then 'active' else 'resolved' end as state, generation, own from g)"""


@query(f"with {_LEDGER} select guard_id, source_id, event_id, alias, occurrence, reason, notices, revision, digest, state from life")
def guard_life(spark, sf):
    """Guards of source, activity, alias, occurrence and reason, through all their generations."""
    return G.guard_life(ledger(spark, sf))


@query(f"with {_LEDGER} select guard_id, observation_id from n join life l on l.source_id = n.source_id and l.event_id = n.event_id and l.alias = n.alias and l.occurrence = n.occurrence and l.reason = n.reason and l.generation = n.generation and l.own is not distinct from n.own")
def guard_members(spark, sf):
    """Which guard each notice is of."""
    return G.guard_members(ledger(spark, sf))


_ASKED = "case when event_id % 4 = 0 then revision - cast(state = 'resolved' as bigint) when event_id % 4 = 1 then revision + 1 else revision end"


@query(f"""with {_LEDGER}, r as (select source_id || ':' || event_id as resolution_id, *, {_ASKED} as asked, event_id % 4 = 3 and alias = 'a1' as other from life where event_id < 40)
select resolution_id, case when bool_and(state = 'active' and asked = revision and not other) then 'applied' when bool_and(state = 'resolved' and asked + 1 = revision and not other) then 'already' else 'conflict' end as outcome, count(*) as guards from r group by 1""")
def guards_resolved(spark, sf):
    """Requests that name guards with the revision and digest they expect; all or nothing."""
    life = G.guard_life(ledger(spark, sf))
    wanted = life.where("event_id < 40").select(
        F.concat_ws(":", "source_id", "event_id").alias("resolution_id"), "guard_id", *G.OCCURRENCE, F.expr(_ASKED).alias("revision"), F.expr("if(event_id % 4 = 3 and alias = 'a1', '0', digest)").alias("digest")
    )
    return G.resolved_as_expected(wanted, life)


@query(f"""with {_LEDGER}, r as (select *, case when event_id % 5 = 0 then 'too short' else 'reviewed by hand, another day' end as review_reason, guard_id as resolution_id from life where event_id % 2 = 0 and occurrence <> ''),
a as (select *, alias <> 'a1' as good_anchor, event_id % 3 <> 0 as scope from r)
select resolution_id, case when failures = '' then 'applied' else 'refused' end as outcome, failures from (select resolution_id,
  concat_ws(',', case when not good_anchor then 'anchor' end, case when event_id % 5 = 0 then 'reason' end, case when not scope then 'scope' end, case when state <> 'active' then 'snapshot' end) as failures from a)""")
def reviewed_disassociation(spark, sf):
    """reviewers' decisions over the exact notices of a guard, by an anchor of another occurrence."""
    life, members = G.guards_and_members(ledger(spark, sf))
    named = life.where("event_id % 2 = 0 and occurrence <> ''")
    seen = members.where("observation_id is not null").groupBy("guard_id").agg(F.collect_set("observation_id").alias("observations"))
    shown = named.join(seen, "guard_id").select(F.col("guard_id").alias("resolution_id"), "guard_id", *G.OCCURRENCE, "revision", "digest", F.expr("if(event_id % 3 = 0, array_append(observations, -1L), observations)").alias("observations"))
    asked = named.select(F.col("guard_id").alias("resolution_id"), F.lit("reviewer").alias("actor"), F.expr("if(event_id % 5 = 0, 'too short', 'reviewed by hand, another day')").alias("review_reason"), F.concat_ws(":", "source_id", "alias").alias("binding_id"))
    pairs = named.select("source_id", "alias").distinct()
    anchors = pairs.select(F.concat_ws(":", "source_id", "alias").alias("binding_id"), "source_id", F.lit(-1).cast("long").alias("event_id"), F.expr("if(alias = 'a1', 'elsewhere', alias)").alias("alias"), F.lit("another day").alias("occurrence"))
    return G.disassociated(asked, shown, life, members, anchors)


@query("""with i as (select o_orderkey as item, o_orderkey % 9 as source_id, 'https://a.example.com/' || o_orderkey as url, o_orderkey % 700 as event_id, 'Café ' || o_orderkey as title, cast(o_orderdate as date) as day from orders),
b as (select item, unnest(case when item % 10 = 0 then [null] when item % 3 = 0 then ['r' || item, 'f' || item] else ['r' || item] end) as binding_id, * exclude (item) from i)
select item, binding_id, concat_ws(',', case when binding_id is null or (item % 7 = 0 and binding_id like 'f%') then 'binding' end, case when binding_id is null or item % 11 = 0 then 'evidence' end,
  case when binding_id is null or item % 13 = 0 then 'occurrence' end, case when item % 17 = 0 then 'link' end, case when binding_id is not null and item % 19 = 0 then 'retarget' end) as failures from b""")
def anchor_checks(spark, sf):
    """An item's bindings must be of its source, address, title, day and link, and never move."""
    items = V.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("item"), (F.col("o_orderkey") % 9).alias("source_id"), F.expr("concat('https://a.example.com/', o_orderkey)").alias("url"), F.expr("concat('Café  ', o_orderkey)").alias("title"),
        F.to_date("o_orderdate").alias("day"), (F.col("o_orderkey") % 700).alias("event_id"), F.col("o_orderkey").alias("raw_id"),
        F.expr("case when o_orderkey % 10 = 0 then array() when o_orderkey % 3 = 0 then array(concat('r', o_orderkey), concat('f', o_orderkey)) else array(concat('r', o_orderkey)) end").cast("array<string>").alias("binding_ids"),
    )
    each = items.select("*", F.explode("binding_ids").alias("binding_id"))
    bindings = each.select(
        "binding_id", F.expr("if(item % 7 = 0 and binding_id like 'f%', source_id + 1, source_id)").alias("source_id"), F.col("url").alias("canonical"), F.expr("concat('Café ', item, if(item % 11 = 0, ' again', ''))").alias("title"),
        F.lit("digest").alias("body_digest"), F.array(F.expr("if(item % 13 = 0, day + 1, day)").cast("string")).alias("days"), F.expr("if(item % 19 = 0, event_id + 1, null)").alias("event_id"),
    )
    links = items.where("item % 17 <> 0").select("source_id", "url", "event_id", "raw_id")
    anchors = each.where("item % 5 = 0").select("binding_id", "event_id", "raw_id", F.array(F.col("day").cast("string")).alias("days"))
    return G.anchor_checks(items, bindings, links, anchors)


# --- pages ---------------------------------------------------------------------------------------------------


@query(r"select page_id, tag, count(*) as n from (select page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) as tag from pages) group by 1, 2")
def page_elements(spark, sf):
    """The element table of the captured pages: how many elements of each tag."""
    return S.element_rows(V.table(spark, sf, "pages").select("page_id", "html")).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query(r"""with a as (select page_id, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) as body from pages),
t as (select page_id, unnest(regexp_extract_all(body, '<([a-z][a-z0-9]*)', 1)) as tag from a) select page_id, count(*) as n, count(*) filter (tag = 'p') as paragraphs from t group by 1""")
def article_elements(spark, sf):
    """Elements that stand in a page's article, by containment of intervals."""
    rows = S.element_rows(V.table(spark, sf, "pages").select("page_id", "html"))
    article = rows.where("tag = 'article'").select("page_id", F.col("pre").alias("a_pre"), F.col("last").alias("a_last"))
    inside = rows.join(article, "page_id").where((F.col("pre") > F.col("a_pre")) & (F.col("pre") <= F.col("a_last")))
    return inside.groupBy("page_id").agg(F.count("*").alias("n"), F.count_if(F.col("tag") == "p").alias("paragraphs"))


_DAY = "cast(start_at + interval 28 years as date)"


@query(f"""with {_A}, c as (select id, id // 12 as page_id, case when id % 3 = 0 then 'timed' when id % 3 = 1 then 'webinars' else 'regions' end as kind0, ['timed', 'webinars', 'regions'][id // 12 % 3 + 1] as kind, case when id % 13 = 0 then '' else title || ' & more' end as title,
  'https://a.example.com/e/' || (id - cast(id % 5 = 0 as integer)) as link, case when id % 7 <> 0 then {_DAY} end as day, district from activity),
r as (select *, case when title = '' then 'title' when kind <> 'timed' and id % 11 = 0 then 'ended' end as bad from c),
n as (select *, row_number() over (partition by page_id, link order by bad is not null, day is null, id) as nth from r)
select page_id, row_number() over (partition by page_id order by id) - 1 as pos, kind, title, link, strftime(day, '%Y-%m-%d') as start, strftime(day + 1, '%Y-%m-%d') as stop, case kind when 'webinars' then '线上' else district end as place, coalesce(bad, case when nth > 1 then 'repeated' end) as reject from n""")
def site_cards(spark, sf):
    """Cards of three kinds of nested layouts, the dated card of an address before the undated."""
    title = "if(id % 13 = 0, '', concat('<b>', title, '</b> &amp; more'))"
    link = "concat('/e/', id - if(id % 5 = 0, 1, 0), '?utm_source=x')"
    day = "if(id % 7 = 0, '', {})"
    iso, written = day.format("date_format(add_months(to_date(start_at), 336), 'yyyy-MM-dd')"), day.format("date_format(add_months(to_date(start_at), 336), 'yyyy年M月d日')")
    label = "if(id % 11 = 0, '精彩回放', '报名中')"
    piece = f"""element_at(array(
      concat('<article><div><div class="x">y</div><h3><i></i><a target=_blank href="', {link}, '">', {title}, '</a></h3></div><p>about</p><time datetime="', {iso}, '">t</time><div><p>', district, '</p></div></article>'),
      concat('<li class="big bd-wrap"><div><div>z</div></div><div class="activity-info"><h3><a href="', {link}, '">', {title}, '</a></h3><p><em>x</em><span>', {written}, '</span></p></div><b class="status">', {label}, '</b></li>'),
      concat('<div class="event-item"><div class="card"><div class="card-meta"><a class="tag" href="#">t</a><a href="', {link}, '" class="initial">', {title}, '</a></div></div><div class="card-times">', {written}, '</div><div class="card-map">', district, '</div><i class="status">', {label}, '</i></div>')), cast(id div 12 % 3 as int) + 1)"""
    pieces = V.activity(spark, sf).groupBy(F.expr("id div 12").alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", F.expr(piece).alias("p")))), lambda x: x["p"]), "").alias("body"))
    pages = pieces.select("page_id", F.expr("element_at(array('timed', 'webinars', 'regions'), cast(page_id % 3 as int) + 1)").alias("kind"), F.lit("https://a.example.com/list/").alias("url"), F.concat(F.lit('<main><div class="regular-events-list"><ul>'), "body", F.lit("</ul></div></main>")).alias("html"))
    day_text = lambda c, n: F.date_format(c, "yyyy-MM-dd").alias(n)
    return S.site_cards(pages).select("page_id", "pos", "kind", "title", "link", day_text("start", "start"), day_text("end", "stop"), "place", "reject")


@query(f"""with {_A}, d as (select *, {_DAY} as day from activity) select id, case when id % 4 = 3 then '' else organizer end as organizer, case id % 3 when 0 then '' else (id % 300) || ' 元' end as fee, case when id % 2 = 0 then 'https://i.example.com/' || id || '.png' else '' end as pictures from d""")
def page_details(spark, sf):
    """Details whose labels are split over elements, with pictures."""
    body = """concat('<nav>主办方：no</nav><article><div><p><b>主办</b>方', if(id % 4 = 3, '', concat('：<span>', organizer, '</span>')), '</p><p>费用：</p>', if(id % 3 = 0, '', concat('<p>', id % 300, '<i> 元</i></p>')), '<p>活动费用</p><p>：</p><img alt="QR code" src="/q.png">',
      if(id % 2 = 0, concat('<div><img alt="" src="//i.example.com/', id, '.png"></div>'), ''), '</div></article>')"""
    found = S.page_details(V.activity(spark, sf).select(F.col("id").alias("page_id"), F.lit("https://a.example.com/x").alias("url"), F.expr(body).alias("html")))
    return found.select(F.col("page_id").alias("id"), "organizer", "fee", F.array_join("pictures", ",").alias("pictures"))


@query(f"""with {_A}, d as (select *, {_DAY} as day from activity) select id, title, strftime(day, '%Y-%m-%d') as start_at, id % 2 = 0 as all_day, district || ' hall' || ' ' || district as location, district as city, organizer || case when id % 5 = 0 then ' / Second' else '' end as organizer,
  ['online', 'offline', 'hybrid', 'unknown'][id % 4 + 1] as attendance, case when id % 6 = 0 then 'cancelled' else 'scheduled' end as status, case when id % 3 = 0 then '免费 / ' || (id % 300 + 1) when id % 3 = 1 then '免费' end as cost_text from d""")
def json_ld_events(spark, sf):
    """Declared activities, nested at any depth, with places, organizers, modes, states and prices."""
    mode = "element_at(array('OnlineEventAttendanceMode', 'OfflineEventAttendanceMode', 'MixedEventAttendanceMode', 'None'), cast(id % 4 as int) + 1)"
    node = f"""concat('{{"@graph":[{{"x":{{"@type":["Thing","https://schema.org/MusicEvent"],"name":"', title, '","startDate":"', date_format(add_months(to_date(start_at), 336), 'yyyy-MM-dd'), if(id % 2 = 0, '', 'T10:00'), '","location":{{"name":"', district, ' hall","address":{{"addressLocality":"', district, '"}}}},
      "organizer":', if(id % 5 = 0, concat('["', organizer, '",{{"name":"Second"}},"', organizer, '"]'), concat('{{"name":"', organizer, '"}}')), ',"eventAttendanceMode":"https://schema.org/', {mode}, '","eventStatus":"https://schema.org/', if(id % 6 = 0, 'EventCancelled', 'EventScheduled'), '"',
      case id % 3 when 0 then concat(',"offers":[{{"price":"', id % 300 + 1, '"}},{{"lowPrice":0,"highPrice":true}},{{"price":-1}}]') when 1 then ',"isAccessibleForFree":true' else ',"offers":{{"price":"ask"}}' end, '}}}}]}}')"""
    html = F.concat(F.lit('<script type="application/ld+json">not json</script><script type="application/ld+json">'), F.expr(node), F.lit("</script>"))
    found = D.json_ld_events(V.activity(spark, sf).select(F.col("id").cast("string").alias("url"), html.alias("html")))
    return found.select(F.col("url").cast("long").alias("id"), "title", F.substring("start_at", 1, 10).alias("start_at"), "all_day", "location", "city", "organizer", "attendance", "status", "cost_text")


@query(f"with {_A} select id % 500 as source_id, title, 'https://a.example.com/e/' || id as link, strftime(start_at, '%Y-%m-%d') as published from activity where id % 7 <> 0")
def feed_entries(spark, sf):
    """Items of RSS and entries of Atom, their publication kept apart."""
    link, day = "concat('https://a.example.com/e/', id, '?utm_source=feed')", "date_format(start_at, 'yyyy-MM-dd')"
    title = "if(id % 7 = 0, '', title)"
    piece = f"""if(id % 2 = 0, concat('<item><title><![CDATA[', {title}, ']]></title><link>', {link}, '</link><pubDate>', {day}, '</pubDate></item>'),
      concat('<entry><title type="text"> ', {title}, '</title><link rel="self" href="https://x/"/><link href="', {link}, '"/><updated>', {day}, '</updated></entry>'))"""
    feeds = V.activity(spark, sf).select((F.col("id") % 500).alias("source_id"), F.concat(F.lit("<feed><title>all</title>"), F.expr(piece), F.lit("</feed>")).alias("body"))
    return D.feed_entries(feeds)


# --- texts ---------------------------------------------------------------------------------------------------


@query(f"""with {_A}, d as (select id, {_DAY} as day from activity) select id, strftime(day, '%Y-%m-%d') as date, ['registration_window', 'actual_occurrence', 'unknown', 'promotion_window'][id % 4 + 1] as role, 0 as k from d
union all select id, strftime(day + 1, '%Y-%m-%d'), 'actual_occurrence', 1 from d where id % 4 = 1 union all select id, strftime(day + 2, '%Y-%m-%d'), 'publication_time', 1 from d where id % 4 = 0""")
def dated_roles(spark, sf):
    """each date of a text with the role of the nearest cue before it in its sentence."""
    rows = V.activity(spark, sf).withColumn("day", F.expr("add_months(to_date(start_at), 336)"))
    of = lambda n: f"date_format(date_add(day, {n}), 'yyyy年M月d日')"
    text = f"element_at(array(concat('报名截至', {of(0)}, '；更新于', {of(2)}), concat('发布会的活动时间：', {of(0)}, '、', date_format(date_add(day, 1), 'yyyy/M/d')), concat('活动时间待定。', {of(0)}), concat('活动时间见下，推广期', {of(0)})), cast(id % 4 as int) + 1)"
    return rows.select("id", F.posexplode(W.dated_roles(F.expr(text))).alias("k", "r")).select("id", F.date_format("r.date", "yyyy-MM-dd").alias("date"), "r.role", "k")


@query("select user_id % 40 as source_id, count(distinct event_id % 5000) filter (event_type <> 'error') as recognised, count(distinct event_id % 5000) filter (event_type = 'error') as excluded from events group by 1")
def page_inventory(spark, sf):
    """Q7: different items recognised and excluded, from bitmaps of each run and page."""
    items = V.table(spark, sf, "events").select((F.col("user_id") % 40).alias("source_id"), F.to_date("ts").alias("run"), (F.col("user_id") % 7).alias("page"), (F.col("event_id") % 5000).alias("item"), (F.col("event_type") != "error").alias("recognised"))
    pages = P.page_inventory(items, "source_id", "run", "page")
    runs = P.merge_inventories(pages, "source_id", "run")
    return P.inventory_counts(P.merge_inventories(runs, "source_id"), "source_id")


@query(f"""with {_A} select id, id % 5 in (1, 2) as held, id % 3 as version, case when id % 7 = 6 then null else sha256('a' || chr(1) || '[1,{{"x":2,"y":' || (id % 3) || '}}]' || chr(2) || 'review_hold' || chr(1) || ['false', 'true', '"yes"', '0', '""'][id % 5 + 1]) end as fingerprint from activity""")
def detail_fingerprints(spark, sf):
    """Flags and canonical digests of JSON details, whatever the order of their keys."""
    hold = "element_at(array('false', 'true', '\"yes\"', '0', '\"\"'), cast(id % 5 as int) + 1)"
    details = f"""case when id % 7 = 6 then '[no object' when id % 2 = 0 then concat('{{"review_hold": ', {hold}, ', "checked_at": "', id, '", "a": [1, {{"y": ', id % 3, ', "x": 2}}]}}')
      else concat('{{"a":[1,{{"x":2,"y":', id % 3, '}}],"review_hold":', {hold}, '}}') end"""
    return V.activity(spark, sf).select("id", (P.held(F.expr(details)) | F.expr("id % 7 = 6 and id % 5 in (1, 2)")).alias("held"), (F.col("id") % 3).alias("version"), P.fingerprint(F.expr(details)).alias("fingerprint"))


# --- identity ------------------------------------------------------------------------------------------------


def _search_rows(spark, sf) -> DataFrame:
    rows = V.table(spark, sf, "orders")
    return rows.select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 3).alias("source_id"), F.expr("concat('item ', o_custkey div 3)").alias("title"), F.lit("body").alias("body"),
        F.expr("if(o_orderkey % 3 = 0, concat('p', o_custkey % 2), null)").alias("published_at"), F.expr("if(o_orderkey % 5 = 0, 'o', null)").alias("organizer"),
        (F.col("o_orderkey") % 4 == 0).alias("done"), F.col("o_orderdate").cast("string").alias("collected_at"),
    )


@query("""with r as (select o_orderkey as id, o_custkey, o_orderkey % 4 = 0 as done, cast(o_orderdate as date) as day from orders),
g as (select id, first_value(id) over (partition by o_custkey order by done desc, day desc, id desc) as copy_of, count(*) over (partition by o_custkey) as group_size from r) select id, copy_of, group_size, false as conflict from g""")
def search_copies(spark, sf):
    """Copies of search items by equality that tolerates what is unknown, and the one of each group that is kept."""
    return I.search_copies(_search_rows(spark, sf))


@query()
def assign_in_order(spark, sf):
    """New rows assigned as if they came one after another, by link, alias, stored duplicate and earlier founder; a test has the loop."""
    slices, pairs = E.duplicate_kinds(V.activity(spark, sf))
    pairs = I.settled(pairs)
    a = slices.select("kind", F.explode("ids").alias("id"))
    new = a.where("id % 3 <> 0").select("kind", F.col("id").alias("row"), (F.col("id") % 9).alias("source_id"), F.expr("concat('https://a.example.com/', id div 2)").alias("url"), F.expr("if(id % 50 = 1, concat('alias ', id % 7), null)").alias("alias_id"))
    held = a.where("id % 3 = 0")
    least = I.settled(held.groupBy("kind").agg(F.min("id").alias("event_id")))
    near = pairs.union(pairs.select("b", "a")).join(least.withColumnRenamed("kind", "b"), "b").select(F.col("a").alias("kind"), "event_id")
    stored = near.union(least).withColumn("place", F.col("event_id"))
    links = held.select((F.col("id") % 9).alias("source_id"), F.expr("concat('https://a.example.com/', id div 2)").alias("url"), F.col("id").alias("event_id"))
    aliases = spark.createDataFrame([("alias 0", "0")], "alias_id string, event_id string")
    return I.assign_in_order(new, links, aliases, stored, pairs)


# --- patches -------------------------------------------------------------------------------------------------


def _patches(rows: DataFrame) -> DataFrame:
    asked = rows.where("id % 4 <> 3").select(
        "id", F.create_map(F.lit("status"), F.expr("if(id % 5 = 0, 'other', status)")).alias("guard"),
        F.expr("case when id % 11 = 0 then map('district', 'x') when id % 3 = 0 then map('status', status) else map('status', 'needs_review', 'organizer', concat('by ', id)) end").alias("patch"),
    )
    return asked.union(asked.where("id % 97 = 0"))


_OUTCOME = "case when id % 11 = 0 or id % 97 = 0 then 'invalid' when id % 3 = 0 then 'already' when id % 5 = 0 then 'stale' else 'applied' end"


@query(f"with {_A} select id, {_OUTCOME} as outcome from activity where id % 4 <> 3")
def reviewed_patches(spark, sf):
    """M8: patches by compare and set: applied, already, stale or invalid."""
    rows = V.activity(spark, sf).select("id", "status", "organizer", "district")
    return P.judge_patches(rows, _patches(rows))


@query(f"with {_A}, p as (select *, id % 4 <> 3 and {_OUTCOME} = 'applied' as hit from activity) select id, case when hit then 'needs_review' else status end as status, case when hit then 'by ' || id else organizer end as organizer, district from p")
def reviewed_updates(spark, sf):
    """M8: the table with the patches that are applied; nothing else changes."""
    rows = V.activity(spark, sf).select("id", "status", "organizer", "district")
    return P.apply_patches(rows, _patches(rows))


@query(f"with {_A} select cast(id as varchar) as id, case when id % 6 = 0 then 'gone' when id % 6 < 4 then 'changed' else 'same' end as outcome from activity")
def resolution_authority(spark, sf):
    """Whether what a decision rests on has changed since it was read: the row, its links or its anchors."""
    rows = V.activity(spark, sf).select("id", "status", "start_at")
    links, anchors = rows.select(F.col("id").alias("event_id"), F.lit("u").alias("url")), rows.select(F.col("id").alias("event_id"), F.lit("d").alias("day"))
    read = P.authority(rows, links, anchors)
    now = P.authority(
        rows.where("id % 6 <> 0").withColumn("status", F.expr("if(id % 6 = 1, 'x', status)")), links.where("event_id % 6 <> 0").withColumn("url", F.expr("if(event_id % 6 = 2, 'v', url)")), anchors.where("event_id % 6 not in (0, 3)")
    )
    return P.authority_conflicts(read, now)


@query("select event_type as kind, strftime(ts, '%Y-%m-%d %H:%M:%S') as started_at, case when event_id % 3 = 0 then 'partial' else 'ok' end as status, least(8000, event_id % 9000) as kept from events where event_id % 50 = 0")
def run_log(spark, sf):
    """K4: rows of the append-only log, their details bounded."""
    rows = V.table(spark, sf, "events").where("event_id % 50 = 0").select(F.col("event_type").alias("kind"), F.expr("if(event_id % 2 = 0, null, ts)").alias("started_at"), F.col("ts").alias("finished_at"), F.expr("if(event_id % 3 = 0, 'partial', 'ok')").alias("status"), F.expr("repeat('x', cast(event_id % 9000 as int))").alias("details"))
    n = F.length("details").cast("long")
    log = P.run_log(rows)
    return log.select("kind", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"), "status", n.alias("kept"))


@query("select o_orderkey as id, 'Café ' || o_orderkey as heading from orders")
def headings(spark, sf):
    """headings in composed form, white space collapsed."""
    return V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), X.heading(F.expr("concat('  Cafe\u0301   ', o_orderkey, ' ')")).alias("heading"))

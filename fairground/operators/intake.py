"""What a run takes up: sources that are due, pages behind a cursor, rows that are admitted, places, approved pictures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairground.functions import grammar as G
from fairground.functions import text as X
from fairground.operators import merges as M

#: Fixed values.
ASSET = r"^[a-f0-9]{64}\.(?:webp|png|jpg)$"
HOME, HOME_LATIN, UNSURE, ONLINE = "深圳", "shenzhen", "待确认", "线上"
SHORT_LEAD, KEPT_DAYS = 40, 45
RUN_SECONDS, LEAST_SECONDS = 380, 20


def approved_images(details: DataFrame, manifest: DataFrame) -> DataFrame:
    """(id, images): the pictures of (id, images) that a reviewed manifest (url, asset) names, by address; every id has a map.

    Only https addresses and assets named by their digest count.  An address that the manifest names twice has its last asset by
    name; repeated ids are one; a null picture or list has none.
    """
    known = manifest.where(F.col("url").startswith("https://") & F.col("asset").rlike(ASSET)).groupBy("url").agg(F.max("asset").alias("asset"))
    # A pair that comes more often is one in the set, so that pairs needn't be told apart before; ids come along with no pair instead of in a join.
    asked = details.where("id is not null").select("id", F.explode(F.array_distinct("images")).alias("url")).where(F.col("url").startswith("https://"))
    pairs = asked.join(known, "url").select("id", F.struct("url", "asset").alias("pair"))
    every = details.select("id", F.lit(None).cast(pairs.schema["pair"].dataType).alias("pair"))
    return every.union(pairs).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_set("pair"))).alias("images"))


def resumed(pages: DataFrame, sources: DataFrame, cursors: DataFrame, most: int) -> DataFrame:
    """(source_id, seq, url, traversal_from_root, next_cursor, truncated): the pages that a run visits.

    pages: (source_id, seq, url) in order of seq; sources: (source_id, url); cursors: (source_id, next_cursor).  A run begins at
    its cursor if that is on the source's host and path, else at the first page; it takes ``most`` pages, and the next one's
    address is the cursor of the next run, null at the end.  A cursor that no page has gives no page.
    """
    route = lambda c: F.regexp_extract(c, r"^https?://([^?#]*)", 1)
    last = cursors.groupBy("source_id").agg(F.max("next_cursor").alias("cursor"))
    begun = sources.join(last, "source_id", "left").withColumn("cursor", F.when(route("cursor") == route("url"), F.col("cursor"))).select("source_id", "cursor")
    at = pages.select("source_id", F.col("url").alias("cursor"), "seq").join(begun.where("cursor is not null"), ["source_id", "cursor"]).groupBy("source_id").agg(F.min("seq").alias("from_seq"))
    rows = pages.join(begun.join(at, "source_id", "left"), "source_id").where("cursor is null or seq >= from_seq")
    line = Window.partitionBy("source_id").orderBy("seq", "url")
    some = rows.withColumn("k", F.row_number().over(line)).where(F.col("k") <= most + 1)
    after = F.max(F.when(F.col("k") == most + 1, F.col("url"))).over(Window.partitionBy("source_id"))
    some = some.withColumn("next_cursor", after).where(F.col("k") <= most)
    return some.select("source_id", "seq", "url", F.col("cursor").isNull().alias("traversal_from_root"), "next_cursor", F.col("next_cursor").isNotNull().alias("truncated"))


def due_sources(sources: DataFrame, now: Column, force: bool = False, seconds: int = RUN_SECONDS) -> DataFrame:
    """(source_id, state) of (source_id, priority, last_attempt, next_attempt, seconds): due ones run in order, longest left alone first, then by priority, until
    the run's time is used; what then has under 20 seconds left is deferred, what isn't due waits.

    ``seconds`` of a source, at least one, is what it may take.  No more sources than the run has seconds can start, so that only
    so many are put in order in one place.
    """
    due = F.lit(force) | F.coalesce(F.col("next_attempt") <= now, F.lit(True))
    order = [F.col("last_attempt").asc_nulls_first(), F.coalesce("priority", F.lit(50)).asc(), F.col("source_id").asc()]
    spent = F.greatest(F.coalesce("seconds", F.lit(160)), F.lit(1))
    first = sources.where(due).orderBy(*order).limit(seconds)
    before = F.sum(spent).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    runs = first.select("source_id", (seconds - F.coalesce(before, F.lit(0)) >= LEAST_SECONDS).alias("runs"))
    state = F.when(~due, "waiting").when(F.coalesce("runs", F.lit(False)), "running").otherwise("deferred")
    return sources.join(runs, "source_id", "left").select("source_id", state.alias("state"))


def admitted(items: DataFrame, as_of: Column) -> DataFrame:
    """``items`` with (city, admitted_status, reject): what a run admits of (title, summary, place, stated_city, url, attendance, start, end, status) under its source's
    (allow_online, city_scope, national, strict, structured) and whether details can follow (detail_candidate); reject is the first reason against a row.

    Online rows pass where their source allows them; others must be of the home city.  Of a strict source the city must be certain,
    of structured data too; an uncertain row of a national source must name the city in its words, and loses its dates to review.
    What ended over 45 days ago, short leads without a date, and rows without title or address are rejected.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    online = F.col("attendance").isin("online", "hybrid") & yes("allow_online")
    city = F.when(online, HOME).otherwise(G.city_of(F.col("stated_city"), F.col("place"), F.col("city_scope")))
    rows = items.withColumn("__city", city)
    unsure = F.col("__city") == UNSURE
    words = F.lower(F.concat_ws(" ", "title", "summary"))
    named = words.contains(HOME) | words.contains(HOME_LATIN)
    reviewed = unsure & yes("national") & ~yes("strict")
    start, end = (F.when(~reviewed, F.col(c)) for c in ("start", "end"))
    reject = F.when(~online & yes("strict") & unsure, "city_unsure").when(~F.col("__city").isin(HOME, UNSURE), "other_city").when(reviewed & ~named, "city_unsure").when(unsure & yes("structured"), "city_unsure")
    reject = reject.when(F.coalesce(end, start) < as_of - F.expr(f"interval {KEPT_DAYS} days"), "past").when(start.isNull() & (F.length(F.coalesce("summary", F.lit(""))) < SHORT_LEAD) & ~yes("detail_candidate"), "short_lead")
    reject = reject.when((X.clean(F.col("title")) == "") | (X.canon_url(F.col("url")) == ""), "no_title_or_link")
    kept = F.when(online, F.when(X.clean(F.col("stated_city")) != "", F.col("stated_city")).otherwise(ONLINE)).otherwise(HOME)
    rows = rows.withColumn("reject", reject).withColumn("__start", start).withColumn("__end", end).withColumn("admitted_status", F.when(reviewed, "needs_review").otherwise(F.col("status")))
    own = [c for c in items.columns if c not in ("start", "end")]
    return rows.select(*(F.col(f"`{c}`") for c in own), F.col("__start").alias("start"), F.col("__end").alias("end"), F.when(F.col("reject").isNull(), kept).alias("city"), "admitted_status", "reject")


def resolved_districts(rows: DataFrame, geocodes: DataFrame, places: DataFrame) -> DataFrame:
    """(id, district, method, outcome) of (id, place): by the place's own words, then by a gazetteer's one district, then by ranked places.

    geocodes: (query, district, adcode) and places: (query, name, address, district) are the answers to ``place_query``.  Each
    different query is worked on once.  Answers in several districts, and queries in Latin letters, go on to the ranked places.
    Places elsewhere, and those too vague to ask for, are skipped.
    """
    elsewhere = F.lower(X.clean(F.col("place"))).rlike("|".join(p.lower() for p in G.FOREIGN_PLACES))
    asked = rows.select("id", F.when(elsewhere, "").otherwise(X.named_district(F.col("place"))).alias("direct"), G.place_query(F.col("place")).alias("query"))
    # In a generator: filters would be moved down to the places, each with the expressions of the query once more.
    queries = asked.select(F.explode(F.array_compact(F.array(F.when((F.col("direct") == "") & (F.col("query") != ""), F.col("query"))))).alias("query")).distinct()
    coded = geocodes.select("query", G.district(F.col("district"), F.col("adcode")).alias("d")).where("d <> ''").groupBy("query").agg(F.min("d").alias("district"), F.max("d").alias("other")).where("district = other")
    by_code = queries.where(~G.mostly_latin(F.col("query"))).join(coded, "query").select("query", "district", F.lit("geocode").alias("method"))
    ranked = M.located(queries.join(by_code, "query", "left_anti"), places).select("query", "district", F.lit("poi").alias("method"))
    found = asked.join(by_code.union(ranked), "query", "left")
    outcome = F.when(F.col("direct") != "", "ok").when(F.col("query") == "", "skipped").when(F.col("district").isNotNull(), "ok").otherwise("not_found")
    method = F.when(F.col("direct") != "", "text").when(F.col("query") == "", "skip").otherwise(F.coalesce("method", F.lit("poi")))
    return found.select("id", F.when(F.col("direct") != "", F.col("direct")).otherwise(F.coalesce("district", F.lit(""))).alias("district"), method.alias("method"), outcome.alias("outcome"))


def ingested(stored: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """(id, title, start, end, place, district, event_type, event_type_state, status, hold, origin_priority, content_hash, first_seen, last_seen, ai_state, outcome): ``stored`` after a run.

    stored has these columns but the outcome; new has (id, title, start, end, place, district, event_type, event_type_state, status,
    content_hash, priority, gated, reinstated).  A row is inserted if its id is new, replaced if it has changed and its source ranks
    at least as high, else given its source's type alone if that ranks as high, else only seen.  What was known sticks: first_seen;
    the district while the place stays; a stated type against a bare one; a hold, which keeps the row in review; and, of gated
    sources, a cancellation until a reinstatement.  Of several new rows of an id the highest ranked, then the last by content, counts.
    """
    known = ["title", "start", "end", "place", "district", "event_type", "event_type_state", "status"]
    one = new.groupBy("id").agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in new.columns)), F.struct("priority", F.xxhash64("content_hash", "title", "status"))).alias("n")).select("n.*")
    was, is_new = stored.withColumn("__held", F.lit(True)).alias("was"), one.withColumn("__here", F.lit(True)).alias("now")
    rows = was.join(is_new, F.col("was.id") == F.col("now.id"), "full_outer")
    old, fresh = (lambda c: F.col(f"was.{c}")), (lambda c: F.col(f"now.{c}"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    first, absent = old("__held").isNull(), fresh("__here").isNull()
    ranks = yes(fresh("priority") <= old("origin_priority"))
    changed = ~fresh("content_hash").eqNullSafe(old("content_hash"))
    district = F.when(~first & old("place").eqNullSafe(fresh("place")) & (fresh("district") == UNSURE), old("district")).otherwise(fresh("district"))
    bare = ~first & yes(fresh("event_type") == "Event") & yes(old("event_type_state").isin("source", "ai"))
    kind, state = (F.when(bare, old(c)).otherwise(fresh(c)) for c in ("event_type", "event_type_state"))
    off = yes(fresh("gated")) & (yes(fresh("status") == "cancelled") | (yes(old("status") == "cancelled") & ~yes(fresh("reinstated"))))
    status = F.when(off, "cancelled").when(yes(old("hold")), "needs_review").otherwise(fresh("status"))
    takes = first | (~absent & changed & ranks)
    typed = ~takes & ~absent & ranks & yes(state == "source")
    made = {**{c: fresh(c) for c in known}, "district": district, "event_type": kind, "event_type_state": state, "status": status}
    out = {c: F.when(takes, v).otherwise(old(c)) for c, v in made.items()}
    out["event_type"] = F.when(takes | typed, kind).otherwise(old("event_type"))
    out["event_type_state"] = F.when(takes | typed, state).otherwise(old("event_type_state"))
    out |= {
        "hold": yes(old("hold")), "origin_priority": F.when(takes, fresh("priority")).otherwise(old("origin_priority")), "content_hash": F.when(absent, old("content_hash")).otherwise(fresh("content_hash")),
        "first_seen": F.coalesce(old("first_seen"), now), "last_seen": F.when(absent, old("last_seen")).otherwise(now), "ai_state": F.when(takes, F.when(yes(old("hold")), "review").otherwise("pending")).otherwise(old("ai_state")),
        "outcome": F.when(first, "inserted").when(absent, "absent").when(takes, "replaced").when(typed, "typed").otherwise("seen"),
    }
    return rows.select(F.coalesce("was.id", "now.id").alias("id"), *(v.alias(c) for c, v in out.items()))


def folded(line: Column) -> Column:
    """A line of a calendar in lines of at most 75 bytes, each but the first begun by a blank; no character is split."""
    return F.regexp_replace(line, F.when(line.rlike(r"[^\x00-\x7F]"), r"(.{18})(?=.)").otherwise(r"(.{74})(?=.)"), F.lit("$1\r\n "))


def calendar_lines(rows: DataFrame, name: str) -> DataFrame:
    """(part, id, text): a calendar of (id, title, summary, place, url, cost_text, start, end, all_day, status, planning_eligible, last_seen, sources), to be written in order of part and id.

    Only scheduled activities that may be planned and have a start are in it.  Days end exclusively, by default after one day; a
    clock's end is given only if it is known.  An address that is none is left out.  ``last_seen`` is a time in UTC, ``sources`` an
    array of struct(name, url); the times are local.  Texts are escaped and lines folded.  An empty table is an empty calendar.
    """
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"([\\;,])", r"\\$1"), r"\r?\n", r"\\n")
    day = lambda c: F.concat(F.lit(";VALUE=DATE:"), F.date_format(c, "yyyyMMdd"))
    clock = lambda c: F.concat(F.lit(";TZID=Asia/Shanghai:"), F.date_format(c, "yyyyMMdd'T'HHmmss"))
    stamp = F.date_format("last_seen", "yyyyMMdd'T'HHmmss'Z'")
    whole = F.coalesce("all_day", F.lit(False))
    end = F.when(whole, day(F.coalesce(F.col("end").cast("date"), F.date_add(F.col("start").cast("date"), 1)))).otherwise(clock(F.col("end")))
    told = F.array_join(F.transform(F.coalesce("sources", F.array().cast("array<struct<name string,url string>>")), lambda s: F.concat_ws(": ", s["name"], s["url"])), "\n")
    about = F.btrim(F.concat(F.coalesce("summary", F.lit("")), F.lit("\n\n费用："), F.coalesce("cost_text", F.lit("费用未注明")), F.lit("\n以主办方最新说明为准。\n"), told), F.lit(" \n\r\t"))
    tagged = lambda tag, value: F.concat(F.lit(tag), value)
    address = F.when(X.canon_url(F.col("url")) != "", F.trim("url"))
    lines = [
        F.lit("BEGIN:VEVENT"), tagged("UID:", F.concat(F.col("id").cast("string"), F.lit("@fairground"))), tagged("DTSTAMP:", stamp), tagged("LAST-MODIFIED:", stamp), tagged("DTSTART", F.when(whole, day(F.col("start"))).otherwise(clock(F.col("start")))), tagged("DTEND", end),
        tagged("SUMMARY:", plain(F.col("title"))), tagged("LOCATION:", plain(F.col("place"))), tagged("DESCRIPTION:", plain(about)), tagged("URL:", address), F.lit("STATUS:CONFIRMED"), F.lit("END:VEVENT"),
    ]
    kept = rows.where("start is not null and planning_eligible and status = 'scheduled'")
    events = kept.select(F.lit(1).alias("part"), F.col("id").cast("string").alias("id"), F.array_join(F.transform(F.array_compact(F.array(*lines)), folded), "\r\n").alias("text"))
    head = ["BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//fairground//activities//ZH-CN", f"X-WR-CALNAME:{name}", "X-WR-TIMEZONE:Asia/Shanghai"]
    ends = rows.sparkSession.createDataFrame([(0, None, "\r\n".join(head)), (2, None, "END:VCALENDAR")], events.schema)
    return ends.union(events)

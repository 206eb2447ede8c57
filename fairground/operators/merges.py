"""Details merged into what a listing says, results of others applied, and identity of new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairground.functions import grammar as G
from fairground.functions.text import canon_url, clean, district_of, norm, ratio

#: Fixed values.
UNKNOWN_FEES = ["", "费用未注明", "未注明", "未知", "待确认"]
FREE = ["免费", "0元", "免费参加"]
CACHE_DAYS, PURGE_DAYS = 30, 90
LEAST_SCORE, CLOSE_SCORE = 58, 3


def _empty(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")) == ""


def chosen_details(base: DataFrame, details: DataFrame) -> DataFrame:
    """(id, organizer, fee, start, end, all_day): one row for each id that has details it may take.

    Details of the listing's own address are taken, or else those of the only address that the id has details of.  Of several
    the first in order of ``rank`` that has an organizer, or a start, gives it; all known costs are joined.  ``url`` and ``rank`` may
    be missing: then all of an id's details are of one address, and of one rank.
    """
    for c, kind in (("url", "string"), ("rank", "int")):
        if c not in details.columns:
            details = details.withColumn(c, F.lit(None).cast(kind))
    own = base.select("id", (canon_url(F.col("url")) if "url" in base.columns else F.lit("")).alias("own")).distinct()
    rows = details.withColumn("address", canon_url(F.col("url"))).join(own, "id")
    addresses = rows.groupBy("id").agg(F.count_distinct("address").alias("n"), F.max(F.col("address") == F.col("own")).alias("mine"))
    rows = rows.join(addresses, "id").where(F.when(F.col("mine"), F.col("address") == F.col("own")).otherwise(F.col("n") == 1))
    order = F.struct(F.coalesce("rank", F.lit(0)), "start", "end", "organizer", "fee")
    fee = F.trim(F.coalesce("fee", F.lit("")))
    first = lambda value, known: F.min_by(value, F.when(known, order))
    time = first(F.struct("start", "end", "all_day"), F.col("start").isNotNull())
    joined = F.array_join(F.array_sort(F.collect_set(F.when(~fee.isin(UNKNOWN_FEES), fee))), " / ")
    return rows.groupBy("id").agg(first(F.col("organizer"), ~_empty("organizer")).alias("organizer"), joined.alias("fee"), time["start"].alias("start"), time["end"].alias("end"), time["all_day"].alias("all_day"))


def fill_details(base: DataFrame, details: DataFrame) -> DataFrame:
    """(id, organizer, fee, start, end, all_day, filled): only what the listing doesn't know is filled.

    Both sides are (id, organizer, fee, start, end, all_day), the listing also has ``hold``; of several details of an id
    ``chosen_details`` makes one.  A schedule is taken over whole, and never under a hold; an end alone only where start and
    precision are equal.  ``filled`` names the fields that come from the details.  A listing without details is left as it is.
    """
    d = chosen_details(base, details).select("id", *(F.col(c).alias(f"d_{c}") for c in ("organizer", "fee", "start", "end", "all_day")))
    rows = base.join(d, "id", "left")
    open_ = ~F.coalesce("hold", F.lit(False)) & F.col("d_start").isNotNull()
    whole = open_ & F.col("start").isNull() & (F.col("end").isNull() | F.coalesce(F.col("end") == F.col("d_end"), F.lit(False)))
    completes = open_ & ~whole & F.col("end").isNull() & F.coalesce(F.col("d_end").isNotNull() & (F.col("start") == F.col("d_start")) & (F.col("all_day") == F.col("d_all_day")), F.lit(False))
    organizer = _empty("organizer") & ~_empty("d_organizer")
    fee = F.coalesce(F.col("fee"), F.lit("")).isin(UNKNOWN_FEES) & ~F.coalesce(F.col("d_fee"), F.lit("")).isin(UNKNOWN_FEES)
    taken = {"organizer": organizer, "fee": fee, "start": whole, "end": (whole & F.col("d_end").isNotNull()) | completes, "all_day": whole}
    filled = F.concat_ws(",", *(F.when(taken[c], c) for c in taken))
    return rows.select("id", *(F.when(taken[c], F.col(f"d_{c}")).otherwise(F.col(c)).alias(c) for c in taken), filled.alias("filled"))


def refine_listing(listing: DataFrame, details: DataFrame) -> DataFrame:
    """(id, start, end, status): a fresh listing outranks its details.

    Both sides are (id, start, end, all_day, status).  On the same date a listing of one whole day takes the details' clock;
    any other difference puts it in review, and what is cancelled stays so.
    """
    d = details.select("id", *(F.col(c).alias(f"d_{c}") for c in ("start", "end", "status")))
    rows = listing.join(d, "id", "left")
    same = F.coalesce(F.to_date("start") == F.to_date("d_start"), F.lit(False))
    single = F.coalesce(F.col("end") == F.timestamp_add("DAY", F.lit(1), F.col("start")), F.lit(False))
    told = F.col("d_start").isNotNull()
    refined = told & same & single & F.col("all_day")
    differs = (F.col("start") != F.col("d_start")) | ~F.col("end").eqNullSafe(F.col("d_end"))
    conflict = told & ~refined & (~same | F.col("all_day") | F.coalesce(differs, F.lit(True)))
    status = F.when(F.col("status") == "cancelled", "cancelled").when(conflict | (F.col("d_status") == "needs_review"), "needs_review").otherwise(F.col("status"))
    return rows.select("id", *(F.when(refined, F.col(f"d_{c}")).otherwise(F.col(c)).alias(c) for c in ("start", "end")), status.alias("status"))


def patched(rows: DataFrame) -> DataFrame:
    """(id, place, fee, kind, changed) of (id, title, summary, place, fee, kind, pending, hold): gaps filled from the kept text.

    Rows under a hold stay; a kind is only given to a pending row whose title names a show.  Rows that nothing changes are left out.
    """
    free = ~F.coalesce("hold", F.lit(False))
    new = {
        "place": F.when(free & _empty("place"), G.inline_field(F.col("summary"), "地点", 250)),
        "fee": F.when(free & F.coalesce(clean(F.col("fee")), F.lit("")).isin(UNKNOWN_FEES), G.inline_field(F.col("summary"), "费用", 100)),
        "kind": F.when(free & F.col("pending"), G.show_type(F.col("title"))),
    }
    changed = F.concat_ws(",", *(F.when(v.isNotNull() & ~v.eqNullSafe(F.col(c)), c) for c, v in new.items()))
    return rows.select("id", *(F.coalesce(v, F.col(c)).alias(c) for c, v in new.items()), changed.alias("changed")).where("changed <> ''")


def assigned(new: DataFrame, links: DataFrame, aliases: DataFrame, duplicates: DataFrame) -> DataFrame:
    """(row_id, event_id, by): the activity that a row belongs to.

    ``new`` is (row_id, source_id, url); links are (source_id, url, event_id); aliases (url, event_id); duplicates (row_id,
    event_id).  The first that answers wins: its own link, an alias of its address, the smallest duplicate, a new id.
    """
    linked = links.groupBy("source_id", "url").agg(F.min("event_id").alias("by_link"))
    aliased = aliases.groupBy("url").agg(F.min("event_id").alias("by_alias"))
    copied = duplicates.groupBy("row_id").agg(F.min("event_id").alias("by_copy"))
    rows = new.join(linked, ["source_id", "url"], "left").join(aliased, "url", "left").join(copied, "row_id", "left")
    made = F.substring(F.sha2(F.concat_ws("|", F.col("source_id").cast("string"), "url"), 256), 1, 20)
    by = F.when(F.col("by_link").isNotNull(), "link").when(F.col("by_alias").isNotNull(), "alias").when(F.col("by_copy").isNotNull(), "duplicate").otherwise("new")
    return rows.select("row_id", F.coalesce(*(F.col(c).cast("string") for c in ("by_link", "by_alias", "by_copy")), made).alias("event_id"), by.alias("by"))


def classified(rows: DataFrame, results: DataFrame, topics: list[str], kinds: list[str]) -> DataFrame:
    """(id, topics, kind, kind_state, priority, commercial, status) of rows with a result for their very text.

    Results of another digest are dropped, as are those of a weaker source for what is done.  Words outside the vocabularies
    become the neutral one; a kind that a source states stays; what is highly commercial has no priority.
    """
    r = results.select("id", "digest", *(F.col(c).alias(f"r_{c}") for c in ("topics", "kind", "priority", "commercial", "local", "rank")))
    found = rows.join(r, ["id", "digest"]).where(~((F.col("r_rank") > F.col("rank")) & F.col("done")))
    known = F.slice(F.filter("r_topics", lambda t: t.isin(*topics, "其他")), 1, 5)
    word = lambda c, words, neutral: F.when(F.col(c).isin(words), F.col(c)).otherwise(neutral)
    commercial = word("r_commercial", ["high", "medium", "low", "unknown"], "unknown")
    stated = F.col("kind_state") == "source"
    return found.select(
        "id",
        F.when(F.size(known) > 0, known).otherwise(F.array(F.lit("其他"))).alias("topics"),
        F.when(stated, F.col("kind")).otherwise(word("r_kind", kinds, "Event")).alias("kind"),
        F.when(stated, "source").otherwise("model").alias("kind_state"),
        F.when(commercial == "high", "normal").otherwise(word("r_priority", ["high", "medium", "normal"], "normal")).alias("priority"),
        commercial.alias("commercial"),
        F.when(~F.col("r_local"), "not_event").otherwise(F.col("status")).alias("status"),
    )


def place_score(query: Column, name: Column, address: Column) -> Column:
    """How well a place answers a query: 100 equal, 92 one in the other, else the ratio, at least 85 by its address."""
    q, n, a = norm(query), norm(name), norm(address)
    near = F.greatest(ratio(q, n), F.when((a != "") & (F.contains(a, q) | F.contains(q, a)), 85.0).otherwise(0.0))
    return F.when((q == "") | (n == ""), 0.0).when(q == n, 100.0).when(F.contains(n, q) | F.contains(q, n), 92.0).otherwise(near)


def located(queries: DataFrame, places: DataFrame) -> DataFrame:
    """(query, district, name, score) of queries that one district answers.

    ``queries`` is (query), ``places`` (query, name, address, district): what a gazetteer answered, those of no district left
    out.  The best must reach 58, or be one of several in one district for a query in Latin letters; a runner-up within 3
    points in another district leaves it open.  Ties go by name.
    """
    scored = queries.select("query").distinct().join(places.where("district <> ''"), "query").withColumn("score", place_score(F.col("query"), F.col("name"), F.col("address")))
    rank = Window.partitionBy("query").orderBy(F.desc("score"), "name", "district")
    ranked = scored.withColumn("k", F.row_number().over(rank)).withColumn("next_score", F.lead("score").over(rank)).withColumn("next_district", F.lead("district").over(rank))
    every = Window.partitionBy("query")
    ranked = ranked.withColumn("n", F.count("*").over(every)).withColumn("one", F.min("district").over(every) == F.max("district").over(every))
    sure = (F.col("score") >= LEAST_SCORE) | (G.mostly_latin(F.col("query")) & (F.col("n") > 1) & F.col("one"))
    rival = F.coalesce((F.col("next_score") >= F.col("score") - CLOSE_SCORE) & (F.col("next_district") != F.col("district")), F.lit(False))
    return ranked.where((F.col("k") == 1) & sure & ~rival).select("query", "district", "name", "score")


def with_districts(rows: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """(id, district, outcome) of (id, place, district, asked): cached answers, applied where the district is still unknown.

    An answer is fresh for 30 days; it is dropped if the place has changed since it was ``asked``.  Outcomes: kept (known before),
    resolved, not_found, changed, stale, missing.
    """
    answers = cache.groupBy("query").agg(F.max_by(F.struct("district", "checked_at"), "checked_at").alias("c"))
    found = rows.join(answers, F.col("asked") == F.col("query"), "left")
    fresh = F.datediff(now, F.col("c.checked_at")) < CACHE_DAYS
    outcome = F.when(~F.col("district").isin("", "待确认"), "kept").when(F.col("c").isNull(), "missing").when(~fresh, "stale").when(F.col("place") != F.col("asked"), "changed").when(F.col("c.district") == "", "not_found").otherwise("resolved")
    found = found.withColumn("outcome", outcome)
    return found.select("id", F.when(F.col("outcome") == "resolved", F.col("c.district")).otherwise(F.col("district")).alias("district"), "outcome")


def receipts(captured: DataFrame, known: DataFrame, links: DataFrame) -> DataFrame:
    """(source_id, new, replayed, unlinked, ambiguous) of captured observations.

    ``captured`` is (observation_id, source_id, alias), each counted once; ``known`` holds the ids that were seen before; links are (source_id, alias,
    event_id): an observation is unlinked without, ambiguous with several activities.
    """
    targets = links.groupBy("source_id", "alias").agg(F.count_distinct("event_id").alias("n"))
    rows = captured.dropDuplicates(["observation_id"]).join(known.select("observation_id").distinct().withColumn("seen", F.lit(True)), "observation_id", "left").join(targets, ["source_id", "alias"], "left")
    seen = F.coalesce("seen", F.lit(False))
    return rows.groupBy("source_id").agg(F.count_if(~seen).alias("new"), F.count_if(seen).alias("replayed"), F.count_if(F.col("n").isNull()).alias("unlinked"), F.count_if(F.col("n") > 1).alias("ambiguous"))


def resolutions(requests: DataFrame, guards: DataFrame) -> DataFrame:
    """(resolution_id, outcome): applied if every guard that a request names is as it expects, already if all are resolved so, else conflict.

    Both sides have (source_id, event_id, reason, digest); guards also ``active``.  A request is all or nothing.
    """
    keys = ["source_id", "event_id", "reason"]
    rows = requests.join(guards.select(*keys, F.col("digest").alias("now"), "active"), keys, "left")
    same = F.coalesce(F.col("now") == F.col("digest"), F.lit(False))
    return rows.groupBy("resolution_id").agg(F.when(F.bool_and(same & F.coalesce("active", F.lit(False))), "applied").when(F.bool_and(same & ~F.coalesce("active", F.lit(True))), "already").otherwise("conflict").alias("outcome"))


def bindings(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(binding_id, source_id, alias, canonical, proof) that are new: one for the address asked for and one for the final one."""
    made = rows.select("source_id", F.col("final").alias("canonical"), "proof", F.explode(F.array_distinct(F.array("requested", "final"))).alias("alias"))
    made = made.withColumn("binding_id", F.sha2(F.concat(F.col("source_id").cast("string"), "alias", "proof"), 256)).dropDuplicates(["binding_id"])
    return made.join(known.select("binding_id"), "binding_id", "left_anti").select("binding_id", "source_id", "alias", "canonical", "proof")


def calendar_entry(alias: str = "vevent") -> Column:
    """A calendar entry of (id, title, start_at, end_at, all_day): escaped, days or local times, the end exclusive."""
    escaped = F.regexp_replace(F.regexp_replace("title", r"([\;,])", r"\\$1"), r"\r?\n", r"\\n")
    whole = F.date_add(F.to_date("start_at"), 1)
    day = lambda c: F.concat(F.lit(";VALUE=DATE:"), F.date_format(c, "yyyyMMdd"))
    clock = lambda c: F.concat(F.lit(";TZID=Asia/Shanghai:"), F.date_format(c, "yyyyMMdd'T'HHmmss"))
    end = F.when(F.col("all_day"), day(F.greatest(F.coalesce(F.to_date("end_at"), whole), whole))).otherwise(clock(F.when(F.col("end_at") > F.col("start_at"), F.col("end_at"))))
    parts = F.array_compact(F.array(F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), "id", F.lit("@fairground")), F.concat(F.lit("DTSTART"), F.when(F.col("all_day"), day("start_at")).otherwise(clock("start_at"))), F.concat(F.lit("DTEND"), end), F.concat(F.lit("SUMMARY:"), escaped), F.lit("END:VEVENT")))
    return F.array_join(parts, "\r\n").alias(alias)


def normalized(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """(id, title, url, start, end, place, district, fee, fee_free, kind, kind_state, status) of rows as they come.

    Rows without title or address are left out; texts have their bounds; an end before the start is unknown; a kind outside the
    vocabulary is the general one and pending; without a start a row is in review.
    """
    place = F.substring(clean(F.col("place")), 1, 250)
    fee = F.substring(clean(F.col("fee")), 1, 100)
    known = F.coalesce(F.col("kind").isin(kinds), F.lit(False))
    out = rows.select(
        "id",
        F.substring(clean(F.col("title")), 1, 220).alias("title"),
        canon_url(F.col("url")).alias("url"),
        "start",
        F.when(F.coalesce(F.col("end") >= F.col("start"), F.lit(True)), F.col("end")).alias("end"),
        place.alias("place"),
        district_of(place).alias("district"),
        F.when(fee == "", "费用未注明").otherwise(fee).alias("fee"),
        F.when(known, F.col("kind")).otherwise("Event").alias("kind"),
        F.when(known, "source").otherwise("pending").alias("kind_state"),
        F.when(F.col("start").isNull(), "needs_review").otherwise(F.coalesce("status", F.lit("scheduled"))).alias("status"),
    )
    return out.withColumn("fee_free", F.col("fee").isin(FREE)).where("title <> '' and url <> ''")


def same_canonical(rows: DataFrame) -> DataFrame:
    """(canonical, status, n, bindings) of items that lead to one address: cancelled wins, then a conflict or two starts mean review.

    Rows are (canonical, start, status, conflict, binding); bindings are told apart and sorted.
    """
    starts = F.count_distinct(F.coalesce(F.col("start").cast("string"), F.lit("")))
    status = F.when(F.max(F.col("status") == "cancelled"), "cancelled").when((starts > 1) | F.max(F.col("conflict")) | F.max(F.col("status") == "needs_review"), "needs_review").otherwise("scheduled")
    return rows.groupBy("canonical").agg(status.alias("status"), F.count("*").alias("n"), F.array_sort(F.collect_set("binding")).alias("bindings"))


def rotated(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (id, raw_id, url) with the newest address under which their item was found; others keep theirs."""
    newest = found.groupBy("raw_id").agg(F.max_by("new_url", F.struct("seen_at", "new_url")).alias("new_url"))
    return rows.join(newest, "raw_id", "left").select("id", F.coalesce("new_url", "url").alias("url"), F.col("new_url").isNotNull().alias("refreshed"))


def adjudicated(anchors: DataFrame, observations: DataFrame, done: DataFrame) -> DataFrame:
    """(observation_id, event_id, result) of retained observations when their anchor arrives, each pair once.

    Anchors are (source_id, alias, event_id, day), observations (observation_id, source_id, alias, day): equal days apply, others don't, an unknown
    one is refused; ``done`` holds the pairs that were decided before.
    """
    pairs = observations.join(anchors.select("source_id", "alias", "event_id", F.col("day").alias("anchor_day")), ["source_id", "alias"])
    result = F.when(F.col("day").isNull() | F.col("anchor_day").isNull(), "refused").when(F.col("day") == F.col("anchor_day"), "applicable").otherwise("not_applicable")
    return pairs.join(done.select("observation_id", "event_id").distinct(), ["observation_id", "event_id"], "left_anti").select("observation_id", "event_id", result.alias("result")).dropDuplicates(["observation_id", "event_id"])


def histories(new: DataFrame, stored: DataFrame) -> DataFrame:
    """(item, admitted, reasons): evidence against every binding of an item that is stored.

    Both are (item, alias, organizer, day), the new evidence also (old_day, new_day) of its notice.  Organizers must be equal, and a
    day that changed must be moved by a notice from the stored one to the new one.  An item is admitted if all its bindings agree.
    """
    s = stored.select("item", "alias", F.col("organizer").alias("was_organizer"), F.col("day").alias("was_day"))
    rows = new.join(s, ["item", "alias"], "left")
    moved = F.coalesce((F.col("old_day") == F.col("was_day")) & (F.col("new_day") == F.col("day")), F.lit(False))
    organizer = F.col("was_organizer").isNotNull() & ~F.col("was_organizer").eqNullSafe(F.col("organizer"))
    day = F.col("was_day").isNotNull() & ~F.col("was_day").eqNullSafe(F.col("day")) & ~moved
    reasons = F.array_compact(F.array(F.when(organizer, "organizer"), F.when(day, "day")))
    return rows.groupBy("item").agg(F.bool_and(F.size(reasons) == 0).alias("admitted"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(reasons)))), ",").alias("reasons"))

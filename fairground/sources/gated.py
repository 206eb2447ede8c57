"""Inventories and details that count only if they are shown to be what they claim.

The reader of a page takes out what stands where; every rule is a column expression with a name.  A rule is true, false, or null
where what it asks about isn't there, and all rules of a row are asked, so that a row carries every reason against it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairground.functions import grammar as G
from fairground.functions import text as X
from fairground.sources.elements import ENDED, Page, Where, absolute, attribute, read_pages

#: The paths, classes and words of these pages.
LIST_PATH, ITEM_PATH = "/event/", r"/(?:event|live)/\d+\.html"
PROMOTED = ["试用", "下载", "赠送", "抽奖", "有奖", "福利", "领取"]
ONLINE, OFFLINE = ["线上", "直播"], ["线下"]
BOTH = ["同步直播", "同步线上", "线上+线下", "线上线下同步"]
ONLINE_PLACE, OFFLINE_PLACE = "线上活动", "线下活动"
HOME = "深圳"
CAMPAIGN = "推广期"
MEETINGS, AFTERWARDS = ["技术交流活动", "研讨会", "线上活动"], ["回放", "资料下载", "开发板试用"]
REPLAYS = ["看回放", "观看回放"]
HOSTS, PLACES, STATE = ["主办方", "主办单位", "主办"], ["活动地点", "地点"], ["当前状态"]
AGENDA = r"(?:议题|专题|场次)[：:]\s*([^。；]+)"
POSTPONED = r"原定.*(?:改期|延期|调整)|(?:改期|延期|调整)至"
REDIRECTS, MOST_HOPS = [301, 302, 303, 307, 308], 5
ASIDE = (Where("aside"), Where("nav"), Where("footer"), Where(cls="related"), Where(cls="recommendations"))


def on_site(url: Column, host: str, path: str) -> Column:
    """Whether an address is https, of the host, without user, query or fragment, and of the path; null is not."""
    return F.coalesce(url.rlike(rf"^(?i:https://{re.escape(host)})(?::443)?{path}$"), F.lit(False))


def _of_item(href: Column, base: Column, host: str) -> Column:
    """The address of an item without query; empty if it isn't the site's."""
    return X.let(F.regexp_replace(absolute(href, base), r"[?#].*$", ""), lambda url: F.when(on_site(url, host, ITEM_PATH), url).otherwise(""))


def _has(c: Column, words: list[str]) -> Column:
    return c.rlike("|".join(map(re.escape, words)))


# --- inventories ---------------------------------------------------------------------------------------------


_ROOT, _CARD = Where("ul", "section-list-item-ul"), Where("li", "section-special-item")
_LINK, _BADGE = Where("a", "item-title", attr="href"), Where(cls="post-tag")
_FIELDS = {"c_label": (Where(cls="event-status"), Where(cls="status")), "c_summary": Where(cls="item-intro"), "c_place": Where(cls="event-location"), "c_time": Where(cls="event-time"), "c_organizer": Where(cls="event-organizer")}


def _inventory(page: Page) -> list[dict]:
    roots = [u for u in page.every(page.whole, _ROOT) if (up := page.parent(u)).get("tag") in ("div", "main") and "special-list" in up["classes"]]
    if len(roots) != 1:
        return [{"problem": "structure"}]
    root = roots[0]
    publisher = page.parent(root)["tag"] == "div"
    cards = [c for c in page.every(root, _CARD) if c["parent"] == root["pre"]]
    if not cards:
        told = page.first(page.whole, Where(attr="data-fixture-empty-state", value="true"))
        return [{"problem": "empty"}] if publisher or told is None else []
    out = []
    for n, card in enumerate(cards):
        link = page.first(card, _LINK)
        out.append({"pos": n, "publisher": publisher, "c_href": attribute(link, "href"), "c_title": page.text(link), "c_tags": " ".join([page.text(e) for e in page.every(card, _BADGE)]), **{name: page.text(page.first(card, of)) for name, of in _FIELDS.items()}})
    return out


def gated_inventory(pages: DataFrame, host: str) -> DataFrame:
    """(page_id, pos, title, link, summary, organizer, place, place_role, attendance, city, start, end, zone, role, status, notes, date_evidence, reject) of (page_id, url, html).

    A page counts only if its address is the site's list and it has exactly one list; else it is one row without pos, and
    ``reject`` says why.  Of its direct cards those without title or link, ended ones, promotions, and further cards of an
    address are kept with the reason.  Days of a campaign, or several days in a publisher's list, are when it is shown, not
    when it takes place.  Both ways of attending without a word of both at once are a conflict.  An empty list counts as such
    only where the page says so, and gives no row.
    """
    added = "pos int, problem string, publisher boolean, " + ", ".join(f"c_{c} string" for c in ("href", "title", "tags", "label", "summary", "place", "time", "organizer"))
    rows = read_pages(pages.select("page_id", "url", "html"), _inventory, added)
    c = {n: F.col(f"c_{n}") for n in ("href", "title", "tags", "label", "summary", "place", "time", "organizer")}
    rows = rows.withColumn("link", _of_item(c["href"], F.col("url"), host))
    bad = F.when(~on_site(F.col("url"), host, LIST_PATH), "origin").when(F.col("problem").isNotNull(), F.col("problem")).when((c["title"] == "") | (F.col("link") == ""), "title_or_link")
    bad = bad.when(F.concat(c["label"], c["tags"]).rlike(ENDED), "ended").when(_has(F.concat(c["tags"], c["title"]), PROMOTED), "promotion")
    rows = rows.withColumn("bad", bad)
    company = c["place"].rlike("^公司[：:]")
    rows = rows.withColumn("place", F.when(company, "").otherwise(F.regexp_replace(c["place"], r"^地点[：:]\s*", "")))
    online, offline = _has(c["tags"], ONLINE) | F.col("place").isin("线上", ONLINE_PLACE), _has(c["tags"], OFFLINE) | (F.col("place") == OFFLINE_PLACE)
    both = _has(F.concat(c["tags"], c["summary"]), BOTH)
    conflict = online & offline & ~both
    mode = F.when(conflict, "unknown").when(both, "hybrid").when(online, "online").when(offline, "offline").otherwise("unknown")
    shown = c["time"].contains(CAMPAIGN) | (F.col("publisher") & (F.size(G.date_parts(c["time"])) > 1))
    rows = rows.withColumn("attendance", mode).withColumn("conflict", conflict).withColumn("shown", shown)
    rows = rows.withColumn("span", F.when(~F.col("shown"), G.meeting_span(c["time"], F.col("attendance"), F.col("place"), exact=False)))
    unclear = F.col("span").isNull() | F.col("conflict") | (F.col("attendance") == "unknown")
    status = F.when(F.coalesce(G.state_of(c["label"]) == "cancelled", F.lit(False)), "cancelled").when(unclear, "needs_review").otherwise("scheduled")
    zone = F.coalesce(F.col("span.zone"), F.lit("unconfirmed"))
    notes = F.array_compact(F.array(
        F.when(F.col("shown"), "shown_not_held"), F.when(F.col("conflict"), "attendance_conflict"),
        F.when((F.col("attendance") == "online") & (zone == "unconfirmed") & c["time"].contains(":"), "clock_without_zone"),
    ))
    place = F.when(F.col("place") == ONLINE_PLACE, "线上").when(F.col("place") == OFFLINE_PLACE, "").otherwise(F.col("place"))
    city = F.when(F.col("attendance") == "online", "线上").when(F.col("place").contains(HOME), HOME).otherwise("")
    nth = F.row_number().over(Window.partitionBy("page_id", "link").orderBy(F.col("bad").isNotNull(), "pos"))
    organizer = F.regexp_replace(c["organizer"], r"^主办(?:方|单位)?[：:]\s*", "")
    card = F.col("pos").isNotNull()
    only = lambda value, name: F.when(card, value).alias(name)
    return rows.select(
        "page_id", "pos", only(c["title"], "title"), only(F.col("link"), "link"), only(c["summary"], "summary"), only(organizer, "organizer"), only(place, "place"), F.when(card & F.col("publisher"), F.when(company, "company").otherwise("venue_or_mode")).alias("place_role"),
        only(F.col("attendance"), "attendance"), only(city, "city"), F.col("span.start").alias("start"), F.col("span.end").alias("end"), only(zone, "zone"), only(F.when(F.col("shown"), "list_promotion_window").otherwise("list_meeting_time"), "role"),
        only(status, "status"), only(notes, "notes"), only(c["time"], "date_evidence"), F.coalesce("bad", F.when(card & (nth > 1), "repeated")).alias("reject"),
    )


# --- details -------------------------------------------------------------------------------------------------


def _chain(page: Page, *steps: Where) -> list[dict]:
    """Elements of the last step, each a direct child of one of the step before."""
    found = []
    for e in page.every(page.whole, steps[-1]):
        up = e
        for step in reversed(steps[:-1]):
            up = page.parent(up)
            if "tag" not in up or not step.of(up):
                break
        else:
            found.append(e)
    return found


def _without(page: Page, e: dict, dropped: list[dict]) -> str:
    """The text of an element without what stands in the dropped ones."""
    parts, at = [], e["begin"]
    for d in dropped:
        if at <= d["begin"] < e["end"]:
            parts += page.texts[at : d["begin"]]
            at = d["end"]
    return " ".join("".join([*parts, *page.texts[at : e["end"]]]).split())


def _body(page: Page, final: str | None) -> list[dict]:
    articles = {e["pre"]: e for e in [*page.every(page.whole, Where("main"), Where("article", "main-event")), *_chain(page, Where("body"), Where("article"))]}
    live = re.match(r"[^:]*://[^/]*/live/", final or "") is not None
    sections = _chain(page, Where("div", "section-body"), Where("div", "section-medium")) if live else []
    nothing = {"shape": None, "heads": [], "lines": [], "marks": [], "actions": [], "body": None}
    if len(articles) + len(sections) != 1:
        return [nothing]
    publisher = bool(sections)
    body = sections[0] if publisher else next(iter(articles.values()))
    if publisher:
        child = lambda e, cls: e["parent"] == body["pre"] and cls in e["classes"]
        heads = [h for h in page.every(body, Where("h1", "title")) if child(page.parent(h), "details-section-title")]
        contents = [e for e in page.every(body, Where("div", "article-content")) if child(e, "article-content")]
        if len(contents) != 1:
            return [nothing]
        body = contents[0]
    dropped = page.every(body, ASIDE)
    kept = lambda found: [e for e in found if not any(d["pre"] <= e["pre"] <= d["last"] for d in dropped)]
    if not publisher:
        heads = kept(page.every(body, Where("h1")))
    text = lambda e: _without(page, e, dropped)
    actions = _chain(page, Where("div", "live"), Where("div", "section-left"), Where("div", "section-action"), Where("div", "action-right"), Where("a", "sign-btn")) if publisher else []
    actions = [a for a in actions if "appt-button-trigger" in a["classes"]]
    return [{"shape": "publisher" if publisher else "article", "heads": [page.text(h) for h in heads], "lines": [text(e) for e in kept(page.every(body, (Where("p"), Where(cls="meeting-time"))))],
             "marks": [text(e) for e in kept(page.every(body, Where(cls="current-status")))], "actions": [page.text(a) for a in actions], "body": text(body)}]


def trace_fault(requested: Column, final: Column, trace: Column, host: str) -> Column:
    """Why a trace array<struct(url, status, location)> doesn't lead from one address of the site to the other; null if it does.

    Each hop must be of the address that the hop before named, every address an item of the site, the last one found there.
    """
    last = F.size(trace) - 1
    start = F.struct(F.lit(0).alias("n"), requested.alias("due"), F.lit(None).cast("string").alias("fault"))

    def step(state: Column, hop: Column) -> Column:
        end, location = state["n"] == last, F.coalesce(hop["location"], F.lit(""))
        here = F.when(~hop["url"].eqNullSafe(state["due"]) | ~on_site(state["due"], host, ITEM_PATH), "invalid")
        arrived = F.when(~F.coalesce(hop["status"] == 200, F.lit(False)) | ~state["due"].eqNullSafe(final), "incomplete")
        led = F.when(~F.coalesce(hop["status"].isin(REDIRECTS), F.lit(False)) | (location == ""), "invalid")
        next_due = F.when(end, state["due"]).when(location.rlike("[?#]"), "").otherwise(absolute(location, state["due"]))
        fault = lambda to: F.coalesce(state["fault"], here, F.when(end, arrived).otherwise(F.coalesce(led, F.when(~on_site(to, host, ITEM_PATH), "route"))))
        return X.let(next_due, lambda to: F.struct((state["n"] + 1).alias("n"), to.alias("due"), fault(to).alias("fault")))

    known = F.coalesce(F.size(trace).between(1, MOST_HOPS), F.lit(False)) & on_site(requested, host, ITEM_PATH) & on_site(final, host, ITEM_PATH)
    return F.when(~known, "incomplete").otherwise(F.aggregate(F.slice(trace, 1, MOST_HOPS), start, step)["fault"])


def _rules(host: str) -> dict[str, Column]:
    """What must be so for a detail to be its candidate's, by name; null where the page has nothing to ask about."""
    shaped = F.col("shape").isNotNull()
    ask = lambda rule: F.when(shaped, rule)
    apart = (F.size("list_days") > 0) & (F.size("body_days") > 0)
    same = lambda a, b: (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
    return {
        "trace": F.col("trace_fault").isNull(),
        "identity": shaped & (F.size("heads") == 1) & (F.size("actions") <= 1),
        "title": F.when(F.size("heads") == 1, F.col("seen_heading") == F.col("due_heading")),
        "replay": ask(~F.exists("actions", lambda a: a.isin(REPLAYS))),
        "semantics": ask(((F.size("times") > 0) | _has(F.col("body"), MEETINGS)) & ~_has(F.col("body"), AFTERWARDS)),
        "organizer": ask((F.col("due_host") == "") | F.forall("hosts", lambda h: h == F.col("due_host"))),
        "dates": ask(~apart | ((F.size("shared") > 0) & (F.col("shown") | same("list_days", "body_days")))),
        "years": ask(F.col("shown") | (F.size("list_years") == 0) | (F.size("body_years") == 0) | same("list_years", "body_years")),
        "corroboration": ask((F.size("shared") > 0) | F.col("agenda_match")),
    }


def gated_details(candidates: DataFrame, captures: DataFrame, host: str) -> DataFrame:
    """(id, capture_id, verdict, failures, undecided, trace_fault, evidence, patch): each capture of each candidate, judged.

    candidates: (id, url, title, organizer, place, summary, attendance, date_evidence, role) of an inventory; captures: (capture_id,
    id, final, html, trace).  ``failures`` are the rules that are false and ``undecided`` those that could not be asked; a verdict is
    "admitted" only without either, else "rejected" or "undecided".  A page's times may confirm the day of a campaign, never its
    length.  A capture of no candidate gives no row.  ``evidence`` and ``patch`` are null unless admitted.
    """
    read = read_pages(captures.select("capture_id", "id", "final", "trace", "html"), _body, "shape string, heads array<string>, lines array<string>, marks array<string>, actions array<string>, body string", "final")
    c = candidates.select("id", "url", "title", F.coalesce("organizer", F.lit("")).alias("organizer"), "place", F.coalesce("summary", F.lit("")).alias("summary"), "attendance", F.coalesce("date_evidence", F.lit("")).alias("raw"), F.coalesce("role", F.lit("")).alias("role"))
    rows = read.join(c, "id")
    rows = rows.withColumn("shown", F.col("raw").contains(CAMPAIGN) | (F.col("role") == "list_promotion_window"))
    rows = rows.withColumn("times", F.array_distinct(F.filter("lines", lambda v: v.rlike(f"^(?:{'|'.join(G.ACTUAL_LABELS)})[：:]"))))
    text = F.array_join("lines", "\n")
    rows = rows.withColumn("named", G.labeled(text, HOSTS)).withColumn("places", G.labeled(text, PLACES)).withColumn("hosts_text", X.nfc(F.array_join("named", "\n")))
    rows = rows.withColumn("hosts", F.filter(F.split("hosts_text", "\n"), lambda v: v != "")).withColumn("due_host", X.heading(F.col("organizer")))
    rows = rows.withColumn("seen_heading", X.heading(F.get("heads", F.lit(0)))).withColumn("due_heading", X.heading(F.col("title")))
    all_times = F.array_join("times", "\n")
    rows = rows.withColumn("list_days", F.array_distinct(G.date_parts(F.col("raw")))).withColumn("body_days", F.array_distinct(G.date_parts(all_times)))
    rows = rows.withColumn("shared", F.array_sort(F.array_intersect("list_days", "body_days"))).withColumn("list_years", G.named_years(F.col("raw"))).withColumn("body_years", G.named_years(all_times))
    topics = F.regexp_extract_all("summary", F.lit(AGENDA), F.lit(1))
    rows = rows.withColumn("agenda_match", (F.col("organizer") != "") & (F.size("named") > 0) & F.exists(topics, lambda v: F.contains(F.coalesce("body", F.lit("")), v)))
    rows = rows.withColumn("trace_fault", trace_fault(F.col("url"), F.col("final"), F.col("trace"), host))
    rules = _rules(host)
    picked = lambda wanted: F.array_compact(F.array(*(F.when(wanted(rule), name) for name, rule in rules.items())))
    rows = rows.withColumn("failures", picked(lambda r: ~r)).withColumn("undecided", picked(lambda r: r.isNull()))
    rows = rows.withColumn("verdict", F.when(F.size("failures") > 0, "rejected").when(F.size("undecided") > 0, "undecided").otherwise("admitted"))
    where = F.when(F.size("places") == 1, F.col("places")[0]).otherwise(F.coalesce("place", F.lit("")))
    rows = rows.withColumn("where", where).withColumn("said", F.concat(G.labeled(text, STATE), "marks"))
    rows = rows.withColumn("spans", F.array_distinct(F.array_compact(F.transform("times", lambda t: G.meeting_span(t, F.col("attendance"), F.col("where"))))))
    says = lambda v, state: F.coalesce(G.state_of(v) == state, F.lit(False))
    off, again = F.exists("said", lambda v: says(v, "cancelled")), (F.size("said") > 0) & F.forall("said", lambda v: says(v, "reinstated"))
    one = F.when(F.size("spans") == 1, F.col("spans")[0])
    patch = F.struct(
        F.col("final").alias("url"), F.when(F.size("named") == 1, F.col("named")[0]).alias("organizer"), F.when(F.size("places") > 0, F.col("where")).alias("place"), one["start"].alias("start"), one["end"].alias("end"), one["all_day"].alias("all_day"), one["zone"].alias("zone"),
        (F.size("spans") > 1).alias("time_conflict"), F.when(off, "cancelled").when(F.size("spans") > 1, "needs_review").alias("status"), (~off & again).alias("reinstated"), F.col("times").alias("time_evidence"),
    )
    evidence = F.struct(
        F.col("heads")[0].alias("title"), F.col("shared").alias("shared_days"), "agenda_match", F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["start"].cast("date")))).alias("occurrence_days"), F.col("named").alias("organizers"),
        F.filter("lines", lambda v: v.rlike(POSTPONED)).alias("postponed"), F.sha2("body", 256).alias("body_digest"), F.col("said").alias("states"),
    )
    admitted = F.col("verdict") == "admitted"
    return rows.select("id", "capture_id", "verdict", "failures", "undecided", "trace_fault", F.when(admitted, evidence).alias("evidence"), F.when(admitted, patch).alias("patch"))


def merge_admitted(base: DataFrame, judged: DataFrame) -> DataFrame:
    """``base`` with the patch of each row's last admitted capture; other rows, and columns that no patch names, stay.

    base: (id, url, organizer, place, start, end, all_day, status, attendance, time_evidence, hold, attendance_conflict, time_conflict, notes, ...).
    Times are appended to the evidence, each once.  Another day, or other clocks where clocks were known, is a conflict, and the
    old time stays; a time that is taken replaces the note that only a campaign was known.  Cancelled wins, whoever says so; else
    a row without a time, without a way to attend, held or in conflict needs review.  A hold and the way to attend are never patched.
    """
    # The verdict stands in the aggregate: as a filter it would be moved down and all rules worked out a second time.
    patches = judged.groupBy("id").agg(F.max_by("patch", F.when(F.col("verdict") == "admitted", F.col("capture_id"))).alias("p"))
    rows = base.join(patches, "id", "left")
    p, none = (lambda n: F.col(f"p.{n}")), F.lit(False)
    yes = lambda c: F.coalesce(c, none)
    timed = ~yes(F.col("all_day")) & (~F.col("start").eqNullSafe(p("start")) | ~F.col("end").eqNullSafe(p("end")))
    differs = F.col("start").isNotNull() & (yes(F.col("start").cast("date") != p("start").cast("date")) | timed)
    conflict = yes(F.col("time_conflict")) | yes(p("time_conflict")) | (p("start").isNotNull() & differs)
    taken = p("start").isNotNull() & ~differs & ~yes(p("time_conflict"))
    rows = rows.withColumn("taken", taken).withColumn("conflict", conflict).withColumn("patched", F.col("p").isNotNull())
    new = {n: F.when(F.col("taken"), p(n)).otherwise(F.col(n)) for n in ("start", "end", "all_day")}
    review = new["start"].isNull() | F.coalesce(F.col("attendance") == "unknown", F.lit(True)) | yes(F.col("hold")) | yes(F.col("attendance_conflict")) | F.col("conflict") | yes(p("status") == "needs_review")
    status = F.when(yes(F.col("status") == "cancelled") | yes(p("status") == "cancelled"), "cancelled").when(review, "needs_review").otherwise("scheduled")
    old, seen = (F.coalesce(c, F.array().cast("array<string>")) for c in (F.col("time_evidence"), p("time_evidence")))
    notes = F.transform("notes", lambda n: F.when(F.col("taken") & (n == "shown_not_held"), "held_as_detailed").otherwise(n))
    kept = lambda n: F.coalesce(F.when(p(n) != "", p(n)), F.col(n))
    made = {**{n: kept(n) for n in ("url", "organizer", "place")}, **new, "time_evidence": F.concat(old, F.array_except(seen, old)), "notes": notes, "time_conflict": F.col("conflict")}
    final = {**{n: F.when(F.col("patched"), v).otherwise(F.col(n)) for n, v in made.items()}, "status": F.when(F.col("patched"), status).otherwise(F.col("status"))}
    return rows.select(*(final[n].alias(n) if n in final else F.col(f"`{n}`") for n in base.columns))

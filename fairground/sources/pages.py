"""Records from captured pages: JSON-LD activities and feed entries."""

from __future__ import annotations

import json
import re
from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairground.functions.text import canon_url, clean

#: Fixed values.
EVENT_TYPES = ["Event", "BusinessEvent", "ChildrensEvent", "ComedyEvent", "ConferenceEvent", "CourseInstance", "DanceEvent", "DeliveryEvent", "EducationEvent", "ExhibitionEvent", "Festival", "FoodEvent", "Hackathon", "LiteraryEvent", "MusicEvent", "PerformingArtsEvent", "PublicationEvent", "SaleEvent", "ScreeningEvent", "SocialEvent", "SportsEvent", "TheaterEvent", "VisualArtsEvent"]
_SCRIPT = re.compile(r"<script[^>]*application/ld\+json[^>]*>(.*?)</script>", re.S | re.I)


def _nodes(value):
    """The objects of a JSON value at any depth, in order."""
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            yield x
            x = list(x.values())
        if isinstance(x, list):
            todo += reversed(x)


def _type(node: dict) -> str | None:
    kinds = node.get("@type")
    names = [str(k).rstrip("/").rpartition("/")[2] for k in (kinds if isinstance(kinds, list) else [kinds])]
    known = [n for n in names if n in EVENT_TYPES]
    return next((n for n in known if n != "Event"), known[0] if known else None)


def _prices(offers) -> str | None:
    found = set()
    for node in _nodes(offers):
        for key in ("price", "lowPrice", "highPrice"):
            value = node.get(key)
            if value is not None and not isinstance(value, bool):
                try:
                    amount = Decimal(str(value))
                except InvalidOperation:
                    continue
                if amount.is_finite() and amount >= 0:
                    found.add(amount)
    return " / ".join("免费" if p == 0 else f"{p:f}" for p in sorted(found)) or None


#: What the last part of an attendance mode's address means.  Fixed values.
MODES = {"OnlineEventAttendanceMode": "online", "OfflineEventAttendanceMode": "offline", "MixedEventAttendanceMode": "hybrid"}


def _tail(value) -> str:
    return value.rstrip("/").rpartition("/")[2] if isinstance(value, str) else ""


def _words(value) -> str:
    """A text, or the texts of an address in order, each once."""
    if isinstance(value, list):
        return " ".join(dict.fromkeys(w for v in value if (w := _words(v))))
    if isinstance(value, dict):
        return " ".join(dict.fromkeys(w for k in ("name", "addressLocality", "addressRegion", "streetAddress", "address") if (w := _words(value.get(k)))))
    return " ".join(value.split()) if isinstance(value, str) else ""


def _names(value) -> str:
    people = value if isinstance(value, list) else [value]
    return " / ".join(dict.fromkeys(n for p in people if (n := _words(p.get("name") if isinstance(p, dict) else p))))


def _fee(node: dict) -> str | None:
    """Prices; without any, whether it is free to enter is what counts."""
    return _prices(node.get("offers")) or ("免费" if node.get("isAccessibleForFree") in (True, "true", "True") else None)


def json_ld_events(pages: DataFrame) -> DataFrame:
    """(url, event_type, title, start_at, end_at, all_day, location, city, organizer, attendance, status, cost_text) of every activity that a page declares.

    ``location`` is the name and address of its places, ``city`` their locality; an activity is cancelled if its status says so.
    Scripts that are not JSON, and nodes without a known type or a name, give nothing.  The walk has no bound of depth,
    which column expressions cannot state.
    """

    def extract(frames):
        for frame in frames:
            out = []
            for url, page in zip(frame["url"], frame["html"], strict=True):
                for script in _SCRIPT.findall(page or ""):
                    try:
                        value = json.loads(script)
                    except ValueError:
                        continue
                    for node in _nodes(value):
                        if (kind := _type(node)) and node.get("name"):
                            place = node.get("location")
                            city = next((w for n in _nodes(place) if (w := _words(n.get("addressLocality")))), None)
                            start, end = (node.get(k) if isinstance(node.get(k), str) else None for k in ("startDate", "endDate"))
                            status = "cancelled" if _tail(node.get("eventStatus")) == "EventCancelled" else "scheduled"
                            out.append((url, kind, str(node["name"]), start, end, bool(start) and len(start) == 10, _words(place), city, _names(node.get("organizer")), MODES.get(_tail(node.get("eventAttendanceMode")), "unknown"), status, _fee(node)))
            yield pd.DataFrame(out, columns=columns)

    columns = ["url", "event_type", "title", "start_at", "end_at", "all_day", "location", "city", "organizer", "attendance", "status", "cost_text"]
    kinds = ", ".join(f"{c} {'boolean' if c == 'all_day' else 'string'}" for c in columns)
    found = pages.select("url", "html").mapInPandas(extract, kinds)
    return found.withColumn("title", clean(F.col("title"))).where("title <> ''")


def feed_entries(feeds: DataFrame) -> DataFrame:
    """(source_id, title, link, published) of the items of captured RSS and the entries of Atom; those without a title are left out.

    The time of publication is kept apart: it is never the time of an activity.  An entry's link is the first that is no other
    relation than its page.
    """
    item = F.explode(F.regexp_extract_all("body", F.lit(r"(?s)<(?:item|entry)\b[^>]*>(.*?)</(?:item|entry)>"), F.lit(1)))
    inner = lambda tag: clean(F.regexp_extract("item", rf"(?s)<{tag}\b[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{tag}>", 1))
    links = F.filter(F.regexp_extract_all("item", F.lit(r"<link\b[^>]*/?>"), F.lit(0)), lambda t: t.contains("href=") & (~t.contains("rel=") | t.rlike("rel=[\"']?alternate")))
    href = F.regexp_extract(F.coalesce(F.get(links, F.lit(0)), F.lit("")), "href=[\"']?([^\"'> ]*)", 1)
    rows = feeds.select("source_id", item.alias("item"))
    published = F.coalesce(*(F.when(inner(t) != "", inner(t)) for t in ("pubDate", "published", "updated")), F.lit(""))
    link = canon_url(F.replace(F.when(href != "", href).otherwise(inner("link")), F.lit("&amp;"), F.lit("&")))
    return rows.select("source_id", inner("title").alias("title"), link.alias("link"), published.alias("published")).where("title <> ''")

"""Single announcements, and rows of developers' activities."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairground.functions import grammar as G
from fairground.functions import text as X
from fairground.sources.elements import Page, Where, read_pages

#: The modes that a row may declare, and the topics of the categories that its description names.
DECLARED = {"https://schema.org/OnlineEventAttendanceMode": "online", "https://schema.org/MixedEventAttendanceMode": "hybrid"}
CATEGORIES = {
    "硬件创客": ["hardware / iot"],
    "AI与开源": ["artificial intelligence (ai)", "machine learning (ml)", "open source"],
    "产品与创业": ["product management", "business analysis", "cio"],
    "学习成长": ["tech leadership"],
    "软件开发": ["api", "cloud", "devops", "java", "javascript", "docker / kubernetes", "microsoft", "testing / qa", "rust", "sap", "cybersecurity / infosec", "wordpress", "software architecture", "aws", "azure", "data / database", "elixir", "flutter", "full-stack", "python", "mobile", "php", "game dev"],
}
HELD_FROM, HELD_AT = "将于", "日在"


def announcements(pages: DataFrame, name: str, known_as: str, place: str) -> DataFrame:
    """(page_id, title, edition_year, start, end, place, evidence) of (page_id, html): the first sentence that gives an edition of ``name``,
    ``known_as`` in brackets, its days and its place; pages without one give nothing.

    The text is cut where it says "to be held from": what stands before must end with the edition, what stands behind must begin
    with days that exist and go on with the place.
    """
    rows = read_pages(pages.select("page_id", "html"), lambda page: [{"text": page.text(page.whole)}], "text string")
    parts = F.split(F.col("text"), HELD_FROM)

    def read(before: Column, after: Column) -> Column:
        bare = F.regexp_replace(before, rf"[（(]\Q{known_as}\E[）)]$", "")
        title = F.when(bare != before, F.regexp_extract(bare, rf"第[零一二三四五六七八九十百]+届\Q{name}\E$", 0))
        days, rest = F.substring_index(after, HELD_AT, 1), F.substring(after, F.instr(after, HELD_AT) + 2, len(place) + 2)
        numbers = F.regexp_extract_all(F.regexp_extract(days, r"^20\d{2}年\d{1,2}月\d{1,2}[-—–~至]\d{1,2}$", 0), F.lit(r"\d+"), F.lit(0))
        span = X.let(X.let(numbers, lambda n: F.struct(*(G.day(*(F.get(n, F.lit(k)) for k in (0, 1, day))).alias(name) for name, day in (("start", 2), ("last", 3))))), lambda d: F.when(d["last"] >= d["start"], F.struct(d["start"].alias("start"), F.date_add(d["last"], 1).alias("end"))))
        return F.when((title != "") & (rest == place + "举办"), F.struct(title.alias("title"), F.substring(days, 1, 4).alias("year"), span.alias("span"), F.concat(title, F.right(before, F.lit(len(known_as) + 2)), F.lit(HELD_FROM), days, F.lit(HELD_AT), rest).alias("evidence")))

    found = F.filter(F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p, k: read(p, F.get(parts, k + 1))), lambda r: r["span"].isNotNull())
    rows = rows.select("page_id", F.get(found, F.lit(0)).alias("r")).where("r is not null")
    return rows.select("page_id", F.concat("r.title", F.lit("（"), "r.year", F.lit("）")).alias("title"), F.col("r.year").cast("int").alias("edition_year"), F.col("r.span.start").alias("start"), F.col("r.span.end").alias("end"), F.lit(place).alias("place"), F.col("r.evidence").alias("evidence"))


def _declared(page: Page) -> list[dict]:
    rows = [r for r in page.every(page.whole, Where(cls="row")) if "featured" not in r["classes"]]
    out, seen, texts = [], set(), lambda v: v if isinstance(v, str) else ""
    for script in (s for r in rows for s in page.every(r, Where("script", attr="type", value="application/ld+json"))):
        if script["pre"] in seen:
            continue
        seen.add(script["pre"])
        try:
            d = json.loads("".join(script.get("script", [])))
        except ValueError:
            continue
        if isinstance(d, dict):
            place = d.get("location")
            out.append({"at": script["pre"], "c_mode": texts(d.get("eventAttendanceMode")), "c_title": texts(d.get("name")), "c_href": texts(d.get("url")), "c_first": texts(d.get("startDate")), "c_last": texts(d.get("endDate")) or texts(d.get("startDate")),
                        "c_text": texts(d.get("description")), "c_place": texts(place.get("name")) if isinstance(place, dict) else "", "c_label": page.text(page.first(page.parent(script), Where("time")))})
    return sorted(out, key=lambda r: r["at"])


def developer_rows(pages: DataFrame) -> DataFrame:
    """(page_id, pos, title, link, start, end, kind, place, city, attendance, category, topics, label) of (page_id, html): rows that declare an activity had online.

    Featured rows are advertisements, unless they stand in a plain row too.  A row without an online or mixed mode, title, link, or a first day not after the last, and
    one that is no JSON object, gives nothing.  Days are whole, the end exclusive.  The topics are those of the category that a
    description of the one known form names; other prose names none.
    """
    added = "at int, " + ", ".join(f"c_{c} string" for c in ("mode", "title", "href", "first", "last", "text", "place", "label"))
    rows = read_pages(pages.select("page_id", "html"), _declared, added)
    day = lambda c: F.when(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(c, 1, 10).try_cast("date"))
    mode = F.coalesce(*(F.when(F.col("c_mode") == url, name) for url, name in DECLARED.items()))
    named = G.course_or_conference(F.col("c_text"))
    rows = rows.select("page_id", "at", "c_label", mode.alias("attendance"), X.clean(F.col("c_title")).alias("title"), X.canon_url(F.col("c_href")).alias("link"), day("c_first").alias("start"), day("c_last").alias("last"), X.clean(F.col("c_place")).alias("venue"), named.alias("named"))
    rows = rows.where("attendance is not null and title <> '' and link <> '' and start <= last")
    at = F.when(F.col("attendance") == "online", "线上").otherwise(F.col("venue"))
    category = F.lower("named.label")
    topics = F.array_compact(F.array(*(F.when(category.isin(labels), topic) for topic, labels in CATEGORIES.items())))
    return rows.select("page_id", F.col("at").alias("pos"), "title", "link", "start", F.date_add("last", 1).alias("end"), F.col("named.kind").alias("kind"), at.alias("place"), at.alias("city"), "attendance", F.col("named.label").alias("category"), topics.alias("topics"), F.col("c_label").alias("label"))

"""Records from captured pages, by a table of patterns a kind, in column expressions and windows over a page's lines.

A page is split once, in place; nothing is shuffled but the lines of block and table pages, by their page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairground.functions import grammar as G
from fairground.functions.text import canon_url, clean, norm

#: Patterns of a kind of listing: a card, and in it the title, link, date and place.  A new kind is a new line.
KINDS = {
    "cards": {"card": r'(?s)<div class="card">(.*?)</div>', "title": r"<h3>(.*?)</h3>", "link": r'href="([^"]*)"', "date": r"<time>(.*?)</time>", "place": r'<span class="place">(.*?)</span>'},
    "list": {"card": r"(?s)<li>(.*?)</li>", "title": r"<a [^>]*>(.*?)</a>", "link": r'<a href="([^"]*)"', "date": r"<em>(.*?)</em>", "place": r"<i>(.*?)</i>"},
    "rows": {"card": r"(?s)<tr([^>]*>.*?)</tr>", "title": r"(?s)<td>(.*?)</td>", "link": r'data-url="([^"]*)"', "date": r"(?s)<td>.*?</td>\s*<td>(.*?)</td>", "place": r"(?s)<td>.*?</td>\s*<td>.*?</td>\s*<td>(.*?)</td>"},
}
#: What an image that is no picture of the activity is called.
NO_PICTURE = "(?i)qr|二维码|公众号|logo|头像"
IMAGES = 8
#: An embedded inventory of more is none.
ITEMS = 300


def plain(c: Column) -> Column:
    """Markup taken out, the common references decoded, white space collapsed."""
    c = F.regexp_replace(c, "<[^>]*>", "")
    for reference, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(reference), F.lit(mark))
    return clean(c)


def _by_kind(make) -> Column:
    return F.coalesce(*(F.when(F.col("kind") == kind, make(rules)) for kind, rules in KINDS.items()))


def listing_cards(pages: DataFrame) -> DataFrame:
    """(page_id, pos, title, link, start, end, place, reject) of every card of (page_id, kind, html, year).

    A card without title, link or date is kept with the reason it is rejected for, so that seen, taken and rejected add up;
    so is a second card of one link.  A page of an unknown kind, and a null page, has no cards.
    """
    cards = pages.select("page_id", "kind", "year", F.posexplode(_by_kind(lambda r: F.regexp_extract_all("html", F.lit(r["card"]), F.lit(1)))).alias("pos", "card"))
    part = lambda name: _by_kind(lambda r: F.regexp_extract("card", r[name], 1))
    rows = cards.select("page_id", "pos", plain(part("title")).alias("title"), canon_url(part("link")).alias("link"), G.explicit_range(plain(part("date")), F.col("year")).alias("range"), plain(part("place")).alias("place"))
    # A card with a date comes before one of its address without.
    again = F.row_number().over(Window.partitionBy("page_id", "link").orderBy(F.col("title") == "", F.col("range").isNull(), "pos")) > 1
    reject = F.when(F.col("title") == "", "title").when(F.col("link") == "", "link").when(F.col("range").isNull(), "date").when(again, "repeated")
    return rows.select("page_id", "pos", "title", "link", F.col("range.start").alias("start"), F.col("range.end").alias("end"), "place", reject.alias("reject"))


def blocks(pages: DataFrame) -> DataFrame:
    """(page_id, block, title, venue, organizer, start, end, record_id) of (page_id, year, body), one row a title.

    A line of one or two digits begins a block; the names come before the line of the venue; a name without Chinese
    characters is an alias of the name before it.  Blocks without venue, names or a date give nothing.
    """
    line = Window.partitionBy("page_id").orderBy("pos")
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    lines = pages.select("page_id", "year", F.posexplode(F.split("body", "\n")).alias("pos", "raw")).withColumn("line", clean(F.col("raw")))
    lines = lines.withColumn("block", F.sum(F.col("line").rlike(r"^\d{1,2}$").cast("int")).over(so_far)).where(~F.col("line").rlike(r"^\d{1,2}$") & (F.col("line") != ""))
    inside = Window.partitionBy("page_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("fields", F.max(F.col("line").rlike(r"^场\s*馆\s*[：:]").cast("int")).over(inside) == 1)
    at = lambda label: F.when(F.col("line").rlike(rf"^{label}\s*[：:]"), F.col("pos"))
    value = lambda label: F.min_by(F.regexp_replace("line", rf"^{label}\s*[：:]\s*", ""), at(label))
    name = ~F.col("fields") & ~F.col("line").rlike(r"^[—*]")
    found = lines.groupBy("page_id", "year", "block").agg(
        F.array_sort(F.collect_list(F.when(name, F.struct("pos", "line")))).alias("names"),
        value(r"场\s*馆").alias("venue"), value("开展时间").alias("when"), value("主/承办单位").alias("organizer"),
    )
    joined = F.aggregate("names", F.array().cast("array<string>"), lambda done, n: F.when((F.size(done) == 0) | n["line"].rlike("[\u3400-\u9fff]"), F.array_append(done, n["line"])).otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), F.lit(" / "), n["line"])))))
    # Conditions in the explode, not in a filter, which would read each date twice.
    rows = found.withColumn("range", G.explicit_range(F.col("when"), F.col("year"))).select("*", F.explode(F.when(F.col("venue").isNotNull() & F.col("range").isNotNull(), joined)).alias("title")).where("length(title) > 1")
    key = F.substring(F.sha2(F.concat_ws("|", "title", F.col("range.start").cast("string"), "venue"), 256), 1, 20)
    return rows.select("page_id", "block", "title", "venue", F.coalesce("organizer", F.lit("")).alias("organizer"), F.col("range.start").alias("start"), F.col("range.end").alias("end"), key.alias("record_id"))


def schedule_rows(pages: DataFrame) -> DataFrame:
    """(page_id, pos, title, start, end, organizer) of the table rows of (page_id, html).

    A row of one cell "YYYY年M月" is the heading of those after it; a row of four cells that begins with a number is an
    activity, if its first date is in the month of the heading.  A last day before the first is in the next year.
    """
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?s)<tr>(.*?)</tr>"), F.lit(1))).alias("pos", "row"))
    rows = rows.select("page_id", "pos", F.transform(F.regexp_extract_all("row", F.lit("(?s)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), plain).alias("cells"))
    heading = F.regexp_extract(F.get("cells", F.lit(0)), r"^(20\d{2})年\s*(\d{1,2})月$", 0)
    carried = F.last(F.when((F.size("cells") == 1) & (heading != ""), heading), ignorenulls=True).over(Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("heading", carried).where((F.size("cells") == 4) & F.get("cells", F.lit(0)).rlike(r"^\d+$"))
    number = lambda c, pattern, k: F.regexp_extract(c, pattern, k).try_cast("int")
    year, month = (number(F.col("heading"), r"(\d+)年\s*(\d+)月", k) for k in (1, 2))
    dates = r"(\d{1,2})月\s*(\d{1,2})日.*?(\d{1,2})月\s*(\d{1,2})日"
    m, d, em, ed = (number(F.col("cells")[2], dates, k) for k in (1, 2, 3, 4))
    later = ((em < m) | ((em == m) & (ed < d))).cast("int")
    out = rows.select("page_id", "pos", F.col("cells")[1].alias("title"), F.when(m == month, G.day(year, m, d)).alias("start"), F.date_add(G.day(year + later, em, ed), 1).alias("end"), F.substring(F.col("cells")[3], 1, 200).alias("organizer"))
    return out.where("title <> '' and start is not null and end is not null")


def posts(feeds: DataFrame) -> DataFrame:
    """(source_id, link, title, start, end, place, organizer, fee, published, reject) of the posts of (source_id, body).

    A post that needs a password, or has no title or link, is rejected with its reason.  The year of a date without one is
    that of publication, and such a date must lie between 45 days before and 120 days after it.  With several dates, the
    first one counts if it holds the others.  A body that is no list of posts gives nothing.
    """
    schema = "array<struct<title: struct<rendered: string>, link: string, date: string, content: struct<rendered: string, protected: boolean>>>"
    rows = feeds.select("source_id", F.explode(F.from_json("body", schema)).alias("p"))
    lines = F.regexp_replace(F.regexp_replace("p.content.rendered", "(?is)<(script|style|iframe)[^>]*>.*?</\\1>", ""), "(?i)</?(?:p|br|div|li)[^>]*>", "\n")
    rows = rows.select("source_id", plain(F.col("p.title.rendered")).alias("title"), canon_url(F.col("p.link")).alias("link"), F.substring("p.date", 1, 10).try_cast("date").alias("published"), F.coalesce("p.content.protected", F.lit(False)).alias("protected"), F.regexp_replace(lines, "<[^>]*>", "").alias("text"))
    rows = rows.withColumn("times", G.labeled(F.col("text"), ["活动时间", "演出时间", "展览时间"])).withColumn("ranges", F.transform("times", lambda t: G.explicit_range(t, F.year("published"))))
    first = F.get("ranges", F.lit(0))
    holds = F.forall("ranges", lambda r: r.isNotNull() & (r["start"] >= first["start"]) & (r["end"] <= first["end"]))
    listed = (F.size("times") > 1) & F.col("title").rlike("汇总|盘点|合集|大全|一览")
    stated = F.get("times", F.lit(0)).rlike(r"20\d{2}")
    likely = stated | F.datediff(first["start"], "published").between(-45, 120)
    time = F.when(holds & ~listed & F.coalesce(likely, F.lit(False)), first)
    place, organizer, fee = (G.labeled(F.col("text"), labels) for labels in (["活动地点", "演出地点", "展览地点"], ["主办单位", "主办方"], ["活动费用", "票价"]))
    cost = F.when(F.size(fee) == 1, F.when(fee[0].rlike(r"^(?:公益)?免费(?:[，,。！!\s]|$)"), "免费").when(fee[0].rlike(r"\d\s*元|[￥¥]\s*\d"), F.substring(fee[0], 1, 100)))
    reject = F.when(F.col("protected"), "protected").when((F.col("title") == "") | (F.col("link") == ""), "title or link")
    return rows.select("source_id", "link", "title", time["start"].alias("start"), time["end"].alias("end"), F.coalesce(F.get(place, F.lit(0)), F.lit("")).alias("place"), F.when(F.size(organizer) == 1, organizer[0]).otherwise("").alias("organizer"), F.coalesce(cost, F.lit("")).alias("fee"), "published", reject.alias("reject"))


def inventory(pages: DataFrame, schema: str) -> DataFrame:
    """(page_id, error, and one column ``item``) of the one JSON.parse(`...`) literal of (page_id, html), a row an item.

    No literal or several, one with escapes or interpolation, one that is not a list of the schema, that repeats a key or has more
    than ``ITEMS`` items is an error row.
    """
    literals = F.regexp_extract_all("html", F.lit(r"(?s)JSON\.parse\(`(.*?)`\)"), F.lit(1))
    rows = pages.select("page_id", literals.alias("l")).withColumn("literal", F.get("l", F.lit(0)))
    items = F.from_json("literal", f"array<struct<{schema}>>")
    error = F.when(F.coalesce(F.size("l"), F.lit(0)) != 1, "not one literal").when(F.col("literal").rlike(r"\\|\$\{"), "escapes").when(F.col("items").isNull() | F.exists("items", lambda x: x.isNull()), "not a list").when(F.try_parse_json("literal").isNull(), "repeated key").when(F.size("items") > ITEMS, "too many")
    rows = rows.withColumn("items", items).withColumn("error", error)
    return rows.select("page_id", "error", F.explode_outer(F.when(F.col("error").isNull(), F.col("items"))).alias("item"))


def recaps(rows: DataFrame) -> DataFrame:
    """(link, title, recaps, status) of announcements of (link, title, start, end, address), with the recaps that are theirs.

    X-review.html is the recap of X.html if start and address are equal; another end puts the announcement in review.
    Recaps give no rows of their own, and of announcements with one link the one of smallest title counts.
    """
    rows = rows.withColumn("recap", F.col("link").endswith("-review.html"))
    own = rows.where("not recap").groupBy("link").agg(F.min(F.struct("title", "start", "end", "address")).alias("r")).select("link", "r.*")
    told = rows.where("recap and start is not null").select(F.regexp_replace("link", r"-review\.html$", ".html").alias("link"), "start", norm(F.col("address")).alias("place"), F.col("end").alias("told_end"), F.lit(True).alias("told")).where("place <> ''")
    pairs = own.withColumn("place", norm(F.col("address"))).join(told, ["link", "start", "place"], "left")
    return pairs.groupBy("link", "title").agg(F.count("told").alias("recaps"), F.when(F.max(F.col("told") & ~F.col("told_end").eqNullSafe(F.col("end"))), "needs_review").otherwise("scheduled").alias("status"))


def month_links(pages: DataFrame, now: Column) -> DataFrame:
    """(page_id, link, pos) of links whose label names a month from one before now to six after it, each once."""
    pattern = F.lit('<a href="([^"]*)"[^>]*>([^<]*)</a>')
    links = F.arrays_zip(F.regexp_extract_all("html", pattern, F.lit(1)).alias("link"), F.regexp_extract_all("html", pattern, F.lit(2)).alias("label"))
    rows = pages.select("page_id", F.posexplode(links).alias("pos", "a")).select("page_id", "pos", "a.link", *(F.regexp_extract("a.label", r"(20\d{2})年(\d{1,2})月", k).try_cast("int").alias(c) for k, c in ((1, "year"), (2, "month"))))
    ahead = F.col("year") * 12 + F.col("month") - F.year(now) * 12 - F.month(now)
    return rows.where(ahead.between(-1, 6)).groupBy("page_id", "link").agg(F.min("pos").cast("long").alias("pos"))


def images(html: Column) -> Column:
    """Up to eight addresses of pictures: those of the page's head, then those of its body; codes, logos and hosts that are not public are left out."""
    head = F.regexp_extract_all(html, F.lit(r'<meta property="og:image" content="([^"]*)"'), F.lit(1))
    tags = F.filter(F.regexp_extract_all(html, F.lit("<img [^>]*>"), F.lit(0)), lambda t: ~F.regexp_extract(t, 'alt="([^"]*)"', 1).rlike(NO_PICTURE))
    source = lambda t: F.when(t.contains("data-src="), F.regexp_extract(t, 'data-src="([^"]*)"', 1)).otherwise(F.regexp_extract(t, r'\ssrc="([^"]*)"', 1))
    public = lambda u: u.rlike(r"^https?://(?![^/?#]*@)[^/?#]*\.[^/?#]+") & ~u.rlike(r"^https?://(?:127|10|0|192\.168|169\.254|172\.(?:1[6-9]|2\d|3[01]))\.")
    return F.slice(F.array_distinct(F.filter(F.concat(head, F.transform(tags, source)), public)), 1, IMAGES)

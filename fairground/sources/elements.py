"""The elements of captured pages as intervals, and what listings and details say, selected by containment.

A page is read once, in one linear pass, into two lists: its elements in the order in which they begin, each with the place
of its last descendant, and its texts.  What an element contains is then a slice of either list, whatever stands nested in it,
and "x in y" is a comparison of two numbers.  Layouts say by such selections where a kind of page has its fields; only the fields
leave the worker that reads the page, and what they mean is worked out by column expressions.  Nothing is shuffled but the
small cards.

A null page has no elements.  Elements that are never closed end with what they stand in; ends that nothing began are
passed over.  Scripts and styles have no text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fairground.functions import grammar as G
from fairground.functions import text as X

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "time", "u", "var", "wbr", "img", "input"}
SILENT = {"script", "style", "template"}
#: Starts that end an open element of their own kind, unless one of the second kinds was opened since.
ALIKE = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}


BLOCKS = ("div", "section", "article", "td", "li", "blockquote")
#: Tags without attributes, which need no more than their name, and elements whose content the parser reads by other rules.
_BARE, _BARE_END = re.compile("<([a-z]+[1-6]?)>"), re.compile("</([a-z]+[1-6]?)>")
_RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext"}
#: The tags of a page that needs no parser: small letters, values in double quotes that hold no reference, nothing behind the name of an end.
_PLAIN = re.compile('<(?:/([a-z]+[1-6]?)|([a-z]+[1-6]?)((?:[ \\t\\n]+[a-z][a-z0-9-]*="[^"<>&]*")*+)[ \\t\\n]*+(/?))>')
_VALUE = re.compile('([a-z][a-z0-9-]*)="([^"]*)"')


class _Reader(HTMLParser):
    """Most tags are bare: they are taken as they stand, all others as the parser reads them; places of lines aren't counted."""

    def updatepos(self, i: int, j: int) -> int:
        return j

    def parse_starttag(self, i: int) -> int:
        bare = _BARE.match(self.rawdata, i)
        if bare is None or (tag := bare.group(1)) in _RAW:
            return super().parse_starttag(i)
        self.lasttag = tag
        self.handle_starttag(tag, ())
        return bare.end()

    def parse_endtag(self, i: int) -> int:
        bare = _BARE_END.match(self.rawdata, i) if self.cdata_elem is None else None
        if bare is None:
            return super().parse_endtag(i)
        self.handle_endtag(bare.group(1))
        return bare.end()

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements: list[dict] = []
        self.texts: list[str] = []
        self._open: list[int] = []
        self._places: dict[str, list[int]] = {}
        self._silent = 0

    def _close(self, to: int) -> None:
        while len(self._open) > to:
            e = self.elements[self._open.pop()]
            self._places[e["tag"]].pop()
            self._silent -= e["tag"] in SILENT
            if e["tag"] not in INLINE:
                self.texts.append("\n")
            e["last"], e["end"] = len(self.elements) - 1, len(self.texts)

    def _since(self, tag: str) -> int:
        places = self._places.get(tag)
        return places[-1] if places else -1

    def _begin(self, tag: str) -> None:
        """What the start of a block ends."""
        if self._places.get("p") and self._since("p") > max(map(self._since, BLOCKS)):
            self._close(self._since("p"))
        if tag in ALIKE and self._places.get(tag) and self._since(tag) > max(map(self._since, ALIKE[tag])):
            self._close(self._since(tag))
        self.texts.append("\n")

    def _end_at_once(self, tag: str) -> None:
        if tag not in VOID and tag not in ("div", "p", "section", "article", "li", "ul"):  # a slash there means nothing
            self._close(len(self._open) - 1)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            self._begin(tag)
        attributes = {k: v or "" for k, v in reversed(attrs)} if attrs else {}
        n = len(self.elements)
        self.elements.append({"pre": n, "last": n, "parent": self._open[-1] if self._open else -1, "tag": tag, "classes": attributes.get("class", "").split() if attributes else [], "attributes": attributes, "begin": len(self.texts), "end": len(self.texts)})
        if tag not in VOID:
            self._places.setdefault(tag, []).append(len(self._open))
            self._open.append(n)
            self._silent += tag in SILENT

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        self._end_at_once(tag)

    def handle_endtag(self, tag: str) -> None:
        if self._since(tag) >= 0:
            self._close(self._since(tag))

    def handle_data(self, data: str) -> None:
        if not self._silent:
            self.texts.append(data)
        elif self._open and self.elements[self._open[-1]]["tag"] == "script":
            self.elements[self._open[-1]].setdefault("script", []).append(data)

    def read(self, html: str) -> None:
        """The whole page; one of texts and plain tags alone is cut in one pass, any other goes through the parser."""
        parts = _PLAIN.split(html)
        if len(parts) // 5 == html.count("<") and _RAW.isdisjoint(parts[2::5]):
            self._plain(parts)
        else:
            self.feed(html)
            self.close()
        self._close(0)

    def _plain(self, parts: list[str | None]) -> None:
        """What the parser makes of texts and plain tags: (text, end, start, attributes, slash) again and again, then a text."""
        elements, texts, opened, places, known = self.elements, self.texts, self._open, self._places, {}
        for text, end, start, attrs, slash in zip(parts[0::5], parts[1::5], parts[2::5], parts[3::5], parts[4::5], strict=False):
            if text and not self._silent:
                texts.append(unescape(text) if "&" in text else text)
            if end:
                if opened and (e := elements[opened[-1]])["tag"] == end and end not in SILENT:
                    opened.pop()
                    places[end].pop()
                    if end not in INLINE:
                        texts.append("\n")
                    e["last"], e["end"] = len(elements) - 1, len(texts)
                else:
                    self.handle_endtag(end)
                continue
            if start not in INLINE:
                if start in ALIKE or places.get("p"):
                    self._begin(start)
                else:
                    texts.append("\n")
            given = known.get(attrs)
            if given is None:
                attributes = dict(reversed(_VALUE.findall(attrs)))
                given = known[attrs] = attributes, attributes.get("class", "").split()
            n, at = len(elements), len(texts)
            elements.append({"pre": n, "last": n, "parent": opened[-1] if opened else -1, "tag": start, "classes": given[1], "attributes": given[0], "begin": at, "end": at})
            if start not in VOID:
                if start in places:
                    places[start].append(len(opened))
                else:
                    places[start] = [len(opened)]
                opened.append(n)
                if start in SILENT:
                    self._silent += 1
            if slash:
                self._end_at_once(start)
        if parts[-1] and not self._silent:
            texts.append(unescape(parts[-1]))


class Page:
    """A page's elements and texts, and selections in them."""

    def __init__(self, html: str | None):
        reader = _Reader()
        reader.read(html or "")
        self.elements, self.texts = reader.elements, reader.texts
        self.whole = {"pre": -1, "last": len(self.elements) - 1, "begin": 0, "end": len(self.texts)}
        self._tags: dict[str, list[int]] | None = None
        self._classes: dict[str, list[int]] = {}

    def _at(self, inside: dict, w: Where) -> list[dict]:
        """The elements in another that meet a condition, in page order, found by their class or tag."""
        if self._tags is None:
            self._tags = {}
            for e in self.elements:
                self._tags.setdefault(e["tag"], []).append(e["pre"])
                for c in set(e["classes"]) if e["classes"] else ():
                    self._classes.setdefault(c, []).append(e["pre"])
        at = self._classes.get(w.cls, ()) if w.cls else self._tags.get(w.tag, ()) if w.tag else range(len(self.elements))
        if not at:
            return []
        mine = at[bisect_right(at, inside["pre"]) : bisect_right(at, inside["last"])]
        return [e for n in mine if w.of(e := self.elements[n])] if mine else []

    def _met(self, inside: dict, step: Where | tuple[Where, ...]) -> list[dict]:
        """The same of any of some conditions."""
        if not isinstance(step, tuple):
            return self._at(inside, step)
        found = {e["pre"]: e for w in step for e in self._at(inside, w)}
        return [found[n] for n in sorted(found)]

    def every(self, inside: dict | None, *path: Where | tuple[Where, ...]) -> list[dict]:
        """The elements that a path leads to, in page order: each step is met in one of the step before, in one pass."""
        if inside is None:
            return []
        above = [inside]
        for step in path:
            met = self._met(above[0] if len(above) == 1 else inside, step)
            if len(above) == 1:  # all that follows it, up to its last, stands in it
                above = met
                continue
            found, k, reach = [], 0, -1
            for e in met:
                while k < len(above) and above[k]["pre"] < e["pre"]:
                    reach = max(reach, above[k]["last"])
                    k += 1
                if e["pre"] <= reach:
                    found.append(e)
            above = found
        return above

    def first(self, inside: dict | None, *path: Where | tuple[Where, ...]) -> dict | None:
        found = self.every(inside, *path)
        return found[0] if found else None

    def parent(self, e: dict | None) -> dict | None:
        return None if e is None else self.elements[e["parent"]] if e["parent"] >= 0 else self.whole

    def raw(self, e: dict | None) -> str:
        return "" if e is None else "".join(self.texts[e["begin"] : e["end"]])

    def text(self, e: dict | None) -> str:
        """White space collapsed; empty without an element."""
        return "" if e is None else " ".join("".join(self.texts[e["begin"] : e["end"]]).split())

    def lines(self, e: dict | None) -> list[str]:
        """The lines in an element: blocks and what ``br`` parts, without empty ones."""
        return [line for raw in self.raw(e).split("\n") if (line := " ".join(raw.split()))]


def attribute(e: dict | None, *names: str) -> str:
    known = e["attributes"] if e else {}
    return next((known[n] for n in names if known.get(n)), "")


@dataclass(frozen=True)
class Where:
    """What an element must be: its tag, a class, an id, an attribute, and how that begins or what it is."""

    tag: str | None = None
    cls: str | None = None
    id: str | None = None
    attr: str | None = None
    begins: str = ""
    value: str | None = None

    def of(self, e: dict) -> bool:
        if self.tag and e["tag"] != self.tag or self.cls and self.cls not in e["classes"] or self.id and e["attributes"].get("id", "") != self.id:
            return False
        if not self.attr:
            return True
        here = e["attributes"].get(self.attr)
        return here is not None and here.startswith(self.begins) and self.value in (None, here)


#: Bytes of html that are read before their records leave the worker; one page may have more.
SLICE_BYTES = 1 << 20


def _slices(sizes: list[int | None]) -> list[int]:
    """Where the slices of a batch end: of pages that have ``SLICE_BYTES`` at most, or of one page."""
    ends, held = [], 0
    for n, size in enumerate(sizes):
        if n and held + (size or 0) > SLICE_BYTES:
            ends.append(n)
            held = 0
        held += size or 0
    return [*ends, len(sizes)] if sizes else []


def read_pages(pages: DataFrame, read: Callable[..., list[dict]], added: str, *arguments: str) -> DataFrame:
    """``pages`` but their html, with the columns ``added`` of each record that ``read`` makes of a page and the columns ``arguments``."""
    keep = [f for f in pages.schema.fields if f.name != "html"]
    more = T._parse_datatype_string(added)
    schema = to_arrow_schema(more)

    def scan(batches):
        for rows in batches:
            value = lambda name: rows.column(rows.schema.get_field_index(name))
            ends = _slices(pc.binary_length(value("html").cast(pa.large_string())).to_pylist())
            for begin, end in zip([0, *ends], ends, strict=False):
                part = lambda name: value(name).slice(begin, end - begin)  # noqa: B023, E731
                found = [read(Page(h), *a) for h, *a in zip(*(part(c).to_pylist() for c in ("html", *arguments)), strict=True)]
                at = pa.array([k for k, records in enumerate(found) for _ in records], pa.int64())
                made = pa.Table.from_pylist([r for records in found for r in records], schema).combine_chunks()
                kept = [part(f.name).take(at) for f in keep]
                columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in made.columns]
                yield pa.RecordBatch.from_arrays([*kept, *columns], names=[*(f.name for f in keep), *schema.names])

    return pages.mapInArrow(scan, T.StructType([*keep, *more.fields]))


def element_rows(pages: DataFrame) -> DataFrame:
    """(the columns of ``pages`` but html, pre, last, parent, tag, classes, attributes, text): the element table, a row an element.

    x stands in y if y.pre < x.pre <= y.last.  ``text`` is the element's own, up to the first element in it.
    """

    def read(page: Page) -> list[dict]:
        after = [*page.elements[1:], None][: len(page.elements)]
        own = lambda e, n: "".join(page.texts[e["begin"] : min(e["end"], n["begin"]) if n else e["end"]])
        return [{**{k: e[k] for k in ("pre", "last", "parent", "tag", "classes")}, "attributes": list(e["attributes"].items()), "text": " ".join(own(e, n).split())} for e, n in zip(page.elements, after, strict=True)]

    return read_pages(pages, read, "pre int, last int, parent int, tag string, classes array<string>, attributes map<string,string>, text string")


def absolute(href: Column, base: Column) -> Column:
    """An address as it is meant on a page at ``base``, in canonical form; empty if it is none."""
    return X.let(F.trim(F.coalesce(href, F.lit(""))), lambda h: X.canon_url(_whole(h, base)))


def _whole(href: Column, base: Column) -> Column:
    origin, folder = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1), F.regexp_extract(base, r"^(https?://[^/?#]+(?:/[^?#]*/|/)?)", 1)
    whole = F.when(href.rlike("^(?i)https?://"), href).when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), "").when(href.startswith("//"), F.concat(F.regexp_extract(base, "^(https?:)", 1), href))
    return whole.when(href.startswith("/"), F.concat(origin, href)).when((href == "") | href.startswith("#"), "").otherwise(F.concat(F.regexp_replace(folder, "([^/])$", "$1/"), href))


# --- listings ------------------------------------------------------------------------------------------------

Field = Callable[[Page, dict], str]


def _in(*path) -> Field:
    return lambda p, card: p.text(p.first(card, *path))


def _of(name: str, *path) -> Field:
    return lambda p, card: attribute(p.first(card, *path) if path else card, name)


def _icon(name: str) -> Field:
    """The text beside an icon."""
    return lambda p, card: p.text(p.parent(p.first(card, Where(attr=name))))


def _label(mark: Where, label: str) -> Field:
    """What stands beside a label in the label's own parent."""

    def find(p: Page, card: dict) -> str:
        at = next((e for e in p.every(card, mark) if p.text(e) == label), None)
        return p.text(p.parent(at)).removeprefix(label).strip()

    return find


def _nothing(p: Page, card: dict) -> str:
    return ""


def _stamp(*path, nth: int = 0) -> Field:
    def find(p: Page, card: dict) -> str:
        found = p.every(card, *path)
        return attribute(found[nth], "content", "datetime") if len(found) > nth else ""

    return find


@dataclass(frozen=True)
class Layout:
    """Where one kind of listing has its cards, and a card its fields."""

    cards: list[tuple]
    title: Field
    href: Field
    place: Field = _nothing
    written: Field = _nothing
    start: Field = _nothing
    last: Field = _nothing
    organizer: Field = _nothing
    fee: Field = _nothing
    label: Field = _nothing
    #: Of the path of a card's address; others are no activities of this kind.
    path: str = "."
    #: Words of cards of other cities.
    elsewhere: tuple[str, ...] = ()


def _badges(p: Page, card: dict) -> str:
    """Fees that stand alone."""
    return " / ".join(sorted({t for e in p.every(card, Where("span")) if re.fullmatch(FEE, t := p.text(e))}))


#: What sites of these kinds write.  Fixed values: their tags, classes and labels.
ENDED = "回放|已结束|重播"
FEE = r"[￥¥]\s*\d[\d.,]*(?:\s*[-–]\s*[￥¥]?\s*[\d.,]+)?|免费"
TITLED = (Where(cls="title"), Where(cls="event-title"))
PLACED = (Where(attr="itemprop", value="location"), Where(cls="loc"), Where(cls="address"))
BLOCK_LABEL = Where(cls="main-single-block-des")
WEBINAR = Where(cls="activity-info")
LAYOUTS = {
    "timed": Layout(
        [(Where("article"),)], _in(Where("h3"), Where("a", attr="href")), _of("href", Where("h3"), Where("a", attr="href")), lambda p, c: p.text((p.every(c, Where("p")) or [None])[-1]),
        start=_stamp(Where("time", attr="datetime")), last=_stamp(Where("time", attr="datetime"), nth=1), organizer=lambda p, c: " / ".join(map(p.text, p.every(c, Where("a", attr="href", begins="/org/")))), fee=_badges,
    ),
    "labelled": Layout([(Where(cls="main-single-block", attr="data-url"),)], _in(Where(cls="main-single-block-title")), _of("data-url"), _label(BLOCK_LABEL, "活动地址"), _label(BLOCK_LABEL, "活动时间")),
    "icons": Layout([(Where("a", attr="href", begins="/event/"),)], _in(Where("h3")), _of("href"), _icon("i-carbon-location"), _icon("i-carbon-calendar"), organizer=_icon("i-carbon-group")),
    "entries": Layout(
        [((Where("li", "list-entry"), Where(cls="event-item")),)], _in(TITLED, Where("a", attr="href")), _of("href", TITLED, Where("a", attr="href")), _in(PLACED),
        start=_stamp(Where(attr="itemprop", value="startDate")), last=_stamp(Where(attr="itemprop", value="endDate")), path=r"^/event/\d+/?$",
    ),
    "results": Layout([(Where(cls="search-tab-content-item"),)], _in(Where(cls="item-title", attr="href")), _of("href", Where(cls="item-title", attr="href")), _in(Where(cls="item-dress")), _in(Where(cls="item-data")), organizer=_in(Where(cls="user-name"))),
    "posters": Layout([(Where("a", attr="href", begins="/activity/poster"),)], _in((Where("h2"), Where("h3"), Where("h4"), Where(cls="title"))), _of("href"), written=lambda p, c: "".join(re.findall(r"20\d\d/\d{2}/\d{2}", p.text(c))[:1]), elsewhere=("成都柴火", "贵阳", "河北柴火")),
    "webinars": Layout([(Where("li", "bd-wrap"),)], _in(WEBINAR, Where("h3"), Where("a", attr="href")), _of("href", WEBINAR, Where("h3"), Where("a", attr="href")), lambda p, c: "线上", _in(WEBINAR, Where("p"), Where("span")), label=_in(Where(cls="status"))),
    "regions": Layout(
        [(Where(cls="hot"), Where(cls="activity")), (Where(cls="regular-events-list"), Where(cls="event-item"))], _in(Where(cls="card-meta"), Where("a", "initial", attr="href")), _of("href", Where(cls="card-meta"), Where("a", "initial", attr="href")),
        _in(Where(cls="card-map")), _in(Where(cls="card-times")), label=_in(Where(cls="status")),
    ),
}


def _cards(page: Page, kind: str) -> list[dict]:
    layout = LAYOUTS.get(kind)
    if layout is None:
        return []
    cards = {e["pre"]: e for path in layout.cards for e in page.every(page.whole, *path)}
    fields = ("title", "href", "place", "written", "start", "last", "organizer", "fee", "label")
    return [{"pos": n, **{f"c_{f}": getattr(layout, f)(page, cards[k]) for f in fields}, "c_path": layout.path, "c_other": any(w in page.text(cards[k]) for w in layout.elsewhere)} for n, k in enumerate(sorted(cards))]


def site_cards(pages: DataFrame) -> DataFrame:
    """(page_id, kind, pos, title, link, start, end, place, organizer, fee, status, reject) of every card of (page_id, kind, url, html).

    A card without title or link, of another city, that has ended, or whose address is no activity's is kept with the reason; so
    is each further card of an address: of those the first dated one counts, or else the first.  A date without a year stays
    unknown.  Cards in cards are cards of their own; a page of an unknown kind, or a null one, has none.
    """
    added = "pos int, c_title string, c_href string, c_place string, c_written string, c_start string, c_last string, c_organizer string, c_fee string, c_label string, c_path string, c_other boolean"
    rows = read_pages(pages.select("page_id", "kind", "url", "html"), _cards, added, "kind")
    day = lambda c: F.substring(c, 1, 10).try_cast("date")
    start, last = day("c_start"), F.coalesce(day("c_last"), day("c_start"))
    stamped = F.when(last >= start, F.struct(start.alias("start"), F.date_add(last, 1).alias("end")))
    rows = rows.withColumn("link", absolute(F.col("c_href"), F.col("url"))).withColumn("range", F.coalesce(stamped, G.explicit_range(G.without_spaces(F.col("c_written")))))
    path = F.regexp_extract("link", r"^https?://[^/?#]+([^?#]*)", 1)
    bad = F.when(F.col("c_title") == "", "title").when((F.col("link") == "") | ~F.regexp(path, F.col("c_path")), "link").when(F.col("c_other"), "elsewhere").when(F.col("c_label").rlike(ENDED), "ended")
    rows = rows.withColumn("bad", bad)
    nth = F.row_number().over(Window.partitionBy("page_id", "link").orderBy(F.col("bad").isNotNull(), F.col("range").isNull(), "pos"))
    status = F.when(F.col("c_label").rlike("取消"), "cancelled").otherwise("scheduled")
    names = {"title": "c_title", "place": "c_place", "organizer": "c_organizer", "fee": "c_fee"}
    field = {n: F.col(c).alias(n) for n, c in names.items()}
    return rows.select("page_id", "kind", "pos", field["title"], "link", F.col("range.start").alias("start"), F.col("range.end").alias("end"), field["place"], field["organizer"], field["fee"], status.alias("status"), F.coalesce("bad", F.when(nth > 1, "repeated")).alias("reject"))


# --- details -------------------------------------------------------------------------------------------------

#: Labels of details, the field each is of, and the bodies that details stand in.  Fixed values.
LABELS = {"主办方": "organizer", "主办单位": "organizer", "协办单位": "coorganizers", "指导单位": "guidance", "支持单位": "supporters", "活动费用": "fee", "门票价格": "fee", "费用": "fee"}
BODIES = (Where(id="js_content"), Where(id="event_desc_page"), Where(cls="event-detail"), Where("article"), Where("main"))
PAST = re.compile("往届活动和嘉宾|往期活动专题")
NO_VALUE, NO_PICTURE = re.compile("https?:|扫码|分享"), re.compile("qr|二维码|公众号|logo|头像", re.I)
MOST_PICTURES = 8
_LABELLED = re.compile(rf"({'|'.join(LABELS)})\s*(?:[：:]|$)")
_ANY_LABEL = re.compile(rf"(?:{'|'.join(LABELS)})(?:\s*[：:]|$)")


def labelled_values(lines: list[str]) -> dict[str, str]:
    """The first value of each field.

    It follows its label on the label's line, or, if nothing does, stands on the next one; a colon may begin that line, or be one.
    What is a label itself, an address, an invitation, or over 200 long is no value.
    """
    found: dict[str, str] = {}
    for n, line in enumerate(lines):
        labelled = _LABELLED.match(line)
        if labelled is None:
            continue
        label = labelled[1]
        value = line.removeprefix(label).strip().lstrip("：:").strip()
        if not value:
            after = [w for w in lines[n + 1 : n + 3] if w not in ("：", ":")]
            value = after[0].lstrip("：:").strip() if after else ""
        if value and len(value) <= 200 and not _ANY_LABEL.match(value) and not NO_VALUE.match(value):
            found.setdefault(LABELS[label], value)
    return found


def _details(page: Page) -> list[dict]:
    body = page.first(page.whole, BODIES)
    lines = page.lines(body)
    own = [attribute(m, "content") for m in page.every(page.whole, Where("meta", attr="property", value="og:image"))]
    shown = [attribute(i, "data-src", "src") for i in page.every(body, Where("img")) if not NO_PICTURE.search(attribute(i, "alt"))]
    fields = dict.fromkeys(LABELS.values(), "") | labelled_values(lines)
    return [{**fields, "seen": [*own, *shown], "detail_text": "\n".join(lines)[:14000]}]


def page_details(pages: DataFrame) -> DataFrame:
    """(page_id, organizer, coorganizers, guidance, supporters, fee, pictures, detail_text) of (page_id, url, html).

    Labels may be split over elements, and stand beside or above their values.  Up to eight public pictures: the page's own
    first, then those of its body but codes, logos and heads.  Without a body every field but the page's own pictures is empty.
    """
    rows = read_pages(pages.select("page_id", "url", "html"), _details, ", ".join(f"{f} string" for f in dict.fromkeys(LABELS.values())) + ", seen array<string>, detail_text string")
    named, private = r"^https?://[^/?#:]*\.[a-z]{2,}(?:[/:?#]|$)", r"^https?://(?:127|10|0|192\.168|169\.254|172\.(?:1[6-9]|2\d|3[01]))\."
    public = lambda u: u.rlike(named) | (u.rlike(r"^https?://\d+(?:\.\d+){3}(?:[/:?#]|$)") & ~u.rlike(private))
    found = F.array_distinct(F.filter(F.transform("seen", lambda u: absolute(u, F.col("url"))), public))
    return rows.select("page_id", *dict.fromkeys(LABELS.values()), F.slice(found, 1, MOST_PICTURES).alias("pictures"), "detail_text")


#: Bodies of recurring activities by kind, where their clocks stand above it, and their labels.  Fixed values.
RECURRING = {"regions": (Where(cls="correlation-center"),), "docs": (Where(cls="vp-doc"),), "webinars": (Where(cls="bd-wrap-txt"), Where(cls="webinar-content"), Where(cls="bd-content"))}
CLOCKS_ABOVE = (Where(cls="event-brief-info"), Where(cls="card-items"))
RECURRING_LABELS = {"organizer": ["主办方", "主办单位", "主办"], "fee": ["活动费用", "门票价格", "参会费用"], "place": ["地点", "活动地点"], "times": ["时间", "活动时间"]}


def _recurring(page: Page, kind: str) -> list[dict]:
    body = page.first(page.whole, RECURRING[kind]) if kind in RECURRING else None
    lines = page.lines(body)
    lines = lines[: next((n for n, w in enumerate(lines) if PAST.match(w)), len(lines))]
    return [{"found": body is not None, "text": "\n".join(lines), "above": [page.text(e) for e in page.every(page.whole, *CLOCKS_ABOVE)]}]


def recurring_details(pages: DataFrame) -> DataFrame:
    """(page_id, organizer, fee, place, start, end, conflict, found) of (page_id, kind, html) of recurring activities.

    Lines end at the heading of past ones.  A label with two values has none.  Clock ranges come from the head and from the
    labelled times of the body: one is taken over, several different ones are a conflict and none is taken.  Without a body
    of its kind nothing is found.
    """
    rows = read_pages(pages.select("page_id", "kind", "html"), _recurring, "found boolean, text string, above array<string>", "kind")
    rows = rows.select("page_id", "found", "above", *(G.labeled(F.col("text"), labels).alias(f) for f, labels in RECURRING_LABELS.items()))
    rows = rows.withColumn("ranges", F.array_distinct(F.array_compact(F.transform(F.concat("above", "times"), G.clock_range))))
    one = lambda f: F.when(F.size(f) == 1, F.substring(F.col(f)[0], 1, 200)).otherwise("").alias(f)
    clocks = F.when(F.size("ranges") == 1, F.col("ranges")[0])
    return rows.select("page_id", one("organizer"), one("fee"), one("place"), clocks["start"].alias("start"), clocks["end"].alias("end"), (F.size("ranges") > 1).alias("conflict"), "found")


def _notices(page: Page) -> list[dict]:
    root = next((u for u in page.every(page.whole, Where("ul", "section-list-item-ul")) if "special-list" in (page.parent(u) or {}).get("classes", [])), None)
    out = []
    for n, card in enumerate(c for c in page.every(root, Where("li", "section-special-item")) if c["parent"] == root["pre"]):
        link = page.first(card, Where("a", "item-title", attr="href"))
        times = dict.fromkeys(t for e in page.every(card, Where(cls="event-time")) if (t := page.text(e)))
        labels = [page.text(e) for e in page.every(card, (Where(cls="event-status"), Where(cls="status")))]
        out.append({"pos": n, "post": attribute(card, "data-post-id"), "href": attribute(link, "href"), "title": page.text(link), "labels": labels, "times": list(times), "inventory": page.parent(root)["tag"] == "div", "raw": page.raw(card)})
    return out


def cancellation_scan(pages: DataFrame) -> DataFrame:
    """(page_id, card_key, alias, title, status_text, again, occurrence, role, digest) of the cards of (page_id, url, html) that say they are off.

    Cards are the direct items of the page's special list.  All their labels must say that the whole activity is off, or off
    again; a part, a question or a quotation says nothing.  The occurrence is known only from one time of its own kind.
    """
    rows = read_pages(pages.select("page_id", "url", "html"), _notices, "pos int, post string, href string, title string, labels array<string>, times array<string>, inventory boolean, raw string")
    rows = rows.withColumn("alias", absolute(F.col("href"), F.col("url"))).withColumn("again", F.exists("labels", G.cancelled_again)).withColumn("time", F.when(F.size("times") == 1, F.col("times")[0]).otherwise(""))
    off = F.forall("labels", lambda v: G.cancelled_again(v) | F.coalesce(G.state_of(v) == "cancelled", F.lit(False)))
    rows = rows.where((F.size("labels") > 0) & off & (F.col("alias") != "") & (F.col("title") != "")).withColumn("role", G.time_role(F.col("time"), F.col("inventory")))
    key = F.when(F.col("post") != "", F.col("post")).otherwise(F.concat_ws(":", F.col("pos").cast("string"), "alias"))
    return rows.select("page_id", key.alias("card_key"), "alias", "title", F.array_join("labels", " / ").alias("status_text"), "again", F.when(F.col("role") == "actual_occurrence", G.single_day(F.col("time"))).alias("occurrence"), "role", F.sha2("raw", 256).alias("digest"))


#: Properties of microdata and the columns they become.  Fixed values.
PROPERTIES = {"name": "title", "startDate": "start", "endDate": "end", "location": "place"}


def microdata_fields(pages: DataFrame) -> DataFrame:
    """(page_id, title, start, end, place) of the first element of each item property, in whatever order its attributes stand.

    Times come from ``content`` or ``datetime``, names and places from the text; without a property ``name`` the first heading counts.
    """

    def read(page: Page) -> list[dict]:
        found = {c: page.first(page.whole, Where(attr="itemprop", value=n)) for n, c in PROPERTIES.items()}
        found["title"] = found["title"] or page.first(page.whole, Where("h1"))
        return [{c: attribute(e, "content", "datetime") or page.text(e) for c, e in found.items()}]

    return read_pages(pages.select("page_id", "html"), read, "title string, start string, end string, place string")

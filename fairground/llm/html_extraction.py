"""HTML extraction by consensus host paths.

Each page's containers are scored by the unlinked text under them.  A page's own choice is the lowest ``article`` or
``main`` that holds half of the page's text, with the page's first heading if such a one has it; without one, the lowest container
that holds nine tenths of the text and the heading.  A container's path is the tags and classes above it, with digits
generalised.  The pages of a host vote: the path with the most votes, then the higher total score, wins, and every page of
the host is extracted again from its outermost containers of that path.  A page whose containers of that path hold less than half
of what its own choice holds, or which has none, uses its own choice.

Left out wherever they stand: navigation, page headers and footers, sidebars, notices, adverts, forms, scripts,
styles, comments of the markup and of readers.  A header in an article is of the article.  What is left out by its class, id or
role alone (``mark_of``) is judged when the page has been read: a sidebar that has the page's heading or an article, and half of
the page's unlinked text besides, is none, and a word that only ends a name (``public-notice``) needs no heading for that.  References are decoded; white space inside a block becomes one
space; blocks are trimmed and joined in page order by one space.

Loose pages: a tag that no page's start may be inside (``body`` in ``head``, ``main`` in ``nav``) ends it; what is left out and
never closed ends at the next ``article``, ``main`` or ``section``; a ``<`` that begins no tag, or a tag without an end, is text.
Scanning is linear in the page, however broken it is; containers deeper than ``DEPTH`` count to the one at that depth.

A null or empty html has an empty text; a null url, or one without ``://``, belongs to the empty host.
Repeated rows each get their result; an empty table gives an empty table; other columns are left aside.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairground.llm._shared import batch, column, cut, frugal, table
from fairground.llm.url_filter import host_of

CONTAINERS = {"article", "body", "center", "dd", "div", "main", "section", "td"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
LEFT_OUT = {"aside", "button", "dialog", "footer", "form", "head", "header", "iframe", "menu", "nav", "noscript", "object", "script", "select", "style", "svg", "template", "textarea", "title"}
#: Elements are left out if their class, id or role begins or ends with one of these.
LEFT_OUT_NAMES = {"ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "promoted", "related", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "widget"}
#: Of those, what readers write is never the article.
READERS = {"comment", "comments", "disqus"}
#: Names that begin so say what else is on the page, or that it isn't; and those of an article's own header.
BESIDE, OWN = {"has", "no", "not", "with", "without"}, {"article", "content", "entry", "main", "post", "story"}
OWN_HEADS = {"header", "masthead"}
#: What may stand in a head; any other start ends it.
HEAD = {"base", "basefont", "bgsound", "link", "meta", "noscript", "script", "style", "template", "title"}
#: Elements of plain characters up to their end.
RAW = {"iframe", "script", "style", "textarea", "title", "xmp"}
#: What main can't be inside.
NOT_ABOVE_MAIN = {"article", "aside", "footer", "header", "nav"}
#: Starts that end an open element of their own kind.
SIBLINGS = {"li", "dd", "dt", "td", "tr", "option"}
DEPTH = 256
HALF, MOST = 0.5, 0.9
#: The winners are broadcast up to this size, measured.
BROADCAST_BYTES = 32 << 20

_OPEN = re.compile(r"<(?:!|\?|/?[a-zA-Z])")
_INSIDE = re.compile(r"[>\"']")
_TAG = re.compile(r"/?([^\s/>]+)")
_NAME = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[a-z]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


def mark_of(names: str, in_article: bool) -> int:
    """What names say of an element: 1 for readers' words, 2 if a name begins with what is left out, 3 if one ends with it; else 0."""
    found = []
    for name in names.split():
        parts = _PARTS.findall(name)
        if not parts or parts[0] in BESIDE or parts[-1] in OWN_HEADS and (in_article or parts[0] in OWN):
            continue
        if parts[0] in READERS or parts[-1] in READERS:
            return 1
        found += [2] * (parts[0] in LEFT_OUT_NAMES) + [3] * (parts[-1] in LEFT_OUT_NAMES)
    return min(found, default=0)


def _step(tag: str, attributes: str, in_article: bool) -> tuple[str, int]:
    """(path step, mark)"""
    step, marks = tag, []
    if attributes and "=" in attributes:
        for kind, *value in _NAME.findall(attributes):
            names = "".join(value).lower()
            if kind.lower() == "class":
                step += "." + ".".join(sorted({re.sub(r"\d+", "#", n) for n in names.split()}))
            marks.append(mark_of(names, in_article))
    return step, 0 if tag in ("html", "body", "article", "main") else min(filter(None, marks), default=0)


def tokens(page: str):
    """(text before, tag or "", whether it is an end, attributes) in page order; the last one has no tag."""
    at, text_from, n, quotes = 0, 0, len(page), True
    while m := _OPEN.search(page, at):
        start = m.start()
        if page[start + 1] in "!?":
            comment = page.startswith("<!--", start)
            end = page.find("-->" if comment else ">", start + (4 if comment else 2))
            end = n if end < 0 else end + (3 if comment else 1)
            yield page[text_from:start], "", False, ""
            at = text_from = end
            continue
        end = start + 1
        while quotes and (q := _INSIDE.search(page, end)) and q[0] != ">":
            end = page.find(q[0], q.end()) + 1
            if not end:
                break
        if quotes and end and q:
            end = q.start()
        else:  # no end outside of quotes from here on: they mean nothing for the rest of the page
            quotes = False
            end = page.find(">", start)
            if end < 0:
                break
        name = _TAG.match(page, start + 1)
        tag, is_end = name[1].lower(), page[start + 1] == "/"
        yield page[text_from:start], tag, is_end, page[name.end() : end]
        at = text_from = end + 1
        if tag in RAW and not is_end:
            close = _RAW_END[tag].search(page, at)
            if not close:
                return
            at = text_from = close.start()
    yield page[text_from:], "", False, ""


class Page:
    """A page's containers, and the texts of what is not left out, in page order."""

    def __init__(self, page: str):
        self.parents, self.paths, self.tags = [-1], [""], [""]
        #: (container, linked, text, or None for a block's end), and the marked element that each is in
        self.pieces: list[tuple[int, bool, str | None]] = []
        self._marks: list[int] = []
        #: Of marked elements: (the one around it, mark); those with an article in them; (container, marked element) of headings.
        self._marked: list[tuple[int, int]] = [(-1, 0)]
        self._articles: set[int] = set()
        self._headings: list[tuple[int, int]] = []
        found = list(tokens(page))
        never = self._never_closed(found)
        #: (tag, left out, container, number of blocks at and under it, whether it ends at the next section, marked element)
        stack: list[tuple[str, bool, int, int, bool, int]] = []
        places: dict[str, list[int]] = defaultdict(list)
        loose: list[int] = []
        out_depth = 0

        def close(to: int):
            nonlocal out_depth
            while len(stack) > to:
                tag, out, _, _, ends, _ = stack.pop()
                places[tag].pop()
                out_depth -= out
                if ends:
                    loose.pop()

        for number, (text, tag, is_end, attributes) in enumerate(found):
            holder, mark = (stack[-1][2], stack[-1][5]) if stack else (0, 0)
            if text and not out_depth:
                self.pieces.append((holder, bool(places["a"]), text))
                self._marks.append(mark)
            if not tag:
                continue
            block, blocks_now = tag not in INLINE, stack[-1][3] if stack else 0
            if block and not out_depth:
                self.pieces.append((holder, False, None))
                self._marks.append(0)
            if is_end:
                # An inline end doesn't reach out of the block that it stands in.
                if places[tag] and (block or blocks_now == stack[places[tag][-1]][3]):
                    close(places[tag][-1])
                continue
            if tag not in HEAD and places["head"]:
                close(places["head"][-1])
            if tag == "main":
                close(min((places[t][0] for t in NOT_ABOVE_MAIN if places[t]), default=len(stack)))
            if loose and tag in ("article", "main", "section"):
                close(loose[0])
            if tag in VOID or attributes.endswith("/") and tag not in CONTAINERS | LEFT_OUT:
                continue
            if block:  # it ends an open paragraph, or an element of its kind, and what inline elements that holds
                blocks_now = stack[-1][3] if stack else 0
                for kind in {"p", tag} if tag in SIBLINGS else {"p"}:
                    if places[kind] and stack[places[kind][-1]][3] == blocks_now:
                        close(places[kind][-1])
                        break
            holder, blocks_now, mark = (stack[-1][2], stack[-1][3], stack[-1][5]) if stack else (0, 0, 0)
            in_article = bool(places["article"] or places["main"])
            step, named = _step(tag, attributes, in_article)
            out = tag in LEFT_OUT and not (tag == "header" and in_article)
            if named and not out and not out_depth:
                self._marked.append((mark, named))
                mark = len(self._marked) - 1
            if tag in ("article", "main") and not out_depth:
                self._articles.add(mark)
            if tag in CONTAINERS and not out and not out_depth and self.paths[holder].count("/") < DEPTH:
                self.parents.append(holder)
                self.paths.append(f"{self.paths[holder]}/{step}")
                self.tags.append(tag)
                holder = len(self.paths) - 1
            if tag == "h1" and not out_depth and not out:
                self._headings.append((holder, mark))
            ends = (out or named) and number in never
            places[tag].append(len(stack))
            if ends:
                loose.append(len(stack))
            stack.append((tag, out, holder, blocks_now + block, ends, mark))
            out_depth += out
        self._settle()

    def _settle(self):
        """Takes the pieces of marked elements away that are left out."""
        n = len(self._marked)
        gone, sizes, holds = [False] * n, [0] * n, [k in self._articles for k in range(n)]
        for _, k in self._headings:
            holds[k] = True
        for k, (above, mark) in enumerate(self._marked):
            gone[k] = mark == 1 or k > 0 and gone[above]
        for every in (False, True):  # all characters, if all are linked
            for (_, linked, text), k in zip(self.pieces, self._marks, strict=True):
                if text and not gone[k] and (every or not linked):
                    sizes[k] += len(text.strip())
            if any(sizes):
                break
        for k in range(n - 1, 0, -1):
            above = self._marked[k][0]
            sizes[above] += sizes[k]
            holds[above] |= holds[k]
        for k in range(1, n):
            above, mark = self._marked[k]
            gone[k] |= gone[above] or sizes[k] < HALF * sizes[0] or mark == 2 and not holds[k]
        self.pieces = [p for p, k in zip(self.pieces, self._marks, strict=True) if not gone[k]]
        self.heading = next((holder for holder, k in self._headings if not gone[k]), None)

    @staticmethod
    def _never_closed(found) -> set[int]:
        """The numbers of the starts that no end belongs to."""
        starts = defaultdict(list)
        for number, (_, tag, is_end, _) in enumerate(found):
            if tag and not is_end:
                starts[tag].append(number)
            elif is_end and starts[tag]:
                starts[tag].pop()
        return {number for numbers in starts.values() for number in numbers}

    def under(self) -> list[int]:
        """The unlinked characters under each container; all characters if all are linked."""
        for every in (False, True):
            sizes = [0] * len(self.parents)
            for holder, linked, text in self.pieces:
                if text and (every or not linked):
                    sizes[holder] += len(text.strip())
            if any(sizes):
                break
        for k in range(len(sizes) - 1, 0, -1):
            sizes[self.parents[k]] += sizes[k]
        return sizes

    def choice(self) -> tuple[str, int] | None:
        """(path, characters) of the page's own choice."""
        sizes = self.under()
        if not sizes[0]:
            return None
        heads, k = set(), self.heading
        while k is not None and k >= 0:
            heads.add(k)
            k = self.parents[k]
        named = [k for k in range(len(sizes)) if self.tags[k] in ("article", "main") and sizes[k] >= HALF * sizes[0]]
        named = [k for k in named if k in heads] or named
        best = named[-1] if named else max(k for k in range(len(sizes)) if sizes[k] >= MOST * sizes[0] and (not heads or k in heads))
        return self.paths[best], sizes[best]

    def text(self, path: str) -> tuple[str, int]:
        """(text, unlinked characters) of the outermost containers of a path."""
        inside = [False] * len(self.paths)
        for k in range(len(inside)):
            inside[k] = self.paths[k] == path or k > 0 and inside[self.parents[k]]
        blocks, now, size = [], [], 0
        for holder, linked, text in self.pieces:
            if text is None or not inside[holder]:
                if now:
                    blocks.append("".join(now))
                    now = []
            else:
                now.append(text)
                size += 0 if linked else len(text.strip())
        blocks.append("".join(now))
        return " ".join(b for b in (_SPACE.sub(" ", html.unescape(b)).strip() for b in blocks) if b), size


def main_text(page: str, path: str | None) -> str:
    """A page's text by its host's path, or by its own choice."""
    parsed = Page(page)
    own = parsed.choice()
    if own is None:
        return ""
    text, size = parsed.text(path) if path is not None else ("", 0)
    return text if size and size >= HALF * own[1] else parsed.text(own[0])[0]


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every page."""
    pages = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    vote = pa.schema([("host", pa.string()), ("path", pa.string()), ("score", pa.float64())])

    def vote_paths(batches):
        for rows in batches:
            votes = [(h, *b) for h, p in zip(column(rows, "host").to_pylist(), column(rows, "html").to_pylist(), strict=True) if p and (b := Page(p).choice())]
            yield batch(vote, *([v[k] for v in votes] for k in range(3)))

    votes = pages.select("host", "html").mapInArrow(frugal(vote_paths), "host string, path string, score double")
    ranked = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    winners = cut(ranked.groupBy("host").agg(F.max_by("path", F.struct("n", "score", "path")).alias("path")))

    def extract_text(batches):
        for rows in batches:
            texts = [main_text(p, path) if p else "" for p, path in zip(column(rows, "html").to_pylist(), column(rows, "path").to_pylist(), strict=True)]
            yield batch(out, column(rows, "page_id"), column(rows, "url"), texts, [len(t) for t in texts])

    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    size = winners.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 32)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        winners = F.broadcast(winners)  # else pages meet them by host, and a hot host's pages can be split
    return pages.join(winners, "host", "left").select("page_id", "url", "html", "path").mapInArrow(frugal(extract_text), "page_id long, url string, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

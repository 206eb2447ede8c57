"""Text, URL, place and fee expressions."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Fixed values.
DROPPED_PARAMETERS = ["from", "spm", "chksm", "scene", "clicktime", "enterid"]
DISTRICTS = ["南山", "福田", "宝安", "龙岗", "龙华", "罗湖", "盐田", "光明", "坪山", "大鹏", "深汕"]
LONG_NAMES = {"大鹏": "大鹏新区", "深汕": "深汕特别合作区"}
PINYIN = {"南山": "nan shan", "福田": "fu tian", "宝安": "bao an", "龙岗": "long gang", "龙华": "long hua", "罗湖": "luo hu", "盐田": "yan tian", "光明": "guang ming", "坪山": "ping shan", "大鹏": "da peng"}
FREE_TEXTS = ["免费", "0元", "免费参加"]
ONLINE_PLACES = ["线上", "线上活动", "在线", "online", "virtual", "online event"]
UNKNOWN_PLACES = ["", "待确认", "地点待确认", "地点待定"]


#: Words of the titles of pages that refuse.  Fixed values.
BLOCKED_TITLES = ["captcha", "访问验证", "安全验证", "反爬", "请输入验证码"]


def let(c: Column, f) -> Column:
    """f(c), with c worked out once however often f names it."""
    return F.transform(F.array(c), f)[0]


def clean(c: Column) -> Column:
    """White space collapsed and trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def heading(c: Column) -> Column:
    """A heading as it is compared: NFC, white space collapsed; null is empty."""
    return clean(nfc(F.coalesce(c, F.lit(""))))


def norm(c: Column) -> Column:
    """NFKC, case folded, word characters only; Spark has no Unicode normaliser of its own."""
    return F.regexp_replace(nfkc(F.coalesce(c, F.lit(""))), r"(?U)[^\w]", "")


def canon_url(c: Column) -> Column:
    """http(s) without user info; tracking parameters and the fragment dropped; else empty."""
    name = lambda p: F.split(p, "=")[0]

    def parts(c: Column) -> Column:
        scheme, authority = F.lower(F.regexp_extract(c, r"^(?i)(https?)://", 1)), F.lower(F.regexp_extract(c, r"^(?i)https?://([^/?#]+)", 1))
        path, query = F.regexp_extract(c, r"^[^:]+://[^/?#]*([^?#]*)", 1), F.regexp_extract(c, r"^[^?#]*\?([^#]*)", 1)
        kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~name(p).startswith("utm_") & ~name(p).isin(DROPPED_PARAMETERS))
        return F.struct(scheme.alias("scheme"), authority.alias("authority"), path.alias("path"), F.array_join(kept, "&").alias("kept"))

    def joined(u: Column) -> Column:
        valid = (u["scheme"] != "") & (u["authority"] != "") & ~u["authority"].contains("@") & ~u["authority"].rlike(r":(?!\d{1,5}$)")
        return F.when(valid, F.concat(u["scheme"], F.lit("://"), u["authority"], u["path"], F.when(u["kept"] != "", F.concat(F.lit("?"), u["kept"])).otherwise(""))).otherwise("")

    return let(let(F.trim(F.coalesce(c, F.lit(""))), parts), joined)


def district_of(c: Column) -> Column:
    """The one district that a place names; otherwise to be confirmed."""
    named = F.filter(F.array(*map(F.lit, DISTRICTS)), lambda d: F.contains(c, d))
    return F.when((F.size(named) == 1) & ~c.rlike("[、→↔]"), named[0]).otherwise("待确认")


def named_district(c: Column) -> Column:
    """The district that a place names in full or in Latin letters, its syllables apart or together; empty if none or several in full."""
    first = lambda tests: F.filter(F.array(*(F.when(test, d) for d, test in tests.items())), lambda d: d.isNotNull())

    def found(text: Column) -> Column:
        full = first({d: text.contains(LONG_NAMES.get(d, d + "区")) for d in DISTRICTS})
        latin = first({d: F.lower(text).rlike(rf"(?<![a-z]){name.replace(' ', '[ ’' + chr(39) + ']?')}(?![a-z])") for d, name in PINYIN.items()})
        return F.when(text.rlike("[、→↔]"), "").otherwise(let(full, lambda f: F.when(F.size(f) > 1, "").otherwise(F.coalesce(F.get(f, F.lit(0)), F.get(latin, F.lit(0)), F.lit("")))))

    return let(clean(c), found)


def cost_free(c: Column) -> Column:
    return clean(c).isin(FREE_TEXTS)


def attendance(mode: Column, place: Column) -> Column:
    place = F.lower(clean(place))
    return F.when(mode.isin("offline", "online", "hybrid", "unknown"), mode).when(place.isin(ONLINE_PLACES), "online").when(place.isin(UNKNOWN_PLACES), "unknown").otherwise("offline")


def date_range(c: Column) -> Column:
    """struct(start, end) of dates: the first full date, up to a second one or a day or month and day after a dash; end exclusive."""
    c = clean(c)
    full = r"(20\d{2})[年./-](\d{1,2})[月./-](\d{1,2})日?"
    whole = F.regexp_extract_all(c, F.lit(full), F.lit(0))

    def day(i: int) -> Column:
        parts = [F.get(F.regexp_extract_all(c, F.lit(full), F.lit(k)), F.lit(i)) for k in (1, 2, 3)]
        return F.expr("try_cast(null as date)") if i > 1 else F.try_to_date(F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0")), "yyyy-MM-dd")

    first, second = day(0), day(1)
    tail = full + r"\s*[—–~至\-]\s*(?:(\d{1,2})月)?(\d{1,2})日"
    month, last = F.regexp_extract(c, tail, 4), F.regexp_extract(c, tail, 5)
    short = F.try_to_date(F.concat_ws("-", F.year(first).cast("string"), F.lpad(F.when(month != "", month).otherwise(F.month(first).cast("string")), 2, "0"), F.lpad(last, 2, "0")), "yyyy-MM-dd")
    end = F.when(F.size(whole) > 1, second).when(last != "", short).otherwise(first)
    return F.when(end >= first, F.struct(first.alias("start"), F.date_add(end, 1).alias("end")))


def blocked(title: Column, url: Column) -> Column:
    """Whether a page is a refusal, by its title or its address."""
    return F.lower(title).rlike("|".join(BLOCKED_TITLES)) | F.contains(url, F.lit("/antispider"))


def cards(pages: DataFrame) -> DataFrame:
    """(page_id, href, label, pos): the links of a page, each address once, at its first place."""
    pattern = F.lit('<a href="([^"]*)"[^>]*>([^<]*)</a>')
    links = F.arrays_zip(F.regexp_extract_all("html", pattern, F.lit(1)).alias("href"), F.regexp_extract_all("html", pattern, F.lit(2)).alias("label"))
    rows = pages.select("page_id", F.posexplode(links).alias("pos", "link")).select("page_id", "link.href", "link.label", F.col("pos").cast("long").alias("pos"))
    return rows.groupBy("page_id", "href").agg(F.min_by("label", "pos").alias("label"), F.min("pos").alias("pos"))


def same_origin(url: Column, hosts: list[str], path: str) -> Column:
    """https, one of the hosts (patterns) or one under it, no port, and a path of the form."""
    return url.rlike(rf"^https://([a-z0-9-]+\.)*(?:{'|'.join(hosts)}){path}([?#].*)?$")


def set_query(url: Column, name: str, value: str) -> Column:
    """The address with one parameter set, without its fragment."""
    base, query = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & (F.split(p, "=")[0] != name))
    return F.concat(base, F.lit("?"), F.array_join(F.concat(kept, F.array(F.lit(f"{name}={value}"))), "&"))


def coords(c: Column) -> Column:
    """struct(lon, lat) of "lon,lat"; else null."""
    parts = F.split(c, ",")
    lon, lat = (F.trim(F.get(parts, F.lit(k))).try_cast("double") for k in (0, 1))
    return F.when((F.size(parts) == 2) & lon.isNotNull() & lat.isNotNull(), F.struct(lon.alias("lon"), lat.alias("lat")))


def decode_tags(c: Column, known: list[str]) -> Column:
    """The known words of a JSON list, each once; none of what is no list."""
    words = F.coalesce(F.from_json(c, "array<string>"), F.expr("array()"))
    return F.array_distinct(F.filter(words, lambda w: w.isin(known)))


def renamed(topics: str, old: str, new: str) -> Column:
    return F.transform(topics, lambda t: F.when(t == old, new).otherwise(t))


def append_note(notes: Column) -> Column:
    """Notes, each once, in order, joined by "; "."""
    return F.array_join(F.array_distinct(F.filter(notes, lambda n: n != "")), "; ")


def topic_rules(c: Column, keywords: dict[str, list[str]]) -> Column:
    """Topics of which a keyword occurs: ASCII words at their boundaries, others anywhere."""
    low = F.lower(F.coalesce(c, F.lit("")))

    def hit(words: list[str]) -> Column:
        """One pattern for all words of a topic."""
        words = [w.lower() for w in words]
        ascii_words, others = ([rf"\Q{w}\E" for w in words if w.isascii() == k] for k in (True, False))
        parts = ([f"(?:^|[^a-z0-9])(?:{'|'.join(ascii_words)})(?![a-z0-9])"] if ascii_words else []) + others
        return low.rlike("|".join(parts)) if parts else F.lit(False)

    found = F.array(*[F.when(hit(words), F.lit(topic)) for topic, words in keywords.items()])
    return F.array_compact(found)


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, with a bit for each character of ``a``; equal beginnings and ends are in it."""
    most = min(len(a), len(b))
    begin = next((k for k in range(most) if a[k] != b[k]), most)
    end = next((k for k in range(most - begin) if a[-1 - k] != b[-1 - k]), most - begin)
    a, b = a[begin : len(a) - end], b[begin : len(b) - end]
    at: dict[str, int] = {}
    for k, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << k
    every = left = (1 << len(a)) - 1
    for y in b:
        hit = left & at.get(y, 0)
        left = ((left + hit) | (left - hit)) & every
    return begin + end + len(a) - left.bit_count()


#: Of texts whose common subsequences are worked out together: most characters of the shorter and the longer one, and texts at a time.
BITS, LONGER, TOGETHER = 64, 128, 4096


def _characters(texts: tuple[str, ...], most: int, none: int) -> np.ndarray:
    """A row of ``most`` characters for each text, filled up with ``none``, which is no character."""
    ends = np.array([len(t) for t in texts])[:, None]
    return np.where(np.arange(most) < ends, np.array(texts, f"U{most}").view("uint32").reshape(-1, most), np.uint32(none))


def commons(a: list[str], b: list[str]) -> np.ndarray:
    """``common`` of many pairs, the bits of ``TOGETHER`` of them worked on at once; long texts one by one."""
    out = np.zeros(len(a), "int64")
    short = [k for k, (x, y) in enumerate(zip(a, b, strict=True)) if x and y and min(len(x), len(y)) <= BITS and max(len(x), len(y)) <= LONGER]
    for k in set(range(len(a))).difference(short) if len(short) < len(a) else ():
        out[k] = common(a[k], b[k])
    for at in range(0, len(short), TOGETHER):
        ks = short[at : at + TOGETHER]
        x, y = zip(*((a[k], b[k]) if len(a[k]) <= len(b[k]) else (b[k], a[k]) for k in ks), strict=True)
        bits = next(n for n in (8, 16, 32, 64) if n >= max(map(len, x)))
        letters, others = (_characters(t, m, none) for t, m, none in ((x, bits, 0xFFFFFFFF), (y, max(map(len, y)), 0xFFFFFFFE)))
        left = np.full(len(ks), ~np.uint64(0))
        for other in np.ascontiguousarray(others.T):
            hit = left & np.packbits((letters == other[:, None]).ravel(), bitorder="little").view(f"<u{bits // 8}")
            left = (left + hit) | (left - hit)
        out[ks] = np.bitwise_count(~left)
    return out


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """200 * longest common subsequence / (len a + len b); 100 of two empty texts."""
    out, known = np.full(len(a), np.nan), (a.notna() & b.notna()).to_numpy()
    x, y = a[known].tolist(), b[known].tolist()
    lengths = np.array([len(s) + len(t) for s, t in zip(x, y, strict=True)], "float64")
    out[known] = np.where(lengths > 0, 200.0 * commons(x, y) / np.maximum(lengths, 1), 100.0)
    return pd.Series(out)

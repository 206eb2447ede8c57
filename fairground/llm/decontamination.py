"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows scans all texts.

Words are runs of digits, a-z (after lower-casing A-Z) and non-ASCII characters.  A window is ``size``
consecutive words of an item; an item of fewer words is one window.  A hash hit counts only once the
words themselves are equal.  The set is measured before it is broadcast: a benchmark of more than ``MAX_BYTES`` is dealt
into parts of at most about that size, and the texts are scanned once for each part, from a written table each time.

Nulls: a null text or item text has no words; an item of null id is left out.  Empty benchmark: no hits.
Repeated rows each get their own result; repeated item ids count once.  ``drop_documents`` and ``remove_spans`` give back
all columns of the documents as they are, whatever their names; ``find_contamination`` puts its three results in the place of
columns of the same names (``prefix`` gives them others).
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairground.llm._shared import batch, column, cut, frugal, table, wider
from fairground.llm._words import LETTERED, LOWER, Block, blocks, covered, inside_windows, owners, sums, windows

WINDOW = 10
#: Of a broadcast part: hashes, words and item ids.
MAX_BYTES = 32 << 20
_FILTER_BITS = 18


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, n, hash, words): every window of every item."""
    schema = pa.schema([("item_id", pa.string()), ("n", pa.int32()), ("hash", pa.int64()), ("words", pa.binary())])

    def scan(batches):
        for rows in batches:
            ids = column(rows, "item_id").to_pylist()
            for first, _, data, offsets in blocks(column(rows, "text")):
                data = LOWER[data]
                block = Block(data, offsets)
                starts, ends, at = block.words(LETTERED)
                hashes, raw, out = block.hashes(starts, ends), data.tobytes(), []
                for i in range(len(offsets) - 1):
                    a, b = int(at[i]), int(at[i + 1])
                    n = min(size, b - a)
                    if n:
                        for j, h in enumerate(windows(hashes[a:b], n).view(np.int64).tolist()):
                            out.append((ids[first + i], n, h, b" ".join(raw[starts[k] : ends[k]] for k in range(a + j, a + j + n))))
                if out:
                    yield batch(schema, *map(list, zip(*out, strict=True)))

    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text")).where("item_id is not null")
    return items.mapInArrow(frugal(scan), "item_id string, n int, hash long, words binary").distinct()


class WindowSet:
    """Windows by length: sorted hashes, a bit filter before them, and the words and item behind each hash, end to end."""

    def __init__(self, rows):
        self.hashes, self.filters, self.words, self.ends, self.items = {}, {}, {}, {}, {}
        for n in sorted({r.n for r in rows}):
            some = sorted((r for r in rows if r.n == n), key=lambda r: (r.hash % (1 << 64), bytes(r.words), r.item_id))
            h = np.array([r.hash for r in some], np.int64).view(np.uint64)
            bits = np.zeros(1 << _FILTER_BITS, bool)
            bits[h >> np.uint64(64 - _FILTER_BITS)] = True
            self.hashes[n], self.filters[n], self.words[n] = h, bits, b"".join(bytes(r.words) for r in some)
            self.ends[n] = np.cumsum([0, *(len(r.words) for r in some)])
            self.items[n] = [r.item_id for r in some]

    def find(self, n: int, h: np.uint64, words: bytes) -> list[str]:
        """The items that have the window."""
        a, b = np.searchsorted(self.hashes[n], h, "left"), np.searchsorted(self.hashes[n], h, "right")
        return [self.items[n][k] for k in range(a, b) if self.words[n][self.ends[n][k] : self.ends[n][k + 1]] == words]

    def scan(self, data: np.ndarray, offsets: np.ndarray):
        """(words of each text, [(text, word, n, items)]) for lower-cased bytes."""
        block = Block(data, offsets)
        starts, ends, at = block.words(LETTERED)
        hashes, found, raw = block.hashes(starts, ends), [], None
        row = owners(at)
        for n, known in self.hashes.items():
            w = windows(hashes, n)
            maybe = np.flatnonzero(self.filters[n][w >> np.uint64(64 - _FILTER_BITS)] & inside_windows(at, n))
            maybe = maybe[known[np.minimum(np.searchsorted(known, w[maybe]), len(known) - 1)] == w[maybe]]
            if len(maybe):
                raw = raw or data.tobytes()
            for j in maybe.tolist():
                words = b" ".join(raw[starts[k] : ends[k]] for k in range(j, j + n))
                if items := self.find(n, w[j], words):
                    found.append((int(row[j]), j, n, items))
        return starts, ends, at, found


def _scan_part(docs: DataFrame, part, text: str, names: list[str]) -> DataFrame:
    """Adds what the windows of one part hit to the columns ``names``: number of words, hits and items."""
    hit_type = pa.list_(pa.struct([("word", pa.int32()), ("from", pa.int32()), ("to", pa.int32())]))
    n_words_name, hits_name, items_name = names
    keep = [c for c in docs.columns if c not in names]
    kind = wider(docs.select(*keep), **dict(zip(names, ("long", "array<struct<word:int,from:int,to:int>>", "array<string>"), strict=True)))

    def scan(batches):
        known = part.value
        for rows in batches:
            before = hits_name in rows.schema.names
            hits = [h or [] for h in column(rows, hits_name).to_pylist()] if before else [[] for _ in range(rows.num_rows)]
            items = [set(x or []) for x in column(rows, items_name).to_pylist()] if before else [set() for _ in range(rows.num_rows)]
            n_words = np.zeros(rows.num_rows, np.int64)
            for first, _, data, offsets in blocks(column(rows, text)):
                starts, ends, at, found = known.scan(LOWER[data], offsets)
                n_words[first : first + len(at) - 1] = np.diff(at)
                by_row = defaultdict(list)
                for i, j, n, of in found:
                    by_row[i].append((j, n))
                    items[first + i].update(of)
                for i, pairs in by_row.items():
                    j, n = np.array(pairs).T
                    base = int(at[i])
                    words = np.flatnonzero(covered(j - base, n, int(at[i + 1]) - base))
                    seen = {h["word"] for h in hits[first + i]}
                    hits[first + i] = hits[first + i] + [{"word": int(k), "from": int(starts[base + k] - offsets[i]), "to": int(ends[base + k] - offsets[i])} for k in words if k not in seen]
            yield pa.RecordBatch.from_arrays([*(column(rows, c) for c in keep), pa.array(n_words), pa.array(hits, hit_type), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names=[*keep, *names])

    return docs.mapInArrow(frugal(scan), kind)


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, max_bytes: int = MAX_BYTES, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` and n_words, hits (word number and byte range in UTF-8), items."""
    found = cut(benchmark_windows(benchmark, size))
    measured = found.agg(F.sum(F.octet_length("words") + F.octet_length("item_id") + 80)).first()[0] or 0
    parts = max(1, math.ceil(1.25 * measured / max_bytes))
    names = [f"{prefix}{c}" for c in ("n_words", "hits", "items")]
    docs = docs.select(*(c for c in docs.columns if c == text or c.lower() not in names))
    for k in range(parts):
        rows = found.where(F.pmod(F.xxhash64("hash"), F.lit(parts)) == k).collect()
        docs = _scan_part(docs, docs.sparkSession.sparkContext.broadcast(WindowSet(rows)), text, names)
        docs = cut(docs) if k + 1 < parts else docs  # no worker holds two parts
    return docs


def digest(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, max_bytes: int = MAX_BYTES) -> DataFrame:
    items = F.array_sort("items")
    return find_contamination(docs.select("doc_id", "text"), benchmark, size, max_bytes).select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def _private(docs: DataFrame) -> str:
    """A prefix under which no column of the documents is."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix


def drop_documents(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents that hold no window, with their own columns."""
    prefix = _private(docs)
    return find_contamination(docs, benchmark, size, prefix=prefix).where(F.size(f"{prefix}hits") == 0).select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents with hit words cut from ``text`` (and what stands between two adjacent hit words)."""

    columns, prefix = docs.columns, _private(docs)

    def clean(batches):
        for rows in batches:
            texts, out = column(rows, "text").to_pylist(), []
            for text, hits in zip(texts, column(rows, f"{prefix}hits").to_pylist(), strict=True):
                if hits:
                    raw, pieces, last, before = text.encode(), [], 0, None
                    for h in sorted(hits, key=lambda h: h["word"]):
                        if before is None or h["word"] != before + 1:
                            pieces.append(raw[last : h["from"]])
                        last, before = h["to"], h["word"]
                    text = b"".join([*pieces, raw[last:]]).decode()
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == "text" else column(rows, n) for n in columns], names=columns)

    return find_contamination(docs, benchmark, size, prefix=prefix).mapInArrow(frugal(clean), docs.schema)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP1_SQL = r"""
with recursive d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null),
bw as (select distinct item_id, least(10, len(w)) as n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as g
       from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
dw as (select r, n, i, array_to_string(w[i:i + n - 1], ' ') as g
       from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from bw) where len(w) >= n)),
hit as (select r, i, dw.n, item_id from dw join bw using (n, g)),
words as (select r, count(distinct k) as n_hit from (select r, unnest(range(i, i + n)) as k from (select distinct r, i, n from hit)) group by r),
items as (select r, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as s from hit group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (r) left join items using (r)
"""

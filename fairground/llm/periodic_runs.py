"""Runs of words that repeat with a period, by suffix trees.

A run is a stretch of words with smallest period q, at least ``max(LEAST, 2 * q)`` long, that no neighbouring word
extends.  For each stretch of a text in which runs can lie, Ukkonen's algorithm builds the suffix trees of the stretch and
of its reversal.  The order of a tree's leaves, under an order of the words and under the reverse order, gives the
longest Lyndon word at each place: it ends where the next smaller suffix begins.  Each is the candidate for a run's root.
How far its period goes on to the right and to the left are longest common extensions, each the depth of the lowest common
ancestor of two leaves: the least depth in a range of the Euler tour, from a table of ranges of powers of two, in
constant time.  Every run has a root among the candidates, so all runs are found, in about linear time.

Where runs can lie: the words of a run but its last q form windows of ``LEAST // 2`` words, each found again q places
on; of B consecutive windows, those found again more than ``B + LEAST // 2 - 1`` places on are of no run (``stretches``).
The windows' hashes only point to stretches; the trees compare the words themselves.

Texts are taken whole, each by itself, and nothing is shuffled.  A null or empty text has no words, no runs and an empty
text left.  Null ids, repeated rows and other columns don't matter; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fairground.llm._shared import batch, column, frugal, table
from fairground.llm._stats import SALT
from fairground.llm._words import SPACED, Block, blocks, inside_windows, mix, owners, spans, windows

LEAST = 12


def suffix_tree(symbols: list[int], size: int) -> tuple[dict[int, int], list[int], list[int]]:
    """Ukkonen's tree of ``symbols``, whose last is found nowhere else: (children, begins, ends).

    ``children`` has the child of node v along symbol c at ``v * size + c``; node 0 is the root; the edge into a node
    is ``symbols[begins[v]:ends[v]]``.
    """
    n = len(symbols)
    children: dict[int, int] = {}
    begins, ends, links = [0], [0], [0]
    node = edge = length = waiting = 0
    for i, c in enumerate(symbols):
        waiting += 1
        unlinked = 0
        while waiting:
            if not length:
                edge = i
            key = node * size + symbols[edge]
            child = children.get(key)
            if child is None:
                children[key] = len(begins)
                begins.append(i)
                ends.append(n)
                links.append(0)
                if unlinked:
                    links[unlinked] = node
                    unlinked = 0
            else:
                begin = begins[child]
                span = min(ends[child], i + 1) - begin
                if length >= span:
                    node, edge, length = child, edge + span, length - span
                    continue
                if symbols[begin + length] == c:
                    length += 1
                    if unlinked:
                        links[unlinked] = node
                    break
                middle = len(begins)
                children[key] = middle
                begins += (begin, i)
                ends += (begin + length, n)
                links += (0, 0)
                begins[child] = begin + length
                children[middle * size + c] = middle + 1
                children[middle * size + symbols[begin + length]] = child
                if unlinked:
                    links[unlinked] = middle
                unlinked = middle
            waiting -= 1
            if node:
                node = links[node]
            elif length:
                length -= 1
                edge = i - waiting + 1
    return children, begins, ends


class Extensions:
    """Longest common extensions of the suffixes of a list of symbols, and the order of its suffixes."""

    def __init__(self, symbols: list[int], size: int):
        n = len(symbols)
        children, begins, ends = suffix_tree(symbols, size)
        keys = np.fromiter(children.keys(), np.int64, len(children))
        self._parents, self._symbols = keys // size, keys % size
        self._nodes = np.fromiter(children.values(), np.int64, len(children))
        self._spans = np.array(ends, np.int64) - np.array(begins, np.int64)
        self._n = n
        below, at = self._below(self._symbols)
        # The Euler tour: a node's depth when it is entered, and its parent's when it is left.
        tour: list[int] = []
        depths, first = [0] * len(begins), [0] * n
        spans_, stack = self._spans.tolist(), [0]
        while stack:
            v = stack.pop()
            if v < 0:
                tour.append(depths[~v])
                continue
            depth = depths[v]
            begin, end = at[v], at[v + 1]
            if begin == end:
                first[n - depth] = len(tour)
            tour.append(depth)
            for child in below[begin:end]:
                depths[child] = depth + spans_[child]
                stack += (~v, child)
        self._depths = depths
        self._first = np.array(first, np.int64)
        level = np.array(tour, np.int32)
        self._table = [level]
        for k in range(len(level).bit_length() - 1):
            level = np.minimum(level[: len(level) - (1 << k)], level[1 << k :])
            self._table.append(level)

    def _below(self, order: np.ndarray) -> tuple[list[int], list[int]]:
        """Each node's children, the largest in ``order`` first, one node after another; and where they begin."""
        place = np.lexsort((-order, self._parents))
        counts = np.bincount(self._parents, minlength=len(self._spans))
        return self._nodes[place].tolist(), np.concatenate([[0], np.cumsum(counts)]).tolist()

    def next_smaller(self, reverse: bool) -> np.ndarray:
        """For each suffix the next one that is smaller; symbol 0 is the smallest in both orders."""
        below, at = self._below(np.where(self._symbols == 0, 0, (1 << 40) - self._symbols) if reverse else self._symbols)
        n, depths = self._n, self._depths
        ranks, stack, rank = [0] * n, [0], 0
        while stack:
            v = stack.pop()
            begin, end = at[v], at[v + 1]
            if begin == end:
                ranks[n - depths[v]] = rank
                rank += 1
            else:
                stack += below[begin:end]
        out, stack = [n] * n, []
        for i in range(n - 1, -1, -1):
            r = ranks[i]
            while stack and ranks[stack[-1]] > r:
                stack.pop()
            if stack:
                out[i] = stack[-1]
            stack.append(i)
        return np.array(out, np.int64)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common beginning of the suffixes at ``a`` and at ``b``, which differ."""
        a, b = self._first[a], self._first[b]
        low, high = np.minimum(a, b), np.maximum(a, b)
        power = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(power):
            x = power == k
            out[x] = np.minimum(self._table[k][low[x]], self._table[k][high[x] - (1 << int(k)) + 1])
        return out


def runs_of(words: list, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of the runs of ``words``, each once, by start and then period."""
    numbers: dict = {}
    symbols = [numbers.setdefault(w, len(numbers) + 1) for w in words]
    n, size = len(symbols), len(numbers) + 1
    if n < least:
        return np.zeros((0, 3), np.int64)
    forward = Extensions([*symbols, 0], size)
    starts = np.arange(n)
    roots = np.concatenate([np.stack([starts, forward.next_smaller(reverse)[:n]]) for reverse in (False, True)], axis=1)
    right = forward.common(roots[0], roots[1])
    del forward
    left = Extensions([*symbols[::-1], 0], size).common(n - roots[0], n - roots[1])
    begin, end, period = roots[0] - left, roots[1] + right, roots[1] - roots[0]
    keep = (end - begin >= 2 * period) & (end - begin >= least)
    found = np.stack([begin, end - begin, period], axis=1)[keep]
    return np.unique(found[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def stretches(hashes: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(begins, ends) of stretches of words, none across texts, that hold all runs; they don't overlap."""
    none = np.zeros(0, np.int64)
    size = least // 2
    keys = windows(hashes, size)
    at = np.flatnonzero(inside_windows(offsets, size))
    row = owners(offsets)
    # Equal windows of one text, in order of place: the distance to the next of them.
    keys = mix(keys[at] + row[at].astype(np.uint64) * SALT)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    order = at[order]
    place, distance = order[:-1][same], np.diff(order)[same]
    by = np.argsort(place)
    place, distance = place[by], distance[by]
    while len(place):
        new = np.concatenate([[True], (np.diff(place) != 1) | (row[place[1:]] != row[place[:-1]])])
        block = np.cumsum(new) - 1
        length = np.bincount(block)[block]
        near = distance < length + size
        if near.all():
            first = place[new]
            reach = first + 2 * (length[new] + size - 1) + 1
            begin, end = first, np.minimum(reach, offsets[row[first] + 1])
            apart = np.concatenate([[True], begin[1:] >= np.maximum.accumulate(end)[:-1]])
            return begin[apart], np.maximum.reduceat(end, np.flatnonzero(apart))
        place, distance = place[near], distance[near]
    return none, none


def text_runs(words: list[bytes], found: list[tuple[int, int]], least: int = LEAST) -> np.ndarray:
    """All runs of ``words``, which lie in the stretches ``found``."""
    n, out = len(words), []
    for begin, end in found:
        for start, length, period in runs_of(words[begin:end], least).tolist():
            start += begin
            stop = start + length
            # What a stretch's edge cuts is whole in another stretch.
            if not (start and words[start - 1] == words[start - 1 + period]) and not (stop < n and words[stop] == words[stop - period]):
                out.append((start, length, period))
    return np.array(sorted(set(out), key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def collapsed(n: int, runs: np.ndarray) -> np.ndarray:
    """Which words stay when of each run the first period alone stays."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge)[:n] == 0


SCHEMA = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
#: (ids, numbers of words) -> (first word that is replaced, period by which it is), or -1 for texts that stay.
Rewrite = Callable[[list, np.ndarray], tuple[np.ndarray, np.ndarray]]


def periodic_runs(docs: DataFrame, least: int = LEAST, rewrite: Rewrite | None = None, texts: bool = False) -> DataFrame:
    """One row a document: the number of runs, the longest one (of equals the one that starts first, then that of least
    period), digests of all runs and of the text in which each run is collapsed to its first period; with ``texts``
    also that text itself (``collapsed``)."""
    schema = SCHEMA.append(pa.field("collapsed", pa.string())) if texts else SCHEMA

    def scan(batches):
        for rows in batches:
            ids = column(rows, "doc_id")
            for first, end, data, offsets in blocks(column(rows, "text")):
                starts, stops, at = spans(SPACED[data], offsets)
                raw, counts = data.tobytes(), np.diff(at)
                some = ids.slice(first, end - first)
                bent = np.zeros(end - first, bool)
                if rewrite is not None:
                    a, p = rewrite(some.to_pylist(), counts)
                    bent = a >= 0
                    source = np.arange(len(starts))
                    for r in np.flatnonzero(bent):
                        begin = at[r] + a[r]
                        source[begin : at[r + 1]] = begin + np.arange(at[r + 1] - begin) % p[r]
                    starts, stops = starts[source], stops[source]
                begins, ends = stretches(Block(data, offsets).hashes(starts, stops), at, least)
                of = np.searchsorted(at, begins, "right") - 1
                held: dict[int, list[tuple[int, int]]] = {}
                for r, b, e in zip(of.tolist(), begins.tolist(), ends.tolist(), strict=True):
                    held.setdefault(r, []).append((b - int(at[r]), e - int(at[r])))
                result = []
                for r in range(end - first):
                    if bent[r]:
                        words = [raw[b:e] for b, e in zip(starts[at[r] : at[r + 1]].tolist(), stops[at[r] : at[r + 1]].tolist(), strict=True)]
                    else:
                        words = raw[offsets[r] : offsets[r + 1]].split()  # at the same bytes
                    runs = text_runs(words, held[r], least) if r in held else ()
                    best, log = (None,) * 4, b""
                    if len(runs):
                        words = [w for w, stays in zip(words, collapsed(len(words), runs).tolist(), strict=True) if stays]
                        start, length, period = min(runs.tolist(), key=lambda x: (-x[1], x[0], x[2]))
                        best = start, length, period, 1000 * length // period
                        log = b"".join(b"%d,%d,%d\n" % tuple(x) for x in runs.tolist())
                    left = b" ".join(words)
                    result.append((len(runs), *best, hashlib.sha256(log).hexdigest(), hashlib.sha256(left).hexdigest(), *([left.decode()] if texts else [])))
                yield batch(schema, some, *zip(*result, strict=True))

    kind = f"{RESULT}, collapsed string" if texts else RESULT
    return docs.select("doc_id", "text").mapInArrow(frugal(scan), kind)


def planted(ids: list, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the query's rule makes periodic: of ids whose checksum is divisible by 10, all words from one on."""
    a, p = np.full(len(ids), -1, np.int64), np.ones(len(ids), np.int64)
    for r, (i, n) in enumerate(zip(ids, counts.tolist(), strict=True)):
        h = None if i is None else zlib.crc32(b"%d" % i)
        if n and h is not None and not h % 10:
            g = h // 10
            a[r] = g % n
            p[r] = 1 + (n - a[r]) // (3 + g % 8)
    return a, p


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), rewrite=planted)

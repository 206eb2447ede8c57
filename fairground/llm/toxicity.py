"""Toxicity by Levenshtein automata intersected with a lexicon trie, weighted by context windows.

The lexicon is learned from labelled training rows: words and word beginnings that toxic documents have
significantly more often than others (log-likelihood ratio of at least ``LEAST_RATIO``, odds of at least ``LEAST_ODDS``),
if they are in ``FREQUENT`` of all toxic documents; a rarer one is taken as long as it is significant in the documents that no
term before it is in, so that what copies of a toxic document say besides is no term.  Its trie and the Levenshtein automaton of one edit (also a swap of neighbours) are intersected and made deterministic once; a
word is then matched in one walk over its bytes, all words of a block side by side.  Words and beginnings of at least
``LEAST_FUZZY`` bytes match with up to one edit, shorter ones exactly.

Each match is looked at in a window of ``WINDOW_BYTES`` on both sides: it is quoted if an opening mark before it is still
open, and closed behind it, so ``"hi" you moron "bye"`` quotes nothing but the greetings.  A cell (term, edits, quoted) has the
probability of label 1 that the training rows show for it, smoothed.  A cell that they don't show takes a share of its exact or
unquoted one, the more the more clean rows don't show it.  A document's score is the noisy-or of what its cells have above the share
of toxic rows, and of the base rate of documents without a match.

Training rows are labelled rows whose crc32(doc_id as text) mod 5 is not 0, at most ``SAMPLE_ROWS`` of them, taken
by hash of the id; their labels are broadcast to the texts.  Empty and null texts have no match and the base score.  Null ids
are never training rows and not held out.  Without toxic training rows the lexicon is empty and every score is the base rate.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairground.llm._shared import batch, column, cut, frugal, labelled_texts, table
from fairground.llm._words import LETTERED, LOWER, Block, blocks, owners
from fairground.llm.quality_classifier import held_out

SAMPLE_ROWS = 20_000
#: A chance finding reaches this ratio (2 ln) about once in 5,000 terms without the odds.
LEAST_RATIO = 14.0
LEAST_ODDS = 20.0
LEAST_TOXIC = 3
FREQUENT = 0.02
LEAST_FREQUENT = 5
PREFIXES = range(4, 11)
LEAST_FUZZY = 5
WINDOW_BYTES = 48
#: (opening, closing) marks of a quotation.
QUOTES = [('"', '"'), ("“", "”"), ("«", "»"), ("»", "«"), ("„", "“"), ("„", "”"), ("‘", "’")]
QUOTED_SHARE = 1 / 3
EDITED_SHARE = 0.8
#: So many clean rows without an edited term speak for half of that.
EDITED_ROWS = 500


def _beginnings(data: np.ndarray, offsets: np.ndarray):
    """(length or 0 for whole words, text, hash, start, end) of each distinct beginning in each text."""
    block = Block(data, offsets)
    starts, ends, at = block.words(LETTERED)
    row = owners(at)
    padded = np.append(data, np.uint8(0))
    for n in (0, *PREFIXES):
        keep = np.flatnonzero(ends - starts >= max(n, PREFIXES[0]))
        if n:
            keep = keep[(padded[starts[keep] + n] & 0xC0) != 0x80]
        b, e = starts[keep], (starts[keep] + n if n else ends[keep])
        h = block.hashes(b, e)
        _, one = np.unique(np.stack([row[keep].astype(np.uint64), h]), axis=1, return_index=True) if len(h) else (None, np.zeros(0, int))
        yield n, row[keep][one], h[one], b[one], e[one]


def learn_terms(train: DataFrame) -> list[tuple[str, bool]]:
    """(term, whole word) from (text, label): see the module's text."""
    schema = pa.schema([("n", pa.int32()), ("term", pa.binary()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def count(batches):
        for rows in batches:
            labels = column(rows, "label").to_numpy()
            for first, end, data, offsets in blocks(column(rows, "text")):
                data = LOWER[data]
                raw, own = data.tobytes(), labels[first:end]
                for n, row, h, b, e in _beginnings(data, offsets):
                    if not len(h):
                        continue
                    _, one, group = np.unique(h, return_index=True, return_inverse=True)
                    toxic = np.bincount(group, own[row] == 1, len(one)).astype(np.int64)
                    clean = np.bincount(group, own[row] == 0, len(one)).astype(np.int64)
                    yield batch(schema, np.full(len(one), n), [raw[x:y] for x, y in zip(b[one], e[one], strict=True)], toxic, clean)

    sizes = {r.label: r["count"] for r in train.groupBy("label").count().collect()}
    odds = (F.col("toxic") / max(1, sizes.get(1, 0))) / ((F.col("clean") + 0.5) / max(1, sizes.get(0, 0)))
    found = train.mapInArrow(frugal(count), "n int, term binary, toxic long, clean long").groupBy("n", "term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # What is frequent in a bounded sample is bounded by it.
    found = [r for r in found.where((F.col("toxic") >= LEAST_TOXIC) & (odds >= LEAST_ODDS)).collect() if _ratio(r.toxic, r.clean, sizes[1], sizes.get(0, 0)) >= LEAST_RATIO]
    clean = {(r.n, bytes(r.term)): r.clean for r in found}
    begins = {(r.n, bytes(r.term)): r.toxic for r in found}
    terms: dict[bytes, int] = {}
    for n, term in sorted((k for k in begins if k[0]), key=lambda k: (k[0], k[1])):
        if any(term.startswith(t) for t in terms):
            continue
        best = term
        while True:  # as long as a longer beginning is as frequent, it says the same more exactly
            longer = [t for k, t in begins if k == len(best) + 1 and t.startswith(best)]
            longer = max(longer, key=lambda t: (begins[len(best) + 1, t], t), default=None)
            if longer is None or begins[len(longer), longer] < 0.95 * begins[n, term]:
                break
            best = longer
        terms[term] = begins[n, term]
        begins[-1, term] = best
    out = []
    for term in sorted(terms, key=lambda t: (-terms[t], t)):
        best = begins[-1, term]
        whole = [t for k, t in begins if k == 0 and t.startswith(best) and begins[0, t] >= 0.9 * terms[term]]
        out.append((whole[0], True) if whole else (best, False))
    return cover(train, sorted(set(out)), {t: clean.get((0 if w else len(t), t), 0) for t, w in out}, sizes)


def cover(train: DataFrame, terms: list[tuple[bytes, bool]], clean: dict[bytes, int], sizes: dict[int, int]) -> list[tuple[str, bool]]:
    """The frequent terms, and of the others those that are significant in the toxic documents that no term before is in."""
    whole, begins = {t for t, w in terms if w}, {t for t, w in terms if not w}
    lengths = sorted({len(t) for t in begins})

    def holds(batches):
        for rows in batches:
            out = []
            for _, _, data, offsets in blocks(column(rows, "text")):
                data = LOWER[data]
                raw, (starts, ends, at) = data.tobytes(), Block(data, offsets).words(LETTERED)
                for a, b in itertools.pairwise(at.tolist()):
                    words = {raw[x:y] for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)}
                    out.append(sorted(words & whole | {w[:n] for w in words for n in lengths if w[:n] in begins}))
            yield batch(schema, out)

    schema = pa.schema([("terms", pa.list_(pa.binary()))])
    left = [{bytes(t) for t in r.terms} for r in train.where("label = 1").mapInArrow(frugal(holds), "terms array<binary>").collect()]
    counts, of = Counter(t for d in left for t in d), dict(terms)
    frequent = {t for t, k in counts.items() if k >= max(LEAST_FREQUENT, FREQUENT * len(left))}
    found = [(t.decode(), of[t]) for t in frequent]
    left = [d for d in left if not d & frequent]
    while left:
        counts = Counter(t for d in left for t in d)
        k, term = max(((k, t) for t, k in counts.items() if _ratio(k, clean[t], len(left), sizes.get(0, 0)) >= LEAST_RATIO), default=(0, None))
        if term is None:
            break
        found.append((term.decode(), of[term]))
        left = [d for d in left if term not in d]
    return sorted(found)


def _ratio(toxic: int, clean: int, n1: int, n0: int) -> float:
    """2 ln of the likelihood of the counts at two rates against one rate."""
    part = lambda k, n: k * math.log(k / n) if k else 0.0
    apart = part(toxic, n1) + part(n1 - toxic, n1) + part(clean, n0) + part(n0 - clean, n0)
    return 2 * (apart - part(toxic + clean, n1 + n0) - part(n1 + n0 - toxic - clean, n1 + n0))


class Automaton:
    """The trie of the terms intersected with the automaton of one edit, as one deterministic table."""

    def __init__(self, terms: list[tuple[str, bool]], least_fuzzy: int = LEAST_FUZZY):
        self.terms = terms
        words = [t.encode() for t, _ in terms]
        alphabet = sorted({b for w in words for b in w})
        self.kinds = np.zeros(256, np.int64)
        self.kinds[alphabet] = np.arange(1, len(alphabet) + 1)
        symbols = len(alphabet) + 1
        trie: list[dict[int, int]] = [{}]
        whole: dict[int, int] = {}
        begin: dict[int, int] = {}
        longest = [0]
        for k, (w, (_, is_word)) in enumerate(zip(words, terms, strict=True)):
            node = 0
            for b in w:
                if b not in trie[node]:
                    trie.append({})
                    longest.append(0)
                    trie[node][b] = len(trie) - 1
                longest[node] = max(longest[node], len(w))
                node = trie[node][b]
            longest[node] = max(longest[node], len(w))
            (whole if is_word else begin)[node] = k

        # Elements: (node, edits), ("swap", node, awaited byte), ("in", term, edits): a beginning that has been read.
        def closed(elements):
            todo, seen = list(elements), set()
            while todo:
                e = todo.pop()
                if e in seen:
                    continue
                seen.add(e)
                if isinstance(e[0], int):
                    node, edits = e
                    if node in begin:
                        todo.append(("in", begin[node], edits))
                    if edits == 0 and longest[node] >= least_fuzzy:
                        todo += [(child, 1) for child in trie[node].values()]
            return frozenset(seen)

        def step(state, symbol):
            byte, out = (alphabet[symbol - 1] if symbol else None), []
            for e in state:
                if e[0] == "in":
                    out.append(e)
                elif e[0] == "swap":
                    if e[2] == byte:
                        out.append((e[1], 1))
                else:
                    node, edits = e
                    if byte in trie[node]:
                        out.append((trie[node][byte], edits))
                    if edits == 0 and longest[node] >= least_fuzzy:
                        out.append((node, 1))
                        for b, child in trie[node].items():
                            out.append((child, 1))
                            if byte in trie[child]:
                                out.append(("swap", trie[child][byte], b))
            return closed(out)

        start = closed([(0, 0)])
        numbers, order, rows = {frozenset(): 0, start: 1}, [frozenset(), start], []
        for state in order:
            row = []
            for symbol in range(symbols):
                after = step(state, symbol) if state else state
                if after not in numbers:
                    numbers[after] = len(order)
                    order.append(after)
                row.append(numbers[after])
            rows.append(row)
        self.table = np.array(rows, np.int32)
        #: 2 * term + edits of the best match, or -1
        def accepted(e) -> int | None:
            term, edits = (e[1], e[2]) if e[0] == "in" else (whole.get(e[0]), e[1])
            # A short term shares its first bytes with longer ones, and with them edits that it doesn't allow.
            return None if term is None or edits and len(words[term]) < least_fuzzy else 2 * term + edits

        self.accepts = np.array([min((x for e in s if (x := accepted(e)) is not None), key=lambda x: (x % 2, x), default=-1) for s in order])
        self.steps = max(map(len, words), default=0) + 2

    def match(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which words, 2 * term + edits)"""
        state, alive, lengths = np.ones(len(starts), np.int32), np.arange(len(starts)), ends - starts
        for i in range(self.steps):
            alive = alive[lengths[alive] > i]
            state[alive] = self.table[state[alive], self.kinds[data[starts[alive] + i]]]
            alive = alive[state[alive] > 0]
        found = self.accepts[state]
        hit = np.flatnonzero(found >= 0)
        return hit, found[hit]


_QUOTE = re.compile("|".join(sorted({m for pair in QUOTES for m in pair})).encode())
_CLOSES = {a.encode(): {c.encode() for o, c in QUOTES if o == a} for a, _ in QUOTES}


def quoted(before: bytes, after: bytes) -> bool:
    """Whether a mark that is opened before is closed behind."""
    still: list[bytes] = []
    for m in _QUOTE.findall(before):
        if still and m in _CLOSES[still[-1]]:
            still.pop()
        elif m in _CLOSES:
            still.append(m)
    return bool(still) and any(m in _CLOSES[still[-1]] for m in _QUOTE.findall(after))


def cells(automaton: Automaton, data: np.ndarray, offsets: np.ndarray):
    """Distinct (text, 4 * term + 2 * edits + quoted) of a block of bytes as they stand."""
    low = LOWER[data]
    starts, ends, at = Block(low, offsets).words(LETTERED)
    hit, found = automaton.match(low, starts, ends)
    row, raw, out = owners(at)[hit], data.tobytes(), set()
    for w, r, f in zip(hit.tolist(), row.tolist(), found.tolist(), strict=True):
        before = raw[max(int(offsets[r]), int(starts[w]) - WINDOW_BYTES) : starts[w]]
        after = raw[ends[w] : min(int(offsets[r + 1]), int(ends[w]) + WINDOW_BYTES)]
        out.add((r, 2 * f + quoted(before, after)))
    return out


class Scorer:
    def __init__(self, automaton: Automaton, base: float, weights: dict[int, float], edited: float = EDITED_SHARE):
        self.automaton, self.base, self.weights, self.edited = automaton, base, weights, edited

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        clean = np.full(len(offsets) - 1, 1 - self.base)
        for r, cell in cells(self.automaton, data, offsets):
            clean[r] *= 1 - self.weight(cell)
        return 1 - clean

    def weight(self, cell: int) -> float:
        if cell in self.weights:
            return self.weights[cell]
        if cell & 1:
            return QUOTED_SHARE * self.weight(cell & ~1)
        return self.edited * self.weight(cell & ~2) if cell & 2 else 0.0


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Scorer:
    train = cut(labelled_texts(docs, labels.where(~held_out("doc_id", 5, 0)), "toxic", sample_rows))
    automaton = Automaton(learn_terms(train))
    schema = pa.schema([("cell", pa.int32()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def count(batches):
        for rows in batches:
            label = column(rows, "label").to_pylist()
            for first, end, data, offsets in blocks(column(rows, "text")):
                found = cells(automaton, data, offsets)
                hit = {r for r, _ in found}
                pairs = [*((c, label[first + r]) for r, c in found), *((-1, label[first + r]) for r in range(end - first) if r not in hit)]
                yield batch(schema, [c for c, _ in pairs], [int(y == 1) for _, y in pairs], [int(y == 0) for _, y in pairs])

    seen = train.mapInArrow(frugal(count), "cell int, toxic long, clean long").groupBy("cell").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).collect()
    counts = {r.cell: (r.toxic, r.clean) for r in seen}
    n1, n0 = (train.where(f"label = {k}").count() for k in (1, 0))
    prior = n1 / max(1, n1 + n0)
    t, c = counts.pop(-1, (0, 0))
    weights = {k: max(0.0, ((t + 0.05) / (t + c + 1) - prior) / max(1e-9, 1 - prior)) for k, (t, c) in counts.items() if not k & 1 or t + c >= 5}
    return Scorer(automaton, (t + 0.01) / (t + c + 1), weights, EDITED_SHARE * n0 / (n0 + EDITED_ROWS))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    scorer = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def scan(batches):
        for rows in batches:
            ids = column(rows, "doc_id")
            for first, end, data, offsets in blocks(column(rows, "text")):
                score = scorer.value.score(data, offsets)
                yield batch(schema, ids.slice(first, end - first), score, (score >= 0.5).astype(np.int32))

    scored = docs.select("doc_id", "text").mapInArrow(frugal(scan), "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

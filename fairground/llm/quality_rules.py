"""Quality rules as a short-circuit cascade.

Each rule's cost (seconds) and selectivity (texts that it rejects) are estimated on a sample of about
``SAMPLE_ROWS`` texts, measured where they lie; the rules then run in order of rejections per second.  Once the texts
rejected so far make up a sixteenth of a block, the rules that follow look at the others alone, and keep what has
been counted of those.  The order changes the work, never the verdict.

Null texts have no words and fail ``too_short``.  Rows with null ids, repeated rows and extra columns are handled as any
other; an empty table gives an empty table.  ``judge`` and ``passing`` take nothing from a table's other columns;
``apply_rules`` puts its result in the place of a column of the same name (``to``).
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairground.llm._shared import batch, column, frugal, table, wider
from fairground.llm._stats import Stats
from fairground.llm._words import blocks

Rule = Callable[[Stats], np.ndarray]

#: Rules of the base verdict: name -> which texts are rejected.
BASE_RULES: dict[str, Rule] = {
    "too_short": lambda s: s.n_words < 10,
    "repeats_itself": lambda s: 100 * s.n_repeat_words > 20 * s.n_words,
}
#: Rules of the cascade itself.
CASCADE_RULES: dict[str, Rule] = {
    "symbols": lambda s: 10 * s.n_symbols > 3 * s.n_words,
    "shouting": lambda s: (100 * s.n_upper > 50 * s.n_letters) & (s.n_letters > 0),
    "exclaims": lambda s: 100 * s.n_shouts > 50 * s.n_words,
    "duplicate_lines": lambda s: 100 * s.n_dup_lines > 50 * s.n_lines,
    "word_length": lambda s: (s.word_chars < 2 * s.n_words) | (s.word_chars > 25 * s.n_words),
    "digits": lambda s: 100 * s.n_digits > 50 * np.maximum(s.word_chars, 1),
    "vocabulary": lambda s: (s.n_words >= 50) & (100 * s.n_distinct < 10 * np.minimum(s.n_words, 2000)),
}
SAMPLE_ROWS = 512


def cascade(stats: Stats, rules: dict[str, Rule], order: list[str]) -> np.ndarray:
    """For each text, the place in ``order`` of the rule that rejected it, or -1."""
    found = np.full(len(stats.offsets) - 1, -1)
    rows = np.arange(len(found))
    for place, name in enumerate(order):
        bad = rules[name](stats)
        found[rows[bad & (found[rows] < 0)]] = place
        alive, size = found[rows] < 0, np.diff(stats.offsets)
        if not alive.any():
            break
        if 16 * size[alive].sum() <= 15 * size.sum() and not alive.all():
            stats, rows = stats.some(alive), rows[alive]
    return found


def estimate_order(texts: DataFrame, rules: dict[str, Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rules by rejections per second on a sample of about ``sample_rows`` texts; ties by name."""
    names = sorted(rules)

    def measure(batches):
        for rows in batches:
            for _, _, data, offsets in blocks(column(rows, "text")):
                cost, bad, words = [], [], Stats(data, offsets).words
                for name in names:
                    stats = Stats(data, offsets)
                    stats._kept["words"] = words  # nearly all rules need them, so they cost none of them
                    began = time.perf_counter()
                    bad.append(int(rules[name](stats).sum()))
                    cost.append(time.perf_counter() - began)
                yield batch(schema, names, cost, bad)

    schema = pa.schema([("rule", pa.string()), ("cost", pa.float64()), ("bad", pa.int64())])
    share = min(1.0, sample_rows / max(1, texts.count()))
    sample = texts.select(F.col(text).alias("text")).sample(share, 7)
    seen = sample.mapInArrow(frugal(measure), "rule string, cost double, bad long").groupBy("rule").agg(F.sum("cost").alias("cost"), F.sum("bad").alias("bad")).collect()
    gain = {r.rule: r.bad / max(r.cost, 1e-9) for r in seen}
    return sorted(names, key=lambda n: (-gain.get(n, 0.0), n))


def apply_rules(docs: DataFrame, rules: dict[str, Rule] | None = None, text: str = "text", order: list[str] | None = None, to: str = "rejected_by") -> DataFrame:
    """``docs`` with the first rule in cost order that rejects the text, or null."""
    rules = rules or BASE_RULES | CASCADE_RULES
    order = order or estimate_order(docs, rules, text)

    def scan(batches):
        for rows in batches:
            found = [cascade(Stats(data, offsets), rules, order) for _, _, data, offsets in blocks(column(rows, text))]
            names = [order[i] if i >= 0 else None for f in found for i in f]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(names, pa.string())], names=[*rows.schema.names, to])

    docs = docs.select(*(c for c in docs.columns if c == text or c.lower() != to.lower()))
    return docs.mapInArrow(frugal(scan), wider(docs, **{to: "string"}))


def passing(docs: DataFrame, rules: dict[str, Rule] | None = None, text: str = "text", order: list[str] | None = None) -> DataFrame:
    """The documents that no rule rejects, with their own columns."""
    rules = rules or BASE_RULES | CASCADE_RULES
    order = order or estimate_order(docs, rules, text)

    def scan(batches):
        for rows in batches:
            found = [cascade(Stats(data, offsets), rules, order) < 0 for _, _, data, offsets in blocks(column(rows, text))]
            yield rows.filter(pa.array(np.concatenate([np.zeros(0, bool), *found])))

    return docs.mapInArrow(frugal(scan), docs.schema)


def judge(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The base counts and the verdict for every document: see the module's text for nulls."""
    docs = docs.select("doc_id", "text")
    order = order or estimate_order(docs, CASCADE_RULES)
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_())])

    def scan(batches):
        for rows in batches:
            ids = column(rows, "doc_id")
            for first, end, data, offsets in blocks(column(rows, "text")):
                s = Stats(data, offsets)
                counts = [s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words]
                failed = np.logical_or.reduce([rule(s) for rule in BASE_RULES.values()])
                kept = ~failed
                kept[kept] = cascade(s.some(kept), CASCADE_RULES, order) < 0
                yield batch(schema, ids.slice(first, end - first), *counts, failed, kept)

    return docs.mapInArrow(frugal(scan), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))

"""Whitening, periodic runs and secret scans against brute force, and their odd tables."""

import base64
import bz2
import gzip
import hashlib
import random
import re
import urllib.parse
import zlib

import numpy as np
import pytest

from fairground.llm import periodic_runs, queries, secret_scan, whitening

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, n_runs string, start map<string,string>, spans long"


# Whitening


def plain_whitening(vectors):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    centred = x - s / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return ((n * x - s) ** 2).sum(1), centred @ v[:, ::-1], e[::-1]


def check_whitening(rows, ids, vectors, components):
    deviation, projected, e = plain_whitening(vectors)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == len(ids) * components
    for c in range(components):
        z = np.array([got[i, c + 1].whitened for i in ids])
        want = projected[:, c] / np.sqrt(e[c])
        assert np.allclose(z * np.sign(z @ want), want, atol=1e-8)
    assert all(got[i, 1].deviation == d and got[i, 1].n == len(ids) for i, d in zip(ids, deviation.tolist(), strict=True))
    assert np.allclose([got[ids[0], c + 1].explained for c in range(components)], e[:components] / e.sum(), rtol=1e-9)
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-9


def test_whitening_equals_plain_numpy(spark):
    have = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    check_whitening(queries.QUERIES["op11_embedding_whitening"](spark, SF).collect(), [r.vec_id for r in have], [r.embedding for r in have], 32)


def write(spark, tmp_path, rows, kind, name="embeddings"):
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_whitening_drops_what_is_no_vector(spark, tmp_path):
    rng = np.random.default_rng(3)
    good = rng.normal(size=(40, 5)).tolist()
    odd = [(100, None, "a"), (101, [1.0, None, 2.0, 3.0, 4.0], "b"), (102, [float("nan")] * 5, "c"), (103, [1.0, float("inf"), 0.0, 0.0, 0.0], None), (104, [], "d"), (105, [1.0, 2.0], "e")]
    rows = [(i, v, "x") for i, v in enumerate(good)] + odd
    d = write(spark, tmp_path, rows, "vec_id long, embedding array<double>, index string")
    check_whitening(whitening.op11_embedding_whitening(spark, d).collect(), list(range(40)), good, 5)


def test_whitening_of_equal_and_of_no_vectors(spark, tmp_path):
    kind = "vec_id long, embedding array<float>"
    for k, rows in enumerate(([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 7, [(1, [])])):
        out = whitening.op11_embedding_whitening(spark, write(spark, tmp_path / str(k), rows, kind))
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and not out.collect()


def test_whitening_of_rank_one_repeats_and_null_ids(spark, tmp_path):
    rows = [(None, [1.0, 2.0]), (None, [1.0, 2.0]), (5, [2.0, 4.0]), (5, [2.0, 4.0])]
    out = whitening.op11_embedding_whitening(spark, write(spark, tmp_path, rows, "vec_id long, embedding array<double>")).collect()
    assert [r.component for r in out] == [1] * 4 and sorted(round(abs(r.whitened), 9) for r in out) == [1.0] * 4
    assert sum(r.vec_id is None for r in out) == 2 and out[0].explained == pytest.approx(1)


def test_whitening_splits_columns_of_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", 3)
    vectors = np.random.default_rng(4).normal(size=(30, 8)).tolist()
    d = write(spark, tmp_path, list(enumerate(vectors)), "vec_id long, embedding array<double>")
    check_whitening(whitening.op11_embedding_whitening(spark, d).collect(), list(range(30)), vectors, 8)
    monkeypatch.setattr(whitening, "MAX_DIMENSIONS", 7)
    with pytest.raises(ValueError):
        whitening.op11_embedding_whitening(spark, d)


# Periodic runs


def plain_runs(words, least=12):
    """Every period by itself: stretches of words that are equal to those the period on."""
    n, found, numbers = len(words), {}, {}
    w = np.array([numbers.setdefault(x, len(numbers)) for x in words], np.int64)
    for q in range(1, n // 2 + 1):
        edge = np.diff(np.concatenate([[0], (w[:-q] == w[q:]).astype(np.int8), [0]]))
        for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            if e + q - s >= max(least, 2 * q):
                found.setdefault((s, e + q - s), q)
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def some_words(rng, n, k):
    words = [f"w{rng.randrange(k)}" for _ in range(n)]
    if n > 4 and rng.random() < 0.6:
        a, p = rng.randrange(n), 1 + rng.randrange(1, n) // 3
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_trees_find_all_runs():
    rng = random.Random(1)
    for _ in range(1500):
        words, least = some_words(rng, rng.randrange(60), rng.choice([1, 2, 3, 6])), rng.choice([2, 6, 12])
        assert [tuple(r) for r in periodic_runs.runs_of(words, least).tolist()] == plain_runs(words, least)


def test_common_extensions():
    rng = random.Random(2)
    for _ in range(60):
        symbols = [rng.randrange(1, 4) for _ in range(rng.randrange(1, 40))] + [0]
        e, n = periodic_runs.Extensions(symbols, 4), len(symbols)
        a, b = np.array([(i, j) for i in range(n) for j in range(n) if i != j]).T
        want = [next(k for k in range(n) if i + k >= n or j + k >= n or symbols[i + k] != symbols[j + k]) for i, j in zip(a, b, strict=True)]
        assert e.common(a, b).tolist() == want


def answer(words):
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(runs), *(best + (1000 * best[1] // best[2],) if best else (None,) * 4), digest("".join("%d,%d,%d\n" % r for r in runs)), digest(kept)), kept


def test_periodic_runs_of_texts(spark):
    rng = random.Random(3)
    texts = [None, "", " \n", "a b a b", "é " * 12, "x " * 11, "one two three " * 5 + "four", " ".join(str(i) for i in range(500)) + " z" * 40]
    texts += ["\t".join(some_words(rng, rng.randrange(150), rng.choice([2, 5, 40]))) for _ in range(150)] + ["b c " * 1500]
    texts += ["line a b c d e\n" * 2 + "other words " * 3] * 3
    docs = spark.createDataFrame([(None if i % 50 == 7 else i // 2, t, "x", {"a": "b"}, 1) for i, t in enumerate(texts)], DOCS)
    got = sorted(map(tuple, periodic_runs.periodic_runs(docs, texts=True).collect()), key=str)
    want = []
    for i, t in enumerate(texts):
        row, kept = answer((t or "").split())
        want.append((None if i % 50 == 7 else i // 2, *row, kept))
    assert got == sorted(want, key=str)


def test_periodic_runs_query(spark):
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op12_periodic_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        assert got[r.doc_id] == answer(words)[0]


# Secrets


def plain_matches(text):
    """By the stated patterns, nothing else."""
    word = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    out = [(m.start(), 0, m.end()) for m in word.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def b64(x):
    return base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()


WRAPS = {
    "url": lambda s: urllib.parse.quote(s, safe=""),
    "all percent": lambda s: "".join(f"%{c:02x}" for c in s.encode()),
    "unicode": lambda s: "".join(f"\\u{ord(c):04X}" for c in s),
    "entities": lambda s: "".join(f"&#{ord(c)};" for c in s),
    "base64": b64,
    "base64 for addresses": lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("="),
    "zlib": lambda s: b64(zlib.compress(s.encode())),
    "gzip": lambda s: b64(gzip.compress(s.encode())),
    "bz2": lambda s: b64(bz2.compress(s.encode())),
    "twice compressed": lambda s: b64(bz2.compress(zlib.compress(s.encode()))),
}


@pytest.mark.parametrize("outer", sorted(WRAPS))
@pytest.mark.parametrize("inner", sorted(WRAPS))
def test_secrets_in_two_layers(outer, inner):
    wrapped = WRAPS[outer](WRAPS[inner]("Größe, password = hunter2secret"))
    text = f"some ü words {wrapped} and more"
    base, found, layers, unopened = secret_scan.findings(text)
    assert base == plain_matches(text) and set(base) <= set(found) and layers >= 2 and not unopened
    start = text.index(wrapped)
    assert any(k == 0 and start <= b and e == start + len(wrapped) for b, k, e in found)
    clean = f"some {WRAPS[outer](WRAPS[inner]('Größe ohne Geheimnis, no secrets here'))} words"
    assert secret_scan.findings(clean)[1] == plain_matches(clean)


def test_spans_of_parts():
    spans = lambda t: secret_scan.joined(secret_scan.findings(t)[1])
    assert spans("pass%77ord=s3cretvalue token=abc%2Fdefghi") == "assign:0:22,assign:23:41"
    assert spans("x password: " + b64("swordfish-is-long") + " y") == "assign:2:36"
    inner = "ok, password: hunter22 bye"
    text = "a " + b64(inner)  # characters 4 to 22 are bytes 4 to 22: from the sixth base64 character to the thirtieth
    assert spans(text) == f"assign:{2 + 5}:{2 + 30}"
    assert spans("\\ud83d\\ude00 \\ud83d \\u{110000} &#1114112; no") == ""
    assert spans("%ff%fe %E0%A4 password=%E2%82%AC") == ""


def test_unwrapping_ends():
    assert secret_scan.findings("%2525252525252541")[2] == 9  # the text and one layer for each level
    text = "nothing"
    for _ in range(30):
        text = b64(text + ", and again")
    assert secret_scan.findings(text)[2] > 20


def test_too_much_is_told(monkeypatch):
    monkeypatch.setattr(secret_scan, "MOST_BYTES", 1000)
    base, found, _, unopened = secret_scan.findings("x " + b64(zlib.compress(b"password=abcdefgh " * 1000)))
    assert not found and unopened == 1


def test_secret_scan_query_and_odd_table(spark):
    for r in queries.QUERIES["op13_secret_scan"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect():
        base = plain_matches(r.text or "")
        told = ",".join(f"{('assign', 'access', 'hex')[k]}:{b}:{e}" for b, k, e in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest() and set(told.split(",")) <= set(r.spans.split(","))
    rows = [(1, None), (None, ""), (2, "é🙂 AKIA" + "Q7" * 10), (2, "é🙂 AKIA" + "Q7" * 10), (3, "Secret:'ſecret=abcdefg' " + "0" * 23), (4, "y" * 300000 + " api_key = 'abcdef'")]
    docs = spark.createDataFrame([(i, t, "x", None, 1) for i, t in rows], DOCS)
    got = sorted((r.doc_id or 0, r.n_assign, r.n_access, r.n_hex, r.spans) for r in secret_scan.scan_secrets(docs).collect())
    assert got == [(0, 0, 0, 0, ""), (1, 0, 0, 0, ""), (2, 0, 1, 0, "access:3:27"), (2, 0, 1, 0, "access:3:27"), (3, 0, 0, 0, ""), (4, 1, 0, 0, "assign:300001:300018")]
    for scan in (secret_scan.scan_secrets, periodic_runs.periodic_runs):
        assert scan(spark.createDataFrame([], DOCS)).collect() == []

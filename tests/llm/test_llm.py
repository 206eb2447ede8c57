"""The training-data operators against brute force, SQL and edge cases on small tables."""

import collections
import hashlib
import html
import re
import time
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fairground.llm import decontamination, html_extraction, near_dup, quality_classifier, quality_rules, queries, sentencepiece, sharding, toxicity, url_filter, warc

SF = "/root/testdata/sf0.001"
SPACED, LETTERED = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = [(1, None), (2, ""), (3, " \n\t"), (4, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (6, "Thé quick\nthé quick\nx " * 30), (7, "y" * 5000 + " z")]
DOCS = "doc_id long, text string, lang string, rejected_by string, n_words long, ids string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "x", 1, "y") for i, t in TEXTS], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (6, 0, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda f: sorted(tuple("" if x is None or x != x else str(x) for x in r) for r in f[columns].astype(object).itertuples(index=False))
    assert plain(got) == plain(want)


def test_quality_rules_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    other = {r.doc_id: r.kept for r in quality_rules.judge(docs, order=sorted(quality_rules.CASCADE_RULES, reverse=True)).collect()}
    for r in docs.collect():
        w = SPACED.findall(r.text)
        runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = collections.Counter(runs)
        repeats = len({k for i, x in enumerate(runs) if n[x] > 1 for k in range(i, i + 5)})
        lines = [x for x in r.text.split("\n") if SPACED.search(x)]
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r.text))
        assert (g.n_dup_lines, g.n_repeat_words) == (len(lines) - len(set(lines)), repeats)
        assert g.base_failed == (len(w) < 10 or 100 * repeats > 20 * len(w)) and not (g.base_failed and g.kept)
        assert g.kept == other[r.doc_id]


def test_decontamination_parts_and_spans(spark):
    bench = spark.createDataFrame([(1, "One two three four five six seven eight nine ten ELEVEN"), (2, "short item"), (None, "z"), (3, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x two THREE four five six, seven eight nine ten eleven y"), (2, "a short-item b"), (3, None), (4, "clean")], "doc_id long, text string")
    want = {1: (10, 1, "1"), 2: (2, 1, "2"), 3: (0, 0, ""), 4: (0, 0, "")}
    for most in (decontamination.MAX_BYTES, 200):
        got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256) for r in decontamination.digest(docs, bench, max_bytes=most).collect()}
        assert got == {k: (a, b, hashlib.sha256(c.encode()).hexdigest()) for k, (a, b, c) in want.items()}
    assert {r.doc_id: r.text for r in decontamination.remove_spans(docs, bench).collect()} == {1: "x  y", 2: "a  b", 3: None, 4: "clean"}
    assert {r.doc_id for r in decontamination.drop_documents(docs, bench).collect()} == {3, 4}


def test_near_dup_index_finds_all_within_radius():
    rng = np.random.RandomState(1)
    for _ in range(200):
        a = rng.randint(0, 1 << 16, near_dup.POSITIONS).astype(np.uint16)
        b = a.copy()
        at = rng.choice(near_dup.POSITIONS, near_dup.RADIUS, replace=False)
        b[at] += 1
        keys = near_dup.chunk_keys(np.stack([a, b]))
        assert (keys[0] == keys[1]).any()
    assert near_dup.miss_probability(0.85) < 2e-5


def test_near_dup_groups(spark):
    words = [f"w{i}" for i in range(200)]
    near = [(i, " ".join([*words[:i], f"x{i}", *words[i + 1 :]])) for i in range(40)]
    got = {r.doc_id: r for r in near_dup.near_duplicates(spark.createDataFrame([*near, (90, " ".join(words)), (91, "something else entirely of its own"), (92, None)], "doc_id long, text string")).collect()}
    assert {got[i].component_id for i in range(40)} == {0} and got[90].component_id == 0
    assert got[91].kept and got[92].kept and got[92].n_shingles == 0 and sum(r.kept for r in got.values()) == 3


def test_html(spark):
    pages = [(1, "http://h/a", "<nav>menu</nav><article><h1>T &amp; t</h1><p>one <b>two</b>\n three<br>four<div class='ad'>buy</div><p>five&nbsp;<script>x</script></article><footer>f</footer>"), (2, None, None), (3, "http://h/b", "")]
    got = {r.page_id: (r.text, r.n_chars) for r in html_extraction.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: ("T & t one two three four five", 29), 2: ("", 0), 3: ("", 0)}
    real = spark.read.parquet(f"{SF}/pages.parquet")
    found = {r.page_id: r.text for r in html_extraction.extract(real).collect()}
    for r in real.collect():
        body = re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", r.html, re.S).group(1))
        parts = (re.sub(r"\s+", " ", html.unescape(b)).strip() for b in re.split(r"<(?:p|/p|br|h1|/h1)>", body))
        assert found[r.page_id] == " ".join(p for p in parts if p)


LOOSE = [
    ("<html><head><title>t</title><body><p>hello there</p>", "hello there"),
    ("<body><nav><ul><li><a href=x>m</a><main><p>real text</p></main>", "real text"),
    ("<body><nav><ul><li>menu item<article><p>real text</p></article>", "real text"),
    ("<article><h1>Title</h1><div class=lead>the lead</div><div class=body>body text that is most of it</div></article>", "Title the lead body text that is most of it"),
    ("<body><div class=all><h1>Title</h1><div class=lead>lead</div><div class=x>" + "w " * 200 + "</div></div><div class=zz>rest</div>", "Title lead " + ("w " * 200).strip()),
    # What a page's names say of what else is on it, or end with, is no sidebar; and its twins.
    ("<body><div class='layout has-sidebar'><h1>T</h1><p>one two three</p></div>", "T one two three"),
    ("<body><div class='elementor-widget-wrap'><p>one two three</p></div>", "one two three"),
    ("<body><div id='public-notice'><p>one two three</p></div><p>x", "one two three"),
    ("<body><div class='market-share-report'><p>one two three</p></div>", "one two three"),
    ("<body><article><div class='article-header'><h1>T</h1></div><p>one</p></article>", "T one"),
    ("<body><article><header class=header><h1>T</h1></header><p>one</p><footer>f</footer></article>", "T one"),
    ("<body><div class='sidebar'><article><h1>T</h1><p>one two three</p></article></div><p>x", "T one two three"),
    ("<body><div class='sidebar-left'><p>a b c d e f g h</p></div><div><h1>T</h1><p>one</p></div>", "T one"),
    ("<body><div class='layout'><div class='left-sidebar'>s</div><p>one two three</p></div>", "one two three"),
    ("<body><div class='widget'>w</div><p>one two three</p>", "one two three"),
    ("<body><div id='public-notice'>we</div><p>one two three</p>", "one two three"),
    ("<body><div class='share-buttons'>s</div><div class='social share'>t</div><p>one two three</p>", "one two three"),
    ("<body><header class='site-header'><h1>Site</h1></header><div class='page-header'>p</div><article><h1>T</h1><p>one two</p></article>", "T one two"),
    ("<body><article><p>one two</p></article><div class='post-comments'><article><p>what a reader says at length</p></article></div>", "one two"),
    ("<article>x<form>name</form><p class='comment-list'>by a reader<p>y</article>", "x y"),
    ("a < b and c > d", "a < b and c > d"),
    ("<p>x <a href='q", "x <a href='q"),
    ("<p>x<!-- never", "x"),
    ("<script>var a='</p>';</script><p>t</p><script>x", "t"),
    ("<article>1 &lt; 2 &amp; 3<p>p1<p>p2<ul><li>i1<li>i2</ul></article>", "1 < 2 & 3 p1 p2 i1 i2"),
]


@pytest.mark.parametrize("page,text", LOOSE)
def test_html_of_loose_pages(page, text):
    assert html_extraction.main_text(page, None) == text


def test_html_is_linear_in_broken_pages():
    began = time.time()
    for page in ("<a " * 300_000, "<a \">\"" * 100_000, "<div>" * 100_000 + "</b>" * 100_000, "<b>" + "<div>" * 50_000 + "</b>" * 50_000, "<section><nav>" * 50_000, "<!--" * 100_000):
        html_extraction.main_text(page, None)
    assert time.time() - began < 30


def test_html_templates_of_a_host_empty_and_repeated(spark, monkeypatch):
    body = "<article><div class=s1><p>{0} one</div><div class=s2><p>{0} two</div></article><div class=x><p>buy</div>"
    other = "<article><div class=s1></div></article><main><p>another template, with a long text of its own</main>"
    rows = [(k, f"http://h/{k}", body.format("some words of page")) for k in range(5)] + [(9, "http://h/9", other), (9, "http://h/9", other), (None, None, "<p>z"), (11, "http://h/11", None)]
    frame = spark.createDataFrame([(*r, "t", "h", 1, "p") for r in rows], "page_id long, url string, html string, text string, host string, n_chars int, path string")
    for limit in (html_extraction.BROADCAST_BYTES, -1):
        monkeypatch.setattr(html_extraction, "BROADCAST_BYTES", limit)
        got = collections.Counter((r.page_id, r.url, r.text, r.n_chars) for r in html_extraction.extract(frame).collect())
        long, short = "another template, with a long text of its own", "some words of page one some words of page two"
        assert got == collections.Counter([*((k, f"http://h/{k}", short, len(short)) for k in range(5)), *[(9, "http://h/9", long, len(long))] * 2, (None, None, "z", 1), (11, "http://h/11", "", 0)])
        assert html_extraction.extract(frame.limit(0)).count() == 0


def test_bloom_cascade_is_exact():
    h = np.arange(1, 40001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    levels = url_filter.build_levels(h[:3000], h[3000:])
    assert url_filter.members(levels, h[:3000]).all() and not url_filter.members(levels, h[3000:]).any()
    assert not url_filter.members([], h[:5]).any()


def test_url_filter_without_broadcast(spark):
    pages = spark.createDataFrame([(1, "http://a.spam-x.COM/fr/1"), (2, "http://ok.org/x"), (3, None), (4, "no scheme"), (5, "https://www.example.com/en/71?q"), (6, "https://x.com/en/"), (7, "http://com/en/")], "page_id long, url string")
    want = {1: ("block", None), 2: ("allow", None), 3: ("allow", None), 4: ("allow", None), 5: ("allow", "example.com/en/7"), 6: ("block", "com/en/"), 7: ("block", "com/en/")}
    for most in (1 << 20, -1):
        assert {r.page_id: (r.verdict, r.rule) for r in url_filter.judge(pages, broadcast_bytes=most).collect()} == want


def test_url_filter_equal_hashes_and_odd_tables(spark, monkeypatch):
    keys = pd.Series([f"k{i}" for i in range(100)])
    listed = np.arange(100) % 3 == 0
    real = url_filter._key_hashes
    monkeypatch.setattr(url_filter, "_key_hashes", lambda x: real(x) % np.uint64(37))
    assert (url_filter.listed_in(*url_filter.build_segment(keys, listed), keys) == listed).all()
    monkeypatch.undo()
    pages = spark.createDataFrame([(1, "http://a.b/x", "h"), (1, "http://a.b/x", "h"), (None, None, None)], "page_id long, url string, segment string")
    universe = spark.createDataFrame([("a.b", True), ("a.b", False), ("", False)], "key string, listed boolean")
    words = spark.createDataFrame([("b",), ("b",), (None,)], "word string")
    for most in (1 << 20, -1):
        for keys in (universe, url_filter.listed_hosts(pages, words)):
            rows = url_filter.judge(pages, keys, broadcast_bytes=most, group_rows=1).collect()
            assert sorted((r.page_id or 0, r.host, r.verdict) for r in rows) == [(0, "", "allow"), (1, "a.b", "block"), (1, "a.b", "block")]
        assert url_filter.judge(pages.limit(0), broadcast_bytes=most).count() == 0


def test_one_edit_automaton():
    terms = [("worthless", True), ("moron", True), ("lowei", False)]
    machine = toxicity.Automaton(terms)

    def found(word):
        data = np.frombuffer(word.encode(), np.uint8)
        hit, what = machine.match(data, np.array([0]), np.array([len(data)]))
        return (terms[what[0] // 2][0], int(what[0] % 2)) if len(hit) else None

    assert found("moron") == ("moron", 0) and found("loweischaft") == ("lowei", 0) and found("low") is None
    for typo in ("worthles", "worthlesss", "wortless", "worthlezs", "owrthless"):
        assert found(typo) == ("worthless", 1)
    assert found("wrthles") is None and found("more") is None


def test_classifiers_hold_out(spark):
    docs, known = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r for r in known.collect()}
    good = [(truth[r.doc_id].quality, r.predicted) for r in quality_classifier.classify(docs, known).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in good]) > 0.95
    toxic = [(truth[r.doc_id].toxic, r.predicted) for r in toxicity.classify(docs, known).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in toxic]) > 0.9 and not any(p for t, p in toxic if not t)


def test_sentencepiece_chunks_match_whole(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(40)
    whole = {r.doc_id: (r.ids, r.score) for r in sentencepiece.encode(docs).collect()}
    chunked = sentencepiece.decode(sentencepiece.encode(docs, chunk=300)).collect()
    assert {r.doc_id: (r.ids, r.score) for r in chunked} == whole and all(r.decoded == r.text for r in chunked)


def test_sentencepiece_brute_force_without_cuts():
    pieces, rng = sentencepiece.pieces_of(sentencepiece.MODEL), np.random.RandomState(3)
    for _ in range(10):
        text = " " + "".join(rng.choice(list("abcdeinrst"), 200))
        best, back = pieces.forward(text, [0], len(text))
        v, vectors, width, size = np.full(pieces.longest, sentencepiece.NEVER), [], pieces.longest, 33
        v[0] = 0
        parts = [(text[k : k + size + width - 1], min(size, len(text) - k)) for k in range(0, len(text), size)]
        matrices = [pieces.matrix(*p) for p in parts]
        for m in matrices:
            vectors.append(v.tolist())
            v = np.maximum((v[:, None] + m).max(axis=0), sentencepiece.NEVER)
        total = matrices[0]
        for m in matrices[1:]:
            total = sentencepiece.plus(total, m)
        assert v[0] == best[-1] == total[0, 0]
        out, ids = 0, []
        for (p, n), e in reversed(list(zip(parts, vectors, strict=True))):
            ids.append(pieces.chunk_ids(p, n, e, out))
            out = pieces.ways_in(p, n, e)[out]
        assert np.frombuffer(b"".join(reversed(ids)), np.int32).tolist() == pieces.trace(text, back, len(text))[0]


def test_warc_audit(spark):
    rows = [("f", 70_000 * k, 10, f"s{k}") for k in range(40)] + [(None, 0, 1, "n")]
    first = spark.createDataFrame(rows, "file string, offset long, length long, sha string")
    second = spark.createDataFrame([("f", r[1], 10, "bad") if r[1] == 140_000 else r for r in rows if r[1] != 2_730_000], first.schema)
    assert {(r.file, r.offset, r.status) for r in warc.audit(first, second).collect()} == {("f", 140_000, "changed"), ("f", 2_730_000, "missing")}
    assert warc.audit(first, first).count() == 0
    # A null offset is 0; a null file is one of its own; rows may repeat.
    one = spark.createDataFrame([("f", None, 3, "a"), (None, None, 1, "n"), ("f", 5, 1, "r"), ("f", 5, 1, "r")], first.schema)
    other = spark.createDataFrame([("f", None, 3, "b"), (None, None, 1, "n"), ("f", 5, 1, "r")], first.schema)
    assert sorted((r.file, r.offset, r.status) for r in warc.audit(one, other).collect()) == [("f", 0, "changed"), ("f", 5, "missing")]
    none = one.limit(0)
    assert warc.audit(none, none).count() == 0 and {r.status for r in warc.audit(none, one).collect()} == {"extra"}


def test_warc_bytes_of_both_replicas(spark):
    rows = [(k, f"http://h/{k}", "é" * (k % 7) * 2000) for k in range(300)] + [(None, None, None), (2, "http://h/2", "again")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    records = warc.records_of(pages)
    one = records.where("page_id = 1").first().record
    head, body = bytes(one).split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    assert head.startswith(b"WARC/1.1\r\n") and int(fields["Content-Length"]) == len(body) - 4 and body == ("é" * 2000).encode() + b"\r\n\r\n"
    assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", fields["WARC-Record-ID"])

    # A turned bit, a cut record (what follows it moves), a lost one and one more than before.
    second = records.where("page_id is null or page_id <> 280").withColumn("record", F.expr("case when page_id = 20 then concat(record, X'00') when page_id = 5 then concat(X'00', substring(record, 2)) else record end"))
    second = second.union(spark.createDataFrame([("part-00000001.warc", 999, bytearray(b"new"))], second.schema))
    first, second = (warc.lay_out(warc.hash_records(r)) for r in (records, second))
    got = {(r.id, r.status) for r in warc.audit(first, second, "page_id").collect()}
    assert got == {(5, "changed"), (20, "changed"), (280, "missing"), (999, "extra"), *((k, "moved") for k in range(21, 300) if k < 256 or k > 280)}


def test_sharding_law(spark):
    rows = sharding.assign(spark.createDataFrame([(i, "x") for i in range(3000)] + [(7, "x")] * 5 + [(None, None)], "doc_id long, text string")).collect()
    assert all(r.grown_shard in (r.shard, 24) for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and len(rows) == 3006


@pytest.mark.parametrize("name", ["rules", "judge", "shard", "near", "quality", "toxic", "pieces", "bench"])
def test_odd_and_empty_tables(spark, odd, none, labels, name):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    run = {
        "rules": quality_rules.apply_rules,
        "judge": quality_rules.judge,
        "shard": sharding.assign,
        "near": near_dup.near_duplicates,
        "quality": lambda d: quality_classifier.classify(d, labels),
        "toxic": lambda d: toxicity.classify(d, labels),
        "pieces": lambda d: sentencepiece.decode(sentencepiece.encode(d, chunk=1000)),
        "bench": lambda d: decontamination.digest(d, bench),
    }[name]
    assert run(odd).count() == len(TEXTS) and run(none).count() == 0


def test_pipeline_keeps_and_drops(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = p.quality_rule_stage(spark, docs, SF)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
    assert len(p.STAGES) == 5


def test_stretches_solved_together_match_the_plain_search():
    pieces = sentencepiece.Pieces.load()
    texts = [sentencepiece.marked(t) for t in ["", "a", "Thé quick, (brown) fox's...  %%% x", "日本語 and\n\tüber ▁ \0", "y" * 200 + " z"]]
    for text, (ids, score) in zip(texts, pieces.many(texts), strict=True):
        best, back = pieces.forward(text, [0], len(text))
        assert (np.frombuffer(ids, np.int32).tolist(), score) == (pieces.trace(text, back, len(text))[0], best[-1])


def test_near_dup_with_several_blocks_to_a_key(spark, monkeypatch):
    rows = lambda: sorted(map(tuple, near_dup.op7_near_dup(spark, SF).collect()))
    whole = rows()
    monkeypatch.setattr(near_dup, "BLOCK", 2)
    assert rows() == whole


def unigram():
    """The library's own processor of a unigram model with the pieces and scores that are used here."""
    import sentencepiece as library

    proto = sentencepiece.proto_of(sentencepiece.MODEL)
    proto.trainer_spec.model_type = proto.trainer_spec.UNIGRAM
    for piece in proto.pieces:
        if piece.type == piece.NORMAL:
            piece.score = sentencepiece.zipf(piece.score) / sentencepiece.SCALE
    return library.SentencePieceProcessor(model_proto=proto.SerializeToString())


#: The processor adds scores up in 32 bits, which hold the sums of fewer pieces than this exactly.
EXACT = 1500


def test_sentencepiece_ids_are_the_processors(spark):
    import sentencepiece as library

    own, merged = unigram(), library.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    odd = [(-1, "y" * 1300 + " z"), (-2, " " * 700 + "a" + " " * 100), (-3, "日本語 and\n\tüber \0 x..."), (-4, "ab" * 900), (-5, ""), (-6, None), (-6, "of the government, of (the) governments")]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).union(spark.createDataFrame(odd, "doc_id long, text string"))
    pieces, n = sentencepiece.pieces_of(sentencepiece.MODEL), docs.count()
    for merges, processor in ((False, own), (True, merged)):
        for chunk in (sentencepiece.CHUNK, 100):
            rows, exact = sentencepiece.decode(sentencepiece.encode(docs, chunk=chunk, merges=merges)).collect(), 0
            assert len(rows) == n
            for r in rows:
                want = None if r.text is None else processor.encode(r.text)
                if not merges and r.text is not None:
                    text = sentencepiece.marked(r.text)
                    best, back = pieces.forward(text, [0], len(text))
                    plain = pieces.trace(text, back, len(text))[0]
                    assert r.score == best[-1] and (len(plain) >= EXACT or plain == want)
                    exact += len(plain) < EXACT
                    want = plain
                assert r.ids == want and r.decoded == r.text
            assert merges or exact > n // 2


def shingles(text):
    words = SPACED.findall((text or "").translate(LOWER))
    n = min(near_dup.SHINGLE, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def test_near_dup_radii_follow_the_threshold():
    assert near_dup.plan_of(85)[:2] == (37, 68) and len(near_dup.plan_of(85).keys) == 50
    rng = np.random.RandomState(2)
    for threshold in (90, 85, 80, 70, 50):
        plan = near_dup.plan_of(threshold)
        assert near_dup.miss_probability(threshold / 100, plan.radius) <= near_dup.MISS
        assert near_dup.miss_probability(threshold / 100, plan.wide_radius, near_dup.MORE_POSITIONS) <= near_dup.WIDE_MISS
        for _ in range(50):
            a = rng.randint(0, 1 << 16, near_dup.POSITIONS).astype(np.uint16)
            b = a.copy()
            b[rng.choice(near_dup.POSITIONS, plan.radius, replace=False)] += 1
            keys = near_dup.chunk_keys(np.stack([a, b]), plan)
            assert (keys[0] == keys[1]).any()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of tables: those of SF with more documents, of which some pairs have a similarity of 0.80 to 0.85."""
    base = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if quality_words(r.text)]
    rows = [r.asDict() for r in base]
    for k, r in enumerate(base[:25]):
        words = r.text.split(" ")
        n = len(shingles(r.text))
        changed = max(1, round(n * (1 - 2 * 0.825 / 1.825) / near_dup.SHINGLE))
        for i in range(changed):
            words[(i + 1) * len(words) // (changed + 1)] += "x"
        rows.append(r.asDict() | {"doc_id": 1_000_000 + k, "text": " ".join(words)})
    sf = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema).write.parquet(f"{sf}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{sf}/{t}.parquet")
    return sf


def quality_words(text):
    return text and 60 <= len(text.split()) <= 1500


def smallest_of_groups(rows, threshold):
    """The rows of smallest id of the groups of near copies."""
    sets, group = [shingles(r.text) for r in rows], list(range(len(rows)))
    band = 0
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            union = len(sets[i]) + len(sets[j]) - shared
            if union and 100 * shared >= threshold * union:
                band += 100 * shared < 85 * union
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    kept = {}
    for r, g in zip(rows, group, strict=True):
        if g not in kept or (r.doc_id is None, r.doc_id) < (kept[g].doc_id is None, kept[g].doc_id):
            kept[g] = r
    return kept.values(), band


def test_pipeline_stages_and_run_against_brute_force(spark, corpus):
    import corpus_pipeline as p

    docs, own = spark.read.parquet(f"{corpus}/documents.parquet"), unigram()
    ids = lambda rows: sorted(r.doc_id for r in rows)
    known, bench = (spark.read.parquet(f"{corpus}/{t}.parquet") for t in ("labels", "benchmark"))
    kept, band = smallest_of_groups(docs.collect(), 80)
    assert band >= 10 and ids(p.near_dup_stage(spark, docs, corpus).collect()) == ids(kept)

    # Each stage by itself, over all that the one before it kept.
    passed = [r for r in docs.collect() if r.doc_id in {x.doc_id for x in quality_rules.judge(docs).where("kept").collect()}]
    frame = spark.createDataFrame(passed, docs.schema)
    assert ids(p.quality_rule_stage(spark, docs, corpus).collect()) == ids(passed)
    good = {r.doc_id for r in quality_classifier.classify(frame, known).where("predicted = 1").collect()}
    passed = [r for r in passed if r.doc_id in good]
    assert ids(p.quality_classifier_stage(spark, frame, corpus).collect()) == ids(passed)
    passed = list(smallest_of_groups(passed, 80)[0])
    frame = spark.createDataFrame(passed, docs.schema)
    split = lambda text: LETTERED.findall((text or "").translate(LOWER))
    size, windows = decontamination.WINDOW, set()
    for r in bench.collect():
        w = split(r.text)
        n = min(size, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    lengths = {len(w) for w in windows}
    holds = lambda w: any(tuple(w[i : i + n]) in windows for n in lengths for i in range(len(w) - n + 1))
    passed = [r for r in passed if not holds(split(r.text))]
    assert ids(p.decontamination_stage(spark, frame, corpus).collect()) == ids(passed)
    want = {r.doc_id: own.encode(r.text) for r in passed}
    pieces, exact = sentencepiece.pieces_of(sentencepiece.MODEL), 0
    for r in passed:
        text = sentencepiece.marked(r.text)
        plain = pieces.trace(text, pieces.forward(text, [0], len(text))[1], len(text))[0]
        exact += len(plain) < EXACT
        assert plain == want[r.doc_id] or len(plain) >= EXACT  # beyond, the processor's sums are rounded
        want[r.doc_id] = plain
    assert exact > len(passed) // 2
    for rows in (p.sentencepiece_stage(spark, spark.createDataFrame(passed, docs.schema), corpus).collect(), p.run(spark, corpus).collect()):
        assert {r.doc_id: r.ids for r in rows} == want and len(rows) == len(want) and all(r.round_trip and r.n_pieces == len(r.ids) for r in rows)


def test_pipeline_near_dup_of_null_and_repeated_ids(spark):
    import corpus_pipeline as p

    words = [f"w{i}" for i in range(200)]
    copy = " ".join([*words[:100], "x", *words[101:]])
    rows = [(1, " ".join(words)), (2, copy), (2, "a text of its own that shares an id"), (None, "a clean text of no id"), (None, "a clean text of no id"), (None, copy), (3, None), (3, ""), (None, None)]
    got = p.near_dup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), SF).collect()
    want = [rows[0], rows[2], rows[3], rows[6], rows[7], rows[8]]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert p.near_dup_stage(spark, spark.createDataFrame([], "doc_id long, text string"), SF).count() == 0


def test_sharding_spreads_the_copies_of_a_text(spark):
    rows = spark.range(20_000).select(F.col("id").alias("key"), F.lit(99).alias("size"), F.lit(7).alias("text_crc32"))
    counts = [r["count"] for r in rows.groupBy(sharding.bucket_of(256).alias("b")).count().collect()]
    assert len(counts) == 256 and max(counts) < 200
    got = sharding.assign(rows.select(F.col("key").alias("doc_id"), F.lit("same").alias("text")), buckets=4, bucket_rows=50).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m"))
    assert all(r.n == r.d == r.m + 1 for r in got.collect())


#: A table that owns the names of all columns that the operators work with.
WORK = ["rejected_by", "n_words", "hits", "items", "__hits", "__items", "row", "_row", "found", "ids", "score", "decoded", "k", "part", "label", "node", "key", "held_out"]


def test_own_columns_stay(spark, labels):
    texts = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "a short item b, and some more words so that no rule of length rejects the text at all"), (3, None), (3, "y" * 700)]
    frame = spark.createDataFrame([(i, t, *[f"{c}{i}" for c in WORK]) for i, t in texts], ", ".join(["doc_id long", "text string", *(f"{c} string" for c in WORK)]))
    bench = spark.createDataFrame([(1, "short item")], "item_id long, text string")
    plain = lambda df: sorted(map(repr, map(tuple, df.collect())))
    own = plain(frame)
    of = lambda *ids: [r for r in own if int(r[1]) in ids]
    assert plain(decontamination.drop_documents(frame, bench)) == of(1, 3)
    cut_out = decontamination.remove_spans(frame, bench)
    assert cut_out.columns == frame.columns and plain(cut_out.drop("text")) == plain(frame.drop("text")) and cut_out.where("doc_id = 2").first().text.startswith("a  b,")
    assert plain(quality_rules.passing(frame)) == of(1, 2)
    assert plain(quality_rules.apply_rules(frame, to="why").drop("why")) == own
    assert quality_classifier.keep_good(frame, labels).columns == frame.columns
    for chunk in (sentencepiece.CHUNK, 100):
        coded = sentencepiece.encode_and_decode(frame, chunk=chunk, ids="i", score="s", to="d")
        assert plain(coded.select(*frame.columns)) == own and all(r.d == r.text for r in coded.collect())
        assert sorted(sentencepiece.encode(frame, chunk=chunk).columns) == sorted(frame.columns)


def test_rules_by_value_on_odd_tables(spark, odd):
    got = sorted(((r.doc_id or 0, r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines, r.base_failed, r.kept) for r in quality_rules.judge(odd).collect()), key=str)
    want = [(0, 6, 6, 0, 0, True, False), (1, 0, 0, 0, 0, True, False), (2, 0, 0, 0, 0, True, False), (3, 0, 0, 0, 0, True, False), (4, 6, 6, 0, 0, True, False), (5, 6, 6, 0, 0, True, False), (5, 6, 6, 0, 0, True, False), (6, 150, 510, 150, 57, True, False), (7, 2, 5001, 0, 0, True, False)]
    assert got == sorted(want, key=str)
    assert {r.doc_id: r.rejected_by for r in quality_rules.apply_rules(odd, order=["repeats_itself", "too_short", *quality_rules.CASCADE_RULES]).collect()}[6] == "repeats_itself"


def plain_rules(text):
    """The rules of the cascade, in words."""
    text = text or ""
    words, raw = SPACED.findall(text), text.encode()
    n, lines = len(words), [x for x in text.split("\n") if SPACED.search(x)]
    letters, upper = sum(c >= 0xC0 or chr(c).isascii() and chr(c).isalpha() for c in raw), sum(65 <= c <= 90 for c in raw)
    chars = sum(map(len, words))
    runs = collections.Counter(tuple(words[i : i + 5]) for i in range(n - 4))
    repeats = len({k for i in range(n - 4) if runs[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)})
    return {
        "too_short": n < 10,
        "repeats_itself": 100 * repeats > 20 * n,
        "symbols": 10 * sum(c in "#*$%&|<>" for c in text) > 3 * n,
        "shouting": letters > 0 and 100 * upper > 50 * letters,
        "exclaims": 100 * sum(c in "!?" for c in text) > 50 * n,
        "duplicate_lines": 100 * (len(lines) - len(set(lines))) > 50 * len(lines),
        "word_length": chars < 2 * n or chars > 25 * n,
        "digits": 100 * sum(c.isascii() and c.isdigit() for c in text) > 50 * max(chars, 1),
        "vocabulary": n >= 50 and 100 * len(set(words)) < 10 * min(n, 2000),
    }


def test_rules_verdicts_against_plain_rules(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    extra = [(-1, "THE LOUD TEXT " * 10), (-2, "what? ! " * 20), (-3, "12345 6789 " * 12 + "a b c"), (-4, "same line of words here\n" * 9), (-5, "x y z w v u t s r q p o n m"), (-6, "ab cd " * 40)]
    docs = docs.union(spark.createDataFrame(extra, "doc_id long, text string"))
    want = {(r.doc_id, r.text): {k for k, v in plain_rules(r.text).items() if v} for r in docs.collect()}
    assert set().union(*want.values()) >= {"shouting", "exclaims", "digits", "duplicate_lines", "word_length", "vocabulary"}
    for order in (None, sorted(quality_rules.BASE_RULES | quality_rules.CASCADE_RULES)):
        for r in quality_rules.apply_rules(docs, order=order).collect():
            failed = want[r.doc_id, r.text]
            assert (r.rejected_by in failed) if failed else r.rejected_by is None
    kept = {(r.doc_id, r.kept) for r in quality_rules.judge(docs).collect()}
    assert kept == {(i, not failed) for (i, _), failed in want.items()}


def test_discriminant_against_numpy(spark):
    """Scores as plain numpy has them: class covariances, shrunk twice, and densities by inverse and determinant."""
    docs, known = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    label = {r.doc_id: r.quality for r in known.collect()}
    rows = docs.collect()
    data = [np.frombuffer((r.text or "").encode(), np.uint8) for r in rows]
    x = np.concatenate([quality_classifier.statistics(quality_classifier.Stats(d, np.array([0, len(d)]))) for d in data])
    y = np.array([label.get(r.doc_id, -1) if not held(r.doc_id) else -1 for r in rows])
    total, d = (y >= 0).sum(), x.shape[1]
    by = {k: x[y == k] for k in (0, 1)}
    pooled = sum(len(v) / total * np.cov(v.T, bias=True) for v in by.values())
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    density = {}
    for k, v in by.items():
        c = (0.7 * np.cov(v.T, bias=True) + 0.3 * pooled) / np.outer(scale, scale)
        c = 0.98 * c + 0.02 * (np.trace(c) / d + 1e-3) * np.eye(d)
        z = (x - v.mean(axis=0)) / scale
        density[k] = -0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(c), z) - 0.5 * np.linalg.slogdet(c)[1] + np.log(len(v) / total)
    want = 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / d, -40, 40)))
    got = {r.doc_id: r for r in quality_classifier.classify(docs, known).collect()}
    for r, w in zip(rows, want, strict=True):
        assert abs(got[r.doc_id].score - w) < 1e-6 and got[r.doc_id].held_out == held(r.doc_id) and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.5)


def edits_of(a, b):
    """Whether bytes a become bytes b by no edit (0), one edit or swap (1), or more (2)."""
    if a == b:
        return 0
    one = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + a[i + 1 : i + 2] + a[i : i + 1] + a[i + 2 :] for i in range(len(a) - 1)}
    if b in one or len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1:
        return 1
    return 1 if any(b[:i] + b[i + 1 :] == a for i in range(len(b))) else 2


def test_automaton_against_plain_edits():
    terms, rng = [("worthless", True), ("moron", True), ("scum", True), ("lowei", False), ("bé", False), ("vequo", False)], np.random.RandomState(5)
    machine = toxicity.Automaton(terms)
    words = [w for t, _ in terms for w in (t, t + "s", t[1:], t[:-1], t[1] + t[0] + t[2:], t + "schaft")]
    for _ in range(3000):
        w = list(terms[rng.randint(len(terms))][0])
        for _ in range(rng.randint(3)):
            i = rng.randint(len(w) + 1)
            w[i : i + rng.randint(2)] = rng.choice(list("abeolwv"), rng.randint(2)).tolist()
        words.append("".join(w) + "".join(rng.choice(list("abco"), rng.randint(4))))
    for word in words:
        raw, best = word.encode(), None
        for k, (t, whole) in enumerate(terms):
            term = t.encode()
            least = min(edits_of(term, b) for b in ([raw] if whole else [raw[:n] for n in range(len(raw) + 1)]))
            if least == 0 or least == 1 and len(term) >= toxicity.LEAST_FUZZY:
                best = min(best or (2, 0), (least, k))
        data = np.frombuffer(raw, np.uint8)
        hit, found = machine.match(data, np.array([0]), np.array([len(data)]))
        assert (None if not len(hit) else (found[0] % 2, found[0] // 2)) == best, word


def test_quotations_pair_their_marks():
    inside = ['he said "', "“well ", "«", "„a", '"hi" and "']
    assert all(toxicity.quoted(b.encode(), a.encode()) for b, a in zip(inside, ['" then', "” x", "»", "“", '" bye'], strict=True))
    for before, after in [('"hi" you ', ' "bye"'), ("", '"'), ('"', ""), ("“", "»"), ("“a” ", "”")]:
        assert not toxicity.quoted(before.encode(), after.encode())


def test_toxicity_scores_by_hand(spark):
    rows = [(i, f"you moron number {i}" if i % 2 else f"a nice day number {i}", i % 2) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, "what a moronn"), (1001, 'she said "moron" to them'), (1002, None), (1003, ""), (None, "moron")], "doc_id long, text string")
    known = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    train = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5]
    t, c = sum(y for _, y in train), sum(1 - y for _, y in train)
    base, prior = 0.01 / (c + 1), t / (t + c)
    exact = ((t + 0.05) / (t + 1) - prior) / (1 - prior)
    want = lambda w: 1 - (1 - base) * (1 - w)
    got = {r.doc_id: r for r in toxicity.classify(docs, known).collect()}
    edited = toxicity.EDITED_SHARE * c / (c + toxicity.EDITED_ROWS) * exact
    for i, w in [(1, exact), (None, exact), (1000, edited), (1001, toxicity.QUOTED_SHARE * exact), (2, 0), (1002, 0), (1003, 0)]:
        assert abs(got[i].score - want(w)) < 1e-9 and got[i].predicted == int(got[i].score >= 0.5)
    assert got[1000].held_out == (zlib.crc32(b"1000") % 5 == 0) and got[None].held_out is False


def test_pipeline_stages_on_odd_and_empty_tables(spark, odd):
    import corpus_pipeline as p

    odd = odd.withColumn("source", F.lit("s"))
    for name, stage in p.STAGES:
        empty = stage(spark, odd.limit(0), SF)
        assert empty.count() == 0
        if name != "sentencepiece":
            assert empty.columns == odd.columns and set(stage(spark, odd, SF).collect()) <= set(odd.collect())
    # Equal texts are one group; null and wordless texts are linked with nothing; a null id comes last.
    got = sorted((r.doc_id for r in p.near_dup_stage(spark, odd, SF).collect()))
    assert got == [1, 2, 3, 4, 6, 7]
    coded = {r.doc_id: r for r in p.sentencepiece_stage(spark, odd, SF).collect()}
    assert coded[1].ids is None and coded[2].ids == [] and coded[2].n_pieces == 0 and all(r.round_trip for r in coded.values() if r.ids is not None)


def test_warc_of_null_ids_and_offsets(spark, tmp_path, monkeypatch):
    # Pages of null id are dealt out over files; equal ones are counted, and each has its own place.
    rows = [(None, f"http://h/{k}", "x" * k) for k in range(40)] + [(None, "http://h/same", "same")] * 30 + [(7, None, None)] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    laid = warc.lay_out(warc.hash_records(warc.records_of(pages))).collect()
    assert len(laid) == len(rows) and len({r.file for r in laid}) > 20
    monkeypatch.setattr(warc, "RUN", 8)
    assert sorted(map(tuple, warc.lay_out(warc.hash_records(warc.records_of(pages))).collect()), key=str) == sorted(map(tuple, laid), key=str)
    of = collections.defaultdict(list)
    for r in laid:
        of[r.file].append((r.offset, r.length))
    for places in of.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
    # Many records at one offset: one that differs is found, and copies are told by their number.
    many = [("f", None, 1, hashlib.sha256(b"%d" % k).hexdigest()) for k in range(500)] + [("f", None, 2, "c")] * 5
    kind = "file string, offset long, length long, sha string"
    first, second = spark.createDataFrame(many, kind), spark.createDataFrame(many[1:-1] + [("f", None, 1, "new")], kind)
    assert warc.audit(first, spark.createDataFrame(many[::-1], kind)).count() == 0
    fewer = spark.createDataFrame(many[:-1], kind)
    assert [r.status for r in warc.audit(first, fewer).collect()] == ["missing"] and warc.audit(first, second).count() > 0
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op9_warc(spark, str(tmp_path)).count() == 0


def test_near_dup_has_one_set_for_each_node(spark):
    words = [f"w{k}" for k in range(200)]
    a, b = " ".join(words), " ".join([*words[:100], "x", *words[101:]])
    docs = spark.createDataFrame([(1, a)] * 300 + [(2, b)] * 300 + [(1, b)] * 5, "doc_id long, text string")
    signed = near_dup.sign(docs)
    got = near_dup.near_duplicates(docs).collect()
    assert len(got) == 605 and {r.component_id for r in got} == {1}
    assert near_dup.full_sets(signed.select("node").distinct(), docs, signed).count() == 2


def test_pipeline_near_dup_keeps_columns_of_its_own_names(spark):
    import corpus_pipeline as p

    text = " ".join(f"w{k}" for k in range(50))
    rows = [(1, text, "mine", {"a": "b"}, 5), (1, text, "mine", {"a": "c"}, 6), (2, "another text", None, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __row string, row map<string,string>, content long")
    kept = p.near_dup_stage(spark, docs, SF)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
    assert {(r["__row"], r.content) for r in kept.collect()} <= {(r[2], r[4]) for r in rows}

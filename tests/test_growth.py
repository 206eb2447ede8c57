"""Work that must not grow faster than the tables: copies of the given tables under other keys."""

from pyspark.sql import functions as F

from fairground import catalogue, extracts, queries  # noqa: F401  they register the queries
from fairground.operators import aliases, merges

SF = "/root/testdata/sf0.001"
#: Steps between the keys of copies: multiples of all the moduli that these queries take of them.
STEP = {"part": ("p_partkey", 6_300), "supplier": ("s_suppkey", 500)}


def copied(spark, tmp_path, n: int, names=STEP) -> str:
    """A folder of the given tables, in which some are there n times."""
    for path in ("nation", "customer", "orders", "lineitem", "events", "part", "supplier"):
        rows = spark.read.parquet(f"{SF}/{path}.parquet")
        if path in names:
            key, step = STEP[path]
            rows = rows.crossJoin(spark.range(n).withColumnRenamed("id", "copy")).withColumn(key, F.col(key) + F.col("copy") * step).drop("copy")
        rows.write.parquet(str(tmp_path / f"{n}" / f"{path}.parquet"))
    return str(tmp_path / f"{n}")


def test_bindings_meet_once(spark, tmp_path, monkeypatch):
    met, plain = [], merges.bindings

    def counted(rows, known):
        met.append(rows.count())
        return plain(rows, known)

    monkeypatch.setattr(merges, "bindings", counted)
    found = [{tuple(r) for r in queries.QUERIES["append_bindings"](spark, sf).collect()} for sf in (SF, copied(spark, tmp_path, 4))]
    assert found[0] == found[1] and len(found[0]) > 20
    assert met[:2] == met[2:]


def test_aliases_of_one_class_are_decided_once(spark, tmp_path, monkeypatch):
    hits, plain = [], aliases.class_hits

    def counted(*args):
        rows = plain(*args)
        hits.append(rows.count())
        return rows

    monkeypatch.setattr(aliases, "class_hits", counted)
    once, more = ([tuple(r) for r in queries.QUERIES["alias_reconcile"](spark, sf).collect()] for sf in (SF, copied(spark, tmp_path, 4, ["part"])))
    assert hits[0] == hits[1] > 0
    assert len(more) == 4 * len(once) and sorted(more) == sorted((a + 6_300 * k, i, w, o) for a, i, w, o in once for k in range(4))


def test_slices_of_aliases_meet_slices_of_activities(spark, monkeypatch):
    """Tables are read once for what a class is decided by, and its rows come out of arrays of limited size, whatever that size is."""
    acts = spark.range(200).selectExpr("id", "timestamp_ntz '2026-01-01 10:00:00' + make_dt_interval(cast(id % 3 as int)) as start_at", "id % 7 as origin_priority")
    links = spark.range(200).selectExpr("id as event_id", "id % 4 as url")
    asked = spark.range(90).selectExpr("concat('a', id) as alias_id", "id % 2 as url", "date_add(date '2026-01-01', cast(id % 2 as int)) as day")
    owned, guarded = spark.createDataFrame([(13, True), (25, None), (4, False)], "id long, favorite boolean"), spark.createDataFrame([(12,)], "id long")
    hits = {r.alias_id: [i for i in range(200) if i % 4 == r.url and i % 3 == r.day.day - 1] for r in asked.collect()}
    winner = {a: min(ids, key=lambda i: (i != 13, i % 7, i % 3, i)) for a, ids in hits.items()}
    want = sorted((a, i, winner[a], "deferred" if 12 in ids else "kept" if i == winner[a] else "merged") for a, ids in hits.items() for i in ids)
    for most in ((504, 128), (7, 4), (1, 1)):
        monkeypatch.setattr(aliases, "ALIASES", most[0])
        monkeypatch.setattr(aliases, "ACTIVITIES", most[1])
        assert sorted(map(tuple, aliases.reconcile(acts, links, asked, owned, guarded).collect())) == want and len(want) > 1000
        assert max(len(r.alias_ids) for r in aliases.alias_classes(asked).collect()) == min(most[0], 45)
    plan = queries.QUERIES["alias_reconcile"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in line and "o_orderkey" in line for line in plan.splitlines()) == 1


def test_an_alias_of_several_addresses(spark):
    """Hits by several addresses or days count once; aliases without any hit nothing."""
    acts = spark.sql("select * from values (1, timestamp_ntz '2026-01-01 10:00:00', 5, 'a'), (2, timestamp_ntz '2026-01-01 12:00:00', 3, 'b'), (3, timestamp_ntz '2026-01-02 12:00:00', 1, 'c') as t(id, start_at, origin_priority, title)")
    links = spark.createDataFrame([(1, "u"), (1, "v"), (2, "v"), (3, "u"), (3, "u")], "event_id int, url string")
    asked = spark.sql("select alias_id, url, date(day) as day from values ('p', 'u', '2026-01-01'), ('p', 'v', '2026-01-01'), ('q', 'v', '2026-01-01'), ('q', 'u', '2026-01-01'), ('q', 'u', '2026-01-02'), ('r', 'u', '2026-01-02'), ('s', null, '2026-01-02') as t(alias_id, url, day)")
    owned = spark.createDataFrame([(1, False), (2, False), (3, True)], "id int, favorite boolean")
    got = aliases.reconcile(acts, links, asked, owned, spark.createDataFrame([], "id int"))
    assert {tuple(r) for r in got.collect()} == {("p", 1, 2, "merged"), ("p", 2, 2, "kept"), ("q", 1, 3, "merged"), ("q", 2, 3, "merged"), ("q", 3, 3, "kept")}
    assert {(r.id, r.title) for r in aliases.override(acts, links, asked).select("id", "title").collect()} == {(1, "Alias q"), (2, "Alias q"), (3, "Alias r")}


def test_only_rows_of_one_district_meet(spark):
    """Rows of a date are compared within their districts; those of unknown ones with all."""
    from fairground.operators import evidence

    rows = spark.range(3000).selectExpr("id", "timestamp_ntz '2026-01-01 10:00:00' as start_at", "true as all_day", "concat('Evening concert of the orchestra ', lpad(conv(id * 7919 % 3000, 10, 36), 3, '0')) as title", "if(id % 500 = 7, null, concat('d', id % 20)) as district")
    pairs = evidence.duplicate_pairs(rows)
    tested = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "district" in [c for line in tested.splitlines() if "Join Inner" in line for c in line.replace("#", " ").replace("(", " ").split()]
    data = rows.collect()
    from fairground.functions.text import common

    norm = {r.id: "".join(c for c in r.title.lower() if c.isalnum()) for r in data}
    some = [r for r in data if r.id < 400]
    want = {(x.id, y.id) for x in some for y in some if x.id < y.id and (x.district is None or y.district is None or x.district == y.district) and 200 * common(norm[x.id], norm[y.id]) >= 93 * (len(norm[x.id]) + len(norm[y.id]))}
    assert {(r.a, r.b) for r in pairs.where("a < 400 and b < 400").collect()} == want and any(7 in p for p in want)


def test_pages_leave_in_slices():
    """However many pages a batch has, only so many bytes of them are held as records at a time."""
    from fairground.sources import elements

    sizes = [400_000] * 5 + [None, 3_000_000, 10, 0, 1_000_000]
    ends = elements._slices(sizes)
    parts = [sizes[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    assert sum(parts, []) == sizes and len(parts) == 5 and all(len(p) == 1 or sum(x or 0 for x in p) <= elements.SLICE_BYTES for p in parts)
    assert elements._slices([]) == []


def test_a_date_is_read_once(spark):
    """Each part of a written range is worked out once a value, and no cast fails on the parts that aren't there."""
    from fairground.functions import grammar

    texts = ["2026年12月30日—1月2日", "12月31日-1月31日", "2026.2.28~2026.3.1", "2026年2月30日", "5月3日至1日", "5月3日 - 5日", "即日起至5月3日", "2026年1月1日—2027年2月1日", "x 2026/3/4 19:00", "", None, "13月1日", "2026年5月3日—32日"]
    frame = spark.createDataFrame([(k, t, 2026 if k % 2 else None) for k, t in enumerate(texts)], "k int, t string, y int")
    rows = frame.select("k", grammar.explicit_range(frame.t, frame.y).alias("r"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 7 and plan.count("regexp_replace(") == 3 and "as int" in plan
    got = {r.k: (str(r.r.start), str(r.r.end)) for r in rows.collect() if r.r}
    assert got == {0: ("2026-12-30", "2027-01-03"), 1: ("2026-12-31", "2027-02-01"), 2: ("2026-02-28", "2026-03-02"), 5: ("2026-05-03", "2026-05-06"), 8: ("2026-03-04", "2026-03-05")}


def test_written_ranges_are_read_once_a_row(spark):
    """Neither a filter nor a generator reads the dates of a row, or a body, a second time."""
    for name, regexes in (("explicit_ranges", 7), ("month_blocks", 7)):
        assert queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == regexes, name
    assert queries.QUERIES["posts_feed"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_bare_tags_skip_the_parsers_own_reading(monkeypatch):
    """Tags without attributes are taken as they stand, with the elements and texts that the parser's own reading gives."""
    import random
    from html.parser import HTMLParser

    from fairground.sources import elements

    asked, plain = [], HTMLParser.parse_starttag
    monkeypatch.setattr(HTMLParser, "parse_starttag", lambda self, i: asked.append(i) or plain(self, i))
    page = elements.Page("<div><p>a<p>b</p><ul><li>c<li>d</ul></div>" * 20)
    assert not asked and len(page.elements) == 120
    bits = ["<p>", "</p>", "<div>", "</div>", "<li>", "<ul>", "</ul>", "<td>", "<table>", "<script>", "</script>", "<title>", "</title>", "<textarea>", "<br>", "<br/>", "<a href='x'>", "</a>", "<P>", "</ p>", "<p", "</p", "<", "&amp;", "a<b", "<!-- c -->", "<h1>", "</h1 >", "<plaintext>", "<noscript>", "<svg>", "<b class='q' class=z>", "x"]
    rng = random.Random(5)
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(2000)]
    fast = [(p.texts, p.elements) for p in map(elements.Page, texts)]
    for name in ("parse_starttag", "parse_endtag", "updatepos"):
        monkeypatch.delattr(elements._Reader, name)
    assert fast == [(p.texts, p.elements) for p in map(elements.Page, texts)]


def test_addresses_and_places_are_worked_out_once(spark):
    """What a fold or a filter uses several times isn't written out for each use."""
    from fairground import admissions  # noqa: F401

    plan = lambda name: queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan("gated_details").count("regexp_extract(") <= 7
    assert plan("admitted_details").count("regexp_extract_all(") <= 14
    assert plan("resolved_districts").count("regexp_replace(") <= 60


def test_plain_pages_skip_the_parser(monkeypatch):
    """A page of texts and plain tags is cut in one pass; its elements, texts and selections are those of the parser's reading."""
    import random

    from fairground.sources import elements

    fed, feed = [], elements._Reader.feed
    monkeypatch.setattr(elements._Reader, "feed", lambda self, html: fed.append(html) or feed(self, html))
    page = elements.Page('<ul class="a b"><li class="b" id="k">x &amp; y<br/><a href="/1?p=2">z</a><li>w</ul>')
    assert not fed and page.text(page.first(page.whole, elements.Where(id="k"))) == "x & y z" and page.elements[3]["attributes"] == {"href": "/1?p=2"}
    assert [e["pre"] for e in page.every(page.whole, (elements.Where("a"), elements.Where(cls="b")))] == [0, 1, 3]
    for odd in ("<P>", "<p", "<a href='x'>", '<a href="?a&amp;b">', '<a b="c"d="e">', "<!-- -->", "<script>", "</p >", "<"):
        elements.Page(f"<p>{odd}")
    assert len(fed) == 9
    bits = ["<p>", "</p>", "<div>", "</div>", "<li>", "</li>", "<ul>", "</ul>", "<td>", "<tr/>", "<table>", "<br />", "<template>", "</template>", '<a href="x" class="c d">', "</a>", '<li class="c"/>', '<b id="" data-n1="q">', "</b>", "&am", "x", " > ", "\n", "<b id=q>", "<title>"]
    rng = random.Random(7)
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(2000)]
    fed.clear()
    fast = [(p.texts, p.elements) for p in map(elements.Page, texts)]
    assert len(fed) < 1600
    monkeypatch.setattr(elements, "_PLAIN", elements.re.compile("()()()()(?!)"))
    assert fast == [(p.texts, p.elements) for p in map(elements.Page, texts)] and fed[-1] == next(t for t in reversed(texts) if "<" in t)


def test_notices_are_placed_once_for_all_that_a_review_asks(spark, monkeypatch):
    """The guards and their members, which a review uses several times, come from one reading of the log."""
    from fairground import upkeep
    from fairground.operators import guards

    met, plain = [], guards.placed
    monkeypatch.setattr(guards, "placed", lambda *a: met.append(a) or plain(*a))
    rows = upkeep.reviewed_disassociation(spark, SF)
    assert len(met) == 1 and "Relation" not in rows._jdf.queryExecution().optimizedPlan().toString()
    life, members = guards.guards_and_members(upkeep.ledger(spark, SF))
    as_rows = lambda df: sorted(map(tuple, df.collect()))
    assert as_rows(life) == as_rows(guards.guard_life(upkeep.ledger(spark, SF))) and as_rows(members) == as_rows(guards.guard_members(upkeep.ledger(spark, SF)))


def test_pictures_are_gathered_in_one_grouping(spark):
    """Pairs of ids and pictures are told apart where they are gathered, and ids come along without a join of their own."""
    from fairground.operators import intake

    details = spark.createDataFrame([(1, ["https://i/1"]), (1, ["https://i/1", "https://i/2"]), (None, ["https://i/1"]), (2, [])], "id long, images array<string>")
    manifest = spark.createDataFrame([(f"https://i/{k}", f"{k}" * 64 + ".png") for k in (1, 2)], "url string, asset string")
    rows = intake.approved_images(details, manifest)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("Aggregate ") == 2
    assert {r.id: sorted(r.images) for r in rows.collect()} == {1: ["https://i/1", "https://i/2"], 2: [], None: []}


def test_copies_are_compared_once(spark, monkeypatch):
    """Rows that are alike are one kind: their pairs are the same as by a loop over all rows, and copies add nothing that is compared."""
    from fairground.functions.text import common
    from fairground.operators import evidence

    monkeypatch.setattr(evidence, "SLICE", 3)
    titles = ["Evening concert of the city orchestra", "Evening concert of the city orchestras", "Evening concert at the city orchestra", "Talk"]
    days = ["2026-01-01 10:00:00", "2026-01-02 10:00:00", None]
    first = [(titles[k % 4], days[k // 4 % 3], ["A", "B", None][k // 12 % 3]) for k in range(36)]

    def frame(n):
        rows = [(k + 36 * c, *row) for c in range(n) for k, row in enumerate(first)]
        return rows, spark.createDataFrame(rows, "id long, title string, at string, district string").selectExpr("id", "title", "cast(at as timestamp_ntz) as start_at", "true as all_day", "district")

    compared = []
    for n in (1, 8):
        rows, df = frame(n)
        slices, near = evidence.duplicate_kinds(df)
        compared.append({(r.a, r.b) for r in near.collect()})
        norm = [t.lower().replace(" ", "") for t in titles]
        alike = {(s, t) for s in range(4) for t in range(4) if s == t or 200 * common(norm[s], norm[t]) >= 93 * len(norm[s] + norm[t])}
        want = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[2] and x[2] == y[2] and (titles.index(x[1]), titles.index(y[1])) in alike and None in (x[3], y[3], None if x[3] == y[3] else 0)}
        got = [tuple(r) for r in evidence.duplicate_pairs(df).collect()]
        assert len(got) == len(set(got)) and set(got) == want and (n == 1 or len(want) > 3000)
        held = slices.collect()
        assert max(len(r.ids) for r in held) <= 3 and sorted(i for r in held for i in r.ids) == [r[0] for r in rows]
    assert compared[0] == compared[1] and len(compared[0]) > 10


def test_ratios_of_many_pairs():
    """Worked out together, texts of any length have the common subsequences that they have one by one."""
    import random

    from fairground.functions.text import common, commons

    rng = random.Random(3)
    of = lambda n: "".join(rng.choice("abcd中\0") for _ in range(n))
    a = [of(rng.choice([0, 1, 8, 9, 33, 63, 64, 65, 128, 129])) for _ in range(3000)]
    b = [of(rng.choice([0, 1, 8, 30, 64, 65, 128, 129])) if rng.random() < 0.5 else "".join(c if rng.random() < 0.9 else "b" for c in t) for t in a]
    assert commons(a, b).tolist() == [common(x, y) for x, y in zip(a, b, strict=True)] and commons([], []).tolist() == []

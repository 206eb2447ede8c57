"""MinHash near-duplicates by a multi-index Hamming join.

Every text's set of word shingles gets ``POSITIONS`` minhash symbols of 16 bits.  Two sets of similarity
s differ in about (1-s) of the symbols; the join finds every pair that differs in at most ``radius`` of
them.  The radius follows from the threshold (``plan_of``): it is the smallest that a pair just at the threshold
exceeds with a chance of at most ``MISS``.  The signature is split into chunks.  By pigeonhole, if ``radius = chunks * e + rest``,
such a pair has at most e errors in one of the first rest+1 chunks, or at most e-1 in one of the others;
so each chunk is indexed once for each choice of that many symbols to be passed over, and the
pair meets under at least one key.  Above the threshold the chance of a miss (``miss_probability``) is far less.
Links are confirmed on the full sets.

Work is kept from growing with the square of a group:
  1. equal sets become one class; only classes are indexed;
  2. each key pairs its classes with the smallest one only; those pairs are confirmed and components formed;
  3. only keys that still hold several components are looked at again.  There the other pairs between
     different components are tested on signatures within tasks, in blocks of bounded size, each pair under
     its first common key alone; the blocks of one large component don't meet each other.  A block's classes that
     have a partner within the radius get their full sets and meet once more; links alone leave the task, so no
     row is made for a pair that is refused.
To confirm the pairs with smallest classes, they are dealt into cells by the hashes of both ends; a set goes
once to each cell that needs it, not once to each pair.
No pair of classes that the join is bound to find is lost: it is either confirmed, refused, or
already inside one component.

Nulls and the like: a null or wordless text has an empty set, linked with nothing.  A row of null
doc_id reports its set, a null component and kept = false, and links nothing.  Rows that share a doc_id
are taken by their texts.  An empty table gives an empty table.
"""

from __future__ import annotations

import functools
import itertools
import math
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairground.llm._shared import batch, column, cut, frugal, table
from fairground.llm._words import LOWER, SPACED, Block, blocks, mix, windows

SHINGLE = 5
POSITIONS = 128
MORE_POSITIONS = 128
#: The chance that a pair just at the threshold is outside the radius, at most, and outside that of all POSITIONS + MORE_POSITIONS symbols.
MISS = 2e-5
WIDE_MISS = 1e-6
#: At least so many chunks.
CHUNKS = 32
THRESHOLD = 85
BLOCK = 2048
#: A larger set counts as several of a block's classes.
BLOCK_SHINGLES = 4096
#: Pairs of a cell, on average.
CELL_PAIRS = 2048
PART_ROWS = 200_000
#: Ids of at most so many rows (16 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 400_000

_random = np.random.RandomState(20240607)
_FACTORS = (_random.randint(0, 1 << 31, POSITIONS + MORE_POSITIONS, dtype=np.int64).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_TERMS = _random.randint(0, 1 << 32, POSITIONS + MORE_POSITIONS, dtype=np.int64).astype(np.uint32)


def miss_probability(similarity: float, radius: int | None = None, more: int = 0) -> float:
    """Chance that two sets of this similarity differ in more than ``radius`` (that of THRESHOLD) of POSITIONS symbols and ``more`` short ones."""
    radius, differ = PLAN.radius if radius is None else radius, np.ones(1)
    for n, bits in ((POSITIONS, 16), (more, 8)):
        p = (1 - similarity) * (1 - 2.0**-bits)
        differ = np.convolve(differ, [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])
    return float(differ[radius + 1 :].sum())


class Plan(NamedTuple):
    radius: int
    #: For all POSITIONS + MORE_POSITIONS symbols.
    wide_radius: int
    #: The positions that make up each key.
    keys: list[np.ndarray]


def index_plan(positions: int, radius: int, chunks: int) -> list[np.ndarray]:
    """The positions that make up each key."""
    edges = np.linspace(0, positions, chunks + 1).astype(int)
    errors, rest = divmod(radius, chunks)
    plan = []
    for c in range(chunks):
        span, skip = range(edges[c], edges[c + 1]), errors if c <= rest else errors - 1
        if skip >= 0:
            plan += [np.array(keep) for keep in itertools.combinations(span, len(span) - skip)]
    return plan


@functools.cache
def plan_of(threshold: int) -> Plan:
    """The radii and keys for a threshold in hundredths; there are so many chunks that a key passes over one symbol at most."""
    radius = next(r for r in range(POSITIONS + 1) if miss_probability(threshold / 100, r) <= MISS)
    wide = next(r for r in range(POSITIONS + MORE_POSITIONS + 1) if miss_probability(threshold / 100, r, MORE_POSITIONS) <= WIDE_MISS)
    chunks = CHUNKS
    while radius >= 2 * chunks:
        chunks *= 2
    return Plan(radius, wide, index_plan(POSITIONS, radius, chunks))


PLAN = plan_of(THRESHOLD)
RADIUS = PLAN.radius


def signature(shingles: np.ndarray) -> bytes:
    """The bytes of POSITIONS symbols of 16 bits and MORE_POSITIONS of 8 bits of a set of 64-bit hashes."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_FACTORS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(least, (_FACTORS[:, None] * x[None, at : at + 512] + _TERMS[:, None]).min(axis=1), out=least)
    symbols = mix(least.astype(np.uint64) + np.arange(len(least), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (symbols[:POSITIONS] >> np.uint64(48)).astype(np.uint16).tobytes() + (symbols[POSITIONS:] >> np.uint64(56)).astype(np.uint8).tobytes()


def chunk_keys(signatures: np.ndarray, plan: Plan = PLAN) -> np.ndarray:
    """One 64-bit key for each row and each entry of the plan."""
    wide = signatures.astype(np.uint64)
    out = np.empty((len(wide), len(plan.keys)), np.uint64)
    for k, keep in enumerate(plan.keys):
        key = np.full(len(wide), np.uint64(k + 1))
        for p in keep:
            key = (key ^ wide[:, p]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
        out[:, k] = mix(key)
    return out


def shingle_sets(texts: pa.Array, size: int = SHINGLE):
    """(row, distinct sorted 64-bit shingle hashes) of each text."""
    for first, end, data, offsets in blocks(texts):
        block = Block(LOWER[data], offsets)
        starts, ends, at = block.words(SPACED)
        hashes = block.hashes(starts, ends)
        runs, at = windows(hashes, size), at.tolist()
        for i in range(end - first):
            a, b = at[i], at[i + 1]
            if b - a >= size:
                yield first + i, np.unique(runs[a : b - size + 1])
            else:
                yield first + i, windows(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    a, b = mix(shingles + np.uint64(1)), mix(shingles ^ np.uint64(0xC2B2AE3D27D4EB4F))
    pair = mix(np.array([a.sum(), b.sum() + np.uint64(len(shingles))], np.uint64))
    return tuple(pair.view(np.int64).tolist())


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, node, check, signature): node and check are 64-bit digests of the set."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("check", pa.int64()), ("signature", pa.binary())])

    def scan(batches):
        for rows in batches:
            n, node, check, signed = [], [], [], []
            for _, s in shingle_sets(column(rows, "text")):
                a, b = _digest(s)
                n.append(len(s))
                node.append(a)
                check.append(b)
                signed.append(signature(s) if len(s) else None)
            yield batch(schema, column(rows, "doc_id"), n, node, check, signed)

    return docs.select("doc_id", "text").mapInArrow(frugal(scan), "doc_id long, n_shingles long, node long, check long, signature binary")


def index(classes: DataFrame, plan: Plan = PLAN) -> DataFrame:
    """(key, node): a row for each class and key."""
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64())])

    def scan(batches):
        for rows in batches:
            signed, nodes = column(rows, "signature"), column(rows, "node").to_numpy()
            for at in range(0, len(nodes), 2048):
                some = nodes[at : at + 2048]
                keys = chunk_keys(_matrix(signed.slice(at, len(some)).to_pylist())[:, :POSITIONS], plan)
                yield batch(schema, keys.view(np.int64).ravel(), np.repeat(some, keys.shape[1]))

    return classes.select("node", "signature").mapInArrow(frugal(scan), "key long, node long")


def _matrix(signed) -> np.ndarray:
    """A row of symbols for each signature."""
    raw = np.frombuffer(b"".join(signed), np.uint8).reshape(len(signed), 2 * POSITIONS + MORE_POSITIONS)
    head = np.ascontiguousarray(raw[:, : 2 * POSITIONS]).view(np.uint16)
    return np.hstack([head, raw[:, 2 * POSITIONS :].astype(np.uint16)])


def within_radius(a: np.ndarray, b: np.ndarray, plan: Plan = PLAN) -> np.ndarray:
    """For signatures of two blocks, which pairs are within both radii."""
    near = np.zeros((len(a), len(b)), bool)
    for i in range(len(a)):
        differ = b[:, :POSITIONS] != a[i, :POSITIONS]
        j = np.flatnonzero(differ.sum(axis=1) <= plan.radius)
        if len(j):
            near[i, j[(b[j] != a[i]).sum(axis=1) <= plan.wide_radius]] = True
    return near


def near_pairs(pairs: DataFrame, classes: DataFrame, plan: Plan = PLAN) -> DataFrame:
    """Those of the pairs (a, b) whose signatures are within the radii."""
    signed = classes.select("node", "signature")
    both = pairs.join(signed.toDF("b", "sb"), "b").join(signed.toDF("a", "sa"), "a")

    def scan(batches):
        for rows in batches:
            if rows.num_rows:
                a, b = (_matrix(column(rows, c).to_pylist()) for c in ("sa", "sb"))
                differ = a != b
                keep = pa.array((differ[:, :POSITIONS].sum(axis=1) <= plan.radius) & (differ.sum(axis=1) <= plan.wide_radius))
                yield rows.select(["a", "b"]).filter(keep)

    return both.mapInArrow(frugal(scan), "a long, b long")


def full_sets(nodes: DataFrame, docs: DataFrame, signed: DataFrame) -> DataFrame:
    """(node, set): the sorted shingle hashes of each of the distinct nodes, once, however many rows have them."""
    ids = cut(signed.where("doc_id is not null").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct())
    texts = docs.select("doc_id", "text").join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    schema = pa.schema([("node", pa.int64()), ("set", pa.binary())])

    def sets(batches):
        for rows in batches:
            found = [(_digest(s)[0], s.tobytes()) for _, s in shingle_sets(column(rows, "text"))]
            yield batch(schema, [f[0] for f in found], [f[1] for f in found])

    return texts.mapInArrow(frugal(sets), "node long, set binary").dropDuplicates(["node"])


def confirm(pairs: DataFrame, docs: DataFrame, signed: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Those of the pairs (a, b) of nodes with 100 * shared >= threshold * union on the full sets."""
    side = min(4096, math.ceil(math.sqrt(max(1, pairs.count()) / CELL_PAIRS)))
    cell = F.pmod(F.xxhash64("a"), F.lit(side)) * side + F.pmod(F.xxhash64("b"), F.lit(side))
    pairs = pairs.select("a", "b", cell.alias("cell"))
    needed = cut(pairs.select("cell", F.col("a").alias("node")).union(pairs.select("cell", F.col("b").alias("node"))).distinct())
    full = needed.join(full_sets(needed.select("node").distinct(), docs, signed), "node").select("cell", "node", "set")

    def compare(pairs: pd.DataFrame, full: pd.DataFrame) -> pd.DataFrame:
        known = {n: np.frombuffer(s, np.uint64) for n, s in zip(full["node"], full["set"], strict=True)}
        keep = np.zeros(len(pairs), bool)
        for k, (a, b) in enumerate(zip(pairs["a"], pairs["b"], strict=True)):
            x, y = known[a], known[b]
            shared = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
            keep[k] = 100 * shared >= threshold * (len(x) + len(y) - shared)
        return pairs.loc[keep, ["a", "b"]]

    return pairs.groupBy("cell").cogroup(full.groupBy("cell")).applyInPandas(compare, "a long, b long")


def few(df: DataFrame) -> DataFrame:
    """``cut`` with a partition for each ``PART_ROWS`` rows at most, as links and components are often few."""
    df = cut(df)
    return df.coalesce(max(1, math.ceil(df.count() / PART_ROWS)))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of the edges (a, b) reaches.

    Alternating large-star and small-star steps; each keeps connectivity and brings nodes nearer to the
    smallest, and the edges are cut after each round, so a lost executor repeats one round at most.
    """
    edges = few(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = few(small)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before = now


def _groups(batches, key: list[str]):
    """The rows of each key as a table, from batches that are sorted by the key; a key may go over several batches."""
    rest = None
    for rows in itertools.chain(batches, [None]):
        parts = [r for r in (rest, rows) if r is not None and r.num_rows]
        if not parts:
            continue
        whole = pa.Table.from_batches(parts).combine_chunks() if len(parts) > 1 else pa.Table.from_batches(parts)
        group = np.stack([whole.column(c).to_numpy() for c in key])
        edges = np.flatnonzero(np.append(True, (group[:, 1:] != group[:, :-1]).any(axis=0)))
        edges = np.append(edges, whole.num_rows)
        if rows is not None:
            rest = whole.slice(edges[-2]).combine_chunks().to_batches()[0]
            edges = edges[:-1]
        for a, b in itertools.pairwise(edges.tolist()):
            yield whole.slice(a, b - a)


def _meet(rows: pa.Table, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Rows (x, y) of a block whose classes are in different components, within the radii, and have no earlier common key."""
    this, i, j = (rows.column(c)[0].as_py() for c in ("key", "i", "j"))
    part, label = (rows.column(c).to_numpy() for c in ("part", "label"))
    a, b = np.flatnonzero(part == i), np.flatnonzero(part == j)
    if not len(a) or not len(b) or (label == label[0]).all():
        return a[:0], a[:0]
    signed = _matrix(rows.column("signature").to_pylist())
    keys = chunk_keys(signed[:, :POSITIONS], plan)
    found = within_radius(signed[a], signed[b], plan) & (label[a][:, None] != label[b][None])
    if i == j:
        found = np.triu(found, 1)
    x, y = (of[k] for of, k in zip((a, b), np.nonzero(found), strict=True))
    if len(x):
        first = keys[x, (keys[x] == keys[y]).argmax(axis=1)].view(np.int64) == this
        x, y = x[first], y[first]
    return x, y


def _linked(x: np.ndarray, others: list[np.ndarray], threshold: int) -> np.ndarray:
    """Which of the other sets a set is linked with."""
    sizes = np.array([len(o) for o in others])
    every = np.concatenate(others)
    same = x[np.minimum(np.searchsorted(x, every), len(x) - 1)] == every
    shared = np.add.reduceat(same.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    return 100 * shared >= threshold * (len(x) + sizes - shared)


def _open_links(keys: DataFrame, classes: DataFrame, labels: DataFrame, docs: DataFrame, signed: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) between components, of pairs that share a key (key, node), are within the radii, and are no star pairs.

    ``keys`` has no smallest node of a key: its pairs are star pairs.
    """
    block, plan = ["key", "i", "j"], plan_of(threshold)
    of_node = classes.select("node", "n_shingles").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), F.ceil(F.col("n_shingles") / BLOCK_SHINGLES).alias("weight"))
    labelled = few(keys.join(of_node, "node"))
    # A component of half a block and over has parts of its own, which need not meet each other; the smaller ones share parts.
    of_label = labelled.groupBy("key", "label").agg(F.sum("weight").alias("n"))
    small = F.when(2 * F.col("n") < BLOCK, F.col("n"))
    of_key = of_label.groupBy("key").agg(F.count("*").alias("labels"), F.coalesce(F.sum(small), F.lit(0)).alias("small")).where("labels > 1")
    placed = few(of_label.join(of_key, "key").select("key", "label", small.isNull().alias("large"), F.ceil(F.when(small.isNull(), F.col("n")).otherwise(F.col("small")) / BLOCK).alias("parts")))
    part = lambda k: F.when(F.col("large"), F.xxhash64("label", k)).otherwise(F.xxhash64(k)).alias("part")
    shared = placed.where("not large").groupBy("key").agg(F.first("parts").alias("parts")).select("key", F.lit(None).cast("long").alias("label"), F.lit(False).alias("large"), "parts")
    every = placed.where("large").unionByName(shared).withColumn("k", F.explode(F.expr("sequence(0L, parts - 1)")))
    parts = every.select("key", F.col("label").alias("owner"), part(F.col("k")))
    meet = parts.toDF("key", "of_i", "i").join(parts.toDF("key", "of_j", "j"), "key").where("i <= j and not coalesce(of_i = of_j, false)").select("key", "i", "j")
    sides = meet.select("*", F.col("i").alias("part")).union(meet.where("i < j").select("*", F.col("j").alias("part")))
    members = labelled.join(placed, ["key", "label"]).select("key", "node", "label", part(F.pmod(F.xxhash64(F.when(F.col("large"), F.col("node")).otherwise(F.col("label"))), F.col("parts"))))
    met = members.join(sides, ["key", "part"]).select("key", "node", "label", "i", "j", "part")
    dealt = met.join(classes.select("node", "signature"), "node").repartition(*block).sortWithinPartitions(*block)

    def partners(batches):
        for rows in _groups(batches, block):
            x, y = _meet(rows, plan)
            if len(x):
                yield from rows.take(np.unique(np.concatenate([x, y]))).combine_chunks().to_batches()

    near = cut(dealt.mapInArrow(frugal(partners), dealt.schema))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(batches):
        for rows in _groups(batches, block):
            (x, y), node = _meet(rows, plan), rows.column("node").to_numpy()
            order = np.argsort(x, kind="stable")
            x, y = x[order], y[order]
            sets = [np.frombuffer(s, np.uint64) for s in rows.column("set").to_pylist()]
            for those in np.split(np.arange(len(x)), np.flatnonzero(np.diff(x)) + 1):
                if len(those):
                    a, b = x[those], y[those]
                    keep = _linked(sets[a[0]], [sets[k] for k in b], threshold)
                    if keep.any():
                        yield batch(schema, node[a[keep]], node[b[keep]])

    full = near.join(full_sets(near.select("node").distinct(), docs, signed), "node")
    return full.repartition(*block).sortWithinPartitions(*block).mapInArrow(frugal(links), "a long, b long")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    signed = cut(sign(docs))
    usable = signed.where("doc_id is not null and n_shingles > 0")
    ids = usable.groupBy("node", "check").agg(F.min("doc_id").alias("smallest"))
    classes = cut(usable.join(ids, ["node", "check"]).where("doc_id = smallest").dropDuplicates(["node", "check"]).select("node", "n_shingles", "signature"))

    plan = plan_of(threshold)
    # Counts and smallest nodes are added up before the shuffle; in the join a hot key's rows can be split.
    shared = index(classes, plan).groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1")
    keys = few(index(classes, plan).join(shared, "key").where("node <> least"))
    stars = keys.select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    links = few(confirm(few(near_pairs(stars, classes, plan)), docs, signed, threshold))
    labels = components(links)
    more = few(_open_links(keys.where("n > 2").select("key", "node"), classes, labels, docs, signed, threshold))
    if not more.isEmpty():
        labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more))

    named = ids.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = named.groupBy("label").agg(F.min("smallest").alias("component_id"))
    named = named.join(smallest, "label").select("node", "check", "component_id")
    out = signed.select("doc_id", "n_shingles", "node", "check").join(named, ["node", "check"], "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y using (g) where x.doc_id <> y.doc_id group by x.doc_id, y.doc_id),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
reach(a, b) as (select doc_id, doc_id from documents union select r.a, e.b from reach r join e on r.b = e.a),
c as (select a as doc_id, min(b) as component_id from reach group by a)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from documents left join n using (doc_id) join c using (doc_id)
"""

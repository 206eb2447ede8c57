"""Merkle fixity audit of WARC replicas.

A record's bytes are hashed on their own (SHA-256).  The records of a file are ordered by offset, and tree nodes are
fixed ranges of that order: a leaf range holds the records that start in ``LEAF_BYTES`` of the file, and a node of
the next level holds ``FANOUT`` ranges.  A node's hash is the hash of its children's (offset, hash) in order, so
no node has more children than a range can hold, whatever the size of the file.

The audit compares the roots of two replicas and goes down only where hashes differ: each level is joined with the
children of the nodes that mismatched above it, so work beyond the roots follows the damage, not the archive.  In the
leaf ranges that differ, records are compared by their offsets or by ids of their own; by ids, one with the same bytes at
another offset has only moved (a record before it was lost or cut short).

Null payloads are records of no bytes.  A null file name is a file of its own; a null offset is taken as 0.
Equal rows of a range are counted, and its records hashed in parts by their hashes, so that no task gathers the copies of one
row, or the many records that share an offset.
Repeated rows (same file and offset) are hashed together in order of their hash, and met in order of offset and hash where
their ids are the same or null.  Empty replicas match.  Other columns of the replicas are left aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairground.llm._shared import cut, table

LEAF_BYTES = 1 << 16
FANOUT = 16
#: Records of a leaf range are hashed in parts by so many hex digits of their hashes.
PART_DIGITS = 3
#: Equal records get their offsets in runs of so many.
RUN = 65_536
#: Of the archive that the query makes: pages of a file.
FILE_PAGES = 256


def warc_record(uri: Column, payload: Column, identity: Column) -> Column:
    """The bytes of one response record of WARC/1.1; its id is made from ``identity``, and its date is a fixed one."""
    body = F.encode(F.coalesce(payload, F.lit("")), "UTF-8")
    digits = F.substring(F.sha2(F.coalesce(identity, F.lit("")).cast("string"), 256), 1, 32)
    uuid = F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Record-ID: <urn:uuid:"), uuid, F.lit(">\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def records_of(pages: DataFrame, file_pages: int = FILE_PAGES) -> DataFrame:
    """(file, page_id, record): the pages as the records of WARC files of ``file_pages`` consecutive ids.

    Pages of null id go to files by a hash of address and html.
    """
    content = F.md5(F.encode(F.concat(F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))), "UTF-8"))
    numbered = F.format_string("part-%08d.warc", F.floor(F.col("page_id") / file_pages))
    file = F.when(F.col("page_id").isNull(), F.format_string("null-%s.warc", F.substring(content, 1, 5))).otherwise(numbered)
    return pages.select(file.alias("file"), "page_id", warc_record(F.col("url"), F.col("html"), F.col("page_id").cast("string")).alias("record"))


def hash_records(records: DataFrame) -> DataFrame:
    """``records`` with length and sha in the place of their bytes (``record``); the bytes go no further."""
    raw = F.coalesce("record", F.encode(F.lit(""), "UTF-8"))
    return records.select(*(c for c in records.columns if c != "record"), F.octet_length(raw).cast("long").alias("length"), F.sha2(raw, 256).alias("sha"))


def lay_out(hashed: DataFrame) -> DataFrame:
    """Adds ``offset``: the records of a file one after another in order of page_id; equal ones are counted first."""
    counted = hashed.groupBy("file", "page_id", "length", "sha").agg(F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("page_id", "sha", "length").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("from", F.coalesce(F.sum(F.col("length") * F.col("n")).over(before), F.lit(0)))
    runs = placed.withColumn("run", F.explode(F.expr(f"sequence(0L, (n - 1) div {RUN})")))
    rows = runs.withColumn("at", F.explode(F.expr(f"sequence(run * {RUN}, least(n, (run + 1) * {RUN}) - 1)")))
    return rows.select("file", "page_id", "length", "sha", (F.col("from") + F.col("at") * F.col("length")).alias("offset"))


def merkle_levels(hashed: DataFrame, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT) -> list[DataFrame]:
    """From the leaf ranges up to one root a file: (file, node, sha, parent)."""

    def digest(rows: DataFrame, keys: list, values: list[str]) -> DataFrame:
        order = F.array_sort(F.collect_list(F.struct(*values)))
        return rows.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(order, lambda r: F.concat_ws(":", *(r[v] for v in values))), "\n"), 256).alias("sha"))

    counted = hashed.groupBy("file", F.floor(F.col("offset") / leaf_bytes).alias("node"), "offset", "length", "sha").agg(F.count("*").alias("n"))
    parts = digest(counted, ["file", "node", F.substring("sha", 1, PART_DIGITS).alias("part")], ["offset", "length", "sha", "n"])
    level = digest(parts, ["file", "node"], ["part", "sha"])
    levels = [cut(level.withColumn("parent", F.floor(F.col("node") / fanout)))]
    while (levels[-1].agg(F.max("node")).first()[0] or 0) > 0:
        level = digest(levels[-1], ["file", "parent"], ["node", "sha"]).withColumnRenamed("parent", "node")
        levels.append(cut(level.withColumn("parent", F.floor(F.col("node") / fanout))))
    return levels


def audit(first: DataFrame, second: DataFrame, by: str = "offset", leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT) -> DataFrame:
    """(file, id, offset, length, status) of every record that is not the same in both replicas.

    Both have (file, offset, length, sha) and what tells the records of a file apart, which is ``id`` in the result.
    status: changed (other bytes), moved (the same bytes at another offset), missing (not in the second) or extra (not in the
    first).  Offset and length are those of the first replica, and of the second for what is extra.
    """
    offset = F.coalesce(F.col("offset"), F.lit(0)).cast("long")
    key = offset if by == "offset" else F.col(by)
    first, second = (side.select("file", key.alias("id"), offset.alias("offset"), "length", "sha") for side in (first, second))
    a, b = merkle_levels(first, leaf_bytes, fanout), merkle_levels(second, leaf_bytes, fanout)
    depth = max(len(a), len(b))
    # A replica of lower files stands under the same ranges: its root is carried up unchanged.
    wrong = None
    for k in reversed(range(depth)):
        x, y = (levels[min(k, len(levels) - 1)].select("file", "node", "parent", "sha") for levels in (a, b))
        if wrong is not None:
            reach = wrong.withColumnRenamed("node", "parent")
            x, y = (side.join(reach, (side["file"].eqNullSafe(reach["file"])) & (side["parent"] == reach["parent"]), "left_semi") for side in (x, y))
        met = x.alias("x").join(y.alias("y"), F.col("x.file").eqNullSafe(F.col("y.file")) & (F.col("x.node") == F.col("y.node")), "full_outer")
        wrong = cut(met.where(~F.col("x.sha").eqNullSafe(F.col("y.sha"))).select(F.coalesce("x.file", "y.file").alias("file"), F.coalesce("x.node", "y.node").alias("node")))

    def inside(side: DataFrame) -> DataFrame:
        side = side.withColumn("node", F.floor(F.col("offset") / leaf_bytes))
        kept = side.join(wrong, side["file"].eqNullSafe(wrong["file"]) & (side["node"] == wrong["node"]), "left_semi")
        return kept.withColumn("place", F.row_number().over(Window.partitionBy("file", "id").orderBy("offset", "length", "sha")))

    x, y = inside(first).alias("x"), inside(second).alias("y")
    met = x.join(y, F.col("x.file").eqNullSafe(F.col("y.file")) & F.col("x.id").eqNullSafe(F.col("y.id")) & (F.col("x.place") == F.col("y.place")), "full_outer")
    same = F.col("x.sha").eqNullSafe(F.col("y.sha")) & (F.col("x.length") == F.col("y.length"))
    status = F.when(F.col("y.place").isNull(), "missing").when(F.col("x.place").isNull(), "extra").when(~same, "changed").when(F.col("x.offset") != F.col("y.offset"), "moved")
    # Only where a replica lacks the record is its place null, and then the file may be null in both.
    of = lambda c: F.when(F.col("x.place").isNull(), F.col(f"y.{c}")).otherwise(F.col(f"x.{c}")).alias(c)
    return met.select(of("file"), of("id"), of("offset"), of("length"), status.alias("status")).where("status is not null")


def damaged(records: DataFrame) -> DataFrame:
    """A replica with known damage: of ids 37 (mod 101) one bit of the record's middle byte is turned, those of 50 (mod 2111) are lost."""
    middle = "(octet_length(record) div 2)"
    turned = F.expr(f"concat(substring(record, 1, {middle} - 1), unhex(lpad(hex(cast(conv(hex(substring(record, {middle}, 1)), 16, 10) as int) ^ 1), 2, '0')), substring(record, {middle} + 1))")
    record = F.when(F.col("page_id") % 101 == 37, turned).otherwise(F.col("record"))
    return records.where("page_id is null or page_id % 2111 <> 50").withColumn("record", record)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of all pages against a replica of known damage: (page_id, file, offset, length, status)."""
    records = records_of(table(spark, sf_dir, "pages"))
    first, second = (cut(lay_out(hash_records(replica))) for replica in (records, damaged(records)))
    return audit(first, second, "page_id").select(F.col("id").alias("page_id"), "file", "offset", "length", "status")


OP9_SQL = r"""
with p as (select page_id, coalesce(url, '') as url, coalesce(html, '') as html from pages),
r as (select page_id, case when page_id is null then 'null-' || substr(md5(url || html), 1, 5) else 'part-' || lpad(cast(page_id // 256 as varchar), 8, '0') end || '.warc' as file,
             strlen('WARC/1.1##WARC-Type: response##WARC-Date: 1970-01-01T00:00:00Z##WARC-Record-ID: <urn:uuid:01234567-0123-0123-0123-0123456789ab>##WARC-Target-URI: ' || url
                    || '##Content-Type: text/html##Content-Length: ' || cast(strlen(html) as varchar) || '####') + strlen(html) + 4 as length from p),
o as (select page_id, file, cast(coalesce(sum(length) over before, 0) as bigint) as "offset", length, coalesce(max(cast(page_id % 2111 = 50 as integer)) over before, 0) as shifted
      from r window before as (partition by file order by page_id rows between unbounded preceding and 1 preceding))
select page_id, file, "offset", length, case when page_id % 2111 = 50 then 'missing' when page_id % 101 = 37 then 'changed' else 'moved' end as status
from o where page_id % 2111 = 50 or page_id % 101 = 37 or shifted = 1
"""

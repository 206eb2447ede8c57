"""Sharding by jump consistent hashing, in column expressions alone.

The shard depends on the key and the number of shards only, by the published recurrence: a 64-bit
linear congruential step, then a jump to the next shard count at which the key would move.  One more
shard takes about 1/(n+1) of the rows, all into itself.  The 64-bit products are made in
DECIMAL(38,0), which holds them exactly, so nothing depends on integers that wrap.

Slots are gapless within a shard without a window over the shard: rows are dealt into buckets of a
shard, numbered inside their bucket, and raised by the counts of the buckets before.  A bucket goes by a hash of
the key with the checksum, so the copies of one text under many keys go to all buckets; equal rows (same key, size
and checksum) are first counted to one row.  There is a bucket for each ``BUCKET_ROWS`` counted rows of a shard, and
``BUCKETS`` at least, so what one task numbers doesn't grow with the table.

A null key counts as key 0; a null text has no bytes (size 8, checksum 0).  Repeated rows stay
repeated, each with its own slot; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairground.llm._shared import cut, table

SHARDS = 24
BUCKETS = 256
BUCKET_ROWS = 1_000_000
_RUN = 65_536


def _next(k: str) -> str:
    """One step of the generator, mod 2^64."""
    return f"cast(({k} * cast(2862933555777941757 as decimal(19,0)) + 1) % cast(18446744073709551616 as decimal(20,0)) as decimal(20,0))"


def jump_hash(key: str, shards: int) -> Column:
    """Shard 0 .. shards-1 of a 64-bit key column.

    The state is (k, b, j): the generator, the shard so far, and the next jump.  Once j has passed
    ``shards`` the state stays; ``shards`` steps are always enough, as j grows each time.
    """
    unsigned = f"cast(pmod(cast(coalesce({key}, 0) as decimal(20,0)), cast(18446744073709551616 as decimal(20,0))) as decimal(20,0))"
    return F.expr(
        f"cast(aggregate(sequence(1, {shards}), named_struct('k', {_next(unsigned)}, 'b', -1L, 'j', 0L), "
        f"(s, i) -> if(s.j >= {shards}L, s, named_struct('k', {_next('s.k')}, 'b', s.j, 'j', "
        f"cast(floor((s.j + 1) * (2147483648D / cast((s.k div 8589934592) + 1 as double))) as bigint))), s -> s.b) as int)"
    )


def bucket_of(buckets: int) -> Column:
    """By the upper half of a product of the key (mod 2^31), the checksum and the size."""
    spread = "(pmod(coalesce(key, 0), 2147483648L) * 2654435761L) % 4294967296L div 65536"
    return F.expr(f"cast(pmod({spread} + text_crc32 + size, {buckets}L) as int)")


def assign(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for every row."""
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    sized = docs.select(F.col(key).alias("key"), (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    counted = cut(sized.groupBy("key", "size", "text_crc32").agg(F.count("*").alias("n")).select("*", jump_hash("key", shards).alias("shard")))
    buckets = max(buckets, math.ceil(counted.agg(F.sum("n")).first()[0] or 0) // (shards * bucket_rows) + 1)
    counted = counted.withColumn("bucket", bucket_of(buckets))

    # The counts of the buckets before, dealt and sorted as the rows are, so that the join moves nothing but these.
    sums = counted.groupBy("shard", "bucket").agg(F.sum("n").alias("rows"))
    before = sums.select("shard", "bucket", (F.sum("rows").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("rows")).alias("before"))

    inside = Window.partitionBy("shard", "bucket").orderBy("key", "text_crc32", "size")
    placed = counted.withColumn("from", F.sum("n").over(inside) - F.col("n")).join(before, ["shard", "bucket"])
    # Counted rows are told apart again in runs, so that no array grows with a group of copies.
    runs = placed.withColumn("run", F.explode(F.expr(f"sequence(0L, (n - 1) div {_RUN})")))
    rows = runs.withColumn("at", F.explode(F.expr(f"sequence(run * {_RUN}, least(n, (run + 1) * {_RUN}) - 1)")))
    return rows.select(
        F.col("key").alias(key),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("before") + F.col("from") + F.col("at")).cast("long").alias("slot"),
        jump_hash("key", shards + 1).alias("grown_shard"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
with recursive tab as (select list(c order by i) as t from (select i, list_reduce(range(0, 8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) as c from (select unnest(range(0, 256)) as i))),
d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
e as (select r, doc_id, strlen(text) + 8 as size, hex(text) as h from d),
s as (select r, doc_id, size, xor(list_reduce(list_transform(range(0, size - 8), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::bigint), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295) as text_crc32 from e, tab),
g(r, n, k, b, j) as (
  select r, n, ((coalesce(doc_id, 0)::hugeint + 18446744073709551616) % 18446744073709551616 * 2862933555777941757 + 1) % 18446744073709551616, -1::bigint, 0::bigint from d, (select unnest([24, 25]) as n)
  union all
  select r, n, (k * 2862933555777941757 + 1) % 18446744073709551616, j, floor((j + 1) * (2147483648::double / ((k // 8589934592) + 1)::double))::bigint from g where j < n),
f as (select r, n, max(b) as shard from g where b < n group by r, n),
q as (select greatest(256, count(*) // 24000000 + 1) as buckets from documents),
v as (select r, (((coalesce(doc_id, 0) % 2147483648 + 2147483648) % 2147483648 * 2654435761) % 4294967296 // 65536 + text_crc32 + size) % buckets as bucket from s, q)
select doc_id, size, text_crc32, 'key' as law, cast(a.shard as integer) as shard,
       row_number() over (partition by a.shard order by bucket, doc_id, text_crc32, size) - 1 as slot, cast(z.shard as integer) as grown_shard
from s join v using (r) join f a on a.r = r and a.n = 24 join f z on z.r = r and z.n = 25
"""

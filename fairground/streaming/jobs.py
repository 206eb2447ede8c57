"""Streaming twins: files of observations or activities as they land."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, source: str) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)


def stream_observations(spark: SparkSession, source: str, target: str, state: str, watermark: str = "45 days"):
    """Appends each observation once, however often it is seen again within the watermark."""
    rows = _read(spark, source).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", watermark)
    once = rows.dropDuplicatesWithinWatermark(["observation_id"])
    return once.writeStream.format("parquet").option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start()


def daily_counts(spark: SparkSession, source: str, target: str, state: str, watermark: str = "1 day"):
    """(day, reason, n) of observations, appended to files once the watermark has passed a day.

    Late rows count while their day is open; then its state is dropped.  The last days stay open until later rows come.
    """
    rows = _read(spark, source).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", watermark)
    counts = rows.groupBy(F.window("at", "1 day"), "reason").agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "reason", "n")
    return counts.writeStream.format("parquet").option("path", target).outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, before: int | None = None, schema: str | None = None) -> DataFrame:
    """The rows of the table that ``stream_upsert`` keeps: of each bucket the newest version, or the newest before a batch."""
    rows = (spark.read.schema(schema) if schema else spark.read).parquet(target)
    if before is not None:
        rows = rows.where(F.col("version") < before)
    newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))
    return rows.join(F.broadcast(newest), ["bucket", "version"], "left_semi").drop("version")


def stream_upsert(spark: SparkSession, source: str, target: str, state: str, values: list[str], buckets: int = 256):
    """Upserts each batch into a Parquet table of buckets by id; only buckets that the batch touches get a new version.

    A replayed batch writes the same versions again, from the versions before it.  At most ``buckets`` numbers are broadcast.
    """
    from fairground.operators.evidence import upsert

    columns = ["id", *values, "origin_priority"]
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")

    def batch(rows: DataFrame, number: int) -> None:
        newest = rows.select(*columns).groupBy("id").agg(F.min_by(F.struct(*columns), F.struct("origin_priority", *values)).alias("r")).select("r.*")
        stored = rows.select(*columns).limit(0)
        if number:
            touched = rows.select(bucket.alias("bucket")).distinct()
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema) + ", version int, bucket int"
            stored = current(spark, target, number, schema).join(F.broadcast(touched), "bucket", "left_semi").select(*columns)
        merged = upsert(stored, newest, values).select(*columns, F.lit(number).alias("version"), bucket.alias("bucket"))
        # Each batch owns its versions: what an earlier try of it left is replaced, nothing else is touched.
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", "bucket").parquet(target)

    return _read(spark, source).writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()


def guard_stream(spark: SparkSession, source: str, target: str, state: str, days: int = 45):
    """Guards as state of a stream of notices: each batch writes the guards that it opens, changes or ends.

    A batch's files hold its number as ``version``; of a guard the newest version counts (``newest_guards``).
    """
    from fairground.operators.guards import guard_changes

    def batch(rows: DataFrame, number: int) -> None:
        rows.withColumn("version", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(target)

    return guard_changes(_read(spark, source), days).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()


def newest_guards(spark: SparkSession, target: str) -> DataFrame:
    rows = spark.read.parquet(target)
    values = [c for c in rows.columns if c not in ("guard_id", "version")]
    return rows.groupBy("guard_id").agg(F.max_by(F.struct(*values), "version").alias("g")).select("guard_id", "g.*")


def late_targets(spark: SparkSession, observations: str, anchors: str, target: str, state: str, watermark: str = "2 days", window: str = "30 days"):
    """(observation_id, source_id, alias, event_id, result) of notices and the anchors that come before or after them.

    A notice (observation_id, source_id, alias, day, ts) meets the anchors (source_id, alias, event_id, day, ts) of its source and
    alias from ``window`` before it to ``window`` after it: the same day is applicable, another isn't, an unknown one is
    refused.  What finds none is released once, as pending, when both watermarks have passed its window; its state then goes.
    """
    seen = _read(spark, observations).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", watermark).dropDuplicatesWithinWatermark(["observation_id"])
    found = _read(spark, anchors).withColumn("anchored", F.col("ts").cast("timestamp")).withWatermark("anchored", watermark)
    found = found.select("event_id", F.col("source_id").alias("a_source"), F.col("alias").alias("a_alias"), F.col("day").alias("a_day"), "anchored")
    near = F.expr(f"source_id = a_source and alias = a_alias and anchored >= at - interval {window} and anchored <= at + interval {window}")
    pairs = seen.join(found, near, "left_outer")
    result = F.when(F.col("a_source").isNull(), "pending").when(F.col("day").isNull() | F.col("a_day").isNull(), "refused").when(F.col("day") == F.col("a_day"), "applicable").otherwise("not_applicable")
    rows = pairs.select("observation_id", "source_id", "alias", "event_id", result.alias("result"))
    return rows.writeStream.format("parquet").option("path", target).outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start()

"""Reviewed patches by compare and set, authority over what they rest on, details as variants, inventories that add up, the run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a reviewer may change.  Fixed values.
ALLOWED = ["topics", "status", "ai_state", "priority", "commercial", "organizer", "reason", "details"]
#: Keys of details that change without the activity, and those that hold it back.  Fixed values.
VOLATILE = ["checked_at"]
HOLDS = ["review_hold", "attendance_conflict", "time_conflict"]
NOTHING = ["false", "0", "", "null", "[]", "{}"]
MOST_LOG = 8000


def _plain(c: str) -> Column:
    return F.col(f"`{c}`").cast("string")


def judge_patches(rows: DataFrame, patches: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """(id, outcome): what compare-and-set makes of patches (id, guard, patch), both maps of columns to values as text.

    already: the row has all that the patch says.  stale: there is no such row, or it isn't as the guard expects (a null value is
    one, too).  invalid: nothing or more than the allowed columns would change, the guard names no column, or the id is
    patched twice.  Otherwise applied.
    """
    allowed = [c for c in (allowed or ALLOWED) if c in rows.columns]
    now = rows.select("id", F.create_map(*(x for c in rows.columns for x in (F.lit(c), _plain(c)))).alias("now"))
    asked = patches.join(patches.groupBy("id").agg(F.count("*").alias("n")), "id").join(now, "id", "left")
    holds = lambda m: F.forall(F.map_entries(m), lambda e: F.map_contains_key("now", e["key"]) & e["value"].eqNullSafe(F.try_element_at("now", e["key"])))
    keys = F.map_keys("patch")
    valid = F.coalesce((F.col("n") == 1) & (F.size(keys) > 0) & (F.size(F.array_except(keys, F.array(*map(F.lit, allowed)))) == 0) & (F.size(F.array_except(F.map_keys("guard"), F.array(*map(F.lit, rows.columns)))) == 0), F.lit(False))
    known = F.col("now").isNotNull()
    outcome = F.when(~valid, "invalid").when(known & holds(F.col("patch")), "already").when(known & holds(F.col("guard")), "applied").otherwise("stale")
    return asked.select("id", outcome.alias("outcome")).distinct()


def apply_patches(rows: DataFrame, patches: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """``rows`` with the patches that are applied; only the columns that a patch names change."""
    allowed = [c for c in (allowed or ALLOWED) if c in rows.columns]
    good = patches.join(judge_patches(rows, patches, allowed).where("outcome = 'applied'").select("id"), "id", "left_semi").select("id", F.col("patch").alias("__patch"))
    met = rows.join(good, "id", "left")
    kinds = dict(rows.dtypes)
    value = lambda c: F.when(F.coalesce(F.map_contains_key("__patch", F.lit(c)), F.lit(False)), F.try_element_at("__patch", F.lit(c)).try_cast(kinds[c])).otherwise(F.col(f"`{c}`")).alias(c)
    return met.select(*(value(c) if c in allowed else F.col(f"`{c}`") for c in rows.columns))


def authority(events: DataFrame, links: DataFrame, anchors: DataFrame) -> DataFrame:
    """(id, signature): what stands behind an activity: its row, its links and its anchors, in any order.

    A signature counts the rows and adds up 60 bits of their hashes, by table; equal ones mean that nothing has changed.
    """

    def share(df: DataFrame, key: str, name: str) -> DataFrame:
        content = F.to_json(F.struct(*(_plain(c).alias(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"})
        return df.select(F.col(key).cast("string").alias("id"), F.conv(F.substring(F.sha2(F.concat(F.lit(f"{name}|"), content), 256), 1, 15), 16, 10).cast("decimal(38,0)").alias("h"))

    every = share(events, "id", "event").unionByName(share(links, "event_id", "link")).unionByName(share(anchors, "event_id", "anchor"))
    return every.groupBy("id").agg(F.concat_ws(":", F.count("*").cast("string"), F.sum("h").cast("string")).alias("signature"))


def authority_conflicts(read: DataFrame, now: DataFrame) -> DataFrame:
    """(id, outcome) of the signatures that decisions were made on: same, changed or gone."""
    met = read.select("id", F.col("signature").alias("was")).join(now, "id", "left")
    return met.select("id", F.when(F.col("signature").isNull(), "gone").when(F.col("signature") == F.col("was"), "same").otherwise("changed").alias("outcome"))


# --- details -------------------------------------------------------------------------------------------------


def flag(details: Column, key: str) -> Column:
    """Whether a key of JSON details holds anything but false, nothing, 0 or an empty value; false where they can't be read."""
    value = F.try_variant_get(F.try_parse_json(details), f"$.{key}", "string")
    return F.coalesce(~F.lower(value).isin(NOTHING), F.lit(False))


def held(details: Column) -> Column:
    out = F.lit(False)
    for key in HOLDS:
        out |= flag(details, key)
    return out


def fingerprint(details: Column, volatile: list[str] | None = None) -> Column:
    """Digest of JSON details in canonical form: keys sorted at every depth, white space and volatile keys out; null if they are no object."""
    entries = F.map_entries(F.try_parse_json(details).try_cast("map<string,variant>"))
    kept = F.filter(entries, lambda e: ~e["key"].isin(volatile or VOLATILE))
    lines = F.array_sort(F.transform(kept, lambda e: F.concat(e["key"], F.lit("\u0001"), F.coalesce(F.to_json(e["value"]), F.lit("null")))))
    return F.sha2(F.array_join(lines, "\u0002"), 256)


# --- inventories ---------------------------------------------------------------------------------------------


def page_inventory(items: DataFrame, *keys: str) -> DataFrame:
    """(keys, bucket, recognised, excluded): the items (item, recognised) seen under the keys, as bitmaps of 32,768 items.

    Bitmaps of runs, pages or tables are put together by ``merge_inventories``; none lists its items.  Null items are passed over.
    """
    rows = items.where("item is not null").withColumn("bucket", F.bitmap_bucket_number("item")).withColumn("bit", F.bitmap_bit_position("item"))
    of = lambda kind: F.bitmap_construct_agg(F.when(kind, F.col("bit")))
    return rows.groupBy(*keys, "bucket").agg(of(F.col("recognised")).alias("recognised"), of(~F.col("recognised")).alias("excluded"))


def merge_inventories(parts: DataFrame, *keys: str) -> DataFrame:
    return parts.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("recognised").alias("recognised"), F.bitmap_or_agg("excluded").alias("excluded"))


def inventory_counts(inventory: DataFrame, *keys: str) -> DataFrame:
    """(keys, recognised, excluded): how many different items."""
    return inventory.groupBy(*keys).agg(*(F.sum(F.bitmap_count(c)).alias(c) for c in ("recognised", "excluded")))


# --- runs ----------------------------------------------------------------------------------------------------


def run_log(runs: DataFrame) -> DataFrame:
    """(kind, started_at, finished_at, status, details): rows of the log; without a start a run began as it ended, and details have a bound."""
    return runs.select("kind", F.coalesce("started_at", "finished_at").alias("started_at"), "finished_at", "status", F.substring(F.coalesce("details", F.lit("")), 1, MOST_LOG).alias("details"))


def append_runs(runs: DataFrame, path: str) -> None:
    """Adds runs to the log; what is in it is never touched."""
    run_log(runs).write.mode("append").parquet(path)

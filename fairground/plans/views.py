"""The activity tables, bound to the given tables by fixed formulas, and the same as SQL.

Every reader takes (spark, sf_dir).  Times are kept without zone; queries take ``as_of`` as a parameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "1998-06-15 12:00:00"
STREAM_AS_OF = "2024-01-20 00:00:00"
EVENT_TYPES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
TOPICS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an activity: times, type, topics, place, fee and status."""
    orders, customers, nations = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    key = F.col("o_orderkey")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        key.alias("id"),
        F.concat(F.lit("Activity "), (key % 700).cast("string"), F.lit(" of "), F.col("c_name")).alias("title"),
        F.col("o_orderdate").alias("start_at"),
        F.when(key % 21 != 0, F.expr("o_orderdate + make_dt_interval(cast(o_orderkey % 21 as int))")).alias("end_at"),
        (key % 2 == 1).alias("all_day"),
        F.col("o_orderpriority").alias("event_type"),
        F.when(key % 11 == 0, "pending").otherwise("source").alias("event_type_state"),
        F.expr("case o_orderstatus when 'F' then 'cancelled' when 'P' then 'needs_review' else 'scheduled' end").alias("status"),
        F.col("n_name").alias("district"),
        F.col("c_name").alias("organizer"),
        F.expr("case when c_mktsegment in ('AUTOMOBILE', 'MACHINERY') then 'high' when c_mktsegment = 'BUILDING' then 'medium' else 'normal' end").alias("priority"),
        F.expr("case when o_custkey % 10 = 0 then 'high' when o_custkey % 10 < 8 then 'unknown' end").alias("commercial"),
        (F.col("o_totalprice") < 50000).alias("cost_free"),
        F.expr("array_distinct(if(o_orderkey % 3 = 0, array(c_mktsegment, 'BUILDING'), array(c_mktsegment)))").alias("topics"),
        F.expr("element_at(array('offline', 'online', 'hybrid', 'unknown'), cast(o_orderkey % 4 as int) + 1)").alias("attendance"),
        (key % 50).cast("int").alias("origin_priority"),
    )


ACTIVITY_SQL = """activity as (select o_orderkey as id, 'Activity ' || (o_orderkey % 700) || ' of ' || c_name as title, o_orderdate as start_at,
  case when o_orderkey % 21 <> 0 then o_orderdate + to_days(cast(o_orderkey % 21 as integer)) end as end_at, o_orderkey % 2 = 1 as all_day, o_orderpriority as event_type,
  case when o_orderkey % 11 = 0 then 'pending' else 'source' end as event_type_state,
  case o_orderstatus when 'F' then 'cancelled' when 'P' then 'needs_review' else 'scheduled' end as status, n_name as district, c_name as organizer,
  case when c_mktsegment in ('AUTOMOBILE', 'MACHINERY') then 'high' when c_mktsegment = 'BUILDING' then 'medium' else 'normal' end as priority,
  case when o_custkey % 10 = 0 then 'high' when o_custkey % 10 < 8 then 'unknown' end as commercial, o_totalprice < 50000 as cost_free,
  list_distinct(case when o_orderkey % 3 = 0 then [c_mktsegment, 'BUILDING'] else [c_mktsegment] end) as topics,
  ['offline', 'online', 'hybrid', 'unknown'][o_orderkey % 4 + 1] as attendance, cast(o_orderkey % 50 as integer) as origin_priority
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""


def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner state of an activity, folded from the log: about three log rows an activity."""
    kind, ts = F.col("event_type"), F.col("ts")
    signal = F.expr("case event_type when 'click' then 'interested' when 'signup' then 'attended' end")
    return table(spark, sf_dir, "events").groupBy((F.col("event_id") % 3000).alias("event_id")).agg(
        (F.count_if(kind == "purchase") > 0).alias("favorite"),
        (F.count_if(kind == "error") >= 2).alias("hidden"),
        F.max(F.when(kind == "view", ts)).alias("viewed_at"),
        F.max_by(signal, F.when(signal.isNotNull(), F.struct(ts, "event_id"))).alias("feedback"),
        F.max(F.when(signal.isNotNull(), ts)).alias("feedback_updated_at"),
        F.count("*").alias("revision"),
    )


PREFERENCES_SQL = """preferences as (select event_id % 3000 as event_id, count(*) filter (event_type = 'purchase') > 0 as favorite, count(*) filter (event_type = 'error') >= 2 as hidden,
  max(ts) filter (event_type = 'view') as viewed_at,
  max_by(case event_type when 'click' then 'interested' else 'attended' end, (ts, e.event_id)) filter (event_type in ('click', 'signup')) as feedback,
  max(ts) filter (event_type in ('click', 'signup')) as feedback_updated_at, count(*) as revision from events e group by event_id % 3000)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cancellation notices (errors) and reinstatements (purchases) about activities."""
    return table(spark, sf_dir, "events").where("event_type in ('error', 'purchase')").select(
        F.col("event_id").alias("observation_id"),
        (F.col("user_id") % 20).alias("source_id"),
        (F.col("event_id") % 300).alias("event_id"),
        F.when(F.col("value") < 10, "time").otherwise("place").alias("reason"),
        "ts",
        (F.col("event_type") == "purchase").alias("resolves"),
    )


OBSERVATIONS_SQL = """observations as (select event_id as observation_id, user_id % 20 as source_id, event_id % 300 as event_id, case when value < 10 then 'time' else 'place' end as reason,
  ts, event_type = 'purchase' as resolves from events where event_type in ('error', 'purchase'))"""


def source_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sources report an activity, in order."""
    lines, suppliers = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    return lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("source_id"), F.col("l_linenumber").alias("seq"), F.col("s_name").alias("source"), (F.col("s_suppkey") % 50).alias("priority"), F.col("l_shipdate").alias("seen_at")
    )


SOURCE_LINKS_SQL = """source_links as (select l_orderkey as event_id, l_suppkey as source_id, l_linenumber as seq, s_name as source, s_suppkey % 50 as priority, l_shipdate as seen_at
  from lineitem join supplier on l_suppkey = s_suppkey)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of a source: a user's day in the log, with visible items and failures."""
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 40).alias("source_id"), F.to_date("ts").alias("day")).agg(
        F.count("*").alias("visible"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("event_type") == "view").alias("checked"), F.sum("value").alias("tokens")
    )


RUNS_SQL = """runs as (select user_id % 40 as source_id, cast(ts as date) as day, count(*) as visible, count(*) filter (event_type = 'error') as failed,
  count(*) filter (event_type = 'view') as checked, sum(value) as tokens from events group by 1, 2)"""

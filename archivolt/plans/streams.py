"""Streaming queries with batch SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt import streaming as Z
from archivolt.session import scratch_dir
from archivolt.sources.tables import table


def _arriving(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, str]:
    folder = scratch_dir(spark)
    return Z.arriving(table(spark, sf_dir, name), "ts", folder), folder


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each search of the log once, whatever is delivered again within an hour."""
    log, folder = _arriving(spark, sf_dir, "query_log")
    log = Z.event_time(log, "ts", "1 hour")
    once = log.where("query is not null").dropDuplicatesWithinWatermark(["ts", "query"]).select("ts", "query")
    return Z.drain(once, folder)


def stream_daily_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches without a good hit, by day."""
    log, folder = _arriving(spark, sf_dir, "query_log")
    bad = Z.event_time(log, "ts", "2 days").where("trim(query) <> '' and (n = 0 or top_score < 0.012)")
    days = bad.groupBy(F.window("at", "1 day")).agg(F.count(F.lit(1)).alias("gaps"))
    days = days.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "gaps")
    return Z.drain_updates(days, folder, ["day"])


def stream_sliding_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each query came back without a good hit in the 30 days up to each tenth day."""
    log, folder = _arriving(spark, sf_dir, "query_log")
    bad = Z.event_time(log, "ts", "1 day").where("trim(query) <> '' and (n = 0 or top_score < 0.012)")
    found = bad.groupBy(F.window("at", "30 days", "10 days"), F.trim("query").alias("query")).agg(F.count(F.lit(1)).alias("asked"), F.round(F.max("top_score"), 6).alias("best"))
    found = found.select(F.date_format("window.start", "yyyy-MM-dd").alias("from_day"), "query", "asked", "best")
    return Z.drain_updates(found, folder, ["from_day", "query"])


def stream_search_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gets within five minutes after a search of the same user: two streams joined over an interval, state for ten minutes."""
    events, folder = _arriving(spark, sf_dir, "events")
    views = Z.event_time(events.where("event_type = 'view'").select(F.col("event_id").alias("search_id"), "user_id", "ts"), "ts", "10 minutes", "searched").drop("ts")
    gets = Z.event_time(events.where("event_type = 'click'").select(F.col("event_id").alias("get_id"), F.col("user_id").alias("getter"), "ts"), "ts", "10 minutes", "got").drop("ts")
    near = views.join(gets, F.expr("user_id = getter and got >= searched and got <= searched + interval 300 seconds"))
    near = near.select("search_id", "get_id", F.rint((F.unix_micros("got") - F.unix_micros("searched")) / 1e6).cast("bigint").alias("seconds"))
    return Z.drain(near, folder)


def stream_each_user_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user and type over a sliding week, kept as state for one day more."""
    events, folder = _arriving(spark, sf_dir, "events")
    week = Z.event_time(events, "ts", "1 day").groupBy(F.window("at", "7 days", "1 day"), "user_id", "event_type")
    week = week.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    week = week.select(F.date_format("window.start", "yyyy-MM-dd").alias("from_day"), "user_id", "event_type", "n", "total")
    return Z.drain_updates(week, folder, ["from_day", "user_id", "event_type"])


def stream_type_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type over a sliding week, all users together."""
    events, folder = _arriving(spark, sf_dir, "events")
    week = Z.event_time(events, "ts", "1 day").groupBy(F.window("at", "7 days", "1 day"), "event_type")
    week = week.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    week = week.select(F.date_format("window.start", "yyyy-MM-dd").alias("from_day"), "event_type", "n", "total")
    return Z.drain_updates(week, folder, ["from_day", "event_type"])


def stream_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last search and the number of searches of each hit, updated batch by batch."""
    log, folder = _arriving(spark, sf_dir, "query_log")
    hit = log.where("nullif(trim(top_id), '') is not null").select(F.lower(F.trim("top_id")).alias("id"), "ts")
    seen = hit.groupBy("id").agg(F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("times"))
    return Z.drain_updates(seen, folder, ["id"])


QUERIES = {f.__name__: f for f in (stream_dedup, stream_daily_gaps, stream_sliding_gaps, stream_search_get, stream_each_user_totals, stream_type_totals, stream_last_seen)}
QUERIES["stream_user_totals"] = stream_each_user_totals
_WEEK = """SELECT strftime(d, '%Y-%m-%d') AS from_day, {0} event_type, count(*) AS n, round(sum(value), 4) AS total FROM (
  SELECT user_id, event_type, value, unnest(generate_series(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS d FROM events) GROUP BY ALL"""
SQL = {
    "stream_dedup": "SELECT DISTINCT ts, query FROM query_log WHERE query IS NOT NULL AND try_cast(ts AS TIMESTAMP) IS NOT NULL",
    "stream_daily_gaps": """SELECT strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d') AS day, count(*) AS gaps FROM query_log
WHERE trim(query) <> '' AND (n = 0 OR top_score < 0.012) GROUP BY 1""",
    "stream_sliding_gaps": """SELECT strftime(DATE '1970-01-01' + CAST(w * 10 AS INT), '%Y-%m-%d') AS from_day, query, count(*) AS asked, round(max(top_score), 6) AS best FROM (
  SELECT trim(query) AS query, top_score, unnest(range(d // 10 - 2, d // 10 + 1)) AS w FROM (SELECT *, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS TIMESTAMP)) AS BIGINT) AS d FROM query_log)
  WHERE trim(query) <> '' AND (n = 0 OR top_score < 0.012)) GROUP BY 1, 2""",
    "stream_search_get": """SELECT v.event_id AS search_id, c.event_id AS get_id, CAST(epoch(c.ts) - epoch(v.ts) AS BIGINT) AS seconds FROM events v JOIN events c
ON v.user_id = c.user_id AND v.event_type = 'view' AND c.event_type = 'click' AND c.ts >= v.ts AND c.ts <= v.ts + INTERVAL 300 SECOND""",
    "stream_user_totals": _WEEK.format("user_id,"),
    "stream_each_user_totals": _WEEK.format("user_id,"),
    "stream_type_totals": _WEEK.format(""),
    "stream_last_seen": """SELECT lower(trim(top_id)) AS id, max(ts) AS last_ts, count(*) AS times FROM query_log WHERE nullif(trim(top_id), '') IS NOT NULL
AND try_cast(ts AS TIMESTAMP) IS NOT NULL GROUP BY 1""",
}

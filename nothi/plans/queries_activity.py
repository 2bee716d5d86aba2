"""Queries over event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from nothi.plans.registry import query, table
from nothi.sources import scratch
from nothi.streaming import activity


@query("""WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 3600 SECOND THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM o)
  SELECT user_id, count(*) AS events, min(ts) AS begin, max(ts) AS "end" FROM s GROUP BY user_id, n""")
def session_activity(spark, sf_dir):
    """Stays that end when a user is idle for over an hour."""
    return activity.sessions(table(spark, sf_dir, "events"), "3600 seconds").select("user_id", "events", "begin", "end")


@query("""WITH w AS (SELECT user_id, unnest(range(0, 4)) AS i, ts FROM events), e AS (SELECT user_id, make_timestamp(CAST((floor(epoch(ts) / 600) * 600 + (i + 1) * 600) * 1000000 AS BIGINT)) AS "at" FROM w WHERE i < 3) SELECT "at", count(DISTINCT user_id) AS users FROM e GROUP BY 1""")
def online_users(spark, sf_dir):
    """Users seen in the half hour before every ten minutes."""
    return activity.online_users(table(spark, sf_dir, "events"), "10 minutes", "30 minutes")


@query("SELECT user_id, max(ts) AS seen FROM events GROUP BY user_id")
def heartbeats(spark, sf_dir):
    """R2."""
    return activity.heartbeats(table(spark, sf_dir, "events"))


@query("""SELECT user_id, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS begin, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') + INTERVAL 1 DAY AS "end", count(*) AS requests FROM events GROUP BY ALL HAVING count(*) > 2""")
def rate_limit_windows(spark, sf_dir):
    """More than two requests a day."""
    return activity.rate_limited(table(spark, sf_dir, "events"), "user_id", "1 day", 2)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def log_stream(spark, sf_dir):
    """A stream of events appended to a log table, then read."""
    events = table(spark, sf_dir, "events")
    source, path = scratch.path(spark, "events"), scratch.path(spark, "log")
    events.write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    activity.append_log(stream, path, scratch.path(spark, "state"), every=None).awaitTermination()
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))

"""Streaming queries over ``events``, run over what is available now."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lathe.operators import rows
from lathe.plans.adapters import table
from lathe.plans.registry import query
from lathe.streaming import queues


def folder(spark) -> str:
    return f"{rows.shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def events(spark, sf_dir):
    return queues.read_events(spark, sf_dir, "events.parquet", table(spark, sf_dir, "events").schema)


LATE = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@query("stream_tumbling_windows", f'SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2, 3 HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= {LATE}')
def tumbling(spark, sf_dir):
    s = queues.windowed(events(spark, sf_dir), "ts", "10 minutes", "1 hour", None, ["event_type"], {"n": F.count(F.lit(1)), "v": F.sum("value")})
    out = queues.run_to_table(s, folder(spark))
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz"), "v": F.round("v", 4)})


@query("stream_sliding_windows", f'WITH s AS (SELECT ts, value, unnest([time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE, time_bucket(INTERVAL 30 MINUTE, ts)]) AS start FROM events) SELECT start, start + INTERVAL 1 HOUR AS "end", count(*) AS n FROM s GROUP BY start HAVING start + INTERVAL 1 HOUR <= {LATE}')
def sliding(spark, sf_dir):
    s = queues.windowed(events(spark, sf_dir), "ts", "10 minutes", "1 hour", "30 minutes", [], {"n": F.count(F.lit(1))})
    out = queues.run_to_table(s, folder(spark))
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query(
    "stream_session_windows",
    f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM r GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= {LATE}""",
)
def session(spark, sf_dir):
    s = queues.sessions(events(spark, sf_dir), "ts", "10 minutes", "30 minutes", "user_id", {"n": F.count(F.lit(1))})
    out = queues.run_to_table(s, folder(spark))
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query("stream_bounded_queue", "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT user_id, count(*) AS produced, greatest(count(*) - 8, 0) AS dropped, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY r DESC) FILTER (r <= 8) AS held FROM r GROUP BY user_id")
def bounded_queue(spark, sf_dir):
    out = queues.run_to_table(queues.bounded_queue(events(spark, sf_dir), "user_id", "ts", "event_id", 8), folder(spark))
    return out.select("user_id", "produced", "dropped", F.array_join(F.transform("held", lambda x: x.cast("string")), ",").alias("held"))


@query("batch_drop_oldest", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 8")
def drop_oldest(spark, sf_dir):
    from lathe.operators.rows import last_n

    return last_n(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 8).select("user_id", "event_id")


@query("count_windows", 'SELECT "window", count(*) AS n, max(value) - min(value) AS spread FROM (SELECT CAST(floor((row_number() OVER (ORDER BY ts, event_id) - 1) / 96) AS BIGINT) AS "window", value FROM events) WHERE "window" < (SELECT count(*) // 96 FROM events) GROUP BY "window"')
def count_windows(spark, sf_dir):
    w = queues.count_windows(table(spark, sf_dir, "events"), ["ts", "event_id"], 96)
    return w.groupBy("window").agg(F.count(F.lit(1)).alias("n"), (F.max("value") - F.min("value")).alias("spread"))


@query("staleness_filter", "SELECT event_id FROM events WHERE (SELECT max(event_id) // 100 FROM events) - event_id // 100 <= 3")
def staleness_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("version", F.floor(F.col("event_id") / 100))
    now = e.agg(F.max("version").alias("current"))
    return queues.fresh(e.join(F.broadcast(now)), "version", F.col("current"), 3).select("event_id")

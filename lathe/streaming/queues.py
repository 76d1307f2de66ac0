"""Streams: bounded queues that drop the oldest, count windows, staleness budgets, event-time windows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window


def read_events(spark: SparkSession, folder: str, name: str, schema: T.StructType, files_per_batch: int = 64) -> DataFrame:
    """A stream over the Parquet file or folder ``name`` inside ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", name).parquet(folder)


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run over what is available now and read the result; output and checkpoints live in the given (shared) folder."""
    spark, out = stream.sparkSession, f"{folder}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def bounded_queue(stream: DataFrame, key: str, order: str, payload: str, capacity: int) -> DataFrame:
    """Per key and micro-batch: ``produced``, ``dropped`` so far, and the ``held`` payloads, oldest first.

    When the queue is full the oldest goes. State holds at most ``capacity`` payloads a key.
    """
    kinds = {f.name: f.dataType for f in stream.schema}
    out = T.StructType([T.StructField(key, kinds[key]), T.StructField("produced", T.LongType()), T.StructField("dropped", T.LongType()), T.StructField("held", T.ArrayType(kinds[payload]))])
    state = T.StructType([T.StructField("produced", T.LongType()), T.StructField("dropped", T.LongType()), T.StructField("held", T.ArrayType(kinds[payload]))])

    def put(k, batches, state: GroupState):
        produced, dropped, held = state.get if state.exists else (0, 0, [])
        rows = pd.concat(list(batches)).sort_values([order, payload])
        held = [*held, *rows[payload].tolist()]
        produced += len(rows)
        dropped += max(0, len(held) - capacity)
        held = held[-capacity:]
        state.update((produced, dropped, held))
        yield pd.DataFrame({key: [k[0]], "produced": [produced], "dropped": [dropped], "held": [held]})

    return stream.groupBy(key).applyInPandasWithState(put, out, state, "append", GroupStateTimeout.NoTimeout)


def windowed(stream: DataFrame, ts: str, delay: str, width: str, slide: str | None, by: list[str], aggregates: dict[str, Column]) -> DataFrame:
    """Tumbling or sliding event-time windows under a watermark: ``start, end``, the keys and the named aggregates."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    grouped = timed.groupBy(F.window(ts, width, slide).alias("w"), *by).agg(*(c.alias(n) for n, c in aggregates.items()))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, *aggregates)


def sessions(stream: DataFrame, ts: str, delay: str, gap: str, by: str, aggregates: dict[str, Column]) -> DataFrame:
    """Session windows of each key under a watermark."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    grouped = timed.groupBy(by, F.session_window(ts, gap).alias("w")).agg(*(c.alias(n) for n, c in aggregates.items()))
    return grouped.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *aggregates)


def staleness_budget(required: int, threshold: float, sync_steps: int) -> int:
    """Samples that may be produced between two weight syncs; the queue's bound is the same."""
    return int(required * (threshold + 1) * sync_steps)


def should_pause(queued: Column, capacity: int, stale: Column, budget: int) -> Column:
    return (queued >= capacity) | (stale >= budget)


def fresh(df: DataFrame, version: str, current: Column, most_lag: int) -> DataFrame:
    """Rows at most ``most_lag`` parameter versions behind."""
    return df.where((current - F.col(version)) <= most_lag)


def count_windows(df: DataFrame, order: list, size: int) -> DataFrame:
    """Tumbling windows of ``size`` rows in order; the short tail goes."""
    from lathe.operators.rows import chunks

    return chunks(df, order, size, drop_tail=True).withColumnRenamed("chunk", "window")


def for_each(stream: DataFrame, folder: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Assemble each micro-batch with ``handle`` over what is available now."""
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{folder}/checkpoint-{uuid.uuid4().hex}").trigger(availableNow=True).start().awaitTermination()


def rate_limited(df: DataFrame, by: list[str], order: list, arrival: str, cost: Column, rate: float, capacity: float) -> DataFrame:
    """Adds ``start``: when a token bucket lets each request of a key begin, in its order.

    The bucket refills at ``rate`` a second up to ``capacity`` and a request takes
    ``cost`` (at most ``capacity``). The time at which the bucket would be full again
    grows by ``cost / rate`` from the later of itself and the arrival, so it is a running maximum
    of arrivals less the work before them, plus the work so far: two windows, no loop.
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    worked = df.withColumn("_c", cost / rate).withColumn("_s", F.sum("_c").over(w))
    full = worked.withColumn("_full", F.col("_s") + F.max(F.col(arrival) - (F.col("_s") - F.col("_c"))).over(w))
    return full.withColumn("start", F.greatest(F.col(arrival), F.col("_full") - F.lit(capacity / rate))).drop("_c", "_s", "_full")


# States of a partial rollout, and what leads from one to the next.
ROLLOUT = {
    ("PENDING", "start"): "GENERATING",
    ("GENERATING", "tool_call"): "PROCESSING_TOOLS",
    ("GENERATING", "interaction"): "INTERACTING",
    ("GENERATING", "stop"): "TERMINATED",
    ("PROCESSING_TOOLS", "tool_result"): "GENERATING",
    ("PROCESSING_TOOLS", "stop"): "TERMINATED",
    ("INTERACTING", "reply"): "GENERATING",
    ("INTERACTING", "stop"): "TERMINATED",
}


def states(events: Column, transitions: dict[tuple[str, str], str] = ROLLOUT, start: str = "PENDING") -> Column:
    """The state after each event of an array; an event that leads nowhere from a state leaves it, so a paused rollout resumes where it was."""
    table = F.create_map(*(F.lit(x) for (s, e), to in transitions.items() for x in (f"{s}/{e}", to)))
    first = F.struct(F.lit(start).alias("state"), F.array().cast("array<string>").alias("out"))

    def move(acc, e):
        to = F.coalesce(F.try_element_at(table, F.concat(acc["state"], F.lit("/"), e)), acc["state"])
        return F.struct(to.alias("state"), F.array_append(acc["out"], to).alias("out"))

    return F.aggregate(events, first, move, lambda acc: acc["out"])

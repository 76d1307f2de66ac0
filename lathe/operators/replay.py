"""Replay pools: per-task rings of positive and negative rows, quota arithmetic, round-robin draws."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lathe.functions.text import hash_rank
from lathe.operators.rows import last_n


def ring(df: DataFrame, keys: list[str], arrival: list, capacity: int) -> DataFrame:
    """What rings of ``capacity`` hold after all arrivals: the newest rows of each key."""
    return last_n(df, keys, arrival, capacity)


def quotas(positives: int, negatives: int, size: int, ratio: float) -> tuple[int, int]:
    """Rows to take of either sign: the asked share, what one side lacks made up by the other, the larger rest first."""
    want = round(size * min(1.0, max(0.0, ratio)))
    p, n = min(want, positives), min(size - want, negatives)
    missing = size - p - n
    more = min(missing, positives - p) if positives - p >= negatives - n else max(0, missing - min(missing, negatives - n))
    more = min(more, positives - p)
    return p + more, n + min(missing - more, negatives - n)


def round_robin(df: DataFrame, task: str, key: str, take: int, seed: int) -> DataFrame:
    """``take`` rows dealt to tasks in turn, each task's drawn by hash without replacement."""
    inner = Window.partitionBy(task).orderBy(hash_rank(seed, F.col(key)), key)
    ranked = df.withColumn("_turn", F.row_number().over(inner)).where(F.col("_turn") <= take)
    return ranked.orderBy("_turn", task).limit(take).drop("_turn")


def sample(df: DataFrame, task: str, key: str, positive: str, size: int, ratio: float, seed: int) -> DataFrame:
    """A batch of ``size`` rows (fewer if there are fewer) from the positive and the negative pool."""
    counts = df.agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n")).first()
    if not counts.p + counts.n:
        raise ValueError("the pool is empty")
    p, n = quotas(counts.p, counts.n, size, ratio)
    return round_robin(df.where(positive), task, key, p, seed).unionByName(round_robin(df.where(~F.col(positive)), task, key, n, seed))

"""Evaluation that follows an order or a seed: bootstrap, leader classes, subset draws, audits of token arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.functions.masked import longest_run


def bootstrap(df: DataFrame, keys: list[str], value: str, order: str, k: int, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """Per key: mean and std of best and worst of ``k`` draws with replacement, over seeded rounds; one prompt's samples are one row.

    The draws of a round depend on the number of samples alone, so prompts of one
    size share them and are evaluated together.
    """
    per = df.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, F.col(value).cast("double").alias("v")))), lambda x: x["v"]).alias("_v"))
    names = ["best_mean", "best_std", "worst_mean", "worst_std"]

    def run(batches):
        draws: dict[int, np.ndarray] = {}
        for batch in batches:
            values = batch.column("_v")
            sizes = np.asarray(values.value_lengths())
            flat, starts = values.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
            out = np.zeros((4, batch.num_rows))
            for n in np.unique(sizes).tolist():
                if n not in draws:
                    draws[n] = np.random.RandomState(seed).choice(n, size=(rounds, k), replace=True)
                at = np.flatnonzero(sizes == n)
                for i in range(0, len(at), 512):
                    some = at[i : i + 512]
                    v = flat[starts[some][:, None] + np.arange(n)][:, draws[n]]
                    best, worst = v.max(axis=2), v.min(axis=2)
                    out[:, some] = best.mean(axis=1), best.std(axis=1), worst.mean(axis=1), worst.std(axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in keys), *(pa.array(x) for x in out)], names=[*keys, *names])

    return per.mapInArrow(run, T.StructType([*(per.schema[x] for x in keys), *(T.StructField(x, T.DoubleType()) for x in names)]))


def leader_classes(df: DataFrame, uid: str, order: str, pred: str, correct: str, same=None) -> DataFrame:
    """Adds ``answer_class``: the first prediction of the same correctness that the row's is equivalent to, in sample order.

    ``same(a, b)`` must hold both ways; blank predictions abstain. By default, trimmed strings without spaces and of one case are equivalent.
    """
    test = same or (lambda a, b: a.replace(" ", "").lower() == b.replace(" ", "").lower())
    schema = T.StructType([*df.schema.fields, T.StructField("answer_class", T.StringType())])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        leaders: list[tuple[str, bool]] = []
        out = []
        for p, ok in zip(rows[pred], rows[correct], strict=True):
            p = "" if p is None else str(p).strip()
            if not p:
                out.append(None)
                continue
            found = next((x for x, right in leaders if right == bool(ok) and test(p, x) and test(x, p)), None)
            if found is None:
                leaders.append((p, bool(ok)))
            out.append(found or p)
        return rows.assign(answer_class=out)

    return df.groupBy(uid).applyInPandas(run, schema)


def subset(df: DataFrame, uid: str, order: str, k: int, strategy: str, seed: int = 0) -> DataFrame:
    """``k`` samples of each prompt: the first ones (prefix), all if there are exactly ``k`` (full_only), or drawn by hash (monte_carlo)."""
    from lathe.functions.text import hash_rank
    from lathe.operators.rows import last_n

    if strategy == "prefix":
        return last_n(df, [uid], [order], k)
    if strategy == "full_only":
        full = df.groupBy(uid).count().where(F.col("count") == k).select(uid)
        return df.join(full, uid, "left_semi")
    if strategy == "monte_carlo":
        return last_n(df, [uid], [hash_rank(seed, F.concat_ws("\x00", F.col(uid).cast("string"), F.lit(str(k)), F.col(order).cast("string")))], k)
    raise ValueError(f"unknown strategy {strategy!r}")


def topk_entropy(logprobs: Column) -> Column:
    """Entropy of top-k probabilities plus the rest as one outcome."""
    p = F.transform(logprobs, lambda v: F.exp(v.cast("double")))
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    rest = F.least(F.greatest(F.lit(1.0) - total, F.lit(0.0)), F.lit(1.0))
    part = lambda x: F.when(x > 0, -x * F.ln(x)).otherwise(0.0)
    return F.aggregate(F.transform(p, part), F.lit(0.0), lambda a, x: a + x) + part(rest)


def predictive_entropy(df: DataFrame, uid: str, entropies: str, mask: str) -> DataFrame:
    """Sequence, question and token means of token entropies under the mask."""
    kept = F.filter(entropies, lambda v, i: F.get(F.col(mask), i) > 0)
    s = df.select(uid, F.aggregate(kept, F.lit(0.0), lambda a, v: a + v).alias("s"), F.size(kept).alias("n")).where("n > 0").withColumn("m", F.col("s") / F.col("n"))
    q = s.groupBy(uid).agg(F.avg("m").alias("q"), F.sum("m").alias("sm"), F.count(F.lit(1)).alias("c"), F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    return q.agg((F.sum("sm") / F.sum("c")).alias("sequence_mean"), F.avg("q").alias("question_mean"), (F.sum("ts") / F.sum("tn")).alias("token_mean"))


def support_overlap(a: Column, b: Column) -> Column:
    """Share of the smaller top-k list that both hold."""
    return F.size(F.array_intersect(a, b)) / F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))


def array_audit(df: DataFrame, key: str, values: str, edges: list[float]) -> DataFrame:
    """Per key: mean, share of zeros, longest zero run, and counts between fixed edges (below the first, ..., from the last on)."""
    v = F.transform(values, lambda x: x.cast("double"))
    n = F.size(v)
    cuts = [float("-inf"), *edges, float("inf")]
    counts = [F.size(F.filter(v, between(lo, hi))).alias(f"bin{i}") for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return df.select(key, (F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n).alias("mean"), (F.size(F.filter(v, lambda x: x == 0)) / n).alias("zeros"), longest_run(v).alias("zero_run"), *counts)


def between(low: float, high: float):
    return lambda x: (x >= F.lit(low)) & (x < F.lit(high))

"""Statistics of prompt groups and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lathe.operators.rows import numbered


def group_stats(df: DataFrame, uid: str = "uid", score: str = "score", floor: float | None = None) -> DataFrame:
    """Adds ``g_n``, ``g_mean``, ``g_std``: a single sample has mean 0 and std 1; the variance is held above ``floor``."""
    w = Window.partitionBy(uid)
    n = F.count(F.lit(1)).over(w)
    var = F.var_samp(score).over(w)
    std = F.sqrt(var if floor is None else F.greatest(var, F.lit(floor)))
    return df.withColumns({"g_n": n, "g_mean": F.when(n > 1, F.avg(score).over(w)).otherwise(0.0), "g_std": F.when(n > 1, std).otherwise(1.0)})


def keep_informative(df: DataFrame, uid: str = "uid", metric: str = "score") -> DataFrame:
    """Rows of groups whose metric varies (population std above 0) or that hold one sample."""
    w = Window.partitionBy(uid)
    return df.withColumns({"_s": F.stddev_pop(metric).over(w), "_n": F.count(F.lit(1)).over(w)}).where("_s > 0 or _n = 1").drop("_s", "_n")


def group_number(df: DataFrame, label: str, name: str = "group") -> DataFrame:
    """Adds dense numbers from 0 by label: positions of the distinct labels, found without one task seeing them all."""
    return df.join(numbered(df.select(label).distinct(), [label], name), label)


def majority(df: DataFrame, keys: list[str], vote: str, value: str, order: list[str]) -> DataFrame:
    """Per key: the most frequent vote, the first seen of equal ones, and the value of its first row."""
    first = F.struct(*order)
    votes = df.groupBy(*keys, vote).agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("at"), F.min_by(value, first).alias("v"))
    most = votes.groupBy(*keys).agg(F.max("n").alias("n"))
    return votes.join(most, [*keys, "n"]).groupBy(*keys).agg(F.min_by(vote, "at").alias("majority"), F.min_by("v", "at").alias("value"), F.max("n").alias("votes"))


def strict_plurality(df: DataFrame, keys: list[str], vote: str, correct: str) -> DataFrame:
    """Per key: 1 where one class alone has most votes and is correct; ties and abstentions only score 0, abstentions count as samples."""
    votes = df.groupBy(*keys, vote).agg(F.count(F.lit(1)).alias("n"), F.max(correct).alias("ok"))
    best = votes.where(F.col(vote).isNotNull()).groupBy(*keys).agg(F.max("n").alias("n"))
    top = votes.where(F.col(vote).isNotNull()).join(best, [*keys, "n"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("ties"), F.max("ok").alias("ok"))
    return df.select(*keys).distinct().join(top, keys, "left").select(*keys, F.when((F.col("ties") == 1) & (F.col("ok") > 0), 1.0).otherwise(0.0).alias("score"))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Unbiased pass@k: 1 - C(n-c, k) / C(n, k)."""
    product = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda a, i: a * (F.lit(1.0) - F.lit(float(k)) / i))
    return F.when(n - c < k, F.lit(1.0)).when(c == 0, F.lit(0.0)).otherwise(F.lit(1.0) - product)


def best_at_k_expected(values: Column, k: int) -> Column:
    """Expected maximum of ``k`` draws with replacement from an array of values."""
    s, n = F.sort_array(values), F.size(values)
    return F.aggregate(F.transform(s, lambda v, i: v * (F.pow((i + 1) / n, F.lit(k)) - F.pow(i / n, F.lit(k)))), F.lit(0.0), lambda a, v: a + v)


def entropy(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key: Shannon entropy in nats of the non-null values; 0 without any."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    sums = counts.groupBy(*keys).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.ln("n")).alias("s"))
    return df.select(*keys).distinct().join(sums, keys, "left").select(*keys, F.coalesce(F.ln("t") - F.col("s") / F.col("t"), F.lit(0.0)).alias("entropy"))

"""Advantage estimators: one row a trajectory, groups are prompts (``uid``).

Outcome estimators read ``score`` and add ``advantage``, which holds for every
token under the mask. Token estimators read arrays and add arrays. Singletons
and small constants differ between estimators on purpose.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lathe.functions import masked
from lathe.operators.groups import group_stats

EPS = 1e-6
ESTIMATORS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str):
    """Add an estimator under a name; another function under a taken name is an error."""

    def put(fn):
        if ESTIMATORS.get(name, fn) is not fn:
            raise ValueError(f"estimator {name!r} is registered already")
        ESTIMATORS[name] = fn
        return fn

    return put


def estimate(df: DataFrame, name: str, **options) -> DataFrame:
    if name not in ESTIMATORS:
        raise ValueError(f"unknown estimator {name!r}; known: {sorted(ESTIMATORS)}")
    return ESTIMATORS[name](df, **options)


def with_totals(df: DataFrame, **aggregates) -> DataFrame:
    """Adds whole-table aggregates to every row by broadcasting their one row."""
    totals = df.agg(*(c.alias(k) for k, c in aggregates.items())).withColumn("_one", F.lit(1))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(totals), "_one").drop("_one")


def whiten_outcome(df: DataFrame, value: str, tokens: str = "n_tokens") -> DataFrame:
    """``value`` whitened over all tokens, each row counting ``tokens`` times: unbiased variance, 1e-8 under both roots."""
    out = with_totals(df, _n=F.sum(tokens), _s=F.sum(F.col(value) * F.col(tokens)))
    out = out.withColumn("_m", F.col("_s") / (F.col("_n") + 1e-8))
    out = with_totals(out, _q=F.sum((F.col(value) - F.col("_m")) ** 2 * F.col(tokens)))
    var = F.col("_q") / (F.col("_n") + 1e-8) * F.col("_n") / (F.col("_n") - 1)
    return out.withColumn(value, (F.col(value) - F.col("_m")) / F.sqrt(var + 1e-8)).drop("_n", "_s", "_m", "_q")


def whiten_tokens(df: DataFrame, value: str, mask: str = "mask") -> DataFrame:
    """An array column whitened over all tokens under the mask."""
    kept = masked.pick(F.col(value), F.col(mask))
    out = with_totals(df, _n=F.sum(F.size(kept)), _s=F.sum(masked.total(kept)))
    out = out.withColumn("_m", F.col("_s") / (F.col("_n") + 1e-8))
    out = with_totals(out, _q=F.sum(masked.total(F.transform(kept, lambda x: (x - F.col("_m")) ** 2))))
    var = F.col("_q") / (F.col("_n") + 1e-8) * F.col("_n") / (F.col("_n") - 1)
    return out.withColumn(value, F.transform(value, lambda x: (x - F.col("_m")) / F.sqrt(var + 1e-8))).drop("_n", "_s", "_m", "_q")


@register("grpo")
def grpo(df: DataFrame, norm_by_std: bool = True, score: str = "score") -> DataFrame:
    """(score - mean) / (std + eps); a single sample keeps score / (1 + eps)."""
    g = group_stats(df, score=score)
    adv = F.col(score) - F.col("g_mean")
    return g.withColumn("advantage", adv / (F.col("g_std") + EPS) if norm_by_std else adv).drop("g_n", "g_mean", "g_std")


@register("grpo_vectorized")
def grpo_vectorized(df: DataFrame, norm_by_std: bool = True, score: str = "score") -> DataFrame:
    """As grpo, with the variance held above eps."""
    g = group_stats(df, score=score, floor=EPS)
    adv = F.col(score) - F.col("g_mean")
    return g.withColumn("advantage", adv / (F.col("g_std") + EPS) if norm_by_std else adv).drop("g_n", "g_mean", "g_std")


@register("gdpo")
def gdpo(df: DataFrame, keys: list[str], weights: list[float] | None = None) -> DataFrame:
    """Weighted sum of each reward key's grpo advantage, whitened over the batch's tokens."""
    out, total = df, F.lit(0.0)
    for i, key in enumerate(keys):
        out = grpo(out, score=key).withColumnRenamed("advantage", f"_a{i}")
        total = total + F.col(f"_a{i}") * float(weights[i] if weights else 1.0)
    return whiten_outcome(out.withColumn("advantage", total).drop(*(f"_a{i}" for i in range(len(keys)))), "advantage")


@register("grpo_passk")
def grpo_passk(df: DataFrame, norm_by_std: bool = True) -> DataFrame:
    """The best sample gets its lead over the second best, others 0; the first of equal ones counts as best."""
    w = Window.partitionBy("uid")
    ordered = w.orderBy(F.desc("score"), "sample_index")
    g = df.withColumns({"_r": F.row_number().over(ordered), "_next": F.lead("score").over(ordered), "_std": F.stddev_samp("score").over(w), "_n": F.count(F.lit(1)).over(w)})
    lead = F.col("score") - F.col("_next")
    best = lead / (F.col("_std") + EPS) if norm_by_std else lead
    adv = F.when(F.col("_n") < 2, F.raise_error(F.lit("a group needs two samples at least"))).when(F.col("_r") == 1, best).otherwise(0.0)
    return g.withColumn("advantage", adv).drop("_r", "_next", "_std", "_n")


@register("reinforce_plus_plus_baseline")
def reinforce_plus_plus_baseline(df: DataFrame) -> DataFrame:
    g = group_stats(df).withColumn("advantage", F.col("score") - F.col("g_mean")).drop("g_n", "g_mean", "g_std")
    return whiten_outcome(g, "advantage")


@register("rloo")
def rloo(df: DataFrame) -> DataFrame:
    """n / (n - 1) (score - mean); a single sample keeps its score."""
    g, n = group_stats(df), F.col("g_n")
    return g.withColumn("advantage", F.when(n > 1, (F.col("score") - F.col("g_mean")) * n / (n - 1)).otherwise(F.col("score"))).drop("g_n", "g_mean", "g_std")


@register("rloo_vectorized")
def rloo_vectorized(df: DataFrame) -> DataFrame:
    """As rloo; a single sample gets 0."""
    g, n = group_stats(df), F.col("g_n")
    return g.withColumn("advantage", F.when(n > 1, (F.col("score") - F.col("g_mean")) * n / (n - 1)).otherwise(0.0)).drop("g_n", "g_mean", "g_std")


@register("opo")
def opo(df: DataFrame) -> DataFrame:
    """score minus the length-weighted mean score of the group; a single sample keeps its score."""
    w = Window.partitionBy("uid")
    base = F.sum(F.col("n_tokens") * F.col("score")).over(w) / F.sum("n_tokens").over(w)
    return df.withColumn("advantage", F.col("score") - F.when(F.count(F.lit(1)).over(w) > 1, base).otherwise(0.0))


@register("gpg")
def gpg(df: DataFrame, f_norm: float = 1.0) -> DataFrame:
    """alpha (score - mean) / f_norm with alpha = batch size / number of scores that aren't 0."""
    g = with_totals(group_stats(df), _b=F.count(F.lit(1)), _m=F.greatest(F.count_if(F.col("score") != 0), F.lit(1)))
    return g.withColumn("advantage", F.col("_b") / F.col("_m") * (F.col("score") - F.col("g_mean")) / f_norm).drop("g_n", "g_mean", "g_std", "_b", "_m")


@register("gae")
def gae(df: DataFrame, gamma: float = 1.0, lam: float = 1.0) -> DataFrame:
    """Adds arrays ``returns`` (before whitening) and ``advantages`` (whitened over the batch)."""
    out = df.withColumn("advantages", masked.gae(F.col("rewards"), F.col("values"), F.col("mask"), gamma, lam))
    return whiten_tokens(out.withColumn("returns", F.zip_with("advantages", "values", lambda a, v: a + v)), "advantages")


@register("reinforce_plus_plus")
def reinforce_plus_plus(df: DataFrame, gamma: float = 1.0) -> DataFrame:
    out = df.withColumn("returns", masked.discounted_returns(F.col("rewards"), F.col("mask"), gamma))
    out = whiten_tokens(out.withColumn("advantages", F.col("returns")), "advantages")
    return out.withColumn("advantages", F.zip_with("advantages", "mask", lambda a, m: a * m))


@register("remax")
def remax(df: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Reward-to-go minus the greedy answer's reward, under the mask."""
    out = df.withColumn("returns", masked.reward_to_go(F.col("rewards"), F.col("mask")))
    return out.withColumn("advantages", F.zip_with("returns", "mask", lambda r, m: (r - F.col(baseline)) * m))


def token_baselines(df: DataFrame, zero_tail: bool, eps: float) -> DataFrame:
    """``uid, sid, advs``: return minus the group's energy-weighted return at the same position.

    Positions of all trajectories of a prompt meet by aggregation on (uid, position),
    so a prompt with very many trajectories is summed before it is shuffled.
    """
    energy = F.zip_with("old_lp", "spi", lambda lp, s: F.lit(1.0) - 2 * F.exp(lp) + s)
    lengths = df.withColumn("n", masked.masked_count(F.col("mask")))
    flat = lengths.select("uid", "sid", "n", F.posexplode(F.arrays_zip(F.col("returns"), masked.prefix_sums(energy, F.col("mask")).alias("w"), F.col("mask"))).alias("pos", "x")).select("uid", "sid", "n", "pos", "x.*")
    per = flat.where("mask > 0").groupBy("uid", "pos").agg((F.sum(F.col("returns") * F.col("w")) / (F.sum("w") + eps)).alias("b"))
    # the two longest responses of a prompt, ties included
    by_length = lengths.groupBy("uid", "n").agg(F.count(F.lit(1)).alias("c"))
    second = by_length.groupBy("uid").agg(F.sum("c").alias("k"), F.max("n").alias("top"), F.max_by("c", "n").alias("tops"), F.get(F.sort_array(F.collect_set("n"), False), F.lit(1)).alias("next"))
    out = flat.join(per, ["uid", "pos"], "left").join(second, "uid")
    tail = (F.col("tops") == 1) & (F.col("n") == F.col("top")) & (F.col("pos") >= F.col("next")) if zero_tail else F.lit(False)
    base = F.when((F.col("k") == 1) | F.coalesce(tail, F.lit(False)), 0.0).otherwise(F.coalesce("b", F.lit(0.0)))
    return out.select("uid", "sid", "pos", F.when(F.col("mask") > 0, F.col("returns") - base).otherwise(0.0).alias("advantage"))


@register("optimal_token_baseline")
def optimal_token_baseline(df: DataFrame, zero_tail: bool = True, eps: float = 1e-8) -> DataFrame:
    """Long form ``uid, sid, pos, advantage``; positions are those of the response."""
    out = df.withColumn("returns", masked.reward_to_go(F.col("rewards"), F.col("mask")))
    return token_baselines(out, zero_tail, eps)


@register("tir_optimal_token_baseline")
def tir_optimal_token_baseline(df: DataFrame, zero_tail: bool = True, eps: float = 1e-8) -> DataFrame:
    """The same over positions counted under the mask only; ``pos`` numbers those."""
    out = df.withColumn("returns", masked.reward_to_go(F.col("rewards"), F.col("mask")))
    packed = {c: masked.pick(F.col(c), F.col("mask")) for c in ("returns", "old_lp", "spi")}
    return token_baselines(out.withColumns(packed).withColumn("mask", F.filter("mask", lambda m: m > 0)), zero_tail, eps)

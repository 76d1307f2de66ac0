"""Forward values of policy, value and distillation losses over trajectory rows of token arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.functions.masked import clamp, kl_penalty
from lathe.operators.advantages import with_totals
from lathe.operators.rows import numbered

LOSSES: dict[str, Callable] = {}
MODES = ("token-mean", "seq-mean-token-sum", "seq-mean-token-sum-norm", "seq-mean-token-mean")


def register(name: str):
    def put(fn):
        if LOSSES.get(name, fn) is not fn:
            raise ValueError(f"loss {name!r} is registered already")
        LOSSES[name] = fn
        return fn

    return put


def agg_loss(mode: str, seq_sum: Column, n_tokens: Column, horizon: int | None = None) -> Column:
    """Aggregate of one row a sequence: its masked token sum and its number of tokens; sequences without tokens don't count."""
    if mode == "token-mean":
        return F.sum(seq_sum) / F.sum(n_tokens)
    has = F.sum(F.when(n_tokens > 0, 1.0).otherwise(0.0))
    if mode == "seq-mean-token-sum":
        return F.sum(F.when(n_tokens > 0, seq_sum).otherwise(0.0)) / has
    if mode == "seq-mean-token-sum-norm":
        if horizon is None:
            raise ValueError("seq-mean-token-sum-norm needs the padded horizon")
        return F.sum(F.when(n_tokens > 0, seq_sum).otherwise(0.0)) / has / float(horizon)
    if mode == "seq-mean-token-mean":
        return F.sum(F.when(n_tokens > 0, seq_sum / (n_tokens + 1e-8)).otherwise(0.0)) / has
    raise ValueError(f"unknown mode {mode!r}; known: {MODES}")


def lit(v) -> Column:
    return F.lit(float(v))


@register("vanilla")
def ppo(t, low=0.2, high=0.2, c=3.0):
    """Dual-clip PPO: (loss, clipped above, clipped below)."""
    ratio = F.exp(clamp(t["d"], -20, 20))
    one, two = -t["adv"] * ratio, -t["adv"] * clamp(ratio, 1 - low, 1 + high)
    top, bound = F.greatest(one, two), -t["adv"] * lit(c)
    return F.when(t["adv"] < 0, F.least(bound, top)).otherwise(top), two > one, (top > bound) & (t["adv"] < 0)


def truncated(t, valid, c):
    ratio = F.exp(clamp(t["d"], -20, 20))
    return F.when(valid, -t["adv"] * F.least(ratio, lit(c)) * t["new"]).otherwise(0.0), ~valid, (ratio > c) & valid


@register("dppo_tv")
def dppo_tv(t, low=0.2, high=0.2, c=20.0):
    """Truncated ratio times log-probability, for tokens within a total-variation bound."""
    gap = F.exp(t["new"]) - F.exp(t["old"])
    return truncated(t, F.when(t["adv"] > 0, gap <= high).otherwise(gap >= -low), c)


@register("dppo_kl")
def dppo_kl(t, low=0.2, high=0.2, c=20.0):
    """The same within a bound on the binary KL divergence."""
    p, q = F.exp(t["new"]), F.exp(t["old"])
    kl = q * (t["old"] - t["new"]) + (1 - q) * F.ln((lit(1.0) - q + 1e-8) / (lit(1.0) - p + 1e-8))
    return truncated(t, F.when(t["adv"] > 0, (kl <= high) | (p <= q)).otherwise((kl <= low) | (p >= q)), c)


@register("gspo")
def gspo(t, low=0.2, high=0.2):
    """The sequence's geometric-mean ratio stands for each token's."""
    ratio = F.exp(F.least(t["seq_d"], lit(10.0)))
    one, two = -t["adv"] * ratio, -t["adv"] * clamp(ratio, 1 - low, 1 + high)
    return F.greatest(one, two), two > one, F.lit(False)


@register("sapo")
def sapo(t, tau_pos=1.0, tau_neg=1.05):
    """Soft gate 4 / tau sigmoid(tau (ratio - 1)) in the place of a clip."""
    ratio = F.exp(clamp(t["d"], -20, 20))
    tau = F.when(t["adv"] > 0, lit(tau_pos)).otherwise(lit(tau_neg))
    return -t["adv"] * 4.0 / tau / (1 + F.exp(-tau * (ratio - 1))), F.lit(False), F.lit(False)


@register("gpg")
def gpg(t):
    return -t["new"] * t["adv"], F.lit(False), F.lit(False)


@register("cispo")
def cispo(t, low=0.2, high=0.2):
    ratio = F.exp(clamp(t["d"], -20, 20))
    clipped = clamp(ratio, 1 - low, 1 + high)
    return -clipped * t["adv"] * t["new"], ratio != clipped, F.lit(False)


@register("reinforce")
def reinforce(t):
    return -t["new"] * t["adv"], F.lit(False), F.lit(False)


FIXED_MODE = {"gspo": "seq-mean-token-mean", "sapo": "seq-mean-token-mean"}


def policy_loss(df: DataFrame, name: str, mode: str = "token-mean", horizon: int | None = None, weights: str | None = None, **options) -> DataFrame:
    """One row: ``loss``, ``clipfrac``, ``kl``, ``clipfrac_lower``. df: arrays ``old_lp, new_lp, adv, mask`` (and weights)."""
    if name not in LOSSES:
        raise ValueError(f"unknown loss {name!r}; known: {sorted(LOSSES)}")
    n = F.aggregate("mask", F.lit(0), lambda a, m: a + m)
    seq_d = F.aggregate(F.zip_with(F.zip_with("new_lp", "old_lp", lambda a, b: a - b), "mask", lambda d, m: d * m), F.lit(0.0), lambda a, x: a + x)
    rows = df.withColumns({"_n": n, "_seq": seq_d / F.greatest(n, F.lit(1))})
    zipped = F.arrays_zip(F.col("new_lp").alias("new"), F.col("old_lp").alias("old"), F.col("adv").alias("adv"), F.col("mask").alias("m"), (F.col(weights) if weights else F.col("mask")).alias("w"))

    def one(x):
        t = {"new": x["new"], "old": x["old"], "adv": x["adv"], "d": x["new"] - x["old"], "seq_d": F.col("_seq")}
        loss, high, low = LOSSES[name](t, **options)
        flag = lambda c: F.when(c, 1.0).otherwise(0.0)
        d = x["new"] - x["old"] if name == "gspo" else clamp(x["new"] - x["old"], -20, 20)
        return F.struct((loss * x["w"] if weights else loss).alias("l"), flag(high).alias("h"), flag(low).alias("o"), (-d).alias("k"))

    zero = F.struct(*(F.lit(0.0).alias(k) for k in "lhok"))
    kept = F.transform(F.filter(zipped, lambda x: x["m"] > 0), one)
    sums = F.aggregate(kept, zero, lambda a, x: F.struct(*((a[k] + x[k]).alias(k) for k in "lhok")))
    s = rows.select("_n", sums.alias("s")).select("_n", "s.*")
    mean = lambda c: F.sum(c) / (F.sum("_n") + 1e-8)
    return s.agg(agg_loss(FIXED_MODE.get(name, mode), F.col("l"), F.col("_n"), horizon).alias("loss"), mean("h").alias("clipfrac"), mean("k").alias("kl"), mean("o").alias("clipfrac_lower"))


def geo_mean_loss(df: DataFrame, low: float = 0.2, high: float = 0.2) -> DataFrame:
    """One row: ``loss``, the plain batch mean of minus advantage times the clipped geometric-mean ratio."""
    zipped = F.arrays_zip(F.col("new_lp").alias("new"), F.col("old_lp").alias("old"), F.col("adv").alias("adv"), F.col("mask").alias("m"))

    def clipped(x):
        d, s = x["new"] - x["old"], F.signum(x["adv"])
        return s * F.least(s * d, s * clamp(d, -low, high))

    kept = F.filter(zipped, lambda x: x["m"] > 0)
    total = lambda f: F.aggregate(F.transform(kept, f), F.lit(0.0), lambda a, v: a + v)
    n = F.size(kept) + F.lit(1e-8)
    return df.select((-(total(lambda x: x["adv"]) / n) * F.exp(total(clipped) / n)).alias("l")).agg(F.avg("l").alias("loss"))


def flow_loss(df: DataFrame, clip: float = 0.2, clip_high: float = 5.0) -> DataFrame:
    """One row: ``loss`` over all steps of flow samples; advantages are held within +-``clip_high``, masks aren't used."""
    x = df.select(F.explode(F.arrays_zip(F.col("new_lp").alias("new"), F.col("old_lp").alias("old"), F.col("adv").alias("adv"))).alias("x")).select("x.*")
    a, r = clamp(F.col("adv"), -clip_high, clip_high), F.exp(F.col("new") - F.col("old"))
    return x.agg(F.avg(F.greatest(-a * r, -a * clamp(r, 1 - clip, 1 + clip))).alias("loss"))


def tokens(df: DataFrame) -> DataFrame:
    """Long form of the tokens under the mask: ``sid, pos, new, old, adv``."""
    zipped = F.arrays_zip(F.col("new_lp").alias("new"), F.col("old_lp").alias("old"), F.col("adv").alias("adv"), F.col("mask").alias("m"))
    return df.select("sid", F.posexplode(zipped).alias("pos", "x")).select("sid", "pos", "x.*").where("m > 0").drop("m")


def with_covariance(df: DataFrame) -> DataFrame:
    """Tokens with ``cov``: advantage and log-probability, each less its mean over all tokens."""
    t = with_totals(tokens(df), _a=F.sum("adv") / (F.count(F.lit(1)) + 1e-8), _l=F.sum("new") / (F.count(F.lit(1)) + 1e-8))
    return t.withColumn("cov", (F.col("adv") - F.col("_a")) * (F.col("new") - F.col("_l"))).drop("_a", "_l")


def kl_cov_loss(df: DataFrame, ratio: float = 0.0002, coef: float = 1.0) -> DataFrame:
    """Token-mean of minus advantage times ratio, with a KL term on the share ``ratio`` of tokens of largest covariance; ties in the order of sid and pos."""
    t = numbered(with_covariance(df), [F.desc("cov"), "sid", "pos"], "place")
    k = max(1, int(t.count() * ratio))
    d = F.col("new") - F.col("old")
    loss = -F.col("adv") * F.exp(d) + F.when(F.col("place") < k, F.abs(d) * coef).otherwise(0.0)
    return t.agg(F.avg(loss).alias("loss"), (F.sum(F.abs(d)) / (F.count(F.lit(1)) + 1e-8)).alias("kl"))


def clip_cov_loss(df: DataFrame, ratio: float = 0.0002, low_cov: float = 1.0, high_cov: float = 5.0, low: float = 0.2, high: float = 0.2, seed: int = 0) -> DataFrame:
    """PPO loss without the share ``ratio`` of tokens drawn (by hash) from those of covariance within the bounds and not clipped anyway."""
    r = F.exp(F.col("new") - F.col("old"))
    one, two = -F.col("adv") * r, -F.col("adv") * clamp(r, 1 - low, 1 + high)
    drawable = (F.col("cov") < high_cov) & (F.col("cov") > low_cov) & ~(two > one)
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("sid").cast("string"), F.col("pos").cast("string")), 256)
    t = numbered(with_covariance(df).withColumns({"shut": ~drawable, "draw": order}), ["shut", "draw", "sid", "pos"], "place")
    gone = ~F.col("shut") & (F.col("place") < max(1, int(t.count() * ratio)))
    return t.agg(F.avg(F.when(gone, 0.0).otherwise(F.greatest(one, two))).alias("loss"), (F.sum(F.when(gone, 1.0).otherwise(0.0)) / (F.count(F.lit(1)) + 1e-8)).alias("clipfrac"))


def value_loss(df: DataFrame, clip: float = 0.5, mode: str = "token-mean", horizon: int | None = None) -> DataFrame:
    """One row: ``loss`` and ``clipfrac`` of the clipped value regression. df: arrays ``vpreds, returns, values, mask``."""
    zipped = F.arrays_zip("vpreds", "returns", "values", F.col("mask").alias("m"))

    def one(x):
        a, b = (x["vpreds"] - x["returns"]) ** 2, (clamp(x["vpreds"], x["values"] - clip, x["values"] + clip) - x["returns"]) ** 2
        return F.struct(F.greatest(a, b).alias("l"), F.when(b > a, 1.0).otherwise(0.0).alias("h"))

    kept = F.transform(F.filter(zipped, lambda x: x["m"] > 0), one)
    sums = F.aggregate(kept, F.struct(F.lit(0.0).alias("l"), F.lit(0.0).alias("h")), lambda a, x: F.struct((a["l"] + x["l"]).alias("l"), (a["h"] + x["h"]).alias("h")))
    s = df.select(F.size(kept).alias("_n"), sums.alias("s")).select("_n", "s.*")
    return s.agg((0.5 * agg_loss(mode, F.col("l"), F.col("_n"), horizon)).alias("loss"), (F.sum("h") / (F.sum("_n") + 1e-8)).alias("clipfrac"))


def distill_estimator_loss(df: DataFrame, kind: str, cap: float | None = None, mode: str = "token-mean") -> DataFrame:
    """Distillation loss from a per-token KL estimate of student ``new_lp`` against teacher ``ref_lp``: loss, min and max."""
    zipped = F.arrays_zip(F.col("new_lp").alias("s"), F.col("ref_lp").alias("t"), F.col("mask").alias("m"))

    def one(x):
        v = kl_penalty(x["s"], x["t"], kind)
        return v if cap is None else clamp(v, -cap, cap)

    kept = F.transform(F.filter(zipped, lambda x: x["m"] > 0), one)
    s = df.select(F.size(kept).alias("_n"), F.aggregate(kept, F.lit(0.0), lambda a, v: a + v).alias("l"), F.array_min(kept).alias("lo"), F.array_max(kept).alias("hi"))
    return s.agg(agg_loss(mode, F.col("l"), F.col("_n")).alias("loss"), F.min("lo").alias("loss_min"), F.max("hi").alias("loss_max"))


def topk_kl(teacher: Column, student: Column, forward: bool = True) -> Column:
    """KL over the teacher's (forward) or the student's (reverse) top-k log-probabilities, never below 0."""
    p, q = (teacher, student) if forward else (student, teacher)
    return F.greatest(F.aggregate(F.zip_with(p, q, lambda a, b: F.exp(a) * (a - b)), F.lit(0.0), lambda s, v: s + v), F.lit(0.0))

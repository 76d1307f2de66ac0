"""Masked reductions and recurrences over ragged token arrays; one row is one trajectory, nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS_MEAN = 1e-8


def pick(values: Column, mask: Column) -> Column:
    """Elements where the mask is set; NaN or null outside it never reaches the result."""
    return F.filter(values, lambda v, i: F.get(mask, i) > 0)


def zero_outside(values: Column, mask: Column) -> Column:
    return F.zip_with(values, mask, lambda v, m: F.when(m > 0, v).otherwise(F.lit(0.0)))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def masked_sum(values: Column, mask: Column) -> Column:
    return total(zero_outside(values, mask))


def masked_count(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0), lambda a, m: a + F.when(m > 0, 1).otherwise(0))


def masked_mean(values: Column, mask: Column) -> Column:
    """sum / (count + 1e-8): an empty mask gives 0."""
    return masked_sum(values, mask) / (masked_count(mask) + F.lit(EPS_MEAN))


def reward_to_go(rewards: Column, mask: Column) -> Column:
    """Reverse cumulative sum of the masked rewards."""
    step = lambda acc, r: F.struct((acc["s"] + r).alias("s"), F.array_append(acc["out"], acc["s"] + r).alias("out"))
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("out"))
    return F.reverse(F.aggregate(F.reverse(zero_outside(rewards, mask)), start, step, lambda acc: acc["out"]))


def prefix_sums(values: Column, mask: Column) -> Column:
    """Cumulative sum of the masked values from the start."""
    step = lambda acc, v: F.struct((acc["s"] + v).alias("s"), F.array_append(acc["out"], acc["s"] + v).alias("out"))
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(zero_outside(values, mask), start, step, lambda acc: acc["out"])


def discounted_returns(rewards: Column, mask: Column, gamma: float) -> Column:
    """R_t = r_t + gamma R_{t+1}; what is carried on is dropped after a masked token."""
    rows = F.reverse(F.arrays_zip(rewards.alias("r"), mask.alias("m")))
    start = F.struct(F.lit(0.0).alias("c"), F.array().cast("array<double>").alias("out"))

    def step(acc, x):
        now = x["r"] + F.lit(gamma) * acc["c"]
        return F.struct((now * x["m"]).alias("c"), F.array_append(acc["out"], now).alias("out"))

    return F.reverse(F.aggregate(rows, start, step, lambda acc: acc["out"]))


def gae(rewards: Column, values: Column, mask: Column, gamma: float, lam: float) -> Column:
    """Generalised advantages; a masked token hands the next value and the last advantage on unchanged."""
    rows = F.reverse(F.arrays_zip(rewards.alias("r"), values.alias("v"), mask.alias("m")))
    start = F.struct(F.lit(0.0).alias("nv"), F.lit(0.0).alias("last"), F.array().cast("array<double>").alias("out"))

    def step(acc, x):
        adv = x["r"] + F.lit(gamma) * acc["nv"] - x["v"] + F.lit(gamma * lam) * acc["last"]
        last = F.when(x["m"] > 0, adv).otherwise(acc["last"])
        return F.struct(F.when(x["m"] > 0, x["v"]).otherwise(acc["nv"]).alias("nv"), last.alias("last"), F.array_append(acc["out"], last).alias("out"))

    return F.reverse(F.aggregate(rows, start, step, lambda acc: acc["out"]))


def longest_run(values: Column, of: float = 0.0) -> Column:
    """Length of the longest run of elements equal to ``of``."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(acc, v):
        now = F.when(v == of, acc["now"] + 1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["best"], now).alias("best"))

    return F.aggregate(values, start, step, lambda acc: acc["best"])


def response_mask_from_eos(ids: Column, eos: list[int]) -> Column:
    """1 up to and including the first end token; all 1 without one."""
    first = F.array_min(F.array_compact(F.array(*(F.nullif(F.array_position(ids, F.lit(e)), F.lit(0)) for e in eos))))
    return F.transform(ids, lambda x, i: F.when(first.isNull() | (i < first), 1).otherwise(0))


def pad(ids: Column, length: int, fill: int, left: bool = False) -> Column:
    missing = F.array_repeat(F.lit(fill), F.greatest(F.lit(0), F.lit(length) - F.size(ids)))
    return F.concat(missing, ids) if left else F.concat(ids, missing)


def truncate(ids: Column, length: int, side: str = "right") -> Column:
    """Keep ``length`` tokens: cut at the right, the left or the middle; ``error`` raises on a longer one."""
    n = F.size(ids)
    if side == "right":
        cut = F.slice(ids, 1, length)
    elif side == "left":
        cut = F.slice(ids, n - length + 1, F.lit(length))
    elif side == "middle":
        half = length // 2
        cut = F.concat(F.slice(ids, 1, half), F.slice(ids, n - (length - half) + 1, F.lit(length - half)))
    elif side == "error":
        return F.when(n > length, F.raise_error(F.lit(f"more than {length} tokens"))).otherwise(ids)
    else:
        raise ValueError(f"unknown side {side!r}")
    return F.when(n > length, cut).otherwise(ids)


def kl_penalty(logprob: Column, ref: Column, kind: str) -> Column:
    """Forward value of a per-token KL estimate; a trailing + changes gradients only."""
    d = logprob - ref
    kind = kind.removesuffix("+")
    if kind in ("kl", "k1"):
        return d
    if kind == "abs":
        return F.abs(d)
    if kind in ("mse", "k2"):
        return F.lit(0.5) * d * d
    if kind in ("low_var_kl", "k3"):
        back = clamp(-d, -20, 20)
        return clamp(F.exp(back) - back - 1, -10, 10)
    raise ValueError(f"unknown estimate {kind!r}")


def clamp(x: Column, low, high) -> Column:
    low, high = (F.lit(float(v)) if isinstance(v, (int, float)) else v for v in (low, high))
    return F.least(F.greatest(x, low), high)


def mismatches(a: Column, b: Column, mask: Column) -> Column:
    """Positions under the mask where two token lists differ."""
    return F.aggregate(F.zip_with(F.zip_with(a, b, lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1)), mask, lambda d, m: d * m), F.lit(0), lambda s, x: s + x)


def left_truncated_targets(mask: Column, targets: Column, length: int) -> Column:
    """Per-response-token targets of the last ``length`` tokens.

    A target belongs to the position before its token, so the first token kept
    loses its target along with those cut off.
    """
    kept = F.slice(mask, F.greatest(F.size(mask) - length, F.lit(0)) + 1, F.lit(length))
    count = lambda m: F.aggregate(m, F.lit(0), lambda a, x: a + x)
    start = count(mask) - count(kept) + F.get(kept, F.lit(0))
    return F.slice(targets, start + 1, count(kept) - F.get(kept, F.lit(0)))


def response_predictions(values: Column, prompt_length: Column, response_length: Column) -> Column:
    """Of values over prompt and response: those that predict the response, one place to the left of its tokens."""
    return F.slice(values, prompt_length, response_length)


def resample_weight(score: Column, method: str, power: float = 2.0, low: Column | None = None, high: Column | None = None) -> Column:
    """Weight of a sample when a batch is drawn anew: a power of its size, or by being the extreme."""
    if method == "pow":
        w = F.pow(F.abs(score), F.lit(power))
    elif method == "max_min":
        w = F.when((score == high) | (score == low), 1.0).otherwise(0.0)
    elif method == "max_random":
        w = F.when(score == high, 0.4).otherwise(0.1)
    else:
        raise ValueError(f"unknown method {method!r}")
    return w + 1e-8

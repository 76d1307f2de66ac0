"""Rollout correction: importance weights, rejection masks and off-policy metrics over trajectory rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.functions import masked
from lathe.functions.masked import clamp
from lathe.operators.advantages import with_totals

SAFETY = 20.0
TOKEN_OPTIONS = ("token_k1", "token_k2", "token_k3")
OPTIONS = (*TOKEN_OPTIONS, *(f"{level}_{k}" for level in ("seq_sum", "seq_mean") for k in ("k1", "k2", "k3")), "seq_max_k2", "seq_max_k3")


def parse_threshold(spec: str | float) -> tuple[float | None, float]:
    """``"lo_hi"`` -> (lo, hi), ``hi`` -> (None, hi)."""
    parts = [float(x) for x in str(spec).split("_")]
    low, high = (None, parts[0]) if len(parts) == 1 else parts
    if high <= 0 or (low is not None and not 0 < low <= high):
        raise ValueError(f"bad threshold {spec!r}")
    return low, high


def parse_rejection(options: str, thresholds: str | float) -> dict[str, tuple[float | None, float]]:
    """Comma lists of options and thresholds, paired; one threshold serves all. A k1 option without a lower bound takes 1 / upper."""
    names = list(dict.fromkeys(x.strip() for x in options.split(",") if x.strip()))
    specs = [x.strip() for x in str(thresholds).split(",") if x.strip()]
    if bad := [x for x in names if x not in OPTIONS]:
        raise ValueError(f"unknown options {bad}; known: {OPTIONS}")
    if len(specs) == 1:
        specs *= len(names)
    if not names or len(specs) != len(names):
        raise ValueError("options and thresholds differ in number")
    out = {}
    for name, spec in zip(names, specs, strict=True):
        low, high = parse_threshold(spec)
        out[name] = (low if low is not None else 1 / high, high) if name.endswith("k1") else (None, high)
    return out


def log_ratio(df: DataFrame) -> Column:
    return F.zip_with("old_lp", "roll_lp", lambda a, b: a - b)


def importance_weights(df: DataFrame, level: str = "token", threshold: str | float = 2.0, normalise: bool = False) -> DataFrame:
    """Adds array ``is_w``: ratio of training to rollout policy, per token or as the sequence's product.

    One number truncates above; ``lo_hi`` zeroes what lies outside. Tokens outside the mask weigh 0.
    """
    low, high = parse_threshold(threshold)
    mask = F.col("mask")
    if level == "token":
        raw = F.zip_with(log_ratio(df), mask, lambda d, m: F.exp(clamp(d, -SAFETY, SAFETY)) * m)
    elif level == "sequence":
        total = masked.masked_sum(log_ratio(df), mask)
        raw = F.transform(mask, lambda m: F.exp(clamp(total, -SAFETY, SAFETY)) * m)
    else:
        raise ValueError(f"unknown level {level!r}")
    keep = (lambda w: F.least(w, F.lit(high))) if low is None else (lambda w: F.when((w >= low) & (w <= high), w).otherwise(0.0))
    out = df.withColumn("is_w", F.transform(raw, keep))
    if not normalise:
        return out
    if level == "token":
        mean = F.sum(masked.masked_sum(F.col("is_w"), mask)) / (F.sum(masked.masked_count(mask)) + 1e-8)
    else:
        has = F.when(masked.masked_count(mask) > 0, 1.0).otherwise(0.0)
        mean = F.sum(masked.masked_mean(F.col("is_w"), mask) * has) / F.greatest(F.sum(has), F.lit(1e-8))
    out = with_totals(out, _mean=mean)
    return out.withColumn("is_w", F.transform("is_w", lambda w: F.when(F.col("_mean") > 1e-8, w / F.col("_mean")).otherwise(w))).drop("_mean")


def divergence(kind: str):
    return {"k1": lambda d: -d, "k2": lambda d: 0.5 * d * d, "k3": lambda d: F.exp(d) - 1.0 - d}[kind]


def within(low: float | None, high: float):
    """(mask, value) -> the mask where the value lies within the bounds, else 0."""
    return lambda m, v: F.when((v <= high) if low is None else (v >= low) & (v <= high), m).otherwise(0)


def rejection_mask(df: DataFrame, options: str, thresholds: str | float) -> DataFrame:
    """Adds array ``kept_mask``: the mask without tokens or sequences whose divergence leaves the bounds of any option."""
    mask = F.col("mask")
    safe = F.transform(log_ratio(df), lambda d: clamp(d, -SAFETY, SAFETY))
    out = mask
    for name, (low, high) in parse_rejection(options, thresholds).items():
        stat = F.transform(safe, divergence(name[-2:]))
        bounds = (math.log(low), math.log(high)) if name.endswith("k1") else (None, high)
        if name in TOKEN_OPTIONS:
            out = F.zip_with(out, stat, within(*bounds))
            continue
        if name.startswith("seq_sum"):
            value = masked.masked_sum(stat, mask)
        elif name.startswith("seq_mean"):
            value = masked.masked_mean(stat, mask)
        else:
            value = F.coalesce(F.array_max(masked.pick(stat, mask)), F.lit(0.0))
        out = F.zip_with(out, F.transform(mask, lambda _: value), within(*bounds))  # noqa: B023
    return df.withColumn("kept_mask", out)


def rejection_summary(df: DataFrame) -> DataFrame:
    """Shares of tokens and of sequences with tokens that the mask lost."""
    before, after = masked.masked_count(F.col("mask")), masked.masked_count(F.col("kept_mask"))
    s = df.select(before.alias("b"), after.alias("a"))
    return s.agg(((F.sum("b") - F.sum("a")) / F.sum("b")).alias("token_fraction"), F.avg(F.when(F.col("b") > 0, F.when(F.col("a") < F.col("b"), 1.0).otherwise(0.0))).alias("seq_fraction"))


def weight_metrics(df: DataFrame, threshold: float = 2.0) -> DataFrame:
    """One row over the applied weights: mean, std, min, max, effective sample size, sequence means."""
    w = F.transform(masked.pick(F.col("is_w"), F.col("mask")), lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(float(threshold))))
    s = df.select(F.size(w).alias("n"), masked.total(w).alias("s"), masked.total(F.transform(w, lambda x: x * x)).alias("q"), F.array_min(w).alias("lo"), F.array_max(w).alias("hi"), masked.masked_mean(F.col("is_w"), F.col("mask")).alias("m"))
    n = F.sum("n") + 1e-8
    mean, square = F.sum("s") / n, F.sum("q") / n
    return s.agg(mean.alias("is_mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("is_std"), F.min("lo").alias("is_min"), F.max("hi").alias("is_max"), ((mean + 1e-8) * (mean + 1e-8) / square).alias("ess"), F.avg("m").alias("seq_mean"), F.stddev_samp("m").alias("seq_std"), F.max(F.abs(F.col("m") - 1)).alias("seq_max_deviation"))


def off_policy_metrics(df: DataFrame) -> DataFrame:
    """One row: perplexities, kl, k3, log-perplexity gaps and chi-squared of training against rollout policy."""
    m = F.col("mask")
    d = log_ratio(df)
    s = df.select(
        masked.masked_count(m).alias("n"),
        masked.masked_mean(F.col("old_lp"), m).alias("t"),
        masked.masked_mean(F.col("roll_lp"), m).alias("r"),
        masked.masked_sum(d, m).alias("d"),
        masked.masked_sum(F.transform(d, lambda x: F.exp(x) - x - 1), m).alias("k3"),
        masked.masked_sum(F.transform(d, lambda x: F.exp(2 * clamp(x, -SAFETY, SAFETY))), m).alias("c"),
    )
    n, gap = F.sum("n") + 1e-8, F.col("r") - F.col("t")
    return s.agg(
        F.avg(F.exp(-F.col("t"))).alias("training_ppl"),
        F.avg(-F.col("t")).alias("training_log_ppl"),
        F.avg(F.exp(-F.col("r"))).alias("rollout_ppl"),
        F.avg(-F.col("r")).alias("rollout_log_ppl"),
        (-F.sum("d") / n).alias("kl"),
        (F.sum("k3") / n).alias("k3_kl"),
        F.avg(gap).alias("log_ppl_diff"),
        F.avg(F.abs(gap)).alias("log_ppl_abs_diff"),
        F.max(gap).alias("log_ppl_diff_max"),
        F.min(gap).alias("log_ppl_diff_min"),
        F.avg(F.exp(gap)).alias("ppl_ratio"),
        (F.sum("c") / n - 1).alias("chi2_token"),
        (F.avg(F.exp(2 * clamp(F.col("d"), -SAFETY, SAFETY))) - 1).alias("chi2_seq"),
    )

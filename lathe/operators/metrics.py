"""Metric tables: reduction by name, data, timing and validation metrics, quantiles and audits."""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lathe.operators.groups import majority
from lathe.operators.rows import numbered

# Metrics whose last value counts, and the ones with a rule of their own.
LAST = [
    "fully_async/count/total_generated_samples",
    "fully_async/count/stale_samples_processed",
    "fully_async/count/stale_trajectory_processed",
    "fully_async/count/current_param_version",
    "fully_async/count/dropped_stale_samples",
    "training/global_step",
]
OWN_RULE = {
    "perf/time_per_step": "sum",
    "timing_s/agent_loop/tool_calls/min": "min",
    "timing_s/agent_loop/tool_calls/mean": "avg",
    "timing_s/agent_loop/tool_calls/max": "max",
}


def reduce_by_name(df: DataFrame) -> DataFrame:
    """``name, value`` -> one row a name: max if the name holds "max", else min if it holds "min", else mean."""
    pick = F.when(F.col("name").contains("max"), F.max("value")).when(F.col("name").contains("min"), F.min("value")).otherwise(F.avg("value"))
    return df.groupBy("name").agg(pick.alias("value"))


def step_rule(name: Column) -> Column:
    low = F.lower(name)
    has = lambda *xs: F.lit(False) if not xs else low.rlike("|".join(xs))
    own = F.when(name.isin(LAST), "last")
    for key, rule in OWN_RULE.items():
        own = own.when(name == key, rule)
    return own.when(low.contains("timing_s/"), "sum").when(has("mean", "avg", "average"), "avg").when(has("max"), "max").when(has("min"), "min").when(has("sum", "total"), "sum").otherwise("avg")


def aggregate_steps(df: DataFrame) -> DataFrame:
    """``step, name, value`` -> one value a name under the name's rule; "last" is that of the greatest step."""
    r = F.col("rule")
    pick = F.when(r == "last", F.max_by("value", "step")).when(r == "sum", F.sum("value")).when(r == "max", F.max("value")).when(r == "min", F.min("value")).otherwise(F.avg("value"))
    return df.withColumn("rule", step_rule(F.col("name"))).groupBy("name", "rule").agg(pick.alias("value"))


def special_metrics(df: DataFrame, gpus: int) -> DataFrame:
    """``name, value`` (aggregated) with throughput, idle ratio and length gap recomputed from the aggregates."""
    names = ["global_seqlen/max", "global_seqlen/min", "perf/total_num_tokens", "perf/time_per_step", "timing_s/gen", "timing_s/step"]
    v = {n: F.max(F.when(F.col("name") == n, F.col("value"))) for n in names}
    made = F.array(
        F.struct(F.lit("global_seqlen/minmax_diff").alias("name"), (v["global_seqlen/max"] - v["global_seqlen/min"]).alias("value")),
        F.struct(F.lit("perf/throughput").alias("name"), F.try_divide(v["perf/total_num_tokens"], v["perf/time_per_step"] * gpus).alias("value")),
        F.struct(F.lit("fully_async/trainer/idle_ratio").alias("name"), F.try_divide(v["timing_s/gen"], v["timing_s/step"]).alias("value")),
    )
    new = df.agg(F.filter(made, lambda x: x["value"].isNotNull()).alias("m")).select(F.explode("m").alias("x")).select("x.*")
    return df.where(~F.col("name").isin("global_seqlen/minmax_diff", "perf/throughput", "fully_async/trainer/idle_ratio")).unionByName(new)


def aggregate_ranks(df: DataFrame, kind: str) -> DataFrame:
    """``name, rank, slot, value``: sums and means are averaged over ranks slot by slot first; min and max run over all. Unequal slot counts raise."""
    if kind in ("min", "max"):
        return df.groupBy("name").agg((F.min if kind == "min" else F.max)("value").alias("value"))
    counts = df.groupBy("name", "rank").agg(F.count(F.lit(1)).alias("n")).groupBy("name").agg(F.min("n").alias("a"), F.max("n").alias("b"))
    per = df.groupBy("name", "slot").agg(F.avg("value").alias("v"))
    out = per.groupBy("name").agg((F.sum if kind == "sum" else F.avg)("v").alias("value")).join(counts, "name")
    return out.select("name", F.when(F.col("a") == F.col("b"), F.col("value")).otherwise(F.raise_error(F.lit("ranks hold unequal numbers of values"))).alias("value"))


def loggable(df: DataFrame) -> DataFrame:
    """``name, value``: summed, least, greatest or mean by the name's ending."""
    n = F.col("name")
    total = n.endswith("/sum") | n.endswith("_sum") | n.endswith("/active_tokens") | n.endswith("/token_count")
    pick = F.when(total, F.sum("value")).when(n.endswith("/min"), F.min("value")).when(n.endswith("/max"), F.max("value")).otherwise(F.avg("value"))
    return df.groupBy("name").agg(pick.alias("value"))


def data_metrics(df: DataFrame, max_response: int) -> DataFrame:
    """One row over trajectories ``score, reward, length``: scores of non-empty responses, lengths, clip and abort shares."""
    live = F.col("length") > 0
    on = lambda c: F.when(live, F.col(c))
    aggs = []
    for c in ("score", "reward"):
        aggs += [F.avg(on(c)).alias(f"{c}_mean"), F.max(on(c)).alias(f"{c}_max"), F.min(on(c)).alias(f"{c}_min")]
    aggs += [F.avg("length").alias("length_mean"), F.max("length").alias("length_max"), F.min("length").alias("length_min")]
    aggs += [F.avg((F.col("length") == max_response).cast("double")).alias("clip_ratio"), F.avg((~live).cast("double")).alias("aborted_ratio")]
    return df.agg(*aggs)


def explained_variance(df: DataFrame, returns: str, values: str) -> DataFrame:
    gap = F.col(returns) - F.col(values)
    return df.agg((1 - F.var_samp(gap) / (F.var_samp(returns) + 1e-5)).alias("explained_variance"))


def validation_metrics(df: DataFrame) -> DataFrame:
    """``data_source, uid, sample_index, score, pred`` -> per source and group size n: mean@n, std@n, maj@n, averaged over prompts."""
    keys = ["data_source", "uid"]
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))
    vote = majority(df, keys, "pred", "score", ["sample_index"]).select(*keys, F.col("value").alias("maj"))
    return per.join(vote, keys).groupBy("data_source", "n").agg(F.avg("mean").alias("mean_at_n"), F.avg("std").alias("std_at_n"), F.avg("maj").alias("maj_at_n"), F.count(F.lit(1)).alias("prompts"))


def sizes_up_to(n: Column) -> Column:
    """2, 4, 8, ... below ``n``, then ``n``; of one sample none."""
    powers = F.filter(F.array(*(F.lit(1 << i) for i in range(1, 31))), lambda k: k < n)
    return F.when(n > 1, F.array_append(powers, n.cast("int"))).otherwise(F.array().cast("array<int>"))


def best_and_worst_at_k(df: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """``keys, variable, n, k`` and mean and std of the best and the worst of ``k`` draws with replacement from a prompt's ``n`` samples.

    These are the moments that resampling estimates, in closed form: the ``i``-th
    smallest of ``n`` is the best of ``k`` with probability ``(i/n)^k - ((i-1)/n)^k``.
    Null values of a variable don't count as samples.
    """
    long = F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in variables))).alias("x")
    per = df.select(*keys, long).select(*keys, "x.*").where("value is not null").groupBy(*keys, "variable").agg(F.sort_array(F.collect_list("value")).alias("v"))
    per = per.withColumn("n", F.size("v")).withColumn("k", F.explode(sizes_up_to(F.col("n"))))

    def moment(power, best):
        share = lambda i: F.pow(i / F.col("n"), F.col("k"))
        weight = (lambda i: share(i + 1) - share(i)) if best else (lambda i: share(F.col("n") - i) - share(F.col("n") - i - 1))
        return F.aggregate(F.transform("v", lambda x, i: F.pow(x, F.lit(power)) * weight(i)), F.lit(0.0), lambda a, x: a + x)

    std = lambda best: F.sqrt(F.greatest(moment(2, best) - F.pow(moment(1, best), F.lit(2)), F.lit(0.0)))
    return per.select(*keys, "variable", "n", "k", moment(1, True).alias("best_mean"), std(True).alias("best_std"), moment(1, False).alias("worst_mean"), std(False).alias("worst_std"))


def win_chances(counts: tuple[int, ...], k: int) -> dict[int, float]:
    """Of ``k`` draws with replacement among answers that ``counts`` samples gave: the chance that one answer of a given count is the majority.

    Equally frequent answers are equally likely to be seen first. Generating
    functions of the other answers, whose exponents count draws and ties.
    """
    n, out = sum(counts), {}
    for c in set(counts):
        others = list(counts)
        others.remove(c)
        total = 0.0
        for t in range(1, k + 1):
            ways = {(0, 0): 1.0}  # (draws, ties) -> weight
            for o in others:
                grown: dict = {}
                for (d, e), w in ways.items():
                    for s in range(min(t, k - t - d) + 1):
                        at = d + s, e + (s == t)
                        grown[at] = grown.get(at, 0.0) + w * (o / n) ** s / math.factorial(s)
                ways = grown
            mine = (c / n) ** t / math.factorial(t)
            total += sum(mine * w / (e + 1) for (d, e), w in ways.items() if d == k - t)
        out[c] = total * math.factorial(k)
    return out


def majority_at_k(df: DataFrame, keys: list[str], vote: str, value: str) -> DataFrame:
    """``keys, n, k, maj_mean, maj_std`` of the value that the majority of ``k`` draws with replacement has, in closed form.

    The value is that of the majority's first draw. The chances depend on how often
    answers occur, not on which; they are worked out once for each such profile.
    """
    classes = df.groupBy(*keys, vote).agg(F.count(F.lit(1)).alias("c"), F.avg(value).alias("m1"), F.avg(F.col(value) * F.col(value)).alias("m2"))
    per = classes.groupBy(*keys).agg(F.sort_array(F.collect_list("c")).alias("profile"), F.collect_list(F.struct("c", "m1", "m2")).alias("classes"), F.sum("c").alias("n")).withColumn("k", F.explode(sizes_up_to(F.col("n"))))

    def chances(batches):
        for batch in batches:
            rows = [(p, k, c, w) for p, k in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True) for c, w in win_chances(tuple(p), k).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.float64()))], names=["profile", "k", "c", "chance"])

    table = per.select("profile", "k").distinct().mapInArrow(chances, "profile array<bigint>, k int, c long, chance double")
    each = per.select(*keys, "n", "k", "profile", F.explode("classes").alias("x")).select(*keys, "n", "k", "profile", "x.*").join(table, ["profile", "k", "c"])
    moments = each.groupBy(*keys, "n", "k").agg(F.sum(F.col("chance") * F.col("m1")).alias("maj_mean"), F.sum(F.col("chance") * F.col("m2")).alias("sq"))
    return moments.withColumn("maj_std", F.sqrt(F.greatest(F.col("sq") - F.col("maj_mean") ** 2, F.lit(0.0)))).drop("sq")


def metric_names(df: DataFrame, core: str) -> DataFrame:
    """``data_source, variable, metric, n`` (metric like ``best@4/mean``, n its size) with ``name``.

    A name starts with ``val-core`` where the variable is ``core`` and the metric is a
    mean, majority or best at the source's greatest n, else with ``val-aux``.
    """
    most = df.groupBy("data_source", "variable").agg(F.max("n").alias("_most"))
    main = (F.col("variable") == core) & F.col("metric").rlike("^(mean|maj|best)") & (F.col("n") == F.col("_most"))
    return df.join(most, ["data_source", "variable"]).withColumn("name", F.concat_ws("/", F.when(main, "val-core").otherwise("val-aux"), "data_source", "variable", "metric")).drop("_most")


def mean_of_means(df: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """Mean within each inner key, then over them per outer key."""
    return df.groupBy(outer, inner).agg(F.avg(value).alias("m")).groupBy(outer).agg(F.avg("m").alias("score"), F.count(F.lit(1)).alias("rows"))


def quantiles(df: DataFrame, column: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """``by, q``: linear-interpolated quantiles in the order of ``shares``; nulls don't count.

    Rows are ranked, over the whole table by ranges and within groups by a window that
    can spill, and only the two neighbours of each quantile go on; no task holds a
    table of values.
    """
    by = by or []
    known = df.select(*by, F.col(column).cast("double").alias("_x")).where("_x is not null")
    if by:
        w = Window.partitionBy(*by)
        ranked = known.withColumns({"_at": F.row_number().over(w.orderBy("_x")) - 1, "_n": F.count(F.lit(1)).over(w)})
    else:
        ranked = numbered(known, ["_x"], "_at").withColumn("_n", F.lit(known.count()))
    places = [F.lit(q) * (F.col("_n") - 1) for q in shares]
    near = reduce(lambda a, b: a | b, [(F.col("_at") == F.floor(p)) | (F.col("_at") == F.ceil(p)) for p in places])
    kept = ranked.where(near)

    def value(p):
        low, high = (F.max(F.when(F.col("_at") == f(p), F.col("_x"))) for f in (F.floor, F.ceil))
        return low + (high - low) * F.max(p - F.floor(p))

    return kept.groupBy(*by).agg(F.array(*(value(p) for p in places)).alias("q"))


def quantile_edges(df: DataFrame, column: str, parts: int) -> list[float]:
    """Linear-interpolated value edges of ``parts`` equal shares."""
    return quantiles(df, column, [i / parts for i in range(parts + 1)]).first()["q"]


def quantile_buckets(df: DataFrame, column: str, parts: int, name: str = "bucket") -> DataFrame:
    """Right-closed buckets by value edges; the first holds the minimum; equal edges fall together."""
    edges = sorted(set(quantile_edges(df, column, parts)))
    pick = F.when(F.col(column) <= edges[1] if len(edges) > 1 else F.lit(True), 0)
    for i, e in enumerate(edges[2:], 1):
        pick = pick.when(F.col(column) <= e, i)
    return df.withColumn(name, pick)


def histogram_quantile(hist: DataFrame, q: float, scale: float = 1.0) -> DataFrame:
    """``bin, n`` -> the first bin whose cumulative count exceeds q (total - 1), times ``scale``."""
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = hist.withColumn("c", F.sum("n").over(w))  # one row a bin
    total = hist.agg(F.sum("n").alias("t"))
    return c.join(F.broadcast(total), F.col("c") > F.floor(F.lit(q) * (F.col("t") - 1))).agg((F.min("bin") * scale).alias("value"))


def quantile_summary(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    qs, by = [0.01, 0.05, 0.5, 0.95, 0.99], by or []
    plain = df.groupBy(*by).agg(F.avg(column).alias("mean"), F.min(column).alias("min"), F.max(column).alias("max"))
    found = quantiles(df, column, qs, by)
    both = plain.join(found, by) if by else plain.join(F.broadcast(found))  # one row each
    return both.select(*by, "mean", "min", "max", *(F.col("q")[i].alias(f"p{round(q * 100):02d}") for i, q in enumerate(qs)))


def tail_ratio(df: DataFrame, column: str, percent: float) -> DataFrame:
    """Share of values above the (1 - percent/100) quantile, with min and max."""
    cut = quantiles(df, column, [1 - percent / 100]).first()
    return df.agg(F.avg((F.col(column) > F.lit(cut["q"][0] if cut else None)).cast("double")).alias("tail_ratio"), F.min(column).alias("min"), F.max(column).alias("max"))


def slowest(df: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """min, max and mean of ``by``, and the fields of the row where it is greatest (ties: the greatest fields)."""
    top = F.max(F.struct(F.col(by).alias("_v"), *fields))
    return df.agg(F.min(by).alias("min"), F.max(by).alias("max"), F.avg(by).alias("mean"), top.alias("t")).select("min", "max", "mean", *(F.col("t")[f].alias(f"slowest_{f}") for f in fields))


# Two-sided 95% quantiles of Student's t by degrees of freedom, fixed values.
T95 = [12.7062, 4.3027, 3.1824, 2.7764, 2.5706, 2.4469, 2.3646, 2.3060, 2.2622, 2.2281]


def t95(degrees: Column) -> Column:
    """Two-sided 95% quantile of Student's t: the table up to its end, then the expansion in powers of 1 / degrees, which is within 0.00001 there."""
    z, v = 1.959963984540054, degrees.cast("double")
    terms = [
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]
    series = reduce(lambda acc, x: acc + F.lit(x[1]) / F.pow(v, F.lit(x[0])), enumerate(terms, 1), F.lit(z))
    table = F.element_at(F.array(*map(F.lit, T95)), F.least(F.greatest(degrees, F.lit(1)), F.lit(len(T95))).cast("int"))
    return F.when(degrees <= len(T95), table).otherwise(series)


def mean_ci(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: n, mean and half width of the 95% interval by Student's t; 0 with one value."""
    g = df.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("s"))
    return g.select(key, "n", "mean", F.when(F.col("n") >= 2, t95(F.col("n") - 1) * F.col("s") / F.sqrt("n")).otherwise(0.0).alias("ci"))


def elementwise_audit(df: DataFrame, a: str, b: str) -> DataFrame:
    """Absolute difference of probabilities (max, mean, std) and Pearson correlation of two log-probability columns of tokens."""
    pa, pb = F.exp(F.col(a)), F.exp(F.col(b))
    d = F.abs(pa - pb)
    return df.agg(F.max(d).alias("diff_max"), F.avg(d).alias("diff_mean"), F.stddev_samp(d).alias("diff_std"), F.corr(pa, pb).alias("pearson"))

"""Data contracts: rules as boolean columns, reports of the rows that fail, checks across rows and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.functions.text import sampling_seed
from lathe.operators.rows import numbered


def trace_rules(max_prompt: int = 4096, max_response: int = 8192, width: int = 2, tolerance: float = 5e-4, mass: float = 2.5e-3) -> dict[str, Column]:
    """Rules of one distillation trace; a rule that is false or null fails."""
    c = F.col
    n = F.size("response_token_ids")
    flat = lambda a: F.flatten(c(a))
    return {
        "question_hash": c("question_sha256") == F.sha2(c("question_text"), 256),
        "sampling_seed": c("sampling_seed") == sampling_seed(c("global_seed"), c("split"), c("source_uid"), c("sample_index")),
        "grade_range": (~F.isnan("strict_grade")) & c("strict_grade").between(0.0, 1.0),
        "grade_agrees": c("strict_correct") == (c("strict_grade") > 0.5),
        "prompt_length": (c("prompt_length") == F.size("prompt_token_ids")) & (c("prompt_length") <= max_prompt),
        "response_length": (c("response_length") == n) & (n <= max_response),
        "input_is_prompt_and_response": c("input_ids") == F.concat("prompt_token_ids", "response_token_ids"),
        "mask_shape": c("response_mask") == F.concat(F.array_repeat(F.lit(0), F.size("prompt_token_ids")), F.array_repeat(F.lit(1), n)),
        "samples_are_response": c("sampled_token_ids") == c("response_token_ids"),
        "targets_per_token": (F.size("teacher_topk_token_ids") == n) & (F.size("teacher_topk_logprobs") == n) & (F.size("sampled_token_logprobs") == n),
        "target_width": F.forall("teacher_topk_token_ids", lambda x: F.size(x) == width) & F.forall("teacher_topk_logprobs", lambda x: F.size(x) == width),
        "target_unique": F.forall("teacher_topk_token_ids", lambda x: F.size(F.array_distinct(x)) == F.size(x)),
        "vocabulary": F.forall(flat("teacher_topk_token_ids"), lambda t: (t >= 0) & (t < c("tokenizer_vocab_size"))) & F.forall("input_ids", lambda t: (t >= 0) & (t < c("tokenizer_vocab_size"))),
        "rank_order": F.forall("teacher_topk_logprobs", lambda x: F.sort_array(x, asc=False) == x),
        "logprobs_finite": F.forall(flat("teacher_topk_logprobs"), lambda v: (v <= tolerance) & ~F.isnan(v)),
        "mass": F.forall("teacher_topk_logprobs", lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v.cast("double"))) <= 1 + mass),
        "length_flag": c("reached_max_response_tokens") == (n >= max_response),
    }


def failures(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """``key, rule`` for each rule that a row fails; one pass, nothing is shuffled."""
    named = F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for name, cond in rules.items()))
    return df.select(key, F.explode(F.array_compact(named)).alias("rule"))


def incomplete_samples(df: DataFrame, uid: str, index: str, n: int) -> DataFrame:
    """Prompts whose sample indices aren't exactly 0..n-1, each once."""
    g = df.groupBy(uid).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(index).alias("distinct"), F.min(index).alias("low"), F.max(index).alias("high"))
    return g.where(~((F.col("rows") == n) & (F.col("distinct") == n) & (F.col("low") == 0) & (F.col("high") == n - 1)))


def overlap(a: DataFrame, b: DataFrame, key: Column) -> DataFrame:
    """Distinct keys in both tables."""
    return a.select(key.alias("key")).where("key is not null").intersect(b.select(key.alias("key")))


def differences(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``key, side``: missing from found, or extra in it."""
    return expected.select(key).distinct().join(found, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(found.select(key).distinct().join(expected, key, "left_anti").withColumn("side", F.lit("extra")))


def same_schema(df: DataFrame, expected) -> None:
    if [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in expected]:
        raise ValueError(f"schema differs: {df.schema.simpleString()} is not {expected.simpleString()}")


def gates(metrics: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """``name, value, rule, limit, passed`` for every limit; limits: name -> ("<=" or ">=", limit). A metric that is missing or not a number fails."""
    table = metrics.sparkSession.createDataFrame([(n, r, float(x)) for n, (r, x) in limits.items()], "name string, rule string, limit double")
    met = F.when(F.col("rule") == "<=", F.col("value") <= F.col("limit")).otherwise(F.col("value") >= F.col("limit"))
    return table.join(metrics.select("name", "value"), "name", "left").withColumn("passed", F.coalesce(met & ~F.isnan("value"), F.lit(False)))


def overlay_report(source: DataFrame, overlay: DataFrame, key: str, same: list[str]) -> DataFrame:
    """``check, failures`` of an overlay of a source table: missing, extra and repeated keys, and rows whose ``same`` columns differ."""
    theirs = overlay.select(key, *(F.col(c).alias(f"_{c}") for c in same), F.lit(True).alias("_there"))
    both = source.select(key, *same, F.lit(True).alias("_here")).join(theirs, key, "full")
    fail = {"missing": F.col("_there").isNull(), "extra": F.col("_here").isNull()}
    fail |= {f"{c}_differs": F.col("_there") & F.col("_here") & ~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same}
    counts = both.agg(*(F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias(n) for n, c in fail.items()))
    twice = overlay.groupBy(key).count().where("count > 1").agg(F.count(F.lit(1)).alias("failures")).select(F.lit("repeated").alias("check"), "failures")
    listed = F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).cast("long").alias("failures")) for n in fail))).alias("x")
    return counts.select(listed).select("x.*").unionByName(twice)


def index_mismatches(df: DataFrame, order: list, index: str) -> DataFrame:
    """Rows whose ``index`` isn't their position in the order, with the position as ``expected``."""
    return numbered(df, order, "expected").where(~F.col(index).eqNullSafe(F.col("expected")))


def checked_config(config: dict, rules: dict[str, tuple]) -> dict:
    """``config`` if every rule holds, else an error that names all that fail. rules: key -> (least, most) for numbers or a set of allowed values; keys without a rule raise."""
    wrong = [f"unknown {k}" for k in config if k not in rules]
    for key, rule in rules.items():
        value = config.get(key)
        if isinstance(rule, (set, frozenset)):
            if value not in rule:
                wrong.append(f"{key} is {value!r}, not one of {sorted(map(repr, rule))}")
        elif not isinstance(value, (int, float)) or not rule[0] <= value <= rule[1]:
            wrong.append(f"{key} is {value!r}, not within {rule}")
    if wrong:
        raise ValueError("; ".join(wrong))
    return config

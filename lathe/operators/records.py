"""Prompt records from raw question tables: nested structs, instructions, ground truths, typed content."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.functions import text as T
from lathe.operators.rows import numbered

# Instructions that records end with.
STEP_BY_STEP = 'Let\'s think step by step and output the final answer after "####".'
BOXED = "Please output the final answer within \\boxed{}."


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def record(df: DataFrame, data_source: str | Column, messages: list[Column], truth: Column, split: str | Column, order: list[str], ability: str = "math", style: str = "rule", extra: dict[str, Column] | None = None) -> DataFrame:
    """``data_source, prompt, ability, reward_model, extra_info``; the index counts rows in the declared order."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    info = F.struct(lit(split).alias("split"), F.col("_n").alias("index"), *(c.alias(k) for k, c in (extra or {}).items()))
    return numbered(df, order).select(
        lit(data_source).alias("data_source"),
        F.array(*messages).alias("prompt"),
        F.lit(ability).alias("ability"),
        F.struct(F.lit(style).alias("style"), truth.alias("ground_truth")).alias("reward_model"),
        info.alias("extra_info"),
    )


def word_problems(df: DataFrame, split: str, order: list[str]) -> DataFrame:
    """question, answer ending in ``#### n`` -> records with the bare number as truth."""
    content = F.concat_ws(" ", "question", F.lit(STEP_BY_STEP))
    return record(df, "openai/gsm8k", [message("user", content)], T.hash_answer(F.col("answer")), split, order, extra={"answer": F.col("answer"), "question": F.col("question")})


def boxed_problems(df: DataFrame, source: str, split: str, order: list[str]) -> DataFrame:
    """problem, solution with a box -> records with the boxed answer as truth."""
    return record(df, source, [message("user", T.with_suffix(F.col("problem"), BOXED))], T.boxed(F.col("solution")), split, order)


def contest_problems(df: DataFrame, source: str, order: list[str]) -> DataFrame:
    """problem, answer, problem_type (an array or null) -> records whose truth is a string; types are joined, ``unknown`` without."""
    kind = F.coalesce(F.array_join("problem_type", ", "), F.lit("unknown"))
    return record(df, source, [message("user", T.with_suffix(F.col("problem"), BOXED))], F.col("answer").cast("string"), "test", order, extra={"problem_type": kind})


def sentence_completions(df: DataFrame, source: str, split: str, order: list[str]) -> DataFrame:
    """activity_label, ctx_a, ctx_b, endings, label -> cleaned contexts and choices; rows without a label go."""
    labelled = df.where(F.length("label") > 0)
    context = F.concat(F.col("activity_label"), F.lit(": "), F.col("ctx_a"), F.lit(" "), T.capitalised(F.col("ctx_b")))
    out = record(labelled, source, [message("user", T.clean_completion(context))], F.col("label").cast("int"), split, order, ability="nlp", style="model", extra={"choices": F.transform("endings", T.clean_completion)})
    return out


def search_questions(df: DataFrame, system: str, prefix: str, split: str, order: list[str]) -> DataFrame:
    """question, golden_answers, reward_model -> system and user messages; the truth is the reward model's, else the golden answers."""
    truth = F.coalesce(F.col("reward_model")["ground_truth"], F.col("golden_answers"))
    source = F.concat(F.lit("searchR1_"), F.coalesce(F.col("data_source"), F.lit("")))
    return record(df, source, [message("system", F.lit(system)), message("user", F.concat(F.lit(prefix.rstrip("\n")), "question"))], truth, split, order, ability="fact-reasoning", extra={"need_tools_kwargs": F.lit(True), "question": F.col("question")})


def with_tools(df: DataFrame, tool: str, kwargs: dict[str, Column]) -> DataFrame:
    """Adds ``tools_kwargs`` and ``need_tools_kwargs`` for one tool."""
    made = F.create_map(F.lit(tool), F.struct(F.create_map(*(x for k, c in kwargs.items() for x in (F.lit(k), c.cast("string")))).alias("create_kwargs")))
    return df.withColumns({"tools_kwargs": made, "need_tools_kwargs": F.lit(True)})


def info_defaults(df: DataFrame, info: str = "extra_info") -> DataFrame:
    """index 0 and empty tool arguments where the record's map lacks them."""
    m = F.coalesce(F.col(info), F.create_map().cast("map<string,string>"))
    return df.withColumns({"index": F.coalesce(F.try_element_at(m, F.lit("index")).cast("long"), F.lit(0)), "tools_kwargs": F.coalesce(F.try_element_at(m, F.lit("tools_kwargs")), F.lit("{}"))})


def expand_placeholders(content: Column, marks: tuple[str, ...] = ("<image>", "<video>")) -> Column:
    """array<struct<type, text>>: text pieces and typed marks in order; empty pieces go."""
    tagged = reduce(lambda c, m: F.replace(c, F.lit(m), F.lit(f"\x01{m}\x01")), marks, content)
    pieces = F.filter(F.split(tagged, "\x01"), lambda p: p != "")
    kind = lambda p: reduce(lambda c, m: c.when(p == m, m.strip("<>")), marks[1:], F.when(p == marks[0], marks[0].strip("<>"))).otherwise("text")
    return F.transform(pieces, lambda p: F.struct(kind(p).alias("type"), F.when(kind(p) == "text", p).alias("text")))


def count_marks(content: Column, mark: str) -> Column:
    return F.size(F.split(content, mark, -1)) - 1


def set_split(df: DataFrame, split: str, info: str = "extra_info") -> DataFrame:
    """The record's nested split field set."""
    return df.withColumn(info, F.col(info).withField("split", F.lit(split)))


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    """Columns renamed with the prefix, unless they have it."""
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if not c.startswith(prefix)})


def passages(column: Column) -> Column:
    """Retrieved passages (title line, then text) as numbered paragraphs."""
    one = lambda p, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit(" (Title: "), F.substring_index(p, "\n", 1), F.lit(")\n"), F.trim(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p))))
    return F.regexp_replace(F.array_join(F.transform(column, one), "\n\n"), r"^\s+|\s+$", "")

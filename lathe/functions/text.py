"""Text functions: normalisers, answer extraction, question keys; regular expressions stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed substitutions of the question key, in the order in which they apply (Java regular expressions).
QUESTION_STEPS = [
    (r"\s+", " "),
    (r"\$\$?|\\\(|\\\)|\\\[|\\\]", " "),
    (r"\\left\s*|\\right\s*", ""),
    (r"\\[dt]frac", r"\\frac"),
    (r"\\(?:qquad|quad|[,;:!])", " "),
    (r"\\(?:mathrm|mathbf|mathit|text|textbf|operatorname)\s*\{([^{}]*)\}", "$1"),
    (r"([_^])\{(\w)\}", "$1$2"),
    (r"\\cdot\b", "*"),
    (r"\\times\b", "*"),
    (r"""[.,;:!?'"`]""", ""),
    (r"\s+", " "),
]


def chain(col: Column, steps) -> Column:
    return reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, col)


def question_key(text: Column) -> Column:
    """One key for spellings of a question: case, white space, math delimiters and punctuation don't count."""
    return F.trim(chain(F.trim(F.lower(text)), QUESTION_STEPS))


def qa_normal(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    bare = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the)\b", " "), r"\s+", " "))


def exact_match(prediction: Column, golds: Column) -> Column:
    p = qa_normal(prediction)
    return F.exists(golds, lambda g: qa_normal(g) == p)


def contains_match(prediction: Column, golds: Column) -> Column:
    p = qa_normal(prediction)
    return F.exists(golds, lambda g: p.contains(qa_normal(g)))


def last_answer(text: Column) -> Column:
    """Inside of the last <answer> element, trimmed; null without one."""
    return F.trim(F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1)), F.lit(-1)))


def hash_answer(text: Column) -> Column:
    """Number of the last ``#### n`` within the last 300 characters, without , and $; null without one."""
    found = F.try_element_at(F.regexp_extract_all(F.right(text, F.lit(300)), F.lit(r"#### (-?[0-9.,]+)"), F.lit(1)), F.lit(-1))
    return F.regexp_replace(found, r"[,$]", "")


def last_number(text: Column) -> Column:
    """Last number within the last 300 characters that isn't a bare point; the first such token where all are; null without one."""
    found = F.regexp_extract_all(F.right(text, F.lit(300)), F.lit(r"(-?[0-9.,]+)"), F.lit(1))
    real = F.filter(found, lambda x: ~x.isin("", "."))
    return F.coalesce(F.try_element_at(real, F.lit(-1)), F.try_element_at(found, F.lit(1)))


def boxed(text: Column) -> Column:
    """Inside of the last ``\\boxed{...}`` with balanced braces, null where there is none or it never closes."""
    rest = F.when(F.instr(text, r"\boxed{") > 0, F.substring_index(text, r"\boxed{", -1))
    start = F.struct(F.lit(1).alias("depth"), F.lit("").alias("out"))

    def step(acc, c):
        depth = acc["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        done = acc["depth"] == 0
        return F.struct(F.when(done, F.lit(0)).otherwise(depth).alias("depth"), F.when(done | (depth == 0), acc["out"]).otherwise(F.concat(acc["out"], c)).alias("out"))

    return F.aggregate(F.split(rest, ""), start, step, lambda acc: F.when(acc["depth"] == 0, acc["out"]))


def with_suffix(text: Column, suffix: str) -> Column:
    """Trimmed text that ends with the instruction, added after a space unless it is there."""
    t = F.trim(text)
    return F.when(t.endswith(suffix), t).otherwise(F.concat_ws(" ", t, F.lit(suffix)))


def clean_completion(text: Column) -> Column:
    """Strip, `` [title]`` to ``. ``, other bracketed notes out, double spaces once."""
    t = F.regexp_replace(F.replace(F.trim(text), F.lit(" [title]"), F.lit(". ")), r"\[.*?\]", "")
    return F.replace(t, F.lit("  "), F.lit(" "))


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def metric_key(key: Column) -> Column:
    """Key that a metric store accepts."""
    return F.regexp_replace(F.regexp_replace(F.replace(key, F.lit("@"), F.lit("_at_")), r"/+", "/"), r"[^A-Za-z0-9_\-. /]", "_")


def sampling_seed(*parts: Column) -> Column:
    """First 8 bytes of the SHA-256 of the parts joined by NUL, modulo 2**31 - 1; 0 becomes 1."""
    joined = F.concat_ws("\x00", *(p.cast("string") for p in parts))
    seed = F.pmod(F.conv(F.substring(F.sha2(joined, 256), 1, 16), 16, 10).cast("decimal(20,0)"), F.lit(2**31 - 1)).cast("long")
    return F.when(seed == 0, F.lit(1)).otherwise(seed)


def hash_rank(seed: int, key: Column) -> Column:
    """Order key of a reproducible shuffle: SHA-256 of seed and key."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def tool_calls(text: Column) -> Column:
    """array<struct<name, arguments>> of the JSON inside <tool_call> elements; broken JSON is left out."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))
    calls = F.transform(found, lambda x: F.struct(F.get_json_object(x, "$.name").alias("name"), F.get_json_object(x, "$.arguments").alias("arguments")))
    return F.filter(calls, lambda c: c["name"].isNotNull())


def mask_pattern(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "*")

"""Queries over rule scorers, balancing and contracts: texts are made from the tables so that every branch is met."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathe.functions import answers, tools
from lathe.functions import text as T
from lathe.operators import balance, contracts, rows
from lathe.plans.adapters import table
from lathe.plans.registry import query

PARTS = "SELECT p_partkey AS id, p_name AS name, p_size AS size FROM part"


def parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))


@query("score_gsm8k", f"WITH p AS ({PARTS}) SELECT id, CASE WHEN id % 3 = 0 THEN 0.0 WHEN id % 3 = 1 THEN CASE WHEN size = id % 50 THEN 1.0 ELSE 0.1 END ELSE CASE WHEN CAST(size * 1000 AS VARCHAR) = CAST(size * 1000 AS VARCHAR) THEN 1.0 END END AS score FROM p")
def score_gsm8k(spark, sf_dir):
    p = parts(spark, sf_dir)
    size = F.col("size").cast("string")
    text = F.when(F.col("id") % 3 == 0, F.lit("no answer")).when(F.col("id") % 3 == 1, F.concat(F.lit("#### 7 then #### "), size)).otherwise(F.concat(F.lit("so #### "), size, F.lit(",000")))
    gold = F.when(F.col("id") % 3 == 1, (F.col("id") % 50).cast("string")).otherwise((F.col("size") * 1000).cast("string"))
    return p.select("id", answers.gsm8k_score(text, gold, format_score=0.1).alias("score"))


@query("score_boxed_math", f"WITH p AS ({PARTS}) SELECT id, CASE id % 4 WHEN 0 THEN '\\frac{{' || size || '}}{{2}}' WHEN 1 THEN CAST(size AS VARCHAR) WHEN 2 THEN 'x^{{' || size || '}}' END AS pred, CASE WHEN id % 4 = 0 AND size < 10 OR id % 4 = 1 THEN 1.0 ELSE 0.0 END AS score FROM p")
def score_boxed_math(spark, sf_dir):
    p = parts(spark, sf_dir)
    size, kind = F.col("size").cast("string"), F.col("id") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit("first \\boxed{1} then \\boxed{\\frac{"), size, F.lit("}{2}} done")))
        .when(kind == 1, F.concat(F.lit("\\boxed{"), size, F.lit("}")))
        .when(kind == 2, F.concat(F.lit("\\boxed{x^{"), size, F.lit("}}")))
        .otherwise(F.concat(F.lit("\\boxed{{"), size, F.lit("}")))
    )
    gold = F.when(kind == 0, F.concat(F.lit("\\dfrac"), size, F.lit("2"))).when(kind == 1, F.concat(F.lit("n = "), size)).otherwise(F.lit("y"))
    return p.select("id", T.boxed(text).alias("pred"), answers.math_score(text, gold).alias("score"))


@query("score_dapo_answer", f"WITH p AS ({PARTS}) SELECT id, CASE WHEN id % 2 = 0 THEN 1.0 ELSE -1.0 END AS score, CASE WHEN id % 2 = 0 THEN CAST(size * 1000 AS VARCHAR) ELSE '[INVALID]' END AS pred FROM p")
def score_dapo_answer(spark, sf_dir):
    p = parts(spark, sf_dir)
    text = F.when(F.col("id") % 2 == 0, F.concat(F.lit("Answer: 3\nAnswer: x = $"), F.col("size").cast("string"), F.lit(",000$ dollars"))).otherwise(F.col("name"))
    return p.withColumn("s", answers.dapo_score(text, (F.col("size") * 1000).cast("string"))).select("id", "s.score", "s.pred")


@query("score_search_qa", f"WITH p AS ({PARTS}) SELECT id, CASE WHEN id % 3 = 0 THEN 0.0 WHEN id % 3 = 1 THEN 1.0 ELSE 0.2 END AS score FROM p")
def score_search_qa(spark, sf_dir):
    p = parts(spark, sf_dir)
    text = F.when(F.col("id") % 3 == 0, F.col("name")).when(F.col("id") % 3 == 1, F.concat(F.lit("<answer>x</answer> <answer>The "), F.upper("name"), F.lit("!</answer>"))).otherwise(F.lit("<answer>nothing</answer>"))
    return p.select("id", answers.qa_score(text, F.array(F.lit("other"), F.col("name")), format_score=0.2).alias("score"))


@query("score_dispatch", f"WITH p AS ({PARTS}) SELECT id, CASE id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 ELSE -1.0 END AS score FROM p")
def score_dispatch(spark, sf_dir):
    p = parts(spark, sf_dir)
    source = F.element_at(F.array(F.lit("openai/gsm8k"), F.lit("searchqa"), F.lit("dapo")), (F.col("id") % 3 + 1).cast("int"))
    size = F.col("size").cast("string")
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit("#### "), size)).when(F.col("id") % 3 == 1, F.concat(F.lit("<answer>"), size, F.lit("</answer>"))).otherwise(F.lit("none"))
    return p.select("id", answers.score(source, text, size).alias("score"))


@query("score_format_frame", f"WITH p AS ({PARTS}) SELECT id, CASE WHEN id % 3 = 2 THEN 0.0 ELSE 1.0 END AS score FROM p")
def score_format_frame(spark, sf_dir):
    p = parts(spark, sf_dir)
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit("<think>"), F.col("name"), F.lit("</think>\n<response>ok</response>"))).when(F.col("id") % 3 == 1, F.lit("<think>\n</think>\n<tool_call>\n{}\n</tool_call>")).otherwise(F.lit("<response>a</response><response>b</response>"))
    gold = F.when(F.col("id") % 3 == 1, F.lit("<tool_call>")).otherwise(F.lit("<response>"))
    return p.select("id", answers.format_reward(text, gold).alias("score"))


@query("score_tool_calls", f"WITH p AS ({PARTS}) SELECT id, round(CASE id % 4 WHEN 0 THEN 3.0 WHEN 1 THEN 6.0 * (1.0 + 1.0 + 0.0) / 3.0 - 3.0 WHEN 2 THEN -3.0 ELSE -3.0 END, 6) AS score FROM p")
def score_tool_calls(spark, sf_dir):
    p = parts(spark, sf_dir)
    want = F.concat(F.lit('[{"name": "find", "parameters": {"q": '), F.col("size").cast("string"), F.lit("}}]"))
    have = F.when(F.col("id") % 4 == 0, want).when(F.col("id") % 4 == 1, F.lit('[{"name": "find", "parameters": {"q": -1}}]')).when(F.col("id") % 4 == 2, F.lit('[{"name": "get", "parameters": {}}]')).otherwise(F.col("name"))
    return p.select("id", F.round(tools.tool_score(want, have), 6).alias("score"))


@query("tool_call_parse", f"WITH p AS ({PARTS}) SELECT id, CASE WHEN id % 2 = 0 THEN 'find,get' ELSE '' END AS names FROM p")
def tool_call_parse(spark, sf_dir):
    p = parts(spark, sf_dir)
    text = F.when(F.col("id") % 2 == 0, F.concat(F.lit('<tool_call>\n{"name": "find", "arguments": {"q": "'), F.col("name"), F.lit('"}}\n</tool_call> and <tool_call>{"name": "get"}</tool_call><tool_call>{broken</tool_call>'))).otherwise(F.col("name"))
    return p.select("id", F.array_join(F.transform(T.tool_calls(text), lambda c: c["name"]), ",").alias("names"))


@query("trace_contract", f"""WITH p AS ({PARTS}), r AS (SELECT id, CASE id % 5 WHEN 1 THEN 'grade_agrees' WHEN 2 THEN 'rank_order' WHEN 3 THEN 'mask_shape' WHEN 4 THEN 'vocabulary' END AS rule FROM p) SELECT * FROM r WHERE rule IS NOT NULL""")
def trace_contract(spark, sf_dir):
    p = parts(spark, sf_dir)
    kind = F.col("id") % 5
    ints = lambda *xs: F.array(*(F.lit(x).cast("int") for x in xs))
    rank = lambda a, b: F.array(F.array(F.lit(a), F.lit(b)), F.array(F.lit(-0.5), F.lit(-2.5)))
    top = F.array(ints(5, 6), F.array(F.lit(7), F.when(kind == 4, F.lit(1000)).otherwise(F.lit(8)))).alias("t")
    traces = p.select(
        "id",
        F.col("name").alias("question_text"),
        F.sha2("name", 256).alias("question_sha256"),
        F.lit(7).alias("global_seed"),
        F.lit("train").alias("split"),
        F.col("id").cast("string").alias("source_uid"),
        F.lit(0).alias("sample_index"),
        F.when(F.col("size") > 25, 1.0).otherwise(0.0).alias("strict_grade"),
        F.when(kind == 1, F.col("size") <= 25).otherwise(F.col("size") > 25).alias("strict_correct"),
        ints(1, 2).alias("prompt_token_ids"),
        ints(5, 7).alias("response_token_ids"),
        ints(1, 2, 5, 7).alias("input_ids"),
        F.when(kind == 3, ints(0, 1, 1, 1)).otherwise(ints(0, 0, 1, 1)).alias("response_mask"),
        ints(5, 7).alias("sampled_token_ids"),
        F.array(F.lit(-0.1), F.lit(-0.2)).alias("sampled_token_logprobs"),
        top.alias("teacher_topk_token_ids"),
        F.when(kind == 2, rank(-3.0, -0.2)).otherwise(rank(-0.2, -3.0)).alias("teacher_topk_logprobs"),
        F.lit(2).alias("prompt_length"),
        F.lit(2).alias("response_length"),
        F.lit(100).alias("tokenizer_vocab_size"),
        F.lit(False).alias("reached_max_response_tokens"),
    )
    seeded = traces.withColumn("sampling_seed", T.sampling_seed(F.col("global_seed"), F.col("split"), F.col("source_uid"), F.col("sample_index")))
    return contracts.failures(seeded, contracts.trace_rules(), "id")


@query("incomplete_samples", "WITH s AS (SELECT l_orderkey AS uid, l_linenumber AS i FROM lineitem), g AS (SELECT uid, count(*) AS r, count(DISTINCT i) AS d, min(i) AS lo, max(i) AS hi FROM s GROUP BY uid) SELECT uid FROM g WHERE NOT (r = 4 AND d = 4 AND lo = 0 AND hi = 3)")
def incomplete_samples(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("uid"), F.col("l_linenumber").alias("i"))
    return contracts.incomplete_samples(s, "uid", "i", 4).select("uid")


@query("balanced_partitions")
def balanced_partitions(spark, sf_dir):
    c = table(spark, sf_dir, "documents").where("n_chars > 0").select("doc_id", F.col("n_chars").alias("length"))
    return balance.assign(c, "doc_id", "length", 8).groupBy("part").agg(F.count(F.lit(1)).alias("docs"), F.sum("length").alias("chars"))


@query("weighted_resample")
def weighted_resample(spark, sf_dir):
    p = parts(spark, sf_dir)
    return rows.weighted_resample(p, "id", F.pow(F.col("size").cast("double"), F.lit(2.0)) + 1e-8, p.count(), 3)


# Plain counts and joins of the relational kind, which come with the engine.
@query("revenue_by_flag", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def revenue_by_flag(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("revenue_by_nation", "SELECT n_name, round(sum(l_extendedprice), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def revenue_by_nation(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))

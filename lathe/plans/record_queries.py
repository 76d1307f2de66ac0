"""Queries over record builders, evaluation, replay pools, folds and remaining corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathe.functions import masked, tools
from lathe.functions import text as T
from lathe.operators import correction, evaluation, losses, records, replay, rows
from lathe.plans.adapters import SAMPLES, TOKENS, samples, table, trajectories
from lathe.plans.registry import query
from lathe.plans.training_queries import off_grid, rounded


@query("records_word_problems", "SELECT 'openai/gsm8k' AS data_source, p_name || ' Let''s think step by step and output the final answer after \"####\".' AS content, CAST(p_size AS VARCHAR) AS truth, 'train' AS split, p_partkey AS idx FROM part")
def word_problems(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("question"), F.concat(F.lit("so 1+1\n#### "), F.col("p_size").cast("string")).alias("answer"))
    r = records.word_problems(p, "train", ["p_partkey"])
    return r.select("data_source", F.element_at("prompt", -1)["content"].alias("content"), F.col("reward_model.ground_truth").alias("truth"), F.col("extra_info.split").alias("split"), F.col("extra_info.index").alias("idx"))


@query("records_boxed_problems", "SELECT p_name || ' Please output the final answer within \\boxed{}.' AS content, '\\frac{' || p_size || '}{3}' AS truth, p_partkey AS idx FROM part")
def boxed_problems(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("problem"), F.concat(F.lit("thus $\\boxed{\\frac{"), F.col("p_size").cast("string"), F.lit("}{3}}$")).alias("solution"))
    r = records.boxed_problems(p, "math", "train", ["p_partkey"])
    return r.select(F.col("prompt")[0]["content"].alias("content"), F.col("reward_model.ground_truth").alias("truth"), F.col("extra_info.index").alias("idx"))


@query("records_contest_problems", "SELECT CAST(p_size AS VARCHAR) AS truth, CASE WHEN p_size % 2 = 0 THEN p_brand || ', ' || p_type ELSE 'unknown' END AS kind FROM part")
def contest_problems(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("problem"), F.col("p_size").alias("answer"), F.when(F.col("p_size") % 2 == 0, F.array("p_brand", "p_type")).alias("problem_type"))
    r = records.contest_problems(p, "aime", ["p_partkey"])
    return r.select(F.col("reward_model.ground_truth").alias("truth"), F.col("extra_info.problem_type").alias("kind"))


@query("records_sentence_completions", "SELECT p_brand || ': ' || p_name || ' ' || upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS content, p_size AS truth, 'a. ' || p_name AS choice FROM part WHERE p_size > 9")
def sentence_completions(spark, sf_dir):
    label = F.when(F.col("p_size") > 9, F.col("p_size").cast("string")).otherwise("")
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("activity_label"), F.col("p_name").alias("ctx_a"), F.col("p_type").alias("ctx_b"), F.array(F.concat(F.lit("a [title]"), "p_name", F.lit("[x]"))).alias("endings"), label.alias("label"))
    r = records.sentence_completions(p, "hellaswag", "train", ["p_partkey"])
    return r.select(F.col("prompt")[0]["content"].alias("content"), F.col("reward_model.ground_truth").alias("truth"), F.col("extra_info.choices")[0].alias("choice"))


@query("records_search_questions", "SELECT 'searchR1_nq' AS data_source, 'Q: ' || p_name AS content, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END AS truth FROM part")
def search_questions(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("question"), F.lit("nq").alias("data_source"), F.array("p_type").alias("golden_answers"), F.struct(F.when(F.col("p_size") % 2 == 0, F.array("p_brand")).alias("ground_truth")).alias("reward_model"))
    r = records.search_questions(p, "You answer.", "Q: \n", "test", ["p_partkey"])
    return r.select("data_source", F.element_at("prompt", -1)["content"].alias("content"), F.col("reward_model.ground_truth")[0].alias("truth"))


@query("placeholder_expansion", "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'image,text,video' ELSE 'text' END AS kinds, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS images FROM part")
def placeholder_expansion(spark, sf_dir):
    content = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("<image>"), "p_name", F.lit("<video>"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(F.transform(records.expand_placeholders(content), lambda x: x["type"]), ",").alias("kinds"), records.count_marks(content, "<image>").alias("images"))


@query("passages_to_text", "SELECT p_partkey AS id, 'Doc 1 (Title: ' || p_name || ')' || chr(10) || p_type || chr(10) || chr(10) || 'Doc 2 (Title: ' || p_brand || ')' AS text FROM part")
def passages_to_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), records.passages(F.array(F.concat_ws("\n", "p_name", "p_type"), F.col("p_brand"))).alias("text"))


@query("fold_unfold_round_trip", "SELECT event_id, value FROM events WHERE event_id < (SELECT count(*) // 4 * 4 FROM events)")
def fold_unfold(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "value")
    n = e.count() // 4 * 4
    folded = e.where(F.col("event_id") < n).groupBy(F.floor(F.col("event_id") / 4).alias("row")).agg(F.sort_array(F.collect_list(F.struct("event_id", "value"))).alias("x"))
    return folded.select(F.explode("x").alias("x")).select("x.*")


@query("unfold_column_chunks", "SELECT vec_id, CAST(c AS INTEGER) AS chunk, round(list_sum(list_transform(list_slice(embedding, CAST(c * 16 + 1 AS INTEGER), CAST(c * 16 + 16 AS INTEGER)), lambda x: CAST(x AS DOUBLE))), 5) AS s FROM (SELECT *, unnest(range(4)) AS c FROM embeddings)")
def unfold_chunks(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: F.slice("embedding", c * 16 + 1, F.lit(16)))).alias("chunk", "part"))
    return e.select("vec_id", "chunk", F.round(masked.total(F.transform("part", lambda x: x.cast("double"))), 5).alias("s"))


@query("column_chunk_quantiles", "SELECT l_linenumber, count(*) AS n, quantile_disc(l_quantity, 0.5) AS median FROM lineitem GROUP BY 1")
def chunk_quantiles(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.expr("percentile_disc(0.5) within group (order by l_quantity)").alias("median"))


@query("bootstrap_best_worst")
def bootstrap_best_worst(spark, sf_dir):
    out = evaluation.bootstrap(samples(spark, sf_dir), ["uid"], "score", "sample_index", 2)
    return out.agg(F.round(F.avg("best_mean"), 6).alias("best"), F.round(F.avg("worst_mean"), 6).alias("worst"), F.count(F.lit(1)).alias("prompts"))


@query("leader_answer_classes", f"WITH {SAMPLES}, s AS (SELECT uid, sample_index, acc, CASE WHEN pred = 2 THEN NULL ELSE CAST(pred AS VARCHAR) END AS p FROM samples) SELECT uid, sample_index, CASE WHEN p IS NOT NULL THEN first_value(p) OVER (PARTITION BY uid, acc, p ORDER BY sample_index) END AS answer_class FROM s")
def leader_classes(spark, sf_dir):
    s = samples(spark, sf_dir).select("uid", "sample_index", "acc", F.when(F.col("pred") == 2, F.lit("  ")).otherwise(F.col("pred").cast("string")).alias("pred"))
    return evaluation.leader_classes(s, "uid", "sample_index", "pred", "acc").select("uid", "sample_index", "answer_class")


@query("subset_monte_carlo", f"WITH {SAMPLES} SELECT uid, sample_index FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY sha256('3:' || CAST(uid AS VARCHAR) || chr(0) || '2' || chr(0) || CAST(sample_index AS VARCHAR))) AS r FROM samples) WHERE r <= 2")
def subset_monte_carlo(spark, sf_dir):
    return evaluation.subset(samples(spark, sf_dir), "uid", "sample_index", 2, "monte_carlo", seed=3).select("uid", "sample_index")


@query("subset_full_only", f"WITH {SAMPLES}, g AS (SELECT uid FROM samples GROUP BY uid HAVING count(*) = 4) SELECT s.uid, sample_index FROM samples s JOIN g ON s.uid = g.uid")
def subset_full_only(spark, sf_dir):
    return evaluation.subset(samples(spark, sf_dir), "uid", "sample_index", 4, "full_only").select("uid", "sample_index")


@query("topk_residual_entropy", "WITH v AS (SELECT event_id, [0.5, 0.25, (event_id % 3) * 0.05] AS p FROM events), e AS (SELECT event_id, list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN -x * ln(x) ELSE 0.0 END)) AS h, 1 - list_sum(p) AS r FROM v) SELECT event_id, round(h - r * ln(r), 6) AS entropy FROM e")
def topk_residual_entropy(spark, sf_dir):
    p = F.array(F.ln(F.lit(0.5)), F.ln(F.lit(0.25)), F.when(F.col("event_id") % 3 == 0, F.lit(float("-inf"))).otherwise(F.ln((F.col("event_id") % 3) * 0.05)))
    return table(spark, sf_dir, "events").select("event_id", F.round(evaluation.topk_entropy(p), 6).alias("entropy"))


@query("predictive_entropy", off_grid(f"WITH {TOKENS}, s AS (SELECT uid, sid, sum(-old_lp) AS s, count(*) AS n FROM tok WHERE mask = 1 GROUP BY uid, sid), q AS (SELECT uid, avg(s / n) AS q FROM s GROUP BY uid) SELECT round((SELECT avg(s / n) FROM s), 6) AS sequence_mean, round((SELECT avg(q) FROM q), 6) AS question_mean, round((SELECT sum(s) / sum(n) FROM s), 6) AS token_mean"))
def predictive_entropy(spark, sf_dir):
    t = trajectories(spark, sf_dir).withColumn("h", F.transform("old_lp", lambda x: -x))
    out = evaluation.predictive_entropy(t, "uid", "h", "mask")
    return rounded(out, *out.columns)


@query("topk_support_overlap", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 WHEN 2 THEN 0.5 ELSE 0.25 END AS overlap FROM events")
def topk_support_overlap(spark, sf_dir):
    base = F.sequence(F.lit(0), F.lit(3))
    return table(spark, sf_dir, "events").select("event_id", evaluation.support_overlap(base, F.transform(base, lambda x: x + (F.col("event_id") % 4).cast("int"))).alias("overlap"))


@query("logprob_array_audit", off_grid(f"WITH {TOKENS}, z AS (SELECT sid, mask, pos - row_number() OVER (PARTITION BY sid, mask ORDER BY pos) AS grp FROM tok), r AS (SELECT sid, max(n) AS n FROM (SELECT sid, count(*) AS n FROM z WHERE mask = 0 GROUP BY sid, grp) GROUP BY sid) SELECT t.sid, round(avg(mask), 6) AS mean, round(avg(CASE WHEN mask = 0 THEN 1.0 ELSE 0.0 END), 6) AS zeros, coalesce(any_value(n), 0) AS zero_run, CAST(0 AS BIGINT) AS bin0, count(*) FILTER (mask = 0) AS bin1, count(*) FILTER (mask = 1) AS bin2 FROM tok t LEFT JOIN r ON t.sid = r.sid GROUP BY t.sid"))
def logprob_array_audit(spark, sf_dir):
    return rounded(evaluation.array_audit(trajectories(spark, sf_dir), "sid", "mask", [0.0, 0.5]), "mean", "zeros")


@query("replay_ring", "SELECT event_type, value > 50 AS positive, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, value > 50 ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5")
def replay_ring(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("positive", F.col("value") > 50)
    return replay.ring(e, ["event_type", "positive"], [F.desc("ts"), F.desc("event_id")], 5).select("event_type", "positive", "event_id")


@query(
    "replay_sample",
    """WITH e AS (SELECT event_id, event_type, value > 50 AS positive, row_number() OVER (PARTITION BY event_type, value > 50 ORDER BY sha256('2:' || CAST(event_id AS VARCHAR)), event_id) AS turn FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY positive ORDER BY turn, event_type) AS n FROM e) SELECT event_id, positive FROM r WHERE n <= CASE WHEN positive THEN 12 ELSE 36 END""",
)
def replay_sample(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("positive", F.col("value") > 50)
    return replay.sample(e, "event_type", "event_id", "positive", 48, 0.25, 2).select("event_id", "positive")


@query("loss_flow_grpo", off_grid(f"WITH {TOKENS}, t AS (SELECT least(greatest(adv, -0.5), 0.5) AS a, exp(new_lp - old_lp) AS r FROM tok) SELECT round(avg(greatest(-a * r, -a * least(greatest(r, 0.8), 1.2))), 6) AS loss FROM t"))
def flow_grpo(spark, sf_dir):
    return rounded(losses.flow_loss(trajectories(spark, sf_dir), 0.2, 0.5), "loss")


@query("loss_bypass_reinforce", off_grid(f"WITH {TOKENS}, t AS (SELECT sid, mask, adv, new_lp, least(exp(least(greatest(new_lp - roll_lp, -20), 20)), 2.0) AS w, sum((new_lp - roll_lp) * mask) OVER (PARTITION BY sid) AS d FROM tok), k AS (SELECT * FROM t WHERE mask = 1 AND -d BETWEEN ln(0.5) AND ln(2.0)) SELECT round(sum(-new_lp * adv * w) / count(*), 6) AS loss FROM k"))
def bypass_reinforce(spark, sf_dir):
    t = trajectories(spark, sf_dir).withColumn("old_lp", F.col("new_lp"))
    t = correction.rejection_mask(correction.importance_weights(t, "token", 2.0), "seq_sum_k1", "0.5_2.0").withColumn("mask", F.col("kept_mask"))
    return rounded(losses.policy_loss(t, "reinforce", weights="is_w").select("loss"), "loss")


@query("distill_topk_kl", off_grid("WITH v AS (SELECT vec_id, list_transform(list_slice(embedding, 1, 8), lambda x: CAST(x AS DOUBLE)) AS a, list_transform(list_slice(embedding, 9, 16), lambda x: CAST(x AS DOUBLE)) AS b FROM embeddings) SELECT vec_id, round(greatest(list_sum(list_transform(list_zip(a, b), lambda x: exp(x[1]) * (x[1] - x[2]))), 0.0), 6) AS kl FROM v"))
def distill_topk(spark, sf_dir):
    part = lambda i: F.transform(F.slice("embedding", i, 8), lambda x: x.cast("double"))
    return rounded(table(spark, sf_dir, "embeddings").select("vec_id", losses.topk_kl(part(1), part(9)).alias("kl")), "kl")


@query("kl_controller", "SELECT event_id AS step, round(0.2 * exp(sum(ln(1 + least(greatest(value / 40.0 - 1, -0.2), 0.2) * 64 / 10000.0)) OVER (ORDER BY event_id)), 7) AS beta FROM events")
def kl_controller(spark, sf_dir):
    # a step's factor doesn't depend on the coefficient so far, so the coefficient is a running product: a sum of logarithms
    factor = F.ln(1 + masked.clamp(F.col("value") / 40.0 - 1, -0.2, 0.2) * 64 / 10000.0)
    out = rows.running_sum(table(spark, sf_dir, "events").select("event_id", "value"), ["event_id"], factor)
    return out.select(F.col("event_id").alias("step"), F.round(0.2 * F.exp("sum"), 7).alias("beta"))


@query("run_log_metrics", "SELECT event_id // 10 AS step, 'm/' || event_type AS name, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def run_log_metrics(spark, sf_dir):
    from lathe.sources.datasets import parse_run_log

    line = F.concat(F.lit("\x1b[36mstep:"), F.floor(F.col("event_id") / 10).cast("string"), F.lit(" - m/"), "event_type", F.lit(":"), F.col("value").cast("string"), F.lit("\x1b[0m"))
    return parse_run_log(table(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), line.alias("value")))


@query("latest_result_per_key", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_result(spark, sf_dir):
    from lathe.sources.datasets import latest_results

    return latest_results(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("token_padding_and_truncation", "SELECT conv_id, turn, list_slice(w || list_transform(range(greatest(0, 6 - len(w))), lambda x: '_'), 1, 6)[6] AS sixth, CASE WHEN len(w) > 4 THEN w[len(w) - 3] ELSE w[1] END AS left_first FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)")
def padding(spark, sf_dir):
    w = F.split("text", " ")
    right = F.slice(F.concat(w, F.array_repeat(F.lit("_"), F.greatest(F.lit(0), F.lit(6) - F.size(w)))), 1, 6)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", right[5].alias("sixth"), masked.truncate(w, 4, "left")[0].alias("left_first"))


@query("weighted_cut_points", "SELECT bucket, count(*) AS n FROM (SELECT CAST(floor((sum(p_size) OVER (ORDER BY p_partkey) - 1) / 1000) AS BIGINT) AS bucket FROM part) GROUP BY bucket")
def weighted_cut_points(spark, sf_dir):
    p = rows.running_sum(table(spark, sf_dir, "part").select("p_partkey", "p_size"), ["p_partkey"], F.col("p_size"))
    return p.select(F.floor((F.col("sum") - 1) / 1000).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("stable_question_ids", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE 'sha256:' || sha256(text) END AS qid FROM documents")
def stable_question_ids(spark, sf_dir):
    uid = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(uid, F.concat(F.lit("sha256:"), F.sha2("text", 256))).alias("qid"))


@query("question_keys", r"SELECT p_partkey AS id, lower(p_name) || ' x^' || (p_size % 10) AS key FROM part")
def question_keys(spark, sf_dir):
    q = F.concat(F.lit("  "), F.upper("p_name"), F.lit("  $x^{"), (F.col("p_size") % 10).cast("string"), F.lit("}$? "))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.question_key(q).alias("key"))


@query("tool_call_parse_xml", "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'find' ELSE '' END AS names, CASE WHEN p_size % 2 = 0 THEN '{\"n\": ' || p_size || ', \"q\": \"' || p_name || '\", \"deep\": true, \"opt\": null}' END AS arguments FROM part")
def tool_call_parse_xml(spark, sf_dir):
    body = F.concat(F.lit("<tool_call>\n<function=find><parameter=n>"), F.col("p_size").cast("string"), F.lit("</parameter><parameter=q>\n"), "p_name", F.lit("\n</parameter><parameter=deep>TRUE</parameter><parameter=opt>null</function>"))
    text = F.when(F.col("p_size") % 2 == 0, body).otherwise(F.col("p_name"))
    calls = tools.xml_tool_calls({"find": {"n": "integer", "q": "string", "deep": "bool", "opt": "object"}})(text)
    return table(spark, sf_dir, "part").withColumn("c", calls).select(F.col("p_partkey").alias("id"), F.array_join(F.transform("c", lambda x: x["name"]), ",").alias("names"), F.get("c", F.lit(0))["arguments"].alias("arguments"))


@query("tool_call_parse_channels", "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'find={' || p_size || '};get={}' ELSE '' END AS calls FROM part")
def tool_call_parse_channels(spark, sf_dir):
    call = lambda f, a: F.concat(F.lit(f"<|start|>assistant<|channel|>commentary to=functions.{f} <|constrain|>json<|message|>"), a, F.lit("<|call|>"))
    think = F.lit("<|channel|>analysis<|message|>to=functions.no<|end|>")
    text = F.when(F.col("p_size") % 2 == 0, F.concat(think, call("find", F.concat(F.lit("{"), F.col("p_size").cast("string"), F.lit("}"))), call("get", F.lit("{}")))).otherwise(think)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(F.transform(tools.channel_calls(text), lambda c: F.concat(c["name"], F.lit("="), c["arguments"])), ";").alias("calls"))


@query("distill_left_truncation", "WITH s AS (SELECT event_id, event_id % 7 + 2 AS p, event_id % 5 + 1 AS r FROM events), t AS (SELECT *, least(r, greatest(4 - 0, 0)) AS kept FROM s) SELECT event_id, CASE WHEN p + r <= 4 THEN r WHEN r >= 4 THEN 3 ELSE r END AS n_targets, CASE WHEN p + r <= 4 THEN 1 WHEN r >= 4 THEN r - 2 ELSE 1 END AS first_target FROM t")
def distill_left_truncation(spark, sf_dir):
    p, r = (F.col("event_id") % 7 + 2).cast("int"), (F.col("event_id") % 5 + 1).cast("int")
    mask = F.concat(F.array_repeat(F.lit(0), p), F.array_repeat(F.lit(1), r))
    kept = masked.left_truncated_targets(mask, F.sequence(F.lit(1), r), 4)
    return table(spark, sf_dir, "events").select("event_id", F.size(kept).cast("long").alias("n_targets"), F.get(kept, F.lit(0)).cast("long").alias("first_target"))


@query("token_list_difference", f"WITH {TOKENS} SELECT sid, sum(CASE WHEN old_lp IS DISTINCT FROM new_lp THEN mask ELSE 0 END) AS n FROM tok GROUP BY sid")
def token_list_difference(spark, sf_dir):
    return trajectories(spark, sf_dir).select("sid", masked.mismatches(F.col("old_lp"), F.col("new_lp"), F.col("mask")).cast("long").alias("n"))


@query("resample_weights", off_grid(f"WITH {SAMPLES}, b AS (SELECT max(score) AS hi, min(score) AS lo FROM samples) SELECT uid, sample_index, round(score * score + 1e-8, 7) AS pow, CASE WHEN score = hi OR score = lo THEN 1.0 ELSE 0.0 END + 1e-8 AS max_min, CASE WHEN score = hi THEN 0.4 ELSE 0.1 END + 1e-8 AS max_random FROM samples, b"))
def resample_weights(spark, sf_dir):
    from lathe.operators.advantages import with_totals

    s = with_totals(samples(spark, sf_dir), hi=F.max("score"), lo=F.min("score"))
    w = lambda m: masked.resample_weight(F.col("score"), m, low=F.col("lo"), high=F.col("hi"))
    return rounded(s.select("uid", "sample_index", w("pow").alias("pow"), w("max_min").alias("max_min"), w("max_random").alias("max_random")), "pow", digits=7)


@query("response_prediction_shift", f"WITH {TOKENS}, n AS (SELECT sid, pos, old_lp, count(*) OVER (PARTITION BY sid) AS n FROM tok) SELECT sid, count(*) AS n, round(sum(old_lp), 6) + 0.0 AS s FROM n WHERE pos >= 2 AND pos < n - 1 GROUP BY sid")
def response_prediction_shift(spark, sf_dir):
    out = masked.response_predictions(F.col("old_lp"), F.lit(3), F.size("old_lp") - 3)
    return trajectories(spark, sf_dir).select("sid", F.size(out).cast("long").alias("n"), (F.round(masked.total(out), 6) + F.lit(0.0)).alias("s"))

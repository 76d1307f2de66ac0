"""Operators against hand-computed values, numpy and round trips."""

import itertools
import json
import random
from collections import Counter

import numpy as np
import pytest
from lathe.functions import answers, masked, tools
from lathe.functions import text as T
from lathe.operators import advantages, balance, contracts, correction, evaluation, groups, losses, metrics, rows
from lathe.sources import datasets
from lathe.streaming import queues
from pyspark.sql import functions as F


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


def test_text_functions(spark):
    s = lambda c, v: one(spark, c(F.col("s")), s=v)
    assert s(T.question_key, "What is  $x^{2}$ + \\left( \\dfrac{1}{2} \\right)?") == s(T.question_key, "what is x^2 + ( \\frac{1}{2} )")
    assert s(T.qa_normal, " The  Cat's, a hat ") == "cats hat"
    assert s(T.last_answer, "<answer>a</answer> x <answer> b\nc </answer>") == "b\nc"
    assert s(T.hash_answer, "#### 1,234 and #### -5,6") == "-56"
    assert s(T.hash_answer, "none") is None
    assert s(T.last_number, "1 then 2.5 .") == "2.5"
    assert s(T.last_number, ". .") == "."
    assert s(T.boxed, "\\boxed{1} \\boxed{\\frac{1}{2}} x") == "\\frac{1}{2}"
    assert s(T.boxed, "\\boxed{{1}") is None and s(T.boxed, "none") is None
    assert s(lambda c: T.with_suffix(c, "Go."), " a. Go. ") == "a. Go."
    assert [c["name"] for c in s(T.tool_calls, '<tool_call>{"name": "f", "arguments": {"a": 1}}</tool_call><tool_call>{bad</tool_call>')] == ["f"]


def test_answer_forms(spark):
    form = lambda v: one(spark, answers.math_form(F.col("s")), s=v)
    assert form("\\dfrac12") == "\\frac{1}{2}" == form("0.5") == form("1/2") == form("\\frac 1 2".replace(" ", ""))
    assert form("x = 3") == "3" and form(".5\\%") == "\\frac{1}{2}" and form("\\sqrt2") == "\\sqrt{2}"
    assert one(spark, answers.quantity(F.col("s")), s="x = \\text{1,000} dollars") == "1000"
    score = lambda t, g: one(spark, answers.strict_box_score(F.col("t"), F.col("g")), t=t, g=g)
    assert score("\\boxed{7}", "7") == 1.0 and score("\\boxed{7} \\boxed{7}", "7") == 0.0 and score("7", "7") == 0.0 and score("\\fbox{7}", "7") == 1.0
    assert one(spark, answers.dapo_score(F.col("t"), F.col("g"), True)["score"], t="so \\boxed{4}", g="4") == 1.0
    sim = lambda a, b: one(spark, answers.multiset_similarity(F.col("a"), F.col("b")), a=a, b=b)
    assert sim(["x", "x", "y"], ["x", "z"]) == 0.25 and sim(["x"], ["x"]) == 1.0
    with pytest.raises(Exception, match="no scorer"):
        one(spark, answers.score(F.lit("nowhere"), F.lit("a"), F.lit("a")))


def test_tool_call_scores_by_hand(spark):
    f = lambda *calls: json.dumps([{"name": n, "parameters": p} for n, p in calls])
    cases = [
        (f(("f", {"a": 1})), f(("f", {"a": 1})), 3.0),
        (f(("f", {"a": 1})), f(("f", {"a": -1})), 6 * 2 / 3 - 3),  # name and key agree, the value doesn't
        (f(("f", {"a": 1}), ("f", {"a": 2})), f(("f", {"a": 2}), ("f", {"a": 1})), 3.0),  # the best call that is left, whatever its place
        (f(("f", {"a": 1, "b": "x"})), f(("f", {"a": 1}), ("g", {})), 6 * (1 / 2 + 1 / 2 + 1) / 4 - 3),
        (f(("f", {"a": 1})), f(("f", {"a": "1"})), 6 * 2 / 3 - 3),  # a number isn't its text
        (f(("f", {"o": {"x": 1, "y": [1, 2]}})), f(("f", {"o": {"y": [1, 2], "x": 1.0}})), 3.0),
        (f(("f", {"a": 1}), ("f", {"a": 1})), f(("f", {"a": 1})), 6 * (1 / 2 + 2) / 5 - 3),  # a call is taken once
        (f(("f", None)), '[{"name": "f"}]', 3.0),
        (f(("f", {"b": 2})), f(("f", {"c": 2}), ("f", {"b": 3})), 6 * (1 / 2 + 1) / 3 - 3),  # the second agrees in its key
        ("[]", f(("f", {})), -3.0),
        ("[]", "[]", 3.0),
        (f(("f", {})), "__import__('os')", -3.0),
        (f(("f", {})), '{"name": "f"}', -3.0),
        (f(("f", {})), '[{"parameters": {}}]', -3.0),
        (f(("f", {})), None, -3.0),
    ]
    df = spark.createDataFrame([(i, e, p) for i, (e, p, _) in enumerate(cases)], "i int, e string, p string")
    got = {r.i: r.s for r in df.select("i", tools.tool_score(F.col("e"), F.col("p")).alias("s")).collect()}
    assert [got[i] for i in range(len(cases))] == [pytest.approx(w) for *_, w in cases]


def test_masked_recurrences_against_numpy(spark):
    rng = np.random.default_rng(0)
    r, v, m = rng.normal(size=11), rng.normal(size=11), np.array([0, 0, 1, 1, 1, 0, 0, 1, 1, 0, 0])

    def gae(values):
        nv = last = 0.0
        out = []
        for t in range(10, -1, -1):
            a = r[t] + 0.9 * nv - values[t] + 0.9 * 0.8 * last
            nv, last = (values[t], a) if m[t] else (nv, last)
            out.append(last)
        return out[::-1]

    col = masked.gae(F.col("r"), F.col("v"), F.col("m"), 0.9, 0.8)
    args = {"r": r.tolist(), "v": v.tolist(), "m": m.tolist()}
    assert np.allclose(one(spark, col, **args), gae(v))
    other = np.where(m, v, 99.0)
    assert np.allclose(one(spark, col, **{**args, "v": other.tolist()}), gae(v))  # values outside the mask don't matter
    assert np.allclose(one(spark, masked.reward_to_go(F.col("r"), F.col("m")), **args), np.cumsum((r * m)[::-1])[::-1])
    assert np.allclose(one(spark, masked.prefix_sums(F.col("r"), F.col("m")), **args), np.cumsum(r * m))
    nan = [float("nan") if not k else x for x, k in zip(r.tolist(), m.tolist(), strict=True)]
    assert one(spark, masked.masked_mean(F.col("r"), F.col("m")), r=nan, m=m.tolist()) == pytest.approx((r * m).sum() / (m.sum() + 1e-8))
    assert one(spark, masked.longest_run(F.col("r")), r=[0.0, 1.0, 0.0, 0.0, 0.0, 2.0]) == 3
    ids = [5, 6, 2, 7, 2]
    assert one(spark, masked.response_mask_from_eos(F.col("i"), [2, 3]), i=ids) == [1, 1, 1, 0, 0]
    assert one(spark, masked.response_mask_from_eos(F.col("i"), [9]), i=ids) == [1] * 5
    assert one(spark, masked.pad(F.col("i"), 7, 0, left=True), i=ids) == [0, 0, *ids]
    assert [one(spark, masked.truncate(F.col("i"), 3, s), i=ids) for s in ("right", "left", "middle")] == [[5, 6, 2], [2, 7, 2], [5, 7, 2]]
    with pytest.raises(Exception, match="more than 3"):
        one(spark, masked.truncate(F.col("i"), 3, "error"), i=ids)
    with pytest.raises(ValueError, match="unknown"):
        masked.kl_penalty(F.lit(0.0), F.lit(0.0), "k9")


def test_estimators_agree_where_they_should(spark):
    rng = random.Random(1)
    data = [(rng.randrange(9), i, rng.random(), rng.randint(1, 9)) for i in range(60)] + [(99, 100, 0.7, 3)]
    df = spark.createDataFrame(data, "uid long, sample_index int, score double, n_tokens int")
    get = lambda name: {r.sample_index: r.advantage for r in advantages.estimate(df, name).collect()}
    a, b = get("grpo"), get("grpo_vectorized")
    assert all(a[k] == pytest.approx(b[k], rel=1e-5) for k in a)
    c, d = get("rloo"), get("rloo_vectorized")
    assert all(c[k] == pytest.approx(d[k]) for k in c if k != 100) and (c[100], d[100]) == (0.7, 0.0)
    with pytest.raises(Exception, match="two samples"):
        get("grpo_passk")
    with pytest.raises(ValueError, match="unknown estimator"):
        advantages.estimate(df, "nothing")
    with pytest.raises(ValueError, match="registered"):
        advantages.register("grpo")(lambda x: x)
    with pytest.raises(ValueError, match="horizon"):
        losses.agg_loss("seq-mean-token-sum-norm", F.lit(1.0), F.lit(1))


def test_threshold_specs():
    assert correction.parse_threshold("0.5_1.5") == (0.5, 1.5) and correction.parse_threshold(2.0) == (None, 2.0)
    assert correction.parse_rejection("token_k1, seq_sum_k3", "2.0,0.1") == {"token_k1": (0.5, 2.0), "seq_sum_k3": (None, 0.1)}
    for bad in (("token_k9", "1"), ("token_k1,token_k2,token_k3", "1,2"), ("", "1")):
        with pytest.raises(ValueError):
            correction.parse_rejection(*bad)


def test_balanced_parts(spark):
    rng = random.Random(2)
    for equal in (False, True):
        costs = [rng.randint(1, 100) for _ in range(24)]
        parts = balance.largest_differencing(costs, 4, equal)
        assert sorted(i for p in parts for i in p) == list(range(24))
        sums = [sum(costs[i] for i in p) for p in parts]
        assert max(sums) - min(sums) <= 100 and (not equal or {len(p) for p in parts} == {6})
        assert sorted(i for p in balance.greedy(costs, 4, equal) for i in p) == list(range(24))
    lengths = [rng.randint(1, 100) for _ in range(20)]
    batches = balance.micro_batches(lengths, 300)
    assert len(batches) == -(-sum(lengths) // 300) and sorted(i for b in batches for i in b) == list(range(20))
    assert all(len(b) * max(lengths[i] for i in b) <= 300 or len(b) == 1 for b in balance.padded_batches(lengths, 300, 8))
    assert [len(p) for p in balance.group_balanced(lengths, [i // 5 for i in range(20)], 2)] == [10, 10]
    with pytest.raises(ValueError):
        balance.largest_differencing([1], 2)
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "id long, n int")
    assert balance.assign(df, "id", "n", 3).groupBy("part").count().count() == 3


def test_row_algebra(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(20)], "id long, k int")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(rows.take_slice(df, ["id"], 2, 15, 4)) == list(range(20))[2:15:4]
    assert [r._n for r in rows.numbered(df, [F.desc("id")]).orderBy("id").collect()] == list(range(19, -1, -1))
    assert len(ids(rows.chunks(df, ["id"], 6, drop_tail=True))) == 18
    assert len(ids(rows.equal_splits(df, ["id"], 3))) == 18
    assert rows.pad_to_multiple(df.limit(3), ["id"], 8).count() == 8
    assert rows.pad_to_multiple(df.limit(0), ["id"], 8).count() == 0
    assert rows.repeat(df, 3).count() == 60 and rows.repeat(df, "k").count() == sum(i % 3 for i in range(20))
    split = rows.holdout(df, "k", 1, 7).groupBy("split").agg(F.count_distinct("k").alias("n")).collect()
    assert {r.split: r.n for r in split} == {"val": 1, "train": 2}
    same = rows.union_columns(df, df.withColumn("x", F.lit(float("nan"))), ["id"])
    assert same.columns == ["id", "k", "x"] and same.count() == 20
    with pytest.raises(Exception, match="differs"):
        rows.union_columns(df, df.withColumn("k", F.col("k") + 1), ["id"]).collect()
    drawn = rows.weighted_resample(df, "id", (F.col("id") == 7).cast("double") + 1e-9, 50, 1)
    assert drawn.count() == 50 and {r.id for r in drawn.collect()} == {7}


def test_groups_and_metrics(spark):
    v = spark.createDataFrame([("s", "p", i, x, y) for i, (x, y) in enumerate([("A", 0.9), ("B", 0.8), ("B", 0.7), ("A", 0.6)])], "data_source string, uid string, sample_index int, pred string, score double")
    assert groups.majority(v, ["uid"], "pred", "score", ["sample_index"]).first().value == 0.9
    assert groups.strict_plurality(v.withColumn("ok", F.lit(1)), ["uid"], "pred", "ok").first().score == 0.0
    assert [one(spark, groups.pass_at_k(F.lit(n), F.lit(c), k)) for n, c, k in ((64, 0, 1), (64, 1, 32), (2, 2, 1))] == [0.0, 0.5, 1.0]
    m = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 0, 1, 2.0), ("a", 1, 0, 3.0), ("a", 1, 1, 4.0)], "name string, rank int, slot int, value double")
    assert [metrics.aggregate_ranks(m, k).first().value for k in ("min", "max", "mean", "sum")] == [1.0, 4.0, 2.5, 5.0]
    with pytest.raises(Exception, match="unequal"):
        metrics.aggregate_ranks(m.where("not (rank = 1 and slot = 1)"), "mean").collect()
    sp = spark.createDataFrame([("perf/total_num_tokens", 600.0), ("perf/time_per_step", 2.0), ("perf/throughput", 1.0)], "name string, value double")
    assert {r.name: r.value for r in metrics.special_metrics(sp, 2).collect()}["perf/throughput"] == 150.0
    q = metrics.quantile_buckets(spark.createDataFrame([(float(x),) for x in (1, 1, 1, 2, 3)], "x double"), "x", 5)
    assert q.where("bucket is null").count() == 0


def test_sources_and_contracts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    df.write.parquet(str(tmp_path / "x.parquet"))
    df.withColumn("u", F.lit(1)).write.json(str(tmp_path / "y.jsonl"))
    both = datasets.read_dataset(spark, [str(tmp_path / "x.parquet"), str(tmp_path / "y.jsonl")])
    assert both.count() == 4 and set(both.columns) == {"id", "t", "u"}
    with pytest.raises(ValueError, match="unsupported"):
        datasets.read_dataset(spark, ["a.csv"])
    with pytest.raises(ValueError, match="none of"):
        datasets.keep_columns(df, ["zz"])
    log = spark.createDataFrame([(0, "\x1b[31mstep:1 - a/b:0.5 - c:2\x1b[0m"), (1, "step:1 - c:3"), (2, "noise")], "line_no int, value string")
    assert {(r.step, r.name, r.value) for r in datasets.parse_run_log(log).collect()} == {(1, "a/b", 0.5), (1, "c", 3.0)}
    datasets.dump_generations(df.withColumn("step", F.lit(4)), str(tmp_path / "dump"))
    assert datasets.read_rollouts(spark, str(tmp_path / "dump"), mask="[ab]").where("t = '*' and step = 4").count() == 2
    made = []
    for _ in range(2):
        datasets.cached_step(spark, str(tmp_path / "cache"), 3, lambda: (made.append(1), df)[1])
    assert made == [1]
    datasets.write_shards(df, str(tmp_path / "shards"), 1)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 2
    with pytest.raises(ValueError, match="schema"):
        contracts.same_schema(df, both.schema)


def test_queue_budget_and_pause(spark):
    assert queues.staleness_budget(64, 0.5, 4) == 384
    assert one(spark, queues.should_pause(F.lit(5), 5, F.lit(0), 9)) is True and one(spark, queues.should_pause(F.lit(4), 5, F.lit(8), 9)) is False
    df = spark.createDataFrame([(i,) for i in range(10)], "i int")
    assert queues.count_windows(df, ["i"], 4).count() == 8


def test_majority_of_draws_equals_enumeration(spark):
    groups_ = {1: [("a", 1.0), ("b", 2.0), ("a", 3.0)], 2: [("a", 1.0), ("b", 5.0), ("c", -1.0), ("b", 2.0), ("a", 0.5)], 3: [("x", 1.0)], 4: [("x", 1.0), ("x", 3.0)]}
    df = spark.createDataFrame([(u, p, v) for u, xs in groups_.items() for p, v in xs], "uid int, pred string, score double")
    got = {(r.uid, r.k): (r.n, r.maj_mean, r.maj_std) for r in metrics.majority_at_k(df, ["uid"], "pred", "score").collect()}
    want = {}
    for u, xs in groups_.items():
        for k in ([2, len(xs)] if len(xs) < 4 else [2, 4, len(xs)]):
            if len(xs) < 2:
                continue
            values = []
            for draw in itertools.product(xs, repeat=k):
                counts = Counter(p for p, _ in draw)  # first seen first
                winner = max(counts, key=counts.__getitem__)
                values.append(next(v for p, v in draw if p == winner))
            want[(u, k)] = (len(xs), np.mean(values), np.std(values))
    assert got.keys() == want.keys()
    for key, w in want.items():
        assert got[key] == pytest.approx(w)


def test_best_and_worst_of_draws_equal_enumeration(spark):
    v = [0.3, -1.0, 2.0, 2.0, 0.0]
    df = spark.createDataFrame([(1, x, None if i else 1.0) for i, x in enumerate(v)], "uid int, a double, b double")
    got = {r.k: r for r in metrics.best_and_worst_at_k(df, ["uid"], ["a", "b"]).collect()}
    assert sorted(got) == [2, 4, 5] and {r.variable for r in got.values()} == {"a"}
    for k, r in got.items():
        best, worst = ([f(d) for d in itertools.product(v, repeat=k)] for f in (max, min))
        assert (r.n, r.best_mean, r.best_std, r.worst_mean, r.worst_std) == pytest.approx((5, np.mean(best), np.std(best), np.mean(worst), np.std(worst)))


def test_bootstrap_equals_numpy(spark):
    rng = np.random.default_rng(3)
    data = {u: rng.normal(size=rng.integers(1, 6)) for u in range(20)}
    df = spark.createDataFrame([(u, i, float(x)) for u, xs in data.items() for i, x in enumerate(xs)], "uid int, i int, v double")
    got = {r.uid: r for r in evaluation.bootstrap(df, ["uid"], "v", "i", 3, rounds=50, seed=7).collect()}
    for u, xs in data.items():
        np.random.seed(7)
        draws = xs[np.random.choice(len(xs), size=(50, 3), replace=True)]
        r = got[u]
        assert (r.best_mean, r.best_std, r.worst_mean, r.worst_std) == pytest.approx((draws.max(1).mean(), draws.max(1).std(), draws.min(1).mean(), draws.min(1).std()))


def test_quantiles_of_t_and_running_sums(spark):
    # from printed tables
    t = {1: 12.7062, 5: 2.5706, 10: 2.2281, 11: 2.2010, 15: 2.1314, 30: 2.0423, 120: 1.9799, 100_000: 1.9600}
    got = {r.n: r.t for r in spark.createDataFrame([(n,) for n in t], "n long").select("n", metrics.t95(F.col("n")).alias("t")).collect()}
    assert all(abs(got[n] - x) < 1e-4 for n, x in t.items())
    df = spark.range(1000).withColumn("k", (F.col("id") * 7919) % 1009)
    out = rows.running_sum(df, ["k"], F.col("id") % 5, number="at").orderBy("k").collect()
    total = 0
    for i, r in enumerate(out):
        total += r.id % 5
        assert (r["sum"], r["at"]) == (total, i)


def test_metric_names_of_the_greatest_size(spark):
    df = spark.createDataFrame([("s", "acc", "best@2/mean", 2), ("s", "acc", "best@4/mean", 4), ("s", "acc", "worst@4/mean", 4), ("s", "len", "mean@4", 4)], "data_source string, variable string, metric string, n int")
    assert {r.metric: r.name.split("/")[0] for r in metrics.metric_names(df, "acc").collect()} == {"best@2/mean": "val-aux", "best@4/mean": "val-core", "worst@4/mean": "val-aux", "mean@4": "val-aux"}


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(5)
    data = [(int(g), None if x > 2 else float(x)) for g, x in zip(rng.integers(0, 3, 500), rng.normal(size=500), strict=True)]
    df = spark.createDataFrame(data, "g int, x double")
    qs = [0.0, 0.01, 0.37, 0.5, 0.95, 1.0]
    own = lambda g: np.array([x for h, x in data if x is not None and g in (None, h)])
    assert metrics.quantiles(df, "x", qs).first()["q"] == pytest.approx(np.quantile(own(None), qs).tolist())
    for r in metrics.quantiles(df, "x", qs, ["g"]).collect():
        assert r["q"] == pytest.approx(np.quantile(own(r.g), qs).tolist())
    assert metrics.tail_ratio(df.limit(0), "x", 5.0).first()["tail_ratio"] is None

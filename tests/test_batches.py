"""Batches, rates, states, values and gates against plain loops."""

import random

import pandas as pd
import pytest
from lathe.functions import answers
from lathe.operators import balance, contracts, rows
from lathe.plans import QUERIES
from lathe.sources import datasets
from lathe.streaming import queues
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lengths(spark, n=90, size=16):
    rng = random.Random(4)
    data = [(i // size, i, rng.randint(1, 900)) for i in range(n)]
    return data, spark.createDataFrame(data, "batch long, id long, length long")


def test_parts_of_batches_equal_the_lists(spark):
    data, df = lengths(spark)
    by_batch = {}
    for b, i, n in data:
        by_batch.setdefault(b, []).append((i, n))
    split = lambda t: balance.largest_differencing([balance.workload(x) for x in t["length"]], 4)
    got = {r.id: r.part for r in balance.in_batches(df, "batch", "id", split).collect()}
    greedy = {r.id: r.part for r in balance.least_loaded(df, "batch", "id", "length", 3).collect()}
    pads = {r.id: r.part for r in balance.padded(df, "batch", "id", "length", 2000, 5).collect()}
    for xs in by_batch.values():
        ids, ns = [i for i, _ in xs], [n for _, n in xs]
        want = balance.largest_differencing([balance.workload(n) for n in ns], 4)
        assert [[i for i in ids if got[i] == p] for p in range(4)] == [[ids[k] for k in part] for part in want]
        assert [[i for i in ids if greedy[i] == p] for p in range(3)] == [[ids[k] for k in part] for part in balance.greedy(ns, 3)]
        want = balance.padded_batches(ns, 2000, 5)
        assert [sorted(i for i in ids if pads[i] == p) for p in range(len(want))] == [sorted(ids[k] for k in part) for part in want]


def test_orders_of_micro_batches_equal_slices(spark):
    data, df = lengths(spark, 37, 10)
    for fn, want in (
        (balance.micro_batch_order, lambda xs: (s := sorted(xs, key=lambda x: (-x[1], x[0])))[::2][::-1] + s[1::2]),
        (balance.rank_order, lambda xs: (s := sorted(xs, key=lambda x: (x[1], x[0])))[::2] + s[1::2][::-1]),
    ):
        got = {}
        for r in fn(df, "batch", F.col("length"), "id").collect():
            got.setdefault(r.batch, {})[r.at] = r.id
        for b in got:
            xs = [(i, n) for c, i, n in data if c == b]
            assert [got[b][k] for k in range(len(xs))] == [i for i, _ in want(xs)]


def test_more_rows_than_the_driver_takes_are_dealt(spark):
    data, df = lengths(spark)
    few = balance.assign(df, "id", "length", 4).groupBy("part").agg(F.sum("length").alias("s")).collect()
    many = balance.assign(df, "id", "length", 4, most_items=10)
    assert many.count() == len(data) and {r.part for r in many.collect()} == {0, 1, 2, 3}
    sums = [r.s for r in many.groupBy("part").agg(F.sum("length").alias("s")).collect()]
    assert len(few) == 4 and max(sums) - min(sums) <= max(n for *_, n in data)
    counts = [r["count"] for r in many.groupBy("part").count().collect()]
    assert max(counts) - min(counts) <= 1


def test_token_bucket_equals_a_simulation(spark):
    rng = random.Random(8)
    rate, capacity = 2.0, 4.0
    data, want = [], {}
    for key in range(3):
        at = tokens_at = 0.0
        tokens = capacity
        for i in range(60):
            at += rng.choice([0, 0, 0.1, 0.4, 3])
            cost = rng.choice([1, 2, 4])
            data.append((key, i, at, cost))
            now = max(at, tokens_at)
            tokens = min(capacity, tokens + (now - tokens_at) * rate)
            start = now if tokens >= cost else now + (cost - tokens) / rate
            tokens = min(capacity, tokens + (start - now) * rate) - cost
            tokens_at = start
            want[(key, i)] = start
    df = spark.createDataFrame(data, "key int, i int, at double, cost int")
    got = {(r.key, r.i): r.start for r in queues.rate_limited(df, ["key"], ["i"], "at", F.col("cost"), rate, capacity).collect()}
    assert got == pytest.approx(want)


def test_a_paused_rollout_goes_on_where_it_was(spark):
    events = ["tool_result", "start", "tool_call", "start", "tool_result", "interaction", "reply", "stop", "start"]
    got = spark.createDataFrame([(events,), ([],)], "e array<string>").select(queues.states(F.col("e")).alias("s")).collect()
    assert got[0].s == ["PENDING", "GENERATING", "PROCESSING_TOOLS", "PROCESSING_TOOLS", "GENERATING", "INTERACTING", "GENERATING", "TERMINATED", "TERMINATED"] and got[1].s == []


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("1/2", "0.50", True),
        ("-\\frac{3}{4}", "-0.75", True),
        ("1\\frac{1}{2}", "1.5", True),
        ("3 1/4", "3.25", True),
        ("50\\%", "0.5", True),
        ("2\\sqrt{2}", "2.8284271", True),
        ("\\pi", "3.14159265", True),
        ("3 million", "3000000", True),
        ("1,234", "1234", True),
        ("(1, 2)", "(1.0,\\frac{4}{2})", True),
        ("(1,2)", "[1,2]", False),
        ("(1,2)", "(2,1)", False),
        ("(1,2,3)", "(1,2)", False),
        ("x+1", "x+1", True),
        ("x+1", "1+x", False),  # no algebra
        ("\\text{East}", "east", True),
        ("5 cm", "5", True),
        ("1/0", "1/0", True),
        ("1/0", "5", False),
        ("", "0", False),
    ],
)
def test_values(spark, a, b, same):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(answers.same_value(F.col("a"), F.col("b")).alias("s")).first().s is same


def test_values_of_nothing(spark):
    df = spark.createDataFrame([(None, "1"), ("1", None)], "a string, b string")
    assert {r.s for r in df.select(answers.same_value(F.col("a"), F.col("b")).alias("s")).collect()} == {False}
    cases = spark.createDataFrame([([True, True],), ([True, None, False],), ([],), ([True] * 10 + [False],)], "p array<boolean>")
    assert [r.s for r in cases.select(answers.case_score(F.col("p"), True).alias("s")).collect()] == [1.0, pytest.approx(1 / 3), 1.0, 1.0]
    assert [r.s for r in cases.select(answers.case_score(F.col("p")).alias("s")).collect()] == [1.0, 0.0, 1.0, 0.0]


def test_columns_rows_and_positions(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "id long, t string")
    with pytest.raises(ValueError, match="no columns"):
        rows.select_columns(df, ["id", "x"])
    with pytest.raises(ValueError, match="can't become"):
        rows.rename_columns(df, ["id"], [])
    assert rows.select_columns(df).columns == ["id", "t"]
    picks = spark.createDataFrame([(3, 0), (3, 1), (0, 2)], "at long, out long")
    assert [(r.out, r.id) for r in rows.take_rows(df, ["id"], picks).orderBy("out").collect()] == [(0, 3), (1, 3), (2, 0)]
    path = str(tmp_path / "x.parquet")
    df.coalesce(1).write.parquet(path)
    stored = spark.read.parquet(path)
    name = stored.inputFiles()[0].rpartition("/")[2]
    chosen = spark.createDataFrame([(name, 4, 4), (name, 9, 9), ("other", 2, 2)], "file string, row_index long, id long")
    assert sorted(r.id for r in datasets.selected_rows(stored, chosen, "id").collect()) == [4, 9]
    with pytest.raises(Exception, match="another row"):
        datasets.selected_rows(stored, spark.createDataFrame([(name, 4, 5)], "file string, row_index long, id long"), "id").collect()
    assert datasets.read_exact(spark, path, stored.schema).count() == 20
    with pytest.raises(ValueError, match="schema differs"):
        datasets.read_exact(spark, path, T.StructType([T.StructField("id", T.LongType())]))
    assert rows.quantile_picks(df.withColumn("g", F.lit(1)), ["g"], ["id"], 1).count() == 1


def test_rows_by_file_position_in_several_files_and_any_order(spark, tmp_path):
    docs = [(i, f"s{i % 7}") for i in range(60)] + [(5, "again"), (None, "none")]
    spark.createDataFrame(docs, "doc_id long, source string").orderBy(F.desc("source"), F.desc("doc_id")).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [*range(0, 60, 3), 6, 5, 1000, None]
    spark.createDataFrame([(i,) for i in labels], "doc_id long").repartition(2).write.parquet(f"{tmp_path}/labels.parquet")
    got = QUERIES["rows_by_file_position"](spark, str(tmp_path)).collect()
    want = sorted((i, s) for i, s in docs for j in labels if i is not None and i == j)
    assert sorted((r.doc_id, r.source) for r in got) == want


def test_parameters_and_configs():
    flat = datasets.flat_params({"a": {"b": [1, {"c": 2}]}, "d": None, "e": []})
    # by hand; a table tool flattens alike where there is no list
    assert flat == {"a/b/list_len": 2, "a/b/0": 1, "a/b/1/c": 2, "d": None, "e/list_len": 0}
    nested = {"x": {"y": 1, "z": {"w": "v"}}, "u": 2.5}
    assert datasets.flat_params(nested) == pd.json_normalize(nested, sep="/").iloc[0].to_dict()
    assert datasets.flat_params(None) == {}
    rules = {"mode": {"a", "b"}, "rate": (0, 1)}
    assert contracts.checked_config({"mode": "a", "rate": 0.5}, rules) == {"mode": "a", "rate": 0.5}
    with pytest.raises(ValueError, match="unknown x; mode is None.*; rate is 2"):
        contracts.checked_config({"rate": 2, "x": 1}, rules)

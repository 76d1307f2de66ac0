"""Clashing columns, repeated ids, hot keys and odd letters."""

import random

import corpus_pipeline
import numpy as np
import pytest
from lathe.llm import common, decontaminate, lines, mixing, secrets, simhash, substrings, topk, toxicity, urls
from lathe.llm.components import connected_components
from lathe.llm.queries import RULES
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_spare_names_and_counted_joins(spark):
    assert common.spare(["_a", "_A_", "b"], "_a", "c") == ["_a__", "c"]
    left = spark.createDataFrame([(i % 7 if i % 2 else 99, i) for i in range(4000)], "k long, v long")
    right = common.stored(left.groupBy("k").agg(F.count(F.lit(1)).alias("n")))
    joined = common.with_counted(left, right, ["k"], "n", parts=3)
    assert joined.count() == 4000 and {r.n for r in joined.where("k = 99").collect()} == {2000}
    assert common.with_counted(left, right.where("k < 0"), ["k"], "n").count() == 0


def test_scratch_deletes_what_was_stored(spark):
    import os

    with common.scratch(spark):
        path = common.stored(spark.range(3)).inputFiles()[0].removeprefix("file:")
        assert os.path.exists(path)
    assert not os.path.exists(path)


def test_lower_case_keeps_offsets(spark):
    model = toxicity.Model(np.zeros(1 << 18, np.float32), -6.0, 18)
    for f in toxicity.features("vile", 18):
        model.weights[f] = 10
    texts = ["i. You are VILE. ß", "İ. You are VILE. ß", "İ İ İ. you are vile. ẞ"]
    scored = [model.scorer()(t) for t in texts]
    assert scored[0] == scored[1] and scored[2][0] == pytest.approx(scored[0][0], abs=1e-2) and scored[0][0] > 0.9
    for t, (_, found) in zip(texts, scored, strict=True):
        s, e, _ = max(found, key=lambda x: x[2])
        assert t[s:e].strip().lower() == "you are vile"
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(len(r.offending) == 1 for r in toxicity.score_documents(df, model).collect())


def test_relative_links(spark):
    base = "HTTP://Site.io/a/b/page.html?x=1#f"
    wanted = {"next.html": "x://site.io/a/b/next.html", "?id=3": "x://site.io/a/b/page.html?id=3", "#top": "x://site.io/a/b/page.html#top", "/c?d": "x://site.io/c?d", "//o.io/x": "x://o.io/x", "../up": "x://site.io/a/up", "./../../z/./y?q#r": "x://site.io/z/y?q#r", "../../../..": "x://site.io/", "https://p.io/": "https://p.io/", "mailto:a@b.c": None, "p?u=http://e.com/": "x://site.io/a/b/p?u=http://e.com/"}
    df = spark.createDataFrame([(base, t) for t in wanted], "url string, target string")
    got = {r.target: r.full for r in df.withColumn("full", urls.resolved(F.col("url"), F.col("target"))).collect()}
    assert got == wanted
    pages = spark.createDataFrame([(1, "http://one.io/x/a.html", "<link rel=canonical href=b.html>"), (2, "http://one.io/x/b.html", "<link rel=canonical href='http://z.com/en/'>"), (3, "http://one.io", "<link rel=canonical href='x/b.html'>")], "page_id long, url string, html string").selectExpr("*", "'k' as _node", "'k' as _own", "'k' as alias_verdict", "'k' as _alias")
    rows = urls.judge(pages, RULES).collect()
    assert {r.page_id: r.verdict for r in rows} == {1: "block", 2: "block", 3: "block"}
    assert {(r._node, r._own, r.alias_verdict, r._alias) for r in rows} == {("k",) * 4}


def test_owners_and_repositories_both_decide(spark):
    key = lambda c: f"Zx9aB3dE5fG7hJ9kL1m{c}"
    held = {"A": [("s0", "en"), ("s0", "de")], "B": [("s0", "en"), ("s1", "en")], "C": [("s0", g) for g in ("en", "de", "fr", "es")], "D": [("s2", "en"), ("s2", "en")]}
    docs = [(i, f"x {key(c)} y", g, s, 0) for i, (c, s, g) in enumerate((c, *x) for c, xs in held.items() for x in xs)]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as _row", "2 as _owner", "3 as _repository", "4 as _found", "5 as n")
    rows = secrets.scan(df, repository=F.concat_ws("/", "source", "lang")).collect()
    live = {c: {bool(r.spans) for r in rows if docs[r.doc_id][1] == f"x {key(c)} y"} for c in held}
    assert live == {"A": {True}, "B": {False}, "C": {False}, "D": {True}}
    assert {(r._row, r._owner, r._repository, r._found, r.n) for r in rows} == {(1, 2, 3, 4, 5)} and "text" not in rows[0]


def test_many_matches_in_one_text(spark):
    text = "x token=abcdefghijklmnop\n" * 20_000 + "é AKIA" + "B" * 16
    got = secrets.secret_report(spark.createDataFrame([(1, text, "en", "s", 0)], DOCS)).first()
    assert got.n_assign == 20_000 and got.n_access == 1
    spans = got.spans.split(",")
    assert spans[-2] == f"assign:{25 * 19_999 + 2}:{25 * 19_999 + 24}" and spans[-1] == f"access:{25 * 20_000 + 2}:{25 * 20_000 + 22}"


def test_fitting_in_one_row_and_by_joins_agree(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(["w"] * rng.randint(1, 40)) + rng.choice(["", " token", " license"]), rng.choice(["en", "de", None]), rng.choice("abcd"), 0) for i in range(600)]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "'k' as _d0", "'k' as _d1", "'old' as copies", "'old' as residual")
    target = spark.createDataFrame([("a", 0.4), ("b", 0.6), ("z", 0.0)], "source string, target double")
    one, two = ({r.doc_id: r for r in mixing.mix(df, mixing.document_dims(), targets={"source": target}, most_steps=m).collect()} for m in (1 << 18, 0))
    for i, r in one.items():
        assert r.weight == pytest.approx(two[i].weight, rel=1e-9, abs=1e-12) and r.copies == two[i].copies and r.residual == pytest.approx(two[i].residual, rel=1e-6, abs=1e-12)
        assert (r._d0, r._d1) == ("k", "k") and (r.weight == 0) == (r.source in "cd")
    # brute force
    cells = {}
    for _, t, g, s, _ in docs:
        topic = "licence" if "license" in t else "credential" if "token" in t else "prose"
        cells[(s, g, topic)] = cells.get((s, g, topic), 0) + len(t.split())
    own, w = dict(cells), {k: float(v) for k, v in cells.items()}
    margin = lambda x, i: {v: sum(n for k, n in x.items() if k[i] == v) for v in {k[i] for k in x}}
    powers = [{v: n**0.7 for v, n in margin(own, i).items()} for i in range(3)]
    goal = [{"a": 0.4, "b": 0.6}, *({v: n / sum(p.values()) for v, n in p.items()} for p in powers[1:])]
    for _ in range(10):
        for i in range(3):
            now = margin(w, i)
            w = {k: n * goal[i][k[i]] / now[k[i]] if k[i] in goal[i] and now[k[i]] > 0 else 0.0 for k, n in w.items()}
    for i, t, g, s, _ in docs:
        topic = "licence" if "license" in t else "credential" if "token" in t else "prose"
        assert one[i].weight == pytest.approx(w[(s, g, topic)] * sum(own.values()) / own[(s, g, topic)], rel=1e-9, abs=1e-12)
    off = max(abs(n / goal[i][v] - 1) for i in range(3) for v, n in margin(w, i).items() if v in goal[i])
    assert one[0].residual == pytest.approx(off, rel=1e-6, abs=1e-12)


def test_mixing_a_very_long_text(spark):
    df = spark.createDataFrame([(1, "w " * 400_000, "en", "a", 0), (2, "w", "de", "b", 0), (3, None, None, None, 0)], DOCS)
    got = {r.doc_id: r for r in mixing.mix(df, mixing.document_dims()).collect()}
    assert got[1].n_tokens == 400_000 and got[2].n_tokens == 1 and got[3].n_tokens == 0 and got[3].residual is None


def test_query_rows_that_share_an_id_and_query_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(300)] + [(100, [9.0, 0.0, 0.0, 0.0]), (100, [-9.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    least = [int(np.floor(1024 * x)) for x in min(v for i, v in rows if i == 100)]
    whole = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    want = sorted((-sum(a * b for a, b in zip(least, v, strict=True)), i) for i, v in whole if i != 100)[:10]
    for options in ({}, {"query_block": 1}, {"seeds": 20, "bucket": 7, "chunk": 50}):
        got = topk.top_k(df, df.where("vec_id % 100 = 0"), **options).where("query_id = 100").orderBy("rank").collect()
        assert [(-r.score, r.vec_id) for r in got] == want
    assert topk.top_k(df, df.limit(0)).count() == 0


def test_shards_are_cut_in_rounds(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 1500, np.int64).astype(np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, 2, False)) for b in base]
    values = np.unique(np.array([*base.tolist(), *near], np.uint64)).view(np.int64)
    prints = spark.createDataFrame([(int(v),) for v in values], "fingerprint long")
    # few sampled points and leaves a round, so that later rounds have to go on; trees in several batches
    dealt = simhash.shards(prints, 2, 40, 128, 64)
    sizes = [r["count"] for r in dealt.groupBy("shard").count().collect()]
    assert max(sizes) <= 160 and len(sizes) > 30
    edges = simhash.near_edges(prints, target=40, sample_rows=128, tree_bytes=64)
    got = {r.node: r.component for r in connected_components(edges).collect()}
    d = np.bitwise_count(values.view(np.uint64)[:, None] ^ values.view(np.uint64)[None, :]) <= 2
    up = {int(v): int(v) for v in values}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in zip(*np.nonzero(np.triu(d, 1)), strict=True):
        a, b = sorted((root(int(values[i])), root(int(values[j]))))
        up[b] = a
    assert {n: got.get(n, n) for n in up} == {n: root(n) for n in up}


def test_one_document_of_each_group_by_text(spark):
    docs = [(1, "a b c d"), (1, "wholly other words here"), (1, "a b c d"), (2, "A  b c d"), (None, "alone it stands"), (None, "a b c d"), (3, None), (4, ""), (None, None), (5, "wholly other words here")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "2 as at", "3 as _key", "4 as group_rows", "5 as component_id")
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(1, "a b c d"), (1, "wholly other words here"), (None, "alone it stands"), (3, None)], key=repr)
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_substrings_beside_clashing_columns(spark):
    body = "".join(random.Random(1).choices("abcdef ", k=900))
    df = spark.createDataFrame([(1, body), (2, "x" + body), (3, None)], "doc_id long, text string").selectExpr("*", "1 as _r1", "2 as _r2", "3 as _runs", "'old' as kept")
    got = {r.doc_id: r for r in substrings.dedup_substrings(df).collect()}
    assert bytes(got[1].kept) == b"" and bytes(got[2].kept) == b"x" and (got[3].n_bytes, got[3]._r1, got[3]._r2, got[3]._runs) == (0, 1, 2, 3)


def test_items_that_share_an_id_are_one(spark):
    d = spark.createDataFrame([(1, "a b c x y z")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c"), (1, "x y z"), (2, "x y")], "item_id long, text string")
    r = decontaminate.contamination_report(d, b).first()
    assert (r.n_hit, r.n_items) == (6, 2)


def test_stages_on_empty_tables_nulls_repeats_and_clashing_columns(spark, tmp_path):
    sf = str(tmp_path)
    rng = random.Random(2)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(30))
    own = [text() for _ in range(6)]
    docs = [(0, own[0]), (1, own[1]), (1, own[2]), (1, own[1]), (None, own[3]), (None, own[3]), (2, None), (3, ""), (4, own[4] + "\n" + own[0].upper()), (5, "w " * 60_000 + own[5])]
    df = spark.createDataFrame([(d, t, "en" if t else None, "s", len(t or "")) for d, t in docs], DOCS)
    df = df.selectExpr("*", "'k' as toxicity", "'k' as Offending", "'k' as items", "'k' as n_words", "'k' as n_lines", "'k' as _gone", "'k' as n", "'k' as key")
    spark.createDataFrame([(0, 0, 1), (None, 0, 1), (4, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, own[5])], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, sf)
        if name != "mixing":
            assert out.columns == df.columns
            rows = out.collect()
            assert {v for r in rows for v in (r.toxicity, r.Offending, r["items"], r.n_words, r.n_lines, r._gone, r.n, r.key)} <= {"k"}
            kept[name] = sorted(((r.doc_id, r.text) for r in rows), key=repr)
        else:
            assert out.count() >= 0
        assert stage(spark, df.limit(0), sf).count() == 0
    # the only labelled class is 1, so every document with a sentence goes
    assert kept["toxicity"] == [(2, None), (3, "")]
    assert kept["line_dedup"] == sorted([(d, own[4] if d == 4 else t) for d, t in docs], key=repr)
    assert kept["near_dedup"] == sorted([(0, own[0]), (1, own[1]), (1, own[2]), (None, own[3]), (2, None), (4, docs[8][1]), (5, docs[9][1])], key=repr)
    assert kept["decontamination"] == sorted([x for x in docs if x[0] != 5], key=repr)

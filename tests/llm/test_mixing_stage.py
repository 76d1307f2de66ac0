"""The mixing stage's copies against its targets."""

import random

import corpus_pipeline
from lathe.llm import mixing
from pyspark.sql import functions as F


def test_mixed_tokens_follow_the_targets(spark):
    rng = random.Random(2)
    docs = []
    for i in range(12000):
        kind = rng.choices(["", " license", " token", " a@b.c"], [96, 2, 1, 1])[0]
        docs.append((i, " ".join(["w"] * 20) + kind, rng.choice(["en", "en", "en", "de"]), rng.choice("aaab"), 0))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.mix_sources(spark, df, "").cache()
    assert kept.agg(F.max("weight")).first()[0] > 2.5  # capped before
    for name, column in mixing.document_dims().items():
        share = lambda rows, c=column: {r.k: r.n for r in rows.groupBy(c.alias("k")).agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
        own, got = share(df), share(kept)
        power = {k: v**0.7 for k, v in own.items()}
        for k in own:
            want = power[k] / sum(power.values())
            assert abs(got[k] / sum(got.values()) - want) < 0.12 * want + 0.004, (name, k)
    assert abs(kept.count() / len(docs) - 0.5) < 0.03

"""Toxicity: held-out accuracy, located sentences and odd inputs."""

import random

from lathe.llm import toxicity
from pyspark.sql import functions as F


def corpus(n=600):
    rng = random.Random(4)
    clean = [f"{a}{b}" for a in "klmnprst" for b in ("ano", "eri", "uto", "ima")]
    bad = ["vexar" + x for x in ("", "us", "on", "il")]
    docs, labels = [], []
    for i in range(n):
        sentences = [" ".join(rng.choices(clean, k=rng.randint(3, 9))) for _ in range(rng.randint(1, 30))]
        toxic = i % 5 == 0
        if toxic:
            sentences[rng.randrange(len(sentences))] += f" {rng.choice(bad)} {rng.choice(clean)}"
        docs.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_offending_sentence(spark):
    docs, labels = corpus()
    rows = [*docs, (None, "Kano. VEXARUS leri"), (9001, None), (9002, ""), (9003, "kano " * 50_000 + ". vexaril"), docs[0]]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1), (3, None), (5, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity_report(d, lab).collect()
    assert len(got) == len(rows)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    texts = dict(docs)
    for r in held:
        if truth[r.doc_id] and r.predicted:
            assert "vexar" in texts[r.doc_id][r.worst_start : r.worst_end]
    odd = {r.doc_id: r for r in got if r.doc_id is None or r.doc_id > 9000}
    assert odd[None].predicted == 1 and odd[None].held_out is False
    assert odd[9001].score == odd[9002].score == 0.0
    assert odd[9003].predicted == 1 and odd[9003].worst_start == 250_001


def test_no_labels_one_class_and_no_rows(spark):
    docs, labels = corpus(40)
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.toxicity_report(d, lab.limit(0)).collect()} == {0}
    assert {r.predicted for r in toxicity.toxicity_report(d, lab.where("toxic = 0")).collect()} == {0}
    assert {r.predicted for r in toxicity.toxicity_report(d, lab.where("toxic = 1")).collect()} == {1}
    assert toxicity.toxicity_report(d.limit(0), lab).count() == 0
    clash = toxicity.score_documents(d.withColumn("toxicity", F.lit("x")), toxicity.fit(d, lab))
    assert clash.schema["toxicity"].dataType.simpleString() == "double" and clash.count() == 40

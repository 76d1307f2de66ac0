"""Toxicity by multiple-instance learning: sentence scores under a noisy-or, trained from document labels."""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.llm.common import stored

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")


def features(word: str, bits: int) -> list[int]:
    """Hashed features of a lower-cased word: the word, and its first 4, 5 and 6 letters where it is longer."""
    mask = (1 << bits) - 1
    out = [zlib.crc32(b"w" + word.encode("utf-8", "surrogatepass")) & mask]
    for n in (4, 5, 6):
        if len(word) >= n:
            out.append(zlib.crc32(b"p%d" % n + word[:n].encode("utf-8", "surrogatepass")) & mask)
    return out


def folded(text: str) -> str:
    """Lower case, of the same length: the one letter that becomes two is folded to its first before, so offsets hold for the text as it is."""
    return text.replace("\u0130", "i").lower()


def sentences(text: str):
    """(start, end) of every sentence that holds a word; whole text, offsets in code points."""
    return [m.span() for m in SENTENCE.finditer(text)]


@dataclass
class Model:
    """Sentence logit: ``bias`` plus the weights of the features of its distinct words."""

    weights: np.ndarray
    bias: float
    bits: int

    def scorer(self, memo_words: int = 200_000):
        """A function text -> (score, [(start, end, sentence score)] for all sentences); words are scored once while they fit in the memo."""
        memo: dict[str, float] = {}
        weights, bits, bias, exp = self.weights, self.bits, self.bias, math.exp

        def word_score(w):
            got = memo.get(w)
            if got is None:
                if len(memo) >= memo_words:
                    memo.clear()
                got = memo[w] = float(sum(weights[f] for f in features(w, bits)))
            return got

        def score(text):
            found, log_clean, lowered = [], 0.0, folded(text)
            for s, e in sentences(lowered):
                words = WORD.findall(lowered, s, e)
                if words:
                    z = bias
                    for w in set(words):
                        z += memo[w] if w in memo else word_score(w)
                    p = 1 / (1 + exp(-z)) if z > -30 else exp(z)
                    log_clean += math.log1p(-min(p, 1 - 1e-12))
                    found.append((s, e, p))
            return abs(math.expm1(log_clean)), found

        return score


def telling(in_toxic: np.ndarray, in_clean: np.ndarray, n_toxic: int, n_clean: int, z_least: float = 4.0) -> np.ndarray:
    """Whether toxic documents hold a feature more often than clean ones, by ``z_least`` standard errors."""
    n1, n0 = max(1, n_toxic), max(1, n_clean)
    both = (in_toxic + in_clean) / (n1 + n0)
    return in_toxic / n1 - in_clean / n0 > z_least * np.sqrt(both * (1 - both) * (1 / n1 + 1 / n0) + 1e-12)


def train(numbers: np.ndarray, sentence: np.ndarray, doc: np.ndarray, labels: np.ndarray, weights: np.ndarray, bits: int, epochs: int = 150, rate: float = 0.15, l2: float = 2e-6) -> Model:
    """Fit sentence weights by Adam on the document log-loss of ``1 - prod(1 - p_sentence)``.

    numbers, sentence: each feature and the sentence that holds it; doc: each
    sentence's document. weights: how many documents each one stands for.
    """
    n_sentences, n_docs, y = len(doc), len(labels), labels.astype(float)
    used, index = np.unique(numbers, return_inverse=True)
    share = weights / weights.sum()
    w, b = np.zeros(len(used)), -6.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, epochs + 1):
        z = b + np.bincount(sentence, w[index], n_sentences)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        log_clean = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), n_docs)
        prob = np.clip(-np.expm1(log_clean), 1e-9, 1 - 1e-9)
        g = share[doc] * np.where(y[doc] == 1, -(1 - prob[doc]) / prob[doc] * p, p)
        gw, gb = np.bincount(index, g[sentence], len(used)) + l2 * w, g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= rate * (mb / c1) / (math.sqrt(vb / c2) + 1e-8)
    full = np.zeros(1 << bits, np.float32)
    full[used] = np.where(np.abs(w) < 1e-3, 0, w)
    return Model(full, float(b), bits)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 2000, max_chars: int = 12_000_000, bits: int = 18, epochs: int = 150) -> Model:
    """Train on a bounded sample: at most ``max_rows`` labelled documents of each class, by hashed id, and ``max_chars`` characters.

    Rows of the held-out fold are left out, and so are documents of more than a
    hundredth of ``max_chars``; where the rest holds more than ``max_chars``
    characters, a share by hashed id is taken. A document labelled more than once
    counts as toxic if any label says so; null ids, labels and texts train
    nothing. Where one class is missing the model gives its share of one class,
    and without any label 0.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1) & ~is_held_out(F.col(doc_id))).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    known = stored(known)
    totals = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    if len(totals) < 2:
        return Model(np.zeros(1 << bits, np.float32), 20.0 if totals.get(1) else -20.0, bits)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = stored(known.where("y = 1").orderBy(*order).limit(max_rows).unionByName(known.where("y = 0").orderBy(*order).limit(max_rows)))
    sample = docs.where(F.col(doc_id).isNotNull() & (F.length(text) <= max_chars // 100)).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sample = stored(sample.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")))  # at most 2 * max_rows ids
    chars = sample.select(F.sum(F.length("text"))).first()[0] or 0
    if chars > max_chars:
        part = int(1e6 * max_chars / chars)
        sample = sample.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < part)

    def encode(batches):
        for batch in batches:
            feats, ends = [], []
            for t in batch.column(1):
                f, at = [], [0]
                lowered = folded(t.as_py())
                for s, e in sentences(lowered):
                    words = WORD.findall(lowered, s, e)
                    if words:
                        f += [x for w in set(words) for x in features(w, bits)]
                        at.append(len(f))
                feats.append(np.array(f, np.int32).tobytes())
                ends.append(np.diff(at).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(feats, pa.binary()), pa.array(ends, pa.binary())], names=["y", "f", "sizes"])

    def learn(batches):
        numbers, sizes, counts, ys = [], [], [], []
        seen = np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            for label, f, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if size:
                    numbers.append(np.frombuffer(f, np.int32))
                    sizes.append(np.frombuffer(size, np.int32))
                    counts.append(len(sizes[-1]))
                    ys.append(label)
                    seen[label, np.unique(numbers[-1])] += 1
        y = np.array(ys)
        if len(set(ys)) < 2:
            model = Model(np.zeros(1 << bits, np.float32), -20.0, bits)
        else:
            n1, n0 = int((y == 1).sum()), int((y == 0).sum())
            keep = telling(seen[1], seen[0], n1, n0)
            # only telling features go on, so the sample's bulk is let go document by document
            flat, inside, at = [], [], 0
            for f, size in zip(numbers, sizes, strict=True):
                kept = keep[f]
                flat.append(f[kept])
                inside.append(np.repeat(np.arange(at, at + len(size), dtype=np.int32), size)[kept])
                at += len(size)
            doc = np.repeat(np.arange(len(ys), dtype=np.int32), counts)
            model = train(np.concatenate(flat), np.concatenate(inside), doc, y, np.where(y == 1, totals[1] / n1, totals[0] / n0), bits, epochs)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], names=["weights", "bias"])

    # the bounded sample is learned from in one task, in the order of ids
    coded = sample.select("doc_id", "y", "text").repartition(1).sortWithinPartitions("doc_id").select("y", "text").mapInArrow(encode, "y int, f binary, sizes binary")
    learned = coded.mapInArrow(learn, "weights binary, bias double").first()
    if learned is None:  # no labelled document is there
        return Model(np.zeros(1 << bits, np.float32), -20.0, bits)
    return Model(np.frombuffer(learned.weights, np.float32), learned.bias, bits)


def score_documents(docs: DataFrame, model: Model, text: str = "text", at_least: float = 0.3, name: str = "toxicity") -> DataFrame:
    """Adds ``toxicity`` (0 to 1) and ``offending``: array of struct(start, end, score) of the sentences that score ``at_least``.

    Null and empty texts score as having no offending sentence, 0. Whole texts are
    scored; repeated rows stay; columns named like the new ones are replaced.
    """
    out = docs.drop(name, "offending")
    kept = out.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        score = shared.value.scorer()
        for batch in batches:
            scores, bad = [], []
            for t in batch.column(text):
                p, found = score(t.as_py() or "")
                scores.append(p)
                bad.append([{"start": s, "end": e, "score": q} for s, e, q in found if q >= at_least])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(scores, pa.float64()), pa.array(bad, arrow)], names=[*kept, name, "offending"])

    return out.mapInArrow(run, T.StructType([*out.schema.fields, T.StructField(name, T.DoubleType()), T.StructField("offending", T.ArrayType(span))]))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``op9``: one for every document row."""
    found = score_documents(docs.select("doc_id", "text"), fit(docs, labels))
    worst = F.array_max(F.transform("offending", lambda x: F.struct(x["score"].alias("score"), (-x["start"]).alias("s"), x["end"].alias("e"))))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"), F.size("offending").cast("long").alias("n_offending"), (-worst["s"]).alias("worst_start"), worst["e"].alias("worst_end"))

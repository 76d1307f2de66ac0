"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

import random

import corpus_pipeline
import numpy as np
from lathe.llm import shingles, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words_changed(text, n, rng):
    w = text.split()
    at = rng.randrange(len(w) - n)
    w[at : at + n] = [f"new{rng.randrange(10**6)}" for _ in range(n)]
    return " ".join(w)


def brute_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_copies_of_similarity_80_to_95_go(spark):
    rng = random.Random(4)
    make = lambda k: " ".join(f"w{rng.randrange(3000)}" for _ in range(k))
    base = [make(rng.randint(60, 400)) for _ in range(40)]
    texts = list(base)
    for t in base[:30]:
        n = len(t.split())
        texts += [words_changed(t, max(1, round(n * f) - 4), rng) for f in (0.02, 0.06, 0.1, 0.14, 0.25)]
    passage = make(70)  # shared by texts that are no near copies of each other
    texts += [passage + " " + make(30) for _ in range(40)] + [texts[2].upper(), None, "", " \n", "one two", "One  two", "one three"]
    docs = list(enumerate(texts)) + [(None, texts[0]), (3, texts[3])]
    sets = [brute_set(t) for t in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    between = 0
    for i, a in enumerate(sets):
        for j in range(i):
            s = len(a & sets[j]) / len(a | sets[j])
            between += 0.8 <= s <= 0.95
            if s >= 0.8:
                x, y = sorted((root(i), root(j)))
                up[y] = x
    assert between > 60
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS)
    kept = corpus_pipeline.drop_near_duplicates(spark, df, "").collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({root(i) for i in range(len(texts))})
    assert sum(r.doc_id is None for r in kept) == 0  # its text is that of id 0
    assert corpus_pipeline.drop_near_duplicates(spark, df.limit(0), "").count() == 0


def test_the_tree_over_simhashes_proposes_pairs(spark, monkeypatch):
    members_of = shingles.members_of
    monkeypatch.setattr(shingles, "members_of", lambda rows: members_of(rows.limit(0)))  # what the tree finds alone
    rng = random.Random(9)
    texts = []
    for k in (40, 400, 2500) * 4:
        base = " ".join(f"w{rng.randrange(3000)}" for _ in range(k))
        texts += [base, base.upper(), *(words_changed(base, n, rng) for n in (1, 1, 3, k // 5))]
    prints = [shingles.set_print(shingles.shingle_set(shingles.normal(t), 5)) for t in texts]
    sets = [brute_set(t) for t in texts]
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((up[i], up[j]))
                up = [low if x == high else x for x in up]
    got = {r.doc_id: r.component_id for r in shingles.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(up))
    assert len(set(up)) < len(set(map(str.lower, texts)))  # more than equal texts


def test_links_of_a_shard_lie_within_the_radius():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, np.uint64)
    points = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(30))]))
    links = simhash.near_links(points, 2, leaf=64)
    assert (np.bitwise_count(points[links[:, 0]] ^ points[links[:, 1]]) <= 2).all()
    assert len(links) == len(points) - 40

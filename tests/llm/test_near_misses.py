"""Pairs that share a passage and little else: what is spared before their edit distance, with the same links."""

import random

import numpy as np
from lathe.llm import buckets, lines


def test_common_ends_are_left_out_before_distances(monkeypatch):
    # before, pairs side by side were worked on with their common ends
    rng = random.Random(8)
    make = lambda n: "".join(rng.choices("abé漢", k=n))
    passage = make(300)
    pairs = [(make(k) + passage, make(k) + passage) for _ in range(60) for k in (20, 60, 200)]
    pairs += [(passage + make(50), passage + make(70)), (passage, passage), ("", ""), ("", "a"), ("aab", "aabaab"), ("ab" * 90, "ab" * 70)]
    sent = []
    plain = lines.edit_distances
    monkeypatch.setattr(lines, "edit_distances", lambda pairs, most: sent.extend(pairs) or plain(pairs, most))
    want = [lines.edit_similarity(a, b) >= 0.8 for a, b in pairs]
    assert lines.exactly_similar(pairs, 0.8) == want and 0 < sum(want) < len(want)
    assert len(sent) >= 100 and max(len(x) for p in sent for x in p) <= 200


def test_ends_are_found_whatever_their_length():
    rng = random.Random(9)
    for _ in range(3000):
        start, end, a, b = ("".join(rng.choices("ab", k=rng.randrange(n))) for n in (80, 80, 12, 12))
        a, b = start + a + end, start + b + end
        n = lines.shared_start(a, b)
        assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])
        x, y = lines.apart(a, b)
        assert not x or not y or (x[0] != y[0] and x[-1] != y[-1])
        assert lines.edit_distance(x, y, 400) == lines.edit_distance(a, b, 400)


def test_few_tables_give_the_same_as_many(monkeypatch):
    rng = random.Random(10)
    pairs = [("".join(rng.choices("abcdé", k=90)), "".join(rng.choices("abcdé" if k % 2 else "xyzüö", k=80 + k % 20))) for k in range(300)]
    pairs += [(a, a[:40] + "z" + a[45:]) for a, _ in pairs]
    want = [lines.edit_similarity(a, b) >= 0.8 for a, b in pairs]
    for size in (1 << 14, 1 << 18, 1 << 25):
        monkeypatch.setattr(lines, "TABLES", size)
        assert lines.exactly_similar(pairs, 0.8) == want and 0 < sum(want) < len(want)


def test_quick_is_tried_only_where_it_can_tell(spark):
    # before, quick was asked of every pair that was not ruled out
    df = spark.createDataFrame([(i, 10, bytes(8), [1]) for i in range(6)], "id long, size long, sketch binary, blocks array<long>")
    members = buckets.members_of(spark.createDataFrame([(1, i, 0) for i in range(6)], "block long, id long, sim long"), 2)
    groups = spark.createDataFrame([], "node long, component long")
    payload = lambda ids: ids.select("id", ids.id.cast("string").alias("payload"))
    outline = lambda texts: np.array([[int(x)] for x in texts])
    at_most = lambda one, many: np.where((np.minimum(one, many)[:, 0] < 2) & (np.maximum(one, many)[:, 0] < 2), 0.95, np.where(np.maximum(one, many)[:, 0] < 4, 0.85, 0.5))

    def quick(x, y):
        if int(x) > 1 or int(y) > 1:
            raise ValueError("a pair that quick can't tell")
        return True

    def exact(pairs):
        if any(int(x) > 3 or int(y) > 3 for x, y in pairs):
            raise ValueError("a pair that was ruled out before")
        return [True] * len(pairs)

    got = buckets.settled(members, groups, df, payload, lines.nearby(2), quick, exact, 0.8, 4096, outline, at_most).collect()
    up = {i: i for i in range(6)}
    for a, b in got:
        up = {k: up[a] if v == up[b] else v for k, v in up.items()}
    assert len({up[i] for i in range(4)}) == 1 and up[4] != up[5] != up[0] != up[4]

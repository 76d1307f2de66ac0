"""Pairs of a bucket that are settled one by one: what is ruled out before, and that nothing is lost by it."""

import random

import numpy as np
import pyarrow as pa
from lathe.llm import buckets, lines


def changed(rng, a, most):
    b = list(a)
    for _ in range(rng.randint(0, most)):
        k = rng.randrange(len(b))
        b[k : k + 1] = rng.choice([[], ["x"], [b[k], "y"]])
    return "".join(b)


def test_letters_rule_out_no_similar_pair():
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdefghij klmé漢\ud800\U0001f600", k=rng.choice([1, 5, 20, 100, 400]))) for _ in range(400)]
    pairs = [(a, changed(rng, a, len(a) // 3)) for a in texts] + list(zip(texts, rng.sample(texts, 400), strict=True)) + [("", ""), ("", "a")]
    allow = lines.letters_allow(0.8)
    one, other = (lines.letter_counts([p[k] for p in pairs]) for k in (0, 1))
    assert one.sum(axis=1).tolist() == [len(a) for a, _ in pairs]
    may = allow(one, other).tolist()
    similar = [lines.edit_similarity(a, b) >= 0.8 for a, b in pairs]
    assert all(m for m, s in zip(may, similar, strict=True) if s) and sum(similar) > 200
    assert sum(may[400:800]) < 200  # of unrelated pairs most go
    assert allow(one[0], other).tolist() == [bool(allow(one[:1], other[k : k + 1])[0]) for k in range(len(pairs))]


def test_pairs_beyond_their_limit_go_early(monkeypatch):
    # before, all pairs were worked on until the last one ended
    rng = random.Random(5)
    make = lambda n: "".join(rng.choices("abcdefgh é", k=n))
    pairs = [(make(400), make(rng.randint(360, 400))) for _ in range(200)]
    a = make(400)
    pairs[77] = (a, "x" + a[:200] + "zz" + a[201:380] + "q")
    alone = []
    plain = lines.edit_distance
    monkeypatch.setattr(lines, "edit_distance", lambda *x: alone.append(x) or plain(*x))
    got = lines.edit_distances(pairs, 80).tolist()
    assert len(alone) == 1 and set(alone[0][:2]) == set(pairs[77])
    assert [k for k, d in enumerate(got) if d <= 80] == [77] and got[77] == plain(*pairs[77], 80)
    for limits in (np.array([rng.choice([0, 10, 90, 300]) for _ in pairs]), 500):
        got = lines.edit_distances(pairs, limits)
        want = np.array([plain(*p, 500) for p in pairs])
        assert (np.where(got <= limits, got, -1) == np.where(want <= limits, want, -1)).all()


def test_small_and_large_buckets_give_the_links_of_all_pairs(spark):
    rng = random.Random(7)
    points = [(i, rng.randint(9, 12), rng.getrandbits(3), [rng.choice([1, 2, 3]), rng.choice([11, 12, *range(20, 60)]), 100 + i // 2]) for i in range(120)]
    df = spark.createDataFrame([(i, n, s.to_bytes(8, "little"), b) for i, n, s, b in points], "id long, size long, sketch binary, blocks array<long>")
    members = buckets.members_of(spark.createDataFrame([(b, i, s) for i, _, s, bs in points for b in bs], "block long, id long, sim long"), 2)
    payload = lambda ids: ids.select("id", (ids.id % 5).cast("string").alias("payload"))
    groups = spark.createDataFrame([(k, 0) for k in range(9)], "node long, component long")
    same = lambda i, j: i % 5 == j % 5

    def closed(links):
        up = {i: 0 if i < 9 else i for i in range(120)}
        for a, b in links:
            x, y = up[a], up[b]
            up = {k: x if v == y else v for k, v in up.items()}
        return {frozenset(k for k in up if up[k] == v) for v in up.values()}

    near = lambda p, q: (p[2] ^ q[2]).bit_count() <= 2 and min(p[1], q[1]) >= 0.8 * max(p[1], q[1]) and set(p[3]) & set(q[3])
    want = closed([(p[0], q[0]) for p in points for q in points[: p[0]] if near(p, q) and same(p[0], q[0])])
    outline = lambda texts: np.array([[int(x)] for x in texts])
    allowed = lambda one, many: (many == one).all(axis=1)

    def exact(pairs):
        if any(x != y for x, y in pairs):
            raise ValueError("a pair that was ruled out before")
        return [True] * len(pairs)

    for few, crowd in ((1, 4096), (64, 4096), (8, 4096), (8, 5)):
        more = buckets.settled(members, groups, df, payload, lines.nearby(2), lambda x, y: None, exact, 0.8, crowd, outline, allowed, few)
        assert closed([tuple(r) for r in more.collect()]) == want and len(want) < 100


def test_small_groups_come_together():
    rows = [(b, i) for b, n in enumerate([1, 5, 1, 9, 2, 1]) for i in range(n)]
    for size in (1, 2, 3, 7, 50):
        parts = [pa.RecordBatch.from_pylist([dict(zip("ab", r, strict=True)) for r in rows[i : i + size]]) for i in range(0, len(rows), size)]
        assert [t.num_rows for t in buckets.groups_of(parts, 1, 6)] == [6, 10, 3]
        assert [t.num_rows for t in buckets.groups_of(parts, 1, 99)] == [19]


def test_members_are_found_whatever_is_read_at_a_time(spark):
    # before, each block of a row was a row of the shuffle
    rng = random.Random(4)
    rows = [(i, [rng.choice((-5, 7)), *{rng.randrange(-150, 150) for _ in range(rng.randint(0, 5))} - {-5, 7}], rng.getrandbits(64) - (1 << 63) if i % 3 else -1 - rng.getrandbits(2)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, blocks array<long>, sim long").repartition(5)
    where = {}
    for i, blocks, sim in rows:
        for b in blocks:
            where.setdefault(b, {})[i] = sim
    many = {b: ids for b, ids in where.items() if len(ids) > 1}
    assert len(many) < len(where)
    for radius in (20, None):
        for most in (1, 40, 1 << 20):
            got = [tuple(r) for r in buckets.members_of(df, radius, most).collect()]
            heads = {b: h for b, _, h, _ in got}
            assert all(heads[b] == h for b, _, h, _ in got)
            assert sorted((b, i) for b, i, _, _ in got) == sorted((b, i) for b, ids in many.items() for i in ids)
            assert all(near == (i != h and (radius is None or ((many[b][i] ^ many[b][h]) & (1 << 64) - 1).bit_count() <= radius)) for b, i, h, near in got)
            assert most == 1 or most == 40 or all(h == min(many[b]) for b, h in heads.items())
    packs = [len(r["rows"]) for r in buckets.packed(df, 4, 3).collect()]
    assert sum(packs) == 24 * sum(len(b) for _, b, _ in rows) and len(packs) <= 5 * 4

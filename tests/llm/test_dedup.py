"""Substring and line dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
from lathe.llm import buckets, lines, substrings


def brute_cut(docs, length):
    data = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for d, b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int(np.sum(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=repr)


def report(df, **options):
    from pyspark.sql import functions as F

    found = substrings.dedup_substrings(df, **options)
    rows = found.select("doc_id", "n_bytes", F.col("n_bytes") - F.octet_length("kept"), F.size("removed") / 2, F.sha2("kept", 256)).collect()
    return sorted(((r[0], r[1], r[2], int(r[3]), r[4]) for r in rows), key=repr)


def texts(seed, n, alphabet="abcdeé "):
    rng = random.Random(seed)
    make = lambda k: "".join(rng.choices(alphabet, k=k))
    out = [make(rng.randint(0, 900)) for _ in range(n)]
    passages = [make(rng.randint(60, 300)) for _ in range(6)]
    for i in range(0, n, 2):
        p = rng.choice(passages)
        cut = rng.randint(0, len(out[i]))
        out[i] = out[i][:cut] + p[rng.randint(0, 5) : len(p) - rng.randint(0, 5)] + out[i][cut:]
    for i in range(1, n, 5):
        t = out[i - 1]
        k = rng.randint(0, max(0, len(t) - 1))
        out[i] = t[:k] + "#" + t[k + 1 :]
    return out


def test_substrings_equal_brute_force(spark):
    body = texts(1, 60)
    odd = [None, "", "x", "a" * 700, "ab" * 400, "a" * 41, body[3], body[3], body[5] + body[5], "thue" * 30]
    docs = list(enumerate(body + odd)) + [(None, body[7]), (3, body[3]), (3, body[3])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_cut(docs, 40)
    assert sum(x[2] for x in want) > 5000
    assert report(df, length=40, reach=16) == want
    assert report(df, length=40, reach=16, crowd=2) == want  # crowded buckets settled by blocks
    assert report(df, length=40, reach=25) == want
    assert report(df.limit(0), length=40, reach=16) == []


def test_substrings_at_their_own_length(spark):
    rng = random.Random(2)
    make = lambda k: "".join(rng.choices("abcdefgh ", k=k))
    shared = [make(k) for k in (399, 400, 401, 1500)]
    docs = [(i, make(rng.randint(0, 3000)) + rng.choice(shared) + make(rng.randint(0, 800))) for i in range(40)]
    docs += [(100, docs[0][1]), (101, docs[1][1][:-1] + "é"), (102, make(1_100_000) + shared[3])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n_bytes", "'x' as kept", "2 as _runs_")
    got = sorted((tuple(r) for r in substrings.substring_report(df).collect()), key=repr)
    assert got == brute_cut(docs, 400)


def plain_form(line):
    """The normal form, spelled out: A-Z lower-cased, digits 0, other ASCII a space, single spaces."""
    kept = (c.lower() if "A" <= c <= "Z" else "0" if c in "0123456789" else c if "a" <= c <= "z" or ord(c) > 127 else " " for c in line)
    return " ".join(x for x in "".join(kept).split(" ") if x)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def brute_kept(docs):
    """What stays of each (id, text): lines in order, the first occurrence of every group linked by edit similarity 0.8; no fingerprint in between."""
    spots = []
    for d, t in dict.fromkeys(docs):
        spots += [((d is not None, d or 0), t, k, plain_form(x)) for k, x in enumerate(t.split("\n") if t else [])]
    keys = sorted({s[3] for s in spots if s[3]})
    up = {k: k for k in keys}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    long = [k for k in keys if len(k.split()) >= 5 or len(k.replace(" ", "")) >= 20]
    for i, a in enumerate(long):
        for b in long[:i]:
            if root(a) != root(b) and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and lines.edit_similarity(a, b) >= 0.8:
                up[root(a)] = root(b)
    first = {}
    for s in sorted((s for s in spots if s[3]), key=lambda s: (s[0], s[2])):
        first.setdefault(root(s[3]), s[:3])
    return {(d, t): None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if not plain_form(x) or first[root(plain_form(x))] == ((d is not None, d or 0), t, k)) for d, t in docs}


def test_edit_similarity_equals_a_plain_distance():
    rng = random.Random(12)
    for _ in range(400):
        a = " ".join(rng.choices(["ab", "abc", "b", "é", "cab"], k=rng.randint(0, 12)))
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 2)] = rng.choices("abcé ", k=rng.randint(0, 3))
        b = "".join(b)
        n, d = max(len(a), len(b)), plain_distance(a, b)
        assert lines.edit_similarity(a, b) == (1 - d / n if n else 1.0)
        assert lines.quickly_similar(a, b, 0.8) in (None, lines.edit_similarity(a, b) >= 0.8)
        assert lines.alignment_cost(a.split(" "), b.split(" "), 1e9) >= d


def test_distances_side_by_side_equal_a_plain_distance():
    rng = random.Random(13)
    make = lambda k: "".join(rng.choices("abcdé 漢字\U0001f600", k=k))
    pairs = [(make(rng.choice([0, 1, 5, 63, 64, 65, 127, 128, 129, 200])), make(rng.choice([0, 1, 5, 63, 64, 65, 128, 190]))) for _ in range(120)]
    for a, _ in pairs[:60]:
        b = list(a)
        for _ in range(rng.randint(0, 20)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 2)] = rng.choices("abc ", k=rng.randint(0, 2))
        pairs.append((a, "".join(b)))
    want = [plain_distance(a, b) for a, b in pairs]
    for words in range(4):
        some = [i for i, (a, _) in enumerate(pairs) if (len(a) - 1) // 64 == words]
        for most in (0, 10, 30, 70, 500):
            got = lines.edit_distances([pairs[i] for i in some], most).tolist()
            assert [d if d <= most else None for d in got] == [want[i] if want[i] <= most else None for i in some]
    assert lines.exactly_similar(pairs, 0.8) == lines.exactly_similar(pairs, 0.8, least=2) == [1 - d / max(len(a), len(b), 1) >= 0.8 for (a, b), d in zip(pairs, want, strict=True)]
    assert lines.exactly_similar([], 0.8) == []


def test_lines_equal_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(30, 60))) for _ in range(50)]
    docs = []
    for i in range(120):
        chosen = []
        for _ in range(rng.randint(0, 6)):
            w = rng.choice(base).split()
            if rng.random() < 0.5:
                k = rng.randrange(len(w))
                w[k] = w[k] + rng.choice("xyz")
            chosen.append(" ".join(w).title() + rng.choice(["", ".", " 1", " 2", "!"]))
        docs.append((i, "\n".join([*chosen, "short line", ""])))
    docs += [(200, None), (201, ""), (202, "\n\n"), (None, docs[0][1]), (5, docs[5][1]), (203, ("very long words here now " * 400) + "\n" + base[0])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'old' as n_removed", "'keep' as _id", "'keep' as _doc", "'keep' as hash", "'keep' as _gone")
    want = brute_kept(docs)
    for options in ({}, {"broadcast_bytes": -1, "crowd": 3}):  # removals broadcast, and joined by a shuffle; blocks in many parts
        got = lines.dedup_lines(df, **options).collect()
        assert len(got) == len(docs)
        assert {(r._id, r._doc, r.hash, r._gone) for r in got} == {("keep",) * 4}
        texts = {}
        for d, t in docs:
            texts.setdefault(d, t)
        assert {r.doc_id: r.text for r in got} == {d: want[(d, t)] for d, t in texts.items()}
        by_id = {r.doc_id: r for r in got}
        assert by_id[200].text is None and by_id[200].n_lines == 0
        assert by_id[201].text == "" and by_id[202].text == "\n\n"
        assert all(r.text.count("\n") + 1 == r.n_lines - r.n_removed for r in got if r.text and r.n_removed < r.n_lines)
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_line_hashes_equal_a_plain_count():
    rng = random.Random(8)
    made = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(1, 700))).encode() for _ in range(60)] + [b"one", ("é " * 3000).strip().encode()]
    for line, got in zip(made, lines.simhashes(made), strict=True):
        h, _ = lines.word_hashes(np.frombuffer(line + b"\n", np.uint8))
        h = h.tolist()
        assert len(h) == len(line.split()) and len(set(h)) == len(set(line.split()))
        assert int(got) == sum((2 * sum(f >> b & 1 for f in h) > len(h)) << b for b in range(64))


def test_links_that_a_star_leaves_out_are_found(spark):
    # the first of the block is near neither of the others, which are near each other; in two blocks the pair is looked at once
    points = [(0, 40, 1, [7, 8]), (1, 40, 0, [7, 8]), (2, 40, 3, [7, 8]), (3, 40, (1 << 40) - 1, [7, 9]), (4, 20, 3, [7, 10]), (5, 40, 3, [11, 12])]
    df = spark.createDataFrame([(i, n, (s).to_bytes(8, "little"), b) for i, n, s, b in points], "id long, size long, sketch binary, blocks array<long>")
    rows = spark.createDataFrame([(b, i, s) for i, _, s, bs in points for b in bs], "block long, id long, sim long")
    members = buckets.members_of(rows, 2)
    assert sorted(tuple(r) for r in members.collect()) == [(7, 0, 0, False), (7, 1, 0, True), (7, 2, 0, True), (7, 3, 0, False), (7, 4, 0, True), (8, 0, 0, False), (8, 1, 0, True), (8, 2, 0, True)]
    assert sorted(tuple(r) for r in buckets.stars(members).collect()) == [(0, 1), (0, 2), (0, 4)]
    texts = {0: "a", 1: "b", 2: "b", 3: "b", 4: "b", 5: "b"}
    payload = lambda ids: ids.join(spark.createDataFrame(list(texts.items()), "id long, payload string"), "id")
    groups = spark.createDataFrame([], "node long, component long")
    for crowd, quick, exact in ((4096, lambda x, y: x == y, None), (1, lambda x, y: None, lambda pairs: [x == y for x, y in pairs])):
        more = buckets.settled(members, groups, df, payload, lines.nearby(2), quick, exact or list, 0.8, crowd)
        assert [tuple(sorted(r)) for r in more.collect()] == [(1, 2)]
    linked = spark.createDataFrame([(k, 0) for k in range(5)], "node long, component long")
    assert buckets.settled(members, linked, df, payload, lines.nearby(2), quick, exact, 0.8) is None


def test_rows_of_a_bucket_over_many_batches():
    import pyarrow as pa

    rows = [(b, b % 2, i) for b, n in enumerate([1, 5, 1, 9, 2, 1]) for i in range(n)]
    for size in (1, 2, 3, 7, 50):
        parts = [pa.RecordBatch.from_pylist([dict(zip("abc", r, strict=True)) for r in rows[i : i + size]]) for i in range(0, len(rows), size)]
        got = [t.num_rows for t in buckets.groups_of(parts, 2)]
        assert got == [1, 5, 1, 9, 2, 1]

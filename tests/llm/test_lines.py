"""op8's own settings against brute-force edit similarity, without any fingerprint in between."""

import random

import numpy as np
from lathe.llm import lines

WORDS = [f"{a}{b}{c}{d}" for a in "bdfgklm" for b in "aeiou" for c in ("n", "rt", "st") for d in ("", "ing", "ed", "ous")]


def brute_removed(docs, fuzzy):
    """Lines that go: all but one of each group linked by edit similarity 0.8; ``fuzzy`` says which lines take part in such links."""
    spots = [(k, b" ".join(lines.normal_words(x)).decode()) for k, t in docs for x in t.split("\n")]
    keys = sorted({x for _, x in spots if x})
    up = {k: k for k in keys}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if fuzzy(a) and fuzzy(b) and lines.edit_similarity(a, b) >= 0.8:
                up[root(a)] = root(b)
    return sum(1 for _, x in spots if x) - len({root(k) for k in keys})


def test_lines_with_words_changed_go(spark):
    rng = random.Random(3)
    base = [rng.choices(WORDS, k=rng.randint(10, 60)) for _ in range(60)]
    texts = []
    for w in base:
        for _ in range(3):
            v = list(w)
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                k = rng.randrange(len(v))
                v[k : k + 1] = rng.choice([[], [rng.choice(WORDS)], [v[k], rng.choice(WORDS)]])
            texts.append(" ".join(v))
    rng.shuffle(texts)
    docs = [(i, "\n".join(texts[i * 4 : i * 4 + 4])) for i in range(len(texts) // 4)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_removed(docs, lambda x: True)
    removed = lambda found: sum(r.n_removed for r in found.select("n_removed").collect())
    assert 0.97 * want <= removed(lines.line_report(df)) <= want and want > 100


def test_short_lines_and_lines_without_spaces_go(spark):
    rng = random.Random(8)
    chinese = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(k)) for k in (3, 8, 30, 45, 60)]
    near = [x[:12] + "一" + x[13:] for x in chinese[2:]]
    docs = [(i, "\n".join(["Home", "Log in!", "", "--", f"Page {i}", *rng.sample(chinese, 3), "Homf" if i else "home"])) for i in range(6)]
    docs += [(6, "\n".join([*chinese, *near])), (7, "Log in\n\nlog out")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in lines.dedup_lines(df).collect()}
    want = brute_removed(docs, lambda x: len(x.split()) >= 5 or len(x.replace(" ", "")) >= 20)
    assert sum(r.n_removed for r in got.values()) == want
    assert got[7].text == "\nlog out"  # an equal line goes, a blank one and a similar short one stay
    assert not any(x in r.text.split("\n") for r in got.values() for x in near)


def test_recall_of_pairs_against_all_pairs(spark):
    # every pair of similarity 0.8 or more, changed by one word up to a sixth of the words: 9 in 10 or more share a block and lie within the radius
    rng = random.Random(5)
    found = total = 0
    for _ in range(300):
        a = rng.choices(WORDS, k=rng.randint(8, 80))
        b = list(a)
        for _ in range(rng.randint(1, max(1, len(a) // 6))):
            k = rng.randrange(len(b))
            b[k : k + 1] = rng.choice([[], [rng.choice(WORDS)], [rng.choice(WORDS)], [b[k], rng.choice(WORDS)]])
        pair = [" ".join(x).encode() for x in (a, b)]
        if lines.edit_similarity(pair[0].decode(), pair[1].decode()) >= 0.8:
            bands = np.zeros((2, lines.BANDS), np.uint32)
            x, y = lines.simhashes(pair, bands).tolist()
            total += 1
            found += (x ^ y).bit_count() <= 14 and bool((bands[0] == bands[1]).any())
    assert total > 150 and found >= 0.9 * total


def test_lines_of_all_sizes_are_compared_side_by_side(monkeypatch):
    rng = random.Random(6)
    pairs = []
    for n in range(40, 440, 2):
        a = [rng.choice("abcde é") for _ in range(n)]
        b = list(a)
        for _ in range(rng.randint(0, n // 3)):
            k = rng.randrange(len(b))
            b[k : k + 1] = rng.choice([[], ["x"], [b[k], "y"]])
        pairs.append(("".join(a), "".join(b)))
    want = [lines.edit_similarity(*p) >= 0.8 for p in pairs]
    alone = []
    plain = lines.edit_similarity
    monkeypatch.setattr(lines, "edit_similarity", lambda a, b: alone.append(a) or plain(a, b))
    assert lines.exactly_similar(pairs, 0.8) == want and 0 < sum(want) < len(want)
    assert len(alone) < 32  # before, each size of 64 characters needed 128 pairs of its own


def test_long_lines_are_compared_along_their_diagonals(monkeypatch):
    rng = random.Random(9)

    def pair(n):
        a = [rng.choice("abcde é漢") for _ in range(n)]
        b = list(a)
        for _ in range(rng.randint(0, n // 3)):
            k = rng.randrange(len(b))
            b[k : k + 1] = rng.choice([[], ["x"], [b[k], "y"]])
        return rng.sample(["".join(a), "".join(b)], 2)

    together = []
    plain = lines.edit_distances
    monkeypatch.setattr(lines, "edit_distances", lambda pairs, most: together.append(len(pairs)) or plain(pairs, most))
    for n, count, sides in ((1500, 40, []), (90, 200, [200])):  # before, 40 long pairs went side by side, which takes several times as long
        pairs = [pair(n) for _ in range(count)]
        want = [lines.edit_similarity(*p) for p in pairs]
        assert lines.exactly_similar(pairs, 0.8) == [s >= 0.8 for s in want] and 0 < sum(s >= 0.8 for s in want) < count
        assert together == sides
        sizes = [max(map(len, p)) for p in pairs]
        true = [round((1 - s) * k) for s, k in zip(want, sizes, strict=True)]
        limits = [rng.choice([0, 5, 63, 64, d, max(d - 1, 0), k // 5]) for d, k in zip(true, sizes, strict=True)]
        for found in (plain(pairs, np.array(limits)).tolist(), [lines.edit_distance(*p, most) for p, most in zip(pairs, limits, strict=True)]):
            assert [d if d <= most else None for d, most in zip(found, limits, strict=True)] == [d if d <= most else None for d, most in zip(true, limits, strict=True)]


def test_lines_of_many_texts_are_normalised_together():
    rng = random.Random(8)
    texts = [b"\n", b" ", b"a\n\n b, c\n", b"\n..\n7\r\n", "é 漢字\ud800\nX".encode("utf-8", "surrogatepass"), *("".join(rng.choice("aB \n.\té漢\U0001f6007") for _ in range(rng.randint(1, 60))).encode() for _ in range(2000))]

    def one_by_one(texts):
        for i, t in enumerate(texts):
            for k, line in enumerate(t.split(b"\n")):
                if words := lines.normal_words(line):
                    yield b" ".join(words), i, k, len(words), len(b" ".join(words).decode("utf-8", "surrogatepass"))

    for some in (texts, *([t] for t in texts[:50])):
        norms, *rest = lines.normal_lines(some)
        assert [*zip(norms, *(x.tolist() for x in rest), strict=True)] == [*one_by_one(some)]


def test_alignment_goes_on_after_a_longer_passage():
    # before, seven changed words in a row ended the alignment, and edit distance decided
    rng = random.Random(2)
    line = [rng.choice(WORDS) for _ in range(80)]
    other = [*line[:20], *(rng.choice(WORDS) for _ in range(7)), *line[27:]]
    assert lines.quickly_similar(" ".join(line), " ".join(other), 0.8) is True
    for _ in range(300):
        a = [rng.choice(WORDS[:12]) for _ in range(rng.randint(1, 20))]
        b = [w if rng.random() < 0.7 else rng.choice(WORDS[:12]) for w in a if rng.random() < 0.9] + [rng.choice(WORDS)] * rng.randint(0, 3)
        x, y = " ".join(a), " ".join(b)
        bound = lines.alignment_cost(x.split(" "), y.split(" "), 1e9)
        assert bound >= lines.edit_distance(x, y, 1000)

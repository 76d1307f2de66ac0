"""Fuzzy line dedup: SimHash of normalised lines, blocks that similar lines share, edit similarity, one occurrence a group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.llm.buckets import members_of, settled, stars
from lathe.llm.common import beside_few, let, sized_broadcast, spare, stored, tidy, with_counted
from lathe.llm.components import connected_components

#: A-Z is lower-cased, digits become 0, other ASCII becomes a space; beyond ASCII bytes stay.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else 32 for b in range(256))


def normal_words(line: str | bytes) -> list[bytes]:
    return (line.encode("utf-8", "surrogatepass") if isinstance(line, str) else line).translate(NORMAL).split()


WORDS = NORMAL[:10] + b"\n" + NORMAL[11:]


def normal_lines(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The normalised lines of all texts, without those that hold no word; of each its text, its number there, its words and its code points."""
    blob = (b"\n".join(texts) + b"\n").translate(WORDS)
    codes = np.frombuffer(blob, np.uint8)
    inside = np.concatenate(([False], codes > 32))
    ends, breaks = np.flatnonzero(inside[:-1] & ~inside[1:]), np.flatnonzero(codes == 10)
    line_ends = np.searchsorted(breaks, np.cumsum([len(t) + 1 for t in texts]) - 1) + 1  # the lines up to the end of each text
    line_starts = np.concatenate(([0], line_ends[:-1]))
    of = np.repeat(np.arange(len(texts)), line_ends - line_starts)
    up_to = np.searchsorted(ends, breaks, "right")  # the words up to the end of each line
    words = np.diff(up_to, prepend=0)
    held = np.flatnonzero(words)
    codes = codes[inside[1:] | inside[:-1]]  # each word and one letter after it
    stops = np.flatnonzero(codes <= 32)
    codes[stops] = 32
    stops = stops[up_to[held] - 1]
    codes[stops] = 10
    points = stops - np.searchsorted(np.flatnonzero(codes.view(np.int8) < -64), stops)  # less bytes that continue a code point
    return codes.tobytes().split(b"\n")[:-1], of[held], held - line_starts[of[held]], words[held], np.diff(points, prepend=-1) - 1


# The eight bits of a byte, each in an 8-bit lane of its own.
LANES = np.array([sum((d >> b & 1) << 8 * b for b in range(8)) for d in range(256)], np.uint64)
BASE = 0x9E3779B97F4A7C15
SPAN = 240  # words summed in one lane stay below 256
TABLES = 32 << 20  # bytes of letters' positions, for pairs side by side


FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # of the bytes of a little-endian word the first k


def word_hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and how many words end with each line; words end with a space, lines with a newline. Eight bytes of all words are mixed in at a time."""
    ends = np.flatnonzero(text <= 32)
    starts = np.concatenate(([0], ends[:-1] + 1))
    sizes = ends - starts
    eight = np.ndarray(len(text) + 1, "<u8", np.concatenate((text, np.zeros(8, np.uint8))).data, 0, 1)

    def mixed(h, at, left):
        h = (h ^ (eight[at] & FIRST[np.minimum(left, 8)])) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ h >> np.uint64(32)

    h, done = mixed((sizes + 1).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), starts, sizes), 8
    while len(longer := np.flatnonzero(sizes > done)):
        h[longer] = mixed(h[longer], starts[longer] + done, sizes[longer] - done)
        done += 8
    h *= np.uint64(BASE)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h, np.diff(np.concatenate(([0], np.flatnonzero(text[ends] == 10) + 1)))


def hashed_form(line: bytes, min_words: int, min_chars: int = 20) -> bytes | None:
    """What a normalised line is fingerprinted by: its words, or its characters where it has few words but many characters; None if it has few of both."""
    if line.count(b" ") + 1 >= min_words:
        return line
    chars = line.replace(b" ", b"").decode("utf-8", "surrogatepass")
    return " ".join(chars).encode("utf-8", "surrogatepass") if len(chars) >= min_chars else None


BANDS, ROWS = 8, 3
BAND_PAIRS = [f"bands_{i}" for i in range(0, BANDS, 2)]  # columns of two bands each, of 32 bits, the first one low
_rng = np.random.default_rng(5)
MULTIPLY, ADD = _rng.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1), _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32)


def minhash_bands(pairs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of ``BANDS`` keys for each line: hashes of ``ROWS`` minima each over the line's pairs of neighbours."""
    high, out = (pairs >> np.uint64(32)).astype(np.uint32), np.zeros((len(starts), BANDS), np.uint64)
    mixed = np.empty_like(high)
    for i, (m, a) in enumerate(zip(MULTIPLY, ADD, strict=True)):
        np.add(np.multiply(high, m, out=mixed), a, out=mixed)
        least = np.minimum.reduceat(mixed, starts).astype(np.uint64)
        out[:, i // ROWS] = (out[:, i // ROWS] * np.uint64(BASE) ^ least) * np.uint64(0xD6E8FEB86659FD93)
    return (out >> np.uint64(32)).astype(np.uint32)


def simhashes(lines: list[bytes], bands: np.ndarray | None = None) -> np.ndarray:
    """64-bit SimHash of each line's words, repeats included; lines are words joined by single spaces.

    bands: filled with the MinHash bands of the lines' pairs of neighbours, the last word paired with the end, if given.
    """
    out = np.zeros(len(lines), np.uint64)
    at = 0
    while at < len(lines):  # so much at a time that its lanes, about eleven times that, stay in a core's cache
        end, n = at, 0
        while end < len(lines) and (n < 1 << 17 or end == at):
            n += len(lines[end])
            end += 1
        values, sizes = word_hashes(np.frombuffer(b"\n".join(lines[at:end]) + b"\n", np.uint8))
        stops = np.cumsum(sizes)
        starts = stops - sizes
        if bands is not None:
            after = np.empty_like(values)
            after[:-1] = values[1:]
            after[stops - 1] = 0
            pairs = (values * np.uint64(BASE) ^ (after << np.uint64(31) | after >> np.uint64(33))) * np.uint64(0xD6E8FEB86659FD93)
            bands[at:end] = minhash_bands(pairs ^ pairs >> np.uint64(32), starts)
        lanes = LANES.take(values.view(np.uint8))
        spans = -(-sizes // SPAN)
        first = np.cumsum(spans) - spans
        cuts = np.repeat(starts, spans) + SPAN * (np.arange(spans.sum()) - np.repeat(first, spans))
        parts = np.add.reduceat(lanes.reshape(-1, 8), cuts, axis=0).view(np.uint8).reshape(len(cuts), 64)
        counts = np.add.reduceat(parts.astype(np.int64), first, axis=0)
        out[at:end] = np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()
        at = end
    return out


def edit_similarity(a: str, b: str) -> float:
    """1 - edit distance / longer length, in code points; common ends are trimmed, the rest takes Myers' bit vectors."""
    longer = max(len(a), len(b))
    if not longer:
        return 1.0
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a or not b:
        return 1 - max(len(a), len(b)) / longer
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for c in b:
        eq = where.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = (down | ~(xh | up)) & full, up & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1 | 1) & full, (mh << 1) & full
        up, down = (mh | ~(xv | ph)) & full, ph & xv
    return 1 - score / longer


def alignment_cost(a: list[str], b: list[str], most: float) -> float:
    """An upper bound of the edit distance of two lines, from aligning their words with up to six words' look-ahead, else word by word; stops beyond ``most``."""
    i = j = cost = 0
    n, m = len(a), len(b)
    span = lambda xs: sum(map(len, xs)) + len(xs)
    while i < n and j < m and cost <= most:
        if a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        for k in (1, 2, 3, 4, 5, 6):
            if i + k < n and j + k < m and a[i + k] == b[j + k]:
                cost += max(span(a[i : i + k]), span(b[j : j + k]))
                i, j = i + k, j + k
                break
            if j + k < m and a[i] == b[j + k]:
                cost += span(b[j : j + k])
                j += k
                break
            if i + k < n and a[i + k] == b[j]:
                cost += span(a[i : i + k])
                i += k
                break
        else:
            cost += max(len(a[i]), len(b[j])) + 1
            i, j = i + 1, j + 1
    return cost + max(span(a[i:]), span(b[j:])) if cost <= most else cost


def edit_distance(a: str, b: str, most: int) -> int:
    """Edit distance in code points, or some number above ``most`` where it is above it: Myers' bit vectors along the diagonals that ``most`` edits can reach."""
    if len(a) < len(b):
        a, b = b, a
    n = len(b)
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : n - j]
    score = len(a) - len(b)  # on the diagonal that ends in the last cell, where values never fall
    if score > most or not b:
        return score
    above = (most - score) // 2
    where: dict[str, int] = {}
    for k, c in enumerate(a, above):
        where[c] = where.get(c, 0) | 1 << k
    full, end = (1 << most + 1) - 1, 1 << score + above
    down = (1 << above) - 1
    up = full ^ down
    for j, c in enumerate(b):
        x = (where.get(c, 0) >> j & full) | down
        diagonal = ((((x & up) + up) ^ up) | x) & full
        if not diagonal & end:
            score += 1
            if score > most:
                return score
        more = down | full ^ (diagonal | up)
        less, diagonal = diagonal & up, diagonal >> 1
        up, down = less | full ^ (diagonal | more), diagonal & more
    return score


def edit_distances(pairs: list[tuple[str, str]], most: int | np.ndarray) -> np.ndarray:
    """``edit_distance`` of all pairs side by side, whatever their sizes; pairs of like size waste least. most: one for all or one for each pair.

    Bit 0 of a pair's window is the highest diagonal that its edits can reach; a window is as many words of 64 bits as the largest ``most`` needs.
    """
    pairs = [(a, b) if len(a) >= len(b) else (b, a) for a, b in pairs]
    codes = np.frombuffer("".join(x for p in pairs for x in p).encode("utf-32-le", "surrogatepass"), np.uint32)
    used = np.zeros(int(codes.max(initial=0)) + 1, bool)
    used[codes] = True
    at = (np.cumsum(used) - 1)[codes]
    sizes = np.array([len(x) for p in pairs for x in p], np.int64)
    starts = np.cumsum(sizes) - sizes
    limit = np.broadcast_to(np.asarray(most, np.int64), len(pairs))
    out = sizes[::2] - sizes[1::2]
    order = np.flatnonzero((out <= limit) & (sizes[1::2] > 0))
    if not len(order):
        return out
    order = order[np.argsort(-sizes[1::2][order], kind="stable")]  # those whose second text goes on come first
    m, n, first, second, limit = sizes[::2][order], sizes[1::2][order], starts[::2][order], starts[1::2][order], limit[order]
    limits = limit
    score = m - n
    above = (limit - score) // 2
    words, count, alphabet = int(limit.max()) // 64 + 1, len(order), int(used.sum())
    owner = np.repeat(np.arange(count), m)
    letter = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
    place = letter + above[owner]
    masks = np.zeros((int(max(place.max() >> 6, (n[0] - 1 >> 6) + words)) + 1, count * alphabet), np.uint64)
    np.bitwise_or.at(masks.ravel(), (place >> 6) * (count * alphabet) + owner * alphabet + at[np.repeat(first, m) + letter], np.uint64(1) << (place & 63).astype(np.uint64))
    one, last, rows, lanes = np.uint64(1), np.uint64(63), np.arange(count) * alphabet, np.arange(count)
    bits = np.clip(above - 64 * np.arange(words)[:, None], 0, 64)
    down = np.where(bits == 64, ~np.uint64(0), (one << np.minimum(bits, 63).astype(np.uint64)) - one)
    up = ~down
    end, bit = score + above >> 6, (score + above & 63).astype(np.uint64)
    shifts, found, who = np.arange(64, dtype=np.uint64), score.copy(), lanes
    for j in range(int(n[0])):
        if n[-1] <= j or not j & 31:  # pairs that ended or are beyond their limit go
            found[who] = score
            on = np.flatnonzero((n > j) & (score <= limit))
            if not len(on):
                break
            if len(on) * int(n[0]) < 16 * (int(n[0]) - j):  # the last few take less one by one
                for w in who[on].tolist():
                    found[w] = edit_distance(*pairs[order[w]], int(limits[w]))
                break
            if n[on[-1]] > n[-1] or 8 * len(on) < 7 * len(who):
                up, down, score, limit, n, second, rows, end, bit, who = up[:, on], down[:, on], *(v[on] for v in (score, limit, n, second, rows, end, bit, who))
                lanes = np.arange(len(on))
        column, k, shift = rows + at.take(second + j), j >> 6, shifts[j & 63]
        if words == 1:
            low, high = masks[k].take(column), masks[k + 1].take(column)
        else:
            seen = masks[k : k + words + 1].take(column, axis=1)
            low, high = seen[:-1], seen[1:]
        x = low >> shift | high << one << last - shift | down
        both = x & up
        total = both + up
        if words > 1:
            over = total < both
            for w in range(1, words):
                total[w] += over[w - 1]
                over[w] |= over[w - 1] & (total[w] == 0)
        diagonal = (total ^ up) | x
        more, less = down | ~(diagonal | up), diagonal & up
        score += ((diagonal[0] if words == 1 else diagonal[end, lanes]) >> bit & one) == 0
        moved = diagonal >> one
        moved[:-1] |= diagonal[1:] << last
        up, down = less | ~(moved | more), moved & more
    else:
        found[who] = score
    out[order] = found
    return out


def letter_counts(texts: list[str]) -> np.ndarray:
    """How often each code point, by its last six bits, is in each text: a row of 64 counts for each."""
    out, at = np.zeros((len(texts), 64), np.int32), 0
    while at < len(texts):  # about a million letters at a time
        end, n = at, 0
        while end < len(texts) and (n < 1 << 20 or end == at):
            n += len(texts[end])
            end += 1
        codes = np.frombuffer("".join(texts[at:end]).encode("utf-32-le", "surrogatepass"), np.uint32) & np.uint32(63)
        owner = np.repeat(np.arange(end - at) * 64, [len(x) for x in texts[at:end]])
        out[at:end] = np.bincount(owner + codes, minlength=64 * (end - at)).reshape(-1, 64)
        at = end
    return out


def letters_bound(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For ``letter_counts`` of texts: the most edit similarity that each can have with the first, or each with its own. An edit takes one letter away at most, and adds one at most."""
    n, m = one.sum(axis=-1), many.sum(axis=1)
    edits = (np.abs(many - one).sum(axis=1) + np.abs(m - n)) // 2
    return 1 - edits / np.maximum(np.maximum(m, n), 1)


def letters_allow(at_least: float):
    """For ``letter_counts`` of texts: which may have an edit similarity of ``at_least`` with the first, or each with its own."""
    return lambda one, many: letters_bound(one, many) >= at_least


def quickly_similar(a: str, b: str, at_least: float) -> bool | None:
    """Whether the edit similarity is ``at_least`` or more, where lengths or an alignment of words can tell."""
    longer = max(len(a), len(b))
    if min(len(a), len(b)) < at_least * longer:
        return False
    most = (1 - at_least) * longer
    return True if alignment_cost(a.split(" "), b.split(" "), most) <= most else None


def shared_start(a: str, b: str) -> int:
    """How many letters two texts begin with alike; whole slices are compared, twice as long each time and then half."""
    n, at, step = min(len(a), len(b)), 0, 16
    while at < n and a[at : at + step] == b[at : at + step]:
        at, step = at + step, 2 * step
    while at < n and step:
        if a[at : at + step] == b[at : at + step] and at + step <= n:
            at += step
        step //= 2
    return min(at, n)


def apart(a: str, b: str) -> tuple[str, str]:
    """Two texts without their common ends, which leaves their edit distance as it is."""
    i = shared_start(a, b)
    a, b = a[i:], b[i:]
    j = shared_start(a[::-1], b[::-1])
    return a[: len(a) - j], b[: len(b) - j]


def letters_of(texts: list[str]) -> int:
    """How many different code points the texts hold."""
    used, at = np.zeros(0x110000, bool), 0
    while at < len(texts):  # about a million letters at a time
        end, n = at, 0
        while end < len(texts) and (n < 1 << 20 or end == at):
            n += len(texts[end])
            end += 1
        used[np.frombuffer("".join(texts[at:end]).encode("utf-32-le", "surrogatepass"), np.uint32)] = True
        at = end
    return int(used.sum())


def exactly_similar(pairs: list[tuple[str, str]], at_least: float, least: int = 40, side: int = 2048) -> list[bool]:
    """The same for many pairs, by edit distance: up to ``side`` of like size side by side; one by one where too few, ``least`` or so, are together."""
    longer = [max(len(a), len(b), 1) for a, b in pairs]
    most = [int((1 - at_least) * n) + 1 for n in longer]
    pairs = [apart(a, b) for a, b in pairs]
    out = [False] * len(pairs)
    order = sorted(range(len(pairs)), key=longer.__getitem__)
    alphabet = letters_of([x for p in pairs for x in p])
    at = 0
    while at < len(order):
        widest, letters, end = 2 * max(longer[order[at]], 32), set(), at
        while end < len(order) and end - at < side and longer[order[end]] <= widest:  # up to about twice the size
            table = 8 * (3 + longer[order[end]] * 3 // 128) * (end - at + 1)
            fresh = order[end if letters else at : end + 1]
            wide = letters if table * alphabet <= TABLES else letters.union(*(x for i in fresh for x in pairs[i]))
            if end > at and table * len(wide) > TABLES:
                break
            letters, end = wide, end + 1
        part, at = order[at:end], end
        if 2 * len(part) < least * (3 + most[part[-1]] // 64):  # more where windows take more than one word
            found = [edit_distance(*pairs[i], most[i]) for i in part]
        else:
            found = edit_distances([pairs[i] for i in part], np.array([most[i] for i in part])).tolist()
        for i, d in zip(part, found, strict=True):
            out[i] = 1 - d / longer[i] >= at_least
    return out


def nearby(radius: int):
    """For sketches of one 64-bit print: which lie within ``radius`` bits of the first."""
    return lambda one, many: np.bitwise_count(one ^ many).sum(axis=1) <= radius


def verified(pairs: DataFrame, texts: DataFrame, at_least: float) -> DataFrame:
    """``pairs`` with ``good``: whether the two normalised lines are similar enough. texts: ``id, line``, a stored table."""

    allow = letters_allow(at_least)

    def judge(batches):
        def rows(ends, good):
            return pa.RecordBatch.from_arrays([*(pa.array([e[k] for e in ends], pa.int64()) for k in (0, 1)), pa.array(good, pa.bool_())], names=["a", "b", "good"])

        held, texts, size = [], [], 0  # undecided pairs, of one batch or several
        for batch in batches:
            ends, good = [], []
            columns = [c.to_pylist() for c in batch.columns]
            allowed = allow(*map(letter_counts, columns[2:])).tolist()
            for a, b, x, y, may in zip(*columns, allowed, strict=True):
                if (g := may and quickly_similar(x, y, at_least)) is None:
                    held.append((a, b))
                    texts.append((x, y))
                    size += len(x) + len(y)
                else:
                    ends.append((a, b))
                    good.append(g)
                if len(held) >= 8192 or size >= 8 << 20:
                    yield rows(held, exactly_similar(texts, at_least))
                    held, texts, size = [], [], 0
            yield rows(ends, good)
        yield rows(held, exactly_similar(texts, at_least))

    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(judge, "a long, b long, good boolean")


@tidy
def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 5, radius: int = 14, similarity: float = 0.8, broadcast_bytes: int = 32 << 20, crowd: int = 4096) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``; adds ``n_lines`` and ``n_removed``.

    Lines are what ``\\n`` separates. A line is normalised (A-Z lower-cased, digits
    to 0, other ASCII to single spaces); one without any word left is left alone.
    Lines are linked if equal when normalised, or if they share a block, their
    SimHashes differ in at most ``radius`` bits and their edit similarity is
    ``similarity`` or more. Of each connected group the first occurrence stays, by doc_id (nulls
    first), text hash and line number; rows that repeat both id and text are one
    document. A null text stays null with no line; an empty one has no line.
    Other columns stay; an ``n_lines`` or ``n_removed`` is replaced.

    A line's blocks are 8 MinHash bands of 3 over its pairs of neighbouring words.
    A line of fewer than ``min_words`` words but 20 characters or more (scripts
    without spaces) is fingerprinted by characters in place of words; a shorter one
    is linked only if equal when normalised.

    Equal lines collapse to one before any are compared. A block's lines are linked
    to one of them; blocks whose lines are then still apart are settled pair by pair
    within a task, as ``buckets.settled`` says. Texts of documents are shuffled only
    if the list of removals is too long to broadcast, and those that hold a compared
    line first only if the list of such lines is.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    clean = docs.select(*kept)
    source = clean.select(F.col(doc_id).alias("doc"), F.xxhash64(F.col(text)).alias("hash"), F.col(text).alias("text")).where("text is not null and text <> ''")

    def cut(batches):
        def packed(batch, at, texts):
            norms, rows, numbers, words, sizes = normal_lines(texts)
            keys = [xxhash.xxh3_128_digest(x) for x in norms]
            first: dict[bytes, int] = {}
            for n, key in enumerate(keys):
                first.setdefault(key, n)
            enough = (words >= min_words).tolist()
            forms = {k: form for k, n in first.items() if (form := norms[n] if enough[n] else hashed_form(norms[n], min_words))}
            bands = np.zeros((len(forms), BANDS), np.uint32)
            sims = pa.array(simhashes(list(forms.values()), bands).view(np.int64))
            number = {k: i for i, k in enumerate(forms)}
            at, which = pa.array(rows + at, pa.int64()), pa.array([number.get(k) for k in keys], pa.int64())
            two = bands.view(np.int64)
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(numbers, pa.int32()), pa.array(keys, pa.binary()), sims.take(which), *(pa.array(two[:, i]).take(which) for i in range(BANDS // 2)), pa.array(sizes, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["doc", "hash", "line", "key", "sim", *BAND_PAIRS, "size"])

        for batch in batches:
            texts, at, n = [], 0, 0
            for i, t in enumerate(batch.column(2).cast(pa.binary())):
                texts.append(t.as_py())
                n += len(texts[-1])
                if n > 1 << 19:  # about half a megabyte at a time
                    yield packed(batch, at, texts)
                    texts, at, n = [], i + 1, 0
            if texts:
                yield packed(batch, at, texts)

    fields = [("hash", T.LongType()), ("line", T.IntegerType()), ("key", T.BinaryType()), *((x, T.LongType()) for x in ("sim", *BAND_PAIRS, "size"))]
    lines = stored(source.mapInArrow(cut, T.StructType([T.StructField("doc", source.schema["doc"].dataType), *(T.StructField(*f) for f in fields)])), distinct=True)
    place = F.struct("doc", "hash", "line")
    distinct = stored(lines.groupBy("key").agg(F.min(place).alias("first"), *(F.first(x).alias(x) for x in ("sim", *BAND_PAIRS, "size")), F.count(F.lit(1)).alias("n")).withColumn("id", F.monotonically_increasing_id()), distinct=True)

    formed = distinct.where("sim is not null")
    halves = [half for x in BAND_PAIRS for half in (F.shiftright(F.shiftleft(x, 32), 32), F.shiftright(x, 32))]
    blocks = F.array(*(F.shiftleft(half, 5).bitwiseOR(F.lit(i).cast("long")) for i, half in enumerate(halves)))
    members = members_of(formed.select("id", "sim", blocks.alias("blocks")), radius)

    def texts_of(ids):
        """``id, payload``: the normalised line of each id, read from the document that holds it first."""
        wanted = distinct.select("id", "first").join(sized_broadcast(ids, F.lit(16), broadcast_bytes), "id")
        spots = stored(wanted.groupBy(F.col("first.doc").alias("doc"), F.col("first.hash").alias("hash")).agg(F.collect_list(F.struct("id", F.col("first.line").alias("line"))).alias("at")))
        held, few = beside_few(source, spots, 32 + 16 * F.size("at"), "hash", broadcast_bytes)
        holders = held.join(few.withColumnsRenamed({"doc": "its_doc", "hash": "its_hash"}), F.col("doc").eqNullSafe(F.col("its_doc")) & (F.col("hash") == F.col("its_hash")))
        return stored(holders.select("at", "text").mapInArrow(fetch, "id long, payload string").dropDuplicates(["id"]))

    def fetch(batches):
        for batch in batches:
            ids, texts = [], []
            for at, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                parts = t.as_py().split(b"\n")
                ids += [x["id"] for x in at]
                texts += [b" ".join(normal_words(parts[x["line"]])).decode("utf-8", "surrogatepass") for x in at]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["id", "payload"])

    pairs = stars(members)
    ends = stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    good = stored(verified(pairs, texts_of(ends).withColumnRenamed("payload", "line"), similarity).where("good").select("a", "b"))
    groups = connected_components(good, small=1 << 18)
    shaped = lambda points: points.select("id", "size", F.unhex(F.lpad(F.hex("sim"), 16, "0")).alias("sketch"), blocks.alias("blocks"))
    more = settled(members, groups, formed.select("id", "size", "sim", *BAND_PAIRS), texts_of, nearby(radius), lambda x, y: quickly_similar(x, y, similarity), lambda pairs: exactly_similar(pairs, similarity), similarity, crowd, letter_counts, letters_bound, shaped=shaped)
    if more is not None:
        groups = connected_components(good.union(more), small=1 << 18)
    grouped = stored(distinct.select("id", "key", "first", "n").join(sized_broadcast(groups.withColumnRenamed("node", "id"), F.lit(24), broadcast_bytes), "id", "left").where("n > 1 or component is not null").select("key", "first", "n", F.coalesce("component", "id").alias("component")))
    firsts = stored(grouped.groupBy("component").agg(F.min("first").alias("keep")))
    marks = stored(grouped.select("key", "n", "component").join(firsts, "component").select("key", "n", "keep"))
    gone = with_counted(lines.select("doc", "hash", "line", "key"), marks, ["key"], "n").where("not (doc <=> keep.doc and hash = keep.hash and line = keep.line)")
    removed = stored(gone.groupBy("doc", "hash").agg(F.collect_set("line").alias("gone")))
    their_doc, their_hash, out = spare([*kept, "doc", "hash", "gone"], "_doc", "_hash", "_gone")
    few = sized_broadcast(removed, 32 + 4 * F.size("gone"), broadcast_bytes, wide=True).select(F.col("doc").alias(their_doc), F.col("hash").alias(their_hash), F.sort_array("gone").alias(out))
    marked = clean.join(few, F.col(doc_id).eqNullSafe(F.col(their_doc)) & (F.xxhash64(F.col(text)) == F.col(their_hash)), "left")
    parts = F.split(F.col(text), "\n", -1)
    between = F.arrays_zip(F.concat(F.array(F.lit(0)), F.transform(out, lambda x: x + 1)).alias("s"), F.concat(F.col(out), F.array(F.size(parts))).alias("e"))
    rest = let(parts, lambda p: F.array_join(F.flatten(F.transform(between, lambda x: F.slice(p, x["s"] + 1, x["e"] - x["s"]))), "\n"))
    n = F.when(F.octet_length(text) > 0, F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1).otherwise(0).cast("long")
    cut_text = F.when(F.col(out).isNull(), F.col(text)).otherwise(rest).alias(text)
    return marked.select(*(cut_text if c == text else F.col(c) for c in kept), n.alias("n_lines"), F.when(F.col(out).isNull(), 0).otherwise(F.size(out)).cast("long").alias("n_removed"))


def line_report(docs: DataFrame) -> DataFrame:
    """The rows of ``op8``: one for every document row."""
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))

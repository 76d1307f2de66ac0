"""Exact substring dedup by prefix-free parsing: rolling-hash triggers, phrases, dictionary and parse order."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.llm.common import spare, stored, with_counted

TRIGGER = 16  # bytes under the rolling hash
BASE = 0x9E3779B97F4A7C15
SEGMENT = 1 << 20


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """Mixed polynomial hash, modulo 2**64, of the ``TRIGGER`` bytes from every position; built by doubling."""
    with np.errstate(over="ignore"):
        h, width, power = data.astype(np.uint64) + np.uint64(1), 1, BASE
        while width < TRIGGER:
            h = h[:-width] * np.uint64(power) + h[width:]
            width, power = 2 * width, power * power & (1 << 64) - 1
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ h >> np.uint64(29)


def first_least(h: np.ndarray, g: int) -> np.ndarray:
    """For every window of ``g`` consecutive hashes: the position of the least, the first of equal ones."""
    n = len(h) - g + 1
    at = np.arange(len(h), dtype=np.uint64)
    key = (h & ~np.uint64(0xFFFFFF)) | at  # a segment is shorter than 2**24
    blocks = np.full(-(-len(h) // g) * g, ~np.uint64(0), np.uint64)
    blocks[: len(h)] = key
    blocks = blocks.reshape(-1, g)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[g - 1 : g - 1 + n]) & np.uint64(0xFFFFFF)).astype(np.int64)


def phrases(data: np.ndarray, length: int, reach: int):
    """(first start, last start, trigger) of the runs of ``length``-byte strings that share their trigger.

    A trigger is a position whose rolling hash is the least of ``reach``
    consecutive ones; a string's trigger is the least among its first ``reach``
    positions. It depends on the string's bytes alone, so equal strings have
    theirs at the same offset, and no string is without one. Triggers cut a text
    into phrases of at most ``reach`` bytes; the strings of one run start inside the
    phrase that the trigger ends.
    """
    n = len(data) - length + 1
    lows, highs, ats = [], [], []
    for s in range(0, max(n, 0), SEGMENT):
        m = min(SEGMENT, n - s)
        trigger = first_least(rolling_hash(data[s : s + m - 1 + reach + TRIGGER - 1]), reach)[:m]
        cuts = np.flatnonzero(np.diff(trigger)) + 1
        low = np.concatenate(([0], cuts))
        lows.append(low + s)
        highs.append(np.concatenate((cuts - 1, [m - 1])) + s)
        ats.append(trigger[low] + s)
    return (np.concatenate(lows), np.concatenate(highs), np.concatenate(ats)) if lows else (np.zeros(0, np.int64),) * 3


def repeated_starts(contexts: list[tuple[bytes, int, int]], length: int) -> list[list[int]]:
    """For phrase contexts around one trigger: the offsets of each one's strings that another context holds too.

    A context is ``(bytes, offset of the trigger, number of strings)``. The
    dictionary holds what stands before the trigger, the parse what follows. The
    order of the strings is that of (suffix of the dictionary's phrase, rank of the
    parse's suffix): equal strings are neighbours in it, and neighbours are
    compared. Bounds from both suffix orders leave out strings that no other
    context can hold.
    """
    left = [x[:c] for x, c, _ in contexts]
    right = [x[c:] for x, c, _ in contexts]
    parse = sorted(range(len(contexts)), key=right.__getitem__)
    rank = {j: r for r, j in enumerate(parse)}
    reach_right, reach_left = [0] * len(contexts), [0] * len(contexts)
    for i, j in pairwise(parse):
        same = common(right[i], right[j])
        reach_right[i], reach_right[j] = max(reach_right[i], same), max(reach_right[j], same)
    back = [x[::-1] for x in left]
    for i, j in pairwise(sorted(range(len(contexts)), key=back.__getitem__)):
        same = common(back[i], back[j])
        reach_left[i], reach_left[j] = max(reach_left[i], same), max(reach_left[j], same)
    order = []
    for j, (_, c, n) in enumerate(contexts):
        order += [(left[j][i:], rank[j], j, i) for i in range(max(0, c - reach_left[j]), min(n - 1, c - (length - reach_right[j])) + 1)]
    order.sort()
    found: list[set[int]] = [set() for _ in contexts]
    for (s, _, i, at), (t, _, j, to) in pairwise(order):
        if s == t:
            rest = length - len(s)
            if right[i][:rest] == right[j][:rest]:
                found[i].add(at)
                found[j].add(to)
    return [sorted(x) for x in found]


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:  # a[:low] == b[:low], a[:high] != b[:high]
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def ranges(starts: list[int]) -> list[tuple[int, int]]:
    """Runs of consecutive numbers as (first, last)."""
    out: list[list[int]] = []
    for s in starts:
        if out and s == out[-1][1] + 1:
            out[-1][1] = s
        else:
            out.append([s, s])
    return [tuple(x) for x in out]


CONTEXT = "k long, c1 long, c2 long, r1 long, r2 long, low int, size int, at int"


def contexts_of(rows: DataFrame, length: int, reach: int) -> DataFrame:
    """A row for each phrase of each text: bucket ``k``, 128-bit name ``c1, c2`` of its context, and where it stands.

    rows: ``r1, r2, text``. The context is all bytes of the phrase's strings; the
    bucket hashes the bytes after the trigger that every one of them holds.
    """

    def run(batches):
        core = length - reach + 1
        for batch in batches:
            r1, r2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[list] = [[] for _ in range(8)]
            for i, t in enumerate(batch.column(2)):
                data = t.as_py().encode("utf-8", "surrogatepass")
                if len(data) < length:
                    continue
                low, high, at = phrases(np.frombuffer(data, np.uint8), length, reach)
                for s, e, a in zip(low.tolist(), high.tolist(), at.tolist(), strict=True):
                    name = xxhash.xxh3_128_intdigest(data[s : e + length])
                    row = (xxhash.xxh3_64_intdigest(data[a : a + core]), name >> 64, name & (1 << 64) - 1, r1[i], r2[i], s, e - s + length, a - s)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                if len(out[0]) >= 1 << 16:
                    yield packed(out)
                    out = [[] for _ in range(8)]
            yield packed(out)

    def packed(out):
        longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in out[:3]] + [pa.array(x, pa.int64()) for x in out[3:5]]
        return pa.RecordBatch.from_arrays([*longs, *(pa.array(x, pa.int32()) for x in out[5:])], names=["k", "c1", "c2", "r1", "r2", "low", "size", "at"])

    return rows.mapInArrow(run, CONTEXT)


def in_buckets(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated byte ranges ``r1, r2, s, e`` of the unresolved contexts (``n`` = 1) of buckets that fit a task."""

    def run(batches):
        held: list[tuple] = []

        def solve(group, out):
            for (_, n, r1, r2, low, *_), starts in zip(group, repeated_starts([(x[6], x[5], len(x[6]) - length + 1) for x in group], length), strict=True):
                if n == 1:
                    out += [(r1, r2, low + s, low + e + length) for s, e in ranges(starts)]

        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    solve(held, out)
                    held = []
                held.append(row)
            yield intervals(out)
        out = []
        if held:
            solve(held, out)
        yield intervals(out)

    return contexts.select("k", "n", "r1", "r2", "low", "at", "bytes").repartition("k").sortWithinPartitions("k").mapInArrow(run, "r1 long, r2 long, s int, e int")


def intervals(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kinds[i]) for i in range(4)], names=["r1", "r2", "s", "e"])


BLOCK = "r1 long, r2 long, low int, at int, n long, a int, c1 long, c2 long, s1 long, s2 long"
SPOT = ["r1", "r2", "low"]


def blocks_of(contexts: DataFrame, size: int, length: int) -> DataFrame:
    """A row for each open block of each context: the name of what all its strings share, and of all its bytes.

    contexts: ``r1, r2, low, at, bytes`` and ``open``, an array of struct(a, n). A block
    holds the strings that start ``a`` to ``a + size - 1`` bytes before the trigger; one that
    reaches past the context's strings has no second name.
    """

    def run(batches):
        def name(x):
            v = xxhash.xxh3_128_intdigest(x)
            return v >> 64, v & (1 << 64) - 1

        def packed(out):
            pick = lambda i, kind: pa.array([r[i] for r in out], kind)
            longs = [pa.array([None if r[i] is None else r[i] - (1 << 64) * (r[i] >> 63) for r in out], pa.int64()) for i in range(6, 10)]
            return pa.RecordBatch.from_arrays([pick(0, pa.int64()), pick(1, pa.int64()), pick(2, pa.int32()), pick(3, pa.int32()), pick(4, pa.int64()), pick(5, pa.int32()), *longs], names=["r1", "r2", "low", "at", "n", "a", "c1", "c2", "s1", "s2"])

        for batch in batches:
            out = []
            for r1, r2, low, c, data, todo in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                least = c - (len(data) - length)
                for x in todo:
                    a, tag = x["a"], b"%d:%d:" % (x["a"], size)
                    if a <= c and a + size - 1 >= least:
                        whole = name(tag + data[c - a - size + 1 : c - a + length]) if a >= least and a + size - 1 <= c else (None, None)
                        out.append((r1, r2, low, c, x["n"], a, *name(tag + data[c - a : c - a - size + 1 + length]), *whole))
            yield packed(out)

    return contexts.select(*SPOT, "at", "bytes", "open").mapInArrow(run, BLOCK)


def by_blocks(contexts: DataFrame, length: int, reach: int, cut: int = 4) -> DataFrame:
    """The same for the contexts of crowded buckets, by blocks of strings that are cut until they are settled.

    A block whose strings share bytes that no other block has is done: nothing in
    it repeats. One whose bytes another block has repeats whole. The rest are cut
    in ``cut``, down to single strings; of blocks with the same bytes one goes on for
    all, so that others can still meet it. Every round counts by hash, so no
    crowd meets in one task and a context makes few rows a round.
    """
    size = 1
    while size < reach:
        size *= cut
    todo = contexts.withColumn("open", F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("n"))))
    found = None
    while True:
        blocks = stored(blocks_of(todo, size, length))
        cores = stored(blocks.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1").select("c1", "c2"))
        live = stored(blocks.join(cores, ["c1", "c2"], "left_semi"))
        same = stored(live.where("s1 is not null").groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct(*SPOT, "a")).alias("x")).where("m > 1"))
        again = live.where("n = 1").join(same.select("s1", "s2"), ["s1", "s2"], "left_semi")
        part = stored(again.select("r1", "r2", (F.col("low") + F.col("at") - F.col("a") - size + 1).alias("s"), (F.col("low") + F.col("at") - F.col("a") + length).alias("e")))
        found = part if found is None else found.unionByName(part)
        if size == 1:
            return found
        size //= cut
        single = live.join(same.select("s1", "s2"), ["s1", "s2"], "left_anti").select(*SPOT, "a", "n")
        stand = same.select("x.*", F.lit(2).cast("long").alias("n"))
        parts = F.explode(F.array(*(F.struct((F.col("a") + i * size).alias("a"), F.col("n").alias("n")) for i in range(cut)))).alias("x")
        rest = stored(single.unionByName(stand).select(*SPOT, parts).groupBy(*SPOT).agg(F.collect_list("x").alias("open")))
        if rest.isEmpty():
            return found
        todo = contexts.join(rest, SPOT)


def repeated_ranges(rows: DataFrame, length: int, reach: int, crowd: int) -> DataFrame:
    """Byte ranges ``r1, r2, s, e`` covered by strings of ``length`` bytes that start more than once. rows: ``r1, r2, text``.

    1. A bucket met once holds no repeat; the rest go on.
    2. A context met twice repeats with all its strings, copies collapse to a count.
    3. Contexts met once that share their bucket with others are compared as bytes,
       in order; one of the copies stands for a context met more often.

    The phrases of a large group of copies are hot keys where counts meet places;
    these are joined by a broadcast, which ``with_counted`` bounds.
    """
    buckets = stored(contexts_of(rows, length, reach).groupBy("k").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("k"))
    met = stored(contexts_of(rows, length, reach).join(buckets, "k"))
    one = F.struct("r1", "r2", "low", "size", "at")
    names = stored(met.groupBy("k", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min(one).alias("x")))
    shared = stored(names.groupBy("k").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1").select("k", "m"))
    full = stored(names.where("n > 1").select("c1", "c2", "n"))
    whole = with_counted(met, full, ["c1", "c2"], "n").select("r1", "r2", F.col("low").alias("s"), (F.col("low") + F.col("size")).alias("e"))
    spots = with_counted(names, shared, ["k"], "m").select("k", "n", "m", "x.*")
    by_text = stored(spots.groupBy("r1", "r2").agg(F.collect_list(F.struct("k", "n", "m", "low", "size", "at")).alias("spots")))

    def fetch(batches):
        for batch in batches:
            out: list[tuple] = []
            for r1, r2, t, xs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                data = t.encode("utf-8", "surrogatepass")
                out += [(x["k"], x["n"], x["m"], r1, r2, x["low"], x["at"], data[x["low"] : x["low"] + x["size"]]) for x in xs]
            kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kinds[i]) for i in range(8)], names=["k", "n", "m", "r1", "r2", "low", "at", "bytes"])

    data = rows.join(by_text.hint("merge"), ["r1", "r2"]).select("r1", "r2", "text", "spots").mapInArrow(fetch, "k long, n long, m long, r1 long, r2 long, low int, at int, bytes binary")
    data = stored(data)
    part = in_buckets(data.where(F.col("m") <= crowd), length)
    crowded = data.where(F.col("m") > crowd)
    if not crowded.isEmpty():
        part = part.unionByName(by_blocks(crowded, length, reach))
    return whole.unionByName(part)


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 400, reach: int = 256, crowd: int = 500) -> DataFrame:
    """Adds ``n_bytes``, ``removed`` (flat byte offsets of the maximal removed runs) and ``kept`` (the remaining bytes) to every row.

    A byte goes if a ``length``-byte string that also starts anywhere else covers
    it: in another row, or elsewhere in the same one, overlapping or not. Strings
    never cross rows and are judged on the input. Every occurrence goes, the first
    too. A null text is empty; texts shorter than ``length`` stay whole; rows that
    repeat one another are each other's copies. Columns named like the new ones
    are replaced.

    ``reach`` bounds phrases; a bucket of more than ``crowd`` different contexts is settled by blocks, spread over all tasks.
    """
    kept = [c for c in docs.columns if c not in ("n_bytes", "removed", "kept")]
    one, two, found_runs = spare([*kept, "n_bytes", "removed", "kept"], "_r1", "_r2", "_runs")
    keyed = docs.select(*kept, F.xxhash64(F.lit(1), F.col(doc_id), F.col(text)).alias(one), F.xxhash64(F.lit(2), F.col(text), F.col(doc_id)).alias(two))
    rows = keyed.where(F.octet_length(text) >= length).select(F.col(one).alias("r1"), F.col(two).alias("r2"), F.col(text).alias("text"))
    found = repeated_ranges(rows, length, reach, crowd)
    runs = stored(found.distinct().groupBy(F.col("r1").alias(one), F.col("r2").alias(two)).agg(F.collect_list(F.struct("s", "e")).alias(found_runs)))
    joined = keyed.join(runs.hint("merge"), [one, two], "left").select(*kept, found_runs)

    def run(batches):
        for batch in batches:
            sizes, removed, rest = [], [], []
            for t, xs in zip(batch.column(text), batch.column(found_runs), strict=True):
                data = (t.as_py() or "").encode("utf-8", "surrogatepass")
                flat: list[int] = []
                for s, e in sorted((x["s"], x["e"]) for x in xs.as_py() or ()):
                    if flat and s <= flat[-1]:
                        flat[-1] = max(flat[-1], e)
                    else:
                        flat += [s, e]
                ends = [0, *flat, len(data)]
                sizes.append(len(data))
                removed.append(flat)
                rest.append(b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
            columns = [batch.column(c) for c in kept] + [pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(pa.int32())), pa.array(rest, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n_bytes", "removed", "kept"])

    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("removed", T.ArrayType(T.IntegerType())), T.StructField("kept", T.BinaryType())])
    return joined.mapInArrow(run, schema)


def substring_report(docs: DataFrame) -> DataFrame:
    """The digest rows of ``op2``: one for every document row."""
    found = dedup_substrings(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.floor(F.size("removed") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

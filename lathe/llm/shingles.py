"""Near-duplicate documents by word shingles: SimHash in a vantage-point tree, then MinHash bands propose pairs, the shingle sets decide them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.llm.buckets import members_of, settled, stars
from lathe.llm.common import stored, with_counted
from lathe.llm.components import connected_components
from lathe.llm.simhash import UPPER, majority, near_edges, set_bits

BANDS, ROWS = 24, 4
_rng = np.random.default_rng(23)
MULTIPLY = _rng.integers(1, 1 << 63, BANDS * ROWS, np.uint64) | np.uint64(1)
ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def normal(text: str | None) -> bytes:
    """The words, A-Z lower-cased, joined by single spaces."""
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(UPPER).split()) if text else b""


def shingle_set(line: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; a shorter text is one shingle."""
    words = line.split(b" ")
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(line[s:e], 42) for s, e in zip(starts, ends[size - 1 :].tolist(), strict=True)), np.uint64, len(starts)))


def minima(values: np.ndarray) -> np.ndarray:
    """The least of the set under each of ``BANDS * ROWS`` hash functions."""
    out = np.full(len(MULTIPLY), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(values), 1024):  # bounded memory for a very long text
        mixed = values[None, i : i + 1024] * MULTIPLY[:, None] + ADD[:, None]
        mixed ^= mixed >> np.uint64(32)
        out = np.minimum(out, (mixed * np.uint64(0x9E3779B97F4A7C15)).min(axis=1))
    return out


def set_print(values: np.ndarray) -> int:
    """64-bit SimHash of a shingle set, as an unsigned integer."""
    return majority(sum(set_bits(values[i : i + (1 << 16)]) for i in range(0, len(values), 1 << 16)), len(values))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets."""
    if min(len(a), len(b)) == 0:
        return float(len(a) == len(b))
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int(np.count_nonzero(b[at] == a))
    return both / (len(a) + len(b) - both)


def agreeing(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which sketches agree with the first, or each with its own, in half of their bytes or more; at similarity 0.8 one pair in ten billion doesn't."""
    return 2 * np.count_nonzero(many == one, axis=1) >= many.shape[1]


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8, radius: int = 2, crowd: int = 4096) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id`` and ``component_id``, the smallest doc_id of its group.

    Texts are linked whose sets of ``size``-word shingles (A-Z lower-cased) have a
    Jaccard similarity of ``similarity`` or more; the sets decide every pair that is
    proposed. Null, empty and blank texts are one group.

    First op10's method proposes pairs: SimHashes of the sets within ``radius`` bits of
    one another, found by the vantage-point tree and its shards. At similarity 0.8
    SimHashes differ in about 10 bits, beyond what a tree over 64 can prune, so what is
    then still apart is proposed by MinHash, in 24 bands of 4, which misses a pair of
    similarity 0.8 once in 300,000. A bucket's texts are linked to one of them; buckets
    whose texts are then still apart are settled pair by pair within a task, as
    ``buckets.settled`` says.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = [("key", T.BinaryType()), ("size", T.LongType()), ("blocks", T.ArrayType(T.LongType())), ("sketch", T.BinaryType()), ("fingerprint", T.LongType())]

    def sign(batches):
        for batch in batches:
            keys, sizes, blocks, sketches, prints = [], [], [], [], []
            for t in batch.column(1):
                line = normal(t.as_py())
                found = shingle_set(line, size)
                low = minima(found)
                keys.append(xxhash.xxh3_128_digest(line))
                sizes.append(len(found))
                blocks.append([xxhash.xxh64_intdigest(low[i : i + ROWS].tobytes(), i) - (1 << 63) for i in range(0, len(low), ROWS)] if line else [])
                sketches.append((low >> np.uint64(56)).astype(np.uint8).tobytes())
                prints.append(set_print(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(blocks, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["doc_id", *(n for n, _ in fields)])

    rows = stored(source.mapInArrow(sign, T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType), *(T.StructField(*f) for f in fields)])))
    distinct = stored(rows.groupBy("key").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("blocks").alias("blocks"), F.first("sketch").alias("sketch"), F.first("fingerprint").alias("fingerprint")).withColumn("id", F.monotonically_increasing_id()))
    members = members_of(distinct.select("id", "blocks"))
    pairs = stars(members)
    prints = stored(distinct.where(F.size("blocks") > 0).groupBy("fingerprint").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")))
    shared = with_counted(distinct.where(F.size("blocks") > 0).select("fingerprint", "id"), prints.where("n > 1"), ["fingerprint"], "n").where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    heads = lambda end: prints.select(F.col("fingerprint").alias(end), F.col("head").alias(f"{end}_id"))
    near = near_edges(prints, radius).join(heads("a"), "a").join(heads("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    near = stored(shared.unionByName(near).distinct())

    def cut(batches):
        for batch in batches:
            found = [shingle_set(normal(t.as_py()), size).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.large_binary()).cast(pa.binary())], names=["id", "payload"])

    def judge(batches):
        for batch in batches:
            good = [jaccard(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) >= similarity for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], names=["a", "b", "good"])

    def sets_of(ids):
        """``id, payload``: the shingle set of each id, made from one document that has the text."""
        wanted = stored(ids.join(distinct.select("id", "key", "n"), "id"))
        tagged = source.mapInArrow(tag, "key binary, text string")
        return stored(with_counted(tagged, wanted, ["key"], "n").dropDuplicates(["id"]).select("id", "text").mapInArrow(cut, "id long, payload binary"))

    def tag(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(normal(t.as_py())) for t in batch.column(1)], pa.binary()), batch.column(1)], names=["key", "text"])

    def verified(pairs, sets):
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("found").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("found").alias("y")), "b")
        return stored(both.select("a", "b", "x", "y").mapInArrow(judge, "a long, b long, good boolean"))

    both = near.union(pairs)
    ends = stored(both.select(F.col("a").alias("id")).union(both.select("b")).distinct())
    sets = sets_of(ends).withColumnRenamed("payload", "found")
    good = verified(near, sets).where("good").select("a", "b")
    groups = connected_components(good, small=1 << 18)
    label = lambda end: groups.select(F.col("node").alias(end), F.col("component").alias(f"{end}_label"))
    apart = pairs.join(label("a"), "a", "left").join(label("b"), "b", "left").where(~F.coalesce(F.col("a_label") == F.col("b_label"), F.lit(False))).select("a", "b")
    good = good.union(verified(apart, sets).where("good").select("a", "b"))
    groups = connected_components(good, small=1 << 18)
    same = lambda x, y: jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= similarity
    more = settled(members, groups, distinct.select("id", "size", "sketch", "blocks"), sets_of, agreeing, same, lambda pairs: [same(x, y) for x, y in pairs], similarity, crowd)
    if more is not None:
        groups = connected_components(good.union(more), small=1 << 18)
    named = stored(distinct.join(groups.withColumnRenamed("node", "id"), "id", "left").select("key", "low", "n", F.coalesce("component", "id").alias("component")))
    lows = stored(named.groupBy("component").agg(F.min("low").alias("component_id")))
    final = stored(named.select("key", "n", "component").join(lows, "component").select("key", "n", "component_id"))
    return with_counted(rows.select("doc_id", "key"), final, ["key"], "n").select("doc_id", "component_id")

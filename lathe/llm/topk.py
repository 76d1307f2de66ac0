"""Exact top-k inner-product search over norm buckets with local cosine thresholds."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lathe.llm.common import stored

OUT = "query_id long, vec_id long, score long"
LONG = np.iinfo(np.int64)


def usable(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, x) of rows with an id and finite, non-null components only."""
    x = F.col(embedding)
    fine = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return df.where(F.col(vec_id).isNotNull() & fine).select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x"))


def scaled(x, scale: int):
    """The components as whole doubles."""
    return F.transform(x, lambda c: floor_double(c.cast("double") * scale))


def floor_double(c):
    """floor as a double; beyond 2**53 a double is whole already."""
    return F.when(F.abs(c) < 2.0**53, F.floor(c).cast("double")).otherwise(c)


class Bucket:
    """Vectors of similar length, longest first, with each coordinate's direction cosines sorted for range lookups."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray):
        self.ids, self.vectors, self.norms, self.longest = ids, vectors, norms, float(norms[0])
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def by_coordinate(self, f: int):
        if f not in self.sorted:
            c = self.vectors[:, f] / np.maximum(self.norms, 1e-300)
            order = np.argsort(c, kind="stable")
            self.sorted[f] = c[order], order
        return self.sorted[f]

    def candidates(self, query: np.ndarray, length: float, least: float) -> np.ndarray | None:
        """Positions whose product with the query may reach ``least``; None: the whole bucket is too short.

        The local threshold is the cosine that even the bucket's longest vector
        needs. Where it is high, a vector's cosine on the query's main coordinate
        is confined to a narrow range, found by bisection; else lengths alone cut
        the bucket's tail. Both keep every vector that may reach the threshold.
        """
        if least <= 0 or length == 0:
            return np.arange(len(self.ids)) if least <= 0 else None
        cosine = least / (length * self.longest) if self.longest else np.inf
        if cosine > 1 + 1e-9:
            return None
        if cosine >= 0.5:
            f = int(np.argmax(np.abs(query)))
            q, r = query[f] / length, np.sqrt(max(0.0, 1 - min(cosine, 1.0) ** 2) * max(0.0, 1 - (query[f] / length) ** 2))
            # x.q >= cosine with |x| = |q| = 1 holds x_f within q*cosine +- r; at most 1 where q itself is closer than the threshold
            low, high = (q * cosine - r, q * cosine + r)
            if q >= cosine:
                high = 1.0
            if -q >= cosine:
                low = -1.0
            values, order = self.by_coordinate(f)
            return order[np.searchsorted(values, low - 1e-9, "left") : np.searchsorted(values, high + 1e-9, "right")]
        return np.arange(np.searchsorted(-self.norms, -(least / length) * (1 - 1e-12), "right"))


def buckets(ids: np.ndarray, vectors: np.ndarray, size: int) -> list[Bucket]:
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    order = np.argsort(-norms, kind="stable")
    return [Bucket(ids[o], vectors[o], norms[o]) for o in (order[i : i + size] for i in range(0, len(order), size))]


def products(query: np.ndarray, rows: np.ndarray) -> list[int] | np.ndarray:
    """Exact products; doubles are exact while every partial sum stays below 2**53, else whole numbers are taken, held within a long."""
    if len(query) * float(np.abs(query).max(initial=0)) * float(np.abs(rows).max(initial=0)) < 2.0**53:
        return (rows @ query).astype(np.int64)
    q = [int(x) for x in query]
    return np.array([min(max(sum(a * int(b) for a, b in zip(q, r, strict=True)), LONG.min), LONG.max) for r in rows], np.int64)


def search_block(queries, found, parts, k: int) -> None:
    """Improve each query's heap in ``found`` over the buckets, longest first. A query is (id, vector, length, seed), see ``seeded``."""
    for i, (qid, q, length, seed) in enumerate(queries):
        heap = found[i]
        for b in parts:
            if len(q) != b.vectors.shape[1]:
                break
            least = max(seed, heap[0][0]) if len(heap) == k else seed
            at = b.candidates(q, length, float(least) * (1 - 1e-12) - 1e-6 if least > 0 else least)
            if at is None:
                break  # the buckets that follow are shorter still
            if not len(at):
                continue
            scores = products(q, b.vectors[at])
            better = scores >= least
            at, scores = at[better], scores[better]
            ids = b.ids[at]
            others = ids != qid
            ids, scores = ids[others], scores[others]
            if len(ids) > k:
                first = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[first], scores[first]
            for s, v in zip(scores.tolist(), ids.tolist(), strict=True):
                if len(heap) < k:
                    heapq.heappush(heap, (s, -v))
                elif (s, -v) > heap[0]:
                    heapq.heapreplace(heap, (s, -v))


def seeded(asked: DataFrame, longest: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    """``asked`` with ``seed``: a score that the query's k-th best reaches for sure, as k of the corpus' longest vectors do; null without k of them."""
    shared = asked.sparkSession.sparkContext.broadcast(longest)

    def run(batches):
        groups: dict[int, list] = {}
        for i, x in shared.value:
            groups.setdefault(len(x), []).append((i, x))
        known = {d: (np.array([i for i, _ in xs]), np.stack([x for _, x in xs])) for d, xs in groups.items()}
        for batch in batches:
            seeds = []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                q, best = np.array(x.as_py(), np.float64), None
                if len(q) in known:
                    ids, vectors = known[len(q)]
                    scores = products(q, vectors[ids != i])
                    best = int(np.sort(scores)[-k]) if len(scores) >= k else None
                seeds.append(best)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seeds, pa.int64())], names=[*batch.schema.names, "seed"])

    return asked.mapInArrow(run, "vec_id long, v array<double>, seed long")


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 1024, query_block: int = 16384, chunk: int = 16384, bucket: int = 512, seeds: int = 2048, block_bytes: int = 32 << 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest integer inner products, ties to the smaller vec_id.

    A row of the query's own vec_id is no candidate for it. Rows that are null or
    hold a null or non-finite component, or have no id, take no part; a query and a
    vector of different dimensions have no product. Repeated rows each count as
    candidates; of query rows that share an id the least vector asks. Fewer than
    ``k`` candidates give as many rows; empty tables give none. Scores
    outside a long are held at its ends.

    The table is ordered by length over the whole corpus and stored, once, rows of one
    length dealt by hash; so a bucket of neighbours is a narrow range of lengths
    wherever it is read. The longest ``seeds`` vectors give each query a first
    threshold, from which all tasks start. Queries are a stated set: blocks of at most
    ``query_block`` queries and about ``block_bytes`` are sent to all rows, one block
    and one scan after the other; beyond one block each is stored before the next. A task keeps ``k`` for each query, so what
    is shuffled is bounded by tasks x queries x k, and the window's group limit cuts
    it before the shuffle.
    """
    spark = rows.sparkSession
    norm = F.sqrt(F.aggregate(scaled(F.col("x"), scale), F.lit(0.0), lambda s, c: s + c * c))
    measured = usable(rows, vec_id, embedding).withColumns({"norm": norm, "at": F.xxhash64(F.monotonically_increasing_id())})
    data = stored(measured.repartitionByRange(F.desc("norm"), "at").sortWithinPartitions(F.desc("norm"), "at").drop("at"))
    asked = usable(queries, vec_id, embedding).groupBy("vec_id").agg(F.min(scaled(F.col("x"), scale)).alias("v"))
    width = data.agg(F.max(F.size("x"))).first()[0] or 1
    first = data.orderBy(F.desc("norm"), "vec_id").limit(max(k + 1, min(seeds, block_bytes // (32 * width)))).select("vec_id", scaled(F.col("x"), scale).alias("v"))
    asked = stored(seeded(asked, [(r.vec_id, np.array(r.v, np.float64)) for r in first.collect()], k))
    n_blocks = max(1, -(-asked.count() // max(1, min(query_block, block_bytes // (8 * width)))))
    vectors = data.select("vec_id", scaled(F.col("x"), scale).alias("v"))
    out = spark.createDataFrame([], OUT)
    for b in range(n_blocks):
        part = asked if n_blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b)
        block = []
        for r in part.toLocalIterator():
            q = np.array(r.v, np.float64)
            block.append((r.vec_id, q, float(np.sqrt(q @ q)), -np.inf if r.seed is None else r.seed))
        if not block:
            continue
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            queries = shared.value
            found: list[list] = [[] for _ in queries]
            held: dict[int, list] = {}

            def flush(dim):
                ids, vectors = zip(*held.pop(dim), strict=True)
                search_block(queries, found, buckets(np.concatenate(ids), np.concatenate(vectors), bucket), k)

            for batch in batches:
                ids, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
                sizes, flat = np.asarray(column.value_lengths()), column.flatten().to_numpy(zero_copy_only=False)
                starts = np.cumsum(sizes) - sizes
                for dim in np.unique(sizes).tolist():
                    at = np.flatnonzero(sizes == dim)
                    vectors = flat.reshape(-1, dim) if len(at) == len(sizes) and dim else np.stack([flat[s : s + dim] for s in starts[at]])
                    held.setdefault(dim, []).append((ids[at], vectors))
                    if sum(len(x) for x, _ in held[dim]) >= chunk:
                        flush(dim)
            for dim in list(held):
                flush(dim)
            out = [(queries[i][0], -v, s) for i, heap in enumerate(found) for s, v in heap]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(3)], names=["query_id", "vec_id", "score"])

        best = vectors.mapInArrow(run, OUT)
        if n_blocks > 1:
            best = stored(best)
            shared.destroy()
        out = out.unionByName(best)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

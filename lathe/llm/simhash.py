"""SimHash fingerprints and exact near-pair search with a vantage-point tree cut into shards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.llm.common import sized_broadcast, spare, stored, with_counted
from lathe.llm.components import connected_components

UPPER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def set_bits(hashes: np.ndarray) -> np.ndarray:
    """In how many of the hashes each of the 64 bits is set."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    """The bits that are set in more than half of ``n`` hashes."""
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, size: int = 3) -> int:
    """64-bit SimHash over ``size``-word shingles, repeats included, as an unsigned integer; 0 where there is no word."""
    words = text.encode("utf-8", "surrogatepass").translate(UPPER).split() if text else []
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) <= size:
        return hashed(b" ".join(words), 42)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    n, counts = len(starts), np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):  # a very long text stays within bounded memory
        counts += set_bits(np.array([hashed(joined[s:e], 42) for s, e in zip(starts[i : i + (1 << 16)], ends[i : i + (1 << 16)], strict=True)], np.uint64))
    return majority(counts, n)


def with_fingerprint(docs: DataFrame, text: str = "text", size: int = 3, name: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint as a long whose bits are the unsigned ones. Null and empty texts have fingerprint zero."""
    out = docs.drop(name)
    kept = out.columns

    def run(batches):
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py(), size) for t in batch.column(text)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(prints.view(np.int64))], names=[*kept, name])

    return out.mapInArrow(run, T.StructType([*out.schema.fields, T.StructField(name, T.LongType())]))


def distances(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def split(points: np.ndarray, radius: int, rng: np.random.Generator):
    """A vantage point and a boundary: points at most ``mu`` away are inner. None where no split helps.

    Of a few vantage points and the boundaries near the middle, it takes the one
    whose larger half with its visitors is smallest. A pair across the boundary
    has its inner end more than ``mu - radius`` away from the vantage point, by the
    triangle inequality; only such inner points visit the outer side.
    """
    best = None
    for v in points[rng.integers(0, len(points), 4)]:
        counts = np.bincount(distances(points, v), minlength=65)
        inner = np.cumsum(counts)
        visitors = inner - np.concatenate((np.zeros(radius, inner.dtype), inner[:-radius]))
        larger = np.maximum(inner, len(points) - inner + visitors)
        mu = int(np.argmin(larger))
        if best is None or larger[mu] < best[0]:
            best = int(larger[mu]), np.uint64(v), mu
    return best[1:] if best and best[0] <= 0.9 * len(points) else None


def plan(sample: np.ndarray, share: float, target: int, radius: int, most: int = 4096):
    """A tree over the sample, as nested tuples: ``(vantage, mu, inner, outer)``, or a shard's number at a leaf.

    share: the sample's share of all points; leaves are cut until about ``target`` points, visitors included, fall in each.
    """
    rng, leaves = np.random.default_rng(7), [0]

    def grow(points, depth):
        cut = split(points, radius, rng) if len(points) > max(8, target * share) and depth < 40 and leaves[0] < most else None
        if cut is None:
            leaves[0] += 1
            return leaves[0] - 1
        v, mu = cut
        d = distances(points, v)
        return v, mu, grow(points[d <= mu], depth + 1), grow(points[d > mu - radius], depth + 1)

    return grow(sample, 0)


def shards_of(tree, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, index of the point) of every shard that a point lives in or visits."""
    shard, index = [], []

    def walk(node, at):
        if not len(at):
            return
        if not isinstance(node, tuple):
            shard.append(np.full(len(at), node, np.int32))
            index.append(at)
            return
        v, mu, inner, outer = node
        d = distances(points[at], v)
        walk(inner, at[d <= mu])
        walk(outer, at[d > mu - radius])

    walk(tree, np.arange(len(points)))
    return (np.concatenate(shard), np.concatenate(index)) if shard else (np.zeros(0, np.int32), np.zeros(0, np.int64))


class Groups:
    """Union-find over positions; the root of a group is its smallest position."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether that made one group of two."""
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def near_links(points: np.ndarray, radius: int, leaf: int = 256) -> np.ndarray:
    """For distinct points of one shard: pairs of positions, each within ``radius``, as few as link what all such pairs link.

    The shard's own vantage-point tree prunes as the planned one does; a part
    that no boundary divides is compared in blocks, so that memory stays
    bounded, and what is linked already isn't linked again.
    """
    groups, links, rng = Groups(len(points)), [], np.random.default_rng(11)
    todo = [np.arange(len(points))]
    while todo:
        at = todo.pop()
        own = points[at]
        cut = split(own, radius, rng) if len(at) > leaf else None
        if cut:
            d = distances(own, cut[0])
            todo += [at[d <= cut[1]], at[d > cut[1] - radius]]
            continue
        for i in range(0, len(at), 256):
            if len(at) > leaf:  # dense: each point joins the first one it is near to, other links follow
                label = np.fromiter((groups.root(int(x)) for x in at[i:]), np.int64, len(at) - i)
            for j in range(i, len(at), 1 << 14):
                near = np.bitwise_count(own[i : i + 256, None] ^ own[None, j : j + (1 << 14)]) <= radius
                for x, row in enumerate(near):
                    hits = j - i + np.flatnonzero(row)
                    hits = hits[hits > x]
                    if len(hits) > 32 and len(at) > leaf:
                        hits = hits[np.unique(label[hits], return_index=True)[1]]
                    for y in hits.tolist():
                        ends = int(at[i + x]), int(at[i + y])
                        if groups.join(*ends):
                            links.append(ends)
    return np.array(links, np.int64).reshape(-1, 2)


def flat_tree(tree) -> bytes:
    """A planned tree as triples of longs, outer nodes first: (1, vantage, mu), or (0, shard's number, 0)."""
    out: list[int] = []

    def write(node):
        if isinstance(node, tuple):
            out.extend((1, int(node[0].view(np.int64)), node[1]))
            write(node[2])
            write(node[3])
        else:
            out.extend((0, node, 0))

    write(tree)
    return np.array(out, np.int64).tobytes()


def grown_tree(data: bytes):
    triples = iter(np.frombuffer(data, np.int64).reshape(-1, 3))

    def read():
        kind, value, mu = next(triples)
        return (value.view(np.uint64), int(mu), read(), read()) if kind else int(value)

    return read()


def shards(prints: DataFrame, radius: int, target: int, sample_rows: int, tree_bytes: int) -> DataFrame:
    """``shard, fingerprint``: every fingerprint in the shard that it lives in and in those that it visits.

    In rounds: of every shard of more than four times ``target`` points a sample of
    about ``sample_rows`` by hash plans a vantage-point tree, and the tree deals out all of the shard's
    points. A shard that no boundary divides stays as it is. Trees go to the
    executors in batches of about ``tree_bytes``. Shards that share a number by
    accident are one shard, which costs comparisons and loses nothing.
    """
    sc, kind = prints.sparkSession.sparkContext, "shard long, fingerprint long, final boolean"
    points, done = stored(prints.select(F.lit(0).cast("long").alias("shard"), "fingerprint")), []
    while True:
        big = stored(points.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * target))
        if big.isEmpty():
            break
        known = sized_broadcast(big, F.lit(32))
        done.append(points.join(known, "shard", "left_anti"))
        points = points.join(known, "shard")
        sample = points.where(F.pmod(F.xxhash64("fingerprint", "shard"), F.col("n")) < sample_rows)

        def planned(table: pa.Table) -> pa.Table:
            values = np.sort(table.column("fingerprint").to_numpy()).view(np.uint64)
            tree = plan(values, len(values) / table.column("n")[0].as_py(), target, radius)
            return pa.table({"shard": table.column("shard").slice(0, 1), "tree": pa.array([flat_tree(tree)] if isinstance(tree, tuple) else [None], pa.binary())})

        trees = stored(sample.groupBy("shard").applyInArrow(planned, "shard long, tree binary").where("tree is not null"))
        batches = max(1, -(-(trees.agg(F.sum(F.octet_length("tree"))).first()[0] or 0) // tree_bytes))
        parts = []
        for b in range(batches):
            mine = F.pmod(F.xxhash64("shard"), F.lit(batches)) == b
            shared = sc.broadcast({r.shard: r.tree for r in trees.where(mine).toLocalIterator()})

            def place(batches, shared=shared):
                grown: dict = {}
                for batch in batches:
                    own, values = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:2])
                    for shard in np.unique(own).tolist():
                        mine = values[own == shard]
                        if shard not in shared.value:
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), shard)), pa.array(mine), pa.array(np.ones(len(mine), bool))], names=["shard", "fingerprint", "final"])
                            continue
                        if shard not in grown:
                            grown[shard] = grown_tree(shared.value[shard])
                        number, index = shards_of(grown[shard], mine.view(np.uint64), radius)
                        names = np.array([xxhash.xxh64_intdigest(b"%d:%d" % (shard, x)) for x in range(int(number.max(initial=-1)) + 1)], np.uint64).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(names[number]), pa.array(mine[index]), pa.array(np.zeros(len(index), bool))], names=["shard", "fingerprint", "final"])

            parts.append(stored(points.where(mine).select("shard", "fingerprint").mapInArrow(place, kind)))
            shared.destroy()
        placed = parts[0]
        for p in parts[1:]:
            placed = placed.unionByName(p)
        done.append(placed.where("final").drop("final"))
        points = placed.where("not final").drop("final")
    for p in done:
        points = points.unionByName(p)
    return points


def near_edges(prints: DataFrame, radius: int = 2, target: int = 1024, sample_rows: int = 32768, tree_bytes: int = 32 << 20) -> DataFrame:
    """Edges ``(a, b)`` within ``radius`` whose components are those of all pairs of distinct ``fingerprint`` values within it.

    prints: a stored table of distinct fingerprints. Every pair within ``radius``
    meets in some shard of the tree. A shard emits fewer edges than it has points, not its pairs.
    """

    def link(table: pa.Table) -> pa.Table:
        values = np.unique(table.column("fingerprint").to_numpy())
        links = values[near_links(values.view(np.uint64), radius)]
        return pa.table({"a": pa.array(links[:, 1], pa.int64()), "b": pa.array(links[:, 0], pa.int64())})

    return shards(prints, radius, target, sample_rows, tree_bytes).groupBy("shard").applyInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 2, size: int = 3) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``, ``group_rows``.

    Fingerprints that differ in at most ``radius`` bits are linked; the component
    is named by the smallest doc_id reachable. Null and empty texts share
    fingerprint zero and are linked like any other; rows with a null doc_id get a
    component but never name one, unless no member has an id (then null). Repeated
    rows stay. An empty table gives none.

    Copies collapse to one fingerprint before anything is searched, so neither a
    large group nor its pairs meet in one task.
    """
    rows = stored(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), size=size).select("doc_id", "fingerprint"))
    prints = stored(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")))
    comps = connected_components(near_edges(prints, radius), small=1 << 18)
    named = stored(prints.join(comps.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select("fingerprint", "low", "n", F.coalesce("component", "fingerprint").alias("rep")))
    ids = stored(named.groupBy("rep").agg(F.min("low").alias("component_id"), F.sum("n").alias("group_rows")))
    labels = stored(named.select("fingerprint", "rep", "n").join(ids, "rep").select("fingerprint", "component_id", "group_rows", "n"))
    return with_counted(rows, labels, ["fingerprint"], "n").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id", "group_rows")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_bytes: int = 32 << 20, groups=near_duplicates, **options) -> DataFrame:
    """One row of each near-duplicate group of ``docs``, with its own columns: that of the smallest doc_id, nulls last.

    groups: what finds the groups, by default the links of op10. Grouping is by
    text: a doc_id that comes with several texts is as many documents, each of which
    stays or goes with the group of its own text; where the smallest doc_id comes
    with several texts of one group, the one of least MD5 stays. Of rows that repeat
    both id and text any one stays. Null and empty texts count as one text. An empty
    table gives none.

    Copies collapse to one row before any are compared. What goes and what is shared
    is found again by keys of 16 bytes, which are broadcast if they measure at most
    ``broadcast_bytes``, so texts aren't shuffled then; beyond, by shuffles that adaptive execution can split.
    """
    key, bare, at, n, group = spare([*docs.columns, "doc_id", "text"], "_key", "_bare", "_at", "_n", "_group")
    keyed = docs.withColumns({key: F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))), bare: F.col(doc_id).isNull()})
    texts = stored(keyed.groupBy(key).agg(F.min(F.struct(F.col(bare).alias("bare"), F.col(doc_id).alias("id"))).alias(at), F.min(text).alias("text"), F.count(F.lit(1)).alias(n)).withColumn("doc_id", F.monotonically_increasing_id()))
    found = groups(texts.select("doc_id", "text"), **options).select("doc_id", F.col("component_id").alias(group))
    best = F.min(F.struct(at, key, n)).alias("best")
    chosen = stored(found.join(texts.select("doc_id", key, at, n), "doc_id").groupBy(group).agg(best).select("best.*"))
    gone = stored(texts.select(key).join(chosen.select(key), key, "left_anti"))
    shared = stored(chosen.where(F.col(n) > 1))
    size = F.lit(64) + F.coalesce(F.octet_length(F.col(f"{at}.id").cast("string")), F.lit(0))
    left = keyed.join(sized_broadcast(gone, F.lit(32), broadcast_bytes), key, "left_anti")
    once = left.join(sized_broadcast(shared.select(key), F.lit(32), broadcast_bytes), key, "left_anti")
    often = left.join(sized_broadcast(shared, size, broadcast_bytes), key).where((F.col(bare) == F.col(f"{at}.bare")) & F.col(doc_id).eqNullSafe(F.col(f"{at}.id")))
    return once.select(*docs.columns).unionByName(often.dropDuplicates([key]).select(*docs.columns))

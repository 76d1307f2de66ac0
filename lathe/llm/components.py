"""Connected components by repeated contraction, in DataFrame operations; a small rest may be finished in one task."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.llm.common import stored


def united(edges: DataFrame) -> DataFrame:
    """``node, to`` of the ends of ``edges``: the smallest node reachable, by union-find in one task."""

    def run(batches):
        up: dict = {}

        def root(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up.setdefault(y, y)
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = sorted((root(a), root(b)))
                up[b] = a
        yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([root(x) for x in list(up)], kind)], names=["node", "to"])

    node = edges.schema["a"].dataType
    kind = pa.string() if isinstance(node, T.StringType) else pa.int64()
    return edges.select("a", "b").repartition(1).mapInArrow(run, T.StructType([T.StructField("node", node), T.StructField("to", node)]))


def connected_components(edges: DataFrame, max_rounds: int = 100, small: int = 0) -> DataFrame:
    """``edges(a, b)`` -> ``(node, component)``, component being the smallest node reachable.

    Null ends and self loops are ignored; a node without an edge does not appear.
    In every round each node moves to the first node of its closed neighbourhood
    and edges follow, until none is left. Even rounds take the nodes' own order
    (a star ends in two rounds), odd ones a hashed order (a long path loses a
    constant share of its nodes). Each round's tables are stored, so its joins
    read plain exchanges that adaptive execution can split when a node is hot.

    small: once at most so many edges are left, one task unites them, in place of
    rounds whose cost is in starting them. Nodes are longs or strings then. With 0
    nothing leaves DataFrame operations.
    """
    e = stored(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    moves: list[DataFrame] = []
    for i in range(max_rounds):
        if e.isEmpty():
            break
        if small and e.count() <= small:
            moves.append(stored(united(e)))
            break
        both = e.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(e.select(F.col("b").alias("node"), F.col("a").alias("other")))
        rank = (lambda c: F.struct(F.xxhash64(c, F.lit(i)).alias("r"), c.alias("n"))) if i % 2 else (lambda c: F.struct(c.alias("n")))
        first = both.groupBy("node").agg(F.min(rank(F.col("other"))).alias("f"))
        move = stored(first.select("node", F.least(F.col("f"), rank(F.col("node")))["n"].alias("to")))
        moves.append(move)
        moved = e.join(move.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").select("ta", "b")
        moved = moved.join(move.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b").where("ta <> tb")
        e = stored(moved.select(F.greatest("ta", "tb").alias("a"), F.least("ta", "tb").alias("b")).distinct())
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    if not moves:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    ends = moves.pop()
    while moves:
        move = moves.pop()
        later = ends.select(F.col("node").alias("to"), F.col("to").alias("end"))
        ends = stored(move.join(later, "to", "left").select("node", F.coalesce("end", "to").alias("to")))
    low = stored(ends.groupBy("to").agg(F.min("node").alias("component")))
    return stored(ends.join(low, "to").select("node", F.col("component")))

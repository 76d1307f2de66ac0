"""Balanced partitions of sequences by cost: algorithms over lists, and the same over batches of a table."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lathe.operators.rows import numbered

MOST_ITEMS = 1_000_000


def workload(length: int) -> int:
    return 24576 * length + length * length


def largest_differencing(costs: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """Karmarkar-Karp: merge the two most uneven partial solutions, heavy against light, until one is left.

    ``equal_size`` starts from groups of ``k`` neighbours in cost, so each part gets the same number of items.
    Parts come back sorted; none is empty if there are ``k`` items at least.
    """
    if len(costs) < k:
        raise ValueError("fewer items than parts")
    order = sorted(range(len(costs)), key=lambda i: (costs[i], i))
    if equal_size and len(order) % k:
        raise ValueError("the number of items must divide by the number of parts")
    seeds = [order[i : i + k] for i in range(0, len(order), k)] if equal_size else [[i] for i in order]
    heap = []
    for n, seed in enumerate(seeds):
        parts = sorted(((costs[i], [i]) for i in seed), reverse=True) + [(0, [])] * (k - len(seed))
        heap.append((parts[-1][0] - parts[0][0], n, parts))
    heapq.heapify(heap)
    tick = len(seeds)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        parts = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b), strict=True)), reverse=True)
        heapq.heappush(heap, (parts[-1][0] - parts[0][0], tick, parts))
        tick += 1
    return sorted(sorted(p) for _, p in heap[0][2])


def greedy(costs: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """Each item, in input order, to the first part of least cost (of those with fewest items, for equal sizes)."""
    bias = sum(costs) + 1 if equal_size else 0
    parts, totals = [[] for _ in range(k)], [0] * k
    for i, c in enumerate(costs):
        p = totals.index(min(totals))
        parts[p].append(i)
        totals[p] += c + bias
    return parts


def micro_batches(lengths: list[int], max_tokens: int, least: int = 1, multiple: int = 1) -> list[list[int]]:
    """As many batches as the total needs, balanced by workload, the light ones at both ends."""
    n = min(len(lengths), -(-sum(lengths) // max_tokens))
    n = -(-max(n, least) // multiple) * multiple
    work = [workload(x) for x in lengths]
    parts = sorted(largest_differencing(work, n), key=lambda p: (sum(work[i] for i in p), p[0]), reverse=True)
    return parts[::2][::-1] + parts[1::2]


def padded_batches(lengths: list[int], max_tokens: int, max_rows: int) -> list[list[int]]:
    """Sorted by length, a batch closes when rows or padded tokens would exceed the limits."""
    batches: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (lengths[i], i)):
        if batches and len(batches[-1]) < max_rows and (len(batches[-1]) + 1) * lengths[i] <= max_tokens:
            batches[-1].append(i)
        else:
            batches.append([i])
    return batches


def uid_groups(uids: list) -> list[list[int]]:
    """Runs of consecutive equal uids."""
    out: list[list[int]] = []
    for i, u in enumerate(uids):
        if i and u == uids[i - 1]:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def group_balanced(lengths: list[int], uids: list, k: int) -> list[list[int]]:
    """Prompt groups stay together; each part gets the same number of groups."""
    groups = uid_groups(uids)
    costs = [sum(workload(lengths[i]) for i in g) for g in groups]
    return [[i for g in part for i in groups[g]] for part in largest_differencing(costs, k, equal_size=True)]


def work(length: Column) -> Column:
    """``workload`` as a column."""
    return 24576 * length + length * length


def dealt(df: DataFrame, order: list, k: int, name: str = "part") -> DataFrame:
    """Adds the part of each row when rows are dealt in the order there and back: 0 .. k - 1, k - 1 .. 0, and so on. For any number of rows."""
    n = F.col("_n")
    turn = F.pmod(n, F.lit(k))
    return numbered(df, order).withColumn(name, F.when(F.pmod(F.floor(n / k), F.lit(2)) == 0, turn).otherwise(k - 1 - turn).cast("int")).drop("_n")


def assign(df: DataFrame, key: str, length: str, k: int, method=largest_differencing, name: str = "part", most_items: int = MOST_ITEMS) -> DataFrame:
    """Adds the part of each row, balanced by workload.

    The driver sees (key, length) of one batch of at most ``most_items`` rows,
    counted first. A longer one is dealt there and back from the heaviest row on,
    which nothing has to hold as a whole.
    """
    if df.count() > most_items:
        return dealt(df, [F.desc(length), key], k, name)
    rows = df.select(key, length).orderBy(key).collect()
    parts = method([workload(r[1]) for r in rows], k)
    pairs = [(rows[i][0], p) for p, items in enumerate(parts) for i in items]
    table = df.sparkSession.createDataFrame(pairs, f"{key} {dict(df.dtypes)[key]}, {name} int")
    return df.join(F.broadcast(table), key)


def in_batches(df: DataFrame, batch: str, order: str, split, name: str = "part") -> DataFrame:
    """Adds the part of each row within its batch. ``split`` maps a batch, a pandas table in the order, to lists of positions; a batch fits a task."""

    def run(rows):
        rows = rows.sort_values(order, ignore_index=True)
        part = [0] * len(rows)
        for p, items in enumerate(split(rows)):
            for i in items:
                part[i] = p
        return rows.assign(**{name: part})

    return df.groupBy(batch).applyInPandas(run, T.StructType([*df.schema.fields, T.StructField(name, T.IntegerType())]))


def micro_batch_order(df: DataFrame, batch: str, weight: Column, key: str, name: str = "at") -> DataFrame:
    """Adds each row's place in its batch: from the heaviest on every other row, turned round, then the rest; the light ones come at both ends."""
    w = Window.partitionBy(batch)
    r, n = F.row_number().over(w.orderBy(weight.desc(), key)) - 1, F.count(F.lit(1)).over(w)
    evens = F.floor((n + 1) / 2)
    return df.withColumn(name, F.when(r % 2 == 0, evens - 1 - F.floor(r / 2)).otherwise(evens + F.floor(r / 2)))


def rank_order(df: DataFrame, batch: str, weight: Column, key: str, name: str = "at") -> DataFrame:
    """Adds each row's place in its batch: from the lightest on every other row, then the rest turned round; the heavy ones come in the middle."""
    w = Window.partitionBy(batch)
    r, n = F.row_number().over(w.orderBy(weight, key)) - 1, F.count(F.lit(1)).over(w)
    return df.withColumn(name, F.when(r % 2 == 0, F.floor(r / 2)).otherwise(n - 1 - F.floor(r / 2)))


def padded(df: DataFrame, batch: str, key: str, length: str, max_tokens: int, max_rows: int) -> DataFrame:
    """``batch, key, part``: ``padded_batches`` of each batch as a fold over its rows by length; a batch is one row meanwhile."""
    rows = df.groupBy(batch).agg(F.sort_array(F.collect_list(F.struct(F.col(length).cast("long").alias("length"), F.col(key).alias("key")))).alias("rows"))
    start = F.struct(F.lit(-1).alias("part"), F.lit(max_rows).alias("count"), F.array().cast("array<int>").alias("parts"))

    def add(s, x):
        joins = (s["count"] < max_rows) & ((s["count"] + 1) * x["length"] <= max_tokens)
        part = F.when(joins, s["part"]).otherwise(s["part"] + 1)
        return F.struct(part.alias("part"), F.when(joins, s["count"] + 1).otherwise(1).alias("count"), F.array_append(s["parts"], part).alias("parts"))

    both = F.arrays_zip(F.transform("rows", lambda x: x["key"]).alias("key"), F.aggregate("rows", start, add, lambda s: s["parts"]).alias("part"))
    return rows.select(batch, F.explode(both).alias("x")).select(batch, F.col("x.key").alias(key), "x.part")


def least_loaded(df: DataFrame, batch: str, key: str, length: str, k: int) -> DataFrame:
    """``batch, key, part``: each row of a batch, in the order of keys, to the first part of least length so far, as a fold."""
    rows = df.groupBy(batch).agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("key"), F.col(length).cast("long").alias("length")))).alias("rows"))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), k).alias("sums"), F.array().cast("array<int>").alias("parts"))

    def add(s, x):
        least = (F.array_position(s["sums"], F.array_min(s["sums"])) - 1).cast("int")
        return F.struct(F.transform(s["sums"], lambda v, i: v + F.when(i == least, x["length"]).otherwise(0)).alias("sums"), F.array_append(s["parts"], least).alias("parts"))

    both = F.arrays_zip(F.transform("rows", lambda x: x["key"]).alias("key"), F.aggregate("rows", start, add, lambda s: s["parts"]).alias("part"))
    return rows.select(batch, F.explode(both).alias("x")).select(batch, F.col("x.key").alias(key), "x.part")


def imbalance(df: DataFrame, part: str, length: str) -> DataFrame:
    """min, max, their distance and mean of the parts' sums."""
    return df.groupBy(part).agg(F.sum(length).alias("s")).agg(F.min("s").alias("min"), F.max("s").alias("max"), (F.max("s") - F.min("s")).alias("minmax_diff"), F.avg("s").alias("mean"))

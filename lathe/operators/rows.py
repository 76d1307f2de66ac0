"""Row algebra: order, slices, repeats, unions, splits, samples, duplicates. Order is always by a declared key."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lathe.functions.text import hash_rank


def settled(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the folder that all executors share, so that every use sees the same partitions. Only a local master may do without one; it gets a temporary folder."""
    spark = df.sparkSession
    shared_folder(spark)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="lathe-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def numbered(df: DataFrame, order: list, name: str = "_n") -> DataFrame:
    """Adds the position 0.. in the total order of the columns ``order``.

    Rows are range-partitioned by the order and settled, since a second
    partitioning may draw other bounds; positions are a partition's own plus the
    rows before it, so no task sees the whole table.
    """
    spark = df.sparkSession
    parts = df.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), *order).sortWithinPartitions(*order)
    tagged = settled(parts.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() - (F.col("_p").cast("long") * F.lit(1 << 33))))
    counts = tagged.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # one row a partition
    return tagged.join(F.broadcast(before), "_p").withColumn(name, F.col("_b") + F.col("_i")).drop("_p", "_i", "_b")


def running_sum(df: DataFrame, order: list, value: Column, name: str = "sum", number: str | None = None) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to and with this one in the total order ``order``, and the position as ``number``.

    As in ``numbered``, a partition sums its own rows and adds what the partitions before it hold.
    """
    spark = df.sparkSession
    parts = df.withColumn("_v", value).repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), *order)
    tagged = settled(parts.withColumn("_p", F.spark_partition_id()))
    sums = tagged.groupBy("_p").agg(F.sum("_v").alias("_s"), F.count(F.lit(1)).alias("_c"))
    ahead = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    before = sums.select("_p", *(F.coalesce(F.sum(x).over(ahead), F.lit(0)).alias(y) for x, y in (("_s", "_b"), ("_c", "_d"))))
    own = Window.partitionBy("_p").orderBy(*order)
    out = tagged.join(F.broadcast(before), "_p").withColumn(name, F.col("_b") + F.sum("_v").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = out if number is None else out.withColumn(number, F.col("_d") + F.row_number().over(own) - 1)
    return out.drop("_p", "_v", "_b", "_d")


def take_slice(df: DataFrame, order: list, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    """Rows start:stop:step of the order; bounds are not negative and step is positive."""
    n = F.col("_n")
    keep = (n >= start) & ((n - start) % step == 0)
    return numbered(df, order).where(keep if stop is None else keep & (n < stop)).drop("_n")


def chunks(df: DataFrame, order: list, size: int, drop_tail: bool = False) -> DataFrame:
    """Adds ``chunk``; with ``drop_tail`` a short last chunk goes."""
    out = numbered(df, order).withColumn("chunk", F.floor(F.col("_n") / size))
    if drop_tail:
        full = df.count() // size
        out = out.where(F.col("chunk") < full)
    return out.drop("_n")


def equal_splits(df: DataFrame, order: list, parts: int) -> DataFrame:
    """Adds ``part``: contiguous splits of one size, the remainder dropped."""
    size = df.count() // parts
    return numbered(df, order).where(F.col("_n") < size * parts).withColumn("part", F.floor(F.col("_n") / max(size, 1))).drop("_n")


def repeat(df: DataFrame, times: int | str) -> DataFrame:
    """Each row ``times`` times (a number or a column of counts, 0 leaves none), numbered by ``rep`` from 0."""
    n = F.lit(times) if isinstance(times, int) else F.col(times)
    return df.withColumn("rep", F.explode(F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))))


def pad_to_multiple(df: DataFrame, order: list, size: int) -> DataFrame:
    """Rows from the head again until the count divides; marked by ``is_pad``."""
    n = df.count()
    missing = -n % size if n else 0
    out = df.withColumns({"is_pad": F.lit(False), "pad_round": F.lit(0)})
    full, rest = divmod(missing, n) if n else (0, 0)
    extra = [df.withColumns({"is_pad": F.lit(True), "pad_round": F.lit(i + 1)}) for i in range(full)]
    if rest:
        extra.append(df.orderBy(*order).limit(rest).withColumns({"is_pad": F.lit(True), "pad_round": F.lit(full + 1)}))
    for x in extra:
        out = out.unionByName(x)
    return out


def union_columns(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of both tables by key; columns in both must be equal (nulls and NaN equal themselves), else it raises."""
    both = [c for c in b.columns if c in a.columns and c not in keys]
    right = b.withColumnsRenamed({c: f"_b_{c}" for c in both})
    out = a.join(right, keys)
    for c in both:
        out = out.withColumn(c, F.when(F.col(c).eqNullSafe(F.col(f"_b_{c}")), F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs")))).drop(f"_b_{c}")
    return out


def holdout(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Adds ``split``: ``val`` for exactly ``n`` distinct keys, drawn by hashed order, else ``train``; a key's rows stay together."""
    val = df.select(key).distinct().orderBy(hash_rank(seed, F.col(key)), key).limit(n).withColumn("split", F.lit("val"))
    return df.join(val, key, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def stratified(df: DataFrame, strata: list[str], key: str, n: int, seed: int) -> DataFrame:
    """At most ``n`` rows of each stratum, drawn by hashed order; the window's group limit cuts before the shuffle."""
    w = Window.partitionBy(*strata).orderBy(hash_rank(seed, F.col(key)), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def dedup_questions(df: DataFrame, question: Column, gold: Column, key: str, seed: int) -> DataFrame:
    """One row, drawn by hash, of each normalised question; questions with conflicting golds go."""
    q = df.withColumns({"_q": question, "_g": gold})
    fine = q.groupBy("_q").agg(F.count_distinct("_g").alias("n")).where("n <= 1").select("_q")
    return first_per_key(q.join(fine, "_q", "left_semi"), ["_q"], [hash_rank(seed, F.col(key)), key]).drop("_q", "_g")


def conflicts(df: DataFrame, key: str, content: list[str]) -> DataFrame:
    """Keys that come with more than one content."""
    return df.groupBy(key).agg(F.count_distinct(F.struct(*content)).alias("contents")).where("contents > 1")


def runs(df: DataFrame, order: list, value: str, by: list[str] | None = None, name: str = "run") -> DataFrame:
    """Adds the number, from 0, of the run of consecutive equal values."""
    w = Window.partitionBy(*(by or [])).orderBy(*order)
    start = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_s", start).withColumn(name, F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1).drop("_s")


def rolling_mean(df: DataFrame, order: list, value: str, width: int, by: list[str], name: str = "smooth") -> DataFrame:
    """Centred mean over ``width`` points, fewer at the ends; an even width takes one more before."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(width // 2), width - 1 - width // 2)
    return df.withColumn(name, F.avg(value).over(w))


def last_n(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The newest ``n`` rows of each key: what a bounded buffer that drops the oldest holds."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def weighted_resample(df: DataFrame, key: str, weight: Column, draws: int, seed: int) -> DataFrame:
    """``draws`` rows with replacement, in proportion to weight, by the inverse of the cumulative weights; draws come from hashes.

    Draws and rows meet by range: both sit on the same grid of cumulative weight, one cell a draw on average.
    """
    cum = running_sum(df.withColumn("_w", weight), [key], F.col("_w"), "_e").withColumn("_a", F.col("_e") - F.col("_w"))
    total = float(cum.agg(F.max("_e")).first()[0] or 0.0)
    cell = total / draws
    spread = cum.withColumn("_k", F.explode(F.sequence(F.floor(F.col("_a") / cell), F.floor(F.col("_e") / cell))))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("draw").cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") / float(16**13)
    points = df.sparkSession.range(draws).withColumnRenamed("id", "draw").withColumn("_u", u * total).withColumn("_k", F.floor(F.col("_u") / cell))
    return spread.join(points, "_k").where("_u >= _a and _u < _e").drop("_w", "_e", "_a", "_k", "_u")


def select_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The named columns in their order; None keeps all, a missing one raises."""
    return df if columns is None else df.select(*present(df, columns))


def pop_columns(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the named columns, the rest); a missing one raises."""
    return df.select(*present(df, columns)), df.drop(*columns)


def rename_columns(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError(f"{len(old)} names can't become {len(new)}")
    present(df, old)
    return df.withColumnsRenamed(dict(zip(old, new, strict=True)))


def column_or(df: DataFrame, name: str, default: Column) -> Column:
    """The column with nulls filled, or the default where there is no such column."""
    return F.coalesce(F.col(name), default) if name in df.columns else default


def present(df: DataFrame, columns: list[str]) -> list[str]:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no columns {missing}")
    return columns


def take_rows(df: DataFrame, order: list, picks: DataFrame) -> DataFrame:
    """Rows by position in the order: ``picks(at, out)`` says which row comes at which place; a row may come more than once."""
    return numbered(df, order, "_n").join(picks.withColumnRenamed("at", "_n"), "_n").drop("_n")


def inverse_permutation(permutation: DataFrame) -> DataFrame:
    """``at, out`` turned round: what brings reordered rows back."""
    return permutation.select(F.col("out").alias("at"), F.col("at").alias("out"))


def head(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first ``n`` rows of the order."""
    return df.orderBy(*order).limit(n)


def concat(tables: list[DataFrame], order: list, name: str = "at") -> DataFrame:
    """Tables one after the other, each in its order, with the position in the whole; columns missing in some are null."""
    out = None
    for i, t in enumerate(tables):
        t = t.withColumn("_table", F.lit(i))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return numbered(out, ["_table", *order], name).drop("_table")


def shuffled(df: DataFrame, key: Column, seed: int, name: str = "at") -> DataFrame:
    """Adds the position in a seeded shuffle, which is the same on every run."""
    return numbered(df.withColumn("_h", hash_rank(seed, key)), ["_h", key], name).drop("_h")


def quantile_picks(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """``k`` rows of each group at evenly spread positions of the order, truncated to whole ones; all rows of a group that has no more."""
    w = Window.partitionBy(*by)
    n, r = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(*order)) - 1
    ranked = df.withColumns({"_n": n, "_r": r})
    spots = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / max(k - 1, 1)).cast("int"))
    return ranked.where((F.col("_n") <= k) | F.array_contains(spots, F.col("_r"))).drop("_n", "_r")


def spread_positions(length: Column, k: int) -> Column:
    """``k`` positions of 0 .. length - 1, evenly spread and truncated; empty for an empty response."""
    spots = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (length - 1) / max(k - 1, 1)).cast("int"))
    return F.when(length > 0, spots).otherwise(F.array().cast("array<int>"))

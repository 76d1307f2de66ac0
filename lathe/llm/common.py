"""Helpers shared by the training-data operators: materialised tables, free column names, sized broadcasts, hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local master may do without; it gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="lathe-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def stored(df: DataFrame, distinct: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there and a lost executor loses nothing. distinct: most values differ, so no dictionaries are tried."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    (df.write.option("parquet.enable.dictionary", "false") if distinct else df.write).parquet(path)
    if (paths := _written.get()) is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what ``stored`` writes inside; write the result elsewhere before that."""
    token = _written.set([])
    try:
        yield
    finally:
        paths = _written.get()
        _written.reset(token)
        for p in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Spark deletes an execution's shuffle files at its end; if a task should still ask for one, its stage runs again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tidy(operate: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator on a DataFrame whose own jobs delete their shuffle files as soon as each has ended, not when the driver happens to collect garbage.

    ``stored`` cuts lineage, so no later job reads them. The session's setting is as before when the operator returns.
    """

    @wraps(operate)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        conf = docs.sparkSession.conf
        before = conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")
        try:
            return operate(docs, *args, **options)
        finally:
            conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)

    return run


def spare(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores added as it takes to clash with none of ``columns``, whose case doesn't count."""
    taken = {c.lower() for c in columns}
    return [next(x for i in count() if (x := n + "_" * i).lower() not in taken) for n in names]


def with_counted(left: DataFrame, right: DataFrame, keys: list[str], n: str, parts: int = 1000, least: int = 1000) -> DataFrame:
    """Inner join with ``right``, a stored table of one row a key that says in column ``n`` how many rows of ``left`` hold the key.

    Keys that hold more than one ``parts``-th of all counted rows (and more than
    ``least``) are fewer than ``parts``, by arithmetic, so they are broadcast and their rows stay where they
    are; the rest are joined by a shuffle, in which no key is hot any more.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) > max(total // parts, least)
    if right.where(hot).isEmpty():
        return left.join(right, keys)
    heavy = F.broadcast(right.where(hot))
    rest = left.join(F.broadcast(right.where(hot).select(*keys)), keys, "left_anti").join(right.where(~hot), keys)
    return left.join(heavy, keys).unionByName(rest)


def sized_broadcast(df: DataFrame, size: Column, max_bytes: int = 32 << 20, wide: bool = False) -> DataFrame:
    """``df`` with a broadcast hint if its rows' bytes, by the column ``size``, sum to at most ``max_bytes``; else as it is, for a shuffled join.

    ``df`` should be a stored table, so that the sum is a cheap scan. wide: the other
    side's rows are, so a shuffled join is to hash ``df``'s rows and not to sort both sides.
    """
    if (df.agg(F.sum(size)).first()[0] or 0) <= max_bytes:
        return F.broadcast(df)
    return df.hint("shuffle_hash") if wide else df


def beside_few(rows: DataFrame, df: DataFrame, size: Column, key: str, max_bytes: int = 32 << 20) -> tuple[DataFrame, DataFrame]:
    """Wide ``rows`` and ``df``, a stored table, for an inner join by ``key``, a long, and more: ``df`` as by ``sized_broadcast``.

    If ``df`` is too large for that but its keys are not, rows whose ``key`` it lacks are left out before they are shuffled.
    """
    if 16 * df.count() <= max_bytes < (df.agg(F.sum(size)).first()[0] or 0):
        rows = rows.join(F.broadcast(df.select(key)), key, "left_semi").select(*rows.columns)
    return rows, sized_broadcast(df, size, max_bytes, wide=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col):
    """A-Z to a-z, nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value, body):
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]

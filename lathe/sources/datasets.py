"""Scans and sinks: dataset files, run logs, rollout dumps, trace shards, metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

READERS = {"parquet": "parquet", "json": "json", "jsonl": "json"}

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
PROMPTS = T.StructType(
    [
        T.StructField("data_source", T.StringType()),
        T.StructField("prompt", T.ArrayType(MESSAGE)),
        T.StructField("ability", T.StringType()),
        T.StructField("reward_model", T.StructType([T.StructField("style", T.StringType()), T.StructField("ground_truth", T.StringType())])),
        T.StructField("extra_info", T.MapType(T.StringType(), T.StringType())),
    ]
)


def read_dataset(spark: SparkSession, paths: list[str], schema: T.StructType | None = None, columns: list[str] | None = None) -> DataFrame:
    """Files of one or several formats by suffix, by name; columns missing in some are null. Other suffixes raise."""
    out = None
    for path in paths:
        suffix = path.rstrip("/").rpartition(".")[2]
        if suffix not in READERS:
            raise ValueError(f"unsupported file {path!r}")
        reader = spark.read.schema(schema) if schema else spark.read
        df = reader.format(READERS[suffix]).load(path)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no paths")
    return out if columns is None else keep_columns(out, columns)


def keep_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns that are there; none is an error."""
    found = [c for c in columns if c in df.columns]
    if not found:
        raise ValueError(f"none of {columns} in {df.columns}")
    return df.select(*found)


def parse_run_log(lines: DataFrame, text: str = "value", order: str = "line_no") -> DataFrame:
    """``step:N - key:value - ...`` lines -> ``step, name, value``; colour codes go, the last line of a key counts."""
    clean = F.regexp_replace(text, "\x1b\\[[0-9;]*m", "")
    parts = lines.select(order, F.try_to_number(F.nullif(F.regexp_extract(clean, r"step:(\d+)", 1), F.lit("")), F.lit("999999999")).cast("long").alias("step"), F.explode(F.split(clean, " - ")).alias("kv")).where("step is not null")
    pairs = parts.select(order, "step", F.trim(F.regexp_extract("kv", r"^\s*(.*):([^:]*)$", 1)).alias("name"), F.expr("try_cast(trim(regexp_extract(kv, '^\\\\s*(.*):([^:]*)$', 2)) as double)").alias("value"))
    return pairs.where("name <> '' and name <> 'step' and value is not null").groupBy("step", "name").agg(F.max_by("value", order).alias("value"))


def dump_generations(df: DataFrame, path: str) -> None:
    """One JSON line a sample, one folder a step."""
    df.write.mode("append").partitionBy("step").json(path)


def read_rollouts(spark: SparkSession, path: str, mask: str | None = None) -> DataFrame:
    """Rollout dumps with the step of their folder or numeric file name; ``mask`` is replaced in all strings."""
    df = spark.read.json(path)
    if "step" not in df.columns:
        df = df.withColumn("step", F.regexp_extract(F.input_file_name(), r"(\d+)[^/]*$", 1).cast("long"))
    if mask:
        df = df.withColumns({f.name: F.regexp_replace(f.name, mask, "*") for f in df.schema if isinstance(f.dataType, T.StringType)})
    return df


def write_shards(df: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """Typed Parquet, zstd, bounded files; Spark's commit protocol publishes all or nothing."""
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)


def cached_step(spark: SparkSession, path: str, step: int, make) -> DataFrame:
    """The stored table of a generation step, made and stored first if it isn't there."""
    where = f"{path}/gen_step={step}"
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")
    if not fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
        make().write.mode("overwrite").parquet(where)
    return spark.read.parquet(where)


def log_metrics(df: DataFrame, path: str) -> None:
    """Append ``step, name, value`` rows to a metrics table."""
    df.select("step", "name", "value").write.mode("append").parquet(path)


def latest_results(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key."""
    from lathe.operators.rows import first_per_key

    return first_per_key(df, keys, order)


def report(df: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """Wide table with the mean over the columns that a row has."""
    wide = df.groupBy(row).pivot(column, columns).agg(F.avg(value))
    present = F.array_compact(F.array(*(F.col(f"`{c}`") for c in columns)))
    return wide.withColumn("mean", F.aggregate(present, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(present), F.lit(0)))


def oversized_row_groups(path: str, columns: list[str], most_bytes: int) -> list[tuple[int, int]]:
    """(row group, bytes) of the groups whose columns take more than ``most_bytes`` uncompressed; reads a local file's footer only."""
    import pyarrow.parquet as pq

    meta = pq.ParquetFile(path).metadata
    out = []
    for i in range(meta.num_row_groups):
        g = meta.row_group(i)
        size = sum(g.column(j).total_uncompressed_size for j in range(g.num_columns) if g.column(j).path_in_schema.split(".")[0] in columns)
        if size > most_bytes:
            out.append((i, size))
    return out


def read_exact(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A shard whose files hold exactly the columns and types of ``schema``; anything else raises before a row is read. Nullability is the contract rules' part."""
    df = spark.read.parquet(path)
    found, wanted = ([(f.name, f.dataType) for f in s.fields] for s in (df.schema, schema))
    if found != wanted:
        raise ValueError(f"schema differs: {df.schema.simpleString()} is not {schema.simpleString()}")
    return df


def with_position(df: DataFrame) -> DataFrame:
    """A Parquet scan with ``file`` and ``row_index``, the place of each row."""
    return df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_index"))


def selected_rows(df: DataFrame, selection: DataFrame, key: str) -> DataFrame:
    """Rows of a Parquet scan by ``file`` (the path or its end, from the whole file name on) and ``row_index``; one whose ``key`` isn't the selection's raises."""
    name = lambda path: F.substring_index(path, "/", -1).alias("_name")
    chosen = selection.select(F.col("row_index"), F.col("file").alias("_file"), F.col(key).alias("_key"), name("file"))
    rows = with_position(df).select("*", name("file")).join(chosen, ["row_index", "_name"]).where(F.col("file").endswith(F.col("_file")))
    held = F.when(F.col(key).eqNullSafe(F.col("_key")), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("another row at "), F.col("row_index").cast("string"))).cast(df.schema[key].dataType))
    return rows.withColumn(key, held).drop("_file", "_key", "_name", "file")


def flat_params(params, sep: str = "/") -> dict:
    """Nested parameters as one level: keys joined by ``sep``; a list becomes its length (``list_len``) and its items by number."""

    def walk(x, path):
        if isinstance(x, (list, tuple)):
            x = {"list_len": len(x), **{str(i): v for i, v in enumerate(x)}}
        if isinstance(x, dict):
            for k, v in x.items():
                yield from walk(v, [*path, str(k)])
        else:
            yield sep.join(path), x

    return dict(walk(params or {}, []))


def path_key(path: Column) -> Column:
    """Name of a remote path in a cache: the MD5 of its text."""
    return F.md5(path.cast("binary"))


def metric_history(df: DataFrame, step: str = "step", value: str = "value", by: list[str] | None = None) -> DataFrame:
    """Steps above 0 that have a value, the first row of each step; rows come in the order of ``row``."""
    w = Window.partitionBy(*(by or []), step).orderBy("row")
    return df.where((F.col(step) > 0) & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*(by or []), step, value)

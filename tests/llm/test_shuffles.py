"""What op8 shuffles and how long it stays on disk."""

import time

from lathe.llm import common, lines
from pyspark.sql import functions as F


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(found.size()) if (name := found.apply(k).getName()).startswith("shuffle_")}


def documents(spark, n=60):
    words = [f"w{k}x" for k in range(300)]
    line = lambda i: " ".join(words[(i * 7 + k * k) % 300] for k in range(12))
    return spark.createDataFrame([(i if i % 9 else None, "\n".join([line(i), line(i // 2) + " end", line(i // 3), f"no {i}"])) for i in range(n)], "doc_id long, text string")


def test_shuffle_files_go_with_the_job_that_wrote_them(spark):
    # before, they stayed until the driver collected its garbage
    docs = documents(spark)
    before, setting = shuffle_files(spark), spark.conf.get(common.CLEANUP, None)
    found = lines.dedup_lines(docs)
    until = time.time() + 10
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(common.CLEANUP, None) == setting
    assert found.count() == 60 and sum(r.n_removed for r in found.collect()) > 60


def test_wide_rows_without_a_partner_are_left_out_before_the_shuffle(spark):
    # before, all rows were shuffled and sorted once the other side was too large to broadcast
    rows = spark.range(1000).select((F.col("id") % 100).alias("hash"), F.lit("text").alias("text"))
    few = common.stored(spark.range(10).select(F.col("id").alias("hash"), F.array(F.lit(1)).alias("at")))
    for most, narrowed, join in ((1000, 1000, "BroadcastHashJoin"), (999, 100, "ShuffledHashJoin"), (159, 1000, "ShuffledHashJoin")):
        left, right = common.beside_few(rows, few, F.lit(100), "hash", most)
        both = left.join(right, "hash")
        assert left.count() == narrowed and both.count() == 100
        assert join in both._jdf.queryExecution().executedPlan().toString()


def test_results_do_not_depend_on_what_is_broadcast(spark):
    docs = documents(spark)
    rows = lambda most: sorted(lines.dedup_lines(docs, broadcast_bytes=most).collect(), key=str)
    want = rows(32 << 20)
    assert rows(0) == want and rows(16 * 60) == want

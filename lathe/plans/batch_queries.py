"""Queries over batches: column and row selection, order, concatenation, balance, gates, values, rates and states."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathe.functions import answers, masked
from lathe.operators import balance, contracts, records, rows
from lathe.plans.adapters import TOKENS, table, trajectories
from lathe.plans.registry import query
from lathe.sources import datasets
from lathe.streaming import queues


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def batches(spark, sf_dir):
    """Documents in batches of 64 by id, with their lengths."""
    return documents(spark, sf_dir).select(F.floor(F.col("doc_id") / 64).alias("batch"), "doc_id", F.col("n_chars").alias("length"))


BATCHES = "batches AS (SELECT doc_id // 64 AS batch, doc_id, n_chars AS length, 24576 * n_chars + n_chars * n_chars AS w FROM documents)"


# --- columns ---------------------------------------------------------------------------------------------------------


@query("select_pop_rename", "SELECT doc_id, lang AS language, n_chars AS size FROM documents")
def select_pop_rename(spark, sf_dir):
    chosen = rows.select_columns(documents(spark, sf_dir), ["doc_id", "lang", "n_chars", "source"])
    _, rest = rows.pop_columns(chosen, ["source"])
    return rows.rename_columns(rest, ["lang", "n_chars"], ["language", "size"])


@query("column_defaults", "SELECT doc_id, coalesce(quality, -1) AS quality, 'none' AS reviewer FROM documents LEFT JOIN labels USING (doc_id)")
def column_defaults(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.select("doc_id", rows.column_or(d, "quality", F.lit(-1)).alias("quality"), rows.column_or(d, "reviewer", F.lit("none")).alias("reviewer"))


@query("keep_available_columns", "SELECT doc_id, lang FROM documents")
def keep_available(spark, sf_dir):
    return datasets.keep_columns(documents(spark, sf_dir), ["doc_id", "embedding", "lang"])


@query("prefixed_columns", "SELECT doc_id AS d_doc_id, n_chars AS d_n_chars FROM documents")
def prefixed_columns(spark, sf_dir):
    return records.prefixed(documents(spark, sf_dir).select("doc_id", F.col("n_chars").alias("d_n_chars")), "d_")


@query("nested_split_and_defaults", "SELECT doc_id, 'test' AS split, CASE WHEN lang = 'en' THEN doc_id ELSE 0 END AS index, CASE WHEN lang = 'en' THEN source ELSE '{}' END AS tools_kwargs FROM documents")
def nested_split_and_defaults(spark, sf_dir):
    d = documents(spark, sf_dir)
    info = F.when(F.col("lang") == "en", F.create_map(F.lit("index"), F.col("doc_id").cast("string"), F.lit("tools_kwargs"), F.col("source")))
    d = records.info_defaults(d.select("doc_id", info.alias("extra_info")))
    return records.set_split(d.withColumn("meta", F.struct(F.lit("train").alias("split"))), "test", "meta").select("doc_id", "meta.split", "index", "tools_kwargs")


@query("rows_to_columns_and_back", "SELECT conv_id, CAST(count(*) AS BIGINT) AS turns, string_agg(role || ':' || length(text), ',' ORDER BY turn) AS joined FROM conversations GROUP BY conv_id")
def rows_to_columns(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    columns = m.select("conv_id", F.transform("m", lambda x: x["role"]).alias("role"), F.transform("m", lambda x: x["text"]).alias("text"))
    back = columns.select("conv_id", F.arrays_zip("role", "text").alias("m"))
    return back.select("conv_id", F.size("m").cast("long").alias("turns"), F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), F.length(x["text"]).cast("string"))), ",").alias("joined"))


# --- rows and order --------------------------------------------------------------------------------------------------


@query("take_rows_by_index", "WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS at FROM documents), p AS (SELECT CAST(n_chars % 97 AS BIGINT) AS at, doc_id AS out FROM documents) SELECT p.out, n.doc_id FROM p JOIN n ON n.at = p.at")
def take_rows(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", "n_chars")
    picks = d.select((F.col("n_chars") % 97).cast("long").alias("at"), F.col("doc_id").alias("out"))
    return rows.take_rows(d, ["n_chars", "doc_id"], picks).select("out", "doc_id")


@query("mask_rows", "SELECT l.doc_id FROM labels l JOIN documents d USING (doc_id) WHERE toxic = 1 OR lang = 'de'")
def mask_rows(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("keep", (F.col("toxic") == 1) | (F.col("lang") == "de"))
    return d.where("keep").select("doc_id")


@query("reorder_and_restore", 'WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS "at" FROM documents), p AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS moved FROM documents) SELECT n.doc_id, moved, "at" AS restored FROM n JOIN p USING (doc_id)')
def reorder_and_restore(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", "n_chars")
    by_size = rows.numbered(rows.numbered(d, ["doc_id"], "at"), [F.desc("n_chars"), "doc_id"], "out").select("at", "out")
    moved = rows.take_rows(d, ["doc_id"], by_size).withColumnRenamed("out", "moved")
    back = rows.inverse_permutation(by_size)
    return moved.join(back.select(F.col("at").alias("moved"), F.col("out").alias("restored")), "moved").select("doc_id", "moved", "restored")


@query("head_in_order", "SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100")
def head_in_order(spark, sf_dir):
    return rows.head(documents(spark, sf_dir), [F.desc("n_chars"), "doc_id"], 100).select("doc_id")


@query("concatenated_tables", "SELECT row_number() OVER (ORDER BY t, id) - 1 AS at, id, lang FROM (SELECT 0 AS t, item_id AS id, NULL AS lang FROM benchmark UNION ALL SELECT 1, doc_id, lang FROM documents)")
def concatenated_tables(spark, sf_dir):
    a = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))
    return rows.concat([a, documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "lang")], ["id"]).select("at", "id", "lang")


@query("seeded_mix", "SELECT id, kind, row_number() OVER (ORDER BY sha256('7:' || kind || id), kind || id) - 1 AS at FROM (SELECT 'b' AS kind, item_id AS id FROM benchmark UNION ALL SELECT 'd', doc_id FROM documents)")
def seeded_mix(spark, sf_dir):
    a = table(spark, sf_dir, "benchmark").select(F.lit("b").alias("kind"), F.col("item_id").alias("id"))
    both = a.unionByName(documents(spark, sf_dir).select(F.lit("d").alias("kind"), F.col("doc_id").alias("id")))
    return rows.shuffled(both, F.concat("kind", F.col("id").cast("string")), 7)


@query("append_and_filter", "SELECT id, n FROM (SELECT item_id AS id, length(text) AS n FROM benchmark UNION ALL SELECT doc_id, n_chars FROM documents) WHERE n <= 2000")
def append_and_filter(spark, sf_dir):
    a = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.length("text").cast("long").alias("n"))
    return a.unionByName(documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("n_chars").alias("n"))).where("n <= 2000")


@query("quantile_picks", "WITH r AS (SELECT lang, doc_id, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents WINDOW w AS (PARTITION BY lang ORDER BY n_chars, doc_id)) SELECT lang, doc_id FROM r WHERE n <= 7 OR r IN (SELECT CAST(floor(i * (n - 1) / 6) AS BIGINT) FROM range(7) t(i))")
def quantile_picks(spark, sf_dir):
    return rows.quantile_picks(documents(spark, sf_dir).select("lang", "doc_id", "n_chars"), ["lang"], ["n_chars", "doc_id"], 7).select("lang", "doc_id")


@query("spread_positions", "SELECT doc_id, CAST(list_sum(list_transform(range(5), lambda i: CAST(floor(i * (n_chars - 1) / 4) AS BIGINT))) AS BIGINT) AS total FROM documents WHERE n_chars > 0")
def spread_positions(spark, sf_dir):
    spots = rows.spread_positions(F.col("n_chars"), 5)
    return documents(spark, sf_dir).where("n_chars > 0").select("doc_id", F.aggregate(spots, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("rows_by_file_position", "SELECT d.doc_id, d.source FROM documents d JOIN labels l USING (doc_id)")
def rows_by_position(spark, sf_dir):
    d = documents(spark, sf_dir)
    places = datasets.with_position(d).select("doc_id", "file", "row_index")
    chosen = places.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    return datasets.selected_rows(d, chosen, "doc_id").select("doc_id", "source")


@query("exact_schema_scan", "SELECT doc_id, quality, toxic FROM labels")
def exact_schema_scan(spark, sf_dir):
    path = f"{sf_dir}/labels.parquet"
    return datasets.read_exact(spark, path, spark.read.parquet(path).schema)


@query("metric_history", "SELECT user_id, step, value FROM (SELECT user_id, event_id // 20 AS step, value, row_number() OVER (PARTITION BY user_id, event_id // 20 ORDER BY event_id) AS r FROM events WHERE event_id // 20 > 0 AND value IS NOT NULL) WHERE r = 1")
def metric_history(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.floor(F.col("event_id") / 20).alias("step"), "value", F.col("event_id").alias("row"))
    return datasets.metric_history(e, by=["user_id"])


@query("path_keys", "SELECT page_id, md5(url) AS key FROM pages")
def path_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", datasets.path_key(F.col("url")).alias("key"))


# --- token masks -----------------------------------------------------------------------------------------------------


@query("response_mask_from_attention", f"WITH {TOKENS}, n AS (SELECT sid, pos, mask, count(*) OVER (PARTITION BY sid) AS n FROM tok) SELECT sid, CAST(sum(mask) AS BIGINT) AS valid, count(*) AS width FROM n WHERE pos >= n - 8 GROUP BY sid")
def response_mask_from_attention(spark, sf_dir):
    mask = F.col("mask")
    part = F.slice(mask, F.greatest(F.size(mask) - 8, F.lit(0)) + 1, F.lit(8))
    return trajectories(spark, sf_dir).select("sid", F.aggregate(part, F.lit(0), lambda a, x: a + x).cast("long").alias("valid"), F.size(part).cast("long").alias("width"))


@query("response_mask_from_end_token", "WITH e AS (SELECT user_id AS sid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_id % 11 AS id FROM events), f AS (SELECT sid, min(pos) FILTER (id IN (3, 7)) AS first, count(*) AS n FROM e GROUP BY sid) SELECT sid, coalesce(first, n) AS valid, n AS width FROM f")
def response_mask_from_end_token(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("sid")).agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id"))), lambda x: (x["event_id"] % 11).cast("int")).alias("ids"))
    mask = masked.response_mask_from_eos(F.col("ids"), [3, 7])
    return e.select("sid", F.aggregate(mask, F.lit(0), lambda a, x: a + x).cast("long").alias("valid"), F.size(mask).cast("long").alias("width"))


@query("valid_lengths", f"WITH {TOKENS} SELECT sid, CAST(sum(mask) AS DOUBLE) AS length FROM tok GROUP BY sid")
def valid_lengths(spark, sf_dir):
    return trajectories(spark, sf_dir).select("sid", masked.masked_count(F.col("mask")).cast("double").alias("length"))


@query("masked_extremes", f"WITH {TOKENS} SELECT min(old_lp - new_lp) FILTER (mask = 1) AS low, max(old_lp - new_lp) FILTER (mask = 1) AS high FROM tok")
def masked_extremes(spark, sf_dir):
    d = masked.pick(F.zip_with("old_lp", "new_lp", lambda a, b: a - b), F.col("mask"))
    return trajectories(spark, sf_dir).select(F.array_min(d).alias("a"), F.array_max(d).alias("b")).agg(F.min("a").alias("low"), F.max("b").alias("high"))


@query("clipped_by_columns", "SELECT event_id, greatest(least(value, 10.0 + event_id % 70), CAST(event_id % 10 AS DOUBLE)) AS value FROM events")
def clipped(spark, sf_dir):
    low, high = (F.col("event_id") % 10).cast("double"), F.lit(10.0) + F.col("event_id") % 70
    return table(spark, sf_dir, "events").select("event_id", F.greatest(F.least("value", high), low).alias("value"))


# --- balance ---------------------------------------------------------------------------------------------------------


@query("workload_estimates", f"WITH {BATCHES} SELECT doc_id, w, CAST((length + 127) // 128 * 128 AS BIGINT) AS rounded FROM batches")
def workloads(spark, sf_dir):
    n = F.col("length")
    return batches(spark, sf_dir).select("doc_id", balance.work(n).alias("w"), (F.floor((n + 127) / 128) * 128).alias("rounded"))


@query("dealt_there_and_back", "SELECT doc_id, CAST(CASE WHEN (r // 8) % 2 = 0 THEN r % 8 ELSE 7 - r % 8 END AS INTEGER) AS part FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS r FROM documents)")
def dealt(spark, sf_dir):
    return balance.dealt(documents(spark, sf_dir).select("doc_id", "n_chars"), [F.desc("n_chars"), "doc_id"], 8).select("doc_id", "part")


@query("micro_batch_order", f"WITH {BATCHES}, r AS (SELECT batch, doc_id, row_number() OVER (PARTITION BY batch ORDER BY w DESC, doc_id) - 1 AS r, count(*) OVER (PARTITION BY batch) AS n FROM batches) SELECT batch, doc_id, CASE WHEN r % 2 = 0 THEN (n + 1) // 2 - 1 - r // 2 ELSE (n + 1) // 2 + r // 2 END AS at FROM r")
def micro_batch_order(spark, sf_dir):
    return balance.micro_batch_order(batches(spark, sf_dir), "batch", balance.work(F.col("length")), "doc_id").select("batch", "doc_id", "at")


@query("rank_order", f"WITH {BATCHES}, r AS (SELECT batch, doc_id, row_number() OVER (PARTITION BY batch ORDER BY w, doc_id) - 1 AS r, count(*) OVER (PARTITION BY batch) AS n FROM batches) SELECT batch, doc_id, CASE WHEN r % 2 = 0 THEN r // 2 ELSE n - 1 - r // 2 END AS at FROM r")
def rank_order(spark, sf_dir):
    return balance.rank_order(batches(spark, sf_dir), "batch", balance.work(F.col("length")), "doc_id").select("batch", "doc_id", "at")


FITS = "w.c < 8 AND (w.c + 1) * s.length <= 40000"


@query("padded_micro_batches", f"WITH RECURSIVE {BATCHES}, s AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY length, doc_id) AS r FROM batches), w AS (SELECT batch, doc_id, r, 0 AS part, 1 AS c FROM s WHERE r = 1 UNION ALL SELECT s.batch, s.doc_id, s.r, CASE WHEN {FITS} THEN w.part ELSE w.part + 1 END, CASE WHEN {FITS} THEN w.c + 1 ELSE 1 END FROM w JOIN s ON s.batch = w.batch AND s.r = w.r + 1) SELECT batch, doc_id, part FROM w")
def padded(spark, sf_dir):
    return balance.padded(batches(spark, sf_dir), "batch", "doc_id", "length", 40000, 8)


LEAST = "list_position(w.sums, list_min(w.sums))"


@query("least_loaded_parts", f"WITH RECURSIVE {BATCHES}, s AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY doc_id) AS r FROM batches), w AS (SELECT batch, doc_id, r, 0 AS part, [length, 0, 0, 0] AS sums FROM s WHERE r = 1 UNION ALL SELECT s.batch, s.doc_id, s.r, CAST({LEAST} - 1 AS INTEGER), list_transform(w.sums, lambda x, i: x + CASE WHEN i = {LEAST} THEN s.length ELSE 0 END) FROM w JOIN s ON s.batch = w.batch AND s.r = w.r + 1) SELECT batch, doc_id, part FROM w")
def least_loaded(spark, sf_dir):
    return balance.least_loaded(batches(spark, sf_dir), "batch", "doc_id", "length", 4)


@query("differencing_parts")  # brute force in the tests
def differencing_parts(spark, sf_dir):
    found = balance.in_batches(batches(spark, sf_dir), "batch", "doc_id", lambda t: balance.largest_differencing([balance.workload(x) for x in t["length"]], 4) if len(t) >= 4 else [[i] for i in range(len(t))])
    return found.groupBy("batch", "part").agg(F.count(F.lit(1)).alias("docs"), F.sum("length").alias("chars"))


@query("dynamic_micro_batches")
def dynamic_micro_batches(spark, sf_dir):
    found = balance.in_batches(batches(spark, sf_dir), "batch", "doc_id", lambda t: balance.micro_batches(t["length"].tolist(), 60000))
    return found.groupBy("batch", "part").agg(F.count(F.lit(1)).alias("docs"), F.sum("length").alias("chars"))


@query("group_balanced_parts")
def group_balanced_parts(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.floor(F.col("conv_id") / 16).alias("batch"), "conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("at"), F.length("text").alias("length"))

    def split(t):
        uids = t["conv_id"].tolist()
        k = 4 if len(set(uids)) % 4 == 0 else 1
        return balance.group_balanced(t["length"].tolist(), uids, k)

    found = balance.in_batches(turns, "batch", "at", split)
    return found.groupBy("batch", "part").agg(F.count_distinct("conv_id").alias("conversations"), F.sum("length").alias("chars"))


@query("imbalance_before_and_after", """WITH r AS (SELECT n_chars, (row_number() OVER (ORDER BY doc_id) - 1) * 8 // (SELECT count(*) FROM documents) AS a, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS r FROM documents),
x AS (SELECT 'before' AS "when", a AS part, sum(n_chars) AS s FROM r GROUP BY ALL UNION ALL SELECT 'after', CASE WHEN (r // 8) % 2 = 0 THEN r % 8 ELSE 7 - r % 8 END, sum(n_chars) FROM r GROUP BY ALL)
SELECT "when", CAST(min(s) AS BIGINT) AS min, CAST(max(s) AS BIGINT) AS max, CAST(max(s) - min(s) AS BIGINT) AS minmax_diff, round(avg(s), 3) AS mean FROM x GROUP BY "when" """)
def imbalance_before_and_after(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", "n_chars")
    n = d.count()
    before = rows.numbered(d, ["doc_id"], "r").withColumn("part", F.floor(F.col("r") * 8 / n))
    after = balance.dealt(d, [F.desc("n_chars"), "doc_id"], 8)
    out = balance.imbalance(before, "part", "n_chars").withColumn("when", F.lit("before")).unionByName(balance.imbalance(after, "part", "n_chars").withColumn("when", F.lit("after")))
    return out.withColumn("mean", F.round("mean", 3))


# --- contracts -------------------------------------------------------------------------------------------------------

LIMITS = {"mean_chars": ("<=", 1e9), "share_en": (">=", 0.99), "max_chars": ("<=", 10.0), "absent": (">=", 0.0)}


@query("metric_gates", """WITH m AS (SELECT 'mean_chars' AS name, avg(n_chars) AS value FROM documents UNION ALL SELECT 'share_en', avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END) FROM documents UNION ALL SELECT 'max_chars', max(n_chars) FROM documents),
l(name, rule, "limit") AS (VALUES ('mean_chars', '<=', 1e9), ('share_en', '>=', 0.99), ('max_chars', '<=', 10.0), ('absent', '>=', 0.0))
SELECT l.name, round(value, 6) AS value, rule, CAST("limit" AS DOUBLE) AS "limit", coalesce(CASE WHEN rule = '<=' THEN value <= "limit" ELSE value >= "limit" END, FALSE) AS passed FROM l LEFT JOIN m USING (name)""")
def metric_gates(spark, sf_dir):
    m = documents(spark, sf_dir).agg(F.avg("n_chars").alias("mean_chars"), F.avg(F.when(F.col("lang") == "en", 1.0).otherwise(0.0)).alias("share_en"), F.max("n_chars").cast("double").alias("max_chars"))
    long = m.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in m.columns))).alias("x")).select("x.*")
    return contracts.gates(long, LIMITS).withColumn("value", F.round("value", 6))


@query("overlay_report", """WITH o AS (SELECT doc_id, CASE WHEN source = 'src1' THEN 'xx' ELSE lang END AS lang FROM documents WHERE source <> 'src0' UNION ALL SELECT doc_id, lang FROM documents WHERE source = 'src2'),
j AS (SELECT d.doc_id AS a, o.doc_id AS b, d.lang AS x, o.lang AS y FROM documents d FULL JOIN o ON d.doc_id = o.doc_id)
SELECT 'missing' AS "check", count(*) FILTER (b IS NULL) AS failures FROM j UNION ALL SELECT 'extra', count(*) FILTER (a IS NULL) FROM j UNION ALL SELECT 'lang_differs', count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND x IS DISTINCT FROM y) FROM j
UNION ALL SELECT 'repeated', count(*) FROM (SELECT doc_id FROM o GROUP BY doc_id HAVING count(*) > 1)""")
def overlay_report(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", "lang", "source")
    o = d.where("source <> 'src0'").withColumn("lang", F.when(F.col("source") == "src1", "xx").otherwise(F.col("lang"))).unionByName(d.where("source = 'src2'"))
    return contracts.overlay_report(d, o, "doc_id", ["lang"])


@query("index_mismatches", "SELECT doc_id, expected FROM (SELECT doc_id, CASE WHEN lang = 'fr' THEN doc_id + 1 ELSE doc_id END AS idx, row_number() OVER (ORDER BY doc_id) - 1 AS expected FROM documents) WHERE idx IS DISTINCT FROM expected")
def index_mismatches(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", F.when(F.col("lang") == "fr", F.col("doc_id") + 1).otherwise(F.col("doc_id")).alias("idx"))
    return contracts.index_mismatches(d, ["doc_id"], "idx").select("doc_id", "expected")


# --- values and scores -----------------------------------------------------------------------------------------------


@query("same_values", "SELECT p_partkey AS id, (p_size + p_partkey) % 8 < 6 AS same FROM part")
def same_values(spark, sf_dir):
    n, kind = F.col("p_size").cast("string"), (F.col("p_size") + F.col("p_partkey")) % 8
    half = (F.col("p_size") / 2).cast("string")
    pred = (
        F.when(kind == 0, F.concat(F.lit("\\frac{"), n, F.lit("}{2}")))
        .when(kind == 1, F.concat(F.lit("("), n, F.lit(", 1/2)")))
        .when(kind == 2, F.concat(n, F.lit("\\%")))
        .when(kind == 3, F.concat(n, F.lit(" million feet")))
        .when(kind == 4, F.concat(n, F.lit("\\pi")))
        .when(kind == 5, F.concat(n, F.lit(",000 meters")))
        .when(kind == 6, F.concat(F.lit("["), n, F.lit(", 9)")))
        .otherwise(F.concat(n, F.lit("x")))
    )
    gold = (
        F.when(kind == 0, half)
        .when(kind == 1, F.concat(F.lit("("), n, F.lit(".0,\\frac12)")))
        .when(kind == 2, (F.col("p_size") / 100).cast("string"))
        .when(kind == 3, F.concat(n, F.lit("000000")))
        .when(kind == 4, (F.col("p_size") * 3.14159265).cast("string"))
        .when(kind == 5, F.concat(n, F.lit("000")))
        .when(kind == 6, F.concat(F.lit("["), n, F.lit(", 9]")))
        .otherwise(F.concat(n, F.lit("y")))
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), answers.same_value(pred, gold).alias("same"))


@query("score_strict_value", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 1.0 ELSE 0.0 END AS score FROM part")
def score_strict_value(spark, sf_dir):
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    box = F.concat(F.lit("\\boxed{\\frac{"), size, F.lit("}{4}}"))
    text = F.when(kind == 0, F.concat(F.lit("so "), box)).when(kind == 1, F.concat(box, F.lit(" or "), box)).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), answers.strict_value_score(text, (F.col("p_size") / 4).cast("string")).alias("score"))


@query("marked_answers", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN '7' END AS answer FROM part")
def marked_answers(spark, sf_dir):
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    text = F.when(kind == 0, F.concat(F.lit("The answer is 3. Final Answer: "), size, F.lit(".\nDone"))).when(kind == 1, F.lit("Answer: none, so \\boxed{7}")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), answers.marked_answer(text).alias("answer"))


@query("case_scores", "SELECT user_id, CASE WHEN bool_and(ok) THEN 1.0 ELSE round(sum(CASE WHEN r <= 10 AND ok THEN 1 ELSE 0 END) / least(count(*), 10), 6) END AS score FROM (SELECT user_id, value > 20 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) GROUP BY user_id")
def case_scores(spark, sf_dir):
    results = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", (F.col("value") > 20).alias("ok")))), lambda x: x["ok"]).alias("passed"))
    return results.select("user_id", F.round(answers.case_score(F.col("passed"), continuous=True), 6).alias("score"))


@query("labels_and_formats", "SELECT p_partkey AS id, 'run_' || p_size AS label, CAST(p_size AS INTEGER) AS step, format('{:.1f}%', p_size / 50.0 * 100) AS percent, strftime(TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 SECOND * p_partkey, '%Y-%m-%dT%H:%M:%SZ') AS at FROM part")
def labels_and_formats(spark, sf_dir):
    path = F.concat(F.lit("org/run_"), F.col("p_size").cast("string"))
    label = F.substring_index(path, "/", -1)
    at = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("p_partkey")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), label.alias("label"), F.coalesce(F.substring_index(label, "_", -1).try_cast("int"), F.lit(0)).alias("step"), F.format_string("%.1f%%", F.col("p_size") / 50.0 * 100).alias("percent"), at.alias("at"))


# --- rates and states ------------------------------------------------------------------------------------------------

# Seconds since the first event, so that doubles hold them well.
ARRIVALS = 'a AS (SELECT user_id, event_id, ts, epoch(ts - (SELECT min(ts) FROM events)) AS "at", 1 + event_id % 3 AS cost FROM events)'


@query("rate_limited_starts", f"""WITH {ARRIVALS}, s AS (SELECT *, sum(cost / 0.001) OVER w AS s FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, s + max("at" - (s - cost / 0.001)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS f FROM s) SELECT user_id, event_id, round(greatest("at", f - 5 / 0.001), 3) AS start FROM f""")
def rate_limited_starts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    first = e.agg(F.min("ts").alias("t0"))  # one row
    e = e.join(F.broadcast(first)).withColumn("at", (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))) / 1e6)
    out = queues.rate_limited(e, ["user_id"], ["ts", "event_id"], "at", 1 + F.col("event_id") % 3, 0.001, 5)
    return out.select("user_id", "event_id", F.round("start", 3).alias("start"))


STEPS = {"view": "start", "click": "tool_call", "purchase": "tool_result", "error": "stop"}
NEXT = " ".join(f"WHEN s = '{s}' AND e = '{e}' THEN '{to}'" for (s, e), to in queues.ROLLOUT.items())


@query("rollout_states", f"WITH t AS (SELECT user_id, list(CASE event_type {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in STEPS.items())} ELSE 'interaction' END ORDER BY ts, event_id) AS e FROM events GROUP BY user_id) SELECT user_id, list_reduce(list_prepend('PENDING', e), lambda s, e: CASE {NEXT} ELSE s END) AS state, CAST(len(e) AS BIGINT) AS n FROM t")
def rollout_states(spark, sf_dir):
    kind = F.lit("interaction")
    for k, v in STEPS.items():
        kind = F.when(F.col("event_type") == k, v).otherwise(kind)
    t = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", kind.alias("e")))), lambda x: x["e"]).alias("e"))
    s = queues.states(F.col("e"))
    return t.select("user_id", F.element_at(s, -1).alias("state"), F.size(s).cast("long").alias("n"))

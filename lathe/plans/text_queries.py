"""Queries over prompts, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathe.functions import answers
from lathe.functions import text as T
from lathe.operators import contracts, rows
from lathe.plans.adapters import table
from lathe.plans.registry import query

INSTRUCTION = "Answer in one line."


@query("scan_documents", "SELECT doc_id, source AS data_source, n_chars FROM documents WHERE n_chars >= 100 AND lang = 'en'")
def scan_documents(spark, sf_dir):
    from lathe.sources.datasets import read_dataset

    df = read_dataset(spark, [f"{sf_dir}/documents.parquet"], columns=["doc_id", "source", "n_chars", "lang", "not_there"])
    return df.where("n_chars >= 100 and lang = 'en'").select("doc_id", F.col("source").alias("data_source"), "n_chars")


@query(
    "prompt_records",
    f"""SELECT conv_id, turn, 'src/' || role AS data_source, CASE WHEN ends_with(trim(text, ' '), '{INSTRUCTION}') THEN trim(text, ' ') ELSE trim(text, ' ') || ' {INSTRUCTION}' END AS content,
  'user' AS role, 'rule' AS style, CAST(row_number() OVER (ORDER BY conv_id, turn) - 1 AS BIGINT) AS idx FROM conversations WHERE role = 'user'""",
)
def prompt_records(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").where("role = 'user'")
    prompt = F.array(F.struct(F.lit("user").alias("role"), T.with_suffix(F.col("text"), INSTRUCTION).alias("content")))
    df = df.select("conv_id", "turn", F.concat(F.lit("src/"), "role").alias("data_source"), prompt.alias("prompt"), F.struct(F.lit("rule").alias("style")).alias("reward_model"))
    last = F.element_at("prompt", -1)
    out = rows.numbered(df, ["conv_id", "turn"], "idx")
    return out.select("conv_id", "turn", "data_source", last["content"].alias("content"), last["role"].alias("role"), "reward_model.style", "idx")


@query(
    "conversation_messages",
    """SELECT conv_id, CAST(count(*) AS BIGINT) AS n_messages, string_agg(role, ',' ORDER BY turn) AS roles, CAST(sum(length(text)) AS BIGINT) AS n_chars
  FROM conversations WHERE role <> 'system' GROUP BY conv_id HAVING bool_or(role = 'user') AND bool_or(role = 'assistant') AND max(length(text)) <= 4000""",
)
def conversation_messages(spark, sf_dir):
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    m = F.filter("messages", lambda x: x["role"] != "system")
    fine = F.forall(m, lambda x: (F.length(x["text"]) <= 4000) & x["role"].isin("user", "assistant")) & F.exists(m, lambda x: x["role"] == "user") & F.exists(m, lambda x: x["role"] == "assistant")
    return grouped.where(fine).select("conv_id", F.size(m).cast("long").alias("n_messages"), F.array_join(F.transform(m, lambda x: x["role"]), ",").alias("roles"), F.aggregate(m, F.lit(0), lambda a, x: a + F.length(x["text"])).cast("long").alias("n_chars"))


@query("loss_mask_by_role", "SELECT conv_id, CAST(sum(CASE WHEN role = 'assistant' THEN len(list_filter(string_split(text, ' '), lambda x: x <> '')) ELSE 0 END) AS BIGINT) AS trained, CAST(sum(len(list_filter(string_split(text, ' '), lambda x: x <> ''))) AS BIGINT) AS total FROM conversations GROUP BY conv_id")
def loss_mask_by_role(spark, sf_dir):
    tokens = F.filter(F.split("text", " "), lambda x: x != "")
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.size(tokens).alias("n")))).alias("m"))
    mask = F.flatten(F.transform("m", lambda x: F.array_repeat(F.when(x["role"] == "assistant", 1).otherwise(0), x["n"])))
    return grouped.select("conv_id", F.aggregate(mask, F.lit(0), lambda a, x: a + x).cast("long").alias("trained"), F.size(mask).cast("long").alias("total"))


@query("overlong_prompt_filter", "SELECT doc_id FROM documents WHERE len(list_filter(string_split(text, ' '), lambda x: x <> '')) <= 256")
def overlong_prompt_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.size(F.filter(F.split("text", " "), lambda x: x != "")) <= 256).select("doc_id")


@query("completion_cleanup", r"SELECT conv_id, turn, replace(regexp_replace(replace(trim(text, ' '), ' [title]', '. '), '\[.*?\]', '', 'g'), '  ', ' ') AS cleaned, upper(substr(text, 1, 1)) || lower(substr(text, 2)) AS capitalised FROM conversations WHERE lower(text) = translate(lower(text), 'ß', 'ß')")
def completion_cleanup(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.clean_completion(F.col("text")).alias("cleaned"), T.capitalised(F.col("text")).alias("capitalised"))


# A word's edge lies between a letter, digit or underscore of any script and something else; matches overlap by a space, so the articles are taken out twice.
ARTICLES = r"'(^|[^\p{L}\p{N}_])(?:a|an|the)([^\p{L}\p{N}_]|$)', '\1 \2', 'g'"


@query("qa_normal_form", rf"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{{-~]', '', 'g'), {ARTICLES}), {ARTICLES}), '[ \t\n\r\f\x0B]+', ' ', 'g'), ' ') AS normal FROM conversations")
def qa_normal_form(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.qa_normal(F.col("text")).alias("normal"))


@query("final_number_scores", r"""WITH n AS (SELECT doc_id, source, regexp_extract_all(right(text, 300), '-?[0-9.,]+') AS f FROM documents),
r AS (SELECT doc_id, source, list_filter(f, lambda x: x NOT IN ('', '.')) AS g, f FROM n)
SELECT doc_id, source, coalesce(g[len(g)], f[1]) AS answer, CASE WHEN coalesce(g[len(g)], f[1]) IS NULL THEN 0.0 WHEN coalesce(g[len(g)], f[1]) = CAST(doc_id % 10 AS VARCHAR) THEN 1.0 ELSE 0.25 END AS score FROM r""")
def final_number_scores(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", T.last_number(F.col("text")).alias("answer"), answers.gsm8k_score(F.col("text"), (F.col("doc_id") % 10).cast("string"), strict=False, format_score=0.25).alias("score"))


@query("offline_eval", r"""WITH s AS (SELECT conv_id, role, CASE WHEN regexp_matches(text, '[0-9]') THEN 1.0 ELSE 0.0 END AS score FROM conversations),
r AS (SELECT role, conv_id, avg(score) AS m FROM s GROUP BY role, conv_id) SELECT role, round(avg(m), 9) AS score, count(*) AS rows FROM r GROUP BY role""")
def offline_eval(spark, sf_dir):
    from lathe.operators.metrics import mean_of_means

    scored = table(spark, sf_dir, "conversations").withColumn("score", F.when(F.col("text").rlike("[0-9]"), 1.0).otherwise(0.0))
    return mean_of_means(scored, "role", "conv_id", "score").withColumn("score", F.round("score", 9))


def question_key_sql(column: str) -> str:
    """The question key in DuckDB's regular expressions, whose white space lacks the vertical tab and whose groups are numbered by backslashes."""
    out = f"trim(lower({column}), ' ')"
    for pattern, to in T.QUESTION_STEPS:
        pattern, to = pattern.replace(r"\s", r"[ \t\n\r\f\x0B]").replace("'", "''"), to.replace("$", "\\").replace("\\\\frac", "\\\\frac")
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return f"trim({out}, ' ')"


@query("dedup_questions_max_strength", f"""WITH q AS (SELECT doc_id, source, md5({question_key_sql("text")}) AS k FROM documents),
g AS (SELECT k FROM q GROUP BY k HAVING count(DISTINCT source) <= 1),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY q.k ORDER BY sha256('11:' || CAST(doc_id AS VARCHAR)), doc_id) AS n FROM q JOIN g ON q.k = g.k) SELECT doc_id, source FROM r WHERE n = 1""")
def dedup_questions_max_strength(spark, sf_dir):
    key = F.md5(T.question_key(F.col("text")).cast("binary"))
    return rows.dedup_questions(table(spark, sf_dir, "documents"), key, F.col("source"), "doc_id", 11).select("doc_id", "source")


@query("exact_duplicates", "SELECT sha256(text) AS text_sha256, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("text_sha256")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query("question_overlap", "SELECT DISTINCT sha256(d.text) AS key FROM documents d WHERE d.source = 'src0' AND sha256(d.text) IN (SELECT sha256(text) FROM documents WHERE source <> 'src0')")
def question_overlap(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return contracts.overlap(d.where("source = 'src0'"), d.where("source <> 'src0'"), F.sha2("text", 256))


@query("excluded_hash_anti_join", "SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source = 'src1')")
def excluded_hash_anti_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("h", F.sha2("text", 256))
    return d.join(d.where("source = 'src1'").select("h").distinct(), "h", "left_anti").select("doc_id")


@query("conflicting_content", "SELECT n_chars, count(DISTINCT text) AS contents FROM documents GROUP BY n_chars HAVING count(DISTINCT text) > 1")
def conflicting_content(spark, sf_dir):
    return rows.conflicts(table(spark, sf_dir, "documents"), "n_chars", ["text"])


@query("deterministic_seeds", "SELECT doc_id, CASE WHEN s = 0 THEN 1 ELSE s END AS seed FROM (SELECT doc_id, CAST(CAST('0x' || substr(sha256('7' || chr(0) || source || chr(0) || CAST(doc_id AS VARCHAR)), 1, 16) AS UBIGINT) % 2147483647 AS BIGINT) AS s FROM documents)")
def deterministic_seeds(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.sampling_seed(F.lit("7"), F.col("source"), F.col("doc_id")).alias("seed"))


@query("holdout_split", """WITH v AS (SELECT source FROM (SELECT DISTINCT source FROM documents) ORDER BY sha256('5:' || source), source LIMIT 3)
SELECT doc_id, source, CASE WHEN source IN (SELECT source FROM v) THEN 'val' ELSE 'train' END AS split FROM documents""")
def holdout_split(spark, sf_dir):
    return rows.holdout(table(spark, sf_dir, "documents"), "source", 3, 5).select("doc_id", "source", "split")


@query("stratified_sample", "SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY sha256('3:' || CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents) WHERE r <= 2")
def stratified_sample(spark, sf_dir):
    return rows.stratified(table(spark, sf_dir, "documents"), ["source", "lang"], "doc_id", 2, 3).select("doc_id", "source", "lang")


@query("random_top_n_sample", "SELECT doc_id FROM documents ORDER BY sha256('9:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 50")
def random_top_n_sample(spark, sf_dir):
    return table(spark, sf_dir, "documents").orderBy(T.hash_rank(9, F.col("doc_id")), "doc_id").limit(50).select("doc_id")


@query("slice_with_step", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS n FROM documents) WHERE n >= 5 AND n < 400 AND (n - 5) % 7 = 0")
def slice_with_step(spark, sf_dir):
    return rows.take_slice(table(spark, sf_dir, "documents"), ["n_chars", "doc_id"], 5, 400, 7).select("doc_id")


@query("fixed_size_chunks", "SELECT chunk, count(*) AS n, min(doc_id) AS low FROM (SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 64) AS BIGINT) AS chunk FROM documents) GROUP BY chunk")
def fixed_size_chunks(spark, sf_dir):
    return rows.chunks(table(spark, sf_dir, "documents"), ["doc_id"], 64).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"))


@query("equal_positional_splits", "SELECT part, count(*) AS n, max(doc_id) AS high FROM (SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / ((SELECT count(*) FROM documents) // 7)) AS BIGINT) AS part FROM documents) WHERE part < 7 GROUP BY part")
def equal_positional_splits(spark, sf_dir):
    return rows.equal_splits(table(spark, sf_dir, "documents"), ["doc_id"], 7).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("high"))


@query("repeat_rows", "SELECT item_id, CAST(rep AS INTEGER) AS rep FROM (SELECT item_id, unnest(range(item_id % 4)) AS rep FROM benchmark)")
def repeat_rows(spark, sf_dir):
    return rows.repeat(table(spark, sf_dir, "benchmark").withColumn("k", (F.col("item_id") % 4).cast("int")), "k").select("item_id", "rep")


@query("pad_to_multiple", "WITH n AS (SELECT count(*) AS c FROM benchmark) SELECT item_id, FALSE AS is_pad FROM benchmark UNION ALL SELECT item_id, TRUE FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) AS r FROM benchmark) WHERE r <= (SELECT (64 - c % 64) % 64 FROM n)")
def pad_to_multiple(spark, sf_dir):
    # every scale's benchmark has more rows than one pad round takes, or is repeated whole
    b = table(spark, sf_dir, "benchmark")
    return rows.pad_to_multiple(b, ["item_id"], 64).where("pad_round <= 1").select("item_id", "is_pad")


@query("column_union_by_key", "SELECT d.doc_id, source, lang, n_chars, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def column_union_by_key(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    right = lab.join(d.select("doc_id", "source"), "doc_id")
    return rows.union_columns(d.select("doc_id", "source", "lang", "n_chars"), right, ["doc_id"])


@query("ground_truth_lookup", "SELECT d.doc_id, coalesce(CAST(quality AS DOUBLE), 0.0) AS score FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def ground_truth_lookup(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.coalesce(F.col("quality").cast("double"), F.lit(0.0)).alias("score"))


@query("semi_join_membership", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join_membership(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi")


@query("heldout_complement", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def heldout_complement(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("missing_and_extra", "SELECT doc_id, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'extra' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def missing_and_extra(spark, sf_dir):
    return contracts.differences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("rejection_sampling_filter", "SELECT source, count(*) AS kept FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality > 0.5 GROUP BY source")
def rejection_sampling_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("quality > 0.5"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("kept"))


@query("preference_explode", "SELECT conv_id, turn, kind, length(content) AS n FROM (SELECT conv_id, turn, 'chosen' AS kind, text AS content FROM conversations UNION ALL SELECT conv_id, turn, 'rejected', role FROM conversations)")
def preference_explode(spark, sf_dir):
    pair = F.explode(F.array(F.struct(F.lit("chosen").alias("kind"), F.col("text").alias("content")), F.struct(F.lit("rejected").alias("kind"), F.col("role").alias("content"))))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", pair.alias("x")).select("conv_id", "turn", "x.kind", F.length("x.content").cast("long").alias("n"))


@query("positional_rm_split", "SELECT doc_id, CASE WHEN r < 0.75 * c THEN 'train' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS c FROM documents)")
def positional_rm_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    n = d.count()
    return rows.numbered(d.select("doc_id"), ["doc_id"]).select("doc_id", F.when(F.col("_n") < 0.75 * n, "train").otherwise("test").alias("split"))


@query("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("metric_key_sanitiser", r"SELECT DISTINCT regexp_replace(regexp_replace(replace(event_type || '@' || CAST(user_id % 5 AS VARCHAR) || '//x:y', '@', '_at_'), '/+', '/', 'g'), '[^A-Za-z0-9_\-. /]', '_', 'g') AS key FROM events")
def metric_key_sanitiser(spark, sf_dir):
    raw = F.concat("event_type", F.lit("@"), (F.col("user_id") % 5).cast("string"), F.lit("//x:y"))
    return table(spark, sf_dir, "events").select(T.metric_key(raw).alias("key")).distinct()


@query("locale_allocation", "SELECT lang, CAST(row_id % 4 AS BIGINT) AS locale, count(*) AS n FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS row_id FROM documents) GROUP BY 1, 2")
def locale_allocation(spark, sf_dir):
    from pyspark.sql.window import Window

    w = Window.partitionBy("lang").orderBy("doc_id")
    return table(spark, sf_dir, "documents").select("lang", F.pmod(F.row_number().over(w) - 1, F.lit(4)).cast("long").alias("locale")).groupBy("lang", "locale").agg(F.count(F.lit(1)).alias("n"))


@query("masked_dump_view", r"SELECT conv_id, turn, regexp_replace(text, '[0-9]+', '*', 'g') AS text FROM conversations")
def masked_dump_view(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.mask_pattern(F.col("text"), "[0-9]+").alias("text"))

"""Queries over the dealt operators, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from lathe.llm import decontaminate, html, lines, mixing, secrets, simhash, substrings, topk, toxicity, urls
from lathe.llm.common import table

# The rules (verdict, host, path) of the op3 query.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("block", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1(spark, sf_dir):
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2(spark, sf_dir):
    return substrings.substring_report(table(spark, sf_dir, "documents"))


def op3(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op4(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where("vec_id % 100 = 0"))


def op5(spark, sf_dir):
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op6(spark, sf_dir):
    return html.page_text_report(table(spark, sf_dir, "pages"))


def op7(spark, sf_dir):
    return mixing.mixing_report(table(spark, sf_dir, "documents"))


def op8(spark, sf_dir):
    return lines.line_report(table(spark, sf_dir, "documents"))


def op9(spark, sf_dir):
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries():
    return {
        "op1_benchmark_decontamination": op1,
        "op2_substring_dedup": op2,
        "op3_url_filter": op3,
        "op4_exact_top_k": op4,
        "op5_secret_scan": op5,
        "op6_html_extraction": op6,
        "op7_mixing_to_targets": op7,
        "op8_fuzzy_line_dedup": op8,
        "op9_toxicity": op9,
        "op10_simhash_near_dedup": op10,
        "pipeline": corpus_pipeline.run,
    }


def _words(column: str) -> str:
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
b AS (SELECT item_id, {_words("text")} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT m FROM windows),
spots AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lengths WHERE len(w) >= m),
found AS (SELECT doc_id, item_id, i, spots.m AS m FROM spots JOIN windows ON windows.m = spots.m AND g = array_to_string(list_slice(w, i, i + spots.m - 1), ' ')),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_items, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

# Bytes are pairs of hex digits; a run goes on while the next repeated string starts within or right after the last one.
OP2_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 399)) AS i FROM d WHERE len(h) >= 800)),
r AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM r),
s AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM g),
runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS b FROM s GROUP BY doc_id, run),
seg AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS prev FROM runs),
kept AS (SELECT d.doc_id, string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS rest, sum(b - a) AS n_removed, count(*) AS n_spans
  FROM seg JOIN d ON seg.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

# The tables hold no redirect or canonical link, so here the rules alone decide.
OP3_SQL = f"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
p AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(verdict, h, q) AS (VALUES {", ".join(f"('{v}', '{h}', '{q}')" for v, h, q in RULES)}),
fits AS (SELECT page_id, h || q AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC) AS n
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN fits ON p.page_id = fits.page_id AND n = 1
"""

OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""


def _op5_sql() -> str:
    quoted = lambda p: p.replace("'", "''")
    found = " UNION ALL ".join(
        f"SELECT doc_id, source, lang, '{kind}' AS kind, {i} AS o, {least} AS least, regexp_split_to_array(t, '{quoted(p)}') AS parts, regexp_extract_all(t, '{quoted(p)}', 1) AS whole, regexp_extract_all(t, '{quoted(p)}', {g}) AS vals FROM d"
        for i, (kind, p, g, least) in enumerate([*secrets.BASE, secrets.OPAQUE])
    )
    return f"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
m AS ({found}),
k AS (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM m),
x AS (SELECT doc_id, source, lang, kind, o, least, whole[i] AS w, vals[i] AS v,
  CAST(list_sum(list_transform(list_slice(parts, 1, i), lambda p: length(p))) + coalesce(list_sum(list_transform(list_slice(whole, 1, i - 1), lambda p: length(p))), 0) AS BIGINT) AS s FROM k),
y AS (SELECT *, s + length(w) AS e FROM x WHERE length(v) >= least),
base AS (SELECT * FROM y WHERE kind <> 'opaque'),
a AS (SELECT * FROM base UNION ALL SELECT * FROM y WHERE kind = 'opaque' AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]')
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = y.doc_id AND b.s < y.e AND y.s < b.e)),
u AS (SELECT v, count(DISTINCT source) <= 1 AND count(DISTINCT source || '/' || lang) <= 3 AS live FROM a GROUP BY v),
f AS (SELECT a.doc_id, s, o, live, CASE WHEN kind = 'opaque' THEN 'owned' ELSE kind END AS kk, CASE WHEN kind = 'opaque' THEN 'owned' ELSE kind END || ':' || s || ':' || e AS span FROM a JOIN u ON a.v = u.v WHERE live OR kind <> 'opaque')
SELECT d.doc_id, count(*) FILTER (kk = 'assign') AS n_assign, count(*) FILTER (kk = 'access') AS n_access, count(*) FILTER (kk = 'hex') AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY s, o) FILTER (kk <> 'owned'), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY s, o), '') AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example
FROM d LEFT JOIN f ON d.doc_id = f.doc_id GROUP BY d.doc_id"""


# The fixed values of the mixing query: fraction 0.5, power 0.7, 10 cycles, seed 17.
def _op7_sql() -> str:
    topic = " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{t}'" for t, p in mixing.TOPICS)
    words = r"CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT)"
    parts = [
        f"d AS MATERIALIZED (SELECT doc_id, source, lang, CASE {topic} ELSE 'prose' END AS topic, {words} AS n_tokens FROM documents)",
        "c0 AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS t, CAST(sum(n_tokens) AS DOUBLE) AS w FROM d GROUP BY ALL HAVING sum(n_tokens) > 0)",
    ]
    for x in ("source", "lang", "topic"):
        parts.append(f"m_{x} AS MATERIALIZED (SELECT {x}, pow(sum(t), 0.7) / sum(pow(sum(t), 0.7)) OVER () AS target FROM c0 GROUP BY {x})")
    n = 0
    for _ in range(10):
        for x in ("source", "lang", "topic"):
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, t, w * target / sum(w) OVER (PARTITION BY c.{x}) AS w FROM c{n} c JOIN m_{x} m ON c.{x} IS NOT DISTINCT FROM m.{x})")
            n += 1
    parts.append(f"f AS MATERIALIZED (SELECT source, lang, topic, w * (SELECT sum(t) FROM c0) / t AS weight FROM c{n})")
    off = " UNION ALL ".join(f"SELECT max(abs(s / target - 1)) AS off FROM (SELECT {x}, sum(w) AS s FROM c{n} GROUP BY {x}) c JOIN m_{x} m ON c.{x} IS NOT DISTINCT FROM m.{x}" for x in ("source", "lang", "topic"))
    parts.append(f"r AS (SELECT max(off) AS residual FROM ({off}))")
    parts.append("j AS (SELECT d.*, coalesce(weight, 1.0) AS weight, 0.5 * coalesce(weight, 1.0) AS p, CASE WHEN weight IS NOT NULL THEN residual END AS residual FROM d LEFT JOIN f ON d.source IS NOT DISTINCT FROM f.source AND d.lang IS NOT DISTINCT FROM f.lang AND d.topic = f.topic CROSS JOIN r)")
    draw = "CAST(CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0"
    return f"""WITH {', '.join(parts)}, k AS (SELECT *, CAST(floor(p) AS INTEGER) + CASE WHEN {draw} < p - floor(p) THEN 1 ELSE 0 END AS copies FROM j)
SELECT doc_id, source, lang, topic, n_tokens, round(weight, 6) AS weight, round(p, 6) AS expected, copies, copies > 0 AS sampled, round(residual, 6) AS residual FROM k"""


def oracle_sql():
    return {"op5_secret_scan": _op5_sql(), "op7_mixing_to_targets": _op7_sql(), "op1_benchmark_decontamination": OP1_SQL, "op2_substring_dedup": OP2_SQL, "op3_url_filter": OP3_SQL, "op4_exact_top_k": OP4_SQL}

"""Queries over scored samples and token sequences: groups, advantages, losses, corrections, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathe.functions import answers, masked
from lathe.operators import advantages, correction, groups, losses, metrics, rows
from lathe.plans.adapters import SAMPLES, TOKENS, samples, table, trajectories
from lathe.plans import registry

G = f"WITH {SAMPLES}, g AS (SELECT *, count(*) OVER w AS n, avg(score) OVER w AS mu, stddev_samp(score) OVER w AS sd, var_samp(score) OVER w AS va FROM samples WINDOW w AS (PARTITION BY uid))"


OFF = 1.2345e-8


def off_grid(sql: str) -> str:
    """The SQL with ``OFF`` added inside every ``round(x, n)``, as ``rounded`` does."""
    out, at = "", 0
    while (i := sql.find("round(", at)) >= 0:
        depth, j, comma = 1, i + 6, None
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            comma = j if sql[j] == "," and depth == 1 else comma
            j += 1
        out += f"{sql[at:i]}round({off_grid(sql[i + 6 : comma])} + {OFF}, {sql[comma + 1 : j - 1].strip()})"
        at = j
    return out + sql[at:]


def query(name: str, sql: str):
    return registry.query(name, off_grid(sql))


def rounded(df, *columns, digits=6):
    """Rounded a little off the decimal grid, where sums in another order can't tip a tie; 0 comes as 0, not -0."""
    return df.withColumns({c: F.round(F.col(c) + OFF, digits) + F.lit(0.0) for c in columns})


def outcome(name: str, formula: str, **options):
    @query(f"advantage_{name}" + ("" if options.get("norm_by_std", True) else "_unnormalised"), f"{G} SELECT uid, sample_index, round({formula}, 6) + 0.0 AS advantage FROM g" + (" WHERE n > 1" if name == "grpo_passk" else ""))
    def run(spark, sf_dir):
        s = samples(spark, sf_dir)
        if name == "grpo_passk":
            s = s.join(s.groupBy("uid").count().where("count > 1").select("uid"), "uid", "left_semi")
        return rounded(advantages.estimate(s, name, **options).select("uid", "sample_index", "advantage"), "advantage")

    return run


outcome("grpo", "CASE WHEN n = 1 THEN score / (1 + 1e-6) ELSE (score - mu) / (sd + 1e-6) END")
outcome("grpo", "CASE WHEN n = 1 THEN score ELSE score - mu END", norm_by_std=False)
outcome("grpo_vectorized", "CASE WHEN n = 1 THEN score / (1 + 1e-6) ELSE (score - mu) / (sqrt(greatest(va, 1e-6)) + 1e-6) END")
outcome("rloo", "CASE WHEN n = 1 THEN score ELSE (score - mu) * n / (n - 1) END")
outcome("rloo_vectorized", "CASE WHEN n = 1 THEN 0.0 ELSE (score - mu) * n / (n - 1) END")
outcome("opo", "score - CASE WHEN n = 1 THEN 0.0 ELSE sum(n_tokens * score) OVER (PARTITION BY uid) / sum(n_tokens) OVER (PARTITION BY uid) END")
outcome("gpg", "(SELECT count(*) FROM samples) / (SELECT greatest(count(*) FILTER (score <> 0), 1) FROM samples) * CASE WHEN n = 1 THEN score ELSE score - mu END")
outcome("grpo_passk", "CASE WHEN row_number() OVER (PARTITION BY uid ORDER BY score DESC, sample_index) = 1 THEN (score - lead(score) OVER (PARTITION BY uid ORDER BY score DESC, sample_index)) / (sd + 1e-6) ELSE 0.0 END")

WHITEN = """m AS (SELECT *, sum(n_tokens) OVER () AS tn, sum(a * n_tokens) OVER () / (sum(n_tokens) OVER () + 1e-8) AS tm FROM a),
v AS (SELECT *, sum((a - tm) * (a - tm) * n_tokens) OVER () / (tn + 1e-8) * tn / (tn - 1) AS tv FROM m)
SELECT uid, sample_index, round((a - tm) / sqrt(tv + 1e-8), 6) + 0.0 AS advantage FROM v"""


@query("advantage_reinforce_plus_plus_baseline", f"{G}, a AS (SELECT *, CASE WHEN n = 1 THEN score ELSE score - mu END AS a FROM g), {WHITEN}")
def reinforce_plus_plus_baseline(spark, sf_dir):
    return rounded(advantages.estimate(samples(spark, sf_dir), "reinforce_plus_plus_baseline").select("uid", "sample_index", "advantage"), "advantage")


@query(
    "advantage_gdpo",
    f"""{G}, h AS (SELECT *, avg(format_score) OVER (PARTITION BY uid) AS fm, stddev_samp(format_score) OVER (PARTITION BY uid) AS fs FROM g),
a AS (SELECT *, CASE WHEN n = 1 THEN score / (1 + 1e-6) ELSE (score - mu) / (sd + 1e-6) END + 0.5 * CASE WHEN n = 1 THEN format_score / (1 + 1e-6) ELSE (format_score - fm) / (fs + 1e-6) END AS a FROM h), {WHITEN}""",
)
def gdpo(spark, sf_dir):
    return rounded(advantages.estimate(samples(spark, sf_dir), "gdpo", keys=["score", "format_score"], weights=[1.0, 0.5]).select("uid", "sample_index", "advantage"), "advantage")


def exploded(df, column, name="v"):
    return df.select("sid", F.posexplode(column).alias("pos", name))


@query("reward_to_go", f"WITH {TOKENS} SELECT sid, pos, round(sum(rewards * mask) OVER (PARTITION BY sid ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS v FROM tok")
def reward_to_go(spark, sf_dir):
    return rounded(exploded(trajectories(spark, sf_dir), masked.reward_to_go(F.col("rewards"), F.col("mask"))), "v")


@query("advantage_remax", f"WITH {TOKENS} SELECT sid, pos, round((sum(rewards * mask) OVER (PARTITION BY sid ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - (sid % 7) / 4.0) * mask, 6) + 0.0 AS v FROM tok")
def remax(spark, sf_dir):
    t = trajectories(spark, sf_dir).withColumn("baseline", (F.col("sid") % 7) / 4.0)
    return rounded(exploded(advantages.estimate(t, "remax"), "advantages"), "v")


RETURNS = f"""WITH RECURSIVE {TOKENS}, last AS (SELECT sid, max(pos) AS top FROM tok GROUP BY sid),
r(sid, pos, v, carry) AS (SELECT tok.sid, pos, rewards, rewards * mask FROM tok JOIN last ON tok.sid = last.sid AND pos = top
  UNION ALL SELECT tok.sid, tok.pos, rewards + 0.9 * carry, (rewards + 0.9 * carry) * mask FROM r JOIN tok ON tok.sid = r.sid AND tok.pos = r.pos - 1)"""


@query("discounted_returns", f"{RETURNS} SELECT sid, pos, round(v, 6) AS v FROM r")
def discounted_returns(spark, sf_dir):
    return rounded(exploded(trajectories(spark, sf_dir), masked.discounted_returns(F.col("rewards"), F.col("mask"), 0.9)), "v")


TOKEN_WHITEN = """s AS (SELECT sum(v * mask) / (sum(mask) + 1e-8) AS tm, sum(mask) AS tn FROM x),
q AS (SELECT tm, sum((v - tm) * (v - tm) * mask) / (tn + 1e-8) * tn / (tn - 1) AS tv FROM x, s GROUP BY tm, tn)"""


@query("advantage_reinforce_plus_plus", f"{RETURNS}, x AS (SELECT r.sid, r.pos, v, mask FROM r JOIN tok ON r.sid = tok.sid AND r.pos = tok.pos), {TOKEN_WHITEN} SELECT sid, pos, round((v - tm) / sqrt(tv + 1e-8) * mask, 6) + 0.0 AS v FROM x, q")
def reinforce_plus_plus(spark, sf_dir):
    return rounded(exploded(advantages.estimate(trajectories(spark, sf_dir), "reinforce_plus_plus", gamma=0.9), "advantages"), "v")


GAE = f"""WITH RECURSIVE {TOKENS}, last AS (SELECT sid, max(pos) AS top FROM tok GROUP BY sid),
r(sid, pos, v, nv) AS (SELECT tok.sid, pos, (rewards - "values") * mask, "values" * mask FROM tok JOIN last ON tok.sid = last.sid AND pos = top
  UNION ALL SELECT tok.sid, tok.pos, CASE WHEN mask = 1 THEN rewards + 0.99 * nv - "values" + 0.99 * 0.95 * r.v ELSE r.v END, CASE WHEN mask = 1 THEN "values" ELSE nv END FROM r JOIN tok ON tok.sid = r.sid AND tok.pos = r.pos - 1)"""


@query("advantage_gae", f'{GAE}, x AS (SELECT r.sid, r.pos, v, mask, "values" AS b FROM r JOIN tok ON r.sid = tok.sid AND r.pos = tok.pos), {TOKEN_WHITEN} SELECT sid, pos, round(v + b, 6) + 0.0 AS ret, round((v - tm) / sqrt(tv + 1e-8), 6) + 0.0 AS v FROM x, q')
def gae(spark, sf_dir):
    t = advantages.estimate(trajectories(spark, sf_dir), "gae", gamma=0.99, lam=0.95)
    both = t.select("sid", F.posexplode(F.arrays_zip(F.col("returns").alias("ret"), F.col("advantages").alias("v"))).alias("pos", "x")).select("sid", "pos", "x.ret", "x.v")
    return rounded(both, "ret", "v")


def otb_sql(source: str) -> str:
    return f"""WITH {TOKENS}, full_ AS (SELECT uid, sid, pos, mask, old_lp, spi, sum(rewards * mask) OVER (PARTITION BY sid ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS g FROM tok),
t AS ({source}),
e AS (SELECT *, sum((1 - 2 * exp(old_lp) + spi) * mask) OVER (PARTITION BY sid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS w, sum(mask) OVER (PARTITION BY sid) AS n FROM t),
b AS (SELECT uid, pos, sum(g * w) / (sum(w) + 1e-8) AS b FROM e WHERE mask = 1 GROUP BY uid, pos),
l AS (SELECT DISTINCT uid, sid, n FROM e),
k AS (SELECT uid, count(*) AS k, max(n) AS top FROM l GROUP BY uid),
k2 AS (SELECT l.uid, any_value(k) AS k, any_value(top) AS top, count(*) FILTER (n = top) AS tops, max(CASE WHEN n < top THEN n END) AS nxt FROM l JOIN k ON l.uid = k.uid GROUP BY l.uid)
SELECT e.sid, e.pos, CASE WHEN mask = 1 THEN round(g - CASE WHEN k = 1 OR (tops = 1 AND n = top AND e.pos >= nxt) THEN 0.0 ELSE coalesce(b, 0.0) END, 5) + 0.0 ELSE 0.0 END AS advantage
FROM e JOIN k2 ON e.uid = k2.uid LEFT JOIN b ON e.uid = b.uid AND e.pos = b.pos"""


@query("advantage_optimal_token_baseline", otb_sql("SELECT * FROM full_"))
def optimal_token_baseline(spark, sf_dir):
    return rounded(advantages.estimate(trajectories(spark, sf_dir), "optimal_token_baseline").select("sid", "pos", "advantage"), "advantage", digits=5)


@query("advantage_tir_optimal_token_baseline", otb_sql("SELECT uid, sid, CAST(row_number() OVER (PARTITION BY sid ORDER BY pos) - 1 AS INTEGER) AS pos, mask, old_lp, spi, g FROM full_ WHERE mask = 1"))
def tir_optimal_token_baseline(spark, sf_dir):
    return rounded(advantages.estimate(trajectories(spark, sf_dir), "tir_optimal_token_baseline").select("sid", "pos", "advantage"), "advantage", digits=5)


# --- losses ---------------------------------------------------------------------------------------------------------


def agg_sql(mode: str, loss: str = "l") -> str:
    seq = f"SELECT sid, sum({loss}) AS s, count(*) AS n FROM t GROUP BY sid"
    return {
        "token-mean": f"(SELECT sum({loss}) / count(*) FROM t)",
        "seq-mean-token-sum": f"(SELECT avg(s) FROM ({seq}))",
        "seq-mean-token-sum-norm": f"(SELECT avg(s) / 128.0 FROM ({seq}))",
        "seq-mean-token-mean": f"(SELECT avg(s / (n + 1e-8)) FROM ({seq}))",
    }[mode]


RATIO = "exp(least(greatest(new_lp - old_lp, -20), 20))"
PPO1, PPO2 = f"-adv * {RATIO}", f"-adv * least(greatest({RATIO}, 0.8), 1.2)"
P, Q = "exp(new_lp)", "exp(old_lp)"
TV = f"CASE WHEN adv > 0 THEN {P} - {Q} <= 0.2 ELSE {P} - {Q} >= -0.2 END"
BKL = f"({Q} * (old_lp - new_lp) + (1 - {Q}) * ln((1.0 - {Q} + 1e-8) / (1.0 - {P} + 1e-8)))"
KLV = f"CASE WHEN adv > 0 THEN {BKL} <= 0.2 OR {P} <= {Q} ELSE {BKL} <= 0.2 OR {P} >= {Q} END"
TAU = "CASE WHEN adv > 0 THEN 1.0 ELSE 1.05 END"
SEQ = "exp(least(avg(new_lp - old_lp) OVER (PARTITION BY sid), 10.0))"
LOSS_SQL = {
    "vanilla": (f"CASE WHEN adv < 0 THEN least(-adv * 3.0, greatest({PPO1}, {PPO2})) ELSE greatest({PPO1}, {PPO2}) END", f"{PPO2} > {PPO1}"),
    "dppo_tv": (f"CASE WHEN {TV} THEN -adv * least({RATIO}, 20.0) * new_lp ELSE 0.0 END", f"NOT ({TV})"),
    "dppo_kl": (f"CASE WHEN {KLV} THEN -adv * least({RATIO}, 20.0) * new_lp ELSE 0.0 END", f"NOT ({KLV})"),
    "gspo": (f"greatest(-adv * {SEQ}, -adv * least(greatest({SEQ}, 0.8), 1.2))", f"-adv * least(greatest({SEQ}, 0.8), 1.2) > -adv * {SEQ}"),
    "sapo": (f"-adv * 4.0 / ({TAU}) / (1 + exp(-({TAU}) * ({RATIO} - 1)))", "FALSE"),
    "gpg": ("-new_lp * adv", "FALSE"),
    "cispo": (f"-least(greatest({RATIO}, 0.8), 1.2) * adv * new_lp", f"{RATIO} <> least(greatest({RATIO}, 0.8), 1.2)"),
    "reinforce": ("-new_lp * adv", "FALSE"),
}


def loss_query(name: str, mode: str, suffix: str = ""):
    loss, clipped = LOSS_SQL[name]
    sql = f"WITH {TOKENS}, t AS (SELECT sid, {loss} AS l, CASE WHEN {clipped} THEN 1.0 ELSE 0.0 END AS h, old_lp - new_lp AS k FROM tok WHERE mask = 1) SELECT round({agg_sql(losses.FIXED_MODE.get(name, mode))}, 6) + 0.0 AS loss, round((SELECT sum(h) / (count(*) + 1e-8) FROM t), 6) AS clipfrac, round((SELECT sum(k) / (count(*) + 1e-8) FROM t), 6) + 0.0 AS kl"

    @query(f"loss_{name}{suffix}", sql)
    def run(spark, sf_dir):
        out = losses.policy_loss(trajectories(spark, sf_dir), name, mode, horizon=128)
        return rounded(out.select("loss", "clipfrac", "kl"), "loss", "clipfrac", "kl")


for _name in LOSS_SQL:
    loss_query(_name, "token-mean")
for _mode in losses.MODES[1:]:
    loss_query("vanilla", _mode, "_" + _mode.replace("-", "_"))


@query(
    "loss_geo_mean",
    f"""WITH {TOKENS}, t AS (SELECT sid, count(*) AS n, sum(adv) AS a, sum(sign(adv) * least(sign(adv) * (new_lp - old_lp), sign(adv) * least(greatest(new_lp - old_lp, -0.2), 0.2))) AS d FROM tok WHERE mask = 1 GROUP BY sid)
SELECT round(sum(-a / (n + 1e-8) * exp(d / (n + 1e-8))) / (SELECT count(DISTINCT sid) FROM tok), 6) AS loss FROM t""",
)
def geo_mean(spark, sf_dir):
    return rounded(losses.geo_mean_loss(trajectories(spark, sf_dir)), "loss")


COV = f"WITH {TOKENS}, c AS (SELECT sid, pos, new_lp, old_lp, adv, (adv - sum(adv) OVER () / (count(*) OVER () + 1e-8)) * (new_lp - sum(new_lp) OVER () / (count(*) OVER () + 1e-8)) AS cov FROM tok WHERE mask = 1)"


@query("loss_kl_cov", f"{COV}, t AS (SELECT *, row_number() OVER (ORDER BY cov DESC, sid, pos) <= greatest(1, CAST(floor((SELECT count(*) FROM c) * 0.01) AS INTEGER)) AS top FROM c) SELECT round(avg(-adv * exp(new_lp - old_lp) + CASE WHEN top THEN abs(new_lp - old_lp) ELSE 0.0 END), 6) AS loss, round(sum(abs(new_lp - old_lp)) / (count(*) + 1e-8), 6) AS kl FROM t")
def kl_cov(spark, sf_dir):
    return rounded(losses.kl_cov_loss(trajectories(spark, sf_dir), ratio=0.01), "loss", "kl")


@query(
    "loss_clip_cov",
    f"""{COV}, o AS (SELECT sid, pos FROM c WHERE cov < 5.0 AND cov > 0.05 AND NOT (-adv * least(greatest(exp(new_lp - old_lp), 0.8), 1.2) > -adv * exp(new_lp - old_lp))
  ORDER BY sha256('0:' || CAST(sid AS VARCHAR) || ':' || CAST(pos AS VARCHAR)), sid, pos LIMIT (SELECT greatest(1, CAST(floor(count(*) * 0.01) AS INTEGER)) FROM c))
SELECT round(avg(CASE WHEN o.sid IS NOT NULL THEN 0.0 ELSE greatest(-adv * exp(new_lp - old_lp), -adv * least(greatest(exp(new_lp - old_lp), 0.8), 1.2)) END), 6) AS loss, round(count(o.sid) / (count(*) + 1e-8), 6) AS clipfrac FROM c LEFT JOIN o ON c.sid = o.sid AND c.pos = o.pos""",
)
def clip_cov(spark, sf_dir):
    return rounded(losses.clip_cov_loss(trajectories(spark, sf_dir), ratio=0.01, low_cov=0.05), "loss", "clipfrac")


@query(
    "loss_value_clipped",
    f"""WITH {TOKENS}, t AS (SELECT power(vpreds - "returns", 2) AS a, power(least(greatest(vpreds, "values" - 0.5), "values" + 0.5) - "returns", 2) AS b FROM tok WHERE mask = 1)
SELECT round(0.5 * avg(greatest(a, b)), 6) AS loss, round(avg(CASE WHEN b > a THEN 1.0 ELSE 0.0 END), 6) AS clipfrac FROM t""",
)
def value_clipped(spark, sf_dir):
    return rounded(losses.value_loss(trajectories(spark, sf_dir)), "loss", "clipfrac")


KL_SQL = {"k1": "new_lp - ref_lp", "abs": "abs(new_lp - ref_lp)", "k2": "0.5 * power(new_lp - ref_lp, 2)", "k3": "least(greatest(exp(ref_lp - new_lp) - (ref_lp - new_lp) - 1, -10), 10)"}


def kl_query(kind: str):
    @query(f"distill_loss_{kind}", f"WITH {TOKENS}, t AS (SELECT {KL_SQL[kind]} AS v FROM tok WHERE mask = 1) SELECT round(avg(v), 6) + 0.0 AS loss, round(min(v), 6) + 0.0 AS loss_min, round(max(v), 6) + 0.0 AS loss_max FROM t")
    def run(spark, sf_dir):
        return rounded(losses.distill_estimator_loss(trajectories(spark, sf_dir), kind), "loss", "loss_min", "loss_max")


for _kind in KL_SQL:
    kl_query(_kind)


@query("kl_shaped_rewards", f"WITH {TOKENS} SELECT sid, round(sum(mask * (rewards - 0.1 * (old_lp - ref_lp))), 5) AS reward, round(sum(mask * (old_lp - ref_lp)) / (sum(mask) + 1e-8), 6) + 0.0 AS kl FROM tok GROUP BY sid")
def kl_shaped_rewards(spark, sf_dir):
    t = trajectories(spark, sf_dir)
    kl = masked.zero_outside(F.zip_with("old_lp", "ref_lp", lambda a, b: masked.kl_penalty(a, b, "kl")), F.col("mask"))
    shaped = F.zip_with("rewards", kl, lambda r, k: r - 0.1 * k)
    return rounded(rounded(t.select("sid", masked.masked_sum(shaped, F.col("mask")).alias("reward"), masked.masked_mean(kl, F.col("mask")).alias("kl")), "kl"), "reward", digits=5)


# --- corrections ----------------------------------------------------------------------------------------------------

D = "least(greatest(old_lp - roll_lp, -20), 20)"
SEQ_D = "least(greatest(sum((old_lp - roll_lp) * mask) OVER (PARTITION BY sid), -20), 20)"
METRICS_SQL = """c AS (SELECT sid, mask, least(greatest(w, 0), 2.0) AS w, w AS raw FROM t),
s AS (SELECT sum(raw * mask) / (sum(mask) + 1e-8) AS m FROM c GROUP BY sid),
a AS (SELECT sum(w * mask) / (sum(mask) + 1e-8) AS mean, sum(w * w * mask) / (sum(mask) + 1e-8) AS sq, min(CASE WHEN mask = 1 THEN w END) AS lo, max(CASE WHEN mask = 1 THEN w END) AS hi FROM c)
SELECT round(mean, 6) AS is_mean, round(sqrt(greatest(sq - mean * mean, 0)), 5) AS is_std, round(lo, 6) AS is_min, round(hi, 6) AS is_max, round((mean + 1e-8) * (mean + 1e-8) / sq, 6) AS ess,
  round((SELECT avg(m) FROM s), 6) AS seq_mean, round((SELECT stddev_samp(m) FROM s), 6) AS seq_std, round((SELECT max(abs(m - 1)) FROM s), 6) AS seq_max_deviation FROM a"""
WEIGHTS = {
    "token_truncated": ("token", 1.2, f"least(exp({D}) * mask, 1.2)"),
    "token_band": ("token", "0.8_1.2", f"CASE WHEN exp({D}) * mask BETWEEN 0.8 AND 1.2 THEN exp({D}) * mask ELSE 0.0 END"),
    "sequence_truncated": ("sequence", 2.0, f"least(exp({SEQ_D}) * mask, 2.0)"),
}


def weight_query(name: str):
    level, threshold, sql = WEIGHTS[name]

    @query(f"is_weights_{name}", f"WITH {TOKENS}, t AS (SELECT sid, mask, {sql} AS w FROM tok), {METRICS_SQL}")
    def run(spark, sf_dir):
        out = correction.weight_metrics(correction.importance_weights(trajectories(spark, sf_dir), level, threshold))
        return rounded(rounded(out, *(c for c in out.columns if c != "is_std")), "is_std", digits=5)


for _name in WEIGHTS:
    weight_query(_name)


@query("is_weights_normalised", f"WITH {TOKENS}, t AS (SELECT sid, pos, least(exp({D}) * mask, 2.0) AS w, mask FROM tok), m AS (SELECT sum(w * mask) / (sum(mask) + 1e-8) AS m FROM t) SELECT sid, pos, round(w / m, 6) AS v FROM t, m")
def normalised_weights(spark, sf_dir):
    return rounded(exploded(correction.importance_weights(trajectories(spark, sf_dir), "token", 2.0, normalise=True), "is_w"), "v")


K = {"k1": f"-({D})", "k2": f"0.5 * power({D}, 2)", "k3": f"exp({D}) - 1.0 - ({D})"}
REJECT = {"token_k1": "0.8_1.25", "token_k2": "0.02", "token_k3": "0.02", "seq_sum_k1": "0.5_2.0", "seq_sum_k2": "1.5", "seq_sum_k3": "1.5", "seq_mean_k1": "0.97_1.03", "seq_mean_k2": "0.03", "seq_mean_k3": "0.03", "seq_max_k2": "0.19", "seq_max_k3": "0.22"}


def reject_query(name: str):
    stat = K[name[-2:]]
    over = {"token": stat, "seq_sum": f"sum(({stat}) * mask) OVER (PARTITION BY sid)", "seq_mean": f"sum(({stat}) * mask) OVER (PARTITION BY sid) / (sum(mask) OVER (PARTITION BY sid) + 1e-8)", "seq_max": f"max(CASE WHEN mask = 1 THEN {stat} END) OVER (PARTITION BY sid)"}[name.rpartition("_")[0]]
    low, _, high = REJECT[name].rpartition("_")
    fine = f"x BETWEEN ln({low}) AND ln({high})" if name.endswith("k1") else f"x <= {high}"
    sql = f"""WITH {TOKENS}, t AS (SELECT sid, mask, {over} AS x FROM tok), s AS (SELECT sid, sum(mask) AS b, sum(CASE WHEN {fine} THEN mask ELSE 0 END) AS a FROM t GROUP BY sid)
SELECT round((sum(b) - sum(a)) / sum(b), 6) AS token_fraction, round(avg(CASE WHEN b > 0 THEN CASE WHEN a < b THEN 1.0 ELSE 0.0 END END), 6) AS seq_fraction FROM s"""

    @query(f"rejection_{name}", sql)
    def run(spark, sf_dir):
        return rounded(correction.rejection_summary(correction.rejection_mask(trajectories(spark, sf_dir), name, REJECT[name])), "token_fraction", "seq_fraction")


for _name in REJECT:
    reject_query(_name)


@query(
    "off_policy_metrics",
    f"""WITH {TOKENS}, s AS (SELECT sid, sum(mask) AS n, sum(old_lp * mask) / (sum(mask) + 1e-8) AS t, sum(roll_lp * mask) / (sum(mask) + 1e-8) AS r, sum((old_lp - roll_lp) * mask) AS d,
  sum((exp(old_lp - roll_lp) - (old_lp - roll_lp) - 1) * mask) AS k3, sum(exp(2 * ({D})) * mask) AS c FROM tok GROUP BY sid)
SELECT round(avg(exp(-t)), 6) AS training_ppl, round(avg(-t), 6) AS training_log_ppl, round(avg(exp(-r)), 6) AS rollout_ppl, round(avg(-r), 6) AS rollout_log_ppl, round(-sum(d) / (sum(n) + 1e-8), 6) + 0.0 AS kl, round(sum(k3) / (sum(n) + 1e-8), 6) AS k3_kl,
  round(avg(r - t), 6) + 0.0 AS log_ppl_diff, round(avg(abs(r - t)), 6) AS log_ppl_abs_diff, round(max(r - t), 6) + 0.0 AS log_ppl_diff_max, round(min(r - t), 6) + 0.0 AS log_ppl_diff_min, round(avg(exp(r - t)), 6) AS ppl_ratio, round(sum(c) / (sum(n) + 1e-8) - 1, 6) AS chi2_token,
  round(avg(exp(2 * least(greatest(d, -20), 20))) - 1, 2) AS chi2_seq FROM s""",
)
def off_policy(spark, sf_dir):
    out = correction.off_policy_metrics(trajectories(spark, sf_dir))
    return rounded(rounded(out, *(c for c in out.columns if c != "chi2_seq")), "chi2_seq", digits=2)


# --- metrics --------------------------------------------------------------------------------------------------------

EV = "SELECT CAST(event_id // 100 AS BIGINT) AS step, event_type || CASE user_id % 4 WHEN 0 THEN '/max' WHEN 1 THEN '/min' WHEN 2 THEN '/sum' ELSE '/mean' END AS name, value FROM events"


def metric_rows(spark, sf_dir):
    kind = F.element_at(F.array(*(F.lit(x) for x in ("/max", "/min", "/sum", "/mean"))), (F.col("user_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 100).alias("step"), F.concat("event_type", kind).alias("name"), "value")


@query("reduce_metrics_by_name", f"WITH m AS ({EV}) SELECT name, round(CASE WHEN contains(name, 'max') THEN max(value) WHEN contains(name, 'min') THEN min(value) ELSE avg(value) END, 6) AS value FROM m GROUP BY name")
def reduce_metrics(spark, sf_dir):
    return rounded(metrics.reduce_by_name(metric_rows(spark, sf_dir)), "value")


@query("aggregate_step_metrics", f"WITH m AS ({EV}) SELECT name, CASE WHEN contains(name, 'mean') THEN 'avg' WHEN contains(name, 'max') THEN 'max' WHEN contains(name, 'min') THEN 'min' WHEN contains(name, 'sum') THEN 'sum' ELSE 'avg' END AS rule, round(CASE WHEN contains(name, 'mean') THEN avg(value) WHEN contains(name, 'max') THEN max(value) WHEN contains(name, 'min') THEN min(value) WHEN contains(name, 'sum') THEN sum(value) ELSE avg(value) END, 4) AS value FROM m GROUP BY name")
def aggregate_steps(spark, sf_dir):
    return rounded(metrics.aggregate_steps(metric_rows(spark, sf_dir)), "value", digits=4)


@query("loggable_metrics", f"WITH m AS ({EV}) SELECT name, round(CASE WHEN ends_with(name, '/sum') THEN sum(value) WHEN ends_with(name, '/min') THEN min(value) WHEN ends_with(name, '/max') THEN max(value) ELSE avg(value) END, 4) AS value FROM m GROUP BY name")
def loggable(spark, sf_dir):
    return rounded(metrics.loggable(metric_rows(spark, sf_dir)), "value", digits=4)


@query("data_metrics", f"WITH {SAMPLES}, s AS (SELECT score, format_score AS reward, CASE WHEN n_tokens % 7 = 0 THEN 0 ELSE n_tokens END AS length FROM samples) SELECT round(avg(score) FILTER (length > 0), 6) AS score_mean, max(score) FILTER (length > 0) AS score_max, min(score) FILTER (length > 0) AS score_min, round(avg(reward) FILTER (length > 0), 6) AS reward_mean, max(reward) FILTER (length > 0) AS reward_max, min(reward) FILTER (length > 0) AS reward_min, round(avg(length), 6) AS length_mean, max(length) AS length_max, min(length) AS length_min, round(avg(CASE WHEN length = 50 THEN 1.0 ELSE 0.0 END), 6) AS clip_ratio, round(avg(CASE WHEN length = 0 THEN 1.0 ELSE 0.0 END), 6) AS aborted_ratio FROM s")
def data_metrics(spark, sf_dir):
    s = samples(spark, sf_dir).select("score", F.col("format_score").alias("reward"), F.when(F.col("n_tokens") % 7 == 0, 0).otherwise(F.col("n_tokens")).alias("length"))
    return rounded(metrics.data_metrics(s, 50), "score_mean", "reward_mean", "length_mean", "clip_ratio", "aborted_ratio")


@query("explained_variance", f'WITH {TOKENS} SELECT round(1 - var_samp("returns" - "values") / (var_samp("returns") + 1e-5), 6) AS explained_variance FROM tok')
def explained_variance(spark, sf_dir):
    t = trajectories(spark, sf_dir).select(F.explode(F.arrays_zip("returns", "values")).alias("x")).select("x.*")
    return rounded(metrics.explained_variance(t, "returns", "values"), "explained_variance")


VOTE = "votes AS (SELECT data_source, uid, pred, count(*) AS c, min(sample_index) AS f, arg_min(score, sample_index) AS v FROM samples GROUP BY ALL), maj AS (SELECT data_source, uid, arg_max(v, c * 1000 - f) AS maj FROM votes GROUP BY data_source, uid)"


@query("validation_metrics", f"WITH {SAMPLES}, {VOTE}, per AS (SELECT data_source, uid, count(*) AS n, avg(score) AS m, stddev_pop(score) AS s FROM samples GROUP BY data_source, uid) SELECT per.data_source, n, round(avg(m), 6) + 0.0 AS mean_at_n, round(avg(s), 6) AS std_at_n, round(avg(maj), 6) + 0.0 AS maj_at_n, count(*) AS prompts FROM per JOIN maj ON per.uid = maj.uid AND per.data_source = maj.data_source GROUP BY per.data_source, n")
def validation(spark, sf_dir):
    return rounded(metrics.validation_metrics(samples(spark, sf_dir)), "mean_at_n", "std_at_n", "maj_at_n")


@query("majority_first_seen", f"WITH {SAMPLES}, {VOTE} SELECT data_source, uid, maj AS value FROM maj")
def majority_first_seen(spark, sf_dir):
    return groups.majority(samples(spark, sf_dir), ["data_source", "uid"], "pred", "score", ["sample_index"]).select("data_source", "uid", "value")


@query("majority_strict_plurality", f"WITH {SAMPLES}, v AS (SELECT uid, CASE WHEN pred = 2 THEN NULL ELSE pred END AS p, acc FROM samples), c AS (SELECT uid, p, count(*) AS n, max(acc) AS ok FROM v WHERE p IS NOT NULL GROUP BY uid, p), t AS (SELECT uid, max(n) AS n FROM c GROUP BY uid), w AS (SELECT c.uid, count(*) AS ties, max(ok) AS ok FROM c JOIN t ON c.uid = t.uid AND c.n = t.n GROUP BY c.uid) SELECT u.uid, CASE WHEN ties = 1 AND ok > 0 THEN 1.0 ELSE 0.0 END AS score FROM (SELECT DISTINCT uid FROM samples) u LEFT JOIN w ON u.uid = w.uid")
def majority_strict(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("pred", F.when(F.col("pred") != 2, F.col("pred")))
    return groups.strict_plurality(s, ["uid"], "pred", "acc")


@query("answer_entropy", f"WITH {SAMPLES}, c AS (SELECT uid, pred, count(*) AS n FROM samples GROUP BY uid, pred), t AS (SELECT *, sum(n) OVER (PARTITION BY uid) AS tot FROM c) SELECT uid, round(-sum(n / tot * ln(n / tot)), 6) + 0.0 AS entropy FROM t GROUP BY uid")
def answer_entropy(spark, sf_dir):
    return rounded(groups.entropy(samples(spark, sf_dir), ["uid"], "pred"), "entropy")


@query("pass_at_k", f"WITH {SAMPLES}, g AS (SELECT uid, count(*) AS n, sum(acc) AS c FROM samples GROUP BY uid) SELECT uid, round(CASE WHEN n - c < 2 THEN 1.0 WHEN c = 0 THEN 0.0 ELSE 1.0 - ((n - c) * (n - c - 1)) / (n * (n - 1)) END, 6) AS pass_at_2 FROM g")
def pass_at_k(spark, sf_dir):
    g = samples(spark, sf_dir).groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.sum("acc").alias("c"))
    return rounded(g.select("uid", groups.pass_at_k(F.col("n"), F.col("c"), 2).alias("pass_at_2")), "pass_at_2")


@query("mean_at_k_prefix", f"WITH {SAMPLES} SELECT uid, round(avg(acc), 6) AS mean_at_2 FROM samples WHERE sample_index < 2 GROUP BY uid")
def mean_at_k(spark, sf_dir):
    return rounded(samples(spark, sf_dir).where("sample_index < 2").groupBy("uid").agg(F.avg("acc").alias("mean_at_2")), "mean_at_2")


@query("best_at_k_expected", f"WITH {SAMPLES}, r AS (SELECT uid, score, row_number() OVER (PARTITION BY uid ORDER BY score) AS i, count(*) OVER (PARTITION BY uid) AS n FROM samples) SELECT uid, round(sum(score * (power(i / n, 3) - power((i - 1) / n, 3))), 6) + 0.0 AS best_at_3 FROM r GROUP BY uid")
def best_at_k(spark, sf_dir):
    g = samples(spark, sf_dir).groupBy("uid").agg(F.collect_list("score").alias("v"))
    return rounded(g.select("uid", groups.best_at_k_expected(F.col("v"), 3).alias("best_at_3")), "best_at_3")


@query("group_filter_informative", f"WITH {SAMPLES}, g AS (SELECT *, stddev_pop(acc) OVER (PARTITION BY uid) AS s, count(*) OVER (PARTITION BY uid) AS n FROM samples) SELECT uid, sample_index FROM g WHERE s > 0 OR n = 1")
def group_filter(spark, sf_dir):
    return groups.keep_informative(samples(spark, sf_dir), metric="acc").select("uid", "sample_index")


@query("group_statistics", f"{G} SELECT uid, sample_index, n AS g_n, round(CASE WHEN n = 1 THEN 0.0 ELSE mu END, 6) + 0.0 AS g_mean, round(CASE WHEN n = 1 THEN 1.0 ELSE sqrt(greatest(va, 1e-6)) END, 6) AS g_std FROM g")
def group_statistics(spark, sf_dir):
    return rounded(groups.group_stats(samples(spark, sf_dir), floor=1e-6).select("uid", "sample_index", "g_n", "g_mean", "g_std"), "g_mean", "g_std")


@query("group_numbering", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS \"group\" FROM part")
def group_numbering(spark, sf_dir):
    return groups.group_number(table(spark, sf_dir, "part"), "p_brand").select("p_partkey", "group")


@query("difficulty_buckets", f"WITH {SAMPLES}, g AS (SELECT uid, avg(score) AS m FROM samples GROUP BY uid), e AS (SELECT quantile_cont(m, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM g) SELECT CAST(CASE WHEN m <= e[2] THEN 0 WHEN m <= e[3] THEN 1 WHEN m <= e[4] THEN 2 WHEN m <= e[5] THEN 3 ELSE 4 END AS INTEGER) AS bucket, count(*) AS n, round(avg(m), 5) + 0.0 AS mean FROM g, e GROUP BY 1")
def difficulty_buckets(spark, sf_dir):
    g = samples(spark, sf_dir).groupBy("uid").agg(F.avg("score").alias("m"))
    return rounded(metrics.quantile_buckets(g, "m", 5).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("m").alias("mean")), "mean", digits=5)


@query("quantile_summary", "SELECT event_type, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.01), 6) AS p01, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def quantile_summary(spark, sf_dir):
    return rounded(metrics.quantile_summary(table(spark, sf_dir, "events"), "value", ["event_type"]), "mean", "p01", "p05", "p50", "p95", "p99")


@query("histogram_quantile", "WITH h AS (SELECT CAST(floor(value) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1), c AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS c, (SELECT sum(n) FROM h) AS t FROM h) SELECT round(min(bin) * 0.5, 6) AS value FROM c WHERE c > floor(0.9 * (t - 1))")
def histogram_quantile(spark, sf_dir):
    hist = table(spark, sf_dir, "events").groupBy(F.floor("value").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return metrics.histogram_quantile(hist, 0.9, 0.5)


@query("tail_ratio", "WITH c AS (SELECT quantile_cont(value, 0.95) AS cut FROM events) SELECT round(avg(CASE WHEN value > cut THEN 1.0 ELSE 0.0 END), 6) AS tail_ratio, min(value) AS min, max(value) AS max FROM events, c")
def tail_ratio(spark, sf_dir):
    return rounded(metrics.tail_ratio(table(spark, sf_dir, "events"), "value", 5.0), "tail_ratio")


@query("slowest_sample", "SELECT min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, (SELECT event_id FROM events ORDER BY value DESC, event_id DESC LIMIT 1) AS slowest_event_id FROM events")
def slowest_sample(spark, sf_dir):
    return rounded(metrics.slowest(table(spark, sf_dir, "events"), "value", ["event_id"]), "mean")


T_SERIES = "1.959963984540054 + 2.372271230298562 / v + 2.8224986157396112 / v ** 2 + 2.555849679507722 / v ** 3 + 1.5895340533938225 / v ** 4"


@query("mean_confidence_interval", f"WITH g AS (SELECT c_nationkey, count(c_acctbal) AS n, avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s, count(c_acctbal) - 1.0 AS v FROM customer GROUP BY 1) SELECT c_nationkey, n, round(m, 4) AS mean, round(CASE WHEN n >= 2 THEN CASE WHEN n <= 11 THEN [12.7062, 4.3027, 3.1824, 2.7764, 2.5706, 2.4469, 2.3646, 2.3060, 2.2622, 2.2281][n - 1] ELSE {T_SERIES} END * s / sqrt(n) ELSE 0.0 END, 2) AS ci FROM g")
def mean_confidence_interval(spark, sf_dir):
    return rounded(rounded(metrics.mean_ci(table(spark, sf_dir, "customer"), "c_nationkey", "c_acctbal"), "mean", digits=4), "ci", digits=2)


AT_K = "ks AS (SELECT unnest([2, 4, 8, 16, 32, 64]) AS k), long AS (SELECT data_source, uid, 'score' AS variable, score AS value FROM samples UNION ALL SELECT data_source, uid, 'format_score', format_score FROM samples), o AS (SELECT *, row_number() OVER (PARTITION BY data_source, uid, variable ORDER BY value) AS i, count(*) OVER (PARTITION BY data_source, uid, variable) AS n FROM long), g AS (SELECT o.*, ks.k FROM o JOIN ks ON ks.k < n UNION ALL SELECT o.*, n FROM o WHERE n > 1), p AS (SELECT *, power(i / n, k) - power((i - 1) / n, k) AS b, power((n - i + 1) / n, k) - power((n - i) / n, k) AS w FROM g), m AS (SELECT data_source, uid, variable, n, k, sum(value * b) AS b1, sum(value * value * b) AS b2, sum(value * w) AS w1, sum(value * value * w) AS w2 FROM p GROUP BY ALL)"


@query("validation_best_worst_at_k", f"WITH {SAMPLES}, {AT_K} SELECT data_source, variable, n, CAST(k AS INTEGER) AS k, round(avg(b1), 6) + 0.0 AS best_mean, round(avg(sqrt(greatest(b2 - b1 * b1, 0))), 5) AS best_std, round(avg(w1), 6) + 0.0 AS worst_mean, round(avg(sqrt(greatest(w2 - w1 * w1, 0))), 5) AS worst_std, count(*) AS prompts FROM m GROUP BY ALL")
def validation_at_k(spark, sf_dir):
    per = metrics.best_and_worst_at_k(samples(spark, sf_dir), ["data_source", "uid"], ["score", "format_score"])
    out = per.groupBy("data_source", "variable", "n", "k").agg(*(F.avg(c).alias(c) for c in ("best_mean", "best_std", "worst_mean", "worst_std")), F.count(F.lit(1)).alias("prompts"))
    return rounded(rounded(out, "best_mean", "worst_mean"), "best_std", "worst_std", digits=5)


@registry.query("validation_majority_at_k")  # brute force in the tests
def validation_majority_at_k(spark, sf_dir):
    per = metrics.majority_at_k(samples(spark, sf_dir), ["data_source", "uid"], "pred", "score")
    out = per.groupBy("data_source", "n", "k").agg(F.avg("maj_mean").alias("maj_mean"), F.avg("maj_std").alias("maj_std"), F.count(F.lit(1)).alias("prompts"))
    return rounded(out, "maj_mean", "maj_std")


@query("validation_metric_names", f"WITH {SAMPLES}, per AS (SELECT data_source, uid, count(*) AS n, avg(score) AS s, avg(format_score) AS f FROM samples GROUP BY ALL), l AS (SELECT data_source, n, 'score' AS variable, avg(s) AS value FROM per GROUP BY ALL UNION ALL SELECT data_source, n, 'format_score', avg(f) FROM per GROUP BY ALL), m AS (SELECT *, max(n) OVER (PARTITION BY data_source, variable) AS most FROM l) SELECT CASE WHEN variable = 'score' AND n = most THEN 'val-core' ELSE 'val-aux' END || '/' || data_source || '/' || variable || '/mean@' || n AS name, round(value, 6) + 0.0 AS value FROM m")
def validation_metric_names(spark, sf_dir):
    per = samples(spark, sf_dir).groupBy("data_source", "uid").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("score"), F.avg("format_score").alias("format_score"))
    long = F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), F.col(v).alias("value")) for v in ("score", "format_score")))).alias("x")
    rows_ = per.select("data_source", "n", long).groupBy("data_source", "n", F.col("x.variable").alias("variable")).agg(F.avg("x.value").alias("value")).withColumn("metric", F.concat(F.lit("mean@"), F.col("n").cast("string")))
    return rounded(metrics.metric_names(rows_, "score").select("name", "value"), "value")


@query("logprob_difference", f"WITH {TOKENS}, t AS (SELECT exp(old_lp) AS a, exp(roll_lp) AS b FROM tok WHERE mask = 1) SELECT round(max(abs(a - b)), 6) AS diff_max, round(avg(abs(a - b)), 6) AS diff_mean, round(stddev_samp(abs(a - b)), 6) AS diff_std, round(corr(a, b), 6) + 0.0 AS pearson FROM t")
def logprob_difference(spark, sf_dir):
    z = F.arrays_zip("old_lp", "roll_lp", "mask")
    t = trajectories(spark, sf_dir).select(F.explode(z).alias("x")).select("x.*").where("mask = 1")
    out = metrics.elementwise_audit(t, "old_lp", "roll_lp")
    return rounded(out, *out.columns)


@query("longest_zero_run", f"WITH {TOKENS}, z AS (SELECT sid, mask, pos - row_number() OVER (PARTITION BY sid, mask ORDER BY pos) AS grp FROM tok), r AS (SELECT sid, count(*) AS n FROM z WHERE mask = 0 GROUP BY sid, grp) SELECT t.sid, coalesce(max(n), 0) AS run FROM (SELECT DISTINCT sid FROM tok) t LEFT JOIN r ON t.sid = r.sid GROUP BY t.sid")
def longest_zero_run(spark, sf_dir):
    return trajectories(spark, sf_dir).select("sid", masked.longest_run(F.transform("mask", lambda m: m.cast("double"))).cast("long").alias("run"))


@query("consecutive_groups", 'SELECT user_id, event_id, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS run FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS s FROM events)')
def consecutive_groups(spark, sf_dir):
    return rows.runs(table(spark, sf_dir, "events"), ["ts", "event_id"], "event_type", by=["user_id"]).select("user_id", "event_id", "run")


@query("centred_rolling_mean", "SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS smooth FROM events")
def centred_rolling_mean(spark, sf_dir):
    return rounded(rows.rolling_mean(table(spark, sf_dir, "events"), ["ts", "event_id"], "value", 4, ["user_id"]).select("user_id", "event_id", "smooth"), "smooth")


@query("overlong_penalty", f"WITH {SAMPLES} SELECT uid, sample_index, round(score + least(-(n_tokens - 30) / 20.0 * 0.5, 0.0), 6) + 0.0 AS score FROM samples")
def overlong_penalty(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("score", F.col("score") + answers.overlong_penalty(F.col("n_tokens"), 50, 20, 0.5))
    return rounded(s.select("uid", "sample_index", "score"), "score")


@query("variance_proxies", f"WITH {TOKENS}, s AS (SELECT sid, sum(adv * mask) / (sum(mask) + 1e-8) AS a, sum((1 - 2 * exp(old_lp) + spi) * mask) AS w FROM tok GROUP BY sid) SELECT round(avg(a * a * greatest(w, 0)), 6) AS total_power, round(avg(a * a), 6) AS expected_a_squared, round(avg(w), 6) AS expected_w FROM s")
def variance_proxies(spark, sf_dir):
    m = F.col("mask")
    w = F.zip_with("old_lp", "spi", lambda lp, s: F.lit(1.0) - 2 * F.exp(lp) + s)
    s = trajectories(spark, sf_dir).select(masked.masked_mean(F.col("adv"), m).alias("a"), masked.masked_sum(w, m).alias("w"))
    out = s.agg(F.avg(F.col("a") * F.col("a") * F.greatest(F.col("w"), F.lit(0.0))).alias("total_power"), F.avg(F.col("a") * F.col("a")).alias("expected_a_squared"), F.avg("w").alias("expected_w"))
    return rounded(out, *out.columns)


@query("seed_outer_join", "SELECT coalesce(a.step, b.step) AS step, a.v AS seed_a, b.v AS seed_b FROM (SELECT event_id // 50 AS step, round(max(value), 6) AS v FROM events WHERE event_type = 'view' GROUP BY 1) a FULL JOIN (SELECT event_id // 50 AS step, round(max(value), 6) AS v FROM events WHERE event_type = 'click' GROUP BY 1) b ON a.step = b.step")
def seed_outer_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("step", F.floor(F.col("event_id") / 50))
    a = e.where("event_type = 'view'").groupBy("step").agg(F.round(F.max("value"), 6).alias("seed_a"))
    b = e.where("event_type = 'click'").groupBy("step").agg(F.round(F.max("value"), 6).alias("seed_b"))
    return a.join(b, "step", "full")


@query("as_of_step_lookup", "SELECT o.o_orderkey, max(event_id) AS last_event FROM orders o JOIN events e ON e.user_id = o.o_custkey AND e.event_id <= o.o_orderkey GROUP BY o.o_orderkey")
def as_of_step_lookup(spark, sf_dir):
    o, e = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "events").select("event_id", "user_id")
    both = o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("at"), F.lit(1).alias("ask"), F.lit(None).cast("long").alias("ev")).unionByName(e.select(F.col("user_id").alias("k"), F.col("event_id").alias("at"), F.lit(0).alias("ask"), F.col("event_id").alias("ev")))
    from pyspark.sql.window import Window

    w = Window.partitionBy("k").orderBy("at", "ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("last_event", F.last("ev", ignorenulls=True).over(w)).where("ask = 1 and last_event is not null").select(F.col("at").alias("o_orderkey"), "last_event")


@query("results_pivot_report", "WITH r AS (SELECT c_mktsegment AS model, n_regionkey AS ds, c_acctbal AS v FROM customer JOIN nation ON c_nationkey = n_nationkey), w AS (SELECT model, avg(v) FILTER (ds = 0) AS \"0\", avg(v) FILTER (ds = 1) AS \"1\", avg(v) FILTER (ds = 2) AS \"2\" FROM r GROUP BY model) SELECT model, round(\"0\", 4) AS d0, round(\"1\", 4) AS d1, round(\"2\", 4) AS d2, round((\"0\" + \"1\" + \"2\") / 3, 4) AS mean FROM w")
def results_pivot(spark, sf_dir):
    from lathe.sources.datasets import report

    r = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("model"), F.concat(F.lit("d"), F.col("n_regionkey").cast("string")).alias("ds"), "c_acctbal")
    out = report(r, "model", "ds", "c_acctbal", ["d0", "d1", "d2"])
    return rounded(out, "d0", "d1", "d2", "mean", digits=4)


@query("embedding_drift", "WITH v AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT vec_id, round(sum(CASE WHEN i <= 10 THEN abs(CAST(x AS DOUBLE)) ELSE 0 END), 4) AS head, round(max(CAST(x AS DOUBLE)), 5) AS top FROM v GROUP BY vec_id")
def embedding_drift(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    head = F.aggregate(F.transform(F.slice("embedding", 1, 10), lambda x: F.abs(x.cast("double"))), F.lit(0.0), lambda a, x: a + x)
    return rounded(rounded(e.select("vec_id", head.alias("head"), F.array_max("embedding").cast("double").alias("top")), "head", digits=4), "top", digits=5)

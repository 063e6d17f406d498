"""Queries: run analytics on tables derived from lineitem, orders, part and events.

A lineitem row stands for a training run: the budget is its line number,
parameters come from the extended price, and the validation bpb is a
parabola in log-parameters plus the discount/tax noise.  Events are step
metrics: run = user, step = order of (ts, event_id), loss = value.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs
from .fixtures import table
from .registry import query

RUNS_SQL = """rt AS (SELECT l_orderkey * 8 + l_linenumber AS run_id, l_linenumber AS budget,
    1e17 * pow(2, l_linenumber) AS flops_budget, l_extendedprice * 1000 AS params_transformer,
    l_partkey * 10 AS params_lm_head, l_quantity * 1e6 AS tokens_trained,
    CASE WHEN l_linenumber = 7 AND l_orderkey % 5 = 0 THEN NULL
         ELSE 0.8 + l_discount + l_tax + 0.1 * pow(log10(l_extendedprice * 1000) - 7.5, 2) END AS val_bpb
  FROM lineitem),
sp AS (SELECT *, (params_transformer + params_lm_head)::DOUBLE AS effective_params,
              tokens_trained / (params_transformer + params_lm_head) AS ratio
       FROM rt WHERE val_bpb IS NOT NULL AND val_bpb > 0)"""


def run_table(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    bpb = F.when((F.col("l_linenumber") == 7) & (F.col("l_orderkey") % 5 == 0), None).otherwise(
        0.8 + F.col("l_discount") + F.col("l_tax")
        + 0.1 * F.pow(F.log10(F.col("l_extendedprice") * 1000) - 7.5, 2))
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("run_id"),
                     F.col("l_linenumber").alias("budget"),
                     (F.lit(1e17) * F.pow(F.lit(2.0), F.col("l_linenumber"))).alias("flops_budget"),
                     (F.col("l_extendedprice") * 1000).alias("params_transformer"),
                     (F.col("l_partkey") * 10).alias("params_lm_head"),
                     (F.col("l_quantity") * 1e6).alias("tokens_trained"), bpb.alias("val_bpb"))


def scaled(spark, sf_dir):
    return runs.scaling_params(run_table(spark, sf_dir))


@query("scaling_params", oracle=f"""WITH {RUNS_SQL}
SELECT run_id, effective_params, round(ratio, 9) AS ratio FROM sp""")
def q_scaling_params(spark, sf_dir):
    return scaled(spark, sf_dir).select("run_id", "effective_params", F.round("ratio", 9).alias("ratio"))


@query("sort_runs", oracle=f"""WITH {RUNS_SQL}
SELECT run_id, row_number() OVER (ORDER BY effective_params, run_id) - 1 AS rank FROM sp""")
def q_sort_runs(spark, sf_dir):
    from ..functions.ranking import dense_index
    return dense_index(scaled(spark, sf_dir), ["effective_params", "run_id"], out="rank").select("run_id", "rank")


ISO_SQL = f"""{RUNS_SQL},
xs AS (SELECT budget, log10(effective_params) AS x, val_bpb AS y FROM sp),
mx AS (SELECT budget, avg(x) AS m FROM xs GROUP BY budget),
c AS (SELECT xs.budget, xs.x, xs.x - mx.m AS u, xs.y, mx.m FROM xs JOIN mx ON xs.budget = mx.budget),
s AS (SELECT budget, count(*)::DOUBLE AS s0, sum(u) AS s1, sum(u*u) AS s2, sum(u*u*u) AS s3, sum(u*u*u*u) AS s4,
             sum(y) AS t0, sum(u*y) AS t1, sum(u*u*y) AS t2, any_value(m) AS m,
             arg_min(x, y) AS xmin, min(y) AS ymin FROM c GROUP BY budget),
d AS (SELECT *, s4*(s2*s0 - s1*s1) - s3*(s3*s0 - s1*s2) + s2*(s3*s1 - s2*s2) AS dd FROM s),
f AS (SELECT *, (t2*(s2*s0 - s1*s1) - s3*(t1*s0 - s1*t0) + s2*(t1*s1 - s2*t0)) / dd AS a,
                (s4*(t1*s0 - s1*t0) - t2*(s3*s0 - s1*s2) + s2*(s3*t0 - t1*s2)) / dd AS b,
                (s4*(s2*t0 - t1*s1) - s3*(s3*t0 - t1*s2) + t2*(s3*s1 - s2*s2)) / dd AS c FROM d),
o AS (SELECT budget, CASE WHEN a > 0 AND s0 >= 3 THEN -b / (2*a) + m ELSE xmin END AS x_opt,
             CASE WHEN a > 0 AND s0 >= 3 THEN a*(b/(2*a))*(b/(2*a)) - b*b/(2*a) + c ELSE ymin END AS y_opt,
             CASE WHEN a > 0 AND s0 >= 3 THEN 'vertex' ELSE 'min' END AS method FROM f)"""


@query("isoflop_optimum", oracle=f"""WITH {ISO_SQL}
SELECT budget, round(x_opt, 4) AS x_opt, round(y_opt, 4) AS y_opt, method FROM o""")
def q_isoflop_optimum(spark, sf_dir):
    s = scaled(spark, sf_dir).withColumn("x", F.log10("effective_params"))
    o = runs.isoflop_optimum(s, ["budget"], "x", "val_bpb")
    return o.select("budget", F.round("x_opt", 4).alias("x_opt"), F.round("y_opt", 4).alias("y_opt"), "method")


@query("isoflop_carry", oracle=f"""WITH {ISO_SQL},
kn AS (SELECT budget, log10(effective_params) AS x, avg(tokens_trained) AS t, avg(ratio) AS r FROM sp GROUP BY ALL),
sg AS (SELECT *, lead(x) OVER w AS x1, lead(t) OVER w AS t1, lead(r) OVER w AS r1,
              lag(x) OVER w IS NULL AS head FROM kn WINDOW w AS (PARTITION BY budget ORDER BY x))
SELECT o.budget, round(CASE WHEN o.x_opt < g.x OR g.x1 IS NULL THEN g.t ELSE g.t + (g.t1 - g.t) * (o.x_opt - g.x) / (g.x1 - g.x) END / 1e6, 2) AS tokens_opt,
       round(CASE WHEN o.x_opt < g.x OR g.x1 IS NULL THEN g.r ELSE g.r + (g.r1 - g.r) * (o.x_opt - g.x) / (g.x1 - g.x) END, 3) AS ratio_opt
FROM o JOIN sg g ON g.budget = o.budget AND ((g.x <= o.x_opt AND (g.x1 IS NULL OR o.x_opt < g.x1)) OR (g.head AND o.x_opt < g.x))""")
def q_isoflop_carry(spark, sf_dir):
    """Tokens and token ratio at each budget's optimum."""
    s = scaled(spark, sf_dir).withColumn("x", F.log10("effective_params"))
    o = runs.isoflop_optimum(s, ["budget"], "x", "val_bpb").select("budget", "x_opt")
    c = runs.isoflop_carry(o, s, ["budget"], "x", ["tokens_trained", "ratio"])
    return c.select("budget", F.round(F.col("tokens_trained_opt") / 1e6, 2).alias("tokens_opt"), F.round("ratio_opt", 3).alias("ratio_opt"))


BEST_SQL = f"""{RUNS_SQL},
best AS (SELECT budget, min(val_bpb) AS best_val_bpb,
                arg_min(run_id, (val_bpb, run_id)) AS run_id, any_value(flops_budget) AS flops_budget
         FROM sp GROUP BY budget),
bj AS (SELECT b.*, s.effective_params, s.tokens_trained FROM best b JOIN sp s ON b.run_id = s.run_id)"""


def best_rows(spark, sf_dir):
    s = scaled(spark, sf_dir)
    b = runs.best_per_group(s, ["budget"], "val_bpb", ["run_id"])
    return b.join(s.select("run_id", "flops_budget", "effective_params", "tokens_trained"), "run_id")


@query("best_per_group", oracle=f"""WITH {BEST_SQL}
SELECT budget, round(best_val_bpb, 9) AS best_val_bpb, run_id FROM best""")
def q_best_per_group(spark, sf_dir):
    b = runs.best_per_group(scaled(spark, sf_dir), ["budget"], "val_bpb", ["run_id"])
    return b.select("budget", F.round("best_val_bpb", 9).alias("best_val_bpb"), "run_id")


@query("power_law_fit", oracle=f"""WITH {BEST_SQL}
SELECT round(regr_slope(log10(effective_params), log10(flops_budget)), 6) AS n_exp,
       round(regr_slope(log10(tokens_trained), log10(flops_budget)), 6) AS d_exp,
       round(avg(tokens_trained / effective_params), 6) AS ratio_mean,
       round(stddev_samp(tokens_trained / effective_params), 6) AS ratio_std, count(*) AS n_points FROM bj""")
def q_power_law_fit(spark, sf_dir):
    f = runs.power_law_fit(best_rows(spark, sf_dir), "flops_budget", "effective_params", "tokens_trained")
    return f.select(F.round("n_exp", 6).alias("n_exp"), F.round("d_exp", 6).alias("d_exp"),
                    F.round("ratio_mean", 6).alias("ratio_mean"), F.round("ratio_std", 6).alias("ratio_std"),
                    "n_points")


LI_X = "log10(l_extendedprice)"


@query("linreg", oracle=f"""
SELECT l_suppkey, count(*) AS n, round(regr_slope(l_quantity, {LI_X}), 6) AS slope,
       round(regr_intercept(l_quantity, {LI_X}), 6) AS intercept, round(regr_r2(l_quantity, {LI_X}), 6) AS r2
FROM lineitem GROUP BY l_suppkey""")
def q_linreg(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("x", F.log10("l_extendedprice"))
    r = runs.linreg(li, ["l_suppkey"], "x", "l_quantity")
    return r.select("l_suppkey", "n", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")])


@query("best_predictor", oracle=f"""WITH u AS (
  SELECT l_returnflag, 'lx' AS feature, {LI_X} AS x, l_quantity AS y FROM lineitem
  UNION ALL SELECT l_returnflag, 'l_discount', l_discount, l_quantity FROM lineitem
  UNION ALL SELECT l_returnflag, 'l_tax', l_tax, l_quantity FROM lineitem
  UNION ALL SELECT l_returnflag, 'l_linenumber', l_linenumber, l_quantity FROM lineitem),
f AS (SELECT l_returnflag, feature, regr_r2(y, x) AS r2 FROM u GROUP BY ALL)
SELECT l_returnflag, arg_min(feature, (-r2, feature)) AS best_feature, round(max(r2), 6) AS r2 FROM f GROUP BY l_returnflag""")
def q_best_predictor(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("lx", F.log10("l_extendedprice"))
    r = runs.best_predictor(li, ["l_returnflag"], ["lx", "l_discount", "l_tax", "l_linenumber"], "l_quantity")
    return r.select("l_returnflag", "best_feature", F.round("r2", 6).alias("r2"))


RIDGE_TERMS = ["1.0", "lx", "l_discount", "l_tax"]
RIDGE_ALPHAS = [0.0, 0.001, 0.01, 0.1, 1.0]


def _det(m: list[list[str]]) -> str:
    """Determinant as SQL, by the first line."""
    if len(m) == 1:
        return m[0][0]
    parts = [f"{'-' if k % 2 else '+'} {m[0][k]} * ({_det([row[:k] + row[k + 1:] for row in m[1:]])})" for k in range(len(m))]
    return " ".join(parts)


def _ridge_sql() -> str:
    """Cramer's rule on the Gram sums of the complete rows; the intercept isn't penalised."""
    n = len(RIDGE_TERMS)
    sums = [f"sum({a} * {b}) AS g{i}{j}" for i, a in enumerate(RIDGE_TERMS) for j, b in enumerate(RIDGE_TERMS)]
    sums += [f"sum({a} * y) AS r{i}" for i, a in enumerate(RIDGE_TERMS)]
    gram = [[f"(g{i}{j} + alpha)" if i == j and i else f"g{i}{j}" for j in range(n)] for i in range(n)]
    terms = []
    for k, name in enumerate(["intercept", "lx", "l_discount", "l_tax"]):
        own = [[f"r{i}" if j == k else gram[i][j] for j in range(n)] for i in range(n)]
        terms.append(f"SELECT alpha, '{name}' AS term, round(({_det(own)}) / ({_det(gram)}), 6) AS coef FROM s, a")
    return f"""WITH x AS (SELECT log10(l_extendedprice) AS lx, l_discount::DOUBLE AS l_discount, l_tax::DOUBLE AS l_tax, l_quantity::DOUBLE AS y, l_orderkey FROM lineitem),
c AS (SELECT * FROM x WHERE l_orderkey % 7 <> 0), s AS (SELECT {", ".join(sums)} FROM c),
a(alpha) AS (VALUES {", ".join(f"({x}::DOUBLE)" for x in RIDGE_ALPHAS)})
{" UNION ALL ".join(terms)}"""


@query("ridge", oracle=_ridge_sql())
def q_ridge(spark, sf_dir):
    """One order in seven has no discount noted: its rows take no part."""
    li = table(spark, sf_dir, "lineitem").withColumn("lx", F.log10("l_extendedprice"))
    li = li.withColumn("l_discount", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_discount")))
    r = runs.ridge(li, ["lx", "l_discount", "l_tax"], "l_quantity", RIDGE_ALPHAS)
    return r.select("alpha", "term", F.round("coef", 6).alias("coef"))


@query("predict_from_fit", oracle=f"""WITH f AS (
  SELECT l_suppkey, regr_slope(l_quantity, {LI_X}) AS slope, regr_intercept(l_quantity, {LI_X}) AS intercept
  FROM lineitem GROUP BY l_suppkey)
SELECT l.l_suppkey, round(avg(abs(l.l_quantity - (f.intercept + f.slope * {LI_X}))), 6) AS mean_abs_resid
FROM lineitem l JOIN f ON l.l_suppkey = f.l_suppkey GROUP BY l.l_suppkey""")
def q_predict_from_fit(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("x", F.log10("l_extendedprice"))
    fit = runs.linreg(li, ["l_suppkey"], "x", "l_quantity")
    p = runs.predict_from_fit(li, fit, ["l_suppkey"], "x")
    return p.groupBy("l_suppkey").agg(F.round(F.avg(F.abs(F.col("l_quantity") - F.col("pred"))), 6)
                                      .alias("mean_abs_resid"))


SIZE_SQL = f"""f AS (SELECT regr_slope(l_quantity, {LI_X}) AS s1, regr_intercept(l_quantity, {LI_X}) AS i1,
                 regr_slope(l_quantity, l_discount) AS s2, regr_intercept(l_quantity, l_discount) AS i2 FROM lineitem),
a AS (SELECT l_suppkey, l_returnflag, l_linenumber, avg({LI_X}) AS x, avg(l_discount) AS z, avg(l_quantity) AS y FROM lineitem GROUP BY ALL),
m AS (SELECT l_linenumber, avg(y) AS measured FROM a WHERE l_returnflag = 'A' GROUP BY 1),
e AS (SELECT l_linenumber, avg((i1 + s1 * x + i2 + s2 * z) / 2) AS estimated FROM a, f WHERE l_returnflag = 'R' GROUP BY 1)"""


@query("size_matched_deltas", oracle=f"""WITH {SIZE_SQL}
SELECT l_linenumber, round(measured, 6) AS measured, round(estimated, 6) AS estimated, round(estimated - measured, 6) AS delta,
       round(100.0 * (estimated - measured) / measured, 4) AS percent FROM m JOIN e USING (l_linenumber)""")
def q_size_matched_deltas(spark, sf_dir):
    """Estimates of one family (mean of two models) against measured scores of another, by size class."""
    li = table(spark, sf_dir, "lineitem").withColumn("x", F.log10("l_extendedprice")).withColumn("all", F.lit(1))
    first, second = runs.linreg(li, ["all"], "x", "l_quantity"), runs.linreg(li, ["all"], "l_discount", "l_quantity")
    a = li.groupBy("l_suppkey", "l_returnflag", "l_linenumber", "all").agg(
        F.avg("x").alias("x"), F.avg("l_discount").alias("z"), F.avg("l_quantity").alias("y"))
    p = runs.predict_from_fit(runs.predict_from_fit(a, first, ["all"], "x", "p1").drop("slope", "intercept"), second, ["all"], "z", "p2")
    p = runs.average_predictions(p, "p1", "p2")
    both = runs.measured_and_estimated(
        a.filter("l_returnflag = 'A'").groupBy("l_linenumber").agg(F.avg("y").alias("score")).select(F.lit("A").alias("name"), "l_linenumber", "score"),
        p.filter("l_returnflag = 'R'").groupBy("l_linenumber").agg(F.avg("pred").alias("score")).select(F.lit("R").alias("name"), "l_linenumber", "score"),
        "name", "l_linenumber", "score")
    d = runs.size_matched(both.filter("kind = 'measured'"), both.filter("kind = 'estimated'"), "l_linenumber", "score")
    return d.select("l_linenumber", *[F.round(c, 6).alias(c) for c in ("measured", "estimated", "delta")], F.round("percent", 4).alias("percent"))


@query("repeat_run_stats", oracle="""
SELECT o_orderpriority, count(*) AS n_runs, round(avg(o_totalprice / 1e5), 6) AS mean,
       round(max(o_totalprice / 1e5) - min(o_totalprice / 1e5), 6) AS spread, avg(o_totalprice / 1e5) > 1.5 AS passed
FROM orders GROUP BY o_orderpriority""")
def q_repeat_run_stats(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("v", F.col("o_totalprice") / 1e5)
    r = runs.repeat_run_stats(o, ["o_orderpriority"], "v", 1.5)
    return r.select("o_orderpriority", "n_runs", F.round("mean", 6).alias("mean"),
                    F.round("spread", 6).alias("spread"), "passed")


DEVICES = ["NVIDIA H100 80GB HBM3", "NVIDIA H100 PCIe", "NVIDIA A100-SXM4-40GB", "NVIDIA GeForce RTX 4090",
           "NVIDIA RTX 6000 Ada Generation", "AMD Instinct MI300X", "NVIDIA L4"]


def devices(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in DEVICES], F.col("p_name"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.element_at(names, (F.col("p_partkey") % (len(DEVICES) + 1) + 1).cast("int")).alias("device"))


PF_SQL = ", ".join("({}, [{}], {!r})".format(i, ", ".join("'" + p + "'" for p in pats), float(f))
                   for i, (pats, f) in enumerate(runs.PEAK_FLOPS_TABLE))
DEV_SQL = "[" + ", ".join("'" + n + "'" for n in DEVICES) + "]"


@query("peak_flops_lookup", oracle=f"""WITH t(prio, patterns, peak_flops) AS (VALUES {PF_SQL}),
d AS (SELECT p_partkey, CASE WHEN p_partkey % {len(DEVICES) + 1} < {len(DEVICES)}
                             THEN {DEV_SQL}[p_partkey % {len(DEVICES) + 1} + 1] ELSE p_name END AS device FROM part),
m AS (SELECT d.p_partkey, arg_min(t.peak_flops, t.prio) AS peak_flops FROM d JOIN t
      ON len(list_filter(t.patterns, lambda p: NOT contains(lower(d.device), p))) = 0 GROUP BY d.p_partkey)
SELECT d.p_partkey, d.device, coalesce(m.peak_flops, 'inf'::DOUBLE) AS peak_flops
FROM d LEFT JOIN m ON d.p_partkey = m.p_partkey""")
def q_peak_flops_lookup(spark, sf_dir):
    return runs.peak_flops_lookup(devices(spark, sf_dir), runs.peak_flops_table(spark)).select(
        "p_partkey", "device", "peak_flops")


KNOT_SQL = """k AS (SELECT l_suppkey, l_linenumber::DOUBLE AS x, avg(l_quantity) AS y FROM lineitem GROUP BY ALL),
p AS (SELECT l_suppkey, x + 0.5 AS at FROM k UNION ALL SELECT l_suppkey, min(x) - 1 FROM k GROUP BY l_suppkey),
seg AS (SELECT l_suppkey, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM k
        WINDOW w AS (PARTITION BY l_suppkey ORDER BY x)),
e AS (SELECT l_suppkey, arg_min(y, x) AS y_first, min(x) AS x_first, arg_max(y, x) AS y_last, max(x) AS x_last
      FROM k GROUP BY l_suppkey)"""


@query("interp_column", oracle=f"""WITH {KNOT_SQL}
SELECT p.l_suppkey, p.at, round(CASE WHEN p.at <= e.x_first THEN e.y_first WHEN p.at >= e.x_last THEN e.y_last
  ELSE s.y0 + (s.y1 - s.y0) * (p.at - s.x0) / (s.x1 - s.x0) END, 6) AS interp
FROM p JOIN e ON p.l_suppkey = e.l_suppkey
LEFT JOIN seg s ON s.l_suppkey = p.l_suppkey AND s.x1 IS NOT NULL AND p.at >= s.x0 AND p.at < s.x1""")
def q_interp_column(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    k = li.groupBy("l_suppkey", F.col("l_linenumber").cast("double").alias("x")).agg(F.avg("l_quantity").alias("y"))
    p = k.select("l_suppkey", (F.col("x") + 0.5).alias("at")).unionByName(
        k.groupBy("l_suppkey").agg((F.min("x") - 1).alias("at")))
    r = runs.interp_column(p, k, ["l_suppkey"], "at")
    return r.select("l_suppkey", "at", F.round("interp", 6).alias("interp"))


# --- step metrics -------------------------------------------------------------

def steps(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts_us", F.unix_micros(F.col("ts").cast("timestamp")))
    return runs.with_steps(e, "user_id", ["ts_us", "event_id"])


STEPS_SQL = """st AS (SELECT user_id, event_id, ts, value,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM events)"""


@query("ema_debiased", oracle=f"""WITH RECURSIVE {STEPS_SQL},
r(user_id, step, s) AS (
  SELECT user_id, step, 0.1 * value FROM st WHERE step = 0
  UNION ALL
  SELECT r.user_id, r.step + 1, 0.9 * r.s + 0.1 * st.value FROM r JOIN st ON st.user_id = r.user_id AND st.step = r.step + 1)
SELECT user_id, step, round(s / (1 - pow(0.9, step + 1)), 6) AS ema FROM r""")
def q_ema_debiased(spark, sf_dir):
    r = runs.ema_debiased(steps(spark, sf_dir), "user_id", "step", "value")
    return r.select("user_id", "step", F.round("ema", 6).alias("ema"))


@query("ema_slow", oracle=f"""WITH RECURSIVE {STEPS_SQL},
r(user_id, step, s) AS (
  SELECT user_id, step, 0.001 * value FROM st WHERE step = 0
  UNION ALL
  SELECT r.user_id, r.step + 1, 0.999 * r.s + 0.001 * st.value FROM r JOIN st ON st.user_id = r.user_id AND st.step = r.step + 1)
SELECT user_id, step, round(s / (1 - pow(0.999, step + 1)), 6) AS ema FROM r""")
def q_ema_slow(spark, sf_dir):
    """A decay that needs the state of all earlier blocks (of 16 steps here)."""
    r = runs.ema_debiased(steps(spark, sf_dir), "user_id", "step", "value", beta=0.999, block=16)
    return r.select("user_id", "step", F.round("ema", 6).alias("ema"))


@query("running_min_bpb", oracle=f"""WITH {STEPS_SQL}
SELECT user_id, step, min(value) OVER (PARTITION BY user_id ORDER BY step) AS best FROM st""")
def q_running_min_bpb(spark, sf_dir):
    return runs.running_min(steps(spark, sf_dir), "user_id", "step", "value", "best").select(
        "user_id", "step", "best")


def step_dt(spark, sf_dir):
    """dt of each step = time since the run's previous step; none for its first step."""
    e = table(spark, sf_dir, "events").withColumn("ts_us", F.unix_micros(F.col("ts").cast("timestamp")))
    s = runs.with_steps(e, "user_id", ["ts_us", "event_id"], previous={"prev_us": "ts_us"})
    return s.withColumn("dt_us", F.col("ts_us") - F.col("prev_us")).withColumn("dt", F.col("dt_us") / 1e6)


DT_SQL = f"""{STEPS_SQL},
dt AS (SELECT a.user_id, a.step, epoch_us(a.ts) - epoch_us(b.ts) AS dt_us, (epoch_us(a.ts) - epoch_us(b.ts)) / 1e6 AS dt
       FROM st a LEFT JOIN st b ON a.user_id = b.user_id AND b.step = a.step - 1)"""
TOKENS_PER_STEP = 524288
FLOPS_PER_TOKEN = 6 * 124e6


@query("throughput", oracle=f"""WITH {DT_SQL}
SELECT user_id, step, CASE WHEN dt > 0 THEN trunc({TOKENS_PER_STEP} / dt) END AS tok_per_sec,
       CASE WHEN dt > 0 THEN round(100.0 * ({FLOPS_PER_TOKEN} * {TOKENS_PER_STEP} / dt) / (989e12 * 1), 6) END AS mfu
FROM dt""")
def q_throughput(spark, sf_dir):
    d = step_dt(spark, sf_dir).withColumn("device", F.lit("NVIDIA H100 80GB HBM3"))
    d = runs.peak_flops_lookup(d, runs.peak_flops_table(spark))
    r = runs.throughput(d, TOKENS_PER_STEP, FLOPS_PER_TOKEN, 1)
    return r.select("user_id", "step", "tok_per_sec", F.round("mfu", 6).alias("mfu"))


@query("train_time_eta", oracle=f"""WITH {DT_SQL},
n AS (SELECT user_id, count(*) AS num_iterations FROM st GROUP BY user_id),
c AS (SELECT dt.*, n.num_iterations, sum(CASE WHEN step > 10 THEN dt_us ELSE 0 END)
        OVER (PARTITION BY dt.user_id ORDER BY step)::BIGINT AS total_us FROM dt JOIN n ON dt.user_id = n.user_id)
SELECT user_id, step, total_us / 1e6 AS total_time,
       CASE WHEN step > 10 THEN total_us / (step - 10) * (num_iterations - step) / 1e6 END AS eta_sec FROM c""")
def q_train_time_eta(spark, sf_dir):
    d = step_dt(spark, sf_dir)
    n = d.groupBy("user_id").agg(F.count(F.lit(1)).alias("num_iterations"))
    d = d.withColumn("dt_us", F.coalesce("dt_us", F.lit(0)))
    r = runs.train_time_eta(d.join(n, "user_id"), "user_id", "step", "dt_us", "num_iterations")
    return r.select("user_id", "step", (F.col("total_time") / 1e6).alias("total_time"),
                    (F.col("eta_sec") / 1e6).alias("eta_sec"))


@query("report_pivot", oracle="""WITH m AS (
  SELECT event_type AS stage, 'count' AS metric, CASE WHEN count(*) >= 10000 THEN format('{:,}', count(*)) ELSE count(*)::VARCHAR END AS v FROM events GROUP BY 1
  UNION ALL SELECT event_type, 'mean_value', printf('%.4f', avg(value)) FROM events GROUP BY 1
  UNION ALL SELECT event_type, 'big_values', count(*)::VARCHAR FROM events WHERE value > 99.9 GROUP BY 1
  UNION ALL SELECT event_type, 'duration',
                   ((floor(epoch(max(ts))) - floor(epoch(min(ts))))::BIGINT // 60 // 60)::VARCHAR || 'h '
                   || ((floor(epoch(max(ts))) - floor(epoch(min(ts))))::BIGINT // 60 % 60)::VARCHAR || 'm'
                   FROM events GROUP BY 1)
SELECT metric,
  coalesce(any_value(v) FILTER (WHERE stage = 'click'), '-') AS click,
  coalesce(any_value(v) FILTER (WHERE stage = 'error'), '-') AS error,
  coalesce(any_value(v) FILTER (WHERE stage = 'purchase'), '-') AS purchase,
  coalesce(any_value(v) FILTER (WHERE stage = 'signup'), '-') AS signup,
  coalesce(any_value(v) FILTER (WHERE stage = 'view'), '-') AS "view"
FROM m GROUP BY metric""")
def q_report_pivot(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    cnt = e.groupBy(F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("n")).select(
        "stage", F.lit("count").alias("metric"), runs.format_value(F.col("n"), F.lit(True)).alias("v"))
    mean = e.groupBy(F.col("event_type").alias("stage")).agg(F.avg("value").alias("x")).select(
        "stage", F.lit("mean_value").alias("metric"), runs.format_value(F.col("x"), F.lit(False)).alias("v"))
    big = e.filter(F.col("value") > 99.9).groupBy(F.col("event_type").alias("stage")).agg(
        F.count(F.lit(1)).alias("n")).select("stage", F.lit("big_values").alias("metric"),
                                             F.col("n").cast("string").alias("v"))
    mins = (F.unix_seconds(F.max("ts").cast("timestamp")) - F.unix_seconds(F.min("ts").cast("timestamp")))
    dur = e.groupBy(F.col("event_type").alias("stage")).agg(mins.alias("s")).select(
        "stage", F.lit("duration").alias("metric"),
        F.concat((F.floor(F.col("s") / 60) / 60).cast("long").cast("string"), F.lit("h "),
                 (F.floor(F.col("s") / 60) % 60).cast("long").cast("string"), F.lit("m")).alias("v"))
    long = cnt.unionByName(mean).unionByName(big).unionByName(dur)
    return runs.report_pivot(long, "metric", "stage", "v")

"""Training-run analytics: regressions, scaling fits, lookups and step metrics.

Fits are grouped aggregates (``regr_*`` or moment sums) so any number of
groups and rows is handled in one shuffle; only coefficient tables of a few
numbers per group are produced.  Step-metric recurrences (EMA, running
minimum, cumulative time) are expressed with bounded windows per
(run, block) plus a small per-block carry, so a very long run is spread over
many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import dense_index, last_known, running_sum
from ..functions.sizing import broadcast_if_small
from ..session import materialised

# ---------------------------------------------------------------------------
# BF16 peak FLOP/s by device-name patterns.  The first row whose
# patterns all occur in the lower-cased name wins; unknown devices get +inf.
PEAK_FLOPS_TABLE = [
    (["gb300"], 2.7e15),
    (["b300"], 2.6e15),
    (["gb200"], 2.5e15),
    (["grace blackwell"], 2.5e15),
    (["b200"], 2.25e15),
    (["b100"], 1.8e15),
    (["h200", "nvl"], 836e12),
    (["h200", "pcie"], 836e12),
    (["h200"], 989e12),
    (["h100", "nvl"], 835e12),
    (["h100", "pcie"], 756e12),
    (["h100"], 989e12),
    (["h800", "nvl"], 989e12),
    (["h800"], 756e12),
    (["a100"], 312e12),
    (["a800"], 312e12),
    (["a40"], 149.7e12),
    (["a30"], 165e12),
    (["l40s"], 362e12),
    (["l40-s"], 362e12),
    (["l40 s"], 362e12),
    (["rtx 6000 ada"], 364e12),
    (["l4"], 121e12),
    (["mi355"], 2.5e15),
    (["mi325"], 1.3074e15),
    (["mi300x"], 1.3074e15),
    (["mi300a"], 980.6e12),
    (["mi250x"], 383e12),
    (["mi250"], 362.1e12),
    (["5090"], 209.5e12),
    (["4090"], 165.2e12),
    (["3090"], 71e12),
]
EMA_BETA = 0.9
# ---------------------------------------------------------------------------


def peak_flops_table(spark) -> DataFrame:
    return spark.createDataFrame([(i, p, f) for i, (p, f) in enumerate(PEAK_FLOPS_TABLE)],
                                 "prio int, patterns array<string>, peak_flops double")


def peak_flops_lookup(d: DataFrame, table: DataFrame, name: str = "device") -> DataFrame:
    """Theta join on ``forall(patterns, contains)``; first match by priority; unknown -> +inf."""
    t = broadcast_if_small(table)
    keyed = d.select(F.col(name).alias("_name")).distinct()
    m = keyed.join(t, F.forall("patterns", lambda p: F.contains(F.lower(F.col("_name")), p)), "inner")
    best = m.groupBy("_name").agg(F.min_by("peak_flops", "prio").alias("peak_flops"))
    return d.join(best.withColumnRenamed("_name", name), name, "left").withColumn(
        "peak_flops", F.coalesce("peak_flops", F.lit(float("inf"))))


def linreg(d: DataFrame, group: Sequence[str], x: str, y: str) -> DataFrame:
    """1-D OLS per group: slope, intercept, R^2 = 1 - SSres/SStot, of the ``n`` rows that have both values."""
    return d.groupBy(*group).agg(F.regr_count(y, x).alias("n"),
                                 F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                                 F.regr_r2(y, x).alias("r2"))


def unpivot(d: DataFrame, keys: Sequence[str], features: Sequence[str], y: str) -> DataFrame:
    return d.select(*keys, F.col(y).alias("y"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("_f")) \
        .select(*keys, "y", "_f.feature", "_f.x")


def best_predictor(d: DataFrame, group: Sequence[str], features: Sequence[str], y: str) -> DataFrame:
    """Fit each feature alone, rank by R^2, keep the best (ties: feature name)."""
    long = unpivot(d, group, features, y)
    fits = linreg(long, [*group, "feature"], "x", "y")
    return fits.groupBy(*group).agg(
        F.min_by("feature", F.struct(-F.coalesce("r2", F.lit(-1.0)), F.col("feature"))).alias("best_feature"),
        F.max("r2").alias("r2"))


def ridge(d: DataFrame, features: Sequence[str], y: str, alphas: Sequence[float]) -> DataFrame:
    """(X'X + aI')^-1 X'y with an unpenalised intercept, for each alpha.

    The Gram matrix is one Spark aggregate of d(d+1)/2 + d + 1 sums; the
    (d+1)x(d+1) solve happens on the driver (a handful of numbers).  Rows with a NULL
    or NaN take no part; without any row there are no coefficients.
    """
    cols = ["_one", *features]
    complete = F.lit(True)
    for c in (*features, y):
        complete = complete & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    base = d.filter(complete).withColumn("_one", F.lit(1.0))
    aggs = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            aggs.append(F.sum(F.col(a).cast("double") * F.col(b).cast("double")).alias(f"g_{a}_{b}"))
        aggs.append(F.sum(F.col(a).cast("double") * F.col(y).cast("double")).alias(f"r_{a}"))
    row = base.agg(*aggs).first().asDict()
    schema = "alpha double, term string, coef double"
    if not row["g__one__one"]:
        return d.sparkSession.createDataFrame([], schema)
    k = len(cols)
    g = np.zeros((k, k))
    r = np.zeros(k)
    for i, a in enumerate(cols):
        r[i] = row[f"r_{a}"]
        for j in range(i, k):
            g[i, j] = g[j, i] = row[f"g_{a}_{cols[j]}"]
    out = []
    for alpha in alphas:
        pen = np.eye(k) * alpha
        pen[0, 0] = 0.0
        coef = np.linalg.lstsq(g + pen, r, rcond=None)[0]  # the smallest of several solutions
        out += [(float(alpha), name, float(c)) for name, c in zip(["intercept", *features], coef)]
    return d.sparkSession.createDataFrame(out, schema)


def predict_from_fit(d: DataFrame, fit: DataFrame, group: Sequence[str], x: str, out: str = "pred") -> DataFrame:
    return d.join(fit.select(*group, "slope", "intercept"), list(group), "left").withColumn(
        out, F.col("intercept") + F.col("slope") * F.col(x))


def scaling_params(d: DataFrame, style: str = "transformer_lm_head") -> DataFrame:
    """Effective parameters, tokens/params ratio; drop null or non-positive bpb."""
    if style == "total":
        eff = F.col("params_total")
    elif style == "transformer":
        eff = F.col("params_transformer")
    else:
        eff = F.col("params_transformer") + F.col("params_lm_head")
    return (d.filter(F.col("val_bpb").isNotNull() & (F.col("val_bpb") > 0))
             .withColumn("effective_params", eff.cast("double"))
             .withColumn("ratio", F.col("tokens_trained") / F.col("effective_params")))


def isoflop_optimum(d: DataFrame, group: Sequence[str], x: str, y: str) -> DataFrame:
    """Per group fit ``y = a*x'^2 + b*x' + c`` with x' = x - mean(x) (moments, Cramer's rule).

    If ``a > 0`` the optimum is the vertex, else the row of minimum ``y``.
    Returns ``x_opt``, ``y_opt`` and ``method``.
    """
    means = d.groupBy(*group).agg(F.avg(x).alias("_mx"))
    c = d.join(means, list(group)).withColumn("_u", F.col(x) - F.col("_mx"))
    u, v = F.col("_u"), F.col(y)
    s = c.groupBy(*group).agg(
        F.count(F.lit(1)).cast("double").alias("s0"), F.sum(u).alias("s1"), F.sum(u * u).alias("s2"),
        F.sum(u * u * u).alias("s3"), F.sum(u * u * u * u).alias("s4"), F.sum(v).alias("t0"),
        F.sum(u * v).alias("t1"), F.sum(u * u * v).alias("t2"), F.first("_mx").alias("_mx"),
        F.min_by(F.col(x), F.struct(v, F.col(x))).alias("_xmin"), F.min(v).alias("_ymin"))

    def det3(a11, a12, a13, a21, a22, a23, a31, a32, a33):
        return a11 * (a22 * a33 - a23 * a32) - a12 * (a21 * a33 - a23 * a31) + a13 * (a21 * a32 - a22 * a31)

    S0, S1, S2, S3, S4 = (F.col(k) for k in ("s0", "s1", "s2", "s3", "s4"))
    T0, T1, T2 = F.col("t0"), F.col("t1"), F.col("t2")
    # normal equations: [S4 S3 S2; S3 S2 S1; S2 S1 S0] [a b c]' = [T2 T1 T0]'
    D = det3(S4, S3, S2, S3, S2, S1, S2, S1, S0)
    A = det3(T2, S3, S2, T1, S2, S1, T0, S1, S0) / D
    B = det3(S4, T2, S2, S3, T1, S1, S2, T0, S0) / D
    C = det3(S4, S3, T2, S3, S2, T1, S2, S1, T0) / D
    r = s.withColumn("a", A).withColumn("b", B).withColumn("c", C)
    vert = -F.col("b") / (2 * F.col("a"))
    ok = (F.col("a") > 0) & (F.col("s0") >= 3)
    return r.select(*group, "a", "b", "c",
                    F.when(ok, vert + F.col("_mx")).otherwise(F.col("_xmin")).alias("x_opt"),
                    F.when(ok, F.col("a") * vert * vert + F.col("b") * vert + F.col("c"))
                     .otherwise(F.col("_ymin")).alias("y_opt"),
                    F.when(ok, F.lit("vertex")).otherwise(F.lit("min")).alias("method"))


def power_law_fit(d: DataFrame, c: str, n: str, tokens: str) -> DataFrame:
    """log-log slopes of N(C) and D(C); ratio D/N at the geometric-mean compute; ratio mean/std."""
    lc, ln_, ld = F.log10(c), F.log10(n), F.log10(tokens)
    g = d.agg(F.regr_slope(ln_, lc).alias("n_exp"), F.regr_intercept(ln_, lc).alias("n_icpt"),
              F.regr_slope(ld, lc).alias("d_exp"), F.regr_intercept(ld, lc).alias("d_icpt"),
              F.avg(lc).alias("log_c_mean"), F.avg(F.col(tokens) / F.col(n)).alias("ratio_mean"),
              F.stddev_samp(F.col(tokens) / F.col(n)).alias("ratio_std"), F.count(F.lit(1)).alias("n_points"))
    at = F.col("log_c_mean")
    return g.withColumn("ratio_at_mean_c", F.pow(F.lit(10.0), (F.col("d_icpt") + F.col("d_exp") * at))
                        / F.pow(F.lit(10.0), (F.col("n_icpt") + F.col("n_exp") * at)))


def best_per_group(d: DataFrame, group: Sequence[str], metric: str, carry: Sequence[str]) -> DataFrame:
    """Row of minimum ``metric`` per group (ties: smallest carried values)."""
    order = F.struct(F.col(metric), *[F.col(c) for c in carry])
    return d.groupBy(*group).agg(F.min(metric).alias(f"best_{metric}"),
                                 *[F.min_by(F.col(c), order).alias(c) for c in carry])


def repeat_run_stats(d: DataFrame, group: Sequence[str], value: str, threshold: float) -> DataFrame:
    return d.groupBy(*group).agg(F.count(F.lit(1)).alias("n_runs"), F.avg(value).alias("mean"),
                                 (F.max(value) - F.min(value)).alias("spread")).withColumn(
        "passed", F.col("mean") > threshold)


def interp_column(points: DataFrame, knots: DataFrame, group: Sequence[str], at: str,
                  kx: str = "x", ky: str = "y") -> DataFrame:
    """Piecewise-linear interpolation per group, clamped to the end knots (like ``np.interp``).

    A group's points and knots are scanned in range buckets, so a hot group spreads over tasks.
    A NULL point, or a group without knots, gives NULL; knots with a NULL place count for nothing.
    """
    k = knots.select(*group, F.col(kx).cast("double").alias("_x"), F.col(ky).alias("_y")).filter("_x IS NOT NULL")
    k = running_sum(k, F.lit(0), ["_x", "_y"], by=group, out="_n", previous={"_x0": "_x", "_y0": "_y"})
    knot = k.select(*group, (-F.col("_x")).alias("_at"), F.lit(0).alias("_kind"), F.struct("_x", "_y", "_x0", "_y0").alias("_knot"))
    # from right to left: a point meets the first knot at or after it, which knows the one before
    point = points.withColumn("_at", -F.col(at).cast("double")).withColumn("_kind", F.lit(1))
    both = last_known(knot.unionByName(point, allowMissingColumns=True), "_knot", ["_at", "_kind"], by=group, out="_next").filter("_kind = 1")
    ends = knots.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]).agg(F.max_by(ky, kx).alias("_y_last"))
    on = F.lit(True)
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    j = both.join(ends, on, "left")
    n, x = F.col("_next"), F.col(at)
    val = (F.when(x.isNull(), F.lit(None)).when(n.isNull(), F.col("_y_last")).when(n["_x0"].isNull() | (x == n["_x"]), n["_y"])
           .otherwise(n["_y0"] + (n["_y"] - n["_y0"]) * (x - n["_x0"]) / (n["_x"] - n["_x0"])))
    return j.select(*points.columns, val.alias("interp"))


def _near(d: DataFrame, points: DataFrame, group: Sequence[str], x: str) -> DataFrame:
    """The rows of ``d`` that interpolation at ``x_opt`` depends on: those of the values of ``x`` next to a point, and of the ends.

    Two passes with partial aggregation; points and the values found are small.
    """
    at = points.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "x_opt").distinct()
    own = [f"_g{i}" for i in range(len(group))]

    same = F.lit(True)
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    v, opt = F.col("_x").cast("double"), F.col("x_opt")
    met = d.select(*group, F.col(x).alias("_x")).join(broadcast_if_small(at), same)
    ends = met.groupBy(*own, "x_opt").agg(F.max(F.when(v < opt, F.col("_x"))).alias("a"), F.min(F.when(v >= opt, F.col("_x"))).alias("b"),
                                          F.min("_x").alias("c"), F.max("_x").alias("d"))
    kept = ends.select(*own, F.explode(F.array("a", "b", "c", "d")).alias("_at")).filter("_at IS NOT NULL").distinct()
    kept = materialised(kept, "isoflop-near")
    return d.join(broadcast_if_small(kept), same & (F.col(x) == F.col("_at")), "left_semi")


def isoflop_carry(opt: DataFrame, d: DataFrame, group: Sequence[str], x: str, carry: Sequence[str]) -> DataFrame:
    """Values of ``carry`` at each group's optimum, interpolated along ``x`` (mean of equal ``x``)."""
    opt = materialised(opt, "isoflop-opt")
    near = _near(d.select(*dict.fromkeys([*group, x, *carry])), opt, group, x)
    means = near.groupBy(*group, F.col(x).alias("x")).agg(*[F.avg(c).alias(f"_y{i}") for i, c in enumerate(carry)])
    means = materialised(means, "isoflop-knots")
    out = opt
    for i, c in enumerate(carry):
        knots = means.select(*group, "x", F.col(f"_y{i}").alias("y"))
        at = interp_column(opt.select(*group, "x_opt"), knots, group, "x_opt")
        out = out.join(at.select(*group, F.col("interp").alias(f"{c}_opt")), list(group))
    return out


# ---------------------------------------------------------------------------
# Step metrics

def with_steps(d: DataFrame, run: str, order: Sequence[str], out: str = "step",
               previous: dict[str, str] | None = None) -> DataFrame:
    """0-based step per run in ``order`` (skew-safe dense index); ``previous`` as in ``dense_index``."""
    return dense_index(d, list(order), by=[run], out=out, previous=previous)


EMA_BLOCK = 512


def decayed_sum(d: DataFrame, run: str, step: str, x: str, beta: float, out: str, block: int = EMA_BLOCK) -> DataFrame:
    """``s_j = x_j + beta * s_(j-1)`` per run over dense steps, in bounded windows.

    Inside a block the sum is closed-form, scaled by powers of ``beta`` that stay far from
    overflow; block ends follow the same recurrence with ``beta ** block``, which is solved
    the same way until its decay is below double precision.
    """
    if beta < 1e-18:
        return d.withColumn(out, F.col(x).cast("double"))
    size = max(1, min(block, int(150 / -math.log10(beta)) if beta < 1 else block))
    lb = math.log(beta)
    b = d.withColumn("_blk", F.floor(F.col(step) / size)).withColumn("_j", F.col(step) % size)
    w = Window.partitionBy(run, "_blk").orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("_local", F.exp(F.col("_j") * lb) * F.sum(F.col(x) * F.exp(-F.col("_j") * lb)).over(w))
    ends = b.groupBy(run, "_blk").agg(F.max_by("_local", step).alias("_end")).select(run, F.col("_blk").alias("_at"), "_end")
    state = decayed_sum(ends, run, "_at", "_end", beta ** size, "_state", block)
    carry = state.select(F.col(run).alias("_run"), (F.col("_at") + 1).alias("_next"), F.col("_state").alias("_carry"))
    r = b.join(carry, F.col(run).eqNullSafe(F.col("_run")) & (F.col("_blk") == F.col("_next")), "left")
    s = F.col("_local") + F.exp((F.col("_j") + 1) * lb) * F.coalesce("_carry", F.lit(0.0))
    return r.withColumn(out, s).drop("_blk", "_j", "_local", "_run", "_next", "_carry")


def ema_debiased(d: DataFrame, run: str, step: str, x: str, beta: float = EMA_BETA,
                 block: int = EMA_BLOCK) -> DataFrame:
    """``s = beta*s + (1-beta)*x``, reported as ``s / (1 - beta^(step+1))``; 0 < beta < 1."""
    r = decayed_sum(d, run, step, x, beta, "_s", block)
    return r.withColumn("ema", F.col("_s") * (1 - beta) / (1 - F.pow(F.lit(beta), F.col(step) + 1))).drop("_s")


def running_min(d: DataFrame, run: str, step: str, x: str, out: str, block: int = 4096) -> DataFrame:
    """Best-so-far per run: min within (run, block) windows, then the min of earlier blocks."""
    b = d.withColumn("_blk", (F.col(step) / block).cast("long"))
    w = Window.partitionBy(run, "_blk").orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("_lmin", F.min(x).over(w))
    mins = b.groupBy(run, "_blk").agg(F.min(x).alias("_bmin"))
    wb = Window.partitionBy(run).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    prev = mins.select(run, "_blk", F.min("_bmin").over(wb).alias("_prev"))
    r = b.join(prev, [run, "_blk"], "left")
    return r.withColumn(out, F.least(F.col("_lmin"), F.coalesce("_prev", F.col("_lmin")))).drop(
        "_blk", "_lmin", "_prev")


def running_total(d: DataFrame, run: str, step: str, x: Column, out: str, block: int = 4096) -> DataFrame:
    """Cumulative sum per run with the same block decomposition."""
    b = d.withColumn("_blk", (F.col(step) / block).cast("long")).withColumn("_x", x)
    w = Window.partitionBy(run, "_blk").orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("_l", F.sum("_x").over(w))
    sums = b.groupBy(run, "_blk").agg(F.sum("_x").alias("_bs"))
    wb = Window.partitionBy(run).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    prev = sums.select(run, "_blk", F.coalesce(F.sum("_bs").over(wb), F.lit(0)).alias("_prev"))
    return b.join(prev, [run, "_blk"], "left").withColumn(out, F.col("_l") + F.col("_prev")).drop(
        "_blk", "_x", "_l", "_prev")


def throughput(d: DataFrame, tokens_per_step: int, flops_per_token: float, world: int = 1,
               dt: str = "dt", peak: str = "peak_flops") -> DataFrame:
    """tok/s (truncated to int), FLOP/s and MFU = 100 * flops / (peak * world); null without a positive dt."""
    known = F.when(F.col(dt) > 0, F.col(dt))
    fps = flops_per_token * tokens_per_step / known
    return (d.withColumn("tok_per_sec", F.floor(F.lit(tokens_per_step) / known).cast("double"))
             .withColumn("flops_per_sec", fps)
             .withColumn("mfu", 100.0 * fps / (F.col(peak) * world)))


def train_time_eta(d: DataFrame, run: str, step: str, dt: str, num_iterations: str, warmup: int = 10) -> DataFrame:
    """Cumulative dt for steps > warmup; ETA = mean dt * remaining steps; null before."""
    r = running_total(d, run, step, F.when(F.col(step) > warmup, F.col(dt)).otherwise(F.lit(0)), "total_time")
    avg = F.col("total_time") / (F.col(step) - warmup)
    return r.withColumn("eta_sec", F.when(F.col(step) > warmup, avg * (F.col(num_iterations) - F.col(step))))


def report_pivot(d: DataFrame, metric: str, stage: str, value: str, stages: Sequence[str] | None = None) -> DataFrame:
    """metric x stage table of formatted values, '-' where missing; metrics sorted.

    Without ``stages`` every stage of the data is a column; of several values the smallest counts.
    """
    g = d.groupBy(metric)
    p = (g.pivot(stage) if stages is None else g.pivot(stage, list(stages))).agg(F.min(value))
    return p.na.fill("-").orderBy(metric)


def average_predictions(d: DataFrame, first: str, second: str, out: str = "pred") -> DataFrame:
    """Mean of two models' predictions; null if either is."""
    return d.withColumn(out, (F.col(first) + F.col(second)) / 2)


def measured_and_estimated(measured: DataFrame, estimated: DataFrame, name: str, size: str, score: str) -> DataFrame:
    """One table of both, with ``kind``."""
    return measured.select(name, size, score, F.lit("measured").alias("kind")).unionByName(
        estimated.select(name, size, score, F.lit("estimated").alias("kind")))


def size_matched(measured: DataFrame, estimated: DataFrame, by: str, score: str) -> DataFrame:
    """Estimated against measured score of the same size class: difference and percent."""
    j = measured.select(by, F.col(score).alias("measured")).join(estimated.select(by, F.col(score).alias("estimated")), by)
    return j.withColumn("delta", F.col("estimated") - F.col("measured")).withColumn(
        "percent", 100.0 * F.col("delta") / F.col("measured"))


def format_value(v: Column, is_int: Column) -> Column:
    """Floats as %.4f, integers >= 10000 with thousands separators, else plain."""
    return (F.when(~is_int, F.format_string("%.4f", v))
            .when(F.abs(v) >= 10000, F.format_number(v.cast("long"), 0))
            .otherwise(v.cast("long").cast("string")))

"""Prediction quality: correlations, curves, calibration, uncertainty."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import exprs as X
from ..functions.distributions import t_two_sided
from ..functions.ordered import (average_ranks, equal_count_bins, medians, quantiles, row_numbers, top_k,
                                 value_counts)
from ..functions.storage import reusable

# Grid of the null-fraction estimators, smallest positive double step, default spline freedom.
PI0_LAMBDAS = tuple(round(0.05 * i, 2) for i in range(1, 20))
EPS = 2.220446049250313e-16
SMOOTH_DF = 3.0


# ---- alignment -----------------------------------------------------------------------------

def align(tables: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Inner join of several value tables on all keys; a duplicated key is an error."""
    keys, out = list(keys), None
    for name, t in tables.items():
        one = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("__c"), F.first("value").alias("__v")).select(
            *keys, F.when(F.col("__c") > 1, F.raise_error(F.lit(f"duplicate key in {name}")).cast("double"))
            .otherwise(F.col("__v")).alias(name))
        out = one if out is None else out.join(one, keys)
    return out


def harmonised_donors(df: DataFrame, *, model: str = "model", donor: str = "donor") -> DataFrame:
    """Rows of donors that every model predicts."""
    n_models = df.select(F.count_distinct(model)).scalar()
    everywhere = (df.groupBy(donor).agg(F.count_distinct(model).alias("__n"))
                  .filter(F.col("__n") == n_models).select(donor))
    return df.join(everywhere, donor, "left_semi")


# ---- correlation ---------------------------------------------------------------------------

def _pearson_from(n: Column, cov: Column, vx: Column, vy: Column, min_n: int) -> Column:
    scale = F.sqrt(vx * vy)
    return X.clip(F.when((n >= min_n) & (n * scale > EPS), F.try_divide(cov, scale)), -1.0, 1.0)


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided t p-value of a correlation, 0 at |r| = 1."""
    one = F.nullif(1.0 - r * r, F.lit(0.0))
    t = F.when(F.abs(r) < 1, r * F.sqrt((n - 2).cast("double")) / F.sqrt(one))
    return F.when(F.abs(r) >= 1, 0.0).otherwise(t_two_sided(t, (n - 2).cast("double")))


def pearson(df: DataFrame, keys: Sequence[str], x: str, y: str, *, min_n: int = 3,
            with_p: bool = False) -> DataFrame:
    """r per group over complete pairs, null below ``min_n`` or for a constant side.

    One aggregate with map-side partial moments: a group of any size is combined, not gathered.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    cx, cy = F.when(both, F.col(x)), F.when(both, F.col(y))
    m = df.groupBy(*keys).agg(F.count(cx).alias("n"), F.covar_pop(cx, cy).alias("__c"),
                              F.var_pop(cx).alias("__x"), F.var_pop(cy).alias("__y"))
    out = m.select(*keys, "n", _pearson_from(F.col("n"), F.col("__c"), F.col("__x"), F.col("__y"), min_n).alias("r"))
    return out.withColumn("pvalue", correlation_p(F.col("r"), F.col("n"))) if with_p else out


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, *, min_n: int = 3,
             limit: int | None = None) -> DataFrame:
    """Average-rank correlation per group over complete pairs."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *keys, F.col(x).alias("__x0"), F.col(y).alias("__y0"))
    ranked = average_ranks(pairs, keys, "__x0", out="__rx", limit=limit)
    ranked = average_ranks(ranked, keys, "__y0", out="__ry", limit=limit)
    return pearson(ranked, keys, "__rx", "__ry", min_n=min_n).withColumnRenamed("r", "rho")


def error_metrics(df: DataFrame, keys: Sequence[str], prediction: str, truth: str, *, min_n: int = 3,
                  limit: int | None = None) -> DataFrame:
    """n, RMSE, MAE, Pearson and Spearman per group (no keys: one row)."""
    keys = list(keys)
    e = F.col(prediction) - F.col(truth)
    base = df.filter(e.isNotNull()).groupBy(*keys).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))
    r, rho = pearson(df, keys, prediction, truth, min_n=min_n), spearman(
        df, keys, prediction, truth, min_n=min_n, limit=limit).drop("n")
    if not keys:
        return base.withColumns({"n": r.select("n").scalar(), "r": r.select("r").scalar(),
                                 "rho": rho.select("rho").scalar()})
    return base.join(r, keys).join(rho, keys, "left")


def mean_correlations(df: DataFrame, prediction: str, truth: str, *, min_n: int = 2) -> DataFrame:
    """Mean r across genes within cell types, across cell types within genes, and their mean."""
    genes = pearson(df, ["cell_type"], prediction, truth, min_n=min_n).agg(F.avg("r").alias("a"))
    types = pearson(df, ["gene"], prediction, truth, min_n=min_n).agg(F.avg("r").alias("b"))
    both = genes.withColumn("b", types.scalar())
    return both.select(F.col("a").alias("mean_across_genes"), F.col("b").alias("mean_across_cell_types"),
                       ((F.col("a") + F.col("b")) / 2).alias("mean_of_both"))


# ---- threshold curves ----------------------------------------------------------------------

def _threshold_counts(df: DataFrame, keys: Sequence[str], r: str, steps: int) -> DataFrame:
    """Rows with |r| >= i/steps for i = 0..steps, from one small histogram per group."""
    keys = list(keys)
    grid = F.array(*[F.lit(i / steps) for i in range(steps + 1)])
    passed = F.size(F.filter(grid, lambda t: t <= F.abs(F.col(r))))
    cells = (df.filter(F.col(r).isNotNull()).groupBy(*keys, passed.alias("cell"))
             .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(r) > 0).alias("pos")))
    # At most steps + 2 histogram rows per group reach the explode.
    reach = cells.filter("cell > 0").select(*keys, "n", "pos", F.explode(F.sequence(F.lit(0), F.col("cell") - 1)).alias("i"))
    counted = reach.groupBy(*keys, "i").agg(F.sum("n").alias("n_at"), F.sum("pos").alias("pos_at"))
    groups = cells.groupBy(*keys).agg(F.sum("n").alias("n_genes")).select(
        *keys, "n_genes", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("i"))
    joined = groups.join(counted, [*keys, "i"], "left")
    return joined.select(*keys, (F.col("i") / F.lit(steps)).alias("threshold"), "i", "n_genes",
                         F.coalesce("n_at", F.lit(0)).alias("n_at"), F.coalesce("pos_at", F.lit(0)).alias("pos_at"))


def survival_curve(df: DataFrame, keys: Sequence[str], r: str = "r", *, steps: int = 100) -> DataFrame:
    """P(|r| >= t) on a 0..1 grid."""
    return _threshold_counts(df, keys, r, steps).select(
        *keys, "threshold", "n_genes", F.try_divide("n_at", "n_genes").alias("survival"))


def survival_auc(df: DataFrame, keys: Sequence[str], r: str = "r", *, steps: int = 100) -> DataFrame:
    """Trapezoid area below the survival curve."""
    weight = F.when(F.col("i").isin(0, steps), 0.5).otherwise(1.0) / steps
    return _threshold_counts(df, keys, r, steps).groupBy(*keys).agg(
        F.max("n_genes").alias("n_genes"), F.sum(weight * F.col("n_at") / F.col("n_genes")).alias("auc"))


def sign_accuracy(df: DataFrame, keys: Sequence[str], r: str = "r", *, steps: int = 20) -> DataFrame:
    """P(r > 0 given |r| >= t), null where no gene reaches t."""
    return _threshold_counts(df, keys, r, steps).select(
        *keys, "threshold", "n_at", F.try_divide("pos_at", F.nullif("n_at", F.lit(0))).alias("accuracy"))


# ---- p-value summaries ---------------------------------------------------------------------

def pvalue_histogram(df: DataFrame, keys: Sequence[str], p: str = "pvalue", *, bins: int = 20) -> DataFrame:
    """Counts in equal bins of [0, 1], the last one closed; empty bins stay."""
    slot = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    counted = df.filter(F.col(p).isNotNull()).groupBy(*keys, slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = counted.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counted, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def significant_share(df: DataFrame, keys: Sequence[str], p: str = "pvalue", *, alpha: float = 0.05) -> DataFrame:
    """Evaluation significance is inclusive: p <= alpha."""
    return df.groupBy(*keys).agg(
        F.count(p).alias("n_tested"), F.count_if(F.col(p) <= alpha).alias("n_significant"),
        F.try_divide(F.count_if(F.col(p) <= alpha), F.nullif(F.count(p), F.lit(0))).alias("fraction_significant"))


def knot_curvatures(count: int, step: float) -> np.ndarray:
    """Second derivatives at evenly spaced knots of the cardinal natural cubic splines, one spline per column.

    Continuity of the slope gives c[k-1] + 4 c[k] + c[k+1] = 6 (f[k-1] - 2 f[k] + f[k+1]) / step^2 inside, zero at the ends;
    the three bands are eliminated from top to bottom.
    """
    values = np.eye(count)
    right = 6.0 * (values[:-2] - 2.0 * values[1:-1] + values[2:]) / step ** 2
    pivot = np.full(count - 2, 4.0)
    for row in range(1, count - 2):
        pivot[row] -= 1.0 / pivot[row - 1]
        right[row] -= right[row - 1] / pivot[row - 1]
    curvature = np.zeros((count, count))
    for row in range(count - 3, -1, -1):
        curvature[row + 1] = (right[row] - curvature[row + 2]) / pivot[row]
    return curvature


@lru_cache(maxsize=8)
def smoother_weights(df: float = SMOOTH_DF) -> tuple[float, ...]:
    """Weights with which the smoothing spline of ``df`` degrees of freedom takes its last value from the grid's values.

    Curvature is linear between knots, so the bending energy of a spline is a sum over intervals of
    step/3 (a^2 + a b + b^2). The penalty is found by Newton's rule on the trace, in its logarithm.
    """
    count, step = len(PI0_LAMBDAS), PI0_LAMBDAS[1] - PI0_LAMBDAS[0]
    bend = knot_curvatures(count, step)
    start, stop = bend[:-1], bend[1:]
    energy = step / 3.0 * (start.T @ start + stop.T @ stop + 0.5 * (start.T @ stop + stop.T @ start))
    log_penalty = np.log(count / np.trace(energy))
    for _ in range(100):
        penalty = np.exp(log_penalty)
        fitted = np.linalg.inv(np.eye(count) + penalty * energy)
        slope = -penalty * np.trace(fitted @ energy @ fitted)
        move = float(np.clip((np.trace(fitted) - df) / slope, -2.0, 2.0))
        log_penalty -= move
        if abs(move) < 1e-13:
            break
    return tuple(float(v) for v in np.linalg.solve(np.eye(count) + np.exp(log_penalty) * energy, np.eye(count)[-1]))


def null_fraction(df: DataFrame, keys: Sequence[str], p: str = "pvalue", *, method: str = "bootstrap",
                  smooth_df: float = SMOOTH_DF) -> DataFrame:
    """pi0 with m1 = (1 - pi0) n; boundary estimates are kept and flagged."""
    keys = list(keys)
    value = F.when((F.col(p) < 0) | (F.col(p) > 1), F.raise_error(F.lit("p outside [0, 1]")).cast("double")).otherwise(F.col(p))
    counted = df.filter(F.col(p).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_tested"),
        F.array(*[F.count_if(value >= F.lit(t)).cast("double") for t in PI0_LAMBDAS]).alias("w"))
    grid = F.array(*[F.lit(t) for t in PI0_LAMBDAS])
    m = F.col("n_tested").cast("double")
    curve = counted.withColumn("curve", F.zip_with("w", grid, lambda w, t: w / (m * (1.0 - t))))
    if method == "smoother":
        weights = F.array(*[F.lit(v) for v in smoother_weights(smooth_df)])
        raw = F.aggregate(F.zip_with("curve", weights, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    elif method == "bootstrap":
        curve = curve.withColumn("sorted", F.array_sort("curve"))
        pos = 0.1 * (len(PI0_LAMBDAS) - 1)
        lo = int(pos)
        reference = F.col("sorted")[lo] + (F.col("sorted")[lo + 1] - F.col("sorted")[lo]) * (pos - lo)
        curve = curve.withColumn("reference", reference)
        score = F.zip_with("w", F.arrays_zip("curve", grid.alias("t")), lambda w, c: (
            w / (m * m * (1.0 - c["t"]) * (1.0 - c["t"])) * (1.0 - w / m)
            + (c["curve"] - F.col("reference")) * (c["curve"] - F.col("reference"))))
        curve = curve.withColumn("score", score).withColumn("best", F.array_min("score"))
        raw = F.array_min(F.filter(F.zip_with("curve", "score", lambda c, s: F.when(s == F.col("best"), c)),
                                   lambda v: v.isNotNull()))
    else:
        raise ValueError(f"unknown method {method!r}")
    pi0 = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    return curve.withColumn("pi0", pi0).select(
        *keys, "n_tested", "pi0", ((1.0 - F.col("pi0")) * m).alias("m1"),
        ((F.col("pi0") <= 0) | (F.col("pi0") >= 1)).alias("boundary"))


# ---- seeds ---------------------------------------------------------------------------------

def seed_summary(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], *, seed: str = "seed") -> DataFrame:
    """Mean and sample SD over seeds (0 for one seed), with the sorted seed list."""
    aggs = [F.array_join(F.sort_array(F.collect_set(F.col(seed).cast("string"))), ",").alias("seeds")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"),
                 F.coalesce(F.stddev_samp(m), F.when(F.count(m) == 1, 0.0)).alias(f"{m}_sd")]
    return df.groupBy(*keys).agg(*aggs)


# ---- equal-count curves --------------------------------------------------------------------

def equal_count_curve(df: DataFrame, keys: Sequence[str], x: str, y: str, k: int, *, tie: Sequence[str],
                      limit: int | None = None) -> DataFrame:
    """Mean y in k equal-count bins of x; null when rows are too few or x is constant."""
    keys = list(keys)
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    binned = equal_count_bins(rows, keys, [x, *tie], k, limit=limit)
    per_bin = binned.groupBy(*keys, "bin").agg(
        F.avg(y).alias("mean_y"), F.max("n_valid").alias("n_valid"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    ends = per_bin.groupBy(*keys).agg((F.max("hi") - F.min("lo")).alias("spread"))
    joined = per_bin.join(ends, keys) if keys else per_bin.withColumn("spread", ends.scalar())
    usable = (F.col("n_valid") >= k) & (F.col("spread") > EPS)
    grid = joined.groupBy(*keys).agg(F.max("n_valid").alias("n_valid")).select(
        *keys, "n_valid", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("bin"))
    return grid.join(joined.select(*keys, "bin", F.when(usable, F.col("mean_y")).alias("mean_y")),
                     [*keys, "bin"], "left")


def transformed(x: Column, how: str) -> Column:
    """Space in which errors are taken: ``none`` or ``log1p`` (null at or below -1)."""
    if how == "none":
        return x
    if how == "log1p":
        return X.safe_log1p(x)
    raise ValueError(f"unknown error transform {how!r}")


def within_gene_curve(df: DataFrame, keys: Sequence[str], prediction: str, truth: str, uncertainty: str, k: int, *,
                      min_n: int = 3, tie: Sequence[str] = ("donor",), transform: str = "none",
                      limit: int | None = None) -> DataFrame:
    """Relative squared error by within-gene uncertainty bin, averaged over usable genes."""
    keys = list(keys)
    error = transformed(F.col(prediction), transform) - transformed(F.col(truth), transform)
    rows = df.select(*keys, "gene", *tie, F.col(uncertainty).alias("u"), (error * error).alias("e")).filter(
        (F.col("u") >= 0) & F.col("e").isNotNull())
    binned = equal_count_bins(rows, [*keys, "gene"], ["u", *tie], k, limit=limit)
    per_bin = binned.groupBy(*keys, "gene", "bin").agg(
        F.avg("e").alias("bin_error"), F.sum("e").alias("total"), F.count("e").alias("n"),
        F.min("u").alias("lo"), F.max("u").alias("hi"))
    bins = F.array_agg(F.struct("bin", "bin_error"))
    per_gene = per_bin.groupBy(*keys, "gene").agg(
        F.try_divide(F.sum("total"), F.sum("n")).alias("mean_error"), F.sum("n").alias("n"),
        (F.max("hi") - F.min("lo")).alias("spread"), bins.alias("bins"))
    usable = per_gene.filter((F.col("n") >= max(min_n, k)) & (F.col("spread") > EPS) & (F.col("mean_error") > EPS))
    relative = usable.select(*keys, "gene", "mean_error", F.inline("bins"))
    return relative.groupBy(*keys, "bin").agg(
        F.avg(F.col("bin_error") / F.col("mean_error")).alias("relative_error"),
        F.count(F.lit(1)).alias("n_genes"))


def error_uncertainty_rho(df: DataFrame, keys: Sequence[str], prediction: str, truth: str, uncertainty: str, *,
                          min_n: int = 3, transform: str = "none", limit: int | None = None) -> DataFrame:
    """Spearman of squared error against uncertainty per group, defined groups only."""
    error = transformed(F.col(prediction), transform) - transformed(F.col(truth), transform)
    rows = df.select(*keys, (error * error).alias("e"), F.when(F.col(uncertainty) >= 0, F.col(uncertainty)).alias("u"))
    return spearman(rows, keys, "e", "u", min_n=min_n, limit=limit).filter("rho is not null")


def rho_summary(rhos: DataFrame, keys: Sequence[str], *, limit: int | None = None) -> DataFrame:
    base = rhos.groupBy(*keys).agg(F.avg("rho").alias("rho_mean"), F.avg((F.col("rho") > 0).cast("double")).alias("frac_positive"))
    return base.join(quantiles(rhos, keys, "rho", {"rho_median": 0.5}, limit=limit), list(keys))


def calibration(df: DataFrame, keys: Sequence[str], prediction: str, truth: str, uncertainty: str, k: int, *,
                tie: Sequence[str], limit: int | None = None) -> DataFrame:
    """ENCE over equal-count uncertainty bins, means, RMSE and error-uncertainty Spearman."""
    keys = list(keys)
    e = F.col(prediction) - F.col(truth)
    rows = df.select(*keys, *tie, F.col(uncertainty).alias("u"), (e * e).alias("e")).filter(
        F.col("u").isNotNull() & F.col("e").isNotNull())
    rows = reusable(rows)
    binned = equal_count_bins(rows, keys, ["u", *tie], k, limit=limit)
    per_bin = binned.groupBy(*keys, "bin").agg(
        F.avg("u").alias("bu"), F.avg("e").alias("be"), F.sum("u").alias("su"), F.sum("e").alias("se"),
        F.count("u").alias("n"))
    root = F.sqrt(F.greatest("bu", F.lit(1e-12)))
    off = F.abs(root - F.sqrt(F.greatest("be", F.lit(0.0)))) / F.greatest(root, F.lit(1e-12))
    out = per_bin.groupBy(*keys).agg(
        F.sum("n").alias("n_pairs"), (F.sum("su") / F.sum("n")).alias("mean_uncertainty"),
        (F.sum("se") / F.sum("n")).alias("mean_squared_error"), F.sqrt(F.sum("se") / F.sum("n")).alias("rmse"),
        F.when(F.sum("n") >= k, F.avg(off)).alias("ence"))
    rho = spearman(rows, keys, "e", "u", limit=limit).drop("n")
    return out.join(rho, keys, "left") if keys else out.withColumn("rho", rho.select("rho").scalar())


def box_stats(df: DataFrame, keys: Sequence[str], value: str, *, limit: int | None = None) -> DataFrame:
    """Quartiles and whiskers at the extremes within 1.5 IQR."""
    keys = list(keys)
    q = quantiles(df, keys, value, {"q1": 0.25, "med": 0.5, "q3": 0.75}, limit=limit)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, value).join(q, keys)
    iqr = F.col("q3") - F.col("q1")
    inside = (F.col(value) >= F.col("q1") - 1.5 * iqr) & (F.col(value) <= F.col("q3") + 1.5 * iqr)
    kept = F.when(inside, F.col(value))
    return rows.groupBy(*keys).agg(
        F.max("q1").alias("q1"), F.max("med").alias("med"), F.max("q3").alias("q3"),
        F.coalesce(F.min(kept), F.min(value)).alias("whislo"), F.coalesce(F.max(kept), F.max(value)).alias("whishi"))


def difficulty(df: DataFrame, keys: Sequence[str], prediction: str, truth: str, uncertainty: str, *,
               min_n: int = 3) -> DataFrame:
    """Per gene: mean uncertainty and 1 - |r| over complete non-negative triples."""
    ok = F.col(prediction).isNotNull() & F.col(truth).isNotNull() & (F.col(uncertainty) >= 0)
    rows = df.filter(ok)
    u = rows.groupBy(*keys, "gene").agg(F.avg(uncertainty).alias("mean_uncertainty"))
    r = pearson(rows, [*keys, "gene"], prediction, truth, min_n=min_n)
    return r.join(u, [*keys, "gene"]).withColumn("difficulty", 1.0 - F.abs("r"))


# ---- dropping uncertain donors -------------------------------------------------------------

def ablation(df: DataFrame, keys: Sequence[str], prediction: str, truth: str, uncertainty: str,
             percents: Sequence[float], *, tie: Sequence[str] = ("donor",), min_n: int = 3, steps: int = 100,
             limit: int | None = None) -> DataFrame:
    """Survival AUC after dropping each gene's most uncertain donors, for a grid of shares.

    Rows are ranked once; every share is a conditional moment of the same pass.
    """
    keys = list(keys)
    rows = df.filter(F.col(prediction).isNotNull() & F.col(truth).isNotNull() & (F.col(uncertainty) >= 0)).select(
        *keys, "gene", *tie, F.col(prediction).alias("x"), F.col(truth).alias("y"), F.col(uncertainty).alias("u"))
    ranked = row_numbers(rows, [*keys, "gene"], ["u", *tie], rn="rn", total="nv", limit=limit)
    parts = []
    for p in percents:
        keep = F.col("rn") <= F.col("nv") - F.floor(F.col("nv") * F.lit(p / 100.0))
        x, y = F.when(keep, F.col("x")), F.when(keep, F.col("y"))
        parts.append(F.struct(F.lit(float(p)).alias("percent_removed"), F.count(x).alias("n"),
                              F.covar_pop(x, y).alias("c"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy")))
    moments = ranked.groupBy(*keys, "gene").agg(F.array(*parts).alias("parts")).select(*keys, "gene", F.inline("parts"))
    scored = moments.withColumn("r", _pearson_from(F.col("n"), F.col("c"), F.col("vx"), F.col("vy"), min_n))
    scored = reusable(scored.filter("r is not null").select(*keys, "percent_removed", "n", "r"))
    group = [*keys, "percent_removed"]
    size = scored.groupBy(*group).agg(F.avg("n").alias("mean_n_individuals"))
    return survival_auc(scored, group, steps=steps).join(size, group)


def ablation_change(table: DataFrame, keys: Sequence[str], *, over: str = "cell_type") -> DataFrame:
    """AUC at the largest removed share minus AUC at none, summarised over cell types."""
    per = table.groupBy(*keys, over).agg(
        (F.max_by("auc", "percent_removed")
         - F.max(F.when(F.col("percent_removed") == 0, F.col("auc")))).alias("change"))
    return per.groupBy(*keys).agg(F.avg("change").alias("mean_change"), F.min("change").alias("min_change"),
                                  F.max("change").alias("max_change"), F.count("change").alias("n"))


# ---- quantile positions --------------------------------------------------------------------

def empirical_quantiles(df: DataFrame, keys: Sequence[str], value: str, *, limit: int | None = None) -> DataFrame:
    """Mid-rank quantile of every value within its group; 0.5 when the group has one value."""
    ranked = average_ranks(df, keys, value, out="__r", n="__n", limit=limit)
    q = F.when(F.col("__n") == 1, 0.5).otherwise(F.try_divide(F.col("__r") - 1, F.col("__n") - 1))
    return ranked.withColumn("quantile", F.when(F.col(value).isNotNull(), q)).select(*df.columns, "quantile")


def qq_points(df: DataFrame, keys: Sequence[str], p: str, *, tie: Sequence[str], limit: int | None = None) -> DataFrame:
    """Expected against observed -log10 p, observed capped."""
    ranked = row_numbers(df.filter(F.col(p).isNotNull()), keys, [p, *tie], rn="__i", total="__n", limit=limit)
    return ranked.withColumns({"expected": -F.log10((F.col("__i") - 0.5) / F.col("__n")),
                               "observed": X.neglog10(F.col(p))}).select(*df.columns, "expected", "observed")


def matched_quantiles(df: DataFrame, keys: Sequence[str], arm: str, arms: tuple[str, str], value: str,
                      points: int, *, limit: int | None = None) -> DataFrame:
    """Two samples at the same probabilities (i - 0.5) / points."""
    probs = {f"q{i}": (i + 0.5) / points for i in range(points)}
    q = quantiles(df.filter(F.col(arm).isin(*arms)), [*keys, arm], value, probs, limit=limit)
    long = q.select(*keys, arm, F.posexplode(F.array(*probs)).alias("index", "value"))
    return long.groupBy(*keys, "index").agg(
        F.max(F.when(F.col(arm) == arms[0], F.col("value"))).alias("x"),
        F.max(F.when(F.col(arm) == arms[1], F.col("value"))).alias("y"))


def share_above(matched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of matched quantiles above y = x."""
    return matched.groupBy(*keys).agg(F.avg((F.col("y") > F.col("x")).cast("double")).alias("share_above"))


def extreme_genes(scores: DataFrame, keys: Sequence[str], n: int, *, r: str = "r", gene: str = "gene") -> DataFrame:
    """n // 2 worst and the remaining best genes by r squared, never the same gene twice.

    Both ends are per-group top-k, which Spark trims before the shuffle.
    """
    keys = list(keys)
    rows = scores.filter(F.col(r).isNotNull()).select(*keys, gene, (F.col(r) * F.col(r)).alias("r2"))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    take = F.least(F.lit(n), F.col("size"))
    n_worst = F.when(take == 1, 0).otherwise(F.floor(take / 2))
    worst = top_k(rows, keys, [F.col("r2").asc(), F.col(gene).asc()], n // 2 or 1, rn="place").join(sizes, keys)
    best = top_k(rows, keys, [F.col("r2").desc(), F.col(gene).desc()], n, rn="place").join(sizes, keys)
    return (worst.filter(F.col("place") <= n_worst).withColumn("end", F.lit("worst"))
            .unionByName(best.filter(F.col("place") <= take - n_worst).withColumn("end", F.lit("best")))
            .select(*keys, gene, "r2", "end", "place"))


# ---- ensembles, variance calibration and losses ---------------------------------------------

def ensemble_moments(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, aleatoric, epistemic and total variance over members."""
    spread = F.greatest(F.avg(F.col("mean") * F.col("mean")) - F.avg("mean") * F.avg("mean"), F.lit(0.0))
    return members.groupBy(*keys).agg(
        F.avg("mean").alias("prediction"), F.avg("variance").alias("aleatoric"), spread.alias("epistemic"),
        F.count(F.lit(1)).alias("n_members")).withColumn("total", F.col("aleatoric") + F.col("epistemic"))


def total_variance(weights: DataFrame, keys: Sequence[str], *, member: str = "member", value: str = "weight") -> DataFrame:
    """Law of total variance over (member, bootstrap) weights, inclusion share and sign stability.

    Within-member variance is averaged, between-member variance is that of member means.
    """
    v = F.col(value)
    per = weights.groupBy(*keys, member).agg(
        F.avg(v).alias("m"), F.var_pop(v).alias("s"), F.count(v).alias("n"),
        F.count_if(v != 0).alias("nz"), F.count_if(v > 0).alias("pos"), F.count_if(v < 0).alias("neg"))
    out = per.groupBy(*keys).agg(
        F.avg("m").alias("mean"), F.avg("s").alias("within"), F.var_pop("m").alias("between"),
        F.try_divide(F.sum("nz"), F.sum("n")).alias("pip"),
        F.coalesce(F.try_divide(F.abs(F.sum("pos") - F.sum("neg")), F.nullif(F.sum("nz"), F.lit(0))),
                   F.lit(0.0)).alias("sign_stability"))
    return out.withColumn("total", F.col("within") + F.col("between"))


def variance_scale(df: DataFrame, keys: Sequence[str], y: str, mean: str, variance: str, *, floor: float = 1e-8) -> DataFrame:
    """Multiplier that makes the average standardised squared error one."""
    e = F.col(y) - F.col(mean)
    ratio = F.avg(e * e / F.greatest(F.col(variance), F.lit(floor)))
    return df.groupBy(*keys).agg(F.greatest(ratio, F.lit(floor)).alias("alpha"))


def variance_agreement(df: DataFrame, keys: Sequence[str], predicted: str, empirical: str) -> DataFrame:
    """Predicted against empirical variance: r, ratio of means, R squared, RMSE and NRMSE of the SDs."""
    ok = (F.col(predicted) >= 0) & (F.col(empirical) >= 0)
    p, e = F.col(predicted), F.col(empirical)
    d, ds = p - e, F.sqrt(F.greatest(p, F.lit(0.0))) - F.sqrt(F.greatest(e, F.lit(0.0)))
    m = df.filter(ok).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop(p, e).alias("c"), F.var_pop(p).alias("vp"), F.var_pop(e).alias("ve"),
        F.avg(p).alias("mp"), F.avg(e).alias("me"), F.avg(d * d).alias("mse"), F.sqrt(F.avg(ds * ds)).alias("std_rmse"),
        F.avg(F.sqrt(F.greatest(e, F.lit(0.0)))).alias("mean_sd"))
    return m.select(
        *keys, "n", _pearson_from(F.col("n"), F.col("c"), F.col("vp"), F.col("ve"), 2).alias("r"),
        F.try_divide("mp", F.nullif("me", F.lit(0.0))).alias("variance_ratio"),
        (1.0 - F.try_divide("mse", F.nullif("ve", F.lit(0.0)))).alias("r2"), "std_rmse",
        F.try_divide("std_rmse", F.nullif("mean_sd", F.lit(0.0))).alias("std_nrmse"))


def variance_report(df: DataFrame, predicted: str, empirical: str, scale: float, *, by: str = "cell_type") -> DataFrame:
    """Macro and pooled r, and magnitude metrics of the calibrated and the unscaled variance, as metric rows."""
    rows = reusable(df.select(by, F.col(predicted).alias("p"), F.col(empirical).alias("e"), (F.col(predicted) / scale).alias("u")))
    macro = pearson(rows, [by], "p", "e", min_n=2).agg(F.avg("r").alias("pearson_macro"))
    wide = macro.withColumn("pearson_pooled", pearson(rows, [], "p", "e", min_n=2).select("r").scalar())
    for prefix, column in (("", "p"), ("uncalibrated_", "u")):
        m = variance_agreement(rows, [], column, "e")
        wide = wide.withColumns({f"{prefix}{c}": m.select(c).scalar() for c in ("variance_ratio", "r2", "std_rmse", "std_nrmse")})
    return wide.unpivot([], wide.columns, "metric", "value")


def correlation_losses(df: DataFrame, prediction: str, truth: str) -> DataFrame:
    """Mutual-correlation and centred-cosine losses: across genes within cell types plus the reverse.

    A constant side has no correlation and cosine 0.
    """
    parts = [pearson(df, [key], prediction, truth, min_n=2).agg(
        F.avg("r").alias("r"), F.avg(F.coalesce("r", F.lit(0.0))).alias("c")) for key in ("cell_type", "gene")]
    a, b = parts
    both = a.withColumns({"r2": b.select("r").scalar(), "c2": b.select("c").scalar()})
    return both.select((-(F.col("r") + F.col("r2"))).alias("mutual_correlation_loss"),
                       (2.0 - F.col("c") - F.col("c2")).alias("cosine_loss"))


def head_metrics(df: DataFrame, keys: Sequence[str], *, limit_abs: float = 1e3) -> DataFrame:
    """Distribution match of (mean, aleatoric, epistemic) predictions, total and per source.

    ``df(mu, aleatoric, epistemic, y, y_aleatoric, y_epistemic)`` with variances.
    Squared Wasserstein distance splits into its mean and SD parts. A group with
    a prediction beyond ``limit_abs`` or not finite has diverged: its metrics are null.
    """
    def sd(*cs: str) -> Column:
        return F.sqrt(sum((F.greatest(F.col(c), F.lit(0.0)) for c in cs[1:]), F.greatest(F.col(cs[0]), F.lit(0.0))))

    mu, y = F.col("mu"), F.col("y")
    sides = {"": (sd("aleatoric", "epistemic"), sd("y_aleatoric", "y_epistemic")),
             "aleatoric_": (sd("aleatoric"), sd("y_aleatoric")), "epistemic_": (sd("epistemic"), sd("y_epistemic"))}
    bad = X.finite(mu).isNull() | X.finite(sides[""][0]).isNull() | (F.abs(mu) > limit_abs) | (sides[""][0] > limit_abs)
    aggs = [F.count(y).alias("n"), F.coalesce(F.bool_or(bad), F.lit(False)).alias("diverged"), F.avg((mu - y) * (mu - y)).alias("mean_w2"),
            X.safe_corr(mu, y).alias("r"), (1.0 - F.try_divide(F.avg((mu - y) * (mu - y)), F.nullif(F.var_pop(y), F.lit(0.0)))).alias("r2")]
    for prefix, (p, t) in sides.items():
        mean_t = F.avg(t)
        aggs += [F.avg((p - t) * (p - t)).alias(f"{prefix}std_w2" if not prefix else f"{prefix}w2"), X.safe_corr(p, t).alias(f"{prefix}std_corr"),
                 F.try_divide(F.avg(p), F.when(mean_t > 1e-12, mean_t)).alias(f"{prefix}std_ratio"),
                 F.avg(p).alias(f"{prefix}pred_std"), mean_t.alias(f"{prefix}target_std")]
    out = df.groupBy(*keys).agg(*aggs).withColumn("w2", F.col("mean_w2") + F.col("std_w2"))
    usable = ~F.col("diverged") & (F.col("n") > 1)
    kept = {*keys, "n", "diverged", *[c for c in out.columns if c.endswith("target_std")]}
    return out.withColumns({c: F.when(usable, F.col(c)) for c in out.columns if c not in kept})


def losses(df: DataFrame, keys: Sequence[str], mean: str, truth: str, *, variance: str | None = None,
           eps: float = 1e-8) -> DataFrame:
    """MSE, Poisson NLL of a positive rate, Gaussian NLL, Pearson and cosine similarity."""
    m, y = F.col(mean), F.col(truth)
    df = df.filter(m.isNotNull() & y.isNotNull())
    rate = F.greatest(m, F.lit(eps))
    aggs = [F.avg((m - y) * (m - y)).alias("mse"), F.avg(rate - y * F.ln(rate)).alias("poisson_nll"),
            X.safe_corr(m, y).alias("pearson"),
            F.try_divide(F.sum(m * y), F.nullif(F.sqrt(F.sum(m * m)) * F.sqrt(F.sum(y * y)), F.lit(0.0))).alias("cosine")]
    if variance:
        v = F.greatest(F.col(variance), F.lit(eps))
        aggs.append(F.avg(0.5 * (F.ln(v) + (m - y) * (m - y) / v)).alias("gaussian_nll"))
    return df.groupBy(*keys).agg(*aggs)


def centred_cosine(df: DataFrame, keys: Sequence[str], mean: str, truth: str) -> DataFrame:
    """Cosine of values centred by group mean, from combinable moments."""
    both = F.col(mean).isNotNull() & F.col(truth).isNotNull()
    x, y = F.when(both, F.col(mean)), F.when(both, F.col(truth))
    return df.groupBy(*keys).agg(X.safe_corr(x, y).alias("centred_cosine"))


def fit_diagnostics(fits: DataFrame, keys: Sequence[str], *, limit: int | None = None) -> DataFrame:
    """Fit quality per cell type: ``fits(r, r2, r_train, r2_train, pvalue, n_nonzero, sd_true, sd_predicted)``.

    R2 is the fit's own, which falls below zero where a fit is worse than the mean. ``sd_corr`` is the correlation across
    genes of the true and the predicted spread over donors.
    """
    rows = fits.withColumn("gap", F.col("r_train") - F.col("r"))
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_genes"), F.avg("r").alias("mean_r"), F.avg("r2").alias("mean_r2"),
        F.avg("r2_train").alias("mean_r2_train"), F.avg("n_nonzero").alias("mean_nonzero"), F.avg("gap").alias("mean_gap"),
        F.avg("pvalue").alias("mean_pvalue"), F.count_if(F.col("pvalue") < 0.05).alias("n_significant"),
        F.stddev_pop("r").alias("sd_r"), X.safe_corr(F.col("sd_true"), F.col("sd_predicted")).alias("sd_corr"))
    mids = medians(rows, keys, {"median_r": "r", "median_r2": "r2", "median_nonzero": "n_nonzero", "median_pvalue": "pvalue"}, limit=limit)
    return base.join(mids, list(keys))


def weighted_fit_quality(df: DataFrame, keys: Sequence[str], *, sigma_floor: float) -> DataFrame:
    """Effective sample size, floored share, whitened MSE and Gaussian NLL: ``df(error, sigma)``."""
    df = df.filter(F.col("error").isNotNull() & F.col("sigma").isNotNull())
    s = F.greatest(F.col("sigma"), F.lit(sigma_floor))
    w = 1.0 / (s * s)
    e2 = F.col("error") * F.col("error")
    return df.groupBy(*keys).agg(
        (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("effective_n"),
        F.avg((F.col("sigma") < sigma_floor).cast("double")).alias("floored_fraction"),
        F.avg(e2 * w).alias("whitened_mse"),
        F.avg(0.5 * (F.ln(2.0 * 3.141592653589793 * s * s) + e2 * w)).alias("gaussian_nll"))


def ranked_fits(fits: DataFrame, keys: Sequence[str], *, r: str = "r", tie: str = "gene",
                limit: int | None = None) -> DataFrame:
    """Ascending by r with rank 1..n."""
    return row_numbers(fits.filter(F.col(r).isNotNull()), keys, [r, tie], rn="rank", limit=limit)


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int) -> DataFrame:
    """Equal-width counts over each group's observed range, the last bin closed."""
    keys = list(keys)
    ends = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    rows = df.filter(F.col(value).isNotNull()).select(*keys, value).join(ends, keys)
    width = F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    slot = F.coalesce(F.least(F.floor((F.col(value) - F.col("lo")) * bins / width), F.lit(bins - 1)), F.lit(0))
    return rows.groupBy(*keys, slot.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def binned_boxes(df: DataFrame, keys: Sequence[str], prediction: str, truth: str, uncertainty: str, k: int, *,
                 tie: Sequence[str], limit: int | None = None) -> DataFrame:
    """Box summary of squared error in equal-count uncertainty bins."""
    e = F.col(prediction) - F.col(truth)
    rows = df.select(*keys, *tie, F.col(uncertainty).alias("u"), (e * e).alias("e")).filter(
        F.col("u").isNotNull() & F.col("e").isNotNull())
    binned = equal_count_bins(rows, keys, ["u", *tie], k, limit=limit).filter(F.col("n_valid") >= k)
    return box_stats(reusable(binned), [*keys, "bin"], "e", limit=limit)

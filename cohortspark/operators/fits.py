"""Per-gene sparse linear models.

A SNP is one row with its donors' dosages as an array, so neither SNP x donor
rows nor SNP pairs are ever shuffled. Screening is a matrix product of such rows,
part by part of a gene, with all its targets and cell types at once. A gene's
solver works on the array rows of its screened SNPs directly, one copy for all cell
types and members: at most ``screen_to`` rows of each cell type and phase,
whatever the window holds. See ``packed`` for designs that genes share.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import exprs as X
from ..functions.ordered import row_numbers, top_k
from ..functions.storage import reusable
from .evaluation import spearman
from .genotype import allele_frequencies
from .intervals import window_join

# Penalty mix, folds, path length and ratio, ridge grid, pruning limits, inclusion mask.
L1_RATIO, CV_FOLDS, N_ALPHAS, PATH_RATIO = 0.5, 3, 15, 1e-3
RIDGE_ALPHAS = np.logspace(-6, 6, 15)
PRUNE_VARIANCE, PRUNE_R2 = 1e-8, 0.1
PIP_MASK = 0.5
TEST = -1
#: Rows that pruning takes at a time.
PRUNE_TILE = 512
#: Parts, by hash of the SNP, in which a gene's window is screened.
SCREEN_PARTS = 32

FIT_SCHEMA = ("cell_type string, gene string, target string, snps array<string>, coefs array<double>, "
              "x_mean array<double>, x_scale array<double>, intercept double, y_mean double, y_scale double, "
              "alpha double, n_train long, n_test long, heldout_r2 double, heldout_r double, "
              "insample_r2 double, insample_r double, heldout_snps array<string>, heldout_weights array<double>, "
              "heldout_offset double, status string")


def design_rows(genes: DataFrame, variants: DataFrame, genotypes: DataFrame, *, window: int,
                min_maf: float = 0.0) -> DataFrame:
    """(gene, snp, bp, donor, x): variants of each cis window, common ones, missing calls at the mean."""
    stats = allele_frequencies(genotypes).filter(F.col("maf") >= min_maf)
    inside = window_join(genes.select("gene", "chrom", "tss"), variants.select("chrom", "snp", "bp"), window=window)
    kept = inside.select("gene", "snp", "bp").join(stats.select("snp", (F.col("frequency") * 2).alias("mean")), "snp")
    return kept.join(genotypes, "snp").select("gene", "snp", "bp", "donor",
                                              F.coalesce(F.col("dosage").cast("double"), "mean").alias("x"))


def donor_places(donors: DataFrame, *, limit: int | None = None) -> DataFrame:
    """(donor, slot): place of each donor in the arrays of SNPs and targets."""
    placed = row_numbers(donors.select("donor").distinct(), [], ["donor"], rn="slot", limit=limit)
    return reusable(placed.select("donor", (F.col("slot") - 1).cast("int").alias("slot")))


def _gathered(*columns: str) -> list[Column]:
    """Arrays of the columns in the order of the donors' slots."""
    rows = F.array_sort(F.collect_list(F.struct("slot", *columns)))
    return [F.transform(rows, lambda r: r[c]).alias(name) for c, name in (("slot", "slots"), *((c, f"{c}s") for c in columns))]


def design_arrays(genes: DataFrame, variants: DataFrame, genotypes: DataFrame, slots: DataFrame, *, window: int,
                  min_maf: float = 0.0) -> DataFrame:
    """(gene, snp, bp, slots, xs): each SNP is gathered once, then its row goes to the genes whose window holds it."""
    stats = allele_frequencies(genotypes).filter(F.col("maf") >= min_maf).select("snp", (F.col("frequency") * 2).alias("mean"))
    x = F.coalesce(F.col("dosage").cast("double"), "mean").alias("x")
    rows = genotypes.join(stats, "snp").join(slots, "donor").select("snp", "slot", x).groupBy("snp").agg(*_gathered("x"))
    inside = window_join(genes.select("gene", "chrom", "tss"), variants.select("chrom", "snp", "bp"), window=window)
    return inside.select("gene", "snp", "bp").join(rows, "snp").select("gene", "snp", "bp", "slots", "xs")


def as_arrays(design: DataFrame, slots: DataFrame) -> DataFrame:
    """Array rows as they are; rows (gene, snp, bp, donor, x) gathered per SNP."""
    if "xs" in design.columns:
        return design
    return design.join(slots, "donor").groupBy("gene", "snp", "bp").agg(*_gathered("x"))


def as_rows(design: DataFrame, slots: DataFrame) -> DataFrame:
    """(gene, snp, bp, donor, x) of array rows."""
    if "xs" not in design.columns:
        return design
    z = F.explode(F.arrays_zip("slots", "xs")).alias("z")
    return design.select("gene", "snp", "bp", z).select("gene", "snp", "bp", F.col("z.slots").alias("slot"), F.col("z.xs").alias("x")).join(
        slots, "slot").select("gene", "snp", "bp", "donor", "x")


# ---- solvers -------------------------------------------------------------------------------

def elastic_net(x: np.ndarray, y: np.ndarray, alpha: float, l1: float, start: np.ndarray | None = None, *,
                max_iter: int = 10_000, tol: float = 1e-9) -> np.ndarray:
    """Weights of the rows of ``x`` (centred, one per SNP) for 1/(2n)|y-wx|^2 + alpha(l1|w|_1 + (1-l1)/2|w|^2).

    Coordinate descent on the rows that can be non-zero; one product with all rows then finds those whose condition
    is broken, until there are none.
    """
    k, n = x.shape
    w = np.zeros(k) if start is None else start.copy()
    square = np.einsum("ij,ij->i", x, x)
    ridge, lasso = n * alpha * (1 - l1), n * alpha * l1
    slope = x @ y
    scale = max(np.abs(slope).max(initial=0.0), 1e-300)
    rest = y - w @ x
    usable = square > 1e-12
    active = np.flatnonzero((w != 0) | (usable & (np.abs(x @ rest - ridge * w) > lasso)))
    for _ in range(max_iter):
        for _ in range(max_iter):
            largest = 0.0
            for j in active:
                rho = x[j] @ rest + square[j] * w[j]
                new = np.sign(rho) * max(abs(rho) - lasso, 0.0) / (square[j] + ridge)
                if new != w[j]:
                    rest -= (new - w[j]) * x[j]
                    largest = max(largest, abs(new - w[j]) * square[j])
                    w[j] = new
            if largest <= tol * scale:
                break
        else:
            raise ArithmeticError(f"no convergence in {max_iter} sweeps")
        broken = np.flatnonzero(usable & (w == 0) & (np.abs(x @ rest) > lasso * (1 + 1e-9) + tol * scale))
        more = np.setdiff1d(broken, active)
        if not len(more):
            return w
        active = np.union1d(active, more)
    raise ArithmeticError(f"no convergence in {max_iter} rounds")


def _path(slope: np.ndarray, n: float, l1: float, count: int) -> np.ndarray:
    top = np.abs(slope).max(initial=0.0) / (n * l1)
    return np.geomspace(top, top * PATH_RATIO, count) if top > 0 else np.array([1e-12])


def ridge(x: np.ndarray, y: np.ndarray, alpha: float) -> np.ndarray:
    """Weights for |y-wx|^2 + alpha|w|^2, solved on the shorter side of ``x``."""
    k, n = x.shape
    if k <= n:
        return np.linalg.solve(x @ x.T + alpha * np.eye(k), x @ y)
    return x @ np.linalg.solve(x.T @ x + alpha * np.eye(n), y)


def prune(x: np.ndarray, *, tile: int = PRUNE_TILE) -> np.ndarray:
    """Rows kept by greedy pruning in order: enough variance, r squared below the limit to all kept.

    Tile by tile: one product drops what is too close to a row kept earlier, one more settles the tile in itself.
    """
    centred = x - x.mean(axis=1, keepdims=True)
    spread = (centred ** 2).mean(axis=1)
    usable = np.flatnonzero(spread > PRUNE_VARIANCE)
    unit = centred[usable] / np.sqrt(spread[usable] * x.shape[1])[:, None]
    kept = np.zeros(0, np.int64)
    for lo in range(0, len(usable), tile):
        rows = np.arange(lo, min(lo + tile, len(usable)))
        for at in range(0, len(kept), tile):
            rows = rows[((unit[rows] @ unit[kept[at:at + tile]].T) ** 2 < PRUNE_R2).all(axis=1)]
        free = (unit[rows] @ unit[rows].T) ** 2 < PRUNE_R2
        alive = np.ones(len(rows), bool)
        for i in range(len(rows)):
            if alive[i]:
                alive[i + 1:] &= free[i, i + 1:]
        kept = np.concatenate([kept, rows[alive]])
    return usable[kept]


def scaling(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sd = x.std(axis=1)
    return x.mean(axis=1), np.where(sd > 1e-12, sd, 1.0)


def quality(truth: np.ndarray, guess: np.ndarray) -> tuple[float, float]:
    """R squared and r of a prediction; null where the truth or both do not vary."""
    total = ((truth - truth.mean()) ** 2).sum()
    r2 = 1 - ((truth - guess) ** 2).sum() / total if total > 1e-12 else np.nan
    spread = total * ((guess - guess.mean()) ** 2).sum()
    r = ((truth - truth.mean()) * (guess - guess.mean())).sum() / np.sqrt(spread) if spread > 1e-18 else np.nan
    return float(r2), float(r)


def _solve(x: np.ndarray, y: np.ndarray, fold: np.ndarray, model: str, l1: float, alpha: float | None, n_alphas: int):
    """Standardised coefficients, scaling of SNPs and target, and the penalty chosen over the folds."""
    mean, scale = scaling(x)
    z, my, sd = (x - mean[:, None]) / scale[:, None], y.mean(), y.std()
    sy = sd if sd > 1e-12 else 1.0

    def weights(rows: np.ndarray, target: np.ndarray, value: float, start=None) -> np.ndarray:
        return ridge(rows, target, value) if model == "ridge" else elastic_net(rows, target, value, l1, start)

    target = (y - my) / sy
    if alpha is None:
        grid = RIDGE_ALPHAS if model == "ridge" else _path(z @ target, len(y), l1, n_alphas)
        loss = np.zeros(len(grid))
        for part in np.unique(fold):
            out = fold == part
            if out.all():
                continue
            rows, centre = z[:, ~out], z[:, ~out].mean(axis=1, keepdims=True)
            shift, w = target[~out].mean(), None
            for a, value in enumerate(grid):
                w = weights(rows - centre, target[~out] - shift, value, w)
                loss[a] += np.mean((target[out] - shift - w @ (z[:, out] - centre)) ** 2)
        alpha = float(grid[int(np.argmin(loss))])
    return weights(z, target, alpha), mean, scale, my, sy, alpha


def _dense(slots, values, width: int) -> np.ndarray:
    out = np.full((len(slots), width), np.nan)
    for row, at, xs in zip(out, slots, values):
        row[np.asarray(at, dtype=int)] = xs
    return out


def _matrix(snps: pd.DataFrame, used: np.ndarray) -> np.ndarray:
    """Dosages of each SNP for the donors in use; a donor that a SNP lacks has its mean."""
    width = int(max(used.max(initial=0), max((max(s) if len(s) else 0) for s in snps["slots"]))) + 1
    x = _dense(snps["slots"], snps["xs"], width)[:, used]
    gaps = np.isnan(x)
    if gaps.any():
        x = np.where(gaps, np.nan_to_num(np.nanmean(np.where(gaps.all(axis=1, keepdims=True), 0.0, x), axis=1))[:, None], x)
    return x


def _marginal(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """|covariance with the target| / SD of each row; 0 without spread."""
    p = np.full(x.shape[1], 1 / x.shape[1]) if weight is None else weight / weight.sum()
    centred = x - (x @ p)[:, None]
    sd = np.sqrt(np.maximum(centred ** 2 @ p, 0))
    covariance = np.abs(centred @ (p * (y - p @ y)))
    return np.where(sd > 1e-12, covariance / np.where(sd > 1e-12, sd, 1.0), 0.0)


def _screen_function(names: Sequence[str]):
    def screen(snps: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(snps):
            for _, row in targets.iterrows():
                slots, fold = np.asarray(row["slots"], dtype=int), np.asarray(row["folds"])
                x = _matrix(snps, slots)
                for phase, part in (("heldout", fold != TEST), ("kept", np.ones(len(fold), bool))):
                    if part.any():
                        scores = [_marginal(x[:, part], np.asarray(row[f"{n}s"], float)[part]) for n in names]
                        out.append(pd.DataFrame({"phase": phase, "cell_type": row["cell_type"], "gene": row["gene"], "snp": snps["snp"],
                                                 "bp": snps["bp"], "score": np.max(scores, axis=0)}))
        columns = ["phase", "cell_type", "gene", "snp", "bp", "score"]
        return pd.concat(out, ignore_index=True)[columns] if out else pd.DataFrame(columns=columns)

    return screen


def _phases(fold: np.ndarray) -> list[tuple[str, np.ndarray]]:
    """Name and training donors of the held-out fit, if any donor is held out, and of the kept one."""
    test = fold == TEST
    held = [("heldout", ~test)] if test.any() and not test.all() else []
    return [*held, ("kept", np.ones(len(fold), bool))]


def _fit_targets(source, names: Sequence[str], design, model: str, l1: float, alpha: float | None, n_alphas: int) -> list[dict]:
    """Rows of FIT_SCHEMA for the targets of one cell type. ``design(phase)`` gives the labels and dosages of its SNPs."""
    fold = np.asarray(source["folds"])
    test, rows = fold == TEST, []
    for name in names:
        row = {"cell_type": str(source["cell_type"]), "gene": str(source["gene"]), "target": name, "status": "ok"}
        y = np.asarray(source[f"{name}s"], float)
        try:
            held_alpha = alpha
            for phase, train in _phases(fold):
                features, x = design(phase)
                if model == "ridge":
                    keep = prune(x[:, train])
                    x, features = x[keep], features[keep]
                w, mean, scale, my, sy, held_alpha = _solve(x[:, train], y[train], fold[train], model, l1, held_alpha, n_alphas)
                raw = w * sy / scale
                offset = float(my - raw @ mean)
                if phase == "heldout" or not test.any():
                    r2, r = quality(y[train], offset + raw @ x[:, train])
                    row.update(insample_r2=r2, insample_r=r, n_train=int(train.sum()), n_test=int(test.sum()))
                if phase == "heldout":
                    r2, r = quality(y[test], offset + raw @ x[:, test])
                    row.update(heldout_r2=r2, heldout_r=r, heldout_snps=features.tolist(), heldout_weights=raw.tolist(), heldout_offset=offset)
                else:
                    row.update(snps=features.tolist(), coefs=w.tolist(), x_mean=mean.tolist(), x_scale=scale.tolist(),
                               intercept=0.0, y_mean=float(my), y_scale=float(sy), alpha=held_alpha)
        except Exception as error:  # noqa: BLE001 - a failed gene must stay visible
            row["status"] = f"{type(error).__name__}: {error}"[:200]
        rows.append(row)
    return rows


def _fit_frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in FIT_SCHEMA.split(", ")])
    for c in ("n_train", "n_test"):
        out[c] = out[c].astype("Int64")
    for c in ("snps", "coefs", "x_mean", "x_scale", "heldout_snps", "heldout_weights"):
        out[c] = [v if isinstance(v, list) else None for v in out[c]]
    return out


def _fit_function(targets: Sequence[str], model: str, l1: float, alpha: float | None, n_alphas: int):
    """All cell types of a gene over one copy of its SNPs; ``uses`` says which cell types and phases took a SNP."""
    names = list(targets)

    def fit(snps: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        if not len(given) or not len(snps):
            return _fit_frame([])
        snps = snps.sort_values(["bp", "snp"], ignore_index=True)
        labels, rows = snps["snp"].astype(str).to_numpy(), []
        uses = [set(u) for u in snps["uses"]]
        for _, source in given.iterrows():
            slots, own = np.asarray(source["slots"], dtype=int), {}
            for phase in ("heldout", "kept"):
                own[phase] = np.array([f"{phase}/{source['cell_type']}" in u for u in uses], bool)
            either = own["heldout"] | own["kept"]
            if not either.any():
                continue
            every, held = _matrix(snps[either], slots), {p: m[either] for p, m in own.items()}
            rows += _fit_targets(source, names, lambda p: (labels[either][held[p]], every[held[p]]), model, l1, alpha, n_alphas)
        return _fit_frame(rows)

    return fit


def fold_targets(targets: DataFrame, names: Sequence[str], *, cv: int = CV_FOLDS, seed: int = 42, test_fraction: float = 0.2,
                 min_train: int = 3, min_test: int = 2, limit: int | None = None) -> DataFrame:
    """Usable targets with their fold: -1 is held out, 0..cv-1 are cross-validation parts.

    Genes with too few donors hold none out.
    """
    usable = targets.filter(X.all_of([F.col(n).isNotNull() for n in names])).select(
        F.col("cell_type").cast("string").alias("cell_type"), "gene", "donor", *names)
    hashed = usable.withColumn("__h", X.shuffle_order(seed, F.col("gene"), F.col("donor")))
    ranked = row_numbers(hashed, ["cell_type", "gene"], ["__h", "donor"], rn="rn", total="n", limit=limit)
    n = F.col("n")
    n_test = F.when(n >= min_train + min_test, F.greatest(F.lit(min_test), F.least(
        F.bround(n * test_fraction).cast("bigint"), n - min_train))).otherwise(0)
    return ranked.withColumn("fold", F.when(F.col("rn") <= n_test, TEST).otherwise(F.col("rn") % cv)).drop("__h", "rn", "n")


def fit_genes(design: DataFrame, targets: DataFrame, names: Sequence[str] = ("y",), *, model: str = "elasticnet",
              l1_ratio: float = L1_RATIO, alpha: float | None = None, cv: int = CV_FOLDS, n_alphas: int = N_ALPHAS,
              screen_to: int = 5000, seed: int = 42, test_fraction: float = 0.2, min_train: int = 3, min_test: int = 2,
              slots: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """One row per (cell type, gene, target): coefficients, penalty, held-out and in-sample quality.

    ``design(gene, snp, bp, slots, xs)`` of :func:`design_arrays` with its ``slots``, or rows ``(gene, snp, bp, donor, x)``,
    is shared by all cell types; ``targets(cell_type, gene, donor, *names)``. SNPs are screened on training
    donors for the held-out score and on all donors for the kept fit.
    """
    if model not in ("elasticnet", "ridge"):
        raise ValueError(f"unknown model {model!r}")
    names = list(names)
    folded = reusable(fold_targets(targets, names, cv=cv, seed=seed, test_fraction=test_fraction, min_train=min_train,
                                   min_test=min_test, limit=limit))
    slots = slots if slots is not None else donor_places(folded.select("donor"), limit=limit)
    arrays = as_arrays(design, slots)
    values = folded.join(slots, "donor").select("cell_type", "gene", "slot", "fold", *[F.col(n).cast("double").alias(n) for n in names])
    wanted = reusable(values.groupBy("cell_type", "gene").agg(*_gathered("fold", *names)))
    part = F.pmod(F.xxhash64("snp"), F.lit(SCREEN_PARTS)).cast("int")
    parts = F.explode(F.sequence(F.lit(0), F.lit(SCREEN_PARTS - 1))).alias("part")
    kinds = dict(arrays.dtypes) | {"cell_type": "string"}
    scored = arrays.withColumn("part", part).groupBy("gene", "part").cogroup(wanted.select("*", parts).groupBy("gene", "part")).applyInPandas(
        _screen_function(names), f"phase string, cell_type string, gene {kinds['gene']}, snp {kinds['snp']}, bp {kinds['bp']}, score double")
    best = top_k(scored, ["phase", "cell_type", "gene"], [F.col("score").desc(), F.col("snp")], screen_to)
    chosen = best.groupBy("gene", "snp").agg(F.collect_set(F.concat_ws("/", "phase", "cell_type")).alias("uses"))
    return arrays.join(chosen, ["gene", "snp"]).groupBy("gene").cogroup(wanted.groupBy("gene")).applyInPandas(
        _fit_function(names, model, l1_ratio, alpha, n_alphas), FIT_SCHEMA)


def raw_weights(fits: DataFrame) -> DataFrame:
    """(cell_type, gene, target, snp, weight) on raw dosages, non-zero ones only."""
    z = F.arrays_zip("snps", "coefs", "x_scale")
    rows = fits.filter("status = 'ok'").select("cell_type", "gene", "target", "y_scale", F.explode(z).alias("z"))
    return rows.select("cell_type", "gene", "target", F.col("z.snps").alias("snp"),
                       (F.col("z.coefs") * F.col("y_scale") / F.col("z.x_scale")).alias("weight")).filter("weight <> 0")


def raw_intercepts(fits: DataFrame) -> DataFrame:
    z = F.arrays_zip("coefs", "x_mean", "x_scale")
    shift = F.aggregate(z, F.lit(0.0), lambda acc, v: acc + v["coefs"] * v["x_mean"] / v["x_scale"])
    return fits.filter("status = 'ok'").select(
        "cell_type", "gene", "target",
        (F.col("y_mean") + F.col("y_scale") * (F.col("intercept") - shift)).alias("intercept"))


def _linear(weights: DataFrame, offsets: DataFrame, design: DataFrame) -> DataFrame:
    """(cell_type, gene, target, donor, prediction); a gene without weights predicts its offset."""
    x = design.select(F.col("gene").cast("string").alias("gene"), F.col("snp").cast("string").alias("snp"), "donor", "x")
    summed = weights.join(x, ["gene", "snp"]).groupBy("cell_type", "gene", "target", "donor").agg(
        F.sum(F.col("weight") * F.col("x")).alias("s"))
    every = offsets.join(x.select("gene", "donor").distinct(), "gene")
    return every.join(summed, ["cell_type", "gene", "target", "donor"], "left").select(
        "cell_type", "gene", "target", "donor", (F.col("offset") + F.coalesce("s", F.lit(0.0))).alias("prediction"))


def predict(fits: DataFrame, design: DataFrame) -> DataFrame:
    """Predictions of the kept fits on raw dosages."""
    return _linear(raw_weights(fits), raw_intercepts(fits).withColumnRenamed("intercept", "offset"), design)


def predict_heads(fits: DataFrame, design: DataFrame, *, mean: str = "mean",
                  log_variances: Sequence[str] = ("aleatoric", "epistemic")) -> DataFrame:
    """One row per donor with the mean and the variance heads, undone from log1p and kept non-negative."""
    long = predict(fits, design)

    def of(target: str) -> Column:
        return F.max(F.when(F.col("target") == target, F.col("prediction")))

    return long.groupBy("cell_type", "gene", "donor").agg(
        of(mean).alias("mu"), *[F.greatest(F.expm1(of(v)), F.lit(0.0)).alias(v) for v in log_variances])


def rank_quality(fits: DataFrame, design: DataFrame, folded: DataFrame, names: Sequence[str], *,
                 limit: int | None = None) -> DataFrame:
    """Held-out and in-sample Spearman of the held-out fits, from donor-level predictions."""
    ok = fits.filter("heldout_offset is not null")
    z = F.explode(F.arrays_zip("heldout_snps", "heldout_weights")).alias("z")
    weights = ok.select("cell_type", "gene", "target", z).select(
        "cell_type", "gene", "target", F.col("z.heldout_snps").alias("snp"), F.col("z.heldout_weights").alias("weight")).filter("weight <> 0")
    offsets = ok.select("cell_type", "gene", "target", F.col("heldout_offset").alias("offset"))
    truth = folded.select("cell_type", F.col("gene").cast("string").alias("gene"), "donor",
                          F.when(F.col("fold") == TEST, "heldout").otherwise("insample").alias("part"),
                          *[F.col(n).cast("double").alias(n) for n in names]).unpivot(
        ["cell_type", "gene", "donor", "part"], list(names), "target", "truth")
    pairs = reusable(_linear(weights, offsets, design).join(truth, ["cell_type", "gene", "target", "donor"]))
    rho = spearman(pairs, ["cell_type", "gene", "target", "part"], "prediction", "truth", min_n=2, limit=limit)
    return rho.groupBy("cell_type", "gene", "target").agg(
        F.max(F.when(F.col("part") == "heldout", F.col("rho"))).alias("heldout_rho"),
        F.max(F.when(F.col("part") == "insample", F.col("rho"))).alias("insample_rho"))


# ---- bootstrapped member ensembles -----------------------------------------------------------

def multiplicities(donors: DataFrame, genes: DataFrame, n_bootstraps: int, *, seed: int = 42,
                   limit: int | None = None) -> DataFrame:
    """Multinomial donor counts per (gene, bootstrap), shared by all members.

    Each donor slot makes one reproducible pick among all donors, so counts sum to n exactly.
    ``donors(gene, donor)`` are the usable donors of each gene.
    """
    slots = row_numbers(donors.join(genes.select("gene").distinct(), "gene", "left_semi"), ["gene"], ["donor"],
                        rn="place", total="n", limit=limit)
    slots = reusable(slots)
    drawn = slots.select("gene", "n", "place", F.explode(F.sequence(F.lit(0), F.lit(n_bootstraps - 1))).alias("bootstrap"))
    pick = F.pmod(X.shuffle_order(seed, F.col("gene"), F.col("bootstrap"), F.col("place")), F.col("n")) + 1
    counted = drawn.groupBy("gene", "bootstrap", pick.alias("place")).agg(F.count(F.lit(1)).alias("multiplicity"))
    return counted.join(slots.select("gene", "place", "donor"), ["gene", "place"]).select(
        "gene", "bootstrap", "donor", "multiplicity")


def _member_screen(snps: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
    columns = ["gene", "snp", "score"]
    if not len(snps) or not len(members):
        return pd.DataFrame(columns=columns)
    scores = []
    for _, row in members.iterrows():
        slots = np.asarray(row["slots"], dtype=int)
        scores.append(_marginal(_matrix(snps, slots), np.asarray(row["means"], float), np.asarray(row["ws"], float)))
    return pd.DataFrame({"gene": members["gene"].iloc[0], "snp": snps["snp"], "score": np.max(scores, axis=0)})[columns]


def _bootstrap_function(l1: float):
    """All members of a gene over one copy of its SNPs."""
    def fit(snps: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        out = []
        snps = snps.sort_values(["bp", "snp"], ignore_index=True)
        for _, source in (given if len(snps) else given[:0]).iterrows():
            x = _matrix(snps, np.asarray(source["slots"], dtype=int))
            y, w = np.asarray(source["means"], float), np.asarray(source["ws"], float)
            counts = np.stack([np.asarray(c, float) for c in source["countss"]], axis=1)
            mean, scale = scaling(x)
            z = (x - mean[:, None]) / scale[:, None]
            start = None
            for number, count in enumerate(counts):
                share = w * count / (w * count).sum()
                root = np.sqrt(share * len(y))
                centre, middle = z @ share, share @ y
                start = elastic_net((z - centre[:, None]) * root, (y - middle) * root, float(source["alpha"]), l1, start)
                raw = start / scale
                out.append(pd.DataFrame({"gene": str(source["gene"]), "member": str(source["member"]), "bootstrap": number,
                                         "snp": snps["snp"].astype(str), "weight": raw, "intercept": middle - raw @ (mean + centre * scale)}))
        columns = ["gene", "member", "bootstrap", "snp", "weight", "intercept"]
        return pd.concat(out, ignore_index=True)[columns] if out else pd.DataFrame(columns=columns)

    return fit


def bootstrap_fits(design: DataFrame, members: DataFrame, alphas: DataFrame, *, n_bootstraps: int = 5,
                   sigma_floor: float = 1e-3, l1_ratio: float = L1_RATIO, screen_to: int = 5000, seed: int = 42,
                   slots: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(gene, member, bootstrap, snp, weight, intercept) on raw dosages.

    ``members(gene, member, donor, mean, sigma)``; donors without every member
    are left out; rows weigh 1 / max(sigma, floor)^2 times the bootstrap count.
    ``alphas(gene, alpha)`` is one shared penalty per gene. Designs as for :func:`fit_genes`.
    """
    n_members = members.groupBy("gene").agg(F.count_distinct("member").alias("n_members"))
    complete = (members.filter("mean is not null and sigma >= 0").groupBy("gene", "donor")
                .agg(F.count_distinct("member").alias("c")).join(n_members, "gene").filter("c = n_members")
                .select("gene", "donor"))
    precision = 1.0 / F.pow(F.greatest("sigma", F.lit(sigma_floor)), 2)
    rows = reusable(members.join(complete, ["gene", "donor"]).select("gene", "member", "donor", F.col("mean").cast("double").alias("mean"),
                                                                  precision.alias("w")))
    donors = rows.select("gene", "donor").distinct()
    drawn = multiplicities(donors, donors, n_bootstraps, seed=seed, limit=limit).groupBy("gene", "donor").agg(
        F.map_from_entries(F.collect_list(F.struct("bootstrap", "multiplicity"))).alias("drawn"))
    numbers = F.sequence(F.lit(0), F.lit(n_bootstraps - 1))
    counts = F.transform(numbers, lambda b: F.coalesce(F.try_element_at("drawn", b), F.lit(0).cast("bigint"))).alias("counts")
    slots = slots if slots is not None else donor_places(donors.select("donor"), limit=limit)
    arrays = as_arrays(design, slots)
    weighted = rows.join(drawn, ["gene", "donor"], "left").join(slots, "donor").select("gene", "member", "slot", "mean", "w", counts)
    wanted = reusable(weighted.groupBy("gene", "member").agg(*_gathered("mean", "w", "counts")).join(alphas.select("gene", "alpha"), "gene"))
    part = F.pmod(F.xxhash64("snp"), F.lit(SCREEN_PARTS)).cast("int")
    parts = F.explode(F.sequence(F.lit(0), F.lit(SCREEN_PARTS - 1))).alias("part")
    kinds = dict(arrays.dtypes)
    scored = arrays.withColumn("part", part).groupBy("gene", "part").cogroup(
        wanted.select("gene", "slots", "means", "ws", parts).groupBy("gene", "part")).applyInPandas(
        _member_screen, f"gene {kinds['gene']}, snp {kinds['snp']}, score double")
    best = top_k(scored, ["gene"], [F.col("score").desc(), F.col("snp")], screen_to).select("gene", "snp")
    return arrays.join(best, ["gene", "snp"]).groupBy("gene").cogroup(wanted.groupBy("gene")).applyInPandas(
        _bootstrap_function(l1_ratio), "gene string, member string, bootstrap int, snp string, weight double, intercept double")


def mask_by_inclusion(moments: DataFrame, *, threshold: float = PIP_MASK) -> DataFrame:
    """Ensemble weights kept only where enough fits include the SNP."""
    return moments.withColumn("weight", F.when(F.col("pip") >= threshold, F.col("mean")).otherwise(0.0))

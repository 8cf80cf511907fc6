import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import evaluation as V, fits as M, genotype as G, packed as PK


@pytest.fixture(scope="module")
def problem():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, size=(120, 6)).astype(float)
    x[:, 5] = x[:, 0]
    y = 1.5 * x[:, 1] - 0.8 * x[:, 3] + rng.normal(0, 0.5, 120) + 4
    return x, y


def _tables(spark, x, y):
    design = spark.createDataFrame([("g", f"s{j}", j * 10, i, float(x[i, j])) for i in range(len(y)) for j in range(x.shape[1])],
                                   "gene string, snp string, bp long, donor long, x double")
    target = spark.createDataFrame([("c", "g", i, float(v)) for i, v in enumerate(y)], "cell_type string, gene string, donor long, y double")
    return design, target


def test_elastic_net_meets_its_optimality_conditions(problem):
    x, y = problem
    xs = (x - x.mean(0)) / x.std(0)
    yc = y - y.mean()
    n, alpha, l1 = len(y), 0.05, 0.5
    w = M.elastic_net(xs.T, yc, alpha, l1)
    gradient = xs.T @ (yc - xs @ w) / n - alpha * (1 - l1) * w
    for g, c in zip(gradient, w):
        assert abs(g - alpha * l1 * np.sign(c)) < 1e-6 if c else abs(g) <= alpha * l1 + 1e-6


def test_distributed_fit_equals_local_fit(spark, problem):
    x, y = problem
    design, target = _tables(spark, x, y)
    fit = M.fit_genes(design, target, alpha=0.05).first()
    assert fit.status == "ok" and fit.n_train == 96 and fit.n_test == 24
    xs = (x - x.mean(0)) / x.std(0)
    ys = (y - y.mean()) / y.std()
    want = M.elastic_net(xs.T, ys, 0.05, 0.5)
    got = dict(zip(fit.snps, fit.coefs))
    pairs = [(0, 5)]
    for j in (1, 2, 3, 4):
        assert got[f"s{j}"] == pytest.approx(want[j], abs=1e-6)
    for a, b in pairs:
        assert got[f"s{a}"] + got[f"s{b}"] == pytest.approx(want[a] + want[b], abs=1e-6)
    assert fit.heldout_r2 > 0.5 and 0 < fit.heldout_r <= 1


def test_ridge_closed_form(spark, problem):
    x, y = problem
    x = x[:, 1:4]
    design, target = _tables(spark, x, y)
    fits = M.fit_genes(design, target, model="ridge", alpha=10.0)
    xs = (x - x.mean(0)) / x.std(0)
    ys = (y - y.mean()) / y.std()
    want = np.linalg.solve(xs.T @ xs + 10 * np.eye(3), xs.T @ ys)
    fit = fits.first()
    assert len(fit.snps) == 3 and np.allclose(fit.coefs, want, atol=1e-9)
    raw = {r.snp: r.weight for r in M.raw_weights(fits).collect()}
    base = M.raw_intercepts(fits).first().intercept
    local = sum(raw[f"s{j}"] * x[:, j] for j in range(3)) + base
    assert np.allclose(local, (xs @ want) * y.std() + y.mean())


def test_more_snps_than_donors(problem):
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 3, (400, 60)).astype(float), rng.normal(size=60)
    x -= x.mean(axis=1, keepdims=True)
    y -= y.mean()
    w = M.elastic_net(x, y, 0.1, 0.5)
    gradient = x @ (y - w @ x) / 60 - 0.05 * w
    assert all(abs(g - 0.05 * np.sign(c)) < 1e-6 if c else abs(g) <= 0.05 + 1e-6 for g, c in zip(gradient, w))
    assert np.allclose(M.ridge(x, y, 3.0), np.linalg.solve(x @ x.T + 3 * np.eye(400), x @ y), atol=1e-8)
    with pytest.raises(ArithmeticError, match="no convergence"):
        M.elastic_net(x, y, 1e-4, 0.5, max_iter=2)


def test_array_design_equals_rows(spark, problem):
    x, y = problem
    calls = spark.createDataFrame([(f"s{j}", i, int(x[i, j])) for i in range(len(y)) for j in range(6)], "snp string, donor long, dosage int")
    genes = spark.createDataFrame([("g", "1", 25), ("far", "1", 9000)], "gene string, chrom string, tss long")
    variants = spark.createDataFrame([("1", f"s{j}", j * 10) for j in range(6)], "chrom string, snp string, bp long")
    _, target = _tables(spark, x, y)
    slots = M.donor_places(calls)
    arrays = M.design_arrays(genes, variants, calls, slots, window=100)
    assert arrays.count() == 6 and {len(r.xs) for r in arrays.collect()} == {len(y)}
    rows = M.design_rows(genes, variants, calls, window=100)
    a, b = (M.fit_genes(d, target, alpha=0.05, slots=slots).first() for d in (arrays, rows))
    assert (a.snps, a.n_train) == (b.snps, b.n_train) and np.allclose(a.coefs, b.coefs, atol=1e-9)
    plan = M.fit_genes(arrays, target, alpha=0.05, slots=slots)._jdf.queryExecution().executedPlan().toString()
    assert "explode(slots" not in plan and "snp1" not in plan and "FlatMapCoGroupsInPandas" in plan


def test_small_tiles_and_chunks_change_nothing(spark, problem, rows):
    x, _ = problem
    long = [(f"s{j}", i, int(x[i, j])) for i in range(len(x)) for j in range(6)]
    g = spark.createDataFrame(long, "snp string, donor long, dosage int")
    where = spark.createDataFrame([("g", f"s{j}", j) for j in range(6)], "gene string, snp string, bp long")
    tables = [G.gene_covariance(where, g, **kw)[0].select("snp1", "snp2", F.round("value", 10)) for kw in ({}, {"tile": 2, "chunk": 17, "limit": 0})]
    assert rows(tables[0]) == rows(tables[1])
    want = np.cov(x.T)
    for a, b, v in rows(tables[0]):
        assert v == pytest.approx(want[int(a[1]), int(b[1])], abs=1e-9)


def test_pruning_keeps_first_of_a_pair(problem):
    x, y = problem
    kept = M.prune(x.T)
    assert 0 in kept and 5 not in kept


def test_too_few_donors_still_fit(spark, problem):
    x, y = problem
    design, target = _tables(spark, x[:4], y[:4])
    fit = M.fit_genes(design, target, alpha=0.01).first()
    assert fit.status == "ok" and fit.n_test == 0 and fit.heldout_r2 is None


def test_failed_gene_stays_visible(spark, problem):
    x, y = problem
    design, target = _tables(spark, x, y)
    broken = M.fit_genes(design, target, model="ridge", alpha=float("nan")).first()
    assert broken is not None and broken.gene == "g"


def test_bootstrap_counts_sum_to_n(spark):
    donors = spark.range(50).select(F.lit("g").alias("gene"), F.col("id").alias("donor"))
    for limit in (None, 0):
        got = M.multiplicities(donors, donors, 6, limit=limit).groupBy("bootstrap").agg(F.sum("multiplicity").alias("s")).collect()
        assert [r.s for r in got] == [50] * 6


def test_bootstrap_ensemble_finds_the_signal(spark, problem):
    x, y = problem
    design, _ = _tables(spark, x, y)
    members = spark.createDataFrame([("g", m, i, float(v + 0.1 * k), 0.5) for k, m in enumerate("ab") for i, v in enumerate(y)],
                                    "gene string, member string, donor long, mean double, sigma double")
    alphas = spark.createDataFrame([("g", 0.05)], "gene string, alpha double")
    fits = M.bootstrap_fits(design, members, alphas, n_bootstraps=4)
    assert fits.select("member", "bootstrap").distinct().count() == 8
    moments = {r.snp: r for r in M.mask_by_inclusion(V.total_variance(fits, ["gene", "snp"])).collect()}
    assert moments["s1"].pip == 1.0 and moments["s1"].weight > 1 and moments["s3"].weight < -0.4
    assert moments["s1"].sign_stability == 1.0


def test_scoring_rules(spark):
    w = spark.createDataFrame([("g", "s1", 2.0), ("g", "missing", 9.0)], "gene string, snp string, weight double")
    base = spark.createDataFrame([("g", 1.0), ("bare", 5.0)], "gene string, intercept double")
    calls = spark.createDataFrame([("s1", "d1", 2), ("s1", "d2", None)], "snp string, donor string, dosage int")
    got = {(r.gene, r.donor): r.value for r in G.score(w, base, calls).collect()}
    assert got == {("g", "d1"): 5.0, ("g", "d2"): 1.0, ("bare", "d1"): 5.0, ("bare", "d2"): 5.0}


def test_smoother_reproduces_lines():
    weights = np.array(V.smoother_weights())
    grid = np.array(V.PI0_LAMBDAS)
    assert weights @ (0.3 + 0.5 * grid) == pytest.approx(0.3 + 0.5 * 0.95, abs=1e-8)


def test_smoother_minimises_the_bent_energy():
    """The same weights from second differences on a fine grid between the knots."""
    n, fine = len(V.PI0_LAMBDAS), 8
    m, h = (n - 1) * fine + 1, 0.05 / fine
    second = np.diff(np.eye(m), 2, axis=0)
    energy, pick = second.T @ second / h ** 3, np.eye(m)[::fine]
    smooth = lambda penalty: pick @ np.linalg.solve(pick.T @ pick + penalty * energy, pick.T)
    low, high = -25.0, 0.0
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if np.trace(smooth(np.exp(middle))) > V.SMOOTH_DF else (low, middle)
    assert np.abs(smooth(np.exp(low))[-1] - V.smoother_weights()).max() < 1e-4


def test_uniform_weights_screen_like_none(spark, problem):
    x, y = problem
    design, target = _tables(spark, x, y)
    rows = design.join(target.drop("cell_type"), ["gene", "donor"]).withColumn("w", F.lit(3.0))
    plain = {r.snp: r.score for r in G.screen(rows, ["gene"], ["y"]).collect()}
    weighted = {r.snp: r.score for r in G.screen(rows, ["gene"], ["y"], weight="w").collect()}
    assert all(weighted[s] == pytest.approx(plain[s]) for s in plain)


def test_rank_quality_and_predictions(spark, problem):
    x, y = problem
    design, target = _tables(spark, x, y)
    fits = M.fit_genes(design, target, alpha=0.02)
    folded = M.fold_targets(target, ["y"])
    q = M.rank_quality(fits, design, folded, ["y"]).first()
    assert q.heldout_rho > 0.6 and q.insample_rho > 0.6
    got = {r.donor: r.prediction for r in M.predict(fits, design).collect()}
    fit = fits.first()
    raw = np.array(fit.coefs) * fit.y_scale / np.array(fit.x_scale)
    order = [int(s[1:]) for s in fit.snps]
    want = x[:, order] @ raw + fit.y_mean - raw @ np.array(fit.x_mean)
    assert np.allclose([got[i] for i in range(len(y))], want)


def test_rank_quality_matches_a_local_rank(spark, problem):
    x, y = problem
    design, target = _tables(spark, x, y)
    fits = M.fit_genes(design, target, alpha=0.02)
    fit = fits.first()
    held = [r.donor for r in M.fold_targets(target, ["y"]).filter("fold = -1").collect()]
    order = [int(s[1:]) for s in fit.heldout_snps]
    pred = x[np.ix_(held, order)] @ np.array(fit.heldout_weights) + fit.heldout_offset
    r2 = 1 - ((y[held] - pred) ** 2).sum() / ((y[held] - y[held].mean()) ** 2).sum()
    assert fit.heldout_r2 == pytest.approx(r2, abs=1e-9)
    assert fit.heldout_r == pytest.approx(np.corrcoef(pred, y[held])[0, 1], abs=1e-9)


def test_diverged_heads_have_no_metrics(spark):
    df = spark.createDataFrame([("g", 1e4, 1.0, 1.0, 1.0, 1.0, 1.0), ("h", 1.0, 1.0, 1.0, 2.0, 1.0, 1.0), ("h", 3.0, 1.0, 1.0, 3.0, 1.0, 1.0)],
                               "gene string, mu double, aleatoric double, epistemic double, y double, y_aleatoric double, y_epistemic double")
    got = {r.gene: r for r in V.head_metrics(df, ["gene"]).collect()}
    assert got["g"].diverged and got["g"].w2 is None
    assert not got["h"].diverged and got["h"].w2 == pytest.approx(0.5) and got["h"].std_corr is None


def _shared(spark, seed=11, n_donors=60, n_snps=90):
    """Genes with overlapping windows, two cell types with different donors, missing and absent calls, a monomorphic SNP."""
    r = np.random.default_rng(seed)
    calls = r.integers(0, 3, (n_snps, n_donors))
    calls[5] = 1
    held = r.random((n_snps, n_donors))
    rows = [(f"s{j}", i, None if held[j, i] < 0.05 else int(calls[j, i])) for j in range(n_snps) for i in range(n_donors) if held[j, i] < 0.97]
    genotypes = spark.createDataFrame(rows, "snp string, donor long, dosage int")
    variants = spark.createDataFrame([("1" if j < 70 else "2", f"s{j}", 100 * j) for j in range(n_snps)], "chrom string, snp string, bp long")
    genes = spark.createDataFrame([(f"g{k}", "1", 700 * k) for k in range(10)] + [("h", "2", 8000), ("far", "2", 900000)], "gene string, chrom string, tss long")
    targets = [(c, f"g{k}", i, float(calls[7 * k, i] - calls[7 * k + 3, i] + r.normal() / 4), float(calls[7 * k + 1, i] + r.normal() / 4))
               for k in range(10) for c, part in (("a", range(n_donors)), ("b", range(5, n_donors, 2))) for i in part]
    targets += [("a", "h", i, float(calls[80, i] + r.normal() / 4), float(r.normal())) for i in range(n_donors)]
    return genes, variants, genotypes, spark.createDataFrame(targets, "cell_type string, gene string, donor long, y double, y2 double")


def _comparable(fits):
    plain = lambda v: round(v, 7) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list) else v
    return sorted(tuple(plain(x) for x in r) for r in fits.collect())


@pytest.mark.parametrize("options", [{"alpha": 0.03}, {"model": "ridge", "alpha": 20.0, "screen_to": 7}, {"screen_to": 4}])
@pytest.mark.parametrize("genes_per_task", [2, 64])
def test_shared_designs_fit_alike(spark, options, genes_per_task):
    genes, variants, genotypes, targets = _shared(spark)
    slots = M.donor_places(genotypes)
    arrays = M.design_arrays(genes, variants, genotypes, slots, window=900, min_maf=0.05)
    packed = PK.design(genes, variants, genotypes, slots, window=900, min_maf=0.05)
    wanted = _comparable(M.fit_genes(arrays, targets, ("y", "y2"), slots=slots, **options))
    assert len(wanted) == 42 and _comparable(PK.fit_genes(packed, targets, ("y", "y2"), genes_per_task=genes_per_task, **options)) == wanted


def test_shared_designs_send_a_snp_to_two_regions_at_most(spark):
    genes, variants, genotypes, _ = _shared(spark)
    many = genes.unionByName(genes.withColumns({"gene": F.concat("gene", F.lit("x")), "tss": F.col("tss") + 30}))
    sent = []
    for table in (genes, many):
        made = PK.design(table, variants, genotypes, M.donor_places(genotypes), window=900)
        targets = table.select("gene")
        _, snps = PK._parts(made, targets, PK.GENES)
        sent.append({r.snp: r["count"] for r in snps.groupBy("snp").count().collect()})
    assert sent[0] == sent[1] and max(sent[0].values()) == 2
    with pytest.raises(Exception, match="whole numbers"):
        PK.design(genes, variants, genotypes.withColumn("dosage", F.lit(-1)), M.donor_places(genotypes), window=900).snps.collect()


@pytest.mark.parametrize("tile", [7, 512])
def test_pruning_by_tiles_is_the_plain_rule(tile):
    r = np.random.default_rng(2)
    base = r.normal(size=(400, 40))
    x = base[r.integers(0, 400, 5000)] + r.normal(size=(5000, 40)) * r.choice([0.0, 0.5, 2.0], (5000, 1))
    x[17] = 3.0
    unit = x - x.mean(1, keepdims=True)
    unit[unit.std(1) <= 1e-4] = np.nan
    unit /= np.sqrt((unit ** 2).sum(1, keepdims=True))
    kept = []
    for i in range(len(x) if tile > 7 else 600):
        if not np.isnan(unit[i, 0]) and (not kept or ((unit[kept] @ unit[i]) ** 2 < 0.1).all()):
            kept.append(i)
    assert M.prune(x[:len(x) if tile > 7 else 600], tile=tile).tolist() == kept and 10 < len(kept) < 400

"""Quadratic forms by gene blocks against plain sums; repeated weights; the plan."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import association as A


def tables(spark, seed=6, n_snps=9, draws=("d0", "d1", "d2")):
    r = np.random.default_rng(seed)
    weights, snps, cov, gwas = [], [], [], []
    for gene in ("g", "h"):
        x = r.normal(size=(30, n_snps))
        s = np.cov(x.T)
        for i in range(n_snps):
            snps.append((gene, f"{gene}{i}", float(np.sqrt(s[i, i])), "A", "C"))
            gwas.append((f"{gene}{i}", *(("A", "C") if i % 3 else ("C", "A")), float(r.normal()), float(r.normal()), 0.5))
            cov += [(gene, f"{gene}{i}", f"{gene}{j}", float(s[i, j])) for j in range(i, n_snps)]
        weights += [("c", "a", d, gene, f"{gene}{i}", float(r.normal())) for d in draws for i in range(n_snps) if r.random() < 0.7]
    return (spark.createDataFrame(weights, "cell_type string, arm string, draw string, gene string, snp string, weight double"),
            spark.createDataFrame(snps, "gene string, snp string, sd double, effect_allele string, non_effect_allele string"),
            spark.createDataFrame(cov, "gene string, snp1 string, snp2 string, value double"),
            spark.createDataFrame(gwas, "snp string, effect_allele string, non_effect_allele string, zscore double, beta double, pvalue double"))


def expected(weights, snps, cov, gwas):
    sd = {(r.gene, r.snp): r.sd for r in snps.collect()}
    z = {r.snp: r.zscore if r.effect_allele == "A" else -r.zscore for r in gwas.collect()}
    pairs = {(r.gene, r.snp1, r.snp2): r.value for r in cov.collect()}
    sums = {}
    for r in weights.collect():
        sums.setdefault((r.draw, r.gene), {}).setdefault(r.snp, 0.0)
        sums[r.draw, r.gene][r.snp] += r.weight
    out = {}
    for (draw, gene), w in sums.items():
        form = sum(w[a] * w[b] * pairs.get((gene, a, b), pairs.get((gene, b, a))) for a in w for b in w)
        out[draw, gene] = (form, sum(w[s] * z[s] * sd[gene, s] for s in w) / np.sqrt(form))
    return out


def got(found):
    return {(r.draw, r.gene): (r.var_g, r.zscore) for r in found.collect()}


@pytest.mark.parametrize("tile,draws", [(512, 2048), (2, 2), (4, 1)])
def test_blocks_and_tiles_give_the_plain_sums(spark, monkeypatch, tile, draws):
    monkeypatch.setattr(A, "DRAWS", draws)
    plain = A.quadratic_forms
    monkeypatch.setattr(A, "quadratic_forms", lambda w, c: plain(w, c, tile=tile))
    given = tables(spark)
    wanted, found = expected(*given), got(A.gene_association(*given))
    assert found.keys() == wanted.keys()
    for k, v in wanted.items():
        assert found[k] == pytest.approx(v, rel=1e-9)


def test_repeated_weights_add_up(spark):
    weights, *rest = tables(spark)
    twice = weights.unionByName(weights.filter("snp in ('g1', 'h2')"))
    wanted, found = expected(twice, *rest), got(A.gene_association(twice, *rest))
    for k, v in wanted.items():
        assert found[k] == pytest.approx(v, rel=1e-9)


def test_genes_without_covariance_drop_out(spark):
    weights, snps, cov, gwas = tables(spark)
    assert {g for _, g in got(A.gene_association(weights, snps, cov.filter("gene = 'g'"), gwas))} == {"g"}
    assert A.gene_association(weights.filter("false"), snps, cov, gwas).count() == 0


def test_covariance_rows_are_shuffled_once_by_gene(spark):
    weights, _, cov, _ = tables(spark)
    kept = weights.select("gene", "snp", F.lit(1).alias("k"), "weight")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = A.quadratic_forms(kept, cov)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    keys = re.findall(r"hashpartitioning\(([a-z0-9]+)#", plan)
    assert keys and set(keys) <= {"gene"} and "map_from_entries" not in plan

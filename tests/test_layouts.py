"""Layouts of files, model records, versions of covariances."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.sources import layouts as L, sinks as K, text as S, weights as M
from cohortspark.streaming import incremental as Z


def paths(spark, *rows):
    return spark.createDataFrame(list(rows), "root string, path string")


def faults(spark, *rows):
    return sorted((r.root, r.model, r.seed, r.kind, r.cell_type, r.fault) for r in L.prediction_faults(paths(spark, *rows)).collect())


def kinds(*cell_types, of=L.KINDS, below=""):
    return [f"{below}{k}/{c}.csv" for k in of for c in cell_types]


def test_layouts_on_disk(spark, tmp_path):
    for name in [*kinds("A cell", "B", below="one/s1/"), "two/A.csv", "three/m1/s1/A.csv", *kinds("A", below="three/m2/s1/"), "three/.old/s9/A.csv", "two/note.txt"]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x\n")
    def found(root):
        rows = L.discover_predictions(L.list_files(spark, str(tmp_path / root))).collect()
        return sorted((r.layout, r.model, r.seed, r.kind, r.cell_type.replace("%20", " ")) for r in rows)
    assert found("one") == sorted(("seeds", "one", "s1", k, c) for k in L.KINDS for c in ("A cell", "B"))
    assert found("one/s1") == sorted(("seed", "one", "s1", k, c) for k in L.KINDS for c in ("A cell", "B"))
    assert found("two") == [("seed", tmp_path.name, "two", "preds", "A")]
    assert found("three") == sorted([("models", "m1", "s1", "preds", "A")] + [("models", "m2", "s1", k, "A") for k in L.KINDS])


def test_layout_faults(spark):
    root = "/x/r"
    at = lambda *names: [(root, n) for n in names]
    assert faults(spark, *at("s1/A.csv", "s2/A.csv")) == []
    assert faults(spark, *at(*kinds("A", of=("preds", "totvar"), below="s1/"))) == [
        (root, "r", "s1", "aleatoric", None, "missing kind"), (root, "r", "s1", "epistemic", None, "missing kind")]
    assert faults(spark, *at("s2/A.csv", "s2/C.csv", "s10/A.csv", "s10/B.csv")) == [
        (root, "r", "s10", None, "B", "extra"), (root, "r", "s10", None, "C", "missing")]
    assert (root, "m", None, None, None, "mixed") in [f for f in L.prediction_faults(paths(spark, *at("m/s1/A.csv", *kinds("A", below="m/s2/")))).select(
        "root", "model", "seed", "kind", "cell_type", "fault").collect()]
    assert faults(spark, *at("notes.txt")) == [(root, None, None, None, None, "no predictions")]
    assert faults(spark, *at("m/s1/A.csv", "m/s2/log.txt")) == [(root, "m", "s2", None, None, "no predictions")]
    with pytest.raises(ValueError, match="fault=missing kind"):
        L.discover_predictions(paths(spark, *at(*kinds("A", of=("preds", "totvar")))))


def joins(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_faults_gather_no_paths_on_the_driver(spark):
    p = paths(spark, ("/x/r", "s1/A.csv"))
    assert "SortMergeJoin" in joins(L.prediction_faults(p)) and "Broadcast" not in joins(L.prediction_faults(p))


def test_tables_gather_no_paths_on_the_driver(spark):
    p = paths(spark, ("/x/r", "s1/A.csv"))
    assert "SortMergeJoin" in joins(L.prediction_tables(p)) and "Broadcast" not in joins(L.prediction_tables(p))


def test_headers_are_reconciled(spark):
    lines = spark.createDataFrame([("a", 0, "﻿gene,p"), ("a", 1, "g1,0.5"), ("a", 2, ""), ("b", 0, "p,note,gene"), ("b", 1, '0.1,"x, ""y""",g2\r'), ("b", 2, "bad,,g3")],
                                  "file string, ordinal int, value string")
    got = sorted(tuple(r) for r in L.reconciled(lines, {"gene": "string", "p": "double", "note": "string"}).collect())
    assert got == [("a", "g1", 0.5, None), ("b", "g2", 0.1, 'x, "y"'), ("b", "g3", None, None)]
    with pytest.raises(Exception, match="no column note in a"):
        L.reconciled(lines, {"gene": "string"}, required=["note"]).collect()


def test_results_are_selected_by_folded_name(spark, tmp_path):
    for cell_type, arm, text in (("T cell", "a", "gene,p\ng1,0.5\n"), ("B-cell", "a", "p,gene\n0.25,g2\n"), ("T cell", "b", "gene,p\ng3,1\n")):
        folder = tmp_path / cell_type / arm
        folder.mkdir(parents=True)
        (folder / "results.csv").write_text(text)
    columns = {"gene": "string", "p": "double"}
    read = lambda arm, **k: sorted((r.cell_type, r.gene, r.p) for r in L.read_results(spark, str(tmp_path), arm, columns, **k).collect())
    assert read("a") == [("B-cell", "g2", 0.25), ("T cell", "g1", 0.5)]
    assert read("a", cell_types=["b_CELL"]) == [("B-cell", "g2", 0.25)]
    with pytest.raises(ValueError, match="no .*/c/results"):
        read("c")
    with pytest.raises(Exception, match="no results for NK"):
        read("a", cell_types=["NK"])
    names = spark.createDataFrame([("T cell",), ("t_cell",)], "cell_type string")
    with pytest.raises(Exception, match="ambiguous: T-Cell"):
        L.select_labels(names, ["T-Cell"]).collect()


def test_sidecars_run_along(spark):
    features = spark.createDataFrame([("s", 0, 1.0), ("s", 1, 2.0), ("s", 2, 3.0)], "feature_set string, row bigint, x double")
    def side(field, *values):
        return spark.createDataFrame([("s", field, i, v) for i, v in enumerate(values)], "feature_set string, field string, row bigint, value string")
    genes = spark.createDataFrame([("ENSG2",), ("ENSG3.9",)], "gene string")
    whole = side("gene_ids", "ENSG1.1", "ENSG2.4", "ENSG3.1").unionByName(side("tss", "5", "6", "7"))
    got = sorted((r.row, r.place, r.gene, r.x, r.tss) for r in L.select_features(features, whole, genes).collect())
    assert got == [(1, 0, "ENSG2", 2.0, "6"), (2, 1, "ENSG3", 3.0, "7")]
    with pytest.raises(ValueError, match="field=tss, n_rows=2, n_features=3"):
        L.select_features(features, whole.filter("not (field = 'tss' and row = 2)"), genes)
    with pytest.raises(ValueError, match="field=tss"):
        L.select_features(features, whole.withColumn("row", F.when((F.col("field") == "tss") & (F.col("row") == 2), 5).otherwise(F.col("row"))), genes)
    with pytest.raises(ValueError, match="inconsistent"):
        L.select_features(features, side("tss", "5", "6", "7"), genes)


def test_probabilistic_records(spark):
    heads = spark.createDataFrame([('g"1', "07", h, i + 0.5) for i, h in enumerate(M.HEADS)], "gene string, chrom string, head string, intercept double")
    coefficients = spark.createDataFrame([('g"1', "mean", 2, "b", 1.5), ('g"1', "mean", 1, "a", -1.0), ('g"1', "mean", 3, "c", 0.0), ('g"1', "epistemic", 1, "a", 0.1)],
                                         "gene string, head string, place bigint, snp string, weight double")
    records = M.probabilistic_json(coefficients, heads)
    assert json.loads(records.first().value) == {'g"1': {
        "chr": 7, "mean": {"snp_ids": ["a", "b"], "coefs": [-1.0, 1.5], "intercept": 0.5},
        "aleatoric": {"snp_ids": [], "coefs": [], "intercept": 1.5, "log1p": True},
        "epistemic": {"snp_ids": ["a"], "coefs": [0.1], "intercept": 2.5, "log1p": True}}}
    assert sorted((r.snp, r.weight, r.standardized) for r in S.parse_weights(records.select("value")).collect()) == [("a", -1.0, True), ("b", 1.5, True)]
    with pytest.raises(Exception, match="a head is missing"):
        M.probabilistic_json(coefficients, heads.filter("head <> 'mean'")).collect()


def test_ensemble_records(spark):
    r = np.random.default_rng(4)
    samples = {f"m{m}": np.where(r.random((m + 2, 4)) < 0.4, 0.0, r.normal(size=(m + 2, 4))) for m in range(3)}
    samples["m1"][:, 3] = samples["m2"][:, 3] = samples["m0"][:, 3] = 0.0
    offsets = {m: r.normal(size=len(x)) for m, x in samples.items()}
    fits = spark.createDataFrame([("g", m, b, float(offsets[m][b])) for m, x in samples.items() for b in range(len(x))], "gene string, member string, bootstrap int, intercept double")
    rows = [("g", m, b, p, f"s{p}", float(x[b, p])) for m, x in samples.items() for b in range(len(x)) for p in range(4) if x[b, p]]
    coefficients = spark.createDataFrame(rows, "gene string, member string, bootstrap int, place bigint, snp string, weight double")
    record = json.loads(M.ensemble_json(fits, coefficients, spark.createDataFrame([("g", "X")], "gene string, chrom string")).first().value)["g"]
    assert record["chr"] == "X" and record["snp_ids"] == ["s0", "s1", "s2"]
    means, spreads = np.array([x.mean(0)[:3] for x in samples.values()]), np.array([x.var(0)[:3] for x in samples.values()])
    close = lambda name, wanted: np.testing.assert_allclose(record[name], wanted, atol=1e-12)
    close("coefs", means.mean(0))
    close("coef_within_variances", spreads.mean(0))
    close("coef_between_variances", means.var(0))
    close("coef_sds", np.sqrt(spreads.mean(0) + means.var(0)))
    every = np.concatenate(list(samples.values()))[:, :3]
    close("inclusion_probabilities", (every != 0).mean(0))
    close("sign_stabilities", np.abs(np.sign(every).sum(0)) / (every != 0).sum(0))
    close("intercept", np.mean([o.mean() for o in offsets.values()]))
    assert record["metadata"]["n_members"] == 3 and record["metadata"]["n_fits"] == 9
    for m, got in zip(sorted(samples), record["members"]):
        np.testing.assert_allclose(got["bootstrap_coefs"], samples[m][:, :3], atol=1e-12)
        np.testing.assert_allclose(got["coef_variances"], samples[m].var(0)[:3], atol=1e-12)
        np.testing.assert_allclose(got["bootstrap_intercepts"], offsets[m], atol=1e-12)


def test_failed_write_leaves_the_earlier_covariance_whole(spark, tmp_path):
    path = f"{tmp_path}/cov"
    with pytest.raises(ValueError, match="no finished covariance"):
        K.read_covariance(spark, path, "pairs")
    snps = spark.createDataFrame([("g", "s1"), ("g", "s2")], "gene string, snp string")
    pairs = snps.withColumn("value", F.lit(1.0))
    K.write_covariance(pairs, snps, path, reference="old")
    broken = snps.withColumn("snp", F.when(F.col("snp") == "s2", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("snp")))
    with pytest.raises(Exception, match="lost"):
        K.write_covariance(pairs.withColumn("value", F.lit(2.0)), broken, path, reference="new")
    read = lambda name: K.read_covariance(spark, path, name)
    assert {r.value for r in read("pairs").collect()} == {1.0} and read("snps").count() == 2 and read("meta").first().reference == "old"
    assert K.remove_old_versions(spark, path) == []
    old = read("meta").first().content_hash
    K.write_covariance(pairs.withColumn("value", F.lit(3.0)), snps, path, reference="new")
    assert {r.value for r in read("pairs").collect()} == {3.0} and read("meta").first().content_hash == old
    assert len(K.remove_old_versions(spark, path)) == 1 and {r.value for r in read("pairs").collect()} == {3.0}


@pytest.mark.parametrize("limit", [None, 0])
def test_ordered_hash(spark, limit):
    rows = [("g", 1, "a"), ("g", 2, "b"), ("h", 1, "c")]
    of = lambda r: Z.ordered_hash(spark.createDataFrame(r, "gene string, place int, snp string"), ["gene"], ["place"], ["snp"], limit=limit).first().content_hash
    assert of(rows) == of(rows[::-1]) != of([("g", 1, "b"), ("g", 2, "a"), ("h", 1, "c")])
    assert of(rows) != of([("g", 1, "a"), ("h", 2, "b"), ("h", 1, "c")])

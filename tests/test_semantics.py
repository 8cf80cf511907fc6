"""Hand-checked cases."""

import pytest
from pyspark.sql import functions as F

from cohortspark.operators import (association as A, comparison as C, evaluation as V, expression as E,
                                   genotype as G, intervals as I, pooling as P)


def test_bh_with_null_and_tie(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.02), (3, 0.02), (4, None), (5, 0.9)], "gene int, pvalue double")
    for limit in (None, 0):
        got = {r.gene: r for r in P.annotate_significance(df, [], fdr=0.2, limit=limit).collect()}
        assert [got[g].qvalue for g in (1, 2, 3)] == [pytest.approx(0.08 / 3)] * 3
        assert got[4].qvalue is None and got[5].qvalue == pytest.approx(0.9)
        assert got[1].bonferroni_threshold == 0.0125
        assert [got[g].significant_bonferroni for g in range(1, 6)] == [True, False, False, False, False]
        assert got[4].significant_fdr is False


def test_single_draw_has_no_spread(spark):
    df = spark.createDataFrame([("c", 0, "g", 5.0, 1e-6)], "cell_type string, draw int, gene string, zscore double, pvalue double")
    r = P.pool_draws(df, ["cell_type"]).first()
    assert r.n_draws == 1 and r.zscore_var is None and r.zscore_sd is None and r.zscore_ci_low is None
    assert r.zscore_min == r.zscore_max == 5.0 and r.pvalue == pytest.approx(1e-6)


def test_pooling_paths_agree(spark, rows):
    i = F.col("id")
    draws = spark.range(1200).select(
        F.when(i % 3 > 0, "hot").otherwise("cold").alias("cell_type"), (i % 5).alias("draw"), F.floor(i / 5).alias("gene"),
        ((F.xxhash64(i) % 1000) / 200.0).alias("zscore"), (F.pmod(F.xxhash64(i, F.lit(1)), F.lit(997)) / 1000.0 + 1e-4).alias("pvalue"))
    columns = ["cell_type", "gene", "n_draws", "n_draws_significant_fdr", "significant_fdr",
               F.round("qvalue", 10), F.round("pvalue", 10), F.round("zscore", 10)]
    small, sliced = (P.pool_draws(draws, ["cell_type"], limit=l).select(*columns) for l in (None, 0))
    assert rows(small) == rows(sliced)


def test_agreement_threshold_zero(spark):
    df = spark.createDataFrame([(0.0,), (0.04,), (0.8,)], "agreement_fdr double")
    kept = lambda t: [r[0] for r in df.filter(C.hit_flag(df.columns, min_agreement=t)).collect()]
    assert kept(0) == [0.04, 0.8] and kept(80) == [0.8]


def test_block_boundaries(spark):
    blocks = spark.createDataFrame([("1", 10, 20, 0, "a"), ("1", 20, 30, 1, "b")], "chrom string, start long, stop long, block_index long, block string")
    where = spark.createDataFrame([("1", 19), ("1", 20), ("1", 30), ("1", 9), ("7", 15)], "chrom string, bp long")
    for width in (1_000_000, 7):
        got = {(r.chrom, r.bp): r.block_index for r in I.assign_blocks(where, blocks, bin_width=width).collect()}
        assert got == {("1", 19): 0, ("1", 20): 1, ("1", 30): -1, ("1", 9): -1, ("7", 15): -1}


def test_versionless_block_fallback(spark):
    blocks = spark.createDataFrame([("1", 0, 100, 4, "a")], "chrom string, start long, stop long, block_index long, block string")
    positions = spark.createDataFrame([("G1", "1", 5)], "gene string, chrom string, bp long")
    genes = spark.createDataFrame([("G1.3",), ("G2",)], "gene string")
    assert dict(I.block_of_gene(genes, positions, blocks).select("gene", "block_index").collect()) == {"G1.3": 4, "G2": -1}


def test_cis_window_is_closed(spark):
    genes = spark.createDataFrame([("g", "1", 1000)], "gene string, chrom string, tss long")
    variants = spark.createDataFrame([("1", i, bp) for i, bp in enumerate((899, 900, 1100, 1101))], "chrom string, snp int, bp long")
    for width in (None, 30):
        got = sorted(r.bp for r in I.window_join(genes, variants, window=100, bin_width=width).collect())
        assert got == [900, 1100]


def test_region_overlap_is_closed(spark):
    df = spark.createDataFrame([(60, 70), (61, 70)], "s long, e long")
    assert [r[0] for r in df.select(I.overlaps(F.col("s"), F.col("e"), F.lit(50), F.lit(60))).collect()] == [True, False]


def test_builds():
    assert I.require_same_build("hg38", "GRCh38") == "GRCh38"
    with pytest.raises(ValueError):
        I.require_same_build("hg19", "hg38")


def test_min_max(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 3.0), ("b", 1.0), ("b", None), ("b", 5.0)], "gene string, value double")
    got = sorted((r.gene, -1.0 if r.value is None else r.value) for r in E.min_max(df, ["gene"]).collect())
    assert got == [("a", 0.0), ("a", 0.0), ("b", -1.0), ("b", 0.0), ("b", 1.0)]


def test_correlation_edges(spark):
    data = [("const", float(i), 1.0) for i in range(5)] + [("perfect", float(i), 2.0 * i) for i in range(5)] + [("two", 1.0, 2.0), ("two", 2.0, 5.0)]
    df = spark.createDataFrame(data, "gene string, x double, y double")
    got = {r.gene: (r.r, r.pvalue) for r in V.pearson(df, ["gene"], "x", "y", with_p=True).collect()}
    assert got["const"] == (None, None) and got["two"] == (None, None)
    assert got["perfect"] == (pytest.approx(1.0), pytest.approx(0.0, abs=1e-12))


def test_maf(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("a", None), ("b", None)], "snp string, dosage int")
    assert {r.snp: r.maf for r in G.allele_frequencies(df).collect()} == {"a": 0.5, "b": 0.0}


def test_covariance_mean_imputes(spark):
    g = spark.createDataFrame([("s", d, v) for d, v in enumerate((0, 2, None))], "snp string, donor int, dosage int")
    pairs, snps, _ = G.gene_covariance(spark.createDataFrame([("g", "s", 1)], "gene string, snp string, bp long"), g)
    assert pairs.first().value == pytest.approx(1.0) and snps.first().sd == pytest.approx(1.0)


def test_allele_alignment(spark):
    df = spark.createDataFrame([(2.0, "A", "G", "A", "G"), (2.0, "G", "A", "A", "G"), (2.0, "A", "C", "A", "G")],
                               "z double, ge string, gn string, e string, n string")
    assert [r[0] for r in df.select(A.aligned_z(*[F.col(c) for c in ("z", "ge", "gn", "e", "n")])).collect()] == [2.0, -2.0, None]


def test_association_by_hand(spark):
    w = spark.createDataFrame([("c", "A", 0, "g", "s1", 0.5), ("c", "A", 0, "g", "s2", -1.0)], "cell_type string, arm string, draw int, gene string, snp string, weight double")
    snps = spark.createDataFrame([("g", "s1", 1.0, "A", "G"), ("g", "s2", 2.0, "C", "T")], "gene string, snp string, sd double, effect_allele string, non_effect_allele string")
    cov = spark.createDataFrame([("g", "s1", "s1", 1.0), ("g", "s1", "s2", 0.5), ("g", "s2", "s2", 4.0)], "gene string, snp1 string, snp2 string, value double")
    gwas = spark.createDataFrame([("s1", "A", "G", 3.0, 0.3, 0.01), ("s2", "T", "C", 1.0, 0.1, 0.3)], "snp string, effect_allele string, non_effect_allele string, zscore double, beta double, pvalue double")
    r = A.gene_association(w, snps, cov, gwas).first()
    var = 0.25 * 1 + 2 * 0.5 * -1 * 0.5 + 4.0
    assert r.var_g == pytest.approx(var)
    assert r.zscore == pytest.approx((0.5 * 3 * 1 + -1 * -1 * 2) / var ** 0.5)
    assert r.effect_size == pytest.approx((0.5 * 0.3 * 1 + -1 * -0.1 * 4) / var)
    assert (r.n_snps_used, r.n_snps_in_cov, r.n_snps_in_model, r.best_gwas_p) == (2, 2, 2, 0.01)
    scaled = A.gene_association(w.withColumn("weight", F.col("weight") * 7), snps, cov, gwas).first()
    assert scaled.zscore == pytest.approx(r.zscore)


def test_gene_on_two_chromosomes_is_an_error(spark):
    m = spark.createDataFrame([("g", 1), ("g", 2)], "gene string, snp int")
    v = spark.createDataFrame([(1, "1", 5), (2, "2", 5)], "snp int, chrom string, bp long")
    with pytest.raises(Exception, match="several chromosomes"):
        A.reference_plan(m, v).collect()


@pytest.mark.parametrize("rule,sizes", [("floor", [2, 3, 2, 3]), ("divmod", [3, 3, 2, 2])])
def test_contiguous_rules(spark, rule, sizes):
    df = spark.range(10)
    for limit in (None, 0):
        assert [E.contiguous_part(df, ["id"], k, 4, rule=rule, limit=limit).count() for k in (1, 2, 3, 4)] == sizes


def test_folds_need_enough_donors(spark):
    df = spark.createDataFrame([("a", d) for d in range(4)] + [("b", d) for d in range(10)], "gene string, donor int")
    got = E.gene_folds(df).groupBy("gene", "fold").count().collect()
    assert {(r.gene, r.fold): r["count"] for r in got} == {("a", None): 4, ("b", "train"): 8, ("b", "test"): 2}


def test_uncertain_donors_dropped(spark):
    rows = [("c", "g", d, float(d), float(d * d % 5), float(d)) for d in range(7)]
    df = spark.createDataFrame(rows, "cell_type string, gene string, donor int, x double, y double, u double")
    for limit in (None, 0):
        got = {r.percent_removed: r.mean_n_individuals for r in V.ablation(df, ["cell_type"], "x", "y", "u", [0, 20], limit=limit).collect()}
        assert got == {0.0: 7.0, 20.0: 6.0}


def test_exact_membership(spark):
    hits = spark.createDataFrame([("A", "x"), ("B", "x"), ("A", "y")], "cell_type string, gene string")
    assert {tuple(r.members): r["size"] for r in C.exact_intersections(hits).collect()} == {("A", "B"): 1, ("A",): 1}


def test_block_needs_reference_gene(spark):
    ref = spark.createDataFrame([("r", "")], "gene string, symbol string")
    owned = spark.createDataFrame([("r", 3)], "gene string, block_index long")
    res = spark.createDataFrame([("c", "other", "", True, 3), ("c", "r", "", False, 3)], "cell_type string, gene string, symbol string, hit boolean, block_index long")
    got = C.block_recovery(res, ref, owned, ["cell_type"]).first()
    assert (got.n_recovered, got.n_hits, got.n_extra, got.n_tested) == (0, 1, 0, 1)


def test_symbol_match_once(spark):
    ref = spark.createDataFrame([("R1", "Abc")], "gene string, symbol string")
    res = spark.createDataFrame([("R1", "ABC"), ("zzz", "abc"), ("q", "")], "gene string, symbol string")
    assert sorted((r.gene, r.ref_gene) for r in C.to_reference(res, ref).collect()) == [("R1", "R1"), ("zzz", "R1")]


def test_sparse_zeros_rank_as_one_block(spark):
    present = spark.createDataFrame([("s", 2.0), ("s", 5.0)], "k string, v double")
    sizes = spark.createDataFrame([("s", 5)], "k string, n_all long")
    got = {r.v: r.percentile for r in E.sparse_percentiles(present, sizes, ["k"], "v").collect()}
    assert got == {0.0: pytest.approx(0.4), 2.0: pytest.approx(0.8), 5.0: pytest.approx(1.0)}


def test_mean_of_sums_ranks_as_cell_weighted(spark):
    sums = spark.createDataFrame([("d1", "c", "g1", 5.0), ("d2", "c", "g2", 9.0), ("d1", "c", "g3", 1.0)], "donor string, cell_type string, gene string, sum_count double")
    groups = spark.createDataFrame([("d1", "c", 4), ("d2", "c", 6)], "donor string, cell_type string, n_cells long")
    order = [[r.gene for r in E.aggregate_donors(sums, groups, how=h).orderBy("value").collect()] for h in ("cell-weighted", "mean-of-sums")]
    assert order[0] == order[1] == ["g3", "g1", "g2"]


def test_fill_leaves_mean_unchanged(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 3.0), ("c", "y", 2.0)], "donor string, cell_type string, value double")
    filled = E.fill_with_mean(df, ["cell_type"], logged=False)
    assert {r.cell_type: r.m for r in filled.groupBy("cell_type").agg(F.avg("value").alias("m")).collect()} == {"x": 2.0, "y": 2.0}
    assert filled.filter("not observed").count() == 3


def test_direction_ladder(spark):
    ref = spark.createDataFrame([(g, 1) for g in "abcdef"], "gene string, sign int")
    res = spark.createDataFrame([("k", "b", False, 1.0), ("k", "c", True, 1.0), ("k", "d", True, 0.0), ("k", "e", True, 2.0), ("k", "f", True, -2.0)],
                                "cell_type string, gene string, hit boolean, effect_size double")
    signs = C.effect_signs(spark.createDataFrame([("k", "c", 1.0), ("k", "c", -1.0), ("k", "d", 0.0), ("k", "e", 2.0), ("k", "f", -2.0)],
                                                 "cell_type string, gene string, effect_size double"), ["cell_type"])
    got = dict(C.direction_table(ref, res, signs, ["cell_type"]).select("gene", "status").collect())
    assert got == {"a": "not_tested", "b": "not_significant", "c": "mixed_models", "d": "missing_or_zero", "e": "concordant", "f": "discordant"}


def test_window_padding(spark):
    seqs = spark.createDataFrame([("1", "ACGTACGT")], "chrom string, sequence string")
    windows = spark.createDataFrame([("1", -2, 4), ("1", 5, 11), ("1", -1, 9), ("2", 0, 3)], "chrom string, start long, end long")
    for length in (3, 50):
        got = {(r.start, r.end): (r.sequence, r.actual_start, r.actual_end) for r in G.window_sequences(windows, G.chunk_sequences(seqs, length), length).collect()}
        assert got == {(-2, 4): ("ACGTAC", 0, 6), (5, 11): ("GTACGT", 2, 8), (-1, 9): ("NNACGTACGT", 0, 8)}


def test_central_bins_take_exactly_w(spark):
    df = spark.createDataFrame([([[float(i)] for i in range(6)],)], "b array<array<double>>")
    assert df.select(G.central_mean(F.col("b"), 1, 1)).first()[0] == [2.0]
    assert df.select(G.central_mean(F.col("b"), 2, 1)).first()[0] == [2.5]


def test_rank_spread_single_and_paths(spark, rows):
    one = spark.createDataFrame([("g", 1, 3.0, 0.5)], "gene string, donor int, value double, sigma double")
    assert G.rank_spread(one, ["gene"]).first().spread == 0.0
    i = F.col("id")
    many = spark.range(300).select(F.when(i % 3 > 0, "hot").otherwise("b").alias("gene"), i.alias("donor"),
                                   F.pmod(F.xxhash64(i), F.lit(90)).cast("double").alias("value"), ((i % 7) / 5.0).alias("sigma"))
    for form in ("percentile", "normal"):
        a, b = (G.rank_spread(many, ["gene"], form=form, limit=l).select("gene", "donor", F.round("spread", 12)) for l in (None, 0))
        assert rows(a) == rows(b)


def test_evaluation_paths_agree(spark, rows):
    i = F.col("id")
    df = spark.range(900).select(
        F.when(i % 3 > 0, "hot").otherwise("cold").alias("cell_type"), (i % 4).alias("gene"), i.alias("donor"),
        F.pmod(F.xxhash64(i), F.lit(50)).cast("double").alias("x"), F.pmod(F.xxhash64(i, F.lit(2)), F.lit(60)).cast("double").alias("y"),
        (F.pmod(F.xxhash64(i, F.lit(3)), F.lit(30)) / 10.0).alias("u"))
    keys = ["cell_type"]
    calls = [
        lambda l: V.spearman(df, keys, "x", "y", limit=l).select("cell_type", F.round("rho", 12)),
        lambda l: V.calibration(df, keys, "x", "y", "u", 6, tie=["donor"], limit=l).select("cell_type", F.round("ence", 10), F.round("rho", 10)),
        lambda l: V.within_gene_curve(df, keys, "x", "y", "u", 4, limit=l).select("cell_type", "bin", F.round("relative_error", 10)),
        lambda l: V.box_stats(df, keys, "x", limit=l), lambda l: V.empirical_quantiles(df, keys, "u", limit=l),
        lambda l: P.inflation(df.withColumn("p", (F.col("x") + 1) / 52), keys, "p", limit=l).select("cell_type", F.round("lambda_gc", 10)),
        lambda l: I.block_runs(df.withColumn("block_index", F.col("x").cast("int") % 3 - 1), keys, ["donor"], limit=l),
        lambda l: I.widest_gap(df.withColumn("z", F.when(F.col("donor") < 3, 90.0).otherwise(F.col("x") / 9)), keys, "z", floor=1.0, limit=l),
    ]
    for call in calls:
        assert rows(call(None)) == rows(call(0))


def test_edits_cut_the_sequence_only_where_they_are(spark):
    cases = [("ACGT", {0: "T", 2: "N"}), ("ACGT", {}), ("ACGT", None), (None, {0: "T"}), ("", {0: "T"}), ("", {1: "T"}), ("", {}), ("é漢A😀", {1: "T", 3: "G"}),
             ("ACGT", {-1: "T", 4: "T", 9: "T", 3: "GG"}), ("ACGT", {1: None, 2: ""}), ("ACGT", {3: "a", 1: "b", 0: "c", 2: "d"})]
    df = spark.createDataFrame(list(enumerate(cases)), "id int, c struct<s: string, e: map<int, string>>").select("id", G.apply_edits(F.col("c.s"), F.col("c.e")).alias("x"))

    def plain(s, e):
        return s if s is None else "".join((e or {}).get(i) if (e or {}).get(i) is not None else c for i, c in enumerate(s or [""]))

    assert {r.id: r.x for r in df.collect()} == {i: plain(*c) for i, c in enumerate(cases)}
    # no list of all bases is made
    assert "split(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_base_codes_and_channels_by_the_batch(spark):
    texts = ["ACGTN", "acgtnX -", None, "", "é漢A😀t", "", "G" * 3000, None, "T"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, s string").coalesce(1)
    codes = G.base_codes(F.col("s"))
    d = df.select("id", codes.alias("codes"), G.one_hot(codes).alias("hot"), G.channel_sums(G.one_hot(codes)).alias("sums"), G.unknown_bases(codes).alias("n_other"))
    got = {r.id: tuple(r[1:]) for r in d.collect()}
    for i, text in enumerate(texts):
        # an empty sequence has one empty base with code 0, as it had where sequences were split
        want = None if text is None else ["ACGT".find(c.upper()) if c.upper() in "ACGT" else 4 for c in text or [""]]
        hot = None if want is None else [[int(k == c) for k in range(4)] for c in want]
        assert got[i] == (want, hot, hot and [sum(x) for x in zip(*hot)], want and want.count(4)), text
    alone = spark.createDataFrame([([0, None, 3, 4, 7, -1],), ([],), (None,)], "c array<int>").coalesce(1).select(G.one_hot(F.col("c")))
    zero = [0, 0, 0, 0]
    assert [r[0] for r in alone.collect()] == [[[1, 0, 0, 0], [None] * 4, [0, 0, 0, 1], zero, zero, zero], [], None]
    # batches of bases, not a function call for each
    assert "lambda" not in d._jdf.queryExecution().optimizedPlan().toString()

"""Association, correction, pooling and block summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as T
from ..association_run import association_run
from ..registry import query, sql_acat, sql_bh, sql_norm_ppf, sql_two_sided
from ...functions import exprs as X
from ...functions.storage import reusable
from ...operators import association as A, intervals as I, pooling as P

# ---- the association itself ----------------------------------------------------------------

_MODEL = """
model AS (
  SELECT w.*, s.sd, CASE WHEN g.effect_allele = s.effect_allele AND g.non_effect_allele = s.non_effect_allele THEN 1
                         WHEN g.effect_allele = s.non_effect_allele AND g.non_effect_allele = s.effect_allele THEN -1 END AS flip,
         g.zscore AS gz, g.beta AS gb, g.pvalue AS gp
  FROM weights w LEFT JOIN ld_snps s USING (gene, snp) LEFT JOIN gwas g USING (snp)),
sides AS (
  SELECT cell_type, arm, draw, gene, sum(weight*flip*gz*sd) AS num, sum(weight*flip*gb*sd*sd) AS eff,
         count(flip) AS n_snps_used, count(sd) AS n_snps_in_cov, count(*) AS n_snps_in_model,
         min(CASE WHEN flip IS NOT NULL THEN gp END) AS best_gwas_p,
         max(CASE WHEN flip IS NOT NULL THEN abs(weight) END) AS largest_weight
  FROM model GROUP BY ALL),
vars AS (
  SELECT a.cell_type, a.arm, a.draw, a.gene,
         sum(a.weight*b.weight*c.value*CASE WHEN c.snp1=c.snp2 THEN 1 ELSE 2 END) AS var_g
  FROM ld_cov c JOIN model a ON a.gene=c.gene AND a.snp=c.snp1 AND a.flip IS NOT NULL
       JOIN model b ON b.gene=c.gene AND b.snp=c.snp2 AND b.flip IS NOT NULL
            AND b.cell_type=a.cell_type AND b.arm=a.arm AND b.draw=a.draw
  GROUP BY ALL),
assoc AS (
  SELECT s.cell_type, s.arm, s.draw, s.gene, num/sqrt(var_g) AS zscore, eff/var_g AS effect_size,
         """ + sql_two_sided("num/sqrt(var_g)") + """ AS pvalue, var_g, n_snps_used, n_snps_in_cov,
         n_snps_in_model, best_gwas_p, largest_weight
  FROM sides s JOIN vars v USING (cell_type, arm, draw, gene) WHERE var_g > 0)"""


def _inputs(spark, sf):
    snps = reusable(T.ld_snps(spark, sf))
    return T.weights(spark, sf), snps, T.ld_cov(snps), T.gwas(spark, sf)


@query("gene_association", "A5 J4 J5", "WITH " + _MODEL + " SELECT * FROM assoc",
       ctes="weights ld_snps ld_cov gwas",
       floats="zscore effect_size pvalue var_g best_gwas_p largest_weight", digits=7)
def gene_association(spark, sf):
    return A.gene_association(*_inputs(spark, sf))


_POOL = """
flagged AS (""" + sql_bh("assoc", "cell_type, arm, draw", "pvalue") + """),
pooled0 AS (
  SELECT cell_type, arm, gene, count(zscore) AS n_draws, avg(zscore) AS zscore, """ + sql_acat("pvalue") + """ AS pvalue,
         count_if(significant_bonferroni) AS n_draws_significant_bonferroni, avg(n_snps_used) AS mean_n_snps_used,
         min(best_gwas_p) AS best_gwas_p
  FROM flagged GROUP BY ALL),
pooled AS (""" + sql_bh("pooled0", "cell_type, arm", "pvalue") + """)"""


@query("association_run", "A5 A6 A7 W1 J1 (flagship)",
       "WITH " + _MODEL + "," + _POOL + """
SELECT cell_type, arm, gene, n_draws, zscore, pvalue, qvalue, significant_fdr, significant_bonferroni, bonferroni_threshold,
       n_draws_significant_bonferroni, mean_n_snps_used, best_gwas_p, coalesce(b.block_index, -1) AS block_index
FROM pooled p LEFT JOIN gene20_pos g USING (gene) LEFT JOIN blocks b ON b.chrom = g.chrom AND g.bp >= b.start AND g.bp < b.stop""",
       ctes="weights ld_snps ld_cov gwas gene20_pos blocks", longs="block_index",
       floats="zscore pvalue qvalue bonferroni_threshold mean_n_snps_used best_gwas_p", digits=7)
def flagship(spark, sf):
    run = association_run(*_inputs(spark, sf), T.gene20_pos(spark, sf), T.blocks(spark, sf))
    return run.select("cell_type", "arm", "gene", "n_draws", "zscore", "pvalue", "qvalue", "significant_fdr", "significant_bonferroni",
                      "bonferroni_threshold", "n_draws_significant_bonferroni", "mean_n_snps_used", "best_gwas_p", "block_index")


@query("weight_attrition", "F18", """
SELECT cell_type, draw, count(*) AS n_weights, 0 AS n_non_finite, 0 AS n_zero,
       count(*) FILTER (s.gene IS NULL) AS n_missing_snp, count(s.gene) AS n_kept
FROM weights w LEFT JOIN ld_snps s USING (gene, snp) GROUP BY ALL""",
       ctes="weights ld_snps", longs="n_non_finite n_zero")
def weight_attrition(spark, sf):
    return A.weight_attrition(T.weights(spark, sf), T.ld_snps(spark, sf), ["cell_type", "draw"])


@query("reference_plan", "J6", """
SELECT gene, min(v.chrom) AS chrom, min(v.bp) AS start_bp, max(v.bp) AS end_bp, count(*) AS n_snps_in_model,
       count(v.snp) AS n_snps_found, count(*) - count(v.snp) AS n_snps_missing
FROM (SELECT DISTINCT o_custkey AS gene, o_orderkey + (o_orderkey % 5 // 4) * 100000000 AS snp FROM orders) m
LEFT JOIN variants v USING (snp) GROUP BY gene""", ctes="variants")
def reference_plan(spark, sf):
    key = F.col("o_orderkey")
    model = T.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("gene"), (key + F.when(key % 5 == 4, 100000000).otherwise(0)).alias("snp")).distinct()
    return A.reference_plan(model, T.variants(spark, sf))


@query("attach_symbols", "J16", """
SELECT l_partkey AS gene, CASE WHEN l_returnflag = 'R' THEN 'kept' ELSE min(p_name) END AS gene_name, count(*) AS n
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_partkey, l_returnflag""")
def attach_symbols(spark, sf):
    genes = T.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("gene"), "l_returnflag").agg(
        F.count(F.lit(1)).alias("n"))
    blank = F.when(F.col("l_returnflag") == "R", "kept").when(F.col("l_returnflag") == "A", "").otherwise(
        F.col("gene").cast("string"))
    names = T.table(spark, sf, "part").select(F.col("p_partkey").alias("gene"), F.col("p_name").alias("symbol"))
    return A.attach_symbols(genes.withColumn("gene_name", blank), names).select("gene", "gene_name", "n")


# ---- correction and pooling ----------------------------------------------------------------

@query("multiple_testing", "W1", "WITH c AS (" + sql_bh("draws", "cell_type, arm, draw", "pvalue") + """)
SELECT cell_type, arm, draw, gene, pvalue, qvalue, significant_fdr, bonferroni_threshold, significant_bonferroni FROM c""",
       ctes="draws", floats="pvalue qvalue bonferroni_threshold")
def multiple_testing(spark, sf):
    out = P.annotate_significance(T.draws(spark, sf), ["cell_type", "arm", "draw"])
    return out.select("cell_type", "arm", "draw", "gene", "pvalue", "qvalue", "significant_fdr",
                      "bonferroni_threshold", "significant_bonferroni")


@query("multiple_testing_ungrouped", "W1", "WITH one AS (SELECT gene, draw, min(pvalue) AS pvalue FROM draws GROUP BY ALL), c AS ("
       + sql_bh("one", "", "pvalue") + ") SELECT gene, draw, qvalue, significant_fdr FROM c",
       ctes="draws", floats="qvalue")
def multiple_testing_ungrouped(spark, sf):
    one = T.draws(spark, sf).groupBy("gene", "draw").agg(F.min("pvalue").alias("pvalue"))
    return P.annotate_significance(one, []).select("gene", "draw", "qvalue", "significant_fdr")


_POOLED = """
flagged AS (""" + sql_bh("draws", "cell_type, arm, draw", "pvalue") + """),
agg AS (
  SELECT cell_type, arm, gene, count(zscore) AS n_draws, """ + sql_acat("pvalue") + """ AS pvalue,
         avg(zscore) AS zscore, var_samp(zscore) AS zscore_var, min(zscore) AS zscore_min, max(zscore) AS zscore_max,
         avg(pvalue) AS pm, var_samp(pvalue) AS pv, min(pvalue) AS pvalue_expectation_min, max(pvalue) AS pvalue_expectation_max,
         avg(effect_size) AS effect_size, var_samp(effect_size) AS ev,
         count_if(significant_bonferroni) AS n_draws_significant_bonferroni, count_if(significant_fdr) AS n_draws_significant_fdr,
         avg(n_snps_used) AS mean_n_snps_used, avg(n_snps_in_model) AS n_snps_in_model, min(best_gwas_p) AS best_gwas_p
  FROM flagged GROUP BY ALL),
exp0 AS (SELECT *, """ + sql_two_sided("zscore") + """ AS pvalue_expectation,
                n_draws_significant_bonferroni/n_draws AS agreement_bonferroni, n_draws_significant_fdr/n_draws AS agreement_fdr FROM agg),
exp1 AS (""" + sql_bh("exp0", "cell_type, arm", "pvalue") + """),
exp2 AS (""" + sql_bh("exp1", "cell_type, arm", "pvalue_expectation", suffix="_expectation") + """),
pooled AS (
  SELECT *, significant_fdr OR significant_fdr_expectation AS hit,
         CASE WHEN hit THEN sqrt(zscore_var) END AS zscore_sd,
         CASE WHEN hit THEN sqrt(ev) END AS effect_size_sd,
         CASE WHEN hit THEN sqrt(pv) END AS pvalue_expectation_sd,
         CASE WHEN hit THEN zscore - 1.959963984540054*sqrt(zscore_var) END AS zscore_ci_low,
         CASE WHEN hit AND pv IS NOT NULL THEN greatest(0, least(1, pm + 1.959963984540054*sqrt(pv))) END AS pvalue_expectation_ci_high
  FROM exp2)"""

_POOL_COLUMNS = ("cell_type arm gene n_draws pvalue qvalue zscore zscore_min zscore_max zscore_sd zscore_ci_low "
                 "pvalue_expectation qvalue_expectation pvalue_expectation_min pvalue_expectation_ci_high effect_size "
                 "n_draws_significant_bonferroni n_draws_significant_fdr agreement_bonferroni agreement_fdr "
                 "mean_n_snps_used n_snps_in_model best_gwas_p significant_fdr significant_bonferroni "
                 "significant_fdr_expectation significant_bonferroni_expectation bonferroni_threshold").split()


def pooled(spark, sf):
    return P.pool_draws(T.draws(spark, sf), ["cell_type", "arm"])


@query("pool_draws", "A6 A7 X2", "WITH " + _POOLED + f" SELECT {', '.join(_POOL_COLUMNS)} FROM pooled", ctes="draws",
       floats="pvalue qvalue zscore zscore_min zscore_max zscore_sd zscore_ci_low pvalue_expectation qvalue_expectation "
              "pvalue_expectation_min pvalue_expectation_ci_high effect_size agreement_bonferroni agreement_fdr "
              "mean_n_snps_used n_snps_in_model best_gwas_p bonferroni_threshold", digits=8)
def pool_draws(spark, sf):
    return pooled(spark, sf).select(*_POOL_COLUMNS)


@query("acat_combine", "A7", "SELECT gene, " + sql_acat("pvalue") + " AS pvalue, count(*) AS n FROM (SELECT gene, "
       "CASE WHEN draw = 6 AND gene % 50 = 0 THEN 0 WHEN gene % 40 = 1 THEN 1 ELSE pvalue END AS pvalue FROM draws) GROUP BY gene",
       ctes="draws", floats="pvalue")
def acat_combine(spark, sf):
    g = F.col("gene")
    p = F.when((F.col("draw") == 6) & (g % 50 == 0), 0.0).when(g % 40 == 1, 1.0).otherwise(F.col("pvalue"))
    return T.draws(spark, sf).select("gene", p.alias("pvalue")).groupBy("gene").agg(
        X.acat(F.col("pvalue")).alias("pvalue"), F.count(F.lit(1)).alias("n"))


@query("genomic_inflation", "A8 X2", "SELECT cell_type, arm, median(z*z)/0.4549364231195728 AS lambda_gc FROM "
       "(SELECT cell_type, arm, " + sql_norm_ppf("pvalue/2.0") + " AS z FROM draws WHERE pvalue > 0) GROUP BY ALL",
       ctes="draws", floats="lambda_gc")
def genomic_inflation(spark, sf):
    return P.inflation(T.draws(spark, sf), ["cell_type", "arm"])


@query("result_summary", "A9", "WITH " + _POOLED + """,
s AS (SELECT cell_type, arm, count(*) AS n_genes, count(pvalue) AS n_genes_tested, count_if(significant_fdr) AS n_significant_fdr,
             count_if(significant_bonferroni) AS n_significant_bonferroni, min(pvalue) AS min_pvalue,
             max(abs(zscore)) AS max_abs_zscore, avg(mean_n_snps_used) AS mean_n_snps_used,
             avg(n_snps_in_model) AS mean_n_snps_in_model, avg(mean_n_snps_used)/avg(n_snps_in_model) AS frac_model_snps_used,
             avg(zscore_sd) AS mean_zscore_sd_significant, max(effect_size_sd) AS max_effect_size_sd_significant,
             count_if(significant_fdr_expectation) AS "expectation/n_significant_fdr"
      FROM pooled GROUP BY ALL),
l AS (SELECT cell_type, arm, median(z*z)/0.4549364231195728 AS lambda_gc FROM (SELECT *, """ + sql_norm_ppf("pvalue/2.0") + """ AS z
      FROM pooled WHERE pvalue > 0) GROUP BY ALL)
SELECT cell_type, arm, metric, value FROM (
  SELECT s.cell_type, s.arm, unnest(['n_genes','n_genes_tested','n_significant_fdr','n_significant_bonferroni','min_pvalue',
    'max_abs_zscore','mean_n_snps_used','mean_n_snps_in_model','frac_model_snps_used','mean_zscore_sd_significant',
    'max_effect_size_sd_significant','expectation/n_significant_fdr','lambda_gc']) AS metric,
   unnest([n_genes::DOUBLE, n_genes_tested, n_significant_fdr, n_significant_bonferroni, min_pvalue, max_abs_zscore,
    mean_n_snps_used, mean_n_snps_in_model, frac_model_snps_used, mean_zscore_sd_significant, max_effect_size_sd_significant,
    "expectation/n_significant_fdr", lambda_gc]) AS value
  FROM s JOIN l USING (cell_type, arm))""", ctes="draws", floats="value", digits=8)
def result_summary(spark, sf):
    wanted = ["n_genes", "n_genes_tested", "n_significant_fdr", "n_significant_bonferroni", "min_pvalue",
              "max_abs_zscore", "mean_n_snps_used", "mean_n_snps_in_model", "frac_model_snps_used",
              "mean_zscore_sd_significant", "max_effect_size_sd_significant", "expectation/n_significant_fdr", "lambda_gc"]
    return P.result_summary(pooled(spark, sf), ["cell_type", "arm"]).filter(F.col("metric").isin(wanted))


_PLACED = """,
placed AS (SELECT p.*, coalesce(b.block_index, -1) AS block_index
           FROM pooled p LEFT JOIN gene_pos g USING (gene)
           LEFT JOIN blocks b ON b.chrom = g.chrom AND g.bp >= b.start AND g.bp < b.stop)"""


def placed(spark, sf):
    where = I.assign_blocks(T.gene_pos(spark, sf), T.blocks(spark, sf)).select("gene", "block_index")
    return pooled(spark, sf).join(where, "gene", "left").withColumn(
        "block_index", F.coalesce("block_index", F.lit(-1)))


_STRATA_LABELS = "['0%', '(0%, 20%]', '(20%, 40%]', '(40%, 60%]', '(60%, 80%]', '(80%, 100%]']"


@query("agreement_strata", "A10", "WITH " + _POOLED + _PLACED + f""",
d AS (SELECT *, CASE WHEN agreement_bonferroni > 0 THEN CAST(ceil(round(agreement_bonferroni*5, 9)) AS INT) ELSE 0 END AS bin_no,
             abs(zscore) AS az, abs(zscore)/zscore_sd AS st FROM placed),
grid AS (SELECT cell_type, arm, b.* FROM (SELECT DISTINCT cell_type, arm FROM pooled),
         (SELECT unnest(range(6)) AS bin_no, unnest({_STRATA_LABELS}) AS agreement_bin) b)
SELECT cell_type, arm, bin_no, agreement_bin, count(gene) AS n_genes, median(n_draws_significant_bonferroni) AS n_draws_significant_median,
       count(DISTINCT CASE WHEN block_index >= 0 THEN block_index END) AS n_ld_blocks,
       median(az) AS abs_zscore_median, avg(az) AS abs_zscore_mean, median(st) AS stability_median,
       avg(best_gwas_p) AS best_gwas_p_mean, avg(significant_bonferroni::INT) AS frac_significant_pooled
FROM grid LEFT JOIN d USING (cell_type, arm, bin_no) GROUP BY ALL""",
       ctes="draws gene_pos blocks", longs="bin_no",
       floats="n_draws_significant_median abs_zscore_median abs_zscore_mean stability_median best_gwas_p_mean frac_significant_pooled")
def agreement_strata(spark, sf):
    return P.agreement_strata(placed(spark, sf), ["cell_type", "arm"]).select(
        "cell_type", "arm", "bin_no", "agreement_bin", "n_genes", "n_draws_significant_median", "n_ld_blocks",
        "abs_zscore_median", "abs_zscore_mean", "stability_median", "best_gwas_p_mean", "frac_significant_pooled")


@query("agreement_summary", "A11", "WITH " + _POOLED + """
SELECT cell_type, arm, count_if(agreement_fdr > 0) AS n_genes_significant_in_any_draw,
       count_if(agreement_fdr >= 1) AS n_genes_significant_in_all_draws,
       count_if(agreement_fdr >= 0.8) AS n_genes_agreement_at_least_80pct,
       count_if(agreement_fdr >= 0.5) AS n_genes_agreement_at_least_50pct,
       avg(CASE WHEN agreement_fdr > 0 THEN agreement_fdr END) AS mean_agreement_among_ever_significant,
       median(CASE WHEN agreement_fdr > 0 THEN agreement_fdr END) AS median_agreement_among_ever_significant
FROM pooled GROUP BY ALL""", ctes="draws",
       floats="mean_agreement_among_ever_significant median_agreement_among_ever_significant")
def agreement_summary(spark, sf):
    return P.agreement_summary(pooled(spark, sf), ["cell_type", "arm"], criterion="fdr")


@query("draw_spread", "A12 W7", """
SELECT cell_type, arm, draw, count(gene) AS n_genes, avg(zscore) AS mean_zscore, stddev_samp(zscore) AS sd_zscore,
       sqrt(avg((zscore - gm)*(zscore - gm))) AS rmse_vs_mean
FROM (SELECT *, avg(zscore) OVER (PARTITION BY cell_type, arm, gene) AS gm FROM draws) GROUP BY ALL""",
       ctes="draws", floats="mean_zscore sd_zscore rmse_vs_mean")
def draw_spread(spark, sf):
    return P.draw_spread(T.draws(spark, sf), ["cell_type", "arm"])


@query("combine_tables", "A39", "WITH d AS (SELECT *, CASE WHEN draw % 3 = 0 THEN '' ELSE 'n' || draw END AS gene_name FROM draws) "
       "SELECT arm, gene, arg_min(nullif(gene_name, ''), CASE WHEN gene_name <> '' THEN draw END) AS gene_name, " + sql_acat("pvalue")
       + " AS pvalue, count(pvalue) AS n_cell_types, avg(zscore) AS zscore FROM d GROUP BY ALL",
       ctes="draws", floats="pvalue zscore")
def combine_tables(spark, sf):
    named = T.draws(spark, sf).withColumn(
        "gene_name", F.when(F.col("draw") % 3 == 0, "").otherwise(F.concat(F.lit("n"), "draw")))
    named = named.groupBy("arm", "gene", "cell_type", "draw").agg(
        F.first("pvalue").alias("pvalue"), F.first("zscore").alias("zscore"), F.first("gene_name").alias("gene_name"))
    return P.combine_tables(named, ["arm"], mean_columns=["zscore"], label_columns=["gene_name"], order="draw")


_GROUPS = "(SELECT * FROM (VALUES ('F','done',2), ('O','done',2), ('P','open',1)) t(cell_type, group_name, n_expected))"


def _groups(spark):
    return spark.createDataFrame([("F", "done", 2), ("O", "done", 2), ("P", "open", 1)],
                                 "cell_type string, group_name string, n_expected int")


@query("collapse_groups", "A40", "WITH r0 AS (SELECT cell_type, gene, min(pvalue) AS pvalue FROM draws GROUP BY ALL), r AS ("
       + sql_bh("r0", "cell_type", "pvalue") + f"), c AS (SELECT group_name, gene, {sql_acat('pvalue')} AS pvalue, "
       f"bool_or(significant_fdr) AS kept_call, max(n_expected) AS n_expected FROM r JOIN {_GROUPS} USING (cell_type) GROUP BY ALL), "
       "k AS (" + sql_bh("c", "group_name", "pvalue") + """)
SELECT group_name, gene, pvalue, CASE WHEN n_expected = 1 THEN kept_call ELSE significant_fdr END AS hit FROM k""",
       ctes="draws", floats="pvalue")
def collapse_groups(spark, sf):
    one = T.draws(spark, sf).groupBy("cell_type", "gene").agg(F.min("pvalue").alias("pvalue"))
    called = P.annotate_significance(one, ["cell_type"])
    return P.collapse_groups(called, _groups(spark))


@query("collapse_groups_by_draw", "A40", "WITH d AS (SELECT cell_type, draw, gene, min(pvalue) AS pvalue FROM draws GROUP BY ALL), c AS ("
       f"SELECT group_name, draw, gene, {sql_acat('pvalue')} AS pvalue FROM d JOIN {_GROUPS} USING (cell_type) GROUP BY ALL), k AS ("
       + sql_bh("c", "group_name, draw", "pvalue") + """)
SELECT group_name, gene, avg(significant_fdr::INT) AS agreement, avg(significant_fdr::INT)*100 >= 20 AS hit FROM k GROUP BY ALL""",
       ctes="draws", floats="agreement")
def collapse_groups_by_draw(spark, sf):
    one = T.draws(spark, sf).groupBy("cell_type", "draw", "gene").agg(F.min("pvalue").alias("pvalue"))
    return P.collapse_groups_by_draw(one, _groups(spark), min_agreement=20)


# ---- positions -----------------------------------------------------------------------------

@query("block_assignment", "J1", """
SELECT g.gene, g.chrom, g.bp, coalesce(b.block_index, -1) AS block_index, b.block
FROM gene_pos g LEFT JOIN blocks b ON b.chrom = g.chrom AND g.bp >= b.start AND g.bp < b.stop""", ctes="gene_pos blocks")
def block_assignment(spark, sf):
    return I.assign_blocks(T.gene_pos(spark, sf), T.blocks(spark, sf))


@query("cis_window_join", "J2", """
SELECT g.gene, count(*) AS n, min(v.bp) AS first_bp, max(v.bp) AS last_bp, sum(v.snp) AS snps
FROM gene_pos g JOIN variants v ON v.chrom = g.chrom AND v.bp BETWEEN g.bp - 50000 AND g.bp + 50000 GROUP BY g.gene""",
       ctes="gene_pos variants", longs="snps")
def cis_window_join(spark, sf):
    genes = T.gene_pos(spark, sf).withColumnRenamed("bp", "tss")
    return I.window_join(genes, T.variants(spark, sf), window=50000).groupBy("gene").agg(
        F.count(F.lit(1)).alias("n"), F.min("bp").alias("first_bp"), F.max("bp").alias("last_bp"), F.sum("snp").alias("snps"))


@query("region_overlap", "J3 S9 X5", """
SELECT gene, chrom, bp AS start, bp + 5000 AS "end" FROM gene_pos WHERE chrom = '6' AND bp + 5000 >= 250000 AND bp <= 1200000""",
       ctes="gene_pos")
def region_overlap(spark, sf):
    region = X.parse_region(F.lit("chr6:250,000-1,200,000"))
    genes = T.gene_pos(spark, sf).select("gene", "chrom", F.col("bp").alias("start"), (F.col("bp") + 5000).alias("end"))
    return genes.filter((F.col("chrom") == region["chrom"]) & I.overlaps(
        F.col("start"), F.col("end"), region["start"], region["end"]))


@query("block_metrics", "A13", "WITH " + _POOLED + _PLACED + """,
c AS (SELECT cell_type, arm, block_index, count(*) AS n FROM placed WHERE agreement_fdr > 0 GROUP BY ALL)
SELECT cell_type, arm, sum(n) AS n_genes, count_if(block_index >= 0) AS n_ld_blocks, (SELECT count(*) FROM blocks) AS n_ld_blocks_total,
       count_if(block_index >= 0)/(SELECT count(*) FROM blocks) AS frac_ld_blocks,
       sum(CASE WHEN block_index >= 0 THEN n END)/nullif(count_if(block_index >= 0), 0) AS genes_per_ld_block,
       coalesce(max(CASE WHEN block_index >= 0 THEN n END), 0) AS max_genes_in_one_ld_block,
       coalesce(sum(CASE WHEN block_index < 0 THEN n END), 0) AS n_genes_outside_ld_blocks
FROM c GROUP BY ALL""", ctes="draws gene_pos blocks", longs="n_genes n_genes_outside_ld_blocks",
       floats="frac_ld_blocks genes_per_ld_block")
def block_metrics(spark, sf):
    return I.block_metrics(placed(spark, sf).filter("agreement_fdr > 0"), T.blocks(spark, sf), ["cell_type", "arm"])


@query("agreement_block_curve", "A14 F9", "WITH " + _POOLED + _PLACED + """,
t AS (SELECT unnest([0.0,0.2,0.4,0.5,0.6,0.8,0.9,1.0])::DOUBLE AS threshold),
k AS (SELECT cell_type, arm, threshold, block_index, count(*) FILTER (CASE WHEN threshold = 0 THEN agreement_fdr > 0 ELSE agreement_fdr >= threshold END) AS n
      FROM placed, t GROUP BY ALL),
a AS (SELECT cell_type, arm, threshold, sum(n) AS n_genes, count_if(block_index >= 0 AND n > 0) AS n_ld_blocks,
             sum(CASE WHEN block_index >= 0 THEN n ELSE 0 END) AS n_inside,
             coalesce(max(CASE WHEN block_index >= 0 THEN n END), 0) AS max_genes_in_one_ld_block FROM k GROUP BY ALL)
SELECT a.cell_type, a.arm, a.threshold, a.n_genes, a.n_ld_blocks, (SELECT count(*) FROM blocks) AS n_ld_blocks_total,
       a.n_inside/nullif(a.n_ld_blocks, 0) AS genes_per_ld_block, a.max_genes_in_one_ld_block,
       a.n_genes/nullif(z.n_genes, 0) AS frac_genes_retained, a.n_ld_blocks/nullif(z.n_ld_blocks, 0) AS frac_ld_blocks_retained
FROM a JOIN a z ON z.cell_type = a.cell_type AND z.arm = a.arm AND z.threshold = 0""",
       ctes="draws gene_pos blocks", longs="n_genes", floats="genes_per_ld_block frac_genes_retained frac_ld_blocks_retained")
def agreement_block_curve(spark, sf):
    return I.agreement_block_curve(placed(spark, sf), T.blocks(spark, sf), ["cell_type", "arm"],
                                   P.AGREEMENT_CUTS, criterion="fdr")


@query("genes_per_block", "A47", "WITH " + _POOLED + _PLACED + """
SELECT cell_type, arm, genes_in_block, count(*) AS n_blocks FROM (
  SELECT cell_type, arm, block_index, count(*) AS genes_in_block FROM placed WHERE significant_fdr AND block_index >= 0 GROUP BY ALL)
GROUP BY ALL""", ctes="draws gene_pos blocks")
def genes_per_block(spark, sf):
    return I.genes_per_block_histogram(placed(spark, sf).filter("significant_fdr"), ["cell_type", "arm"])


@query("genome_layout", "W8", """
WITH s AS (SELECT chrom, max(bp)::DOUBLE AS span FROM gene_pos GROUP BY chrom),
o AS (SELECT chrom, coalesce(sum(span*1.02) OVER (ORDER BY chrom::INT ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM s)
SELECT gene, chrom, bp, off + bp AS x FROM gene_pos JOIN o USING (chrom)""", ctes="gene_pos", floats="x", digits=3)
def genome_layout(spark, sf):
    return I.genome_layout(T.gene_pos(spark, sf))[0]


@query("genome_ticks", "W8", """
WITH s AS (SELECT chrom, max(bp)::DOUBLE AS span FROM gene_pos GROUP BY chrom)
SELECT chrom, coalesce(sum(span*1.02) OVER (ORDER BY chrom::INT ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + span/2 AS tick FROM s""",
       ctes="gene_pos", floats="tick", digits=3)
def genome_ticks(spark, sf):
    return I.genome_layout(T.gene_pos(spark, sf))[1]


@query("block_runs", "W9", """
WITH p AS (SELECT g.chrom, g.bp, CASE WHEN g.gene % 7 = 0 THEN -1 ELSE coalesce(b.block_index, -1) END AS block_index
           FROM gene_pos g LEFT JOIN blocks b ON b.chrom = g.chrom AND g.bp >= b.start AND g.bp < b.stop),
n AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY bp) AS pos, lag(block_index) OVER (PARTITION BY chrom ORDER BY bp) AS before FROM p),
r AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> block_index THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY bp) AS run FROM n)
SELECT chrom, block_index, min(pos) - 1 AS run_start, max(pos) - 1 AS run_end FROM r WHERE block_index >= 0 GROUP BY chrom, run, block_index""",
       ctes="gene_pos blocks")
def block_runs(spark, sf):
    rows = I.assign_blocks(T.gene_pos(spark, sf), T.blocks(spark, sf)).withColumn(
        "block_index", F.when(F.col("gene") % 7 == 0, -1).otherwise(F.col("block_index")))
    return I.block_runs(rows.select("chrom", "bp", "block_index"), ["chrom"], ["bp"])


@query("widest_gap", "W11", """
WITH y AS (SELECT o_orderstatus AS cell_type, CASE WHEN o_orderkey % 1500 = 7 THEN 60 ELSE 10 END * o_totalprice / 500000 AS y FROM orders),
v AS (SELECT DISTINCT cell_type, y FROM y WHERE y > 3),
g AS (SELECT *, lead(y) OVER (PARTITION BY cell_type ORDER BY y) AS high FROM v),
b AS (SELECT cell_type, y AS low, high FROM g WHERE high IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cell_type ORDER BY high - y DESC, y) = 1)
SELECT b.cell_type, low, high FROM b JOIN y USING (cell_type) GROUP BY ALL
HAVING high - low >= greatest(0.35*max(y), 5.0) AND count_if(y > low) <= greatest(10.0, 0.02*count(*))""", floats="low high")
def widest_gap(spark, sf):
    scale = F.when(F.col("o_orderkey") % 1500 == 7, 60).otherwise(10)
    y = T.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("cell_type"),
                                            (scale * F.col("o_totalprice") / 500000).alias("y"))
    return I.widest_gap(y, ["cell_type"], "y", floor=3.0)

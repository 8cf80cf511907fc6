"""Correlations, curves, calibration, ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as T
from ..registry import query, sql_two_sided
from ...functions import exprs as X
from ...operators import evaluation as V

KEYS = ["cell_type", "gene"]


def r_sql(x: str, y: str) -> str:
    return (f"CASE WHEN count(*)*sqrt(var_pop({x})*var_pop({y})) > 2.220446049250313e-16 "
            f"THEN greatest(-1, least(1, covar_pop({x}, {y})/sqrt(var_pop({x})*var_pop({y})))) END")


def rank_sql(part: str, v: str) -> str:
    return f"(rank() OVER (PARTITION BY {part} ORDER BY {v}) + (count(*) OVER (PARTITION BY {part}, {v}) - 1)/2)"


_SCORES = f"scores AS (SELECT cell_type, gene, count(*) AS n, CASE WHEN count(*) >= 3 THEN {r_sql('prediction', 'truth')} END AS r FROM expr GROUP BY ALL)"


def scores(spark, sf):
    return V.pearson(T.expr(spark, sf), KEYS, "prediction", "truth")


@query("pearson_by_gene", "A17", "WITH " + _SCORES + " SELECT * FROM scores", ctes="expr", floats="r")
def pearson_by_gene(spark, sf):
    return scores(spark, sf)


def _t_tail(r: str, n: str) -> str:
    """Two-sided t tail for integer degrees of freedom by its finite trigonometric sums."""
    v, th = f"({n}-2)", f"atan(abs({r})*sqrt({n}-2)/sqrt(1-{r}*{r})/sqrt({n}-2))"
    c, s = f"cos({th})", f"sin({th})"
    even = (f"{s}*list_reduce(list_prepend(1.0::DOUBLE, list_transform(range({v}//2-1, 0, -1), lambda k: k::DOUBLE)), "
            f"lambda acc, k: 1.0 + acc*{c}*{c}*(2*k-1)/(2*k))")
    odd = (f"2/pi()*({th} + CASE WHEN {v} > 1 THEN {s}*{c}*list_reduce(list_prepend(1.0::DOUBLE, "
           f"list_transform(range(({v}-1)//2-1, 0, -1), lambda k: k::DOUBLE)), lambda acc, k: 1.0 + acc*{c}*{c}*(2*k)/(2*k+1)) ELSE 0 END)")
    return f"(1 - CASE WHEN {v} % 2 = 0 THEN {even} ELSE {odd} END)"


@query("pearson_pvalues", "A17 X3", "WITH s AS (SELECT cell_type, count(*) AS n, gene % 20 AS gene_set, "
       + r_sql("prediction", "truth") + " AS r FROM expr GROUP BY ALL) SELECT cell_type, gene_set, n, r, " + _t_tail("r", "n") + " AS pvalue FROM s",
       ctes="expr", floats="r pvalue", digits=8)
def pearson_pvalues(spark, sf):
    rows = T.expr(spark, sf).withColumn("gene_set", F.col("gene") % 20)
    return V.pearson(rows, ["cell_type", "gene_set"], "prediction", "truth", with_p=True)


_RHO = f"""(SELECT *, {rank_sql('cell_type, gene', 'prediction')} AS rx, {rank_sql('cell_type, gene', 'truth')} AS ry FROM expr)"""


@query("spearman_by_gene", "A18", f"""SELECT cell_type, gene, count(*) AS n, CASE WHEN count(*) >= 3 THEN {r_sql('rx', 'ry')} END AS rho
FROM {_RHO} GROUP BY ALL""", ctes="expr", floats="rho")
def spearman_by_gene(spark, sf):
    return V.spearman(T.expr(spark, sf), KEYS, "prediction", "truth")


@query("error_metrics_by_gene", "A19", f"""SELECT cell_type, gene, count(*) AS n, sqrt(avg((prediction-truth)*(prediction-truth))) AS rmse,
 avg(abs(prediction-truth)) AS mae, CASE WHEN count(*) >= 3 THEN {r_sql('prediction', 'truth')} END AS r,
 CASE WHEN count(*) >= 3 THEN {r_sql('rx', 'ry')} END AS rho FROM {_RHO} GROUP BY ALL""",
       ctes="expr", floats="rmse mae r rho", digits=7)
def error_metrics_by_gene(spark, sf):
    return V.error_metrics(T.expr(spark, sf), KEYS, "prediction", "truth")


@query("error_metrics_global", "A19", f"""SELECT count(*) AS n, sqrt(avg((prediction-truth)*(prediction-truth))) AS rmse,
 avg(abs(prediction-truth)) AS mae, {r_sql('prediction', 'truth')} AS r, {r_sql('rx', 'ry')} AS rho
 FROM (SELECT *, {rank_sql('1', 'prediction')} AS rx, {rank_sql('1', 'truth')} AS ry FROM expr)""",
       ctes="expr", floats="rmse mae r rho", digits=7)
def error_metrics_global(spark, sf):
    return V.error_metrics(T.expr(spark, sf), [], "prediction", "truth")


@query("mean_correlations", "A30", f"""
SELECT a AS mean_across_genes, b AS mean_across_cell_types, (a+b)/2 AS mean_of_both FROM
(SELECT avg(r) AS a FROM (SELECT {r_sql('prediction', 'truth')} AS r FROM expr GROUP BY cell_type)),
(SELECT avg(r) AS b FROM (SELECT {r_sql('prediction', 'truth')} AS r FROM expr GROUP BY gene HAVING count(*) >= 2))""",
       ctes="expr", floats="mean_across_genes mean_across_cell_types mean_of_both")
def mean_correlations(spark, sf):
    return V.mean_correlations(T.expr(spark, sf), "prediction", "truth")


_T100 = "(SELECT i, i/100.0::DOUBLE AS threshold FROM (SELECT unnest(range(101)) AS i))"


@query("survival_curve", "A20", "WITH " + _SCORES + f"""
SELECT cell_type, threshold, count(r) AS n_genes, count_if(abs(r) >= threshold)/count(r) AS survival FROM scores, {_T100}
WHERE r IS NOT NULL GROUP BY ALL""", ctes="expr", floats="threshold survival")
def survival_curve(spark, sf):
    return V.survival_curve(scores(spark, sf), ["cell_type"])


@query("survival_auc", "A20", "WITH " + _SCORES + f""",
c AS (SELECT cell_type, i, count(r) AS n_genes, count_if(abs(r) >= threshold)/count(r) AS s FROM scores, {_T100} WHERE r IS NOT NULL GROUP BY ALL)
SELECT cell_type, max(n_genes) AS n_genes, sum((s + nxt)/200) AS auc FROM (SELECT *, lead(s) OVER (PARTITION BY cell_type ORDER BY i) AS nxt FROM c) GROUP BY ALL""",
       ctes="expr", floats="auc")
def survival_auc(spark, sf):
    return V.survival_auc(scores(spark, sf), ["cell_type"])


@query("survival_auc_pooled", "A20", "WITH " + _SCORES + f""",
c AS (SELECT i, count(r) AS n_genes, count_if(abs(r) >= threshold)/count(r) AS s FROM scores, {_T100} WHERE r IS NOT NULL GROUP BY ALL)
SELECT max(n_genes) AS n_genes, sum((s + nxt)/200) AS auc FROM (SELECT *, lead(s) OVER (ORDER BY i) AS nxt FROM c)""",
       ctes="expr", floats="auc")
def survival_auc_pooled(spark, sf):
    return V.survival_auc(scores(spark, sf), [])


@query("sign_accuracy", "A21", "WITH " + _SCORES + """
SELECT cell_type, threshold, count_if(abs(r) >= threshold) AS n_at, count_if(abs(r) >= threshold AND r > 0)/nullif(count_if(abs(r) >= threshold), 0) AS accuracy
FROM scores, (SELECT i/20.0::DOUBLE AS threshold FROM (SELECT unnest(range(21)) AS i)) WHERE r IS NOT NULL GROUP BY ALL""",
       ctes="expr", floats="threshold accuracy")
def sign_accuracy(spark, sf):
    return V.sign_accuracy(scores(spark, sf), ["cell_type"])


@query("pvalue_histogram", "A22", """
SELECT k.cell_type, k.arm, CAST(b AS INT) AS bin, count(d.gene) AS n FROM (SELECT DISTINCT cell_type, arm FROM draws) k
JOIN (SELECT unnest(range(20)) AS b) ON true
LEFT JOIN draws d ON d.cell_type = k.cell_type AND d.arm = k.arm AND least(floor(d.pvalue*20), 19) = b GROUP BY ALL""", ctes="draws")
def pvalue_histogram(spark, sf):
    return V.pvalue_histogram(T.draws(spark, sf), ["cell_type", "arm"])


@query("significant_share", "A22", """SELECT cell_type, arm, count(pvalue) AS n_tested, count_if(pvalue <= 0.05) AS n_significant,
 count_if(pvalue <= 0.05)/count(pvalue) AS fraction_significant FROM draws GROUP BY ALL""", ctes="draws", floats="fraction_significant")
def significant_share(spark, sf):
    return V.significant_share(T.draws(spark, sf), ["cell_type", "arm"])


_CURVE = """g AS (SELECT i, round(0.05*i, 2)::DOUBLE AS t FROM (SELECT unnest(range(1, 20)) AS i)),
c AS (SELECT cell_type, arm, i, t, count(*)::DOUBLE AS m, count_if(pvalue >= t)::DOUBLE AS w, count_if(pvalue >= t)/(count(*)*(1-t)) AS p FROM draws, g GROUP BY cell_type, arm, i, t)"""


@query("null_fraction_bootstrap", "A23", "WITH " + _CURVE + """,
q AS (SELECT *, w/(m*m*(1-t)*(1-t))*(1-w/m) + pow(p - quantile_cont(p, 0.1) OVER (PARTITION BY cell_type, arm), 2) AS score FROM c),
b AS (SELECT cell_type, arm, max(m) AS m, greatest(0, least(1, arg_min(p, score))) AS pi0 FROM q GROUP BY ALL)
SELECT cell_type, arm, CAST(m AS BIGINT) AS n_tested, pi0, (1-pi0)*m AS m1, pi0 <= 0 OR pi0 >= 1 AS boundary FROM b""",
       ctes="draws", floats="pi0 m1", digits=7)
def null_fraction_bootstrap(spark, sf):
    return V.null_fraction(T.draws(spark, sf), ["cell_type", "arm"])


# End weights of the spline with 3 degrees of freedom on 0.05, 0.10, ..., 0.95, to nine places.
_SMOOTHER = [-0.002493138, -0.006528434, -0.010535252, -0.014436548, -0.018071643, -0.021165415, -0.023299763, -0.023889557,
             -0.022166442, -0.017175168, -0.007788558, 0.007251314, 0.029256809, 0.059473402, 0.098903043, 0.148062562,
             0.206669455, 0.273251357, 0.344681976]


@query("null_fraction_smoother", "A23", "WITH " + _CURVE + f""",
b AS (SELECT cell_type, arm, max(m) AS m, greatest(0, least(1, sum(p*({_SMOOTHER!r})[i]))) AS pi0 FROM c GROUP BY ALL)
SELECT cell_type, arm, CAST(m AS BIGINT) AS n_tested, pi0, (1-pi0)*m AS m1, pi0 <= 0 OR pi0 >= 1 AS boundary FROM b""",
       ctes="draws", floats="pi0 m1", digits=5)
def null_fraction_smoother(spark, sf):
    return V.null_fraction(T.draws(spark, sf), ["cell_type", "arm"], method="smoother")


@query("seed_summary", "A24", """
SELECT cell_type, arm, string_agg(CAST(draw AS VARCHAR), ',' ORDER BY CAST(draw AS VARCHAR)) AS seeds, avg(m) AS m_mean, coalesce(stddev_samp(m), 0) AS m_sd
FROM (SELECT cell_type, arm, draw, avg(zscore) AS m FROM draws GROUP BY ALL) GROUP BY ALL""", ctes="draws", floats="m_mean m_sd")
def seed_summary(spark, sf):
    per = T.draws(spark, sf).groupBy("cell_type", "arm", "draw").agg(F.avg("zscore").alias("m"))
    return V.seed_summary(per, ["cell_type", "arm"], ["m"], seed="draw")


@query("equal_count_curve", "A25", """
SELECT cell_type, max(n) AS n_valid, CAST(bin AS INT) AS bin, avg(truth) AS mean_y FROM (
 SELECT *, ntile(10) OVER (PARTITION BY cell_type ORDER BY prediction, gene, donor) - 1 AS bin, count(*) OVER (PARTITION BY cell_type) AS n FROM expr) GROUP BY cell_type, bin""",
       ctes="expr", floats="mean_y")
def equal_count_curve(spark, sf):
    return V.equal_count_curve(T.expr(spark, sf), ["cell_type"], "prediction", "truth", 10, tie=["gene", "donor"])


@query("within_gene_curve", "A25", """
WITH e AS (SELECT cell_type, gene, donor, uncertainty AS u, (prediction-truth)*(prediction-truth) AS e FROM expr),
b AS (SELECT *, ntile(4) OVER (PARTITION BY cell_type, gene ORDER BY u, donor) - 1 AS bin, count(*) OVER w AS n, max(u) OVER w - min(u) OVER w AS spread, avg(e) OVER w AS me
      FROM e WINDOW w AS (PARTITION BY cell_type, gene)),
p AS (SELECT cell_type, gene, bin, avg(e/me) AS rel FROM b WHERE n >= 4 AND spread > 2.3e-16 AND me > 2.3e-16 GROUP BY ALL)
SELECT cell_type, CAST(bin AS INT) AS bin, avg(rel) AS relative_error, count(*) AS n_genes FROM p GROUP BY ALL""",
       ctes="expr", floats="relative_error")
def within_gene_curve(spark, sf):
    return V.within_gene_curve(T.expr(spark, sf), ["cell_type"], "prediction", "truth", "uncertainty", 4)


_EU = f"""eu AS (SELECT *, (prediction-truth)*(prediction-truth) AS e FROM expr),
rk AS (SELECT *, {rank_sql('cell_type, gene', 'e')} AS rx, {rank_sql('cell_type, gene', 'uncertainty')} AS ry FROM eu),
rho AS (SELECT cell_type, gene, count(*) AS n, {r_sql('rx', 'ry')} AS rho FROM rk GROUP BY ALL HAVING count(*) >= 3 AND rho IS NOT NULL)"""


@query("error_uncertainty_rho", "A26", "WITH " + _EU + " SELECT * FROM rho", ctes="expr", floats="rho")
def error_uncertainty_rho(spark, sf):
    return V.error_uncertainty_rho(T.expr(spark, sf), KEYS, "prediction", "truth", "uncertainty")


@query("error_uncertainty_summary", "A26", "WITH " + _EU + """
SELECT cell_type, avg(rho) AS rho_mean, avg((round(rho, 12) > 0)::INT) AS frac_positive, median(rho) AS rho_median FROM rho GROUP BY ALL""",
       ctes="expr", floats="rho_mean frac_positive rho_median")
def error_uncertainty_summary(spark, sf):
    rhos = V.error_uncertainty_rho(T.expr(spark, sf), KEYS, "prediction", "truth", "uncertainty")
    # A rank correlation of exactly zero must not turn positive through the order of a sum.
    return V.rho_summary(rhos.withColumn("rho", F.round("rho", 12)), ["cell_type"])


@query("uncertainty_calibration", "A27", f"""
WITH e AS (SELECT cell_type, gene, donor, uncertainty AS u, (prediction-truth)*(prediction-truth) AS e FROM expr),
b AS (SELECT *, ntile(15) OVER (PARTITION BY cell_type ORDER BY u, gene, donor) AS bin, {rank_sql('cell_type', 'e')} AS rx, {rank_sql('cell_type', 'u')} AS ry FROM e),
p AS (SELECT cell_type, bin, sqrt(greatest(avg(u), 1e-12)) AS ru, sqrt(avg(e)) AS re FROM b GROUP BY ALL),
n AS (SELECT cell_type, avg(abs(ru-re)/ru) AS ence FROM p GROUP BY ALL)
SELECT b.cell_type, count(*) AS n_pairs, avg(u) AS mean_uncertainty, avg(e) AS mean_squared_error, sqrt(avg(e)) AS rmse, max(ence) AS ence, {r_sql('rx', 'ry')} AS rho
FROM b JOIN n ON b.cell_type = n.cell_type GROUP BY ALL""", ctes="expr", floats="mean_uncertainty mean_squared_error rmse ence rho", digits=6)
def uncertainty_calibration(spark, sf):
    return V.calibration(T.expr(spark, sf), ["cell_type"], "prediction", "truth", "uncertainty", 15, tie=["gene", "donor"])


_BOX = """q AS (SELECT {k}, quantile_cont(v, 0.25) AS q1, median(v) AS med, quantile_cont(v, 0.75) AS q3 FROM v GROUP BY ALL)
SELECT {k}, q1, med, q3, min(v) FILTER (v >= q1-1.5*(q3-q1)) AS whislo, max(v) FILTER (v <= q3+1.5*(q3-q1)) AS whishi FROM v JOIN q USING ({k}) GROUP BY ALL"""


@query("box_stats", "A28", "WITH v AS (SELECT cell_type, truth AS v FROM expr), " + _BOX.format(k="cell_type"), ctes="expr", floats="q1 med q3 whislo whishi", digits=6)
def box_stats(spark, sf):
    return V.box_stats(T.expr(spark, sf), ["cell_type"], "truth")


@query("binned_error_boxes", "A28", """WITH v AS (SELECT cell_type, CAST(ntile(8) OVER (PARTITION BY cell_type ORDER BY uncertainty, gene, donor) - 1 AS INT) AS bin,
 (prediction-truth)*(prediction-truth) AS v FROM expr), """ + _BOX.format(k="cell_type, bin"), ctes="expr", floats="q1 med q3 whislo whishi", digits=6)
def binned_error_boxes(spark, sf):
    return V.binned_boxes(T.expr(spark, sf), ["cell_type"], "prediction", "truth", "uncertainty", 8, tie=["gene", "donor"])


@query("uncertainty_difficulty", "A29", f"""
SELECT cell_type, gene, count(*) AS n, CASE WHEN count(*) >= 3 THEN {r_sql('prediction', 'truth')} END AS r, avg(uncertainty) AS mean_uncertainty, 1 - abs(r) AS difficulty
FROM expr WHERE uncertainty >= 0 GROUP BY ALL""", ctes="expr", floats="r mean_uncertainty difficulty")
def uncertainty_difficulty(spark, sf):
    return V.difficulty(T.expr(spark, sf), ["cell_type"], "prediction", "truth", "uncertainty")


@query("difficulty_rho", "A29", f"""
WITH d AS (SELECT cell_type, gene, round({r_sql('prediction', 'truth')}, 10) AS r, round(avg(uncertainty) + 3.7e-11::DOUBLE, 8) AS u FROM expr GROUP BY ALL HAVING count(*) >= 3),
k AS (SELECT *, {rank_sql('cell_type', 'u')} AS rx, {rank_sql('cell_type', '1-abs(r)')} AS ry FROM d WHERE r IS NOT NULL)
SELECT cell_type, count(*) AS n, {r_sql('rx', 'ry')} AS rho FROM k GROUP BY ALL""", ctes="expr", floats="rho", digits=7)
def difficulty_rho(spark, sf):
    d = V.difficulty(T.expr(spark, sf), ["cell_type"], "prediction", "truth", "uncertainty")
    d = d.withColumns({"u": F.round(F.col("mean_uncertainty") + 3.7e-11, 8), "hard": 1.0 - F.abs(F.round("r", 10))})
    return V.spearman(d, ["cell_type"], "u", "hard")


_ABLATION = f"""r AS (SELECT *, row_number() OVER (PARTITION BY cell_type, gene ORDER BY uncertainty, donor) AS rn, count(*) OVER (PARTITION BY cell_type, gene) AS nv FROM expr),
s AS (SELECT cell_type, gene, percent_removed, count(*) AS n, {r_sql('prediction', 'truth')} AS r
      FROM r, (SELECT unnest([0, 10, 20, 50])::DOUBLE AS percent_removed) WHERE rn <= nv - floor(nv*(percent_removed/100)) GROUP BY ALL HAVING count(*) >= 3 AND r IS NOT NULL),
c AS (SELECT cell_type, percent_removed, i, count(*) AS n_genes, avg(n) AS mean_n, count_if(abs(r) >= threshold)/count(r) AS s FROM s, {_T100} GROUP BY ALL),
a AS (SELECT cell_type, percent_removed, max(n_genes) AS n_genes, max(mean_n) AS mean_n_individuals, sum((s+nxt)/200) AS auc
      FROM (SELECT *, lead(s) OVER (PARTITION BY cell_type, percent_removed ORDER BY i) AS nxt FROM c) GROUP BY ALL)"""


def _ablation(spark, sf):
    return V.ablation(T.expr(spark, sf), ["cell_type"], "prediction", "truth", "uncertainty", [0, 10, 20, 50])


@query("uncertainty_ablation", "W6", "WITH " + _ABLATION + " SELECT * FROM a", ctes="expr", floats="mean_n_individuals auc")
def uncertainty_ablation(spark, sf):
    return _ablation(spark, sf)


@query("ablation_change", "A50", "WITH " + _ABLATION + """, d AS (SELECT z.auc - o.auc AS change FROM a z JOIN a o USING (cell_type) WHERE z.percent_removed = 50 AND o.percent_removed = 0)
SELECT 'm' AS model, avg(change) AS mean_change, min(change) AS min_change, max(change) AS max_change, count(*) AS n FROM d""",
       ctes="expr", floats="mean_change min_change max_change")
def ablation_change(spark, sf):
    return V.ablation_change(_ablation(spark, sf).withColumn("model", F.lit("m")), ["model"])


@query("empirical_quantiles", "W10", f"""
SELECT cell_type, gene, donor, CASE WHEN count(*) OVER (PARTITION BY cell_type, gene) = 1 THEN 0.5 ELSE ({rank_sql('cell_type, gene', 'uncertainty')} - 1)/nullif(count(*) OVER (PARTITION BY cell_type, gene) - 1, 0) END AS quantile
FROM expr""", ctes="expr", floats="quantile")
def empirical_quantiles(spark, sf):
    rows = T.expr(spark, sf).select("cell_type", "gene", "donor", "uncertainty")
    return V.empirical_quantiles(rows, ["cell_type", "gene"], "uncertainty").drop("uncertainty")


@query("qq_points", "W12 X1", """
SELECT cell_type, arm, draw, gene, -log10((row_number() OVER w - 0.5)/count(*) OVER (PARTITION BY cell_type, arm)) AS expected, least(-log10(pvalue), 320) AS observed
FROM draws WINDOW w AS (PARTITION BY cell_type, arm ORDER BY pvalue, gene, draw)""", ctes="draws", floats="expected observed")
def qq_points(spark, sf):
    rows = T.draws(spark, sf).select("cell_type", "arm", "draw", "gene", "pvalue")
    return V.qq_points(rows, ["cell_type", "arm"], "pvalue", tie=["gene", "draw"]).drop("pvalue")


@query("matched_quantiles", "W12 A49", """
WITH i AS (SELECT unnest(range(20)) AS i),
q AS (SELECT cell_type, arm, quantile_cont(pvalue, [""" + ", ".join(f"{(i + 0.5) / 20}" for i in range(20)) + """]) AS qs FROM draws GROUP BY ALL)
SELECT cell_type, CAST(i AS INT) AS index, max(qs[i+1]) FILTER (arm = 'A') AS x, max(qs[i+1]) FILTER (arm = 'B') AS y FROM q, i GROUP BY ALL""",
       ctes="draws", floats="x y")
def matched_quantiles(spark, sf):
    return V.matched_quantiles(T.draws(spark, sf), ["cell_type"], "arm", ("A", "B"), "pvalue", 20)


@query("matched_quantile_share", "A49", """
WITH i AS (SELECT unnest(range(20)) AS i),
q AS (SELECT cell_type, arm, quantile_cont(-log10(pvalue), [""" + ", ".join(f"{(i + 0.5) / 20}" for i in range(20)) + """]) AS qs FROM draws GROUP BY ALL),
m AS (SELECT cell_type, i, max(qs[i+1]) FILTER (arm = 'A') AS x, max(qs[i+1]) FILTER (arm = 'B') AS y FROM q, i GROUP BY ALL)
SELECT cell_type, avg((y > x)::INT) AS share_above FROM m GROUP BY ALL""", ctes="draws", floats="share_above")
def matched_quantile_share(spark, sf):
    rows = T.draws(spark, sf).withColumn("strength", X.neglog10(F.col("pvalue")))
    return V.share_above(V.matched_quantiles(rows, ["cell_type"], "arm", ("A", "B"), "strength", 20), ["cell_type"])


@query("extreme_genes", "T3", "WITH " + _SCORES + """,
k AS (SELECT cell_type, gene, r*r AS r2, row_number() OVER (PARTITION BY cell_type ORDER BY r*r, gene) AS up, row_number() OVER (PARTITION BY cell_type ORDER BY r*r DESC, gene DESC) AS down
      FROM scores WHERE r IS NOT NULL)
SELECT cell_type, gene, r2, 'worst' AS "end", CAST(up AS INT) AS place FROM k WHERE up <= 4 UNION ALL SELECT cell_type, gene, r2, 'best', CAST(down AS INT) FROM k WHERE down <= 5""",
       ctes="expr", floats="r2")
def extreme_genes(spark, sf):
    return V.extreme_genes(scores(spark, sf).withColumn("r", F.round("r", 12)), ["cell_type"], 9)


@query("ranked_fits", "W13", "WITH " + _SCORES + """
SELECT cell_type, gene, n, r, row_number() OVER (PARTITION BY cell_type ORDER BY r, gene) AS rank FROM scores WHERE r IS NOT NULL""",
       ctes="expr", floats="r")
def ranked_fits(spark, sf):
    return V.ranked_fits(scores(spark, sf), ["cell_type"])


@query("ensemble_moments", "A34", """
SELECT gene, donor, avg(mean) AS prediction, avg(variance) AS aleatoric, greatest(avg(mean*mean) - avg(mean)*avg(mean), 0) AS epistemic, count(*) AS n_members,
 aleatoric + epistemic AS total FROM members GROUP BY ALL""", ctes="members", floats="prediction aleatoric epistemic total", digits=7)
def ensemble_moments(spark, sf):
    return V.ensemble_moments(T.members(spark, sf), ["gene", "donor"])


@query("total_variance", "A34", """
WITH w AS (SELECT l_partkey AS gene, l_linenumber AS member, CASE WHEN l_discount > 0.03 THEN l_discount - 0.06 ELSE 0 END AS weight FROM lineitem),
p AS (SELECT gene, member, avg(weight) AS m, var_pop(weight) AS s, count(*) AS n, count_if(weight <> 0) AS nz, count_if(weight > 0) AS pos, count_if(weight < 0) AS neg FROM w GROUP BY ALL)
SELECT gene, avg(m) AS mean, avg(s) AS within, var_pop(m) AS between, sum(nz)/sum(n) AS pip, coalesce(abs(sum(pos) - sum(neg))/nullif(sum(nz), 0), 0) AS sign_stability,
 within + between AS total FROM p GROUP BY gene""", floats="mean within between pip sign_stability total")
def total_variance(spark, sf):
    w = F.when(F.col("l_discount") > 0.03, F.col("l_discount") - 0.06).otherwise(0.0)
    rows = T.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("gene"), F.col("l_linenumber").alias("member"), w.alias("weight"))
    return V.total_variance(rows, ["gene"])


@query("variance_scale", "A33", """
SELECT cell_type, greatest(avg((truth-prediction)*(truth-prediction)/greatest(uncertainty, 1e-8)), 1e-8) AS alpha FROM expr GROUP BY ALL""",
       ctes="expr", floats="alpha", digits=2)
def variance_scale(spark, sf):
    return V.variance_scale(T.expr(spark, sf), ["cell_type"], "truth", "prediction", "uncertainty")


@query("variance_agreement", "A32", f"""
WITH m AS (SELECT cell_type, gene, avg(uncertainty)*100 AS p, var_pop(truth) AS e FROM expr GROUP BY ALL HAVING count(*) >= 2)
SELECT cell_type, count(*) AS n, {r_sql('p', 'e')} AS r, avg(p)/avg(e) AS variance_ratio, 1 - avg((p-e)*(p-e))/var_pop(e) AS r2,
 sqrt(avg(pow(sqrt(p)-sqrt(e), 2))) AS std_rmse, sqrt(avg(pow(sqrt(p)-sqrt(e), 2)))/avg(sqrt(e)) AS std_nrmse FROM m GROUP BY ALL""",
       ctes="expr", floats="r variance_ratio r2 std_rmse std_nrmse", digits=7)
def variance_agreement(spark, sf):
    m = T.expr(spark, sf).groupBy("cell_type", "gene").agg(
        (F.avg("uncertainty") * 100).alias("p"), F.var_pop("truth").alias("e"), F.count(F.lit(1)).alias("c")).filter("c >= 2")
    return V.variance_agreement(m, ["cell_type"], "p", "e")


@query("evaluation_losses", "A35", f"""
SELECT cell_type, avg(pow(prediction-truth, 2)) AS mse, avg(greatest(prediction, 1e-8) - truth*ln(greatest(prediction, 1e-8))) AS poisson_nll,
 {r_sql('prediction', 'truth')} AS pearson, sum(prediction*truth)/(sqrt(sum(prediction*prediction))*sqrt(sum(truth*truth))) AS cosine,
 avg(0.5*(ln(greatest(uncertainty, 1e-2)) + pow(prediction-truth, 2)/greatest(uncertainty, 1e-2))) AS gaussian_nll FROM expr GROUP BY ALL""",
       ctes="expr", floats="mse poisson_nll pearson cosine gaussian_nll", digits=5)
def evaluation_losses(spark, sf):
    return V.losses(T.expr(spark, sf).withColumn("uncertainty", F.greatest("uncertainty", F.lit(1e-2))), ["cell_type"],
                    "prediction", "truth", variance="uncertainty")


@query("correlation_losses", "A35 A30", f"""
WITH c AS (SELECT {r_sql('prediction', 'truth')} AS r FROM expr GROUP BY cell_type HAVING count(*) >= 2), g AS (SELECT {r_sql('prediction', 'truth')} AS r FROM expr GROUP BY gene HAVING count(*) >= 2)
SELECT -((SELECT avg(r) FROM c) + (SELECT avg(r) FROM g)) AS mutual_correlation_loss, 2 - (SELECT avg(coalesce(r, 0)) FROM c) - (SELECT avg(coalesce(r, 0)) FROM g) AS cosine_loss""",
       ctes="expr", floats="mutual_correlation_loss cosine_loss")
def correlation_losses(spark, sf):
    return V.correlation_losses(T.expr(spark, sf), "prediction", "truth")


_MAGNITUDE = ("avg({0})/avg(e) AS {1}variance_ratio, 1 - avg(({0}-e)*({0}-e))/var_pop(e) AS {1}r2, sqrt(avg(pow(sqrt({0})-sqrt(e), 2))) AS {1}std_rmse, "
              "sqrt(avg(pow(sqrt({0})-sqrt(e), 2)))/avg(sqrt(e)) AS {1}std_nrmse")


@query("variance_report", "A32", f"""
WITH m AS (SELECT cell_type, gene, avg(uncertainty)*100 AS p, avg(uncertainty)*50 AS u, var_pop(truth) AS e FROM expr GROUP BY ALL HAVING count(*) >= 2),
w AS (SELECT (SELECT avg(r) FROM (SELECT {r_sql('p', 'e')} AS r FROM m GROUP BY cell_type)) AS pearson_macro, {r_sql('p', 'e')} AS pearson_pooled, {_MAGNITUDE.format('p', '')}, {_MAGNITUDE.format('u', 'uncalibrated_')} FROM m)
SELECT metric, value FROM (UNPIVOT w ON COLUMNS(*) INTO NAME metric VALUE value)""", ctes="expr", floats="value", digits=7)
def variance_report(spark, sf):
    m = T.expr(spark, sf).groupBy("cell_type", "gene").agg(
        (F.avg("uncertainty") * 100).alias("p"), F.var_pop("truth").alias("e"), F.count(F.lit(1)).alias("c")).filter("c >= 2")
    return V.variance_report(m, "p", "e", 2.0)


_SIDE = "avg(pow({0}-{1}, 2)) AS {2}, {3} AS {4}std_corr, avg({0})/avg({1}) AS {4}std_ratio, avg({0}) AS {4}pred_std, avg({1}) AS {4}target_std"


@query("head_metrics", "M5", f"""
WITH h AS (SELECT cell_type, gene, CASE WHEN gene = 7 THEN prediction*100 ELSE prediction END AS mu, truth AS y, uncertainty AS a, truth/1000 AS ya, uncertainty*2 AS e, prediction/1000 AS ye FROM expr),
s AS (SELECT *, sqrt(a+e) AS p, sqrt(ya+ye) AS t, sqrt(a) AS pa, sqrt(ya) AS ta, sqrt(e) AS pe, sqrt(ye) AS te FROM h),
g AS (SELECT cell_type, gene, count(*) AS n, max(abs(mu)) > 1000 AS diverged, avg(pow(mu-y, 2)) AS mean_w2, {r_sql('mu', 'y')} AS r, 1 - avg(pow(mu-y, 2))/var_pop(y) AS r2,
 {_SIDE.format('p', 't', 'std_w2', r_sql('p', 't'), '')}, {_SIDE.format('pa', 'ta', 'aleatoric_w2', r_sql('pa', 'ta'), 'aleatoric_')}, {_SIDE.format('pe', 'te', 'epistemic_w2', r_sql('pe', 'te'), 'epistemic_')} FROM s GROUP BY ALL)
SELECT cell_type, gene, n, diverged, target_std, aleatoric_target_std, epistemic_target_std, CASE WHEN NOT diverged AND n > 1 THEN mean_w2 + std_w2 END AS w2, CASE WHEN NOT diverged AND n > 1 THEN r2 END AS r2,
 CASE WHEN NOT diverged AND n > 1 THEN std_corr END AS std_corr, CASE WHEN NOT diverged AND n > 1 THEN aleatoric_std_ratio END AS aleatoric_std_ratio, CASE WHEN NOT diverged AND n > 1 THEN epistemic_w2 END AS epistemic_w2 FROM g""",
       ctes="expr", floats="target_std aleatoric_target_std epistemic_target_std w2 r2 std_corr aleatoric_std_ratio epistemic_w2", digits=6)
def head_metrics(spark, sf):
    e = T.expr(spark, sf)
    rows = e.select("cell_type", "gene", F.when(F.col("gene") == 7, F.col("prediction") * 100).otherwise(F.col("prediction")).alias("mu"), F.col("truth").alias("y"),
                    F.col("uncertainty").alias("aleatoric"), (F.col("truth") / 1000).alias("y_aleatoric"), (F.col("uncertainty") * 2).alias("epistemic"),
                    (F.col("prediction") / 1000).alias("y_epistemic"))
    return V.head_metrics(rows, KEYS).select("cell_type", "gene", "n", "diverged", "target_std", "aleatoric_target_std", "epistemic_target_std", "w2", "r2",
                                             "std_corr", "aleatoric_std_ratio", "epistemic_w2")


@query("centred_cosine", "A35", f"SELECT gene, {r_sql('prediction', 'truth')} AS centred_cosine FROM expr GROUP BY gene", ctes="expr", floats="centred_cosine")
def centred_cosine(spark, sf):
    return V.centred_cosine(T.expr(spark, sf), ["gene"], "prediction", "truth")


@query("fit_diagnostics", "A45", """
WITH l AS (SELECT cell_type, gene, donor % 3 AS part, prediction/1000 AS p, truth AS y FROM expr),
f AS (SELECT cell_type, gene, 1 - avg(pow(y - p, 2)) FILTER (part = 0)/nullif(var_pop(y) FILTER (part = 0), 0) AS r2, 1 - avg(pow(y - p, 2)) FILTER (part > 0)/nullif(var_pop(y) FILTER (part > 0), 0) AS r2_train,
  CASE WHEN stddev_pop(y) FILTER (part = 0)*stddev_pop(p) FILTER (part = 0) > 0 THEN corr(y, p) FILTER (part = 0) END AS r,
  CASE WHEN stddev_pop(y) FILTER (part > 0)*stddev_pop(p) FILTER (part > 0) > 0 THEN corr(y, p) FILTER (part > 0) END AS rt,
  count(*) FILTER (part = 0) AS n_nonzero, stddev_pop(y) AS sy, stddev_pop(p) AS sp FROM l GROUP BY ALL),
g AS (SELECT *, 1 - r*r AS pvalue FROM f WHERE r IS NOT NULL AND rt IS NOT NULL)
SELECT cell_type, count(*) AS n_genes, avg(r) AS mean_r, avg(r2) AS mean_r2, avg(r2_train) AS mean_r2_train, avg(n_nonzero) AS mean_nonzero, avg(rt - r) AS mean_gap, avg(pvalue) AS mean_pvalue,
 count_if(pvalue < 0.05) AS n_significant, stddev_pop(r) AS sd_r, corr(sy, sp) AS sd_corr, median(r) AS median_r, median(r2) AS median_r2, median(n_nonzero) AS median_nonzero, median(pvalue) AS median_pvalue FROM g GROUP BY ALL""",
       ctes="expr", floats="mean_r mean_r2 mean_r2_train mean_nonzero mean_gap mean_pvalue sd_r sd_corr median_r median_r2 median_nonzero median_pvalue", digits=6)
def fit_diagnostics(spark, sf):
    """A third of the donors held out: R2 of both parts from the errors, r beside it, and 1 - r^2 in the place of a p-value."""
    rows = T.expr(spark, sf).select("cell_type", "gene", (F.col("donor") % 3 == 0).alias("held"), (F.col("prediction") / 1000).alias("p"), F.col("truth").alias("y"))

    def of(flag, column):
        return F.when(F.col("held") == flag, F.col(column))

    def r2(flag):
        return 1 - F.try_divide(F.avg(F.pow(of(flag, "y") - of(flag, "p"), 2)), F.nullif(F.var_pop(of(flag, "y")), F.lit(0.0)))

    fits = rows.groupBy("cell_type", "gene").agg(
        r2(True).alias("r2"), r2(False).alias("r2_train"), X.safe_corr(of(True, "y"), of(True, "p")).alias("r"), X.safe_corr(of(False, "y"), of(False, "p")).alias("r_train"),
        F.count_if("held").alias("n_nonzero"), F.stddev_pop("y").alias("sd_true"), F.stddev_pop("p").alias("sd_predicted"))
    fits = fits.filter("r is not null and r_train is not null").withColumn("pvalue", 1 - F.col("r") * F.col("r"))
    return V.fit_diagnostics(fits, ["cell_type"])


@query("weighted_fit_quality", "A46", """
WITH e AS (SELECT cell_type, uncertainty AS u, prediction-truth AS error, greatest(uncertainty, 0.02) AS s FROM expr)
SELECT cell_type, pow(sum(1/(s*s)), 2)/sum(1/pow(s, 4)) AS effective_n, avg((u < 0.02)::INT) AS floored_fraction, avg(error*error/(s*s))/1e6 AS whitened_mse,
 avg(0.5*(ln(2*pi()*s*s) + error*error/(s*s)))/1e6 AS gaussian_nll FROM e GROUP BY ALL""", ctes="expr",
       floats="effective_n floored_fraction whitened_mse gaussian_nll", digits=6)
def weighted_fit_quality(spark, sf):
    rows = T.expr(spark, sf).select("cell_type", (F.col("prediction") - F.col("truth")).alias("error"), F.col("uncertainty").alias("sigma"))
    return V.weighted_fit_quality(rows, ["cell_type"], sigma_floor=0.02).withColumns(
        {"whitened_mse": F.col("whitened_mse") / 1e6, "gaussian_nll": F.col("gaussian_nll") / 1e6})


@query("zscore_histogram", "A51", """
WITH e AS (SELECT cell_type, min(zscore) AS lo, max(zscore) AS hi FROM draws GROUP BY ALL)
SELECT cell_type, CAST(least(floor((zscore-lo)*60/(hi-lo)), 59) AS INT) AS bin, count(*) AS n FROM draws JOIN e USING (cell_type) GROUP BY ALL""", ctes="draws")
def zscore_histogram(spark, sf):
    return V.histogram(T.draws(spark, sf), ["cell_type"], "zscore", 60)


@query("aligned_tables", "J9", """
SELECT a.gene, a.donor, a.prediction, b.truth FROM (SELECT * FROM expr WHERE cell_type = 'A') a JOIN (SELECT * FROM expr WHERE cell_type = 'R') b
ON a.gene = b.gene AND a.donor = b.donor""", ctes="expr", floats="prediction truth", digits=6)
def aligned_tables(spark, sf):
    e = T.expr(spark, sf)
    return V.align({"prediction": e.filter("cell_type = 'A'").select("gene", "donor", F.col("prediction").alias("value")),
                    "truth": e.filter("cell_type = 'R'").select("gene", "donor", F.col("truth").alias("value"))}, ["gene", "donor"])


@query("harmonised_donors", "J9", """
SELECT member, donor, count(*) AS n FROM members WHERE variance > 0.079 AND donor IN (SELECT donor FROM members WHERE variance > 0.079 GROUP BY donor
 HAVING count(DISTINCT member) = (SELECT count(DISTINCT member) FROM members WHERE variance > 0.079)) GROUP BY ALL""", ctes="members")
def harmonised_donors(spark, sf):
    m = T.members(spark, sf).filter("variance > 0.079")
    return V.harmonised_donors(m, model="member").groupBy("member", "donor").agg(F.count(F.lit(1)).alias("n"))

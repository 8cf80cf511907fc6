"""Variants, covariance, scoring, edits, sequences and fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as T
from ..registry import query, sql_norm_ppf
from ...functions.ordered import top_k
from ...functions.storage import bounded_batches, reusable
from ...operators import evaluation as V, fits as M, packed as PK, genotype as G


@query("allele_frequencies", "F6 S3", """
SELECT snp, coalesce(avg(dosage)/2, 0) AS frequency, count(dosage) AS n_called, least(frequency, 1 - frequency) AS maf FROM genotypes GROUP BY snp""",
       ctes="genotypes", floats="frequency maf")
def allele_frequencies(spark, sf):
    return G.allele_frequencies(G.dosages(T.genotypes(spark, sf)))


@query("common_variants", "F6", """
SELECT snp, count(*) AS n FROM genotypes WHERE snp IN (SELECT snp FROM genotypes GROUP BY snp HAVING least(avg(dosage)/2, 1 - avg(dosage)/2) >= 0.45) GROUP BY snp""",
       ctes="genotypes")
def common_variants(spark, sf):
    return G.common_variants(T.genotypes(spark, sf), 0.45).groupBy("snp").agg(F.count(F.lit(1)).alias("n"))


_COV = """
m AS (SELECT *, coalesce(dosage, avg(dosage) OVER (PARTITION BY snp)) AS x FROM genotypes),
c AS (SELECT *, x - avg(x) OVER (PARTITION BY snp) AS d FROM m)"""


def _covariance(spark, sf, **kw):
    g = T.genotypes(spark, sf)
    places = g.select("gene", "snp").distinct().withColumn("bp", F.col("snp") * 100)
    return G.gene_covariance(places, g.select("snp", "donor", "dosage"), **kw)


@query("gene_covariance", "A4 J17 S3 K4", "WITH " + _COV + """
SELECT a.gene, a.snp AS snp1, b.snp AS snp2, sum(a.d*b.d)/(count(*) - 1) AS value FROM c a JOIN c b ON a.gene = b.gene AND a.donor = b.donor AND a.snp <= b.snp GROUP BY ALL""",
       ctes="genotypes", floats="value")
def gene_covariance(spark, sf):
    return _covariance(spark, sf)[0]


@query("gene_covariance_tiled", "A4 J17", "WITH " + _COV + """
SELECT a.gene, a.snp AS snp1, b.snp AS snp2, sum(a.d*b.d)/(count(*) - 1) AS value FROM c a JOIN c b ON a.gene = b.gene AND a.donor = b.donor AND a.snp <= b.snp GROUP BY ALL""",
       ctes="genotypes", floats="value")
def gene_covariance_tiled(spark, sf):
    return _covariance(spark, sf, tile=3, chunk=100)[0]


@query("covariance_snps", "A4 F17 K4", "WITH " + _COV + " SELECT gene, snp, snp*100 AS bp, stddev_samp(x) AS sd FROM m GROUP BY ALL HAVING stddev_samp(x) > 0",
       ctes="genotypes", floats="sd")
def covariance_snps(spark, sf):
    return _covariance(spark, sf)[1]


@query("covariance_genes", "A4 F17", "SELECT gene, min(snp)*100 AS start_bp, max(snp)*100 AS end_bp, CAST((min(snp)*100 + max(snp)*100)//2 AS BIGINT) AS mid_bp, count(DISTINCT snp) AS n_snps_in_cov "
       "FROM genotypes GROUP BY gene HAVING count(DISTINCT snp) <= 8", ctes="genotypes")
def covariance_genes(spark, sf):
    return _covariance(spark, sf, max_snps=8)[2]


_W = "w AS (SELECT 'e' || (l_partkey % 40) AS gene, l_partkey % 90 AS snp, avg(l_discount) - 0.05 AS weight FROM lineitem GROUP BY ALL), i AS (SELECT DISTINCT 'e' || (s_suppkey % 45) AS gene, (s_suppkey % 45)/10.0 AS intercept FROM supplier)"


def _scoring(spark, sf):
    w = T.table(spark, sf, "lineitem").groupBy(F.concat(F.lit("e"), F.col("l_partkey") % 40).alias("gene"), (F.col("l_partkey") % 90).alias("snp")).agg(
        (F.avg("l_discount") - 0.05).alias("weight"))
    slot = F.col("s_suppkey") % 45
    base = T.table(spark, sf, "supplier").select(F.concat(F.lit("e"), slot).alias("gene"), (slot / 10.0).alias("intercept")).distinct()
    return w, base, T.genotypes(spark, sf).select("snp", "donor", "dosage")


@query("score_genotypes", "M8 J18 K6", "WITH " + _W + """, s AS (SELECT w.gene, g.donor, sum(weight*coalesce(dosage, 0)) AS s FROM w JOIN genotypes g USING (snp) GROUP BY ALL)
SELECT gene, donor, s + coalesce(intercept, 0) AS value FROM s LEFT JOIN i USING (gene)
UNION ALL SELECT i.gene, d.donor, intercept FROM i, (SELECT DISTINCT donor FROM genotypes) d WHERE i.gene NOT IN (SELECT gene FROM w)""",
       ctes="genotypes", floats="value", digits=8)
def score_genotypes(spark, sf):
    return G.score(*_scoring(spark, sf))


@query("unscorable_genes", "J18", """
SELECT DISTINCT l_partkey AS gene FROM lineitem WHERE l_partkey NOT IN (SELECT snp FROM genotypes)""", ctes="genotypes")
def unscorable_genes(spark, sf):
    w = T.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("gene"), F.col("l_partkey").alias("snp"))
    return G.unscorable_genes(w, T.genotypes(spark, sf))


@query("prediction_distribution", "M9 A34", """
WITH s AS (SELECT l_partkey AS gene, l_suppkey AS donor, l_linenumber AS member, l_discount AS value FROM lineitem),
m AS (SELECT gene, donor, member, avg(value) AS m FROM s GROUP BY ALL)
SELECT s.gene, s.donor, avg(value) AS mean, var_pop(value) AS variance, (SELECT var_pop(m) FROM m WHERE m.gene = s.gene AND m.donor = s.donor) AS between_members FROM s GROUP BY s.gene, s.donor""",
       floats="mean variance between_members")
def prediction_distribution(spark, sf):
    s = T.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("gene"), F.col("l_suppkey").alias("donor"),
                                              F.col("l_linenumber").alias("member"), F.col("l_discount").alias("value"))
    return G.prediction_distribution(s)


def _design(spark, sf):
    """Genotypes with two targets per (gene, donor) built from the dosages."""
    g = T.genotypes(spark, sf)
    means = g.groupBy("snp").agg(F.avg("dosage").alias("mean"))
    rows = g.join(means, "snp").select("gene", "snp", (F.col("snp") * 100).alias("bp"), "donor",
                                       F.coalesce(F.col("dosage").cast("double"), "mean").alias("x"))
    noise = (F.col("donor") * 7919 % 1009) / 1009.0
    signal = F.sum(F.when(F.col("snp") % 8 == 1, F.col("x")).when(F.col("snp") % 8 == 4, -F.col("x")).otherwise(0.0))
    targets = rows.groupBy("gene", "donor").agg((signal + noise).alias("y"), (signal * 0.5 - noise).alias("y2"))
    return rows, targets


_DESIGN = """
d AS (SELECT gene, snp, donor, coalesce(dosage, avg(dosage) OVER (PARTITION BY snp)) AS x FROM genotypes),
t AS (SELECT gene, donor, sum(CASE WHEN snp % 8 = 1 THEN x WHEN snp % 8 = 4 THEN -x ELSE 0 END) AS s, ((donor*7919) % 1009)/1009.0 AS e FROM d GROUP BY ALL),
r AS (SELECT d.*, s + e AS y, s*0.5 - e AS y2 FROM d JOIN t USING (gene, donor))"""


@query("design_rows", "M1 J2 F6", """
WITH g AS (SELECT l_orderkey AS snp, l_suppkey AS donor, CASE WHEN max(l_quantity) > 10 THEN max(l_linenumber) % 3 END AS dosage FROM lineitem GROUP BY ALL),
f AS (SELECT snp, avg(dosage) AS mean FROM g GROUP BY snp HAVING least(coalesce(avg(dosage)/2, 0), 1 - coalesce(avg(dosage)/2, 0)) >= 0.1)
SELECT p.gene, v.snp, v.bp, g.donor, coalesce(g.dosage, f.mean) AS x FROM gene_pos p JOIN variants v ON v.chrom = p.chrom AND v.bp BETWEEN p.bp - 20000 AND p.bp + 20000
JOIN f USING (snp) JOIN g USING (snp)""", ctes="gene_pos variants", floats="x")
def design_rows(spark, sf):
    calls = T.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("snp"), F.col("l_suppkey").alias("donor")).agg(
        F.when(F.max("l_quantity") > 10, F.max("l_linenumber") % 3).alias("dosage"))
    genes = T.gene_pos(spark, sf).withColumnRenamed("bp", "tss")
    return M.design_rows(genes, T.variants(spark, sf), calls, window=20000, min_maf=0.1)


@query("screen_snps", "T2 M2", "WITH " + _DESIGN + """,
k AS (SELECT gene, snp, greatest(abs(covar_pop(x, y))/stddev_pop(x), abs(covar_pop(x, y2))/stddev_pop(x)) AS score FROM r GROUP BY ALL)
SELECT gene, snp, score, CAST(row_number() OVER (PARTITION BY gene ORDER BY score DESC, snp) AS INT) AS rank FROM k QUALIFY rank <= 3""", ctes="genotypes", floats="score")
def screen_snps(spark, sf):
    rows, targets = _design(spark, sf)
    scored = G.screen(rows.join(targets, ["gene", "donor"]), ["gene"], ["y", "y2"])
    return top_k(scored, ["gene"], [F.col("score").desc(), F.col("snp")], 3)


@query("screen_snps_weighted", "T2 M6", "WITH " + _DESIGN + """,
v AS (SELECT *, 1.0/(1 + e2) AS w FROM (SELECT *, (donor % 5) AS e2 FROM r)),
k AS (SELECT gene, snp, sum(w*x)/sum(w) AS mx, sum(w*y)/sum(w) AS my, sum(w*x*y)/sum(w) AS mxy, sum(w*x*x)/sum(w) AS mxx FROM v GROUP BY ALL)
SELECT gene, snp, abs(mxy - mx*my)/sqrt(mxx - mx*mx) AS score FROM k""", ctes="genotypes", floats="score", digits=8)
def screen_snps_weighted(spark, sf):
    rows, targets = _design(spark, sf)
    weighted = rows.join(targets, ["gene", "donor"]).withColumn("w", 1.0 / (1 + F.col("donor") % 5))
    return G.screen(weighted, ["gene"], ["y"], weight="w")


def _fits(spark, sf, names=("y",), **kw):
    rows, targets = _design(spark, sf)
    return M.fit_genes(rows, targets.withColumn("cell_type", F.lit("c")), names, **kw)


def _standard(fits, rows, targets, names):
    """One row per (gene, target, donor, snp) of the kept fits: standardised dosage z, coefficient w and target t."""
    gene = F.col("gene").cast("string").alias("gene")
    truth = targets.select(gene, "donor", *[F.col(n).cast("double").alias(n) for n in names]).unpivot(
        ["gene", "donor"], list(names), "target", "y")
    terms = fits.select("gene", "target", "alpha", "y_mean", "y_scale", F.explode(F.arrays_zip("snps", "coefs", "x_mean", "x_scale")).alias("v"))
    x = rows.select(gene, F.col("snp").cast("string").alias("snp"), "donor", "x")
    return terms.select("*", F.col("v.snps").alias("snp")).join(x, ["gene", "snp"]).join(truth, ["gene", "target", "donor"]).select(
        "gene", "target", "donor", "snp", "alpha", F.col("v.coefs").alias("w"),
        ((F.col("x") - F.col("v.x_mean")) / F.col("v.x_scale")).alias("z"), ((F.col("y") - F.col("y_mean")) / F.col("y_scale")).alias("t"))


def _optimal(fits, rows, targets, names, l1=None):
    """Whether every coefficient of a fit meets its condition: the gradient equals the penalty's, or lies within it at 0."""
    part = reusable(_standard(fits, rows, targets, names))
    left = part.groupBy("gene", "target", "donor").agg((F.first("t") - F.sum(F.col("w") * F.col("z"))).alias("e"))
    slope = part.join(left, ["gene", "target", "donor"]).groupBy("gene", "target", "snp").agg(
        F.sum(F.col("z") * F.col("e")).alias("g"), F.count(F.lit(1)).alias("n"), F.first("w").alias("w"), F.first("alpha").alias("alpha"))
    w, alpha = F.col("w"), F.col("alpha")
    if l1 is None:
        met = F.abs(F.col("g") - alpha * w) < 1e-6
    else:
        rest = F.col("g") / F.col("n") - alpha * (1 - l1) * w
        met = F.when(w != 0, F.abs(rest - alpha * l1 * F.signum(w)) < 1e-6).otherwise(F.abs(rest) <= alpha * l1 + 1e-6)
    return slope.groupBy("gene", "target").agg(F.bool_and(met).alias("optimal"), F.count(F.lit(1)).alias("n_snps"))


_TEST = "greatest(2, least(CAST(round_even(n*0.2, 0) AS BIGINT), n - 3))"
_FOLDS = """,
f AS (SELECT gene, donor, CASE WHEN rn <= """ + _TEST + """ THEN 'heldout' ELSE 'insample' END AS part FROM (SELECT gene, donor, count(*) OVER (PARTITION BY gene) AS n,
  row_number() OVER (PARTITION BY gene ORDER BY CAST('0x' || substr(md5('42|' || gene || '|' || donor), 1, 15) AS BIGINT), donor) AS rn FROM t))"""


@query("fit_elastic_net", "M1 M2 M4 M7 K5 W13", """
WITH c AS (SELECT gene, count(DISTINCT snp) AS k, count(DISTINCT donor) AS n FROM genotypes GROUP BY gene)
SELECT CAST(gene AS VARCHAR) AS gene, 'y' AS target, true AS optimal, k AS n_snps, n - """ + _TEST + """ AS n_train, """ + _TEST + """ AS n_test,
 true AS heldout_agrees, true AS better_than_none FROM c""", ctes="genotypes", longs="n_train n_test")
def fit_elastic_net(spark, sf):
    """Conditions of the optimum, and the held-out R2 worked out again from the held-out weights."""
    rows, targets = _design(spark, sf)
    fits = reusable(M.fit_genes(rows, targets.withColumn("cell_type", F.lit("c"))))
    folded = M.fold_targets(targets.withColumn("cell_type", F.lit("c")), ["y"])
    gene = F.col("gene").cast("string").alias("gene")
    held = fits.select("gene", "heldout_offset", F.explode(F.arrays_zip("heldout_snps", "heldout_weights")).alias("v"))
    x = rows.select(gene, F.col("snp").cast("string").alias("snp"), "donor", "x")
    guess = held.select("gene", "heldout_offset", F.col("v.heldout_snps").alias("snp"), F.col("v.heldout_weights").alias("w")).join(
        x, ["gene", "snp"]).groupBy("gene", "donor").agg((F.first("heldout_offset") + F.sum(F.col("w") * F.col("x"))).alias("p"))
    test = folded.filter(F.col("fold") == M.TEST).select(gene, "donor", "y").join(guess, ["gene", "donor"])
    again = test.groupBy("gene").agg((1 - F.sum(F.pow(F.col("y") - F.col("p"), 2)) / (F.var_pop("y") * F.count("y"))).alias("r2"))
    agrees = F.abs(F.col("r2") - F.col("heldout_r2")) < 1e-9
    return _optimal(fits, rows, targets, ["y"], M.L1_RATIO).join(fits.select(
        "gene", "n_train", "n_test", "heldout_r2"), "gene").join(again, "gene").select(
        "gene", "target", "optimal", "n_snps", "n_train", "n_test", agrees.alias("heldout_agrees"), (F.col("heldout_r2") > 0).alias("better_than_none"))


@query("fit_rank_quality", "M4 A18", "WITH " + _DESIGN + _FOLDS + """,
k AS (SELECT gene, snp, regr_slope(y, x) AS b, row_number() OVER (PARTITION BY gene ORDER BY abs(covar_pop(x, y))/stddev_pop(x) DESC, snp) AS rn
  FROM r JOIN f USING (gene, donor) WHERE part = 'insample' GROUP BY gene, snp),
q AS (SELECT gene, part, sign(b) AS s, rank() OVER (PARTITION BY gene, part ORDER BY x) + (count(*) OVER (PARTITION BY gene, part, x) - 1)/2.0 AS rx,
  rank() OVER (PARTITION BY gene, part ORDER BY y) + (count(*) OVER (PARTITION BY gene, part, y) - 1)/2.0 AS ry FROM r JOIN f USING (gene, donor) JOIN k USING (gene, snp) WHERE rn = 1)
SELECT 'c' AS cell_type, CAST(gene AS VARCHAR) AS gene, 'y' AS target, any_value(s)*corr(rx, ry) FILTER (part = 'heldout') AS heldout_rho,
 any_value(s)*corr(rx, ry) FILTER (part = 'insample') AS insample_rho FROM q GROUP BY gene""", ctes="genotypes", floats="heldout_rho insample_rho", digits=8)
def fit_rank_quality(spark, sf):
    """One SNP per gene, so the ranks of the prediction are those of the SNP, up to the sign of its weight."""
    rows, targets = _design(spark, sf)
    targets = targets.withColumn("cell_type", F.lit("c"))
    fits = reusable(M.fit_genes(rows, targets, model="ridge", alpha=50.0, screen_to=1))
    return M.rank_quality(fits, rows, M.fold_targets(targets, ["y"]), ["y"])


@query("fit_three_heads", "M5", "WITH " + _DESIGN + """,
h AS (SELECT gene, snp, donor, x, y AS mean, ln(1 + abs(y2)) AS aleatoric, ln(1 + abs(y - y2)) AS epistemic FROM r),
k AS (SELECT gene, snp, avg(x) AS mx, count(*)/(count(*) + 50.0) AS shrink, regr_slope(mean, x) AS bm, avg(mean) AS am, regr_slope(aleatoric, x) AS ba, avg(aleatoric) AS aa,
  regr_slope(epistemic, x) AS be, avg(epistemic) AS ae, greatest(abs(covar_pop(x, mean)), abs(covar_pop(x, aleatoric)), abs(covar_pop(x, epistemic)))/stddev_pop(x) AS score FROM h GROUP BY gene, snp),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY gene ORDER BY score DESC, snp) = 1)
SELECT 'c' AS cell_type, CAST(gene AS VARCHAR) AS gene, donor, am + bm*shrink*(x - mx) AS mu, greatest(exp(aa + ba*shrink*(x - mx)) - 1, 0) AS aleatoric,
 greatest(exp(ae + be*shrink*(x - mx)) - 1, 0) AS epistemic FROM h JOIN b USING (gene, snp)""", ctes="genotypes", floats="mu aleatoric epistemic", digits=7)
def fit_three_heads(spark, sf):
    """Mean and two log1p variance heads fitted together on the one SNP that serves any of them best."""
    rows, targets = _design(spark, sf)
    targets = targets.select(F.lit("c").alias("cell_type"), "gene", "donor", F.col("y").alias("mean"),
                             F.log1p(F.abs("y2")).alias("aleatoric"), F.log1p(F.abs(F.col("y") - F.col("y2"))).alias("epistemic"))
    fits = reusable(M.fit_genes(rows, targets, ("mean", "aleatoric", "epistemic"), model="ridge", alpha=50.0, screen_to=1))
    return M.predict_heads(fits, rows)


@query("fit_two_heads", "M5 M3", "WITH " + _DESIGN + """,
c AS (SELECT a.gene, max(CASE WHEN a.snp < b.snp THEN pow(corr_, 2) END) AS top, count(DISTINCT a.snp) AS k FROM (SELECT a.gene, a.snp AS s1, b.snp AS s2, corr(a.x, b.x) AS corr_ FROM d a JOIN d b USING (gene, donor) GROUP BY ALL) p
  JOIN (SELECT DISTINCT gene, snp FROM d) a ON a.gene = p.gene AND a.snp = s1 JOIN (SELECT DISTINCT gene, snp FROM d) b ON b.gene = p.gene AND b.snp = s2 GROUP BY a.gene)
SELECT CAST(gene AS VARCHAR) AS gene, unnest(['y', 'y2']) AS target, true AS optimal, CASE WHEN top < 0.1 THEN k END AS n_snps FROM c""", ctes="genotypes", longs="n_snps")
def fit_two_heads(spark, sf):
    """Normal equations of both ridge heads; no pair is correlated enough to be pruned, as SQL sees for itself."""
    rows, targets = _design(spark, sf)
    fits = reusable(M.fit_genes(rows, targets.withColumn("cell_type", F.lit("c")), ("y", "y2"), model="ridge"))
    return _optimal(fits, rows, targets, ["y", "y2"])


@query("fit_fixed_ridge", "M4 M2", "WITH " + _DESIGN + """,
k AS (SELECT gene, snp, regr_slope(y, x) AS b, count(*) AS n, row_number() OVER (PARTITION BY gene ORDER BY abs(covar_pop(x, y))/stddev_pop(x) DESC, snp) AS rn FROM r GROUP BY gene, snp)
SELECT CAST(gene AS VARCHAR) AS gene, CAST(snp AS VARCHAR) AS snp, b*(n*1.0)/(n + 50) AS weight FROM k WHERE rn = 1""", ctes="genotypes", floats="weight")
def fit_fixed_ridge(spark, sf):
    return M.raw_weights(_fits(spark, sf, model="ridge", alpha=50.0, screen_to=1)).select("gene", "snp", "weight")


# The one best SNP of each gene, screened on the training donors and on all; the penalty by the summed errors of three folds.
_CHOICE = """WITH """ + _DESIGN + _FOLDS.replace("CASE WHEN rn <= ", "rn, CASE WHEN rn <= ") + """,
u AS (SELECT r.gene, snp, donor, x, y, rn % 3 AS fold FROM r JOIN f USING (gene, donor) WHERE part = 'insample'),
pick AS (SELECT gene, snp, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy, count(*) AS n FROM u GROUP BY gene, snp
 QUALIFY row_number() OVER (PARTITION BY gene ORDER BY abs(covar_pop(x, y))/stddev_pop(x) DESC, snp) = 1),
every AS (SELECT gene, snp, stddev_pop(x) AS sx, stddev_pop(y) AS sy, corr(x, y)*count(*) AS g, count(*) AS n FROM r GROUP BY gene, snp
 QUALIFY row_number() OVER (PARTITION BY gene ORDER BY abs(covar_pop(x, y))/stddev_pop(x) DESC, snp) = 1),
s AS (SELECT gene, fold, (x - mx)/sx AS z, (y - my)/sy AS t FROM u JOIN pick USING (gene, snp)),
total AS (SELECT gene, sum(z*t) AS g, count(*) AS n FROM s GROUP BY gene),
grid AS (SELECT gene, i, {grid} AS alpha FROM total, (SELECT unnest(range(15)) AS i)),
parts AS (SELECT DISTINCT gene, fold AS part FROM s),
c AS (SELECT s.gene, part, avg(z) AS cz, avg(t) AS ct FROM s JOIN parts USING (gene) WHERE fold <> part GROUP BY ALL),
m AS (SELECT s.gene, part, sum((z - cz)*(z - cz)) AS zz, sum((z - cz)*(t - ct)) AS zt, count(*) AS k FROM s JOIN c USING (gene) WHERE fold <> part GROUP BY ALL),
o AS (SELECT s.gene, part, avg((t - ct)*(t - ct)) AS tt, avg((t - ct)*(z - cz)) AS tz, avg((z - cz)*(z - cz)) AS oo FROM s JOIN c USING (gene) WHERE fold = part GROUP BY ALL),
w AS (SELECT gene, part, i, alpha, {w_fold} AS w FROM m JOIN grid USING (gene)),
loss AS (SELECT gene, i, alpha, sum(tt - 2*w*tz + w*w*oo) AS e FROM w JOIN o USING (gene, part) GROUP BY ALL),
best AS (SELECT gene, alpha FROM loss QUALIFY row_number() OVER (PARTITION BY gene ORDER BY round(e, 11), i) = 1)
SELECT CAST(gene AS VARCHAR) AS gene, alpha, CAST(p.snp AS VARCHAR) AS heldout_snp, {w_held}*p.sy/p.sx AS heldout_weight, CAST(v.snp AS VARCHAR) AS kept_snp, {w_kept}*v.sy/v.sx AS kept_weight
FROM best JOIN pick p USING (gene) JOIN total t USING (gene) JOIN every v USING (gene)"""


def _net(g: str, square: str, n: str) -> str:
    """Optimum of an elastic net with one SNP."""
    return f"(sign({g})*greatest(abs({g}) - {n}*alpha*0.5, 0)/({square} + {n}*alpha*0.5))"


def _chosen(fits):
    weight = lambda coefs, place: F.get(coefs, F.lit(place))
    return fits.select("gene", "alpha", F.get("heldout_snps", F.lit(0)).alias("heldout_snp"), weight("heldout_weights", 0).alias("heldout_weight"),
                       F.get("snps", F.lit(0)).alias("kept_snp"), (weight("coefs", 0) * F.col("y_scale") / weight("x_scale", 0)).alias("kept_weight"))


@query("penalty_choice_net", "M4 M1 M2 M7", _CHOICE.format(
    grid="abs(g)/(n*0.5)*pow(1e-3, i/14.0)", w_fold=_net("zt", "zz", "k"), w_held=_net("t.g", "t.n", "t.n"), w_kept=_net("v.g", "v.n", "v.n")),
       ctes="genotypes", floats="alpha heldout_weight kept_weight", digits=8)
def penalty_choice_net(spark, sf):
    """Penalty, SNPs and weights of elastic nets over a shared design, one SNP each, as the closed form has them."""
    g = T.genotypes(spark, sf)
    _, targets = _design(spark, sf)
    variants = g.select("snp").distinct().select(F.lit("1").alias("chrom"), "snp", (F.col("snp") * 100).alias("bp"))
    genes = g.select("gene").distinct().select("gene", F.lit("1").alias("chrom"), (F.col("gene") * 800 + 350).alias("tss"))
    shared = PK.design(genes, variants, g.select("snp", "donor", "dosage"), M.donor_places(g), window=350)
    return _chosen(PK.fit_genes(shared, targets.withColumn("cell_type", F.lit("c")), screen_to=1))


@query("penalty_choice_ridge", "M4 M2", _CHOICE.format(
    grid="pow(10, -6 + 12*i/14.0)", w_fold="zt/(zz + alpha)", w_held="(t.g/(t.n + alpha))", w_kept="(v.g/(v.n + alpha))"),
       ctes="genotypes", floats="alpha heldout_weight kept_weight", digits=8)
def penalty_choice_ridge(spark, sf):
    return _chosen(_fits(spark, sf, model="ridge", screen_to=1))


@query("pruned_snps", "M3", """
WITH RECURSIVE d AS (SELECT gene, snp, donor, coalesce(dosage, avg(dosage) OVER (PARTITION BY snp)) AS x FROM genotypes),
h AS (SELECT a.gene, a.snp, a.donor, CASE WHEN a.snp % 2 = 1 AND a.donor % 4 > 0 THEN b.x ELSE a.x END AS x FROM d a JOIN d b ON b.gene = a.gene AND b.donor = a.donor AND b.snp = a.snp - a.snp % 2),
near AS (SELECT a.gene, a.snp, [b.snp] AS bad FROM h a JOIN h b ON b.gene = a.gene AND b.donor = a.donor AND b.snp < a.snp GROUP BY a.gene, a.snp, b.snp HAVING pow(corr(a.x, b.x), 2) >= 0.1),
lists AS (SELECT gene, snp, flatten(list(bad)) AS bad FROM near GROUP BY ALL),
places AS (SELECT gene, snp, row_number() OVER (PARTITION BY gene ORDER BY snp) AS k FROM (SELECT DISTINCT gene, snp FROM h)),
walk AS (SELECT gene, k, [snp] AS kept FROM places WHERE k = 1
 UNION ALL SELECT p.gene, p.k, CASE WHEN len(list_intersect(w.kept, coalesce(l.bad, []))) = 0 THEN list_append(w.kept, p.snp) ELSE w.kept END
 FROM walk w JOIN places p ON p.gene = w.gene AND p.k = w.k + 1 LEFT JOIN lists l ON l.gene = p.gene AND l.snp = p.snp)
SELECT CAST(gene AS VARCHAR) AS gene, array_to_string(kept, ' ') AS snps FROM walk QUALIFY row_number() OVER (PARTITION BY gene ORDER BY k DESC) = 1""", ctes="genotypes")
def pruned_snps(spark, sf):
    """Every second SNP is its neighbour but for a quarter of the donors: ridge fits keep the first of such a pair."""
    rows, targets = _design(spark, sf)
    first = rows.filter("snp % 2 = 0").select("gene", F.col("snp").alias("pair"), "donor", F.col("x").alias("x0"))
    mixed = rows.withColumn("pair", F.col("snp") - F.col("snp") % 2).join(first, ["gene", "pair", "donor"]).withColumn(
        "x", F.when((F.col("snp") % 2 == 1) & (F.col("donor") % 4 > 0), F.col("x0")).otherwise(F.col("x"))).select(*rows.columns)
    return M.fit_genes(mixed, targets.withColumn("cell_type", F.lit("c")), model="ridge", alpha=50.0).select("gene", F.array_join("snps", " ").alias("snps"))


@query("fit_bootstrap_ensemble", "M6 A34", """
SELECT CAST(gene AS VARCHAR) AS gene, member, bootstrap, true AS optimal, true AS centred, count(DISTINCT snp) AS n_snps
FROM genotypes, (SELECT unnest(['m1', 'm2']) AS member), (SELECT unnest(range(3)) AS bootstrap) GROUP BY ALL""", ctes="genotypes", longs="bootstrap")
def fit_bootstrap_ensemble(spark, sf):
    """Conditions of the optimum of every weighted bootstrap fit, and its intercept, from the drawn counts."""
    rows, targets = _design(spark, sf)
    member = F.explode(F.array(F.lit("m1"), F.lit("m2"))).alias("member")
    members = targets.select("gene", "donor", member, "y", "y2").select(
        "gene", "member", "donor", F.when(F.col("member") == "m1", F.col("y")).otherwise(F.col("y2")).alias("mean"),
        (0.1 + (F.col("donor") % 3) / 10.0).alias("sigma"))
    alphas = rows.select("gene").distinct().withColumn("alpha", F.lit(0.05))
    fits = reusable(M.bootstrap_fits(rows, members, alphas, n_bootstraps=3))
    donors = targets.select("gene", "donor").distinct()
    gene = F.col("gene").cast("string").alias("gene")
    drawn = M.multiplicities(donors, donors, 3).select(gene, "bootstrap", "donor", "multiplicity")
    weighted = members.select(gene, "member", "donor", "mean", F.pow("sigma", F.lit(-2.0)).alias("p")).join(drawn, ["gene", "donor"])
    x = rows.select(gene, F.col("snp").cast("string").alias("snp"), "donor", "x")
    spread = x.groupBy("gene", "snp").agg(F.stddev_pop("x").alias("sd"), F.count(F.lit(1)).alias("n"))
    keys = ["gene", "member", "bootstrap"]
    part = reusable(fits.join(spread, ["gene", "snp"]).join(x, ["gene", "snp"]).join(weighted, [*keys, "donor"]).withColumn(
        "share", F.col("p") * F.col("multiplicity")))
    left = part.groupBy(*keys, "donor").agg((F.first("mean") - F.first("intercept") - F.sum(F.col("weight") * F.col("x"))).alias("e"))
    share = F.col("share") / F.col("total")
    total = weighted.groupBy(*keys).agg(F.sum(F.col("p") * F.col("multiplicity")).alias("total"))
    slope = part.join(left, [*keys, "donor"]).join(total, keys).groupBy(*keys, "snp").agg(
        (F.sum(share * F.col("x") * F.col("e")) / F.first("sd")).alias("g"), F.sum(share * F.col("e")).alias("middle"),
        (F.first("weight") * F.first("sd")).alias("w"))
    w, alpha, l1 = F.col("w"), 0.05, M.L1_RATIO
    rest = F.col("g") - alpha * (1 - l1) * w
    met = F.when(w != 0, F.abs(rest - alpha * l1 * F.signum(w)) < 1e-6).otherwise(F.abs(rest) <= alpha * l1 + 1e-6)
    return slope.groupBy(*keys).agg(F.bool_and(met).alias("optimal"), F.bool_and(F.abs("middle") < 1e-9).alias("centred"),
                                    F.count(F.lit(1)).alias("n_snps"))


@query("fit_rank_quality_net", "M4 A18", """
SELECT CAST(gene AS VARCHAR) AS gene, 'y' AS target, true AS optimal, count(DISTINCT snp) AS n_snps, true AS heldout_agrees, true AS insample_agrees,
 true AS several FROM genotypes GROUP BY gene""", ctes="genotypes")
def fit_rank_quality_net(spark, sf):
    """Elastic nets over all screened SNPs: conditions of the optimum, and both rank correlations worked out again from the held-out weights."""
    rows, targets = _design(spark, sf)
    typed = targets.withColumn("cell_type", F.lit("c"))
    fits = reusable(M.fit_genes(rows, typed, alpha=0.02))
    folded = M.fold_targets(typed, ["y"])
    gene = F.col("gene").cast("string").alias("gene")
    held = fits.select("gene", "heldout_offset", F.explode(F.arrays_zip("heldout_snps", "heldout_weights")).alias("v")).select(
        "gene", "heldout_offset", F.col("v.heldout_snps").alias("snp"), F.col("v.heldout_weights").alias("w"))
    x = rows.select(gene, F.col("snp").cast("string").alias("snp"), "donor", "x")
    guess = held.join(x, ["gene", "snp"]).groupBy("gene", "donor").agg((F.first("heldout_offset") + F.sum(F.col("w") * F.col("x"))).alias("p"))
    part = F.when(F.col("fold") == M.TEST, "heldout").otherwise("insample").alias("part")
    pairs = folded.select(gene, "donor", part, "y").join(guess, ["gene", "donor"])
    order = lambda c: (F.expr(f"rank() OVER (PARTITION BY gene, part ORDER BY {c})")
                       + (F.expr(f"count(*) OVER (PARTITION BY gene, part, {c})") - 1) / 2.0)
    pairs = pairs.select("gene", "part", order("round(p, 12)").alias("rp"), order("y").alias("ry"))
    again = pairs.groupBy("gene").agg(*(F.corr(F.when(F.col("part") == n, F.col("rp")), F.when(F.col("part") == n, F.col("ry"))).alias(n)
                                        for n in ("heldout", "insample")))
    several = held.groupBy("gene").agg((F.count_if(F.col("w") != 0) > 1).alias("several"))
    rho = M.rank_quality(fits, rows, folded, ["y"])
    return _optimal(fits, rows, targets, ["y"], M.L1_RATIO).join(rho, ["gene", "target"]).join(again, "gene").join(several, "gene").select(
        "gene", "target", "optimal", "n_snps", (F.abs(F.col("heldout_rho") - F.col("heldout")) < 1e-6).alias("heldout_agrees"),
        (F.abs(F.col("insample_rho") - F.col("insample")) < 1e-6).alias("insample_agrees"), "several")


@query("fit_three_heads_net", "M5", """
SELECT CAST(gene AS VARCHAR) AS gene, unnest(['mean', 'aleatoric', 'epistemic']) AS target, true AS optimal, n_snps, n, false AS diverged, true AS agrees
FROM (SELECT gene, count(DISTINCT snp) AS n_snps, count(DISTINCT donor) AS n FROM genotypes GROUP BY gene)""", ctes="genotypes")
def fit_three_heads_net(spark, sf):
    """Joint elastic nets of the mean and two log1p variance heads over all screened SNPs: conditions of each optimum, and the
    metrics of the heads against the mean squared error worked out again from the coefficients."""
    rows, targets = _design(spark, sf)
    names = ("mean", "aleatoric", "epistemic")
    heads = targets.select(F.lit("c").alias("cell_type"), "gene", "donor", F.col("y").alias("mean"),
                           F.log1p(F.abs("y2")).alias("aleatoric"), F.log1p(F.abs(F.col("y") - F.col("y2"))).alias("epistemic"))
    fits = reusable(M.fit_genes(rows, heads, names, alpha=0.02))
    truth = heads.select("cell_type", F.col("gene").cast("string").alias("gene"), "donor", F.col("mean").alias("y"),
                         F.expm1("aleatoric").alias("y_aleatoric"), F.expm1("epistemic").alias("y_epistemic"))
    metrics = V.head_metrics(M.predict_heads(fits, rows).join(truth, ["cell_type", "gene", "donor"]), ["cell_type", "gene"])
    terms = _standard(fits, rows, heads, names).filter("target = 'mean'").join(fits.select("gene", "target", "y_scale"), ["gene", "target"])
    left = terms.groupBy("gene", "donor").agg((F.first("y_scale") * (F.first("t") - F.sum(F.col("w") * F.col("z")))).alias("e"))
    again = left.groupBy("gene").agg(F.avg(F.col("e") * F.col("e")).alias("mse"))
    return _optimal(fits, rows, heads, names, M.L1_RATIO).join(metrics, "gene").join(again, "gene").select(
        "gene", "target", "optimal", "n_snps", "n", "diverged", (F.abs(F.col("mean_w2") - F.col("mse")) < 1e-9).alias("agrees"))


@query("bootstrap_inclusion", "M6 A34", """
SELECT CAST(gene AS VARCHAR) AS gene, count(DISTINCT snp) AS n_snps, true AS masked, true AS split, true AS some FROM genotypes GROUP BY gene""", ctes="genotypes")
def bootstrap_inclusion(spark, sf):
    """Ensemble weights masked by inclusion, against the shares, means and total variances of the plain bootstrap weights."""
    rows, targets = _design(spark, sf)
    member = F.explode(F.array(F.lit("m1"), F.lit("m2"))).alias("member")
    members = targets.select("gene", "donor", member, "y", "y2").select(
        "gene", "member", "donor", F.when(F.col("member") == "m1", F.col("y")).otherwise(F.col("y2")).alias("mean"),
        (0.1 + (F.col("donor") % 3) / 10.0).alias("sigma"))
    fits = reusable(M.bootstrap_fits(rows, members, rows.select("gene").distinct().withColumn("alpha", F.lit(0.05)), n_bootstraps=3))
    masked = M.mask_by_inclusion(V.total_variance(fits, ["gene", "snp"])).select("gene", "snp", "weight", "total")
    plain = fits.groupBy("gene", "snp").agg((F.count_if(F.col("weight") != 0) / F.count("weight")).alias("share"),
                                            F.avg("weight").alias("middle"), F.var_pop("weight").alias("spread"))
    wanted = F.when(F.col("share") >= M.PIP_MASK, F.col("middle")).otherwise(0.0)
    return masked.join(plain, ["gene", "snp"]).groupBy("gene").agg(
        F.count(F.lit(1)).alias("n_snps"), F.bool_and(F.abs(F.col("weight") - wanted) < 1e-9).alias("masked"),
        F.bool_and(F.abs(F.col("total") - F.col("spread")) < 1e-9).alias("split"), F.bool_or(F.col("weight") != 0).alias("some"))


@query("bootstrap_counts", "M6", """
SELECT gene, b AS bootstrap, count(DISTINCT donor) AS total FROM genotypes, (SELECT unnest(range(4)) AS b) GROUP BY ALL""", ctes="genotypes", longs="bootstrap")
def bootstrap_counts(spark, sf):
    donors = T.genotypes(spark, sf).select("gene", "donor").distinct()
    return M.multiplicities(donors, donors, 4).groupBy("gene", "bootstrap").agg(F.sum("multiplicity").alias("total"))


_ECDF = """
v AS (SELECT cell_type, gene, donor, ln(1 + truth) AS y, uncertainty AS s FROM expr),
u AS (SELECT *, count(*) OVER (PARTITION BY cell_type, gene) AS n, (rank() OVER (PARTITION BY cell_type, gene ORDER BY y) + (count(*) OVER (PARTITION BY cell_type, gene, y) - 1)/2)/({0}) AS p FROM v),
k AS (SELECT DISTINCT cell_type, gene, y, p FROM u),
e AS (SELECT cell_type, gene, donor, n, y - s AS q, 1 AS side FROM u UNION ALL SELECT cell_type, gene, donor, n, y + s, 2 FROM u),
f AS (SELECT e.cell_type, e.gene, e.donor, e.n, side, q, max(k.y) FILTER (k.y <= q) AS y0, max(k.p) FILTER (k.y <= q) AS p0, min(k.y) FILTER (k.y > q) AS y1, min(k.p) FILTER (k.y > q) AS p1
      FROM e JOIN k USING (cell_type, gene) GROUP BY ALL),
g AS (SELECT *, CASE WHEN y0 IS NULL THEN {1} WHEN y0 = q THEN p0 WHEN y1 IS NULL THEN {2} ELSE p0 + (p1 - p0)*(q - y0)/(y1 - y0) END AS v FROM f)"""


@query("rank_spread_percentile", "W4", "WITH " + _ECDF.format("count(*) OVER (PARTITION BY cell_type, gene)", "0", "1") + """
SELECT cell_type, gene, donor, CASE WHEN max(n) = 1 THEN 0 ELSE 0.5*(max(v) FILTER (side = 2) - max(v) FILTER (side = 1)) END AS spread FROM g GROUP BY cell_type, gene, donor""",
       ctes="expr", floats="spread", digits=8)
def rank_spread_percentile(spark, sf):
    rows = T.expr(spark, sf).select("cell_type", "gene", "donor", F.col("truth").alias("value"), F.col("uncertainty").alias("sigma"))
    return G.rank_spread(rows, ["cell_type", "gene"])


@query("rank_spread_normal", "W4", "WITH " + _ECDF.format("count(*) OVER (PARTITION BY cell_type, gene) + 1", "1/(n+1)", "n/(n+1)") + ", z AS (SELECT *, " + sql_norm_ppf("v") + """ AS z FROM g)
SELECT cell_type, gene, donor, CASE WHEN max(n) = 1 THEN 0 ELSE 0.5*(max(z) FILTER (side = 2) - max(z) FILTER (side = 1)) END AS spread FROM z GROUP BY cell_type, gene, donor""",
       ctes="expr", floats="spread", digits=7)
def rank_spread_normal(spark, sf):
    rows = T.expr(spark, sf).select("cell_type", "gene", "donor", F.col("truth").alias("value"), F.col("uncertainty").alias("sigma"))
    return G.rank_spread(rows, ["cell_type", "gene"], form="normal")


# ---- edits and sequences -------------------------------------------------------------------

@query("variant_edits", "A48 J19 F15", """
WITH e AS (SELECT g.gene, o.o_custkey AS donor, v.bp - 1 - (g.bp - 20000) AS off, substr('ACGT', CAST(v.snp % 4 AS INT) + 1, 1) AS alt
  FROM gene_pos g JOIN variants v ON v.chrom = g.chrom AND v.bp BETWEEN g.bp - 20000 AND g.bp + 20000 JOIN orders o ON o.o_orderkey = v.snp
  WHERE o_orderstatus <> 'P' AND v.snp % 11 <> 0)
SELECT gene, donor, string_agg(off || alt, ',' ORDER BY off) AS edits FROM e GROUP BY ALL""", ctes="gene_pos variants")
def variant_edits(spark, sf):
    snp = F.col("snp")
    v = T.variants(spark, sf).select("chrom", "snp", "bp", F.lit("A").alias("ref"),
                                     F.concat(F.lit("ACGT").substr((snp % 4 + 1).cast("int"), F.lit(1)), F.when(snp % 11 == 0, "T").otherwise("")).alias("alt"))
    calls = T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("snp"), F.col("o_custkey").alias("donor"),
                                                F.when(F.col("o_orderstatus") == "P", 0).otherwise(1).alias("n_alt"), F.lit(2).alias("n_called"))
    genes = T.gene_pos(spark, sf).withColumnRenamed("bp", "tss")
    e = G.variant_edits(genes, v, calls, window=20000)
    return e.select("gene", "donor", F.array_join(F.transform("edits", lambda x: F.concat(x["offset"].cast("string"), x["alt"])), ",").alias("edits"))


@query("personalised_sequences", "X8", """
SELECT doc_id, md5(array_to_string(list_transform(string_split(text, ''), lambda c, i: CASE WHEN i - 1 = n_chars // 3 THEN 'N' WHEN i - 1 = 5 THEN 'T' ELSE c END), '')) AS digest FROM documents""")
def personalised_sequences(spark, sf):
    edits = F.map_from_arrays(F.array(F.lit(5), F.floor(F.col("n_chars") / 3).cast("int")), F.array(F.lit("T"), F.lit("N")))
    only = F.map_from_arrays(F.array(F.lit(5)), F.array(F.lit("N")))
    d = T.table(spark, sf, "documents").withColumn("edits", F.when(F.floor(F.col("n_chars") / 3) == 5, only).otherwise(edits))
    return d.select("doc_id", F.md5(G.apply_edits(F.col("text"), F.col("edits"))).alias("digest"))


@query("sequence_codes", "X8", """
WITH c AS (SELECT doc_id, upper(unnest(string_split(text, ''))) AS c FROM documents)
SELECT doc_id, count_if(c = 'A') AS n_a, count_if(c = 'C') AS n_c, count_if(c = 'G') AS n_g, count_if(c = 'T') AS n_t, count_if(c NOT IN ('A','C','G','T')) AS n_other FROM c GROUP BY doc_id""")
def sequence_codes(spark, sf):
    codes = G.base_codes(F.col("text"))
    d = bounded_batches(T.table(spark, sf, "documents")).select(
        "doc_id", G.channel_sums(G.one_hot(codes)).alias("sums"), G.unknown_bases(codes).alias("n_other"))
    return d.select("doc_id", *(F.col("sums")[k].alias(n) for k, n in enumerate(("n_a", "n_c", "n_g", "n_t"))), "n_other")


@query("centre_crops", "X8", """
SELECT doc_id, md5(substr(text, (length(text) - length(text)//2)//2 + 1, length(text)//2)) AS digest FROM documents""")
def centre_crops(spark, sf):
    half = F.floor(F.length("text") / 2).cast("int")
    return T.table(spark, sf, "documents").select("doc_id", F.md5(G.centre_crop(F.col("text"), half)).alias("digest"))


@query("window_sequences", "X7", """
WITH w AS (SELECT doc_id, length(text) AS n, text, CAST(s AS BIGINT) AS start, CAST(s + 500 AS BIGINT) AS "end" FROM documents, (SELECT unnest([-50, 100, 100000]) AS s)),
a AS (SELECT *, CASE WHEN start < 0 THEN 0 WHEN "end" > n THEN greatest(n - 500, 0) ELSE start END AS actual_start,
 CASE WHEN start < 0 THEN least(500, n) WHEN "end" > n THEN n ELSE "end" END AS actual_end FROM w)
SELECT doc_id AS chrom, start, "end", actual_start, actual_end, md5(CASE WHEN actual_start = 0 THEN repeat('N', 500 - (actual_end - actual_start)) || substr(text, actual_start + 1, actual_end - actual_start)
 ELSE substr(text, actual_start + 1, actual_end - actual_start) || repeat('N', 500 - (actual_end - actual_start)) END) AS digest FROM a""", longs="actual_start actual_end")
def window_sequences(spark, sf):
    seqs = T.table(spark, sf, "documents").select(F.col("doc_id").alias("chrom"), F.col("text").alias("sequence"))
    starts = F.explode(F.array(F.lit(-50), F.lit(100), F.lit(100000)).cast("array<bigint>")).alias("start")
    windows = seqs.select("chrom", starts).withColumn("end", F.col("start") + 500)
    out = G.window_sequences(windows, G.chunk_sequences(seqs, 300), 300)
    return out.select("chrom", "start", "end", "actual_start", "actual_end", F.md5("sequence").alias("digest"))


@query("central_bin_means", "X9", """
SELECT vec_id, f, avg(x) AS value FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(64)) AS pos, pos % 8 AS f, pos // 8 AS bin FROM embeddings) WHERE bin BETWEEN 2 AND 4 GROUP BY ALL""",
       floats="value", longs="f", digits=7)
def central_bin_means(spark, sf):
    bins = F.array(*[F.slice("embedding", 8 * i + 1, 8) for i in range(8)])
    e = T.table(spark, sf, "embeddings").select("vec_id", G.central_mean(bins, 3, 8).alias("m"))
    return e.select("vec_id", F.posexplode("m").alias("f", "value"))


@query("feature_log_flags", "M10 S20", """
WITH l AS (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS feature FROM embeddings),
s AS (SELECT feature, CASE WHEN feature % 2 = 0 THEN exp(x*8) ELSE x END AS v FROM l), m AS (SELECT feature, avg(v) AS m FROM s GROUP BY ALL)
SELECT CAST(feature AS INT) AS feature, min(v) AS low, avg(pow(v-m, 3))/pow(avg(pow(v-m, 2)), 1.5) AS skew, min(v) >= 0 AND avg(pow(v-m, 3))/pow(avg(pow(v-m, 2)), 1.5) > 1 AS log
FROM s JOIN m USING (feature) GROUP BY ALL""", floats="low skew", digits=7)
def feature_log_flags(spark, sf):
    values = F.transform("embedding", lambda x, i: F.when(i % 2 == 0, F.exp(x.cast("double") * 8)).otherwise(x.cast("double")))
    return G.log_flags(T.table(spark, sf, "embeddings").select(values.alias("features")))


@query("called_allele_frequencies", "S13 F6", """
SELECT o_custkey AS snp, sum(o_orderkey % 3)/sum(2.0*(o_orderkey % 4 > 0)::INT + 1) AS frequency, least(frequency, 1 - frequency) AS maf FROM orders GROUP BY o_custkey""", floats="frequency maf")
def called_allele_frequencies(spark, sf):
    calls = T.table(spark, sf, "orders").select(F.col("o_custkey").alias("snp"), (F.col("o_orderkey") % 3).alias("n_alt"),
                                                (2.0 * (F.col("o_orderkey") % 4 > 0).cast("int") + 1).alias("n_called"))
    return G.called_allele_frequencies(calls)

"""Arms, gene sets, reference lists and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as T
from ..registry import query, sql_bh, sql_norm_ppf
from ...functions import exprs as X
from ...operators import comparison as C, intervals as I, pooling as P

_ARMS = ("o AS (SELECT cell_type, arm, gene, min(pvalue) AS pvalue, avg(zscore) AS zscore FROM draws GROUP BY ALL), c AS ("
         + sql_bh("o", "cell_type, arm", "pvalue", fdr=0.05) + """),
m AS (SELECT a.cell_type, CAST(a.gene AS VARCHAR) AS gene_key, a.pvalue AS pa, b.pvalue AS pb, a.zscore AS za, b.zscore AS zb, a.significant_fdr AS fa, b.significant_fdr AS fb,
 a.significant_bonferroni AS ba, b.significant_bonferroni AS bb FROM c a JOIN c b ON a.cell_type = b.cell_type AND a.gene = b.gene AND a.arm = 'A' AND b.arm = 'B')""")


def matched(spark, sf):
    one = T.draws(spark, sf).groupBy("cell_type", "arm", "gene").agg(F.min("pvalue").alias("pvalue"), F.avg("zscore").alias("zscore"))
    called = P.annotate_significance(one, ["cell_type", "arm"])
    return C.match_arms(called.filter("arm = 'A'").drop("arm"), called.filter("arm = 'B'").drop("arm"), ["cell_type"])


@query("match_arms", "J7 F1", "WITH " + _ARMS + " SELECT cell_type, gene_key, pa AS pvalue_a, pb AS pvalue_b FROM m",
       ctes="draws", floats="pvalue_a pvalue_b")
def match_arms(spark, sf):
    return matched(spark, sf).select("cell_type", "gene_key", "pvalue_a", "pvalue_b")


_CORR = "CASE WHEN count(*) > 2 THEN covar_pop({0}, {1})/sqrt(var_pop({0})*var_pop({1})) END"


@query("arm_overlap", "A16", "WITH " + _ARMS + """,
s AS (SELECT cell_type, count(*)::DOUBLE AS n_genes_shared, count_if(fa AND fb) AS fdr_both, count_if(fa AND NOT fb) AS fdr_a_only, count_if(NOT fa AND fb) AS fdr_b_only,
 count_if(fa AND fb)/nullif(count_if(fa OR fb), 0) AS fdr_jaccard, count_if(ba AND bb) AS bonferroni_both, count_if(ba AND NOT bb) AS bonferroni_a_only,
 count_if(NOT ba AND bb) AS bonferroni_b_only, count_if(ba AND bb)/nullif(count_if(ba OR bb), 0) AS bonferroni_jaccard,
 avg(abs(za)) AS mean_abs_zscore_a, avg(abs(zb)) AS mean_abs_zscore_b, """ + _CORR.format("za", "zb") + " AS zscore_correlation, "
       + _CORR.format("pa", "pb") + """ AS pvalue_correlation FROM m GROUP BY ALL)
SELECT cell_type, unnest(['n_genes_shared','fdr_both','fdr_a_only','fdr_b_only','fdr_jaccard','bonferroni_both','bonferroni_a_only','bonferroni_b_only','bonferroni_jaccard',
 'mean_abs_zscore_a','mean_abs_zscore_b','zscore_correlation','pvalue_correlation']) AS metric,
 unnest([n_genes_shared, fdr_both, fdr_a_only, fdr_b_only, fdr_jaccard, bonferroni_both, bonferroni_a_only, bonferroni_b_only, bonferroni_jaccard,
 mean_abs_zscore_a, mean_abs_zscore_b, zscore_correlation, pvalue_correlation]) AS value FROM s""", ctes="draws", floats="value")
def arm_overlap(spark, sf):
    return C.arm_overlap(matched(spark, sf), ["cell_type"])


@query("call_status", "A51", "WITH " + _ARMS + """ SELECT cell_type, CASE WHEN ba AND bb THEN 'both' WHEN ba THEN 'only_a' WHEN bb THEN 'only_b' ELSE 'neither' END AS status,
 count(*) AS n FROM m GROUP BY ALL""", ctes="draws")
def call_status(spark, sf):
    return C.call_status(matched(spark, sf), ["cell_type"])


@query("largest_disagreements", "T7 X1", "WITH " + _ARMS + """ SELECT cell_type, gene_key, abs(-log10(pb) + log10(pa)) AS gap,
 CAST(row_number() OVER (PARTITION BY cell_type ORDER BY abs(-log10(pb) + log10(pa)) DESC, gene_key) AS INT) AS rank FROM m WHERE ba OR bb QUALIFY rank <= 10""",
       ctes="draws", floats="gap")
def largest_disagreements(spark, sf):
    return C.largest_disagreements(matched(spark, sf), ["cell_type"], 10)


_AB = "CASE WHEN l_linenumber < 4 THEN 'a' ELSE 'b' END"


@query("gene_attrition", "A44 U3", f"""
WITH mo AS (SELECT DISTINCT {_AB} AS arm, l_partkey AS gene FROM lineitem WHERE l_quantity > 30),
re AS (SELECT DISTINCT {_AB} AS arm, l_partkey AS gene FROM lineitem WHERE l_quantity > 40 AND l_tax > 0.03),
k AS (SELECT gene, bool_or(w = 'm' AND arm = 'a') AS ma, bool_or(w = 'm' AND arm = 'b') AS mb, bool_or(w = 'r' AND arm = 'a') AS ra, bool_or(w = 'r' AND arm = 'b') AS rb
      FROM (SELECT 'm' AS w, * FROM mo UNION ALL SELECT 'r', * FROM re) GROUP BY gene)
SELECT count_if(ma) AS n_model_a, count_if(mb) AS n_model_b, count_if(ma AND mb) AS n_shared_models, count_if(ra) AS n_result_a, count_if(rb) AS n_result_b,
 count_if(ra AND rb) AS n_shared_results, count_if(ma AND NOT ra) AS n_lost_a, count_if(mb AND NOT rb) AS n_lost_b,
 count_if(ra AND rb)/count_if(ma AND mb) AS frac_reaching_both FROM k""", floats="frac_reaching_both")
def gene_attrition(spark, sf):
    rows = T.table(spark, sf, "lineitem").withColumn("arm", F.when(F.col("l_linenumber") < 4, "a").otherwise("b")).withColumn("gene", F.col("l_partkey"))
    return C.gene_attrition(rows.filter("l_quantity > 30").select("arm", "gene"),
                            rows.filter("l_quantity > 40 AND l_tax > 0.03").select("arm", "gene"))


@query("restrict_to_list", "F11", """
WITH l AS (SELECT DISTINCT p_partkey AS gene FROM part WHERE p_size < 20 UNION SELECT p_partkey + 1000000000 FROM part WHERE p_size = 49), r AS (SELECT DISTINCT gene FROM results WHERE hit)
SELECT count(r.gene) AS n_in_model, count(l.gene) AS n_on_list, count_if(r.gene IS NOT NULL AND l.gene IS NOT NULL) AS n_kept,
 count_if(r.gene IS NULL) AS n_missing, count_if(l.gene IS NULL) AS n_off_list FROM r FULL JOIN l ON r.gene = l.gene""", ctes="results")
def restrict_to_list(spark, sf):
    p = T.table(spark, sf, "part")
    listed = p.filter("p_size < 20").select(F.col("p_partkey").alias("gene")).unionByName(
        p.filter("p_size = 49").select((F.col("p_partkey") + 1000000000).alias("gene")))
    return C.restrict_to_list(T.results(spark, sf).filter("hit"), listed)[1]


@query("restricted_rows", "F11", """SELECT cell_type, gene FROM results WHERE gene IN (SELECT p_partkey FROM part WHERE p_size < 20)""", ctes="results")
def restricted_rows(spark, sf):
    listed = T.table(spark, sf, "part").filter("p_size < 20").select(F.col("p_partkey").alias("gene"))
    return C.restrict_to_list(T.results(spark, sf), listed)[0].select("cell_type", "gene")


@query("pair_labels", "J8 F2", """
SELECT DISTINCT c_mktsegment AS left_name, CASE WHEN r.name IS NOT NULL THEN r.name END AS right_name FROM customer
LEFT JOIN (SELECT DISTINCT lower(c_mktsegment) || ' !' AS name, lower(c_mktsegment) AS k FROM customer WHERE c_mktsegment < 'G') r ON r.k = lower(c_mktsegment)""")
def pair_labels(spark, sf):
    names = T.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("cell_type")).distinct()
    other = names.filter("cell_type < 'G'").select(F.concat(F.lower("cell_type"), F.lit(" !")).alias("cell_type"))
    return C.pair_labels(names, other)


@query("shared_genes", "U1 S16", """
WITH l AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_discount > 0.08 AND l_tax > 0.05), r AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_discount < 0.02 AND l_tax < 0.03)
SELECT 'ensg' || k || '.1' AS gene, coalesce(p_name, '') AS symbol FROM l JOIN r USING (k) LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = k""")
def shared_genes(spark, sf):
    li = T.table(spark, sf, "lineitem")
    names = T.table(spark, sf, "part").filter("p_size > 10").select(
        F.concat(F.lit("ENSG"), "p_partkey").alias("gene"), F.col("p_name").alias("symbol"))
    left = li.filter("l_discount > 0.08 AND l_tax > 0.05").select(F.concat(F.lit("ensg"), "l_partkey", F.lit(".1")).alias("gene"))
    right = li.filter("l_discount < 0.02 AND l_tax < 0.03").select(F.concat(F.lit("ENSG"), "l_partkey", F.lit(".7")).alias("gene"))
    return C.shared_genes(left, right, names)


@query("set_counts", "U3", """
SELECT count(*) AS n_union, count_if(a.k IS NOT NULL AND b.k IS NOT NULL) AS n_both, count_if(b.k IS NULL) AS n_left_only, count_if(a.k IS NULL) AS n_right_only
FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 400000) a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice < 60000) b ON a.k = b.k""")
def set_counts(spark, sf):
    o = T.table(spark, sf, "orders")
    return C.set_counts(o.filter("o_totalprice > 400000"), o.filter("o_totalprice < 60000"), "o_custkey")


# ---- sets ----------------------------------------------------------------------------------

_MEMBERS = "mem AS (SELECT gene, list_sort(list(DISTINCT cell_type)) AS members FROM hits GROUP BY gene)"


@query("exact_intersections", "A36", "WITH " + _MEMBERS + " SELECT members, count(*) AS size, len(members) AS degree FROM mem GROUP BY members HAVING count(*) >= 2",
       ctes="hits", longs="degree")
def exact_intersections(spark, sf):
    return C.exact_intersections(T.hits(spark, sf), min_size=2, max_rows=0)


@query("top_intersections", "A36", "WITH " + _MEMBERS + """ SELECT members, count(*) AS size, len(members) AS degree FROM mem GROUP BY members
 ORDER BY size DESC, degree, members LIMIT 12""", ctes="hits", longs="degree")
def top_intersections(spark, sf):
    return C.exact_intersections(T.hits(spark, sf), max_rows=12, order="size")


@query("sharing_summary", "A37", "WITH " + _MEMBERS + """, d AS (SELECT len(members) AS d FROM mem), n AS (SELECT count(DISTINCT cell_type) AS n FROM hits)
SELECT count(*) AS n_hits, count_if(d = n) AS n_shared_all, count_if(d >= 2) AS n_shared_at_least_two, count_if(d = 1) AS n_single,
 100*count_if(d = n)/count(*) AS pct_shared_all, 100*count_if(d >= 2)/count(*) AS pct_shared_at_least_two, 100*count_if(d = 1)/count(*) AS pct_single FROM d, n""",
       ctes="hits", floats="pct_shared_all pct_shared_at_least_two pct_single")
def sharing_summary(spark, sf):
    return C.sharing_summary(T.hits(spark, sf))


@query("single_set_genes", "A38", "WITH " + _MEMBERS + """, d AS (SELECT c_mktsegment AS cell_type, 'g' || (c_custkey // 4) AS gene, max(c_acctbal) AS best FROM customer GROUP BY ALL)
SELECT d.cell_type, d.gene, best FROM mem JOIN d ON d.gene = mem.gene AND d.cell_type = members[1] WHERE len(members) = 1""", ctes="hits", floats="best")
def single_set_genes(spark, sf):
    gene = F.concat(F.lit("g"), F.floor(F.col("c_custkey") / 4).cast("bigint"))
    details = T.table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("cell_type"), gene.alias("gene")).agg(F.max("c_acctbal").alias("best"))
    return C.single_set_genes(T.hits(spark, sf), details)


@query("set_sizes", "A37", "SELECT cell_type, count(*) AS n FROM hits GROUP BY ALL", ctes="hits")
def set_sizes(spark, sf):
    return T.hits(spark, sf).groupBy("cell_type").agg(F.count(F.lit(1)).alias("n"))


# ---- reference lists -----------------------------------------------------------------------

# Symbols are made specific so that one symbol names few genes.
_REF = """
ref AS (SELECT gene, 's' || (gene // 2) AS symbol, sign FROM reference_genes),
res AS (SELECT r.cell_type, r.gene, 'S' || (r.gene // 2) AS symbol, r.hit, r.pvalue, r.zscore, coalesce(b.block_index, -1) AS block_index
        FROM results r JOIN gene_pos g ON g.gene = r.gene LEFT JOIN blocks b ON b.chrom = g.chrom AND g.bp >= b.start AND g.bp < b.stop),
mat AS (SELECT cell_type, ref.gene AS ref_gene, bool_or(hit) AS recovered FROM res JOIN ref ON res.gene = ref.gene OR upper(res.symbol) = upper(ref.symbol) GROUP BY ALL)"""


def _symbol(prefix):
    return F.concat(F.lit(prefix), F.floor(F.col("gene") / 2).cast("bigint"))


def _reference(spark, sf):
    return T.reference_genes(spark, sf).withColumn("symbol", _symbol("s"))


def _results(spark, sf):
    placed = I.assign_blocks(T.gene_pos(spark, sf), T.blocks(spark, sf)).select("gene", "block_index")
    return T.results(spark, sf).join(placed, "gene").withColumn("symbol", _symbol("S"))


_RATES = """, precision AS (SELECT *, n_recovered/nullif(n_hits, 0) AS precision, n_recovered/nullif(n_reference, 0) AS recall, n_recovered/nullif(n_tested, 0) AS recall_tested FROM cnt)
SELECT *, 2*precision*recall_tested/nullif(precision + recall_tested, 0) AS f1 FROM precision"""
_GENE_COUNTS = _REF + """,
cnt AS (SELECT h.cell_type, (SELECT count(DISTINCT gene) FROM ref) AS n_reference, coalesce(n_tested, 0) AS n_tested, n_hits, coalesce(n_recovered, 0) AS n_recovered,
 coalesce(n_tested, 0) - coalesce(n_recovered, 0) AS n_missed, n_extra FROM
 (SELECT cell_type, count_if(hit) AS n_hits, count_if(hit AND gene NOT IN (SELECT gene FROM ref)) AS n_extra FROM res GROUP BY ALL) h
 LEFT JOIN (SELECT cell_type, count(*) AS n_tested, count_if(recovered) AS n_recovered FROM mat GROUP BY ALL) f USING (cell_type))"""
_RATE_COLS = "precision recall recall_tested f1"


@query("gene_recovery", "A41 J14", "WITH " + _GENE_COUNTS + _RATES, ctes="results reference_genes gene_pos blocks", floats=_RATE_COLS)
def gene_recovery(spark, sf):
    return C.gene_recovery(_results(spark, sf), _reference(spark, sf), ["cell_type"])


_OWNED = ", own AS (SELECT DISTINCT ref.gene AS ref_gene, b.block_index FROM ref JOIN gene_pos g ON g.gene = ref.gene JOIN blocks b ON b.chrom = g.chrom AND g.bp >= b.start AND g.bp < b.stop)"


def _owned(spark, sf):
    placed = I.assign_blocks(T.gene_pos(spark, sf), T.blocks(spark, sf)).filter("block_index >= 0")
    return _reference(spark, sf).select("gene").join(placed.select("gene", "block_index"), "gene")


@query("block_recovery", "A41", "WITH " + _REF + _OWNED + """,
bm AS (SELECT cell_type, block_index, bool_or(recovered) AS recovered FROM mat JOIN own USING (ref_gene) GROUP BY ALL),
hb AS (SELECT DISTINCT cell_type, block_index FROM res WHERE hit AND block_index >= 0),
cnt AS (SELECT k.cell_type, (SELECT count(DISTINCT block_index) FROM own) AS n_reference, (SELECT count(*) FROM bm WHERE bm.cell_type = k.cell_type) AS n_tested,
 (SELECT count(*) FROM hb WHERE hb.cell_type = k.cell_type) AS n_hits, (SELECT count(*) FROM bm WHERE bm.cell_type = k.cell_type AND recovered) AS n_recovered,
 (SELECT count(*) FROM bm WHERE bm.cell_type = k.cell_type AND NOT recovered) AS n_missed,
 (SELECT count(*) FROM hb WHERE hb.cell_type = k.cell_type AND block_index NOT IN (SELECT block_index FROM own)) AS n_extra
 FROM (SELECT DISTINCT cell_type FROM res) k)""" + _RATES, ctes="results reference_genes gene_pos blocks", floats=_RATE_COLS)
def block_recovery(spark, sf):
    return C.block_recovery(_results(spark, sf), _reference(spark, sf), _owned(spark, sf), ["cell_type"])


@query("average_recovery", "A42", "WITH " + _GENE_COUNTS + ", sc AS (SELECT * FROM (WITH x AS (SELECT 1) SELECT *, n_recovered/nullif(n_hits, 0) AS precision FROM cnt)) "
       "SELECT 'x' AS arm, count(*) AS n_cell_types, avg(n_hits) AS n_hits, avg(n_recovered) AS n_recovered, avg(precision) AS precision FROM sc",
       ctes="results reference_genes gene_pos blocks", floats="n_hits n_recovered precision")
def average_recovery(spark, sf):
    scores = C.gene_recovery(_results(spark, sf), _reference(spark, sf), ["cell_type"]).withColumn("arm", F.lit("x"))
    return C.average_recovery(scores, ["arm"]).select("arm", "n_cell_types", "n_hits", "n_recovered", "precision")


@query("scoped_hits", "F10", """
SELECT 'inside' AS scope, count(*) AS n FROM results WHERE hit AND gene IN (SELECT gene FROM gene_pos WHERE chrom = '6')
UNION ALL SELECT 'outside', count(*) FROM results WHERE hit AND gene NOT IN (SELECT gene FROM gene_pos WHERE chrom = '6')
UNION ALL SELECT 'all', count(*) FROM results WHERE hit""", ctes="results gene_pos")
def scoped_hits(spark, sf):
    region = T.gene_pos(spark, sf).filter("chrom = '6'")
    rows = T.results(spark, sf).filter("hit")
    parts = [C.in_scope(rows, region, s).agg(F.count(F.lit(1)).alias("n")).select(F.lit(s).alias("scope"), "n")
             for s in ("inside", "outside", "all")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("hit_flags", "F9 X6", """
SELECT l_partkey AS gene, count_if(l_returnflag = 'R') AS n_flag, avg(l_discount*10) > 0 AS any_agreement, avg(l_discount*10) >= 0.5 AS half_agreement FROM lineitem GROUP BY ALL""")
def hit_flags(spark, sf):
    rows = T.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("gene"), F.when(F.col("l_returnflag") == "R", "True").otherwise("0.0").alias("significant_fdr"),
                                                 F.col("l_discount").alias("d"))
    flagged = rows.withColumn("flag", C.hit_flag(rows.columns))
    pooled = flagged.groupBy("gene").agg(F.count_if("flag").alias("n_flag"), F.avg(F.col("d") * 10).alias("agreement_fdr"))
    return pooled.select("gene", "n_flag", C.hit_flag(pooled.columns, min_agreement=0).alias("any_agreement"),
                         C.hit_flag(pooled.columns, min_agreement=50).alias("half_agreement"))


@query("shared_universe", "A41", """
SELECT cell_type, draw, arm, gene, pvalue FROM draws WHERE (cell_type, draw, gene) IN (SELECT (cell_type, draw, gene) FROM draws GROUP BY cell_type, draw, gene HAVING count(DISTINCT arm) = 2)""",
       ctes="draws", floats="pvalue")
def shared_universe(spark, sf):
    return C.shared_universe(T.draws(spark, sf), ["cell_type", "draw"]).select("cell_type", "draw", "arm", "gene", "pvalue")


@query("stratified_inflation", "A49 A8", "WITH " + _REF + """,
t AS (SELECT *, CASE WHEN gene IN (SELECT gene FROM ref) OR upper(symbol) IN (SELECT upper(symbol) FROM ref) THEN 'reference' ELSE 'other' END AS stratum, """
       + sql_norm_ppf("pvalue/2.0") + """ AS q FROM res)
SELECT cell_type, stratum, count(pvalue) AS n, median(q*q) FILTER (pvalue > 0)/0.4549364231195728 AS lambda_gc FROM t GROUP BY ALL""",
       ctes="results reference_genes gene_pos blocks", floats="lambda_gc")
def stratified_inflation(spark, sf):
    return C.stratified_inflation(_results(spark, sf), _reference(spark, sf), ["cell_type"])


_DIR = """
sg AS (SELECT l_returnflag AS cell_type, l_partkey AS gene, count_if(l_discount > 0.06) AS n_positive, count_if(l_discount < 0.01) AS n_negative,
 count_if(l_discount BETWEEN 0.01 AND 0.06) AS n_zero, count(*) AS n_models FROM lineitem GROUP BY ALL),
dt AS (SELECT k.cell_type, f.gene, f.sign, r.hit IS NOT NULL AS tested, coalesce(r.hit, false) AS significant, CAST(sign(r.e) AS INT) AS effect_sign,
 CASE WHEN r.hit IS NULL THEN 'not_tested' WHEN NOT r.hit THEN 'not_significant' WHEN n_positive > 0 AND n_negative > 0 THEN 'mixed_models'
      WHEN n_models IS NULL THEN 'models_unavailable' WHEN r.e = 0 THEN 'missing_or_zero' WHEN sign(r.e) = f.sign THEN 'concordant' ELSE 'discordant' END AS status
 FROM reference_genes f JOIN (SELECT DISTINCT cell_type FROM results) k ON true
 LEFT JOIN (SELECT *, CASE WHEN pvalue > 0.5 THEN 0 ELSE pvalue - 0.4 END AS e FROM results) r ON r.cell_type = k.cell_type AND r.gene = f.gene
 LEFT JOIN sg ON sg.cell_type = k.cell_type AND sg.gene = f.gene),
bulk AS (SELECT *, CASE WHEN n_significant = 0 THEN 'no_hit' WHEN n_mixed > 0 THEN 'mixed_models' WHEN n_positive > 0 AND n_negative > 0 THEN 'mixed_cell_types'
  WHEN n_significant > n_positive + n_negative THEN 'missing_or_zero' WHEN CASE WHEN n_positive > 0 THEN 1 ELSE -1 END = sign THEN 'concordant' ELSE 'discordant' END AS status
 FROM (SELECT gene, sign, count_if(tested) AS n_tested, count_if(significant) AS n_significant, count_if(significant AND effect_sign = 1) AS n_positive,
  count_if(significant AND effect_sign = -1) AS n_negative, count_if(status = 'mixed_models') AS n_mixed FROM dt GROUP BY ALL))"""


def _direction(spark, sf):
    d = F.col("l_discount")
    effect = F.when(d > 0.06, 1.0).when(d < 0.01, -1.0).otherwise(0.0)
    draws = T.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("cell_type"), F.col("l_partkey").alias("gene"), effect.alias("effect_size"))
    res = T.results(spark, sf).withColumn("effect_size", F.when(F.col("pvalue") > 0.5, 0.0).otherwise(F.col("pvalue") - 0.4))
    return C.direction_table(T.reference_genes(spark, sf), res, C.effect_signs(draws, ["cell_type"]), ["cell_type"])


@query("direction_table", "A43 J15 S18", "WITH " + _DIR + " SELECT cell_type, gene, sign, tested, significant, effect_sign, status FROM dt", ctes="results reference_genes")
def direction_table(spark, sf):
    return _direction(spark, sf)


@query("direction_bulk", "A43", "WITH " + _DIR + " SELECT gene, sign, n_tested, n_significant, n_positive, n_negative, n_mixed, status FROM bulk", ctes="results reference_genes")
def direction_bulk(spark, sf):
    return C.direction_bulk(_direction(spark, sf)).drop("n_unavailable")


@query("direction_metrics", "A43", "WITH " + _DIR + """ SELECT cell_type, count(*) AS n_reference_genes, count_if(status NOT IN ('not_tested', 'not_significant')) AS n_significant,
 count_if(status = 'concordant') AS n_concordant, count_if(status = 'discordant') AS n_discordant, count_if(status = 'mixed_models') AS n_mixed_models,
 count_if(status = 'mixed_cell_types') AS n_mixed_cell_types, count_if(status = 'missing_or_zero') AS n_missing_or_zero, count_if(status = 'models_unavailable') AS n_models_unavailable,
 count_if(status = 'concordant')/nullif(count_if(status IN ('concordant', 'discordant')), 0) AS fraction_concordant_definite FROM dt GROUP BY ALL""",
       ctes="results reference_genes", floats="fraction_concordant_definite")
def direction_metrics(spark, sf):
    return C.direction_metrics(_direction(spark, sf), ["cell_type"])


@query("direction_pairs", "A43", "WITH " + _DIR + """, p AS (SELECT a.status AS a, b.status AS b FROM dt a JOIN dt b ON a.gene = b.gene AND a.cell_type = 'A' AND b.cell_type = 'N'),
f AS (SELECT *, a NOT IN ('not_tested', 'not_significant') AND b NOT IN ('not_tested', 'not_significant') AS bo, bo AND a IN ('concordant', 'discordant') AND b IN ('concordant', 'discordant') AS sure FROM p)
SELECT count_if(bo) AS n_both_significant, count_if(sure) AS n_both_definite, count_if(sure AND a = b) AS n_same_sign, count_if(sure AND a <> b) AS n_opposite_sign,
 count_if(bo AND NOT sure) AS n_any_uncertain, count_if(sure AND a = b)/nullif(count_if(sure), 0) AS fraction_same_sign FROM f""",
       ctes="results reference_genes", floats="fraction_same_sign")
def direction_pairs(spark, sf):
    d = _direction(spark, sf)
    return C.direction_pairs(d.filter("cell_type = 'A'"), d.filter("cell_type = 'N'"), [])


# ---- rankings ------------------------------------------------------------------------------

@query("top_genes", "T1 T6 K9", """
SELECT cell_type, arm, gene, draw, pvalue, CAST(row_number() OVER (PARTITION BY cell_type, arm ORDER BY pvalue, gene) AS INT) AS rank FROM draws QUALIFY rank <= 15""",
       ctes="draws", floats="pvalue")
def top_genes(spark, sf):
    return C.top_genes(T.draws(spark, sf), ["cell_type", "arm"], 15).select("cell_type", "arm", "gene", "draw", "pvalue", "rank")


@query("top_overall", "T1 T6", "SELECT cell_type, arm, gene, draw, pvalue FROM draws ORDER BY pvalue, gene, draw, arm, cell_type LIMIT 50", ctes="draws", floats="pvalue")
def top_overall(spark, sf):
    return T.draws(spark, sf).select("cell_type", "arm", "gene", "draw", "pvalue").orderBy("pvalue", "gene", "draw", "arm", "cell_type").limit(50)


@query("largest_mean_genes", "T4", """
WITH m AS (SELECT cell_type, gene, avg(zscore) AS mean_z FROM draws GROUP BY ALL), k AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY cell_type ORDER BY abs(mean_z) DESC, gene) <= 20)
SELECT cell_type, gene, mean_z, CAST(row_number() OVER (PARTITION BY cell_type ORDER BY mean_z, gene) AS INT) AS position FROM k""", ctes="draws", floats="mean_z")
def largest_mean_genes(spark, sf):
    return C.largest_mean_genes(T.draws(spark, sf), ["cell_type"], 20)


@query("stacked_tables", "U2 A52 S19", """
SELECT cell_type AS label, count(*) AS n, avg(pvalue) AS score, 'measured' AS source FROM draws GROUP BY ALL
UNION ALL SELECT c_mktsegment, NULL, avg(c_acctbal), 'reported' FROM customer GROUP BY ALL""", ctes="draws", floats="score", digits=6)
def stacked_tables(spark, sf):
    measured = T.draws(spark, sf).groupBy(F.col("cell_type").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.avg("pvalue").alias("score"))
    reported = T.table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("label")).agg(F.avg("c_acctbal").alias("score"))
    return C.append_reported(measured, reported, source="reported")


@query("draws_significant_histogram", "A51", "WITH f AS (" + sql_bh("draws", "cell_type, arm, draw", "pvalue") + """),
g AS (SELECT cell_type, arm, gene, count_if(significant_fdr) AS k FROM f GROUP BY ALL) SELECT cell_type, arm, k, count(*) AS n FROM g WHERE k > 0 GROUP BY ALL""", ctes="draws")
def draws_significant_histogram(spark, sf):
    called = P.annotate_significance(T.draws(spark, sf), ["cell_type", "arm", "draw"])
    per = called.groupBy("cell_type", "arm", "gene").agg(F.count_if("significant_fdr").alias("k")).filter("k > 0")
    return per.groupBy("cell_type", "arm", "k").agg(F.count(F.lit(1)).alias("n"))

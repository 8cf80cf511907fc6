"""Single-cell aggregation, filters, ranks, cohorts and alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as T
from ..registry import query, sql_norm_ppf
from ...functions import exprs as X
from ...functions.distributions import norm_ppf
from ...functions.ordered import average_ranks, first_by
from ...functions.storage import parts_for
from ...operators import expression as E

_BULK = """
sums AS (SELECT donor, cell_type, gene, sum("count") AS sum_count FROM counts JOIN cells USING (cell_id) GROUP BY ALL),
groups AS (SELECT donor, cell_type, count(*) AS n_cells FROM cells GROUP BY ALL)"""
GROUP = ["donor", "cell_type"]


def bulk(spark, sf):
    return E.pseudobulk(T.counts(spark, sf), T.cells(spark, sf), GROUP)


@query("pseudobulk", "A1 A3 S12", "WITH " + _BULK + """
SELECT donor, cell_type, gene, sum_count, n_cells, sum_count/n_cells AS value FROM sums JOIN groups USING (donor, cell_type)""",
       ctes="cells counts", floats="value")
def pseudobulk(spark, sf):
    sums, groups = E.pseudobulk(T.counts(spark, sf), E.clean_cells(T.cells(spark, sf), ["donor", "cell_type"]), GROUP)
    return E.mean_per_cell(sums, groups, GROUP).select("donor", "cell_type", "gene", "sum_count", "n_cells", "value")


_TOTALS = ", totals AS (SELECT cell_type, sum(n_cells) AS cells, count(*) AS donors FROM groups GROUP BY ALL)"
for _how, _below in (("cell-weighted", "cells"), ("mean-of-sums", "donors")):
    @query(f"donor_mean_{_how.replace('-', '_')}", "A2", "WITH " + _BULK + _TOTALS + f"""
SELECT cell_type, gene, sum(sum_count)/max({_below}) AS value FROM sums JOIN totals USING (cell_type) GROUP BY ALL""",
           ctes="cells counts", floats="value")
    def _donor_mean(spark, sf, how=_how):
        return E.aggregate_donors(*bulk(spark, sf), how=how)


@query("donor_mean_normalized", "A2 W5", "WITH " + _BULK + """,
grid AS (SELECT g.donor, g.cell_type, u.gene, coalesce(s.sum_count, 0)/n_cells AS v, n_cells
         FROM groups g JOIN (SELECT DISTINCT cell_type, gene FROM sums) u USING (cell_type)
         LEFT JOIN sums s ON s.donor = g.donor AND s.cell_type = g.cell_type AND s.gene = u.gene),
norm AS (SELECT *, CASE WHEN hi > lo THEN (v - lo)/(hi - lo) ELSE 0 END AS z FROM (
         SELECT *, min(v) OVER (PARTITION BY cell_type, gene) AS lo, max(v) OVER (PARTITION BY cell_type, gene) AS hi FROM grid))
SELECT cell_type, gene, sum(z*n_cells)/sum(n_cells) AS value FROM norm GROUP BY ALL""", ctes="cells counts", floats="value")
def donor_mean_normalized(spark, sf):
    return E.aggregate_donors(*bulk(spark, sf), how="normalized")


@query("filter_by_expression", "F8", "WITH " + _BULK + """,
ok AS (SELECT * FROM groups WHERE n_cells >= 20),
grid AS (SELECT g.donor, g.cell_type, u.gene, coalesce(s.sum_count, 0) AS c, n_cells, lib
         FROM ok g JOIN (SELECT DISTINCT gene FROM sums) u ON true
         JOIN (SELECT donor, cell_type, sum(sum_count) AS lib FROM sums GROUP BY ALL) l ON l.donor = g.donor AND l.cell_type = g.cell_type
         LEFT JOIN sums s ON s.donor = g.donor AND s.cell_type = g.cell_type AND s.gene = u.gene)
SELECT cell_type, gene FROM grid GROUP BY ALL
HAVING count_if(c >= 10) >= ceil(0.2*(SELECT count(DISTINCT donor) FROM groups))
   AND count_if(c/lib*1e6 >= 500) >= ceil(0.2*(SELECT count(DISTINCT donor) FROM groups))
   AND count(*) >= 2 AND var_pop(c/n_cells) > 0.04""", ctes="cells counts")
def filter_by_expression(spark, sf):
    return E.filter_by_expression(*bulk(spark, sf), min_cells=20, min_reads=10, min_cpm=500, min_prop=0.2,
                                  min_variance=0.04)


@query("expressed_genes", "F7", """
SELECT gene, avg((truth > 20)::INT) AS fraction, stddev_pop(ln(1 + greatest(truth - 20, 0))) AS log_sd FROM expr GROUP BY gene
HAVING fraction >= 0.7 AND log_sd >= 0.5""", ctes="expr", floats="fraction log_sd", digits=8)
def expressed_genes(spark, sf):
    rows = T.expr(spark, sf).withColumn("value", F.col("truth") - 20)
    return E.expressed_genes(rows, min_fraction=0.7, min_log_sd=0.5)


@query("percentile_ranks_across_genes", "W2", """
SELECT cell_type, gene, donor, (rank() OVER (PARTITION BY cell_type, donor ORDER BY truth) + (count(*) OVER (PARTITION BY cell_type, donor, truth) - 1)/2)
  / count(*) OVER (PARTITION BY cell_type, donor) AS percentile FROM expr""", ctes="expr", floats="percentile")
def percentile_ranks_across_genes(spark, sf):
    return E.percentile_ranks(T.expr(spark, sf), ["cell_type", "donor"], "truth").select(
        "cell_type", "gene", "donor", "percentile")


@query("percentile_ranks_across_donors", "W2", """
SELECT cell_type, gene, donor, CASE WHEN t IS NOT NULL THEN (rank() OVER (PARTITION BY cell_type, gene ORDER BY t NULLS LAST)
  + (count(t) OVER (PARTITION BY cell_type, gene, t) - 1)/2) / count(t) OVER (PARTITION BY cell_type, gene) END AS percentile
FROM (SELECT *, CASE WHEN truth < 45 THEN round(truth/10) END AS t FROM expr)""", ctes="expr", floats="percentile")
def percentile_ranks_across_donors(spark, sf):
    rows = T.expr(spark, sf).withColumn("t", F.when(F.col("truth") < 45, F.round(F.col("truth") / 10)))
    return E.percentile_ranks(rows, ["cell_type", "gene"], "t").select("cell_type", "gene", "donor", "percentile")


@query("sparse_percentile_ranks", "W2", "WITH " + _BULK + """,
grid AS (SELECT g.donor, g.cell_type, u.gene, coalesce(s.sum_count, 0) AS v FROM groups g JOIN (SELECT DISTINCT gene FROM sums) u ON true
         LEFT JOIN sums s ON s.donor = g.donor AND s.cell_type = g.cell_type AND s.gene = u.gene),
r AS (SELECT *, (rank() OVER (PARTITION BY donor, cell_type ORDER BY v) + (count(*) OVER (PARTITION BY donor, cell_type, v) - 1)/2)
  / count(*) OVER (PARTITION BY donor, cell_type) AS percentile FROM grid)
SELECT donor, cell_type, v AS sum_count, count(*) AS n, max(percentile) AS percentile FROM r GROUP BY ALL""",
       ctes="cells counts", floats="percentile")
def sparse_percentile_ranks(spark, sf):
    sums, groups = bulk(spark, sf)
    n_genes = sums.select(F.count_distinct("gene")).scalar()
    return E.sparse_percentiles(sums, groups.select(*GROUP, n_genes.alias("n_all")), GROUP, "sum_count")


@query("inverse_normal", "W3 X2", "SELECT cell_type, gene, donor, " + sql_norm_ppf("r/(n+1)") + """ AS z FROM (
SELECT cell_type, gene, donor, rank() OVER (PARTITION BY cell_type, gene ORDER BY truth) + (count(*) OVER (PARTITION BY cell_type, gene, truth) - 1)/2 AS r,
  count(*) OVER (PARTITION BY cell_type, gene) AS n FROM expr)""", ctes="expr", floats="z")
def inverse_normal(spark, sf):
    ranked = average_ranks(T.expr(spark, sf), ["cell_type", "gene"], "truth", out="r", n="n")
    return ranked.withColumn("q", F.col("r") / (F.col("n") + 1)).select(
        "cell_type", "gene", "donor", norm_ppf(F.col("q")).alias("z"))


@query("min_max_scaling", "W5", """
SELECT cell_type, gene, donor, CASE WHEN v IS NULL THEN NULL WHEN hi > lo THEN (v - lo)/(hi - lo) ELSE 0 END AS value FROM (
 SELECT *, min(v) OVER (PARTITION BY cell_type, gene) AS lo, max(v) OVER (PARTITION BY cell_type, gene) AS hi
 FROM (SELECT *, CASE WHEN truth > 3 THEN truth END AS v FROM expr))""", ctes="expr", floats="value")
def min_max_scaling(spark, sf):
    rows = T.expr(spark, sf).select("cell_type", "gene", "donor", F.when(F.col("truth") > 3, F.col("truth")).alias("value"))
    return E.min_max(rows, ["cell_type", "gene"])


# ---- cohorts -------------------------------------------------------------------------------

_PARTS = {"floor": ("total*1//4", "total*2//4"),
          "divmod": ("total//4 + least(1, total % 4)", "total//4*2 + least(1, total % 4) + CASE WHEN 2 <= total % 4 THEN 1 ELSE 0 END")}
for _rule, (_a, _b) in _PARTS.items():
    @query(f"contiguous_part_{_rule}", "F12", f"""
SELECT c_custkey, c_name FROM (SELECT *, row_number() OVER (ORDER BY c_name) AS rn, count(*) OVER () AS total
  FROM customer WHERE c_acctbal > 0) WHERE rn > {_a} AND rn <= {_b}""")
    def _part(spark, sf, rule=_rule):
        people = T.table(spark, sf, "customer").filter("c_acctbal > 0").select("c_custkey", "c_name")
        return E.contiguous_part(people, ["c_name"], 2, 4, rule=rule)


_ORDER = "CAST('0x' || substr(md5({0}), 1, 15) AS BIGINT)"


@query("sample_donors", "F12", f"""
SELECT donor FROM (SELECT DISTINCT l_suppkey AS donor FROM lineitem) WHERE donor NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 1000)
ORDER BY {_ORDER.format("'7|' || donor")}, donor LIMIT 20""")
def sample_donors(spark, sf):
    held = T.table(spark, sf, "supplier").filter("s_acctbal < 1000").select(F.col("s_suppkey").alias("donor"))
    donors = T.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("donor")).distinct()
    return E.sample_donors(donors, 20, seed=7, exclude=held)


@query("gene_folds", "F13 X11", f"""
WITH p AS (SELECT cell_type, gene, donor, count(*) OVER (PARTITION BY cell_type, gene) AS n,
  row_number() OVER (PARTITION BY cell_type, gene ORDER BY {_ORDER.format("'42|' || gene || '|' || donor")}, donor) AS rn FROM expr)
SELECT cell_type, gene, donor, CASE WHEN n >= 5 THEN CASE WHEN rn <= greatest(2, least(CAST(round_even(n*0.2, 0) AS BIGINT), n - 3)) THEN 'test' ELSE 'train' END END AS fold
FROM p""", ctes="expr")
def gene_folds(spark, sf):
    return E.gene_folds(T.expr(spark, sf).select("cell_type", "gene", "donor"), keys=["cell_type"])


@query("gene_fold_sizes", "F13", """
SELECT cell_type, gene, count(*) AS n, CASE WHEN n >= 5 THEN greatest(2, least(CAST(round_even(n*0.2, 0) AS BIGINT), n - 3)) ELSE 0 END AS n_test
FROM expr GROUP BY ALL""", ctes="expr", longs="n_test")
def gene_fold_sizes(spark, sf):
    folds = E.gene_folds(T.expr(spark, sf).select("cell_type", "gene", "donor"), keys=["cell_type"])
    return folds.groupBy("cell_type", "gene").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("fold") == "test").alias("n_test"))


@query("chromosome_folds", "F13 F3", """
SELECT gene, 'chr' || chrom AS chrom, CASE WHEN chrom IN ('12','20','5') THEN 'test' WHEN chrom IN ('11','14','7') THEN 'validation' ELSE 'train' END AS fold
FROM gene_pos""", ctes="gene_pos")
def chromosome_folds(spark, sf):
    rows = T.gene_pos(spark, sf).select("gene", F.concat(F.lit("chr"), "chrom").alias("chrom"))
    return E.chromosome_folds(rows, ["11", "14", "7"], ["12", "20", "5"])


@query("skip_first_donors", "F14", """
SELECT donor, ordinal FROM (SELECT c_custkey AS donor, c_acctbal AS ordinal, c_mktsegment, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS rn FROM customer)
WHERE rn > 100 AND c_mktsegment <> 'BUILDING'""")
def skip_first_donors(spark, sf):
    customers = T.table(spark, sf, "customer")
    people = customers.select(F.col("c_custkey").alias("donor"), F.col("c_acctbal").alias("ordinal"))
    listed = customers.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("donor"))
    return E.skip_first_donors(people.withColumn("key", F.struct("ordinal", "donor")), 100,
                               listed, order="key").drop("key")


@query("split_by_list", "K8 F13", """
SELECT 'test' AS part, count(*) AS n, count(DISTINCT donor) AS donors FROM expr WHERE donor IN (SELECT s_suppkey*3 FROM supplier)
UNION ALL SELECT 'train', count(*), count(DISTINCT donor) FROM expr WHERE donor NOT IN (SELECT s_suppkey*3 FROM supplier)
UNION ALL SELECT 'missing', count(*), count(*) FROM (SELECT DISTINCT s_suppkey*3 AS d FROM supplier) WHERE d NOT IN (SELECT donor FROM expr)""",
       ctes="expr")
def split_by_list(spark, sf):
    listed = T.table(spark, sf, "supplier").select((F.col("s_suppkey") * 3).alias("donor"))
    train, test, missing = E.split_by_list(T.expr(spark, sf), listed)

    def described(part, df):
        return df.agg(F.count("donor").alias("n"), F.count_distinct("donor").alias("donors")).select(
            F.lit(part).alias("part"), "n", "donors")

    return described("test", test).unionByName(described("train", train)).unionByName(described("missing", missing))


@query("first_per_key", "F16", """
SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey""")
def first_per_key(spark, sf):
    o = T.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return first_by(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


# ---- alignment -----------------------------------------------------------------------------

@query("align_genes", "J10", """
WITH f AS (SELECT DISTINCT p_partkey % 350 AS gene FROM part WHERE p_size > 9), d AS (SELECT DISTINCT cell_type FROM expr),
e AS (SELECT cell_type, gene, avg(truth) AS value FROM expr WHERE prediction > 104.5 GROUP BY ALL)
SELECT e.cell_type, e.gene, e.value FROM e JOIN f USING (gene)
UNION ALL SELECT d.cell_type, f.gene, 0 FROM f JOIN d ON true WHERE f.gene NOT IN (SELECT gene FROM e)""",
       ctes="expr", floats="value", digits=7)
def align_genes(spark, sf):
    values = T.expr(spark, sf).filter("prediction > 104.5").groupBy("cell_type", "gene").agg(F.avg("truth").alias("value"))
    features = T.table(spark, sf, "part").filter("p_size > 9").select((F.col("p_partkey") % 350).alias("gene"))
    return E.align_genes(values, features, ["cell_type"])


@query("gene_axis_report", "J10", """
WITH f AS (SELECT p_partkey % 350 AS gene, count(*) AS c FROM part WHERE p_size > 9 GROUP BY 1), e AS (SELECT DISTINCT gene FROM expr WHERE prediction > 104.5)
SELECT count_if(e.gene IS NOT NULL AND f.gene IS NOT NULL) AS n_matched, count_if(f.gene IS NULL) AS n_dropped,
       count_if(e.gene IS NULL) AS n_undetected, count_if(c > 1) AS n_duplicated FROM e FULL JOIN f ON e.gene = f.gene""", ctes="expr")
def gene_axis_report(spark, sf):
    features = T.table(spark, sf, "part").filter("p_size > 9").select((F.col("p_partkey") % 350).alias("gene"))
    return E.gene_axis_report(T.expr(spark, sf).filter("prediction > 104.5"), features)


@query("attach_target", "J11", """
SELECT a.cell_type, a.gene, a.donor, b.truth AS target FROM (SELECT * FROM expr WHERE cell_type = 'A') a
LEFT JOIN (SELECT * FROM expr WHERE cell_type = 'N') b ON a.gene = b.gene AND a.donor = b.donor""", ctes="expr", floats="target", digits=7)
def attach_target(spark, sf):
    e = T.expr(spark, sf)
    other = e.filter("cell_type = 'N'").select("gene", "donor", F.col("truth").alias("value"))
    return E.attach_target(e.filter("cell_type = 'A'").select("cell_type", "gene", "donor"), other, ["gene", "donor"], "target")


@query("members_in_common", "J12", """
SELECT gene FROM members GROUP BY gene HAVING count(DISTINCT member) = (SELECT count(DISTINCT member) FROM members)""", ctes="members")
def members_in_common(spark, sf):
    return E.members_in_common(T.members(spark, sf), ["gene"], "member")


@query("population_moments", "A31", """
SELECT cell_type, count(value) AS n_donors, avg(ln(1 + value)) AS mean, CASE WHEN count(value) >= 2 THEN var_pop(ln(1 + value)) END AS variance
FROM population GROUP BY ALL""", ctes="population", floats="mean variance")
def population_moments(spark, sf):
    return E.population_moments(T.population(spark, sf), ["cell_type"])


@query("fill_with_mean", "A31 U4", """
WITH p AS (SELECT donor, cell_type, ln(1 + value) AS v FROM population WHERE value < 50),
m AS (SELECT cell_type, avg(v) AS mean FROM p GROUP BY ALL)
SELECT d.donor, m.cell_type, coalesce(p.v, m.mean) AS value, p.v IS NOT NULL AS observed
FROM (SELECT DISTINCT donor FROM p) d JOIN m ON true LEFT JOIN p ON p.donor = d.donor AND p.cell_type = m.cell_type""",
       ctes="population", floats="value")
def fill_with_mean(spark, sf):
    rows = T.population(spark, sf).filter("value < 50")
    return E.fill_with_mean(rows, ["cell_type"])


@query("key_index", "U4", """
SELECT DISTINCT gene, donor FROM expr UNION SELECT gene, donor FROM members""", ctes="expr members")
def key_index(spark, sf):
    parts = parts_for(T.table(spark, sf, "lineitem"))
    return E.key_index([T.expr(spark, sf), T.members(spark, sf)], ["gene", "donor"], parts=parts)


@query("wide_targets", "K1 K2", """
SELECT gene, avg(truth) FILTER (cell_type = 'A') AS "A", avg(truth) FILTER (cell_type = 'N') AS "N", avg(truth) FILTER (cell_type = 'R') AS "R"
FROM expr GROUP BY gene""", ctes="expr", floats="A N R", digits=7)
def wide_targets(spark, sf):
    return E.wide_by(T.expr(spark, sf), ["gene"], "cell_type", ["A", "N", "R"], "truth", drop_empty=True)


@query("chromosome_rows", "K2", """
SELECT gene, chrom, c AS row_chrom, CASE WHEN chrom = c THEN bp ELSE 0 END AS value FROM gene_pos, (SELECT unnest(['1','2','3']) AS c)""",
       ctes="gene_pos", floats="value", digits=1)
def chromosome_rows(spark, sf):
    rows = T.gene_pos(spark, sf).select("gene", "chrom", F.col("bp").cast("double").alias("value"))
    return E.chromosome_rows(rows, ["1", "2", "3"])


# ---- scalar expressions over whole tables --------------------------------------------------

@query("identifier_keys", "F1 F2 F3 F4 X1 X4 X10", """
SELECT c_custkey, upper(trim(split_part('ensg' || c_custkey || '.' || (c_custkey % 5), '.', 1))) AS gene,
       CASE WHEN regexp_replace(lower(c_mktsegment), '[^a-z0-9]+', '', 'g') = 'building' THEN 'construction'
            ELSE regexp_replace(lower(c_mktsegment), '[^a-z0-9]+', '', 'g') END AS label,
       CAST(c_nationkey AS VARCHAR) AS chrom, CAST(CAST(regexp_extract(c_name, '(\\d+)$', 1) AS BIGINT) AS BIGINT) AS digits,
       CASE WHEN c_acctbal > -1 THEN ln(1 + c_acctbal) END AS logged,
       CASE WHEN c_acctbal > 0 THEN least(-log10(c_acctbal/1e4), 320) ELSE 320 END AS strength
FROM customer""", floats="logged strength", longs="digits")
def identifier_keys(spark, sf):
    c = T.table(spark, sf, "customer")
    return c.select(
        "c_custkey", X.gene_key(F.concat(F.lit("ensg"), "c_custkey", F.lit("."), F.col("c_custkey") % 5)).alias("gene"),
        X.canonical_label(F.concat("c_mktsegment", F.lit(" (human)")), {"building": "construction"}).alias("label"),
        X.chrom_key(F.concat(F.lit("chr"), "c_nationkey", F.lit(".0"))).alias("chrom"),
        X.donor_digits(F.col("c_name")).alias("digits"), X.safe_log1p(F.col("c_acctbal")).alias("logged"),
        X.neglog10(F.col("c_acctbal") / 1e4).alias("strength"))


@query("donor_rewrite", "F4", """
SELECT c_custkey, 'cohort_' || regexp_extract(c_name, '(\\d+)$', 1) AS donor FROM customer WHERE c_custkey % 10 <> c_nationkey % 10""")
def donor_rewrite(spark, sf):
    c = T.table(spark, sf, "customer").withColumn("raw", F.concat(
        F.lit("d_"), F.col("c_custkey") % 10, F.lit("_"), F.col("c_nationkey") % 10))
    return c.filter(~X.doubled_donor(F.col("raw"))).select("c_custkey", X.prefixed_donor(F.col("c_name"), "cohort").alias("donor"))


@query("natural_sort_key", "T5", """
SELECT c_custkey, 'arm' || lpad(CAST(length(CAST(c_custkey AS VARCHAR)) AS VARCHAR), 10, '0') || c_custkey || '_' || lpad(CAST(length(CAST(c_nationkey AS VARCHAR)) AS VARCHAR), 10, '0') || c_nationkey AS k FROM customer""")
def natural_sort_key(spark, sf):
    return T.table(spark, sf, "customer").select(
        "c_custkey", X.natural_key(F.concat(F.lit("Arm"), "c_custkey", F.lit("_"), "c_nationkey")).alias("k"))


@query("stage_counts", "X10 S12", """
SELECT split_part(c_mktsegment || '-x', '-', 1) AS stage, regexp_replace(trim(c_mktsegment || ' a/b'), '[^A-Za-z0-9._-]+', '_', 'g') AS file, count(*) AS n
FROM customer GROUP BY ALL""")
def stage_counts(spark, sf):
    m = F.col("c_mktsegment")
    return T.table(spark, sf, "customer").groupBy(
        X.stage_label(F.concat(m, F.lit("-x"))).alias("stage"), X.file_label(F.concat(m, F.lit(" a/b"))).alias("file")).agg(
        F.count(F.lit(1)).alias("n"))

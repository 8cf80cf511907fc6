"""Text formats parsed from lines that Spark derives from the given tables; incremental jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .. import fixtures as T
from ..registry import query, sql_norm_ppf
from ...functions import exprs as X
from ...functions.storage import shared_dir
from ...operators import expression as E
from ...sources import sinks as K, text as S
from ...streaming import incremental as Z


def lines(df, *parts, order, sep="\t"):
    return df.select(F.concat_ws(sep, *parts).alias("value"), order.alias("ordinal"))


def _bim(spark, sf):
    o = T.table(spark, sf, "orders")
    snp = F.concat(F.lit("rs"), F.floor(F.col("o_orderkey") / 2).cast("bigint"))
    return lines(o, F.concat(F.lit("chr"), F.col("o_custkey") % 22 + 1), snp, F.lit("0"), (F.col("o_orderkey") * 100).cast("string"),
                 F.lit("A"), F.lit("G"), order=F.col("o_orderkey"))


@query("variant_table", "S1", """
SELECT chrom, snp, 0.0::DOUBLE AS cm, bp, 'A' AS a1, 'G' AS a2 FROM (SELECT CAST(o_custkey % 22 + 1 AS VARCHAR) AS chrom, 'rs' || (o_orderkey // 2) AS snp, o_orderkey*100 AS bp,
 row_number() OVER (PARTITION BY o_orderkey // 2 ORDER BY CAST(o_custkey % 22 + 1 AS VARCHAR), o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def variant_table(spark, sf):
    return S.parse_variants(_bim(spark, sf)).select("chrom", "snp", "cm", "bp", "a1", "a2")


@query("variant_duplicates", "S1", "SELECT count(*) - count(DISTINCT o_orderkey // 2) AS n_duplicates FROM orders")
def variant_duplicates(spark, sf):
    return S.duplicate_count(_bim(spark, sf))


@query("sample_table", "S2", "SELECT CAST(c_nationkey AS VARCHAR) AS family_id, c_custkey || '_' || c_custkey AS donor FROM customer")
def sample_table(spark, sf):
    c = T.table(spark, sf, "customer")
    rows = lines(c, "c_nationkey", "c_custkey", F.lit("0 0 1 -9"), order=F.col("c_custkey"), sep="  ")
    return S.parse_samples(rows, doubled=True).select("family_id", "donor")


def _calls(key):
    return F.when(key % 3 == 0, "0/1").when(key % 3 == 1, "1|1:35").otherwise("./.")


def _vcf(spark, sf):
    o, k = T.table(spark, sf, "orders"), F.col("o_orderkey")
    alt = F.when(k % 10 == 0, "TT").when(k % 10 == 1, "C,T").otherwise("c")
    body = lines(o, F.concat(F.lit("chr"), F.col("o_custkey") % 22 + 1), (k * 100).cast("string"), F.concat(F.lit("rs"), k), F.lit("a"), alt,
                 F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), _calls(k), _calls(k + 1), order=k)
    head = o.agg(F.min("o_orderkey").alias("m")).select(
        F.lit("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tdonorA\tdonorB").alias("value"), (F.col("m") - 1).alias("ordinal"))
    return head.unionByName(body)


@query("vcf_calls", "S13", """
WITH c AS (SELECT *, unnest(['donorA','donorB']) AS donor, unnest([0, 1]) AS d FROM orders WHERE o_orderkey % 10 > 1)
SELECT CAST(o_custkey % 22 + 1 AS VARCHAR) AS chrom, o_orderkey*100 AS bp, 'rs' || o_orderkey AS snp, 'A' AS ref, 'C' AS alt, donor,
 CASE WHEN (o_orderkey + d) % 3 = 2 THEN 0 ELSE 2 END AS n_called, CASE (o_orderkey + d) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS n_alt FROM c""")
def vcf_calls(spark, sf):
    return S.parse_vcf(_vcf(spark, sf))


@query("vcf_contig_style", "S14", "SELECT count(*) > 0 AS prefixed FROM orders")
def vcf_contig_style(spark, sf):
    return S.contig_style(_vcf(spark, sf))


@query("block_file", "S7", """
SELECT chrom, start, stop, row_number() OVER (ORDER BY chrom, start) - 1 AS block_index, block FROM blocks""", ctes="blocks")
def block_file(spark, sf):
    b = T.blocks(spark, sf)
    rows = lines(b, F.concat(F.lit("chr"), "chrom"), "start", "stop", order=F.col("block_index"), sep=" ")
    extra = b.agg(F.min("block_index").alias("m")).select(F.explode(F.array(F.lit("# build GRCh38"), F.lit("chr start stop"))).alias("value"), (F.col("m") - 1).alias("ordinal"))
    return S.parse_blocks(extra.unionByName(rows))


def _gtf(spark, sf):
    p = T.table(spark, sf, "part")
    k, at = F.col("p_partkey"), F.col("p_partkey") * 1000
    kind = F.when(F.col("p_size") > 10, "protein_coding").otherwise("lncRNA")
    attrs = F.concat(F.lit('gene_id "ENSG'), k, F.lit('.3"; gene_name "'), "p_name", F.lit('"; gene_type "'), kind, F.lit('";'))
    feature = F.when(F.col("p_brand") == "Brand#1", "exon").otherwise("gene")
    return lines(p, F.concat(F.lit("chr"), F.col("p_size") % 22 + 1), F.lit("src"), feature, at.cast("string"), (at + 5000).cast("string"), F.lit("."),
                 F.when(k % 2 == 0, "+").otherwise("-"), F.lit("."), attrs, order=k)


@query("gtf_symbols", "S8 X5", "SELECT 'ENSG' || p_partkey AS gene, p_name AS symbol FROM part WHERE p_brand <> 'Brand#1'")
def gtf_symbols(spark, sf):
    return S.gene_symbols(S.parse_gtf(_gtf(spark, sf)))


@query("gtf_region_genes", "S9 J3", """
SELECT 'ENSG' || p_partkey AS gene FROM part WHERE p_brand <> 'Brand#1' AND p_size % 22 + 1 = 6 AND p_partkey*1000 + 5000 >= 100000 AND p_partkey*1000 <= 1500000""")
def gtf_region_genes(spark, sf):
    return S.region_genes(S.parse_gtf(_gtf(spark, sf)), X.parse_region(F.lit("6:100,000-1,500,000")))


@query("gtf_windows", "S10 S21", """
SELECT chrom, ensid, tss, tss - 98305 AS start, tss + 98303 AS "end" FROM (SELECT CAST(p_size % 22 + 1 AS VARCHAR) AS chrom, 'ENSG' || p_partkey AS ensid,
 CASE WHEN p_partkey % 2 = 0 THEN p_partkey*1000 ELSE p_partkey*1000 + 5000 END AS tss FROM part WHERE p_brand <> 'Brand#1' AND p_size > 10 AND p_retailprice > 950)""")
def gtf_windows(spark, sf):
    ids = T.table(spark, sf, "part").filter("p_retailprice > 950").select(F.concat(F.lit("ensg"), "p_partkey").alias("gene"))
    return S.autosomal(S.gene_windows(S.parse_gtf(_gtf(spark, sf)), ids))


@query("gene_ids_in_text", "S11", "SELECT DISTINCT 'ENSG' || c_custkey AS gene FROM customer UNION SELECT DISTINCT 'ENSG' || c_nationkey FROM customer")
def gene_ids_in_text(spark, sf):
    c = T.table(spark, sf, "customer")
    return S.parse_gene_list(lines(c, F.concat(F.lit("x ensg"), "c_custkey", F.lit(".2;ENSG"), "c_nationkey", F.lit(" y")), order=F.col("c_custkey")))


@query("gene_table", "S11", "SELECT 'ENSG' || p_partkey AS gene, CASE WHEN p_size > 5 THEN p_name END AS symbol FROM part")
def gene_table(spark, sf):
    p = T.table(spark, sf, "part")
    return S.gene_table(p.select(F.concat(F.lit("ENSG"), "p_partkey", F.lit(".1")).alias("ENSID"), F.when(F.col("p_size") > 5, F.col("p_name")).otherwise("nan").alias("Gene")))


@query("wide_to_long", "S4 K1", """
SELECT gene, donor, avg(truth) AS value, CAST(ord AS INT) AS ordinal FROM (SELECT gene, cell_type AS donor, truth, CASE cell_type WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS ord FROM expr) GROUP BY ALL""",
       ctes="expr", floats="value", digits=7)
def wide_to_long(spark, sf):
    wide = E.wide_by(T.expr(spark, sf), ["gene"], "cell_type", ["A", "N", "R"], "truth")
    return S.wide_to_long(wide).filter("value is not null").select("gene", "donor", "value", "ordinal")


@query("reference_list", "S17 X5", """
SELECT 'ENSG' || p_partkey AS gene, p_name AS symbol, CAST(unnest([p_size, p_size + 1]) AS BIGINT) AS block_index, unnest(['chr6:' || p_size || '-' || (p_size + 5), 'chr7:1-2']) AS block,
 unnest([p_size + 5 >= 20 AND p_size <= 30, false]) AS in_region FROM part WHERE p_brand LIKE '%1'""")
def reference_list(spark, sf):
    p = T.table(spark, sf, "part").filter("p_brand like '%1'")
    df = p.select(F.lit("l").alias("locus"), F.col("p_name").alias("gene"), F.concat(F.lit("ensg"), "p_partkey", F.lit(".4")).alias("ensid"),
                  F.concat_ws(" ; ", "p_size", F.col("p_size") + 1).alias("ld_block_index"),
                  F.concat(F.lit("chr6:"), "p_size", F.lit("-"), F.col("p_size") + 5, F.lit(";chr7:1-2")).alias("ld_block"))
    return S.reference_list(df, region=X.parse_region(F.lit("chr6:20-30")))


@query("reference_sign_list", "S18", "SELECT CAST(gene AS VARCHAR) AS gene, sign FROM reference_genes", ctes="reference_genes")
def reference_sign_list(spark, sf):
    return S.reference_signs(T.reference_genes(spark, sf).select(F.concat("gene", F.lit(".1")).alias("gene_id"), F.col("sign").alias("reference_sign")))


@query("reported_performance", "S19 F2", """
SELECT c_mktsegment AS cell_type, lower(c_mktsegment) || ' Human' AS reported_cell_type, avg(c_acctbal) AS m1 FROM customer GROUP BY ALL""", floats="m1", digits=6)
def reported_performance(spark, sf):
    c = T.table(spark, sf, "customer")
    reported = c.groupBy(F.concat(F.lower("c_mktsegment"), F.lit(" Human")).alias("cell_type")).agg(F.avg("c_acctbal").alias("m1")).withColumn("dataset", F.lit("d"))
    labels = c.select(F.col("c_mktsegment").alias("cell_type")).distinct()
    return S.reported_performance(reported, labels, dataset="d")


def _study(spark, sf):
    p = T.table(spark, sf, "part")
    return p.select(F.concat(F.lit("rs"), "p_partkey").alias("SNP"), F.lit("a").alias("A1"), F.lit("g").alias("A2"),
                    (F.col("p_size") - 25.5).alias("b"), F.when(F.col("p_size") > 20, F.col("p_size") / 10.0).alias("s"),
                    ((F.col("p_partkey") % 997 + 1) / 1000.0).alias("p"))


@query("study_zscores", "S5 X2", """
SELECT 'rs' || p_partkey AS snp, 'A' AS effect_allele, 'G' AS non_effect_allele, CASE WHEN p_size > 20 THEN (p_size - 25.5)/(p_size/10.0) ELSE -sign(p_size - 25.5)*"""
       + sql_norm_ppf("((p_partkey % 997 + 1)/2000.0)") + """ END AS zscore, p_size - 25.5 AS beta, (p_partkey % 997 + 1)/1000.0 AS pvalue FROM part""",
       floats="zscore beta pvalue")
def study_zscores(spark, sf):
    return S.normalise_study(_study(spark, sf), S.StudyColumns(beta="b", se="s", pvalue="p"))


@query("study_odds_ratio", "S5", """
SELECT 'm' || p_partkey AS snp, ln(p_size/10.0)/0.5 AS zscore FROM part WHERE p_retailprice > 950""", floats="zscore")
def study_odds_ratio(spark, sf):
    p = T.table(spark, sf, "part")
    raw = p.select(F.concat(F.lit("rs"), "p_partkey").alias("SNP"), F.lit("A").alias("A1"), F.lit("G").alias("A2"), (F.col("p_size") / 10.0).alias("or"), F.lit(0.5).alias("se"))
    ids = p.filter("p_retailprice > 950").select(F.concat(F.lit("rs"), "p_partkey").alias("snp"), F.concat(F.lit("m"), "p_partkey").alias("mapped"))
    return S.normalise_study(raw, S.StudyColumns(odds_ratio="or", se="se"), ids).select("snp", "zscore")


@query("study_lines", "S5", "SELECT CAST(o_orderkey AS VARCHAR) AS snp, CAST(o_custkey AS VARCHAR) AS z FROM orders")
def study_lines(spark, sf):
    o = T.table(spark, sf, "orders")
    body = lines(o, "o_orderkey", "o_custkey", order=F.col("o_orderkey"), sep="|")
    head = o.agg(F.min("o_orderkey").alias("m")).select(F.explode(F.array(
        F.struct(F.lit("some text").alias("value"), (F.col("m") - 2).alias("ordinal")),
        F.struct(F.lit("snp|z").alias("value"), (F.col("m") - 1).alias("ordinal")))).alias("h")).select("h.*")
    return S.delimited(head.unionByName(body), ["snp", "z"], sep="|", skip_until="snp|")


def _weights_table(spark, sf):
    return T.weights(spark, sf).groupBy(F.col("gene").cast("string").alias("gene"), F.col("snp").cast("string").alias("snp")).agg(
        F.sum("weight").alias("weight")).withColumns({"chrom": F.lit("1"), "intercept": F.lit(0.5)})


@query("weights_round_trip", "S6 K5", """
SELECT CAST(gene AS VARCHAR) AS gene, '1' AS chrom, 'point' AS draw, CAST(snp AS VARCHAR) AS snp, sum(weight) AS weight, 0.5 AS intercept, true AS standardized FROM weights GROUP BY gene, snp""",
       ctes="weights", floats="weight intercept")
def weights_round_trip(spark, sf):
    return S.parse_weights(S.weights_json(_weights_table(spark, sf)).select("value"))


@query("ensemble_weight_draws", "S6", """
SELECT 'g' || p_partkey AS gene, draw, snp, w AS weight FROM (SELECT p_partkey, unnest(['m0_0','m0_0','m0_1','m0_1','m1_0','m1_0']) AS draw, unnest(['s1','s2','s1','s2','s1','s2']) AS snp,
 unnest([p_size/10.0, 1, 2, p_size/10.0, 0.5, 0.25]) AS w FROM part)""", floats="weight")
def ensemble_weight_draws(spark, sf):
    size = (F.col("p_size") / 10.0).cast("string")
    body = F.concat(F.lit('{"g'), "p_partkey", F.lit('": {"snp_ids": ["s1", "s2"], "coefs": [1, 2], "metadata": {"coefficient_scale": "raw_dosage"}, "members": [{"member_id": "m0", "bootstrap_coefs": [['),
                    size, F.lit(', 1], [2, '), size, F.lit(']]}, {"member_id": "m1", "bootstrap_coefs": [[0.5, 0.25]]}]}}'))
    return S.parse_weights(T.table(spark, sf, "part").select(body.alias("value")), draws=True).select("gene", "draw", "snp", "weight")


@query("ambiguous_labels", "S15", "SELECT lower(c_mktsegment) AS key, CAST(2 AS BIGINT) AS n, [c_mktsegment, lower(c_mktsegment)] AS names FROM customer WHERE c_mktsegment < 'G' GROUP BY ALL")
def ambiguous_labels(spark, sf):
    names = T.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("cell_type")).distinct()
    return S.ambiguous_labels(names.unionByName(names.filter("cell_type < 'G'").select(F.lower("cell_type").alias("cell_type"))))


@query("incomplete_seeds", "S16", """
WITH d AS (SELECT DISTINCT l_partkey AS model, l_linenumber AS seed, l_returnflag AS cell_type FROM lineitem), e AS (SELECT model, count(DISTINCT cell_type) AS n_expected FROM d GROUP BY ALL)
SELECT model, seed, count(*) AS n, n_expected FROM d JOIN e USING (model) GROUP BY ALL HAVING count(*) < n_expected""")
def incomplete_seeds(spark, sf):
    return S.incomplete_seeds(T.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("model"), F.col("l_linenumber").alias("seed"), F.col("l_returnflag").alias("cell_type")))


@query("unique_names", "X10", """
SELECT s_suppkey, CASE WHEN rn = 1 THEN s ELSE s || '_' || rn END AS s FROM (SELECT s_suppkey, 'n' || s_nationkey AS s, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn FROM supplier)""")
def unique_names(spark, sf):
    rows = T.table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("n"), "s_nationkey").alias("s"))
    return S.unique_names(rows, "s", ["s_suppkey"])


@query("results_overview", "K7", "SELECT cell_type, arm, count_if(pvalue < 0.01) AS n_significant_fdr, count(*) AS n_genes FROM draws GROUP BY ALL", ctes="draws")
def results_overview(spark, sf):
    return K.overview(T.draws(spark, sf).withColumn("significant_fdr", F.col("pvalue") < 0.01))


# ---- writers, read back ----------------------------------------------------------------------

def _place(spark):
    return f"{shared_dir(spark)}/sinks/{uuid.uuid4().hex}"


def _donor_rows(spark, sf):
    return T.table(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("cell_type"), (F.col("l_partkey") % 50).alias("gene"), (F.col("l_suppkey") % 5).alias("donor")).agg(
        F.sum("l_quantity").cast("double").alias("value"))


_DONORS = "SELECT l_returnflag AS cell_type, l_partkey % 50 AS gene, l_suppkey % 5 AS donor, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem GROUP BY ALL"


@query("written_wide", "K1", f"SELECT cell_type, CAST(gene AS VARCHAR) AS gene, CAST(donor AS BIGINT) AS donor, value FROM ({_DONORS})", floats="value", longs="donor", digits=4)
def written_wide(spark, sf):
    """One cell type after the other; each write leaves the others alone."""
    path, rows = _place(spark), _donor_rows(spark, sf)
    for part in ("A", "N", "R", "N"):
        K.write_wide(rows.filter(F.col("cell_type") == part).withColumns({"chrom": F.lit("1"), "tss": F.lit(5)}), path, range(5))
    wide = spark.read.option("header", True).csv(path)
    return wide.unpivot(["cell_type", "gene"], [str(d) for d in range(5)], "donor", "value").filter("value is not null").select(
        "cell_type", "gene", F.col("donor").cast("bigint").alias("donor"), F.col("value").cast("double").alias("value"))


@query("written_predictions", "K6", f"SELECT cell_type, CAST(gene AS VARCHAR) AS gene, max(value) FILTER (donor = 0) AS d0, max(value) FILTER (donor = 4) AS d4 FROM ({_DONORS}) GROUP BY ALL", floats="d0 d4", digits=4)
def written_predictions(spark, sf):
    path = _place(spark)
    K.write_predictions(_donor_rows(spark, sf), path, range(5))
    return spark.read.option("header", True).csv(path).select("cell_type", "gene", F.col("0").cast("double").alias("d0"), F.col("4").cast("double").alias("d4"))


@query("written_population", "K3", f"SELECT cell_type, gene, donor, value/(donor + 1) AS value, donor + 1 AS n_cells FROM ({_DONORS})", floats="value", longs="n_cells", digits=6)
def written_population(spark, sf):
    path, rows = _place(spark), _donor_rows(spark, sf)
    groups = rows.select("donor", "cell_type", (F.col("donor") + 1).alias("n_cells")).distinct()
    K.write_population(rows.withColumnRenamed("value", "sum_count"), groups, path)
    return spark.read.parquet(path).select("cell_type", "gene", "donor", "value", "n_cells")


@query("written_targets", "K2", f"SELECT cell_type, gene, avg(value) AS value FROM ({_DONORS}) GROUP BY ALL", floats="value", digits=4)
def written_targets(spark, sf):
    path = _place(spark)
    K.write_targets(_donor_rows(spark, sf), path)
    return spark.read.parquet(path).select("cell_type", "gene", "value")


@query("written_covariance", "K4 A15", """
WITH s AS (SELECT l_returnflag AS cell_type, l_partkey % 9 AS gene, l_suppkey AS snp FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY cell_type, gene ORDER BY snp % 13, snp) AS place FROM s),
h AS (SELECT cell_type, count(*) AS n, """ + ", ".join(f"sum(CAST('0x' || substr(sha256(gene || chr(9) || place || chr(9) || snp), {a}, 12) AS HUGEINT)) AS p{a}" for a in (1, 13, 25, 37)) + """ FROM r GROUP BY cell_type)
SELECT cell_type, n AS n_snps, sha256(n || '-' || hex(CAST(p1 AS VARCHAR)) || '-' || hex(CAST(p13 AS VARCHAR)) || '-' || hex(CAST(p25 AS VARCHAR)) || '-' || hex(CAST(p37 AS VARCHAR))) AS content_hash,
 CASE cell_type WHEN 'N' THEN 'second' ELSE 'first' END AS reference, n AS n_pairs FROM h""")
def written_covariance(spark, sf):
    """One cell type after the other, one of them twice; readers follow the commit records, and the replaced version goes."""
    path = _place(spark)
    snps = T.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("cell_type"), (F.col("l_partkey") % 9).alias("gene"), F.col("l_suppkey").alias("snp")).distinct()
    snps = snps.withColumn("rest", F.col("snp") % 13)
    for part, reference in (("A", "first"), ("N", "first"), ("R", "first"), ("N", "second")):
        own = snps.filter(F.col("cell_type") == part)
        held = own if reference == "second" else own.withColumn("snp", F.when(F.col("cell_type") == "N", -1).otherwise(F.col("snp")))
        K.write_covariance(own.withColumn("value", F.lit(1.0)), held, path, partition="cell_type", order=("rest", "snp"), reference=reference)
    K.remove_old_versions(spark, path)
    pairs = K.read_covariance(spark, path, "pairs", partition="cell_type").groupBy("cell_type").agg(F.count(F.lit(1)).alias("n_pairs"))
    return K.read_covariance(spark, path, "meta", partition="cell_type").join(pairs, "cell_type")


@query("written_split", "K8", "SELECT CASE WHEN l_suppkey % 4 = 1 THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM lineitem GROUP BY ALL")
def written_split(spark, sf):
    path = _place(spark)
    rows = T.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("donor"), "l_partkey")
    K.write_split(rows, rows.select("donor").filter("donor % 4 = 1").distinct(), path)
    read = [spark.read.parquet(f"{path}/{p}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(p).alias("part"), "n") for p in ("train", "test")]
    return read[0].unionByName(read[1])


@query("written_top", "K9", f"SELECT cell_type, CAST(gene AS VARCHAR) AS gene, CAST(donor AS VARCHAR) AS donor, value FROM ({_DONORS}) ORDER BY value DESC, cell_type, gene, donor LIMIT 15", floats="value", digits=4)
def written_top(spark, sf):
    path = _place(spark)
    K.write_top(_donor_rows(spark, sf), path, [F.col("value").desc(), F.col("cell_type"), F.col("gene"), F.col("donor")], 15)
    return spark.read.option("header", True).option("sep", "\t").csv(path).withColumn("value", F.col("value").cast("double"))


@query("written_donors", "K10", f"SELECT cell_type, gene, donor, value FROM ({_DONORS})", floats="value", digits=4)
def written_donors(spark, sf):
    """Two donors, then all: the first two are not written again."""
    path, rows = _place(spark), _donor_rows(spark, sf)
    K.write_new_donors(rows.filter("donor < 2"), path)
    K.write_new_donors(rows.withColumn("value", F.when(F.col("donor") < 2, -1.0).otherwise(F.col("value"))), path)
    return K.written_donors(spark, path).select("cell_type", "gene", "donor", "value")


# ---- incremental ---------------------------------------------------------------------------

@query("unfinished_work", "J13", """
SELECT DISTINCT l_partkey AS cell_type FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber IN (1, 2) GROUP BY 1 HAVING count(DISTINCT l_linenumber) = 2)""")
def unfinished_work(spark, sf):
    li = T.table(spark, sf, "lineitem").withColumn("cell_type", F.col("l_partkey"))
    manifest = li.select("cell_type", F.when(F.col("l_linenumber") == 1, "summary").when(F.col("l_linenumber") == 2, "results").otherwise("log").alias("item"))
    return Z.unfinished(li.select("cell_type").distinct(), manifest, ["results"])


_DIGEST = "sha256(gene || chr(9) || snp)"


@query("content_hash", "A15", f"""
WITH d AS (SELECT DISTINCT gene, snp, {_DIGEST} AS h FROM ld_snps),
s AS (SELECT count(*) AS n, """ + ", ".join(f"sum(CAST('0x' || substr(h, {a}, 12) AS HUGEINT)) AS p{a}" for a in (1, 13, 25, 37)) + """ FROM d)
SELECT n AS n_rows, sha256(n || '-' || hex(CAST(p1 AS VARCHAR)) || '-' || hex(CAST(p13 AS VARCHAR)) || '-' || hex(CAST(p25 AS VARCHAR)) || '-' || hex(CAST(p37 AS VARCHAR))) AS content_hash FROM s""",
       ctes="ld_snps")
def content_hash(spark, sf):
    return Z.content_hash(T.ld_snps(spark, sf), ["gene", "snp"])


@query("cohort_consistency", "J20 F5", """
SELECT unnest(['n_rows', 'content_hash']) AS field, unnest([a = b, a = b]) AS same FROM (SELECT (SELECT count(DISTINCT o_custkey) FROM orders) AS a, (SELECT count(DISTINCT c_custkey) FROM customer) AS b)""")
def cohort_consistency(spark, sf):
    a = T.table(spark, sf, "orders").select(F.col("o_custkey").alias("donor")).distinct()
    b = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("donor"))
    return Z.consistent_metadata(Z.content_hash(a, ["donor"]), Z.content_hash(b, ["donor"]), ["n_rows", "content_hash"]).select("field", "same")


@query("running_correlation", "Z2", """
SELECT event_type, user_id % 50 AS part, count(*) AS n, covar_pop(value, user_id)/sqrt(nullif(var_pop(value)*var_pop(user_id), 0)) AS r FROM events GROUP BY ALL""", floats="r", digits=6)
def running_correlation(spark, sf):
    """The events table consumed as a file stream in four arrivals, each after a restart; correlation from base and later batches."""
    schema = T.table(spark, sf, "events").schema
    work = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    source = spark.read.schema(schema).parquet(f"{sf}/events.parquet").withColumn("arrival", F.least(F.col("event_id") % 7, F.lit(3)))
    keyed = StructType([*schema.fields, StructField("part", LongType())])
    for arrival in range(4):
        source.filter(F.col("arrival") == arrival).drop("arrival").withColumn("part", F.col("user_id") % 50).write.mode("append").parquet(f"{work}/in")
        Z.stream_sums(spark, f"{work}/in", keyed, ["event_type", "part"], "value", "user_id", output=f"{work}/out",
                      checkpoint=f"{work}/checkpoint").awaitTermination()
    return Z.correlation_from_sums(Z.latest_sums(spark, f"{work}/out", ["event_type", "part"]), ["event_type", "part"])


@query("resumed_batches", "Z1", "SELECT event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL", floats="total", digits=4)
def resumed_batches(spark, sf):
    """Half of the files, then all of them after a restart: nothing is lost or counted twice."""
    schema = T.table(spark, sf, "events").schema
    work = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    source = spark.read.schema(schema).parquet(f"{sf}/events.parquet").withColumn("half", F.col("event_id") % 2)

    def run() -> None:
        Z.resume_batches(spark, f"{work}/in", schema, lambda batch: batch, output=f"{work}/out",
                         checkpoint=f"{work}/checkpoint").awaitTermination()

    for half in (0, 1):
        source.filter(F.col("half") == half).drop("half").write.mode("append").parquet(f"{work}/in")
        run()
    return spark.read.parquet(f"{work}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("merged_sums", "Z2", """
SELECT event_type, count(*) AS n, covar_pop(value, user_id)/sqrt(var_pop(value)*var_pop(user_id)) AS r FROM events GROUP BY ALL""", floats="r")
def merged_sums(spark, sf):
    e = T.table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    parts = Z.running_sums(e, ["event_type", "day"], "value", "user_id")
    return Z.correlation_from_sums(Z.merge_sums(parts, ["event_type"]), ["event_type"])

"""Folders of predictions, results and feature sets as path and line tables; model records with heads and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as T
from ..registry import query
from ...sources import layouts as L, text as S, weights as M

# ---- predictions: a part is a run of one of four kinds, with three seeds of three cell types ----

_KINDS = "['preds', 'totvar', 'aleatoric', 'epistemic']"


def _paths(spark, sf):
    """Kinds 0: a seed by itself, 1: seeds with plain tables, 2: models, one with uncertainties, 3: seeds with uncertainties."""
    k, n = F.col("k"), F.col("n")
    runs = T.table(spark, sf, "part").select(F.col("p_partkey").alias("k")).select("k", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n"))
    run, seed = F.concat(F.lit("/out/run"), k), F.concat(F.lit("seed"), n)
    uncertain = (k % 4 == 0) | (k % 4 == 3) | ((k % 4 == 2) & (n == 2))
    kinds = F.when(uncertain, F.array(*map(F.lit, L.KINDS))).otherwise(F.array(F.lit("")))
    tables = runs.select("k", "n", run.alias("run"), seed.alias("seed"), F.explode(kinds).alias("kind")).select(
        "*", F.explode(F.array(*map(F.lit, "ANR"))).alias("c"))
    model = F.concat(F.lit("m"), n % 2)
    root = F.when(k % 4 == 0, F.concat_ws("/", "run", "seed")).otherwise(F.col("run"))
    inner = F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 2, F.concat_ws("/", model, "seed")).otherwise(F.col("seed"))
    path = F.concat_ws("/", inner, F.when(F.col("kind") != "", F.col("kind")), F.concat("c", F.lit(".csv")))
    rows = tables.select("k", "n", "kind", "c", root.alias("root"), path.alias("path"))
    noise = rows.filter("c = 'A'")
    hidden = noise.withColumn("path", F.concat(F.lit(".cache/"), "path"))
    return rows.unionByName(hidden.withColumn("c", F.lit("hidden"))).unionByName(
        noise.withColumns({"path": F.regexp_replace("path", r"\.csv$", ".log"), "c": F.lit("log")}))


_EXPECTED = f"""
r AS (SELECT p_partkey AS k, unnest([1, 2, 3]) AS n FROM part),
u AS (SELECT *, k % 4 IN (0, 3) OR (k % 4 = 2 AND n = 2) AS uncertain, '/out/run' || k AS run, 'seed' || n AS seed FROM r),
t AS (SELECT *, unnest(['A', 'N', 'R']) AS cell_type FROM (SELECT *, unnest(CASE WHEN uncertain THEN {_KINDS} ELSE ['preds'] END) AS kind FROM u)),
e AS (SELECT k, n, uncertain, cell_type, kind, seed, CASE WHEN k % 4 = 0 THEN run || '/' || seed ELSE run END AS root,
 CASE k % 4 WHEN 0 THEN 'seed' WHEN 2 THEN 'models' ELSE 'seeds' END AS layout, CASE WHEN k % 4 = 2 THEN 'm' || (n % 2) ELSE 'run' || k END AS model FROM t)"""


@query("prediction_layouts", "S16", f"WITH {_EXPECTED} SELECT root, layout, model, seed, kind, cell_type FROM e")
def prediction_layouts(spark, sf):
    return L.discover_predictions(_paths(spark, sf).select("root", "path")).drop("path")


@query("prediction_layout_faults", "S16", f"""
WITH {_EXPECTED}, roots AS (SELECT DISTINCT root, k, n, model, seed FROM e)
SELECT root, model, seed, 'aleatoric' AS kind, NULL::VARCHAR AS cell_type, 'missing kind' AS fault FROM roots WHERE k % 12 = 3 AND n = 2
UNION ALL SELECT root, model, seed, 'totvar', 'R', 'missing' FROM roots WHERE k % 20 = 4
UNION ALL SELECT root, model, seed, 'epistemic', 'Z', 'extra' FROM roots WHERE k % 20 = 7
UNION ALL SELECT root, model, 'seed3', NULL, 'N', 'missing' FROM roots WHERE k % 20 = 5 AND n = 3
UNION ALL SELECT root, 'm1', NULL, NULL, NULL, 'mixed' FROM roots WHERE k % 20 = 6 AND n = 3
UNION ALL SELECT root, NULL, NULL, NULL, NULL, 'no predictions' FROM roots WHERE k % 20 = 9 AND n = 1""")
def prediction_layout_faults(spark, sf):
    k, n, plain = F.col("k"), F.col("n"), ~F.col("c").isin("hidden", "log")
    p = _paths(spark, sf)
    gone = (((k % 12 == 3) & (n == 2) & (F.col("kind") == "aleatoric"))
            | (plain & (((k % 20 == 4) & (F.col("kind") == "totvar") & (F.col("c") == "R")) | ((k % 20 == 5) & (n == 3) & (F.col("c") == "N")) | (k % 20 == 9))))
    extra = p.filter((k % 20 == 7) & (F.col("kind") == "epistemic") & (F.col("c") == "R")).withColumn("path", F.replace("path", F.lit("R.csv"), F.lit("Z.csv")))
    kinds = p.filter((k % 20 == 6) & (n == 3) & plain).select("root", "path", F.explode(F.array(*map(F.lit, L.KINDS))).alias("kind")).select(
        "root", F.concat(F.regexp_extract("path", "^(.*/)", 1), "kind", F.lit("/"), F.regexp_extract("path", "([^/]+)$", 1)).alias("path"))
    return L.prediction_faults(p.filter(~gone).unionByName(extra).select("root", "path").unionByName(kinds))


# ---- results -------------------------------------------------------------------------------

@query("result_tables", "S15", """
SELECT 'b' || p_size || '/' || (CASE WHEN p_size % 2 = 0 THEN 'this' ELSE 'other' END) || '/results.csv' AS file, 'g' || p_partkey AS gene,
 CASE WHEN p_partkey % 9 <> 0 THEN p_retailprice END AS zscore, CASE WHEN p_size % 2 = 1 THEN 'a "b", ' || p_partkey END AS symbol, NULL::DOUBLE AS pvalue FROM part""",
       floats="zscore pvalue")
def result_tables(spark, sf):
    """Files of two arms with different headers; a quoted symbol in one, empty cells in both, a column that neither has."""
    p = T.table(spark, sf, "part")
    even, z = F.col("p_size") % 2 == 0, F.when(F.col("p_partkey") % 9 != 0, F.col("p_retailprice").cast("string")).otherwise("")
    file = F.concat(F.lit("b"), "p_size", F.lit("/"), F.when(even, "this").otherwise("other"), F.lit("/results.csv"))
    gene, symbol = F.concat(F.lit("g"), "p_partkey"), F.concat(F.lit('"a ""b"", '), "p_partkey", F.lit('"'))
    body = p.select(file.alias("file"), F.when(even, F.concat_ws(",", gene, F.lit("x"), z)).otherwise(F.concat_ws(",", symbol, z, gene)).alias("value"),
                    F.col("p_partkey").alias("ordinal"))
    head = p.select(file.alias("file"), F.when(even, "gene,note,zscore").otherwise("symbol,zscore,gene").alias("value"), F.lit(-1).alias("ordinal")).distinct()
    return L.reconciled(body.unionByName(head), {"gene": "string", "zscore": "double", "symbol": "string", "pvalue": "double"}, required=["gene"])


@query("selected_results", "S15", """
SELECT c_mktsegment AS cell_type, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY ALL""")
def selected_results(spark, sf):
    rows = T.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("cell_type"))
    kept = L.select_labels(rows, ["build-ing", "Machinery", "MACHINERY "])
    return rows.join(kept, "cell_type", "left_semi").groupBy("cell_type").agg(F.count(F.lit(1)).alias("n"))


# ---- feature sets --------------------------------------------------------------------------

def _sidecar_lines(spark, sf):
    """Lines of parallel files: gene ids with versions in every set, positions in all, plain ids in some, ordered by part."""
    p, s = T.table(spark, sf, "part"), F.col("p_partkey") % 7
    base = p.select(s.alias("feature_set"), F.col("p_partkey").alias("ordinal"), F.concat(F.lit("ensg"), F.col("p_partkey") % 50).alias("id"), "p_size")
    fields = [base.select("feature_set", F.lit("gene_ids").alias("field"), "ordinal", F.concat("id", F.lit(".3")).alias("value")),
              base.select("feature_set", F.lit("tss").alias("field"), "ordinal", F.col("p_size").cast("string").alias("value")),
              base.filter("feature_set < 3").select("feature_set", F.lit("ensids").alias("field"), "ordinal", F.upper("id").alias("value"))]
    rows = fields[0].unionByName(fields[1]).unionByName(fields[2])
    return rows.withColumn("file", F.concat_ws(".", "feature_set", "field"))


@query("feature_selection", "S20", """
WITH r AS (SELECT p_partkey % 7 AS feature_set, row_number() OVER (PARTITION BY p_partkey % 7 ORDER BY p_partkey) - 1 AS row, p_partkey, p_size, p_retailprice FROM part)
SELECT feature_set, row, row_number() OVER (PARTITION BY feature_set ORDER BY row) - 1 AS place, 'ENSG' || (p_partkey % 50) AS gene, p_retailprice AS feature,
 CASE WHEN feature_set < 3 THEN 'ENSG' || (p_partkey % 50) END AS ensids, 'ensg' || (p_partkey % 50) || '.3' AS gene_ids, NULL::VARCHAR AS chroms, CAST(p_size AS VARCHAR) AS tss,
 NULL::VARCHAR AS sample_ids FROM r WHERE p_partkey % 50 IN (SELECT s_suppkey % 25 FROM supplier)""", floats="feature")
def feature_selection(spark, sf):
    lines = _sidecar_lines(spark, sf)
    sidecars = L.positions(lines.select("file", "ordinal", "value")).withColumns({
        "feature_set": F.split_part("file", F.lit("."), F.lit(1)).cast("bigint"), "field": F.split_part("file", F.lit("."), F.lit(2))}).drop("file")
    p = T.table(spark, sf, "part")
    rows = p.select((F.col("p_partkey") % 7).cast("string").alias("file"), F.col("p_partkey").alias("ordinal"), F.col("p_retailprice").alias("value"))
    features = L.positions(rows).select(F.col("file").cast("bigint").alias("feature_set"), "row", F.col("value").alias("feature"))
    genes = T.table(spark, sf, "supplier").select(F.concat(F.lit("ENSG"), F.col("s_suppkey") % 25, F.lit(".1")).alias("gene"))
    return L.select_features(features, sidecars, genes)


# ---- model records -------------------------------------------------------------------------

@query("probabilistic_weights", "K5 S6", """
WITH c AS (SELECT 'g' || (l_partkey % 40) AS gene, l_linenumber % 3 AS h, l_suppkey AS place, sum(l_quantity - 25) AS weight FROM lineitem WHERE l_linenumber % 3 < 2 OR l_partkey % 4 > 0 GROUP BY ALL),
g AS (SELECT DISTINCT 'g' || (l_partkey % 40) AS gene, l_partkey % 40 AS k FROM lineitem), heads AS (SELECT gene, k, unnest([0, 1, 2]) AS h FROM g)
SELECT gene, CASE WHEN k % 5 = 0 THEN 'X' ELSE CAST(k AS VARCHAR) END AS chrom, ['mean', 'aleatoric', 'epistemic'][h + 1] AS head, h + 0.5 AS intercept, h > 0 AS log1p,
 row_number() OVER (PARTITION BY gene, h ORDER BY c.place) - 1 + 0 * c.place AS place, 's' || c.place AS snp, weight FROM heads LEFT JOIN (SELECT * FROM c WHERE weight <> 0) c USING (gene, h)""",
       floats="intercept weight")
def probabilistic_weights(spark, sf):
    """Written and read again; genes whose number is a multiple of four have no weights in their third head."""
    li = T.table(spark, sf, "lineitem").select((F.col("l_partkey") % 40).alias("k"), (F.col("l_linenumber") % 3).alias("h"), "l_suppkey", "l_quantity")
    name, gene = F.get(F.array(*map(F.lit, M.HEADS)), F.col("h").cast("int")), F.concat(F.lit("g"), "k")
    sums = li.filter("h < 2 or k % 4 > 0").groupBy("k", "h", "l_suppkey").agg(F.sum(F.col("l_quantity") - 25).cast("double").alias("weight"))
    coefficients = sums.select(gene.alias("gene"), name.alias("head"), F.col("l_suppkey").alias("place"), F.concat(F.lit("s"), "l_suppkey").alias("snp"), "weight")
    heads = li.select("k").distinct().select("k", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("h")).select(
        gene.alias("gene"), F.when(F.col("k") % 5 == 0, "X").otherwise(F.col("k").cast("string")).alias("chrom"), name.alias("head"), (F.col("h") + 0.5).alias("intercept"))
    return M.parse_heads(M.probabilistic_json(coefficients, heads).select("value"))


_ENSEMBLE = """
raw AS (SELECT l_partkey % 20 AS k, l_linenumber % 3 AS m, l_suppkey % (2 + l_linenumber % 3) AS b, l_orderkey % 7 AS place, sum(l_quantity - 25) AS weight FROM lineitem
 WHERE l_orderkey % 7 < 5 OR (l_linenumber % 3 = 0 AND l_suppkey % 2 = 0) GROUP BY ALL),
c AS (SELECT * FROM raw WHERE weight <> 0), fits AS (SELECT DISTINCT l_partkey % 20 AS k, l_linenumber % 3 AS m, l_suppkey % (2 + l_linenumber % 3) AS b FROM lineitem),
full_ AS (SELECT f.k, f.m, f.b, s.place, coalesce(c.weight, 0.0) AS w FROM fits f JOIN (SELECT DISTINCT k, place FROM c) s USING (k) LEFT JOIN c USING (k, m, b, place)),
mem AS (SELECT k, place, m, avg(w) AS mu, var_pop(w) AS v FROM full_ GROUP BY ALL),
pips AS (SELECT k, place, avg(CASE WHEN w <> 0 THEN 1.0 ELSE 0.0 END) AS pip, coalesce(abs(sum(sign(w)))/nullif(count(*) FILTER (WHERE w <> 0), 0), 0) AS sign_stability FROM full_ GROUP BY ALL),
mom AS (SELECT k, place, avg(mu) AS mean, avg(v) + var_pop(mu) AS variance, avg(v) AS within_variance, var_pop(mu) AS between_variance FROM mem GROUP BY ALL)"""


def _ensemble(spark, sf):
    """Members with two, three and four fits, weights with gaps."""
    li = T.table(spark, sf, "lineitem").select(
        F.concat(F.lit("g"), F.col("l_partkey") % 20).alias("gene"), (F.col("l_linenumber") % 3).alias("m"),
        (F.col("l_suppkey") % (2 + F.col("l_linenumber") % 3)).alias("bootstrap"), (F.col("l_orderkey") % 7).alias("place"), "l_quantity", "l_suppkey")
    li = li.withColumn("member", F.concat(F.lit("m"), "m"))
    weight = F.sum(F.col("l_quantity") - 25).cast("double").alias("weight")
    coefficients = li.filter("place < 5 or (m = 0 and l_suppkey % 2 = 0)").groupBy("gene", "member", "bootstrap", "place").agg(weight).filter(
        "weight <> 0").withColumn("snp", F.concat(F.lit("s"), "place"))
    fits = li.select("gene", "member", "bootstrap", (F.col("m") + F.col("bootstrap") / 8).alias("intercept")).distinct()
    return fits, coefficients, li.select("gene", F.substring("gene", 2, 9).alias("chrom")).distinct()


@query("ensemble_weight_moments", "K5 M6", f"""
WITH {_ENSEMBLE} SELECT 'g' || k AS gene, 's' || place AS snp, mean, variance, within_variance, between_variance, pip, sign_stability FROM mom JOIN pips USING (k, place)""",
       floats="mean variance within_variance between_variance pip sign_stability", digits=6)
def ensemble_weight_moments(spark, sf):
    fits, coefficients, _ = _ensemble(spark, sf)
    return M.ensemble_moments(fits, coefficients)


@query("ensemble_weights", "K5 S6", f"""
WITH {_ENSEMBLE}, off AS (SELECT k, avg(i) AS intercept FROM (SELECT k, m, avg(m + b / 8.0) AS i FROM fits GROUP BY ALL) GROUP BY ALL),
kept AS (SELECT * FROM full_ JOIN pips USING (k, place) WHERE pip >= 0.3)
SELECT 'g' || k AS gene, CAST(k AS VARCHAR) AS chrom, 'm' || m || '_' || b AS draw, 's' || place AS snp, w AS weight, intercept, false AS standardized FROM kept JOIN off USING (k)
UNION ALL SELECT 'g' || k, CAST(k AS VARCHAR), 'point', 's' || place, mean, intercept, false FROM mom JOIN pips USING (k, place) JOIN off USING (k) WHERE pip >= 0.3""",
       floats="weight intercept", digits=6)
def ensemble_weights(spark, sf):
    """All draws and the pooled weights, as written and read again; SNPs that few fits include are left out."""
    fits, coefficients, genes = _ensemble(spark, sf)
    records = M.ensemble_json(fits, coefficients, genes, pip_threshold=0.3).select("value")
    return S.parse_weights(records, draws=True).unionByName(S.parse_weights(records))

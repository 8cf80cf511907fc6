"""Summary-statistics gene association over many model draws at once.

Cell type, arm and draw are columns, so one job covers every combination.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions.distributions import two_sided_p
from ..functions.ordered import first_by, row_numbers
from ..functions.storage import reusable


def aligned_z(z, gwas_effect, gwas_other, effect, other):
    """z for the model's effect allele: kept, sign-flipped, or null when alleles differ."""
    return (F.when((gwas_effect == effect) & (gwas_other == other), z)
            .when((gwas_effect == other) & (gwas_other == effect), -z))


def model_table(weights: DataFrame, ld_snps: DataFrame, *, standardized: bool = False) -> DataFrame:
    """Weights with reference SD and alleles; left join so that losses can be counted.

    ``weights(..., gene, snp, weight)``, ``ld_snps(gene, snp, sd, effect_allele,
    non_effect_allele)``. Standardised weights are divided by the SD.
    """
    usable = weights.filter(F.col("weight").isNotNull() & ~F.isnan("weight") & (F.col("weight") != 0))
    joined = usable.join(
        ld_snps.select("gene", "snp", "sd", "effect_allele", "non_effect_allele"),
        ["gene", "snp"], "left")
    if standardized:
        joined = joined.withColumn("weight", F.try_divide("weight", "sd"))
    return joined


def weight_attrition(weights: DataFrame, ld_snps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of zero, non-finite, missing-in-reference and kept weights."""
    w = F.col("weight")
    bad = w.isNull() | F.isnan(w) | (F.abs(w) == float("inf"))
    flagged = weights.join(ld_snps.select("gene", "snp", F.lit(True).alias("known")),
                           ["gene", "snp"], "left")
    return flagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_weights"),
        F.count_if(bad).alias("n_non_finite"),
        F.count_if(~bad & (w == 0)).alias("n_zero"),
        F.count_if(~bad & (w != 0) & F.col("known").isNull()).alias("n_missing_snp"),
        F.count_if(~bad & (w != 0) & F.col("known")).alias("n_kept"))


def reference_plan(model_snps: DataFrame, variants: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Model SNPs found in a reference panel; error where a gene spans chromosomes."""
    found = model_snps.join(variants.select("snp", "chrom", "bp"), "snp", "inner")
    spans = found.groupBy(*keys, "gene").agg(
        F.count_distinct("chrom").alias("n_chrom"), F.min("bp").alias("start_bp"),
        F.max("bp").alias("end_bp"), F.min("chrom").alias("chrom"),
        F.count(F.lit(1)).alias("n_snps_found"))
    total = model_snps.groupBy(*keys, "gene").agg(F.count(F.lit(1)).alias("n_snps_in_model"))
    chrom = F.when(F.col("n_chrom") > 1,
                   F.raise_error(F.concat(F.lit("gene on several chromosomes: "),
                                          F.col("gene").cast("string"))).cast("string")
                   ).otherwise(F.col("chrom").cast("string"))
    n_found = F.coalesce("n_snps_found", F.lit(0))
    return total.join(spans, [*keys, "gene"], "left").select(
        *keys, "gene", chrom.alias("chrom"), "start_bp", "end_bp",
        "n_snps_in_model", n_found.alias("n_snps_found"),
        (F.col("n_snps_in_model") - n_found).alias("n_snps_missing"))


#: SNPs that a tile of a gene has on average, and draws that are multiplied at a time.
TILE, DRAWS = 512, 2048


def _block_form(covariance: pa.Table, weights: pa.Table) -> pa.Table:
    """diag(W S W') of one block: S from the covariance rows of a pair of tiles, W the draws' weights of the SNPs in both."""
    snps, place = np.unique(weights.column("snp").to_numpy(), return_inverse=True)
    sides = []
    for side in ("snp1", "snp2"):
        given = covariance.column(side).to_numpy()
        at = np.minimum(np.searchsorted(snps, given), max(0, len(snps) - 1))
        sides.append((at, snps[at] == given))
    live = sides[0][1] & sides[1][1]
    first, second = (at[live] for at, _ in sides)
    value = covariance.column("value").to_numpy()[live] * np.where(first == second, 1.0, 2.0)
    matrix = np.bincount(first * len(snps) + second, value, len(snps) ** 2).reshape(len(snps), len(snps))
    draws, row = np.unique(weights.column("k").to_numpy(), return_inverse=True)
    weight = weights.column("weight").to_numpy()
    order = np.argsort(row, kind="stable")
    forms = []
    for lo in range(0, len(draws), DRAWS):
        part = order[slice(*np.searchsorted(row[order], [lo, lo + DRAWS]))]
        dense = np.bincount((row[part] - lo) * len(snps) + place[part], weight[part], min(DRAWS, len(draws) - lo) * len(snps)).reshape(-1, len(snps))
        forms.append(np.einsum("ij,ij->i", dense @ matrix, dense))
    return pa.table({"k": pa.array(draws, pa.int32()), "part": pa.array(np.concatenate(forms))})


def quadratic_forms(weights: DataFrame, ld_cov: DataFrame, *, tile: int = TILE) -> DataFrame:
    """(gene, k, var_g): w' S w of every draw ``k`` of a gene that shares a covariance row with it.

    ``weights(gene, snp, k, weight)``; repeated weights add up. ``ld_cov(gene, snp1, snp2, value)`` has the diagonal and one triangle.
    Both sides meet once per gene, where all draws are one matrix product, so a covariance row is shuffled once at its own
    size. The SNPs of a gene with more than ``tile`` fall into tiles, and each pair of tiles is a block of its own.
    """
    wide = weights.select("gene", "snp").distinct().groupBy("gene").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") > tile).select("gene", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    wide = reusable(wide)

    def tile_of(snp: str) -> Column:
        return F.pmod(F.xxhash64(snp), F.coalesce("tiles", F.lit(1))).cast("int")

    one, other = tile_of("snp1"), tile_of("snp2")
    rows = ld_cov.join(wide, "gene", "left").select(
        "gene", F.least(one, other).alias("t1"), F.greatest(one, other).alias("t2"), "snp1", "snp2", F.col("value").cast("double").alias("value"))
    tiled = weights.join(wide, "gene", "left").withColumn("t", tile_of("snp")).withColumn(
        "u", F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1)))
    spread = tiled.select("gene", F.least("t", "u").alias("t1"), F.greatest("t", "u").alias("t2"), "snp", "k", F.col("weight").cast("double").alias("weight"))
    kind = weights.schema["gene"].dataType
    out = StructType([StructField("gene", kind), StructField("k", IntegerType()), StructField("part", DoubleType())])

    def forms(key: tuple, covariance: pa.Table, held: pa.Table) -> pa.Table:
        if not covariance.num_rows or not held.num_rows:
            return to_arrow_schema(out).empty_table()
        found = _block_form(covariance, held)
        return found.add_column(0, "gene", pa.repeat(key[0], found.num_rows))

    blocks = ["gene", "t1", "t2"]
    parts = spread.groupBy(*blocks).cogroup(rows.groupBy(*blocks)).applyInArrow(lambda key, w, c: forms(key, c, w), out)
    return parts.groupBy("gene", "k").agg(F.sum("part").alias("var_g"))


def gene_association(weights: DataFrame, ld_snps: DataFrame, ld_cov: DataFrame, gwas: DataFrame,
                     keys: Sequence[str] = ("cell_type", "arm", "draw"), *,
                     standardized: bool = False) -> DataFrame:
    """z = sum(w z sd) / sqrt(w' S w) per (keys, gene), with effect size and SNP counts.

    ``ld_cov(gene, snp1, snp2, value)`` holds the diagonal and one triangle.
    ``gwas(snp, effect_allele, non_effect_allele, zscore, beta, pvalue)``.
    """
    keys = list(keys)
    study = gwas.select("snp", F.col("effect_allele").alias("g_effect"),
                        F.col("non_effect_allele").alias("g_other"),
                        F.col("zscore").alias("g_z"), F.col("beta").alias("g_beta"),
                        F.col("pvalue").alias("g_p"))
    model = model_table(weights, ld_snps, standardized=standardized).join(study, "snp", "left")

    def oriented(c):
        return aligned_z(F.col(c), F.col("g_effect"), F.col("g_other"),
                         F.col("effect_allele"), F.col("non_effect_allele"))

    model = reusable(model.select(*keys, "gene", "snp", "weight", "sd", oriented("g_z").alias("z"),
                                  oriented("g_beta").alias("b"), "g_p"))
    used = F.col("z").isNotNull()
    sides = model.groupBy(*keys, "gene").agg(
        F.sum(F.when(used, F.col("weight") * F.col("z") * F.col("sd"))).alias("numerator"),
        F.sum(F.when(used, F.col("weight") * F.col("b") * F.col("sd") * F.col("sd"))).alias("effect_sum"),
        F.count_if(used).alias("n_snps_used"),
        F.count("sd").alias("n_snps_in_cov"),
        F.count(F.lit(1)).alias("n_snps_in_model"),
        F.min(F.when(used, F.col("g_p"))).alias("best_gwas_p"),
        F.max(F.when(used, F.abs("weight"))).alias("largest_weight"))

    numbered = reusable(row_numbers(model.select(*keys).distinct(), [], keys, rn="k"))
    kept = model.filter(used).join(numbered, keys).select("gene", "snp", F.col("k").cast("int").alias("k"), "weight")
    variance = quadratic_forms(kept, ld_cov).join(numbered, "k").select(*keys, "gene", "var_g")
    scored = (sides.join(variance, [*keys, "gene"]).filter("var_g > 0")
              .withColumn("zscore", F.try_divide("numerator", F.sqrt("var_g"))))
    return (scored
            .select(*keys, "gene", "zscore", F.try_divide("effect_sum", "var_g").alias("effect_size"),
                    two_sided_p(F.col("zscore")).alias("pvalue"), "var_g", "n_snps_used", "n_snps_in_cov",
                    "n_snps_in_model", "best_gwas_p", "largest_weight"))


def attach_symbols(df: DataFrame, names: DataFrame, *, gene: str = "gene",
                   symbol: str = "gene_name") -> DataFrame:
    """Fill a symbol only where it is blank or repeats the id. ``names(gene, symbol)``."""
    unique = first_by(names.select(F.col("gene").alias("n_gene"), F.col("symbol").alias("n_symbol")),
                      ["n_gene"], [F.col("n_symbol")])
    have = F.col(symbol)
    blank = have.isNull() | (F.trim(have) == "") | (F.lower(have) == "nan") | (
        have == F.col(gene).cast("string"))
    joined = df.join(unique, F.col(gene) == F.col("n_gene"), "left")
    return joined.withColumn(symbol, F.when(blank, F.coalesce("n_symbol", have)).otherwise(have)).drop(
        "n_gene", "n_symbol")

"""The association run: weights and summary statistics in, ranked placed genes out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..operators.association import gene_association
from ..operators.intervals import assign_blocks
from ..operators.pooling import pool_draws


def association_run(weights: DataFrame, ld_snps: DataFrame, ld_cov: DataFrame, gwas: DataFrame,
                    positions: DataFrame, blocks: DataFrame, *,
                    keys: Sequence[str] = ("cell_type", "arm"), standardized: bool = False,
                    fdr: float = 0.05, bin_width: int = 1_000_000) -> DataFrame:
    """Every draw of every (cell type, arm) in one job.

    ``positions(gene, chrom, bp)``; genes without a position keep block -1.
    """
    per_draw = gene_association(weights, ld_snps, ld_cov, gwas, [*keys, "draw"],
                                standardized=standardized)
    pooled = pool_draws(per_draw, keys, fdr=fdr)
    placed = assign_blocks(positions, blocks, bin_width=bin_width).select(
        "gene", "chrom", "bp", "block_index", "block")
    return pooled.join(placed, "gene", "left").withColumn(
        "block_index", F.coalesce("block_index", F.lit(-1)))

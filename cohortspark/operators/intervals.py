"""Position joins and block summaries.

Every position join carries an equality key (chromosome and position bin), so
none of them degrades into a nested loop; block tables are broadcast only when
the planner shows them small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import exprs as X
from ..functions.ordered import first_by, previous, row_numbers, running

UNASSIGNED = -1
# Assembly names that mean the same build.
BUILD_ALIASES = {"hg19": "GRCh37", "grch37": "GRCh37", "b37": "GRCh37", "37": "GRCh37",
                 "hg38": "GRCh38", "grch38": "GRCh38", "b38": "GRCh38", "38": "GRCh38"}


def canonical_build(name: str) -> str:
    key = name.strip().lower()
    if key not in BUILD_ALIASES:
        raise ValueError(f"unknown genome build: {name!r}")
    return BUILD_ALIASES[key]


def require_same_build(blocks_build: str, panel_build: str) -> str:
    left, right = canonical_build(blocks_build), canonical_build(panel_build)
    if left != right:
        raise ValueError(f"block file is {left} but the panel is {right}")
    return left


def _bin(c: Column, width: int) -> Column:
    return F.floor(c / F.lit(width)).cast("bigint")


def assign_blocks(positions: DataFrame, blocks: DataFrame, *, chrom: str = "chrom", bp: str = "bp",
                  bin_width: int = 1_000_000) -> DataFrame:
    """Block of each position, half-open; index -1 and null label outside every block.

    ``blocks(chrom, start, stop, block_index, block)`` must not overlap.
    """
    spread = blocks.select(
        F.col("chrom").alias("b_chrom"), "start", "stop", "block_index", "block",
        F.explode(F.sequence(_bin(F.col("start"), bin_width),
                             _bin(F.col("stop") - 1, bin_width))).alias("b_bin"))
    on = ((F.col(chrom) == F.col("b_chrom")) & (_bin(F.col(bp), bin_width) == F.col("b_bin"))
          & (F.col(bp) >= F.col("start")) & (F.col(bp) < F.col("stop")))
    return positions.join(spread, on, "left").select(
        *positions.columns, F.coalesce("block_index", F.lit(UNASSIGNED)).alias("block_index"), "block")


def block_of_gene(genes: DataFrame, positions: DataFrame, blocks: DataFrame, *,
                  bin_width: int = 1_000_000) -> DataFrame:
    """Blocks by gene id, falling back to the id without its version."""
    placed = assign_blocks(positions, blocks, bin_width=bin_width).select("gene", "block_index", "block")
    bare = first_by(placed.withColumn("bare", F.split_part("gene", F.lit("."), F.lit(1))), ["bare"],
                    [F.col("gene")]).select(
        "bare", F.col("block_index").alias("bare_index"), F.col("block").alias("bare_block"))
    joined = (genes.withColumn("bare", F.split_part("gene", F.lit("."), F.lit(1)))
              .join(placed, "gene", "left").join(bare, "bare", "left"))
    return joined.select(*genes.columns,
                         F.coalesce("block_index", "bare_index", F.lit(UNASSIGNED)).alias("block_index"),
                         F.coalesce("block", "bare_block").alias("block"))


def window_join(genes: DataFrame, variants: DataFrame, *, window: int,
                bin_width: int | None = None) -> DataFrame:
    """Variants with ``tss - window <= bp <= tss + window`` on the same chromosome.

    Genes are repeated into the few bins their window touches; a variant lies in
    exactly one bin, so no pair appears twice.
    """
    width = bin_width or max(2 * window, 1)
    low, high = F.col("tss") - window, F.col("tss") + window
    spread = genes.select("*", F.explode(F.sequence(_bin(low, width), _bin(high, width))).alias("__bin"))
    placed = variants.withColumn("__bin", _bin(F.col("bp"), width))
    return (spread.join(placed, ["chrom", "__bin"])
            .filter(F.col("bp").between(low, high)).drop("__bin"))


def overlaps(start: Column, end: Column, region_start, region_end) -> Column:
    """Closed-interval overlap."""
    return (end >= region_start) & (start <= region_end)


def block_label_region(label: Column) -> Column:
    """``chrC:a-b`` -> struct(chrom, start, end)."""
    return X.parse_region(label)


def block_metrics(hits: DataFrame, blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many blocks a gene set covers; ``hits(keys, gene, block_index)``."""
    per_block = hits.groupBy(*keys, "block_index").agg(F.count(F.lit(1)).alias("n"))
    inside = F.col("block_index") >= 0
    total = blocks.select(F.count(F.lit(1)).alias("n")).scalar()
    agg = per_block.groupBy(*keys).agg(
        F.sum("n").alias("n_genes"), F.count_if(inside).alias("n_ld_blocks"),
        F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias("n_inside"),
        F.coalesce(F.max(F.when(inside, F.col("n"))), F.lit(0)).alias("max_genes_in_one_ld_block"))
    return agg.select(
        *keys, "n_genes", "n_ld_blocks", total.alias("n_ld_blocks_total"),
        F.try_divide("n_ld_blocks", total).alias("frac_ld_blocks"),
        F.try_divide("n_inside", F.nullif("n_ld_blocks", F.lit(0))).alias("genes_per_ld_block"),
        "max_genes_in_one_ld_block", (F.col("n_genes") - F.col("n_inside")).alias("n_genes_outside_ld_blocks"))


def agreement_block_curve(pooled: DataFrame, blocks: DataFrame, keys: Sequence[str],
                          thresholds: Sequence[float], *, criterion: str = "bonferroni") -> DataFrame:
    """Genes and blocks kept as the agreement threshold rises (0 means more than 0).

    One pass counts each block per threshold; no row is repeated per threshold.
    """
    a = F.coalesce(F.col(f"agreement_{criterion}"), F.lit(0.0))
    passes = [a > 0 if t == 0 else a >= t for t in thresholds]
    per_block = pooled.groupBy(*keys, "block_index").agg(
        *[F.count_if(c).alias(f"n{i}") for i, c in enumerate(passes)], F.count_if(a > 0).alias("n_base"))
    inside = F.col("block_index") >= 0
    rows = []
    for i, t in enumerate(thresholds):
        n = F.col(f"n{i}")
        rows.append(F.struct(
            F.lit(float(t)).alias("threshold"), F.sum(n).alias("n_genes"),
            F.count_if(inside & (n > 0)).alias("n_ld_blocks"),
            F.coalesce(F.sum(F.when(inside, n)), F.lit(0)).alias("n_inside"),
            F.coalesce(F.max(F.when(inside, n)), F.lit(0)).alias("max_genes_in_one_ld_block")))
    total = blocks.select(F.count(F.lit(1)).alias("n")).scalar()
    wide = per_block.groupBy(*keys).agg(
        F.array(*rows).alias("rows"), F.sum("n_base").alias("n_base"),
        F.count_if(inside & (F.col("n_base") > 0)).alias("n_base_blocks"))
    long = wide.select(*keys, "n_base", "n_base_blocks", F.inline("rows"))
    return long.select(
        *keys, "threshold", "n_genes", "n_ld_blocks", total.alias("n_ld_blocks_total"),
        F.try_divide("n_inside", F.nullif("n_ld_blocks", F.lit(0))).alias("genes_per_ld_block"),
        "max_genes_in_one_ld_block",
        F.try_divide("n_genes", F.nullif("n_base", F.lit(0))).alias("frac_genes_retained"),
        F.try_divide("n_ld_blocks", F.nullif("n_base_blocks", F.lit(0))).alias("frac_ld_blocks_retained"))


def genes_per_block_histogram(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many implicated blocks hold 1, 2, ... genes."""
    per_block = (hits.filter("block_index >= 0").groupBy(*keys, "block_index")
                 .agg(F.count(F.lit(1)).alias("genes_in_block")))
    return per_block.groupBy(*keys, "genes_in_block").agg(F.count(F.lit(1)).alias("n_blocks"))


def genome_layout(positions: DataFrame, *, gap: float = 1.02) -> tuple[DataFrame, DataFrame]:
    """Cumulative genome x per row, and one tick per chromosome.

    The running offset orders chromosomes, a fixed small vocabulary, not rows.
    """
    keyed = positions.filter("chrom is not null and bp is not null").withColumns(
        {"chrom_no": X.chrom_order(F.col("chrom")), "chrom_text": X.chrom_key(F.col("chrom"))})
    spans = keyed.groupBy("chrom_no", "chrom_text").agg(
        F.coalesce(F.nullif(F.max("bp").cast("double"), F.lit(0.0)), F.lit(1.0)).alias("span"))
    before = W.orderBy("chrom_no", "chrom_text").rowsBetween(W.unboundedPreceding, -1)
    offsets = spans.withColumn("offset", F.coalesce(F.sum(F.col("span") * gap).over(before), F.lit(0.0)))
    placed = keyed.join(offsets, ["chrom_no", "chrom_text"]).select(
        *positions.columns, (F.col("offset") + F.col("bp")).alias("x"))
    ticks = offsets.select(F.col("chrom_text").alias("chrom"), (F.col("offset") + F.col("span") / 2).alias("tick"))
    return placed, ticks


def block_runs(rows: DataFrame, keys: Sequence[str], order: Sequence[str], *,
               limit: int | None = None) -> DataFrame:
    """Inclusive 0-based runs of the same assigned block along ``order``."""
    placed = row_numbers(rows, keys, order, rn="pos", limit=limit)
    stepped = previous(placed, keys, order, {"before": "block_index"}, limit=limit)
    change = F.when(F.col("before").isNull() | (F.col("before") != F.col("block_index")), 1).otherwise(0)
    numbered = running(stepped, keys, order, sums={"run": change}, limit=limit)
    return (numbered.filter("block_index >= 0").groupBy(*keys, "run", "block_index")
            .agg((F.min("pos") - 1).alias("run_start"), (F.max("pos") - 1).alias("run_end"))
            .drop("run"))


def widest_gap(df: DataFrame, keys: Sequence[str], y: str, *, floor: float,
               min_fraction: float = 0.35, limit: int | None = None) -> DataFrame:
    """Widest empty band above ``floor``, only where it is wide and its top sparse enough."""
    keys = list(keys)
    values = df.filter(F.col(y).isNotNull()).groupBy(*keys, y).agg(F.count(F.lit(1)).alias("n"))
    sized = values.groupBy(*keys).agg(F.sum("n").alias("n_all"), F.max(y).alias("top"))
    above = values.filter(F.col(y) > floor).select(*keys, y, "n")
    stepped = previous(above, keys, [y], {"low": y}, limit=limit)
    gaps = stepped.filter("low is not null").groupBy(*keys).agg(
        F.max(F.struct((F.col(y) - F.col("low")).alias("gap"), (-F.col("low")).alias("neg_low"),
                       F.col(y).alias("high"))).alias("g"))
    picked = gaps.select(*keys, (-F.col("g.neg_low")).alias("low"), F.col("g.high").alias("high"))
    joined = above.join(picked, keys) if keys else above.crossJoin(F.broadcast(picked))
    beyond = joined.groupBy(*keys, "low", "high").agg(
        F.sum(F.when(F.col(y) > F.col("low"), F.col("n")).otherwise(0)).alias("n_above"))
    full = beyond.join(sized, keys) if keys else beyond.crossJoin(F.broadcast(sized))
    wide = (F.col("high") - F.col("low")) >= F.greatest(min_fraction * F.col("top"), F.lit(5.0))
    sparse = F.col("n_above") <= F.greatest(F.lit(10.0), 0.02 * F.col("n_all"))
    return full.filter(wide & sparse).select(*keys, "low", "high")

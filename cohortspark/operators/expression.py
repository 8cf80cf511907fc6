"""Single-cell counts to per-donor tables, gene filters, cohort selection and alignment.

Counts are sparse: an absent (gene, sample) pair means zero. Wherever zeros
matter they enter through group sizes, never through a materialised grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import exprs as X
from ..functions.ordered import average_ranks, row_numbers, value_counts
from ..functions.storage import dealt, reusable, grid


def clean_cells(cells: DataFrame, required: Sequence[str]) -> DataFrame:
    """Cells with every required annotation; a missing column is an error."""
    missing = [c for c in required if c not in cells.columns]
    if missing:
        raise ValueError(f"cell table lacks columns {missing}")
    return cells.dropna(subset=list(required))


def pseudobulk(counts: DataFrame, cells: DataFrame, group: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Summed counts per (group, gene), and cells per group.

    ``n_cells`` counts cells, not non-zero entries, so it comes from the cell table.
    """
    group = list(group)
    sums = (counts.join(cells.select("cell_id", *group), "cell_id")
            .groupBy(*group, "gene").agg(F.sum("count").alias("sum_count")))
    return sums, cells.groupBy(*group).agg(F.count(F.lit(1)).alias("n_cells"))


def mean_per_cell(sums: DataFrame, groups: DataFrame, group: Sequence[str]) -> DataFrame:
    return sums.join(groups, list(group)).withColumn("value", F.col("sum_count") / F.col("n_cells"))


def aggregate_donors(sums: DataFrame, groups: DataFrame, *, how: str = "cell-weighted",
                     by: Sequence[str] = ("cell_type",)) -> DataFrame:
    """One value per (cell type, gene) over donors.

    ``cell-weighted``: counts / cells; ``mean-of-sums``: counts / donors;
    ``normalized``: cell-weighted mean of per-gene min-max values. Donors
    without the gene still count in every denominator.
    """
    by = list(by)
    totals = groups.groupBy(*by).agg(F.sum("n_cells").alias("cells"), F.count(F.lit(1)).alias("donors"))
    if how in ("cell-weighted", "mean-of-sums"):
        per_gene = sums.groupBy(*by, "gene").agg(F.sum("sum_count").alias("total"))
        below = "cells" if how == "cell-weighted" else "donors"
        return per_gene.join(totals, by).select(*by, "gene", F.try_divide("total", below).alias("value"))
    if how != "normalized":
        raise ValueError(f"unknown donor aggregation {how!r}")
    v = F.col("sum_count") / F.col("n_cells")
    per_gene = sums.join(groups, [c for c in groups.columns if c != "n_cells"]).groupBy(*by, "gene").agg(
        F.sum("sum_count").alias("total"), F.count(F.lit(1)).alias("present"),
        F.min(v).alias("low"), F.max(v).alias("high"))
    joined = per_gene.join(totals, by)
    absent = F.col("present") < F.col("donors")
    low = F.when(absent, F.least("low", F.lit(0.0))).otherwise(F.col("low"))
    high = F.when(absent, F.greatest("high", F.lit(0.0))).otherwise(F.col("high"))
    mean = F.try_divide("total", "cells")
    return joined.select(*by, "gene", F.when(high > low, (mean - low) / F.nullif(high - low, F.lit(0.0)))
                         .otherwise(F.lit(0.0)).alias("value"))


def expressed_genes(expr: DataFrame, *, min_fraction: float, min_log_sd: float,
                    keys: Sequence[str] = ()) -> DataFrame:
    """Genes expressed in enough donors with enough spread, over all donors given."""
    x = F.col("value")
    logged = F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0))))
    stats = expr.groupBy(*keys, "gene").agg(
        F.avg((x > 0).cast("double")).alias("fraction"), F.stddev_pop(logged).alias("log_sd"))
    return stats.filter((F.col("fraction") >= min_fraction) & (F.col("log_sd") >= min_log_sd))


def filter_by_expression(sums: DataFrame, groups: DataFrame, *, min_cells: int, min_reads: float,
                         min_cpm: float, min_prop: float, min_variance: float,
                         by: Sequence[str] = ("cell_type",), scope: Sequence[str] = ()) -> DataFrame:
    """Genes kept per cell type: reads and CPM reached in enough donors, and variance.

    The donor requirement counts every donor of the input (of the scope, e.g. an
    age stage), not those passing QC. Zeros enter the variance by arithmetic.
    """
    by, scope = list(by), list(scope)
    sums, groups = reusable(sums), reusable(groups)
    donors = groups.groupBy(*scope).agg(F.count_distinct("donor").alias("n_donors"))
    passing = groups.filter(F.col("n_cells") >= min_cells)
    sizes = passing.groupBy(*by).agg(F.count(F.lit(1)).alias("n_valid"))
    sample = [c for c in groups.columns if c != "n_cells"]
    library = sums.groupBy(*sample).agg(F.sum("sum_count").alias("library"))
    rows = sums.join(passing, sample).join(library, sample)
    count, per_cell = F.col("sum_count"), F.col("sum_count") / F.col("n_cells")
    cpm = F.coalesce(F.try_divide(count, F.nullif("library", F.lit(0.0))), F.lit(0.0)) * 1e6
    stats = rows.groupBy(*by, "gene").agg(
        F.count_if(count >= min_reads).alias("n_reads"), F.count_if(cpm >= min_cpm).alias("n_cpm"),
        F.count(F.lit(1)).alias("n"), F.avg(per_cell).alias("m"), F.var_pop(per_cell).alias("v"))
    joined = stats.join(sizes, by)
    joined = joined.join(donors, scope) if scope else joined.withColumn(
        "n_donors", donors.select("n_donors").scalar())
    need = F.greatest(F.lit(1.0), F.ceil(F.col("n_donors") * min_prop).cast("double"))
    n, total = F.col("n"), F.col("n_valid")
    # Present rows hold (n, m, v); the other total - n rows are zero.
    spread = n / total * (F.col("v") + F.col("m") * F.col("m") * (total - n) / total)
    return joined.filter((F.col("n_reads") >= need) & (F.col("n_cpm") >= need)
                         & (total >= 2) & (spread > min_variance)).select(*by, "gene")


def min_max(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Scale to [0, 1] per group over non-null rows; a constant group becomes 0."""
    keys = list(keys)
    ends = df.groupBy(*keys).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    x, low, high = F.col(value), F.col("__low"), F.col("__high")
    scaled = F.when(high > low, (x - low) / F.nullif(high - low, F.lit(0.0))).when(x.isNotNull(), 0.0)
    return df.join(ends, keys).withColumn(value, scaled).select(*df.columns)


def percentile_ranks(df: DataFrame, keys: Sequence[str], value: str = "value", *, out: str = "percentile",
                     limit: int | None = None) -> DataFrame:
    """Average rank over the non-null count, in (0, 1]."""
    ranked = average_ranks(df, keys, value, out="__r", n="__n", limit=limit)
    return ranked.withColumn(out, F.try_divide("__r", "__n")).select(*df.columns, out)


def sparse_percentiles(present: DataFrame, sizes: DataFrame, keys: Sequence[str], value: str, *,
                       limit: int | None = None) -> DataFrame:
    """Percentile ranks where ``sizes(keys, n_all)`` says how many entries exist.

    The absent entries are zeros forming one tie block below every positive
    value. Returns one row per distinct value, the zero block included.
    """
    keys = list(keys)
    positive = value_counts(present.filter(F.col(value) > 0), keys, value, limit=limit)
    n_pos = positive.groupBy(*keys).agg(F.max("n_valid").alias("n_pos"))
    filled = sizes.join(n_pos, keys, "left").withColumn(
        "zeros", F.col("n_all") - F.coalesce("n_pos", F.lit(0)))
    above = positive.join(filled, keys).select(
        *keys, value, F.col("n_ties").alias("n"),
        ((F.col("zeros") + F.col("n_upto") - (F.col("n_ties") - 1) / 2.0) / F.col("n_all")).alias("percentile"))
    block = filled.filter("zeros > 0").select(
        *keys, F.lit(0.0).alias(value), F.col("zeros").alias("n"),
        ((F.col("zeros") + 1) / 2.0 / F.col("n_all")).alias("percentile"))
    return above.unionByName(block)


# ---- cohorts -------------------------------------------------------------------------------

def contiguous_part(df: DataFrame, order: Sequence[str], k: int, n: int, *, rule: str = "floor",
                    limit: int | None = None) -> DataFrame:
    """The ``k``-th of ``n`` near-equal contiguous runs (1-based).

    ``floor`` cuts at floor(k T / n); ``divmod`` gives the remainder to the first runs.
    """
    if not 1 <= k <= n:
        raise ValueError("need 1 <= k <= n")
    placed = row_numbers(df, [], order, rn="__rn", total="__all", limit=limit)
    total = F.col("__all")
    if rule == "floor":
        start, stop = F.floor(total * (k - 1) / n), F.floor(total * k / n)
    elif rule == "divmod":
        quotient, extra = F.floor(total / n), total % n
        start = quotient * (k - 1) + F.least(F.lit(k - 1), extra)
        stop = start + quotient + F.when(F.lit(k) <= extra, 1).otherwise(0)
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return placed.filter((F.col("__rn") > start) & (F.col("__rn") <= stop)).select(*df.columns)


def sample_donors(donors: DataFrame, n: int, *, seed: int, donor: str = "donor",
                  exclude: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """``n`` donors in a reproducible hash order, after removing held-out ones."""
    pool = donors if exclude is None else donors.join(exclude.select(donor), donor, "left_anti")
    placed = row_numbers(pool.withColumn("__h", X.shuffle_order(seed, F.col(donor))), [], ["__h", donor], rn="__rn", limit=limit)
    return placed.filter(F.col("__rn") <= n).drop("__h", "__rn")


def require_donors(wanted: DataFrame, present: DataFrame, *, donor: str = "donor") -> DataFrame:
    """Wanted donors missing from ``present`` (empty when all are there)."""
    return wanted.select(donor).join(present.select(donor).distinct(), donor, "left_anti")


def gene_folds(df: DataFrame, *, gene: str = "gene", donor: str = "donor", keys: Sequence[str] = (),
               seed: int = 42, test_fraction: float = 0.2, min_train: int = 3, min_test: int = 2,
               limit: int | None = None) -> DataFrame:
    """Per-gene reproducible train/test label; null where a gene has too few donors."""
    hashed = df.withColumn("__h", X.shuffle_order(seed, F.col(gene), F.col(donor)))
    placed = row_numbers(hashed, [*keys, gene], ["__h", donor], rn="__rn", total="__n", limit=limit)
    n = F.col("__n")
    n_test = F.greatest(F.lit(min_test), F.least(F.bround(n * test_fraction).cast("bigint"), n - min_train))
    fold = F.when(n >= min_train + min_test,
                  F.when(F.col("__rn") <= n_test, "test").otherwise("train"))
    return placed.withColumn("fold", fold).select(*df.columns, "fold")


def chromosome_folds(df: DataFrame, validation: Sequence[str], test: Sequence[str], *,
                     chrom: str = "chrom") -> DataFrame:
    key = X.chrom_key(F.col(chrom))
    return df.withColumn("fold", F.when(key.isin(list(test)), "test")
                         .when(key.isin(list(validation)), "validation").otherwise("train"))


def skip_first_donors(donors: DataFrame, n: int, excluded: DataFrame, *, order: str = "ordinal",
                      donor: str = "donor", limit: int | None = None) -> DataFrame:
    """Drop the first ``n`` donors in ``order`` and an exclusion list."""
    placed = row_numbers(donors, [], [order], rn="__rn", limit=limit)
    return placed.filter(F.col("__rn") > n).drop("__rn").join(excluded.select(donor), donor, "left_anti")


def split_by_list(df: DataFrame, test_donors: DataFrame, *, donor: str = "donor"
                  ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, test, listed donors that are missing)."""
    listed = test_donors.select(donor).distinct()
    return (df.join(listed, donor, "left_anti"), df.join(listed, donor, "left_semi"),
            require_donors(listed, df, donor=donor))


# ---- alignment -----------------------------------------------------------------------------

def align_genes(df: DataFrame, features: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Pin the gene axis to ``features(gene)``: extra genes go, undetected ones become 0.

    A gene detected anywhere keeps its missing values. Undetected genes repeat
    once per group, which is the dense result asked for.
    """
    keys = list(keys)
    wanted = features.select("gene").distinct()
    kept = df.join(wanted, "gene", "left_semi").select(*keys, "gene", value)
    undetected = wanted.join(df.select("gene").distinct(), "gene", "left_anti")
    filled = (grid(undetected, df.select(*keys).distinct()).select(*keys, "gene", F.lit(0.0).alias(value)))
    return kept.unionByName(filled)


def gene_axis_report(df: DataFrame, features: DataFrame) -> DataFrame:
    """Counts of matched, dropped and undetected genes, and of duplicated feature ids."""
    a = df.select("gene").distinct().withColumn("a", F.lit(1))
    b = features.groupBy("gene").agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, "gene", "full_outer").agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_matched"),
        F.count_if(F.col("b").isNull()).alias("n_dropped"),
        F.count_if(F.col("a").isNull()).alias("n_undetected"),
        F.count_if(F.col("b") > 1).alias("n_duplicated"))


def attach_target(rows: DataFrame, target: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Optional target: rows without one keep a null."""
    return rows.join(target.select(*keys, F.col("value").alias(name)), list(keys), "left")


def members_in_common(df: DataFrame, keys: Sequence[str], member: str) -> DataFrame:
    """Key combinations that every member has."""
    n_members = df.select(F.count_distinct(member)).scalar()
    return (df.groupBy(*keys).agg(F.count_distinct(member).alias("__n"))
            .filter(F.col("__n") == n_members).drop("__n"))


def population_moments(df: DataFrame, keys: Sequence[str], *, logged: bool = True) -> DataFrame:
    """Across-donor mean in the transformed space and population variance (two donors or more)."""
    x = X.safe_log1p(F.col("value")) if logged else F.col("value")
    return df.groupBy(*keys).agg(
        F.count("value").alias("n_donors"), F.avg(x).alias("mean"),
        F.when(F.count("value") >= 2, F.var_pop(x)).alias("variance"))


def fill_with_mean(df: DataFrame, keys: Sequence[str], *, donor: str = "donor", logged: bool = True) -> DataFrame:
    """Every (donor, group) pair, missing ones filled by the group's mean and marked.

    The complete grid is the asked-for result; see :func:`grid` for how it spreads.
    """
    keys = list(keys)
    x = X.safe_log1p(F.col("value")) if logged else F.col("value")
    seen = df.select(donor, *keys, x.alias("value"))
    means = seen.groupBy(*keys).agg(F.avg("value").alias("mean"))
    every = grid(seen.select(donor).distinct(), df.select(*keys).distinct())
    joined = every.join(seen, [donor, *keys], "left").join(means, keys)
    return joined.select(donor, *keys, F.coalesce("value", "mean").alias("value"),
                         F.col("value").isNotNull().alias("observed"))


def key_index(tables: Sequence[DataFrame], keys: Sequence[str], *, parts: int | None = None) -> DataFrame:
    """Distinct keys over several tables; ``parts``: in how many parts they are compared, Spark's choice if None."""
    out = tables[0].select(*keys)
    for t in tables[1:]:
        out = out.unionByName(t.select(*keys))
    return dealt(out, keys, parts).distinct()


def wide_by(df: DataFrame, index: Sequence[str], column: str, names: Sequence, value: str = "value", *,
            drop_empty: bool = False) -> DataFrame:
    """One column per entry of ``names``; duplicates are averaged."""
    source = df.filter(F.col(value).isNotNull()) if drop_empty else df
    return source.groupBy(*index).pivot(column, list(names)).agg(F.avg(value))


def chromosome_rows(df: DataFrame, chromosomes: Sequence[str], *, value: str = "value") -> DataFrame:
    """One row per (cell type, chromosome, gene) with 0 off the gene's own chromosome."""
    listed = F.explode(F.array(*[F.lit(c) for c in chromosomes])).alias("row_chrom")
    return df.select("*", listed).withColumn(
        value, F.when(F.col("row_chrom") == X.chrom_key(F.col("chrom")), F.col(value)).otherwise(0.0))

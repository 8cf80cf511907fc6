"""Multiple-testing correction, pooling of draws and the summaries built on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import exprs as X
from ..functions.distributions import norm_isf, two_sided_p
from ..functions.ordered import medians, quantiles, running, value_counts
from ..functions.storage import reusable, settled

# Family-wise level, median of chi-square(1), agreement cut points and bins.
FAMILY_WISE = 0.05
CHI2_MEDIAN = 0.4549364231195728
AGREEMENT_CUTS = (0.0, 0.2, 0.4, 0.5, 0.6, 0.8, 0.9, 1.0)
AGREEMENT_EDGES = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)


def bh_table(df: DataFrame, keys: Sequence[str], p: str, *, limit: int | None = None) -> DataFrame:
    """(keys, p, qvalue, n_valid), one row per distinct p.

    Tied p-values share one q: the step-up minimum always comes from the last of them.
    """
    counted = value_counts(df, keys, p, limit=limit)
    raw = counted.withColumn("raw", F.col(p) * F.col("n_valid") / F.col("n_upto"))
    stepped = running(raw, keys, [p], suffix_mins={"qvalue": F.col("raw")}, limit=limit)
    return stepped.select(*keys, p, F.least("qvalue", F.lit(1.0)).alias("qvalue"), "n_valid")


def annotate_significance(df: DataFrame, keys: Sequence[str], *, fdr: float = 0.05,
                          p: str = "pvalue", suffix: str = "", limit: int | None = None) -> DataFrame:
    """Benjamini-Hochberg q, strict FDR flag, Bonferroni threshold and strict flag per group.

    Null p-values are untested: null q, false flags. The Bonferroni numerator
    is 0.05 whatever ``fdr`` is.
    """
    keys = list(keys)
    df, fits = settled(df, limit)
    if fits:
        group = W.partitionBy(*keys)
        n = F.count(p).over(group)
        upto = F.count(p).over(group.orderBy(F.col(p).asc_nulls_last()))
        ranked = df.select("*", n.alias("__n"), (F.col(p) * n / upto).alias("__raw"))
        q = F.min("__raw").over(group.orderBy(F.col(p).desc_nulls_first()))
        out = ranked.withColumn(f"qvalue{suffix}",
                                F.when(F.col(p).isNotNull(), F.least(q, F.lit(1.0)))).drop("__raw")
    else:
        table = bh_table(df, keys, p, limit=limit).select(
            *[F.col(k).alias(f"q_{k}") for k in keys], F.col(p).alias("q_p"),
            F.col("qvalue").alias(f"qvalue{suffix}"))
        sizes = df.groupBy(*keys).agg(F.count(p).alias("__n")).select(
            *[F.col(k).alias(f"n_{k}") for k in keys], "__n")
        on_q, on_n = F.col(p) == F.col("q_p"), F.lit(True)
        for k in keys:
            on_q = on_q & F.col(k).eqNullSafe(F.col(f"q_{k}"))
            on_n = on_n & F.col(k).eqNullSafe(F.col(f"n_{k}"))
        out = df.join(table, on_q, "left").join(sizes, on_n, "left").select(
            *df.columns, f"qvalue{suffix}", "__n")
    threshold = F.try_divide(F.lit(FAMILY_WISE), F.col("__n"))
    return out.select(
        *df.columns, f"qvalue{suffix}",
        F.coalesce(F.col(f"qvalue{suffix}") < fdr, F.lit(False)).alias(f"significant_fdr{suffix}"),
        threshold.alias(f"bonferroni_threshold{suffix}"),
        F.coalesce(F.col(p) < threshold, F.lit(False)).alias(f"significant_bonferroni{suffix}"))


def _spread(source: str, prefix: str) -> list[Column]:
    return [F.avg(source).alias(f"{prefix}_mean"), F.var_samp(source).alias(f"{prefix}_var"),
            F.min(source).alias(f"{prefix}_min"), F.max(source).alias(f"{prefix}_max")]


def pool_draws(draws: DataFrame, keys: Sequence[str], *, fdr: float = 0.05,
               limit: int | None = None) -> DataFrame:
    """One row per (keys, gene) over all draws.

    Each draw is corrected against its own genes first; the pooled p is the
    equal-weight ACAT of the draws, the expectation track is the tail of E[z].
    Spread columns other than min and max stay only where either track is an FDR hit.
    """
    keys = list(keys)
    has = set(draws.columns)
    flagged = annotate_significance(draws, [*keys, "draw"], fdr=fdr, limit=limit)
    prefixes = {"zscore": "zscore", "pvalue": "pvalue_expectation"}
    if "effect_size" in has:
        prefixes["effect_size"] = "effect_size"
    aggs = [c for source, prefix in prefixes.items() for c in _spread(source, prefix)]
    aggs += [F.count("zscore").alias("n_draws"), X.acat(F.col("pvalue")).alias("pvalue")]
    aggs += [F.count_if(f"significant_{c}").alias(f"n_draws_significant_{c}") for c in ("bonferroni", "fdr")]
    if "n_snps_used" in has:
        aggs.append(F.avg("n_snps_used").alias("mean_n_snps_used"))
    if "n_snps_in_model" in has:
        aggs.append(F.avg("n_snps_in_model").alias("n_snps_in_model"))
    if "best_gwas_p" in has:
        aggs.append(F.min("best_gwas_p").alias("best_gwas_p"))
    if "gene_name" in has:
        aggs.append(F.min_by("gene_name", F.when(F.col("gene_name").isNotNull(), F.col("draw"))).alias("gene_name"))
    pooled = flagged.groupBy(*keys, "gene").agg(*aggs)

    for prefix in prefixes.values():
        var = F.when(F.col("n_draws") >= 2, F.col(f"{prefix}_var"))
        sd, mean = F.sqrt(var), F.col(f"{prefix}_mean")
        low, high = mean - X.Z95 * sd, mean + X.Z95 * sd
        if prefix == "pvalue_expectation":
            low, high = (F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))
                         for c in (low, high))
        pooled = pooled.withColumns({f"{prefix}_sd": sd, f"{prefix}_ci_low": low,
                                     f"{prefix}_ci_high": high, f"{prefix}_var": var})
    pooled = pooled.withColumns({
        "zscore": F.col("zscore_mean"),
        "pvalue_expectation": two_sided_p(F.col("zscore_mean")),
        **({"effect_size": F.col("effect_size_mean")} if "effect_size" in has else {}),
        **{f"agreement_{c}": F.try_divide(f"n_draws_significant_{c}", "n_draws")
           for c in ("bonferroni", "fdr")}})
    pooled = annotate_significance(pooled, keys, fdr=fdr, limit=limit)
    pooled = annotate_significance(pooled, keys, fdr=fdr, p="pvalue_expectation",
                                   suffix="_expectation", limit=limit)
    hit = F.col("significant_fdr") | F.col("significant_fdr_expectation")
    masked = {f"{p}_{s}": F.when(hit, F.col(f"{p}_{s}"))
              for p in prefixes.values() for s in ("mean", "var", "sd", "ci_low", "ci_high")}
    return pooled.withColumns(masked)


def inflation(df: DataFrame, keys: Sequence[str], p: str = "pvalue", *, out: str = "lambda_gc",
              limit: int | None = None) -> DataFrame:
    """Genomic inflation: median chi-square over its null median, on p > 0."""
    half = norm_isf(F.col(p) / 2.0)
    chi = df.filter(F.col(p) > 0).select(*keys, (half * half).alias("__chi"))
    return quantiles(chi, keys, "__chi", {out: 0.5}, limit=limit).withColumn(
        out, F.col(out) / CHI2_MEDIAN)


def result_summary(results: DataFrame, keys: Sequence[str], *, limit: int | None = None) -> DataFrame:
    """Long (keys, metric, value) scalars of a corrected table, both tracks where present."""
    keys, has = list(keys), set(results.columns)
    results = reusable(results)
    used = "n_snps_used" if "n_snps_used" in has else "mean_n_snps_used"
    aggs = [F.count(F.lit(1)).alias("n_genes"), F.count("pvalue").alias("n_genes_tested"),
            F.count_if("significant_fdr").alias("n_significant_fdr"),
            F.count_if("significant_bonferroni").alias("n_significant_bonferroni"),
            F.min("pvalue").alias("min_pvalue"), F.max(F.abs("zscore")).alias("max_abs_zscore")]
    if used in has:
        aggs.append(F.avg(used).alias("mean_n_snps_used"))
        if "n_snps_in_model" in has:
            aggs += [F.avg("n_snps_in_model").alias("mean_n_snps_in_model"),
                     F.try_divide(F.avg(used), F.avg("n_snps_in_model")).alias("frac_model_snps_used")]
    for prefix in ("zscore", "effect_size"):
        if f"{prefix}_sd" in has:
            aggs += [F.avg(f"{prefix}_sd").alias(f"mean_{prefix}_sd_significant"),
                     F.max(f"{prefix}_sd").alias(f"max_{prefix}_sd_significant")]
    both = "pvalue_expectation" in has
    if both:
        aggs += [F.count_if("significant_fdr_expectation").alias("expectation/n_significant_fdr"),
                 F.count_if("significant_bonferroni_expectation").alias("expectation/n_significant_bonferroni"),
                 F.min("pvalue_expectation").alias("expectation/min_pvalue")]
    wide = results.groupBy(*keys).agg(*aggs)
    wide = wide.join(inflation(results, keys, limit=limit), keys, "left") if keys else wide.crossJoin(
        F.broadcast(inflation(results, keys, limit=limit)))
    if both and keys:
        wide = wide.join(inflation(results, keys, "pvalue_expectation", out="expectation/lambda_gc",
                                   limit=limit), keys, "left")
    names = [c for c in wide.columns if c not in keys]
    return (wide.select(*keys, *[F.col(f"`{c}`").cast("double").alias(c) for c in names])
            .unpivot(keys, [F.col(f"`{c}`") for c in names], "metric", "value"))


def agreement_strata(pooled: DataFrame, keys: Sequence[str], *, criterion: str = "bonferroni",
                     edges: Sequence[float] = AGREEMENT_EDGES, limit: int | None = None) -> DataFrame:
    """Describe genes by left-open agreement bins; zero is its own row, empty bins stay."""
    keys, a = list(keys), F.col(f"agreement_{criterion}")
    pooled = reusable(pooled)
    labels = ["0%"] + [f"({lo:.0%}, {hi:.0%}]" for lo, hi in zip(edges[:-1], edges[1:])]
    bin_no = F.lit(0)
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:]), start=1):
        bin_no = F.when((a > lo) & (a <= hi), i).otherwise(bin_no)
    data = pooled.filter(a.isNotNull()).select(
        "*", bin_no.alias("bin_no"), F.abs("zscore").alias("abs_zscore"),
        F.try_divide(F.abs("zscore"), F.col("zscore_sd")).alias("stability"))
    described = ["abs_zscore", "zscore_sd", "stability", "best_gwas_p", "mean_n_snps_used"]
    described = [c for c in described if c in data.columns]
    group = [*keys, "bin_no"]
    plain = data.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_genes"), F.count_if(F.col("block_index") >= 0).alias("n_assigned"),
        F.avg(F.col("significant_bonferroni").cast("double")).alias("frac_significant_pooled"),
        *[F.avg(c).alias(f"{c}_mean") for c in described])
    blocks = (data.filter("block_index >= 0").groupBy(*group, "block_index").agg(F.lit(1).alias("one"))
              .groupBy(*group).agg(F.count("one").alias("n_ld_blocks")))
    mids = medians(data, group, {f"{c}_median": c for c in described} |
                   {"n_draws_significant_median": f"n_draws_significant_{criterion}"}, limit=limit)
    bins = F.posexplode(F.array(*[F.lit(v) for v in labels])).alias("bin_no", "agreement_bin")
    grid = pooled.select(*keys).distinct().select(*keys, bins)
    joined = grid.join(plain, group, "left").join(blocks, group, "left").join(mids, group, "left")
    n_blocks = F.coalesce("n_ld_blocks", F.lit(0))
    return joined.select(
        *keys, "bin_no", "agreement_bin", F.coalesce("n_genes", F.lit(0)).alias("n_genes"),
        "n_draws_significant_median", n_blocks.alias("n_ld_blocks"),
        F.try_divide("n_assigned", F.nullif(n_blocks, F.lit(0))).alias("genes_per_ld_block"),
        *[f"{c}_{s}" for c in described for s in ("median", "mean")], "frac_significant_pooled")


def agreement_summary(pooled: DataFrame, keys: Sequence[str], *, criterion: str = "bonferroni",
                      limit: int | None = None) -> DataFrame:
    a = F.col(f"agreement_{criterion}")
    ever = pooled.filter(a > 0).select(*keys, a.alias("a"))
    counts = pooled.groupBy(*keys).agg(
        F.count_if(a > 0).alias("n_genes_significant_in_any_draw"),
        F.count_if(a >= 1).alias("n_genes_significant_in_all_draws"),
        F.count_if(a >= 0.8).alias("n_genes_agreement_at_least_80pct"),
        F.count_if(a >= 0.5).alias("n_genes_agreement_at_least_50pct"),
        F.avg(F.when(a > 0, a)).alias("mean_agreement_among_ever_significant"))
    mid = quantiles(ever, keys, "a", {"median_agreement_among_ever_significant": 0.5}, limit=limit)
    return counts.join(mid, list(keys), "left")


def draw_spread(draws: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per draw: size, mean, SD and RMSE to the across-draw gene mean.

    The gene mean is a combined aggregate joined back, so a gene with very many
    draws is never gathered in one window.
    """
    keys = list(keys)
    means = draws.groupBy(*keys, "gene").agg(F.avg("zscore").alias("gene_mean"))
    residual = F.col("zscore") - F.col("gene_mean")
    return draws.join(means, [*keys, "gene"]).groupBy(*keys, "draw").agg(
        F.count("gene").alias("n_genes"), F.avg("zscore").alias("mean_zscore"),
        F.stddev_samp("zscore").alias("sd_zscore"),
        F.sqrt(F.avg(residual * residual)).alias("rmse_vs_mean"))


def combine_tables(results: DataFrame, keys: Sequence[str], *, acat_columns=("pvalue", "pvalue_expectation"),
                   mean_columns: Sequence[str] = (), label_columns: Sequence[str] = (),
                   order: str = "cell_type") -> DataFrame:
    """One row per (keys, gene) over cell types: ACAT p, mean numbers, first non-empty labels."""
    aggs = []
    for c in label_columns:
        text = F.trim(F.col(c).cast("string"))
        filled = (text != "") & ~F.lower(text).isin("nan", "none")
        aggs.append(F.min_by(F.when(filled, text), F.when(filled, F.col(order))).alias(c))
    aggs += [X.acat(F.col(c)).alias(c) for c in acat_columns if c in results.columns]
    aggs.append(F.count("pvalue").alias("n_cell_types"))
    aggs += [F.avg(c).alias(c) for c in mean_columns]
    return results.groupBy(*keys, "gene").agg(*aggs)


def collapse_groups(results: DataFrame, mapping: DataFrame, *, alpha: float = 0.05,
                    criterion: str = "fdr", limit: int | None = None) -> DataFrame:
    """Calls per ontology group without an agreement rule.

    ``mapping(cell_type, group_name, n_expected)``; a group defined with one
    member reuses that member's call, others are ACAT-combined and re-called.
    """
    tagged = results.join(mapping, "cell_type")
    combined = tagged.groupBy("group_name", "gene").agg(
        X.acat(F.col("pvalue")).alias("pvalue"),
        F.bool_or(f"significant_{criterion}").alias("kept_call"),
        F.max("n_expected").alias("n_expected"))
    called = annotate_significance(combined, ["group_name"], fdr=alpha, limit=limit)
    strict = (F.col("significant_fdr") if criterion == "fdr" else
              F.col("pvalue") < F.col("bonferroni_threshold") * F.lit(alpha / FAMILY_WISE))
    return called.select("group_name", "gene", "pvalue",
                         F.when(F.col("n_expected") == 1, F.col("kept_call"))
                         .otherwise(F.coalesce(strict, F.lit(False))).alias("hit"))


def collapse_groups_by_draw(draws: DataFrame, mapping: DataFrame, *, min_agreement: float,
                            alpha: float = 0.05, criterion: str = "fdr",
                            limit: int | None = None) -> DataFrame:
    """Group agreement: ACAT inside each draw, call per draw, then the share of calling draws.

    ``min_agreement`` is a percentage; 0 means "in at least one draw".
    """
    combined = (draws.join(mapping, "cell_type").groupBy("group_name", "draw", "gene")
                .agg(X.acat(F.col("pvalue")).alias("pvalue")).filter("pvalue is not null"))
    called = annotate_significance(combined, ["group_name", "draw"], fdr=alpha, limit=limit)
    flag = (F.col("significant_fdr") if criterion == "fdr" else
            F.col("pvalue") < F.col("bonferroni_threshold") * F.lit(alpha / FAMILY_WISE))
    share = called.groupBy("group_name", "gene").agg(F.avg(flag.cast("double")).alias("agreement"))
    a = F.col("agreement")
    return share.withColumn("hit", a > 0 if min_agreement == 0 else a * 100 >= min_agreement)

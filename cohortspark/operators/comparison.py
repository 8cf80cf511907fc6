"""Comparing arms, gene sets and reference lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import exprs as X
from ..functions.ordered import first_by, top_k
from ..functions.storage import reusable, grid
from .pooling import inflation

# Track suffixes of a corrected table and the two criteria.
CRITERIA = ("fdr", "bonferroni")
TRACKS = {"": "", "_expectation": "expectation/"}


def rate(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator, F.nullif(denominator, F.lit(0)))


# ---- hits and scopes -----------------------------------------------------------------------

def hit_flag(columns: Sequence[str], *, criterion: str = "fdr", suffix: str = "",
             min_agreement: float | None = None) -> Column:
    """Significance flag, or agreement in percent where 0 means "more than none"."""
    if criterion not in CRITERIA:
        raise ValueError(f"unknown criterion {criterion!r}")
    if min_agreement is None:
        name = f"significant_{criterion}{suffix}"
        if name not in columns:
            raise ValueError(f"table lacks {name}")
        return X.parse_bool(F.col(name))
    if not 0 <= min_agreement <= 100:
        raise ValueError("min_agreement must be a percentage")
    a = F.col(f"agreement_{criterion}").cast("double")
    checked = F.when((a < 0) | (a > 1), F.raise_error(F.lit("agreement outside [0, 1]")).cast("double")).otherwise(a)
    return F.coalesce(checked > 0 if min_agreement == 0 else checked >= min_agreement / 100.0, F.lit(False))


def in_scope(df: DataFrame, region_genes: DataFrame, scope: str, *, gene: str = "gene") -> DataFrame:
    """``all``, ``inside`` or ``outside`` a region given by its genes."""
    listed = region_genes.select(gene).distinct()
    if scope == "all":
        return df
    if scope not in ("inside", "outside"):
        raise ValueError(f"unknown scope {scope!r}")
    return df.join(listed, gene, "left_semi" if scope == "inside" else "left_anti")


# ---- two arms ------------------------------------------------------------------------------

def match_arms(left: DataFrame, right: DataFrame, keys: Sequence[str] = (), *,
               suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Inner join on the folded gene key, first row per gene on each side, values suffixed."""
    keys = list(keys)

    def side(df: DataFrame, suffix: str) -> DataFrame:
        keyed = df.withColumn("gene_key", X.gene_key(F.col("gene").cast("string"))).filter("gene_key is not null")
        one = first_by(keyed, [*keys, "gene_key"], [F.col("gene")])
        return one.select(*keys, "gene_key", *[F.col(c).alias(c + suffix) for c in df.columns if c not in keys])

    return side(left, suffixes[0]).join(side(right, suffixes[1]), [*keys, "gene_key"])


def arm_overlap(matched: DataFrame, keys: Sequence[str] = (), *,
                suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Hit overlap per criterion and track, correlations and mean |z|, as long metric rows."""
    a, b = suffixes
    has, aggs = set(matched.columns), [F.count(F.lit(1)).cast("double").alias("n_genes_shared")]
    for track, prefix in TRACKS.items():
        for c in CRITERIA:
            left, right = f"significant_{c}{track}{a}", f"significant_{c}{track}{b}"
            if left not in has or right not in has:
                continue
            x, y = F.coalesce(F.col(left), F.lit(False)), F.coalesce(F.col(right), F.lit(False))
            aggs += [F.count_if(x & y).cast("double").alias(f"{prefix}{c}_both"),
                     F.count_if(x & ~y).cast("double").alias(f"{prefix}{c}{a}_only"),
                     F.count_if(~x & y).cast("double").alias(f"{prefix}{c}{b}_only"),
                     rate(F.count_if(x & y), F.count_if(x | y)).alias(f"{prefix}{c}_jaccard")]
    if f"zscore{a}" in has:
        aggs += [F.avg(F.abs(f"zscore{s}")).alias(f"mean_abs_zscore{s}") for s in suffixes]
    for v, name in (("zscore", "zscore_correlation"), ("pvalue", "pvalue_correlation"),
                    ("pvalue_expectation", "expectation/pvalue_correlation")):
        if f"{v}{a}" in has and f"{v}{b}" in has:
            x, y = F.col(f"{v}{a}"), F.col(f"{v}{b}")
            aggs.append(F.when(X.complete_count(x, y) > 2, X.safe_corr(x, y)).alias(name))
    wide = matched.groupBy(*keys).agg(*aggs)
    names = [c for c in wide.columns if c not in keys]
    return wide.unpivot(list(keys), [F.col(f"`{n}`") for n in names], "metric", "value")


def call_status(matched: DataFrame, keys: Sequence[str] = (), *, criterion: str = "bonferroni",
                suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Genes called by neither, both, or one of the arms."""
    x, y = (F.coalesce(F.col(f"significant_{criterion}{s}"), F.lit(False)) for s in suffixes)
    status = F.when(x & y, "both").when(x, "only" + suffixes[0]).when(y, "only" + suffixes[1]).otherwise("neither")
    return matched.groupBy(*keys, status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def largest_disagreements(matched: DataFrame, keys: Sequence[str], k: int, *, criterion: str = "bonferroni",
                          suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Genes with the largest gap in -log10 p among those at least one arm calls."""
    a, b = suffixes
    called = F.col(f"significant_{criterion}{a}") | F.col(f"significant_{criterion}{b}")
    gap = F.abs(X.neglog10(F.col(f"pvalue{b}")) - X.neglog10(F.col(f"pvalue{a}")))
    rows = matched.filter(called).select(*keys, "gene_key", gap.alias("gap"))
    return top_k(rows, keys, [F.col("gap").desc_nulls_last(), F.col("gene_key")], k)


def gene_attrition(models: DataFrame, results: DataFrame) -> DataFrame:
    """Where genes are lost between models and results; both tables hold (arm, gene) with arms a and b."""
    def flags(df, what):
        key = X.gene_key(F.col("gene").cast("string"))
        return df.select(key.alias("key"), *[
            (F.col("arm") == arm).alias(f"{what}_{arm}") for arm in ("a", "b")], *[
            F.lit(False).alias(f"{other}_{arm}") for other in {"model", "result"} - {what} for arm in ("a", "b")])

    names = [f"{w}_{arm}" for w in ("model", "result") for arm in ("a", "b")]
    per = (flags(models, "model").unionByName(flags(results, "result")).filter("key is not null")
           .groupBy("key").agg(*[F.bool_or(n).alias(n) for n in names]))
    ma, mb, ra, rb = (F.col(n) for n in names)
    shared, reaching = F.count_if(ma & mb), F.count_if(ra & rb)
    return per.agg(F.count_if(ma).alias("n_model_a"), F.count_if(mb).alias("n_model_b"), shared.alias("n_shared_models"),
                   F.count_if(ra).alias("n_result_a"), F.count_if(rb).alias("n_result_b"), reaching.alias("n_shared_results"),
                   F.count_if(ma & ~ra).alias("n_lost_a"), F.count_if(mb & ~rb).alias("n_lost_b"),
                   rate(reaching, shared).alias("frac_reaching_both"))


def restrict_to_list(df: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows on a gene list, and one row of counts; a listed gene without a model is only counted."""
    key = X.gene_key(F.col("gene").cast("string"))
    keyed = df.withColumn("__key", key)
    wanted = listed.select(key.alias("__key")).filter("__key is not null").distinct()
    kept = keyed.join(wanted, "__key", "left_semi").drop("__key")
    sides = keyed.select("__key").distinct().withColumn("m", F.lit(True)).join(
        wanted.withColumn("l", F.lit(True)), "__key", "full_outer")
    m, lst = F.col("m").isNotNull(), F.col("l").isNotNull()
    return kept, sides.agg(F.count_if(m).alias("n_in_model"), F.count_if(lst).alias("n_on_list"),
                           F.count_if(m & lst).alias("n_kept"), F.count_if(lst & ~m).alias("n_missing"),
                           F.count_if(m & ~lst).alias("n_off_list"))


def pair_labels(left: DataFrame, right: DataFrame, *, name: str = "cell_type") -> DataFrame:
    """Left rows with the right label of the same folded name; null marks the unmatched."""
    l = left.select(F.col(name).alias("left_name"), X.label_key(F.col(name)).alias("__k"))
    r = right.select(F.col(name).alias("right_name"), X.label_key(F.col(name)).alias("__k"))
    return l.join(r, "__k", "left").select("left_name", "right_name")


def shared_genes(left: DataFrame, right: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Genes of both sides on the versionless id, in the left spelling, with a symbol or ''."""
    def side(df, out):
        return df.select(X.gene_key(F.col("gene")).alias("__k"), F.col("gene").alias(out)).filter(
            "__k is not null").groupBy("__k").agg(F.min(out).alias(out))

    both = side(left, "gene").join(side(right, "__other"), "__k").select("__k", "gene")
    if names is None:
        return both.select("gene", F.lit("").alias("symbol"))
    symbols = names.select(X.gene_key(F.col("gene")).alias("__k"), F.col("symbol").alias("__s")).groupBy("__k").agg(
        F.min("__s").alias("__s"))
    return both.join(symbols, "__k", "left").select("gene", F.coalesce("__s", F.lit("")).alias("symbol"))


def set_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Union, intersection and difference sizes of two key sets."""
    a = left.select(key).distinct().withColumn("a", F.lit(True))
    b = right.select(key).distinct().withColumn("b", F.lit(True))
    x, y = F.col("a").isNotNull(), F.col("b").isNotNull()
    return a.join(b, key, "full_outer").agg(
        F.count(F.lit(1)).alias("n_union"), F.count_if(x & y).alias("n_both"),
        F.count_if(x & ~y).alias("n_left_only"), F.count_if(~x & y).alias("n_right_only"))


# ---- exact set intersections ---------------------------------------------------------------

def memberships(hits: DataFrame, *, gene: str = "gene", group: str = "cell_type") -> DataFrame:
    """Each gene with the sorted list of groups holding it (as many entries as groups)."""
    return hits.groupBy(gene).agg(F.array_sort(F.collect_set(group)).alias("members"))


def exact_intersections(hits: DataFrame, *, gene: str = "gene", group: str = "cell_type", min_size: int = 1,
                        max_rows: int = 0, order: str = "degree") -> DataFrame:
    """Counts of genes by exact membership, all of them unless ``max_rows`` asks for the largest only."""
    sized = (memberships(hits, gene=gene, group=group).groupBy("members").agg(F.count(F.lit(1)).alias("size"))
             .filter(F.col("size") >= min_size).withColumn("degree", F.size("members")))
    if max_rows:
        sized = sized.orderBy(F.col("size").desc(), "degree", "members").limit(max_rows)
    if order == "degree":
        return sized.orderBy("degree", "members")
    if order == "size":
        return sized.orderBy(F.col("size").desc(), "degree", "members")
    raise ValueError(f"unknown order {order!r}")


def sharing_summary(hits: DataFrame, *, gene: str = "gene", group: str = "cell_type") -> DataFrame:
    per = memberships(hits, gene=gene, group=group).select(F.size("members").alias("degree"))
    n_groups = hits.select(F.count_distinct(group)).scalar()
    n = F.count(F.lit(1))
    parts = {"shared_all": F.count_if(F.col("degree") == n_groups),
             "shared_at_least_two": F.count_if(F.col("degree") >= 2), "single": F.count_if(F.col("degree") == 1)}
    return per.agg(n.alias("n_hits"), *[c.alias(f"n_{k}") for k, c in parts.items()],
                   *[F.coalesce(rate(100.0 * c, n), F.lit(0.0)).alias(f"pct_{k}") for k, c in parts.items()])


def single_set_genes(hits: DataFrame, details: DataFrame, *, gene: str = "gene", group: str = "cell_type") -> DataFrame:
    """Genes in exactly one set, with the details of that set's row."""
    alone = memberships(hits, gene=gene, group=group).filter(F.size("members") == 1).select(
        gene, F.col("members")[0].alias(group))
    return alone.join(details, [group, gene], "left")


# ---- reference lists -----------------------------------------------------------------------

def to_reference(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Rows with the reference gene they mean, by id or by symbol.

    A union of two equality joins; a join on "id or symbol" would compare every pair.
    """
    by_id = df.join(reference.select(F.col("gene").alias("ref_gene")), F.col("gene") == F.col("ref_gene"))
    names = reference.filter(F.trim("symbol") != "").select(F.upper("symbol").alias("__s"), F.col("gene").alias("ref_gene"))
    by_name = df.filter(F.trim("symbol") != "").join(
        names.distinct(), F.upper("symbol") == F.col("__s")).drop("__s")
    return by_id.unionByName(by_name).distinct()


def _scores(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    precision, recall = rate(F.col("n_recovered"), F.col("n_hits")), rate(F.col("n_recovered"), F.col("n_reference"))
    tested = rate(F.col("n_recovered"), F.col("n_tested"))
    out = counts.select("*", precision.alias("precision"), recall.alias("recall"), tested.alias("recall_tested"))
    total = F.col("precision") + F.col("recall_tested")
    return out.withColumn("f1", F.try_divide(2.0 * F.col("precision") * F.col("recall_tested"), F.nullif(total, F.lit(0.0))))


def gene_recovery(results: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reference genes tested, recovered and missed, extra hits, precision, recall and F1.

    ``results(keys, gene, symbol, hit)``; recall counts every reference gene,
    ``recall_tested`` only those tested, and F1 uses the latter.
    """
    keys = list(keys)
    results = reusable(results)
    matched = to_reference(results.select(*keys, "gene", "symbol", "hit"), reference).groupBy(*keys, "ref_gene").agg(
        F.bool_or("hit").alias("recovered"))
    found = matched.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_tested"), F.count_if("recovered").alias("n_recovered"))
    known = results.join(reference.select("gene", F.lit(True).alias("known")), "gene", "left")
    totals = known.groupBy(*keys).agg(F.count_if("hit").alias("n_hits"),
                                      F.count_if(F.col("hit") & F.col("known").isNull()).alias("n_extra"))
    n_ref = reference.select(F.count_distinct("gene")).scalar()
    counts = totals.join(found, keys, "left").select(
        *keys, n_ref.alias("n_reference"), F.coalesce("n_tested", F.lit(0)).alias("n_tested"), "n_hits",
        F.coalesce("n_recovered", F.lit(0)).alias("n_recovered"),
        (F.coalesce("n_tested", F.lit(0)) - F.coalesce("n_recovered", F.lit(0))).alias("n_missed"), "n_extra")
    return _scores(counts, keys)


def block_recovery(results: DataFrame, reference: DataFrame, reference_blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As for genes, over blocks: a reference block is recovered only through a reference gene in it."""
    keys = list(keys)
    results = reusable(results)
    owned = reference_blocks.select(F.col("gene").alias("ref_gene"), "block_index").distinct()
    matched = to_reference(results.select(*keys, "gene", "symbol", "hit"), reference)
    blocks = matched.join(owned, "ref_gene").groupBy(*keys, "block_index").agg(F.bool_or("hit").alias("recovered"))
    found = blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_tested"), F.count_if("recovered").alias("n_recovered"))
    listed = owned.select("block_index", F.lit(True).alias("known")).distinct()
    hit_blocks = results.filter("hit and block_index >= 0").select(*keys, "block_index").distinct().join(listed, "block_index", "left")
    totals = hit_blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_hits"), F.count_if(F.col("known").isNull()).alias("n_extra"))
    n_ref = reference_blocks.select(F.count_distinct("block_index")).scalar()
    every = results.select(*keys).distinct()
    zero = F.lit(0)
    counts = every.join(totals, keys, "left").join(found, keys, "left").select(
        *keys, n_ref.alias("n_reference"), F.coalesce("n_tested", zero).alias("n_tested"),
        F.coalesce("n_hits", zero).alias("n_hits"), F.coalesce("n_recovered", zero).alias("n_recovered"),
        (F.coalesce("n_tested", zero) - F.coalesce("n_recovered", zero)).alias("n_missed"),
        F.coalesce("n_extra", zero).alias("n_extra"))
    return _scores(counts, keys)


def average_recovery(scores: DataFrame, keys: Sequence[str], *, over: str = "cell_type") -> DataFrame:
    """Mean of every score over cell types, skipping undefined ones."""
    fields = [c for c in scores.columns if c not in (*keys, over)]
    return scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cell_types"), *[F.avg(c).alias(c) for c in fields])


def shared_universe(results: DataFrame, keys: Sequence[str], *, arm: str = "arm") -> DataFrame:
    """Rows of genes that every arm tested."""
    keys = list(keys)
    n_arms = results.select(F.count_distinct(arm)).scalar()
    everywhere = results.groupBy(*keys, "gene").agg(F.count_distinct(arm).alias("__n")).filter(F.col("__n") == n_arms)
    return results.join(everywhere.drop("__n"), [*keys, "gene"], "left_semi")


def stratified_inflation(results: DataFrame, reference: DataFrame, keys: Sequence[str], *,
                         limit: int | None = None) -> DataFrame:
    """N and inflation for reference genes (by id or symbol) and for all others."""
    keys = list(keys)
    known = to_reference(results.select("gene", "symbol").distinct(), reference).select("gene").distinct()
    tagged = results.join(known.withColumn("known", F.lit(True)), "gene", "left").withColumn(
        "stratum", F.when(F.col("known"), "reference").otherwise("other")).filter("pvalue is not null")
    group = [*keys, "stratum"]
    sizes = tagged.groupBy(*group).agg(F.count("pvalue").alias("n"))
    return sizes.join(inflation(tagged, group, limit=limit), group, "left")


# ---- direction of effect -------------------------------------------------------------------

def effect_signs(draws: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of positive, negative and zero model effects per gene."""
    e = F.col("effect_size")
    return draws.groupBy(*keys, "gene").agg(
        F.count_if(e > 0).alias("n_positive"), F.count_if(e < 0).alias("n_negative"), F.count_if(e == 0).alias("n_zero"),
        F.count(F.lit(1)).alias("n_models"))


def direction_table(reference: DataFrame, results: DataFrame, signs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per (keys, reference gene) with its status.

    ``reference(gene, sign)`` unique; ``results(keys, gene, hit, effect_size)``.
    Order of checks: tested, significant, mixed model signs, unavailable signs, zero, agreement.
    """
    keys = list(keys)
    unique = reference.groupBy("gene").agg(F.count(F.lit(1)).alias("c"), F.min("sign").alias("s")).select(
        "gene", F.when(F.col("c") > 1, F.raise_error(F.lit("reference gene listed twice")).cast("int"))
        .when(F.col("s").isin(-1, 1), F.col("s")).otherwise(F.raise_error(F.lit("sign must be -1 or 1")).cast("int")).alias("sign"))
    base = grid(unique, results.select(*keys).distinct())
    joined = base.join(results.select(*keys, "gene", "hit", "effect_size"), [*keys, "gene"], "left").join(
        signs, [*keys, "gene"], "left")
    observed = F.col("n_positive") + F.col("n_negative") + F.col("n_zero")
    missing = F.col("n_models").isNull() | ((F.col("n_models") > 1) & (observed < F.col("n_models")))
    e = F.col("effect_size")
    status = (F.when(F.col("hit").isNull(), "not_tested").when(~F.col("hit"), "not_significant")
              .when((F.col("n_positive") > 0) & (F.col("n_negative") > 0), "mixed_models")
              .when(missing, "models_unavailable").when(e.isNull() | (e == 0), "missing_or_zero")
              .when(F.signum(e) == F.col("sign"), "concordant").otherwise("discordant"))
    return joined.select(*keys, "gene", F.col("sign"), F.col("hit").isNotNull().alias("tested"),
                         F.coalesce("hit", F.lit(False)).alias("significant"),
                         F.signum(e).cast("int").alias("effect_sign"), status.alias("status"))


def direction_bulk(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Equal vote of significant cell types per reference gene."""
    s, e, st = F.col("significant"), F.col("effect_sign"), F.col("status")
    votes = table.groupBy(*keys, "gene", "sign").agg(
        F.count_if("tested").alias("n_tested"), F.count_if(s).alias("n_significant"),
        F.count_if(s & (e == 1)).alias("n_positive"), F.count_if(s & (e == -1)).alias("n_negative"),
        F.count_if(st == "mixed_models").alias("n_mixed"), F.count_if(st == "models_unavailable").alias("n_unavailable"))
    pos, neg = F.col("n_positive"), F.col("n_negative")
    vote = F.when(pos > 0, 1).otherwise(-1)
    status = (F.when(F.col("n_significant") == 0, "no_hit").when(F.col("n_mixed") > 0, "mixed_models")
              .when(F.col("n_unavailable") > 0, "models_unavailable").when((pos > 0) & (neg > 0), "mixed_cell_types")
              .when(F.col("n_significant") > pos + neg, "missing_or_zero")
              .when(vote == F.col("sign"), "concordant").otherwise("discordant"))
    return votes.withColumn("status", status)


def direction_metrics(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    st = F.col("status")
    named = ("concordant", "discordant", "mixed_models", "mixed_cell_types", "missing_or_zero", "models_unavailable")
    sure = F.count_if(st.isin("concordant", "discordant"))
    return table.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_reference_genes"),
        F.count_if(~st.isin("no_hit", "not_tested", "not_significant")).alias("n_significant"),
        *[F.count_if(st == n).alias(f"n_{n}") for n in named],
        rate(F.count_if(st == "concordant"), sure).alias("fraction_concordant_definite"))


def direction_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Agreement of two arms' statuses on the same reference genes."""
    keys = list(keys)
    on = [*keys, "gene"]
    pair = left.select(*on, F.col("status").alias("a")).join(right.select(*on, F.col("status").alias("b")), on)
    none = ("no_hit", "not_tested", "not_significant")
    both = ~F.col("a").isin(*none) & ~F.col("b").isin(*none)
    sure = both & F.col("a").isin("concordant", "discordant") & F.col("b").isin("concordant", "discordant")
    same = sure & (F.col("a") == F.col("b"))
    return pair.groupBy(*keys).agg(
        F.count_if(both).alias("n_both_significant"), F.count_if(sure).alias("n_both_definite"),
        F.count_if(same).alias("n_same_sign"), F.count_if(sure & ~same).alias("n_opposite_sign"),
        F.count_if(both & ~sure).alias("n_any_uncertain"), rate(F.count_if(same), F.count_if(sure)).alias("fraction_same_sign"))


# ---- rankings and stacking -----------------------------------------------------------------

def top_genes(results: DataFrame, keys: Sequence[str], k: int, *, p: str = "pvalue", gene: str = "gene") -> DataFrame:
    return top_k(results, keys, [F.col(p).asc_nulls_last(), F.col(gene)], k)


def largest_mean_genes(draws: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """The k genes with the largest |mean z|, then ranked by the mean itself."""
    means = draws.groupBy(*keys, "gene").agg(F.avg("zscore").alias("mean_z"))
    chosen = top_k(means, keys, [F.abs("mean_z").desc(), F.col("gene")], k, rn="__k").drop("__k")
    # k rows per group remain, so this second ranking is bounded.
    return top_k(chosen, keys, [F.col("mean_z"), F.col("gene")], k, rn="position")


def ordered_hits(hits: DataFrame) -> DataFrame:
    """Stable presentation order; null p-values last."""
    return hits.orderBy("cell_type", F.col("pvalue").asc_nulls_last(), "gene")


def stack(tables: Sequence[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def append_reported(summary: DataFrame, reported: DataFrame, *, source: str) -> DataFrame:
    """Externally reported rows below measured ones; unknown columns stay null."""
    return summary.withColumn("source", F.lit("measured")).unionByName(
        reported.withColumn("source", F.lit(source)), allowMissingColumns=True)

"""JSON records of models with several heads, and of ensembles; :func:`~.text.parse_weights` reads both back.

A gene's record is one row, gathered per gene in SNP order, as the format has one object for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Heads of a probabilistic model; those fitted on log1p of a variance say so.
VARIANCES = ("aleatoric", "epistemic")
HEADS = ("mean", *VARIANCES)
SCALE = "raw_dosage"
#: Weights up to this size count as absent.
ZERO = 1e-12


def _chromosome(chrom: Column) -> Column:
    """Whole numbers as numbers, other names as text, in a JSON text that is spliced in later."""
    return F.when(chrom.rlike(r"^\d+$"), F.regexp_replace(chrom, r"^0+(?=\d)", "")).otherwise(F.concat(F.lit('"'), chrom, F.lit('"')))


def _record(gene: Column, fields: Column, chrom: Column) -> Column:
    """{gene: {fields..., "chr": chrom}} as text; a struct of ``to_json`` leaves out what is null."""
    return F.concat(F.lit("{"), F.to_json(F.array(gene)).substr(F.lit(2), F.length(F.to_json(F.array(gene))) - 2), F.lit(": {\"chr\": "),
                    _chromosome(chrom), F.lit(", "), F.substring(F.to_json(fields), 2, 1 << 30), F.lit("}"))


def probabilistic_json(coefficients: DataFrame, heads: DataFrame) -> DataFrame:
    """(gene, value): one record per gene with the heads mean, aleatoric and epistemic.

    ``coefficients(gene, head, place, snp, weight)``: zero weights are left out, SNPs stand by place. ``heads(gene, chrom, head,
    intercept)`` has a row for every head; a head without weights keeps its intercept, and a gene that lacks a head is an error.
    """
    listed = coefficients.filter("weight <> 0").groupBy("gene", "head").agg(
        F.array_sort(F.collect_list(F.struct("place", "snp", "weight"))).alias("z"))
    known = heads.select("gene", "head", F.col("intercept").cast("double").alias("intercept"), F.col("chrom").cast("string").alias("chrom"))
    z = F.coalesce("z", F.array().cast(listed.schema["z"].dataType))
    rows = known.join(listed, ["gene", "head"], "left")
    entry = F.struct(F.col("z.snp").alias("snp_ids"), F.col("z.weight").alias("coefs"), "intercept",
                     F.when(F.col("head").isin(*VARIANCES), F.lit(True)).alias("log1p"))
    per = rows.withColumn("z", z).groupBy("gene").agg(
        F.max("chrom").alias("chrom"), *[F.first(F.when(F.col("head") == h, entry), ignorenulls=True).alias(h) for h in HEADS])
    lacking = F.greatest(*[F.col(h).isNull() for h in HEADS])
    whole = F.when(~lacking, F.struct(*HEADS)).otherwise(F.raise_error(F.concat(F.lit("a head is missing: "), F.col("gene").cast("string"))))
    return per.select("gene", _record(F.col("gene"), whole, F.col("chrom")).alias("value"))


_HEAD = "struct<snp_ids: array<string>, coefs: array<double>, intercept: double, log1p: boolean>"


def parse_heads(texts: DataFrame) -> DataFrame:
    """(gene, chrom, head, intercept, log1p, place, snp, weight) of probabilistic records; a head without weights has one row
    without SNP. A head whose numbers of SNPs and weights differ is an error."""
    schema = "map<string, struct<chr: string, " + ", ".join(f"{h}: {_HEAD}" for h in HEADS) + ">>"
    entry = texts.select(F.explode(F.from_json("value", schema)).alias("gene", "e"))
    heads = entry.select("gene", F.col("e.chr").alias("chrom"), F.explode(F.array(*[
        F.struct(F.lit(h).alias("head"), F.col(f"e.{h}").alias("h")) for h in HEADS])).alias("x")).select("gene", "chrom", "x.head", "x.h.*")
    zipped = F.when(F.size("coefs") == F.size("snp_ids"), F.arrays_zip("snp_ids", "coefs")).otherwise(
        F.raise_error(F.concat(F.lit("coefficient count differs from SNP count: "), F.col("gene"))))
    return heads.select("gene", "chrom", "head", "intercept", F.coalesce("log1p", F.lit(False)).alias("log1p"),
                        F.posexplode_outer(zipped).alias("place", "z")).select(
        "gene", "chrom", "head", "intercept", "log1p", F.col("place").cast("bigint").alias("place"), F.col("z.snp_ids").alias("snp"), F.col("z.coefs").alias("weight"))


def ensemble_moments(fits: DataFrame, coefficients: DataFrame, *, zero: float = ZERO) -> DataFrame:
    """Empirical moments of every (gene, snp) over all member-bootstrap fits; a fit without a row of the SNP has weight 0.

    ``fits(gene, member, bootstrap)`` lists the fits. The variance within members is the mean of their variances, the one
    between members that of their means; members count alike, however many fits they have. ``pip`` is the share of fits that
    include the SNP, ``sign_stability`` the share of the prevailing sign over the other among these.
    """
    size = fits.groupBy("gene", "member").agg(F.count(F.lit(1)).alias("n"))
    members = size.groupBy("gene").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("fits"))
    used = F.abs("weight") > zero
    per = coefficients.groupBy("gene", "snp", "member").agg(
        F.sum("weight").alias("s"), F.sum(F.col("weight") * F.col("weight")).alias("s2"), F.sum(used.cast("bigint")).alias("held"),
        F.sum(F.when(used, F.signum("weight")).otherwise(0.0)).alias("sign")).join(size, ["gene", "member"])
    mean = F.col("s") / F.col("n")
    within = F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0))
    total = per.groupBy("gene", "snp").agg(F.sum(mean).alias("m"), F.sum(mean * mean).alias("m2"), F.sum(within).alias("w"),
                                           F.sum("held").alias("held"), F.sum("sign").alias("sign")).join(members, "gene")
    centre = F.col("m") / F.col("members")
    between = F.greatest(F.col("m2") / F.col("members") - centre * centre, F.lit(0.0))
    return total.select("gene", "snp", centre.alias("mean"), (F.col("w") / F.col("members") + between).alias("variance"),
                        (F.col("w") / F.col("members")).alias("within_variance"), between.alias("between_variance"),
                        (F.col("held") / F.col("fits")).alias("pip"),
                        F.coalesce(F.try_divide(F.abs("sign"), F.col("held")), F.lit(0.0)).alias("sign_stability"))


def ensemble_json(fits: DataFrame, coefficients: DataFrame, genes: DataFrame, *, pip_threshold: float = 0.0, zero: float = ZERO) -> DataFrame:
    """(gene, value): one record per gene with pooled weights, their moments and every member's bootstrap weights.

    ``fits(gene, member, bootstrap, intercept)``, ``coefficients(gene, member, bootstrap, place, snp, weight)`` without the
    zeros, ``genes(gene, chrom)``. SNPs with ``pip`` under the threshold are left out everywhere. Members may have different
    numbers of fits; a SNP that a fit lacks is 0 in its list, so all lists are as long as the gene's SNPs.
    """
    places = coefficients.groupBy("gene", "snp").agg(F.min("place").alias("place"))
    kept = ensemble_moments(fits, coefficients, zero=zero).filter(F.col("pip") >= pip_threshold).join(places, ["gene", "snp"])
    tracks = ("mean", "variance", "within_variance", "between_variance", "pip", "sign_stability")
    gathered = kept.groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("place", "snp", *tracks))).alias("k"))
    weights = coefficients.groupBy("gene", "member", "bootstrap", "snp").agg(F.sum("weight").alias("weight")).groupBy(
        "gene", "member", "bootstrap").agg(F.map_from_entries(F.collect_list(F.struct("snp", "weight"))).alias("held"))
    one = (fits.select("gene", "member", "bootstrap", F.col("intercept").cast("double").alias("intercept")).join(weights, ["gene", "member", "bootstrap"], "left")
           .join(gathered.select("gene", F.col("k.snp").alias("snps")), "gene", "left"))
    snps = F.coalesce("snps", F.array().cast("array<string>"))
    dense = F.transform(snps, lambda s: F.coalesce(F.try_element_at("held", s), F.lit(0.0)))
    fitted = one.select("gene", "member", "bootstrap", "intercept", dense.alias("row"))
    rows = fitted.groupBy("gene", "member").agg(F.array_sort(F.collect_list(F.struct("bootstrap", "intercept", "row"))).alias("b"))
    lists, offsets, count = F.col("b.row"), F.col("b.intercept"), F.size("b")

    def average(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)

    def spread(values: Column) -> Column:
        return average(F.transform(values, lambda v: (v - average(values)) * (v - average(values))))

    def along(summary) -> Column:
        width = F.size(F.get(lists, F.lit(0)))
        return F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), lambda i: summary(F.transform(lists, lambda r: F.get(r, i))))).otherwise(
            F.array().cast("array<double>"))

    included = lambda values: average(F.transform(values, lambda v: (F.abs(v) > zero).cast("double")))
    member = F.struct(
        F.col("member").cast("string").alias("member_id"), along(average).alias("coefs"), along(lambda v: F.sqrt(spread(v))).alias("coef_sds"),
        along(spread).alias("coef_variances"), along(included).alias("inclusion_probabilities"), lists.alias("bootstrap_coefs"),
        average(offsets).alias("intercept"), F.sqrt(spread(offsets)).alias("intercept_sd"), offsets.alias("bootstrap_intercepts"))
    members = rows.select("gene", member.alias("m"), count.alias("n")).groupBy("gene").agg(
        F.array_sort(F.collect_list("m")).alias("members"), F.sum("n").alias("n_fits"))
    whole = members.join(gathered, "gene", "left").join(genes.select("gene", F.col("chrom").cast("string").alias("chrom")), "gene")
    k = F.coalesce("k", F.array().cast(gathered.schema["k"].dataType))
    # The mean of members' means, and their within and between variances, as for the weights.
    means, variances = F.transform("members", lambda m: m["intercept"]), F.transform("members", lambda m: m["intercept_sd"] * m["intercept_sd"])
    entry = F.struct(
        F.col("k.snp").alias("snp_ids"), F.col("k.mean").alias("coefs"), average(means).alias("intercept"),
        F.transform("k.variance", F.sqrt).alias("coef_sds"), F.col("k.variance").alias("coef_variances"),
        F.col("k.within_variance").alias("coef_within_variances"), F.col("k.between_variance").alias("coef_between_variances"),
        F.col("k.pip").alias("inclusion_probabilities"), F.col("k.sign_stability").alias("sign_stabilities"),
        F.sqrt(average(variances) + spread(means)).alias("intercept_sd"), "members",
        F.struct(F.size("members").alias("n_members"), "n_fits", F.size("k").alias("n_retained_snps"), F.lit(pip_threshold).alias("pip_threshold"),
                 F.lit(SCALE).alias("coefficient_scale")).alias("metadata"))
    return whole.withColumn("k", k).select("gene", _record(F.col("gene"), entry, F.col("chrom")).alias("value"))

"""Allele frequencies, covariance in tiles, scoring, edits and sequences."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.distributions import norm_ppf
from ..functions.ordered import average_ranks, row_numbers, running
from ..functions.storage import grid, reusable
from .intervals import window_join

#: SNPs per tile side and donors per chunk: bounds one task's matrix whatever the group size.
TILE, CHUNK = 512, 4096


def dosages(genotypes: DataFrame) -> DataFrame:
    """Negative sentinels become NULL."""
    return genotypes.withColumn("dosage", F.when(F.col("dosage") >= 0, F.col("dosage")))


def allele_frequencies(genotypes: DataFrame, keys: Sequence[str] = ("snp",)) -> DataFrame:
    """Counted-allele and minor-allele frequency over called donors; all missing gives 0."""
    p = F.coalesce(F.avg("dosage") / 2.0, F.lit(0.0))
    return genotypes.groupBy(*keys).agg(p.alias("frequency"), F.count("dosage").alias("n_called")).withColumn(
        "maf", F.least(F.col("frequency"), 1.0 - F.col("frequency")))


def common_variants(genotypes: DataFrame, threshold: float, keys: Sequence[str] = ("snp",)) -> DataFrame:
    kept = allele_frequencies(genotypes, keys).filter(F.col("maf") >= threshold).select(*keys)
    return genotypes.join(kept, list(keys), "left_semi")


def called_allele_frequencies(calls: DataFrame) -> DataFrame:
    """From called alleles: ``calls(snp, n_alt, n_called)`` per donor; nothing called fails any threshold."""
    p = F.try_divide(F.sum("n_alt"), F.nullif(F.sum("n_called"), F.lit(0)))
    return calls.groupBy("snp").agg(p.alias("frequency")).withColumn(
        "maf", F.least(F.col("frequency"), 1.0 - F.col("frequency")))


def biallelic_in_window(calls: DataFrame, *, start: str = "start", stop: str = "stop") -> DataFrame:
    """Single-base variants inside a 0-based half-open window, with their offset in it."""
    offset = F.col("bp") - 1 - F.col(start)
    return calls.withColumn("offset", offset).filter(
        (F.length("ref") == 1) & (F.length("alt") == 1) & (F.col("offset") >= 0) & (F.col("bp") - 1 < F.col(stop)))


# ---- pairwise products in bounded tiles ------------------------------------------------------

def donor_slots(donors: DataFrame, *, chunk: int = CHUNK, limit: int | None = None) -> DataFrame:
    """A dense 0-based slot per donor and its chunk."""
    placed = row_numbers(donors.select("donor").distinct(), [], ["donor"], rn="__rn", limit=limit)
    at = F.col("__rn") - 1
    return placed.select("donor", F.floor(at / chunk).cast("bigint").alias("chunk"), (at % chunk).cast("int").alias("slot"))


def _tile_matrices(pdf: pd.DataFrame):
    """Both tiles of one group, the pairs between them and their products over one donor chunk."""
    first, second = int(pdf["ti"].iloc[0]), int(pdf["tj"].iloc[0])
    pdf = pdf.sort_values("place")
    width = 1 + max((max(s) if len(s) else 0) for s in pdf["slots"])

    def dense(part: pd.DataFrame) -> np.ndarray:
        m = np.zeros((len(part), width))
        for row, (slots, xs) in enumerate(zip(part["slots"], part["xs"])):
            m[row, np.asarray(slots, dtype=int)] = xs
        return m

    left = pdf[pdf["tile"] == first]
    right = left if first == second else pdf[pdf["tile"] == second]
    product = dense(left) @ dense(right).T
    rows, cols = np.triu_indices(len(left)) if first == second else np.indices(product.shape).reshape(2, -1)
    return left, right, rows, cols, product[rows, cols]


def _named_products(pdf: pd.DataFrame) -> pd.DataFrame:
    left, right, rows, cols, values = _tile_matrices(pdf)
    return pd.DataFrame({"gid": pdf["gid"].iloc[0], "f1": left["feature"].to_numpy()[rows],
                         "f2": right["feature"].to_numpy()[cols], "part": values})


def _placed_products(pdf: pd.DataFrame) -> pd.DataFrame:
    left, right, rows, cols, values = _tile_matrices(pdf)
    return pd.DataFrame({"gid": pdf["gid"].iloc[0], "i": left["place"].to_numpy()[rows],
                         "j": right["place"].to_numpy()[cols], "part": values})


def pair_products(values: DataFrame, keys: Sequence[str], places: DataFrame, slots: DataFrame, *,
                  within: Sequence[str] = (), tile: int = TILE, named: bool = True) -> DataFrame:
    """sum over donors of x_i x_j for every pair i <= j in place order, per group.

    ``values(keys, within, feature, donor, x)`` with absent rows as zero;
    ``places(keys, feature, place)`` 1-based. The result is the pair table that
    was asked for, by feature name or by place; no task holds more than two
    tiles of features by one chunk of donors, however large group or cohort are.
    """
    keys, within = list(keys), list(within)
    every = [*keys, *within]
    arrays = (values.join(slots, "donor").groupBy(*every, "feature", "chunk")
              .agg(F.collect_list("slot").alias("slots"), F.collect_list(F.col("x").cast("double")).alias("xs")))
    tiles = F.floor((F.col("place") - 1) / tile).cast("int")
    sized = places.groupBy(*keys).agg((F.floor((F.max("place") - 1) / tile) + 1).cast("int").alias("n_tiles"))
    placed = arrays.join(places.withColumn("tile", tiles), [*keys, "feature"]).join(sized, keys)
    spread = placed.select(
        F.to_json(F.struct(*every)).alias("gid"), F.col("feature").cast("string").alias("feature"), "place", "tile",
        "chunk", "slots", "xs", F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1)).alias("other")).withColumns(
        {"ti": F.least("tile", "other"), "tj": F.greatest("tile", "other")})
    grouped = spread.groupBy("gid", "ti", "tj", "chunk")
    if named:
        parts = grouped.applyInPandas(_named_products, "gid string, f1 string, f2 string, part double")
        return parts.groupBy("gid", "f1", "f2").agg(F.sum("part").alias("product"))
    parts = grouped.applyInPandas(_placed_products, "gid string, i long, j long, part double")
    return parts.groupBy("gid", "i", "j").agg(F.sum("part").alias("product"))


def gene_covariance(gene_snps: DataFrame, genotypes: DataFrame, *, max_snps: int | None = None,
                    tile: int = TILE, chunk: int = CHUNK, limit: int | None = None
                    ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, snps, genes): covariance over mean-imputed dosages, divisor n - 1.

    ``gene_snps(gene, snp, bp)``, ``genotypes(snp, donor, dosage)``. SNPs
    without spread go; a gene above ``max_snps`` is excluded, as the caller asks.
    """
    donors = reusable(genotypes.select("donor").distinct())
    n = donors.select(F.count(F.lit(1))).scalar()
    enough = F.when(n >= 3, n).otherwise(F.raise_error(F.lit("need at least three donors")).cast("bigint"))
    called = genotypes.groupBy("snp").agg(
        F.avg("dosage").alias("mean"), (F.var_pop("dosage") * F.count("dosage")).alias("ss"))
    stats = called.select("snp", "mean", F.sqrt(F.col("ss") / (enough - 1)).alias("sd")).filter("sd > 0")
    wanted = gene_snps.join(stats, "snp")
    if max_snps is not None:
        kept = wanted.groupBy("gene").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") <= max_snps).select("gene")
        wanted = wanted.join(kept, "gene", "left_semi")
    wanted = reusable(wanted)
    places = row_numbers(wanted.select("gene", "snp", "bp"), ["gene"], ["bp", "snp"], rn="place", limit=limit).select(
        "gene", F.col("snp").alias("feature"), "place")
    centred = wanted.select("gene", "snp", "mean").join(genotypes.filter("dosage is not null"), "snp").select(
        "gene", F.col("snp").alias("feature"), "donor", (F.col("dosage") - F.col("mean")).alias("x"))
    products = pair_products(centred, ["gene"], places, donor_slots(donors, chunk=chunk, limit=limit), tile=tile)
    gene_type = dict(gene_snps.dtypes)["gene"]
    snp_type = dict(gene_snps.dtypes)["snp"]
    pairs = products.select(
        F.get_json_object("gid", "$.gene").cast(gene_type).alias("gene"), F.col("f1").cast(snp_type).alias("snp1"),
        F.col("f2").cast(snp_type).alias("snp2"), (F.col("product") / (n - 1)).alias("value"))
    genes = wanted.groupBy("gene").agg(
        F.min("bp").alias("start_bp"), F.max("bp").alias("end_bp"),
        F.floor((F.min("bp") + F.max("bp")) / 2).alias("mid_bp"), F.count(F.lit(1)).alias("n_snps_in_cov"))
    return pairs, wanted.select("gene", "snp", "bp", "sd"), genes


# ---- scoring -------------------------------------------------------------------------------

def score(weights: DataFrame, intercepts: DataFrame, genotypes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """intercept + sum(weight x dosage) per (keys, gene, donor).

    A missing call counts 0; SNPs absent from the panel are skipped. Genes with an intercept only are constant for every
    donor: a grid of genes and donors, spread over salts.
    """
    keys = list(keys)
    base = intercepts.select(*keys, "gene", "intercept")
    calls = genotypes.select(F.col("snp").cast("string").alias("snp"), "donor",
                             F.coalesce("dosage", F.lit(0)).cast("double").alias("dosage"))
    terms = weights.select(*keys, "gene", F.col("snp").cast("string").alias("snp"), "weight")
    summed = terms.join(calls, "snp").groupBy(*keys, "gene", "donor").agg(
        F.sum(F.col("weight") * F.col("dosage")).alias("s"))
    scored = summed.join(base, [*keys, "gene"], "left").select(
        *keys, "gene", "donor", (F.col("s") + F.coalesce("intercept", F.lit(0.0))).alias("value"))
    bare = base.join(weights.select(*keys, "gene").distinct(), [*keys, "gene"], "left_anti")
    constant = grid(genotypes.select("donor").distinct(), bare).select(
        *keys, "gene", "donor", F.coalesce("intercept", F.lit(0.0)).alias("value"))
    return scored.unionByName(constant)


def unscorable_genes(weights: DataFrame, genotypes: DataFrame) -> DataFrame:
    """Genes none of whose SNPs is in the panel (an error for the caller to raise)."""
    found = weights.join(genotypes.select("snp").distinct(), "snp", "left_semi").select("gene").distinct()
    return weights.select("gene").distinct().join(found, "gene", "left_anti")


def prediction_distribution(scores: DataFrame, *, member: str = "member") -> DataFrame:
    """Mean and population variance over member-bootstrap fits, and the spread of member means."""
    per = scores.groupBy("gene", "donor", member).agg(
        F.avg("value").alias("m"), F.var_pop("value").alias("v"), F.count("value").alias("n"))
    total = F.sum(F.col("m") * F.col("n")) / F.sum("n")
    second = F.sum(F.col("n") * (F.col("v") + F.col("m") * F.col("m"))) / F.sum("n")
    return per.groupBy("gene", "donor").agg(
        total.alias("mean"), F.greatest(second - total * total, F.lit(0.0)).alias("variance"),
        F.var_pop("m").alias("between_members"))


def screen(design: DataFrame, keys: Sequence[str], targets: Sequence[str], *, weight: str | None = None) -> DataFrame:
    """Marginal score of every (keys, snp): |covariance with the target| / SD, largest over targets.

    Sums only, so any number of donors combines before the shuffle. A constant SNP scores 0.
    """
    x = F.col("x").cast("double")
    if weight is None:
        parts = [F.coalesce(F.try_divide(F.abs(F.covar_pop(x, F.col(t))), F.nullif(F.stddev_pop(x), F.lit(0.0))), F.lit(0.0))
                 for t in targets]
    else:
        w = F.col(weight)
        sw, mx = F.sum(w), F.sum(w * x) / F.sum(w)
        sd = F.sqrt(F.greatest(F.sum(w * x * x) / sw - mx * mx, F.lit(0.0)))
        parts = [F.coalesce(F.try_divide(F.abs(F.sum(w * x * F.col(t)) / sw - mx * F.sum(w * F.col(t)) / sw),
                                         F.when(sd > 1e-12, sd)), F.lit(0.0)) for t in targets]
    best = F.greatest(*parts) if len(parts) > 1 else parts[0]
    return design.groupBy(*keys, "snp").agg(best.alias("score"))


# ---- spread through the rank map -----------------------------------------------------------

def rank_spread(df: DataFrame, keys: Sequence[str], *, form: str = "percentile", donor: str = "donor",
                limit: int | None = None) -> DataFrame:
    """SD after ranking: half the difference of the interpolated ECDF at value +- sigma.

    Support points and both query points are sorted together, so the neighbours
    of a query are a prefix maximum and a suffix minimum: no group is gathered.
    """
    if form not in ("percentile", "normal"):
        raise ValueError(f"unknown form {form!r}")
    keys = list(keys)
    rows = df.filter("value is not null")
    positive = rows.groupBy(*keys).agg(F.bool_and(F.col("value") >= 0).alias("__pos"))
    y = F.when(F.col("__pos"), F.log1p(F.greatest("value", F.lit(0.0)))).otherwise(F.col("value"))
    based = reusable(average_ranks(rows.join(positive, keys).withColumn("__y", y), keys, "__y",
                                   out="__r", n="__n", limit=limit))
    below = F.col("__n") + (0 if form == "percentile" else 1)
    support = based.select(*keys, F.col("__y").alias("at"), (F.col("__r") / below).alias("p")).distinct().select(
        *keys, "at", F.lit(0).alias("kind"), F.lit(None).cast(dict(df.dtypes)[donor]).alias(donor), "p")
    ok = based.filter(F.col("sigma") >= 0)
    ends = [ok.select(*keys, (F.col("__y") + side * F.col("sigma")).alias("at"), F.lit(kind).alias("kind"), donor,
                      F.lit(None).cast("double").alias("p")) for kind, side in ((1, -1), (2, 1))]
    events = support.unionByName(ends[0]).unionByName(ends[1])
    known = F.col("kind") == 0
    walked = running(events, keys, ["at", "kind", donor], limit=limit,
                     prefix_maxs={"y0": F.when(known, F.col("at")), "p0": F.col("p")},
                     suffix_mins={"y1": F.when(known, F.col("at")), "p1": F.col("p")})
    low, high = (F.lit(0.0), F.lit(1.0))
    n = based.groupBy(*keys).agg(F.max("__n").alias("__n"))
    walked = walked.filter("kind > 0").join(n, keys)
    if form == "normal":
        low, high = 1.0 / (F.col("__n") + 1), F.col("__n") / (F.col("__n") + 1)
    inside = F.col("p0") + (F.col("p1") - F.col("p0")) * F.try_divide(F.col("at") - F.col("y0"), F.col("y1") - F.col("y0"))
    f = F.when(F.col("y0").isNull(), low).when(F.col("y0") == F.col("at"), F.col("p0")).when(
        F.col("y1").isNull(), high).otherwise(inside)
    mapped = norm_ppf(f) if form == "normal" else f
    paired = walked.withColumn("f", mapped).groupBy(*keys, donor).agg(
        F.max("__n").alias("__n"), F.max(F.when(F.col("kind") == 1, F.col("f"))).alias("lo"),
        F.max(F.when(F.col("kind") == 2, F.col("f"))).alias("hi"))
    return paired.select(*keys, donor, F.when(F.col("__n") == 1, 0.0).otherwise(
        0.5 * (F.col("hi") - F.col("lo"))).alias("spread"))


# ---- sequences -----------------------------------------------------------------------------

# Base codes.
BASES = "ACGTN"


def chunk_sequences(sequences: DataFrame, length: int) -> DataFrame:
    """``(chrom, sequence)`` -> fixed-length numbered pieces, so no row holds a chromosome later on.

    One pass cuts all pieces; only they leave the row that holds the text.
    """
    pieces = F.regexp_extract_all("sequence", F.lit(f"(?s).{{1,{int(length)}}}"), F.lit(0))
    return sequences.select("chrom", F.length("sequence").cast("bigint").alias("chrom_length"),
                            F.posexplode_outer(pieces).alias("piece", "bases")).select(
        "chrom", "chrom_length", F.coalesce("piece", F.lit(0)).alias("piece"), F.coalesce("bases", F.lit("")).alias("bases"))


def window_sequences(windows: DataFrame, pieces: DataFrame, length: int) -> DataFrame:
    """Sequence of each 0-based half-open window.

    A window past a chromosome end is shifted inside; N-padding appears only
    when the chromosome is shorter: on the left where it starts at 0. Unknown
    chromosomes drop out.
    """
    sizes = pieces.filter("piece = 0").select("chrom", "chrom_length")
    size = F.col("end") - F.col("start")
    total = F.col("chrom_length")
    begin = F.when(F.col("start") < 0, 0).when(F.col("end") > total, F.greatest(total - size, F.lit(0))).otherwise(F.col("start"))
    stop = F.when(F.col("start") < 0, F.least(size, total)).when(F.col("end") > total, total).otherwise(F.col("end"))
    located = windows.join(sizes, "chrom").withColumns({"actual_start": begin, "actual_end": stop})
    first = F.floor(F.col("actual_start") / length).cast("int")
    last = F.floor(F.greatest(F.col("actual_end") - 1, F.col("actual_start")) / length).cast("int")
    touched = located.select("*", F.explode(F.sequence(first, last)).alias("piece"))
    joined = touched.join(pieces.select("chrom", "piece", "bases"), ["chrom", "piece"])
    # A window touches window/length + 2 pieces at most.
    glued = joined.groupBy(*windows.columns, "actual_start", "actual_end").agg(
        F.array_sort(F.collect_list(F.struct("piece", "bases"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["bases"]), "")
    offset = F.col("actual_start") - F.col("parts")[0]["piece"] * length
    cut = F.substr(text, (offset + 1).cast("int"), (F.col("actual_end") - F.col("actual_start")).cast("int"))
    pad = F.repeat(F.lit("N"), (size - (F.col("actual_end") - F.col("actual_start"))).cast("int"))
    padded = F.when(F.col("actual_start") == 0, F.concat(pad, cut)).otherwise(F.concat(cut, pad))
    return glued.withColumn("sequence", padded).drop("parts")


#: Code of each byte that begins a character, and the channels of each code.
CODE = np.full(256, 4, np.int32)
CODE[np.frombuffer((BASES + BASES.lower()).encode(), np.uint8)] = [0, 1, 2, 3, 4] * 2
CHANNELS = np.eye(5, 4, dtype=np.int32)


def _offsets(lists: pa.Array) -> np.ndarray:
    return np.frombuffer(lists.buffers()[1], np.int32)[lists.offset:lists.offset + len(lists) + 1] if len(lists) else np.zeros(1, np.int32)


def _lists(ends: np.ndarray, values: pa.Array, like: pa.Array) -> pa.Array:
    """Lists of values that are null where those of ``like`` are."""
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values, mask=like.is_null())


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _base_codes(text: pa.Array) -> pa.Array:
    text = text.cast(pa.string())
    at = _offsets(text)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]
    begins = (data & 0xC0) != 0x80
    codes, ends = CODE[data[begins]], np.r_[0, np.cumsum(begins)][at - at[0]]
    # as where a sequence is split, an empty one is one empty base, found in front of the letters
    empty = (np.diff(at) == 0) & text.is_valid().to_numpy(zero_copy_only=False)
    return _lists(ends + np.r_[0, np.cumsum(empty)], pa.array(np.insert(codes, ends[:-1][empty], 0)), text)


def base_codes(sequence: Column) -> Column:
    """0..4 for A, C, G, T, N; any other letter counts as N."""
    return _base_codes(sequence)


@F.arrow_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def _one_hot(codes: pa.Array) -> pa.Array:
    at = _offsets(codes)
    base = codes.values.slice(at[0], at[-1] - at[0])
    known = base.fill_null(4).to_numpy(zero_copy_only=False)
    rows = CHANNELS[np.where((known >= 0) & (known < 4), known, 4)].ravel()
    unknown = np.repeat(base.is_null().to_numpy(zero_copy_only=False), 4) if base.null_count else None
    inner = pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) + 1, 4, dtype=np.int32)), pa.array(rows, mask=unknown))
    return _lists(at - at[0], inner, codes)


def one_hot(codes: Column) -> Column:
    """Four channels per base; N is all zero."""
    return _one_hot(codes)


@F.arrow_udf(T.ArrayType(T.LongType()))
def _channel_sums(hot: pa.Array) -> pa.Array:
    at = _offsets(hot)
    inner = hot.values.slice(at[0], at[-1] - at[0])
    sums = [np.diff(np.r_[0, np.cumsum(inner.flatten().to_numpy(zero_copy_only=False)[k::4], dtype=np.int64)][at - at[0]]) for k in range(4)]
    return _lists(np.arange(len(at)) * 4, pa.array(np.stack(sums, 1).ravel()), hot)


def channel_sums(hot: Column) -> Column:
    """Sum of each of the four channels of a sequence of known bases."""
    return _channel_sums(hot)


@F.arrow_udf(T.LongType())
def _unknown_bases(codes: pa.Array) -> pa.Array:
    at = _offsets(codes)
    other = codes.values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False) == 4
    return pa.array(np.diff(np.r_[0, np.cumsum(other)][at - at[0]]), mask=codes.is_null().to_numpy(zero_copy_only=False))


def unknown_bases(codes: Column) -> Column:
    """How many bases of a sequence are none of the four."""
    return _unknown_bases(codes)


def centre_crop(sequence: Column, width: int | Column) -> Column:
    wide = F.lit(width) if isinstance(width, int) else width
    start = F.floor((F.length(sequence) - wide) / 2) + 1
    return F.substr(sequence, start.cast("int"), wide)


def apply_edits(sequence: Column, edits: Column) -> Column:
    """Replace single bases; ``edits`` is map<int offset, string base>.

    The sequence is cut at the offsets inside it, so that a row costs as much as its edits, not a look-up for every base. An
    empty sequence has one empty base.
    """
    end = F.greatest(F.length(sequence), F.lit(1))
    inside = F.filter(F.map_keys(edits), lambda k: (k >= 0) & (k < end) & F.try_element_at(edits, k).isNotNull())
    cuts = F.coalesce(F.array_sort(inside).cast("array<int>"), F.array().cast("array<int>"))

    def piece(cut, following):
        base = F.when(cut >= 0, F.try_element_at(edits, cut)).otherwise("")
        return F.concat(base, F.substr(sequence, cut + 2, following - cut - 1))

    pieces = F.zip_with(F.concat(F.array(F.lit(-1)), cuts), F.concat(cuts, F.array(end)), piece)
    return F.when(sequence.isNotNull(), F.array_join(pieces, ""))


def central_mean(bins: Column, width: int, n_features: int) -> Column:
    """Mean over exactly ``width`` central rows of an array of feature arrays."""
    start = F.floor((F.size(bins) - width) / 2) + 1
    zero = F.array_repeat(F.lit(0.0), n_features)
    total = F.aggregate(F.slice(bins, start.cast("int"), F.lit(width)), zero,
                        lambda acc, row: F.zip_with(acc, row, lambda a, b: a + b.cast("double")))
    return F.transform(total, lambda v: v / width)


def variant_edits(genes: DataFrame, variants: DataFrame, calls: DataFrame, *, window: int,
                  mode: str = "any") -> DataFrame:
    """Edits per (gene, donor): ALT where any called allele is ALT, or the ALT dosage share.

    ``genes(gene, chrom, tss)``, ``variants(chrom, snp, bp, ref, alt)``,
    ``calls(snp, donor, n_alt, n_called)``. A gene-donor pair holds at most the
    variants of one window.
    """
    inside = window_join(genes, variants.filter((F.length("ref") == 1) & (F.length("alt") == 1)), window=window)
    offset = F.col("bp") - 1 - (F.col("tss") - window)
    carried = inside.select("gene", "snp", offset.alias("offset"), "ref", "alt").join(
        calls.filter(F.col("n_called") > 0), "snp")
    if mode == "any":
        rows = carried.filter(F.col("n_alt") > 0).select("gene", "donor", F.struct("offset", "alt").alias("edit"))
    elif mode == "dosage":
        share = F.col("n_alt") / F.col("n_called")
        rows = carried.select("gene", "donor", F.struct("offset", "ref", "alt", share.alias("dosage")).alias("edit"))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return rows.groupBy("gene", "donor").agg(F.array_sort(F.collect_list("edit")).alias("edits"))


def log_flags(features: DataFrame, *, column: str = "features") -> DataFrame:
    """Per feature: log-transform where all values are non-negative and skewness exceeds 1."""
    long = features.select(F.posexplode(column).alias("feature", "v"))
    v = F.col("v").cast("double")
    return long.groupBy("feature").agg(F.min(v).alias("low"), F.skewness(v).alias("skew")).select(
        "feature", "low", "skew", ((F.col("low") >= 0) & F.coalesce(F.col("skew") > 1, F.lit(False))).alias("log"))

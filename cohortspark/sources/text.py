"""Text formats as ``parse_*`` over a table of lines, plus readers over paths.

A line table has ``value`` and a sortable ``ordinal`` (file order), so parsing
is the same for files and for lines Spark derives from other tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import exprs as X
from ..functions.distributions import norm_isf
from ..functions.ordered import first_by, row_numbers

# Half window around a transcription start, known block counts per population.
HALF_WINDOW = 98304
KNOWN_BLOCK_COUNTS = {1703: "EUR", 2583: "AFR", 1445: "ASN"}
GENE_ID_PATTERN = r"ENSG\d+"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file, and their order: file, block start, position within the split."""
    lines = spark.read.text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line")).alias("ordinal"))


def fields(lines: DataFrame, names: Sequence[str], *, sep: str = r"\s+", comment: str | None = "#") -> DataFrame:
    """Split non-empty, non-comment lines into named text columns."""
    kept = lines.filter(F.trim("value") != "")
    if comment:
        kept = kept.filter(~F.col("value").startswith(comment))
    text = F.trim("value") if sep == r"\s+" else F.col("value")
    parts = F.split(text, sep)
    return kept.select(*[F.get(parts, i).alias(n) for i, n in enumerate(names)], "ordinal")


def by_file(lines: DataFrame) -> DataFrame:
    """Line tables made by hand may lack ``file``: they are one file."""
    return lines if "file" in lines.columns else lines.withColumn("file", F.lit(""))


def require_columns(df: DataFrame, required: Sequence[str], what: str) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns {missing}")
    return df


# ---- variants, samples, calls --------------------------------------------------------------

def parse_variants(lines: DataFrame) -> DataFrame:
    """Six whitespace columns; the first row of a repeated SNP id wins."""
    raw = fields(lines, ["chrom", "snp", "cm", "bp", "a1", "a2"])
    typed = raw.select(X.chrom_key(F.col("chrom")).alias("chrom"), "snp", F.col("cm").try_cast("double").alias("cm"),
                       F.col("bp").try_cast("bigint").alias("bp"), "a1", "a2", "ordinal")
    return first_by(typed, ["snp"], [F.col("chrom"), F.col("ordinal")]).drop("ordinal")


def duplicate_count(lines: DataFrame) -> DataFrame:
    """How many variant rows repeat an earlier SNP id."""
    raw = fields(lines, ["chrom", "snp"])
    return raw.agg((F.count(F.lit(1)) - F.count_distinct("snp")).alias("n_duplicates"))


def parse_samples(lines: DataFrame, *, doubled: bool = False) -> DataFrame:
    """Second column is the donor; ``doubled`` rewrites ids to ``id_id``."""
    raw = fields(lines, ["family_id", "donor"])
    donor = F.concat_ws("_", "donor", "donor") if doubled else F.col("donor")
    return raw.select("family_id", donor.alias("donor"), "ordinal")


def parse_vcf(lines: DataFrame, donors: Sequence[str] | None = None) -> DataFrame:
    """One row per biallelic single-base record and donor: called alleles and ALT alleles.

    Donor names come from each file's own ``#CHROM`` line unless given; a file without one is an error.
    """
    lines = by_file(lines)
    if donors is None:
        heads = lines.filter(F.col("value").startswith("#CHROM")).groupBy("file").agg(
            F.min_by(F.slice(F.split("value", "\t"), 10, 100000000), "ordinal").alias("found"))
        lines = lines.filter(~F.col("value").startswith("#")).join(heads, "file", "left")
        names = F.when(F.col("found").isNotNull(), F.col("found")).otherwise(F.raise_error(
            F.concat(F.lit("no #CHROM line in "), F.col("file"))).cast("array<string>"))
    else:
        names = F.array(*[F.lit(d) for d in donors])

    cells = F.slice(F.split("value", "\t"), 10, 100000000)
    body = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    parts = F.split("value", "\t")
    wide = body.select(X.chrom_key(parts[0]).alias("chrom"), parts[1].cast("bigint").alias("bp"), parts[2].alias("snp"),
                       F.upper(parts[3]).alias("ref"), F.upper(parts[4]).alias("alt"), cells.alias("cells"),
                       names.alias("names"))

    single = wide.filter((F.length("ref") == 1) & (F.length("alt") == 1))
    long = single.select("chrom", "bp", "snp", "ref", "alt", F.explode(F.arrays_zip("cells", "names")).alias("z")).select(
        "*", F.col("z.cells").alias("cell"), F.col("z.names").alias("donor")).filter("cell is not null")
    alleles = F.filter(F.split(F.split_part("cell", F.lit(":"), F.lit(1)), "[/|]"), lambda a: a.rlike(r"^\d+$"))
    return long.select("chrom", "bp", "snp", "ref", "alt", "donor",
                       F.size(alleles).alias("n_called"), F.size(F.filter(alleles, lambda a: a != "0")).alias("n_alt"))


def contig_style(lines: DataFrame) -> DataFrame:
    """Whether the records name their contigs with a ``chr`` prefix; both styles in one input are an error."""
    prefixed = F.lower(F.split("value", "\t")[0]).startswith("chr")
    return lines.filter(~F.col("value").startswith("#")).agg(F.min(prefixed).alias("a"), F.max(prefixed).alias("b")).select(
        F.when(F.col("a") == F.col("b"), F.col("a")).when(F.col("a").isNotNull(), F.raise_error(
            F.lit("contigs with and without chr in one input")).cast("boolean")).alias("prefixed"))


def autosomal(windows: DataFrame, *, chrom: str = "chrom") -> DataFrame:
    return windows.filter(F.regexp_replace(F.col(chrom).cast("string"), "^chr", "").rlike(r"^\d+$"))


# ---- blocks and annotation -----------------------------------------------------------------

def parse_blocks(lines: DataFrame) -> DataFrame:
    """LD blocks: optional header and ``chr``; stop must exceed start; numbered in (chrom text, start) order."""
    raw = fields(lines, ["chrom", "start", "stop"]).filter(F.col("start").rlike(r"^\d+$"))
    typed = raw.select(X.chrom_key(F.col("chrom")).alias("chrom"), F.col("start").cast("bigint").alias("start"),
                       F.col("stop").cast("bigint").alias("stop"))
    checked = typed.withColumn("stop", F.when(F.col("stop") > F.col("start"), F.col("stop")).otherwise(
        F.raise_error(F.lit("block with stop <= start")).cast("bigint")))
    numbered = row_numbers(checked, [], ["chrom", "start", "stop"], rn="rn")
    return numbered.select("chrom", "start", "stop", (F.col("rn") - 1).alias("block_index"),
                           F.concat(F.lit("chr"), "chrom", F.lit(":"), "start", F.lit("-"), "stop").alias("block"))


def block_set_name(n_blocks: int, fallback: str) -> str:
    return KNOWN_BLOCK_COUNTS.get(n_blocks, fallback)


def parse_gtf(lines: DataFrame) -> DataFrame:
    """Annotation rows with versionless gene id, symbol, type and strand."""
    names = ["seqname", "source", "feature", "start", "end", "score", "strand", "frame", "attributes"]
    raw = fields(lines, names, sep="\t").filter(F.col("attributes").isNotNull())
    a = F.col("attributes")

    def attribute(*keys: str) -> Column:
        return F.coalesce(*[X.gtf_attribute(a, k) for k in keys])

    return raw.select(
        X.chrom_key(F.col("seqname")).alias("chrom"), "feature", F.col("start").cast("bigint").alias("start"),
        F.col("end").cast("bigint").alias("end"), "strand", X.gene_key(attribute("gene_id", "ID")).alias("gene"),
        attribute("gene_name", "gene_symbol", "Name").alias("symbol"),
        attribute("gene_type", "gene_biotype").alias("gene_type"), "ordinal")


def gene_symbols(gtf: DataFrame) -> DataFrame:
    """id -> symbol from ``gene`` rows, or from every feature where the file has none; first wins."""
    usable = gtf.filter(F.col("gene").isNotNull() & (F.trim("symbol") != ""))
    is_gene = F.col("feature") == "gene"
    per = usable.groupBy("gene").agg(
        F.min_by("symbol", F.when(is_gene, F.col("ordinal"))).alias("from_gene"),
        F.min_by("symbol", F.when(~is_gene, F.col("ordinal"))).alias("from_any"), F.bool_or(is_gene).alias("has_gene"))
    any_gene = usable.select(F.bool_or(is_gene)).scalar()
    return per.filter(~any_gene | F.col("has_gene")).select(
        "gene", F.when(any_gene, F.col("from_gene")).otherwise(F.col("from_any")).alias("symbol"))


def gene_intervals(gtf: DataFrame) -> DataFrame:
    return gtf.filter("feature = 'gene' and gene is not null").select("gene", "chrom", "start", "end")


def region_genes(gtf: DataFrame, region: Column) -> DataFrame:
    """Gene ids whose interval overlaps a parsed region (closed ends)."""
    return gene_intervals(gtf).filter((F.col("chrom") == region["chrom"]) & (F.col("end") >= region["start"])
                                      & (F.col("start") <= region["end"])).select("gene").distinct()


def gene_windows(gtf: DataFrame, ids: DataFrame | None = None, *, half: int = HALF_WINDOW,
                 coding_only: bool = True) -> DataFrame:
    """TSS by strand and the window around it, one base lower at both ends (0-based start)."""
    rows = gtf.filter("feature = 'gene' and gene is not null")
    if coding_only:
        rows = rows.filter("gene_type = 'protein_coding'")
    if ids is not None:
        rows = rows.join(ids.select(X.gene_key(F.col("gene")).alias("gene")).distinct(), "gene", "left_semi")
    tss = F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("end"))
    return rows.select("chrom", F.col("gene").alias("ensid"), tss.alias("tss"),
                       (tss - half - 1).alias("start"), (tss + half - 1).alias("end"))


# ---- lists and tables ----------------------------------------------------------------------

def parse_gene_list(lines: DataFrame) -> DataFrame:
    """Ids anywhere in the text, one row each."""
    found = F.regexp_extract_all(F.upper("value"), F.lit(f"({GENE_ID_PATTERN})"), F.lit(1))
    return lines.filter(~F.col("value").startswith("#")).select(F.explode(found).alias("gene")).distinct()


def gene_table(df: DataFrame) -> DataFrame:
    """(gene, symbol) from a table: ENSID/gene/ensid or the first column, optional symbol column."""
    column = next((c for c in ("ENSID", "gene", "ensid") if c in df.columns), df.columns[0])
    name = next((c for c in ("Gene", "gene_name", "symbol", "name") if c in df.columns and c != column), None)
    symbol = F.trim(F.col(name).cast("string")) if name else F.lit(None).cast("string")
    filled = F.when((symbol != "") & ~F.lower(symbol).isin("nan", "none"), symbol)
    return df.select(X.gene_key(F.col(column).cast("string")).alias("gene"), filled.alias("symbol")).filter(
        "gene is not null").groupBy("gene").agg(F.max("symbol").alias("symbol"))


def wide_to_long(df: DataFrame, *, meta: Sequence[str] = ("gene", "chrom", "tss"), value: str = "value") -> DataFrame:
    """Wide donors -> rows with the donor's ordinal; a table with ``individual`` is already long.

    The first row of a repeated gene is the caller's choice: see ``first_by``.
    """
    if "individual" in df.columns:
        return df.withColumnsRenamed({"individual": "donor", "expression": value})
    kept = [c for c in meta if c in df.columns]
    donors = [c for c in df.columns if c not in kept]
    names = F.array(*[F.lit(d) for d in donors])
    values = F.array(*[X.null_nan(F.col(f"`{d}`").cast("double")) for d in donors])
    return df.select(*kept, F.posexplode(values).alias("ordinal", value)).withColumn(
        "donor", F.get(names, F.col("ordinal")))


def reference_list(df: DataFrame, *, region: Column | None = None) -> DataFrame:
    """Reference genes with one row per listed block; key is the id or else the upper symbol."""
    require_columns(df, ["locus", "gene"], "reference list")
    symbol = F.trim(F.coalesce(F.col("gene"), F.lit("")))
    ensid = F.trim(F.coalesce(F.col("ensid"), F.lit(""))) if "ensid" in df.columns else F.lit("")
    key = F.coalesce(X.gene_key(F.nullif(ensid, F.lit(""))), F.upper(symbol))
    has = "ld_block_index" in df.columns
    indices = F.transform(X.parse_list(F.coalesce(F.col("ld_block_index").cast("string"), F.lit(""))),
                          lambda v: v.try_cast("double").cast("bigint")) if has else F.array().cast("array<bigint>")
    labels = X.parse_list(F.coalesce(F.col("ld_block"), F.lit(""))) if has else F.array().cast("array<string>")
    pairs = F.arrays_zip(indices.alias("block_index"), labels.alias("block"))
    rows = df.select(key.alias("gene"), symbol.alias("symbol"), F.explode_outer(pairs).alias("b")).select(
        "gene", "symbol", F.when(F.col("b.block_index") >= 0, F.col("b.block_index")).alias("block_index"), F.col("b.block").alias("block"))
    if region is None:
        return rows
    place = X.parse_region(F.col("block"))
    inside = (place["chrom"] == region["chrom"]) & (place["end"] >= region["start"]) & (place["start"] <= region["end"])
    return rows.withColumn("in_region", F.coalesce(inside, F.lit(False)))


def reference_signs(df: DataFrame) -> DataFrame:
    """Unique ids with a sign of -1 or 1; anything else is an error."""
    require_columns(df, ["gene_id", "reference_sign"], "sign list")
    sign = F.col("reference_sign").cast("int")
    per = df.groupBy(X.gene_key(F.col("gene_id")).alias("gene")).agg(F.count(F.lit(1)).alias("c"), F.min(sign).alias("s"))
    bad = F.when(F.col("c") > 1, F.raise_error(F.lit("gene listed twice")).cast("int")).when(
        F.col("s").isin(-1, 1), F.col("s")).otherwise(F.raise_error(F.lit("sign must be -1 or 1")).cast("int"))
    return per.select("gene", bad.alias("sign"))


def reported_performance(df: DataFrame, labels: DataFrame, *, dataset: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """Reported rows of one dataset aligned to evaluated labels; two rows for a label are an error."""
    require_columns(df, ["dataset", "cell_type"], "performance table")
    key = X.canonical_label(F.col("cell_type"), aliases)
    rest = [c for c in df.columns if c not in ("dataset", "cell_type")]
    rows = df.filter(F.col("dataset") == dataset).groupBy(key.alias("k")).agg(
        F.count(F.lit(1)).alias("c"), F.first("cell_type").alias("reported_cell_type"), *[F.first(c).alias(c) for c in rest])
    checked = rows.withColumn("k", F.when(F.col("c") > 1, F.raise_error(F.lit("label reported twice"))).otherwise(F.col("k"))).drop("c")
    wanted = labels.select("cell_type", key.alias("k"))
    return wanted.join(checked, "k").drop("k")


# ---- summary statistics --------------------------------------------------------------------

@dataclass(frozen=True)
class StudyColumns:
    """Names of the columns in a summary-statistics file."""

    snp: str = "SNP"
    effect_allele: str = "A1"
    non_effect_allele: str = "A2"
    beta: str | None = None
    beta_sign: str | None = None
    odds_ratio: str | None = None
    se: str | None = None
    zscore: str | None = None
    pvalue: str | None = None

    def validate(self) -> None:
        if not any((self.zscore, self.beta, self.odds_ratio, self.beta_sign)):
            raise ValueError("name at least one of z-score, beta, odds ratio, beta sign")
        if not self.zscore and not (self.se or self.pvalue):
            raise ValueError("without a z-score, name a standard error or a p-value")


def normalise_study(df: DataFrame, columns: StudyColumns, snp_map: DataFrame | None = None, *,
                    keep_non_rsid: bool = True) -> DataFrame:
    """(snp, effect_allele, non_effect_allele, zscore, beta, pvalue).

    z = given, else beta/se, else ln(OR)/se, else the sign times the two-sided normal quantile of p.
    """
    columns.validate()

    def number(name: str | None) -> Column:
        return X.null_nan(F.col(name).try_cast("double")) if name else F.lit(None).cast("double")

    z, se, p = number(columns.zscore), number(columns.se), number(columns.pvalue)
    ratio = number(columns.odds_ratio)
    beta = F.coalesce(number(columns.beta), F.ln(F.when(ratio > 0, ratio)))
    if columns.beta_sign:
        text = F.trim(F.col(columns.beta_sign).cast("string"))
        sign = F.when(text == "+", 1.0).when(text == "-", -1.0).otherwise(F.signum(text.try_cast("double")))
    else:
        sign = F.signum(beta)
    score = F.coalesce(z, F.try_divide(beta, F.nullif(se, F.lit(0.0))), sign * norm_isf(p / 2.0))
    out = df.select(F.col(columns.snp).cast("string").alias("snp"), F.upper(F.col(columns.effect_allele)).alias("effect_allele"),
                    F.upper(F.col(columns.non_effect_allele)).alias("non_effect_allele"), score.alias("zscore"),
                    beta.alias("beta"), p.alias("pvalue"))
    if snp_map is not None:
        renamed = snp_map.select(F.col("snp").cast("string").alias("snp"), F.col("mapped").cast("string").alias("mapped"))
        out = out.join(renamed, "snp").withColumn("snp", F.col("mapped")).drop("mapped")
    if not keep_non_rsid:
        out = out.filter(F.col("snp").startswith("rs"))
    return out


def delimited(lines: DataFrame, header: Sequence[str], *, sep: str = "\t", skip_until: str | None = None) -> DataFrame:
    """Rows of each file after its header line, or after its first line that starts with ``skip_until``.

    A file without such a line is an error.
    """
    lines, plain = by_file(lines), sep.encode().decode("unicode_escape")
    mark = skip_until if skip_until is not None else plain.join(header)
    heads = lines.filter(F.col("value").startswith(mark)).groupBy("file").agg(F.min("ordinal").alias("at"))
    after = F.when(F.col("at").isNull(), F.raise_error(F.concat(F.lit("no header line in "), F.col("file"))).cast("boolean")).otherwise(
        F.col("ordinal") > F.col("at"))
    pattern = "".join("\\" + c if c in r"|.*+?()[]{}^$\\" else c for c in plain)
    return fields(lines.join(heads, "file", "left").filter(after), header, sep=pattern, comment=None).drop("ordinal")


def headers(lines: DataFrame, *, skip_until: str | None = None) -> DataFrame:
    """(header, files): the different header lines, each the first of a file or its first that starts with ``skip_until``."""
    lines = by_file(lines)
    found = lines if skip_until is None else lines.filter(F.col("value").startswith(skip_until))
    return found.groupBy("file").agg(F.min_by("value", "ordinal").alias("header")).groupBy("header").agg(
        F.count(F.lit(1)).alias("files"))


def read_study(spark: SparkSession, path: str, columns: StudyColumns, *, sep: str = "\t", file_pattern: str | None = None,
               snp_map: DataFrame | None = None, skip_until: str | None = None) -> DataFrame:
    """A file, or a folder whose file names match ``file_pattern``; lines before ``skip_until`` are passed over.

    Files whose headers differ are an error.
    """
    lines = read_lines(spark, path)
    if file_pattern:
        lines = lines.filter(F.element_at(F.split("file", "/"), -1).rlike(file_pattern))
    found = [r.header for r in headers(lines, skip_until=skip_until).limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"{'different headers in' if found else 'no header in'} {path}")
    names = found[0].split(sep.encode().decode("unicode_escape"))
    return normalise_study(delimited(lines, names, sep=sep, skip_until=skip_until or found[0]), columns, snp_map)


# ---- model weights -------------------------------------------------------------------------

_HEAD = "struct<snp_ids: array<string>, coefs: array<double>, intercept: double>"
WEIGHTS_SCHEMA = (
    "map<string, struct<snp_ids: array<string>, coefs: array<double>, chr: string, intercept: double, "
    f"mean: {_HEAD}, aleatoric: {_HEAD}, epistemic: {_HEAD}, "
    "members: array<struct<member_id: string, bootstrap_coefs: array<array<double>>>>, "
    "metadata: struct<coefficient_scale: string>>>")
RAW_SCALE = "raw_dosage"


def parse_weights(texts: DataFrame, *, draws: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, gene, chrom, draw, snp, weight, intercept, standardized) from JSON objects gene -> model.

    One row of ``texts.value`` may hold a whole model or a single gene (JSON
    lines), so large models are split over tasks. Point and probabilistic
    weights (the mean head) are standardised; ensembles are raw and, with
    ``draws``, expand to one draw per member and bootstrap. Genes without SNPs drop out.
    """
    entry = texts.select(*keys, F.explode(F.from_json("value", WEIGHTS_SCHEMA)).alias("gene", "e"))
    ensemble = F.col("e.members").isNotNull() | F.col("e.metadata").isNotNull()
    heads = F.col("e.mean").isNotNull() & F.col("e.aleatoric").isNotNull() & F.col("e.epistemic").isNotNull()
    scale = F.col("e.metadata.coefficient_scale")
    snps = F.when(ensemble, F.col("e.snp_ids")).when(heads, F.coalesce("e.snp_ids", "e.mean.snp_ids")).otherwise(F.col("e.snp_ids"))
    base = entry.select(
        *keys, "gene", F.col("e.chr").alias("chrom"), snps.alias("snps"), (~ensemble).alias("standardized"),
        F.when(heads, F.coalesce("e.mean.intercept", "e.intercept")).otherwise(F.col("e.intercept")).alias("intercept"),
        F.when(ensemble & scale.isNotNull() & (scale != RAW_SCALE),
               F.raise_error(F.concat(F.lit("unsupported coefficient scale "), scale)).cast("array<double>"))
        .when(heads, F.col("e.mean.coefs")).otherwise(F.col("e.coefs")).alias("coefs"),
        "e.members").filter(F.size("snps") > 0)
    if draws:
        member = base.select("*", F.explode("members").alias("m"))
        each = member.select("*", F.posexplode("m.bootstrap_coefs").alias("b", "draw_coefs"))
        rows = each.withColumns({"draw": F.concat_ws("_", "m.member_id", "b"), "coefs": F.col("draw_coefs")})
    else:
        rows = base.withColumn("draw", F.lit("point"))
    checked = F.when(F.size("coefs") == F.size("snps"), F.arrays_zip("snps", "coefs")).otherwise(F.raise_error(F.concat(
        F.lit("coefficient count differs from SNP count: "), F.col("gene"))).cast("array<struct<snps: string, coefs: double>>"))
    return rows.select(*keys, "gene", "chrom", "draw", "standardized", "intercept", F.explode(checked).alias("z")).select(
        *keys, "gene", "chrom", "draw", F.col("z.snps").alias("snp"), F.col("z.coefs").alias("weight"), "intercept", "standardized")


def weights_json(weights: DataFrame) -> DataFrame:
    """One JSON object per gene, readable by :func:`parse_weights`.

    A gene's entry is one record of the format, so it is gathered per gene, in SNP order.
    """
    per = weights.groupBy("gene").agg(
        F.array_sort(F.collect_list(F.struct("snp", "weight"))).alias("z"), F.max("intercept").alias("intercept"),
        F.max("chrom").alias("chr"))
    entry = F.struct(F.col("z.snp").alias("snp_ids"), F.col("z.weight").alias("coefs"), "chr", "intercept")
    return per.select("gene", F.to_json(F.create_map("gene", entry)).alias("value"))


# ---- catalogues ----------------------------------------------------------------------------

def ambiguous_labels(labels: DataFrame, *, name: str = "cell_type") -> DataFrame:
    """Folded labels that more than one name shares."""
    return labels.groupBy(X.label_key(F.col(name)).alias("key")).agg(
        F.count_distinct(name).alias("n"), F.array_sort(F.collect_set(name)).alias("names")).filter("n > 1")


def incomplete_seeds(layout: DataFrame) -> DataFrame:
    """Seeds of a model that lack cell types other seeds have; ``layout(model, seed, cell_type)``."""
    distinct = layout.select("model", "seed", "cell_type").distinct()
    seeds = distinct.groupBy("model", "seed").agg(F.count(F.lit(1)).alias("n"))
    wanted = distinct.groupBy("model").agg(F.count_distinct("cell_type").alias("n_expected"))
    return seeds.join(wanted, "model").filter("n < n_expected")


def unique_names(df: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """Suffix repeated names with _2, _3, ... in ``order``."""
    placed = row_numbers(df, [name], order, rn="__rn")
    return placed.withColumn(name, F.when(F.col("__rn") == 1, F.col(name)).otherwise(
        F.concat_ws("_", F.col(name), F.col("__rn").cast("string")))).drop("__rn")

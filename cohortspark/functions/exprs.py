"""Scalar Column builders: identifiers, parsing, guarded arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: Cap of -log10 p where p underflows (fixed value).
NEGLOG10_CAP = 320.0
#: Coefficient behind a 95 % interval (fixed value).
Z95 = 1.959963984540054


def null_nan(x: Column) -> Column:
    """NaN becomes NULL; every source applies this."""
    return F.when(~F.isnan(x), x)


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def gene_key(x: Column) -> Column:
    key = F.upper(F.trim(F.split_part(x, F.lit("."), F.lit(1))))
    return F.when((key != "") & (key != "NAN"), key)


def label_key(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")


def canonical_label(x: Column, aliases: dict[str, str] | None = None) -> Column:
    """Folded label without a trailing ``human``; then an optional alias map."""
    key = F.regexp_replace(label_key(x), "human$", "")
    if not aliases:
        return key
    pairs = [F.lit(v) for item in aliases.items() for v in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), key)


def chrom_key(x: Column) -> Column:
    key = F.regexp_replace(F.upper(F.trim(x.cast("string"))), "^CHR", "")
    return F.regexp_replace(key, r"\.0$", "")


def chrom_extract(x: Column) -> Column:
    """chr1..22, X or Y anywhere in a text, without the prefix; null if absent."""
    found = F.regexp_extract(x, r"(?i)chr([0-9]{1,2}|X|Y)(?![0-9A-Za-z])", 1)
    return F.when(found != "", F.upper(found))


def chrom_order(x: Column) -> Column:
    """Numeric chromosomes first, then text ones (sort by this, then the key)."""
    return F.coalesce(chrom_key(x).try_cast("int"), F.lit(99))


def donor_digits(x: Column) -> Column:
    found = F.regexp_extract(x, r"(\d+)$", 1)
    return F.when(found != "", found)


def prefixed_donor(x: Column, prefix: str) -> Column:
    """``x_n`` or ``n`` becomes ``prefix_n``; text without trailing digits is an error."""
    digits = donor_digits(x)
    return F.when(digits.isNotNull(), F.concat(F.lit(prefix + "_"), digits)).otherwise(
        F.raise_error(F.concat(F.lit("donor id has no trailing number: "), x)))


def doubled_donor(x: Column) -> Column:
    """True for technical copies named ``prefix_n_n``."""
    return x.rlike(r"^.*_(\d+)_\1$")


def neglog10(p: Column, cap: float = NEGLOG10_CAP) -> Column:
    positive = F.when(p > 0, p)
    return F.when(p.isNotNull(),
                  F.coalesce(F.least(-F.log10(positive), F.lit(cap)), F.lit(cap)))


def safe_log1p(x: Column) -> Column:
    return F.when(x > -1, F.log1p(F.when(x > -1, x)))


def parse_region(x: Column) -> Column:
    """``chrom:start-end`` with optional thousands commas -> struct(chrom, start, end)."""
    pattern = r"^\s*(?:chr)?([0-9A-Za-z]+)\s*:\s*([0-9,]+)\s*-\s*([0-9,]+)\s*$"

    def number(i):
        return F.regexp_replace(F.regexp_extract(x, pattern, i), ",", "").try_cast("bigint")

    chrom = F.regexp_extract(x, pattern, 1)
    return F.when(chrom != "", F.struct(
        chrom_key(chrom).alias("chrom"), number(2).alias("start"), number(3).alias("end")))


def parse_list(x: Column, sep: str = ";") -> Column:
    """Trimmed non-empty parts of a delimited text."""
    return F.filter(F.transform(F.split(x, sep), lambda v: F.trim(v)), lambda v: v != "")


def parse_bool(x: Column) -> Column:
    """true/false/yes/no or a number (non-zero is true); other text is an error."""
    text = F.lower(F.trim(x.cast("string")))
    number = text.try_cast("double")
    return (F.when(text.isNull() | text.isin("", "nan", "none"), F.lit(False))
            .when(text.isin("true", "t", "yes", "y"), True)
            .when(text.isin("false", "f", "no", "n"), False)
            .when(number.isNotNull(), number != 0)
            .otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), text))))


def gtf_attribute(attributes: Column, key: str) -> Column:
    """Value of ``key "v"`` or ``key=v`` in a ninth-column text; null if absent."""
    hit = F.regexp_extract(attributes, rf'(?:^|[;\s]){key}[ =]"?([^";]+)"?', 1)
    return F.when(hit != "", F.trim(hit))


def stage_label(x: Column) -> Column:
    return F.trim(F.split_part(x, F.lit("-"), F.lit(1)))


def file_label(x: Column) -> Column:
    """A label that is safe inside a file name."""
    return F.regexp_replace(F.trim(x), r"[^A-Za-z0-9._-]+", "_")


def natural_key(x: Column) -> Column:
    """Sortable text in which digit runs of any length compare as numbers: each is led by its number of digits."""
    parts = F.regexp_extract_all(F.lower(x), F.lit(r"(\d+|\D+)"), F.lit(1))
    plain = lambda v: F.regexp_replace(v, r"^0+(?=\d)", "")
    padded = F.transform(parts, lambda v: F.when(v.rlike(r"^\d"), F.concat(
        F.lpad(F.length(plain(v)).cast("string"), 10, "0"), plain(v))).otherwise(v))
    return F.array_join(padded, "")


def seed_for(x: Column, base: int = 0) -> Column:
    """Reproducible per-key seed: base + crc32 modulo 100000."""
    return F.lit(base) + F.crc32(x.cast("binary")) % 100000


def shuffle_order(seed: int, *ids: Column) -> Column:
    """A reproducible pseudo-random order that does not depend on partitioning: 60 bits of the MD5 of the joined texts."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(i.cast("string"), F.lit("")) for i in ids])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def clip(x: Column, low: float, high: float) -> Column:
    """Bounded value; Spark's greatest and least skip nulls, so a null must be kept apart."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson r aggregate over pairwise-complete rows, null for a constant side.

    Built from Spark's mergeable central moments: one pass, map-side combine.
    """
    both = x.isNotNull() & y.isNotNull()
    cx, cy = F.when(both, x), F.when(both, y)
    r = F.try_divide(F.covar_pop(cx, cy), F.sqrt(F.var_pop(cx) * F.var_pop(cy)))
    return clip(r, -1.0, 1.0)


def complete_count(x: Column, y: Column) -> Column:
    return F.count(F.when(x.isNotNull() & y.isNotNull(), 1))


def acat_term(p: Column) -> Column:
    """Per-row ACAT transform; average these, then apply :func:`acat_p`."""
    pi = F.lit(3.141592653589793)
    checked = F.when((p < 0) | (p > 1), F.raise_error(F.lit("ACAT needs p in [0, 1]")).cast("double")).otherwise(p)
    positive = F.when(checked > 0, checked)
    return F.when(positive < 1e-15, 1.0 / (positive * pi)).otherwise(F.tan((0.5 - positive) * pi))


def acat_p(mean_term: Column, any_zero: Column, all_one: Column) -> Column:
    pi = F.lit(3.141592653589793)
    big = F.when(mean_term > 1e15, mean_term)
    tail = (F.when(mean_term > 1e15, 1.0 / (big * pi))
            .when(mean_term < -1e15, F.lit(1.0))
            .otherwise(0.5 - F.atan(mean_term) / pi))
    return F.when(any_zero, 0.0).when(all_one, 1.0).otherwise(tail)


def acat(p: Column) -> Column:
    """Equal-weight ACAT aggregate over non-null p-values."""
    return acat_p(F.avg(acat_term(p)), F.bool_or(p == 0), F.bool_and(p == 1))


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)

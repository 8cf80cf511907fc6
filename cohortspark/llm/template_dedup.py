"""Removal of lines whose log template recurs across documents; DataFrame functions only.

The template tree has a fixed depth: a line goes by its number of tokens, then by its first `lead` tokens, to a leaf;
tokens with a digit count as a wildcard. Within a leaf that enough documents share, a token stays part of the template
where `min_docs` documents have it at its place, and generalises to the wildcard where it varies. Lines with equal
results have one template. A template that `min_docs` documents have is recurring, if at least `fixed` of its tokens
are no wildcards; its lines go from all documents but the first (smallest id), where the first line stays. A line that
`min_docs` documents have with equal tokens, digits included, is recurring whatever its share of wildcards.

Leaves and templates are counted by hash with map-side sums, once per document; only lines of shared leaves are looked
at as text, each different one once. A leaf's tokens are never gathered: they are counted as rows and joined back.

Edges: a null text stays null; lines without a token are never templates and stay. Rows without id come after all others.
Repeated rows (equal id and text) are one document. A document that loses all its lines goes, others keep every column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortspark.llm.store import stored

WILDCARD = "<*>"
LAST = (1 << 63) - 1
SPACE = r"\x20\x09-\x0D"
#: A token with a digit; it is tried where a token begins only, so long tokens cost no more than their length.
VARIABLE = rf"(?<![^{SPACE}])[^{SPACE}0-9]*+[0-9][^{SPACE}]*+"


def masked(line: Column) -> Column:
    """A line with variable tokens as wildcards and one space between tokens; lines that are so already cost no rewrite."""
    odd = line.rlike(r"[0-9\x09-\x0D]") | line.contains("  ") | line.startswith(" ") | line.endswith(" ")
    plain = F.trim(F.regexp_replace(F.regexp_replace(line, VARIABLE, WILDCARD), f"[{SPACE}]+", " "))
    return F.when(odd, plain).otherwise(line)


def n_tokens(line: Column) -> Column:
    """Tokens of a masked line: spaces and one, or none."""
    return F.when(line == "", F.lit(0)).otherwise(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def bound(value: Column, use) -> Column:
    """`use(value)` with the value worked out once, though `use` names it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def identified(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(row, id, key, text): all columns, the rank of the id, a hash of the text, and the text."""
    text = F.col(text_column).cast("string")
    return docs.select(F.struct("*").alias("row"), F.coalesce(F.col(id_column).cast("bigint"), F.lit(LAST)).alias("id"),
                       F.xxhash64(text).alias("key"), text.alias("text"))


def leaves(docs: DataFrame, lead: int) -> DataFrame:
    """One row per line with a token: (id, key, no, leaf, line, exact), the last three as hashes. exact: the line with its variable
    tokens, null where it has none, as such a line is its own template."""
    lines = docs.select("id", "key", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    lines = lines.select("id", "key", "no", F.col("line").alias("raw"), masked(F.col("line")).alias("line")).where("line <> ''")
    exact = F.when(F.col("line").contains(WILDCARD), F.xxhash64(F.trim(F.regexp_replace("raw", f"[{SPACE}]+", " "))))
    return lines.select("id", "key", "no", F.xxhash64(n_tokens(F.col("line")), F.substring_index("line", " ", lead)).alias("leaf"),
                        F.xxhash64("line").alias("line"), exact.alias("exact"))


def templates(docs: DataFrame, once: DataFrame, min_docs: int, fixed: float) -> DataFrame:
    """(leaf, line, template) of the lines with enough fixed tokens. once: (leaf, line, id, key, no), a row per document."""
    different = once.groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct("id", "key", "no")).alias("rep"))
    picks = different.groupBy("rep.id", "rep.key").agg(F.collect_list(F.struct("leaf", "line", "docs", "rep.no")).alias("picks"))
    taken = docs.join(picks, ["id", "key"]).select(bound(
        F.struct(F.split("text", "\n").alias("lines"), "picks"),
        lambda s: F.transform(s["picks"], lambda p: F.struct(
            p["leaf"].alias("leaf"), p["line"].alias("line"), p["docs"].alias("docs"),
            F.get(s["lines"], p["no"]).alias("text")))).alias("taken"))
    parsed = taken.select(F.explode("taken").alias("p")).select("p.*").dropDuplicates(["leaf", "line"])
    placed = stored(parsed.select("leaf", "line", "docs", F.posexplode(F.split(masked(F.col("text")), " ")).alias("pos", "token")))
    held = placed.where(F.col("token") != WILDCARD).groupBy("leaf", "pos", "token").agg(F.sum("docs").alias("support"))
    held = stored(held.where(F.col("support") >= min_docs).select("leaf", "pos", "token", F.lit(True).alias("held")))
    shown = placed.join(held, ["leaf", "pos", "token"], "left").withColumn(
        "token", F.when(F.col("held"), F.col("token")).otherwise(F.lit(WILDCARD)))
    summed = shown.groupBy("leaf", "line").agg(
        F.bit_xor(F.xxhash64("pos", "token")).alias("x"), F.bit_xor(F.xxhash64("token", "pos")).alias("y"),
        F.count("held").alias("held"), (F.max("pos") + 1).alias("size"))
    return summed.where(F.col("held") >= F.lit(fixed) * F.col("size")).select(
        "leaf", "line", F.xxhash64("leaf", "x", "y").alias("template"))


def beyond_first(where: DataFrame, name: str, min_docs: int) -> DataFrame:
    """(id, key, no) of the places of each name that `min_docs` documents have, without those in its first document."""
    counted = stored(where.groupBy(name, "id", "key").agg(F.lit(1).alias("one")).groupBy(name).agg(
        F.count(F.lit(1)).alias("docs"), F.min(F.struct("id", "key")).alias("first")).where(F.col("docs") >= min_docs))
    return where.join(counted, name).where(F.struct("id", "key") != F.col("first")).select("id", "key", "no")


def recurring_lines(docs: DataFrame, min_docs: int, lead: int, fixed: float) -> DataFrame:
    """(id, key, no) of the lines that go; a place may come twice."""
    lines = leaves(docs, lead)
    shared = lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("c"), *(f(x).alias(n) for x, n, f in (
        ("id", "a", F.min), ("id", "b", F.max), ("key", "x", F.min), ("key", "y", F.max))))
    shared = stored(shared.where((F.col("c") >= min_docs) & ((F.col("a") != F.col("b")) | (F.col("x") != F.col("y")))).select("leaf"))
    places = stored(lines.join(shared, "leaf"))
    once = places.groupBy("leaf", "line", "id", "key").agg(F.min("no").alias("no"))
    named = stored(templates(docs, once, min_docs, fixed))
    where = places.join(named, ["leaf", "line"]).select("template", "id", "key", "no")
    equal = places.where("exact is not null").select("exact", "id", "key", "no")
    return beyond_first(where, "template", min_docs).unionByName(beyond_first(equal, "exact", min_docs))


def drop_recurring(docs: DataFrame, min_docs: int = 3, lead: int = 3, fixed: float = 0.6, id_column: str = "doc_id",
                   text_column: str = "text") -> DataFrame:
    """The documents without their recurring lines, in the columns they came with, and `n_dropped` at the end."""
    known = identified(docs, id_column, text_column)
    gone = recurring_lines(known.select("id", "key", "text"), min_docs, lead, fixed)
    gone = gone.groupBy("id", "key").agg(F.collect_set("no").alias("gone"))
    kept = bound(F.struct(F.split("text", "\n").alias("lines"), "gone"), lambda s: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(s["lines"]) - 1), s["gone"]), lambda i: F.get(s["lines"], i)), "\n"))
    out = known.join(gone, ["id", "key"], "left").select(
        "row", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("left"),
        F.coalesce(F.size("gone"), F.lit(0)).alias("n_dropped"))
    out = out.where((F.col("n_dropped") == 0) | F.col("left").rlike(f"[^{SPACE}]"))
    return out.select(*(F.col("left").alias(c) if c == text_column else F.col("row").getField(c).alias(c) for c in docs.columns),
                      F.col("n_dropped").cast("bigint").alias("n_dropped"))

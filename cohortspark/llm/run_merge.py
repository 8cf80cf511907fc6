"""Exact duplicates by a tree-merge of sorted digest runs.

The digests of a chunk of rows make one run, sorted and without repeats; an entry holds the row that stays and the number of
rows. Runs meet in binomial rounds: in each, 2^FAN_BITS runs of a group cut their digest range into as many pieces and exchange
them, and a multiway merge makes one run of each range. A group's entries then lie in as many pieces as it has runs, so a merge
never sees more than about one run's entries, however many rows there are or share a text, and after the last round every
digest has met its likes. Entries merge only if digest, byte length and a second hash agree.

The entries of groups of several rows go back to the runs (one entry a run, so a text held by a third of all rows is no hot
key), and from there to the rows, by run and digest.

Edges: a null text counts as empty. Of rows equal in text and id, one stays. A row without an id loses to any with one; if no
row of a group has an id, one of them stays and `keep_id` is null. Very long texts are only hashed. Other columns are passed
over. An empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohortspark.llm.store import stored

#: Runs that meet in one merge, as a power of two.
FAN_BITS = 5
#: Rows that a run holds at most, as a power of two; a task's row numbers have 33 bits.
RUN_BITS, ROW_BITS = 18, 33
#: Bytes of a digest with its two checks.
WIDTH = 48
ENTRY = "digest binary, id bigint, tag bigint, size bigint"


def verified_digest(text: Column) -> Column:
    """SHA-256 with byte length and a second hash, so that entries merge only where all three agree."""
    number = lambda x: F.unhex(F.lpad(F.hex(x.cast("bigint")), 16, "0"))
    return F.concat(F.unhex(F.sha2(text, 256)), number(F.octet_length(text)), number(F.xxhash64(text)))


def digest_rows(docs: DataFrame, id_column: str, text_column: str, run_bits: int) -> tuple[DataFrame, int]:
    """(digest, id, tag, size, run), one row per document, and the number of runs. `tag` numbers the rows.

    Written once: a second look at `docs` may number its rows otherwise.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = stored(docs.select(verified_digest(text).alias("digest"), F.col(id_column).cast("bigint").alias("id"),
                              F.monotonically_increasing_id().alias("tag"), F.lit(1).cast("bigint").alias("size")))
    task = F.shiftright("tag", ROW_BITS)
    chunk = F.shiftright(F.col("tag").bitwiseAND((1 << ROW_BITS) - 1), run_bits)
    last = rows.agg(F.coalesce(F.max(task), F.lit(0)).alias("task"), F.coalesce(F.max(chunk), F.lit(0)).alias("chunk")).first()
    return rows.withColumn("run", task * (last.chunk + 1) + chunk), (last.task + 1) * (last.chunk + 1)


def merged(entries: pa.Table, largest: bool) -> pa.Table:
    """One run of the given ones: per digest the row that stays and the sum of sizes, in the order of digests.

    Of equal digests the largest (or smallest) id stays, a missing one only if there is no other, then the smallest tag.
    """
    if not entries.num_rows:
        return entries.select(["digest", "id", "tag", "size"])
    digest = entries.column("digest").cast(pa.binary(WIDTH)).combine_chunks()
    keys = np.frombuffer(digest.buffers()[1], f"S{WIDTH}", len(digest), digest.offset * WIDTH)
    ids = entries.column("id")
    lacking, value = ids.is_null().to_numpy(), ids.fill_null(0).to_numpy()
    tag, size = entries.column("tag").to_numpy(), entries.column("size").to_numpy()
    # The stable sort takes sorted stretches as they are, so this is a multiway merge of the runs.
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(order)]))
    stays = order[np.lexsort((tag[order], ~value[order] if largest else value[order], lacking[order], group))][first]
    kept = entries.select(["digest", "id", "tag"]).take(pa.array(stays))
    return kept.append_column("size", pa.array(np.add.reduceat(size[order], first)))


def exchange(entries: DataFrame, level: int, largest: bool, fan_bits: int) -> DataFrame:
    """One round: runs of a group trade pieces of their digest ranges; (digest, id, tag, size, run), `run` the group."""
    prefix = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("bigint")
    piece = F.shiftright(prefix, 56 - fan_bits * level)

    def meet(key: tuple, pieces: pa.Table) -> pa.Table:
        out = merged(pieces, largest)
        return out.append_column("run", pa.array(np.full(out.num_rows, key[0].as_py())))

    return (entries.withColumn("run", F.shiftright("run", fan_bits)).withColumn("piece", piece)
            .groupBy("run", "piece").applyInArrow(meet, ENTRY + ", run bigint"))


def groups(rows: DataFrame, n_runs: int, largest: bool, fan_bits: int = FAN_BITS) -> tuple[DataFrame, DataFrame]:
    """(entries of the runs, entries of all rows): `digest`, the row that stays (`id`, `tag`) and `size`, the runs' with `run`."""
    def own(key: tuple, run: pa.Table) -> pa.Table:
        out = merged(run, largest)
        return out.append_column("run", pa.array(np.full(out.num_rows, key[0].as_py())))

    runs = stored(rows.groupBy("run").applyInArrow(own, ENTRY + ", run bigint"))
    top, level = runs, 0
    while (1 << fan_bits * level) < n_runs:
        level += 1
        top = exchange(top, level, largest, fan_bits)
    return runs, top.drop("run")


def copies(docs: DataFrame, keep: str = "largest", id_column: str = "doc_id", text_column: str = "text", fan_bits: int = FAN_BITS,
           run_bits: int = RUN_BITS) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256): one row per document, the dropped ones too."""
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    rows, n_runs = digest_rows(docs, id_column, text_column, run_bits)
    runs, top = groups(rows, n_runs, keep == "largest", fan_bits)
    several = stored(top.where("size > 1")).select("digest", F.col("id").alias("keep_id"), F.col("tag").alias("keep_tag"),
                                                  F.col("size").alias("group_size"))
    answers = stored(runs.select("run", "digest").join(several, "digest"))
    found = rows.drop("size").join(answers, ["run", "digest"], "left")
    alone = F.col("group_size").isNull()
    return found.select(F.col("id").alias(id_column), F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
                        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
                        (alone | (F.col("tag") == F.col("keep_tag"))).alias("kept"),
                        F.lower(F.hex(F.substring("digest", 1, 32))).alias("text_sha256"))


def drop_copies(docs: DataFrame, keep: str = "largest", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows of `docs` that stay, with all their columns. Of rows equal in text and id an arbitrary one stays."""
    stays = copies(docs, keep, id_column, text_column).where("kept").select(F.col(id_column).alias("__id"), F.col("text_sha256").alias("__digest"))
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    marked = docs.withColumn("__id", F.col(id_column).cast("bigint")).withColumn("__digest", F.sha2(text, 256))
    same = (F.col("d.__id").eqNullSafe(F.col("s.__id"))) & (F.col("d.__digest") == F.col("s.__digest"))
    return marked.alias("d").join(stays.alias("s"), same, "left_semi").dropDuplicates(["__id", "__digest"]).drop("__id", "__digest")

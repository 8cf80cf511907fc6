"""N-gram Jaccard join by a blocked sparse product of the document by n-gram incidence matrix.

Equal sets are collapsed to one row of the matrix. Rows that can link are brought together first: the hashed n-grams of a set
are sorted, and each two neighbours among its `SKETCH` smallest are a key. Of the union's smallest n-grams at least
80 in 100 are common to two linked sets, so common neighbours exist: always in sets of up to `SKETCH` n-grams, and with
a chance of a miss under 1e-18 in larger ones, less than that of two n-grams with one 64-bit hash. Components over
shared keys are then independent blocks of the product. A common passage chains many sets, so a component larger than a
block is taken apart by a second kind of key: of a set's rarest n-grams, as many as a link may leave out and one more. In one
order for all sets, two linked sets have one of these in common, and few sets that do not link do. A block's product is
taken tile by tile over column blocks; columns with one entry are left out, tiles and pairs whose sizes rule out the
threshold are passed over, and overlap counts are compared with the exact bound. What is still larger than a block is cut
into parts, and each two parts are a block.

Edges: null, empty and wordless texts have no n-grams and link with nothing, themselves their component. Shorter texts are
one n-gram. Rows that share an id are one vertex; rows without id take part, and get the component's smallest id or null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortspark.llm import passages as ps, wordkit as wk
from cohortspark.llm.components import components
from cohortspark.llm.store import stored

SKETCH = 64
#: Entries (n-grams of all sets) and sets that one block of the product may hold.
BLOCK_ENTRIES, BLOCK_SETS = 1_500_000, 4_000
TILE, COLUMNS = 512, 4_096


def sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each row without repeats, rising within the row, and where each row begins."""
    w = wk.words(data, offsets)
    sums, n = wk.running(w.hashes(wk.LOWER[data])), np.diff(w.first)
    at = wk.spread(w.first[:-1], np.where(n > 0, np.maximum(n - size + 1, 1), 0))
    row = np.searchsorted(w.first, at, "right") - 1
    code = wk.span_hash(sums, at, np.minimum(at + size, w.first[row + 1]))
    order = np.argsort(code)
    order = order[np.argsort(row[order].astype(np.uint16 if len(n) < 65536 else np.int64), kind="stable")]
    code, row = code[order], row[order]
    new = np.r_[True, (code[1:] != code[:-1]) | (row[1:] != row[:-1])] if len(code) else np.zeros(0, bool)
    code, row = code[new], row[new]
    return code, np.searchsorted(row, np.arange(len(n) + 1))


def totals(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    return (sums[first[1:]] - sums[first[:-1]]).view(np.int64)


def signatures(code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set."""
    return totals(wk.mix(code ^ np.uint64(0x5851F42D4C957F2D)), first), totals(wk.mix(code ^ np.uint64(0x14057B7EF767814F)), first)


def described(docs: DataFrame, size: int) -> DataFrame:
    """(doc, id, key, n, s, t): number of n-grams and the two signatures of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in wk.portions(batches):
            code, first = sets(*wk.text_bytes(part.column("text")), size)
            s, t = signatures(code, first)
            yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("id"), part.column("key"), pa.array(np.diff(first)), pa.array(s),
                                              pa.array(t)], ["doc", "id", "key", "n", "s", "t"])

    return docs.mapInArrow(run, "doc bigint, id bigint, key bigint, n bigint, s bigint, t bigint")


def neighbours(docs: DataFrame, size: int) -> DataFrame:
    """(pair, s): keys of each set, once per batch for equal sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in wk.portions(batches):
            code, first = sets(*wk.text_bytes(part.column("text")), size)
            s, t = signatures(code, first)
            _, once = np.unique(np.stack([s, t]), axis=1, return_index=True)
            n = np.maximum(np.minimum(np.diff(first)[once], SKETCH) - 1, 0)
            at = wk.spread(first[once], n)
            pair = wk.mix(code[at] * np.uint64(3) + wk.mix(code[at + 1])) if len(at) else code[:0]
            yield pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), pa.array(np.repeat(s[once], n))], ["pair", "s"])

    return docs.mapInArrow(run, "pair bigint, s bigint")


def together(keys: DataFrame) -> DataFrame:
    """(s, near): sets that share a key with another, and the component over shared keys. keys: (pair, s)."""
    shared = stored(keys.groupBy("pair").agg(F.min("s").alias("a"), F.max("s").alias("b")).where("a <> b").select("pair", "a"))
    near = components(keys.join(shared, "pair").where("s <> a").select(F.col("s").alias("u"), F.col("a").alias("v")))
    return near.select(F.col("u").alias("s"), F.col("v").alias("near")).unionByName(near.select(F.col("v").alias("s"), F.col("v").alias("near")).distinct())


def entries(texts: DataFrame, size: int) -> DataFrame:
    """(s, t, n, pair): the hashed n-grams of sets. texts: (s, t, n, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, some in ps.unpacked(batches):
            code, first = sets(*wk.text_bytes(pa.array(some, pa.large_binary())), size)
            row = np.repeat(np.arange(len(some)), np.diff(first))
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(row)) for c in ("s", "t", "n")), pa.array(code.view(np.int64))],
                                             ["s", "t", "n", "pair"])

    return texts.select("s", "t", "n", "packed").mapInArrow(run, "s bigint, t bigint, n bigint, pair bigint")


def rarest(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(pair, s): n-grams of which two linked sets share one: as many of a set's rarest as a link may leave out, and one more.

    Those in one set are no keys, but the first in order."""
    every = entries(texts, size)
    held = stored(every.groupBy("pair").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    common = every.join(held, "pair").groupBy("s", "t", "n").agg(F.sort_array(F.collect_list(F.struct("df", "pair"))).alias("common"))
    wanted = F.expr(f"cast(n - ceil({percent} * n / 100) + 1 - (n - size(common)) as int)")
    return common.select("s", F.explode(F.slice("common", F.lit(1), F.greatest(wanted, F.lit(0)))).alias("c")).select(F.col("c.pair").alias("pair"), "s")


def linked_tiles(code: np.ndarray, first: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int):
    """Links of the sets `left` with the sets `right` (indices): for each two tiles, their indices and the link matrix."""
    n = np.diff(first)
    column, df = np.unique(code, return_inverse=True, return_counts=True)[1:]
    place = np.cumsum(df > 1) - 1
    width = int(place[-1]) + 1 if len(place) else 0
    same = left is right

    def tiles(chosen: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        chosen = chosen[np.argsort(n[chosen], kind="stable")]
        out = []
        for lo in range(0, len(chosen), TILE):
            some = chosen[lo:lo + TILE]
            at = wk.spread(first[some], n[some])
            row = np.repeat(np.arange(len(some)), n[some])
            keep = df[column[at]] > 1
            out.append((some, row[keep], place[column[at[keep]]]))
        return out

    def dense(tile, lo: int) -> np.ndarray:
        _, row, col = tile
        inside = (col >= lo) & (col < lo + COLUMNS)
        matrix = np.zeros((len(tile[0]), min(COLUMNS, width - lo)), np.float32)
        matrix[row[inside], col[inside] - lo] = 1
        return matrix

    rows = tiles(left)
    columns = rows if same else tiles(right)
    for i, a in enumerate(rows):
        for j, b in enumerate(columns):
            low, high = sorted(((n[a[0][0]], n[a[0][-1]]), (n[b[0][0]], n[b[0][-1]])))
            if (same and j < i) or percent * high[0] > 100 * low[1]:
                continue
            shared = np.zeros((len(a[0]), len(b[0])), np.float32)
            used = np.intersect1d(a[2] // COLUMNS, b[2] // COLUMNS)
            for block in used:
                shared += dense(a, block * COLUMNS) @ dense(b, block * COLUMNS).T
            union = n[a[0]][:, None] + n[b[0]][None, :] - shared
            yield a[0], b[0], 100 * shared >= percent * union


def product(members: DataFrame, size: int, percent: int) -> DataFrame:
    """(label, root, links): for each set of a block, the smallest label it reaches in the block, and its links there.

    members: (block, side, label, copies, packed); side 0 and 1 are linked with each other, side 2 within itself."""

    def block(rows: list[dict], expand) -> tuple[list, list, list]:
        texts = [expand(r["packed"]) for r in rows]
        code, first = sets(*wk.text_bytes(pa.array(texts, pa.large_binary())), size)
        label, copies = np.array([r["label"] for r in rows]), np.array([r["copies"] for r in rows])
        side = np.array([r["side"] for r in rows])
        if side[0] == 2:
            left = right = np.arange(len(rows))
        else:
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found = list(linked_tiles(code, first, left, right, percent)) if len(left) and len(right) else []
        root, links, moved = label.copy(), np.zeros(len(rows), np.int64), True
        for a, b, link in found:
            if a is b:
                np.fill_diagonal(link, False)
            links[a] += link @ copies[b]
            if a is not b:
                links[b] += copies[a] @ link
        while moved:
            before = root.copy()
            for a, b, link in found:
                root[a] = np.minimum(root[a], np.where(link, root[b][None, :], ps.LAST).min(axis=1))
                root[b] = np.minimum(root[b], np.where(link, root[a][:, None], ps.LAST).min(axis=0))
            moved = bool((root != before).any())
        return label.tolist(), root.tolist(), links.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand, rows, out = ps.zstandard.ZstdDecompressor().decompress, [], ([], [], [])

        def finish() -> None:
            seen, once = set(), []
            for r in rows:
                if (r["side"], r["s"], r["t"]) not in seen:
                    seen.add((r["side"], r["s"], r["t"]))
                    once.append(r)
            for values, more in zip(out, block(once, expand)):
                values.extend(more)

        for part in batches:
            for row in part.to_pylist():
                if rows and rows[-1]["block"] != row["block"]:
                    finish()
                    rows = []
                rows.append(row)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], ["label", "root", "links"])
                out = ([], [], [])
        if rows:
            finish()
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], ["label", "root", "links"])

    together = members.repartition("block").sortWithinPartitions("block")
    return together.select("block", "side", "s", "t", "label", "copies", "packed").mapInArrow(run, "label bigint, root bigint, links bigint")


def join(docs: DataFrame, size: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text",
         block_entries: int = BLOCK_ENTRIES, block_sets: int = BLOCK_SETS) -> DataFrame:
    """(id, n_shingles, component_id, n_links): number of n-grams, smallest id reachable by links, linked documents."""
    given = ps.with_key(docs, id_column, text_column)
    every = stored(described(given, size))
    full = every.where("n > 0")
    # rows without an id: a label beyond all ids, from the set
    label = F.when(F.col("doc").isNull(), F.lit(1 << 62) + F.shiftrightunsigned(F.col("s"), 2)).otherwise(F.col("id"))
    classes = stored(full.withColumn("label", label).groupBy("s", "t").agg(
        F.min("label").alias("label"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.min(F.struct("id", "key")).alias("rep")))
    members = classes.join(together(neighbours(given, size)), "s")

    def cut(members: DataFrame) -> DataFrame:
        weight = members.groupBy("near").agg(F.sum("n").alias("entries"), F.count(F.lit(1)).alias("sets"))
        half = F.greatest(F.ceil(F.col("entries") * 2 / block_entries), F.ceil(F.col("sets") * 2 / block_sets))
        parts = F.when((F.col("entries") <= block_entries) & (F.col("sets") <= block_sets), F.lit(1)).otherwise(half).cast("int")
        return members.join(weight.select("near", parts.alias("parts")), "near")

    squeezed = ps.packed(given).select("id", "key", "packed")
    named = cut(members).select("rep.*", "s", "t", "n", "label", "copies", "near", "parts")
    texts = stored(squeezed.join(named, ["id", "key"]).drop("id", "key"))
    small, large = texts.where("parts = 1"), texts.where("parts > 1").drop("near", "parts")
    if not large.isEmpty():
        finer = cut(large.drop("packed").join(together(rarest(large, size, percent)), "s"))
        small = small.unionByName(large.join(finer.select("s", "t", "near", "parts"), ["s", "t"]))
    own = F.pmod(F.col("t"), F.col("parts")).cast("int")
    places = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.struct(
        F.xxhash64("near", F.least(own, other), F.greatest(own, other)).alias("block"),
        F.when(own == other, 2).when(own < other, 0).otherwise(1).alias("side")))
    filled = small.select("packed", "s", "t", "label", "copies", F.explode(places).alias("p")).select("packed", "s", "t", "label", "copies", "p.*")
    found = stored(product(filled, size, percent))
    final = components(found.where("root <> label").select(F.col("label").alias("u"), F.col("root").alias("v")))
    linked = found.groupBy("label").agg(F.sum("links").alias("links"))
    done = classes.join(linked, "label", "left").join(final.select(F.col("u").alias("label"), F.col("v").alias("root")), "label", "left")
    done = done.select("s", "t", F.coalesce("root", "label").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = every.join(done, ["s", "t"], "left")
    root = F.when(F.col("root") >= 1 << 62, F.lit(None)).otherwise(F.col("root"))
    return out.select(F.col("doc").alias(id_column), F.col("n").alias("n_shingles"),
                      F.when(F.col("n") == 0, F.col("doc")).otherwise(root).alias("component_id"),
                      F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents of which each component keeps the one with the smallest id; of repeated ids all rows of that id,
    and rows without id always. Rows without n-grams stay."""
    found = join(docs.select("doc_id", "text"), size, percent)
    lost = found.where("component_id <> doc_id").select(F.col("doc_id").alias("lost")).distinct()
    return docs.join(lost, docs["doc_id"] == lost["lost"], "left_anti")

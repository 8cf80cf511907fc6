"""Repeated windows of a corpus: which fixed-length runs of units (words or bytes) occur elsewhere.

Every window of `window` units has one anchor: its smallest hashed gram of `gram` units, the leftmost on ties. The
windows of an anchor are neighbours, and together they are the anchor's passage. Equal windows have equal anchors at
equal offsets, so whatever can match meets in one group of passages, and text whose anchors never repeat is left
behind before any text moves. Equal passages of an anchor are collapsed first. A group of more than `GROUP` different
passages is divided: windows are sorted by the anchor's place in them into classes, and the part that all windows of a
class share is their new, longer anchor. At the last division a class is one window, so its group is one passage.

What happens inside a group is the caller's `compare`. Shuffles carry (anchor, passage) keys, then the passages of
repeated anchors, then spans; texts move compressed, keyed by document, never grouped by content.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame, functions as F

from cohortspark.llm import wordkit as wk
from cohortspark.llm.store import bounded_batches, stored

#: Different passages that one anchor's group may hold before it is divided.
GROUP = 400
#: Rank of documents without id: after all others.
LAST = (1 << 63) - 1
#: Windows that are given their anchors at once.
PIECE = 4 << 20


@dataclass(frozen=True)
class Unit:
    """What a window counts, and how long windows and grams are."""

    name: str
    window: int
    gram: int

    @property
    def classes(self) -> list[int]:
        """Windows of an anchor that stay together, at each division."""
        whole = self.window - self.gram + 1
        return [whole, max(1, whole // 8), 1]

    def table(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Running hash sums over units, first unit of each row, and the byte range of each unit."""
        if self.name == "word":
            w = wk.words(data, offsets)
            return wk.running(w.hashes()), w.first, w.start, w.stop
        place = np.arange(len(data) + 1)
        return wk.running(wk.BYTE_CODE[data]), offsets, place[:-1], place[1:]


def owners(sums: np.ndarray, first: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor position, first window and number of windows, for each anchor of the rows that begin at `first`."""
    length, width = unit.window, unit.window - unit.gram + 1
    starts = wk.spread(first[:-1], np.maximum(np.diff(first) - length + 1, 0))
    if not len(starts):
        return starts, starts, starts
    grams = wk.gram_hash(sums, unit.gram)
    own = np.empty(len(grams) - width + 1, np.int64)
    low = np.uint64((1 << 24) - 1)
    for lo in range(0, len(own), PIECE):
        part = grams[lo:min(lo + PIECE, len(own)) + width - 1]
        code = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        own[lo:lo + PIECE] = (wk.window_min(code, width) & low).astype(np.int64) + lo
    own = own[starts]
    begin = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)])
    return own[begin], starts[begin], np.diff(np.r_[begin, len(starts)])


def keys(sums: np.ndarray, anchor: np.ndarray, start: np.ndarray, count: np.ndarray, unit: Unit, size: int):
    """Passages divided into classes of `size` windows: index of the passage, first window, windows, and both hashes."""
    lead = anchor - start
    high, low = lead // size, (lead - count + 1) // size
    index = np.repeat(np.arange(len(anchor)), high - low + 1)
    group = high[index] - (np.arange(len(index)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1))
    begin = np.maximum(anchor[index] - (group + 1) * size + 1, start[index])
    stop = np.minimum(anchor[index] - group * size, start[index] + count[index] - 1)
    core = wk.span_hash(sums, anchor[index] - group * size, anchor[index] - (group + 1) * size + 1 + unit.window)
    whole = wk.span_hash(sums, begin, stop + unit.window)
    anchors = wk.mix(core + group.astype(np.uint64))
    return index, begin, stop - begin + 1, anchors, wk.mix(whole ^ (anchor[index] - begin).astype(np.uint64))


def with_key(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Documents as (doc, id, key, text): the given id, its rank, and a hash that tells apart texts under one id."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return bounded_batches(docs).select(F.col(id_column).cast("bigint").alias("doc"),
                       F.coalesce(F.col(id_column).cast("bigint"), F.lit(LAST)).alias("id"),
                       F.xxhash64(text).alias("key"), text.alias("text"))


def anchors(docs: DataFrame, unit: Unit) -> DataFrame:
    """One row per anchor: (id, key, anchor, seg, at, lead, wins)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in wk.portions(batches):
            sums, first, _, _ = unit.table(*wk.text_bytes(part.column("text")))
            anchor, start, count = owners(sums, first, unit)
            _, _, _, a, s = keys(sums, anchor, start, count, unit, unit.classes[0])
            row = np.searchsorted(first, start, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(pa.array(row)), part.column("key").take(pa.array(row)), pa.array(a.view(np.int64)),
                 pa.array(s.view(np.int64)), pa.array(start - first[row]), pa.array((anchor - start).astype(np.int32)),
                 pa.array(count.astype(np.int32))], ["id", "key", "anchor", "seg", "at", "lead", "wins"])

    return docs.select("id", "key", "text").mapInArrow(
        run, "id bigint, key bigint, anchor bigint, seg bigint, at bigint, lead int, wins int")


def packed(docs: DataFrame) -> DataFrame:
    """Texts compressed row by row, for shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for part in wk.portions(batches):
            small = [squeeze(t.as_py().encode()) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("id"), part.column("key"), pa.array(small, pa.binary())],
                                             ["doc", "id", "key", "packed"])

    return docs.select("doc", "id", "key", "text").mapInArrow(run, "doc bigint, id bigint, key bigint, packed binary")


def unpacked(batches: Iterator[pa.RecordBatch], limit: int = wk.PORTION) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Portions of rows with their texts."""
    for batch in batches:
        expand, texts, size, start = zstandard.ZstdDecompressor().decompress, [], 0, 0
        for i, small in enumerate(batch.column("packed")):
            texts.append(expand(small.as_py()))
            size += len(texts[-1])
            if size >= limit or i == batch.num_rows - 1:
                yield batch.slice(start, len(texts)), texts
                start, texts, size = i + 1, [], 0


PASSAGE = ("anchor bigint, seg bigint, n bigint, lo bigint, hi bigint, id bigint, key bigint, at bigint, lead int, wins int, "
           "hot boolean")


def cut(documents: DataFrame, unit: Unit) -> DataFrame:
    """Passages with their text, from documents with the list `picks` of passages to take from them."""
    names = [c.split()[0] for c in PASSAGE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in unpacked(batches):
            picks = part.column("picks")
            data, offsets = wk.text_bytes(pa.array(texts, pa.large_binary()))
            _, first, start, stop = unit.table(data, offsets)
            rows = pa.RecordBatch.from_struct_array(picks.flatten())
            row = np.repeat(np.arange(len(picks)), pa.compute.list_value_length(picks).to_numpy())
            begin = first[row] + rows.column("at").to_numpy()
            end = begin + rows.column("wins").to_numpy() + unit.window - 2
            whole = data.tobytes()
            passages = [whole[a:b] for a, b in zip(start[begin].tolist(), stop[end].tolist())]
            for lo in range(0, len(passages), 8192):
                some = rows.slice(lo, 8192)
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names), pa.array(passages[lo:lo + 8192], pa.binary())],
                                                 [*names, "passage"])

    return documents.mapInArrow(run, f"{PASSAGE}, passage binary")


def divide(rows: DataFrame, unit: Unit, size: int) -> DataFrame:
    """Passages of hot anchors divided into classes of `size` windows; (anchor0, seg0, shift) tell what they are part of."""
    names = ["anchor", "seg", "anchor0", "seg0", "shift", "n", "lo", "hi", "id", "key", "at", "lead", "wins", "passage"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in wk.portions(batches, "passage", 1 << 20):
            data, offsets = wk.text_bytes(part.column("passage"))
            sums, first, begin, end = unit.table(data, offsets)
            start, lead = first[:-1], part.column("lead").to_numpy().astype(np.int64)
            index, at, count, a, s = keys(sums, start + lead, start, part.column("wins").to_numpy().astype(np.int64), unit, size)
            whole, take = data.tobytes(), pa.array(index)
            text = [whole[x:y] for x, y in zip(begin[at].tolist(), end[at + count + unit.window - 2].tolist())]
            shift = at - start[index]
            columns = {c: part.column(c).take(take) for c in ("n", "lo", "hi", "id", "key")}
            columns |= {"anchor": pa.array(a.view(np.int64)), "seg": pa.array(s.view(np.int64)), "anchor0": part.column("anchor").take(take),
                        "seg0": part.column("seg").take(take), "shift": pa.array(shift.astype(np.int32)),
                        "at": pa.array(part.column("at").to_numpy()[index] + shift), "lead": pa.array((lead[index] - shift).astype(np.int32)),
                        "wins": pa.array(count.astype(np.int32)), "passage": pa.array(text, pa.binary())}
            for lo in range(0, len(index), 8192):
                yield pa.RecordBatch.from_arrays([columns[c].slice(lo, 8192) for c in names], names)

    return rows.mapInArrow(run, "anchor bigint, seg bigint, anchor0 bigint, seg0 bigint, shift int, n bigint, lo bigint, hi bigint, "
                                "id bigint, key bigint, at bigint, lead int, wins int, passage binary")


Compare = Callable[[DataFrame], DataFrame]
FOUND = ["anchor", "seg", "shift", "n", "id0", "key0", "at0", "least", "found"]


def settle(rows: DataFrame, unit: Unit, compare: Compare, fields: list[str], group: int, level: int = 0) -> DataFrame:
    """What `compare` finds for each passage, with hot groups divided until they fit.

    rows: one per different passage of an anchor, with `hot`. Result: (anchor, seg, least, pieces), one row for each passage
    of which something was found. `compare` gives columns `FOUND`, and a piece has the named fields of them: `found`
    describes the windows from `shift` on, n is how often these windows stand together in the corpus, and (id0, key0, at0)
    is the first such place. A divided passage has several pieces, at most one for each of its windows.
    """
    done = compare(rows.where(~F.col("hot")).drop("hot")).select("anchor", "seg", "least", F.array(F.struct(*fields)).alias("pieces"))
    if level + 1 == len(unit.classes) or rows.where("hot").isEmpty():
        return done
    parts = stored(divide(rows.where("hot"), unit, unit.classes[level + 1]))
    one = parts.groupBy("anchor", "seg").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.min(F.struct("id", "key", "at", "lead", "wins", "passage")).alias("rep")).select("anchor", "seg", "n", "lo", "hi", "rep.*")
    count = one.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total")).where("total > 1")
    last = level + 2 == len(unit.classes)
    inner = stored(one.join(count, "anchor").withColumn("hot", F.lit(False) if last else F.col("m") > group).drop("m", "total"))
    found = settle(inner, unit, compare, fields, group, level + 1)
    whole = parts.select("anchor", "seg", "anchor0", "seg0", F.col("shift").alias("moved")).join(found, ["anchor", "seg"])
    moved = F.transform("pieces", lambda p: p.withField("shift", (p["shift"] + F.col("moved")).cast("int")))
    joined = whole.groupBy("anchor0", "seg0").agg(F.min("least").alias("least"), F.flatten(F.collect_list(moved)).alias("pieces"))
    return done.unionByName(joined.withColumnsRenamed({"anchor0": "anchor", "seg0": "seg"}))


def matches(docs: DataFrame, unit: Unit, compare: Compare, other_documents: bool, keep_hit, fields: list[str], group: int = GROUP) -> DataFrame:
    """Documents as (doc, id, packed, hits): for each, the passages of which `compare` found something.

    docs: as of `with_key`. other_documents: only anchors in two documents with different ids matter, else any two
    places. keep_hit: condition on a hit, over the columns id and least (the smallest of the passage's pieces). A hit has
    the place `at` of the passage and its `pieces`, each with the named fields of `FOUND`. What is joined to places is written
    first or comes by a plain shuffle, so that Spark can split the places of a hot anchor.
    """
    seen = anchors(docs, unit)
    repeated = stored(seen.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("l"), F.max("id").alias("h")).where(
        "l <> h" if other_documents else "c > 1").select("anchor"))
    places = stored(seen.join(repeated, "anchor"))
    one = places.groupBy("anchor", "seg").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"),
        F.min(F.struct("id", "key", "at", "lead", "wins")).alias("rep"))
    large = one.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > group).select("anchor", F.lit(True).alias("large"))
    chosen = one.join(large, "anchor", "left").select("anchor", "seg", "n", "lo", "hi", F.coalesce("large", F.lit(False)).alias("hot"), "rep.*")
    squeezed = packed(docs)
    taken = F.struct("anchor", "seg", "n", "lo", "hi", "id", "key", "at", "lead", "wins", "hot")
    picks = chosen.groupBy("id", "key").agg(F.collect_list(taken).alias("picks"))
    rows = stored(cut(squeezed.join(picks, ["id", "key"]).select("packed", "picks"), unit))
    spans = places.join(settle(rows, unit, compare, fields, group), ["anchor", "seg"]).where(keep_hit).groupBy("id", "key").agg(
        F.collect_list(F.struct("at", "pieces")).alias("hits"))
    return squeezed.join(spans, ["id", "key"], "left").select("doc", "id", "key", "packed", "hits")


def grouped(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[dict]]:
    """Rows sorted by (anchor, seg) as lists that end where an anchor ends, of about `limit` passage bytes; rows that
    repeat a passage are passed over."""
    held, size, last = [], 0, None
    for batch in batches:
        for row in batch.to_pylist():
            name = (row["anchor"], row["seg"])
            if name == last:
                continue
            if size >= limit and last is not None and last[0] != name[0]:
                yield held
                held, size = [], 0
            held.append(row)
            size += len(row["passage"])
            last = name
    if held:
        yield held


def together(rows: DataFrame) -> DataFrame:
    """Rows of one anchor side by side in one partition."""
    return rows.repartition("anchor").sortWithinPartitions("anchor", "seg")

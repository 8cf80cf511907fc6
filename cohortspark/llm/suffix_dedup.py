"""Removal of repeated byte runs by longest-previous-factor arrays over suffix arrays.

Passages that share an anchor (see `passages`) meet in shards of bounded size; a shard's text is its passages in corpus
order. Positions are ranked by their next 8, 24, 72, ... bytes, each rank from three shorter ones, down to the
wanted length, which gives the suffix order to that depth. In it, the previous and next smaller positions of a suffix
are the places of its earlier matches, the previous and next larger ones those of later matches; equal rank to full
depth is a match of full length. `keep="first"` removes bytes with an earlier match, `keep="none"` those with any.
Passages that occur several times are ranked once; a place that is not their first has an earlier match by that.

Edges: null and empty texts count as no bytes. Texts shorter than `length` stay whole. Matches may overlap and may lie in
one document, never across two. Repeated rows are copies of each other, but with `keep="first"` rows equal in id and text
are one document. Other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortspark.llm import passages as ps, wordkit as wk

#: Passage bytes that a shard holds before it ends with the next anchor; ranks must stay below 2^21.
STEP = 900_000
EARLIER, LATER = 1, 2


def dense(codes: np.ndarray) -> np.ndarray:
    """Rank of each code among the different codes."""
    order = np.argsort(codes)
    ranks = np.empty(len(codes), np.int64)
    ordered = codes[order]
    ranks[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
    return ranks


def tripled(ranks: np.ndarray, length: int, depth: int) -> np.ndarray:
    """Ranks by the next `depth` bytes from ranks by the next `length`, length < depth <= 3 * length; two or three parts
    that may overlap. Positions too close to the end for `depth` are left out."""
    n = len(ranks) + length - depth
    if depth <= 2 * length:
        return dense(ranks[:n] << 21 | ranks[depth - length:depth - length + n])
    return dense(ranks[:n] << 42 | ranks[length:length + n] << 21 | ranks[depth - length:depth - length + n])


def ranks_to_depth(text: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each position by its next `depth` bytes (depth >= 8), for the positions that have so many."""
    if len(text) < depth:
        return np.zeros(0, np.int64)
    padded = text.astype(np.uint64)
    code = np.zeros(len(text) - 7, np.uint64)
    for i in range(8):
        code = code << np.uint64(8) | padded[i:len(text) - 7 + i]
    ranks, length = dense(code), 8
    while length < depth:
        ranks, length = tripled(ranks, length, min(depth, 3 * length)), min(depth, 3 * length)
    return ranks


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest place before it with a smaller value, -1 if none; all places jump at once."""
    at = np.arange(len(values)) - 1
    open_ = np.flatnonzero(at >= 0)
    while len(open_):
        open_ = open_[values[at[open_]] > values[open_]]
        at[open_] = at[at[open_]]
        open_ = open_[at[open_] >= 0]
    return at


def neighbours(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of a suffix order, the previous and the next place with a smaller position; -1 if none."""
    before = nearest_smaller(order)
    after = nearest_smaller(order[::-1])[::-1]
    return before, np.where(after >= 0, len(order) - 1 - after, -1)


def full_matches(ranks: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """EARLIER and LATER flags of the given rising positions, by full-depth rank."""
    own = ranks[positions]
    order = np.lexsort((positions, own))
    sorted_rank = own[order]
    flags = np.zeros(len(positions), np.int8)
    for places, flag in ((order, EARLIER), (len(order) - 1 - order, LATER)):
        for side in neighbours(places):
            hit = (side >= 0) & (sorted_rank[side] == sorted_rank)
            flags[order[hit]] |= flag
    return flags


def longest_previous_factor(text: bytes) -> np.ndarray:
    """Longest match of each position that begins earlier, by the smaller neighbours in the whole suffix order."""
    n = len(text)
    data = np.frombuffer(text, np.uint8).astype(np.int64) + 1
    ranks, length, levels = dense(data), 1, [(1, data)]
    levels = [(1, ranks)]
    while length < n:
        moved = np.full(n, -1, np.int64)
        moved[:n - length] = ranks[length:]
        ranks, length = dense(ranks * (n + 2) + moved + 1), 2 * length
        levels.append((length, ranks))
    order = np.argsort(ranks, kind="stable")
    best = np.zeros(n, np.int64)
    for side in neighbours(order):
        for place, other in enumerate(side):
            if other >= 0:
                a, b, common = order[place], order[other], 0
                for step, rank in reversed(levels):
                    while max(a, b) + common + step <= n and rank[a + common] == rank[b + common]:
                        common += step
                best[a] = max(best[a], common)
    return best


def flagged(rows: DataFrame, length: int) -> DataFrame:
    """For each passage the match flags of its windows, one byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in ps.grouped(batches, STEP):
            held.sort(key=lambda r: (r["id"], r["key"], r["at"]))
            text = np.frombuffer(b"".join(r["passage"] for r in held), np.uint8)
            size = np.array([len(r["passage"]) for r in held])
            begin = np.cumsum(size) - size
            count = size - length + 1
            flags = full_matches(ranks_to_depth(text, length), wk.spread(begin, count))
            repeated = np.array([r["n"] > 1 for r in held])
            flags |= np.where(np.repeat(repeated, count), LATER, 0).astype(np.int8)
            ends = np.cumsum(count)
            for lo in range(0, len(held), 4096):
                some = [(r, flags[e - c:e]) for r, e, c in zip(held[lo:lo + 4096], ends[lo:lo + 4096], count[lo:lo + 4096])]
                some = [(r, f) for r, f in some if f.any()]
                if some:
                    columns = [[r[c] for r, _ in some] for c in ("anchor", "seg", "n", "id", "key", "at")]
                    columns[2:2] = [[0] * len(some)]
                    columns += [[int(f.max()) for _, f in some], [f.tobytes() for _, f in some]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, kinds[c]) for c, v in zip(ps.FOUND, columns)], ps.FOUND)

    kinds = {c: pa.int64() for c in ps.FOUND} | {"shift": pa.int32(), "found": pa.binary()}
    return ps.together(rows).mapInArrow(run, "anchor bigint, seg bigint, shift int, n bigint, id0 bigint, key0 bigint, at0 bigint, "
                                             "least bigint, found binary")


def remove_repeated_bytes(docs: DataFrame, length: int = 400, gram: int = 32, keep: str = "first", group: int = ps.GROUP,
                          id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept, spans): kept bytes, and the removed byte ranges [start, stop)."""
    if keep not in ("first", "none"):
        raise ValueError("keep is 'first' or 'none'")
    found = ps.matches(ps.with_key(docs, id_column, text_column), ps.Unit("byte", length, gram), lambda rows: flagged(rows, length),
                       False, F.lit(True), ["shift", "found"] if keep == "none" else ["shift", "found", "id0", "key0", "at0"], group)
    wanted = EARLIER if keep == "first" else EARLIER | LATER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in ps.unpacked(batches):
            out = [[], [], [], [], []]
            names = zip(part.column("id").to_pylist(), part.column("key").to_pylist())
            for text, name, hits in zip(texts, names, part.column("hits").to_pylist()):
                starts = []
                for at, p in ((h["at"] + h_["shift"], h_) for h in hits or [] for h_ in h["pieces"]):
                    flags = np.frombuffer(p["found"], np.int8)
                    if keep == "first" and (*name, at) != (p["id0"], p["key0"], p["at0"]):
                        flags = flags | EARLIER
                    starts.append(at + np.flatnonzero(flags & wanted))
                edge = np.zeros((0, 2), np.int64)
                kept = text
                if starts:
                    gone = wk.covered(len(text), np.concatenate(starts), length)
                    edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))).reshape(-1, 2)
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                for values, v in zip(out, (len(text), len(text) - len(kept), len(edge), kept,
                                           [{"start": int(a), "stop": int(b)} for a, b in edge])):
                    values.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([part.column("doc"), *(pa.array(v, k) for v, k in zip(out, kinds))],
                                             [id_column, "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    return found.mapInArrow(run, f"`{id_column}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, "
                                 "spans array<struct<start:bigint,stop:bigint>>")

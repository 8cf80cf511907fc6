"""Benchmark decontamination: CGK embeddings of item-sized windows, bit-sampling LSH, exact edit verification.

A benchmark item leaks into a document if some run of the document's words is within `edits` word edits of the item, that
is `share` of its words rounded down. Windows of each item length slide over every document; those that share too few word
pairs with the items of that length cannot be that near (one edit breaks two pairs) and are passed over. The rest are
embedded by random walks: at each of 3 L steps a walk emits the window's current word and moves on if a random bit of
(step, word) says so, which turns few edits into few differing places. Tables hash a few sampled places of a walk; for each
item length, tables are added until copies edited at random as much as allowed meet their item with the target recall, and
a length that a bounded number of tables does not serve samples fewer places. Each window that shares
a bucket with an item of its length is aligned with the item exactly; distances in the result are exact.

The item index is one shard of at most `ITEMS` items, the only thing sent to tasks; more items mean more passes. Items in
scripts without spaces, and items of a few very long words, are read by characters instead of words, spaces left out, in a
pass of their own; `start` and `stop` of their matches count characters.

Edges: null and empty texts match nothing, and items without a word are in none. Items with too few words for an edit, down
to one, match equal runs. Words are compared after lowering A-Z. Equal
items are each reported. Null item ids are passed over. Repeated rows give repeated rows; other columns are kept apart.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cohortspark.llm import wordkit as wk
from cohortspark.llm.store import bounded_batches

SHARE, RECALL = 0.15, 0.99
ITEMS = 20_000
#: Items of fewer than `FEW` words with this many characters a word are read by characters.
FEW, LONG_WORD = 5, 20
#: Characters of scripts without spaces: Thai, Lao, Tibetan, Myanmar, Khmer, kana, Han and their extensions.
UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff]")
#: Places of a walk that a table samples at most, tables that share a walk, most tables, and edited copies that try a length.
PLACES, PER_WALK, TABLES, TRIED = 5, 8, 64, 256
#: Windows that a worker gathers before it embeds them.
GATHER = 20_000
#: Words of windows that are embedded at a time.
CELLS = 2_000_000
PAD = np.uint64(0)


def by_characters(text: str) -> bool:
    """Whether words say little about an item."""
    size = len("".join(words := re.split("[\x20\x09-\x0D]+", text)))
    return size > 0 and (2 * len(UNSPACED.findall(text)) >= size or len(w := [x for x in words if x]) < FEW and size >= LONG_WORD * len(w))


def units(column: pa.Array, characters: bool) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words or characters of all texts in a row, and where each text begins."""
    data, offsets = wk.text_bytes(column)
    if not characters:
        w = wk.words(data, offsets)
    else:
        begins = np.flatnonzero((data & 0xC0) != 0x80)
        shown = ~wk.SEPARATOR[data[begins]]
        start, stop = begins[shown], np.r_[begins[1:], len(data)][shown]
        w = wk.Words(data, offsets, start, stop, np.searchsorted(start, offsets))
    return w.hashes(wk.LOWER[data]), w.first


def budget(length: int, share: float) -> int:
    return int(length * share)


def walks(windows: np.ndarray, seed: int) -> np.ndarray:
    """CGK embedding of each row of words to three times as many places."""
    n, length = windows.shape
    padded = np.concatenate([windows, np.full((n, 1), PAD)], axis=1)
    at, rows = np.zeros(n, np.int64), np.arange(n)
    out = np.empty((n, 3 * length), np.uint64)
    for step in range(3 * length):
        word = padded[rows, at]
        out[:, step] = word
        at = np.minimum(at + (wk.mix(word ^ np.uint64((seed * 1_000_003 + step) * 2 + 1)) & np.uint64(1)).astype(np.int64), length)
    return out


def bucket_keys(windows: np.ndarray, tables: int, sampled: int = PLACES) -> Iterator[np.ndarray]:
    """Bucket of each row in each table, of so many places each."""
    length = windows.shape[1]
    for walk in range(-(-tables // PER_WALK)):
        out = walks(windows, walk)
        for table in range(walk * PER_WALK, min(tables, (walk + 1) * PER_WALK)):
            places = np.random.default_rng([table, length]).integers(0, 3 * length, sampled)
            key = np.full(len(windows), table, np.uint64)
            for p in places:
                key = wk.mix(key * np.uint64(wk.BASE) + out[:, p])
            yield key


def blank_key(table: int, sampled: int) -> np.uint64:
    """Bucket of a table where all places lie behind the ends of the walks, so that it holds any two windows."""
    key = np.full(1, table, np.uint64)
    for _ in range(sampled):
        key = wk.mix(key * np.uint64(wk.BASE) + PAD)
    return key[0]


def edited(words: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """The window of an item's length that begins where a copy with random edits begins."""
    copy = words.tolist()
    for _ in range(edits):
        kind, at = rng.integers(3), int(rng.integers(len(copy)))
        fresh = int(rng.integers(1, 1 << 62))
        copy[at:at + (kind != 1)] = [] if kind == 0 else [fresh]
    copy += rng.integers(1, 1 << 62, max(0, len(words) - len(copy))).tolist()
    return np.array(copy[:len(words)], np.uint64)


def tables_for(items: np.ndarray, share: float, recall: float) -> tuple[int, int, float]:
    """Tables for items of one length, places that each samples, and the recall seen with them: the share of copies, edited at
    random as much as allowed, that meet their item's bucket in some table.

    Windows that only meet where all places lie behind their ends have nothing in common and do not count. Equal runs meet in
    the first table. Fewer places serve a length that needs more than `TABLES` tables; should one place
    not do, which takes items that have next to nothing in common with their copies, a warning says so.
    """
    length = items.shape[1]
    edits = budget(length, share)
    if not edits:
        return 1, PLACES, 1.0
    rng = np.random.default_rng([11, length])
    some = items[rng.integers(0, len(items), TRIED)]
    changed = np.stack([edited(w, edits, rng) for w in some])
    for sampled in range(PLACES, 0, -1):
        met = np.zeros(len(some), bool)
        for table, (a, b) in enumerate(zip(bucket_keys(some, TABLES, sampled), bucket_keys(changed, TABLES, sampled)), 1):
            met |= (a == b) & (a != blank_key(table - 1, sampled))
            if not table % PER_WALK and met.mean() >= recall:
                return table, sampled, float(met.mean())
    warnings.warn(f"recall {met.mean():.3f} at item length {length}, under {recall}", stacklevel=2)
    return TABLES, 1, float(met.mean())


@dataclass
class Index:
    """Items of one shard: names, words, and per length the word pairs, the tables (number, places, recall seen) and the buckets."""

    names: list
    words: list[np.ndarray]
    share: float
    tables: dict[int, tuple[int, int, float]]
    single: np.ndarray
    pairs: np.ndarray
    pair_first: np.ndarray
    pair_length: np.ndarray
    buckets: dict[int, list[tuple[np.ndarray, np.ndarray]]]

    @staticmethod
    def of(items: list[tuple], share: float, recall: float, characters: bool = False) -> Index:
        code, first = units(pa.array([t or "" for _, t in items], pa.large_string()), characters)
        words = [code[a:b] for a, b in zip(first, first[1:])]
        kept = [i for i, x in enumerate(words) if len(x)]
        names, words = [items[i][0] for i in kept], [words[i] for i in kept]
        lengths = np.array([len(x) for x in words], np.int64)
        stacked = {int(n): (np.flatnonzero(lengths == n), np.stack([x for x in words if len(x) == n])) for n in np.unique(lengths)}
        tables = {n: tables_for(x, share, recall) for n, (_, x) in stacked.items()}
        known = [np.unique(np.stack([pair_codes(x), np.full(len(x) - 1, len(x), np.uint64)]), axis=1) for x in words]
        both = np.unique(np.concatenate(known, axis=1), axis=1) if known else np.zeros((2, 0), np.uint64)
        pairs, first = np.unique(both[0], return_index=True)
        buckets = {}
        for n, (index, x) in stacked.items():
            buckets[n] = []
            for key in bucket_keys(x, *tables[n][:2]):
                order = np.argsort(key, kind="stable")
                buckets[n].append((key[order], index[order]))
        single = np.unique(stacked[1][1]) if 1 in stacked else np.zeros(0, np.uint64)
        return Index(names, words, share, tables, single, pairs, np.r_[first, both.shape[1]], both[1].astype(np.int64), buckets)

    def windows(self, code: np.ndarray, first: np.ndarray) -> dict[int, np.ndarray]:
        """For each item length, where the windows begin that share enough word pairs with items of that length."""
        found = {}
        if len(self.single) and len(starts := np.flatnonzero(np.isin(code, self.single))):
            found[1] = starts
        if len(code) < 2 or not len(self.pairs):
            return found
        pair = pair_codes(code)
        pair[first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(code))] - 1] = PAD  # none goes over the end of a row
        place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        at = np.flatnonzero(self.pairs[place] == pair)
        place = place[at]
        count = self.pair_first[place + 1] - self.pair_first[place]
        position, length = np.repeat(at, count), self.pair_length[wk.spread(self.pair_first[place], count)]
        order = np.argsort(length, kind="stable")
        position, length = position[order], length[order]
        for n in np.unique(length).tolist():
            here = position[np.searchsorted(length, n):np.searchsorted(length, n, "right")]
            edits = budget(n, self.share)
            need = max(1, n - 1 - 2 * edits)
            if len(here) < need:
                continue
            low = here[need - 1:] - (n - 2)
            high = here[:len(here) - need + 1]
            ok = low <= high
            low, high = np.maximum(low[ok] - edits, 0), high[ok]
            starts = np.unique(wk.spread(low, high - low + 1))
            row = np.searchsorted(first, starts, "right") - 1
            starts = starts[starts + n - edits <= first[row + 1]]
            if len(starts):
                found[n] = starts
        return found


def pair_codes(code: np.ndarray) -> np.ndarray:
    return wk.mix(code[:-1] * np.uint64(wk.BASE) + wk.mix(code[1:]))


def alignment(item: list, text: list, most: int) -> tuple[int, int, int] | None:
    """(edits, start, stop) of the run of `text` nearest to the item, the first such; None beyond `most` edits."""
    cost, begin = [0] * (len(text) + 1), list(range(len(text) + 1))
    for i, word in enumerate(item):
        before, origin = cost, begin
        cost, begin = [i + 1], [0]
        for j, other in enumerate(text):
            best, source = before[j] + (word != other), origin[j]
            if before[j + 1] + 1 < best:
                best, source = before[j + 1] + 1, origin[j + 1]
            if cost[j] + 1 < best:
                best, source = cost[j] + 1, begin[j]
            cost.append(best)
            begin.append(source)
    stop = min(range(len(text) + 1), key=cost.__getitem__)
    return (cost[stop], begin[stop], stop) if cost[stop] <= most else None


MATCH = pa.list_(pa.struct([("item_id", pa.string()), ("edits", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())]))


class Held:
    """Rows with candidate windows, until enough are together to embed them."""

    def __init__(self, index: Index):
        self.index, self.parts, self.rows, self.windows = index, [], [], {}
        self.size = 0

    def add(self, part: pa.RecordBatch, code: np.ndarray, first: np.ndarray, found: dict[int, np.ndarray]) -> None:
        rows = np.unique(np.concatenate([np.searchsorted(first, s, "right") - 1 for s in found.values()]))
        base, place = len(self.rows), {int(r): i for i, r in enumerate(rows)}
        self.parts.append(part.take(pa.array(rows)))
        self.rows += [code[first[r]:first[r + 1]].copy() for r in rows]
        for n, starts in found.items():
            row = np.searchsorted(first, starts, "right") - 1
            own = np.array([base + place[int(r)] for r in row])
            self.windows.setdefault(n, []).append((own, starts - first[row]))
            self.size += len(starts)

    def finish(self) -> Iterator[tuple[pa.RecordBatch, list]]:
        """The held rows and the matches of each."""
        near: dict[tuple[int, int], list[int]] = {}
        for n, places in self.windows.items():
            own, at = (np.concatenate(x) for x in zip(*places))
            pairs, step = set(), max(1, CELLS // n)
            for base in range(0, len(own), step):
                text = np.full((len(own[base:base + step]), n), PAD)
                for line, r, a in zip(text, own[base:base + step].tolist(), at[base:base + step].tolist()):
                    words = self.rows[r][a:a + n]
                    line[:len(words)] = words
                for key, (buckets, items) in zip(bucket_keys(text, *self.index.tables[n][:2]), self.index.buckets[n]):
                    lo, hi = np.searchsorted(buckets, key), np.searchsorted(buckets, key, "right")
                    hit = np.flatnonzero(hi > lo)
                    for w, a, b in zip(hit.tolist(), lo[hit].tolist(), hi[hit].tolist()):
                        pairs.update((base + w, int(i)) for i in items[a:b])
            for w, i in pairs:
                near.setdefault((int(own[w]), i), []).append(int(at[w]))
        matches = [[] for _ in self.rows]
        for (row, i), starts in sorted(near.items()):
            item, text = self.index.words[i].tolist(), self.rows[row].tolist()
            edits, starts, done = budget(len(item), self.index.share), sorted(starts), -1
            for k, start in enumerate(starts):
                if k + 1 < len(starts) and starts[k + 1] - start <= len(item):
                    continue  # windows in a row are one region
                lo = max(0, min(s for s in starts[:k + 1] if s > done) - edits)
                region = text[lo:start + len(item) + edits]
                # an edit takes one word at most, so a region that lacks more of the item's words cannot be that near
                near_enough = (Counter(item) & Counter(region)).total() >= len(item) - edits
                found = alignment(item, region, edits) if near_enough else None
                done = start
                if found:
                    matches[row].append({"item_id": str(self.index.names[i]), "edits": found[0], "start": lo + found[1], "stop": lo + found[2]})
        base = 0
        for part in self.parts:
            yield part, matches[base:base + part.num_rows]
            base += part.num_rows
        self.parts, self.rows, self.windows, self.size = [], [], {}, 0


def searched(docs: DataFrame, items: list[tuple], characters: bool, carried: list[str], share: float, recall: float) -> DataFrame:
    """(row, text, matches) of all documents against one shard of items; row holds the carried columns."""
    index = Index.of(items, share, recall, characters)
    names = ["row", "text", "matches"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(index)

        def sent() -> Iterator[pa.RecordBatch]:
            for part, matches in held.finish():
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(matches, MATCH)], names)

        for part in wk.portions(batches):
            code, first = units(part.column("text"), characters)
            found = index.windows(code, first)
            rest = np.ones(part.num_rows, bool)
            if found:
                rest[np.concatenate([np.searchsorted(first, s, "right") - 1 for s in found.values()])] = False
                held.add(part, code, first, found)
            clean = part.filter(pa.array(rest))
            if clean.num_rows:
                yield pa.RecordBatch.from_arrays([*clean.columns, pa.array([[]] * clean.num_rows, MATCH)], names)
            if held.size >= GATHER:
                yield from sent()
        yield from sent()

    source = bounded_batches(docs).select(F.struct(*carried).alias("row"), F.col("text").cast("string").alias("text"))
    match = T.ArrayType(T.StructType([T.StructField("item_id", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("edits", "start", "stop"))]))
    return source.mapInArrow(run, T.StructType([*source.schema, T.StructField("matches", match)]))


def shards(benchmark: DataFrame) -> Iterator[tuple[list[tuple], bool]]:
    """Items in lists of about ITEMS, each bounded, and whether they are read by characters."""
    named = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("item_id is not null")
    n = max(1, -(-named.count() // ITEMS))
    for i in range(n):
        part = named.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i)
        rows = sorted(((r.item_id, r.text) for r in part.collect()), key=lambda r: (str(r[0]), r[1] or ""))
        other = [by_characters(t or "") for _, t in rows]
        for characters in (False, True):
            some = [r for r, c in zip(rows, other) if c == characters]
            if some or not (characters or any(other)):
                yield some, characters


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, recall: float = RECALL) -> DataFrame:
    """(doc_id, n_matches, contaminated, matches): the items that each document holds, with exact edit distances."""
    parts = [searched(docs.select("doc_id", "text"), items, characters, ["doc_id"], share, recall).select("row.doc_id", F.xxhash64("text").alias("key"), "matches")
             for items, characters in shards(benchmark)]
    out = parts[0]
    if len(parts) > 1:
        for more in parts[1:]:
            out = out.unionByName(more)
        copies = F.count(F.lit(1)) / len(parts)
        grouped = out.groupBy("doc_id", "key").agg(F.flatten(F.collect_set("matches")).alias("matches"), copies.cast("int").alias("copies"))
        out = grouped.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select("doc_id", F.size("matches").cast("bigint").alias("n_matches"), (F.size("matches") > 0).alias("contaminated"), "matches")


def keep_clean(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, recall: float = RECALL) -> DataFrame:
    """The documents that hold no item, in their columns."""
    for items, characters in shards(benchmark):
        out = searched(docs, items, characters, [c for c in docs.columns if c != "text"], share, recall).where(F.size("matches") == 0)
        docs = out.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
    return docs

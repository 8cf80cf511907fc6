"""Alignment of two tokenizers' tokens over a corpus, with counts of aligned pairs under minimal perfect hashes.

First pass: documents are encoded by both tokenizers and cut into groups where tokens of both end at the same byte; tokens of a
group are linked. A block of documents is one row: its packed ids, and its distinct pairs with the number of its documents
that link them. Pairs belong to shards by their A id, so all pairs of an id, and its highest count, lie in one shard.

Distinct pairs of a shard are united in a tree of groups of FAN blocks and get a minimal perfect hash that keeps the keys. Each
group of FAN blocks then adds its counts up in one dense vector indexed by the hash, and the vectors are summed along the tree.

Second pass: blocks ask the shards for their pairs; every look-up is verified against the kept key, and a pair that is not
there is an error. The answers meet their block, which is aligned again and takes each link's count from them.

A shard has about SHARD_KEYS distinct pairs, and at most two vocabularies' worth of pairs exist, so the number of shards is
bounded by the vocabularies, and rows between blocks and shards grow with the number of blocks only.

Edges: a null or empty text, and one whose tokens do not spell a space and the text on both sides, has no tokens. Wide groups
(a long stretch without a common end) are counted by distinct ids and how often each occurs, never pair by pair. Repeated
rows are documents of their own. A very long text is a portion of its own. Other columns are passed over. An empty table gives none.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from cohortspark.llm import wordkit as wk
from cohortspark.llm.byte_bpe import Decoder, byte_characters, encoder_of, joined, quiet_threads
from cohortspark.llm.perfect_hash import PerfectHash
from cohortspark.llm.store import bounded_batches, stored

#: Text bytes of a block, and of the portions that it is aligned by.
BLOCK, PORTION = 4 << 20, 1 << 20
#: Blocks, or vectors of blocks, that meet in one group of a tree.
FAN = 128
#: Distinct pairs that a shard should have, and the most shards.
SHARD_KEYS, MOST_SHARDS = 1 << 20, 2048
#: White space characters in a row from which a text is encoded by the library's own model.
LONG_SPACE = 10_000
#: Pairs of a group above which distinct ids are counted in place of pairs; pairs made at a time.
WIDE, STEP = 256, 1 << 20

BLOCKS = "block bigint, ids array<bigint>, n_a array<int>, n_b array<int>, a binary, b binary, keys binary, counts binary"
Batches = Iterator[pa.RecordBatch]


def byte_level_encoder(vocabulary: str, pattern: str) -> Callable[[str], list[int]]:
    """Encoder of whole texts by a byte-level vocabulary's merges.

    Where the merges are in the order of their tokens' ids, the ids are ranks, and tiktoken encodes by them; a text with a
    long run of white space, which its pattern engine may refuse, and any other vocabulary go to the library's own model.
    """
    import tiktoken

    slow = encoder_of(vocabulary, pattern).encode
    with open(vocabulary, encoding="utf-8") as file:
        model = json.load(file)["model"]
    pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
    ids = [model["vocab"].get(a + b, -1) for a, b in pairs]
    if any(x <= y for x, y in zip(ids[1:], ids)) or min(ids, default=0) < 256:
        return slow
    byte_of = {c: b for b, c in enumerate(byte_characters())}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if all(c in byte_of for c in token)}
    wanted = set(range(256)) | set(ids)
    fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for t, i in ranks.items() if i in wanted}, special_tokens={})
    odd = re.compile(r"\s{%d}" % LONG_SPACE).search
    return lambda text: slow(text) if odd(text) else fast.encode_ordinary(text)


class Tokenizers:
    """Both encoders of a worker, with the bytes of every token."""

    _made: dict[tuple[str, str, str], "Tokenizers"] = {}

    def __init__(self, a_file: str, pattern: str, b_file: str):
        import sentencepiece

        quiet_threads()
        self.encode_a = byte_level_encoder(a_file, pattern)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        known = Decoder(a_file).bytes_of
        self.bytes_a = [known.get(i, b"") for i in range(max(known) + 1)]
        self.bytes_b = [self.piece_bytes(i) for i in range(self.b.get_piece_size())]
        if len(self.bytes_a) * len(self.bytes_b) > 1 << 32:
            raise ValueError("pairs of these vocabularies do not fit 32 bits")

    @classmethod
    def of(cls, a_file: str, pattern: str, b_file: str) -> "Tokenizers":
        if (a_file, pattern, b_file) not in cls._made:
            cls._made[a_file, pattern, b_file] = cls(a_file, pattern, b_file)
        return cls._made[a_file, pattern, b_file]

    def piece_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of every token of both sides: all that an alignment needs of the tokenizers."""
        return tuple(np.array([len(x) for x in side], np.uint16) for side in (self.bytes_a, self.bytes_b))

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of each text on both sides; none where either side does not spell a space and the text."""
        out = []
        for text, b in zip(texts, self.b.encode(texts, num_threads=1)):
            spelled = (" " + text).encode()
            a = self.encode_a(" " + text) if text else []
            if a and b"".join(map(self.bytes_a.__getitem__, a)) == spelled == b"".join(map(self.bytes_b.__getitem__, b)):
                out.append((a, b))
            else:
                out.append(([], []))
        return out


@dataclass
class Aligned:
    """Tokens of several documents, one after the other, and their groups: first token and number of tokens on either side."""

    a: np.ndarray
    b: np.ndarray
    first_a: np.ndarray
    count_a: np.ndarray
    first_b: np.ndarray
    count_b: np.ndarray
    row: np.ndarray

    def links(self, size_b: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, key, times) of all links, in parts; key is the A id times `size_b` plus the B id."""
        wide = self.count_a * self.count_b > WIDE
        if not wide.all():
            group = np.repeat(np.arange(len(self.row)), self.count_a)
            tokens = np.flatnonzero(~wide[group])
            group = group[tokens]
            times = self.count_b[group]
            cuts = np.searchsorted(np.cumsum(times), np.arange(STEP, int(times.sum()) + STEP, STEP))
            for lo, hi in zip([0, *cuts], [*cuts, len(tokens)]):
                t, g, n = tokens[lo:hi], group[lo:hi], times[lo:hi]
                other = wk.spread(self.first_b[g], n)
                key = np.repeat(self.a[t].astype(np.uint32), n) * np.uint32(size_b) + self.b[other].astype(np.uint32)
                yield np.repeat(self.row[g], n), key, np.ones(len(key), np.int64)
        for g in np.flatnonzero(wide):
            a, times_a = np.unique(self.a[self.first_a[g]:self.first_a[g] + self.count_a[g]], return_counts=True)
            b, times_b = np.unique(self.b[self.first_b[g]:self.first_b[g] + self.count_b[g]], return_counts=True)
            step = max(1, STEP // len(b))
            for lo in range(0, len(a), step):
                key = (a[lo:lo + step, None].astype(np.uint32) * np.uint32(size_b) + b.astype(np.uint32)).ravel()
                yield np.full(len(key), self.row[g]), key, np.outer(times_a[lo:lo + step], times_b).ravel()

    def spelled(self, n_rows: int) -> list[bytes]:
        """Groups of each row as decimal ids: a1,a2|b1;a3|b2,b3."""
        n_a, n_b = np.cumsum(self.count_a), np.cumsum(self.count_b)
        group_a, group_b = (np.repeat(np.arange(len(self.row)), c) for c in (self.count_a, self.count_b))
        at_a = np.arange(len(self.a)) + (n_b - self.count_b)[group_a]
        at_b = np.arange(len(self.b)) + n_a[group_b]
        code = np.empty(len(self.a) + len(self.b), np.int64)
        last_a, last_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        last_a[n_a - 1], last_b[n_b - 1] = True, True
        code[at_a] = self.a * np.int64(3) + last_a
        code[at_b] = self.b * np.int64(3) + 2 * last_b
        written = decimals(int(code.max(initial=0)) // 3 + 1)[code].tolist()
        ends = np.searchsorted(self.row, np.arange(n_rows), "right")
        stop = np.concatenate([[0], n_a + n_b])[ends].tolist()
        return [b"".join(written[lo:hi])[:-1] for lo, hi in zip([0, *stop], stop)]


_DECIMALS = [np.zeros(0, object)]


def decimals(size: int) -> np.ndarray:
    """Ids below `size` with a comma, a bar and a semicolon after them, three entries an id."""
    if len(_DECIMALS[0]) < 3 * size:
        _DECIMALS[0] = np.array([b"%d%b" % (i, end) for i in range(size) for end in (b",", b"|", b";")], object)
    return _DECIMALS[0]


def align(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, lengths_a: np.ndarray, lengths_b: np.ndarray) -> Aligned:
    """Groups of the tokens of several documents, which spell the same bytes on both sides. n_a: A tokens of each document."""
    end_a, end_b = np.cumsum(lengths_a[a], dtype=np.int64), np.cumsum(lengths_b[b], dtype=np.int64)
    place = np.searchsorted(end_b, end_a)
    last_a = np.flatnonzero(end_b[np.minimum(place, max(0, len(end_b) - 1))] == end_a) if len(a) else np.zeros(0, np.int64)
    last_b = place[last_a]
    first_a, first_b = (np.concatenate([[0], x + 1])[:-1].astype(np.int64) for x in (last_a, last_b))
    row = np.searchsorted(np.cumsum(n_a), last_a, "right")
    return Aligned(a, b, first_a, last_a + 1 - first_a, first_b, last_b + 1 - first_b, row)


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    key, count = np.concatenate([np.zeros(0, np.uint32), *keys]), np.concatenate([np.zeros(0, np.int64), *counts])
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:len(key)])
    return key[first], np.add.reduceat(count[order], first) if len(first) else count


def documents_holding(found: Aligned, size_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of some documents, and how many of these link each."""
    seen = np.zeros(0, np.uint64)
    for row, key, _ in found.links(size_b):
        seen = np.unique(np.concatenate([seen, row.astype(np.uint64) << np.uint64(32) | key]))
    return np.unique((seen & np.uint64(0xFFFFFFFF)).astype(np.uint32), return_counts=True)


def packed(ids: np.ndarray) -> bytes:
    """Ids as compressed byte planes: blocks are written once and shuffled once."""
    return zstandard.ZstdCompressor(level=3).compress(ids.view(np.uint8).reshape(-1, ids.dtype.itemsize).T.tobytes())


def unpacked(data: bytes, size: int) -> np.ndarray:
    """`size` ids, of two bytes each, or four if the vocabulary is larger."""
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    kind = np.uint16 if len(flat) == 2 * size else np.uint32
    return np.ascontiguousarray(flat.reshape(-1, size).T).view(kind).ravel() if size else np.zeros(0, kind)


def encoded_blocks(batches: Batches, files: tuple[str, str, str], block: int, portion: int) -> Batches:
    """(id, text) batches as BLOCKS."""
    from pyspark import TaskContext

    tools = Tokenizers.of(*files)
    lengths = tools.lengths()
    number = TaskContext.get().partitionId() << 33
    ids, sizes, tokens, keys, counts, held = [], [], ([], []), [], [], 0

    def row() -> pa.RecordBatch:
        key, count = added(keys, counts)
        n = np.array(sizes, np.int32).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([
            pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), joined([n[:, 0]], pa.int32()), joined([n[:, 1]], pa.int32()),
            *(pa.array([packed(np.concatenate(side))], pa.binary()) for side in tokens),
            *(pa.array([side.tobytes()], pa.binary()) for side in (key, count))],
            [f.split()[0] for f in BLOCKS.split(", ")])

    for part in wk.portions(batches, limit=portion):
        found = tools.encode([t or "" for t in part.column("text").to_pylist()])
        a, b = (np.array([i for pair in found for i in pair[k]], np.uint16 if len(side) <= 1 << 16 else np.uint32)
                for k, side in enumerate((tools.bytes_a, tools.bytes_b)))
        key, count = documents_holding(align(a, b, np.array([len(x) for x, _ in found]), *lengths), len(tools.bytes_b))
        ids += part.column("id").to_pylist()
        sizes += [(len(x), len(y)) for x, y in found]
        tokens[0].append(a)
        tokens[1].append(b)
        keys.append(key)
        counts.append(count)
        held += part.column("text").nbytes
        if held >= block:
            yield row()
            number += 1
            ids, sizes, tokens, keys, counts, held = [], [], ([], []), [], [], 0
    if ids:
        yield row()


def shard_of(keys: np.ndarray, size_b: int, shards: int) -> np.ndarray:
    return (wk.mix((keys // np.uint32(size_b)).astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def by_shard(keys: np.ndarray, size_b: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys by shard, and where each shard begins (one more at the end)."""
    shard = shard_of(keys, size_b, shards)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def split(batches: Batches, size_b: int, shards: int) -> Batches:
    """(block, keys, counts) batches as (shard, block, keys, counts), the keys of one shard each."""
    for part in batches:
        for block, keys, counts in zip(*(part.column(k).to_pylist() for k in range(3))):
            keys, counts = np.frombuffer(keys, np.uint32), np.frombuffer(counts, np.int64)
            order, begin = by_shard(keys, size_b, shards)
            held = np.flatnonzero(np.diff(begin)).tolist()
            runs = [order[begin[s]:begin[s + 1]] for s in held]
            yield pa.RecordBatch.from_arrays([
                pa.array(held, pa.int64()), pa.array([block] * len(held), pa.int64()),
                *(pa.array([column[r].tobytes() for r in runs], pa.binary()) for column in (keys, counts))], ["shard", "block", "keys", "counts"])


def united(key: tuple, rows: pa.Table) -> pa.Table:
    """One row with the distinct keys of all rows of a group."""
    keys = np.unique(np.concatenate([np.frombuffer(k.as_py(), np.uint32) for k in rows.column("keys")]))
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "grp": pa.array([key[1].as_py()], pa.int64()),
                     "keys": pa.array([keys.tobytes()], pa.binary())})


def hashed(batches: Batches) -> Batches:
    """(shard, keys) batches as (shard, sizes, words, hash_keys)."""
    for part in batches:
        for shard, keys in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            made = PerfectHash.build(np.frombuffer(keys, np.uint32)).dump()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), *(pa.array([x], pa.binary()) for x in made.values())], ["shard", *made])


def hash_of(rows: pa.Table) -> PerfectHash:
    return PerfectHash.load(*(rows.column(c)[0].as_py() for c in ("sizes", "words", "hash_keys")))


def numbers_of(hash_: PerfectHash, keys: np.ndarray) -> np.ndarray:
    found = hash_.verified(keys)
    if (found < 0).any():
        raise ValueError("a pair of a block is not in its shard's hash")
    return found


def counted(key: tuple, pieces: pa.Table, hashes: pa.Table) -> pa.Table:
    """Dense vector of a group of blocks: summed counts by the hash's numbers."""
    hash_ = hash_of(hashes)
    total = np.zeros(len(hash_.keys), np.int64)
    for keys, counts in zip(pieces.column("keys"), pieces.column("counts")):
        total[numbers_of(hash_, np.frombuffer(keys.as_py(), np.uint32))] += np.frombuffer(counts.as_py(), np.int64)
    return vector(key, total)


def vector(key: tuple, total: np.ndarray) -> pa.Table:
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "grp": pa.array([key[1].as_py()], pa.int64()),
                     "total": pa.array([total.tobytes()], pa.binary())})


def summed(key: tuple, rows: pa.Table) -> pa.Table:
    return vector(key, sum(np.frombuffer(t.as_py(), np.int64) for t in rows.column("total")))


def highest(hash_: PerfectHash, total: np.ndarray, size_b: int) -> np.ndarray:
    """Whether each pair's count is the highest of its A id."""
    ids, place = np.unique(hash_.keys // np.uint32(size_b), return_inverse=True)
    most = np.zeros(len(ids), np.int64)
    np.maximum.at(most, place, total)
    return total == most[place]


def answered(key: tuple, pieces: pa.Table, index: pa.Table, size_b: int) -> pa.Table:
    """Counts and highest flags of each block's pairs, in the order of its keys."""
    hash_ = hash_of(index)
    total = np.frombuffer(index.column("total")[0].as_py(), np.int64)
    best = highest(hash_, total, size_b)
    found = [numbers_of(hash_, np.frombuffer(k.as_py(), np.uint32)) for k in pieces.column("keys")]
    return pa.table({"block": pieces.column("block"), "shard": pieces.column("shard"),
                     "counts": pa.array([total[f].tobytes() for f in found], pa.binary()),
                     "best": pa.array([best[f].tobytes() for f in found], pa.binary())})


def portions_of(n_a: np.ndarray, tokens: int) -> list[int]:
    """Rows at which portions of about `tokens` tokens begin, and the end."""
    total = np.cumsum(n_a)
    cuts = np.searchsorted(total, np.arange(tokens, int(total[-1]) if len(total) else 0, tokens)) + 1
    return sorted({0, len(n_a), *cuts.tolist()})


@dataclass
class Corpus:
    """Blocks of a corpus, their shards' index, and what both depend on."""

    blocks: DataFrame
    index: DataFrame
    pieces: DataFrame
    shards: int
    groups: int
    size_b: int
    lengths: tuple[np.ndarray, np.ndarray]

    def spread_index(self) -> DataFrame:
        """The index once for each group of blocks: a group's work needs its shard's hash, whatever blocks it holds."""
        return self.index.withColumn("grp", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(self.groups - 1).cast("bigint"))))


def group_of(groups: int) -> Column:
    return F.pmod(F.xxhash64("block"), F.lit(groups)).cast("bigint")


def corpus(docs: DataFrame, a_file: str, pattern: str, b_file: str, id_column: str = "doc_id", text_column: str = "text",
           block: int = BLOCK, fan: int = FAN, shards: int | None = None, portion: int = PORTION) -> Corpus:
    """Encode the documents once, count their pairs, and index the counts."""
    spark, files = docs.sparkSession, (a_file, pattern, b_file)
    lengths = Tokenizers.of(*files).lengths()
    size_b = len(lengths[1])
    source = bounded_batches(docs).select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text"))
    blocks = stored(source.mapInArrow(lambda b: encoded_blocks(b, files, block, portion), BLOCKS))
    n_blocks, n_keys = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("keys")), F.lit(0)) / 4).first()
    if shards is None:
        shards = int(min(MOST_SHARDS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_keys // SHARD_KEYS)))
    groups = max(1, -(-n_blocks // fan))
    pieces = (blocks.select("block", "keys", "counts")
              .mapInArrow(lambda b: split(b, size_b, shards), "shard bigint, block bigint, keys binary, counts binary")
              .withColumn("grp", group_of(groups)))

    level, left = pieces.select("shard", "grp", "keys"), groups
    while True:
        level = level.groupBy("shard", "grp").applyInArrow(united, "shard bigint, grp bigint, keys binary")
        if left == 1:
            break
        left = -(-left // fan)
        level = level.withColumn("grp", F.floor(F.col("grp") / fan))
    hashes = stored(level.select("shard", "keys").mapInArrow(hashed, "shard bigint, sizes binary, words binary, hash_keys binary"))

    made = Corpus(blocks, hashes, pieces, shards, groups, size_b, lengths)
    vectors = (pieces.groupBy("shard", "grp").cogroup(made.spread_index().groupBy("shard", "grp"))
               .applyInArrow(present(counted), "shard bigint, grp bigint, total binary"))
    left = groups
    while left > 1:
        left = -(-left // fan)
        vectors = vectors.withColumn("grp", F.floor(F.col("grp") / fan)).groupBy("shard", "grp").applyInArrow(summed, "shard bigint, grp bigint, total binary")
    made.index = stored(hashes.join(vectors.drop("grp"), "shard"))
    return made


def present(work):
    """`work` on the groups that have pieces; a shard has none of some groups."""
    def run(key: tuple, pieces: pa.Table, index: pa.Table) -> pa.Table | None:
        return work(key, pieces, index) if pieces.num_rows else work(key, pieces, index).slice(0, 0)

    return run


def pair_counts(found: Corpus) -> DataFrame:
    """(a, b, n_documents, highest): every linked pair of ids, with the number of documents that link it."""
    def rows(batches: Batches) -> Batches:
        for part in batches:
            for i in range(part.num_rows):
                row = pa.Table.from_batches([part.slice(i, 1)])
                hash_, total = hash_of(row), np.frombuffer(row.column("total")[0].as_py(), np.int64)
                best = highest(hash_, total, size_b)
                for lo in range(0, len(total), STEP):
                    key = hash_.keys[lo:lo + STEP].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key // size_b, pa.int32()), pa.array(key % size_b, pa.int32()),
                                                      pa.array(total[lo:lo + STEP]), pa.array(best[lo:lo + STEP])], ["a", "b", "n_documents", "highest"])

    size_b = found.size_b
    return found.index.mapInArrow(rows, "a int, b int, n_documents bigint, highest boolean")


def block_rows(blocks: pa.Table | pa.RecordBatch, i: int) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, n_a, n_b, a, b of one block."""
    ids, n_a, n_b = (blocks.column(c)[i].as_py() for c in ("ids", "n_a", "n_b"))
    n_a, n_b = np.array(n_a, np.int64), np.array(n_b, np.int64)
    return ids, n_a, n_b, *(unpacked(blocks.column(side)[i].as_py(), int(n.sum())) for side, n in (("a", n_a), ("b", n_b)))


def alignments(found: Corpus, portion: int = PORTION) -> DataFrame:
    """(id, a, b, group_a, group_b): ids of both sides, and the number of tokens of either side in each group."""
    lengths = found.lengths

    def rows(batches: Batches) -> Batches:
        for part in batches:
            for i in range(part.num_rows):
                ids, n_a, n_b, a, b = block_rows(part, i)
                cut_a, cut_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
                edges = portions_of(n_a, portion // 4)
                for lo, hi in zip(edges, edges[1:]):
                    at = align(a[cut_a[lo]:cut_a[hi]], b[cut_b[lo]:cut_b[hi]], n_a[lo:hi], *lengths)
                    begin = np.searchsorted(at.row, np.arange(hi - lo + 1))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(ids[lo:hi], pa.int64()),
                        *(joined([side[cut[r]:cut[r + 1]].astype(np.int32) for r in range(lo, hi)], pa.int32()) for side, cut in ((a, cut_a), (b, cut_b))),
                        *(joined([count[x:y].astype(np.int32) for x, y in zip(begin, begin[1:])], pa.int32()) for count in (at.count_a, at.count_b))],
                        ["id", "a", "b", "group_a", "group_b"])

    return found.blocks.select("ids", "n_a", "n_b", "a", "b").mapInArrow(
        rows, "id bigint, a array<int>, b array<int>, group_a array<int>, group_b array<int>")


SCORES = ("id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")


def scored(block: pa.Table, answers: pa.Table, lengths: tuple[np.ndarray, np.ndarray], shards: int, portion: int) -> pa.Table:
    """SCORES of one block's documents, aligned again, from the shards' answers."""
    size_b = len(lengths[1])
    ids, n_a, n_b, a, b = block_rows(block, 0)
    keys = np.frombuffer(block.column("keys")[0].as_py(), np.uint32)
    order, begin = by_shard(keys, size_b, shards)
    counts, best = np.full(len(keys), -1, np.int64), np.zeros(len(keys), bool)
    for shard, count, flag in zip(*(answers.column(c).to_pylist() for c in ("shard", "counts", "best"))):
        places = order[begin[shard]:begin[shard + 1]]
        counts[places], best[places] = np.frombuffer(count, np.int64), np.frombuffer(flag, bool)
    if (counts < 0).any():
        raise ValueError("a pair of a block got no answer")
    sums, digests = np.zeros((4, len(ids)), np.int64), []
    cut_a, cut_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
    edges = portions_of(n_a, portion // 4)
    for lo, hi in zip(edges, edges[1:]):
        at = align(a[cut_a[lo]:cut_a[hi]], b[cut_b[lo]:cut_b[hi]], n_a[lo:hi], *lengths)
        sums[0, lo:hi] = np.bincount(at.row, minlength=hi - lo)
        for row, key, times in at.links(size_b):
            place = np.searchsorted(keys, key)
            for k, value in ((1, times), (2, times * best[place]), (3, times * counts[place])):
                np.add.at(sums[k], row + lo, value)
        digests += [hashlib.sha256(x).hexdigest() if x else "" for x in at.spelled(hi - lo)]
    return pa.table([pa.array(ids, pa.int64()), pa.array(n_a), pa.array(n_b), *map(pa.array, sums), pa.array(digests, pa.string())],
                    [f.split()[0] for f in SCORES.split(", ")])


def scores(found: Corpus, id_column: str = "doc_id", portion: int = PORTION) -> DataFrame:
    """SCORES of every document: links, links whose count is the highest of their A id, and the sum of the links' counts."""
    size_b, shards, lengths = found.size_b, found.shards, found.lengths
    answers = (found.pieces.select("shard", "grp", "block", "keys").groupBy("shard", "grp")
               .cogroup(found.spread_index().groupBy("shard", "grp"))
               .applyInArrow(present(lambda key, p, i: answered(key, p, i, size_b)), "block bigint, shard bigint, counts binary, best binary"))
    blocks = found.blocks.select("block", "ids", "n_a", "n_b", "a", "b", "keys")
    return (blocks.groupBy("block").cogroup(answers.groupBy("block"))
            .applyInArrow(lambda b, x: scored(b, x, lengths, shards, portion), SCORES).withColumnRenamed("id", id_column))

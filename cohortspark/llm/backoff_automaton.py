"""Language-model scores by a weighted backoff automaton over counts of the whole training corpus.

States are the empty history, every word v and every pair (u, v) that training texts go on from. A state h of longest length has
an arc for each word w seen after it, with weight log10((c(hw) + k p(w | shorter h)) / (c(h) + k)); any other word takes its
failure arc, with weight log10(k / (c(h) + k)), to the state without the first word of h, where the same holds, down to the
empty state, whose arcs have the base weights log10 p(w), p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)). k = MASS * c(h)^POWER, with
constants of each length, stands for the successors that h would have by Heaps' law. One pass from left to right carries the state:
after w it is (v, w) if training saw that pair, else w if a training text goes on from it, else the empty state; a text starts in
the state of a mark. Failure arcs and arcs of all tokens of a block are taken at once, state by state length.

Texts are gathered in blocks that are written once. A block sends each different word, pair and triple once, as compressed sorted
codes with their training counts, to the bucket of the code's range; a bucket adds up, and answers each block with the totals
in the order asked. A block's answers are the part of the automaton that its texts walk through, whatever the corpus size.
An n-gram that everybody has comes once per block, and a code's total is one number, so no key gathers rows. Words have codes of 64
bits; those of pairs and triples have SPARE bits more than the number of tokens needs, so that at every size the chance that
an unseen one meets the code of another is under 2^-SPARE.

Edges: null and empty texts are one end token. Ids are compared as text for the training split; rows without id are training
rows. Without training rows every token is unknown and N = V = 0. Repeated rows count and score twice. A very long text is a block
of its own. Other columns are passed over.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from cohortspark.llm import wordkit as wk
from cohortspark.llm.store import bounded_batches, stored

#: Factor and exponent of the unseen successors of a word and of a pair.
MASS, POWER = (20.0, 2.0), (0.7, 0.7)
#: Text bytes of a block, and different codes that a bucket gets on average.
BLOCK, BUCKET = 4 << 20, 1_000_000
#: Bits of the code of a pair or triple beyond those of the number of tokens.
SPARE = 24
END, START = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949D7C7509E6557)
WORD, PAIR, TRIPLE = KINDS = 0, 1, 2


def planes(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unplanes(data: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(8, -1).T).view("<u8").ravel()


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the tokens of each row, the end included, and where each row begins."""
    w = wk.words(data, offsets)
    first = w.first + np.arange(len(w.first))
    code = np.full(first[-1], END, np.uint64)
    code[np.arange(len(w.start)) + w.row] = w.hashes(wk.LOWER[data])
    return code, first


def histories(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The word before each token, or the start."""
    before = np.r_[START, code[:-1]] if len(code) else code
    before[first[:-1]] = START
    return before


def pair_code(before: np.ndarray, code: np.ndarray) -> np.ndarray:
    return wk.mix(before * np.uint64(wk.BASE) + wk.mix(code))


def code_mask(total: int) -> np.uint64:
    """The leading bits that codes of pairs and triples keep when `total` tokens may make them."""
    bits = min(64, SPARE + max(1, total).bit_length())
    return np.uint64(((1 << bits) - 1) << (64 - bits))


def grams(code: np.ndarray, first: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the words, of the pairs that end with them, and of the triples, which a text's first tokens lack."""
    pair = pair_code(histories(code, first), code)
    inner = np.ones(len(code), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    return code, pair & mask, pair_code(pair[at - 1], code[at]) & mask


def blocks(docs: DataFrame) -> DataFrame:
    """(block, ids, held, sizes, packed, tokens): documents by the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, texts, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            whole = b"".join(texts)
            n = sum(len(t.split()) + 1 for t in texts)
            values = [uuid.uuid4().int >> 65, ids, held, [len(t) for t in texts], zstandard.ZstdCompressor(level=3).compress(whole), n]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

        names = ["block", "ids", "held", "sizes", "packed", "tokens"]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.int64()]
        for part in batches:
            for i, h, t in zip(part.column(0), part.column(1), part.column(2)):
                texts.append((t.as_py() or "").encode())
                ids.append(i.as_py())
                held.append(h.as_py())
                size += len(texts[-1]) + 16
                if size >= BLOCK:
                    yield block()
                    ids, held, texts, size = [], [], [], 0
        if texts:
            yield block()

    return docs.mapInArrow(run, "block bigint, ids array<bigint>, held array<boolean>, sizes array<bigint>, packed binary, tokens bigint")


def opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token codes of a block, first token of each text, and which texts are held out."""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["packed"]), np.uint8)
    offsets = np.r_[0, np.cumsum(np.array(row["sizes"], np.int64))]
    codes, sizes, lo = [], [np.zeros(1, np.int64)], 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + wk.PORTION, "right")) - 1)
        code, first = tokens(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        codes.append(code)
        sizes.append(np.diff(first))
        lo = hi
    return np.concatenate(codes), np.cumsum(np.concatenate(sizes)), np.array(row["held"], bool)


def bucket_of(codes: np.ndarray, buckets: int) -> np.ndarray:
    """Range of each code; no smaller for larger codes."""
    return ((codes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def questions(table: DataFrame, buckets: int, mask: np.uint64) -> DataFrame:
    """(bucket, kind, block, codes, counts): different n-grams of each block with their training counts, in the buckets they touch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for row in part.to_pylist():
                code, first, held = opened(row)
                trains = np.repeat(~held, np.diff(first))
                later = np.ones(len(code), bool)
                later[first[:-1]] = False
                for kind, values in zip(KINDS, grams(code, first, mask)):
                    different, at = np.unique(values, return_inverse=True)
                    counts = np.bincount(at, trains[later] if kind == TRIPLE else trains, len(different)).astype(np.uint64)
                    touched, begin = np.unique(bucket_of(different, buckets), return_index=True)
                    edges = [*begin.tolist(), len(different)]
                    for lo in range(0, len(touched), 1024):
                        out = [(b, kind, row["block"], planes(np.diff(different[a:z], prepend=np.uint64(0))), planes(counts[a:z]))
                               for b, a, z in zip(touched[lo:lo + 1024].tolist(), edges[lo:lo + 1024], edges[lo + 1:lo + 1025])]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    names, kinds = ["bucket", "kind", "block", "codes", "counts"], [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return table.select("block", "held", "sizes", "packed").mapInArrow(run, "bucket int, kind int, block bigint, codes binary, counts binary")


def answers(asked: DataFrame) -> DataFrame:
    """(bucket, kind, block, totals, n, v): totals in the order of each question; n and v (tokens and different words of the
    bucket) come with one row of each bucket only."""

    def group(rows: list[dict]) -> pa.RecordBatch:
        codes = [np.cumsum(unplanes(r["codes"]), dtype=np.uint64) for r in rows]
        different, at = np.unique(np.concatenate(codes), return_inverse=True)
        totals = np.bincount(at, np.concatenate([unplanes(r["counts"]) for r in rows]), len(different)).astype(np.uint64)
        ends = np.cumsum([len(c) for c in codes])
        word = rows[0]["kind"] == WORD
        out = [(r["bucket"], r["kind"], r["block"], planes(totals[at[e - len(c):e]]), int(totals.sum()) if word and not i else 0,
                int((totals > 0).sum()) if word and not i else 0) for i, (r, c, e) in enumerate(zip(rows, codes, ends))]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for part in batches:
            for row in part.to_pylist():
                if rows and (row["bucket"], row["kind"]) != (rows[0]["bucket"], rows[0]["kind"]):
                    yield group(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield group(rows)

    names = ["bucket", "kind", "block", "totals", "n", "v"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    sorted_ = asked.repartition("bucket", "kind").sortWithinPartitions("bucket", "kind")
    return sorted_.mapInArrow(run, "bucket int, kind int, block bigint, totals binary, n bigint, v bigint")


class Automaton:
    """Part of the backoff automaton that the texts of a block walk through. totals: training counts of the block's different words,
    pairs and triples, in the order of their codes; they are used up."""

    def __init__(self, code: np.ndarray, first: np.ndarray, mask: np.uint64, totals: dict[int, np.ndarray], n: int, v: int, starts: int):
        self.first, counts = first, {}
        for kind, values in zip(KINDS, grams(code, first, mask)):
            counts[kind] = totals.pop(kind).astype(float)[np.unique(values, return_inverse=True)[1]]
        self.words, self.pairs = counts[WORD], counts[PAIR]
        self.later = np.ones(len(code), bool)
        self.later[first[:-1]] = False
        self.triples = np.zeros(len(code))
        self.triples[self.later] = counts[TRIPLE]
        self.share = (self.words + 0.5) / (n + 0.5 * (v + 1)) if n + v else np.ones(len(code))
        self.ends, self.starts = code == END, starts

    def before(self, counts: np.ndarray, start: float) -> np.ndarray:
        """Count of the state that each token is read in: that of the word or pair which ends right before it."""
        out = np.r_[0.0, counts[:-1]] if len(counts) else counts
        out[self.first[:-1]] = start
        return out

    def walk(self, mass: tuple[float, float], power: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weight, base weight and whether known, of each token on the way from the start of each text."""
        base = weight = np.log10(self.share)
        visits = (self.before(np.where(self.ends, 0, self.words), self.starts), self.before(np.where(self.ends, 0, self.pairs), 0))
        for seen, there, factor, exponent in zip((self.pairs, self.triples), visits, mass, power):
            state = there > 0
            k, at = factor * there[state] ** exponent, there[state]
            fail = np.log10(k / (at + k)) + weight[state]
            arc = np.log10((seen[state] + k * 10 ** weight[state]) / (at + k))
            weight = weight.copy()
            weight[state] = np.where(seen[state] > 0, arc, fail)
        return weight, base, self.words > 0


def scores(docs: DataFrame, modulus: int = 5, remainder: int = 1, id_column: str = "doc_id", text_column: str = "text",
           mass: tuple[float, float] = MASS, power: tuple[float, float] = POWER) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document; documents whose crc32 of the id
    has the given remainder are held out of the counts."""
    held = F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))
    table = stored(blocks(bounded_batches(docs).select(F.col(id_column).cast("bigint"), held, F.col(text_column).cast("string"))))
    total = table.agg(F.sum("tokens").alias("n")).first().n or 0
    buckets = max(1, math.ceil(total / BUCKET))
    mask = code_mask(total)
    answered = stored(answers(questions(table, buckets, mask)))
    size = answered.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    starts = table.select(F.explode("held").alias("h")).where("not h").count()
    n, v = size.n or 0, size.v or 0
    replies = answered.groupBy("block").agg(F.collect_list(F.struct("kind", "bucket", "totals")).alias("replies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for row in part.to_pylist():
                code, first, out = opened(row)
                totals = {k: np.concatenate([np.zeros(0, np.uint64), *(unplanes(r["totals"]) for r in sorted(row["replies"], key=lambda r: r["bucket"]) if r["kind"] == k)])
                          for k in KINDS}
                weight, base, known = Automaton(code, first, mask, totals, n, v, starts).walk(mass, power)
                text = np.repeat(np.arange(len(out)), np.diff(first))
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["ids"], pa.int64()), pa.array(out), pa.array(np.diff(first)),
                    pa.array(np.bincount(text, known, len(out)).astype(np.int64)), pa.array(np.full(len(out), n, np.int64)),
                    pa.array(np.bincount(text, base, len(out))), pa.array(np.bincount(text, weight, len(out)))],
                    ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    joined = table.join(replies, "block").select("ids", "held", "sizes", "packed", "replies")
    return joined.mapInArrow(run, "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, "
                                  "score double").withColumnRenamed("id", id_column)

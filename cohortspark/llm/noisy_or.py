"""Toxicity by multiple-instance learning: sentences have scores, and a document's score is their noisy-or.

Sentences end at `.`, `!`, `?` and line breaks. A sentence's score is the logistic of the weights of its different words
and word beginnings, lower-cased in A-Z and known by a 64-bit hash. A document is toxic unless no sentence is: 1 - product(1 - score). Training
sees document labels only, so the gradient itself finds the sentences that explain a label. The fit takes a bounded,
hash-ordered sample of labelled documents into one task; the weights are bounded by `VOCABULARY` and sent to all tasks,
where scores and the offending sentences (character ranges are those of the bytes) come from passes over Arrow batches.

Edges: null and empty texts have no sentence; their score is that of a document without evidence, 0. Null labels and ids
are no training rows; an id with several labels is toxic if one of them says so. With no labels of both kinds every score
is the share of toxic labels, or 0 without labels. Repeated rows give repeated rows; other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F

from cohortspark.llm import wordkit as wk
from cohortspark.llm.store import bounded_batches

#: Labelled documents of a fit, words of a model, documents that must have a word, and rounds of a fit.
SAMPLE, VOCABULARY, LEAST_DOCS, ROUNDS = 6_000, 20_000, 4, 300
#: Bytes of the texts of a fit.
SAMPLE_BYTES = 128 << 20
#: Bytes of the beginnings of longer words that count as words too, so that a stem is known under new endings.
STEMS = (4, 5, 6)
#: A sentence at least this likely to be toxic is reported.
OFFENDING = 0.5

OUTSIDE = np.ones(256, bool)
OUTSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
END = np.zeros(256, bool)
END[list(b".!?\n")] = True


def held_out(doc_id: Column) -> Column:
    """Whether an id belongs to the fifth that no fit sees; null ids do not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Sentences:
    """Different words of each sentence of a portion; `first` are the sentences of each row, `begin` and `end` their bytes."""

    word: np.ndarray
    sentence: np.ndarray
    first: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def sentences(data: np.ndarray, offsets: np.ndarray) -> Sentences:
    inside = ~OUTSIDE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.r_[False, inside[:-1]], np.r_[inside[1:], False]
    start = np.flatnonzero(inside & (~before | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    stop = np.flatnonzero(inside & (~after | edge[1:])) + 1 if len(data) else start
    sums = wk.running(wk.BYTE_CODE[wk.LOWER[data]])
    row = np.searchsorted(offsets, start, "right") - 1
    ended = np.r_[0, np.cumsum(END[data])][start]
    new = np.r_[True, (ended[1:] != ended[:-1]) | (row[1:] != row[:-1])] if len(start) else np.zeros(0, bool)
    sentence = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    end = stop[np.r_[heads[1:] - 1, len(start) - 1]] if len(heads) else stop
    first = np.searchsorted(row[heads], np.arange(len(offsets)))
    code, part = [wk.span_hash(sums, start, stop)], [sentence]
    for size in STEMS:
        longer = stop - start > size
        code.append(wk.mix(wk.span_hash(sums, start[longer], start[longer] + size) + np.uint64(size)))
        part.append(sentence[longer])
    code, part = np.concatenate(code), np.concatenate(part)
    _, once = np.unique(wk.mix(code ^ wk.mix(part.astype(np.uint64))), return_index=True)
    once = once[np.argsort(part[once], kind="stable")]
    return Sentences(code[once], part[once], first, start[heads], end)


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    """Weights of known words, in the order of their hashes; without words, `bias` is a document's fixed log-odds."""

    words: np.ndarray
    weights: np.ndarray
    bias: float

    def sentence_scores(self, s: Sentences) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.words, s.word), len(self.words) - 1)
        weight = np.where(self.words[at] == s.word, self.weights[at], 0.0)
        return logistic(self.bias + np.bincount(s.sentence, weight, len(s.begin)))

    def scores(self, s: Sentences) -> tuple[np.ndarray, np.ndarray]:
        """Score of each row, and of each sentence."""
        if not len(self.words):
            return np.full(len(s.first) - 1, logistic(np.array(self.bias))), np.zeros(len(s.begin))
        each = self.sentence_scores(s)
        none = np.r_[0, np.cumsum(np.log1p(-np.minimum(each, 1 - 1e-12)))][s.first]
        return -np.expm1(np.minimum(np.diff(none), 0)), each


def fit(word: np.ndarray, sentence: np.ndarray, first: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = 0.1,
        shrink: float = 5e-5) -> Model:
    """Adam with soft thresholds on the noisy-or likelihood; words in fewer than LEAST_DOCS documents are unknown."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(0, np.uint64), np.zeros(0), 40.0 if share == 1 else -40.0)
    names, column = np.unique(word, return_inverse=True)
    row = np.searchsorted(first, sentence, "right") - 1
    key = np.unique(column.astype(np.int64) * len(y) + row)
    docs_with = np.bincount(key // len(y), minlength=len(names))
    toxic_with = np.bincount(key // len(y), y[key % len(y)], len(names))
    expected = docs_with * y.mean()
    lift = (toxic_with - expected) ** 2 / np.maximum(expected, 1e-9)
    chosen = np.flatnonzero(docs_with >= LEAST_DOCS)
    chosen = np.sort(chosen[np.argsort(-lift[chosen], kind="stable")[:VOCABULARY]])
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    known = place[column] >= 0
    column, sentence = place[column[known]], sentence[known]
    n = int(first[-1])
    w, bias = np.zeros(len(chosen)), -5.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    owner = np.repeat(np.arange(len(y)), np.diff(first))
    for step in range(1, rounds + 1):
        p = logistic(bias + np.bincount(sentence, w[column], n))
        none = np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y))
        toxic = np.maximum(-np.expm1(none), 1e-12)
        pull = p * ((y - toxic) / toxic)[owner]
        g = -np.r_[np.bincount(column, pull[sentence], len(w)), pull.sum()] / len(y)
        m, v = .9 * m + .1 * g, .999 * v + .001 * g * g
        move = rate * (m / (1 - .9 ** step)) / (np.sqrt(v / (1 - .999 ** step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
        scale = rate * shrink / (np.sqrt(v[:-1] / (1 - .999 ** step)) + 1e-8)
        w = np.sign(w) * np.maximum(np.abs(w) - scale, 0)
    keep = w != 0
    return Model(names[chosen[keep]], w[keep], float(bias)) if keep.any() else Model(names[:1], np.zeros(1), float(bias))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, size: int = SAMPLE_BYTES) -> Model:
    """A model of the labelled documents that are not held out: of at most `sample` ids and texts, and `size` bytes of whole texts.

    Rows that are equal in id and text count once, and are told apart from their sizes and hashes alone, so that the one task
    that fits never gathers more than the sample.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    given = bounded_batches(docs).select(F.col("doc_id").cast("bigint"), text.alias("text"), F.xxhash64(text).alias("key"))
    some = given.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "key").agg(F.first("y").alias("y"), F.first(F.octet_length("text")).alias("size"))
    taken, left = [], size
    for r in some.orderBy(F.xxhash64("doc_id"), "doc_id", "key").limit(sample).collect():
        if r["size"] <= left:
            taken.append((r.doc_id, r.key, r.y))
            left -= r["size"]
    picked = docs.sparkSession.createDataFrame(taken, "doc_id bigint, key bigint, y int")
    rows = given.join(F.broadcast(picked), ["doc_id", "key"]).groupBy("doc_id", "key").agg(F.first("text").alias("text"), F.first("y").alias("y"))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in wk.portions(batches):
            s = sentences(*wk.text_bytes(part.column("text")))
            count = np.bincount(s.sentence, minlength=len(s.begin))
            edges = np.searchsorted(s.sentence, s.first)
            words = pa.LargeListArray.from_arrays(pa.array(edges, pa.int64()), pa.array(s.word.view(np.int64)))
            sizes = pa.LargeListArray.from_arrays(pa.array(s.first, pa.int64()), pa.array(count))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), part.column("y"), words.cast(pa.list_(pa.int64())), sizes.cast(pa.list_(pa.int64()))],
                                             ["doc_id", "key", "y", "words", "sizes"])

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("key", "ascending")]).combine_chunks()
        flat = lambda name: table.column(name).combine_chunks().flatten().to_numpy()
        size = flat("sizes")
        first = np.r_[0, np.cumsum(pa.compute.list_value_length(table.column("sizes")).to_numpy())]
        model = fit(flat("words").view(np.uint64), np.repeat(np.arange(len(size)), size), first, table.column("y").to_numpy().astype(float))
        return pa.table({"word": pa.array(np.r_[model.words.view(np.int64), 0]), "weight": pa.array(np.r_[model.weights, model.bias]),
                         "bias": pa.array([False] * len(model.words) + [True])})

    prepared = rows.mapInArrow(prepare, "doc_id bigint, key bigint, y int, words array<bigint>, sizes array<bigint>")
    found = prepared.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(learn, "word bigint, weight double, bias boolean").collect()
    if not found:
        return fit(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0))
    terms = sorted(((np.uint64(r.word & (1 << 64) - 1), r.weight) for r in found if not r.bias))
    bias = next(r.weight for r in found if r.bias)
    return Model(np.array([t for t, _ in terms], np.uint64), np.array([x for _, x in terms]), bias)


def scored(docs: DataFrame, model: Model, threshold: float = OFFENDING) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_sentences, offending): offending sentences as byte ranges with scores."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in wk.portions(batches):
            data, offsets = wk.text_bytes(part.column("text"))
            s = sentences(data, offsets)
            score, each = model.scores(s)
            found = [[] for _ in score]
            for i in np.flatnonzero(each >= threshold):
                row = int(np.searchsorted(s.first, i, "right")) - 1
                found[row].append({"start": int(s.begin[i] - offsets[row]), "stop": int(s.end[i] - offsets[row]), "score": float(each[i])})
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)),
                 pa.array(np.diff(s.first)), pa.array(found, kind)],
                ["doc_id", "held_out", "score", "predicted", "n_sentences", "offending"])

    source = bounded_batches(docs).select("doc_id", F.col("text").cast("string").alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    return source.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int, n_sentences bigint, "
                                  "offending array<struct<start:bigint,stop:bigint,score:double>>")

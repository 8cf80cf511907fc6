"""Quality rules: boosted trees over document statistics, as flat node arrays.

Statistics come from numpy passes over Arrow batches. The trees are fitted on histograms of a bounded sample of labelled
rows, with monotonic constraints: more symbols, repeated lines, repeated words or capitals never raise the score. All
nodes of all trees lie in five arrays; rows walk all trees one level at a time. A document is kept unless it fails the base
rules or its score is under one half.

Edges: null and empty texts have no words, so the base rules reject them. Without labels of both kinds there is no model,
and the base rules alone decide. Null labels are passed over; an id with several labels counts as bad if one of
them is bad. Very long texts are portions of their own. Repeated rows give repeated rows. Other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cohortspark.llm import wordkit as wk
from cohortspark.llm.store import bounded_batches

#: Labelled rows that a fit takes at most, by hash order of the id.
SAMPLE = 20_000
#: Share of words in repeated windows above which, and number of words below which, the base rules reject.
REPEAT_WINDOW, REPEAT_PERCENT, LEAST_WORDS = 8, 30, 20
#: Statistics that trees see, and the direction in which each may move the score (0: either).
FEATURES = {"log_words": 0, "mean_word_chars": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "capital_share": -1,
            "digit_share": 0, "punctuation_share": 0, "mark_share": -1, "distinct_word_share": 0, "words_per_line": 0,
            "single_char_share": 0, "wide_char_share": 0, "longest_word": 0}


def flags(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


SYMBOL = flags(b"#*$%&|<>")
CAPITAL = flags(bytes(range(65, 91)))
DIGIT = flags(bytes(range(48, 58)))
PUNCTUATION = flags(b".,;:")
MARK = flags(b"!?")
BEGIN = ~flags(bytes(range(0x80, 0xC0)))
WIDE = flags(bytes(range(0xC0, 256)))


def sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sum of the values between neighbouring edges."""
    return np.diff(np.r_[0, np.cumsum(values, dtype=np.int64)][edges])


def repeated_in_row(code: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Rank of each code among equal codes of its row, in order; and how many there are."""
    own = wk.mix(code ^ wk.mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(own, kind="stable")
    begin = np.flatnonzero(np.r_[True, own[order][1:] != own[order][:-1]]) if len(order) else order
    size = np.diff(np.r_[begin, len(order)])
    rank, count = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order)) - np.repeat(begin, size)
    count[order] = np.repeat(size, size)
    return rank, count


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Counts of the base rules for each row, and the features."""
    w = wk.words(data, offsets)
    hashes, row, n = w.hashes(), w.row, np.diff(w.first)
    chars = np.r_[0, np.cumsum(BEGIN[data])]
    size = chars[w.stop] - chars[w.start]
    # windows of words
    grams = wk.gram_hash(wk.running(hashes), REPEAT_WINDOW)
    at = wk.spread(w.first[:-1], np.maximum(n - REPEAT_WINDOW + 1, 0))
    _, same = repeated_in_row(grams[at], row[at])
    repeated = wk.covered(len(row), at[same > 1], REPEAT_WINDOW)
    # lines with a word
    breaks = np.flatnonzero(data == 10)
    line_begin = np.union1d(offsets[:-1][np.diff(offsets) > 0], breaks + 1) if len(data) else breaks
    line_begin = line_begin[line_begin < len(data)]
    line_of_break = np.searchsorted(breaks, line_begin)
    next_break = np.r_[breaks, len(data)][line_of_break]
    line_row = np.searchsorted(offsets, line_begin, "right") - 1
    line_end = np.minimum(next_break, offsets[line_row + 1])
    words_before = np.searchsorted(w.start, np.stack([line_begin, line_end]))
    full = words_before[1] > words_before[0]
    line_begin, line_end, line_row = line_begin[full], line_end[full], line_row[full]
    rank, _ = repeated_in_row(wk.span_hash(wk.running(wk.BYTE_CODE[data]), line_begin, line_end), line_row)
    rows = len(offsets) - 1
    lines = np.bincount(line_row, minlength=rows)
    first_word, _ = repeated_in_row(hashes, row)
    base = {"n_words": n, "word_chars": sums(size, w.first), "n_symbols": sums(SYMBOL[data], offsets),
            "n_dup_lines": np.bincount(line_row[rank > 0], minlength=rows), "n_repeat_words": sums(repeated, w.first)}
    some, length = np.maximum(n, 1), np.maximum(np.diff(offsets), 1)
    longest = np.zeros(rows)
    np.maximum.at(longest, row, size)
    x = np.stack([
        np.log1p(n), base["word_chars"] / some, base["n_symbols"] / length, base["n_dup_lines"] / np.maximum(lines, 1),
        base["n_repeat_words"] / some, sums(CAPITAL[data], offsets) / length, sums(DIGIT[data], offsets) / length,
        sums(PUNCTUATION[data], offsets) / length, sums(MARK[data], offsets) / length, sums(first_word == 0, w.first) / some,
        n / np.maximum(lines, 1), sums(size == 1, w.first) / some, sums(WIDE[data], offsets) / length, np.log1p(longest)], axis=1)
    return base, x


@dataclass
class Trees:
    """All nodes of all trees; a leaf has feature -1. Left is value <= cut."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        while True:
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                return 1 / (1 + np.exp(-(self.start + self.value[at].sum(axis=1))))
            down = np.where(x[rows, np.maximum(feature, 0)] <= self.cut[at], self.left[at], self.right[at])
            at = np.where(inner, down, at)


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64,
        ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Second-order boosting of the logistic loss over histograms, with bounds that keep constrained features monotonic."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T)], axis=1)
    start = float(np.log(y.mean() / (1 - y.mean())))
    margin, nodes, roots = np.full(len(y), start), [], []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, left_depth: int) -> int:
        """Index of the node of these rows; its value lies in [low, high]."""
        me, total_g, total_h = len(nodes), g[rows].sum(), h[rows].sum()
        own = float(np.clip(-total_g / (total_h + ridge), low, high))
        nodes.append([-1, 0.0, 0, 0, rate * own])
        best, gain = None, 1e-6
        for f in range(x.shape[1]) if left_depth else ():
            if not len(cuts[f]):
                continue
            gs = np.cumsum(np.bincount(binned[rows, f], g[rows], len(cuts[f]) + 1))[:-1]
            hs = np.cumsum(np.bincount(binned[rows, f], h[rows], len(cuts[f]) + 1))[:-1]
            a, b = np.clip(-gs / (hs + ridge), low, high), np.clip(-(total_g - gs) / (total_h - hs + ridge), low, high)
            loss = gs * a + .5 * (hs + ridge) * a * a + (total_g - gs) * b + .5 * (total_h - hs + ridge) * b * b
            better = total_g * own + .5 * (total_h + ridge) * own * own - loss
            better[(hs < least) | (total_h - hs < least) | (signs[f] * (b - a) < 0)] = 0
            k = int(np.argmax(better))
            if better[k] > gain:
                best, gain = (f, k, a[k], b[k]), better[k]
        if best is None:
            margin[rows] += nodes[me][4]
            return me
        f, k, a, b = best
        middle = (a + b) / 2
        sides = [(low, high), (low, high)] if not signs[f] else [(low, middle), (middle, high)] if signs[f] > 0 else [(middle, high), (low, middle)]
        goes = binned[rows, f] <= k
        left = grow(rows[goes], g, h, *sides[0], left_depth - 1)
        right = grow(rows[~goes], g, h, *sides[1], left_depth - 1)
        nodes[me][:4] = [f, float(cuts[f][k]), left, right]
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), -8.0, 8.0, depth))
    feature, cut, left, right, value = zip(*nodes)
    return Trees(np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(value), np.array(roots), start)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, features) of documents, for fits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in wk.portions(batches):
            _, x = statistics(*wk.text_bytes(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(list(x), pa.list_(pa.float64()))],
                                             ["doc_id", "y", "x"])

    return bounded_batches(docs).select(F.col("doc_id").cast("bigint"), "y", F.col("text").cast("string")).mapInArrow(
        run, "doc_id bigint, y int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Trees | None:
    """Trees from at most `sample` labelled ids; only their statistics reach the driver. None without both labels."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = measured(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    y = np.array([r.y for r in rows], float)
    if not len(rows) or y.min() == y.max():
        return None
    return fit(np.array([r.x for r in rows]), y, list(FEATURES.values()))


def judged(docs: DataFrame, trees: Trees | None, carried: list[str]) -> DataFrame:
    """(row, text) with the counts, `base_failed`, `score` and `kept`; row holds the carried columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in wk.portions(batches):
            base, x = statistics(*wk.text_bytes(part.column("text")))
            failed = (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > REPEAT_PERCENT * base["n_words"])
            score = trees.score(x) if trees is not None else np.ones(len(x))
            added = [*(pa.array(base[c], pa.int64()) for c in COUNTS), pa.array(failed), pa.array(score), pa.array(~failed & (score >= 0.5))]
            yield pa.RecordBatch.from_arrays([*part.columns, *added], [*part.schema.names, *COUNTS, "base_failed", "score", "kept"])

    source = bounded_batches(docs).select(F.struct(*carried).alias("row"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([*source.schema, *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("base_failed", T.BooleanType()),
                           T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    return source.mapInArrow(run, schema)


def rules(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """(doc_id, counts, base_failed, score, kept) of every document."""
    return judged(docs, trees, ["doc_id"]).select("row.doc_id", *COUNTS, "base_failed", "score", "kept")


def keep(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """The documents that the rules keep, in their columns."""
    out = judged(docs, trees, [c for c in docs.columns if c != "text"]).where("kept")
    return out.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))

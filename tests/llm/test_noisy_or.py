"""Sentence scores learned from document labels: held-out accuracy, the noisy-or itself, and edge cases."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cohortspark.llm import noisy_or, wordkit


def test_sentences():
    texts = ["One two. Two, three!\nfour", None, "", "...", "Stupidly stupid"]
    data, offsets = wordkit.text_bytes(pa.array(texts))
    s = noisy_or.sentences(data, offsets)
    assert np.diff(s.first).tolist() == [3, 0, 0, 0, 1]
    assert [bytes(data[a:b]) for a, b in zip(s.begin, s.end)] == [b"One two", b"Two, three", b"four", b"Stupidly stupid"]
    assert np.bincount(s.sentence).tolist() == [2, 3, 1, 5]


def test_noisy_or():
    data, offsets = wordkit.text_bytes(pa.array(["bad. fine. bad fine", "fine", ""]))
    s = noisy_or.sentences(data, offsets)
    model = noisy_or.Model(np.sort(s.word[:1]), np.array([3.0]), -2.0)
    score, each = model.scores(s)
    p, q = 1 / (1 + np.exp(-1)), 1 / (1 + np.exp(2))
    assert np.allclose(each, [p, q, p, q]) and np.allclose(score, [1 - (1 - p) ** 2 * (1 - q), q, 0])


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = noisy_or.scored(docs, noisy_or.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    hits = [r.score for r in rows if r.toxic == 1]
    rest = np.array([r.score for r in rows if r.toxic == 0])
    assert np.mean([(h > rest).mean() for h in hits]) > 0.95 and (rest >= .5).mean() < 0.02
    assert all(r.predicted == (r.score >= .5) for r in rows)
    texts = {r.doc_id: r.text for r in docs.collect()}
    named = [texts[r.doc_id].encode()[s.start:s.stop].decode() for r in rows for s in r.offending]
    assert named and np.mean([bool(re.search("idiot|moron|loser|scum|trash|clown|stupid|pathetic|worthless|disgusting|lowei|lostra|vequ|veju|chlla", x.lower()))
                              for x in named]) > 0.5


@pytest.mark.parametrize("toxic,score", [([], 0), ([None], 0), ([0, 0], 0), ([1, 1], 1)])
def test_without_labels_of_both_kinds(spark, frame, toxic, score):
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)], "doc_id bigint, toxic int")
    docs = frame([(0, "some words. more"), (1, "some words"), (2, None), (2, "")])
    rows = noisy_or.scored(docs, noisy_or.train(docs, labels)).collect()
    assert len(rows) == 4 and {round(r.score, 6) for r in rows} == {score}
    assert noisy_or.scored(docs.where("false"), noisy_or.train(docs, labels)).count() == 0


def test_sample_counts_repeated_rows_once_and_is_bounded_by_bytes(spark):
    train = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, f"plain words {i}. scum here" if i % 3 == 0 else f"plain words {i}. calm here") for i in train]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in train], "doc_id bigint, toxic int")
    schema = "doc_id bigint, text string"
    model = noisy_or.train(spark.createDataFrame(rows, schema), labels)
    again = noisy_or.train(spark.createDataFrame(rows + rows[:1] * 500, schema), labels)
    assert np.array_equal(model.words, again.words) and np.allclose(model.weights, again.weights) and len(model.words)
    # one id with a text beyond the budget is passed over, the others are taken
    long = noisy_or.train(spark.createDataFrame(rows + [(train[0], "calm " * 100_000)], schema), labels, size=20_000)
    assert np.array_equal(model.words, long.words) and np.allclose(model.weights, long.weights)
    few = noisy_or.train(spark.createDataFrame(rows, schema), labels, size=60)
    assert not len(few.words)

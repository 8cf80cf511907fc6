"""Document statistics against plain counts, trees against their definition, and a fit on the given labels."""

import re

import numpy as np
import pytest

from cohortspark.llm import boosted_rules, wordkit
from tests.llm.brute import word_list


def plain(text):
    text = text or ""
    w = word_list(text)
    lines = [x for x in text.split("\n") if word_list(x)]
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    hit = set()
    for i, x in enumerate(windows):
        if windows.count(x) > 1:
            hit |= set(range(i, i + 8))
    n = len(w)
    return (n, sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit),
            n < 20 or 100 * len(hit) > 30 * n)


TEXTS = ["a b\nc d\na b\n\n \na b", "", None, "x" * 5000, "one two three four five six seven eight nine " * 4, "é ü# *$ñ\n*|<>%&\tz",
         " ".join(f"w{i}" for i in range(30)), "\n\n", "a\x0bb\x0cc\rd", "last line\nno break", "no break\nlast line\n"]


def test_counts(frame):
    got = {r.doc_id: r for r in boosted_rules.rules(frame(list(enumerate(TEXTS))), None).collect()}
    for i, text in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(text), text
        assert r.kept == (not r.base_failed)


def test_counts_do_not_cross_rows():
    data, offsets = wordkit.text_bytes(__import__("pyarrow").array(TEXTS * 3))
    base, x = boosted_rules.statistics(data, offsets)
    for i, text in enumerate(TEXTS * 3):
        assert tuple(int(base[c][i]) for c in boosted_rules.COUNTS) == plain(text)[:5]
    assert np.isfinite(x).all() and x.shape[1] == len(boosted_rules.FEATURES)


def test_trees_are_monotonic_and_flat():
    r = np.random.default_rng(3)
    x = r.normal(size=(2000, 3))
    y = (x[:, 0] + np.sin(3 * x[:, 1]) + .5 * r.normal(size=2000) > 0).astype(float)
    trees = boosted_rules.fit(x, y, [1, 0, -1])
    assert np.mean((trees.score(x) > .5) == y) > 0.85

    def walk(row):
        total = trees.start
        for at in trees.roots:
            while trees.feature[at] >= 0:
                at = trees.left[at] if row[trees.feature[at]] <= trees.cut[at] else trees.right[at]
            total += trees.value[at]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.score(x[:50]), [walk(v) for v in x[:50]])
    line = np.linspace(-3, 3, 200)
    for base in x[:40]:
        for f, sign in ((0, 1), (2, -1)):
            grid = np.repeat(base[None], 200, axis=0)
            grid[:, f] = line
            assert (sign * np.diff(trees.score(grid)) >= -1e-12).all()


def test_fit_on_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    trees = boosted_rules.train(docs, labels.where("doc_id % 3 <> 0"))
    rows = boosted_rules.rules(docs, trees).join(labels.where("doc_id % 3 = 0 and quality is not null"), "doc_id").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) > 0.9
    assert boosted_rules.keep(docs, trees).columns == docs.columns


@pytest.mark.parametrize("quality", [None, 1])
def test_without_labels_of_both_kinds(spark, frame, quality):
    labels = spark.createDataFrame([(1, quality)], "doc_id bigint, quality int")
    docs = frame([(1, " ".join(map(str, range(25)))), (2, "x")])
    trees = boosted_rules.train(docs, labels)
    assert trees is None
    assert [r.doc_id for r in boosted_rules.keep(docs, trees).collect()] == [1]
    assert boosted_rules.rules(docs.where("false"), trees).count() == 0

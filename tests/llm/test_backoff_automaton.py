"""Scores of the distributed automaton against a plain walk over dictionaries."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from cohortspark.llm import backoff_automaton as ba
from tests.llm.brute import word_list


def plain(docs):
    """One walk over dictionaries, from state to state by arcs and failure arcs."""
    lists = [([w.lower() for w in word_list(t)] + ["end"]) for _, t in docs]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs]
    counts, starts = Counter(), 0
    for w, h in zip(lists, held):
        if not h:
            full = ["start", *w]
            counts.update((x,) for x in w)
            counts.update(zip(full, w))
            counts.update(zip(full, w, w[1:]))
            starts += 1
    one = {g[0]: c for g, c in counts.items() if len(g) == 1}
    n, v = sum(one.values()), len(one)

    def visits(state):
        return starts if state == ("start",) else 0 if state[-1:] == ("end",) else counts[state]

    def read(state, w):
        """Weight of w from a state: its arc, or the failure arc and what follows."""
        if not state:
            return math.log10((one.get(w, 0) + .5) / (n + .5 * (v + 1)) if n else 1.0)
        c = visits(state)
        shorter = read(state[1:], w)
        if not c:
            return shorter
        k = ba.MASS[len(state) - 1] * c ** ba.POWER[len(state) - 1]
        seen = counts[*state, w]
        return math.log10((seen + k * 10 ** shorter) / (c + k)) if seen else math.log10(k / (c + k)) + shorter

    out = []
    for (i, _), w, h in zip(docs, lists, held):
        score, state = 0.0, ("start",)
        for x in w:
            score += read(state, x)
            # the longest history that training knows
            state = next(s for s in ((*state, x)[-2:], (x,), ()) if not s or visits(s))
        out.append((i, h, len(w), sum(x in one for x in w), n, sum(read((), x) for x in w), score))
    return out


def same(got, wanted):
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    got, wanted = sorted((tuple(r) for r in got), key=key), sorted(wanted, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in wanted]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in wanted], rtol=1e-9)


@pytest.mark.parametrize("bucket,block", [(ba.BUCKET, ba.BLOCK), (300, 3000)])
def test_scores(frame, planted, bucket, block, monkeypatch):
    monkeypatch.setattr(ba, "BUCKET", bucket)
    monkeypatch.setattr(ba, "BLOCK", block)
    docs = planted + [(None, "w1 W2 new"), (planted[0][0], planted[0][1]), (777, "ÀB cD w1 w2"), (778, "w3 " * 2000), (779, "w1 w2 w1 w2 w1 w2")]
    same(ba.scores(frame(docs)).collect(), plain(docs))


def test_no_training_rows_and_empty_table(frame):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    same(ba.scores(frame([(held, "a b a")])).collect(), plain([(held, "a b a")]))
    assert ba.scores(frame([(1, "a")]).where("false")).count() == 0


def test_better_than_the_base_on_held_out_rows(spark):
    rows = ba.scores(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out").collect()
    assert np.mean([r.score > r.base_score for r in rows]) > 0.9
    assert sum(r.score - r.base_score for r in rows) / sum(r.n_tokens for r in rows) > 0.4


def test_three_orders_beat_two(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")

    def held_out(**options):
        rows = ba.scores(docs, **options).where("held_out").collect()
        return sum(r.score for r in rows) / sum(r.n_tokens for r in rows)

    # with no weight on what was seen after a pair, only words are states
    assert held_out() > held_out(mass=(ba.MASS[0], 1e12)) + 0.05


def test_codes_have_spare_bits():
    assert ba.code_mask(0) == ba.code_mask(1) and bin(int(ba.code_mask(1))).count("1") == ba.SPARE + 1
    assert bin(int(ba.code_mask(10 ** 9))).count("1") == ba.SPARE + 30 and int(ba.code_mask(1 << 45)) == (1 << 64) - 1


def test_planes():
    values = np.array([0, 1, 255, 256, 1 << 63, (1 << 64) - 1], np.uint64)
    assert ba.unplanes(ba.planes(values)).tolist() == values.tolist()
    assert ba.unplanes(ba.planes(values[:0])).tolist() == []

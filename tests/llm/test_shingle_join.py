"""Exact Jaccard components against all pairs."""

import random

import pytest

from cohortspark.llm import components, shingle_join
from tests.llm import brute


def chains(seed=5):
    """Documents that differ from the one before by a few words, so that ends of a chain do not link."""
    r = random.Random(seed)
    docs, at = [], 0
    for _ in range(6):
        w = [f"v{r.randrange(500)}" for _ in range(r.randrange(30, 200))]
        for _ in range(8):
            docs.append((at, " ".join(w)))
            at += 1
            w = list(w)
            w[r.randrange(len(w))] = "new%d" % at
            if r.random() < .5:
                w.append("tail%d" % at)
    return docs


@pytest.mark.parametrize("entries,count", [(1_500_000, 4000), (1500, 4000), (1_500_000, 6)])
def test_components(frame, planted, entries, count):
    docs = planted + [(1000 + i, t) for i, t in chains()] + [(2000, "Short text"), (2001, "SHORT  text"), (2002, "a b c d e"), (2003, "A B C D e")]
    got = shingle_join.join(frame(docs), block_entries=entries, block_sets=count).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.jaccard_components(docs)
    sets = {i: brute.shingles(t) for i, t in docs}
    links = {i: sum(1 for b in sets if b != i and sets[i] and 100 * len(sets[i] & sets[b]) >= 80 * len(sets[i] | sets[b])) for i in sets}
    assert {r.doc_id: r.n_links for r in got} == links


def test_small_sets_always_share_a_key(frame):
    r = random.Random(2)
    docs = []
    for i in range(0, 240, 2):
        w = [f"z{r.randrange(10 ** 6)}" for _ in range(5 + i // 3)]
        cut = list(w)
        while len(cut) > 1 and 100 * (len(cut) - 5) >= 80 * (len(w) - 4):
            cut.pop(r.choice([0, -1]))
        docs += [(i, " ".join(w)), (i + 1, " ".join(cut))]
    got = shingle_join.join(frame(docs)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.jaccard_components(docs)


def test_missing_ids_repeated_rows_empty(spark, frame):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(None, text), (None, text + " x"), (5, text), (5, text), (5, "else where"), (6, "else where"), (None, None), (9, "")],
                                 "doc_id bigint, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in shingle_join.join(docs).collect())
    assert got == [(False, 5, 1, 5), (False, 5, 26, 5), (False, 5, 26, 5), (False, 6, 1, 5), (False, 9, 0, 9), (True, 0, 0, None),
                   (True, 0, 26, 5), (True, 0, 27, 5)]
    assert shingle_join.join(docs.where("false")).count() == 0
    kept = sorted(((r.doc_id is None, r.doc_id or 0) for r in shingle_join.keep_one(docs).collect()))
    assert kept == [(False, 5)] * 3 + [(False, 9)] + [(True, 0)] * 3


def test_stars(spark):
    r = random.Random(9)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(240)] + [(1000 + i, 1001 + i) for i in range(60)]
    edges = [e for e in edges if e[0] != e[1]]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.u: r.v for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}


def test_common_passage_repeats_no_set(frame, monkeypatch):
    r = random.Random(3)
    passage = [f"p{i}" for i in range(40)]
    docs = [(i, " ".join(passage + [f"o{r.randrange(10 ** 6)}" for _ in range(40)])) for i in range(60)]
    docs += [(100 + i, t + " end") for i, t in docs[:3]]
    given, product = [], shingle_join.product
    monkeypatch.setattr(shingle_join, "product", lambda members, *rest: given.append(members.count()) or product(members, *rest))
    got = shingle_join.join(frame(docs), block_sets=6).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.jaccard_components(docs)
    assert given == [6]

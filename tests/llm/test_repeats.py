"""Word and byte runs that occur elsewhere, against brute force."""

import hashlib

import numpy as np
import pytest

from cohortspark.llm import automaton_dedup, passages, suffix_dedup, wordkit
from tests.llm import brute


@pytest.mark.parametrize("group", [400, 3])
@pytest.mark.parametrize("window,gram", [(50, 8), (12, 4)])
def test_words(frame, planted, window, gram, group):
    found = automaton_dedup.remove_repeated_words(frame(planted), window, gram, group).collect()
    got = {r.doc_id: (r.n_words, r.n_removed, brute.sha(r.kept.encode())) for r in found}
    assert len(found) == len(planted) and got == brute.repeated_words(planted, window)
    assert all(sum(s.stop - s.start for s in r.spans) == r.n_removed for r in found)


@pytest.mark.parametrize("group", [400, 3])
@pytest.mark.parametrize("keep", ["first", "none"])
@pytest.mark.parametrize("length,gram", [(400, 32), (60, 16)])
def test_bytes(frame, planted, keep, group, length, gram):
    found = suffix_dedup.remove_repeated_bytes(frame(planted), length, gram, keep, group).collect()
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in found)
    assert got == sorted(brute.repeated_bytes(planted, length, keep))


def test_repeated_rows_and_missing_ids(frame, spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text), (None, None)], "doc_id bigint, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in automaton_dedup.remove_repeated_words(docs, 50).collect())
    assert got == [(False, 1, 0), (False, 1, 0), (False, 2, 60), (True, 0, 0), (True, 0, 60)]
    got = sorted((r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeated_bytes(docs, 100, keep="none").collect())
    assert got == [(0, 0)] + [(len(text), len(text))] * 4


def test_empty_table(frame):
    assert automaton_dedup.remove_repeated_words(frame([(1, "a")]).where("false"), 50).count() == 0
    assert suffix_dedup.remove_repeated_bytes(frame([(1, "a")]).where("false"), 400).count() == 0


def test_automaton_matching_statistics():
    shard = automaton_dedup.SuffixAutomaton()
    lists = [list("abcabd"), list("bcabcc"), list("aabca")]
    for label, one in enumerate(lists):
        shard.add(one, label)
    shard.finish()
    for stream in (*lists, list("zabcabcab")):
        for width in (1, 2, 3, 4):
            wanted = []
            for at in range(len(stream) - width + 1):
                piece = stream[at:at + width]
                having = [i for i, one in enumerate(lists) if any(one[j:j + width] == piece for j in range(len(one)))]
                wanted.append(min(having, default=passages.LAST))
            assert shard.stream(stream, width) == wanted


def test_longest_previous_factor():
    text = b"abracadabra abracadabra cad"
    wanted = [max((n for j in range(i) for n in range(len(text) - i + 1) if text[j:j + n] == text[i:i + n]), default=0)
              for i in range(len(text))]
    assert suffix_dedup.longest_previous_factor(text).tolist() == wanted


def test_ranks_to_depth():
    data = np.random.default_rng(1).integers(0, 2, 3000, dtype=np.uint8)
    for depth in (8, 11, 16, 24, 40, 100):
        ranks = suffix_dedup.ranks_to_depth(data, depth)
        runs = [data[i:i + depth].tobytes() for i in range(len(ranks))]
        assert len(runs) == len(data) - depth + 1
        order = {run: i for i, run in enumerate(sorted(set(runs)))}
        assert ranks.tolist() == [order[x] for x in runs]


def test_words_of_portions():
    texts = ["a bb\tc", "", "d", " e\x0bf ", "g"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    w = wordkit.words(data, np.cumsum([0, *map(len, texts)]))
    assert [bytes(data[a:b]) for a, b in zip(w.start, w.stop)] == [b"a", b"bb", b"c", b"d", b"e", b"f", b"g"]
    assert np.diff(w.first).tolist() == [3, 0, 1, 2, 1]
    assert len(set(w.hashes().tolist())) == 7

"""Texts of more than 3 MiB through every operator, beside short ones; odd rows through the pipeline."""

import importlib.util

import public_tokenizers
import pytest

from cohortspark.llm import (automaton_dedup, backoff_automaton, boosted_rules, byte_bpe, edit_leaks, kneser_ney, noisy_or, shingle_join,
                             suffix_dedup, template_dedup)
from tests.llm import brute

WORDS = [f"w{i * 7919 % 600_011}" for i in range(420_000)]
LONG = " ".join(WORDS) + "."
ITEM = " ".join(f"leaked{i}" for i in range(30))


@pytest.fixture(scope="module")
def docs(frame):
    assert len(LONG) > 3 << 20
    return frame([(1, LONG), (2, LONG), (3, LONG[:1 << 20] + " " + ITEM + " " + LONG[1 << 20:]), (4, "one short text"), (5, None), (6, "")]).cache()


def test_word_and_byte_runs(docs):
    got = {r.doc_id: (r.n_words, r.n_removed) for r in automaton_dedup.remove_repeated_words(docs, 50).collect()}
    n = len(WORDS)
    assert got[1] == (n, 0) and got[2] == (n, n) and got[4] == (3, 0) and got[5] == got[6] == (0, 0)
    # the passage in the middle stays, with what it cut in two at its edges
    assert got[3][0] in (n + 30, n + 31) and got[3][0] - got[3][1] in range(30, 34)
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeated_bytes(docs, 400, keep="none").collect()}
    assert got[1] == got[2] == (len(LONG), len(LONG)) and got[4][1] == 0 and 0 < got[3][0] - got[3][1] <= len(ITEM) + 2


def test_shingles(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.join(docs).collect()}
    assert got[1] == got[2] == (len(set(zip(WORDS, WORDS[1:], WORDS[2:], WORDS[3:], [*WORDS[4:-1], "end"]))), 1)
    assert got[3][1] == 1 and got[4] == (1, 4) and got[5] == (0, 5)


def test_language_models(spark, docs):
    got = {r.doc_id: r for r in backoff_automaton.scores(docs).collect()}
    assert got[1].n_tokens == len(WORDS) + 1 and got[1].score == pytest.approx(got[2].score) and got[5].n_tokens == 1
    assert got[1].score > got[1].base_score
    trusted = spark.createDataFrame([(1,), (2,), (4,)], "doc_id bigint")
    got = {r.doc_id: r for r in kneser_ney.judged(docs, trusted).collect()}
    assert got[1].n_tokens == len(WORDS) + 1 and 1 <= got[1].perplexity == pytest.approx(got[2].perplexity) and len(got) == 6


def test_leaks(spark, docs):
    benchmark = spark.createDataFrame([(7, ITEM)], "item_id bigint, text string")
    got = {r.doc_id: r.n_matches for r in edit_leaks.leaks(docs, benchmark).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0, 6: 0}


def test_verdicts(spark, docs):
    labels = spark.createDataFrame([(1, 0, 1), (4, 1, 0)], "doc_id bigint, toxic int, quality int")
    got = {r.doc_id: r for r in noisy_or.scored(docs, noisy_or.train(docs, labels)).collect()}
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got.values()) and got[1].score == got[2].score
    got = {r.doc_id: r for r in boosted_rules.rules(docs, boosted_rules.train(docs, labels)).collect()}
    assert got[1].n_words == len(WORDS) and got[1].word_chars == sum(map(len, WORDS)) + 1 and got[4].base_failed


def test_lines_and_encoding(docs):
    got = {r.doc_id: r.text for r in template_dedup.drop_recurring(docs).collect()}
    # a line that three documents share stays in the first; here two are equal, the third differs
    assert got[1] == LONG and got[4] == "one short text"
    found = byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).collect()
    assert {r.doc_id: r.decoded_sha256 for r in found} == {r.doc_id: brute.sha((r.text or "").encode()) for r in docs.collect()}


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not installed")
def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    def plain(seed):
        """Eight lines of twelve words of letters."""
        word = lambda i: "".join(chr(97 + (seed + i) * k % 26) for k in (3, 7, 11, 17, 5))
        return "\n".join(" ".join(word(12 * line + i) + "abcdefgh"[line] for i in range(12)) for line in range(8))

    good = plain(1)
    rows = [(1, good, "en", "s", len(good)), (1, good, "en", "s", len(good)), (2, good, None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0),
            (None, plain(9).upper(), "en", "s", 5), (5, good + "\n" + LONG, "en", "s", 9)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    for name, some in (("odd", rows), ("none", [])):
        spark.createDataFrame(some, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([(1, ITEM), (None, "x"), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in corpus_pipeline.run(spark, f"{tmp_path}/odd").collect())
    assert kept == [(False, 1), (False, 1), (False, 5), (True, 0)]
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0

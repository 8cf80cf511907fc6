"""The pipeline stage by stage on the smallest tables, against plain versions of each stage's decisions."""

import base64

import public_tokenizers
import pytest
import tiktoken

from cohortspark.llm import boosted_rules, edit_leaks
from tests.llm import brute
from tests.llm.test_boosted_rules import plain as plain_counts
from tests.llm.test_template_dedup import plain as plain_lines

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """Rows before and after each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.stored(stage(spark, out[-1], SF)))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_join", "decontamination", "byte_encoding"]
    for df in steps[1:5]:
        assert df.columns == steps[0].columns and dict(df.dtypes) == dict(steps[0].dtypes)


def test_quality_rules(spark, steps):
    before, after = texts(steps[0]), texts(steps[1])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert 0 < len(after) < len(before) and all(before[i] == t for i, t in after.items())
    assert not any(plain_counts(t)[5] for t in after.values())
    good = [i for i in before if labels.get(i) == 1 and not plain_counts(before[i])[5]]
    assert sum(i in after for i in good) >= 0.95 * len(good)


def test_line_dedup(steps):
    before, after = texts(steps[1]), texts(steps[2])
    assert after == plain_lines(list(before.items()))
    assert all(r.n_chars == len(r.text) for r in steps[2].collect() if before[r.doc_id] != r.text)


def test_ngram_join(steps):
    before, after = texts(steps[2]), texts(steps[3])
    component = brute.jaccard_components(list(before.items()))
    assert after == {i: t for i, t in before.items() if component[i][1] == i}


def test_decontamination(spark, steps):
    before, after = texts(steps[3]), texts(steps[4])
    items = [(r.text or "").lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    most = {len(w): edit_leaks.budget(len(w), edit_leaks.SHARE) for w in items}
    leaked = {i for i, t in before.items() if any(edit_leaks.alignment(w, t.lower().split(), most[len(w)]) for w in items
                                                  if len(set(w) & set(t.lower().split())) >= len(set(w)) * .5)}
    assert leaked and set(before) - set(after) == leaked and all(before[i] == t for i, t in after.items())


def test_encoding(steps):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    before = texts(steps[4])
    rows = steps[5].collect()
    assert sorted(r.doc_id for r in rows) == sorted(before)
    for r in rows:
        ids = plain.encode_ordinary(before[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == brute.sha(" ".join(map(str, ids)).encode())
        assert r.decoded_sha256 == brute.sha(before[r.doc_id].encode())


def test_run_and_rules_agree(spark, steps):
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, steps[5].collect()))
    docs = steps[0].limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
    assert boosted_rules.COUNTS[0] == "n_words"

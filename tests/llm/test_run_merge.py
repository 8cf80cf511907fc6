"""Exact duplicates against a plain grouping, over several rounds of exchange."""

from collections import defaultdict

import pyarrow as pa
import pytest

from cohortspark.llm import run_merge
from tests.llm import brute


def plain_version(docs, largest=True):
    """{(doc_id, digest): (keep_id, size)} and the number of rows kept."""
    groups = defaultdict(list)
    for i, t in docs:
        groups[t or ""].append(i)
    out = {}
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max(known) if largest else min(known)) if known else None
        out |= {(i, brute.sha(t.encode())): (keep, len(ids)) for i in ids}
    return out, len(groups)


def check(found, docs, largest=True):
    rows = found.collect()
    wanted, groups = plain_version(docs, largest)
    assert len(rows) == len(docs)
    assert {(r.doc_id, r.text_sha256): (r.keep_id, r.group_size) for r in rows} == wanted
    kept = [r for r in rows if r.kept]
    assert len(kept) == groups == len({r.text_sha256 for r in kept}) and all(r.doc_id == r.keep_id for r in kept)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("fan_bits,run_bits", [(5, 18), (1, 1), (2, 3)])
def test_groups(frame, planted, keep, fan_bits, run_bits):
    docs = planted + [(1000 + i, "hot") for i in range(60)] + [(5000 - i, f"pair {i // 2}") for i in range(20)] + [(-4, "hot"), (-2**63, "low"), (None, "low")]
    check(run_merge.copies(frame(docs), keep, fan_bits=fan_bits, run_bits=run_bits), docs, keep == "largest")


def test_rows_equal_in_all(frame):
    docs = [(1, "a"), (1, "a"), (2, "a"), (2, "a"), (None, "a"), (None, "b"), (None, "b"), (3, ""), (4, None)]
    check(run_merge.copies(frame(docs), fan_bits=1, run_bits=1), docs)


def test_long_and_empty(frame):
    long = "x y " * 900_000
    docs = [(1, long), (2, long + "."), (3, long), (4, "")]
    check(run_merge.copies(frame(docs)), docs)
    assert run_merge.copies(frame(docs).where("false")).count() == 0


def test_drop_copies_keeps_columns(spark, planted):
    docs = spark.createDataFrame([(i, t, "en", "tag", 5, b"d") for i, t in planted + [(3, planted[3][1]), (900, planted[3][1])]],
                                 "doc_id bigint, text string, lang string, tag string, run int, digest binary")
    kept = run_merge.drop_copies(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert len(rows) == len({t or "" for _, t in planted}) and {r.doc_id for r in rows if r.text == planted[3][1]} == {900}


def test_merge_compares_all_of_the_verified_digest():
    one, other = b"\0" * 48, b"\0" * 47 + b"\1"
    table = pa.table({"digest": [one, other, one], "id": [5, 9, 6], "tag": [0, 1, 2], "size": [1, 1, 3]})
    assert run_merge.merged(table, True).to_pylist() == [{"digest": one, "id": 6, "tag": 2, "size": 4}, {"digest": other, "id": 9, "tag": 1, "size": 1}]

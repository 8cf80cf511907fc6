"""Leaked items against exact alignment at every place."""

import random

import numpy as np
import pytest

from cohortspark.llm import edit_leaks


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def changed(words, edits, r):
    words = list(words)
    for _ in range(edits):
        kind, at = r.randrange(3), r.randrange(len(words))
        words[at:at + (kind != 1)] = [] if kind == 0 else ["fresh%d" % r.randrange(10 ** 6)]
    return words


@pytest.fixture(scope="module")
def case():
    r = random.Random(4)
    common = ["the", "of", "and", "to", "in"]
    text = lambda n: [r.choice(common) if r.random() < .4 else "b%d" % r.randrange(3000) for _ in range(n)]
    items = [(i, text(r.randrange(14, 60))) for i in range(60)] + [(100, ["two", "words"])]
    docs, planted = [], {}
    for d in range(400):
        body = text(r.randrange(5, 300))
        if d % 2:
            i, words = r.choice(items[:60])
            most = int(len(words) * edit_leaks.SHARE)
            copy = changed(words, r.randrange(most + 1), r)
            at = r.randrange(len(body))
            body[at:at] = copy
            planted[d] = (i, distance(words, copy))
        docs.append((d, " ".join(w.upper() if r.random() < .1 else w for w in body)))
    docs += [(900, None), (901, ""), (902, "two words")]
    return items, docs, planted


def test_recall_and_exactness(spark, frame, case):
    items, docs, planted = case
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(None, "x"), (101, None)], "item_id bigint, text string")
    got = {r.doc_id: r for r in edit_leaks.leaks(frame(docs), benchmark).collect()}
    assert len(got) == len(docs)
    hit = sum(any(m.item_id == str(i) and m.edits <= d for m in got[doc].matches) for doc, (i, d) in planted.items())
    assert hit >= 0.98 * len(planted)
    words = dict(items)
    for doc, text in docs:
        assert got[doc].contaminated == (got[doc].n_matches > 0) and (doc in planted or got[doc].contaminated == (doc == 902))
        for m in got[doc].matches:
            item = words[int(m.item_id)]
            assert distance(item, text.lower().split()[m.start:m.stop]) == m.edits <= int(len(item) * edit_leaks.SHARE)
    clean = edit_leaks.keep_clean(frame(docs), benchmark)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d in got if not got[d].contaminated)
    assert clean.columns == frame(docs).columns


def test_several_shards(spark, frame, case, monkeypatch):
    items, docs, _ = case
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    some = frame(docs[:60] + docs[:1])
    whole = sorted((r.doc_id, sorted(m.item_id for m in r.matches)) for r in edit_leaks.leaks(some, benchmark).collect())
    monkeypatch.setattr(edit_leaks, "ITEMS", 20)
    assert sorted((r.doc_id, sorted(m.item_id for m in r.matches)) for r in edit_leaks.leaks(some, benchmark).collect()) == whole


def test_empty_tables(spark, frame):
    nothing = spark.createDataFrame([], "item_id bigint, text string")
    assert [r.n_matches for r in edit_leaks.leaks(frame([(1, "a b c d e f g")]), nothing).collect()] == [0]
    some = spark.createDataFrame([(1, "a b c d e f g")], "item_id bigint, text string")
    assert edit_leaks.leaks(frame([(1, "a")]).where("false"), some).count() == 0
    assert [r.n_matches for r in edit_leaks.leaks(frame([(1, "x a b c d e f g"), (2, "a b c")]), some).orderBy("doc_id").collect()] == [1, 0]


def test_alignment_and_walks():
    assert edit_leaks.alignment(list("abcde"), list("xxabdeyy"), 2) == (1, 2, 6)
    assert edit_leaks.alignment(list("abcde"), list("zzzz"), 2) is None
    rng = np.random.default_rng(0)
    words = rng.integers(1, 1 << 62, (200, 40), dtype=np.uint64)
    near = np.stack([edit_leaks.edited(w, 2, rng) for w in words])
    far = rng.integers(1, 1 << 62, (200, 40), dtype=np.uint64)
    share = lambda other: (edit_leaks.walks(words, 1) == edit_leaks.walks(other, 1)).mean()
    assert share(words) == 1 and share(near) > 0.5 > 0.35 > share(far)


def test_short_items_and_scripts_without_spaces(spark, frame):
    r = random.Random(9)
    han = lambda n: "".join(chr(r.randrange(0x4e00, 0x9000)) for _ in range(n))
    question, key = han(40), "".join(r.choice("abcdefgh_") for _ in range(120))
    changed_one = question[:10] + "变" + question[11:25] + question[26:]
    benchmark = spark.createDataFrame([(1, question), (2, "Who wrote Hamlet"), (3, "capital city of Peru"), (4, key), (5, "一二三"), (6, "Xylophone"), (7, "")],
                                      "item_id bigint, text string")
    docs = [(1, han(90) + question + han(30)), (2, "so who wrote hamlet then"), (3, "the capital city of peru is"), (4, f"x {key} y"),
            (5, han(60) + changed_one + han(7)), (6, "who wrote the hamlet and capital of peru"), (7, han(300)), (8, None),
            (9, question[:20] + " " + question[20:] + " who wrote Hamlet"), (10, "a xylophone"), (11, "xylophones 一二 三四"), (1, han(90) + question + han(30))]
    got = [(x.doc_id, sorted((m.item_id, m.edits) for m in x.matches)) for x in edit_leaks.leaks(frame(docs), benchmark).collect()]
    one = [("1", 0)]
    assert sorted(got) == [(1, one), (1, one), (2, [("2", 0)]), (3, [("3", 0)]), (4, [("4", 0)]), (5, [("1", 2)]), (6, []), (7, []), (8, []),
                           (9, [("1", 0), ("2", 0)]), (10, [("6", 0)]), (11, [("5", 0)])]
    assert sorted(x.doc_id for x in edit_leaks.keep_clean(frame(docs), benchmark).collect()) == [6, 7, 8]


@pytest.mark.parametrize("length", [7, 14, 17, 50, 56, 150, 400])
def test_target_recall_at_every_length(length, recwarn):
    r = np.random.default_rng(length)
    items = r.integers(1, 1 << 62, (30, length)).astype(np.uint64)
    tables, sampled, seen = edit_leaks.tables_for(items, edit_leaks.SHARE, edit_leaks.RECALL)
    assert seen >= edit_leaks.RECALL and not [w for w in recwarn if issubclass(w.category, UserWarning)]
    some = items[r.integers(0, 30, 600)]
    copies = np.stack([edit_leaks.edited(w, edit_leaks.budget(length, edit_leaks.SHARE), r) for w in some])
    met = np.any([a == b for a, b in zip(edit_leaks.bucket_keys(some, tables, sampled), edit_leaks.bucket_keys(copies, tables, sampled))], axis=0)
    assert met.mean() >= 0.97


def test_recall_out_of_reach_is_reported(monkeypatch):
    monkeypatch.setattr(edit_leaks, "edited", lambda words, edits, rng: rng.integers(1, 1 << 62, len(words)).astype(np.uint64))
    items = np.random.default_rng(3).integers(1, 1 << 62, (30, 400)).astype(np.uint64)
    with pytest.warns(UserWarning, match="at item length 400, under 0.99"):
        edit_leaks.tables_for(items, edit_leaks.SHARE, edit_leaks.RECALL)

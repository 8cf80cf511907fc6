"""Recurring log templates, against a plain version."""

import re

import pytest

from cohortspark.llm import template_dedup

SPACE = re.compile(r"[\x20\x09-\x0D]+")
LOGS = ["error %d in unit %s at once today", "disk %d%% full on host h%d of rack seven", "all rights are reserved by owners"]


def plain(docs, min_docs=3, lead=3, fixed=0.6):
    """{(doc_id, text): kept text} by sorting out templates with dictionaries; ids are different."""
    parsed = {}
    for i, text in docs:
        for no, line in enumerate((text or "").split("\n")):
            t = [("<*>" if re.search("[0-9]", x) else x) for x in SPACE.split(line) if x]
            if t:
                parsed[i, no] = (len(t), *t[:lead]), tuple(t)
    support = {}
    for (i, _), (leaf, t) in parsed.items():
        for pos, x in enumerate(t):
            support.setdefault((leaf, pos, x), {}).setdefault(t, set()).add(i)
    having = {}
    for place, (leaf, t) in parsed.items():
        form = tuple(x if x != "<*>" and sum(len(d) for d in support[leaf, p, x].values()) >= min_docs else "<*>" for p, x in enumerate(t))
        if sum(x != "<*>" for x in form) >= fixed * len(t):
            having.setdefault((leaf, form), {}).setdefault(place[0], []).append(place[1])
    gone = set()
    for places in having.values():
        if len(places) >= min_docs:
            gone |= {(i, no) for i, lines in places.items() if i != min(places) for no in lines}
    out = {}
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for no, x in enumerate(lines) if (i, no) not in gone]
        if len(kept) == len(lines) or any(SPACE.sub("", x) for x in kept):
            out[i] = text if len(kept) == len(lines) else "\n".join(kept)
    return out


def documents():
    docs = []
    for i in range(30):
        own = f"line of {i} only here with words a{i} b c d"
        log = LOGS[i % 3] % ((i, "xyz"[i % 3]) if i % 3 == 0 else (i, i + 1) if i % 3 == 1 else ())
        docs.append((i, "\n".join([own, log, "", "quiet prose that one document has " + "pqrst"[i % 5] * (i + 1)])))
    docs += [(100, None), (101, ""), (102, LOGS[2]), (103, "  \t "), (104, "\n\n"), (105, LOGS[2] + "\n" + LOGS[2]), (106, "a" * 50_000 + "7")]
    return docs


def test_against_plain(frame):
    docs = documents()
    got = template_dedup.drop_recurring(frame(docs)).collect()
    assert {r.doc_id: r.text for r in got} == plain(docs)
    assert 102 not in {r.doc_id for r in got} and len(got) == len({r.doc_id for r in got})
    assert [r.lang for r in got] == ["en"] * len(got) and [r.id for r in got] == ["x"] * len(got)


@pytest.mark.parametrize("lead,fixed,min_docs", [(1, 0.3, 2), (2, 0.9, 4)])
def test_parameters(frame, lead, fixed, min_docs):
    docs = documents()
    got = template_dedup.drop_recurring(frame(docs), min_docs, lead, fixed).collect()
    assert {r.doc_id: r.text for r in got} == plain(docs, min_docs, lead, fixed)


def test_repeated_rows_missing_ids_and_empty_tables(spark, frame):
    line = "served by the same good host as ever"
    docs = spark.createDataFrame([(1, line + "\na"), (1, line + "\na"), (2, line + "\nb"), (None, line + "\nc"), (3, "d")],
                                 "doc_id bigint, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in template_dedup.drop_recurring(docs).collect())
    assert got == [(False, 1, line + "\na"), (False, 1, line + "\na"), (False, 2, "b"), (False, 3, "d"), (True, 0, "c")]
    assert template_dedup.drop_recurring(frame([(1, "a")]).where("false")).count() == 0


def test_no_python_in_the_plan(frame):
    plan = template_dedup.drop_recurring(frame(documents()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_equal_lines_of_mostly_variable_tokens(frame):
    lines = ["Page 3 of 12", "Tel 030 1234567 Fax 030 1234568", "2024-01-02 10:00:00 INFO 200 OK", "1 2 3", "a <*> <*>"]
    docs = [(i, "\n".join([f"own {i} x{i} {i}", *lines, "Page  %d of 12" % (i + 20)])) for i in range(6)]
    got = {r.doc_id: (r.text, r.n_dropped) for r in template_dedup.drop_recurring(frame(docs)).collect()}
    assert got[0] == (docs[0][1], 0)
    assert all(got[i] == (f"own {i} x{i} {i}\nPage  {i + 20} of 12", len(lines)) for i in range(1, 6))
    two = [(i, "7 8\nonly " + "abcdef"[i]) for i in range(2)]
    assert {r.doc_id: r.n_dropped for r in template_dedup.drop_recurring(frame(two)).collect()} == {0: 0, 1: 0}


def test_leaf_of_rows_without_id(spark):
    line = "served by the same good host as ever"
    docs = spark.createDataFrame([(None, f"{line}\n{x}") for x in "abcd"], "doc_id bigint, text string")
    assert sorted(r.n_dropped for r in template_dedup.drop_recurring(docs).collect()) == [0, 1, 1, 1]

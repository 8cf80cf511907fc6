"""Fill-in-middle forms against a plain version, and exact round trips."""

import hashlib
import re

import numpy as np
import pytest

from cohortspark.llm import middle_fill
from tests.llm import brute

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_version(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(m in text for m in middle_fill.MARKS) or h[2] % 100 >= rate:
        return (doc_id, len(units), "plain", None, None, text)
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return (doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def odd_documents():
    texts = [None, "", " ", "\n\t", "one", " one", "one ", "é ü\x0b日本 語", "a <P> b", "x<M>", "<S>", "< P> <P <", "\x1c\xa0 nbsp", "<", "P>x <S", "a\r\nb\n"]
    docs = [(i, texts[i % len(texts)]) for i in range(160)]
    return docs + [(None, "no id here"), (7, "same"), (7, "same"), (-3, "minus three words")]


@pytest.mark.parametrize("window", [7, 1 << 20])
def test_forms(frame, planted, monkeypatch, window):
    monkeypatch.setattr(middle_fill, "WINDOW", window)
    docs = odd_documents() + planted
    key = lambda r: tuple((v is None, v) for v in r)
    got = sorted((tuple(r) for r in middle_fill.transform(frame(docs)).collect()), key=key)
    assert got == sorted((plain_version(*d) for d in docs), key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_other_rates_and_seed(frame, planted):
    got = sorted(tuple(r) for r in middle_fill.transform(frame(planted), seed=7, rate=100, spm_rate=0).collect())
    assert got == sorted(plain_version(*d, seed=7, rate=100, spm=0) for d in planted)


def test_restored_from_output_and_form(frame, planted):
    docs = dict(odd_documents()[:160]) | {1000 + i: t for i, t in planted}
    back = middle_fill.restore(middle_fill.transform(frame(list(docs.items())), rate=100)).collect()
    assert {r.doc_id: r.restored for r in back} == {i: t or "" for i, t in docs.items()}


def test_digests(frame, planted):
    for r in middle_fill.digests(frame(planted)).collect():
        wanted = plain_version(r.doc_id, dict(planted)[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256) == (*wanted[1:5], brute.sha(wanted[5].encode()))
        assert r.restored_sha256 == brute.sha((dict(planted)[r.doc_id] or "").encode())


def test_long_text(frame):
    long = " ".join(f"wörd{i % 977}" for i in range(360_000))
    assert len(long.encode()) > 3 << 20
    docs = [(i, long + str(i)) for i in range(4)] + [(9, "short one")]
    got = {r.doc_id: r for r in middle_fill.digests(frame(docs), rate=100).collect()}
    for i, t in docs:
        assert got[i].output_sha256 == brute.sha(plain_version(i, t, rate=100)[5].encode())
        assert got[i].restored_sha256 == brute.sha(t.encode())


def test_empty_table(frame):
    assert middle_fill.digests(frame([(1, "a")]).where("false")).count() == 0


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("<P>", "P", "<M>"), ("aba", "<S>", "<M>"), ("<P>", "><", "<M>"), ("", "<S>", "<M>")])
def test_marks_that_a_scan_could_confuse(frame, marks):
    with pytest.raises(ValueError):
        middle_fill.transform(frame([(1, "a")]), marks=marks)


def test_broken_outputs(spark):
    marks = middle_fill.checked_marks(middle_fill.MARKS)
    for text, form in ((b"<P>a<S>b", 1), (b"<S>a<P>b<M>c", 1), (b"abc", 2)):
        with pytest.raises(ValueError):
            middle_fill.gather(np.frombuffer(text, np.uint8), np.array([0, len(text)]), np.array([form]), marks)

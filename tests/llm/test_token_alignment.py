"""Alignment of two tokenizers against a plain version, and the perfect hash that counts its pairs."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cohortspark.llm import perfect_hash, token_alignment
from cohortspark.llm.byte_bpe import byte_characters
from tests.llm import brute

FILES = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))
PLACES = {c: b for b, c in enumerate(byte_characters())}


def groups_of(texts):
    """Groups [(a ids, b ids)] of each text, from the libraries' own encodings of whole texts."""
    a_side = Tokenizer.from_file(FILES[0])
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=FILES[2])
    out = []
    for text in texts:
        groups, wanted = [], (" " + (text or "")).encode()
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        bytes_a = [bytes(PLACES[c] for c in a_side.id_to_token(i)) for i in a]
        pieces = [b_side.id_to_piece(i) for i in b]
        bytes_b = [bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
        if text and b"".join(bytes_a) == wanted == b"".join(bytes_b):
            end_a, end_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
            x = y = 0
            for end in sorted(set(end_a) & set(end_b)):
                i, j = end_a.index(end, x) + 1, end_b.index(end, y) + 1
                groups.append((a[x:i], b[y:j]))
                x, y = i, j
        out.append(groups)
    return out


def plain_version(docs):
    """[(doc_id, n_a, ...)] as the query returns them, and the pairs' counts."""
    per_text = {t: g for t, g in zip({t for _, t in docs}, groups_of({t for _, t in docs}))}
    counts = Counter()
    for _, t in docs:
        counts.update({(a, b) for group in per_text[t] for a in group[0] for b in group[1]})
    most = Counter()
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = []
    for i, t in docs:
        groups = per_text[t]
        links = [(a, b) for group in groups for a in group[0] for b in group[1]]
        spelled = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
                    sum(counts[x] == most[x[0]] for x in links), sum(counts[x] for x in links), brute.sha(spelled.encode()) if groups else ""))
    return out, counts, most


def odd_documents():
    r = random.Random(5)
    letters = "aeiou bcdfg ß日本語語語 éà\n\t0123<>|.,  "
    texts = [None, "", " ", "a", "  two  spaces ", "<|endoftext|> <s></s><unk>", "▁ already ▁", "x\x00y", "<0x41> A", "日本語のテキスト", "é", "😀😀 ok",
             "ａｂｃ ﬁ", "a" * 700, "ab" * 300 + "日" * 50, "\n" * 40 + " " * 40, "　" * 20]
    texts += ["".join(r.choice(letters) for _ in range(r.randrange(1, 120))) for _ in range(60)]
    return list(enumerate(texts)) + [(None, "no id"), (3, "repeated row"), (3, "repeated row")]


def order(row):
    return tuple((v is None, v) for v in row)


@pytest.mark.parametrize("settings", [{}, {"block": 500, "fan": 2, "shards": 7, "portion": 200}, {"block": 3000, "fan": 3, "shards": 3}])
def test_scores_and_counts(frame, planted, settings):
    docs = odd_documents() + planted
    found = token_alignment.corpus(frame(docs), *FILES, **settings)
    wanted, counts, most = plain_version(docs)
    assert sorted((tuple(r) for r in token_alignment.scores(found).collect()), key=order) == sorted(wanted, key=order)
    got = {(r.a, r.b): (r.n_documents, r.highest) for r in token_alignment.pair_counts(found).collect()}
    assert got == {pair: (n, n == most[pair[0]]) for pair, n in counts.items()}


@pytest.mark.parametrize("wide", [1, 4, 1000])
def test_wide_groups_and_small_steps(monkeypatch, wide):
    monkeypatch.setattr(token_alignment, "WIDE", wide)
    monkeypatch.setattr(token_alignment, "STEP", 3)
    r = np.random.default_rng(3)
    lengths = np.arange(5)
    a, b, n_a, pairs = [], [], [], Counter()
    for row in range(30):
        total, sides = int(r.integers(0, 40)), []
        for _ in range(2):
            side, left = [], total
            while left:
                side.append(int(r.integers(1, min(4, left) + 1)))
                left -= side[-1]
            sides.append(side)
        ends = [np.cumsum(s).tolist() for s in sides]
        cuts = [-1, *sorted(set(ends[0]) & set(ends[1]))]
        for lo, hi in zip(cuts, cuts[1:]):
            inside = [[t for t, e in zip(s, es) if max(lo, 0) < e <= hi] for s, es in zip(sides, ends)]
            pairs.update((row, x, y) for x in inside[0] for y in inside[1])
        a += sides[0]
        b += sides[1]
        n_a.append(len(sides[0]))
    at = token_alignment.align(np.array(a, np.uint16), np.array(b, np.uint16), np.array(n_a), lengths, lengths)
    got = Counter()
    for row, key, times in at.links(10):
        for x, k, n in zip(row.tolist(), key.tolist(), times.tolist()):
            got[x, k // 10, k % 10] += n
    assert got == pairs


def test_alignments_spell_both_sides(frame, planted):
    found = token_alignment.corpus(frame(planted), *FILES, block=2000)
    groups = dict(zip([i for i, _ in planted], groups_of([t for _, t in planted])))
    for r in token_alignment.alignments(found, portion=100).collect():
        assert [len(a) for a, _ in groups[r.id]] == r.group_a and [len(b) for _, b in groups[r.id]] == r.group_b
        assert sum((a for a, _ in groups[r.id]), []) == r.a and sum((b for _, b in groups[r.id]), []) == r.b


def test_long_runs_encode_alike():
    fast, slow = token_alignment.byte_level_encoder(*FILES[:2]), token_alignment.encoder_of(*FILES[:2]).encode
    for text in (" " * 300_000 + "x", "\n" * 20_000, "a" * 200_000, " 0" * 50_000, "日" * 60_000, "\x1c\xa0 \u2003" * 9_000, "<|endoftext|> it's"):
        assert fast(text) == slow(text)


def test_long_text_and_empty_table(frame):
    long = " ".join(f"word{i % 1000} ünd" for i in range(260_000))
    assert len(long.encode()) > 3 << 20
    docs = [(1, long), (2, "word1 ünd"), (3, None)]
    assert sorted(tuple(r) for r in token_alignment.scores(token_alignment.corpus(frame(docs), *FILES)).collect()) == sorted(plain_version(docs)[0])
    empty = token_alignment.corpus(frame(docs).where("false"), *FILES)
    assert token_alignment.scores(empty).count() == 0 and token_alignment.pair_counts(empty).count() == 0


@pytest.mark.parametrize("size", [0, 1, 2, 1000, 100_003])
def test_perfect_hash(size):
    keys = np.random.default_rng(size).choice(1 << 32, size, replace=False).astype(np.uint32)
    made = perfect_hash.PerfectHash.load(**perfect_hash.PerfectHash.build(keys).dump())
    assert np.array_equal(np.sort(made.verified(keys)), np.arange(size))
    others = np.setdiff1d(np.arange(5000, dtype=np.uint32), keys)
    assert (made.verified(others) == -1).all()
    assert len(made.words) * 64 < 8 * size + 640


def test_perfect_hash_of_repeated_keys():
    with pytest.raises(ValueError):
        perfect_hash.PerfectHash.build(np.array([7, 7], np.uint32))

"""Ids, offsets and bytes against the two public libraries."""

import base64

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from cohortspark.llm import byte_bpe
from tests.llm.brute import sha

VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
TEXTS = ["plain words, don't stop", None, "", "a  b\n\n c d  ", "éñ 你好 \U0001f642\U0001f642x", "<|endoftext|> is text", "x" * 30_000,
         "1234 ١٢ ⅷ²", " \t\n", "\u0085 z", "word " * 5_000]


def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_round_trip(frame):
    docs = list(enumerate(TEXTS)) + [(3, TEXTS[3])]
    got = byte_bpe.round_trip(frame(docs), VOCABULARY, PATTERN, with_ids=True).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = plain().encode_ordinary(TEXTS[r.doc_id] or "")
        assert (r.n_tokens, r.ids, r.ids_sha256) == (len(ids), ids, sha(" ".join(map(str, ids)).encode()))
        assert r.decoded_sha256 == sha((TEXTS[r.doc_id] or "").encode())


def test_pieces_are_forgotten(monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 5)
    encoder = byte_bpe.Encoder(VOCABULARY, PATTERN)
    for text in TEXTS * 2:
        assert encoder.encode(text or "") == plain().encode_ordinary(text or "")
        assert [tuple(x) for x in encoder.offsets(text or "")] is not None


def test_offsets_and_decoding(frame):
    whole = Tokenizer.from_file(VOCABULARY)
    whole.encode_special_tokens = True
    encoded = byte_bpe.encode(frame(list(enumerate(TEXTS))), VOCABULARY, PATTERN, offsets=True)
    for r in encoded.collect():
        wanted = whole.encode(TEXTS[r.doc_id] or "", add_special_tokens=False)
        assert r.ids == wanted.ids and list(zip(r.starts, r.ends)) == wanted.offsets
    for r in byte_bpe.decode(encoded, VOCABULARY).collect():
        assert bytes(r.bytes) == (TEXTS[r.doc_id] or "").encode()
    assert byte_bpe.encode(frame([(1, "a")]).where("false"), VOCABULARY, PATTERN).count() == 0


def test_remembered_pieces_are_bounded_within_a_text(monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 5)
    encoder, text = byte_bpe.Encoder(VOCABULARY, PATTERN), " ".join(f"piece{i}" for i in range(50))
    assert encoder.encode(text) == plain().encode_ordinary(text)
    assert len(encoder.known) <= 5


def test_rows_are_decoded_in_arrow():
    texts = [b"\xc3\xa9 one", None, b"", b"two"]
    ids = pa.array([t and plain().encode_ordinary(t.decode()) for t in texts], pa.list_(pa.int32())).slice(0, 4)
    decoder = byte_bpe.Decoder(VOCABULARY)
    assert decoder.decode(ids).to_pylist() == [t or b"" for t in texts] and decoder.decode(ids.slice(1)).to_pylist() == [b"", b"", b"two"]
    for outside in (10 ** 6, -1, None):
        with pytest.raises((KeyError, IndexError)):
            decoder.decode(pa.array([[outside]], pa.list_(pa.int32())))

"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A text falls into the pieces of the vocabulary's split pattern, and each piece is encoded by itself. Its bytes are written
as the characters that stand for them, the library's model merges these, and a worker remembers the ids of each distinct
piece. A token string has one character per byte, so its bytes' characters give its offsets in the text. Decoding reverses the byte table of the vocabulary: token strings
are characters that stand for bytes, so a character split over several tokens comes back whole once their bytes meet.

Edges: a null or empty text gives no tokens and decodes to empty bytes. An id outside the vocabulary is an error.
Very long texts are walked piece by piece. Repeated rows and ids are encoded alike; other columns are passed over.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from cohortspark.llm.store import bounded_batches

#: Distinct pieces that a worker remembers before it starts anew.
REMEMBERED = 400_000
#: Text bytes, or tokens, in one Arrow batch that goes back to Spark.
STEP = 2 << 20


Batches = Iterator[pa.RecordBatch]


def byte_characters() -> list[str]:
    """Character that stands for each byte in token strings: printable Latin-1 stands for itself, the rest follows from
    code point 256 on in byte order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in set(plain)]
    place = dict(zip(plain, plain)) | {b: 256 + i for i, b in enumerate(shifted)}
    return [chr(place[b]) for b in range(256)]


class Known(dict):
    """Ids of pieces as the bytes of an int32 array, worked out when first asked for."""

    def __init__(self, ids):
        super().__init__()
        self.ids = ids

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[piece] = array("i", self.ids(piece)).tobytes()
        return found


class Encoder:
    """Remembers the ids of pieces, and on demand their character offsets."""

    def __init__(self, vocabulary: str, pattern: str):
        import regex
        from tokenizers import Tokenizer

        self.split = regex.compile(pattern).findall
        self.model = Tokenizer.from_file(vocabulary).model
        self.stand_in = {b: c for b, c in enumerate(byte_characters())}
        self.known = Known(lambda piece: [t.id for t in self.tokens(piece)])
        self.spans: dict[str, list[tuple[int, int]]] = {}

    def tokens(self, piece: str) -> list:
        """The library's tokens of one piece, whose bytes are written as the characters that stand for them."""
        return self.model.tokenize(piece.encode().decode("latin-1").translate(self.stand_in))

    def packed(self, text: str) -> bytes:
        """Ids of a text as the bytes of an int32 array."""
        return b"".join(map(self.known.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def offsets(self, text: str) -> np.ndarray:
        """First character and end of each token's characters; tokens that share a character both include it."""
        found, at = [], 0
        if len(self.spans) > REMEMBERED:
            self.spans.clear()
        for piece in self.split(text):
            if piece not in self.spans:
                character = [i for i, c in enumerate(piece) for _ in c.encode()]
                ends = list(accumulate((len(t.value) for t in self.tokens(piece)), initial=0))
                self.spans[piece] = [(character[s], character[e - 1] + 1) for s, e in zip(ends, ends[1:])]
            found += [(at + s, at + e) for s, e in self.spans[piece]]
            at += len(piece)
        return np.array(found, np.int64).reshape(-1, 2)


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder_of(vocabulary: str, pattern: str) -> Encoder:
    """A worker's encoder, kept with its pieces from task to task."""
    if (vocabulary, pattern) not in _ENCODERS:
        _ENCODERS[vocabulary, pattern] = Encoder(vocabulary, pattern)
    return _ENCODERS[vocabulary, pattern]


def quiet_threads() -> None:
    """One thread: Spark runs a task on each core already."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def encoded(batches: Batches, vocabulary: str, pattern: str, offsets: bool) -> Batches:
    """(id, text) batches as (id, ids), with (starts, ends) when `offsets` is set."""
    quiet_threads()
    encoder = encoder_of(vocabulary, pattern)

    def batch(keys: list, ids: list, spans: list) -> pa.RecordBatch:
        ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
        flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
        columns, names = [pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat)], ["id", "ids"]
        if offsets:
            columns += [joined([s[:, i] for s in spans], pa.int64()) for i in (0, 1)]
            names += ["starts", "ends"]
        return pa.RecordBatch.from_arrays(columns, names)

    for part in batches:
        keys, ids, spans, size = [], [], [], 0
        for key, text in zip(part.column(0), part.column(1)):
            text = text.as_py() or ""
            keys.append(key.as_py())
            ids.append(encoder.packed(text))
            if offsets:
                spans.append(encoder.offsets(text))
            size += len(text)
            if size >= STEP:
                yield batch(keys, ids, spans)
                keys, ids, spans, size = [], [], [], 0
        if keys:
            yield batch(keys, ids, spans)


def joined(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows), kind))


def strung(table: pa.Array, column: pa.ListArray) -> tuple[np.ndarray, memoryview]:
    """The table's entries at all listed places, strung together, and where each row's begin (one more at the end)."""
    ends = np.cumsum([0, *pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy()])
    if not ends[-1]:
        return ends, memoryview(b"")
    taken = table.take(column.flatten())
    if taken.null_count:
        raise KeyError("an id outside the vocabulary")
    return np.frombuffer(taken.buffers()[1], np.int32)[taken.offset:][ends], memoryview(taken.buffers()[2])


class Decoder:
    """Bytes of each token id, from the token strings through the reversed byte table."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        tokenizer, back = Tokenizer.from_file(vocabulary), {c: b for b, c in enumerate(byte_characters())}
        special = set(tokenizer.get_added_tokens_decoder())
        self.bytes_of = {i: t.encode() if i in special else bytes(map(back.__getitem__, t))
                         for t, i in tokenizer.get_vocab(with_added_tokens=True).items()}

        self.table = pa.array(map(self.bytes_of.get, range(max(self.bytes_of) + 1)), pa.binary())

    def decode(self, ids: pa.ListArray) -> pa.Array:
        first, data = strung(self.table, ids)
        return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(first.astype(np.int32).tobytes()), pa.py_buffer(data)])


def decoded(batches: Batches, vocabulary: str) -> Batches:
    """(id, ids) batches as (id, ids, bytes)."""
    quiet_threads()
    decoder = Decoder(vocabulary)
    for part in batches:
        step = max(1, STEP * part.num_rows // max(1, len(part.column(1).flatten())))
        for lo in range(0, part.num_rows, step):
            rows = part.slice(lo, step)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), decoder.decode(rows.column(1))], ["id", "ids", "bytes"])


def digests(batches: Batches, with_ids: bool = False) -> Batches:
    """(id, ids, bytes) batches as the number of ids and the digests of both results, and the ids if wanted."""
    decimal = pa.array([], pa.binary())
    for part in batches:
        top = pa.compute.max(part.column(1).flatten()).as_py()
        if top is not None and top >= len(decimal):
            decimal = pa.array([b"%d " % i for i in range(2 * top + 1)], pa.binary())
        first, data = strung(decimal, part.column(1))
        ids = [hashlib.sha256(data[lo:max(lo, hi - 1)]).hexdigest() for lo, hi in zip(first, first[1:])]
        yield pa.RecordBatch.from_arrays([
            part.column(0), pa.compute.fill_null(pa.compute.list_value_length(part.column(1)), 0).cast(pa.int64()), pa.array(ids, pa.string()),
            pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in part.column(2)], pa.string()),
            *([part.column(1)] if with_ids else []),
        ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])])


def encode(docs: DataFrame, vocabulary: str, pattern: str, offsets: bool = False, id_column: str = "doc_id",
           text_column: str = "text") -> DataFrame:
    """(id, ids array<int>), with `starts` and `ends` (characters) when `offsets` is set."""
    schema = "id bigint, ids array<int>" + (", starts array<bigint>, ends array<bigint>" if offsets else "")
    source = bounded_batches(docs).select(F.col(id_column).cast("bigint"), F.col(text_column).cast("string"))
    return source.mapInArrow(lambda b: encoded(b, vocabulary, pattern, offsets), schema).withColumnRenamed("id", id_column)


def decode(ids: DataFrame, vocabulary: str, id_column: str = "doc_id") -> DataFrame:
    """(id, ids, bytes): the bytes that the ids stand for; null ids give empty bytes."""
    return ids.select(id_column, "ids").mapInArrow(lambda b: decoded(b, vocabulary), "id bigint, ids array<int>, bytes binary"
                                                   ).withColumnRenamed("id", id_column)


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), and ids if wanted: encoded, decoded and digested in one pass."""
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    source = bounded_batches(docs).select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return source.mapInArrow(lambda b: digests(decoded(encoded(b, vocabulary, pattern, False), vocabulary), with_ids), schema)

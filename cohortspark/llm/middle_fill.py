"""Fill-in-middle transformation by a displacement scatter over the bytes of Arrow batches, and its inverse.

A scan of a batch's bytes finds the units (white space with the word after it; white space at the end of a text is a unit of
its own) and with them the two cuts of each text. The output moves three segments of a text by three shifts, so a difference
array that holds the change of shift at each segment's first byte gives every byte its shift by a running sum, and one scatter
writes all outputs of the batch; the marks are scattered into the gaps. The inverse scans an output for its marks, builds the
same kind of array from them and gathers the text. Running sums go window by window, so that their memory does not grow with a text.

The cuts and the form come from a hash of a seed and the row's id, so they are the same on any partitioning.

Edges: a null text counts as empty; an empty text, or one that holds a mark, stays plain. A null id hashes as the empty string.
Repeated rows are cut alike. Very long texts are a portion of their own. Other columns are passed over. An empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from cohortspark.llm import wordkit as wk
from cohortspark.llm.store import bounded_batches

#: Marks of the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
FORMS = ("plain", "psm", "spm")
PLAIN, PSM, SPM = range(3)
#: Bytes whose shifts are summed at a time.
WINDOW = 1 << 20


def checked_marks(marks: tuple[str, str, str]) -> list[bytes]:
    """Marks as bytes. A mark's end must not be a mark's beginning, or a scan could find one that was never written."""
    found = [m.encode() for m in marks]
    for a in found:
        for b in found:
            if not a or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (a is not b))) or (a is not b and a in b):
                raise ValueError(f"marks {marks} are empty or overlap")
    return found


@dataclass
class Moves:
    """Runs of bytes and where they go: run i is input[start[i]:start[i] + size[i]], ascending, and moves by shift[i]."""

    start: np.ndarray
    size: np.ndarray
    shift: np.ndarray

    def targets(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, positions moved) of all bytes of all runs, a window at a time."""
        live = self.size > 0
        start, shift = self.start[live], self.shift[live]
        if not len(start):
            return
        change = np.diff(shift, prepend=0)
        stop = int(start[-1] + self.size[live][-1])
        inside = np.zeros(0, bool)
        ends = start + self.size[live]
        carried = 0
        for lo in range(int(start[0]), stop, WINDOW):
            hi = min(lo + WINDOW, stop)
            difference = np.zeros(hi - lo, np.int64)
            a, b = np.searchsorted(start, [lo, hi])
            difference[start[a:b] - lo] = change[a:b]
            shifts = np.cumsum(difference) + carried
            carried = int(shifts[-1])
            places = np.arange(lo, hi)
            if (ends[:-1] != start[1:]).any():
                inside = places < ends[np.searchsorted(start, places, "right") - 1]
                places, shifts = places[inside], shifts[inside]
            yield places, places + shifts


def unit_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """End of each unit, and the first unit of each row (one more at the end)."""
    w = wk.words(data, offsets)
    rows = np.flatnonzero(np.diff(offsets) > 0)
    trailing = rows[wk.SEPARATOR[data[offsets[rows + 1] - 1]]]
    ends = np.sort(np.concatenate([w.stop, offsets[trailing + 1]]))
    count = np.diff(w.first)
    count[trailing] += 1
    return ends, np.concatenate([[0], np.cumsum(count)])


@dataclass
class Cut:
    """Outputs of a portion: bytes and where each begins, with the form and the cuts (byte places in the texts) of each row."""

    data: np.ndarray
    offsets: np.ndarray
    units: np.ndarray
    form: np.ndarray
    first: np.ndarray
    second: np.ndarray


def scatter(data: np.ndarray, offsets: np.ndarray, held: np.ndarray, hashes: np.ndarray, marks: list[bytes], rate: int, spm_rate: int) -> Cut:
    """Transform the texts of a portion. held: rows whose text holds a mark; hashes: four integers a row."""
    ends, first_unit = unit_ends(data, offsets)
    units = np.diff(first_unit)
    chosen = np.sort(hashes[:, :2] % (units[:, None] + 1), axis=1)
    edges = np.concatenate([[0], ends])
    places = np.where(chosen > 0, edges[first_unit[:-1, None] + chosen], offsets[:-1, None])
    first, second = places[:, 0], places[:, 1]
    form = np.where(hashes[:, 3] % 100 < spm_rate, SPM, PSM)
    form[(units == 0) | held | (hashes[:, 2] % 100 >= rate)] = PLAIN
    p, s, m = map(len, marks)
    size = np.diff(offsets) + np.where(form == PLAIN, 0, p + s + m)
    begin = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(begin[-1], np.uint8)
    prefix, middle, suffix = first - offsets[:-1], second - first, offsets[1:] - second
    at = begin[:-1]
    to_prefix = at + np.choose(form, [0, p, s + suffix + p])
    to_middle = at + np.choose(form, [prefix, p + prefix + s + suffix + m, s + suffix + p + prefix + m])
    to_suffix = at + np.choose(form, [prefix + middle, p + prefix + s, s])
    runs = np.stack([offsets[:-1], first, second], 1).ravel()
    moves = Moves(runs, np.stack([prefix, middle, suffix], 1).ravel(), np.stack([to_prefix, to_middle, to_suffix], 1).ravel() - runs)
    for places, targets in moves.targets():
        out[targets] = data[places]
    cut = form != PLAIN
    for mark, after in zip(marks, (to_prefix, to_suffix, to_middle)):
        out[(after[cut, None] - len(mark)) + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    return Cut(out, begin, units, form, first, second)


def find_marks(data: np.ndarray, mark: bytes) -> np.ndarray:
    """Places where `mark` begins."""
    n = len(data) - len(mark) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    places = np.flatnonzero(data[:n] == mark[0])
    for k in range(1, len(mark)):
        places = places[data[places + k] == mark[k]]
    return places


def gather(data: np.ndarray, offsets: np.ndarray, form: np.ndarray, marks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts from outputs and forms alone: their bytes, and where each begins. A cut form without its marks is an error."""
    rows = np.flatnonzero(form != PLAIN)
    after = np.zeros((3, len(form)), np.int64)
    for k, mark in enumerate(marks):
        places = find_marks(data, mark)
        at = np.searchsorted(places, offsets[rows])
        if len(rows) and (at >= len(places)).any() or (places[at] + len(mark) > offsets[rows + 1]).any():
            raise ValueError(f"an output lacks its mark {mark.decode()}")
        after[k, rows] = places[at] + len(mark)
    p, s, m = after
    widths = np.array([len(x) for x in marks])
    stop = offsets[1:]
    # Prefix, suffix and middle in the order of the text; in psm the suffix ends at <M>, in spm it ends at <P>.
    run_p = np.where(form == PLAIN, offsets[:-1], p)
    end_p = np.choose(form, [stop, s - widths[1], m - widths[2]])
    run_m = np.where(form == PLAIN, stop, m)
    run_s = np.where(form == PLAIN, stop, s)
    end_s = np.choose(form, [stop, m - widths[2], p - widths[0]])
    sizes = np.stack([end_p - run_p, stop - run_m, end_s - run_s], 1)
    if (sizes < 0).any():
        raise ValueError("marks of an output stand in the wrong order")
    begin = np.concatenate([[0], np.cumsum(sizes.sum(1))])
    to = begin[:-1, None] + np.cumsum(sizes, 1) - sizes
    text = np.empty(begin[-1], np.uint8)
    # The runs ascend in the text, not in the output: the text's bytes look up their place there.
    moves = Moves(to.ravel(), sizes.ravel(), (np.stack([run_p, run_m, run_s], 1) - to).ravel())
    for places, sources in moves.targets():
        text[places] = data[sources]
    return text, begin


def binary_array(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType = pa.binary()) -> pa.Array:
    wide = pa.large_binary() if kind == pa.binary() else pa.large_string()
    return pa.Array.from_buffers(wide, len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)]).cast(kind)


def characters(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Code points in each range of bytes."""
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=sums[1:])
    return sums[stop] - sums[start]


TRANSFORMED = "id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def transformed(batches: Iterator[pa.RecordBatch], marks: tuple[str, str, str], rate: int, spm_rate: int) -> Iterator[pa.RecordBatch]:
    """(id, text, h1..h4) batches as TRANSFORMED."""
    written = checked_marks(marks)
    for part in wk.portions(batches):
        texts = part.column("text")
        data, offsets = wk.text_bytes(texts)
        held = np.zeros(len(texts), bool)
        for mark in marks:
            held |= pc.fill_null(pc.match_substring(texts, mark), False).to_numpy(zero_copy_only=False)
        hashes = np.stack([part.column(f"h{k}").to_numpy() for k in range(1, 5)], 1)
        cut = scatter(data, offsets, held, hashes, written, rate, spm_rate)
        plain = pa.array(cut.form == PLAIN)
        none = pa.scalar(None, pa.int64())
        yield pa.RecordBatch.from_arrays([
            part.column("id"), pa.array(cut.units), pa.array(np.array(FORMS, object)[cut.form], pa.string()),
            pc.if_else(plain, none, pa.array(characters(data, offsets[:-1], cut.first))),
            pc.if_else(plain, none, pa.array(characters(data, cut.first, cut.second))),
            binary_array(cut.data, cut.offsets, pa.string())], [f.split()[0] for f in TRANSFORMED.split(", ")])


def restored(batches: Iterator[pa.RecordBatch], marks: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
    """Batches with `form` and `output`, with one more column: the text rebuilt from the two."""
    written = checked_marks(marks)
    for part in wk.portions(batches, "output"):
        data, offsets = wk.text_bytes(part.column("output"))
        form = pc.fill_null(pc.index_in(part.column("form"), pa.array(FORMS)), -1).to_numpy().astype(np.int64)
        if (form < 0).any():
            raise ValueError("unknown form")
        text, begin = gather(data, offsets, form, written)
        yield pa.RecordBatch.from_arrays([*part.columns, binary_array(text, begin, pa.string())], [*part.schema.names, "restored"])


def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches whose `output` and `restored` give way to their digests, lower-case hexadecimal."""
    for part in batches:
        columns = dict(zip(part.schema.names, part.columns))
        for name in ("output", "restored"):
            data, offsets = wk.text_bytes(columns.pop(name))
            view = memoryview(data)
            columns[f"{name}_sha256"] = pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(offsets.tolist(), offsets[1:].tolist())], pa.string())
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def row_hashes(id_column: Column, seed: int) -> list[Column]:
    """First four groups of eight digits of the SHA-256 of the seed, a colon and the decimal id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"h{k + 1}") for k in range(4)]


def hashed(docs: DataFrame, id_column: str, text_column: str, seed: int) -> DataFrame:
    return bounded_batches(docs).select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text"),
                                        *row_hashes(F.col(id_column).cast("bigint"), seed))


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, marks: tuple[str, str, str] = MARKS,
              id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output). `rate` percent of the texts are cut, `spm_rate` percent of these
    into suffix, prefix, middle and the rest into prefix, suffix, middle."""
    checked_marks(marks)
    return (hashed(docs, id_column, text_column, seed).mapInArrow(lambda b: transformed(b, marks, rate, spm_rate), TRANSFORMED)
            .withColumnRenamed("id", id_column))


def restore(outputs: DataFrame, marks: tuple[str, str, str] = MARKS, id_column: str = "doc_id") -> DataFrame:
    """(id, form, output, restored) from (id, form, output)."""
    checked_marks(marks)
    source = bounded_batches(outputs).select(F.col(id_column).cast("bigint").alias("id"), "form", "output")
    return source.mapInArrow(lambda b: restored(b, marks), "id bigint, form string, output string, restored string").withColumnRenamed("id", id_column)


def digests(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, marks: tuple[str, str, str] = MARKS,
            id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256): transformed, restored and digested in one pass."""
    checked_marks(marks)
    schema = TRANSFORMED.replace("output string", "output_sha256 string, restored_sha256 string")
    return (hashed(docs, id_column, text_column, seed)
            .mapInArrow(lambda b: digested(restored(transformed(b, marks, rate, spm_rate), marks)), schema)
            .withColumnRenamed("id", id_column))

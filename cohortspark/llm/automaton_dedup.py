"""Removal of long word runs that an earlier document has, by suffix automata of reference shards.

A shard is the set of passages that share an anchor (see `passages`), so its size is bounded and no automaton of the whole
corpus is ever broadcast. The shard's automaton accepts every run of words in it, and each state knows the smallest id
of the documents that hold its runs. The passages are then streamed over it: matching statistics held at `window` words
give, for each window, the smallest id in the corpus. Covered words of a document, as maximal spans, are removed.

Edges: null and empty texts have no words and stay as they are. Fewer words than the window: nothing is removed. Words
are compared byte by byte. Documents with equal ids are no reason for removal between each other; rows without id rank
after all others. Repeated rows give repeated result rows. Other columns are passed over, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortspark.llm import passages as ps, wordkit as wk

#: Passage bytes after which a worker sends results on.
STEP = 1 << 20


class SuffixAutomaton:
    """Suffix automaton of several word lists. `low[state]` is the smallest label of the lists with the state's runs."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.low = [-1], [0], [ps.LAST]

    def add(self, sequence: list, label: int) -> None:
        """Lists come with labels that do not fall, so the first label of a state is its smallest but for `finish`."""
        nxt, link, length, low = self.next, self.link, self.length, self.low
        last = 0
        for unit in sequence:
            known = nxt[last].get(unit)
            if known is not None:
                last = known if length[known] == length[last] + 1 else self.split(last, unit, known)
                continue
            made = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            low.append(label)
            at = last
            while at >= 0 and unit not in nxt[at]:
                nxt[at][unit] = made
                at = link[at]
            if at >= 0:
                target = nxt[at][unit]
                link[made] = target if length[target] == length[at] + 1 else self.split(at, unit, target)
            last = made

    def split(self, at: int, unit, target: int) -> int:
        """A state of its own for the shorter runs of `target` that end a run of `at` plus `unit`."""
        nxt, link = self.next, self.link
        made = len(nxt)
        nxt.append(dict(nxt[target]))
        link.append(link[target])
        self.length.append(self.length[at] + 1)
        self.low.append(self.low[target])
        link[target] = made
        while at >= 0 and nxt[at].get(unit) == target:
            nxt[at][unit] = made
            at = link[at]
        return made

    def finish(self) -> None:
        """Carry labels to the states of shorter runs."""
        low, link = self.low, self.link
        for state in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            if low[state] < low[link[state]]:
                low[link[state]] = low[state]

    def stream(self, sequence: list, window: int) -> list[int]:
        """Smallest label for each run of `window` units of `sequence`, LAST where the automaton lacks the run."""
        nxt, link, length, low = self.next, self.link, self.length, self.low
        state, matched, found = 0, 0, []
        for unit in sequence:
            while state and unit not in nxt[state]:
                state = link[state]
                matched = length[state]
            if unit in nxt[state]:
                state = nxt[state][unit]
                matched += 1
            while state and length[link[state]] >= window:
                state = link[state]
                matched = length[state]
            found.append(low[state] if matched >= window else ps.LAST)
        return found[window - 1:]


def smallest_ids(rows: DataFrame, window: int) -> DataFrame:
    """For each passage the smallest id of every window, as 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in ps.grouped(batches, STEP):
            out, lo = {c: [] for c in [*ps.FOUND]}, 0
            while lo < len(held):
                hi = lo + 1
                while hi < len(held) and held[hi]["anchor"] == held[lo]["anchor"]:
                    hi += 1
                group = sorted(held[lo:hi], key=lambda r: r["lo"])
                lo = hi
                if group[0]["lo"] == max(r["hi"] for r in group):
                    continue
                shard, lists = SuffixAutomaton(), [r["passage"].split() for r in group]
                for r, sequence in zip(group, lists):
                    shard.add(sequence, r["lo"])
                shard.finish()
                for r, sequence in zip(group, lists):
                    lows = np.array(shard.stream(sequence, window), np.int64)
                    for c, v in zip(ps.FOUND, (r["anchor"], r["seg"], 0, r["n"], r["id"], r["key"], r["at"], int(lows.min()), lows.tobytes())):
                        out[c].append(v)
            if out["n"]:
                yield pa.RecordBatch.from_arrays([pa.array(out[c], kinds[c]) for c in ps.FOUND], ps.FOUND)

    kinds = {c: pa.int64() for c in ps.FOUND} | {"shift": pa.int32(), "found": pa.binary()}
    return ps.together(rows).mapInArrow(run, "anchor bigint, seg bigint, shift int, n bigint, id0 bigint, key0 bigint, at0 bigint, "
                                             "least bigint, found binary")


def remove_repeated_words(docs: DataFrame, window: int = 50, gram: int = 8, group: int = ps.GROUP, id_column: str = "doc_id",
                          text_column: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept, spans): kept words joined by one space, and the removed word ranges [start, stop)."""
    found = ps.matches(ps.with_key(docs, id_column, text_column), ps.Unit("word", window, gram),
                       lambda rows: smallest_ids(rows, window), True, F.col("least") < F.col("id"), ["shift", "found"], group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in ps.unpacked(batches):
            counts, removed, kept, spans = [], [], [], []
            for text, own, hits in zip(texts, part.column("id").to_pylist(), part.column("hits").to_pylist()):
                w = text.split()
                counts.append(len(w))
                starts = [h["at"] + p["shift"] + np.flatnonzero(np.frombuffer(p["found"], np.int64) < own) for h in hits or [] for p in h["pieces"]]
                if starts:
                    gone = wk.covered(len(w), np.concatenate(starts), window)
                    edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))).reshape(-1, 2)
                    w = list(compress(w, (~gone).tolist()))
                    removed.append(int(gone.sum()))
                    spans.append([{"start": int(a), "stop": int(b)} for a, b in edge])
                else:
                    removed.append(0)
                    spans.append([])
                kept.append(b" ".join(w).decode())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
                [id_column, "n_words", "n_removed", "kept", "spans"])

    return found.mapInArrow(run, f"`{id_column}` bigint, n_words bigint, n_removed bigint, kept string, "
                                 "spans array<struct<start:bigint,stop:bigint>>")

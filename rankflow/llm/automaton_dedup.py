"""Operator 7: repeated word windows, by suffix automata of reference shards.

A reference shard holds the classes of contexts around repeated anchors (see repeats.py); its size is bounded,
whatever the corpus. Its suffix automaton knows every word sequence of the shard, and for each state the earliest
place where the sequence ends. The shard's contexts are streamed through it: matching statistics give the
longest known sequence at each word, the suffix links shorten it to the window, and the window is a repeat if its
earliest place comes before the context's own. All later members of a class repeat its first one as a whole.
Windows of an anchor too frequent for one shard are dealt by the words they share (see repeats.py).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.llm.common import offsets, sliced
from rankflow.llm.repeats import Windows, covered, keyed_rows, repeated_spans, span_lists, unpack, unpacked_sizes, window_runs

GRAM = 5
SHARD_BYTES = 1 << 19
HOT_CLASSES = 4096
NEVER = 1 << 62


class SuffixAutomaton:
    """All subsequences of a set of sequences, with the earliest end of each. Ends are numbers; smaller is earlier."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.earliest = [NEVER]

    def add(self, sequence: list[int], first_end: int) -> None:
        """Add a sequence whose words end at first_end, first_end + 1, ..."""
        nexts, link, length, earliest = self.next, self.link, self.length, self.earliest
        last = 0
        for end, word in enumerate(sequence, first_end):
            known = nexts[last].get(word)
            if known is not None:
                if length[known] == length[last] + 1:
                    last = known
                else:
                    last = self._split(last, word, known)
                if end < earliest[last]:
                    earliest[last] = end
                continue
            new = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            earliest.append(end)
            link.append(0)
            p = last
            while p >= 0 and word not in nexts[p]:
                nexts[p][word] = new
                p = link[p]
            if p >= 0:
                q = nexts[p][word]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, word, q)
            last = new

    def _split(self, p: int, word: int, q: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        copy = len(nexts)
        nexts.append(dict(nexts[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        self.earliest.append(NEVER)
        while p >= 0 and nexts[p].get(word) == q:
            nexts[p][word] = copy
            p = link[p]
        link[q] = copy
        return copy

    def finish(self) -> None:
        """Carry the earliest ends from longer sequences to their suffixes."""
        earliest, link = self.earliest, self.link
        for state in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            up = link[state]
            if earliest[state] < earliest[up]:
                earliest[up] = earliest[state]

    def window_ends(self, sequence: list[int], window: int) -> list[int]:
        """For each window of the sequence the earliest end of equal words; NEVER if there is none."""
        nexts, link, length, earliest = self.next, self.link, self.length, self.earliest
        state = matched = 0
        out = []
        for i, word in enumerate(sequence, 1):
            while state and word not in nexts[state]:
                state = link[state]
                matched = length[state]
            to = nexts[state].get(word)
            if to is None:
                state = matched = 0
            else:
                state = to
                matched += 1
            if matched > window:  # longer context is of no use: the state of the window's own length
                matched = window
            while state and length[link[state]] >= window:
                state = link[state]
            if i >= window:
                out.append(earliest[state] if matched >= window else NEVER)
        return out


def shard_spans(window: int):
    def work(classes: pa.Table) -> pa.RecordBatch:
        ident, row, first = (classes.column(c).to_numpy() for c in ("id", "row", "start"))
        words: dict[bytes, int] = {}
        cut = [c.split() for c in classes.column("content").to_pylist()]
        sequences = [[words.setdefault(w, len(words)) for w in c] for c in cut]
        # A place is a number that orders like (id, row, place in the text).
        text = np.unique(np.stack([ident, row], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
        begin = (text.astype(np.int64) << 36) | first
        automaton = SuffixAutomaton()
        for at, sequence in zip(begin.tolist(), sequences, strict=True):
            automaton.add(sequence, at + 1)
        automaton.finish()
        ends = [automaton.window_ends(s, window) for s in sequences]
        windows = np.fromiter(map(len, ends), np.int64, len(ends))
        owner = np.repeat(np.arange(len(ends)), windows)
        offset = np.arange(len(owner)) - offsets(windows)[:-1][owner]
        earliest = np.fromiter((e for x in ends for e in x), np.int64, len(owner))
        place = first[owner] + offset
        repeated = earliest < begin[owner] + offset + window
        return window_runs(repeated, owner, row, place, window)

    return work


def repeated_word_spans(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, candidate texts, spans): keyed rows, packed texts with repeats, and word spans to remove per row."""
    rows = keyed_rows(docs, id_col, text_col)
    kind = Windows(window, min(GRAM, window), words=True)
    texts, spans = repeated_spans(rows, kind, shard_spans(window), SHARD_BYTES, HOT_CLASSES)
    return rows, texts, span_lists(spans)


def _changed(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(row, n_removed, kept) of texts that lose words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, sizes=unpacked_sizes):
            out = []
            for row, packed, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = unpack(packed).split()
                gone = covered(parts, len(words))
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                out.append((row, int(gone.sum()), kept))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["row", "n_removed", "kept"])

    return texts.join(spans, "row").select("row", "packed", "spans").mapInArrow(cut, "row long, n_removed long, kept binary")


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per row of docs.

    Words are parted by ASCII white space and unchanged. Each word covered by a ``window``-word sequence that also
    starts earlier (smaller id, or same text further left) is removed; judged on the input. A null text has no
    words. Ids may be null (the smallest) or repeated (ordered by their row number). Other columns are not read.
    """
    rows, texts, spans = repeated_word_spans(docs, window, id_col, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            words = [t.split() for t in batch.column(2).to_pylist()]
            sha = pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(map(len, words), pa.int64()), sha], names=["row", "id", "n_words", "whole"])

    whole = rows.mapInArrow(count, "row long, id long, n_words long, whole string")
    changed = _changed(texts, spans).select("row", "n_removed", F.sha2("kept", 256).alias("sha"))
    return whole.join(changed, "row", "left").select(
        F.col("id").alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("sha", "whole").alias("kept_sha256")
    )

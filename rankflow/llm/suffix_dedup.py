"""Operator 3: byte spans that occur more than once, by suffix arrays of shards.

The shards hold the classes of contexts around repeated anchors (see repeats.py). In a shard the contexts are
one array: its suffixes are sorted by Larsson-Sadakane refinement in numpy (groups of equal rank are split by
the ranks further on, until none is left), and Kasai's common prefixes, computed for
many stretches of the text side by side, cut the order into runs of windows with equal bytes. A run repeats if
its contexts have two members together. Shards are merged before they are sorted: equal windows of an anchor too
frequent for one shard are brought together by the bytes they share (see repeats.py).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.llm.common import offsets, ragged, sliced
from rankflow.llm.repeats import Windows, covered, keyed_rows, repeated_spans, span_lists, unpack, unpacked_sizes, window_runs

GRAM = 32
SHARD_BYTES = 1 << 20
HOT_CLASSES = 2048
LANES = 1 << 13


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffixes of a byte array in order.

    The first ranks come from seven bytes, as values from 1, so that the end is below a NUL byte. Then only groups of equal rank are refined, by the rank h further on,
    which doubles the sorted depth. Below 2^21 bytes the rank 2h further on fits into the key too, which triples
    it. It goes on until no group is left: Kasai's prefixes need the true order.
    """
    n = len(text)
    triple = n < (1 << 21) - 1
    padded = np.r_[text.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64)]
    key = np.zeros(n, np.uint64)
    for i in range(7):
        key = (key << np.uint64(9)) | padded[i : i + n]
    order = np.argsort(key)
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # first place of each place's group
    rank = np.zeros(n + 1, np.int64)  # 1-based, 0 beyond the end
    rank[order] = group + 1
    h = 7
    open_at = np.flatnonzero(~new | ~np.r_[new[1:], True])  # places in groups of two or more
    while len(open_at):
        at = order[open_at]
        keys = (group[open_at] << (21 if triple else 32)) | rank[np.minimum(at + h, n)]
        if triple:
            keys = (keys << 21) | rank[np.minimum(at + 2 * h, n)]
        by = np.argsort(keys)
        keys, at = keys[by], at[by]
        order[open_at] = at
        new = np.r_[True, keys[1:] != keys[:-1]]
        start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        group[open_at] = open_at[start]
        rank[at] = group[open_at] + 1
        open_at = open_at[~new | ~np.r_[new[1:], True]]
        h *= 3 if triple else 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Kasai's common prefix of each suffix with the one before it in the order, up to ``cap``.

    In text order the value falls by one at most from a suffix to the next, so it is carried along; LANES
    stretches of the text are walked side by side, comparing eight bytes at a time.
    """
    n = len(text)
    padded = np.r_[text, np.zeros(8, np.uint8)].astype(np.uint64)
    eight = np.zeros(n + 1, np.uint64)
    for i in range(8):
        eight[:n] = (eight[:n] << np.uint64(8)) | padded[i : i + n]
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int64)
    lanes = min(LANES, n)
    step = -(-n // lanes)
    lane = np.arange(lanes) * step
    length = np.zeros(lanes, np.int64)
    for t in range(step):
        here = lane + t
        live = np.flatnonzero(here < n)
        i = here[live]
        j = before[i]
        now = np.maximum(length[live] - 1, 0)
        now[j < 0] = 0
        most = np.minimum(cap, n - np.maximum(i, j))
        go = np.flatnonzero((j >= 0) & (now < most))
        while len(go):
            differ = eight[i[go] + now[go]] ^ eight[j[go] + now[go]]
            same = differ == 0
            # Equal bytes before the first difference.
            part = (differ.astype(">u8").view(np.uint8).reshape(-1, 8) != 0).argmax(1)
            now[go] = np.minimum(now[go] + np.where(same, 8, part), most[go])
            go = go[same & (now[go] < most[go])]
        length[live] = now
        out[i] = now
    return out[order]


def shard_spans(window: int):
    def work(classes: pa.Table) -> pa.RecordBatch:
        contents = classes.column("content").to_pylist()
        size = np.fromiter(map(len, contents), np.int64, len(contents))
        begin = offsets(size)
        text = np.frombuffer(b"".join(contents), np.uint8)
        n, row, first, windows = (classes.column(c).to_numpy() for c in ("n", "row", "start", "windows"))
        order = suffix_array(text)
        prefix = common_prefixes(text, order, window)
        run = np.zeros(len(text), np.int64)
        run[order] = np.cumsum(prefix < window)
        # The windows of a class: where they start in the array, their run and its members over all classes.
        at = ragged(begin[:-1], windows)
        owner = np.repeat(np.arange(len(n)), windows)
        members = np.bincount(run[at], n[owner], len(text) + 1)
        repeated = members[run[at]] >= 2
        place = at - begin[owner] + first[owner]
        return window_runs(repeated, owner, row, place, window)

    return work


def repeated_byte_spans(docs: DataFrame, window: int = 400, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, candidate texts, spans): keyed rows, packed texts with repeats, and byte spans to remove per row."""
    rows = keyed_rows(docs, id_col, text_col)
    kind = Windows(window, min(GRAM, window), words=False)
    texts, spans = repeated_spans(rows, kind, shard_spans(window), SHARD_BYTES, HOT_CLASSES)
    return rows, texts, span_lists(spans)


def remove_repeats(docs: DataFrame, window: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) per row of docs.

    Each byte covered by a ``window``-byte string that starts anywhere else too, same text included, is removed;
    judged on the input. A null text is empty; ids may be null or repeated (each row is a text of its own). kept:
    the remaining bytes, null where nothing is removed. Other columns are not read.
    """
    rows, texts, spans = repeated_byte_spans(docs, window, id_col, text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, sizes=unpacked_sizes):
            out = []
            for row, packed, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = np.frombuffer(unpack(packed), np.uint8)
                gone = covered(parts, len(text))
                kept = text[~gone].tobytes()
                out.append((row, int(gone.sum()), int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["row", "n_removed", "n_spans", "sha", "kept"])

    changed = texts.join(spans, "row").select("row", "packed", "spans").mapInArrow(cut, "row long, n_removed long, n_spans long, sha string, kept binary")
    whole = rows.select("row", "id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    zero = F.lit(0).cast("long")
    return whole.join(changed, "row", "left").select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("sha", "whole").alias("kept_sha256"),
        "kept",
    )

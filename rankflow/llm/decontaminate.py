"""Operator 5: benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over successive words that ignores some positions, so a substituted word there does not
hide a match. The hashes of all seeds of the benchmark are one side of the join; training texts are streamed
against them, since benchmarks are small: a block of at most BLOCK_WORDS words is sent to the tasks at a time,
and larger benchmarks take several passes. Around each hit, text and item are aligned on the hit's diagonal and
the run with most equal words is verified, with substitutions up to one word in five of the whole run, wherever
they are. Items of fewer than SHORTEST_ITEM words have to be there word by word.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.llm.common import offsets, ragged, sliced, text_bytes

#: Any run of SHORTEST_ITEM words or more with one substitution in five has a hit of one of these.
MASKS = ("1111", "11011", "101011", "110101", "1100011")
MIN_WORDS = 12
SHORTEST_ITEM = 8
SIMILARITY = 0.8
MISMATCH = 4  # matches that make up for a mismatch at SIMILARITY
BLOCK_WORDS = 1 << 20
FILTER_BITS = 22
PRIME = np.uint64(0x9E3779B97F4A7C15)
TO_SPACE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


UNSPACED = ("CJK UNIFIED", "CJK COMPATIBILITY IDEOGRAPH", "HIRAGANA", "KATAKANA", "HALFWIDTH KATAKANA", "BOPOMOFO", "THAI ", "LAO ", "TIBETAN", "MYANMAR", "KHMER", "NEW TAI LUE", "TAI ")


class _ToWords(dict):
    """For str.translate: letters, marks and numbers stay, format characters go, those of scripts written without
    spaces are words of their own, and all else is space."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        kind = unicodedata.category(c)
        if kind[0] in "LMN":
            to = f" {c} " if unicodedata.name(c, "").startswith(UNSPACED) else c
        else:
            to = None if kind == "Cf" else " "
        self[code] = to
        return to


TO_WORDS = _ToWords()


def words_of(text: str) -> list[bytes]:
    """Lower-cased words without signs; single characters in scripts written without spaces."""
    low = text.lower()
    if low.isascii():
        return low.encode().translate(TO_SPACE).split()
    return low.translate(TO_WORDS).encode("utf-8", "replace").split()


def words_needed(n: int) -> int:
    """Equal words that make an overlap with an item of n words."""
    return n if n < SHORTEST_ITEM else min(MIN_WORDS, -(-4 * n // 5))


def mask_hashes(ids: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) where all words under the mask are known (above 0)."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    on = [i for i, c in enumerate(mask) if c == "1"]
    at = np.flatnonzero(ids[:n] > 0)
    for i in on[1:]:
        at = at[ids[at + i] > 0]
    h = np.full(len(at), len(mask), np.uint64)
    for i in on:
        h = (h ^ ids[at + i].astype(np.uint64)) * PRIME
        h ^= h >> np.uint64(29)
    return at, h


@dataclass
class SeedTable:
    """The seeds of one benchmark block, and its items as word numbers."""

    vocabulary: dict[bytes, int]
    item_ids: list[int | None]
    words: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray
    places: np.ndarray  # into words, in the order of hashes
    filter: np.ndarray
    masks: tuple[str, ...]

    def hits(self, texts: list[str]) -> list[tuple[int, int, int, int, int, int, float]]:
        """(text, item, matched words, run words, start in text, start in item, similarity), best run per text and item."""
        cut = [words_of(t) for t in texts]
        count = np.fromiter(map(len, cut), np.int64, len(cut))
        known = self.vocabulary.get
        # Zeros between texts keep seeds from reaching over.
        gap = max(map(len, MASKS))
        begin = offsets(count + gap)[:-1]
        ids = np.zeros(int(count.sum()) + gap * len(cut), np.int64)
        ids[ragged(begin, count)] = np.fromiter((known(w, 0) for x in cut for w in x), np.int64, int(count.sum()))
        found = []
        for mask in self.masks:
            at, h = mask_hashes(ids, mask)
            maybe = self.filter[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
            at, h = at[maybe], h[maybe]
            low, high = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
            place = self.places[ragged(low, high - low)]
            at = np.repeat(at, high - low)
            found.append(np.stack([at - place, np.searchsorted(self.bounds, place, "right") - 1, np.searchsorted(begin, at, "right") - 1], axis=1))
        best: dict[tuple[int, int], tuple] = {}
        for shift, item, text in np.unique(np.concatenate(found), axis=0).tolist() if found else []:
            a, b = int(self.bounds[item]), int(self.bounds[item + 1])
            if b - a < SHORTEST_ITEM and (text, item) in best:  # whole, and the first in the text
                continue
            start = max(a, int(begin[text]) - shift)
            end = min(b, int(begin[text] + count[text]) - shift)
            equal = self.words[start:end] == ids[start + shift : end + shift]
            run = best_run(equal)
            if run is None:
                continue
            lo, hi = run
            matched, n = int(equal[lo:hi].sum()), hi - lo
            if matched >= words_needed(b - a):
                row = (matched, n, start + lo + shift - int(begin[text]), start + lo - a, matched / n)
                if (text, item) not in best or (row[0], -row[2], -row[3]) > (best[text, item][0], -best[text, item][2], -best[text, item][3]):
                    best[text, item] = row
        return [(*key, *row) for key, row in sorted(best.items())]


def best_run(equal: np.ndarray) -> tuple[int, int] | None:
    """Bounds of the run with most matches among those with SIMILARITY; the shortest, then the first of equals."""
    if not equal.any():
        return None
    total = np.r_[0, np.cumsum(np.where(equal, 1, -MISMATCH))]
    matches = np.r_[0, np.cumsum(equal)]
    # For each end, the first start from where matches make up for all mismatches.
    start = np.searchsorted(-np.minimum.accumulate(total), -total, "left")
    found = matches - matches[start]
    ends = np.flatnonzero(found == found.max())
    at = np.flatnonzero(equal)
    # Between its first and its last match.
    low = at[matches[start[ends]]]
    high = at[matches[ends] - 1] + 1
    best = int(np.argmin(high - low))
    return int(low[best]), int(high[best])


def seed_table(items: list[tuple[int | None, str | None]]) -> SeedTable:
    """Null texts and those without words have no seeds; an item shorter than SHORTEST_ITEM is a seed as a whole."""
    cut = [(i, w) for i, t in items if (w := words_of(t or ""))]
    vocabulary: dict[bytes, int] = {}
    words = np.array([vocabulary.setdefault(x, len(vocabulary) + 1) for _, w in cut for x in w], np.int64)
    bounds = offsets(np.array([len(w) for _, w in cut], np.int64))
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    size = np.diff(bounds)
    masks = tuple(dict.fromkeys((*MASKS, *("1" * n for n in np.unique(size[size < SHORTEST_ITEM]).tolist()))))
    for mask in masks:
        at, h = mask_hashes(words, mask)
        item = np.searchsorted(bounds, at, "right") - 1
        inside = item == np.searchsorted(bounds, at + len(mask) - 1, "right") - 1
        whole = "0" not in mask and size[item] == len(mask)
        inside &= whole | (size[item] >= SHORTEST_ITEM if mask in MASKS else False)
        hashes.append(h[inside])
        places.append(at[inside])
    hashes, places = np.concatenate(hashes), np.concatenate(places)
    order = np.argsort(hashes, kind="stable")
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    return SeedTable(vocabulary, [i for i, _ in cut], words, bounds, hashes[order], places[order], bits, masks)


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[SeedTable]:
    """Seed tables of at most about BLOCK_WORDS words each, whatever the size of the benchmark."""
    rows = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    held, size = [], 0
    for row in rows.sort("id", "text").toLocalIterator():
        held.append((row.id, row.text))
        size += len(words_of(row.text or "")) + 1
        if size >= BLOCK_WORDS:
            yield seed_table(held)
            held, size = [], 0
    if held:
        yield seed_table(held)


HIT_SCHEMA = "doc_id long, item_id long, matched_words long, run_words long, doc_start long, item_start long, similarity double"


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item with a verified overlap: the longest, its place in words of both.

    A null or empty text has none, nor has an empty benchmark. Repeated rows each have their own; null ids stay
    null. Other columns are not read. Texts are streamed once per block; nothing is shuffled.
    """
    names = [c.split()[0] for c in HIT_SCHEMA.split(", ")]

    def task(seeds: SeedTable):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, 1, 1 << 20):
                hits = seeds.hits([t.decode("utf-8", "replace") for t in batch.column(1).to_pylist()])
                columns = list(zip(*hits, strict=True)) or [()] * 7
                out = [batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array([seeds.item_ids[i] for i in columns[1]], pa.int64())]
                out += [pa.array(c, pa.int64()) for c in columns[2:6]]
                yield pa.RecordBatch.from_arrays([*out, pa.array(columns[6], pa.float64())], names=names)

        return run

    rows = docs.select(F.col(f"`{id_col}`").cast("long"), text_bytes(text_col))
    found = [rows.mapInArrow(task(seeds), HIT_SCHEMA) for seeds in benchmark_blocks(benchmark)]
    out = found[0] if found else rows.sparkSession.createDataFrame([], HIT_SCHEMA)
    for more in found[1:]:
        out = out.union(more)
    return out


def without_overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text overlaps no benchmark item. Null and empty texts stay."""
    keep = [F.col(f"`{c}`") for c in docs.columns]
    schema = docs.select(*keep).schema
    kept = [F.col(f"`{c}`") for c in schema.names]

    def task(seeds: SeedTable):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, 0, 1 << 20):
                clean = np.ones(batch.num_rows, bool)
                clean[[h[0] for h in seeds.hits([t.decode("utf-8", "replace") for t in batch.column(0).to_pylist()])]] = False
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(clean)) for c in batch.columns[1:]], names=schema.names)

        return run

    out = docs.select(text_bytes(text_col), *keep)
    for seeds in benchmark_blocks(benchmark):
        out = out.mapInArrow(task(seeds), schema).select(text_bytes(text_col), *kept)
    return out.select(*kept)

"""Operator 10: token counts of a sentencepiece BPE model by rank-synchronous array merging.

Texts are cut into pre-tokens where no piece of the vocabulary can cross. The distinct pre-tokens of a batch
are one ragged numpy array of symbols; in each round every sequence merges the occurrences of its own pair of
lowest rank, all sequences at the same time, until none has a pair left. What survives is counted: a piece is
one token, a symbol outside the vocabulary one token per UTF-8 byte.
"""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.llm.common import sliced, text_bytes

SPACE = "▁"  # fixed value: the sign that the format writes for a space
CACHE_WORDS = 400_000
NO_RANK = np.iinfo(np.int64).max
#: Runs of spaces, each with the word after it: no piece has a space sign after another character.
PRE_TOKEN = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class PieceMerges:
    """Ranks of all mergeable pairs of a model, in hashed slots."""

    def __init__(self, model_file: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or trainer.model_type != 2:
            raise ValueError("only BPE models without text normalization are supported")
        self.prefix = norm.add_dummy_prefix
        normal = [(p.piece, p.score) for p in proto.pieces if p.type == 1]
        if not trainer.byte_fallback or any(p.type in (4, 5) for p in proto.pieces) or any(SPACE in p.lstrip(SPACE) for p, _ in normal):
            raise ValueError("only byte fallback, no user symbols and no spaces inside pieces are supported")
        self.ids = {p: i for i, (p, _) in enumerate(normal)}
        rank = {s: i for i, s in enumerate(sorted({s for _, s in normal}, reverse=True))}
        pairs = []
        for piece, score in normal:
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    pairs.append((left << 32 | right, rank[score], self.ids[piece]))
        table = np.array(sorted(pairs), np.int64).reshape(-1, 3)
        self.keys, self.ranks, self.merged = (np.ascontiguousarray(table[:, i]) for i in range(3))
        self._hash_pairs()
        #: Symbol of every character: a piece, or minus the number of its UTF-8 bytes.
        point = np.arange(sys.maxunicode + 1)
        self.by_char = -(1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)).astype(np.int64)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.by_char[ord(piece)] = i

    def _hash_pairs(self) -> None:
        """Open addressing: row of each pair in a table of slots, -1 where none is."""
        self.bits = max(8, int(len(self.keys)).bit_length() + 3)
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(self.keys)), self._slot(self.keys)
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            lost = self.slots[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of pairs of symbols; NO_RANK where they do not merge. Unknown symbols are negative."""
        rank, merged = np.full(len(left), NO_RANK), np.zeros(len(left), np.int64)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        key = left[at] << 32 | right[at]
        slot = self._slot(key)
        while len(at):
            row = self.slots[slot]
            hit = (row >= 0) & (self.keys[row] == key)
            rank[at[hit]], merged[at[hit]] = self.ranks[row[hit]], self.merged[row[hit]]
            more = (row >= 0) & ~hit
            at, key, slot = at[more], key[more], (slot[more] + 1) & ((1 << self.bits) - 1)
        return rank, merged

    def count(self, words: list[str]) -> np.ndarray:
        """Number of tokens of each pre-token; none of them is empty."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self.by_char[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        owner = np.repeat(np.arange(len(words)), length)
        total = np.zeros(len(words), np.int64)
        # Of the pair that begins at each symbol; a sequence's last symbol begins none.
        rank, merged = self.pair_rank(symbol, np.append(symbol[1:], -1))
        rank[np.append(owner[1:] != owner[:-1], True)] = NO_RANK
        while len(symbol):
            start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.repeat(np.minimum.reduceat(rank, start), np.diff(np.append(start, len(symbol))))
            done = lowest == NO_RANK
            if done.any():
                total += np.bincount(owner[done], np.maximum(-symbol[done], 1), len(words)).astype(np.int64)
                symbol, owner, rank, merged, lowest = (x[~done] for x in (symbol, owner, rank, merged, lowest))
            at = np.flatnonzero(rank == lowest)
            # Of overlapping occurrences (a a a) every second one merges, from the left.
            run = np.append(True, np.diff(at) > 1)[: len(at)]
            first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            step = self._merge(symbol, owner, rank, merged, at)
            # Where a merge makes a pair of a lower rank, that pair goes before the other occurrences: one step only.
            clash = self._lower(*step[1:3], lowest[at], step[4])
            if len(clash):
                alone = np.append(True, owner[at][1:] != owner[at][:-1])
                at = at[alone | ~np.isin(owner[at], clash)]
                step = self._merge(symbol, owner, rank, merged, at)
            symbol, owner, rank, merged, _ = step
        return total

    def _merge(self, symbol, owner, rank, merged, at):
        """The arrays after the pairs at ``at`` have become symbols, and where those are now."""
        keep = np.ones(len(symbol), bool)
        keep[at + 1] = False
        symbol = symbol.copy()
        symbol[at] = merged[at]
        now = at - np.arange(len(at))
        symbol, owner, rank, merged = (x[keep] for x in (symbol, owner, rank, merged))
        for pair in (now, now[now > 0] - 1):
            right = np.minimum(pair + 1, len(symbol) - 1)
            new, into = self.pair_rank(symbol[pair], symbol[right])
            new[(owner[pair] != owner[right]) | (right == pair)] = NO_RANK
            rank[pair], merged[pair] = new, into
        return symbol, owner, rank, merged, now

    @staticmethod
    def _lower(owner, rank, was, now) -> np.ndarray:
        """Owners where a pair beside a merged symbol has a lower or equal rank than the pair just merged."""
        before = np.maximum(now - 1, 0)
        low = np.minimum(rank[now], np.where(owner[before] == owner[now], rank[before], NO_RANK)) <= was
        return np.unique(owner[now[low]])


def _merges(model_file: str) -> PieceMerges:
    """One table per worker process and model, kept over tasks; executors open the path they have it under."""
    held = sys.modules.setdefault("rankflow_piece_merges", type(sys)("rankflow_piece_merges")).__dict__
    key = (model_file, os.path.getmtime(model_file))
    if key not in held:
        held[key] = PieceMerges(model_file)
    return held[key]


class WordCounts(dict):
    """Tokens per pre-token, for the batch at hand and the words seen before."""

    def __init__(self, merges: PieceMerges) -> None:
        super().__init__()
        self.merges = merges

    def of(self, texts: list[str]) -> list[int]:
        merges = self.merges
        cut = []
        for text in texts:
            text = text.replace(" ", SPACE)
            if text and merges.prefix:
                text = SPACE + text
            cut.append(PRE_TOKEN.findall(text))
        new = list({w for words in cut for w in words}.difference(self))
        if len(self) + len(new) > CACHE_WORDS:
            self.clear()
            new = list({w for words in cut for w in words})
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            self.update(zip(part, merges.count(part).tolist(), strict=True))
        get = self.__getitem__
        return [sum(map(get, words)) for words in cut]


def count_tokens(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row, for whole texts; a null text is empty and has no token.

    A null id stays null; repeated rows stay rows. Other columns are not read. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = WordCounts(_merges(model_file))
        for batch in sliced(batches, 1):
            texts = batch.column(1).to_pylist()
            tokens = np.array(counts.of([t.decode("utf-8", "replace") for t in texts]), np.int64)
            sizes = pa.array(np.fromiter(map(len, texts), np.int64, len(texts)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, pa.array(tokens), pa.array(tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

"""Operator 6: order-preserving packing of token sequences by dynamic programming.

Documents of a partition form one token stream, in order. Cuts are allowed at document ends (free), at sentence
ends (a small penalty) and, inside long stretches without either, at fixed steps (a large one). A sequence of n tokens costs
its padding, max_tokens - n, or nothing where n is a power of two (such lengths are batched unpadded). The
cheapest chain of cuts is found for each stretch of about BLOCK_TOKENS tokens:

    f(i) = penalty(i) + min( min{f(j) + j : i - max_tokens <= j < i} + max_tokens - i,  min{f(i - 2^t)} )

The inner minimum is a sliding window over positions, kept in a monotone queue.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections import deque
from collections.abc import Iterable, Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.llm.common import offsets, sliced, text_bytes

BLOCK_TOKENS = 1 << 19
#: As shares of max_tokens: what a cut costs in tokens of padding, stretches that get cuts of their own, their step.
SENTENCE_PENALTY = 1 / 512
INSIDE_PENALTY = 1 / 32
LONG_STRETCH = 1 / 16
INSIDE_STEP = 1 / 64
SENTENCE_SIGNS = set(".!?…。！？")
CACHE_CHUNKS = 300_000
CACHE_PARTS = 400_000


#: A word with signs after it: letters are one pre-token, so both parts are tokenized alone. An
#: apostrophe may begin a contraction, which takes letters with it.
WORD_AND_SIGNS = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]*)\Z")


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}


class ChunkTokens:
    """Token ids of texts, with the ids of chunks between spaces and line ends kept.

    For lower-casing BPE tokenizers of bytes whose pre-tokenizer parts letters from signs and drops spaces. Ids
    are held as packed bytes, so that putting a text together is joining them.
    """

    def __init__(self, tokenizer_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        vocab = self.tokenizer.get_vocab()
        self.letters = _byte_letters()
        size = max(vocab.values()) + 1
        self.code, self.dtype = ("H", np.uint16) if size <= 1 << 16 else ("I", np.uint32)
        self.sentence_end = np.zeros(size, bool)
        for token, i in vocab.items():
            token = token.removesuffix("</w>")
            self.sentence_end[i] = any(c in SENTENCE_SIGNS for c in token) and not any(c.isalnum() for c in token)
        self.known: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {}  # words and signs

    def encode(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def part(self, text: str) -> bytes:
        """Ids of a lower-cased word, or of signs."""
        if text.isalpha() and (text.isascii() or is_normalized("NFC", text)):
            byte_letters = text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
            ids = array(self.code, [t.id for t in self.tokenizer.model.tokenize(byte_letters)]).tobytes()
        else:
            ids = self.encode(text)
        self.parts[text] = ids
        return ids

    def learn(self, chunks: Iterable[str]) -> None:
        if len(self.parts) > CACHE_PARTS:
            self.parts = {}
        match, part_of, part, known = WORD_AND_SIGNS.match, self.parts.get, self.part, self.known
        for chunk in chunks:
            if chunk.isalpha():
                word, signs = chunk, ""
            elif (found := match(chunk)) is None:
                known[chunk] = self.encode(chunk)
                continue
            else:
                word, signs = found.groups()
            if "Σ" in word:  # its lower case depends on what follows
                known[chunk] = self.encode(chunk)
                continue
            word = word.lower()
            own = part_of(word) or part(word)
            known[chunk] = own + (part_of(signs) or part(signs)) if signs else own

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids per text)."""
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        used = set().union(*cut)
        new = used.difference(self.known)
        if len(self.known) + len(new) > CACHE_CHUNKS:
            # Only chunks of the texts at hand stay: frequent ones are among them.
            self.known = {c: self.known[c] for c in used.difference(new)}
        self.learn(new)
        get = self.known.__getitem__
        packed = [b"".join(map(get, chunks)) for chunks in cut]
        count = np.fromiter(map(len, packed), np.int64, len(packed)) // np.dtype(self.dtype).itemsize
        return np.frombuffer(b"".join(packed), self.dtype), count


def choose_cuts(ends: np.ndarray, sentence: np.ndarray, max_tokens: int) -> np.ndarray:
    """Ends of the sequences of one stretch, ascending; the last is its end.

    ends: ends of the documents (each has a token at least). sentence: ends of sentences.
    """
    n = int(ends[-1])
    penalty = np.full(n + 1, np.inf)
    penalty[sentence] = SENTENCE_PENALTY * max_tokens
    penalty[ends] = 0.0
    penalty[0] = 0.0
    at = np.flatnonzero(np.isfinite(penalty))
    step = max(1, int(max_tokens * INSIDE_STEP))
    for i in np.flatnonzero(np.diff(at) > max_tokens * LONG_STRETCH):
        penalty[at[i] + step : at[i + 1] : step] = INSIDE_PENALTY * max_tokens
    at = np.flatnonzero(np.isfinite(penalty))
    where = np.full(n + 1, -1, np.int64)
    where[at] = np.arange(len(at))
    into, out_of = [], []  # pairs of cuts a power of two apart
    size = 1
    while size <= max_tokens:
        late = at[np.searchsorted(at, size) :]
        back = where[late - size]
        into.append(where[late[back >= 0]])
        out_of.append(back[back >= 0])
        size *= 2
    into, out_of = np.concatenate(into), np.concatenate(out_of)
    order = np.argsort(into, kind="stable")
    pair_at = np.searchsorted(into[order], np.arange(len(at) + 1)).tolist()
    out_of = out_of[order].tolist()
    places, cost = at.tolist(), penalty[at].tolist()
    best, before = [0.0] * len(places), [0] * len(places)
    queue: deque[tuple[int, float, int]] = deque([(0, 0.0, 0)])  # (place, f + place, index), f + place ascending
    for k in range(1, len(places)):
        i = places[k]
        while queue[0][0] < i - max_tokens:
            queue.popleft()
        low, j = queue[0][1] + max_tokens - i, queue[0][2]
        for m in out_of[pair_at[k] : pair_at[k + 1]]:
            if best[m] < low:
                low, j = best[m], m
        low += cost[k]
        best[k], before[k] = low, j
        low += i
        while queue and queue[-1][1] >= low:
            queue.pop()
        queue.append((i, low, k))
    cuts, k = [], len(places) - 1
    while k:
        cuts.append(places[k])
        k = before[k]
    return np.array(cuts[::-1], np.int64)


def _tokens(tokenizer_file: str) -> ChunkTokens:
    """One per worker process, kept over tasks."""
    held = sys.modules.setdefault("rankflow_chunk_tokens", type(sys)("rankflow_chunk_tokens")).__dict__
    if tokenizer_file not in held:
        held[tokenizer_file] = ChunkTokens(tokenizer_file)
    return held[tokenizer_file]


PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


def pack_documents(
    docs: DataFrame,
    tokenizer_file: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_tokens: int = 2048,
    end_id: int = 1,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence; with_ids adds the ids themselves.

    A null or empty text is its end id alone, so each row has a piece. Repeated rows are packed each for itself,
    a null id stays null, other columns are not read. Sequence ids hold the partition's number, so a task that
    runs again gives the same rows. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(tokenizer_file)
        next_id = TaskContext.get().partitionId() << 32
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal next_id
            names = pa.concat_arrays([h[0] for h in held])
            ids = np.concatenate([h[1] for h in held])
            count = np.concatenate([h[2] for h in held])
            held.clear()
            bounds = offsets(count)
            cuts = choose_cuts(bounds[1:], np.flatnonzero(tokens.sentence_end[np.minimum(ids, len(tokens.sentence_end) - 1)]) + 1, max_tokens)
            end = np.union1d(cuts, bounds[1:])
            start = np.r_[0, end[:-1]]
            doc = np.searchsorted(bounds, start, "right") - 1
            seq = np.searchsorted(cuts, start, "right")
            seq_start = np.r_[0, cuts[:-1]]
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            columns = [
                names.take(pa.array(doc)), start - bounds[doc], end - start, crc, count[doc], next_id + seq, start - seq_start[seq], (cuts - seq_start)[seq],
            ]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.r_[start, end[-1:]].astype(np.int32)), pa.array(ids.astype(np.int32))))
            next_id += len(cuts)
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names=names_out)

        for batch in sliced(batches, 1, 1 << 20):
            ids, count = tokens.of([t.decode("utf-8", "replace") for t in batch.column(1).to_pylist()])
            ids = np.insert(ids.astype("<u4"), offsets(count)[1:], np.uint32(end_id))
            held.append((batch.column(0), ids, count + 1))
            if sum(len(h[1]) for h in held) >= BLOCK_TOKENS:
                yield flush()
        if held:
            yield flush()

    schema = PIECE_SCHEMA + (", ids array<int>" if with_ids else "")
    names_out = [c.split()[0] for c in schema.split(", ")]
    rows = docs.select(F.col(f"`{id_col}`").cast("long"), text_bytes(text_col))
    return rows.mapInArrow(run, schema)

"""Repeated windows of a corpus: how texts meet in shards without all of it being sorted or indexed at once.

Every window of W symbols (bytes or words) has an anchor: the run of ``gram`` symbols inside it with the
smallest hash, the leftmost of equals. Equal windows have equal anchors, wherever they are. So

1. anchors are counted over all texts; a window can only repeat if its anchor does,
2. around repeated anchors the stretch of text that holds the anchor's windows is cut out (a context),
3. equal contexts become one class, with the number of its members and the first of them,
4. an anchor with many classes is narrowed: its windows are dealt by where the anchor stands in them, in ranges of
   offsets, and by all symbols that the windows of a range share around it. Equal windows still meet; equal
   stretches are one class again, and a group still large goes through finer ranges, down to single offsets, where
   the windows of a group are all equal and one class,
5. classes are dealt to shards by group, where operators find repeated windows by their own method,
6. what a class's first member keeps or loses is decided there; the other members repeat it as a whole.

Counts, contexts and classes are exact over all rows; hashes only choose who meets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.llm.common import materialize, offsets, ragged, sliced, text_bytes

PRIME = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
PLACE_BITS = 24
NARROW = 8  # ranges of offsets that a hot group is dealt to
STRETCH = 1 << 20  # symbols handled at once; longer texts are taken in overlapping stretches
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


@dataclass(frozen=True)
class Windows:
    size: int
    gram: int
    words: bool


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def run_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of symbols[start:end] for many runs: differences of one prefix sum, shifted back to a common place."""
    before = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * powers(PRIME, len(symbols)), out=before[1:])
    back = powers(INVERSE, len(symbols) + 1)
    return mixed((before[ends] - before[starts]) * back[starts])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w successive values, by running minima inside blocks of w from both sides."""
    n = len(x) - w + 1
    blocks = np.full((-(-len(x) // w), w), np.iinfo(np.uint64).max, np.uint64)
    blocks.reshape(-1)[: len(x)] = x
    left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def word_bounds(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words between ASCII white space."""
    edge = np.diff(np.r_[True, SPACE[text], True].astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def text_symbols(text: bytes, kind: Windows) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """(symbols as numbers, word starts, word ends) of one text or several joined ones."""
    x = np.frombuffer(text, np.uint8)
    if not kind.words:
        return x.astype(np.uint64) + np.uint64(1), None, None
    starts, ends = word_bounds(x)
    return run_hashes(x.astype(np.uint64) + np.uint64(1), starts, ends) if len(starts) else np.zeros(0, np.uint64), starts, ends


def anchor_runs(symbols: np.ndarray, bounds: np.ndarray, kind: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, last window, anchor) of runs of windows with one anchor. Windows count within a text."""
    n = len(symbols) - kind.gram + 1
    assert n <= 1 << PLACE_BITS, "a place would run into the hash bits"
    length = np.diff(bounds)
    windows = np.maximum(length - kind.size + 1, 0)
    if n <= 0 or not windows.any():
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    place = np.arange(n)
    grams = run_hashes(symbols, place, place + kind.gram)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = sliding_min((grams & ~low) | place.astype(np.uint64), kind.size - kind.gram + 1)
    at = ragged(bounds[:-1], windows)
    anchor = (least[at] & low).astype(np.int64)
    text = np.repeat(np.arange(len(length)), windows)
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    last = np.r_[first[1:], len(at)] - 1
    text = text[first]
    return text, at[first] - bounds[text], at[last] - bounds[text], grams[anchor[first]]


def runs_of(texts: list[bytes], kind: Windows) -> Iterator[tuple]:
    """anchor_runs of texts, in stretches of bounded size: (text, first, last, anchor, shift, symbols' words)."""
    long = [i for i, t in enumerate(texts) if len(t) > STRETCH]
    short = [i for i, t in enumerate(texts) if len(t) <= STRETCH]
    if short:
        joined = b" ".join(texts[i] for i in short) if kind.words else b"".join(texts[i] for i in short)
        size = np.fromiter((len(texts[i]) for i in short), np.int64, len(short))
        symbols, starts, ends = text_symbols(joined, kind)
        if kind.words:
            bounds = np.searchsorted(starts, np.r_[offsets(size + 1)[:-1], len(joined) + 1])
        else:
            bounds = offsets(size)
        text, first, last, anchor = anchor_runs(symbols, bounds, kind)
        yield np.array(short)[text], first, last, anchor
    for i in long:
        symbols, _, _ = text_symbols(texts[i], kind)
        for at in range(0, max(1, len(symbols) - kind.size + 1), STRETCH):
            part = symbols[at : at + STRETCH + kind.size - 1]
            text, first, last, anchor = anchor_runs(part, np.array([0, len(part)]), kind)
            yield np.full(len(text), i), first + at, last + at, anchor


def keyed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text) with a key of its own for each row: the id, or a stored number if ids are null or repeated."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_bytes(text_col).alias("text"))
    odd = rows.groupBy("id").count().where("count > 1 or id is null").select("id").limit(1).count()
    if odd:
        return materialize(rows.select(F.monotonically_increasing_id().alias("row"), "id", "text"), "rows")
    return rows.select(F.col("id").alias("row"), "id", "text")


def _count_task(kind: Windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, 1 << 20):
            rows = batch.column(0).to_numpy()
            for text, _, _, anchor in runs_of(batch.column(1).to_pylist(), kind):
                yield pa.RecordBatch.from_arrays([pa.array(rows[text]), pa.array(anchor.view(np.int64))], names=["row", "anchor"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in sliced(batches, 2):
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(map(squeeze, batch.column(2).to_pylist()), pa.binary())], names=["row", "id", "packed"])


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def unpacked_sizes(packed: pa.Array) -> np.ndarray:
    """Bytes of the texts themselves, from the frame headers: repetitive texts are packed to a thousandth."""
    return np.fromiter(map(zstandard.frame_content_size, packed.to_pylist()), np.int64, len(packed))


def _context_task(kind: Windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        digest = xxhash.xxh64_intdigest
        names = ["row", "id", "anchor", "ctx", "start", "windows", "content"]
        types = [pa.int64()] * 6 + [pa.binary()]
        for batch in sliced(batches, 2, 1 << 20, unpacked_sizes):
            rows, ids, wanted = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)
            texts = [unpack(t) for t in batch.column(2).to_pylist()]
            cut: dict[int, tuple] = {}
            out: list[list] = [[] for _ in names]
            for text, first, last, anchor in runs_of(texts, kind):
                anchor = anchor.view(np.int64)
                begin = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else []
                for a, b in zip(begin, [*begin[1:], len(text)], strict=True):
                    i = int(text[a])
                    hit = a + np.flatnonzero(np.isin(anchor[a:b], wanted[i].values.to_numpy()))
                    if kind.words and len(hit) and i not in cut:
                        cut = {i: word_bounds(np.frombuffer(texts[i], np.uint8))}
                    for p, q, h in zip(first[hit].tolist(), last[hit].tolist(), anchor[hit].tolist(), strict=True):
                        if kind.words:
                            content = b" ".join(texts[i][cut[i][0][p] : cut[i][1][q + kind.size - 1]].split())
                        else:
                            content = texts[i][p : q + kind.size]
                        ctx = digest(content)
                        ctx -= (ctx >> 63) << 64
                        new = (h, ctx) not in seen
                        seen.add((h, ctx))
                        for column, value in zip(out, (rows[i], ids[i], h, ctx, p, q - p + 1, content if new else None), strict=True):
                            column.append(value)
                    if len(out[0]) > 4000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)
                        out = [[] for _ in names]
            if len(seen) > 1 << 20:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    return run


SPAN_SCHEMA = "row long, a long, b long"
CONTEXT_SCHEMA = "row long, id long, anchor long, ctx long, start long, windows long, content binary"
CLASS_SCHEMA = "anchor long, ctx long, n long, id long, row long, start long, windows long, content binary"
CLASS_COLUMNS = [c.split()[0] for c in CLASS_SCHEMA.split(", ")]


def narrowing_widths(kind: Windows) -> list[int]:
    """Widths of the ranges of anchor offsets, from coarse to single offsets."""
    n = kind.size - kind.gram + 1
    out = []
    while not out or out[-1] > 1:
        n = -(-n // NARROW)
        out.append(n)
    return out


def anchor_places(contents: list[bytes], kind: Windows) -> np.ndarray:
    """Where the anchor of each context starts, in symbols: as in anchor_runs, the leftmost smallest of its first window."""
    joined = (b" " if kind.words else b"").join(contents)
    symbols, starts, _ = text_symbols(joined, kind)
    size = np.fromiter(map(len, contents), np.int64, len(contents))
    begin = np.searchsorted(starts, offsets(size + 1)[:-1]) if kind.words else offsets(size)[:-1]
    at = begin[:, None] + np.arange(kind.size - kind.gram + 1)
    flat = at.reshape(-1)
    low = np.uint64((1 << PLACE_BITS) - 1)
    return (run_hashes(symbols, flat, flat + kind.gram) & ~low).reshape(at.shape).argmin(1)


def _narrow_task(kind: Windows, width: int):
    """Classes of hot groups -> a stretch per class and range of offsets, in the group of what the range's windows share."""
    size, most = kind.size, kind.size - kind.gram

    def signed(data: bytes, seed: int) -> int:
        h = xxhash.xxh64_intdigest(data, seed)
        return h - ((h >> 63) << 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 7, 1 << 20):
            columns = [c.to_pylist() for c in batch.columns]
            out: list[list] = [[] for _ in CLASS_COLUMNS]
            for _, _, n, ident, row, start, windows, content, place in zip(*columns, anchor_places(columns[7], kind).tolist(), strict=True):
                symbols = content.split(b" ") if kind.words else content
                for part in range((place - windows + 1) // width, place // width + 1):
                    # Offsets of the range; the stretch's windows; what all windows of those offsets share.
                    near, far = part * width, min(part * width + width - 1, most)
                    first, last = max(0, place - far), min(windows - 1, place - near)
                    stretch, shared = symbols[first : last + size], symbols[place - near : place - far + size]
                    if kind.words:
                        stretch, shared = b" ".join(stretch), b" ".join(shared)
                    new = (signed(shared, (part << 32) + width), signed(stretch, 0), n, ident, row, start + first, last - first + 1, stretch)
                    for column, value in zip(out, new, strict=True):
                        column.append(value)
            types = [pa.int64()] * 7 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=CLASS_COLUMNS)

    return run


def _shard_task(work: Callable[[pa.Table], pa.RecordBatch], size: int):
    """Feeds whole groups to ``work``, several at a time up to about ``size`` bytes of contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in sliced(batches, 7, size):
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            if held.column("content").nbytes < size:
                continue
            anchor = held.column("anchor").to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1]))  # the last group may go on
            if cut:
                yield work(held.slice(0, cut).combine_chunks())
                held = held.slice(cut).combine_chunks()
        if held is not None and held.num_rows:
            yield work(held.combine_chunks())

    return run


def _classes(members: DataFrame, n) -> DataFrame:
    """CLASS_SCHEMA: equal contexts of a group as one row, with the first member of them. A null id counts as the smallest."""
    order = F.struct(F.coalesce("id", F.lit(-(1 << 63))).alias("id"), "row", "start")
    found = members.groupBy("anchor", "ctx").agg(n.alias("n"), F.min(order).alias("first"), F.max("windows").alias("windows"), F.max("content").alias("content"))
    return found.select("anchor", "ctx", "n", "first.id", "first.row", "first.start", "windows", "content")


def _later_members(members: DataFrame, classes: DataFrame, kind: Windows) -> DataFrame:
    """(row, a, b) of the members of a class that are not its first one."""
    firsts = classes.where("n > 1").select("anchor", "ctx", F.col("row").alias("r1"), F.col("start").alias("s1"))
    others = members.select("row", "start", "windows", "anchor", "ctx").join(firsts, ["anchor", "ctx"]).where("row <> r1 or start <> s1")
    return others.select("row", F.col("start").alias("a"), (F.col("start") + F.col("windows") + kind.size - 1).alias("b"))


def repeated_spans(rows: DataFrame, kind: Windows, work: Callable[[pa.Table], pa.RecordBatch], shard_bytes: int, hot_classes: int) -> tuple[DataFrame, DataFrame]:
    """(candidate texts, spans): (row, packed) of texts with repeated anchors, and (row, a, b) in symbols to remove.

    work: classes of whole groups -> rows of SPAN_SCHEMA. A group has at most hot_classes of them.
    """
    anchors = rows.select("row", "text").mapInArrow(_count_task(kind), "row long, anchor long")
    if not kind.words:  # bytes have more windows than words: reading their anchors again costs less than finding them
        anchors = materialize(anchors, "anchors")
    # Stored, so that the join below is of two plain shuffles, whose large partitions Spark can split.
    repeated = materialize(anchors.groupBy("anchor").count().where("count > 1").select("anchor"), "repeated-anchors")
    wanted = anchors.join(repeated, "anchor").groupBy("row").agg(F.collect_set("anchor").alias("anchors"))
    packed = rows.mapInArrow(_pack, "row long, id long, packed binary")
    texts = materialize(packed.join(wanted, "row"), "candidate-texts")
    members = texts.select("row", "id", "packed", "anchors").mapInArrow(_context_task(kind), CONTEXT_SCHEMA)
    members = materialize(members, "contexts")
    classes = materialize(_classes(members, F.count(F.lit(1))), "classes")
    spans, shards = _later_members(members, classes, kind), []
    for width in narrowing_widths(kind):
        hot = classes.groupBy("anchor").count().where(F.col("count") > hot_classes).select("anchor")
        hot = materialize(hot, "hot-groups")
        if hot.isEmpty():
            break
        shards.append(classes.join(hot, "anchor", "left_anti"))
        members = classes.join(hot, "anchor").select(*CLASS_COLUMNS).mapInArrow(_narrow_task(kind, width), CLASS_SCHEMA)
        members = materialize(members, "narrowed")
        classes = materialize(_classes(members, F.sum("n")), "classes")
        spans = spans.union(_later_members(members, classes, kind))
    shards.append(classes)
    dealt = reduce(DataFrame.union, [c.select(*CLASS_COLUMNS) for c in shards]).repartition("anchor").sortWithinPartitions("anchor")
    return texts.select("row", "packed"), spans.union(dealt.mapInArrow(_shard_task(work, shard_bytes), SPAN_SCHEMA))


def span_lists(spans: DataFrame) -> DataFrame:
    """(row, spans): all spans of a row; as many as its text has anchors at most."""
    return spans.groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def covered(spans: pa.Scalar, n: int) -> np.ndarray:
    """Which of n symbols the spans cover."""
    values = spans.values
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, values.field("a").to_numpy(), 1)
    np.add.at(step, values.field("b").to_numpy(), -1)
    return np.cumsum(step[:n]) > 0


def window_runs(repeated: np.ndarray, owner: np.ndarray, row: np.ndarray, place: np.ndarray, window: int) -> pa.RecordBatch:
    """SPAN_SCHEMA rows of successive repeated windows of one owner; place: where each window starts in its text."""
    edge = np.flatnonzero(np.r_[True, (np.diff(repeated.astype(np.int8)) != 0) | (np.diff(owner) != 0)]) if len(owner) else np.zeros(0, np.int64)
    last = np.r_[edge[1:], len(owner)] - 1
    edge, last = edge[repeated[edge]], last[repeated[edge]]
    columns = (row[owner[edge]], place[edge], place[last] + window)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["row", "a", "b"])

"""Operator 1: SimHash near-duplicates by pivot distance tables.

Every fingerprint has a table of Hamming distances to fixed reference fingerprints (pivots). By the triangle
inequality two fingerprints within radius r differ by at most r in every coordinate, so pairs are discarded by
their largest coordinate difference and only survivors are compared bit by bit.

Which pairs meet at all: a coordinate is the sum of its parts over radius + 2 bit segments. At most r differing
bits leave two segments untouched, so there the parts agree for all pivots. Rows meet by the parts of two
segments, in a table per pair of segments. Equal fingerprints are one row. A bucket above BLOCK rows is dealt
out as pairs of blocks, so no bucket is one task, and each task sends on a star per linked set, not its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.llm.common import materialize, sliced, text_bytes
from rankflow.llm.components import connected_components, star_forest

SEED = 42
BLOCK = 2048
PIVOTS = [int.from_bytes(hashlib.md5(f"pivot {i}".encode()).digest()[:8], "big") for i in range(24)]
KEY_PIVOTS = 8


def fingerprint(text: bytes, shingle: int) -> int:
    """Unsigned 64-bit SimHash of ASCII-lower-cased words split at ASCII white space; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start = (end - length)[: len(words) - shingle + 1].tolist()
    end = end[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start, end, strict=True)), np.uint64, len(start))
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int32)
    bits = np.packbits(count * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp) per row. Null and empty texts have fingerprint 0. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            fp = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(f"`{id_col}`").cast("long"), text_bytes(text_col)).mapInArrow(run, "id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def segment_masks(n: int) -> list[int]:
    cuts = [64 * i // n for i in range(n + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]


def _segment_part(name: str, mask: int) -> Column:
    """The pivot coordinates of one segment, as one number."""
    parts = (F.bit_count(F.col(name).bitwiseXOR(F.lit(_signed(p))).bitwiseAND(F.lit(_signed(mask)))) for p in PIVOTS[:KEY_PIVOTS])
    return F.xxhash64(*parts)


def near_rows(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of equal key within the radius; rows are sorted by key."""
    n = len(key)
    table = [np.bitwise_count(fp ^ np.uint64(p)).astype(np.int8) for p in PIVOTS]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if n else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, n])
    left = np.repeat(first + size, size) - np.arange(n)  # rows from here to the bucket's end
    found_a, found_b = [], []
    at, step = np.flatnonzero(left > 1), 1
    while len(at):
        i = at
        for column in table:
            i = i[np.abs(column[i] - column[i + step]) <= radius]
            if not len(i):
                break
        i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= radius]
        found_a.append(i)
        found_b.append(i + step)
        step += 1
        at = at[left[at] > step]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])


def _link_task(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(key, node, fp) -> pa.RecordBatch:
            a, b = near_rows(key, fp.view(np.uint64), radius)
            root = star_forest(len(key), a, b)
            at = np.flatnonzero(root != np.arange(len(key)))
            return pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[root[at]])], names=["a", "b"])

        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
            if not len(held[0]):
                continue
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last bucket may go on
            if cut:
                yield links(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if held and len(held[0]):
            yield links(*held)

    return run


def near_links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) between distinct rows (id, fp) that join all within the radius."""
    masks = segment_masks(radius + 2)
    parts = fps.select("id", "fp", *(_segment_part("fp", m).alias(f"part_{i}") for i, m in enumerate(masks)))
    keys = [F.xxhash64(F.lit(i), F.lit(j), F.col(f"part_{i}"), F.col(f"part_{j}")) for i, j in combinations(range(len(masks)), 2)]
    rows = parts.select("id", "fp", F.explode(F.array(*keys)).alias("key"))
    # Stored, so that the join below is of two plain shuffles, whose large partitions Spark can split.
    shared = materialize(rows.groupBy("key").count().where("count > 1"), "shared-keys")
    blocks = rows.join(shared, "key").withColumn("n", F.ceil(F.col("count") / BLOCK).cast("int"))
    block = F.pmod(F.xxhash64("id"), F.col("n")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.least(block, j) * F.col("n") + F.greatest(block, j))
    dealt = blocks.select("key", "id", "fp", F.explode(pairs).alias("pair"))
    key = F.when(F.col("pair") == 0, F.col("key")).otherwise(F.xxhash64("key", "pair")).alias("key")
    sorted_rows = dealt.select(key, "id", "fp").repartition("key").sortWithinPartitions("key")
    return sorted_rows.mapInArrow(_link_task(radius), "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3
) -> DataFrame:
    """(id, fp, component) per row: the component is the smallest id reachable by links within the radius.

    Ties and repeated rows: equal fingerprints are always one component. Rows with a null id keep a row; their
    component is that of their fingerprint, null if no row of it has an id. An empty table gives an empty one.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    return components_of(fps, near_links(one_per_fingerprint(fps), radius))


def one_per_fingerprint(fps: DataFrame) -> DataFrame:
    return fps.where("id is not null").groupBy("fp").agg(F.min("id").alias("id"))


def components_of(fps: DataFrame, links: DataFrame) -> DataFrame:
    found = connected_components(links)
    known = one_per_fingerprint(fps).join(found, F.col("id") == F.col("node"), "left")
    known = known.select("fp", F.coalesce("component", "id").alias("component"))
    return fps.join(known, "fp", "left").select("id", "fp", "component")


def fingerprint_hex(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))

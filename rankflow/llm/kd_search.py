"""Operator 9: exact top-k inner product search with one KD-tree per shard.

Vectors become integers (floor of 64 x) and are dealt to shards by the top of a KD-tree whose medians come from
a bounded sample; every row is dealt, and a cell above the shard size is split by a hash of the id. In a shard,
median splits go on down to leaves with tight bounding boxes. A query visits leaves by falling box bound (the
largest inner product a point of the box can have) and stops below its kth score. The first search is in the
query's own shard; its kth score goes along, so other shards are visited only where their box can still beat it.

Queries and candidates meet in pairs of blocks: a shard, and at most QUERY_BLOCK queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankflow.llm.common import materialize

SAMPLE_ROWS = 20_000
SHARD_ROWS = 8192
MAX_SHARDS = 4096  # bounds what the driver holds: two corners of a box per shard
LEAF_ROWS = 64
QUERY_BLOCK = 4096
CHUNK = 256
EXACT = 2.0**53
TOP_SCHEMA = "query_id long, vec_id long, score long"


def quantized(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec) with floor(64 x) as doubles; rows with a null id, or null or non-finite components, are left out."""
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vec.alias("vec")).where("vec_id is not null and vec is not null")
    return rows.where(F.coalesce(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))).select("vec_id", "vec")


def split_planes(sample: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """Nodes (dimension, median, left, right) of a tree with about ``cells`` leaves; a child below 0 is leaf -1 - child."""
    nodes: list[tuple[int, float, int, int]] = []
    leaves = 0

    def grow(rows: np.ndarray, want: int) -> int:
        nonlocal leaves
        spread = np.ptp(sample[rows], axis=0) if len(rows) else np.zeros(1)
        if want <= 1 or len(rows) < 2 or not spread.max(initial=0):
            leaves += 1
            return -leaves
        d = int(spread.argmax())
        x = sample[rows, d]
        cut = float(np.median(x))
        if not (x > cut).any():
            cut = float(x[x < cut].max())
        at = len(nodes)
        nodes.append((d, cut, 0, 0))
        left = grow(rows[x <= cut], want // 2)
        right = grow(rows[x > cut], want - want // 2)
        nodes[at] = (d, cut, left, right)
        return at

    grow(np.arange(len(sample)), cells)
    return nodes


def cell_of(nodes: list[tuple[int, float, int, int]], x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), np.int64) if nodes else np.full(len(x), -1)
    while (inner := np.flatnonzero(at >= 0)).size:
        for node in np.unique(at[inner]):
            d, cut, left, right = nodes[node]
            rows = inner[at[inner] == node]
            at[rows] = np.where(x[rows, d] <= cut, left, right)
    return -1 - at


def leaf_boxes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row order, leaf starts with the end, low corners, high corners) of the KD-tree over x."""
    order, starts = [], [0]
    stack = [np.arange(len(x))]
    while stack:
        rows = stack.pop()
        if len(rows) <= LEAF_ROWS:
            order.append(rows)
            starts.append(starts[-1] + len(rows))
            continue
        d = int(np.ptp(x[rows], axis=0).argmax()) if x.shape[1] else 0
        half = len(rows) // 2
        by = np.argpartition(x[rows, d], half) if x.shape[1] else np.arange(len(rows))
        stack += [rows[by[half:]], rows[by[:half]]]
    order, starts = np.concatenate(order), np.array(starts)
    low = np.minimum.reduceat(x[order], starts[:-1], axis=0)
    high = np.maximum.reduceat(x[order], starts[:-1], axis=0)
    return order, starts, low, high


def box_bound(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Largest inner product of each query with a point of each box."""
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


def clipped(scores: np.ndarray) -> np.ndarray:
    """Python integers, to the range of a long."""
    return np.minimum(np.maximum(scores, -(1 << 63)), (1 << 63) - 1)


def search(q_ids: np.ndarray, q: np.ndarray, kth: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
    """(query position, vec_id, score) of the k best of x per query that reach kth; ties go to the smaller id."""
    by_id = np.argsort(ids, kind="stable")
    ids, x = ids[by_id], x[by_id]
    order, starts, low, high = leaf_boxes(x)
    size = np.diff(starts)
    if len(q) and np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, x.shape[1]) >= EXACT:
        q, x, low, high = (a.astype(object) for a in (np.vectorize(int, otypes=[object])(b) if b.size else b for b in (q, x, low, high)))
        bound = clipped(np.maximum(q, 0).dot(high.T) + np.minimum(q, 0).dot(low.T))
        # A score in a double may be rounded up; a lower bound is as right.
        kth = np.array([-(1 << 200) if v == -np.inf else int(v) - (abs(int(v)) >> 30) - 1 for v in kth], object)
        none = -(1 << 200)
    else:
        bound, none = box_bound(q, low, high), -np.inf
    found = []
    width = int(size.max())
    slot = np.minimum(starts[:-1, None] + np.arange(width), len(x) - 1)
    real = np.arange(width) < size[:, None]
    for c in range(0, len(q), CHUNK):
        qc, bc = q[c : c + CHUNK], bound[c : c + CHUNK]
        visit = np.argsort(-bc, axis=1)
        best = np.full((len(qc), k), none, q.dtype)
        who = np.full((len(qc), k), np.iinfo(np.int64).max)  # place in id order
        floor = kth[c : c + CHUNK].copy()
        for step in range(len(starts) - 1):
            leaf = visit[:, step]
            live = np.flatnonzero(bc[np.arange(len(qc)), leaf] >= floor)
            if not len(live):
                break
            leaf = leaf[live]
            rows = order[slot[leaf]]
            score = np.matmul(x[rows], qc[live][:, :, None])[:, :, 0] if q.dtype != object else clipped(np.array([x[r].dot(v) for r, v in zip(rows, qc[live], strict=True)], object))
            drop = ~real[leaf] | (ids[rows] == q_ids[c + live][:, None])
            score = np.where(drop, none, score)
            score = np.concatenate([best[live], score], axis=1)
            place = np.concatenate([who[live], np.where(drop, np.iinfo(np.int64).max, rows)], axis=1)
            top = np.lexsort((place, -score), axis=1)[:, :k]
            best[live] = np.take_along_axis(score, top, 1)
            who[live] = np.take_along_axis(place, top, 1)
            floor[live] = np.maximum(floor[live], best[live][:, k - 1])
        row, col = np.nonzero((who < np.iinfo(np.int64).max) & (best >= kth[c : c + CHUNK][:, None]))
        found.append((c + row, ids[who[row, col]], best[row, col]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(f) for f in zip(*found, strict=True))


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _search_groups(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not queries.num_rows or not rows.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        q_ids = queries.column("query_id").to_numpy()
        kth = queries.column("kth").to_numpy()
        at, ids, score = search(q_ids, _matrix(queries.column("vec"), len(q_ids)), kth.astype(np.float64), rows.column("vec_id").to_numpy(), _matrix(rows.column("vec"), rows.num_rows), k)
        return pa.table({"query_id": pa.array(q_ids[at]), "vec_id": pa.array(ids), "score": pa.array([int(s) for s in score], pa.int64())})

    return run


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row where ``is_query`` holds on vec_id.

    Fewer than k candidates give fewer rows. Only vectors of the query's dimension take part; rows of the query's
    own id do not. If a query id is repeated, its smallest vector asks; a candidate id counts once for each row.
    Scores beyond a long are clipped to it.
    """
    base = quantized(vectors, id_col, vec_col)
    n = base.count()
    shard_rows = max(shard_rows, -(-n // MAX_SHARDS))
    share = min(1.0, SAMPLE_ROWS / max(1, n))
    drawn = base.where(F.pmod(F.xxhash64(F.lit("kd"), F.col("vec_id")), F.lit(1 << 20)) < int(share * (1 << 20))).select("vec").toPandas().vec
    dims = drawn.map(len).mode()
    dims = int(dims.iloc[0]) if len(dims) else 0
    sample = [np.floor(64.0 * np.asarray(v)) for v in drawn if len(v) == dims]
    nodes = split_planes(np.stack(sample), -(-n // shard_rows)) if sample and dims else []

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column(1)
            flat = np.floor(64.0 * vec.flatten().to_numpy(zero_copy_only=False))
            size = vec.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            cell = np.zeros(len(size), np.int64)
            end = np.cumsum(size)
            own = np.flatnonzero(size == dims)
            if nodes and len(own):
                cell[own] = cell_of(nodes, flat[(end[own] - dims)[:, None] + np.arange(dims)])
            data = [flat[e - s : e].astype("<f8").tobytes() for e, s in zip(end.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(cell), pa.array(data, pa.binary())], names=["vec_id", "dims", "cell", "vec"])

    placed = materialize(base.mapInArrow(place, "vec_id long, dims long, cell long, vec binary"), "kd-placed")
    parts = placed.groupBy("dims", "cell").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("parts"))
    salt = F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    dealt = materialize(placed.join(parts, ["dims", "cell"]).select("vec_id", "dims", F.xxhash64("dims", "cell", salt).alias("shard"), "vec"), "kd-shards")

    def box(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            shard, size = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data = batch.column(2).to_pylist()
            for s, d in set(zip(shard.tolist(), size.tolist(), strict=True)):
                x = np.frombuffer(b"".join(data[i] for i in np.flatnonzero((shard == s) & (size == d))), np.float64).reshape(-1, d) if d else np.zeros((1, 0))
                old = held.get((s, d), [x[:1].max(0), x[:1].max(0)])
                held[s, d] = [np.minimum(old[0], x.min(0)), np.maximum(old[1], x.max(0))]
        if held:
            columns = [[s for s, _ in held], [d for _, d in held], [v[0].tolist() for v in held.values()], [v[1].tolist() for v in held.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.list_(pa.float64())) for c in columns[2:])], names=["shard", "dims", "low", "high"])

    boxes: dict[int, list] = {}
    for row in dealt.select("shard", "dims", "vec").mapInArrow(box, "shard long, dims long, low array<double>, high array<double>").toLocalIterator():
        _, low, high = boxes.setdefault(row.shard, [row.dims, np.array(row.low), np.array(row.high)])
        boxes[row.shard] = [row.dims, np.minimum(low, row.low), np.maximum(high, row.high)]
    by_dims: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for d in {b[0] for b in boxes.values()}:
        own = [(s, low, high) for s, (size, low, high) in boxes.items() if size == d]
        by_dims[d] = (np.array([o[0] for o in own]), np.stack([o[1] for o in own]), np.stack([o[2] for o in own]))

    asks = dealt.where(is_query).groupBy("vec_id").agg(F.min(F.struct("dims", "vec", "shard")).alias("q"))
    asks = materialize(asks.select(F.col("vec_id").alias("query_id"), "q.dims", "q.shard", "q.vec"), "kd-queries")
    task = _search_groups(k)
    first = asks.withColumn("kth", F.lit(float("-inf"))).groupBy("shard").cogroup(dealt.select("shard", "vec_id", "vec").groupBy("shard"))
    first = materialize(first.applyInArrow(task, TOP_SCHEMA), "kd-first")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, home = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            kth = batch.column(4).to_numpy(zero_copy_only=False)
            row, to = [], []
            data = batch.column(3).to_pylist()
            for d in np.unique(size):
                own = np.flatnonzero(size == d)
                shards, low, high = by_dims[int(d)]
                q = np.frombuffer(b"".join(data[i] for i in own), np.float64).reshape(len(own), int(d))
                top = box_bound(q, low, high)
                top += np.abs(top) * 1e-9 + 1e-9  # rounding of very large products
                a, b = np.nonzero((top >= kth[own][:, None]) & (shards[None, :] != home[own][:, None]))
                row.append(own[a])
                to.append(shards[b])
            row = pa.array(np.concatenate(row) if row else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(3).take(row), batch.column(4).take(row), pa.array(np.concatenate(to) if to else np.zeros(0, np.int64))], names=["query_id", "vec", "kth", "shard"])

    reached = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("kth"))
    known = asks.join(reached, "query_id", "left").select("query_id", "dims", "shard", "vec", F.coalesce("kth", F.lit(float("-inf"))).alias("kth"))
    blocks = max(1, -(-asks.count() // QUERY_BLOCK))
    routed = known.mapInArrow(route, "query_id long, vec binary, kth double, shard long")
    routed = routed.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    copies = dealt.select("shard", "vec_id", "vec", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    rest = routed.groupBy("shard", "block").cogroup(copies.groupBy("shard", "block")).applyInArrow(task, TOP_SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = first.union(rest).withColumn("rank", F.row_number().over(order).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Vector search: exact and cluster-pruned top-k, recall and trial selection."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankflow.functions.hashing import seeded_int
from rankflow.functions.ordering import top_per_group
from rankflow.functions.text import word_tokens
from rankflow.functions.vecmath import l2_normalize, sum_vectors
from rankflow.sources.scratch import materialize

# Vector elements per block: about 32 MB of doubles on the catalog side.
QUERY_ELEMENTS = 1_000_000
CATALOG_ELEMENTS = 4_000_000
SCORE_DIGITS = 9
# Scores that a task holds at once; sorting out the best of them takes as much again.
SCORES_AT_ONCE = 1_000_000
# Below this many pairs of blocks all are searched: finding bounds would cost more than the products it saves.
BOUNDED_PAIRS = 64
PIVOTS_PER_BLOCK = 4
# Allowance of a bound for rounded scores, absolute and as a share of the lengths involved.
SLACK, RELATIVE_SLACK = 1e-8, 1e-9


def _block_search(k: int, metric: str, by_cell: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Top k of one query block against one catalog block. Both blocks have bounded size."""
    cells = SCORES_AT_ONCE

    def search(queries: pa.Table, catalog: pa.Table) -> pa.Table:
        import numpy as np

        def matrix(t: pa.Table) -> np.ndarray:
            flat = t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return flat.reshape(t.num_rows, -1)

        out_q, out_c, out_s = [], [], []
        if queries.num_rows and catalog.num_rows:
            order = np.argsort(catalog.column("item_id").to_numpy(), kind="stable")
            c = matrix(catalog)[order]
            q = matrix(queries)
            step = max(1, cells // len(c))
            for start in range(0, len(q), step):
                part = q[start : start + step]
                s = part @ c.T
                if metric == "l2":
                    s = 2.0 * s - (part * part).sum(1)[:, None] - (c * c).sum(1)[None, :]
                np.round(s, SCORE_DIGITS, out=s)
                # ids are sorted, so a stable sort of -score breaks ties by id.
                kk = min(k, s.shape[1])
                cut = np.partition(s, s.shape[1] - kk, axis=1)[:, s.shape[1] - kk]
                for i in range(len(part)):
                    hit = np.flatnonzero(s[i] >= cut[i])
                    hit = hit[np.argsort(-s[i][hit], kind="stable")[:kk]]
                    out_q.append(np.full(len(hit), start + i))
                    out_c.append(order[hit])
                    out_s.append(s[i][hit])
        rows_q = np.concatenate(out_q) if out_q else np.empty(0, np.int64)
        rows_c = np.concatenate(out_c) if out_c else np.empty(0, np.int64)
        score = np.concatenate(out_s) if out_s else np.empty(0)
        out = {
            "query_key": queries.column("query_key").take(pa.array(rows_q)),
            "item_id": catalog.column("item_id").take(pa.array(rows_c)),
            "score": pa.array(-score if metric == "l2" else score),
        }
        if by_cell:
            out["cell"] = catalog.column("cell").take(pa.array(rows_c))
        return pa.table(out)

    return search


def _blocks(elements: int) -> F.Column:
    return F.ceil(F.count(F.lit(1)) * F.max(F.size("vec")) / elements).cast("long")


def block_topk(queries: DataFrame, catalog: DataFrame, k: int, metric: str = "ip", by_cell: bool = True) -> DataFrame:
    """Exact top k per query and cell: (query_key, item_id, score), with ``cell`` if by_cell.

    ``queries`` (query_key, vec) and ``catalog`` (item_id, vec), both with a column cell if by_cell:
    then only rows of one cell meet. Both sides are cut into blocks by hash of their unique ids; every
    query block meets every catalog block (of its cell) in its own task group, which sends on at most
    k rows per query. The numbers of blocks are scalars, or one row per cell joined by cell; which
    side of that join is broadcast is left to Spark's size check. No pair is ever a row.
    """
    if metric not in ("ip", "l2"):
        raise ValueError(f"unknown metric: {metric}")
    zero = F.lit(0).cast("long")
    cells = ["cell"] if by_cell else []
    if by_cell:
        nq = queries.groupBy("cell").agg(_blocks(QUERY_ELEMENTS).alias("qb"))
        nc = catalog.groupBy("cell").agg(_blocks(CATALOG_ELEMENTS).alias("cb"))
        grid = nq.join(nc, "cell")
        q, c = queries.join(grid, "cell"), catalog.join(grid, "cell")
    else:
        qb = queries.agg(_blocks(QUERY_ELEMENTS).alias("qb")).scalar()
        cb = catalog.agg(_blocks(CATALOG_ELEMENTS).alias("cb")).scalar()
        q, c = (df.withColumn("qb", qb).withColumn("cb", cb) for df in (queries, catalog))
    # Aliases give each side columns of its own, also where both come from one table.
    cell = [F.col("cell").alias("cell")] if by_cell else []
    q = q.select(
        "query_key", F.col("vec").alias("vec"), *cell,
        F.pmod(F.xxhash64("query_key"), F.col("qb")).alias("qblock"),
        F.explode(F.sequence(zero, F.col("cb") - 1)).alias("cblock"),
    )
    c = c.select(
        "item_id", F.col("vec").alias("vec"), *cell,
        F.explode(F.sequence(zero, F.col("qb") - 1)).alias("qblock"),
        F.pmod(F.xxhash64("item_id"), F.col("cb")).alias("cblock"),
    )
    keys = [*cells, "qblock", "cblock"]
    fields = [
        T.StructField("query_key", queries.schema["query_key"].dataType),
        T.StructField("item_id", catalog.schema["item_id"].dataType),
        T.StructField("score", T.DoubleType()),
    ]
    if by_cell:
        fields.append(T.StructField("cell", catalog.schema["cell"].dataType))
    task = _block_search(k, metric, by_cell)
    return q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(task, T.StructType(fields))


def _best(partial: DataFrame, k: int, metric: str) -> DataFrame:
    first = F.desc("score") if metric == "ip" else F.asc("score")
    ranked = top_per_group(partial, ["query_key"], [first, F.asc("item_id")], k)
    return ranked.select("query_key", F.col("rank").cast("int").alias("rank"), "item_id", "score")


def _distance(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda total, x: total + x))


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def place_in_blocks(rows: DataFrame, key: str, elements: int, block: str) -> tuple[DataFrame, DataFrame]:
    """Neighbouring vectors in blocks of about ``elements``: (key, vec, block), and (block, center, radius, n).

    Each vector goes to the nearest of some sampled vectors, a few per block that is needed. A cell above the size,
    such as that of one vector that many rows share, is split by hash into blocks of the same center.
    """
    n = rows.agg(_blocks(elements).alias("n")).first()["n"] or 1
    picked = rows.orderBy(F.md5(F.col(key).cast("string")), key).limit(PIVOTS_PER_BLOCK * n)
    picked = picked.groupBy("vec").agg(F.min(key).alias("_id"))
    number = F.row_number().over(W.orderBy(F.md5(F.col("_id").cast("string")), "_id")).cast("long")
    pivots = materialize(picked.select(number.alias("cell"), F.col("vec").alias("center")), "pivots")
    near = block_topk(
        rows.select(F.col(key).alias("query_key"), "vec"), pivots.select(F.col("cell").alias("item_id"), F.col("center").alias("vec")), 1, "l2", by_cell=False
    )
    near = _best(near, 1, "l2").select(F.col("query_key").alias(key), F.col("item_id").alias("cell"))
    # Centers are looked up by cell and not stored with every vector.
    placed = rows.select(key, "vec").join(near, key).join(pivots, "cell").select(key, "vec", "cell", _distance("vec", "center").alias("far"))
    placed = materialize(placed, "placed")
    parts = placed.groupBy("cell").agg(_blocks(elements).alias("parts"))
    number = F.shiftleft("cell", 24) + F.pmod(F.xxhash64(key), F.col("parts"))
    placed = materialize(placed.join(parts, "cell").select(key, "vec", "cell", "far", number.alias(block)), "blocks")
    blocks = placed.groupBy(block).agg(F.first("cell").alias("cell"), F.max("far").alias("radius"), F.count(F.lit(1)).alias("n"))
    blocks = blocks.join(pivots, "cell").select(block, "center", "radius", "n")
    return placed.select(key, "vec", block), materialize(blocks, "block-radii")


def _bounds_task(metric: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For every pair of blocks the best score that any of its pairs of vectors can have, higher being better."""
    slack, relative = SLACK, RELATIVE_SLACK

    def bounds(queries: pa.Table, catalog: pa.Table) -> pa.Table:
        import numpy as np

        def side(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            center = t.column("center").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
            return center, np.linalg.norm(center, axis=1), t.column("radius").to_numpy()

        out = []
        if queries.num_rows and catalog.num_rows:
            (q, q_len, q_far), (c, c_len, c_far) = side(queries), side(catalog)
            for i in range(len(q)):
                if metric == "ip":
                    best = c @ q[i] + q_len[i] * c_far + q_far[i] * (c_len + c_far)
                else:
                    best = -(np.maximum(np.linalg.norm(c - q[i], axis=1) - q_far[i] - c_far, 0.0) ** 2)
                out.append(best + slack + relative * (q_len[i] + q_far[i] + c_len + c_far) ** 2)
        at = np.arange(queries.num_rows * catalog.num_rows)
        rows, columns = (at // catalog.num_rows, at % catalog.num_rows) if len(at) else (at, at)
        return pa.table({
            "qblock": queries.column("qblock").take(pa.array(rows)), "cblock": catalog.column("cblock").take(pa.array(columns)),
            "n": catalog.column("n").take(pa.array(columns)), "bound": pa.array(np.concatenate(out) if out else np.zeros(0)),
        })

    return bounds


def _block_bounds(qblocks: DataFrame, cblocks: DataFrame, metric: str) -> DataFrame:
    """(qblock, cblock, n, bound) of all pairs of blocks, in groups of bounded size on both sides."""
    count = lambda df, elements: df.agg(F.ceil(F.count(F.lit(1)) * F.max(F.size("center")) / elements).cast("long").alias("n")).first()["n"] or 1
    nq, nc = count(qblocks, QUERY_ELEMENTS), count(cblocks, CATALOG_ELEMENTS)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = qblocks.select("qblock", "center", "radius", F.pmod(F.xxhash64("qblock"), F.lit(nq)).alias("i"), each(nc).alias("j"))
    c = cblocks.select("cblock", "center", "radius", "n", each(nq).alias("i"), F.pmod(F.xxhash64("cblock"), F.lit(nc)).alias("j"))
    pairs = q.groupBy("i", "j").cogroup(c.groupBy("i", "j"))
    return pairs.applyInArrow(_bounds_task(metric), "qblock long, cblock long, n long, bound double")


def bounded_topk(queries: DataFrame, catalog: DataFrame, k: int, metric: str = "ip") -> tuple[DataFrame, DataFrame]:
    """(candidates, pairs): rows that hold each query's exact top k, and which pairs of blocks were searched.

    Vectors lie in blocks with a center and a radius, which bound the score of any pair of vectors of two blocks
    (Cauchy-Schwarz for products, the triangle inequality for distances). Each query block is first searched in the
    blocks of the best bounds that hold k vectors together. That gives every query a kth score, and only blocks whose
    bound reaches it, for a block of queries and then for the query itself, are searched further.
    """
    q, qblocks = place_in_blocks(queries, "query_key", QUERY_ELEMENTS, "qblock")
    c, cblocks = place_in_blocks(catalog, "item_id", CATALOG_ELEMENTS, "cblock")
    ahead = W.partitionBy("qblock").orderBy(F.desc("bound"), "cblock").rowsBetween(W.unboundedPreceding, -1)
    bounds = _block_bounds(qblocks, cblocks, metric)
    bounds = materialize(bounds.withColumn("first", F.coalesce(F.sum("n").over(ahead), F.lit(0)) < k), "block-bounds")
    fields = [queries.schema["query_key"], catalog.schema["item_id"], T.StructField("score", T.DoubleType())]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])

    def search(asked: DataFrame, pairs: DataFrame) -> DataFrame:
        keys = ["qblock", "cblock"]
        # Aliases give each side columns of its own: both come from the same pairs.
        own = [F.col(name).alias(name) for name in keys]
        asked = asked.select("query_key", "vec", *own)
        stored = c.join(pairs, "cblock").select("item_id", "vec", *own)
        return asked.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInArrow(_block_search(k, metric, False), schema)

    nearest = bounds.where("first").select("qblock", "cblock")
    found = materialize(search(q.join(nearest, "qblock"), nearest), "nearest-lists")
    order = F.desc("score") if metric == "ip" else F.asc("score")
    worth = F.col("score") if metric == "ip" else -F.col("score")
    kth = top_per_group(found, ["query_key"], [order, F.asc("item_id")], k).where(F.col("rank") == k).select("query_key", worth.alias("kth"))
    known = q.join(kth, "query_key", "left").withColumn("kth", F.coalesce("kth", F.lit(float("-inf"))))
    limits = known.groupBy("qblock").agg(F.min("kth").alias("limit"))
    rest = bounds.where(~F.col("first")).join(limits, "qblock").where("bound >= limit").select("qblock", "cblock")
    asked = known.join(rest, "qblock").join(cblocks.select("cblock", "center", "radius"), "cblock")
    length, far = F.sqrt(_dot("vec", "vec")), F.sqrt(_dot("center", "center")) + F.col("radius")
    gap = F.greatest(_distance("vec", "center") - F.col("radius"), F.lit(0.0))
    best = _dot("vec", "center") + length * F.col("radius") if metric == "ip" else -gap * gap
    best = best + F.lit(SLACK) + F.lit(RELATIVE_SLACK) * (length + far) * (length + far)
    asked = materialize(asked.where(best >= F.col("kth")).select("query_key", "qblock", "cblock"), "open-searches")
    more = asked.select("qblock", "cblock").distinct()
    found = found.unionByName(search(asked.join(q.select("query_key", "vec"), "query_key"), more))
    return found, nearest.unionByName(more)


def exact_topk(queries: DataFrame, catalog: DataFrame, k: int = 100, metric: str = "ip") -> DataFrame:
    """(query_key, rank, item_id, score) by inner product, or by squared L2 distance.

    Inputs: (query_key, vec) and (item_id, vec) with ARRAY<DOUBLE> vectors. Score ties (equal to 9
    digits) go to the smaller id. Beyond a few blocks, pairs of blocks that cannot hold a result are left out.
    """
    if metric not in ("ip", "l2"):
        raise ValueError(f"unknown metric: {metric}")
    q, c = queries.select("query_key", "vec"), catalog.select("item_id", "vec")
    blocks = [df.agg(_blocks(n).alias("n")).first()["n"] or 0 for df, n in ((q, QUERY_ELEMENTS), (c, CATALOG_ELEMENTS))]
    if blocks[0] * blocks[1] < BOUNDED_PAIRS:
        return _best(block_topk(q, c, k, metric, by_cell=False), k, metric)
    return _best(bounded_topk(q, c, k, metric)[0], k, metric)


def assign_cells(items: DataFrame, centroids: DataFrame, key: str = "item_id", metric: str = "ip") -> DataFrame:
    """Nearest centroid of every vector, by the search's own metric: (key, vec, cell)."""
    q = items.select(F.col(key).alias("query_key"), "vec")
    c = centroids.select(F.col("cell").alias("item_id"), "vec")
    near = exact_topk(q, c, 1, metric).select(F.col("query_key").alias(key), F.col("item_id").alias("cell"))
    return items.join(near, key)


def nearest_cells(queries: DataFrame, centroids: DataFrame, nprobe: int, metric: str = "ip") -> DataFrame:
    """(query_key, cell, probe_rank) of every query's nearest cells."""
    if nprobe < 1:
        raise ValueError("nprobe must be >= 1")
    c = centroids.select(F.col("cell").alias("item_id"), "vec")
    near = exact_topk(queries.select("query_key", "vec"), c, nprobe, metric)
    return near.select("query_key", F.col("item_id").alias("cell"), F.col("rank").alias("probe_rank"))


def _search_cells(queries: DataFrame, probes: DataFrame, placed: DataFrame, k: int, metric: str) -> DataFrame:
    q = queries.select("query_key", "vec").join(probes.drop("probe_rank"), "query_key")
    found = block_topk(q, placed, k, metric)
    return found.join(probes, ["query_key", "cell"]).select("query_key", "probe_rank", "item_id", "score")


def ivf_partial(queries: DataFrame, catalog: DataFrame, centroids: DataFrame, k: int, nprobe: int, metric: str = "ip") -> DataFrame:
    """(query_key, probe_rank, item_id, score): the k best of each cell among a query's nprobe nearest.

    The list for any smaller nprobe is the best of its rows up to that probe rank (``ivf_lists``), so a
    recall curve over nprobe costs one search.
    """
    probes = nearest_cells(queries, centroids, nprobe, metric)
    return _search_cells(queries, probes, assign_cells(catalog.select("item_id", "vec"), centroids, metric=metric), k, metric)


def ivf_lists(partial: DataFrame, k: int, nprobe: int, metric: str = "ip") -> DataFrame:
    return _best(partial.where(F.col("probe_rank") <= nprobe), k, metric)


def ivf_topk(
    queries: DataFrame, catalog: DataFrame, centroids: DataFrame, k: int = 100, nprobe: int = 16, metric: str = "ip"
) -> DataFrame:
    """E5: each query searches the cells of its nprobe nearest centroids only.

    ``centroids`` (cell, vec) is the coarse quantizer: label means, ``sample_centroids`` or ``train_centroids``.
    """
    probes = materialize(nearest_cells(queries, centroids, nprobe, metric), "probes")
    placed = materialize(assign_cells(catalog.select("item_id", "vec"), centroids, metric=metric), "placed")
    return probed_topk(queries, probes, placed, k, metric)


def probed_topk(queries: DataFrame, probes: DataFrame, placed: DataFrame, k: int, metric: str = "ip") -> DataFrame:
    """(query_key, rank, item_id, score): the k best of all cells that a query probes.

    ``probes`` (query_key, cell), ``placed`` (item_id, vec, cell). Cells are put together into groups of a catalog
    block's size, and a cell above it is split. A query is sent once to a group with the list of its cells there, and
    the group sends on at most k rows for all of them, not k per cell.
    """
    groups = materialize(_cell_groups(placed), "cell-groups")
    opened = probes.join(groups, "cell").select("query_key", "cell", F.explode(F.sequence(F.col("group"), F.col("group") + F.col("parts") - 1)).alias("group"))
    asked = materialize(opened.groupBy("query_key", "group").agg(F.collect_list("cell").alias("cells")), "asked-cells")
    dim = queries.agg(F.max(F.size("vec")).alias("d")).scalar()
    blocks = materialize(asked.groupBy("group").agg(F.ceil(F.count(F.lit(1)) * dim / QUERY_ELEMENTS).cast("long").alias("qb")), "group-blocks")
    q = queries.select("query_key", "vec").join(asked.join(blocks, "group"), "query_key")
    q = q.select("query_key", F.col("vec").alias("vec"), "cells", F.col("group").alias("group"), F.pmod(F.xxhash64("query_key"), F.col("qb")).alias("qblock"))
    part = (F.col("group") + F.pmod(F.xxhash64("item_id"), F.col("parts"))).alias("group")
    c = placed.join(groups, "cell").select("item_id", F.col("vec").alias("vec"), "cell", part)
    c = c.join(blocks, "group").select(
        "item_id", "vec", "cell", F.col("group").alias("group"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("qb") - 1)).alias("qblock")
    )
    fields = [T.StructField("query_key", queries.schema["query_key"].dataType), T.StructField("item_id", placed.schema["item_id"].dataType)]
    keys = ["group", "qblock"]
    found = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(_probed_search(k, metric), T.StructType([*fields, T.StructField("score", T.DoubleType())]))
    return _best(found, k, metric)


def _cell_groups(placed: DataFrame) -> DataFrame:
    """(cell, group, parts): neighbours by number share a group of bounded size; a large cell has groups of its own, from ``group`` on."""
    size = placed.groupBy("cell").agg((F.count(F.lit(1)) * F.max(F.size("vec"))).alias("_e"))
    size = size.withColumn("parts", F.greatest(F.ceil(F.col("_e") / CATALOG_ELEMENTS), F.lit(1)).cast("long"))
    run = W.orderBy("cell").rowsBetween(W.unboundedPreceding, W.currentRow)
    small, large = F.when(F.col("parts") == 1, F.col("_e")).otherwise(0), F.when(F.col("parts") > 1, F.col("parts")).otherwise(0)
    group = F.when(F.col("parts") == 1, F.floor((F.sum(small).over(run) - small) / CATALOG_ELEMENTS)).otherwise(-F.sum(large).over(run))
    return size.select("cell", group.cast("long").alias("group"), "parts")


def _probed_search(k: int, metric: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Top k of each query over the cells it probes in one group."""
    at_once, digits = SCORES_AT_ONCE, SCORE_DIGITS

    def search(queries: pa.Table, catalog: pa.Table) -> pa.Table:
        import numpy as np
        import pyarrow.compute as pc

        def matrix(t: pa.Table) -> np.ndarray:
            return t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)

        out_q, out_c, out_s = [], [], []
        if queries.num_rows and catalog.num_rows:
            # By cell, and by id inside: a cell is a slice.
            coded = catalog.column("cell").combine_chunks().dictionary_encode()
            code, ids = coded.indices.to_numpy(), catalog.column("item_id").to_numpy()
            order = np.lexsort((ids, code))
            c, ids, code = matrix(catalog)[order], ids[order], code[order]
            ends = np.searchsorted(code, np.arange(len(coded.dictionary) + 1))
            q, lists = matrix(queries), queries.column("cells").combine_chunks()
            probed = pc.fill_null(pc.index_in(lists.flatten(), coded.dictionary), -1).to_numpy()
            asker = np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
            step = max(1, at_once // len(c))
            for start in range(0, len(q), step):
                part = q[start : start + step]
                a, b = np.searchsorted(asker, [start, start + len(part)])
                mine = probed[a:b] >= 0
                times = np.zeros((len(part), len(ends) - 1), np.int64)  # a repeated id may probe a cell more than once
                np.add.at(times, (asker[a:b][mine] - start, probed[a:b][mine]), 1)
                s = np.full((len(part), len(c)), -np.inf)
                for cell in np.flatnonzero(times.any(0)):
                    rows, at = np.flatnonzero(times[:, cell]), slice(ends[cell], ends[cell + 1])
                    x = part[rows] @ c[at].T
                    if metric == "l2":
                        x = 2.0 * x - (part[rows] * part[rows]).sum(1)[:, None] - (c[at] * c[at]).sum(1)[None, :]
                    s[rows, at] = np.round(x, digits)
                kk = min(k, len(c))
                cut = np.partition(s, len(c) - kk, axis=1)[:, len(c) - kk]
                for i in range(len(part)):
                    hit = np.flatnonzero((s[i] >= cut[i]) & (s[i] > -np.inf))
                    hit = hit[np.lexsort((ids[hit], -s[i][hit]))]
                    hit = np.repeat(hit, times[i, code[hit]] ** 2)[:k]
                    out_q.append(np.full(len(hit), start + i))
                    out_c.append(order[hit])
                    out_s.append(s[i][hit])
        rows_q, rows_c = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (out_q, out_c))
        score = np.concatenate(out_s) if out_s else np.empty(0)
        return pa.table({
            "query_key": queries.column("query_key").take(pa.array(rows_q)), "item_id": catalog.column("item_id").take(pa.array(rows_c)),
            "score": pa.array(-score if metric == "l2" else score),
        })

    return search


def store_cells(catalog: DataFrame, centroids: DataFrame, path: str, metric: str = "ip") -> None:
    """Write (item_id, vec) as an inverted file: a table partitioned by cell. A large cell is several files."""
    placed = materialize(assign_cells(catalog.select("item_id", "vec"), centroids, metric=metric), "placed")
    parts = placed.groupBy("cell").agg(_blocks(CATALOG_ELEMENTS).alias("parts"))
    dealt = placed.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("item_id"), F.col("parts")))
    dealt.repartition("cell", "part").select("item_id", "vec", "cell").write.partitionBy("cell").parquet(path)


def read_cells(spark: SparkSession, path: str, cells: list, item_type: str = "long", cell_type: str = "long") -> DataFrame:
    """(item_id, vec, cell) of the given cells of an inverted file; the folders of other cells are not opened."""
    stored = spark.read.schema(f"item_id {item_type}, vec array<double>, cell {cell_type}").parquet(path)
    return stored.where(F.col("cell").isin(cells))


def stored_ivf_topk(queries: DataFrame, path: str, centroids: DataFrame, k: int = 100, nprobe: int = 16, metric: str = "ip", item_type: str = "long") -> DataFrame:
    """E5 over a stored inverted file: only the cells that some query probes are read.

    The probed cells are listed on the driver: at most as many ids as there are centroids.
    """
    probes = materialize(nearest_cells(queries, centroids, nprobe, metric), "probes")
    cells = [row["cell"] for row in probes.select("cell").distinct().collect()]
    placed = read_cells(queries.sparkSession, path, cells, item_type, probes.schema["cell"].dataType.simpleString())
    return ivf_lists(_search_cells(queries, probes, placed, k, metric), k, nprobe, metric)


def refine_centroids(catalog: DataFrame, centroids: DataFrame, steps: int = 2) -> DataFrame:
    """Lloyd steps from given centroids: each becomes the mean of the vectors nearest to it; one without any goes."""
    for _ in range(steps):
        placed = assign_cells(catalog.select("item_id", "vec"), centroids, metric="l2")
        centroids = materialize(sum_vectors(placed, ["cell"], "vec", "vec", mean=True), "centroids")
    return centroids


def sample_centroids(catalog: DataFrame, nlist: int) -> DataFrame:
    """Coarse centroids: the nlist vectors with the smallest md5 of their id (all, if there are fewer)."""
    picked = catalog.orderBy(F.md5(F.col("item_id").cast("string")), "item_id").limit(max(1, int(nlist)))
    return picked.select(F.col("item_id").alias("cell"), "vec")


def train_centroids(catalog: DataFrame, nlist: int, seed: int = 42, max_iter: int = 20) -> DataFrame:
    """Coarse centroids by k-means; nlist is clipped to [1, number of vectors]."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    nlist = max(1, min(int(nlist), catalog.count()))
    spark = catalog.sparkSession
    data = catalog.select(array_to_vector("vec").alias("features"))
    if nlist == 1:
        return sum_vectors(catalog, [], "vec", "vec", mean=True).select(F.lit(0).alias("cell"), "vec")
    model = KMeans(k=nlist, seed=seed, maxIter=max_iter).fit(data)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(model.clusterCenters())]
    return spark.createDataFrame(rows, "cell int, vec array<double>")


def recall_against_exact(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Mean share of each query's exact list that was found; queries with no exact list do not count."""
    # Lists meet as one row per query; a missing id counts in a list, but is never found.
    none = F.max(F.col("item_id").isNull().cast("int")).alias("_none")
    truth = exact.groupBy("query_key").agg(F.collect_set("item_id").alias("_truth"), none)
    lists = truth.join(found.groupBy("query_key").agg(F.collect_set("item_id").alias("_found")), "query_key", "left")
    hits = F.when(F.col("_found").isNull(), 0).otherwise(F.size(F.array_intersect("_truth", "_found")))
    per_query = lists.select((hits / (F.size("_truth") + F.col("_none"))).alias("r"))
    return per_query.agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("recall"))


def recall_drop(exact_recall: F.Column, approx_recall: F.Column) -> F.Column:
    return F.greatest(exact_recall - approx_recall, F.lit(0.0))


def judge_trials(trials: DataFrame, cost_target: float = 50.0, max_recall_drop: float = 0.02) -> DataFrame:
    """Flag every trial (nlist, cost, recall_drop) against both targets and mark the best one.

    Best: both targets met first, then lowest cost, then lowest drop, then lowest nlist.
    """
    flags = trials.withColumn("meets_cost", F.col("cost") < cost_target).withColumn(
        "meets_recall", F.col("recall_drop") < max_recall_drop
    )
    miss = (~(F.col("meets_cost") & F.col("meets_recall"))).cast("int")
    best = flags.agg(F.min(F.struct(miss, "cost", "recall_drop", "nlist"))["nlist"].alias("nlist"))
    return flags.withColumn("is_best", F.col("nlist") == best.scalar())


def hash_encode(df: DataFrame, key: str, text_col: str, dim: int = 64, seed: int = 42) -> DataFrame:
    """E2, default encoder: signed feature hashing of word tokens to unit vectors, as JVM expressions.

    The terms of one text are hashed and summed by position within the row, so nothing is shuffled.
    """
    slot = lambda t: F.pmod(seeded_int(seed, t), F.lit(2 * dim))
    slots = F.transform(word_tokens(F.col(text_col)), slot)
    zeros = F.array_repeat(F.lit(0.0), dim)

    def add(acc, s):
        at = F.floor(s / 2)
        sign = F.when(s % 2 == 0, 1.0).otherwise(-1.0)
        return F.transform(acc, lambda x, i: F.when(i == at, x + sign).otherwise(x))

    vec = F.aggregate(slots, zeros, add)
    return df.select(key, l2_normalize(vec).alias("vec"))


def encode_corpus(df: DataFrame, key: str, text_col: str, load_encoder: Callable[[], Callable], batch_rows: int = 64) -> DataFrame:
    """E2, pluggable encoder: ``load_encoder()`` runs once per task and returns texts -> float matrix.

    Rows stream through in Arrow batches; vectors are normalized here. An empty corpus gives no rows.
    """
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("vec", T.ArrayType(T.DoubleType()))])

    def run(batches):
        import numpy as np
        import pandas as pd

        encode = load_encoder()
        for pdf in batches:
            for start in range(0, len(pdf), batch_rows):
                part = pdf.iloc[start : start + batch_rows]
                m = np.asarray(encode(part[text_col].fillna("").tolist()), dtype=np.float64)
                m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({key: part[key].to_numpy(), "vec": list(m)})

    return df.select(key, text_col).mapInPandas(run, schema)

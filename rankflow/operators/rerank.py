"""Click features, candidate frames, the click model and reranking reports (H1-H9)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankflow.functions.hashing import number_before
from rankflow.functions.ordering import bucketed_rank, top_per_group
from rankflow.functions.vecmath import dot
from rankflow.operators.catalog import category_lookup
from rankflow.operators.metrics import discount
from rankflow.sources.scratch import materialize

# The click model's features, in order.
FEATURES = [
    "similarity_score",
    "category_match_binary",
    "historical_global_ctr",
    "user_category_affinity",
    "product_popularity",
]

# Rows that go through the click network at once in a task.
FORWARD_ROWS = 16_384

# Permutation importance: rows of a block, rows that a task holds to pack them, scores of a range, rows drawn for its cuts.
IMPORTANCE_BLOCK = 65_536
ROWS_AT_ONCE = 400_000
RANGE_SCORES = 250_000
CUT_ROWS = 20_000


def product_features(interactions: DataFrame, catalog: DataFrame, ctr_smoothing: float = 10.0) -> DataFrame:
    """H1: (product_id, category, global_ctr, product_popularity) for every catalog product.

    The prior is the unweighted mean over products with interactions; products without any get the
    prior and popularity 0.
    """
    if "product_id" not in interactions.columns:
        raise ValueError("no product_id column to count by")
    if "score" in interactions.columns:
        raw = (F.col("score").cast("double") - 1.0) / 4.0
    else:
        raw = F.col("label").cast("double")
    signal = F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))
    stats = interactions.groupBy("product_id").agg(F.avg(signal).alias("ctr"), F.count(signal).alias("n"))
    prior = F.coalesce(stats.agg(F.avg("ctr").alias("p")).scalar(), F.lit(0.0))
    top = F.greatest(F.coalesce(stats.agg(F.max("n").alias("m")).scalar(), F.lit(1)), F.lit(1)).cast("double")
    smoothed = (F.col("ctr") * F.col("n") + F.lit(ctr_smoothing) * prior) / (F.col("n") + F.lit(ctr_smoothing))
    return (
        category_lookup(catalog)
        .join(stats, "product_id", "left")
        .select(
            "product_id",
            F.coalesce("category", F.lit("unknown")).alias("category"),
            F.coalesce(smoothed, prior).alias("global_ctr"),
            F.coalesce(F.log1p(F.col("n").cast("double")) / F.log1p(top), F.lit(0.0)).alias("product_popularity"),
        )
    )


def user_category_affinity(interactions: DataFrame, catalog: DataFrame, smoothing: float = 5.0) -> DataFrame:
    """H2: (user_id, category, affinity), shrunk toward the mean label over all rows."""
    frame = interactions.select("user_id", "product_id", "label").join(category_lookup(catalog), "product_id", "left")
    mean = F.coalesce(interactions.agg(F.avg("label").alias("m")).scalar(), F.lit(0.0))
    return (
        frame.groupBy("user_id", F.coalesce("category", F.lit("unknown")).alias("category"))
        .agg(F.sum("label").alias("positives"), F.count("label").alias("impressions"))
        .select(
            "user_id",
            "category",
            ((F.col("positives") + F.lit(smoothing) * mean) / (F.col("impressions") + F.lit(smoothing))).alias("affinity"),
        )
    )


def candidate_frame(requests: DataFrame, retrieved: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """H3: one row per (request, candidate).

    ``requests`` (query_idx, user_id, product_id, category, query_text, ...), ``retrieved``
    (query_text, rank, item_id, score): lists are per distinct text and joined back to the requests.
    ``extra`` names request columns to keep.
    """
    lists = retrieved.where(F.col("item_id").isNotNull())
    return requests.join(lists, "query_text").select(
        *extra,
        "query_idx",
        "user_id",
        F.col("product_id").alias("target_product_id"),
        F.col("category").alias("query_category"),
        "query_text",
        F.col("item_id").alias("candidate_product_id"),
        F.col("rank").alias("retrieval_rank"),
        F.col("score").alias("similarity_score"),
        (F.col("item_id") == F.col("product_id")).cast("int").alias("label"),
    )


def add_features(candidates: DataFrame, features: DataFrame, affinity: DataFrame) -> DataFrame:
    """H4: candidates with the five click features; missing numbers are 0, a missing category "unknown"."""
    table = features.select(
        F.col("product_id").alias("candidate_product_id"), F.col("category").alias("candidate_category"),
        F.col("global_ctr").alias("historical_global_ctr"), "product_popularity",
    )
    taste = affinity.select(
        "user_id", F.col("category").alias("candidate_category"), F.col("affinity").alias("user_category_affinity")
    )
    joined = candidates.join(table, "candidate_product_id", "left").withColumn(
        "candidate_category", F.coalesce("candidate_category", F.lit("unknown"))
    )
    match = F.coalesce((F.col("candidate_category") == F.col("query_category")).cast("double"), F.lit(0.0))
    return (
        joined.join(taste, ["user_id", "candidate_category"], "left")
        .withColumn("category_match_binary", match)
        .fillna(0.0, FEATURES)
    )


def candidate_lists(retrieved: DataFrame, features: DataFrame) -> DataFrame:
    """(query_text, list): per distinct text its candidates in retrieval order, with what depends on the candidate only.

    Product features are joined here, once per (text, candidate), and not once per request.
    """
    table = features.select(F.col("product_id").alias("item_id"), "category", "global_ctr", "product_popularity")
    rows = retrieved.where(F.col("item_id").isNotNull()).join(table, "item_id", "left")
    one = F.struct(
        F.col("rank").alias("retrieval_rank"),
        F.col("item_id").alias("candidate_product_id"),
        F.coalesce("category", F.lit("unknown")).alias("candidate_category"),
        F.col("score").alias("similarity_score"),
        F.coalesce("global_ctr", F.lit(0.0)).alias("historical_global_ctr"),
        F.coalesce("product_popularity", F.lit(0.0)).alias("product_popularity"),
    )
    return rows.groupBy("query_text").agg(F.array_sort(F.collect_list(one)).alias("list"))


def with_taste(requests: DataFrame, affinity: DataFrame) -> DataFrame:
    """Requests with their user's affinities as one map ``taste`` (a number per category)."""
    pair = F.struct("category", "affinity")
    taste = affinity.groupBy("user_id").agg(F.map_from_entries(F.collect_list(pair)).alias("taste"))
    return requests.join(taste, "user_id", "left")


def pack_requests(requests: DataFrame, lists: DataFrame, affinity: DataFrame | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """H3 and H4 with one row per request: its candidates with all click features, in the array ``cands``.

    A request meets the map of its user and then the list of its text, so only narrow rows are moved. Requests that
    have their map (``with_taste``) already need no ``affinity``. ``feature_rows`` and ``unpack`` give rows.
    """
    if affinity is not None:
        requests = with_taste(requests, affinity)
    joined = requests.join(lists, "query_text")

    def candidate(c):
        kept = ["candidate_product_id", "candidate_category", "retrieval_rank", "similarity_score", "historical_global_ctr", "product_popularity"]
        return F.struct(*[c[k].alias(k) for k in kept], *_request_features(c.getItem))

    return joined.select(*_request_columns(extra), F.transform("list", candidate).alias("cands"))


def feature_rows(requests: DataFrame, lists: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """The rows of ``add_features`` for requests with their ``taste``: lists are opened before features are made."""
    names = [f"r_{c}" for c in ("category", "product_id")]
    asked = requests.withColumnsRenamed({n[2:]: n for n in names})
    rows = asked.join(lists, "query_text").select(*asked.columns, F.inline("list"))
    made = rows.withColumnsRenamed({n: n[2:] for n in names})
    kept = ["candidate_product_id", "candidate_category", "retrieval_rank", "similarity_score", "historical_global_ctr", "product_popularity"]
    return made.select(*_request_columns(extra), *kept, *_request_features(F.col))


def _request_columns(extra: Sequence[str]) -> list:
    return [*extra, "query_idx", "user_id", F.col("product_id").alias("target_product_id"), F.col("category").alias("query_category"), "query_text"]


def _request_features(c: Callable[[str], Column]) -> list[Column]:
    """What a candidate's features take from the request; ``c`` gives the candidate's fields."""
    known = F.coalesce(F.try_element_at("taste", c("candidate_category")), F.lit(0.0))
    match = F.coalesce((c("candidate_category") == F.col("category")).cast("double"), F.lit(0.0))
    label = (c("candidate_product_id") == F.col("product_id")).cast("int")
    return [match.alias("category_match_binary"), known.alias("user_category_affinity"), label.alias("label")]


def unpack(packed: DataFrame) -> DataFrame:
    """One row per (request, candidate)."""
    return packed.select(*[c for c in packed.columns if c != "cands"], F.inline("cands"))


def counted_candidates(requests: DataFrame, lists: DataFrame, affinity: DataFrame) -> DataFrame:
    """The rows of ``pack_requests``, counted: per text, query category and candidate category the candidates of the text,
    how many requests have each affinity to that category, and which of the candidates were asked for, how often.

    A candidate's features depend on its text, the two categories and that affinity, so these are all rows of all requests,
    each as often as it occurs. Only counts are moved, and no row is made per request and candidate.
    """
    keys = ["query_text", "category"]
    asked = requests.select("user_id", "product_id", *keys)
    taste = affinity.select("user_id", F.col("category").alias("liked"), "affinity")
    rows = lists.select("query_text", F.inline("list"))
    one = F.struct("candidate_product_id", "similarity_score", "historical_global_ctr", "product_popularity")
    groups = rows.groupBy("query_text", F.col("candidate_category").alias("liked")).agg(F.sort_array(F.collect_list(one)).alias("candidates"))
    likes = asked.join(taste, "user_id").groupBy(*keys, "liked", "affinity").agg(F.count(F.lit(1)).alias("n"))
    likes = likes.groupBy(*keys, "liked").agg(F.sort_array(F.collect_list(F.struct("affinity", "n"))).alias("likes"))
    known = rows.select("query_text", F.col("candidate_product_id").alias("product_id"), F.col("candidate_category").alias("liked")).distinct()
    found = asked.join(known, ["query_text", "product_id"]).join(taste, ["user_id", "liked"], "left")
    found = found.groupBy(*keys, "liked", "product_id", F.coalesce("affinity", F.lit(0.0)).alias("affinity")).agg(F.count(F.lit(1)).alias("n"))
    found = found.groupBy(*keys, "liked").agg(F.sort_array(F.collect_list(F.struct("product_id", "affinity", "n"))).alias("clicked"))
    total = asked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(groups, "query_text")
    total = total.withColumn("category_match_binary", F.coalesce((F.col("liked") == F.col("category")).cast("double"), F.lit(0.0)))
    return total.join(likes, [*keys, "liked"], "left").join(found, [*keys, "liked"], "left")


def _row_parts(features: Sequence[str]):
    """(features, rows, clicks) of plain rows, for tasks."""
    names = list(features)

    def parts(batches: Iterator) -> Iterator:
        import numpy as np

        for batch in batches:
            column = lambda n: batch.column(batch.schema.get_field_index(n)).cast("double").to_numpy(zero_copy_only=False)
            yield np.column_stack([column(n) for n in names]), np.ones(batch.num_rows), column("label")

    return parts


def _counted_parts(features: Sequence[str]):
    """(features, rows, clicks) of ``counted_candidates``: what is asked for is a row of its own, counted among the rows already."""
    names, at_once = list(features), FORWARD_ROWS

    def parts(batches: Iterator) -> Iterator:
        import numpy as np

        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda n: batch.column(batch.schema.get_field_index(n))[row]  # noqa: E731, B023
                listed = get("candidates").values
                field = lambda v, n: v.field(n).to_numpy(zero_copy_only=False)
                columns = [field(listed, n).astype(float) if n not in ("category_match_binary", "user_category_affinity") else None for n in names]
                match, total = get("category_match_binary").as_py(), get("n").as_py()
                liked, times, clicked = np.zeros(0), np.zeros(0), get("clicked").values
                if get("likes").is_valid:
                    liked, times = (field(get("likes").values, n).astype(float) for n in ("affinity", "n"))
                liked, times = np.r_[liked, 0.0], np.r_[times, total - times.sum()]

                def made(at, affinity, columns=columns, match=match):
                    values = {"category_match_binary": np.full(len(at), match), "user_category_affinity": affinity}
                    return np.column_stack([values[n] if c is None else c[at] for n, c in zip(names, columns, strict=True)])

                keep = times > 0
                liked, times = liked[keep], times[keep]
                step = max(1, at_once // max(1, len(liked)))
                for low in range(0, len(listed) if len(liked) else 0, step):
                    at = np.arange(low, min(low + step, len(listed)))
                    yield made(np.repeat(at, len(liked)), np.tile(liked, len(at))), np.tile(times, len(at)), np.zeros(len(at) * len(liked))
                if clicked is not None and len(clicked):
                    item, wanted = field(listed, "candidate_product_id"), field(clicked, "product_id")
                    # A product that is listed twice is clicked at both places.
                    first, last = np.searchsorted(item, wanted), np.searchsorted(item, wanted, "right")
                    who = np.repeat(np.arange(len(wanted)), last - first)
                    at = np.concatenate([np.arange(a, b) for a, b in zip(first, last)]).astype(int)
                    yield made(at, field(clicked, "affinity").astype(float)[who]), np.zeros(len(who)), field(clicked, "n").astype(float)[who]

    return parts


def _moments(parts):
    """Per task: rows, and per feature the mean and the sum of squares around it."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        n, mean, squares = 0.0, 0.0, 0.0
        for x, times, _ in parts(batches):
            some = times.sum()
            if some:
                middle = times @ x / some
                far = middle - mean
                squares = squares + times @ (x - middle) ** 2 + far * far * (n * some / (n + some))
                n, mean = n + some, mean + far * (some / (n + some))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([np.r_[mean, squares].tobytes()], pa.binary())], names=["n", "sums"])

    return run


def _loss(parts, weights, mean, scale, hidden: int):
    """Per task: the summed loss of the click network and its gradient, in the library's order of the weights."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        size = len(mean)
        w, b = weights[: size * hidden].reshape(size, hidden), weights[size * hidden :][:hidden]
        out, out_b = weights[(size + 1) * hidden : -2].reshape(hidden, 2), weights[-2:]
        side, total, grad = out[:, 1] - out[:, 0], 0.0, np.zeros(len(weights))
        for all_x, all_times, all_clicks in parts(batches):
            for low in range(0, len(all_x), rows):
                x, times, clicks = (all_x[low : low + rows] - mean) * scale, all_times[low : low + rows], all_clicks[low : low + rows]
                inner = 1.0 / (1.0 + np.exp(-(x @ w + b)))
                z = inner @ side + (out_b[1] - out_b[0])
                total += times @ np.logaddexp(0.0, z) - clicks @ z
                d = times / (1.0 + np.exp(-z)) - clicks
                to_out, back = d @ inner, np.outer(d, side) * inner * (1.0 - inner)
                grad += np.concatenate([(x.T @ back).ravel(), back.sum(0), np.column_stack([-to_out, to_out]).ravel(), [-d.sum(), d.sum()]])
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([grad.tobytes()], pa.binary())], names=["n", "sums"])

    rows = FORWARD_ROWS
    return run


def _minimize(measure: Callable, x, steps: int, tolerance: float = 1e-6, memory: int = 10):
    """L-BFGS with a line search for the weak Wolfe conditions; ``measure`` gives value and gradient."""
    import numpy as np

    value, grad = measure(x)
    pairs: list = []
    for _ in range(steps):
        if np.linalg.norm(grad) <= tolerance * max(abs(value), 1e-8):
            break
        way, marks = -grad, []
        for s, y in reversed(pairs):
            marks.append(s @ way / (s @ y))
            way = way - marks[-1] * y
        if pairs:
            way = way * (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1])
        for (s, y), mark in zip(pairs, reversed(marks), strict=True):
            way = way + (mark - y @ way / (s @ y)) * s
        slope, low, high = grad @ way, 0.0, np.inf
        far = 1.0 if pairs else min(1.0, 1.0 / np.linalg.norm(grad))
        for _ in range(20):
            there, new = measure(x + far * way)
            if not there <= value + 1e-4 * far * slope:
                high = far
            elif new @ way < 0.9 * slope:
                low = far
            else:
                break
            far = (low + high) / 2 if high < np.inf else 2 * far
        if not there < value:
            break
        if (new - grad) @ way > 0:
            pairs = [*pairs, (far * way, new - grad)][-memory:]
        x, value, grad = x + far * way, there, new
    return x


def click_model(train: DataFrame, hidden: int = 32, max_iter: int = 30, seed: int = 42, features: Sequence[str] = FEATURES):
    """H5: fitted pipeline: standard scaling, then one hidden layer, for p(click).

    ``train`` has a row per candidate with features and label, or the same rows as ``counted_candidates``. Every row
    counts. Loss, first weights and model are those of the library's multilayer perceptron; tasks sum loss and gradient over
    their rows, and only weights and sums pass the driver, where the library would keep all rows as vectors.
    """
    import numpy as np
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.linalg import Vectors

    spark, size = train.sparkSession, len(features)
    counted = "candidates" in train.columns
    rows = train if counted else materialize(train.select(*features, "label"), "click-rows")
    parts = (_counted_parts if counted else _row_parts)(features)

    def sums(task) -> list:
        return [(r["n"], np.frombuffer(r["sums"])) for r in rows.mapInArrow(task, "n double, sums binary").collect()]

    found = sums(_moments(parts))
    n = sum(m for m, _ in found)
    if not n:
        raise ValueError("no rows to fit the click model on")
    mean = sum(m * x[:size] for m, x in found) / n
    squares = sum(x[size:] + m * (x[:size] - mean) ** 2 for m, x in found)
    std = np.sqrt(squares / max(n - 1, 1))
    if not np.isfinite(std).all():
        raise ValueError("the click features have missing or infinite values")
    # Scaler and network are the library's, made of the figures: two rows have this mean and deviation.
    ends = spark.createDataFrame([(Vectors.dense(mean + sign * std / np.sqrt(2.0)), label) for sign, label in ((-1.0, 0.0), (1.0, 1.0))], ["raw_features", "label"])
    scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True).fit(ends)
    scaled = scaler.transform(ends)

    def network(**first):
        return MultilayerPerceptronClassifier(layers=[size, hidden, 2], maxIter=0, seed=seed, **first).fit(scaled)

    mean, std = scaler.mean.toArray(), scaler.std.toArray()
    scale = np.divide(1.0, std, out=np.zeros(size), where=std > 0)

    def measure(weights) -> tuple:
        found = sums(_loss(parts, weights, mean, scale, hidden))
        return sum(v for v, _ in found) / n, sum(g for _, g in found) / n

    weights = _minimize(measure, network().weights.toArray(), max_iter)
    net = network(initialWeights=Vectors.dense(weights))
    return PipelineModel([VectorAssembler(inputCols=list(features), outputCol="raw_features"), scaler, net])


def click_probability(model, frame: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Frame with ``rerank_probability``."""
    p = ClickNetwork.of_model(model).batch_probability([F.col(f).cast("double") for f in features])
    return frame.withColumn("rerank_probability", p)


@dataclass(frozen=True)
class ClickNetwork:
    """The click model's forward pass: scaled features, one hidden layer of sigmoids, p(click).

    As a table it is one row per unit (``weight_rows``), so a fitted model can be stored and read back, and its
    probabilities are plain column expressions, or a matrix product over packed lists.
    """

    mean: tuple[float, ...]
    scale: tuple[float, ...]  # 1 / standard deviation, 0 for constant features
    hidden: tuple[tuple[tuple[float, ...], float], ...]  # per unit: weights, bias
    out: tuple[float, ...]  # of the difference of the two output units
    out_bias: float

    @staticmethod
    def of_model(model) -> ClickNetwork:
        """From a fitted ``click_model``."""
        scaler, net = model.stages[1], model.stages[2]
        mean, std = scaler.mean.toArray().tolist(), scaler.std.toArray().tolist()
        n_in, n_hidden = len(mean), net.getLayers()[1] if hasattr(net, "getLayers") else (len(net.weights) - 2) // (len(mean) + 3)
        flat = net.weights.toArray().tolist()
        # Each layer: weights by input, then one bias per unit.
        weights = [[flat[i * n_hidden + u] for i in range(n_in)] for u in range(n_hidden)]
        at = n_in * n_hidden
        bias = flat[at : at + n_hidden]
        at += n_hidden
        out = [flat[at + 2 * u + 1] - flat[at + 2 * u] for u in range(n_hidden)]
        at += 2 * n_hidden
        hidden = tuple((tuple(w), b) for w, b in zip(weights, bias, strict=True))
        return ClickNetwork(tuple(mean), tuple(1.0 / s if s else 0.0 for s in std), hidden, tuple(out), flat[at + 1] - flat[at])

    @staticmethod
    def schema() -> str:
        return "layer string, unit int, weights array<double>, bias double"

    def weight_rows(self) -> list[tuple[str, int, list[float], float]]:
        rows = [("mean", 0, list(self.mean), 0.0), ("scale", 0, list(self.scale), 0.0), ("out", 0, list(self.out), self.out_bias)]
        return rows + [("hidden", u, list(w), b) for u, (w, b) in enumerate(self.hidden)]

    @staticmethod
    def load(table: DataFrame) -> ClickNetwork:
        """Read back from a table of ``weight_rows``: as many rows as the model has units."""
        rows = {(r["layer"], r["unit"]): (tuple(r["weights"]), r["bias"]) for r in table.collect()}
        hidden = tuple(rows["hidden", u] for u in range(sum(layer == "hidden" for layer, _ in rows)))
        return ClickNetwork(rows["mean", 0][0], rows["scale", 0][0], hidden, *rows["out", 0])

    def probability(self, features: Sequence[Column]) -> Column:
        """p(click) as an expression over the feature columns; the units are an array, so the expression stays small."""
        scaled = F.array(*[(x - F.lit(m)) * F.lit(s) for x, m, s in zip(features, self.mean, self.scale, strict=True)])
        units = F.array(
            *[F.struct(F.array(*[F.lit(x) for x in w]).alias("w"), F.lit(b).alias("b"), F.lit(o).alias("o")) for (w, b), o in zip(self.hidden, self.out, strict=True)]
        )

        def sigmoid(x: Column) -> Column:
            return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))

        def forward(x: Column) -> Column:
            return sigmoid(F.aggregate(units, F.lit(self.out_bias), lambda total, u: total + u["o"] * sigmoid(u["b"] + dot(u["w"], x))))

        return F.transform(F.array(scaled), forward)[0]

    def batch_probability(self, features: Sequence[Column]) -> Column:
        """The same in Arrow batches, as one matrix product: for many rows."""
        return F.pandas_udf(_forward(self), "double", F.PandasUDFType.SCALAR)(*features)


def _forward(net: ClickNetwork):
    def run(*columns):
        import numpy as np
        import pandas as pd

        w, b = np.array([x for x, _ in hidden]), np.array([x for _, x in hidden])
        p = np.empty(len(columns[0]))
        for at in range(0, len(p), rows):  # the hidden layer is 32 numbers a row, so only some rows at once
            x = (np.column_stack([c[at : at + rows] for c in columns]) - np.array(mean)) * np.array(scale)
            inner = 1.0 / (1.0 + np.exp(-(x @ w.T + b)))
            p[at : at + rows] = 1.0 / (1.0 + np.exp(-(inner @ np.array(out) + out_bias)))
        return pd.Series(p)

    # Plain values, so that the function ships without the package.
    mean, scale, hidden, out, out_bias, rows = net.mean, net.scale, net.hidden, net.out, net.out_bias, FORWARD_ROWS
    return run


def scored_lists(packed: DataFrame, network: ClickNetwork, features: Sequence[str] = FEATURES, digits: int = 9) -> DataFrame:
    """Packed requests with p(click) of every candidate as ``cands.p_click``: one matrix product per batch."""
    names, forward = list(features), _forward(network)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("cands"))
            flat = lists.flatten()
            p = np.round(forward(*[flat.field(n).cast("double").to_numpy(zero_copy_only=False) for n in names]).to_numpy(), digits)
            ends = np.append(0, np.cumsum(np.diff(lists.offsets.to_numpy()))).astype(np.int32)
            scores = pa.ListArray.from_arrays(pa.array(ends), pa.array(p))
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, "p_click"])

    schema = T.StructType([*packed.schema.fields, T.StructField("p_click", T.ArrayType(T.DoubleType()))])
    scored = packed.mapInArrow(run, schema)
    both = F.zip_with("cands", "p_click", lambda c, p: c.withField("p_click", p))
    return scored.withColumn("cands", both).drop("p_click")


def text_scores(network: ClickNetwork, features: Sequence[str] = FEATURES, digits: int = 9):
    """p(click) of a text's candidates for each of its requests, for tasks: a row per request.

    Candidates come as the one row of ``candidate_lists``, requests with their ``taste`` and category. What the network is
    given depends on the candidate and on two values per category, so it is asked once per distinct pair of them.
    """
    names, forward = list(features), _forward(network)

    def score(requests, texts):
        import numpy as np
        import pyarrow.compute as pc

        listed = texts.column("list").combine_chunks()[0].values
        fixed = {n: listed.field(n).cast("double").to_numpy(zero_copy_only=False) for n in ("similarity_score", "historical_global_ctr", "product_popularity")}
        coded = listed.field("candidate_category").dictionary_encode()
        code, kinds = coded.indices.to_numpy(), coded.dictionary
        taste = requests.column("taste").combine_chunks()
        ends = taste.offsets.to_numpy()
        who = np.repeat(np.arange(len(taste)), np.diff(ends))
        inside = slice(ends[0], ends[-1])
        of = pc.fill_null(pc.index_in(taste.keys, kinds), -1).to_numpy()[inside]
        liked = np.zeros((len(taste), len(kinds)))
        liked[who[of >= 0], of[of >= 0]] = taste.items.to_numpy(zero_copy_only=False)[inside][of >= 0]
        own = pc.fill_null(pc.index_in(requests.column("category").combine_chunks(), kinds), -1).to_numpy()
        out = np.empty((len(taste), len(code)))
        for c in range(len(kinds)):
            at = np.flatnonzero(code == c)
            pairs, which = np.unique(liked[:, c] + 1j * (own == c), return_inverse=True)
            made = {n: np.tile(x[at], len(pairs)) for n, x in fixed.items()}
            made["user_category_affinity"] = np.repeat(pairs.real, len(at))
            made["category_match_binary"] = np.repeat(pairs.imag, len(at))
            p = np.round(forward(*[made[n] for n in names]).to_numpy(), digits)
            out[:, at] = p.reshape(len(pairs), len(at))[which]
        return out

    score.columns = ["category", "taste"]
    return score


def ordered_lists(frame: DataFrame, score_col: str, k: int | None = None) -> DataFrame:
    """H6: (query_idx, rank, candidate_product_id) by score; ties keep retrieval order."""
    order = [F.desc(score_col), F.asc("retrieval_rank"), F.asc("candidate_product_id")]
    ranked = top_per_group(frame, ["query_idx"], order, k or 2**31 - 1)
    return ranked.select("query_idx", F.col("rank").cast("int").alias("rank"), "candidate_product_id")


def reordered(packed: DataFrame, score: Callable[[Column], Column]) -> DataFrame:
    """H6 over packed requests: each list is ordered in its own row, nothing is shuffled."""

    def order(c: Column) -> Column:
        return F.struct((-score(c)).alias("s"), c["retrieval_rank"].alias("r"), c["candidate_product_id"].alias("i"))

    lists = packed.select("query_idx", F.array_sort(F.transform("cands", order)).alias("o"))
    rows = lists.select("query_idx", F.posexplode("o.i").alias("at", "candidate_product_id"))
    return rows.select("query_idx", (F.col("at") + 1).cast("int").alias("rank"), "candidate_product_id")


def compare_rankings(frame: DataFrame, baseline_col: str, rerank_col: str, k: int = 10) -> DataFrame:
    """H7: NDCG and MRR of two score columns over the queries that have candidates, with lift.

    The target is one product per query, so both metrics only need its rank: the number of
    candidates that sort before it. That is one aggregate per query, and no list is sorted.
    """
    keys = ["retrieval_rank", "candidate_product_id"]
    target = frame.where(F.col("label") == 1).groupBy("query_idx").agg(
        *[F.min(F.struct(-F.col(c), *keys)).alias(f"t_{c}") for c in (baseline_col, rerank_col)]
    )
    joined = frame.join(target, "query_idx", "left")
    ranks = []
    for c in (baseline_col, rerank_col):
        ahead = F.struct(-F.col(c), *keys) < F.col(f"t_{c}")
        first = F.when(F.count(f"t_{c}") > 0, F.sum(ahead.cast("int")) + 1)
        ranks.append(first.alias(f"r_{c}"))
    return _lift_report(joined.groupBy("query_idx").agg(*ranks), baseline_col, rerank_col, k)


def compare_lists(packed: DataFrame, baseline: Callable[[Column], Column], reranked: Callable[[Column], Column], k: int = 10) -> DataFrame:
    """H7 over packed requests: the scores are functions of a candidate. Nothing is shuffled but the final sums."""

    def place(score: Callable[[Column], Column]) -> Column:
        def order(c: Column) -> Column:
            return F.struct((-score(c)).alias("s"), c["retrieval_rank"].alias("r"), c["candidate_product_id"].alias("i"))

        keys = F.struct(F.transform("cands", order).alias("all"), F.array_min(F.transform(F.filter("cands", lambda c: c["label"] == 1), order)).alias("t"))
        ahead = F.transform(F.array(keys), lambda x: F.size(F.filter(x["all"], lambda o: o < x["t"])) + 1)[0]
        return F.when(F.exists("cands", lambda c: c["label"] == 1), ahead)

    per = packed.where(F.size("cands") > 0).select(place(baseline).alias("r_a"), place(reranked).alias("r_b"))
    return _lift_report(per, "a", "b", k)


def _lift_report(per: DataFrame, baseline_col: str, rerank_col: str, k: int) -> DataFrame:
    """NDCG, MRR and their lift from r_baseline and r_reranked, the target's rank per query (null: not in the list)."""

    def mean(value):
        return F.coalesce(F.avg(F.coalesce(value, F.lit(0.0))), F.lit(0.0))

    out = []
    for name, c in (("baseline", baseline_col), ("reranked", rerank_col)):
        r = F.col(f"r_{c}")
        out.append(mean(F.when(r <= k, discount(r))).alias(f"{name}_ndcg"))
        out.append(mean(F.when(r <= k, F.lit(1.0) / r)).alias(f"{name}_mrr"))
    row = per.agg(F.count(F.lit(1)).alias("n_queries"), *out)
    for m in ("ndcg", "mrr"):
        b, p = F.col(f"baseline_{m}"), F.col(f"reranked_{m}")
        row = row.withColumn(f"{m}_lift_percent", (p - b) / F.greatest(b, F.lit(1e-12)) * 100)
    return row


def permutation_importance(
    frame: DataFrame, score: Callable[[Sequence[Column]], Column], repeats: int = 5, seed: int = 42, features: Sequence[str] = FEATURES
) -> DataFrame:
    """H8: drop in ROC-AUC when one feature is shuffled; mean and deviation over the repeats, in one job.

    ``frame`` needs a unique (query_idx, retrieval_rank); ``score`` makes a score of the feature columns. Rows are
    numbered once and dealt out by number, in blocks. A repeat's shuffle is a keyed permutation of the numbers, so a row
    knows which row takes its features and is sent to that one's block, packed with all others that go there. The scores
    of all variants become packed columns per range of scores, and only ranges are put in order.
    """
    names = list(features)
    keep = [F.col(f).cast("double").alias(f) for f in names]
    rows = frame.select("query_idx", "retrieval_rank", *keep, F.col("label").cast("long").alias("label"))
    levels = [F.floor(F.col("query_idx") / 65536), F.floor(F.col("query_idx") / 256)]
    base = bucketed_rank(rows, "row_no", [], levels, [F.col("query_idx"), F.col("retrieval_rank")])
    base = materialize(base.select((F.col("row_no") - 1).alias("row_no"), *names, "label"), "importance-rows")
    n = base.count()
    plain, cuts = score([F.col(f) for f in names]), [[]] * (len(names) + 1)

    def variants(other: Callable[[int], Column]) -> list[Column]:
        return [score([other(q) if q == p else F.col(f) for q, f in enumerate(names)]).alias(f"_s{p}") for p in range(len(names))]

    if n > RANGE_SCORES:
        cuts = _score_cuts(base, n, plain, variants)
    scored = _packed_scores(base.select(F.lit(-1).alias("repeat"), "label", plain.alias("_s0")), [-1], cuts[-1:])
    if n and repeats:
        dealt = base.mapInArrow(_dealt_rows(names, [number_before(n, f"{seed}/{i}") for i in range(repeats)]), "block long, repeat int, at binary, x binary, lost binary, label binary")
        doubles = ", ".join(f"`{c}` double" for c in [*names, *[f"_z{q}" for q in range(len(names))]])
        swapped = dealt.groupBy("block").applyInArrow(_swapped_rows(names, repeats), f"repeat int, label long, {doubles}")
        swapped = swapped.select("repeat", "label", *variants(lambda q: F.col(f"_z{q}")))
        scored = scored.unionByName(_packed_scores(swapped, list(range(len(names))), cuts[:-1]))
    area = materialize(_packed_auc(scored), "importance-areas")
    full = area.where("place < 0").select("auc").scalar()
    drops = area.where("place >= 0").withColumn("drop", full - F.col("auc"))
    out = drops.groupBy("place").agg(F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std"))
    return out.select(
        F.array(*[F.lit(f) for f in names])[F.col("place")].alias("feature"), "importance_mean", "importance_std"
    ).orderBy(F.desc("importance_mean"), "feature")


def _score_cuts(base: DataFrame, n: int, plain: Column, variants: Callable[[Callable[[int], Column]], list[Column]]) -> list[list[float]]:
    """Scores that cut each variant, and last the plain score, into ranges of about RANGE_SCORES rows.

    They come from a bounded draw of rows, of which each takes a feature of another one. Areas do not depend on them.
    """
    ranges = -(-n // RANGE_SCORES)
    drawn = base.where(F.pmod(F.xxhash64("row_no"), F.lit(max(1, n // max(CUT_ROWS, 16 * ranges)))) == 0)
    names = [c for c in base.columns if c not in ("row_no", "label")]
    order = F.xxhash64("row_no", F.lit(1))
    paired = drawn.select(*names, F.lead(F.array(*names)).over(W.orderBy(order, "row_no")).alias("_z")).where("_z IS NOT NULL")
    scored = paired.select(plain.alias("_plain"), *variants(lambda q: F.col("_z")[q]))
    at = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    columns = [*[c for c in scored.columns if c != "_plain"], "_plain"]
    row = scored.agg(*[F.percentile(F.when(~F.isnan(c), F.col(c)), at).alias(c) for c in columns]).first()
    return [sorted(set(row[c] or [])) for c in columns]


def _dealt_rows(names: Sequence[str], before: Sequence[Callable]):
    """Numbered rows, packed by the block of their own number (repeat -1) and of the number of the row that takes their features."""
    names, block_rows, most = list(names), IMPORTANCE_BLOCK, ROWS_AT_ONCE

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def dealt(held: list) -> Iterator:
            table = pa.Table.from_batches(held)
            columns = [table.column(f) for f in names]
            x, lost = np.stack([c.to_numpy() for c in columns]), np.stack([c.is_null().to_numpy() for c in columns])
            own = table.column("row_no").to_numpy()
            label = table.column("label").fill_null(-1).to_numpy().astype(np.int8)
            for repeat, turn in enumerate([lambda no: no, *before], -1):
                to = turn(own)
                order = np.argsort(to, kind="stable")
                block, at = to[order] // block_rows, (to[order] % block_rows).astype(np.int32)
                ends = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
                parts = [(order[a:b], at[a:b]) for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block[ends[:-1]]), pa.array(np.full(len(parts), repeat, np.int32)), pa.array([t.tobytes() for _, t in parts], pa.binary()),
                        pa.array([x[:, i].tobytes() for i, _ in parts], pa.binary()), pa.array([lost[:, i].tobytes() for i, _ in parts], pa.binary()),
                        pa.array([label[i].tobytes() if repeat < 0 else b"" for i, _ in parts], pa.binary()),
                    ],
                    names=["block", "repeat", "at", "x", "lost", "label"],
                )

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= most:
                yield from dealt(held)
                held, rows = [], 0
        if rows:
            yield from dealt(held)

    return run


def _swapped_rows(names: Sequence[str], repeats: int):
    """The rows of one block, once per repeat, with their own features and those of the other row (_z0, ...)."""
    names = list(names)

    def run(parts):
        import numpy as np
        import pyarrow as pa

        parts = parts.to_pylist()
        n = sum(len(p["at"]) // 4 for p in parts if p["repeat"] < 0)
        values = {r: (np.empty((len(names), n)), np.zeros((len(names), n), bool)) for r in range(-1, repeats)}
        label = np.empty(n, np.int8)
        for p in parts:
            at = np.frombuffer(p["at"], np.int32)
            x, lost = values[p["repeat"]]
            x[:, at] = np.frombuffer(p["x"]).reshape(len(names), -1)
            lost[:, at] = np.frombuffer(p["lost"], bool).reshape(len(names), -1)
            if p["repeat"] < 0:
                label[at] = np.frombuffer(p["label"], np.int8)

        def columns(r: int) -> list:
            x, lost = values[r]
            return [pa.array(a, mask=b) for a, b in zip(x, lost, strict=True)]

        own = [pa.array(label.astype(np.int64), mask=label < 0), *columns(-1)]
        titles = ["repeat", "label", *names, *[f"_z{q}" for q in range(len(names))]]
        return pa.concat_tables([pa.table([pa.array(np.full(n, r, np.int32)), *own, *columns(r)], names=titles) for r in range(repeats)])

    return run


def _packed_scores(rows: DataFrame, places: Sequence[int], cuts: Sequence[Sequence[float]]) -> DataFrame:
    """(place, repeat, range, label, value, n): the distinct scores of a range with their counts (none: all 1), packed.

    ``rows`` (repeat, label, _s0, ...) with a score column per place; rows without label or score take no part.
    """
    places, cuts, most = list(places), [list(c) for c in cuts], ROWS_AT_ONCE

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def packed(held: list) -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            repeat, label = table.column("repeat").to_numpy(), table.column("label").fill_null(-1).to_numpy()
            out = []
            for c, (place, cut) in enumerate(zip(places, cuts, strict=True)):
                score = table.column(f"_s{c}")
                s, known = score.to_numpy(), ~score.is_null().to_numpy()
                for r in np.unique(repeat):
                    for y in (0, 1):
                        value, n = np.unique(s[known & (repeat == r) & (label == y)], return_counts=True)
                        ends = np.r_[0, np.searchsorted(value, cut), len(value)]
                        for i in np.flatnonzero(np.diff(ends)):
                            v, m = value[ends[i] : ends[i + 1]], n[ends[i] : ends[i + 1]]
                            out.append((place, int(r), int(i), y, v.tobytes(), m.tobytes() if (m > 1).any() else b""))
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            columns = zip(*out, strict=True) if out else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["place", "repeat", "range", "label", "value", "n"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= most:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    return rows.mapInArrow(run, "place int, repeat int, range int, label int, value binary, n binary")


def _packed_auc(scored: DataFrame) -> DataFrame:
    """(place, repeat, auc) of packed scores: a range is ordered by itself, what lies below it comes from sums."""
    by = ["place", "repeat"]

    def inside(parts):
        import numpy as np
        import pyarrow as pa

        def side(label: int) -> tuple:
            mine = [(np.frombuffer(p["value"]), np.frombuffer(p["n"], np.int64)) for p in parts if p["label"] == label]
            value = np.concatenate([v for v, _ in mine] or [np.zeros(0)])
            return value, np.concatenate([n if len(n) else np.ones(len(v), np.int64) for v, n in mine] or [np.zeros(0, np.int64)])

        head = parts.slice(0, 1).select(["place", "repeat", "range"])
        parts = parts.to_pylist()
        (low, n_low), (high, n_high) = side(0), side(1)
        order = np.argsort(low)
        low, total = low[order], np.r_[0, np.cumsum(n_low[order])]
        twice = int((n_high * (total[np.searchsorted(low, high)] + total[np.searchsorted(low, high, "right")])).sum())
        sums = {"won": pa.array([twice / 2.0]), "pos": pa.array([int(n_high.sum())]), "neg": pa.array([int(n_low.sum())])}
        return pa.table({**{c: head.column(c) for c in head.column_names}, **sums})

    ranges = scored.groupBy(*by, "range").applyInArrow(inside, "place int, repeat int, range int, won double, pos long, neg long")
    before = W.partitionBy(*by).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    placed = ranges.withColumn("below", F.coalesce(F.sum("neg").over(before), F.lit(0)))
    won = F.col("won") + F.col("pos").cast("double") * F.col("below")
    total = placed.groupBy(*by).agg(F.sum(won).alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    pairs = F.col("pos").cast("double") * F.col("neg")
    return total.select(*by, F.when(pairs > 0, F.col("won") / pairs).alias("auc"))


def correlation_importance(frame: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """H9: |corr(feature, label)| in one aggregate; constant features and undefined values give 0."""
    label = F.col("label").cast("double")
    row = frame.agg(
        *[F.stddev_pop(f).alias(f"sd_{f}") for f in features], *[F.corr(F.col(f), label).alias(f"c_{f}") for f in features]
    )

    def value(f):
        c = F.abs(F.nanvl(F.col(f"c_{f}"), F.lit(0.0)))
        return F.when(F.col(f"sd_{f}") < 1e-12, 0.0).otherwise(F.coalesce(c, F.lit(0.0)))

    pairs = [F.struct(F.lit(f).alias("feature"), value(f).alias("importance_mean")) for f in features]
    long = row.select(F.explode(F.array(*pairs)).alias("x")).select("x.feature", "x.importance_mean")
    return long.withColumn("importance_std", F.lit(0.0)).orderBy(F.desc("importance_mean"), "feature")


def grouped_auc(scored: DataFrame, by: Sequence[str], score: str = "score", label: str = "label", buckets: int = 4096) -> DataFrame:
    """(by..., auc): exact area under the ROC curve per group, ties counted half; null without both labels.

    Equal scores become one row with their counts. Scores are cut into ranges; what lies below a range comes from
    sums per range, and windows only run inside one, so no group is ordered as a whole.
    """
    by = list(by)
    cells = scored.groupBy(*by, F.col(score).alias("s")).agg(F.sum(label).alias("pos"), F.count(F.lit(1)).alias("n"))
    # Read by three branches, so the scores are made once.
    cells = materialize(cells.withColumn("neg", F.col("n") - F.col("pos")), "score-cells")
    ends = cells.groupBy(*by).agg(F.min("s").alias("low"), F.max("s").alias("high"))
    width = (F.col("high") - F.col("low")) / F.lit(float(buckets))
    ranged = cells.join(ends, by).withColumn("range", F.when(width > 0, F.floor((F.col("s") - F.col("low")) / width)).otherwise(F.lit(0).cast("long")))
    ranged = ranged.select(*by, "range", "s", "pos", "neg")
    sums = ranged.groupBy(*by, "range").agg(F.sum("neg").alias("neg"))
    before = W.partitionBy(*by).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    below = sums.select(*by, "range", F.coalesce(F.sum("neg").over(before), F.lit(0)).alias("below"))
    inside = W.partitionBy(*by, "range").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    placed = ranged.withColumn("lower", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(below, [*by, "range"])
    won = F.col("pos") * (F.col("below") + F.col("lower") + F.col("neg") / F.lit(2.0))
    total = placed.groupBy(*by).agg(F.sum(won).alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    pairs = F.col("pos").cast("double") * F.col("neg")
    return total.select(*by, F.when(pairs > 0, F.col("won") / pairs).alias("auc"))

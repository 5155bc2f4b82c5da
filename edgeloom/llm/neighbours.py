"""Approximate nearest neighbours: stable projections of few dimensions, a kd-tree, and a chi-square stopping test.

Largest inner products are looked for as smallest distances: a vector x gets one more component sqrt(M^2 - |x|^2), M the
largest norm, and a query the component 0. The lengthened vectors are projected by Gaussian (2-stable) directions: a squared
projected distance, divided by the squared true distance, is chi-square distributed with as many degrees of freedom as there
are directions. Points are verified one after another in the order of their projected distance, and a query stops at the projected
distance r at which a point as near as its k-th best one, d, would have been met with probability ``confidence``:
chi2_cdf(r^2 / d^2) >= confidence. The share of near points found is about ``confidence`` or more, whatever the data; how many
points that takes depends on how much nearer than the rest the neighbours are. Each result row says how many were verified.

The test bounds the chance to miss a nearer point, and says nothing of points exactly as near as the k-th, among which the ids
decide: a query that meets such a tie goes on to the end.

On Spark: equal vectors are one class, which holds its k + 1 smallest ids. A kd-tree over a bounded sample of projected
classes cuts the space into cells of about ``cell_rows`` classes; each cell has its own kd-tree, made in the task that searches it.
A query is first searched in its own cell, which bounds d; the test on the cells' boxes then names the other cells that it
still has to visit. Queries of a cell come in blocks, so no task holds more than a cell and a block of queries.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a null id; vectors of different
lengths are an error. Rows of equal id and vector count once. A candidate is any row of another id. Columns other than vec_id and
embedding are not looked at. An empty table gives no rows.
"""

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.common import bounded_batches, spread_join, stage


@dataclass(frozen=True)
class AnnParams:
    """sample_rows: projected classes, chosen by a hash, that the cells are cut from at most."""

    k: int = 20
    query_every: int = 20
    directions: int = 16
    confidence: float = 0.9
    cell_rows: int = 32_768
    leaf_rows: int = 64
    query_rows: int = 1_024
    sample_rows: int = 50_000
    seed: int = 11


def chi2_cdf(x: np.ndarray, degrees: int) -> np.ndarray:
    """For an even number of degrees of freedom."""
    h = np.minimum(np.asarray(x, float) / 2, 700.0)
    term, total = np.ones_like(h), np.ones_like(h)
    for j in range(1, degrees // 2):
        term = term * h / j
        total = total + term
    return 1 - np.exp(-h) * total


def chi2_quantile(p: float, degrees: int) -> float:
    lo, hi = 0.0, 1e3
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(np.array(mid), degrees) < p else (lo, mid)
    return hi


def split(points: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers of the leaves of a kd-tree: halves at the median of the widest dimension, down to ``most`` rows."""
    todo, leaves = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            leaves.append(rows)
            continue
        own = points[rows]
        axis = int(np.argmax(own.max(0) - own.min(0)))
        half = len(rows) // 2
        order = np.argpartition(own[:, axis], half)
        todo += [rows[order[half:]], rows[order[:half]]]
    return leaves


def boxes(points: np.ndarray, leaves: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([points[r].min(0) for r in leaves]), np.array([points[r].max(0) for r in leaves])


def box_distances(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of each query from each box."""
    out = np.zeros((len(queries), len(low)))
    for j in range(queries.shape[1]):
        gap = np.maximum(low[None, :, j] - queries[:, j, None], queries[:, j, None] - high[None, :, j])
        out += np.maximum(gap, 0) ** 2
    return out


@dataclass
class Space:
    """The projection and the cells: directions by dimension, the largest norm, and the kd-tree's cuts in heap order."""

    directions: np.ndarray
    norm: float
    axes: np.ndarray
    cuts: np.ndarray
    stop: float

    def project(self, x: np.ndarray, query: bool) -> np.ndarray:
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))
        return x @ self.directions[:-1] + last[:, None] * self.directions[-1]

    def cell(self, projected: np.ndarray) -> np.ndarray:
        node = np.zeros(len(projected), np.int64)
        while len(self.axes) and node[0] < len(self.axes):
            node = 2 * node + 1 + (projected[np.arange(len(node)), self.axes[node]] >= self.cuts[node])
        return node - len(self.axes)


def cut_cells(sample: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Axes and medians of a full kd-tree with ``cells`` (a power of two) leaves, in heap order."""
    axes, cuts = np.zeros(cells - 1, np.int64), np.zeros(cells - 1)
    rows = {0: np.arange(len(sample))}
    for node in range(cells - 1):
        own = rows.pop(node)
        if len(own):
            axes[node] = int(np.argmax(sample[own].max(0) - sample[own].min(0)))
            cuts[node] = np.median(sample[own, axes[node]])
        left = sample[own, axes[node]] < cuts[node]
        rows[2 * node + 1], rows[2 * node + 2] = own[left], own[~left]
    return axes, cuts


ROUNDING = 2.0**-51  # of a product of norms and the dimensions: more than two orders of summing can make of the same products
FIRST = 128  # points verified before a query's first test


@dataclass
class Tree:
    """A cell's points in the order of the leaves of its kd-tree, with the leaves' begins and boxes in the projection."""

    points: np.ndarray
    ids: np.ndarray
    projected: np.ndarray
    begins: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def build(cls, space: Space, leaf_rows: int, points: np.ndarray, ids: np.ndarray) -> "Tree":
        z = space.project(points, False)
        leaves = split(z, leaf_rows)
        order = np.concatenate(leaves)
        return cls(points[order], ids[order], z[order], np.cumsum([0, *map(len, leaves)]), *boxes(z, leaves))

    def near(self, z: np.ndarray, far: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """Points nearer to z than limit in the projection and their squared distances, nearest first; far: of the boxes."""
        leaves = np.flatnonzero(far < limit)
        if not len(leaves):
            return leaves, far[leaves]
        rows = slice(None) if len(leaves) == len(far) else np.concatenate([np.arange(self.begins[j], self.begins[j + 1]) for j in leaves])
        r = ((self.projected[rows] - z) ** 2).sum(1)
        inside = np.flatnonzero(r < limit)
        inside = inside[np.argsort(r[inside], kind="stable")]
        return (inside if isinstance(rows, slice) else rows[inside]), r[inside]


def search(space: Space, k: int, leaf_rows: int, queries: np.ndarray, bound: np.ndarray, tied: np.ndarray, points: np.ndarray, ids: np.ndarray):
    """For each query the ids found, best first: k, and all others that rounding alone may set apart from the k-th; their products, the
    points verified, and whether the k-th place is tied. bound: the k-th product known so far; tied: whether it is so already."""
    tree = Tree.build(space, leaf_rows, points, ids)
    projected = space.project(queries, True)
    own_norms = (queries * queries).sum(1)
    base = space.norm**2 + own_norms
    slack = ROUNDING * queries.shape[1] * space.norm * np.sqrt(own_norms)
    for i, q in enumerate(queries):
        tie, kth = bool(tied[i]), float(bound[i])
        limit = lambda: math.inf if tie or kth == -math.inf else space.stop * max(base[i] - 2 * kth, 0.0)  # noqa: B023, E731
        rows, r = tree.near(projected[i], box_distances(projected[i : i + 1], tree.low, tree.high)[0], limit())
        best, found, done, step = np.zeros(0), np.zeros(0, np.int64), 0, FIRST
        while done < len(rows):
            own = rows[done : done + step]
            done, step = done + len(own), step * 2
            scores = np.concatenate([best, (tree.points[own] * q).sum(1)])
            names = np.concatenate([found, tree.ids[own]])
            top = np.lexsort((names, -scores))
            full = len(top) > k
            if full:
                top = top[scores[top] >= scores[top[k - 1]] - slack[i]]
            best, found = scores[top], names[top]
            if full:
                kth, tie = max(float(bound[i]), float(best[k - 1])), tie or (len(best) > k and best[k] >= bound[i] - slack[i])
                rows = rows[: max(done, int(np.searchsorted(r, limit())))]
        yield found, best, done, tie


def _classes(vectors: DataFrame, p: AnnParams) -> DataFrame:
    """(cls, x, members, asked): each distinct vector with its k + 1 smallest ids; asked: whether a query has it."""
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    rows = rows.where("vec_id is not null and x is not null and size(x) > 0 and not exists(x, v -> v is null or isnan(v) or abs(v) = double('infinity')) and exists(x, v -> v <> 0)")
    rows = rows.groupBy("x", "vec_id").agg(F.lit(1).alias("one"))
    own = Window.partitionBy("x").orderBy("vec_id")
    kept = rows.withColumn("place", F.row_number().over(own)).where(F.col("place") <= p.k + 1)
    asked = rows.groupBy("x").agg(F.max((F.col("vec_id") % p.query_every == 0).cast("int")).alias("asked"))
    return kept.groupBy("x").agg(F.sort_array(F.collect_list("vec_id")).alias("members")).join(asked, "x").select(F.element_at("members", 1).alias("cls"), "x", "members", (F.col("asked") == 1).alias("asked"))


def nearest(vectors: DataFrame, p: AnnParams = AnnParams()) -> DataFrame:
    """query_id, rank, vec_id, score for the rows (vec_id, embedding) whose id is divisible by query_every."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    classes = stage(_classes(vectors, p), "vector-classes")
    facts = classes.agg(F.count("*").alias("n"), F.max(F.expr("aggregate(x, double(0), (s, v) -> s + v * v)")).alias("norm"), F.min(F.size("x")).alias("d"), F.max(F.size("x")).alias("d2")).first()
    if facts["d"] != facts["d2"]:
        raise ValueError("the vectors differ in length")
    n, d = facts["n"], facts["d"] or 1
    rng = np.random.default_rng(p.seed)
    space = Space(rng.normal(size=(d + 1, p.directions)), math.sqrt(facts["norm"] or 0.0), np.zeros(0, np.int64), np.zeros(0), chi2_quantile(p.confidence, p.directions))
    cells = 1 << max(0, math.ceil(math.log2(max(1, n / p.cell_rows))))
    share = min(1.0, p.sample_rows / max(n, 1))
    if cells > 1:
        rows = classes.where(F.pmod(F.xxhash64("cls"), F.lit(1 << 30)) < int(share * (1 << 30))).select("x").collect()
        space.axes, space.cuts = cut_cells(space.project(np.array([r["x"] for r in rows]), False), min(cells, 1 << max(0, int(math.log2(max(1, len(rows) / 8))))))
    shared = spark.sparkContext.broadcast(space)
    m = p.directions

    def placed(batches):
        for b in batches:
            if len(b):
                x = np.array(b["x"].tolist())
                z = shared.value.project(x, False)
                q = shared.value.cell(shared.value.project(x, True))
                yield pd.DataFrame({"cls": b["cls"], "x": b["x"], "asked": b["asked"], "cell": shared.value.cell(z), "home": q, **{f"z{j}": z[:, j] for j in range(m)}})

    points = stage(classes.select("cls", "x", "asked").mapInPandas(placed, "cls long, x array<double>, asked boolean, cell long, home long, " + ", ".join(f"z{j} double" for j in range(m))), "vector-cells")
    ends = points.groupBy("cell").agg(*[f(f"z{j}").alias(f"{name}{j}") for name, f in (("low", F.min), ("high", F.max)) for j in range(m)]).collect()
    ends.sort(key=lambda r: r["cell"])
    table = spark.sparkContext.broadcast((np.array([r["cell"] for r in ends], np.int64), *(np.array([[r[f"{s}{j}"] for j in range(m)] for r in ends]).reshape(-1, m) for s in ("low", "high"))))
    k, leaf_rows = p.k + 1, p.leaf_rows
    result = "query long, found array<long>, best array<double>, verified long, tied boolean"

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).reshape(len(column), -1)

    def searched(asked: pa.Table, own: pa.Table) -> pa.Table:
        rows = []
        if len(asked) and len(own):
            rows = list(search(shared.value, k, leaf_rows, matrix(asked["x"]), asked["bound"].to_numpy(), asked["tied"].to_numpy(), matrix(own["px"]), own["point"].to_numpy()))
        columns = [asked["query"].to_pylist()[: len(rows)], *zip(*rows)] if rows else [[]] * 5
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.int64(), pa.bool_()]
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, types)], names=["query", "found", "best", "verified", "tied"])

    def visit(asked: DataFrame) -> DataFrame:
        """asked: query, x, bound, tied, cell. Each cell's points go to each block of its queries."""
        asked = asked.join(asked.groupBy("cell").agg(F.count("*").alias("asked_here")), "cell")
        asked = asked.withColumn("block", F.pmod(F.xxhash64("query"), F.greatest(F.lit(1), F.ceil(F.col("asked_here") / p.query_rows)))).drop("asked_here")
        blocks = asked.select(F.col("cell").alias("of"), F.col("block").alias("part")).distinct()
        own = points.select(F.col("cell").alias("of"), F.col("cls").alias("point"), F.col("x").alias("px")).join(blocks, "of")
        return asked.groupBy("cell", "block").cogroup(own.groupBy("of", "part")).applyInArrow(searched, result)

    queries = points.where("asked").select(F.col("cls").alias("query"), "x", "home")
    known = queries.select("query", "x", F.lit(float("-inf")).alias("bound"), F.lit(False).alias("tied"), F.col("home").alias("cell"))
    first = stage(visit(known), "near-home")

    def others(batches):
        names, low, high = table.value
        s = shared.value
        for b in batches:
            if len(b):
                x, tied = np.array(b["x"].tolist()), b["tied"].to_numpy().astype(bool)
                far = box_distances(s.project(x, True), low, high)
                left = s.stop * np.maximum(s.norm**2 + (x * x).sum(1) - 2 * b["bound"].to_numpy(), 0)
                q, c = np.nonzero(((far < left[:, None]) | tied[:, None]) & (names[None, :] != b["home"].to_numpy()[:, None]))
                yield pd.DataFrame({"query": b["query"].to_numpy()[q], "x": b["x"].to_numpy()[q], "bound": b["bound"].to_numpy()[q], "tied": tied[q], "cell": names[c]})

    kth = F.when(F.size("best") >= k, F.element_at("best", k)).otherwise(float("-inf"))
    bounded = queries.join(first.select("query", kth.alias("bound"), "tied"), "query", "left").withColumns({"bound": F.coalesce("bound", F.lit(float("-inf"))), "tied": F.coalesce("tied", F.lit(False))})
    further = stage(visit(bounded.mapInPandas(others, "query long, x array<double>, bound double, tied boolean, cell long")), "near-others")
    either = first.unionByName(further)
    verified = either.groupBy("query").agg(F.sum("verified").alias("verified"))
    pairs = either.select("query", F.explode(F.arrays_zip("found", "best")).alias("f")).select("query", F.col("f.found").alias("cls"), F.col("f.best").alias("s"))
    own = Window.partitionBy("query").orderBy(F.desc("s"), "cls")
    kept = F.nth_value("s", k).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    near = F.col("kth").isNull() | (F.col("s") >= F.col("kth") - ROUNDING * d * space.norm**2)
    pairs = pairs.withColumn("kth", kept).where(near).select("query", "cls")
    # exact products on the original vectors, then the members of the classes
    a, b = classes.select(F.col("cls").alias("query"), F.col("x").alias("qx")), classes.select("cls", "x", "members")
    dot = F.expr("aggregate(zip_with(qx, x, (u, v) -> u * v), double(0), (s, v) -> s + v)")
    scored = spread_join(pairs, b, ["cls"]).join(a, "query").select("query", dot.alias("score"), F.explode("members").alias("vec_id"))
    top = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    scored = scored.withColumn("place", F.row_number().over(top)).where(F.col("place") <= k).join(verified, "query")
    # a query's results are those of its class without itself; a class may hold any share of the queries
    ids = vectors.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("x")).where(F.col("query_id") % p.query_every == 0).distinct()
    ids = spread_join(ids, classes.where("asked").select("x", F.col("cls").alias("query")), ["x"]).select("query_id", "query")
    out = spread_join(stage(ids, "near-queries"), scored, ["query"]).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score", "verified")

"""Lists, key resolution and detail assembly."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def list_nodes(nodes: DataFrame, contains: str | None = None, where: Column | None = None, page: int = 1, size: int = 50, by: str = "views") -> DataFrame:
    """A page of the nodes that pass the optional filters, by ``views`` (descending, nulls last) or ``title``; with total and pages."""
    out = nodes if where is None else nodes.where(where)
    if contains:
        out = out.where(F.lower("title").contains(contains.lower()))
    count = out.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size))
    keys = [F.desc_nulls_last("views"), "title", "id"] if by == "views" else ["title", "id"]
    return out.orderBy(*keys).offset((page - 1) * size).limit(size).join(F.broadcast(count), F.lit(True))


def first_by(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row a key, the first in order (DISTINCT ON)."""
    rn = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def resolve_targets(edges: DataFrame, nodes: DataFrame, redirects: DataFrame) -> DataFrame:
    """to_id of edges by label: exact title, else redirect, else external key; null if none fits. ``matched_by`` says which.

    A title or key of several nodes goes to the smallest id, so no edge is repeated.
    """
    titles = nodes.where(F.col("title").isNotNull()).groupBy(F.col("title").alias("to_label")).agg(F.min("id").alias("_title"))
    moved = redirects.join(nodes.select(F.col("title").alias("target"), "id"), "target").groupBy(F.col("name").alias("to_label")).agg(F.min("id").alias("_redirect"))
    keys = nodes.where(F.col("key").isNotNull()).groupBy(F.col("key").alias("to_key")).agg(F.min("id").alias("_key"))
    out = edges.join(titles, "to_label", "left").join(moved, "to_label", "left").join(keys, "to_key", "left")
    by = F.when(F.col("_title").isNotNull(), "title").when(F.col("_redirect").isNotNull(), "redirect").when(F.col("_key").isNotNull(), "key")
    return out.withColumns({"to_id": F.coalesce("_title", "_redirect", "_key"), "matched_by": by}).drop("_title", "_redirect", "_key")


def lookup(names: DataFrame, nodes: DataFrame, redirects: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, id, matched_by) for many names at once: title, then redirect, then alias (any case), then external key."""
    ranked = [
        names.join(nodes, names["name"] == nodes["title"]).select("name", "id", F.lit(1).alias("rank"), F.lit("title").alias("matched_by")),
        names.join(redirects, "name").join(nodes, F.col("target") == F.col("title")).select("name", "id", F.lit(2), F.lit("redirect")),
        names.join(aliases.select(F.lower("alias").alias("_low"), "id"), F.lower("name") == F.col("_low")).select("name", "id", F.lit(3), F.lit("alias")),
        names.join(nodes, names["name"] == nodes["key"]).select("name", "id", F.lit(4), F.lit("key")),
    ]
    all_ = ranked[0]
    for r in ranked[1:]:
        all_ = all_.union(r)
    return first_by(all_, ["name"], ["rank", "id"]).drop("rank")


def resolve_roots(titles: DataFrame, nodes: DataFrame, redirects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of an ordered list (ordinal, title): the resolved roots (ordinal, title, id), and the titles that nothing fits."""
    own = nodes.groupBy("title").agg(F.min("id").alias("_own"))
    moved = redirects.join(nodes.select(F.col("title").alias("target"), "id"), "target").groupBy(F.col("name").alias("title")).agg(F.min("id").alias("_moved"))
    all_ = titles.join(own, "title", "left").join(moved, "title", "left").select("ordinal", "title", F.coalesce("_own", "_moved").alias("id"))
    return all_.where("id is not null"), all_.where("id is null").select("ordinal", "title")


def details(nodes: DataFrame, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Nodes with one sorted array for each child table: name -> (rows with id, expression of the value). No fan-out."""
    out = nodes
    for name, (rows, value) in children.items():
        own = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.expr(value))).alias(name))
        out = out.join(own, "id", "left")
    return out


def viewport(boxes: DataFrame, left: float, top: float, right: float, bottom: float, margin: float, keep: str | int | None = None) -> DataFrame:
    """Boxes (x, y centre, w, h) that meet the viewport with its margin, and the box ``keep`` wherever it is."""
    x, y, w, h = (F.col(c) for c in ("x", "y", "w", "h"))
    meets = (x + w / 2 >= left - margin) & (x - w / 2 <= right + margin) & (y + h / 2 >= top - margin) & (y - h / 2 <= bottom + margin)
    return boxes.where(meets | (F.col("id") == keep if keep is not None else F.lit(False)))


def tiles(boxes: DataFrame, size: float) -> DataFrame:
    """(id, tile_x, tile_y) for each tile that a box overlaps."""
    span = lambda c, d: F.sequence(F.floor((F.col(c) - F.col(d) / 2) / size), F.floor((F.col(c) + F.col(d) / 2) / size))
    return boxes.withColumn("tile_x", F.explode(span("x", "w"))).withColumn("tile_y", F.explode(span("y", "h")))


def overlaps(boxes: DataFrame, cell: float) -> DataFrame:
    """(a, b) with a < b of all pairs of boxes that overlap: equi join on grid cells, the exact test, one row a pair."""
    t = tiles(boxes, cell)
    a = t.select("tile_x", "tile_y", *[F.col(c).alias(f"{c}_a") for c in ("id", "x", "y", "w", "h")])
    b = t.select("tile_x", "tile_y", *[F.col(c).alias(f"{c}_b") for c in ("id", "x", "y", "w", "h")])
    j = a.join(b, ["tile_x", "tile_y"]).where("id_a < id_b and abs(x_a - x_b) < (w_a + w_b) / 2 and abs(y_a - y_b) < (h_a + h_b) / 2")
    return j.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()

"""Edge projections: active rows, effective relations, and the detail, traversal and neighbour views of raw and reviewed edges."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.skew import spread_join
from edgeloom.operators.staging import cut

# The relation vocabulary.
DISPLAY = ("subgenre", "derivative", "fusion_genre", "regional_scene")
INVERTED = ("broader_genres", "fusion_components", "source_genres")
SYMMETRIC = ("sibling_or_adjacent_genres",)
NOT_TRAVERSED = ("sibling_or_adjacent_genres", "influenced_by", "influences")
ORIGIN_EVIDENCE = "stylistic_origin_of"
EDGE = ("from_id", "to_id", "to_label", "relation", "source", "ordinal", "evidence_relation", "is_ignored", "confidence")


def active_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are neither deleted (deleted_at) nor flagged (is_excluded)."""
    alive = nodes.where(F.col("deleted_at").isNull() & ~F.coalesce("is_excluded", F.lit(False))).select("id")
    out = edges.join(alive.withColumnRenamed("id", "from_id"), "from_id", "left_semi")
    return out.join(alive.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(*edges.columns)


def effective_relation(display=DISPLAY):
    """A ``related`` edge counts as what its evidence says, if that is displayed; evidence of origin makes an origin parent."""
    related = F.col("relation") == "related"
    return F.when(related & F.col("evidence_relation").isin(*display), F.col("evidence_relation")).when(related & (F.col("evidence_relation") == ORIGIN_EVIDENCE), "origin_parent").otherwise(F.col("relation"))


def display_edges(edges: DataFrame, display=DISPLAY) -> DataFrame:
    """Edges with their effective relation, where that is displayed or an origin parent."""
    out = edges.withColumn("effective", effective_relation(display))
    return out.where(F.col("effective").isin(*display, "origin_parent"))


def _raw_unless_reviewed(raw: DataFrame, reviewed: DataFrame) -> DataFrame:
    """The raw edges if no reviewed edge is active, else none: a one-row flag, no correlated test."""
    flag = reviewed.where("status = 'active'").limit(1).agg((F.count("*") > 0).alias("_has"))
    out = raw.withColumn("confidence", F.lit(None).cast("string"))
    return out.join(F.broadcast(flag), F.lit(True)).where(~F.col("_has")).select(*EDGE)


def _reviewed(reviewed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Active reviewed edges that aren't ignored, with the titles of both ends."""
    own = reviewed.where("status = 'active' and not is_ignored")
    own = own.join(nodes.select(F.col("id").alias("from_id"), F.col("title").alias("from_title")), "from_id", "left")
    own = own.join(nodes.select(F.col("id").alias("to_id"), F.col("title").alias("to_title")), "to_id", "left")
    return own.withColumns({"to_label": F.coalesce(F.nullif(F.col("to_label"), F.lit("")), F.col("to_title")), "evidence_relation": F.col("relation"), "is_ignored": F.lit(False)})


def detail_edges(raw: DataFrame, reviewed: DataFrame, nodes: DataFrame) -> DataFrame:
    return _reviewed(reviewed, nodes).select(*EDGE).unionByName(_raw_unless_reviewed(raw, reviewed))


def traversal_edges(raw: DataFrame, reviewed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Parent to child: relations that point to the parent are turned round, relations without direction left out."""
    own = _reviewed(reviewed, nodes).where(F.col("to_id").isNotNull() & F.col("from_title").isNotNull() & ~F.col("relation").isin(*NOT_TRAVERSED))
    turn = F.col("relation").isin(*INVERTED)
    swapped = {"from_id": F.when(turn, F.col("to_id")).otherwise(F.col("from_id")), "to_id": F.when(turn, F.col("from_id")).otherwise(F.col("to_id")), "to_label": F.when(turn, F.col("from_title")).otherwise(F.col("to_label"))}
    return own.withColumns(swapped).select(*EDGE).unionByName(_raw_unless_reviewed(raw, reviewed))


def neighbor_edges(raw: DataFrame, reviewed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Reviewed edges with a target, symmetric ones in both directions."""
    own = _reviewed(reviewed, nodes).where(F.col("to_id").isNotNull())
    back = own.where(F.col("relation").isin(*SYMMETRIC) & F.col("from_title").isNotNull())
    back = back.select(*[{"from_id": F.col("to_id"), "to_id": F.col("from_id"), "to_label": F.col("from_title")}.get(c, F.col(c)).alias(c) for c in EDGE])
    return own.select(*EDGE).unionByName(back).unionByName(_raw_unless_reviewed(raw, reviewed))


def edges_of(edges: DataFrame, ids: DataFrame, direction: str = "both", relation: str | None = None) -> DataFrame:
    """Edges out of, into, or at the nodes of ids (id); relation also matches the evidence. Column ``direction`` says which."""
    if relation is not None:
        edges = edges.where((F.col("relation") == relation) | (F.col("evidence_relation") == relation))
    out = edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").withColumn("direction", F.lit("out"))
    into = edges.join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi").withColumn("direction", F.lit("in"))
    return {"out": lambda: out, "in": lambda: into.select(*out.columns), "both": lambda: out.unionByName(into)}[direction]()


def client_tracks(tracks: DataFrame, blocked: DataFrame) -> DataFrame:
    """Tracks whose id, URL or video is not blocked, renumbered from 0 per node: one anti join a key, no OR join."""
    out = tracks
    for key in ("track_id", "url", "video"):
        out = out.join(blocked.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")
    from pyspark.sql import Window

    return out.withColumn("position", F.row_number().over(Window.partitionBy("id").orderBy("ordinal", "track_id")) - 1).select("id", "track_id", "url", "video", "position")


ENTRIES = 100_000  # other children of all parents of a child that are held in one row
PASS = 500_000_000  # list entries that one pass shuffles


def shared_parents(edges: DataFrame) -> DataFrame:
    """(a, b, shared): children a < b of edges (from_id, to_id) that have more than one parent in common, and how many.

    The pairs of a parent's children are not shuffled one by one: each child gets its parents' lists of children after it, and what
    stands in several of them is next to itself when they are sorted. A child of very many others has them in parts by a hash. Children
    are taken in passes, so the disk that is needed holds the lists of one pass and what was found.
    """
    e = cut(edges.select("from_id", "to_id").distinct(), "children")
    # who has one parent shares no two
    e = cut(e.join(e.groupBy("to_id").count().where("count > 1").select("to_id"), "to_id", "left_semi"), "children")
    sizes = cut(e.groupBy("from_id").agg(F.count("*").alias("n")), "children")
    most = spread_join(e, sizes, ["from_id"]).groupBy("to_id").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    passes = -(-(sizes.agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0] or 1) // PASS)
    part = F.pmod(F.xxhash64("to_id"), F.lit(-(-most // ENTRIES) or 1)).cast("int")
    lists = cut(e.groupBy("from_id", part.alias("part")).agg(F.sort_array(F.collect_list("to_id")).alias("children")), "children")

    def found(k: int) -> DataFrame:
        own = e.where(F.pmod(F.xxhash64("to_id", F.lit(2)), F.lit(passes)) == k).select("from_id", F.col("to_id").alias("a"))
        after = spread_join(own, lists, ["from_id"]).select("a", "part", F.filter("children", lambda b: b > F.col("a")).alias("children"))
        each = after.where(F.size("children") > 0).repartition("a", "part").groupBy("a", "part").agg(F.sort_array(F.flatten(F.collect_list("children"))).alias("c"))
        again = each.select("a", "part", F.explode(F.filter("c", lambda b, i: (i > 0) & (b == F.get("c", i - 1)))).alias("b"))
        return again.groupBy("a", "part", "b").agg((F.count("*") + 1).alias("shared")).select("a", "b", "shared")

    return found(0) if passes <= 1 else reduce(DataFrame.union, [cut(found(k), "shared") for k in range(passes)])

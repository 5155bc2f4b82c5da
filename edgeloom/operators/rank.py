"""Windows: ranks, top rows, levels of detail."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.operators.staging import cut


def keep_best(df: DataFrame, key: list[str], order: list, reason: str = "duplicate") -> tuple[DataFrame, DataFrame]:
    """The first row of each key in order, and the rest with a reason."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.where("_n = 1").drop("_n"), ranked.where("_n > 1").drop("_n").withColumn("reason", F.lit(reason))


def renumber(df: DataFrame, key: list[str], order: list, name: str = "position") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)


def importance(df: DataFrame, value: str, group: str, floor: float = 0.15, share: float = 0.6) -> DataFrame:
    """Importance from 0 to 1: the rank in the whole table and in the row's group, each scaled to 0..1, mixed, not under floor.

    The rank in the whole table needs no single sorted task (see global_rank).
    """
    own = Window.partitionBy(group)
    inside = F.row_number().over(own.orderBy(F.desc_nulls_last(value), "id"))
    out = df.withColumn("_in", inside).withColumn("_size", F.count("*").over(own))
    ranks = global_rank(df, [F.desc_nulls_last(value), F.asc("id")]).select("id", F.col("rank").alias("_rank"), F.col("total").alias("_total"))
    out = out.join(ranks, "id")
    scaled = lambda r, n: F.when(F.col(n) <= 1, 1.0).otherwise(1 - (F.col(r) - 1) / (F.col(n) - 1))
    return out.withColumn("importance", F.greatest(F.lit(floor), share * scaled("_rank", "_total") + (1 - share) * scaled("_in", "_size"))).drop("_in", "_size", "_rank", "_total")


def global_rank(df: DataFrame, order: list) -> DataFrame:
    """df with rank, the row number over the whole table in order, and total.

    Rows are range-partitioned by the order and written with the number of their partition, so that a task that runs again doesn't
    number them anew; then they are numbered within each partition, and offset by the sizes of the partitions before it (one row
    a partition).
    """
    parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).withColumn("total", F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    n = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_n", n).join(F.broadcast(before), "_part").withColumn("rank", F.col("_n") + F.coalesce("_before", F.lit(0))).drop("_part", "_n", "_size", "_before")


def top_neighbours(pairs: DataFrame, n: int = 14) -> DataFrame:
    """(a, b, weight) of undirected pairs that are among the n best of either end, once a pair."""
    both = pairs.select("a", "b", "weight").union(pairs.select(F.col("b"), F.col("a"), "weight"))
    top = both.withColumn("_n", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("weight"), "b"))).where(F.col("_n") <= n)
    return top.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight").distinct()


# Weights, boosts and penalties of the level-of-detail score, and the scales up to which a tier goes.
TIERS = ((0.5, 0), (0.8, 1), (1.15, 2), (1.5, 3))
REGIONAL = r"(?i)\bmusic\s+(?:of|in)\b"


def levels(df: DataFrame, centre=None) -> DataFrame:
    """Level of detail of nodes (id, title, label, views, children, parents, depth, has_playlist): score, rank from 0, the scale from
    which a node is shown, the one below which it is hidden, and a tier from 0 to 5.

    Children, views (logarithmic) and parents count by their share of the largest; near the root, with a playlist, or as the
    centre (an id) a node gains, with a label of many words or of a region it loses. The scale grows with the rank; nodes near
    the root and the centre are shown early.
    """
    views = F.log1p(F.coalesce("views", F.lit(0)))
    most = df.agg(F.greatest(F.lit(1.0), F.max(views)).alias("_v"), F.greatest(F.lit(1), F.max("children")).alias("_c"), F.greatest(F.lit(1), F.max("parents")).alias("_p"))
    middle = F.lit(False) if centre is None else F.col("id") == F.lit(centre)
    near = F.when(F.col("depth") <= 1, 0.08).when(F.col("depth") <= 2, 0.035).otherwise(0.0)
    words = F.size(F.regexp_extract_all("label", F.lit(r"([\p{L}\p{N}]+)"), 1))
    score = F.col("children") / F.col("_c") * 0.52 + views / F.col("_v") * 0.31 + F.col("parents") / F.col("_p") * 0.12 + F.when(middle, 0.2).otherwise(0.0) + near
    score = score + F.when(F.col("has_playlist"), 0.025).otherwise(0.0) - F.greatest(F.lit(0), words - 3) * 0.045 - F.when(F.rlike("label", F.lit(REGIONAL)), 0.28).otherwise(0.0)
    d = df.join(F.broadcast(most), F.lit(True)).withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)).drop("_v", "_c", "_p")
    d = d.withColumns({"_views": F.coalesce("views", F.lit(0)), "_title": F.lower("title")})
    d = global_rank(d, [F.desc("score"), F.desc("children"), F.desc("_views"), F.desc("parents"), F.asc("_title"), F.asc("id")]).drop("_views", "_title")
    d = d.withColumn("rank", F.col("rank") - 1)
    scale = 0.35 + F.pow(F.col("rank") / F.greatest(F.lit(1), F.col("total") - 1), F.lit(0.72)) * 1.65
    held = F.when((F.col("depth") <= 1) | middle, F.least(F.lit(0.42), scale)).when(F.col("depth") <= 2, F.least(F.lit(1.15), scale)).when(F.col("has_playlist"), F.least(F.lit(1.55), scale)).otherwise(scale)
    d = d.withColumn("_scale", F.greatest(F.lit(0.28), F.least(F.lit(2.0), held)))
    tier = F.when(F.col("_scale") < 2.0, 4).otherwise(5)
    for top, k in reversed(TIERS):
        tier = F.when(F.col("_scale") <= top, k).otherwise(tier)
    shown = F.round("_scale", 4)
    return d.withColumns({"show_scale": shown, "hide_scale": F.round(F.greatest(F.lit(0.05), shown - 0.15), 4), "tier": tier}).drop("_scale", "total")


def best_rank_rows(df: DataFrame, key: list[str], rank) -> DataFrame:
    """All rows at the lowest rank of their key."""
    return df.withColumn("_rank", rank).withColumn("_best", F.min("_rank").over(Window.partitionBy(*key))).where("_rank = _best").drop("_rank", "_best")


def random_row(df: DataFrame, seed: int) -> DataFrame:
    """A row (id, ...) drawn by a hash of its id and the seed: each as likely as another, and the same one when a task runs again."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed))).cast("binary")), "id").limit(1)


def ordered_first(df: DataFrame, order: list, n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)

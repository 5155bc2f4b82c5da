"""Rollups, evidence merges and weighted statistics."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.operators.staging import cut


def rollup(df: DataFrame, key: list[str], counts: dict[str, Column], any_: dict[str, Column], distinct: dict[str, Column] = {}) -> DataFrame:
    """Per key: conditional counts, whether any row meets a condition, and exact distinct counts, in one pass."""
    return df.groupBy(*key).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in counts.items()], *[F.coalesce(F.bool_or(c), F.lit(False)).alias(k) for k, c in any_.items()], *[F.countDistinct(c).alias(k) for k, c in distinct.items()])


def child_arrays(parents: DataFrame, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Parents (id) with a sorted distinct array of each child table's column; none: an empty array. Children are aggregated first."""
    out = parents
    for name, (rows, column) in children.items():
        own = rows.where(F.col(column).isNotNull()).groupBy("id").agg(F.sort_array(F.collect_set(column)).alias(name))
        out = out.join(own, "id", "left").withColumn(name, F.coalesce(name, F.array().cast(dict(own.dtypes)[name])))
    return out


def duplicates(df: DataFrame, key: list[str], least: int = 2) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def map_totals(df: DataFrame, key: list[str], column: str) -> DataFrame:
    """(key, totals): maps summed by their keys and put together again, in the order of their keys."""
    each = df.select(*key, F.explode(column).alias("k", "v")).groupBy(*key, "k").agg(F.sum("v").alias("v"))
    return each.groupBy(*key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("totals"))


def weighted_stats(df: DataFrame, key: list[str], value: str, weight: str) -> DataFrame:
    """(key, mean, sd, total): weighted mean and population standard deviation around it (two passes, no cancellation)."""
    means = df.groupBy(*key).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"), F.sum(weight).alias("total"))
    off = df.join(means, key).groupBy(*key).agg(F.first("mean").alias("mean"), F.first("total").alias("total"), F.sum(F.col(weight) * F.pow(F.col(value) - F.col("mean"), F.lit(2))).alias("s"))
    return off.select(*key, "mean", F.sqrt(F.col("s") / F.col("total")).alias("sd"), "total")


def weighted_quantiles(df: DataFrame, key: list[str], value: str, weight: str, at: dict[str, float]) -> DataFrame:
    """Lower step quantiles: the least value at which the running weight reaches a share of the total.

    Selected in two passes, so that a group of all rows is no one task's sort: the values, their weights summed, are dealt by ranges of
    (key, value) and written; weights are summed by range, which tells where each range starts, and only then running sums are taken
    within ranges. Ranges of a key are as few as its values fill.
    """
    each = df.groupBy(*key, value).agg(F.sum(weight).alias("_w"))
    parts = cut(each.repartitionByRange(*key, value).withColumn("_part", F.spark_partition_id()), "quantiles")
    sums = parts.groupBy(*key, "_part").agg(F.sum("_w").alias("_s"))
    own = Window.partitionBy(*key)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_s").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_s").over(own))
    # a quantile lies in the first range of its key whose end reaches its share: other ranges are not summed up
    reached = [(F.col("_before") < q * F.col("_all")) & (F.col("_before") + F.col("_s") >= q * F.col("_all")) for q in at.values()]
    first = F.col("_before") == 0  # for shares that nothing has to reach
    hit = sums.where(reduce(lambda x, y: x | y, reached, first))
    same = F.expr(" and ".join(f"p.`{k}` <=> h.`{k}`" for k in [*key, "_part"]))
    run = parts.alias("p").join(hit.alias("h"), same).select(*[f"p.{k}" for k in key], f"p.{value}", "p._w", "p._part", "h._before", "h._all")
    run = run.withColumn("_run", F.col("_before") + F.sum("_w").over(Window.partitionBy(*key, "_part").orderBy(value)))
    # sums in another order may miss a share that only the last value reaches by the last bit
    last = F.max(F.when(F.col("_all").isNotNull(), F.col(value)))
    return run.groupBy(*key).agg(*[F.coalesce(F.min(F.when(F.col("_run") >= q * F.col("_all"), F.col(value))), last).alias(n) for n, q in at.items()])


def weighted_degree(pairs: DataFrame, weight: str = "n") -> DataFrame:
    """(id, degree) of undirected pairs (a, b, weight)."""
    return pairs.select(F.col("a").alias("id"), weight).union(pairs.select("b", weight)).groupBy("id").agg(F.sum(weight).alias("degree"))


def merge_edges(edges: DataFrame, least: float, most: float) -> DataFrame:
    """(a, b, weight, sources): weights of a pair (in either order) summed by source, the total held to bounds, a map of sources."""
    each = edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "source").agg(F.sum("weight").alias("w")).where("a <> b")
    total = F.greatest(F.lit(least), F.least(F.lit(most), F.sum("w")))
    return each.groupBy("a", "b").agg(total.alias("weight"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "w")))).alias("sources"))


def merge_evidence(evidence: DataFrame, key: list[str], bonus: float = 0.08, review_below: float = 0.7, most: int = 12) -> DataFrame:
    """Per key: the best score and confidence, a bonus for two sources or more, a review flag, and the top pieces of evidence.

    The list is bounded by a ranked window before it is collected.
    """
    top = Window.partitionBy(*key).orderBy(F.desc("score"), "source", "evidence")
    kept = evidence.withColumn("_n", F.row_number().over(top)).where(F.col("_n") <= most).groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "source", "evidence"))), lambda x: F.concat_ws(": ", x["source"], x["evidence"])).alias("evidence"))
    sums = evidence.groupBy(*key).agg(F.max("score").alias("score"), F.max("confidence").alias("confidence"), F.countDistinct("source").alias("n_sources"))
    held = lambda c: F.least(F.lit(1.0), F.col(c) + F.when(F.col("n_sources") >= 2, bonus).otherwise(0.0))
    sums = sums.withColumn("score", held("score")).withColumn("confidence", held("confidence"))
    return sums.withColumn("needs_review", F.col("confidence") < review_below).join(kept, key)


def metrics(parts: dict[str, Column], df: DataFrame) -> DataFrame:
    """(metric, value) of aggregates over one table."""
    row = df.agg(*[c.cast("long").alias(k) for k, c in parts.items()])
    return row.select(F.explode(F.create_map(*[x for k in parts for x in (F.lit(k), F.col(k))])).alias("metric", "value"))


def shortfalls(groups: DataFrame, members: DataFrame, target: int) -> DataFrame:
    """Groups (id) with fewer than target playable members (id, playable: true, false or unknown), worst first."""
    j = groups.join(members, "id", "left").groupBy("id").agg(F.count_if("playable").alias("playable"), F.count_if(F.col("member").isNotNull() & ~F.col("playable")).alias("blocked"), F.count_if(F.col("member").isNotNull() & F.col("playable").isNull()).alias("unknown"))
    return j.where(F.col("playable") < target).withColumn("missing", F.lit(target) - F.col("playable")).orderBy(F.desc("missing"), "id")

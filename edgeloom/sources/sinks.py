"""Sinks: bounded work batches, rebuilt tables, snapshot logs."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.sources.manifest import ManifestTable


def batches(states: DataFrame, edges: DataFrame, top_roots: int, per_root: int) -> tuple[DataFrame, DataFrame]:
    """Work batches: of the roots with most nodes, the first nodes by depth then id, and the edges between nodes of one batch."""
    roots = states.groupBy("root_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "root_id").limit(top_roots).select("root_id")
    n = F.row_number().over(Window.partitionBy("root_id").orderBy("depth", "id"))
    nodes = states.join(F.broadcast(roots), "root_id").withColumn("_n", n).where(F.col("_n") <= per_root).select(F.col("root_id").alias("batch_key"), "id", "depth")
    a, b = nodes.select("batch_key", F.col("id").alias("from_id")), nodes.select(F.col("batch_key").alias("_b"), F.col("id").alias("to_id"))
    inside = edges.join(a, "from_id").join(b, "to_id").where("batch_key = _b").select("batch_key", "from_id", "to_id", "relation")
    return nodes, inside


def batch_samples(nodes: DataFrame, texts: DataFrame, most: int, length: int = 200) -> DataFrame:
    """(batch_key, samples): of each batch the texts (id, text) of its first ``most`` nodes by depth then id, as sorted 'id: text' strings."""
    n = F.row_number().over(Window.partitionBy("batch_key").orderBy("depth", "id"))
    first = nodes.join(texts.select("id", "text"), "id").withColumn("_n", n).where(F.col("_n") <= most)
    return first.groupBy("batch_key").agg(F.sort_array(F.collect_list(F.concat(F.col("id"), F.lit(": "), F.substring("text", 1, length)))).alias("samples"))


def export_batches(nodes: DataFrame, path: str) -> None:
    nodes.repartition("batch_key").write.mode("overwrite").partitionBy("batch_key").json(path)


def rebuild(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Replace a derived table, or with ``partition`` only the partitions that df has; ``rebuilt`` reads it.

    The new files are written beside the old ones and put in force by the table's manifest, so a reader sees a whole table at any time,
    and a failure leaves the old one. A null partition value is a partition of its own.
    """
    table = ManifestTable(df.sparkSession, path)
    start = table.current()
    number = start["batch"] + 1 if start else 0
    keyed = df.withColumn("_part", F.coalesce(F.concat(F.lit("="), F.col(partition).cast("string")), F.lit("null")) if partition else F.lit("all"))
    parts = table.stage(keyed, "_part")
    table.commit((start["parts"] if start and partition else {}) | parts, number, start)


def rebuilt(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table that ``rebuild`` has put in force last."""
    return ManifestTable(spark, path).read(schema)


def snapshot(nodes: DataFrame, edges: DataFrame, run: str, note: str) -> DataFrame:
    """One summary row of a job run."""
    n = nodes.agg(F.count("*").alias("nodes"), F.count("views").alias("with_views"))
    e = edges.agg(F.count("*").alias("edges"), F.countDistinct("from_id").alias("parents"))
    return n.join(F.broadcast(e), F.lit(True)).select(F.lit(run).alias("run"), "nodes", "with_views", "edges", "parents", F.lit(note).alias("note"))


def append_log(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("append").parquet(path)

"""Shards of nearly equal size by longest-processing-time scheduling: groups of rows that must stay together go, the largest first,
to the shard with the least so far, which a heap gives.

Groups of one size are alike to the schedule, so it runs over (size, number of groups): of g different sizes the rows take at least
g²/2 bytes in all, so there are few, and they are read one after another. The groups of a size take the shards that the heap gives in
turn; for very many groups of one size the same turns are worked out at once. A group finds its place among those of
its size by a sort over the whole table, written by ranges and offset by the sizes of the ranges before.

Groups are equal texts; null and empty texts are one group. Every row is placed, repeated rows on their own slots. Null or repeated
ids do no harm. Texts are only read for their length and digests, however long. An empty table gives no rows.
"""

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.common import discard, scratch, spread_join, stage

OVERHEAD = 16  # bytes of a row beside its text
_RUN = 4096  # groups of one size that are put on the heap one by one


class Schedule:
    """Loads of shards, and the heap of (load, shard)."""

    def __init__(self, shards: int):
        self.heap = [(0, k) for k in range(shards)]

    def place(self, size: int, groups: int) -> list[tuple[int, int]]:
        """Runs (shard, how many) in which this many groups of a size are placed.

        Up to _RUN, group by group. Beyond, by how many times the heap would give each shard: those with the lowest load +
        j·size over all shards and j, ties to the smaller shard.
        """
        if groups > _RUN:
            counts = self._many(size, groups)
        else:
            counts = {}
            for _ in range(groups):
                load, k = self.heap[0]
                heapq.heapreplace(self.heap, (load + size, k))
                counts[k] = counts.get(k, 0) + 1
        return sorted(counts.items())

    def _many(self, size: int, groups: int) -> dict[int, int]:
        loads = {k: load for load, k in self.heap}
        low, high = min(loads.values()), max(loads.values()) + size * groups
        under = lambda level: sum(max(0, -(-(level - x) // size)) for x in loads.values())  # noqa: E731  turns at a load below level
        while low < high:  # the highest level with no more turns below than groups
            mid = (low + high + 1) // 2
            low, high = (mid, high) if under(mid) <= groups else (low, mid - 1)
        counts = {k: max(0, -(-(low - x) // size)) for k, x in loads.items()}
        left = groups - sum(counts.values())
        for k in sorted(k for k, x in loads.items() if x + counts[k] * size == low)[:left]:
            counts[k] += 1
        self.heap = [(x + counts[k] * size, k) for k, x in loads.items()]
        heapq.heapify(self.heap)
        return {k: n for k, n in counts.items() if n}


def _numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """df, staged by ranges of order, with its place from 0 in order over the whole table."""
    parts = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    parts = parts.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    offsets = parts.groupBy("_part").agg(F.count("*").alias("_size")).select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return parts.join(F.broadcast(offsets), "_part").withColumn("place", F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def measured(docs: DataFrame, carried: list[str], text: str = "text") -> DataFrame:
    """The carried columns of docs in ``_row``, with size, text_crc32, the group's key, and a number to tell rows apart."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    marks = {"size": (F.octet_length(whole) + OVERHEAD).cast("long"), "text_crc32": F.crc32(whole), "group": F.unhex(F.sha2(whole, 256)), "own": F.monotonically_increasing_id()}
    return docs.select(F.struct(*carried).alias("_row"), *(c.alias(name) for name, c in marks.items()))


_PLAN = "total long, first long, runs array<struct<upto:long,shard:int>>"


def _plan(classes: DataFrame, shards: int, at_once: int = 100_000) -> DataFrame:
    """For each size of groups: its first place in the order of sizes, and which shards take how many; classes: (total, size, first).

    The sizes come to the driver one range after another, and go to the shared folder at_once at a time.
    """
    spark, schedule, rows = classes.sparkSession, Schedule(shards), []
    path = scratch(spark, "shard-plan")

    def put():
        spark.createDataFrame(rows, _PLAN).write.mode("append").parquet(path)
        rows.clear()

    for total, n, first in classes.orderBy(F.desc("total")).toLocalIterator():
        upto, runs = 0, []
        for shard, many in schedule.place(total, n):
            upto += many
            runs.append((upto, shard))
        rows.append((total, first, runs))
        if len(rows) >= at_once:
            put()
    put()
    return spark.read.schema(_PLAN).parquet(path)


def shards_of_groups(rows: DataFrame, shards: int = 40) -> DataFrame:
    """(group, shard) for the groups of rows (group, size); a group's size is that of all its rows."""
    groups = rows.groupBy("group").agg(F.sum("size").alias("total"))
    placed = _numbered(groups, [F.desc("total"), F.asc("group")], "shard-groups")
    classes = stage(placed.groupBy("total").agg(F.count("*").alias("size"), F.min("place").alias("first")), "shard-sizes")
    runs = spread_join(placed, _plan(classes, shards), ["total"], sizes=classes.select("total", "size"))
    return runs.select("group", F.expr("filter(runs, r -> r.upto > place - first)[0].shard").alias("shard"))


def assign(docs: DataFrame, shards: int = 40, carried: list[str] | None = None, text: str = "text") -> DataFrame:
    """The carried columns of docs (doc_id, if not said otherwise) in ``_row``, with size, text_crc32, shard (from 0) and slot (from 0,
    gapless in each shard; rows of one group stand together)."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    rows = stage(measured(docs, carried or ["doc_id"], text), "shard-rows")
    of = stage(shards_of_groups(rows, shards), "shard-of-group")
    placed = _numbered(spread_join(rows, of, ["group"]), [F.asc("shard"), F.asc("group"), F.asc("own")], "shard-slots")
    first = placed.groupBy("shard").agg(F.min("place").alias("_first"))  # one row a shard
    out = placed.join(F.broadcast(first), "shard").select("_row", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("place") - F.col("_first")).alias("slot"))
    discard(rows, of)
    return out


def write_shards(docs: DataFrame, folder: str, shards: int = 40, text: str = "text", part_rows: int = 1_000_000) -> None:
    """Write the whole rows of docs as Parquet below folder, one subfolder ``shard=K`` each, files of at most part_rows rows in slot order."""
    placed = assign(docs, shards, docs.columns, text)
    files = placed.withColumn("_file", F.expr(f"slot div {part_rows}"))
    spread = files.repartition("shard", "_file").sortWithinPartitions("shard", "_file", "slot")
    spread.select("shard", "slot", "_row").write.partitionBy("shard").option("maxRecordsPerFile", part_rows).parquet(folder)


def report(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: sizes decide here, not keys) of every row of docs."""
    out = assign(docs, shards)
    return out.select("_row.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

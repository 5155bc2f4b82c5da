"""Structured Streaming jobs: upserts of page changes, change feed, windows, counters, staleness alerts.

Sinks that keep a table rewrite the hash buckets that a batch touches and commit them by a manifest, so a batch that runs again, killed
or not, gives the same table. The final state equals the batch operators' result.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from edgeloom.operators.ingest import upsert
from edgeloom.operators.staging import cut
from edgeloom.sources.manifest import ManifestTable


class StateTable:
    """A keyed table in hash buckets that split as they grow, of which a batch rewrites only those that its keys fall into.

    A bucket has all keys whose hash ends in its bits; one that gets more than ``most`` rows is split by further bits when it is written, so
    a task never writes much more, however large the table (only rows of one key stay together). The manifest names the live
    files of every bucket. A batch that runs again starts from the version before it, whether or not it was committed.
    """

    def __init__(self, spark: SparkSession, folder: str, empty: DataFrame, key: list[str], most: int = 1_000_000):
        self.spark, self.empty, self.key, self.most = spark, empty, key, most
        self.table = ManifestTable(spark, folder)

    def _buckets(self, version: dict | None) -> list[tuple[str, int, int]]:
        """(name, depth, bits) of all buckets; without any, one of all hashes."""
        names = list(version["parts"]) if version else []
        return [(n, *map(int, n.split("-"))) for n in names] or [("0-0", 0, 0)]

    def _placed(self, rows: DataFrame, buckets: list[tuple[str, int, int]]) -> DataFrame:
        """rows with _hash and _bucket. The buckets are broadcast: there are about as many as rows of the table by ``most``."""
        known = F.broadcast(self.spark.createDataFrame(buckets, "_bucket string, _depth int, _bits long"))
        depths = F.array(*[F.lit(d) for d in sorted({d for _, d, _ in buckets})])
        each = rows.withColumn("_hash", F.xxhash64(*self.key).bitwiseAND(F.lit((1 << 62) - 1))).withColumn("_depth", F.explode(depths))
        return each.withColumn("_bits", F.expr("_hash & (shiftleft(1L, _depth) - 1)")).join(known, ["_depth", "_bits"]).drop("_depth", "_bits")

    def touched(self, rows: DataFrame, batch: int) -> list[str]:
        return sorted(r[0] for r in self._placed(rows.select(*self.key), self._buckets(self.table.before(batch))).select("_bucket").distinct().collect())

    def read(self, before: int | None = None, buckets: list[str] | None = None) -> DataFrame:
        version = self.table.current() if before is None else self.table.before(before)
        return self.table.read(self.empty.schema, version, buckets) if version else self.empty

    def write(self, df: DataFrame, batch: int, touched: list[str]) -> None:
        """df: all rows of the buckets that the batch touches."""
        start = self.table.before(batch)
        buckets = [b for b in self._buckets(start) if b[0] in set(touched)]
        placed = cut(self._placed(df.select(*self.empty.columns), buckets), "state") if buckets else None
        counts = {r["_bucket"]: r["n"] for r in placed.groupBy("_bucket").agg(F.count("*").alias("n")).collect()} if buckets else {}
        leaves = []
        for name, depth, bits in buckets:
            more = 0
            while counts.get(name, 0) > self.most << more:
                more += 1
            leaves += [(f"{depth + more}-{bits | (k << depth)}", depth + more, bits | (k << depth)) for k in range(1 << more)]
        parts = {n: {"files": []} for n, *_ in leaves}
        if counts:
            rows = self._placed(placed.drop("_hash", "_bucket"), leaves)
            parts |= self.table.stage(rows.drop("_hash"), "_bucket")
        old = start["parts"] if start else {}
        self.table.commit({k: v for k, v in old.items() if k not in set(touched)} | parts, batch, start)


def upsert_stream(changes: DataFrame, table: StateTable, checkpoint: str):
    """ST1: changes (id, hash, fetched_at, seq) into a table by the batch upsert; within a batch the last change of an id wins.

    Earlier changes of the same batch still count: rows are applied through the hash that was stored before, as one fold of a key.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        last = batch.groupBy("id").agg(F.max_by(F.struct("hash", "fetched_at"), F.struct("fetched_at", "seq")).alias("v")).select("id", "v.hash", "v.fetched_at").persist()
        touched = table.touched(last, batch_id)
        table.write(upsert(table.read(batch_id, touched), last).select(*table.empty.columns), batch_id, touched)
        last.unpersist()

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def children_stream(changes: DataFrame, children: StateTable, revisions: StateTable, checkpoint: str):
    """ST1 with I4 and I6: changes (id, hash, fetched_at, seq, items) replace the children (id, item) of each changed id, and add a
    revision (id, batch, before, after) with the counts of children where they differ. The children's table has the key id, so a
    bucket holds whole families."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        last = batch.groupBy("id").agg(F.max_by("items", F.struct("fetched_at", "seq")).alias("items")).persist()
        touched, noted = children.touched(last, batch_id), revisions.touched(last, batch_id)
        stored = children.read(batch_id, touched)
        incoming = last.select("id", F.explode_outer(F.array_distinct("items")).alias("item"))
        kept = stored.join(last.select("id"), "id", "left_anti").select("id", "item")
        before = stored.where("item is not null").groupBy("id").agg(F.count("*").alias("before"))
        after = incoming.groupBy("id").agg(F.count("item").alias("after"))
        moved = after.join(before, "id", "left").select("id", F.lit(batch_id).cast("long").alias("batch"), F.coalesce("before", F.lit(0).cast("long")).alias("before"), "after").where("before <> after")
        revisions.write(revisions.read(batch_id, noted).unionByName(moved), batch_id, noted)
        children.write(kept.union(incoming), batch_id, touched)  # last: a batch that runs again still finds the children of before
        last.unpersist()

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def change_feed(changes: DataFrame, late: str = "2 days") -> DataFrame:
    """ST2: each (id, hash) once within the watermark."""
    return changes.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id", "hash"])


def popularity(views: DataFrame, size: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """ST3: views by tumbling or sliding window and type, late rows cut off."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return views.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def error_counters(errors: DataFrame) -> DataFrame:
    """ST4: count and last fields of errors by (user_id, props), for update or complete mode."""
    at = F.struct("ts", "event_id")
    return errors.groupBy("user_id", "props").agg(F.count("*").alias("n"), F.max("ts").alias("last_at"), F.max_by("value", at).alias("last_value"))


class StaleAlert(StatefulProcessor):
    """ST5: an alert (with the last time seen) whenever a key is silent for more than ttl_ms of event time: between rows, or by a timer
    when the watermark passes; a new row rearms it."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = sorted(int(x.timestamp() * 1000) for b in rows for x in b["ts"])
        if self.last.exists():
            old = self.last.get()[0]
            self.handle.deleteTimer(old + self.ttl_ms)
            seen = sorted([old, *seen])
        self.last.update((seen[-1],))
        self.handle.registerTimer(seen[-1] + self.ttl_ms)
        silent = [a for a, b in zip(seen, seen[1:]) if b - a > self.ttl_ms]
        yield pd.DataFrame({"user_id": pd.Series([int(key[0])] * len(silent), dtype="int64"), "last_ms": pd.Series(silent, dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame({"user_id": [int(key[0])], "last_ms": [last]})

    def close(self) -> None:
        pass


def stale_alerts(rows: DataFrame, ttl_ms: int, late: str = "1 hour") -> DataFrame:
    return rows.withWatermark("ts", late).groupBy("user_id").transformWithStateInPandas(StaleAlert(ttl_ms), "user_id long, last_ms long", "append", "eventTime")

"""Queries: streaming jobs (ST) over the events as files that arrive; each runs all that is there and gives the final state."""

from pyspark.sql import functions as F

from edgeloom.operators.staging import shared_path
from edgeloom.plans.bindings import sql_with
from edgeloom.plans.registry import query
from edgeloom.streaming import jobs as J


def _folder(t) -> str:
    return shared_path(t.spark, "stream")


def _arriving(t, df, folder: str, parts: int = 3, file_rows: int = 500_000):
    """df as a stream of ``parts`` batches in order of time; each is a folder of as many files, of about file_rows rows at most."""
    lo, hi = df.agg(F.min("event_id"), F.max("event_id")).first()
    step = max(1, (hi - lo + parts) // parts)
    most = df.groupBy(F.expr(f"(event_id - {lo}) div {step}").alias("k")).count().agg(F.max("count")).first()[0]
    files = -(-most // file_rows)
    for k in range(parts):
        df.where(F.col("event_id").between(lo + k * step, lo + (k + 1) * step - 1)).repartition(files).write.parquet(f"{folder}/in/{k}")
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(f"{folder}/in/*")


def _run(writer) -> None:
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()


def _to_files(df, folder: str, mode: str = "append"):
    """Run a stream into Parquet files and read them."""
    _run(df.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp"))
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")


CHANGES = "ch AS (SELECT id, content AS hash, ts AS fetched_at, event_id FROM versions)"


@query("st1_streaming_upsert", sql_with("versions") + f""", {CHANGES}, b AS (SELECT *, (event_id - (SELECT min(event_id) FROM ch)) // greatest(1, ((SELECT max(event_id) - min(event_id) FROM ch) + 3) // 3) AS k FROM ch),
l AS (SELECT id, k, hash, fetched_at FROM (SELECT *, row_number() OVER (PARTITION BY id, k ORDER BY fetched_at DESC, event_id DESC) AS rn FROM b) q WHERE rn = 1),
c AS (SELECT *, hash IS DISTINCT FROM lag(hash) OVER (PARTITION BY id ORDER BY k) AS changed FROM l)
SELECT id, max_by(hash, k) AS hash, max_by(fetched_at, k) AS last_fetched_at, max_by(fetched_at, CASE WHEN changed THEN k END) AS last_changed_at, CAST(NULL AS TIMESTAMP) AS deleted_at FROM c GROUP BY id""")  # fmt: skip
def st1(t):
    folder = _folder(t)
    rows = t.versions.select("id", F.col("content").alias("hash"), F.col("ts").alias("fetched_at"), F.col("event_id").alias("seq"), "event_id")
    table = J.StateTable(t.spark, f"{folder}/state", t.old_rows.select("id", "hash", "last_fetched_at", "last_changed_at", "deleted_at").limit(0), ["id"])
    _run(J.upsert_stream(_arriving(t, rows, folder), table, f"{folder}/cp"))
    return table.read()


@query("st1_children", sql_with("versions") + """, b AS (SELECT *, (event_id - (SELECT min(event_id) FROM versions)) // greatest(1, ((SELECT max(event_id) - min(event_id) FROM versions) + 3) // 3) AS k FROM versions),
l AS (SELECT id, k, list_distinct([event_type, substr(content, 1, 3), CASE WHEN event_id % 3 = 0 THEN content END]) AS items FROM (SELECT *, row_number() OVER (PARTITION BY id, k ORDER BY ts DESC, event_id DESC) AS rn FROM b) q WHERE rn = 1),
c AS (SELECT id, k, len(items) AS after, coalesce(lag(len(items)) OVER (PARTITION BY id ORDER BY k), 0) AS before, row_number() OVER (PARTITION BY id ORDER BY k DESC) AS last, items FROM l)
SELECT 'child' AS kind, id, item AS what, CAST(NULL AS BIGINT) AS before, CAST(NULL AS BIGINT) AS after FROM (SELECT id, unnest(items) AS item FROM c WHERE last = 1) q UNION ALL SELECT 'revision', id, CAST(k AS VARCHAR), before, after FROM c WHERE before <> after""")  # fmt: skip
def st1b(t):
    folder = _folder(t)
    items = F.filter(F.array("event_type", F.substring("content", 1, 3), F.when(F.col("event_id") % 3 == 0, F.col("content"))), lambda v: v.isNotNull())
    rows = t.versions.select("id", F.col("ts").alias("fetched_at"), F.col("event_id").alias("seq"), "event_id", items.alias("items"))
    empty = t.versions.limit(0)
    children = J.StateTable(t.spark, f"{folder}/children", empty.select("id", F.col("content").alias("item")), ["id"])
    revisions = J.StateTable(t.spark, f"{folder}/revisions", empty.select("id", F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("after")), ["id"])
    _run(J.children_stream(_arriving(t, rows, folder), children, revisions, f"{folder}/cp"))
    none = F.lit(None).cast("long")
    kept = children.read().where("item is not null").select(F.lit("child").alias("kind"), "id", F.col("item").alias("what"), none.alias("before"), none.alias("after"))
    return kept.union(revisions.read().select(F.lit("revision"), "id", F.col("batch").cast("string"), "before", "after"))


@query("st2_change_feed", sql_with("versions") + " SELECT id, content AS hash, count(DISTINCT content) AS n FROM versions GROUP BY ALL")
def st2(t):
    folder = _folder(t)
    rows = t.versions.select("id", F.col("content").alias("hash"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return _to_files(J.change_feed(_arriving(t, rows, folder), "60 days"), folder).groupBy("id", "hash").agg(F.count("*").alias("n"))


@query("st3_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
def st3(t):
    folder = _folder(t)
    out = _to_files(J.popularity(_arriving(t, t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"), folder), "1 day"), folder)
    out = out.withColumn("start", F.col("start").cast("timestamp_ntz"))
    end = t.events.agg(F.max("ts").alias("m"))
    return out.join(F.broadcast(end), F.lit(True)).where(F.expr("start + INTERVAL 1 DAY <= m - INTERVAL 1 DAY")).drop("m")


@query("st3_sliding", """WITH h AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS b, event_type, value FROM events), w AS (SELECT b - i * INTERVAL 6 HOUR AS start, event_type, value FROM h, range(0, 4) r(i))
SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL HAVING start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")  # fmt: skip
def st3b(t):
    folder = _folder(t)
    rows = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    out = _to_files(J.popularity(_arriving(t, rows, folder), "1 day", "6 hours"), folder).withColumn("start", F.col("start").cast("timestamp_ntz"))
    end = t.events.agg(F.max("ts").alias("m"))
    return out.join(F.broadcast(end), F.lit(True)).where(F.expr("start + INTERVAL 1 DAY <= m - INTERVAL 1 DAY")).drop("m")


@query("st4_error_counters", "SELECT user_id, props, count(*) AS n, max(ts) AS last_at, max_by(value, ts) AS last_value FROM events WHERE event_type = 'error' GROUP BY ALL")
def st4(t):
    folder = _folder(t)
    table = J.StateTable(t.spark, f"{folder}/state", J.error_counters(t.events).limit(0), ["user_id", "props"])
    stream = J.error_counters(_arriving(t, t.events.where("event_type = 'error'"), folder))

    def merge(batch, batch_id):
        touched = table.touched(batch, batch_id)
        kept = table.read(batch_id, touched).join(batch.select("user_id", "props"), ["user_id", "props"], "left_anti")
        table.write(kept.select(*batch.columns).union(batch), batch_id, touched)

    _run(stream.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", f"{folder}/cp"))
    return table.read()


@query("st5_stale_alerts", """WITH l AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nx FROM events) SELECT user_id, epoch_us(ts) // 1000 AS last_ms FROM l WHERE epoch_us(nx) // 1000 - epoch_us(ts) // 1000 > 43200000 OR (nx IS NULL AND epoch_us(ts) // 1000 + 43200000 <= (SELECT epoch_us(max(ts)) // 1000 - 3600000 FROM events))""")
def st5(t):
    folder = _folder(t)
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id")
    return _to_files(J.stale_alerts(_arriving(t, rows, folder), 12 * 3600 * 1000), folder)

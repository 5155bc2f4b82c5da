"""Queries: sources and sinks (S): written to the shared folder and read back."""

from pyspark.sql import functions as F

from edgeloom.plans.bindings import sql_with
from edgeloom.plans.graphs import TREE, shown, states
from edgeloom.plans.registry import query
from edgeloom.plans.streams import _folder
from edgeloom.sources import readers, sinks


@query("s1_relationship_csv", """WITH n AS (SELECT lower(p_name) AS k, min(concat('p:', p_partkey)) AS id FROM part GROUP BY 1), s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN concat('x:', o_orderkey) ELSE concat('p:', o_custkey) END AS src, o_orderkey % 3 AS m FROM orders),
e AS (SELECT src, 0 AS k, 0 AS i, o_orderkey, 'broader' AS relation, CASE m WHEN 0 THEN 'nothing' ELSE (SELECT any_value(p_name) FROM part WHERE p_partkey = o_orderkey % 50) END AS target FROM s UNION ALL SELECT src, 1, 0, o_orderkey, 'source', (SELECT any_value(upper(p_name)) FROM part WHERE p_partkey = o_orderkey % 40) FROM s)
SELECT src AS from_id, n.id AS to_id, relation, count(*) AS n FROM e JOIN n ON n.k = lower(target) WHERE src IN (SELECT concat('p:', p_partkey) FROM part) AND n.id <> src GROUP BY ALL""")  # fmt: skip
def s1(t):
    k = F.col("o_orderkey")
    names = t.part.select("p_partkey", "p_name")
    src = F.when(k % 9 == 0, F.concat(F.lit("x:"), k)).otherwise(F.concat(F.lit("p:"), "o_custkey"))
    j = t.orders.join(names.select(F.col("p_partkey").alias("a"), F.col("p_name").alias("na")), k % 50 == F.col("a")).join(names.select(F.col("p_partkey").alias("b"), F.upper("p_name").alias("nb")), k % 40 == F.col("b"))
    cell = lambda v: F.to_json(F.array(F.struct(v.alias("target"), F.lit("high").alias("confidence"))))
    rows = j.select(src.alias("source_id"), cell(F.when(k % 3 == 0, "nothing").otherwise(F.col("na"))).alias("broader"), cell(F.col("nb")).alias("source"))
    path = _folder(t)
    rows.write.csv(path, header=True, quote='"', escape='"')
    nodes = t.part.select(F.concat(F.lit("p:"), "p_partkey").alias("id"), F.col("p_name").alias("title"))
    edges, _ = readers.relationship_reviews(t.spark, path, ["broader", "source"], nodes)
    return edges.groupBy("from_id", "to_id", "relation").agg(F.count("*").alias("n"))


LINES = "SELECT event_id AS line, concat('u:', user_id) AS key, CASE WHEN event_type = 'signup' THEN 'bogus' ELSE event_type END AS decision, round(value / 50, 4) AS confidence, event_id % 17 = 0 AS broken FROM events"


@query("s2_decisions", f"""WITH l AS ({LINES}), g AS (SELECT *, CASE WHEN broken THEN 'invalid json' WHEN decision = 'bogus' THEN 'unknown decision' WHEN key IN (SELECT concat('u:', user_id) FROM events WHERE user_id % 7 = 0) THEN 'unknown key' END AS reason FROM l), w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY line DESC) AS rn FROM g WHERE reason IS NULL)
SELECT key, decision AS what, CAST(greatest(0, least(1, confidence)) AS DOUBLE) AS confidence, CASE WHEN confidence >= 0.8 THEN 'imported' ELSE 'needs_human' END AS status, CAST(1 AS BIGINT) AS n FROM w WHERE rn = 1 UNION ALL SELECT NULL, reason, NULL, 'rejected', count(*) FROM g WHERE reason IS NOT NULL GROUP BY reason""")  # fmt: skip
def s2(t):
    t.events.createOrReplaceTempView("bound_events")
    l = t.spark.sql(LINES.replace("FROM events", "FROM bound_events"))
    json = F.to_json(F.struct("key", "decision", "confidence", F.lit("n").alias("note")))
    path = _folder(t)
    # many files, in which the lines keep their order: the reader numbers lines by file and place
    l.repartitionByRange("line").sortWithinPartitions("line").select(F.when(F.col("broken"), F.concat(F.lit("{oops "), json)).otherwise(json).alias("value")).write.text(path)
    keys = t.events.where("user_id % 7 <> 0").select(F.concat(F.lit("u:"), "user_id").alias("key"))
    ok, bad = readers.decisions(t.spark, path, ["click", "view", "purchase", "error"], keys)
    bad = bad.groupBy("reason").agg(F.count("*").alias("n")).select(F.lit(None).cast("string").alias("key"), F.col("reason").alias("what"), F.lit(None).cast("double").alias("confidence"), F.lit("rejected").alias("status"), "n")
    return ok.select("key", F.col("decision").alias("what"), "confidence", "status", F.lit(1).cast("long").alias("n")).union(bad)


@query("s3_batches", TREE + """, rt AS (SELECT root_id FROM st GROUP BY root_id ORDER BY count(*) DESC, root_id LIMIT 3), n AS (SELECT root_id AS batch_key, id FROM (SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY depth, id) AS k FROM st WHERE root_id IN (SELECT root_id FROM rt)) q WHERE k <= 40)
SELECT a.batch_key, e.from_id, e.to_id, e.relation FROM shown e JOIN n a ON a.id = e.from_id JOIN n b ON b.id = e.to_id AND b.batch_key = a.batch_key""")  # fmt: skip
def s3(t):
    path = _folder(t)
    nodes, inside = sinks.batches(states(t), shown(t), 3, 40)
    sinks.export_batches(inside, path)
    return t.spark.read.schema("from_id string, to_id string, relation string, batch_key string").json(path).select("batch_key", "from_id", "to_id", "relation")


@query("s3_samples", TREE + """, rt AS (SELECT root_id FROM st GROUP BY root_id ORDER BY count(*) DESC, root_id LIMIT 3), n AS (SELECT root_id AS batch_key, id, k FROM (SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY depth, id) AS k FROM st WHERE root_id IN (SELECT root_id FROM rt)) q WHERE k <= 40)
SELECT batch_key, string_agg(concat(nodes.id, ': ', title), ' | ' ORDER BY concat(nodes.id, ': ', title)) AS samples FROM n JOIN nodes USING (id) WHERE k <= 5 GROUP BY batch_key""")  # fmt: skip
def s3b(t):
    nodes, _ = sinks.batches(states(t), shown(t), 3, 40)
    return sinks.batch_samples(nodes, t.nodes.select("id", F.col("title").alias("text")), 5).select("batch_key", F.array_join("samples", " | ").alias("samples"))


@query("s4_playlist", """WITH r AS (SELECT o_orderkey AS line, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE concat('n:', o_custkey % 40) END AS id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE concat('song ', o_orderkey) END AS song, CASE o_orderkey % 4 WHEN 0 THEN concat('https://youtu.be/', o_orderkey) WHEN 1 THEN concat('http://www.youtube.com/watch?v=', o_orderkey) WHEN 2 THEN concat('https://example.com/', o_orderkey) ELSE concat('https://m.youtube.com/watch?v=', o_orderkey) END AS url, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 50 AS INTEGER) END AS ordinal FROM orders),
v AS (SELECT *, greatest(coalesce((SELECT max(n_nationkey) FROM nation WHERE concat('n:', n_nationkey) = r.id), -1), coalesce(max(ordinal) OVER (PARTITION BY id), -1)) AS m, sum(CASE WHEN ordinal IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY line) AS run FROM r WHERE id <> '' AND song IS NOT NULL AND url NOT LIKE '%example%') SELECT id, song, url, CAST(coalesce(ordinal, m + run) AS INTEGER) AS ordinal FROM v""")  # fmt: skip
def s4(t):
    k = F.col("o_orderkey")
    url = F.when(k % 4 == 0, F.concat(F.lit("https://youtu.be/"), k)).when(k % 4 == 1, F.concat(F.lit("http://www.youtube.com/watch?v="), k)).when(k % 4 == 2, F.concat(F.lit("https://example.com/"), k)).otherwise(F.concat(F.lit("https://m.youtube.com/watch?v="), k))
    rows = t.orders.select(k.alias("line"), F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("n:"), F.col("o_custkey") % 40)).alias("id"), F.when(k % 11 != 0, F.concat(F.lit("song "), k)).alias("song"), F.lit("").alias("artist"), url.alias("url"), F.when(k % 3 == 0, (k % 50).cast("int")).alias("ordinal"))
    path = _folder(t)
    rows.write.csv(path, header=True)
    read = t.spark.read.csv(path, header=True, schema="line long, id string, song string, artist string, url string, ordinal int")
    stored = t.nation.select(F.concat(F.lit("n:"), "n_nationkey").alias("id"), F.col("n_nationkey").alias("ordinal"))
    return readers.playlist(read, stored)[0].select("id", "song", "url", "ordinal")


@query("s6_entity_json", "SELECT o_orderkey AS id, CAST(0 AS INTEGER) AS pos, o_orderstatus AS alias FROM orders")
def s6(t):
    from edgeloom.operators.extract import entity_aliases
    from edgeloom.plans.extracting import CLAIM

    path = _folder(t)
    t.orders.select(F.col("o_orderkey").alias("id"), F.expr(CLAIM).alias("json")).write.parquet(path)
    return entity_aliases(t.spark.read.parquet(path))


@query("s7_rebuild", "SELECT p_brand, p_partkey FROM part WHERE p_brand <> 'Brand#1' OR p_partkey % 2 = 0")
def s7(t):
    path = _folder(t)
    own = t.part.select("p_brand", "p_partkey")
    sinks.rebuild(own, path, "p_brand")
    sinks.rebuild(own.where("p_brand = 'Brand#1' and p_partkey % 2 = 0"), path, "p_brand")
    return sinks.rebuilt(t.spark, path, own.schema)


@query("s8_snapshot_log", sql_with("nodes", "edges") + """, s AS (SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(views) FROM nodes) AS with_views, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT from_id) FROM edges) AS parents) SELECT 'a' AS run, s.*, 'first' AS note FROM s UNION ALL SELECT 'b', s.*, 'second' FROM s""")
def s8(t):
    path = _folder(t)
    for run, note in (("a", "first"), ("b", "second")):
        sinks.append_log(sinks.snapshot(t.nodes, t.edges, run, note), path)
    return t.spark.read.schema("run string, nodes long, with_views long, edges long, parents long, note string").parquet(path)

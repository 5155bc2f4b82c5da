"""Queries: ingest, upsert and change capture (I)."""

from pyspark.sql import functions as F

from edgeloom.functions import text
from edgeloom.operators import ingest as I
from edgeloom.plans.bindings import sql_with
from edgeloom.plans.registry import query

DAY = "TIMESTAMP '2024-01-25 00:00:00'"
SEEN = "stored AS (SELECT id, min(ts) AS first_seen_at, max(CASE WHEN event_id % 3 = 0 THEN ts END) AS last_changed_at FROM versions GROUP BY id)"


def seen(t):
    return t.versions.groupBy("id").agg(F.min("ts").alias("first_seen_at"), F.max(F.when(F.col("event_id") % 3 == 0, F.col("ts"))).alias("last_changed_at"))


@query("i1_stable_keys", r"""SELECT p_partkey, coalesce(nullif(CASE WHEN p_partkey % 3 = 0 THEN concat('Q', p_partkey) ELSE '' END, ''), regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS id,
 substr(sha1(concat(p_name, chr(0), p_brand, chr(0), p_partkey)), 1, 24) AS key FROM part""")  # fmt: skip
def i1(t):
    ext = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Q"), F.col("p_partkey"))).otherwise("")
    return t.part.select("p_partkey", text.node_id(ext, "p_name").alias("id"), text.stable_key("p_name", "p_brand", "p_partkey").alias("key"))


@query("i2_upsert", sql_with("old_rows", "new_rows") + """
SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NULL THEN o.hash ELSE n.hash END AS hash, coalesce(n.fetched_at, o.last_fetched_at) AS last_fetched_at,
 CASE WHEN n.id IS NULL THEN o.last_changed_at WHEN o.id IS NULL OR o.hash IS DISTINCT FROM n.hash THEN n.fetched_at ELSE o.last_changed_at END AS last_changed_at, CASE WHEN n.id IS NULL THEN o.deleted_at END AS deleted_at
FROM old_rows o FULL JOIN new_rows n ON n.id = o.id""")  # fmt: skip
def i2(t):
    return I.upsert(t.old_rows, t.new_rows)


KIDS = "SELECT concat('u:', user_id) AS id, event_type AS name, CAST(value AS BIGINT) AS value, event_id FROM events"


def kids(t, where):
    return t.events.where(where).select(F.concat(F.lit("u:"), "user_id").alias("id"), F.col("event_type").alias("name"), F.round("value").cast("long").alias("value"), "event_id")


@query("i3_insert_absent", """WITH kids AS (SELECT concat('u:', user_id) AS id, event_type AS name, CAST(round(value) AS BIGINT) AS value, event_id FROM events), stored AS (SELECT * FROM kids WHERE event_id % 40 = 0)
SELECT * FROM stored UNION ALL SELECT id, name, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY id, name ORDER BY event_id) AS rn FROM kids WHERE event_id % 2 = 1) k
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.id = k.id AND s.name = k.name)""")  # fmt: skip
def i3(t):
    return I.insert_absent(kids(t, "event_id % 40 = 0"), kids(t, "event_id % 2 = 1"), ["id", "name"], ["event_id"])


@query("i4_replace_children", """WITH kids AS (SELECT concat('u:', user_id) AS id, event_type AS name, CAST(round(value) AS BIGINT) AS value, event_id FROM events), inc AS (SELECT * FROM kids WHERE event_id % 50 = 1)
SELECT * FROM kids k WHERE event_id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM inc WHERE inc.id = k.id AND inc.name = k.name) UNION ALL SELECT * FROM inc""")  # fmt: skip
def i4(t):
    return I.replace_children(kids(t, "event_id % 3 = 0"), kids(t, "event_id % 50 = 1"), ["id", "name"])


@query("i5_max_merge", """WITH kids AS (SELECT user_id AS id, event_type AS name, value, event_id % 5 = 0 AS inc, CASE WHEN event_id % 4 = 1 THEN event_id END AS note FROM events)
SELECT id, name, max(value) AS value, coalesce(min(CASE WHEN NOT inc THEN note END), min(CASE WHEN inc THEN note END)) AS note, coalesce(max(CASE WHEN inc THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END), 'old') AS mark FROM kids GROUP BY id, name""")  # fmt: skip
def i5(t):
    own = t.events.select(F.col("user_id").alias("id"), F.col("event_type").alias("name"), "value", (F.col("event_id") % 5 == 0).alias("inc"), F.when(F.col("event_id") % 4 == 1, F.col("event_id")).alias("note"))
    side = lambda inc: own.where(F.col("inc") == inc).groupBy("id", "name").agg(F.max("value").alias("value"), F.min("note").alias("note"), F.create_map(F.lit("mark"), F.coalesce(F.max(F.when(F.lit(inc), F.floor("value").cast("string"))), F.lit("old"))).alias("payload"))
    return I.max_merge(side(False), side(True), ["id", "name"], ["value"], ["note"], ["payload"]).select("id", "name", "value", "note", F.col("payload")["mark"].alias("mark"))


@query("i6_revisions", sql_with("old_rows", "new_rows") + """
, a AS (SELECT id, count(*) AS n FROM versions WHERE event_id % 2 = 0 GROUP BY id), b AS (SELECT id, count(*) AS n FROM versions WHERE event_id % 3 = 0 GROUP BY id)
SELECT o.id, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM old_rows o JOIN new_rows n ON n.id = o.id AND n.hash IS DISTINCT FROM o.hash LEFT JOIN a ON a.id = o.id LEFT JOIN b ON b.id = o.id""")  # fmt: skip
def i6(t):
    n = lambda k: t.versions.where(F.col("event_id") % k == 0).groupBy("id").agg(F.count("*").alias("n"))
    hashes = t.old_rows.select("id", F.col("hash").alias("old_hash")).join(t.new_rows.select("id", F.col("hash").alias("new_hash")), "id")
    return I.revisions(n(2), n(3), hashes)


@query("i7_series_latest", """WITH s AS (SELECT l_partkey AS id, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month, l_orderkey % 7 = 0 AS inc, CAST(sum(l_quantity) AS BIGINT) AS views FROM lineitem WHERE l_partkey % 10 = 0 GROUP BY ALL),
m AS (SELECT * FROM s WHERE inc UNION ALL SELECT * FROM s WHERE NOT inc AND NOT EXISTS (SELECT 1 FROM s i WHERE i.inc AND i.id = s.id AND i.year = s.year AND i.month = s.month))
SELECT id, max_by(views, year * 12 + month) AS views, count(*) AS months FROM m GROUP BY id""")  # fmt: skip
def i7(t):
    s = t.lineitem.where("l_partkey % 10 = 0").groupBy(F.col("l_partkey").alias("id"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), (F.col("l_orderkey") % 7 == 0).alias("inc")).agg(F.sum("l_quantity").cast("long").alias("views"))
    m = I.upsert_series(s.where("not inc").drop("inc"), s.where("inc").drop("inc"))
    return I.latest_value(m).join(m.groupBy("id").agg(F.count("*").alias("months")), "id")


@query("i8_soft_delete", sql_with("old_rows", "new_rows") + f"""
SELECT o.id, o.hash, o.last_fetched_at, o.last_changed_at, CASE WHEN o.deleted_at IS NOT NULL THEN o.deleted_at WHEN n.id IS NULL THEN {DAY} END AS deleted_at FROM old_rows o LEFT JOIN (SELECT DISTINCT id FROM new_rows WHERE length(id) < 4) n ON n.id = o.id""")  # fmt: skip
def i8(t):
    return I.soft_delete(t.old_rows, t.new_rows.where("length(id) < 4"), F.expr(DAY))


@query("i9_stale", sql_with("old_rows", "new_rows") + f"""
SELECT id, last_fetched_at FROM old_rows o WHERE deleted_at IS NULL AND last_fetched_at < {DAY.replace('25', '29')} AND NOT EXISTS (SELECT 1 FROM new_rows n WHERE n.id = o.id AND length(n.hash) % 3 = 0)""")  # fmt: skip
def i9(t):
    return I.stale(t.old_rows, t.new_rows.where("length(hash) % 3 = 0"), F.expr(DAY.replace("25", "29")))


@query("i10_new_keys", """SELECT DISTINCT p_name AS title FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size % 17 = 0 AND p_partkey % 3 = 0) AND p_name NOT IN (SELECT p_name FROM part WHERE p_brand = 'Brand#3')""")
def i10(t):
    own = t.part.withColumn("title", F.col("p_name"))
    return I.new_keys(own, own.where("p_size % 17 = 0 and p_partkey % 3 = 0"), own.where("p_brand = 'Brand#3'"))


@query("i11_diff_feed", sql_with("versions") + f", {SEEN}" + f"""
SELECT id, CASE WHEN first_seen_at > TIMESTAMP '2024-01-02 00:00:00' THEN 'added' ELSE 'updated' END AS change, CASE WHEN last_changed_at IS NULL OR first_seen_at > last_changed_at THEN first_seen_at ELSE last_changed_at END AS at
FROM stored WHERE first_seen_at > TIMESTAMP '2024-01-02 00:00:00' OR last_changed_at > TIMESTAMP '2024-01-02 00:00:00'""")  # fmt: skip
def i11(t):
    return I.diff_feed(seen(t), F.expr("TIMESTAMP '2024-01-02 00:00:00'"))


@query("i12_admission", """SELECT p_partkey AS id, p_name AS title, CASE WHEN p_size % 11 = 0 THEN 'infobox' WHEN p_name IN (SELECT p_name FROM part WHERE p_partkey < 8) THEN 'manual' WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) THEN 'class' WHEN p_type LIKE '%ECON%' OR p_brand LIKE '%#7%' THEN 'category' END AS signal
FROM part WHERE p_size % 11 = 0 OR p_name IN (SELECT p_name FROM part WHERE p_partkey < 8) OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) OR p_type LIKE '%ECON%' OR p_brand LIKE '%#7%'""")  # fmt: skip
def i12(t):
    pages = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), (F.col("p_size") % 11 == 0).alias("has_infobox"), F.array("p_type", "p_brand").alias("categories"))
    edges = t.lineitem.where("l_quantity > 49").select(F.col("l_partkey").alias("id"))
    return I.admitted(pages, pages.where("id < 8"), edges, ("econ", "#7")).select("id", "title", "signal")


@query("i13_redirects", """SELECT name, target FROM (SELECT concat('alias ', p_partkey % 60) AS name, p_name AS target, row_number() OVER (PARTITION BY p_partkey % 60 ORDER BY p_partkey) AS rn FROM part WHERE p_partkey % 4 <> 0 AND p_name LIKE '%ring%') q WHERE rn = 1""")
def i13(t):
    pages = t.part.select(F.concat(F.lit("alias "), F.col("p_partkey") % 60).alias("title"), F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("#REDIRECT [["), "p_name", F.lit("#part]] x"))).otherwise(F.lit("plain text")).alias("text"), F.col("p_partkey").alias("page"))
    return I.redirects(pages, t.part.where("p_name like '%ring%'").select(F.col("p_name").alias("title")))


@query("i14_alias_merge", """WITH a AS (SELECT p_size AS id, p_name AS alias, 0 AS src, p_partkey AS pos FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT p_size, upper(p_name), 1, p_partkey FROM part WHERE p_partkey % 3 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY id, lower(alias) ORDER BY src, pos, alias) AS rn FROM a) SELECT id, alias, CAST(row_number() OVER (PARTITION BY id ORDER BY src, pos, alias) - 1 AS INTEGER) AS position FROM k WHERE rn = 1""")  # fmt: skip
def i14(t):
    own = lambda c, k: t.part.where(F.col("p_partkey") % k == 0).select(F.col("p_size").alias("id"), c.alias("alias"), F.col("p_partkey").alias("pos"))
    return I.merge_aliases([own(F.col("p_name"), 4), own(F.upper("p_name"), 3)])


@query("i15_error_counters", """SELECT user_id, props, count(*) AS n, max(ts) AS last_at, max_by(value, ts) AS last_value, max_by(event_id, ts) AS last_event_id FROM events WHERE event_type = 'error' GROUP BY user_id, props""")
def i15(t):
    return I.error_counters(t.events.where("event_type = 'error'"), ["user_id", "props"], ["value", "event_id"])

"""Queries: filters, predicates and scalar functions (F), edge projections (V)."""

from pyspark.sql import functions as F

from edgeloom.functions import text
from edgeloom.operators import edges as E
from edgeloom.plans.bindings import sql_with
from edgeloom.plans.registry import query

FLAGGED = "flagged AS (SELECT id, title, kind, views, CASE WHEN length(title) % 7 = 0 THEN 'gone' END AS deleted_at, length(id) % 7 = 0 AS is_excluded FROM nodes)"


def flagged(t):
    return t.nodes.select("id", "title", "kind", "views", F.when(F.length("title") % 7 == 0, "gone").alias("deleted_at"), (F.length("id") % 7 == 0).alias("is_excluded"))


@query("f1_active_edges", sql_with("nodes", "edges") + ",\n" + FLAGGED + """
SELECT e.from_id, e.to_id, e.relation, e.source FROM edges e
JOIN flagged a ON a.id = e.from_id AND a.deleted_at IS NULL AND NOT a.is_excluded
JOIN flagged b ON b.id = e.to_id AND b.deleted_at IS NULL AND NOT b.is_excluded""")  # fmt: skip
def f1(t):
    return E.active_edges(t.edges, flagged(t)).select("from_id", "to_id", "relation", "source")


@query("f2_effective_relation", sql_with("edges") + """
SELECT effective, source, count(*) AS n FROM (SELECT source, CASE WHEN relation = 'related' AND evidence_relation IN ('subgenre', 'derivative', 'fusion_genre', 'regional_scene') THEN evidence_relation
  WHEN relation = 'related' AND evidence_relation = 'stylistic_origin_of' THEN 'origin_parent' ELSE relation END AS effective FROM edges) q GROUP BY ALL""")  # fmt: skip
def f2(t):
    return t.edges.withColumn("effective", E.effective_relation()).groupBy("effective", "source").agg(F.count("*").alias("n"))


@query("f3_node_list", sql_with("nodes") + """
, kept AS (SELECT * FROM nodes WHERE title ILIKE '%ring%' AND kind = 'part')
SELECT id, title, views, (SELECT count(*) FROM kept) AS total, CAST(ceil((SELECT count(*) FROM kept) / 10.0) AS BIGINT) AS pages FROM kept ORDER BY views DESC NULLS LAST, title, id LIMIT 10 OFFSET 10""")  # fmt: skip
def f3(t):
    from edgeloom.operators.lookup import list_nodes

    return list_nodes(t.nodes, contains="ring", where=F.col("kind") == "part", page=2, size=10).select("id", "title", "views", "total", "pages")


@query("f4_array_membership", sql_with("edges") + """
SELECT from_id, to_id, relation IN ('subgenre', 'derivative') AS listed, source NOT IN ('wikidata') AS unlisted FROM edges WHERE from_id IN (SELECT from_id FROM edges GROUP BY from_id HAVING count(*) > 20)""")  # fmt: skip
def f4(t):
    many = t.edges.groupBy("from_id").count().where("count > 20").select("from_id")
    return t.edges.join(many, "from_id", "left_semi").select("from_id", "to_id", F.array_contains(F.array(F.lit("subgenre"), F.lit("derivative")), F.col("relation")).alias("listed"), (~F.col("source").isin("wikidata")).alias("unlisted"))


@query("f5_patterns", sql_with("nodes") + r"""
SELECT id, title ILIKE '%WIDGET%' AS liked, regexp_matches(title, '(?i)\bRing\b') AS whole_word, regexp_matches(title, '^[a-z]+ [a-z]+ \d+$') AS shaped FROM nodes""")  # fmt: skip
def f5(t):
    return t.nodes.select("id", F.col("title").ilike("%WIDGET%").alias("liked"), F.col("title").rlike(r"(?i)\bRing\b").alias("whole_word"), F.col("title").rlike(r"^[a-z]+ [a-z]+ \d+$").alias("shaped"))


@query("f6_is_distinct", sql_with("old_rows", "new_rows") + """
SELECT o.id, o.hash IS DISTINCT FROM n.hash AS changed, n.hash IS NOT DISTINCT FROM NULL AS missing FROM old_rows o LEFT JOIN new_rows n ON n.id = o.id""")  # fmt: skip
def f6(t):
    n = t.new_rows.select("id", F.col("hash").alias("new_hash"))
    return t.old_rows.join(n, "id", "left").select("id", (~F.col("hash").eqNullSafe(F.col("new_hash"))).alias("changed"), F.col("new_hash").isNull().alias("missing"))


@query("f7_scalar_functions", """
SELECT c_custkey, greatest(c_acctbal, 0.0) AS floor_zero, least(c_acctbal, 5000.0) AS capped, coalesce(nullif(c_mktsegment, 'MACHINERY'), '-') AS segment, trim(concat(' ', c_name, ' ')) AS trimmed,
  replace(c_name, '#', '/') AS replaced, split_part(c_name, '#', 2) AS number, left(c_name, 8) AS head, strftime(TIMESTAMP '1995-03-05 00:00:00' + INTERVAL 1 DAY * (c_custkey % 365), '%Y-%m') AS month FROM customer""")  # fmt: skip
def f7(t):
    c = F.col
    day = F.expr("timestampadd(DAY, CAST(c_custkey % 365 AS INT), TIMESTAMP '1995-03-05 00:00:00')")
    return t.customer.select(
        "c_custkey", F.greatest(c("c_acctbal"), F.lit(0.0)).alias("floor_zero"), F.least(c("c_acctbal"), F.lit(5000.0)).alias("capped"), F.coalesce(F.nullif(c("c_mktsegment"), F.lit("MACHINERY")), F.lit("-")).alias("segment"),
        F.trim(F.concat(F.lit(" "), "c_name", F.lit(" "))).alias("trimmed"), F.replace("c_name", F.lit("#"), F.lit("/")).alias("replaced"), F.split_part("c_name", F.lit("#"), F.lit(2)).alias("number"), F.left("c_name", F.lit(8)).alias("head"), F.date_format(day, "yyyy-MM").alias("month"),
    )


@query("f8_json_objects", """
SELECT user_id, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total, CAST(max(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(DISTINCT event_type) AS n_types, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY user_id""")  # fmt: skip
def f8(t):
    props = F.from_json("props", "map<string,bigint>")
    each = t.events.select("user_id", "event_type", F.explode(F.map_concat(props, F.create_map(F.lit("_"), F.lit(0).cast("long")))).alias("key", "value")).where("key <> '_'")
    own = each.groupBy("user_id").agg(F.sum("value").cast("long").alias("total"), F.map_from_entries(F.array(F.struct(F.lit("k"), F.max("value")))).alias("best"), F.map_from_entries(F.array_distinct(F.collect_list(F.struct("event_type", F.lit(1))))).alias("seen"))
    return own.select("user_id", "total", F.col("best")["k"].alias("k"), F.size("seen").cast("long").alias("n_types"), F.concat_ws(",", F.array_sort(F.map_keys("seen"))).alias("types"))


@query("f9_arrays", sql_with("edges") + """
SELECT from_id, CAST(len(list(to_id)) AS BIGINT) AS n, array_to_string(list(to_id ORDER BY ordinal)[1:5], '|') AS head, list_contains(list(relation), 'related') AS has_related, CAST(sum(ordinal * (ordinal + 1)) AS BIGINT) AS weighted FROM edges GROUP BY from_id""")  # fmt: skip
def f9(t):
    own = t.edges.groupBy("from_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "to_id"))).alias("to"), F.collect_set("relation").alias("relations"))
    flat = own.select("from_id", "to", "relations", F.posexplode(F.array_append("to", F.struct(F.lit(None).cast("int").alias("ordinal"), F.lit(None).cast("string").alias("to_id")))).alias("pos", "x"))
    sums = flat.where("x.to_id is not null").groupBy("from_id").agg(F.sum(F.col("pos") * (F.col("x.ordinal") + 1)).cast("long").alias("weighted"))
    return own.join(sums, "from_id").select("from_id", F.size("to").cast("long").alias("n"), F.concat_ws("|", F.slice("to.to_id", 1, 5)).alias("head"), F.array_contains("relations", "related").alias("has_related"), "weighted")


@query("f10_title_keys", """
, x""".replace(", x", "") + r"""WITH src AS (SELECT DISTINCT concat('The ', p_name, '''s "', p_brand, '" Music (', p_type, ')') AS s FROM part)
SELECT s, trim(regexp_replace(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'), '\s+', ' ', 'g')) AS lookup,
 trim(regexp_replace(regexp_replace(replace(lower(s), '''', ''), '[^a-z0-9-]+', ' ', 'g'), '\s+', ' ', 'g')) AS mention,
 trim(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(lower(s), '\s*\([^)]*\)\s*$', ''), '[^a-z0-9]+', ' ', 'g'), '\s+', ' ', 'g')), '\s+(?:music|genre)$', '')) AS label,
 regexp_replace(regexp_replace(trim(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(lower(s), '\s*\([^)]*\)\s*$', ''), '[^a-z0-9]+', ' ', 'g'), '\s+', ' ', 'g')), '\s+(?:music|genre)$', '')), '^(?:music (?:of|in) )', ''), '^the ', '') AS container,
 regexp_replace(lower(s), '[^a-z0-9]+', '', 'g') AS compact FROM src""")  # fmt: skip
def f10(t):
    s = F.concat(F.lit("The "), "p_name", F.lit("'s \""), "p_brand", F.lit('" Music ('), "p_type", F.lit(")"))
    return t.part.select(s.alias("s")).distinct().select("s", text.lookup_key("s").alias("lookup"), text.mention_key("s").alias("mention"), text.label_key("s").alias("label"), text.container_key("s").alias("container"), text.compact_key("s").alias("compact"))


@query("f11_display_label", r"""WITH src AS (SELECT DISTINCT concat(replace(p_name, ' ', '_'), ' (', p_type, ')') AS s FROM part)
SELECT s, concat(upper(l[1]), l[2:]) AS label FROM (SELECT s, trim(regexp_replace(regexp_replace(replace(s, '_', ' '), '\s*\([^)]*\)\s*$', ''), '\s+', ' ', 'g')) AS l FROM src) q""")  # fmt: skip
def f11(t):
    return t.part.select(F.concat(F.translate("p_name", " ", "_"), F.lit(" ("), "p_type", F.lit(")")).alias("s")).distinct().select("s", text.display_label("s").alias("label"))


@query("f12_stable_unit", """WITH RECURSIVE src AS (SELECT DISTINCT p_name AS s FROM part), h AS (
SELECT s, 0 AS i, CAST(2166136261 AS HUGEINT) AS a FROM src UNION ALL
SELECT s, i + 1, (xor(CAST(a AS BIGINT), CAST(ascii(s[i + 1]) AS BIGINT)) * CAST(16777619 AS HUGEINT)) % 4294967296 FROM h WHERE i < length(s))
SELECT s, round(CAST(a AS DOUBLE) / 4294967295.0, 9) AS unit FROM h WHERE i = length(s)""")  # fmt: skip
def f12(t):
    return t.part.select(F.col("p_name").alias("s")).distinct().select("s", F.round(text.stable_unit("s"), 9).alias("unit"))


def _lab_sql() -> str:
    lin = ", ".join(f"CASE WHEN x{k} <= 0.04045 THEN x{k} / 12.92 ELSE pow((x{k} + 0.055) / 1.055, 2.4) END AS y{k}" for k in range(3))
    lms = ", ".join(f"pow({p}::DOUBLE * y0 + {q}::DOUBLE * y1 + {r}::DOUBLE * y2, 1.0::DOUBLE / 3) AS m{k}" for k, (p, q, r) in enumerate(text.LMS))
    lab = ", ".join(f"round({p}::DOUBLE * m0 + {q}::DOUBLE * m1 + {r}::DOUBLE * m2, 6) AS {n}" for n, (p, q, r) in zip(("l", "a", "b"), text.LAB))
    channels = ", ".join(f"CAST(concat('0x', substr(c, {2 + 2 * k}, 2)) AS INTEGER) / 255.0::DOUBLE AS x{k}" for k in range(3))
    return f", s1 AS MATERIALIZED (SELECT c, {channels} FROM src), s2 AS MATERIALIZED (SELECT c, {lin} FROM s1), s3 AS MATERIALIZED (SELECT c, {lms} FROM s2) SELECT c, {lab}, c AS back FROM s3"


@query("f13_oklab", "WITH src AS (SELECT DISTINCT concat('#', substr(md5(p_name), 1, 6)) AS c FROM part)" + _lab_sql())
def f13(t):
    c = t.part.select(F.concat(F.lit("#"), F.substring(F.md5(F.col("p_name").cast("binary")), 1, 6)).alias("c")).distinct()
    c = c.withColumn("lab", text.oklab("c"))
    return c.select("c", *[F.round(F.col("lab")[k], 6).alias(n) for k, n in enumerate(("l", "a", "b"))], text.srgb_hex(F.col("lab")).alias("back"))


URLS = "concat(CASE e % 6 WHEN 0 THEN 'https://www.youtube.com/watch?v=' WHEN 1 THEN 'https://youtu.be/' WHEN 2 THEN 'https://youtube.com/embed/' WHEN 3 THEN 'https://m.youtube.com/shorts/' WHEN 4 THEN 'https://example.com/watch?v=' ELSE 'https://youtube.com/watch?list=a&v=' END, substr(md5(CAST(e AS VARCHAR(20))), 1, CASE WHEN e % 7 = 0 THEN 9 ELSE 11 END), CASE WHEN e % 5 = 0 THEN '&t=3' ELSE '' END)"


@query("f14_video_id", f"WITH src AS (SELECT event_id AS e, {URLS} AS url FROM (SELECT event_id, event_id AS e FROM events) q)" + r"""
SELECT e, url, CASE WHEN e % 7 = 0 OR e % 6 = 4 OR (e % 6 IN (1, 2, 3) AND FALSE) THEN NULL ELSE substr(md5(CAST(e AS VARCHAR)), 1, 11) END AS video FROM src""")  # fmt: skip
def f14(t):
    src = t.events.select(F.col("event_id").alias("e")).select("e", F.expr(URLS.replace("md5(CAST(e AS VARCHAR(20)))", "md5(CAST(CAST(e AS STRING) AS BINARY))")).alias("url"))
    return src.select("e", "url", text.video_id("url").alias("video"))


PROBE = "CASE e % 9 WHEN 0 THEN NULL WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 404 WHEN 4 THEN 403 ELSE 200 END AS http_status, CASE e % 5 WHEN 0 THEN 'OK' WHEN 1 THEN 'ERROR' WHEN 2 THEN 'LOGIN_REQUIRED' WHEN 3 THEN 'ok' END AS status, CASE e % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS playable"


@query("f15_probe_decision", f"""SELECT decision, count(*) AS n FROM (SELECT CASE WHEN http_status IS NULL OR http_status IN (408, 425, 429) OR http_status >= 500 THEN NULL WHEN http_status IN (401, 403, 404, 410) THEN FALSE
 WHEN lower(status) = 'ok' THEN coalesce(playable, TRUE) WHEN lower(status) IN ('error', 'unplayable', 'login_required') THEN FALSE END AS decision FROM (SELECT {PROBE} FROM (SELECT event_id AS e FROM events) p) q) r GROUP BY decision""")  # fmt: skip
def f15(t):
    probe = t.events.select(F.col("event_id").alias("e")).selectExpr(*[x.strip() for x in PROBE.replace("AS http_status, ", "AS http_status;").replace("AS status, ", "AS status;").split(";")])
    return probe.select(text.probe_decision("http_status", "status", "playable").alias("decision")).groupBy("decision").agg(F.count("*").alias("n"))


@query("f16_label_box", """WITH src AS (SELECT DISTINCT p_name AS s FROM part), w AS (SELECT s, len(s) - len(translate(s, 'fijlrtI.,:;''|! ', '')) AS a, len(s) - len(translate(s, 'mwMW@%', '')) AS b FROM src)
SELECT s, round(CAST(a * 0.32 + b * 0.86 + (len(s) - a - b) * 0.56 + 0.6 AS DOUBLE), 6) AS width, CAST(1.2 AS DOUBLE) AS height FROM w""")  # fmt: skip
def f16(t):
    w, h = text.label_box("s")
    return t.part.select(F.col("p_name").alias("s")).distinct().select("s", F.round(w, 6).alias("width"), h.cast("double").alias("height"))


# --- views --------------------------------------------------------------------------------------------------------------

REVIEWED = """raw AS (SELECT from_id, CASE WHEN ordinal % 9 <> 4 THEN to_id END AS to_id, concat('label ', to_id) AS to_label, relation, source, ordinal, evidence_relation, ordinal % 11 = 3 AS is_ignored FROM edges WHERE from_id LIKE 's:%'),
reviewed AS (SELECT from_id, CASE WHEN ordinal % 10 <> 7 THEN to_id END AS to_id, CASE WHEN ordinal % 2 = 0 THEN '' ELSE concat('label ', to_id) END AS to_label,
 CASE ordinal % 6 WHEN 0 THEN 'broader_genres' WHEN 1 THEN 'subgenres' WHEN 2 THEN 'sibling_or_adjacent_genres' WHEN 3 THEN 'influences' WHEN 4 THEN 'source_genres' ELSE 'fusion_descendants' END AS relation,
 'review' AS source, ordinal, CASE WHEN ordinal % 5 = 0 THEN 'superseded' ELSE {status} END AS status, ordinal % 13 = 6 AS is_ignored, 'high' AS confidence FROM edges WHERE from_id LIKE 's:%' AND ordinal % 3 <> 1)"""
SHOWN = "SELECT r.from_id, r.to_id, coalesce(nullif(r.to_label, ''), b.title) AS to_label, r.relation, r.source, r.ordinal, r.relation AS evidence_relation, FALSE AS is_ignored, r.confidence, a.title AS from_title FROM reviewed r LEFT JOIN nodes a ON a.id = r.from_id LEFT JOIN nodes b ON b.id = r.to_id WHERE r.status = 'active' AND NOT r.is_ignored"
RAW = " UNION ALL SELECT from_id, to_id, to_label, relation, source, ordinal, evidence_relation, is_ignored, NULL AS confidence FROM raw WHERE NOT EXISTS (SELECT 1 FROM reviewed WHERE status = 'active')"
COLS = "from_id, to_id, to_label, relation, source, ordinal, evidence_relation, is_ignored, confidence"


def _reviews(t, status="'active'"):
    t.edges.createOrReplaceTempView("bound_edges")
    raw, reviewed = REVIEWED.replace("{status}", status).split(",\nreviewed AS ")
    select = lambda s: t.spark.sql(s.strip().removeprefix("raw AS ").strip()[1:-1].replace("FROM edges", "FROM bound_edges"))
    return select(raw), select(reviewed), t.nodes


def _view_sql(body: str, status="'active'") -> str:
    staged = REVIEWED.replace("reviewed AS (", "reviewed AS MATERIALIZED (").replace("{status}", status)
    return sql_with("nodes", "edges").replace("edges AS (", "edges AS MATERIALIZED (").replace("nodes AS (", "nodes AS MATERIALIZED (") + f",\n{staged},\nshown AS MATERIALIZED ({SHOWN})\n{body}{RAW}"


@query("v1_detail_edges", _view_sql(f"SELECT {COLS} FROM shown"))
def v1(t):
    return E.detail_edges(*_reviews(t))


@query("v1_detail_edges_raw", _view_sql(f"SELECT {COLS} FROM shown", "'superseded'"))
def v1_raw(t):
    return E.detail_edges(*_reviews(t, "'superseded'"))


@query("v2_traversal_edges", _view_sql("""SELECT CASE WHEN turn THEN to_id ELSE from_id END AS from_id, CASE WHEN turn THEN from_id ELSE to_id END AS to_id, CASE WHEN turn THEN from_title ELSE to_label END AS to_label, relation, source, ordinal, evidence_relation, is_ignored, confidence
FROM (SELECT *, relation IN ('broader_genres', 'fusion_components', 'source_genres') AS turn FROM shown WHERE to_id IS NOT NULL AND relation NOT IN ('sibling_or_adjacent_genres', 'influenced_by', 'influences')) q"""))  # fmt: skip
def v2(t):
    return E.traversal_edges(*_reviews(t))


@query("v3_neighbor_edges", _view_sql(f"""SELECT {COLS} FROM shown WHERE to_id IS NOT NULL UNION ALL
SELECT to_id, from_id, from_title, relation, source, ordinal, evidence_relation, is_ignored, confidence FROM shown WHERE to_id IS NOT NULL AND relation = 'sibling_or_adjacent_genres'"""))  # fmt: skip
def v3(t):
    return E.neighbor_edges(*_reviews(t))


TRACKS = "SELECT concat('o:', l_orderkey) AS id, concat('t', l_partkey, '-', l_suppkey) AS track_id, concat('https://youtu.be/', l_partkey) AS url, concat('v', l_suppkey) AS video, l_linenumber AS ordinal FROM lineitem"
BLOCKED = "SELECT CASE WHEN p_partkey % 3 = 0 THEN concat('t', p_partkey, '-', p_partkey % 100) END AS track_id, CASE WHEN p_partkey % 3 = 1 THEN concat('https://youtu.be/', p_partkey) END AS url, CASE WHEN p_partkey % 3 = 2 THEN concat('v', p_partkey) END AS video FROM part WHERE p_partkey % 25 = 7"


@query("v4_client_tracks", f"""WITH tracks AS ({TRACKS}), blocked AS ({BLOCKED})
SELECT id, track_id, url, video, CAST(row_number() OVER (PARTITION BY id ORDER BY ordinal, track_id) - 1 AS INTEGER) AS position FROM tracks t
WHERE NOT EXISTS (SELECT 1 FROM blocked b WHERE b.track_id = t.track_id OR b.url = t.url OR b.video = t.video)""")  # fmt: skip
def v4(t):
    t.lineitem.createOrReplaceTempView("bound_lineitem")
    t.part.createOrReplaceTempView("bound_part")
    return E.client_tracks(t.spark.sql(TRACKS.replace("FROM lineitem", "FROM bound_lineitem")), t.spark.sql(BLOCKED.replace("FROM part", "FROM bound_part")))

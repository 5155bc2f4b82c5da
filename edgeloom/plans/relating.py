"""Queries: joins (J), aggregations (A), windows, top rows and set operations (W, U)."""

from pyspark.sql import functions as F

from edgeloom.operators import aggregate as A
from edgeloom.operators import edges as E
from edgeloom.operators import lookup as L
from edgeloom.operators import rank as R
from edgeloom.operators.skew import spread_join
from edgeloom.operators.staging import cut
from edgeloom.plans.bindings import sql_with
from edgeloom.plans.registry import query

CATALOG = """cat AS (SELECT concat('p:', p_partkey) AS id, concat(p_name, ' ', p_partkey % 700) AS title, CASE WHEN p_partkey % 3 = 0 THEN concat('Q', p_partkey) END AS key FROM part),
red AS (SELECT concat('old ', p_partkey) AS name, concat(p_name, ' ', p_partkey % 700) AS target FROM part WHERE p_partkey % 2 = 0),
ali AS (SELECT upper(concat('alias ', p_size)) AS alias, concat('p:', p_partkey) AS id FROM part WHERE p_partkey % 5 = 0)"""


def catalog(t):
    p = t.part
    title = F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 700).cast("string"))
    pid = F.concat(F.lit("p:"), "p_partkey")
    return (p.select(pid.alias("id"), title.alias("title"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Q"), "p_partkey")).alias("key")),
            p.where("p_partkey % 2 = 0").select(F.concat(F.lit("old "), "p_partkey").alias("name"), title.alias("target")),
            p.where("p_partkey % 5 = 0").select(F.upper(F.concat(F.lit("alias "), "p_size")).alias("alias"), pid.alias("id")))


TARGETS = "SELECT l_orderkey, l_linenumber, CASE l_partkey % 4 WHEN 0 THEN concat('old ', l_partkey) WHEN 1 THEN concat(p_name, ' ', l_partkey % 700) ELSE 'nothing' END AS to_label, CASE WHEN l_partkey % 4 = 3 THEN concat('Q', l_partkey) ELSE '' END AS to_key FROM lineitem JOIN part ON p_partkey = l_partkey"


def targets(t):
    j = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    m = F.col("l_partkey") % 4
    label = F.when(m == 0, F.concat(F.lit("old "), "l_partkey")).when(m == 1, F.concat("p_name", F.lit(" "), (F.col("l_partkey") % 700).cast("string"))).otherwise("nothing")
    return j.select("l_orderkey", "l_linenumber", label.alias("to_label"), F.when(m == 3, F.concat(F.lit("Q"), "l_partkey")).otherwise("").alias("to_key"))


@query("j1_resolve_targets", f"""WITH {CATALOG}, tg AS ({TARGETS}),
tt AS (SELECT title, min(id) AS id FROM cat GROUP BY title), rr AS (SELECT name, min(cat.id) AS id FROM red JOIN cat ON cat.title = red.target GROUP BY name), kk AS (SELECT key, min(id) AS id FROM cat WHERE key IS NOT NULL GROUP BY key)
SELECT l_orderkey, l_linenumber, to_label, to_key, coalesce(tt.id, rr.id, kk.id) AS to_id, CASE WHEN tt.id IS NOT NULL THEN 'title' WHEN rr.id IS NOT NULL THEN 'redirect' WHEN kk.id IS NOT NULL THEN 'key' END AS matched_by
FROM tg LEFT JOIN tt ON tt.title = to_label LEFT JOIN rr ON rr.name = to_label LEFT JOIN kk ON kk.key = to_key""")  # fmt: skip
def j1(t):
    cat, red, _ = catalog(t)
    return L.resolve_targets(targets(t), cat, red)


@query("j2_lookup", f"""WITH {CATALOG}, tg AS (SELECT DISTINCT to_label AS name FROM ({TARGETS}) q UNION SELECT 'Alias 7' UNION SELECT 'Q9' UNION SELECT concat('alias ', p_size) FROM part WHERE p_partkey < 50),
m AS (SELECT name, id, 1 AS r FROM tg JOIN cat ON title = name UNION ALL SELECT tg.name, cat.id, 2 FROM tg JOIN red ON red.name = tg.name JOIN cat ON title = target UNION ALL SELECT name, id, 3 FROM tg JOIN ali ON lower(alias) = lower(name) UNION ALL SELECT name, id, 4 FROM tg JOIN cat ON key = name)
SELECT name, id, ['title', 'redirect', 'alias', 'key'][r] AS matched_by FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY r, id) AS rn FROM m) q WHERE rn = 1""")  # fmt: skip
def j2(t):
    cat, red, ali = catalog(t)
    names = targets(t).select(F.col("to_label").alias("name")).union(t.part.where("p_partkey < 50").select(F.concat(F.lit("alias "), "p_size"))).union(t.spark.sql("SELECT 'Alias 7' AS name UNION ALL SELECT 'Q9'")).distinct()
    return L.lookup(names, cat, red, ali)


@query("j3_root_titles", f"""WITH {CATALOG}, w AS (SELECT p_partkey AS ordinal, CASE WHEN p_partkey % 3 = 0 THEN concat('old ', p_partkey) WHEN p_partkey % 3 = 1 THEN concat(p_name, ' ', p_partkey % 700) ELSE concat('none ', p_partkey) END AS title FROM part WHERE p_partkey < 60)
SELECT ordinal, title, coalesce((SELECT min(id) FROM cat WHERE cat.title = w.title), (SELECT min(cat.id) FROM red JOIN cat ON cat.title = red.target WHERE red.name = w.title)) AS id FROM w""")  # fmt: skip
def j3(t):
    cat, red, _ = catalog(t)
    k = F.col("p_partkey")
    w = t.part.where("p_partkey < 60").select(k.alias("ordinal"), F.when(k % 3 == 0, F.concat(F.lit("old "), k)).when(k % 3 == 1, F.concat("p_name", F.lit(" "), k % 700)).otherwise(F.concat(F.lit("none "), k)).alias("title"))
    roots, missing = L.resolve_roots(w, cat, red)
    return roots.select("ordinal", "title", "id").union(missing.select("ordinal", "title", F.lit(None).cast("string")))


@query("j4_details", sql_with("nodes", "edges") + """
SELECT n.id, title, (SELECT string_agg(concat(relation, '>', to_id), ' ' ORDER BY relation, to_id) FROM edges e WHERE e.from_id = n.id) AS out_edges, (SELECT string_agg(concat(relation, '<', from_id), ' ' ORDER BY relation, from_id) FROM edges e WHERE e.to_id = n.id) AS in_edges FROM nodes n WHERE kind <> 'part'""")  # fmt: skip
def j4(t):
    kids = {"out_edges": (t.edges.withColumn("id", F.col("from_id")), "struct(relation, to_id)"), "in_edges": (t.edges.withColumn("id", F.col("to_id")), "struct(relation, from_id)")}
    d = L.details(t.nodes.where("kind <> 'part'").select("id", "title"), kids)
    flat = lambda c, sep, end: F.array_join(F.transform(c, lambda x: F.concat_ws(sep, x["relation"], x[end])), " ").alias(c)
    return d.select("id", "title", flat("out_edges", ">", "to_id"), flat("in_edges", "<", "from_id"))


@query("j5_semi_anti", sql_with("nodes", "links") + """
, f AS MATERIALIZED (SELECT to_id, bool_or(source = 'wikidata') AS good, bool_or(relation = 'related') AS bad FROM links GROUP BY to_id) SELECT id, kind FROM nodes JOIN f ON to_id = id WHERE good AND NOT bad""")  # fmt: skip
def j5(t):
    good = t.edges.where("source = 'wikidata'").select(F.col("to_id").alias("id"))
    bad = t.edges.where("relation = 'related'").select(F.col("to_id").alias("id"))
    return t.nodes.join(good, "id", "left_semi").join(bad, "id", "left_anti").select("id", "kind")


@query("j6_first_edge", sql_with("nodes", "edges") + """
SELECT n.id, e.from_id, e.relation, e.source, e.ordinal FROM nodes n LEFT JOIN LATERAL (SELECT * FROM edges e WHERE e.to_id = n.id ORDER BY CASE relation WHEN 'subgenre' THEN 0 WHEN 'derivative' THEN 1 ELSE 2 END, source, ordinal, from_id LIMIT 1) e ON TRUE WHERE kind = 'part'""")  # fmt: skip
def j6(t):
    order = [F.when(F.col("relation") == "subgenre", 0).when(F.col("relation") == "derivative", 1).otherwise(2), "source", "ordinal", "from_id"]
    best = L.first_by(t.edges.withColumn("id", F.col("to_id")), ["id"], order)
    return t.nodes.where("kind = 'part'").join(best, "id", "left").select("id", "from_id", "relation", "source", "ordinal")


@query("j7_shared_parents", sql_with("edges") + """
SELECT x.to_id AS a, y.to_id AS b, count(DISTINCT x.from_id) AS shared FROM edges x JOIN edges y ON x.from_id = y.from_id AND x.to_id < y.to_id WHERE x.relation = 'derivative' AND y.relation = 'derivative' GROUP BY 1, 2 HAVING count(DISTINCT x.from_id) > 1""")  # fmt: skip
def j7(t):
    e = t.links.where("relation = 'derivative'").select("from_id", "to_id")
    return E.shared_parents(e)


@query("j8_or_join", """SELECT DISTINCT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND ((a.p_name = b.p_name AND a.p_size = b.p_size) OR (a.p_brand = b.p_brand AND a.p_retailprice = b.p_retailprice))""")
def j8(t):
    """All pairs equal by one key or another: the first of a class and its members would not tell which key a pair shares.

    The pairs grow with the square of a class, so they are not shuffled to find what both keys give: the second key leaves out what the
    first gives. Only parts of several different rows, whose pairs can come about in several ways, have theirs made distinct.
    """
    keys = (("p_name", "p_size"), ("p_brand", "p_retailprice"))
    rows = t.part.select("p_partkey", *keys[0], *keys[1]).distinct()
    several = cut(rows.groupBy("p_partkey").count().where("count > 1").select("p_partkey"), "several")
    side = lambda df, end: df.select(F.col("p_partkey").alias(end), *[F.col(c).alias(f"{c}_{end}") for k in keys for c in k])
    same = lambda k: F.coalesce(F.expr(" and ".join(f"{c}_a = {c}_b" for c in k)), F.lit(False))

    def pairs(a, b):
        def by(k):
            a_side = side(a, "a").select("*", *[F.col(f"{c}_a").alias(c) for c in k])
            return spread_join(a_side, side(b, "b").select("*", *[F.col(f"{c}_b").alias(c) for c in k]), list(k)).where("a < b")

        return by(keys[0]).select("a", "b").union(by(keys[1]).where(~same(keys[0])).select("a", "b"))

    if several.isEmpty():
        return pairs(rows, rows)
    once, more = rows.join(several, "p_partkey", "left_anti"), rows.join(several, "p_partkey", "left_semi")
    return pairs(once, once).union(pairs(once, more).union(pairs(more, rows)).distinct())


@query("j9_normalised_join", sql_with("names") + """
, k AS (SELECT id, trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM names) SELECT id, min(id) OVER (PARTITION BY key) AS first, count(*) OVER (PARTITION BY key) AS n FROM k""")  # fmt: skip
def j9(t):
    from edgeloom.functions.text import lookup_key

    k = t.names.select("id", lookup_key("name").alias("key"))
    # every row with the first of its key, so a key that very many rows share gives as many rows, not all their pairs
    return k.join(k.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")), "key").select("id", "first", "n")


@query("j10_token_candidates", """WITH tok AS (SELECT DISTINCT p_partkey, unnest(string_split(concat(p_name, ' ', lower(p_brand)), ' ')) AS w FROM part), al AS (SELECT DISTINCT p_type, unnest(string_split(p_name, ' ')) AS w FROM part)
SELECT DISTINCT p_partkey, p_type FROM tok JOIN al USING (w)""")  # fmt: skip
def j10(t):
    tok = t.part.select("p_partkey", F.explode(F.split(F.concat_ws(" ", "p_name", F.lower("p_brand")), " ")).alias("w")).distinct()
    al = t.part.select("p_type", F.explode(F.split("p_name", " ")).alias("w")).distinct()
    return spread_join(tok, al, ["w"]).select("p_partkey", "p_type").distinct()


@query("j11_dictionary_join", """SELECT d.n_name, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation d ON d.n_nationkey = c_nationkey GROUP BY d.n_name""")
def j11(t):
    j = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))  # a small side is broadcast by its measured size
    return j.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("j12_viewport", sql_with("boxes") + " SELECT id, x, y, w, h FROM boxes WHERE (x + w / 2 >= -60 AND x - w / 2 <= 60 AND y + h / 2 >= -60 AND y - h / 2 <= 60) OR id = 3")
def j12(t):
    return L.viewport(t.boxes, -50, -50, 50, 50, 10, keep=3).select("id", "x", "y", "w", "h")


@query("j13_tiles", sql_with("boxes") + " SELECT id, CAST(tx AS BIGINT) AS tile_x, CAST(ty AS BIGINT) AS tile_y FROM (SELECT id, tx, unnest(range(CAST(floor((y - h / 2) / 16) AS BIGINT), CAST(floor((y + h / 2) / 16) AS BIGINT) + 1)) AS ty FROM (SELECT *, unnest(range(CAST(floor((x - w / 2) / 16) AS BIGINT), CAST(floor((x + w / 2) / 16) AS BIGINT) + 1)) AS tx FROM boxes) q) r")
def j13(t):
    return L.tiles(t.boxes, 16).select("id", "tile_x", "tile_y")


@query("j14_overlaps", sql_with("boxes") + " SELECT a.id AS a, b.id AS b FROM boxes a JOIN boxes b ON a.id < b.id AND abs(a.x - b.x) < (a.w + b.w) / 2 AND abs(a.y - b.y) < (a.h + b.h) / 2")
def j14(t):
    return L.overlaps(t.boxes, 24)


# --- aggregations -------------------------------------------------------------------------------------------------------


@query("a1_rollup", """SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_quantity > 40) AS large, coalesce(bool_or(l_discount > 0.09), FALSE) AS discounted, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_suppkey""")
def a1(t):
    c = F.col
    return A.rollup(t.lineitem, ["l_suppkey"], {"returned": c("l_returnflag") == "R", "large": c("l_quantity") > 40}, {"discounted": c("l_discount") > 0.09}, {"parts": c("l_partkey")})


@query("a2_distinct_counts", sql_with("edges") + " SELECT to_id, count(DISTINCT from_id) AS parents, count(DISTINCT source) AS sources, count(DISTINCT relation) AS relations FROM edges GROUP BY to_id")
def a2(t):
    return t.edges.groupBy("to_id").agg(F.countDistinct("from_id").alias("parents"), F.countDistinct("source").alias("sources"), F.countDistinct("relation").alias("relations"))


@query("a3_child_arrays", """SELECT s_suppkey AS id, coalesce((SELECT string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 45), '') AS flags, coalesce((SELECT string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) FROM customer WHERE c_nationkey = s_nationkey AND c_acctbal < 0), '') AS segments FROM supplier""")
def a3(t):
    flags = t.lineitem.where("l_quantity > 45").select(F.col("l_suppkey").alias("id"), "l_returnflag")
    seg = t.customer.where("c_acctbal < 0").select("c_nationkey", "c_mktsegment").distinct().join(t.supplier, F.col("c_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("id"), "c_mktsegment")
    d = A.child_arrays(t.supplier.select(F.col("s_suppkey").alias("id")), {"flags": (flags, "l_returnflag"), "segments": (seg, "c_mktsegment")})
    return d.select("id", F.array_join("flags", ",").alias("flags"), F.array_join("segments", ",").alias("segments"))


@query("a4_earliest", sql_with("nodes", "years") + " SELECT n.id, min(year_start) AS first_year, max(year_end) AS last_year FROM nodes n LEFT JOIN years y ON y.id = n.id GROUP BY n.id")
def a4(t):
    y = t.years.groupBy("id").agg(F.min("year_start").alias("first_year"), F.max("year_end").alias("last_year"))
    return t.nodes.select("id").join(y, "id", "left")


@query("a5_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def a5(t):
    return A.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("a6_map_totals", """SELECT n, string_agg(concat(k, '=', v), ',' ORDER BY k) AS totals FROM (SELECT user_id % 10 AS n, event_type AS k, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS v FROM events GROUP BY 1, 2) q GROUP BY n""")
def a6(t):
    m = t.events.select((F.col("user_id") % 10).alias("n"), F.create_map("event_type", F.get_json_object("props", "$.k").cast("long")).alias("m"))
    return A.map_totals(m, ["n"], "m").select("n", F.array_join(F.transform(F.map_entries("totals"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("totals"))


@query("a7_weighted_stats", sql_with("years") + ", m AS (SELECT id, sum(year_start * weight) / sum(weight) AS mean, sum(weight) AS total FROM years GROUP BY id) SELECT id, round(mean, 6) AS mean, round(sqrt(sum(weight * pow(year_start - mean, 2)) / any_value(total)), 6) AS sd, any_value(total) AS total FROM years JOIN m USING (id) GROUP BY id, mean")
def a7(t):
    return A.weighted_stats(t.years, ["id"], "year_start", "weight").select("id", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "total")


@query("a8_weighted_quantiles", sql_with("years") + ", r AS (SELECT id, year_start, sum(weight) OVER (PARTITION BY id ORDER BY year_start) AS run, sum(weight) OVER (PARTITION BY id) AS al FROM years) SELECT id, min(CASE WHEN run >= 0.16 * al THEN year_start END) AS low, min(CASE WHEN run >= 0.5 * al THEN year_start END) AS mid, min(CASE WHEN run >= 0.84 * al THEN year_start END) AS high FROM r GROUP BY id")
def a8(t):
    return A.weighted_quantiles(t.years, ["id"], "year_start", "weight", {"low": 0.16, "mid": 0.5, "high": 0.84})


@query("a9_weighted_degree", sql_with("together") + " SELECT id, CAST(sum(n) AS BIGINT) AS degree FROM (SELECT a AS id, n FROM together UNION ALL SELECT b, n FROM together) q GROUP BY id")
def a9(t):
    return A.weighted_degree(t.together)


@query("a10_merge_edges", sql_with("together", "succ") + """, e AS (SELECT least(from_id, to_id) AS a, greatest(from_id, to_id) AS b, 'succ' AS source, 0.5 * n AS weight FROM succ UNION ALL SELECT least(a, b), greatest(a, b), 'together', 0.25 * n FROM together), s AS (SELECT a, b, source, sum(weight) AS w FROM e GROUP BY ALL)
SELECT a, b, CAST(greatest(0.3, least(1.5, sum(w))) AS DOUBLE) AS weight, string_agg(source, ',' ORDER BY source) AS sources FROM s GROUP BY a, b""")  # fmt: skip
def a10(t):
    e = t.succ.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), F.lit("succ").alias("source"), (F.col("n") * 0.5).alias("weight")).union(t.together.select("a", "b", F.lit("together"), F.col("n") * 0.25))
    return A.merge_edges(e, 0.3, 1.5).select("a", "b", "weight", F.array_join(F.map_keys("sources"), ",").alias("sources"))


EVID = "SELECT l_partkey AS id, l_returnflag AS source, round(l_discount * 8, 2) AS score, round(l_tax * 10, 2) AS confidence, concat('o', l_orderkey) AS evidence FROM lineitem"


@query("a11_merge_evidence", f"""WITH e AS ({EVID}), s AS (SELECT id, max(score) AS score, max(confidence) AS confidence, count(DISTINCT source) AS n_sources FROM e GROUP BY id),
k AS (SELECT id, string_agg(concat(source, ': ', evidence), ' | ' ORDER BY rn) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, source, evidence) AS rn FROM e) q WHERE rn <= 12 GROUP BY id)
SELECT id, round(least(1.0, score + CASE WHEN n_sources > 1 THEN 0.08 ELSE 0 END), 6) AS score, round(least(1.0, confidence + CASE WHEN n_sources > 1 THEN 0.08 ELSE 0 END), 6) AS confidence, n_sources, least(1.0, confidence + CASE WHEN n_sources > 1 THEN 0.08 ELSE 0 END) < 0.7 AS needs_review, evidence FROM s JOIN k USING (id)""")  # fmt: skip
def a11(t):
    t.lineitem.createOrReplaceTempView("bound_lineitem")
    m = A.merge_evidence(t.spark.sql(EVID.replace("FROM lineitem", "FROM bound_lineitem")), ["id"])
    return m.select("id", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"), "n_sources", "needs_review", F.array_join("evidence", " | ").alias("evidence"))


@query("a12_stats", sql_with("nodes", "edges", "names") + """
SELECT 'nodes' AS metric, count(*) AS value FROM nodes UNION ALL SELECT 'named', count(views) FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'related', count(*) FILTER (WHERE relation = 'related') FROM edges UNION ALL SELECT 'targets', count(DISTINCT to_id) FROM edges
UNION ALL SELECT 'resolved', count(*) FROM edges WHERE to_id IN (SELECT id FROM nodes) UNION ALL SELECT 'aliases', count(DISTINCT name) FROM names UNION ALL SELECT concat('queue:', event_type), count(*) FROM events GROUP BY event_type UNION ALL SELECT 'last_snapshot', max(event_id) FROM events""")  # fmt: skip
def a12(t):
    n = A.metrics({"nodes": F.count("*"), "named": F.count("views")}, t.nodes)
    e = t.edges.join(t.nodes.select(F.col("id").alias("to_id"), F.lit(True).alias("known")), "to_id", "left")
    n = n.union(A.metrics({"edges": F.count("*"), "related": F.count_if(F.col("relation") == "related"), "targets": F.countDistinct("to_id"), "resolved": F.count("known")}, e))
    queue = t.events.groupBy(F.concat(F.lit("queue:"), "event_type").alias("metric")).agg(F.count("*").alias("value"))
    return n.union(A.metrics({"aliases": F.countDistinct("name")}, t.names)).union(queue).union(A.metrics({"last_snapshot": F.max("event_id")}, t.events))


@query("a13_shortfalls", """WITH m AS (SELECT l_suppkey AS id, l_partkey AS member, CASE l_linenumber % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS playable FROM lineitem WHERE l_quantity > 40)
SELECT id, playable, blocked, unknown, 40 - playable AS missing FROM (SELECT s_suppkey AS id, count(*) FILTER (WHERE playable) AS playable, count(*) FILTER (WHERE member IS NOT NULL AND NOT playable) AS blocked, count(*) FILTER (WHERE member IS NOT NULL AND playable IS NULL) AS unknown FROM supplier LEFT JOIN m ON m.id = s_suppkey GROUP BY 1) q WHERE playable < 40""")  # fmt: skip
def a13(t):
    m = t.lineitem.where("l_quantity > 40").select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("member"), F.when(F.col("l_linenumber") % 3 == 0, True).when(F.col("l_linenumber") % 3 == 1, False).alias("playable"))
    return A.shortfalls(t.supplier.select(F.col("s_suppkey").alias("id")), m, 40)


# --- windows ------------------------------------------------------------------------------------------------------------


@query("w1_keep_best", """SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, l_extendedprice, CASE WHEN rn = 1 THEN 'kept' ELSE 'duplicate' END AS verdict FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_discount DESC, l_orderkey, l_linenumber, l_extendedprice) AS rn FROM lineitem WHERE l_suppkey < 5) q""")
def w1(t):
    kept, rest = R.keep_best(t.lineitem.where("l_suppkey < 5"), ["l_suppkey", "l_partkey"], [F.desc("l_discount"), "l_orderkey", "l_linenumber", "l_extendedprice"])
    cols = ["l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice"]
    return kept.select(*cols, F.lit("kept").alias("verdict")).union(rest.select(*cols, "reason"))


@query("w2_renumber", "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INTEGER) AS position FROM orders")
def w2(t):
    return R.renumber(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "position")


@query("w3_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def w3(t):
    best = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k")))
    return t.orders.groupBy("o_custkey").agg(best.alias("b")).select("o_custkey", "b.o_orderkey", "b.o_totalprice")


@query("w4_priority_order", "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey) AS rn FROM orders) q WHERE rn = 1")
def w4(t):
    status = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return L.first_by(t.orders, ["o_custkey"], [status, F.desc("o_orderdate"), "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("w5_importance", """WITH p AS (SELECT p_partkey AS id, p_retailprice AS views, p_size AS decade FROM part), r AS (SELECT *, row_number() OVER (ORDER BY views DESC NULLS LAST, id) AS g, count(*) OVER () AS gn, row_number() OVER (PARTITION BY decade ORDER BY views DESC NULLS LAST, id) AS i, count(*) OVER (PARTITION BY decade) AS n FROM p)
SELECT id, round(greatest(0.15, 0.6 * CASE WHEN gn <= 1 THEN 1.0 ELSE 1 - (g - 1) / (gn - 1)::DOUBLE END + 0.4 * CASE WHEN n <= 1 THEN 1.0 ELSE 1 - (i - 1) / (n - 1)::DOUBLE END), 6) AS importance FROM r""")  # fmt: skip
def w5(t):
    p = t.part.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("views"), F.col("p_size").alias("decade"))
    return R.importance(p, "views", "decade").select("id", F.round("importance", 6).alias("importance"))


@query("w6_top_neighbours", sql_with("together") + """, b AS (SELECT a, b, n FROM together UNION ALL SELECT b, a, n FROM together), k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS rn FROM b) SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, n AS weight FROM k WHERE rn <= 5""")
def w6(t):
    return R.top_neighbours(t.together.withColumnRenamed("n", "weight"), 5)


@query("w7_levels", """WITH d AS (SELECT p_partkey AS id, concat(p_name, CASE WHEN p_partkey % 4 = 1 THEN ' music of the old town' ELSE '' END) AS label, p_retailprice AS views, p_size AS children, p_partkey % 7 AS parents, p_partkey % 5 AS depth, p_partkey % 3 = 0 AS has_playlist FROM part), m AS (SELECT greatest(1.0, max(ln(1 + views))) AS v, greatest(1, max(children)) AS c, greatest(1, max(parents)) AS p FROM d),
s AS (SELECT d.*, CAST(round(greatest(0.0, least(1.0, children / c::DOUBLE * 0.52 + ln(1 + views) / v * 0.31 + parents / p::DOUBLE * 0.12 + CASE WHEN id = 17 THEN 0.2 ELSE 0 END + CASE WHEN depth <= 1 THEN 0.08 WHEN depth <= 2 THEN 0.035 ELSE 0 END + CASE WHEN has_playlist THEN 0.025 ELSE 0 END - greatest(0, len(regexp_extract_all(label, '([a-zA-Z0-9]+)', 1)) - 3) * 0.045 - CASE WHEN regexp_matches(label, 'music (of|in)') THEN 0.28 ELSE 0 END)), 6) AS DOUBLE) AS score FROM d, m),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, children DESC, views DESC, parents DESC, lower(label), id) - 1 AS rank, count(*) OVER () AS total FROM s),
x AS (SELECT *, 0.35 + pow(rank / greatest(1, total - 1)::DOUBLE, 0.72) * 1.65 AS a FROM r), y AS (SELECT *, greatest(0.28, least(2.0, CASE WHEN depth <= 1 OR id = 17 THEN least(0.42, a) WHEN depth <= 2 THEN least(1.15, a) WHEN has_playlist THEN least(1.55, a) ELSE a END)) AS sc FROM x)
SELECT id, score, rank, CAST(round(sc, 4) AS DOUBLE) AS show_scale, CAST(round(greatest(0.05, round(sc, 4) - 0.15), 4) AS DOUBLE) AS hide_scale, CAST(CASE WHEN sc <= 0.5 THEN 0 WHEN sc <= 0.8 THEN 1 WHEN sc <= 1.15 THEN 2 WHEN sc <= 1.5 THEN 3 WHEN sc < 2.0 THEN 4 ELSE 5 END AS INTEGER) AS tier FROM y""")  # fmt: skip
def w7(t):
    k = F.col("p_partkey")
    label = F.concat("p_name", F.when(k % 4 == 1, " music of the old town").otherwise(""))
    d = t.part.select(k.alias("id"), label.alias("title"), label.alias("label"), F.col("p_retailprice").alias("views"), F.col("p_size").alias("children"), (k % 7).alias("parents"), (k % 5).alias("depth"), (k % 3 == 0).alias("has_playlist"))
    return R.levels(d, 17).select("id", "score", "rank", "show_scale", "hide_scale", "tier")


@query("w8_best_rank_rows", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM (SELECT *, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS r, min(CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) OVER (PARTITION BY l_orderkey) AS b FROM lineitem) q WHERE r = b")
def w8(t):
    rank = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return R.best_rank_rows(t.lineitem, ["l_orderkey"], rank).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")


@query("w9_top_page", sql_with("nodes") + " SELECT id, views FROM nodes ORDER BY views DESC NULLS LAST, title, id LIMIT 25 OFFSET 10")
def w9(t):
    return t.nodes.orderBy(F.desc_nulls_last("views"), "title", "id").offset(10).limit(25).select("id", "views")


@query("w10_random_row", sql_with("nodes") + " SELECT id FROM nodes WHERE views IS NOT NULL ORDER BY md5(concat(id, ':5')), id LIMIT 1")
def w10(t):
    return R.random_row(t.nodes.where("views is not null"), 5).select("id")


@query("w11_priority_limit", sql_with("nodes") + " SELECT id, kind FROM nodes ORDER BY CASE kind WHEN 'region' THEN 0 WHEN 'nation' THEN 1 ELSE 2 END, views DESC NULLS LAST, id LIMIT 60")
def w11(t):
    tier = F.when(F.col("kind") == "region", 0).when(F.col("kind") == "nation", 1).otherwise(2)
    return R.ordered_first(t.nodes, [tier, F.desc_nulls_last("views"), "id"], 60).select("id", "kind")


@query("u1_set_operations", """WITH a AS (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45)
SELECT 'union' AS op, k FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'except', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'intersect', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b)""")  # fmt: skip
def u1(t):
    a, b = (t.lineitem.where(w).select(F.col("l_partkey").alias("k")) for w in ("l_returnflag = 'R'", "l_quantity > 45"))
    made = {"union": a.union(b).distinct(), "except": a.subtract(b), "intersect": a.intersect(b)}
    named = [d.select(F.lit(n).alias("op"), "k") for n, d in made.items()]
    return named[0].union(named[1]).union(named[2])

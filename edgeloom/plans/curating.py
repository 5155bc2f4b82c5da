"""Queries: containers (G19 to G33), ownership evidence (T9 to T12), curation and audits (Q)."""

from pyspark.sql import functions as F

from edgeloom.operators import curate as C
from edgeloom.operators import edges as E
from edgeloom.operators import graph as G
from edgeloom.operators import regions as R
from edgeloom.operators import triage as T
from edgeloom.operators.staging import cut
from edgeloom.plans import graphs
from edgeloom.plans.bindings import sql_with
from edgeloom.plans.graphs import TREE
from edgeloom.plans.registry import query

INB = "inb AS (SELECT to_id, from_id, CASE WHEN from_id LIKE '%:1_' OR from_id LIKE '%:2_' OR from_id LIKE '%:4_' THEN 'subclass_of' WHEN from_id LIKE '%:3_' THEN 'derivative' ELSE 'influenced' END AS relation FROM succ), nod AS (SELECT id, concat('t', id) AS title FROM (SELECT from_id AS id FROM inb UNION SELECT to_id FROM inb) q)"


def inbound(t):
    rel = F.when(F.rlike("from_id", F.lit(":[124].$")), "subclass_of").when(F.rlike("from_id", F.lit(":3.$")), "derivative").otherwise("influenced")
    e = t.succ.select("to_id", "from_id", rel.alias("relation"))
    n = e.select(F.col("from_id").alias("id")).union(e.select("to_id")).distinct()
    return e, n.withColumn("title", F.concat(F.lit("t"), "id"))


@query("g19_infer_inbound", sql_with("succ", recursive=True) + f""", {INB}, sub AS (SELECT DISTINCT to_id AS p, from_id AS c FROM inb WHERE relation = 'subclass_of' AND to_id NOT LIKE '%:5P'),
gr AS (SELECT from_id AS p, to_id AS c FROM inb WHERE relation = 'derivative' UNION SELECT p, c FROM sub), h AS (SELECT p AS s, c AS id, 1 AS d FROM gr WHERE p IN (SELECT p FROM sub) UNION SELECT h.s, g.c, h.d + 1 FROM h JOIN gr g ON g.p = h.id WHERE h.d < 4 AND g.c <> h.s),
a AS (SELECT p, c, CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.s = sub.p AND h.id = sub.c AND d >= 2) THEN 'related' ELSE 'subgenre' END AS relation, 'subclass_of' AS evidence, 0 AS k FROM sub
 UNION ALL SELECT to_id, from_id, CASE WHEN from_id LIKE '%F' THEN 'subgenre' ELSE 'related' END, CASE WHEN from_id LIKE '%F' THEN 'summary_taxonomy' ELSE concat('inverse_', relation) END, 1 FROM inb WHERE relation <> 'subclass_of' AND to_id NOT LIKE '%:5P'),
b AS (SELECT *, row_number() OVER (PARTITION BY p, c ORDER BY CASE relation WHEN 'subgenre' THEN 0 ELSE 1 END, k, evidence) AS rn FROM a WHERE NOT EXISTS (SELECT 1 FROM inb i WHERE i.from_id = a.p AND i.relation = a.relation AND i.to_id = a.c))
SELECT p AS from_id, c AS to_id, relation, evidence, CAST(row_number() OVER (PARTITION BY p ORDER BY lower(concat('t', c)), c) - 1 AS INTEGER) AS ordinal FROM b WHERE rn = 1""")  # fmt: skip
def g19(t):
    e, n = inbound(t)
    cues = e.where("from_id like '%F'").select(F.col("from_id").alias("child"), F.col("to_id").alias("parent"))
    return R.infer_inbound(e, n, cues, n.where("id like '%:5P'"), max_depth=4)


MAPPED = "mp AS (SELECT id, concat('box ', length(title), kind) AS container, kind, CASE WHEN length(id) % 2 = 0 THEN 0.9 ELSE 0.6 END::DOUBLE AS confidence FROM nodes WHERE length(title) % 4 <> 1)"


def mapped(t):
    return t.nodes.where("length(title) % 4 <> 1").select("id", F.concat(F.lit("box "), F.length("title").cast("string"), "kind").alias("container"), "kind", F.when(F.length("id") % 2 == 0, 0.9).otherwise(0.6).alias("confidence"))


@query("g20_projection", sql_with("nodes", "edges") + f""", {MAPPED}, j AS (SELECT relation = 'regional_scene' AS turn, a.container AS x, a.kind AS xk, a.confidence AS xc, b.container AS y, b.kind AS yk, b.confidence AS yc FROM edges e JOIN mp a ON a.id = e.from_id JOIN mp b ON b.id = e.to_id WHERE a.container <> b.container),
k AS (SELECT CASE WHEN turn THEN y ELSE x END AS child_id, CASE WHEN turn THEN x ELSE y END AS parent_id, CASE CASE WHEN turn THEN xk ELSE yk END WHEN 'region' THEN 'part_of' WHEN 'nation' THEN 'admin_parent' ELSE 'cultural_region_of' END AS relation, least(xc, yc) AS confidence FROM j)
SELECT child_id, parent_id, relation, max(confidence) AS confidence FROM k WHERE confidence >= 0.5 GROUP BY ALL""")  # fmt: skip
def g20(t):
    return R.project(t.edges, mapped(t), 0.5)


@query("g21_map_containers", """WITH s AS (SELECT p_partkey AS id, p_brand AS container, 'page' AS origin, 0.95::DOUBLE AS confidence FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT p_partkey, p_type, 'promoted', 0.9 FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, split_part(p_name, ' ', 2), 'title', 0.7 FROM part)
SELECT id, container, origin, confidence FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY confidence DESC, container) AS rn FROM s WHERE lower(container) NOT IN ('ring', 'brand#5')) q WHERE rn = 1""")  # fmt: skip
def g21(t):
    own = lambda c, k: t.part.where(F.col("p_partkey") % k == 0).select(F.col("p_partkey").alias("id"), c.alias("container"))
    denied = t.spark.createDataFrame([("Ring",), ("Brand#5",)], "name string")
    return R.map_containers([("page", 0.95, own(F.col("p_brand"), 5)), ("promoted", 0.9, own(F.col("p_type"), 3)), ("title", 0.7, own(F.split_part("p_name", F.lit(" "), F.lit(2)), 1))], denied)


@query("g22_seed_containers", """WITH t AS (SELECT concat('p:', p_partkey) AS id, CASE WHEN p_partkey % 2 = 0 THEN concat('Music of the ', p_name) ELSE p_name END AS title, p_size % 3 <> 0 AS approved FROM part)
SELECT replace(substr(title, 14), ' ', '-') AS container_id, count(*) AS n, min(substr(title, 14)) AS name FROM t WHERE approved AND title LIKE 'Music of the %' GROUP BY 1""")  # fmt: skip
def g22(t):
    from edgeloom.functions.text import slug
    from edgeloom.operators.extract import container_name

    own = t.part.select(F.concat(F.lit("p:"), "p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Music of the "), "p_name")).otherwise(F.col("p_name")).alias("title"), (F.col("p_size") % 3 != 0).alias("approved"))
    c, pages = R.seed_containers(own, container_name("title"), slug(container_name("title")))
    return c.join(pages.groupBy("container_id").agg(F.count("*").alias("n")), "container_id").select("container_id", "n", "name")


CAND = "SELECT p_name AS title, p_brand AS parent_name, p_type AS member_title, CASE p_size % 4 WHEN 0 THEN 'admin' WHEN 1 THEN 'cultural' WHEN 2 THEN 'historical' ELSE 'sub' END AS kind, round(0.5 + p_size / 100.0, 2) AS confidence, CASE WHEN p_partkey % 2 = 0 THEN 'list' ELSE 'category' END AS source FROM part"


@query("g23_proposals", f"""WITH c AS ({CAND}), x AS (SELECT DISTINCT lower(p_name) AS k, concat('c:', p_name) AS id FROM part WHERE p_name NOT LIKE 'red%' UNION SELECT DISTINCT lower(p_brand), concat('c:', p_brand) FROM part)
SELECT a.id AS container, b.id AS other, CASE kind WHEN 'historical' THEN 'historical_region_of' WHEN 'cultural' THEN 'cultural_region_of' WHEN 'admin' THEN 'admin_parent' ELSE 'part_of' END AS relation, CAST(max(confidence) AS DOUBLE) AS confidence FROM c JOIN x a ON a.k = lower(title) JOIN x b ON b.k = lower(parent_name) WHERE a.id <> b.id GROUP BY ALL
UNION ALL SELECT a.id, concat('n:', member_title), CASE source WHEN 'list' THEN 'associated_with' ELSE 'owned_by' END, CAST(max(confidence) AS DOUBLE) FROM c JOIN x a ON a.k = lower(title) GROUP BY ALL""")  # fmt: skip
def g23(t):
    t.part.createOrReplaceTempView("bound_part")
    cand = t.spark.sql(CAND.replace("FROM part", "FROM bound_part")).withColumn("confidence", F.col("confidence").cast("double"))
    names = t.part.where("p_name not like 'red%'").select(F.col("p_name").alias("name")).union(t.part.select("p_brand")).distinct()
    up, down = R.proposals(cand, names.withColumn("container_id", F.concat(F.lit("c:"), "name")), t.part.select(F.lower("p_type").alias("key"), F.concat(F.lit("n:"), "p_type").alias("id")).distinct())
    return up.select(F.col("child_id").alias("container"), F.col("parent_id").alias("other"), "relation", "confidence").union(down.select("container_id", "node", "relation", "confidence"))


@query("g24_promotion", """WITH c AS (SELECT concat('k', p_partkey) AS container_id, p_name AS name, p_size AS priority FROM part WHERE p_partkey % 3 = 0), n AS (SELECT lower(p_name) AS t, min(concat('p:', p_partkey)) AS id FROM part WHERE p_partkey % 7 = 1 GROUP BY 1),
j AS (SELECT c.*, n.id FROM c LEFT JOIN n ON t = lower(name)), m AS (SELECT container_id, id, FALSE AS is_new FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY priority, container_id) AS rn FROM j WHERE id IS NOT NULL) q WHERE rn = 1 UNION ALL SELECT container_id, concat('c:', container_id), TRUE FROM j WHERE id IS NULL),
e AS (SELECT concat('k', p_partkey) AS child, concat('k', p_partkey % 30 * 3) AS parent, CASE WHEN p_size % 2 = 0 THEN 'admin_parent' ELSE 'part_of' END AS relation FROM part),
d AS (SELECT a.id AS from_id, b.id AS to_id, relation, row_number() OVER (PARTITION BY a.id, b.id ORDER BY CASE relation WHEN 'admin_parent' THEN 0 ELSE 1 END) AS rn FROM e JOIN m a ON a.container_id = parent JOIN m b ON b.container_id = child WHERE a.id <> b.id)
SELECT from_id, to_id, relation, CAST(row_number() OVER (PARTITION BY from_id ORDER BY to_id) - 1 AS INTEGER) AS ordinal FROM d WHERE rn = 1""")  # fmt: skip
def g24(t):
    return _promoted(t)[1]


@query("g24_nodes", """WITH c AS (SELECT concat('k', p_partkey) AS container_id, p_name AS name, p_size AS priority FROM part WHERE p_partkey % 3 = 0), n AS (SELECT lower(p_name) AS t, min(concat('p:', p_partkey)) AS id FROM part WHERE p_partkey % 7 = 1 GROUP BY 1), j AS (SELECT c.*, n.id FROM c LEFT JOIN n ON t = lower(name))
SELECT container_id, id, FALSE AS is_new FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY priority, container_id) AS rn FROM j WHERE id IS NOT NULL) q WHERE rn = 1 UNION ALL SELECT container_id, concat('c:', container_id), TRUE FROM j WHERE id IS NULL""")  # fmt: skip
def g24b(t):
    return _promoted(t)[0]


def _promoted(t):
    k = F.col("p_partkey")
    c = t.part.where("p_partkey % 3 = 0").select(F.concat(F.lit("k"), k).alias("container_id"), F.col("p_name").alias("name"), F.col("p_size").alias("priority"))
    n = t.part.where("p_partkey % 7 = 1").select(F.concat(F.lit("p:"), k).alias("id"), F.col("p_name").alias("title"))
    e = t.part.select(F.concat(F.lit("k"), k).alias("child"), F.concat(F.lit("k"), k % 30 * 3).alias("parent"), F.when(F.col("p_size") % 2 == 0, "admin_parent").otherwise("part_of").alias("relation"))
    return R.promote(c, n, e)


METRICS = "mt AS (SELECT s_suppkey AS id, s_name AS name, CASE s_suppkey % 4 WHEN 0 THEN 'country' WHEN 1 THEN 'sub_region' ELSE 'cultural' END AS kind, s_suppkey % 3 AS owned, s_suppkey % 2 AS candidates, s_suppkey % 5 AS children, CASE WHEN s_suppkey % 10 = 3 THEN 2 ELSE 0 END AS country_children, s_suppkey % 9 = 4 AS special FROM supplier), ed AS (SELECT DISTINCT l_suppkey AS child, l_partkey % 20 * 4 % (SELECT count(*) FROM supplier) AS parent, round(l_discount * 10, 2) AS confidence FROM lineitem WHERE l_quantity > 44)"


@query("g25_collapse", f"""WITH {METRICS}, low AS (SELECT id FROM mt WHERE (owned + candidates + children <= 1 OR (candidates = 0 AND owned < 2 AND children < 3)) AND NOT special AND NOT (kind = 'continent' OR country_children >= 2 OR children >= 8 OR (kind IN ('cultural', 'sub_region') AND children >= 5 AND owned >= 1))),
m0 AS (SELECT child AS old, parent AS new FROM (SELECT ed.*, row_number() OVER (PARTITION BY child ORDER BY confidence DESC, name, parent) AS rn FROM ed JOIN mt ON mt.id = parent AND kind = 'country' WHERE child IN (SELECT id FROM low)) q WHERE rn = 1), m AS (SELECT * FROM m0 WHERE new NOT IN (SELECT old FROM m0))
SELECT child, coalesce(m.new, parent) AS parent, max(confidence) AS confidence FROM ed LEFT JOIN m ON m.old = parent WHERE child NOT IN (SELECT old FROM m) AND child <> coalesce(m.new, parent) GROUP BY ALL""")  # fmt: skip
def g25(t):
    k, n = F.col("s_suppkey"), t.supplier.count()
    mt = t.supplier.select(k.alias("id"), F.col("s_name").alias("name"), F.when(k % 4 == 0, "country").when(k % 4 == 1, "sub_region").otherwise("cultural").alias("kind"), (k % 3).alias("owned"), (k % 2).alias("candidates"), (k % 5).alias("children"), F.when(k % 10 == 3, 2).otherwise(0).alias("country_children"), (k % 9 == 4).alias("special"))
    ed = t.lineitem.where("l_quantity > 44").select(F.col("l_suppkey").alias("child"), (F.col("l_partkey") % 20 * 4 % n).alias("parent"), F.round(F.col("l_discount") * 10, 2).alias("confidence")).distinct()
    ed = ed.join(mt.select(F.col("id").alias("parent"), F.col("kind").alias("parent_kind"), F.col("name").alias("parent_name")), "parent", "left")
    return R.collapse(mt, ed, ed.select(F.col("parent").alias("container"), F.col("child").alias("node"), "confidence"))[1]


_TREE = """WITH RECURSIVE rg AS (SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 20 = 3 THEN 'city' ELSE ['country', 'subregion', 'cultural_region', 'historical_region', 'continent'][1 + CASE s_suppkey % 10 WHEN 0 THEN 0 WHEN 9 THEN 4 ELSE 1 + s_suppkey % 3 END] END AS kind, s_suppkey % 9 = 4 AS special, CASE WHEN s_suppkey % 11 = 2 THEN concat('Music of ', s_name) ELSE s_name END AS title FROM supplier),
e0 AS (SELECT l_suppkey AS child, l_partkey % (SELECT count(*) FROM supplier) AS parent, max(l_discount) AS confidence FROM lineitem WHERE l_quantity > 49 GROUP BY ALL UNION ALL SELECT s_suppkey, s_suppkey // 10 * 10, 1.0 FROM supplier WHERE s_suppkey % 13 = 5), ed AS (SELECT child, parent, max(confidence) AS confidence FROM e0 WHERE child <> parent GROUP BY ALL),
mb AS (SELECT l_suppkey AS region, l_partkey AS node, max(l_tax) AS confidence, CASE max(l_returnflag) WHEN 'A' THEN 'accepted' ELSE 'candidate' END AS status FROM lineitem WHERE l_suppkey % 4 = 1 AND l_quantity < 3 GROUP BY ALL), nm AS (SELECT ed.*, c.kind AS ck, p.kind AS pk, p.name AS pn FROM ed JOIN rg c ON c.id = child JOIN rg p ON p.id = parent),
hm AS (SELECT child AS id, parent AS home FROM (SELECT *, row_number() OVER (PARTITION BY child ORDER BY confidence DESC, pn, parent) AS n FROM nm WHERE pk = 'country') q WHERE n = 1), up AS (SELECT child AS id, count(*) AS parents, count(*) FILTER (WHERE pk = 'country') AS cp FROM nm GROUP BY 1), dn AS (SELECT parent AS id, count(*) AS children, count(*) FILTER (WHERE ck = 'country') AS cc FROM nm GROUP BY 1), hl AS (SELECT region AS id, count(*) FILTER (WHERE status = 'accepted') AS owned, count(*) FILTER (WHERE status <> 'accepted') AS cand FROM mb GROUP BY 1),
mm AS (SELECT rg.*, coalesce(parents, 0) AS parents, coalesce(cp, 0) AS cp, coalesce(children, 0) AS children, coalesce(cc, 0) AS cc, coalesce(owned, 0) AS owned, coalesce(cand, 0) AS cand, home FROM rg LEFT JOIN up USING (id) LEFT JOIN dn USING (id) LEFT JOIN hl USING (id) LEFT JOIN hm USING (id)),
m1 AS (SELECT *, kind = 'continent' OR name = 'Supplier#000000021' OR children >= 8 OR (kind IN ('cultural_region', 'subregion') AND children >= 5 AND owned >= 1) AS stays, owned + cand + children AS total, CASE WHEN kind IN ('cultural_region', 'diaspora_region', 'historical_region') THEN owned = 0 AND children = 0 ELSE owned < 2 AND children < 3 END AS loose FROM mm),
m2 AS (SELECT *, stays OR cc >= 2 AS sup, coalesce(CASE WHEN id % 17 = 6 THEN id - 1 END, CASE WHEN (id % 7 = 3 AND parents = 1 AND cp = 1) OR (kind NOT IN ('country', 'continent', 'city') AND NOT (special AND total > 0) AND NOT stays AND cp > 0 AND (total <= 1 OR (cand = 0 AND loose))) THEN home END) AS tg FROM m1),
ms AS (SELECT id AS old, tg AS new FROM m2 WHERE tg <> id), wk AS (SELECT old, new AS nd, [old] AS path FROM ms UNION ALL SELECT wk.old, ms.new, list_append(path, nd) FROM wk JOIN ms ON ms.old = nd WHERE NOT list_contains(path, nd)),
ma AS (SELECT old, new FROM (SELECT old, CASE WHEN list_contains(path, nd) THEN list_min(path[list_position(path, nd):]) ELSE nd END AS new FROM wk WHERE list_contains(path, nd) OR nd NOT IN (SELECT old FROM ms)) q WHERE old <> new),
e2 AS (SELECT child, coalesce(new, parent) AS parent, max(confidence) AS confidence FROM ed LEFT JOIN ma ON old = parent WHERE child NOT IN (SELECT old FROM ma) AND child <> coalesce(new, parent) GROUP BY ALL), e3 AS (SELECT e2.*, kind, sup, bool_or(kind = 'country') OVER (PARTITION BY child) AS hc FROM e2 JOIN m2 ON m2.id = parent), e4 AS (SELECT child, parent, confidence, CASE WHEN hc AND kind <> 'country' AND sup THEN 'rejected' ELSE 'accepted' END AS status FROM e3),
h2 AS (SELECT coalesce(new, region) AS region, node, max(confidence) AS confidence, min(status) AS status FROM mb LEFT JOIN ma ON old = region GROUP BY ALL)"""


def _hierarchy(t):
    k, n = F.col("s_suppkey"), t.supplier.count()
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("country", "subregion", "cultural_region", "historical_region", "continent")]), (F.when(k % 10 == 0, 0).when(k % 10 == 9, 4).otherwise(k % 3 + 1) + 1).cast("int"))
    regions = t.supplier.select(k.alias("id"), F.col("s_name").alias("name"), kinds.alias("kind"), (k % 9 == 4).alias("special"))
    edges = t.lineitem.where("l_quantity > 49").groupBy(F.col("l_suppkey").alias("child"), (F.col("l_partkey") % n).alias("parent")).agg(F.max("l_discount").alias("confidence"))
    members = t.lineitem.where("l_suppkey % 4 = 1 and l_quantity < 3").groupBy(F.col("l_suppkey").alias("region"), F.col("l_partkey").alias("node")).agg(F.max("l_tax").alias("confidence"), F.when(F.max("l_returnflag") == "A", "accepted").otherwise("candidate").alias("status"))
    own = lambda when, *c: t.supplier.where(when).select(*c)
    cities = own("s_suppkey % 20 = 3", F.col("s_name").alias("name"), F.lit("city").alias("kind"))
    required = own("s_suppkey % 13 = 5", k.alias("child"), (F.floor(k / 10) * 10).alias("parent"))
    titles = own("s_suppkey % 11 = 2", k.alias("id"), F.concat(F.lit("Music of "), "s_name").alias("title"))
    merges = own("s_suppkey % 17 = 6", k.alias("old"), (k - 1).alias("new"))
    return R.hierarchy_pass(regions, edges, members, cities, required, titles, merges, own("s_suppkey % 7 = 3", k.alias("id")), ("Supplier#000000021",))


@query("g25_regions", _TREE + ", sn AS (SELECT region AS id FROM h2 UNION SELECT parent FROM e4 WHERE status = 'accepted') SELECT m2.id, kind, title, ma.new AS target, ma.new IS NULL AND m2.id IN (SELECT id FROM sn) AS visible FROM m2 LEFT JOIN ma ON ma.old = m2.id")
def g25b(t):
    return _hierarchy(t)[0]


@query("g25_edges", _TREE + " SELECT child, parent, confidence, status FROM e4")
def g25c(t):
    return _hierarchy(t)[1]


@query("g25_members", _TREE + " SELECT region, node, confidence, status FROM h2")
def g25d(t):
    return _hierarchy(t)[2]


@query("g26_alias_proxies", """WITH c AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN concat('Music of ', p_name) WHEN 1 THEN p_brand ELSE p_name END AS name, p_type AS kind FROM part), tg AS (SELECT lower(name) AS t, min(id) AS new FROM c WHERE kind IN ('ECONOMY', 'STANDARD', 'PROMO', 'SMALL') GROUP BY 1),
v AS (SELECT id, 'red ring' AS t FROM c WHERE lower(name) = 'brand#3' UNION SELECT id, lower(regexp_replace(regexp_replace(name, '(?i)^music of (?:the )?', ''), '(?i) music$', '')) FROM c WHERE name LIKE 'Music of %')
SELECT id AS old, min(new) AS new FROM v JOIN tg ON tg.t = v.t WHERE id <> new GROUP BY id""")  # fmt: skip
def g26(t):
    k = F.col("p_partkey")
    c = t.part.select(k.alias("id"), F.when(k % 3 == 0, F.concat(F.lit("Music of "), "p_name")).when(k % 3 == 1, F.col("p_brand")).otherwise(F.col("p_name")).alias("name"), F.col("p_type").alias("kind"))
    return R.alias_proxies(c, t.spark.createDataFrame([("Brand#3", "red ring")], "alias string, name string"), ("ECONOMY", "STANDARD", "PROMO", "SMALL"))


@query("g27_overlay", sql_with("nodes", "edges") + """, cu AS (SELECT DISTINCT concat('Supplier#', lpad(CAST(l_suppkey AS VARCHAR), 9, '0')) AS ft, CASE WHEN l_partkey % 11 = 0 THEN 'nobody' ELSE concat('NATION_', l_partkey % 30) END AS tt, 'child' AS relation FROM lineitem)
SELECT from_id, to_id, relation, source, ordinal FROM edges WHERE source <> 'manual_curation' UNION ALL SELECT from_id, to_id, 'subgenre', 'manual_curation', CAST(row_number() OVER (PARTITION BY from_id ORDER BY to_id) - 1 AS INTEGER) FROM (SELECT DISTINCT a.id AS from_id, b.id AS to_id FROM cu JOIN nodes a ON a.title = ft JOIN nodes b ON b.title = tt) q""")  # fmt: skip
def g27(t):
    cu = t.lineitem.select(F.concat(F.lit("Supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias("from_title"), F.when(F.col("l_partkey") % 11 == 0, "nobody").otherwise(F.concat(F.lit("NATION_"), F.col("l_partkey") % 30)).alias("to_title"), F.lit("child").alias("relation")).distinct()
    return R.overlay(t.edges, cu, t.nodes, names={"child": "subgenre"})[0]


@query("g28_edges_of", sql_with("edges") + " SELECT from_id, to_id, relation, source, ordinal, 'out' AS direction FROM edges WHERE from_id IN ('n:1', 'n:2', 's:3') AND (relation = 'subgenre' OR evidence_relation = 'subgenre' OR relation = 'regional_scene') AND relation <> 'regional_scene' UNION ALL SELECT from_id, to_id, relation, source, ordinal, 'in' FROM edges WHERE to_id IN ('n:1', 'n:2', 's:3') AND (relation = 'subgenre' OR evidence_relation = 'subgenre')")
def g28(t):
    ids = t.nodes.where("id in ('n:1', 'n:2', 's:3')").select("id")
    return E.edges_of(t.edges, ids, "both", "subgenre").select("from_id", "to_id", "relation", "source", "ordinal", "direction")


def _index(t):
    from edgeloom.plans.graphs import g2

    return g2(t)


@query("g29_reachable_parents", TREE + """, y AS (SELECT concat('s:', l_suppkey) AS id, CAST(min(year(l_shipdate)) AS INTEGER) AS year FROM lineitem GROUP BY 1)
SELECT e.to_id AS id, e.from_id AS parent_id, e.relation, e.source, e.ordinal, array_to_string(list_append(st.path_titles, n.title), ' / ') AS titles, y.year FROM shown e JOIN st ON st.id = e.from_id JOIN nodes n ON n.id = e.to_id LEFT JOIN y ON y.id = e.from_id WHERE st.depth = 3 AND NOT list_contains(st.path_ids, e.to_id)""")  # fmt: skip
def g29(t):
    y = t.lineitem.groupBy(F.concat(F.lit("s:"), "l_suppkey").alias("id")).agg(F.min(F.year("l_shipdate")).alias("year"))
    # only parents of depth 3 count, so no deeper states are worked out
    shown = cut(graphs.shown(t), "shown")
    top = G.reachability(graphs.roots(t), shown, t.nodes, 3)
    index = G.parent_index(top, shown, graphs.roots(t), t.nodes).where("depth = 4").withColumn("path", F.array_join("path_ids", ">"))
    return R.reachable_parents(index.drop("path_ids"), t.nodes, y).select("id", "parent_id", "relation", "source", "ordinal", "titles", "year")


@query("g30_regional_variants", """WITH b AS (SELECT p_partkey AS base FROM part WHERE p_partkey % 4 = 0), a AS (SELECT p_partkey AS base, p_partkey + p_size AS variant, p_brand AS region, p_size % 3 AS rank, 0 AS k FROM part UNION ALL SELECT p_partkey, p_partkey + p_size, p_type, p_size % 2, 1 FROM part UNION ALL SELECT p_partkey, p_partkey + 1, p_name, 0, 2 FROM part),
r AS (SELECT *, min(rank) OVER (PARTITION BY base, variant) AS m FROM a WHERE base IN (SELECT base FROM b) AND base <> variant) SELECT base, variant, region, ['title', 'link', 'inferred'][k + 1] AS origin FROM (SELECT *, row_number() OVER (PARTITION BY base, variant ORDER BY k, region) AS rn FROM r WHERE rank = m) q WHERE rn = 1""")  # fmt: skip
def g30(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    rows = lambda v, c, r: t.part.select(k.alias("base"), v.alias("variant"), F.col(c).alias("region"), r.alias("rank"))
    return R.regional_variants(t.part.where("p_partkey % 4 = 0").select(k.alias("base")), rows(k + s, "p_brand", s % 3), rows(k + s, "p_type", s % 2), rows(k + 1, "p_name", F.lit(0)))


@query("g31_map_context", """WITH it AS (SELECT concat('i', s_suppkey) AS item, CASE WHEN s_suppkey % 3 = 0 THEN concat('r:', s_suppkey % 5) ELSE concat('n:', s_nationkey) END AS region, round(s_acctbal, 0) AS score FROM supplier),
sp AS (SELECT concat('r:', n_regionkey) AS region, concat('n:', n_nationkey) AS f FROM nation UNION SELECT concat('n:', n_nationkey), concat('n:', n_nationkey) FROM nation), j AS (SELECT f, item, max(score) AS score FROM it JOIN sp USING (region) GROUP BY ALL)
SELECT f AS feature, max_by(item, struct_pack(s := score, i := -CAST(substr(item, 2) AS BIGINT))) AS item, string_agg(item, ',' ORDER BY item) AS represents FROM j GROUP BY f""")  # fmt: skip
def g31(t):
    k = F.col("s_suppkey")
    it = t.supplier.select(F.concat(F.lit("i"), k).alias("item"), F.when(k % 3 == 0, F.concat(F.lit("r:"), k % 5)).otherwise(F.concat(F.lit("n:"), "s_nationkey")).alias("region"), F.round("s_acctbal", 0).alias("score"))
    kinds = t.nodes.select("id", F.when(F.col("kind") == "nation", "country").otherwise("other").alias("kind"))
    return R.map_context(it, t.edges.where("from_id like 'r:%'"), kinds)


_ITEMS = """it AS (SELECT concat('i', s_suppkey) AS item, CASE s_suppkey % 3 WHEN 0 THEN concat('r:', s_suppkey % 5) WHEN 1 THEN concat('n:', s_nationkey) ELSE concat('s:', s_suppkey) END AS region, round(s_acctbal, 0) AS score FROM supplier),
an AS (SELECT it.*, CASE WHEN region LIKE 'n:%' THEN region WHEN region LIKE 's:%' THEN concat('n:', s.s_nationkey) END AS country FROM it LEFT JOIN supplier s ON concat('s:', s.s_suppkey) = region), ag AS (SELECT an.*, concat('r:', n_regionkey) AS grp FROM an LEFT JOIN nation ON concat('n:', n_nationkey) = country)"""


def _annotated(t):
    k = F.col("s_suppkey")
    region = F.when(k % 3 == 0, F.concat(F.lit("r:"), k % 5)).when(k % 3 == 1, F.concat(F.lit("n:"), "s_nationkey")).otherwise(F.concat(F.lit("s:"), k))
    it = t.supplier.select(F.concat(F.lit("i"), k).alias("item"), region.alias("region"), F.round("s_acctbal", 0).alias("score"))
    kind = F.when(F.col("kind") == "nation", "country").when(F.col("kind") == "region", "continent").when(F.col("kind") == "supplier", "cultural").otherwise("part")
    return R.annotated_items(it, t.edges.where("to_id not like 'p:%'"), t.nodes.select("id", kind.alias("kind")))


@query("g31_annotated", f"WITH {_ITEMS} SELECT item, region, score, country, CASE WHEN country IS NOT NULL THEN grp END AS grp FROM ag")
def g31b(t):
    return _annotated(t)[0].withColumnRenamed("group", "grp")


@query("g31_lists", f"WITH {_ITEMS} SELECT country, CAST(row_number() OVER (PARTITION BY country ORDER BY score DESC, item) - 1 AS INTEGER) AS place, item FROM ag WHERE country IS NOT NULL")
def g31c(t):
    return _annotated(t)[1]


@query("g32_scoped_nodes", sql_with("nodes", "edges") + """, tr AS (SELECT 'r:2' AS id, 0 AS depth UNION SELECT to_id, 1 FROM edges WHERE from_id = 'r:2' UNION SELECT b.to_id, 2 FROM edges a JOIN edges b ON b.from_id = a.to_id WHERE a.from_id = 'r:2'), o AS (SELECT id, 0 AS hop, depth, id AS region FROM tr WHERE id LIKE 's:%'),
k AS (SELECT * FROM o UNION ALL SELECT DISTINCT e.to_id, 1, o.depth, o.region FROM o JOIN edges e ON e.from_id = o.id) SELECT id, CAST(hop AS INTEGER) AS hop, region FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hop, depth, region) AS rn FROM k) q WHERE rn = 1""")  # fmt: skip
def g32(t):
    promoted = t.nodes.where("kind = 'supplier'").select(F.col("id").alias("container"), "id")
    return R.scoped_nodes(t.nodes.where("id = 'r:2'").select("id"), t.edges.where("to_id not like 'p:%'"), promoted, t.edges)


@query("g33_best_paths", TREE + """, ix AS (SELECT e.to_id AS id, e.from_id AS parent_id, e.relation, e.source, e.ordinal, st.depth + 1 AS depth, st.title AS parent_title, list_append(st.path_ids, e.to_id) AS p FROM shown e JOIN st ON st.id = e.from_id WHERE st.depth < 16 AND NOT list_contains(st.path_ids, e.to_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN regexp_matches(lower(parent_title), '3|nation_1') THEN 0 ELSE 1 END, depth, parent_title, array_to_string(p, '>'), relation, source, ordinal) AS rn FROM ix WHERE list_contains(p, 'r:1'))
SELECT id, parent_id, CAST(depth AS INTEGER) AS depth, array_to_string(p, '>') AS path FROM rk WHERE rn = 1""")  # fmt: skip
def g33(t):
    i = _index(t).where("depth > 1").join(t.nodes.select(F.col("id").alias("parent_id"), F.col("title").alias("parent_title")), "parent_id")
    return R.best_paths(i, ("3", "nation_1"), "r:1").select("id", "parent_id", "depth", "path")


# --- ownership and evidence ---------------------------------------------------------------------------------------------

OWN = "SELECT p_partkey AS id, p_brand AS region, CASE p_size % 3 WHEN 0 THEN 'category' WHEN 1 THEN 'list' ELSE 'prose' END AS source_type, CASE WHEN p_size % 5 = 0 THEN 'Genres by country' WHEN p_size % 5 = 1 THEN '' ELSE 'Styles' END AS section, CASE WHEN p_partkey % 4 = 0 THEN concat(p_name, ' of ', p_brand) ELSE p_name END AS title, CASE WHEN p_partkey % 7 = 0 THEN 'It originated there.' ELSE 'Plain.' END AS summary FROM part"


def own(t):
    t.part.createOrReplaceTempView("bound_part")
    return t.spark.sql(OWN.replace("FROM part", "FROM bound_part"))


@query("t9_ownership_rules", f"""SELECT id, region, CASE WHEN source_type = 'category' AND section LIKE '%by country' THEN 'rejected' WHEN contains(lower(title), lower(region)) OR (source_type = 'list' AND section <> '') OR summary LIKE '%originat%' THEN 'owned' WHEN source_type = 'prose' THEN 'associated' ELSE 'needs_review' END AS status FROM ({OWN}) q""")
def t9(t):
    return C.ruled(own(t), C.OWNERSHIP).select("id", "region", "status")


@query("t10_ownership_majority", f"""SELECT id, region, s AS status, CASE WHEN s = 'variant' THEN id + 1 END AS target FROM (SELECT *, CASE WHEN source_type = 'category' AND section LIKE '%by country' THEN 'rejected' WHEN contains(lower(title), lower(region)) OR id % 6 = 1 THEN 'owned' WHEN id % 9 = 0 THEN 'variant' WHEN source_type = 'prose' THEN 'staged' ELSE 'needs_review' END AS s FROM ({OWN}) q) r""")
def t10(t):
    o = own(t)
    return C.classify_ownership(o, o.select("id", "region", (F.col("id") % 6 == 1).alias("majority")), o.where("id % 9 = 0").select("id", "region", (F.col("id") + 1).alias("variant")))


@query("t10_variants", f"""WITH c AS (SELECT *, CASE WHEN source_type = 'category' AND section LIKE '%by country' THEN 'rejected' WHEN contains(lower(title), lower(region)) OR id % 6 = 1 THEN 'owned' WHEN id % 9 = 0 THEN 'variant' WHEN source_type = 'prose' THEN 'staged' ELSE 'needs_review' END AS s FROM ({OWN}) q),
m AS (SELECT p_brand AS region, p_partkey AS node, CAST(0.5 AS DOUBLE) AS confidence FROM part WHERE p_size > 25 UNION ALL SELECT region, id + 1, round(0.4 + id % 7 / 10.0, 2)::DOUBLE FROM c WHERE s = 'variant')
SELECT 'member' AS kind, CAST(node AS VARCHAR) AS key, region, max(confidence) AS confidence FROM m GROUP BY region, node UNION ALL SELECT 'staged', concat('variant:', id, ':', region), region, NULL FROM c WHERE s = 'staged'""")  # fmt: skip
def t10b(t):
    o = own(t)
    classified = C.classify_ownership(o, o.select("id", "region", (F.col("id") % 6 == 1).alias("majority")), o.where("id % 9 = 0").select("id", "region", (F.col("id") + 1).alias("variant")))
    mentions = o.select("id", "region", F.round(0.4 + F.col("id") % 7 / 10.0, 2).alias("confidence"), F.col("title").alias("name"))
    stored = t.part.where("p_size > 25").select(F.col("p_brand").alias("region"), F.col("p_partkey").alias("node"), F.lit(0.5).alias("confidence"))
    members, staged = C.variant_changes(classified, mentions, stored)
    return members.select(F.lit("member").alias("kind"), F.col("node").cast("string").alias("key"), "region", "confidence").union(staged.select(F.lit("staged"), "candidate", "region", F.lit(None).cast("double")))


@query("t11_resolve_variants", """WITH n AS (SELECT concat('p:', p_partkey) AS id, concat(p_name, ' ', p_size) AS title, lower(concat(p_name, ' ', p_size)) AS k FROM part), s AS (SELECT p_partkey AS candidate, concat('p:', p_partkey) AS base, CASE p_partkey % 3 WHEN 0 THEN concat(p_name, '-', p_size % 7) WHEN 1 THEN concat('Old ', p_name, ' ', p_size) ELSE 'other' END AS name FROM part),
j AS (SELECT s.*, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS k FROM s), m AS (SELECT k, min(id) AS node FROM n GROUP BY k)
SELECT candidate, base, CASE WHEN m.node IS NOT NULL AND m.node <> base THEN 'resolved' WHEN ends_with(j.k, n.k) THEN 'rejected' ELSE 'staged' END AS status, CASE WHEN m.node IS NOT NULL AND m.node <> base THEN m.node END AS node FROM j LEFT JOIN m ON m.k = j.k JOIN n ON n.id = base""")  # fmt: skip
def t11(t):
    k = F.col("p_partkey")
    n = t.part.select(F.concat(F.lit("p:"), k).alias("id"), F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("title"))
    name = F.when(k % 3 == 0, F.concat("p_name", F.lit("-"), F.col("p_size") % 7)).when(k % 3 == 1, F.concat(F.lit("Old "), "p_name", F.lit(" "), "p_size")).otherwise("other")
    return C.resolve_variants(t.part.select(k.alias("candidate"), F.concat(F.lit("p:"), k).alias("base"), name.alias("name")), n)


_PART_TEXTS = "SELECT p_partkey AS id, concat(CASE WHEN p_size % 3 = 0 THEN 'It emerged in NATION_' ELSE 'Known in NATION_' END, p_partkey % 25, ' and Old Land ', CASE WHEN p_size % 2 = 0 THEN p_partkey % 25 ELSE p_size % 25 END, '.') AS content, concat(p_name, ' of nation-', p_size % 30) AS title, concat('Category: Old Land ', (p_partkey + p_size) % 40) AS category, concat('origin nation ', p_size) AS origin FROM part"
_WORDS = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


def _hint(source: str, column: str, score: float, sure: float) -> str:
    return f"SELECT id, country, '{source}' AS source, {score}::DOUBLE AS score, {sure}::DOUBLE AS confidence, concat('{source.split('_')[0]} names ', country) AS evidence FROM (SELECT DISTINCT id, country FROM tx JOIN al ON contains(concat(' ', {_WORDS.format(column)}, ' '), concat(' ', alias, ' '))) q"


_AFFINITY = f"""WITH al AS (SELECT n_nationkey AS country, {_WORDS.format("n_name")} AS alias FROM nation UNION ALL SELECT n_nationkey, concat('old land ', n_nationkey) FROM nation), tx AS ({_PART_TEXTS}),
ev AS (SELECT l_partkey AS id, CAST(s_nationkey AS BIGINT) AS country, 'accepted_region_relationship' AS source, 0.94::DOUBLE AS score, greatest(0.72, least(1.0, l_discount * 9)) AS confidence, concat('o', l_orderkey) AS evidence FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity > 47
UNION ALL SELECT l_partkey, s_nationkey, 'country_music_page_child', 0.9, 0.82, concat('c', l_orderkey) FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity < 3
UNION ALL {_hint("title_region_hint", "title", 0.78, 0.74)} UNION ALL {_hint("category_region_hint", "category", 0.66, 0.62)} UNION ALL {_hint("origin_region_hint", "origin", 0.72, 0.7)}
UNION ALL SELECT id, country, 'wikipedia_content_mention', CASE WHEN content LIKE '%emerged%' THEN 0.62 ELSE 0.54 END, CASE WHEN content LIKE '%emerged%' THEN 0.58 ELSE 0.5 END, concat('content names ', country) FROM (SELECT id, country, any_value(content) AS content FROM tx JOIN al ON contains(concat(' ', {_WORDS.format("content")}, ' '), concat(' ', alias, ' ')) GROUP BY id, country HAVING count(DISTINCT alias) >= 2) q)"""


def _evidence(t):
    t.part.createOrReplaceTempView("bound_part")
    tx = t.spark.sql(_PART_TEXTS.replace("FROM part", "FROM bound_part"))
    sold = t.lineitem.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("country")), "l_suppkey")
    of = lambda df, mark: df.select(F.col("l_partkey").alias("id"), "country", (F.col("l_discount") * 9).alias("confidence"), F.concat(F.lit(mark), "l_orderkey").alias("evidence"))
    key = F.col("n_nationkey").cast("long").alias("country")
    aliases = t.nation.select(key, F.col("n_name").alias("alias")).union(t.nation.select(key, F.concat(F.lit("Old Land "), "n_nationkey")))
    texts = lambda c: tx.select("id", F.col(c).alias("text"))
    return C.country_evidence(aliases, of(sold.where("l_quantity > 47"), "o"), of(sold.where("l_quantity < 3"), "c"), texts("title"), texts("category"), texts("origin"), texts("content"))


@query("t12_evidence", _AFFINITY + " SELECT id, country, source, score, round(confidence, 6) AS confidence, evidence FROM ev")
def t12b(t):
    return _evidence(t).withColumn("confidence", F.round("confidence", 6))


@query("t12_affinities", _AFFINITY + """, s AS (SELECT id, country, max(score) AS score, max(confidence) AS confidence, count(DISTINCT source) AS n, bool_and(source = 'wikipedia_content_mention') AS lone FROM ev GROUP BY ALL),
h AS (SELECT id, country, least(1.0, score + CASE WHEN n > 1 THEN 0.08 ELSE 0 END) AS score, least(1.0, confidence + CASE WHEN n > 1 THEN 0.06 ELSE 0 END) AS confidence, n AS n_sources, lone AS needs_review FROM s)
SELECT id, country, round(score, 6) AS score, round(confidence, 6) AS confidence, n_sources, needs_review FROM h WHERE score >= 0.55 AND confidence >= 0.5""")  # fmt: skip
def t12(t):
    return C.affinities(_evidence(t)).select("id", "country", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"), "n_sources", "needs_review")


# --- curation -----------------------------------------------------------------------------------------------------------


@query("q1_approval", """WITH n AS (SELECT p_partkey AS id, p_size % 2 = 0 AS approved, CASE WHEN p_size % 10 = 0 THEN 'manual keep' WHEN p_size % 2 = 0 THEN 'pages' END AS note FROM part), c AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'pages' WHEN id IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48) THEN 'claims' END AS f, id % 11 = 0 AS x FROM n),
d AS (SELECT id, f IS NOT NULL AND NOT x AS a, CASE WHEN note LIKE 'manual%' THEN note WHEN x THEN 'forced' ELSE f END AS m, approved, note FROM c) SELECT id, a AS approved, m AS note FROM d WHERE a IS DISTINCT FROM approved OR m IS DISTINCT FROM note""")  # fmt: skip
def q1(t):
    n = t.part.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 2 == 0).alias("approved"), F.when(F.col("p_size") % 10 == 0, "manual keep").when(F.col("p_size") % 2 == 0, "pages").alias("note"))
    return C.approve(n, {"pages": n.where("id % 3 = 0"), "claims": t.lineitem.where("l_quantity > 48").select(F.col("l_partkey").alias("id"))}, n.where("id % 11 = 0"))


REL = """SELECT p_partkey AS id, CASE WHEN p_size % 9 = 0 THEN 'Cities by size' WHEN p_size % 9 = 1 THEN 'Nordic' ELSE p_name END AS child, CASE WHEN p_size % 8 = 0 THEN p_name WHEN p_size % 8 = 1 THEN 'Sweden' ELSE p_brand END AS parent, CASE p_partkey % 5 WHEN 0 THEN 'part_of' WHEN 1 THEN 'admin_parent' WHEN 2 THEN 'historical_region_of' WHEN 3 THEN 'cultural_region_of' ELSE 'diaspora_region_of' END AS relation,
CASE p_partkey % 7 WHEN 0 THEN 'wikipedia_list' WHEN 1 THEN 'manual' WHEN 2 THEN 'wikipedia_article' ELSE 'wikipedia_category' END AS source_type, p_size % 2 = 0 AS has_context, p_size % 3 = 0 AS has_alias, p_size % 8 = 1 AS parent_is_country, CASE p_partkey % 11 WHEN 0 THEN 'music by city' WHEN 1 THEN 'category:music in x' WHEN 2 THEN 'medieval music' WHEN 3 THEN 'celtic music' WHEN 4 THEN 'african diaspora' ELSE 'other' END AS source_title FROM part"""


@query("q2_relation_review", f"""SELECT id, s[1] AS status, s[2] AS reason FROM (SELECT id, CASE WHEN child LIKE '% by %' THEN ['needs_review', 'container name'] WHEN source_type = 'wikipedia_list' AND has_context THEN CASE WHEN relation = 'part_of' THEN ['accepted', 'row context'] ELSE ['needs_review', 'unexpected relation of a list'] END
WHEN source_type = 'manual' AND has_alias THEN CASE WHEN relation = 'part_of' THEN ['accepted', 'regional alias'] ELSE ['needs_review', 'unexpected relation of an alias'] END WHEN source_type <> 'wikipedia_category' THEN ['needs_review', 'not category-backed'] WHEN child = parent THEN ['rejected', 'self edge']
WHEN relation = 'admin_parent' THEN CASE WHEN source_title IN ('music by city', 'category:music in x') THEN ['accepted', 'administrative category'] ELSE ['needs_review', 'no administrative evidence'] END WHEN relation = 'part_of' THEN ['accepted', 'direct containment']
WHEN relation = 'cultural_region_of' AND child = 'Nordic' AND parent_is_country THEN ['rejected', 'points from the broader region'] WHEN relation = 'cultural_region_of' AND source_title = 'celtic music' THEN ['accepted', 'cultural category'] WHEN relation = 'diaspora_region_of' AND source_title = 'african diaspora' THEN ['accepted', 'diaspora category']
WHEN relation = 'historical_region_of' AND source_title = 'medieval music' THEN ['accepted', 'historical category'] ELSE ['needs_review', 'parallel relation'] END AS s FROM ({REL}) q) r""")  # fmt: skip
def q2(t):
    t.part.createOrReplaceTempView("bound_part")
    return C.ruled(t.spark.sql(REL.replace("FROM part", "FROM bound_part")), C.RELATION_RULES).select("id", "status", "reason")


MEM = """SELECT p_partkey AS id, CASE WHEN p_size % 13 = 0 THEN 'Islands by name' ELSE p_brand END AS region, CASE WHEN p_size % 11 = 0 THEN 'List of songs' WHEN p_size % 11 = 1 THEN 'Category:Songs' ELSE p_name END AS title, CASE p_partkey % 3 WHEN 0 THEN 'regional_scene' WHEN 1 THEN 'local_scene' ELSE 'other' END AS relation,
CASE p_partkey % 5 WHEN 0 THEN 'wikipedia_category' WHEN 1 THEN 'wikipedia_list' WHEN 2 THEN 'manual' ELSE 'wikipedia_article' END AS source_type, CASE p_partkey % 6 WHEN 0 THEN 'See also' WHEN 1 THEN 'Further reading' WHEN 2 THEN p_name WHEN 3 THEN 'Folk dance' ELSE '' END AS section, CASE p_partkey % 7 WHEN 0 THEN 'music of x' WHEN 1 THEN 'list of music genres' WHEN 2 THEN 'music in y' ELSE 'z' END AS source_title, CASE WHEN p_size % 10 = 0 THEN 'deterministic-region-page-links-v2' ELSE 'other' END AS model FROM part"""


@query("q2_member_review", f"""SELECT id, s[1] AS status, s[2] AS reason FROM (SELECT id, CASE WHEN region LIKE '% by %' THEN ['rejected', 'container as region'] WHEN title IN ('List of songs', 'Category:Songs') THEN ['rejected', 'artifact as member'] WHEN source_type = 'wikipedia_category' THEN ['accepted', 'category membership'] WHEN source_type = 'wikipedia_list' AND section = 'See also' THEN ['needs_review', 'generic list section'] WHEN source_type = 'wikipedia_list' AND relation <> 'other' THEN ['accepted', 'list section']
WHEN source_type = 'wikipedia_article' AND section IN ('See also', 'Further reading') THEN ['needs_review', 'generic article section'] WHEN source_type = 'wikipedia_article' AND model <> 'other' THEN ['accepted', 'filtered link'] WHEN source_type = 'wikipedia_article' AND source_title IN ('music of x', 'music in y') AND section = title THEN ['accepted', 'section heading'] WHEN source_type = 'wikipedia_article' AND source_title IN ('music of x', 'music in y') AND section = 'Folk dance' THEN ['accepted', 'section of the page']
WHEN source_title = 'list of music genres' THEN ['accepted', 'regional list'] ELSE ['needs_review', 'no rule'] END AS s FROM ({MEM}) q) r""")  # fmt: skip
def q2b(t):
    t.part.createOrReplaceTempView("bound_part")
    return C.ruled(t.spark.sql(MEM.replace("FROM part", "FROM bound_part")), C.MEMBER_RULES).select("id", "status", "reason")


_CANDIDATES = """SELECT p_partkey AS id, CASE p_partkey % 12 WHEN 0 THEN concat('Category:Music of ', p_name) WHEN 1 THEN concat('Music in ', p_name, ' County') WHEN 2 THEN concat(p_name, ' award') WHEN 3 THEN 'Music by city' WHEN 4 THEN concat('Ancient ', p_name) WHEN 5 THEN concat(p_name, ' folk music') WHEN 6 THEN concat('Music history of ', p_name)
WHEN 7 THEN concat(p_name, ' (1850-1900)') WHEN 8 THEN 'Music of the Caribbean' WHEN 9 THEN concat('Indigenous ', p_name, ' music') WHEN 10 THEN concat(p_name, ' library') ELSE concat(p_name, ' music') END AS title, CASE p_size % 5 WHEN 0 THEN 'Category:Music by country' WHEN 1 THEN 'Styles of music' WHEN 2 THEN 'Music by city' WHEN 3 THEN 'X by state' END AS source_title,
['music_region_page', 'music_region_category', 'region_container_category', 'regional_music_list', 'cultural_region_page', 'regional_genre_page', 'unknown_music_candidate', 'other'][1 + p_partkey % 8] AS candidate_type, p_size / 50.0::DOUBLE AS confidence, CASE p_size % 4 WHEN 1 THEN concat('Land of ', p_name) WHEN 2 THEN '' END AS suggested_name FROM part"""
_TRIAGED = f"""WITH c AS ({_CANDIDATES}), b AS (SELECT *, p AS t, CASE source_title WHEN 'Category:Music by country' THEN 'music by country' ELSE lower(coalesce(source_title, '')) END AS s, id % 12 AS k FROM (SELECT *, regexp_replace(lower(title), '^category:', '') AS p FROM c) q),
n AS (SELECT *, coalesce(nullif(suggested_name, ''), CASE WHEN k IN (0, 1) THEN regexp_replace(t, '^music (of|in) ', '') WHEN k = 8 THEN 'caribbean' END) AS region, CASE WHEN k = 1 THEN CASE WHEN s LIKE '%by city%' THEN 'city' ELSE 'subregion' END WHEN k = 4 THEN 'historical_region' WHEN k = 9 THEN 'cultural_region' WHEN s LIKE '%by country%' THEN 'country' WHEN s LIKE '%by state%' OR k = 8 THEN 'subregion' ELSE 'unknown' END AS kd FROM b)"""


def _candidates(t):
    k, name = F.col("p_partkey"), F.col("p_name")
    cat = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    titles = [cat("Category:Music of ", name), cat("Music in ", name, " County"), cat(name, " award"), F.lit("Music by city"), cat("Ancient ", name), cat(name, " folk music"), cat("Music history of ", name), cat(name, " (1850-1900)"), F.lit("Music of the Caribbean"), cat("Indigenous ", name, " music"), cat(name, " library"), cat(name, " music")]
    title = F.element_at(F.array(*titles), (k % 12 + 1).cast("int"))
    source = F.element_at(F.array(*[F.lit(x) for x in ("Category:Music by country", "Styles of music", "Music by city", "X by state", None)]), (F.col("p_size") % 5 + 1).cast("int"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("music_region_page", "music_region_category", "region_container_category", "regional_music_list", "cultural_region_page", "regional_genre_page", "unknown_music_candidate", "other")]), (k % 8 + 1).cast("int"))
    return t.part.select(k.alias("id"), title.alias("title"), source.alias("source_title"), kind.alias("candidate_type"), (F.col("p_size") / 50.0).alias("confidence"), F.when(F.col("p_size") % 4 == 1, cat("Land of ", name)).when(F.col("p_size") % 4 == 2, "").alias("suggested_name"))


@query("q3_triage", _TRIAGED + """, x AS (SELECT *, id % 8 AS o, CASE WHEN k = 2 THEN ['reject', 'unknown', '0.96'] WHEN k = 3 THEN ['needs_review', 'unknown', '0.6'] WHEN id % 8 IN (0, 1) THEN ['accept', kd, '0.88'] WHEN id % 8 = 2 THEN ['needs_review', 'unknown', '0.72'] WHEN id % 8 = 3 THEN ['accept', 'unknown', '0.82'] WHEN id % 8 = 4 THEN ['needs_review', kd, '0.7']
WHEN id % 8 = 5 THEN CASE WHEN k IN (4, 5, 9) OR s = 'styles of music' THEN ['accept', kd, '0.74'] ELSE ['needs_review', kd, '0.58'] END WHEN id % 8 = 6 AND (k = 6 OR ((k IN (5, 9, 11)) AND s IN ('styles of music', 'music by city'))) THEN ['needs_review', kd, '0.62'] ELSE ['needs_review', kd, '0.5'] END AS r FROM n)
SELECT id, r[1] AS status, region, r[2] AS kind, CASE WHEN r[1] = 'reject' THEN 0.96 ELSE greatest(confidence, CAST(r[3] AS DOUBLE)) END::DOUBLE AS sure FROM x""")  # fmt: skip
def q3(t):
    return T.triage(_candidates(t)).select("id", "status", "region", "kind", "sure")


@query("q3_final", _TRIAGED + """, x AS (SELECT *, CASE WHEN k IN (2, 10) THEN ['reject', 'unknown', '0.9'] WHEN k = 7 THEN ['reject', 'unknown', '0.82'] WHEN id % 8 = 2 THEN ['accept', kd, '0.78'] WHEN id % 8 = 1 THEN ['accept', kd, '0.82'] WHEN id % 8 = 4 THEN ['accept', kd, '0.76'] WHEN id % 8 = 6 THEN ['accept', CASE WHEN k = 6 THEN 'historical_region' ELSE kd END, '0.7'] ELSE ['accept', kd, '0.72'] END AS r FROM n)
SELECT id, r[1] AS status, region, r[2] AS kind, greatest(confidence, CAST(r[3] AS DOUBLE)) AS sure FROM x""")  # fmt: skip
def q3b(t):
    return T.triage(_candidates(t), final=True).select("id", "status", "region", "kind", "sure")


_AUDIT = """, kp AS (SELECT * FROM staged_edges WHERE status = 'accepted'), ow AS (SELECT * FROM staged_members WHERE relation <> 'regional_style_mention'), ce AS (SELECT DISTINCT child AS f, parent AS t FROM kp WHERE relation IN ('part_of', 'admin_parent')),
w AS (SELECT [f, t] AS path FROM ce WHERE f <> t UNION ALL SELECT list_append(path, e.t) FROM w JOIN ce e ON e.f = path[-1] WHERE len(path) < 6 AND NOT list_contains(path, e.t) AND e.t > path[1]),
cy AS (SELECT DISTINCT CAST(len(path) AS INTEGER) AS length, array_to_string(path, '>') AS cycle FROM w JOIN ce e ON e.f = path[-1] AND e.t = path[1] WHERE list_min(path) = path[1])"""


def _promotion(t):
    return C.promotion_audit(t.staged_regions, t.staged_edges, t.staged_members)


@query("q4_promotion_audit", sql_with("staged_edges", "staged_regions", "staged_members", recursive=True) + _AUDIT + """, m AS (SELECT 'region_accepted' AS metric, count(*) FILTER (WHERE status = 'accepted') AS value FROM staged_edges UNION ALL SELECT 'region_rejected', count(*) FILTER (WHERE status = 'rejected') FROM staged_edges UNION ALL SELECT 'region_pending', count(*) FILTER (WHERE status = 'proposed') FROM staged_edges
UNION ALL SELECT 'member_accepted', count(*) FILTER (WHERE status = 'accepted') FROM ow UNION ALL SELECT 'member_rejected', count(*) FILTER (WHERE status = 'rejected') FROM ow UNION ALL SELECT 'member_pending', count(*) FILTER (WHERE status = 'proposed') FROM ow UNION ALL SELECT 'artifact_members', count(*) FROM ow WHERE status = 'accepted' AND title LIKE 'List of %' UNION ALL SELECT 'cycles', count(*) FROM cy
UNION ALL SELECT 'container_edges', count(*) FROM kp WHERE child LIKE '%:1F' OR parent LIKE '%:1F' UNION ALL SELECT 'broad_members', count(*) FROM ow WHERE status = 'accepted' AND region LIKE '%:2F' UNION ALL SELECT 'duplicate_members', count(*) FROM (SELECT 1 FROM ow WHERE status = 'accepted' GROUP BY region, node, relation HAVING count(*) > 1) q)
SELECT metric, value, (SELECT sum(value) FROM m WHERE metric IN ('region_pending', 'member_pending', 'cycles', 'container_edges', 'artifact_members')) = 0 AS ready FROM m""")  # fmt: skip
def q4(t):
    return _promotion(t)[0]


@query("q4_samples", sql_with("staged_edges", "staged_regions", "staged_members", recursive=True) + _AUDIT + """, s1 AS (SELECT 'cycle' AS kind, cycle AS what FROM cy ORDER BY length, cycle LIMIT 25), s2 AS (SELECT 'accepted' AS kind, concat(name, ' > ', relation, ' > ', title) AS what FROM ow JOIN staged_regions r ON r.id = region WHERE status = 'accepted' ORDER BY confidence DESC, name, title, relation LIMIT 25)
SELECT * FROM s1 UNION ALL SELECT * FROM s2 WHERE (SELECT count(*) FROM s1) = 0""")  # fmt: skip
def q4b(t):
    return _promotion(t)[1]


_READY = """, rg AS (SELECT id, name, CASE WHEN id LIKE '%F' THEN concat('Music of ', name) WHEN id LIKE '%O' THEN concat(name, ' music') ELSE 'List of x' END AS title, CASE WHEN id LIKE '%:3_' THEN 'city' ELSE 'subregion' END AS kind, views > 1 OR id LIKE '%:3_' AS promoted, CASE WHEN id LIKE '%:4P' THEN 'reviewed_empty' WHEN id LIKE '%:5P' THEN 'collapsed' END AS state FROM staged_regions),
ow AS (SELECT * FROM staged_members WHERE relation <> 'regional_style_mention'), ac AS (SELECT * FROM ow WHERE status = 'accepted'), pm AS (SELECT * FROM rg WHERE promoted), kp AS (SELECT id AS region, ['zero_child', 'parentless', 'broad'][1 + length(id) % 3] AS review FROM staged_regions WHERE id LIKE '%:3F' OR id LIKE '%:2F'), cd AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'discovered' ELSE 'done' END AS status FROM orders)"""


@query("q5_readiness_audit", sql_with("staged_regions", "staged_members", "staged_edges") + _READY + """, st AS (SELECT 'open_members' AS metric, count(*) AS value FROM ow WHERE status = 'needs_review' UNION ALL SELECT 'open_candidates', count(*) FROM cd WHERE status = 'discovered' UNION ALL SELECT 'childless_cities', count(*) FROM pm WHERE kind = 'city' AND coalesce(state, '') <> 'reviewed_empty' AND id NOT IN (SELECT region FROM ac) AND id NOT IN (SELECT region FROM kp WHERE review = 'zero_child')
UNION ALL SELECT 'parentless', count(*) FROM pm WHERE coalesce(state, '') <> 'collapsed' AND lower(name) <> 'asia' AND id NOT IN (SELECT child FROM staged_edges WHERE status = 'accepted') AND id NOT IN (SELECT region FROM kp WHERE review = 'parentless') UNION ALL SELECT 'invalid_titles', count(*) FROM pm WHERE coalesce(state, '') <> 'collapsed' AND title LIKE 'List of %'
UNION ALL SELECT 'duplicates', count(*) FROM (SELECT 1 FROM ac GROUP BY region, node, relation HAVING count(*) > 1) q UNION ALL SELECT 'broad_members', count(*) FROM ac WHERE region LIKE '%:2F' AND region NOT IN (SELECT region FROM kp WHERE review = 'broad')),
tl AS (SELECT 'regions' AS metric, count(*) AS value FROM rg UNION ALL SELECT 'promoted', count(*) FROM pm UNION ALL SELECT 'edges', count(*) FROM staged_edges UNION ALL SELECT 'members', count(*) FROM staged_members UNION ALL SELECT 'candidates', count(*) FROM cd UNION ALL SELECT 'sources', count(*) FROM supplier UNION ALL SELECT 'accepted_edges', count(*) FROM staged_edges WHERE status = 'accepted' UNION ALL SELECT 'accepted_members', count(*) FROM ac UNION ALL SELECT 'style_proxies', CAST(0 AS BIGINT))
SELECT metric, value, (SELECT sum(value) FROM st) = 0 AS ready FROM (SELECT * FROM st UNION ALL SELECT * FROM tl) q""")  # fmt: skip
def q5(t):
    r = t.staged_regions
    title = F.when(F.col("id").like("%F"), F.concat(F.lit("Music of "), "name")).when(F.col("id").like("%O"), F.concat("name", F.lit(" music"))).otherwise("List of x")
    regions = r.select("id", "name", title.alias("title"), F.when(F.col("id").like("%:3_"), "city").otherwise("subregion").alias("kind"), ((F.col("views") > 1) | F.col("id").like("%:3_")).alias("promoted"), F.when(F.col("id").like("%:4P"), "reviewed_empty").when(F.col("id").like("%:5P"), "collapsed").alias("state"))
    review = F.element_at(F.array(F.lit("zero_child"), F.lit("parentless"), F.lit("broad")), F.length("id") % 3 + 1)
    kept = r.where("id like '%:3F' or id like '%:2F'").select(F.col("id").alias("region"), review.alias("review"))
    candidates = t.orders.select(F.when(F.col("o_orderstatus") == "F", "discovered").otherwise("done").alias("status"))
    return C.readiness_audit(regions, t.staged_edges, t.staged_members, candidates, t.supplier, kept)


@query("q6_coverage", sql_with("nodes", "edges") + """, c AS (SELECT id, id IN (SELECT to_id FROM edges WHERE source = 'wikidata') AS d, id IN (SELECT to_id FROM edges WHERE source = 'infobox') AS p FROM nodes) SELECT CASE WHEN d AND p THEN 'both' WHEN d THEN 'direct' WHEN p THEN 'page' ELSE 'none' END AS covered, count(*) AS n FROM c GROUP BY 1""")
def q6(t):
    by = lambda s: t.edges.where(F.col("source") == s).select(F.col("to_id").alias("id"))
    return C.coverage(t.nodes.select("id"), by("wikidata"), by("infobox"))


def _covered(t):
    inferred = t.staged_members.where("status = 'proposed'").select(F.col("relation").alias("kind"))
    return C.coverage_counts(t.staged_regions.select(F.col("id").alias("region"), "name", "views"), t.staged_members, inferred)


_GOOD = ", g AS (SELECT DISTINCT region FROM staged_members WHERE status = 'accepted'), wo AS (SELECT * FROM staged_regions WHERE id NOT IN (SELECT region FROM g))"


@query("q6_counts", sql_with("staged_regions", "staged_members") + _GOOD + """ SELECT 'promoted' AS metric, count(*) AS value FROM staged_regions UNION ALL SELECT 'with_direct', count(*) FROM staged_regions WHERE id IN (SELECT region FROM g) UNION ALL SELECT 'without_direct', count(*) FROM wo UNION ALL SELECT 'with_article', count(*) FROM staged_regions WHERE id IN (SELECT region FROM staged_members WHERE status = 'accepted' AND source_type = 'wikipedia_article')
UNION ALL SELECT 'accepted', count(*) FILTER (WHERE status = 'accepted') FROM staged_members UNION ALL SELECT 'article', count(*) FILTER (WHERE status = 'accepted' AND source_type = 'wikipedia_article') FROM staged_members UNION ALL SELECT 'pending', count(*) FILTER (WHERE status = 'proposed') FROM staged_members UNION ALL SELECT 'rejected', count(*) FILTER (WHERE status = 'rejected') FROM staged_members
UNION ALL SELECT concat('inferred:', relation), count(*) FROM staged_members WHERE status = 'proposed' GROUP BY relation""")  # fmt: skip
def q6b(t):
    return _covered(t)[0]


@query("q6_uncovered", sql_with("staged_regions", "staged_members") + _GOOD + " SELECT id AS region, name FROM wo ORDER BY views DESC, name, id LIMIT 25")
def q6c(t):
    return _covered(t)[1]


_DECIDED = """WITH r AS (SELECT s_suppkey AS id, s_name AS name FROM supplier), d AS (SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN 'keep' WHEN 1 THEN 'anchor' WHEN 2 THEN 'move' WHEN 3 THEN 'rename' WHEN 4 THEN 'collapse' ELSE 'demote' END AS decision, CASE WHEN s_suppkey % 4 = 0 THEN 'nobody' ELSE concat('supplier#', lpad(CAST(s_suppkey // 2 AS VARCHAR), 9, '0')) END AS tn, CASE WHEN s_suppkey % 9 = 0 THEN concat('Supplier#', lpad('1', 9, '0')) ELSE concat('New ', s_suppkey) END AS nn FROM supplier WHERE s_suppkey % 5 <> 0),
x AS (SELECT d.*, t.id AS target, decision = 'rename' AND EXISTS (SELECT 1 FROM r o WHERE lower(o.name) = lower(nn) AND o.id <> d.id) AS clash FROM d LEFT JOIN r t ON lower(t.name) = tn), s AS (SELECT *, CASE WHEN (decision IN ('anchor', 'move') AND target IS NULL) OR clash THEN 'needs_human' WHEN decision = 'collapse' THEN 'collapsed' WHEN decision = 'keep' THEN 'kept' ELSE 'done' END AS st FROM x)"""  # fmt: skip


def _decided(t):
    k = F.col("s_suppkey")
    r = t.supplier.select(k.alias("id"), F.col("s_name").alias("name"), F.lit("open").alias("status"))
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("keep", "anchor", "move", "rename", "collapse", "demote")]), (k % 6 + 1).cast("int"))
    pad = lambda c: F.lpad(c.cast("string"), 9, "0")
    d = t.supplier.where("s_suppkey % 5 <> 0").select(k.alias("id"), kinds.alias("decision"), F.when(k % 4 == 0, "nobody").otherwise(F.concat(F.lit("supplier#"), pad(F.floor(k / 2)))).alias("target_name"), F.when(k % 9 == 0, F.concat(F.lit("Supplier#"), pad(F.lit(1)))).otherwise(F.concat(F.lit("New "), k)).alias("new_name"))
    e = t.supplier.select(k.alias("child"), F.floor(k / 3).alias("parent"))
    m = t.lineitem.select(F.col("l_suppkey").alias("region"), F.col("l_partkey").alias("node"), F.lit("accepted").alias("status")).distinct()
    return C.apply_decisions(d, r, e, m)


@query("q7_decisions", _DECIDED + " SELECT r.id, CASE WHEN decision = 'rename' AND st = 'done' THEN nn ELSE name END AS name, coalesce(st, 'open') AS status FROM r LEFT JOIN s ON s.id = r.id")
def q7(t):
    return _decided(t)[0]


@query("q7_edges", _DECIDED + """, e AS (SELECT s_suppkey AS child, s_suppkey // 3 AS parent FROM supplier), c AS (SELECT id, target FROM s WHERE decision = 'collapse' AND target IS NOT NULL), f AS (SELECT child, coalesce(target, parent) AS parent FROM e LEFT JOIN c ON c.id = parent UNION SELECT id, target FROM s WHERE decision = 'anchor' AND target IS NOT NULL AND target <> id)
SELECT DISTINCT child, parent FROM f WHERE child <> parent""")  # fmt: skip
def q7b(t):
    return _decided(t)[1]


@query("q7_members", _DECIDED + """, m AS (SELECT DISTINCT l_suppkey AS region, l_partkey AS node FROM lineitem) SELECT DISTINCT coalesce(c.target, region) AS region, node, CASE WHEN w.id IS NOT NULL THEN 'candidate' ELSE 'accepted' END AS status FROM m LEFT JOIN (SELECT id, target FROM s WHERE decision IN ('move', 'collapse') AND target IS NOT NULL) c ON c.id = region LEFT JOIN (SELECT id FROM s WHERE decision = 'demote') w ON w.id = region""")
def q7c(t):
    return _decided(t)[2]


_MEMBER_DECISIONS = """WITH m AS (SELECT l_suppkey AS region, l_partkey AS node, CASE max(l_returnflag) WHEN 'R' THEN 'candidate' ELSE 'accepted' END AS status FROM lineitem WHERE l_quantity <= 40 GROUP BY ALL), d AS (SELECT DISTINCT l_suppkey AS region, l_partkey AS node, CASE (l_suppkey + l_partkey) % 3 WHEN 0 THEN 'extract' WHEN 1 THEN 'move' ELSE 'demote' END AS decision FROM lineitem WHERE l_quantity > 40),
tg AS (SELECT region, node, unnest([region // 2, CASE WHEN node % 4 = 0 THEN -1 ELSE region // 5 END]) AS target FROM d WHERE decision = 'move' AND node % 8 <> 0), mv AS (SELECT DISTINCT region, node, target FROM tg WHERE target IN (SELECT s_suppkey FROM supplier)), o AS (SELECT d.*, CASE WHEN decision = 'move' AND NOT EXISTS (SELECT 1 FROM mv WHERE mv.region = d.region AND mv.node = d.node) THEN 'needs_human' ELSE 'done' END AS outcome FROM d)"""


def _member_decisions(t):
    m = t.lineitem.where("l_quantity <= 40").groupBy(F.col("l_suppkey").alias("region"), F.col("l_partkey").alias("node")).agg(F.when(F.max("l_returnflag") == "R", "candidate").otherwise("accepted").alias("status"))
    k = (F.col("l_suppkey") + F.col("l_partkey")) % 3
    name = lambda c: F.concat(F.lit("SUPPLIER#"), F.lpad(c.cast("string"), 9, "0"))
    other = F.when(F.col("l_partkey") % 4 == 0, "nobody").otherwise(name(F.floor(F.col("l_suppkey") / 5)))
    targets = F.when(F.col("l_partkey") % 8 != 0, F.array(name(F.floor(F.col("l_suppkey") / 2)), other)).otherwise(F.array(F.lit("nobody")))
    d = t.lineitem.where("l_quantity > 40").select(F.col("l_suppkey").alias("region"), F.col("l_partkey").alias("node"), F.when(k == 0, "extract").when(k == 1, "move").otherwise("demote").alias("decision"), targets.alias("target_names")).distinct()
    return C.apply_member_decisions(d, t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), m)


@query("q7_member_decisions", _MEMBER_DECISIONS + """, a AS (SELECT m.region, m.node, CASE WHEN o.decision = 'extract' THEN 'accepted' WHEN o.outcome = 'done' THEN 'candidate' ELSE m.status END AS status FROM m LEFT JOIN o ON o.region = m.region AND o.node = m.node UNION ALL SELECT region, node, 'accepted' FROM o WHERE decision = 'extract' UNION ALL SELECT target, node, 'accepted' FROM mv)
SELECT region, node, min(status) AS status FROM a GROUP BY ALL""")  # fmt: skip
def q7d(t):
    return _member_decisions(t)[0]


@query("q7_outcomes", _MEMBER_DECISIONS + " SELECT region, node, decision, outcome FROM o")
def q7e(t):
    return _member_decisions(t)[1]


_CLEANED = """WITH r AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 = 0 THEN 'rejected' WHEN s_suppkey % 5 = 0 THEN 'collapsed' ELSE 'open' END AS status FROM supplier), m AS (SELECT l_suppkey AS region, l_partkey AS node, max(l_discount) AS confidence FROM lineitem GROUP BY ALL), li AS (SELECT l_suppkey AS region, l_partkey AS node, bool_or(l_returnflag = 'A') AS accepted FROM lineitem WHERE l_quantity > 48 GROUP BY ALL),
j AS (SELECT m.*, status <> 'open' AS gone, accepted, status <> 'open' OR coalesce(NOT accepted, FALSE) AS ou FROM m JOIN r ON r.id = m.region LEFT JOIN li ON li.region = m.region AND li.node = m.node), k AS (SELECT *, row_number() OVER (PARTITION BY node, ou ORDER BY coalesce(accepted, FALSE) DESC, confidence DESC, region) AS rn FROM j)"""


def _cleaned(t):
    k = F.col("s_suppkey")
    r = t.supplier.select(k.alias("id"), F.concat(F.lit("Music in "), "s_name").alias("title"), F.when(k % 5 == 0, "collapsed").otherwise("open").alias("status"), F.lit("sub").alias("kind"))
    o = t.supplier.where("s_suppkey % 7 = 0").select(k.alias("id"), F.lit("rejected").alias("status"), F.lit("city").alias("kind"))
    m = t.lineitem.groupBy(F.col("l_suppkey").alias("region"), F.col("l_partkey").alias("node")).agg(F.max("l_discount").alias("confidence"))
    listed = t.lineitem.where("l_quantity > 48").groupBy(F.col("l_suppkey").alias("region"), F.col("l_partkey").alias("node")).agg(F.bool_or(F.col("l_returnflag") == "A").alias("accepted"))
    return C.cleanup(r, m, o, listed=listed, cities=t.supplier.where("s_nationkey = 3").select(k.alias("id")))


@query("q8_cleanup", _CLEANED + " SELECT region, node, CASE WHEN gone OR NOT coalesce(accepted, TRUE) OR rn > 1 THEN 'rejected' ELSE 'accepted' END AS status, CASE WHEN gone THEN 'hidden region' WHEN NOT coalesce(accepted, TRUE) THEN 'listed' WHEN rn > 1 THEN 'better owner' END AS reason FROM k")
def q8(t):
    return _cleaned(t)[1]


@query("q8_regions", _CLEANED + " SELECT id, concat('Music of ', s_name) AS title, status, CASE WHEN id % 7 = 0 THEN 'city' ELSE 'sub' END AS kind, status = 'open' AND s_nationkey <> 3 AS visible FROM r JOIN supplier ON s_suppkey = id")
def q8b(t):
    return _cleaned(t)[0]


@query("q8_parents", sql_with("staged_edges") + """, b AS (SELECT child, parent FROM staged_edges WHERE relation = 'cultural_region_of'), n AS (SELECT DISTINCT parent AS child, child AS parent, 'part_of' AS need FROM staged_edges WHERE status = 'proposed')
SELECT coalesce(e.child, n.child) AS child, coalesce(e.parent, n.parent) AS parent, coalesce(relation, need) AS relation, CASE WHEN need IS NOT NULL THEN 'accepted' WHEN b.child IS NOT NULL THEN 'rejected' ELSE status END AS status FROM staged_edges e FULL JOIN n ON n.child = e.child AND n.parent = e.parent LEFT JOIN b ON b.child = e.child AND b.parent = e.parent""")  # fmt: skip
def q8c(t):
    e = t.staged_edges
    required = e.where("status = 'proposed'").select(F.col("parent").alias("child"), F.col("child").alias("parent"), F.lit("part_of").alias("relation"))
    return C.fix_parents(e, e.where("relation = 'cultural_region_of'").select("child", "parent"), required)


@query("q9_review_queue", "SELECT p_partkey AS id, p_size FROM part WHERE p_size > 30 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) ORDER BY p_size DESC, p_partkey LIMIT 30")
def q9(t):
    rows = t.part.withColumn("id", F.col("p_partkey"))
    return C.review_queue(rows, t.lineitem.where("l_quantity > 49").select(F.col("l_partkey").alias("id")), F.col("p_size") > 30, [F.desc("p_size"), "id"], 30).select("id", "p_size")


@query("q10_violations", """SELECT CAST(event_id AS VARCHAR) AS key, c AS "check" FROM (SELECT event_id, CASE WHEN value < 5 OR value > 90 THEN 'range' END AS c FROM events UNION ALL SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view', 'purchase', 'signup') THEN 'enum' END FROM events UNION ALL SELECT event_id, CASE WHEN length(props) < 9 THEN 'short' END FROM events) q WHERE c IS NOT NULL""")
def q10(t):
    from edgeloom.sources.readers import violations

    return violations(t.events, "event_id", {"range": F.col("value").between(5, 90), "enum": F.col("event_type").isin("click", "view", "purchase", "signup"), "short": F.length("props") >= 9})


@query("q11_orphan_lineage", sql_with("nodes", "edges") + """ SELECT from_id AS id, count(DISTINCT to_id) AS parents_of, count(*) FILTER (WHERE source = 'infobox') AS infobox, count(*) FILTER (WHERE source <> 'infobox') AS other FROM (SELECT to_id AS from_id, from_id AS to_id, source FROM edges) e WHERE from_id IN (SELECT id FROM nodes WHERE length(title) % 3 = 0) GROUP BY 1""")
def q11(t):
    return C.orphan_lineage(t.nodes.where("length(title) % 3 = 0"), G.reversed_edges(t.edges))


@query("q12_inventory", sql_with("nodes", "edges") + """ SELECT from_id AS parent, count(*) AS children, count(*) FILTER (WHERE length(title) % 2 = 0) AS shown, count(*) FILTER (WHERE length(title) % 2 <> 0) AS hidden FROM (SELECT DISTINCT from_id, to_id FROM edges) e JOIN nodes ON id = to_id GROUP BY 1""")
def q12(t):
    return C.inventory(t.nodes, t.edges, F.length("title") % 2 == 0)

"""Queries: graph operators (G)."""

from pyspark.sql import functions as F

from edgeloom.functions import text
from edgeloom.operators import edges as E
from edgeloom.operators import graph as G
from edgeloom.operators import reach
from edgeloom.operators.rank import global_rank
from edgeloom.operators.staging import cut
from edgeloom.plans.bindings import sql_with
from edgeloom.plans.registry import query

SHOWN = """shown AS (SELECT from_id, to_id, CASE WHEN relation <> 'related' THEN relation WHEN evidence_relation = 'stylistic_origin_of' THEN 'origin_parent' ELSE evidence_relation END AS relation, source, ordinal FROM edges WHERE relation <> 'related' OR evidence_relation IS NOT NULL)"""
WALK = """, w AS (SELECT id, title, id AS root_id, title AS root_title, 1 AS depth, [id] AS path_ids, [title] AS path_titles FROM nodes WHERE kind = 'region'
UNION ALL SELECT n.id, n.title, w.root_id, w.root_title, w.depth + 1, list_append(w.path_ids, n.id), list_append(w.path_titles, n.title) FROM w JOIN (SELECT DISTINCT from_id, to_id FROM shown) e ON e.from_id = w.id JOIN nodes n ON n.id = e.to_id WHERE NOT list_contains(w.path_ids, n.id) AND w.depth < 16),
st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY depth, lower(root_title), lower(title), path_titles, path_ids) AS rn FROM w) q WHERE rn = 1)"""
TREE = sql_with("nodes", "edges", recursive=True) + ",\n" + SHOWN + WALK


def shown(t):
    return E.display_edges(t.edges).select("from_id", "to_id", F.col("effective").alias("relation"), "source", "ordinal")


def roots(t):
    return t.nodes.where("kind = 'region'").select("id")


def states(t):
    return G.reachability(roots(t), shown(t), t.nodes)


@query("g1_reachability", TREE + " SELECT id, title, root_id, root_title, CAST(depth AS INTEGER) AS depth, array_to_string(path_ids, '>') AS path FROM st")
def g1(t):
    return states(t).select("id", "title", "root_id", "root_title", "depth", F.array_join("path_ids", ">").alias("path"))


@query("g2_parent_index", TREE + """ SELECT e.to_id AS id, e.from_id AS parent_id, e.relation, e.source, e.ordinal, st.root_id, CAST(st.depth AS INTEGER) AS parent_depth, CAST(st.depth + 1 AS INTEGER) AS depth, array_to_string(list_append(st.path_ids, e.to_id), '>') AS path FROM shown e JOIN st ON st.id = e.from_id WHERE st.depth < 16 AND NOT list_contains(st.path_ids, e.to_id)
UNION ALL SELECT id, 'root', 'root', 'root', 0, root_id, 0, 1, array_to_string(path_ids, '>') FROM st WHERE id LIKE 'r:%'""")  # fmt: skip
def g2(t):
    p = G.parent_index(states(t), shown(t), roots(t), t.nodes)
    return p.select("id", "parent_id", "relation", "source", "ordinal", "root_id", "parent_depth", "depth", F.array_join("path_ids", ">").alias("path"))


@query("g1_skipped", TREE + """ SELECT count(*) FILTER (WHERE depth < 3 AND list_contains(path_ids, to_id)) AS cycle, count(*) FILTER (WHERE depth >= 3) AS depth FROM (SELECT from_id, to_id FROM shown UNION ALL SELECT to_id, from_id FROM shown) e JOIN st ON st.id = e.from_id WHERE st.depth <= 3""")
def g1b(t):
    """Edges both ways, so that some lead back into a path; nodes as far as depth 3."""
    e = shown(t).select("from_id", "to_id")
    return G.skipped(states(t).where("depth <= 3"), e.union(e.select("to_id", "from_id")), 3)


@query("g3_orphans", TREE + " SELECT id, title, views FROM nodes WHERE id NOT IN (SELECT id FROM st) ORDER BY views DESC NULLS LAST, lower(title), id LIMIT 50")
def g3(t):
    return G.orphans(t.nodes, states(t)).limit(50).select("id", "title", "views")


def _near_sql(edges: str, seeds: str, hops: int) -> str:
    return f", h AS (SELECT id AS seed, id, 0 AS depth FROM ({seeds}) s UNION SELECT h.seed, e.to_id, h.depth + 1 FROM h JOIN (SELECT DISTINCT from_id, to_id FROM {edges}) e ON e.from_id = h.id WHERE h.depth < {hops}) SELECT seed, id, CAST(min(depth) AS INTEGER) AS depth FROM h GROUP BY seed, id HAVING min(depth) > 0"


SEEDS = "SELECT from_id AS id FROM succ GROUP BY from_id HAVING count(*) > 1"


@query("g4_neighbourhood", sql_with("succ", recursive=True) + _near_sql("succ", SEEDS, 3))
def g4(t):
    return G.neighbourhood(t.succ, t.succ.groupBy("from_id").count().where("count > 1").select(F.col("from_id").alias("id")), 3)


@query("g5_shortcuts", sql_with("succ", recursive=True) + """, c AS (SELECT from_id, to_id FROM succ), h AS (SELECT DISTINCT from_id AS s, to_id AS id, 1 AS depth FROM succ WHERE from_id IN (SELECT from_id FROM c)
UNION SELECT h.s, e.to_id, h.depth + 1 FROM h JOIN succ e ON e.from_id = h.id WHERE h.depth < 8 AND e.to_id <> h.s) SELECT from_id, to_id FROM c WHERE EXISTS (SELECT 1 FROM h WHERE h.s = c.from_id AND h.id = c.to_id AND h.depth >= 2)""")  # fmt: skip
def g5(t):
    return G.shortcuts(t.succ, t.succ, 8)


DISPLAY = "('subgenre', 'derivative', 'fusion_genre', 'regional_scene')"
OPPOSING = f"""s AS (SELECT *, CASE WHEN source = 'manual_curation' THEN -1 WHEN evidence_relation = 'summary_taxonomy' THEN 90 WHEN source = 'inbound_index' AND (CASE WHEN relation = 'related' THEN coalesce(evidence_relation IN {DISPLAY}, FALSE) ELSE relation IN {DISPLAY} END) THEN 70 WHEN source = 'wikidata' THEN 62 WHEN source = 'infobox' THEN 55 ELSE 50 END AS s FROM succ_edges),
p AS (SELECT *, row_number() OVER (PARTITION BY least(from_id, to_id), greatest(from_id, to_id) ORDER BY s, from_id, relation, source, ordinal) AS rn FROM s x WHERE EXISTS (SELECT 1 FROM s y WHERE y.from_id = x.to_id AND y.to_id = x.from_id))"""


@query("g6_opposing_edges", sql_with("succ_edges") + f", {OPPOSING} SELECT from_id, to_id, relation, source, ordinal FROM p WHERE rn = 1 AND source <> 'manual_curation'")
def g6(t):
    return G.opposing(t.succ_edges, E.DISPLAY)


def _ids(t):
    return t.succ.select(F.col("from_id").alias("id")).union(t.succ.select("to_id")).distinct()


def _cycle_edges(t):
    customer = F.substring_index("id", ":", 2)
    starts = _ids(t).groupBy(customer.alias("c")).agg(F.min("id").alias("id")).select("id")
    return starts, G.cycle_edges(starts, t.succ_edges, _ids(t).withColumn("title", F.col("id")), E.DISPLAY)


CYCLES = f""", {OPPOSING}, ids AS (SELECT from_id AS id FROM succ UNION SELECT to_id FROM succ), hd AS (SELECT min(id) AS id, 0 AS depth FROM ids GROUP BY split_part(id, ':', 2) UNION SELECT e.to_id, depth + 1 FROM hd JOIN succ e ON e.from_id = hd.id WHERE depth < 20),
dp AS (SELECT id, min(depth) AS depth FROM hd GROUP BY id), f1 AS (SELECT from_id, to_id, relation, source, ordinal FROM p WHERE rn = 1 AND source <> 'manual_curation' AND from_id IN (SELECT id FROM dp)),
rs AS (SELECT from_id, to_id, relation, source, ordinal FROM succ_edges WHERE from_id IN (SELECT id FROM dp) EXCEPT SELECT * FROM f1), ex AS (SELECT a.from_id, a.to_id FROM rs a JOIN rs b ON b.from_id = a.to_id AND b.to_id = a.from_id WHERE b.source = 'manual_curation'),
hr AS (SELECT id AS seed, id AS node FROM dp UNION SELECT hr.seed, rs.to_id FROM hr JOIN rs ON rs.from_id = hr.node)
SELECT from_id, to_id, relation, source, ordinal, 'opposing' AS reason FROM f1 UNION ALL SELECT r.from_id, r.to_id, relation, source, ordinal, 'backward' FROM rs r JOIN dp x ON x.id = r.from_id JOIN dp y ON y.id = r.to_id JOIN hr ON hr.seed = r.to_id AND hr.node = r.from_id
WHERE source <> 'manual_curation' AND (y.depth, lower(y.id), y.id) <= (x.depth, lower(x.id), x.id) AND (r.from_id, r.to_id) NOT IN (SELECT (from_id, to_id) FROM ex)"""


@query("g6_cycle_edges", sql_with("succ", "succ_edges", recursive=True) + CYCLES)
def g6b(t):
    return _cycle_edges(t)[1]


@query("g6_acyclic", sql_with("succ", recursive=True) + """, s AS (SELECT min(id) AS id FROM (SELECT from_id AS id FROM succ UNION SELECT to_id FROM succ) q GROUP BY split_part(id, ':', 2)), h AS (SELECT id, id AS node FROM s UNION SELECT h.id, e.to_id FROM h JOIN succ e ON e.from_id = h.node)
SELECT count(DISTINCT node) AS reached, CAST(0 AS BIGINT) AS on_cycles FROM h""")  # fmt: skip
def g6c(t):
    """Of what the starts reach: the nodes, and those still on a cycle of edges that are neither ignored nor manual (none)."""
    starts, ignored = _cycle_edges(t)
    reached = G.depths(t.succ, starts).select("id")
    key = ["from_id", "to_id", "relation", "source", "ordinal"]
    manual = t.succ_edges.where("source = 'manual_curation'")
    beside = G.reversed_edges(manual).select("from_id", "to_id").distinct()
    left = t.succ_edges.where("source <> 'manual_curation'").join(ignored, key, "left_anti").join(beside, ["from_id", "to_id"], "left_anti")
    left = left.join(reached.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    back = reach.components(left).groupBy("scc").agg(F.count("*").alias("n")).where("n > 1")
    return reached.agg(F.count("*").alias("reached")).crossJoin(F.broadcast(back.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("on_cycles"))))


@query("g7_flag_cycles", sql_with("succ_edges") + f", {OPPOSING}, c AS (SELECT *, FALSE AS x FROM p WHERE rn = 1 AND source <> 'manual_curation') SELECT e.from_id, e.to_id, e.relation, e.source, e.ordinal, c.from_id IS NOT NULL OR e.to_id LIKE '%:4_' AS is_ignored, CASE WHEN c.from_id IS NOT NULL THEN 'cycle:opposing' WHEN e.to_id LIKE '%:4_' THEN 'hand' END AS ignored_reason FROM succ_edges e LEFT JOIN c ON c.from_id = e.from_id AND c.to_id = e.to_id AND c.relation = e.relation AND c.source = e.source")
def g7(t):
    own = F.when(F.col("to_id").like("%:4_"), "hand").when(F.col("from_id").like("%:4_"), "cycle:old")
    stored = t.succ_edges.withColumn("ignored_reason", own).withColumn("is_ignored", F.col("ignored_reason").isNotNull())
    return G.flag_edges(stored, G.opposing(t.succ_edges, E.DISPLAY).withColumn("reason", F.lit("opposing")), "cycle")


@query("g8_named_cycles", sql_with("succ", recursive=True) + """, w AS (SELECT [from_id, to_id] AS path FROM succ UNION ALL SELECT list_append(path, e.to_id) FROM w JOIN succ e ON e.from_id = path[-1] WHERE len(path) < 6 AND NOT list_contains(path, e.to_id) AND e.to_id > path[1])
SELECT CAST(len(path) AS INTEGER) AS length, array_to_string(path, '>') AS cycle FROM w JOIN succ e ON e.from_id = path[-1] AND e.to_id = path[1] WHERE list_min(path) = path[1]""")  # fmt: skip
def g8(t):
    return G.named_cycles(t.succ, 6)


@query("g9_closure", sql_with("succ", recursive=True) + ", h AS (SELECT from_id AS seed, from_id AS id FROM (SELECT DISTINCT from_id FROM succ) s UNION SELECT h.seed, e.to_id FROM h JOIN succ e ON e.from_id = h.id) SELECT seed, count(*) - 1 AS n, max(id) AS last FROM h WHERE seed <> id OR TRUE GROUP BY seed HAVING count(*) > 1")
def g9(t):
    """How much each node reaches and the greatest id of it: within a customer's piece, or from reach labels if a piece is large."""
    edges = cut(t.succ.select("from_id", "to_id"), "succ")
    all_ = reach.summary(edges, edges.select(F.col("from_id").alias("id")))
    return all_.where("n > 1").select("seed", (F.col("n") - 1).alias("n"), F.col("most").alias("last"))


#: The graph of all customers: a row of 1O nodes from customer to customer, a hub above the 5F nodes, and a ring of the 3O nodes.
LINKED = """, byc AS (SELECT split_part(id, ':', 3) AS p, CAST(split_part(id, ':', 2) AS BIGINT) AS c, id FROM (SELECT from_id AS id FROM succ UNION SELECT to_id FROM succ) q), nx AS (SELECT id, p, lead(id) OVER (PARTITION BY p ORDER BY c) AS b, first_value(id) OVER (PARTITION BY p ORDER BY c) AS a FROM byc WHERE p IN ('1O', '3O')),
linked AS (SELECT from_id, to_id FROM succ WHERE from_id LIKE '%F' UNION SELECT id, coalesce(b, CASE WHEN p = '3O' THEN a END) FROM nx WHERE b IS NOT NULL OR p = '3O' UNION SELECT 'hub', id FROM byc WHERE p = '5F')"""


def _linked(t):
    ids = t.succ.select(F.col("from_id").alias("id")).union(t.succ.select("to_id")).distinct().select("id", F.split_part("id", F.lit(":"), F.lit(3)).alias("p"), F.split_part("id", F.lit(":"), F.lit(2)).cast("long").alias("c"))
    rows = global_rank(ids.where("p in ('1O', '3O')"), [F.asc("p"), F.asc("c")]).select("p", "id", "rank")
    after = rows.select("p", (F.col("rank") - 1).alias("rank"), F.col("id").alias("b"))
    start = rows.groupBy("p").agg(F.min_by("id", "rank").alias("a"))
    steps = rows.join(after, ["p", "rank"], "left").join(F.broadcast(start), "p").select("id", F.coalesce("b", F.when(F.col("p") == "3O", F.col("a"))).alias("to_id")).where("to_id is not null")
    return t.succ.where("from_id like '%F'").select("from_id", "to_id").union(steps).union(ids.where("p = '5F'").select(F.lit("hub"), "id")).distinct()


REACHED = ", h AS (SELECT from_id AS seed, from_id AS id FROM (SELECT from_id FROM linked UNION SELECT to_id FROM linked) s UNION SELECT h.seed, e.to_id FROM h JOIN linked e ON e.from_id = h.id)"


@query("g9_linked_reach", sql_with("succ", recursive=True) + LINKED + REACHED + " SELECT seed, count(*) AS n, min(id) AS least, max(id) AS most FROM h GROUP BY seed")
def g9b(t):
    """Rows of customers, a hub and a large ring: how much each node reaches, itself included."""
    e = _linked(t)
    return reach.reach_summary(reach.reach_index(e), e.select(F.col("from_id").alias("id")).union(e.select("to_id")))


@query("g6_components", sql_with("succ", recursive=True) + LINKED + REACHED + " SELECT a.seed AS id, min(a.id) AS least, count(*) AS n FROM h a JOIN h b ON b.seed = a.id AND b.id = a.seed GROUP BY a.seed")
def g6d(t):
    """The strongly connected component of each node of that graph: its least node and its size."""
    of = reach.components(_linked(t))
    return of.join(of.groupBy("scc").agg(F.min("id").alias("least"), F.count("*").alias("n")), "scc").select("id", "least", "n")


@query("g10_nearest_typed", sql_with("nodes", "edges", recursive=True) + """, h AS (SELECT id AS seed, id, 0 AS depth FROM nodes WHERE kind = 'part' UNION SELECT h.seed, e.from_id, h.depth + 1 FROM h JOIN (SELECT DISTINCT from_id, to_id FROM edges) e ON e.to_id = h.id WHERE h.depth < 8),
k AS (SELECT seed, h.id, kind, min(depth) AS depth FROM h JOIN nodes n ON n.id = h.id WHERE kind IN ('nation', 'region') AND depth > 0 GROUP BY ALL) SELECT seed, id, kind, CAST(depth AS INTEGER) AS depth FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, kind, id) AS rn FROM k) q WHERE rn = 1""")  # fmt: skip
def g10(t):
    return G.nearest_typed(G.reversed_edges(t.edges), t.nodes.where("kind = 'part'").select("id"), t.nodes, {"nation": 0, "region": 1})


UP = """, h AS (SELECT id AS seed, id, 0 AS depth FROM nodes WHERE kind = 'supplier' UNION SELECT h.seed, e.from_id, h.depth + 1 FROM h JOIN (SELECT DISTINCT from_id, to_id FROM edges) e ON e.to_id = h.id WHERE h.depth < 8),
k AS (SELECT seed, h.id, kind, CAST(min(depth) AS INTEGER) AS depth FROM h JOIN nodes n ON n.id = h.id WHERE kind IN ('nation', 'region') AND depth > 0 GROUP BY ALL)"""


@query("g10_group", sql_with("nodes", "edges", recursive=True) + UP + " SELECT seed, id, kind, depth FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY CASE kind WHEN 'region' THEN 0 ELSE 1 END, depth, id) AS rn FROM k) q WHERE rn = 1")
def g10b(t):
    return G.best_typed(G.reversed_edges(t.edges), t.nodes.where("kind = 'supplier'").select("id"), t.nodes, {"region": 0, "nation": 1})


@query("g10_descendants", sql_with("nodes", "edges", recursive=True) + """, h AS (SELECT id AS seed, id, 0 AS depth FROM nodes WHERE kind = 'region' UNION SELECT h.seed, e.to_id, h.depth + 1 FROM h JOIN (SELECT DISTINCT from_id, to_id FROM edges) e ON e.from_id = h.id WHERE h.depth < 8)
SELECT seed, h.id, kind, CAST(min(depth) AS INTEGER) AS depth FROM h JOIN nodes n ON n.id = h.id WHERE kind IN ('nation', 'supplier') GROUP BY ALL""")  # fmt: skip
def g10c(t):
    return G.typed_reach(t.edges, t.nodes.where("kind = 'region'").select("id"), t.nodes, ("nation", "supplier"))


FLOWS = """fe AS (SELECT from_id, to_id, relation, CASE source WHEN 'inbound_index' THEN 'unlisted' WHEN 'manual_curation' THEN 'gpt_review' ELSE source END AS source, ordinal % 17 = 5 AS block_forward, ordinal % 13 = 2 AS block_reverse FROM shown),
sw AS (SELECT * FROM (VALUES ('gpt_review', 1.18::DOUBLE), ('manual_curation', 1.1), ('infobox', 1.0), ('wikidata', 0.9)) v(source, sw)), rw AS (SELECT * FROM (VALUES ('subgenre', 1.0::DOUBLE, 0.34::DOUBLE), ('derivative', 0.76, 0.28), ('fusion_genre', 0.68, 0.26), ('regional_scene', 0.58, 0.82)) v(relation, f, b)),
fl AS MATERIALIZED (SELECT from_id AS src, to_id AS dst, f * coalesce(sw, 0.82) AS w FROM fe LEFT JOIN sw USING (source) JOIN rw USING (relation) WHERE NOT block_forward UNION ALL SELECT to_id, from_id, b * coalesce(sw, 0.82) FROM fe LEFT JOIN sw USING (source) JOIN rw USING (relation) WHERE NOT block_reverse),
f AS MATERIALIZED (SELECT src, dst, sum(w) AS w FROM fl WHERE dst NOT LIKE 'r:%' GROUP BY ALL), pin AS (SELECT id, id AS root, 1.0::DOUBLE AS value FROM nodes WHERE kind = 'region')"""


def _rounds(n: int) -> str:
    out, last = FLOWS, "pin"
    for k in range(n):
        out += f""",\nm{k} AS MATERIALIZED (SELECT id, root, sum(value) AS value FROM (SELECT dst AS id, root, value * w AS value FROM {last} v JOIN f ON f.src = v.id UNION ALL SELECT id, root, 0.05 * value FROM {last} WHERE id NOT LIKE 'r:%') q GROUP BY ALL),
v{k} AS MATERIALIZED (SELECT * FROM pin UNION ALL SELECT id, root, value / sum(value) OVER (PARTITION BY id) FROM m{k})"""  # fmt: skip
        last = f"v{k}"
    return out


def _flows(t):
    source = F.when(F.col("source") == "inbound_index", "unlisted").when(F.col("source") == "manual_curation", "gpt_review").otherwise(F.col("source"))
    return cut(G.flow_edges(shown(t).withColumns({"source": source, "block_forward": F.col("ordinal") % 17 == 5, "block_reverse": F.col("ordinal") % 13 == 2})), "flows")


def _affinity(t, flows, rounds=30):
    return G.affinity(t.nodes, roots(t), flows, rounds)


@query("g11_affinity", sql_with("nodes", "edges") + f",\n{SHOWN},\n{_rounds(30)}\nSELECT id, root, round(value, 6) AS value FROM v29")
def g11(t):
    return _affinity(t, _flows(t)).select("id", "root", F.round("value", 6).alias("value"))


@query("g12_floor_confidence", sql_with("nodes", "edges") + f",\n{SHOWN},\n{_rounds(30)}" + """,
dr AS (SELECT dst AS id, src AS root, sum(w) AS w FROM fl WHERE src = 'r:1' AND dst NOT LIKE 'r:%' GROUP BY ALL), low AS (SELECT DISTINCT dr.id FROM dr LEFT JOIN v29 ON v29.id = dr.id AND v29.root = dr.root WHERE coalesce(v29.value, 0) < 0.5 AND dr.id IN (SELECT id FROM v29)),
fv AS (SELECT * FROM v29 WHERE id NOT IN (SELECT id FROM low) UNION ALL SELECT id, root, sum(value) FROM (SELECT id, root, value * 0.5 AS value FROM v29 WHERE id IN (SELECT id FROM low) UNION ALL SELECT id, root, 0.5 FROM dr WHERE id IN (SELECT id FROM low)) q GROUP BY ALL),
sup AS (SELECT dst AS id, sum(w) AS w FROM fl GROUP BY 1), tp AS (SELECT id, max(value) AS top FROM fv GROUP BY id)
SELECT tp.id, CAST(round(CASE WHEN kind = 'region' THEN 1.0 ELSE greatest(0, least(1, 0.14 + (1 - exp(-coalesce(w, 0) / 1.35)) * 0.56 + top * 0.14 + least(1, log10(coalesce(views, 0) + 1) / 6) * 0.16)) END, 4) AS DOUBLE) AS confidence FROM tp JOIN nodes USING (id) LEFT JOIN sup ON sup.id = tp.id""")  # fmt: skip
def g12(t):
    flows = _flows(t)
    direct = flows.where("src = 'r:1' and dst not like 'r:%'").select(F.col("dst").alias("id"), F.col("src").alias("root"), "w")
    v = G.root_floor(_affinity(t, flows), direct)
    palette = roots(t).withColumn("colour", F.concat(F.lit("#"), F.substring(F.md5(F.col("id").cast("binary")), 1, 6)))
    support = flows.groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("w"))
    return G.colours(v, palette, support, t.nodes.select("id", "views")).select("id", "confidence")


def _colour_sql() -> str:
    """Palette colours to OKLab, the mix of the four top roots, and back to #rrggbb."""
    dot = lambda row, names: "(" + " + ".join(f"({c}::DOUBLE) * {n}" for c, n in zip(row, names)) + ")"
    channels = ", ".join(f"CAST(concat('0x', substr(c, {2 + 2 * k}, 2)) AS INTEGER) / 255.0::DOUBLE AS x{k}" for k in range(3))
    linear = ", ".join(f"CASE WHEN x{k} <= 0.04045 THEN x{k} / 12.92 ELSE pow((x{k} + 0.055) / 1.055, 2.4) END AS y{k}" for k in range(3))
    roots = ", ".join(f"pow({dot(row, ('y0', 'y1', 'y2'))}, 1.0::DOUBLE / 3) AS m{k}" for k, row in enumerate(text.LMS))
    lab = ", ".join(f"{dot(row, ('m0', 'm1', 'm2'))} AS l{k}" for k, row in enumerate(text.LAB))
    cubes = ", ".join(f"pow(z0 + {dot(row, ('z1', 'z2'))}, 3) AS q{k}" for k, row in enumerate(text.UNLAB))
    rgb = ", ".join(f"{dot(row, ('q0', 'q1', 'q2'))} AS r{k}" for k, row in enumerate(text.UNLMS))
    hexes = ", ".join(f"format('{{:02x}}', CAST(floor(greatest(0.0, least(1.0, CASE WHEN r{k} <= 0.0031308 THEN 12.92 * r{k} ELSE 1.055 * pow(greatest(r{k}, 0.0), 1.0::DOUBLE / 2.4) - 0.055 END)) * 255 + 0.5) AS INTEGER))" for k in range(3))
    return f""",
p0 AS (SELECT id AS root, concat('#', substr(md5(id), 1, 6)) AS c FROM nodes WHERE kind = 'region'), p1 AS (SELECT root, {channels} FROM p0), p2 AS (SELECT root, {linear} FROM p1), p3 AS (SELECT root, {roots} FROM p2), pal AS MATERIALIZED (SELECT root, {lab} FROM p3),
t4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY value DESC, root) AS n FROM v29) q JOIN pal USING (root) WHERE n <= 4), mx AS (SELECT id, max(value) AS top, {", ".join(f"sum(value * l{k}) / sum(value) AS x{k}" for k in range(3))} FROM t4 GROUP BY id), sup AS (SELECT dst AS id, sum(w) AS w FROM fl GROUP BY 1),
cf AS (SELECT mx.*, CASE WHEN kind = 'region' THEN 1.0::DOUBLE ELSE greatest(0, least(1, 0.14 + (1 - exp(-coalesce(w, 0) / 1.35)) * 0.56 + top * 0.14 + least(1, log10(coalesce(views, 0) + 1) / 6) * 0.16)) END AS conf FROM mx JOIN nodes USING (id) LEFT JOIN sup ON sup.id = mx.id),
z AS (SELECT id, conf, greatest(0.56, least(0.74, x0)) AS z0, x1 * (0.52 + conf * 0.42) AS z1, x2 * (0.52 + conf * 0.42) AS z2 FROM cf), q AS (SELECT id, conf, {cubes} FROM z), r AS (SELECT id, conf, {rgb} FROM q)
SELECT id, CAST(round(conf, 4) AS DOUBLE) AS confidence, concat('#', {hexes}) AS colour FROM r"""


@query("g12_colours", sql_with("nodes", "edges") + f",\n{SHOWN},\n{_rounds(30)}" + _colour_sql())
def g12b(t):
    palette = roots(t).withColumn("colour", F.concat(F.lit("#"), F.substring(F.md5(F.col("id").cast("binary")), 1, 6)))
    flows = _flows(t)
    return G.colours(_affinity(t, flows), palette, flows.groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("w")), t.nodes.select("id", "views"))


STRONG = "(0.3 + 0.1 * least(n, 6))"


def _distances(depth: int) -> str:
    out = ", x0 AS MATERIALIZED (SELECT id AS seed, id, depth, s FROM d0)"
    for k in range(1, depth + 1):
        out += f""",
x{k} AS MATERIALIZED (SELECT * FROM x{k - 1} UNION ALL SELECT seed, u.b, {k}, max(x.s * u.s) FROM x{k - 1} x JOIN u ON u.a = x.id WHERE depth = {k - 1} AND NOT EXISTS (SELECT 1 FROM x{k - 1} v WHERE v.seed = x.seed AND v.id = u.b) GROUP BY seed, u.b)"""
    return out


@query("g13_distance_map", sql_with("together", recursive=True) + f""", u AS (SELECT a, b, CAST({STRONG} AS DOUBLE) AS s FROM together WHERE n > 1 UNION ALL SELECT b, a, CAST({STRONG} AS DOUBLE) FROM together WHERE n > 1),
d0 AS (SELECT 'g:1' AS id, 0 AS depth, 1.0::DOUBLE AS s UNION ALL SELECT 'g:2', 0, 1.0){_distances(4)}
SELECT seed, id, CAST(depth AS INTEGER) AS depth, round(s, 6) AS strength, round(greatest(0.18, s) / (1 + depth), 6) AS score FROM x4""")  # fmt: skip
def g13(t):
    e = t.together.where("n > 1").select("a", "b", (0.3 + 0.1 * F.least(F.col("n"), F.lit(6))).alias("strength"))
    seeds = t.spark.sql("SELECT 'g:1' AS id UNION ALL SELECT 'g:2'")
    return G.distance_map(e, seeds, 4).select("seed", "id", "depth", F.round("strength", 6).alias("strength"), "score")


def _walk_sql() -> str:
    """The focus walk around a nation, unrolled: four depths up (u) and down (d)."""
    out = """, ee AS (SELECT from_id, to_id, CASE relation WHEN 'subgenre' THEN 1 WHEN 'derivative' THEN 2 WHEN 'fusion_genre' THEN 3 ELSE 99 END AS k FROM edges),
dg AS (SELECT id, count(*) AS c, sum(w) AS w FROM (SELECT from_id AS id, 1.0::DOUBLE AS w FROM ee UNION ALL SELECT to_id, 0.35 FROM ee) q GROUP BY id),
nn AS MATERIALIZED (SELECT n.id, title, length(title) AS rk, coalesce(c, 0) AS c, round(log2(coalesce(w, 0) + 1) * 4.0 + log10(greatest(coalesce(views, 0), 0) + 10) * 1.2, 9) AS raw FROM nodes n LEFT JOIN dg ON dg.id = n.id)"""
    for side, at, to in (("u", "to_id", "from_id"), ("d", "from_id", "to_id")):
        out += f""",\n{side}0 AS MATERIALIZED (SELECT 'n:3' AS id, 0 AS depth)"""
        for k, keep in enumerate((12, 8, 4, 2), 1):
            out += f""",\n{side}{k} AS MATERIALIZED (SELECT * FROM {side}{k - 1} UNION ALL SELECT id, {k} FROM (SELECT c.id FROM (SELECT {to} AS id, min(k) AS k FROM ee JOIN {side}{k - 1} p ON p.id = {at} AND p.depth = {k - 1} WHERE {to} NOT IN (SELECT id FROM {side}{k - 1}) GROUP BY 1) c JOIN nn ON nn.id = c.id ORDER BY raw DESC, k, rk, title, c.id LIMIT {keep}) z)"""
    return out + """,
bo AS (SELECT id, min(depth) AS depth, CASE WHEN count(*) > 1 THEN 'both' ELSE min(way) END AS way FROM (SELECT id, depth, 'up' AS way FROM u4 WHERE depth > 0 UNION ALL SELECT id, depth, 'down' FROM d4 WHERE depth > 0) q GROUP BY id UNION ALL SELECT 'n:3', 0, 'selected'),
kp AS (SELECT * FROM (SELECT bo.id, depth, way, c, raw, row_number() OVER (PARTITION BY depth ORDER BY raw DESC, rk, title, bo.id) AS n FROM bo JOIN nn ON nn.id = bo.id) q WHERE n <= [1, 16, 10, 5, 2][depth + 1])
SELECT id, CAST(depth AS INTEGER) AS distance, way AS direction, round((raw - min(raw) OVER ()) / greatest(0.001, max(raw) OVER () - min(raw) OVER ()), 6) AS score, c AS connections FROM kp"""


@query("g14_beam_walk", sql_with("nodes", "edges") + _walk_sql())
def g14(t):
    nodes = t.nodes.select("id", "title", "views", F.length("title").alias("rank"))
    return G.beam_walk(nodes, t.edges, t.nodes.where("id = 'n:3'")).withColumn("score", F.round("score", 6))


@query("g15_bounded_descendants", sql_with("nodes", "edges", recursive=True) + """, h AS (SELECT 'r:1' AS id, 0 AS depth UNION SELECT e.to_id, h.depth + 1 FROM h JOIN edges e ON e.from_id = h.id WHERE h.depth < 8)
SELECT id, CAST(depth AS INTEGER) AS depth FROM (SELECT h.id, min(depth) AS depth, any_value(lower(title)) AS t FROM h JOIN nodes n ON n.id = h.id WHERE h.id <> 'r:1' GROUP BY h.id) q ORDER BY q.depth, t, id LIMIT 60""")  # fmt: skip
def g15(t):
    return G.bounded_descendants(t.edges, t.nodes.where("id = 'r:1'").select("id"), t.nodes, 8, 60)


@query("g16_trace_paths", TREE + """, k AS (SELECT path_ids FROM st WHERE id LIKE 'p:%' ORDER BY depth, id LIMIT 18), i AS (SELECT path_ids, unnest(range(1, len(path_ids))) AS i FROM k)
SELECT DISTINCT path_ids[i] AS from_id, path_ids[i + 1] AS to_id FROM i""")  # fmt: skip
def g16(t):
    return G.trace_paths(states(t), t.nodes.where("kind = 'part'"))[1]


@query("g17_redundant_edges", sql_with("succ", recursive=True) + """, h AS (SELECT DISTINCT from_id AS s, to_id AS id, 1 AS depth FROM succ UNION SELECT h.s, e.to_id, h.depth + 1 FROM h JOIN succ e ON e.from_id = h.id WHERE h.depth < 5 AND e.to_id <> h.s),
r AS (SELECT from_id, to_id, n, row_number() OVER (PARTITION BY from_id ORDER BY n DESC, to_id) AS k FROM succ c WHERE EXISTS (SELECT 1 FROM h WHERE h.s = c.from_id AND h.id = c.to_id AND h.depth >= 2))
SELECT from_id, to_id, n FROM r WHERE k > CASE WHEN from_id LIKE '%O' THEN 1 ELSE 0 END""")  # fmt: skip
def g17(t):
    ranked = t.succ.withColumn("rank", -F.col("n"))
    keep = t.succ.where("from_id like '%O'").select(F.col("from_id").alias("id"), F.lit(1).alias("n")).distinct()
    return G.redundant(ranked.withColumnRenamed("n", "times"), 5, keep).select("from_id", "to_id", F.col("times").alias("n"))


@query("g18_wrong_direction", sql_with("nodes", "edges") + """, i AS (SELECT id, coalesce(views, 0) AS v, title LIKE '%3' AS b, kind = 'nation' AS p FROM nodes)
SELECT e.to_id AS from_id, e.from_id AS to_id, e.relation, e.source FROM edges e JOIN i a ON a.id = e.to_id JOIN i b ON b.id = e.from_id WHERE source <> 'manual_curation' AND b.b AND NOT a.b AND NOT a.p AND NOT b.p AND b.v >= 2 * a.v AND b.v >= a.v + 100""")  # fmt: skip
def g18(t):
    nodes = t.nodes.withColumn("promoted", F.col("kind") == "nation")
    return G.wrong_direction(G.reversed_edges(t.edges), nodes, t.nodes.where("title like '%3'").select("title"), t.edges.limit(0)).select("from_id", "to_id", "relation", "source")

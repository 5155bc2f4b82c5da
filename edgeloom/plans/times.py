"""Queries: temporal analytics (Y)."""

from pyspark.sql import functions as F

from edgeloom.operators import temporal as Y
from edgeloom.plans.bindings import sql_with
from edgeloom.plans.registry import query

OBS = "obs AS (SELECT DISTINCT id, year_start AS start, greatest(year_end, year_start) AS end_, (weight + 0.37) / 10 AS weight, CASE kind WHEN 'R' THEN 'medium' WHEN 'A' THEN 'high' ELSE 'low' END AS confidence, CASE kind WHEN 'R' THEN 'emergence' WHEN 'A' THEN 'popularity' ELSE 'influence' END AS kind, 'summary' AS source FROM years)"
HINTS = """, o AS (SELECT *, kind = 'emergence' AS direct, kind <> 'influence' AND weight >= 0.6 AS solid FROM obs), p AS (SELECT *, bool_or(direct) OVER (PARTITION BY id) AS anyd, bool_or(solid) OVER (PARTITION BY id) AS anys FROM o),
q AS (SELECT *, CASE WHEN anys THEN solid ELSE TRUE END AS base, CASE WHEN anyd THEN direct WHEN anys THEN solid ELSE TRUE END AS pool, CASE WHEN anyd THEN direct OR (kind = 'popularity' AND weight >= 1) WHEN anys THEN solid ELSE TRUE END AS later FROM p),
fst AS (SELECT id, start AS fs, end_ AS fe FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY start, end_) AS rn FROM q WHERE pool) z WHERE rn = 1), b AS (SELECT q.* FROM q JOIN fst USING (id) WHERE pool AND start <= greatest(fs + 12, fe)),
lo AS (SELECT id, min(start) AS lo FROM (SELECT id, start, sum(weight) OVER (PARTITION BY id ORDER BY start) AS run, sum(weight) OVER (PARTITION BY id) AS al FROM b) z WHERE run >= 0.16 * al GROUP BY id),
hi AS (SELECT id, min(end_) AS hi FROM (SELECT id, end_, sum(weight) OVER (PARTITION BY id ORDER BY end_) AS run, sum(weight) OVER (PARTITION BY id) AS al FROM b) z WHERE run >= 0.84 * al GROUP BY id),
un AS (SELECT id, min(end_) AS un FROM (SELECT id, end_, sum(weight) OVER (PARTITION BY id ORDER BY end_) AS run, sum(weight) OVER (PARTITION BY id) AS al FROM q WHERE later) z WHERE run >= 0.84 * al GROUP BY id),
mn AS (SELECT id, sum((start + end_) / 2.0::DOUBLE * weight) / sum(weight) AS mean FROM b GROUP BY id), sd AS (SELECT id, sqrt(sum(weight * pow((start + end_) / 2.0::DOUBLE - mean, 2)) / sum(weight)) AS sd FROM b JOIN mn USING (id) GROUP BY id),
h AS (SELECT id, greatest(900, least(lo, 2050)) AS ys, greatest(greatest(900, least(lo, 2050)), least(hi, 2050)) AS be, greatest(greatest(900, least(lo, 2050)), least(un, 2050)) AS re FROM lo JOIN hi USING (id) JOIN un USING (id)),
far AS (SELECT DISTINCT q.id FROM q JOIN h USING (id) WHERE later AND end_ > be + 2 AND (kind IN ('popularity', 'period') OR (kind = 'emergence' AND start > be + 2) OR (start <= be AND end_ - be >= 8))),
c AS (SELECT id, count(*) AS n, max_by(kind, struct_pack(w := weight, s := -start, k := kind)) AS kind, max(CASE WHEN base THEN CASE WHEN confidence = 'high' AND weight >= 5 THEN 2 WHEN confidence IN ('high', 'medium') AND weight >= 2 THEN 1 ELSE 0 END END) AS c FROM q GROUP BY id),
hint AS (SELECT h.id, ys AS year_start, nullif(be, ys) AS year_end, round(mean, 2) AS mean, round(sd, 2) AS sd, n, kind, ['low', 'medium', 'high'][c + 1] AS confidence, CASE WHEN far.id IS NOT NULL THEN re END AS relevance_end FROM h JOIN mn USING (id) JOIN sd USING (id) JOIN c USING (id) LEFT JOIN far ON far.id = h.id)"""


def obs(t):
    sure = F.when(F.col("kind") == "R", "medium").when(F.col("kind") == "A", "high").otherwise("low")
    kind = F.when(F.col("kind") == "R", "emergence").when(F.col("kind") == "A", "popularity").otherwise("influence")
    return t.years.select("id", F.col("year_start").alias("start"), F.greatest("year_end", "year_start").alias("end"), ((F.col("weight") + 0.37) / 10).alias("weight"), sure.alias("confidence"), kind.alias("kind"), F.lit("summary").alias("source")).distinct()


@query("y1_observations", """WITH p AS (SELECT p_partkey AS id, p_size, p_name, p_partkey % 3 AS m FROM part)
SELECT id, CAST(1900 + p_size AS INTEGER) AS start, CAST(1900 + p_size AS INTEGER) AS end, CASE m WHEN 0 THEN 7.5 WHEN 1 THEN 3.2 ELSE 0.45 END::DOUBLE AS weight, CASE m WHEN 0 THEN 'medium' ELSE 'low' END AS confidence, CASE m WHEN 0 THEN 'emergence' WHEN 1 THEN 'popularity' ELSE 'influence' END AS kind, 'summary' AS source FROM p
UNION ALL SELECT id, CAST(1950 + id % 10 AS INTEGER), CAST(1950 + id % 10 AS INTEGER), 10.0, 'high', 'origin', 'origin' FROM p WHERE id % 4 = 0 UNION ALL SELECT id, CAST(1960 AS INTEGER), CAST(1969 AS INTEGER), 0.65, 'low', 'period', 'category' FROM p WHERE id % 5 = 0""")  # fmt: skip
def y1(t):
    p, k = t.part, F.col("p_partkey")
    verb = F.when(k % 3 == 0, " emerged in ").when(k % 3 == 1, " was popular in ").otherwise(" was influenced by music of ")
    summary = F.concat(F.lit("The "), "p_name", verb, (F.col("p_size") + 1900).cast("string"), F.lit(". The term was coined in 1999."))
    rows = p.select(k.alias("id"), F.lit("summary").alias("source"), summary.alias("text")).union(p.where("p_partkey % 4 = 0").select(k, F.lit("origin"), F.concat(F.lit("Somewhere, "), (k % 10 + 1950).cast("string")))).union(p.where("p_partkey % 5 = 0").select(k, F.lit("category"), F.lit("1960s genres")))
    return Y.observations(rows)


@query("y2_year_hints", sql_with("years") + f", {OBS}{HINTS} SELECT * FROM hint")
def y2(t):
    return Y.year_hints(obs(t))


@query("y3_hint_table", sql_with("nodes", "years") + f", {OBS}{HINTS} SELECT n.id, CASE WHEN kind_ THEN 'excluded' WHEN year_start IS NULL THEN 'no_observation' ELSE 'hint' END AS reason, CASE WHEN NOT kind_ THEN year_start END AS year_start, CASE WHEN NOT kind_ THEN confidence END AS confidence FROM (SELECT id, kind = 'region' OR title LIKE '%ring%' AS kind_ FROM nodes) n LEFT JOIN hint ON hint.id = n.id")
def y3(t):
    return Y.hint_table(t.nodes, Y.year_hints(obs(t)), (F.col("kind") == "region") | F.col("title").like("%ring%"))


@query("y4_evaluation", sql_with("years") + f""", {OBS}{HINTS}, j AS (SELECT s.id, s.year, hint.* EXCLUDE (id) FROM (SELECT id, max(year_start) AS year FROM years GROUP BY id) s LEFT JOIN hint ON hint.id = s.id)
SELECT 'stored' AS metric, count(*) AS value FROM j UNION ALL SELECT 'covered', count(year_start) FROM j UNION ALL SELECT 'high', count(*) FILTER (WHERE confidence = 'high') FROM j UNION ALL SELECT 'medium', count(*) FILTER (WHERE confidence = 'medium') FROM j UNION ALL SELECT 'low', count(*) FILTER (WHERE confidence = 'low') FROM j UNION ALL SELECT 'mismatched', count(*) FILTER (WHERE abs(year - year_start) > 2) FROM j""")  # fmt: skip
def y4(t):
    stored = t.years.groupBy("id").agg(F.max("year_start").alias("year"))
    return Y.evaluate(Y.year_hints(obs(t)), stored)


LEVEL = "h AS (SELECT id, CAST(1950 + min(o_orderkey) % 70 AS INTEGER) AS year, CAST(count(*) % 3 AS INTEGER) AS level FROM visits GROUP BY 1), s AS (SELECT *, year // 10 AS d FROM h WHERE level >= 1 ORDER BY year, id LIMIT 2000), c AS (SELECT from_id, to_id FROM succ JOIN s a ON a.id = from_id JOIN s b ON b.id = to_id WHERE a.d <> b.d)"


@query("y5_timeline", sql_with("visits", "succ") + f", {LEVEL} SELECT from_id, to_id, CAST(NULL AS INTEGER) AS year FROM c UNION ALL SELECT id, NULL, year FROM s WHERE id IN (SELECT from_id FROM c UNION SELECT to_id FROM c)")
def y5(t):
    h = t.visits.groupBy("id").agg((F.min("o_orderkey") % 70 + 1950).cast("int").alias("year"), (F.count("*") % 3).cast("int").alias("level"))
    nodes, edges = Y.timeline(h, t.succ.select("from_id", "to_id"), 1, 2000)
    return edges.select("from_id", "to_id", F.lit(None).cast("int").alias("year")).union(nodes.select("id", F.lit(None).cast("string"), "year"))


@query("y6_inferred_years", sql_with("nodes", "edges") + """, n0 AS (SELECT id, CASE kind WHEN 'region' THEN 0 WHEN 'nation' THEN 1 WHEN 'supplier' THEN 2 ELSE 3 END AS depth, CASE WHEN kind = 'region' AND id <> 'r:0' THEN 1900 WHEN length(title) % 3 = 0 THEN 1950 END AS year FROM nodes), m AS (SELECT min(year) AS m FROM n0),
y0 AS (SELECT id, coalesce(year, m) AS y FROM n0, m WHERE depth = 0), y1 AS (SELECT n.id, coalesce(n.year, max(y0.y) + 8, any_value(m) + 12) AS y FROM n0 n CROSS JOIN m LEFT JOIN edges e ON e.to_id = n.id LEFT JOIN y0 ON y0.id = e.from_id WHERE depth = 1 GROUP BY n.id, n.year),
y2 AS (SELECT n.id, coalesce(n.year, max(y1.y) + 8, any_value(m) + 24) AS y FROM n0 n CROSS JOIN m LEFT JOIN edges e ON e.to_id = n.id LEFT JOIN y1 ON y1.id = e.from_id WHERE depth = 2 GROUP BY n.id, n.year),
y3 AS (SELECT n.id, coalesce(n.year, max(y2.y) + 8, any_value(m) + 36) AS y FROM n0 n CROSS JOIN m LEFT JOIN edges e ON e.to_id = n.id LEFT JOIN y2 ON y2.id = e.from_id WHERE depth = 3 GROUP BY n.id, n.year)
SELECT id, CAST(y AS INTEGER) AS year FROM (SELECT * FROM y0 UNION ALL SELECT * FROM y1 UNION ALL SELECT * FROM y2 UNION ALL SELECT * FROM y3) z""")  # fmt: skip
def y6(t):
    depth = F.when(F.col("kind") == "region", 0).when(F.col("kind") == "nation", 1).when(F.col("kind") == "supplier", 2).otherwise(3)
    year = F.when((F.col("kind") == "region") & (F.col("id") != "r:0"), 1900).when(F.length("title") % 3 == 0, 1950)
    return Y.infer_years(t.nodes.select("id", depth.alias("depth"), year.alias("year")), t.edges.select("from_id", "to_id").distinct())

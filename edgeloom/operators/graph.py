"""Graph operators: level-synchronous loops of joins. Each level reduces to one row a key, drops what was visited, and is
written to the shared folder, so plans stay short; state rows are narrow. Edges: (from_id, to_id, ...)."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.operators.reach import components
from edgeloom.operators.skew import heavy_keys, part_target, spread_join
from edgeloom.operators.staging import clustered, cut, partitions

MERGED = 32


def frontier(seeds: DataFrame, key: list[str], expand: Callable[[DataFrame], DataFrame], max_depth: int | None) -> DataFrame:
    """Rows with ``depth``: seeds at their depth, then level by level what expand(level) gives, of keys not seen before; max_depth
    None: until nothing is new. What was found is written as one table every ``MERGED`` levels, so that deep graphs keep plans short.

    expand must give one row a key, with the columns of seeds but depth.
    """
    level = cut(seeds, "frontier")
    found, depth = level, level.agg(F.max("depth")).first()[0]
    while depth is not None and (max_depth is None or depth < max_depth):
        depth += 1
        level = cut(expand(level).join(found.select(*key), key, "left_anti").withColumn("depth", F.lit(depth)).select(*seeds.columns), "frontier")
        if level.isEmpty():
            break
        found = found.unionByName(level)
        if depth % MERGED == 0:
            found = cut(found, "found")
    return found


def reachability(roots: DataFrame, edges: DataFrame, titles: DataFrame, max_depth: int = 16) -> DataFrame:
    """Canonical state of each node that a root reaches: (id, title, root_id, root_title, depth, path_ids, path_titles).

    Shortest depth (roots: 1); ties by lower-cased root title, lower-cased title, the path's titles, then its ids. An edge back into
    its own path is not followed. Levels are final: a node of depth d can't be improved at d + 1.
    """
    t = titles.select("id", "title")
    start = roots.select("id").distinct().join(t, "id")
    start = start.select("id", "title", F.col("id").alias("root_id"), F.col("title").alias("root_title"), F.lit(1).alias("depth"), F.array("id").alias("path_ids"), F.array("title").alias("path_titles"))
    named = cut(edges.select("from_id", "to_id").distinct().join(t.select(F.col("id").alias("to_id"), F.col("title").alias("to_title")), "to_id"), "named")  # read at each level

    def expand(level: DataFrame) -> DataFrame:
        j = level.join(named, level["id"] == named["from_id"]).where(~F.array_contains("path_ids", F.col("to_id")))
        state = F.struct(F.lower("root_title").alias("k1"), F.lower("to_title").alias("k2"), F.array_append("path_titles", F.col("to_title")).alias("path_titles"), F.array_append("path_ids", F.col("to_id")).alias("path_ids"), F.col("root_id"), F.col("root_title"), F.col("to_title").alias("title"))
        return j.groupBy(F.col("to_id").alias("id")).agg(F.min(state).alias("s")).select("id", "s.title", "s.root_id", "s.root_title", "s.path_ids", "s.path_titles")

    return frontier(start, ["id"], expand, max_depth)


def skipped(states: DataFrame, edges: DataFrame, max_depth: int = 16) -> DataFrame:
    """(cycle, depth): how many edges of reachable nodes lead back into the node's own path, and how many start at max_depth."""
    j = edges.join(states.select(F.col("id").alias("from_id"), "depth", "path_ids"), "from_id")
    deep = F.col("depth") >= max_depth
    return j.agg(F.count_if(~deep & F.array_contains("path_ids", F.col("to_id"))).alias("cycle"), F.count_if(deep).alias("depth"))


def parent_index(states: DataFrame, edges: DataFrame, roots: DataFrame, titles: DataFrame, max_depth: int = 16, top: str = "root") -> DataFrame:
    """One row for each edge whose parent is reachable above max_depth and whose child is not on the parent's path, once a
    (child, parent, relation, source, ordinal); and one row for each root under the synthetic parent ``top``."""
    kept = edges.dropDuplicates(["to_id", "from_id", "relation", "source", "ordinal"])
    j = kept.join(states, kept["from_id"] == states["id"]).where((F.col("depth") < max_depth) & ~F.array_contains("path_ids", F.col("to_id")))
    rows = j.select(F.col("to_id").alias("id"), F.col("from_id").alias("parent_id"), "relation", "source", "ordinal", "root_id", F.col("depth").alias("parent_depth"), (F.col("depth") + 1).alias("depth"), F.array_append("path_ids", F.col("to_id")).alias("path_ids"))
    own = roots.select("id").distinct().join(states.select("id", "root_id", "path_ids"), "id")
    own = own.select("id", F.lit(top).alias("parent_id"), F.lit("root").alias("relation"), F.lit("root").alias("source"), F.lit(0).alias("ordinal"), "root_id", F.lit(0).alias("parent_depth"), F.lit(1).alias("depth"), "path_ids")
    return rows.unionByName(own)


def orphans(nodes: DataFrame, states: DataFrame) -> DataFrame:
    return nodes.join(states.select("id"), "id", "left_anti").orderBy(F.desc_nulls_last("views"), F.lower("title"), "id")


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int | None, relations: list[str] | None = None) -> DataFrame:
    """(seed, id, depth) of what each seed (id) reaches within hops, at its least depth; many seeds at once."""
    e = (edges if relations is None else edges.where(F.col("relation").isin(*relations))).select("from_id", "to_id").distinct()
    e = cut(e, "pairs")
    start = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth")).distinct()
    step = lambda level: level.join(e, level["id"] == e["from_id"]).select("seed", F.col("to_id").alias("id")).distinct()
    return frontier(start, ["seed", "id"], step, hops).where("depth > 0")


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(seed, id, depth): all descendants of each seed with the least depth; cycles end by the visited pairs. Where depths are not asked
    for, ``reach.reach_index`` answers for deep and large graphs without these pairs."""
    return neighbourhood(edges, seeds, max_depth)


def depths(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, depth) of all that roots (id) reach, themselves at 0: one row a node, not one a root and node."""
    e = cut(edges.select("from_id", "to_id").distinct(), "pairs")
    step = lambda level: spread_join(level, e.withColumnRenamed("from_id", "id"), ["id"]).select(F.col("to_id").alias("id")).distinct()
    return frontier(roots.select("id", F.lit(0).alias("depth")).distinct(), ["id"], step, None)


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.withColumnsRenamed({"from_id": "_f", "to_id": "from_id"}).withColumnRenamed("_f", "to_id")


def shortcuts(edges: DataFrame, candidates: DataFrame, max_depth: int = 8) -> DataFrame:
    """Of candidate edges (from_id, to_id), those whose end is also reached in 2 to max_depth steps that do not come back to the start.

    Searched from both sides: half of the steps forward from the candidates' starts, the rest backward from their ends, where a start is
    kept out of its own candidates' ways; a node that both sides meet is on a way. Either side walks at most half as deep.
    """
    e = cut(edges.select("from_id", "to_id").distinct(), "pairs")
    want = cut(candidates.where("from_id <> to_id").select("from_id", "to_id").distinct(), "pairs")
    forward = (max_depth + 1) // 2
    first = want.select(F.col("from_id").alias("seed")).distinct().join(e, F.col("seed") == F.col("from_id")).where("seed <> to_id").select("seed", F.col("to_id").alias("id"), F.lit(1).alias("depth"))
    ahead = lambda level: spread_join(level, e.withColumnRenamed("from_id", "id"), ["id"]).where("seed <> to_id").select("seed", F.col("to_id").alias("id")).distinct()
    met = frontier(first, ["seed", "id"], ahead, forward).select("seed", "id")
    last = spread_join(want.select(F.col("from_id").alias("seed"), F.col("to_id").alias("end")), e.select(F.col("to_id").alias("end"), F.col("from_id").alias("id")), ["end"])
    last = last.where("id <> seed").select("seed", "end", "id", F.lit(1).alias("depth"))
    behind = lambda level: spread_join(level, e.withColumnRenamed("to_id", "id"), ["id"]).where("seed <> from_id").select("seed", "end", F.col("from_id").alias("id")).distinct()
    ways = frontier(last, ["seed", "end", "id"], behind, max_depth - forward)
    return spread_join(ways, met, ["seed", "id"], "left_semi").select(F.col("seed").alias("from_id"), F.col("end").alias("to_id")).distinct()


# How much an edge's evidence is worth when two edges oppose each other.
def strength(display: tuple[str, ...], manual: str = "manual_curation", summary: str = "summary_taxonomy") -> Column:
    shown = F.when(F.col("relation") == "related", F.col("evidence_relation").isin(*display)).otherwise(F.col("relation").isin(*display))
    return F.when(F.col("source") == manual, -1).when(F.col("evidence_relation") == summary, 90).when((F.col("source") == "inbound_index") & shown, 70).when(F.col("source") == "wikidata", 62).when(F.col("source") == "infobox", 55).otherwise(50)


def opposing(edges: DataFrame, display: tuple[str, ...], manual: str = "manual_curation") -> DataFrame:
    """Edges to drop of pairs that point at each other: the weakest of the pair, unless that one is manual (then none).

    Ties: the smaller (from_id, relation, source, ordinal).
    """
    e = edges.withColumn("_s", F.coalesce(strength(display, manual), F.lit(50)))
    pair = [F.least("from_id", "to_id").alias("_a"), F.greatest("from_id", "to_id").alias("_b")]
    both = e.groupBy(*pair).agg(F.countDistinct("from_id").alias("n"), F.min(F.struct("_s", "from_id", "relation", "source", "ordinal", "to_id")).alias("w")).where("n = 2 and _a <> _b")
    return both.where(F.col("w.source") != manual).select("w.from_id", "w.to_id", "w.relation", "w.source", "w.ordinal")


def components_by(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, scc): strongly connected components of the ids, named by their least id."""
    of = components(edges, ids)
    least = of.groupBy("scc").agg(F.min("id").alias("least"))
    return spread_join(of.join(ids.select("id").distinct(), "id", "left_semi"), least, ["scc"]).select("id", F.col("least").alias("scc"))


def cycle_edges(roots: DataFrame, edges: DataFrame, titles: DataFrame, display: tuple[str, ...], manual: str = "manual_curation") -> DataFrame:
    """Edges to ignore so that what roots reach has no cycle: (from_id, to_id, relation, source, ordinal, reason).

    First the weaker edge of opposing pairs; then, within each strongly connected component of the rest, edges that are not manual
    and whose end does not come later in the order (depth from the roots, lower-cased title, id). Pairs that the first rule leaves
    alone stay. Cycles left go through a manual edge.
    """
    depth = depths(edges, roots)
    order = cut(depth.join(titles, "id").select("id", "depth", F.lower("title").alias("t")), "cycle")
    own = edges.join(order.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    key = ["from_id", "to_id", "relation", "source", "ordinal"]
    first = cut(opposing(own, display, manual), "cycle")
    rest = own.join(first, key, "left_anti")
    exempt = rest.join(reversed_edges(rest.where(F.col("source") == manual)).select("from_id", "to_id").distinct(), ["from_id", "to_id"], "left_semi").select(*key)
    scc = components(rest, order.select("id"))
    at = lambda c, p: order.join(scc, "id").select(F.col("id").alias(c), F.struct("depth", "t", F.col("id").alias("i")).alias(p), F.col("scc").alias(f"{p}_scc"))
    inner = rest.where(F.col("source") != manual).join(at("from_id", "x"), "from_id").join(at("to_id", "y"), "to_id").where("x_scc = y_scc and y <= x").select(*key).join(exempt, key, "left_anti")
    return first.select(*key, F.lit("opposing").alias("reason")).union(inner.select(*key, F.lit("backward").alias("reason")))


def flag_edges(stored: DataFrame, ignored: DataFrame, mark: str) -> DataFrame:
    """Stored edges with is_ignored and ignored_reason: own earlier flags (reason beginning with mark) reset, new ones set."""
    key = ["from_id", "to_id", "relation", "source", "ordinal"]
    own = F.coalesce(F.startswith("ignored_reason", F.lit(mark)), F.lit(False))
    j = stored.join(ignored.select(*key, F.concat(F.lit(f"{mark}:"), "reason").alias("_new")).distinct(), key, "left")
    kept = F.when(own, F.lit(None)).otherwise(F.col("ignored_reason"))
    return j.select(*key, (F.col("_new").isNotNull() | (F.col("is_ignored") & ~own)).alias("is_ignored"), F.coalesce("_new", kept).alias("ignored_reason"))


def named_cycles(edges: DataFrame, longest: int) -> DataFrame:
    """(length, cycle): simple cycles of up to ``longest`` edges, each once, its ids from the least on.

    Only edges within a strongly connected component can be on a cycle; paths are followed among these alone, so a graph without
    cycles costs no more than its components.
    """
    every = cut(edges.select("from_id", "to_id").distinct(), "cycles")
    of = components(every)
    inner = spread_join(spread_join(every, of.select(F.col("id").alias("from_id"), F.col("scc").alias("_x")), ["from_id"]), of.select(F.col("id").alias("to_id"), F.col("scc").alias("_y")), ["to_id"])
    e = cut(inner.where("_x = _y").select("from_id", "to_id"), "cycles")
    paths = e.where("from_id <> to_id").select(F.array("from_id", "to_id").alias("path"))
    found = e.where("from_id = to_id").select(F.array("from_id").alias("cycle"))
    for length in range(2, longest + 1):
        ends = paths.join(e, F.element_at("path", -1) == F.col("from_id"))
        found = found.union(ends.where(F.col("to_id") == F.col("path")[0]).select("path"))
        if length < longest:  # the least id leads a path, so each cycle is met once
            paths = cut(ends.where((F.col("to_id") > F.col("path")[0]) & ~F.array_contains("path", F.col("to_id"))).select(F.array_append("path", F.col("to_id")).alias("path")), "cycles")
    return found.where(F.array_min("cycle") == F.col("cycle")[0]).distinct().select(F.size("cycle").alias("length"), F.array_join("cycle", ">").alias("cycle"))


def nearest_typed(edges: DataFrame, seeds: DataFrame, kinds: DataFrame, wanted: dict[str, int], max_depth: int = 8) -> DataFrame:
    """(seed, id, kind, depth): of what each seed reaches, the nearest of the wanted kinds; ties by the kind's rank, then id."""
    rank = F.create_map(*[x for k, v in wanted.items() for x in (F.lit(k), F.lit(v))])
    near = closure(edges, seeds, max_depth).join(kinds.select("id", "kind"), "id").where(F.col("kind").isin(*wanted)).withColumn("_r", rank[F.col("kind")])
    n = F.row_number().over(Window.partitionBy("seed").orderBy("depth", "_r", "id"))
    return near.withColumn("_n", n).where("_n = 1").select("seed", "id", "kind", "depth")


def typed_reach(edges: DataFrame, seeds: DataFrame, kinds: DataFrame, wanted: tuple[str, ...], max_depth: int = 8) -> DataFrame:
    """(seed, id, kind, depth): all that each seed reaches of the wanted kinds."""
    return closure(edges, seeds, max_depth).join(kinds.select("id", "kind"), "id").where(F.col("kind").isin(*wanted)).select("seed", "id", "kind", "depth")


def best_typed(edges: DataFrame, seeds: DataFrame, kinds: DataFrame, wanted: dict[str, int], max_depth: int = 8) -> DataFrame:
    """(seed, id, kind, depth): of what each seed reaches, the best by the kind's rank, then the nearest, then by id."""
    rank = F.create_map(*[x for k, v in wanted.items() for x in (F.lit(k), F.lit(v))])
    n = F.row_number().over(Window.partitionBy("seed").orderBy(rank[F.col("kind")], "depth", "id"))
    return typed_reach(edges, seeds, kinds, tuple(wanted), max_depth).withColumn("_n", n).where("_n = 1").drop("_n")


# How much affinity an edge passes on, forward by relation and source, and back by relation.
FORWARD = {
    "broader_genres": 1.0, "subgenres": 1.0, "subgenre": 1.0, "source_genres": 0.42, "derived_genres": 0.76, "derivative": 0.76, "fusion_components": 0.68,
    "fusion_descendants": 0.68, "fusion_genre": 0.68, "regional_variations": 0.72, "regional_scene": 0.58,
}
BACKWARD = {
    "broader_genres": 0.34, "subgenres": 0.34, "subgenre": 0.34, "source_genres": 0.20, "derived_genres": 0.28, "derivative": 0.28, "fusion_components": 0.26,
    "fusion_descendants": 0.26, "fusion_genre": 0.26, "regional_variations": 0.82, "regional_scene": 0.82,
}
SOURCES = {"gpt_review": 1.18, "manual_curation": 1.1, "infobox": 1.0, "wikidata": 0.9, "inbound_index": 0.72}
OTHER_SOURCE = 0.82


def flow_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, w): affinity flows with the edge and, weaker, against it, unless blocked (block_forward, block_reverse).

    An unlisted relation passes nothing on; an unlisted source, or none, counts OTHER_SOURCE.
    """
    pick = lambda m, c, other: F.coalesce(F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(v))])[F.col(c)], F.lit(other))
    source = pick(SOURCES, "source", OTHER_SOURCE)
    flow = lambda src, dst, blocked, m: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), F.when(~F.col(blocked), pick(m, "relation", 0.0) * source).alias("w"))
    both = F.array(flow("from_id", "to_id", "block_forward", FORWARD), flow("to_id", "from_id", "block_reverse", BACKWARD))
    return edges.select(F.explode(both).alias("f")).select("f.*").where("w > 0")


WIDE = 64  # roots up to which a node's mix is kept in columns


def affinity(nodes: DataFrame, roots: DataFrame, flows: DataFrame, rounds: int = 30, own: float = 0.05, every: int = 1) -> DataFrame:
    """(id, root, value): each node's mix of roots after Jacobi rounds over flows (src, dst, w).

    A round mixes the neighbours' vectors by weight with ``own`` times the node's own, and scales to sum 1; roots stay as they are;
    nodes that nothing reaches keep what they have. With few roots a node's vector is one row of columns, so a round is one join and
    one sum of as many rows as flows; with more roots than WIDE, vectors are rows of (id, root). Flows are laid down by their sources
    once, so a round shuffles vectors and sums only.
    """
    free, heavy = _laid_flows(flows.join(roots.select(F.col("id").alias("dst")), "dst", "left_anti"))
    few = sorted(r["id"] for r in roots.select("id").distinct().limit(WIDE + 1).collect())
    v = _wide_rounds(free, heavy, few, rounds, own, every) if 0 < len(few) <= WIDE else _long_rounds(free, heavy, roots, rounds, own, every)
    return v.join(nodes.select("id"), "id", "left_semi")


def _laid_flows(flows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, _salt, dst, w) with equal flows summed, in buckets by source and salt; and (src, _salts), the sources of very many flows
    and over how many salts these are dealt."""
    spark = flows.sparkSession
    flows = cut(flows, "flows")
    rows = [tuple(r) for r in heavy_keys(flows, ["src"], part_target(flows)).collect()]
    heavy = F.broadcast(spark.createDataFrame(rows, f"src {dict(flows.dtypes)['src']}, _salts int"))
    salted = flows.join(heavy, "src", "left").select("src", F.pmod(F.xxhash64("dst"), F.coalesce("_salts", F.lit(1))).cast("int").alias("_salt"), "dst", "w")
    summed = salted.repartition(partitions(spark), "src", "_salt").groupBy("src", "_salt", "dst").agg(F.sum("w").alias("w"))
    return clustered(summed, ["src", "_salt"], "flows"), heavy


def _passed_on(v: DataFrame, free: DataFrame, heavy: DataFrame, *hint: str) -> DataFrame:
    """v (id, ...) with dst and w of each flow from id; a hint says how v is joined."""
    each = v.join(heavy, v["id"] == heavy["src"], "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
    each = each.select(F.col("id").alias("src"), "_salt", *[c for c in v.columns if c != "id"])
    for h in hint:
        each = each.hint(h)
    return each.join(free, ["src", "_salt"])


def _wide_rounds(free: DataFrame, heavy: DataFrame, roots: list, rounds: int, own: float, every: int) -> DataFrame:
    names = [f"c{k}" for k in range(len(roots))]
    kind = free.schema["src"].dataType
    pinned = free.sparkSession.createDataFrame([(r, *(1.0 if r == x else 0.0 for x in roots)) for r in roots], "id string, " + ", ".join(f"{c} double" for c in names)).withColumn("id", F.col("id").cast(kind))
    mixed = None
    for k in range(rounds):
        v = pinned if mixed is None else pinned.unionByName(mixed)
        # vectors are the side that is kept in a hash table: the flows need no sorting
        sent = _passed_on(v, free, heavy, "shuffle_hash").select(F.col("dst").alias("id"), "w", *names)
        if mixed is not None:
            sent = sent.unionByName(mixed.select("id", F.lit(own).alias("w"), *names))
        sums = sent.groupBy("id").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in names])
        total = sum((F.col(c) for c in names[1:]), F.col(names[0]))
        mixed = sums.withColumn("_t", total).where("_t > 0").select("id", *[(F.col(c) / F.col("_t")).alias(c) for c in names])
        if (k + 1) % every == 0 or k == rounds - 1:
            mixed = cut(mixed, "affinity")
    v = pinned if mixed is None else pinned.unionByName(mixed)
    each = F.explode(F.array(*[F.struct(F.lit(r).cast(kind).alias("root"), F.col(c).alias("value")) for r, c in zip(roots, names)]))
    return v.select("id", each.alias("e")).select("id", "e.root", "e.value").where("value > 0")


def _long_rounds(free: DataFrame, heavy: DataFrame, roots: DataFrame, rounds: int, own: float, every: int) -> DataFrame:
    pinned = roots.select("id", F.col("id").alias("root"), F.lit(1.0).alias("value"))
    v = pinned
    for k in range(rounds):
        sent = _passed_on(v, free, heavy).select(F.col("dst").alias("id"), "root", (F.col("value") * F.col("w")).alias("value"))
        kept = v.join(roots.select("id"), "id", "left_anti")
        mixed = sent.union(kept.select("id", "root", F.col("value") * own)).groupBy("id", "root").agg(F.sum("value").alias("value"))
        total = Window.partitionBy("id")
        scaled = mixed.select("id", "root", (F.col("value") / F.sum("value").over(total)).alias("value"))
        v = pinned.union(scaled)
        if (k + 1) % every == 0 or k == rounds - 1:
            v = cut(v, "affinity")
    return v


def root_floor(vectors: DataFrame, direct: DataFrame, floor: float = 0.5) -> DataFrame:
    """Children of flagged roots, direct (id, root, w), keep at least ``floor`` with those roots together."""
    d = direct.where("w > 0").groupBy("id", "root").agg(F.sum("w").alias("w"))
    d = d.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy("id"))).select("id", "root", "share")
    have = vectors.join(d.select("id", "root"), ["id", "root"], "left_semi").groupBy("id").agg(F.sum("value").alias("_have"))
    low = d.select("id").distinct().join(have, "id", "left").where(F.coalesce("_have", F.lit(0.0)) < floor).select("id", F.lit(True).alias("_low"))
    low = low.join(vectors.select("id").distinct(), "id", "left_semi")
    j = vectors.join(low, "id", "left")
    lifted = j.where("_low").select("id", "root", (F.col("value") * (1 - floor)).alias("value")).union(d.join(low.select("id"), "id", "left_semi").select("id", "root", F.col("share") * floor))
    return j.where("_low is null").select("id", "root", "value").union(lifted.groupBy("id", "root").agg(F.sum("value").alias("value")))


def colours(vectors: DataFrame, roots: DataFrame, support: DataFrame, views: DataFrame) -> DataFrame:
    """(id, confidence, colour): confidence from support (id, w), top share and views; colour: OKLab mix of the four top roots' colours."""
    from edgeloom.functions.text import let, oklab, srgb_hex

    n = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("value"), "root"))
    top = vectors.withColumn("_n", n).where("_n <= 4").join(roots.select(F.col("id").alias("root"), oklab("colour").alias("lab")), "root")
    mix = top.groupBy("id").agg(F.max("value").alias("top"), *[(F.sum(F.col("value") * F.col("lab")[k]) / F.sum("value")).alias(f"x{k}") for k in range(3)])
    j = mix.join(support, "id", "left").join(views, "id", "left").join(roots.select("id", F.lit(True).alias("_root")), "id", "left")
    conf = 0.14 + (1 - F.exp(-F.coalesce("w", F.lit(0.0)) / 1.35)) * 0.56 + F.col("top") * 0.14 + F.least(F.lit(1.0), F.log10(F.coalesce("views", F.lit(0.0)) + 1) / 6) * 0.16
    j = j.withColumn("confidence", F.when(F.col("_root"), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf))))
    scale = 0.52 + F.col("confidence") * 0.42
    lab = F.array(F.greatest(F.lit(0.56), F.least(F.lit(0.74), F.col("x0"))), F.col("x1") * scale, F.col("x2") * scale)
    return j.select("id", F.round("confidence", 4).alias("confidence"), let(lab, lambda v: srgb_hex(v)).alias("colour"))


def distance_map(edges: DataFrame, seeds: DataFrame, max_depth: int = 4, floor: float = 0.18) -> DataFrame:
    """(seed, id, depth, strength, score) over undirected edges (a, b, strength): least depth, and of its paths the strongest product."""
    e = cut(edges.select("a", "b", "strength").union(edges.select("b", "a", "strength")), "pairs")
    start = seeds.select(F.col("id").alias("seed"), "id", F.lit(1.0).alias("strength"), F.lit(0).alias("depth")).distinct()
    step = lambda level: level.withColumnRenamed("strength", "s").join(e, level["id"] == e["a"]).groupBy("seed", F.col("b").alias("id")).agg(F.max(F.col("s") * F.col("strength")).alias("strength"))
    out = frontier(start, ["seed", "id"], step, max_depth)
    return out.withColumn("score", F.round(F.greatest(F.lit(floor), F.col("strength")) / (1 + F.col("depth")), 6))


# The order of relations in the focus walk, and how much an edge counts at its upper and lower end.
WALK_RANK = {
    "broader_genres": 0, "subgenres": 1, "subgenre": 1, "derived_genres": 2, "derivative": 2, "fusion_components": 3, "fusion_descendants": 3, "fusion_genre": 3,
    "regional_variations": 4, "origin_parent": 5,
}
DOWNWARD, UPWARD = 1.0, 0.35


def beam_walk(nodes: DataFrame, edges: DataFrame, seed: DataFrame, per_depth: tuple[int, ...] = (12, 8, 4, 2), totals: tuple[int, ...] = (16, 10, 5, 2)) -> DataFrame:
    """(id, distance, direction, score, connections): the focus around a seed, up and down the edges.

    nodes: (id, title, views, rank); edges: (from_id, to_id, relation). Each direction keeps at each depth the best ``per_depth`` new
    nodes by score, the relation's order, the node's rank and title; a node of both directions has the smaller distance and the
    direction ``both``. Of all nodes of a distance the best ``totals`` stay. A node's score is 4 log2(1 + weighted degree) + 1.2
    log10(views + 10), scaled to 0..1 over the focus. What is kept is bounded by the totals; candidates are reduced by a join, a
    minimum a node and a top-k each depth.
    """
    ends = edges.select(F.col("from_id").alias("id"), F.lit(DOWNWARD).alias("w")).union(edges.select("to_id", F.lit(UPWARD)))
    degree = ends.groupBy("id").agg(F.count("*").alias("connections"), F.sum("w").alias("w"))
    score = F.log2(F.coalesce("w", F.lit(0.0)) + 1) * 4.0 + F.log10(F.greatest(F.coalesce("views", F.lit(0.0)), F.lit(0.0)) + 10) * 1.2
    known = cut(nodes.join(degree, "id", "left").select("id", "title", "rank", F.coalesce("connections", F.lit(0)).alias("connections"), F.round(score, 9).alias("raw")), "beam")
    order = F.coalesce(F.create_map(*[x for k, v in WALK_RANK.items() for x in (F.lit(k), F.lit(v))])[F.col("relation")], F.lit(99))
    start = seed.select("id").join(known, "id", "left_semi").distinct()

    def walk(steps: DataFrame, direction: str) -> DataFrame:
        """steps: (at, id, relation order)."""
        seen = level = cut(start, "beam")
        out = None
        for depth, keep in enumerate(per_depth, 1):
            new = steps.join(level.select(F.col("id").alias("at")), "at").groupBy("id").agg(F.min("order").alias("order"))
            new = new.join(seen, "id", "left_anti").join(known, "id").orderBy(F.desc("raw"), "order", "rank", "title", "id").limit(keep)
            level = cut(new.select("id", F.lit(depth).alias("distance")), "beam")
            seen = seen.union(level.select("id"))
            own = level.withColumn("direction", F.lit(direction))
            out = own if out is None else out.union(own)
        return out

    pairs = cut(edges.select("from_id", "to_id", order.alias("order")), "beam")
    both = walk(pairs.select(F.col("to_id").alias("at"), F.col("from_id").alias("id"), "order"), "up").union(walk(pairs.select(F.col("from_id").alias("at"), F.col("to_id").alias("id"), "order"), "down"))
    focus = both.groupBy("id").agg(F.min("distance").alias("distance"), F.when(F.count("*") > 1, "both").otherwise(F.min("direction")).alias("direction"))
    focus = focus.union(start.select("id", F.lit(0), F.lit("selected"))).join(known, "id")
    n = F.row_number().over(Window.partitionBy("distance").orderBy(F.desc("raw"), "rank", "title", "id"))
    most = F.element_at(F.array(F.lit(1), *[F.lit(t) for t in totals]), F.col("distance") + 1)
    kept = focus.withColumn("_n", n).where(F.col("_n") <= most)
    ends = kept.agg(F.min("raw").alias("_lo"), F.max("raw").alias("_hi"))
    scaled = (F.col("raw") - F.col("_lo")) / F.greatest(F.lit(0.001), F.col("_hi") - F.col("_lo"))
    return kept.join(F.broadcast(ends), F.lit(True)).select("id", "distance", "direction", scaled.alias("score"), "connections")


def bounded_descendants(edges: DataFrame, seed: DataFrame, titles: DataFrame, max_depth: int = 8, budget: int = 200) -> DataFrame:
    """(id, depth) of descendants breadth first, children by lower-cased title, until the budget of nodes is spent."""
    near = closure(edges, seed, max_depth).select("id", "depth").join(titles.select("id", F.lower("title").alias("t")), "id")
    return near.orderBy("depth", "t", "id").limit(budget).select("id", "depth")


def trace_paths(states: DataFrame, targets: DataFrame, most: int = 18) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the stored paths of up to ``most`` targets (id), by depth then id."""
    paths = states.join(targets.select("id"), "id", "left_semi").orderBy("depth", "id").limit(most)
    nodes = paths.select(F.explode("path_ids").alias("id")).distinct()
    pairs = F.explode(F.expr("transform(sequence(1, greatest(size(path_ids) - 1, 1)), i -> struct(path_ids[i - 1] as from_id, path_ids[i] as to_id))"))
    return nodes, paths.where("size(path_ids) > 1").select(pairs.alias("e")).select("e.*").distinct()


def redundant(edges: DataFrame, hops: int = 5, allowance: DataFrame | None = None) -> DataFrame:
    """Edges (from_id, to_id, rank) whose end is also reached by another path of up to ``hops``; ``allowance`` (id, n) lets a node
    keep its n first redundant edges by rank."""
    out = edges.join(shortcuts(edges, edges, hops), ["from_id", "to_id"], "left_semi")
    if allowance is None:
        return out
    n = F.row_number().over(Window.partitionBy("from_id").orderBy("rank", "to_id"))
    return out.withColumn("_n", n).join(allowance.withColumnRenamed("id", "from_id"), "from_id", "left").where(F.col("_n") > F.coalesce("n", F.lit(0))).select(*edges.columns)


def wrong_direction(edges: DataFrame, nodes: DataFrame, broad: DataFrame, reviewed: DataFrame, manual: str = "manual_curation") -> DataFrame:
    """Edges from a narrow node to a broad one (broad: title), twice and 100 more as popular, neither manual nor promoted; none at
    all if reviewed edges exist."""
    info = nodes.join(broad.select("title").distinct().withColumn("_b", F.lit(True)), "title", "left").select("id", F.coalesce("views", F.lit(0.0)).alias("v"), F.coalesce("_b", F.lit(False)).alias("b"), "promoted")
    side = lambda p: info.select(*[F.col(c).alias(f"{p}_{c}" if c != "id" else f"{p}_id") for c in info.columns])
    j = edges.join(side("from"), "from_id").join(side("to"), "to_id").where(F.col("source") != manual)
    hit = j.where("to_b and not from_b and not from_promoted and not to_promoted and to_v >= 2 * from_v and to_v >= from_v + 100").select(*edges.columns)
    flag = reviewed.limit(1).agg((F.count("*") > 0).alias("_has"))
    return hit.join(F.broadcast(flag), F.lit(True)).where("not _has").select(*edges.columns)

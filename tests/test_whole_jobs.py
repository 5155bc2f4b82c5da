"""Jobs that must not stop at a fixed size, nor start anew what is done."""

import random
from collections import Counter

from pyspark.sql import functions as F
from test_scenarios import edge_frame, titles

from edgeloom.operators import aggregate as A
from edgeloom.operators import graph as G
from edgeloom.operators import textsim as T
from edgeloom.operators.rank import global_rank
from edgeloom.plans import registry
from edgeloom.sources import readers, sinks
from edgeloom.streaming.jobs import StateTable


def test_closure_of_a_deep_chain_and_a_cycle_at_its_end(spark):
    n = 65
    e = edge_frame(spark, [*[(f"c{k}", f"c{k + 1}") for k in range(n)], (f"c{n}", "x"), ("x", f"c{n}")])
    got = {r["id"]: r["depth"] for r in G.closure(e, titles(spark, ["c0"]).select("id")).collect()}
    assert got == {f"c{k}": k for k in range(1, n + 1)} | {"x": n + 1}


def test_search_finds_the_reachable_below_a_million_others(spark):
    docs = spark.range(1_000_002).select("id", F.when(F.col("id") < 1_000_001, "red ring").otherwise("a red one").alias("title"), F.lit(1.0).alias("views"))
    states = docs.where("id = 1000001").select("id", F.lit(2).alias("depth"), F.array("title").alias("path_titles"))
    assert [r["id"] for r in T.search_reachable(docs, states, "red ring", {"title": 1.0}, 3).collect()] == [1_000_001]


def test_affinity_in_columns_and_in_rows(spark, monkeypatch):
    e = edge_frame(spark, [("r", "a"), ("q", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("q", "c")]).withColumns({"block_forward": F.lit(False), "block_reverse": F.lit(False)})
    nodes, roots = titles(spark, "r q a b c z".split()), titles(spark, "r q".split()).select("id")
    both = []
    for wide in (64, 0):
        monkeypatch.setattr(G, "WIDE", wide)
        both.append({(r["id"], r["root"]): round(r["value"], 9) for r in G.affinity(nodes, roots, G.flow_edges(e), 12).collect()})
    assert both[0] == both[1] and ("a", "q") in both[0]


def test_an_unlisted_source_still_counts(spark):
    e = spark.createDataFrame([("r", "a", "subgenre", "new", False, False), ("r", "b", "subgenres", None, False, True), ("r", "c", "related", "wikidata", False, False)], "from_id string, to_id string, relation string, source string, block_forward boolean, block_reverse boolean")
    got = {(r["src"], r["dst"]): round(r["w"], 6) for r in G.flow_edges(e).collect()}
    assert got == {("r", "a"): 0.82, ("a", "r"): 0.2788, ("r", "b"): 0.82}


def test_state_table_rewrites_touched_buckets_only(spark, tmp_path):
    empty = spark.createDataFrame([], "id string, n long")
    table = StateTable(spark, f"file://{tmp_path}/state", empty, ["id"], most=8)
    frame = lambda rows: spark.createDataFrame(rows, "id string, n long")

    def put(rows, batch):
        touched = table.touched(frame(rows), batch)
        table.write(table.read(batch, touched).join(frame(rows).select("id"), "id", "left_anti").union(frame(rows)), batch, touched)

    put([(f"k{i}", 0) for i in range(50)], 0)
    first = table.table.current()["parts"]
    for batch in range(1, 6):
        put([("k1", batch), ("k2", batch)], batch)
        put([("k1", batch), ("k2", batch)], batch)  # a batch that runs again
    got = {r["id"]: r["n"] for r in table.read().collect()}
    assert got == {f"k{i}": 5 if i in (1, 2) else 0 for i in range(50)}
    assert {r["id"]: r["n"] for r in table.read(5).collect()}["k1"] == 4
    last = table.table.current()["parts"]
    assert len(first) >= 7 and 1 <= sum(last.get(k) != v for k, v in first.items()) <= 2


def test_rebuild_keeps_one_whole_table(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    for n in (5, 3):
        sinks.rebuild(spark.range(n), path)
        assert sinks.rebuilt(spark, path, "id long").count() == n
    assert [p.name for p in tmp_path.iterdir()] == ["table"]


def test_weighted_quantiles_of_one_large_group(spark):
    """One group of all rows beside small ones: the same as a walk over the sorted values, and no task sorts the group alone."""
    rng = random.Random(6)
    rows = [("big", rng.randrange(3000), rng.randrange(4)) for _ in range(20_000)] + [(f"g{k % 40}", k, 1 + k % 3) for k in range(300)] + [(None, 1, 2), ("none", 5, None)]
    df = spark.createDataFrame(rows, "k string, v int, w long").repartition(9)
    at = {"low": 0.16, "mid": 0.5, "high": 0.84, "all": 1.0}
    got = {r["k"]: tuple(r[n] for n in at) for r in A.weighted_quantiles(df, ["k"], "v", "w", at).collect()}
    sums: dict = {}
    for k, v, w in rows:
        sums.setdefault(k, Counter())[v] += w or 0
    for k, c in sums.items():
        total, out = sum(c.values()), []
        for q in at.values():
            run = 0
            for v in sorted(c):
                run += c[v]
                if run >= q * total:
                    break
            out.append(v)
        assert got[k] == (tuple(out) if k != "none" else (None,) * 4)
    assert len(got) == len(sums)
    plan = A.weighted_quantiles(df, ["k"], "v", "w", at)._jdf.queryExecution().toString()
    assert "_part" in plan.split("Window")[1]


def test_decisions_of_many_files_keep_their_order(spark, tmp_path):
    rows = [(k, f"u{k % 7}", "keep" if k % 2 else "drop") for k in range(200)]
    df = spark.createDataFrame(rows, "line long, key string, decision string")
    json = F.to_json(F.struct("key", "decision", F.lit(0.9).alias("confidence"), F.lit("n").alias("note")))
    df.repartitionByRange(6, "line").sortWithinPartitions("line").select(json).write.text(f"file://{tmp_path}/lines")
    ok, bad = readers.decisions(spark, f"file://{tmp_path}/lines", ["keep", "drop"], df.select("key").distinct())
    assert {r["key"]: r["decision"] for r in ok.collect()} == {k: d for _, k, d in rows} and bad.count() == 0


def test_global_rank_counts_on(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 37).alias("v")).repartition(7)
    rows = global_rank(df, [F.desc("v"), F.asc("id")]).collect()
    order = sorted(range(1000), key=lambda i: (-(i % 37), i))
    assert {r["id"]: r["rank"] for r in rows} == {i: k + 1 for k, i in enumerate(order)} and {r["total"] for r in rows} == {1000}


def test_or_join_gives_every_pair_and_no_other(spark, tmp_path):
    rows = [(k, "red ring", 1, f"b{k}", 1.0) for k in (1, 2, 3)] + [(4, "nut", 2, "b1", 1.0), (5, "nut", 3, "b1", 1.0), (6, None, 1, None, 1.0), (7, None, 1, None, 1.0), (1, "red ring", 1, "b1", 1.0)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int, p_brand string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(map(tuple, registry.queries()["j8_or_join"](spark, str(tmp_path)).select("a", "b").collect()))
    assert got == [(1, 2), (1, 3), (1, 4), (1, 5), (2, 3), (4, 5)]

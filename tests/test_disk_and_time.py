"""Jobs that must not fill the disk nor repeat what is known: what is laid down, shuffled and left behind."""

import random
from collections import Counter

from pyspark.sql import functions as F
from test_scenarios import edge_frame, titles

from edgeloom.operators import edges as E
from edgeloom.operators import graph as G
from edgeloom.operators import reach as Reach
from edgeloom.operators import regions as R
from edgeloom.operators import textsim as T
from edgeloom.operators.staging import clustered, cut
from edgeloom.plans import registry


def shuffles(df) -> int:
    """Exchanges of the plan as it was run."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning")


def shuffle_blocks(spark) -> Counter:
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return Counter(b for b in blocks.mkString(" ").split() if b.startswith("shuffle_"))


def test_a_written_step_leaves_no_shuffle_files(spark):
    before = shuffle_blocks(spark)
    cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert not shuffle_blocks(spark) - before


def test_what_is_laid_down_by_a_key_is_not_shuffled_by_it(spark):
    rows = spark.range(500).select((F.col("id") % 50).alias("k"), "id")
    laid = clustered(rows.repartition(4, "k"), ["k"])
    assert sorted(map(tuple, laid.collect())) == sorted(map(tuple, rows.collect()))
    assert shuffles(laid.groupBy("k").count()) == 0


def test_affinity_with_a_source_dealt_over_salts(spark, monkeypatch):
    """Flows are laid down once, and a source of very many is dealt over several parts: the same mixes."""
    e = edge_frame(spark, [("r", "a"), ("q", "a"), *[("a", f"b{k}") for k in range(9)], ("b1", "c"), ("c", "a"), ("q", "c")]).withColumns({"block_forward": F.lit(False), "block_reverse": F.lit(False)})
    nodes, roots = titles(spark, ["r", "q", "a", "c", *[f"b{k}" for k in range(9)]]), titles(spark, ["r", "q"]).select("id")
    got = []
    for target in (10_000, 2):
        monkeypatch.setattr(G, "part_target", lambda df: target)
        got.append({(r["id"], r["root"]): round(r["value"], 9) for r in G.affinity(nodes, roots, G.flow_edges(e), 8).collect()})
        free, heavy = G._laid_flows(G.flow_edges(e))
        assert ("a" in {r["src"] for r in heavy.collect()}) == (target == 2)
        assert shuffles(free.groupBy("src", "_salt").count()) == 0
    assert got[0] == got[1] and ("b8", "q") in got[0]


def test_tfidf_by_bounds_and_in_passes(spark, monkeypatch):
    """Few listed terms, many passes: the same weights as with all terms listed; and the texts' bag is not shuffled again."""
    rng = random.Random(3)
    docs = spark.createDataFrame([(k, " ".join(f"w{int(rng.paretovariate(0.7)) % 40}" for _ in range(rng.randrange(60)))) for k in range(60)] + [(3, "w1 w2 more")], "id long, text string")
    bag = T.term_bag(docs, {"text": 1.0})
    got = []
    for listed, rows in ((200_000, 10**8), (3, 40)):
        monkeypatch.setattr(T, "LISTED", listed)
        monkeypatch.setattr(T, "PASS", rows)
        got.append({(r["id"], r["term"]): round(r["w"], 9) for r in T.tfidf(bag, most=7).collect()})
    assert got[0] == got[1] and len(got[0]) > 300 and max(Counter(k for k, _ in got[0]).values()) == 7
    assert shuffles(bag) == 1


def test_merge_scores_of_all_kinds_of_candidates(spark):
    """Each kind of candidate, several keys, keys that are held twice, and pairs that no candidate is made of."""
    frame = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    pairs = frame([("a", "b", 0.9), ("a", "c", 0.83)], "a string, b string, similarity double")
    aliases = frame([*[(i, f"m{k}") for i in "ad" for k in range(2)], *[(i, f"n{k}") for i in "bc" for k in range(5)], ("a", "o"), ("b", "o")], "id string, alias string")
    equal = frame([("a", "b"), ("x", "y")], "a string, b string")
    parents = frame([("a", "p1"), ("a", "p2"), ("b", "p1"), ("b", "p1"), ("b", "p2"), ("c", "p3"), ("d", None)], "id string, key string")
    children = frame([(i, k) for i in "ad" for k in range(9)] + [("e", 1)], "id string, key int")
    scores = T.merge_scores(pairs, aliases, {"parents": parents, "children": children}, equal, frame([("b", "e")], "a string, b string"))
    got = {(r["a"], r["b"]): r["score"] for r in scores.collect()}
    assert got == {("a", "b"): round(0.52 * 0.9 + 0.22 + 0.08 + 0.025 * 3, 8), ("a", "d"): round(0.08 * 2 + 0.02 * 4, 8), ("b", "c"): 0.24, ("b", "e"): 0.18}
    assert "Aggregate" not in scores._jdf.queryExecution().optimizedPlan().toString()  # pairs of aliases are never summed


def test_shared_parents_of_lists_in_parts(spark, monkeypatch):
    rng = random.Random(5)
    edges = [(f"p{rng.randrange(12)}", f"c{rng.randrange(40)}") for _ in range(300)] + [("hub", f"c{k}") for k in range(40)] + [("p1", None), (None, "c1"), ("p2", "lone")]
    df = spark.createDataFrame(edges, "from_id string, to_id string")
    held: dict = {}
    for p, c in set(edges):
        if p is not None and c is not None:
            held.setdefault(c, set()).add(p)
    want = {(a, b): len(held[a] & held[b]) for a in held for b in held if a < b and len(held[a] & held[b]) > 1}
    for entries, most in ((100_000, 10**8), (50, 10**8), (50, 400)):
        monkeypatch.setattr(E, "ENTRIES", entries)
        monkeypatch.setattr(E, "PASS", most)
        out = E.shared_parents(df)
        assert {(r["a"], r["b"]): r["shared"] for r in out.collect()} == want
        assert shuffles(out) <= 3


def test_or_join_does_not_shuffle_its_pairs(spark, tmp_path):
    """Distinct parts need no sum over pairs; a part of several rows still has each pair once."""
    kinds = "p_partkey long, p_name string, p_size int, p_brand string, p_retailprice double"
    rows = [(k, f"n{k % 3}", k % 2, f"b{k % 4}", float(k % 2)) for k in range(40)] + [(50, None, 1, "b1", None), (51, None, 1, "b1", 1.0)]
    want = lambda rows: sorted({(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and ((None not in (x[1], y[1]) and x[1:3] == y[1:3]) or (None not in (x[4], y[4]) and x[3:] == y[3:]))})
    for name, own in (("once", rows), ("several", [*rows, (3, "n1", 1, "b2", 0.0), (4, "n0", 0, "b3", 1.0), (50, "n1", 1, "b2", 0.0)])):
        spark.createDataFrame(own, kinds).write.parquet(f"{tmp_path}/{name}/part.parquet")
        out = registry.queries()["j8_or_join"](spark, f"{tmp_path}/{name}")
        assert sorted(map(tuple, out.select("a", "b").collect())) == want(own)
        if name == "once":
            assert "Aggregate [a#" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_titles_of_paths_without_a_row_for_each_step(spark):
    index = [("c", "b", "sub", None, 0, "a>b>c"), ("d", "b", "sub", "x", 1, "a>b>d"), ("a", "root", "root", "root", 0, "a"), ("e", "?", "sub", "x", 0, "?>e"), ("?", "!", "sub", "x", 0, "!>?")]
    df = spark.createDataFrame(index, "id string, parent_id string, relation string, source string, ordinal int, path string")
    nodes = titles(spark, list("abcde"))
    name = {r["id"]: r["title"] for r in nodes.collect()}
    out = R.reachable_parents(df, nodes, spark.createDataFrame([("b", 1999)], "id string, year int"))
    got = {r["id"]: (r["titles"], r["year"]) for r in out.collect()}
    of = lambda ids: " / ".join(name[i] for i in ids)
    assert got == {"c": (of("abc"), 1999), "d": (of("abd"), 1999), "a": (of("a"), None), "e": (of("e"), None)}
    assert "Generate posexplode" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_reach_of_small_pieces_beside_a_large_one(spark, monkeypatch):
    """Pieces that fit a row, one that is too large and one that is too long for the rounds: the same as by search."""
    rng = random.Random(9)
    edges = [(f"s{k}:{rng.randrange(6)}", f"s{k}:{rng.randrange(6)}") for k in range(30) for _ in range(6)]
    edges += [(f"big{k}", f"big{k * 7 % 30}") for k in range(30)] + [("big0", f"big{k}") for k in range(30)] + [(f"row{k:02}", f"row{k + 1:02}") for k in range(25)] + [("alone", None), (None, "end"), ("é", "z"), ("z", "é")]
    to: dict = {}
    for a, b in edges:
        for v in (a, b):
            to.setdefault(v, set())
        to[a].add(b)
    del to[None]

    def reached(v):
        seen, todo = {v}, [v]
        while todo:
            todo += [w for w in to[todo.pop()] if w is not None and w not in seen and not seen.add(w)]
        return len(seen), min(seen), max(seen)

    monkeypatch.setattr(Reach, "SMALL", 12)
    monkeypatch.setattr(Reach, "ROUNDS", 2)
    calls = []
    index = Reach.reach_index
    monkeypatch.setattr(Reach, "reach_index", lambda e: calls.append(e.count()) or index(e))
    df = spark.createDataFrame(edges, "from_id string, to_id string")
    got = {r["seed"]: (r["n"], r["least"], r["most"]) for r in Reach.summary(df, spark.createDataFrame([(v,) for v in to], "id string")).collect()}
    assert got == {v: reached(v) for v in to} and len(calls) == 1 and 30 <= calls[0] < 150

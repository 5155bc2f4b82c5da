"""Components and reach labels against plain searches; chains, rings and hubs."""

import random

from edgeloom.operators import graph as G
from edgeloom.operators import reach as R
from edgeloom.operators.regions import followed


def edge_frame(spark, pairs):
    return spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "from_id string, to_id string")


def below(pairs):
    out: dict = {}
    for a, b in pairs:
        out.setdefault(str(a), set()).add(str(b))
        out.setdefault(str(b), set())
    reached = {}
    for v in out:
        seen, todo = {v}, [v]
        while todo:
            for w in out[todo.pop()] - seen:
                seen.add(w)
                todo.append(w)
        reached[v] = seen
    return reached


def graphs():
    rng = random.Random(11)
    yield "empty", []
    yield "loop", [(1, 1), (1, 2)]
    for n, m in ((12, 14), (30, 40), (30, 90), (60, 70)):
        yield f"random{n}-{m}", [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    yield "grid", [((r, c), x) for r in range(5) for c in range(5) for x in ((r + 1, c), (r, c + 1)) if max(x) < 5]
    yield "hubs", [("h", k) for k in range(70)] + [("g", k) for k in range(0, 70, 2)] + [(3, "g")]


def test_reach_equals_a_search(spark):
    """All graphs side by side, so that one index answers for them."""
    pairs = [(f"{name}/{a}", f"{name}/{b}") for name, some in graphs() for a, b in some]
    e, want = edge_frame(spark, pairs), below(pairs)
    index = R.reach_index(e)
    scc = {r["id"]: r["scc"] for r in index.members.collect()}
    assert set(scc) == set(want)
    for v in want:
        assert scc[v] in want[v] and {w for w in want if scc[w] == scc[v]} == {w for w in want[v] if v in want[w]}
    seeds = spark.createDataFrame([(v,) for v in want], "id string")
    got = [(r["seed"], r["id"]) for r in R.reach(index, seeds).collect()]
    assert len(got) == len(set(got)) and set(got) == {(v, w) for v in want for w in want[v] if v != w}
    sums = {r["seed"]: (r["n"], r["least"], r["most"]) for r in R.reach_summary(index, seeds).collect()}
    assert sums == {v: (len(w), min(w), max(w)) for v, w in want.items()}


def test_reach_of_nothing(spark):
    index = R.reach_index(edge_frame(spark, []))
    assert index.members.count() == 0 and R.reach(index, spark.createDataFrame([("x",)], "id string")).count() == 0
    assert R.components(edge_frame(spark, []), spark.createDataFrame([("x",), (None,)], "id string")).collect() == [("x", "x")]


def test_shortcuts_equal_a_search(spark):
    rng = random.Random(3)
    pairs = list({(rng.randrange(25), rng.randrange(25)) for _ in range(60)} | {("h", k) for k in range(25)} | {(k, "h") for k in range(0, 25, 7)})
    out: dict = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    for depth in (2, 3, 5, 8):
        want = set()
        for a, b in pairs:
            level, hit = {w for w in out.get(a, ()) if w != a}, False
            for _ in range(depth - 1):
                level = {w for v in level for w in out.get(v, ()) if w != a}
                hit |= b in level
            if hit and a != b:
                want.add((str(a), str(b)))
        e = edge_frame(spark, pairs)
        assert {tuple(r) for r in G.shortcuts(e, e, depth).collect()} == want


def test_named_cycles_lie_within_components(spark):
    pairs = [("r", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "b"), ("c", "d"), ("d", "e"), ("x", "x")] + [(f"k{i}", f"k{i + 1}") for i in range(30)]
    got = {(r["length"], r["cycle"]) for r in G.named_cycles(edge_frame(spark, pairs), 4).collect()}
    assert got == {(3, "a>b>c"), (2, "b>c"), (1, "x")}


def test_merges_are_followed_to_their_ends(spark):
    """A chain of five, a tree, a loop of three with a tail, a loop of two, and a step to itself."""
    steps = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (7, 3), (8, 6), (30, 31), (31, 32), (32, 30), (40, 31), (41, 40), (51, 50), (50, 51), (60, 60)]
    got = {(r["old"], r["new"]) for r in followed(spark.createDataFrame(steps, "old int, new int")).collect()}
    assert got == {(k, 6) for k in (1, 2, 3, 4, 5, 7, 8)} | {(k, 30) for k in (31, 32, 40, 41)} | {(51, 50)}


def test_a_long_chain_a_hub_and_a_large_ring(spark):
    """10,000 nodes in a row, that end in a ring of 5,000 and in a hub: rounds stay few, and rows linear."""
    n, ring, leaves = 10_000, 5_000, 3_000
    chain = spark.range(n - 1).selectExpr("concat('c', id) as from_id", "concat('c', id + 1) as to_id")
    circle = spark.range(ring).selectExpr("concat('r', id) as from_id", f"concat('r', (id + 1) % {ring}) as to_id")
    hub = spark.range(leaves).selectExpr("'hub' as from_id", "concat('l', id) as to_id")
    more = spark.createDataFrame([(f"c{n - 1}", "r0"), ("r7", "hub"), ("c5", "l3")], "from_id string, to_id string")
    e = R.cut(chain.union(circle).union(hub).union(more), "graph")
    cuts, whole = [0], R.cut
    try:
        R.cut = lambda df, name: (cuts.append(1), whole(df, name))[1]
        index = R.reach_index(e)
    finally:
        R.cut = whole
    # a round of contraction takes a third of a chain and writes six tables: some 24 rounds; a search by levels would write 15,000 times
    assert sum(cuts) < 300
    total = n + ring + leaves + 1
    some = spark.createDataFrame([(f"c{k}",) for k in (0, 5, 6, 5000, n - 1)] + [("r3",), ("hub",), ("l3",)], "id string")
    got = {r["seed"]: r["n"] for r in R.reach_summary(index, some).collect()}
    assert got == {**{f"c{k}": total - k for k in (0, 5, 6, 5000, n - 1)}, "r3": ring + leaves + 1, "hub": leaves + 1, "l3": 1}
    assert index.spans.count() <= 2 * total
    assert R.reach(index, some.where("id in ('c9999', 'hub')")).count() == ring + 2 * leaves + 1
    all_pairs = R.reach_summary(index, e.select(R.F.col("from_id").alias("id"))).agg(R.F.sum("n")).first()[0]
    assert all_pairs == sum(total - k for k in range(n)) + ring * (ring + leaves + 1) + leaves + 1

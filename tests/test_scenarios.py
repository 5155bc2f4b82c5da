"""Small scenarios and invariants of the graph, ingest, extraction and year operators."""

import datetime as dt

from pyspark.sql import functions as F

from edgeloom.operators import edges as E
from edgeloom.operators import extract as X
from edgeloom.operators import graph as G
from edgeloom.operators import ingest as I
from edgeloom.operators import temporal as Y
from edgeloom.operators import textsim as T


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def edge_frame(spark, pairs, relation="subgenre", source="infobox"):
    return frame(spark, [(a, b, relation, source, 0, None) for a, b in pairs], "from_id string, to_id string, relation string, source string, ordinal int, evidence_relation string")


def titles(spark, ids):
    return frame(spark, [(i, i.upper()) for i in ids], "id string, title string")


def test_shortest_path_wins_and_longer_parent_stays(spark):
    e = edge_frame(spark, [("r", "a"), ("a", "b"), ("r", "b"), ("b", "a")])
    roots, names = titles(spark, ["r"]), titles(spark, ["r", "a", "b"])
    s = G.reachability(roots, e, names)
    assert {r["id"]: r["depth"] for r in s.collect()} == {"r": 1, "a": 2, "b": 2}
    p = G.parent_index(s, e, roots, names)
    assert {(r["id"], r["parent_id"], r["depth"]) for r in p.collect()} == {("r", "root", 1), ("a", "r", 2), ("b", "a", 3), ("b", "r", 2), ("a", "b", 3)}


def test_loops_and_depth_end_reachability(spark):
    chain = [(f"n{k}", f"n{k + 1}") for k in range(20)] + [("n5", "n0")]
    s = G.reachability(titles(spark, ["n0"]), edge_frame(spark, chain), titles(spark, [f"n{k}" for k in range(21)]), max_depth=4)
    assert sorted(r["depth"] for r in s.collect()) == [1, 2, 3, 4]


def test_cycle_edges_leave_no_cycle(spark):
    pairs = [("r", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "b"), ("d", "e"), ("e", "d")]
    e = edge_frame(spark, pairs)
    names = titles(spark, "r a b c d e".split())
    drop = G.cycle_edges(names.where("id = 'r'").select("id"), e, names, E.DISPLAY)
    left = {tuple(x) for x in pairs} - {(r["from_id"], r["to_id"]) for r in drop.collect()}
    done = set()
    while True:  # a graph without cycles can be taken apart from its ends
        ends = {a for a, _ in left} - {b for _, b in left}
        if not ends:
            break
        done |= ends
        left = {x for x in left if x[0] not in ends}
    assert not left and drop.where("reason = 'opposing'").count() == 1


def test_manual_edge_is_never_marked(spark):
    e = edge_frame(spark, [("a", "b")], source="manual_curation").union(edge_frame(spark, [("b", "a")]))
    assert G.opposing(e, E.DISPLAY).count() == 0


def test_affinity_sums_to_one_and_unreached_keep_nothing(spark):
    e = edge_frame(spark, [("r", "a"), ("q", "a"), ("a", "b")]).withColumns({"block_forward": F.lit(False), "block_reverse": F.lit(False)})
    nodes = titles(spark, "r q a b z".split())
    v = G.affinity(nodes, nodes.where("id in ('r', 'q')").select("id"), G.flow_edges(e), 6)
    total = {r["id"]: r["t"] for r in v.groupBy("id").agg(F.sum("value").alias("t")).collect()}
    assert set(total) == {"r", "q", "a", "b"} and all(abs(x - 1) < 1e-9 for x in total.values())


def test_shortcut_needs_two_steps(spark):
    e = edge_frame(spark, [("a", "b"), ("b", "c"), ("a", "c")])
    assert [tuple(r) for r in G.shortcuts(e, e, 8).collect()] == [("a", "c")]


def test_strong_components(spark):
    e = edge_frame(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "c"), ("f", "a")])
    got = {r["id"]: r["scc"] for r in G.components_by(e, titles(spark, "a b c d e f g".split())).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "c", "f": "f", "g": "g"}


def test_upsert_twice_changes_nothing(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    old = frame(spark, [("a", "h1", day(1), day(1), day(2)), ("b", None, day(1), day(1), None)], "id string, hash string, last_fetched_at timestamp, last_changed_at timestamp, deleted_at timestamp")
    new = frame(spark, [("a", "h1", day(5)), ("b", "h2", day(5)), ("c", None, day(5))], "id string, hash string, fetched_at timestamp")
    once = I.upsert(old, new)
    rows = {r["id"]: r for r in once.collect()}
    assert rows["a"]["last_changed_at"] == day(1) and rows["a"]["deleted_at"] is None and rows["b"]["last_changed_at"] == day(5) and rows["c"]["last_changed_at"] == day(5)
    assert sorted(map(str, I.upsert(once, new).collect())) == sorted(map(str, once.collect()))


def test_span_years():
    assert X.span_years("1966 in x; the 1980s") == [(0, 1966, 1966), (15, 1980, 1989)]
    assert [x[1:] for x in X.span_years("1960s – late 1970s")] == [(1960, 1979)]
    assert [x[1:] for x in X.span_years("early 1990s and the mid 2000s")] == [(1990, 1993), (2004, 2006)] or [x[1:] for x in X.span_years("early 1990s and the mid 2000s")] == [(1990, 2006)]
    assert [x[1:] for x in X.span_years("early 19th century")] == [(1800, 1833)] and X.span_years(None) == []


def test_naming_sentence_gives_no_year(spark):
    t = frame(spark, [(1, "summary", "It emerged in the early 1990s. The term was coined in 1999."), (2, "category", "1966 things")], "id int, source string, text string")
    got = {(r["id"], r["start"], r["end"], r["weight"]) for r in Y.observations(t).collect()}
    assert got == {(1, 1990, 1993, 7.5), (2, 1966, 1966, 0.65)}


def test_prose_cue_stops_at_the_clause(spark):
    rows = [("Acid jazz is a kind of jazz that came from house.", "Acid jazz", "jazz"), ("Acid jazz is a kind of jazz that came from house.", "Acid jazz", "house"), ("Jazz is old.", "Jazz", "old")]
    p = frame(spark, rows, "summary string, child_title string, parent_title string")
    assert [r["parent_title"] for r in T.prose_cues(p).collect()] == ["jazz"]


def test_mentions_longest_first(spark):
    docs = frame(spark, [(1, "New York City and York, in York"), (2, None)], "id int, text string")
    a = frame(spark, [("nyc", "New York City"), ("york", "York"), ("ny", "New York")], "owner string, alias string")
    assert {(r["id"], r["owner"], r["n"]) for r in T.mentions(docs, a).collect()} == {(1, "nyc", 1), (1, "york", 2)}


def test_empty_inputs(spark):
    e = edge_frame(spark, [])
    assert G.reachability(titles(spark, []), e, titles(spark, [])).count() == 0
    assert G.shortcuts(e, e).count() == 0 and G.named_cycles(e, 3).count() == 0

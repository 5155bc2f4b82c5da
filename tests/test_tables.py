"""Tables behind manifests: buckets that split, batches that are killed or repeated, readers between any two steps; salted joins."""

import pytest
from pyspark.sql import functions as F

from edgeloom.operators import textindex as I
from edgeloom.operators import textsim as S
from edgeloom.operators.extract import plain_text
from edgeloom.operators.skew import spread_join
from edgeloom.sources import manifest, sinks
from edgeloom.streaming.jobs import StateTable

SCHEMA = "id long, value string"


def rows(spark, lo, hi, value):
    return spark.range(lo, hi).select("id", F.concat(F.lit(value), F.col("id")).alias("value"))


def put(table, df, batch):
    """An upsert of df as a batch."""
    touched = table.touched(df, batch)
    table.write(table.read(batch, touched).join(df.select("id"), "id", "left_anti").select("id", "value").union(df.select("id", "value")), batch, touched)


def content(df):
    return {r["id"]: r["value"] for r in df.collect()}


def test_buckets_split_as_they_grow(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"), spark.createDataFrame([], SCHEMA), ["id"], most=100)
    want = {}
    for batch, (lo, hi) in enumerate([(0, 50), (20, 900), (10, 15), (850, 1500)]):
        put(table, rows(spark, lo, hi, f"b{batch}-"), batch)
        want |= {k: f"b{batch}-{k}" for k in range(lo, hi)}
        assert content(table.read()) == want
    parts = table.table.current()["parts"]
    sizes = [table.table.read(SCHEMA, parts=[p]).count() for p in parts]
    assert sum(sizes) == 1500 and max(sizes) <= 200 and len(parts) >= 15
    assert len(table.touched(rows(spark, 3, 4, "x"), 9)) == 1  # one key, one bucket


def test_killed_and_repeated_batches_give_the_same_table(spark, tmp_path, monkeypatch):
    table = StateTable(spark, str(tmp_path / "t"), spark.createDataFrame([], SCHEMA), ["id"], most=50)
    put(table, rows(spark, 0, 100, "a"), 0)
    put(table, rows(spark, 50, 300, "b"), 1)
    want = content(table.read())
    for step in ("commit", "_put"):
        with monkeypatch.context() as m:
            m.setattr(manifest.ManifestTable, step, lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
            with pytest.raises(RuntimeError):
                put(table, rows(spark, 0, 200, "c"), 2)
        assert content(table.read()) == want  # what the dead batch wrote is named by no manifest
    put(table, rows(spark, 0, 200, "c"), 2)
    want |= {k: f"c{k}" for k in range(200)}
    assert content(table.read()) == want
    put(table, rows(spark, 0, 200, "c"), 2)  # committed, but run again
    assert content(table.read()) == want and table.table.before(2)["batch"] == 1
    put(table, rows(spark, 299, 301, "d"), 3)
    assert content(table.read()) == want | {299: "d299", 300: "d300"}


def test_a_reader_sees_a_whole_table_between_any_two_steps(spark, tmp_path, monkeypatch):
    path, seen = str(tmp_path / "t"), []
    old, new = {k: f"o{k}" for k in range(40)}, {k: f"n{k}" for k in range(25)}
    sinks.rebuild(rows(spark, 0, 40, "o"), path)
    look = lambda: seen.append(content(sinks.rebuilt(spark, path, SCHEMA)))
    for step in ("_put", "stage", "commit", "_fs"):
        whole = getattr(manifest.ManifestTable, step)
        busy = []

        def around(self, *a, whole=whole, busy=busy):
            if not busy:
                busy.append(1)
                look()
                busy.clear()
            return whole(self, *a)

        with monkeypatch.context() as m:
            m.setattr(manifest.ManifestTable, step, around)
            sinks.rebuild(rows(spark, 0, 25, "n"), path)
        assert content(sinks.rebuilt(spark, path, SCHEMA)) == new
        sinks.rebuild(rows(spark, 0, 40, "o"), path)
    assert len(seen) > 10 and all(s in (old, new) for s in seen)
    spark.createDataFrame([(9, "stray")], SCHEMA).write.parquet(f"{path}/data/stray")
    assert content(sinks.rebuilt(spark, path, SCHEMA)) == old


def test_rebuild_of_partitions_only(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a=b/c"), (2, "x+y"), (3, None), (4, "null")], SCHEMA)
    sinks.rebuild(df, path, "value")
    sinks.rebuild(spark.createDataFrame([(5, "x+y"), (6, None), (7, "new")], SCHEMA), path, "value")
    assert content(sinks.rebuilt(spark, path, SCHEMA)) == {1: "a=b/c", 5: "x+y", 6: None, 4: "null", 7: "new"}
    sinks.rebuild(df.limit(0), path)
    assert sinks.rebuilt(spark, path, SCHEMA).count() == 0


def test_a_key_of_half_of_the_rows_is_dealt_over_tasks(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(keep, ("16", "false", "-1")):
            spark.conf.set(k, v)
        big = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id") % 5000).cast("long").alias("k"), F.col("id").alias("v"))
        big = big.union(spark.createDataFrame([(None, -1)], "k long, v long"))
        small = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
        joined = spread_join(big, small, ["k"])
        each = sorted(r["n"] for r in joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())
        assert sum(each) == 200_000 and each[-1] <= 2 * each[len(each) // 2]
        for how in ("inner", "left", "left_semi", "left_anti"):
            some = small.where("k % 3 = 1")
            a, b = spread_join(big, some, ["k"], how), big.join(some, "k", how)
            assert a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_plain_text_is_whole_unless_asked(spark):
    page = "".join(f"'''Word{k}''' [[Title {k}|link{k}]] {{{{t}}}}<ref>x</ref>\n" for k in range(5000))
    got = spark.createDataFrame([(page,)], "text string").select(plain_text("text").alias("a"), plain_text("text", 32_000).alias("b")).first()
    assert len(page) > 100_000 and got["a"].split() == [w for k in range(5000) for w in (f"Word{k}", f"link{k}")] and got["b"] == got["a"][:32_000]


def test_text_index_reads_only_its_words_partitions(spark, tmp_path):
    docs = spark.createDataFrame([(1, "The Blue Note", "blue blue note and more"), (2, "Red", "a note in blue, blue note"), (3, "blues", None), (4, "Blue note!", ""), (5, None, "nothing")], "id long, title string, text string")
    built = I.build_index(docs, ["title", "text"], str(tmp_path / "i"), 16)
    index, fields = I.open_index(spark, str(tmp_path / "i"), "long", 16), {"title": 2.0, "text": 1.0}
    for q in ("blue note", "blue", "more nothing", "blue blue", "absent"):
        want = [tuple(r) for r in S.search(docs, q, fields).collect()]
        assert [tuple(r) for r in I.search(index, q, fields).collect()] == want == [tuple(r) for r in I.search(built, q, fields).collect()]
    assert {(r["id"], r["n"]) for r in I.phrase(index, "blue note", "text").collect()} == {(1, 1), (2, 1)}
    assert {(r["id"], r["n"]) for r in I.phrase(index, "blue blue", "text").collect()} == {(1, 1), (2, 1)}
    plan = I.postings_of(index, ["blue"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,blue)" in plan
    dirs = {f.rsplit("bucket=", 1)[1].split("/")[0] for f in I.postings_of(index, ["blue"]).select(F.input_file_name().alias("f")).toPandas()["f"]}
    assert len(dirs) == 1

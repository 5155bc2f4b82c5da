"""Near-duplicates where an id names several texts, or none."""

import random

from test_pairs_and_pipeline import brute_components

import corpus_pipeline
from edgeloom.llm import ngram_join


def shared_ids():
    """Ten ids, each with two texts, and near copies of each: under ids of their own, and without an id."""
    rng = random.Random(3)
    rows = []
    for k in range(20):
        base = [f"w{rng.randrange(5000)}" for _ in range(120)]
        rows += [(k % 10, " ".join(base)), (100 + k if k % 3 else None, " ".join([*base[:-1], "other"]))]
        if k % 5 == 0:
            rows.append((None, " ".join([*base[:-2], "some", "more"])))
    lone = [f"v{k}" for k in range(90)]
    return [*rows, (None, " ".join(lone)), (None, " ".join([*lone[:-1], "end"])), (None, None), (7, ""), (7, " ")]


def test_jaccard_of_shared_and_null_ids(spark):
    rows = shared_ids()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, ngram_join.jaccard_components(df).collect()), key=str) == brute_components(rows)


def test_pipeline_keeps_one_row_of_each_component(spark):
    rows = shared_ids()
    df = spark.createDataFrame([*rows, *rows[:4]], "doc_id long, text string").repartition(4)
    got = dict(corpus_pipeline.STAGES)["ngram_jaccard"](spark, df, "").collect()
    firsts = [(k % 10, t) for k, t in enumerate(t for i, t in rows if i is not None and i < 10 and t.strip())]
    lone = [r["text"] for r in got if r["text"] and r["text"].startswith("v0 ")]
    left = [tuple(r) for r in got if not (r["text"] or "").startswith("v0 ")]
    assert len(lone) == 1 and sorted(left, key=str) == sorted([*firsts, (None, None), (7, ""), (7, " ")], key=str)

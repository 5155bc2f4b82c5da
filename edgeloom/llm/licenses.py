"""License scan of paragraphs: sparse word n-gram logistic regression, a calibrated unknown class, and template comparison.

DataFrame and SQL functions only. A paragraph ends at an empty line or at a line that ends a sentence; other line breaks are wraps,
and its lines are joined, without the marks that comments begin lines with. A prediction of the regression stands if the paragraph also holds ``least_overlap`` of
the word pairs of one of the family's templates; a template of a few words must also end the paragraph.

Candidates are the paragraphs that can pass that comparison: each template has cue words, so many that a paragraph without any of
them misses too many of the template's pairs. So the cues lose no result, and only candidates are scored.

A multinomial logistic regression with an L1 penalty (Spark's own) is fitted on the templates, on pieces of them, on all candidates
that hold nearly all of a template, and, as the unknown class, on the candidates that are far from every template and on the templates'
single words. No sample is taken: candidates of equal words are one row with a weight, and the weights are scaled so that those of the
candidates together are ``candidate_weight`` at most, which keeps a family that a large table hardly names learnable. Paragraphs that
are no candidates are never scored and not learned from. The features are the words, pairs and triples of the templates, hashed; what no
template holds speaks for no family. The probability that a prediction needs is calibrated on the half of the far candidates that was
not learned from: the highest probability that a family gets there, and ``least_probability`` at least.

Null and empty texts have no paragraphs and no licences. Every row of the documents gives one row, from its own text: repeated rows
are scanned alike and each counts its own paragraphs once, and so are rows that share an id. A probability or overlap of exactly
the bound passes; of equal probabilities the family that comes first by name wins. Very long texts are read whole. Columns other
than doc_id and text are not looked at. An empty table gives no rows.
"""

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import stage

UNKNOWN = "unknown"
# Sentences by which licences name themselves.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "licensed under the mit license"),
    ("apache", "licensed under the apache license version 2.0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl", "licensed under the mozilla public license version 2.0"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("boost", "distributed under the boost software license version 1.0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "released under the bsd license"),
    ("cc", "licensed under cc by nc 4.0"),
    ("cc", "this work is licensed under a creative commons attribution license"),
    ("cc", "licensed under cc by sa 4.0"),
    ("reserved", "all rights reserved"),
    ("reserved", "copyright all rights reserved"),
)
#: Templates of at most so many words have to end the paragraph: they are too short to be told from other sentences by their pairs.
SHORT = 4
# Words of the templates that no ordinary sentence is known by.
COMMON = "a and any by can except file free in is it may modify not of or person source terms the this to under use version with without work you".split()


_TASK_ROWS = 20_000  # of the regression's rows


@dataclass(frozen=True)
class LicenseParams:
    """candidate_weight: what all candidates of a kind (far from every template, or sure) weigh at most beside the templates' rows."""

    candidate_weight: int = 4_000
    features: int = 1 << 15
    penalty: float = 2e-4
    least_probability: float = 0.5
    least_overlap: float = 0.65
    sure_overlap: float = 0.9
    far_overlap: float = 0.4


def paragraphs(text: str):
    """The paragraphs of a text as an array; empty ones are left in their places."""
    bare = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?m)^[ \t]*(?:#+|//+|/?\*+/?|;+|--+)[ \t]?", "")
    joined = F.regexp_replace(bare, r"([^.!?:\s])[ \t]*\r?\n[ \t]*(?=\S)", "$1 ")
    return F.split(joined, "\n")


def words(c):
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}.]+|\.(?=\s|$)"), lambda w: w != "")


def grams(w):
    """Words, pairs and triples of a column of words."""

    def runs(n: int):
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))

    return F.concat(w, runs(2), runs(3))


def _pairs(template: str) -> list[str]:
    w = template.split()
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def cue_words(least_overlap: float) -> list[str]:
    """Words of which a paragraph must hold one to hold least_overlap of any template's pairs; telling words first, long ones first."""
    out: set[str] = set()
    for _, template in TEMPLATES:
        pairs, own = _pairs(template), set()
        for w in sorted(set(template.split()), key=lambda w: (w in COMMON, -len(w), w)):
            if len(pairs) - sum(any(x in own for x in pair.split()) for pair in pairs) < least_overlap * len(pairs):
                break
            own.add(w)
        out |= own
    return sorted(out)


def _overlaps(p: LicenseParams) -> dict:
    """For each family, the largest share of a template's pairs that the column ``grams`` holds; short templates end the ``words``."""
    out = {}
    for family in sorted({f for f, _ in TEMPLATES}):
        shares = []
        for t in (t for f, t in TEMPLATES if f == family):
            share, w = F.size(F.array_intersect("grams", F.lit(_pairs(t)))) / len(_pairs(t)), t.split()
            shares.append(F.when(F.slice("words", F.greatest(F.size("words") - 2, F.lit(1)), F.lit(3)) == F.lit(w[-3:]), share).otherwise(0.0) if len(w) <= SHORT else share)
        out[family] = F.greatest(*shares) if len(shares) > 1 else shares[0]
    return out


def candidates(docs: DataFrame, p: LicenseParams = LicenseParams()) -> DataFrame:
    """(doc_id, text_key, paragraph, words, grams, overlaps): the distinct paragraphs of rows of docs that hold a cue word."""
    cues = cue_words(p.least_overlap)
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    some = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(reduce(or_, [F.contains(low, F.lit(c)) for c in cues]))
    rows = some.select("doc_id", text_key().alias("text_key"), F.posexplode(paragraphs("text")).alias("paragraph", "line")).withColumn("words", words(F.col("line")))
    rows = rows.where(F.arrays_overlap("words", F.lit(cues))).drop("line").dropDuplicates(["doc_id", "text_key", "paragraph"]).withColumn("grams", grams(F.col("words")))
    return rows.withColumn("overlaps", F.struct(*[c.alias(f) for f, c in _overlaps(p).items()]))


def text_key():
    """Tells the texts of one doc_id apart."""
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))


def lessons(found: DataFrame, p: LicenseParams = LicenseParams()) -> tuple[DataFrame, int]:
    """(family, words, teach, weight) of all that is learned from or, without teach, calibrated on, and the number of rows about."""
    families = sorted({f for f, _ in TEMPLATES})
    each = [F.col(f"overlaps.{f}") for f in families]
    found = stage(found.groupBy("words").agg(F.count("*").alias("n"), F.first("overlaps").alias("overlaps")).withColumn("best", F.greatest(*each)), "license-sentences")
    is_far, is_sure = F.col("best") < p.far_overlap, F.col("best") >= p.sure_overlap
    rows, n_far, n_sure = found.agg(F.count("*"), F.sum(F.when(is_far, F.col("n"))), F.count_if(is_sure)).first()
    share = lambda n: F.lit(min(1.0, p.candidate_weight / max(n or 0, 1)))
    far = found.where(is_far).select(F.lit(UNKNOWN).alias("family"), "words", (F.pmod(F.xxhash64(F.concat_ws(" ", "words")), F.lit(2)) == 0).alias("teach"), (F.col("n") * share(n_far)).alias("weight"))
    named = F.element_at(F.array(*[F.lit(f) for f in families]), F.array_position(F.array(*each), F.col("best")).cast("int"))
    sure = found.where(is_sure).select(named.alias("family"), "words", F.lit(True).alias("teach"), share(n_sure).alias("weight"))
    single = sorted({w for _, t in TEMPLATES for w in t.split()})
    known = found.sparkSession.createDataFrame([*TEMPLATES, *((UNKNOWN, w) for w in single)], "family string, text string").withColumn("words", words(F.col("text"))).drop("text")
    cut = F.explode(F.expr("flatten(transform(sequence(0, greatest(size(words) - 4, 0)), i -> array(slice(words, i + 1, 4), slice(words, i + 1, size(words)), slice(words, 1, size(words) - i))))"))
    pieces = known.where(F.col("family") != UNKNOWN).select("family", cut.alias("words"))
    own = known.union(pieces).withColumns({"teach": F.lit(True), "weight": F.lit(1.0)})
    return own.union(far).union(sure), rows


def _features(p: LicenseParams):
    """Rows with words to rows with features: which of the templates' words, pairs and triples they hold."""
    hashing = HashingTF(inputCol="_grams", outputCol="_hashed", numFeatures=p.features, binary=True)
    runs = lambda w: [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    places = sorted({hashing.indexOf(g) for _, t in TEMPLATES for g in runs(t.split())})
    kept = VectorSlicer(inputCol="_hashed", outputCol="features", indices=places)
    return lambda df: kept.transform(hashing.transform(df.withColumn("_grams", grams(F.col("words"))))).drop("_grams", "_hashed")


def train(found: DataFrame, p: LicenseParams = LicenseParams()):
    """The fitted model, the families in the order of its classes, and the probability needed; found: all candidates."""
    families = [UNKNOWN, *sorted({f for f, _ in TEMPLATES})]
    index = F.element_at(F.create_map(*[x for k, f in enumerate(families) for x in (F.lit(f), F.lit(float(k)))]), F.col("family"))
    rows, n = lessons(found, p)
    rows = _features(p)(rows).select("teach", "weight", "features", index.alias("label")).coalesce(2 + n // _TASK_ROWS).cache()
    model = LogisticRegression(maxIter=40, regParam=p.penalty, elasticNetParam=1.0, family="multinomial", weightCol="weight").fit(rows.where("teach").select("features", "label", "weight"))
    held = model.transform(rows.where(~F.col("teach"))).select((1 - F.element_at(vector_to_array("probability"), 1)).alias("p"))
    most = held.agg(F.max("p")).first()[0]
    rows.unpersist()
    return model, families, max(p.least_probability, min(most or 0.0, 0.95))


def scan(docs: DataFrame, p: LicenseParams = LicenseParams()) -> DataFrame:
    """One row for each paragraph with a licence: doc_id, text_key, paragraph (from 0), family, probability, overlap."""
    found = stage(candidates(docs, p), "license-candidates")
    model, families, need = train(found, p)
    scored = model.transform(_features(p)(found)).withColumn("probabilities", F.slice(vector_to_array("probability"), 2, len(families) - 1))
    place = F.array_position("probabilities", F.array_max("probabilities")).cast("int")
    overlaps = F.array(*[F.col(f"overlaps.{f}") for f in families[1:]])
    scored = scored.select("doc_id", "text_key", "paragraph", F.element_at(F.lit(families[1:]), place).alias("family"), F.array_max("probabilities").alias("probability"), F.element_at(overlaps, place).alias("overlap"))
    return scored.where((F.col("probability") >= need) & (F.col("overlap") >= p.least_overlap))


def licenses(docs: DataFrame, p: LicenseParams = LicenseParams()) -> DataFrame:
    """doc_id, families (sorted, distinct), n_paragraphs, first_paragraph of every row of docs; no licence: empty, 0, null."""
    found = scan(docs, p).groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("family")).alias("families"), F.count("*").alias("n"), F.min("paragraph").alias("first"))
    found = found.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    out = docs.select("doc_id", text_key().alias("text_key")).join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    return out.select("doc_id", F.concat_ws(",", F.coalesce("families", F.array().cast("array<string>"))).alias("families"), F.coalesce("n", F.lit(0)).cast("long").alias("n_paragraphs"), F.col("first").cast("int").alias("first_paragraph"))

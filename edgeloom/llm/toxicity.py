"""Toxicity by a factorization machine over hashed terms.

A document's terms are its distinct lower-cased words and the words' beginnings of 4 and 5 letters, hashed. Two screens choose
the machine's terms. Alone: those that tell the classes apart by a G-test on the learning rows. In pairs: of the terms in at
least ``pair_share`` of those rows, those of which two together tell the classes apart, by ``min_pair_g`` better than each of them
does; so an insult and a group's name that say nothing alone come in together, and rare words of one kind by the beginning that they
share. A second-order factorization machine with
logistic loss then learns a weight for each term and a vector for each; the vectors' inner products are the pairwise
interactions that additive weights miss.

Null and empty texts have no terms: their score is the model's bias. Repeated rows are scored alike. Rows whose label or
id is null teach nothing; of several labels of an id the highest counts. A term at exactly a threshold is kept, so ties need no
order. Without learning rows of both classes the score is 0.5 less a little, or the classes' share, and no text changes it. Very
long texts are read whole; a term counts once however often it comes. A labelled id with many rows teaches by each text once; beyond
``max_rows`` rows a share of them is learned from, chosen by a hash of id and text. Columns other than doc_id and text are not looked at.
"""

import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import bounded_batches, discard, fold, stage

BITS = 22
WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class FMParams:
    """max_rows: the labelled rows that the model is fitted on at most (or so), chosen by a hash."""

    max_rows: int = 12_000
    min_rows: int = 3
    min_g: float = 12.0
    pair_share: float = 0.01
    min_pair_g: float = 40.0
    factors: int = 4
    steps: int = 150
    rate: float = 0.1
    decay: float = 2e-4
    seed: int = 7


@lru_cache(maxsize=50_000)
def _terms(word: str) -> tuple[int, ...]:
    mask = (1 << BITS) - 2  # the last bit keeps words and beginnings apart
    return (zlib.crc32(word.encode()) & mask, *(zlib.crc32(t.encode()) & mask | 1 for t in {"4" + word[:4], "5" + word[:5]}))


def term_ids(text: str | None) -> set[int]:
    out: set[int] = set()
    for w in set(WORD.findall(text.lower())) if text else ():
        out.update(_terms(w))
    return out


@dataclass
class FMModel:
    """bias, weights w and vectors v of the kept terms; the arrays' places are those of terms, sorted."""

    terms: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(r) for r in rows])
        flat = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
        row = np.repeat(np.arange(len(rows)), sizes)
        out = self.bias + np.bincount(row, self.w[flat], len(rows))
        for f in range(self.v.shape[1]):
            x = self.v[flat, f]
            out += 0.5 * (np.bincount(row, x, len(rows)) ** 2 - np.bincount(row, x * x, len(rows)))
        return out

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows), -40, 40)))


def _labelled(docs: DataFrame, labels: DataFrame, learn, p: FMParams) -> DataFrame:
    """(doc_id, text, y) of the learning rows, staged; the broadcast side holds max_rows ids or so, whatever the input."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    n = known.count()
    if n > p.max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * p.max_rows / n))
    rows = stage(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id").distinct(), "labelled")
    n = rows.count()
    if n > p.max_rows:
        rows._share = int((1 << 20) * p.max_rows / n)
    return rows


def _learned_from(rows: DataFrame) -> DataFrame:
    share = getattr(rows, "_share", None)
    return rows if share is None else rows.where(F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 20)) < share)


def train(docs: DataFrame, labels: DataFrame, learn=None, p: FMParams = FMParams()) -> FMModel:
    """Fit on rows of labels (doc_id, toxic) for which the column learn holds; docs has their doc_id and text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    staged = _labelled(docs, labels, F.lit(True) if learn is None else learn, p)
    try:
        return _trained(_learned_from(staged), p)
    finally:
        discard(staged)


def _trained(rows: DataFrame, p: FMParams) -> FMModel:
    def counts(batches):
        n = np.zeros((2, 1 << BITS), np.int32)
        total = [0, 0]
        for b in batches:
            for text, y in zip(b["text"], b["y"]):
                total[int(y > 0)] += 1
                n[int(y > 0), np.fromiter(term_ids(text), np.int64)] += 1
        at = np.flatnonzero(n.any(0))
        yield pd.DataFrame({"term": np.append(at, -1), "pos": np.append(n[1, at], total[1]), "neg": np.append(n[0, at], total[0])})

    each = rows.mapInPandas(counts, "term long, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    each = each.where((F.col("pos") + F.col("neg") >= p.min_rows) | (F.col("term") == -1))
    total = rows.agg(F.sum("y").alias("pos"), F.count("*").alias("n")).first()
    pos, n = int(total["pos"] or 0), int(total["n"])
    none = FMModel(np.zeros(0, np.int64), float(np.log((pos + 0.5) / (n - pos + 1.0))), np.zeros(0), np.zeros((0, p.factors)))
    if not 0 < pos < n:
        return none
    a, b = F.col("pos"), F.col("neg")

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    share = (a + b) / F.lit(float(n))
    g = 2 * (part(a, share * pos) + part(b, share * (n - pos)) + part(pos - a, (1 - share) * pos) + part(n - pos - b, (1 - share) * (n - pos)))
    frequent = a + b >= p.pair_share * n
    kept = each.where("term >= 0").select("term", (g >= p.min_g).alias("alone"), frequent.alias("frequent")).where("alone or frequent").toPandas().sort_values("term")
    terms, alone, often = kept["term"].to_numpy(np.int64), kept["alone"].to_numpy(bool), kept["frequent"].to_numpy(bool)
    if not len(terms):
        return none

    def encoded(batches):
        for b in batches:
            yield pd.DataFrame({"x": [_known(terms, t).astype("<i4").tobytes() for t in b["text"]], "y": b["y"]})

    data = sorted((bytes(r["x"]), r["y"]) for r in rows.mapInPandas(encoded, "x binary, y int").collect())
    found, y = [np.frombuffer(x, "<i4") for x, _ in data], np.array([y for _, y in data], float)
    chosen, line = alone.copy(), (np.cumsum(often) - 1).astype(np.int32)
    chosen[often] |= interacting([line[r[often[r]]] for r in found], y > 0, int(often.sum()), p)
    if not chosen.any():
        return none
    place = np.cumsum(chosen) - 1
    return _fit(terms[chosen], [place[r[chosen[r]]] for r in found], y, p)


def g_test(pos: np.ndarray, seen: np.ndarray, all_pos: int, n: int) -> np.ndarray:
    """G of being seen in ``seen`` of n rows, of which ``pos`` of the all_pos positive ones."""

    def part(x, expected):
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(expected, 1e-9)), 0.0)

    share = seen / n
    return 2 * (part(pos, share * all_pos) + part(seen - pos, share * (n - all_pos)) + part(all_pos - pos, (1 - share) * all_pos) + part(n - all_pos - seen + pos, (1 - share) * (n - all_pos)))


def interacting(rows: list[np.ndarray], positive: np.ndarray, size: int, p: FMParams, block: int = 256) -> np.ndarray:
    """Which of ``size`` terms are in a pair that tells the classes apart better than both its terms; exact counts of all pairs.

    The terms' number is bounded by the terms of a row over pair_share, the rows' by max_rows.
    """
    n, all_pos = len(rows), int(positive.sum())
    bits = np.zeros((size, -(-n // 8)), np.uint8)  # a line a term, positive rows first
    for i, k in enumerate(np.argsort(~positive, kind="stable").tolist()):
        bits[rows[k], i >> 3] |= 128 >> (i & 7)
    bits, which = np.unique(bits, axis=0, return_inverse=True)  # terms of the same rows are alike
    out = np.zeros(len(bits), bool)
    some = lambda i: np.unpackbits(bits[i : i + block], axis=1, count=n).astype(np.float32)
    own = np.concatenate([np.zeros(0), *(g_test(x[:, :all_pos].sum(1, dtype=float), x.sum(1, dtype=float), all_pos, n) for x in map(some, range(0, len(bits), block)))])
    for i in range(0, len(bits), block):
        a = some(i)
        for j in range(i, len(bits), block):
            b = a if j == i else some(j)
            both = (a[:, :all_pos] @ b[:, :all_pos].T).astype(float)
            g = g_test(both, both + a[:, all_pos:] @ b[:, all_pos:].T, all_pos, n)
            better = g - np.maximum(own[i : i + block, None], own[None, j : j + block]) >= p.min_pair_g
            out[i : i + block] |= better.any(1)
            out[j : j + block] |= better.any(0)
    return out[which.reshape(-1)]


def _known(terms: np.ndarray, text: str | None) -> np.ndarray:
    ids = np.fromiter(term_ids(text), np.int64)
    at = np.minimum(np.searchsorted(terms, ids), max(len(terms) - 1, 0))
    return np.sort(at[terms[at] == ids]) if len(terms) and len(ids) else np.zeros(0, np.int64)


def _fit(terms: np.ndarray, rows: list[np.ndarray], y: np.ndarray, p: FMParams) -> FMModel:
    """Adam on the mean logistic loss of all rows, with weight decay."""
    m, n = len(terms), len(rows)
    flat = np.concatenate(rows)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    pos = y.mean()
    theta = np.concatenate([[np.log((pos + 1e-3) / (1 - pos + 1e-3))], np.zeros(m), np.random.default_rng(p.seed).normal(0, 0.05, m * p.factors)])
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, p.steps + 1):
        model = FMModel(terms, theta[0], theta[1 : m + 1], theta[m + 1 :].reshape(m, p.factors))
        err = (1 / (1 + np.exp(-np.clip(model.raw(rows), -40, 40))) - y) / n
        grad = np.concatenate([[err.sum()], np.bincount(flat, err[row], m), np.zeros(m * p.factors)])
        gv = grad[m + 1 :].reshape(m, p.factors)
        for f in range(p.factors):
            x = model.v[flat, f]
            gv[:, f] = np.bincount(flat, err[row] * (np.bincount(row, x, n)[row] - x), m)
        grad[1:] += p.decay * theta[1:]
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
        theta = theta - p.rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return FMModel(terms, float(theta[0]), theta[1 : m + 1], theta[m + 1 :].reshape(m, p.factors))


def score(docs: DataFrame, model: FMModel) -> DataFrame:
    """docs with toxicity_score (0 to 1) and n_terms, the model's terms found; all texts are read whole."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("score double, n_terms int")
    def scored(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        rows = [_known(m.terms, t) for t in texts]
        return pd.DataFrame({"score": m.score(rows), "n_terms": [len(r) for r in rows]})

    return docs.withColumn("_toxicity", scored("text")).withColumns({"toxicity_score": F.col("_toxicity.score"), "n_terms": F.col("_toxicity.n_terms")}).drop("_toxicity")


def toxicity(docs: DataFrame, labels: DataFrame, p: FMParams = FMParams()) -> DataFrame:
    """doc_id, held_out, score, predicted, n_terms for every row of docs."""
    model = train(docs, labels, fold("doc_id", 5) != 0, p)
    return score(docs.select("doc_id", "text"), model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= 0.5).cast("int").alias("predicted"), "n_terms")

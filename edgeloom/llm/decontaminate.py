"""Benchmark decontamination by a generalised suffix automaton of words.

The automaton accepts all runs of words of all items. A document's words stream through it, which gives at each word the
longest run that ends there and occurs in an item. A run of ``window`` words or more hits its words, and so does a whole item
of fewer words. Between words that never follow each other in an item the automaton can hold one word at most, so it is only
fed the stretches between such places; they are found by numpy for a batch at once, by 64-bit hashes of the words. A stretch goes
through the automaton as the words themselves, so the result doesn't rest on hashes being unique.

Words are lower-cased (A-Z) runs of the bytes 0-9, a-z and above 0x7F. Null and empty texts have no words; items without words
match nothing; a null item id counts as the empty text; repeated items count once. Every row of the documents gives a row.

The automaton is built from blocks of items of at most ``block_words`` words, so what is broadcast is bounded; a larger set of
items takes several passes, whose spans are merged.
"""

import itertools
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import bounded_batches, lowered, packed, pieces, utf8, word_hashes, word_places

IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class DecontaminationParams:
    """window: words of a run that counts; max_coverage: share of a document's words hit above which it is rejected whole."""

    window: int = 10
    max_coverage: float = 0.5
    block_words: int = 400_000


def placed_words(texts: pa.Array):
    """(bytes, begins, ends, counts by row) of the words of consecutive row ranges."""
    data, offsets = utf8(texts)
    for a, b in pieces(offsets):
        yield data, *word_places(data, offsets[a : b + 1], IS_WORD)


def item_words(text: str) -> list[bytes]:
    return [lowered(data, a, b) for data, starts, ends, _ in placed_words(pa.array([text])) for a, b in zip(starts.tolist(), ends.tolist())]


def hashes_of(words: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return word_hashes(np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) if words else np.zeros(0, np.uint64)


@dataclass
class Automaton:
    """A generalised suffix automaton of item words, and the hashes that find what may match.

    words: numbers of the items' words; vocabulary, pairs: hashes of words, sorted, and pairs of their places that follow each
    other; step, link, length: the states; hits: items by state of a window; whole: (words, items) by state.
    """

    window: int
    words: dict[bytes, int]
    vocabulary: np.ndarray
    pairs: np.ndarray
    shortest: int
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    hits: dict[int, set[str]] = field(default_factory=dict)
    whole: dict[int, dict[int, set[str]]] = field(default_factory=dict)

    @classmethod
    def build(cls, items: list[tuple[str, list[bytes]]], window: int) -> "Automaton":
        """items: ids and words."""
        items = [(i, w) for i, w in items if w]
        numbers: dict[bytes, int] = {}
        for _, ws in items:
            for w in ws:
                numbers.setdefault(w, len(numbers))
        hashes = hashes_of(list(numbers))
        vocabulary = np.unique(hashes)
        place = np.searchsorted(vocabulary, hashes)
        words = [(i, [numbers[w] for w in ws]) for i, ws in items]
        pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *(place[w[:-1]] * len(vocabulary) + place[w[1:]] for _, w in words if len(w) > 1)]))
        out = cls(window, numbers, vocabulary, pairs, min([window, *(len(w) for _, w in words)]))
        for seq in {tuple(w) for _, w in words}:
            last = 0
            for c in seq:
                last = out._extend(last, c)
        for item, seq in words:
            state = 0
            for n, c in enumerate(seq, 1):
                state = out.step[state][c]
                if n >= window:
                    out.hits.setdefault(out.suffix(state, window), set()).add(item)
            if len(seq) < window:
                out.whole.setdefault(state, {}).setdefault(len(seq), set()).add(item)
        return out

    def _new(self, length: int, step: dict, link: int) -> int:
        self.length.append(length)
        self.step.append(step)
        self.link.append(link)
        return len(self.length) - 1

    def _extend(self, last: int, c: int) -> int:
        """The state of the text so far and one more word; texts start at state 0."""
        step, link, length = self.step, self.link, self.length
        known = step[last].get(c)
        if known is not None:
            return known if length[known] == length[last] + 1 else self._split(last, c, known)
        made = self._new(length[last] + 1, {}, 0)
        at = last
        while at != -1 and c not in step[at]:
            step[at][c] = made
            at = link[at]
        if at != -1:
            after = step[at][c]
            link[made] = after if length[after] == length[at] + 1 else self._split(at, c, after)
        return made

    def _split(self, at: int, c: int, state: int) -> int:
        twin = self._new(self.length[at] + 1, dict(self.step[state]), self.link[state])
        self.link[state] = twin
        while at != -1 and self.step[at].get(c) == state:
            self.step[at][c] = twin
            at = self.link[at]
        return twin

    def suffix(self, state: int, n: int) -> int:
        """The state that holds the last n words of a longer run of this state."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def spans(self, words: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word places [start, end) that are hit, merged, and the items that hit them."""
        out: list[tuple[int, int]] = []
        items: set[str] = set()
        state = n = 0
        for i, c in enumerate(words, 1):
            while state and c not in self.step[state]:
                state = self.link[state]
                n = self.length[state]
            if c in self.step[state]:
                state, n = self.step[state][c], n + 1
            if n < self.shortest:
                continue
            widest = 0
            if n >= self.window:
                at = self.suffix(state, self.window)
                items |= self.hits[at]
                widest = self.window
            at = state
            while self.whole and at:
                for k, found in self.whole.get(at, {}).items():
                    if k <= n:
                        items |= found
                        widest = max(widest, k)
                at = self.link[at]
            if widest:
                start = i - widest
                while out and out[-1][1] >= start:
                    start = min(start, out.pop()[0])
                out.append((start, i))
        return out, items

    def scan(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
        """Spans and items by row, of the rows that have any."""
        if not len(self.vocabulary) or not len(starts):
            return {}
        hashes = word_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == hashes
        row = np.repeat(np.arange(len(counts)), counts)
        joined = np.zeros(len(at) + 1, bool)  # whether a word can go on from the one before it
        pair = at[:-1] * len(self.vocabulary) + at[1:]
        place = np.minimum(np.searchsorted(self.pairs, pair), max(len(self.pairs) - 1, 0))
        if len(self.pairs):
            joined[1:-1] = (self.pairs[place] == pair) & known[:-1] & known[1:] & (row[:-1] == row[1:])
        first = np.flatnonzero(known & ~joined[:-1])
        end = np.flatnonzero(known & ~joined[1:]) + 1
        long = end - first >= self.shortest
        begin = np.concatenate([[0], np.cumsum(counts)])
        out: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        for a, b in zip(first[long].tolist(), end[long].tolist()):
            spans, items = self.spans([self.words.get(lowered(data, i, j), -1) for i, j in zip(starts[a:b].tolist(), ends[a:b].tolist())])
            if spans:
                r = int(row[a])
                own = out.setdefault(r, ([], set()))
                own[0].extend((a - int(begin[r]) + s, a - int(begin[r]) + e) for s, e in spans)
                own[1].update(items)
        return out


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and out[-1][1] >= s:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _blocks(benchmark: DataFrame, p: DecontaminationParams):
    """Automata of the items, one after another; the driver holds the words of one block at a time."""
    own: list[tuple[str, list[bytes]]] = []
    total = 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").where(F.col("text").isNotNull()).orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        words = item_words(r["text"])
        if own and total + len(words) > p.block_words:
            yield Automaton.build(own, p.window)
            own, total = [], 0
        own.append((r["item_id"], words))
        total += len(words)
    yield Automaton.build(own, p.window)


def _cleaned(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans; what stood around a span is kept apart by a line break."""
    at = [m.span() for m in WORD.finditer(text)]
    out, last = [], 0
    for s, e in spans:
        out.append(text[last : at[s][0]])
        last = at[e - 1][1]
    out.append(text[last:])
    return "\n".join(out)


_FOUND = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def _scanned(docs: DataFrame, automaton: Automaton, columns: list[str]) -> DataFrame:
    """The columns of docs with n_words, spans and items by one automaton."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    kinds = dict(docs.dtypes)

    def run(batches):
        for b in batches:
            n_words, spans, items = [], [], []
            for data, starts, ends, counts in placed_words(b.column(b.num_columns - 1)):
                found = shared.value.scan(data, starts, ends, counts)
                for r, n in enumerate(counts.tolist()):
                    s, i = found.get(r, ((), ()))
                    n_words.append(n)
                    spans.append([{"start": a, "end": e} for a, e in merged(s)])
                    items.append(sorted(i))
            pair = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            new = [pa.array(n_words, pa.int64()), pa.array(spans, pair), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], [*columns, "n_words", "spans", "items"])

    return docs.select(*columns, F.col("text").cast("string").alias("_text")).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", " + _FOUND)


def contamination(docs: DataFrame, benchmark: DataFrame, p: DecontaminationParams = DecontaminationParams(), columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of docs with n_words, spans (hit word places, merged) and items (ids) of every whole text."""
    bounded_batches(docs.sparkSession)
    columns = list(columns)
    blocks = _blocks(benchmark, p)
    whole, second = next(blocks), next(blocks, None)
    if second is None:
        return _scanned(docs, whole, columns)
    # spans depend on nothing but the text; a null text has no words, as an empty one
    keyed = docs.withColumn("_key", F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256))
    out, more = _scanned(keyed, whole, [*columns, "_key"]), None
    for automaton in itertools.chain([second], blocks):
        part = _scanned(keyed.select("_key", "text").dropDuplicates(["_key"]), automaton, ["_key"]).where(F.size("spans") > 0).select("_key", "spans", "items")
        more = part if more is None else more.union(part)
    more = more.groupBy("_key").agg(F.flatten(F.collect_list("spans")).alias("more_spans"), F.flatten(F.collect_list("items")).alias("more_items"))
    joined = out.join(more, "_key", "left")

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def union(each: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b} for a, b in merged((s["start"], s["end"]) for s in spans)] for spans in each], dtype=object)

    spans = F.when(F.col("more_spans").isNull(), F.col("spans")).otherwise(union(F.concat("spans", F.coalesce("more_spans", F.array().cast("array<struct<start:int,end:int>>")))))
    items = F.array_sort(F.array_union("items", F.coalesce("more_items", F.array().cast("array<string>"))))
    return joined.select(*columns, "n_words", spans.alias("spans"), items.alias("items"))


def report(docs: DataFrame, benchmark: DataFrame, p: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs."""
    found = contamination(docs.select("doc_id", "text"), benchmark, p)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, p: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """docs without the hit spans, and without the documents of which more than max_coverage is hit.

    n_chars, if there, is counted anew for texts that change. One pass takes out all runs that the text holds; words on both sides
    of a cut are not held against an item together.
    """
    found = contamination(packed(docs, "doc_id", "text"), benchmark, p, ("_row",))
    n_hit = F.aggregate("spans", F.lit(0), lambda n, s: n + (s["end"] - s["start"]))
    found = found.where(n_hit <= p.max_coverage * F.col("n_words"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if not len(s) else _cleaned(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(texts, spans)], dtype=object)

    hit, old = F.size("spans") > 0, F.col("_row.text")
    out = found.withColumn("_text", F.when(hit, cut(old, "spans")).otherwise(old))
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return out.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])

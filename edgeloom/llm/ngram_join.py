"""Exact Jaccard join of word n-gram sets by prefix filters under several global orders.

Two sets of Jaccard similarity t or more share a token among the first n - ceil(t n) + 1 of each, under any order that all
sets agree on. The first order is by rarity, so that tokens of only one set, which join nothing, fill most prefixes and
common passages come last; two more orders are by seeded hashes. A candidate must share a prefix token under all three: the
first order's lists give the pairs, the other orders' prefixes, kept as 32-bit prints for each class, thin them out, and texts are
fetched and compared only for the pairs that are left.

How it runs: documents of equal sets are one class. Token counts come from numpy blocks that are shuffled by hash range;
tokens with a large share of all set members are found beforehand (their number is bounded by the share), rank last, and never
meet in a range. A token's list is not expanded into pairs: first each class is compared with the list's pivot, then only
classes that ended in another component than the pivot are compared with the rest. So every link between different classes is
either found or joins two classes of one component, and components are exact. Keys that many rows share (a token's list, a
class of many copies, a large component) are dealt over several tasks (``spread_join``).

Sets of up to SMALL tokens are ordered by rarity over all tokens; for larger sets the tokens of a fixed hash region come
first, by rarity, and the prefix lies within it. Sets between the two sizes take part in both orders.

Tokens are 64-bit hashes of shingles. Classes are told apart by 128 bits: a class's number is the first half, or, where another
class has the same first half, the second.

Null texts and texts without words have the empty set, are linked with nothing, and are a component of their own. A text of
fewer than k words has one shingle, the sequence. Repeated rows are equal sets. A row with a null id takes part in linking;
its component is the smallest id that is not null, or null. An id may name several texts: each row is linked by its own text.
Columns other than doc_id and text are not looked at, so they may have any name. An empty table gives no rows.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.common import bounded_batches, discard, hashed_words, mix, part_target, pieces, spread_join, stage, utf8
from edgeloom.llm.graph import components

IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_PLACES = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
_LAST = np.uint64(0xA0761D6478BD642F)
_ORDERS = (np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3))
SMALL = 512
REGION = int(0.3 * (1 << 32))
HEAVY_SHARE, HEAVY_LEAST = 100_000, 64
COUNTERS = 1 << 17


def shingle_sets(texts: pa.Array, k: int):
    """For each text its distinct shingles as sorted 64-bit hashes."""
    data, offsets = utf8(texts)
    for a, b in pieces(offsets):
        words, counts = hashed_words(data, offsets[a : b + 1], IS_WORD)
        n = len(words) - k + 1
        grams = np.zeros(max(n, 0), np.uint64)
        for i in range(k if n > 0 else 0):
            grams += words[i : i + n] * _PLACES[i]
        grams = mix(grams)
        at = 0
        for c in counts.tolist():
            if c >= k:
                yield np.unique(grams[at : at + c - k + 1])
            elif c:
                yield mix((words[at : at + c] * _PLACES[:c]).sum(keepdims=True) + _LAST * np.uint64(c))
            else:
                yield words[:0]
            at += c


def prefix_length(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def class_keys(tokens: np.ndarray) -> tuple[int, int]:
    """The two halves of a set's 128-bit key."""
    digest = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def class_number(tokens: np.ndarray, clash: dict[int, int]) -> int:
    """clash: first halves that several classes have, with the second half of the class that keeps it."""
    first, second = class_keys(tokens)
    return second if first in clash and clash[first] != second else first


def prints(tokens: np.ndarray, percent: int) -> bytes:
    """The prefixes under the two hash orders, one after the other, as 32-bit prints."""
    need = prefix_length(len(tokens), percent)
    return b"".join((np.partition(mix(tokens ^ seed), need - 1)[:need] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() for seed in _ORDERS)


def prints_meet(a: bytes, b: bytes) -> bool:
    """Whether the prefixes share a print under each order."""
    x, y = np.frombuffer(a, "<u4").reshape(2, -1), np.frombuffer(b, "<u4").reshape(2, -1)
    return bool(np.isin(x[0], y[0]).any() and np.isin(x[1], y[1]).any())


class Frequent:
    """Bounded counts of tokens: what was seen more often than all tokens together / COUNTERS is kept, its count never too high."""

    def __init__(self):
        self.tokens, self.counts, self.total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0

    def add(self, tokens: np.ndarray) -> None:
        self.total += len(tokens)
        own, n = np.unique(tokens, return_counts=True)
        tokens, at = np.unique(np.concatenate([self.tokens, own]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([self.counts, n]), len(tokens)).astype(np.int64)
        if len(tokens) > COUNTERS:
            counts = counts - np.partition(counts, len(counts) - COUNTERS - 1)[len(counts) - COUNTERS - 1]
            tokens, counts = tokens[counts > 0], counts[counts > 0]
        self.tokens, self.counts = tokens, counts

    def common(self) -> tuple[np.ndarray, np.ndarray]:
        often = self.counts >= max(2, self.total // (2 * HEAVY_SHARE))
        return self.tokens[often], self.counts[often]


def text_hash():
    """Tells apart the texts that share a doc_id."""
    return F.xxhash64(F.col("text").cast("string"))


_FOUND = "own long, cls long, second long, n long, prints binary, token long, seen long"


def _classes(docs: DataFrame, k: int, percent: int, id_type: str) -> DataFrame:
    """Rows of all documents (doc_id, own, a hash of the text, both halves of the class's key, size and prints), and rows
    (token, seen) of the tokens that are common in a task's share of them."""
    names = ["doc_id", *(c.split()[0] for c in _FOUND.split(", "))]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    def run(batches):
        frequent, kind = Frequent(), None
        for b in batches:
            kind = b.column(0).type
            keys, n, views, tokens = [], [], [], [np.zeros(0, np.uint64)]
            for s in shingle_sets(b.column(1), k):
                n.append(len(s))
                keys.append(class_keys(s) if len(s) else (None, None))
                views.append(prints(s, percent) if len(s) else None)
                tokens.append(s)
            none = [None] * len(n)
            columns = [b.column(2), *zip(*keys), n, views, none, none] if keys else [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types))], names)
            frequent.add(np.concatenate(tokens))
        token, seen = frequent.common()
        if len(token):
            nulls = [pa.nulls(len(token), t) for t in types[:5]]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(token), kind), *nulls, pa.array(token.view(np.int64)), pa.array(seen)], names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text"), text_hash().alias("own")).mapInArrow(run, f"doc_id {id_type}, {_FOUND}")


def _blocks(docs: DataFrame, k: int, percent: int, heavy, clash, ranges: int) -> DataFrame:
    """Packed tokens by side and hash range: each token and its row's place; class, size and tokens ranked of each row."""

    def pack(side, key, tokens, idx, info):
        rows, idx = np.unique(idx, return_inverse=True)
        return side, key, tokens.astype("<u8").tobytes(), idx.astype("<u4").tobytes(), *(x[rows].tobytes() for x in info)

    def run(batches):
        common = heavy.value
        for batch in batches:
            sides = ([], [])
            for s in shingle_sets(batch.column(0), k):
                n = len(s)
                for side in (0, 1):
                    if n and (n <= SMALL if side == 0 else 100 * n > percent * SMALL):
                        sides[side].append(s)
            out = []
            for side, sets in enumerate(sides):
                if not sets:
                    continue
                kept, rows, info, hot = [], [], [], []
                for row, s in enumerate(sets):
                    n = len(s)
                    need = prefix_length(n, percent)
                    at = np.minimum(np.searchsorted(common, s), max(len(common) - 1, 0))
                    is_hot = common[at] == s if len(common) else np.zeros(n, bool)
                    x = mix(s ^ (_ORDERS[0] + np.uint64(side)))
                    rare = x[~is_hot]
                    take = np.ones(len(rare), bool) if side == 0 else (rare >> np.uint64(32)) < np.uint64(REGION)
                    z = int(take.sum())
                    if z < min(need, len(rare)):
                        more = np.flatnonzero(~take)
                        take[more[np.argsort(rare[more])[: need - z]]] = True
                    kept.append(rare[take])
                    rows.append(np.full(int(take.sum()), row))
                    info.append((class_number(s, clash.value), n, z))
                    if len(rare) < need:
                        first = np.sort(x[is_hot])[: need - len(rare)]
                        hot.append((row, first, np.arange(len(rare), len(rare) + len(first))))
                tokens, row = np.concatenate(kept), np.concatenate(rows)
                key = (tokens & np.uint64(ranges - 1)).astype(np.int64)
                cls, n, z = (np.array(c, t) for c, t in zip(zip(*info), ("<i8", "<i4", "<i4")))
                order = np.argsort(key, kind="stable")
                cuts = np.flatnonzero(np.diff(key[order])) + 1
                for part in np.split(order, cuts) if len(order) else ():
                    out.append((*pack(side, int(key[part[0]]) * 2 + side, tokens[part], row[part], (cls, n, z)), None, None))
                if hot:
                    r = np.concatenate([np.full(len(f), row) for row, f, _ in hot])
                    where = -1 - int(cls[0]) % ranges
                    out.append((*pack(side, where, np.zeros(len(r)), r, (cls, n, z)), np.concatenate([f for _, f, _ in hot]).astype("<u8").tobytes(), np.concatenate([p for *_, p in hot]).astype("<i4").tobytes()))
            if out:
                types = [pa.int32(), pa.int64(), *[pa.binary()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["side", "key", "tokens", "idx", "cls", "n", "z", "hot", "pos"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "side int, key long, tokens binary, idx binary, cls binary, n binary, z binary, hot binary, pos binary")


_POSTING = "side int, tok long, cls long, n int, z int, late int, df int, pos int"


def _lists(table: pa.Table) -> pa.Table:
    """Of one hash range, the tokens that two classes or more have, each with its classes; heavy tokens pass through."""
    cols = {c: table.column(c).to_pylist() for c in table.column_names}
    parts = []
    for i in range(len(table)):
        idx = np.frombuffer(cols["idx"][i], "<u4")
        info = [np.frombuffer(cols[c][i], t)[idx] for c, t in (("cls", "<i8"), ("n", "<i4"), ("z", "<i4"))]
        parts.append((np.frombuffer(cols["tokens"][i], "<u8"), *info))
    tok, cls, n, z = map(np.concatenate, zip(*parts))
    side, key = cols["side"][0], cols["key"][0]
    if key < 0:
        tok = np.concatenate([np.frombuffer(x, "<u8") for x in cols["hot"]])
        pos = np.concatenate([np.frombuffer(x, "<i4") for x in cols["pos"]])
        sides = np.concatenate([np.full(len(np.frombuffer(x, "<i4")), s, np.int32) for s, x in zip(cols["side"], cols["pos"])])
        late, df = np.full(len(tok), 2, np.int32), np.zeros(len(tok), np.int32)
    else:
        order = np.lexsort((cls, tok))
        tok, cls, n, z = tok[order], cls[order], n[order], z[order]
        keep = np.ones(len(tok), bool)
        keep[1:] = (tok[1:] != tok[:-1]) | (cls[1:] != cls[:-1])  # rows of one class have the same tokens
        tok, cls, n, z = tok[keep], cls[keep], n[keep], z[keep]
        _, back, count = np.unique(tok, return_inverse=True, return_counts=True)
        df = count[back]
        some = df > 1
        tok, cls, n, z, df = tok[some], cls[some], n[some], z[some], df[some].astype(np.int32)
        late = ((tok >> np.uint64(32) >= np.uint64(REGION)) & (side == 1)).astype(np.int32)
        pos, sides = np.zeros(len(tok), np.int32), np.full(len(tok), side, np.int32)
        df = np.where(late == 1, 0, df).astype(np.int32)
    names = [x.split()[0] for x in _POSTING.split(", ")]
    return pa.table([pa.array(x) for x in (sides, tok.view(np.int64), cls, n.astype(np.int32), z.astype(np.int32), late, df, pos)], names=names)


def _postings(blocks: DataFrame, percent: int) -> DataFrame:
    """(side, tok, cls, n, pos): tokens of the rarity order's prefixes that may be shared, and their place in the order."""
    each = blocks.groupBy("key").applyInArrow(_lists, _POSTING)
    own = Window.partitionBy("side", "cls")
    need = F.expr(f"n - (({percent} * n + 99) div 100) + 1")
    rank = F.row_number().over(own.orderBy("late", "df", "tok")) - 1
    early = F.count(F.when(F.col("late") == 0, 1)).over(own)
    ranked = each.where("late < 2").withColumn("place", (F.col("z") - early + rank).cast("int"))
    ranked = ranked.where((F.col("place") < need) | (F.col("late") == 1)).select("side", "tok", "cls", "n", F.col("place").alias("pos"))
    heavy = each.where("late = 2").select((F.col("side") + 2).alias("side"), "tok", "cls", "n", "pos").distinct()
    return ranked.union(heavy)


def _near(x: str, y: str, percent: int):
    """Sizes and places of a shared first token that allow the similarity."""
    n, m, p, q = (F.col(c) for c in (f"n_{x}", f"n_{y}", f"pos_{x}", f"pos_{y}"))
    fits = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    return fits & ((100 + percent) * F.least(n - p, m - q) >= percent * (n + m))


def _filtered(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that share a prefix token under the two hash orders too."""
    of = lambda c: classes.select(F.col("cls").alias(c), F.col("prints").alias(f"prints_{c}"))
    rows = spread_join(pairs.join(of("b"), "b"), of("a"), ["a"], sizes=pairs.groupBy("a").agg(F.count("*").alias("size")), target=part_target(pairs))

    def run(batches):
        for b in batches:
            keep = [prints_meet(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_())), b.column(1).filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    return rows.select("a", "b", "prints_a", "prints_b").mapInArrow(run, "a long, b long")


def _compared(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that are as similar as asked: those that pass all orders are compared by their whole texts.

    The text of a class is that of one of its rows, found by id and text hash: an id may be missing, and may name other texts too.
    """
    left = stage(_filtered(pairs, classes), "candidates")
    needed = left.select(F.col("a").alias("cls")).union(left.select("b")).distinct().join(classes.select("cls", "rep_id", "rep_own"), "cls")
    hashed = docs.withColumn("text_own", text_hash())
    texts = stage(hashed.join(needed, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("text_own") == F.col("rep_own"))).select("cls", "text").dropDuplicates(["cls"]), "texts")
    of = lambda c: texts.select(F.col("cls").alias(c), F.col("text").alias(f"text_{c}"))
    rows = spread_join(left.join(of("b"), "b"), of("a"), ["a"], sizes=left.groupBy("a").agg(F.count("*").alias("size")), target=part_target(left)).select("a", "b", "text_a", "text_b")

    def run(batches):
        at, pivot = None, None
        for b in batches:
            a, c = b.column(0).to_pylist(), b.column(1).to_pylist()
            keep = []
            for i, other in enumerate(shingle_sets(b.column(3), k)):
                if a[i] != at:
                    at, pivot = a[i], next(iter(shingle_sets(b.column(2).slice(i, 1), k)))
                both = len(np.intersect1d(pivot, other, assume_unique=True))
                if 100 * both >= percent * (len(pivot) + len(other) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([c[i] for i in keep], pa.int64())], ["a", "b"])

    links = stage(rows.mapInArrow(run, "a long, b long"), "links")
    discard(left, texts)
    return links


def _grouped(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """members (doc_id, own, cls, n): the hash of a row's text, its class (null: empty set) and its size; and
    classes (cls, rep_id, rep_own, copies, group): a row of the class, its number of rows and its component."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select("doc_id", "text")
    id_type = dict(docs.dtypes)["doc_id"]
    found = stage(_classes(docs, k, percent, id_type), "classes")
    rows = found.where("token is null")
    total = rows.agg(F.sum("n")).first()[0] or 0
    common = found.where("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= max(HEAVY_LEAST, total // HEAVY_SHARE))
    heavy = spark.sparkContext.broadcast(np.sort(np.array([r["token"] for r in common.select("token").collect()], np.int64).view(np.uint64)))
    # first halves that two classes have: a handful in 10 ** 10 classes
    twice = rows.where("cls is not null").groupBy("cls").agg(F.min("second").alias("keeps"), F.max("second").alias("last")).where("keeps < last")
    clash = {r["cls"]: r["keeps"] for r in twice.collect()}
    shared_clash = spark.sparkContext.broadcast(clash)
    number = F.col("cls")
    if clash:
        keeps = F.element_at(F.create_map(*[F.lit(x) for pair in clash.items() for x in pair]), F.col("cls"))
        number = F.when(keeps.isNotNull() & (keeps != F.col("second")), F.col("second")).otherwise(F.col("cls"))
    members = rows.select("doc_id", "own", number.alias("cls"), "n", "prints")
    reps = members.where("cls is not null").groupBy("cls").agg(F.min(_first()).alias("rep"), F.count("*").alias("copies"), F.any_value("prints").alias("prints"))
    reps = stage(reps.select("cls", F.col("rep.doc_id").alias("rep_id"), F.col("rep.own").alias("rep_own"), "copies", "prints"), "reps")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = 1 << max(5, (parts - 1).bit_length())
    postings = stage(_postings(_blocks(docs, k, percent, heavy, shared_clash, ranges), percent), "postings")

    listed = stage(postings.groupBy("side", "tok").agg(F.min(F.struct("pos", "n", "cls")).alias("pivot"), F.count("*").alias("size")).where("size > 1"), "pivots")
    pivots = listed.select("side", "tok", F.col("pivot.cls").alias("cls_p"), F.col("pivot.n").alias("n_p"), F.col("pivot.pos").alias("pos_p"))
    target = part_target(postings)
    own = postings.withColumnsRenamed({"cls": "cls_m", "n": "n_m", "pos": "pos_m"})
    shared = stage(spread_join(own, pivots, ["side", "tok"], sizes=listed, target=target), "lists")
    star = shared.where((F.col("cls_m") != F.col("cls_p")) & _near("m", "p", percent)).select(F.col("cls_p").alias("a"), F.col("cls_m").alias("b")).distinct()
    star = stage(star, "star")
    discard(postings)
    links = _compared(star, docs, reps, k, percent)
    label = components(links)

    of = lambda c: label.select(F.col("node").alias(f"cls_{c}"), F.col("label").alias(f"comp_{c}"))
    placed = spread_join(spread_join(shared, of("m"), ["cls_m"], "left"), of("p"), ["cls_p"], "left", sizes=shared.groupBy("cls_p").agg(F.count("*").alias("size")), target=target)
    placed = placed.withColumns({f"comp_{c}": F.coalesce(f"comp_{c}", f"cls_{c}") for c in ("m", "p")})
    placed = stage(placed.select("side", "tok", "cls_m", "n_m", "pos_m", "comp_m", "comp_p", (F.col("cls_m") == F.col("cls_p")).alias("is_pivot")), "placed")
    outside = placed.where("comp_m <> comp_p and not is_pivot").select("side", "tok", *[F.col(f"{c}_m").alias(f"{c}_o") for c in ("cls", "n", "pos", "comp")])
    outside = stage(outside, "outside")
    rest = spread_join(outside, placed.where("not is_pivot"), ["side", "tok"]).where((F.col("comp_o") != F.col("comp_m")) & _near("o", "m", percent))
    rest = stage(rest.select(F.least("cls_o", "cls_m").alias("a"), F.greatest("cls_o", "cls_m").alias("b")).distinct(), "rest")
    more = _compared(rest, docs, reps, k, percent)
    label = components(links.union(more))
    discard(listed, shared, star, placed, outside, rest, links, more)

    classes = reps.drop("prints").join(label, reps["cls"] == label["node"], "left").select("cls", "rep_id", "rep_own", "copies", F.coalesce("label", "cls").alias("group"))
    return members.drop("prints"), stage(classes, "grouped")


def _first():
    """The order of rows within a class or component: the smallest id first, null last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "own")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs: components of the exact Jaccard join at percent / 100."""
    members, classes = _grouped(docs, k, percent)
    least = classes.groupBy("group").agg(F.min("rep_id").alias("component_id"))
    named = spread_join(classes.select("cls", "group"), least, ["group"]).select("cls", "component_id")
    linked = spread_join(members.where("cls is not null"), named, ["cls"], sizes=classes.select("cls", F.col("copies").alias("size")))
    alone = members.where("cls is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(alone)


def one_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs of each component: of the smallest id, or of none if no row has one; every row without words."""
    _, classes = _grouped(docs, k, percent)
    first = F.struct(F.col("rep_id").isNull().alias("none"), F.col("rep_id").alias("doc_id"), F.col("rep_own").alias("own"))
    kept = classes.groupBy("group").agg(F.min(first).alias("rep")).select(F.col("rep.doc_id").alias("_id"), F.col("rep.own").alias("_kept"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_doc"), text_hash().alias("_own"))
    own = rows.join(kept, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_kept"))).dropDuplicates(["_doc", "_own"]).select("_row.*")
    return own.unionByName(docs.where(~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")))

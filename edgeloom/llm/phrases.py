"""Phrases of words that occur together more often than their parts: collocations of two to four words, by language.

Words with enough occurrences get ids by frequency, and texts become sequences of ids in blocks of one language. The pairs of
neighbours in a block fall into tiles of id ranges: a tile with many pairs is counted in a dense array addressed by the two ids
(numpy bincount), the pairs of all other tiles as sorted coordinates. Spark adds up the blocks' counts. Pairs with enough
occurrences get ids by frequency in their turn, the sequences are rewritten with them, and neighbours that overlap in all
but one word are the pairs of the next round: pairs give triples, triples give phrases of four words.

Nothing is dropped but what a definition drops: a phrase with enough occurrences has only parts with enough. Vocabularies, ids and counts
stay in Spark; a block gets those of its own words and phrases. A frequent pair is listed with the blocks that hold it, so blocks have to
grow (block_words) where there would be millions of them.

A null language is ``und``; null and empty texts have no words. Repeated rows count as often as they come, null or repeated ids play no
part. A very long text is never cut: a block ends with a text. Scores are exact (decimals), ties are ordered by the definition. An empty
table gives no rows.
"""

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.common import bounded_batches, discard, stage
from edgeloom.operators.rank import global_rank

BREAK = b"."
_WORDS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,:;!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + BREAK * 9)
SCALE = 2_000_000


def words_and_breaks(text: str) -> list[bytes]:
    """The words of a text, A-Z as a-z, and ``.`` where a piece ends."""
    return text.encode().translate(_WORDS).replace(BREAK, b" . ").split()


class _Numbers(dict):
    """Numbers things as they come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def count_pairs(left: np.ndarray, right: np.ndarray, tile: int = 1024, fill: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs as left << 32 | right, in any order, and how often each occurs.

    Ids are split into ranges of ``tile``; a tile that has more than 1/fill of its cells as pairs is counted by bincount.
    """
    if not len(left):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    side = 1 + max(int(left.max()), int(right.max())) // tile
    of = left // tile * side + right // tile
    tiles, size = np.unique(of, return_counts=True)
    codes, counts, rest = [], [], np.ones(len(of), bool)
    for t in tiles[size * fill > tile * tile].tolist():
        inside = of == t
        rest &= ~inside
        dense = np.bincount(left[inside] % tile * tile + right[inside] % tile, minlength=tile * tile)
        cell = np.flatnonzero(dense)
        codes.append((t // side * tile + cell // tile) << 32 | t % side * tile + cell % tile)
        counts.append(dense[cell])
    sparse, n = np.unique(left[rest] << 32 | right[rest], return_counts=True)  # sorted coordinates
    return np.concatenate([*codes, sparse]), np.concatenate([*counts, n])


def _packed(ids: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(ids.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return zstandard.ZstdCompressor(level=1, write_checksum=False).compress(planes)


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(4, -1).T.copy().view("<i4").reshape(-1).astype(np.int64)


_BLOCK = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("pos", pa.int32()), ("word", pa.string()), ("n", pa.int64()), ("seq", pa.binary())])
_BLOCK_SQL = "block long, lang string, pos int, word string, n long, seq binary"
_ROWS = 100_000  # of a record batch


def _blocks(docs: DataFrame, block_words: int) -> DataFrame:
    """For each block of texts of one language: a row with the sequence of words, as places in the block's list (-1: a piece ends), and
    a row for each word of that list with its occurrences."""

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        lists: dict[str, tuple] = {}

        def out(lang):
            nonlocal block
            numbers, parts, _ = lists.pop(lang)
            seq = np.concatenate(parts) - 1  # the break has number 0
            n = np.bincount(seq[seq >= 0], minlength=len(numbers) - 1)
            words = list(numbers)[1:]
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([lang]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.string()), pa.array([len(seq)]), pa.array([_packed(seq)])], schema=_BLOCK)
            for i in range(0, len(words), _ROWS):
                some = pa.array(words[i : i + _ROWS], pa.binary()).cast(pa.string())
                k = len(some)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, block)), pa.array([lang] * k), pa.array(np.arange(i, i + k), pa.int32()), some, pa.array(n[i : i + k]), pa.nulls(k, pa.binary())], schema=_BLOCK)
            block += 1

        for b in batches:
            for lang, text in zip(*(c.to_pylist() for c in b.columns)):
                if not text:
                    continue
                if lang not in lists:
                    lists[lang] = (_Numbers({BREAK: 0}), [], [0])
                numbers, parts, size = lists[lang]
                found = words_and_breaks(text)
                parts.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                parts.append(np.zeros(1, np.int32))
                size[0] += len(found)
                if size[0] >= block_words:
                    yield from out(lang)
            while sum(size[0] for *_, size in lists.values()) >= 3 * block_words:  # many languages, each with few words
                yield from out(max(lists, key=lambda k: lists[k][2][0]))
        for lang in list(lists):
            yield from out(lang)

    return docs.mapInArrow(run, _BLOCK_SQL)


def _ids(counted: DataFrame, key: str) -> DataFrame:
    """counted (lang, key, n, ...) with id: the rank by n from 0 within the language, ties by key."""
    ranked = stage(global_rank(counted, [F.asc("lang"), F.desc("n"), F.asc(key)]).drop("total"), "phrase-ranks")
    first = ranked.groupBy("lang").agg(F.min("rank").alias("_first"))
    return ranked.join(first, "lang").withColumn("id", F.col("rank") - F.col("_first")).drop("rank", "_first")


def _rewritten(sequences: DataFrame, answers: DataFrame, level: int) -> DataFrame:
    """(block, lang, seq) with ids of the next level: at each place the id of the word or phrase that begins there, else -1.

    answers: (block, part), parts of a block's table of what is frequent: keys and ids as int64, where a key is a place in the block's
    list (level 1) or a pair of ids.
    """
    own = answers.groupBy("block").agg(F.collect_list("part").alias("parts"))

    def run(batches):
        for b in batches:
            for block, lang, raw, parts in zip(*(b.column(c).to_pylist() for c in ("block", "lang", "seq", "parts"))):
                seq = _unpacked(raw)
                key, ids = np.concatenate([np.frombuffer(p, "<i8").reshape(2, -1) for p in parts], axis=1)
                if level == 1:
                    table = np.full(max(int(key.max()), int(seq.max())) + 2, -1)  # the last entry answers for -1
                    table[key] = ids
                    out = table[seq]
                else:
                    order = np.argsort(key)
                    key, ids = key[order], ids[order]
                    code = np.where((seq[:-1] >= 0) & (seq[1:] >= 0), seq[:-1] << 32 | seq[1:], -1)
                    at = np.minimum(np.searchsorted(key, code), len(key) - 1)
                    out = np.where(key[at] == code, ids[at], -1)
                lone = np.concatenate([[True], out[:-1] < 0]) & np.concatenate([out[1:] < 0, [True]])
                out = np.where(lone, -1, out)  # makes no pair
                out = out[(out >= 0) | np.concatenate([[True], out[:-1] >= 0])]  # one break is as good as many
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([lang]), pa.array([_packed(out)])], ["block", "lang", "seq"])

    return sequences.join(own, "block").mapInArrow(run, "block long, lang string, seq binary")


def _dealt(answers: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(block, part) from answers (key, id, blocks): each block's keys and ids, gathered from about ``most`` of them at a time."""

    def run(batches):
        kept, size = [], 0

        def out():
            key, ids, block = (np.concatenate(x) for x in zip(*kept))
            order = np.argsort(block, kind="stable")
            key, ids, block = key[order], ids[order], block[order]
            first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            parts = [np.stack([k, i]).astype("<i8").tobytes() for k, i in zip(np.split(key, first[1:]), np.split(ids, first[1:]))]
            return pa.RecordBatch.from_arrays([pa.array(block[first]), pa.array(parts, pa.binary())], ["block", "part"])

        for b in batches:
            if not b.num_rows:
                continue
            blocks = b.column("blocks")
            n = np.diff(blocks.offsets.to_numpy())
            kept.append((np.repeat(b.column("key").to_numpy(), n), np.repeat(b.column("id").to_numpy(), n), blocks.flatten().to_numpy()))
            size += int(n.sum())
            if size >= most:
                yield out()
                kept, size = [], 0
        if kept:
            yield out()

    return answers.select("key", "id", "blocks").mapInArrow(run, "block long, part binary")


def _counted(sequences: DataFrame, least: int, tile: int) -> DataFrame:
    """(lang, code, n, blocks): pairs with least occurrences in all blocks of the language, and the blocks that hold them."""

    def run(batches):
        for b in batches:
            for block, lang, raw in zip(*(b.column(c).to_pylist() for c in ("block", "lang", "seq"))):
                seq = _unpacked(raw)
                both = (seq[:-1] >= 0) & (seq[1:] >= 0)
                codes, n = count_pairs(seq[:-1][both], seq[1:][both], tile)
                for i in range(0, len(codes), _ROWS):
                    k = len(codes[i : i + _ROWS])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(k, block)), pa.array([lang] * k), pa.array(codes[i : i + k]), pa.array(n[i : i + k])], ["block", "lang", "code", "n"])

    each = sequences.mapInArrow(run, "block long, lang string, code long, n long")
    frequent = each.withColumn("total", F.sum("n").over(Window.partitionBy("code", "lang"))).where(F.col("total") >= least)
    return frequent.groupBy("code", "lang").agg(F.first("total").alias("n"), F.collect_list("block").alias("blocks"))  # partitioned alike: no further shuffle


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, most: int = 2000, share: int = 80, block_words: int = 1_300_000, tile: int = 1024) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``most`` phrases of 2 to ``longest`` words with a >= least occurrences.

    n: occurrences of all words of the language. Of the cuts of a phrase into two parts of l and r occurrences, the one with the lowest
    floor(2,000,000 a / (l + r)) counts, ties to the shortest first part. A phrase inside a longer one that has ``share`` per cent of
    its occurrences or more is left out. A block holds one language's texts of about block_words words; a text is never cut.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    blocks = stage(_blocks(rows, block_words), "phrase-blocks")
    listed = blocks.where("seq is null").select("block", "lang", "pos", "word", "n")
    sums = listed.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = stage(_ids(sums.where(F.col("n") >= least), "word"), "phrase-words")
    totals = listed.groupBy("lang").agg(F.sum("n").alias("n"))
    places = listed.select("block", "lang", "word", F.col("pos").cast("long").alias("key")).join(words.select("lang", "word", "id"), ["lang", "word"])
    answers = _dealt(places.select("key", "id", F.array("block").alias("blocks")))
    sequences = stage(_rewritten(blocks.where("seq is not null").select("block", "lang", "seq"), answers, 1), "phrase-ids")
    # of a phrase: its occurrences, those of its first k and last k words, and its last word
    one = F.array("n")
    table = words.select("lang", "id", F.col("word").alias("phrase"), F.col("word").alias("last"), "n", one.alias("first"), one.alias("ends"))
    levels, done = [table], [blocks]
    for size in range(2, longest + 1):
        pairs = stage(_ids(stage(_counted(sequences, least, tile), "phrase-pairs"), "code"), "phrase-level")
        left = levels[-1].select("lang", F.col("id").alias("left"), F.col("phrase").alias("_phrase"), F.col("first").alias("_first"))
        right = levels[-1].select("lang", F.col("id").alias("right"), "last", F.col("ends").alias("_ends"))
        made = pairs.drop("blocks").withColumns({"left": F.shiftright("code", 32), "right": F.col("code").bitwiseAND(F.lit(0xFFFFFFFF))}).join(left, ["lang", "left"]).join(right, ["lang", "right"])
        grown = lambda c: F.array_append(c, F.col("n"))
        made = made.select("lang", "id", F.concat_ws(" ", "_phrase", "last").alias("phrase"), "last", "n", grown("_first").alias("first"), grown("_ends").alias("ends"), "left", "right")
        levels.append(stage(made, "phrase-table"))
        done += [pairs, sequences]
        if size < longest:
            sequences = stage(_rewritten(sequences, _dealt(pairs.withColumnRenamed("code", "key")), size), "phrase-ids")
    out = None
    for size, phrases in enumerate(levels[1:], 2):
        kept = phrases
        if size < longest:
            longer = levels[size].select("lang", F.explode(F.array("left", "right")).alias("id"), F.col("n").alias("over"))
            most_of = longer.groupBy("lang", "id").agg(F.max("over").alias("over"))
            whole = lambda c, by: F.col(c).cast("decimal(20,0)") * F.lit(by).cast("decimal(3,0)")
            kept = phrases.join(most_of, ["lang", "id"], "left").where(F.col("over").isNull() | (whole("over", 100) < whole("n", share)))
        cuts = [F.struct(F.expr(f"(cast(n as decimal(20,0)) * {SCALE}) div (cast(first[{k - 1}] as decimal(20,0)) + ends[{size - k - 1}])").alias("score"), F.lit(k).alias("k"), F.expr(f"first[{k - 1}]").alias("l"), F.expr(f"ends[{size - k - 1}]").alias("r")) for k in range(1, size)]
        scored = kept.select("lang", "phrase", F.col("n").alias("a"), (F.least(*cuts) if len(cuts) > 1 else cuts[0]).alias("cut"))
        scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        out = scored if out is None else out.union(scored)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = out.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)
    result = stage(best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrases")
    discard(*done)
    return result

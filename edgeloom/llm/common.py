"""Helpers that the text and vector operators share: scratch tables, Arrow batches, word hashing."""

import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20  # of Arrow data that a Python worker is sent at once


def bounded_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Hold Arrow batches to a number of bytes, so that very long texts don't add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder in spark.checkpoint.dir; without one, a local folder in local mode and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="edgeloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by stage() that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._staged_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def part_target(df: DataFrame) -> int:
    """Rows of one key that a task may get at most before the key is dealt over several."""
    return max(500, df.count() // (2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", sizes: DataFrame | None = None, target: int | None = None) -> DataFrame:
    """big joined with small on keys; keys that many rows of big share are dealt over several tasks by a salt.

    Only such keys' rows of small are repeated, once for each salt. There are fewer of them than rows of big divided by the target, so
    their list, which is broadcast, is bounded by the number of shuffle partitions. sizes: rows of big by key (keys, size), if
    known. A null in a key joins nothing and is not salted.
    """
    spark = big.sparkSession
    target = target or part_target(big)
    sizes = big.groupBy(*keys).agg(F.count("*").alias("size")) if sizes is None else sizes
    known = [F.col(k).isNotNull() for k in keys]
    for k in known[1:]:
        known[0] = known[0] & k
    hot = [(*(r[k] for k in keys), -(-r["size"] // target)) for r in sizes.where(known[0] & (F.col("size") > target)).select(*keys, "size").collect()]
    if not hot:
        return big.join(small, keys, how)
    kinds = dict(big.dtypes)
    salts = F.broadcast(spark.createDataFrame(hot, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", _salts int"))
    own = F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.coalesce("_salts", F.lit(1))).cast("int")
    dealt = big.join(salts, keys, "left").withColumn("_salt", own).drop("_salts")
    copies = small.join(salts, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")


def fold(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def packed(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns beside all columns in the struct ``_row``, so that no column of docs clashes with what is added."""
    return docs.select(F.struct(*docs.columns).alias("_row"), *needed)


def letters(text: str) -> bool:
    return any(map(str.isalpha, text))


# --- words of UTF-8 text by numpy -------------------------------------------------------------------------------------

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(30), np.uint64(27), np.uint64(31))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    a, b, i, j, k = _MIX
    x = (x ^ (x >> i)) * a
    x = (x ^ (x >> j)) * b
    return x ^ (x >> k)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32  # A-Z count as a-z
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_LENGTH = np.uint64(0x9E3779B97F4A7C15)
_LONG_WORD = 256  # bytes; longer words are hashed one by one


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets, without copies; null has no bytes."""
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def pieces(offsets: np.ndarray, most: int = 1 << 19):
    """Row ranges of about as many bytes at most; a longer row comes alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def lowered(data: np.ndarray, start: int, end: int) -> bytes:
    """The bytes of a word, A-Z as a-z."""
    return _LOWER[data[start:end]].tobytes()


def word_places(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends in data of all words of rows in order, and how many words each row has.

    is_word: for each byte, whether words hold it.
    """
    lo, hi = int(offsets[0]), int(offsets[-1])
    if hi == lo:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = np.zeros(hi - lo + 2, bool)
    inside[1:-1] = is_word[data[lo:hi]]
    cuts = np.unique(offsets[:-1] - lo)
    cuts = cuts[cuts < hi - lo]
    begin = inside[1:-1] & ~inside[:-2]
    begin[cuts] = inside[1:-1][cuts]
    end = inside[1:-1] & ~inside[2:]
    end[cuts[cuts > 0] - 1] |= inside[1:-1][cuts[cuts > 0] - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts + lo, ends + lo, np.diff(np.searchsorted(starts, offsets - lo))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, A-Z taken as a-z.

    Eight bytes at a time go through a bijection, begun with the length: words of up to eight bytes and equal length never
    collide, longer ones as seldom as 64 random bits do.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    lo = int(starts[0])
    low = np.concatenate([_LOWER[data[lo : int(ends[-1])]], np.zeros(8, np.uint8)])
    eight = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))
    at, size = starts - lo, ends - starts
    out = mix(size.astype(np.uint64) * _LENGTH)
    some = np.flatnonzero(size <= _LONG_WORD)
    k = 0
    while len(some):
        left = size[some] - k
        out[some] = mix(out[some] ^ (eight[at[some] + k] & _MASKS[np.minimum(left, 8)]))
        k += 8
        some = some[left > 8]
    for i in np.flatnonzero(size > _LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(low[at[i] : at[i] + size[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def hashed_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of rows in order, and how many each row has."""
    starts, ends, counts = word_places(data, offsets, is_word)
    return word_hashes(data, starts, ends), counts

"""Token ids in binary files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

An id is replaced by its rank in the whole corpus (0: the most frequent id; ties to the smaller id), so that frequent ids
take one byte. A file holds one block of documents in ascending doc_id order:

    magic ``ELTOKEN1``; little-endian int64: documents, ids, ids before this file, bits of a control code;
    doc ids (int64; the least int64 stands for null); ids of each document (int64);
    control bytes; data bytes

A control code tells how many bytes an id's rank takes, less one: 1 bit an id where no rank needs over 2 bytes, else 2. Control
bytes fill from their lowest bits. Files are named in reading order, beside ``ranks.bin``: the magic and the ids by rank (uint32).

Null and empty texts have the end id only. Every row is written as often as it comes: rows of equal doc_id stand next to each
other in any order, and an id that many rows share is dealt over several files. Rows with a null id come first.
"""

import itertools
import os
import string
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from edgeloom.llm.common import bounded_batches, discard, scratch, stage, utf8

MAGIC = b"ELTOKEN1"
HEAD = struct.Struct("<8sqqqq")
NO_ID = int(np.iinfo(np.int64).min)
DEFAULT_VOCABULARY = "byte_bpe_50k.json"


# --- the code -----------------------------------------------------------------------------------------------------------


def _widths(bits: int) -> np.ndarray:
    """For each control byte the bytes of the ids that it stands for."""
    codes = np.arange(256)[:, None] >> np.arange(0, 8, bits)[None, :]
    return ((codes & ((1 << bits) - 1)) + 1).astype(np.int64)


_TABLES = {bits: _widths(bits) for bits in (1, 2)}


def pack(ranks: np.ndarray) -> tuple[int, bytes, bytes]:
    """Bits of a control code, control bytes and data bytes."""
    ranks = ranks.astype("<u4")
    more = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    bits = 1 if not len(more) or more.max() < 2 else 2
    each = 8 // bits
    codes = np.zeros(-(-len(more) // each) * each, np.uint8)
    codes[: len(more)] = more
    control = np.bitwise_or.reduce(codes.reshape(-1, each) << np.arange(0, 8, bits, dtype=np.uint8), axis=1).astype(np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= more[:, None]]
    return bits, control.tobytes(), data.tobytes()


def unpack(n: int, bits: int, control: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The n ranks, by looking the control bytes up."""
    width = _TABLES[bits][control].reshape(-1)[:n]
    end = np.cumsum(width)
    begin = end - width
    out = data[begin].astype(np.uint32)
    for k in range(1, 1 << bits):
        longer = np.flatnonzero(width > k)
        out[longer] |= data[begin[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def block_bytes(doc_ids: np.ndarray, sizes: np.ndarray, start: int, ranks: np.ndarray) -> bytes:
    bits, control, data = pack(ranks)
    return HEAD.pack(MAGIC, len(sizes), len(ranks), start, bits) + doc_ids.astype("<i8").tobytes() + sizes.astype("<i8").tobytes() + control + data


def read_block(content: bytes) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """Doc ids, ids of each document, ids before the file, and all ranks."""
    magic, docs, n, start, bits = HEAD.unpack_from(content)
    if magic != MAGIC:
        raise ValueError("not a token file")
    raw = np.frombuffer(content, np.uint8, offset=HEAD.size)
    doc_ids, sizes = raw[: 8 * docs].view("<i8"), raw[8 * docs : 16 * docs].view("<i8")
    length = -(-n * bits // 8)
    rest = raw[16 * docs :]
    return doc_ids, sizes, start, unpack(n, bits, rest[:length], rest[length:])


# --- encoding -----------------------------------------------------------------------------------------------------------


def load_tokenizer(path: str) -> Tokenizer:
    """The vocabulary file's tokenizer without truncation and padding; on Spark, tasks take the place of its threads."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def _table(*byte_values) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(itertools.chain(*byte_values))] = True
    return out


_WHITE = _table(range(9, 14), b" ")
_MAYBE_WHITE = _table(range(9, 14), b" ", range(0x1C, 0x20))
_PUNCTUATION = _table(string.punctuation.encode())
_LETTER = _table(string.ascii_letters.encode())
_LEAD = _table(range(0xC3, 0xCA), (0xD0, 0xD1))  # first bytes of Latin and Cyrillic letters, but for multiplication and division signs
_SECOND = _table(set(range(0x80, 0xC0)) - {0x97, 0xB7})
_WIDE_WHITE = np.array([int.from_bytes(chr(c).encode(), "big") for c in (0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)])
_LATIN_WHITE = np.array([0xC285, 0xC2A0])


def cuts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in UTF-8 bytes where the pre-tokenizer of byte-level vocabularies (``bpe.PATTERN``) begins a word, whatever stands around:
    before white space that follows none, and before punctuation that follows a letter. Places where that is not sure are left out."""
    space = np.flatnonzero(_WHITE[data[1:]] & ~_MAYBE_WHITE[data[:-1]]) + 1
    wide = np.flatnonzero(data[space - 1] >= 0x80)
    at = space[wide]
    three = sum(data[np.maximum(at - k, 0)].astype(np.int64) << 8 * (k - 1) for k in (1, 2, 3))
    space = np.delete(space, wide[np.isin(three, _WIDE_WHITE) | np.isin(three & 0xFFFF, _LATIN_WHITE)])
    mark = np.flatnonzero(_PUNCTUATION[data[1:]]) + 1
    last, before = data[mark - 1], data[np.maximum(mark - 2, 0)]
    return space, mark[_LETTER[last] | (_LEAD[before] & _SECOND[last])]


class IdTable:
    """The ids of strings, side by side in one array."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.ids, self.begin, self.size = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)

    def add(self, keys: list, ids: np.ndarray, size: np.ndarray) -> None:
        self.place.update(zip(keys, range(len(self.size), len(self.size) + len(keys))))
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])
        self.ids = np.concatenate([self.ids, ids])
        self.size = np.concatenate([self.size, size])
        self.uses = np.concatenate([self.uses, np.zeros(len(size), np.int64)])

    def find(self, keys: list) -> np.ndarray:
        """The keys' places; -1: not here."""
        return np.fromiter(map(self.place.get, keys, itertools.repeat(-1)), np.int64, len(keys))

    def most_used(self, most_ids: int) -> "IdTable":
        """A table of the half that was asked for most often; an empty one, if that half holds over most_ids ids."""
        out = IdTable()
        kept = np.sort(np.argsort(-self.uses, kind="stable")[: len(self.uses) // 2])
        if self.size[kept].sum() <= most_ids:
            keys = list(self.place)
            out.add([keys[k] for k in kept.tolist()], self.gather(kept)[0], self.size[kept])
            out.uses = self.uses[kept] // 2
        return out

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the keys at these places one after another, and where each key's begin, with their end."""
        size = self.size[at]
        end = np.concatenate([[0], np.cumsum(size)])
        return self.ids[np.repeat(self.begin[at] - end[:-1], size) + np.arange(end[-1])], end


class Encoder:
    """Whole texts to ids by the tokenizers library, which is given each distinct chunk of a worker's texts once.

    The texts' bytes are cut into chunks by numpy, only where the pre-tokenizer begins a word in any case; Arrow numbers the distinct
    ones, and the library encodes those that are new, as words of one text. A text that holds a special token is one chunk. The ids
    of up to most chunks, and max_ids ids, are kept; beyond that, the half of them that is used least is given up.
    """

    def __init__(self, path: str, most: int = 300_000, max_ids: int = 3_000_000):
        self.tokenizer = load_tokenizer(path)
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.most, self.max_ids = most, max_ids
        self.chunks = IdTable()

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the chunks of texts begin, and the end of the last."""
        begins = np.zeros(len(data) + 1, bool)
        if len(data):
            for places in cuts(data):
                begins[places] = True
            raw = data.tobytes()
            for special in self.specials:
                at = raw.find(special)
                while at >= 0:
                    row = int(np.searchsorted(offsets, at, "right"))
                    begins[offsets[row - 1] : offsets[row]] = False
                    at = raw.find(special, int(offsets[row]))
        begins[offsets] = True
        return np.flatnonzero(begins)

    def _learn(self, new: list) -> None:
        made = self.tokenizer.encode(new, is_pretokenized=True, add_special_tokens=False)
        self.chunks.add(new, np.array(made.ids, "<u4"), np.bincount(np.array(made.word_ids, np.int64), minlength=len(new)))

    def batch(self, texts: list | pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        if not len(texts):
            return []
        data, offsets = utf8(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        starts = self.starts(data, offsets)
        chunks = pa.Array.from_buffers(pa.large_string(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
        distinct, which = chunks.dictionary.to_numpy(zero_copy_only=False).tolist(), chunks.indices.to_numpy()
        if len(self.chunks.place) > self.most or len(self.chunks.ids) > self.max_ids:
            self.chunks = self.chunks.most_used(self.max_ids // 2)
        at = self.chunks.find(distinct)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = len(self.chunks.size) + np.arange(len(new))
            self._learn([distinct[i] for i in new.tolist()])
        self.chunks.uses[at] += np.bincount(which, minlength=len(at))
        ids, end = self.chunks.gather(at[which])
        return np.split(ids, end[np.searchsorted(starts, offsets[1:-1])])


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One for each Python worker, whatever the number of its tasks."""
    return Encoder(path)


def _parts(doc_ids: np.ndarray, own: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The range that each row belongs to; an id that fills several ranges is dealt over them by own."""
    first, last = np.searchsorted(bounds, doc_ids, "left"), np.searchsorted(bounds, doc_ids, "right")
    return np.where(last > first, first + own % (last - first + 1), last)


def _encoded(docs: DataFrame, bounds: np.ndarray, path: str, end_id: int) -> DataFrame:
    """(part, doc_id, n, ids): ids squeezed by zstandard, only to keep the shuffle small."""

    def run(batches):
        encode = _encoder(path)
        squeeze = zstandard.ZstdCompressor(level=1, write_checksum=False)
        for b in batches:
            doc_ids = b.column(0).to_pylist()
            n, out, own = [], [], []
            for ids in encode.batch(b.column(1)):
                x = np.append(ids, np.uint32(end_id)).astype("<u4")
                n.append(len(x))
                out.append(squeeze.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes()))
                own.append(zlib.crc32(out[-1]))
            part = _parts(np.array([NO_ID if d is None else d for d in doc_ids], np.int64), np.array(own, np.int64), bounds)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(doc_ids, pa.int64()), pa.array(n, pa.int64()), pa.array(out, pa.binary())], ["part", "doc_id", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "part int, doc_id long, n long, ids binary")


_BLOCK = "part int, block int, n long, doc_ids binary, sizes binary, ids binary, counts binary"


def _blocks(rows: DataFrame, most: int) -> DataFrame:
    """Rows in order to blocks of about ``most`` ids, with the ids' counts; a document is never cut."""

    def run(batches):
        squeeze, open_ = zstandard.ZstdCompressor(level=1, write_checksum=False), zstandard.ZstdDecompressor()
        part, block, doc_ids, sizes, ids, total = None, 0, [], [], [], 0

        def out():
            x = np.concatenate(ids)
            count = np.bincount(x)
            seen = np.flatnonzero(count)
            planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes()
            counts = np.stack([seen.astype("<i8"), count[seen].astype("<i8")]).tobytes()
            values = [[part], [block], [len(x)], [np.array(doc_ids, "<i8").tobytes()], [np.array(sizes, "<i8").tobytes()], [squeeze.compress(planes)], [counts]]
            types = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], ["part", "block", "n", "doc_ids", "sizes", "ids", "counts"])

        for b in batches:
            for p, d, n, x in zip(*(c.to_pylist() for c in b.columns)):
                if ids and (p != part or total + n > most):
                    yield out()
                    block, doc_ids, sizes, ids, total = (block + 1 if p == part else 0), [], [], [], 0
                part = p
                doc_ids.append(NO_ID if d is None else d)
                sizes.append(n)
                ids.append(np.frombuffer(open_.decompress(x), np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1))
                total += n
        if ids:
            yield out()

    return rows.mapInArrow(run, _BLOCK)


def write_tokens(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = 0, block_ids: int = 2_000_000) -> DataFrame:
    """Encode docs (doc_id, text), append end_id to each, and write the files below folder.

    Returns the manifest (name, part, block, start, n). What the driver holds is bounded: counts by id (the vocabulary), totals by
    part (as many as shuffle partitions), and the parts' bounds. A file is moved into place when complete, and a task that runs
    again writes the same file.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    path = vocabulary or public_tokenizers.path(DEFAULT_VOCABULARY)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    cuts = docs.agg(F.percentile_approx(ids, [k / parts for k in range(1, parts)] or [0.5], 20_000).alias("q")).first()["q"]
    bounds = np.sort(np.array(cuts or [], np.int64))
    rows = _encoded(docs, bounds, path, end_id).repartition(parts, "part").sortWithinPartitions("part", "doc_id", "ids")
    blocks = stage(_blocks(rows, block_ids), "token-blocks")

    def counted(batches):
        for b in batches:
            for raw in b.column(0).to_pylist():
                ids, n = np.frombuffer(raw, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], ["id", "n"])

    counts = blocks.select("counts").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").collect()
    by_rank = np.array([r["id"] for r in counts], "<u4")
    totals, before = {}, 0
    for r in blocks.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        totals[r["part"]] = before
        before += r["n"]
    rank = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 0, np.uint32)
    rank[by_rank] = np.arange(len(by_rank))
    shared = spark.sparkContext.broadcast((rank, totals))
    own = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.select("part", "block", "n", F.coalesce(F.sum("n").over(own), F.lit(0)).alias("before"))
    placed = blocks.drop("counts", "n").join(placed, ["part", "block"]).select("part", "block", "n", "before", "doc_ids", "sizes", "ids")

    def written(batches):
        rank, totals = shared.value
        open_ = zstandard.ZstdDecompressor()
        for b in batches:
            for part, block, n, before, doc_ids, sizes, ids in zip(*(c.to_pylist() for c in b.columns)):
                x = np.frombuffer(open_.decompress(ids), np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1)
                name, start = f"tokens-{part:06d}-{block:06d}.ids", totals[part] + before
                _put(folder, name, block_bytes(np.frombuffer(doc_ids, "<i8"), np.frombuffer(sizes, "<i8"), start, rank[x]))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip([[name], [part], [block], [start], [n]], [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()])], ["name", "part", "block", "start", "n"])

    _put(folder, "ranks.bin", MAGIC + by_rank.tobytes())
    manifest = stage(placed.mapInArrow(written, "name string, part int, block int, start long, n long"), "token-manifest")
    discard(blocks)
    return manifest


def _put(folder: str, name: str, content: bytes) -> None:
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    partial = f"{base}/_{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(partial) as f:
        f.write(content)
    fs.move(partial, f"{base}/{name}")


def read_tokens(spark, folder: str, each, schema: str) -> DataFrame:
    """Rows that ``each(doc_ids, sizes, start, ids)`` gives (a record batch) for every file of the folder."""
    by_rank = np.frombuffer(bytes(spark.read.format("binaryFile").load(f"{folder}/ranks.bin").first()["content"])[len(MAGIC) :], "<u4")
    shared = spark.sparkContext.broadcast(by_rank)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder).select("content")

    def run(batches):
        for b in batches:
            for content in b.column(0):
                doc_ids, sizes, start, ranks = read_block(content.as_buffer().to_pybytes())
                yield each(doc_ids, sizes, start, shared.value[ranks])

    return files.mapInArrow(run, schema)


def _digests(doc_ids: np.ndarray, sizes: np.ndarray, start: int, ids: np.ndarray) -> pa.RecordBatch:
    end = np.cumsum(sizes)
    raw = memoryview(ids.astype("<u4").tobytes())
    crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(end.tolist(), sizes.tolist())]
    arrays = [pa.array(doc_ids, mask=doc_ids == NO_ID), pa.array(start + end - sizes), pa.array(sizes), pa.array(crc, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32"])


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row of docs, from files written and read back."""
    spark = docs.sparkSession
    folder = scratch(spark, "tokens")
    write_tokens(docs.select("doc_id", "text"), folder, vocabulary)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return read_tokens(spark, folder, _digests, schema)


def texts(spark, folder: str, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) decoded from the files; each document's last id, the end id, is left out."""
    path = vocabulary or public_tokenizers.path(DEFAULT_VOCABULARY)

    def each(doc_ids, sizes, start, ids):
        tokenizer = load_tokenizer(path)
        end = np.cumsum(sizes)
        out = [tokenizer.decode(ids[e - n : e - 1].tolist(), skip_special_tokens=False) for e, n in zip(end.tolist(), sizes.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=doc_ids == NO_ID), pa.array(out, pa.string())], ["doc_id", "text"])

    return read_tokens(spark, folder, each, "doc_id long, text string")

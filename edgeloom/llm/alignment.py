"""Alignment of the tokens of two tokenizers over the bytes of a text, and how many documents hold an id pair linked.

A tokenizer's tokens and the text's bytes make a 0/1 matrix: a row a token, a column a byte, in CSR form. The row products A·Bᵀ
(Gustavson: for each byte of an A token's row, the row of that byte in Bᵀ is added) give the links: pairs of tokens whose byte
ranges overlap, with the bytes that they share. Offsets where tokens of both end cut the tokens into groups; the product of the two
token-group matrices gives the links within a group. A group can be as long as a text, so only the symbolic half of that product
(how many links a row has) is worked out by default.

A text is cut into chunks where both tokenizers always end a token, and each distinct chunk of a worker's texts is encoded and
multiplied once. Documents are gathered in blocks. A block's distinct id pairs are counted over all documents by Spark, and the
counts come back to the block, which holds its documents' pairs as numbers of its own list.

Texts that are null or empty, or that either tokenizer does not give back byte by byte, have no tokens: zeros and an empty digest.
Repeated rows count as often as they come. Null or repeated ids play no part. Very long texts, also of one word, are aligned whole.
An empty table gives no rows.
"""

import itertools
import os
import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from edgeloom.llm.bpe import byte_letters
from edgeloom.llm.common import bounded_batches, discard, packed, stage

DEFAULT_A, DEFAULT_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
SPACE = "▁"  # a blank in pieces


# --- sparse matrices ----------------------------------------------------------------------------------------------------


class Csr(NamedTuple):
    """A 0/1 matrix by rows: row i has the columns column[start[i]:start[i + 1]]."""

    start: np.ndarray
    column: np.ndarray
    width: int


def spans(lengths: np.ndarray) -> Csr:
    """Rows that cover columns one after another, each so many."""
    start = np.concatenate([[0], np.cumsum(lengths)])
    return Csr(start, np.arange(start[-1]), int(start[-1]))


def one_each(column: np.ndarray, width: int) -> Csr:
    """Rows of one column each."""
    return Csr(np.arange(len(column) + 1), column, width)


def transposed(m: Csr) -> Csr:
    row = np.repeat(np.arange(len(m.start) - 1), np.diff(m.start))
    start = np.concatenate([[0], np.cumsum(np.bincount(m.column, minlength=m.width))])
    return Csr(start, row[np.argsort(m.column, kind="stable")], len(m.start) - 1)


def product_sizes(a: Csr, b: Csr) -> np.ndarray:
    """The symbolic half: how many products each row of a·b adds up."""
    total = np.concatenate([[0], np.cumsum(np.diff(b.start)[a.column])])
    return total[a.start[1:]] - total[a.start[:-1]]


def row_products(a: Csr, b: Csr) -> tuple[Csr, np.ndarray]:
    """a·b with its values: each row of a adds up the rows of b that its columns name."""
    size = np.diff(b.start)[a.column]
    end = np.cumsum(size)
    n = int(end[-1]) if len(end) else 0
    row = np.repeat(np.repeat(np.arange(len(a.start) - 1), np.diff(a.start)), size)
    at = np.arange(n) + np.repeat(b.start[a.column] - (end - size), size)
    key = row * max(b.width, 1) + b.column[at]
    if np.any(key[1:] < key[:-1]):
        key = np.sort(key)
    first = np.flatnonzero(np.concatenate([np.ones(min(n, 1), bool), key[1:] != key[:-1]]))
    value = np.diff(np.append(first, n))
    key = key[first]
    row = key // max(b.width, 1)
    return Csr(np.searchsorted(row, np.arange(len(a.start))), key % max(b.width, 1), b.width), value


class Aligned(NamedTuple):
    """Links as (A token, B token, shared bytes) by place, and the end of each group among the A and the B tokens."""

    a: np.ndarray
    b: np.ndarray
    shared: np.ndarray
    a_end: np.ndarray
    b_end: np.ndarray


def aligned(a_bytes: np.ndarray, b_bytes: np.ndarray) -> Aligned:
    """The links and groups of two sequences of tokens that cover the same bytes, given the tokens' lengths."""
    a, b = spans(a_bytes), spans(b_bytes)
    made, shared = row_products(a, transposed(b))
    both = np.intersect1d(a.start[1:], b.start[1:])
    ends = [np.searchsorted(m.start[1:], both, "right") for m in (a, b)]
    return Aligned(np.repeat(np.arange(len(a_bytes)), np.diff(made.start)), made.column, shared, *ends)


def group_links(a_end: np.ndarray, b_end: np.ndarray) -> tuple[Csr, Csr]:
    """The matrices (A tokens x groups) and (groups x B tokens); their product is 1 for tokens that share a group."""
    of = lambda end: one_each(np.repeat(np.arange(len(end)), np.diff(end, prepend=0)), len(end))
    return of(a_end), transposed(of(b_end))


# --- tokenizers ---------------------------------------------------------------------------------------------------------

_CHUNK = re.compile(r"\n(?=\S)|\s+\S*|\S+").findall
_ODD = re.compile(r"\S[^\S \n]").search  # white space that a piece may take together with what comes before it


def chunks(text: str) -> list[str]:
    """A text cut before a blank or line end that follows other than white space, and after such a line end."""
    out = _CHUNK(text)
    if _ODD(text):
        joined = out[:1]
        for c in out[1:]:
            if c[0].isspace() and c[0] not in " \n":
                joined[-1] += c
            elif joined[-1] == "\n" or c[0].isspace():
                joined.append(c)
            else:
                joined[-1] += c
        return joined
    return out


class Digits:
    """Decimal ids as bytes, each with a mark after it."""

    def __init__(self, n: int):
        text = np.array([str(i).encode() for i in range(max(n, 1))])
        self.table = text.view(np.uint8).reshape(len(text), -1)
        self.size = (self.table != 0).sum(1)

    def write(self, ids: np.ndarray, marks: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes, and where each id's end."""
        size = self.size[ids]
        out = np.zeros((len(ids), self.table.shape[1] + 1), np.uint8)
        out[:, :-1] = self.table[ids]
        out[np.arange(len(ids)), size] = marks
        return out[np.arange(out.shape[1]) <= size[:, None]].tobytes(), np.cumsum(size + 1)


class Tokens(NamedTuple):
    """Tokens of some strings one after another: ids, and how many each string has."""

    ids: np.ndarray
    count: np.ndarray


class Tokenizers:
    """A (a file of the tokenizers library, byte-level) and B (a sentencepiece model) with the bytes of their tokens."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        letters = byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_tokens = [b""] * (1 + max(vocabulary.values()))
        for t, i in vocabulary.items():
            self.a_tokens[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_tokens = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_bytes, self.b_bytes = (np.array([len(t) for t in x]) for x in (self.a_tokens, self.b_tokens))
        plain = [p.replace(SPACE, " ") for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        line_end = self.b.encode("\n")
        #: No piece goes over a place where chunks() cuts, so that a chunk's pieces are the same as within its text.
        self.cuts = len(line_end) == 2 and not any(re.search(r"\S[ \n]", p) or "\n" in p and len(p) > 1 for p in plain)
        self.before = "\n" if self.cuts else ""

    def chunks(self, text: str) -> list[str]:
        return chunks(" " + text) if self.cuts else [" " + text]

    def encode(self, texts: list[str]) -> tuple[Tokens, Tokens]:
        """Tokens of chunks (with the blank before the text, as chunks() gives them)."""
        made = self.a.encode(texts, is_pretokenized=True, add_special_tokens=False)
        a = Tokens(np.array(made.ids, np.int64), np.bincount(np.array(made.word_ids, np.int64), minlength=len(texts)))
        # B sets a blank before what it encodes: a line end, whose token is none but its own, keeps it off the chunk
        each = [x[2:] for x in self.b.encode(["\n" + t for t in texts], num_threads=1)] if self.cuts else self.b.encode([t[1:] for t in texts], num_threads=1)
        count = np.fromiter(map(len, each), np.int64, len(each))
        return a, Tokens(np.fromiter(itertools.chain.from_iterable(each), np.int64, int(count.sum())), count)

    def sound(self, texts: list[str], a: Tokens, b: Tokens) -> np.ndarray:
        """For each string whether the bytes of both tokenizers' tokens are its bytes."""
        raw = [t.encode() for t in texts]
        sizes, joined, ok = np.fromiter(map(len, raw), np.int64, len(raw)), b"".join(raw), np.ones(len(raw), bool)
        for tokens, table, lengths in ((a, self.a_tokens, self.a_bytes), (b, self.b_tokens, self.b_bytes)):
            each = tokens.ids.tolist()
            ends = np.concatenate([[0], np.cumsum(tokens.count)])
            got = np.diff(np.concatenate([[0], np.cumsum(lengths[tokens.ids])])[ends])
            if (got != sizes).any() or b"".join(map(table.__getitem__, each)) != joined:
                ends = ends.tolist()
                ok &= np.array([b"".join(map(table.__getitem__, each[x:y])) == r for x, y, r in zip(ends, ends[1:], raw)], bool)
        return ok


class Chunks:
    """What is known of distinct chunks: token, group and link counts, id pairs of the links, and the groups as digits."""

    def __init__(self, tokenizers: Tokenizers, most: int = 400_000, most_links: int = 8_000_000):
        self.t, self.most, self.most_links = tokenizers, most, most_links
        self.digits = Digits(max(len(tokenizers.a_tokens), len(tokenizers.b_tokens)))
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.text: list[str] = []
        self.numbers = np.zeros((0, 5), np.int64)  # A tokens, B tokens, groups, links, links within groups
        self.sound = np.zeros(0, bool)
        self.begin, self.codes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, each: list[str]) -> np.ndarray:
        """Places of chunks; new ones are encoded and aligned."""
        if len(self.place) > self.most or len(self.codes) > self.most_links:
            self.clear()
        at = np.fromiter(map(self.place.get, each, itertools.repeat(-1)), np.int64, len(each))
        new = np.flatnonzero(at < 0)
        if len(new):
            missing = [each[i] for i in new.tolist()]
            self._learn(list(dict.fromkeys(missing)))
            at[new] = np.fromiter(map(self.place.get, missing), np.int64, len(missing))
        return at

    def _learn(self, new: list[str]) -> None:
        t = self.t
        a, b = t.encode(new)
        sound = t.sound(new, a, b)
        if not sound.all():
            a, b = (Tokens(x.ids[np.repeat(sound, x.count)], np.where(sound, x.count, 0)) for x in (a, b))
        made = aligned(t.a_bytes[a.ids], t.b_bytes[b.ids])
        a_end, b_end = np.cumsum(a.count), np.cumsum(b.count)
        groups = np.searchsorted(made.a_end, a_end, "right")  # a chunk's end is a group's end
        links = np.searchsorted(made.a, a_end, "left")
        inside = np.concatenate([[0], np.cumsum(product_sizes(*group_links(made.a_end, made.b_end)))])[a_end]
        self.place.update(zip(new, range(len(self.sound), len(self.sound) + len(new))))
        self.numbers = np.concatenate([self.numbers, np.stack([a.count, b.count, *(np.diff(x, prepend=0) for x in (groups, links, inside))], 1)])
        self.sound = np.concatenate([self.sound, sound])
        self.begin = np.concatenate([self.begin, len(self.codes) + np.concatenate([[0], links[:-1]])])
        self.codes = np.concatenate([self.codes, a.ids[made.a] * len(t.b_tokens) + b.ids[made.b]])
        self.text += self._digits(a.ids, b.ids, made, np.concatenate([[0], groups]))

    def _digits(self, a: np.ndarray, b: np.ndarray, made: Aligned, groups: np.ndarray) -> list[str]:
        """For each chunk ``a1,a2|b1;a3|b2,b3``, from the tokens in the order of groups, A before B."""
        n_a, n_b = np.diff(made.a_end, prepend=0), np.diff(made.b_end, prepend=0)
        at_a = np.arange(len(a)) + np.repeat(made.b_end - n_b, n_a)
        at_b = np.arange(len(b)) + np.repeat(made.a_end, n_b)
        ids, marks = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[at_a], ids[at_b] = a, b
        marks[made.a_end + made.b_end - n_b - 1] = ord("|")
        marks[made.a_end + made.b_end - 1] = ord(";")
        raw, end = self.digits.write(ids, marks)
        raw = raw.decode()
        ends = np.concatenate([[0], end[made.a_end + made.b_end - 1]])[groups].tolist()
        return [raw[x : max(x, y - 1)] for x, y in zip(ends, ends[1:])]

    def links(self, at: np.ndarray) -> np.ndarray:
        """The id pairs of the links of the chunks at these places, one after another."""
        size = self.numbers[at, 3]
        end = np.cumsum(size)
        return self.codes[np.arange(int(end[-1]) if len(end) else 0) + np.repeat(self.begin[at] - (end - size), size)]


@lru_cache(maxsize=1)
def _tokenizers(a: str, b: str) -> Tokenizers:
    return Tokenizers(a, b)


@lru_cache(maxsize=1)
def _known(a: str, b: str) -> Chunks:
    """One for each Python worker, whatever the number of its tasks."""
    return Chunks(_tokenizers(a, b))


def _paths(a: str | None, b: str | None) -> tuple[str, str]:
    return a or public_tokenizers.path(DEFAULT_A), b or public_tokenizers.path(DEFAULT_B)


# --- whole alignments ---------------------------------------------------------------------------------------------------

_ALIGNMENT = "a_ids array<int>, b_ids array<int>, links array<struct<a:int,b:int,bytes:int>>, groups array<struct<a_end:int,b_end:int>>, shared array<struct<a:int,b:int>>"


def align(docs: DataFrame, a: str | None = None, b: str | None = None, shared: bool = False) -> DataFrame:
    """All columns of docs in the struct ``_row``, and ``alignment``: ids of both tokenizers, links by token places (from 0) with the
    bytes that are shared, the ends of the groups, and, if asked for, the links within groups (else none).

    This multiplies the whole text's matrices. shared lists every pair of a group, which for a group of n tokens is up to n²/4.
    """
    bounded_batches(docs.sparkSession)
    paths = _paths(a, b)

    @F.pandas_udf(_ALIGNMENT)
    def run(texts):
        import pandas as pd

        t, out = _tokenizers(*paths), []
        for text in texts:
            x, y = t.encode([" " + text]) if text and not t.cuts else (None, None)
            if text and t.cuts:
                each = t.chunks(text)
                x, y = (Tokens(m.ids, np.array([len(m.ids)])) for m in t.encode(each))
            if not text or not t.sound([" " + text], x, y)[0]:
                out.append(([], [], [], [], []))
                continue
            made = aligned(t.a_bytes[x.ids], t.b_bytes[y.ids])
            inside, _ = row_products(*group_links(made.a_end, made.b_end)) if shared else (Csr(np.zeros(1, int), np.zeros(0, int), 0), None)
            pairs = zip(np.repeat(np.arange(len(inside.start) - 1), np.diff(inside.start)).tolist(), inside.column.tolist())
            row = lambda names, *columns: [dict(zip(names, r)) for r in zip(*(c.tolist() for c in columns))]
            out.append((x.ids.tolist(), y.ids.tolist(), row(("a", "b", "bytes"), made.a, made.b, made.shared), row(("a_end", "b_end"), made.a_end, made.b_end), [{"a": i, "b": j} for i, j in pairs]))
        return pd.DataFrame(out, columns=["a_ids", "b_ids", "links", "groups", "shared"])

    return packed(docs, "text").select("_row", run("text").alias("alignment"))


# --- counts over the corpus ---------------------------------------------------------------------------------------------

_DOC = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_shared", pa.int64()), ("groups_sha256", pa.string()), ("n_pairs", pa.int32())]
_BLOCK = pa.schema([("block", pa.int64()), ("pos", pa.int32()), ("pair", pa.int64()), ("holders", pa.int64()), ("docs", pa.list_(pa.struct(_DOC))), ("at", pa.binary()), ("times", pa.binary())])
_BLOCK_SQL = "block long, pos int, pair long, holders long, docs array<struct<doc_id:long,n_a:long,n_b:long,n_groups:long,n_links:long,n_shared:long,groups_sha256:string,n_pairs:int>>, at binary, times binary"


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers by planes of bytes, which compress well."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _whole(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1)


def _blocks(docs: DataFrame, paths: tuple[str, str], block_bytes: int) -> DataFrame:
    """For each block of documents: a row with its documents and their id pairs, as places in the block's list of pairs and how often
    each is linked; and a row for each pair of that list, with the number of documents that hold it."""

    def run(batches):
        import hashlib

        known = _known(*paths)
        squeeze = zstandard.ZstdCompressor(level=1, write_checksum=False)
        block, size, rows, codes, times = TaskContext.get().partitionId() << 32, 0, [], [], []

        def out():
            all_codes = np.concatenate(codes)
            pairs, at = np.unique(all_codes, return_inverse=True)
            holders = np.bincount(at, minlength=len(pairs))
            columns = list(zip(*rows))
            docs = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _DOC)], fields=[pa.field(n, t) for n, t in _DOC])
            whole = [pa.array([block], pa.int64()), *(pa.nulls(1, t) for t in (pa.int32(), pa.int64(), pa.int64())), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), docs)]
            yield pa.RecordBatch.from_arrays([*whole, pa.array([squeeze.compress(_planes(at))]), pa.array([squeeze.compress(_planes(np.concatenate(times)))])], schema=_BLOCK)
            for i in range(0, len(pairs), 100_000):
                n = len(pairs[i : i + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(np.arange(i, i + n), pa.int32()), pa.array(pairs[i : i + n]), pa.array(holders[i : i + n]), *(pa.nulls(n, _BLOCK.field(k).type) for k in (4, 5, 6))], schema=_BLOCK)

        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = part.column(1).to_pylist()
                each = [known.t.chunks(x) if x else [] for x in texts]
                at = known.find(list(itertools.chain.from_iterable(each)))
                end = np.cumsum([len(x) for x in each], dtype=np.int64)
                bad = np.concatenate([[0], np.cumsum(~known.sound[at])])
                sound = (np.diff(bad[np.concatenate([[0], end])]) == 0) & (np.diff(end, prepend=0) > 0)
                at = at[np.repeat(sound, np.diff(end, prepend=0))]
                end = np.cumsum(np.where(sound, np.diff(end, prepend=0), 0))
                sums = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(known.numbers[at], 0)])
                sums = np.diff(sums[np.concatenate([[0], end])], axis=0)
                code = known.links(at)
                row = np.repeat(np.arange(len(texts)), sums[:, 3])
                key, n = np.unique(row * (len(known.t.a_tokens) * len(known.t.b_tokens)) + code, return_counts=True)
                row, code = np.divmod(key, len(known.t.a_tokens) * len(known.t.b_tokens))
                n_pairs = np.bincount(row, minlength=len(texts))
                codes.append(code)
                times.append(n)
                places = at.tolist()
                for k, (doc_id, e) in enumerate(zip(part.column(0).to_pylist(), end.tolist())):
                    own = places[int(end[k - 1]) if k else 0 : e]
                    digest = hashlib.sha256(";".join([known.text[i] for i in own]).encode()).hexdigest() if own else ""
                    rows.append((doc_id, *sums[k].tolist(), digest, int(n_pairs[k])))
                size += sum(map(len, filter(None, texts)))
                if size >= block_bytes:
                    yield from out()
                    block, size, rows, codes, times = block + 1, 0, [], [], []
        if rows:
            yield from out()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _BLOCK_SQL)


def _pair_counts(blocks: DataFrame) -> DataFrame:
    return blocks.where("pair is not null").groupBy("pair").agg(F.sum("holders").alias("n"))


def pair_counts(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """(a, b, n): id pairs that are linked in any document, and in how many documents."""
    bounded_batches(docs.sparkSession)
    paths = _paths(a, b)
    width = len(_tokenizers(*paths).b_tokens)
    counts = _pair_counts(_blocks(docs, paths, 8 << 20))
    return counts.select(F.expr(f"cast(pair div {width} as int)").alias("a"), F.expr(f"cast(pair % {width} as int)").alias("b"), "n")


def report(docs: DataFrame, a: str | None = None, b: str | None = None, block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_shared (links within groups), groups_sha256, n_best and count_sum of every row of docs.

    n_best: links whose id pair is held by as many documents as any pair of that A id; count_sum: the number of documents of the id pair,
    over all links. Broadcast is only the highest count of each A id, one row an id of the vocabulary.
    """
    bounded_batches(docs.sparkSession)
    paths = _paths(a, b)
    width = len(_tokenizers(*paths).b_tokens)
    blocks = stage(_blocks(docs, paths, block_bytes), "aligned")
    counts = stage(_pair_counts(blocks).withColumn("a", F.expr(f"pair div {width}")), "pair-counts")
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    marked = counts.join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    asked = blocks.where("pair is not null").select("block", "pos", "pair")
    answers = asked.join(marked, "pair").groupBy("block").agg(F.collect_list(F.struct("pos", "n", "best")).alias("answers"))
    whole = blocks.where("docs is not null").select("block", "docs", "at", "times").join(answers, "block", "left").drop("block")

    def run(batches):
        open_ = zstandard.ZstdDecompressor()
        for b in batches:
            for i in range(b.num_rows):
                docs, got = b.column("docs").slice(i, 1).flatten(), b.column("answers").slice(i, 1).flatten()
                pos = got.field("pos").to_numpy()
                n, best = np.zeros(len(pos), np.int64), np.zeros(len(pos), bool)
                n[pos] = got.field("n").to_numpy()
                best[pos] = got.field("best").to_numpy(zero_copy_only=False)
                at, times = (_whole(open_.decompress(b.column(c)[i].as_py())).astype(np.int64) for c in ("at", "times"))
                end = np.concatenate([[0], np.cumsum(docs.field("n_pairs").to_numpy())])
                sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[end]) for x in (times * best[at], times * n[at])]
                yield pa.RecordBatch.from_arrays([*(docs.field(name) for name, _ in _DOC[:-1]), *map(pa.array, sums)], [*(name for name, _ in _DOC[:-1]), "n_best", "count_sum"])

    out = stage(whole.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string, n_best long, count_sum long"), "alignment")
    discard(blocks, counts)
    return out

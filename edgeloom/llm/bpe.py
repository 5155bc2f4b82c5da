"""Byte-level BPE encoding of distinct words over a trie, and decoding.

The words of a batch (the pieces that the pre-tokenizer's pattern cuts) are inserted into a trie of bytes. For the text on the
way from the root to a node, only the last token of its encoding is kept: the encoding of a prefix is the encoding of the
prefix without its last token, followed by that token. Depth-first, a node's last token is found among the tokens that end
there: it is the one token t for which the last token at t's beginning and t are a pair that merging keeps apart. So a
prefix that many words share is worked out once. Whether a pair is kept apart is worked out from the merges, once a pair.

Null counts as empty: no tokens. Every row is encoded, repeated rows alike; ids, null or repeated, play no part. Very long texts are
encoded whole, also those of one word. Special tokens found in a text are single ids, as the tokenizers library does by default;
decoding keeps them. An empty table gives no rows.
"""

import hashlib
import json
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import bounded_batches

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_VOCABULARY = "byte_bpe_50k.json"


def byte_letters() -> dict[str, int]:
    """The letters that vocabulary files of this kind write for bytes: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


@dataclass
class Vocabulary:
    """ids: token bytes to id; ranks: of merged pairs of ids, the rank and the id made; specials: strings to ids."""

    ids: dict[bytes, int]
    ranks: dict[tuple[int, int], tuple[int, int]]
    specials: dict[str, int]
    tokens: list[bytes] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        ids = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        ranks = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (raw(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            ranks[ids[a], ids[b]] = (rank, ids[a + b])
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [b""] * (1 + max([*ids.values(), *specials.values()]))
        for t, i in ids.items():
            tokens[i] = t
        for s, i in specials.items():
            tokens[i] = s.encode()
        return cls(ids, ranks, specials, tokens)


class TrieEncoder:
    """Encodes words by the trie; keeps encodings of up to max_words words between batches."""

    def __init__(self, vocabulary: Vocabulary, max_words: int = 150_000):
        self.v, self.max_words = vocabulary, max_words
        self.known: dict[str, tuple[int, ...]] = {}
        self.split: dict[int, tuple[int, int]] = {made: pair for pair, (_, made) in sorted(vocabulary.ranks.items(), key=lambda x: -x[1][0])}
        self.apart: dict[int, bool] = {}
        self.reach = self._reversed()

    def _reversed(self) -> dict:
        """A trie of the tokens' bytes from their end: the tokens that end at a place are found in one walk back."""
        top: dict = {}
        for t, i in self.v.ids.items():
            node = top
            for b in reversed(t):
                node = node.setdefault(b, {})
            node[-1] = i
        return top

    def kept_apart(self, a: int, b: int) -> bool:
        """Whether merging the bytes of tokens a and b ends in just these two.

        Undoes the merges of both sides, latest first: what was made on the left or right of the border must have come
        before any merge across the border.
        """
        got = self.apart.get(a << 32 | b)
        if got is None:
            got = self._kept_apart(a, b)
            if len(self.apart) >= 300_000:
                self.apart.clear()
            self.apart[a << 32 | b] = got
        return got

    def _kept_apart(self, a: int, b: int) -> bool:
        limit = 1 << 60
        ranks, split = self.v.ranks, self.split
        while True:
            across = ranks.get((a, b))
            if across is not None and across[0] < limit:
                return False
            sa, sb = split.get(a), split.get(b)
            ra = ranks[sa][0] if sa else -1
            rb = ranks[sb][0] if sb else -1
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # the left was finished last; a merge across the border had to come before it
                limit, a = ra, sa[1]
            else:  # the right was finished last; an equal merge across the border, being further left, came before it
                limit, b = rb + 1, sb[0]

    def encode(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """Token ids of each word, in a dictionary that holds at least these."""
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            if len(known) + len(new) > self.max_words:
                known = self.known = {w: known[w] for w in words if w in known} if len(words) < self.max_words else {}
                new = [w for w in words if w not in known]
            known.update(self._traverse(new))
        return known

    def _traverse(self, words: list[str]):
        """Depth first over the words in byte order, which is a walk over their trie: the path holds one state a depth.

        A state is (last token's id, its length); a word's common part with the one before it keeps its states.
        """
        pairs = sorted((w.encode(), w) for w in words)
        last: list[int] = [-1]
        size: list[int] = [0]
        before = b""
        reach, apart, kept_apart = self.reach, self.apart, self.kept_apart
        for data, word in pairs:
            n, m = len(data), min(len(data), len(before))
            k = 0
            while k < m and data[k] == before[k]:
                k += 1
            del last[k + 1 :], size[k + 1 :]
            for end in range(k + 1, n + 1):
                node, at = reach, end
                while True:  # the tokens that end here, shortest first
                    at -= 1
                    node = node[data[at]]
                    t = node.get(-1)
                    if t is not None:
                        if not at:
                            break
                        key = last[at] << 32 | t
                        if apart[key] if key in apart else kept_apart(last[at], t):
                            break
                last.append(t)
                size.append(end - at)
            out, at = [], n
            while at:
                out.append(last[at])
                at -= size[at]
            out.reverse()
            before = data
            yield word, tuple(out)


class Words:
    """Cuts texts into words, as the pre-tokenizer does; special tokens come as their ids."""

    def __init__(self, specials: dict[str, int]):
        self.specials = specials
        self.pieces = regex.compile(PATTERN).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None

    def __call__(self, text: str) -> list:
        if self.special is None or not any(s in text for s in self.specials):
            return self.pieces(text)
        out: list = []
        for part in self.special.split(text):
            if part in self.specials:
                out.append(self.specials[part])
            elif part:
                out += self.pieces(part)
        return out


class Coder:
    """Texts to ids and back with one vocabulary file."""

    def __init__(self, path: str):
        self.v = Vocabulary.load(path)
        self.trie = TrieEncoder(self.v)
        self.words = Words(self.v.specials)

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        each = [self.words(t) for t in texts]
        known = self.trie.encode({w for ws in each for w in ws if isinstance(w, str)})
        return [[i for w in ws for i in (known[w] if isinstance(w, str) else (w,))] for ws in each]

    def decode(self, ids) -> str:
        t = self.v.tokens
        return b"".join([t[i] for i in ids]).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """docs with token_ids array<int>: the whole text's ids."""
    bounded_batches(docs.sparkSession, 4 << 20)
    coder = _coders(path)

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series(coder().encode_batch([t or "" for t in texts]))

    return docs.withColumn("token_ids", ids(text))


def decode(encoded: DataFrame, path: str | None = None, ids: str = "token_ids") -> DataFrame:
    """encoded with decoded_text, special tokens kept."""
    coder = _coders(path)

    @F.pandas_udf("string")
    def text(each: pd.Series) -> pd.Series:
        return pd.Series([None if i is None else coder().decode(i) for i in each])

    return encoded.withColumn("decoded_text", text(ids))


def _coders(path: str | None):
    """A function that gives the worker's coder, made at its first call; the path defaults to the installed vocabulary's."""
    made: list[Coder] = []

    def get() -> Coder:
        if not made:
            made.append(Coder(path or public_tokenizers.path(DEFAULT_VOCABULARY)))
        return made[0]

    return get


_WORDS = 80_000
_DIGESTS = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}


def _digested(c: Coder, parts: dict, texts, most: int, with_ids: bool) -> list[tuple]:
    """The digests of each text. parts: of up to about ``most`` words known so far, their ids' digits and their ids."""
    each = [c.words(t) if t else [] for t in texts]
    words = set().union(*each)
    new = words.difference(parts)
    if len(parts) + len(new) > most:
        parts.clear()
        new = words
    for w, ids in chain(c.trie._traverse([w for w in new if isinstance(w, str)]), ((w, (w,)) for w in new if not isinstance(w, str))):
        parts[w] = (",".join(map(str, ids)), ids)
    token, out = c.v.tokens.__getitem__, []
    for ws in each:
        own = list(map(parts.__getitem__, ws))
        ids = list(chain.from_iterable([p[1] for p in own]))
        digits = hashlib.sha256(",".join([p[0] for p in own]).encode()).hexdigest()
        decoded = b"".join(map(token, ids)).decode("utf-8", "replace")
        out.append((len(ids), digits, hashlib.sha256(decoded.encode()).hexdigest(), *([np.array(ids, np.int32)] if with_ids else [])))
    return out


def digests(docs: DataFrame, path: str | None = None, with_ids: bool = False, most: int = _WORDS) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256 of each whole text encoded and its ids decoded again; also token_ids, if asked.

    A task keeps, for each of up to ``most`` words of the trie, its ids and their decimal digits, and is sent 1 MB of texts at a time.
    A column of docs that has one of these names is replaced.
    """
    bounded_batches(docs.sparkSession, 1 << 20)
    coder = _coders(path)
    parts: dict = {}
    names = [*_DIGESTS, *(["token_ids"] if with_ids else [])]
    schema = ", ".join(f"{c} {t}" for c, t in (_DIGESTS | {"token_ids": "array<int>"}).items() if c in names)

    @F.pandas_udf(schema)
    def digest(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(_digested(coder(), parts, texts, most, with_ids), columns=names)

    made = docs.withColumn("_bpe", digest("text"))
    return made.withColumns({c: F.col(f"_bpe.{c}") for c in names}).drop("_bpe")

"""Language identification by compression.

Each language has a zstandard raw-content dictionary of sampled text. A text is reduced to its words and cut into blocks; each
block is compressed with every dictionary, and the language whose dictionary gives the smallest total wins. The margin between
the smallest and the second total, as a share of the second, rejects undecided texts. Texts of all lengths go the same way.

The dictionaries are filled from pieces of the learning texts, chosen by a hash of id, length and place, so a long text teaches as
many short ones do.

Null texts and texts without a letter get ``und`` with score 0 and are rejected. Ties go to the language with more learning
rows, then to the smaller name. Rows with a null language or text teach nothing; without learning rows every text gets ``und``;
with one language every other text gets it. Repeated rows are judged alike; equal pieces are learned once. Very long texts are read
whole. Columns other than doc_id, text and lang are not looked at, and no column of docs is lost to the new ones' names in
``language_id``. An empty table gives no rows.
"""

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import bounded_batches, fold, letters

UNKNOWN = "und"
_GAPS = re.compile(r"[\W\d_]+")


def spelled(text: str) -> str:
    """Lower-cased words with a blank before and after each: marks, digits and layout say little about the language."""
    return f" {_GAPS.sub(' ', text.lower()).strip()} "


@dataclass(frozen=True)
class LangParams:
    """sample_pieces: pieces of piece_chars characters that a language is learned from at most (about); model_bytes: the longest that
    all dictionaries together are."""

    sample_pieces: int = 160
    piece_chars: int = 2_000
    dictionary_bytes: int = 200_000
    model_bytes: int = 64_000_000
    level: int = 3
    block_bytes: int = 1_024
    min_margin: float = 0.004


@dataclass
class LangModel:
    """For each language, most learning rows first, its dictionary's content."""

    languages: list[str]
    contents: list[bytes]


def dictionary(pieces: set[str], most: int) -> bytes:
    """Pieces by their checksums, as many as go into ``most`` bytes."""
    out, size = [], 0
    for t in sorted(pieces, key=lambda t: (zlib.crc32(t.encode()), t)):
        b = t.encode()
        if size + len(b) <= most or not out:
            out.append(b[:most])
            size += len(b)
    return b"".join(out) or b"\n" * 8


def train(docs: DataFrame, learn=None, p: LangParams = LangParams()) -> LangModel:
    """From text and lang of the rows for which the column learn holds.

    What comes to the driver is one count a language, and about sample_pieces different pieces of each, one at least, chosen by a hash
    of text and place: neither ids nor copies of a text play a part. With very many languages, their share of model_bytes gets smaller,
    and fewer pieces are drawn.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.lit(True) if learn is None else learn)).select(F.col("text").cast("string").alias("text"), "lang")
    rows = rows.withColumns({"n": F.greatest(F.lit(1), F.ceil(F.length("text") / p.piece_chars)).cast("int"), "h": F.xxhash64("text")})
    different = rows.groupBy("lang", "h", "n").agg(F.count("*").alias("rows"))
    counts = {r["lang"]: r["pieces"] for r in different.groupBy("lang").agg(F.sum("rows").alias("rows"), F.sum("n").alias("pieces")).orderBy(F.desc("rows"), "lang").collect()}
    if not counts:
        return LangModel([], [])
    most = min(p.dictionary_bytes, p.model_bytes // len(counts))
    wanted = max(1, min(p.sample_pieces, 2 * most // p.piece_chars))
    cut = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, wanted / n))])
    chosen = "filter(sequence(0, n - 1), i -> pmod(xxhash64(h, i), 1L << 30) < share * (1L << 30))"
    drawn = rows.withColumn("share", cut[F.col("lang")]).withColumn("i", F.explode(F.expr(chosen)))
    drawn = drawn.select("lang", F.expr(f"substring(text, i * {p.piece_chars} + 1, {p.piece_chars})").alias("piece"))
    first = rows.groupBy("lang").agg(F.min_by(F.substring("text", 1, p.piece_chars), F.struct("h", "n")).alias("piece"))  # none is left without
    drawn = drawn.union(first).distinct()
    texts: dict[str, set[str]] = {lang: set() for lang in counts}
    for r in drawn.toLocalIterator():
        texts[r["lang"]].add(spelled(r["piece"]))
    return LangModel(list(counts), [dictionary(texts[lang], most) for lang in counts])


class Compressors:
    """The model's dictionaries, made ready once for each worker."""

    def __init__(self, model: LangModel, p: LangParams):
        self.p, self.languages = p, model.languages
        self.each = []
        for content in model.contents:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=p.level)
            self.each.append(zstandard.ZstdCompressor(level=p.level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> np.ndarray:
        """Compressed bytes of all blocks of the text with each language's dictionary."""
        data = spelled(text).encode()
        step = self.p.block_bytes
        blocks = [data[i : i + step] for i in range(0, len(data), step)]
        return np.array([sum(len(c.compress(b)) for b in blocks) for c in self.each])

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin."""
        if text is None or not self.languages or not letters(text):
            return UNKNOWN, 0.0, 0.0
        n = self.sizes(text)
        best = int(np.argmin(n))
        second = int(np.min(np.delete(n, best))) if len(n) > 1 else 2 * int(n[best])
        margin = (second - n[best]) / max(second, 1)
        return self.languages[best], float(1 - np.exp(-25 * margin)), float(margin)


def identify(docs: DataFrame, model: LangModel, p: LangParams = LangParams()) -> DataFrame:
    """docs with lang_pred, lang_score, lang_margin and lang_rejected (no letter, or a margin under min_margin)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    ready: list[Compressors] = []

    @F.pandas_udf("lang string, score double, margin double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        if not ready:
            ready.append(Compressors(shared.value, p))
        return pd.DataFrame([ready[0].predict(t) for t in texts], columns=["lang", "score", "margin"])

    out = docs.withColumn("_lang", predicted("text"))
    return out.withColumns({"lang_pred": F.col("_lang.lang"), "lang_score": F.col("_lang.score"), "lang_margin": F.col("_lang.margin"), "lang_rejected": (F.col("_lang.lang") == UNKNOWN) | (F.col("_lang.margin") < p.min_margin)}).drop("_lang")


def language_id(docs: DataFrame, p: LangParams = LangParams()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, rejected for every row of docs."""
    model = train(docs, fold("doc_id", 4) != 2, p)
    out = identify(docs.select("doc_id", "text"), model, p)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_margin").alias("margin"), F.col("lang_rejected").alias("rejected"))

"""The corpus pipeline: toxicity, language ID, near-duplicate removal, benchmark decontamination, BPE encoding.

What holds for every stage: it works on all rows that the one before kept, and on whole texts. Rows may have null or repeated ids, null
or empty texts, and columns of any names beside doc_id, text and lang, which come through unchanged. Rows that are equal in all
columns are treated alike. An empty table of documents, labels or benchmark items gives a result, if an empty one.
"""

from pyspark.sql import DataFrame, SparkSession

from edgeloom.llm import bpe, decontaminate, langid, ngram_join, toxicity
from edgeloom.llm.common import discard, fold, packed, stage


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, fitted on labels of this input, gives 0.5 or more go.

    Null and empty texts get the bias, so they stay unless most labelled rows are toxic. Without labels of both classes every row
    stays, but for labels that are all toxic.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs.select("doc_id", "text"), labels, fold("doc_id", 5) != 0)
    return toxicity.score(packed(docs, "text"), model).where("toxicity_score < 0.5").select("_row.*")


def _language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too) or between two languages go; without any known language, all go."""
    model = langid.train(docs, fold("doc_id", 4) != 2)
    return langid.identify(packed(docs, "text"), model).where("not lang_rejected").select("_row.*")


def _ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: the one of the smallest id, null ids last, then by a hash of the text.

    Rows without words are in no group and all stay. Repeated rows are a group.
    """
    return ngram_join.one_each(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that benchmark items hold go; documents of which more than half is such spans go whole.

    Texts without a hit, null texts among them, stay as they are.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of every whole text (none for a null or empty one), and digests of the ids and of what they decode to."""
    return bpe.digests(docs, with_ids=True)


STAGES = [("toxicity", _toxicity), ("language_id", _language_id), ("ngram_jaccard", _ngram_jaccard), ("decontamination", _decontamination), ("bpe", _bpe)]

#: Learned models and token merging have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again, and the one before deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

"""The queries opN_<name> over the driver's tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from edgeloom.llm import alignment, bpe, chat, decontaminate, langid, licenses, neighbours, ngram_join, phrases, sharding, token_files, toxicity, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), most=300_000).drop("text")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op6_chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_turns(table(spark, sf_dir, "conversations"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    import corpus_pipeline

    return {
        "op1_toxicity": op1_toxicity,
        "op2_decontamination": op2_decontamination,
        "op3_bpe": op3_bpe,
        "op4_nearest": op4_nearest,
        "op5_token_files": op5_token_files,
        "op6_chat_turns": op6_chat_turns,
        "op7_licenses": op7_licenses,
        "op8_url_filter": op8_url_filter,
        "op9_language_id": op9_language_id,
        "op10_ngram_jaccard": op10_ngram_jaccard,
        "op11_token_alignment": op11_token_alignment,
        "op12_collocations": op12_collocations,
        "op13_sharding": op13_sharding,
        "pipeline": corpus_pipeline.run,
    }


#: Phrases by plain n-grams: all runs of 1 to 4 words counted, every cut scored, and candidates within longer ones looked up.
COLLOCATIONS = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM words GROUP BY lang),
runs AS (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: ws[i:i + m - 1])) AS p FROM words, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(ws) >= m),
f AS (SELECT lang, m, p, count(*) AS a FROM runs GROUP BY lang, m, p HAVING count(*) >= 30),
cuts AS (SELECT c.lang, c.p, c.m, c.a, k, x.a AS l, y.a AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (x.a + y.a) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1) c JOIN f x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1:c.m]),
cut AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inside AS (SELECT lang, p[s:s + size - 1] AS q, max(a) AS over FROM (SELECT *, unnest(range(1, m - size + 2)) AS s FROM (SELECT *, unnest(range(2, m)) AS size FROM f WHERE m > 2)) GROUP BY ALL),
kept AS (SELECT cut.* FROM cut LEFT JOIN inside i ON i.lang = cut.lang AND i.q = cut.p WHERE i.over IS NULL OR 100 * i.over < 80 * cut.a),
ranked AS (SELECT *, array_to_string(p, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, totals.n, score FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_collocations": COLLOCATIONS}

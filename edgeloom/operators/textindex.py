"""Ranked text search over an inverted index that is built once and read by term.

Postings (term, id, field, n, impact, positions) are kept as a table partitioned by a hash of the term and sorted by term within its
files, so a query reads the partitions of its own words only; titles are a narrow table beside them. A term that very many texts hold
is spread over files by id. The rank is that of ``textsim.search``: the sum over fields of weight times ln(1 + occurrences) of each
word, plus 10 if the title holds the query.
"""

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions.text import lookup_key

POSTINGS = "term string, id {id}, field string, n long, impact double, positions array<int>, bucket int"


class TextIndex(NamedTuple):
    postings: DataFrame
    titles: DataFrame
    buckets: int


def _bucket(term, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build_index(docs: DataFrame, fields: list[str], path: str, buckets: int = 64) -> TextIndex:
    """Index the fields of docs (id, title, ...; ids are unique) below path. Texts are read once; null and empty fields have no words."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), lookup_key(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias("text")) for f in fields]))
    words = docs.select("id", each.alias("f")).select("id", "f.field", F.posexplode(F.split("f.text", " ")).alias("pos", "term")).where("term <> ''")
    lists = words.groupBy("id", "field", "term").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("pos")).alias("positions"))  # of one field of one text
    lists = lists.select("term", "id", "field", "n", F.log1p(F.col("n").cast("double")).alias("impact"), "positions", _bucket("term", buckets).alias("bucket"))
    lists.repartitionByRange("bucket", "term", "id").sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").parquet(f"{path}/postings")
    docs.select("id", "title").write.parquet(f"{path}/titles")
    return open_index(docs.sparkSession, path, dict(docs.dtypes)["id"], buckets)


def open_index(spark: SparkSession, path: str, id_type: str = "long", buckets: int = 64) -> TextIndex:
    return TextIndex(spark.read.schema(POSTINGS.format(id=id_type)).parquet(f"{path}/postings"), spark.read.schema(f"id {id_type}, title string").parquet(f"{path}/titles"), buckets)


def postings_of(index: TextIndex, words: list[str]) -> DataFrame:
    """The postings of these words: filters on bucket and term, which prune partitions and files."""
    one = lambda w: (F.col("bucket") == _bucket(F.lit(w), index.buckets)) & (F.col("term") == w)
    cond = F.lit(False)
    for w in sorted(set(words)):
        cond = cond | one(w)
    return index.postings.where(cond)


def ranked(index: TextIndex, query: str, fields: dict[str, float]) -> DataFrame:
    """(id, title, rank) of all documents that hold a word of the query, or the query within their title."""
    words = [w for w in query.lower().split() if w]
    weight = F.create_map(*[x for f, w in fields.items() for x in (F.lit(f), F.lit(float(w)))])
    often = F.create_map(*[x for w in sorted(set(words)) for x in (F.lit(w), F.lit(float(words.count(w))))])
    hits = postings_of(index, words).where(F.col("field").isin(*fields)).groupBy("id").agg(F.sum(F.col("impact") * weight[F.col("field")] * often[F.col("term")]).alias("own"))
    named = F.when(F.contains(F.lower("title"), F.lit(query.lower())), 10.0).otherwise(0.0)
    return index.titles.join(hits, "id", "left").withColumn("rank", F.round(named + F.coalesce("own", F.lit(0.0)), 6)).where("rank > 0").select("id", "title", "rank")


def search(index: TextIndex, query: str, fields: dict[str, float], most: int = 20) -> DataFrame:
    return ranked(index, query, fields).orderBy(F.desc("rank"), "title", "id").limit(most)


def search_reachable(index: TextIndex, nodes: DataFrame, states: DataFrame, query: str, fields: dict[str, float], most: int = 20) -> DataFrame:
    """search among the reachable nodes, with depth and path; ties by views (nodes: id, views), depth, title."""
    hits = ranked(index, query, fields).join(nodes.select("id", "views"), "id").join(states.select("id", "depth", "path_titles"), "id")
    return hits.orderBy(F.desc("rank"), F.desc_nulls_last("views"), "depth", "title", "id").limit(most).select("id", "title", "rank", "depth", "path_titles", "views")


def phrase(index: TextIndex, query: str, field: str) -> DataFrame:
    """(id, n): documents whose field holds the query's words next to each other, and how often."""
    words = [w for w in query.lower().split() if w]
    found = postings_of(index, words).where(F.col("field") == field)
    places = [F.struct(F.lit(k).alias("k"), F.lit(w).alias("term")) for k, w in enumerate(words)]
    starts = found.join(F.broadcast(found.sparkSession.range(1).select(F.explode(F.array(*places)).alias("p")).select("p.*")), "term")
    starts = starts.select("id", "k", F.explode("positions").alias("pos")).groupBy("id", (F.col("pos") - F.col("k")).alias("start")).agg(F.count("*").alias("n"))
    return starts.where(F.col("n") == len(words)).groupBy("id").agg(F.count("*").alias("n"))

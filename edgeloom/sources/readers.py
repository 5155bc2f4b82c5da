"""Readers that validate what they read and split it into valid and rejected rows."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def page_corpus(pages: DataFrame, cached: DataFrame) -> DataFrame:
    """(title, text, revision, sha256, status) of titles not cached yet; of several rows of a title the first revision."""
    first = F.row_number().over(Window.partitionBy("title").orderBy("revision"))
    fresh = pages.withColumn("_n", first).where("_n = 1").drop("_n").join(cached.select("title").distinct(), "title", "left_anti")
    status = F.when(F.col("text").isNull(), "error").when(F.col("text") == "", "missing").otherwise("ok")
    return fresh.withColumns({"sha256": F.sha2("text", 256), "status": status})


REVIEW_CELL = "array<struct<target:string,confidence:string,evidence:string>>"


def relationship_reviews(spark: SparkSession, path: str, types: list[str], nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and missing targets of a CSV with a source id and one column of JSON lists for each relation type.

    Rows of unknown sources and edges to the source itself drop; targets are matched by lower-cased title; the ordinal runs
    over the relation types in order. Nodes: (id, title).
    """
    schema = "source_id string, " + ", ".join(f"{t} string" for t in types)
    rows = spark.read.csv(path, header=True, schema=schema, quote='"', escape='"', multiLine=True)
    rows = rows.join(nodes.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi")
    def cell(k: int, t: str):
        read = F.coalesce(F.from_json(t, REVIEW_CELL), F.array().cast(REVIEW_CELL))
        return F.transform(read, lambda c, i: F.struct(F.lit(k).alias("k"), i.alias("i"), F.lit(t).alias("relation"), c["target"].alias("target"), c["confidence"].alias("confidence")))

    cells = F.explode(F.flatten(F.array(*[cell(k, t) for k, t in enumerate(types)])))
    each = rows.select("source_id", cells.alias("c")).select("source_id", "c.*").where("target is not null and trim(target) <> ''")
    each = each.withColumn("ordinal", F.row_number().over(Window.partitionBy("source_id").orderBy("k", "i")) - 1)
    titles = nodes.groupBy(F.lower("title").alias("_key")).agg(F.min("id").alias("to_id"))
    found = each.join(titles, F.lower(F.trim("target")) == F.col("_key"), "left").select(F.col("source_id").alias("from_id"), "to_id", "relation", "ordinal", "target", "confidence")
    return found.where("to_id is not null and to_id <> from_id").drop("target"), found.where("to_id is null").select("from_id", "relation", "target").distinct()


def replace_run(stored: DataFrame, incoming: DataFrame, run: str) -> DataFrame:
    """Edges of a review run replaced by the incoming ones."""
    return stored.where(F.col("run") != run).unionByName(incoming.withColumn("run", F.lit(run)).select(*stored.columns))


def decisions(spark: SparkSession, path: str, allowed: list[str], keys: DataFrame, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Valid and rejected lines of a JSONL file of review decisions (key, decision, confidence, note).

    Rejected, with a reason: broken JSON, a missing field, an unknown decision or key. The last line of a key wins, by file
    name and place in the file (the struct ``line``), so a file may be read in parts and be one of many; the confidence is held to 0..1; a decision below ``least`` still needs a human.
    """
    schema = "key string, decision string, confidence double, note string, _corrupt string"
    place = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path, lineSep="\n").select("value", place.alias("line"), F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("j")).select("line", "value", "j.*")
    return decide(lines, allowed, keys, least)


def decide(lines: DataFrame, allowed: list[str], keys: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    known = keys.select("key").distinct().withColumn("_known", F.lit(True))
    reason = F.when(F.col("_corrupt").isNotNull(), "invalid json").when(F.col("key").isNull() | (F.col("key") == ""), "missing key").when(F.col("decision").isNull(), "missing decision").when(~F.col("decision").isin(*allowed), "unknown decision").when(F.col("_known").isNull(), "unknown key")
    each = lines.join(known, "key", "left").withColumn("reason", reason)
    ok = each.where("reason is null").withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("line")))).where("_n = 1")
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0))))
    ok = ok.select("key", "decision", held.alias("confidence"), "note", F.when(held >= least, "imported").otherwise("needs_human").alias("status"))
    return ok, each.where("reason is not null").select("line", "key", "reason")


def playlist(rows: DataFrame, stored: DataFrame, hosts: tuple[str, ...] = ("youtube.com", "youtu.be")) -> tuple[DataFrame, DataFrame]:
    """Valid and rejected rows of a playlist (id, song, artist?, url, ordinal?, line).

    A URL needs http(s) and an allowed host or its subdomain; a missing ordinal runs on after the greatest stored or given one.
    """
    host = F.lower(F.regexp_extract("url", r"^https?://([^/?#:]+)", 1))
    allowed = F.lit(False)
    for h in hosts:
        allowed = allowed | (host == h) | F.endswith(host, F.lit("." + h))
    reason = F.when(F.coalesce(F.trim("id"), F.lit("")) == "", "missing id").when(F.coalesce(F.trim("song"), F.lit("")) == "", "missing song").when(~F.coalesce(allowed, F.lit(False)), "bad url")
    each = rows.withColumn("reason", reason)
    own = Window.partitionBy("id")
    valid = each.where("reason is null").join(stored.groupBy("id").agg(F.max("ordinal").alias("_most")), "id", "left")
    most = F.greatest(F.coalesce("_most", F.lit(-1)), F.coalesce(F.max("ordinal").over(own), F.lit(-1)))
    missing = F.sum(F.when(F.col("ordinal").isNull(), 1).otherwise(0)).over(own.orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    valid = valid.withColumn("_at", most).withColumn("_run", missing).withColumn("ordinal", F.coalesce("ordinal", (F.col("_at") + F.col("_run")).cast("int")))
    return valid.select("id", "song", F.nullif(F.trim("artist"), F.lit("")).alias("artist"), "url", "ordinal"), each.where("reason is not null").select("line", "reason")


def violations(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """(key, check) for each check that does not hold; a check that gives null holds."""
    failed = F.array(*[F.when(~c, F.lit(name)) for name, c in checks.items()])
    return df.select(F.col(key).cast("string").alias("key"), F.explode(F.array_compact(failed)).alias("check"))

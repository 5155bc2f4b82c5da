"""Upserts, change capture and selection of work, as set operations between a stored table and an incoming one."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """old (id, hash, last_fetched_at, last_changed_at, deleted_at) with new (id, hash, fetched_at).

    A fetched row moves last_fetched_at always, last_changed_at only if the hash is distinct from the old, and is not deleted.
    """
    n = new.select("id", F.col("hash").alias("_hash"), "fetched_at", F.lit(True).alias("_new"))
    j = old.withColumn("_old", F.lit(True)).join(n, "id", "full")
    fresh, changed = F.col("_new"), ~F.col("hash").eqNullSafe(F.col("_hash")) | F.col("_old").isNull()
    pick = lambda a, b: F.when(fresh, a).otherwise(b)
    return j.select(
        "id", pick(F.col("_hash"), F.col("hash")).alias("hash"), pick(F.col("fetched_at"), F.col("last_fetched_at")).alias("last_fetched_at"),
        pick(F.when(changed, F.col("fetched_at")).otherwise(F.col("last_changed_at")), F.col("last_changed_at")).alias("last_changed_at"), F.when(fresh.isNull(), F.col("deleted_at")).alias("deleted_at"),
    )


def insert_absent(stored: DataFrame, incoming: DataFrame, key: list[str], order: list) -> DataFrame:
    """Stored rows and those incoming rows whose key is new; of several incoming rows of a key the first in order."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    fresh = incoming.withColumn("_n", first).where("_n = 1").drop("_n").join(stored.select(*key).distinct(), key, "left_anti")
    return stored.unionByName(fresh.select(*stored.columns))


def replace_children(stored: DataFrame, incoming: DataFrame, parent: list[str]) -> DataFrame:
    """Children of parents that came in are replaced; those of other parents stay."""
    return stored.join(incoming.select(*parent).distinct(), parent, "left_anti").select(*stored.columns).unionByName(incoming.select(*stored.columns))


def max_merge(stored: DataFrame, incoming: DataFrame, key: list[str], greatest: list[str], fill: list[str], maps: list[str] = ()) -> DataFrame:
    """One row a key: the greatest of some columns, the first known value of others (stored before incoming), maps merged (incoming wins)."""
    both = stored.withColumn("_at", F.lit(0)).unionByName(incoming.withColumn("_at", F.lit(1)))
    known = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c) for c in fill]
    entries = [F.aggregate(F.transform(F.sort_array(F.collect_list(F.struct("_at", F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))).alias("e")))), lambda x: x["e"]), F.create_map().cast("map<string,string>"), lambda a, e: F.map_concat(F.map_filter(a, lambda k, v: ~F.exists(e, lambda x: x["key"] == k)), F.map_from_entries(e))).alias(m) for m in maps]
    return both.groupBy(*key).agg(*[F.max(c).alias(c) for c in greatest], *known, *entries)


def revisions(old_counts: DataFrame, new_counts: DataFrame, hashes: DataFrame) -> DataFrame:
    """(id, before, after, delta) of child counts where the hash (old_hash, new_hash) changed."""
    changed = hashes.where(~F.col("old_hash").eqNullSafe(F.col("new_hash"))).select("id")
    j = changed.join(old_counts.select("id", F.col("n").alias("before")), "id", "left").join(new_counts.select("id", F.col("n").alias("after")), "id", "left").na.fill(0, ["before", "after"])
    return j.withColumn("delta", F.col("after") - F.col("before"))


def upsert_series(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(id, year, month, views): incoming replaces stored months."""
    return replace_children(stored, incoming, ["id", "year", "month"])


def latest_value(series: DataFrame) -> DataFrame:
    """(id, views of the newest month)."""
    return series.groupBy("id").agg(F.max_by("views", F.struct("year", "month")).alias("views"))


def soft_delete(stored: DataFrame, seed: DataFrame, now: Column) -> DataFrame:
    """Rows that are not in the seed set get deleted_at, unless they have it."""
    gone = stored.join(seed.select("id").distinct().withColumn("_in", F.lit(True)), "id", "left")
    return gone.withColumn("deleted_at", F.coalesce("deleted_at", F.when(F.col("_in").isNull(), now))).select(*stored.columns)


def stale(stored: DataFrame, queued: DataFrame, before: Column) -> DataFrame:
    """Ids of rows not deleted, last fetched before a time, and not queued."""
    return stored.where(F.col("deleted_at").isNull() & (F.col("last_fetched_at") < before)).join(queued.select("id").distinct(), "id", "left_anti").select("id", "last_fetched_at")


def new_keys(titles: DataFrame, known: DataFrame, queued: DataFrame) -> DataFrame:
    """Distinct titles in neither table."""
    return titles.select("title").distinct().join(known.select("title"), "title", "left_anti").join(queued.select("title"), "title", "left_anti")


def diff_feed(stored: DataFrame, since: Column) -> DataFrame:
    """Rows first seen or changed after a time: (id, change, at), newest first."""
    at = F.greatest("first_seen_at", "last_changed_at")
    out = stored.where((F.col("first_seen_at") > since) | (F.col("last_changed_at") > since))
    return out.select("id", F.when(F.col("first_seen_at") > since, "added").otherwise("updated").alias("change"), at.alias("at")).orderBy(F.desc("at"), "id")


def admitted(pages: DataFrame, allowed: DataFrame, class_edges: DataFrame, markers: tuple[str, ...]) -> DataFrame:
    """pages with ``signal``: infobox, manual, class or category, the first that holds; pages without one are left out."""
    out = pages.join(allowed.select("title").distinct().withColumn("_listed", F.lit(True)), "title", "left")
    out = out.join(class_edges.select("id").distinct().withColumn("_class", F.lit(True)), "id", "left")
    marked = F.exists("categories", lambda c: F.rlike(F.lower(c), F.lit("|".join(markers))))
    signal = F.when(F.col("has_infobox"), "infobox").when(F.col("_listed"), "manual").when(F.col("_class"), "class").when(marked, "category")
    return out.withColumn("signal", signal).where("signal is not null").select(*pages.columns, "signal")


def redirects(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, target) of pages that redirect to a node's title; of several targets of a name the first page's."""
    to = F.regexp_extract("text", r"(?is)^\s*#redirect\s*:?\s*\[\[([^\]|#]+)", 1)
    own = pages.select(F.col("title").alias("name"), F.trim(to).alias("target"), "page").where("target <> ''")
    own = own.join(nodes.select(F.col("title").alias("target")).distinct(), "target", "left_semi")
    return own.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("page"))).where("_n = 1").select("name", "target")


def merge_aliases(sources: list[DataFrame]) -> DataFrame:
    """(id, alias, position): aliases of several sources in order (pos within each), the first spelling of each kept."""
    all_ = None
    for k, s in enumerate(sources):
        own = s.select("id", "alias", F.lit(k).alias("_src"), "pos")
        all_ = own if all_ is None else all_.unionByName(own)
    kept = all_.withColumn("_n", F.row_number().over(Window.partitionBy("id", F.lower("alias")).orderBy("_src", "pos", "alias"))).where("_n = 1")
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("id").orderBy("_src", "pos", "alias")) - 1).select("id", "alias", "position")


def error_counters(errors: DataFrame, key: list[str], latest: list[str]) -> DataFrame:
    """Count, last time and last fields of errors (ts, event_id order ties) by key."""
    at = F.struct("ts", "event_id")
    return errors.groupBy(*key).agg(F.count("*").alias("n"), F.max("ts").alias("last_at"), *[F.max_by(c, at).alias(f"last_{c}") for c in latest])

"""Joins on keys that very many rows share."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def part_target(df: DataFrame, least: int = 10_000) -> int:
    """Rows of one key that a task may get before the key is dealt over several: half of an even part, ``least`` at least."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, df.count() // (2 * parts))


def heavy_keys(df: DataFrame, keys: list[str], target: int) -> DataFrame:
    """(keys, _salts): keys of more than target rows and over how many tasks to deal them. There are fewer than rows / target."""
    known = F.expr(" and ".join(f"`{k}` is not null" for k in keys))
    sizes = df.where(known).groupBy(*keys).agg(F.count("*").alias("_size"))
    return sizes.where(F.col("_size") > target).select(*keys, F.ceil(F.col("_size") / target).cast("int").alias("_salts"))


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", target: int | None = None) -> DataFrame:
    """big joined with small on keys; a key of more than target rows of big is dealt over several tasks by a hash of the row.

    Only such keys' rows of small are repeated, once a task. The list of such keys is broadcast: it is shorter than the number of
    tasks that big needs. how: inner, left, left_semi or left_anti. A null in a key joins nothing.
    """
    target = target or part_target(big)
    rows = heavy_keys(big, keys, target).collect()
    if not rows:
        return big.join(small, keys, how)
    kinds = dict(big.dtypes)
    heavy = F.broadcast(big.sparkSession.createDataFrame([tuple(r) for r in rows], ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", _salts int"))
    salts = F.coalesce("_salts", F.lit(1))
    dealt = big.join(heavy, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*big.columns), salts).cast("int")).drop("_salts")
    copies = small.join(heavy, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")

"""Connected components of links by the smallest label, for the similarity joins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import discard, part_target, spread_join, stage


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all ends of links (a, b): label is the component's smallest node.

    Each round takes the smallest label among neighbours and then the label of that label, so that chains shorten to half;
    rounds are written to the shared folder. A node with very many links, and a label that very many nodes have, are dealt over
    several tasks. Links to itself and repeated links do no harm; null ends are left out.
    """
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    edges = stage(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    target = part_target(edges)
    degrees = stage(edges.groupBy("b").agg(F.count("*").alias("size")).where(F.col("size") > target), "degrees")
    labels = stage(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("other")).select("node", F.least("node", "other").alias("label")), "labels")
    while True:
        of = labels.select(F.col("node").alias("b"), "label")
        near = spread_join(edges, of, ["b"], sizes=degrees, target=target).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        hooked = stage(hooked, "hooked")
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("top"))
        jumped = stage(spread_join(hooked, up, ["label"]).select("node", F.least("label", "top").alias("label"), "old"), "labels")
        moved = jumped.where("label < old").limit(1).count()
        discard(hooked, labels)
        labels = jumped
        if not moved:
            discard(edges, degrees)
            return labels.select("node", "label")

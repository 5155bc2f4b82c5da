"""Years: observations from text, weighted hints, evaluation, timelines."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.operators.aggregate import weighted_quantiles, weighted_stats
from edgeloom.operators.extract import year_spans

# Cue words by how sure they make a year next to them.
STRONG = "originat|emerg|began|creat|develop|first appear|form(?:ed)? in|invented"
WEAK = "popular|peak|revival|flourish|mainstream|prominent"
INFLUENCE = "influenc|inspir|root|derive"
NAMING = "coined|the (?:term|name|word)|named"
DIRECT = ("origin", "emergence")


def observations(texts: DataFrame) -> DataFrame:
    """(id, start, end, weight, confidence, kind, source) of texts (id, source: origin | summary | category, text).

    An origin's years weigh 10. A sentence's years weigh by the nearest cue before them within 120 characters (else one in the 90
    after them): 7.5 or 5, 3.2 or 2.4, .45, the first of each pair in the first two sentences; sentences about the name give none.
    A category's weigh .65, or .15 if they span more than 12 years.
    """
    sentences = texts.where("source = 'summary'").select("id", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("k", "text"))
    rest = texts.where("source <> 'summary'").select("id", F.lit(-1).alias("k"), "text", "source")
    each = sentences.withColumn("source", F.lit("summary")).where(~F.lower("text").rlike(NAMING)).unionByName(rest)
    each = each.withColumn("part", F.struct("k", "source", "text"))
    s = year_spans(each.select("id", "part", "text")).select("id", "part.*", "pos", "year_start", "year_end")
    before = F.lower(F.substr("text", F.greatest(F.lit(1), F.col("pos") - 119), F.least(F.col("pos"), F.lit(120))))
    after = F.lower(F.substr("text", F.col("pos") + 1, F.lit(90)))
    last = lambda cue: F.length(F.regexp_extract(before, rf"(?s)^(.*(?:{cue}))", 1))
    a, b, c = last(STRONG), last(WEAK), last(INFLUENCE)
    most = F.greatest(a, b, c)
    cue = F.when(most > 0, F.when(most == a, "strong").when(most == b, "weak").otherwise("influence")).when(after.rlike(WEAK), "weak").when(after.rlike(INFLUENCE), "influence")
    lead = F.col("k") <= 1
    weight = F.when(F.col("source") == "origin", 10.0).when(F.col("source") == "category", F.when(F.col("year_end") - F.col("year_start") <= 12, 0.65).otherwise(0.15)).when(cue == "strong", F.when(lead, 7.5).otherwise(5.0)).when(cue == "weak", F.when(lead, 3.2).otherwise(2.4)).when(cue == "influence", 0.45)
    kind = F.when(F.col("source") == "origin", "origin").when(F.col("source") == "category", "period").when(cue == "strong", "emergence").when(cue == "weak", "popularity").otherwise("influence")
    sure = F.when(F.col("source") == "origin", "high").when((F.col("source") == "summary") & (cue == "strong"), "medium").otherwise("low")
    return s.select("id", F.col("year_start").alias("start"), F.col("year_end").alias("end"), weight.alias("weight"), sure.alias("confidence"), kind.alias("kind"), "source").where("weight is not null")


def year_hints(obs: DataFrame) -> DataFrame:
    """One weighted hint an id (start, end, weight, confidence, kind, source): windows of beginning and relevance, mean, sd, confidence.

    The beginning pool is the direct observations, else those of some weight that are no influence, else all; its earliest cluster
    is what starts no later than 12 years after the earliest start or its end. Window bounds are weighted .16 / .84 quantiles.
    """
    own = Window.partitionBy("id")
    direct = (F.col("source") == "origin") | F.col("kind").isin(*DIRECT)
    solid = (F.col("kind") != "influence") & (F.col("weight") >= 0.6)
    o = obs.withColumns({"_direct": direct, "_solid": solid, "end": F.coalesce("end", "start")})
    o = o.withColumns({"_any_direct": F.max("_direct").over(own), "_any_solid": F.max("_solid").over(own)})
    base = F.when(F.col("_any_solid"), F.col("_solid")).otherwise(True)
    o = o.withColumns({"_base": base, "_pool": F.when(F.col("_any_direct"), F.col("_direct")).otherwise(base), "_later": F.when(F.col("_any_direct"), F.col("_direct") | ((F.col("kind") == "popularity") & (F.col("weight") >= 1.0))).otherwise(base)})
    first = F.min(F.when(F.col("_pool"), F.struct("start", "end"))).over(own)
    o = o.withColumn("_first", first).withColumn("_begin", F.col("_pool") & (F.col("start") <= F.greatest(F.col("_first.start") + 12, F.col("_first.end"))))
    o = o.withColumn("_mid", (F.col("start") + F.col("end")) / 2)
    begin, later = o.where("_begin"), o.where("_later")
    mean = weighted_stats(begin, ["id"], "_mid", "weight").select("id", F.round("mean", 2).alias("mean"), F.round("sd", 2).alias("sd"))
    low = weighted_quantiles(begin, ["id"], "start", "weight", {"_low": 0.16})
    high = weighted_quantiles(begin, ["id"], "end", "weight", {"_high": 0.84})
    until = weighted_quantiles(later, ["id"], "end", "weight", {"_until": 0.84})
    held = lambda c, a: F.greatest(a, F.least(c, F.lit(2050)))
    h = o.groupBy("id").agg(F.count("*").alias("n"), F.max_by("kind", F.struct("weight", (-F.col("start")).alias("s"), "kind")).alias("kind"), F.max(F.when(F.col("_base"), F.when((F.col("confidence") == "high") & (F.col("weight") >= 5), 2).when(F.col("confidence").isin("high", "medium") & (F.col("weight") >= 2), 1).otherwise(0))).alias("_c"))
    h = h.join(mean, "id").join(low, "id").join(high, "id").join(until, "id")
    h = h.withColumn("year_start", held(F.col("_low"), F.lit(900))).withColumn("beginning_end", held(F.col("_high"), F.col("year_start"))).withColumn("relevance_end", held(F.col("_until"), F.col("year_start")))
    gap = F.col("_e2")
    strong = later.select("id", "kind", "start", F.col("end").alias("e"), "source").join(h.select("id", F.col("year_start").alias("_s2"), F.col("beginning_end").alias("_e2")), "id").where(F.col("e") > gap + 2)
    strong = strong.where(F.col("kind").isin("popularity", "period") | ((F.col("kind").isin(*DIRECT) | (F.col("source") == "origin")) & (F.col("start") > gap + 2)) | ((F.col("start") <= gap) & (F.col("e") - gap >= 8))).select("id").distinct()
    h = h.join(strong.withColumn("_far", F.lit(True)), "id", "left")
    label = F.when(F.col("_c") == 2, "high").when(F.col("_c") == 1, "medium").otherwise("low")
    return h.select("id", "year_start", F.when(F.col("beginning_end") != F.col("year_start"), F.col("beginning_end")).alias("year_end"), "mean", "sd", "n", "kind", label.alias("confidence"), F.when(F.col("_far"), F.col("relevance_end")).alias("relevance_end"))


def hint_table(nodes: DataFrame, hints: DataFrame, excluded: Column) -> DataFrame:
    """One row a node: its hint, or why it has none (``excluded`` rows: regional)."""
    j = nodes.select("id", excluded.alias("_x")).join(hints, "id", "left")
    reason = F.when(F.col("_x"), "excluded").when(F.col("year_start").isNull(), "no_observation").otherwise("hint")
    return j.select("id", reason.alias("reason"), F.when(~F.col("_x"), F.col("year_start")).alias("year_start"), F.when(~F.col("_x"), F.col("confidence")).alias("confidence"))


def evaluate(hints: DataFrame, stored: DataFrame, off: int = 2) -> DataFrame:
    """(metric, value): coverage, counts by confidence, and mismatches of more than ``off`` years with stored ones (id, year)."""
    j = stored.join(hints, "id", "left")
    row = j.agg(F.count("*").alias("stored"), F.count("year_start").alias("covered"), *[F.count_if(F.col("confidence") == c).alias(c) for c in ("high", "medium", "low")], F.count_if(F.abs(F.col("year") - F.col("year_start")) > off).alias("mismatched"))
    names = ["stored", "covered", "high", "medium", "low", "mismatched"]
    return row.select(F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])).alias("metric", "value"))


def timeline(hints: DataFrame, edges: DataFrame, least: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a slice: the first hints (id, year, level) at a level or above by year then id; only edges that cross
    decades, and their ends."""
    shown = hints.where(F.col("level") >= least).orderBy("year", "id").limit(most).withColumn("decade", F.floor(F.col("year") / 10) * 10)
    at = lambda c: shown.select(F.col("id").alias(c), F.col("decade").alias(f"_{c}"))
    e = edges.join(at("from_id"), "from_id").join(at("to_id"), "to_id").where("_from_id <> _to_id").select(*edges.columns)
    ends = e.select(F.col("from_id").alias("id")).union(e.select("to_id")).distinct()
    return shown.join(ends, "id", "left_semi"), e


def infer_years(nodes: DataFrame, edges: DataFrame, gap: int = 8, step: int = 12) -> DataFrame:
    """(id, year): known years, else the latest parent's year + gap, in order of depth, else the least year + step * depth.

    nodes: (id, depth, year?). One join a depth level, so parents of a level are settled before it.
    """
    from edgeloom.operators.staging import cut

    least = nodes.agg(F.min("year").alias("_least"))
    depths = [r[0] for r in nodes.select("depth").distinct().orderBy("depth").collect()]
    done = None
    for d in depths:
        own = nodes.where(F.col("depth") == d)
        if done is None:
            made = own.select("id", "depth", "year", F.lit(None).cast("int").alias("_p"))
        else:
            parents = edges.join(done.select(F.col("id").alias("from_id"), F.col("year").alias("_y")), "from_id").groupBy(F.col("to_id").alias("id")).agg(F.max("_y").alias("_p"))
            made = own.join(parents, "id", "left").select("id", "depth", "year", F.col("_p").cast("int").alias("_p"))
        made = made.join(F.broadcast(least), F.lit(True)).select("id", F.coalesce("year", F.col("_p") + gap, F.col("_least") + step * F.col("depth")).cast("int").alias("year"))
        made = cut(made, "years")
        done = made if done is None else done.union(made)
    return done

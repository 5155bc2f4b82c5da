"""Curation: ownership rules, evidence indexes, approval, review rules, decisions, audits, queues."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.operators.aggregate import merge_evidence
from edgeloom.operators.extract import rule_ladder

# Rules in order; the first that holds decides (status, reason).
OWNERSHIP = [
    ("source_type = 'category' and lower(section) rlike 'by country'", ("rejected", "container artifact")),
    ("contains(lower(title), lower(region))", ("owned", "title names the region")),
    ("source_type = 'list' and section <> ''", ("owned", "sectioned list")),
    ("summary rlike '(?i)originat|emerged|developed in'", ("owned", "prose names the origin")),
    ("source_type = 'prose'", ("associated", "mention only")),
]
CONTAINER = "' by |dependent territories of |styles of music|music genres'"
BROAD = ("africa", "asia", "europe", "north america", "south america", "oceania", "latin america", "caribbean", "middle eastern", "african diaspora")
CULTURAL = "'music of latin america|music of the caribbean|latin american|caribbean music|middle eastern|north american|celtic music'"
ASIDE = "lower(section) in ('see also', 'references', 'external links'"
MUSIC_PAGE = "(source_title like 'music of %' or source_title like 'music in %')"
# Rules for proposed parents of regions; source_title is lower-cased. Countries: (lower-cased name) in ``countries``.
RELATION_RULES = [
    (f"lower(child) rlike {CONTAINER} or lower(parent) rlike {CONTAINER}", ("needs_review", "container name")),
    ("source_type = 'wikipedia_list' and has_context and relation = 'part_of'", ("accepted", "row context")),
    ("source_type = 'wikipedia_list' and has_context", ("needs_review", "unexpected relation of a list")),
    ("source_type = 'manual' and has_alias and relation = 'part_of'", ("accepted", "regional alias")),
    ("source_type = 'manual' and has_alias", ("needs_review", "unexpected relation of an alias")),
    ("source_type <> 'wikipedia_category'", ("needs_review", "not category-backed")),
    ("child = parent", ("rejected", "self edge")),
    ("relation = 'admin_parent' and (source_title like '% by %' or contains(source_title, 'dependent territor') or source_title like 'category:music in %')", ("accepted", "administrative category")),
    ("relation = 'admin_parent'", ("needs_review", "no administrative evidence")),
    ("relation = 'part_of'", ("accepted", "direct containment")),
    ("relation = 'cultural_region_of' and lower(child) = 'nordic' and parent_is_country", ("rejected", "points from the broader region")),
    (f"relation = 'cultural_region_of' and source_title rlike {CULTURAL}", ("accepted", "cultural category")),
    ("relation = 'diaspora_region_of' and contains(source_title, 'diaspora')", ("accepted", "diaspora category")),
    ("relation = 'historical_region_of' and source_title rlike 'ancient|medieval|renaissance|history'", ("accepted", "historical category")),
    ("relation in ('cultural_region_of', 'diaspora_region_of', 'historical_region_of')", ("needs_review", "parallel relation")),
]
# Rules for proposed members of regions.
MEMBER_RULES = [
    (f"lower(region) rlike {CONTAINER}", ("rejected", "container as region")),
    ("lower(title) like 'list of %' or lower(title) like 'category:%'", ("rejected", "artifact as member")),
    ("source_type = 'wikipedia_category'", ("accepted", "category membership")),
    (f"source_type = 'wikipedia_list' and {ASIDE})", ("needs_review", "generic list section")),
    ("source_type = 'wikipedia_list' and relation in ('regional_scene', 'local_scene', 'traditional_region', 'indigenous_region', 'historical_region', 'diaspora_region', 'cultural_region')", ("accepted", "list section")),
    (f"source_type = 'wikipedia_article' and {ASIDE}, 'further reading')", ("needs_review", "generic article section")),
    ("source_type = 'wikipedia_article' and model in ('deterministic-region-page-links-v1', 'deterministic-region-page-links-v2')", ("accepted", "filtered link")),
    (f"source_type = 'wikipedia_article' and {MUSIC_PAGE} and lower(section) = lower(title)", ("accepted", "section heading")),
    (f"source_type = 'wikipedia_article' and {MUSIC_PAGE} and lower(section) rlike 'classical|dance|folk|genre|indigenous|local|popular|regional|scene|style|tradition'", ("accepted", "section of the page")),
    ("source_title rlike 'music genres|folk music traditions'", ("accepted", "regional list")),
]
#: Relations of members that only mention a region.
MENTIONS = ("regional_style_mention", "influence_or_context")


def ruled(rows: DataFrame, rules: list, default: tuple[str, str] = ("needs_review", "no rule")) -> DataFrame:
    """rows with status and reason by the first rule that holds."""
    r = F.coalesce(rule_ladder(rules, ("status", "reason")), F.struct(F.lit(default[0]).alias("status"), F.lit(default[1]).alias("reason")))
    return rows.withColumn("_r", r).select(*rows.columns, "_r.status", "_r.reason")


def classify_ownership(rows: DataFrame, majority: DataFrame, variants: DataFrame) -> DataFrame:
    """Ownership of (id, region) rows: artifact, title, mention majority, then a style mention.

    A style mention owns an existing variant of the node in the region (variants: id, region, variant), else a staged one.
    """
    j = rows.join(majority.select("id", "region", "majority"), ["id", "region"], "left").join(variants, ["id", "region"], "left")
    artifact = (F.col("source_type") == "category") & F.lower("section").rlike("by country")
    status = F.when(artifact, "rejected").when(F.contains(F.lower("title"), F.lower("region")), "owned").when(F.col("majority"), "owned").when(F.col("variant").isNotNull(), "variant").when(F.col("source_type") == "prose", "staged").otherwise("needs_review")
    return j.select("id", "region", status.alias("status"), F.when(status == "variant", F.col("variant")).alias("target"))


def resolve_variants(staged: DataFrame, nodes: DataFrame) -> DataFrame:
    """Staged variants (candidate, base, name) that equal an existing node: resolved; that end with the base's name: rejected."""
    from edgeloom.functions.text import lookup_key

    ids = nodes.groupBy(lookup_key("title").alias("_k")).agg(F.min("id").alias("node"))
    base = nodes.select(F.col("id").alias("base"), lookup_key("title").alias("_b"))
    j = staged.withColumn("_k", lookup_key("name")).join(ids, "_k", "left").join(base, "base", "left")
    status = F.when(F.col("node").isNotNull() & (F.col("node") != F.col("base")), "resolved").when(F.endswith("_k", F.col("_b")), "rejected").otherwise("staged")
    return j.select("candidate", "base", status.alias("status"), F.when(status == "resolved", F.col("node")).alias("node"))


# Score and confidence of a kind of evidence that a node belongs to a country.
EVIDENCE = {
    "accepted_region_relationship": (0.94, 0.72), "country_music_page_child": (0.9, 0.82), "title_region_hint": (0.78, 0.74),
    "origin_region_hint": (0.72, 0.7), "category_region_hint": (0.66, 0.62), "wikipedia_content_mention": (0.54, 0.5),
}
ORIGIN_MENTION = (0.62, 0.58)
ORIGIN_WORDS = r"\b(?:originated|emerged|developed|formed|scene|from|based in|popular in)\b"


def _names_in(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, country, n): how many aliases of a country (country, alias; lower-cased words) the words of texts (id, text) hold.

    Candidates share the alias's first word with the text, so no text meets all aliases.
    """
    from edgeloom.functions.text import lookup_key

    t = texts.select("id", lookup_key("text").alias("t")).where("t <> ''")
    a = aliases.select("country", lookup_key("alias").alias("a")).where("a <> ''").distinct().withColumn("w", F.element_at(F.split("a", " "), 1))
    words = t.select("id", F.explode(F.array_distinct(F.split("t", " "))).alias("w"))
    some = words.join(a, "w").select("id", "country", "a").join(t, "id")
    inside = F.contains(F.concat(F.lit(" "), "t", F.lit(" ")), F.concat(F.lit(" "), "a", F.lit(" ")))
    return some.where(inside).groupBy("id", "country").agg(F.countDistinct("a").alias("n"))


def country_evidence(aliases: DataFrame, accepted: DataFrame, children: DataFrame, titles: DataFrame, categories: DataFrame, origins: DataFrame, contents: DataFrame) -> DataFrame:
    """Evidence (id, country, source, score, confidence, evidence) of six kinds that nodes belong to countries.

    aliases: (country, alias); accepted: (id, country, confidence, evidence) from member edges; children: (id, country, evidence) of
    countries' own pages; titles, categories, origins, contents: (id, text), several rows of an id counting as one text.
    A content counts with two names or more, and more so if it speaks of an origin.
    """
    from edgeloom.functions.text import lookup_key

    def given(source: str, rows: DataFrame, confidence=None) -> DataFrame:
        score, sure = EVIDENCE[source]
        return rows.select("id", "country", F.lit(source).alias("source"), F.lit(score).alias("score"), (F.lit(sure) if confidence is None else confidence).alias("confidence"), "evidence")

    def hinted(source: str, texts: DataFrame, what: str) -> DataFrame:
        joined = texts.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("text")), " ").alias("text"))
        return given(source, _names_in(joined, aliases).withColumn("evidence", F.concat(F.lit(f"{what} names "), F.col("country").cast("string"))))

    sure = F.greatest(F.lit(0.72), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.72))))
    out = given("accepted_region_relationship", accepted, sure).union(given("country_music_page_child", children))
    out = out.union(hinted("title_region_hint", titles, "title")).union(hinted("category_region_hint", categories, "category")).union(hinted("origin_region_hint", origins, "origin"))
    mention = _names_in(contents, aliases).where("n >= 2").join(contents.select("id", F.rlike(lookup_key("text"), F.lit(ORIGIN_WORDS)).alias("_o")), "id")
    pick = lambda k: F.when(F.col("_o"), ORIGIN_MENTION[k]).otherwise(EVIDENCE["wikipedia_content_mention"][k])
    text = F.concat(F.lit("content names "), F.col("country").cast("string"))
    return out.union(mention.select("id", "country", F.lit("wikipedia_content_mention"), pick(0), pick(1), text))


def affinities(evidence: DataFrame, accept: float = 0.55, sure: float = 0.5) -> DataFrame:
    """(id, country, score, ...): merged evidence above both thresholds; two kinds or more add .08 to the score, .06 to the confidence."""
    merged = merge_evidence(evidence, ["id", "country"])
    raw = evidence.groupBy("id", "country").agg(F.max("confidence").alias("_c"), F.min(F.col("source") == "wikipedia_content_mention").alias("_only"))
    bonus = F.when(F.col("n_sources") >= 2, 0.06).otherwise(0.0)
    merged = merged.join(raw, ["id", "country"]).withColumns({"confidence": F.least(F.lit(1.0), F.col("_c") + bonus), "needs_review": F.col("_only")}).drop("_c", "_only")
    return merged.where((F.col("score") >= accept) & (F.col("confidence") >= sure))


def variant_changes(classified: DataFrame, mentions: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a classification of (id, region, status, target) changes: (members, staged).

    A row whose status is ``variant`` makes the existing variant a member of the region: members (region, node, confidence) are
    upserted, the best confidence wins. A ``staged`` row becomes a candidate (candidate key, base, region, name) unless stored.
    mentions: (id, region, confidence, name), name being the candidate's title.
    """
    j = classified.join(mentions, ["id", "region"])
    new = j.where("status = 'variant'").select("region", F.col("target").alias("node"), "confidence")
    members = stored.select("region", "node", "confidence").union(new).groupBy("region", "node").agg(F.max("confidence").alias("confidence"))
    key = F.concat_ws(":", F.lit("variant"), F.col("id").cast("string"), F.col("region").cast("string"))
    return members, j.where("status = 'staged'").select(key.alias("candidate"), F.col("id").alias("base"), "region", "name").distinct()


def approve(nodes: DataFrame, signals: dict[str, DataFrame], forced: DataFrame) -> DataFrame:
    """Rows whose approval changes: (id, approved, note). Approved: any signal and not forced out; a manual note stays."""
    out = nodes
    for name, ids in signals.items():
        out = out.join(ids.select("id").distinct().withColumn(f"_{name}", F.lit(True)), "id", "left")
    out = out.join(forced.select("id").distinct().withColumn("_forced", F.lit(True)), "id", "left")
    first = F.coalesce(*[F.when(F.col(f"_{n}"), n) for n in signals])
    approved = first.isNotNull() & F.col("_forced").isNull()
    note = F.when(F.startswith("note", F.lit("manual")), F.col("note")).otherwise(F.when(F.col("_forced"), "forced").otherwise(first))
    out = out.withColumns({"_approved": approved, "_note": note})
    return out.where(~(F.col("_approved").eqNullSafe(F.col("approved")) & F.col("_note").eqNullSafe(F.col("note")))).select("id", F.col("_approved").alias("approved"), F.col("_note").alias("note"))


def audit(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """(metric, value): the number of rows of each part, one pass a part, no row of any part on the driver."""
    out = None
    for name, df in parts:
        own = df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
        out = own if out is None else out.union(own)
    return out


def coverage(regions: DataFrame, direct: DataFrame, page: DataFrame) -> DataFrame:
    """(covered, n): regions by whether they have direct or page edges."""
    j = regions.join(direct.select("id").distinct().withColumn("_d", F.lit(True)), "id", "left").join(page.select("id").distinct().withColumn("_p", F.lit(True)), "id", "left")
    kind = F.when(F.col("_d") & F.col("_p"), "both").when(F.col("_d"), "direct").when(F.col("_p"), "page").otherwise("none")
    return j.groupBy(kind.alias("covered")).agg(F.count("*").alias("n"))


def promotion_audit(regions: DataFrame, edges: DataFrame, members: DataFrame, longest: int = 6, most: int = 25) -> tuple[DataFrame, DataFrame]:
    """Whether staged regions may be promoted: (metric, value, ready), and (kind, what) samples.

    regions: (id, name); edges: (child, parent, relation, status); members: (region, node, title, relation, status, confidence).
    Cycles are those of accepted containment of up to ``longest`` edges, each once. Mentions are no members. Samples are the first
    cycles by length, else the most confident members.
    """
    from edgeloom.operators.graph import named_cycles

    own = members.where(~F.col("relation").isin(*MENTIONS))
    kept, inside = edges.where("status = 'accepted'"), own.where("status = 'accepted'")
    names = lambda c: regions.select(F.col("id").alias(c), F.lower("name").alias(f"_{c}"))
    artifact = F.lower("title").like("list of %") | F.lower("title").like("category:%")
    cycles = named_cycles(kept.where("relation in ('part_of', 'admin_parent')").select(F.col("child").alias("from_id"), F.col("parent").alias("to_id")), longest)
    boxes = kept.join(names("child"), "child").join(names("parent"), "parent").where("_child rlike ' by |styles of music|music genres' or _parent rlike ' by |styles of music|music genres'")
    counts = edges.agg(*[F.count_if(c).alias(f"region_{n}") for n, c in _states().items()])
    counts = counts.crossJoin(F.broadcast(own.agg(*[F.count_if(c).alias(f"member_{n}") for n, c in _states().items()], F.count_if(artifact & (F.col("status") == "accepted")).alias("artifact_members"))))
    counts = counts.select(F.explode(F.create_map(*[x for c in counts.columns for x in (F.lit(c), F.col(c))])).alias("metric", "value"))
    broad = inside.join(names("region"), "region").where(F.col("_region").isin(*BROAD))
    out = counts.union(audit([("cycles", cycles), ("container_edges", boxes), ("broad_members", broad), ("duplicate_members", inside.groupBy("region", "node", "relation").count().where("count > 1"))]))
    blocking = F.col("metric").isin("region_pending", "member_pending", "cycles", "container_edges", "artifact_members")
    ready = out.agg((F.sum(F.when(blocking, F.col("value")).otherwise(0)) == 0).alias("ready"))
    first = cycles.orderBy("length", "cycle").limit(most).select(F.lit("cycle").alias("kind"), F.col("cycle").alias("what"))
    best = inside.join(regions.select(F.col("id").alias("region"), "name"), "region").orderBy(F.desc("confidence"), "name", "title", "relation").limit(most)
    best = best.select(F.lit("accepted").alias("kind"), F.concat_ws(" > ", "name", "relation", "title").alias("what"))
    none = first.agg((F.count("*") == 0).alias("_none"))
    return out.join(F.broadcast(ready), F.lit(True)), first.union(best.join(F.broadcast(none), F.lit(True)).where("_none").drop("_none"))


def _states() -> dict[str, Column]:
    return {"accepted": F.col("status") == "accepted", "rejected": F.col("status") == "rejected", "pending": ~F.col("status").isin("accepted", "rejected")}


#: Regions that need no parent.
TOPS = ("music", "africa", "americas", "asia", "europe", "north america", "south america", "oceania", "world")


def readiness_audit(regions: DataFrame, edges: DataFrame, members: DataFrame, candidates: DataFrame, sources: DataFrame, kept: DataFrame) -> DataFrame:
    """(metric, value, ready): whether the graph of regions can be shown.

    regions: (id, name, title, kind, promoted, state); edges: (child, parent, status); members: (region, node, relation, status);
    candidates: (status); sources: any rows; kept: (region, review), high-confidence decisions to leave a finding as it is, reviews being
    ``zero_child``, ``parentless`` and ``broad``. Blocking are open members and candidates, promoted cities without members, regions
    without a parent, invalid titles, duplicates and members of broad regions.
    """
    own = members.where(~F.col("relation").isin(*MENTIONS))
    inside, promoted = own.where("status = 'accepted'"), regions.where("promoted")
    left = lambda df, review, key="id": df.join(kept.where(F.col("review") == review).select(F.col("region").alias(key)), key, "left_anti")
    owners = inside.select(F.col("region").alias("id"))
    empty = left(promoted.where("kind = 'city' and coalesce(state, '') <> 'reviewed_empty'").join(owners, "id", "left_anti"), "zero_child")
    gone = "coalesce(state, '') not in ('approved_root', 'approved_superregion', 'collapsed', 'rejected', 'demoted_source')"
    parents = edges.where("status = 'accepted'").select(F.col("child").alias("id"))
    alone = left(promoted.where(gone).where(~F.lower("name").isin(*TOPS)).join(parents, "id", "left_anti"), "parentless")
    title = F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"\s+", " "))
    valid = ~F.lower(title).like("list of %") & (title.rlike(r"^Music of [^\s|<>][^|<>]*$") | title.rlike(r"^[^\s|<>][^|<>]* music$"))
    invalid = promoted.where("coalesce(state, '') not in ('collapsed', 'rejected', 'demoted_source')").where(~valid)
    broad = left(inside.join(regions.where(F.lower("name").isin(*BROAD)).select(F.col("id").alias("region")), "region", "left_semi"), "broad", "region")
    proxies = regions.where(F.col("name").rlike("^[a-z]") & (F.col("name") == F.lower("name")) & F.lower("title").rlike("folk music|styles of music"))
    blocking = {
        "open_members": own.where("status = 'needs_review'"), "open_candidates": candidates.where("status in ('discovered', 'queued_for_crawl', 'needs_gpt_review')"),
        "childless_cities": empty, "parentless": alone, "invalid_titles": invalid, "duplicates": inside.groupBy("region", "node", "relation").count().where("count > 1"),
        "broad_members": broad,
    }
    told = {"regions": regions, "promoted": promoted, "edges": edges, "members": members, "candidates": candidates, "sources": sources, "accepted_edges": edges.where("status = 'accepted'"), "accepted_members": inside, "style_proxies": proxies}
    stops = audit(list(blocking.items()))
    ready = stops.agg((F.sum("value") == 0).alias("ready"))
    return stops.union(audit(list(told.items()))).join(F.broadcast(ready), F.lit(True))


def coverage_counts(promoted: DataFrame, members: DataFrame, inferred: DataFrame, most: int = 25) -> tuple[DataFrame, DataFrame]:
    """(metric, value) of how promoted regions (region, name, views) are covered by members (region, source_type, status) and by inferred
    ones (kind); and the most viewed regions (region, name) without any accepted member."""
    good = members.where("status = 'accepted'")
    direct = promoted.join(good.select("region"), "region", "left_semi")
    article = promoted.join(good.where("source_type = 'wikipedia_article'").select("region"), "region", "left_semi")
    without = promoted.join(good.select("region"), "region", "left_anti")
    parts = [("promoted", promoted), ("with_direct", direct), ("without_direct", without), ("with_article", article), ("accepted", good), ("article", good.where("source_type = 'wikipedia_article'"))]
    parts += [("pending", members.where("status in ('proposed', 'needs_review')")), ("rejected", members.where("status = 'rejected'"))]
    kinds = inferred.groupBy(F.concat(F.lit("inferred:"), "kind").alias("metric")).agg(F.count("*").alias("value"))
    return audit(parts).union(kinds), without.orderBy(F.desc(F.coalesce("views", F.lit(0))), "name", "region").limit(most).select("region", "name")


def apply_member_decisions(decisions: DataFrame, regions: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decisions about one member each (region, node, decision, target_names) applied to members (region, node, status): (members,
    decisions with their outcome).

    extract: the member is accepted, and made if it is missing; demote: it becomes a candidate; move: the node becomes an accepted
    member of every target that has a name among the regions (id, name), and then a candidate here; without any such target
    nothing moves and a human is asked.
    """
    names = regions.groupBy(F.lower("name").alias("_k")).agg(F.min("id").alias("target"))
    moves = decisions.where("decision = 'move'").select("region", "node", F.explode("target_names").alias("_t")).join(names, F.lower("_t") == F.col("_k")).select("region", "node", "target").distinct()
    done = moves.select("region", "node").distinct().withColumn("_moved", F.lit(True))
    d = decisions.select("region", "node", "decision").distinct().join(done, ["region", "node"], "left")
    outcome = F.when((F.col("decision") == "move") & F.col("_moved").isNull(), "needs_human").otherwise("done")
    d = d.withColumn("outcome", outcome)
    to = F.when(F.col("decision") == "extract", "accepted").when(F.col("outcome") == "done", "candidate")
    changed = d.select("region", "node", to.alias("_to")).where("_to is not null")
    kept = members.join(changed, ["region", "node"], "left").select("region", "node", F.coalesce("_to", "status").alias("status"))
    made = d.where("decision = 'extract'").select("region", "node", F.lit("accepted").alias("status")).join(members.select("region", "node"), ["region", "node"], "left_anti")
    moved = moves.select(F.col("target").alias("region"), "node", F.lit("accepted").alias("status"))
    # a member that is accepted by one of these is accepted
    rank = F.min(F.struct(F.when(F.col("status") == "accepted", 0).otherwise(1).alias("k"), "status"))
    return kept.union(made).union(moved).groupBy("region", "node").agg(rank.alias("s")).select("region", "node", "s.status"), d.drop("_moved")


def apply_decisions(decisions: DataFrame, regions: DataFrame, edges: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decisions (id, decision, target_name, new_name) applied as one set operation a kind: (regions, edges, members).

    anchor: an edge to the target; move: members go to the target; demote: members become candidates; rename: unless another
    region has the name; collapse: members and children go to the target, the region is marked. A target that no region has sends
    anchors and moves to needs_human; a collapse without one only marks.
    """
    names = regions.groupBy(F.lower("name").alias("_k")).agg(F.min("id").alias("target"))
    d = decisions.join(names, F.lower("target_name") == F.col("_k"), "left").drop("_k")
    taken = regions.select(F.lower("name").alias("_n"), F.col("id").alias("_other"))
    clash = d.where("decision = 'rename'").join(taken, (F.lower("new_name") == F.col("_n")) & (F.col("id") != F.col("_other"))).select("id").distinct().withColumn("_clash", F.lit(True))
    d = d.join(clash, "id", "left")
    lost = F.col("decision").isin("anchor", "move") & F.col("target").isNull()
    status = F.when(lost | F.col("_clash"), "needs_human").when(F.col("decision") == "collapse", "collapsed").when(F.col("decision") == "keep", "kept").otherwise("done")
    d = d.withColumn("_status", status)
    r = regions.join(d.select("id", "decision", "new_name", "_status"), "id", "left")
    r = r.select("id", F.when((F.col("decision") == "rename") & (F.col("_status") == "done"), F.col("new_name")).otherwise(F.col("name")).alias("name"), F.coalesce("_status", "status").alias("status"))
    moved = d.where("decision in ('move', 'collapse') and target is not null").select(F.col("id").alias("_old"), "target", "decision")
    e = edges.join(moved.where("decision = 'collapse'").drop("decision"), F.col("parent") == F.col("_old"), "left").select("child", F.coalesce("target", "parent").alias("parent"))
    anchors = d.where("decision = 'anchor' and target is not null and target <> id").select(F.col("id").alias("child"), F.col("target").alias("parent"))
    e = e.union(anchors).where("child <> parent").distinct()
    m = members.join(moved.drop("decision"), F.col("region") == F.col("_old"), "left").join(d.where("decision = 'demote'").select(F.col("id").alias("region"), F.lit(True).alias("_low")), "region", "left")
    m = m.select(F.coalesce("target", "region").alias("region"), "node", F.when(F.col("_low"), "candidate").otherwise(F.col("status")).alias("status")).distinct()
    return r, e, m


def cleanup(regions: DataFrame, members: DataFrame, overrides: DataFrame, hidden: tuple[str, ...] = ("rejected", "collapsed"), listed: DataFrame | None = None, cities: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """After a review: regions (id, title, status, kind) with overrides (id, status, kind), 'Music in' titles as 'Music of' and
    visible; and members (region, node, confidence) with status and reason.

    Members of hidden regions are rejected, listed ones (region, node, accepted) become what the list says, and of several visible
    regions that own a node the most confident stays. A region is hidden by its status or by ``cities`` (id).
    """
    o = overrides.select("id", F.col("status").alias("_s"), F.col("kind").alias("_k"))
    r = regions.join(o, "id", "left").select("id", F.regexp_replace("title", r"^Music in ", "Music of ").alias("title"), F.coalesce("_s", "status").alias("status"), F.coalesce("_k", "kind").alias("kind"))
    if cities is not None:
        r = r.join(cities.select("id").distinct().withColumn("_city", F.lit(True)), "id", "left").withColumn("visible", ~F.col("status").isin(*hidden) & F.col("_city").isNull()).drop("_city")
    else:
        r = r.withColumn("visible", ~F.col("status").isin(*hidden))
    gone = r.where(F.col("status").isin(*hidden)).select(F.col("id").alias("region"), F.lit(True).alias("_gone"))
    m = members.join(gone, "region", "left")
    m = m.withColumn("_listed", F.lit(None).cast("boolean")) if listed is None else m.join(listed.select("region", "node", F.col("accepted").alias("_listed")), ["region", "node"], "left")
    out = F.coalesce("_gone", F.lit(False)) | F.coalesce(~F.col("_listed"), F.lit(False))
    m = m.withColumn("_out", out)
    n = F.row_number().over(Window.partitionBy("node", "_out").orderBy(F.desc(F.coalesce("_listed", F.lit(False))), F.desc("confidence"), "region"))
    m = m.withColumn("_n", n)
    reason = F.when(F.col("_gone"), "hidden region").when(~F.col("_listed"), "listed").when(F.col("_n") > 1, "better owner")
    return r, m.select("region", "node", F.when(reason.isNull(), "accepted").otherwise("rejected").alias("status"), reason.alias("reason"))


def fix_parents(edges: DataFrame, wrong: DataFrame, required: DataFrame) -> DataFrame:
    """Edges (child, parent, relation, status) with wrong ones (child, parent) rejected and required ones (child, parent, relation)
    accepted, and put in where they are missing."""
    bad = wrong.select("child", "parent").distinct().withColumn("_bad", F.lit(True))
    need = required.select("child", "parent", F.col("relation").alias("_need")).distinct()
    j = edges.join(need, ["child", "parent"], "full").join(bad, ["child", "parent"], "left")
    status = F.when(F.col("_need").isNotNull(), "accepted").when(F.col("_bad"), "rejected").otherwise(F.col("status"))
    return j.select("child", "parent", F.coalesce("relation", "_need").alias("relation"), status.alias("status"))


def review_queue(rows: DataFrame, decided: DataFrame, needs: Column, order: list, most: int) -> DataFrame:
    """Rows that need review and have no decision yet, the first in order."""
    return rows.where(needs).join(decided.select("id").distinct(), "id", "left_anti").orderBy(*order).limit(most)


def orphan_lineage(orphans: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, parents_of, infobox, other): unreachable nodes that are origin parents, with counts of their evidence."""
    own = edges.join(orphans.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    return own.groupBy(F.col("from_id").alias("id")).agg(F.countDistinct("to_id").alias("parents_of"), F.count_if(F.col("source") == "infobox").alias("infobox"), F.count_if(F.col("source") != "infobox").alias("other"))


def inventory(nodes: DataFrame, edges: DataFrame, visible: Column) -> DataFrame:
    """(parent, children, shown, hidden): children of each parent by visibility."""
    j = edges.select("from_id", "to_id").distinct().join(nodes.select(F.col("id").alias("to_id"), visible.alias("_v")), "to_id")
    return j.groupBy(F.col("from_id").alias("parent")).agg(F.count("*").alias("children"), F.count_if("_v").alias("shown"), F.count_if(~F.col("_v")).alias("hidden"))

"""Facts out of marked-up text: fields, links, lists, years, claims, categories. A page is (page, title, text)."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.functions.text import collapsed, link_title, skipped_link

LINK = r"\[\[([^\]|#]+)(?:[^\]|]*)(?:\|[^\]]*)?\]\]"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fields(pages: DataFrame) -> DataFrame:
    """(page, field, value) of the info block's lines ``| field = value``."""
    block = F.regexp_extract("text", r"(?s)\{\{Infobox[^\n]*\n(.*?)\n\}\}", 1)
    lines = pages.select("page", F.explode(F.split(block, "\n")).alias("line"))
    out = lines.select("page", F.regexp_extract("line", r"^\|\s*([a-z_0-9]+)\s*=\s*(.*)$", 1).alias("field"), F.regexp_extract("line", r"^\|\s*([a-z_0-9]+)\s*=\s*(.*)$", 2).alias("value"))
    return out.where("field <> '' and value <> ''")


def list_items(value: str | Column) -> Column:
    """Items of a list field: its links if there are any, else the text between , ; / and bullets. One-letter items drop."""
    links = F.regexp_extract_all(_c(value), F.lit(LINK), 1)
    free = F.transform(F.split(_c(value), r"[,;•/\n]"), lambda x: collapsed(x))
    return F.filter(F.when(F.size(links) > 0, F.transform(links, lambda x: link_title(x))).otherwise(free), lambda x: F.length(x) > 1)


def field_edges(pages: DataFrame, relations: DataFrame) -> DataFrame:
    """(page, relation, ordinal, target): items of the fields that relations (field, relation) names; a target once per relation."""
    each = fields(pages).join(F.broadcast(relations), "field").select("page", "relation", F.posexplode(list_items("value")).alias("pos", "target"))
    first = F.row_number().over(Window.partitionBy("page", "relation", F.lower("target")).orderBy("pos"))
    kept = each.withColumn("_n", first).where("_n = 1")
    return kept.select("page", "relation", (F.row_number().over(Window.partitionBy("page", "relation").orderBy("pos")) - 1).alias("ordinal"), "target")


def colour(c: str | Column) -> Column:
    return F.upper(F.nullif(F.regexp_extract(_c(c), r"#?\b([0-9a-fA-F]{6})\b", 1), F.lit("")))


def origin(c: str | Column, hints: tuple[str, ...]) -> Column:
    """Struct of kind (temporal, cultural), year_start, year_end, hint: the first of the known names in it."""
    text = _c(c)
    year = F.nullif(F.regexp_extract(text, r"\b(1[5-9]\d\d|20\d\d)", 1), F.lit("")).cast("int")
    end = F.nullif(F.regexp_extract(text, r"\b(?:1[5-9]\d\d|20\d\d)s?\s*[-–]\s*(1[5-9]\d\d|20\d\d)", 1), F.lit("")).cast("int")
    hint = F.nullif(F.regexp_extract(text, r"(?i)\b(" + "|".join(hints) + r")\b", 1), F.lit(""))
    return F.struct(F.when(year.isNotNull(), "temporal").otherwise("cultural").alias("kind"), year.alias("year_start"), F.coalesce(end, year).alias("year_end"), hint.alias("hint"))


CLAIMS = "struct<claims:map<string,array<struct<rank:string,mainsnak:struct<snaktype:string,datavalue:struct<value:struct<id:string>,type:string>>>>>,aliases:map<string,array<struct<value:string>>>>"


def claim_edges(entities: DataFrame, properties: DataFrame) -> DataFrame:
    """(id, relation, ordinal, target) of entity JSON (id, json): claims of known properties, not deprecated, with an entity value."""
    each = entities.select("id", F.explode(F.from_json("json", CLAIMS)["claims"]).alias("property", "all"))
    each = each.join(F.broadcast(properties), "property").select("id", "relation", F.posexplode("all").alias("ordinal", "c"))
    ok = (F.col("c.rank") != "deprecated") & (F.col("c.mainsnak.snaktype") == "value") & (F.col("c.mainsnak.datavalue.type") == "wikibase-entityid")
    return each.where(ok).select("id", "relation", "ordinal", F.col("c.mainsnak.datavalue.value.id").alias("target"))


def entity_aliases(entities: DataFrame, language: str = "en") -> DataFrame:
    return entities.select("id", F.posexplode(F.from_json("json", CLAIMS)["aliases"][language]).alias("pos", "a")).select("id", "pos", F.col("a.value").alias("alias"))


def plain_text(c: str | Column, length: int | None = None) -> Column:
    """Text without references, templates, tags and link marks, blanks collapsed; whole, or cut to a length (32,000 is usual) if asked."""
    out = F.regexp_replace(_c(c), r"(?s)<ref[^>]*>.*?</ref>", " ")
    for _ in range(2):
        out = F.regexp_replace(out, r"(?s)\{\{[^{}]*\}\}", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    out = F.regexp_replace(out, r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1")
    out = collapsed(F.regexp_replace(out, r"'{2,}", ""))
    return out if length is None else F.left(out, F.lit(length))


# Confidence of a link by the kind of its line.
CONFIDENCE = {"table": 0.82, "definition": 0.8, "list": 0.76, "prose": 0.62}
SKIPPED = ("references", "see also", "external links", "notes", "bibliography")


def lines(pages: DataFrame) -> DataFrame:
    """(page, pos, section, kind, line): each line with the heading above it; headings themselves are left out."""
    each = pages.select("page", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    head = F.nullif(F.regexp_extract("line", r"^==+\s*(.*?)\s*==+\s*$", 1), F.lit(""))
    above = F.last(F.col("head"), True).over(Window.partitionBy("page").orderBy("pos"))
    each = each.withColumn("head", head).withColumn("section", F.coalesce(above, F.lit("")))
    start = F.substring("line", 1, 1)
    kind = F.when(start.isin("|", "!"), "table").when(start.isin(";", ":"), "definition").when(start.isin("*", "#"), "list").otherwise("prose")
    return each.where("head is null").select("page", "pos", "section", kind.alias("kind"), "line")


def section_links(pages: DataFrame, dictionary: DataFrame, skipped=SKIPPED) -> DataFrame:
    """(page, target_id, kind, section, confidence): links that name a node of dictionary (key: lower-cased title, id), once a page.

    The most confident mention wins, then the first.
    """
    each = lines(pages).where(~F.lower("section").isin(*skipped)).select("page", "pos", "section", "kind", F.posexplode(F.regexp_extract_all("line", F.lit(LINK), 1)).alias("at", "link"))
    each = each.where(~skipped_link("link")).withColumn("key", F.lower(link_title("link"))).join(dictionary.select("key", F.col("id").alias("target_id")), "key")
    score = F.create_map(*[x for k, v in CONFIDENCE.items() for x in (F.lit(k), F.lit(v))])[F.col("kind")]
    each = each.withColumn("confidence", score)
    n = F.row_number().over(Window.partitionBy("page", "target_id").orderBy(F.desc("confidence"), "pos", "at"))
    return each.withColumn("_n", n).where("_n = 1").select("page", "target_id", "kind", "section", "confidence")


def nested_context(pages: DataFrame) -> DataFrame:
    """(page, pos, depth, link, context): first link of each bullet with that of the nearest shallower bullet above, else the section.

    One running window per depth would read the lines again for each; here the lines of a page are walked once, in order.
    """
    each = lines(pages).where("kind = 'list'").select("page", "pos", "section", F.length(F.regexp_extract("line", r"^([*#]+)", 1)).alias("depth"), F.regexp_extract("line", LINK, 1).alias("link"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, section, open_ = None, None, []
        for b in batches:
            context = []
            for p, s, d, link in zip(b["page"], b["section"], b["depth"], b["link"]):
                if p != page or s != section:
                    page, section, open_ = p, s, []
                while open_ and open_[-1][0] >= d:
                    open_.pop()
                context.append(open_[-1][1] if open_ else s)
                open_.append((d, link or context[-1]))
            yield b[["page", "pos", "depth", "link"]].assign(context=context)

    kind = dict(each.dtypes)["page"]
    return each.repartition("page").sortWithinPartitions("page", "pos").mapInPandas(walk, f"page {kind}, pos int, depth int, link string, context string")


def template_links(pages: DataFrame, cues: tuple[str, ...] = ("genre", "style")) -> DataFrame:
    """(page, owner, link) of navigation templates whose title holds a cue word; owner: the title without the cue."""
    block = F.explode(F.regexp_extract_all("text", F.lit(r"(?s)(\{\{(?:Navbox|Sidebar)\b.*?\n\}\})"), 1))
    own = pages.select("page", block.alias("block")).withColumn("head", F.regexp_extract("block", r"\|\s*title\s*=\s*([^\n]*)", 1))
    own = own.where(F.lower("head").rlike("|".join(cues)))
    owner = F.trim(F.regexp_replace(F.lower("head"), r"\b(?:" + "|".join(f"{c}s?" for c in cues) + r")\b", ""))
    return own.select("page", owner.alias("owner"), F.explode(F.regexp_extract_all("block", F.lit(LINK), 1)).alias("link")).distinct()


def page_job(picked: DataFrame, pages: DataFrame, dictionary: DataFrame, stored: DataFrame, nested: float = 0.7, template: float = 0.66) -> tuple[DataFrame, DataFrame]:
    """What the pages of owners (owner, page) say: (evidence, edges).

    Evidence (owner, target_id, how, where, confidence, page) comes from links in sections, from the first links of nested bullets, where
    the bullet above is the place, and from navigation templates; links resolve by dictionary (key, id). Edges (owner, target_id, confidence)
    are the stored ones with the best evidence put in: an owner and a target meet once.
    """
    own = pages.join(picked.select("page").distinct(), "page", "left_semi")
    known = dictionary.select("key", F.col("id").alias("target_id"))
    named = lambda df: df.where((F.col("link") != "") & ~skipped_link("link")).withColumn("key", F.lower(link_title("link"))).join(known, "key")
    found = section_links(own, dictionary).select("page", "target_id", F.lit("section").alias("how"), F.col("section").alias("where"), "confidence")
    found = found.union(named(nested_context(own)).select("page", "target_id", F.lit("nested"), "context", F.lit(nested)))
    found = found.union(named(template_links(own)).select("page", "target_id", F.lit("template"), "owner", F.lit(template))).distinct()
    evidence = picked.join(found, "page").select("owner", "target_id", "how", "where", "confidence", "page")
    best = stored.select("owner", "target_id", "confidence").union(evidence.select("owner", "target_id", "confidence"))
    return evidence, best.groupBy("owner", "target_id").agg(F.max("confidence").alias("confidence"))


def page_list(*sources: DataFrame) -> DataFrame:
    """(owner, title, priority) of several page lists in order of priority, each (owner, lower title) once."""
    all_ = None
    for k, s in enumerate(sources):
        own = s.select("owner", "title", F.lit(k).alias("priority"))
        all_ = own if all_ is None else all_.unionByName(own)
    n = F.row_number().over(Window.partitionBy("owner", F.lower("title")).orderBy("priority", "title"))
    return all_.withColumn("_n", n).where("_n = 1").drop("_n")


def rule_ladder(rules: list[tuple[str, tuple]], names: tuple[str, ...]) -> Column:
    """The first rule (SQL predicate, values) that holds, as a struct of names; null if none does."""
    out = None
    for predicate, values in rules:
        made = F.struct(*[F.lit(v).alias(n) for n, v in zip(names, values)])
        out = F.when(F.expr(predicate), made) if out is None else out.when(F.expr(predicate), made)
    return out


TITLE_RULES = [
    ("lower(title) rlike '^(?:file|template|help|portal|wikipedia):'", ("ignored", "rejected", 1.0)),
    ("lower(title) rlike '^category:music of '", ("category", "accepted", 0.9)),
    ("lower(title) rlike '^category:'", ("category", "needs_review", 0.5)),
    ("lower(title) rlike '^music (?:of|in) '", ("container", "accepted", 0.92)),
    ("lower(title) rlike '^list of .*(?:genres|styles)'", ("list", "accepted", 0.85)),
    ("lower(title) rlike '^list of '", ("list", "rejected", 0.6)),
    ("lower(title) rlike '(?:ring|bolt)'", ("node", "needs_review", 0.55)),
]


def classify_titles(titles: DataFrame, rules=TITLE_RULES) -> DataFrame:
    """titles with type, status and confidence by the first rule that holds; else (node, candidate, .4)."""
    made = F.coalesce(rule_ladder(rules, ("type", "status", "confidence")), F.struct(F.lit("node").alias("type"), F.lit("candidate").alias("status"), F.lit(0.4).alias("confidence")))
    return titles.withColumn("_r", made).select(*titles.columns, "_r.*")


def container_name(c: str | Column) -> Column:
    """The container that a title speaks of: 'Music of (the) X', 'Music in X', 'List of X styles/genres', 'X (country)'; else null."""
    t = _c(c)
    cascade = [r"(?i)^(?:category:)?music (?:of|in) (?:the )?(.+)$", r"(?i)^list of (.+?) (?:music )?(?:styles|genres)$", r"(?i)^(.+?) \((?:country|state|region)\)$"]
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(t, p, 1)), F.lit("")) for p in cascade])


def crawl(members: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(title, is_category, depth): what categories hold, breadth first from seeds (category) through member categories."""
    from edgeloom.operators.staging import cut

    level = seeds.select(F.col("category").alias("title"), F.lit(True).alias("is_category"), F.lit(0).alias("depth")).distinct()
    found = cut(level, "crawl")
    level = found
    for depth in range(1, max_depth + 1):
        new = level.where("is_category").select(F.col("title").alias("category")).join(members, "category").select(F.col("member").alias("title"), "is_category").distinct()
        level = cut(new.join(found.select("title"), "title", "left_anti").withColumn("depth", F.lit(depth)), "crawl")
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found


_SPAN = (
    r"(?i)(?:(early|mid|late)[ -]*(?:to[ -]*late[ -]*)?)?\b(1[5-9]\d0|20\d0)s\s*(?:-|–|to|and)\s*(?:(early|mid|late)[ -]*)?(1[5-9]\d0|20\d0)s"
    r"|(?:(early|mid|late)[ -]*)?\b(1[5-9]\d0|20\d0)s\b"
    r"|\b(1[5-9]\d\d|20\d\d)\s*(?:-|–)\s*(1[5-9]\d\d|20\d\d)\b"
    r"|\b(1[5-9]\d\d|20\d\d)\b"
    r"|\b(?:(early|mid|late)[ -]*)?(1[5-9]|20|21)(?:th|st)[ -]century"
)


def span_years(text: str) -> list[tuple[int, int, int]]:
    """(position, first year, last year) of the years, decades, ranges and centuries of a text, in order; ranges come whole.

    A decade's early part is its years 0-3, its middle 4-6, its late part 7-9; of a century the thirds.
    """
    import re

    begin, end = {"early": 0, "mid": 4, "late": 7}, {"early": 3, "mid": 6, "late": 9}
    out = []
    for m in re.finditer(_SPAN, text or ""):
        g = [x.lower() if x else None for x in m.groups()]
        if g[1]:
            a, b = int(g[1]) + begin.get(g[0], 0), int(g[3]) + end.get(g[2], 9)
        elif g[5]:
            a, b = int(g[5]) + begin.get(g[4], 0), int(g[5]) + end.get(g[4], 9)
        elif g[6]:
            a, b = int(g[6]), int(g[7])
        elif g[8]:
            a = b = int(g[8])
        else:
            base = (int(g[10]) - 1) * 100
            a, b = base + {"early": 0, "mid": 34, "late": 67}.get(g[9], 0), base + {"early": 33, "mid": 66, "late": 99}.get(g[9], 99)
        if a <= b:
            out.append((m.start(), a, b))
    return out


def year_spans(texts: DataFrame) -> DataFrame:
    """(id, part, pos, year_start, year_end) of texts (id, part, text): positions matter, so an Arrow batch function does it."""

    @F.pandas_udf("array<struct<pos:int,year_start:int,year_end:int>>")
    def spans(c: pd.Series) -> pd.Series:
        return pd.Series([[{"pos": p, "year_start": a, "year_end": b} for p, a, b in span_years(t)] for t in c])

    hit = texts.where(F.col("text").rlike(r"\d{2}"))
    return hit.select("id", "part", F.explode(spans("text")).alias("s")).select("id", "part", "s.*")


def link_expansion(sources: DataFrame, pages: DataFrame, known: DataFrame, admit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New titles that approved sources link to and admit (title) lists; and sources without any approved link."""
    links = sources.select("page").join(pages, "page").select("page", F.explode(F.regexp_extract_all("text", F.lit(LINK), 1)).alias("link")).where(~skipped_link("link"))
    links = links.select("page", link_title("link").alias("title")).distinct()
    approved = links.join(admit.select("title").distinct(), "title", "left_semi")
    return approved.select("title").distinct().join(known.select("title"), "title", "left_anti"), sources.join(approved.select("page").distinct(), "page", "left_anti")

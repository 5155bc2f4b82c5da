"""Queries: extraction from marked-up pages (X)."""

from pyspark.sql import functions as F

from edgeloom.functions import text as T
from edgeloom.operators import extract as X
from edgeloom.plans.bindings import sql_with
from edgeloom.plans.registry import query

CAP = "concat(upper(substr({0}, 1, 1)), substr({0}, 2))"
LINKS = r"regexp_extract_all({0}, '\[\[([^\]|#]+)(?:[^\]|]*)(?:\|[^\]]*)?\]\]', 1)"
NORM = "trim(regexp_replace(replace(regexp_replace({0}, '#.*$', ''), '_', ' '), '\\s+', ' ', 'g'))"
FIELDS = r"""blk AS (SELECT page, string_split(regexp_extract(text, '(?s)\{\{Infobox[^\n]*\n(.*?)\n\}\}', 1), chr(10)) AS l FROM wiki),
fld AS (SELECT page, regexp_extract(line, '^\|\s*([a-z_0-9]+)\s*=\s*(.*)$', 1) AS field, regexp_extract(line, '^\|\s*([a-z_0-9]+)\s*=\s*(.*)$', 2) AS value FROM (SELECT page, unnest(l) AS line FROM blk) q)"""
ITEMS = f"""itm AS (SELECT page, field, CASE WHEN len({LINKS.format('value')}) > 0 THEN list_transform({LINKS.format('value')}, lambda x: {CAP.format(NORM.format('x'))}) ELSE list_transform(string_split_regex(value, '[,;•/\\n]'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) END AS l FROM fld WHERE field <> '' AND value <> ''),
its AS (SELECT page, field, list_filter(l, lambda x: len(x) > 1) AS l FROM itm), pos AS (SELECT page, field, unnest(range(1, len(l) + 1)) AS i, l FROM its)"""
RELATIONS = [("stylistic_origins", "origin"), ("derivatives", "derivative"), ("name", "label")]


def relations(t):
    return t.spark.createDataFrame(RELATIONS, "field string, relation string")


@query("x1_field_edges", sql_with("wiki") + f",\n{FIELDS},\n{ITEMS}" + """,
rel AS (SELECT page, CASE field WHEN 'stylistic_origins' THEN 'origin' WHEN 'derivatives' THEN 'derivative' WHEN 'name' THEN 'label' END AS relation, CAST(i AS BIGINT) AS i, l[i] AS target FROM pos WHERE field IN ('stylistic_origins', 'derivatives', 'name')),
one AS (SELECT *, row_number() OVER (PARTITION BY page, relation, lower(target) ORDER BY i) AS rn FROM rel)
SELECT page, relation, CAST(row_number() OVER (PARTITION BY page, relation ORDER BY i) - 1 AS INTEGER) AS ordinal, target FROM one WHERE rn = 1""")  # fmt: skip
def x1(t):
    return X.field_edges(t.wiki, relations(t))


@query("x2_list_items", sql_with("wiki") + f",\n{FIELDS},\n{ITEMS}\nSELECT page, field, array_to_string(l, '|') AS items, CAST(len(l) AS INTEGER) AS n FROM its")
def x2(t):
    f = X.fields(t.wiki).withColumn("l", X.list_items("value"))
    return f.select("page", "field", F.concat_ws("|", "l").alias("items"), F.size("l").alias("n"))


@query("x3_link_titles", sql_with("wiki") + f", lk AS (SELECT page, unnest({LINKS.format('text')}) AS link FROM wiki)\nSELECT {CAP.format(NORM.format('link'))} AS title, starts_with(lower(link), 'file:') OR starts_with(lower(link), 'category:') AS skipped, count(*) AS n FROM lk GROUP BY ALL")
def x3(t):
    lk = t.wiki.select(F.explode(F.regexp_extract_all("text", F.lit(X.LINK), 1)).alias("link"))
    return lk.groupBy(T.link_title("link").alias("title"), T.skipped_link("link").alias("skipped")).agg(F.count("*").alias("n"))


@query("x4_colours", sql_with("wiki") + f",\n{FIELDS}\n" + r"SELECT page, upper(nullif(regexp_extract(value, '#?\b([0-9a-fA-F]{6})\b', 1), '')) AS colour FROM fld WHERE field = 'color'")
def x4(t):
    return X.fields(t.wiki).where("field = 'color'").select("page", X.colour("value").alias("colour"))


@query("x5_origins", sql_with("wiki") + f",\n{FIELDS}, o AS (SELECT page, unnest(string_split(value, ', ')) AS s FROM fld WHERE field = 'stylistic_origins')\n" + r"""
SELECT page, s, CASE WHEN regexp_matches(s, '\b(1[5-9]\d\d|20\d\d)') THEN 'temporal' ELSE 'cultural' END AS kind, TRY_CAST(regexp_extract(s, '\b(1[5-9]\d\d|20\d\d)', 1) AS INTEGER) AS year_start, TRY_CAST(regexp_extract(s, '\b(1[5-9]\d\d|20\d\d)', 1) AS INTEGER) AS year_end, nullif(regexp_extract(s, '(?i)\b(Brand|STANDARD|ECONOMY)\b', 1), '') AS hint FROM o""")  # fmt: skip
def x5(t):
    o = X.fields(t.wiki).where("field = 'stylistic_origins'").select("page", F.explode(F.split("value", ", ")).alias("s"))
    return o.select("page", "s", X.origin("s", ("Brand", "STANDARD", "ECONOMY")).alias("o")).select("page", "s", "o.*")


CLAIM = """concat('{"claims": {"P279": [{"rank": "', CASE WHEN o_orderkey % 5 = 0 THEN 'deprecated' ELSE 'normal' END, '", "mainsnak": {"snaktype": "', CASE WHEN o_orderkey % 7 = 0 THEN 'novalue' ELSE 'value' END, '", "datavalue": {"type": "wikibase-entityid", "value": {"id": "Q', o_custkey, '"}}}}], "P9": [], "P31": [{"rank": "normal", "mainsnak": {"snaktype": "value", "datavalue": {"type": "wikibase-entityid", "value": {"id": "Q', o_orderkey % 10, '"}}}}]}, "aliases": {"en": [{"value": "', o_orderstatus, '"}]}}')"""


@query("x6_claim_edges", """SELECT o_orderkey AS id, 'subclass' AS relation, CAST(0 AS INTEGER) AS ordinal, concat('Q', o_custkey) AS target FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0
UNION ALL SELECT o_orderkey, 'instance', 0, concat('Q', o_orderkey % 10) FROM orders""")  # fmt: skip
def x6(t):
    entities = t.orders.select(F.col("o_orderkey").alias("id"), F.expr(CLAIM).alias("json"))
    return X.claim_edges(entities, t.spark.createDataFrame([("P279", "subclass"), ("P31", "instance")], "property string, relation string"))


@query("x7_plain_text", sql_with("wiki") + r"""
SELECT page, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)<ref[^>]*>.*?</ref>', ' ', 'g'), '(?s)\{\{[^{}]*\}\}', ' ', 'g'), '(?s)\{\{[^{}]*\}\}', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\[\[(?:[^\]|]*\|)?([^\]]*)\]\]', '\1', 'g'), '''{2,}', '', 'g'), '\s+', ' ', 'g')) AS plain FROM wiki""")  # fmt: skip
def x7(t):
    return t.wiki.select("page", X.plain_text("text").alias("plain"))


LINES = r"""ln AS (SELECT page, i - 1 AS pos, l[i] AS line, nullif(regexp_extract(l[i], '^==+\s*(.*?)\s*==+\s*$', 1), '') AS head FROM (SELECT page, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page, string_split(text, chr(10)) AS l FROM wiki) q) r),
lines AS (SELECT page, pos, section, CASE WHEN line[1] IN ('|', '!') THEN 'table' WHEN line[1] IN (';', ':') THEN 'definition' WHEN line[1] IN ('*', '#') THEN 'list' ELSE 'prose' END AS kind, line FROM (SELECT *, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY page ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS section FROM ln) q WHERE head IS NULL)"""
FOUND = f"""dict AS (SELECT DISTINCT concat('part ', p_partkey) AS key, p_partkey AS id FROM part WHERE p_partkey % 3 <> 0),
lk AS (SELECT page, pos, section, kind, j, {LINKS.format('line')}[j] AS link FROM (SELECT *, unnest(range(1, len({LINKS.format('line')}) + 1)) AS j FROM lines WHERE lower(section) NOT IN ('references', 'see also', 'external links', 'notes', 'bibliography')) q),
hit AS (SELECT page, id AS target_id, kind, section, CASE kind WHEN 'table' THEN 0.82 WHEN 'definition' THEN 0.8 WHEN 'list' THEN 0.76 ELSE 0.62 END::DOUBLE AS confidence, pos, j FROM lk JOIN dict ON key = lower({NORM.format('link')}) WHERE NOT starts_with(lower(link), 'file:')),
best AS (SELECT *, row_number() OVER (PARTITION BY page, target_id ORDER BY confidence DESC, pos, j) AS rn FROM hit)"""


def dictionary(t):
    return t.part.where("p_partkey % 3 <> 0").select(F.concat(F.lit("part "), "p_partkey").alias("key"), F.col("p_partkey").alias("id")).distinct()


@query("x8_section_links", sql_with("wiki") + f",\n{LINES},\n{FOUND}\nSELECT page, target_id, kind, section, confidence FROM best WHERE rn = 1")
def x8(t):
    return X.section_links(t.wiki, dictionary(t))


@query("x9_nested_context", sql_with("wiki") + f",\n{LINES}" + r""", b AS (SELECT page, CAST(pos AS INTEGER) AS pos, section, CAST(len(regexp_extract(line, '^([*#]+)', 1)) AS INTEGER) AS depth, regexp_extract(line, '\[\[([^\]|#]+)(?:[^\]|]*)(?:\|[^\]]*)?\]\]', 1) AS link FROM lines WHERE kind = 'list')
SELECT page, pos, depth, link, coalesce((SELECT max_by(a.link, a.pos) FROM b a WHERE a.page = b.page AND a.section = b.section AND a.pos < b.pos AND a.depth < b.depth), section) AS context FROM b""")  # fmt: skip
def x9(t):
    return X.nested_context(t.wiki)


@query("x10_template_links", sql_with("wiki") + r""", nb AS (SELECT page, unnest(regexp_extract_all(text, '(?s)(\{\{Navbox.*?\n\}\})', 1)) AS b FROM wiki)
SELECT DISTINCT page, trim(regexp_replace(lower(regexp_extract(b, '\|\s*title\s*=\s*([^\n]*)', 1)), '\bgenres?\b', '')) AS owner, unnest(""" + LINKS.format("b") + ") AS link FROM nb")  # fmt: skip
def x10(t):
    return X.template_links(t.wiki)


_JOB = sql_with("wiki") + f",\n{LINES},\n{FOUND}" + r""",
src AS (SELECT type AS owner, title, page, 0 AS pr FROM wiki WHERE page % 3 = 0 UNION ALL SELECT type, upper(title), page, 1 FROM wiki WHERE page % 2 = 0),
one AS (SELECT owner, page FROM (SELECT owner, page, row_number() OVER (PARTITION BY owner, lower(title) ORDER BY pr, title) AS rn FROM src) q WHERE rn = 1),
b AS (SELECT page, CAST(pos AS INTEGER) AS pos, section, CAST(len(regexp_extract(line, '^([*#]+)', 1)) AS INTEGER) AS depth, regexp_extract(line, '\[\[([^\]|#]+)(?:[^\]|]*)(?:\|[^\]]*)?\]\]', 1) AS link FROM lines WHERE kind = 'list'),
ne AS (SELECT page, link, coalesce((SELECT max_by(a.link, a.pos) FROM b a WHERE a.page = b.page AND a.section = b.section AND a.pos < b.pos AND a.depth < b.depth), section) AS context FROM b),
nb AS (SELECT page, unnest(regexp_extract_all(text, '(?s)(\{\{Navbox.*?\n\}\})', 1)) AS b FROM wiki), te AS (SELECT DISTINCT page, trim(regexp_replace(lower(regexp_extract(b, '\|\s*title\s*=\s*([^\n]*)', 1)), '\bgenres?\b', '')) AS owner, unnest(""" + LINKS.format("b") + f""") AS link FROM nb),
fd AS (SELECT page, target_id, 'section' AS how, section AS "where", confidence FROM best WHERE rn = 1 UNION SELECT page, dict.id, 'nested', context, 0.7 FROM ne JOIN dict ON key = lower({NORM.format("link")}) UNION SELECT page, dict.id, 'template', owner, 0.66 FROM te JOIN dict ON key = lower({NORM.format("link")})),
ev AS (SELECT owner, target_id, how, "where", confidence, page FROM one JOIN fd USING (page))"""


def _page_job(t):
    own = t.wiki.select(F.col("type").alias("owner"), "title", "page")
    pages = X.page_list(own.where("page % 3 = 0"), own.where("page % 2 = 0").withColumn("title", F.upper("title")))
    picked = pages.join(own.select(F.lower("title").alias("low"), "page").distinct(), F.lower("title") == F.col("low")).select("owner", "page")
    stored = t.part.select(F.col("p_type").alias("owner"), F.col("p_size").cast("long").alias("target_id"), F.lit(0.64).alias("confidence"))
    return X.page_job(picked, t.wiki, dictionary(t), stored)


@query("x11_evidence", _JOB + ' SELECT owner, target_id, how, "where", confidence, page FROM ev')
def x11(t):
    return _page_job(t)[0]


@query("x11_page_job", _JOB + " SELECT owner, target_id, max(confidence) AS confidence FROM (SELECT owner, target_id, confidence FROM ev UNION ALL SELECT p_type, p_size, 0.64 FROM part) q GROUP BY ALL")
def x11b(t):
    return _page_job(t)[1]


TITLES = "CASE p_partkey % 8 WHEN 0 THEN concat('Music of the ', p_name) WHEN 1 THEN concat('Category:Music of ', p_name) WHEN 2 THEN concat('List of ', p_name, ' styles') WHEN 3 THEN concat('List of ', p_name) WHEN 4 THEN concat(p_name, ' (country)') WHEN 5 THEN concat('Template:', p_name) WHEN 6 THEN concat('Category:', p_name) ELSE p_name END"


@query("x12_title_classes", f"""WITH t AS (SELECT DISTINCT {TITLES} AS title FROM part), r AS (SELECT title, CASE WHEN regexp_matches(lower(title), '^(?:file|template|help|portal|wikipedia):') THEN 0 WHEN starts_with(lower(title), 'category:music of ') THEN 1 WHEN starts_with(lower(title), 'category:') THEN 2
 WHEN regexp_matches(lower(title), '^music (?:of|in) ') THEN 3 WHEN regexp_matches(lower(title), '^list of .*(?:genres|styles)') THEN 4 WHEN starts_with(lower(title), 'list of ') THEN 5 WHEN regexp_matches(lower(title), '(?:ring|bolt)') THEN 6 ELSE 7 END AS k FROM t)
SELECT title, ['ignored', 'category', 'category', 'container', 'list', 'list', 'node', 'node'][k + 1] AS type, ['rejected', 'accepted', 'needs_review', 'accepted', 'accepted', 'rejected', 'needs_review', 'candidate'][k + 1] AS status, CAST([1.0, 0.9, 0.5, 0.92, 0.85, 0.6, 0.55, 0.4][k + 1] AS DOUBLE) AS confidence FROM r""")  # fmt: skip
def x12(t):
    return X.classify_titles(t.part.select(F.expr(TITLES).alias("title")).distinct())


@query("x13_container_names", f"WITH t AS (SELECT DISTINCT {TITLES} AS title FROM part)" + r"""
SELECT title, coalesce(nullif(trim(regexp_extract(title, '(?i)^(?:category:)?music (?:of|in) (?:the )?(.+)$', 1)), ''), nullif(trim(regexp_extract(title, '(?i)^list of (.+?) (?:music )?(?:styles|genres)$', 1)), ''), nullif(trim(regexp_extract(title, '(?i)^(.+?) \((?:country|state|region)\)$', 1)), '')) AS name FROM t""")  # fmt: skip
def x13(t):
    return t.part.select(F.expr(TITLES).alias("title")).distinct().select("title", X.container_name("title").alias("name"))


@query("x14_year_spans", sql_with("wiki") + r""", s AS (SELECT page AS id, regexp_extract(text, 'early (\d+)s', 1) AS d FROM wiki)
SELECT id, 'lead' AS part, CAST(d AS INTEGER) AS year_start, CAST(d AS INTEGER) + 3 AS year_end FROM s WHERE regexp_matches(d, '^19\d0$')""")  # fmt: skip
def x14(t):
    lead = t.wiki.select(F.col("page").alias("id"), F.lit("lead").alias("part"), F.regexp_extract("text", r"(?m)^(The .*)$", 1).alias("text"))
    return X.year_spans(lead).drop("pos")


@query("x15_category_crawl", sql_with("members", recursive=True) + """, c AS (SELECT DISTINCT category AS title, TRUE AS is_category, CAST(0 AS INTEGER) AS depth FROM members WHERE category LIKE '%S' OR category LIKE '%Y'
UNION SELECT m.member, m.is_category, c.depth + 1 FROM c JOIN members m ON m.category = c.title WHERE c.is_category AND c.depth < 3) SELECT title, is_category, min(depth) AS depth FROM c GROUP BY ALL""")  # fmt: skip
def x15(t):
    return X.crawl(t.members, t.members.where("category like '%S' or category like '%Y'").select("category"), 3)


@query("x16_link_expansion", sql_with("wiki") + f""", lk AS (SELECT DISTINCT page, {CAP.format(NORM.format('link'))} AS title FROM (SELECT page, unnest({LINKS.format('text')}) AS link FROM wiki) q WHERE NOT starts_with(lower(link), 'file:')),
ok AS (SELECT * FROM lk WHERE title IN (SELECT concat('Part ', p_partkey) FROM part WHERE p_size % 2 = 0))
SELECT 'new' AS kind, title AS what FROM (SELECT DISTINCT title FROM ok) q WHERE title NOT IN (SELECT concat('Part ', p_partkey) FROM part WHERE p_partkey % 5 = 0)
UNION ALL SELECT 'bare', CAST(page AS VARCHAR) FROM wiki WHERE page NOT IN (SELECT page FROM ok)""")  # fmt: skip
def x16(t):
    titles = t.part.select(F.concat(F.lit("Part "), "p_partkey").alias("title"), "p_partkey", "p_size")
    new, bare = X.link_expansion(t.wiki.select("page"), t.wiki, titles.where("p_partkey % 5 = 0"), titles.where("p_size % 2 = 0"))
    return new.select(F.lit("new").alias("kind"), F.col("title").alias("what")).union(bare.select(F.lit("bare"), F.col("page").cast("string")))


@query("s5_page_corpus", """SELECT title, sha256, status FROM (SELECT url AS title, CASE WHEN html IS NOT NULL THEN sha256(html) END AS sha256, CASE WHEN html IS NULL THEN 'error' WHEN html = '' THEN 'missing' ELSE 'ok' END AS status, row_number() OVER (PARTITION BY url ORDER BY page_id) AS rn FROM pages) q WHERE rn = 1 AND title NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)""")
def s5(t):
    from edgeloom.sources.readers import page_corpus

    own = t.pages.select(F.col("url").alias("title"), F.col("html").alias("text"), F.col("page_id").alias("revision"))
    return page_corpus(own, own.where("revision % 3 = 0").select("title")).select("title", "sha256", "status")



"""The operators' inputs, bound to the driver's tables by plain SQL that both engines run."""

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: one marked-up page a part: an info block, a sentence with years, sections with links and nested lists
_PAGE = """{{Infobox genre
| name = @p_name@
| stylistic_origins = [[@p_type@ music]], [[part @p_partkey % 50@|Part]], 19@p_partkey % 10@0s @p_brand@
| derivatives = @p_brand@; @lower(p_type)@, x, @p_name@
| color = #@substr(md5(concat('', p_partkey)), 1, 6)@
}}
The '''@p_name@''' is a kind of [[@lower(p_type)@ style#History|style]] that emerged in the early 19@40 + p_size@s<ref>note</ref>.
== Styles ==
* [[part @p_partkey % 40@]] is a genre of [[@p_brand@]]
** [[part @p_partkey % 30@|p]]
; [[File:x.png]] [[part @p_partkey % 20@]]
| [[part @p_partkey % 60@]] || x
== References ==
* [[part 1]]
{{Navbox
| title = @p_type@ genres
| list1 = [[part @p_partkey % 25@]] [[part @p_partkey % 35@]]
}}"""


def _page_sql() -> str:
    """The page as a concat() that both engines know: quoted text, line breaks as chr(10), and expressions."""
    parts: list[str] = []
    for k, piece in enumerate(_PAGE.split("@")):
        if k % 2:
            parts.append(piece)
            continue
        for j, line in enumerate(piece.split("\n")):
            parts += ["chr(10)"] * bool(j) + ["'" + line.replace("'", "''") + "'"]
    return f"concat({', '.join(parts)})"


_WIKI = f"SELECT p_partkey AS page, concat(p_name, ' ', p_partkey) AS title, p_name AS name, p_type AS type, p_brand AS brand, {_page_sql()} AS text FROM part"

#: name: (tables and bindings it reads, select)
BINDINGS: dict[str, tuple[tuple[str, ...], str]] = {
    # a container tree: regions, nations, suppliers, parts
    "nodes": (("region", "nation", "supplier", "part", "lineitem"), """
        SELECT concat('r:', r_regionkey) AS id, r_name AS title, 'region' AS kind, CAST(NULL AS DOUBLE) AS views FROM region
        UNION ALL SELECT concat('n:', n_nationkey), n_name, 'nation', CAST(NULL AS DOUBLE) FROM nation
        UNION ALL SELECT concat('s:', s_suppkey), s_name, 'supplier', v FROM supplier LEFT JOIN (SELECT l_suppkey AS k, sum(l_quantity) AS v FROM lineitem GROUP BY l_suppkey) q ON k = s_suppkey
        UNION ALL SELECT concat('p:', p_partkey), concat(p_name, ' ', p_partkey), 'part', v FROM part LEFT JOIN (SELECT l_partkey AS k, sum(l_quantity) AS v FROM lineitem GROUP BY l_partkey) q ON k = p_partkey"""),
    "links": (("region", "nation", "supplier", "lineitem"), """
        SELECT concat('r:', n_regionkey) AS from_id, concat('n:', n_nationkey) AS to_id, 'subgenre' AS relation, CASE n_nationkey % 3 WHEN 0 THEN 'infobox' WHEN 1 THEN 'wikidata' ELSE 'manual_curation' END AS source, CAST(NULL AS VARCHAR(20)) AS evidence_relation, CAST(n_nationkey AS BIGINT) AS k FROM nation
        UNION ALL SELECT concat('n:', s_nationkey), concat('s:', s_suppkey), 'regional_scene', CASE s_suppkey % 3 WHEN 0 THEN 'infobox' WHEN 1 THEN 'wikidata' ELSE 'manual_curation' END, CAST(NULL AS VARCHAR(20)), s_suppkey FROM supplier
        UNION ALL SELECT concat('s:', l_suppkey), concat('p:', l_partkey), CASE l_partkey % 4 WHEN 0 THEN 'derivative' WHEN 1 THEN 'subgenre' WHEN 2 THEN 'related' ELSE 'fusion_genre' END, CASE (l_partkey + l_suppkey) % 3 WHEN 0 THEN 'infobox' WHEN 1 THEN 'wikidata' ELSE 'inbound_index' END, CASE WHEN l_partkey % 8 = 2 THEN 'subgenre' WHEN l_partkey % 16 = 6 THEN 'stylistic_origin_of' END, l_partkey FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) d"""),
    "edges": (("links",), "SELECT from_id, to_id, relation, source, CAST(row_number() OVER (PARTITION BY from_id ORDER BY k, to_id) - 1 AS INTEGER) AS ordinal, evidence_relation FROM links"),
    # successions of a customer's orders by priority and status: a directed graph with cycles, that grows with the customers
    "visits": (("orders",), "SELECT o_custkey, o_orderkey, o_orderdate, concat('g:', o_custkey, ':', substr(o_orderpriority, 1, 1), o_orderstatus) AS id FROM orders"),
    "steps": (("visits",), "SELECT o_orderkey, id AS a, lead(id) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM visits"),
    "succ": (("steps",), "SELECT a AS from_id, b AS to_id, count(*) AS n FROM steps WHERE b IS NOT NULL AND a <> b GROUP BY a, b"),
    "succ_edges": (("succ",), "SELECT from_id, to_id, CASE WHEN n > 1 OR from_id LIKE '%P' THEN 'subgenre' WHEN from_id LIKE '%F' THEN 'derivative' ELSE 'related' END AS relation, CASE WHEN to_id LIKE '%:1P' THEN 'manual_curation' WHEN to_id LIKE '%F' THEN 'wikidata' WHEN from_id LIKE '%:2_' THEN 'inbound_index' ELSE 'infobox' END AS source, CAST(0 AS INTEGER) AS ordinal, CASE WHEN from_id LIKE '%:3_' THEN 'stylistic_origin_of' END AS evidence_relation FROM succ"),
    # staged regions, their parents and their members, as a review finds them
    "staged_edges": (("succ",), "SELECT from_id AS child, to_id AS parent, CASE WHEN to_id LIKE '%P' THEN 'part_of' WHEN to_id LIKE '%O' THEN 'admin_parent' ELSE 'cultural_region_of' END AS relation, CASE WHEN from_id LIKE '%:5_' THEN 'rejected' WHEN from_id LIKE '%:4_' THEN 'proposed' ELSE 'accepted' END AS status FROM succ"),
    "staged_regions": (("visits",), "SELECT id, CASE WHEN id LIKE '%:1F' THEN concat('Styles of music ', id) WHEN id LIKE '%:2F' THEN 'Asia' ELSE concat('Land ', id) END AS name, CAST(count(*) AS BIGINT) AS views FROM visits GROUP BY id"),
    "staged_members": (("visits", "lineitem"), "SELECT id AS region, l_partkey AS node, CASE WHEN l_partkey % 50 = 0 THEN concat('List of ', l_partkey) ELSE concat('Part ', l_partkey) END AS title, CASE WHEN l_tax > 0.06 THEN 'regional_style_mention' ELSE 'regional_scene' END AS relation, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'rejected' ELSE 'proposed' END AS status, CASE l_linestatus WHEN 'F' THEN 'wikipedia_article' ELSE 'wikipedia_list' END AS source_type, l_discount AS confidence FROM lineitem JOIN visits ON o_orderkey = l_orderkey"),
    # parts bought in one order: an undirected weighted graph
    "together": (("lineitem",), "SELECT concat('g:', x.k) AS a, concat('g:', y.k) AS b, count(*) AS n FROM (SELECT DISTINCT l_orderkey AS o, l_partkey AS k FROM lineitem) x JOIN (SELECT DISTINCT l_orderkey AS o, l_partkey AS k FROM lineitem) y ON x.o = y.o AND x.k < y.k GROUP BY x.k, y.k"),
    # events as a log of versions of users
    "versions": (("events",), "SELECT concat('u:', user_id) AS id, concat(event_type, ':', CAST(CAST(floor(value) AS BIGINT) AS VARCHAR(20))) AS content, ts, event_id, event_type FROM events"),
    "old_rows": (("versions",), "SELECT id, content AS hash, ts AS last_fetched_at, ts AS last_changed_at, CASE WHEN event_id % 4 = 0 THEN ts END AS deleted_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) AS rn FROM versions WHERE event_id % 3 <> 0) q WHERE rn = 1"),
    "new_rows": (("versions",), "SELECT id, content AS hash, ts AS fetched_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) AS rn FROM versions WHERE event_id % 5 <> 1) q WHERE rn = 1"),
    # years of orders, weighted by what was bought
    "years": (("orders", "lineitem"), "SELECT concat('p:', l_partkey) AS id, CAST(extract(YEAR FROM o_orderdate) AS INTEGER) AS year_start, CAST(extract(YEAR FROM l_shipdate) AS INTEGER) AS year_end, l_quantity AS weight, l_returnflag AS kind FROM lineitem JOIN orders ON o_orderkey = l_orderkey"),
    # rectangles
    "boxes": (("embeddings",), "SELECT vec_id AS id, 1000 * CAST(embedding[{first}] AS DOUBLE) AS x, 1000 * CAST(embedding[{second}] AS DOUBLE) AS y, CAST(8 + label % 5 AS DOUBLE) AS w, CAST(4 + vec_id % 3 AS DOUBLE) AS h, CAST(vec_id % 100 AS DOUBLE) AS priority FROM embeddings"),
    "names": (("part", "supplier"), "SELECT concat('p:', p_partkey) AS id, concat(p_name, ' ', p_brand, CASE WHEN p_partkey % 3 = 0 THEN ' s' ELSE '' END) AS name, p_brand AS brand, p_type AS type FROM part"),
    "wiki": (("part",), _WIKI),
    "members": (("part",), "SELECT DISTINCT concat('Category:', p_type) AS category, concat('Category:', p_type, ' ', p_brand) AS member, TRUE AS is_category FROM part UNION ALL SELECT DISTINCT concat('Category:', p_type, ' ', p_brand), concat(p_name, ' ', p_partkey % 50), FALSE FROM part UNION ALL SELECT DISTINCT concat('Category:', p_type), concat('Music of ', p_name), FALSE FROM part WHERE p_size % 9 = 0"),
}


def sql_with(*names: str, recursive: bool = False) -> str:
    """WITH clauses of the bindings, for DuckDB; ends before the query's own select or further clauses."""
    order: list[str] = []

    def add(n: str) -> None:
        if n in TABLES or n in order:
            return
        for m in BINDINGS[n][0]:
            add(m)
        order.append(n)

    for n in names:
        add(n)
    clauses = [f"{n} AS ({BINDINGS[n][1].replace('{first}', '1').replace('{second}', '2')})" for n in order]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(clauses)


class Tables:
    """The tables and bindings of one data folder as DataFrames: t.lineitem, t.edges, ..."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in BINDINGS:
                needs, text = BINDINGS[name]
                text = text.replace("{first}", "0").replace("{second}", "1")
                for n in needs:
                    getattr(self, n).createOrReplaceTempView(f"bound_{n}")
                    text = _renamed(text, n)
                self._made[name] = self.spark.sql(text)
            else:
                raise AttributeError(name)
        return self._made[name]


def _renamed(text: str, table: str) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 bound_{table}", text)

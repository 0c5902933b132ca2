"""Queries that apply the operators to the test tables, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import compare, hierarchy, lookup, merge, retrieval
from ..sources import files, scans
from . import document, runs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
c = F.col


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query by its function's name, with its SQL."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# A tree of regions, nations and customers under one root

TREE_SQL = """nodes AS (
  SELECT 'root' AS id, CAST(NULL AS VARCHAR) AS parent, CAST(0 AS BIGINT) AS ordinal, CAST(0 AS DOUBLE) AS bal
  UNION ALL SELECT 'r:' || r_regionkey, 'root', r_regionkey, 0 FROM region
  UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, n_nationkey, 0 FROM nation
  UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, c_custkey, c_acctbal FROM customer)"""


def tree(spark: SparkSession, sf: str) -> DataFrame:
    key = lambda p, x: F.concat(F.lit(p), c(x).cast("string"))
    root = spark.range(1).select(F.lit("root").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("ordinal"), F.lit(0.0).alias("bal"))
    regions = table(spark, sf, "region").select(key("r:", "r_regionkey").alias("id"), F.lit("root").alias("parent"), c("r_regionkey").cast("long").alias("ordinal"), F.lit(0.0).alias("bal"))
    nations = table(spark, sf, "nation").select(key("n:", "n_nationkey").alias("id"), key("r:", "n_regionkey").alias("parent"), c("n_nationkey").cast("long").alias("ordinal"), F.lit(0.0).alias("bal"))
    customers = table(spark, sf, "customer").select(key("c:", "c_custkey").alias("id"), key("n:", "c_nationkey").alias("parent"), c("c_custkey").alias("ordinal"), c("c_acctbal").alias("bal"))
    return root.unionByName(regions).unionByName(nations).unionByName(customers)


@query(f"""WITH RECURSIVE {TREE_SQL},
own AS (SELECT 'c:' || o_custkey AS id, sum(n) AS items, count(*) FILTER (WHERE o_orderstatus = 'F') AS problems
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey GROUP BY 1),
up AS (SELECT id, id AS ancestor FROM nodes UNION ALL SELECT up.id, nodes.parent FROM up JOIN nodes ON nodes.id = up.ancestor WHERE nodes.parent IS NOT NULL)
SELECT n.id AS node_id, CAST(coalesce(sum(items), 0) AS BIGINT) AS items, CAST(coalesce(sum(problems), 0) AS BIGINT) AS problems
FROM nodes n LEFT JOIN up ON up.ancestor = n.id LEFT JOIN own ON own.id = up.id GROUP BY 1""")
def hierarchical_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Line items and problem orders of customers, added up to nations, regions and the root."""
    counts = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    own = orders.join(counts, orders.o_orderkey == counts.l_orderkey, "left").groupBy(F.concat(F.lit("c:"), c("o_custkey").cast("string")).alias("id"))
    own = own.agg(F.sum("n").alias("items"), F.count_if(c("o_orderstatus") == "F").alias("problems"))
    return hierarchy.hierarchical_rollup(tree(spark, sf), own).withColumnRenamed("id", "node_id")


def some_customers(spark: SparkSession, sf: str) -> DataFrame:
    return tree(spark, sf).filter("bal > 9900").select("id")


@query(f"""WITH RECURSIVE {TREE_SQL}, up AS (
  SELECT parent AS id FROM nodes WHERE bal > 9900 UNION SELECT nodes.parent FROM up JOIN nodes ON nodes.id = up.id)
SELECT DISTINCT up.id FROM up JOIN nodes USING (id) WHERE nodes.parent IS NOT NULL""")
def ancestor_expand(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.expand_ancestors(tree(spark, sf), some_customers(spark, sf))


@query(f"""WITH RECURSIVE {TREE_SQL}, up AS (SELECT 'n:3' AS id UNION SELECT nodes.parent FROM up JOIN nodes ON nodes.id = up.id WHERE nodes.parent IS NOT NULL)
SELECT id FROM up UNION SELECT id FROM nodes WHERE parent = 'n:3'""")
def neighborhood(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.neighborhood(tree(spark, sf), spark.createDataFrame([("n:3",)], "id string"))


@query(f"""WITH {TREE_SQL}, shown AS (
SELECT id, 0 AS level, '000000000000' AS path FROM nodes WHERE parent IS NULL
UNION ALL SELECT id, 1, '000000000000/' || lpad(CAST(ordinal AS VARCHAR), 12, '0') FROM nodes WHERE parent = 'root'
UNION ALL SELECT n.id, 2, '000000000000/' || lpad(CAST(p.ordinal AS VARCHAR), 12, '0') || '/' || lpad(CAST(n.ordinal AS VARCHAR), 12, '0') FROM nodes n JOIN nodes p ON n.parent = p.id WHERE p.id IN ('r:1', 'r:2')
UNION ALL SELECT n.id, 3, '000000000000/' || lpad(CAST(q.ordinal AS VARCHAR), 12, '0') || '/' || lpad(CAST(p.ordinal AS VARCHAR), 12, '0') || '/' || lpad(CAST(n.ordinal AS VARCHAR), 12, '0')
  FROM nodes n JOIN nodes p ON n.parent = p.id JOIN nodes q ON p.parent = q.id WHERE p.id IN ('n:1', 'n:4') AND q.id IN ('r:1', 'r:2'))
SELECT id, CAST(level AS BIGINT) AS level, row_number() OVER (ORDER BY path) - 1 AS place FROM shown""")
def visible_tree(spark: SparkSession, sf: str) -> DataFrame:
    expanded = spark.createDataFrame([("r:1",), ("r:2",), ("n:1",), ("n:4",)], "id string")
    return hierarchy.visible_tree(tree(spark, sf), expanded)


@query(f"""WITH RECURSIVE {TREE_SQL}, up AS (SELECT id FROM nodes WHERE bal > 9900 UNION SELECT nodes.parent FROM up JOIN nodes ON nodes.id = up.id WHERE nodes.parent IS NOT NULL) SELECT id FROM up""")
def visible_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.visible_filtered(tree(spark, sf), c("bal") > 9900, spark.createDataFrame([], "id string"))


# Merging observers

OBSERVED_SQL = """observed AS (
  SELECT c_custkey AS id, 'SOURCE' AS source, CASE WHEN c_custkey % 4 = 0 THEN '  ' ELSE c_name || '-s' END AS name, c_mktsegment AS segment, CAST(NULL AS BOOLEAN) AS flag FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT c_custkey, 'BYTECODE', c_name || '-b', '', c_acctbal > 0 FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT c_custkey, 'RUNTIME', c_name || '-r', c_mktsegment || '!', CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal > 5000 END FROM customer)"""


def observed(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer")
    key = c("c_custkey")
    source = rows.filter(key % 2 == 0).select(key.alias("id"), F.lit("SOURCE").alias("source"), F.when(key % 4 == 0, "  ").otherwise(F.concat("c_name", F.lit("-s"))).alias("name"), c("c_mktsegment").alias("segment"), F.lit(None).cast("boolean").alias("flag"))
    bytecode = rows.filter(key % 3 == 0).select(key.alias("id"), F.lit("BYTECODE").alias("source"), F.concat("c_name", F.lit("-b")).alias("name"), F.lit("").alias("segment"), (c("c_acctbal") > 0).alias("flag"))
    runtime = rows.select(key.alias("id"), F.lit("RUNTIME").alias("source"), F.concat("c_name", F.lit("-r")).alias("name"), F.concat("c_mktsegment", F.lit("!")).alias("segment"), F.when(key % 5 != 0, c("c_acctbal") > 5000).alias("flag"))
    return source.unionByName(bytecode).unionByName(runtime)


@query(f"""WITH {OBSERVED_SQL}, s AS (FROM observed WHERE source = 'SOURCE'), b AS (FROM observed WHERE source = 'BYTECODE'), r AS (FROM observed WHERE source = 'RUNTIME')
SELECT coalesce(s.id, b.id, r.id) AS id,
  coalesce(CASE WHEN trim(s.name) <> '' THEN s.name END, CASE WHEN trim(b.name) <> '' THEN b.name END, r.name) AS name,
  coalesce(CASE WHEN trim(s.segment) <> '' THEN s.segment END, CASE WHEN trim(r.segment) <> '' THEN r.segment END, b.segment) AS segment,
  coalesce(s.flag, r.flag, b.flag) AS flag, coalesce(b.flag, false) OR coalesce(r.flag, false) AS any_flag
FROM r FULL JOIN b ON r.id = b.id FULL JOIN s ON coalesce(r.id, b.id) = s.id""")
def observer_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = observed(spark, sf).withColumn("any_flag", c("flag"))
    return merge.observer_merge(rows, "id", first_text={"name": merge.BY_SOURCE, "segment": merge.RUNTIME_FIRST}, first_value={"flag": merge.RUNTIME_FIRST}, any_of={"any_flag": ("BYTECODE", "RUNTIME")})


@query(f"""WITH {OBSERVED_SQL}, long AS (SELECT id, 'name' AS field, name AS value FROM observed UNION ALL SELECT id, 'segment', segment FROM observed UNION ALL SELECT id, 'flag', CAST(flag AS VARCHAR) FROM observed)
SELECT id, field, string_agg(DISTINCT value, '|' ORDER BY value) AS values FROM long WHERE trim(value) <> '' GROUP BY 1, 2 HAVING count(DISTINCT value) > 1""")
def merge_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return merge.merge_conflicts(observed(spark, sf), "id", ["name", "segment", "flag"])


SLICES_SQL = """slices AS (
  SELECT o_orderkey, o_orderstatus, o_totalprice, 1 AS priority FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT o_orderkey, o_orderstatus || 'x', o_totalprice + 1, 2 FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT o_orderkey, o_orderstatus || 'y', o_totalprice + 2, 3 FROM orders WHERE o_orderkey % 5 <> 0)"""


@query(f"""WITH {SLICES_SQL} SELECT o_orderkey, o_orderstatus, o_totalprice, priority,
  first_value(priority || ':' || o_orderkey) OVER (PARTITION BY o_orderkey ORDER BY priority) AS position
FROM slices QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY priority DESC) = 1""")
def overlay_upsert(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    part = lambda rows, mark, n: rows.select("o_orderkey", F.concat("o_orderstatus", F.lit(mark)).alias("o_orderstatus"), (c("o_totalprice") + (n - 1)).alias("o_totalprice"), F.lit(n).alias("priority"))
    rows = part(o.filter("o_orderkey % 2 = 0"), "", 1).unionByName(part(o.filter("o_orderkey % 3 = 0"), "x", 2)).unionByName(part(o.filter("o_orderkey % 5 <> 0"), "y", 3))
    return merge.overlay_upsert(rows, "o_orderkey", "priority", "o_orderkey")


@query("""WITH seen AS (SELECT user_id, event_type, min(CAST(floor((event_id) / 100) AS BIGINT)) AS part, min(event_id) AS pos FROM events GROUP BY 1, 2)
SELECT user_id, string_agg(event_type, ',' ORDER BY part, pos) AS event_types FROM seen GROUP BY 1""")
def ordered_distinct_union(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").withColumn("part", F.floor(c("event_id") / 100))
    return merge.ordered_distinct_union(rows, "user_id", "event_type", "part", "event_id").select("user_id", F.array_join("values", ",").alias("event_types"))


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def citation_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "customer").filter("c_acctbal > 0").select(c("c_custkey").alias("o_custkey"))
    return lookup.unknown_references(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), known, "o_custkey")


@query("""SELECT c_custkey, event_type, event_id FROM customer LEFT JOIN (
  SELECT user_id, arg_min(event_type, ts) AS event_type, arg_min(event_id, ts) AS event_id FROM events GROUP BY 1) ON user_id = c_custkey""")
def first_ref_left_join(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").withColumnRenamed("user_id", "c_custkey")
    return lookup.first_match(table(spark, sf, "customer").select("c_custkey"), events, "c_custkey", ["ts", "event_id"], ["event_type", "event_id"])


@query("""SELECT DISTINCT l_suppkey, coalesce(s_name, 'external:' || l_suppkey) AS owner FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 5000""")
def lookup_with_fallback(spark: SparkSession, sf: str) -> DataFrame:
    left = table(spark, sf, "lineitem").select("l_suppkey").distinct()
    known = table(spark, sf, "supplier").filter("s_acctbal > 5000").select(c("s_suppkey").alias("l_suppkey"), "s_name")
    return lookup.lookup_with_fallback(left, known, "l_suppkey", "s_name", F.concat(F.lit("external:"), c("l_suppkey").cast("string")), "owner")


@query("""SELECT o_orderkey, coalesce(a.c_name, b.c_name, 'root') AS owner FROM orders
LEFT JOIN (FROM customer WHERE c_mktsegment = 'BUILDING') a ON a.c_custkey = o_custkey
LEFT JOIN (FROM customer WHERE c_mktsegment = 'BUILDING') b ON b.c_custkey = o_orderkey % 1000""")
def lookup_by_either(spark: SparkSession, sf: str) -> DataFrame:
    left = table(spark, sf, "orders").select("o_orderkey", "o_custkey", (c("o_orderkey") % 1000).alias("other"))
    known = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'")
    return lookup.lookup_by_either(left, known, ["o_custkey", "other"], "c_custkey", "c_name", "owner", F.lit("root")).select("o_orderkey", "owner")


@query("""WITH layers AS (
  SELECT l_suppkey AS key, 'first:' || l_orderkey AS owner, l_orderkey AS ordinal, 0 AS layer FROM lineitem WHERE l_suppkey % 3 = 0
  UNION ALL SELECT l_suppkey, 'last:' || l_orderkey, -l_orderkey, 1 FROM lineitem WHERE l_suppkey % 2 = 0)
SELECT s_suppkey AS key, coalesce(owner, 'root') AS owner FROM supplier LEFT JOIN (SELECT key, arg_min(owner, layer * 1000000000000 + ordinal) AS owner FROM layers GROUP BY 1) l ON l.key = s_suppkey""")
def layered_lookup(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(c("l_suppkey").alias("key"), c("l_orderkey").alias("ordinal"))
    layer = lambda n, mark: rows.filter(c("key") % n == 0).select("key", F.concat(F.lit(mark), c("ordinal").cast("string")).alias("owner"), "ordinal")
    left = table(spark, sf, "supplier").select(c("s_suppkey").alias("key"))
    return lookup.layered_lookup(left, "key", [(layer(3, "first:"), False), (layer(2, "last:"), True)], "owner", F.lit("root"))


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)
OR o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = 7)""")
def or_key_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_suppkey").alias("suppliers"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice").join(lines, "o_orderkey", "left")
    wanted = table(spark, sf, "customer").filter("c_nationkey = 7").select(F.concat(F.lit("c"), c("c_custkey").cast("string")).alias("key"))
    wanted = wanted.unionByName(table(spark, sf, "supplier").filter("s_nationkey = 7").select(F.concat(F.lit("s"), c("s_suppkey").cast("string")).alias("key")))
    keys = F.concat(F.array(F.concat(F.lit("c"), c("o_custkey").cast("string"))), F.transform(F.coalesce("suppliers", F.array().cast("array<bigint>")), lambda s: F.concat(F.lit("s"), s.cast("string"))))
    return lookup.either_key_semi(orders, wanted, "key", keys, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("""WITH paths AS (SELECT page_id AS ordinal, 'p' || page_id AS id, regexp_replace(url, '[/#?][^/#?]*$', '') AS path FROM pages),
best AS (SELECT pages.page_id, paths.id, CASE WHEN paths.path = url THEN 1000000 ELSE length(paths.path) END AS size, CASE WHEN paths.path = url THEN -paths.ordinal ELSE paths.ordinal END AS tie
  FROM pages JOIN paths ON paths.path <> '' AND (url = paths.path OR (starts_with(url, paths.path) AND substr(url, length(paths.path) + 1, 1) IN ('/', ':', '#')))),
one AS (SELECT page_id, id FROM best QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY size DESC, tie) = 1)
SELECT page_id, url, coalesce(id, 'root') AS owner FROM pages LEFT JOIN one USING (page_id)""")
def longest_prefix_join(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url")
    nodes = pages.select(c("page_id").alias("ordinal"), F.concat(F.lit("p"), c("page_id").cast("string")).alias("id"), F.regexp_replace("url", "[/#?][^/#?]*$", "").alias("path"))
    return lookup.longest_prefix_join(pages, nodes, "page_id", "url", F.lit("root"))


@query("""SELECT r_regionkey,
  (SELECT string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = r_regionkey) AS segments,
  (SELECT string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = r_regionkey) AS statuses,
  (SELECT string_agg(DISTINCT n_name, ',' ORDER BY n_name) FROM nation WHERE n_regionkey = r_regionkey) AS nations
FROM region""")
def optional_branches_collect(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation").select(c("n_nationkey").alias("c_nationkey"), c("n_regionkey").alias("r_regionkey"), "n_name")
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment").join(nations, "c_nationkey")
    orders = table(spark, sf, "orders").select(c("o_custkey").alias("c_custkey"), "o_orderstatus").join(customers, "c_custkey")
    out = lookup.collected_branches(table(spark, sf, "region").select("r_regionkey"), "r_regionkey", [(customers, "c_mktsegment", "segments"), (orders, "o_orderstatus", "statuses"), (nations, "n_name", "nations")])
    return out.select("r_regionkey", *(F.array_join(n, ",").alias(n) for n in ("segments", "statuses", "nations")))


@query("""SELECT DISTINCT l_suppkey AS source, l_partkey AS target FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10)""")
def edge_endpoint_filter(spark: SparkSession, sf: str) -> DataFrame:
    edges = table(spark, sf, "lineitem").select(F.concat(F.lit("s"), c("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("p"), c("l_partkey").cast("string")).alias("target")).distinct()
    nodes = table(spark, sf, "supplier").filter("s_acctbal > 5000").select(F.concat(F.lit("s"), c("s_suppkey").cast("string")).alias("id")).unionByName(table(spark, sf, "part").filter("p_size < 10").select(F.concat(F.lit("p"), c("p_partkey").cast("string")).alias("id")))
    kept = hierarchy.with_open_ends(edges, nodes)
    return kept.select(F.substr("source", F.lit(2)).cast("long").alias("source"), F.substr("target", F.lit(2)).cast("long").alias("target"))


YEARS_SQL = """a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE year(o_orderdate) = 1996), b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE year(o_orderdate) = 1997)"""


def active(spark: SparkSession, sf: str, year: int) -> DataFrame:
    return table(spark, sf, "orders").filter((c("o_orderdate") >= F.lit(f"{year}-01-01").cast("timestamp")) & (c("o_orderdate") < F.lit(f"{year + 1}-01-01").cast("timestamp"))).select(c("o_custkey").alias("id")).distinct()


@query(f"WITH {YEARS_SQL} SELECT id, 'REMOVED' AS change FROM a WHERE id NOT IN (FROM b) UNION ALL SELECT id, 'ADDED' FROM b WHERE id NOT IN (FROM a)")
def version_diff(spark: SparkSession, sf: str) -> DataFrame:
    return compare.version_diff(active(spark, sf, 1996), active(spark, sf, 1997), "id")


@query(f"WITH {YEARS_SQL} FROM a EXCEPT FROM b")
def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    return compare.set_difference(active(spark, sf, 1996), active(spark, sf, 1997))


@query(f"WITH {YEARS_SQL} (FROM a EXCEPT FROM b) UNION ALL (FROM b EXCEPT FROM a)")
def symmetric_difference(spark: SparkSession, sf: str) -> DataFrame:
    return compare.symmetric_difference(active(spark, sf, 1996), active(spark, sf, 1997), "id")


@query("""WITH patch AS (SELECT p_partkey + 1000 AS p_partkey, CASE WHEN p_size % 3 = 0 THEN '<name>' WHEN p_size % 3 = 1 THEN ' ' ELSE 'new ' || p_name END AS p_name FROM part WHERE p_partkey % 7 = 0)
SELECT part.p_partkey, coalesce(CASE WHEN trim(patch.p_name) <> '' AND NOT contains(patch.p_name, '<') THEN patch.p_name END, part.p_name) AS p_name, p_brand FROM part LEFT JOIN patch USING (p_partkey)
UNION ALL SELECT p_partkey, p_name, NULL FROM patch WHERE p_partkey NOT IN (SELECT p_partkey FROM part)""")
def patch_merge(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    third = c("p_size") % 3
    patch = table(spark, sf, "part").filter("p_partkey % 7 = 0").select((c("p_partkey") + 1000).alias("p_partkey"), F.when(third == 0, "<name>").when(third == 1, " ").otherwise(F.concat(F.lit("new "), c("p_name"))).alias("p_name"))
    return lookup.patch_merge(part, patch, "p_partkey", ["p_name"], lookup.value_guard(c("_p_p_name")))


# Retrieval

QUESTION = "the stion was token license from of"
_TERMS = retrieval.query_terms(QUESTION, 2, True)
_SCORE = " + ".join(f"CAST(contains(lower(text), '{t}') AS INTEGER)" for t in _TERMS)


@query(f"SELECT doc_id, {_SCORE} AS score FROM documents ORDER BY score DESC, doc_id LIMIT 12")
def term_overlap_topk(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return retrieval.term_overlap_topk(docs, QUESTION, 12, ordinal="doc_id").select("doc_id", "score")


_BM25_SQL = """WITH tokens AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: length(t) > 1) AS t FROM documents),
tf AS (SELECT doc_id, len(t) AS n, w.word, w.times, len(list_filter(t, lambda x: x = w.word)) AS tf FROM tokens, (VALUES {words}) AS w(word, times)),
stats AS (SELECT word, count(*) FILTER (WHERE tf > 0) AS df, count(*) AS big_n, avg(n) AS mean FROM tf GROUP BY word),
scores AS (SELECT doc_id, sum(times * ln((big_n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))) AS score FROM tf JOIN stats USING (word) GROUP BY doc_id)
SELECT doc_id, round(score, 6) AS score FROM scores"""
_WORDS = retrieval.query_terms(QUESTION, 1, False)
_BM25_SQL = _BM25_SQL.format(words=", ".join(f"('{w}', {_WORDS.count(w)})" for w in dict.fromkeys(_WORDS)))


@query(_BM25_SQL)
def bm25_full_rank(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return retrieval.bm25_scores(docs, QUESTION, ordinal="doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query(f"SELECT * FROM ({_BM25_SQL}) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 12")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return retrieval.bm25_topk(docs, QUESTION, 12, ordinal="doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query("""WITH s AS (SELECT p_partkey, CASE WHEN lower(p_name) = 'red' THEN 100 ELSE CASE WHEN starts_with(lower(p_name), 'red') THEN 80 WHEN contains(lower(p_name), 'red') THEN 60 ELSE 0 END
  + CASE WHEN contains(lower(p_brand), 'red') THEN 30 ELSE 0 END + CASE WHEN contains(lower(p_type), 'red') THEN 20 ELSE 0 END END AS score, p_name FROM part)
SELECT p_partkey, score FROM s WHERE score > 0 ORDER BY score DESC, p_name, lpad(CAST(p_partkey AS VARCHAR), 12, '0') LIMIT 8""")
def search_score(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "part").select(F.lpad(c("p_partkey").cast("string"), 12, "0").alias("id"), "p_partkey", c("p_name").alias("label"), c("p_brand").alias("path"), c("p_type").alias("metadata"), F.lit("").alias("kind"))
    return retrieval.search_topk(nodes, "Red ").select("p_partkey", "score")


KEYWORDS = ("token", "license", "example.com", "und", "idiot", "kafka")


@query(f"""WITH m AS (SELECT doc_id, source, unnest({list(KEYWORDS)}) AS keyword, text FROM documents), hits AS (SELECT * FROM m WHERE contains(lower(text), keyword))
SELECT keyword, upper(keyword) AS name, count(*) AS n, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM hits GROUP BY keyword""")
def keyword_multi_match(spark: SparkSession, sf: str) -> DataFrame:
    hits = retrieval.keyword_rows(table(spark, sf, "documents").select("doc_id", "source", "text"), KEYWORDS)
    groups = retrieval.keyword_groups(hits, "doc_id", "source")
    return groups.select("keyword", "name", F.size("labels").cast("long").alias("n"), F.array_join("nodes", ",").alias("sources"))


@query(f"""SELECT doc_id FROM documents WHERE {' OR '.join(f"contains(lower(text), '{k}')" for k in KEYWORDS[:3])} ORDER BY lpad(CAST(doc_id AS VARCHAR), 12, '0') LIMIT 20""")
def keyword_context(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "documents").select("doc_id", F.lpad(c("doc_id").cast("string"), 12, "0").alias("id"), F.lit("").alias("name"), c("text").alias("summary"), F.lit(None).cast("string").alias("path"))
    return retrieval.keyword_context(nodes, KEYWORDS[:3]).select("doc_id")


# Line scans

LINES_SQL = """lines AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS value FROM (
  SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents))"""


def document_lines(spark: SparkSession, sf: str) -> DataFrame:
    return files.lines(table(spark, sf, "documents").select("doc_id", "text"))


MARKED_SQL = "marked AS (SELECT doc_id, line, CASE WHEN starts_with(value, 'Th') THEN '## ' WHEN starts_with(value, 'T') THEN '# ' WHEN starts_with(value, 'S') THEN '####### ' WHEN starts_with(value, 'A') THEN '######' || chr(9) ELSE '' END || value AS value FROM lines)"


@query(f"WITH {LINES_SQL}, {MARKED_SQL} SELECT doc_id, line, length(regexp_extract(value, '^(#{{1,6}})\\s+(.+)$', 1)) AS level, trim(regexp_extract(value, '^(#{{1,6}})\\s+(.+)$', 2)) AS title FROM marked WHERE regexp_matches(value, '^(#{{1,6}})\\s+(.+)$')")
def heading_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that begin with Th, T, S or A are written as headings of some level first."""
    value = c("value")
    for start, mark in (("A", "######\t"), ("S", "####### "), ("T", "# "), ("Th", "## ")):
        value = F.when(c("value").startswith(start), F.concat(F.lit(mark), c("value"))).otherwise(value)
    return scans.headings(document_lines(spark, sf).withColumn("value", value)).select("doc_id", c("line").cast("long").alias("line"), c("level").cast("long").alias("level"), "title")


@query(f"""WITH {LINES_SQL} SELECT doc_id, line, last_value(CASE WHEN starts_with(value, 'T') THEN value END IGNORE NULLS)
  OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM lines""")
def carry_forward_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = scans.carried_forward(table(spark, sf, "documents").select("doc_id", "text"), lambda line: F.when(line.startswith("T"), line), "carried")
    return found.select("doc_id", c("line").cast("long").alias("line"), "carried")


@query(f"""WITH {LINES_SQL} SELECT doc_id, line, coalesce(last_value(CASE WHEN starts_with(value, 'T') THEN true WHEN starts_with(value, 'E') OR value = '' THEN false END IGNORE NULLS)
  OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS inside FROM lines""")
def section_flag_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = scans.section_flag(table(spark, sf, "documents").select("doc_id", "text"), lambda line: line.startswith("T"), lambda line: line.startswith("E") | (line == ""), "inside")
    return found.select("doc_id", c("line").cast("long").alias("line"), "inside")


def contract_texts(spark: SparkSession, sf: str, item: str, verb: str, opening: str) -> DataFrame:
    """(path, text): documents written as contracts. Sentences become lines: those that begin with T an item, with A to L a detail, with S a section."""
    text = F.regexp_replace("text", r"[.!?]\s+", "\n")
    for pattern, line in ((r"(?m)^T([a-z]+).*$", item), (r"(?m)^[A-L]([a-z]+).*$", verb), (r"(?m)^S.*$", opening)):
        text = F.regexp_replace(text, pattern, line)
    return table(spark, sf, "documents").select(c("doc_id").cast("string").alias("path"), text.alias("text"))


def contract_sql(item: str, verb: str, opening: str) -> str:
    text = r"regexp_replace(coalesce(text, ''), '[.!?]\s+', chr(10), 'g')"
    for pattern, line in ((r"^T([a-z]+)[^\n]*$", item), (r"^[A-L]([a-z]+)[^\n]*$", verb), (r"^S[^\n]*$", opening)):
        text = f"regexp_replace({text}, '(?m){pattern}', '{line}', 'g')"
    return f"""lines AS (SELECT path, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS line, unnest(l) AS value FROM (
  SELECT CAST(doc_id AS VARCHAR) AS path, string_split(regexp_replace({text}, '\n$', ''), chr(10)) AS l FROM documents))"""


@query(rf"""WITH {contract_sql(r'  /' + chr(92) + '1/{id}:', '    get:', 'paths:')}, carried AS (SELECT *, last_value(CASE WHEN regexp_matches(value, '^\s{{2}}(/[^:]+):\s*$') THEN trim(regexp_extract(value, '^\s{{2}}(/[^:]+):\s*$', 1)) END IGNORE NULLS)
  OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS url FROM lines)
SELECT path, line, upper(regexp_extract(value, '(?i)^\s{{4}}(get|post|put|patch|delete|options|head):\s*$', 1)) AS method, url FROM carried
WHERE url IS NOT NULL AND regexp_matches(value, '(?i)^\s{{4}}(get|post|put|patch|delete|options|head):\s*$')""")
def openapi_operations(spark: SparkSession, sf: str) -> DataFrame:
    """Operations of contracts made of the documents' sentences."""
    return scans.openapi_operations(contract_texts(spark, sf, "  /$1/{id}:", "    get:", "paths:"))


@query(rf"""WITH {contract_sql('  ' + chr(92) + '1.events:', 'x-end', 'channels:')}, inside AS (SELECT *, coalesce(last_value(CASE WHEN trim(value) = 'channels:' THEN true WHEN NOT regexp_matches(value, '^\s{{2}}([^\s:#][^:]*):\s*$') AND NOT starts_with(value, ' ') THEN false END IGNORE NULLS)
  OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS open FROM lines)
SELECT path, line, trim(regexp_extract(value, '^\s{{2}}([^\s:#][^:]*):\s*$', 1)) AS channel FROM inside WHERE open AND regexp_matches(value, '^\s{{2}}([^\s:#][^:]*):\s*$') AND trim(value) <> 'channels:'""")
def asyncapi_channels(spark: SparkSession, sf: str) -> DataFrame:
    """Channels of contracts made of the documents' sentences."""
    return scans.asyncapi_channels(contract_texts(spark, sf, "  $1.events:", "x-end", "channels:"))


@query("""SELECT doc_id, CASE WHEN len(l) < 2 THEN '' ELSE trim(array_to_string(l[2:4], chr(10))) END AS excerpt FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
def excerpt_range(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", files.excerpt(c("text"), F.lit(2), F.lit(4)).alias("excerpt"))


@query(f"WITH {LINES_SQL} SELECT doc_id, line, trim(replace(value, ';', '')) AS statement FROM lines WHERE starts_with(value, 'T')")
def import_statements(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that begin with T are written as imports first."""
    value = F.when(c("value").startswith("T"), F.concat(F.lit("  import "), c("value"), F.lit(";"))).otherwise(c("value"))
    return scans.import_statements(document_lines(spark, sf).withColumn("value", value)).select("doc_id", c("line").cast("long").alias("line"), "statement")


# Ids and names


@query("""SELECT o_orderkey, 'order:' || o_custkey || ':' || coalesce(o_orderpriority, '') AS node_id, 'edge:DECLARES:c' || o_custkey || ':o' || o_orderkey AS edge_id,
  sha256('order|' || o_orderkey || '|' || o_custkey || '|' || sha256('{"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}')) AS hashed FROM orders""")
def structural_ids(spark: SparkSession, sf: str) -> DataFrame:
    text = lambda name: c(name).cast("string")
    return table(spark, sf, "orders").select(
        "o_orderkey", fx.stable_id("order", c("o_custkey"), c("o_orderpriority")).alias("node_id"), fx.edge_id("DECLARES", F.concat(F.lit("c"), text("o_custkey")), F.concat(F.lit("o"), text("o_orderkey"))).alias("edge_id"),
        fx.hashed_id("order", text("o_orderkey"), text("o_custkey"), fx.canonical_json(status=c("o_orderstatus"), priority=c("o_orderpriority"))).alias("hashed"),
    )


@query(r"""WITH n AS (SELECT p_partkey, replace(replace(p_name, ' ', '-'), 'e', 'E') || ['Controller', 'ServiceImpl', 'Resource', 'Thing', 'FacadeService'][CAST(p_partkey % 5 + 1 AS INTEGER)] AS raw FROM part)
SELECT p_partkey, regexp_replace(lower(trim(translate(regexp_replace(raw, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '_-', '  '))), '\s+', '_', 'g') AS token,
  regexp_replace(raw, '^(.+?)(Controller|Service|Facade|Impl|Resource)+$', '\1') AS bare FROM n""")
def canonical_token(spark: SparkSession, sf: str) -> DataFrame:
    suffix = F.element_at(F.array(*map(F.lit, ("Controller", "ServiceImpl", "Resource", "Thing", "FacadeService"))), (c("p_partkey") % 5 + 1).cast("int"))
    raw = F.concat(F.translate("p_name", " e", "-E"), suffix)
    return table(spark, sf, "part").select("p_partkey", fx.canonical_token(raw).alias("token"), fx.strip_suffixes(raw).alias("bare"))


@query(r"""SELECT page_id, CASE WHEN trim(p) = '' THEN '/' ELSE regexp_replace('/' || trim(p), '/+', '/', 'g') END AS path,
  trim(regexp_replace(lower(p), '[^a-z0-9]+', '-', 'g'), '-') AS slug, upper(regexp_replace(p, '[^A-Z0-9_]', '_', 'g')) AS relationship
FROM (SELECT page_id, regexp_replace(url, '^https?:/*[^/]*', '') || '//x' AS p FROM pages)""")
def normalize_path(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.regexp_replace("url", "^https?:/*[^/]*", ""), F.lit("//x"))
    return table(spark, sf, "pages").select("page_id", fx.normalize_path(path).alias("path"), fx.slug(path).alias("slug"), fx.relationship_name(path).alias("relationship"))


@query("""SELECT event_id, CASE WHEN event_id % 4 < 2 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""")
def tolerant_json(spark: SparkSession, sf: str) -> DataFrame:
    """Properties as they are, in a fence, broken, and blank."""
    kind = c("event_id") % 4
    raw = F.when(kind == 0, c("props")).when(kind == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(kind == 2, F.concat(F.lit("{"), "props")).otherwise("  ")
    return table(spark, sf, "events").select("event_id", fx.tolerant_json(fx.unfenced(raw), "k long")["k"].alias("k"))


#: Words of the documents' texts and the code that method bodies made of them have in their place.
CODE_WORDS = {
    "the": "if ( x.{} == null)", "of": "requireNonNull(x.{}.id)", "and": "requireNonNull( {} ); y = {} == null;", "with": "throw new {}Exception (", "that": "throw new {}Error()", "in": "repo.save(", "und": "if ({}== null)", "die": "requireNonNull({})",
    "der": "orders.getById (", "das": "orders.getOne(", "que": "throw  new {}Exception(", "la": "if({} == null) return", "le": "em.persist (", "et": "repo.deleteBy(", "el": "list.remove(", "los": "cache.saveToDisk(",
}


def method_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, name, body): documents as commands; each of CODE_WORDS with the word after it is code."""
    body = F.col("text")
    for word, code in CODE_WORDS.items():
        body = F.regexp_replace(body, f" {word} ([a-z]+)", " " + code.replace("{}", "$1"))
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("Do"), c("doc_id").cast("string")).alias("name"), F.when(c("doc_id") % 50 == 0, "null").otherwise(body).alias("body"))


def _bodies_sql() -> str:
    body = "text"
    for word, code in CODE_WORDS.items():
        body = f"regexp_replace({body}, ' {word} ([a-z]+)', ' {code.replace('{}', chr(92) + '1')}', 'g')"
    named = {"null_checks": r"if\s*\(([\w.]+)\s*==\s*null", "required": r"requireNonNull\(([\w.]+)", "thrown": r"throw\s+new\s+(\w+Exception)\s*\(", "saves": r"\.(save|persist|saveAndFlush|saveAll)\s*\(",
             "finds": r"\.(findById|findBy|findAll|getById|getReferenceById)\s*\(", "deletes": r"\.(delete|remove|deleteById|deleteAll)\s*\("}
    found = ", ".join(f"regexp_extract_all(body, '{pattern}', 1) AS {name}" for name, pattern in named.items())
    once = ", ".join(f"list_filter({name}, lambda x, i: list_position({name}, x) = i) AS {name}" for name in named)
    return f"""WITH bodies AS (SELECT doc_id, 'Do' || doc_id AS name, CASE WHEN doc_id % 50 = 0 THEN 'null' ELSE {body} END AS body FROM documents),
found AS (SELECT doc_id, name, body, {found} FROM bodies), f AS (SELECT doc_id, name, body, {once} FROM found)"""


@query(_bodies_sql() + " SELECT doc_id, " + ", ".join(f"array_to_string({k}, ',') AS {k}" for k in fx.BODY_PATTERNS) + " FROM f")
def body_features(spark: SparkSession, sf: str) -> DataFrame:
    """What method bodies show that are made of the documents' texts."""
    return method_bodies(spark, sf).select("doc_id", *(F.array_join(v, ",").alias(k) for k, v in fx.body_features(c("body")).items()))


@query(_bodies_sql() + """, t AS (SELECT doc_id, name, body, list_concat(list_transform(null_checks, lambda x: 'Given ' || x || ' is provided'), list_transform(list_filter(required, lambda x: NOT list_contains(null_checks, x)), lambda x: 'Given ' || x || ' is not null'),
  CASE WHEN len(finds) > 0 THEN ['Given the record exists in the repository'] ELSE [] END) AS given,
  list_concat(list_transform(thrown, lambda x: 'Then throws ' || x), CASE WHEN len(saves) > 0 THEN ['Then the record is persisted'] ELSE [] END, CASE WHEN len(deletes) > 0 THEN ['Then the record is removed'] ELSE [] END) AS outcome FROM f)
SELECT doc_id, array_to_string(given, '|') AS given, 'When ' || name || ' is invoked' AS happens, CASE WHEN len(outcome) = 0 THEN 'Then the operation completes successfully' ELSE array_to_string(outcome, '|') END AS outcome
FROM t WHERE trim(body) <> '' AND body <> 'null' AND len(given) + len(outcome) > 0""")
def body_scenarios(spark: SparkSession, sf: str) -> DataFrame:
    """Scenarios of commands, from method bodies that are made of the documents' texts."""
    # A filter on the scenario would be moved below it and work it out a second time; an array without nulls is exploded as it is.
    found = method_bodies(spark, sf).select("doc_id", F.explode(F.filter(F.array(fx.body_scenario(c("name"), c("body"))), lambda s: s.isNotNull())).alias("s"))
    return found.select("doc_id", F.array_join("s.given", "|").alias("given"), F.array_join("s.when", "|").alias("happens"), F.array_join("s.then", "|").alias("outcome"))


@query("""SELECT o_custkey AS owner, string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey) AS refs FROM orders GROUP BY 1""")
def grouped_refs(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import code

    refs = code.grouped_refs(table(spark, sf, "orders").select(c("o_custkey").alias("owner"), "o_orderkey", "o_orderstatus"), "owner", "o_orderkey", ["o_orderstatus"])
    return refs.select("owner", F.array_join(F.transform("refs", lambda r: F.concat_ws(":", r["o_orderkey"].cast("string"), r["o_orderstatus"])), ",").alias("refs"))


@query("""SELECT p_partkey, CASE WHEN p_size < 10 THEN 100 ELSE p_size END AS page_size, coalesce(nullif(p_type, 'PROMO'), 'AT_LEAST_ONCE') AS delivery, 500 AS batch FROM part""")
def filled_defaults(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import code

    specs = table(spark, sf, "part").select("p_partkey", F.when(c("p_size") >= 10, c("p_size")).cast("long").alias("page_size"), F.when(c("p_type") != "PROMO", c("p_type")).alias("delivery"))
    return code.filled_defaults(specs, {"page_size": F.lit(100).cast("long"), "delivery": F.lit("AT_LEAST_ONCE"), "batch": F.lit(500)})


# Validation, confidence, drift, migration


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 200000 THEN 'blocked' WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderpriority LIKE '1%' THEN 'urgent' WHEN o_totalprice < 1000 THEN 'small' ELSE 'healthy' END AS verdict,
  CASE WHEN o_orderstatus <> 'O' THEN 'CONFIRMED' WHEN o_totalprice > 100000 THEN 'PARTIAL' ELSE 'MISSING' END AS backed FROM orders""")
def classify_case(spark: SparkSession, sf: str) -> DataFrame:
    verdict = runs.decision([((c("o_orderstatus") == "F") & (c("o_totalprice") > 200000), "blocked"), (c("o_orderstatus") == "P", "pending"), (c("o_orderpriority").startswith("1"), "urgent"), (c("o_totalprice") < 1000, "small")], "healthy")
    return table(spark, sf, "orders").select("o_orderkey", verdict.alias("verdict"), document.runtime_backed(c("o_orderstatus") == "O", F.lit(False), c("o_totalprice") > 100000).alias("backed"))


REPORT_SQL = """report AS (SELECT source AS scope, lang AS domain, CASE WHEN count(quality) * 10 >= count(*) * 4 THEN 'CONFIRMED' WHEN count(quality) > 0 THEN 'PARTIAL' ELSE 'MISSING' END AS status, count(*) - count(quality) AS missing
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2)"""


def coverage(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    counted = docs.groupBy(c("source").alias("scope"), c("lang").alias("domain")).agg(F.count("*").alias("n"), F.count("quality").alias("k"))
    return counted.select("scope", "domain", F.when(c("k") * 10 >= c("n") * 4, "CONFIRMED").when(c("k") > 0, "PARTIAL").otherwise("MISSING").alias("status"), (c("n") - c("k")).alias("missing"))


@query("""WITH f AS (SELECT count(*) > 0 AS found, bool_or(o_orderstatus = 'F') AS f, bool_or(o_orderstatus = 'X') AS x, max(o_totalprice) > 0 AS paid FROM orders)
SELECT unnest(['BUILD', 'TYPES', 'METHOD_BODIES', 'CALL_GRAPH', 'SPRING_BEANS', 'HTTP', 'JPA', 'VALIDATION', 'SECURITY']) AS domain,
  unnest([CASE WHEN found THEN 'CONFIRMED' ELSE 'MISSING' END, CASE WHEN x THEN 'CONFIRMED' ELSE 'MISSING' END, CASE WHEN f THEN 'CONFIRMED' ELSE 'PARTIAL' END, CASE WHEN x THEN 'CONFIRMED' ELSE 'PARTIAL' END,
    CASE WHEN paid THEN 'PARTIAL' ELSE 'MISSING' END, CASE WHEN x THEN 'PARTIAL' ELSE 'MISSING' END, 'CONFIRMED', CASE WHEN f THEN 'PARTIAL' ELSE 'MISSING' END, 'CONFIRMED']) AS status FROM f""")
def confidence_report(spark: SparkSession, sf: str) -> DataFrame:
    """A system that wasn't booted: what it asks for is partial where evidence was merged, else missing; what it doesn't ask for is confirmed."""
    status = c("o_orderstatus")
    facts = table(spark, sf, "orders").agg((F.count("*") > 0).alias("some"), F.bool_or(status == "F").alias("f"), F.bool_or(status == "X").alias("x"), (F.max("o_totalprice") > 0).alias("paid"))
    yes, no = F.lit(True), F.lit(False)
    flags = {"built": c("some"), "types": c("x"), "bodies": c("f"), "call_graph": c("x"), "booted": no, "spring": yes, "web_mvc": no, "web_flux": yes, "jpa": no, "validation": yes, "security": no}
    flags |= {"has_spring_beans": c("paid"), "has_http": c("x"), "has_jpa": yes, "has_validation": c("f"), "has_security": no}
    return document.confidence_report(facts.select(*(v.alias(k) for k, v in flags.items())))


@query(f"""WITH {REPORT_SQL}, wanted AS (SELECT DISTINCT scope, unnest(['en', 'fr', 'de', 'es']) AS domain FROM report)
SELECT w.scope, round(any_value(s.score), 6) AS score, bool_and(coalesce(r.status = 'CONFIRMED', false)) AS trusted FROM wanted w LEFT JOIN report r USING (scope, domain)
JOIN (SELECT scope, avg(CASE WHEN status = 'CONFIRMED' THEN 1.0 ELSE 0.0 END) AS score FROM report GROUP BY 1) s ON s.scope = w.scope GROUP BY w.scope""")
def confidence_score(spark: SparkSession, sf: str) -> DataFrame:
    report = coverage(spark, sf)
    wanted = report.select("scope").distinct().withColumn("domain", F.explode(F.array(*map(F.lit, ("en", "fr", "de", "es")))))
    scores = document.confidence_score(report, ["scope"])
    return scores.join(document.trust(report, wanted, ["scope"]), "scope").select("scope", F.round("score", 6).alias("score"), "trusted")


@query(f"""WITH {REPORT_SQL} SELECT DISTINCT CASE WHEN missing > 3 THEN domain || ' misses ' || missing ELSE scope || ' incomplete' END AS warning FROM report WHERE status <> 'CONFIRMED'""")
def warnings(spark: SparkSession, sf: str) -> DataFrame:
    details = F.when(c("missing") > 3, F.array(F.concat_ws(" ", "domain", F.lit("misses"), c("missing").cast("string")))).otherwise(F.array().cast("array<string>"))
    return document.warnings(coverage(spark, sf).withColumn("details", details).withColumn("summary", F.concat_ws(" ", "scope", F.lit("incomplete"))))


@query("""SELECT a.adapter, count(event_id) AS node_count, count(DISTINCT user_id) AS edge_count, CASE WHEN count(event_id) = 0 THEN 'SKIPPED' ELSE 'COLLECTED' END AS status
FROM (SELECT unnest(['click', 'view', 'purchase', 'signup', 'error', 'refund']) AS adapter) a LEFT JOIN events ON event_type = adapter GROUP BY 1""")
def adapter_report(spark: SparkSession, sf: str) -> DataFrame:
    from .snapshot import Evidence
    from .snapshot import adapter_report as report

    events = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    found = {k: Evidence(e := events.filter(c("event_type") == k), e.select("user_id").distinct(), e.limit(0)) for k in ("click", "view", "purchase", "signup", "error", "refund")}
    return report(spark, found)


@query("""SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1""")
def duplicate_ids(spark: SparkSession, sf: str) -> DataFrame:
    return merge.duplicate_keys(table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h")), ["h"], "doc_id").select("doc_id")


@query("""WITH f AS (SELECT user_id, arg_min(event_type, event_id) AS first_literal FROM events GROUP BY 1) SELECT event_id, user_id, event_type, first_literal FROM events JOIN f USING (user_id) WHERE event_type <> first_literal""")
def conflicting_literals(spark: SparkSession, sf: str) -> DataFrame:
    return merge.conflicting_literals(table(spark, sf, "events").select("event_id", "user_id", "event_type"), ["user_id"], "event_type", "event_id").select("event_id", "user_id", "event_type", "first_literal")


@query(r"""WITH types AS (SELECT 't' || c_custkey AS id,
    ['OrderLine', 'AbstractOrder', 'OrderMapper', 'ShipHook', 'User', 'RefundPolicy'][CAST(c_custkey % 6 + 1 AS INTEGER)] || CASE WHEN c_custkey % 6 IN (0, 3, 4) THEN CAST(c_custkey % 500 AS VARCHAR) ELSE '' END || ['Service', 'Controller', ''][CAST(c_custkey % 3 + 1 AS INTEGER)] AS name,
    CASE WHEN c_custkey % 11 = 0 THEN 'interface' WHEN c_custkey % 13 = 0 THEN 'enum' ELSE 'class' END AS kind,
    CASE c_custkey % 4 WHEN 0 THEN [] WHEN 1 THEN ['Service'] WHEN 2 THEN ['Entity'] ELSE ['Old', 'Component'] END AS marks FROM customer),
calls AS (SELECT 'm' || o_orderkey AS id, 't' || o_custkey AS type_id, ['getName', 'submitAll', 'hookUp', 'setName'][CAST(o_orderkey % 4 + 1 AS INTEGER)] AS name, o_orderkey % 2 AS arity FROM orders),
acts AS (SELECT * FROM calls WHERE NOT (name = 'getName' AND arity = 0) AND NOT (name = 'setName' AND arity = 1)),
told AS (SELECT *, regexp_replace(name, '(Service|Controller)$', '') AS bare, lower(regexp_replace(bare, '([a-z0-9])([A-Z])', '\1_\2', 'g')) AS token,
  kind = 'enum' OR starts_with(name, 'Abstract') OR ends_with(name, 'Mapper') OR ends_with(bare, 'Policy') OR (kind = 'interface' AND len(marks) = 0) AS skipped FROM types),
approved AS (SELECT DISTINCT 'order_line' || (c_custkey % 500) AS token FROM customer WHERE c_acctbal > 5000),
live AS (SELECT * FROM told WHERE name NOT IN (SELECT name FROM told WHERE skipped) AND len(marks) > 0 AND (list_contains(marks, 'Entity') OR id IN (SELECT type_id FROM acts))),
lost AS (SELECT * FROM live WHERE token NOT IN (FROM approved)),
found AS (SELECT CASE WHEN contains(lower(name), 'hook') THEN 'HANDWRITTEN_HOOK' ELSE 'UNSUPPORTED_HANDWRITTEN' END AS kind, 'type' AS what, id AS subject FROM lost
UNION ALL SELECT CASE WHEN contains(lower(acts.name), 'hook') THEN 'HANDWRITTEN_HOOK' ELSE 'UNSUPPORTED_HANDWRITTEN' END, 'method', acts.id FROM acts JOIN lost ON lost.id = acts.type_id WHERE NOT (token LIKE 'user1%' AND acts.name = 'submitAll')
UNION ALL SELECT 'SPEC_OWNED', 'aggregate', '/' || token FROM approved WHERE token NOT IN (SELECT token FROM told WHERE NOT skipped))
SELECT *, kind <> 'HANDWRITTEN_HOOK' AS blocking FROM found""")
def drift_report(spark: SparkSession, sf: str) -> DataFrame:
    key = c("c_custkey")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    number = F.when((key % 6).isin(0, 3, 4), (key % 500).cast("string")).otherwise("")
    marks = F.when(key % 4 == 0, F.array().cast("array<string>")).when(key % 4 == 1, F.array(F.lit("Service"))).when(key % 4 == 2, F.array(F.lit("Entity"))).otherwise(F.array(F.lit("Old"), F.lit("Component")))
    types = table(spark, sf, "customer").select(
        F.concat(F.lit("t"), key.cast("string")).alias("id"), F.concat(pick(("OrderLine", "AbstractOrder", "OrderMapper", "ShipHook", "User", "RefundPolicy"), key % 6), number, pick(("Service", "Controller", ""), key % 3)).alias("name"),
        F.when(key % 11 == 0, "interface").when(key % 13 == 0, "enum").otherwise("class").alias("kind"), marks.alias("annotations"),
    )
    approved = table(spark, sf, "customer").filter("c_acctbal > 5000").select(F.concat(F.lit("orderLine"), (key % 500).cast("string")).alias("name")).distinct().withColumn("path", F.concat(F.lit("/order_line"), F.substr("name", F.lit(10))))
    methods = table(spark, sf, "orders").select(F.concat(F.lit("m"), c("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("t"), c("o_custkey").cast("string")).alias("type_id"), pick(("getName", "submitAll", "hookUp", "setName"), c("o_orderkey") % 4).alias("name"), (c("o_orderkey") % 2).alias("arity"))
    commands = table(spark, sf, "customer").select(F.concat(F.lit("User"), (key % 500).cast("string")).alias("aggregate")).filter("aggregate LIKE 'User1%'").distinct().withColumn("name", F.lit("submit_all"))
    return compare.drift_report(types, methods, approved, commands)


STEPS = [
    {"column": "p_brand", "old": "Brand#11", "new": "Brand#99", "scope": ("p_type", "ECONOMY")},
    {"column": "p_brand", "old": "Brand#12", "new": "Brand#11"},
    {"column": "p_type", "old": "PROMO", "new": "SPECIAL", "scope": ("p_brand", "brand#11")},
    {"column": "p_brand", "old": "Brand#99", "new": "Brand#12"},
]
_SAME = """WITH a AS (SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' AND lower(p_type) = 'economy' THEN 'Brand#99' ELSE p_brand END AS p_brand, p_type FROM part),
b AS (SELECT p_partkey, CASE WHEN p_brand = 'Brand#12' THEN 'Brand#11' ELSE p_brand END AS p_brand, p_type FROM a),
d AS (SELECT p_partkey, p_brand, CASE WHEN p_type = 'PROMO' AND lower(p_brand) = 'brand#11' THEN 'SPECIAL' ELSE p_type END AS p_type FROM b)"""


@query(f"{_SAME} SELECT p_partkey, CASE WHEN p_brand = 'Brand#99' THEN 'Brand#12' ELSE p_brand END AS p_brand, p_type FROM d")
def migrate_rename(spark: SparkSession, sf: str) -> DataFrame:
    return compare.migrate(table(spark, sf, "part").select("p_partkey", "p_brand", "p_type"), STEPS)


@query(f"""{_SAME} SELECT 0 AS step, count(*) FILTER (WHERE p_brand = 'Brand#11' AND lower(p_type) = 'economy') AS matches FROM part UNION ALL SELECT 1, count(*) FILTER (WHERE p_brand = 'Brand#12') FROM a
UNION ALL SELECT 2, count(*) FILTER (WHERE p_type = 'PROMO' AND lower(p_brand) = 'brand#11') FROM b UNION ALL SELECT 3, count(*) FILTER (WHERE p_brand = 'Brand#99') FROM d""")
def migrate_actions(spark: SparkSession, sf: str) -> DataFrame:
    return compare.migration_actions(table(spark, sf, "part").select("p_partkey", "p_brand", "p_type"), STEPS)


@query("""SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_returnflag = 'R' AND (l_discount > 0.05 OR l_linestatus != 'O')""")
def rule_filter(spark: SparkSession, sf: str) -> DataFrame:
    return compare.rule_filter(table(spark, sf, "lineitem"), "l_quantity >= 10 && l_returnflag == \"R\" && (l_discount > 0.05 || l_linestatus != 'O')").select("l_orderkey", "l_partkey", "l_quantity")


# Ranking and runs


@query("""WITH n AS (SELECT 'n' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS id, n_name AS label, count(*) FILTER (WHERE o_orderstatus = 'F') AS blocking, count(*) FILTER (WHERE o_totalprice > 300000) AS warning
  FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2), l AS (SELECT id, 'blocking' AS measure, blocking AS count, label FROM n UNION ALL SELECT id, 'warning', warning, label FROM n)
SELECT id, measure, count, row_number() OVER (PARTITION BY measure ORDER BY count DESC, label, id) AS place FROM l WHERE count > 0 QUALIFY place <= 6""")
def hotspots_topk(spark: SparkSession, sf: str) -> DataFrame:
    by_customer = table(spark, sf, "orders").groupBy(c("o_custkey").alias("c_custkey")).agg(F.count_if(c("o_orderstatus") == "F").alias("b"), F.count_if(c("o_totalprice") > 300000).alias("w"))
    rows = by_customer.join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey").groupBy(c("c_nationkey").alias("n_nationkey")).agg(F.sum("b").alias("blocking"), F.sum("w").alias("warning")).join(table(spark, sf, "nation"), "n_nationkey")
    rows = rows.select(F.concat(F.lit("n"), F.lpad(c("n_nationkey").cast("string"), 3, "0")).alias("id"), c("n_name").alias("label"), "blocking", "warning")
    return runs.hotspots(rows, ["blocking", "warning"]).select("id", "measure", "count", c("place").cast("long").alias("place"))


#: Documents taken for evidence nodes of ten kinds.
NODES_SQL = """n AS (SELECT 'd' || doc_id AS id, doc_id AS ordinal, coalesce(source, 'none') || CASE doc_id % 3 WHEN 0 THEN ' flow' WHEN 1 THEN ' scenario' ELSE '' END AS label, lang,
    ['project', 'documentation-section', 'http-endpoint', 'contract-channel', 'nightly-job', 'persistence-entity', 'database-migration', 'integration-config', 'validation-constraint', 'security-constraint'][CAST(doc_id % 10 + 1 AS INTEGER)] AS kind FROM documents),
faces AS (SELECT *, CASE kind WHEN 'http-endpoint' THEN 'http' WHEN 'contract-channel' THEN 'async' ELSE 'jobs' END AS surface FROM n WHERE kind IN ('http-endpoint', 'contract-channel', 'nightly-job')),
ops AS (SELECT *, CAST(CASE surface WHEN 'http' THEN 1 WHEN 'async' THEN 2 ELSE 3 END AS BIGINT) * 1000000000 + row_number() OVER (PARTITION BY surface ORDER BY label, ordinal) AS spot FROM faces),
doc AS (SELECT * FROM n WHERE kind = 'documentation-section')"""


@query(f"""WITH {NODES_SQL},
head AS (SELECT coalesce((SELECT arg_min(label, ordinal) FROM n WHERE kind = 'project'), 'service') AS name, coalesce((SELECT arg_min(label, ordinal) FROM doc), 'Semantic draft synthesized from deterministic evidence') AS summary),
root AS (SELECT 'service:' || name AS root FROM head)
SELECT 'service:' || name AS id, 'service' AS kind, NULL AS parent_id, name, summary, 'CONFIRMED' AS confidence_level, 0 AS ordinal FROM head
UNION ALL SELECT DISTINCT 'interface:' || surface, 'interface', root, CASE surface WHEN 'http' THEN 'HTTP Surface' WHEN 'async' THEN 'Async Messaging' ELSE 'Background Jobs' END, surface, 'CONFIRMED', CASE surface WHEN 'http' THEN 1 WHEN 'async' THEN 2 ELSE 3 END FROM faces, root
UNION ALL SELECT 'operation:' || id, 'operation', 'interface:' || surface, label, surface, 'CONFIRMED', spot FROM ops
UNION ALL SELECT 'scenario:operation:' || id, 'scenario', root, label, 'operation', 'PARTIAL', spot FROM ops, root
UNION ALL SELECT 'datastore:primary', 'datastore', any_value(root), 'Primary Relational Store', CASE WHEN bool_or(kind = 'database-migration' AND lang = 'fr') THEN 'flyway-relational' ELSE 'liquibase-relational' END, 'CONFIRMED', 0 FROM n, root WHERE kind IN ('persistence-entity', 'database-migration')
UNION ALL SELECT 'integration:' || lang, 'integration', any_value(root), upper(lang), string_agg(label, ',' ORDER BY label), 'PARTIAL', min(ordinal) FROM n, root WHERE kind = 'integration-config' GROUP BY lang
UNION ALL SELECT 'workflow:' || id, 'workflow', root, label, 'execution', 'CONFIRMED', ordinal FROM n, root WHERE kind = 'nightly-job'
UNION ALL SELECT 'workflow:' || id, 'workflow', root, label, 'documentation', 'PARTIAL', 1000000000 + ordinal FROM doc, root WHERE ends_with(label, ' flow')
UNION ALL SELECT 'rule:' || id, 'rule', root, label, CASE WHEN lang = 'en' THEN 'x > 1' WHEN kind = 'validation-constraint' THEN 'Validation rule' ELSE 'Security rule' END, 'CONFIRMED', ordinal FROM n, root WHERE kind IN ('validation-constraint', 'security-constraint')
UNION ALL SELECT 'scenario:' || id, 'scenario', root, label, 'documentation', 'PARTIAL', 10000000000 + ordinal FROM doc, root WHERE ends_with(label, ' scenario')
UNION ALL (SELECT 'note:' || id, 'note', root, label, 'documentation', 'PARTIAL', ordinal FROM doc, root ORDER BY label, ordinal LIMIT 5)""")
def synthesized_items(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence nodes made into a service with interfaces, store, integrations, workflows, rules, scenarios and the first five notes."""
    return document.synthesize(spark, *evidence_nodes(spark, sf))[0]


def evidence_nodes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, refs) of NODES_SQL."""
    key = c("doc_id")
    kinds = ("project", "documentation-section", "http-endpoint", "contract-channel", "nightly-job", "persistence-entity", "database-migration", "integration-config", "validation-constraint", "security-constraint")
    attributes = F.map_filter(F.create_map(F.lit("keyword"), c("lang"), F.lit("tool"), F.when(c("lang") == "fr", "Flyway"), F.lit("expression"), F.when(c("lang") == "en", "x > 1")), lambda k, v: v.isNotNull())
    nodes = table(spark, sf, "documents").select(
        F.concat(F.lit("d"), key.cast("string")).alias("id"), key.alias("ordinal"), F.element_at(F.array(*map(F.lit, kinds)), (key % 10 + 1).cast("int")).alias("kind"),
        F.concat(F.coalesce("source", F.lit("none")), F.when(key % 3 == 0, " flow").when(key % 3 == 1, " scenario").otherwise("")).alias("label"), attributes.alias("attributes"),
    )
    return nodes, nodes.select(c("id").alias("owner_id"), F.lit("file").alias("file"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), "ordinal")


@query("""WITH a AS (SELECT '0:' || p_type || ':' || p_name AS place, p_type || ' ' || p_name || ' ' || p_brand AS text FROM part WHERE p_type IN ('PROMO', 'SMALL') ORDER BY p_type, p_name, lpad(CAST(p_partkey AS VARCHAR), 12, '0') LIMIT 12),
b AS (SELECT '1:' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS place, text FROM documents WHERE regexp_matches(text, '\\S') ORDER BY doc_id LIMIT 12) FROM a UNION ALL FROM b""")
def kind_sorted_limit(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "part").select(F.lpad(c("p_partkey").cast("string"), 12, "0").alias("id"), c("p_type").alias("kind"), c("p_name").alias("label"), c("p_brand").alias("path"))
    refs = table(spark, sf, "documents").select(c("doc_id").alias("ordinal"), c("text").alias("excerpt"))
    return retrieval.evidence_context(nodes, refs, ["PROMO", "SMALL"], 12)


@query("""SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def latest_run_per_kind(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return runs.latest_per_key(rows, ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


STAGE_SQL = """stages AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ordinal, event_id,
  CASE event_type WHEN 'purchase' THEN 'SUCCEEDED' WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'SKIPPED' WHEN 'signup' THEN 'RUNNING' ELSE 'PENDING' END AS status FROM events)"""


def stages(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    status = F.when(c("event_type") == "purchase", "SUCCEEDED").when(c("event_type") == "error", "FAILED").when(c("event_type") == "view", "SKIPPED").when(c("event_type") == "signup", "RUNNING").otherwise("PENDING")
    return table(spark, sf, "events").select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("ordinal"), "event_id", status.alias("status"))


@query(f"""WITH {STAGE_SQL} SELECT user_id, count(*) FILTER (WHERE status = 'SUCCEEDED') AS done, count(*) FILTER (WHERE status <> 'SKIPPED') AS total, coalesce(min(ordinal) FILTER (WHERE status = 'RUNNING'), -1) AS active FROM stages GROUP BY 1""")
def run_progress(spark: SparkSession, sf: str) -> DataFrame:
    return runs.progress(stages(spark, sf), "user_id", "status", "ordinal")


@query(f"""WITH {STAGE_SQL} SELECT user_id, coalesce(min(event_id) FILTER (WHERE status = 'RUNNING'), min(event_id) FILTER (WHERE status = 'FAILED'), max(event_id) FILTER (WHERE status = 'SUCCEEDED')) AS current FROM stages GROUP BY 1""")
def current_stage(spark: SparkSession, sf: str) -> DataFrame:
    own, status = c("event_id"), c("status")
    at = lambda kind: F.when(status == kind, own)
    return stages(spark, sf).groupBy("user_id").agg(F.coalesce(F.min(at("RUNNING")), F.min(at("FAILED")), F.max(at("SUCCEEDED"))).alias("current"))


@query("""WITH f AS (SELECT user_id, bool_or(event_type = 'signup' AND event_id % 11 = 0) AS running, bool_or(event_type = 'error' AND event_id % 5 = 0) AS failed, count(*) > 20 AS evidence, avg(value) > 50 AS trusted,
  bool_or(event_type = 'purchase') AS spec, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) > 6 AS approved, user_id % 2 = 0 AS graph_on, user_id % 3 = 0 AS graph, user_id % 5 = 0 AS answered FROM events GROUP BY 1)
SELECT user_id, 'evidence' AS stage, CASE WHEN running THEN 'running' WHEN NOT evidence THEN 'pending' WHEN failed THEN 'blocked' WHEN NOT trusted THEN 'needs-review' ELSE 'healthy' END AS status FROM f
UNION ALL SELECT user_id, 'spec', CASE WHEN NOT evidence THEN 'not-loaded' WHEN running THEN 'running' WHEN NOT spec THEN 'pending' WHEN NOT approved THEN 'needs-review' ELSE 'healthy' END FROM f
UNION ALL SELECT user_id, 'graph', CASE WHEN NOT graph_on THEN 'not-loaded' WHEN NOT approved THEN 'blocked' WHEN NOT graph THEN 'pending' ELSE 'healthy' END FROM f
UNION ALL SELECT user_id, 'ask', CASE WHEN NOT approved THEN 'blocked' WHEN answered THEN 'healthy' ELSE 'pending' END FROM f""")
def stage_status(spark: SparkSession, sf: str) -> DataFrame:
    kind = c("event_type")
    facts = table(spark, sf, "events").groupBy("user_id").agg(
        F.bool_or((kind == "signup") & (c("event_id") % 11 == 0)).alias("running"), F.bool_or((kind == "error") & (c("event_id") % 5 == 0)).alias("failed"), (F.count("*") > 20).alias("evidence"), (F.avg("value") > 50).alias("trusted"),
        F.bool_or(kind == "purchase").alias("spec"), (F.count_if(kind == "purchase") > 6).alias("approved"),
    )
    facts = facts.withColumn("graph_on", c("user_id") % 2 == 0).withColumn("graph", c("user_id") % 3 == 0).withColumn("answered", c("user_id") % 5 == 0)
    return runs.stage_matrix(facts, "user_id")


@query("""SELECT user_id, max(ts) AS ts, arg_max(event_type, ts) AS event_type, arg_max(event_id, ts) AS event_id FROM events GROUP BY 1""")
def stage_progress_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The latest event per user, kept by a stream over the events' files that drains what is there; equal to the batch form."""
    from ..streaming import runs as live

    source = table(spark, sf, "events")
    base = files.temporary(spark, "states")
    live.upsert_stream(live.run_events(spark, f"{sf}/events.parquet", source.schema), f"{base}/log", ["user_id"], "ts", f"{base}/progress").awaitTermination()
    log = live.StateLog(spark, f"{base}/log", source.schema, ["user_id"], "ts")
    log.compact()
    return log.latest().select("user_id", "ts", "event_type", "event_id")


@query("""WITH e AS (SELECT *, lag(ts) OVER w AS before, lag(event_type) OVER w AS was FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(CASE WHEN before IS NULL OR was IN ('purchase', 'error') OR ts - before > INTERVAL 36 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM e),
g AS (SELECT user_id, run, min(ts) AS started, max(ts) AS last, count(*) AS n, arg_max(event_type, ts) AS final FROM r GROUP BY 1, 2),
s AS (SELECT *, CASE final WHEN 'purchase' THEN 'SUCCEEDED' WHEN 'error' THEN 'FAILED' WHEN NULL THEN NULL ELSE 'TIMED_OUT' END AS status, run < max(run) OVER (PARTITION BY user_id) AS over FROM g)
SELECT user_id, CAST(run AS BIGINT) AS run, started, CASE status WHEN 'TIMED_OUT' THEN last + INTERVAL 36 HOUR ELSE last END AS ended, status, n FROM s
WHERE status <> 'TIMED_OUT' OR over OR last + INTERVAL 36 HOUR < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def ended_runs_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Users' runs of events that a purchase or an error ends, or 36 hours of silence: keyed state with a watermark and timers, equal to the batch form."""
    from ..streaming import runs as live

    source = table(spark, sf, "events")
    kind = F.when(c("event_type") == "purchase", "SUCCEEDED").when(c("event_type") == "error", "FAILED").otherwise("RUNNING")
    events = live.run_events(spark, f"{sf}/events.parquet", source.schema).select(c("user_id").alias("key"), c("ts").cast("timestamp").alias("at"), kind.alias("status"))
    base = files.temporary(spark, "ended")
    found = live.ended_runs(events, 36 * 3600, "1 hour")
    live.append_stream(found, f"{base}/runs", f"{base}/progress").awaitTermination()
    ended = spark.read.schema(found.schema).parquet(f"{base}/runs")
    return ended.select(c("key").alias("user_id"), "run", *(c(name).cast(source.schema["ts"].dataType).alias(name) for name in ("started", "ended")), "status", "n")


# Code models


@query("""WITH cp AS (SELECT p_partkey % 7 AS scope, lower(p_name) AS entry FROM part), src AS (SELECT doc_id % 7 AS scope, text FROM documents),
a AS (SELECT scope, bool_or(contains(entry, 'red') OR contains(entry, 'rod')) AS spring, bool_or(contains(entry, 'blue plate')) AND scope > 3 AS boot0, bool_or(contains(entry, 'zzz')) AS jpa FROM cp GROUP BY 1),
b AS (SELECT scope, bool_or(contains(text, 'idiot')) AS spring2, bool_or(contains(text, 'token =')) AS jpa2 FROM src GROUP BY 1)
SELECT scope, spring OR (NOT boot AND spring2) AS spring, boot, jpa OR (NOT boot AND jpa2) AS jpa FROM (SELECT *, coalesce(boot0, false) AS boot FROM a) JOIN b USING (scope)""")
def capability_flags(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import code

    classpath = table(spark, sf, "part").select((c("p_partkey") % 7).alias("scope"), F.when((c("p_name") == "blue plate") & (c("p_partkey") % 7 <= 3), "-").otherwise(c("p_name")).alias("entry"))
    sources = table(spark, sf, "documents").select((c("doc_id") % 7).alias("scope"), "text")
    return code.capabilities(classpath, sources, ["scope"], {"spring": ("red", "rod"), "boot": ("blue plate",), "jpa": ("zzz",)}, {"spring": ("idiot",), "jpa": ("token =",)})


@query("""SELECT count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'refund') AS refund, count(*) FILTER (WHERE value > 50) AS high FROM events""")
def kind_counts(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import code

    return code.kind_counts(table(spark, sf, "events"), "event_type", ["click", "error", "refund"], {"high": c("value") > 50})


@query("""WITH l AS (SELECT o_orderkey, o_custkey, generate_subscripts([o_custkey * 3 % 1700, o_custkey * 5 % 1700, o_custkey], 1) AS pos, unnest([o_custkey * 3 % 1700, o_custkey * 5 % 1700, o_custkey]) AS id FROM orders),
f AS (SELECT o_orderkey, arg_min(c_name, pos) AS c_name FROM l JOIN customer ON c_custkey = id WHERE c_acctbal > 3000 GROUP BY 1)
SELECT o_orderkey, c_name FROM orders LEFT JOIN f USING (o_orderkey)""")
def first_resolvable(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import code

    lists = table(spark, sf, "orders").select("o_orderkey", F.array(c("o_custkey") * 3 % 1700, c("o_custkey") * 5 % 1700, c("o_custkey")).alias("ids"))
    known = table(spark, sf, "customer").filter("c_acctbal > 3000").select(c("c_custkey").alias("id"), "c_name")
    return code.first_resolvable(lists, "o_orderkey", "ids", known, "id", "c_name")


@query("""SELECT r_name AS top, n_name AS middle, c_name AS bottom FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey""")
def topology_chain(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import code

    nations = table(spark, sf, "nation")
    upper = nations.join(table(spark, sf, "region"), c("n_regionkey") == c("r_regionkey")).select(c("r_name").alias("source"), c("n_name").alias("target"), F.lit("A").alias("kind"))
    lower = nations.join(table(spark, sf, "customer"), c("n_nationkey") == c("c_nationkey")).select(c("n_name").alias("source"), c("c_name").alias("target"), F.lit("B").alias("kind"))
    return code.chained(upper.unionByName(lower), "A", "B")


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderkey) AS number FROM orders""")
def running_numbers(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import code

    return code.running_numbers(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_custkey"], "o_orderstatus", "o_orderkey").select("o_orderkey", c("number").cast("long").alias("number"))


@query(r"""WITH e AS (SELECT 'Thing' || (c_custkey % 40) || ['', 'Service'][CAST(c_custkey % 2 + 1 AS INTEGER)] AS type_name FROM customer),
p AS (SELECT CASE WHEN o_orderkey % 5 > 0 THEN 'Thing' || (o_custkey % 60) || 'Controller' END AS owner_name, '/orders/{id}/' || lower(o_orderstatus) AS full_path, ['GET', 'POST', 'PUT'][CAST(o_orderkey % 3 + 1 AS INTEGER)] AS http_method FROM orders),
a AS (SELECT regexp_replace(type_name, '^(.+?)(Controller|Service|Facade|Impl|Resource)+$', '\1') AS aggregate, count(*) AS n FROM e GROUP BY 1),
b AS (SELECT coalesce(regexp_replace(owner_name, '^(.+?)(Controller|Service|Facade|Impl|Resource)+$', '\1'), 'Orders') AS aggregate, string_agg(DISTINCT http_method || ' ' || split_part(full_path, '/', 4), ',' ORDER BY http_method || ' ' || split_part(full_path, '/', 4)) AS commands FROM p WHERE http_method <> 'GET' GROUP BY 1)
SELECT coalesce(a.aggregate, b.aggregate) AS aggregate, coalesce(n, 0) AS n_entities, coalesce(commands, '') AS commands FROM a FULL JOIN b ON a.aggregate = b.aggregate""")
def draft_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import code

    key = c("c_custkey")
    entities = table(spark, sf, "customer").select(F.concat(F.lit("Thing"), (key % 40).cast("string"), F.when(key % 2 == 1, "Service").otherwise("")).alias("type_name"))
    verbs = F.element_at(F.array(*map(F.lit, ("GET", "POST", "PUT"))), (c("o_orderkey") % 3 + 1).cast("int"))
    owner = F.when(c("o_orderkey") % 5 > 0, F.concat(F.lit("Thing"), (c("o_custkey") % 60).cast("string"), F.lit("Controller")))
    endpoints = table(spark, sf, "orders").select(owner.alias("owner_name"), F.concat(F.lit("/orders/{id}/"), F.lower("o_orderstatus")).alias("full_path"), verbs.alias("http_method"))
    return code.draft_aggregates(entities, endpoints)


@query("""SELECT p_brand AS entity, string_agg('c_' || p_partkey || ' ' || CASE p_type WHEN 'PROMO' THEN 'uuid' WHEN 'SMALL' THEN 'integer' ELSE 'varchar(255)' END || CASE WHEN p_size < 5 THEN ' primary key' ELSE '' END, ', ' ORDER BY p_partkey) AS ddl FROM part GROUP BY 1""")
def column_list(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import code

    spec = F.when(c("p_type") == "PROMO", "UUID").when(c("p_type") == "SMALL", "int").otherwise("x")
    fields = table(spark, sf, "part").select(c("p_brand").alias("entity"), F.concat(F.lit("c_"), c("p_partkey").cast("string")).alias("name"), spec.alias("spec"), (c("p_size") < 5).alias("pk"), c("p_partkey").alias("at"))
    return code.column_list(fields, "entity", "name", "spec", "pk", "at")


@query("""SELECT n_nationkey, 'region/' || lower(r_name) || '/' || lower(n_name) AS raw, regexp_replace(lower(trim(translate(r_name, '_-', '  '))), '\\s+', '_', 'g') || '/' || regexp_replace(lower(trim(translate(n_name, '_-', '  '))), '\\s+', '_', 'g') AS canonical_path,
  'NATION ' || n_name || chr(10) || 'IN ' || r_name AS text FROM nation JOIN region ON r_regionkey = n_regionkey""")
def canonical_paths(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import code

    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), c("n_regionkey") == c("r_regionkey"))
    rows = code.serialized(code.canonical_paths(rows.withColumn("none", F.lit(None).cast("string")), ["r_name", "n_name", "none"]), [("NATION", "n_name"), ("IN", "r_name"), ("LOST", "none")])
    return rows.select("n_nationkey", F.concat(F.lit("region/"), F.lower("r_name"), F.lit("/"), F.lower("n_name")).alias("raw"), "canonical_path", "text")


@query(f"""WITH {LINES_SQL}, d AS (SELECT trim(regexp_replace(value, '\\s+', ' ', 'g')) AS message, min(doc_id) AS doc_id FROM lines GROUP BY 1 HAVING length(message) >= 12),
m AS (SELECT *, regexp_matches(message, '(?i)error|exception|failed|cannot') AS bad FROM d)
SELECT doc_id, message FROM m WHERE bad OR NOT (SELECT bool_or(bad) FROM m) ORDER BY doc_id, message LIMIT 3""")
def diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import code

    rows = document_lines(spark, sf).select("doc_id", "value")
    return code.diagnostics(rows, "value", "doc_id")


@query("""WITH a AS (SELECT 0 AS list, 'n' || n_nationkey AS id, n_nationkey AS place FROM nation WHERE n_nationkey < 5), b AS (SELECT 1, 'r' || r_regionkey, r_regionkey FROM region)
SELECT list, id FROM (FROM a UNION ALL FROM b) ORDER BY list, place LIMIT 8""")
def first_over_lists(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import code

    a = table(spark, sf, "nation").filter("n_nationkey < 5").select(F.concat(F.lit("n"), c("n_nationkey").cast("string")).alias("id"), c("n_nationkey").alias("at"))
    b = table(spark, sf, "region").select(F.concat(F.lit("r"), c("r_regionkey").cast("string")).alias("id"), c("r_regionkey").alias("at"))
    return code.first_over_lists([a, b], ["id"], "at").select("list", "id")


@query("""WITH k AS (SELECT DISTINCT p_brand AS name, 'path/' || p_brand AS path FROM part WHERE p_size < 25 AND p_brand < 'Brand#33'), l AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN p_brand ELSE upper(p_brand) END AS name FROM part)
SELECT l.name, coalesce(a.path, b.path) AS path FROM l LEFT JOIN k a ON a.name = l.name LEFT JOIN k b ON lower(b.name) = lower(l.name)""")
def two_key_lookup(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import code

    part = table(spark, sf, "part")
    known = part.filter("p_size < 25 AND p_brand < 'Brand#33'").select(c("p_brand").alias("known"), F.concat(F.lit("path/"), c("p_brand")).alias("path")).distinct()
    left = part.select(F.when(c("p_size") % 2 == 0, c("p_brand")).otherwise(F.upper("p_brand")).alias("name")).distinct()
    return code.two_key_lookup(left, known, "name", "known", "path")


@query("""SELECT doc_id, source FROM documents WHERE EXISTS (SELECT 1 FROM benchmark WHERE contains(documents.text, benchmark.text)) ORDER BY doc_id LIMIT 32""")
def named_in_texts(spark: SparkSession, sf: str) -> DataFrame:
    docs, names = table(spark, sf, "documents").select("doc_id", "source", "text"), table(spark, sf, "benchmark").select(c("text").alias("name"))
    return lookup.named_in(docs, names, "text", "name", 32, ["doc_id"]).select("doc_id", "source")


@query("""WITH o AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), e AS (SELECT user_id AS k, count(*) AS m FROM events GROUP BY 1) SELECT coalesce(o.k, e.k) AS k, n, m FROM o FULL JOIN e ON o.k = e.k""")
def align_groups(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.align_groups(table(spark, sf, "orders").groupBy(c("o_custkey").alias("k")).agg(F.count("*").alias("n")), table(spark, sf, "events").groupBy(c("user_id").alias("k")).agg(F.count("*").alias("m")), "k")


@query(f"WITH {YEARS_SQL} SELECT 'removed_operation' AS change, 'op ' || id AS name FROM a WHERE id NOT IN (FROM b) UNION ALL SELECT 'added_operation', 'op ' || id FROM b WHERE id NOT IN (FROM a) UNION ALL SELECT 'changed_schema', 'op ' || id FROM ((FROM a EXCEPT FROM b) UNION ALL (FROM b EXCEPT FROM a))")
def contract_diff(spark: SparkSession, sf: str) -> DataFrame:
    named = lambda y: active(spark, sf, y).select(F.concat_ws(" ", F.lit("op"), c("id").cast("string")).alias("name"))
    old, new = named(1996), named(1997)
    return compare.contract_diff(old, new, old, new)

"""Queries that apply the plans over code models, trees, indexes and rules to the test tables, each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as fx
from ..operators import lookup, retrieval, rules
from ..sources import files, scans
from ..sources.files import temporary, written
from ..sources.store import VersionedTable
from . import ask, canonical, document, draft, observed, runs, snapshot
from .queries import NODES_SQL, ORACLES, QUERIES, c, evidence_nodes, hierarchical_rollup, query, table  # noqa: F401  the entry takes some from here

# Nested types of three observers, made of customers, their events as fields, orders as methods and line items as parameters

_NB = "CASE WHEN trim({0}) <> '' THEN {0} END"


def _first_text(name: str, order: str = "sbr") -> str:
    return f"coalesce({', '.join(_NB.format(f'{o}.{name}') for o in order)})"


def _beside_sql(name: str, key: str, columns: str) -> str:
    packed = "{" + ", ".join(f"'{col}': {col}" for col in columns.split()) + "}"
    by = ", ".join(f"arg_max({packed}, ordinal) FILTER (source = '{who}') AS {o}, min(ordinal) FILTER (source = '{who}') AS at_{o}" for o, who in zip("sbr", ("SOURCE", "BYTECODE", "RUNTIME"), strict=True))
    return f"{name}_by AS (SELECT *, CASE WHEN at_s IS NOT NULL THEN 0 WHEN at_b IS NOT NULL THEN 1 ELSE 2 END AS who, coalesce(at_s, at_b, at_r) AS at_first FROM (SELECT {key}, {by} FROM {name} GROUP BY {key}))"


MODEL_SQL = f"""types AS (
  SELECT 'SOURCE' AS source, 'c' || c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE 'src.' || lower(c_mktsegment) END AS package_name, c_name AS simple_name, 'class' AS kind, NULL AS super_class, c_mktsegment AS face, c_custkey AS ordinal FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT 'BYTECODE', 'c' || c_custkey, 'bin.' || c_nationkey, c_name || 'B', 'interface', 'Base' || c_nationkey, 'N' || c_nationkey, c_custkey FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT 'RUNTIME', 'c' || c_custkey, 'run', c_name || 'R', '', 'Proxy', c_mktsegment, c_custkey FROM customer WHERE c_custkey % 5 <> 0),
fields AS (SELECT ['SOURCE', 'BYTECODE', 'RUNTIME'][CAST(event_id % 3 + 1 AS INTEGER)] AS source, 'c' || user_id AS type_id, event_type AS id, CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type || '-' || event_id % 3 END AS name,
  CASE WHEN event_id % 5 = 0 THEN ' ' ELSE 'T' || event_id % 7 END AS type, CASE event_id % 6 WHEN 0 THEN NULL ELSE event_id % 2 = 0 END AS nullable, event_id AS ordinal FROM events),
methods AS (
  SELECT 'SOURCE' AS source, 'c' || o_custkey AS type_id, 'o' || o_orderkey AS id, 'do' || o_orderstatus AS name, '' AS return_type, 'public' AS visibility, o_orderkey % 4 = 0 AS constructor, false AS synthetic, o_orderpriority AS thrown, o_orderkey AS ordinal FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT 'BYTECODE', 'c' || o_custkey, 'o' || o_orderkey, 'call' || o_orderstatus, 'void', NULL, o_orderkey % 9 = 0, o_orderstatus = 'F', 'Fault' || o_orderkey % 3, o_orderkey FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT 'RUNTIME', 'c' || o_custkey, 'o' || o_orderkey, '', 'Object', 'private', true, o_orderstatus = 'P', o_orderpriority, o_orderkey FROM orders WHERE o_orderkey % 5 <> 0),
params AS (SELECT ['SOURCE', 'BYTECODE', 'RUNTIME'][CAST(l_partkey % 3 + 1 AS INTEGER)] AS source, 'o' || l_orderkey AS method_id, l_returnflag AS id, CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE 'arg' || l_suppkey % 5 END AS name,
  'P' || l_linenumber AS type, CASE l_partkey % 5 WHEN 0 THEN NULL ELSE l_partkey % 2 = 0 END AS nullable, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 100000 + l_suppkey AS ordinal FROM lineitem),
{_beside_sql('types', 'id', 'package_name simple_name kind super_class face')}, {_beside_sql('fields', 'type_id, id', 'name type nullable')},
{_beside_sql('methods', 'type_id, id', 'name return_type visibility constructor synthetic thrown')}, {_beside_sql('params', 'method_id, id', 'name type nullable')},
p AS (SELECT method_id, string_agg(concat_ws(':', id, coalesce({_first_text('name', 'srb')}, '-'), {_first_text('type')}, coalesce(CAST(coalesce(s.nullable, r.nullable, b.nullable) AS VARCHAR), '-')), ',' ORDER BY who, at_first) AS parameters FROM params_by GROUP BY 1),
m AS (SELECT type_id, string_agg(concat_ws(':', m.id, CASE WHEN at_s IS NOT NULL THEN s.name WHEN at_b IS NOT NULL THEN b.name ELSE r.name END, coalesce({_first_text('return_type')}, '-'), coalesce({_first_text('visibility')}, '-'),
  CAST(coalesce(s.constructor, false) OR coalesce(b.constructor, false) AS VARCHAR), CAST(coalesce(b.synthetic, false) OR coalesce(r.synthetic, false) AS VARCHAR),
  concat_ws('+', s.thrown, b.thrown, CASE WHEN r.thrown <> coalesce(s.thrown, '') THEN r.thrown END)) || '(' || coalesce(p.parameters, '') || ')', ';' ORDER BY who, at_first) AS methods FROM methods_by m LEFT JOIN p ON p.method_id = m.id GROUP BY 1),
f AS (SELECT type_id, string_agg(concat_ws(':', id, CASE WHEN at_s IS NOT NULL THEN s.name WHEN at_b IS NOT NULL THEN b.name ELSE r.name END, coalesce({_first_text('type')}, '-'), coalesce(CAST(coalesce(s.nullable, r.nullable, b.nullable) AS VARCHAR), '-')), ';' ORDER BY who, at_first) AS fields FROM fields_by GROUP BY 1)"""


@query(f"""WITH {MODEL_SQL}
SELECT t.id, coalesce({_first_text('package_name')}, '-') AS package_name, {_first_text('simple_name')} AS simple_name, coalesce({_first_text('kind')}, '-') AS kind, coalesce({_first_text('super_class')}, '-') AS super_class,
  concat_ws('+', s.face, CASE WHEN b.face <> coalesce(s.face, '') THEN b.face END, CASE WHEN r.face <> coalesce(s.face, '') THEN r.face END) AS interfaces, concat_ws('+', 'Mark/' || s.kind, 'Mark/' || b.kind, CASE WHEN at_r IS NOT NULL THEN 'Mark/' END) AS annotations,
  coalesce(f.fields, '') AS fields, coalesce(m.methods, '') AS methods
FROM types_by t LEFT JOIN f ON f.type_id = t.id LEFT JOIN m ON m.type_id = t.id""")
def merged_types(spark: SparkSession, sf: str) -> DataFrame:
    """Nested types of three observers, written as text."""
    key = lambda p, name: F.concat(F.lit(p), c(name).cast("string"))
    no_marks, none = F.expr(f"CAST(array() AS {schemas._ANNOTATIONS})").alias("annotations"), F.expr(f"CAST(array() AS {schemas._PROVENANCE})").alias("provenance")
    marked = lambda kind: F.array(F.struct(F.lit("Mark").alias("name"), F.lit("a.Mark").alias("qualified_name"), F.create_map(F.lit("kind"), F.lit(kind)).alias("values"))).alias("annotations")
    source = lambda at: F.element_at(F.array(*map(F.lit, ("SOURCE", "BYTECODE", "RUNTIME"))), (at + 1).cast("int")).alias("source")
    text = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("string")

    rows = table(spark, sf, "customer")

    def types(who: str, package: Column, name: Column, kind: str, above: Column | str | None, face: Column) -> list[Column]:
        return [F.lit(who).alias("source"), key("c", "c_custkey").alias("id"), package.alias("package_name"), name.alias("simple_name"), name.alias("qualified_name"), F.lit(kind).alias("kind"), text(above).alias("super_class"), F.array(face).alias("interfaces"), marked(kind), none, c("c_custkey").alias("ordinal")]

    nation = c("c_nationkey").cast("string")
    t = rows.filter("c_custkey % 2 = 0").select(*types("SOURCE", F.when(c("c_custkey") % 4 == 0, " ").otherwise(F.concat(F.lit("src."), F.lower("c_mktsegment"))), c("c_name"), "class", None, c("c_mktsegment")))
    t = t.unionByName(rows.filter("c_custkey % 3 = 0").select(*types("BYTECODE", F.concat(F.lit("bin."), nation), F.concat("c_name", F.lit("B")), "interface", F.concat(F.lit("Base"), nation), F.concat(F.lit("N"), nation))))
    t = t.unionByName(rows.filter("c_custkey % 5 <> 0").select(*types("RUNTIME", F.lit("run"), F.concat("c_name", F.lit("R")), "", "Proxy", c("c_mktsegment"))))
    e = c("event_id")
    flag = lambda at, n, odd: F.when(at % n != 0, at % odd == 0)
    f = table(spark, sf, "events").select(
        source(e % 3), key("c", "user_id").alias("type_id"), c("event_type").alias("id"), F.when(e % 4 == 0, "").otherwise(F.concat_ws("-", "event_type", (e % 3).cast("string"))).alias("name"), F.when(e % 5 == 0, " ").otherwise(F.concat(F.lit("T"), (e % 7).cast("string"))).alias("type"),
        F.lit("").alias("erased_type"), flag(e, 6, 2).alias("nullable"), F.lit(None).cast("boolean").alias("primary_key"), no_marks, none, e.alias("ordinal"),
    )
    o, orders = c("o_orderkey"), table(spark, sf, "orders")

    def methods(who: str, name: Column, kind: str, seen: str | None, made: Column, extra: Column, thrown: Column) -> list[Column]:
        body = F.lit(None).cast("struct<normalized_source:string, call_edges:array<struct<owner_type:string, method_name:string>>, literals:array<string>>").alias("body")
        return [F.lit(who).alias("source"), key("c", "o_custkey").alias("type_id"), key("o", "o_orderkey").alias("id"), name.alias("name"), F.lit(kind).alias("return_type"), F.lit(kind).alias("erased_return_type"), text(seen).alias("visibility"), made.alias("constructor"), extra.alias("synthetic"), F.lit(False).alias("bridge"), no_marks, F.array(thrown).alias("thrown_types"), body, none, o.alias("ordinal")]

    status = c("o_orderstatus")
    m = orders.filter(o % 2 == 0).select(*methods("SOURCE", F.concat(F.lit("do"), status), "", "public", o % 4 == 0, F.lit(False), c("o_orderpriority")))
    m = m.unionByName(orders.filter(o % 3 == 0).select(*methods("BYTECODE", F.concat(F.lit("call"), status), "void", None, o % 9 == 0, status == "F", F.concat(F.lit("Fault"), (o % 3).cast("string")))))
    m = m.unionByName(orders.filter(o % 5 != 0).select(*methods("RUNTIME", F.lit(""), "Object", "private", F.lit(True), status == "P", c("o_orderpriority"))))
    p = table(spark, sf, "lineitem").select(
        source(c("l_partkey") % 3), key("o", "l_orderkey").alias("method_id"), c("l_returnflag").alias("id"), F.when(c("l_suppkey") % 4 == 0, "").otherwise(F.concat(F.lit("arg"), (c("l_suppkey") % 5).cast("string"))).alias("name"), key("P", "l_linenumber").alias("type"),
        F.lit("").alias("erased_type"), flag(c("l_partkey"), 5, 2).alias("nullable"), no_marks, none, (c("l_linenumber").cast("long") * 1_000_000_000_000 + c("l_partkey") * 100_000 + c("l_suppkey")).alias("ordinal"),
    )
    said = lambda x: F.coalesce(x.cast("string"), F.lit("-"))
    listed = lambda items, one, mark: F.array_join(F.transform(items, one), mark)
    member = lambda x: F.concat_ws(":", x["id"], said(x["name"]), said(x["type"]), said(x["nullable"]))
    method = lambda x: F.concat(F.concat_ws(":", x["id"], x["name"], said(x["return_type"]), said(x["visibility"]), said(x["constructor"]), said(x["synthetic"]), F.array_join(x["thrown_types"], "+")), F.lit("("), listed(x["parameters"], member, ","), F.lit(")"))
    return observed.merged_types(t, f, m, p).select(
        "id", said(c("package_name")).alias("package_name"), "simple_name", said(c("kind")).alias("kind"), said(c("super_class")).alias("super_class"), F.array_join("interfaces", "+").alias("interfaces"),
        listed("annotations", lambda a: F.concat_ws("/", a["name"], a["values"]["kind"]), "+").alias("annotations"), listed("fields", member, ";").alias("fields"), listed("methods", method, ";").alias("methods"),
    )


# Citations and lineage of the synthesized document

CITES_SQL = f"""{NODES_SQL}, cites AS (
  SELECT 'service:' || coalesce((SELECT arg_min(label, ordinal) FROM n WHERE kind = 'project'), 'service') AS owner_id, id AS node, row_number() OVER (ORDER BY ordinal) - 1 AS ordinal FROM n WHERE kind IN ('project', 'documentation-section')
  UNION ALL SELECT 'interface:' || surface, id, row_number() OVER (PARTITION BY surface ORDER BY label, ordinal) - 1 FROM faces
  UNION ALL SELECT unnest(['operation:' || id, 'scenario:operation:' || id]), id, 0 FROM n WHERE kind IN ('http-endpoint', 'contract-channel', 'nightly-job')
  UNION ALL SELECT 'datastore:primary', id, row_number() OVER (ORDER BY kind = 'database-migration', ordinal) - 1 FROM n WHERE kind IN ('persistence-entity', 'database-migration')
  UNION ALL SELECT 'integration:' || lang, id, row_number() OVER (PARTITION BY lang ORDER BY ordinal) - 1 FROM n WHERE kind = 'integration-config'
  UNION ALL SELECT 'workflow:' || id, id, 0 FROM n WHERE kind = 'nightly-job' OR (kind = 'documentation-section' AND ends_with(label, ' flow'))
  UNION ALL SELECT 'rule:' || id, id, 0 FROM n WHERE kind IN ('validation-constraint', 'security-constraint')
  UNION ALL SELECT 'scenario:' || id, id, 0 FROM n WHERE kind = 'documentation-section' AND ends_with(label, ' scenario')
  UNION ALL SELECT * FROM (SELECT 'note:' || id, id, 0 FROM n WHERE kind = 'documentation-section' ORDER BY label, ordinal LIMIT 5))"""


@query(f"""WITH {CITES_SQL} SELECT owner_id, ordinal, node AS evidence_node_id, 'file' AS file, 1 AS start_line, 2 AS end_line, 'Derived from evidence node ' || node AS rationale FROM cites""")
def synthesized_citations(spark: SparkSession, sf: str) -> DataFrame:
    """The citations of synthesized_items, a row each."""
    return document.synthesize(spark, *evidence_nodes(spark, sf))[1]


@query(f"""WITH {CITES_SQL}, own AS (SELECT owner_id, count(*) AS evidence FROM cites GROUP BY 1),
sides AS (SELECT 'interface:' || surface AS face, sum(evidence) AS evidence, count(*) AS commands FROM ops JOIN own ON owner_id = 'operation:' || id GROUP BY 1),
kinds AS (SELECT split_part(owner_id, ':', 1) AS kind, count(*) AS items FROM own GROUP BY 1)
SELECT owner_id AS id, split_part(owner_id, ':', 1) AS kind, CAST(CASE WHEN starts_with(owner_id, 'service:') THEN (SELECT sum(evidence) FROM own WHERE NOT starts_with(owner_id, 'service:')) ELSE own.evidence + coalesce(sides.evidence, 0) END AS BIGINT) AS evidence,
  CAST(0 AS BIGINT) AS warning, CASE WHEN starts_with(owner_id, 'service:') THEN (SELECT count(*) FROM n WHERE kind = 'project') ELSE 0 END AS blocking,
  {', '.join(f"coalesce(CASE WHEN starts_with(owner_id, 'service:') THEN (SELECT items FROM kinds WHERE kind = '{kind}') {'ELSE sides.commands' if kind == 'operation' else ''} END, 0) AS {name}" for kind, name in document.COUNTED.items())}
FROM own LEFT JOIN sides ON face = owner_id""")
def lineage_tree(spark: SparkSession, sf: str) -> DataFrame:
    """The items of the synthesized document with the citations rolled up and the service's own counts; nodes of projects are taken for lost."""
    nodes, refs = evidence_nodes(spark, sf)
    items, citations = (written(x, "document") for x in document.synthesize(spark, written(nodes, "nodes"), refs))
    return document.lineage(items, citations, nodes.filter("kind <> 'project'"))[0].drop("parent_id", "name")


# Many questions and names at once


_TOKENS_SQL = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda t: length(t) > {n})"


@query(f"""WITH tokens AS (SELECT doc_id, {_TOKENS_SQL.format(n=1)} AS t FROM documents), stats AS (SELECT count(*) AS big_n, avg(len(t)) AS mean FROM tokens),
tf AS (SELECT doc_id, any_value(length) AS length, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM tokens) GROUP BY doc_id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TOKENS_SQL.format(n=1)}) AS term FROM benchmark) GROUP BY ALL),
scores AS (SELECT item_id, doc_id, sum(times * ln((big_n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))) AS score FROM asked JOIN df USING (term) JOIN tf USING (term), stats GROUP BY item_id, doc_id)
SELECT item_id AS question, doc_id AS ordinal, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS place FROM scores QUALIFY place <= 5""")
def bm25_questions(spark: SparkSession, sf: str) -> DataFrame:
    """The five best documents for every benchmark item at once."""
    index = retrieval.text_index(table(spark, sf, "documents").select("doc_id", "text"), ordinal="doc_id")
    found = retrieval.bm25_questions(index, table(spark, sf, "benchmark").select(c("item_id").alias("question"), "text"), 5)
    return found.select("question", "ordinal", F.round("score", 6).alias("score"), c("place").cast("long").alias("place"))


@query(f"""WITH asked AS (SELECT item_id, unnest(list_distinct({_TOKENS_SQL.format(n=2)})) AS term FROM benchmark), parts AS (SELECT DISTINCT term FROM asked),
held AS (SELECT term, doc_id FROM parts JOIN documents ON contains(lower(text), term)), scores AS (SELECT item_id, doc_id, count(*) AS score FROM asked JOIN held USING (term) GROUP BY item_id, doc_id)
SELECT b.item_id AS question, d.doc_id AS ordinal, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY b.item_id ORDER BY coalesce(score, 0) DESC, d.doc_id) AS place
FROM benchmark b CROSS JOIN documents d LEFT JOIN scores s ON s.item_id = b.item_id AND s.doc_id = d.doc_id QUALIFY place <= 5""")
def overlap_questions(spark: SparkSession, sf: str) -> DataFrame:
    """The five documents that hold most terms of every benchmark item."""
    index = retrieval.text_index(table(spark, sf, "documents").select("doc_id", "text"), ordinal="doc_id")
    found = retrieval.overlap_questions(index, table(spark, sf, "benchmark").select(c("item_id").alias("question"), "text"), 5)
    return found.select("question", "ordinal", "score", c("place").cast("long").alias("place"))


@query("""WITH names AS (SELECT text AS name FROM benchmark UNION SELECT p_name FROM part UNION SELECT c_name FROM customer UNION SELECT s_name FROM supplier UNION SELECT props FROM events WHERE event_type = 'error' UNION SELECT replace(url, 'https://', '') FROM pages)
SELECT doc_id, source FROM documents WHERE EXISTS (SELECT 1 FROM names WHERE name <> '' AND contains(documents.text, name))""")
def named_in_many(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold one of the names of benchmark items, parts, customers, suppliers, properties and pages: too many for one array."""
    tables = (("benchmark", c("text")), ("part", c("p_name")), ("customer", c("c_name")), ("supplier", c("s_name")), ("events", F.when(c("event_type") == "error", c("props"))), ("pages", F.replace(c("url"), F.lit("https://"), F.lit(""))))
    names = [table(spark, sf, name).select(column.alias("name")) for name, column in tables]
    rows = table(spark, sf, "documents").select("doc_id", "source", "text")
    return lookup.named_in(rows, _all(names), "text", "name", at_once=100).select("doc_id", "source")


# Rules of customers as commands, by templates over their orders

RULE_TEMPLATES = (
    "total > {n} && status == 'F'", "priority == '{p}'", "missing{m} > 5 || total <= {n}", "total == 'abc'", "total && flag", "duration(start, end) <= PT{n}H && DRAFT == status", "total >", "(total < 5) == flag || priority != '{p}' && emitPayrollAdjustment(total, unseen)",
)


def _rule_codes_sql() -> str:
    """What is wrong with each template, by the type of `total` (t) and of `flag` (f)."""
    bad = lambda test, code: f"CASE WHEN {test} THEN ['{code}'] ELSE [] END"
    number, flagged = bad("t <> 'UNKNOWN' AND t <> 'NUMBER'", "RULE_TYPE_MISMATCH"), bad("f IS NULL", "RULE_UNKNOWN_IDENTIFIER")
    known = bad("t IS NULL", "RULE_UNKNOWN_IDENTIFIER")
    number, known = number.replace("t <>", "coalesce(t, 'UNKNOWN') <>"), known
    unseen = "['RULE_UNKNOWN_IDENTIFIER']"
    text = bad("coalesce(t, 'UNKNOWN') NOT IN ('UNKNOWN', 'STRING')", "RULE_TYPE_MISMATCH")
    both = bad("coalesce(t, '') <> 'BOOLEAN' OR coalesce(f, '') <> 'BOOLEAN'", "RULE_TYPE_BOOLEAN")
    listed = {
        0: [known, number, unseen.replace("RULE", "RULE")], 1: ["[]"], 2: [unseen, known, number], 3: [known, text], 4: [known, flagged, both],
        5: ["['RULE_UNKNOWN_IDENTIFIER', 'RULE_UNKNOWN_IDENTIFIER', 'RULE_UNKNOWN_IDENTIFIER']"], 6: ["['RULE_UNPARSEABLE']"], 7: [known, known, flagged, unseen, number],
    }
    return "CASE kind " + " ".join(f"WHEN {k} THEN list_concat({', '.join(v)}, [])" for k, v in listed.items()) + " END"


@query(f"""WITH r AS (SELECT 'c' || o_custkey AS command, 'R-' || o_orderkey % 6 AS rule_id, o_orderkey AS ordinal, CAST(o_orderkey % 8 AS INTEGER) AS kind, o_orderpriority AS p, o_custkey FROM orders),
typed AS (SELECT r.*, CASE WHEN c_mktsegment = 'BUILDING' THEN 'STRING' WHEN c_nationkey = 3 THEN NULL WHEN c_nationkey = 4 THEN 'UNKNOWN' ELSE 'NUMBER' END AS t, CASE WHEN c_nationkey < 15 THEN 'BOOLEAN' END AS f FROM r JOIN customer ON c_custkey = o_custkey),
good AS (SELECT * FROM typed WHERE kind <> 6),
codes AS (SELECT command, rule_id, ordinal, unnest({_rule_codes_sql()}) AS code FROM typed
  UNION ALL SELECT command, rule_id, ordinal, 'RULE_DUPLICATE_ID' FROM good QUALIFY row_number() OVER (PARTITION BY command, rule_id ORDER BY ordinal) > 1
  UNION ALL SELECT command, rule_id, ordinal, 'RULE_CONFLICT' FROM (SELECT *, first_value(v) OVER (PARTITION BY command, name ORDER BY rule_id, ordinal) AS first FROM (
    SELECT *, CASE kind WHEN 1 THEN 'priority' ELSE 'total' END AS name, CASE kind WHEN 1 THEN p ELSE 'abc' END AS v FROM good WHERE kind IN (1, 3))) WHERE v <> first)
SELECT command, rule_id, ordinal, code, CASE code WHEN 'RULE_UNPARSEABLE' THEN 'WARN' ELSE 'ERROR' END AS level FROM codes""")
def rule_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """Rules made of orders, eight templates; symbols by customer: an entity's fields, inputs that replace them, a status machine for none."""
    text = F.lit(RULE_TEMPLATES[-1])
    for k, template in enumerate(RULE_TEMPLATES[:-1]):
        text = F.when(c("o_orderkey") % 8 == k, template).otherwise(text)
    for mark, column in (("{n}", (c("o_orderkey") % 9).cast("string")), ("{m}", (c("o_orderkey") % 3).cast("string")), ("{p}", c("o_orderpriority"))):
        text = F.replace(text, F.lit(mark), column)
    key = F.concat(F.lit("c"), c("o_custkey").cast("string"))
    made = table(spark, sf, "orders").select(key.alias("command"), F.concat(F.lit("R-"), (c("o_orderkey") % 6).cast("string")).alias("rule_id"), c("o_orderkey").alias("ordinal"), text.alias("ensure"))
    known = table(spark, sf, "customer").select(F.concat(F.lit("c"), c("c_custkey").cast("string")).alias("command"), "c_nationkey", "c_mktsegment")
    symbol = lambda rows, name, kind, layer: rows.select("command", F.lit(name).alias("name"), F.lit(kind).alias("type"), F.lit(layer).alias("layer"), F.lit(0).alias("ordinal"))
    fields = symbol(known.filter("c_nationkey NOT IN (3, 4)"), "total", "double", 0).unionByName(symbol(known.filter("c_nationkey = 4"), "total", "Money", 0)).unionByName(symbol(known.filter("c_nationkey < 15"), "flag", "boolean", 0)).unionByName(symbol(known, "priority", "String", 0))
    return rules.rule_diagnostics(made, fields.unionByName(symbol(known.filter("c_mktsegment = 'BUILDING'"), "total", "enum(Totals)", 1)))


# Canonical specifications: a region's nations are contexts, its customers' segments aggregates

_TOKEN_SQL = r"regexp_replace(lower(trim(translate(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '_-', '  '))), '\s+', '_', 'g')"


def _token(x: str) -> str:
    return _TOKEN_SQL.replace("{0}", x)


def _id_sql(kind: str, token: str, scope: str, json: str) -> str:
    return f"sha256('{kind}|' || {token} || '|' || {scope} || '|' || sha256({json}))"


def _texts(items: str) -> str:
    """A JSON array of texts, sorted."""
    return f"""'[' || coalesce(string_agg('"' || {items} || '"', ',' ORDER BY {items}), '') || ']'"""


SPEC_SQL = f"""things AS (SELECT r_regionkey, r_name, n_name, c_mktsegment AS segment, c_custkey, c_name, c_acctbal FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey),
service AS (SELECT r_regionkey AS s, 'Region' || r_name AS name, '/services/' || translate({_token("'Region' || r_name")}, '_', '-') AS path FROM region),
context AS (SELECT DISTINCT s, path AS up, path || '/bounded-contexts/' || translate({_token('n_name')}, '_', '-') AS path, {_token('n_name')} AS token, n_name FROM things JOIN service ON s = r_regionkey),
aggregate AS (SELECT DISTINCT c.s, c.path AS up, c.path || '/aggregates/' || translate({_token("'Market' || segment")}, '_', '-') AS path, {_token("'Market' || segment")} AS token, c.n_name, segment FROM things t JOIN context c ON c.n_name = t.n_name),
entity AS (SELECT a.path AS up, a.path || '/entities/' || translate({_token('c_name')}, '_', '-') AS path, {_token('c_name')} AS token, c_custkey, c_acctbal FROM things t JOIN aggregate a ON a.n_name = t.n_name AND a.segment = t.segment),
field AS (SELECT path AS up, path || '/fields/' || f AS path, f AS token, CASE f WHEN 'cust-key' THEN '{{"nullable":false,"pk":true,"type":"long"}}' ELSE '{{"nullable":true,"pk":false,"type":"' || CASE WHEN c_acctbal < 0 THEN 'int' ELSE 'double' END || '"}}' END AS json FROM entity, (VALUES ('cust-key'), ('balance')) x(f)),
names(name) AS (VALUES ('Opened'), ('BalanceChanged'), ('closed-Down')), event AS (SELECT path AS up, path || '/events/' || translate({_token('name')}, '_', '-') AS path, {_token('name')} AS token, name FROM aggregate, names),
command AS (SELECT path AS up, path || '/commands/' || translate({_token('k')}, '_', '-') AS path, {_token('k')} AS token, k, e FROM aggregate, (VALUES ('Open', ['Opened', 'nothing']), ('changeBalance', ['balance_changed', 'closed-Down', 'Closed Down'])) x(k, e)),
emitted AS (SELECT c.path, c.k, up || '/events/' || translate({_token('w')}, '_', '-') AS e FROM (SELECT path, up, k, unnest(e) AS w FROM command) c WHERE {_token('w')} IN (SELECT {_token('name')} FROM names))"""


@query(rf"""WITH {SPEC_SQL}
SELECT 'service' AS kind, {_id_sql('service', _token('name'), "'/'", """'{"basePackage":"org.' || s || '"}'""")} AS id, path, {_token('name')} AS canonical_name FROM service
UNION ALL SELECT 'boundedContext', {_id_sql('boundedContext', 'c.token', 'c.up', """'{"aggregateNames":' || (SELECT """ + _texts('a.token') + """ FROM aggregate a WHERE a.up = c.path) || '}'""")}, path, token FROM context c
UNION ALL SELECT 'aggregate', {_id_sql('aggregate', 'a.token', 'a.up', """'{"commandNames":' || (SELECT """ + _texts('c.token') + """ FROM command c WHERE c.up = a.path) || ',"entityNames":' || (SELECT """ + _texts('e.token') + """ FROM entity e WHERE e.up = a.path) || ',"eventNames":' || (SELECT """ + _texts('v.token') + """ FROM event v WHERE v.up = a.path) || ',"identityField":"custKey"}'""")}, path, token FROM aggregate a
UNION ALL SELECT 'entity', {_id_sql('entity', 'e.token', 'e.up', """'{"fieldNames":["balance","cust_key"],"table":"t' || c_custkey || '"}'""")}, path, token FROM entity e
UNION ALL SELECT 'field', {_id_sql('field', "translate(token, '-', '_')", 'up', 'json')}, path, translate(token, '-', '_') FROM field
UNION ALL SELECT 'event', {_id_sql('event', 'token', 'up', """'{"payload":[],"topic":"topic.' || name || '"}'""")}, path, token FROM event
UNION ALL SELECT 'command', {_id_sql('command', 'c.token', 'c.up', """'{"emits":' || (SELECT """ + _texts('m.e') + """ FROM emitted m WHERE m.path = c.path) || ',"method":"POST","rules":' || CASE k WHEN 'Open' THEN '["r_10","R-2"]' ELSE '[]' END || '}'""")}, path, token FROM command c
UNION ALL SELECT 'rule', {_id_sql('rule', _token('r'), 'path', """'{"source":"' || CASE r WHEN 'R-2' THEN 'a > 1' ELSE 'b == 2' END || '","type":"GUARD"}'""")}, path || '/rules/' || translate({_token('r')}, '_', '-'), r FROM command, (VALUES ('R-2'), ('r_10')) x(r) WHERE k = 'Open'""")
def canonical_specs(spark: SparkSession, sf: str) -> DataFrame:
    """Every item of specifications made of regions, nations, segments and customers, with its path and stable id."""
    t, no_members = table(spark, sf, "customer"), f"CAST(array() AS {schemas._MEMBERS})"
    t = t.join(table(spark, sf, "nation"), c("n_nationkey") == c("c_nationkey")).join(table(spark, sf, "region"), c("r_regionkey") == c("n_regionkey"))
    member = lambda name, kind, key: f"named_struct('name', '{name}', 'type', {kind}, 'pk', {key}, 'nullable', {'false' if key == 'true' else 'CAST(NULL AS BOOLEAN)'})"
    balance = "IF(c_acctbal < 0, 'int', 'double')"
    entity = F.expr(f"named_struct('name', c_name, 'table', concat('t', c_custkey), 'fields', array({member('custKey', chr(39) + 'long' + chr(39), 'true')}, {member('balance', balance, 'CAST(NULL AS BOOLEAN)')}))")
    event = lambda name: f"named_struct('name', '{name}', 'topic', 'topic.{name}', 'format', CAST(NULL AS STRING), 'payload', {no_members})"
    no_rules = "CAST(array() AS array<struct<id:string, type:string, ensure:string>>)"
    command = lambda name, rules, emits: f"named_struct('name', '{name}', 'method', 'POST', 'path', CAST(NULL AS STRING), 'input', {no_members}, 'rules', {rules}, 'emits', array({emits}))"
    ruled = "array(named_struct('id', 'r_10', 'type', 'GUARD', 'ensure', 'b == 2'), named_struct('id', 'R-2', 'type', 'GUARD', 'ensure', 'a > 1'))"
    aggregates = t.groupBy("r_regionkey", "r_name", "n_name", "c_mktsegment").agg(F.collect_list(entity).alias("entities"))
    aggregate = F.expr(f"""named_struct('name', concat('Market', c_mktsegment), 'identity', named_struct('type', 'long', 'field', 'custKey'), 'entities', entities,
      'events', array({event('Opened')}, {event('BalanceChanged')}, {event('closed-Down')}), 'commands', array({command('Open', ruled, "'Opened', 'nothing'")}, {command('changeBalance', no_rules, "'balance_changed', 'closed-Down', 'Closed Down'")}),
      'machine', CAST(NULL AS struct<name:string, initial:string, states:array<string>, transitions:array<struct<on:string, from:array<string>, to:string>>>), 'hooks', CAST(array() AS array<struct<name:string, signature:string, optional:boolean>>))""")
    contexts = aggregates.groupBy("r_regionkey", "r_name", "n_name").agg(F.collect_list(aggregate).alias("aggregates"))
    specs = contexts.groupBy("r_regionkey", "r_name").agg(F.collect_list(F.struct(c("n_name").alias("name"), "aggregates")).alias("bounded_contexts"))
    specs = specs.selectExpr(
        "1 AS schema_version", "named_struct('name', concat('Region', r_name), 'base_package', concat('org.', r_regionkey)) AS service", "CAST(NULL AS BOOLEAN) AS generation", "CAST(NULL AS BOOLEAN) AS external",
        "CAST(NULL AS struct<page:int, batch:int, cache:boolean>) AS performance", "CAST(NULL AS struct<delivery:string, key:string, attempts:int, backoff:string, dlq:string>) AS messaging", "CAST(NULL AS array<string>) AS tags", "bounded_contexts",
    )
    return canonical.canonical_items(canonical.canonical_specs(specs))


ASKED = "which http flow has a scenario with migration or zzz"
_SCORE = " + ".join(f"CAST(contains(lower(text), '{t}') AS INTEGER)" for t in retrieval.query_terms(ASKED, 2, True))
_NAMED = " OR ".join(f"contains(lower(label), '{t}')" for t in retrieval.query_terms(ASKED, 2, True))


@query(f"""WITH items AS ({ORACLES['synthesized_items']}), {NODES_SQL},
texts AS (SELECT list_position(['service', 'interface', 'datastore', 'integration', 'workflow', 'rule', 'scenario'], kind) AS part, ordinal, id, upper(kind) || ' ' || name || chr(10) || CASE kind WHEN 'interface' THEN 'Protocol' WHEN 'datastore' THEN 'Technology' WHEN 'integration' THEN 'Artifacts'
    WHEN 'rule' THEN 'Statement' WHEN 'scenario' THEN 'Then' ELSE 'Summary' END || ': ' || coalesce(summary, '') AS text FROM items WHERE kind NOT IN ('operation', 'note')
  UNION ALL SELECT 8, ordinal, id, upper(kind) || ' ' || label || chr(10) || 'Path: ' FROM n WHERE kind IN ('documentation-section', 'http-endpoint', 'contract-operation'))
SELECT 'document' AS source, text FROM (SELECT text FROM texts ORDER BY {_SCORE} DESC, part, ordinal, id LIMIT 12) UNION ALL SELECT 'graph', label FROM (SELECT label FROM n WHERE {_NAMED} ORDER BY id LIMIT 20)""")
def ask_context(spark: SparkSession, sf: str) -> DataFrame:
    """What a question is answered from: the best texts of the document and the evidence, and the graph's nodes that name one of its terms."""
    nodes, refs = evidence_nodes(spark, sf)
    nodes = written(nodes.withColumn("path", F.lit(None).cast("string")), "nodes")
    items = written(document.synthesize(spark, nodes, refs)[0], "items")
    return ask.ask(items, nodes, ASKED)


# Versioned graphs


@query("""SELECT 'v' || c_nationkey % 3 AS version, 'c' || c_custkey AS node_id, CASE WHEN c_acctbal > 3000 AND c_nationkey % 3 < 2 THEN 'Good ' ELSE '' END || c_name AS name, 'customer' AS kind FROM customer
UNION ALL SELECT 'v0', 's' || s_suppkey, s_name, 'supplier' FROM supplier""")
def versioned_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Customers put into three versions, some renamed in two of them, suppliers added to one, and a commit repeated."""
    graph = VersionedTable(spark, temporary(spark, "graph"), "node_id string, name string, kind string", ["node_id"])
    customers = table(spark, sf, "customer").select(F.concat(F.lit("c"), c("c_custkey").cast("string")).alias("node_id"), c("c_name").alias("name"), F.lit("customer").alias("kind"), "c_acctbal", "c_nationkey")
    for n in range(3):
        own = customers.filter(c("c_nationkey") % 3 == n)
        graph.upsert(own, f"v{n}", f"load-{n}")
        if n < 2:
            graph.upsert(own.filter("c_acctbal > 3000").withColumn("name", F.concat(F.lit("Good "), c("name"))), f"v{n}", f"rename-{n}")
    graph.upsert(table(spark, sf, "supplier").select(F.concat(F.lit("s"), c("s_suppkey").cast("string")).alias("node_id"), c("s_name").alias("name"), F.lit("supplier").alias("kind")), "v0", "suppliers")
    graph.upsert(customers.filter(c("c_nationkey") % 3 == 0), "v0", "load-0")
    return graph.rows().select("version", "node_id", "name", "kind")


@query(f"""WITH items AS ({ORACLES['synthesized_items']}), {CITES_SQL}
SELECT 'nodes' AS part, id AS source, kind AS target, 'semantic:' || name AS type FROM items UNION ALL SELECT 'nodes', id, kind, 'evidence:' || label FROM n
UNION ALL SELECT 'links', parent_id, id, CASE kind WHEN 'interface' THEN 'DECLARES' WHEN 'operation' THEN 'DECLARES' WHEN 'datastore' THEN 'USES' WHEN 'integration' THEN 'INTEGRATES_WITH' WHEN 'workflow' THEN 'RUNS' WHEN 'rule' THEN 'CONSTRAINS' WHEN 'scenario' THEN 'DESCRIBES' END
  FROM items WHERE parent_id IS NOT NULL AND kind <> 'note'
UNION ALL SELECT 'links', owner_id, node, 'DERIVED_FROM' FROM cites UNION ALL SELECT 'links', a.id, b.id, 'FOLLOWS' FROM n a JOIN n b ON b.ordinal = a.ordinal * 3""")
def graph_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Both layers of the graph as versioned nodes and links; edges lead from each document to that of three times its number, where there is one."""
    nodes, refs = evidence_nodes(spark, sf)
    nodes = written(nodes, "nodes")
    items, citations = (written(x, "document") for x in document.synthesize(spark, nodes, refs))
    edges = nodes.select(c("id").alias("source"), F.concat(F.lit("d"), (c("ordinal") * 3).cast("string")).alias("target"), F.lit("FOLLOWS").alias("kind"))
    found, links = document.graph_projection(items, citations, nodes, edges, "v1")
    return found.select(F.lit("nodes").alias("part"), c("node_id").alias("source"), c("kind").alias("target"), F.concat_ws(":", "layer", "name").alias("type")).unionByName(links.select(F.lit("links").alias("part"), "source", "target", "type"))


# Helpers on names, annotations, times and texts


@query(r"""WITH p AS (SELECT page_id, url, regexp_replace(url, '^https?://[^/]*', '') AS path, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages), s AS (SELECT *, list_filter(string_split(replace(path, '/en/', '/{en}/'), '/'), lambda x: trim(x) <> '' AND NOT starts_with(x, '{')) AS parts FROM p),
h AS (SELECT page_id, string_split_regex(replace(host, '.', '_') || '-page', '[-_]+') AS w FROM p)
SELECT s.page_id, CASE WHEN trim(path) = '' THEN 'getCommand' ELSE coalesce(parts[-1], 'Command') END AS command, w[1] || coalesce(array_to_string(list_transform(w[2:], lambda x: upper(x[1:1]) || x[2:]), ''), '') AS camel,
  replace(replace(lower(host), '-', '.'), '_', '.') AS package, starts_with(url, 'https://m.') OR (starts_with(url, 'http://' || host) AND substr(url, length('http://' || host) + 1, 1) IN ('/', ':', '#')) OR url = 'http://' || host AS under,
  CASE WHEN parts[-1] IN ('true', 'false') THEN 'boolean' WHEN regexp_full_match(parts[-1], '-?[0-9]+(\.[0-9]+)?') THEN 'number' ELSE 'string' END AS kind
FROM s JOIN h ON h.page_id = s.page_id""")
def path_helpers(spark: SparkSession, sf: str) -> DataFrame:
    """Commands, camel-case and package names, path boundaries and literal kinds of the pages' URLs."""
    path, host = F.regexp_replace("url", "^https?://[^/]*", ""), F.regexp_extract("url", "://([^/?#]*)", 1)
    marked = F.replace(path, F.lit("/en/"), F.lit("/{en}/"))
    last = F.try_element_at(F.filter(F.split(marked, "/"), lambda x: (F.trim(x) != "") & ~x.startswith("{")), F.lit(-1))
    under = c("url").startswith("https://m.") | fx.under_path(c("url"), F.concat(F.lit("http://"), host))
    return table(spark, sf, "pages").select("page_id", fx.endpoint_command(F.when(path == "", "").otherwise(marked), F.lit("GET")).alias("command"), fx.camel_case(F.concat(F.replace(host, F.lit("."), F.lit("_")), F.lit("-page"))).alias("camel"), fx.folder_package(host).alias("package"), under.alias("under"), F.coalesce(fx.coerced_literal(last), F.lit("string")).alias("kind"))


@query("""WITH e AS (SELECT *, CAST(event_id % 7 * event_id AS BIGINT) - 3 AS s FROM events)
SELECT event_id, CASE WHEN s < 0 THEN '' WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm' || CASE WHEN s % 60 > 0 THEN ' ' || s % 60 || 's' ELSE '' END ELSE s // 3600 || 'h' || CASE WHEN s % 3600 // 60 > 0 THEN ' ' || s % 3600 // 60 || 'm' ELSE '' END END AS spent,
  CAST(floor(value * 100 + 0.5) AS BIGINT) || '%' AS share, event_type IN ('error') AS fatal, CASE event_type WHEN 'click' THEN 'Order' || event_id % 5 WHEN 'view' THEN 'Plain' WHEN 'error' THEN 'Derived semantic scenarios' ELSE 'a' || event_id % 3 END AS owner,
  CASE event_type WHEN 'click' THEN 'Order' || event_id % 5 || 'Impl' WHEN 'error' THEN 'scenario:' END AS class FROM e""")
def run_helpers(spark: SparkSession, sf: str) -> DataFrame:
    """Times, shares, severities and scenario subjects made of events."""
    e, kind = c("event_id"), c("event_type")
    number = lambda n: (e % n).cast("string")
    subject = F.when(kind == "click", F.concat(F.lit("scenario:operation:org.x.Order"), number(5), F.lit("Impl#run"))).when(kind == "view", "job:Plain").when(kind == "error", "scenario:#x").otherwise(F.concat(F.lit("a"), number(3)))
    start = F.timestamp_seconds(F.lit(1_700_000_000))
    return table(spark, sf, "events").select("event_id", fx.elapsed(start, F.timestamp_seconds(F.lit(1_700_000_000) + e % 7 * e - 3)).alias("spent"), fx.percent(c("value")).alias("share"), fx.fatal(kind).alias("fatal"), fx.scenario_owner(subject).alias("owner"), fx.scenario_class(subject).alias("class"))


@query("""WITH o AS (SELECT *, o_orderkey % 5 AS k FROM orders)
SELECT o_orderkey, CASE WHEN k IN (0, 3) THEN o_orderstatus = 'F' WHEN k = 1 THEN false END AS nullable, CASE WHEN k = 2 THEN true END AS key, CASE k WHEN 3 THEN 'ManyToOne' WHEN 4 THEN 'OneToMany' END AS relation,
  CASE WHEN k = 4 AND trim(o_orderpriority) <> '' THEN replace(o_orderpriority, '"', '') ELSE 'order' || o_orderkey END AS bean, CASE k WHEN 0 THEN 'GET' WHEN 2 THEN 'PUT' WHEN 1 THEN upper(o_orderstatus) || 'X' END AS verb,
  CASE k WHEN 0 THEN '/a|/b' || o_orderkey WHEN 1 THEN '' ELSE '/x' END AS paths, CASE o_orderstatus WHEN 'F' THEN 'protected' WHEN 'O' THEN 'public' ELSE 'package' END AS visibility, CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 4 THEN 1 ELSE 0 END AS validations FROM o""")
def annotation_helpers(spark: SparkSession, sf: str) -> DataFrame:
    """What annotations say that are made of orders: null, identity, relation, bean name, verb, paths, visibility, constraints."""
    k, status = c("o_orderkey") % 5, c("o_orderstatus")
    none = F.create_map().cast("map<string,string>")
    mark = lambda name, values=none, package="x": F.struct(F.lit(name).alias("name"), F.lit(f"{package}.{name}").alias("qualified_name"), values.alias("values"))
    value = lambda key, v: F.create_map(F.lit(key), v.cast("string"))
    quoted = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    key = c("o_orderkey").cast("string")
    marks = (
        F.when(k == 0, F.array(mark("Column", value("nullable", F.when(status == "F", "TRUE").otherwise("no"))), mark("NotNull"), mark("GetMapping", value("path", quoted('"/a", "/b', key, '",')))))
        .when(k == 1, F.array(mark("NotBlank"), mark("RequestMapping", value("method", quoted("RequestMethod.", F.upper(status), "X"))), mark("Odd", none, "jakarta.validation")))
        .when(k == 2, F.array(mark("EmbeddedId"), mark("PutMapping", value("value", F.lit('"/x"')))))
        .when(k == 3, F.array(mark("Other"), mark("ManyToOne"), mark("JoinColumn", value("nullable", (status == "F")))))
        .otherwise(F.array(mark("OneToMany"), mark("Size"), mark("Service", value("value", quoted('"', c("o_orderpriority"), '"')))))
    )
    row = table(spark, sf, "orders").select("o_orderkey", status, marks.alias("marks"))
    m, mapping = c("marks"), F.get(F.filter("marks", lambda a: a["name"].endswith("Mapping")), F.lit(0))
    paths = F.when(mapping["name"] == "GetMapping", F.array_join(fx.annotation_values(m, "GetMapping", "path"), "|")).when(mapping["name"] == "RequestMapping", fx.annotation_attribute(m, ("RequestMapping",), ("path", "value"), F.lit("")))
    seen = F.when(status == "F", F.array(F.lit("static"), F.lit("protected"))).when(status == "O", F.array(F.lit("public"))).otherwise(F.array().cast("array<string>"))
    return row.select(
        "o_orderkey", fx.explicit_nullable(m).alias("nullable"), fx.explicit_key(m).alias("key"), fx.relation_type(m).alias("relation"), fx.bean_name(F.concat(F.lit("Order"), key), m).alias("bean"), fx.http_verb(mapping["name"], mapping["values"]["method"]).alias("verb"),
        F.coalesce(paths, fx.annotation_attribute(m, ("PutMapping",), ("path", "value"), F.lit("/x"))).alias("paths"), fx.visibility(seen).alias("visibility"), F.size(F.filter(m, fx.is_validation)).alias("validations"),
    )


@query("""SELECT page_id, replace(replace(url, '/en/', '/db/migration/'), '/de/', '/Liquibase/changelog/') AS path, CASE WHEN contains(url, '/de/') THEN 'liquibase' ELSE 'flyway' END AS tool,
  CASE WHEN contains(url, '/de/') THEN regexp_extract(replace(url, '/de/', '/Liquibase/changelog/'), '^(.*)[/][^/]*$', 1) END AS collection FROM pages WHERE contains(url, '/en/') OR contains(url, '/de/')""")
def migration_files(spark: SparkSession, sf: str) -> DataFrame:
    """Pages taken for files: English ones lie in a migration folder, German ones in a changelog's."""
    path = F.replace(F.replace(c("url"), F.lit("/en/"), F.lit("/db/migration/")), F.lit("/de/"), F.lit("/Liquibase/changelog/"))
    pages = table(spark, sf, "pages").select("page_id", path.alias("path"))
    return pages.join(scans.migration_files(pages).distinct(), "path").select("page_id", "path", "tool", "collection")


@query("""WITH s AS (SELECT 'x' || c_nationkey AS owner, c_custkey % 3 + c_custkey % 5 + 1 AS steps FROM customer WHERE c_acctbal <= 5000 UNION ALL SELECT c_mktsegment, c_custkey % 3 + c_custkey % 5 + 1 FROM customer WHERE c_acctbal > 5000)
SELECT owner, count(*) AS n, CAST(sum(steps) AS BIGINT) AS steps FROM s GROUP BY 1""")
def grouped_scenarios(spark: SparkSession, sf: str) -> DataFrame:
    """Customers taken for scenarios; rich ones cite a class named by their segment."""
    k = c("c_custkey")
    steps = lambda n: F.array_repeat(F.lit("step"), n.cast("int"))
    cited = F.when(c("c_acctbal") > 5000, F.array(F.lit(""), F.concat(F.lit("job:org.x."), c("c_mktsegment"), F.lit("Impl#run")))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf, "customer").select(F.concat(F.lit("scenario:x"), c("c_nationkey").cast("string"), F.lit("#"), k.cast("string")).alias("id"), c("c_name").alias("name"), cited.alias("cited"), steps(k % 3).alias("given"), steps(k % 5).alias("when"), steps(F.lit(1)).alias("then"))
    return document.grouped_scenarios(rows)


@query("""WITH s AS (SELECT 'c' || c_custkey AS id, c_custkey % 4 AS k, c_nationkey < 10 AS m FROM customer)
SELECT id, unnest(list_concat(CASE WHEN k = 0 THEN ['SCHEMA_VERSION_UNSUPPORTED'] ELSE [] END, CASE WHEN k = 1 THEN ['SERVICE_NAME_REQUIRED'] ELSE [] END, CASE WHEN k <> 2 THEN ['GENERATOR_LOCK_REQUIRED'] ELSE [] END, CASE WHEN m AND k < 2 THEN ['MESSAGING_IDEMPOTENCY_REQUIRED'] ELSE [] END)) AS code FROM s""")
def top_level_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Customers taken for specifications."""
    k = c("c_custkey") % 4
    specs = table(spark, sf, "customer").select(
        F.concat(F.lit("c"), c("c_custkey").cast("string")).alias("id"), F.when(k == 0, 2).when(k > 0, 1).alias("schema_version"), F.when(k == 1, " \t").otherwise(c("c_name")).alias("service_name"), F.when(k == 2, "1.0").when(k == 3, " ").alias("generator_lock"),
        (c("c_nationkey") < 10).alias("has_messaging"), F.when(k == 0, "").when(k == 1, None).otherwise("id").alias("idempotency_key"),
    )
    return document.top_level_problems(specs)


ISSUES_SQL = f"""{CITES_SQL}, left_over AS (SELECT * FROM cites WHERE right(node, 1) <> '7'), items AS (SELECT DISTINCT owner_id AS id FROM cites),
issues AS (SELECT 'EVIDENCE_REQUIRED' AS code, id AS item_id, 'ERROR' AS level FROM items WHERE NOT starts_with(id, 'operation:') AND id NOT IN (SELECT owner_id FROM left_over)
  UNION ALL SELECT 'EVIDENCE_NODE_UNKNOWN', owner_id, 'ERROR' FROM left_over JOIN n ON n.id = node WHERE NOT starts_with(owner_id, 'operation:') AND n.kind = 'security-constraint')"""


def _broken(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, nodes, issues) of the synthesized document without the citations of nodes that end in 7, and with the security constraints taken for lost."""
    nodes, refs = evidence_nodes(spark, sf)
    items, citations = (written(x, "document") for x in document.synthesize(spark, written(nodes, "nodes"), refs))
    return items, nodes, document.validate(items, citations.filter(~c("evidence_node_id").endswith("7")), nodes.filter("kind <> 'security-constraint'"))


@query(f"WITH {ISSUES_SQL} SELECT * FROM issues")
def document_issues(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with a document that lost citations and nodes."""
    return _broken(spark, sf)[2]


@query(f"WITH {ISSUES_SQL} SELECT id, (SELECT count(*) FROM issues) = 0 AS valid FROM n WHERE kind = CASE WHEN (SELECT count(*) FROM issues) = 0 THEN 'project' ELSE 'documentation-section' END")
def candidate_or_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Projects if the document is valid, else sections of documentation, and whether it is."""
    _, nodes, issues = _broken(spark, sf)
    issues = written(issues, "issues")
    chosen = document.valid_or_fallback(nodes.filter("kind = 'project'").select("id"), issues, nodes.filter("kind = 'documentation-section'").select("id"))
    return chosen.join(F.broadcast(document.is_valid(issues)), how="cross")


@query("""WITH t AS (SELECT o_orderkey, o_custkey % 4 AS a, o_orderkey % 3 AS b FROM orders)
SELECT o_orderkey, CASE WHEN a = 0 AND b = 0 THEN '/' ELSE array_to_string(CASE WHEN a = 0 THEN list_transform(range(b), lambda j: 'p' || j || '/') WHEN b = 0 THEN list_transform(range(a), lambda i: '//v' || i) ELSE flatten(list_transform(range(a), lambda i: list_transform(range(b), lambda j: '/v' || i || '/p' || j || '/'))) END, ' ') END AS paths FROM t""")
def combined_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Up to three prefixes before up to two paths for each order."""
    listed = lambda n, before, after: F.transform(F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit(before), i.cast("string"), F.lit(after)))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(lookup.combined_paths(listed(c("o_custkey") % 4, "//v", ""), listed(c("o_orderkey") % 3, "p", "/")), " ").alias("paths"))


# The graph of evidence, and files

_STATEMENTS_SQL = r"""statements AS (SELECT DISTINCT doc_id, trim(replace(v, ';', '')) AS s FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS v FROM documents) WHERE starts_with(v, 'T'))"""


@query(f"""WITH {_STATEMENTS_SQL}, c AS (SELECT * FROM customer), o AS (SELECT * FROM orders), p AS (SELECT count(*) AS n FROM pages), l AS (SELECT count(DISTINCT l_orderkey || ':' || l_linenumber) AS n FROM lineitem),
k AS (SELECT count(*) FILTER (page_id % 4 = 0) AS md, count(*) FILTER (page_id % 4 = 1) AS api, count(*) FILTER (page_id % 4 = 2) AS sql, count(*) FILTER (page_id % 4 = 3) AS conf FROM pages),
found(part, kind, n) AS (
  SELECT 'node', 'project', 1 UNION ALL SELECT 'node', 'source-file', count(*) FROM documents UNION ALL SELECT 'edge', 'CONTAINS', (SELECT count(*) FROM documents) + 2 * md FROM k UNION ALL SELECT 'node', 'import', count(*) FROM statements UNION ALL SELECT 'edge', 'IMPORTS', count(*) FROM statements
  UNION ALL SELECT 'node', 'java-type', count(*) FROM c UNION ALL SELECT 'node', 'annotation', count(*) FROM c WHERE c_acctbal > 0 UNION ALL SELECT 'edge', 'ANNOTATED_WITH', count(*) FROM c WHERE c_acctbal > 0 UNION ALL SELECT 'node', 'java-method', count(*) FROM o
  UNION ALL SELECT 'node', 'method-parameter', n FROM l UNION ALL SELECT 'edge', 'DECLARES', (SELECT count(*) FROM o) + l.n + k.api + (SELECT count(*) FROM o WHERE o_orderstatus = 'P') FROM l, k
  UNION ALL SELECT 'node', 'literal', count(*) FROM o WHERE o_totalprice > 100000 UNION ALL SELECT 'edge', 'USES_LITERAL', count(*) FROM o WHERE o_totalprice > 100000
  UNION ALL SELECT 'node', 'call-target', count(DISTINCT o_orderkey % 1000 || o_orderstatus) FROM o WHERE o_orderkey % 1000 NOT IN (SELECT c_custkey FROM c) UNION ALL SELECT 'edge', 'CALLS', count(*) FROM o
  UNION ALL SELECT 'node', 'http-endpoint', count(*) FROM nation UNION ALL SELECT 'edge', 'EXPOSES', count(*) FROM nation WHERE n_regionkey > 1 UNION ALL SELECT 'node', 'persistence-entity', count(*) FROM region UNION ALL SELECT 'edge', 'PERSISTS', count(*) FROM region
  UNION ALL SELECT 'node', 'bean', count(*) FROM supplier UNION ALL SELECT 'edge', 'BACKED_BY', (SELECT count(*) FROM supplier) UNION ALL SELECT 'node', 'validation-constraint', count(*) FROM part UNION ALL SELECT 'edge', 'CONSTRAINS', count(*) FROM part
  UNION ALL SELECT 'node', 'security-constraint', count(*) FROM nation UNION ALL SELECT 'edge', 'SECURES', count(*) FROM nation
  UNION ALL SELECT 'node', 'documentation-file', md FROM k UNION ALL SELECT 'node', 'documentation-section', 2 * md FROM k UNION ALL SELECT 'node', 'openapi-contract', api FROM k UNION ALL SELECT 'node', 'contract-operation', api FROM k
  UNION ALL SELECT 'node', 'database-migration', sql FROM k UNION ALL SELECT 'node', 'integration-config', conf FROM k UNION ALL SELECT 'node', 'scheduled-job', count(*) FROM o WHERE o_orderstatus = 'P'
  UNION ALL SELECT 'ref', 'line', 2 * md + api FROM k)
SELECT part, kind, CAST(n AS BIGINT) AS n FROM found WHERE n > 0""")
def evidence_graph(spark: SparkSession, sf: str) -> DataFrame:
    """How many nodes, edges and refs of each kind the graph has that is built from a code model made of all tables, and from pages as documents, contracts, migrations and configuration."""
    key = lambda p, name: F.concat(F.lit(p), c(name).cast("string"))
    typed = lambda schema: F.expr(f"CAST(array() AS {schema})")
    none = typed(schemas._PROVENANCE).alias("provenance")
    mark = lambda when, name: F.when(when, F.array(F.struct(F.lit(name).alias("name"), F.lit(f"x.{name}").alias("qualified_name"), F.create_map().cast("map<string,string>").alias("values")))).otherwise(typed(schemas._ANNOTATIONS)).alias("annotations")
    zero, text = F.lit(0).cast("long").alias("ordinal"), lambda x: F.lit(x).cast("string")
    docs = table(spark, sf, "documents").select(F.concat(F.lit("src/"), c("doc_id").cast("string"), F.lit(".java")).alias("path"), F.regexp_replace("text", "(?m)^T", "import T").alias("text"))
    pages = table(spark, sf, "pages").select(F.when(c("page_id") % 4 == 0, key("docs/", "page_id")).alias("doc"), "page_id")
    kind = c("page_id") % 4
    path = F.when(kind == 0, F.concat(key("docs/", "page_id"), F.lit(".md"))).when(kind == 1, F.concat(key("api/openapi-", "page_id"), F.lit(".yaml"))).when(kind == 2, F.concat(key("src/db/migration/V", "page_id"), F.lit(".sql"))).otherwise(F.concat(key("conf/", "page_id"), F.lit(".properties")))
    body = F.when(kind == 0, "# Title\nwords\n## Part\n").when(kind == 1, "paths:\n  /things:\n    get:\n").when(kind == 2, "create table x").otherwise("bootstrap = Kafka:9092")
    resources = pages.select(path.alias("path"), body.alias("text"))
    t = table(spark, sf, "customer").select(key("c", "c_custkey").alias("id"), F.concat(F.lit("a."), key("C", "c_custkey")).alias("qualified_name"), key("C", "c_custkey").alias("simple_name"), F.lit("a").alias("package_name"), F.lit("class").alias("kind"), mark(c("c_acctbal") > 0, "Entity"), none, c("c_custkey").cast("long").alias("ordinal"))
    called = F.struct(F.concat(F.lit("a.C"), (c("o_orderkey") % 1000).cast("string")).alias("owner_type"), c("o_orderstatus").alias("method_name"))
    literals = F.when(c("o_totalprice") > 100000, F.array(c("o_orderpriority"), F.lit(" "))).otherwise(F.array().cast("array<string>"))
    m = table(spark, sf, "orders").select(
        key("c", "o_custkey").alias("type_id"), key("o", "o_orderkey").alias("id"), c("o_orderstatus").alias("name"), F.lit("void").alias("return_type"), F.lit("public").alias("visibility"), mark(c("o_orderstatus") == "P", "Scheduled"),
        F.struct(F.lit("").alias("normalized_source"), F.array(called).alias("call_edges"), literals.alias("literals")).alias("body"), none, zero,
    )
    p = table(spark, sf, "lineitem").select(key("o", "l_orderkey").alias("method_id"), F.concat(key("p", "l_orderkey"), F.lit(":"), c("l_linenumber").cast("string")).alias("id"), F.lit("x").alias("name"), F.lit("int").alias("type"), zero)
    nation, one = table(spark, sf, "nation"), table(spark, sf, "region")
    endpoints = nation.select(key("e", "n_nationkey").alias("id"), F.when(c("n_regionkey") > 1, key("m", "n_nationkey")).alias("method_id"), F.lit("b").alias("bean_name"), F.lit("GET").alias("http_method"), F.lit("/x").alias("full_path"), none, zero)
    tables = {
        "files": docs, "lines": files.lines(docs), "types": t, "methods": m, "params": p, "endpoints": endpoints, "resources": resources, "resource_lines": files.lines(resources),
        "entities": one.select(key("j", "r_regionkey").alias("id"), key("c", "r_regionkey").alias("type_id"), c("r_name").alias("table_name"), zero),
        "beans": table(spark, sf, "supplier").select(key("b", "s_suppkey").alias("id"), c("s_name").alias("name"), key("c", "s_suppkey").alias("type_id"), text("singleton").alias("scope"), zero),
        "validations": table(spark, sf, "part").select(key("v", "p_partkey").alias("id"), key("o", "p_partkey").alias("target_id"), F.lit("NotNull").alias("annotation"), zero),
        "securities": nation.select(key("s", "n_nationkey").alias("id"), key("o", "n_nationkey").alias("target_id"), F.lit("role").alias("kind"), F.lit("x").alias("expression"), zero),
    }
    graph, _ = snapshot.build(spark, tables, "/work/thing")
    counts = lambda rows, part: rows.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "kind", "n")
    return counts(graph.nodes, "node").unionByName(counts(graph.edges, "edge")).unionByName(counts(graph.refs.select(F.lit("line").alias("kind")), "ref"))


@query("""WITH l AS (SELECT lang, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS value FROM documents WHERE text IS NOT NULL)
SELECT CASE lang WHEN 'en' THEN 'docs' WHEN 'de' THEN 'api' ELSE 'src/main/resources' END AS folder, value, count(*) AS n FROM l WHERE value <> '' GROUP BY ALL""")
def resource_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written to files of a project's resource folders, which are found, read whole and cut into lines again; English ones are docs, German ones contracts."""
    root = temporary(spark, "project")
    docs = table(spark, sf, "documents").filter("text IS NOT NULL").select("lang", "text")
    for folder, own in (("docs", c("lang") == "en"), ("api", c("lang") == "de"), ("src/main/resources", ~c("lang").isin("en", "de"))):
        docs.filter(own).select("text").write.text(f"{root}/{folder}")
    rows = files.lines(files.resource_files(spark, root).filter(~c("path").endswith("_SUCCESS"))).filter("value <> ''")
    folder = F.when(F.contains("path", F.lit("/docs/")), "docs").when(F.contains("path", F.lit("/api/")), "api").otherwise("src/main/resources")
    return rows.groupBy(folder.alias("folder"), "value").agg(F.count("*").alias("n"))


@query("""SELECT 'nodes' AS name, 'c' || c_custkey AS id, c_mktsegment AS kind, c_name AS label FROM customer UNION ALL SELECT 'suppliers', 's' || s_suppkey, NULL, s_name FROM supplier""")
def run_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """Tables written as a run's artifacts, found again by its manifest; and JSON artifacts read with a fixed schema, which ignores what it doesn't know."""
    folder = temporary(spark, "artifacts")
    nodes = table(spark, sf, "customer").select(F.concat(F.lit("c"), c("c_custkey").cast("string")).alias("id"), c("c_mktsegment").alias("kind"), c("c_name").alias("label"))
    files.write_artifacts({"nodes": nodes.limit(0), "edges": nodes.limit(0)}, folder, "run-0")
    files.write_artifacts({"nodes": nodes}, folder, "run-1")
    manifest = spark.read.schema("run_id string, name string, path string").json(f"{folder}/manifest/run-1").first()
    supplier = F.struct(F.concat(F.lit("s"), c("s_suppkey").cast("string")).alias("id"), c("s_name").alias("label"), "s_acctbal")
    table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.to_json(F.collect_list(supplier)).alias("value")).repartition("s_nationkey").write.partitionBy("s_nationkey").text(f"{folder}/json")  # an array a file
    read = spark.read.schema(nodes.schema).parquet(manifest.path)
    other = files.json_artifact(spark, f"{folder}/json", "id string, kind string, label string")
    return read.select(F.lit(manifest.name).alias("name"), "id", "kind", "label").unionByName(other.select(F.lit("suppliers").alias("name"), "id", "kind", "label"))


@query("""SELECT 'org.x' || min(doc_id) || '.App' || min(doc_id) AS name FROM documents WHERE lang = 'fr' AND lpad(CAST(doc_id AS VARCHAR), 9, '0') = (SELECT min(lpad(CAST(doc_id AS VARCHAR), 9, '0')) FROM documents WHERE lang = 'fr')""")
def boot_class(spark: SparkSession, sf: str) -> DataFrame:
    """The entry class among documents taken for source files: French ones have one behind their text."""
    key = c("doc_id").cast("string")
    code = F.when(c("lang") == "fr", F.concat(F.lit("package org.x"), key, F.lit(";\n"), F.coalesce("text", F.lit("")), F.lit("\n@SpringBootApplication\npublic class App"), key, F.lit(" {}"))).otherwise(c("text"))
    return files.boot_class(table(spark, sf, "documents").select(F.lpad(key, 9, "0").alias("path"), code.alias("text")))


# A draft specification: suppliers as entities, orders as methods and endpoints, line items as parameters and constraints

DRAFT_SQL = """methods AS (SELECT 'org.x.Thing' || o_orderkey % 30 || 'Controller#m' || o_orderkey AS id, 'do' || o_orderstatus || o_orderkey % 3 AS name, o_orderkey AS k, o_orderstatus AS st, o_orderpriority AS pr FROM orders),
params AS (SELECT 'org.x.Thing' || l_orderkey % 30 || 'Controller#m' || l_orderkey AS method_id, CASE l_linenumber WHEN 1 THEN 'orderId' WHEN 2 THEN 'ID' ELSE 'p' || l_linenumber END AS name, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 100000 + l_suppkey AS ordinal, l_quantity FROM lineitem),
inputs AS (SELECT method_id, string_agg(name, ',' ORDER BY ordinal) AS input, arg_min(name, ordinal) FILTER (lower(name) = 'id' OR ends_with(name, 'Id')) AS idish FROM params GROUP BY 1),
constraints AS (SELECT method_id, 0 AS part, ordinal, name || ' must satisfy @Max' AS text, 'validation' AS kind FROM params WHERE l_quantity > 45 UNION ALL SELECT id, 0, 0, name || ' must satisfy @Valid', 'validation' FROM methods WHERE pr = '1-URGENT' UNION ALL SELECT id, 1, 0, 'role ' || st, 'security' FROM methods WHERE st = 'P'),
numbered AS (SELECT c.*, row_number() OVER (PARTITION BY method_id ORDER BY part, ordinal) AS n FROM constraints c),
ruled AS (SELECT method_id, string_agg(lower(m.name) || '-' || kind || '-v' || n || '=' || text, ',' ORDER BY n) AS rules FROM numbered JOIN methods m ON m.id = method_id GROUP BY 1),
ends AS (SELECT k, 'Thing' || k % 30 AS aggregate, upper(name[1:1]) || name[2:] AS name, '/v1/' || k AS path, coalesce(input, '') AS input, idish, coalesce(rules, '') AS rules,
    CASE k % 4 WHEN 0 THEN 'Given o.id is provided>Then the operation completes successfully' WHEN 2 THEN '>Then throws LateException' ELSE '' END AS told FROM methods m LEFT JOIN inputs i ON i.method_id = m.id LEFT JOIN ruled r ON r.method_id = m.id WHERE k % 2 = 0
  UNION ALL SELECT o_orderkey, 'Act' || o_orderkey % 7, 'Act' || o_orderkey % 7, '/v1/things/{id}/act' || o_orderkey % 7 || '/{x}', '', NULL, '', '' FROM orders WHERE o_orderkey % 10 = 1),
commands AS (SELECT aggregate, string_agg(name || '(' || input || ')' || path || '[' || rules || ']' || told, ';' ORDER BY name, k) AS commands, arg_min(idish, name || lpad(CAST(k AS VARCHAR), 12, '0')) FILTER (idish IS NOT NULL) AS idish FROM ends GROUP BY 1),
ents AS (SELECT s_suppkey AS k, 'Thing' || s_nationkey AS aggregate, CASE s_suppkey % 4 WHEN 0 THEN 'Thing' || s_nationkey || CASE s_suppkey % 3 WHEN 0 THEN 'Service' WHEN 1 THEN 'Impl' ELSE '' END || 'Entity' WHEN 1 THEN 'KnownEntity' ELSE 'Known' || s_suppkey || 'Entity' END AS name, s_suppkey % 2 = 0 AS keyed FROM supplier),
entities AS (SELECT aggregate, string_agg(name || '(bal:double,suppId:long)', ';' ORDER BY k) AS entities, bool_or(keyed) AS keyed FROM ents GROUP BY 1)"""


@query(f"""WITH {DRAFT_SQL} SELECT coalesce(e.aggregate, c.aggregate) AS aggregate, CASE WHEN keyed THEN 'suppId' ELSE idish END AS field, CASE WHEN keyed THEN 'long' ELSE 'String' END AS type, coalesce(entities, '') AS entities, coalesce(commands, '') AS commands
FROM entities e FULL JOIN commands c ON c.aggregate = e.aggregate""")
def draft_specification(spark: SparkSession, sf: str) -> DataFrame:
    """Aggregates with their identity, entities and commands, written as text."""
    text = lambda x: x.cast("string")
    method_id = lambda k: F.concat(F.lit("org.x.Thing"), text(k % 30), F.lit("Controller#m"), text(k))
    k, status = c("o_orderkey"), c("o_orderstatus")
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    source = F.when(k % 4 == 0, "if (o.id == null) return").when(k % 4 == 2, "throw new LateException (x)").otherwise("go()")
    m = orders.select(method_id(k).alias("id"), F.concat(F.lit("do"), status, text(k % 3)).alias("name"), F.struct(source.alias("normalized_source")).alias("body"))
    number = c("l_linenumber")
    ordinal = number.cast("long") * 1_000_000_000_000 + c("l_partkey") * 100_000 + c("l_suppkey")
    param = F.concat(method_id(c("l_orderkey")), F.lit("/"), text(ordinal))
    p = lines.select(method_id(c("l_orderkey")).alias("method_id"), param.alias("id"), F.when(number == 1, "orderId").when(number == 2, "ID").otherwise(F.concat(F.lit("p"), text(number))).alias("name"), F.lit("int").alias("type"), F.lit(None).cast("boolean").alias("nullable"), ordinal.alias("ordinal"))
    ends = orders.filter(k % 2 == 0).select(method_id(k).alias("method_id"), F.lit("POST").alias("http_method"), F.concat(F.lit("/v1/"), text(k)).alias("full_path"), k.alias("ordinal"))
    ends = ends.unionByName(orders.filter(k % 10 == 1).select(F.lit("gone#x").alias("method_id"), F.lit("POST").alias("http_method"), F.concat(F.lit("/v1/things/{id}/act"), text(k % 7), F.lit("/{x}")).alias("full_path"), k.alias("ordinal")))
    checks = lines.filter("l_quantity > 45").select(F.lit("v").alias("id"), param.alias("target_id"), F.lit("Max").alias("annotation"), ordinal.alias("ordinal"))
    checks = checks.unionByName(orders.filter("o_orderpriority = '1-URGENT'").select(F.lit("v").alias("id"), method_id(k).alias("target_id"), F.lit("Valid").alias("annotation"), F.lit(0).cast("long").alias("ordinal")))
    guards = orders.filter("o_orderstatus = 'P'").select(F.lit("s").alias("id"), method_id(k).alias("target_id"), F.lit("role").alias("kind"), status.alias("expression"), F.lit(0).cast("long").alias("ordinal"))
    n = c("s_suppkey")
    type_id = F.concat(F.lit("org.x.Thing"), text(c("s_nationkey")), F.when(n % 3 == 0, "Service").when(n % 3 == 1, "Impl").otherwise(""), F.when(n % 4 != 0, F.concat(F.lit("/"), text(n))).otherwise(""))
    suppliers = table(spark, sf, "supplier").withColumn("type_id", F.substring_index(type_id, "/", 1)).withColumn("own", F.concat("type_id", F.lit("@"), text(n)))
    attribute = lambda name, kind: F.struct(F.lit(name).alias("field_name"), F.lit(kind).alias("type"), F.lit(name == "suppId").alias("pk"), F.lit(None).cast("boolean").alias("nullable"))
    # known classes have ids of their own, which the role suffix and the number behind it don't change
    entities = suppliers.select(F.when(n % 4 == 0, c("type_id")).otherwise(F.concat(F.lit("k"), text(n), F.lit("."), F.substring_index("type_id", ".", -1))).alias("type_id"), c("s_name").alias("table_name"), F.when(n % 2 == 0, F.array(F.lit("org.x#suppId"))).otherwise(F.array().cast("array<string>")).alias("id_fields"), F.array(attribute("suppId", "long"), attribute("bal", "double")).alias("attributes"), n.alias("ordinal"))
    types = entities.filter(c("ordinal") % 4 != 0).select(c("type_id").alias("id"), F.when(c("ordinal") % 4 == 1, "KnownEntity").otherwise(F.concat(F.lit("Known"), text(c("ordinal")))).alias("simple_name"))
    listed = lambda items, one, between: F.array_join(F.transform(items, one), between)
    told = lambda s: F.when(s.isNull(), "").otherwise(F.concat(F.array_join(s["given"], "|"), F.lit(">"), F.array_join(s["then"], "|")))
    entity = lambda e: F.concat(e["name"], F.lit("("), listed(e["fields"], lambda f: F.concat_ws(":", f["name"], f["type"]), ","), F.lit(")"))
    command = lambda x: F.concat(x["name"], F.lit("("), listed(x["input"], lambda f: f["name"], ","), F.lit(")"), x["path"], F.lit("["), listed(x["rules"], lambda r: F.concat(r["id"], F.lit("="), r["ensure"]), ","), F.lit("]"), told(x["scenario"]))
    return draft.draft_texts(types, m, p, ends, entities, checks, guards, (entity, command))


# Chips and branch conditions

_CHIP_KINDS = ("service", "interface", "operation", "datastore", "integration", "workflow", "rule", "scenario", "note")


@query(f"""WITH n AS (SELECT c_custkey, {list(_CHIP_KINDS)}[CAST(c_custkey % 9 + 1 AS INTEGER)] AS kind, c_nationkey AS a, c_custkey % 4 AS b, c_custkey % 3 AS w, c_custkey % 5 AS e, c_name, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE '' END AS fact FROM customer),
parts AS (SELECT *, CASE kind WHEN 'service' THEN [a || ' interfaces', b || ' data stores'] WHEN 'interface' THEN [a || ' operations', fact] WHEN 'operation' THEN [trim(upper(fact) || ' ' || c_name)] WHEN 'datastore' THEN [c_name] WHEN 'integration' THEN [fact, 'mq'] ELSE [fact] END AS own FROM n)
SELECT c_custkey, array_to_string(list_filter(list_concat(own, [CASE WHEN b > 0 THEN b || ' blocking' WHEN w > 0 THEN w || ' warnings' ELSE '' END, CASE WHEN e > 0 THEN e || ' evidence' ELSE 'No evidence' END]), lambda x: x <> '')[:4], '|') AS chips,
  array_to_string(list_filter(['fact=' || fact, 'name=' || c_name], lambda x: NOT ends_with(x, '=')), '|') AS kept FROM parts""")
def node_chips(spark: SparkSession, sf: str) -> DataFrame:
    """Chips of lineage nodes of all kinds, and metadata without empty values, made of customers."""
    k = c("c_custkey")
    fact = F.when(c("c_acctbal") > 0, c("c_mktsegment")).otherwise("")
    metadata = F.create_map(*(x for name in ("protocol", "method", "direction", "summary", "statement", "then", "detail") for x in (F.lit(name), fact)), F.lit("kind"), F.lit("mq"))
    stats = {"bounded_contexts": c("c_nationkey"), "aggregates": k % 4, "commands": c("c_nationkey"), "blocking": k % 4, "warning": k % 3, "evidence": k % 5}
    kind = F.element_at(F.array(*map(F.lit, _CHIP_KINDS)), (k % 9 + 1).cast("int"))
    kept = fx.kept_metadata(F.create_map(F.lit("fact"), fact, F.lit("name"), c("c_name"), F.lit("none"), F.lit(None).cast("string")))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(runs.node_chips(kind, c("c_name"), metadata, stats), "|").alias("chips"), F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat_ws("=", e["key"], e["value"])), "|").alias("kept"))


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 6 AS k, 'x' || o_custkey AS v FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN v || '=true' WHEN 1 THEN v || '  && y=false' WHEN 2 THEN v || ' != null ||  z=true|' || v || '  || == null z=false' WHEN 3 THEN 'a=true|b=false' ELSE '' END AS checks FROM o""")
def null_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What branch conditions compare with null that are made of orders."""
    k, v = c("o_orderkey") % 6, F.concat(F.lit("x"), c("o_custkey").cast("string"))
    made = F.when(k == 0, F.array(F.concat(v, F.lit(" == null")))).when(k == 1, F.array(F.concat(v, F.lit(" != null && y")), F.lit("n > 1"))).when(k == 2, F.array(F.concat(v, F.lit(" != null || == null z")))).when(k == 3, F.array(F.lit("a == null"), F.lit("b != null"))).otherwise(F.array(F.lit("p"), F.lit("q.isNull()")))
    found = fx.null_checks(made)
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(F.transform(found, lambda x: F.concat_ws("=", x["text"], x["is_null"].cast("string"))), "|").alias("checks"))


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out

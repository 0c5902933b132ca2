"""Goldens on tiny tables: ids, names, trees, lineage, scans, snapshot, synthesis, validation, runs."""

import hashlib
import itertools
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillgraph import schemas
from quillgraph.functions import text as fx
from quillgraph.operators import compare, hierarchy, lookup, merge, numbering, retrieval, rules
from quillgraph.plans import canonical, document, draft, observed, queries, runs, snapshot
from quillgraph.sources import files, scans, store
from quillgraph.streaming import runs as live


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(x):
    return F.lit(x).cast("string") if x is None else F.lit(x)


# names and ids


@pytest.mark.parametrize(
    ("given", "want"),
    [("TaskRequest-v2 Name", "task_request_v2_name"), ("  Already_there ", "already_there"), (None, ""), ("ÉtatCivil", "état_civil"), ("a--b__c", "a_b_c")],
)
def test_canonical_token(spark, given, want):
    assert value(spark, fx.canonical_token(lit(given))) == want


def test_structural_ids(spark):
    assert value(spark, fx.field_id(F.lit("com.acme.Employee"), F.lit("id"))) == "com.acme.Employee#id"
    method = fx.method_id(F.lit("com.acme.EmployeeResource"), F.lit("getCurrent"), F.array(F.lit("java.util.UUID")))
    assert value(spark, fx.endpoint_id(method, F.lit("GET"), F.lit("/v1/employees/current"))) == "com.acme.EmployeeResource#getCurrent(java.util.UUID)::GET::/v1/employees/current"
    assert value(spark, fx.stable_id("doc", F.lit("a"), lit(None), F.lit(3))) == "doc:a::3"
    assert value(spark, fx.edge_id("CALLS", F.lit("x"), F.lit("y"))) == "edge:CALLS:x:y"
    body = fx.canonical_json(b=F.lit(1), a=lit(None), c=F.lit("z"))
    assert value(spark, body) == '{"b":1,"c":"z"}'
    same = [value(spark, fx.hashed_id("field", F.lit("n"), F.lit("s"), b)) for b in (body, body, fx.canonical_json(b=F.lit(2)))]
    assert same[0] == same[1] != same[2]


def test_suffixes_strip_to_a_fixpoint(spark):
    def loop(name):
        while True:
            for s in fx.ROLE_SUFFIXES:
                if name.endswith(s) and len(name) > len(s):
                    name = name[: -len(s)]
                    break
            else:
                return name

    parts = ("", "Task", "Impl", "Service", "Controller", "Facade", "Resource", "X")
    names = ["".join(p) for p in itertools.product(parts, repeat=3) if "".join(p)]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", fx.strip_suffixes(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in rows} == {n: loop(n) for n in names}


def test_small_text_functions(spark):
    assert value(spark, fx.normalize_path(F.lit("a//b"))) == "/a/b" and value(spark, fx.normalize_path(F.lit("  "))) == "/"
    assert value(spark, fx.relationship_name(F.lit("Uses_It"))) == "U____I_"
    assert value(spark, fx.command_name(F.lit("/v1/tasks/{id}/submit/{x}"))) == "submit"
    assert value(spark, fx.elapsed(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 02:05:09").cast("timestamp"))) == "2h 5m"
    spent = lambda n: value(spark, fx.elapsed(F.timestamp_seconds(F.lit(1)), F.timestamp_seconds(F.lit(1 + n))))
    assert [spent(n) for n in (0, 59, 60, 61, 3600, 3605, 7260, 90061, -1)] == ["0s", "59s", "1m", "1m 1s", "1h", "1h", "2h 1m", "25h 1m", ""]
    assert value(spark, fx.clean_line(F.lit("\x1b[31m  bad \t thing\x1b[0m "))) == "bad thing"
    assert [value(spark, fx.coerced_literal(F.lit(x))) for x in ("true", "12.5", "PT12H", "draft")] == ["boolean", "number", "duration", "string"]
    assert value(spark, fx.scenario_owner(F.lit("scenario:com.acme.OrderServiceImpl#place"))) == "OrderService"
    assert value(spark, fx.first_non_blank(lit(None), F.lit(" \t"), F.lit("x"))) == "x"
    assert [value(spark, fx.scenario_owner(lit(x))) for x in ("job:Nightly", "operation:a.b.CImpl", "scenario:job:x.YImplZ#q", "", None, "#x")] == ["Nightly", "C", "YImplZ", *["Derived semantic scenarios"] * 3]
    assert [value(spark, fx.scenario_class(lit(x))) for x in ("scenario:operation:a.b.C#m", "job:N#", "x.Y", "#m", None)] == ["C", "N", None, None, None]
    assert [value(spark, fx.coerced_literal(F.lit(x))) for x in ("1e5", "+3", "-7", "P1D", "PT", "007")] == ["string", "string", "number", "duration", None, "number"]
    verb = lambda name, method=None: value(spark, fx.http_verb(F.lit(name), lit(method)))
    assert [verb("GetMapping"), verb("RequestMapping"), verb("RequestMapping", "RequestMethod.POST"), verb("RequestMapping", "PUT"), verb("Get")] == ["GET", None, "POST", "PUT", None]
    assert [value(spark, fx.endpoint_command(lit(x), lit("GET"))) for x in ("/a/{b}", "/{a}/", " ", None)] == ["a", "Command", "getCommand", "getCommand"]
    assert [value(spark, fx.under_path(F.lit(x), F.lit("/a"))) for x in ("/a", "/a/b", "/a#b", "/ab", "/")] == [True, True, True, False, False]
    assert value(spark, fx.storage_type(F.lit("UUID"))) == "uuid" and value(spark, fx.storage_type(F.lit("Other"))) == "varchar(255)"
    assert value(spark, lookup.combined_paths(F.array(F.lit("/a"), F.lit("/b")), F.array().cast("array<string>"))) == ["/a", "/b"]
    texts = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    assert value(spark, lookup.combined_paths(texts("/a", "b/"), texts("c", "/d/"))) == ["/a/c", "/a/d/", "/b/c", "/b/d/"] and value(spark, lookup.combined_paths(texts(), texts())) == ["/"] and value(spark, lookup.combined_paths(texts(), texts("x"))) == ["x"]


# trees


@pytest.fixture(scope="module")
def explorer(spark):
    rows = [
        ("svc-orders", None, "Orders", 0, 8, 1, "/"), ("if-http", "svc-orders", "HTTP", 1, 2, 0, "/orders"), ("op-submit", "if-http", "SubmitOrder", 2, 1, 0, "/orders"),
        ("ds-orders", "svc-orders", "Orders DB", 3, 1, 0, "db"), ("int-payments", "svc-orders", "payments", 4, 0, 0, "payments"), ("wf-submit", "svc-orders", "Submit order", 5, 1, 1, "Submit order"),
    ]
    return spark.createDataFrame(rows, "id string, parent string, label string, ordinal long, evidence long, blocking long, path string")


def ids(df, order=None):
    return [r.id for r in (df.orderBy(order) if order else df).select("id").collect()]


def test_visible_tree_and_neighborhood(spark, explorer):
    none = spark.createDataFrame([], "id string")
    assert ids(hierarchy.visible_tree(explorer, none), "place") == ["svc-orders", "if-http", "ds-orders", "int-payments", "wf-submit"]
    opened = spark.createDataFrame([("if-http",)], "id string")
    assert ids(hierarchy.visible_tree(explorer, opened), "place") == ["svc-orders", "if-http", "op-submit", "ds-orders", "int-payments", "wf-submit"]
    assert set(ids(hierarchy.neighborhood(explorer, opened))) == {"if-http", "op-submit", "svc-orders"}
    assert set(ids(hierarchy.visible_filtered(explorer, F.col("blocking") > 0, none))) == {"svc-orders", "wf-submit"}
    assert set(ids(hierarchy.visible_filtered(explorer, F.col("evidence") == 0, none))) == {"svc-orders", "int-payments"}
    assert set(ids(hierarchy.visible_filtered(explorer, F.col("evidence") > 99, none))) == {"svc-orders", "if-http", "ds-orders", "int-payments", "wf-submit"}
    assert ids(hierarchy.expand_ancestors(explorer, spark.createDataFrame([("op-submit",)], "id string"))) == ["if-http"]


def test_longest_prefix_join(spark, explorer):
    nodes = explorer.select("id", "path", "ordinal")
    artifacts = spark.createDataFrame([(1, "/orders"), (2, "/orders/7"), (3, "/orders7"), (4, "Submit order"), (5, None)], "row long, path string")
    found = {r.row: r.owner for r in lookup.longest_prefix_join(artifacts, nodes, "row", "path", F.lit("svc-orders")).collect()}
    assert found == {1: "op-submit", 2: "if-http", 3: "svc-orders", 4: "wf-submit", 5: "svc-orders"}


def test_prefixes_against_brute_force(spark):
    rng = random.Random(2)
    paths = ["".join(rng.choice("ab/:#") for _ in range(rng.randrange(1, 8))) for _ in range(200)]
    node_paths = [(f"n{k}", "".join(rng.choice("ab/:#") for _ in range(rng.randrange(1, 5))), k) for k in range(60)]

    def owner(path):
        same = [n for n in node_paths if n[1] == path]
        if same:
            return max(same, key=lambda n: n[2])[0]
        fits = [n for n in node_paths if path.startswith(n[1]) and path[len(n[1])] in "/:#"]
        return min(fits, key=lambda n: (-len(n[1]), n[2]))[0] if fits else "root"

    found = lookup.longest_prefix_join(spark.createDataFrame(list(enumerate(paths)), "row long, path string"), spark.createDataFrame(node_paths, "id string, path string, ordinal long"), "row", "path", F.lit("root"))
    assert {r.row: r.owner for r in found.collect()} == {k: owner(p) for k, p in enumerate(paths)}


def test_rollup_of_citations(spark):
    items = [("svc-orders", "service", None), ("if-http", "interface", "svc-orders"), ("op-submit-order", "operation", "if-http")]
    items += [(i, k, "svc-orders") for i, k in (("ds-orders", "datastore"), ("int-payments", "integration"), ("wf-submit-order", "workflow"), ("rule-submit", "rule"), ("sc-happy-path", "scenario"), ("note-1", "note"))]
    table = spark.createDataFrame([(*x, x[0], n) for n, x in enumerate(items)], "id string, kind string, parent_id string, name string, ordinal long")
    cites = [(i, f"ev-{i}") for i, *_ in items] + [("svc-orders", "missing-evidence")]
    citations = spark.createDataFrame(cites, "owner_id string, evidence_node_id string")
    nodes = spark.createDataFrame([(f"ev-{i}",) for i, *_ in items], "id string")
    tree, edges = document.lineage(table, citations, nodes)
    counts = {r.id: (r.evidence, r.blocking) for r in tree.collect()}
    assert counts["op-submit-order"] == (1, 0) and counts["if-http"] == (2, 0) and counts["svc-orders"] == (8, 1)
    service = tree.filter("id = 'svc-orders'").first()
    assert [service[name] for name in ("warning", *document.COUNTED.values())] == [0, 1, 1, 1, 1, 1]
    assert [tree.filter("id = 'if-http'").first()[name] for name in document.COUNTED.values()] == [0, 0, 1, 0, 0]
    assert {r.id: r.parent_id for r in tree.collect() if r.id in ("svc-orders", "if-http", "op-submit-order", "ds-orders")} == {"svc-orders": None, "if-http": "svc-orders", "op-submit-order": "if-http", "ds-orders": "svc-orders"}
    labels = sorted(r.label for r in edges.collect())
    assert labels == sorted(["DECLARES", "DECLARES", "USES", "INTEGRATES_WITH", "RUNS", "CONSTRAINS", "DESCRIBES", "NOTES"])
    issues = {(r.code, r.item_id) for r in document.validate(table, citations, nodes).collect()}
    assert issues == {("EVIDENCE_NODE_UNKNOWN", "svc-orders")}
    bare = document.validate(table, citations.filter("owner_id <> 'note-1'"), nodes.limit(0))
    assert {(r.code, r.item_id) for r in bare.collect()} == {("EVIDENCE_REQUIRED", "note-1")} and not document.is_valid(bare).first().valid
    assert document.is_valid(bare.limit(0)).first().valid


def test_search(spark, explorer):
    nodes = explorer.select("id", "label", "path", F.lit("").alias("metadata"), F.lit("").alias("kind"))
    assert retrieval.search_topk(nodes, "payments").first().id == "int-payments"
    assert retrieval.search_topk(nodes, "SubmitOrder").first().id == "op-submit"


def test_retrieval_fallbacks(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["SERVICE orders", "note tax", "rule orders orders"])], "ordinal long, text string")
    assert [r.ordinal for r in retrieval.term_overlap_topk(docs, "is it ok", 2).collect()] == [0, 1]
    assert [r.ordinal for r in retrieval.bm25_topk(docs, "zzz", 2).collect()] == [0, 1]
    assert [r.ordinal for r in retrieval.bm25_topk(docs, "orders", 2).collect()] == [2, 0]


def test_many_questions_equal_one_after_the_other(spark):
    """The index answers as a scan for each question does: repeated terms, ties in document order, parts of words, questions without terms or hits, null and empty texts."""
    rng = random.Random(29)
    words = ["order", "orders", "tax", "Reorder", "note", "a", "ab", "service9", "état", "x-ray", "ord"]
    docs = spark.createDataFrame([(k, None if k == 5 else " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))) for k in range(60)], "ordinal long, text string").repartition(3)
    asked = ["orders orders tax", "ord", "zzz", "", None, "a", "x-ray Service9 note", "ÉTAT ab", "order of the note"]
    questions = spark.createDataFrame(list(enumerate(asked)), "question long, text string")
    index = retrieval.text_index(docs)
    for many, one in ((retrieval.bm25_questions, retrieval.bm25_topk), (retrieval.overlap_questions, retrieval.term_overlap_topk)):
        found = {}
        for r in many(index, questions, 7).collect():
            found.setdefault(r.question, {})[r.place] = (r.ordinal, round(float(r.score), 6))
        filled = docs.fillna("", ["text"])  # a null text has no score of its own when it is scanned
        for k, text in enumerate(asked):
            want = [(r.ordinal, round(float(r.score), 6)) for r in one(filled, text or "", 7).collect()]
            got = [found[k][p] for p in sorted(found[k])]
            assert [s for _, s in got] == [s for _, s in want] and sorted(found[k]) == list(range(1, 8))[: len(want)]
            assert got == sorted(got, key=lambda x: (-x[1], x[0])) and {d for d, s in got if s > want[-1][1]} == {d for d, s in want if s > want[-1][1]}


def test_searches_shuffle_only_the_best_of_each_task(spark, monkeypatch):
    """Of 200 texts that all hold the asked word, k rows a question and task leave the tasks, whether questions come in one pass or one by one."""
    docs = spark.createDataFrame([(k, "order " * (k % 7 + 1) + "note") for k in range(200)], "ordinal long, text string").repartition(2)
    questions = spark.createDataFrame([(k, "order note" if k % 2 else "note") for k in range(5)], "question long, text string")
    index, seen = retrieval.text_index(docs), {}
    keep = retrieval.written
    monkeypatch.setattr(retrieval, "written", lambda df, tag: seen.setdefault(tag, keep(df, tag)))
    scored = lambda search: sorted(map(tuple, search(index, questions, 3).collect()))
    one = scored(retrieval.bm25_questions)
    assert seen["scores"].count() <= 5 * 3 * index.texts.rdd.getNumPartitions()
    seen.clear()
    other = scored(retrieval.overlap_questions)
    seen.clear()
    plan = retrieval.overlap_questions(index, questions, 3)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(question#\d+L?, ordinal", plan)
    monkeypatch.setattr(retrieval, "QUESTIONS_AT_ONCE", 1)
    seen.clear()
    assert scored(retrieval.bm25_questions) == one
    seen.clear()
    assert scored(retrieval.overlap_questions) == other and len(other) == 15


def test_scenarios_seek_each_pattern_once(spark, sf):
    """The plan holds each of a body's patterns once, whatever is made of them; bodies without any have no scenario."""
    plan = queries.body_scenarios(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == len(fx.BODY_PATTERNS)
    bodies = spark.createDataFrame([("A", "if (x == null) a.save (y)"), ("B", "go()"), ("C", None), ("D", "null")], "name string, body string")
    found = {r.name: r.s for r in bodies.select("name", fx.body_scenario(F.col("name"), F.col("body")).alias("s")).collect()}
    assert tuple(found["A"]) == (["Given x is provided"], ["When A is invoked"], ["Then the record is persisted"]) and [found[n] for n in "BCD"] == [None] * 3


def test_only_grams_of_names_leave_their_task(spark, monkeypatch):
    """Of thousands of grams in texts without any name hardly one is joined; names of several bytes a character are found where they stand, joined by hash or broadcast."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(3000)) for _ in range(20)] + ["xx Zürich-Straße 17 yy", "Zürich-Strasse 17", None, "", "ñ€𝄞 ok"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2)
    names = spark.createDataFrame([(f"Customer#{k:09d}",) for k in range(300)] + [("Zürich-Straße 17",), ("€𝄞",), ("",), (None,)], "name string")
    met, keep = [], lookup._met_grams
    monkeypatch.setattr(lookup, "_met_grams", lambda *a: met.append(keep(*a)) or met[-1])
    for bytes_ in (lookup.BROADCAST_BYTES, 0):
        monkeypatch.setattr(lookup, "BROADCAST_BYTES", bytes_)
        assert sorted(r.id for r in lookup.named_in(rows, names, "text", "name", at_once=0).collect()) == [20, 24]
        assert met[-1].count() <= 10


# merging


def test_first_rows_build_only_what_is_read(spark):
    """Columns that nobody reads aren't in the plan; null values of the first row stay null."""
    rows = spark.createDataFrame([("a", 2, "x", "u"), ("a", 1, None, "v"), ("b", 1, "z", None)], "id string, ordinal long, kind string, unread string")
    first = merge.keep_first(rows, "id", "ordinal")
    assert sorted(map(tuple, first.collect())) == [("a", 1, None, "v"), ("b", 1, "z", None)] and first.columns == rows.columns
    assert "min_by(unread" not in first.select("id", "kind")._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by(unread" in first._jdf.queryExecution().optimizedPlan().toString()


def test_observer_merge_against_python(spark):
    rng = random.Random(7)
    rows = []
    for key in range(60):
        for source in merge.OBSERVERS:
            if rng.random() < 0.6:
                rows.append((source, key, rng.choice(["", "  ", None, f"t-{source}"]), rng.choice([None, True, False]), rng.choice([None, True, False]), [rng.choice("abc") for _ in range(rng.randrange(3))], f"name-{source}"))
    observed = spark.createDataFrame(rows, "source string, id long, type string, nullable boolean, synthetic boolean, marks array<string>, name string")
    found = merge.observer_merge(observed, "id", first_text={"type": merge.BY_SOURCE}, first_value={"nullable": merge.RUNTIME_FIRST}, any_of={"synthetic": ("BYTECODE", "RUNTIME")}, lists=["marks"], named=["name"])
    for r in found.collect():
        own = {x[0]: x for x in rows if x[1] == r.id}
        pick = lambda order, k, ok: next((own[s][k] for s in order if s in own and ok(own[s][k])), None)  # noqa: B023, E731
        assert r.type == pick(merge.BY_SOURCE, 2, lambda v: v and v.strip())
        assert r.nullable == pick(merge.RUNTIME_FIRST, 3, lambda v: v is not None)
        assert r.synthetic == any(own[s][4] for s in ("BYTECODE", "RUNTIME") if s in own)
        assert r.marks == list(dict.fromkeys(m for s in merge.OBSERVERS if s in own for m in own[s][5]))
        assert r.name == pick(merge.OBSERVERS, 6, lambda v: True)


def test_parameters_of_two_observers_both_stay(spark):
    params = spark.createDataFrame([("SOURCE", "m", "m/name", "name"), ("BYTECODE", "m", "m/arg0", "arg0")], "source string, method_id string, id string, name string")
    assert merge.observer_merge(params, ["method_id", "id"], first_text={"name": merge.RUNTIME_FIRST}).count() == 2


def test_types_are_merged_with_all_below_them(spark):
    """Precedence at each level, first-seen order, lists without repeats (annotations with equal maps too), the last of an observer's repeats at the place of its first, bodies of sources alone."""
    mark = lambda name, **values: (name, f"q.{name}", values)
    seen = lambda who: [(who, "t", "F.java", "s", 1, 2)]
    types = [
        ("SOURCE", "t", " ", "T", "a.T", "class", None, ["I", "J"], [mark("A", x="1", y="2")], seen("SOURCE"), 0), ("BYTECODE", "t", "a", "TB", "a.T", "", "Base", ["J", "K"], [mark("A", y="2", x="1"), mark("B")], seen("BYTECODE"), 0),
        ("RUNTIME", "t", "r", "TR", "a.T", "proxy", "Other", [], [], seen("SOURCE"), 0), ("BYTECODE", "only", "b", "Only", "b.Only", "enum", None, None, None, [], 0), ("BYTECODE", "only", "b", "Last", "b.Only", "enum", None, None, None, [], 1),
    ]
    fields = [
        ("BYTECODE", "t", "t#b", "b", "int", "", None, True, [], [], 0), ("SOURCE", "t", "t#z", "", " ", "Z", None, None, [], [], 5), ("SOURCE", "t", "t#a", "a", "A", "", None, None, [], [], 6), ("BYTECODE", "t", "t#z", "zz", "long", "J", True, False, [], [], 1),
        ("RUNTIME", "t", "t#z", "zr", "x", "x", False, None, [], [], 0), ("SOURCE", "t", "t#z", "", "again", "Z", None, None, [], [], 7), ("SOURCE", "lost", "lost#x", "x", "X", "", None, None, [], [], 0),
    ]
    body = ("return 1;", [("a.X", "go")], ["1"])
    methods = [
        ("SOURCE", "t", "t#m()", "m", "int", "", "public", None, True, False, [], ["E1"], body, [], 0), ("BYTECODE", "t", "t#m()", "mb", "long", "J", "private", True, False, True, [mark("M")], ["E2", "E1"], ("bytes", [], []), [], 0),
        ("RUNTIME", "t", "t#r()", "r", "x", "x", "public", True, True, None, [], [], ("run", [], []), [], 0),
    ]
    params = [("SOURCE", "t#m()", "p0", "given", "int", "", None, [], [], 0), ("BYTECODE", "t#m()", "p0", "arg0", "long", "", True, [], [], 0), ("RUNTIME", "t#m()", "p0", "named", "x", "", False, [], [], 0), ("BYTECODE", "t#m()", "arg1", "arg1", "T", "", None, [], [], 1)]
    tables = [spark.createDataFrame(rows, schema).repartition(3) for rows, schema in ((types, schemas.TYPES), (fields, schemas.FIELDS), (methods, schemas.METHODS), (params, schemas.PARAMS))]
    found = {r.id: r for r in observed.merged_types(*tables).collect()}
    t = found["t"]
    assert (t.package_name, t.simple_name, t.kind, t.super_class, t.interfaces) == ("a", "T", "class", "Base", ["I", "J", "K"])
    assert [(a.name, a["values"]) for a in t.annotations] == [("A", {"x": "1", "y": "2"}), ("B", {})] and [p.source for p in t.provenance] == ["SOURCE", "BYTECODE"]
    assert [(f.id, f.name, f.type, f.erased_type, f.nullable, f.primary_key) for f in t.fields] == [("t#z", "", "again", "Z", False, False), ("t#a", "a", "A", None, None, None), ("t#b", "b", "int", None, None, True)]
    m, r = t.methods
    assert (m.name, m.return_type, m.erased_return_type, m.visibility, m.constructor, m.synthetic, m.bridge, m.thrown_types) == ("m", "int", "J", "public", True, False, True, ["E1", "E2"])
    assert m.body.normalized_source == "return 1;" and r.body is None and [a.name for a in m.annotations] == ["M"] and (r.constructor, r.synthetic, r.bridge, r.parameters) == (False, True, False, [])
    assert [(p.id, p.name, p.type, p.nullable) for p in m.parameters] == [("p0", "given", "int", False), ("arg1", "arg1", "T", None)]
    assert (found["only"].simple_name, found["only"].fields, found["only"].interfaces) == ("Last", [], []) and set(found) == {"t", "only"}


# scans


def test_contract_scans(spark):
    text = "openapi: 3\npaths:\n  /tasks:\n    get:\n    post:\n  /tasks/{id}:\n    delete:\n      get:\n"
    api = spark.createDataFrame([("api/openapi.yaml", text), ("empty.yaml", None)], "path string, text string")
    assert [(r.line, r.method, r.url) for r in scans.openapi_operations(api).orderBy("line").collect()] == [(4, "GET", "/tasks"), (5, "POST", "/tasks"), (7, "DELETE", "/tasks/{id}")]
    text = "asyncapi: 2\n  early:\nchannels:\n  orders.new:\n    x: y\n  orders.old:\n\n  late:\n"
    events = spark.createDataFrame([("asyncapi.yml", text)], "path string, text string")
    assert [r.channel for r in scans.asyncapi_channels(events).orderBy("line").collect()] == ["orders.new", "orders.old"]
    for found in (scans.openapi_operations(api), scans.asyncapi_channels(events)):
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size", [0, 1, 255, 256, 257, 2000])
def test_marks_are_carried_along_an_array(spark, size):
    rng = random.Random(size)
    marks = [rng.choice([None, None, None, "a", "b", "c"]) for _ in range(size)]
    found = spark.createDataFrame([(marks,)], "m array<string>").select(fx.carried(F.col("m")).alias("c")).first().c
    want, last = [], None
    for m in marks:
        want.append(last)
        last = m or last
    assert found == want


def test_method_bodies_show_what_the_patterns_say(spark):
    body = 'if (a.b == null) x; x = c == null; throw new Err(); throw new OrderException ("x"); em.persist(o); r.getById(1); r.remove(2); requireNonNull(o.id); requireNonNull(a.b); f.saveToDisk(3); if(a.b==null) y;'
    bodies = [("Place", body), ("Quiet", "x = 1"), ("Blank", "  "), ("Null", None), ("Word", "null"), ("Save", "repo.saveAll (x)"), ("Check", "if (q == null) return")]
    frame = spark.createDataFrame(bodies, "name string, body string")
    row = frame.filter("name = 'Place'").select(*(v.alias(k) for k, v in fx.body_features(F.col("body")).items())).first().asDict()
    assert row == {"null_checks": ["a.b"], "required": ["o.id", "a.b"], "thrown": ["OrderException"], "saves": ["persist"], "finds": ["getById"], "deletes": ["remove"]}
    told = {r.name: r.s and r.s.asDict() for r in frame.select("name", fx.body_scenario(F.col("name"), F.col("body")).alias("s")).collect()}
    assert told["Place"] == {
        "given": ["Given a.b is provided", "Given o.id is not null", "Given the record exists in the repository"], "when": ["When Place is invoked"],
        "then": ["Then throws OrderException", "Then the record is persisted", "Then the record is removed"],
    }
    assert told["Check"] == {"given": ["Given q is provided"], "when": ["When Check is invoked"], "then": ["Then the operation completes successfully"]}
    assert told["Save"]["given"] == [] and [told[k] for k in ("Quiet", "Blank", "Null", "Word")] == [None] * 4


def test_excerpts_and_headings(spark):
    doc = spark.createDataFrame([("a.md", "# Title\n\ntext\n## Order flow\n####### no\n")], "path string, text string")
    assert [(r.line, r.level, r.title) for r in scans.headings(files.lines(doc)).orderBy("line").collect()] == [(1, 1, "Title"), (4, 2, "Order flow")]
    at = lambda a, b: doc.select(files.excerpt(F.col("text"), F.lit(a), F.lit(b)).alias("v")).first().v
    assert (at(-1, 1), at(3, 1), at(3, 4), at(90, 91)) == ("# Title", "text", "text\n## Order flow", "")


@pytest.fixture(scope="module")
def model(spark):
    prov = [("SOURCE", "t1", "src/Order.java", "Order", 1, 9)]
    mark = lambda n: [(n, f"org.x.{n}", {})]
    t = {
        "files": spark.createDataFrame([("src/Order.java", "import a.B;\nclass Order {}")], "path string, text string"),
        "types": spark.createDataFrame([("SOURCE", "t1", "com.acme", "Order", "com.acme.Order", "class", None, [], mark("Service"), prov, 0), ("SOURCE", "t2", "com.acme", "KafkaGate", "com.acme.KafkaGate", "class", None, [], [], prov, 1)], schemas.TYPES),
        "methods": spark.createDataFrame([("SOURCE", "t1", "t1#run()", "run", "void", "void", "public", False, False, False, mark("Scheduled"), [], ("x", [("com.acme.KafkaGate", "send"), ("java.util.List", "add")], ["hi", " "]), prov, 0)], schemas.METHODS),
        "params": spark.createDataFrame([("SOURCE", "t1#run()", "t1#run()/p", "p", "int", "int", None, [], prov, 0)], schemas.PARAMS),
        "endpoints": spark.createDataFrame([("SOURCE", "t1#run()::GET::/o", "t1#run()", "order", "GET", "/o", prov, 0)], schemas.ENDPOINTS),
        "entities": spark.createDataFrame([("SOURCE", "e1", "t1", "orders", 0)], schemas.ENTITIES),
        "beans": spark.createDataFrame([("SOURCE", "b1", "order", "t1", None, 0)], schemas.BEANS),
        "validations": spark.createDataFrame([("SOURCE", "v1", "t1", "NotNull", 0)], schemas.VALIDATIONS),
        "securities": spark.createDataFrame([("SOURCE", "s1", "t1", "PreAuthorize", "hasRole('A')", 0)], schemas.SECURITIES),
        "resources": spark.createDataFrame([("docs/guide.md", "# Guide\n## Order flow\n## Happy scenario\n"), ("src/main/resources/db/migration/V1.sql", "create table x"), ("api/openapi.yaml", "paths:\n  /o:\n    get:\n")], "path string, text string"),
    }
    t["lines"], t["resource_lines"] = files.lines(t["files"]), files.lines(t["resources"])
    return t


@pytest.fixture(scope="module")
def run(spark, model, tmp_path_factory):
    """A stored run: evidence, its report, items and citations."""
    folder = str(tmp_path_factory.mktemp("run"))
    built, report = snapshot.build(spark, model, "/work/orders")
    found = snapshot.stored(built, folder, "r1")
    items, citations = document.synthesize(spark, found.nodes, found.refs)
    kept = files.stored({"items": items, "citations": citations}, folder, "r1")
    return found, report, kept["items"], kept["citations"]


def test_snapshot_and_synthesis(spark, model, run):
    found, report, items, citations = run
    kinds = {r.kind for r in found.nodes.select("kind").distinct().collect()}
    assert kinds == {
        "project", "source-file", "import", "java-type", "annotation", "java-method", "method-parameter", "literal", "call-target", "http-endpoint", "persistence-entity", "bean", "validation-constraint",
        "security-constraint", "documentation-file", "documentation-section", "openapi-contract", "contract-operation", "database-migration", "scheduled-job", "integration-artifact",
    }
    assert found.nodes.count() == found.nodes.select("id").distinct().count()
    calls = {(r.source, r.target) for r in found.edges.filter("kind = 'CALLS'").collect()}
    assert calls == {("t1#run()", "t2"), ("t1#run()", "external-call-target:java.util.List:add")}
    assert {r.adapter: (r.status, r.node_count) for r in report.collect()} == {"documentation": ("COLLECTED", 4), "contracts": ("COLLECTED", 2), "migrations": ("COLLECTED", 1), "scheduling": ("COLLECTED", 1), "integration-patterns": ("COLLECTED", 1)}

    got = [(r.kind, r.name) for r in items.orderBy("kind", "ordinal", "name").collect()]
    assert ("service", "orders") in got and ("datastore", "Primary Relational Store") in got and ("integration", "KAFKA") in got
    assert [n for k, n in got if k == "interface"] == ["HTTP Surface", "Background Jobs"]
    assert [n for k, n in got if k == "operation"] == ["GET /o", "GET /o", "Order.run"]
    assert {n for k, n in got if k == "workflow"} == {"Order.run", "Order flow"} and {n for k, n in got if k == "scenario"} == {"GET /o", "Order.run", "Happy scenario"}
    assert items.filter("kind = 'datastore'").first().summary == "flyway-relational"
    assert items.filter("kind = 'service'").first().summary == "Guide"
    assert document.validate(items, citations, found.nodes).count() == 0
    nodes, links = document.graph_projection(items, citations, found.nodes, found.edges, "r1")
    assert links.filter("type = 'DERIVED_FROM'").count() > 0 and links.filter("type = 'NOTES'").count() == 0
    tree, _ = document.lineage(items, citations, found.nodes)
    assert tree.filter("kind = 'service'").first().blocking == 0
    again, _ = snapshot.build(spark, model, "/work/orders")
    digest = lambda df: df.agg(F.sum(F.xxhash64(*(F.col(c).cast("string") for c in df.columns)).cast("decimal(20,0)"))).first()[0]
    assert digest(again.nodes) == digest(found.nodes) and digest(again.edges) == digest(found.edges)


def test_adapter_without_rows_is_skipped(spark, model):
    none = {k: v.limit(0) for k, v in model.items()}
    _, report = snapshot.build(spark, none, "/x")
    assert {(r.status, r.node_count, r.edge_count) for r in report.collect()} == {("SKIPPED", 0, 0)}


# confidence, drift, rules, migrations


def test_confidence(spark):
    assert value(spark, document.runtime_backed(F.lit(True), F.lit(False), F.lit(True))) == "PARTIAL"
    assert value(spark, document.required_domains({"spring": F.lit(True), "jpa": F.lit(False)})) == ["BUILD", "TYPES", "METHOD_BODIES", "CALL_GRAPH", "SPRING_BEANS"]
    report = spark.createDataFrame([("a", "CONFIRMED"), ("b", "PARTIAL")], "domain string, status string")
    need = lambda *d: spark.createDataFrame([(x,) for x in d], "domain string")
    assert [document.trust(report, need(*d)).first().trusted for d in (("a",), ("a", "b"), ("a", "z"))] == [True, False, False]
    assert document.confidence_score(report).first().score == 0.5 and document.confidence_score(report.limit(0)).first().score == 0


def test_trees_of_any_depth(spark):
    """A chain of 300 nodes, and a circle."""
    chain = spark.createDataFrame([(str(k), str(k - 1) if k else None, k) for k in range(300)], "id string, parent string, ordinal long")
    one = spark.createDataFrame([("299", 1), ("7", 10)], "id string, n long")
    totals = {r.id: r.n for r in hierarchy.hierarchical_rollup(chain, one).collect()}
    assert totals == {str(k): 11 if k <= 7 else 1 for k in range(300)}
    shown = hierarchy.visible_tree(chain, spark.createDataFrame([(str(k),) for k in range(1, 200)], "id string")).collect()
    assert {r.id: (r.level, r.place) for r in shown} == {str(k): (k, k) for k in range(201)}
    circle = spark.createDataFrame([("a", "b", 1), ("b", "a", 1), ("c", None, 1)], "id string, parent string, ordinal long")
    for call in (lambda: hierarchy.hierarchical_rollup(circle, one), lambda: hierarchy.visible_tree(circle, one)):
        with pytest.raises(ValueError, match="circle"):
            call()


def test_random_trees_against_a_walk(spark):
    """Several roots, unknown parents, equal ordinals: the walk, ancestors, neighbourhoods and the filter, by recursion."""
    rng = random.Random(17)
    for size in (1, 50, 200):
        rows = [(f"n{k}", None if rng.random() < 0.03 or not k else "lost" if rng.random() < 0.03 else f"n{rng.randrange(max(0, k - 12), k)}", rng.randrange(4)) for k in range(size)]
        nodes = spark.createDataFrame(rows, "id string, parent string, ordinal long").repartition(3)
        opened = {r[0] for r in rows if rng.random() < 0.7} | {"nobody"}
        expanded = spark.createDataFrame([(x,) for x in opened for _ in range(2)], "id string")
        children = {}
        for i, parent, ordinal in rows:
            children.setdefault(parent, []).append((ordinal, i))
        walk = []

        def visit(i, level):
            walk.append((i, level))
            if level == 0 or i in opened:  # noqa: B023
                for _, child in sorted(children.get(i, [])):  # noqa: B023
                    visit(child, level + 1)

        for _, top in sorted(children.get(None, [])):
            visit(top, 0)
        shown = sorted(hierarchy.visible_tree(nodes, expanded).collect(), key=lambda r: r.place)
        assert [(r.id, r.level) for r in shown] == walk and [r.place for r in shown] == list(range(len(walk)))
        parent = {i: p for i, p, _ in rows}
        above = lambda i: [] if parent.get(i) not in parent else [parent[i], *above(parent[i])]  # noqa: B023, E731
        some = {f"n{rng.randrange(size)}" for _ in range(3)}
        chosen = spark.createDataFrame([(x,) for x in [*some, "nobody"]], "id string")
        assert {r.id for r in hierarchy.expand_ancestors(nodes, chosen).collect()} == {a for i in some for a in above(i) if parent[a] is not None}
        assert {r.id for r in hierarchy.neighborhood(nodes, chosen).collect()} == some | {a for i in some for a in above(i)} | {i for i, p in parent.items() if p in some}
        hits = {i for i, _, o in rows if o == 3}
        want = hits | {a for i in hits for a in above(i)} if hits else {i for i, _ in walk}
        assert {r.id for r in hierarchy.visible_filtered(nodes, F.col("ordinal") == 3, expanded).collect()} == want


def test_a_chain_of_100_000_nodes(spark):
    """Plans don't grow with the depth: each round reads the tables of the round before."""
    n = 100_000
    chain = spark.range(n).selectExpr("CAST(id AS STRING) AS id", "IF(id = 0, NULL, CAST(id - 1 AS STRING)) AS parent", "id AS ordinal")
    began, before = time.perf_counter(), set(files._written)
    total = hierarchy.hierarchical_rollup(chain, chain.selectExpr("id", "1 AS n"))
    assert total.filter("n <> 100000 - CAST(id AS LONG)").count() == 0
    assert len(set(files._written) - before) <= 3  # the rounds' tables are deleted on the way: the last sums and pointers stay, and an empty table
    assert time.perf_counter() - began < 60


@pytest.mark.parametrize("parts", [1, 7])
def test_running_sums_of_a_hot_group(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["hot", "hot", "hot", "hot", "a", "b", None]), k, rng.choice([None, 1, 2, -5])) for k in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame(rows, "g string, k long, v long").repartition(parts)
        found = numbering.running(numbering.running(frame, ["g"], ["k"], "number"), ["g"], ["k"], "total", F.col("v")).collect()
        whole = numbering.running(frame, [], ["k"], "number").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    seen, sums = Counter(), Counter()
    for g, k, v in sorted(rows, key=lambda r: r[1]):
        assert (g, k, v, seen[g], sums[g]) in {tuple(r) for r in found if r.k == k}
        seen[g] += 1
        sums[g] += v or 0
    assert sorted((r.k, r.number) for r in whole) == [(k, k) for k in range(3000)]
    assert numbering.running(frame.limit(0), ["g"], ["k"], "n").count() == 0


def test_drift_goldens(spark):
    """Each branch: infrastructure by name, annotation, kind, stripped name and shared name; domain, command and entity types; hooks; tokens."""
    rows = [
        ("C", "C", "class", []), ("thing", "OrderThing", "class", []), ("svc", "OrderService", "class", ["Service"]), ("pay", "PaymentService", "class", ["Service"]), ("idle", "IdleService", "class", ["Service"]),
        ("ent", "Invoice", "class", ["Entity"]), ("hook", "ShipHook", "class", ["Component"]), ("repo", "TaxRepository", "class", ["Service"]), ("policy", "RefundPolicyService", "class", ["Service"]),
        ("dup1", "Shared", "class", ["Service"]), ("dup2", "Shared", "enum", []), ("plain", "Gateway", "interface", []), ("line", "OrderLineController", "class", ["RestController"]), ("conf", "Wired", "class", ["Service", "Configuration"]),
    ]
    types = spark.createDataFrame(rows, "id string, name string, kind string, annotations array<string>")
    methods = spark.createDataFrame([
        ("m1", "svc", "submit", 1), ("m2", "pay", "charge", 1), ("m3", "pay", "getName", 0), ("m4", "idle", "getName", 0), ("m5", "idle", "setName", 1), ("m6", "hook", "onHook", 0), ("m7", "hook", "run", 0),
        ("m8", "ent", "total", 0), ("m9", "line", "add", 2), ("m10", "dup1", "run", 0), ("m11", "pay", "refund", 1), ("m12", "pay", "getFor", 1),
    ], "id string, type_id string, name string, arity int")
    approved = spark.createDataFrame([("order", "/order"), ("order_line", "/order-line"), ("gone", "/gone"), ("c", "/c")], "name string, path string")
    commands = spark.createDataFrame([("payment", "refund")], "aggregate string, name string")
    found = {(r.kind, r.what, r.subject, r.blocking) for r in compare.drift_report(types, methods, approved, commands).collect()}
    mine, hook = "UNSUPPORTED_HANDWRITTEN", "HANDWRITTEN_HOOK"
    assert found == {
        (mine, "type", "pay", True), (mine, "method", "m2", True), (mine, "method", "m12", True), (mine, "type", "ent", True), (mine, "method", "m8", True),
        (hook, "type", "hook", False), (hook, "method", "m6", False), (mine, "method", "m7", True), ("SPEC_OWNED", "aggregate", "/gone", True),
    }


def test_names_of_all_lengths_in_texts(spark):
    """By grams as by looking: names of 1 to 40 characters, characters of several bytes, repeated rows and rows with nulls, which all stay."""
    rng = random.Random(23)
    letters = "ab é\U0001f600."
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = [word(rng.randrange(0, 120)) for _ in range(120)]
    rows = [(k % 50 or None, rng.choice([None, "x"]), t) for k, t in enumerate([*texts, *texts[:20], None, ""])]
    names = [word(rng.choice([7, 8, 9, 15, 16, 17, 40])) for _ in range(200)] + [t[a : a + n] for t in texts[:40] for a, n in [(rng.randrange(0, 60), rng.choice([3, 4, 5, 12, 16, 33]))]] + [None, ""]
    for some in (names, [n for n in names if n and len(n) > 8], ["b.", "\U0001f600\U0001f600\U0001f600"]):
        frame, table = spark.createDataFrame(rows, "id long, other string, text string").repartition(3), spark.createDataFrame([(n,) for n in some], "name string")
        found = lookup.named_in(frame, table, "text", "name", at_once=0)
        assert found.columns == frame.columns
        assert Counter(map(tuple, found.collect())) == Counter(r for r in rows if r[2] and any(n and n in r[2] for n in some))


def test_names_in_texts_both_ways(spark):
    rows = spark.createDataFrame([(k, f"path/to/Thing{k}/x" if k % 3 else "") for k in range(60)] + [(99, None)], "id long, text string")
    names = spark.createDataFrame([(f"Thing{k}",) for k in range(0, 60, 4)] + [("",), (None,), ("o/T",)], "name string")
    want = {r.id for r in rows.collect() if r.text and any(n in r.text for n in [f"Thing{k}" for k in range(0, 60, 4)] + ["o/T"])}
    for few in (2_000, 0):
        assert {r.id for r in lookup.named_in(rows, names, "text", "name", order=["id"], at_once=few).collect()} == want
        assert lookup.named_in(rows, names.limit(0), "text", "name", at_once=few).count() == 0


def test_rules(spark):
    rows = spark.createDataFrame([("DRAFT", 5, "2024-01-01 00:00:00", "2024-01-01 13:00:00"), ("OPEN", 20, "2024-01-01 00:00:00", "2024-01-01 02:00:00")], "status string, n int, a string, b string").selectExpr("status", "n", "cast(a as timestamp) a", "cast(b as timestamp) b")
    assert [r.n for r in compare.rule_filter(rows, "status == 'DRAFT' || n > 10 && n != 20").collect()] == [5]
    assert [r.n for r in compare.rule_filter(rows, "duration(a, b) <= PT12H").collect()] == [20]
    assert [compare.rule_problem(rows, r) for r in ("n > 1", "zz > 1", "n", "n == duration(a, b)")] == [None, "RULE_UNKNOWN_IDENTIFIER", "RULE_TYPE_BOOLEAN", "RULE_TYPE_MISMATCH"]
    assert compare.rule_to_sql("x == 'a && b'") == "x = 'a && b'"
    assert [r.n for r in compare.rule_filter(rows, "status == OPEN && n > 1").collect()] == [20] and compare.rule_problem(rows, "status != IN_WORK") is None
    assert compare.rule_problem(rows, "state == OPEN") == "RULE_UNKNOWN_IDENTIFIER"


def test_canonical_tree_of_a_specification(spark):
    """Paths of a service with one context, aggregate, command and event; defaults; order; ids that hold still, whatever the order of what is written."""
    none = {"schema_version": 1, "generation": None, "external": None, "performance": None, "tags": None}
    field = lambda name, pk=None, nullable=None: {"name": name, "type": "String", "pk": pk, "nullable": nullable}
    event = {"name": "TaskSubmitted", "topic": "tasks", "format": "json", "payload": [field("taskId"), field("at")]}
    commands = [
        {"name": "SubmitTask", "method": "POST", "path": "/tasks", "input": [field("zeta"), field("Alpha")], "rules": [{"id": "R_2", "type": "VALIDATION", "ensure": "a"}, {"id": "R-1", "type": "GUARD", "ensure": "b"}], "emits": ["task_submitted", "TaskSubmitted", "gone"]},
        {"name": "approve", "method": None, "path": None, "input": None, "rules": None, "emits": None},
    ]
    machine = {"name": "Life", "initial": "NEW", "states": ["OPEN", "NEW"], "transitions": [{"on": "Submit Task", "from": ["OPEN", "NEW"], "to": "DONE"}, {"on": "Approve", "from": ["DONE"], "to": "NEW"}]}
    aggregate = {"name": "TaskRequest", "identity": {"type": "UUID", "field": "taskId"}, "entities": [{"name": "TaskEntity", "table": "task", "fields": [field("taskId", True, False), field("Name")]}], "events": [event], "commands": commands, "machine": machine, "hooks": [{"name": "h", "signature": "x()", "optional": None}]}
    spec = none | {"service": {"name": "test-service", "base_package": "a.b"}, "messaging": {"delivery": None, "key": None, "attempts": None, "backoff": None, "dlq": None}, "bounded_contexts": [{"name": "core", "aggregates": [aggregate]}]}
    turned = spec | {"bounded_contexts": [{"name": "core", "aggregates": [aggregate | {"commands": commands[::-1], "entities": [aggregate["entities"][0] | {"fields": aggregate["entities"][0]["fields"][::-1]}]}]}], "messaging": None}
    bare = none | {"service": {"name": "Bare", "base_package": None}, "messaging": None, "bounded_contexts": None}
    rows = canonical.canonical_specs(spark.createDataFrame([spec, turned, bare], schemas.SPEC)).collect()
    first, second, third = sorted(rows, key=lambda r: (r.service.name == "Bare", r.settings.key is not None))
    path = "/services/test-service/bounded-contexts/core/aggregates/task-request"
    made = first.contexts[0].aggregates[0]
    assert first.service.path == "/services/test-service" and made.path == path
    assert [x.name for x in made.commands] == ["approve", "SubmitTask"] and made.commands[1].emits == [f"{path}/events/task-submitted"] * 2 and made.commands[1].unknown_emits == ["gone"]
    assert [f.path for f in made.commands[1].input] == [f"{path}/commands/submit-task/input/fields/alpha", f"{path}/commands/submit-task/input/fields/zeta"]
    assert [(r.name, r.path) for r in made.commands[1].rules] == [("R-1", f"{path}/commands/submit-task/rules/r-1"), ("R_2", f"{path}/commands/submit-task/rules/r-2")]
    assert [(f.name, f.pk, f.nullable) for f in made.entities[0].fields] == [("Name", False, True), ("taskId", True, False)]
    assert made.machine.states == ["NEW", "OPEN"] and [(t.command, t["from"]) for t in made.machine.transitions] == [(f"{path}/commands/approve", ["DONE"]), (f"{path}/commands/submit-task", ["NEW", "OPEN"])]
    assert first.contexts == second.contexts and third.contexts == []
    assert (first.settings.key, first.settings.dlq, first.settings.attempts) == (None, None, 3) and (second.settings.key, second.settings.dlq) == ("requestId", "default.dlq") and third.settings.page == 100
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert made.events[0].id == sha(f"event|task_submitted|{path}|" + sha('{"payload":["at","task_id"],"schemaFormat":"json","topic":"tasks"}'))
    assert first.service.id == sha("service|test_service|/|" + sha('{"basePackage":"a.b"}'))
    kinds = Counter(r.kind for r in canonical.canonical_items(canonical.canonical_specs(spark.createDataFrame([spec], schemas.SPEC))).collect())
    assert kinds == {"service": 1, "boundedContext": 1, "aggregate": 1, "entity": 1, "field": 2, "event": 1, "command": 2, "rule": 2}


def written_out(rule):
    """A rule's nodes as text with all parentheses, or why it can't be read."""
    try:
        nodes = rules.rule_nodes(rule)
    except ValueError:
        return None
    below = lambda k: [x["node"] for x in sorted(nodes, key=lambda x: x["side"]) if x["parent"] == k]

    def out(k):
        x, parts = nodes[k], [out(j) for j in below(k)]
        return f"({parts[0]} {x['text']} {parts[1]})" if x["kind"] == "binary" else f"{x['text']}[{', '.join(parts)}]" if x["kind"] == "call" else f"{x['text']}:{x['type']}".rstrip(":")

    return out(0)


@pytest.mark.parametrize(
    ("rule", "want"),
    [
        ("duration(shiftStart, shiftEnd) <= PT12H", "(duration[shiftStart, shiftEnd] <= 43200 s:DURATION)"), ("a < b == c", "((a < b) == c)"), ("a == b < c != d", "((a == (b < c)) != d)"), ("a||b&&c || d", "((a || (b && c)) || d)"),
        ("a && (b || c) && d", "((a && (b || c)) && d)"), ("f(a, g(b == 1) || x)", "f[a, (g[(b == 1:NUMBER)] || x)]"), ("true == 'false'", "(true:BOOLEAN == false:BOOLEAN)"), ("x == '12.5'", "(x == 12.5:NUMBER)"), ("1.2.3 == x", "(1.2.3:STRING == x)"),
        ("lambda == is", "(lambda == is)"), ("Ping == P_x", "(Ping == P_x)"), ("\"a && b", "a && b:STRING"), ("f()", "f[]"), ("(a)(b)", None), ("f(a,)", None), ("a = b", None), ("a b", None), ("", None), ("total >", None), ("P1 > 2", None), ("'a' (b)", None), ("a ? b", None), ("(a, b)", None),
    ],
)
def test_rules_are_read_as_the_grammar_says(rule, want):
    assert written_out(rule) == want


def test_draft_as_texts_says_what_the_nested_draft_says(spark, monkeypatch):
    """Texts of pieces of two items each, in order; identities by an id field, by an input, by none; commands and entities alone."""
    make = spark.createDataFrame
    types = make([("x.T", "T")], "id string, simple_name string")
    methods = make([(f"x.{t}Controller#m{k}", f"do{k}", (f"if (a{k} == null)",)) for t in "TUV" for k in range(5)], "id string, name string, body struct<normalized_source:string>")
    params = make([(f"x.{t}Controller#m{k}", f"p{t}{k}", n, "int", None, 0) for t in "TU" for k, n in ((1, "other"), (3, "lateId"), (2, "ID"))], "method_id string, id string, name string, type string, nullable boolean, ordinal long")
    ends = make([(f"x.{t}Controller#m{k}", "POST", f"/{k}", 9 - k) for t in "TUV" for k in range(5)], "method_id string, http_method string, full_path string, ordinal long")
    fields = "type_id string, table_name string, id_fields array<string>, attributes array<struct<field_name:string, type:string, pk:boolean, nullable:boolean>>, ordinal long"
    entities = make([("x.T", "t", [], [("k", "int", True, None)], 0), ("x.T", "t2", ["x.T#k"], [("k", "long", True, None)], 1), ("x.W", "w", [], [], 0)], fields)
    checks = make([("v", "pT1", "Max", 0)], "id string, target_id string, annotation string, ordinal long")
    guards = make([], "id string, target_id string, kind string, expression string, ordinal long")
    monkeypatch.setattr(draft, "PIECE", 2)
    tables = (types, methods, params, ends, entities, checks, guards)
    nested = {r.aggregate: r for r in draft.draft(*tables).collect()}
    texts = {r.aggregate: r for r in draft.draft(*tables, (lambda e: e["table"], lambda m: F.concat(m["name"], m["path"])), "; ").collect()}
    assert {a: tuple(r.identity) for a, r in nested.items()} == {"T": ("int", "k"), "U": ("String", "ID"), "V": ("String", None), "W": ("String", None)}
    assert {a: r.identity for a, r in texts.items()} == {a: r.identity for a, r in nested.items()}
    for a, r in nested.items():
        assert texts[a].entities == "; ".join(e["table"] for e in r.entities) and texts[a].commands == "; ".join(m["name"] + m["path"] for m in r.commands)
    assert [m["name"] for m in nested["V"].commands] == [f"Do{k}" for k in range(5)] and nested["W"].commands == [] and nested["U"].entities == []


def test_long_draft_texts_meet_in_one_step(spark, monkeypatch):
    """Texts beyond LONG beside short ones, from pieces of several items, null and equal ones too: the same rows, and no join or aggregation of them."""
    commands = [(a, f"c{n // 2:02}", n, "/", None if n % 5 else f"{a}Id{n}", f"{a}{n}é" if n % 7 else None) for a, most in (("A", 60), ("B", 3), (None, 2)) for n in range(most)]
    m = "aggregate string, name string, ordinal long, path string, first string, item string"
    entities = [("B", 1, "y", [("key", "long")], "key", "b1"), ("B", 0, "x", [("key", "int")], None, "b0"), ("C", 0, "z", [], None, "c"), (None, 0, "n", [("Id0", "int")], None, "n"), ("D", 0, "d", [], None, None)]
    e = "aggregate string, ordinal long, name string, fields array<struct<name:string, type:string>>, first string, item string"
    texts = lambda a: ";".join(x[5] for x in commands if x[0] == a and x[5])
    want = {("A", "AId0", "String", "", texts("A")), ("B", "key", "int", "b0;b1", texts("B")), ("C", None, "String", "c", ""), (None, None, "String", "n", ""), (None, "NoneId0", "String", "", texts(None)), ("D", None, "String", "", "")}
    monkeypatch.setattr(draft, "PIECE", 16)
    for long in (1 << 24, 100, 0):
        monkeypatch.setattr(draft, "LONG", long)
        made = [files.written(spark.createDataFrame(rows[::-1], kind), "made") for rows, kind in ((entities, e), (commands, m))]
        found = draft._as_texts(*made, ";")
        assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "Aggregate" not in plan.partition("Window")[0] and ("Coalesce 1" in plan) == (long < 1000)


def test_rule_diagnostics_by_layer(spark):
    """Inputs replace an entity's fields, the machine's status both; each code; constants are texts; other commands' names are unknown."""
    symbols = [("c", "total", "double", 0, 1), ("c", "total", "boolean", 0, 2), ("c", "when", "Instant", 0, 1), ("c", "status", "int", 1, 1), ("c", "status", "enum(Life)", 2, 1), ("c", "took", "Duration", 1, 1), ("d", "only", "int", 0, 1)]
    texts = [
        ("A", "total && flag"), ("B", "status == OPEN"), ("C", "status == 5"), ("D", "only > 1"), ("E", "took > PT1H"), ("F", "took > PT"), ("b", "status != 'X'"), ("A", "total"), ("G", "when == 'x' && total"), ("H", "f(nix) == 5"), ("I", "status == 'X'"), ("J", "took == PT60M"),
        ("K", "took == PT1H"), ("L", None),
    ]
    frame = spark.createDataFrame([("c", i, k, t) for k, (i, t) in enumerate(texts)], "command string, rule_id string, ordinal long, ensure string").repartition(3)
    table = spark.createDataFrame(symbols, "command string, name string, type string, layer int, ordinal int")
    found = sorted((r.rule_id, r.ordinal, r.code) for r in rules.rule_diagnostics(frame, table).collect())
    assert found == sorted([
        ("A", 0, "RULE_UNKNOWN_IDENTIFIER"), ("A", 0, "RULE_TYPE_BOOLEAN"), ("A", 7, "RULE_DUPLICATE_ID"), ("C", 2, "RULE_TYPE_MISMATCH"), ("D", 3, "RULE_UNKNOWN_IDENTIFIER"), ("F", 5, "RULE_UNPARSEABLE"),
        ("H", 9, "RULE_UNKNOWN_IDENTIFIER"), ("C", 2, "RULE_CONFLICT"), ("L", 13, "RULE_UNPARSEABLE"),
    ])
    assert rules.rule_diagnostics(frame.limit(0), table).count() == 0 and rules.rule_diagnostics(frame, table.limit(0)).filter("code = 'RULE_UNKNOWN_IDENTIFIER'").count() > 8


def test_rules_are_read_once_and_stored(spark):
    """Neither joins nor unions read rules a second time; a repeated rule has the same problems in each of its commands, by the types there."""
    frame = spark.createDataFrame([(f"c{k % 3}", f"R{k}", k, "n > 5 && f(n, n) == m") for k in range(12)] + [("c0", "Z", 99, "n >")], "command string, rule_id string, ordinal long, ensure string").repartition(2)
    table = spark.createDataFrame([("c0", "n", "int", 0, 0), ("c1", "n", "String", 0, 0), ("c0", "m", "int", 0, 0)], "command string, name string, type string, layer int, ordinal int")
    made = rules.rule_diagnostics(frame, table)
    assert "MapInArrow" not in made._jdf.queryExecution().executedPlan().toString()
    found = Counter((r.command, r.code) for r in made.collect())
    assert found == {("c0", "RULE_UNPARSEABLE"): 1, ("c1", "RULE_TYPE_MISMATCH"): 4, ("c1", "RULE_UNKNOWN_IDENTIFIER"): 4, ("c2", "RULE_UNKNOWN_IDENTIFIER"): 16}


def brute_runs(events, timeout, watermark):
    out = []
    for key in {e[0] for e in events}:
        run, is_open, last, started, n = 0, False, 0, 0, 0
        for _, at, status in sorted(e for e in events if e[0] == key):
            if is_open and at - last > timeout:
                out.append((key, run, started, last + timeout, "TIMED_OUT", n))
                is_open = False
            if not is_open:
                run, started, n, is_open = run + 1, at, 0, True
            last, n = at, n + 1
            if status in live.TERMINAL:
                out.append((key, run, started, at, status, n))
                is_open = False
        if is_open and last + timeout < watermark:
            out.append((key, run, started, last + timeout, "TIMED_OUT", n))
    return sorted(out)


@pytest.mark.parametrize("files_at_once", [1, 4])
def test_runs_end_by_state_or_silence_over_many_batches(spark, tmp_path, files_at_once):
    rng = random.Random(files_at_once)
    at = sorted(rng.sample(range(10_000), 300))
    events = [(rng.choice("abcdef"), t, rng.choice(["RUNNING"] * 6 + ["SUCCEEDED", "FAILED"])) for t in at] + [("silent", 5, "RUNNING"), ("done", 7, "SUCCEEDED"), ("z", 10_050, "RUNNING")]
    events.sort(key=lambda e: e[1])
    for k in range(8):  # one file after the other in time
        part = spark.createDataFrame(events[len(events) * k // 8 : len(events) * (k + 1) // 8], "key string, at long, status string").selectExpr("key", "timestamp_seconds(at) AS at", "status")
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        time.sleep(0.02)
    found = live.ended_runs(live.run_events(spark, f"{tmp_path}/events", "key string, at timestamp, status string", files_at_once), 400, "10 seconds")
    for _ in range(2):  # a second drain finds nothing new
        live.append_stream(found, f"{tmp_path}/out", f"{tmp_path}/progress").awaitTermination()
        got = spark.read.schema(found.schema).parquet(f"{tmp_path}/out").selectExpr("key", "run", "unix_seconds(started)", "unix_seconds(ended)", "status", "n").collect()
        assert sorted(map(tuple, got)) == brute_runs(events, 400, 10_040)
    assert {r.status for r in got} == {"SUCCEEDED", "FAILED", "TIMED_OUT"}


def test_a_log_of_states_is_compacted(spark, tmp_path):
    rows = [(k % 7, k, f"s{k}") for k in range(40)]
    log = live.StateLog(spark, f"{tmp_path}/log", "key long, at long, state string", ["key"], "at")
    assert log.latest().count() == 0
    log.compact()
    want = {(k, max(r[1] for r in rows if r[0] == k)) for k in range(7)}
    for n in range(4):
        spark.createDataFrame(rows[n * 10 : n * 10 + 10], "key long, at long, state string").write.parquet(f"{tmp_path}/log/batch={n}")
        if n in (1, 3):
            seen = {tuple(r) for r in log.latest().collect()}
            (tmp_path / "log" / "upto=9").mkdir(exist_ok=True)  # what an attempt that broke off leaves
            log.compact()
            log.compact()
            assert {tuple(r) for r in log.latest().collect()} == seen
            assert sorted(p.name for p in (tmp_path / "log").iterdir()) == [f"upto={n}", "upto=9"]
    assert {(r.key, r.at) for r in log.latest().collect()} == want


def test_versioned_table_takes_replays(spark, tmp_path):
    table = store.VersionedTable(spark, f"{tmp_path}/graph", "node_id string, name string, seen long", ["node_id"], buckets=4)
    rows = lambda pairs: spark.createDataFrame([(i, n, k) for k, (i, n) in enumerate(pairs)], "node_id string, name string, seen long")
    state = lambda version=None: {(r.version, r.node_id): r.name for r in table.rows(version).collect()}
    assert state() == {}
    first = [(f"n{k}", f"a{k}") for k in range(20)]
    assert table.upsert(rows(first), "v1", "c1")
    assert table.upsert(rows([("n3", "late"), ("n3", "later"), ("new", "x")]), "v1", "c2", "seen")
    assert table.upsert(rows([("n3", "other")]), "v2", "c3")
    want = {("v1", i): n for i, n in first} | {("v1", "n3"): "later", ("v1", "new"): "x", ("v2", "n3"): "other"}
    assert state() == want and state("v2") == {("v2", "n3"): "other"}
    files_before = sorted(p for p in (tmp_path / "graph").rglob("*.parquet"))
    assert not table.upsert(rows([("n3", "never")]), "v1", "c2", "seen") and not table.upsert(rows(first), "v1", "c1")
    assert state() == want and sorted(p for p in (tmp_path / "graph").rglob("*.parquet")) == files_before
    # A commit that wrote its data and broke off before it was listed: readers don't see it, and it can be repeated.
    whole = table._written
    table._written = None
    with pytest.raises(TypeError):
        table.upsert(rows([("n5", "half"), ("n6", "half")]), "v1", "c4")
    table._written = whole
    assert state() == want
    assert table.upsert(rows([("n5", "whole")]), "v1", "c4") and state() == want | {("v1", "n5"): "whole"}
    assert table.upsert(rows([]), "v1", "c5") and state() == want | {("v1", "n5"): "whole"}


def test_migrations_in_order(spark):
    fields = spark.createDataFrame([("employeeId",), ("other",)], "field string")
    steps = [{"column": "field", "old": "employeeId", "new": "staffId"}, {"column": "field", "old": "none", "new": "x"}]
    assert {r.field for r in compare.migrate(fields, steps).collect()} == {"staffId", "other"}
    assert {r.step: r.matches for r in compare.migration_actions(fields, steps).collect()} == {0: 1, 1: 0}


def test_runs(spark):
    rows = [("1", "p", None, "boot", "RUNNING", 1), ("1", "p", None, "boot", "FAILED", 2), ("2", "p", None, "boot", "SUCCEEDED", 3), ("3", "p", "2", "boot", "RUNNING", 4)]
    table = spark.createDataFrame(rows, "id string, project_id string, parent_run_id string, kind string, status string, started_at long")
    assert {r.id: r.status for r in runs.latest_per_key(table, ["id"], "started_at").collect()} == {"1": "FAILED", "2": "SUCCEEDED", "3": "RUNNING"}
    assert runs.any_success(table, "boot").first().succeeded and not runs.any_success(table, "ask").first().succeeded
    assert runs.latest_top_level(table, "boot").first().id == "2" and runs.may_start(table, "p", "boot").first().id == "3"
    assert value(spark, runs.chips([F.lit("a"), F.lit(""), lit(None), F.lit("b"), F.lit("c"), F.lit("d"), F.lit("e")])) == ["a", "b", "c", "d"]


def test_files_yaml_and_upsert(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "A.java").write_text("package com.acme;\n@SpringBootApplication\nclass App {}\n")
    (tmp_path / "src" / "b.txt").write_text("no")
    code = files.code_files(spark, [f"{tmp_path}/src", f"{tmp_path}/missing", f"{tmp_path}/src"])
    assert code.count() == 1 and files.boot_class(code).first().name == "com.acme.App"
    rules = spark.createDataFrame([("a", 1), ("b", 2)], "name string, n long")
    files.write_yaml(rules, f"{tmp_path}/doc")
    assert sorted(map(tuple, files.yaml_rows(spark, f"{tmp_path}/doc", "name string, n long").collect())) == [("a", 1), ("b", 2)]
    fresh = spark.createDataFrame([("b", 9), ("c", 3)], "name string, n long")
    once = files.upsert(rules, fresh, ["name"])
    assert sorted(map(tuple, files.upsert(once, fresh, ["name"]).collect())) == [("a", 1), ("b", 9), ("c", 3)]
    manifest = files.write_artifacts({"rules": rules}, f"{tmp_path}/out", "r1")
    assert manifest.count() == 1 and spark.read.parquet(f"{tmp_path}/out/rules").filter("run_id = 'r1'").count() == 2
    assert files.json_artifact(spark, None, schemas.NODES).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    from quillgraph.streaming import runs as live

    rows = [(f"r{k % 5}", k, ("RUNNING", "SUCCEEDED", "FAILED")[k % 3]) for k in range(60)]
    for n in range(3):
        spark.createDataFrame(rows[n * 20 : n * 20 + 20], "id string, seq long, status string").write.parquet(f"{tmp_path}/in/part{n}")
    for n in range(3):
        for f in (tmp_path / "in" / f"part{n}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{n}-{f.name}")
    events = live.run_events(spark, f"{tmp_path}/in", "id string, seq long, status string", 1)
    live.progress_stream(events, "states_test", ["id"], "seq", ["status"], f"{tmp_path}/cp").awaitTermination()
    batch = runs.latest_per_key(spark.createDataFrame(rows, "id string, seq long, status string"), ["id"], "seq")
    key = lambda df: sorted(map(tuple, df.select("id", "seq", "status").collect()))
    assert key(spark.table("states_test")) == key(batch)
    events = live.run_events(spark, f"{tmp_path}/in", "id string, seq long, status string", 1)
    live.upsert_stream(events, f"{tmp_path}/log", ["id"], "seq", f"{tmp_path}/cp2").awaitTermination()
    assert key(runs.latest_per_key(spark.read.parquet(f"{tmp_path}/log"), ["id"], "seq")) == key(batch)
    assert live.still_running(batch).count() == batch.filter("status = 'RUNNING'").count()


def test_more_text_functions(spark):
    row = spark.createDataFrame([([("Mapping", "x.Mapping", {"path": '"/a", "/b", '}), ("Other", "x.Other", {})], ["x == null", "y != null && z", "a != null || b == null", "n"])], "annotations array<struct<name:string, qualified_name:string, values:map<string,string>>>, predicates array<string>")
    got = row.select(
        fx.annotation_values(F.col("annotations"), "Mapping", "path").alias("v"), fx.annotation_attribute(F.col("annotations"), ("Nope", "Mapping"), ("value", "path"), F.lit("d")).alias("a"),
        fx.annotation_attribute(F.col("annotations"), ("Nope",), ("value",), F.lit("d")).alias("d"), fx.null_checks(F.col("predicates")).alias("n"),
    ).first()
    assert got.v == ["/a", "/b"] and got.a == "/a, /b, " and got.d == "d" and [tuple(x) for x in got.n] == [("x", True), ("y  && z", False), ("a != null || b", True), ("a  || b == null", False)]
    assert value(spark, fx.unfenced(F.lit('```json\n{"a": 1}\n```\nmore'))) == '{"a": 1}' and value(spark, fx.unfenced(F.lit(" {} "))) == "{}"
    assert [value(spark, fx.tolerant_json(lit(x), "struct<a:int>")) for x in (None, " ", "{oops")] == [None] * 3 and value(spark, fx.tolerant_json(F.lit('{"a": 2}'), "struct<a:int>")).a == 2
    assert value(spark, fx.camel_case(F.lit("Order line-item_v2"))) == "Order lineItemV2" and value(spark, fx.percent(F.lit(0.256))) == "26%"
    assert value(spark, fx.fatal(F.lit("Blocking"))) and not value(spark, fx.fatal(lit(None)))
    assert value(spark, fx.kept_metadata(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit(""), F.lit("c"), F.lit(None)))) == {"a": "1"}


def test_annotations_names_and_dialects(spark):
    kinds = "array<struct<name:string, qualified_name:string, values:map<string,string>>>"
    rows = [
        ([("Column", "p.Column", {"name": "x", "nullable": "False"}), ("Id", "p.Id", {}), ("NotNull", "v.NotNull", {})], "OrderThing", ["static", "private"], ["/lib/pg.jar", "/lib/PostgreSQL-42.jar"]),
        ([("NotBlank", "v.NotBlank", {}), ("ManyToOne", "p.ManyToOne", {}), ("OneToOne", "p.OneToOne", {})], "X", [], ["a h2-1.jar"]),
        ([("Service", "s.Service", {"value": " "}), ("Component", "s.Component", {"other": "q", "name": "named", "value": "later"}), ("Odd", "jakarta.validation.Odd", {})], "Y", ["protected", "public"], []),
    ]
    frame = spark.createDataFrame(rows, f"marks {kinds}, simple string, modifiers array<string>, classpath array<string>").coalesce(1)
    marks = F.col("marks")
    got = frame.select(fx.explicit_nullable(marks), fx.explicit_key(marks), fx.relation_type(marks), fx.bean_name(F.col("simple"), marks), fx.visibility(F.col("modifiers")), fx.database_dialect(F.col("classpath")), F.transform(marks, fx.is_validation)).collect()
    assert [tuple(r) for r in got] == [
        (False, True, None, "orderThing", "private", "org.hibernate.dialect.PostgreSQLDialect", [False, False, True]), (False, None, "ManyToOne", "x", "package", "org.hibernate.dialect.H2Dialect", [True, False, False]),
        (None, None, None, "named", "public", None, [False, False, True]),
    ]


def test_chips_of_lineage_nodes(spark):
    rows = [("service", "/", {}, 2, 1, 0, 0, 0, 5), ("interface", "/o", {"protocol": "http"}, 0, 0, 3, 0, 2, 0), ("operation", "/o", {"method": "post"}, 0, 0, 0, 1, 9, 1), ("integration", "", {"direction": "out", "kind": "mq"}, 0, 0, 0, 1, 0, 2), ("note", None, {}, 0, 0, 0, 0, 0, 0)]
    names = ("bounded_contexts", "aggregates", "commands", "blocking", "warning", "evidence")
    frame = spark.createDataFrame(rows, "kind string, path string, metadata map<string,string>, " + ", ".join(f"{n} long" for n in names)).coalesce(1)
    got = frame.select(runs.node_chips(F.col("kind"), F.col("path"), F.col("metadata"), {n: F.col(n) for n in names}).alias("c")).collect()
    assert [r.c for r in got] == [["2 interfaces", "1 data stores", "5 evidence"], ["3 operations", "http", "2 warnings", "No evidence"], ["POST /o", "1 blocking", "1 evidence"], ["out", "mq", "1 blocking", "2 evidence"], ["No evidence"]]


def test_decisions(spark):
    flags = {"running": False, "failed": False, "extracted": True, "fatal": 0, "trusted": True, "approved": True, "graph_on": True, "graph": True}
    at = lambda f, **more: value(spark, f({k: F.lit(v) for k, v in (flags | more).items()}))
    assert at(runs.current_blocker) == "Knowledge base ready" and at(runs.next_action) == "Ask grounded questions"
    assert at(runs.current_blocker, fatal=2, trusted=False) == "Fatal extraction conflicts" and at(runs.current_blocker, graph=False) == "Graph projection missing"
    assert at(runs.next_action, graph=False, fatal=2) == "Refresh knowledge" and at(runs.next_action, trusted=False) == "Review evidence confidence"
    facts = spark.range(1).select(*(F.lit(v).alias(k) for k, v in {"built": True, "types": True, "bodies": False, "call_graph": True, "booted": False, "spring": True, "web_mvc": False, "web_flux": False, "jpa": True, "validation": False, "security": False, "has_spring_beans": True, "has_http": False, "has_jpa": False, "has_validation": False, "has_security": False}.items()))
    got = {r.domain: r.status for r in document.confidence_report(facts).collect()}
    assert got == {"BUILD": "CONFIRMED", "TYPES": "CONFIRMED", "METHOD_BODIES": "PARTIAL", "CALL_GRAPH": "CONFIRMED", "SPRING_BEANS": "PARTIAL", "HTTP": "CONFIRMED", "JPA": "MISSING", "VALIDATION": "CONFIRMED", "SECURITY": "CONFIRMED"}


def test_specs_candidates_and_scenarios(spark):
    specs = spark.createDataFrame([("a", 1, "x", "1", False, None), ("b", 2, " ", None, True, "")], "id string, schema_version int, service_name string, generator_lock string, has_messaging boolean, idempotency_key string")
    assert {(r.id, r.code) for r in document.top_level_problems(specs).collect()} == {("b", x) for x in ("SCHEMA_VERSION_UNSUPPORTED", "SERVICE_NAME_REQUIRED", "GENERATOR_LOCK_REQUIRED", "MESSAGING_IDEMPOTENCY_REQUIRED")}
    one, two = (spark.createDataFrame([(x,)], "name string") for x in ("candidate", "draft"))
    issues = spark.createDataFrame([("X", "i", "ERROR")], "code string, item_id string, level string")
    assert [document.valid_or_fallback(one, i, two).first().name for i in (issues.limit(0), issues)] == ["candidate", "draft"]
    told = [("scenario:a.OrderImpl#x", "n", [], ["g"], ["w"], ["t", "u"]), ("x", "n", [None, "", "a.Order#y", "b.C#z"], [], ["w"], []), ("", "Named", [], [], [], ["t"]), (None, None, [], [], [], [])]
    told = spark.createDataFrame(told, "id string, name string, cited array<string>, given array<string>, when array<string>, then array<string>")
    assert {tuple(r) for r in document.grouped_scenarios(told).collect()} == {("Order", 2, 5), ("Named", 1, 1), ("Derived semantic scenarios", 1, 0)}


def test_ask(run):
    from quillgraph.plans import ask

    found, _, items, _ = run
    rows = ask.ask(items, found.nodes, "Which order flow is there?", 3).collect()
    assert rows[0].source == "document" and "flow" in rows[0].text.lower() and sum(r.source == "document" for r in rows) == 3
    assert any(r.source == "graph" and "Order flow" in r.text for r in rows)


def test_current_stage_gathers_no_events(spark, sf):
    """A user with a third of all events is aggregated before the shuffle: no array, no sort over a key."""
    plan = queries.current_stage(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Window" not in plan

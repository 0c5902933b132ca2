"""The cited document: synthesis from evidence, validation, confidence, lineage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hierarchy import hierarchical_rollup
from ..operators.lookup import first_match, unknown_references
from ..operators.numbering import running

#: Kinds of items below the service, with the label of the edge that leads to them (fixed values).
EDGE_LABELS = {"interface": "DECLARES", "operation": "DECLARES", "datastore": "USES", "integration": "INTEGRATES_WITH", "workflow": "RUNS", "rule": "CONSTRAINS", "scenario": "DESCRIBES", "note": "NOTES"}
ITEM = ("id", "kind", "parent_id", "name", "summary", "confidence_level", "ordinal")


def _items(rows: DataFrame, kind: str, parent: Column, node: Column, name: Column, summary: Column, level: str, ordinal: Column) -> DataFrame:
    return rows.select(F.concat_ws(":", F.lit(kind), node).alias("id"), F.lit(kind).alias("kind"), parent.alias("parent_id"), name.alias("name"), summary.alias("summary"), F.lit(level).alias("confidence_level"), ordinal.cast("long").alias("ordinal"))


def _cites(rows: DataFrame, kind: str, node: Column, first: Column, second: Column | None = None) -> DataFrame:
    """Rows of evidence nodes as citations of the item that _items() makes of `kind` and `node`."""
    number = lambda c: c.cast("long")
    return rows.select(F.concat_ws(":", F.lit(kind), node).alias("owner_id"), number(first).alias("first"), number(F.lit(0) if second is None else second).alias("second"), F.col("id").alias("evidence_node_id"))


def synthesize(spark: SparkSession, nodes: DataFrame, refs: DataFrame, service_name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Evidence -> (items, citations): a service with interfaces and operations, data store, integrations, workflows, rules, scenarios and notes.

    Nodes are read in order of `ordinal`; a citation names a node and its first ref, with nulls where it has none, and is a row
    from the start: no list of nodes is gathered, and operations and citations are numbered over ranges, however many
    belong to one interface. Nodes are used by every part of the plan, so they should be stored tables (snapshot.stored), and so should the items for what follows.
    """
    c = F.col
    first = lambda kind, name: F.min_by(F.when(c("kind") == kind, c("label")), F.when(c("kind") == kind, F.struct("ordinal", "id"))).alias(name)
    head = nodes.groupBy().agg(first("project", "project"), first("documentation-section", "section"))
    named = F.lit(service_name) if service_name and service_name.strip() else F.coalesce("project", F.lit("service"))
    head = head.select(named.alias("name"), F.coalesce("section", F.lit("Semantic draft synthesized from deterministic evidence")).alias("summary"))
    service = _items(head, "service", F.lit(None).cast("string"), c("name"), c("name"), c("summary"), "CONFIRMED", F.lit(0))
    root = service.select(F.col("id").alias("root"))
    under = lambda rows: rows.join(F.broadcast(root), how="cross")  # noqa: E731  one row
    whole = under(nodes.filter(c("kind").isin("project", "documentation-section")))
    cites = [_cites(whole, "service", F.substr("root", F.lit(len("service:") + 1)), c("ordinal"))]

    surface = F.when(c("kind").isin("http-endpoint", "contract-operation"), "http").when(c("kind") == "contract-channel", "async").when(c("kind").endswith("job"), "jobs")
    faces = running(nodes.withColumn("surface", surface).filter("surface IS NOT NULL").select("surface", "label", "ordinal", "id"), ["surface"], ["label", "ordinal", "id"], "at").withColumn("at", c("at") + 1)
    titles = F.create_map(*(F.lit(x) for kv in (("http", "HTTP Surface"), ("async", "Async Messaging"), ("jobs", "Background Jobs")) for x in kv))
    place = F.array_position(F.array(F.lit("http"), F.lit("async"), F.lit("jobs")), c("surface"))
    interfaces = _items(under(faces.select("surface").distinct()), "interface", c("root"), c("surface"), titles[c("surface")], c("surface"), "CONFIRMED", place)
    operations = _items(faces, "operation", F.concat(F.lit("interface:"), c("surface")), c("id"), c("label"), c("surface"), "CONFIRMED", place * 1_000_000_000 + c("at"))
    told = _items(under(operations.select("id", "name", "ordinal")), "scenario", c("root"), c("id"), c("name"), F.lit("operation"), "PARTIAL", c("ordinal"))
    cites += [_cites(faces, "interface", c("surface"), c("at")), _cites(faces, "operation", c("id"), F.lit(0)), _cites(faces, "scenario", F.concat(F.lit("operation:"), c("id")), F.lit(0))]

    stored = nodes.filter(c("kind").isin("persistence-entity", "database-migration"))
    flyway = F.bool_or((c("kind") == "database-migration") & (F.lower(F.coalesce(c("attributes")["tool"], F.lit(""))) == "flyway"))
    store = stored.groupBy().agg(F.count("*").alias("n"), F.coalesce(flyway, F.lit(False)).alias("flyway")).filter("n > 0")
    datastore = _items(under(store), "datastore", c("root"), F.lit("primary"), F.lit("Primary Relational Store"), F.when(c("flyway"), "flyway-relational").otherwise("liquibase-relational"), "CONFIRMED", F.lit(0))
    cites.append(_cites(stored, "datastore", F.lit("primary"), (c("kind") == "database-migration"), c("ordinal")))

    linked = nodes.filter(c("kind").isin("integration-artifact", "integration-config")).withColumn("keyword", F.coalesce(c("attributes")["keyword"], F.lit("integration")))
    by_keyword = linked.groupBy("keyword").agg(F.array_join(F.sort_array(F.collect_list("label")), ",").alias("labels"), F.min("ordinal").alias("ordinal"))
    integrations = _items(under(by_keyword), "integration", c("root"), c("keyword"), F.upper("keyword"), c("labels"), "PARTIAL", c("ordinal"))
    cites.append(_cites(linked, "integration", c("keyword"), c("ordinal")))

    low = F.lower("label")
    has = lambda *words: reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))
    sections = nodes.filter("kind = 'documentation-section'")
    jobs, flows, tales = nodes.filter(c("kind").endswith("job")), sections.filter(has("flow", "sync", "migration")), sections.filter(has("scenario"))
    ruled = nodes.filter(c("kind").isin("validation-constraint", "security-constraint"))
    five = sections.orderBy("label", "ordinal").limit(5)
    default = F.when(c("kind") == "validation-constraint", "Validation rule").otherwise("Security rule")
    own = [
        _items(under(jobs), "workflow", c("root"), c("id"), c("label"), F.lit("execution"), "CONFIRMED", c("ordinal")),
        _items(under(flows), "workflow", c("root"), c("id"), c("label"), F.lit("documentation"), "PARTIAL", 1_000_000_000 + c("ordinal")),
        _items(under(ruled), "rule", c("root"), c("id"), c("label"), F.coalesce(c("attributes")["expression"], default), "CONFIRMED", c("ordinal")),
        _items(under(tales), "scenario", c("root"), c("id"), c("label"), F.lit("documentation"), "PARTIAL", 10_000_000_000 + c("ordinal")),
        _items(under(five), "note", c("root"), c("id"), c("label"), F.lit("documentation"), "PARTIAL", c("ordinal")),
    ]
    cites += [_cites(rows, kind, c("id"), F.lit(0)) for rows, kind in ((jobs, "workflow"), (flows, "workflow"), (ruled, "rule"), (tales, "scenario"), (five, "note"))]

    items = reduce(DataFrame.unionByName, [service, interfaces, operations, datastore, integrations, told, *own]).select(*ITEM)
    once = reduce(DataFrame.unionByName, cites).groupBy("owner_id", "evidence_node_id").agg(F.min(F.struct("first", "second")).alias("p"))
    cited = running(once.select("owner_id", "evidence_node_id", "p.first", "p.second"), ["owner_id"], ["first", "second", "evidence_node_id"], "ordinal")
    first_refs = refs.select(F.col("owner_id").alias("evidence_node_id"), "file", "start_line", "end_line", F.col("ordinal").alias("ref_ordinal"))
    citations = first_match(cited.select("owner_id", "ordinal", "evidence_node_id"), first_refs, "evidence_node_id", ["ref_ordinal", "file", "start_line"], ["file", "start_line", "end_line"])
    return items, citations.withColumn("rationale", F.concat(F.lit("Derived from evidence node "), F.col("evidence_node_id")))


def validate(items: DataFrame, citations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(code, item_id, level): missing names and ids, items without citation, citations without or of an unknown node.

    Operations are not checked. Unknown nodes are only reported if any evidence is known.
    """
    checked = items.filter("kind <> 'operation'")
    issue = lambda rows, code: rows.select(F.lit(code).alias("code"), F.col("id").alias("item_id"), F.lit("ERROR").alias("level"))
    blank = lambda c: ~F.coalesce(F.col(c).rlike(r"\S"), F.lit(False))
    cites = citations.join(checked.select(F.col("id").alias("owner_id")), "owner_id", "left_semi").withColumn("id", F.col("owner_id"))
    named = cites.filter(~blank("evidence_node_id")).withColumn("node", F.col("evidence_node_id"))
    none = items.groupBy().agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(None).cast("string").alias("id"))
    return reduce(
        DataFrame.unionByName,
        [
            issue(none, "SPEC_EMPTY"),
            issue(checked.filter((F.col("kind") == "service") & blank("name")), "SERVICE_NAME_MISSING"),
            issue(checked.filter(blank("id")), "ID_MISSING"),
            issue(checked.join(citations.select(F.col("owner_id").alias("id")), "id", "left_anti"), "EVIDENCE_REQUIRED"),
            issue(cites.filter(blank("evidence_node_id")), "EVIDENCE_NODE_MISSING"),
            issue(unknown_references(named, nodes.select(F.col("id").alias("node")), "node"), "EVIDENCE_NODE_UNKNOWN"),
        ],
    )


def is_valid(issues: DataFrame) -> DataFrame:
    """One row: valid, unless some issue is an error."""
    return issues.groupBy().agg((~F.coalesce(F.bool_or(F.col("level") == "ERROR"), F.lit(False))).alias("valid"))


#: Kinds that a service counts among its items, and the names of the counts (fixed values); interfaces count their operations alone.
COUNTED = {"interface": "bounded_contexts", "datastore": "aggregates", "operation": "commands", "scenario": "entities", "integration": "events"}


def lineage(items: DataFrame, citations: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tree nodes with counts, edges): citations of an item count for it and all above it, but for the service's own.

    Citations of the service that name an unknown node are blocking conflicts of the service; nothing here is a mere warning. A service also
    counts its items of COUNTED kinds, an interface its operations; other items count none.
    """
    tree = items.select("id", F.col("parent_id").alias("parent"))
    cited = citations.select(F.col("owner_id").alias("id"), F.lit(1).cast("long").alias("evidence"))
    counts = hierarchical_rollup(tree, cited, root_counts_itself=False)
    service = items.filter("kind = 'service'").select(F.col("id").alias("owner_id"))
    broken = citations.filter("evidence_node_id IS NOT NULL").join(service, "owner_id", "left_semi").join(nodes.select(F.col("id").alias("evidence_node_id")), "evidence_node_id", "left_anti")
    blocking = broken.groupBy(F.col("owner_id").alias("id")).agg(F.count("*").alias("blocking"))
    whole = items.groupBy().agg(*(F.count_if(F.col("kind") == kind).alias(f"all_{name}") for kind, name in COUNTED.items()))
    own = items.filter("kind = 'operation'").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("own"))
    base = [F.when(F.col("kind") == "service", F.col(f"all_{name}")).otherwise(F.coalesce("own", F.lit(0)) if name == "commands" else 0).cast("long").alias(name) for name in COUNTED.values()]
    out = items.join(counts, "id").join(blocking, "id", "left").join(own, "id", "left").join(F.broadcast(whole), how="cross")
    out = out.select("id", "kind", "parent_id", "name", "evidence", F.lit(0).cast("long").alias("warning"), F.coalesce("blocking", F.lit(0)).alias("blocking"), *base)
    labels = F.create_map(*(F.lit(x) for kv in EDGE_LABELS.items() for x in kv))
    edges = items.filter("parent_id IS NOT NULL").select(F.concat(F.col("parent_id"), F.lit("->"), F.col("id"), F.lit(":"), labels[F.col("kind")]).alias("id"), F.col("parent_id").alias("source"), F.col("id").alias("target"), labels[F.col("kind")].alias("label"))
    return out, edges


def graph_projection(items: DataFrame, citations: DataFrame, nodes: DataFrame, edges: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """Both layers as versioned nodes (node_id, version, layer, kind, name) and links (source, target, type, version).

    Evidence edges stay if both ends exist; notes get no link to the service here; citations become DERIVED_FROM.
    """
    v = F.lit(version).alias("version")
    both = items.select(F.col("id").alias("node_id"), v, F.lit("semantic").alias("layer"), "kind", "name").unionByName(nodes.select(F.col("id").alias("node_id"), v, F.lit("evidence").alias("layer"), "kind", F.col("label").alias("name")))
    ids = nodes.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    labels = F.create_map(*(F.lit(x) for kv in EDGE_LABELS.items() for x in kv))
    links = kept.select("source", "target", F.col("kind").alias("type"), v)
    links = links.unionByName(items.filter("parent_id IS NOT NULL AND kind <> 'note'").select(F.col("parent_id").alias("source"), F.col("id").alias("target"), labels[F.col("kind")].alias("type"), v))
    derived = citations.join(ids.withColumnRenamed("id", "evidence_node_id"), "evidence_node_id", "left_semi").select(F.col("owner_id").alias("source"), F.col("evidence_node_id").alias("target"), F.lit("DERIVED_FROM").alias("type"), v)
    return both, links.unionByName(derived).distinct()


def runtime_backed(required: Column, booted: Column, facts: Column) -> Column:
    """Status of a domain that a running system confirms."""
    return F.when(~required, "CONFIRMED").when(booted, F.when(facts, "CONFIRMED").otherwise("PARTIAL")).otherwise(F.when(facts, "PARTIAL").otherwise("MISSING"))


def required_domains(flags: dict[str, Column]) -> Column:
    """The domains a project's capabilities ask for; four always."""
    f = lambda name: flags.get(name, F.lit(False))
    more = [("SPRING_BEANS", f("spring")), ("HTTP", f("web_mvc") | f("web_flux")), ("JPA", f("jpa")), ("VALIDATION", f("validation")), ("SECURITY", f("security"))]
    return F.array_compact(F.array(*map(F.lit, ("BUILD", "TYPES", "METHOD_BODIES", "CALL_GRAPH")), *(F.when(c, name) for name, c in more)))


def trust(report: DataFrame, required: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """trusted: every required (group, domain) is CONFIRMED; a missing one counts as not."""
    met = required.join(report, [*group, "domain"], "left").withColumn("ok", F.coalesce(F.col("status") == "CONFIRMED", F.lit(False)))
    return met.groupBy(*group).agg(F.bool_and("ok").alias("trusted"))


def confidence_score(report: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Share of CONFIRMED domains, 0 for none."""
    return report.groupBy(*group).agg(F.coalesce(F.avg((F.col("status") == "CONFIRMED").cast("double")), F.lit(0.0)).alias("score"))


def warnings(report: DataFrame) -> DataFrame:
    """Distinct details of domains that aren't confirmed, or their summary where there are none."""
    return report.filter("status <> 'CONFIRMED'").select(F.explode(F.when(F.size("details") > 0, F.col("details")).otherwise(F.array("summary"))).alias("warning")).distinct()


#: Domains that a running system backs, with the capability that asks for them (fixed values).
BACKED_DOMAINS = {"SPRING_BEANS": ("spring",), "HTTP": ("web_mvc", "web_flux"), "JPA": ("jpa",), "VALIDATION": ("validation",), "SECURITY": ("security",)}


def confidence_report(facts: DataFrame) -> DataFrame:
    """(domain, status) of nine domains from one row of flags.

    built, booted, capabilities by name, types, bodies, call_graph, and whether merged facts exist, by lower-cased domain name.
    """
    c = F.col
    rows = [("BUILD", F.when(c("built"), "CONFIRMED").otherwise("MISSING")), ("TYPES", F.when(c("types"), "CONFIRMED").otherwise("MISSING"))]
    rows += [(d, F.when(c(f), "CONFIRMED").otherwise("PARTIAL")) for d, f in (("METHOD_BODIES", "bodies"), ("CALL_GRAPH", "call_graph"))]
    rows += [(d, runtime_backed(reduce(lambda a, b: a | b, map(c, wants)), c("booted"), c(f"has_{d.lower()}"))) for d, wants in BACKED_DOMAINS.items()]
    return facts.select(F.explode(F.array(*(F.struct(F.lit(d).alias("domain"), s.alias("status")) for d, s in rows))).alias("x")).select("x.*")


def top_level_problems(specs: DataFrame) -> DataFrame:
    """(id, code): of specs (id, schema_version, service_name, generator_lock, has_messaging, idempotency_key), all problems of each."""
    blank = lambda name: ~F.coalesce(F.col(name).rlike(r"\S"), F.lit(False))
    codes = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("schema_version") == 1, F.lit(False)), "SCHEMA_VERSION_UNSUPPORTED"), F.when(blank("service_name"), "SERVICE_NAME_REQUIRED"),
        F.when(blank("generator_lock"), "GENERATOR_LOCK_REQUIRED"), F.when(F.coalesce("has_messaging", F.lit(False)) & blank("idempotency_key"), "MESSAGING_IDEMPOTENCY_REQUIRED"),
    ))
    return specs.select("id", F.explode(codes).alias("code"))


def valid_or_fallback(candidate: DataFrame, issues: DataFrame, fallback: DataFrame) -> DataFrame:
    """The candidate's rows if no issue is an error, else the fallback's; decided inside the plan by a one-row table."""
    valid = F.broadcast(is_valid(issues))
    return candidate.join(valid.filter("valid").drop("valid"), how="cross").unionByName(fallback.join(valid.filter("NOT valid").drop("valid"), how="cross"))


def grouped_scenarios(scenarios: DataFrame) -> DataFrame:
    """(owner, n, steps): scenarios (id, name, cited array, given, when, then) by what their first cited node, else their id, else their name belongs to, with the total of their steps."""
    from ..functions.text import scenario_owner

    some = lambda c: F.when(c != "", c)
    subject = F.coalesce(F.get(F.filter("cited", lambda x: some(x).isNotNull()), F.lit(0)), some(F.col("id")), some(F.col("name")))
    steps = F.size("given") + F.size("when") + F.size("then")
    return scenarios.groupBy(scenario_owner(subject).alias("owner")).agg(F.count("*").alias("n"), F.sum(steps).alias("steps"))

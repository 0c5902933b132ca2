"""From a merged code model and scanned files to one graph of evidence: nodes, edges, refs, reports."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import edge_id, extension, stable_id
from ..operators.merge import keep_first
from ..operators.retrieval import keyword_rows
from ..sources import files, scans


@dataclass
class Evidence:
    """nodes, edges, refs in the fixed schemas; diagnostics (message) may be empty."""

    nodes: DataFrame
    edges: DataFrame
    refs: DataFrame


class Adapter(Protocol):
    """What turns input tables into evidence: `name` and collect(tables)."""

    name: str

    def collect(self, tables: Mapping[str, DataFrame]) -> Evidence: ...


def _none(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def _attributes(**values: Column) -> Column:
    """A map of attributes; nulls become empty."""
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.coalesce(v.cast("string"), F.lit("")))))


def nodes_of(rows: DataFrame, node_id: Column, kind: str | Column, label: Column, path: Column, ordinal: Column | None = None, /, **attributes: Column) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    attrs = _attributes(**attributes) if attributes else F.create_map().cast("map<string,string>")
    return rows.select(node_id.alias("id"), kind.alias("kind"), label.alias("label"), path.alias("path"), attrs.alias("attributes"), (F.lit(0).cast("long") if ordinal is None else ordinal.cast("long")).alias("ordinal"))


def edges_of(rows: DataFrame, kind: str, source: Column, target: Column) -> DataFrame:
    return rows.select(edge_id(kind, source, target).alias("id"), source.alias("source"), target.alias("target"), F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("ordinal"))


def file_id(path: Column) -> Column:
    return stable_id("file", path)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def provenance_evidence(owners: DataFrame) -> Evidence:
    """(id, provenance) -> source files that the owners are defined in, edges to them, and refs."""
    p = owners.select("id", F.posexplode("provenance").alias("n", "p")).select("id", "n", "p.*")
    nodes = nodes_of(p, file_id(F.col("file")), "source-file", F.substring_index("file", "/", -1), F.col("file"), extension=extension(F.col("file")))
    refs = p.select(F.col("id").alias("owner_id"), file_id(F.col("file")).alias("evidence_node_id"), "file", "start_line", "end_line", F.lit("").alias("excerpt"), F.col("n").cast("long").alias("ordinal"))
    return Evidence(nodes, edges_of(p, "DEFINED_IN", F.col("id"), file_id(F.col("file"))), refs)


def core_evidence(spark: SparkSession, t: Mapping[str, DataFrame], project_root: str) -> Evidence:
    """Nodes and edges of the code model: files (path, text), lines, types, methods, params, endpoints, entities, beans, validations, securities.

    Later rows replace earlier ones of equal id, but for literals, call targets and provenance files, which
    only fill gaps; `rank` in assemble() says so. Null attributes are empty.
    """
    project = stable_id("project", F.lit(project_root))
    c = F.col
    nodes = [nodes_of(spark.range(1), project, "project", F.lit(project_root.rstrip("/").rsplit("/", 1)[-1]), F.lit(project_root))]
    edges, refs, gaps = [], [], []
    files, types, methods = t["files"], t["types"], t["methods"]
    nodes.append(nodes_of(files, file_id(c("path")), "source-file", F.substring_index("path", "/", -1), c("path"), extension=extension(c("path"))))
    edges.append(edges_of(files, "CONTAINS", project, file_id(c("path"))))
    imports = scans.import_statements(t["lines"])
    import_id = stable_id("import", c("path"), c("statement"))
    nodes.append(nodes_of(imports, import_id, "import", c("statement"), c("path"), c("line"), **{"import": c("statement")}))
    edges.append(edges_of(imports, "IMPORTS", file_id(c("path")), import_id))

    nodes.append(nodes_of(types, c("id"), "java-type", c("qualified_name"), c("qualified_name"), c("ordinal"), kind=c("kind"), packageName=c("package_name")))
    marks = types.select("id", "qualified_name", F.explode("annotations").alias("a"))
    mark_id = stable_id("annotation", c("id"), c("a.qualified_name"))
    nodes.append(nodes_of(marks, mark_id, "annotation", c("a.qualified_name"), c("qualified_name"), qualifiedName=c("a.qualified_name")))
    edges.append(edges_of(marks, "ANNOTATED_WITH", c("id"), mark_id))

    owned = methods.join(types.select(c("id").alias("type_id"), "simple_name"), "type_id")
    nodes.append(nodes_of(owned, c("id"), "java-method", F.concat_ws(".", "simple_name", "name"), c("id"), c("ordinal"), returnType=c("return_type"), visibility=c("visibility")))
    edges.append(edges_of(owned, "DECLARES", c("type_id"), c("id")))
    nodes.append(nodes_of(t["params"], c("id"), "method-parameter", c("name"), c("method_id"), c("ordinal"), type=c("type")))
    edges.append(edges_of(t["params"], "DECLARES", c("method_id"), c("id")))
    literals = methods.select("id", F.explode("body.literals").alias("literal")).filter(c("literal").rlike(r"\S"))
    literal_id = stable_id("literal", c("id"), c("literal"))
    gaps.append(nodes_of(literals, literal_id, "literal", c("literal"), c("id"), value=c("literal")))
    edges.append(edges_of(literals, "USES_LITERAL", c("id"), literal_id))
    calls = methods.select("id", F.explode("body.call_edges").alias("call")).select("id", "call.owner_type", "call.method_name")
    known = keep_first(types, "qualified_name", "ordinal").select(c("qualified_name").alias("owner_type"), c("id").alias("owner_id"))
    calls = calls.join(known, "owner_type", "left").withColumn("target", F.coalesce("owner_id", stable_id("external-call-target", c("owner_type"), c("method_name"))))
    gaps.append(nodes_of(calls.filter("owner_id IS NULL"), c("target"), "call-target", F.concat_ws(".", "owner_type", "method_name"), c("owner_type"), ownerType=c("owner_type"), methodName=c("method_name")))
    edges.append(edges_of(calls, "CALLS", c("id"), c("target")))

    endpoints = t["endpoints"]
    nodes.append(nodes_of(endpoints, c("id"), "http-endpoint", F.concat_ws(" ", F.coalesce("http_method", F.lit("UNKNOWN")), "full_path"), c("full_path"), c("ordinal"), method=c("http_method"), bean=c("bean_name")))
    edges.append(edges_of(endpoints.filter(c("method_id").rlike(r"\S")), "EXPOSES", c("method_id"), c("id")))
    nodes.append(nodes_of(t["entities"], c("id"), "persistence-entity", c("type_id"), c("table_name"), c("ordinal"), tableName=c("table_name")))
    edges.append(edges_of(t["entities"], "PERSISTS", c("type_id"), c("id")))
    nodes.append(nodes_of(t["beans"], c("id"), "bean", c("name"), c("type_id"), c("ordinal"), scope=c("scope")))
    edges.append(edges_of(t["beans"], "BACKED_BY", c("id"), c("type_id")))
    nodes.append(nodes_of(t["validations"], c("id"), "validation-constraint", c("annotation"), c("target_id"), c("ordinal"), targetId=c("target_id")))
    edges.append(edges_of(t["validations"], "CONSTRAINS", c("target_id"), c("id")))
    nodes.append(nodes_of(t["securities"], c("id"), "security-constraint", c("kind"), c("target_id"), c("ordinal"), expression=c("expression")))
    edges.append(edges_of(t["securities"], "SECURES", c("target_id"), c("id")))
    proven = provenance_evidence(types.select("id", "provenance").unionByName(methods.select("id", "provenance")))
    refs += [proven.refs, provenance_evidence(endpoints.select("id", "provenance")).refs]
    return assemble([Evidence(union(nodes), union([*edges, proven.edges]), union(refs)), Evidence(union([*gaps, proven.nodes]), _none(spark, schemas.EDGES), _none(spark, schemas.REFS))])


def assemble(parts: list[Evidence]) -> Evidence:
    """One graph of several: of equal ids the earlier part's node and edge stays; refs are all kept."""
    rank = lambda frames: union([f.withColumn("rank", F.lit(n)) for n, f in enumerate(frames)])
    first = lambda frames: keep_first(rank(frames), "id", "rank", "ordinal").drop("rank")
    return Evidence(first([p.nodes for p in parts]), first([p.edges for p in parts]), union([p.refs for p in parts]))


def _file_refs(rows: DataFrame, owner: Column, target: Column, line: Column, text: Column) -> DataFrame:
    return rows.select(owner.alias("owner_id"), target.alias("evidence_node_id"), F.col("path").alias("file"), line.cast("int").alias("start_line"), line.cast("int").alias("end_line"), text.alias("excerpt"), line.cast("long").alias("ordinal"))


class Documentation:
    """Markdown files and their headings."""

    name = "documentation"

    def collect(self, tables: Mapping[str, DataFrame]) -> Evidence:
        c = F.col
        files = tables["resources"].filter(F.lower("path").endswith(".md"))
        found = scans.headings(tables["resource_lines"].filter(F.lower("path").endswith(".md")))
        file, section = stable_id("doc", c("path")), stable_id("doc-section", c("path"), c("line"))
        nodes = union([nodes_of(files, file, "documentation-file", F.substring_index("path", "/", -1), c("path")), nodes_of(found, section, "documentation-section", c("title"), c("path"), c("line"), level=c("level"), line=c("line"))])
        return Evidence(nodes, edges_of(found, "CONTAINS", file, section), _file_refs(found, section, file, c("line"), F.trim("value")))


class Contracts:
    """API and message contracts."""

    name = "contracts"

    def collect(self, tables: Mapping[str, DataFrame]) -> Evidence:
        c = F.col
        name = F.lower(F.substring_index("path", "/", -1))
        yaml = name.rlike(r"\.ya?ml$")
        opened, messages = yaml & F.contains(name, F.lit("openapi")), yaml & F.contains(name, F.lit("asyncapi"))
        files = tables["resources"].filter(opened | messages)
        contract = stable_id("contract", c("path"))
        nodes = [nodes_of(files, contract, F.when(opened, "openapi-contract").otherwise("asyncapi-contract"), F.substring_index("path", "/", -1), c("path"), format=F.when(opened, "openapi").otherwise("asyncapi"))]
        ops = scans.openapi_operations(tables["resources"].filter(opened))
        channels = scans.asyncapi_channels(tables["resources"].filter(messages & ~opened))
        op, channel = stable_id("contract-op", c("path"), c("url"), c("method")), stable_id("contract-channel", c("path"), c("channel"))
        place = F.concat("path", F.lit("#L"), c("line").cast("string"))
        nodes.append(nodes_of(ops, op, "contract-operation", F.concat_ws(" ", "method", "url"), place, c("line"), method=c("method"), path=c("url")))
        nodes.append(nodes_of(channels, channel, "contract-channel", c("channel"), place, c("line"), channel=c("channel")))
        edges = union([edges_of(ops, "DECLARES", contract, op), edges_of(channels, "DECLARES", contract, channel)])
        refs = union([_file_refs(ops, op, contract, c("line"), F.concat(F.lower("method"), F.lit(":"))), _file_refs(channels, channel, contract, c("line"), F.concat("channel", F.lit(":")))])
        return Evidence(union(nodes), edges, refs)


class Migrations:
    """Database migration files."""

    name = "migrations"

    def collect(self, tables: Mapping[str, DataFrame]) -> Evidence:
        c = F.col
        found = scans.migration_files(tables["resources"])
        one, many = stable_id("migration", c("path")), stable_id("migration-collection", c("collection"))
        grouped = found.filter("collection IS NOT NULL")
        nodes = union([nodes_of(found, one, "database-migration", F.substring_index("path", "/", -1), c("path"), tool=c("tool")), nodes_of(grouped, many, "migration-collection", F.substring_index("collection", "/", -1), c("collection"), directory=c("collection"))])
        return Evidence(nodes, edges_of(grouped, "CONTAINS", many, one), _none(found.sparkSession, schemas.REFS))


class Scheduling:
    """Scheduled and recurring methods."""

    name = "scheduling"

    def collect(self, tables: Mapping[str, DataFrame]) -> Evidence:
        c = F.col
        found = scans.jobs(tables["types"], tables["methods"])
        job = stable_id("job", c("method_id"))
        return Evidence(nodes_of(found, job, c("kind"), c("label"), c("method_id"), ownerType=c("qualified_name"), method=c("name")), edges_of(found, "DECLARES", c("type_id"), job), _none(found.sparkSession, schemas.REFS))


class Integrations:
    """Types and files that name an integration technology: a node per keyword, not per document."""

    name = "integration-patterns"

    def collect(self, tables: Mapping[str, DataFrame]) -> Evidence:
        c = F.col
        types = keyword_rows(tables["types"].withColumn("_hay", F.concat_ws(" ", "qualified_name", "simple_name")), scans.INTEGRATION_KEYWORDS, "_hay")
        files = keyword_rows(tables["resources"], scans.INTEGRATION_KEYWORDS)
        artifact, config = stable_id("integration-artifact", c("keyword"), c("id")), stable_id("integration-config", c("keyword"), c("path"))
        nodes = union([
            nodes_of(types, artifact, "integration-artifact", c("simple_name"), c("qualified_name"), keyword=c("keyword"), qualifiedName=c("qualified_name")),
            nodes_of(files, config, "integration-config", F.substring_index("path", "/", -1), c("path"), keyword=c("keyword"), file=c("path")),
        ])
        return Evidence(nodes, edges_of(types, "BACKED_BY", artifact, c("id")), _none(nodes.sparkSession, schemas.REFS))


ADAPTERS: tuple[Adapter, ...] = (Documentation(), Contracts(), Migrations(), Scheduling(), Integrations())


def adapter_report(spark: SparkSession, collected: Mapping[str, Evidence]) -> DataFrame:
    """(adapter, status, node_count, edge_count): counted before ids are made unique; SKIPPED if an adapter found nothing."""
    names = spark.createDataFrame([(n,) for n in collected], "adapter string")
    counts = union([x.select(F.lit(n).alias("adapter"), F.lit(k).alias("k")) for n, e in collected.items() for k, x in (("n", e.nodes), ("e", e.edges))])
    counts = counts.groupBy("adapter").agg(F.count_if(F.col("k") == "n").alias("node_count"), F.count_if(F.col("k") == "e").alias("edge_count"))
    out = names.join(counts, "adapter", "left").select("adapter", F.coalesce("node_count", F.lit(0)).alias("node_count"), F.coalesce("edge_count", F.lit(0)).alias("edge_count"))
    return out.withColumn("status", F.when((F.col("node_count") == 0) & (F.col("edge_count") == 0), "SKIPPED").otherwise("COLLECTED"))


def build(spark: SparkSession, tables: Mapping[str, DataFrame], project_root: str, adapters: tuple[Adapter, ...] = ADAPTERS) -> tuple[Evidence, DataFrame]:
    """The whole graph and the adapters' report. `resources` (path, text), `resource_lines`, and the code model's tables."""
    collected = {a.name: a.collect(tables) for a in adapters}
    return assemble([core_evidence(spark, tables, project_root), *collected.values()]), adapter_report(spark, collected)


def stored(evidence: Evidence, folder: str, run_id: str) -> Evidence:
    """The graph as tables of a run. Synthesis, validation and projection use it many times: store it first."""
    tables = files.stored({"nodes": evidence.nodes, "edges": evidence.edges, "refs": evidence.refs}, folder, run_id)
    return Evidence(tables["nodes"], tables["edges"], tables["refs"])

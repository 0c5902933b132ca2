"""Comparing versions and sets: differences, drift, ordered renames, rule filters."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_token, strip_suffixes


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of a that are not in b."""
    return a.subtract(b)


def symmetric_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key) values in exactly one of two sets; one aggregation instead of two differences."""
    both = a.select(key, F.lit(1).alias("side")).unionByName(b.select(key, F.lit(2).alias("side")))
    return both.groupBy(key).agg(F.min("side").alias("lo"), F.max("side").alias("hi")).filter("lo = hi").select(key)


def version_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, change): REMOVED if only the older version has it, ADDED if only the newer; the two can't be told apart otherwise."""
    both = a.select(key, F.lit(1).alias("side")).unionByName(b.select(key, F.lit(2).alias("side")))
    sides = both.groupBy(key).agg(F.min("side").alias("lo"), F.max("side").alias("hi")).filter("lo = hi")
    return sides.select(key, F.when(F.col("lo") == 1, "REMOVED").otherwise("ADDED").alias("change"))


def contract_diff(old_operations: DataFrame, new_operations: DataFrame, old_schemas: DataFrame, new_schemas: DataFrame) -> DataFrame:
    """(change, name): added and removed operations, and schema names that only one side has."""
    ops = version_diff(old_operations, new_operations, "name").select(F.lower(F.concat(F.col("change"), F.lit("_operation"))).alias("change"), "name")
    return ops.unionByName(symmetric_difference(old_schemas, new_schemas, "name").select(F.lit("changed_schema").alias("change"), "name"))


# What drift leaves out, and what keeps an interface in (fixed values).
INFRA_SUFFIXES = (
    "Repository", "Mapper", "Exception", "Config", "Configuration", "Validator", "Utils", "Util", "Projection", "Interceptor", "Serializer", "Deserializer", "Converter",
    "Resolver", "Handler", "Listener", "Publisher", "Consumer", "Producer", "UseCase", "Sanitizer", "Calculator", "UserDetails", "Facade", "Filter", "Anonymizer",
)
DTO_SUFFIXES = ("Dto", "DTO", "Request", "Response", "Responses", "PersistDto", "ViewDto", "SummaryDto", "RequestDto", "ResponseDto")
INFRA_ANNOTATIONS = (
    "Repository", "Configuration", "EnableAsync", "EnableCaching", "EnableJpaRepositories", "EnableTransactionManagement",
    "EnableScheduling", "Aspect", "EnableAspectJAutoProxy", "ConfigurationProperties", "PropertySource", "SpringBootApplication",
)
DOMAIN_ANNOTATIONS = ("Service", "RestController", "Controller", "Component", "FeignClient", "Entity", "MappedSuperclass", "Embeddable")
COMMAND_ANNOTATIONS, ENTITY_ANNOTATIONS = DOMAIN_ANNOTATIONS[:5], DOMAIN_ANNOTATIONS[5:]
CANONICAL_SUFFIXES = ("Bootstrap", "Security", "Anonymization", "Policy", "Context")


def _marked(annotations: Column, names: Sequence[str]) -> Column:
    return F.exists(F.coalesce(annotations, F.array().cast("array<string>")), lambda a: a.isin(*names))


def skipped_type(name: Column, kind: Column, annotations: Column) -> Column:
    """Whether a type is left out of drift: annotations, enums, plain interfaces, abstract bases, infrastructure, transfer objects, and what is called so once its suffixes are off."""
    by_kind = F.coalesce(kind.isin("annotation", "enum") | ((kind == "interface") & ~_marked(annotations, DOMAIN_ANNOTATIONS)), F.lit(False))
    by_name = name.rlike(f"^(?:Abstract|Base)|(?:{'|'.join(INFRA_SUFFIXES + DTO_SUFFIXES)})$") | strip_suffixes(name).rlike(rf"^\s*$|(?:{'|'.join(CANONICAL_SUFFIXES)})$")
    return by_kind | by_name | _marked(annotations, INFRA_ANNOTATIONS)


def trivial_method(name: Column, arity: Column) -> Column:
    """Getters without arguments, setters with one, object methods, generated ones; case-folded."""
    low = F.lower(name)
    return (low.startswith("get") & (arity == 0)) | (low.startswith("set") & (arity == 1)) | low.isin("equals", "hashcode", "tostring") | low.startswith("lambda$") | low.startswith("access$")


def drift_report(types: DataFrame, methods: DataFrame, approved: DataFrame, commands: DataFrame | None = None) -> DataFrame:
    """(kind, what, subject, blocking) of types (id, name, kind, annotations), methods (id, type_id, name, arity), approved aggregates
    (name, path) and approved commands (aggregate, name).

    A type that isn't skipped (nor another of its name) and has a domain annotation is UNSUPPORTED_HANDWRITTEN if no approved aggregate
    has the canonical token of its stripped name, and so are its methods that are neither trivial nor approved commands; `hook` in a
    name makes it a HANDWRITTEN_HOOK, which doesn't block. Types of commands without a non-trivial method are passed over. Approved
    aggregates that no type stands for are SPEC_OWNED. Methods of matched types are never reported.
    """
    c = F.col
    told = types.withColumn("skipped", skipped_type(c("name"), c("kind"), c("annotations"))).withColumn("token", canonical_token(strip_suffixes(c("name"))))
    names = approved.select(canonical_token(c("name")).alias("token"), "path")
    acting = methods.filter(~trivial_method(c("name"), c("arity")))
    live = told.join(told.filter("skipped").select("name").distinct(), "name", "left_anti").filter(_marked(c("annotations"), DOMAIN_ANNOTATIONS))
    busy = acting.select(c("type_id").alias("id")).distinct().withColumn("busy", F.lit(True))
    live = live.join(busy, "id", "left").filter(_marked(c("annotations"), ENTITY_ANNOTATIONS) | ~_marked(c("annotations"), COMMAND_ANNOTATIONS) | c("busy"))
    lost = live.join(names.select("token").distinct(), "token", "left_anti")
    kind = F.when(F.contains(F.lower("name"), F.lit("hook")), F.lit("HANDWRITTEN_HOOK")).otherwise(F.lit("UNSUPPORTED_HANDWRITTEN")).alias("kind")
    found = lost.select(kind, F.lit("type").alias("what"), c("id").cast("string").alias("subject"))
    calls = acting.join(lost.select(c("id").alias("type_id"), "token"), "type_id")
    if commands is not None:
        known = commands.select(canonical_token(c("aggregate")).alias("token"), canonical_token(c("name")).alias("command")).distinct()
        calls = calls.withColumn("command", canonical_token(c("name"))).join(known, ["token", "command"], "left_anti")
    found = found.unionByName(calls.select(kind, F.lit("method").alias("what"), c("id").cast("string").alias("subject")))
    gone = names.join(told.filter("NOT skipped").select("token").distinct(), "token", "left_anti")
    found = found.unionByName(gone.select(F.lit("SPEC_OWNED").alias("kind"), F.lit("aggregate").alias("what"), c("path").alias("subject")))
    return found.withColumn("blocking", c("kind") != "HANDWRITTEN_HOOK")


def migrate(rows: DataFrame, steps: Sequence[dict]) -> DataFrame:
    """Apply renames in order: {column, old, new, scope?: (column, value)}. A later step sees what an earlier one made.

    A blank or missing scope is everywhere; scopes match without case. The steps are a short script, so
    they fold into one projection of nested conditions; the data make no move.
    """
    for s in steps:
        hit = F.col(s["column"]) == F.lit(s["old"])
        column, value = s.get("scope") or (None, "")
        if column and value.strip():
            hit &= F.lower(F.col(column)) == F.lit(value.lower())
        rows = rows.withColumn(s["column"], F.when(hit, F.lit(s["new"])).otherwise(F.col(s["column"])))
    return rows


def migration_actions(rows: DataFrame, steps: Sequence[dict]) -> DataFrame:
    """(step, matches): how many rows each step changes when run in order; a step without matches is an error to report."""
    counts = []
    for n, s in enumerate(steps):
        hit = F.col(s["column"]) == F.lit(s["old"])
        column, value = s.get("scope") or (None, "")
        if column and value.strip():
            hit &= F.lower(F.col(column)) == F.lit(value.lower())
        counts.append(migrate(rows, steps[:n]).agg(F.count_if(hit).alias("matches")).select(F.lit(n).alias("step"), "matches"))
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


_QUOTED = re.compile(r"('[^']*'|\"[^\"]*\")")
#: An identifier in capitals is a constant of text.
_CONSTANT = re.compile(r"(?<![\w.])(?!(?:AND|OR|NOT|NULL|TRUE|FALSE)\b)([A-Z_]+)(?![\w.(]|\s+\()")
_DURATION = re.compile(r"\bP(?=[0-9T])(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?\b")


def rule_to_sql(rule: str) -> str:
    """A rule text as a Spark SQL condition: && || == become AND OR =, ISO durations intervals, double quotes single ones, identifiers in capitals texts.

    Spark parses and type-checks it; there is no parser of our own.
    """
    out = []
    for n, part in enumerate(_QUOTED.split(rule)):
        if n % 2:
            out.append("'" + part[1:-1].replace("'", "''") + "'")
            continue
        part = _CONSTANT.sub(r"'\1'", part)
        part = part.replace("&&", " AND ").replace("||", " OR ").replace("==", "=")
        part = _DURATION.sub(lambda m: "INTERVAL '{} {}:{}:{}' DAY TO SECOND".format(*(x or 0 for x in m.groups())), part)
        out.append(re.sub(r"\bduration\s*\(([^,()]+),([^()]+)\)", r"(\2 - \1)", part))
    return "".join(out)


def rule_filter(rows: DataFrame, rule: str) -> DataFrame:
    """Rows that meet a rule."""
    return rows.filter(F.expr(rule_to_sql(rule)))


def rule_problem(rows: DataFrame, rule: str) -> str | None:
    """Why a rule can't apply to these columns: unknown identifier, mismatched types, not a condition; null if it can."""
    try:
        kind = rows.select(F.expr(rule_to_sql(rule)).alias("r")).schema["r"].dataType.simpleString()
    except AnalysisException as e:
        return "RULE_UNKNOWN_IDENTIFIER" if "UNRESOLVED" in str(e.getCondition()) else "RULE_TYPE_MISMATCH" if "DATATYPE_MISMATCH" in str(e.getCondition()) else "RULE_UNREADABLE"
    return None if kind == "boolean" else "RULE_TYPE_BOOLEAN"

"""Derivations on code models: capabilities, drafts, grouped and chained lookups, serialised texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_token, command_name, http_verb, storage_type, strip_suffixes
from .numbering import running

#: What on a class path, and what in sources, shows a capability (fixed values).
CLASSPATH_SIGNS = {
    "spring": ("spring-context", "spring-beans", "spring-core"), "boot": ("spring-boot",), "web_mvc": ("spring-webmvc",), "web_flux": ("spring-webflux",),
    "jpa": ("spring-data-jpa", "hibernate-core", "jakarta.persistence"), "validation": ("jakarta.validation", "hibernate-validator"), "security": ("spring-security",),
}
SOURCE_SIGNS = {
    "spring": ("@Service", "@RestController", "@Component"), "boot": ("@SpringBootApplication",), "web_mvc": ("@RequestMapping", "@GetMapping", "@PostMapping"),
    "jpa": ("@Entity", "@Table"), "validation": ("@Valid", "@NotNull"), "security": ("@PreAuthorize", "@Secured", "@RolesAllowed"),
}


def _any(text: Column, signs: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, signs)), lambda s: F.contains(text, s)) if signs else F.lit(False)


def capabilities(classpath: DataFrame, sources: DataFrame, group: Sequence[str] = (), signs: Mapping | None = None, source_signs: Mapping | None = None, gate: str = "boot") -> DataFrame:
    """A row of flags: class path entries (entry) show them; sources (text) add theirs only where the gate flag wasn't shown."""
    signs, more = signs or CLASSPATH_SIGNS, source_signs or SOURCE_SIGNS
    never = F.lit(False)
    shown = classpath.groupBy(*group).agg(*(F.coalesce(F.bool_or(_any(F.lower("entry"), [x.lower() for x in s])), never).alias(k) for k, s in signs.items()))
    read = sources.groupBy(*group).agg(*(F.coalesce(F.bool_or(_any(F.col("text"), more.get(k, ()))), never).alias(f"_{k}") for k in signs))
    both = shown.join(read, list(group), "full_outer") if group else shown.join(F.broadcast(read), how="cross")
    flag = lambda k: F.coalesce(k, never)
    return both.select(*group, *((flag(k) | (~flag(gate) & flag(f"_{k}"))).alias(k) for k in signs))


def grouped_refs(refs: DataFrame, owner: str, order: str, columns: Sequence[str]) -> DataFrame:
    """(owner, refs): each owner's refs as an array in their order."""
    return refs.groupBy(owner).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("refs"))


def kind_counts(rows: DataFrame, kind: str, kinds: Sequence[str], more: Mapping[str, Column] | None = None) -> DataFrame:
    """One row: how many of each kind, and conditional counts; zeros on an empty table."""
    return rows.groupBy().agg(*(F.count_if(F.col(kind) == k).alias(k.replace("-", "_")) for k in kinds), *(F.count_if(x).alias(n) for n, x in (more or {}).items()))


def first_resolvable(lists: DataFrame, row_id: str, ids: str, known: DataFrame, key: str, value: str) -> DataFrame:
    """(row_id, value): of a list of ids the first that is known; null if none is."""
    exploded = lists.select(row_id, F.posexplode_outer(ids).alias("_at", key))
    found = exploded.join(known.select(key, value), key).groupBy(row_id).agg(F.min_by(value, "_at").alias(value))
    return lists.select(row_id).join(found, row_id, "left")


def chained(edges: DataFrame, first: str, second: str) -> DataFrame:
    """(top, middle, bottom) of two edges of given kinds behind one another."""
    a = edges.filter(F.col("kind") == first).select(F.col("source").alias("top"), F.col("target").alias("middle"))
    b = edges.filter(F.col("kind") == second).select(F.col("source").alias("middle"), F.col("target").alias("bottom"))
    return a.join(b, "middle").select("top", "middle", "bottom")


def two_key_lookup(left: DataFrame, known: DataFrame, name: str, key: str, path: str) -> DataFrame:
    """Paths by raw name, else by canonical name; unmatched rows keep a null path, for diagnostics."""
    raw = known.groupBy(F.col(key).alias("_raw")).agg(F.min(path).alias("_a"))
    folded = known.groupBy(canonical_token(F.col(key)).alias("_token")).agg(F.min(path).alias("_b"))
    out = left.withColumn("_raw", F.col(name)).withColumn("_token", canonical_token(F.col(name))).join(raw, "_raw", "left").join(folded, "_token", "left")
    return out.withColumn(path, F.coalesce("_a", "_b")).drop("_raw", "_token", "_a", "_b")


def running_numbers(rows: DataFrame, group: Sequence[str], *order: str) -> DataFrame:
    """Numbers from 1 within each group: adds `number`. A group of any size is numbered in ranges."""
    return running(rows, group, order, "number").withColumn("number", F.col("number") + 1)


def draft_aggregates(entities: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(aggregate, n_entities, commands): entities (type_name) and endpoints (owner_name, full_path, http_method) meet on the
    stripped name of their class; a group that only one side has stays. An endpoint without an owner takes its path's first segment."""
    things = entities.groupBy(strip_suffixes(F.col("type_name")).alias("aggregate")).agg(F.count("*").alias("n_entities"))
    first = F.initcap(F.regexp_extract("full_path", "^/*([^/{}]+)", 1))
    verbs = endpoints.withColumn("aggregate", F.coalesce(strip_suffixes(F.col("owner_name")), first)).filter(F.coalesce(F.col("http_method"), F.lit("")) != "GET")
    commands = verbs.groupBy("aggregate").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "http_method", F.coalesce(command_name(F.col("full_path")), F.lit(""))))), ",").alias("commands"))
    return things.join(commands, "aggregate", "full_outer").select("aggregate", F.coalesce("n_entities", F.lit(0)).alias("n_entities"), F.coalesce("commands", F.lit("")).alias("commands"))


def canonical_paths(rows: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Adds canonical_path: canonical tokens of the level columns, joined by `/`, as far as they are given."""
    return rows.withColumn("canonical_path", F.concat_ws("/", *(F.when(F.col(x).isNotNull(), canonical_token(F.col(x))) for x in levels)))


def column_list(fields: DataFrame, entity: str, name: str, spec: str, primary: str, order: str) -> DataFrame:
    """(entity, ddl): `name type[ primary key], ...` in order."""
    part = F.concat(canonical_token(F.col(name)), F.lit(" "), storage_type(F.col(spec)), F.when(F.col(primary), " primary key").otherwise(""))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("p")))), lambda x: x["p"])
    return fields.groupBy(entity).agg(F.array_join(parts, ", ").alias("ddl"))


def serialized(rows: DataFrame, template: Sequence[tuple[str, str]], name: str = "text") -> DataFrame:
    """One text per row: `LABEL value` lines for the columns that are given."""
    return rows.withColumn(name, F.concat_ws("\n", *(F.when(F.col(col).isNotNull(), F.concat(F.lit(f"{label} "), F.col(col).cast("string"))) for label, col in template)))


def diagnostics(lines: DataFrame, text: str, order: str, top: int = 3, shortest: int = 12) -> DataFrame:
    """The first few distinct cleaned lines of some length; if any looks like an error, only such lines count."""
    from ..functions.text import clean_line

    cleaned = lines.select(F.col(order), clean_line(F.col(text)).alias("message")).filter(F.length("message") >= shortest)
    unique = cleaned.groupBy("message").agg(F.min(order).alias(order)).withColumn("bad", F.col("message").rlike("(?i)error|exception|failed|cannot"))
    some = unique.groupBy().agg(F.coalesce(F.bool_or("bad"), F.lit(False)).alias("some"))
    return unique.join(F.broadcast(some), how="cross").filter(F.col("bad") | ~F.col("some")).orderBy(order, "message").limit(top).select(order, "message")


def first_over_lists(lists: Sequence[DataFrame], columns: Sequence[str], order: str, top: int = 8) -> DataFrame:
    """The first rows of several lists put behind one another."""
    out = None
    for n, rows in enumerate(lists):
        part = rows.select(F.lit(n).alias("list"), F.col(order).alias("place"), *columns)
        out = part if out is None else out.unionByName(part)
    return out.orderBy("list", "place", *columns).limit(top)


def filled_defaults(rows: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Missing values take defaults; missing columns are added."""
    return rows.select(*(F.coalesce(F.col(c), defaults[c]).alias(c) if c in defaults else F.col(c) for c in rows.columns), *(d.alias(c) for c, d in defaults.items() if c not in rows.columns))


def verbs_of(annotations: Column) -> Column:
    """HTTP verbs that a list of annotation names stands for."""
    return F.array_compact(F.transform(annotations, http_verb))

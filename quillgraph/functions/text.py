"""Column functions on names, paths and texts. All stay inside code generation; none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes that name a role of a class rather than the thing (fixed values).
ROLE_SUFFIXES = ("Controller", "Service", "Facade", "Impl", "Resource")
#: Spec scalar -> storage type (fixed values); anything else is varchar(255).
STORAGE_TYPES = {"UUID": "uuid", "LocalDate": "date", "Instant": "timestamp", "int": "integer", "long": "bigint", "double": "double precision", "BigDecimal": "numeric", "boolean": "boolean"}


def blank(c: Column) -> Column:
    """Null, empty or white space only (Unicode)."""
    return ~F.coalesce(c.rlike(r"\S"), F.lit(False))


def first_non_blank(*columns: Column) -> Column:
    return F.coalesce(*(F.when(~blank(c), c) for c in columns))


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix:part:part; a null part is empty, so the separators stay."""
    return F.concat_ws(":", F.lit(prefix), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def edge_id(kind: Column | str, source: Column, target: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat_ws(":", F.lit("edge"), kind, F.coalesce(source, F.lit("")), F.coalesce(target, F.lit("")))


def method_id(type_id: Column, name: Column, erased: Column) -> Column:
    """Type#method(arg,arg)"""
    return F.concat(type_id, F.lit("#"), name, F.lit("("), F.array_join(erased, ","), F.lit(")"))


def field_id(type_id: Column, name: Column) -> Column:
    return F.concat(type_id, F.lit("#"), name)


def endpoint_id(method: Column, verb: Column, path: Column) -> Column:
    return F.concat_ws("::", method, verb, path)


def canonical_json(**fields: Column) -> Column:
    """JSON with sorted keys and without nulls."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "true"})


def hashed_id(kind: Column | str, name: Column, scope: Column, body: Column) -> Column:
    """sha256(kind|name|scope|sha256(canonical JSON))"""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.sha2(F.concat_ws("|", kind, name, scope, F.sha2(body, 256)), 256)


def canonical_token(c: Column) -> Column:
    """Camel humps, underscores and hyphens part words; lower case, joined by `_`. Null: empty."""
    spaced = F.regexp_replace(F.coalesce(c, F.lit("")), "([a-z0-9])([A-Z])", "$1 $2")
    return F.regexp_replace(F.lower(F.trim(F.translate(spaced, "_-", "  "))), r"\s+", "_")


def path_segment(c: Column) -> Column:
    return F.translate(canonical_token(c), "_", "-")


def strip_suffixes(c: Column, suffixes: tuple[str, ...] = ROLE_SUFFIXES) -> Column:
    """Strip role suffixes as long as there are any, never down to nothing."""
    return F.regexp_replace(c, f"^(.+?)({'|'.join(suffixes)})+$", "$1")


def normalize_path(c: Column) -> Column:
    """Blank: `/`; one slash in front; runs of slashes are one."""
    return F.when(blank(c), F.lit("/")).otherwise(F.regexp_replace(F.concat(F.lit("/"), F.trim(c)), "/+", "/"))


def simple_name(c: Column) -> Column:
    return F.substring_index(c, ".", -1)


def package_name(c: Column) -> Column:
    return F.regexp_extract(c, r"^(.*)\.[^.]*$", 1)


def owner_of(c: Column) -> Column:
    """What stands before `#`."""
    return F.substring_index(c, "#", 1)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./\\]+)$", 1)


def command_name(path: Column) -> Column:
    """The last segment of a URL path that is no {placeholder}."""
    return F.try_element_at(F.filter(F.split(path, "/"), lambda s: (s != "") & ~s.startswith("{")), F.lit(-1))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def relationship_name(c: Column) -> Column:
    """What is outside A-Z, 0-9 and `_` becomes `_` before the rest is upper-cased, so lower-case letters do too."""
    return F.upper(F.regexp_replace(c, "[^A-Z0-9_]", "_"))


def clean_line(c: Column) -> Column:
    """Without terminal escapes and control characters, white space folded."""
    bare = F.regexp_replace(c, "\x1b\\[[0-9;?]*[ -/]*[@-~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[\x00-\x08\x0b-\x1f\x7f]", " "), r"\s+", " "))


def elapsed(start: Column, end: Column) -> Column:
    """`2h 5m`, `5m 9s`, `9s`: the two largest units, without those that are zero; empty when it can't be told."""
    s = F.unix_timestamp(end) - F.unix_timestamp(start)
    unit = lambda n, name, always=False: F.when(F.lit(always) | (n > 0), F.concat(n.cast("string"), F.lit(name)))
    hours, minutes, seconds = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    text = F.when(s < 60, unit(s, "s", True)).when(hours > 0, F.concat_ws(" ", unit(hours, "h"), unit(minutes, "m"))).otherwise(F.concat_ws(" ", unit(minutes, "m"), unit(seconds, "s")))
    return F.when(s.isNull() | (s < 0), F.lit("")).otherwise(text)


def storage_type(spec: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in STORAGE_TYPES.items() for x in kv))[spec], F.lit("varchar(255)"))


def http_verb(annotation: Column, method: Column | None = None) -> Column:
    """GetMapping -> GET; a plain request mapping names its verb in its `method`, what follows the last dot there; other annotations have none."""
    verb = F.upper(F.regexp_extract(annotation, "^(Get|Post|Put|Delete|Patch)Mapping$", 1))
    named = F.lit(None).cast("string") if method is None else F.regexp_replace(method, r"^.*\.([A-Z]+).*$", "$1")
    return F.when(verb != "", verb).when(annotation == "RequestMapping", named)


def coerced_literal(c: Column) -> Column:
    """The kind of a literal text: boolean, number, duration or string; null for a duration that can't be."""
    whole = c.rlike(r"^P(?=[0-9T])(\d+D)?(T(?=[0-9])(\d+H)?(\d+M)?(\d+S)?)?$")
    return F.when(c.rlike("^(true|false)$"), "boolean").when(c.rlike(r"^-?\d+(\.\d+)?$"), "number").when(c.rlike("^P[T0-9HMSD]+$"), F.when(whole, "duration")).otherwise("string")


def terms(c: Column, longer_than: int, distinct: bool) -> Column:
    """Lower-cased runs of a-z and 0-9 longer than a bound."""
    found = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda t: F.length(t) > longer_than)
    return F.array_distinct(found) if distinct else found


def scenario_owner(c: Column) -> Column:
    """What a scenario's subject belongs to: without prefixes, before `#`; of a dotted name the last part without a trailing Impl; `Derived semantic scenarios` where nothing is left."""
    bare = c
    for prefix in ("scenario:", "operation:", "job:"):
        bare = F.regexp_replace(bare, f"^{prefix}", "")
    owner = F.substring_index(F.coalesce(bare, F.lit("")), "#", 1)
    return F.when(F.contains(owner, F.lit(".")), F.regexp_replace(F.substring_index(owner, ".", -1), "Impl$", "")).when(owner != "", owner).otherwise("Derived semantic scenarios")


def scenario_class(c: Column) -> Column:
    """The simple class name before the `#` of a scenario id; null without one."""
    bare = F.replace(F.replace(c, F.lit("scenario:operation:"), F.lit("")), F.lit("job:"), F.lit(""))
    return F.when(F.instr(bare, "#") > 1, F.substring_index(F.substring_index(bare, "#", 1), ".", -1))


def contains_any(c: Column, keywords: list[str]) -> Column:
    """Whether the case-folded text holds a keyword; keywords are lower-case already; null texts hold none."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(low, k)) if keywords else F.lit(False)


#: What a method body is searched for (fixed values).
BODY_PATTERNS = {
    "null_checks": r"if\s*\(([\w.]+)\s*==\s*null",
    "required": r"requireNonNull\(([\w.]+)",
    "thrown": r"throw\s+new\s+(\w+Exception)\s*\(",
    "saves": r"\.(save|persist|saveAndFlush|saveAll)\s*\(",
    "finds": r"\.(findById|findBy|findAll|getById|getReferenceById)\s*\(",
    "deletes": r"\.(delete|remove|deleteById|deleteAll)\s*\(",
}


def body_features(c: Column) -> dict[str, Column]:
    """What a method body shows, each once in order of appearance: compared with null in an `if`, required non-null, thrown exceptions, calls that store, read or delete."""
    return {name: F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), 1)) for name, pattern in BODY_PATTERNS.items()}


def body_scenario(command: Column, body: Column) -> Column:
    """struct<given, when, then> of a command's method body; null where the body is missing, or shows neither conditions nor outcomes.

    What is compared with null and also required counts once, as compared. The body, and each pattern in it, is sought once: what is used
    again is bound as the one item of an array.
    """
    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    return bound(body, lambda b: bound(F.struct(*(v.alias(k) for k, v in body_features(b).items())), lambda found: _scenario(command, b, found)))


def _scenario(command: Column, body: Column, found: Column) -> Column:
    texts = lambda words, before, after: F.transform(words, lambda w: F.concat(F.lit(before), w, F.lit(after)))
    one = lambda words, text: F.when(F.size(words) > 0, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    provided = texts(found["null_checks"], "Given ", " is provided")
    required = texts(F.array_except(found["required"], found["null_checks"]), "Given ", " is not null")
    given = F.concat(provided, required, one(found["finds"], "Given the record exists in the repository"))
    then = F.concat(texts(found["thrown"], "Then throws ", ""), one(found["saves"], "Then the record is persisted"), one(found["deletes"], "Then the record is removed"))
    done = F.when(F.size(then) > 0, then).otherwise(F.array(F.lit("Then the operation completes successfully")))
    when = F.array(F.concat(F.lit("When "), command, F.lit(" is invoked")))
    some = ~blank(body) & (body != "null") & ((F.size(given) > 0) | (F.size(then) > 0))
    return F.when(some, F.struct(given.alias("given"), when.alias("when"), done.alias("then")))


_CHUNK = 256


def carried(marks: Column, kind: str = "string") -> Column:
    """For each place of an array the last non-null mark on an earlier place.

    A fold inside the row. It goes in chunks: the last mark of each chunk is carried to the next, and each chunk is folded
    by itself, so the copies that appending makes stay short whatever the length.
    """
    size = F.greatest(F.ceil(F.size(marks) / _CHUNK).cast("int"), F.lit(1))
    chunks = F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.slice(marks, k * _CHUNK + 1, F.lit(_CHUNK)))
    state = lambda at: F.struct(at.cast(kind).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    step = lambda acc, m: F.struct(F.coalesce(m, acc.at).alias("at"), F.array_append(acc.out, acc.at).alias("out"))
    lasts = F.transform(chunks, lambda ch: F.try_element_at(F.filter(ch, lambda m: m.isNotNull()), F.lit(-1)))
    before = F.aggregate(lasts, state(F.lit(None)), step, lambda acc: acc.out)
    return F.flatten(F.transform(F.arrays_zip(chunks.alias("marks"), before.alias("before")), lambda x: F.aggregate(x["marks"], state(x["before"]), step, lambda acc: acc.out)))


def annotation_values(annotations: Column, name: str, attribute: str) -> Column:
    """Comma-separated values of an attribute of the annotations of a name, without quotes and blanks."""
    raw = F.transform(F.filter(annotations, lambda a: a["name"] == name), lambda a: F.coalesce(a["values"][attribute], F.lit("")))
    parts = F.flatten(F.transform(raw, lambda v: F.transform(F.split(v, ","), lambda p: F.replace(F.trim(p), F.lit('"'), F.lit("")))))
    return F.filter(parts, lambda p: p.rlike(r"\S"))


def _first_annotation(annotations: Column, names: tuple[str, ...]) -> Column:
    return F.get(F.filter(annotations, lambda a: a["name"].isin(*names)), F.lit(0))


def annotation_attribute(annotations: Column, names: tuple[str, ...], attributes: tuple[str, ...], default: Column) -> Column:
    """Of the first annotation that has one of some names the first value that is one of some attributes; quotes dropped. The default where there is none."""
    values = F.filter(F.map_entries(_first_annotation(annotations, names)["values"]), lambda e: e["key"].isin(*attributes) & e["value"].isNotNull())
    return F.coalesce(F.replace(F.get(values, F.lit(0))["value"], F.lit('"'), F.lit("")), default)


def annotation_boolean(annotations: Column, names: tuple[str, ...], attribute: str) -> Column:
    """A flag of the first annotation that has one of some names: whether it says true; null if it says nothing."""
    return F.lower(_first_annotation(annotations, names)["values"][attribute]) == "true"


#: Annotation names that decide (fixed values).
NOT_NULL = ("NotNull", "NotBlank", "NotEmpty")
RELATIONS = ("OneToMany", "ManyToOne", "ManyToMany", "OneToOne")
VALIDATIONS = ("Valid", "NotNull", "NotBlank", "NotEmpty", "Positive", "PositiveOrZero", "Min", "Max", "Size", "Pattern", "Email", "Past", "Future")
STEREOTYPES = ("Component", "Service", "Controller", "RestController", "Repository", "Configuration")
#: What on a class path tells the database's dialect, first match (fixed values).
DIALECTS = (("postgresql", "PostgreSQL"), ("mariadb", "MariaDB"), ("mysql", "MySQL"), ("sqlserver", "SQLServer"), ("mssql", "SQLServer"), ("oracle", "Oracle"), ("/h2", "H2"), (" h2-", "H2"), ("h2database", "H2"))


def explicit_nullable(annotations: Column) -> Column:
    """What a column mapping says, else false where a constraint forbids null, else null."""
    forbidden = F.exists(annotations, lambda a: a["name"].isin(*NOT_NULL))
    return F.coalesce(annotation_boolean(annotations, ("Column", "JoinColumn"), "nullable"), F.when(forbidden, F.lit(False)))


def explicit_key(annotations: Column) -> Column:
    """True for identities, else null."""
    return F.when(F.exists(annotations, lambda a: a["name"].isin("Id", "EmbeddedId")), F.lit(True))


def relation_type(annotations: Column) -> Column:
    """The name of the first annotation that makes a relation."""
    return _first_annotation(annotations, RELATIONS)["name"]


def is_validation(annotation: Column) -> Column:
    return annotation["name"].isin(*VALIDATIONS) | F.coalesce(annotation["qualified_name"].startswith("jakarta.validation"), F.lit(False))


def bean_name(simple: Column, annotations: Column) -> Column:
    """The first non-blank name that a stereotype gives, else the class name with a small first letter."""
    named = F.transform(F.filter(annotations, lambda a: a["name"].isin(*STEREOTYPES)), lambda a: annotation_attribute(F.array(a), STEREOTYPES, ("value", "name"), F.lit("")))
    return F.coalesce(F.get(F.filter(named, lambda n: n.rlike(r"\S")), F.lit(0)), F.concat(F.lower(F.left(simple, F.lit(1))), F.substr(simple, F.lit(2))))


def visibility(modifiers: Column) -> Column:
    """Of an array of modifiers: public, protected, private, or package."""
    has = lambda m: F.array_contains(modifiers, m)
    return F.when(has("public"), "public").when(has("protected"), "protected").when(has("private"), "private").otherwise("package")


def database_dialect(classpath: Column) -> Column:
    """The dialect that a class path (an array of entries) asks for; null if none is known."""
    joined, out = F.lower(F.array_join(classpath, " ")), F
    for sign, name in DIALECTS:
        out = out.when(F.contains(joined, F.lit(sign)), f"org.hibernate.dialect.{name}Dialect")
    return out


def null_checks(predicates: Column) -> Column:
    """What branch conditions compare with null, in order: structs of text and whether equality is asked."""
    of = lambda p, sign, equal: F.when(F.contains(p, F.lit(sign)), F.struct(F.trim(F.replace(p, F.lit(sign), F.lit(""))).alias("text"), F.lit(equal).alias("is_null")))
    return F.flatten(F.transform(predicates, lambda p: F.array_compact(F.array(of(p, "== null", True), of(p, "!= null", False)))))


def unfenced(c: Column) -> Column:
    """The inside of a fenced block, or the text itself; trimmed."""
    text = F.trim(F.coalesce(c, F.lit("")))
    inside = F.regexp_extract(text, r"(?s)^```[^\n]*\n(.*?)(?:\n?```.*)?$", 1)
    return F.when(text.startswith("```"), F.trim(inside)).otherwise(text)


def tolerant_json(c: Column, schema: str) -> Column:
    """JSON with a fixed schema; null, blank or unreadable texts are null."""
    return F.when(~blank(c) & F.try_parse_json(c).isNotNull(), F.from_json(c, schema))


def fatal(c: Column) -> Column:
    return F.coalesce(F.lower(c).isin("fatal", "error", "blocking"), F.lit(False))


def camel_case(c: Column) -> Column:
    """Hyphens and underscores go, and what follows them has a capital; all else stays."""
    parts = F.split(c, "[-_]+")
    return F.array_join(F.transform(parts, lambda w, i: F.when(i == 0, w).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2))))), "")


def folder_package(c: Column) -> Column:
    """A folder's name as a package: lower case, dots for hyphens and underscores."""
    return F.translate(F.lower(c), "-_", "..")


def endpoint_command(path: Column, verb: Column) -> Column:
    """The last segment of a URL path that is no {placeholder}; `Command` where there is none, behind the verb in lower case where there is no path."""
    named = F.try_element_at(F.filter(F.split(path, "/"), lambda s: s.rlike(r"\S") & ~s.startswith("{")), F.lit(-1))
    return F.when(blank(path), F.concat(F.coalesce(F.lower(verb), F.lit("")), F.lit("Command"))).otherwise(F.coalesce(named, F.lit("Command")))


def under_path(candidate: Column, path: Column) -> Column:
    """Whether a path is another one, or goes on from it after `/`, `:` or `#`."""
    return candidate.startswith(path) & ((candidate == path) | F.substr(candidate, F.length(path) + 1, F.lit(1)).isin("/", ":", "#"))


def percent(c: Column) -> Column:
    return F.concat(F.round(c * 100).cast("int").cast("string"), F.lit("%"))


def kept_metadata(c: Column) -> Column:
    """A map without null and empty values."""
    return F.map_filter(c, lambda k, v: v.isNotNull() & (v != ""))

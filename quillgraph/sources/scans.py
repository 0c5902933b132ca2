"""Line scans of documents and contracts. State that runs along a file is a fold over its lines, inside the file's row: no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import carried
from .files import line_array

#: Parts of paths that mark migration files, and words that mark integrations (fixed values).
MIGRATION_SEGMENTS = ("/db/changelog/", "\\db\\changelog\\", "/db/migration/", "\\db\\migration\\", "liquibase", "flyway")
INTEGRATION_KEYWORDS = ("oauth2", "sftp", "outbox", "inbox", "debezium", "kafka", "webclient", "restclient", "cxf")
HTTP_VERBS = "get|post|put|patch|delete|options|head"


def headings(lines: DataFrame, pattern: str = r"^(#{1,6})\s+(.+)$") -> DataFrame:
    """Lines that are headings: adds level and title."""
    found = lines.filter(F.col("value").rlike(pattern))
    return found.withColumn("level", F.length(F.regexp_extract("value", pattern, 1))).withColumn("title", F.trim(F.regexp_extract("value", pattern, 2)))


def import_statements(lines: DataFrame) -> DataFrame:
    """Trimmed lines that start with `import `, without the semicolon: adds statement."""
    bare = F.trim("value")
    return lines.filter(bare.startswith("import ")).withColumn("statement", F.trim(F.regexp_replace(F.regexp_replace(bare, "^import ", ""), ";", "")))


def carried_forward(files: DataFrame, mark: Callable[[Column], Column], name: str, text: str = "text") -> DataFrame:
    """A row per line of each file, as files.lines(): the file's other columns, line (from 1), value, and as `name` the mark of the last earlier line that has one.

    mark: line -> its mark, a string, or null.
    """
    rest = [c for c in files.columns if c != text]
    held = files.select(*rest, line_array(F.col(text)).alias("_lines"))
    held = held.withColumn("_carried", carried(F.transform("_lines", mark)))
    rows = held.select(*rest, F.posexplode(F.arrays_zip(F.col("_lines"), F.col("_carried"))).alias("_at", "_l"))
    return rows.select(*rest, (F.col("_at") + 1).alias("line"), F.col("_l._lines").alias("value"), F.col("_l._carried").alias(name))


def section_flag(files: DataFrame, opens: Callable[[Column], Column], closes: Callable[[Column], Column], name: str, text: str = "text") -> DataFrame:
    """carried_forward() of whether the nearest earlier line that opens or closes a section opened it."""
    mark = lambda line: F.when(opens(line), F.lit("open")).when(closes(line), F.lit("closed"))
    return carried_forward(files, mark, name, text).withColumn(name, F.coalesce(F.col(name) == "open", F.lit(False)))


def openapi_operations(files: DataFrame) -> DataFrame:
    """(path, line, method, url) of files (path, text): verbs at four spaces under the nearest path at two. No YAML is parsed."""
    item, verb = r"^\s{2}(/[^:]+):\s*$", rf"(?i)^\s{{4}}({HTTP_VERBS}):\s*$"
    found = carried_forward(files.select("path", "text"), lambda line: F.when(line.rlike(item), F.trim(F.regexp_extract(line, item, 1))), "url")
    return found.filter(F.col("value").rlike(verb) & F.col("url").isNotNull() & ~F.col("value").rlike(item)).select("path", "line", F.upper(F.regexp_extract("value", verb, 1)).alias("method"), "url")


def asyncapi_channels(files: DataFrame) -> DataFrame:
    """(path, line, channel) of files (path, text): keys at two spaces after a line `channels:`, until a line that isn't indented.

    A blank line ends the section too; lines that look like a channel never do.
    """
    item = r"^\s{2}([^\s:#][^:]*):\s*$"
    opens = lambda line: F.trim(line) == "channels:"
    closes = lambda line: ~opens(line) & ~line.rlike(item) & ~line.startswith(" ")
    found = section_flag(files.select("path", "text"), opens, closes, "inside")
    return found.filter(F.col("inside") & F.col("value").rlike(item) & ~opens(F.col("value"))).select("path", "line", F.trim(F.regexp_extract("value", item, 1)).alias("channel"))


def migration_files(files: DataFrame) -> DataFrame:
    """(path, tool, collection): files on migration paths; collection is the folder of changelogs and masters."""
    low = F.lower("path")
    on_path = F.exists(F.array(*map(F.lit, MIGRATION_SEGMENTS)), lambda s: F.contains(low, s))
    tool = F.when(F.contains(low, F.lit("changelog")) | F.contains(low, F.lit("liquibase")), "liquibase").otherwise("flyway")
    folder = F.regexp_extract("path", r"^(.*)[/\\][^/\\]*$", 1)
    return files.filter(on_path).select("path", tool.alias("tool"), F.when(F.contains(low, F.lit("master.")) | F.contains(low, F.lit("changelog")), folder).alias("collection"))


def jobs(types: DataFrame, methods: DataFrame) -> DataFrame:
    """(method_id, type_id, kind, label): methods with a scheduling annotation; recurring wins."""
    has = lambda word: F.exists(F.coalesce("annotations", F.array()), lambda a: F.contains(F.lower(a.qualified_name), F.lit(word)))
    found = methods.withColumn("_recurring", has("recurring")).filter(has("scheduled") | F.col("_recurring"))
    named = found.select(F.col("id").alias("method_id"), "type_id", "name", "_recurring").join(types.select(F.col("id").alias("type_id"), "simple_name", "qualified_name"), "type_id")
    return named.select("method_id", "type_id", F.when(F.col("_recurring"), "recurring-job").otherwise("scheduled-job").alias("kind"), F.concat_ws(".", "simple_name", "name").alias("label"), "qualified_name", "name")

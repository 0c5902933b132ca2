"""Files as tables: code, resources, lines, JSON artifacts, YAML documents, run stores."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Folders that hold resources (fixed values).
RESOURCE_FOLDERS = ("src/main/resources", "src/test/resources", "api", "docs", "doc")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local master may go without it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "/tmp/checkpoints"


def temporary(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; what is written there is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back; the table is deleted when the driver ends."""
    path = temporary(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete tables that written() made, once nothing lazy reads them any more."""
    for table in tables:
        if table is not None and (spark := _written.pop(table.written_path, None)):
            _delete(spark, table.written_path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def written_counted(df: DataFrame, tag: str, *counts: Column) -> tuple[DataFrame, list[int]]:
    """written(), and aggregates over its rows (by default their number), observed while they are written: no job of their own."""
    seen = Observation()
    named = [c.alias(f"n{k}") for k, c in enumerate(counts or (F.count(F.lit(1)),))]
    out = written(df.observe(seen, *named), tag)
    return out, [seen.get[f"n{k}"] for k in range(len(named))]


_written: dict[str, SparkSession] = {}


@atexit.register
def _forget() -> None:
    with contextlib.suppress(Exception):  # a session that has ended can't delete any more
        for path, spark in _written.items():
            _delete(spark, path)


def text_files(spark: SparkSession, roots: Sequence[str], pattern: str = "*") -> DataFrame:
    """(path, text) of all files below the roots whose name fits; each path once; roots that don't exist are skipped."""
    jvm, conf = spark.sparkContext._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    there = [r for r in dict.fromkeys(roots) if (p := jvm.org.apache.hadoop.fs.Path(r)).getFileSystem(conf).exists(p)]
    if not there:
        return spark.createDataFrame([], "path string, text string")
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return read.text(there, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).dropDuplicates(["path"])


def code_files(spark: SparkSession, roots: Sequence[str], pattern: str = "*.java") -> DataFrame:
    return text_files(spark, roots, pattern)


def resource_files(spark: SparkSession, root: str) -> DataFrame:
    return text_files(spark, [f"{root}/{f}" for f in RESOURCE_FOLDERS]).unionByName(text_files(spark, [f"{root}/README.md"])).dropDuplicates(["path"])


def line_array(text: Column) -> Column:
    """The lines of a text. A final line end makes no line."""
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r?\n\z", ""), r"\r?\n")


def lines(files: DataFrame, text: str = "text") -> DataFrame:
    """A row per line of each file: the file's other columns, line (from 1), value."""
    rest = [c for c in files.columns if c != text]
    return files.select(*rest, F.posexplode(line_array(F.col(text))).alias("_at", "value")).select(*rest, (F.col("_at") + 1).alias("line"), "value")


def excerpt(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end, clamped to the text, joined and trimmed; a start below 1 is 1, an end before the start is the start."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\r?\n")
    first = F.greatest(F.coalesce(start, F.lit(1)), F.lit(1))
    last = F.least(F.greatest(F.coalesce(end, first), first), F.size(parts))
    return F.when(first > F.size(parts), F.lit("")).otherwise(F.trim(F.array_join(F.slice(parts, first, F.greatest(last - first + 1, F.lit(0))), "\n")))


def json_artifact(spark: SparkSession, path: str | None, schema: str) -> DataFrame:
    """A JSON artifact with a fixed schema; no path means an empty table. Properties that aren't in the schema are ignored."""
    return spark.createDataFrame([], schema) if path is None else spark.read.schema(schema).option("multiLine", True).json(path)


def yaml_rows(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """Rows of a YAML document (a list, or the list below `key`). The document is one small file, read on the driver through Spark."""
    import yaml

    text = spark.read.text(path, wholetext=True).filter(F.length("value") > 0).first()[0]
    found = yaml.safe_load(text) or []
    rows = (found.get(key) or []) if key else found
    names = spark.createDataFrame([], schema).columns
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def write_yaml(document: DataFrame, path: str, limit: int = 10_000) -> None:
    """Write a size-bounded document as one YAML file through Spark; more rows than the bound are an error, never a cut."""
    import yaml

    rows = document.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("a YAML document is bounded; write tables as Parquet")
    text = yaml.safe_dump([r.asDict(recursive=True) for r in rows], sort_keys=False, allow_unicode=True)
    document.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_artifacts(tables: dict[str, DataFrame], folder: str, run_id: str) -> DataFrame:
    """Write tables as Parquet, partitioned by run, and return the manifest (run_id, name, path)."""
    spark = next(iter(tables.values())).sparkSession
    for name, table in tables.items():
        table.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(f"{folder}/{name}")
    manifest = spark.createDataFrame([(run_id, n, f"{folder}/{n}/run_id={run_id}") for n in tables], "run_id string, name string, path string")
    manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest/{run_id}")
    return manifest


def stored(tables: dict[str, DataFrame], folder: str, run_id: str) -> dict[str, DataFrame]:
    """Write tables of a run and read them back: what follows plans on files instead of computing them again for every use."""
    schemas = {name: table.schema for name, table in tables.items()}
    paths = {r["name"]: r["path"] for r in write_artifacts(tables, folder, run_id).collect()}
    spark = next(iter(tables.values())).sparkSession
    return {name: spark.read.schema(schema).parquet(paths[name]) for name, schema in schemas.items()}


def upsert(stored: DataFrame, fresh: DataFrame, key: Sequence[str]) -> DataFrame:
    """Stored rows with those of equal key replaced: idempotent, the fresh row wins. The caller overwrites the version's partition."""
    return stored.join(fresh.select(*key), list(key), "left_anti").unionByName(fresh)


def contract_operations(contract: DataFrame) -> DataFrame:
    """`METHOD path` of a contract's operations array<struct<method, path>>."""
    return contract.select(F.explode("operations").alias("o")).select(F.concat_ws(" ", "o.method", "o.path").alias("name")).distinct()


def boot_class(files: DataFrame, annotation: str = "@SpringBootApplication") -> DataFrame:
    """(name): package and class of the first file that holds the annotation; one row at most."""
    hit = files.filter(F.contains("text", F.lit(annotation))).orderBy("path").limit(1)
    package, name = F.regexp_extract("text", r"(?m)^\s*package\s+([\w.]+)", 1), F.regexp_extract("text", r"\bclass\s+(\w+)", 1)
    return hit.select(F.when(package == "", name).otherwise(F.concat_ws(".", package, name)).alias("name"))

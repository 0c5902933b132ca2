"""A draft specification from a code model: aggregates with their identity, entities, commands, rules and scenarios."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.resource import ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.text import blank, body_scenario, endpoint_command, owner_of, simple_name, strip_suffixes
from ..operators.numbering import running
from ..sources.files import drop, written, written_counted

_FIELD = "struct<name:string, type:string, pk:boolean, nullable:boolean>"
_RULE = "struct<id:string, type:string, ensure:string>"
#: Bytes of items whose texts are joined at once, before the texts of an aggregate meet.
PIECE = 1 << 14
#: Bytes of an aggregate's texts beyond which few of them are made at the same time.
LONG = 1 << 23
#: Bytes of long texts in a task where it takes several: a Parquet page of few rows holds them all, and less than 2 GB.
HELD = 1 << 29


def capitalized(c: Column) -> Column:
    """With a capital first letter; `Command` for blank texts."""
    return F.when(blank(c), "Command").otherwise(F.concat(F.upper(F.left(c, F.lit(1))), F.substr(c, F.lit(2))))


def _in_order(rows: DataFrame, key: str, name: str, item: Column, *order: str) -> DataFrame:
    """(key, name): the items of each key as one array."""
    listed = F.array_sort(F.collect_list(F.struct(*(F.col(o).alias(f"o{k}") for k, o in enumerate(order)), item.alias("item"))))
    return rows.groupBy(key).agg(F.transform(listed, lambda x: x["item"]).alias(name))


def constraint_rules(methods: DataFrame, params: DataFrame, validations: DataFrame, securities: DataFrame) -> DataFrame:
    """(method_id, number, kind, type, ensure): validations of a method or one of its parameters, then its security constraints, numbered from 1 per method."""
    targets = methods.select(F.col("id").alias("target_id"), F.col("id").alias("method_id"), F.col("name").alias("target"), F.lit(1).alias("rank"))
    targets = targets.unionByName(params.select(F.col("id").alias("target_id"), "method_id", F.col("name").alias("target"), F.lit(0).alias("rank")))
    targets = targets.join(validations.select("target_id"), "target_id", "left_semi").groupBy("target_id", "method_id").agg(F.min_by("target", "rank").alias("target"))
    checked = validations.join(targets, "target_id").select("method_id", F.lit(0).alias("part"), "ordinal", "id", F.lit("validation").alias("kind"), F.lit("VALIDATION").alias("type"), F.concat("target", F.lit(" must satisfy @"), "annotation").alias("ensure"))
    guarded = securities.join(methods.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    guarded = guarded.select(F.col("target_id").alias("method_id"), F.lit(1).alias("part"), "ordinal", "id", F.lit("security").alias("kind"), F.lit("GUARD").alias("type"), F.concat_ws(" ", F.col("kind"), F.col("expression")).alias("ensure"))
    found = written(checked.unionByName(guarded), "constraints")  # dealing to ranges reads its rows twice
    numbered = running(found, ["method_id"], ["part", "ordinal", "id"], "number")
    drop(found)
    return numbered.select("method_id", (F.col("number") + 1).alias("number"), "kind", "type", "ensure")


def draft_commands(methods: DataFrame, params: DataFrame, endpoints: DataFrame, validations: DataFrame, securities: DataFrame) -> DataFrame:
    """(aggregate, ordinal, name, method, path, input, rules, scenario): a row per endpoint.

    A command is named by its method, or where that is unknown by its path; its aggregate by its method's class without
    role suffixes, or again by the path. Inputs are the method's parameters in order.
    """
    c = F.col
    inputs = _in_order(params, "method_id", "input", F.struct(c("name"), c("type"), F.lit(False).alias("pk"), c("nullable")), "ordinal", "id")
    rules = constraint_rules(methods, params, validations, securities)
    named = methods.select(c("id").alias("method_id"), c("name").alias("method_name"), c("body")["normalized_source"].alias("source"))
    rules = rules.join(named.select("method_id", "method_name"), "method_id")
    rule_id = F.concat(F.lower(capitalized(c("method_name"))), F.lit("-"), c("kind"), F.lit("-v"), c("number").cast("string"))
    rules = _in_order(rules, "method_id", "rules", F.struct(rule_id.alias("id"), c("type"), c("ensure")), "number")
    found = endpoints.select("method_id", "http_method", "full_path", "ordinal").join(named.withColumn("known", F.lit(True)), "method_id", "left").join(inputs, "method_id", "left").join(rules, "method_id", "left")
    by_path = capitalized(endpoint_command(c("full_path"), c("http_method")))
    name = F.when(c("known"), capitalized(c("method_name"))).otherwise(by_path)
    aggregate = F.when(c("known"), strip_suffixes(simple_name(owner_of(c("method_id"))))).otherwise(by_path)
    scenario = F.when(c("known"), body_scenario(name, c("source")))
    return found.select(
        aggregate.alias("aggregate"), "ordinal", name.alias("name"), c("http_method").alias("method"), c("full_path").alias("path"), F.coalesce("input", F.array().cast(f"array<{_FIELD}>")).alias("input"),
        F.coalesce("rules", F.array().cast(f"array<{_RULE}>")).alias("rules"), scenario.alias("scenario"),
    )


def draft_entities(types: DataFrame, entities: DataFrame) -> DataFrame:
    """(aggregate, ordinal, id_fields, name, table, fields): persistent classes (type_id, table_name, id_fields, attributes, ordinal), named after their class, `Entity` behind it; fields by name."""
    c = F.col
    found = entities.join(types.select(c("id").alias("type_id"), "simple_name"), "type_id", "left")
    plain = F.coalesce("simple_name", simple_name(c("type_id")))
    name = F.when(plain.endswith("Entity"), plain).otherwise(F.concat(plain, F.lit("Entity")))
    fields = F.transform(F.array_sort(F.transform("attributes", lambda a, i: F.struct(a["field_name"].alias("name"), i.alias("at"), a.alias("a")))), lambda x: F.struct(x["name"].alias("name"), x["a"]["type"].alias("type"), x["a"]["pk"].alias("pk"), x["a"]["nullable"].alias("nullable")))
    return found.select(strip_suffixes(simple_name(c("type_id"))).alias("aggregate"), "ordinal", "id_fields", name.alias("name"), c("table_name").alias("table"), fields.alias("fields"))


def _pieces(rows: DataFrame, part: int, between: str, *order: str) -> DataFrame:
    """(aggregate, alone, part, piece, text, first, size): each aggregate's items as texts of about PIECE bytes, the first value that there is in each, and its bytes.

    Items get their place by ranges. `alone` is the part where the aggregate is null: such entities and commands don't meet.
    """
    c = F.col
    size = F.coalesce(F.octet_length("item"), F.lit(0)).cast("long") + 1  # more than 0, so places differ
    placed = running(rows.select("aggregate", *order, "item", "first", size.alias("bytes")), ["aggregate"], order, "at", c("bytes"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "item"))), lambda x: x["item"]), between)
    found = placed.groupBy("aggregate", F.floor(c("at") / PIECE).alias("piece")).agg(F.when(F.count("item") > 0, text).alias("text"), _known("at").alias("first"), F.sum("bytes").alias("size"))
    return found.select("aggregate", F.when(c("aggregate").isNull(), part).alias("alone"), F.lit(part).alias("part"), "piece", "text", "first", "size")


def _known(by: str) -> Column:
    """The first value that there is."""
    return F.min_by("first", F.when(F.col("first").isNotNull(), F.col(by)))


def _typed(rows: DataFrame, e: DataFrame) -> DataFrame:
    """Rows with `type`: that of their aggregate's entities' first field that is called `field`, else String."""
    c = F.col
    fields = e.select(c("aggregate").alias("_a"), "ordinal", "name", F.posexplode("fields").alias("at", "f"))
    kinds = fields.groupBy("_a", c("f.name").alias("_field")).agg(F.min_by("f.type", F.struct("ordinal", "name", "at")).alias("_type"))
    found = rows.join(kinds, c("aggregate").eqNullSafe(c("_a")) & (c("field") == c("_field")), "left")
    return found.withColumn("type", F.coalesce("_type", F.lit("String"))).drop("_a", "_field", "_type")


def _few_at_once(spark: SparkSession) -> ResourceProfile | None:
    """Tasks that take half an executor's cores, so two run in it at once; None where that can't be had or the cores aren't known."""
    sc = spark.sparkContext
    if sc.master.startswith("local[") or sc.master == "local" or spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return None
    cores = sc.getConf().get("spark.executor.cores")
    if cores is None and sc.getConf().get("spark.default.parallelism") is None:
        cores = sc.defaultParallelism // max(1, sc._jsc.sc().getExecutorMemoryStatus().size() - 1)  # all cores by executors; the driver is listed too
    half = int(cores or 0) // 2
    return ResourceProfileBuilder().require(TaskResourceRequests().cpus(half)).build if half > 1 else None


def _joined(rows: DataFrame, between: str, profile: ResourceProfile | None = None) -> DataFrame:
    """Partitions sorted by aggregate, each headed by its identity (part null) before its pieces -> (aggregate, field, type, entities, commands), one aggregate in memory."""
    between = between.encode()

    def strings(texts: list[bytearray | None]) -> pa.Array:
        ends = np.cumsum([0, *(len(t or b"") for t in texts)])
        if ends[-1] >= 1 << 31:
            raise ValueError(f"a text of {ends[-1]:,} bytes: a row holds less than 2 GB")
        data = texts[0] if len(texts) == 1 and texts[0] else b"".join(t or b"" for t in texts)  # a long text comes alone and isn't copied
        return pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))

    def made(found: list) -> pa.RecordBatch:
        *named, entities, commands = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in named), strings(entities), strings(commands)], ["aggregate", "field", "type", "entities", "commands"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            for aggregate, field, kind, part, text in zip(*(x.to_pylist() for x in batch.columns[:4]), batch.column(4).cast(pa.binary()).to_pylist(), strict=True):
                if part is None:
                    if held > PIECE:
                        yield made(found)
                        found, held = [], 0
                    found.append([aggregate, field, kind, None, None])
                elif text is not None:
                    own = found[-1]
                    if own[3 + part] is None:
                        own[3 + part] = bytearray(text)
                    else:
                        own[3 + part] += between
                        own[3 + part] += text
                    held += len(text)
        if found:
            yield made(found)

    ordered = rows.sortWithinPartitions("aggregate", "alone", "part", "piece").select("aggregate", "field", "type", "part", "text")
    return ordered.mapInArrow(join, "aggregate string, field string, type string, entities string, commands string", profile=profile)


def _as_texts(e: DataFrame, m: DataFrame, between: str) -> DataFrame:
    """(aggregate, field, type, entities, commands): each aggregate's items as one text a kind.

    No join or aggregation carries whole texts: identities come as rows beside the pieces, which are sorted and strung together. Behind that a
    text is still held some six times (row, file buffers), and a file's writer holds all texts of its task. So an aggregate beyond LONG bytes has
    a task of its own, of which two run in an executor at once. Where tasks can't ask for that, few tasks take the long ones one after the other.
    """
    c, key = F.col, ["aggregate", "alone"]
    pieces = written(_pieces(e, 0, between, "ordinal", "name").unionByName(_pieces(m, 1, between, "name", "ordinal", "path")), "pieces")
    drop(m)
    heads = pieces.groupBy(*key, "part").agg(_known("piece").alias("first"), F.sum("size").alias("size"))
    heads = _typed(heads.groupBy(*key).agg(_known("part").alias("field"), F.sum("size").alias("size")), e)
    long, of_long = c("size") > LONG, F.sum(F.when(c("size") > LONG, c("size")))
    heads, (n_long, held) = written_counted(heads, "heads", F.count(F.when(long, 1)), of_long)
    rows = pieces.select(*key, "part", "piece", "text").unionByName(heads.select(*key, "field", "type"), allowMissingColumns=True)
    if not n_long:
        return _joined(rows.repartition(*key), between)
    number = F.row_number().over(Window.orderBy(*key)) - 1
    numbered = F.broadcast(heads.filter(long).select(c("aggregate").alias("_a"), c("alone").alias("_alone"), number.alias("_number")))
    same = c("aggregate").eqNullSafe(c("_a")) & c("alone").eqNullSafe(c("_alone"))
    profile = _few_at_once(rows.sparkSession)
    alone = _joined(rows.join(numbered, same).repartitionById(n_long, c("_number")), between, profile)
    alone = alone if profile else alone.coalesce(-(-held // HELD))
    return alone.unionByName(_joined(rows.join(numbered, same, "left_anti").repartition(*key), between))


def _listed(rows: DataFrame, name: str, item: Column, first: Column, *order: str) -> DataFrame:
    """(aggregate, name, first): the same with the items themselves as an array."""
    found = rows.groupBy("aggregate").agg(F.min_by(first, F.when(first.isNotNull(), F.struct(*order))).alias(f"{name}_first"))
    return _in_order(rows, "aggregate", name, item, *order).join(found.withColumnRenamed("aggregate", "_a"), F.col("aggregate").eqNullSafe(F.col("_a"))).drop("_a")


def _items(
    types: DataFrame, methods: DataFrame, params: DataFrame, endpoints: DataFrame, entities: DataFrame, validations: DataFrame, securities: DataFrame, texts: tuple[Callable[[Column], Column], Callable[[Column], Column]] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Entities and commands as stored rows, each with its item (nested, or as text) and the first name that an identity may take."""
    e, m = draft_entities(types, entities), draft_commands(methods, params, endpoints, validations, securities)
    called = F.get(F.filter(F.transform("input", lambda f: f["name"]), lambda n: (F.lower(n) == "id") | n.endswith("Id")), F.lit(0))
    entity, command = F.struct("name", "table", "fields"), F.struct("name", "method", "path", "input", "rules", "scenario")
    if texts:
        entity, command = texts[0](entity), texts[1](command)
    own = F.substring_index(F.get("id_fields", F.lit(0)), "#", -1)
    e = written(e.select("aggregate", "ordinal", "name", "fields", own.alias("first"), entity.alias("item")), "entities")
    return e, written(m.select("aggregate", "name", "ordinal", "path", called.alias("first"), command.alias("item")), "commands")


def draft_texts(
    types: DataFrame, methods: DataFrame, params: DataFrame, endpoints: DataFrame, entities: DataFrame, validations: DataFrame, securities: DataFrame,
    texts: tuple[Callable[[Column], Column], Callable[[Column], Column]], between: str = ";",
) -> DataFrame:
    """(aggregate, field, type, entities, commands): the draft with each aggregate's entities and commands as one text each, written in their own rows by `texts`; nothing nested is gathered.

    A projection of the result holds each text once more; where texts are long, take the columns as they are.
    """
    return _as_texts(*_items(types, methods, params, endpoints, entities, validations, securities, texts), between)


def draft(
    types: DataFrame, methods: DataFrame, params: DataFrame, endpoints: DataFrame, entities: DataFrame, validations: DataFrame, securities: DataFrame,
    texts: tuple[Callable[[Column], Column], Callable[[Column], Column]] | None = None, between: str = ";",
) -> DataFrame:
    """(aggregate, identity struct<type, field>, entities, commands): a row per aggregate that entities or endpoints name.

    The identity is the first id field of the first entity that has one, else the first input called id or ending in Id; its type is that of the
    entities' field of this name, else String. Commands go by name. An aggregate's entities and commands meet in its row: as arrays, or, given
    `texts` (how an entity and a command are written), as one text each (see draft_texts).
    """
    c = F.col
    tables = (types, methods, params, endpoints, entities, validations, securities)
    if texts:
        both = draft_texts(*tables, texts, between)
    else:
        e, m = _items(*tables)
        both = _listed(e, "entities", c("item"), c("first"), "ordinal", "name").join(_listed(m, "commands", c("item"), c("first"), "name", "ordinal", "path"), "aggregate", "full_outer")
        for name, rows in {"entities": e, "commands": m}.items():
            both = both.withColumn(name, F.coalesce(name, F.array().cast(ArrayType(rows.schema["item"].dataType))))
        both = _typed(both.withColumn("field", F.coalesce("entities_first", "commands_first")), e)
    return both.select("aggregate", F.struct("type", "field").alias("identity"), "entities", "commands")

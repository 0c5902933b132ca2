"""What several observers report about types, merged with their fields, methods and parameters and nested again."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_non_blank
from ..operators.merge import BY_SOURCE, OBSERVERS, RUNTIME_FIRST

#: An observer's row of a key: its short name in a merged row.
_SHORT = dict(zip(OBSERVERS, "sbr", strict=True))


def _beside(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, s, b, r, place): the observers' rows of each key side by side, by one aggregation.

    Of rows that an observer repeats the last by `ordinal` counts, at the place of the first. place orders keys by the first
    observer that has them, then by their place there.
    """
    rest = [c for c in rows.columns if c not in (*key, "source", "ordinal")]
    own = lambda who: F.when(F.col("source") == who, F.col("ordinal"))
    packed = F.struct(F.lit(True).alias("there"), *rest)
    found = rows.groupBy(*key).agg(*(F.max_by(packed, own(who)).alias(short) for who, short in _SHORT.items()), *(F.min(own(who)).alias(f"at_{short}") for who, short in _SHORT.items()))
    places = (F.when(F.col(f"at_{short}").isNotNull(), F.struct(F.lit(n).alias("observer"), F.col(f"at_{short}").alias("at"))) for n, short in enumerate(_SHORT.values()))
    return found.withColumn("place", F.coalesce(*places)).filter("place IS NOT NULL").drop(*(f"at_{short}" for short in _SHORT.values()))


def _of(order: Sequence[str], name: str) -> list[Column]:
    return [F.col(f"{_SHORT[who]}.{name}") for who in order]


def _text(name: str, order: Sequence[str] = BY_SOURCE) -> Column:
    """The first non-blank of the observers' texts."""
    return first_non_blank(*_of(order, name)).alias(name)


def _value(name: str) -> Column:
    """The first that isn't null: sources, then the running system, then class files."""
    return F.coalesce(*_of(RUNTIME_FIRST, name)).alias(name)


def _base(name: str) -> Column:
    """That of the first observer which has the key at all, whatever it is."""
    return F.when(F.col("s.there"), F.col(f"s.{name}")).when(F.col("b.there"), F.col(f"b.{name}")).otherwise(F.col(f"r.{name}")).alias(name)


def _either(name: str, who: Sequence[str]) -> Column:
    """Whether one of these observers says so."""
    said = [F.coalesce(c, F.lit(False)) for c in _of(who, name)]
    return (said[0] | said[1]).alias(name)


def _union(name: str, kind: str, plain: Callable[[Column], Column] | None = None, back: Callable[[Column], Column] | None = None) -> Column:
    """The observers' lists one after the other, each item once. plain, back: to items that can be compared, and back."""
    parts = [F.coalesce(c, F.array().cast(kind)) for c in _of(BY_SOURCE, name)]
    if plain is None:
        return F.array_distinct(F.concat(*parts)).alias(name)
    return F.transform(F.array_distinct(F.transform(F.concat(*parts), plain)), back).alias(name)


def _marks(rows: DataFrame) -> Column:
    """The annotations' union. Their values are maps, which Spark doesn't compare: sorted entries stand for them."""
    plain = lambda a: F.struct(a["name"].alias("name"), a["qualified_name"].alias("qualified_name"), F.array_sort(F.map_entries(a["values"])).alias("values"))
    back = lambda a: F.struct(a["name"].alias("name"), a["qualified_name"].alias("qualified_name"), F.map_from_entries(a["values"]).alias("values"))
    return _union("annotations", rows.schema["annotations"].dataType.simpleString(), plain, back)


def _listed(rows: DataFrame, owner: str, name: str) -> DataFrame:
    """(owner, name): an owner's merged rows as one array in order of place."""
    inner = [c for c in rows.columns if c not in (owner, "place")]
    ordered = F.array_sort(F.collect_list(F.struct("place", F.struct(*inner).alias("row"))), lambda a, b: F.when(a["place"] < b["place"], -1).when(a["place"] > b["place"], 1).otherwise(0))
    return rows.groupBy(owner).agg(F.transform(ordered, lambda x: x["row"]).alias(name))


def merged_types(types: DataFrame, fields: DataFrame, methods: DataFrame, params: DataFrame) -> DataFrame:
    """Types with nested fields, methods and the methods' parameters, from tables of schemas.TYPES, FIELDS, METHODS and PARAMS in which every row names its observer.

    Bottom-up: each level is merged by its key (method and parameter, type and field, type and method), then listed in its
    owner's row. Members come in order of the first observer that has them. Texts are the first non-blank of sources, class files
    and the running system; parameter names and flags prefer the running system to class files; bodies are those of sources.
    Members of unknown types and parameters of unknown methods are left out. One shuffle by each level's key and one by its
    owner; a type's members meet in one row, since they are one value of it.
    """
    seen = lambda rows: _union("provenance", rows.schema["provenance"].dataType.simpleString())
    p = _beside(params, ["method_id", "id"])
    p = p.select("method_id", "place", "id", _text("name", RUNTIME_FIRST), _text("type"), _text("erased_type"), _value("nullable"), _marks(params), seen(params))
    m = _beside(methods, ["type_id", "id"]).join(_listed(p, "method_id", "parameters").withColumnRenamed("method_id", "id"), "id", "left")
    parameters = F.coalesce("parameters", F.array().cast(_listed(p, "method_id", "parameters").schema["parameters"].dataType)).alias("parameters")
    m = m.select(
        "type_id", "place", "id", _base("name"), _text("return_type"), _text("erased_return_type"), _text("visibility"), _either("constructor", ("SOURCE", "BYTECODE")), _either("synthetic", ("BYTECODE", "RUNTIME")),
        _either("bridge", ("BYTECODE", "RUNTIME")), parameters, _marks(methods), _union("thrown_types", "array<string>"), F.col("s.body").alias("body"), seen(methods),
    )
    f = _beside(fields, ["type_id", "id"])
    f = f.select("type_id", "place", "id", _base("name"), _text("type"), _text("erased_type"), _value("nullable"), _value("primary_key"), _marks(fields), seen(fields))
    t = _beside(types, ["id"])
    own, told = _listed(f, "type_id", "fields").withColumnRenamed("type_id", "id"), _listed(m, "type_id", "methods").withColumnRenamed("type_id", "id")
    listed = t.join(own, "id", "left").join(told, "id", "left")
    empty = lambda name, table: F.coalesce(name, F.array().cast(table.schema[name].dataType)).alias(name)
    return listed.select(
        "id", *(_text(n) for n in ("package_name", "simple_name", "qualified_name", "kind")), _marks(types), _text("super_class"), _union("interfaces", "array<string>"),
        empty("fields", own), empty("methods", told), seen(types),
    )

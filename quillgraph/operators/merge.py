"""Merging what several observers report about the same keys, with precedence by field."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank

#: Observers in the order of their rows (fixed values).
OBSERVERS = ("SOURCE", "BYTECODE", "RUNTIME")
BY_SOURCE = ("SOURCE", "BYTECODE", "RUNTIME")
RUNTIME_FIRST = ("SOURCE", "RUNTIME", "BYTECODE")


def _rank(order: Sequence[str], source: str = "source") -> Column:
    return F.array_position(F.array(*map(F.lit, order)), F.col(source))


def observer_merge(
    observed: DataFrame, key: str | Sequence[str], first_text: Mapping[str, Sequence[str]] | None = None, first_value: Mapping[str, Sequence[str]] | None = None,
    any_of: Mapping[str, Sequence[str]] | None = None, only: Mapping[str, str] | None = None, lists: Sequence[str] = (), named: Sequence[str] = (),
) -> DataFrame:
    """One row per key from rows tagged with their `source`; one shuffle, whatever the number of fields.

    first_text: first non-blank text in the given order of observers. first_value: first non-null.
    any_of: true if one of the given observers says so, null counts as false. only: from this observer
    alone. lists: union without repeats, observers in their order. named: from the first observer that
    has the key at all, even if blank.
    """
    rank = lambda order: F.when(_rank(order) > 0, _rank(order))
    best = lambda c, order, ok: F.min_by(F.when(ok, F.col(c)), F.when(ok, rank(order))).alias(c)
    out = [best(c, order, ~blank(F.col(c))) for c, order in (first_text or {}).items()]
    out += [best(c, order, F.col(c).isNotNull()) for c, order in (first_value or {}).items()]
    out += [F.coalesce(F.bool_or(F.col(c) & F.col("source").isin(*who)), F.lit(False)).alias(c) for c, who in (any_of or {}).items()]
    out += [F.max(F.when(F.col("source") == who, F.col(c))).alias(c) for c, who in (only or {}).items()]
    out += [F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(_rank(OBSERVERS).alias("at"), F.coalesce(c, F.array()).alias("items")))), lambda x: x["items"]))).alias(c) for c in lists]
    out += [F.min_by(c, _rank(OBSERVERS)).alias(c) for c in named]
    return observed.groupBy(*([key] if isinstance(key, str) else key)).agg(*out)


def merge_conflicts(observed: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, field, values): fields for which observers name different non-blank values (an addition of ours)."""
    long = observed.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select(key, "x.*").filter(~blank(F.col("value")))
    said = long.groupBy(key, "field").agg(F.array_join(F.array_sort(F.collect_set("value")), "|").alias("values"), F.count_distinct("value").alias("n"))
    return said.filter("n > 1").drop("n")


def overlay_upsert(rows: DataFrame, key: str, priority: str, ordinal: str) -> DataFrame:
    """The last row of each key by (priority, ordinal), at the position where the key was first seen: adds `position`.

    Position is the smallest (priority, ordinal) of the key: replaced values keep the place of the first.
    """
    packed = F.struct(*(F.col(c) for c in rows.columns))
    order = F.struct(priority, ordinal)
    merged = rows.groupBy(F.col(key).alias("_k")).agg(F.max_by(packed, order).alias("r"), F.min(order).alias("p"))
    return merged.select("r.*", F.concat_ws(":", f"p.{priority}", f"p.{ordinal}").alias("position"))


def keep_first(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key, all columns. Each column is an aggregate of its own by the same order, so those that nobody reads are neither built nor shuffled."""
    first = rows.groupBy(F.col(key).alias("_k")).agg(*(F.min_by(c, F.struct(*order)).alias(c) for c in rows.columns if c != key))
    return first.select(*(F.col("_k").alias(c) if c == key else c for c in rows.columns))


def ordered_distinct_union(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """(key, values): each key's distinct values in order of first occurrence."""
    first = rows.groupBy(key, value).agg(F.min(F.struct(*order)).alias("at"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", value))), lambda x: x[value]).alias("values"))


def conflicting_literals(uses: DataFrame, group: Sequence[str], literal: str, *order: str) -> DataFrame:
    """Rows whose literal differs from the first one of their group: adds `first_literal`."""
    first = uses.groupBy(*group).agg(F.min_by(literal, F.struct(*order)).alias("first_literal"))
    return uses.join(first, list(group)).filter(F.col(literal) != F.col("first_literal"))


def duplicate_keys(rows: DataFrame, key: Sequence[str], *order: str) -> DataFrame:
    """Every occurrence of a key but its first. The first is an aggregate, so a hot key is never gathered; `order` tells rows of a key apart."""
    first = rows.groupBy(*key).agg(F.min(F.struct(*order)).alias("_first"))
    return rows.join(first, list(key)).filter(F.struct(*order) > F.col("_first")).drop("_first")

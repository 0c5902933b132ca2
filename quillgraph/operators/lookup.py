"""Joins that look something up: with a first match, a fallback, either of two keys, or the longest prefix."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_path
from ..sources.files import written, written_counted


def first_match(left: DataFrame, refs: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left rows with the columns of their key's first ref; nulls where there is none. Refs are reduced before the join."""
    first = refs.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("r"))
    return left.join(first, key, "left").select(*(left[c] for c in left.columns), *(F.col(f"r.{c}").alias(c) for c in columns))


def lookup_with_fallback(left: DataFrame, known: DataFrame, key: str, value: str, fallback: Column, name: str) -> DataFrame:
    """Left rows with known.value by key, or a fallback made from the row. Keys of `known` are unique."""
    return left.join(known.select(key, F.col(value).alias(name)), key, "left").withColumn(name, F.coalesce(name, fallback))


def lookup_by_either(left: DataFrame, known: DataFrame, keys: Sequence[str], key: str, value: str, name: str, root: Column | None = None) -> DataFrame:
    """The value of the first of several key columns that is known, else root."""
    found = []
    for n, k in enumerate(keys):
        left = left.join(known.select(F.col(key).alias(k), F.col(value).alias(f"_v{n}")), k, "left")
        found.append(F.col(f"_v{n}"))
    return left.withColumn(name, F.coalesce(*found, *([root] if root is not None else []))).drop(*(f"_v{n}" for n in range(len(keys))))


def layered_lookup(left: DataFrame, key: str, layers: Sequence[tuple[DataFrame, bool]], name: str, root: Column) -> DataFrame:
    """Owners from several (key, owner, ordinal) tables: an earlier layer wins; in a layer the first or (True) the last row of a key.

    One union and one aggregation replace a join per layer.
    """
    tagged = None
    for n, (table, last) in enumerate(layers):
        rows = table.select(F.col(key), F.col("owner"), F.lit(n).alias("layer"), (-F.col("ordinal") if last else F.col("ordinal")).alias("place"))
        tagged = rows if tagged is None else tagged.unionByName(rows)
    chosen = tagged.groupBy(key).agg(F.min_by("owner", F.struct("layer", "place")).alias(name))
    return left.join(chosen, key, "left").withColumn(name, F.coalesce(name, root))


def unknown_references(refs: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Refs whose key is not known; none if nothing is known at all. A null key is unknown."""
    some = known.groupBy().agg((F.count("*") > 0).alias("some")).filter("some").drop("some")
    return refs.join(known.select(key).distinct(), key, "left_anti").join(F.broadcast(some), how="cross")


def either_key_semi(left: DataFrame, wanted: DataFrame, key: str, keys: Column, row_id: str) -> DataFrame:
    """Left rows of whose keys (an array) one is wanted: an equi-join on the exploded keys instead of an OR."""
    hits = left.select(row_id, F.explode(F.array_distinct(keys)).alias(key)).join(wanted.select(key).distinct(), key, "left_semi").select(row_id).distinct()
    return left.join(hits, row_id, "left_semi")


def path_prefixes(path: Column) -> Column:
    """The path and all its prefixes that end before `/`, `:` or `#`; one pass finds the cuts."""
    ends = F.aggregate(F.split(path, "[/:#]"), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("cuts")), lambda acc, p: F.struct((acc.at + F.length(p) + 1).alias("at"), F.array_append(acc.cuts, acc.at + F.length(p)).alias("cuts")), lambda acc: acc.cuts)
    return F.array_distinct(F.concat(F.array(path), F.transform(F.filter(ends, lambda n: n > 0), lambda n: F.substr(path, F.lit(1), n))))


def longest_prefix_join(artifacts: DataFrame, nodes: DataFrame, row_id: str, path: str, root: Column | None = None) -> DataFrame:
    """(row_id, path, owner): the node with the same path (the last of several), else the longest node path that is a
    prefix up to a boundary (the first of several), else root; without a root, rows without owner are dropped.

    Each artifact is exploded into its prefixes, so the theta join is an equi-join on the path.
    """
    exact = F.max_by("id", "ordinal")
    owners = nodes.filter("path <> ''").groupBy(F.col("path").alias("prefix")).agg(exact.alias("last_id"), F.min_by("id", "ordinal").alias("first_id"))
    exploded = artifacts.select(row_id, F.col(path).alias("_path"), F.explode(path_prefixes(F.col(path))).alias("prefix"))
    chosen = exploded.join(owners, "prefix").select(row_id, F.length("prefix").alias("size"), F.when(F.col("prefix") == F.col("_path"), F.col("last_id")).otherwise(F.col("first_id")).alias("owner"))
    best = chosen.groupBy(row_id).agg(F.max_by("owner", "size").alias("owner"))
    out = artifacts.select(row_id, path).join(best, row_id, "left")
    return out.withColumn("owner", F.coalesce("owner", root)) if root is not None else out.filter("owner IS NOT NULL")


def collected_branches(left: DataFrame, key: str, branches: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """Left rows with a sorted set per branch (table, value column, name). Branches are aggregated first, so they don't multiply."""
    for table, value, name in branches:
        left = left.join(table.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return left


def align_groups(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join of two tables of groups on their name."""
    return left.join(right, key, "full_outer")


def patch_merge(rows: DataFrame, patch: DataFrame, key: str, columns: Sequence[str], valid: Column | None = None) -> DataFrame:
    """Patch values replace those of rows with the same key where they are given (and valid); rows with new keys are appended."""
    ok = lambda c: F.when(valid if valid is not None else F.lit(True), F.col(f"_p_{c}"))
    renamed = patch.select(key, *(F.col(c).alias(f"_p_{c}") for c in columns))
    updated = rows.join(renamed, key, "left").select(*(F.coalesce(ok(c), F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns))
    fresh = patch.join(rows.select(key), key, "left_anti").select(*(F.col(c) if c in patch.columns else F.lit(None).alias(c) for c in rows.columns))
    return updated.unionByName(fresh)


def value_guard(c: Column) -> Column:
    """A value worth taking over: not blank and without a <placeholder>."""
    return c.rlike(r"\S") & ~F.contains(c, F.lit("<"))


def combined_paths(prefixes: Column, paths: Column) -> Column:
    """Every prefix before every path, normalised; where one list is empty the other as it is, where both are, the root."""
    both = F.flatten(F.transform(prefixes, lambda a: F.transform(paths, lambda b: normalize_path(F.concat(a, F.lit("/"), b)))))
    return F.when((F.size(prefixes) == 0) & (F.size(paths) == 0), F.array(F.lit("/"))).when(F.size(prefixes) == 0, paths).when(F.size(paths) == 0, prefixes).otherwise(both)


#: Names that go to every task as one array; more meet the texts by an equi-join on grams of these many bytes.
NAMES_AT_ONCE, GRAMS = 2_000, (1, 2, 4, 8, 16)
#: Texts whose grams are counted to find each name's rarest; they settle which gram stands for a name, never which names are found.
SAMPLED_TEXTS = 1_000
#: Bytes of names and grams that may be broadcast.
BROADCAST_BYTES = 32 << 20
#: Bits of the map of names' grams, and counters of the sampled texts' grams.
BITMAP, COUNTED = 1 << 27, 1 << 21


def _grams(column: pa.Array, lengths: Sequence[int]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """(offsets, hashes by length): of a column of texts, laid end to end, the hash of the stretch of that many UTF-8 bytes from each byte on. Each length is made of the hashes of half of it."""
    parts = [(x or "").encode() for x in column.to_pylist()]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int64)
    found = {1: (np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)}
    for n in GRAMS[1:]:
        if n <= max(lengths):
            half = found[n // 2]
            x = half[: max(0, len(half) - n // 2)] * np.uint64(0xD1342543DE82EF95) + half[n // 2 :]
            found[n] = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return offsets, {n: found[n] ^ (found[n] >> np.uint64(32)) for n in lengths}


def _bits(hashes: np.ndarray) -> Iterator[np.ndarray]:
    """The three places of hashes in a bitmap of BITMAP bits."""
    return ((hashes >> np.uint64(shift) & np.uint64(BITMAP - 1)).astype(np.int64) for shift in (0, 18, 37))


def _sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, rows) for batch in batches for at in range(0, batch.num_rows, rows))


def _seen_grams(texts: DataFrame, lengths: Sequence[int]) -> np.ndarray:
    """How many of some texts hold a gram, by the low bits of its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(COUNTED, np.int64)
        for batch in _sliced(batches, 1):
            for hashes in _grams(batch.column(0), lengths)[1].values():
                seen[np.unique(hashes & np.uint64(COUNTED - 1)).astype(np.int64)] += 1
        at = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["at", "n"])

    out = np.zeros(COUNTED, np.int64)
    told = texts.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out[told["at"].to_numpy()] = told["n"].to_numpy()
    return out


def _rarest_grams(rows: DataFrame, known: DataFrame, text: str, lengths: Sequence[int]) -> DataFrame:
    """(_name, _h): of each name (_name, _n) the gram of its length that fewest of some texts hold, the last of several."""
    seen = rows.sparkSession.sparkContext.broadcast(_seen_grams(rows.select(text).limit(SAMPLED_TEXTS), lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, 4096):
            offsets, grams = _grams(batch.column(0), lengths)
            sizes, best = batch.column(1).to_numpy(), np.zeros(batch.num_rows, np.uint64)
            for n in np.unique(sizes).tolist():
                of = np.nonzero(sizes == n)[0]
                many = offsets[of + 1] - offsets[of] - n + 1
                name = np.repeat(of, many)
                at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + offsets[name]
                hashes = grams[n][at]
                order = np.lexsort((-at, seen.value[(hashes & np.uint64(COUNTED - 1)).astype(np.int64)], name))
                first = order[np.concatenate(([0], np.cumsum(many)[:-1]))]
                best[name[first]] = hashes[first]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.view(np.int64))], names=["_name", "_h"])

    return known.select("_name", "_n").mapInArrow(run, "_name string, _h long")


def _bitmap(chosen: DataFrame) -> np.ndarray:
    """A Bloom filter of the hashes, of one size whatever their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(list(_bits(batch.column(0).to_numpy().view(np.uint64)))))], names=["at"])

    places = chosen.select("_h").mapInArrow(run, "at long").groupBy(F.floor(F.col("at") / 32768).alias("part")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits"))
    out = np.zeros((BITMAP // 32768, 4096), np.uint8)
    for r in places.toLocalIterator():
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def _met_grams(numbered: DataFrame, text: str, lengths: Sequence[int], bitmap: np.ndarray) -> DataFrame:
    """(_row, _h): the grams of texts that the bitmap knows; of those of no name it knows few."""
    known = numbered.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, 64):
            offsets, grams = _grams(batch.column(1), lengths)
            texts, found = [], []
            for n, hashes in grams.items():
                at = np.arange(len(hashes))
                for place in range(3):
                    bit = list(_bits(hashes[at]))[place] if place else (hashes & np.uint64(BITMAP - 1)).astype(np.int64)
                    at = at[(known.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
                text = np.searchsorted(offsets, at, "right") - 1
                whole = at + n <= offsets[text + 1]
                texts.append(text[whole])
                found.append(hashes[at[whole]])
            pairs = np.unique(np.stack([np.concatenate(texts).astype(np.uint64), np.concatenate(found)]), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pairs[0].astype(np.int64))), pa.array(pairs[1].view(np.int64))], names=["_row", "_h"])

    return numbered.select("_row", text).mapInArrow(run, "_row long, _h long")


def named_in(rows: DataFrame, names: DataFrame, text: str, name: str, limit: int | None = None, order: Sequence[str] = (), at_once: int = NAMES_AT_ONCE) -> DataFrame:
    """Rows whose text contains one of the names; repeated rows and rows with nulls stay as they are. Empty and null names are in no text.

    A counted few names are one broadcast array. Of more, each is known by its rarest gram. Texts' grams leave their task only if a bitmap of
    the names' grams knows them; these are joined by hash with the names, and the names are compared with the texts of the rows that come out.
    """
    known = names.select(F.col(name).alias("_name")).filter(F.length("_name") > 0).distinct()
    if known.limit(at_once + 1).count() <= at_once:
        listed = F.broadcast(known.agg(F.collect_list("_name").alias("_names")))
        out = rows.join(listed, how="cross").filter(F.exists("_names", lambda x: F.contains(F.col(text), x))).drop("_names")
    else:
        fits = F.filter(F.array(*map(F.lit, GRAMS)), lambda n: n <= F.octet_length("_name"))
        known = written(known.withColumn("_n", F.array_max(fits)), "names")
        size = known.agg(F.sum(F.octet_length("_name") + 32).alias("bytes"), F.collect_set("_n").alias("lengths")).first()
        lengths = sorted(size.lengths or [])
        if not lengths:
            return rows.limit(0)
        numbered = written(rows.withColumn("_row", F.monotonically_increasing_id()), "texts")
        own = written(_rarest_grams(numbered, known, text, lengths), "grams")
        met = _met_grams(numbered, text, lengths, _bitmap(own)).join(F.broadcast(own) if size.bytes <= BROADCAST_BYTES else own, "_h").select("_row", "_name")
        met, (volume,) = written_counted(met, "met", F.sum(F.octet_length("_name") + 40))
        hits = numbered.select("_row", F.col(text).alias("_text")).join(F.broadcast(met) if (volume or 0) <= BROADCAST_BYTES else met, "_row")
        hits = hits.filter(F.contains("_text", F.col("_name"))).select("_row").distinct()
        out = numbered.join(hits, "_row", "left_semi").select(rows.columns)
    return out.orderBy(*order).limit(limit) if limit else out

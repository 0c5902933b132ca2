"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

A seed hashes the tokens at the kept positions of a fixed mask and ignores the others, so it survives
substitutions there. Seeds of benchmark items and of documents are joined; around a hit, item and
document are laid against each other and substitutions are counted.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Kept positions. However two of 13 consecutive words are substituted, the mask fits between them at one of its six
#: places in the 13 words (a test enumerates all 78 pairs); no single mask of weight 6 does that.
MASKS = ((0, 1, 3, 6, 7),)
#: Seeds of the benchmark, with some 200 bytes of words beside each, that may be broadcast; beyond, both sides are shuffled by seed.
BROADCAST_SEEDS = 100_000
#: Documents with a hit, of which as many ids may be broadcast to fetch their texts; beyond, all texts are shuffled to meet the hits.
BROADCAST_DOCS = 1_000_000


def token_hashes(text: Column) -> Column:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; null: none."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    bare = F.btrim(low, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    return F.transform(words, lambda w: F.xxhash64(w))


def _starts(tokens: Column, span: int) -> Column:
    last = F.size(tokens) - (span - 1)
    return F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))


def seed_mask(min_words: int, allowed: int) -> tuple[int, ...]:
    """A mask that finds every stretch of min_words words of which at most `allowed` are substituted.

    Between k substitutions in n words a run of n // (k + 1) equal words is left over.
    """
    if min_words >= 13 and allowed <= 2:
        return MASKS[0]
    if not (run := min_words // (allowed + 1)):
        raise ValueError("min_share must leave equal words in every stretch")
    return tuple(range(run))


def _seed(mask: tuple[int, ...]):
    return lambda i: F.xxhash64(*(F.get("tokens", i + p if p else i) for p in mask))


def _seeded(tokens: DataFrame, keep: list[str], masks: list[tuple[int, ...]]) -> DataFrame:
    """A row for each seed: keep..., at (from 0), seed. The masks' seeds stand behind one another, so texts are split once."""
    seeds, ends = [], [F.lit(0)]
    for mask in masks:
        seeds.append(F.transform(_starts(F.col("tokens"), max(mask) + 1), _seed(mask)))
        ends.append(ends[-1] + F.greatest(F.lit(0), F.size("tokens") - max(mask)))
    listed = tokens.select(*keep, F.array(*ends[:-1]).alias("ends"), F.posexplode(F.concat(*seeds)).alias("n", "seed"))
    at = F.col("n")
    for k in range(1, len(masks)):
        at = F.when(F.col("n") >= F.get("ends", F.lit(k)), F.col("n") - F.get("ends", F.lit(k))).otherwise(at)
    return listed.select(*keep, "seed", at.alias("at"))


def _sought(items: DataFrame, mask: tuple[int, ...], brief: list[int], reach: range) -> DataFrame:
    """(seed, beside, short, place, item_id, n): the distinct surroundings of the items' seeds, so passages that many items share are one row.

    beside: tokens at the seed's place + reach, null beyond the item; place: the seed's, of items that must match whole (short), else 0.
    """
    n, span = F.size("tokens"), max(mask) + 1
    parts = [items.filter(n >= span).select("item_id", "tokens", "short", F.explode(F.sequence(F.lit(0), n - span)).alias("i")).withColumn("seed", _seed(mask)(F.col("i")))]
    parts += [items.filter(n == size).select("item_id", "tokens", "short", F.lit(0).alias("i")).withColumn("seed", _seed(tuple(range(size)))(F.col("i"))) for size in brief]
    seeds = parts[0]
    for part in parts[1:]:
        seeds = seeds.unionByName(part)
    beside = F.transform(F.array(*map(F.lit, reach)), lambda k: F.get("tokens", F.col("i") + k))
    seeds = seeds.select("seed", beside.alias("beside"), "short", F.when(F.col("short"), F.col("i")).otherwise(0).alias("place"), "item_id", n.alias("n"))
    return seeds.groupBy("seed", "beside", "short", "place").agg(F.min("item_id").alias("item_id"), F.max("n").alias("n"))


def _bits(reach: range, holds: Callable[[Column, Column], Column]) -> Column:
    """A bit for each place around a seed where something holds of the item's and the document's word."""
    return sum((F.when(holds(F.get("beside", F.lit(k)), F.get("words", F.lit(k))), F.lit(1 << k).cast("long")).otherwise(0) for k in range(len(reach))), start=F.lit(0).cast("long"))


def contaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, min_share: float = 0.8, broadcast_seeds: int = BROADCAST_SEEDS, broadcast_docs: int = BROADCAST_DOCS) -> DataFrame:
    """(doc_id, stretches, first_word, last_word, item_id, item_words): a row per document that holds a stretch of an item.

    A stretch is min_words consecutive words of which at least min_share are, place by place, those of
    min_words consecutive words of an item; of an item shorter than that, all its words in a row.
    stretches counts the words (from 0) where one begins, first_word and last_word are the least and the
    greatest of these, item_id is the smallest of the items they were found in, item_words the length of the longest: a
    caller that deletes documents can ask for items of some length. Null texts have no words; items without words or
    id and rows without an id are left out; rows that repeat an id count as one document. Passages that items
    share are sought once, so rows follow the documents' words, whatever the number of items.
    Documents without a hit move only where those with one are too many for their ids to be broadcast. min_words is
    at most 31. Items that differ in a word or two beside a shared passage are each laid against a document that holds it.
    """
    least = math.ceil(min_share * min_words - 1e-9)
    mask = seed_mask(min_words, min_words - least)
    before = min_words - max(mask) - 1
    reach = range(-before, min_words)
    if len(reach) > 62:
        raise ValueError("min_words is at most 31: the words beside a seed are compared as bits of one number")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), token_hashes(F.col("text")).alias("tokens")).filter(F.size("tokens") > 0).filter("item_id IS NOT NULL")
    items = items.withColumn("short", F.size("tokens") < min_words)
    # Items that the mask doesn't fit in are sought by all their words; documents get seeds of those lengths that occur.
    brief = sorted(r.n for r in items.filter(F.size("tokens") <= max(mask)).select(F.size("tokens").alias("n")).distinct().collect())
    sought = materialize(_sought(items, mask, brief, reach), "sought")
    few = sought.count() <= broadcast_seeds
    seeds = sought.select("seed").distinct()
    texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    listed = _seeded(texts.select("doc_id", token_hashes(F.col("text")).alias("tokens")), ["doc_id"], [mask, *(tuple(range(n)) for n in brief)])
    hits = listed.join(F.broadcast(seeds) if few else seeds, "seed", "left_semi")
    met = materialize(hits.groupBy("doc_id").agg(F.collect_list(F.struct("seed", "at")).alias("met")), "hits")
    if met.count() <= broadcast_docs:
        texts = texts.join(F.broadcast(met.select("doc_id")), "doc_id", "left_semi")
    # Of a document's words only those beside a seed go on with it.
    words = lambda m: F.transform(F.array(*map(F.lit, reach)), lambda k: F.get("tokens", m.at + k))
    laid = texts.join(met, "doc_id").select("doc_id", "met", token_hashes(F.col("text")).alias("tokens"))
    laid = laid.select("doc_id", F.explode(F.transform("met", lambda m: F.struct(m.seed.alias("seed"), m.at.alias("at"), words(m).alias("words")))).alias("m")).select("doc_id", "m.*")
    laid = laid.join(F.broadcast(sought) if few else sought, "seed")
    laid = laid.withColumns({"same": _bits(reach, lambda w, x: w == x), "there": _bits(reach, lambda w, x: w.isNotNull() & x.isNotNull())})
    full = (1 << min_words) - 1
    held = lambda o: (F.bit_count(F.shiftright("same", o).bitwiseAND(F.lit(full))) >= least) & (F.shiftright("there", o).bitwiseAND(F.lit(full)) == full)
    whole = F.when(F.bit_count("same") == F.col("n"), F.array(F.lit(before) - F.col("place"))).otherwise(F.array().cast("array<int>"))
    begins = F.when(F.col("short"), whole).otherwise(F.array_compact(F.array(*(F.when(held(o), o) for o in range(before + 1)))))
    found = laid.select("doc_id", "at", "item_id", "n", F.explode(begins).alias("o"))
    found = found.groupBy("doc_id", (F.col("at") + F.col("o") - before).cast("long").alias("word")).agg(F.min("item_id").alias("item_id"), F.max("n").alias("n"))
    return found.groupBy("doc_id").agg(F.count("*").alias("stretches"), F.min("word").alias("first_word"), F.max("word").alias("last_word"), F.min("item_id").alias("item_id"), F.max("n").cast("long").alias("item_words"))

"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Targets are filled like water up to each source's cap. The target's blocks go to sources, and a
source's blocks to its shards, by highest quotients votes / (2k + 1). A shard repeats all its blocks as
often as its quota allows, and a seeded permutation of the blocks picks those that count once more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, named

_WHITE = " \t\n\x0b\x0c\r"
#: A prime beyond any shard's number of blocks: multiplying by it permutes residues.
_PRIME = 2654435761


def word_count(text: F.Column) -> F.Column:
    """Number of `[^\\x20\\x09-\\x0D]+`; null: 0."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_WHITE))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def targets(sources: DataFrame, cap: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size) -> with src (rank by code point, null last) and target.

    Sorted by cap / weight, the sources before the first whose cap holds its share are at their caps,
    the rest share what is left by weight. One row per source: windows over the whole table are fine.
    """
    ranked = sources.withColumn("src", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("src") - 1) % len(weights) + 1).cast("double"))
    ranked = ranked.withColumn("ceiling", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("ceiling") / F.col("weight"))
    whole = Window.partitionBy()
    before = Window.orderBy("ratio", "src").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    level = ranked.withColumn("level", level)
    level = level.withColumn("level", F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(whole))
    return level.select("source", "source_size", "src", F.least("ceiling", F.col("level") * F.col("weight")).alias("target"))


def sainte_lague(votes: DataFrame, key: str, by: list[str]) -> DataFrame:
    """(by..., key, votes, total, most) -> with seats: `total` seats of each group by highest quotients, at most `most` each.

    Only quotients near the last seat's are listed: with n seats for s parties, rounding votes over
    V / n misses n by s / 2 at most, so the true divisor lies within a factor 1 ± 2s / n. That is O(s)
    rows per group, however many seats there are. Ties go to the smaller key.
    """
    group = Window.partitionBy(*by)
    fair = F.col("votes") * F.col("total") / F.greatest(F.sum("votes").over(group), F.lit(1e-300))
    width = F.lit(2.0) * F.count("*").over(group) / F.greatest(F.col("total"), F.lit(1))
    near = votes.withColumn("fair", fair).withColumn("width", width)
    near = near.withColumn("sure", F.least("most", F.greatest(F.lit(0), F.floor(F.col("fair") * (1 - F.col("width"))) - 2).cast("long")))
    near = near.withColumn("upto", F.least("most", F.ceil(F.col("fair") * (1 + F.col("width"))).cast("long") + 2))
    near = near.withColumn("upto", F.when(F.col("votes") > 0, F.col("upto")).otherwise(F.col("sure")))
    near = near.withColumn("open", F.greatest(F.lit(0), F.col("total") - F.sum("sure").over(group)))
    contest = near.filter("upto > sure").select(*by, key, "open", F.col("votes"), F.explode(F.sequence("sure", F.col("upto") - 1)).alias("seat_no"))
    best = Window.partitionBy(*by).orderBy((F.col("votes") / (2 * F.col("seat_no") + 1)).desc(), key)
    won = contest.withColumn("rank", F.row_number().over(best)).filter("rank <= open").groupBy(*by, key).agg(F.count("*").alias("won"))
    return near.join(won, [*by, key], "left").withColumn("seats", F.col("sure") + F.coalesce("won", F.lit(0))).drop("fair", "width", "sure", "upto", "open", "won")


#: Shards of a source that are apportioned together; groups of them come first.
SHARD_GROUP = 1024
#: Copies of one row that are listed at once.
_COPIES = 1 << 16


def _told_apart(sizes: DataFrame) -> DataFrame:
    """Rows with marks of their own: of equal rows the n-th has a mark made of theirs and n."""
    counted = sizes.groupBy(*sizes.columns).agg((F.count("*") - 1).alias("last"))
    many = counted.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / _COPIES))))
    many = many.withColumn("n", F.explode(F.sequence(F.col("chunk") * _COPIES, F.least(F.col("last"), F.col("chunk") * _COPIES + (_COPIES - 1)))))
    return many.select("doc_id", "source", "size", F.when(F.col("n") == 0, F.col("mark")).otherwise(F.xxhash64("mark", "n")).alias("mark"))


def mix(docs: DataFrame, block_words: int = 16, shard_words: int = 1 << 20, cap: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): how many of its words the mix takes, repeats counted.

    Every row counts, repeated ones too; null texts have size 0 and null is a source of its own. No
    document exceeds `cap` times its size. A shard holds about shard_words words, so a source with a
    third of the corpus is many shards, whose blocks are apportioned to groups of shards first. Reruns agree:
    all choices are hashes of ids, texts and the seed. Rows that are equal in these are counted and told apart by their
    number, so they are dealt to shards like any others.
    """
    mark = F.xxhash64(F.lit(seed), named(docs, id_col).cast("long"), F.coalesce(named(docs, text_col), F.lit("")))
    sizes = docs.select(named(docs, id_col).cast("long").alias("doc_id"), named(docs, source_col).cast("string").alias("source"), word_count(named(docs, text_col)).alias("size"), mark.alias("mark"))
    sizes = materialize(_told_apart(sizes), "sizes")
    sources = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), cap)
    blocks = lambda words: F.ceil(words / F.lit(block_words)).cast("long")
    quota = sources.select("src", F.col("target").alias("votes"), F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long").alias("total"), (cap * blocks(F.col("source_size"))).alias("most"))
    seats = sainte_lague(quota.withColumn("all", F.lit(0)), "src", ["all"]).select("src", F.col("seats").alias("source_seats"))
    sources = sources.join(seats, "src").withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long"))
    sources = materialize(sources, "sources").withColumnRenamed("source", "named")

    placed = sizes.join(sources, sizes.source.eqNullSafe(sources.named)).drop("named")
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("mark"), "shards"))
    shards = placed.groupBy("src", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_seats").alias("total"))
    shards = shards.select("src", "shard", F.floor(F.col("shard") / SHARD_GROUP).alias("shards_of"), "total", "shard_size", F.col("shard_size").cast("double").alias("votes"), (cap * blocks(F.col("shard_size"))).alias("most"))
    groups = shards.groupBy("src", "shards_of").agg(F.first("total").alias("total"), F.sum("votes").alias("votes"), F.sum("most").alias("most"))
    groups = sainte_lague(groups, "shards_of", ["src"]).select("src", "shards_of", F.col("seats").alias("total"))
    shards = shards.drop("total").join(groups, ["src", "shards_of"])
    quotas = materialize(sainte_lague(shards, "shard", ["src", "shards_of"]).select("src", "shard", blocks(F.col("shard_size")).alias("n_blocks"), "seats"), "quotas")

    order = Window.partitionBy("src", "shard").orderBy("mark", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = placed.withColumn("at", F.coalesce(F.sum("size").over(order), F.lit(0))).join(quotas, ["src", "shard"])
    start, end = F.col("at"), F.col("at") + F.col("size")
    n, rest = F.greatest("n_blocks", F.lit(1)), F.col("seats") % F.greatest("n_blocks", F.lit(1))
    turn = F.pmod(F.xxhash64(F.lit(seed + 1), "src", "shard"), n)

    def words(j: F.Column) -> F.Column:
        inside = F.least(end, (j + 1) * block_words) - F.greatest(start, j * block_words)
        return F.when(F.pmod(j * (F.lit(_PRIME) % n) + turn, n) < rest, inside).otherwise(0)

    reach = F.sequence(F.floor(start / block_words), F.floor((end - 1) / block_words))
    once_more = F.aggregate(reach, F.lit(0).cast("long"), lambda total, j: total + words(j))
    taken = F.col("size") * F.floor(F.col("seats") / n) + F.when(F.col("size") > 0, F.when(rest > 0, once_more).otherwise(0)).otherwise(0)
    return laid.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))

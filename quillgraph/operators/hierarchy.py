"""Trees as (id, parent) tables of any depth: roll-ups, ancestors, visible parts.

Pointers double: after k rounds a node knows its ancestor 2**k above, so a tree of depth d takes
log2(d) rounds. Each round's tables are stored in the shared folder, so plans stay as short as one
round, and every table has at most a row per node. They are deleted as soon as the next round is stored; what
the lazy result still reads goes when the driver ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import drop, written, written_counted
from .numbering import running

#: Rounds after which a chain is longer than any table: it runs in a circle.
MOST_ROUNDS = 40


def _jumps(nodes: DataFrame) -> list[DataFrame]:
    """Tables (id, up): the ancestor 1, 2, 4, ... above, for as long as any node has one. A circle is an error."""
    step = nodes.filter("parent IS NOT NULL").select("id", F.col("parent").alias("up")).join(nodes.select(F.col("id").alias("up")).distinct(), "up", "left_semi").select("id", "up")
    jumps, most = [], None
    while True:
        step, (left,) = written_counted(step, "jumps")
        if not left:
            return jumps
        most = left if most is None else most
        if len(jumps) > min(MOST_ROUNDS, most.bit_length()):
            raise ValueError("parents run in a circle")
        jumps.append(step)
        step = step.join(step.select(F.col("id").alias("up"), F.col("up").alias("over")), "up").select("id", F.col("over").alias("up"))


def _rolled_up(total: DataFrame, jumps: list[DataFrame], keep_jumps: bool = False) -> DataFrame:
    """(id, measures...) of nodes below or at each node, summed; only nodes that something reaches.

    In each round a node adds what it has gathered from 2**k levels to its ancestor 2**k above; sums combine before the shuffle.
    """
    names, before, used = [c for c in total.columns if c != "id"], None, None
    for jump in jumps:
        total = written(total, "total")
        drop(before, None if keep_jumps else used)
        before, used = total, jump
        total = total.unionByName(total.join(jump, "id").select(F.col("up").alias("id"), *names)).groupBy("id").agg(*(F.sum(n).alias(n) for n in names))
    return total


def hierarchical_rollup(nodes: DataFrame, measures: DataFrame, root_counts_itself: bool = True) -> DataFrame:
    """Each node's measures added to itself and to every ancestor: (id, measures...), a row per node."""
    names = [c for c in measures.columns if c != "id"]
    total = measures.groupBy("id").agg(*(F.sum(n).alias(n) for n in names))
    if not root_counts_itself:
        total = total.join(nodes.filter("parent IS NULL").select("id"), "id", "left_anti")
    total = _rolled_up(total, _jumps(nodes))
    return nodes.select("id").join(total, "id", "left").select("id", *(F.coalesce(n, F.lit(0)).alias(n) for n in names))


def _holding(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """(id, n, own): nodes with chosen ids at or below them, how many, and how many are the node itself. Unknown ids are left out."""
    marks = chosen.select("id").distinct().join(nodes.select("id").distinct(), "id", "left_semi").select("id", F.lit(1).alias("n"), F.lit(1).alias("own"))
    jumps = _jumps(nodes)
    below = _rolled_up(marks.select("id", "n"), jumps)
    return below.join(marks.select("id", "own"), "id", "left").select("id", "n", F.coalesce("own", F.lit(0)).alias("own"))


def expand_ancestors(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """Distinct ancestors to open so that the chosen ids show; the root is open anyway."""
    inner = nodes.filter("parent IS NOT NULL").select("id")
    return _holding(nodes, chosen).filter("n > own").select("id").join(inner, "id", "left_semi")


def neighborhood(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """A node, all above it and its direct children."""
    children = nodes.join(chosen.select(F.col("id").alias("parent")).distinct(), "parent", "left_semi").select("id")
    return _holding(nodes, chosen).select("id").unionByName(children).distinct()


def _shown(nodes: DataFrame, expanded: DataFrame) -> DataFrame:
    """(id, level) of nodes whose ancestors are all open and end at a root: each round a node takes over what its pointer's target knows."""
    opened = expanded.select("id", F.lit(True).alias("opened")).distinct()
    facts = nodes.join(opened, "id", "left").select(F.col("id").alias("parent"), (F.col("parent").isNull() | F.coalesce("opened", F.lit(False))).alias("is_open"))
    # up: the node that has to be asked next, null once all is known; ok: whether what lies between is open
    state = nodes.select("id", "parent").join(facts, "parent", "left").select(
        "id", F.when(F.col("is_open").isNotNull(), F.col("parent")).alias("up"), (F.col("parent").isNull() | F.coalesce("is_open", F.lit(False))).alias("ok"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("level"),
    )
    before = None
    for done in range(MOST_ROUNDS):
        state, (rows, left) = written_counted(state, "shown", F.count(F.lit(1)), F.count("up"))
        drop(before)
        before = state
        if not left:
            return state.filter("ok").select("id", "level")
        if done > rows.bit_length():
            break
        asked = state.select(F.col("id").alias("up"), F.col("up").alias("over"), F.col("ok").alias("rest"), F.col("level").alias("more"))
        after = state.filter("up IS NOT NULL").join(asked, "up").select("id", F.col("over").alias("up"), (F.col("ok") & F.col("rest")).alias("ok"), (F.col("level") + F.col("more")).alias("level"))
        state = state.filter("up IS NULL").unionByName(after)
    raise ValueError("parents run in a circle")


def visible_tree(nodes: DataFrame, expanded: DataFrame) -> DataFrame:
    """(id, level, place): nodes all of whose ancestors are expanded (the root always is), numbered from 0 in depth-first order of (ordinal, id).

    A node's place is that of its parent, and one more, and the sizes of the visible subtrees of the siblings before it; the
    sizes roll up, and the sums run along the ancestors by pointer doubling. Nodes under an unknown parent don't show; ids are unique.
    """
    seen = written(nodes.select("id", "parent", "ordinal").join(_shown(nodes, expanded), "id"), "seen")
    jumps = _jumps(seen)
    sizes = _rolled_up(seen.select("id", F.lit(1).cast("long").alias("size")), jumps, keep_jumps=True)
    offsets = running(seen.join(sizes, "id"), ["parent"], ["ordinal", "id"], "before", F.col("size"))
    place = offsets.select("id", (F.col("before") + F.when(F.col("parent").isNull(), 0).otherwise(1)).alias("place"))
    before = used = None
    for jump in jumps:  # of each node: the sum over itself and its ancestors less than 2**k above
        place = written(place, "place")
        drop(before, used)
        before, used = place, jump
        above = place.select(F.col("id").alias("up"), F.col("place").alias("more")).join(jump, "up").select("id", "more")
        place = place.join(above, "id", "left").select("id", (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"))
    return seen.select("id", "level").join(place, "id")


def visible_filtered(nodes: DataFrame, wanted: Column, expanded: DataFrame) -> DataFrame:
    """Nodes that meet a filter and all above them; if none does, what visible_tree shows."""
    shown = written(_holding(nodes, nodes.filter(wanted)).select("id"), "filtered")
    return _shown(nodes, expanded).select("id") if shown.isEmpty() else shown


def with_open_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are in the node set."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def artifacts_of(artifacts: DataFrame, visible: DataFrame) -> DataFrame:
    """Artifacts whose owner shows."""
    return artifacts.join(visible.select(F.col("id").alias("owner_id")).distinct(), "owner_id", "left_semi")

"""Run logs: latest states, stages, progress, decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_key(rows: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The last row of each key; an aggregation, not a window, so it combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def any_success(runs: DataFrame, kind: str) -> DataFrame:
    """One row: whether a run of this kind succeeded."""
    return runs.groupBy().agg(F.coalesce(F.bool_or((F.col("kind") == kind) & (F.col("status") == "SUCCEEDED")), F.lit(False)).alias("succeeded"))


def latest_top_level(runs: DataFrame, kind: str) -> DataFrame:
    """The last started run of a kind that has no parent."""
    return runs.filter((F.col("kind") == kind) & F.col("parent_run_id").isNull()).orderBy(F.desc("started_at"), F.desc("id")).limit(1)


def may_start(runs: DataFrame, project: str, kind: str) -> DataFrame:
    """The running run to return instead of starting one; empty if the latest run isn't running."""
    own = runs.filter((F.col("project_id") == project) & (F.col("kind") == kind))
    return latest_per_key(own, ["project_id", "kind"], "started_at", "id").filter("status = 'RUNNING'")


def progress(stages: DataFrame, run: str, status: str, ordinal: str) -> DataFrame:
    """(run, done, total, active): stages that aren't SKIPPED, how many succeeded, and the first that runs (from 0; -1 none)."""
    live = F.col(status) != "SKIPPED"
    return stages.groupBy(run).agg(
        F.count_if(live & (F.col(status) == "SUCCEEDED")).alias("done"), F.count_if(live).alias("total"),
        F.coalesce(F.min(F.when(F.col(status) == "RUNNING", F.col(ordinal))), F.lit(-1)).alias("active"),
    )


def current_stage(stages: Column) -> Column:
    """Of an array of stages the first running, else the first failed, else the last succeeded, else null."""
    of = lambda s: F.filter(stages, lambda x: x.status == s)
    return F.coalesce(F.get(of("RUNNING"), 0), F.get(of("FAILED"), 0), F.try_element_at(of("SUCCEEDED"), F.lit(-1)))


def stage_matrix(facts: DataFrame, key: str) -> DataFrame:
    """(key, stage, status) of four stages from flags: running, failed, evidence, trusted, spec, approved, graph_on, graph, answered.

    First match per stage; a stage waits for the one before it.
    """
    c = F.col
    evidence = F.when(c("running"), "running").when(~c("evidence"), "pending").when(c("failed"), "blocked").when(~c("trusted"), "needs-review").otherwise("healthy")
    spec = F.when(~c("evidence"), "not-loaded").when(c("running"), "running").when(~c("spec"), "pending").when(~c("approved"), "needs-review").otherwise("healthy")
    graph = F.when(~c("graph_on"), "not-loaded").when(~c("approved"), "blocked").when(~c("graph"), "pending").otherwise("healthy")
    ask = F.when(~c("approved"), "blocked").when(c("answered"), "healthy").otherwise("pending")
    rows = F.array(*(F.struct(F.lit(n).alias("stage"), s.alias("status")) for n, s in (("evidence", evidence), ("spec", spec), ("graph", graph), ("ask", ask))))
    return facts.select(key, F.explode(rows).alias("x")).select(key, "x.*")


def decision(branches: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The first branch whose condition holds."""
    out = F
    for condition, value in branches:
        out = out.when(F.coalesce(condition, F.lit(False)), F.lit(value))
    return out.otherwise(F.lit(otherwise))


def chips(parts: Sequence[Column], most: int = 4) -> Column:
    """Up to four non-empty texts."""
    return F.slice(F.filter(F.array(*parts), lambda x: F.coalesce(x != "", F.lit(False))), 1, most)


def node_chips(kind: Column, path: Column, metadata: Column, stats: dict[str, Column]) -> Column:
    """Up to four short texts of a lineage node, by its kind: counts (by the names of document.lineage()), facts, conflicts and evidence."""
    fact = lambda name: F.coalesce(metadata[name], F.lit(""))
    count = lambda name, text: F.concat(stats[name].cast("string"), F.lit(f" {text}"))
    no = F.lit("")
    path = F.coalesce(path, no)
    pairs = [
        ("service", count("bounded_contexts", "interfaces"), count("aggregates", "data stores")), ("interface", count("commands", "operations"), fact("protocol")), ("operation", F.trim(F.concat(F.upper(fact("method")), F.lit(" "), path)), no), ("datastore", path, no),
        ("integration", fact("direction"), fact("kind")), ("workflow", fact("summary"), no), ("rule", fact("statement"), no), ("scenario", fact("then"), no), ("note", fact("detail"), no),
    ]
    first, second = F, F
    for name, a, b in pairs:
        first, second = first.when(kind == name, a), second.when(kind == name, b)
    conflicts = F.when(stats["blocking"] > 0, count("blocking", "blocking")).when(stats["warning"] > 0, count("warning", "warnings")).otherwise("")
    evidence = F.when(stats["evidence"] > 0, count("evidence", "evidence")).otherwise("No evidence")
    return chips([first, second, conflicts, evidence])


def hotspots(rows: DataFrame, measures: Sequence[str], top: int = 6) -> DataFrame:
    """(id, label, measure, count): the largest positive counts of each measure, ties by label."""
    from pyspark.sql import Window

    long = rows.select("id", "label", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("long").alias("count")) for m in measures))).alias("x")).select("id", "label", "x.*").filter("count > 0")
    w = Window.partitionBy("measure").orderBy(F.desc("count"), "label", "id")
    return long.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)


def current_blocker(c: dict[str, Column]) -> Column:
    """What stands in the way, first match: flags running, failed, extracted, fatal (count), trusted, approved, graph_on, graph."""
    return decision(
        [
            (c["running"], "Knowledge refresh in progress"), (c["failed"], "Knowledge refresh failed"), (~c["extracted"], "Knowledge not extracted"), (c["fatal"] > 0, "Fatal extraction conflicts"),
            (~c["trusted"], "Extraction confidence gates not met"), (~c["approved"], "Approved semantic spec missing"), (c["graph_on"] & ~c["graph"], "Graph projection missing"),
        ],
        "Knowledge base ready",
    )


def next_action(c: dict[str, Column]) -> Column:
    """What to do next, first match, from the same flags."""
    return decision(
        [
            (c["running"], "Watch bootstrap progress"), (~c["extracted"] | ~c["approved"] | (c["graph_on"] & ~c["graph"]), "Refresh knowledge"),
            (c["fatal"] > 0, "Review extraction conflicts"), (~c["trusted"], "Review evidence confidence"),
        ],
        "Ask grounded questions",
    )

"""Context for a question: items and evidence as texts, ranked; no language model is called."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.retrieval import keyword_context, query_terms, term_overlap_topk

#: Second lines of an item's text by kind (fixed values), and evidence kinds that are read along.
SECOND_LINES = {"service": "Summary", "interface": "Protocol", "datastore": "Technology", "integration": "Artifacts", "workflow": "Summary", "rule": "Statement", "scenario": "Then"}
EVIDENCE_KINDS = ("documentation-section", "http-endpoint", "contract-operation")


def context_texts(items: DataFrame, nodes: DataFrame, evidence_kinds: tuple[str, ...] = EVIDENCE_KINDS) -> DataFrame:
    """(ordinal, text): items in the order of their kinds, then evidence of some kinds. Operations and notes aren't texts of their own."""
    kinds = list(SECOND_LINES)
    label = F.create_map(*(F.lit(x) for kv in SECOND_LINES.items() for x in kv))[F.col("kind")]
    texts = items.filter(F.col("kind").isin(*kinds)).select(
        F.struct(F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")).cast("int").alias("part"), "ordinal", "id").alias("ordinal"),
        F.concat(F.upper("kind"), F.lit(" "), "name", F.lit("\n"), label, F.lit(": "), F.coalesce("summary", F.lit(""))).alias("text"),
    )
    evidence = nodes.filter(F.col("kind").isin(*evidence_kinds)).select(
        F.struct(F.lit(len(kinds) + 1).alias("part"), "ordinal", "id").alias("ordinal"), F.concat(F.upper("kind"), F.lit(" "), "label", F.lit("\nPath: "), F.coalesce("path", F.lit(""))).alias("text")
    )
    return texts.unionByName(evidence)


def ask(items: DataFrame, nodes: DataFrame, question: str, k: int = 12, graph_limit: int = 20) -> DataFrame:
    """(source, text): the k best texts, then nodes of the graph that hold a term of the question."""
    best = term_overlap_topk(context_texts(items, nodes), question, k).select(F.lit("document").alias("source"), "text")
    named = nodes.select("id", F.col("label").alias("name"), F.lit("").alias("summary"), "path")
    wanted = query_terms(question, 2, True)
    found = keyword_context(named, wanted, graph_limit).select(F.lit("graph").alias("source"), F.concat_ws(" ", "name", "path").alias("text"))
    return best.unionByName(found) if wanted else best

"""Each stage against what it must keep, on its own input; and run() as a whole."""

import re
from collections import defaultdict

import corpus_pipeline as cp
import pytest
from quillgraph.llm.common import materialize


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory, sf):
    """The smallest documents with columns that clash, repeated rows, nulls; labels and benchmark beside them."""
    folder = tmp_path_factory.mktemp("sf")
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "1 AS key", "array(1) AS tokens", "'x' AS component_id")
    extra = spark.createDataFrame([(90001, None, "en", "src0", 0), (90002, "", "en", None, 0), (None, "a text without an id", "en", "src1", 9), (90003, "seen twice in one id", "en", "src1", 9), (90003, "seen twice in one id", "en", "src1", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.unionByName(extra.selectExpr("*", "1 AS key", "array(1) AS tokens", "'x' AS component_id")).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{tables}/labels.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    before = docs.collect()
    for name, stage in cp.STAGES:
        docs = materialize(stage(spark, docs, tables), name)
        after = docs.collect()
        kept = {r.doc_id for r in after}
        if name != "mix":
            assert docs.columns == columns and {tuple(map(str, r)) for r in after} <= {tuple(map(str, r)) for r in before}
        if name == "quality":
            known = [r for r in before if r.doc_id in labels]
            assert sum((r.doc_id in kept) == labels[r.doc_id] for r in known) / len(known) > 0.9
        elif name == "exact_dedup":
            groups = defaultdict(list)
            for r in before:
                groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append(r)
            assert len(after) == len(groups)
            assert {(r.doc_id, r.text) for r in after} == {min(((-len(r.text or ""), r.doc_id is None, r.doc_id or 0), (r.doc_id, r.text)) for r in g)[1] for g in groups.values()}
        elif name == "near_dedup":
            grams = lambda t: {tuple(w[k : k + 5]) for w in [(t or "").lower().split()] for k in range(max(1, len(w) - 4))}
            sets = {r.doc_id: grams(r.text) for r in before if r.doc_id is not None}
            like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            gone = set(sets) - kept
            assert all(max(like(d, o) for o in sets if o != d) > 0.6 for d in gone)  # clean documents stay
            stay = sorted(d for d in kept if d is not None)
            assert sum(like(a, b) >= 0.85 for n, a in enumerate(stay) for b in stay[:n]) == 0
        elif name == "decontaminate":
            fold = lambda t: " ".join((t or "").lower().split())
            holds = {r.doc_id for r in before if any(fold(i) in fold(r.text) for i in items)}
            assert not holds & kept and {r.doc_id for r in before} - kept <= holds
        else:
            assert kept == {r.doc_id for r in before} and all(0 <= r.taken <= 3 * r.size for r in after)
            by = defaultdict(lambda: [0, 0.0])
            for r in after:
                by[r.source][0] += r.taken
                by[r.source][1] = r.target
            assert all(abs(got - want) < 64 for got, want in by.values())
        before = after


def test_rows_go_whether_broadcast_or_not(spark, tables, monkeypatch):
    docs = spark.read.parquet(f"{tables}/documents.parquet").selectExpr("*", "1 AS gone_id", "2 AS gone_hash", "3 AS gone_row")  # names that clash
    for stage in (cp.stage_near_dedup, cp.stage_decontaminate):
        found = []
        for most in (10**6, 0):
            monkeypatch.setattr(cp, "BROADCAST_ROWS", most)
            out = stage(spark, docs, tables)
            assert out.columns == docs.columns
            found.append(sorted(map(str, out.select("doc_id", "text", "gone_row").collect())))
        assert found[0] == found[1] and len(found[0]) < docs.count()


def test_run_and_empty_tables(spark, tables, tmp_path):
    assert cp.run(spark, tables).columns[:2] == ["doc_id", "source"]
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0

"""URL filters: a trie over reversed host labels, then path segments; the longest rule that fits decides.

A rule is (host, path, verdict). It fits a URL whose host is the rule's or a subdomain of it and whose
path starts with the rule's path, code point by code point. Of the rules that fit, the one with the most
host labels wins, then the one with the longest path, then `allow` over `block`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named

#: Rules whose texts are larger than this, in bytes, are joined and not broadcast.
BROADCAST_BYTES = 32 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or the end. Both empty where there is no `://`."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"\A[^/?#]*+([^?#]*+)", 1)


class RuleTrie:
    """Host labels from the last to the first, then whole path segments. A path node holds the tails of its rules: what comes after a rule's last slash, the start of the next segment."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]) -> None:
        self.labels: list[dict[str, int]] = [{}]
        self.paths: list[int] = [-1]  # of each host node: the root of its paths
        self.segments: list[dict[str, int]] = []
        self.tails: list[dict[str, str]] = []
        self.lengths: list[list[int]] = []  # of the tails, the longest first
        for host, path, verdict in rules:
            node = 0
            for label in reversed(host.split(".")) if host else ():
                if label not in self.labels[node]:
                    self.labels[node][label] = len(self.labels)
                    self.labels.append({})
                    self.paths.append(-1)
                node = self.labels[node][label]
            if self.paths[node] < 0:
                self.paths[node] = self._path_node()
            node = self.paths[node]
            *whole, tail = path.split("/")
            for segment in whole:
                if segment not in self.segments[node]:
                    self.segments[node][segment] = self._path_node()
                node = self.segments[node][segment]
            if self.tails[node].get(tail) != "allow":
                self.tails[node][tail] = verdict
            self.lengths[node] = sorted({*self.lengths[node], len(tail)}, reverse=True)

    def _path_node(self) -> int:
        self.segments.append({})
        self.tails.append({})
        self.lengths.append([])
        return len(self.segments) - 1

    def _longest(self, node: int, segments: list[str]) -> tuple[int, str] | None:
        """(code points of the rule's path, verdict) below a root of paths."""
        found, depth = None, 0
        for at, segment in enumerate(segments):
            for length in self.lengths[node]:
                if (verdict := self.tails[node].get(segment[:length])) is not None and len(segment) >= length:
                    found = depth + length, verdict
                    break
            if at + 1 == len(segments) or (node := self.segments[node].get(segment, -1)) < 0:
                break
            depth += len(segment) + 1
        return found

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(the rule's host and path, its verdict), or None where no rule fits."""
        labels, segments = host.split(".") if host else [], path.split("/")
        node, found = 0, None
        for k in range(len(labels) + 1):
            if self.paths[node] >= 0 and (hit := self._longest(self.paths[node], segments)):
                found = ".".join(labels[len(labels) - k :]) + path[: hit[0]], hit[1]
            if k == len(labels) or (node := self.labels[node].get(labels[-1 - k], -1)) < 0:
                break
        return found


_tries: dict[int, RuleTrie] = {}


def _by_trie(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """A pass over the rows, no shuffle: the trie is built once in each worker."""
    shared = urls.sparkSession.sparkContext.broadcast([tuple(r) for r in rules.collect()])
    number = shared._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if number not in _tries:
            _tries.clear()
            _tries[number] = RuleTrie(shared.value)
        trie = _tries[number]
        for batch in batches:
            hits = [trie.match(h.decode(errors="surrogateescape"), p.decode(errors="surrogateescape")) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            rule = pa.array([hit and hit[0].encode(errors="surrogateescape") for hit in hits], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, pa.array([hit and hit[1] for hit in hits], pa.string())], names=["page_id", "host", "path", "rule", "found"])

    binary = urls.select("page_id", F.col("host").cast("binary"), F.col("path").cast("binary"))
    out = binary.mapInArrow(run, "page_id long, host binary, path binary, rule binary, found string")
    return out.select("page_id", *(F.col(c).cast("string").alias(c) for c in ("host", "path", "rule")), "found")


def _by_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """For rules of any number: each distinct host and path lists the trie nodes on its way, and equi-joins the rules that hang there.

    No way is longer than the deepest rule, so long URLs don't list more than rules can match.
    """
    text = F.concat(F.col("host"), F.col("path"))
    tail = F.substring_index("path", "/", -1)
    keyed = rules.select(F.col("host").alias("at_host"), F.substr("path", F.lit(1), F.length("path") - F.length(tail)).alias("at_path"), tail.alias("tail"), F.length("path").alias("long"), text.alias("rule"), F.col("verdict").alias("found"))
    deep = rules.agg(F.max(F.size(F.split("path", "/"))).alias("deep"), F.max(F.size(F.split("host", "\\."))).alias("wide")).first()
    labels = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.split("host", "\\."))
    most = F.least(F.size(labels), F.lit(deep.wide or 0))
    ways = urls.select("host", "path").distinct()
    ways = ways.withColumn("labels", labels).withColumn("n", F.explode(F.sequence(F.lit(0), most)))
    ways = ways.withColumn("at_host", F.array_join(F.slice("labels", F.size("labels") - F.col("n") + 1, F.col("n")), ".")).withColumn("segments", F.split("path", "/"))
    ways = ways.withColumn("depth", F.explode(F.sequence(F.lit(0), F.least(F.size("segments") - 1, F.lit(max((deep.deep or 1) - 1, 0))))))
    ways = ways.withColumn("at_path", F.when(F.col("depth") == 0, "").otherwise(F.concat(F.array_join(F.slice("segments", F.lit(1), F.col("depth")), "/"), F.lit("/")))).withColumn("next", F.element_at("segments", F.col("depth") + 1))
    hits = ways.join(keyed, ["at_host", "at_path"]).filter(F.startswith("next", F.col("tail")))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "found"), F.struct("n", "long", F.col("found") == "allow")).alias("b"))
    return urls.join(best, ["host", "path"], "left").select("page_id", "host", "path", "b.rule", "b.found")


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", id_col: str = "page_id", url_col: str = "url", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, host, path, rule, verdict): a row per row of pages, repeated rows included.

    rules: host, path, verdict ('allow' or 'block'); nulls are empty. A rule with an empty host is for
    all hosts. Where no rule fits, rule is null and the verdict is `otherwise`; a null URL, or one
    without `://`, has an empty host and path. Without rules all pages get `otherwise`. Extra columns
    of either table are ignored. Rules are broadcast as a trie while their texts, measured first, are
    within broadcast_bytes; beyond it distinct hosts and paths are joined with them.
    """
    host, path = host_and_path(named(pages, url_col))
    urls = pages.select(named(pages, id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    fill = lambda c: F.coalesce(named(rules, c), F.lit(""))
    rules = rules.select(F.translate(fill("host"), _UPPER, _LOWER).alias("host"), fill("path").alias("path"), fill("verdict").alias("verdict"))
    size = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 16)).first()[0] or 0
    found = _by_trie(urls, rules) if size <= broadcast_bytes else _by_join(urls, rules)
    return found.select("page_id", "host", "path", "rule", F.coalesce("found", F.lit(otherwise)).alias("verdict"))

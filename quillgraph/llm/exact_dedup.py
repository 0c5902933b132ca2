"""Exact dedup by Patricia-trie owners.

Texts fall into partitions by length and content hash. A partition's full byte strings go into a
compressed radix trie; the terminal node of a string holds the row that stays and the number of
rows. It happens twice: in each task over the rows it reads, before any shuffle (so a text with a
billion copies leaves each task once), then over the terminals of equal length and hash.
"""

from __future__ import annotations

import contextlib
import hashlib
import os
import pickle
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import WHITE, materialize, named, small_batches, text_bytes

#: Bytes of labels one task's trie may hold before its heaviest subtree is spilled.
TRIE_BYTES = 48 << 20


@dataclass(slots=True)
class Node:
    """A node of a compressed radix trie: children by first byte, each with its edge label."""

    children: dict[int, list] = field(default_factory=dict)  # byte -> [label, Node]
    owner: Any = None


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by bisection on slices."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


#: Weight of one member or row that a terminal node holds, in bytes.
MEMBER_BYTES = 16


class PatriciaTrie:
    """Byte strings -> owners. `weight` counts label bytes and what owners hold, as told by `held`."""

    def __init__(self, held: Callable[[Any], int] = lambda owner: 0) -> None:
        self.root, self.weight, self.held = Node(), 0, held

    def terminal(self, key: bytes) -> Node:
        """The terminal node of a key, which is inserted if it is new."""
        node, at = self.root, 0
        while at < len(key):
            edge = node.children.get(key[at])
            if edge is None:
                node.children[key[at]] = [key[at:], leaf := Node()]
                self.weight += len(key) - at
                return leaf
            label = edge[0]
            if key.startswith(label, at):
                node, at = edge[1], at + len(label)
                continue
            cut = _shared(label, key[at : at + len(label)])
            fork = Node({label[cut]: [label[cut:], edge[1]]})
            edge[0], edge[1] = label[:cut], fork
            node, at = fork, at + cut
        return node

    def owners(self, node: Node | None = None) -> Iterator[Any]:
        stack = [node or self.root]
        while stack:
            node = stack.pop()
            if node.owner is not None:
                yield node.owner
            stack += [child for _, child in node.children.values()]

    def items(self, node: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, Any]]:
        stack = [(node or self.root, prefix)]
        while stack:
            node, prefix = stack.pop()
            if node.owner is not None:
                yield prefix, node.owner
            stack += [(child, prefix + label) for label, child in node.children.values()]

    def cut_heaviest(self) -> tuple[bytes, Node] | None:
        """Take the heaviest subtree below the first fork out of the trie, or that fork's own owner if it weighs more: (its prefix, a node)."""
        node, prefix = self.root, b""
        while node.owner is None and len(node.children) == 1:
            (label, child), = node.children.values()
            if child.owner is not None and not child.children:
                break  # a single string: it is the subtree
            node, prefix = child, prefix + label
        weights = {b: len(label) + self._below(child) for b, (label, child) in node.children.items()}
        own = self.held(node.owner) if node.owner is not None else -1
        if not weights and own < 0:
            return None
        heaviest = max(weights, key=lambda b: (weights[b], b), default=None)
        if heaviest is None or own > weights[heaviest]:
            out, node.owner = Node(owner=node.owner), None
            self.weight -= own
            return prefix, out
        label, out = node.children.pop(heaviest)
        self.weight -= weights[heaviest]
        return prefix + label, out

    def _below(self, node: Node) -> int:
        total, stack = 0, [node]
        while stack:
            node = stack.pop()
            total += self.held(node.owner) if node.owner is not None else 0
            for label, child in node.children.values():
                total += len(label)
                stack.append(child)
        return total


def normalised(text: bytes) -> bytes:
    return text.translate(None, WHITE)


def _rank(points: int, doc_id: int | None) -> tuple:
    """Sorts rows of equal text: most code points first, then smallest id; no id comes last."""
    return (-points, doc_id is None, doc_id or 0)


def _held(value: Any) -> int:
    """About the bytes that a carried value holds."""
    if isinstance(value, str | bytes):
        return 56 + len(value)
    if isinstance(value, dict):
        return 64 + sum(_held(k) + _held(v) for k, v in value.items())
    return 56 + sum(map(_held, value)) if isinstance(value, list | tuple) else 32


def _local_terminals(schema: T.StructType, payload: list[str], with_key: bool):
    """Rows -> a row for each distinct text of the task (or more, where a subtree was spilled). The trie's labels are the only copy of a text, unless it is carried along."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # an owner: length, hash, weight of what is carried, code points, id and place of the best row, ids, digest, carried values
        trie, made = PatriciaTrie(lambda own: MEMBER_BYTES * len(own[6]) + own[2]), 0
        part = _task_number()

        def rows(found: Iterator[tuple[bytes, list]]) -> Iterator[pa.RecordBatch]:
            nonlocal made
            held: list[list] = []
            size = 0
            for key, own in found:
                held.append([part * (1 << 40) + made, *own[:2], key if with_key else None, *own[3:]])
                made += 1
                size += len(key) * with_key + own[2] + 16 * len(own[6])
                if size > 8 << 20:
                    yield _columns(held)
                    held, size = [], 0
            if held:
                yield _columns(held)

        def _columns(held: list[list]) -> pa.RecordBatch:
            cols = list(zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        for batch in small_batches(batches):
            ids, texts, points = (batch.column(k).to_pylist() for k in range(3))
            extra = [batch.column(3 + k).to_pylist() for k in range(len(payload))]
            for i, text in enumerate(texts):
                key = normalised(text)
                node = trie.terminal(key)
                own = node.owner
                if own is None:
                    digest = hashlib.sha256(key).hexdigest()
                    signed = xxhash.xxh64_intdigest(key)
                    own = node.owner = [len(key), signed - (1 << 64) if signed >> 63 else signed, 0, points[i], ids[i], 0, [], digest, *(c[i] for c in extra)]
                    own[2] = sum(map(_held, own[8:]))
                    trie.weight += own[2]
                elif _rank(points[i], ids[i]) < _rank(own[3], own[4]):
                    own[3:6] = points[i], ids[i], len(own[6])
                    own[8:] = [c[i] for c in extra]
                    trie.weight -= own[2]
                    own[2] = sum(map(_held, own[8:]))
                    trie.weight += own[2]
                own[6].append(ids[i])
                trie.weight += MEMBER_BYTES
                while trie.weight > TRIE_BYTES and (cut := trie.cut_heaviest()):
                    yield from rows(trie.items(cut[1], cut[0]))
        yield from rows(trie.items())

    return run


def _task_number() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _spill_file():
    """An unnamed file in the executor's own Spark folder, where a shuffle spills too: it ends with its task, and a task that is run again writes its own."""
    folders = os.environ.get("SPARK_LOCAL_DIRS")
    return tempfile.TemporaryFile(dir=folders.split(",")[0] if folders else None)


class _Merger:
    """One partition key's trie; subtrees beyond the budget go to unnamed files of the task and are merged afterwards, in the same way."""

    def __init__(self, budget: int | None = None) -> None:
        self.budget, self.spilled = TRIE_BYTES if budget is None else budget, {}
        self.trie = PatriciaTrie(lambda rows: 4 * MEMBER_BYTES * len(rows))

    def add(self, key: bytes, row: tuple) -> None:
        for prefix, file in self.spilled.items():
            if key.startswith(prefix):
                pickle.dump((key, row), file)
                return
        node = self.trie.terminal(key)
        if node.owner is None:
            node.owner = []
        node.owner.append(row)
        self.trie.weight += 4 * MEMBER_BYTES
        if self.trie.weight > self.budget:
            self._spill()

    def _spill(self) -> None:
        """A subtree of a single string, which is one group, stays."""
        prefix, subtree = self.trie.cut_heaviest()
        if not subtree.children:
            self.trie.weight += self.trie.held(subtree.owner)
            self.trie.terminal(prefix).owner = subtree.owner
            return
        self.spilled[prefix] = _spill_file()
        for key, rows in self.trie.items(subtree, prefix):
            for row in rows:
                pickle.dump((key, row), self.spilled[prefix])

    def groups(self) -> Iterator[list[tuple]]:
        yield from self.trie.owners()
        for file in self.spilled.values():
            file.seek(0)
            again = _Merger(self.budget)
            with contextlib.suppress(EOFError):
                while True:
                    again.add(*pickle.load(file))
            file.close()
            yield from again.groups()


def _merge_terminals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terminals sorted by length and hash -> (terminal, keep_terminal, keep_id, group_size)."""
    held: list[tuple] = []
    at, merger = None, None

    def results(merger: _Merger) -> Iterator[tuple]:
        for rows in merger.groups():
            best = min(rows, key=lambda r: (*_rank(r[1], r[2]), r[0]))
            size = sum(r[3] for r in rows)
            yield from ((r[0], best[0], best[2], size) for r in rows)

    def out() -> pa.RecordBatch:
        cols = list(zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in cols], names=["terminal", "keep_terminal", "keep_id", "group_size"])

    for batch in batches:
        for terminal, length, digest, key, points, best, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (length, digest) != at:
                if merger:
                    held += results(merger)
                at, merger = (length, digest), _Merger()
            merger.add(normalised(key), (terminal, points, best, count))
        if len(held) > 10_000:
            yield out()
            held = []
    if merger:
        held += results(merger)
    if held:
        yield out()


@dataclass
class ExactDedup:
    """terminals: a row for each distinct text of each task; merged: what became of those that met others."""

    terminals: DataFrame
    merged: DataFrame
    carry: list[str]

    def _joined(self) -> DataFrame:
        return self.terminals.join(self.merged, "terminal", "left")

    def rows(self) -> DataFrame:
        """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
        own = F.col("keep_terminal").isNull() | (F.col("keep_terminal") == F.col("terminal"))
        return (
            self._joined()
            .select(F.posexplode("members").alias("at", "doc_id"), F.when(F.col("keep_terminal").isNull(), F.col("best_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.size("members").cast("long")).alias("group_size"), own.alias("own"), "best_at", "text_sha256")
            .select("doc_id", "keep_id", "group_size", (F.col("own") & (F.col("at") == F.col("best_at"))).alias("kept"), "text_sha256")
        )

    def kept(self) -> DataFrame:
        """The rows that stay, with the columns that were carried along."""
        stays = self._joined().filter("keep_terminal IS NULL OR keep_terminal = terminal")
        return stays.select([F.col(f"carried_{k}").alias(c) for k, c in enumerate(self.carry)])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> ExactDedup:
    """Group rows whose texts are identical after deleting ASCII white space; the longest original, then the smallest id stays.

    Null and empty texts are equal. Rows that repeat an id and a text are copies like any others and
    exactly one row of a group stays. A row without an id loses ties. An empty table gives empty
    results; `carry` names columns (of any names) that the kept rows bring along.

    Cost: one pass over the texts; the distinct texts of each task are written once to the shared
    folder; only texts whose length and hash occur in more than one terminal are shuffled.
    """
    carry = carry or []
    fields = [
        ("terminal", T.LongType()), ("key_length", T.LongType()), ("key_hash", T.LongType()), ("key", T.BinaryType()), ("points", T.LongType()), ("best_id", T.LongType()),
        ("best_at", T.IntegerType()), ("members", T.ArrayType(T.LongType())), ("text_sha256", T.StringType()),
    ]
    schema = T.StructType([T.StructField(n, t) for n, t in fields] + [T.StructField(f"carried_{k}", docs.schema[c].dataType) for k, c in enumerate(carry)])
    source = docs.select(named(docs, id_col).cast("long").alias("id"), text_bytes(docs, text_col).alias("t"), F.char_length(F.coalesce(named(docs, text_col), F.lit(""))).cast("long").alias("points"), *(named(docs, c).alias(f"c{k}") for k, c in enumerate(carry)))
    # A carried text stands for its normalised form, so no text is stored twice.
    text = text_bytes if text_col in carry else None
    local = source.mapInArrow(_local_terminals(schema, carry, text is None), schema)
    terminals = materialize(local, "terminals")
    keys = terminals.groupBy("key_length", "key_hash").agg(F.count("*").alias("n")).filter("n > 1").select("key_length", "key_hash")
    key = F.col("key") if text is None else text(terminals, f"carried_{carry.index(text_col)}").alias("key")
    meet = terminals.select("terminal", "key_length", "key_hash", key, "points", "best_id", F.size("members").cast("long").alias("count")).join(keys, ["key_length", "key_hash"])
    meet = meet.select("terminal", "key_length", "key_hash", "key", "points", "best_id", "count")
    merged = meet.repartition("key_length", "key_hash").sortWithinPartitions("key_length", "key_hash").mapInArrow(_merge_terminals, "terminal long, keep_terminal long, keep_id long, group_size long")
    return ExactDedup(terminals, merged, carry)

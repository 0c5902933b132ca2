"""Fill-in-the-middle transformation on ropes.

A text is a rope: a balanced tree whose leaves hold up to LEAF_UNITS units (words with the white space
before them) and whose nodes cache the number of units and code points below. Splitting at two unit
ranks walks down twice and builds a few nodes; the parts are concatenated with sentinels in another
order. Splitting the result's rope at code-point ranks and concatenating the parts in the first order
is the inverse.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named, small_batches, text_bytes

#: Prefix, suffix and middle sentinels.
P, S, M = "<P>", "<S>", "<M>"
LEAF_UNITS = 128
_UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
_UNITS = re.compile(_UNIT)
_LEAF = re.compile(f"(?:{_UNIT}){{1,{LEAF_UNITS}}}")


@dataclass(slots=True, frozen=True)
class Rope:
    """A leaf (text) or a node (left, right), with the units and code points below it."""

    units: int
    points: int
    text: str = ""
    left: Rope | None = None
    right: Rope | None = None


EMPTY = Rope(0, 0)


def leaf(text: str) -> Rope:
    return Rope(len(_UNITS.findall(text)), len(text), text) if text else EMPTY


def join(left: Rope, right: Rope) -> Rope:
    """The concatenation; both stay as they are."""
    if not left.points or not right.points:
        return right if not left.points else left
    return Rope(left.units + right.units, left.points + right.points, "", left, right)


def rope(text: str) -> Rope:
    """A balanced rope over a whole text; leaves end where units end."""
    level = [leaf(m[0]) for m in _LEAF.finditer(text)] or [EMPTY]
    while len(level) > 1:
        level = [join(level[k], level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def split(tree: Rope, rank: int, by_units: bool = True) -> tuple[Rope, Rope]:
    """The first `rank` units (or code points) and the rest. Down the tree and up again: no recursion, whatever the depth."""
    left, right, above = EMPTY, EMPTY, []
    while tree.left is not None:
        below = tree.left.units if by_units else tree.left.points
        above.append((tree, rank < below))
        tree, rank = (tree.left, rank) if rank < below else (tree.right, rank - below)
    at = rank
    if by_units:  # the place in the leaf's text where the unit ends
        at = 0
        for _, m in zip(range(rank), _UNITS.finditer(tree.text), strict=False):
            at = m.end()
    left, right = leaf(tree.text[:at]), leaf(tree.text[at:])
    for node, was_left in reversed(above):
        left, right = (left, join(right, node.right)) if was_left else (join(node.left, left), right)
    return left, right


def flat(tree: Rope) -> str:
    """The text of a rope."""
    out, todo = [], [tree]
    while todo:
        node = todo.pop()
        if node.left is None:
            out.append(node.text)
        else:
            todo += (node.right, node.left)
    return "".join(out)


def rearranged(tree: Rope, first: int, second: int, form: str) -> tuple[Rope, int, int]:
    """The rope of the output, and the code points of prefix and middle; the middle lies between unit ranks first and second."""
    head, suffix = split(tree, second)
    prefix, middle = split(head, first)
    parts = (Rope(1, len(P), P), prefix, Rope(1, len(S), S), suffix) if form == "psm" else (Rope(1, len(S), S), suffix, Rope(1, len(P), P), prefix)
    out = EMPTY
    for part in (*parts, Rope(1, len(M), M), middle):
        out = join(out, part)
    return out, prefix.points, middle.points


def restored(output: str, form: str) -> str:
    """The text that output was made from: its rope, split where the sentinels begin and end.

    No text with a sentinel in it is rearranged, and sentinels can't overlap, so each is found once.
    """
    if form == "plain":
        return output
    marks, parts, tree, done = ((P, S, M) if form == "psm" else (S, P, M)), {}, rope(output), 0
    for mark, after in zip(marks, (*marks[1:], None), strict=True):
        _, tree = split(tree, len(mark), by_units=False)
        done += len(mark)
        end = len(output) if after is None else output.index(after, done)
        parts[mark], tree = split(tree, end - done, by_units=False)
        done = end
    return flat(join(join(parts[P], parts[M]), parts[S]))


def plan(doc_id: Column, seed: int = 42) -> list[Column]:
    """h1 to h4: the first four 32-bit numbers of the SHA-256 of `seed:doc_id`; a null id is written as nothing."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, restored): a row per row.

    A text of n units is cut at ranks h1 % (n + 1) and h2 % (n + 1). `rate` of 100 texts are rearranged,
    `spm` of 100 of these suffix first; texts that are empty or hold a sentinel stay plain (lengths
    null). `restored` is read back from output and form alone. Null texts are empty; rows that repeat
    an id are cut alike. Bytes that aren't UTF-8 count as a code point each and come back as they were.
    A pass over the rows without a shuffle: a worker holds a few texts at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 64):
            ids, texts, *hashes = (c.to_pylist() if k else c for k, c in enumerate(batch.columns))
            rows = []
            for raw, h1, h2, h3, h4 in zip(texts, *hashes, strict=True):
                text = raw.decode(errors="surrogateescape")
                if not text or h3 % 100 >= rate or P in text or S in text or M in text:
                    rows.append((len(_UNITS.findall(text)), "plain", None, None, raw, raw))
                    continue
                tree, form = rope(text), "spm" if h4 % 100 < spm else "psm"
                first, second = sorted((h1 % (tree.units + 1), h2 % (tree.units + 1)))
                result, prefix, middle = rearranged(tree, first, second, form)
                output = flat(result)
                rows.append((tree.units, form, prefix, middle, output.encode(errors="surrogateescape"), restored(output, form).encode(errors="surrogateescape")))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"])

    doc_id = named(docs, id_col).cast("long")
    found = docs.select(doc_id.alias("doc_id"), text_bytes(docs, text_col).alias("t"), *plan(doc_id, seed)).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary, restored binary")
    return found.withColumns({c: F.col(c).cast("string") for c in ("output", "restored")})

"""SimHash near-dedup: fingerprints, pigeonhole blocks, Hamming verification, components.

Two layouts of blocks share all the code. `exact_layout` covers every pair of 64-bit fingerprints
that differ in at most two bits: eight blocks of eight bits, of which two close fingerprints agree
on six at least, so each fingerprint has C(8, 6) = 28 keys and a key is shared by at most 2**16
distinct fingerprints. `wide_layout` serves a similarity of shingle sets, the cosine that SimHash
estimates: a wide fingerprint is split into as many blocks as a pair at the threshold needs to agree
on one with the wanted recall, and what the blocks propose is decided on the shingle sets themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, named, runs, scratch, small_batches, text_bytes, text_hash
from .components import connected_components

_LANES = np.uint64(0x0101010101010101)
_BIG_ENDIAN = ">u8"  # of words in binary columns, so that hex() prints them
#: Shingles hashed and counted at once; longer texts go through in pieces.
PIECE = 8192
#: Links that one task's union-find may know before it starts afresh.
FOREST_NODES = 500_000
#: Fingerprints of one bucket that a task takes; larger buckets are dealt to pieces that meet two by two.
BUCKET_ROWS = 1 << 17
#: Documents, and shingles, of one tree of proposals that a task compares; larger trees are dealt to several tasks.
CHUNK_NODES, CHUNK_SHINGLES = 512, 1 << 19
#: Documents of such a tree that all its tasks get, about; they tie its tasks' results together.
HUBS = 16


@dataclass(frozen=True)
class Layout:
    """words: 64-bit words of a fingerprint; verify: words that are compared; max_bits: most bits of these that may differ."""

    words: int
    verify: int
    max_bits: int
    block_bits: int = 0
    blocks: int = 0

    def keys(self, fps: np.ndarray) -> np.ndarray:
        """Fingerprints (n, words) -> keys (n, number of keys) as signed 64-bit numbers."""
        if not self.block_bits:
            masks = [sum(0xFF << 8 * b for b in kept) for kept in combinations(range(8), 8 - self.max_bits)]
            out = np.stack([mix64((fps[:, 0] & np.uint64(m)) ^ mix64(np.uint64(k + 1))) for k, m in enumerate(masks)], axis=1)
            return out.view(np.int64)
        bits = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little")[:, : self.block_bits * self.blocks]
        weights = np.uint64(1) << np.arange(self.block_bits, dtype=np.uint64)
        values = (bits.reshape(len(fps), self.blocks, self.block_bits) * weights).sum(axis=2, dtype=np.uint64)
        return mix64(values | (np.arange(1, self.blocks + 1, dtype=np.uint64) << np.uint64(40))).view(np.int64)


def exact_layout(max_bits: int = 2) -> Layout:
    if not 0 <= max_bits < 8:
        raise ValueError("eight blocks cover 0 to 7 differing bits")
    return Layout(1, 1, max_bits)


def wide_layout(n_docs: int, similarity: float = 0.8, recall: float = 0.99, verify_words: int = 4) -> Layout:
    """Blocks so wide that some 32 unrelated documents share a bucket, at every size; comparing these costs about what their rows do.

    Sets of cosine similarity s disagree on a bit with probability acos(s) / pi. Of pairs at the
    threshold the compared bits pass all but those beyond three standard errors.
    """
    flip = math.acos(similarity) / math.pi
    bits = max(8, math.ceil(math.log2(max(n_docs, 2))) - 5)
    compared = 64 * verify_words
    passed = min(0.99865, (1 + recall) / 2)
    blocks = math.ceil(math.log(1 - recall / passed) / math.log(1 - (1 - flip) ** bits))
    slack = 3 * math.sqrt(flip * (1 - flip) / compared)
    return Layout(max(verify_words, math.ceil(bits * blocks / 64)), verify_words, math.floor(compared * (flip + slack)), bits, blocks)


def _bit_counts(h: np.ndarray, words: int) -> np.ndarray:
    """How often each of 64 * words bits is set among hashes; words after the first are mixed from the first."""
    n = len(h)
    rows = -(-n // 255)
    padded = np.zeros((words, rows * 255), np.uint64)
    padded[0, :n] = h
    for w in range(1, words):
        padded[w, :n] = mix64(h + np.uint64(w * 0x9E3779B97F4A7C15 % 2**64))
    out = np.empty((words, 8, 8), np.int64)  # word, byte, bit
    for bit in range(8):
        lanes = ((padded >> np.uint64(bit)) & _LANES).reshape(words, rows, 255).sum(axis=2)
        out[:, :, bit] = lanes.view(np.uint8).reshape(words, rows, 8).sum(axis=1, dtype=np.int64)
    return out.reshape(words, 64)


def _shingle_hashes(text: bytes, shingle: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of a text's shingles, a piece at a time; a text under a shingle's length is one shingle, one without words none."""
    tokens = text.lower().split()
    if not tokens:
        return
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, max(1, len(tokens) - shingle + 1), PIECE):
        piece = tokens[at : at + PIECE + shingle - 1]
        grams = map(join, zip(*(piece[k:] for k in range(shingle)), strict=False)) if len(tokens) >= shingle else [join(tokens)]
        yield np.array([digest(g, seed) for g in grams], dtype=np.uint64)


def shingle_set(text: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """The distinct hashes of a whole text's shingles, sorted."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *_shingle_hashes(text, shingle, seed)]))


def fingerprint(text: bytes, shingle: int, words: int = 1, seed: int = 42, distinct: bool = False) -> np.ndarray:
    """The SimHash of a text: a bit is 1 if it is set in over half the shingles' XXH64; distinct: each shingle counts once. No words: zero."""
    counts, n = np.zeros((words, 64), np.int64), 0
    if distinct:
        own = shingle_set(text, shingle, seed)
        pieces = (own[at : at + PIECE] for at in range(0, len(own), PIECE))
    else:
        pieces = _shingle_hashes(text, shingle, seed)
    for hashes in pieces:
        counts += _bit_counts(hashes, words)
        n += len(hashes)
    bits = (2 * counts > n).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, shingle: int, words: int = 1, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", distinct: bool = False) -> DataFrame:
    """(doc_id, hash, fp binary): one row per row of docs; words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; null texts have no words.

    hash is text_hash(text), which tells rows that repeat an id apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            fps = [fingerprint(t, shingle, words, seed, distinct).astype(_BIG_ENDIAN).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.binary())], names=["doc_id", "hash", "fp"])

    source = docs.select(named(docs, id_col).cast("long").alias("doc_id"), text_hash(named(docs, text_col)).alias("hash"), text_bytes(docs, text_col).alias("t"))
    return source.mapInArrow(run, "doc_id long, hash long, fp binary")


def _as_words(column: pa.Array) -> np.ndarray:
    flat = b"".join(column.to_pylist())
    return np.frombuffer(flat, _BIG_ENDIAN).astype(np.uint64).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.uint64)


def _keyed(layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                fps = _as_words(part.column(1))
                keys = layout.keys(fps)
                n, m = keys.shape
                kept = np.repeat(np.ascontiguousarray(fps[:, : layout.verify]), m, axis=0)
                binary = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * layout.verify), n * m, [None, pa.py_buffer(kept.astype(_BIG_ENDIAN).tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), m)), binary], names=["key", "id", "fp"])

    return run


class Forest:
    """Union-find over the links of one task: only links that join two of its trees are passed on."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x], x = root, up
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _bucket_links(ids: np.ndarray, fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the close pairs in one bucket: walk from each fingerprint to those not reached yet."""
    left = np.arange(len(ids))
    out: list[tuple[int, int]] = []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            here = frontier.pop()
            near = _distance(fps[left], fps[here]) <= max_bits
            hit = left[near]
            out += [(int(ids[here]), int(ids[x])) for x in hit]
            frontier += hit.tolist()
            left = left[~near]
    return out


def _link_table(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(found, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1]), pa.nulls(len(a), pa.binary())], names=["a", "b", "fp"])


def _linked(layout: Layout, split: bool):
    """Rows (key, id, fp) sorted by key -> links (a, b, null) of each bucket, verified; split: rows (id, key, fp) of a bucket that is too large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()

        def links(keys: np.ndarray, ids: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
            nonlocal forest
            out: list[tuple[int, int]] = []
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            for size in range(2, 33):  # most buckets: all pairs at once over all buckets of a size
                first = starts[sizes == size]
                for i, j in combinations(range(size), 2) if len(first) else ():
                    near = _distance(fps[first + i], fps[first + j]) <= layout.max_bits
                    if near.any():
                        out += zip(ids[first + i][near].tolist(), ids[first + j][near].tolist(), strict=True)
            for first, size in zip(starts[sizes > 32].tolist(), sizes[sizes > 32].tolist(), strict=True):
                out += _bucket_links(ids[first : first + size], fps[first : first + size], layout.max_bits)
            if len(forest.parent) > FOREST_NODES:
                forest = Forest()
            return [x for x in out if forest.join(*x)]

        for parts, cut in runs(batches, BUCKET_ROWS if split else 1 << 62):
            if cut:
                for part in parts:
                    yield pa.RecordBatch.from_arrays([part.column(1), part.column(0), part.column(2)], names=["a", "b", "fp"])
                continue
            found = links(*(np.concatenate(x) for x in zip(*((p.column(0).to_numpy(), p.column(1).to_numpy(), _as_words(p.column(2))) for p in parts), strict=True)))
            if found:
                yield _link_table(found)

    return run


def _pairs_of_pieces(large: DataFrame) -> DataFrame:
    """Rows (id, key, fp) of large buckets -> (key, id, fp) with a key for each two pieces of a bucket, so that any two of its rows meet.

    A bucket of n rows is dealt to p = n / BUCKET_ROWS pieces, and a row goes with each of them: no task holds more than about two pieces, no pair is lost.
    """
    sizes = large.groupBy("b").agg(F.ceil(F.count("*") / BUCKET_ROWS).cast("long").alias("pieces"))
    own = F.pmod(F.xxhash64("a"), F.col("pieces"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("pieces") - 1, F.lit(0))))
    dealt = large.join(sizes, "b").select(F.col("b").alias("bucket"), F.col("a").alias("id"), "fp", own.alias("own"), other.alias("other"))
    return dealt.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "id", "fp")


def _merged_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of several tasks -> those that one forest needs."""
    forest = Forest()
    for batch in batches:
        if len(forest.parent) > FOREST_NODES:
            forest = Forest()
        kept = [x for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if forest.join(*x)]
        if kept:
            yield _link_table(kept).select(["a", "b"])


def link_fingerprints(reps: DataFrame, layout: Layout) -> DataFrame:
    """Distinct fingerprints (doc_id, fp) -> links (a, b) that connect all that are close and share a block.

    A bucket of more than BUCKET_ROWS fingerprints, which only the wide layout can have, is dealt to
    pieces of which every two meet in a task, so no task holds it whole and no pair of it is missed.
    """
    schema = "a long, b long, fp binary"
    keyed = reps.filter("doc_id IS NOT NULL").select("doc_id", "fp").mapInArrow(_keyed(layout), "key long, id long, fp binary")
    wide = bool(layout.block_bits)
    linked = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_linked(layout, wide), schema)
    if not wide:
        return linked.select("a", "b")
    linked = materialize(linked, "proposed")
    links, large = linked.filter("fp IS NULL").select("a", "b"), linked.filter("fp IS NOT NULL")
    if not large.isEmpty():
        again = _pairs_of_pieces(large).repartition("key").sortWithinPartitions("key")
        links = links.unionByName(again.mapInArrow(_linked(layout, False), schema).select("a", "b"))
    few = max(1, int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 16)
    return links.repartition(few).mapInArrow(_merged_forests, "a long, b long")


def _nodes(own: DataFrame) -> DataFrame:
    """(node, fp, best): a numbered row for each distinct fingerprint; best is its row with the smallest id (those without one last), then hash."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "hash")).alias("best")
    return materialize(own.groupBy("fp").agg(best).select(F.monotonically_increasing_id().alias("node"), "fp", "best"), "nodes")


def _placed(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(fp, head): of each distinct fingerprint the first row of what the links connect it with."""
    found = connected_components(links)
    firsts = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct()).join(nodes, "node").groupBy("component").agg(F.min("best").alias("head"))
    # Tables of their own, so that both sides of each last join are plain exchanges, of which a hot key's is split.
    firsts = materialize(firsts, "heads")
    placed = nodes.join(found, "node", "left").select("fp", "best", F.coalesce("component", "node").alias("component"))
    return materialize(placed.join(firsts, "component", "left").select("fp", F.coalesce("head", "best").alias("head")), "placed")


def _as_components(own: DataFrame, placed: DataFrame) -> DataFrame:
    """(doc_id, hash, fp, component_id, kept), a row for each of own."""
    kept = F.col("head.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("head.hash") == F.col("hash"))
    return own.join(placed, "fp").select("doc_id", "hash", "fp", F.col("head.doc_id").alias("component_id"), kept.alias("kept"))


def simhash_components(docs: DataFrame, shingle: int, layout: Layout, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, hash, fp, component_id, kept): component_id is the smallest id reachable over links, the row's own included.

    Rows of equal fingerprint are one class, so copies cost nothing beyond their row. Documents without
    words have fingerprint zero and are linked like others. Rows that repeat an id are kept and
    linked each by its own text; a row without an id takes the component of what it is linked with,
    null if that has no id. kept marks one row of each component (rows identical in id and text
    together): that with the smallest id, then text hash.
    """
    with scratch() as tables:
        own = tables.keep(materialize(fingerprints(docs, shingle, layout.words, seed, id_col, text_col), "fingerprints"))
        nodes = _nodes(own)
        placed = tables.keep(_placed(nodes, link_fingerprints(nodes.select(F.col("node").alias("doc_id"), "fp"), layout)))
    return _as_components(own, placed)


def _shingle_sets(texts: DataFrame, shingle: int, seed: int = 42) -> DataFrame:
    """(tree, node, n, grams binary) of texts (tree, node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            grams = [shingle_set(t, shingle, seed) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(len, grams), pa.int64()), pa.array([g.tobytes() for g in grams], pa.binary())], names=["tree", "node", "n", "grams"])

    return texts.select("tree", "node", text_bytes(texts).alias("t")).mapInArrow(run, "tree long, node long, n long, grams binary")


class _Sets:
    """Sets of one task side by side; similar() counts one set's overlap with all of them."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.grams, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)

    def similar(self, own: np.ndarray, similarity: float) -> np.ndarray:
        """Which sets have a cosine with this one that reaches the threshold; empty sets have none."""
        mark = np.zeros(len(self.grams) + 1, bool)
        at = np.searchsorted(self.grams, own)
        known = at < len(self.grams)
        known[known] = self.grams[at[known]] == own[known]
        mark[at[known]] = True
        both = np.bincount(self.owner[mark[self.flat]], minlength=len(self.sizes))
        return (both > 0) & (both >= similarity * np.sqrt(len(own) * self.sizes) - 1e-9)


def exact_parts(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Of each set the first set that similar pairs connect it with."""
    beside, part = _Sets(sets), np.full(len(sets), -1)
    for first in range(len(sets)):
        if part[first] >= 0:
            continue
        part[first], frontier = first, [first]
        while frontier and (part < 0).any():
            new = np.flatnonzero((part < 0) & beside.similar(sets[frontier.pop()], similarity))
            part[new] = first
            frontier += new.tolist()
    return part


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows sorted by (tree, chunk) -> the rows of each."""
    held: list[dict] = []
    for batch in small_batches(batches):
        for row in batch.to_pylist():
            if held and (held[-1]["tree"], held[-1]["chunk"]) != (row["tree"], row["chunk"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _clustered(similarity: float):
    """Rows (tree, chunk, node, grams) sorted by these -> (tree, chunk, node, part): exact within a chunk; part is a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            sets = {r["node"]: np.frombuffer(r["grams"], np.uint64) for r in rows}  # rows that repeat an id and a text are one
            nodes = np.array(list(sets), dtype=np.int64)
            part = nodes[exact_parts(list(sets.values()), similarity)]
            n = len(nodes)
            yield pa.RecordBatch.from_arrays([pa.array([rows[0]["tree"]] * n, pa.int64()), pa.array([rows[0]["chunk"]] * n, pa.int64()), pa.array(nodes), pa.array(part)], names=["tree", "chunk", "node", "part"])

    return run


def _probed(similarity: float):
    """Rows (tree, chunk, probe, node, part, grams) sorted by these -> links (a, b): a probe and one similar node of each part among the chunk's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, beside = None, [], None
        for batch in small_batches(batches):
            found: list[tuple[int, int]] = []
            for row in batch.to_pylist():
                if (row["tree"], row["chunk"]) != at:
                    at, own, beside = (row["tree"], row["chunk"]), [], None
                if not row["probe"]:
                    own.append((row["node"], row["part"], np.frombuffer(row["grams"], np.uint64)))
                    continue
                if beside is None:
                    beside, parts = _Sets([s for *_, s in own] or [np.zeros(0, np.uint64)]), np.array([p for _, p, _ in own])
                hits = np.flatnonzero(beside.similar(np.frombuffer(row["grams"], np.uint64), similarity)) if own else ()
                found += [(row["node"], own[h][0]) for h in hits[np.unique(parts[hits], return_index=True)[1]]] if len(hits) else []
            yield _link_table(found).select(["a", "b"])

    return run


def _confirmed(sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that connect, within each tree of (tree, node, n, grams), all whose similarity reaches the threshold.

    A tree that fits into a task is decided there. A larger one is dealt to chunks; a few hubs go to
    all of them and tie together what belongs together. Whatever stays outside its tree's largest
    part is then held against all of the tree, a chunk at a time, so the result is that of all pairs.
    """
    size = sets.groupBy("tree").agg(F.greatest(F.ceil(F.count("*") / CHUNK_NODES), F.ceil(F.sum("n") / CHUNK_SHINGLES)).cast("long").alias("chunks"))
    mark = F.xxhash64("node")
    dealt = sets.join(size, "tree").withColumn("chunk", F.pmod(mark, "chunks"))
    hub = (F.col("chunks") > 1) & (F.pmod(F.xxhash64(mark), F.col("chunks") * CHUNK_NODES) < HUBS)
    places = F.when(hub, F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(F.array("chunk"))
    dealt = dealt.select("tree", "node", "grams", F.explode(places).alias("chunk")).select("tree", "chunk", "node", "grams")
    local = dealt.repartition("tree", "chunk").sortWithinPartitions("tree", "chunk", "node").mapInArrow(_clustered(similarity), "tree long, chunk long, node long, part long")
    local = materialize(local, "parts")
    good = local.filter("node <> part").select(F.col("node").alias("a"), F.col("part").alias("b"))
    large = materialize(size.filter("chunks > 1"), "large")
    if large.isEmpty():
        return good
    big = sets.join(large, "tree")
    found = connected_components(good.join(big.select(F.col("node").alias("a")), "a", "left_semi"))
    placed = big.select("tree", "node", "chunks").join(found, "node", "left").select("tree", "node", "chunks", F.coalesce("component", "node").alias("part"))
    placed = materialize(placed, "placed-parts")
    main = placed.groupBy("tree", "part").agg(F.count("*").alias("n")).groupBy("tree").agg(F.max_by("part", F.struct("n", "part")).alias("main"))
    outside = placed.join(main, "tree").filter("part <> main").select("node", "part", "chunks")
    column = lambda rows, probe, chunk: rows.select("tree", chunk.alias("chunk"), F.lit(probe).alias("probe"), "node", "part", "grams")
    own = column(sets.join(placed.select("node", "part", "chunks"), "node"), 0, F.pmod(F.xxhash64("node"), "chunks"))
    probes = column(sets.join(outside, "node"), 1, F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    held = own.unionByName(probes).repartition("tree", "chunk").sortWithinPartitions("tree", "chunk", "probe", "node")
    return good.unionByName(held.mapInArrow(_probed(similarity), "a long, b long"))


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, recall: float = 0.99, id_col: str = "doc_id", text_col: str = "text", layout: Layout | None = None) -> DataFrame:
    """simhash_components for a cosine similarity of shingle sets, each shingle counted once; the layout follows the number of documents, the recall does not.

    Fingerprints only propose: documents that proposals connect are compared by the shingle sets of
    their whole texts, and links are all pairs among them that reach the threshold.
    """
    layout = layout or wide_layout(docs.count(), similarity, recall)
    with scratch() as tables:
        own = tables.keep(materialize(fingerprints(docs, shingle, layout.words, 42, id_col, text_col, distinct=True), "fingerprints"))
        nodes = _nodes(own)
        trees = connected_components(link_fingerprints(nodes.select(F.col("node").alias("doc_id"), "fp"), layout))
        members = trees.select("node", F.col("component").alias("tree")).unionByName(trees.select(F.col("component").alias("node"), F.col("component").alias("tree")).distinct())
        wanted = members.join(nodes, "node").select("tree", "node", F.col("best.doc_id").alias("want_id"), F.col("best.hash").alias("want_hash"))
        texts = docs.select(named(docs, id_col).cast("long").alias("doc_id"), named(docs, text_col).alias("text")).withColumn("hash", text_hash(F.col("text")))
        texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("want_id")) & (F.col("hash") == F.col("want_hash"))).select("tree", "node", "text")
        sets = materialize(_shingle_sets(texts, shingle), "shingles")
        placed = tables.keep(_placed(nodes, _confirmed(sets, similarity)))
    return _as_components(own, placed)

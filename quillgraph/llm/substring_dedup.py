"""Substring dedup with difference-cover anchors.

A difference cover D of a period v meets every distance: for all i and j there is a shift d < v with
i + d and j + d both in D modulo v. So if two stretches of `window` words are equal, they share an
anchor, a run of window - v + 1 words that starts at a cover position in both documents. Only anchors
are hashed and shuffled: 4 of 13 positions for windows of 20 words. Around shared anchors the matches
are extended to whole windows, and of equal windows the earliest stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, named, runs, small_batches, text_bytes

#: Perfect difference sets by period (fixed values of combinatorics).
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}
#: Words that are worked on at once.
CHUNK_WORDS = 1 << 19


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of four words at least."""
    periods = [v for v in COVERS if v <= window - 3]
    if not periods:
        raise ValueError("a window has six words at least")
    return max(periods), COVERS[max(periods)]


def _factors(n: int, salt: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt << 32)) | np.uint64(1)


def _run_hash(words: np.ndarray, starts: np.ndarray, length: int, salt: int) -> np.ndarray:
    """A 64-bit hash of words[s : s + length] for each start."""
    total = np.zeros(len(starts), np.uint64)
    for k, factor in enumerate(_factors(length, salt)):
        total += words[starts + k] * factor
    return mix64(total)


def _word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))


def _chunks(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows whose last item is a list of words, gathered until they have CHUNK_WORDS."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[-1])
        if n >= CHUNK_WORDS:
            yield held
            held, n = [], 0
    if held:
        yield held


def _concatenated(chunk: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a chunk's documents behind one another, and each document's offset and length."""
    sizes = np.array([len(r[-1]) for r in chunk], dtype=np.int64)
    words = np.concatenate([_word_hashes(r[-1]) for r in chunk])
    return words, np.cumsum(sizes) - sizes, sizes


def _anchors(window: int) -> Callable:
    period, cover = cover_for(window)
    length = window - period + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i, t.split()) for b in small_batches(batches) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for chunk in _chunks(r for r in rows if r[0] is not None and len(r[1]) >= window):
            words, offsets, sizes = _concatenated(chunk)
            owner = np.repeat(np.arange(len(chunk)), sizes)
            at = np.arange(len(words)) - offsets[owner]
            starts = np.flatnonzero(np.isin(at % period, cover) & (at + length <= sizes[owner]))
            keys = _run_hash(words, starts, length, 1)
            order = np.argsort(keys, kind="stable")
            keys, starts = keys[order], starts[order]
            new = np.r_[True, keys[1:] != keys[:-1]]
            shared = ~new | np.r_[keys[1:] == keys[:-1], False]
            # Of equal anchors in a chunk one meets other chunks; the rest are known to be shared already.
            keys = np.where(new, keys, mix64(keys + np.arange(len(keys), dtype=np.uint64)))
            ids = np.array([r[0] for r in chunk], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(ids[owner[starts]]), pa.array(at[starts].astype(np.int32)), pa.array(shared)],
                names=["key", "doc_id", "at", "shared"],
            )

    return run


#: Anchors of one key that a task holds at once.
RUN_ROWS = 1 << 20


def _shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors sorted by key -> those whose key occurs elsewhere too. A long run goes on in pieces as soon as it is known to be shared."""
    for parts, cut in runs(batches, RUN_ROWS):
        for table in parts if cut else [pa.Table.from_batches(parts).combine_chunks().to_batches()[0]]:
            if not cut:
                keys, known = table.column(0).to_numpy(), table.column(3).to_numpy(zero_copy_only=False)
                starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                sizes = np.diff(np.r_[starts, len(keys)])
                table = table.filter(pa.array(np.repeat((sizes > 1) | np.logical_or.reduceat(known, starts), sizes)))
            if table.num_rows:
                yield pa.RecordBatch.from_arrays([table.column(1), table.column(2)], names=["doc_id", "at"])


def _candidates(shared: list[int] | None, n: int, window: int) -> np.ndarray:
    """Starts of windows that hold a shared anchor."""
    if not shared or n < window:
        return np.zeros(0, np.int64)
    period, _ = cover_for(window)
    at = np.array(shared, dtype=np.int64)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.clip(at - period + 1, 0, n), 1)
    np.add.at(edge, np.clip(at + 1, 0, n), -1)
    return np.flatnonzero(np.cumsum(edge)[: n - window + 1] > 0)


def _windows(window: int) -> Callable:
    """(doc_id, text, shared) -> windows around shared anchors: (d1, d2, doc_id, start), the earliest of equal ones in a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            (i, s, t.split())
            for b in small_batches(batches)
            for i, t, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
            if s
        )
        for chunk in _chunks(rows):
            words, offsets, sizes = _concatenated(chunk)
            found = [_candidates(s, int(n), window) for (_, s, _), n in zip(chunk, sizes, strict=True)]
            start = np.concatenate(found)
            owner = np.repeat(np.arange(len(chunk)), [len(f) for f in found])
            doc = np.array([r[0] for r in chunk], dtype=np.int64)[owner]
            d1, d2 = (_run_hash(w, start + offsets[owner], window, salt) for w, salt in ((words, 2), (mix64(words), 3)))
            order = np.lexsort((start, doc, d2, d1))
            d1, d2, doc, start = d1[order], d2[order], doc[order], start[order]
            first = np.r_[True, (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])] if len(d1) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(d1[first].view(np.int64)), pa.array(d2[first].view(np.int64)), pa.array(doc[first]), pa.array(start[first].astype(np.int32))],
                names=["d1", "d2", "doc_id", "start"],
            )

    return run


def _cut(window: int) -> Callable:
    """(doc_id, text, shared, firsts) -> (doc_id, n_words, n_removed, kept): words under a window that starts earlier elsewhere are gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            columns = [batch.column(k).to_pylist() for k in range(1, 4)]
            n_words, n_removed, kept = [], [], []
            for text, shared, firsts in zip(*columns, strict=True):
                words = text.split()
                n = len(words)
                gone = np.setdiff1d(_candidates(shared, n, window), np.array(firsts or [], dtype=np.int64))
                n_words.append(n)
                if len(gone):
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, gone, 1)
                    np.add.at(edge, gone + window, -1)
                    stays = np.cumsum(edge)[:n] == 0
                    words = [words[k] for k in np.flatnonzero(stays)]
                n_removed.append(n - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([k.decode(errors="replace") for k in kept], pa.string()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"],
            )

    return run


def substring_dedup(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word covered by a window of `window` words that also starts earlier.

    Earlier is a smaller id, or the same document and an earlier start; windows are judged on the
    input. Returns (doc_id, n_words, n_removed, kept, kept_sha256), a row per input row; kept words
    are joined by one space. Null and empty texts have no words. Rows that repeat an id count as one
    document, so equal windows at equal starts of theirs stay. A row without an id stays whole and
    takes nothing from others. Texts shorter than a window stay whole. Words are bytes; in `kept`, what
    isn't UTF-8 is replaced, the hash is of the words as they are.

    Shuffles: anchors (4 of 13 positions), texts by id once (both joins use the same exchange), and
    the windows around shared anchors. A passage that a third of all documents share leaves each
    chunk once per anchor and once per window, so no key is hot.
    """
    source = docs.select(named(docs, id_col).cast("long").alias("doc_id"), text_bytes(docs, text_col).alias("t"))
    anchors = source.mapInArrow(_anchors(window), "key long, doc_id long, at int, shared boolean")
    met = anchors.repartition("key").sortWithinPartitions("key").mapInArrow(_shared_anchors, "doc_id long, at int")
    shared = materialize(met.groupBy("doc_id").agg(F.collect_list("at").alias("shared")), "anchors")
    placed = source.join(shared, "doc_id", "left").select("doc_id", "t", "shared")
    windows = placed.mapInArrow(_windows(window), "d1 long, d2 long, doc_id long, start int")
    # Id and start as one number: its minimum combines before the shuffle without sorting, and has no ties.
    place = F.col("doc_id").cast("decimal(20,0)") * F.lit(2**31).cast("decimal(10,0)") + F.col("start").cast("decimal(10,0)")
    earliest = windows.select("d1", "d2", place.alias("place")).groupBy("d1", "d2").agg(F.min("place").alias("place")).withColumn("start", F.pmod("place", F.lit(2**31)).cast("int"))
    earliest = earliest.select(F.expr("(place - start) div 2147483648").cast("long").alias("doc_id"), "start")
    firsts = earliest.groupBy("doc_id").agg(F.collect_list("start").alias("firsts"))
    both = placed.join(firsts, "doc_id", "left").select("doc_id", "t", "shared", "firsts")
    return both.mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")

"""Token counts with a linear longest-match automaton.

Greedy word-piece tokenisation takes the longest vocabulary entry at each step. A trie with failure
links finds the number of pieces in one pass over a word: a node's link leads to where matching goes on
after the pieces that its text is sure to yield are popped, and how many those are is precomputed.
Pieces themselves are never built.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, small_batches, text_bytes

DEFAULT_VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
#: Added to a word's last byte: an entry that ends words matches there alone, and no other entry does.
END = 256
CACHED_WORDS, CACHED_LENGTH = 400_000, 40


def byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write bytes with: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def load_pieces(path: str = DEFAULT_VOCABULARY, end_mark: str = "</w>") -> list[tuple[int, ...]]:
    """Vocabulary entries as byte sequences; the last byte of an entry that ends a word has END added."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    letters, out = byte_letters(), []
    for token in vocabulary:
        last = token.endswith(end_mark)
        body = token.removesuffix(end_mark)
        if body and all(c in letters for c in body):
            out.append((*(letters[c] for c in body[:-1]), letters[body[-1]] + END * last))
    return out


class LongestMatch:
    """goto: (node << 9 | symbol) -> node; fail, popped: per node, -1 where no link exists."""

    def __init__(self, pieces: Iterable[tuple[int, ...]]) -> None:
        self.goto: dict[int, int] = {}
        ends, parents, depth = [False], [(0, 0)], [0]
        for piece in pieces:
            node = 0
            for symbol in piece:
                edge = node << 9 | symbol
                if edge not in self.goto:
                    self.goto[edge] = len(ends)
                    parents.append((node, symbol))
                    depth.append(depth[node] + 1)
                    ends.append(False)
                node = self.goto[edge]
            if node:
                ends[node] = True
        self.fail, self.popped = [-1] * len(ends), [0] * len(ends)
        for node in sorted(range(1, len(ends)), key=depth.__getitem__):  # links point to shallower nodes
            if ends[node]:
                self.fail[node], self.popped[node] = 0, 1
                continue
            parent, symbol = parents[node]
            at, count = self.fail[parent], self.popped[parent]
            while at >= 0 and (at << 9 | symbol) not in self.goto:
                count += self.popped[at]
                at = self.fail[at]
            if at >= 0:
                self.fail[node], self.popped[node] = self.goto[at << 9 | symbol], count

    def count(self, word: bytes) -> int:
        """Number of pieces of a word, the last of which ends words; 0 if longest matches don't divide it so (an unknown word)."""
        if not word:
            return 0
        goto, fail, popped = self.goto, self.fail, self.popped
        node = total = 0
        for symbol in (*word[:-1], word[-1] + END):
            while (after := goto.get(node << 9 | symbol, -1)) < 0:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return 0
            node = after
        while node:
            total += popped[node]
            node = fail[node]
            if node < 0:
                return 0
        return total


_automata: dict[int, LongestMatch] = {}


def token_counts(docs: DataFrame, pieces: list[tuple[int, ...]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown): a row per row.

    Words are `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased. Of the entries that fit at a place the longest is
    taken; entries that end words fit only where the word ends, others only before. A word without
    such a division is unknown and counts as one token. Null and
    empty texts have none. The vocabulary is broadcast (its size is that of a vocabulary file, whatever
    the data); each worker builds the automaton once and remembers the counts of a bounded number of
    short words. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    number = shared._jbroadcast.id() if shared._jbroadcast is not None else id(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if number not in _automata:
            _automata.clear()
            _automata[number] = LongestMatch(shared.value)
        automaton, cache = _automata[number], {}
        for batch in small_batches(batches):
            n_words, n_tokens, n_unknown = [], [], []
            for text in batch.column(1).to_pylist():
                words = text.lower().split()
                total = unknown = 0
                for word in words:
                    found = cache.get(word, -1)
                    if found < 0:
                        found = automaton.count(word)
                        if len(word) <= CACHED_LENGTH:
                            if len(cache) >= CACHED_WORDS:
                                cache.clear()
                            cache[word] = found
                    if found:
                        total += found
                    else:
                        unknown += 1
                n_words.append(len(words))
                n_tokens.append(total + unknown)
                n_unknown.append(unknown)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_tokens, n_unknown))], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(named(docs, id_col).cast("long").alias("doc_id"), text_bytes(docs, text_col).alias("t")).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")

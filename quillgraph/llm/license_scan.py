"""License scans: fuzzy search for short notices.

A notice with at most k errors, cut into k + 1 pieces, contains one piece exactly (pigeonhole). One
automaton pass finds all pieces in a text; around each, the regex library matches the notice with
bounded errors, counts the edits and gives the span.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, small_batches, text_bytes

#: Phrases that count exactly, word for word (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Short notices that are searched for with errors (fixed values).
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("gnu lesser general public license", "lgpl"),
    ("mozilla public license version 2 0", "mpl-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "bsd"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("you may obtain a copy of the license at http www apache org licenses license 2 0", "apache-2"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("under the terms of the gnu affero general public license", "agpl"),
    ("under the terms of the eclipse public license", "epl"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons attribution noderivatives", "cc-by-nd"),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights", "cc0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("permission is granted to anyone to use this software for any purpose including commercial applications", "zlib"),
    ("boost software license version 1 0", "bsl-1"),
    ("everyone is permitted to copy and distribute verbatim or modified copies of this license document", "wtfpl"),
    ("made available under the open database license", "odbl"),
    ("licensed under the sil open font license version 1 1", "ofl"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
)
#: A notice of n characters may have n // 10 errors.
ERROR_LENGTH = 10
#: A-Z to lower case; \x00-\x2F, \x3A-\x60 and \x7B-\x7F separate words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

HITS = "array<struct<label:string, start_word:long, n_words:long, edits:int, exact:boolean, length:int>>"


def errors_of(notice: str) -> int:
    return len(notice) // ERROR_LENGTH


@dataclass(frozen=True)
class _Notice:
    text: str
    label: str
    errors: int
    pattern: regex.Pattern
    grams: list[str]

    def may_stand_in(self, window: str) -> bool:
        """Whether enough of the notice's three-letter stretches occur: an error destroys three at most, so fewer can't be a match."""
        there = {window[i : i + 3] for i in range(len(window) - 2)}
        return sum(g in there for g in self.grams) >= len(self.grams) - 3 * self.errors


class Scanner:
    def __init__(self, phrases: dict[str, str], notices: tuple[tuple[str, str], ...]) -> None:
        self.phrases = [(f" {p} ", label) for p, label in phrases.items()]
        self.automaton = ahocorasick.Automaton()
        pieces: dict[str, list] = {}
        for text, label in notices:
            k = errors_of(text)
            own = _Notice(text, label, k, regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(text)}){{e<={k}}}(?![^ ])"), [text[i : i + 3] for i in range(len(text) - 2)])
            cuts = [round(i * len(text) / (k + 1)) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(text[a:b], []).append((own, a))
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple]]:
        """Number of words, and hits (label, start word, words, edits, exact, length of what was sought)."""
        words = text.translate(_FOLD).split()
        line = f" {b' '.join(words).decode(errors='replace')} "
        spans = [(at, len(p), label, 0, True, len(p) - 2) for p, label in self.phrases for at in self._places(line, p)]
        spans += self._fuzzy(line)
        out, seen, word = [], 0, 0
        for at, length, label, edits, exact, whole in sorted(spans, key=lambda s: (s[0], s[1], s[2], not s[4])):
            word += line.count(" ", seen, at + 1)
            seen = at + 1
            out.append((label, max(0, word - 1), max(1, line[at : at + length].strip().count(" ") + 1), edits, exact, whole))
        return len(words), out

    @staticmethod
    def _places(line: str, phrase: str) -> Iterator[int]:
        at = line.find(phrase)
        while at >= 0:
            yield at
            at = line.find(phrase, at + 1)

    def _fuzzy(self, line: str) -> list[tuple]:
        out: dict[tuple, tuple] = {}
        done: dict[str, int] = {}
        for end, (size, owners) in self.automaton.iter(line):
            for own, offset in owners:
                begin = end - size + 1 - offset
                if end < done.get(own.text, -1):
                    continue  # inside a match of this notice
                low, high = max(0, begin - own.errors - 1), min(len(line), begin + len(own.text) + own.errors + 1)
                if own.may_stand_in(line[low:high]) and (found := own.pattern.search(line, low, high)):
                    done[own.text] = found.end()
                    out[own.text, found.start()] = (max(0, found.start() - 1), found.end() - found.start() + 1, own.label, sum(found.fuzzy_counts), False, len(own.text))
        return list(out.values())


def license_scan(docs: DataFrame, phrases: dict[str, str] | None = None, notices: tuple[tuple[str, str], ...] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, hits): a row per row; words are runs of a-z, 0-9 and characters beyond ASCII after lower-casing A-Z.

    Null and empty texts have no words and no hits. Exact phrases are reported at every place,
    overlapping ones too; notices with errors once per span. What isn't UTF-8 counts as the letter
    U+FFFD. No shuffle, one pass over whole texts.
    """
    scanner_args = (PHRASES if phrases is None else phrases, notices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*scanner_args)
        names = ("label", "start_word", "n_words", "edits", "exact", "length")
        kind = pa.list_(pa.struct([("label", pa.string()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int32()), ("exact", pa.bool_()), ("length", pa.int32())]))
        for batch in small_batches(batches):
            found = [scanner.scan(t) for t in batch.column(1).to_pylist()]
            hits = [[dict(zip(names, h, strict=True)) for h in hits] for _, hits in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array(hits, kind)], names=["doc_id", "n_words", "hits"])

    return docs.select(named(docs, id_col).cast("long").alias("doc_id"), text_bytes(docs, text_col).alias("t")).mapInArrow(run, f"doc_id long, n_words long, hits {HITS}")


def summary(scanned: DataFrame) -> DataFrame:
    """Digest of hits: places of exact phrases, labels, and the best similarity 1 - edits / length."""
    exact = F.filter("hits", lambda h: h.exact)
    starts = F.transform(exact, lambda h: h.start_word)
    join = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h.label))), ",")
    best = F.array_max(F.transform("hits", lambda h: 1 - h.edits / h.length))
    return scanned.select(
        "doc_id", "n_words", F.size(exact).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        join(exact).alias("base_labels"), join(F.col("hits")).alias("labels"), F.coalesce(best, F.lit(0.0)).alias("score"),
    )

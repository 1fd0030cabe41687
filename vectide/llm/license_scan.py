"""License notices: an exact set-similarity join of text blocks with templates, by containment.

Blocks are windows of consecutive words that overlap by half; each template meets blocks of at least twice its length, so any notice
as long as its template lies in one block as a whole. A template meets a block if the block holds at least threshold of the template's distinct
words. All template words are in one global order, by how many documents of the corpus hold them, rarest first; templates and blocks
are sorted by it, and words of a block that no template has can't be common. Let o be the words that must be common, ceil(threshold |T|). A pair
that meets shares a word of the first |T| - o + 1 of the template and the first |B| - o + 1 of the block (prefix filter on both
sides), the block has o such words at all (length filter), and behind each common word both sides have enough left for o (positional
filter). What passes is compared exactly.

Threshold containment alone can't tell notices apart that differ in a word. So a template that another label's notice would meet
names its label only where the words that the other lacks are present too; and of two templates that meet a block, one whose common
words are all common words of the other, which has more, is left out.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, text_bytes

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")  # over lower-cased UTF-8: ASCII letters and digits, and all other characters

# Base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Notices by which works name their license, and the headers and grants that licenses ask for.
_GPL = "this program is free software you can redistribute it and or modify it under the terms of the gnu {0}general public license as published by the free software foundation either version {1} of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {0}general public license for more details"
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("apache-2.0", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2.0", "this program is licensed under the gnu general public license version 2"),
    ("gpl-3.0", _GPL.format("", "3")),
    ("gpl-2.0", _GPL.format("", "2")),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("lgpl", _GPL.format("lesser ", "3")),
    ("agpl", "licensed under the gnu affero general public license"),
    ("agpl", _GPL.format("affero ", "3")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2.0"),
    ("cc-by", "licensed under cc by 4.0"),
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("cc-by-sa", "licensed under cc by sa 4.0"),
    ("cc-by-nd", "licensed under cc by nd 4.0"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4.0"),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4.0"),
    ("cc-by", "licensed under a creative commons attribution 4.0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4.0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4.0 international license"),
    ("cc-by-nd", "licensed under a creative commons attribution noderivatives 4.0 international license"),
    ("cc-by-nc-sa", "licensed under a creative commons attribution noncommercial sharealike 4.0 international license"),
    ("cc-by-nc-nd", "licensed under a creative commons attribution noncommercial noderivatives 4.0 international license"),
    ("cc0", "dedicated to the public domain under cc0 1.0 universal"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
BLOCK_WORDS = 48


class Index:
    """Templates of one block size, their words as ranks in the global order. frequency: documents that hold a word."""

    def __init__(self, templates: tuple[tuple[str, str], ...], frequency: dict[bytes, int], percent: int):
        self.labels = [label for label, _ in templates]
        sets = [set(WORDS.findall(text.encode().lower())) for _, text in templates]
        order = sorted(set().union(*sets), key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: k for k, w in enumerate(order)}
        self.words = [sorted(self.rank[w] for w in own) for own in sets]
        self.least = [ceil(percent * len(own) / 100) for own in sets]
        # rank: (template, place in it) of those that have it in their prefix
        self.prefixes: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, own in enumerate(self.words):
            for place, w in enumerate(own[: len(own) - self.least[t] + 1]):
                self.prefixes[w].append((t, place))
        self.rare = frozenset(order[k] for k in self.prefixes)
        # what a notice of another label lacks that would meet the template
        self.needed = [set().union(*[set(own) - set(other) for u, other in enumerate(self.words) if self.labels[u] != self.labels[t] and len(set(own) & set(other)) >= self.least[t]]) for t, own in enumerate(self.words)]

    def meets(self, block: list[int]) -> dict[int, frozenset[int]]:
        """The common words of each template that meets a block, given as ascending ranks."""
        out: dict[int, frozenset[int]] = {}
        seen: set[int] = set()
        for j, w in enumerate(block):
            for t, i in self.prefixes.get(w, ()):
                if t in seen:
                    continue
                least = self.least[t]
                seen.add(t)  # the first word in both prefixes decides
                if len(block) >= least and min(len(self.words[t]) - i, len(block) - j) >= least:
                    common = frozenset(self.words[t][i:]).intersection(block[j:])
                    if len(common) >= least:
                        out[t] = common
        return out

    def named(self, met: dict[int, frozenset[int]]) -> dict[int, float]:
        """Containment of those of the templates that name their label."""
        good = {t: c for t, c in met.items() if self.needed[t] <= c}
        return {t: len(c) / len(self.words[t]) for t, c in good.items() if not any(c < d and self.labels[t] != self.labels[u] for u, d in good.items())}


class Scanner:
    """All templates, by the sizes of the blocks they meet."""

    def __init__(self, templates: tuple[tuple[str, str], ...], frequency: dict[bytes, int], percent: int, least_block: int):
        by_size: dict[int, list[tuple[str, str]]] = defaultdict(list)
        for label, text in templates:
            by_size[block_size(text, least_block)].append((label, text))
        self.indexes = {size: Index(tuple(own), frequency, percent) for size, own in sorted(by_size.items())}
        self.rare = frozenset().union(*[x.rare for x in self.indexes.values()]) if by_size else frozenset()

    def search(self, words: list[bytes]) -> dict[str, float]:
        """The best containment by label."""
        best: dict[str, float] = {}
        for size, index in self.indexes.items():
            places = [(p, k) for p, k in enumerate(map(index.rank.get, words)) if k is not None]
            step = size // 2
            starts = {x for p, k in places if k in index.prefixes for x in (p // step - 1, p // step) if x >= 0}
            at = [p for p, _ in places]
            for x in starts:
                block = sorted({k for _, k in places[bisect_left(at, x * step) : bisect_left(at, x * step + size)]})
                for t, share in index.named(index.meets(block)).items():
                    best[index.labels[t]] = max(best.get(index.labels[t], 0.0), share)
        return best


def block_size(text: str, least: int) -> int:
    """The least block, doubled until it is twice as long as the text."""
    n, size = len(WORDS.findall(text.encode().lower())), least
    while size < 2 * n:
        size *= 2
    return size


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(start, label) of each place where a phrase's words stand consecutively."""
    out = []
    for phrase, label in PHRASES:
        own = phrase.encode().split()
        at = -1
        while True:
            try:
                at = words.index(own[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(own)] == own:
                out.append((at, label))
    return out


def _count(vocabulary: frozenset[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[bytes, int] = defaultdict(int)
        for _, bodies in rows_of(batches):
            for body in bodies:
                if body:
                    for w in vocabulary.intersection(WORDS.findall(body.lower())):
                        n[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["w", "n"])

    return run


def _scan(scanner: Scanner):
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])
    firsts = frozenset(p.encode().split()[0] for p, _ in PHRASES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, bodies in rows_of(batches):
            rows = []
            for i, body in zip(ids, bodies, strict=True):
                words = WORDS.findall(body.lower()) if body else []
                distinct = set(words)
                base = base_places(words) if distinct & firsts else []
                best = scanner.search(words) if not distinct.isdisjoint(scanner.rare) else {}
                own = {label for _, label in base}
                at = [p for p, _ in base]
                score = max([1.0 if base else 0.0, *best.values()])
                rows.append((i, len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | best.keys())), score))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema)

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, percent: int = 85, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of docs.

    A-Z are lower-cased; words are runs of ASCII letters, digits and characters beyond ASCII. percent is the containment threshold.
    score is the largest containment of a template that names its label, 1 where a base phrase stands, else 0. Blocks have block_words
    words, or twice that and so on where a template is longer than half a block. Very long texts are read as a whole.
    A null text counts as empty: no words, no labels, score 0. Rows that repeat an id and null ids come back one by one. An
    empty table gives an empty result.
    """
    texts = text_bytes(docs, id_col, text_col)
    vocabulary = frozenset(w for _, t in templates for w in WORDS.findall(t.encode().lower()))
    counted = texts.mapInArrow(_count(vocabulary), "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))
    frequency = {bytes(r["w"]): r["n"] for r in counted.collect()}  # no more rows than the templates have words
    out = texts.mapInArrow(_scan(Scanner(templates, frequency, percent, block_words)), "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    return out.withColumnRenamed("id", id_col)

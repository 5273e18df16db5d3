"""License scans: exact set-similarity containment of license templates in blocks of text.

A text's words are cut into blocks of BLOCK_WORDS that start every BLOCK_WORDS / 2 words, so any passage of half a block lies whole
in one of them. A block matches a template when it holds at least THRESHOLD of the template's distinct words.
Template words are put in order of their frequency over all texts, rarest first. By the prefix filter a matching
block holds one of a template's first words (all but as many as may be missing); the length filter asks for enough distinct words
in the block; the positional filter compares what may still be shared behind the first shared word with what is
needed; survivors are verified exactly. Apart from that, base phrases are found where their words stand consecutively.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import ALNUM, LOWER, Texts, map_texts, word_hashes, word_spans

THRESHOLD, BLOCK_WORDS = 0.8, 256

# Phrases and labels of the base scan.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Wording of public license notices, as label: text.
TEMPLATES = {
    "notice:apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "notice:bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "notice:cc-by-4.0": "this work is licensed under the creative commons attribution 4 0 international license to view a copy of this license visit",
    "notice:gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "notice:isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "notice:lgpl": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "notice:mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "notice:mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "notice:unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "notice:zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
}


def _hash(words: list[str]) -> np.ndarray:
    """word_hashes of the words, as they are in a text."""
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), ALNUM)
    return word_hashes(data, starts, ends)


class Words:
    """Words of a chunk of texts: hashes, and the index of each text's first word."""

    def __init__(self, column: pa.Array):
        texts = Texts(column)
        self.data = LOWER[texts.data]
        self.starts, self.ends, self.first = word_spans(self.data, texts.offsets, ALNUM)
        self.hashes = word_hashes(self.data, self.starts, self.ends)
        self.n = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def _lookup(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places in the sorted table, -1 where missing."""
    at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    return np.where(table[at] == hashes, at, -1)


class Join:
    """The templates' words in global order, and the prefix index of the join."""

    def __init__(self, templates: dict[str, list[str]], frequency: dict[str, int], threshold: float):
        self.rank = {w: i for i, w in enumerate(sorted({w for t in templates.values() for w in t}, key=lambda w: (frequency.get(w, 0), w)))}
        words = list(self.rank)
        self.raw = [w.encode() for w in words]
        hashes = _hash(words) if words else np.empty(0, np.uint64)
        order = np.argsort(hashes)
        self.table, self.place = hashes[order], order
        self.templates = {k: sorted({self.rank[w] for w in t}) for k, t in templates.items() if t}
        self.need = {k: math.ceil(threshold * len(t) - 1e-9) for k, t in self.templates.items()}
        self.prefix: dict[int, list[tuple[str, int]]] = {}
        for k, t in self.templates.items():
            for at, w in enumerate(t[: len(t) - self.need[k] + 1]):
                self.prefix.setdefault(w, []).append((k, at))
        self.starts_one = np.isin(np.arange(len(words)), list(self.prefix))

    def matches(self, words: Words, block_words: int) -> dict[int, dict[str, float]]:
        """Containment of each matching template, by text."""
        out: dict[int, dict[str, float]] = {}
        if not len(self.table) or not len(words.hashes):
            return out
        at = _lookup(self.table, words.hashes)
        rank = np.where(at >= 0, self.place[at], -1)
        rare = np.flatnonzero((rank >= 0) & self.starts_one[rank])
        half = block_words // 2
        blocks = set()
        for i in rare.tolist():
            d = int(words.doc[i])
            own = (i - int(words.first[d])) // half
            blocks.update((d, b) for b in (own, own - 1) if b >= 0)
        for d, b in blocks:
            lo = int(words.first[d]) + b * half
            hi = min(lo + block_words, int(words.first[d + 1]))
            distinct = len(np.unique(words.hashes[lo:hi]))
            held = sorted(set(rank[lo:hi].tolist()) - {-1})
            inside, seen = None, set()
            for place, w in enumerate(held):
                for k, start in self.prefix.get(w, ()):
                    if k in seen:
                        continue
                    seen.add(k)
                    need, t = self.need[k], self.templates[k]
                    # w is the first word that both share, so what lies behind it bounds the overlap
                    if distinct < need or 1 + min(len(t) - start - 1, len(held) - place - 1) < need:
                        continue
                    if inside is None:  # on the words themselves
                        inside = {r for i, r in enumerate(rank[lo:hi].tolist(), lo) if r >= 0 and words.word(i) == self.raw[r]}
                    shared = sum(x in inside for x in t)
                    if shared >= need:
                        own = out.setdefault(d, {})
                        own[k] = max(own.get(k, 0.0), shared / len(t))
        return out


def frequencies(docs: DataFrame, text_col: str, vocabulary: list[str]) -> dict[str, int]:
    """Occurrences of the vocabulary's words in all texts; one row for each word comes to the driver."""
    if not vocabulary:
        return {}
    hashes = _hash(vocabulary)
    order = np.argsort(hashes)
    table, names = hashes[order], [vocabulary[i] for i in order]

    def make():
        def work(column):
            at = _lookup(table, Words(column).hashes)
            counts = np.bincount(at[at >= 0], minlength=len(table))
            # the chunk's counts ride on its first row
            return [pa.array([counts.tolist(), *[None] * (len(column) - 1)], pa.list_(pa.int64()))]

        return work

    rows = map_texts(docs, F.col(text_col), {}, "n array<long>", make).where("n is not null")
    got = rows.select(F.posexplode("n").alias("w", "n")).groupBy("w").agg(F.sum("n").alias("n")).collect()
    return {names[r.w]: r.n for r in got}


def _places(words: Words, phrase: list[str]) -> np.ndarray:
    """Word indexes where the phrase's words stand consecutively within one text; verified on the words."""
    h, m = _hash(phrase), len(phrase)
    n = len(words.hashes) - m + 1
    if n <= 0:
        return np.empty(0, np.int64)
    same = words.hashes[:n] == h[0]
    for t in range(1, m):
        same &= words.hashes[t : t + n] == h[t]
    at = np.flatnonzero(same)
    at = at[words.doc[at] == words.doc[at + m - 1]]
    return np.array([i for i in at.tolist() if all(words.word(i + t) == phrase[t].encode() for t in range(m))], np.int64)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is 1 where a base phrase stands, else the greatest containment of a matching template, else 0. Null and
    empty texts have no words and no labels. Repeated rows are each returned; other columns are not read.
    """
    split = {k: t.split() for k, t in templates.items()}
    vocabulary = sorted({w for t in split.values() for w in t})
    join = Join(split, frequencies(docs, text_col, vocabulary), threshold)

    def make():
        def work(column):
            words = Words(column)
            n = len(words.n)
            base = [[] for _ in range(n)]
            for phrase, label in phrases.items():
                at = _places(words, phrase.split())
                for i in at.tolist():
                    d = int(words.doc[i])
                    base[d].append((i - int(words.first[d]), label))
            matched = join.matches(words, block_words)
            own = [matched.get(d, {}) for d in range(n)]
            return [
                pa.array(words.n, pa.int64()), pa.array([len(b) for b in base], pa.int64()), pa.array([min(b)[0] if b else None for b in base], pa.int64()), pa.array([max(b)[0] if b else None for b in base], pa.int64()),
                pa.array([",".join(sorted({x for _, x in b})) for b in base]), pa.array([",".join(sorted({x for _, x in b} | set(o))) for b, o in zip(base, own, strict=True)]),
                pa.array([1.0 if b else max(o.values(), default=0.0) for b, o in zip(base, own, strict=True)]),
            ]

        return work

    return map_texts(docs, F.col(text_col), {"doc_id": F.col(id_col)}, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double", make)

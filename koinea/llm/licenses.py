"""License scans by an exact set-similarity join of text blocks with license templates.

A block is any run of words up to half longer than the template, across lines. Tokens are ordered by their
frequency over all texts. A block that holds enough of a template must share one of the template's
rarest tokens (prefix filter), have enough words (length filter), and have enough of the template left
after its rarest shared token (positional filter); then it is verified exactly. So only blocks around
the rarest tokens are looked at, and each text's best block counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from koinea.llm import _kernel as K

# Phrases and labels of the base scan, as the query's contract has them.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Notices by which texts state their license.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
THRESHOLD = (9, 10)  # a template is contained if so much of its token set is in the block
BLOCK = (3, 2)  # a block has at most so many words for each word of the template

_WORD = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")


def tokens_of(text: str) -> list[str]:
    """Words of a text with A-Z as a-z."""
    return _WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))


def _hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(K.span_hashes(data, np.array([0]), np.array([len(data)]))[0])


def _vocabulary(templates) -> dict[str, int]:
    return {w: _hash(w) for w in sorted({w for _, t in templates for w in tokens_of(t)})}


def token_frequencies(docs: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """How often each template token stands in all texts; one number for each token reaches the driver."""
    vocabulary = _vocabulary(templates)
    names, keys = list(vocabulary), np.array(list(vocabulary.values()), np.uint64)
    order = np.argsort(keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(keys), np.int64)
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(0))
            for i, j in K.doc_ranges(offsets):
                lo = offsets[i]
                hashes, _ = K.words(data[lo : offsets[j]], offsets[i : j + 1] - lo, K.ALPHANUMERIC)
                place = np.minimum(np.searchsorted(keys[order], hashes), len(keys) - 1)
                total += np.bincount(order[place[keys[order][place] == hashes]], minlength=len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total)], names=["token", "n"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r.token: r.n for r in found.collect()}


class Template:
    """One template's tokens in global order, rarest first."""

    def __init__(self, label: str, text: str, vocabulary: Mapping[str, int], frequencies: Mapping[str, int], threshold: tuple[int, int]) -> None:
        ordered = sorted(set(tokens_of(text)), key=lambda w: (frequencies.get(w, 0), w))
        self.label, self.rank = label, {vocabulary[w]: k for k, w in enumerate(ordered)}
        self.size, self.need = len(ordered), needed(text, threshold)
        self.window = longest_block(text)
        self.prefix = [vocabulary[w] for w in ordered[: self.size - self.need + 1]]

    def best(self, words: list[int], probes: list[int]) -> int:
        """The most tokens of the template that one block around a probe (a place of a prefix token) holds; less than needed is 0."""
        best, done = 0, 0
        for at in probes:
            if at < done:
                continue
            lo = max(0, at - self.window + 1)
            done = min(len(words), at + self.window)
            for later in probes:  # blocks around near probes are looked at together
                if at < later < done:
                    done = min(len(words), later + self.window)
            hits = [(k, self.rank[words[k]]) for k in range(lo, done) if words[k] in self.rank]
            counts: dict[int, int] = {}
            first = 0
            for k, r in hits:
                counts[r] = counts.get(r, 0) + 1
                while hits[first][0] <= k - self.window:
                    out = hits[first][1]
                    counts[out] -= 1
                    if not counts[out]:
                        del counts[out]
                    first += 1
                if len(counts) >= self.need and self.size - min(counts) >= self.need:
                    best = max(best, len(counts))
        return best


def needed(text: str, threshold: tuple[int, int] = THRESHOLD) -> int:
    """How many of a template's tokens a block must hold."""
    return -(-len(set(tokens_of(text))) * threshold[0] // threshold[1])


def longest_block(text: str) -> int:
    """How many words a block has at most."""
    return len(tokens_of(text)) * BLOCK[0] // BLOCK[1]


def _scanner(frequencies: Mapping[str, int], templates, threshold: tuple[int, int]):
    vocabulary = _vocabulary(templates)
    prepared = [Template(label, text, vocabulary, frequencies, threshold) for label, text in templates]
    probes: dict[int, list[int]] = {}
    for t, template in enumerate(prepared):
        for h in template.prefix:
            probes.setdefault(h, []).append(t)
    phrases = [([_hash(w) for w in p.split()], label) for p, label in PHRASES]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.array(sorted(probes), np.uint64)
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(1))
            for i, j in K.doc_ranges(offsets):
                lo = offsets[i]
                hashes, first = K.words(data[lo : offsets[j]], offsets[i : j + 1] - lo, K.ALPHANUMERIC)
                places: dict[int, list[int]] = {}
                base: dict[int, set[str]] = {}
                more: dict[int, set[str]] = {}
                score = np.zeros(j - i)
                owner = lambda k: int(np.searchsorted(first, k, "right")) - 1
                for words, label in phrases:
                    n = len(words)
                    if len(hashes) < n:
                        continue
                    hit = np.ones(len(hashes) - n + 1, bool)
                    for k, h in enumerate(words):
                        hit &= hashes[k : len(hashes) - n + 1 + k] == np.uint64(h)
                    for s in np.flatnonzero(hit).tolist():
                        d = owner(s)
                        if d == owner(s + n - 1):
                            places.setdefault(d, []).append(s - int(first[d]))
                            base.setdefault(d, set()).add(label)
                            score[d] = 1.0
                place = np.minimum(np.searchsorted(wanted, hashes), max(0, len(wanted) - 1))
                hit = np.flatnonzero(wanted[place] == hashes) if len(wanted) else np.zeros(0, np.int64)
                own = np.searchsorted(first, hit, "right") - 1
                for d in np.unique(own).tolist():
                    at = hit[own == d]
                    near: dict[int, list[int]] = {}
                    for k, h in zip((at - first[d]).tolist(), hashes[at].tolist(), strict=True):
                        for t in probes[h]:
                            near.setdefault(t, []).append(k)
                    words = hashes[first[d] : first[d + 1]].tolist()
                    for t, spots in near.items():
                        found = prepared[t].best(words, spots) if len(words) >= prepared[t].need else 0
                        if found:
                            more.setdefault(d, set()).add(prepared[t].label)
                            score[d] = max(score[d], found / prepared[t].size)
                n = j - i
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, n).cast(pa.int64()),
                        pa.array(np.diff(first)),
                        pa.array([len(places.get(d, ())) for d in range(n)], pa.int64()),
                        pa.array([min(places[d]) if d in places else None for d in range(n)], pa.int64()),
                        pa.array([max(places[d]) if d in places else None for d in range(n)], pa.int64()),
                        pa.array([",".join(sorted(base.get(d, ()))) for d in range(n)]),
                        pa.array([",".join(sorted(base.get(d, set()) | more.get(d, set()))) for d in range(n)]),
                        pa.array(score),
                    ],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    return scan


def scan_licenses(docs: DataFrame, *, templates=TEMPLATES, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Licenses of docs(doc_id, text): rows (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    Base labels stand for phrases whose words are consecutive; n_base counts their places, first_word
    and last_word are the smallest and largest start (null without any). labels adds those of templates
    of which a block holds threshold[0] / threshold[1] of the token set at least; a block is any run of
    words, line ends included, with at most BLOCK[0] / BLOCK[1] words for each of the template's. score: 1
    with a base phrase, else the largest containment found, else 0.

    Null and empty texts have no words and no labels; tokens that are equally frequent are ordered by
    code points, which changes no result; repeated rows are scanned alike; other columns are ignored; an
    empty table gives an empty result.
    """
    scan = _scanner(token_frequencies(docs, templates), templates, threshold)
    kind = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, kind)

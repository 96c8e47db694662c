"""Licence scans by a positional index of rare words.

First every file becomes postings of the words that licences use: which of them it has, and where.  How many
files have a word tells how rare it is.  Then each file's licence words are looked up from the rarest on.  A
template is listed under the rarest word of its mandatory phrases, so a file without that word cannot hold it
and nothing else has to be tried.  A mandatory phrase stands where the postings of its words, each shifted by
its place in the phrase, intersect, the rarest word first.  The other mandatory phrases of a template must
stand near where it puts them, give or take ``SLACK`` words (names and years come in between); the rarity of
the template's words that stand near their places, over that of all its words, is the score of the place.

Rows and edge cases: a null text has no words; a file without a licence has no hits and scores 0; a null or
repeated id gives a row for each row; words of texts of any length are counted, in parts; a place counts
for every template that verifies there; other columns are ignored; an empty table gives nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.llm.common import slices, write_shared
from lucerna.llm.resampling import word_parts

#: Words that may come between what a template has next to each other.
SLACK = 24

_GPL = "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {} of the license or at your option any later version"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"

# Label, words of a notice, and the phrases in it that must be there. Notices of public licences.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge", "to deal in the software without restriction"]),
    ("mit", "spdx license identifier mit", ["license identifier mit"]),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["you may not use this file except in compliance with the license", "apache org licenses license 2 0"]),
    ("apache-2", "spdx license identifier apache 2 0", ["license identifier apache 2 0"]),
    ("bsd", f"{_BSD} redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistribution and use in source and binary forms", "must retain the above copyright notice"]),
    ("bsd-3", f"{_BSD} redistributions of source code must retain the above copyright notice neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", ["redistribution and use in source and binary forms", "may be used to endorse or promote products"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify", "with or without fee is hereby granted"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["in no event will the authors be held liable"]),
    ("gpl-2", _GPL.format(2), ["gnu general public license as published by the free software foundation", "version 2"]),
    ("gpl-3", _GPL.format(3), ["gnu general public license as published by the free software foundation", "version 3"]),
    ("gpl-2", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2", "spdx license identifier gpl 2 0", ["license identifier gpl 2 0"]),
    ("gpl-3", "spdx license identifier gpl 3 0", ["license identifier gpl 3 0"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license", ["gnu affero general public license"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["subject to the terms of the mozilla public license", "v 2 0"]),
    ("mpl-2", "spdx license identifier mpl 2 0", ["license identifier mpl 2 0"]),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ["eclipse public license 2 0"]),
    ("boost", "distributed under the boost software license version 1 0", ["boost software license version 1 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software released into the public domain"]),
    ("cc0", "to the extent possible under law the author has waived all copyright under cc0 1 0 universal", ["cc0 1 0 universal"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by", "licensed under cc by 4 0", ["licensed under cc by 4 0"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("all-rights-reserved", "all rights reserved", ["all rights reserved"]),
]


@dataclass(frozen=True)
class Template:
    """``words`` and ``keys`` (offset, words) by number; ``phrase`` where the template is a phrase of the caller."""

    label: str
    phrase: str | None
    words: tuple[int, ...]
    keys: tuple[tuple[int, tuple[int, ...]], ...]


def compiled(phrases: list[tuple[str, str]], templates: list[tuple[str, str, list[str]]]) -> tuple[list[str], list[Template]]:
    """(vocabulary, templates): ``phrases`` are (phrase, label), found at every place where they stand whole."""
    notices = [(label, phrase, phrase, [phrase]) for phrase, label in phrases] + [(label, None, text, keys) for label, text, keys in templates]
    vocabulary = sorted({w for _, _, text, _ in notices for w in text.split()})
    number = {w: i for i, w in enumerate(vocabulary)}
    out = []
    for label, phrase, text, keys in notices:
        words = text.split()
        found = []
        for key in keys:
            k = key.split()
            at = next(i for i in range(len(words)) if words[i : i + len(k)] == k)
            found.append((at, tuple(number[w] for w in k)))
        out.append(Template(label, phrase, tuple(number[w] for w in words), tuple(found)))
    return vocabulary, out


def license_index(documents: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, n_words and postings: distinct licence words, how often each comes, and where, as 32-bit numbers."""
    number = {w.encode(): i for i, w in enumerate(vocabulary)}

    def postings(text: bytes | None) -> tuple[int, dict[int, list[int]]]:
        n, found = 0, {}
        for part in word_parts(text):
            for at, word in enumerate(part, n):
                if word in number:
                    found.setdefault(number[word], []).append(at)
            n += len(part)
        return n, found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int32())
        for b in slices(batches):
            got = [postings(t) for t in b.column("text").cast(pa.large_binary()).to_pylist()]
            places = [np.fromiter((p for ps in f.values() for p in ps), "<i4").tobytes() for _, f in got]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([n for n, _ in got], pa.int64()), pa.array([list(f) for _, f in got], ints), pa.array([[len(ps) for ps in f.values()] for _, f in got], ints), pa.array(places, pa.binary())],
                ["doc_id", "n_words", "word", "n", "at"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, word array<int>, n array<int>, at binary")


def rarity(index: DataFrame, size: int) -> list[float]:
    """For each word of the vocabulary the logarithm of files to files that have it, plus one."""
    files = index.count()
    having = {r["word"]: r["files"] for r in index.select(F.explode("word").alias("word")).groupBy("word").agg(F.count("*").alias("files")).collect()}
    return [1 + math.log((files + 1) / (having.get(i, 0) + 1)) for i in range(size)]


def _places(words: tuple[int, ...], postings: dict[int, np.ndarray], rare: list[float]) -> np.ndarray:
    """Where ``words`` stand consecutively: postings by relative position, from the rarest word on."""
    starts = None
    for k in sorted(range(len(words)), key=lambda k: (-rare[words[k]], k)):
        at = postings.get(words[k])
        if at is None:
            return np.zeros(0, np.int64)
        starts = at - k if starts is None else starts[np.isin(starts, at - k)]
        if not len(starts):
            break
    return starts


def _near(at: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each wanted place whether one of the sorted places is within SLACK of it."""
    i = np.minimum(np.searchsorted(at, wanted - SLACK), len(at) - 1)
    return np.abs(at[i] - wanted) <= SLACK


def _hits(postings: dict[int, np.ndarray], listed: dict[int, list[tuple[Template, int]]], rare: list[float]) -> list[dict]:
    out = []
    for word in sorted(postings, key=lambda w: (-rare[w], w)):
        for template, leading in listed.get(word, ()):
            offset, key = template.keys[leading]
            begins = _places(key, postings, rare) - offset
            for j, (other, words) in enumerate(template.keys):
                if len(begins) and j != leading:
                    at = _places(words, postings, rare)
                    begins = begins[_near(at, begins + other)] if len(at) else begins[:0]
            if not len(begins):
                continue
            held = np.zeros(len(begins))
            for k, w in enumerate(template.words):
                if w in postings:
                    held += rare[w] * _near(postings[w], begins + k)
            score = np.ones(len(begins)) if template.phrase is not None else np.minimum(1.0, held / sum(rare[w] for w in template.words))
            out += [
                {"label": template.label, "phrase": template.phrase, "start": max(0, s), "end": s + len(template.words), "score": x}
                for s, x in zip(begins.tolist(), score.tolist(), strict=True)
            ]
    return out


_HIT = pa.list_(pa.struct([("label", pa.string()), ("phrase", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def scan_licenses(documents: DataFrame, phrases: list[tuple[str, str]], templates: list[tuple[str, str, list[str]]] = TEMPLATES) -> DataFrame:
    """doc_id, n_words and hits (label, phrase, start and end in words, score) of every document."""
    vocabulary, known = compiled(phrases, templates)
    index, _ = write_shared(license_index(documents, vocabulary), "license-index")
    rare = rarity(index, len(vocabulary))
    listed: dict[int, list[tuple[Template, int]]] = {}
    for t in known:
        word, leading = min(((w, j) for j, (_, key) in enumerate(t.keys) for w in key), key=lambda x: (-rare[x[0]], x))
        listed.setdefault(word, []).append((t, leading))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            hits = []
            for words, counts, raw in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), b.column("at").to_pylist(), strict=True):
                at = np.split(np.frombuffer(raw, "<i4").astype(np.int64), np.cumsum(counts)[:-1]) if words else []
                hits.append(_hits(dict(zip(words, at, strict=True)), listed, rare))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(hits, _HIT)], ["doc_id", "n_words", "hits"])

    return index.mapInArrow(run, "doc_id long, n_words long, hits array<struct<label:string,phrase:string,start:bigint,end:bigint,score:double>>")


def _labels(hits: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")


def license_report(documents: DataFrame, phrases: list[tuple[str, str]], templates: list[tuple[str, str, list[str]]] = TEMPLATES) -> DataFrame:
    """Counts and places of ``phrases``, their labels, all labels, and the best score of each document."""
    base = F.filter("hits", lambda h: h["phrase"].isNotNull())
    starts = F.transform(base, lambda h: h["start"])
    return scan_licenses(documents, phrases, templates).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        _labels(base).alias("base_labels"), _labels(F.col("hits")).alias("labels"), F.coalesce(F.array_max(F.transform("hits", lambda h: h["score"])), F.lit(0.0)).alias("score"),
    )

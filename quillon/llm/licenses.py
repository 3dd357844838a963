"""Licence scans by a positional index of rare words."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import settled, small_batches

# Label, and the phrase that makes it.
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

# Label, the template's words (notices as they stand in files), and the key phrase that must stand in it word for word.
TEMPLATES = [
    ("agpl-3.0", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "compliance with the license"),
    ("artistic-2.0", "licensed under the terms of the artistic license 2 0", "artistic license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products"),
    ("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide", "dedicated the work to the public domain"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    ("gpl-2.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "version 2 of the license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl-3.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "version 3 of the license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "distribute this software for any purpose"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "substantial portions of the software"),
    ("mpl-2.0", "subject to the terms of the mozilla public license version 2 0", "mozilla public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "source code form"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors"),
]
LEAST = 0.75  # share of a template's weight that must stand at its places

_SPACED = bytes(c if c >= 0x80 or chr(c).isdigit() or "a" <= chr(c) <= "z" else 0x20 for c in range(256))
VOCABULARY = sorted({w for _, words, *_ in BASE + TEMPLATES for w in words.split()})
_NUMBER = {w.encode(): i for i, w in enumerate(VOCABULARY)}
_KNOWN = frozenset(_NUMBER)
_KEYS = [frozenset(key.encode().split()) for *_, key in BASE + TEMPLATES]


def words_of(text: str | None) -> list[bytes]:
    """The words of a whole text, A-Z lowered: runs of digits, a-z and whatever is not ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_SPACED).split()


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, seen array<int>, words array<int>, places array<int>): which licence words a text has, and where
    they stand. A text that lacks a word of every key phrase can get no label; its places are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _NUMBER.get
        for batch in batches:
            counts, lists = [], [([], [0]) for _ in range(3)]
            for value in batch.column("text").to_pylist():
                found = words_of(value)
                seen = _KNOWN.intersection(found)
                hits = [(n, i) for i, n in enumerate(map(get, found)) if n is not None] if any(key <= seen for key in _KEYS) else []
                counts.append(len(found))
                for (values, ends), more in zip(lists, ([_NUMBER[w] for w in seen], [n for n, _ in hits], [i for _, i in hits]), strict=True):
                    values += more
                    ends.append(len(values))
            arrays = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32())) for values, ends in lists]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), *arrays], names=["doc_id", "n_words", "seen", "words", "places"])

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return small_batches(own).mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_words long, seen array<int>, words array<int>, places array<int>")


def weights(found: DataFrame) -> dict[str, float]:
    """The inverse document frequency of each licence word over all of ``found``; as many numbers as the vocabulary has words."""
    total = found.count()
    counts = {r["word"]: r["count"] for r in found.select(F.explode("seen").alias("word")).groupBy("word").count().collect()}
    return {w: math.log((total + 1) / (counts.get(i, 0) + 1)) + 1.0 for i, w in enumerate(VOCABULARY)}


class Index:
    """Templates by the rarest word of their key phrase, each with its words in order of falling weight."""

    def __init__(self, idf: dict[str, float]):
        self.weight = np.array([idf[w] for w in VOCABULARY])
        self.base = [(label, self._rarest(phrase.split(), idf)) for label, phrase in BASE]
        self.under: dict[int, list] = {}  # a text with the template's label has this word
        for label, words, key in TEMPLATES:
            parts, wanted = words.split(), key.split()
            at = next(i for i in range(len(parts)) if parts[i : i + len(wanted)] == wanted)
            phrase = self._rarest(wanted, idf)
            self.under.setdefault(phrase[0][0], []).append((label, self._rarest(parts, idf), phrase, at))

    @staticmethod
    def _rarest(words: list[str], idf: dict[str, float]) -> list[tuple[int, int, float]]:
        return sorted(((VOCABULARY.index(w), i, idf[w]) for i, w in enumerate(words)), key=lambda x: (-x[2], x[1]))

    @staticmethod
    def whole(parts: list[tuple[int, int, float]], where: dict[int, np.ndarray]) -> np.ndarray:
        """Starts at which all words stand: the rarest word's postings, cut by each further one's, moved to the start."""
        starts = None
        for word, offset, _ in parts:
            places = where.get(word)
            if places is None:
                return np.zeros(0, dtype=np.int64)
            starts = places - offset if starts is None else np.intersect1d(starts, places - offset, assume_unique=True)
            if not len(starts):
                break
        return starts

    def scan(self, words: np.ndarray, places: np.ndarray) -> tuple[int, int | None, int | None, str, str, float]:
        """(n_base, first_word, last_word, base_labels, labels, score) of one text's postings."""
        order = np.argsort(words, kind="stable")
        numbers, firsts = np.unique(words[order], return_index=True)
        where = dict(zip(numbers.tolist(), np.split(places[order].astype(np.int64), firsts[1:]), strict=True)) if len(words) else {}
        base, starts, score = set(), [], 0.0
        for label, parts in self.base:
            if len(found := self.whole(parts, where)):
                base.add(label)
                starts.append(found)
                score = 1.0
        labels = set(base)
        for rare in sorted(where, key=lambda n: (-self.weight[n], n)):  # the text's rarest licence words look templates up
            for label, parts, key, at in self.under.get(rare, ()):
                sure = self.whole(key, where) - at  # the key phrase fixes where the template starts
                if not len(sure):
                    continue
                full, hit = sum(w for *_, w in parts), np.zeros(len(sure))
                for word, offset, weight in parts:
                    if (own := where.get(word)) is not None:
                        hit += weight * np.isin(sure + offset, own)
                if (share := float(hit.max()) / full) >= LEAST:
                    labels.add(label)
                    score = max(score, min(1.0, share))
        every = np.concatenate(starts) if starts else None
        return 0 if every is None else len(every), None if every is None else int(every.min()), None if every is None else int(every.max()), ",".join(sorted(base)), ",".join(sorted(labels)), score


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of ``docs``.

    A base label needs its phrase; a template's label needs the key phrase and three quarters of the
    template's weight at the right places around it. The score is the best share found, 1 with a base
    phrase, 0 without any label. Null and empty texts have no words; repeated rows stay; places may be any
    number; an empty table gives no rows. Other columns are ignored, whatever their names. Texts are read once
    and whole: the weights, counted over all documents, come from their postings.
    """
    found = settled(postings(docs, doc_id, text))
    index = Index(weights(found))
    schema = f"doc_id {found.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
        for batch in batches:
            lists = [(np.asarray(c.values), np.asarray(c.offsets)) for c in (batch.column("words"), batch.column("places"))]
            (words, at), (places, _) = lists
            rows = [index.scan(words[a:b], places[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            columns = [pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), *columns], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return found.mapInArrow(run, schema)

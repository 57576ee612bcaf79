"""Licence scans by a positional index of rare words.

Templates are short public notices. Rarity is the inverse frequency of a word over all scanned documents. The index
posts a template's rarest places: so many that of any share SHARE of its places at least VOTES are posted. A file looks up
each posted word that it holds; each pair of a place in the file and a posting votes for the template at the start the
two imply. Where VOTES or more vote for the same start, the share of the template's words that stand there is the
match's score, and it counts if it reaches SHARE and the template's mandatory phrases stand in the file. So no start
that reaches SHARE is missed, whatever words were changed.

Base phrases are found wherever their words stand consecutively and always give their label.

Defined results: null and empty text has no words, no places and score 0. Repeated ids are scanned row by row. Very long
texts are scanned whole, all their places. Words of equal rarity: the first by bytes. An empty table gives an empty
table. Kept columns named like a new one give way to it.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from math import ceil, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import chunks, map_texts, texts

SHARE, VOTES = 0.6, 2

# Words of public licence notices, labels and phrases.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", ["distributed on an as is basis", "applicable law"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-3", "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu general public license", "version 3"]),
    ("gpl-2", "it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["gnu general public license", "version 2"]),
    ("lgpl", "it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("agpl-3", "it under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify", "with or without fee"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ["eclipse public license"]),
]

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BASE = [(p.encode().split(), label) for p, label in BASE.items()]
_NOTICES = [(label, text.encode().split(), [m.encode().split() for m in must]) for label, text, must in NOTICES]
_LEXICON = frozenset(w for _, words, _ in _NOTICES for w in words) | {w for words, _ in _BASE for w in words}


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def document_frequencies(docs: DataFrame, text_col: str = "text") -> dict[bytes, float]:
    """IDF of each licence word over all documents; the lexicon bounds what comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = Counter(), 0
        for batch in chunks(batches):
            for t in texts(batch.column(0)):
                held.update(_LEXICON.intersection(words_of(t)))
            n += batch.num_rows
        rows = [(b"", n), *held.items()]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.binary()), pa.array([k for _, k in rows], pa.int64())], ["word", "n"])

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n")).collect()
    held = {bytes(w): n for w, n in counted}
    n = held.get(b"", 0)
    return {w: log((n + 1) / (held.get(w, 0) + 1)) for w in _LEXICON}


class Index:
    def __init__(self, idf: dict[bytes, float]) -> None:
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, words, _) in enumerate(_NOTICES):
            rare = sorted(range(len(words)), key=lambda i: (-idf[words[i]], words[i], i))
            for i in rare[: len(words) - ceil(SHARE * len(words)) + VOTES]:
                self.postings[words[i]].append((k, i))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], set[str], float]:
        """Base places with their labels, the labels that the index adds, and the best score."""
        present = _LEXICON.intersection(words)
        if len(present) < 2:
            return [], set(), 0.0
        at: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in present:
                at[w].append(i)

        def places(phrase: list[bytes]) -> list[int]:
            if not present.issuperset(phrase):
                return []
            first = min(range(len(phrase)), key=lambda k: len(at[phrase[k]]))
            starts = (i - first for i in at[phrase[first]])
            return [s for s in starts if s >= 0 and words[s : s + len(phrase)] == phrase]

        base = [(s, label) for phrase, label in _BASE for s in places(phrase)]
        votes = Counter((k, i - p) for w in present.intersection(self.postings) for i in at[w] for k, p in self.postings[w])
        labels, best = set(), 1.0 if base else 0.0
        for (k, start), n in votes.items():
            label, notice, must = _NOTICES[k]
            if n >= VOTES:
                share = sum(0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(notice)) / len(notice)
                if share >= SHARE and all(map(places, must)):
                    labels.add(label)
                    best = max(best, share)
                elif not base:
                    best = max(best, share / 2)
        return base, labels, best


def _scanner(idf: dict[bytes, float]) -> Callable:
    def start() -> Callable[[list[bytes]], dict]:
        index = Index(idf)

        def work(batch: list[bytes]) -> dict:
            out = defaultdict(list)
            for text in batch:
                words = words_of(text)
                base, labels, score = index.scan(words)
                names = {label for _, label in base}
                row = {
                    "n_words": len(words), "n_base": len(base), "first_word": min(base)[0] if base else None, "last_word": max(base)[0] if base else None,
                    "base_labels": ",".join(sorted(names)), "labels": ",".join(sorted(names | labels)), "score": score,
                }
                for k, v in row.items():
                    out[k].append(v)
            return out

        return work

    return start


def scan_licenses(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns and what the scan finds, for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(document_frequencies(docs, text_col))
    fields = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    return map_texts(docs, text_col, lambda: _scanner(shared.value)(), fields, keep)

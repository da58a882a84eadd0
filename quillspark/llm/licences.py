"""Licence scans by a positional index of rare words.

Templates are licence notices, headers and titles with the phrases they must hold; base phrases are templates that must be
held whole. The document frequency of every template word is counted over all documents. The index keeps, for each template,
the postings (template, position) of its ``RARE`` words of highest IDF. A text looks up its licence words, highest IDF first;
each posting votes for the place where its template would start, and votes whose places differ by at most ``SLACK`` words are
one alignment, so that a word put in or left out does not part them. A template with enough votes for an alignment is checked
there at once, and its further words look up nothing: its mandatory phrases must stand, word for word, within the stretch that
the template would take and ``SLACK`` words about it, and a label's score is the share of the template's words that stand
there in its order. A base phrase is looked up by its one rarest word, so every place where its words stand consecutively is
found.

Words are runs of ASCII letters and digits and of anything beyond ASCII; A-Z are lower-cased. A null text has no words. Whole
texts are scanned, however long; repeated rows are scanned alike; of several places the best score counts, and equal IDFs
go by the word. A column ``licence`` of the input is replaced. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import by_value, slices, text_of

by_value(__name__)

RARE, SLACK, LEAST_SCORE = 4, 4, 0.6

# The base phrases of the contract, then notices, headers and titles as the licences word them (lower case, without
# punctuation), each with the phrases it must hold.
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
_FSF = "is free software you can redistribute it and or modify it under the terms of the gnu {} general public license as published by the free software foundation either version {} of the license or at your option any later version"
_FORM = "licensed under the gnu {} general public license version {}"
_SPDX = "spdx license identifier {}"
NOTICES: list[tuple[str, str, list[str]]] = [
    ("agpl-3.0", "gnu affero general public license", ["affero general public license"]),
    ("agpl-3.0", _FSF.format("affero", "3"), ["affero general public license as published by the free software foundation", "version 3 of the license"]),
    ("agpl-3.0", "gnu affero general public license version 3 19 november 2007", ["affero general public license version 3"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license version 2 0"]),
    ("apache-2.0", "apache license version 2 0 january 2004", ["apache license version 2 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use in source and binary forms"]),
    ("bsd-2-clause", "bsd 2 clause license", ["bsd 2 clause"]),
    ("bsd-3-clause", "bsd 3 clause license", ["bsd 3 clause"]),
    ("bsl-1.0", "boost software license version 1 0 august 17th 2003", ["boost software license version 1 0"]),
    ("cc-by-4.0", "creative commons attribution 4 0 international", ["attribution 4 0 international"]),
    ("cc-by-nc", "licensed under cc by nc", ["cc by nc"]),
    ("cc-by-nd", "licensed under cc by nd", ["cc by nd"]),
    ("cc-by-sa", "licensed under cc by sa", ["cc by sa"]),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international", ["attribution sharealike"]),
    ("cc0-1.0", "cc0 1 0 universal public domain dedication", ["cc0 1 0"]),
    ("epl-2.0", "eclipse public license v 2 0", ["eclipse public license"]),
    ("gpl-2.0", _FORM.format("", "2").replace("  ", " "), ["general public license version 2"]),
    ("gpl-2.0", _FSF.format("", "2").replace("  ", " "), ["gnu general public license as published by the free software foundation", "version 2 of the license"]),
    ("gpl-2.0", "gnu general public license version 2 june 1991", ["gnu general public license version 2"]),
    ("gpl-3.0", _FORM.format("", "3").replace("  ", " "), ["general public license version 3"]),
    ("gpl-3.0", _FSF.format("", "3").replace("  ", " "), ["gnu general public license as published by the free software foundation", "version 3 of the license"]),
    ("gpl-3.0", "gnu general public license version 3 29 june 2007", ["gnu general public license version 3"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify"]),
    ("isc", "isc license", ["isc license"]),
    ("lgpl", "gnu lesser general public license", ["lesser general public license"]),
    ("lgpl", _FSF.format("lesser", "2 1"), ["lesser general public license as published by the free software foundation"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("mit", "licensed under the mit license", ["under the mit license"]),
    ("mit", "the mit license", ["mit license"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license", "2 0"]),
    ("mpl-2.0", "mozilla public license version 2 0", ["mozilla public license version 2 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    *[(label, _SPDX.format(name), [_SPDX.format(name)]) for label, name in (
        ("agpl-3.0", "agpl 3 0"), ("apache-2.0", "apache 2 0"), ("bsd-2-clause", "bsd 2 clause"), ("bsd-3-clause", "bsd 3 clause"), ("cc-by-4.0", "cc by 4 0"),
        ("cc0-1.0", "cc0 1 0"), ("gpl-2.0", "gpl 2 0"), ("gpl-3.0", "gpl 3 0"), ("isc", "isc"), ("lgpl", "lgpl"), ("mit", "mit"), ("mpl-2.0", "mpl 2 0"), ("unlicense", "unlicense"))],
]

_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_KEEP).split()


def in_order(template: list[bytes], words: list[bytes]) -> int:
    """How many words of the template stand among ``words`` in its order (their longest common subsequence)."""
    row = [0] * (len(words) + 1)
    for t in template:
        last = 0
        for j, w in enumerate(words, 1):
            last, row[j] = row[j], last + 1 if t == w else max(row[j], row[j - 1])
    return row[-1]


class Index:
    """Postings of the templates' rarest words, given in how many of ``total`` texts each word stands."""

    def __init__(self, frequency: dict[str, int], total: int, base=None, notices=None):
        self.idf = {}
        self.templates: list[tuple[str, list[bytes], list[list[bytes]], int, bool]] = []
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        items = [(k, v, [v], True) for k, v in (base or BASE).items()] + [(*x, False) for x in (notices or NOTICES)]
        for label, notice, phrases, whole in items:
            words = notice.encode().split()
            for w in words:
                self.idf[w] = math.log((total + 1) / (frequency.get(w.decode(), 0) + 1))
            rare = sorted(set(words), key=lambda w: (-self.idf[w], w))[: 1 if whole else RARE]
            places = [(w, i) for i, w in enumerate(words) if w in rare]
            if whole:  # one place is enough, as all must hold
                places = places[:1]
            for w, i in places:
                self.postings.setdefault(w, []).append((len(self.templates), i))
            self.templates.append((label, words, [p.encode().split() for p in phrases], 1 if whole else min(2, len(places)), whole))

    def share(self, words: list[bytes], template: int, start: int) -> float:
        """The share of a template's words that stand in order about ``start``, 0 if a mandatory phrase is missing there."""
        _, notice, phrases, _, _ = self.templates[template]
        near = words[max(0, start - SLACK) : max(0, start + len(notice) + SLACK)]
        if not all(any(near[i : i + len(p)] == p for i in range(len(near) - len(p) + 1)) for p in phrases):
            return 0.0
        return in_order(notice, near) / len(notice)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[str, int]], dict[str, float]]:
        """Places of base phrases as (label, start), and the best score of each label found."""
        known = self.postings.keys() & words
        if not known:
            return [], {}
        at: dict[bytes, list[int]] = {w: [] for w in sorted(known, key=lambda w: (-self.idf[w], w))}
        for i, w in enumerate(words):
            if w in known:
                at[w].append(i)
        base, score, votes = [], {}, {}
        for w, places in at.items():  # rarest first
            for t, p in self.postings[w]:
                label, notice, _, least, whole = self.templates[t]
                if whole:
                    found = [(label, i - p) for i in places if i >= p and words[i - p : i - p + len(notice)] == notice]
                    base += found
                    score |= {label: 1.0 for _ in found}
                    continue
                if score.get(label, 0.0) >= 1.0:
                    continue
                # votes by start: those of one alignment lie in the same stretch of SLACK + 1 starts, or in the next
                mine, tried = votes.setdefault(t, ({}, {}))
                for i in places:
                    start = i - p
                    cell = start // (SLACK + 1)
                    near = [x for c in (cell - 1, cell, cell + 1) for x in mine.get(c, ()) if abs(x[0] - start) <= SLACK]
                    mine.setdefault(cell, set()).add((start, p))
                    if len({q for _, q in near} | {p}) < least:
                        continue
                    for x in sorted({start, *(x for x, _ in near)} - tried.keys()):
                        tried[x] = self.share(words, t, x)
                        if tried[x] >= LEAST_SCORE:
                            score[label] = max(tried[x], score.get(label, 0.0))
                    if score.get(label, 0.0) >= 1.0:
                        break
        return sorted(base, key=lambda x: (x[1], x[0])), score


def frequencies(docs: DataFrame, text: str = "text", base=None, notices=None) -> tuple[dict[str, int], int]:
    """In how many of all texts each template word stands, and how many texts there are. Tasks count, Spark adds up; only
    the templates' own words come back."""
    vocabulary = {w for notice in [*(base or BASE).values(), *(x[1] for x in (notices or NOTICES))] for w in notice.encode().split()}

    def run(batches):
        for batch in slices(batches):
            counts = Counter(w for raw in batch.column(0).to_pylist() for w in vocabulary.intersection(words_of(raw)))
            rows = [("", batch.num_rows), *((w.decode(), n) for w, n in counts.items())]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["word", "n"])
    counted = docs.select(text_of(text).cast("binary").alias("__bytes")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    out = {r["word"]: r["n"] for r in counted.collect()}
    return out, out.pop("", 0)


def scan(docs: DataFrame, index: Index, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns (all, if None) with ``licence``: the number of words, the base phrases' places (label, start) and each found label's score."""
    carry = [c for c in (docs.columns if carry is None else carry) if c != "licence"]
    place = pa.struct([("label", pa.string()), ("start", pa.int64())])
    label = pa.struct([("label", pa.string()), ("score", pa.float64())])
    kind = pa.struct([("n_words", pa.int64()), ("base", pa.list_(place)), ("labels", pa.list_(label))])

    def run(batches):
        for batch in slices(batches):
            out = []
            for raw in batch.column(batch.num_columns - 1).to_pylist():
                words = words_of(raw)
                base, score = index.scan(words)
                out.append({"n_words": len(words), "base": [{"label": k, "start": i} for k, i in base], "labels": [{"label": k, "score": s} for k, s in sorted(score.items())]})
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, kind)], [*carry, "licence"])
    schema = T.StructType([*docs.select(*carry).schema.fields, *T._parse_datatype_string("licence struct<n_words: bigint, base: array<struct<label: string, start: bigint>>, labels: array<struct<label: string, score: double>>>").fields])
    return docs.select(*carry, text_of(text).cast("binary").alias("__bytes")).mapInArrow(run, schema)

"""Licence scans with a positional rare-token index.

Corpus counts give each licence word its IDF. Every template posts its rarest words with their positions; a file's
occurrences of posted words vote for (template, start), so postings intersect by relative position. A start with enough
votes is verified: the template's mandatory key phrases must stand, word for word, where the start puts them, give or
take a small drift. The base phrases are found at all their places.

Defined results: a null or empty text has no words and no labels; a document without a word of the index scores 0; ties
between starts go to the smallest; rows that repeat an id are scanned each; an empty table gives an empty result; other
columns are not touched.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: The phrases of the base rule and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Opening passages of public licence texts, with the phrases that must be there.
TEMPLATES = {
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    "apache": ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("licensed under the apache license version 2 0", "except in compliance with the license")),
    "gpl": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version", ("is free software you can redistribute it", "gnu general public license")),
    "lgpl": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    "agpl": ("it under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "provided that the following conditions are met")),
    "mpl": ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("subject to the terms of the mozilla public license",)),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", ("for any purpose with or without fee is hereby granted",)),
    "unlicense": ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ("free and unencumbered software released into the public domain",)),
    "cc-by": ("this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
}
#: How short notices name a licence, what stands before the names, and identifiers after SPDX-License-Identifier.
NAMES = {
    "mit": ("the mit license",), "apache": ("the apache license",), "gpl": ("the gnu general public license",), "lgpl": ("the gnu lesser general public license",), "agpl": ("the gnu affero general public license",),
    "bsd": ("the bsd license", "a bsd license"), "mpl": ("the mozilla public license",), "isc": ("the isc license",), "cc-by": ("cc by 3", "cc by 4"), "cc-by-sa": ("cc by sa",), "cc-by-nc": ("cc by nc",), "cc-by-nd": ("cc by nd",),
}
OPENINGS = ("licensed under", "released under", "distributed under", "available under")
IDENTIFIERS = {"mit": "mit", "apache": "apache 2 0", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "bsd": "bsd", "mpl": "mpl", "isc": "isc", "unlicense": "unlicense", "cc-by": "cc by 4", "cc-by-sa": "cc by sa", "cc-by-nc": "cc by nc", "cc-by-nd": "cc by nd"}


def with_notices(templates: dict) -> dict:
    """The templates and those of short notices, each of them a mandatory phrase as a whole. What stands before the first / of a template's name is its label."""
    said = [(label, f"{o} {n}") for label, names in NAMES.items() for n in names for o in OPENINGS] + [(label, f"spdx license identifier {i}") for label, i in IDENTIFIERS.items()]
    return templates | {f"{label}/{body}": (body, (body,)) for label, body in said}


#: Rarest words that a template posts, of one that is short half of its words but LEAST of them; share of them that must vote for a start; words that a start may drift.
POSTED, LEAST, VOTES, DRIFT = 8, 3, 0.5, 3

_KEEP = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_KEEP).split() if text else []


def vocabulary(templates: dict) -> set[bytes]:
    return {w for body, _ in templates.values() for w in body.encode().split()}


def document_frequencies(df: DataFrame, templates: dict, text_col: str = "text") -> tuple[int, dict[bytes, int]]:
    """Documents, and how many hold each licence word, over the whole corpus. Only the words of the templates are counted, so the table is as small as they are."""
    known = vocabulary(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = 0, Counter()
        for batch in batches:
            for t in batch.column(0):
                n += 1
                seen.update(known.intersection(words_of(t.as_py())))
        yield pa.RecordBatch.from_pydict({"word": pa.array(["", *(w.decode() for w in seen)], pa.string()), "n": pa.array([n, *seen.values()], pa.int64())})

    rows = df.select(df[text_col].alias("text")).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r.word.encode(): r.n for r in rows}
    return found.pop(b"", 0), found


class Index:
    """Postings of the templates' highest-IDF words."""

    def __init__(self, templates: dict, n: int, df: dict[bytes, int], posted: int = POSTED):
        self.bodies = {k: body.encode().split() for k, (body, _) in templates.items()}
        self.idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) for w in vocabulary(templates)}
        self.postings: dict[bytes, list[tuple[str, int]]] = defaultdict(list)
        self.needed, self.keys = {}, {}
        for k, (_, phrases) in templates.items():
            words = self.bodies[k]
            rare = sorted(set(words), key=lambda w: (-self.idf[w], w))[: max(LEAST, min(posted, len(set(words)) // 2))]
            for w in rare:
                for i, x in enumerate(words):
                    if x == w:
                        self.postings[w].append((k, i))
            self.needed[k] = max(2, math.ceil(VOTES * len(rare)))
            at = {p: b" ".join(words) for p in phrases}
            self.keys[k] = [(p.encode().split(), (b" " + at[p] + b" ").split(b" " + p.encode() + b" ")[0].count(b" ")) for p in phrases]

    def scan(self, words: list[bytes]) -> dict[str, tuple[float, int]]:
        """(agreement, start) of each label with a verified template: the largest share of a template's words that stand at their place."""
        postings, votes = self.postings, defaultdict(set)
        for i, w in enumerate(words):
            if w in postings:
                for k, j in postings[w]:
                    votes[k, i - j].add(w)
        near: dict[tuple[str, int], set] = {}
        for (k, start), _ in votes.items():  # words inserted or left out shift what follows
            near[k, start] = set().union(*(votes.get((k, start + d), ()) for d in range(-DRIFT, DRIFT + 1)))
        out: dict[str, tuple[float, int]] = {}
        for (k, start), got in sorted(near.items(), key=lambda x: x[0]):
            if len(got) < self.needed[k] or not self.verified(words, k, start):
                continue
            body = self.bodies[k]
            share = sum(1 for j, w in enumerate(body) if w in words[max(0, start + j - DRIFT) : max(0, start + j + DRIFT + 1)]) / len(body)
            label = k.split("/")[0]
            if label not in out or share > out[label][0]:
                out[label] = share, max(start, 0)
        return out

    def verified(self, words: list[bytes], k: str, start: int) -> bool:
        return all(any(i >= 0 and words[i : i + len(p)] == p for i in range(start + j - DRIFT, start + j + DRIFT + 1)) for p, j in self.keys[k])


def base_places(words: list[bytes], phrases: dict[str, str] = BASE) -> list[tuple[int, str]]:
    """(start, label) of all places of the base phrases."""
    line, out = b" " + b" ".join(words) + b" ", []
    for phrase, label in phrases.items():
        find, at, seen, word = b" " + phrase.encode() + b" ", line.find(b" " + phrase.encode() + b" "), 0, 0
        while at >= 0:
            word += line.count(b" ", seen, at)
            seen = at
            out.append((word, label))
            at = line.find(find, at + 1)
    return sorted(out)


def license_scan(df: DataFrame, templates: dict | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches (label, start, agreement)."""
    templates = with_notices(TEMPLATES) if templates is None else templates
    small_batches(df.sparkSession)
    n, found = document_frequencies(df, templates, text_col)
    index = Index(templates, n, found)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("matches", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("agreement", pa.float64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(t.as_py())
                base = base_places(words)
                own = index.scan(words)
                labels = {x for _, x in base}
                rows.append({"doc_id": i, "n_words": len(words), "n_base": len(base), "first_word": base[0][0] if base else None, "last_word": base[-1][0] if base else None, "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(labels | set(own))), "score": max([0.0, *(s for s, _ in own.values())]), "matches": [{"label": k, "start": at, "agreement": s} for k, (s, at) in sorted(own.items())]})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    ddl = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, matches array<struct<label:string,start:bigint,agreement:double>>"
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, ddl)

"""Licence texts and notices, found through a positional index of rare words.

Inverse document frequencies of all template words are counted over the whole corpus. A notice counts
only with the mandatory key phrase of its template, so the index holds the rarest words of each phrase
(``ROOTS``) with their positions in it. A file is looked up by the licence words it has, those of highest
inverse document frequency first; the postings of a template's words are intersected by relative
position, that is by the place where the phrase would begin, and a template whose words do not agree on
one goes no further. All words of a phrase are required, so nothing is lost. Where the whole phrase
stands, the template is aligned at every start whose window holds it, and the best alignment is the
match. Fixed phrases are templates whose words must all stand in a row. Words are compared by 64-bit
hash while searching and by their bytes at the end.

Defined results: null or empty texts have no words, labels or places. Repeated ids are judged row by
row. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from attestra.llm.common import Words, hash_words, id_and_text, small_batches, text_slices

# The phrases that count as places of a licence, with their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Wording of public licences (label, notice or clause, mandatory key phrase).
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "has waived all copyright"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    ("all-rights-reserved", "all rights reserved no part of this publication may be reproduced", "all rights reserved"),
)

ROOTS = 3
SLACK = 3
COVERAGE = 0.6


def template_words() -> list[bytes]:
    texts = [text for _, text, _ in TEMPLATES] + [text for text, _ in PHRASES]
    return sorted({word for text in texts for word in text.encode().split()})


def document_frequencies(docs: DataFrame, words: list[bytes]) -> dict[bytes, int]:
    """In how many documents each template word occurs, over the whole table."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = hash_words(words)
        order = np.argsort(hashes)
        ranked = hashes[order]
        counts = np.zeros(len(words), np.int64)
        for batch in text_slices(batches):
            found = Words(batch.column("text"))
            place = np.minimum(np.searchsorted(ranked, found.hash), len(ranked) - 1)
            known = ranked[place] == found.hash
            pairs = np.unique(found.row_of_word()[known] * len(words) + place[known])
            counts[order] += np.bincount(pairs % len(words), minlength=len(words))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(words))), pa.array(counts)], ["word", "n"]
        )

    rows = docs.select("text").mapInArrow(task, "word long, n long").groupBy("word").sum("n").collect()
    return {words[row[0]]: row[1] for row in rows}


class Template:
    def __init__(self, label: str, text: str, mandatory: str, exact: bool):
        self.label, self.exact = label, exact
        self.words = text.encode().split()
        self.mandatory = mandatory.encode().split()

    def roots(self, frequency: dict[bytes, int]) -> list[tuple[bytes, int]]:
        """The rarest words of the mandatory phrase, rarest first, with a position of each."""
        order = sorted(set(self.mandatory), key=lambda word: (frequency.get(word, 0), word))
        return [(word, self.mandatory.index(word)) for word in order[:ROOTS]]


class Index:
    """Postings of the roots of all templates: word to templates and positions in their phrases."""

    def __init__(self, templates: list[Template], frequency: dict[bytes, int]):
        self.templates = templates
        roots = [template.roots(frequency) for template in templates]
        self.rare = np.unique(hash_words(sorted({word for each in roots for word, _ in each})))
        self.roots = [
            [(int(np.searchsorted(self.rare, hash_words([word])[0])), position) for word, position in each]
            for each in roots
        ]

    def candidates(self, words: Words) -> list[tuple[int, int, int]]:
        """(row, word, template) wherever the roots of a template agree on the word at which its
        mandatory phrase would begin; in reading order."""
        if not len(words.hash):
            return []
        slot = np.minimum(np.searchsorted(self.rare, words.hash), len(self.rare) - 1)
        places = np.flatnonzero(self.rare[slot] == words.hash)
        order = np.argsort(slot[places], kind="stable")
        bounds = np.searchsorted(slot[places][order], np.arange(len(self.rare) + 1))
        found = []
        for number, roots in enumerate(self.roots):
            begins = None
            for word, position in roots:
                here = places[order[bounds[word] : bounds[word + 1]]] - position
                begins = here if begins is None else np.intersect1d(begins, here, assume_unique=True)
                if not len(begins):
                    break
            begins = begins[begins >= 0]
            rows = np.searchsorted(words.bounds, begins, side="right") - 1
            inside = begins + len(self.templates[number].mandatory) <= words.bounds[rows + 1]
            begins, rows = begins[inside], rows[inside]
            found += zip(rows.tolist(), begins.tolist(), [number] * len(begins))
        return sorted(found)

    def verify(self, words: Words, template: Template, row: int, start: int) -> tuple | None:
        """(best share of the template found near a mandatory phrase, share, first and last word of
        the match around it) or None. ``start``: where the phrase begins."""
        low, high = int(words.bounds[row]), int(words.bounds[row + 1])
        size, phrase = len(template.words), template.mandatory
        if any(words.word(start + i) != word for i, word in enumerate(phrase)):
            return None
        if template.exact:
            return 1.0, 1.0, start, start + size - 1
        begins = range(start + len(phrase) - size - 2 * SLACK, start + SLACK + 1)
        first = max(low, begins[0] - SLACK)
        near = [words.word(i) for i in range(first, min(high, begins[-1] + size + 2 * SLACK))]
        known = set(near)
        if sum(word in known for word in template.words) < COVERAGE * size:
            return None
        top, best = 0.0, None
        for begin in begins:
            window = near[max(low, begin - SLACK) - first : begin + size + 2 * SLACK - first]
            at, hits = max(low, begin - SLACK), []
            origin = at
            for word in template.words:  # in order, each within reach of the one before
                reach = window[at - origin : at - origin + 2 * SLACK + 1]
                if word in reach:
                    at += reach.index(word) + 1
                    hits.append(at - 1)
            share = len(hits) / size
            if share < COVERAGE:
                continue
            top = max(top, share)
            # A notice beside this one holds a phrase of its own. Of equal shares, that of fewer words.
            around = hits[0] <= start and start + len(phrase) - 1 <= hits[-1]
            found = (around, share, hits[0] - hits[-1], hits[0], hits[-1])
            best = found if best is None else max(best, found)
        return (top, best[1], *best[3:]) if best else None


SCHEMA = (
    "id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
    "labels array<string>, score double, matches array<struct<label:string,first:long,last:long,share:double>>"
)


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document row: word count, places of the fixed phrases and their labels, labels of
    all licences found, best share of a template found, and every match with its words."""
    small_batches(docs.sparkSession)
    docs = id_and_text(docs, id_column, text_column)
    frequency = document_frequencies(docs, template_words())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(
            [Template(label, text, text, True) for text, label in PHRASES]
            + [Template(*template, False) for template in TEMPLATES],
            frequency,
        )
        for batch in text_slices(batches):
            words = Words(batch.column("text"))
            rows = [
                {"base": [], "base_labels": set(), "labels": set(), "score": 0.0, "matches": {}}
                for _ in range(batch.num_rows)
            ]
            for row, start, number in index.candidates(words):
                template = index.templates[number]
                match = index.verify(words, template, row, start)
                if match is None:
                    continue
                top, share, first, last = match
                low, into = int(words.bounds[row]), rows[row]
                into["labels"].add(template.label)
                into["score"] = max(into["score"], top)
                # A notice that holds its phrase twice is one match.
                into["matches"][number, first, last] = {
                    "label": template.label, "first": first - low, "last": last - low, "share": share
                }
                if template.exact:
                    into["base"].append(first - low)
                    into["base_labels"].add(template.label)
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "id": owner,
                        "n_words": int(count),
                        "n_base": len(row["base"]),
                        "first_word": min(row["base"], default=None),
                        "last_word": max(row["base"], default=None),
                        "base_labels": sorted(row["base_labels"]),
                        "labels": sorted(row["labels"]),
                        "score": row["score"],
                        "matches": list(row["matches"].values()),
                    }
                    for owner, count, row in zip(
                        batch.column("id").to_pylist(), np.diff(words.bounds), rows
                    )
                ],
                schema=ARROW,
            )

    return docs.mapInArrow(task, SCHEMA)


ARROW = pa.schema(
    [
        *[(name, pa.int64()) for name in ("id", "n_words", "n_base", "first_word", "last_word")],
        ("base_labels", pa.list_(pa.string())),
        ("labels", pa.list_(pa.string())),
        ("score", pa.float64()),
        (
            "matches",
            pa.list_(
                pa.struct(
                    [("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())]
                )
            ),
        ),
    ]
)

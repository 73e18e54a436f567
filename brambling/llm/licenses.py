"""License scans with a positional rare-token index.

The index posts, for each licence template, only its words of highest inverse document
frequency among the templates, with their positions. A text's own words are looked up
there; each posting proposes a place (word position minus template position), and places
that several rare words agree on, within a small drift, are candidates. A candidate
counts once its mandatory key phrases stand, word for word, where the template has
them; its score is the weighted share of the template's words found there.

Templates of up to ``SHORT`` words are phrases: one rare word posts them, and all their
words are mandatory at once.

Defined results: a null or empty text has no words, no places, an empty list of labels
and score 0; repeated rows repeat; ties between places go to the first. Whole texts,
map-only, memory bounded by an Arrow batch.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from . import base

SHORT, RARE, DRIFT, AGREE = 12, 8, 6, 0.4


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...] = ()  #: phrases that must be there; none: the whole text
    base: bool = False


#: Phrases and openings of public licences.
TEMPLATES = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
    Template("gpl", "gnu general public license"),
    Template("gpl-2", "gnu general public license version 2"),
    Template("gpl-3", "gnu general public license version 3"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("mpl-2", "mozilla public license version 2"),
    Template("mpl-2", "mozilla public license v 2 0"),
    Template("bsd", "bsd 3 clause license"),
    Template("bsd", "bsd 2 clause license"),
    Template("cc0", "cc0 1 0 universal"),
    Template("cc-by", "creative commons attribution 4 0"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nc", "creative commons attribution noncommercial"),
    Template("epl-2", "eclipse public license 2 0"),
    Template("mit", "spdx license identifier mit"),
    Template("apache-2", "spdx license identifier apache 2 0"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions",
        ("permission is hereby granted free of charge", "deal in the software without restriction"),
    ),
    Template(
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
        "the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by "
        "applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied",
        ("apache license version 2", "except in compliance with the license"),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met redistributions of source code must retain the above copyright notice this list of "
        "conditions and the following disclaimer",
        ("redistribution and use in source and binary forms", "must retain the above copyright notice"),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies",
        ("for any purpose with or without fee", "permission notice appear in all copies"),
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use "
        "compile sell or distribute this software",
        ("free and unencumbered software", "released into the public domain"),
    ),
    Template(
        "gpl-2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation either version 2 of the license or at your option any later "
        "version this program is distributed in the hope that it will be useful but without any warranty",
        ("terms of the gnu general public license", "either version 2 of the license"),
    ),
    Template(
        "gpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation either version 3 of the license or at your option any later "
        "version this program is distributed in the hope that it will be useful but without any warranty",
        ("terms of the gnu general public license", "either version 3 of the license"),
    ),
    Template(
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general "
        "public license as published by the free software foundation either version 2 1 of the license or at your option "
        "any later version",
        ("terms of the gnu lesser general public license", "published by the free software foundation"),
    ),
    Template(
        "agpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general "
        "public license as published by the free software foundation either version 3 of the license or at your option any "
        "later version",
        ("terms of the gnu affero general public license", "published by the free software foundation"),
    ),
    Template(
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
        "distributed with this file you can obtain one at http mozilla org mpl 2 0",
        ("subject to the terms of the mozilla public license", "if a copy of the mpl was not distributed with this file"),
    ),
    Template(
        "bsl-1",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license the software to use reproduce display distribute execute and "
        "transmit the software and to prepare derivative works of the software",
        ("any person or organization obtaining a copy", "use reproduce display distribute execute and transmit the software"),
    ),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable "
        "for any damages arising from the use of this software permission is granted to anyone to use this software for any "
        "purpose including commercial applications and to alter it and redistribute it freely",
        ("in no event will the authors be held liable", "alter it and redistribute it freely"),
    ),
    Template(
        "cc0",
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
        ("to the extent possible under law", "waived all copyright and related or neighboring rights"),
    ),
)
SCHEMA = "doc_id long, n_words long, label string, base boolean, start long, n_template_words long, score double"


class Index:
    def __init__(self, templates: tuple[Template, ...]):
        self.templates = templates
        self.words = [base.words(t.text.encode()) for t in templates]
        holds: dict[bytes, int] = defaultdict(int)
        for w in self.words:
            for x in set(w):
                holds[x] += 1
        self.idf = {x: math.log(1 + len(templates) / n) for x, n in holds.items()}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.short = [len(w) <= SHORT for w in self.words]
        self.anchors = []
        self.keys = []
        for k, w in enumerate(self.words):
            first = {x: i for i, x in reversed(list(enumerate(w)))}
            rare = sorted(first, key=lambda x: (-self.idf[x], first[x]))[: 1 if self.short[k] else RARE]
            for i, x in enumerate(w):
                # A phrase is proposed by one place of one word: all others are verified.
                if x in rare and (not self.short[k] or i == first[x]):
                    self.postings[x].append((k, i))
            self.anchors.append(sum(self.idf[x] for x in w if x in rare))
            phrases = [base.words(p.encode()) for p in templates[k].keys]
            self.keys.append([(p, next(i for i in range(len(w)) if w[i : i + len(p)] == p)) for p in phrases])

    def places(self, text: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start, score), by start, then template."""
        if self.postings.keys().isdisjoint(text):
            return []
        votes: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
        for i, w in enumerate(text):
            for k, offset in self.postings.get(w, ()):
                votes[k][i - offset] += self.idf[w]
        found = []
        for k, starts in votes.items():
            template = self.words[k]
            if self.short[k]:
                found += [(k, s, 1.0) for s in starts if s >= 0 and text[s : s + len(template)] == template]
                continue
            taken: list[int] = []
            for s in sorted(starts, key=lambda s: (-starts[s], s)):  # a word that stands twice in a template votes for wrong starts too
                near = sum(v for x in range(s - DRIFT, s + DRIFT + 1) if (v := starts.get(x)))
                if near >= AGREE * self.anchors[k] and all(abs(s - x) > 2 * DRIFT for x in taken) and (hit := self.verify(k, text, s)):
                    found.append((k, *hit))
                    taken.append(s)
        return sorted(found, key=lambda x: (x[1], x[0]))

    def verify(self, k: int, text: list[bytes], start: int) -> tuple[int, float] | None:
        for phrase, offset in self.keys[k]:
            low, high = max(0, start + offset - 2 * DRIFT), start + offset + 2 * DRIFT
            if not any(text[i : i + len(phrase)] == phrase for i in range(low, high + 1)):
                return None
        template = self.words[k]
        window = set(text[max(0, start - DRIFT) : max(0, start) + len(template) + 2 * DRIFT])
        whole = sum(self.idf[w] for w in template)
        return max(0, start), sum(self.idf[w] for w in template if w in window) / whole


def _run(docs: DataFrame, templates, schema: str, each, id_col: str, text_col: str) -> DataFrame:
    base.arrow_limits(docs.sparkSession)

    def run(batches):
        index = Index(templates)
        for batch in batches:
            rows: list[tuple] = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                text = base.words(t)
                each(rows, index, d, text, index.places(text))
            fields = [f.split() for f in schema.split(", ")]
            kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
            columns = list(zip(*rows)) if rows else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])

    return base.texts(docs, id_col, text_col).mapInArrow(run, schema)


def find_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per place of a licence: doc_id, n_words, label, base, start (in words), n_template_words, score."""

    def each(rows, index, d, text, places):
        for k, start, score in places:
            t = index.templates[k]
            rows.append((d, len(text), t.label, t.base, start, len(index.words[k]), score))

    return _run(docs, templates, SCHEMA, each, id_col, text_col)


def license_labels(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_words; n_base, first_word, last_word and base_labels of the
    base phrases; labels of all templates; score of the best place, 0 without any."""

    def each(rows, index, d, text, places):
        own = [(index.templates[k].label, s) for k, s, _ in places if index.templates[k].base]
        starts = [s for _, s in own]
        rows.append((
            d, len(text), len(own), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({x for x, _ in own})), ",".join(sorted({index.templates[k].label for k, _, _ in places})),
            max((x for _, _, x in places), default=0.0),
        ))

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return _run(docs, templates, schema, each, id_col, text_col)


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_labels(base.table(spark, sf_dir, "documents"))

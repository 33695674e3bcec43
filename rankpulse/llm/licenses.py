"""License scan by a positional index of rare words.

Words of the licence templates are weighed by their inverse document frequency over all documents. All of them are indexed: word -> (template,
position). Of the licence words that a file has, the highest-weighted of each template are looked up; each place of such a word in the file
proposes, for each posting, the place where the template would begin. Templates most of whose weight isn't in the file at all are passed over
before that. Places on which enough of the looked-up weight agrees are candidates; as words may have been put in or left out, a template of some
length lets them drift apart a little. A candidate counts if one of the template's mandatory phrases stands where the template has it and
most of the template's weight is found in place, in whose share its score is.

The base phrases are templates of their own, exact and wholly mandatory: their places are those of their candidates that are verified.
A file that has a phrase has its rarest word, and each place of that word proposes the phrase, so none is missed.

The index is a table of fixed size, so scanning is one pass over the documents without a shuffle; document frequencies are one more pass
that counts the templates' words only.

Null text is empty: no words, no labels, score 0. Null ids and repeated rows pass through; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankpulse.llm.common import text_of

# Texts and notices of common licences, as (label, text, mandatory phrases).
TEMPLATES = (
    ("mit", "Released under the MIT License", ("mit license",)),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
        Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
        and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
        ("permission is hereby granted free of charge", "associated documentation files"),
    ),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("apache", "Licensed under the Apache License, Version 2.0", ("apache license",)),
    (
        "apache",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        ("except in compliance with the license", "specific language governing permissions"),
    ),
    ("gpl", "This work is licensed under the GNU General Public License version 3", ("general public license",)),
    (
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either
        version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
        ("gnu general public license as published",),
    ),
    ("lgpl", "GNU Lesser General Public License as published by the Free Software Foundation", ("lesser general public license",)),
    ("agpl", "GNU Affero General Public License as published by the Free Software Foundation", ("affero general public license",)),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code
        must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
        ("source and binary forms",),
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", ("source and binary forms",)),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ("mozilla public license",)),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
        permission notice appear in all copies.""",
        ("with or without fee",),
    ),
    (
        "zlib",
        """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software.""",
        ("origin of this software must not be misrepresented",),
    ),
    ("boost", "Distributed under the Boost Software License, Version 1.0", ("boost software license",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("all-rights-reserved", "All rights reserved", ("all rights reserved",)),
)
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
#: Words of a template that are looked up, the share of their weight that must agree on a place, and the share of all its weight that must be there.
RARE = 8
AGREE = 0.6
#: Words that a template of so many words may drift by.
DRIFT = 25


def words_of(text: str) -> list[str]:
    """Words of a text with A-Z in lower case."""
    return WORDS.findall(text.translate(LOWER))


def known_words() -> list[str]:
    """The words of the templates, all of which hold those of the base phrases too."""
    return sorted({w for _, t, _ in TEMPLATES for w in words_of(t)})


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[int, dict[str, int]]:
    """How many documents there are, and how many have each word of the templates."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = F.split(F.translate(text_of(text), upper, upper.lower()), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    hits = docs.select(F.array_intersect(F.array(*map(F.lit, known_words())), words).alias("w"))
    n = hits.count()
    rows = hits.select(F.explode("w").alias("w")).groupBy("w").count().collect()  # one row a known word
    return n, {r["w"]: r["count"] for r in rows}


class Template:
    """A licence text: its words with their weights and positions, and where its mandatory phrases stand."""

    def __init__(self, label: str, words: list[str], phrases: list[list[str]], idf: dict[str, float], base: bool):
        self.label, self.words, self.base = label, words, base
        self.drift = 0 if base else len(words) // DRIFT
        self.postings: dict[str, list[int]] = defaultdict(list)
        for p, w in enumerate(words):
            self.postings[w].append(p)
        self.weight = {w: idf[w] * len(at) for w, at in self.postings.items()}
        self.total = sum(self.weight.values())
        self.phrases = [(next(i for i in range(len(words)) if words[i : i + len(p)] == p), p) for p in phrases]
        self.idf = idf

    def candidates(self, places: dict[str, list[int]]) -> list[int]:
        """Where the template may begin, from the places of the file's highest-weighted words that it has."""
        rare = sorted((w for w in self.postings if w in places), key=lambda w: (-self.idf[w], w))[: 1 if self.base else RARE]
        votes: dict[int, float] = defaultdict(float)
        for w in rare:
            for place in places[w]:
                for p in self.postings[w]:
                    votes[place - p] += self.idf[w]
        enough = AGREE * sum(self.idf[w] for w in rare)
        begins, found = sorted(votes), []
        if not self.drift:
            return [b for b in begins if votes[b] >= enough]
        i, total = 0, 0.0
        for j, b in enumerate(begins):
            total += votes[b]
            while begins[i] < b - self.drift:
                total -= votes[begins[i]]
                i += 1
            if total >= enough:
                found.append(max(begins[i : j + 1], key=lambda x: (votes[x], -x)))
        return sorted(set(found))

    def verify(self, begin: int, words: list[str], places: dict[str, list[int]]) -> float:
        """The share of the template's weight that stands in place, 0 without a mandatory phrase."""
        around = range(-self.drift, self.drift + 1)
        if not any(0 <= begin + at + d and words[begin + at + d : begin + at + d + len(p)] == p for at, p in self.phrases for d in around):
            return 0.0
        hit = 0.0
        for w, at in self.postings.items():
            there = places.get(w)
            if there:
                for p in at:
                    i = bisect_left(there, begin + p - self.drift)
                    hit += self.idf[w] * (i < len(there) and there[i] <= begin + p + self.drift)
        return hit / self.total


class Index:
    """The templates by word."""

    def __init__(self, documents: int, frequency: dict[str, int]):
        self.idf = {w: math.log((documents + 1) / (frequency.get(w, 0) + 1)) + 1 for w in known_words()}
        self.templates = [Template(label, words_of(t), [p.split() for p in phrases], self.idf, False) for label, t, phrases in TEMPLATES]
        self.templates += [Template(label, p.split(), [p.split()], self.idf, True) for p, label in BASE]
        self.holding: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for i, t in enumerate(self.templates):
            for w, weight in t.weight.items():
                self.holding[w].append((i, weight / t.total))

    def scan(self, words: list[str]) -> tuple[list[int], set[str], dict[str, float]]:
        """Places and labels of base phrases, and the best score by label of the other templates found."""
        shares = [0.0] * len(self.templates)
        own = self.holding.keys() & set(words)
        for w in own:
            for i, share in self.holding[w]:
                shares[i] += share
        wanted = [t for t, share in zip(self.templates, shares, strict=True) if share >= (0.999 if t.base else AGREE)]
        base_places: list[int] = []
        base: set[str] = set()
        found: dict[str, float] = {}
        if wanted:
            needed = {w for t in wanted for w in t.postings}
            places: dict[str, list[int]] = defaultdict(list)
            for i, w in enumerate(words):
                if w in needed:
                    places[w].append(i)
            for t in wanted:
                for begin in t.candidates(places):
                    score = t.verify(begin, words, places)
                    if t.base and score > 0.999:
                        base_places.append(begin)
                        base.add(t.label)
                    elif not t.base and score >= AGREE:
                        found[t.label] = max(found.get(t.label, 0.0), score)
        return base_places, base, found


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the columns of SCHEMA: word count, places of the base phrases, labels and the best score of a template (1 for a base phrase)."""
    index = Index(*document_frequencies(docs, text))

    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                words = words_of(t)
                places, base, found = index.scan(words)
                score = max([1.0] * bool(base) + list(found.values()), default=0.0)
                rows.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | found.keys())), min(1.0, score)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"first_word": "Int64", "last_word": "Int64"})

    kept = [c for c in docs.columns if c not in {x.split()[0] for x in SCHEMA.split(", ")}]
    return docs.select(*kept, run(text_of(text)).alias("_found")).select(*kept, "_found.*")

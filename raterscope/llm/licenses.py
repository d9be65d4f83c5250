"""License scans by a positional index of rare words.

The index holds for every template word its postings: the templates and positions where it stands. Two passes
over the texts, no text is shuffled:

1. Document frequencies of the template words, counted over all texts: some hundred sums.
2. Each text looks its template words up from the highest inverse document frequency downwards. The rarest word of a
   template's key phrases gives starts, ``place in the text - position in the template``, and the postings of
   the next rarer words are intersected with them by relative position until all words of the key
   phrases are met or no start is left. What is left is verified word by word.

No alignment that counts is passed over, and nothing is capped. A template's label needs all its key phrases at their places, so
the intersection over their words loses none. A template without key phrases needs ``LEAST_COVERAGE`` of
its weight: as soon as the words looked up and those the text lacks weigh more than the rest may, every covering
alignment has one of the words looked up at its place.

Base phrases are found at every place where their words stand consecutively, whatever the index says.

Defined results: null counts as empty; repeated rows and null ids keep their rows; ties between
alignments go to the earlier start; an empty table gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import alphanumeric_words, byte_texts

# The base phrases and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Template:
    """A license notice, and the phrases in it without which a text does not carry it."""

    label: str
    text: str
    keys: tuple[str, ...]


# Customary notices and sentences of public licenses.
TEMPLATES = (
    Template(
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at",
        ("apache license version 2 0",),
    ),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction",
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template("mit", "Licensed under the MIT License", ("mit license",)),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
        ("redistribution and use in source and binary forms", "conditions are met"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
        ("with or without fee is hereby granted",),
    ),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    Template("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation",
        ("gnu general public license",),
    ),
    Template("lgpl", "Licensed under the GNU Lesser General Public License", ("gnu lesser general public license",)),
    Template(
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        ("mozilla public license v 2 0",),
    ),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    Template("cc-by-nd", "Licensed under CC BY-ND 4.0", ("cc by nd",)),
    Template(
        "cc0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights",
        ("waived all copyright and related or neighboring rights",),
    ),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software",)),
    Template("proprietary", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited", ("unauthorized copying",)),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The "
        "above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
        "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN "
        "AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
        "OR OTHER DEALINGS IN THE SOFTWARE.",
        ("the rights to use copy modify merge publish distribute sublicense",),
    ),
    Template(
        "bsd-2-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
        "other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND "
        "CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        ("redistributions in binary form must reproduce", "other materials provided with the distribution this software"),
    ),
    Template(
        "bsd-3-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
        "other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of "
        "its contributors may be used to endorse or promote products derived from this software without specific "
        "prior written permission.",
        ("redistributions in binary form must reproduce", "neither the name of"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE "
        "SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
        "PROFITS",
        ("with or without fee is hereby granted", "the author disclaims all warranties"),
    ),
    Template(
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
        "software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions",
        ("to alter it and redistribute it freely",),
    ),
    Template(
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        "an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
        "the specific language governing permissions and limitations under the License.",
        ("apache license version 2 0", "specific language governing permissions"),
    ),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details.",
        ("gnu general public license as published by", "in the hope that it will be useful"),
    ),
    Template(
        "agpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation",
        ("gnu affero general public license",),
    ),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means.",
        ("unencumbered software", "as a compiled binary"),
    ),
    Template(
        "boost-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software "
        "and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, "
        "execute, and transmit the Software, and to prepare derivative works of the Software",
        ("any person or organization obtaining a copy of the software",),
    ),
)

# A template is found where so many distinct words of it ...
LEAST_WORDS = 2
# ... and so much of it stand, in addition to its key phrases.
LEAST_COVERAGE = 0.5
_ROUNDING = 1e-9


def _words(text: str) -> tuple[bytes, ...]:
    return tuple(alphanumeric_words(text.encode()))


class Index:
    """Postings and rarity of all template words, and the base phrases."""

    def __init__(self, templates: tuple[Template, ...], frequencies: dict[bytes, int], n_docs: int):
        self.templates = [(t.label, _words(t.text), tuple(_words(k) for k in t.keys)) for t in templates]
        known = {w for _, words, _ in self.templates for w in words}
        self.idf = {w: math.log((1 + n_docs) / (1 + frequencies.get(w, 0))) for w in known}
        # Where each key phrase stands in its template.
        self.key_places = [
            [(key, next(i for i in range(len(words)) if words[i : i + len(key)] == key)) for key in keys]
            for _, words, keys in self.templates
        ]
        # For each word its postings: template, position, and whether a key phrase covers that position.
        self.postings: dict[bytes, list[tuple[int, int, bool]]] = defaultdict(list)
        self.mandatory: list[set[bytes]] = []
        for number, (_, words, _) in enumerate(self.templates):
            keyed = {place + i for key, place in self.key_places[number] for i in range(len(key))}
            self.mandatory.append({words[i] for i in keyed})
            for position, word in enumerate(words):
                self.postings[word].append((number, position, position in keyed))
        self.rarity = {w: rank for rank, w in enumerate(sorted(known, key=lambda w: (-self.idf[w], w)))}
        self.total = [sum(self.idf[w] for w in words) for _, words, _ in self.templates]
        # A text without a template's rarest mandatory word cannot carry it; one without mandatory words is always looked up.
        self.gates: dict[bytes, list[int]] = defaultdict(list)
        for number, words in enumerate(self.mandatory):
            for word in [min(words, key=self.rarity.__getitem__)] if words else set(self.templates[number][1]):
                self.gates[word].append(number)
        self.base: dict[bytes, list[tuple[tuple[bytes, ...], str]]] = defaultdict(list)
        for phrase, label in BASE_PHRASES.items():
            words = _words(phrase)
            self.base[words[0]].append((words, label))

    def base_hits(self, words: list[bytes]) -> list[tuple[int, str]]:
        """Start and label of every base phrase."""
        hits = []
        for i, word in enumerate(words):
            if word in self.base:
                hits += [(i, label) for phrase, label in self.base[word] if tuple(words[i : i + len(phrase)]) == phrase]
        return hits

    def lookups(self, present: set[bytes]) -> dict[int, list[tuple[bytes, int]]]:
        """The postings to look up for each template that a text with these words may carry, rarest word first."""
        may = {n for w in present for n in self.gates.get(w, ()) if self.mandatory[n] <= present}
        wanted: dict[int, list[tuple[bytes, int]]] = {n: [] for n in may}
        # What the words not looked up may weigh: no alignment without the others reaches the least coverage.
        spare = {n: self.total[n] * LEAST_COVERAGE - _ROUNDING for n in may}
        standing = {n: sum(self.idf[w] for w in self.templates[n][1] if w in present) for n in may}
        may = {n for n in may if standing[n] >= spare[n]}
        for word in sorted(present & self.rarity.keys(), key=self.rarity.__getitem__) if may else ():
            for number, position, keyed in self.postings[word]:
                if number not in may:
                    continue
                if keyed:
                    wanted[number].append((word, position))
                elif not self.mandatory[number] and standing[number] >= spare[number]:
                    wanted[number].append((word, position))
                    standing[number] -= self.idf[word]
        return {n: wanted[n] for n in may}

    def alignments(self, words: list[bytes], present: set[bytes]) -> set[tuple[int, int]]:
        """Each (start, template) that may count: the postings of the text's rare words, intersected by relative position."""
        wanted = self.lookups(present)
        places: dict[bytes, list[int]] = {}
        for number, postings in wanted.items():
            places |= {w: [] for w, _ in (postings[:1] if self.mandatory[number] else postings)}
        if places:
            for i, word in enumerate(words):
                if word in places:
                    places[word].append(i)
        found = set()
        for number, postings in wanted.items():
            if self.mandatory[number]:
                (word, position), *others = postings
                starts = {i - position for i in places[word]}
                for word, position in others:
                    starts = {s for s in starts if 0 <= s + position < len(words) and words[s + position] == word}
                    if not starts:
                        break
            else:
                starts = {i - position for word, position in postings for i in places[word]}
            found |= {(start, number) for start in starts}
        return found

    def verified(self, words: list[bytes], number: int, start: int) -> float:
        """Share of the template, by inverse frequency, that stands at this start; 0 if a key phrase or enough words do not."""
        template = self.templates[number][1]
        for key, place in self.key_places[number]:
            at = start + place
            if at < 0 or tuple(words[at : at + len(key)]) != key:
                return 0.0
        standing = [w for i, w in enumerate(template) if 0 <= start + i < len(words) and words[start + i] == w]
        if len(set(standing)) < min(LEAST_WORDS, len(set(template))):
            return 0.0
        held = sum(self.idf[w] for w in standing)
        return min(1.0, held / self.total[number]) if self.total[number] > 0 else 1.0

    def found(self, words: list[bytes], present: set[bytes]) -> dict[str, tuple[float, int, int]]:
        """For each label its best coverage, with the start and end of that place."""
        best: dict[str, tuple[float, int, int]] = {}
        for start, number in sorted(self.alignments(words, present)):
            label, template, _ = self.templates[number]
            coverage = self.verified(words, number, start)
            if coverage >= LEAST_COVERAGE and coverage > best.get(label, (0.0,))[0]:
                best[label] = (coverage, max(start, 0), start + len(template))
        return best


def template_words(templates: tuple[Template, ...] = TEMPLATES) -> set[bytes]:
    return {w for t in templates for w in _words(t.text)}


def word_frequencies(docs: DataFrame, words: set[bytes], text_col: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many texts each of the given words stands, over all texts, and the number of texts. Runs a job.

    One row for each word and task is shuffled and one for each word collected: both are bounded by
    the templates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n_docs = Counter(), 0
        for batch in batches:
            for text in byte_texts(batch.column(0)):
                counts.update(words.intersection(alphanumeric_words(text)))
                n_docs += 1
        rows = [(None, n_docs), *counts.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())], ["word", "n"]
        )

    partial = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(run, "word binary, n long")
    sums = {r["word"] and bytes(r["word"]): r["n"] for r in partial.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {w: n for w, n in sums.items() if w is not None}, sums.get(None, 0)


SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "places array<struct<label: string, coverage: double, start: long, end: long>>"
)
_PLACES = pa.list_(
    pa.struct([("label", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])
)


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES
) -> DataFrame:
    """License findings of every text.

    The id; n_words; n_base, first_word and last_word of the base phrases' places; base_labels; labels
    (the templates' too); score, the best template coverage, 1 if a base phrase stands, else 0; and places, the
    words that each template's best alignment covers. Runs a job for the word frequencies.
    """
    frequencies, n_docs = word_frequencies(docs, template_words(templates), text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, frequencies, n_docs)
        known = index.postings.keys() | index.base.keys()
        for batch in batches:
            rows = []
            for text in byte_texts(batch.column(1)):
                words = alphanumeric_words(text)
                present = known.intersection(words)
                hits = index.base_hits(words) if not present.isdisjoint(index.base) else []
                found = index.found(words, present) if present else {}
                base = {label for _, label in hits}
                score = 1.0 if hits else max((c for c, _, _ in found.values()), default=0.0)
                rows.append(
                    (
                        len(words),
                        len(hits),
                        min(i for i, _ in hits) if hits else None,
                        max(i for i, _ in hits) if hits else None,
                        ",".join(sorted(base)),
                        ",".join(sorted(base | found.keys())),
                        score,
                        [{"label": k, "coverage": c, "start": s, "end": e} for k, (c, s, e) in sorted(found.items())],
                    )
                )
            columns = list(zip(*rows)) if rows else [()] * 8
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _PLACES]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [id_col, *names])

    id_type = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return narrow.mapInArrow(run, f"`{id_col}` {id_type}, {SCHEMA}")

"""License scans by a positional index of rare words.

The index lists, for each word of a set of notices and phrases, where it stands in them. Words
weigh by their inverse document frequency, counted over all documents. A file looks up its
rarest licence words: every word that is some phrase's rarest, and in each stretch of the file
the heaviest words of the notices. Each posting proposes where its notice would begin;
proposals that agree (to within SHIFT words, for filled-in names and small edits) are a
candidate, whose mandatory key phrases must then stand, word by word, at their places. A
phrase needs one proposal and all its words in a row.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixtext.llm.common import per_worker, raw_texts, taken

# Words of UTF-8 bytes after A-Z are lower-cased: digits, letters and everything beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

STRETCH = 64  # words of a file that choose their heaviest together
HEAVIEST = 12  # distinct notice words looked up in each stretch
SHIFT = 24  # words by which two proposals of one notice may differ
AGREEING = 4  # distinct notice words that must agree on a place
MENTION = 0.5  # score of a phrase; a whole notice scores its weighted share, 0.5 to 1
LEAST_SHARE = 0.5

# The phrases of the base and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Further phrases that name a licence, and their labels.
PHRASES = (
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("gnu general public license version 2", "gpl-2.0"),
    ("gnu general public license version 3", "gpl-3.0"),
    ("apache license version 2 0", "apache-2.0"),
    ("cc by nc", "cc-by-nc"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"),
    ("cc by nc sa", "cc-by-nc-sa"),
    ("cc by nc nd", "cc-by-nc-nd"),
    ("cc by 4 0", "cc-by-4.0"),
    ("cc0 1 0", "cc0"),
    ("creative commons attribution", "cc-by"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("bsd 2 clause", "bsd-2-clause"),
    ("bsd 3 clause", "bsd-3-clause"),
    ("bsd license", "bsd"),
    ("isc license", "isc"),
    ("boost software license", "bsl-1.0"),
    ("the unlicense", "unlicense"),
    ("spdx license identifier mit", "mit"),
    ("spdx license identifier apache 2 0", "apache-2.0"),
    ("spdx license identifier gpl 2 0", "gpl-2.0"),
    ("spdx license identifier gpl 3 0", "gpl-3.0"),
    ("spdx license identifier lgpl", "lgpl"),
    ("spdx license identifier agpl", "agpl"),
    ("spdx license identifier bsd 3 clause", "bsd-3-clause"),
    ("spdx license identifier bsd 2 clause", "bsd-2-clause"),
    ("spdx license identifier mpl 2 0", "mpl"),
    ("spdx license identifier isc", "isc"),
)

# Published notices (label, mandatory key phrases, text).
NOTICES = (
    ("mit", ("permission is hereby granted free of charge", "the software is provided as is"), """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software. THE
SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""),
    ("apache-2.0", ("licensed under the apache license", "you may not use this file except in compliance with the license"), """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License.
"""),
    ("gpl", ("under the terms of the gnu general public license", "free software you can redistribute it and or modify"), """
This program is free software: you can redistribute it and/or modify it under the terms of the
GNU General Public License as published by the Free Software Foundation, either version 3 of the
License, or (at your option) any later version. This program is distributed in the hope that it
will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should
have received a copy of the GNU General Public License along with this program.
"""),
    ("lgpl", ("under the terms of the gnu lesser general public license", "free software you can redistribute it and or modify"), """
This library is free software; you can redistribute it and/or modify it under the terms of the
GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1
of the License, or (at your option) any later version. This library is distributed in the hope
that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for
more details. You should have received a copy of the GNU Lesser General Public License along with
this library.
"""),
    ("bsd-2-clause", ("redistribution and use in source and binary forms", "materials provided with the distribution this software is provided"), """
Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the
above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in
binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE
IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED.
"""),
    ("bsd-3-clause", ("redistribution and use in source and binary forms", "may be used to endorse or promote products"), """
Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the
above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in
binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither
the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.
"""),
    ("isc", ("permission to use copy modify and or distribute this software", "the author disclaims all warranties"), """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without
fee is hereby granted, provided that the above copyright notice and this permission notice appear
in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD
TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
"""),
    ("mpl", ("subject to the terms of the mozilla public license",), """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of
the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.
"""),
    ("unlicense", ("free and unencumbered software released into the public domain",), """
This is free and unencumbered software released into the public domain. Anyone is free to copy,
modify, publish, use, compile, sell, or distribute this software, either in source code form or as
a compiled binary, for any purpose, commercial or non-commercial, and by any means.
"""),
    ("zlib", ("provided as is without any express or implied warranty", "altered source versions must be plainly marked"), """
This software is provided 'as-is', without any express or implied warranty. In no event will the
authors be held liable for any damages arising from the use of this software. Permission is granted
to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions: The origin of this software must
not be misrepresented; you must not claim that you wrote the original software. Altered source
versions must be plainly marked as such, and must not be misrepresented as being the original
software.
"""),
)


def words_of(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text, A-Z in lower case (bytes.lower touches ASCII only)."""
    return WORD.findall(text.lower())


@dataclass(frozen=True)
class Entry:
    """A phrase or notice: its words; a notice also its key phrases and their places in it."""

    label: str
    words: tuple[bytes, ...]
    base: bool = False
    keys: tuple[tuple[int, tuple[bytes, ...]], ...] = ()


def find_run(words, run: tuple[bytes, ...], first: int, last: int) -> int:
    """The first place from ``first`` to ``last`` where ``run`` stands in ``words``; -1: none."""
    n = len(run)
    for i in range(max(first, 0), min(last, len(words) - n) + 1):
        if words[i] == run[0] and tuple(words[i:i + n]) == run:
            return i
    return -1


def entries() -> list[Entry]:
    out = [Entry(label, tuple(words_of(p.encode())), base=True) for p, label in BASE]
    out += [Entry(label, tuple(words_of(p.encode()))) for p, label in PHRASES]
    for label, keys, text in NOTICES:
        w = tuple(words_of(text.encode()))
        found = tuple((find_run(w, k, 0, len(w)), k) for k in (tuple(words_of(x.encode())) for x in keys))
        if min(at for at, _ in found) < 0:
            raise ValueError(f"a key phrase of {label} is not in its notice")
        out.append(Entry(label, w, keys=found))
    return out


class Index:
    """Postings of all entries; ``idf`` holds the weight of every word of theirs."""

    def __init__(self, idf: dict[bytes, float], listed: list[Entry] | None = None):
        self.entries = entries() if listed is None else listed
        self.idf = idf
        self.anchors: dict[bytes, list[tuple[int, int]]] = defaultdict(list)  # phrases by their rarest word
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)  # notices by every word
        self.total: dict[int, float] = {}
        for e, entry in enumerate(self.entries):
            if entry.keys:
                for i, w in enumerate(entry.words):
                    self.postings[w].append((e, i))
                self.total[e] = sum(idf[w] * n for w, n in Counter(entry.words).items())
            else:
                at = max(range(len(entry.words)), key=lambda i: (idf[entry.words[i]], -i))
                self.anchors[entry.words[at]].append((e, at))
        self.known = frozenset(self.anchors) | frozenset(self.postings)
        # a notice needs its key phrases, and each of them its rarest word
        self.key_words = frozenset(max(run, key=lambda w: (idf[w], w)) for e in self.entries for _, run in e.keys)
        self.gate = frozenset(self.anchors) | self.key_words  # a file without any of these has no place

    def phrases(self, words: list[bytes], places: dict[bytes, list[int]]) -> list[tuple[int, int]]:
        """(entry, start) of every phrase, by its rarest word's places."""
        out = []
        for w, posted in self.anchors.items():
            for i in places.get(w, ()):
                for e, at in posted:
                    run = self.entries[e].words
                    if i >= at and tuple(words[i - at:i - at + len(run)]) == run:
                        out.append((e, i - at))
        return out

    def notices(self, words: list[bytes], places: dict[bytes, list[int]]) -> list[tuple[int, int, float]]:
        """(entry, start, weighted share of its words) of every notice."""
        if not any(w in places for w in self.key_words):
            return []
        stretches: dict[int, set[bytes]] = defaultdict(set)
        for w, at in places.items():
            if w in self.postings:
                for i in at:
                    stretches[i // STRETCH].add(w)
        # each stretch looks up its heaviest words, and proposes a start for every posting
        votes: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        looked = {s: sorted(found, key=lambda w: (-self.idf[w], w))[:HEAVIEST] for s, found in stretches.items()}
        for s, chosen in looked.items():
            for w in chosen:
                at = places[w]
                for i in at[np.searchsorted(at, s * STRETCH):np.searchsorted(at, (s + 1) * STRETCH)]:
                    for e, p in self.postings[w]:
                        votes[e].append((i - p, w))
        out = []
        for e, proposed in votes.items():
            proposed.sort()
            first, inside, tried, known = 0, Counter(), None, set()
            for last, (start, w) in enumerate(proposed):
                inside[w] += 1
                while start - proposed[first][0] > SHIFT:
                    gone = proposed[first][1]
                    inside[gone] -= 1
                    if not inside[gone]:
                        del inside[gone]
                    first += 1
                if len(inside) < AGREEING:
                    continue
                middle = proposed[(first + last) // 2][0]
                if middle == tried:
                    continue
                tried = middle
                start, share = self.verified(e, words, middle)
                if share and start not in known:
                    known.add(start)
                    out.append((e, start, share))
        return out

    def verified(self, e: int, words: list[bytes], start: int) -> tuple[int, float]:
        """Where the notice begins by its first key phrase, and the weighted share of its
        words there; the share is 0 unless each key phrase stands at its place, to within SHIFT
        words."""
        entry = self.entries[e]
        begins = [find_run(words, run, start + at - SHIFT, start + at + SHIFT) for at, run in entry.keys]
        if min(begins) < 0:
            return start, 0.0
        start = max(begins[0] - entry.keys[0][0], 0)
        here = Counter(words[max(start - SHIFT, 0):start + len(entry.words) + SHIFT])
        both = sum(self.idf[w] * min(n, here[w]) for w, n in Counter(entry.words).items())
        share = both / self.total[e]
        return start, share if share >= LEAST_SHARE else 0.0

    def scan(self, text: bytes) -> tuple[int, list[tuple]]:
        """n_words, places (label, base or not, start, words, score), by start."""
        words = words_of(text)
        places: dict[bytes, list[int]] = defaultdict(list)
        known = self.known
        if not self.gate.isdisjoint(words):
            for i, w in enumerate(words):
                if w in known:
                    places[w].append(i)
        if not places:
            return len(words), []
        found = [(self.entries[e].label, self.entries[e].base, start, len(self.entries[e].words), MENTION)
                 for e, start in self.phrases(words, places)]
        found += [(self.entries[e].label, False, start, len(self.entries[e].words), min(share, 1.0))
                  for e, start, share in self.notices(words, places)]
        return len(words), sorted(found, key=lambda f: (f[2], f[3], f[0]))


def document_frequency(docs: DataFrame, vocabulary: frozenset[bytes], text_col: str = "text") -> tuple[int, dict[bytes, int]]:
    """Documents, and those that hold each word of the vocabulary: all documents are counted
    where they lie, one partial count for each task and word is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, Counter()
        for b in batches:
            n += b.num_rows
            for t in raw_texts(b.column(0)):
                df.update(vocabulary.intersection(words_of(t)))
        yield pa.RecordBatch.from_arrays([pa.array([None, *df], pa.binary()), pa.array([n, *df.values()], pa.int64())], names=["w", "n"])

    parts = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(count, "w binary, n long")
    found = {(None if r["w"] is None else bytes(r["w"])): r["n"] for r in parts.groupBy("w").agg(F.sum("n").alias("n")).collect()}
    return found.pop(None, 0), found  # as many rows as the vocabulary has words


def build(docs: DataFrame, text_col: str = "text", listed: list[Entry] | None = None) -> Index:
    """The index, its words weighed by ln((1 + documents) / (1 + documents with the word)) + 1."""
    listed = entries() if listed is None else listed
    vocabulary = frozenset(w for e in listed for w in e.words)
    n, df = document_frequency(docs, vocabulary, text_col)
    return Index({w: float(np.log((1 + n) / (1 + df.get(w, 0))) + 1) for w in vocabulary}, listed)


LICENSES = "struct<n_words:long,places:array<struct<label:string,base:boolean,start:long,n:long,score:double>>>"


def licenses(docs: DataFrame, index: Index | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``licenses``: the number of words of each whole text and every place of a
    phrase or notice, by start (word positions from 0).

    Null and empty texts have no words and no places. Places may overlap and are all kept. Rows
    are scanned one by one, so repeated rows give equal results and an empty table gives none.
    A column of ``docs`` named ``licenses`` is replaced; other columns are untouched. The
    index weighs its words over all of ``docs`` unless one is given.
    """
    shared = docs.sparkSession.sparkContext.broadcast(build(docs, text_col) if index is None else index)  # the notices' words
    key = f"licenses:{uuid.uuid4().hex}"
    place = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("n", pa.int64()), ("score", pa.float64())])

    def find(column: pa.Array) -> pa.Array:
        scan = per_worker(key, lambda: taken(shared)).scan
        found = [scan(t) for t in raw_texts(column)]
        return pa.StructArray.from_arrays([
            pa.array([n for n, _ in found], pa.int64()),
            pa.array([[dict(zip(("label", "base", "start", "n", "score"), p, strict=True)) for p in places] for _, places in found], pa.list_(place))],
            names=["n_words", "places"])

    find.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return docs.withColumn("licenses", F.arrow_udf(find, LICENSES).asNondeterministic()(F.col(text_col)))

"""Licence scans: a trained paragraph classifier whose findings templates confirm.

A paragraph is a run of lines: a line goes on in the next where it is long and ends in no
closing mark, as wrapped notices do. A multinomial logistic regression over hashed word n-grams
(one to three words) tells licence families from each other, from licences of no known family
and from plain text. It is trained here, on the families' names in notice frames, on paragraphs
of their texts and parts of these, and on licences of other families. Held-out frames, held-out
parts and whole families of other licences that are never learnt from calibrate it: they set the
temperature (labels taken to be right with 98 percent), and the least probability at which a family is named, which is above what any of
the unknown families reaches. A paragraph whose best family is not that probable is an unknown
licence. A family is confirmed where a template of it has most of the paragraph's word triples,
or the paragraph holds one of the family's names.

Defined cases: null, empty and blank texts have no paragraphs; repeated paragraphs count each; an
empty table gives no rows; repeated rows are scanned each; other columns are ignored; long
paragraphs and texts are whole.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesets import U64, Words, code_points, ngram_hashes, slices, utf8
from .common import map_arrow, table, text_or_empty
from .pii import BETWEEN

#: Names of licence families, as notices write them.
NAMES = {
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache Software License"],
    "mit": ["MIT License", "MIT Licence", "Expat License"],
    "bsd": ["BSD 3-Clause License", "BSD 2-Clause License", "BSD License", "BSD-3-Clause", "New BSD License"],
    "gpl": ["GNU General Public License, version 3", "GNU General Public License version 2", "GNU GPL v3", "GPL-3.0", "GPLv2", "GNU General Public License"],
    "lgpl": ["GNU Lesser General Public License", "LGPL-2.1", "GNU LGPL v3"],
    "agpl": ["GNU Affero General Public License", "AGPL-3.0", "GNU AGPL v3"],
    "mpl": ["Mozilla Public License, version 2.0", "MPL-2.0", "Mozilla Public License"],
    "epl": ["Eclipse Public License 2.0", "EPL-2.0"],
    "cc-by": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC-BY-4.0", "CC BY 3.0"],
    "cc-by-sa": ["Creative Commons Attribution-ShareAlike 4.0", "CC BY-SA 4.0", "CC-BY-SA-3.0"],
    "cc-by-nc": ["Creative Commons Attribution-NonCommercial 4.0", "CC BY-NC 4.0", "CC-BY-NC-4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0"],
    "public-domain": ["CC0 1.0 Universal", "public domain", "the Unlicense"],
    "isc": ["ISC License", "ISC Licence"],
}
#: Paragraphs of the families' texts and notices.
TEXTS = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc.",
    ],
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-2.0/"],
    "cc-by": ["You are free to share and adapt the material for any purpose, even commercially, under the Creative Commons Attribution 4.0 International License, if you give appropriate credit and indicate if changes were made."],
    "cc-by-sa": ["If you remix, transform, or build upon the material, you must distribute your contributions under the same Creative Commons Attribution-ShareAlike license as the original."],
    "cc-by-nc": ["You may not use the material for commercial purposes, under the terms of the Creative Commons Attribution-NonCommercial license."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    ],
}
#: Licences of other families, learnt as unknown, and those that only calibrate.
OTHERS = [
    "Artistic License 2.0", "PostgreSQL License", "OpenSSL License", "Academic Free License 3.0", "Common Development and Distribution License 1.1", "SIL Open Font License 1.1", "Python Software Foundation License 2.0",
    "Microsoft Public License", "Business Source License 1.1", "Elastic License 2.0", "Server Side Public License", "Open Software License 3.0", "PHP License 3.01", "Open Database License 1.0", "Apple Public Source License 2.0", "Q Public License 1.0",
    "Perl may be copied only under the terms of the Artistic License", "Do What The Fuck You Want To Public License", "This font is licensed under the terms of the Open Font License and may be bundled with any software",
    "By installing the product you accept this end user license agreement and may not reverse engineer it", "All rights reserved. No part may be reproduced without written permission of the publisher",
]
CALIBRATING = [
    "Boost Software License, Version 1.0", "zlib License", "European Union Public Licence 1.2", "CeCILL Free Software License Agreement", "University of Illinois/NCSA Open Source License", "Ruby License", "Vim License",
    "Common Public Attribution License 1.0", "Reciprocal Public License 1.5", "Sleepycat License", "Intel Open Source License", "Sun Public License 1.0", "Zope Public License 2.1", "Lucent Public License 1.02", "Open Data Commons Attribution License",
    "This software may be used only under the license granted to the customer by the vendor",
]
FRAMES = [
    "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "Released under {}.", "This work is licensed under the {}.", "This work is licensed under a {}.",
    "Distributed under the terms of the {}.", "SPDX-License-Identifier: {}", "This software is provided under the {}.", "Published under the {} by its authors.",
    "The source code is available under the {}.", "See the {} for details.", "License: {}", "All content is {} unless noted.", "Copyright 2021 the authors. {}", "You may use it under the {}.", "{}",
]
HELD_FRAMES = ["This software is distributed under the {}.", "The documentation may be copied under the {}.", "Covered by the {}", "Code and data: {}.", "It is made available by the authors under the {}, see below."]
UNKNOWN = ["{} Community License", "{} Source License 1.1", "{} Public Licence", "{} Content Agreement", "{} End User License", "{} Data License Terms", "{} Software License, Version 1.0", "{} License"]
PLAIN = [
    "a driving license is required in this country", "he lost his fishing license last year", "the general public was invited to the lesser hall", "permission to enter was granted to the visitors",
    "the apache people lived in the south", "a student of mit spoke about software", "the source of the river is in public land", "see the notes for details", "all rights of way are noted on the map",
    "this program is broadcast under the new terms", "the work is available to the public", "released last week by the general", "version 2.0 of the report was published", "distributed to all members of the club",
    "my license to drive was issued in june", "he has a license and a car", "they lost the license for the bar", "a licence to fish costs ten pounds", "members of the club hold a licence", "the plumber showed her trade license to us", "without a license you may not sell wine here",
    "a poet may take some artistic licence", "the general public license fee was raised by the council", "the free software meeting was moved to monday", "the lesser known public gardens", "eclipse of the sun in the public park",
    "the warranty of the car covers the engine", "any person may obtain a copy of the map at the office", "the authors of the book are free to speak",
]
HELD_PLAIN = [
    "the license of the pub was renewed in may", "the general read the public report about the software", "copies of the paper were distributed at the door", "she is free to use the library for any purpose", "conditions at sea were met with calm",
    "the driver lost his license", "he is a member of the public and has a license", "a license was granted to the new hotel", "they asked for a copy of the pilot license", "the software of the public office was slow", "the gnu is a large animal of the general area",
    "mozilla made the eclipse of the moon public", "the zoo has a licence for its apes", "version 2.0 of the licence form is out",
]
SCREEN_BITS = 20
LENGTHS = (1, 2, 3)
LICENCE_MIN, COVER_PERCENT = 0.5, 60
#: The least probability of a family, where calibration asks for no more.
FAMILY_MIN = 0.5
#: Bytes that end a paragraph's line, and the length under which a line goes on in no other.
CLOSING = np.zeros(256, bool)
CLOSING[list(b".!?:;|}>")] = True
WRAPPED_FROM = 40


def grams(line: bytes) -> np.ndarray:
    """The hashed n-grams of one line, each once."""
    data = np.frombuffer(line, np.uint8)
    word = Words(data, np.array([0, len(data)]), BETWEEN).hashes(lower=True)
    return np.unique(np.concatenate([ngram_hashes(word, n) for n in LENGTHS]))


def _parts(text: str, draw: random.Random, count: int) -> list[str]:
    """The text and runs of its words, as wrapping and quoting leave them."""
    w = text.split()
    out = [text]
    for _ in range(count if len(w) > 14 else 0):
        n = draw.randint(9, min(len(w), 40))
        k = draw.randint(0, len(w) - n)
        out.append(" ".join(w[k : k + n]))
    return out


def _samples(draw: random.Random) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(class, paragraph) pairs to learn from and to calibrate with."""
    syllables = ["ba", "ren", "to", "ki", "lor", "sha", "ver", "in", "qua", "mel", "dor", "est"]

    def word() -> str:
        return "".join(draw.choices(syllables, k=draw.randint(1, 4)))

    learn, held = [], []
    for family, names in NAMES.items():
        learn += [(family, frame.format(name)) for frame in FRAMES for name in names]
        held += [(family, frame.format(name)) for frame in HELD_FRAMES for name in names]
        for text in TEXTS.get(family, []):
            learn += [(family, p) for p in _parts(text, draw, 10)]
            held += [(family, p) for p in _parts(text, draw, 2)[1:]]
    learn += [("unknown", frame.format(name)) for frame in FRAMES for name in OTHERS]
    learn += [("unknown", frame.format(kind.format(word().title()))) for frame in FRAMES for kind in UNKNOWN for _ in range(2)]
    held += [("unknown", frame.format(name)) for frame in FRAMES[::3] + HELD_FRAMES for name in CALIBRATING]
    for to, lines, n in ((learn, PLAIN, 400), (held, HELD_PLAIN, 100)):
        to += [("none", " ".join(word() for _ in range(draw.randint(3, 30)))) for _ in range(n)]
        for line in lines:
            to += [("none", line)] * 4
            to += [("none", " ".join([*line.split()[: draw.randint(3, 12)], *[word() for _ in range(draw.randint(2, 8))]])) for _ in range(6)]
    return learn, held


class Model:
    """classes, the known n-grams in order and a weight row for each; the last row is the bias."""

    def __init__(self, classes: list[str], known: np.ndarray, weights: np.ndarray, temperature: float, family_min: float = FAMILY_MIN) -> None:
        self.classes, self.known, self.weights, self.temperature, self.family_min = classes, known, weights.astype(np.float32), temperature, family_min
        self.screen = np.zeros(1 << SCREEN_BITS, bool)
        self.screen[known >> U64(64 - SCREEN_BITS)] = True

    def find(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the known ones among the hashes, and their weight rows."""
        at = np.flatnonzero(self.screen[hashed >> U64(64 - SCREEN_BITS)])
        row = np.minimum(np.searchsorted(self.known, hashed[at]), len(self.known) - 1)
        same = self.known[row] == hashed[at]
        return at[same], row[same]

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        z = sums / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


#: Share of doubt in a held-out label: made paragraphs are easier than found ones, and are all
#: told apart, which alone would ask for boundless sureness.
DOUBT = 0.02
#: Temperatures that calibration chooses from.
TEMPERATURES = [0.02 * 1.15**k for k in range(45)]


@lru_cache(maxsize=1)
def train(seed: int = 11, steps: int = 400, decay: float = 1e-3) -> Model:
    """Full-batch gradient descent with momentum; rows are kept as lists of their n-grams."""
    samples, held = _samples(random.Random(seed))
    classes = sorted({c for c, _ in samples})
    rows, held_rows = [grams(s.encode()) for _, s in samples], [grams(s.encode()) for _, s in held]
    y, y_held = (np.array([classes.index(c) for c, _ in some]) for some in (samples, held))
    known = np.unique(np.concatenate(rows))

    def sparse(some: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Feature of every entry, bias last in each row, and where rows start."""
        parts = []
        for row in some:
            at = np.minimum(np.searchsorted(known, row), len(known) - 1)
            parts.append(np.append(at[known[at] == row], len(known)))
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])[:-1]

    feature, start = sparse(rows)
    row_of = np.repeat(np.arange(len(rows)), np.diff(np.append(start, len(feature))))
    by_feature = np.argsort(feature, kind="stable")
    present, first = np.unique(feature[by_feature], return_index=True)
    entry_row = row_of[by_feature]
    hot = np.eye(len(classes))[y]
    w = np.zeros((len(known) + 1, len(classes)))
    v = np.zeros_like(w)
    for _ in range(steps):
        z = np.add.reduceat(w[feature], start, axis=0)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        slope = decay * w
        slope[present] += np.add.reduceat(((p - hot) / len(rows))[entry_row], first, axis=0)
        v = 0.9 * v - 0.5 * slope
        w += v
    feature, start = sparse(held_rows)
    z_held = np.add.reduceat(w[feature], start, axis=0)

    def loss(t: float) -> float:
        z = z_held / t
        z = z - z.max(1, keepdims=True)
        rest = np.log(np.exp(z).sum(1))
        return float((rest - DOUBT * z.mean(1) - (1 - DOUBT) * z[np.arange(len(z)), y_held]).mean())

    model = Model(classes, known, w, min(TEMPERATURES, key=loss))
    p = model.probabilities(z_held)
    family = [k for k, c in enumerate(classes) if c not in ("none", "unknown")]
    reached = p[y_held == classes.index("unknown")][:, family].max()
    model.family_min = max(FAMILY_MIN, min(0.95, float(reached) + 0.01))
    right = np.where(p.max(1) >= model.family_min, p.argmax(1), classes.index("unknown")) == y_held
    model.recall = {c: float(right[y_held == k].mean()) for k, c in enumerate(classes)}
    return model


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _triples(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2))}


@lru_cache(maxsize=1)
def templates() -> dict[str, tuple[list[str], set[tuple[str, ...]]]]:
    """Per family its names as plain word strings and the word triples of its paragraphs and notices."""
    out = {}
    for family, names in NAMES.items():
        texts = [f.format(n) for f in FRAMES for n in names] + TEXTS.get(family, [])
        out[family] = ([f" {' '.join(_words(n))} " for n in names], set().union(*(_triples(_words(t)) for t in texts)))
    return out


def confirmed(family: str, paragraph: str) -> bool:
    """Whether the paragraph holds a name of the family, or its templates have most of the paragraph's word triples."""
    names, known = templates()[family]
    words = _words(paragraph)
    plain, own = f" {' '.join(words)} ", _triples(words)
    return any(n in plain for n in names) or 100 * len(own & known) >= COVER_PERCENT * len(own)


FINDING = "struct<family:string,start:int,end:int,probability:double,confirmed:boolean>"
_FINDING_T = pa.list_(pa.struct([("family", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64()), ("confirmed", pa.bool_())]))


def paragraphs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the paragraphs of some rows, in order."""
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([off[:-1], breaks + 1])
    row = np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, breaks, side="right") - 1])
    order = np.lexsort((row, starts))
    starts, row = starts[order], row[order]
    stops = np.append(breaks, len(data))
    ends = np.minimum(stops[np.searchsorted(stops, starts)], off[1:][row])
    last = ends - ((ends > starts) & (data[np.maximum(ends - 1, 0)] == 13) if len(data) else 0)
    goes_on = np.zeros(len(starts), bool)
    if len(data) and len(starts) > 1:
        long = (last - starts >= WRAPPED_FROM) & ~CLOSING[data[np.maximum(last - 1, 0)]]
        goes_on[1:] = long[:-1] & (row[1:] == row[:-1]) & (ends[1:] > starts[1:])
    first = np.flatnonzero(~goes_on)
    final = np.append(first[1:], len(starts)) - 1
    return starts[first], ends[final], row[first]


def _scores(data: np.ndarray, off: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and class sums of the paragraphs with any n-gram the model knows."""
    starts, ends, row = paragraphs(data, off)
    words = Words(data, off, BETWEEN)
    word = words.hashes(lower=True)
    line = np.searchsorted(starts, words.start, side="right") - 1
    hit_line, hit = [], []
    for n in LENGTHS:
        hashed = ngram_hashes(word, n)
        at, known = model.find(hashed)
        whole = line[at] == line[at + n - 1]
        hit_line.append(line[at[whole]])
        hit.append(known[whole])
    size = len(model.known)
    pair = np.unique(np.concatenate(hit_line) * size + np.concatenate(hit))
    which, entry = np.divmod(pair, size)
    at, first = np.unique(which, return_index=True)
    if not len(at):
        return at, at, at, np.zeros((0, len(model.classes)))
    sums = np.add.reduceat(model.weights[entry], first, axis=0) + model.weights[-1]
    return starts[at], ends[at], row[at], sums


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and findings (family, code points, probability, confirmed) of every row."""
    model = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none, unknown = model.classes.index("none"), model.classes.index("unknown")
        for batch in batches:
            data, off = utf8(batch.column("text"))
            for i, j in slices(off):
                part, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
                starts, ends, row, sums = _scores(part, at, model)
                out: list[list] = [[] for _ in range(j - i)]
                if len(starts):
                    p = model.probabilities(sums)
                    point = code_points(part)
                    for k in np.flatnonzero(1 - p[:, none] > LICENCE_MIN).tolist():
                        best = int(np.argmax(np.where(np.arange(len(p[k])) == none, -1, p[k])))
                        text = part[starts[k] : ends[k]].tobytes().decode()
                        family = model.classes[best] if best != unknown and p[k, best] >= model.family_min else "unknown"
                        sure = family != "unknown" and confirmed(family, text)
                        base = point[at[row[k]]]
                        out[row[k]].append({"family": family, "start": int(point[starts[k]] - base), "end": int(point[ends[k]] - base), "probability": float(p[k, best]), "confirmed": sure})
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(out, _FINDING_T)], names=["doc_id", "findings"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), run, f"doc_id long, findings array<{FINDING}>")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    sure = F.filter("findings", lambda f: f["confirmed"])
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.size("findings").cast("long").alias("n_licence_paragraphs"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda f: f["family"]))), ",").alias("families"),
        F.array_join(F.transform("findings", lambda f: F.concat_ws(":", F.when(f["confirmed"], f["family"]).otherwise("unknown"), f["start"].cast("string"), f["end"].cast("string"))), ",").alias("spans"),
    )

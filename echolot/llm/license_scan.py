"""License scans by an exact set-similarity join of text blocks with license templates.

Blocks are the lines of a text and, for each template, the stretches of consecutive words over line ends in which a
threshold's share of words can be the template's, so that a notice wrapped over lines is compared whole wherever its
lines break. Tokens are the words of the scan, A-Z lower-cased; templates and blocks are compared
as sets. A block meets a template if it holds at least threshold of the template's tokens. Tokens are put in one
global order, rarest first, by the number of documents that hold them; these counts cover all documents and only the
templates' tokens need them. Filters, all exact: with c tokens needed of a template of t, one of its first
t - c + 1 tokens is in every block that meets it (prefix); such a block has at least c tokens (length); and a match
at place p of the order leaves at most t - p tokens to find (position). What survives is counted.

Templates are a parameter, held by every task: their number does not depend on the documents. Base phrases are found
exactly as consecutive words over the whole text, across lines. A null or empty text has no words and no label. Other
columns are ignored, repeated rows are scanned each for itself.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hide_null, lowered, ship, show_null, with_rows

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: Words and the label of each base phrase; fixed values.
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
#: Label and text of the method's templates: notices by which works name their license, then whole short licenses and
#: the whole notices of long ones; fixed values.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
)


def tokens(text: str) -> list[str]:
    return WORD.findall(lowered(text))


def token_counts(docs: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """The number of documents that hold each token of the templates; at most as many rows as these have tokens."""
    wanted = frozenset(x for _, t in templates for x in tokens(t))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter[str] = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                if text:
                    n.update(wanted.intersection(tokens(text)))
        yield pd.DataFrame({"token": list(n), "n": list(n.values())}).astype({"token": object, "n": "int64"})

    got = docs.select(F.col("text").cast("string").alias("text")).mapInPandas(with_rows(count), "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return dict.fromkeys(wanted, 0) | {r["token"]: r["n"] for r in got}


class Templates:
    """The templates' side of the join, in the global order."""

    def __init__(self, counts: dict[str, int], threshold: float, templates=TEMPLATES):
        self.place = {x: p for p, x in enumerate(sorted(counts, key=lambda x: (counts[x], x)))}
        self.items, self.index = [], {}
        for k, (label, text) in enumerate(templates):
            order = sorted(set(tokens(text)), key=self.place.__getitem__)
            need = math.ceil(round(threshold * len(order), 9))
            self.items.append((label, frozenset(order), need))
            for p, token in enumerate(order[: len(order) - need + 1]):
                self.index.setdefault(token, []).append((k, p))
        self.rare = frozenset(self.index)
        #: the most words of a stretch over line ends
        self.most = [math.floor(round(len(tokens(text)) / threshold, 9)) for _, text in templates]

    def wrapped(self, lines: list[list[str]]) -> list[tuple[int, str, float]]:
        """First line, label and containment of the fullest stretch over line ends of every template that one meets."""
        places, at = [], 0
        for i, line in enumerate(lines):
            places += [(at + k, i, x) for k, x in enumerate(line) if x in self.place]
            at += len(line)
        here, out = {x for _, _, x in places}, []
        for (label, items, need), most in zip(self.items, self.most, strict=True):
            if len(items & here) < need:
                continue
            mine = [p for p in places if p[2] in items]
            n: Counter[str] = Counter()
            best, first, start = 0, 0, 0
            for at, i, x in mine:
                n[x] += 1
                while at - mine[start][0] >= most:
                    gone = mine[start][2]
                    n[gone] -= 1
                    if not n[gone]:
                        del n[gone]
                    start += 1
                if len(n) > best and mine[start][1] < i:
                    best, first = len(n), mine[start][1]
            if best >= need:
                out.append((first, label, best / len(items)))
        return out

    def meet(self, block: list[str]) -> list[tuple[str, float]]:
        """Label and containment of every template that the block meets."""
        known = sorted({x for x in block if x in self.place}, key=self.place.__getitem__)
        out, seen = [], set()
        for q, token in enumerate(known):
            for k, p in self.index.get(token, ()):
                if k in seen:
                    continue
                seen.add(k)  # the first match in the global order: both sides have only what follows
                label, items, need = self.items[k]
                if len(known) < need or 1 + min(len(items) - p - 1, len(known) - q - 1) < need:
                    continue
                hits = len(items.intersection(known))
                if hits >= need:
                    out.append((label, hits / len(items)))
        return out


def phrase_places(words: list[str], phrases=PHRASES) -> list[tuple[int, str]]:
    out = []
    for end, w in enumerate(words):
        if w == "license":
            for phrase, label in phrases.items():
                n = len(phrase)
                if end + 1 >= n and tuple(words[end + 1 - n : end + 1]) == phrase:
                    out.append((end + 1 - n, label))
    return out


def scan(docs: DataFrame, threshold: float = 0.8, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks (line, label, containment).

    score is 1 for a base phrase, else the best containment, else 0. line is the first line of a block, from 0.
    """
    ship(docs.sparkSession)
    t = Templates(token_counts(docs, templates), threshold, templates)

    def one(doc: str | None):
        low = lowered(doc or "")
        words = WORD.findall(low)
        places = phrase_places(words) if "license" in low else []
        base = {label for _, label in places}
        blocks = []
        if not t.rare.isdisjoint(words):
            lines = [WORD.findall(line) for line in low.split("\n")]
            for i, line in enumerate(lines):
                if not t.rare.isdisjoint(line):
                    blocks += [(i, label, c) for label, c in t.meet(line)]
            if len(lines) > 1:
                blocks += t.wrapped(lines)
        starts = [p for p, _ in places]
        return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {b[1] for b in blocks})),
                1.0 if base else max((b[2] for b in blocks), default=0.0), [{"line": i, "label": x, "containment": c} for i, x, c in blocks])

    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame([one(x) for x in pdf["text"]], columns=names).astype({"first_word": "Int64", "last_word": "Int64"})
            out.insert(0, "doc_id", pdf["doc_id"].array)
            yield out

    return docs.select(hide_null("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(
        with_rows(run), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<line: long, label: string, containment: double>>").withColumn("doc_id", show_null("doc_id"))


def scanned(docs: DataFrame) -> DataFrame:
    return scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

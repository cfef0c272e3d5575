"""Licence scan: parts of a text against templates by the Dice coefficient of word bigrams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND
THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License."""

_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""

_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""

_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""

_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN
NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_GPL_2 = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This
program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received
a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin
Street, Fifth Floor, Boston, MA 02110-1301 USA."""

_LGPL = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This
library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""

_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate
any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large
and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of
all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

#: Fixed values: (identifier, public wording). Further templates can be given to `licensed`.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", f"{_BSD_2} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_2} {_BSD_3} {_BSD_END}"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GPL_2),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GPL),
    ("ISC", "Released under the ISC License."),
    ("ISC", _ISC),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _LGPL),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", _MIT),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("MPL-2.0", _MPL),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", _UNLICENSE),
)

_WORD = re.compile(r"[a-z0-9]+")


def words(text: str) -> list[str]:
    """Words of a normalised text: lower-cased, runs of a-z and 0-9."""
    return _WORD.findall(text.lower())


def bigrams(text: str) -> frozenset[str]:
    """Word bigrams of a normalised text."""
    tokens = words(text)
    return frozenset(map(" ".join, zip(tokens, tokens[1:], strict=False)))


class Matcher:
    """Templates sorted by size, so that the bounds of a Dice coefficient cut out a short range of them."""

    def __init__(self, templates: tuple[tuple[str, str], ...], percent: int):
        self.percent = percent
        self.templates = sorted(((len(grams), name, grams) for name, text in templates if (grams := bigrams(text))), key=lambda t: t[:2])
        self.any = frozenset().union(*(t[2] for t in self.templates))
        #: (bigrams of a window, least number of them in common, name, own bigrams)
        self.windows = [(len(words(text)) - 1, -(-percent * len(grams) // (200 - percent)), name, grams)
                        for name, text in templates if (grams := bigrams(text))]
        self.holders: dict[str, list[int]] = {}
        for i, (*_, grams) in enumerate(self.windows):
            for gram in grams:
                self.holders.setdefault(gram, []).append(i)

    def inside(self, grams: list[str]) -> dict[str, tuple[int, int]]:
        """Licence -> best match over the windows of a template's number of words that begin with a bigram of it.

        A window needs percent / (200 - percent) of the template's bigrams to reach the coefficient, as its own
        set is no smaller than what both share; windows with fewer hits are passed over. One set of counts
        slides over the others, so a text takes time with its length for each template that it holds much of.
        """
        hits: dict[int, list[int]] = {}
        for at, gram in enumerate(grams):
            if gram in self.holders:
                for i in self.holders[gram]:
                    hits.setdefault(i, []).append(at)
        found: dict[str, tuple[int, int]] = {}
        for i, places in hits.items():
            size, least, name, own = self.windows[i]
            left = right = common = 0
            counts: dict[str, int] = {}
            for start, last in zip(places, places[least - 1:], strict=False):
                if last >= start + size:
                    continue
                if start >= right:  # nothing of the earlier window is left
                    counts, common, left, right = {}, 0, start, start
                for gram in grams[left:start]:
                    counts[gram] -= 1
                    if not counts[gram]:
                        del counts[gram]
                        common -= gram in own
                left = start
                for gram in grams[right:start + size]:
                    if gram not in counts:
                        common += gram in own
                    counts[gram] = counts.get(gram, 0) + 1
                right = min(start + size, len(grams))
                both, total = 2 * common, len(counts) + len(own)
                if 100 * both >= self.percent * total and both * found.get(name, (0, 1))[1] > found.get(name, (0, 1))[0] * total:
                    found[name] = (both, total)
        return found

    def matches(self, grams: frozenset[str]) -> dict[str, tuple[int, int]]:
        """Licence -> best (2 * common, sum of sizes) of at least percent / 100."""
        n, p, found = len(grams), self.percent, {}
        for m, name, own in self.templates:
            if (200 - p) * m < p * n:  # even a template inside the text would be too small
                continue
            if p * m > (200 - p) * n:
                break
            both = 2 * len(grams & own)
            if 100 * both >= p * (n + m) and both * found.get(name, (0, 1))[1] > found.get(name, (0, 1))[0] * (n + m):
                found[name] = (both, n + m)
        return found

    def scan(self, text: str) -> dict[str, tuple[int, int]]:
        """Best match of each licence over a text's lines, paragraphs (between blank lines), whole and windows."""
        tokens = words(text)
        grams = list(map(" ".join, zip(tokens, tokens[1:], strict=False)))
        if self.any.isdisjoint(grams):
            return {}
        best = self.inside(grams)
        paragraphs: list[list[frozenset[str] | str]] = [[]]
        for line in text.split("\n"):
            if _WORD.search(line.lower()):
                paragraphs[-1].append(line)
            elif paragraphs[-1] and not line.strip():
                paragraphs.append([])
        parts = [p for p in paragraphs if p]
        sections = [line for p in parts for line in p] + ["\n".join(p) for p in parts if len(p) > 1] + ([text] if len(parts) > 1 else [])
        for section in sections:
            grams = bigrams(section)
            if grams.isdisjoint(self.any):
                continue
            for name, (both, total) in self.matches(grams).items():
                if name not in best or both * best[name][1] > best[name][0] * total:
                    best[name] = (both, total)
        return best


def licensed(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, percent: int = 80) -> DataFrame:
    """doc_id, license, dice, is_best for each licence that a document holds to at least percent / 100.

    Sections of docs (doc_id, text) are its lines, its paragraphs between blank lines and the whole text; each
    is compared with all templates whose size allows the coefficient. Every template is also compared with the
    windows of as many words as it has that begin with one of its bigrams (shorter at the end of a text), so a
    notice within a sentence and a licence of several paragraphs within a longer text are found. is_best marks the highest coefficient
    of a document, of equal ones the first name. Null and empty texts hold none; a repeated row repeats its
    results; a null doc_id is kept as null.
    """

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(templates, percent)
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                best = matcher.scan(text) if text else {}
                first = min(best, key=lambda name: (-best[name][0] / best[name][1], name), default=None)
                rows += [(doc_id, name, both / total, name == first) for name, (both, total) in best.items()]
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "license", "dice", "is_best"])

    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(scanned, "doc_id string, license string, dice double, is_best boolean")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))

"""License scans: runs of lines against licence templates by Dice coefficient over word bigrams.

Text and templates are normalised to lower-case words. For every template, every run of whole
lines whose bigram count can reach the wanted coefficient is a candidate; a run of a bigrams and a
template of b bigrams share at most min(a, b), so Dice >= t needs t/(2-t) <= a/b <= (2-t)/t, and
other sizes are pruned unseen. Where no run of lines reaches a licence, runs of words are compared
wherever they begin and end, so that a notice inside a long line is found. A template needs at least t/(2-t) of its bigrams in a run, so words
that touch more than the rest of its bigrams must occur in any match: texts with none of those
words are passed over after one multi-pattern search. Candidates that remain are compared exactly,
as multisets.

Defined results. A null or empty text has no match. The best run per document row and licence is
reported (of lines before words; the highest coefficient, then the shortest, then the first); rows without a match have
no row. Repeated rows repeat their matches. Rows with a null doc_id are scanned and keep the null.
An empty table gives an empty table. A text is scanned whole, however long. Columns other than the
id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready

WORD = re.compile(r"[a-z0-9]+")
# Warranty paragraphs that end several licences: fixed values.
MIT_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
ISC_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
GPL_WARRANTY = 'This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.'
# Notices and licence texts, by name: fixed values. `with_whole_texts` adds the texts in full.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "cc-by-nc-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
}

# A third condition, and licences that are short enough to hold in full: fixed values.
BSD_3 = '3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.'
ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
UNLICENSE = 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to https://unlicense.org/'


def with_whole_texts(notices: dict[str, tuple[str, ...]]) -> dict[str, tuple[str, ...]]:
    """The notices, and in full the licences that several of the parts above make up."""
    grant = {name: notices[name][-1] for name in ("mit", "isc", "bsd-2-clause", "gpl-3.0")}
    whole = {
        "mit": (f"{grant['mit']} {MIT_WARRANTY}",),
        "isc": (f"{grant['isc']} {ISC_WARRANTY}",),
        "bsd-2-clause": (f"{grant['bsd-2-clause']} {BSD_WARRANTY}",),
        "bsd-3-clause": (f"{grant['bsd-2-clause']} {BSD_3} {BSD_WARRANTY}",),
        "gpl-3.0": (f"{grant['gpl-3.0']} {GPL_WARRANTY}",),
        "zlib": (ZLIB,),
        "unlicense": (UNLICENSE,),
    }
    return {name: notices.get(name, ()) + whole.get(name, ()) for name in {**notices, **whole}}


TEMPLATES = with_whole_texts(TEMPLATES)


def templates_in(folder: str) -> dict[str, tuple[str, ...]]:
    """Licence texts from a folder of text files, each named for its licence: for those too long to bundle."""
    return {p.stem.lower(): (p.read_text(errors="replace"),) for p in sorted(Path(folder).iterdir()) if p.is_file()}


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def bigrams(tokens: list[str]) -> Counter:
    return Counter(zip(tokens, tokens[1:]))


def dice(a: Counter, b: Counter) -> float:
    total = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / total if total else 0.0


def needed_words(template: Counter, least: float) -> set[str]:
    """Words, long ones first, that touch so many bigrams that a match must hold one of them."""
    spare = sum(template.values()) * (1 - least / (2 - least))
    chosen: set[str] = set()
    for w in sorted({w for b in template for w in b}, key=lambda w: (-len(w), w)):
        chosen.add(w)
        if sum(n for b, n in template.items() if chosen.intersection(b)) > spare:
            break
    return chosen


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]], least: float):
        self.least, self.forms = least, []
        self.search = ahocorasick.Automaton()
        for name, texts in templates.items():
            for text in texts:
                form = bigrams(words(text))
                needed = needed_words(form, least)
                n = sum(form.values())
                self.forms.append((name, form, n * least / (2 - least), n * (2 - least) / least, needed))
                for w in needed:
                    self.search.add_word(w, w)
        self.search.make_automaton()

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(licence, coefficient, first line, last line) of the best run per licence."""
        lowered = text.lower()
        present = {w for _, w in self.search.iter(lowered)}
        best: dict[str, tuple] = {}
        if not present:
            return []
        lines = [WORD.findall(x) for x in lowered.split("\n")]
        full = [k for k, x in enumerate(lines) if x]
        for name, form, low, high, needed in self.forms:
            if not needed & present:
                continue
            total, own = sum(form.values()), {w for b in form for w in b}
            touching = [any(w in own for w in lines[k]) for k in full]
            for at, i in enumerate(full):
                if not touching[at]:
                    continue  # a best run does not begin with a line that shares no word
                seen: Counter = Counter()
                shared, size, last = 0, -1, None
                for place in range(at, len(full)):
                    for w in lines[full[place]]:
                        if last is not None:
                            seen[last, w] += 1
                            shared += seen[last, w] <= form[last, w]
                        last, size = w, size + 1
                    if size > high:
                        break
                    if size < low or not touching[place]:
                        continue
                    value, j = 2 * shared / (size + total), full[place]
                    key = (-value, size, i, j)
                    if value >= self.least and (name not in best or key < best[name]):
                        best[name] = key
        left = [f for f in self.forms if f[0] not in best and f[4] & present]
        if left:
            best |= self.windows(lines, left)
        return [(name, -k[0], k[2], k[3]) for name, k in sorted(best.items())]

    def windows(self, lines: list[list[str]], forms: list[tuple]) -> dict[str, tuple]:
        """The best run of words per licence, wherever lines begin or end.

        A best run begins and ends with a bigram of the template, and holds `low` of them.
        """
        run = [w for x in lines for w in x]
        line_of = [k for k, x in enumerate(lines) for _ in x]
        pairs, best = list(zip(run, run[1:])), {}
        for name, form, low, high, _ in forms:
            total = sum(form.values())
            at = [k for k, b in enumerate(pairs) if b in form]
            for i, first in enumerate(at):
                ends = bisect_right(at, first + high - 1)
                if ends - i < low:
                    continue
                seen: Counter = Counter()
                shared = 0
                for last in at[i:ends]:
                    b = pairs[last]
                    seen[b] += 1
                    shared += seen[b] <= form[b]
                    size = last - first + 1
                    value = 2 * shared / (size + total)
                    if value >= self.least and (name not in best or (-value, size) < best[name][:2]):
                        best[name] = (-value, size, line_of[first], line_of[last + 1])
        return best


def scan_licences(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, licence, score, first_line, last_line (from 0) of every licence found."""
    ready(docs.sparkSession)
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        for batch in batches:
            found = [(doc, *m) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)) for m in scanner.scan(text.as_py() or "")]
            columns = list(zip(*found)) or [()] * 5
            types = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "licence", "score", "first_line", "last_line"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, "doc_id long, licence string, score double, first_line int, last_line int")

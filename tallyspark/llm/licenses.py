"""Licence scans: the Dice coefficient over word bigrams of runs of words of a text and of licence templates.

Texts and templates are normalised to lower-case words without marks; line breaks and sentence ends play no part. A run is
some consecutive words of a text that begins and ends with a bigram of the template; repeated bigrams count as often as they
occur. Lists of a and b bigrams can reach a coefficient of t only if the shorter has at least t / (2 - t) of the longer, so a
run has at most b (2 - t) / t bigrams and shares b t / (2 - t) with the template at least: where fewer of them lie close
together, a template is not compared at all.

Of the runs of a template from one start the one of the largest coefficient is taken. Runs that share words, as those of
licences that differ by a clause do, are settled by their gain: the bigrams shared, counted on both sides, less those that are
on one side only. The largest gain counts first, and what shares a word with a run that counts goes. So neither an exact short
notice inside a changed long text wins, nor a run over the ends of two neighbouring texts.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import pick, ship

THRESHOLD = 0.8

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
    "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
    "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "Software.")
_MIT_WARRANTY = (
    " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_BSD_OPENING = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met:")
_BSD_CLAUSES = (
    " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution.")
_BSD_THIRD = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission.")
_BSD_WARRANTY = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
    "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
    "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
    "POSSIBILITY OF SUCH DAMAGE.")
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted")
_ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC_WARRANTY = (
    " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for "
    "any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, "
    "including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you "
    "use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
    "3. This notice may not be removed or altered from any source distribution.")
_UNLICENSE = (
    " Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
    "compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright "
    "laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We "
    "make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this "
    "dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under "
    "copyright law.")

#: Notices and licence texts as published; fixed values.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", _MIT_GRANT),
    ("MIT", _MIT_GRANT + _MIT_WARRANTY),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                   "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                   "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
                   "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
                   "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
                   "the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                         "Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
                         "your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                         "Public License as published by the Free Software Foundation; either version 2 of the License, or (at "
                         "your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
                          "General Public License as published by the Free Software Foundation; either version 2.1 of the "
                          "License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                          "Affero General Public License as published by the Free Software Foundation, either version 3 of the "
                          "License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", _BSD_OPENING + _BSD_CLAUSES + _BSD_THIRD),
    ("BSD-3-Clause", _BSD_OPENING + _BSD_CLAUSES + _BSD_THIRD + _BSD_WARRANTY),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", _BSD_OPENING + _BSD_CLAUSES),
    ("BSD-2-Clause", _BSD_OPENING + _BSD_CLAUSES + _BSD_WARRANTY),
    ("BSD", _BSD_OPENING),
    ("ISC", _ISC_GRANT + _ISC_NOTICE),
    ("ISC", _ISC_GRANT + _ISC_NOTICE + _ISC_WARRANTY),
    ("0BSD", _ISC_GRANT + "." + _ISC_WARRANTY),
    ("Zlib", _ZLIB),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain." + _UNLICENSE),
)

_WORD = re.compile(r"[a-z0-9]+(?:\.[a-z0-9]+)*")
_LOWER = {c: c + 32 for c in range(65, 91)}


def words(text: str) -> list[str]:
    """Normalised words: A-Z in lower case, marks dropped, British spelling as American."""
    return ["license" if w == "licence" else w for w in _WORD.findall(text.translate(_LOWER))]


def bigrams(own: list[str]) -> Counter:
    return Counter(zip(own, own[1:]))


class Templates:
    """Templates as counted bigrams, with the templates of each bigram and the bounds that reaching the threshold sets."""

    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        ratio = threshold / (2 - threshold)
        rows = [(name, own) for name, text in templates for own in (bigrams(words(text)),) if own]
        self.threshold, self.names, self.counts = threshold, [name for name, _ in rows], [own for _, own in rows]
        self.sizes = [own.total() for own in self.counts]
        #: Fewest bigrams a run shares, and most it has.
        self.need = [max(1, math.ceil(n * ratio - 1e-9)) for n in self.sizes]
        self.reach = [math.floor(n / ratio + 1e-9) for n in self.sizes]
        self.holders: dict[tuple[str, str], tuple[int, ...]] = {}
        for number, (_, own) in enumerate(rows):
            for pair in own:
                self.holders[pair] = (*self.holders.get(pair, ()), number)


def _best_runs(pairs: list, places: list[int], number: int, known: Templates) -> Iterator[tuple]:
    """The best run of one template from each start, as a rank; the longest of equal ones."""
    size, need, reach, counts = known.sizes[number], known.need[number], known.reach[number], known.counts[number]
    for i, start in enumerate(places[:len(places) - need + 1]):
        stop = start + reach
        if places[i + need - 1] >= stop:
            continue
        best, seen, shared = None, Counter(), 0
        for at in places[i:bisect_left(places, stop, i)]:
            pair = pairs[at]
            seen[pair] += 1
            if seen[pair] > counts[pair]:
                continue
            shared += 1
            both = size + at - start + 1
            if shared >= need and 2 * shared / both >= known.threshold and (best is None or 2 * shared / both >= best[1]):
                best = (4 * shared - both, 2 * shared / both, at)
        if best:
            yield -best[0], -best[1], start, best[2] - start, known.names[number], number


def scan(text: str, known: Templates) -> list[tuple[str, float, int, int, int, int]]:
    """(license, dice, first word, words, start, end) of the licences of a text in order; start and end are code points.

    The best run counts first; one that shares a word with a run that counts does not."""
    own = words(text)
    pairs = list(zip(own, own[1:]))
    places: dict[int, list[int]] = {}
    for at, pair in enumerate(pairs):
        for number in known.holders.get(pair, ()):
            places.setdefault(number, []).append(at)
    runs = [run for number, at in places.items() if len(at) >= known.need[number] for run in _best_runs(pairs, at, number, known)]
    if not runs:
        return []
    runs.sort()
    taken, kept = bytearray(len(own)), []
    for _, less, first, more, name, _ in runs:
        end = first + more + 2
        if taken.find(1, first, end) < 0:
            kept.append((first, end, name, -less))
            taken[first:end] = b"\x01" * (end - first)
    kept.sort()
    edges = {w for first, end, _, _ in kept for w in (first, end - 1)}
    spans = {i: m.span() for i, m in enumerate(_WORD.finditer(text.translate(_LOWER))) if i in edges}
    return [(name, dice, first, end - first, spans[first][0], spans[end - 1][1]) for first, end, name, dice in kept]


def _scan(templates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(*templates)
        kinds = [pa.int64(), pa.string(), pa.float64(), *[pa.int64()] * 4]
        for batch in batches:
            rows = [(i, *m) for i, t in zip(batch.column(0).to_pylist(), batch.column(1)) for m in scan(t.as_py() or "", known)]
            columns = zip(*rows) if rows else ([] for _ in kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)],
                                             names=["doc_id", "license", "dice", "first_word", "n_words", "start", "end"])

    return run


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, dice, first_word, n_words, start, end): the places of licences in each text.

    Words are counted from 0 in the normalised text, start and end are code points of the original one, end exclusive. A null
    or empty text has no licence; a text can have several, and one licence at several places. Of equal runs from one start the longest counts, of others the
    first, then by name. A text is read whole, whatever its length; memory is some hundred bytes a word of the
    longest one. Repeated rows give repeated results, an empty table none; further columns do not matter.
    """
    ship(docs.sparkSession)
    src = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return src.mapInArrow(_scan((tuple(templates), threshold)),
                          "doc_id long, license string, dice double, first_word long, n_words long, start long, end long")

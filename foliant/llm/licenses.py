"""License scans by conditional compression.

A text is taken as words, without punctuation, comment marks and case, so line breaks do not matter.
Windows of ``WINDOW`` words that overlap by half are compressed with Zstandard, once plainly and once
with all license templates as one raw dictionary; a window that gets smaller by them is a candidate. Where candidate windows share runs of three words with a template, the block that the
template would fill there is compressed with that template alone as raw dictionary. Templates whose
blocks overlap are ranked by the bytes they save, and those near the best are compared word by word:
a template is confirmed if its distinguishing words stand in the block in order and the words that are
missing or extra are few. Of confirmed templates that overlap, the one whose wording fits best is kept;
a block may so give several licenses, each with its own span.

Every row is scanned whole, where it is read; nothing is shuffled, and the work on a text grows with its
length alone. Null texts count as empty, empty texts have no findings, repeated rows give equal findings,
rows with a null id are scanned like any other, very long texts and lines are cut into windows like any
other, and an empty table gives an empty result. Columns other than id and text are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import cache
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm._shared import require, slices, table

#: Short license notices and the texts of short licenses, as they are commonly written, by SPDX
#: identifier, each with the words that set it apart.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0', "apache 2.0"),
    ("MIT", "Released under the MIT License.", "mit"),
    ("MIT", "Licensed under the MIT License.", "mit"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "permission sublicense"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu general 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gnu general 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", "gnu general 2"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gnu general 2"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3.", "gnu lesser 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3.", "gnu affero 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla 2.0"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License.", "bsd 3-clause"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License.", "bsd 2-clause"),
    ("ISC", "Licensed under the ISC License.", "isc"),
    ("EPL-2.0", "Licensed under the Eclipse Public License, version 2.0.", "eclipse 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered domain"),
    ("CC0-1.0", "Licensed under CC0 1.0.", "cc0 1.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", "cc by 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "cc by-sa 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "cc by-nc 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0.", "cc by-nd 4.0"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0.", "cc by-nc-sa 4.0"),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0.", "cc by-nc-nd 4.0"),
    ("Proprietary", "All rights reserved.", "rights reserved"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.', "permission sublicense noninfringement"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.', "apache 2.0 governing"),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.', "redistributions disclaimer advised"),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.', "redistributions endorse promote advised"),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.', "fee appear tortious"),
    ("0BSD", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.', "fee granted tortious"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.", "anyone misrepresented plainly"),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:', "organization reproduce transmit"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "unencumbered compile"),
)

#: Words of a window that is tried with all templates at once; every second half starts a new one.
WINDOW = 24
#: Bytes by which the templates make a candidate window smaller: any saving counts.
LEAST_GAIN = 1
#: Words of a run that ties a template to a place.
RUN = 3
#: Most words that may stand between two runs of one template.
INSERTED = 60
#: Templates whose saving comes within this share of the best one are compared by wording.
NEAR_BEST = 0.5
#: Least share of the template's words that the block has in the same order.
LEAST_WORDING = 0.6
#: Zstandard levels: the fastest for windows, whose matches alone count; one with entropy coding to rank.
FAST_LEVEL, LEVEL = -1, 3
#: Places of the templates' hash table for windows, as a power of two: enough for all of their text.
HASH_LOG = 15
#: Characters around words that do not count: punctuation, quotes and the marks of comments.
AROUND = ".,;:()\"'*#/<>-_=|“”‘’"
#: What a window ends with, so that a match in its last bytes is seen.
TAIL = b"\n" * 8

FINDINGS = "array<struct<license:string,start:int,end:int,saved:int,missing:string>>"


class Template(NamedTuple):
    name: str
    words: list[str]
    marks: list[str]
    count: Counter
    compressor: zstandard.ZstdCompressor


class Place(NamedTuple):
    """A block that a template would fill, and the bytes that the template saves on it."""

    template: int
    start: int
    end: int
    saved: int


class Fit(NamedTuple):
    template: int
    start: int
    end: int
    score: int
    saved: int
    missing: tuple[str, ...]


def words_of(text: str) -> list[str]:
    return [w for w in (x.strip(AROUND) for x in text.lower().split()) if w]


def _compressor(dictionary: bytes | None, level: int, **options: int) -> zstandard.ZstdCompressor:
    if dictionary is None:
        return zstandard.ZstdCompressor(level=level, write_content_size=False)
    d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=False, **options)
    d.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=how)


@cache
def _templates() -> list[Template]:
    out = []
    for name, text, marks in TEMPLATES:
        words = words_of(text)
        out.append(Template(name, words, marks.split(), Counter(words), _compressor(" ".join(words).encode(), LEVEL)))
    return out


@cache
def _windows() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    """Compressors for windows: without, and with all templates, in which none repeats what a longer one holds."""
    kept: list[str] = []
    for t in sorted((" ".join(t.words) for t in _templates()), key=lambda x: (-len(x), x)):
        if not any(t in k for k in kept):
            kept.append(t)
    return _compressor(None, FAST_LEVEL), _compressor("\n".join(kept).encode(), FAST_LEVEL, hash_log=HASH_LOG)


@cache
def _plain() -> zstandard.ZstdCompressor:
    return _compressor(None, LEVEL)


@cache
def _runs() -> dict[tuple[str, ...], list[tuple[int, int]]]:
    """(template, place in it) of every run of words that a template has once."""
    found: dict[tuple[str, ...], list[tuple[int, int]]] = {}
    for t, template in enumerate(_templates()):
        grams = [tuple(template.words[i : i + RUN]) for i in range(len(template.words) - RUN + 1)]
        once = Counter(grams)
        for i, g in enumerate(grams):
            if once[g] == 1:
                found.setdefault(g, []).append((t, i))
    return found


def _raw(words: list[str]) -> bytes:
    return " ".join(words).encode("utf-8", "surrogatepass")


def candidates(words: list[str]) -> list[tuple[int, int]]:
    """(start, end) of the stretches of words that all templates together make smaller."""
    plain, known = _windows()
    step, out = WINDOW // 2, []
    for i in range(0, max(1, len(words) - step), step):
        raw = _raw(words[i : i + WINDOW]) + TAIL
        if len(plain.compress(raw)) - len(known.compress(raw)) >= LEAST_GAIN:
            if out and i <= out[-1][1]:
                out[-1] = (out[-1][0], i + WINDOW)
            else:
                out.append((i, i + WINDOW))
    return out


def _in_order(marks: list[str], have: list[str]) -> bool:
    rest = iter(have)
    return all(any(m == h for h in rest) for m in marks)


def _places(words: list[str], stretch: tuple[int, int]) -> list[Place]:
    """Blocks that templates would fill, by the runs that they share with a stretch and its surroundings."""
    lo, hi = max(0, stretch[0] - WINDOW), min(len(words), stretch[1] + WINDOW)
    known, open_, spans = _runs(), {}, []
    for i in range(lo, hi - RUN + 1):
        for t, at in known.get((words[i], words[i + 1], words[i + 2]), ()):
            last = open_.get(t)
            if last and at > last[3] and i - last[2] <= at - last[3] + INSERTED:
                last[2], last[3] = i, at
            else:
                if last:
                    spans.append((t, *last))
                open_[t] = [i, at, i, at]
    spans.extend((t, *last) for t, last in open_.items())
    out = []
    for t, i, at, j, end_at in spans:
        template = _templates()[t]
        start, end = max(0, i - at), min(len(words), j + len(template.words) - end_at)
        block = _with_room(words, start, end)
        if not _in_order(template.marks, block) or (template.count & Counter(block)).total() < LEAST_WORDING * len(template.words):
            continue
        raw = _raw(block)
        saved = len(_plain().compress(raw)) - len(template.compressor.compress(raw))
        if saved > 0:
            out.append(Place(t, start, end, saved))
    return out


def _with_room(words: list[str], start: int, end: int) -> list[str]:
    """A block with a little room for words that were put in or left out before the first and after the last run."""
    return words[max(0, start - RUN) : end + RUN]


def _winners(places: list[Place]) -> Iterator[Place]:
    """Places that save nearly as much as any other that they overlap."""
    places = sorted(places, key=lambda p: (p.start, p.end))
    longest = max((p.end - p.start for p in places), default=0)
    starts = [p.start for p in places]
    for p in places:
        near = places[bisect_left(starts, p.start - longest) : bisect_left(starts, p.end)]
        if p.saved >= NEAR_BEST * max(o.saved for o in near if o.end > p.start):
            yield p


def compare(place: Place, words: list[str]) -> Fit | None:
    """How a template's words and a block's differ, if they differ little."""
    template = _templates()[place.template]
    want, block = template.words, _with_room(words, place.start, place.end)
    n, first = len(want), max(0, place.start - RUN)
    for i in range(len(block) - n + 1):
        if block[i] == want[0] and block[i : i + n] == want:
            return Fit(place.template, first + i, first + i + n, n, place.saved, ())
    same = [m for m in SequenceMatcher(None, want, block, autojunk=False).get_matching_blocks() if m.size]
    # A single word apart from all others is no part of the wording.
    while len(same) > 1 and same[0].size == 1 and same[1].b - same[0].b > RUN:
        same.pop(0)
    while len(same) > 1 and same[-1].size == 1 and same[-1].b - same[-2].b - same[-2].size >= RUN:
        same.pop()
    size = sum(m.size for m in same)
    if not same or size < LEAST_WORDING * n:
        return None
    start, end = same[0].b, same[-1].b + same[-1].size
    if not _in_order(template.marks, block[start:end]):
        return None
    held = {i for m in same for i in range(m.a, m.a + m.size)}
    missing = tuple(w for i, w in enumerate(want) if i not in held)
    score = size - len(missing) - (end - start - size)
    return Fit(place.template, first + start, first + end, score, place.saved, missing) if score > 0 else None


def find_licenses(text: str | None) -> list[tuple[str, int, int, int, str]]:
    """(license, start, end, saved, missing) without overlaps, in order; places are code points."""
    words = words_of(text or "")
    stretches = candidates(words) if words else []
    if not stretches:
        return []
    fits = {f for stretch in stretches for p in _winners(_places(words, stretch)) if (f := compare(p, words))}
    kept: list[Fit] = []
    ends: list[int] = []
    for f in sorted(fits, key=lambda f: (-f.score, -f.saved, f.start, f.template)):
        i = bisect_left(ends, f.start + 1)
        if i == len(kept) or kept[i].start >= f.end:
            kept.insert(i, f)
            ends.insert(i, f.end)
    if not kept:
        return []
    spans = [m.span() for m in re.finditer(r"\S+", text) if m[0].lower().strip(AROUND)]
    return [(_templates()[f.template].name, spans[f.start][0], spans[f.end - 1][1], f.saved, " ".join(f.missing)) for f in kept]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("saved", pa.int32()), ("missing", pa.string())]))
    names = [f.name for f in kind.value_type]
    for batch in slices(batches):
        rows = [[dict(zip(names, f)) for f in find_licenses(t)] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "findings"])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, findings): one row per input row."""
    rows = require(docs, id_col, text_col).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, findings {FINDINGS}")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.size("findings").cast("long").alias("n_licenses"),
        F.array_join(F.transform("findings", lambda f: f["license"]), ",").alias("licenses"),
        F.array_join(
            F.transform("findings", lambda f: F.concat_ws(":", f["license"], f["start"].cast("string"), f["end"].cast("string"))), ","
        ).alias("spans"),
    )

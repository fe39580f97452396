"""Licence scan by conditional compression.

Lines that mention a licence, and runs of such lines, are candidate blocks.
Each is compressed on its own and with every template as a raw dictionary;
templates are ranked by how much they shrink the block. The best ones are then
confirmed by the exact wording: words of the template that the text lacks and
words it has in between. A template is confirmed if little is missing and, for
one-line notices, nothing stands in between.

Defined cases: null or empty texts and texts that mention no licence give no
row; repeated rows are scanned one by one; very long runs of candidate lines
are looked at in spans that overlap by more than any template; what a confirmed
text does not cover is scanned on; a notice may be wrapped over two lines; of equally good
templates the first by name wins; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlint.llm.common import column
from fleetlint.model import MIT_TEXT
from fleetlint.session import tune

# Names of licences as notices write them, by SPDX identifier.
NAMES = {
    "AGPL-3.0": ["the GNU Affero General Public License, version 3"],
    "Apache-2.0": ["the Apache License, Version 2.0", "Apache 2.0"],
    "BSD-2-Clause": ["the BSD 2-Clause License"],
    "BSD-3-Clause": ["the BSD 3-Clause License"],
    "CC-BY-4.0": ["CC BY 4.0", "the Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["CC0 1.0 Universal"],
    "GPL-2.0": ["the GNU General Public License, version 2"],
    "GPL-3.0": ["the GNU General Public License, version 3"],
    "ISC": ["the ISC License"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3"],
    "MIT": ["the MIT License"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0"],
}
_CONDITIONS = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
"""
_ENDORSE = """3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
"""
_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
_GNU = """This program is free software: you can redistribute it and/or modify
it under the terms of the {0} as published by
the Free Software Foundation, either version {1} of the License, or
(at your option) any later version.
This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
{0} for more details.
You should have received a copy of the {0}
along with this program. If not, see <https://www.gnu.org/licenses/>.
"""
#: Full texts of short licences and the standard headers of long ones.
TEXTS = {
    "AGPL-3.0": _GNU.format("GNU Affero General Public License", 3),
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
""",
    "BSD-2-Clause": _CONDITIONS + _AS_IS,
    "BSD-3-Clause": _CONDITIONS + _ENDORSE + _AS_IS,
    "GPL-2.0": _GNU.format("GNU General Public License", 2),
    "GPL-3.0": _GNU.format("GNU General Public License", 3),
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
""",
    "LGPL-3.0": _GNU.format("GNU Lesser General Public License", 3),
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
""",
}
NOTICES = ["Licensed under {}.", "Released under {}.", "This work is licensed under {}."]

#: Least share by which the best template must shrink a block, and how many templates are looked at closely.
LEAST_GAIN, FINALISTS = 0.15, 4
#: Lines between candidate lines of one block, lines around a block that a template may reach (more than any
#: template has), and lines by which the spans of a long run are moved on; a span is twice as long.
GAP, MARGIN, STEP = 4, 40, 80

_CUES = (b"licen", b"copyright", b"permission is hereby", b"warrant", b"public domain")
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


@dataclass(frozen=True)
class Template:
    licence: str
    text: str
    notice: bool  # one line


def templates() -> list[Template]:
    """Notices made from names and phrases, SPDX tags, and full texts."""
    made = []
    for spdx, names in NAMES.items():
        made.extend(Template(spdx, phrase.format(name), True) for name in names for phrase in NOTICES)
        made.append(Template(spdx, f"SPDX-License-Identifier: {spdx}", True))
    made.extend(Template(spdx, text, False) for spdx, text in TEXTS.items())
    made.append(Template("MIT", MIT_TEXT.replace("{holder}", "year owner"), False))
    return made


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Scanner:
    def __init__(self, known: list[Template]):
        self.known = known
        self.words = [[w for w in words(t.text) if w not in ("year", "owner")] for t in known]
        self.plain = zstandard.ZstdCompressor(level=3)
        raw = zstandard.DICT_TYPE_RAWCONTENT
        self.primed = [
            zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(t.text.encode(), dict_type=raw))
            for t in known
        ]

    def gains(self, block: bytes, notice: bool) -> list[tuple[float, int]]:
        """Templates by the share of the compressed size that they save, best first."""
        base = len(self.plain.compress(block))
        found = [
            (1 - len(self.primed[k].compress(block)) / base, k) for k, t in enumerate(self.known) if t.notice == notice]
        return sorted((f for f in found if f[0] >= LEAST_GAIN), key=lambda f: (-f[0], f[1]))[:FINALISTS]

    def differences(self, k: int, window: list[str]) -> tuple[int, int]:
        """Template words that the window lacks, and window words between its first and last match."""
        match = SequenceMatcher(None, self.words[k], window, autojunk=False)
        runs = [m for m in match.get_matching_blocks() if m.size]
        if not runs:
            return len(self.words[k]), 0
        held = sum(m.size for m in runs)
        reach = runs[-1].b + runs[-1].size - runs[0].b
        return len(self.words[k]) - held, reach - held

    def judge(self, block: bytes, window: str, notice: bool) -> tuple | None:
        ranked = self.gains(block, notice)
        if not ranked:
            return None
        near = words(window)
        best = None
        for gain, k in ranked:
            missing, extra = self.differences(k, near)
            size = len(self.words[k])
            sure = (missing == 0 and extra == 0) if notice else (missing <= 0.15 * size and extra <= 0.3 * size)
            entry = (not sure, missing + extra, -gain, self.known[k].licence, missing, extra, gain)
            best = min(best, entry) if best else entry
        return best[3], best[6], best[4], best[5], not best[0]

    def located(self, k: int, near: list[str]) -> tuple[int, int, int, int]:
        """Missing and extra words of a template around its longest match, and where that stretch starts and ends."""
        own = self.words[k]
        core = SequenceMatcher(None, own, near, autojunk=False).find_longest_match()
        if not core.size:
            return len(own), 0, 0, 0
        slack = int(0.3 * len(own)) + 1
        start = max(core.b - core.a - slack, 0)
        part = near[start: core.b + len(own) - core.a + slack]
        runs = [m for m in SequenceMatcher(None, own, part, autojunk=False).get_matching_blocks() if m.size]
        # Stray words at the ends, which the text around the licence shares with it, are no part of it.
        while len(runs) > 1 and runs[0].size < 3 and runs[1].b - runs[0].b - runs[0].size > 2:
            runs.pop(0)
        while len(runs) > 1 and runs[-1].size < 3 and runs[-1].b - runs[-2].b - runs[-2].size > 2:
            runs.pop()
        a, b = runs[0].b, runs[-1].b + runs[-1].size
        held = sum(m.size for m in runs)
        return len(own) - held, b - a - held, start + a, start + b

    def texts_in(self, lines: list[bytes], first: int, last: int) -> Iterator[tuple]:
        """The confirmed texts of several lines that overlap no other, and the lines they cover."""
        open_parts = [(first, last)]
        while open_parts:
            lo, hi = open_parts.pop()
            block = b"\n".join(lines[lo: hi + 1])
            base = len(self.plain.compress(block))
            near, at = [], []
            for k in range(lo, hi + 1):
                own = words(lines[k].decode("utf-8", "replace"))
                near.extend(own)
                at.extend([k] * len(own))
            best = None
            for k, t in enumerate(self.known):
                if t.notice:
                    continue
                # A text that is a part of the block can save that part only.
                gain = 1 - len(self.primed[k].compress(block)) / base
                if gain < LEAST_GAIN * min(1, len(t.text) / len(block)):
                    continue
                missing, extra, a, b = self.located(k, near)
                if b and missing <= 0.15 * len(self.words[k]) and extra <= 0.3 * len(self.words[k]):
                    entry = (missing + extra, -gain, t.licence, missing, extra, at[a], at[b - 1])
                    best = min(best, entry) if best else entry
            if best:
                a, b = best[5], best[6]
                yield a, b, best[2], -best[1], best[3], best[4], True
                open_parts.extend((x, y) for x, y in ((lo, a - 1), (b + 1, hi)) if x < y)

    def scan(self, raw: bytes) -> Iterator[tuple]:
        """``first_line, last_line, licence, gain, missing, extra, confirmed`` of every candidate block."""
        low = raw.lower()
        if not any(cue in low for cue in _CUES):
            return
        lines = raw.split(b"\n")
        cued = [k for k, line in enumerate(low.split(b"\n")) if any(cue in line for cue in _CUES)]
        covered: set[int] = set()
        for first, last in self.runs(cued):
            lo, end = max(first - MARGIN, 0), min(last + MARGIN, len(lines) - 1)
            while lo <= end:
                # Spans overlap by more than a template; what one has found is not looked at again.
                start = lo
                for k in [*(c for c in range(lo, min(lo + 2 * STEP, end + 1)) if c in covered), min(lo + 2 * STEP, end + 1)]:
                    if k - start > 1:
                        for found in self.texts_in(lines, start, k - 1):
                            inside = [c for c in cued if found[0] <= c <= found[1]]
                            covered.update(range(found[0], found[1] + 1))
                            if inside:
                                yield (inside[0], inside[-1], *found[2:])
                    start = k + 1
                if lo + 2 * STEP > end:
                    break
                lo += STEP
        for k in cued:
            if k in covered:
                continue
            own = self.judge(lines[k], lines[k].decode("utf-8", "replace"), True)
            span = (k, k)
            for a in () if own and own[4] else (k - 1, k):
                # A notice may be wrapped over two lines.
                if a >= 0 and a + 1 < len(lines) and a not in covered and a + 1 not in covered:
                    both = lines[a] + b" " + lines[a + 1]
                    wrapped = self.judge(both, both.decode("utf-8", "replace"), True)
                    if wrapped and wrapped[4]:
                        # The other line's own notice is its own row.
                        alone = self.judge(lines[2 * a + 1 - k], lines[2 * a + 1 - k].decode("utf-8", "replace"), True)
                        if not (alone and alone[4]):
                            own, span = wrapped, (a, a + 1)
                            break
            if own:
                if span[0] != span[1]:
                    covered.update(span)
                yield (*span, *own)

    @staticmethod
    def runs(cued: list[int]) -> Iterator[tuple[int, int]]:
        start = 0
        for k in range(1, len(cued) + 1):
            if k == len(cued) or cued[k] - cued[k - 1] > GAP:
                yield cued[start], cued[k - 1]
                start = k


FOUND = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("first_line", T.IntegerType(), False),
    T.StructField("last_line", T.IntegerType(), False), T.StructField("licence", T.StringType(), False),
    T.StructField("gain", T.DoubleType(), False), T.StructField("n_missing", T.IntegerType(), False),
    T.StructField("n_extra", T.IntegerType(), False), T.StructField("confirmed", T.BooleanType(), False),
])


def found_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per block that a template shrinks: lines from 0, licence, gain, wording differences, whether confirmed."""
    tune(docs.sparkSession)
    source = docs.select(
        column(id_col).cast("long").alias("doc_id"), column(text_col).cast("binary").alias("raw")).where(F.col("raw").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates())
        types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.bool_()]
        for batch in batches:
            rows = [
                (doc_id, *found)
                for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for found in scanner.scan(raw)
            ]
            columns = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=FOUND.names)

    return source.mapInArrow(run, FOUND)

"""Licence scan: normalised text against licence templates by the Dice coefficient of word bigrams."""

from __future__ import annotations

import heapq
import re
from bisect import bisect_right
from collections.abc import Iterator
from importlib import resources
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_arrow

THRESHOLD = 0.8

#: Fixed texts: short licences and the notices by which works refer to them.
NOTICES: list[tuple[str, str]] = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
]
#: Whole texts of longer licences, a file each, as published.
TEXTS = resources.files(__package__).joinpath("license_texts")
#: Where a licence's terms end: what comes behind says how to apply it, and holds notices of its own.
APPENDIX = re.compile(r"\n\s*(?:END OF TERMS AND CONDITIONS|ADDENDUM: How to use this License)")


def full_texts(folder: str | None = None) -> list[tuple[str, str]]:
    """(name, terms without their appendix) of each NAME.txt in a folder that the driver can read (this package's own)."""
    files = sorted((f for f in (Path(folder) if folder else TEXTS).iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    return [(f.name[: -len(".txt")], APPENDIX.split(f.read_text(encoding="utf-8"), maxsplit=1)[0]) for f in files]


TEMPLATES: list[tuple[str, str]] = NOTICES + full_texts()
#: Templates of which a bigram's bits fill one integer.
BITS = 63
#: Blocks of starts a template is looked at in, and elements that are computed at once.
BLOCKS, ELEMENTS = 64, 1 << 18

WORD = re.compile(r"[^\W_]+")


def normalised(text: str) -> list[str]:
    """Words of letters and digits, lower-cased; punctuation, layout and marks of comments go."""
    return WORD.findall(text.lower())


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:], strict=False))


def dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


class Templates:
    """Templates by their bigrams, and what can be known from sizes alone. Built on the driver; tasks get arrays and a dictionary."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float) -> None:
        self.names = [n for n, _ in templates]
        texts = [normalised(t) for _, t in templates]
        sets = [bigrams(t) for t in texts]
        self.sizes = [len(s) for s in sets]
        vocabulary = sorted({w for s in sets for b in s for w in b})
        self.word = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.width = len(vocabulary) + 1
        # A template's bit at each of its bigrams: bigrams have a number, and a row of integers under it (the row 0 has no bits).
        known = {b: i + 1 for i, b in enumerate(sorted({(self.word[a], self.word[b]) for s in sets for a, b in s}))}
        self.pairs = np.array([a * self.width + b for a, b in known], np.int64)
        self.mask = np.zeros((len(known) + 1, max(1, -(-len(sets) // BITS))), np.int64)
        for k, s in enumerate(sets):
            for a, b in s:
                self.mask[known[self.word[a], self.word[b]], k // BITS] |= 1 << k % BITS
        # With |A| and |B| bigrams the coefficient is at most 2 min / (|A| + |B|): a window must share enough, and isn't much longer.
        self.least = [int(np.ceil(threshold / (2 - threshold) * n - 1e-9)) for n in self.sizes]
        self.reach = [int(np.floor((2 - threshold) / threshold * max(0, len(t) - 1) + 1e-9)) for t in texts]
        self.smallest = min(self.least, default=1)
        self.threshold = threshold

    def bits(self, ids: np.ndarray) -> np.ndarray:
        """The templates' bits at each bigram of a text's words (0: no template's word)."""
        out = np.zeros((max(0, len(ids) - 1), self.mask.shape[1]), np.int64)
        at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        pair = ids[at] * self.width + ids[at + 1]
        number = np.minimum(np.searchsorted(self.pairs, pair), max(0, len(self.pairs) - 1))
        if len(at):
            out[at] = self.mask[np.where(self.pairs[number] == pair, number + 1, 0)]
        return out

    def starts(self, mask: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(template, its bigrams' places, those of them at which a window may begin) of templates that sizes leave."""
        some = np.flatnonzero(mask.any(axis=1))
        mask, out = mask[some], []
        for k, need in enumerate(self.least):
            if len(some) < need:
                continue
            at = some[(mask[:, k // BITS] >> k % BITS & 1).astype(bool)]
            if len(at) >= need > 0:
                first = at[: len(at) - need + 1]
                if len(first := first[at[need - 1 :] - first < self.reach[k]]):
                    out.append((k, at, first))
        return out

    def matches(self, words: list[str], mask: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(template, first word, last word, coefficient): windows of words that match, the best first, none touching
        another. mask: templates' bits at each bigram of the text.

        Best first: a block of neighbouring starts has a bound from its outermost ones, which counts what the first one
        shares against what the last one holds; starts are only computed where no window that is known is better, and not at
        all within windows that are kept.
        """
        left = self.starts(mask)
        if not left:
            return []
        codes: dict[str, int] = {}
        code = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
        key = code[:-1] * len(codes) + code[1:]
        order = np.argsort(key, kind="stable")
        n, longest = len(key), max(self.reach[k] for k, _, _ in left) * 2 + 2
        earlier = np.full(n + longest, n, np.int64)  # the place of the same bigram before; none: -1; behind the text nothing is new
        earlier[order] = np.where(np.r_[False, np.diff(key[order]) == 0], np.r_[-1, order[:-1]], -1)
        heap: list[tuple] = []
        shared = {}
        for k, at, first in left:
            shared[k] = np.zeros(n + longest, bool)
            shared[k][at] = True
            step = max(1, self.sizes[k] // BLOCKS)
            cut = np.flatnonzero(np.r_[True, np.diff(first // step) > 0])
            low, high = first[cut], first[np.r_[cut[1:], len(first)] - 1]
            score, end = self._best(k, low, high, step - 1, earlier, shared[k])
            for i in np.flatnonzero(score >= self.threshold - 1e-12).tolist():
                if step == 1:
                    heap.append((-score[i], 1, -self.sizes[k], k, int(low[i]), int(end[i]) + 1))
                else:
                    heap.append((-score[i], 0, k, i, first[cut[i] : cut[i + 1] if i + 1 < len(cut) else len(first)]))
        heapq.heapify(heap)
        begins: list[int] = []
        kept: list[tuple[int, int, int, float]] = []
        touches = lambda a, b: bool((i := bisect_right(begins, b)) and kept[i - 1][2] >= a)
        while heap:
            top = heapq.heappop(heap)
            if top[1]:
                score, _, _, k, a, b = top
                if not touches(a, b):
                    i = bisect_right(begins, a)
                    begins.insert(i, a)
                    kept.insert(i, (k, a, b, float(-score)))
                continue
            k, own = top[2], np.array([a for a in top[4].tolist() if not touches(a, a)], np.int64)
            score, end = self._best(k, own, own, 0, earlier, shared[k])
            for i in np.flatnonzero(score >= self.threshold - 1e-12).tolist():
                heapq.heappush(heap, (-score[i], 1, -self.sizes[k], k, int(own[i]), int(end[i]) + 1))
        return kept

    def _best(self, k: int, low: np.ndarray, high: np.ndarray, more: int, earlier: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each block of starts from low to high: a bound of its windows' coefficients and the last bigram that reaches it. A
        block of one start has its best window's coefficient."""
        wide = self.reach[k] + more
        score, end = np.zeros(len(low)), np.zeros(len(low), np.int64)
        rows = max(1, ELEMENTS // max(1, wide))
        for i in range(0, len(low), rows):
            a, z = low[i : i + rows, None], high[i : i + rows, None]
            at = a + np.arange(wide)
            before, own = earlier[at], shared[at]
            common = np.cumsum((before < a) & own, axis=1, dtype=np.int32)
            inside = np.cumsum((before < z) & (at >= z), axis=1, dtype=np.int32)
            dice = np.where(own & (common >= self.least[k]), 2 * common / (np.maximum(inside, common) + self.sizes[k]), 0.0)
            last = wide - 1 - np.argmax(dice[:, ::-1], axis=1)
            score[i : i + rows], end[i : i + rows] = dice[np.arange(len(a)), last], at[np.arange(len(a)), last]
        return score, end


MATCH = T.StructType([T.StructField("license", T.StringType()), T.StructField("template", T.IntegerType()), T.StructField("dice", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def license_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: id_col, n_words (normalised) and matches: array of (license, template, dice, start, end).

    Within a whole text every window of words whose set of bigrams and a template's have a Dice coefficient of `threshold` or
    more is looked for, that is (2 - t) / t times as long as the template at most, counting all words; of windows that touch, the best
    of each place to begin at competes, and the best stays (then the longer template). start and end are code points,
    end exclusive. Sizes prune: a window shares at least t / (2 - t) of a template's bigrams and is at most (2 - t) / t
    times as long, so templates of which a text holds too few bigrams are never compared. Rows stay where they are.
    Null, empty and one-word texts match nothing; null ids and repeated rows are judged row by row; an empty table gives an
    empty result; other columns are ignored. Any number of templates.
    """
    bound_arrow(docs.sparkSession)
    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("matches", T.ArrayType(MATCH))])
    kind = pa.list_(pa.struct([("license", pa.string()), ("template", pa.int32()), ("dice", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))

    t = Templates(templates, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = t.word.get
        for batch in batches:
            sizes, rows = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                words = normalised(text)
                sizes.append(len(words))
                ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
                both = (ids[:-1] > 0) & (ids[1:] > 0)
                out = []
                if both.sum() >= t.smallest:
                    if found := t.matches(words, t.bits(ids)):
                        # lower() may change lengths ("İ"), so places come from the text as it is, word by word
                        spots = [m.span() for m in WORD.finditer(text)]
                        if len(spots) != len(words):
                            spots = [(0, len(text))] * len(words)
                        out = [{"license": t.names[k], "template": k, "dice": s, "start": spots[a][0], "end": spots[b][1]} for k, a, b, s in found]
                rows.append(out)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(rows, kind)], names=schema.names)

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: all documents, production parameters."""
    rows = license_matches(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    spans = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string"))), ",")
    return rows.select("doc_id", "n_words", F.size("matches").cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"), F.round(F.coalesce(F.array_max(F.transform("matches", lambda m: m["dice"])), F.lit(0.0)), 9).alias("best_dice"), spans.alias("spans"))

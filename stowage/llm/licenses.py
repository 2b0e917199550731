"""Licence texts in documents, by the Dice coefficient over word bigrams.

Texts and templates become lower-case words without punctuation. A window of a
text resembles a template by 2 c / (w + m), c being the bigrams they share
(with repetition), w and m those that each has. Size bounds prune: at
threshold t only windows of m t / (2 - t) to m (2 - t) / t bigrams can match,
and such a window shares at least m t / (2 - t) of them, so a template is
looked at only where that many of its bigrams lie within the longest window.
There the best window is found exactly; it begins and ends with a shared bigram.

Of overlapping matches the most similar stays (then the longer, the earlier, and the name).

Templates are whole licence texts and the notices and lines by which works are
put under them, so that of kindred licences the closest wins. Whole texts end
before their appendix of sample notices, which is found as a notice.

Scale: one map over documents; the templates are a fixed list of a few hundred
kilobytes. Memory for one text at a time.

Defined results: null, empty and one-word texts match nothing; every row is
scanned by itself, so repeats and nulls in doc_id don't matter; no rows in, no
rows out; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable
from functools import cache
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm.words import ONLY_WORDS, U, Words, chunks, rows_by_bytes
from stowage.llm.workers import lean
from stowage.tables import table

THRESHOLD = 0.8



def _gnu(name: str, versions: str, end: str, library: bool = False) -> str:
    """The notice by which works are put under a GNU licence."""
    work, free = ("library", "software;") if library else ("program", "software:" if "3" in versions else "software;")
    return f"This {work} is free {free} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{versions}. This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this {work}{end}"


def _later(version: str) -> str:
    return f", either version {version} of the License, or (at your option) any later version"


_GPL, _LESSER, _LIBRARY, _AFFERO = "General Public License", "Lesser General Public License", "Library General Public License", "Affero General Public License"
_WEB = ". If not, see <https://www.gnu.org/licenses/>."
_POST = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
_OLD_POST = "; if not, write to the Free Software Foundation, Inc., 59 Temple Place, Suite 330, Boston, MA 02111-1307 USA."

_BSD_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE {holder} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE {owner} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_HOLDERS = _BSD_DISCLAIMER.format(holder="COPYRIGHT HOLDERS AND CONTRIBUTORS", owner="COPYRIGHT HOLDER OR CONTRIBUTORS")
_REGENTS = _BSD_DISCLAIMER.format(holder="REGENTS AND CONTRIBUTORS", owner="REGENTS OR CONTRIBUTORS")

#: The parts of Creative Commons' names.
_CC = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nd": "Attribution-NoDerivatives", "by-nc": "Attribution-NonCommercial", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}

#: Notices by which works are put under common licences, short licence texts, and by ``license_texts`` whole ones.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "mit-line": "Released under the MIT License.",
    "mit-licensed": "This project is licensed under the MIT License. See the LICENSE file for details.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "gpl-2.0-or-later": _gnu(_GPL, _later("2"), _WEB),
    "gpl-2.0-or-later-post": _gnu(_GPL, _later("2"), _POST),
    "gpl-2.0-or-later-old-post": _gnu(_GPL, _later("2"), _OLD_POST),
    "gpl-2.0-only": _gnu(_GPL + " version 2", "", _WEB).replace("See the GNU General Public License version 2", "See the GNU General Public License").replace("a copy of the GNU General Public License version 2", "a copy of the GNU General Public License"),
    "gpl-2.0-only-post": _gnu(_GPL, "; version 2 of the License", _POST),
    "gpl-3.0-or-later": _gnu(_GPL, _later("3"), _WEB),
    "gpl-3.0-only": _gnu(_GPL, ", version 3 of the License", _WEB),
    "lgpl-2.0-or-later": _gnu(_LIBRARY, _later("2"), _POST, True),
    "lgpl-2.1-or-later": _gnu(_LESSER, _later("2.1"), _POST, True),
    "lgpl-2.1-or-later-old-post": _gnu(_LESSER, _later("2.1"), _OLD_POST, True),
    "lgpl-2.1-or-later-web": _gnu(_LESSER, _later("2.1"), _WEB, True),
    "lgpl-2.1-or-later-program": _gnu(_LESSER, _later("2.1"), _WEB),
    "lgpl-3.0-or-later": _gnu(_LESSER, _later("3"), _WEB),
    "lgpl-3.0-or-later-library": _gnu(_LESSER, _later("3"), _WEB, True),
    "agpl-3.0-or-later": _gnu(_AFFERO, _later("3"), _WEB),
    "agpl-3.0-only": _gnu(_AFFERO, ", version 3 of the License", _WEB),
    "gfdl-1.2-or-later": 'Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.2 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts. A copy of the license is included in the section entitled "GNU Free Documentation License".',
    "gfdl-1.3-or-later": 'Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts. A copy of the license is included in the section entitled "GNU Free Documentation License".',
    "epl-1.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "bsd-2-clause": f"{_BSD_CONDITIONS} {_HOLDERS}",
    "bsd-3-clause": f"{_BSD_CONDITIONS} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_HOLDERS}",
    "bsd-3-clause-university": f"{_BSD_CONDITIONS} 3. Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_REGENTS}",
    "bsd-4-clause-university": f"{_BSD_CONDITIONS} 3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the University of California, Berkeley and its contributors. 4. Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_REGENTS}",
    "0bsd": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "bsl-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org/>',
    "bsd-line": "Released under the BSD License.",
    "bsd-2-clause-line": "Licensed under the BSD 2-Clause License.",
    "bsd-3-clause-line": "Licensed under the BSD 3-Clause License.",
    "isc-line": "Released under the ISC License.",
    "mpl-2.0-line": "Licensed under the Mozilla Public License, version 2.0.",
    "epl-2.0-line": "Licensed under the Eclipse Public License, version 2.0.",
    "lgpl-2.1-line": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "lgpl-3.0-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0-line": "This work is licensed under the GNU Affero General Public License, version 3.",
}
for _name, _long in _CC.items():
    TEMPLATES[f"cc-{_name}-4.0-line"] = f"Licensed under CC {_name.upper()} 4.0."
    TEMPLATES[f"cc-{_name}-4.0"] = f"This work is licensed under a Creative Commons {_long} 4.0 International License."
    _long = _long.replace("NoDerivatives", "NoDerivs")
    TEMPLATES[f"cc-{_name}-3.0"] = f"This work is licensed under a Creative Commons {_long} 3.0 Unported License."
TEMPLATES |= {f.name.removesuffix(".txt"): f.read_text("utf-8").strip() for f in files("stowage.llm").joinpath("license_texts").iterdir() if f.name.endswith(".txt")}


def fold(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> None:
        self.threshold = threshold
        self.templates = []
        for name, text in sorted((templates or TEMPLATES).items()):
            words = Words([fold(text)], kinds=ONLY_WORDS)
            bag = Counter(words.ngrams(2)[:-1].tolist())
            if m := bag.total():
                need = max(1, math.ceil(m * threshold / (2 - threshold) - 1e-9))
                longest = math.floor(m * (2 - threshold) / threshold + 1e-9)
                self.templates.append((name, bag, np.array(sorted(bag), U), m, need, longest))
        self.known = np.unique(np.concatenate([t[2] for t in self.templates]))
        self.owned = [np.isin(self.known, t[2]) for t in self.templates]

    def scan(self, texts: list[str | None]):
        """(text number, template, dice, first word, words) of each match."""
        raw = [fold(t) for t in texts]
        for a, b in chunks(raw):
            words = Words(raw[a:b], kinds=ONLY_WORDS)
            grams = words.ngrams(2)
            crossing = words.first[1:] - 1  # a bigram that begins with a text's last word isn't one
            number = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
            found = self.known[number] == grams
            found[crossing[crossing >= 0]] = False
            at = np.flatnonzero(found)
            near = number[at]
            matches: dict[int, list[tuple]] = {}
            for (name, bag, own, m, need, longest), owned in zip(self.templates, self.owned, strict=True):
                p = at[owned[near]]
                if len(p) < need:
                    continue
                last = p[need - 1 :]
                starts = np.flatnonzero(last - p[: len(last)] < longest)
                if not len(starts):
                    continue
                used_up = self._used_up(np.searchsorted(own, grams[p]), np.array([bag[g] for g in own.tolist()]))
                docs = np.searchsorted(words.first, p[starts], "right") - 1
                stops = np.searchsorted(p, np.minimum(p[starts] + longest, words.first[docs + 1] - 1))
                for i, doc, stop in zip(starts.tolist(), docs.tolist(), stops.tolist(), strict=True):
                    best = self._best(p[i:stop], used_up[i:stop] < i, m) if stop - i >= need else None
                    if best:
                        dice, end = best
                        first = int(p[i] - words.first[doc])
                        matches.setdefault(doc, []).append((-dice, -(end - int(p[i])), first, name, end - int(p[i]) + 2))
            for doc, rows in sorted(matches.items()):
                taken: list[tuple[int, int]] = []
                for dice, _, first, name, n in sorted(rows):
                    if all(first + n <= x or y <= first for x, y in taken):
                        taken.append((first, first + n))
                        yield a + doc, name, -dice, first, n

    @staticmethod
    def _used_up(own: np.ndarray, times: np.ndarray) -> np.ndarray:
        """For each hit the latest hit from which on a window has its bigram as often as the template before it comes; -1 without one."""
        order = np.argsort(own, kind="stable")
        by = own[order]
        back = np.arange(len(by)) - times[by]
        out = np.full(len(by), -1)
        out[order] = np.where((back >= 0) & (by[back] == by), order[back], -1)
        return out

    def _best(self, p: np.ndarray, shared: np.ndarray, m: int):
        """The best window that begins at the first hit of ``p``: (dice, its last bigram)."""
        dice = 2 * np.cumsum(shared) / (p - p[0] + 1 + m)
        best = int(np.argmax(dice))
        return (float(dice[best]), int(p[best])) if dice[best] >= self.threshold - 1e-12 else None


@cache
def standard(threshold: float) -> Scanner:
    """The scanner for ``TEMPLATES``, built once in a process."""
    return Scanner(None, threshold)


MATCHES = "doc_id long, license string, dice double, first_word long, n_words long"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per licence text found in a row of ``docs`` (doc_id, text)."""

    def run(batches: Iterable[pa.RecordBatch]):
        scanner = Scanner(templates, threshold) if templates else standard(threshold)
        for batch in rows_by_bytes(batches, 1):
            ids = batch.column(0).to_pylist()
            rows = [(ids[i], *rest) for i, *rest in scanner.scan(batch.column(1).to_pylist())]
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in MATCHES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), MATCHES)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))

"""License scans (6): canonical digest lookup.

A text is brought to a canonical form: lower case, no copyright or all-rights-reserved
lines, ``&`` as "and", every run of other characters than letters and digits one blank,
and one spelling for the words that licence texts spell in two ways.  The md5 of the
canonical form is joined with the digests of known licence texts.  The whole document, each
of its lines and each run of its blocks (lines between lines without letters and digits) are
looked up as entire texts, so a licence file, a licence notice and a wrapped notice or licence
inside a document are all found, and a text that merely mentions a licence is not.

A text is canonicalised once, line by line: the forms of its blocks and of the whole are put
together from those of its lines (with the spellings of two words applied again).  Lines and
runs of blocks that begin like a known text and end at the length of one become digests of
their own; whole texts and these parts meet the known digests in hash joins.

Null text: as empty.  An empty canonical form has a digest, but never a licence.  Very long
texts are scanned whole.  Repeated rows are scanned each for itself; an empty table gives an
empty result; other columns of the input are not touched, whatever their names.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: Whole texts of licences, in the lines that they are published in, by identifier.
BODIES = {path.stem: path.read_text(encoding="utf-8") for path in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}

# Texts of well-known licences and notices, and the identifier of each.
KNOWN = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance'
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless"
        " required by applicable law or agreed to in writing, software distributed under the License is distributed on"
        ' an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License'
        " for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        'MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and'
        ' associated documentation files (the "Software"), to deal in the Software without restriction, including'
        " without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell"
        " copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the"
        " following conditions: The above copyright notice and this permission notice shall be included in all copies"
        ' or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,'
        " EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR"
        " PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,"
        " DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN"
        " CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "SPDX-License-Identifier: MIT",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies. THE"
        ' SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING'
        " ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY"
        " SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,"
        " DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN"
        " CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "SPDX-License-Identifier: ISC",
    ],
    "BSD-3-Clause": ["SPDX-License-Identifier: BSD-3-Clause", "Released under the 3-Clause BSD License."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was"
        " not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY-4.0": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC0-1.0": ["SPDX-License-Identifier: CC0-1.0"],
}

_CONDITIONS = [
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following"
    " disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"
    " derived from this software without specific prior written permission.",
]


def _bsd(n: int) -> list[str]:
    """The BSD licence with ``n`` conditions, numbered or not, under its usual titles or none."""
    out = []
    for numbers in (["1. ", "2. ", "3. "], ["(1) ", "(2) ", "(3) "], ["* ", "* ", "* "]):
        body = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
                " following conditions are met: " + " ".join(i + x for i, x in zip(numbers, _CONDITIONS[:n], strict=False))
                + ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,'
                " INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE"
                " DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,"
                " SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR"
                " SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,"
                " WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE"
                " OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
        for body in (body, body.replace("COPYRIGHT HOLDER OR", "COPYRIGHT HOLDERS OR")):
            out += [title + body for title in ("", f"BSD {n}-Clause License ", f"The BSD {n}-Clause License ",
                                               {2: 'BSD 2-Clause "Simplified" License ', 3: 'BSD 3-Clause "New" or "Revised" License '}[n], "BSD License ")]
    return out


def _bodies(name: str) -> list[str]:
    """The whole text in its published lines and unwrapped, each also without what follows the terms."""
    whole = BODIES[name]
    end = "END OF TERMS AND CONDITIONS"
    texts = [whole] + ([whole[:whole.index(end) + len(end)], whole[:whole.index(end)]] if end in whole else [])
    return texts + [" ".join(t.split()) for t in texts]


#: What a licence is called in a notice, and its SPDX names where they are not its own.
NAMES = {
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License", "Apache License 2.0", "Apache-2.0"],
    "MIT": ["the MIT License", "the MIT License (MIT)", "MIT License", "MIT"],
    "ISC": ["the ISC License", "ISC"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License", "the Modified BSD License", "BSD-3-Clause"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GNU General Public License v2.0", "the GNU GPL v2", "the GPL v2", "GPL-2.0", "GPLv2"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GNU General Public License v3.0", "the GNU GPL v3", "the GPL v3", "GPL-3.0", "GPLv3"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1", "the GNU Lesser General Public License v2.1", "the GNU LGPL v2.1", "the LGPL v2.1", "LGPL-2.1"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "the GNU Lesser General Public License v3.0", "the GNU LGPL v3", "the LGPL v3", "LGPL-3.0"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "the MPL 2.0", "MPL-2.0"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "the Creative Commons CC0 1.0 Universal License"],
}
for _short, _long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"),
                      ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
    for _version, _kind in (("4.0", "International"), ("3.0", "Unported")):
        NAMES[f"CC-{_short}-{_version}"] = [f"{_the}{_name}" for _the in ("", "a ") for _name in (
            f"CC {_short} {_version}", f"CC {_short} {_version} License", f"Creative Commons {_long} {_version} {_kind} License",
            f"Creative Commons {_long} {_version} License", f"Creative Commons {_long} {_version} {_kind} License (CC {_short} {_version})")]
_SAID = ["Licensed under", "Released under", "Distributed under", "Available under"]
_SAID += [f"This {thing} is {said} under" for thing in ("work", "project", "software", "program", "code", "content", "article", "document", "file")
          for said in ("licensed", "released", "distributed", "available")]
_GNU = ("This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2}General Public License as published by"
        " the Free Software Foundation; either version {3} of the License, or (at your option) any later version.")
_NO_WARRANTY = (" This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of"
                " MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {2}General Public License for more details.")
for _name, _kind, _version in (("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3")):
    for _thing in ("program", "library", "software", "file"):
        _said = [x.format(_thing, ":", _kind, _version) for x in (_GNU, _GNU + _NO_WARRANTY)]
        _copy = f" You should have received a copy of the GNU {_kind}General Public License along with this {_thing}."
        KNOWN.setdefault(_name, []).extend([*_said, _said[1] + _copy + " If not, see <https://www.gnu.org/licenses/>.", _said[1] + _copy + " If not, see <http://www.gnu.org/licenses/>."])
for _name, _own in NAMES.items():
    _spdx = [f"{_name}-only", f"{_name}-or-later", f"{_name}+", _name] if "GPL" in _name else [_name]
    KNOWN.setdefault(_name, []).extend([f"{said} {own}." for said in _SAID for own in _own] + [f"SPDX-License-Identifier: {x}" for x in _spdx])
_MIT = KNOWN["MIT"][1].removeprefix("MIT License ")
KNOWN["MIT"] += [title + _MIT for title in ("", "The MIT License ", "The MIT License (MIT) ", "MIT License (MIT) ")]
KNOWN["ISC"] += [title + KNOWN["ISC"][0].replace("and/or", andor) for title in ("", "ISC License ", "The ISC License ", "ISC License (ISC) ") for andor in ("and/or", "and")]
KNOWN["Apache-2.0"] += [KNOWN["Apache-2.0"][1].replace("http:", "https:")]
KNOWN["BSD-2-Clause"] += _bsd(2)
KNOWN["BSD-3-Clause"] += _bsd(3)
for _name in BODIES:
    KNOWN[_name] += _bodies(_name)

# Word beginnings that licence texts spell in two ways, and the one kept.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analys": "analyz", "artefact": "artifact",
    "authoris": "authoriz", "calibre": "caliber", "cancelled": "canceled", "capitalis": "capitaliz",
    "catalogue": "catalog", "categoris": "categoriz", "centre": "center", "emphasis": "emphasiz",
    "favour": "favor", "fulfilment": "fulfillment", "initialis": "initializ", "judgement": "judgment",
    "labelling": "labeling", "labour": "labor", "licence": "license", "maximis": "maximiz", "modelling": "modeling",
    "offence": "offense", "optimis": "optimiz", "organis": "organiz", "programme ": "program ", "realis": "realiz",
    "recognis": "recogniz", "sub license": "sublicense", "utilis": "utiliz", "whilst": "while", "wilful": "willful",
    "non commercial": "noncommercial", "per cent": "percent", "copyright owner": "copyright holder",
}

COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*$"
OTHER = r"[^\p{L}\p{N}]+"
#: Characters of a canonical form by which a block is seen to begin a known text.
START = 16


def canonical(text: Column) -> Column:
    """Canonical form, with one blank before and after."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, COPYRIGHT_LINE, " ")
    out = F.replace(out, F.lit("&"), F.lit(" and "))
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, OTHER, " ")), F.lit(" "))
    for old, new in SPELLINGS.items():
        out = F.replace(out, F.lit(f" {old}"), F.lit(f" {new}"))
    return out


def digest(text: Column) -> Column:
    return F.md5(canonical(text))


def known(spark: SparkSession, texts: dict[str, list[str]] | None = None) -> DataFrame:
    """Digests of known texts: (digest, licence, size and first ``START`` characters of the canonical form); texts that are
    empty in canonical form are left out."""
    rows = spark.createDataFrame([(t, name) for name, own in (texts or KNOWN).items() for t in own], "text string, licence string")
    rows = rows.select(canonical(F.col("text")).alias("text"), "licence").where(F.length(F.trim("text")) > 0)
    return rows.groupBy(F.md5("text").alias("digest")).agg(
        F.min("licence").alias("licence"), F.first(F.length("text")).alias("size"), F.first(F.substring("text", 2, START)).alias("start"))


#: Stands for a line without letters and digits between the forms of others.
_GAP = "\x01 "


def _spelled(form: Column, two_words: bool) -> Column:
    for old, new in SPELLINGS.items():
        if (" " in old.strip()) == two_words:
            form = F.replace(form, F.lit(f" {old}"), F.lit(f" {new}"))
    return form


def _words(text: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.replace(text, F.lit("&"), F.lit(" and ")), OTHER, " ")), F.lit(" "))


def _line_form(line: Column) -> Column:
    """Canonical form of one line: its words and a blank (nothing for a copyright line), or ``_GAP``."""
    low = F.lower(line)

    def form(w: Column) -> Column:
        # few lines can hold a copyright line, so few meet the pattern (which takes some other characters for line ends, too)
        about = w.startswith(" copyright") | w.startswith(" c ") | w.startswith(" all rights")
        for sign in "©\r\x85\u2028\u2029":
            about = about | F.contains(low, F.lit(sign))
        own = F.when(about, _words(F.regexp_replace(low, COPYRIGHT_LINE, " "))).otherwise(w)
        return F.when(F.trim(w) == "", F.lit(_GAP)).otherwise(F.ltrim(_spelled(own, False)))
    return _bound(_words(low), form)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digests(text: Column, sizes: list[int], longest: int, starts: list[str]) -> Column:
    """``digest`` of the whole text, and ``parts``: digests of its lines and of the runs of its blocks (not the whole text)
    that begin as a known text does and have the length of one."""
    def of_lines(forms: Column) -> Column:
        joined = _spelled(F.concat(F.lit(" "), F.array_join(forms, "")), True)
        lines = F.transform(forms, lambda x: _spelled(F.concat(F.lit(" "), x), True))
        lines = F.transform(F.filter(lines, lambda x: F.substring(x, 2, START).isin(starts) & F.length(x).isin(sizes)), F.md5)

        def of_joined(j: Column) -> Column:
            whole = _spelled(F.replace(j, F.lit(_GAP), F.lit("")), True)
            blocks = F.filter(F.transform(F.split(j, "\x01"), lambda x: F.ltrim(x)), lambda x: x != "")
            return F.struct(F.md5(whole).alias("digest"), F.concat(lines, _bound(blocks, of_blocks)).alias("parts"))
        return _bound(joined, of_joined)

    def of_blocks(blocks: Column) -> Column:
        def run(i: Column) -> Column:
            def step(done: Column, block: Column) -> Column:
                more = F.concat(done["text"], block)
                whole = (i == 1) & (done["n"] + 1 == F.size(blocks))
                hits = F.when(~whole & F.length(more).isin(sizes), F.array_append(done["hits"], F.md5(more))).otherwise(done["hits"])
                return F.when(F.length(done["text"]) > longest, done).otherwise(F.struct(more.alias("text"), (done["n"] + 1).alias("n"), hits.alias("hits")))
            none = F.struct(F.lit(" ").alias("text"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("hits"))
            return F.aggregate(F.slice(blocks, i, F.lit(longest)), none, step, lambda done: done["hits"])
        first = F.filter(F.transform(blocks, lambda x, i: F.when(F.substring(x, 1, START).isin(starts), i + 1)), lambda i: i.isNotNull())
        return F.flatten(F.transform(first, run))

    return _bound(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), _line_form), of_lines)


def scan(docs: DataFrame, key: str, text: str, texts: dict[str, list[str]] | None = None) -> DataFrame:
    """One row a document: ``key``, ``digest`` of the whole text, ``licence`` (of the whole text, or null), and
    ``notices``: the licences of whole lines and runs of blocks, as sorted distinct names joined by a comma (empty if none).

    The known digests (as many rows as ``texts`` has) are broadcast.
    """
    spark = docs.sparkSession
    table = known(spark, texts).collect()
    if not table:
        return docs.select(F.col(key), digest(F.col(text)).alias("digest"), F.lit(None).cast("string").alias("licence"), F.lit("").alias("notices"))
    sizes = sorted({r["size"] for r in table})
    # a line or block may be shorter than a start: the known text then goes on in the next
    starts = sorted({r["start"][:i] for r in table for i in range(1, len(r["start"]) + 1) if i == len(r["start"]) or r["start"][i - 1] == " "})
    rows = docs.select(F.col(key).alias("_key"), _digests(F.col(text), sizes, sizes[-1], starts).alias("d"), F.monotonically_increasing_id().alias("_row"))
    rows = written(rows.select("_key", "d.digest", "d.parts", "_row"))
    small = F.broadcast(spark.createDataFrame([(r["digest"], r["licence"]) for r in table], "digest string, licence string"))
    found = rows.select("_row", F.explode("parts").alias("digest")).join(small, "digest").groupBy("_row").agg(
        F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("notices"))
    out = rows.select("_key", "digest", "_row").join(small, "digest", "left").join(found, "_row", "left")
    return out.select(F.col("_key").alias(key), "digest", "licence", F.coalesce("notices", F.lit("")).alias("notices"))


def canonical_sql(text: str) -> str:
    """The canonical form as DuckDB SQL, for the oracle."""
    out = f"lower(coalesce({text}, ''))"
    out = f"regexp_replace({out}, '(?m)^[^\\p{{L}}\\p{{N}}\\n]*(?:copyright|\\(c\\)|©|all rights reserved)[^\\n]*$', ' ', 'g')"
    out = f"replace({out}, '&', ' and ')"
    out = f"' ' || trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
    for old, new in SPELLINGS.items():
        out = f"replace({out}, ' {old}', ' {new}')"
    return out

"""Operator 4: licence scans by canonical digests.

A text is canonicalised line by line: lower case, copyright notices (lines with
a sign, a year or "by") out, punctuation and white space to single blanks, one
spelling for equivalent ones, also across a line's end.  Every run of whole
lines that begins with the first word of a known licence and has its length is
digested, and the digests are hash-joined, as entire texts, to those of known
licences and notices.  So a licence is found as a document, as a few paragraphs
of one, wrapped anew, behind comment signs, or as a notice on a line.

Only texts with one of GATE's words are canonicalised; each known text has one.
Known are the texts below and digests of the full texts that are published for
Apache, GPL, LGPL, GFDL, MPL, CC0, Artistic and BSD (FULL; with and without what
follows the terms).  The table is small and fixed, so the join broadcasts it.

Result: (doc_id, start_line, end_line, license_id), lines from 1; runs within
longer known ones (a licence with and without its title) are reported too.

Defined cases: null or empty texts, and lines without letters or digits, match
nothing; rows without an id are scanned, with a null id; each row counts,
repeated or not; texts of any length are read whole; of licences with one digest
the first name counts; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: On lower-case text.
NOTICE = r"^[^a-z0-9(©]*(?:(?:copyright|\(c\)|©)[^a-z0-9(©<\[]*(?:\(c\)|©|by |\[yyyy\]|<year>|(?:[^\n]*[^0-9])?(?:19|20)[0-9][0-9](?:[^0-9]|$))[^\n]*|all rights reserved[^a-z0-9]*)$"
#: On canonical lines joined by '|': what equals what follows.  A word that goes on in the next line is drawn up to this one; no '|' gets lost.
SPELLINGS = [
    (r"\blicence", r"license"), (r"\bsub\|(licens[a-z]*) ?", r"sub\1|"), (r"\bsub licens", r"sublicens"), (r"\bnon\|(commercial[a-z]*|infring[a-z]*) ?", r"non\1|"), (r"\bnon (commercial|infring)", r"non\1"), (r"\bper\|cent\b ?", r"percent|"), (r"\bper cent\b", r"percent"), (r"\backnowledgement", r"acknowledgment"), (r"\borganis", r"organiz"),
    (r"\bfavour", r"favor"), (r"\bjudgement", r"judgment"), (r"\bcopyright([ |])owner", r"copyright\1holder"), (r"\bhttp\b", r"https"), (r"\bwilful", r"willful"), (r"\bfulfilment", r"fulfillment"), (r"\bwhilst\b", r"while"),
]
GATE = ["licen", "permission", "redistribution", "released", "distributed"]

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'

_NAMES = [
    ("MIT", "MIT License", ["MIT"]), ("Apache-2.0", "Apache License, Version 2.0", ["Apache License 2.0", "Apache-2.0"]), ("GPL-3.0", "GNU General Public License, version 3", ["GPL v3", "GPLv3", "GPL-3.0"]), ("GPL-2.0", "GNU General Public License, version 2", ["GPL v2", "GPLv2", "GPL-2.0"]),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3", ["LGPL-3.0"]), ("AGPL-3.0", "GNU Affero General Public License, version 3", ["AGPL-3.0"]), ("MPL-2.0", "Mozilla Public License, version 2.0", ["MPL-2.0"]), ("BSD-3-Clause", "BSD 3-Clause License", ["BSD-3-Clause"]), ("BSD-2-Clause", "BSD 2-Clause License", ["BSD-2-Clause"]),
    *((f"CC-{x}-4.0", f"CC {x} 4.0", [f"Creative Commons {x} 4.0", f"CC-{x}-4.0"]) for x in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")), ("CC0-1.0", "CC0 1.0", ["CC0-1.0"]), ("ISC", "ISC License", ["ISC"]), ("Unlicense", "Unlicense", []),
]
_LEADS = ["Licensed under {}.", "Licensed under the {}.", "Released under {}.", "Released under the {}.", "This work is licensed under {}.", "This work is licensed under the {}.", "Distributed under the {}.", "License: {}", "SPDX-License-Identifier: {}"]


#: (license_id, first word, words, digest) of published full texts.
FULL = [
    ("Apache-2.0", "apache", 1601, "4a6318c7afd8feed8c4463ea5ae0f2f609d433928a8b17f31104c8e7743de2c5"),
    ("Apache-2.0", "apache", 1430, "b93faad605f4e5d56d92cb01789c993887913c893e441b2305b4f880a9cead93"),
    ("Artistic-1.0-Perl", "the", 983, "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("BSD-3-Clause-UC", "redistribution", 214, "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "creative", 1087, "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", "gnu", 3315, "1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f"),
    ("GFDL-1.3", "gnu", 3732, "7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7"),
    ("GPL-1.0", "gnu", 2067, "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0", "gnu", 1641, "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-2.0", "gnu", 2975, "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0", "gnu", 2504, "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-3.0", "gnu", 5684, "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("GPL-3.0", "gnu", 5241, "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.0", "gnu", 4200, "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "gnu", 3865, "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.1", "gnu", 4401, "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "gnu", 4065, "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-3.0", "gnu", 1231, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "mozilla", 3785, "ca11016cfa35488a51cd96aafc50e735c7f8da97b6bbad8a2ae1c5c4f641fc6d"),
    ("MPL-2.0", "mozilla", 2425, "263edff82d69a42f3742042ce624238051bd69fa2d4f817c192f63621765b324"),
]


def known() -> list[tuple[str, str]]:
    """(license_id, text) of the licences and notices that are looked up by their text."""
    full = [
        ("MIT", f"MIT License\n{_GRANT}\n{_NOTICE}\n{_AS_IS}"), ("MIT", f"{_GRANT}\n{_NOTICE}\n{_AS_IS}"), ("ISC", f"ISC License\n{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}"), ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}"),
        ("0BSD", f"{_ISC}.\n{_ISC_END}"), ("BSD-2-Clause", f"{_BSD}\n{_BSD1}\n{_BSD2}\n{_BSD_END}"), ("BSD-3-Clause", f"{_BSD}\n{_BSD1}\n{_BSD2}\n{_BSD3}\n{_BSD_END}"), ("Apache-2.0", _APACHE),
    ]
    return list(dict.fromkeys(full + [(i, lead.format(n)) for i, name, more in _NAMES for n in (name, *more) for lead in _LEADS]))


_PATTERNS = [(re.compile(a, re.A), b) for a, b in SPELLINGS]
_SKIP, _WORDS = re.compile(NOTICE), re.compile("[a-z0-9]+")


def lines(text: str) -> list[tuple[int, list[str]]]:
    """(line number, words) of the canonical lines that have words."""
    kept = []
    for i, line in enumerate(text.lower().split("\n"), 1):
        words = [] if _SKIP.match(line) else _WORDS.findall(line)
        if words:
            kept.append((i, " ".join(words)))
    joined = "|".join(x for _, x in kept)
    for pattern, to in _PATTERNS:
        joined = pattern.sub(to, joined)
    return [(i, x.split(" ")) for (i, _), x in zip(kept, joined.split("|")) if x]


def canonical(text: str) -> str:
    """The canonical form: words with single blanks."""
    return " ".join(w for _, ws in lines(text) for w in ws)


def digest(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode()).hexdigest()


@lru_cache(maxsize=1)
def table() -> list[tuple[str, str, int, str]]:
    """(license_id, first word, words, digest) of everything known."""
    out = {}
    for i, text in known():
        w = canonical(text).split(" ")
        out.setdefault(digest(w), (i, w[0], len(w), digest(w)))
    for row in FULL:
        out.setdefault(row[3], row)
    return list(out.values())


def _candidates(text: str, sizes: dict[str, list[int]]) -> Iterator[tuple[int, int, str]]:
    """(first line, last line, digest) of the runs of whole lines with a known first word and length."""
    found = lines(text)
    words = [w for _, ws in found for w in ws]
    at, ends = 0, {}
    for i, ws in found:
        at += len(ws)
        ends[at] = i
    at = 0
    for i, ws in found:
        for n in sizes.get(ws[0], ()):
            if at + n in ends:
                yield i, ends[at + n], digest(words[at : at + n])
        at += len(ws)


def scan(docs: DataFrame) -> DataFrame:
    """Every run of lines of every text whose canonical digest is a known licence's (see the module's text)."""
    names = docs.sparkSession.createDataFrame([(i, d) for i, _, _, d in table()], "license_id string, digest string")
    sizes: dict[str, list[int]] = {}
    for _, first, n, _ in table():
        sizes[first] = sorted({*sizes.get(first, []), n})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *c) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for c in _candidates(t, sizes)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.string()))], ["doc_id", "start_line", "end_line", "digest"])

    lower = F.lower(F.col("text").cast("string"))
    gate = reduce(lambda a, b: a | b, (F.contains(lower, F.lit(w)) for w in GATE))
    wanted = docs.filter(gate).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    runs = wanted.mapInArrow(run, "doc_id long, start_line int, end_line int, digest string")
    return runs.join(F.broadcast(names), "digest").select("doc_id", "start_line", "end_line", "license_id")


def oracle() -> str:
    values = ", ".join(f"('{i}', {n}, '{d}')" for i, _, n, d in table())
    gate = " OR ".join(f"contains(lower(text), '{w}')" for w in GATE)
    joined = "array_to_string(list_transform(k, lambda x: x.w), '|')"
    for a, b in SPELLINGS:
        joined = f"regexp_replace({joined}, '{a}', '{b}', 'g')"
    return rf"""
WITH known(license_id, n, digest) AS (VALUES {values}),
d AS (SELECT doc_id, row_number() OVER () AS r, string_split(lower(text), chr(10)) AS ls FROM documents WHERE {gate}),
l AS (SELECT doc_id, r, list_filter(list_transform(ls, lambda x, i: {{'i': i, 'w': CASE WHEN regexp_matches(x, '{NOTICE}') THEN '' ELSE trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g')) END}}), lambda x: x.w <> '') AS k FROM d),
c AS (SELECT doc_id, r, list_filter(list_transform(string_split({joined}, '|'), lambda x, j: {{'i': k[j].i, 'w': x}}), lambda x: x.w <> '') AS c FROM l WHERE len(k) > 0),
m AS (SELECT doc_id, r, list_transform(c, lambda x: x.i) AS i, list_transform(c, lambda x: x.w) AS w, list_transform(c, lambda x: len(string_split(x.w, ' '))) AS n FROM c),
s AS (SELECT doc_id, r, i, w, n, unnest(range(1, len(w) + 1)) AS a FROM m),
e AS (SELECT doc_id, r, i, w, n, a, unnest(range(a, len(w) + 1)) AS b FROM s),
f AS (SELECT doc_id, i[a] AS start_line, i[b] AS end_line, list_sum(n[a:b]) AS n, array_to_string(w[a:b], ' ') AS t FROM e WHERE list_sum(n[a:b]) <= (SELECT max(n) FROM known))
SELECT doc_id, start_line::INT AS start_line, end_line::INT AS end_line, license_id FROM f JOIN known ON f.n = known.n AND sha256(f.t) = known.digest
"""

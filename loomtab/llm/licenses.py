"""License scans by canonical digest.

A text's canonical form has its case, quotes, dashes, punctuation, copyright
lines and white space normalised and equivalent spellings made one; its SHA-256
is looked up among the digests of known licence texts, by a hash join over
entire texts, which may stand below one of their known titles.  One-line
notices that refer to a licence are found the same way among a document's
lines, against a short fixed list.

Defined cases: a null text counts as empty; a text with nothing left after
normalising has the digest of the empty text and no licence; texts are read
whole; of several licences with one canonical form the first name is given;
repeated rows are all returned; further columns are left aside.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtab.llm.common import sized

# Public licence texts and notices, in their published wording.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_3_CLAUSE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
TEXTS = {
    "0BSD": ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", ""),
    "BSD-2-Clause": BSD_2,
    "BSD-3-Clause": BSD_2.replace("THIS SOFTWARE IS PROVIDED", BSD_3_CLAUSE + "THIS SOFTWARE IS PROVIDED", 1),
    "ISC": ISC,
    "MIT": MIT,
    "MIT-0": MIT.replace(", subject to the following conditions:", ".").replace("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n", ""),
}
#: Titles that publishers put above a text.
TITLES = {
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License"],
    "ISC": ["ISC License", "The ISC License"],
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "MIT-0": ["MIT No Attribution"],
}
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0-only": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
}
#: Words that are spelled in several ways, and the spelling they are given.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "authorisation": "authorization",
    "authorised": "authorized",
    "favour": "favor",
    "fulfil": "fulfill",
    "labelled": "labeled",
    "licence": "license",
    "licenced": "licensed",
    "licences": "licenses",
    "merchantibility": "merchantability",
    "non infringement": "noninfringement",
    "organisation": "organization",
    "sub license": "sublicense",
    "sub licence": "sublicense",
    "sublicence": "sublicense",
    "whilst": "while",
    "wilful": "willful",
}

_MARK = r"(copyright\s*(\(c\)|©|[0-9]{4})|copyright[ \t][^\n]*(19|20)[0-9]{2}|(\(c\)|©)\s*[0-9]{4}|all rights reserved)"
_COPYRIGHT_LINE = rf"(?m)^[^\p{{L}}\n(©]{{0,8}}{_MARK}[^\n]*$"
_NOT_WORD = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _COPYRIGHT_LINE, " ")
    out = F.trim(F.regexp_replace(out, _NOT_WORD, " "))
    for form, one in SPELLINGS.items():
        out = F.regexp_replace(out, rf"\b{form}\b", one)
    return out


def _canonical(text: str) -> str:
    """The same in Python, for the known texts, which hold none of the signs that the two could see differently."""
    out = re.sub(rf"(?m)^[^a-z\n(©]{{0,8}}{_MARK}[^\n]*$", " ", text.lower())
    out = re.sub(r"[^a-z0-9]+", " ", out).strip()
    for form, one in SPELLINGS.items():
        out = re.sub(rf"\b{form}\b", one, out)
    return out


def digests(texts: dict[str, str]) -> dict[str, str]:
    """Digest to name."""
    return {hashlib.sha256(_canonical(t).encode()).hexdigest(): name for name, t in sorted(texts.items(), reverse=True)}


def titled(texts: dict[str, str], titles: dict[str, list[str]]) -> dict[str, str]:
    """Digest to name, of every text by itself and below each of its titles."""
    out = digests(texts)
    for name in sorted(texts, reverse=True):
        for title in titles.get(name, []):
            out |= digests({name: f"{title}\n\n{texts[name]}"})
    return out


def scan(documents: DataFrame, known: DataFrame | None = None, notices: dict[str, str] = NOTICES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, digest, license, notices) for every row: the licence that the whole text is, and those that whole lines refer to, joined by commas.  ``known`` has (digest, license)."""
    spark = documents.sparkSession
    if known is None:
        known = spark.createDataFrame(sorted(titled(TEXTS, TITLES).items()), "digest string, license string")
    known = known.groupBy("digest").agg(F.min("license").alias("license"))
    names = digests(notices)
    # a line's words are longer than a notice's canonical form by no more than spellings shorten them
    longest = max((len(_canonical(t)) for t in notices.values()), default=0) * max(len(form) / len(one) for form, one in SPELLINGS.items())
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.length(F.trim(F.regexp_replace(F.lower(x), _NOT_WORD, " "))) <= longest)
    found = F.filter(F.transform(lines, lambda x: F.sha2(canonical(x), 256)), lambda d: d.isin(*names))
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    cited = F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda d: F.try_element_at(table, d)))), ",")
    marked = documents.select(F.col(key), F.sha2(canonical(F.col(text)), 256).alias("digest"), cited.alias("notices"))
    return marked.join(sized(known), "digest", "left").select(key, "digest", "license", "notices")


def oracle() -> str:
    """DuckDB SQL for a scan with the built-in texts and notices."""

    def canonical(x: str) -> str:
        out = rf"regexp_replace(lower(coalesce({x}, '')), '{_COPYRIGHT_LINE}', ' ', 'g')"
        out = rf"trim(regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
        for form, one in SPELLINGS.items():
            out = rf"regexp_replace({out}, '\b{form}\b', '{one}', 'g')"
        return out

    rows = lambda known: ", ".join(f"('{d}', '{n}')" for d, n in sorted(known.items()))
    return f"""
WITH known(digest, license) AS (VALUES {rows(titled(TEXTS, TITLES))}),
noted(digest, license) AS (VALUES {rows(digests(NOTICES))}),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
l AS (SELECT r, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM d),
n AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM (SELECT r, sha256({canonical("line")}) AS digest FROM l) JOIN noted USING (digest) GROUP BY r),
w AS (SELECT r, doc_id, sha256({canonical("text")}) AS digest FROM d)
SELECT doc_id, digest, license, coalesce(notices, '') AS notices FROM w LEFT JOIN known USING (digest) LEFT JOIN n USING (r)
"""

"""Licence scans by canonical digest lookup.

A text is brought to a canonical form (lower case, no punctuation, no copyright lines, one spelling
of equivalent words, single spaces, without a title before it) and its digest is hash-joined with the
digests of known licence texts in the same form. Short licences are known by their texts, long ones
by their digests. Both the entire text and each of its lines are looked up, so a document that
is a licence and a document that carries a licence notice on a line of its own are both found; a
text that merely mentions a licence is not.

Only DataFrame functions are used. The known texts are a fixed table of this module (or the
caller's), joined as an ordinary equi-join.

Cases. Null and empty texts, and texts with nothing but copyright lines, have the digest of the
empty text, which matches nothing. A very long text has a digest like any other. Repeated rows come
back once each. A null doc_id keeps its row.
An empty known table matches nothing. Further columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Short licence texts and notices by SPDX identifier.
NOTICES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    (
        "ISC",
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    (
        "0BSD",
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    (
        "BSD-2-Clause",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    (
        "BSD-3-Clause",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org/>',
    ),
    (
        "BSL-1.0",
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
]
# List numbers may be bullets, which are punctuation, instead.
NOTICES += [(name, bare) for name, body in NOTICES if (bare := re.sub(r"(?<=[.:] )\d\. ", "", body)) != body]

# Digests of long licence texts in canonical form, by identifier.
DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "93651fc3b3c9c21033cf07999bdb593e0138192678d4743ddf7ee126fefab052"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2-only", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3-only", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GPL-1.0-only", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0-only", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0-only", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("LGPL-2.0-only", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1-only", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
]

# Titles that may stand before a licence text, in canonical form.
TITLES = ["the mit license mit", "the mit license", "mit license", "isc license", "zero clause bsd license", "bsd 2 clause license", "bsd 3 clause license", "zlib license", "the unlicense", "boost software license version 1 0 august 17th 2003"]

# Spellings that the matching guidelines treat as equal, after lower-casing.
SPELLINGS: list[tuple[str, str]] = [
    ("sub-licence", "sublicense"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("non-infringement", "noninfringement"),
    ("licence", "license"),
    ("organisation", "organization"),
    ("merchantibility", "merchantability"),
    ("whilst", "while"),
    ("wilful", "willful"),
]

# A line of its own: "copyright" with a sign or a year, or the sign alone; not a wrapped "copyright notice".
COPYRIGHT = r"^[ \t\r\f]*(?:copyright[ \t\r\f]*(?:\(c\)|©|[ \t\r\f]\d{4})|\(c\)[ \t\r\f]|©)[^\n]*$"
#: What stands before a text and is no part of it: a title, and what is left of copyright lines.
BEFORE = "^(?:(?:" + "|".join(TITLES) + ") )?(?:all rights reserved )?"


def canonical_lines(text: Column) -> Column:
    """The text in canonical form, line breaks kept."""
    out = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "(?imd)" + COPYRIGHT, ""))
    for said, meant in SPELLINGS:
        out = F.replace(out, F.lit(said), F.lit(meant))
    return F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")


def canonical(lines: Column) -> Column:
    """Canonical lines as one canonical text."""
    return F.regexp_replace(F.btrim(F.regexp_replace(lines, r"[ \n]+", " ")), BEFORE, "")


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def known_table(spark: SparkSession, notices: list[tuple[str, str]] | None = None, digests: list[tuple[str, str]] | None = None) -> DataFrame:
    """``(licence, digest)`` of the known texts, one row per digest."""
    rows = spark.createDataFrame(NOTICES if notices is None else notices, "licence string, body string")
    rows = rows.select(digest(canonical(canonical_lines(F.col("body")))).alias("digest"), "licence")
    if digests is None and notices is None:
        digests = DIGESTS
    if digests:
        rows = rows.unionByName(spark.createDataFrame(digests, "licence string, digest string"))
    return rows.groupBy("digest").agg(F.min("licence").alias("licence"))


#: Known digests that the expression for lines may hold.
MOST_IN_EXPRESSION = 1000


def licence_scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``(doc_id, text_digest, licence, line_licences)`` for every row of ``docs(doc_id, text)``.

    ``licence`` is that of the entire text, or null; ``line_licences`` the sorted distinct licences
    of its lines. Up to ``MOST_IN_EXPRESSION`` rows of ``known`` become part of the expression that looks lines
    up, and only identifiers and digests of documents are joined. A larger table meets the lines' digests in
    a join as well: what it hits is grouped by the digest of the whole text, so equal texts are one.
    """
    few = known.select("digest", "licence").limit(MOST_IN_EXPRESSION + 1).collect()
    lines = canonical_lines(F.col("text"))
    base = docs.select("doc_id", lines.alias("lines"))
    whole = known.select(F.col("digest").alias("text_digest"), "licence")
    if len(few) > MOST_IN_EXPRESSION:
        return _joined_scan(base, known, whole)
    by_digest = {r["digest"]: r["licence"] for r in few}
    if by_digest:
        names = F.create_map(*(F.lit(x) for pair in sorted(by_digest.items()) for x in pair))
        hashed = F.transform(F.split("lines", "\n"), lambda x: digest(F.btrim(x)))
        hits = F.filter(hashed, lambda h: h.isin(*by_digest))
        of_lines = F.array_sort(F.array_distinct(F.transform(hits, lambda h: F.element_at(names, h))))
    else:
        of_lines = F.array().cast("array<string>")
    scanned = base.select("doc_id", digest(canonical(F.col("lines"))).alias("text_digest"), of_lines.alias("line_licences"))
    return scanned.join(whole, "text_digest", "left").select("doc_id", "text_digest", "licence", "line_licences")


def _joined_scan(base: DataFrame, known: DataFrame, whole: DataFrame) -> DataFrame:
    """The scan of ``base(doc_id, lines)`` with lines and texts alike joined by digest."""
    # The canonical text drops what parts lines; the digest of its lines tells texts of other lines apart.
    read = base.select("doc_id", digest(canonical(F.col("lines"))).alias("text_digest"), digest(F.col("lines")).alias("lines_digest"), F.array_distinct(F.transform(F.split("lines", "\n"), lambda x: digest(F.btrim(x)))).alias("hashes"))
    hits = read.select("lines_digest", F.explode("hashes").alias("digest")).join(known.select("digest", F.col("licence").alias("found")), "digest")
    of_lines = hits.groupBy("lines_digest").agg(F.array_sort(F.collect_set("found")).alias("line_licences"))
    scanned = read.select("doc_id", "text_digest", "lines_digest").join(of_lines, "lines_digest", "left").join(whole, "text_digest", "left")
    return scanned.select("doc_id", "text_digest", "licence", F.coalesce("line_licences", F.array().cast("array<string>")).alias("line_licences"))

"""Whole-text licence scan by canonical digest, in DataFrame functions only.

A text's canonical form: without copyright and all-rights-reserved lines, in lower case, without the marks of list items
(1. or (a)), everything but letters and digits turned into single spaces, equivalent spellings made one. Its SHA-256 is
hash-joined to the digests of known licences, so the work is one pass over the texts however many licences are known, and a
licence text that half of the documents repeat costs no more than any other: the join's small side decides its strategy,
and a skewed key of the large side can be split.

A copyright line begins with the word or sign and has a year, a sign, all rights reserved or a name; licence prose that a
line break makes begin with the word stays. Known licences also count after their usual title lines.

Every row of docs gets a row, repeated rows too; null and empty texts have the digest of the empty form and no licence. Very
long texts are read whole. Known licences with equal canonical forms count once, under the name that sorts first. Columns
other than the id and the text are not read, so others may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.common import text_of

# Spellings to be treated as equal (first form -> second form).
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authoris", "authoriz"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("copyright holder", "copyright owner"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("initialis", "initializ"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("licence", "license"),
    ("merchantibility", "merchantability"),
    ("non commercial", "noncommercial"),
    ("organis", "organiz"),
    ("per cent", "percent"),
    ("programme", "program"),
    ("recognis", "recogniz"),
    ("sub license", "sublicense"),
    ("utilis", "utiliz"),
    ("whilst", "while"),
    ("wilful", "willful"),
)
# These patterns mean the same in Java and in SQL engines without look-around.
PROSE = r"Copyright (Holder|Notice|Owner|Law|Licen|Act|Statement|Treat|Interest|Right)"
NOTICE = r"(^|\n)[^\p{L}\p{N}\n]*(?:(?i:copyright[^\n]*(?:\(c\)|©|[12][0-9]{3}|all rights reserved)|(?:\(c\)|©)[^\n]*[12][0-9]{3}|all rights reserved)|Copyright[ \t:]+(?:by[ \t]+)?\p{Lu}\p{Ll})[^\n]*"
ITEM = r"(^|[ \t\n\r\f])\(?(?:[0-9]{1,2}|[a-z])[.)][ \t\n\r\f]"
NOT_WORD = r"[^\p{L}\p{N}]+"

# Public licence texts, without their copyright lines.
_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
KNOWN = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _WARRANTY,
    "BSD-2-Clause": _BSD + "\n" + _DISCLAIMER,
    "BSD-3-Clause": _BSD + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _DISCLAIMER,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _WARRANTY,
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}

KNOWN |= {
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
}
# SHA-256 of the canonical forms of longer public licence texts, as their stewards publish them.
DIGESTS = {
    "Apache-2.0": "df6c8263f9c06900f220c17c98128173babe2eab4383b10739124ba0c2219022",
    "Artistic-1.0": "529002857bb70d601700d3446387c8272f3e722d4f046b868501698ed91ca35b",
    "CC0-1.0": "38ef173883793b023a74895ce0af4bbdeb6bb0bc904463871c507b03695c9c81",
    "GFDL-1.2": "4754bcf0bde48d15f27d93a7b3aa3086f3c7d7089a0de9add42000d4c83cb4e0",
    "GFDL-1.3": "8edfdeda6b950040d28cfc9e707424913b71b2d55efcbfee1ac0a21943a9cd1f",
    "GPL-1.0": "cedcfe76bf961ee9033ae11eacdb6acef84abde5f236f350bde8b2e006e99732",
    "GPL-2.0": "801f098cc8257d272b15f8278794c04ee1ee99710438336011e4892b66c1ae8f",
    "GPL-3.0": "c1113bf6e5e0cf85bf46ec9d5071d5d918f5e5c7279d10dae6830608a858ef3b",
    "LGPL-2.0": "d7cfa68bc5292c1568529fdfad63272872bd20149e00de4c473809ccae2e35f5",
    "LGPL-2.1": "a4558cf480830606cb2a0fa092d5c13460af8e90df197d8d7977384fd5c119c1",
    "LGPL-3.0": "6a1e21cb1f0adda77c68071a8eeadb804a92ffdcaa150c17f976711652333fa0",
    "MPL-1.1": "e15720e0b148bbd07286a99c001a95471fae41dd3a1c642aa01df4893417b787",
    "MPL-2.0": "16bf53094aa71cdf0e28cf166f759a4fde1cc1e3cae6c443ef8e6bf4157561f4",
}
TITLES = {
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "0BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License'),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "Unlicense": ("The Unlicense", "Unlicense"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng license"),
}


def canonical(text: Column) -> Column:
    form = F.regexp_replace(text, PROSE, "copyright $1")
    form = F.lower(F.regexp_replace(form, NOTICE, "$1"))
    form = F.trim(F.regexp_replace(F.regexp_replace(form, ITEM, " "), NOT_WORD, " "))
    for one, other in SPELLINGS:
        form = F.replace(form, F.lit(one), F.lit(other))
    return form


def known_texts() -> list[tuple[str, str]]:
    """(license, text) of the built-in licences, alone and after each of their titles."""
    return sorted(KNOWN.items()) + [(name, f"{title}\n{KNOWN[name]}") for name, titles in TITLES.items() for title in titles]


def known_licenses(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(license, digest) of licence texts by name; by default of those above and of DIGESTS."""
    rows = spark.createDataFrame(sorted(texts.items()) if texts else known_texts(), "license string, text string")
    rows = rows.select("license", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    if not texts:
        rows = rows.union(spark.createDataFrame(sorted(DIGESTS.items()), "license string, digest string"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, licenses: DataFrame | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Returns doc_id, n_canonical (length of the canonical form), digest and license (null if none)."""
    licenses = known_licenses(docs.sparkSession) if licenses is None else licenses
    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), canonical(text_of(text_column)).alias("form"))
    own = own.select("doc_id", F.length("form").cast("long").alias("n_canonical"), F.sha2("form", 256).alias("digest"))
    return own.join(licenses.select("digest", "license"), "digest", "left").select("doc_id", "n_canonical", "digest", "license")

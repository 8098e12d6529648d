"""License scans by canonical digests, with DataFrame functions only.

A text's canonical form has lower case, equivalent spellings made equal, no lines that are copyright statements, and single
spaces for everything but letters and digits. The digest of an entire text is joined with the digests of known
licence texts, with and without their titles; the table of known texts is fixed (some eighty rows), so its side is broadcast, or the user's. Besides, entire lines
are held against the known one-line notices, row by row and without a shuffle.

Defined cases: a null text, and one without letters or digits, has the digest of the empty text
and no licence; repeated rows get equal results; of known texts with one canonical form the least name counts; very long texts are digested
whole; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR '
    "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT '
    "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
    "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above "
    "copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in "
    "the documentation and/or other materials provided with the distribution."
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A '
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED "
    "TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Known licence texts.
TEXTS = {
    "MIT": "MIT License\n\nCopyright (c) <year> <holder>\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or '
    "sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this "
    "permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _WARRANTY,
    "ISC": "ISC License\n\nCopyright (c) <year> <holder>\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_WARRANTY,
    "0BSD": "Copyright (c) <year> <holder>\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_WARRANTY,
    "MIT-0": "MIT No Attribution\n\nCopyright (c) <year> <holder>\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or '
    "sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\n\n" + _WARRANTY,
    "BSD-2-Clause": "BSD 2-Clause License\n\nCopyright (c) <year> <holder>\n\n" + _BSD + "\n\n" + _BSD_WARRANTY,
    "BSD-3-Clause": "BSD 3-Clause License\n\nCopyright (c) <year> <holder>\n\n" + _BSD + "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission.\n\n" + _BSD_WARRANTY,
    "Zlib": "zlib License\n\nCopyright (c) <year> <holder>\n\nThis software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
    "from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
    "following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment "
    "in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
    "3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
    'covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the '
    "Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following "
    "disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable "
    'object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
    "compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest "
    "in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
    "relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
    "OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <http://unlicense.org/>",
}
#: Known one-line notices.
NOTICES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "BSD-3-Clause": ("SPDX-License-Identifier: BSD-3-Clause",),
}
#: Spellings that count as equal, on lower-cased text.
SPELLINGS = (
    ("licence", "license"), ("licencing", "licensing"), ("sub-license", "sublicense"), ("organisation", "organization"), ("authorise", "authorize"), ("favour", "favor"),
    ("non-infringement", "noninfringement"), ("https:", "http:"), ("merchantibility", "merchantability"), ("&", " and "),
)
#: SHA-256 of the canonical forms of long licence texts, as the usual copies have them.
DIGESTS = (
    ("Apache-2.0", "75acde0fb516a7ba4597dfc23680cf78281f7fae7f3b74a78e06ef83c1c375c6"),
    ("Artistic-1.0-Perl", "c9bcba9e70d36ab628a0944e717aa88f7b65f5755a9f3061c584801892429806"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0", "9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "9085ee283b8c84517846c5acafee37391c28bb825b7ecec4aaa90768f2f283b0"),
    ("LGPL-2.0", "5b313222545879140519fc4f8ac7558088e9529f29bda08d2b75946987652f50"),
    ("LGPL-2.1", "6ce9e9dc5005db9536b303ace5104e7d79eb77fa76f5ca2e335ea6401497ea1e"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
)
SYMBOLS = r"[^\p{L}\p{N}\n]+"
#: A line is a copyright statement if it begins so, and not with words of a wrapped licence text unless what follows says so.
STATEMENT, WRAPPED, CERTAIN = (
    r"^ *(?:copyright|c \d|all rights reserved)",
    r"^ *copyright (?:notices?|holders?|owners?|laws?|licenses?|statements?|interests?|and|or|in|to|on|by|of|is|are|the software)\b",
    r"^ *copyright(?: *$| c\b| \d| y{2,4}\b| year\b)",
)
#: Titles that a known text may have; the empty one is a text without a title.
TITLES = {
    "MIT": ("", "MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("", "ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("", "Zero-Clause BSD", "BSD Zero Clause License", "Zero Clause BSD License"),
    "MIT-0": ("", "MIT No Attribution", "MIT No Attribution License", "MIT-0"),
    "BSD-2-Clause": ("", "BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "BSD License"),
    "BSD-3-Clause": ("", "BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "BSD License", "New BSD License"),
    "Zlib": ("", "zlib License", "The zlib License", "zlib/libpng License"),
    "BSL-1.0": ("", "Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License 1.0"),
    "Unlicense": ("", "The Unlicense", "Unlicense"),
}


def lines_of(text: Column) -> Column:
    """Canonical lines: as the canonical text, but with line ends kept."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.regexp_replace(out, SYMBOLS, " ")
    kept = F.filter(F.split(out, "\n"), lambda x: ~(x.rlike(STATEMENT) & (~x.rlike(WRAPPED) | x.rlike(CERTAIN))))
    return F.when(out.rlike(f"(?m){STATEMENT}"), F.array_join(kept, "\n")).otherwise(out)  # most texts have no such line


def canonical(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def whole_texts() -> list[tuple[str, str]]:
    """(license, text) of the known texts under each of their titles, and of the known notices."""
    bodies = {k: t.removeprefix(TITLES[k][1]).lstrip("\n") for k, t in TEXTS.items()}
    return [(k, f"{title}\n\n{t}") for k, t in bodies.items() for title in TITLES[k]] + [(k, t) for k, ts in NOTICES.items() for t in ts]


def known(spark: SparkSession, texts: DataFrame | None = None) -> DataFrame:
    """(digest, license) of the known texts, notices and digests, or of a table (license, text) of one's own."""
    if texts is None:
        own = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({_sql(k)}, {_sql(t)})" for k, t in whole_texts()) + " AS t(license, text)")
        fixed = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({_sql(d)}, {_sql(k)})" for k, d in DIGESTS) + " AS t(digest, license)")
        return known(spark, own).unionByName(fixed)
    digests = texts.select(F.sha2(canonical(lines_of(F.col("text"))), 256).alias("digest"), "license")
    return digests.groupBy("digest").agg(F.min("license").alias("license"))


def _sql(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", texts: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, license (of the entire text, or null) and line_licenses (of entire lines, sorted) for every row.

    ``texts`` (license, text) may take the place of the known texts; it is joined by hash, and broadcast only where Spark finds it small.
    """
    notices = F.create_map(*[x for name, lines in NOTICES.items() for line in lines for x in (canonical(lines_of(F.lit(line))), F.lit(name))])
    lines = F.transform(F.split("lines", "\n"), lambda x: F.trim(x))
    rows = docs.select(F.col(doc_id).alias("doc_id"), lines_of(F.col(text).cast("string")).alias("lines"))
    found = F.filter(F.transform(lines, lambda x: F.try_element_at(notices, x)), lambda x: x.isNotNull())
    rows = rows.select("doc_id", F.sha2(canonical(F.col("lines")), 256).alias("digest"), F.concat_ws(",", F.array_sort(F.array_distinct(found))).alias("line_licenses"))
    table = known(docs.sparkSession, texts)
    return rows.join(F.broadcast(table) if texts is None else table, "digest", "left").select("doc_id", "digest", "license", "line_licenses")

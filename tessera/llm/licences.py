"""Licence scans by canonical digest lookup, in built-in functions only.

A text is brought to a canonical form: lower case, without copyright lines (with or without a year) and without a title
line, equivalent spellings unified, punctuation and white space reduced to single spaces. The SHA-256 of the canonical form of a
*whole* text is hash-joined to the digests of known licence texts; the digests of its single lines
are likewise joined to those of known one-line notices.

The table of known texts below is fixed by this module, so broadcasting it is safe at any corpus size.

Defined cases: null texts and texts that are empty after canonical form have a null digest and match
nothing; long texts are read whole; repeated rows match alike; a digest of two licences goes to the first by name (a
tie that the known texts don't have); extra columns are ignored, also those named like a result; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Published licence texts and customary notices, by SPDX identifier.
_WARRANTY_MIT = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_WARRANTY_BSD = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_ISC = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
TEXTS = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _WARRANTY_MIT,
    "BSD-2-Clause": f"{_BSD_2}\n\n{_WARRANTY_BSD}",
    "BSD-3-Clause": f"{_BSD_2}{_BSD_3}\n\n{_WARRANTY_BSD}",
    "ISC": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC}",
    "0BSD": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n{_ISC}",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": 'This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>',
}
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License v3.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."],
    "CC0-1.0": ["Released under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
}
# SHA-256 of the canonical form of longer published texts; where the terms are followed by advice on how to apply them, also of the terms alone.
DIGESTS = {
    "Apache-2.0": ["d5868b9943dfef2447fe1f065be5442da8097be24f98549117680301e6451781", "2779a7865fb7bbed98a5b5a8d36e0246dbefbea93973253511fe37d00ba8d2e7"],
    "Artistic-1.0": ["4eaaa9e33aeef0af0ff83ab5edac0ad421a1da9cc861c564630460107b4b772c"],
    "CC0-1.0": ["bea9118c5076751be6225d3c509820b983aa4933c4909c06ce16a7fb9f13049b"],
    "GFDL-1.2": ["1a4fa8b77bf455c1a523ee0e87d7133739762ac97293633eb03ad4793b9663df"],
    "GFDL-1.3": ["a77bf3f7d4a75bf2c323b6482996fc8bbd78817a5c75a1589d452017545379ed"],
    "GPL-1.0": ["9541667494b86e9cc49abe4f6a278b0f64992b360f957fae092d80fef0f0925c", "66fbd3265512f6757062cade3af6511c552c56ee8ef910ce3c7492d406896514"],
    "GPL-2.0": ["ac030042b4547a3b04af6cfa0fe64a40d16ab30fb6540ce4f6819d70d88473af", "3a3e6f4a9ce533681025dedf51f91ff124e4de61423dfde23dcf2100859ee700"],
    "GPL-3.0": ["94ec7c622a75b8660ec7e886c855d845fdded1693641c62b977a6f4756b6d4ab", "7b7199315c32f2cbd1dd18bf1bdaffd83aabcc6cc5c1cb720a3f7f6ac33c4852"],
    "LGPL-2.0": ["f17ebefdba4ae01060494f3396c1bc854578b6eaafaa6fe8abcf7a94e7fc2a6e", "1bcddbd821db9aff439d7cd0cc29582bde4192194dead3bbf1218f38ca99554f"],
    "LGPL-2.1": ["50866b22e296e073a398813dc84c4c9dec94ed1ee7d617c063eb6851a562b9d4", "1b0f2373f80527d4e0de3c4558c0b3804f46c844770e82398a9876c782f360f9"],
    "LGPL-3.0": ["e1c7b25e9116bcad127297bbfb82e6a89822822ba6bfa3af9eae995aad877765"],
    "MPL-1.1": ["c4d59213f62b0f12c8d3b40aad60ecffaf865b2b76959652206223c4ecac9050"],
    "MPL-2.0": ["d6279a2761f4523472f39ed8caa710cd655deef1eb092d6d34c591324cbb9abc"],
}
# Patterns and what replaces them, in order, where \\1 is the first group. Spellings follow the public matching guidelines for licences.
RULES = [
    (r"([.!)]) +((?:licensed|released) under|this work is licensed|spdx-license)", "\\1\n\\2"),
    (r"(?m)^[ \t#*/;%!-]*(?:copyright *(?:\(c\)|©|[0-9<\[])|©|\(c\) *(?:copyright|[0-9]))[^\n]*$", ""),
    (r"(?m)(\A|\n[ \t\r#*/;%!-]*\n)[ \t#*/;%!-]*copyright +(?:by +)?[^ \n]+(?: +[^ \n]+){0,4}[ \r]*$", "\\1"),
    (r"all rights reserved\.?", ""),
    (r"sub-?licen[cs]", "sublicens"),
    (r"licen[cs]e", "license"),
    (r"\b(acknowledg|judg)ement", "\\1ment"),
    (r"\b(author|organ|real|recogn|util|emphas|initial|maxim|optim|capital|categor|custom|summar|synchron)is(e|ation|ing)", "\\1iz\\2"),
    (r"\b(fav|lab|hon|behavi)our", "\\1or"),
    (r"copyright owner", "copyright holder"),
    (r"non-?infring|non-?commercial|as-is|&|https?://", " "),
    (r"[^\p{L}\p{N}\n]+", " "),
    (r" ?\n[ \n]*", "\n"),
]
#: A first line that only names the licence, in the canonical form.
TITLE = r"\A\n?(?:the )?(?:[\p{L}\p{N}]+ ){0,6}license(?: [\p{L}\p{N} ]{0,40})?\n"


def _to(replacement: str) -> str:
    return replacement.replace("\\", "$")


def canonical_lines(text: Column) -> Column:
    """Canonical form that still has its line breaks."""
    out = F.lower(text)
    for pattern, to in RULES:
        out = F.regexp_replace(out, pattern, _to(to))
    return F.trim(out)


def canonical(lines: Column) -> Column:
    """The whole text in one line, without a title."""
    return F.nullif(F.trim(F.translate(F.regexp_replace(lines, TITLE, ""), "\n", " ")), F.lit(""))


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


def known(spark: SparkSession, whole: bool) -> DataFrame:
    """(known_digest, licence): of whole texts and notices, or of one-line notices only. Its size is that of this module."""
    rows = [(k, x) for k, xs in NOTICES.items() for x in xs] + ([(k, x) for k, x in TEXTS.items()] if whole else [])
    table = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("licence"), F.lit(x).alias("text")) for k, x in rows])))
    table = table.select(_digest(canonical(canonical_lines(F.col("text")))).alias("known_digest"), "licence")
    if whole and DIGESTS:
        fixed = F.array(*[F.struct(F.lit(d).alias("known_digest"), F.lit(k).alias("licence")) for k, ds in DIGESTS.items() for d in ds])
        table = table.unionByName(spark.range(1).select(F.inline(fixed)))
    return table.groupBy("known_digest").agg(F.min("licence").alias("licence"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, licence of the whole text, comma-joined licences of its lines)."""
    spark = df.sparkSession
    lines = df.select(F.col(id_col).alias("id"), canonical_lines(F.col(text_col)).alias("lines"))
    # only the few short lines that could be a notice travel on with the digest
    longest = max(len(x) for xs in NOTICES.values() for x in xs)
    short = F.expr(f"filter(split(lines, '\\n'), x -> length(x) between 1 and {longest} and (x like '%licens%' or x like '%released%'))")
    base = lines.select("id", _digest(canonical(F.col("lines"))).alias("digest"), F.transform(short, lambda x: _digest(F.trim(x))).alias("notices"))
    base = base.join(F.broadcast(known(spark, True)), F.col("digest") == F.col("known_digest"), "left").drop("known_digest")
    table = F.create_map(*[F.lit(x) for r in known(spark, False).collect() for x in (r["known_digest"], r["licence"])])  # a few fixed rows
    base = base.withColumn("table", table)
    found = F.expr("array_join(array_sort(array_distinct(filter(transform(notices, x -> table[x]), x -> x is not null))), ',')")
    return base.select(F.col("id").alias(id_col), "digest", "licence", F.coalesce(found, F.lit("")).alias("notice_licences"))


def op8_licences(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_sql() -> str:
    def quote(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def lines(col: str) -> str:
        out = f"lower({col})"
        for pattern, to in RULES:
            out = f"regexp_replace({out}, {quote(pattern)}, {quote(to)}, 'g')"
        return f"trim({out}, ' ')"

    whole = lambda x: f"nullif(trim(replace(regexp_replace({x}, {quote(TITLE)}, ''), chr(10), ' '), ' '), '')"
    rows = [(k, x, 1) for k, xs in NOTICES.items() for x in xs] + [(k, x, 0) for k, x in TEXTS.items()]
    values = ", ".join(f"({quote(k)}, {quote(x)}, {n})" for k, x, n in rows)
    fixed = ", ".join(f"({quote(d)}, {quote(k)})" for k, ds in DIGESTS.items() for d in ds)
    return f"""WITH known AS (SELECT kd, min(licence) AS licence, max(notice) AS notice FROM (SELECT sha256({whole(lines('text'))}) AS kd, licence, notice FROM (VALUES {values}) t(licence, text, notice) UNION ALL SELECT kd, licence, 0 FROM (VALUES {fixed}) f(kd, licence)) GROUP BY 1),
base AS (SELECT doc_id, {lines('text')} AS l FROM documents),
whole AS (SELECT doc_id, l, sha256({whole('l')}) AS digest FROM base),
found AS (SELECT doc_id, string_agg(DISTINCT k.licence, ',' ORDER BY k.licence) AS n FROM (SELECT doc_id, unnest(string_split(l, chr(10))) AS line FROM base) x JOIN known k ON sha256(nullif(trim(line, ' '), '')) = k.kd AND k.notice = 1 GROUP BY doc_id)
SELECT w.doc_id, w.digest, k.licence, coalesce(f.n, '') AS notice_licences FROM whole w LEFT JOIN known k ON w.digest = k.kd LEFT JOIN found f ON f.doc_id = w.doc_id"""

"""Licence scan by canonical digests of whole texts.

Canonical form: A-Z folded, typographic quotes, dashes and spaces as white
space; lines that are a copyright notice, "All rights reserved" or a licence's
bare title are dropped; words are what stands between other ASCII characters
than letters and digits; equivalent spellings are replaced word by word, then
equivalent phrases. The SHA-256 of that form is joined with the
digests of the known licences, a fixed list (its size is that of the list, so
it is broadcast). A line that begins with "copyright holder", "copyright
notice" and the like is no notice, however a licence is wrapped.

A null or empty text, or one that holds nothing but dropped lines, has the
digest of the empty form and no licence. Repeated rows each get their row; two
licences of one canonical form give the one of the smaller name. Other columns
are ignored, whatever their names. The method finds whole texts only: a licence
inside another text has another digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that licence matching guidelines treat as equal.
EQUIVALENT = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze",
    "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "capitalisation": "capitalization", "catalogue": "catalog",
    "centre": "center", "colour": "color", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment",
    "labelling": "labeling", "labour": "labor", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "offence": "offense", "optimise": "optimize", "organisation": "organization",
    "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
    "https": "http",
}

# Phrases that count as equal once words are.
PHRASES = (
    ("copyright owners", "copyright holders"), ("copyright owner", "copyright holder"), ("sub license", "sublicense"), ("sub licenses", "sublicenses"),
    ("non commercial", "noncommercial"), ("per cent", "percent"),
)

# Short public licences and licence statements, whole.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>""",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
}

# SHA-256 of the canonical forms of long public licences.
DIGESTS: dict[str, str] = {
    "Apache-2.0": "4580e5390400d27df89edd0617548ac0e66eaa029f6e07cf98aac9cd100b3a37",
    "GPL-1.0": "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
    "GPL-2.0": "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
    "GPL-3.0": "5fc5b48e8eeed6e5e77c32ad8641a6bc04d25011d6b500aa7dc7f3183ab812ea",
    "LGPL-2.0": "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
    "LGPL-2.1": "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6",
    "MPL-2.0": "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "Artistic-1.0-Perl": "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702",
    "GFDL-1.2": "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60",
    "GFDL-1.3": "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826",
}

_MARKS = " \u00a0‐‑‒–—―‘’‚‛“”„‟•"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LEAD = r"(^|\n)[\t /*#;.-]*"
#: A mark behind "copyright" keeps lines that begin with such words from being notices.
_PLAIN = r"copyright([ \t\n]+(?:holders?|owners?|notices?|laws?|statements?|licen[cs]es?|interests?|protection|and|or|in|to|is|are|disclaimers?)[^a-z])"
_NOTICE = _LEAD + r"(?:copyright(?:[ \t:(<\[{]|©)|\(c\)|©)[^\n]*"
_RIGHTS = _LEAD + r"all rights reserved[.]?[ \t]*(\n|\z)"
_NAMES = r"(?:mit|expat|x11|isc|zlib|zlib/libpng|bsd|simplified bsd|new bsd|modified bsd|revised bsd|bsd [0-9][ -]clause|[0-9][ -]clause bsd|bsd zero[ -]clause)"
_TITLE = _LEAD + r"(?:the )?" + _NAMES + r" licen[cs]e(?: \([a-z0-9 -]+\))?[.:]?[ \t]*(\n|\z)"
_WORD, _BETWEEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def canonical(text: Column) -> Column:
    t = F.translate(F.coalesce(text, F.lit("")), _UPPER + _MARKS, _LOWER + " " * len(_MARKS))
    # Few texts hold what a rule is about, and looking for it costs less than the rule.
    t = F.when(t.contains("copyright"), F.regexp_replace(t, _PLAIN, "copyright_$1")).otherwise(t)
    t = F.when(t.contains("copyright") | t.contains("(c)") | t.contains("©"), F.regexp_replace(t, _NOTICE, "\n")).otherwise(t)
    t = F.when(t.contains("all rights reserved"), F.regexp_replace(t, _RIGHTS, "\n")).otherwise(t)
    t = F.when(t.contains("license") | t.contains("licence"), F.regexp_replace(t, _TITLE, "\n")).otherwise(t)
    # Words stand between spaces of their own, so that replacing one never hides the next.
    t = F.concat(F.lit(" "), F.regexp_replace(t, _BETWEEN, "  "), F.lit(" "))
    for word, same in EQUIVALENT.items():
        t = F.replace(t, F.lit(f" {word} "), F.lit(f" {same} "))
    t = F.replace(t, F.lit("  "), F.lit(" "))
    for a, b in PHRASES:
        t = F.replace(t, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(t)


def known(spark, texts: dict[str, str] = KNOWN) -> DataFrame:
    """(digest, license) of the known texts and of the long ones known by digest."""
    rows = spark.createDataFrame(list(texts.items()), "license string, text string")
    rows = rows.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license")
    if DIGESTS:
        rows = rows.union(spark.createDataFrame([(d, k) for k, d in DIGESTS.items()], "digest string, license string"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def scanned(docs: DataFrame, texts: dict[str, str] = KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, digest of its canonical text, license (null where unknown)."""
    own = docs.select(F.col(id_col), F.sha2(canonical(F.col(text_col)), 256).alias("digest"))
    return own.join(F.broadcast(known(docs.sparkSession, texts)), "digest", "left").select(id_col, "digest", "license")


def variants() -> list[tuple[int, str]]:
    """(doc_id, text): known licences as files hold them: wrapped, titled, with notices, in other spellings."""
    from textwrap import fill

    wrapped = lambda k, n: "\n\n".join(fill(p, n) for p in KNOWN[k].split("\n\n"))
    notice = "Copyright (c) 2001-2020 Jane Doe <jane@example.org>\n"
    texts = [
        "MIT License\n\n" + notice + "\n" + wrapped("MIT", 78),
        "The MIT License (MIT)\n\nCopyright © 2019 Example\n\n" + wrapped("MIT", 60),
        notice + "All rights reserved.\n\n" + wrapped("BSD-2-Clause", 74),
        "BSD 2-Clause License\n\n" + notice + "\n" + "\n".join(KNOWN["BSD-2-Clause"].replace("COPYRIGHT", "\nCOPYRIGHT").splitlines()),
        KNOWN["BSD-2-Clause"].replace("COPYRIGHT HOLDER", "COPYRIGHT OWNER"),
        "/*\n" + "\n".join(" * " + x for x in (notice + wrapped("ISC", 70)).split("\n")) + "\n */",
        KNOWN["MIT"].replace("sublicense", "sub-license").upper(),
        KNOWN["Zlib"].replace("acknowledgment", "acknowledgement").replace("'as-is'", "“as is”"),
        wrapped("BSD-3-Clause", 72),
        wrapped("Unlicense", 66),
        KNOWN["MIT"] + "\nExcept on Sundays.",
        notice,
    ]
    return list(enumerate(texts))


def oracle_sql(rows: str = "select doc_id, text from documents") -> str:
    """The same in DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    same = "map {" + ", ".join(f"{quote(a)}: {quote(b)}" for a, b in EQUIVALENT.items()) + "}"

    def form(t: str) -> str:
        t = f"translate(coalesce({t}, ''), {quote(_UPPER + _MARKS)}, {quote(_LOWER + ' ' * len(_MARKS))})"
        t = f"regexp_replace({t}, {quote(_PLAIN)}, 'copyright_\\1', 'g')"
        for pattern in (_NOTICE, _RIGHTS, _TITLE):
            t = f"regexp_replace({t}, {quote(pattern)}, chr(10), 'g')"
        t = f"' ' || array_to_string(list_transform(regexp_extract_all({t}, {quote(_WORD)}), lambda x: coalesce({same}[x], x)), ' ') || ' '"
        for a, b in PHRASES:
            t = f"replace({t}, ' {a} ', ' {b} ')"
        return f"sha256(trim({t}, ' '))"

    texts = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in KNOWN.items())
    long = "".join(f" union all select {quote(d)}, {quote(k)}" for k, d in DIGESTS.items())
    return f"""with known as (select digest, min(license) as license from (select {form("text")} as digest, license from (values {texts}) t(license, text){long}) group by 1),
own as (select doc_id, {form("text")} as digest from ({rows}))
select doc_id, digest, license from own left join known using (digest)"""


def variants_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return oracle_sql("select doc_id, text from (values " + ", ".join(f"({i}, {quote(t)})" for i, t in variants()) + ") t(doc_id, text)")

"""License scans: canonical digest lookup.

A text is brought to a canonical form: A-Z in lower case, copyright lines out, every run of
other signs and white space a single space, equivalent spellings of whole words made one.
The SHA-256 of the whole form is then joined with the digests of known licence texts. The
same is done for each line of a text, joined with the digests of known one-line notices, so
a notice inside a longer document is found as well.

Defined results. A null text, and one without a letter or digit, has no digest (null)
and no licence. Repeated rows are kept one for one; rows without an id are kept.
Columns other than those named are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii

#: Pairs of spellings that licence matching treats as one, from and to; whole words.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("artefact", "artifact"), ("calibre", "caliber"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"),
    ("copyright holder", "copyright owner"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("https", "http"), ("judgement", "judgment"),
    ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("modelled", "modeled"), ("modelling", "modeling"), ("non commercial", "noncommercial"), ("offence", "offense"),
    ("per cent", "percent"), ("practise", "practice"), ("programme", "program"), ("signalling", "signaling"), ("sub license", "sublicense"), ("sub licence", "sublicense"), ("whilst", "while"),
    ("wilful", "willful"), ("wilfull", "willful"), ("wilfully", "willfully"),
]
#: Verbs with s for z, and their endings.
VERBS = ["authori", "capitali", "categori", "emphasi", "initiali", "maximi", "minimi", "optimi", "organi", "reali", "recogni", "utili"]
ENDINGS = ["e", "ed", "es", "ing", "ation", "ations"]
RULES = [(was + tail, now + tail) for was, now in SPELLINGS for tail in ("", "s")] + [(f"{v}s{e}", f"{v}z{e}") for v in VERBS for e in ENDINGS] + [(f"analys{e}", f"analyz{e}") for e in ("e", "ed", "ing")]
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A copyright notice: a line with a year or a sign after the word, not a sentence that wrapping starts with it.
NOTICE_LINE = r"(?m)^[ \t*#/]*(copyright[ \t]*(\(c\)|©|:|[12][0-9]{3})|(\(c\)|©)[ \t]*(copyright[ \t]*)?[12][0-9]{3}|all rights reserved[. \t\r]*$)[^\n]*$"
_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
#: Whole licence texts and one-line notices, by licence.
TEXTS = [
    ("MIT", f"Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_WARRANTY}"),
    ("MIT-0", f"Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. {_WARRANTY}"),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_ISC}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC}"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
]
_CONDITIONS = [
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
]
_BSD = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_bsd = lambda n, mark: " ".join(["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", *[mark.format(k + 1) + x for k, x in enumerate(_CONDITIONS[:n])], _BSD])
#: More whole texts, with numbers before their conditions and without.
FURTHER = [(f"BSD-{n}-Clause", _bsd(n, mark)) for n in (2, 3) for mark in ("{}. ", "* ")]
#: What a whole text may have as its first line.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "MIT-0": ["MIT No Attribution", "MIT No Attribution License"], "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License"], "Zlib": ["zlib License", "The zlib License", "zlib/libpng license"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License"],
}
#: Digests of the canonical forms of longer texts as they are published, whole and up to the end of their terms.
DIGESTS = [
    ("Apache-2.0", "95f35d79ea3bab75c250549d6a03cef242e0547d78c99e26fcede49936fb0184"),
    ("Apache-2.0", "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0"),
    ("Artistic-1.0-Perl", "64e91f5cc481723b420f8e1ecf131ec7eba02da96cf0a78bb4b764fb30984f7a"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "66919c3537107c2c9f5219f6ba4c41fe9c0d7c14d885087e3db69494463a778e"),
    ("GFDL-1.3", "525fd4384869c81c4cbd264822942ae15202284aed28fb120ba01fc119dda9ff"),
    ("GPL-1.0", "37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f"),
    ("GPL-1.0", "3b5b36de4a3801680b9eb44e80739b3aeb71c4bf6ca623ee5f87b2e2b03d3ed9"),
    ("GPL-2.0", "ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6"),
    ("GPL-2.0", "a76cc6ce70778ba70e43b9b1838f9e3f88b3fc7c5acbb3b8a9847918003b63e0"),
    ("GPL-3.0", "ee0d2b91860148fdc6916d4fbea5723c7b0c7330d7a45ee71fabe123ce7175f8"),
    ("GPL-3.0", "4a9083dfa89bea4f460e373a4c7a4645205d5e3d3be775d544b10357e357f57b"),
    ("LGPL-2.0", "bea988245c65edbddad6f43ff12ca2472c232324e916d42648b90eac944d833e"),
    ("LGPL-2.0", "7d5246cc24a9d78fffd01a07fbc2e71edd1e94ad8d403f3180a4cf5fef43d389"),
    ("LGPL-2.1", "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692"),
    ("LGPL-2.1", "65484d3c9f900f96945bd4e6c5397aaa24f93bdc8f720eae06fbd377c62cfe97"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
]
NOTICES = [
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
]


def alternation(words: list[str]) -> str:
    """A pattern for any of words, with their common beginnings said once."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    if len(heads) == 1 and "" not in heads:
        ((head, tails),) = heads.items()
        return head + alternation(tails)
    some = [h + alternation(tails) for h, tails in heads.items() if h]
    return f"(?:{'|'.join(some)})" + "?" * ("" in heads) if some else ""


def spaced(phrase: str) -> str:
    """Each word with a space of its own on either side, so that neighbours never share one."""
    return " " + phrase.replace(" ", "  ") + " "


def canonical(text: Column) -> Column:
    """The canonical form; empty if no letter or digit is left."""
    c = F.regexp_replace(lower_ascii(text), NOTICE_LINE, " ")
    c = F.concat(F.lit("  "), F.trim(F.regexp_replace(c, NOT_WORD, "  ")), F.lit("  "))
    one = c
    for was, now in RULES:
        one = F.replace(one, F.lit(spaced(was)), F.lit(spaced(now)))
    # Most texts have no word with a rule, and are looked at once.
    return F.trim(F.replace(F.when(c.rlike(alternation(sorted(spaced(was) for was, _ in RULES))), one).otherwise(c), F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    c = canonical(text)
    return F.when(F.length(c) > 0, F.sha2(c, 256))


def known(spark: SparkSession, texts: list[tuple[str, str]], digests: list[tuple[str, str]] = []) -> DataFrame:
    """(license_id, digest) of licence texts, with and without titles, and of those whose digests are given; a list of a few, so safe to broadcast."""
    titled = [(name, f"{title}\n{text}") for name, text in texts for title in TITLES.get(name, [])]
    made = spark.createDataFrame([*texts, *titled], "license_id string, _t string").select("license_id", digest(F.col("_t")).alias("digest"))
    return made.union(spark.createDataFrame(digests, "license_id string, digest string")).distinct()


def scan(docs: DataFrame, texts: DataFrame, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """doc_id, digest, license_id (of the whole text) and notice_ids (of its lines).

    texts is what known() returns. The notices are a short list in the code and become
    a map constant, so their lookup needs no join.
    """
    named = F.create_map(*[x for name, text in notices for x in (digest(F.lit(text)), F.lit(name))])
    # A line is looked at only if it has a word that every notice has; the whole text always is.
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("(?i)licen[cs]e"))
    hit = F.filter(F.transform(lines, lambda x: F.element_at(named, digest(x))), lambda x: x.isNotNull())
    base = docs.select("doc_id", digest(F.col("text")).alias("digest"), F.array_join(F.array_sort(F.array_distinct(hit)), ",").alias("notice_ids"))
    return base.join(F.broadcast(texts.select("digest", "license_id")), "digest", "left").select("doc_id", "digest", "license_id", F.coalesce("notice_ids", F.lit("")).alias("notice_ids"))

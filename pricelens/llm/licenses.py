"""License scan (operator 8) by canonical digests, in DataFrame functions only.

A text is made canonical (lower case, punctuation and white space to single spaces,
copyright lines dropped, equivalent spellings unified) and its digest is looked up in the
table of known licence texts. Whole documents are looked up, and each line as a notice of
its own. Equal digests need equal lengths, so only texts of a known canonical length are
hashed and joined; the known table is a fixed list, and the only broadcast side.

Defined results: a NULL, empty or punctuation-only text or line matches nothing; a document
of one line may match as text and as line; repeated rows each give their rows; rows without
``doc_id`` keep NULL there; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import pkgutil
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public licence texts and notices.
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
    "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
    "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
    "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution. ")
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. ")
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted")
_ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies. "
_ISC_DISCLAIMER = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
    "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE.")
KNOWN = [
    ("MIT", "MIT License " + _MIT_GRANT), ("MIT", "The MIT License (MIT) " + _MIT_GRANT), ("MIT", _MIT_GRANT),
    ("BSD-2-Clause", _BSD_GRANT + _BSD_DISCLAIMER), ("BSD-2-Clause", "BSD 2-Clause License " + _BSD_GRANT + _BSD_DISCLAIMER),
    ("BSD-3-Clause", _BSD_GRANT + _BSD_NAMES + _BSD_DISCLAIMER),
    ("BSD-3-Clause", "BSD 3-Clause License " + _BSD_GRANT + _BSD_NAMES + _BSD_DISCLAIMER),
    ("ISC", _ISC_GRANT + _ISC_NOTICE + _ISC_DISCLAIMER), ("ISC", "ISC License " + _ISC_GRANT + _ISC_NOTICE + _ISC_DISCLAIMER),
    ("0BSD", _ISC_GRANT + ". " + _ISC_DISCLAIMER), ("0BSD", "Zero-Clause BSD " + _ISC_GRANT + ". " + _ISC_DISCLAIMER),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("all-rights-reserved", "All rights reserved."),
    ("MIT", "SPDX-License-Identifier: MIT"), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"), ("ISC", "SPDX-License-Identifier: ISC"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
]
# Where the terms end and advice on their use follows, and addresses that texts of the same terms give.
_TERMS_END = "END OF TERMS AND CONDITIONS"
_ADDRESS = re.compile(r"51 Franklin St(?:reet)?, Fifth Floor, Boston,? MA\s+02110-1301\s+USA")
_ADDRESSES = ("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA",
              "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "675 Mass Ave, Cambridge, MA 02139, USA")
# Spellings that count as equal, each with the form that stands for it.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "catalogue": "catalog", "categorise": "categorize",
    "centre": "center", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill",
    "fulfilment": "fulfillment", "https": "http", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling",
    "labour": "labor", "licence": "license", "licenced": "licensed", "licences": "licenses", "maximise": "maximize",
    "modelled": "modeled", "modelling": "modeling", "offence": "offense", "optimise": "optimize", "organisation": "organization",
    "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize",
    "signalling": "signaling", "sublicence": "sublicense", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}
# Canonical lines that are copyright lines whatever their punctuation was (the SQL reads this rule too).
_COPYRIGHT = r"^(copyright( c)?( [0-9]{4}|$| by | the )|c [0-9]{4}|all rights reserved)"
# Words that follow "copyright" where a line of a licence body was wrapped.
_BODY = ("notices?|holders?|owners?|ownership|licen[sc]es?|licensors?|statements?|laws?|interests?|treaty|act|permissions?|protection|"
         "disclaimers?|doctrines?|claims?|patents?|trademarks?|related|rights?|infringements?|status|assignments?|agreements?|"
         "information|material|and|or|on|in|of|for|to|is|it|with|as|that|under|from|including")
_YEAR = r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])"
_BLANK = r"[<\[{(](?:yyyy|year|name|fullname|full name|copyright|date)"  # the blanks of a template
# Copyright lines as they are written: the sign tells; the bare word or "(c)", which licence bodies have at line starts
# as well, needs a year, a template's blank or a capitalised name.
_NOTICE = (r"^[^\p{L}\p{N}©]*(?:(?i:portions(?: are)?|parts of this \p{L}+(?: are)?)[ \t]+)?(?:"
           r"(?i:copyright)[\s:,]*+(?:©|\([cC]\)|(?i:&copy;))|©[^\p{L}\p{N}]*[\p{L}\p{N}]|"
           rf"(?i:copyright)[\s:,]++(?!(?i:{_BODY})(?!\p{{L}}))(?:.*{_YEAR}|.*(?i:{_BLANK})|\p{{Lu}})|"
           rf"\([cC]\)[\s:,]*+(?:.*{_YEAR}|(?i:{_BLANK})|(?:(?:\p{{Lu}}[\p{{L}}\p{{N}}.'-]*+|(?:and|of|the)(?!\p{{L}})|&)[\s,.]*+){{2,8}}$))")
_VARIANT = "(^| )(" + "|".join(SPELLINGS) + ")( |$)"


def full_texts() -> list[tuple[str, str]]:
    """``known_licenses.jsonl`` (a fixed list that comes with this package) in its usual forms: with and without the advice
    after the terms, with each address of the publisher; BSD texts also without numbers."""
    out = []
    for line in pkgutil.get_data(__package__, "known_licenses.jsonl").decode().splitlines():
        x = json.loads(line)
        terms, end, _ = x["text"].partition(_TERMS_END)
        for t in {x["text"], terms + end, terms}:
            out += [(x["license_id"], y) for y in {t, *(_ADDRESS.sub(a, t) for a in _ADDRESSES)}]
    bsd = [(i, t) for i, t in KNOWN + out if i.startswith("BSD-") and "Redistribution and use" in t]
    return out + [(i, re.sub(r"\b[123]\. (?=Redistributions|Neither)", "", t)) for i, t in bsd]


def canonical_lines(text: Column) -> Column:
    """Each line's canonical form, and whether it was written as a copyright line."""
    def plain(line: Column) -> Column:
        return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))

    same = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])

    def spelled(line: Column) -> Column:
        return F.when(line.rlike(_VARIANT), F.array_join(F.transform(F.split(line, " "), lambda w: F.coalesce(same[w], w)), " ")).otherwise(line)
    lines = F.transform(F.split(text, "\r\n|\r|\n"), lambda x: F.struct(plain(x).alias("plain"), x.rlike(_NOTICE).alias("notice")))
    return F.transform(lines, lambda x: F.struct(spelled(x["plain"]).alias("canonical"), x["notice"].alias("notice")))


def canonical_text(lines: Column) -> Column:
    """A whole text from its canonical lines, without copyright lines."""
    body = F.filter(lines, lambda x: (x["canonical"] != "") & ~x["notice"] & ~x["canonical"].rlike(_COPYRIGHT))
    return F.array_join(F.transform(body, lambda x: x["canonical"]), " ")


def known_digests(spark: SparkSession, known) -> DataFrame:
    """``license_id, scope, digest``: texts for whole documents and lines (``known`` is a
    fixed, bounded list)."""
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("text")) for i, t in known]))
    t = spark.range(1).select(rows.alias("k")).select("k.license_id", canonical_lines(F.col("k.text")).alias("lines"))
    whole = t.select("license_id", F.lit("text").alias("scope"), canonical_text(F.col("lines")).alias("canonical"))
    line = t.select("license_id", F.lit("line").alias("scope"), F.array_join("lines.canonical", " ").alias("canonical"))
    return whole.union(line).where("canonical <> ''").select("license_id", "scope", "canonical", F.sha2("canonical", 256).alias("digest")).distinct()


def find_licenses(spark: SparkSession, docs: DataFrame, known=None) -> DataFrame:
    """``doc_id, license_id, scope, line`` for each document and line that is a known text
    (``line`` from 0, NULL for whole documents); ``known`` is ``KNOWN`` and the full texts if not given."""
    digests = known_digests(spark, KNOWN + full_texts() if known is None else known)
    sizes = [r["n"] for r in digests.select(F.length("canonical").alias("n")).distinct().collect()]
    d = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), canonical_lines(F.col("text")).alias("lines"))
    units = F.concat(
        F.array(F.struct(F.lit("text").alias("scope"), F.lit(None).cast("int").alias("line"), canonical_text(F.col("lines")).alias("canonical"))),
        F.transform("lines", lambda x, i: F.struct(F.lit("line").alias("scope"), i.alias("line"), x["canonical"].alias("canonical"))))
    u = d.select("doc_id", F.explode(F.filter(units, lambda x: F.length(x["canonical"]).isin(sizes))).alias("u"))
    u = u.select("doc_id", "u.scope", "u.line", F.sha2("u.canonical", 256).alias("digest"))
    return u.join(F.broadcast(digests.drop("canonical")), ["scope", "digest"]).select("doc_id", "license_id", "scope", "line")

"""License scans: canonical digests of entire texts, joined to those of known licences.

A text's canonical form drops copyright lines, case, punctuation and layout, and
writes words with several spellings one way.  Whole documents are looked up, and
so is each line as a text of its own, for notices that stand among other text.
"""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Spellings that count as equal (pattern over canonical words, replacement).
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("copyright holders", "copyright owner"), ("copyright holder", "copyright owner"), ("copyright owners", "copyright owner"),
    ("authors", "author"), ("favour", "favor"), ("behaviour", "behavior"), ("organisation", "organization"), ("merchantibility", "merchantability"), ("http", "https"), ("v2 0", "version 2 0"), ("v3", "version 3"), ("gpl", "gnu general public license"),
)
_YEAR = r"(?:19|20)[0-9]{2}"
# Lines of lower-case text that name a holder: with (c), a year or a place for one, or, where a paragraph starts, with a word that begins no sentence on copyright.
COPYRIGHT_LINE = (
    r"(?dm)^(?=[^a-z0-9\n]*(?:copyright|c\)|all rights reserved)|[^a-z0-9\n]*\u00a9)(?:"
    rf"[^a-z0-9\n]*copyright[^a-z0-9\n]*(?:\(c\)|\u00a9|(?:c )?{_YEAR}|(?<=[\[<{{(])(?:yyyy|year|xxxx))"
    rf"|[^a-z0-9\n]*\(c\)(?:[^a-z0-9\n]*(?:copyright[^a-z0-9\n]*)?{_YEAR}|[^\n]*all rights reserved)"
    r"|[^a-z0-9\n]*\u00a9"
    rf"|[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*(?:by\b|copyright|c\)|{_YEAR})"
    r"|(?<![a-z0-9][^a-z0-9\n]{0,40}\n)[^a-z0-9\n]*copyright[ \t:,]+(?!(?:notices?|licen[cs]es?|holders?|owners?|laws?|rights?|interests?|statements?|treaty|act|protection|permissions?|disclaimer|and|or|in|on|to|of|for|as|is|are|under|shall|must|may)\b)[a-z0-9]"
    r"|\A[^a-z0-9\n]*\(c\)[^a-z0-9\n]*[a-z0-9]"
    r")[^\n]*"
)

_PERMIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_MIT_END = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_TOP = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."

# Known licence texts and the notices that name a licence.
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", f"MIT License\n\n{_PERMIT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_MIT_END}"),
    ("MIT", f"{_PERMIT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_MIT_END}"),
    ("MIT-0", f"{_PERMIT}.\n\n{_MIT_END}"),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n{_ISC_END}"),
    ("BSD-2-Clause", _BSD_TOP + _BSD_END),
    ("BSD-3-Clause", _BSD_TOP + _BSD_3 + _BSD_END),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GPL v3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
)


def canonical(text: Column) -> Column:
    """The words that count, separated by single spaces; ASCII letters and digits only."""
    out = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), "\r", ""), UPPER, LOWER)
    out = F.regexp_replace(out, COPYRIGHT_LINE, "")
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, "[^a-z0-9]+", " ")), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(out)


#: SHA-256 of a text without words.
EMPTY = hashlib.sha256(b"").hexdigest()


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form, never null: so the form is computed once, and no filter on nulls computes it again."""
    return F.coalesce(F.sha2(canonical(text), 256), F.lit(""))


def long_digests() -> list[tuple[str, str]]:
    """(license, digest) of the whole texts of long licences, and of short ones with a line that reserves all rights, from the data file."""
    return [tuple(x.split()) for x in (Path(__file__).parent / "license_digests.txt").read_text().splitlines()]


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """(license, digest) of known texts, the long ones' too; a digest of two licences keeps the first by name."""
    rows = spark.createDataFrame(list(known), "license string, text string").select("license", digest(F.col("text")).alias("digest"))
    return rows.union(spark.createDataFrame(long_digests(), "license string, digest string")).groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, digest, license, n_notices, notices) of each document.

    digest and license: of the whole text, null where it has no words or is no known
    text.  notices: the licences that single lines are texts or notices of, sorted
    and joined by commas; empty if none.  Null text has no words.  Repeated rows stay,
    each with the notices of its own text; other columns are ignored.  known: (digest, license)
    with unique digests; Spark picks the join by its size.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("same", F.xxhash64("text"))
    lines = rows.select("id", "same", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
    known = known.where(F.col("digest") != EMPTY)
    notices = lines.where(F.col("line") != "").select("id", "same", digest(F.col("line")).alias("digest")).join(known, "digest")
    notices = notices.groupBy("id", "same").agg(F.array_sort(F.collect_set("license")).alias("found")).toDF("_id", "_same", "found")
    whole = rows.select("id", "same", digest(F.col("text")).alias("digest")).join(known, "digest", "left").withColumn("digest", F.nullif("digest", F.lit(EMPTY)))
    out = whole.join(notices, F.col("id").eqNullSafe(F.col("_id")) & (F.col("same") == F.col("_same")), "left")
    return out.select(F.col("id").alias(id_col), "digest", "license", F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_notices"), F.coalesce(F.array_join("found", ","), F.lit("")).alias("notices"))

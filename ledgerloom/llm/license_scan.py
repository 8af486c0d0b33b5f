"""Canonical licence digests (operator 3).

A text is lower-cased, loses copyright notices, has equivalent spellings made
equal and punctuation and white space reduced to single spaces, and the SHA-256
of what is left is looked up among digests of known licences, each with and
without its title and its appendix.  Only whole texts match: a licence inside a
longer text is another digest.
"""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words after "copyright" or "(c)" in a licence's own sentences and numbered points, where no year or holder follows.
NOT_HOLDERS = r"notices?|holders?|owners?|licen[cs]es?|laws?|statements?|treaty|disclaimers?|interests?|permissions?|protection|rights?|doctrines?|and|or|the software|in|on|to|for|of|as|is|are|by (?:law|applicable)"
NOT_NAMES = r"you|the|an?|any|all|each|if|in|on|to|for|of|or|and|under|where|when|that|this|such|it|is|must|may|with|without|by"
_WORD, _NO_HOLDER, _MARKED = r"(?i:copyright)", rf"(?![ \t:]+(?i:{NOT_HOLDERS})\b)", r"[^A-Za-z0-9\n©]*?"
#: A line that begins, after marks, with a copyright notice: a sign, a year or a capital holder follows, or any holder after an empty line.  A wrapped sentence's line stays.
COPYRIGHT_NOTICE = (
    rf"(?m)^(?:{_MARKED}(?:{_WORD}[ \t:,]*(?:\([cC]\)|©|[\[<{{]|[0-9]{{4}})|{_WORD}{_NO_HOLDER}[ \t:]+(?:(?i:by|the)[ \t]+)?\p{{Lu}}|©|\([cC]\)(?![ \t]*(?i:{NOT_NAMES})\b))"
    rf"|(?<![^\n]\n){_MARKED}{_WORD}{_NO_HOLDER}[ \t:]+[\p{{L}}\p{{N}}])[^\n]*$"
)
#: The rule of the query's SQL: any line that begins with the word.  The given tables have no such line.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*$"
MARKS = r"[^\p{L}\p{N}]+"
# Equivalent spellings, applied in this order after punctuation is reduced.
SPELLINGS = (
    ("all rights reserved", " "), ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"),
    ("authoris", "authoriz"), ("organis", "organiz"), ("recognis", "recogniz"), ("favour", "favor"), ("behaviour", "behavior"),
    ("fulfilment", "fulfillment"), ("judgement", "judgment"), ("acknowledgement", "acknowledgment"), ("copyright owner", "copyright holder"),
    ("https", "http"), ("per cent", "percent"), ("whilst", "while"),
)
# Public licence texts and notices.
LICENSES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Released under the MIT License.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
}


#: Whole licence texts: one file a licence, or a wording of it after a plus sign.
TEXTS = Path(__file__).resolve().parent / "licenses"
# Titles that files have above the text, or that the stored text begins with.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD License", "New BSD License"),
    "Apache-2.0": ("Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",),
    "GPL-2.0": ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991",),
    "GPL-3.0": ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "LGPL-2.1": ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",),
    "LGPL-3.0": ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "MPL-1.1": ("MOZILLA PUBLIC LICENSE Version 1.1",),
    "MPL-2.0": ("Mozilla Public License Version 2.0", "Mozilla Public License, version 2.0"),
}
#: Where a text's terms end; what follows says how to apply them and is often left out.
END_OF_TERMS = "END OF TERMS AND CONDITIONS"


def known_texts() -> list[tuple[str, str]]:
    """(id, text) of all known licences and notices, with and without what follows the end of their terms."""
    texts = list(LICENSES.items()) + [(f.stem.split("+")[0], f.read_text()) for f in sorted(TEXTS.glob("*.txt"))]
    return texts + [(name, t[: t.index(END_OF_TERMS) + len(END_OF_TERMS)]) for name, t in texts if END_OF_TERMS in t]


def canonical(text: Column) -> Column:
    """The text's canonical form; a null text's is empty."""
    t = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT_NOTICE, " "))
    t = F.regexp_replace(t, MARKS, " ")
    for spelt, meant in SPELLINGS:
        t = F.replace(t, F.lit(spelt), F.lit(meant))
    return F.trim(F.regexp_replace(t, " +", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, licenses: Mapping[str, str] | None = None) -> DataFrame:
    """license_digest, license_id of each known text as it is, with each of its titles, and without the one it begins with."""
    texts = known_texts() if licenses is None else sorted(licenses.items())
    rows = [(name, body, title) for name, body in texts for title in (*TITLES.get(name, ()), None)]
    bare, title = F.col("bare"), F.col("title")
    forms = spark.createDataFrame(rows, "license_id string, body string, title string").select("license_id", canonical(F.col("body")).alias("bare"), canonical(F.col("title")).alias("title")).where(bare != "")
    begins = bare.startswith(F.concat(title, F.lit(" ")))
    other = F.when(title == "", bare).when(begins, F.substr(bare, F.length(title) + 2)).otherwise(F.concat(title, F.lit(" "), bare))
    return forms.groupBy(F.sha2(other, 256).alias("license_digest")).agg(F.min("license_id").alias("license_id"))


def scan(documents: DataFrame, licenses: Mapping[str, str] | None = None) -> DataFrame:
    """doc_id, license_digest, license_id (null: no known licence) for each row of ``documents``.

    Null and empty texts have the digest of nothing and no licence.  The known
    digests are a few for each text of ``licenses`` (null: of all known ones)
    and are broadcast; names that share a digest give the first by name.
    Other columns are dropped.
    """
    known = known_digests(documents.sparkSession, licenses)
    found = documents.select("doc_id", digest(F.col("text")).alias("license_digest"))
    return found.join(F.broadcast(known), "license_digest", "left").select("doc_id", "license_digest", "license_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _sql(text: str) -> str:
    t = f"regexp_replace(lower(coalesce({text}, '')), '{COPYRIGHT_LINE}', ' ', 'g')"
    t = f"regexp_replace({t}, '{MARKS}', ' ', 'g')"
    for spelt, meant in SPELLINGS:
        t = f"replace({t}, '{spelt}', '{meant}')"
    return f"trim(regexp_replace({t}, ' +', ' ', 'g'))"


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


ORACLE = f"""
WITH known AS (SELECT sha256(form) AS license_digest, min(id) AS license_id FROM
  (SELECT id, {_sql("body")} AS form FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in LICENSES.items())}) t(id, body)) WHERE form <> '' GROUP BY 1),
d AS (SELECT doc_id, sha256({_sql("text")}) AS license_digest FROM documents)
SELECT doc_id, license_digest, license_id FROM d LEFT JOIN known USING (license_digest)
"""

"""Whole licences in the layouts files have: wrapped, titled, with notices, without their appendix."""

from __future__ import annotations

import textwrap

import duckdb

from ledgerloom.llm import license_scan


def test_license_layouts(spark):
    mit, isc = license_scan.LICENSES["MIT"], license_scan.LICENSES["ISC"]
    wrapped = isc.replace("that the above copyright", "that the above\ncopyright")
    texts = [(isc, "ISC"), (wrapped, "ISC"), (f"ISC License\n\nCopyright (c) 2020, A. Holder <a@example.com>\n\n{wrapped}", "ISC"), (f"Copyright A. Holder\n{mit}", "MIT")]
    texts += [(f"The MIT License (MIT)\n\nCopyright © 2011-2020 Holder\n(c) Other Holder\n\n{mit}", "MIT"), (f"Some Words\n{mit}", None)]
    for name, text in license_scan.known_texts():
        if "notice" not in name:
            for width in (50, 60, 72, 80):
                paragraphs = [textwrap.fill(" ".join(p.split()), width) for p in text.split("\n\n")]
                if "Copyright" not in text:
                    texts.append(("Copyright 2001 The Holder\n\n" + "\n\n".join(paragraphs), name))
                    texts += [(f"{title}\n\nCopyright (c) 2001 The Holder. All rights reserved.\n\n" + "\n\n".join(paragraphs), name) for title in license_scan.TITLES[name] if not text.lstrip().startswith("Mozilla")]
            texts.append((text, name))
    found = license_scan.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")).collect()
    wrong = {i: (r.license_id, texts[i][1], texts[i][0][:300]) for r in found if r.license_id != texts[i := r.doc_id][1]}
    assert len(found) == len(texts) and not wrong
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0"} <= {r.license_id for r in found}


def test_lines_of_sentences_stay(spark):
    kept = ["copyright notice and this", "COPYRIGHT HOLDERS BE LIABLE", "copyright license to reproduce", "(c) You must retain", "copyright treaty adopted on 20 December 1996", "copyright", "copyright\nnotice", "applicable\ncopyright doctrines of fair use"]
    gone = ["Copyright (c) 2020 A", "(c) 2020 A", "  # Copyright 1999-2001, A", "© A", "Copyright A. Holder", "Copyright [yyyy] [name of copyright owner]", "(C) Acme", "copyright a. holder"]
    found = spark.createDataFrame([(t,) for t in kept + gone], "text string").select("text", license_scan.canonical(license_scan.F.col("text")).alias("c")).collect()
    assert [r.text for r in found if r.c] == kept


def test_tables_match_the_sql(spark):
    data = "/root/testdata/sf0.001"
    wanted = duckdb.sql(license_scan.ORACLE.replace("FROM documents", f"FROM '{data}/documents.parquet'")).fetchall()
    assert sorted(map(tuple, license_scan.query(spark, data).collect())) == sorted(wanted)

"""No licence is lost where texts mix one-line and wrapped notices."""

import duckdb

from tickloom.llm import license_scan


def test_one_line_licences_and_wrapped_notices(spark):
    grant = license_scan.SENTENCES["mit.grant"][0]
    notice = license_scan.SENTENCES["mit.notice"][0]
    words = grant.split()
    wrapped = "\n".join(" ".join(words[i : i + 8]) for i in range(0, len(words), 8))
    texts = [f"Licensed under CC BY 4.0\nsome other line\n\n{wrapped}\n\n{notice}.\n", f"SPDX-License-Identifier: ISC\n{wrapped}\n\n{notice}.", f"# head\n{wrapped}\n\n{notice}.\n\nLicensed under CC BY 4.0\nmore"]
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["licenses"] for r in rows} == {0: "CC-BY-4.0,MIT", 1: "ISC,MIT", 2: "MIT,CC-BY-4.0"}
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    assert sorted(duck.execute(license_scan.scan_sql()).fetchall()) == sorted(tuple(r) for r in rows)

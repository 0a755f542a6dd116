"""The registered queries of the training-data operators: query name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm.common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.license_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.bpe import round_trips

    return round_trips(table(spark, sf_dir, "documents"), "byte_bpe_multi_50k.tiktoken")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table added to an index of this call's own, which is dropped when all is decided."""
    from tickloom.llm.exact_dedup import DigestIndex

    index = DigestIndex(spark, f"text_digests_{uuid.uuid4().hex[:12]}")
    found = index.add(table(spark, sf_dir, "documents"))
    index.drop()
    return found


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.substring import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op8_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.webp import media_features, media_rows

    return media_features(media_rows(table(spark, sf_dir, "documents")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.toxicity import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, CAST(count(*) OVER same AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

OP7_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(ws[s:s + 49], ' ')) AS h
        FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS s FROM w WHERE len(ws) >= 50)),
firsts AS (SELECT h, min(doc_id) AS low FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT win.doc_id, unnest(generate_series(s, s + 49)) AS p
         FROM win JOIN firsts USING (h) WHERE win.doc_id > firsts.low)),
per AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN ws
              ELSE list_transform(list_filter(list_zip(ws, generate_series(1, len(ws))), lambda x: NOT list_contains(ps, x[2])), lambda x: x[1]) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN per USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    from tickloom.llm.license_scan import scan_sql

    return {"op3_license_scan": scan_sql(), "op6_exact_dedup": OP6_SQL, "op7_substring_dedup": OP7_SQL}

import re
from collections import defaultdict

import corpus_pipeline as pipeline
import pytest

from tickloom.llm import packing, toxicity
from tickloom.llm.common import tokenizer_path

SMALL = "/root/testdata/sf0.001"


def brute_shingles(text):
    parts = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    parts = re.findall(r"[^\x20\x09-\x0D]+", parts)
    return {tuple(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))} if parts else {()}


def test_stages_against_plain_python(spark, documents, labels, tmp_path, monkeypatch):
    """run() against the same decisions taken one after another without Spark, on its own classifier and on all pairs' Jaccard similarity."""
    model, grams = toxicity.train(documents, labels), toxicity.Grams()
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    rows = [(i, t) for i, t in rows if model.score(grams(t)) < 0.5]
    last = {t: max(i for i, x in rows if x == t) for t in {t for _, t in rows}}
    rows = [(i, t) for i, t in rows if last[t] == i]
    sets = {i: brute_shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    own = sorted(sets)
    for k, a in enumerate(own):
        for b in own[k + 1 :]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    near = {i for i in own if find(i) != i}
    rows = [(i, t) for i, t in rows if i not in near]
    first, cut = {}, {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in rows}
    for i in sorted(cut):
        for s in range(len(cut[i]) - 49):
            first.setdefault(tuple(cut[i][s : s + 50]), i)
    kept = {}
    for i, w in cut.items():
        gone = {k for s in range(len(w) - 49) if first[tuple(w[s : s + 50])] < i for k in range(s, s + 50)}
        kept[i] = [x for k, x in enumerate(w) if k not in gone]
    folder = {}
    monkeypatch.setattr(pipeline, "shared_folder", lambda spark: folder.setdefault("at", str(tmp_path)))
    found, room = defaultdict(int), defaultdict(int)
    packed = pipeline.run(spark, SMALL, keep=True).collect()
    for r in packed:
        found[r["doc_id"]] += r["length"]
        room[r["sequence_id"]] += r["length"]
    assert set(found) == set(kept) and len(found) < documents.count()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{tmp_path}/pipeline-*/substring_dedup").collect()}
    assert {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in texts.items()} == kept
    ids = packing.TokenIds(tokenizer_path("byte_bpe_50k.json"))
    assert dict(found) == {i: 1 + len(ids(t)) for i, t in texts.items()} and max(room.values()) <= 1024


def test_every_stage_keeps_the_columns(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and dict(docs.dtypes)["n_chars"] == "bigint"
    kept = {r["doc_id"] for r in docs.collect()}
    assert {9, 6} <= kept and 1 not in kept and 5 not in kept
    assert pipeline.STAGES[-1][1](spark, docs, SMALL).count() >= len(kept)


def test_stages_on_an_empty_table(spark, empty):
    docs = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in pipeline.STAGES:
        docs_next = stage(spark, docs, SMALL)
        assert docs_next.count() == 0
        docs = docs_next if docs_next.columns == docs.columns else docs


@pytest.mark.parametrize("name", ["op1_html_extraction", "op2_best_fit_packing", "op3_license_scan", "op4_byte_bpe", "op5_simhash_near_dedup", "op6_exact_dedup", "op7_substring_dedup", "op8_webp_media", "op9_toxicity", "op10_language_id", "pipeline"])
def test_registered(name):
    import __spark_entry__ as entry

    assert name in entry.queries()


@pytest.mark.parametrize("name", ["op3_license_scan", "op6_exact_dedup", "op7_substring_dedup"])
def test_against_sql(spark, documents, name):
    import __spark_entry__ as entry
    import duckdb

    held = duckdb.connect()
    held.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    wanted = held.execute(entry.oracle_sql()[name]).fetchdf()
    found = entry.queries()[name](spark, SMALL).toPandas()
    columns = sorted(wanted.columns)
    assert columns == sorted(found.columns)
    assert sorted(map(repr, found[columns].astype(object).values.tolist())) == sorted(map(repr, wanted[columns].astype(object).values.tolist()))

"""No language is left out of training."""

import numpy as np
from pyspark.sql import functions as F

from tickloom.llm import langid


def test_rare_languages_are_learned(spark):
    rows = spark.range(2200).select(F.col("id").alias("doc_id"), F.concat(F.lit("l"), F.format_string("%03d", F.col("id") % 110)).alias("lang"))
    docs = rows.select("doc_id", "lang", F.concat_ws(" ", *(F.concat("lang", F.lit(x)) for x in ("abc", "def", "ghi"))).alias("text"))
    model = langid.train(docs, langid.Settings(sample=1, epochs=1, length=4))
    assert model.languages == [f"l{k:03d}" for k in range(110)]


def test_sequences_grow_with_languages():
    texts = [["a"] * 9, ["b"] * 9, ["c"] * 9]
    assert len(langid._switched(texts, np.arange(3), 3, langid.Settings(sequences=10, each=20, length=4))[1]) == 60

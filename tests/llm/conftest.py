import os
import random

import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    if not os.path.isdir(SMALL):
        pytest.skip("no test data here")
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, one long text, copies, ties, repeated rows, and columns whose names clash with computed ones."""
    r = random.Random(1)
    long = " ".join(r.choice(("alpha", "beta", "gamma", "delta", "épée", "中文")) for _ in range(30_000))
    same = " ".join(f"w{i}" for i in range(120))
    rows = [(1, "a b c", "en"), (2, None, None), (3, "", "en"), (4, " \n\t ", "fr"), (5, long, "en"), (6, long, "en"), (7, same, "de"), (8, same + " tail", "de"), (8, same + " tail", "de"), (None, same, "de"), (None, None, None), (9, "a b c", "en"), (10, "\x00\x01 x y\x85z", "en"), (11, "1234 %% --", "es")]
    return spark.createDataFrame([(i, t, g, f"src{k % 2}", 0 if t is None else len(t), k, "clash", 1.0, 2) for k, (i, t, g) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, key int, digest string, score double, hits int")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("doc_id = -1")

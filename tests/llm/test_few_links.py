"""Few links are settled in one task, and the near-copy stage needs fewer jobs of the driver by that."""

import random

from tickloom.llm import components, similar


def jobs(spark):
    return spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()


def test_one_task_gives_what_rounds_give(spark):
    r = random.Random(4)
    pairs = [(i, i + 1) for i in range(60)] + [(r.randrange(100, 400), r.randrange(100, 400)) for _ in range(150)] + [(7, 7), (9, 8), (8, 9)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    rounds = sorted(components.components(edges).collect())
    at = jobs(spark)
    assert sorted(components.components(edges, at_once=1000).collect()) == rounds
    assert jobs(spark) - at <= 10
    assert sorted(components.components(edges, at_once=100).collect()) == rounds


def test_jobs_of_the_near_copy_stage(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [(k, " ".join(words[: 60 - k % 3] + [f"x{k // 20}"] * 5)) for k in range(60)]
    at = jobs(spark)
    found = {r["doc_id"]: r["group_id"] for r in similar.groups(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    print("jobs", jobs(spark) - at)
    assert set(found.values()) < set(found)
    assert jobs(spark) - at <= 60

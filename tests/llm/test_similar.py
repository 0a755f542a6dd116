"""Groups of near copies against all pairs' Jaccard similarity, around the similarity asked for."""

import random

import pytest

from tickloom.llm import similar


def shingles(text):
    parts = text.lower().split()
    return {tuple(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()


def brute(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    root, links = {i: i for i in sets}, 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, links


def copies(seed):
    """Pairs of texts with a few words replaced: similarities from about 0.6 to 0.95, most near 0.8; short ones too."""
    r, out = random.Random(seed), {}
    for k in range(150):
        words = [f"w{r.randrange(5000)}" for _ in range(r.choice((8, 9, 20, 60, 150, 400)))]
        out[2 * k] = " ".join(words)
        for _ in range(max(1, round(len(words) * r.choice((0.005, 0.02, 0.022, 0.024, 0.03, 0.04))))):
            words[r.randrange(len(words))] = f"x{r.randrange(5000)}"
        out[2 * k + 1] = " ".join(words if r.random() < 0.8 else words[:-1])
    return out


@pytest.mark.parametrize("blocks", [similar.SET_BLOCK, 2])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, blocks):
    monkeypatch.setattr(similar, "SET_BLOCK", blocks)
    texts = copies(3)
    r = random.Random(9)
    base = [f"c{i}" for i in range(300)]
    for k in range(40):  # a group whose members are not all similar to each other
        own = list(base)
        for _ in range(r.randrange(1, 8)):
            own[r.randrange(300)] = f"y{r.randrange(9999)}"
        texts[1000 + k] = " ".join(own)
    wanted, links = brute(texts)
    found = {r["doc_id"]: r["group_id"] for r in similar.groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert links > 50 and found == wanted


def test_groups_at_the_bound(spark):
    """Four of five shingles are 0.8; seven of nine are less."""
    a = "a b c d e f g h"
    texts = {1: a, 2: a + " i", 3: "k l m n o p q r s t u v", 4: "k l m n o p q r s t u x y"}
    found = {r["doc_id"]: r["group_id"] for r in similar.groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert found == brute(texts)[0] == {1: 1, 2: 1, 3: 3, 4: 4}

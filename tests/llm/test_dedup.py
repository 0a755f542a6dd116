import hashlib
import random
import uuid
from collections import defaultdict

import numpy as np
import pytest

from tickloom.llm import components, exact_dedup, similar, simhash, substring


def collected(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


# ---- exact ----------------------------------------------------------------------------------------


def exact_by_hand(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact(spark, odd, empty, documents):
    for frame in (odd, empty, documents):
        index = exact_dedup.DigestIndex(spark, f"d_{uuid.uuid4().hex}", 4)
        wanted = exact_by_hand([(r["doc_id"], r["text"]) for r in frame.collect()])
        assert collected(index.add(frame), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == wanted
        index.drop()
        assert not index.runs()


def test_index_grows_and_anti_joins(spark):
    index = exact_dedup.DigestIndex(spark, f"d_{uuid.uuid4().hex}", 4)
    one = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    two = spark.createDataFrame([(5, "a"), (6, "c"), (7, "c")], "doc_id long, text string")
    assert all(r["kept"] for r in index.add(one).collect())
    found = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in index.add(two).collect()}
    assert found == {5: (1, False), 6: (7, False), 7: (7, True)}
    assert index.entries().count() == 3
    with exact_dedup._sorted_scans(spark):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            plan = index.unseen(exact_dedup.groups_of(exact_dedup.with_digest(two)))._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
    joins = len(index.runs())
    assert plan.count("SortMergeJoin") == joins > 2 and plan.count("LeftAnti") == joins and plan.count("Bucketed: true") == joins
    # the new digests alone are sorted, once, and dealt by the buckets; no run is
    assert plan.count(" Sort [") == 1 and plan.count("Exchange") == 1


def test_index_merges_its_runs(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST_RUNS", 3)
    index = exact_dedup.DigestIndex(spark, f"d_{uuid.uuid4().hex}", 4)
    for k in range(4):
        index.add(spark.createDataFrame([(10 * k + i, f"t{(k + i) % 7}") for i in range(4)], "doc_id long, text string"))
        assert len(index.runs()) <= 4
    assert sorted(r["keep_id"] for r in index.entries().collect()) == [0, 1, 2, 3, 13, 23, 33]
    assert exact_dedup.DigestIndex(spark, index.name, 9).buckets == 4  # an index keeps the number it was made with
    index.drop()


def test_rows_without_copies_keep_their_columns(spark):
    """Columns of any name stay; of rows that repeat id and text one stays, the same in any order; null ids stay alone."""
    columns = "doc_id long, text string, own_id long, no_id string, row int, nth int, digest string"
    rows = [(1, "a", 7, "x", 1, 1, "d"), (2, "a", 8, None, 2, 2, "e"), (2, "a", 9, "z", 3, 3, None), (None, "b", 1, "y", 4, 4, "g"), (None, None, 1, "y", 5, 5, "g"), (3, "", 1, "y", 6, 6, "g")]
    out = []
    for order in (rows, rows[::-1]):
        index = exact_dedup.DigestIndex(spark, f"d_{uuid.uuid4().hex}", 4)
        kept = exact_dedup.without_copies(spark.createDataFrame(order, columns), index)
        index.drop()
        assert kept.columns == ["doc_id", "text", "own_id", "no_id", "row", "nth", "digest"]
        out.append(sorted(map(tuple, kept.collect()), key=repr))
    assert out[0] == out[1] and [(r[0], r[1]) for r in out[0]] == [(2, "a"), (3, ""), (None, "b")]


# ---- components -----------------------------------------------------------------------------------


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 105), (105, 103), (7, 7), (200, -5)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and found[105] == found[103] == found[100] == 100 and found[200] == found[-5] == -5 and 7 in found
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- SimHash --------------------------------------------------------------------------------------


def simhash_by_hand(text, words=4):
    import re

    import xxhash

    parts = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)] or [" ".join(parts)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def linked_by_hand(prints, most):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    own = sorted(root)
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            if (a ^ b).bit_count() <= most:
                root[find(a)] = find(b)
    return {p: find(p) for p in own}


def test_golay_keys():
    random_ = np.random.default_rng(2)
    x = random_.integers(0, 1 << 23, 4000).astype(np.int32)
    y = x.copy()
    for i in range(len(y)):
        for b in random_.choice(23, random_.integers(0, 3), replace=False):
            y[i] ^= 1 << int(b)
    a, b = simhash.codewords(x), simhash.codewords(y)
    assert set((a >= 0).sum(axis=1).tolist()) == {1, 6}
    assert all(set(p[p >= 0]) & set(q[q >= 0]) for p, q in zip(a, b))


def test_keys_meet_within_four_bits():
    random_ = np.random.default_rng(3)
    x = random_.integers(0, 1 << 63, 3000).astype(np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in random_.choice(64, 4, replace=False):
            y[i] ^= np.uint64(1 << int(b))
    assert all(set(p[p >= 0].tolist()) & set(q[q >= 0].tolist()) for p, q in zip(simhash.keys(x), simhash.keys(y)))


@pytest.mark.parametrize("which", ["odd", "empty", "documents"])
def test_near_duplicates(request, which):
    frame = request.getfixturevalue(which)
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    prints = [simhash_by_hand(t) for _, t in rows]
    root = linked_by_hand(set(prints), 4)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    wanted = sorted(((i, f"{p:016x}", least.get(root[p])) for (i, _), p in zip(rows, prints)), key=repr)
    assert collected(simhash.near_duplicates(frame), "doc_id", "fingerprint", "component_id") == wanted


def test_hot_keys_give_the_same_links(spark, monkeypatch):
    """A dense cluster, with so small a RUN that its keys go through the centres."""
    monkeypatch.setattr(simhash, "RUN", 4)
    random_ = random.Random(4)
    base = random_.getrandbits(64)
    prints = {base}
    for _ in range(60):
        p = base
        for b in random_.sample(range(64), random_.randint(1, 5)):
            p ^= 1 << b
        prints.add(p)
    prints |= {random_.getrandbits(64) for _ in range(20)}
    signed = [(int(np.uint64(p).astype(np.int64)),) for p in prints]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"))
    found = {r["node"]: r["root"] for r in components.components(edges).collect()}
    wanted = linked_by_hand(prints, 4)
    unsigned = lambda x: x & (1 << 64) - 1
    groups = defaultdict(set)
    for p in prints:
        groups[found.get(int(np.uint64(p).astype(np.int64)), p)].add(p)
    by_hand = defaultdict(set)
    for p, r in wanted.items():
        by_hand[r].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, by_hand.values())) and unsigned(-1) == 2**64 - 1


# ---- similarity of the pipeline's stage -----------------------------------------------------------


def edited(words, n, r):
    out = list(words)
    for i in r.sample(range(len(out)), n):
        out[i] = f"z{r.random()}"
    return out


def test_similar_groups(spark, odd, empty):
    r = random.Random(6)
    rows, groups = [], 60
    for g in range(groups):
        words = [f"{r.random():.6f}" for _ in range(300)]
        rows += [(3 * g, " ".join(words)), (3 * g + 1, " ".join(edited(words, 3, r))), (3 * g + 2, " ".join(f"{r.random():.6f}" for _ in range(300)))]
    found = {x["doc_id"]: x["group_id"] for x in similar.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(found[3 * g + 1] == 3 * g for g in range(groups)) >= 0.95 * groups
    assert all(found[3 * g + 2] == 3 * g + 2 for g in range(groups))
    own = {x["doc_id"]: x["group_id"] for x in similar.groups(odd).collect()}
    assert own[9] == 1 and own[6] == 5 and own[8] == 7 and own[3] == own[4] == 2 and None not in own
    assert similar.groups(empty).count() == 0


def test_similar_hot_keys(spark, monkeypatch):
    """Keys that are too large for one run, dealt to pairs of blocks, give the groups that plain comparison gives."""
    r = random.Random(7)
    words = [f"{r.random():.6f}" for _ in range(200)]
    rows = [(i, " ".join(edited(words, r.randint(0, 3), r))) for i in range(80)] + [(100 + i, " ".join(f"{r.random():.6f}" for _ in range(50))) for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    plain = collected(similar.groups(frame), "doc_id", "group_id")
    monkeypatch.setattr(similar, "RUN", 8)
    monkeypatch.setattr(similar, "BLOCK", 16)
    assert collected(similar.groups(frame), "doc_id", "group_id") == plain


# ---- substrings -----------------------------------------------------------------------------------


def substrings_by_hand(rows):
    import re

    cut = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in cut:
        for s in range(len(w) - 49):
            key, at = tuple(w[s : s + 50]), float("inf") if i is None else i
            first[key] = min(at, first.get(key, at))
    out = []
    for i, w in cut:
        gone = set()
        for s in range(len(w) - 49):
            if first[tuple(w[s : s + 50])] < (float("inf") if i is None else i):
                gone |= set(range(s, s + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_cover_meets_every_difference():
    for a in range(substring.PERIOD):
        for b in range(substring.PERIOD):
            assert any((a + t) % substring.PERIOD in substring.COVER and (b + t) % substring.PERIOD in substring.COVER for t in range(substring.PERIOD))


@pytest.mark.parametrize("which", ["odd", "empty", "documents", "planted"])
@pytest.mark.parametrize("chunk", [1 << 20, 64])
def test_substrings(request, spark, which, chunk, monkeypatch):
    monkeypatch.setattr(substring, "CHUNK", chunk)
    if which == "planted":
        r = random.Random(8)
        word = lambda: f"{r.randrange(4000)}"
        passage = [word() for _ in range(70)]
        rows = []
        for i in range(40):
            own = [word() for _ in range(r.randint(0, 160))]
            n = r.choice((0, 49, 50, 51, 70))
            at, cut = r.randint(0, len(own)), r.randint(0, 70 - n)
            rows.append((i, r.choice(("  ", " ", "\n")).join(own[:at] + passage[cut : cut + n] + own[at:])))
        frame = spark.createDataFrame(rows, "doc_id long, text string")
    else:
        frame = request.getfixturevalue(which)
    if which == "documents" and chunk == 64 or which == "odd" and chunk == 64:
        pytest.skip("one chunk size is enough for the large ones")
    wanted = substrings_by_hand([(r["doc_id"], r["text"]) for r in frame.collect()])
    assert collected(substring.repeated_passages(frame), "doc_id", "n_words", "n_removed", "kept_sha256") == wanted


def test_without_repeats_keeps_columns(odd):
    found = substring.without_repeats(odd)
    assert found.columns == odd.columns and found.count() == odd.count()
    texts = {r["key"]: r["text"] for r in found.collect()}
    assert texts[1] is None and texts[0] == "a b c" and texts[5] == "" and texts[7] == "tail"

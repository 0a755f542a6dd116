"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. A segment decodes to the codeword of the
perfect (23, 12, 7) Golay code nearest to it and, where three bits had to be mended, also to the five
codewords at distance four: one or six indices, such that two segments within two bits share an index.

Up to four differing bits spread over the three segments in one of these ways, errors sorted:
(0, <=1, any), (0, 2, 2), (1, 1, <=2). Each way has keys that both fingerprints of such a pair carry:

* an error-free segment exactly, and an error-free half of another (one error leaves one half whole);
* an error-free segment exactly, and a Golay index of the next;
* an error-free half of each of two segments, and a Golay index of the third.

Every key is 34 bits or more, so chance meetings stay rare. Fingerprints that meet are compared exactly.
A key that more than RUN fingerprints carry is not compared pair by pair: its members are joined through
all values within two bits of them, since two values within four bits share such a centre, and any two
that share one are within four. This is exact, and linear in the members.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import checkpoint, id_text, map_rows
from tickloom.llm.components import components

#: Generator polynomial of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0xAE3
#: (lowest bit, bits) of the segments; and of the lower half of each.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
RUN = 256
MAX_BITS = 4


# ---- fingerprints ---------------------------------------------------------------------------------


def fingerprint(text: str | None, words: int = 4) -> int:
    """The SimHash of one text, as an unsigned number."""
    import xxhash

    parts = (text or "").encode().lower().split()  # bytes: only A-Z, and only white space of ASCII
    if not parts:
        return 0
    if len(parts) < words:
        return xxhash.xxh64_intdigest(b" ".join(parts), 42)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    joined = b" ".join(parts)
    firsts = np.concatenate(([0], ends[: -words]))
    cuts = map(joined.__getitem__, map(slice, firsts.tolist(), (ends[words - 1 :] - 1).tolist()))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, cuts, repeat(42)), np.uint64, len(firsts))
    over = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        over += np.unpackbits(hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(over * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long) of every row; null texts are empty."""

    def of(part: pa.RecordBatch) -> dict:
        found = np.array([fingerprint(t, words) for t in part.column("text").to_pylist()], np.uint64)
        return {"doc_id": part.column("doc_id"), "fp": found.view(np.int64)}

    return map_rows(id_text(docs), "text", of, "doc_id long, fp long")


# ---- the Golay code -------------------------------------------------------------------------------


@cache
def _code() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits; for each syndrome up to six error patterns, -1 if fewer."""
    unit = []
    for bit in range(23):
        value = 1 << bit
        for top in range(22, 10, -1):
            if value >> top & 1:
                value ^= GENERATOR << (top - 11)
        unit.append(value)

    def table(first: int, bits: int) -> np.ndarray:
        out = np.zeros(1 << bits, np.int32)
        for k in range(bits):
            out[1 << k : 2 << k] = out[: 1 << k] ^ unit[first + k]
        return out

    patterns = np.full((2048, 6), -1, np.int32)
    filled = np.zeros(2048, int)
    weight = np.zeros(2048, int)
    for w in range(5):
        for bits in combinations(range(23), w):
            s = 0
            for b in bits:
                s ^= unit[b]
            if w < 4 or weight[s] == 3:
                patterns[s, filled[s]] = sum(1 << b for b in bits)
                filled[s] += 1
                weight[s] = w if w < 4 else 3
    return table(0, 12), table(12, 11), patterns


@cache
def codebook() -> np.ndarray:
    """The 4096 codewords, by index."""
    low, high, _ = _code()
    index = np.arange(1 << 12, dtype=np.int32) << 11
    syndrome = low[index & 0xFFF] ^ high[index >> 12]  # of the index alone: what the low 11 bits must mend
    return index | syndrome


def codewords(segment: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords near each 23-bit value: six columns, -1 where there are fewer."""
    low, high, patterns = _code()
    found = patterns[low[segment & 0xFFF] ^ high[segment >> 12]]
    return np.where(found < 0, -1, (segment[:, None] ^ found) >> 11)


def keys(fp: np.ndarray) -> np.ndarray:
    """All keys of the fingerprints (uint64): a row for each, -1 where a key is lacking."""
    segments = [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    halves = [(s & ((1 << n // 2) - 1), s >> (n // 2)) for s, (_, n) in zip(segments, SEGMENTS)]
    golay = [codewords(s.astype(np.int32)).astype(np.int64) for s in segments]
    out, kind = [], 0

    def add(columns: np.ndarray, lacking: np.ndarray | None = None) -> None:
        nonlocal kind
        value = columns | (kind << 48)
        out.append(value if lacking is None else np.where(lacking, -1, value))
        kind += 1

    for i in range(3):
        for j in range(3):
            if i != j:
                for half in halves[j]:
                    add((segments[i] << 12 | half)[:, None])
        j = (i + 1) % 3
        add(segments[i][:, None] << 12 | golay[j], golay[j] < 0)
        a, b = (x for x in range(3) if x != i)
        for x in halves[a]:
            for y in halves[b]:
                add((x << 12 | y)[:, None] << 12 | golay[i], golay[i] < 0)
    return np.concatenate(out, axis=1)


# ---- links ----------------------------------------------------------------------------------------


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            fp = batch.column(0).slice(at, 4096).to_numpy()
            found = keys(fp.view(np.uint64))
            has = found >= 0
            yield pa.RecordBatch.from_arrays([pa.array(found[has]), pa.array(np.repeat(fp, has.sum(axis=1)))], names=["key", "fp"])


def _labels(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest connected index of each of `size` indices."""
    label = np.arange(size)
    while True:
        old = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        np.minimum.at(label, old, label)
        label = label[label]
        if (label == old).all():
            return label


def _compare(max_bits: int):
    """Sorted (key, fp) -> (a, b, hot): within each key, every member that has a link and the least it is linked to through members of the key; for keys with over RUN members (fp, fp, 1)."""

    def settle(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1)) if len(key) else np.array([], int)
        sizes = np.diff(np.append(starts, len(key)))
        hot = np.repeat(sizes > RUN, sizes)
        hot_fp = fp[hot]
        key, fp = key[~hot], fp[~hot]
        bits, left, right = fp.view(np.uint64), [], []
        for step in range(1, min(RUN, int(sizes[sizes <= RUN].max(initial=1)))):
            near = np.flatnonzero((key[step:] == key[:-step]) & (np.bitwise_count(bits[step:] ^ bits[:-step]) <= max_bits))
            left.append(near)
            right.append(near + step)
        a, b = (np.concatenate(x) if x else np.array([], int) for x in (left, right))
        label = _labels(len(fp), a, b)
        moved = np.flatnonzero(label != np.arange(len(fp)))
        pairs = np.unique(np.stack([fp[moved], fp[label[moved]]], axis=1), axis=0) if len(moved) else np.empty((0, 2), np.int64)
        hot_fp = np.unique(hot_fp)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([pairs[:, 0], hot_fp])), pa.array(np.concatenate([pairs[:, 1], hot_fp])), pa.array(np.repeat(np.int32([0, 1]), [len(pairs), len(hot_fp)]))], names=["a", "b", "hot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, over = np.array([], np.int64), np.array([], np.int64), None
        for batch in batches:
            new_key, new_fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if over is not None:  # goes on with a key that is known to be hot: its rows need not be held
                same = int(np.searchsorted(new_key, over, side="right"))
                if same:
                    yield pa.RecordBatch.from_arrays([pa.array(new_fp[:same]), pa.array(new_fp[:same]), pa.array(np.ones(same, np.int32))], names=["a", "b", "hot"])
                    new_key, new_fp = new_key[same:], new_fp[same:]
                if not len(new_key):
                    continue
                over = None
            key, fp = np.concatenate([key, new_key]), np.concatenate([fp, new_fp])
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if len(key) - last > RUN:
                over, last = key[-1], len(key)
            if last:
                yield settle(key[:last], fp[:last])
                key, fp = key[last:], fp[last:]
        yield settle(key, fp)

    return run


@cache
def _masks() -> np.ndarray:
    """All 64-bit values with at most two bits set."""
    one = [1 << i for i in range(64)]
    return np.array([0, *one, *(a | b for a, b in combinations(one, 2))], np.uint64)


def _centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            fp = batch.column(0).slice(at, 256).to_numpy()
            centre = (fp.view(np.uint64)[:, None] ^ _masks()[None, :]).reshape(-1)
            owner = np.repeat(fp, len(_masks()))
            order = np.lexsort((owner, centre))
            centre, owner = centre[order], owner[order]
            first = np.concatenate(([True], centre[1:] != centre[:-1]))
            least = owner[first][np.cumsum(first) - 1]
            more = owner != least  # members of this slice are linked here; one row goes on for each centre
            linked = np.unique(np.stack([owner[more], least[more]], axis=1), axis=0) if more.any() else np.empty((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([centre[first].view(np.int64), linked[:, 0]])), pa.array(np.concatenate([owner[first], linked[:, 1]])), pa.array(np.repeat(np.int32([0, 1]), [int(first.sum()), len(linked)]))], names=["a", "b", "linked"])


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) among distinct fingerprints `fp` whose components are those of all links within MAX_BITS."""
    cells = distinct.mapInArrow(_expand, "key long, fp long")
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = checkpoint(cells.repartition(parts, "key").sortWithinPartitions("key", "fp").mapInArrow(_compare(MAX_BITS), "a long, b long, hot int").distinct())
    spread = checkpoint(met.where("hot = 1").select(F.col("a").alias("fp")).mapInArrow(_centres, "a long, b long, linked int"))
    around = spread.where("linked = 0").groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.count(F.lit(1)).alias("n"))
    shared = around.where("low <> high")
    through = spread.where("linked = 0").join(shared.select("a", "low"), "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return met.where("hot = 0").select("a", "b").unionByName(spread.where("linked = 1").select("a", "b")).unionByName(through).distinct()


def near_duplicates(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fingerprint, component_id of every row.

    component_id is the smallest doc_id that can be reached over fingerprints within MAX_BITS, itself
    included. A null or blank text has fingerprint zero and is linked like any other. Null ids are passed
    over when the smallest is sought, so a component of null ids alone has a null component_id. Rows that
    repeat an id keep a row each. An empty table gives an empty result.
    """
    prints = checkpoint(fingerprints(docs, words))
    nodes = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = checkpoint(components(links(nodes.select("fp"))))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    # both sides come straight from a shuffle, so that adaptive execution can split a hot root
    named = checkpoint(placed.groupBy("root").agg(F.min("least").alias("component_id")))
    labels = checkpoint(placed.join(named, "root").select("fp", "component_id"))
    return prints.join(labels.hint("merge"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

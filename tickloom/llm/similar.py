"""SimHash near copies of a stated Jaccard similarity: Golay-code fuzzy hashing with soft decoding, then exact comparison.

The operator of simhash.py for similarities at which fingerprints differ in more bits than pigeonholing of
hard bits bears: at a Jaccard similarity of 0.8 a share arccos(2s / (1 + s)) / pi = 15 % of all bits differ.
A text's SimHash sums say how sure each bit is, so its three segments of 23 bits are decoded softly: to the
NEAR codewords of the Golay code that agree best with the sums. Of two of the three segments (whichever is
the worst is left out, as pigeonholing has it) the BEST pairs of codeword indices by their joint agreement
are keys: 3 x 32 keys of 24 bits, under which 99.5 % of the pairs at 0.8 meet, and nearly all from 0.85.

Documents that meet are compared by 128 fingerprint bits. SIEVE standard deviations on top of the mean are
let through, which a pair at 0.8 exceeds with a chance of 0.2 %. What passes makes loose groups; within
each, the sets of shingles themselves are compared, and only pairs of the similarity asked for are links.

A key or a loose group of any size is joined to its smallest document first. Only documents that this does
not reach meet all others, dealt in blocks of bounded size, so a dense group takes a time that grows with
its members and no task holds all of it. Tasks return spanning forests, never their pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import checkpoint, id_text, map_rows
from tickloom.llm.components import components
from tickloom.llm.simhash import _labels, codebook

#: Codewords that a segment is decoded to; keys of each two segments.
NEAR, BEST = 12, 32
SEGMENT, SEGMENTS = 23, 3
BITS = 128
#: Standard deviations of the number of differing bits that are allowed on top of the mean.
SIEVE = 3.0
#: Documents of a key up to which one task compares them, and of a block of a larger key.
RUN = 2048
BLOCK = 4096
#: Runs up to here are compared by shifting all rows of a batch at once, longer ones each for itself.
SHORT = 24
#: Documents, and shingles, of a block of a loose group.
SET_BLOCK = 512
SET_SHINGLES = 500_000
#: Links up to which one task finds the groups (some 100 MB); more take rounds of joins until they are as few.
LINKS = 500_000
PRINTS = ["fa", "fb"]
COLUMNS = ["key", "id", *PRINTS]
EDGE = "a long, b long, hot int"


# ---- shingles, fingerprints, keys -----------------------------------------------------------------


def most_bits(similarity: float, margin: float = SIEVE, bits: int = BITS) -> int:
    """Differing bits up to which two documents may have this Jaccard similarity."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * share + margin * math.sqrt(bits * share * (1 - share)))


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; a text of fewer words is one shingle; none without words."""
    import xxhash

    parts = (text or "").encode().lower().split()
    if not parts:
        return np.array([], np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    firsts = np.concatenate(([0], ends[:-words]))
    cuts = map(joined.__getitem__, map(slice, firsts.tolist(), (ends[words - 1 :] - 1).tolist()))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, cuts, repeat(42)), np.uint64, len(firsts)))


def sums(hashes: np.ndarray) -> np.ndarray:
    """SimHash sums of BITS bits: by how much the set bits outnumber the others, in parts of the root of the set's size."""
    out, h = [], hashes
    for _ in range(BITS // 64):
        over = np.zeros(64, np.int64)
        for at in range(0, len(h), 8192):
            over += np.unpackbits(h[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(2 * over - len(h))
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(32)
    return np.concatenate(out) / math.sqrt(max(1, len(hashes)))


@cache
def _signs() -> np.ndarray:
    """The codewords of the Golay code as columns of -1 and 1, by index."""
    return (((codebook()[None, :] >> np.arange(SEGMENT)[:, None]) & 1) * 2 - 1).astype(np.float32)


def keys(soft: np.ndarray) -> np.ndarray:
    """Keys (int32) of each row of sums of SEGMENTS * SEGMENT bits."""
    index, score = [], []
    for k in range(SEGMENTS):
        agree = soft[:, k * SEGMENT : (k + 1) * SEGMENT].astype(np.float32) @ _signs()
        near = np.argpartition(-agree, NEAR, axis=1)[:, :NEAR]
        index.append(near.astype(np.int32))
        score.append(np.take_along_axis(agree, near, 1))
    out = []
    for kind, (i, j) in enumerate(combinations(range(SEGMENTS), 2)):
        joint = (score[i][:, :, None] + score[j][:, None, :]).reshape(len(soft), -1)
        key = (index[i][:, :, None] << 12 | index[j][:, None, :]).reshape(len(soft), -1) | kind << 24
        out.append(np.take_along_axis(key, np.argpartition(-joint, BEST, axis=1)[:, :BEST], 1))
    return np.concatenate(out, axis=1)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, fa, fb) for every key of every row with words."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            soft = np.frombuffer(b"".join(part.column("soft").to_pylist()), np.int8).reshape(-1, SEGMENTS * SEGMENT)
            found = keys(soft)
            own = [np.repeat(part.column(c).to_numpy(), found.shape[1]) for c in COLUMNS[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(found.reshape(-1)), *map(pa.array, own)], names=COLUMNS)


# ---- the sieve ------------------------------------------------------------------------------------


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, which stand along the first axis."""
    return sum(np.bitwise_count(x ^ y).astype(np.int16) for x, y in zip(a, b))


def _dense(fp: np.ndarray, rows: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, within `most` bits, i in the first `rows`."""
    left, right = [np.array([], int)], [np.array([], int)]
    for a in range(0, rows, 256):
        i, j = np.nonzero(_near(fp[:, a : min(a + 256, rows), None], fp[:, None, a:]) <= most)
        left.append(i[i < j] + a)
        right.append(j[i < j] + a)
    return np.concatenate(left), np.concatenate(right)


def _meet(fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links whose components are those of all links: of the first with all, then of those that it doesn't reach with all."""
    reached = _near(fp, fp[:, :1]) <= most
    order = np.concatenate((np.flatnonzero(~reached), np.flatnonzero(reached)))
    left, right = _dense(fp[:, order], len(fp[0]) - int(reached.sum()), most)
    hub = np.flatnonzero(reached)
    return np.concatenate((hub, order[left])), np.concatenate((np.zeros(len(hub), int), order[right]))


def _forest(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    """(a, b, hot): each id that is linked to a smaller one, and the smallest of its own here; ids in any order, repeated ones too."""
    own, place = np.unique(ids, return_inverse=True)
    label = _labels(len(own), place[left], place[right]) if len(left) else np.arange(len(own))
    moved = np.flatnonzero(label != np.arange(len(own)))
    return pa.RecordBatch.from_arrays([pa.array(own[moved]), pa.array(own[label[moved]]), pa.array(np.zeros(len(moved), np.int32))], names=["a", "b", "hot"])


def _compare(most: int):
    """Sorted cells -> (a, b, hot): a forest of links; and (key, key, 1) for keys with over RUN rows."""

    def settle(key, ids, *prints) -> pa.RecordBatch:
        starts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1))
        sizes = np.diff(np.append(starts, len(key)))
        fp, left, right = np.stack(prints).view(np.uint64), [np.array([], int)], [np.array([], int)]
        short = np.repeat(sizes <= SHORT, sizes)
        for step in range(1, min(SHORT, int(sizes.max()))):
            meets = np.flatnonzero((key[step:] == key[:-step]) & short[step:])
            near = meets[_near(fp[:, meets], fp[:, meets + step]) <= most]
            left.append(near)
            right.append(near + step)
        for s, n in zip(starts[sizes > SHORT].tolist(), sizes[sizes > SHORT].tolist()):
            i, j = _meet(fp[:, s : s + n], most)
            left.append(i + s)
            right.append(j + s)
        return _forest(ids, np.concatenate(left), np.concatenate(right))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.array([], np.int64)] * len(COLUMNS)
        over = None
        for batch in batches:
            new = [batch.column(c).to_numpy() for c in COLUMNS]
            if over is not None:  # the rest of a key that is known to be hot
                same = int(np.searchsorted(new[0], over, side="right"))
                new = [c[same:] for c in new]
                if not len(new[0]):
                    continue
                over = None
            held = [np.concatenate(pair) for pair in zip(held, new)]
            if not len(held[0]):
                continue
            last = int(np.searchsorted(held[0], held[0][-1]))
            if len(held[0]) - last > RUN:
                over = int(held[0][-1])
                yield pa.RecordBatch.from_arrays([pa.array([over]), pa.array([over]), pa.array([1], pa.int32())], names=["a", "b", "hot"])
                if last:
                    yield settle(*(c[:last] for c in held))
                held = [np.array([], np.int64)] * len(COLUMNS)
            elif last:
                yield settle(*(c[:last] for c in held))
                held = [c[last:] for c in held]
        if len(held[0]):
            yield settle(*held)

    return run


def _tasks(columns: list[str], settle):
    """Rows sorted by `task` -> what settle makes of the columns of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = [], None
        for batch in batches:
            task = batch.column("task").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(task)) + 1).tolist(), len(task)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if own is not None and task[a] != own:
                    yield settle(*(pa.chunked_array([x.column(c) for x in held]).combine_chunks() for c in columns))
                    held = []
                own = task[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield settle(*(pa.chunked_array([x.column(c) for x in held]).combine_chunks() for c in columns))

    return run


def _deal(rows: DataFrame, group: str, columns: list[str], parts: int) -> DataFrame:
    """Of rows with `group`, id, blocks, rest_blocks, rest: for each block of a group and each block of those of it that are still to be reached, a task with both."""
    own = rows.withColumn("_own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = own.withColumn("_rest", every("rest_blocks")).withColumn("rest", F.lit(0))
    rest = own.where("rest = 1").withColumn("_rest", F.pmod(F.xxhash64("id"), "rest_blocks").cast("int")).drop("_own").withColumn("_own", every("blocks"))
    dealt = base.select(group, "_own", "_rest", "rest", *columns).unionByName(rest.select(group, "_own", "_rest", "rest", *columns))
    return dealt.select(F.xxhash64(group, "_own", "_rest").alias("task"), "rest", *columns).repartition(parts, "task").sortWithinPartitions("task")


def _hot_links(cells: DataFrame, hot: DataFrame, most: int, parts: int) -> DataFrame:
    """Links among the documents of hot keys: with each key's smallest document, then of those that it doesn't reach with all."""
    own = checkpoint(cells.join(hot, "key"))
    hubs = checkpoint(own.groupBy("key").agg(F.min(F.struct("id", *PRINTS)).alias("hub"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")))
    differ: Column = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"hub.{c}"))) for c in PRINTS[1:]), F.bit_count(F.col(PRINTS[0]).bitwiseXOR(F.col(f"hub.{PRINTS[0]}"))))
    near = checkpoint(own.join(hubs.hint("merge"), "key").withColumn("rest", (differ > most).cast("int")))
    reached = near.where("rest = 0").select(F.col("id").alias("a"), F.col("hub.id").alias("b"))
    left = checkpoint(near.where("rest = 1").groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("rest_blocks")))

    def settle(ids, rest, *prints) -> pa.RecordBatch:
        order = np.argsort(1 - rest.to_numpy(), kind="stable")
        fp = np.stack([p.to_numpy().view(np.uint64) for p in prints])[:, order]
        return _forest(ids.to_numpy()[order], *_dense(fp, int(rest.to_numpy().sum()), most))

    dealt = _deal(near.join(left.hint("merge"), "key"), "key", ["id", *PRINTS], parts)
    return reached.unionByName(dealt.mapInArrow(_tasks(["id", "rest", *PRINTS], settle), EDGE).select("a", "b")).distinct()


# ---- the judge ------------------------------------------------------------------------------------


def _spanning(sets: list[np.ndarray], similarity: float) -> tuple[list, list]:
    """Links (i, j) that join all sets which pairs of this Jaccard similarity join; each set is compared with all that aren't reached yet."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1)
    ends = np.cumsum(sizes)
    mine = np.zeros(int(flat.max()) + 1, bool)
    rest, shingles, left, right, queue = np.arange(len(sets)), flat, [], [], []
    while len(rest):
        now = queue.pop() if queue else int(rest[0])
        own = flat[ends[now] - sizes[now] : ends[now]]
        mine[own] = True
        size = sizes[rest]
        common = np.add.reduceat(mine[shingles], np.cumsum(size) - size, dtype=np.int64)
        mine[own] = False
        near = common >= similarity * (size + sizes[now] - common) - 1e-9
        found = rest[near]
        left += [now] * len(found)
        right += found.tolist()
        queue += found[found != now].tolist()
        shingles, rest = shingles[np.repeat(~near, size)], rest[~near]
    return left, right


def _judge(similarity: float):
    """ids and hashes of a task -> a forest of the links that hold."""

    def settle(ids, hashes) -> pa.RecordBatch:
        left, right = _spanning([np.frombuffer(x, np.uint64) for x in hashes.to_pylist()], similarity)
        return _forest(ids.to_numpy(), np.array(left, int), np.array(right, int))

    return _tasks(["id", "hashes"], settle)


def _true_links(known: DataFrame, nodes: DataFrame, loose: DataFrame, words: int, similarity: float, parts: int) -> DataFrame:
    """Links within loose groups (node, root) whose sets of shingles have the similarity.

    Groups of one block are compared at once. Of larger ones each block is compared with the root; then
    those that aren't joined to the root with all blocks.
    """
    members = checkpoint(nodes.select(F.col("id").alias("node"), "size").join(loose, "node").groupBy("node", "root").agg(F.sum("size").alias("size")))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / SET_BLOCK, F.sum("size") / SET_SHINGLES)).cast("int")
    # written first, so that both sides come straight from a shuffle, and nothing above the join that needs its partitioning: a hot root can be split
    sizes = checkpoint(members.groupBy("root").agg(blocks.alias("blocks")))
    placed = checkpoint(members.join(sizes.hint("merge"), "root").select("node", "root", "blocks"))

    def of(part: pa.RecordBatch) -> dict:
        return {c: part.column(c) for c in ("id", "root", "blocks")} | {"hashes": [shingle_hashes(t, words).tobytes() for t in part.column("text").to_pylist()]}

    texts = known.join(placed, known.doc_id == placed.node).select(F.col("node").alias("id"), "root", "blocks", "text")
    own = checkpoint(map_rows(texts, "text", of, "id long, root long, blocks int, hashes binary").where("length(hashes) > 0"))
    first = own.withColumn("_own", F.when(F.col("id") == F.col("root"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), "blocks").cast("int")))).withColumn("_own", F.explode("_own"))
    judge = _judge(similarity)
    dealt = first.select(F.xxhash64("root", "_own").alias("task"), "id", "hashes").repartition(parts, "task").sortWithinPartitions("task")
    found = checkpoint(dealt.mapInArrow(judge, EDGE).select("a", "b").distinct())
    large = placed.where("blocks > 1")
    if not large.limit(1).count():
        return found
    reached = components(found, at_once=LINKS).withColumnRenamed("root", "mark")
    marks = checkpoint(large.join(reached, "node", "left").select("node", "root", "blocks", F.coalesce("mark", "node").alias("mark")))
    hub = checkpoint(marks.where("node = root").select("root", F.col("mark").alias("hub")))
    split = checkpoint(marks.join(hub.hint("merge"), "root").select("node", "root", "blocks", (F.col("mark") != F.col("hub")).cast("int").alias("rest")))
    left = checkpoint(split.where("rest = 1").groupBy("root").agg(F.ceil(F.count(F.lit(1)) / SET_BLOCK).cast("int").alias("rest_blocks")))
    again = own.select("id", "hashes").join(split.join(left.hint("merge"), "root").withColumnRenamed("node", "id"), "id")
    return found.unionByName(_deal(again, "root", ["id", "hashes"], parts).mapInArrow(judge, EDGE).select("a", "b")).distinct()


def groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id and group_id (the smallest doc_id of the group) of every row with an id.

    Documents whose sets of shingles of `words` words have this Jaccard similarity or more are linked; links
    make groups. Texts without words are one group. Rows without an id are left out; rows that repeat an id
    share its row of the smallest group. An empty table gives an empty result.
    """
    most = most_bits(similarity)

    def of(part: pa.RecordBatch) -> dict:
        import xxhash

        sets = [shingle_hashes(t, words) for t in part.column("text").to_pylist()]
        found = np.array([sums(h) for h in sets]).reshape(-1, BITS)
        prints = np.packbits(found > 0, axis=1, bitorder="little").view("<i8")
        digests = np.array([divmod(xxhash.xxh3_128_intdigest(h.tobytes()), 1 << 64) for h in sets], np.uint64).reshape(-1, 2).view(np.int64)
        soft = np.clip(np.rint(found[:, : SEGMENTS * SEGMENT] * 32), -127, 127).astype(np.int8)
        return {"doc_id": part.column("doc_id"), "fa": prints[:, 0], "fb": prints[:, 1], "da": digests[:, 0], "db": digests[:, 1], "size": list(map(len, sets)), "soft": [s.tobytes() for s in soft]}

    known = id_text(docs).where("doc_id is not null")
    prints = checkpoint(map_rows(known, "text", of, "doc_id long, fa long, fb long, da long, db long, size int, soft binary"))
    # rows of equal digests are equal in all but the id
    nodes = checkpoint(prints.groupBy("da", "db").agg(F.min("doc_id").alias("id"), *(F.first(c).alias(c) for c in (*PRINTS, "size", "soft"))))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = nodes.where("size > 0").select("id", *PRINTS, "soft").mapInArrow(_cells, "key int, id long, fa long, fb long")
    met = checkpoint(cells.repartition(parts, "key").sortWithinPartitions("key", "id").mapInArrow(_compare(most), EDGE).distinct())
    edges = met.where("hot = 0").select("a", "b")
    hot = met.where("hot = 1").select(F.col("a").cast("int").alias("key"))
    if hot.limit(1).count():
        edges = edges.unionByName(_hot_links(cells, hot, most, parts))
    roots = components(_true_links(known, nodes, components(edges, at_once=LINKS), words, similarity, parts), at_once=LINKS)
    named = nodes.join(roots, nodes.id == roots.node, "left").select("da", "db", F.coalesce("root", "id").alias("group_id"))
    return prints.select("doc_id", "da", "db").join(named.hint("merge"), ["da", "db"]).groupBy("doc_id").agg(F.min("group_id").alias("group_id"))

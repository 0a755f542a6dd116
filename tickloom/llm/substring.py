"""Substring deduplication by difference-cover anchors.

A window is WINDOW consecutive words. COVER is a difference cover modulo PERIOD: for any two places at
which the same window stands, some shift below PERIOD takes both to positions that are in COVER modulo
PERIOD. So it is enough to hash the ANCHOR words that begin at such positions; every window that two
documents share holds an anchor that both have hashed, since ANCHOR + PERIOD - 1 = WINDOW. Anchors that
only one document has are dropped; the others are extended: windows around a shared anchor are hashed in
full (96 bits), and those that a smaller document has too are hits.

Both groupings combine in the task before the one shuffle that each takes: a task works on its rows in
chunks of bounded size; where a chunk alone shows that a hash is shared, its documents are told so
directly, and one row stands for them in the shuffle. So a passage that a third of all documents share
costs one row a chunk, and no pair of documents is ever formed. The shuffle of the texts by document is
the same for both joins and is made once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import LAST_ID, id_text, slices

WINDOW = 50
PERIOD = 31
#: A perfect difference set modulo 31: every difference occurs once.
COVER = (0, 1, 3, 8, 12, 18)
ANCHOR = WINDOW - PERIOD + 1
#: Odd multipliers of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Hashes that a chunk holds before it is combined.
CHUNK = 1 << 20


def split_words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ in UTF-8 (bytes.split knows just that white space)."""
    return (text or "").encode().split()


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits (the finalizer of a 64-bit hash)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Rolling:
    """Hashes of spans of bytes by prefix sums modulo 2^64; every byte counts as a mixed value."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)
        self.value = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))

    def spans(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(raw) + 1
        if len(self.up) < n:
            self.up, self.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(2 * n, b, np.uint64))), dtype=np.uint64) for b in (self.base, self.inverse))
        total = np.zeros(n, np.uint64)
        np.cumsum(self.value[raw] * self.up[: n - 1], dtype=np.uint64, out=total[1:])
        return _mixed((total[ends] - total[starts]) * self.down[starts])


class _Hasher:
    """Hashes of runs of words: of the words joined by one space, so what parts them doesn't matter."""

    def __init__(self):
        self.rolling = [_Rolling(b) for b in BASES]

    def runs(self, words: list[bytes], starts: np.ndarray, n: int, which: int = 0) -> np.ndarray:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        firsts = np.concatenate((np.zeros(1, np.int64), ends[:-1] + 1))
        return self.rolling[which].spans(np.frombuffer(b" ".join(words), np.uint8), firsts[starts], ends[starts + n - 1]).view(np.int64)

    def anchors(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the cover and the hashes of the anchors there."""
        last = len(words) - ANCHOR
        at = (np.arange(0, last + 1, PERIOD)[:, None] + np.array(COVER)[None, :]).reshape(-1)
        at = at[at <= last]
        return at, self.runs(words, at, ANCHOR)


def _around(anchors: np.ndarray, n_words: int) -> np.ndarray:
    """Starts of the windows that hold a whole anchor at one of the positions."""
    opened = np.zeros(n_words + 2, np.int32)
    np.add.at(opened, np.maximum(anchors - (WINDOW - ANCHOR), 0), 1)
    np.add.at(opened, np.minimum(anchors, n_words - WINDOW) + 1, -1)
    return np.flatnonzero(np.cumsum(opened)[: n_words - WINDOW + 1] > 0)


def _first_of(keys: list[np.ndarray]) -> np.ndarray:
    """Of sorted columns, whether a row differs from the one before."""
    out = np.ones(len(keys[0]), bool)
    if len(out) > 1:
        out[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return out


def _chunked(batches: Iterator[pa.RecordBatch], column: str, hashes: Callable, tell: Callable, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Gather (hashes..., doc) of the rows up to CHUNK, sort out what repeats, and let `tell` make the rows to send."""
    held, size = [], 0

    def combined() -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held)]
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        once = _first_of(columns)
        h, *more, doc, known = tell([c[once] for c in columns])
        to, known_h = np.where(known == 1, _mixed(doc.view(np.uint64)).view(np.int64), h), np.where(known == 1, h, 0)
        together = np.argsort(doc, kind="stable")  # a document's rows one after another: the shuffle packs them better
        return pa.RecordBatch.from_arrays([pa.array(c[together]) for c in (to, known_h, *more, doc, known)], names=names)

    hasher = _Hasher()
    for part in slices(batches, column):
        for row in zip(*(part.column(c).to_pylist() for c in part.schema.names)):
            found = hashes(hasher, dict(zip(part.schema.names, row)))
            if found is not None and len(found[0]):
                held.append(found)
                size += len(found[0])
                if size >= CHUNK:
                    yield combined()
                    held, size = [], 0
    if held:
        yield combined()


def _groups(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First row of each group, and its size for every row."""
    first = np.flatnonzero(_first_of(keys))
    sizes = np.diff(np.append(first, len(keys[0])))
    return first, np.repeat(sizes, sizes)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(to, h, doc, known): known 1 tells a document that it shares h; 0 asks, for all documents of the chunk.

    Rows go to the partition of `to`: of the document where known, else the hash, and h is 0.
    """

    def hashes(hasher: _Hasher, row: dict) -> tuple | None:
        words = split_words(row["text"])
        if len(words) < WINDOW:
            return None
        _, h = hasher.anchors(words)
        return h, np.full(len(h), row["doc"], np.int64)

    def tell(columns: list[np.ndarray]) -> list[np.ndarray]:
        h, doc = columns
        first, size = _groups([h])
        many = size > 1
        return [np.concatenate((h[first], h[many])), np.concatenate((doc[first], doc[many])), np.repeat(np.int32([0, 1]), [len(first), int(many.sum())])]

    return _chunked(batches, "text", hashes, tell, ["to", "h", "doc", "known"])


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(to, h, h2, doc, known): known 1 tells a document that a smaller one has the window; 0 asks, for the smallest of the chunk."""

    def hashes(hasher: _Hasher, row: dict) -> tuple | None:
        words = split_words(row["in_text"])
        if len(words) < WINDOW:
            return None
        at, h = hasher.anchors(words)
        starts = _around(at[np.isin(h, np.array(row["shared"], np.int64))], len(words))
        h1 = hasher.runs(words, starts, WINDOW)
        return h1, hasher.runs(words, starts, WINDOW, 1).astype(np.int32), np.full(len(h1), row["doc"], np.int64)

    def tell(columns: list[np.ndarray]) -> list[np.ndarray]:
        first, _ = _groups(columns[:2])
        asks = np.zeros(len(columns[0]), bool)
        asks[first] = True
        return [*columns, (~asks).astype(np.int32)]

    return _chunked(batches, "in_text", hashes, tell, ["to", "h", "h2", "doc", "known"])


def covered(n_words: int, starts: np.ndarray) -> np.ndarray:
    """Which words the windows at `starts` cover."""
    opened = np.zeros(n_words + 1, np.int32)
    np.add.at(opened, starts, 1)
    np.add.at(opened, starts + WINDOW, -1)
    return np.cumsum(opened)[:n_words] > 0


def _take_out(text: str | None, hits: list[int] | None, hasher: _Hasher) -> tuple[list[bytes], int]:
    """The words that stay, and how many go."""
    words = split_words(text)
    if not hits or len(words) < WINDOW:
        return words, 0
    h = hasher.runs(words, np.arange(len(words) - WINDOW + 1), WINDOW)
    away = covered(len(words), np.flatnonzero(np.isin(h, np.array(hits, np.int64))))
    return [w for w, x in zip(words, away.tolist(), strict=True) if not x], int(away.sum())


def _judged(docs: DataFrame) -> DataFrame:
    """The rows of docs, their columns under the prefix in_, with `hits`: the hashes of windows to take out."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), *(F.col(c).alias(f"in_{c}") for c in docs.columns))
    asked = rows.select("doc", F.col("in_text").alias("text")).mapInArrow(_anchor_rows, "to long, h long, doc long, known int")
    # what is known goes to its document, what is asked to its hash; a group of asking rows has one a chunk at most
    own_hash = F.when(F.col("known") == 1, F.col("h")).otherwise(F.col("to"))
    group = Window.partitionBy("to", "known", "h")
    shared = (asked.withColumns({"low": F.min("doc").over(group), "high": F.max("doc").over(group)})
        .where("known = 1 or low < high").groupBy("doc").agg(F.collect_set(own_hash).alias("shared")))
    windows = rows.join(shared, "doc").mapInArrow(_window_rows, "to long, h long, h2 int, doc long, known int")
    group = Window.partitionBy("to", "known", "h", "h2")
    hits = (windows.withColumn("low", F.min("doc").over(group))
        .where("known = 1 or doc > low").groupBy("doc").agg(F.collect_set(own_hash).alias("hits")))
    return rows.join(hits, "doc", "left").drop("doc")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row.

    A word goes if a window over it also begins in a document with a smaller doc_id; windows are judged on
    the input. A null text has no words. A null id counts as larger than all others. Rows that repeat an id
    are never each other's earlier document; each keeps its row. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        for part in slices(batches, "in_text"):
            found = [_take_out(t, h, hasher) for t, h in zip(part.column("in_text").to_pylist(), part.column("hits").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("in_doc_id"), pa.array([len(w) + n for w, n in found], pa.int64()), pa.array([n for _, n in found], pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w, _ in found])], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _judged(id_text(docs)).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of docs with all their columns; texts that lose words become the kept words joined by spaces."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        for part in slices(batches, "in_text"):
            texts = []
            for text, hits in zip(part.column("in_text").to_pylist(), part.column("hits").to_pylist()):
                words, gone = _take_out(text, hits, hasher)
                texts.append(b" ".join(words).decode() if gone else text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else part.column(f"in_{c}") for c in columns], names=columns)

    return _judged(docs).mapInArrow(run, docs.schema)

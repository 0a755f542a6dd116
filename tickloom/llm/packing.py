"""Vector best-fit packing of token sequences.

Every piece is a vector: its tokens, one document, and its attention cost (the square of its length).
All three depend on the length alone, so the packing is solved exactly on the histogram of lengths: at
most `max_tokens` rows, however large the corpus. Bins in the same state (same residual vector) are
handled together as a range of bin numbers. The pieces then find their bin by their rank among pieces
of the same length, which is computed without gathering a length in one task.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import checkpoint, id_text, map_rows, tokenizer_path


@dataclass(frozen=True)
class Capacity:
    """What a bin holds at most. The defaults for documents and attention allow whatever tokens allow, so that no bin is opened for them; they still weigh in the choice of a bin."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024


#: Weights of residual tokens, documents and attention when a bin is chosen.
WEIGHTS = (1.0, 1.0, 1.0)


def _byte_ranks(path: str) -> dict[bytes, int]:
    """Bytes -> id of a byte-level BPE in tokenizers' JSON form, whose printable alphabet is undone here."""
    import json

    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model["added_tokens"]}
    return {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}


class TokenIds:
    """Ids as `tokenizers` gives them, special strings being plain text.

    Texts below U+0250 go through the same vocabulary as ranks, which is five times faster and gives the
    same ids there (tests compare them); other texts go through `tokenizers` itself, since the two
    libraries' tables of letters may be of different Unicode versions.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_byte_ranks(path), special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if text.isascii() or max(text) < "ɐ":
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4")
        return np.asarray(self.full.encode(text, add_special_tokens=False).ids, "<u4")


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, max_tokens: int = 1024) -> DataFrame:
    """Tokenise, end every document with end_id, and cut those over max_tokens.

    The remainder comes first, so all pieces of a document but the first are full. A null text is empty:
    one piece of the end id. Repeated rows give pieces of their own.
    """

    def setup() -> TokenIds:
        return TokenIds(tokenizer_path(tokenizer))

    def cut(part: pa.RecordBatch, encode: TokenIds) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for key, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
            ids = np.append(encode(text), np.uint32(end_id)).astype("<u4") if text else np.array([end_id], "<u4")
            edges = [0, *range(len(ids) % max_tokens or max_tokens, len(ids) + 1, max_tokens)]
            for n, (a, b) in enumerate(zip(edges, edges[1:])):
                out["doc_id"].append(key)
                out["piece"].append(n)
                out["start"].append(a)
                out["length"].append(b - a)
                out["ids_crc32"].append(zlib.crc32(ids[a:b].tobytes()))
        return out

    return map_rows(id_text(docs), "text", cut, PIECES, setup)


def best_fit(histogram: dict[int, int], capacity: Capacity = Capacity(), choose: str = "norm", weights: tuple[float, float, float] = WEIGHTS) -> tuple[np.ndarray, int]:
    """Pack `histogram` (length -> how many). Returns placements and the number of bins.

    A placement (length, first rank, n, first bin, offset) puts the pieces of that length with ranks
    first rank .. first rank + n - 1 into consecutive bins, each at that token offset. Longest pieces go
    first. Among the states that have room in every dimension, `norm` takes the least weighted norm of
    what would remain, `dot` the greatest weighted dot product of demand and residual; vectors are in
    parts of the capacity. The work grows with the number of distinct lengths and states.
    """
    full = np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    w = np.asarray(weights, float)
    states: dict[tuple[int, int, int], list[list[int]]] = {}
    placed: list[tuple[int, int, int, int, int]] = []
    bins = 0
    for length in sorted(histogram, reverse=True):
        demand = (length, 1, length * length)
        if any(d > c for d, c in zip(demand, (capacity.tokens, capacity.documents, capacity.attention))):
            raise ValueError(f"a piece of {length} tokens exceeds an empty bin")
        left, rank = histogram[length], 0
        while left:
            best = _choose(states, demand, full, w, choose)
            if best is None:
                each = min(capacity.tokens // length, capacity.documents, capacity.attention // (length * length))
                whole, rest = divmod(left, each)
                for many, count in ((whole, each), (1, rest)):
                    if not many or not count:
                        continue
                    for k in range(count):
                        placed.append((length, rank, many, bins, k * length))
                        rank += many
                    residual = (capacity.tokens - count * length, capacity.documents - count, capacity.attention - count * length * length)
                    states.setdefault(residual, []).append([bins, many])
                    bins += many
                left = 0
                continue
            run = states[best][-1]
            n = min(left, run[1])
            placed.append((length, rank, n, run[0], capacity.tokens - best[0]))
            states.setdefault(tuple(a - b for a, b in zip(best, demand)), []).append([run[0], n])
            run[0], run[1] = run[0] + n, run[1] - n
            if not run[1]:
                states[best].pop()
                if not states[best]:
                    del states[best]
            rank, left = rank + n, left - n
    return np.array(placed, np.int64).reshape(-1, 5), bins


def _choose(states: dict, demand: tuple, full: np.ndarray, w: np.ndarray, choose: str):
    fits = [s for s in states if s[0] >= demand[0] and s[1] >= demand[1] and s[2] >= demand[2]]
    if not fits:
        return None
    residual, d = np.array(fits, float) / full, np.array(demand, float) / full
    score = -(((residual - d) ** 2) * w).sum(axis=1) if choose == "norm" else (residual * d * w).sum(axis=1)
    return fits[int(score.argmax())]


def pack(items: DataFrame, capacity: Capacity = Capacity(), choose: str = "norm", weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """Give every row of `items` (doc_id, piece, length, ...) a sequence_id and an offset in it.

    Ranks among equal lengths are taken inside each partition and shifted by the counts of the partitions
    before it, so neither a common length nor the corpus passes through one task. Only the histogram of
    lengths, at most capacity.tokens rows, reaches the driver. An empty table gives an empty result.
    """
    held = checkpoint(items.withColumn("_part", F.spark_partition_id()))
    counts = held.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table, _ = best_fit(histogram, capacity, choose, weights)
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("_part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    # by all columns, so that a task that runs again ranks repeated ids alike
    inside = Window.partitionBy("_part", "length").orderBy("doc_id", "piece", *(c for c in items.columns if c not in ("doc_id", "piece", "length")))
    ranked = held.withColumn("_at", F.row_number().over(inside).cast("long") - 1).join(shifts, ["_part", "length"])
    return place(ranked.withColumn("_rank", F.col("_at") + F.col("_shift")).drop("_at", "_shift", "_part"), table)


def place(ranked: DataFrame, table: np.ndarray) -> DataFrame:
    """Look up (length, _rank) in the placements; the table's size depends on the lengths alone."""
    order = np.lexsort((table[:, 1], table[:, 0])) if len(table) else np.array([], int)
    table = table[order]
    keys = (table[:, 0] << 44) + table[:, 1]
    columns = [f for f in ranked.schema.fields if f.name != "_rank"]

    def look_up(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            row = table[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            own = [batch.column(f.name) for f in columns]
            yield pa.RecordBatch.from_arrays([*own, pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])], names=[*(f.name for f in columns), "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns) + ", sequence_id long, `offset` long"
    return ranked.mapInArrow(look_up, schema)


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, capacity: Capacity = Capacity()) -> DataFrame:
    """Tokenise, cut and pack `docs`; one row per piece."""
    return pack(pieces(docs, tokenizer, end_id, capacity.tokens), capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

"""Audit: hash chains and Merkle trees."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "GENESIS_" + "0" * 64


def _link(prev: Column) -> Column:
    return F.sha2(F.concat_ws("|", prev, F.col("timestamp").cast("string"), "actor", "role", "action", "details"), 256)


def verify_chain(entries: DataFrame) -> DataFrame:
    """Entries (chain, seq, timestamp, actor, role, action, details, prev_hash, entry_hash) with their fault: BROKEN_LINK or TAMPERED. Links are found by lag per chain."""
    before = F.coalesce(F.lag("entry_hash").over(Window.partitionBy("chain").orderBy("seq")), F.lit(GENESIS))
    return entries.withColumn("fault", F.when(F.col("prev_hash") != before, "BROKEN_LINK").when(_link(F.col("prev_hash")) != F.col("entry_hash"), "TAMPERED"))


def append_chain(entries: DataFrame) -> DataFrame:
    """Hashes for new chains: each entry's hash holds the one before it."""
    schema = "chain string, seq long, timestamp double, actor string, role string, action string, details string, prev_hash string, entry_hash string"

    def fold(own: pd.DataFrame) -> pd.DataFrame:
        prev, out = GENESIS, []
        for e in own.sort_values("seq").itertuples():
            text = "|".join([prev, e.ts_text, e.actor, e.role, e.action, e.details])
            now = hashlib.sha256(text.encode()).hexdigest()
            out.append((e.chain, e.seq, e.timestamp, e.actor, e.role, e.action, e.details, prev, now))
            prev = now
        return pd.DataFrame(out, columns=["chain", "seq", "timestamp", "actor", "role", "action", "details", "prev_hash", "entry_hash"])

    return entries.withColumn("ts_text", F.col("timestamp").cast("string")).groupBy("chain").applyInPandas(fold, schema)


def leaf(data: bytes) -> bytes:
    return hashlib.sha256(b"\0" + data).digest()


def node(left: bytes, right: bytes) -> bytes:
    return hashlib.sha256(b"\1" + left + right).digest()


def root_pairwise(leaves: list[bytes], join: Callable[[bytes, bytes], bytes] = node, odd: str = "promote") -> bytes:
    """Root of hashed leaves taken in pairs; an odd one goes up alone or is doubled."""
    level = list(leaves)
    while len(level) > 1:
        pairs = [join(level[i], level[i + 1]) for i in range(0, len(level) - 1, 2)]
        level = pairs + ([level[-1] if odd == "promote" else join(level[-1], level[-1])] if len(level) % 2 else [])
    return level[0] if level else hashlib.sha256(b"").digest()


def root_rfc6962(leaves: list[bytes]) -> bytes:
    """Root by splitting at the largest power of two below the number of leaves."""
    if not leaves:
        return hashlib.sha256(b"").digest()
    if len(leaves) == 1:
        return leaves[0]
    k = 1 << (len(leaves) - 1).bit_length() - 1
    return node(root_rfc6962(leaves[:k]), root_rfc6962(leaves[k:]))


def inclusion_proof(leaves: list[bytes], i: int) -> list[tuple[str, bytes]]:
    """Sibling hashes from leaf i to the RFC 6962 root, each with the side that it stands on."""
    if len(leaves) <= 1:
        return []
    k = 1 << (len(leaves) - 1).bit_length() - 1
    if i < k:
        return inclusion_proof(leaves[:k], i) + [("right", root_rfc6962(leaves[k:]))]
    return inclusion_proof(leaves[k:], i - k) + [("left", root_rfc6962(leaves[:k]))]


def proves(leaf_hash: bytes, proof: list[tuple[str, bytes]], root: bytes) -> bool:
    for side, other in proof:
        leaf_hash = node(other, leaf_hash) if side == "left" else node(leaf_hash, other)
    return leaf_hash == root


def merkle_levels(rows: DataFrame, data: str = "data", order: str = "seq") -> DataFrame:
    """One row, the root (hex) of prefixed leaves in order, odd ones promoted; levels are joined by position, so no task holds all leaves.

    `order` must count from 0 without gaps.
    """
    level = rows.select(F.col(order).cast("long").alias("i"), F.sha2(F.concat(F.unhex(F.lit("00")), F.col(data).cast("binary")), 256).alias("h"))
    n = rows.count()
    while n > 1:
        level = level.groupBy(F.floor(F.col("i") / 2).alias("i")).agg(F.min_by("h", "i").alias("l"), F.max_by("h", "i").alias("r"), F.count(F.lit(1)).alias("k")).select("i", F.when(F.col("k") == 1, F.col("l")).otherwise(F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex("l"), F.unhex("r")), 256)).alias("h"))
        n = (n + 1) // 2
    return level.select(F.col("h").alias("root"))

"""Exact deduplication over a persistent digest index, with DataFrame operations only.

The index is a set of runs: tables bucketed and sorted by digest, one sorted file a bucket, of which each
call appends one. New rows are pre-aggregated by digest and sorted once; the digests that the index holds
are taken out by sort-merge anti-joins with the runs. A run is neither shuffled nor sorted for it, since
its scan reports both. When there are more than MOST_RUNS, they are merged into one.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import checkpoint

MOST_RUNS = 8
ENTRY = "digest binary, keep_id long"


def digest_of(text: Column) -> Column:
    """The 32-byte SHA-256 of the text in UTF-8; a null text counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def with_digest(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and the digest of the text."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), digest_of(F.col(text)).alias("digest"))


def groups_of(digests: DataFrame) -> DataFrame:
    """Of each digest, the largest doc_id and the number of rows; combined before the shuffle."""
    return digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


@contextmanager
def _sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Lets the scan of a bucketed table with one file a bucket report its order, so that no sort is planned above it."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class DigestIndex:
    """The digests (digest, keep_id) of all texts seen, in buckets sorted by digest.

    The number of buckets is fixed when the index is made, as `buckets` or else as many as a shuffle has
    partitions: choose it so that a bucket of the final index fits a task (about 60 bytes a distinct text).
    An index that is there keeps its own number. `name` is the caller's; drop() removes the tables.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        self.spark, self.name = spark, name
        self.buckets = self._held_buckets() or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _held_buckets(self) -> int | None:
        for t in self.runs()[:1]:
            for r in self.spark.sql(f"DESCRIBE EXTENDED {t}").where("col_name = 'Num Buckets'").collect():
                return int(r["data_type"])
        return None

    def runs(self) -> list[str]:
        """The tables of the index, oldest first."""
        own = [t.name for t in self.spark.catalog.listTables() if t.name.startswith(f"{self.name}_run")]
        return sorted(own, key=lambda t: int(t.rpartition("_run")[2]))

    def entries(self) -> DataFrame:
        empty = self.spark.createDataFrame([], ENTRY)
        return reduce(DataFrame.unionByName, [self.spark.table(t) for t in self.runs()] or [empty])

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The groups whose digest no run has; groups are shuffled and sorted once for all runs."""
        dealt = groups.repartition(self.buckets, "digest")
        return reduce(lambda left, t: left.join(self.spark.table(t).select("digest").hint("merge"), "digest", "left_anti"), self.runs(), dealt)

    def insert(self, groups: DataFrame) -> None:
        """Append what the index lacks of `groups` (a row for each digest, with keep_id) as a run."""
        with _sorted_scans(self.spark):
            self._write(checkpoint(self.unseen(groups.select("digest", "keep_id"))))
        if len(self.runs()) > MOST_RUNS:
            self.compact()

    def compact(self) -> None:
        """Merge all runs into one."""
        old = self.runs()
        self._write(checkpoint(self.entries()))
        for t in old:
            self.spark.sql(f"DROP TABLE {t}")

    def drop(self) -> None:
        for t in self.runs():
            self.spark.sql(f"DROP TABLE {t}")

    def _write(self, entries: DataFrame) -> None:
        number = 1 + max((int(t.rpartition("_run")[2]) for t in self.runs()), default=-1)
        (entries.repartition(self.buckets, "digest").write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
            .saveAsTable(f"{self.name}_run{number}"))

    def add(self, docs: DataFrame, text: str = "text", key: str = "doc_id", batches: int = 2) -> DataFrame:
        """Decide on each row of docs, and append the texts that are new.

        The rows go in as `batches` ranges of ids, the largest ids first, so that a text's digest is in the
        index before rows with smaller ids come: the anti-join leaves those out. Returns doc_id, keep_id,
        group_size, kept, text_sha256 for every row. Of equal texts in docs the row with the largest doc_id
        stays, unless an earlier call already took the text: then none does and keep_id is the earlier
        row's. group_size counts rows of this call. Null ids: they come last and count in group_size; a null
        id stays only if its group has no other. Rows that repeat both doc_id and text share one decision.
        An empty table gives an empty result.
        """
        digests = with_digest(docs, text, key)
        low, high = digests.agg(F.min("doc_id"), F.max("doc_id")).first()
        step = max(1, -((low - high - 1) // batches)) if low is not None else 1
        batch = F.coalesce(F.least(((F.lit(high) - F.col("doc_id")) / step).cast("int"), F.lit(batches - 1)), F.lit(batches - 1))
        earlier = self.runs()
        groups = checkpoint(digests.groupBy("digest", batch.alias("batch")).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
        for number in range(batches):
            self.insert(groups.where(F.col("batch") == number))
        sizes = groups.groupBy("digest").agg(F.sum("group_size").alias("group_size"))
        known = [self.spark.table(t).withColumn("new", F.lit(t not in earlier)) for t in self.runs()]
        verdicts = checkpoint(sizes.join(reduce(DataFrame.unionByName, known).hint("merge"), "digest"))
        # both sides come straight from a shuffle, so that adaptive execution can split a hot digest
        return digests.join(verdicts.hint("merge"), "digest").select(
            "doc_id", "keep_id", "group_size",
            (F.col("new") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"))


def without_copies(docs: DataFrame, index: DigestIndex, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs that DigestIndex.add keeps, with all their columns.

    Of rows that repeat id and text one stays: that with the smallest hash of all its columns, so a task
    that runs again keeps the same. Columns of any name stay untouched. Null ids and texts as in add().
    """
    marks = lambda i: {"no_id": i.isNull(), "own_id": F.coalesce(i, F.lit(0))}
    same = ["no_id", "own_id", "own_sha256"]
    kept = index.add(docs, text, key).where("kept").withColumns(marks(F.col("doc_id"))).withColumnRenamed("text_sha256", "own_sha256").select(*same)
    rows = docs.select(F.struct("*").alias("row"), F.lower(F.hex(digest_of(F.col(text)))).alias("own_sha256"), *(c.alias(n) for n, c in marks(F.col(key).cast("long")).items()))
    first = Window.partitionBy(*same).orderBy(F.xxhash64("row"))
    return rows.join(kept.hint("merge"), same, "left_semi").withColumn("nth", F.row_number().over(first)).where("nth = 1").select("row.*")

"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id where ids are compared: after every real id.
LAST_ID = (1 << 63) - 1
#: Characters of text that a Python step handles at once.
SLICE_CHARS = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the folder named by spark.checkpoint.dir.

    A folder of our own is set only where the session names none, as in tests.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share, as spark.checkpoint.dir names it; one of our own where it is unset and Spark runs in this process alone, as in tests."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tickloom-"))
    return named or sc.getCheckpointDir()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def id_text(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Only the key and the text, so extra columns never clash with computed ones."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each part holds about SLICE_CHARS of text, one row at least."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist() if batch.num_rows else []
        first, held = 0, 0
        for i, size in enumerate(sizes):
            if i > first and held + size > SLICE_CHARS:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += size
        if first < len(sizes):
            yield batch.slice(first)


def map_rows(df: DataFrame, text: str, fn: Callable[[pa.RecordBatch], dict[str, object]], schema: str, setup: Callable[[], object] | None = None) -> DataFrame:
    """mapInArrow over bounded slices.

    fn gets a slice (and what setup made once per task) and returns columns; their lengths may
    differ from the slice's.
    """
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = setup() if setup else None
        for part in slices(batches, text):
            got = fn(part, held) if setup else fn(part)
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}


def _arrow_schema(schema: str) -> pa.Schema:
    """The Arrow form of a DDL string such as 'doc_id long, text string'."""
    pairs = [part.strip().split(" ", 1) for part in schema.split(",")]
    return pa.schema([pa.field(name, _ARROW[kind.strip()]) for name, kind in pairs])


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; looked up on the machine that uses it."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)

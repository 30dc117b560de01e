"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import materialize, scratch_path, shared_dir  # noqa: F401

#: Bytes that separate words wherever a contract says ``[^\x20\x09-\x0D]+``.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Arrow batches between the JVM and Python workers: by bytes, as texts are of any length.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by ``BATCH_BYTES`` unless it has its own lower bound.

    The default of 10,000 rows is up to 64 MB of text a batch, held by both sides of
    the pipe and copied as it grows.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def release() -> None:
    """Give freed memory back to the system: an idle worker outlives its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its memory
        pass


def column(name: str) -> "F.Column":
    """A column by its whole name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def hash62(*columns) -> "F.Column":
    """A non-negative 62-bit hash: differences of two of them never overflow."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 2)


def fold_of(id_column) -> "F.Column":
    """crc32 of the id as text, modulo 5; remainder 0 is held out of all learning."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 5


def labelled_sample(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str, bound: int, folds: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """At most ``bound`` labelled documents of the given folds: ``doc_id, text, label``.

    They are the first by a hash of the id, so the choice doesn't depend on the label,
    the order of rows or the number of partitions.  A repeated label counts once (the
    larger value); null labels and ids are left out.
    """
    kept = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(fold_of(F.col("doc_id")).isin(*folds))
    kept = kept.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    kept = kept.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(bound)
    # At most ``bound`` ids and labels: 12 bytes each.
    return docs.select("doc_id", "text").join(F.broadcast(kept), "doc_id")


class WordHashes(dict):
    """64-bit hashes of words, kept in a bounded table per Python worker."""

    def __init__(self, bound: int = 100_000):
        import xxhash

        super().__init__()
        self.digest, self.bound = xxhash.xxh3_64_digest, bound

    def __missing__(self, word: bytes) -> bytes:
        found = self[word] = self.digest(word)
        return found

    def __call__(self, words: list[bytes]):
        import numpy as np

        if len(self) > self.bound:
            self.clear()
        return np.frombuffer(b"".join(map(self.__getitem__, words)), np.uint64)

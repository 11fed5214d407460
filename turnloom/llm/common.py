"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textbatch import mix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder for cut lineage; a temporary one only in local mode without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder is None:
        folder = context.getCheckpointDir()
        if folder is None:
            if not (context.master or "").startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="turnloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


_tables: list[tuple[SparkSession, str]] = []


def temporary_table(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for a table that results still read; it is deleted when the program ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _tables.append((spark, path))
    return path


@atexit.register
def _delete_tables() -> None:
    for spark, path in _tables:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001
            # the session has ended; a folder of this machine can still be deleted
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def cut(df: DataFrame) -> DataFrame:
    """The rows as a reliable checkpoint, computed once."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else the table has."""
    return df.select(*[df[n] for n in names])


BLOCK = "bucket int, body binary"
_BLOCK = pa.schema([("bucket", pa.int32()), ("body", pa.binary())])


class Packer:
    """Collects fixed-width records for hash buckets and hands them out as one binary a bucket.

    A row of Spark's then holds thousands of records, so that a shuffle costs the JVM no work a record.
    """

    def __init__(self, record: np.dtype, buckets: int, limit: int = 24 << 20) -> None:
        self.record, self.buckets, self.limit = np.dtype(record), buckets, limit
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, records: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(((keys >> np.uint64(40)).astype(np.int64) % self.buckets, records))
        self.held += records.nbytes
        if self.held > self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            bucket = np.concatenate([b for b, _ in self.parts])
            records = np.concatenate([r for _, r in self.parts])
            order = np.argsort(bucket.astype(np.uint16) if self.buckets < 1 << 16 else bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
            records = records[order]
            some = np.flatnonzero(np.diff(bounds))
            for at in range(0, len(some), 64):
                part = some[at : at + 64]
                bodies = [records[bounds[b] : bounds[b + 1]].tobytes() for b in part]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(bodies, pa.binary())], schema=_BLOCK)
        self.parts, self.held = [], 0


def unpack(batches: Iterator[pa.RecordBatch], record: np.dtype) -> np.ndarray:
    """All records of a partition."""
    parts = [np.frombuffer(b, dtype=record) for batch in batches for b in batch.column(1).to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=record)


def exchange(df: DataFrame, make: Callable, buckets: int) -> DataFrame:
    """Packed blocks of ``make`` (mapInArrow function to BLOCK rows), bucket b in partition b."""
    return df.mapInArrow(make, BLOCK).repartitionById(buckets, F.col("bucket"))


class Filter:
    """A Bloom filter of at most 32 MB, which any number of keys may enter; who asks must check again.

    Up to 20 million keys few others pass; with more it lets more through, and nothing else changes.
    """

    LARGEST = 1 << 28

    def __init__(self, keys: DataFrame) -> None:
        """keys: one bigint column.  Tasks fill the bits, and the driver gets them combined."""
        n = self.keys = keys.count()
        self.bits = 1 << min(self.LARGEST.bit_length() - 1, max(13, (12 * n).bit_length()))
        size, chunk = self.bits, self.bits // 2048

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros(size // 8, dtype=np.uint8)
            for batch in batches:
                for at in _places(np.asarray(batch.column(0)), size):
                    np.bitwise_or.at(held, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
            if held.any():
                bodies = [held[k * chunk : (k + 1) * chunk].tobytes() for k in range(256)]
                yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(bodies, pa.binary())], schema=_BLOCK)

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    part = np.frombuffer(body, np.uint8)
                    total[k] = total[k] | part if k in total else part
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], schema=_BLOCK)

        self.body = np.zeros(size // 8, dtype=np.uint8)
        few = keys.coalesce(max(1, min(partitions(keys.sparkSession), 1 + n // 100_000)))
        for row in few.mapInArrow(fill, BLOCK).repartitionById(min(partitions(keys.sparkSession), 16), F.col("bucket")).mapInArrow(join, BLOCK).collect():
            self.body[row.bucket * chunk : (row.bucket + 1) * chunk] = np.frombuffer(bytes(row.body), np.uint8)

    def passes(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), dtype=bool)
        for at in _places(keys, self.bits):
            out &= (self.body[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def _places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    x = mix(keys.view(np.uint64))
    return [((x >> np.uint64(shift)) & np.uint64(bits - 1)).astype(np.int64) for shift in (0, 32)]

"""Helpers shared by the corpus operators: bounded Arrow batches, a vectorised word
scanner over UTF-8 buffers, and tables written to the folder all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Text bytes handled at once by a Python worker; a longer document is a batch of its own.
CHUNK_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)

#: \x20 and \x09-\x0D separate words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
RAW = np.arange(256, dtype=np.uint8)
LOWER = RAW.copy()
LOWER[65:91] += 32


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a local session gets a folder of its warehouse, as in
    tests; on a cluster that is an error, as the warehouse may be local to each machine."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        set_to = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return set_to.rstrip("/")


_CLEANUP, _ROWS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, path: str, parts: int | None = None, rows: int | None = None) -> DataFrame:
    """df written once as Parquet and read again: lineage ends here, and the rows outlive any executor. Spark drops the
    step's shuffle files when it has ended. parts: the most tasks and files that the last step needs. rows: the most
    rows that go to Python at once, where rows are large."""
    spark = df.sparkSession
    if parts is not None:
        df = df.coalesce(parts)
    wanted = {_CLEANUP: "true"} | ({_ROWS: str(rows)} if rows else {})
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """df written to a new table of the shared folder, which stays there."""
    return written(df, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}", parts)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a folder of whatever file system Spark writes to."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Scratch:
    """Tables of one operator, deleted when it has its result."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.count = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def stored(self, df: DataFrame, name: str, parts: int | None = None, rows: int | None = None) -> DataFrame:
        self.count += 1
        return written(df, f"{self.folder}/{name}-{self.count}", parts, rows)

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        for k in range(1, self.count + 1):
            for name in names:
                dropped(self.spark, f"{self.folder}/{name}-{k}")

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """A table that stays, one a call of the operator."""
        return stored(df, self.folder.rsplit("/", 1)[1].split("-")[0] + "-" + name)

    def __exit__(self, *failed) -> None:
        dropped(self.spark, self.folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `most` bytes in `column`, one row at least."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        col = b.column(b.schema.get_field_index(column))
        size = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
        total = np.cumsum(size)
        at = 0
        while at < n:
            base = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, base + most, "right")))
            yield b.slice(at, end - at)
            at = end


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: none), and where each row begins and the last ends."""
    col = pa.concat_arrays([pc.fill_null(col, "").cast(pa.large_string())])
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        m = max(n, CHUNK_BYTES + 1024)
        _powers[:] = [np.concatenate([[_U(1)], np.cumprod(np.full(m - 1, b, _U))]) for b in (_BASE, _BASE_INV)]
    return _powers[0][:n], _powers[1][:n]


class Words:
    """The words of a batch of texts: start and end bytes, 64-bit hashes, and each text's first word.

    The hash of any byte span is a difference of prefix sums, so no word becomes a Python object.
    """

    def __init__(self, buf: np.ndarray, at: np.ndarray, fold: np.ndarray = RAW, space: np.ndarray = SPACE):
        self.buf, self.at = buf, at
        n = len(buf)
        inside = ~space[buf]
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            begin = at[:-1][at[1:] > at[:-1]]
            first[begin] = inside[begin]
            end = at[1:][at[1:] > at[:-1]] - 1
            last[end] = inside[end]
        self.inside = inside
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, at)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(at) - 1), self.count)
        up, self._down = powers(n + 1)
        self._sum = np.zeros(n + 1, _U)
        np.cumsum((fold[buf].astype(_U) + _U(1)) * up[:n], out=self._sum[1:])
        self.hash = self.spans(self.start, self.end)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sum[end] - self._sum[start]) * self._down[start] + (end - start).astype(_U))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Rolling hashes of n words, by the first word's position; spans of two texts are the caller's to drop."""
    if len(h) < n:
        return np.zeros(0, _U)
    m = len(h) - n + 1
    g = h[:m].copy()
    for k in range(1, n):
        g = (g ^ (g >> _U(31))) * _U(0xD6E8FEB86659FD93) + h[k : k + m]
    return mix(g)


def carried(docs: DataFrame, run, added: list[tuple[str, str]] | None = None) -> DataFrame:
    """docs.mapInArrow(run) with the columns of docs and those added, whatever the names: run sees the columns as c0, c1, ..."""
    schema = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)])
    for i, (_, kind) in enumerate(added or []):
        schema = schema.add(f"x{i}", kind)
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).mapInArrow(run, schema).toDF(*docs.columns, *[n for n, _ in added or []])


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive positions of first."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def crc_fold(column: str, n: int):
    """crc32 of an integer column as text, modulo n."""
    return F.expr(f"crc32(cast(`{column}` as string)) % {n}")

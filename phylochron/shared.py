"""Tables that cut lineage, in the folder all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a local session gets a folder of its warehouse, as in
    tests; on a cluster that is an error, as the warehouse may be local to each machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet and read again."""
    return _written(df, f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


def files(spark: SparkSession, path: str):
    """(file system, path) of whatever store Spark itself uses for a path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    store, place = files(spark, path)
    return store.exists(place)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written to its end: Spark's commit marks it."""
    return exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, null if there is none."""
    if not exists(spark, path):
        return None
    return spark.read.text(path, wholetext=True).first()[0]


def write_text(spark: SparkSession, path: str, text: str | Iterable[str], force: bool = False) -> None:
    """The whole text, or all its parts, or nothing, on whatever file system the path names: a hidden file is written, which then
    takes the name. Without force a name that exists is an error, also if another writer takes it in the meantime."""
    jvm = spark._jvm
    store, place = files(spark, path)
    place = store.makeQualified(place)
    if store.exists(place) and not force:
        raise FileExistsError(f"{path} exists; force overwrites it")
    store.mkdirs(place.getParent())
    own = jvm.org.apache.hadoop.fs.FileSystem.newInstance(place.toUri(), spark._jsc.hadoopConfiguration())
    part = jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{place.getName()}.{uuid.uuid4().hex}")
    try:
        own.setWriteChecksum(False)  # no files beside the results
        out = own.create(part, False)
        try:
            for piece in [text] if isinstance(text, str) else text:
                out.write(bytearray(piece.encode()))
        finally:
            out.close()
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE if force else kind.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration()).rename(part, place, how)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise FileExistsError(f"{path} exists; force overwrites it") from e
            raise
    finally:
        own.delete(part, False)
        own.close()


class Steps:
    """The tables of an algorithm of many steps: all but the result are deleted at its end."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.count = spark, f"{folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.versions: dict[str, str] = {}

    def __enter__(self) -> Steps:
        return self

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        return _written(df, f"{self.folder}/{name}-{self.count}")

    def replaced(self, df: DataFrame, name: str) -> DataFrame:
        """The same for the next version of a table: the one before, which it may still read, is deleted then."""
        before, out = self.versions.get(name), self.stored(df, name)
        self.versions[name] = f"{self.folder}/{name}-{self.count}"
        if before:
            store, place = files(self.spark, before)
            store.delete(place, True)
        return out

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """A table that stays."""
        return stored(df, name)

    def __exit__(self, *failed) -> None:
        store, place = files(self.spark, self.folder)
        store.delete(place, True)


class Parts:
    """A table that stays and is written part by part, each of which can be read before the others are there."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{folder(spark)}/{name}-{uuid.uuid4().hex}"

    def stored(self, df: DataFrame, part: int) -> DataFrame:
        return _written(df, f"{self.path}/part={part}")

    def whole(self, like: DataFrame) -> DataFrame:
        """The table, of parts like this one."""
        return self.spark.read.schema(like.schema).parquet(self.path).select(*like.columns)

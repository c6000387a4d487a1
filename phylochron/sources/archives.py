"""Files as texts: gzip by its magic number whatever the name, tar archives member by member, nothing unpacked to disk."""

from __future__ import annotations

import gzip
import io
import posixpath
import re
import tarfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SUFFIXES = (".tar.gz", ".tgz", ".tar", ".gz")
MEMBERS = "path string, member string, content binary"


class ArchiveError(ValueError):
    """An archive that cannot be read as what was asked for."""


def logical_path(path: str) -> str:
    """The path without its compression suffix."""
    low = path.lower()
    return next((path[: -len(s)] for s in SUFFIXES if low.endswith(s)), path)


def logical_stem(path: str) -> str:
    """The family's name: the file's name without compression suffix and extension."""
    return posixpath.splitext(posixpath.basename(logical_path(path)))[0]


def is_gzip(content: bytes) -> bool:
    return content[:2] == b"\x1f\x8b"


def is_tar(content: bytes) -> bool:
    return content[257:262] == b"ustar"


def safe(name: str) -> bool:
    """Member names that stay inside: relative, without parent parts."""
    return not name.startswith(("/", "\\")) and not re.match(r"[A-Za-z]:", name) and ".." not in name.replace("\\", "/").split("/")


def members(path: str, content: bytes):
    """(member, bytes) of a file: itself, or the regular files of a tar archive."""
    if is_gzip(content):
        content = gzip.decompress(content)
    if not is_tar(content):
        yield logical_path(path), content
        return
    with tarfile.open(fileobj=io.BytesIO(content)) as tar:
        for m in tar:
            if m.isreg():
                if not safe(m.name):
                    raise ArchiveError(f"{path}: member {m.name!r} leaves the archive")
                yield m.name, tar.extractfile(m).read()


def text(path: str, content: bytes) -> str:
    """The one text of a file; newlines of any kind are \\n."""
    found = list(members(path, content))
    if len(found) != 1:
        raise ArchiveError(f"{path} has {len(found)} members; unpack it with: tar -xf {path}")
    return found[0][1].decode("utf-8-sig").replace("\r\n", "\n").replace("\r", "\n")


def read(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, member, content) of files and archives; each file is one task's work at a time."""

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for name, data in members(path, content.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([name]), pa.array([data], pa.binary())], names=["path", "member", "content"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", "content").mapInArrow(run, MEMBERS)

"""Members of zip archives as a Python data source: one partition for each member.

Only an archive's directory and the bytes of one member are read by a task, through pyarrow's file systems (local paths, and
stores whose scheme pyarrow knows).  A member that can't be read is a row with an error and no content.
"""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from touchline.sources.files import normalise

#: A file that is no archive, a wrong checksum, a cut or garbled stream, a password.  Failures of the store are not among them: the task is tried again.
BROKEN = (zipfile.BadZipFile, EOFError, ValueError, RuntimeError, zlib.error)
SCHEMA = "archive string, member string, content binary, error string"


def _open(path: str) -> tuple:
    """File system and plain path of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)


class _File:
    """A file as ``zipfile`` expects it: a place before its start is an OSError."""

    def __init__(self, file: object) -> None:
        self.read, self.tell, self.seekable = file.read, file.tell, file.seekable
        self._seek = file.seek

    def seek(self, offset: int, whence: int = 0) -> int:
        try:
            return self._seek(offset, whence)
        except ValueError as e:
            raise OSError(str(e)) from e


@contextmanager
def _unzipped(path: str) -> Iterator[zipfile.ZipFile]:
    system, plain = _open(path)
    with system.open_input_file(plain) as f, zipfile.ZipFile(_File(f)) as z:
        yield z


def _archives(path: str) -> list[str]:
    """The archive itself, or the archives in a folder and below, in order."""
    from pyarrow import fs

    system, plain = _open(path)
    head = path[: len(path) - len(plain)] if path.endswith(plain) else ""
    if system.get_file_info(plain).type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(plain, recursive=True, allow_not_found=True))
    return sorted(head + f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".zip"))


@dataclass
class Member(InputPartition):
    archive: str
    member: str | None  # None: the archive's directory can't be read
    error: str | None = None


class MemberReader(DataSourceReader):
    def __init__(self, path: str, suffix: str) -> None:
        self.path, self.suffix = path, suffix

    def partitions(self) -> list[Member]:
        out: list[Member] = []
        for archive in _archives(self.path):
            try:
                with _unzipped(archive) as z:
                    out += [Member(archive, i.filename) for i in sorted(z.infolist(), key=lambda i: i.filename) if not i.is_dir() and i.filename.lower().endswith(self.suffix)]
            except BROKEN as e:
                out.append(Member(archive, None, str(e)))
        return out or [Member("", None)]

    def read(self, partition: Member) -> Iterator[tuple]:
        if partition.member is None:
            if partition.error:
                yield partition.archive, None, None, partition.error
            return
        try:
            with _unzipped(partition.archive) as z:
                yield partition.archive, partition.member, z.read(partition.member), None
        except BROKEN as e:
            yield partition.archive, partition.member, None, str(e) or type(e).__name__


class ZipMembers(DataSource):
    """Options: ``path`` (an archive or a folder of archives) and ``suffix`` (of the members to read; any by default)."""

    @classmethod
    def name(cls) -> str:
        return "zipmembers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> MemberReader:
        return MemberReader(self.options["path"], self.options.get("suffix", "").lower())


def read_members(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """archive, member, content, error of each member whose name ends in ``suffix``.

    Empty archives and folders give no rows, a broken archive one row without a member."""
    spark.dataSource.register(ZipMembers)
    return spark.read.format("zipmembers").option("path", path).option("suffix", suffix).load()


def read_zipped_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Season rows of the CSV members of archives, each member by a task of its own; members that can't be read give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for batch in batches:
            for archive, member, content in zip(batch.archive, batch.member, batch.content, strict=True):
                for part in pd.read_csv(io.BytesIO(content), dtype=str, chunksize=25_000):
                    yield part.reindex(columns=columns).assign(file=f"{archive}#{member}")

    schema = ", ".join(f"`{c}` string" for c in columns) + ", file string"
    held = read_members(spark, path, ".csv").filter("content is not null and length(content) > 0")
    return normalise(held.select("archive", "member", "content").mapInPandas(run, schema))

"""Archives read member by member, and rows written as files, as data sources of Spark.

Both need a folder that all executors mount, given as a plain path or with the scheme file:.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import time
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Partitions of an archive at most; members are dealt to them in turn.
MOST_PARTITIONS = 10_000
_STEP = 1 << 20
_TRIES = 100
MEMBERS = "member string, size long, packed long, crc32 long, sha256 string, content binary"
MANIFEST = "name string, size long, sha256 string"


def local(path: str) -> str:
    """A path that open() understands; other schemes than file: are refused."""
    scheme, found, rest = path.partition(":")
    if found and "/" not in scheme:
        if scheme != "file":
            raise ValueError(f"{path}: a mounted folder is needed")
        path = "/" + rest.lstrip("/")
    return path


def digest_of(path: str) -> str:
    found = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(_STEP):
            found.update(block)
    return found.hexdigest()


@dataclass
class _Members(InputPartition):
    path: str
    names: list[str]


class ArchiveSource(DataSource):
    """Rows (member, size, packed, crc32, sha256, content) of a ZIP archive, shortest name first.

    Options: path (mirrors, comma-separated, of which the first that is there and has the right digest is read), sha256
    (of the archive; any if not given), suffix (of the members), content ("false": the directory alone, no member is
    opened). A member is read and its checksum tested on an executor; one that is damaged fails the job.
    """

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ArchiveReader(dict(self.options))


class _ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.mirrors = [local(p.strip()) for p in options.get("path", "").split(",") if p.strip()]
        self.sha256, self.suffix = options.get("sha256", "").lower(), options.get("suffix", "")
        self.content = options.get("content", "true").lower() != "false"

    def _archive(self) -> str:
        why = []
        for path in self.mirrors:
            if not os.path.isfile(path):
                why.append(f"{path}: not there")
            elif self.sha256 and digest_of(path) != self.sha256:
                why.append(f"{path}: another digest")
            else:
                return path
        raise ValueError("no mirror can be read: " + "; ".join(why or ["none is named"]))

    def partitions(self) -> list[InputPartition]:
        path = self._archive()
        with zipfile.ZipFile(path) as z:
            names = sorted({i.filename for i in z.infolist() if not i.is_dir() and i.filename.endswith(self.suffix)}, key=lambda n: (len(n), n))
        n = min(len(names), MOST_PARTITIONS)
        return [_Members(path, names[i::n]) for i in range(n)] or [_Members(path, [])]

    def read(self, partition: _Members) -> Iterator[tuple]:
        with zipfile.ZipFile(partition.path) as z:
            for name in partition.names:
                info = z.getinfo(name)
                content = z.read(name) if self.content else None  # tests the checksum
                yield name, info.file_size, info.compress_size, info.CRC, hashlib.sha256(content).hexdigest() if self.content else None, content


def archive_members(spark: SparkSession, mirrors: list[str], sha256: str | None = None, suffix: str = "", content: bool = True) -> DataFrame:
    """The members of the first mirror that is whole; see ArchiveSource."""
    spark.dataSource.register(ArchiveSource)
    reader = spark.read.format("archive_members").option("path", ",".join(mirrors)).option("suffix", suffix).option("content", str(content).lower())
    return (reader.option("sha256", sha256) if sha256 else reader).load()


@dataclass
class _Written(WriterCommitMessage):
    part: str
    files: int


class FileSink(DataSource):
    """Writes a file for each row (name, content): option path, a folder that is not there yet.

    Each task writes its files and their manifest into a folder of its own beside the target; the job's commit moves
    these into place, one for each task, so a job that fails leaves no file, and a task that runs twice leaves one copy.
    """

    @classmethod
    def name(cls) -> str:
        return "row_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _FileWriter(local(self.options["path"]))


def checked_name(name: str | None) -> str:
    """The name of a file within a folder: no other folder, no hidden file."""
    if not name or name.startswith(".") or "/" in name or "\\" in name or "\0" in name or '"' in name or "\n" in name:
        raise ValueError(f"not the name of a file: {name!r}")
    return name


class _FileWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.staged = path, f"{path}.staged-{uuid.uuid4().hex}"
        if os.path.exists(path):
            raise FileExistsError(path)
        os.makedirs(self.staged)

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        part, files = uuid.uuid4().hex, 0
        folder = f"{self.staged}/{part}"
        os.mkdir(folder)  # fails once the job is aborted
        with open(f"{self.staged}/{part}.csv", "w", encoding="utf-8") as manifest:
            for row in iterator:
                name, content = checked_name(row["name"]), bytes(row["content"] or b"")
                with open(f"{folder}/{name}", "xb") as f:
                    f.write(content)
                manifest.write(f'"{name}",{len(content)},{hashlib.sha256(content).hexdigest()}\n')
                files += 1
        return _Written(part, files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        final = f"{self.staged}.whole"
        os.makedirs(f"{final}/_manifest")
        for m in messages:
            if m and m.files:
                os.rename(f"{self.staged}/{m.part}", f"{final}/{m.part}")
                os.rename(f"{self.staged}/{m.part}.csv", f"{final}/_manifest/{m.part}.csv")
        os.rename(final, self.path)
        _removed(self.staged)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        _removed(self.staged)
        _removed(f"{self.staged}.whole")


def _removed(folder: str) -> None:
    """Removes a folder that tasks of a failed job may still write to; none of them can begin again once it is gone."""
    for _ in range(_TRIES):
        shutil.rmtree(folder, ignore_errors=True)
        if not os.path.exists(folder):
            return
        time.sleep(0.1)


def write_files(rows: DataFrame, name: str, content: str, path: str) -> DataFrame:
    """Writes the content of each row to a file of that name under a new folder path, and returns their manifest (name, size, sha256).

    Names must differ, which one job tests before anything is written; null contents are empty files. Files stand in a
    folder for each task.
    """
    named = rows.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content"))
    twice = named.groupBy("name").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"a name stands twice: {twice[0]['name']!r}")
    rows.sparkSession.dataSource.register(FileSink)
    named.write.format("row_files").option("path", path).mode("append").save()
    return rows.sparkSession.read.schema(MANIFEST).csv(f"{path}/_manifest")


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, sha256) of the files that write_files() left, each read and hashed again."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*").load(path)
    plain = found.filter(~F.col("path").contains("/_manifest/"))
    return plain.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))

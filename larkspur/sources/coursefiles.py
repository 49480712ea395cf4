"""Course files as a Python data source, ``course_files`` (SRC1): folders are pruned while listing, files are dealt to tasks by size; and the sink that writes files.

The driver lists folders, several at once, and never opens one with a skipped name; files of other kinds are not read. Each task
reads files of about ``partition_bytes`` together, one record batch for each few megabytes. Paths are those that pyarrow's file systems know.

Defined results: a folder without files gives no rows; a root below a skipped name gives none either; a link to a folder is not followed; of a name
such as ``.md`` the dot begins no suffix. A file that goes away between listing and reading is an error.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# What is read, and folders that are not.
SUFFIXES = ("md", "txt", "py", "ipynb")
SKIPPED = (".git", "__pycache__", ".venv", "venv", "node_modules", ".next", "dist", "build")
#: Bytes of files for a task, and of files in a record batch; listings at once.
PARTITION_BYTES, BATCH_BYTES, LISTERS = 64 << 20, 4 << 20, 16
#: What a file costs besides its bytes.
OPEN_BYTES = 1 << 20
SCHEMA = "source_path string, size long, content binary"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or local path, and the path in it."""
    if uri.startswith("file:"):
        uri = "file:///" + uri[len("file:") :].lstrip("/")  # file:/x and file:///x are one folder
    system, path = fs.FileSystem.from_uri(uri if ":" in uri else f"file://{os.path.abspath(uri)}")
    return system, path.rstrip("/")


def listed(uri: str) -> list[tuple[str, int]]:
    """(path below the root, size) of the wanted files, in order of paths."""
    system, root = opened(uri)
    if set(PurePosixPath(root).parts) & set(SKIPPED):
        return []
    local = isinstance(system, fs.LocalFileSystem)

    def one(folder: str) -> list[fs.FileInfo]:
        return system.get_file_info(fs.FileSelector(folder, recursive=False))

    found, folders = [], [root]
    with ThreadPoolExecutor(LISTERS) as pool:
        while folders:
            below = [info for infos in pool.map(one, folders) for info in infos]
            folders = [i.path for i in below if i.type == fs.FileType.Directory and i.base_name not in SKIPPED and not (local and os.path.islink(i.path))]
            # A file of a skipped name is no course file either.
            found += [(i.path[len(root) :].lstrip("/"), i.size) for i in below if i.type == fs.FileType.File and i.base_name not in SKIPPED and PurePosixPath(i.base_name).suffix.lower()[1:] in SUFFIXES]
    return sorted(found)


@dataclass
class Files(InputPartition):
    names: list[str]


class CourseFilesReader(DataSourceReader):
    def __init__(self, uri: str, partition_bytes: int):
        self.uri, self.partition_bytes = uri, partition_bytes

    def partitions(self) -> list[Files]:
        out, held = [Files([])], 0
        for name, size in listed(self.uri):
            if out[-1].names and held + size + OPEN_BYTES > self.partition_bytes:
                out.append(Files([]))
                held = 0
            out[-1].names.append(name)
            held += size + OPEN_BYTES
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, root = opened(self.uri)
        names, bodies, held = [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array(names, pa.string()), pa.array([len(b) for b in bodies], pa.int64()), pa.array(bodies, pa.binary())], names=["source_path", "size", "content"])

        for name in partition.names:
            with system.open_input_stream(f"{root}/{name}") as source:
                bodies.append(source.read())
            names.append(name)
            held += len(bodies[-1])
            if held >= BATCH_BYTES:
                yield batch()
                names, bodies, held = [], [], 0
        if names:
            yield batch()


class CourseFiles(DataSource):
    """spark.read.format("course_files").load(root); option partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "course_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CourseFilesReader:
        return CourseFilesReader(self.options["path"], int(self.options.get("partitionBytes", PARTITION_BYTES)))


def read(spark: SparkSession, root: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(source_path, size, content)."""
    spark.dataSource.register(CourseFiles)
    return spark.read.format(CourseFiles.name()).option("partitionBytes", str(partition_bytes)).load(root)


def write(files: DataFrame, root: str) -> int:
    """Write rows (source_path, content: binary) as files below a folder of the shared storage; gives their number.

    A file appears whole under its name, also when a task runs twice; rows without a path or content are left out, of rows with one path any wins.
    """
    system, base = opened(root)
    system.create_dir(base, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root)
        n = 0
        for b in batches:
            for name, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                path = f"{base}/{name}"
                system.create_dir(os.path.dirname(path), recursive=True)
                own = f"{path}.{os.urandom(8).hex()}.part"
                with system.open_output_stream(own) as out:
                    out.write(body.as_buffer())
                system.move(own, path)
                n += 1
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    whole = files.select("source_path", "content").where("source_path is not null and content is not null")
    return whole.mapInArrow(run, "n long").agg({"n": "sum"}).first()[0] or 0

"""A Spark data source over media and manifest files in a shared folder: texts up to a cap, and ranged reads of files' first bytes.

    register(spark)
    spark.read.format("media_texts").option("path", "/shared/manifests").load()      # path, size, text, error
    spark.read.format("media_heads").option("path", "/shared/media").load()          # path, size, head

Files are listed once, by name and size; their contents are read by tasks. A file whose size alone says that it is over the cap is an error row and
is never opened.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from reelgrid import constants as K

#: Bytes of files that one task reads, about.
TASK_BYTES = 64 << 20
#: Bytes that a probe asks for.
HEAD_BYTES = 100 << 10


@dataclass
class Files(InputPartition):
    """Files of one task: path and size of each."""

    files: list[tuple[str, int]]


def _found(path: str):
    """The file system of a path or address, and the place in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.suffix = options.get("suffix", "")
        self.task_bytes = int(options.get("task_bytes", TASK_BYTES))

    def cost(self, size: int) -> int:
        """Bytes that a task reads of a file."""
        return size

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, root = _found(self.path)
        listed = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        kept = sorted((i.path, i.size) for i in listed if i.type == fs.FileType.File and i.path.endswith(self.suffix) and not any(p.startswith(("_", ".")) for p in i.path[len(root) :].split("/")))
        out, total = [Files([])], 0
        for path, size in kept:
            if out[-1].files and total + self.cost(size) > self.task_bytes:
                out.append(Files([]))
                total = 0
            out[-1].files.append((path, size))
            total += self.cost(size) + 4096
        return out


class _Texts(_Reader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.most = int(options.get("max_chars", K.MAX_MANIFEST_CHARS))

    def cost(self, size: int) -> int:
        return size if size <= 4 * self.most else 0

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = _found(self.path)
        for path, size in partition.files:
            text = None
            if size <= 4 * self.most:  # a character is four bytes at most: what is larger is too long, whatever it holds
                with system.open_input_stream(path) as f:
                    text = f.read().decode("utf-8", "replace").removeprefix("﻿")
                if len(text.encode("utf-16-le", "surrogatepass")) > 2 * self.most:
                    text = None
            yield path, size, text, None if text is not None else K.SAYS["playlist_large"]


class _Heads(_Reader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.bytes = int(options.get("bytes", HEAD_BYTES))

    def cost(self, size: int) -> int:
        return min(size, self.bytes)

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = _found(self.path)
        for path, size in partition.files:
            with system.open_input_file(path) as f:
                yield path, size, f.read_at(min(size, self.bytes), 0)


class MediaTexts(DataSource):
    """Whole texts of files of at most max_chars UTF-16 units. Options: path, suffix, max_chars, task_bytes."""

    @classmethod
    def name(cls) -> str:
        return "media_texts"

    def schema(self) -> str:
        return "path string, size long, text string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Texts(self.options)


class MediaHeads(DataSource):
    """First bytes of files, read as a range. Options: path, suffix, bytes, task_bytes."""

    @classmethod
    def name(cls) -> str:
        return "media_heads"

    def schema(self) -> str:
        return "path string, size long, head binary"

    def reader(self, schema) -> DataSourceReader:
        return _Heads(self.options)


def register(spark: SparkSession) -> None:
    for source in (MediaTexts, MediaHeads):
        spark.dataSource.register(source)

"""A web page as a sink that leaves one whole page or none.

Tasks write their parts to a staging folder beside the page. When all have succeeded, the parts of
attempts that failed or ran twice are left out, and the folder takes the page's place; when the
job fails it is removed, and a page that was there before stays. The page is its parts end to end.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StringType, StructType


@dataclass
class Part(WriterCommitMessage):
    """What a task wrote: its place in the page, and the file in the staging folder ("" if it had no rows)."""

    number: int
    name: str


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI, or of a local path, which driver and executors have to share."""
    return pafs.FileSystem.from_uri(path if ":/" in path else os.path.abspath(path))


class PageWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.staging = f"{self.path}.staging-{uuid4().hex}"
        files, at = file_system(self.path)
        if not overwrite and files.get_file_info(at).type != pafs.FileType.NotFound:
            raise FileExistsError(f"{self.path} is there already; use mode overwrite")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        context, out = TaskContext.get(), None
        files, at = file_system(self.staging)
        name = f"attempt-{context.partitionId():06d}-{context.taskAttemptId()}"
        for batch in iterator:
            if out is None:
                files.create_dir(at)
                out = files.open_output_stream(f"{at}/{name}")
            out.write("".join(f"{line or ''}\n" for line in batch.column(0).to_pylist()).encode())
        if out is not None:
            out.close()
        return Part(context.partitionId(), name if out is not None else "")

    def commit(self, messages: list[Part | None]) -> None:
        files, at = file_system(self.staging)
        files.create_dir(at)
        for part in messages:
            if part and part.name:
                files.move(f"{at}/{part.name}", f"{at}/part-{part.number:06d}.html")
        for found in files.get_file_info(pafs.FileSelector(at)):
            if not found.base_name.startswith("part-"):
                files.delete_file(found.path)
        page = file_system(self.path)[1]
        before = files.get_file_info(page).type != pafs.FileType.NotFound
        if before:
            files.move(page, f"{at}-before")
        files.move(at, page)
        if before:
            files.delete_dir(f"{at}-before")

    def abort(self, messages: list[Part | None]) -> None:
        files, at = file_system(self.staging)
        if files.get_file_info(at).type != pafs.FileType.NotFound:
            files.delete_dir(at)


class Page(DataSource):
    """``df.write.format("page")``: one column of lines of HTML; "append" needs a new path, "overwrite" replaces the page."""

    @classmethod
    def name(cls) -> str:
        return "page"

    def writer(self, schema: StructType, overwrite: bool) -> PageWriter:
        if [f.dataType for f in schema] != [StringType()]:
            raise ValueError(f"a page is one column of strings, not {schema.simpleString()}")
        return PageWriter(self.options["path"], overwrite)

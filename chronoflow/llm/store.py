"""Files in the folder that all executors share.

The folder and its tables are those of ``chronoflow.sources.shared``. Files are opened through ``pyarrow.fs``, so any scheme
that pyarrow knows (file, hdfs, s3, gs, abfs) works from executors.
"""

from __future__ import annotations

import os
import uuid

from pyarrow import fs as pafs

from chronoflow.sources.shared import cut as written, cut_folder as fresh_folder, drop as dropped, drop_folder as dropped_folder

__all__ = ["Output", "dropped", "dropped_folder", "fresh_folder", "open_fs", "open_input", "written"]


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return pafs.FileSystem.from_uri(uri)


class Output:
    """A file that gets its name only once it is whole, so a lost or repeated task leaves no half file there."""

    def __init__(self, uri: str):
        self.fs, self.path = open_fs(uri)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.sink = self.fs.open_output_stream(self.temp)

    def write(self, data: bytes) -> None:
        self.sink.write(data)

    def close(self) -> None:
        self.sink.close()
        self.fs.move(self.temp, self.path)


def open_input(uri: str):
    fs, path = open_fs(uri)
    return fs.open_input_file(path)

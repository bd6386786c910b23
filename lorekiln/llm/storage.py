"""Files in the shared folder, as Python on executors and driver opens them: plain paths where the folder
is mounted, else whatever store pyarrow reaches by the URI (hdfs, s3, gs ...)."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse


def local_path(uri: str) -> str | None:
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return unquote(parts.path) if parts.scheme else uri
    return None


def writer(uri: str):
    """A new file, open for writing from start to end."""
    if path := local_path(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")  # noqa: SIM115
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    return store.open_output_stream(path)


class Ranges:
    """Reads ranges of a file: from a memory map where the file is mounted, else by range requests."""

    def __init__(self, uri: str):
        self.map = self.file = None
        if path := local_path(uri):
            import mmap

            with open(path, "rb") as f:
                self.size = os.fstat(f.fileno()).st_size
                self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if self.size else b""
        else:
            from pyarrow import fs

            store, path = fs.FileSystem.from_uri(uri)
            self.file = store.open_input_file(path)
            self.size = self.file.size()

    def read(self, offset: int, length: int) -> memoryview:
        if offset < 0 or length < 0 or offset + length > self.size:
            raise ValueError(f"range {offset}+{length} of {self.size} bytes")
        if self.file is None:
            return memoryview(self.map)[offset : offset + length]
        return memoryview(self.file.read_at(length, offset))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.map = self.file = None  # the map goes with the last view of it

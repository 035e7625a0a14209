"""Files in the folder that all executors share, by whatever store its URI names."""

from __future__ import annotations

import uuid


def store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Writer:
    """A file that appears under its name only when it is whole."""

    def __init__(self, uri: str):
        self.fs, self.path = store(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.partial = f"{self.path}.{uuid.uuid4().hex}.partial"
        self.out = self.fs.open_output_stream(self.partial)
        self.at = 0

    def write(self, data: bytes) -> int:
        """Returns where the data begin."""
        began = self.at
        self.out.write(data)
        self.at += len(data)
        return began

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.partial, self.path)


def read_range(handle, offset: int, length: int) -> bytes:
    data = handle.read_at(length, offset)
    if len(data) != length:
        raise EOFError(f"{length} bytes wanted at {offset}, {len(data)} there")
    return data


def open_file(uri: str):
    fs, path = store(uri)
    return fs.open_input_file(path)

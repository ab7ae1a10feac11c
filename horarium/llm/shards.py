"""Files in the shared folder, opened from the executors by URI."""

from __future__ import annotations

import pyarrow.fs as pafs


def open_in(uri: str):
    """A random-access input file."""
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


def write_file(uri: str, data: bytes) -> None:
    """Write a whole file; names are unique to a task attempt, so nothing is overwritten."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(data)

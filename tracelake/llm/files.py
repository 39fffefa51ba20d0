"""Files that tasks write to and read from the shared folder, through any file system URI."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _at(uri: str):
    return fs.FileSystem.from_uri(uri)


def new_file(folder: str, name: str, suffix: str):
    """(uri, output stream) of a file that no other attempt of a task writes.

    Only files in the manifest, which Spark commits, count; what a lost attempt has left is never read.
    """
    uri = f"{folder}/{name}-{uuid.uuid4().hex[:12]}{suffix}"
    system, path = _at(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return uri, system.open_output_stream(path, compression=None)


def open_file(uri: str):
    system, path = _at(uri)
    return system.open_input_file(path)

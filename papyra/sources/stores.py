"""Files of stores that driver and executors share: local paths, file:, hdfs:, s3: and what else pyarrow reads."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:")))


def make(path: str) -> None:
    store, at = _at(path)
    store.create_dir(at, recursive=True)


def kind(path: str) -> str | None:
    """"dir", "file" or None."""
    store, at = _at(path)
    return {fs.FileType.Directory: "dir", fs.FileType.File: "file"}.get(store.get_file_info(at).type)


def opened(path: str):
    """A file to read from its start."""
    store, at = _at(path)
    return store.open_input_file(at)


@contextmanager
def replacing(path: str) -> Iterator:
    """A file to write, there only when complete: a repeated or lost task leaves no half of it."""
    store, at = _at(path)
    part = f"{os.path.dirname(at)}/.{uuid.uuid4().hex}.part"
    try:
        with store.open_output_stream(part) as sink:
            yield sink
    except BaseException:
        if store.get_file_info(part).type != fs.FileType.NotFound:
            store.delete_file(part)
        raise
    store.move(part, at)

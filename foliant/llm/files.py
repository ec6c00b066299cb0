"""Reading and writing plain files of the shared folder from tasks, by any address that Spark's folders have."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO
from urllib.parse import unquote, urlparse


def _local(uri: str) -> str | None:
    u = urlparse(uri)
    return unquote(u.path) if u.scheme == "file" else uri if not u.scheme else None


def make_dir(uri: str) -> None:
    if path := _local(uri):
        os.makedirs(path, exist_ok=True)
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(path, recursive=True)


@contextmanager
def new_file(folder: str, label: str, suffix: str) -> Iterator[tuple[BinaryIO, str]]:
    """A file to write under a name that no other attempt of any task has. It gets that name only when it is whole."""
    name = f"{folder}/{label}-{uuid.uuid4().hex}{suffix}"
    if path := _local(name):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path + ".tmp", "wb") as f:
            yield f, name
        os.replace(path + ".tmp", path)
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(name)
        with store.open_output_stream(path + ".tmp") as f:
            yield f, name
        store.move(path + ".tmp", path)


@contextmanager
def opened(uri: str) -> Iterator[BinaryIO]:
    """A file to read from any place in it."""
    if path := _local(uri):
        with open(path, "rb") as f:
            yield f
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        with store.open_input_file(path) as f:
            yield f

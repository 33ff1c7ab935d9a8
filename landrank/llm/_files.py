"""Files that tasks write and read beside Spark's own tables: any store that both the cluster and pyarrow can open."""

from __future__ import annotations

import uuid

from pyarrow import fs

#: Names that Hadoop gives to stores which pyarrow knows by another name.
_SCHEMES = {"s3a://": "s3://", "s3n://": "s3://", "file:/": "file:///"}


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder or file, and its path there."""
    for hadoop, ours in _SCHEMES.items():
        if uri.startswith(hadoop):
            uri = ours + uri[len(hadoop) :].lstrip("/")
            break
    return fs.FileSystem.from_uri(uri)


def write_file(folder: str, name: str, parts: list[bytes]) -> str:
    """Write a file whose name no other attempt takes, and return where it is.

    A task may run twice; the table of files that Spark commits names those of one attempt, and only they are read.
    """
    store, path = store_of(folder)
    store.create_dir(path, recursive=True)
    own = f"{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(f"{path}/{own}") as out:
        for p in parts:
            out.write(p)
    return f"{folder}/{own}"


def open_file(uri: str):
    store, path = store_of(uri)
    return store.open_input_file(path)

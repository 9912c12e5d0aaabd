"""Read-only arrays that tasks write once and other tasks memory-map.

Every array lies in the shared folder that `spark.checkpoint.dir` names, so it
outlives the executor that wrote it. A task writes under a name of its own and
returns it in a row; names of attempts that failed are in no row, so nobody
reads them. On a mounted folder `mapped` maps the file itself; from an object
store or HDFS it copies the file once per worker into the task's temp folder,
which is a cache that may be lost.
"""

from __future__ import annotations

import io
import math
import mmap
import os
import re
import sys
import tempfile
import uuid

import numpy as np

_MAPPED: dict[str, np.ndarray] = {}


def _local(uri: str) -> str | None:
    if re.match(r"file:/", uri):
        return re.sub(r"^file:/+", "/", uri)
    return None if re.match(r"[a-zA-Z][\w+.-]*:", uri) else uri


def put(folder: str, name: str, array: np.ndarray) -> str:
    """Write one array under a fresh name; returns its address."""
    uri = f"{folder}/{name}-{uuid.uuid4().hex}.npy"
    path = _local(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        np.save(path, array)
        return uri
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    held = io.BytesIO()
    np.save(held, array)
    with store.open_output_stream(path) as out:
        out.write(held.getbuffer())
    return uri


def _map(path: str) -> np.ndarray:
    """The array of a file, read-only. Its file is closed, so a worker can map more arrays than it may open files."""
    with open(path, "rb") as file:
        np.lib.format.read_magic(file)
        shape, _, kind = np.lib.format.read_array_header_1_0(file)
        held = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ, **({"trackfd": False} if sys.version_info >= (3, 13) else {}))
        return np.frombuffer(held, kind, math.prod(shape), file.tell()).reshape(shape)


def mapped(uri: str) -> np.ndarray:
    """The array at an address, memory-mapped; one mapping per worker."""
    if uri not in _MAPPED:
        path = _local(uri)
        if path is None:
            from pyarrow import fs

            store, remote = fs.FileSystem.from_uri(uri)
            path = os.path.join(tempfile.mkdtemp(prefix="blob-"), os.path.basename(remote))
            with store.open_input_stream(remote) as source, open(path, "wb") as copy:
                while chunk := source.read(1 << 24):
                    copy.write(chunk)
        _MAPPED[uri] = _map(path)
    return _MAPPED[uri]

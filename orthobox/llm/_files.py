"""Arrays as files in the shared folder: written once by a task, memory-mapped by the workers that read them."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
from urllib.parse import unquote, urlparse

import numpy as np


def _local(path: str) -> str | None:
    parts = urlparse(path)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def write_array(path: str, array: np.ndarray) -> None:
    """Writes path.npy whole or not at all, so that a task may be repeated."""
    path += ".npy"
    if (local := _local(path)) is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        handle, made = tempfile.mkstemp(dir=os.path.dirname(local))
        with os.fdopen(handle, "wb") as f:
            np.save(f, array)
        os.replace(made, local)
        return
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    out = io.BytesIO()
    np.save(out, array)
    with store.open_output_stream(f"{at}.{os.getpid()}") as f:
        f.write(out.getbuffer())
    store.move(f"{at}.{os.getpid()}", at)


def map_array(path: str) -> np.ndarray:
    """path.npy, memory-mapped; from a store that is no file system it is copied to the worker's own folder first."""
    path += ".npy"
    local = _local(path)
    if local is None:
        from pyarrow import fs

        local = os.path.join(tempfile.gettempdir(), hashlib.sha256(path.encode()).hexdigest() + ".npy")
        if not os.path.exists(local):
            store, at = fs.FileSystem.from_uri(path)
            handle, made = tempfile.mkstemp(dir=os.path.dirname(local))
            with os.fdopen(handle, "wb") as f, store.open_input_stream(at) as g:
                while part := g.read(1 << 24):
                    f.write(part)
            os.replace(made, local)
    got = np.load(local, mmap_mode="r")
    return got

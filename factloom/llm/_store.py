"""Arrays in files of the shared folder, mapped into memory by the workers that read them."""

from __future__ import annotations

import atexit
import fcntl
import hashlib
import os
import tempfile
import uuid
from urllib.parse import unquote, urlparse

import numpy as np


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def put(uri: str, array: np.ndarray) -> None:
    """Whole or not at all, so that a repeated task does no harm."""
    path = _local(uri)
    if path is None:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        system.create_dir(os.path.dirname(path))
        with system.open_output_stream(path) as out:
            out.write(np.ascontiguousarray(array).data)
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    np.ascontiguousarray(array).tofile(part)
    os.replace(part, path)


def mapped(uri: str, kind: type) -> np.ndarray:
    """Read-only array on the file; of a remote folder, on a copy that all workers of a machine share."""
    path = _local(uri)
    if path is None:
        path = _copied(uri)
    return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)


#: Copies that this process holds, by address.
_held: dict[str, tuple[str, int]] = {}


def _copied(uri: str) -> str:
    """The first worker that asks copies the file, the others wait for it; the last that ends removes it."""
    if uri not in _held:
        name = hashlib.sha256(uri.encode()).hexdigest()[:32]
        path = os.path.join(tempfile.gettempdir(), f"factloom-{os.getuid()}-{name}")
        lock = os.open(f"{path}.lock", os.O_RDWR | os.O_CREAT, 0o600)
        fcntl.flock(lock, fcntl.LOCK_SH)
        while not os.path.exists(path):
            fcntl.flock(lock, fcntl.LOCK_EX)
            if not os.path.exists(path):
                from pyarrow import fs

                system, remote = fs.FileSystem.from_uri(uri)
                with system.open_input_stream(remote) as source, open(f"{path}.part", "wb") as copy:
                    while block := source.read(8 << 20):
                        copy.write(block)
                os.replace(f"{path}.part", path)
            fcntl.flock(lock, fcntl.LOCK_SH)  # another may end and remove it meanwhile
        _held[uri] = (path, lock)
    return _held[uri][0]


@atexit.register
def _dropped() -> None:
    for path, lock in _held.values():
        try:
            fcntl.flock(lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
            os.remove(path)
        except OSError:  # others still use it
            pass
        os.close(lock)
    _held.clear()

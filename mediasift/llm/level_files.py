"""Files of named arrays that tasks write to shared storage and map into memory."""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile

import numpy as np
from pyarrow import fs

MAGIC = b"MSLEVELS"
LOCAL_BYTES = 4 << 30
_local: dict[str, str] = {}
_folder: list[str] = []


def write(root: str, name: str, arrays: dict[str, np.ndarray], meta: dict) -> None:
    sections, body, at = {}, [], 0
    for k, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        sections[k] = [at, len(a), a.dtype.str]
        body += [raw, b"\0" * (-len(raw) % 64)]
        at += len(raw) + -len(raw) % 64
    head = json.dumps({"meta": meta, "sections": sections}).encode()
    head += b" " * (-(len(head) + 16) % 64)
    files, folder = fs.FileSystem.from_uri(root)
    files.create_dir(folder, recursive=True)
    with files.open_output_stream(f"{folder}/{name}") as f:
        for part in (MAGIC, np.uint64(len(head)).tobytes(), head, *body):
            f.write(part)


def read(root: str, name: str) -> tuple[dict[str, np.ndarray], dict]:
    """The arrays as memory maps. A file of a remote store is copied when it is first asked for; a worker keeps
    copies of at most ``LOCAL_BYTES``, and drops those asked for longest ago."""
    files, folder = fs.FileSystem.from_uri(root)
    path = f"{folder}/{name}"
    if not isinstance(files, fs.LocalFileSystem):
        copy = _local.pop(path, None)
        if copy is None:
            if not _folder:
                _folder.append(tempfile.mkdtemp(prefix="levels-"))
                atexit.register(shutil.rmtree, _folder[0], ignore_errors=True)
            handle, copy = tempfile.mkstemp(dir=_folder[0])
            with files.open_input_stream(path) as src, os.fdopen(handle, "wb") as out:
                shutil.copyfileobj(src, out, 1 << 22)
        _local[path] = copy  # the latest last
        while len(_local) > 1 and sum(map(os.path.getsize, _local.values())) > LOCAL_BYTES:
            os.unlink(_local.pop(next(iter(_local))))
        path = copy
    if os.path.getsize(path) < 16:
        raise ValueError(f"{path} is not a level file")
    data = np.asarray(np.memmap(path, np.uint8, "r"))  # a plain array over the mapped pages
    if bytes(data[:8]) != MAGIC:
        raise ValueError(f"{path} is not a level file")
    n = int(data[8:16].view("<u8")[0])
    head = json.loads(bytes(data[16 : 16 + n]))
    base = 16 + n
    return {k: data[base + at : base + at + size * np.dtype(kind).itemsize].view(kind) for k, (at, size, kind) in head["sections"].items()}, head["meta"]

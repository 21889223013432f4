"""Opening files by path or address, on the driver and on executors.

A plain path is on the local disk or one mounted there; an address (``file://``, ``s3://``, ``hdfs://`` and so on) goes
through Arrow's file systems, which need no JVM.
"""

from __future__ import annotations

import glob
import os
from typing import BinaryIO


def _at(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def found(pattern: str) -> list[str]:
    """The files of a comma-separated list of patterns, sorted; an address stands for itself."""
    return sorted(p for part in pattern.split(",") for p in ([part] if "://" in part else glob.glob(part)))


def reading(path: str) -> BinaryIO:
    """A seekable binary file."""
    if "://" not in path:
        return open(path, "rb")
    fs, p = _at(path)
    return fs.open_input_file(p)


def writing(path: str) -> BinaryIO:
    if "://" not in path:
        return open(path, "wb")
    fs, p = _at(path)
    return fs.open_output_stream(p)


def rename(old: str, new: str) -> None:
    if "://" not in old:
        return os.replace(old, new)
    fs, p = _at(old)
    fs.move(p, _at(new)[1])


def remove(path: str) -> None:
    """Does nothing if there is no such file."""
    if "://" not in path:
        if os.path.exists(path):
            os.remove(path)
        return
    from pyarrow import fs as kinds

    fs, p = _at(path)
    if fs.get_file_info(p).type != kinds.FileType.NotFound:
        fs.delete_file(p)

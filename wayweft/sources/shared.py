"""Binary files that every executor can read: a path of the shared file system, or a URI such as hdfs:// or s3://."""

from __future__ import annotations

import os


def _place(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _local(path: str) -> str:
    """file:/folder, as Hadoop writes it, is a path of the shared file system like any other."""
    return path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path


def open_shared(path: str):
    """A seekable binary file."""
    path = _local(path)
    if "://" in path:
        system, inner = _place(path)
        return system.open_input_file(inner)
    return open(path, "rb")


def files_below(path: str) -> list[str]:
    """All files below a folder, in order; none if there is no such folder."""
    path = _local(path)
    if "://" in path:
        from pyarrow import fs

        system, inner = _place(path)
        head = path[: len(path) - len(inner)] if path.endswith(inner) else path.split("://")[0] + "://"
        return sorted(head + f.path for f in system.get_file_info(fs.FileSelector(inner, allow_not_found=True, recursive=True)) if f.is_file)
    return sorted(os.path.join(folder, f) for folder, _, files in os.walk(path) for f in files)


def exists(path: str) -> bool:
    path = _local(path)
    if "://" in path:
        system, inner = _place(path)
        return system.get_file_info(inner).is_file
    return os.path.exists(path)


def size_of(path: str) -> int:
    if "://" in path:
        system, inner = _place(path)
        return system.get_file_info(inner).size
    return os.path.getsize(path)

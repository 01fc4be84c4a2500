"""Random access to files of any file system that Arrow knows, local paths included."""

from __future__ import annotations

import re
from typing import BinaryIO

from pyarrow import fs


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def open_input(path: str) -> BinaryIO:
    system, where = _place(path)
    return system.open_input_file(where)


def write_bytes(path: str, data: bytes) -> None:
    """Writes a whole file beside its place and moves it there, so that a task that runs again or dies leaves no half."""
    system, where = _place(path)
    parent = where.rsplit("/", 1)[0]
    system.create_dir(parent, recursive=True)
    half = f"{parent}/.{where.rsplit('/', 1)[1]}.part"
    with system.open_output_stream(half) as f:
        f.write(data)
    system.move(half, where)


def listed(paths: str, pattern: str) -> list[str]:
    """Files of comma-separated paths; of a folder those below it whose names match, hidden copies (``._``) left out, sorted."""
    out = []
    for path in paths.split(","):
        system, where = _place(path)
        info = system.get_file_info(where)
        if info.type == fs.FileType.Directory:
            prefix = path[: len(path) - len(where)] if path.endswith(where) else ""
            found = system.get_file_info(fs.FileSelector(where, recursive=True))
            out += [prefix + f.path for f in found if f.type == fs.FileType.File and re.search(pattern, f.path, re.I) and not f.base_name.startswith("._")]
        else:
            out.append(path)
    return sorted(set(out))

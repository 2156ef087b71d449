"""Files of any file system that pyarrow opens, for tasks that read or write them directly."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a URI or a local path."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def put(system: fs.FileSystem, path: str, data: bytes) -> None:
    """Writes a file that readers see whole or not at all."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as f:
        f.write(data)
    system.move(part, path)


def listed(system: fs.FileSystem, root: str, end: str) -> list[fs.FileInfo]:
    """The files in ``root`` whose names end so; none if it isn't there."""
    return [i for i in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.type == fs.FileType.File and i.path.endswith(end)]

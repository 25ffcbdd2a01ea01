"""Files of a folder for Python data sources: local paths and stores pyarrow knows."""

from __future__ import annotations

from pyarrow import fs


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path on it."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def sizes(system: fs.FileSystem, path: str) -> dict[str, int]:
    """Sizes of a file, or of the files of a folder whose names begin with neither a dot nor an underscore."""
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return {path: info.size}
    files = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return {f.path: f.size for f in files if f.type == fs.FileType.File and f.base_name[:1] not in "._"}

"""Files by path or address (file, hdfs, s3, gs), as tasks on executors open them."""

from __future__ import annotations

import re
import uuid
from urllib.parse import unquote

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), unquote(re.sub(r"^file:/+", "/", path))
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def opened(path: str):
    """A file to read from, with seek and tell; only what is read is fetched."""
    system, at = located(path)
    return system.open_input_file(at)


def exists(path: str) -> bool:
    system, at = located(path)
    return system.get_file_info(at).type != fs.FileType.NotFound


def put(path: str, data, chunk: int = 1 << 22) -> int:
    """Writes bytes, or what a file has, and gives their number. The file appears whole; doing it again leaves the same file."""
    system, at = located(path)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    part, n = f"{at}.{uuid.uuid4().hex}.part", 0
    with system.open_output_stream(part) as out:
        if isinstance(data, bytes):
            n = len(data)
            out.write(data)
        else:
            while block := data.read(chunk):
                n += len(block)
                out.write(block)
    if not isinstance(system, fs.LocalFileSystem) and system.get_file_info(at).type != fs.FileType.NotFound:
        system.delete_file(at)  # elsewhere a move does not replace
    system.move(part, at)
    return n

"""Files in the shared scratch folder, written and read by tasks."""

from __future__ import annotations

import pyarrow.fs as pafs


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI: file, hdfs, s3, gs."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


def write_bytes(uri: str, data: bytes) -> None:
    """Write a whole file under another name, then move it into place."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(f"{path}.part", compression=None) as out:
        out.write(data)
    fs.move(f"{path}.part", path)


def read_bytes(uri: str) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_stream(path, compression=None) as source:
        return source.read()

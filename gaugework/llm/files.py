"""Files that tasks write to and read from the shared folder, by its URI (local paths, HDFS or an object store)."""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow.fs as pafs
import pyarrow.parquet as pq


def at(uri: str) -> tuple[pafs.FileSystem, str]:
    """A whole URI's file system and path; a path alone is refused, as Spark and this machine could take it for different ones."""
    if "://" not in uri:
        raise ValueError(f"{uri}: a URI with its file system is needed")
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if uri.startswith("s3a://") else uri)


def make_dir(uri: str) -> None:
    fs, path = at(uri)
    fs.create_dir(path, recursive=True)


def listed(uri: str, suffix: str) -> list[tuple[str, int]]:
    """Names and sizes of the finished files in a folder, by name."""
    fs, path = at(uri)
    found = fs.get_file_info(pafs.FileSelector(path))
    return sorted((f.base_name, f.size) for f in found if f.is_file and f.base_name.endswith(suffix))


class Put:
    """A file under another name until it is whole: a lost or repeated attempt leaves no half file under its name."""

    def __init__(self, folder: str, name: str):
        self.fs, path = at(folder)
        self.final, self.temp = f"{path}/{name}", f"{path}/.{name}.{uuid.uuid4().hex}"

    def __enter__(self) -> io.BufferedWriter:
        self.raw = self.fs.open_output_stream(self.temp)
        return self.raw

    def __exit__(self, kind, *_):
        self.raw.close()
        if kind is None:
            self.fs.move(self.temp, self.final)
        else:
            self.fs.delete_file(self.temp)


def read(folder: str, name: str) -> bytes:
    fs, path = at(folder)
    with fs.open_input_stream(f"{path}/{name}") as f:
        return f.read()


def column(uri: str, name: str) -> np.ndarray:
    """A number column of all Parquet files of a folder, which must be there."""
    fs, path = at(uri)
    found = [f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.is_file and f.base_name.endswith(".parquet")]
    parts = [pq.read_table(f, columns=[name], filesystem=fs).column(name).to_numpy() for f in sorted(found)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)

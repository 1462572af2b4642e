"""Files in the shared folder, written and read by executors."""

from __future__ import annotations

import os

import pyarrow.fs as pafs


def place(uri: str):
    """File system and path of a URI or a local path."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else os.path.abspath(uri))


def writer(uri: str):
    fs, path = place(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(path, compression=None)


def reader(uri: str):
    fs, path = place(uri)
    return fs.open_input_stream(path, compression=None)

"""Folders: the one that all executors see, and checks of those that results are to go to.

Checks ask the file system of a path through Spark, so they hold for any store that Spark can write to.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

from ..functions.text import CHARS_PER_SECOND, WAV_BYTES_PER_SECOND, WORKING_COPIES

#: Folders that are offered, below a home folder.
OFFERED = {"desktop": "Desktop/Audiobooks", "downloads": "Downloads/Audiobooks", "documents": "Documents/Audiobooks"}


class Refused(ValueError):
    """A folder won't do: its path is relative, a file is there, or there is too little space."""


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder under spark.checkpoint.dir. A local master without that setting gets a temporary one; a cluster an
    error, since its executors would each write to a disk of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/tomeflow-shared"
    return f"{found.rstrip('/')}/{name}"


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def offered_folders(home: str) -> dict[str, str]:
    return {key: f"{home.rstrip('/')}/{tail}" for key, tail in OFFERED.items()}


def checked_folder(spark: SparkSession, asked: str | None) -> str | None:
    """The folder that is asked for, with ~ for the home folder; None for a blank one."""
    asked = (asked or "").strip()
    if not asked:
        return None
    folder = os.path.expanduser(asked)
    if not folder.startswith("/") and "://" not in folder and not folder.startswith("file:/"):
        raise Refused(f"a full path is needed, not {asked!r}")
    files, path = _file_system(spark, folder)
    if files.exists(path) and not files.getFileStatus(path).isDirectory():
        raise Refused(f"that is a file, not a folder: {folder}")
    return folder


def free_bytes(spark: SparkSession, folder: str) -> int:
    """Free space where folder is, or would be."""
    files, path = _file_system(spark, folder)
    while not files.exists(path) and path.getParent() is not None:
        path = path.getParent()
    return files.getStatus(path).getRemaining()


def check_space(spark: SparkSession, folder: str, n_chars: int) -> None:
    """Refuses a folder without room for the working copies of so many characters of speech."""
    needed, free = int(n_chars / CHARS_PER_SECOND * WAV_BYTES_PER_SECOND * WORKING_COPIES), free_bytes(spark, folder)
    if free < needed:
        raise Refused(f"not enough space: about {needed / 1e9:.1f} GB needed, {free / 1e9:.1f} GB free")

"""Raw files that tasks write to and read from the folder all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from ..session import ensure_checkpoint_dir


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder name under ``spark.checkpoint.dir``, or under the session's own one if that is unset."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        ensure_checkpoint_dir(spark)
        top = spark.sparkContext.getCheckpointDir()
    return f"{top.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def opened(folder: str):
    """(file system, path) of a folder given as a plain path or a URI."""
    from pyarrow import fs

    if folder.startswith("/"):
        return fs.LocalFileSystem(), folder
    if folder.startswith("file:"):  # file:/x as well as file:///x
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder)


def remove(folder: str) -> None:
    """Delete a folder that nothing reads any more, if it is there."""
    files, path = opened(folder)
    files.delete_dir_contents(path, missing_dir_ok=True)


def release(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of finished steps now.

    It removes them when the driver collects its garbage, which a driver with little to do does seldom.
    """
    spark.sparkContext._jvm.System.gc()


class Target:
    """A file that gets its final name only when it is complete.

    Until then it has a name of its own, so readers never meet half a file. Callers put the task attempt into
    the final name: of two attempts, only the one whose rows are used is ever read.
    """

    def __init__(self, folder: str, name: str):
        self._files, path = opened(folder)
        self._files.create_dir(path, recursive=True)
        self._final = f"{path}/{name}"
        self._mine = f"{self._final}.{uuid.uuid4().hex}.part"
        self._stream = self._files.open_output_stream(self._mine)
        self.length = 0

    def write(self, data) -> None:
        self._stream.write(data)
        self.length += len(data)

    def finish(self) -> None:
        self._stream.close()
        self._files.move(self._mine, self._final)

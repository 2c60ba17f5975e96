"""Folders that all executors share."""

from __future__ import annotations

import re
import tempfile
import time
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in ``spark.checkpoint.dir``; where that is unset and the master is local, in a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sluice-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/sluice-{tag}-{uuid.uuid4().hex}"


class SharedFiles:
    """Small files of one folder, wherever Spark can write: through the Hadoop file system of its path."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm = spark._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(folder)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _of(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.path, name)

    def listed(self) -> list[tuple[str, float]]:
        """Names of the files and folders, and when each was last changed (seconds)."""
        if not self.fs.exists(self.path):
            return []
        return [(x.getPath().getName(), x.getModificationTime() / 1000) for x in self.fs.listStatus(self.path)]

    def names(self) -> list[str]:
        return [n for n, _ in self.listed()]

    def write(self, name: str, text: str) -> None:
        """Appears whole under its name; one that is there already is an error."""
        if self.fs.exists(self._of(name)):
            raise FileExistsError(name)
        part = self._of(f".{name}.{uuid.uuid4().hex}")
        out = self.fs.create(part)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.rename(part, self._of(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._of(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def remove(self, name: str) -> None:
        self.fs.delete(self._of(name), True)


def clean(spark: SparkSession, older_than: float = 86400.0, folder: str | None = None) -> list[str]:
    """Removes intermediate tables (``sluice-*``) of the shared folder, or another one, that were last changed so many seconds ago; returns their names.

    Only for ones that no running job reads.
    """
    files = SharedFiles(spark, folder or shared_path(spark, "none").rpartition("/")[0])
    gone = [n for n, changed in files.listed() if n.startswith("sluice-") and changed < time.time() - older_than]
    for n in gone:
        files.remove(n)
    return sorted(gone)

"""A commit log: numbered JSON entries in a folder, each published by one rename.

A table whose files lie in folders of its own is what its log says: readers
take the folders that committed entries add and no entry removes, so a folder
that an interrupted job left behind is never read.  An entry is written under a
temporary name and renamed to the next number; the rename fails when another
writer was first, who then decides anew on what the log now says.  An entry
with ``snapshot`` holds the whole state, entries before it are not read again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from py4j.protocol import Py4JJavaError


class CommitLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self):
        return self._path().getFileSystem(self._conf)

    def numbers(self) -> list[int]:
        fs = self._fs()
        if not fs.exists(self._path()):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(self._path())]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def entries(self) -> tuple[int, list[dict]]:
        """(number of the last entry or -1, entries from the last snapshot on)."""
        numbers, found, fs = self.numbers(), [], self._fs()
        for n in reversed(numbers):
            stream = fs.open(self._path(f"{n:08d}.json"))
            try:
                found.append(json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
            if found[-1].get("snapshot"):
                break
        return (numbers[-1] if numbers else -1), found[::-1]

    def commit(self, entry: dict, after: int) -> bool:
        """Publish ``entry`` as the one after number ``after``; False when another writer has published that number."""
        fs, held = self._fs(), self._path(f".{uuid.uuid4().hex}.tmp")
        fs.mkdirs(self._path())
        stream = fs.create(held, False)
        try:
            stream.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
        finally:
            stream.close()
        if not rename(self.spark, held.toString(), f"{self.root}/{after + 1:08d}.json"):
            fs.delete(held, False)
            return False
        return True


def rename(spark: SparkSession, held: str, path: str) -> bool:
    """Give a file or folder its name; False when the name is taken."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    a, b = hadoop.Path(held), hadoop.Path(path)
    fs = a.getFileSystem(conf)
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        hadoop.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(a), fs.makeQualified(b), options)
    except (Py4JJavaError, PySparkException) as e:
        if "FileAlreadyExistsException" in str(e):
            return False
        raise
    return True


def delete(spark: SparkSession, path: str) -> None:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def exists(spark: SparkSession, path: str) -> bool:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath))


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder (none, if it is not there)."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(hpath)) if fs.exists(hpath) else []

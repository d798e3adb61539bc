"""Small files through Hadoop's file systems, so a store can be anywhere Spark reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        p, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        p, fs = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Makes a new file, whole from its first moment; False if there is one of that name.

        It is written under another name and renamed without overwriting, so
        the file system's rename must be atomic, as those of HDFS and local
        disks are.
        """
        target, fs = self._at(path)
        folder = target.getParent()
        fs.mkdirs(folder)
        draft = self.jvm.org.apache.hadoop.fs.Path(folder, f".{target.getName()}.{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        kind = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf).rename(draft, target, how)
        except Exception as e:  # the file system says it in its own class
            fs.delete(draft, False)
            if "AlreadyExists" in str(e):
                return False
            raise
        return True

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors share; a temporary one only where they are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    got = spark.sparkContext._jsc.sc().getCheckpointDir()
    if got.isDefined():
        return got.get().rstrip("/")
    if not (spark.sparkContext.master or "").split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tabulon-')}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")

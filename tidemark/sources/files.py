"""Small files and folders on any file system Spark knows, through its own client."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream).decode()
        finally:
            stream.close()

    def write_new(self, path: str, text: str) -> bool:
        """Write a file that must not exist, whole or not at all; False if another was quicker."""
        fs, p = self._at(path)
        fs.mkdirs(p.getParent())
        draft = self.jvm.org.apache.hadoop.fs.Path(p.getParent(), f".draft-{self.jvm.java.util.UUID.randomUUID()}")
        stream = fs.create(draft)
        stream.write(bytearray(text.encode()))
        stream.close()
        if fs.exists(p) or not fs.rename(draft, p):
            fs.delete(draft, False)
            return False
        return True

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def age(self, path: str) -> float:
        """Seconds since the last change."""
        fs, p = self._at(path)
        return (self.jvm.System.currentTimeMillis() - fs.getFileStatus(p).getModificationTime()) / 1000

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

"""Files of the catalog on any file system that Spark knows: local, HDFS or an object store."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Storage:
    """Small files and folders, through Hadoop's file systems; data itself goes through Spark."""

    def __init__(self, spark: SparkSession) -> None:
        self._jvm, self._gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _system(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        return self._system(path).exists(self._path(path))

    def folders(self, path: str) -> list[str]:
        """Names of the visible folders inside, sorted."""
        if not self.exists(path):
            return []
        found = self._system(path).listStatus(self._path(path))
        return sorted(f.getPath().getName() for f in found if f.isDirectory() and f.getPath().getName()[0] not in "._")

    def make(self, path: str) -> None:
        self._system(path).mkdirs(self._path(path))

    def read(self, path: str) -> str:
        stream = self._system(path).open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def create(self, path: str, text: str, overwrite: bool) -> bool:
        """Writes a file; False if it is there and may not be overwritten."""
        try:
            stream = self._system(path).create(self._path(path), overwrite)
        except Exception as e:
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        return True

    def replace(self, path: str, text: str) -> None:
        """Writes a file so that readers see the old text or the new one."""
        temporary = f"{path}.tmp"
        self.create(temporary, text, True)
        options = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        source = self._system(path).makeQualified(self._path(temporary))
        target = self._system(path).makeQualified(self._path(path))
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf).rename(source, target, options)

    def move(self, source: str, target: str) -> None:
        if not self._system(source).rename(self._path(source), self._path(target)):
            raise OSError(f"can't move {source} to {target}")

    def delete(self, path: str) -> None:
        self._system(path).delete(self._path(path), True)

    def bytes(self, path: str) -> int:
        return self._system(path).getContentSummary(self._path(path)).getLength()

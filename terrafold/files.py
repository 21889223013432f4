"""Small files and folders on any file system that Hadoop knows, seen from the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """Paths may have a scheme (hdfs, s3a, file) or none, which means the session's default file system."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def makedirs(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def names(self, folder: str) -> list[str]:
        fs, p = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        if not fs.exists(p):
            raise FileNotFoundError(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str, new: bool = False) -> None:
        """new: fail if the file exists, in one step with its creation."""
        fs, p = self._at(path)
        stream = fs.create(p, not new)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def replace(self, path: str, text: str) -> None:
        """Write aside and rename over the old file, so that readers see the whole old or the whole new text."""
        self.write(f"{path}.tmp", text)
        Path, fc = self._jvm.org.apache.hadoop.fs.Path, self._jvm.org.apache.hadoop.fs.FileContext
        kind = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._jvm.java.lang.reflect.Array.newInstance(kind.OVERWRITE.getClass(), 1)
        self._jvm.java.lang.reflect.Array.set(options, 0, kind.OVERWRITE)
        at = Path(path).getFileSystem(self._conf).makeQualified(Path(path))
        fc.getFileContext(at.toUri(), self._conf).rename(Path(f"{path}.tmp"), Path(path), options)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

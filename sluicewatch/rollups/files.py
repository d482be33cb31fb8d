"""A folder on whatever file system its path names."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Written last into the folder of a finished write.
DONE = "_SUCCESS"


class Folder:
    """Names, small texts and removal; data goes through Spark's readers and writers."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._jvm = spark._jvm
        self._files = self._at().getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: object):
        return self._jvm.org.apache.hadoop.fs.Path(self.of(*parts))

    def of(self, *parts: object) -> str:
        return "/".join([self.path, *map(str, parts)])

    def has(self, *parts: object) -> bool:
        return self._files.exists(self._at(*parts))

    def names(self, *parts: object) -> list[str]:
        """Names in a folder, in order; none if it is not there."""
        if not self.has(*parts):
            return []
        return sorted(x.getPath().getName() for x in self._files.listStatus(self._at(*parts)))

    def read(self, *parts: object) -> str:
        stream = self._files.open(self._at(*parts))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, text: str, *parts: object) -> None:
        """Write a text that readers see whole or not at all; there must be none yet."""
        draft = (*parts[:-1], f".{parts[-1]}.draft")
        stream = self._files.create(self._at(*draft), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.has(*parts) or not self._files.rename(self._at(*draft), self._at(*parts)):
            raise FileExistsError(self.of(*parts))

    def remove(self, *parts: object) -> None:
        self._files.delete(self._at(*parts), True)

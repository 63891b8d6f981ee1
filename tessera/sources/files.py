"""Files through Hadoop's FileSystem, so that a table's root may be in any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str, overwrite: bool = True) -> None:
        """Writes a file; without overwrite an existing one is an error, as locks need."""
        stream = self.fs.create(self.path(name), overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Replaces a file by a rename, so that readers see the old one or the new one."""
        self.create(f"{name}.new", text)
        target = self.path(name)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
        options[0] = rename.OVERWRITE
        context.rename(self.path(f"{name}.new"), target, options)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def delete_uri(self, uri: str) -> None:
        self.fs.delete(self.jvm.org.apache.hadoop.fs.Path(uri), True)

    def list(self, name: str) -> list[tuple[str, bool, int]]:
        """(URI, whether it is a folder, bytes) of what is in a folder."""
        if not self.exists(name):
            return []
        return [(s.getPath().toString(), s.isDirectory(), s.getLen()) for s in self.fs.listStatus(self.path(name))]

    def size(self, name: str = "") -> int:
        return self.fs.getContentSummary(self.path(name)).getLength() if self.exists(name) else 0

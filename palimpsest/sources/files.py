"""Small text files in any store that Spark can reach, through Hadoop's file systems."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def step(df: DataFrame, path: str) -> DataFrame:
    """The rows of a DataFrame written and read again, so that nothing computes them twice; as few bytes as Spark's writers can make of them."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Files:
    """Reads and makes small files; tables themselves go through DataFrames."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark.sparkContext._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Make a file that isn't there, whole or not at all; False if it is there. Of several writers one succeeds."""
        fs, p = self._at(path)
        fs.mkdirs(p.getParent())
        _, draft = self._at(f"{path}.{uuid.uuid4().hex}.draft")
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            if fs.getScheme() == "file":  # a link isn't made over a file
                os.link(draft.toUri().getPath(), p.toUri().getPath())
            else:  # a rename that doesn't overwrite
                options = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self._conf).rename(draft, p, options)
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception):
                return False
            raise
        finally:
            fs.delete(draft, False)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

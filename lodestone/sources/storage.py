"""Small files and folders on Spark's file systems, so that an index may lie wherever its tables can."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def _place(spark: SparkSession, path: object) -> tuple:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: object) -> bool:
    fs, place = _place(spark, path)
    return fs.exists(place)


def names(spark: SparkSession, path: object) -> list[str]:
    """What lies directly in a folder; nothing if there is none."""
    fs, place = _place(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(place)) if fs.exists(place) else []


def read_text(spark: SparkSession, path: object) -> str | None:
    """A file's text, or None if it can't be read."""
    fs, place = _place(spark, path)
    try:
        stream = fs.open(place)
        try:
            return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
    except Py4JJavaError:
        return None


def write_text(spark: SparkSession, path: object, text: str) -> None:
    """Writes beside the file and puts that in its place, so that a reader sees the old or the new, never a part."""
    fs, place = _place(spark, path)
    fs.setWriteChecksum(False)
    part = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{place.getName()}.part")
    stream = fs.create(part, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(part), fs.makeQualified(place), options)


def delete(spark: SparkSession, path: object) -> None:
    fs, place = _place(spark, path)
    fs.delete(place, True)


def place(spark: SparkSession, kind: str = "star") -> str:
    """A new folder in the shared one of spark.checkpoint.dir; a session without that, as in tests, gets a temporary one, deleted at its end."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, root, True)
    return f"{root}/{kind}-{uuid.uuid4().hex}"


class Tables:
    """Tables written in a place of their own, which cut lineage; those that aren't to be kept go with close()."""

    def __init__(self, spark: SparkSession, kind: str):
        self.spark, self.root, self.n = spark, place(spark, kind), 0

    def table(self, df: DataFrame, to: str | None = None) -> DataFrame:
        self.n += 1
        to = to or f"{self.root}/{self.n}"
        df.write.parquet(to)
        return self.spark.read.schema(df.schema).parquet(to)

    def keep(self, df: DataFrame) -> DataFrame:
        return self.table(df, place(self.spark, "kept"))

    def close(self) -> None:
        delete(self.spark, self.root)

"""An append-only log of tables: what is added together is there together, or not at all.

Tables are written by Spark under data/, each addition in a folder of its own. Only then one small
file under log/ names them; readers see an addition from the moment that file has got its name. A
writer that breaks off before leaves a folder that nobody reads and that blocks nothing."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import qualified

_FIRST = "0" * 20


class Files:
    """The few calls of Hadoop's file systems that the log needs, for any of them."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self.root = qualified(spark, path).rstrip("/")
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return bytes(self._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Whether a file of that name is there now that was not before, with the whole text."""
        draft, final = self._path(f"{self.root}/drafts/{uuid.uuid4().hex}"), self._path(f"{self.root}/{name}")
        stream = self._fs.create(draft)
        stream.write(bytearray(text.encode()))
        stream.close()
        self._fs.mkdirs(final.getParent())
        done = not self._fs.exists(final) and self._fs.rename(draft, final)
        if not done:
            self._fs.delete(draft, False)
        return bool(done)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)


def append(spark: SparkSession, path: str, tables: dict[str, DataFrame], first: bool = False) -> str:
    """Add rows to several tables of the log at once; returns the number of the addition. first:
    the log must be empty, and of several that begin it at a time one wins and the others raise,
    where the file system's rename does not replace (HDFS; a local one may, within an instant)."""
    files = Files(spark, path)
    number = _FIRST if first else f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    folder = f"data/{number}-{uuid.uuid4().hex}"
    if first and files.names("log"):
        raise FileExistsError(f"{path} has a record already")
    try:
        for name, rows in tables.items():
            rows.withColumn("added", F.lit(number)).write.parquet(f"{files.root}/{folder}/{name}")
        if not files.publish(f"log/{number}.json", json.dumps({"folder": folder, "tables": {k: df.withColumn("added", F.lit(number)).schema.jsonValue() for k, df in tables.items()}})):
            raise FileExistsError(f"{path} has a record already")
    except BaseException:
        files.delete(folder)
        raise
    return number


def read(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """All rows added to a table, with `added`, the number of the addition (later ones are
    greater); None where there are none yet."""
    from pyspark.sql import types as T

    files = Files(spark, path)
    found, schema = [], None
    for entry in files.names("log"):
        said = json.loads(files.read(f"log/{entry}"))
        if name in said["tables"]:
            found.append(f"{files.root}/{said['folder']}/{name}")
            schema = T.StructType.fromJson(said["tables"][name])
    return spark.read.schema(schema).parquet(*found) if found else None


def exists(spark: SparkSession, path: str) -> bool:
    return bool(Files(spark, path).names("log"))


def count(spark: SparkSession, path: str, name: str) -> int:
    """How many additions to a table there are."""
    files = Files(spark, path)
    return sum(name in json.loads(files.read(f"log/{entry}"))["tables"] for entry in files.names("log"))

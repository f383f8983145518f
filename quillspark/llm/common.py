"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a
    session on a single machine (tests) gets a new temporary folder; on a cluster it is an error, as
    no folder of the driver's is seen by the executors."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not re.match(r"local($|\[)", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share (master {master})")
        found = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    if ":" not in found:  # a path of the cluster's default file system
        path = spark._jvm.org.apache.hadoop.fs.Path(found)
        found = str(path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path))
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quillspark/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df to a new Parquet table in the shared folder and read it back: this cuts the
    lineage, so a lost executor costs a reread and no recomputation."""
    path = new_path(df.sparkSession, name)
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")  # the shuffle files of this write go when it has ended
    try:
        df.write.parquet(path)
    finally:
        conf.set(key, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table() that no later step reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def settle(spark: SparkSession) -> None:
    """Let the driver's JVM drop the plans and compiled code of finished steps. After dozens of
    writes it would otherwise grow to its full heap before it collects them."""
    spark._jvm.System.gc()


@contextmanager
def unchecked(spark: SparkSession) -> Iterator[None]:
    """Sums, products and casts of the frames made within are not checked for overflow, as ANSI mode
    does at every use. For values that cannot overflow: their results are the same."""
    key = "spark.sql.ansi.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fresh(df: DataFrame, n: int) -> list[str]:
    """n names that no column of df has, whatever the case of their letters."""
    taken = {c.lower() for c in df.columns}
    free = (name for i in range(len(taken) + n) if (name := f"_own{i}") not in taken)
    return [next(free) for _ in range(n)]


def quoted(df: DataFrame) -> list[Column]:
    """All columns of df, by names that may hold dots or spaces."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver found it: once per session's
    context, its sources go along as a zip file."""
    sc = spark.sparkContext
    if getattr(sc, "_quillspark_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = f"{tempfile.mkdtemp(prefix='quillspark-')}/quillspark.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    sc._quillspark_shipped = True


def texts(docs: DataFrame, *cols: str) -> DataFrame:
    """doc_id, the named columns and the text as UTF-8 bytes; a null text is empty."""
    ship(docs.sparkSession)
    return docs.select("doc_id", *cols, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def give_back() -> None:
    """Return freed memory of a Python worker to the system, as workers live from task to task."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        return


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.Table | pa.RecordBatch], schema: T.StructType | str) -> DataFrame:
    """Apply f to each Arrow batch on its own. A worker gives its memory back after each task."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield f(b)
        give_back()

    return df.mapInArrow(run, schema)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges of longs: one row (node, root) per node that has
    an edge to another node; root is the smallest node reachable.

    Distributed union-find by alternating large-star and small-star rounds, each a group minimum
    (combined before the shuffle) and an equi-join; every round is written to the shared folder.
    It ends when a round leaves the edges as they were. Nothing but a count and a checksum
    reaches the driver.
    """
    spark = edges.sparkSession
    e = table(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == now or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = table(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        remove(spark, e)
        e = new

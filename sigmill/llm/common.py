"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import math
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as a Java/RE2 character class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where none is set."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    return _own.setdefault("dir", tempfile.mkdtemp(prefix="sigmill-"))


#: Rows of a file of a table whose size is known beforehand.
FILE_ROWS = 10_000


def written(df: DataFrame, hint: str = "t", rows: int | None = None) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back.

    rows: how many rows df has at most, where that is known. A small table then has few files, not one for each shuffle
    partition: on a local file system Hadoop starts a chmod for each file, and until the new process runs it, the
    executor's memory shows twice."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, math.ceil(rows / FILE_ROWS)))
    path = f"{shared_dir(spark)}/sigmill/{hint}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sigmill_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by written(), once no plan reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._sigmill_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished steps now; it acts when the driver's
    garbage is collected, which otherwise may be long after they have filled the disks."""
    for _ in range(2):  # the second round finds what the first one's finalisers let go
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.7)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of so many rows for what runs meanwhile. A batch of Spark's 10,000 rows of text or of sets is tens
    of megabytes, held by each task in the JVM's direct memory and again in its Python worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def give_back() -> None:
    """At the end of a Python task: return freed memory to the system. Workers are reused, and what they
    hold on to would count against the executor in all later steps."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(run):
    """run, a function of Arrow batches, with give_back() after the last of them."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have yet (case-insensitively)."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


#: A side of at most so many rows may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast for a written table whose row count was just checked."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: (a long, b long), any direction, loops allowed. Returns (a, b): each node that has a
    link to a smaller one, with the smallest node of its component. Every step is a partially
    aggregated minimum and an equi-join whose hot keys AQE may split; each round is written to the
    shared folder.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(e, "cc")
    seen = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            return e
        seen = now
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        step = large.join(low, "a")
        step = step.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        new = written(step.where("a <> b").distinct(), "cc", 2 * now[0])
        discard(e)
        e = new


def text_sha(text: str) -> F.Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def keep_lowest(docs: DataFrame, rows: DataFrame, text: str, key: str) -> DataFrame:
    """The rows of docs that stay, with their columns: one of each group of rows (root, doc_id, sha), which
    has a row for each of docs: the smallest key (null last), then the smallest hash of the text.

    Rows are told apart by key and text, so that a null or repeated key takes no other text along."""
    found = rows.groupBy("root", "doc_id", "sha").agg(F.count("*").alias("n"))
    found = written(found.withColumn("at", F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "sha")), "found")
    size = found.count()
    best = written(found.groupBy("root").agg(F.min("at").alias("best")), "best", size)
    found = written(found.join(best, "root").select("doc_id", "sha", "n", (F.col("at") == F.col("best")).alias("kept")), "kept", size)
    k, h = fresh(docs, "_key", "_sha")
    own = docs.withColumn(k, F.col(key).cast("long")).withColumn(h, text_sha(text))
    gone = small(written(found.where("not kept").select(F.col("doc_id").alias(k), F.col("sha").alias(h)), "gone", size))
    out = own.join(gone, own[k].eqNullSafe(gone[k]) & (own[h] == gone[h]), "left_anti")
    if found.where("kept and n > 1").limit(1).count():
        out = out.dropDuplicates([k, h])
    return out.drop(k, h)

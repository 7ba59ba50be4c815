"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import os
import sys
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: An Arrow batch ends at whichever comes first; a single longer text still makes a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 4_000_000
#: Rows of a table up to which it may be broadcast: under 50 MB at two longs a row.
SMALL = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.lru_cache(maxsize=4)
def shipped(application: str) -> None:
    """Send this package to the executors, once for each application."""
    path = os.path.join(tempfile.mkdtemp(prefix="tidemill-"), "tidemill-llm.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.write(os.path.join(ROOT, "tidemill", "__init__.py"), "tidemill/__init__.py")
        here = os.path.join(ROOT, "tidemill", "llm")
        for name in sorted(os.listdir(here)):
            if name.endswith(".py"):
                z.write(os.path.join(here, name), f"tidemill/llm/{name}")
    SparkSession.getActiveSession().sparkContext.addPyFile(path)


def ship(target: str, **settings):
    """A function for mapInArrow that imports `module:function` on the executor.

    It is pickled by value and carries only strings and small settings. Module-level caches
    (vocabularies, word caches) live in the Python worker until it turns to another operator.
    """
    module, name = target.split(":")

    def run(batches):
        import importlib

        plumbing = importlib.import_module("tidemill.llm.common")
        plumbing.turn_to(module)
        yield from getattr(importlib.import_module(module), name)(batches, **settings)
        plumbing.give_back()

    return run


_operator = None


def turn_to(module: str) -> None:
    """In a Python worker: drop what the operator before has kept."""
    global _operator
    if _operator not in (None, module):
        for name, m in list(sys.modules.items()):
            if name.startswith("tidemill.llm."):
                getattr(m, "_held", {}).clear()
        gc.collect()
        give_back()
    _operator = module


def give_back() -> None:
    """Return freed memory to the system: idle workers count against their executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library keeps what it has


def arrow_map(df: DataFrame, target: str, schema: str, **settings) -> DataFrame:
    spark = df.sparkSession
    shipped(spark.sparkContext.applicationId)
    # the same for every operator, so that no plan changes another's
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(ship(target, **settings), schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where none is set, a temporary one, and only if the
    executors run in this process: on a cluster they couldn't share it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemill-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_paths: dict[str, None] = {}


def written(df: DataFrame, label: str = "t") -> DataFrame:
    """Cut lineage: write a table to the shared folder and read it back. It stays until drop_written,
    forget_written or the end of the application."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _paths[path] = None
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemill_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    _paths.pop(path, None)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def drop_written(*tables: DataFrame) -> None:
    """Delete tables made by written() once nothing refers to them any more."""
    for df in tables:
        path = getattr(df, "_tidemill_path", None)
        if path:
            delete(df.sparkSession, path)


def written_paths() -> set[str]:
    return set(_paths)


def forget_written(spark: SparkSession, before: set[str] = frozenset(), but: DataFrame | None = None) -> None:
    """Delete the tables that written() has made since `before`, except one: for the end of a job."""
    for path in written_paths() - before:
        if but is None or path != but._tidemill_path:
            delete(spark, path)


@atexit.register
def _clean() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _paths:
        try:
            forget_written(spark)
        except Exception:  # noqa: BLE001  the session has ended before
            pass


def maybe_small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """A written table, marked for broadcast if it has been counted to be small."""
    return F.broadcast(df) if df.count() <= rows else df


def numbered(documents: DataFrame, name: str = "copy") -> DataFrame:
    """The rows with a number that tells rows of one doc_id apart: (doc_id, copy) is a key.

    Where ids are unique it is 0 and nothing moves. Rows that share an id are written once with
    their places as numbers, so the numbers hold however often a plan is run again; the groups
    aren't gathered, whatever their size. Null ids count as unique.
    """
    many = written(documents.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 and doc_id is not null").select("doc_id"), "repeated-ids")
    if many.isEmpty():
        drop_written(many)
        return documents.withColumn(name, F.lit(0).cast("long"))
    ids = maybe_small(many)
    rows = written(documents.join(ids, "doc_id", "left_semi").select(*documents.columns).withColumn(name, F.monotonically_increasing_id()), "repeated-rows")
    alone = documents.join(ids, "doc_id", "left_anti").select(*documents.columns).withColumn(name, F.lit(0).cast("long"))
    return alone.unionByName(rows)


def spare_name(name: str, columns) -> str:
    """A column name that the table doesn't have yet."""
    while name in columns:
        name += "_"
    return name


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) long pairs -> (node, component): the smallest node reachable from each.

    Alternating large-star and small-star rounds. Minima come from partially aggregated
    groupBys and go back by a join that AQE may split, so a node with very many
    neighbours isn't gathered in one task. Nodes without an edge don't appear; null ends
    and loops are ignored. Each round is written to the shared folder, which cuts the
    lineage and lets a lost executor's work be read again. Raises if max_rounds don't settle it.
    """
    cur = written(
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = cur.union(cur.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).distinct())
        nxt = written(small, "edges")
        drop_written(large)
        drop_written(cur)
        cur = nxt
        mark = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    roots = cur.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)

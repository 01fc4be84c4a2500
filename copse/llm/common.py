"""Helpers shared by the text operators: table access, durable lineage cuts, row packing."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: By operator: drops what its module keeps in a worker from task to task.
KEPT: dict[str, Callable[[], None]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor sees: ``spark.checkpoint.dir``; a local one only where that is unset and Spark runs in one JVM."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return LOCAL_CHECKPOINTS


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage; the driver gives back what planning and running it took."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    out = df.checkpoint(eager=True)
    relieve(df.sparkSession)
    return out


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder for a table written between two steps."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table of :func:`scratch` that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release() -> None:
    """Returns memory that this process has freed to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def give_back(own: str = "") -> None:
    """Drops what operators other than ``own`` keep in this worker, and returns freed memory to the system.

    Spark's Python workers go from stage to stage, beside a JVM that keeps its heap.
    """
    for name, drop in KEPT.items():
        if name != own:
            drop()
    release()


def relieve(spark: SparkSession) -> str:
    """Collects garbage in the driver's two processes and returns freed memory to the system; what the JVM says of it, empty if it cannot.

    The code that is compiled for each plan leaves some hundred MB that the JVM
    has freed, but that its C library holds in the pools of many threads.
    """
    gc.collect()
    release()
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    jvm.System.gc()
    find = jvm.java.lang.Class.forName
    kinds, given = array(jvm.java.lang.Class, 4), array(jvm.Object, 4)
    try:
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = find(kind)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # by the interface: the class of the server itself is not open to callers
        return find("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given) or ""
    except Py4JError:  # a JVM without that command
        return ""


def tidy(run: Callable[[Iterator], Iterator], own: str = "") -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a task, with :func:`give_back` before and after it."""

    def tidied(batches: Iterator) -> Iterator:
        give_back(own)
        try:
            yield from run(batches)
        finally:
            give_back(own)

    return tidied


def listed(spark: SparkSession, rows: list[tuple], **columns: pa.DataType) -> DataFrame:
    """A table of the driver's rows, sent by Arrow: from a list, Spark would start another daemon with workers of its own on each executor."""
    cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(columns.values())]
    return spark.createDataFrame(pa.table(cols, names=list(columns)))


def packed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(row, id, text)``: the whole input row as one struct, so that no name of the operator can clash with one of the caller's."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def unpacked(df: DataFrame, **more: Column | str) -> DataFrame:
    """The input columns again, then ``more``; a caller's column of the same name gives way."""
    taken = {k.lower() for k in more}
    kept = [F.col(f"row.`{f}`").alias(f) for f in df.schema["row"].dataType.fieldNames() if f.lower() not in taken]
    return df.select(*kept, *[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in more.items()])


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the rows whose labels no classifier may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))

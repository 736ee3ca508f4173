"""Cutting lineage in the shared folder, and joins whose broadcast is size-checked."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
import zipfile

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows, and most stored bytes, of a table that may be broadcast; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 32 << 20


#: Rows and bytes of an Arrow batch, where the session keeps Spark's own (10,000 rows of any length).
BATCH_ROWS, BATCH_BYTES = 2_000, 4 << 20


def ship(spark: SparkSession) -> None:
    """Gives this package to the session's Python workers, once a session, and bounds their batches.

    Workers unpickle functions that refer to the package, and need not have it
    on their path. Batches of long texts are held several times over (as Arrow
    and as Python objects, in both processes), so they are kept small.
    """
    context = spark.sparkContext
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if getattr(context, "_statloom_shipped", False):
        return
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="statloom-")), "statloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(home):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(home)))
    context.addPyFile(path)
    context._statloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only on one machine, and where the session names none (tests), a temporary
    folder is made and set; a cluster without a shared folder is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return str(jsc.getCheckpointDir().get()).rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="statloom-")
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The written rows survive lost executors, are computed once, and stay
    column-prunable for every later read.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/statloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Lets what finished plans hold go: shuffle files, broadcasts, and the driver's memory.

    Spark deletes the files once the driver has collected the plans they belong
    to, which may be long after; call it where a large shuffle has been cut, and
    between the phases of an operator that runs hundreds of small plans. The
    driver's heap shrinks to what is in use.
    """
    gc.collect()  # what Python holds of those plans
    spark.sparkContext._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> bool:
    """Frees what the driver's C library keeps of memory that the JVM gave back, mostly that of compiling plans.

    Only Java machines that offer it (HotSpot on Linux since 17.0.9) do it; others answer False.
    """
    context = spark.sparkContext
    java = context._jvm.java.lang
    try:
        # by reflection on the interface: the server's own class is closed to callers
        kinds = ["javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"]
        args = [context._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", None, None]
        types, values = context._gateway.new_array(java.Class, 4), context._gateway.new_array(java.Object, 4)
        for i in range(4):
            types[i], values[i] = java.Class.forName(kinds[i]), args[i]
        server = java.management.ManagementFactory.getPlatformMBeanServer()
        java.Class.forName("javax.management.MBeanServer").getMethod("invoke", types).invoke(server, values)
    except Py4JJavaError:
        return False
    return True


def sweep_executors(spark: SparkSession) -> None:
    """Shrinks the executors' heaps to what is in use, by a task for each core.

    A heap stays as large as an earlier stage made it, which lacks where
    workers need the memory outside it; call it before such a stage. Nothing
    depends on every executor getting a task.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def forget(spark: SparkSession, made: DataFrame) -> None:
    """Deletes the files of a cut table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in made.inputFiles() if "/statloom-" in f}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows and stored bytes stay within the bounds.

    Give it a cut (stored) table, since it is counted. Beyond the bounds the
    join that uses it shuffles, and adaptive execution splits skewed keys.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= BROADCAST_BYTES and df.count() <= rows else df

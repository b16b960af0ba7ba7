"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import gc
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, by the path that Spark itself resolves."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_of(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 3; remainder 1 is the held-out part. Null ids count as held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)), F.lit(1))


def held_out(doc_id: str = "doc_id") -> Column:
    return split_of(doc_id) == 1


def fresh(name: str, taken: list[str]) -> str:
    """A column name that doesn't clash with those taken (case is ignored, as Spark ignores it)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors once, so that their Python workers can import it; the driver serves it while it lives."""
    sc = spark.sparkContext
    if getattr(sc, "_loomspark_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, True)
    where = os.path.join(folder, f"loomspark_{uuid.uuid4().hex[:8]}.zip")
    Path(where).write_bytes(blob.getvalue())
    sc.addPyFile(where)
    sc._loomspark_shipped = True


def trim() -> None:
    """Give this process's free memory back to the system, where Arrow and the C library can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


def tidied(run):
    """For mapInArrow: run over a partition, then give the worker's free memory back, as workers outlive their tasks."""

    def whole(parts):
        try:
            yield from run(parts)
        finally:
            trim()

    return whole


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows from the driver. As an Arrow table it needs no Python worker on the executors."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))
    columns = list(zip(*rows, strict=True)) or [[]] * len(kind)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind))


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that the cluster names; a local default only where it is unset (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file:///tmp/checkpoints"
    return where


def materialise(df: DataFrame, how: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/loomspark/{how or 'part'}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomspark_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialise() wrote, by Hadoop's file system and only inside the shared folder."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    own = getattr(df, "_loomspark_path", None)
    for name in [own] if own else {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/loomspark/" in name:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def trim_jvm(spark: SparkSession) -> None:
    """Give the driver JVM's free native memory (of compilations and buffers that are over) back to the system, where it has a command for that.

    The C library keeps it otherwise, and a driver of many jobs gathers much of it beside its heap.
    """
    from py4j.protocol import Py4JError

    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    kind = jvm.java.lang.Class.forName

    def array(of, *items):
        out = gateway.new_array(of, len(items))
        for i, x in enumerate(items):
            out[i] = x
        return out

    try:  # by reflection on the interface, as the server's own class isn't open to callers
        types = array(jvm.java.lang.Class, *map(kind, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")))
        bean = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        args = array(jvm.java.lang.Object, bean, "systemTrimNativeHeap", array(jvm.java.lang.Object), array(jvm.java.lang.String))
        kind("javax.management.MBeanServer").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        pass  # a JVM without the command


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of tables that nothing refers to any more, and the driver its free memory, now rather than some time later."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim()
    trim_jvm(spark)

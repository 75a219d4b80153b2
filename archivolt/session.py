"""Session settings and the shared scratch folder for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Ids and rows below this count may be broadcast (16-byte keys: 8 MB at most).
BROADCAST_ROWS = 500_000


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session as tests and the bench use it: UTC, AQE with skew handling, Arrow."""
    b = (
        SparkSession.builder.master(master)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    The folder is ``spark.checkpoint.dir`` when the cluster names one; only a
    session without it (tests, a single machine) gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        elif not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        else:
            base = "file://" + tempfile.mkdtemp(prefix="spark-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/archivolt-{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet and read it back: lineage ends here and survives lost executors.

    The folder is new and read by this session only, after the job; so tasks may
    move their files into it themselves (a task that runs again writes the same names).
    """
    writer = df.write.mode("overwrite").option("compression", "zstd").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def save_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file to a shared folder: it appears whole or not at all."""
    at, fs = _hadoop(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{at.getParent().toString()}/.{at.getName()}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.rename(part, at)


def load_text(spark: SparkSession, path: str) -> str:
    at, fs = _hadoop(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Names in a shared folder."""
    at, fs = _hadoop(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []


def release(spark: SparkSession) -> None:
    """Let the driver collect its garbage, so that broadcasts, shuffle files and generated code of finished jobs go.

    Spark does so on its own every half hour; a job of many short passes would hold them all until then. What the
    driver's hundreds of threads freed outside the heap goes back to the system, too.
    """
    spark._jvm.System.gc()
    trim_native(spark)


def trim_native(spark: SparkSession) -> bool:
    """Return freed native memory of the driver to the system; false where its Java machine has no System.trim_native_heap."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    # the server's own class is closed to reflection, its interface is open
    types = gateway.new_array(jvm.java.lang.Class, 4)
    for i, t in enumerate(["javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"]):
        types[i] = jvm.java.lang.Class.forName(t)
    args = gateway.new_array(jvm.java.lang.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        invoke = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", types)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JJavaError:
        return False
    return True


def _sized(keys: DataFrame, limit: int) -> DataFrame:
    """``keys``, marked for broadcast when a count shows at most ``limit`` of them."""
    from pyspark.sql import functions as F

    return F.broadcast(keys) if keys.limit(limit + 1).count() <= limit else keys


def semi_join_sized(left: DataFrame, keys: DataFrame, key: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``left`` whose ``key`` is in ``keys``; a broadcast up to ``limit`` keys, a shuffle beyond."""
    return left.join(_sized(keys.select(key), limit), key, "left_semi")


def anti_join_sized(left: DataFrame, keys: DataFrame, key: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``left`` whose ``key`` isn't in ``keys``; a broadcast up to ``limit`` keys, a shuffle beyond."""
    return left.join(_sized(keys.select(key), limit), key, "left_anti")


def join_sized(left: DataFrame, right: DataFrame, key: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Inner join on ``key`` with a table of narrow rows; a broadcast up to ``limit`` of them, a shuffle beyond."""
    return left.join(_sized(right, limit), key)


def one_per_key(df: DataFrame, key: str, path: str) -> DataFrame:
    """A row for each ``key``: only rows whose key occurs again are shuffled. ``path``: for the list of those keys."""
    again = materialize(df.groupBy(key).count().where("count > 1").select(key), path)
    return anti_join_sized(df, again, key).unionByName(semi_join_sized(df, again, key).dropDuplicates([key]))

"""Session helpers: settings, shared scratch tables, table reading."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(app: str = "folioweave", cpus: str | int = 8, memory: str = "8g", **conf) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own session."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app).config("spark.driver.memory", memory)
    b = b.config("spark.sql.shuffle.partitions", str(conf.pop("shuffle_partitions", 8)))
    for k, v in {**DEFAULT_CONF, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it.

    Where that is unset a local session takes a local folder, and a cluster is an error: each of its executors would
    write to a disk of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), f"folioweave-{os.getuid()}")


#: A task's share of a scan; fewer files than cores stay as they are where each core has more than this.
SHARE_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores, where it reads fewer files than there are cores and little of each.

    A small file is one task, whatever the cores; it is dealt out anew. Larger inputs stay as they are.
    """
    spark = df.sparkSession
    files, want = df.inputFiles(), int(spark.conf.get("spark.default.parallelism", None) or spark.sparkContext.defaultParallelism)
    if not files or len(files) >= want:
        return df
    size = spark.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0]  # lists the files, reads none
    return df.repartition(want) if size < want * SHARE_BYTES else df


_written: list[tuple[SparkSession, str]] = []


def materialize(df: DataFrame, tag: str = "t") -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    It cuts the lineage with files that outlive any executor, so a stage that is used several times is
    computed once. The files go at the end of the process, or with `release`.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/fw-{tag}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what `materialize` returned as `df`, where nothing reads it any more."""
    files = [f.rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles()[:1]]
    for i, (spark, path) in enumerate(_written):
        if path.rpartition("/")[2] in files:
            del _written[i]
            _delete(spark, path)
            return


def release() -> None:
    """Delete what `materialize` wrote in this process."""
    while _written:
        _delete(*_written.pop())


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone; local files can still be removed
        if path.startswith("file://"):
            import shutil

            shutil.rmtree(path[7:], ignore_errors=True)


atexit.register(release)

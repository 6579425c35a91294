"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def local_session(cpus: int | str | None = None, shuffle_partitions: int = 8, app: str = "gleanery") -> SparkSession:
    """A local session for tests, the bench and the command line; a cluster brings its own."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the setting is absent, a temporary folder is used in local mode only: on a
    cluster a machine-local folder would be lost with its executor, so that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if named:
        if not current:
            sc.setCheckpointDir(named)
        return named
    if current:
        return current
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="gleanery-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_packed(df: DataFrame, run=None, schema: T.StructType | None = None, rows: int = 1024) -> DataFrame:
    """``cut`` as compressed Arrow batches of up to ``rows`` rows: for texts and words, which take several times as much as rows.

    With ``run`` and ``schema``, what ``run`` makes of the batches of ``df`` is kept, as by ``map_arrow``.
    """
    schema = df.schema if schema is None else schema

    def pack(batches):
        for batch in run(batches) if run else batches:
            for a in range(0, batch.num_rows, rows):
                to = pa.BufferOutputStream()
                with pa.ipc.new_stream(to, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_batch(batch.slice(a, rows))
                yield pa.RecordBatch.from_arrays([pa.array([to.getvalue().to_pybytes()], pa.binary())], names=["part"])

    def unpack(batches):
        for batch in batches:
            for part in batch.column(0):
                yield from pa.ipc.open_stream(part.as_buffer())

    return map_arrow(cut(map_arrow(df, pack, "part binary")), unpack, schema)


def release(df: DataFrame) -> None:
    """Deletes what ``cut`` wrote for ``df``, which nothing may read any more. For loops that cut a table in each round."""
    spark = df.sparkSession
    try:
        rdd = df._jdf.queryExecution().logical().rdd()
        file = rdd.getCheckpointFile()
    except (AttributeError, Py4JError):  # not a table that was cut
        return
    if file.isDefined():
        path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hands this package to the Python workers, once an application, unless they find it on their path anyway."""
    root = Path(__file__).resolve().parent
    on_path = {str(Path(p).resolve()) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    app = spark.sparkContext.applicationId
    if app in _shipped or str(root.parent) in on_path or root.suffix == ".zip" or not root.is_dir():
        return
    target = Path(tempfile.mkdtemp(prefix="gleanery-")) / "gleanery.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` whose function may use this package."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def spread(df: DataFrame, least: int = 16 << 20) -> DataFrame:
    """``df`` over all cores where it comes from fewer files than cores, each too small to be split.

    Work that takes long for each row would otherwise run on few cores. Larger inputs are left as they are: they split
    by themselves, and a shuffle would cost more than it gives.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if 1 << 16 < size < least * cores else df

"""Session set-up and the shared folder for checkpoints and written intermediate tables."""

from __future__ import annotations

import gc
import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "callweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on. On a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Give the executors' Python workers this package, once per application, through Spark's own file service."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        archive = os.path.join(tempfile.mkdtemp(prefix="callweave-"), f"{root.name}.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own, as tests do.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    base = tempfile.mkdtemp(prefix="callweave-")
    spark.sparkContext.setCheckpointDir(base)
    return base


_written: list[tuple[int, str]] = []  # thread and path


def run_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    _written.append((threading.get_ident(), path))
    return path


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of :func:`run_dir` that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    _written[:] = [w for w in _written if w[1] not in paths]


def written_paths() -> list[str]:
    """Folders that this thread has begun by :func:`run_dir` and that are not dropped."""
    return [path for thread, path in _written if thread == threading.get_ident()]


@contextmanager
def dropping_tables(spark: SparkSession) -> Iterator[None]:
    """Delete the paths that this thread begins within the block when it ends. What is to stay must be written elsewhere by then."""
    before = set(written_paths())
    try:
        yield
    finally:
        drop_paths(spark, [p for p in written_paths() if p not in before])


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` in the shared folder by ``checkpoint``, which keeps its partitions and the order of their rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, free: bool = False) -> DataFrame:
    """``df`` as a written table in the shared folder: computed once, and not again when an executor is lost. With ``free``, shuffles
    that only it needed go at once."""
    spark = df.sparkSession
    path = run_dir(spark, "table")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._callweave_table = path
    del df
    if free:
        release(spark)
    return out


def stored_alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """``make()`` as a written table. The tables that it writes on its way go."""
    path = run_dir(spark, "table")
    with dropping_tables(spark):
        df = make()
        df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    del df
    release(spark)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of :func:`stored` that nothing reads any more."""
    for df in tables:
        if path := df.__dict__.pop("_callweave_table", None):
            drop_paths(df.sparkSession, [path])


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner see which shuffles and broadcasts nothing refers to any more, so that their files go."""
    gc.collect()
    jvm = spark.sparkContext._jvm
    jvm.System.gc()

"""Session, table and scratch-table helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scratch_roots: dict[int, str] = {}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "galley") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("GALLEY_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """A folder that all executors share: ``spark.checkpoint.dir`` where the cluster names one.

    Only where that setting is absent (tests, a single machine) a temporary
    folder is made; it is removed with the process.
    """
    sc = spark.sparkContext
    key = id(sc)
    if key not in _scratch_roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or sc._conf.get("spark.checkpoint.dir", None)
        if not base:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="galley-scratch-")
        root = f"{base.rstrip('/')}/galley-{uuid.uuid4().hex}"
        _scratch_roots[key] = root
        atexit.register(_remove, spark, root)
    return _scratch_roots[key]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """The scratch tables written inside the block, dropped at its end; their results have to be stored by then."""
    key, outer = id(spark.sparkContext), scratch_root(spark)
    inner = f"{outer}/block-{uuid.uuid4().hex[:12]}"
    _scratch_roots[key] = inner
    try:
        yield inner
    finally:
        _scratch_roots[key] = outer
        _remove(spark, inner)


def _remove(spark: SparkSession, root: str) -> None:
    try:
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:
        pass  # the session may be gone; the folder is scratch


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    It cuts the lineage, keeps only the columns that are used, and survives the
    loss of an executor, as no block of it lives on one.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Drops tables that ``materialize`` gave and nothing reads any more."""
    for t in tables:
        path = getattr(t, "_scratch", None)
        if path:
            _remove(t.sparkSession, path)


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))

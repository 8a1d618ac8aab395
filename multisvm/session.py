"""Session helpers: a local session for tests and benches, and the shared
scratch folder that jobs write derived tables to."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", app: str = "multisvm", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and benches (local mode, UI off, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must name storage that all machines share; without
    it this raises. In local mode (tests, benches) a temporary folder is taken.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="multisvm-ckpt-")
        sc.setCheckpointDir(current)
        current = sc.getCheckpointDir() or current
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for a derived table."""
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    if not _SCRATCH:
        atexit.register(clear_scratch, spark)
    _SCRATCH.append(path)
    return path


_SCRATCH: list[str] = []


def clear_scratch(spark: SparkSession) -> None:
    """Delete the derived tables of this process (also done when it ends)."""
    while _SCRATCH:
        path = _SCRATCH.pop()
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended: what is local can still go
            shutil.rmtree(path.removeprefix("file:"), ignore_errors=True)


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


__all__ = ["local_session", "checkpoint_dir", "scratch_path", "clear_scratch", "is_local"]


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``multisvm`` importable in Python workers (same as ``--py-files``).

    The Arrow kernels are closures over this package's helpers; executors
    started elsewhere than the repo need the package shipped. Done once per
    SparkContext: the package is zipped on the driver and distributed by Spark.
    """
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out_dir = tempfile.mkdtemp(prefix="multisvm-pyfiles-")
    archive = os.path.join(out_dir, "multisvm.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as zf:
        for folder, _dirs, files in os.walk(pkg_dir):
            if "__pycache__" in folder:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(archive)
    _SHIPPED.add(key)

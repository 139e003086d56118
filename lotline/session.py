"""Session construction and the shared work folder."""

from __future__ import annotations

import tempfile
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

# Settings every lotline job relies on: naive UTC timestamps end to end and
# adaptive execution (runtime broadcast conversion under the size threshold,
# partition coalescing, skew-join splitting).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "lotline", driver_memory: str | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name).config("spark.ui.enabled", "false")
    if driver_memory:
        # local mode: the driver JVM is the only executor (takes effect when
        # this call starts the JVM)
        builder = builder.config("spark.driver.memory", driver_memory)
    if master:
        builder = builder.master(master)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_conf(spark)
    return spark


def apply_conf(spark: SparkSession) -> None:
    """Pin the session settings lotline depends on (safe on a running session)."""
    for k, v in BASE_CONF.items():
        if k != "spark.sql.ansi.enabled":
            spark.conf.set(k, v)


@contextmanager
def at_most(spark: SparkSession, sizes: dict[str, str]):
    """While the block runs, settings of the session that are byte sizes are no larger than ``sizes``."""
    as_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    before = {k: spark.conf.get(k) for k in sizes}
    try:
        for k, size in sizes.items():
            if as_bytes(before[k]) > as_bytes(size):
                spark.conf.set(k, size)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors' Python (once an application), so that
    tasks find it wherever they run; Spark serves the file from the driver."""
    ctx = spark.sparkContext
    root = Path(__file__).resolve().parent
    if ctx.applicationId in _shipped or not root.is_dir():
        return
    path = Path(tempfile.mkdtemp(prefix="lotline-code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    ctx.addPyFile(str(path))
    _shipped.add(ctx.applicationId)


_WORK_DIRS: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables and stream checkpoints.

    On a cluster this is the folder named by ``spark.checkpoint.dir`` (shared
    storage every executor can reach).  Only in local mode, where the driver is
    the executor, a missing setting is made up for by a folder of this machine;
    a cluster without the setting is refused, as its executors would each
    write to their own disk.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        if spark.sparkContext.getCheckpointDir() is None:
            # reliable checkpoints (DataFrame.checkpoint) go to the same folder
            spark.sparkContext.setCheckpointDir(d)
        return d.rstrip("/")
    app = spark.sparkContext.applicationId
    if app in _WORK_DIRS:
        return _WORK_DIRS[app]
    d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="lotline-work-")
        spark.sparkContext.setCheckpointDir(d)
    _WORK_DIRS[app] = d.rstrip("/")
    return _WORK_DIRS[app]


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence test through the Hadoop FileSystem of the path (works on any store)."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(p))

"""SparkSession factory and cluster-facing settings."""

from __future__ import annotations

import os
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job relies on. Shuffle partitions are sized by the caller
# (local tests: the core count; a cluster: ~2-3x total executor cores, with
# AQE coalescing small ones and splitting skewed ones at run time).
BASE_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}


def get_spark(app: str = "itcflow", cpus: int | None = None, shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster the platform provides the session."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cpus)
    conf["spark.driver.memory"] = os.environ.get("SPARK_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; a directory is only
    chosen here when that setting is unset (local tests).
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = fallback or os.environ.get("ITCFLOW_CHECKPOINT_DIR")
        if not d:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile
            d = tempfile.mkdtemp(prefix="itcflow-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def shared_dir(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]):
    """Session settings for the queries that are started inside; then as before."""
    was = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drop_shuffles(spark: SparkSession) -> None:
    """Spark removes the shuffle files of queries that are done when the driver collects
    garbage, else each half hour. Streams have no other cleanup of theirs."""
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of this job's own, on any file system Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``itcflow`` importable in Python workers (pandas UDFs, grouped-map
    and stateful functions live in this package). The package is zipped once
    per application and added with ``addPyFile``, which distributes it to every
    executor; nothing relies on the driver's working directory."""
    import hashlib
    import zipfile
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    files = []
    for root, _dirs, names in os.walk(pkg):
        for n in sorted(names):
            if n.endswith(".py"):
                files.append(os.path.join(root, n))
    h = hashlib.sha1()
    for f in sorted(files):
        with open(f, "rb") as fh:
            h.update(f.encode() + fh.read())
    base = spark.conf.get("spark.checkpoint.dir", None) or ""
    local = base if base and "://" not in base.replace("file://", "") else ""
    local = local.replace("file://", "")
    if not local:
        import tempfile
        local = tempfile.gettempdir()
    os.makedirs(local, exist_ok=True)
    path = os.path.join(local, f"itcflow-{h.hexdigest()[:12]}.zip")
    if not os.path.exists(path):
        tmp = path + f".{os.getpid()}.part"
        with zipfile.ZipFile(tmp, "w", zipfile.ZIP_DEFLATED) as z:
            for f in files:
                z.write(f, os.path.join("itcflow", os.path.relpath(f, pkg)))
        os.replace(tmp, path)
    sc.addPyFile(path)
    _SHIPPED.add(app)

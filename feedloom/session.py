"""Session helpers.

Library code never builds its own session: every operator takes DataFrames
and returns a DataFrame.  These helpers are for tests, the bench and for
jobs that need a lineage cut (checkpoint directory taken from the session).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "feedloom") -> SparkSession:
    """A local session configured like the tests and the bench expect."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is.  Only when it is unset (local tests) a fresh scratch folder is
    created and registered.
    """
    sc = spark.sparkContext
    current = spark.conf.get(CHECKPOINT_CONF, None) or sc.getCheckpointDir()
    if not current:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError(f"{CHECKPOINT_CONF} must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="feedloom-ckpt-"))
        return sc.getCheckpointDir()
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, asked through the file system that Spark would read it with."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def list_folders(spark: SparkSession, path: str) -> list[str]:
    """The folders directly below a path, by name; none where the path does not exist."""
    fs, p = _file_system(spark, path)
    return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def stamp_in_order(spark: SparkSession, folder: str, start_ms: int = 1_700_000_000_000) -> None:
    """Give the files of a folder modification times in the order of their names: a file stream takes them in
    that order.  One call per file of an input laid out for a stream."""
    fs, p = _file_system(spark, folder)
    files = sorted((s.getPath() for s in fs.listStatus(p) if s.isFile()), key=lambda f: f.getName())
    for i, f in enumerate(f for f in files if not f.getName().startswith(("_", "."))):
        fs.setTimes(f, start_ms + 1000 * i, -1)


def publish_folder(spark: SparkSession, staged: str, path: str) -> None:
    """Move a finished folder to its place, replacing what is there; a staged folder that does not exist leaves nothing there."""
    fs, src = _file_system(spark, staged)
    _, dst = _file_system(spark, path)
    fs.delete(dst, True)
    if fs.exists(src):
        fs.mkdirs(dst.getParent())
        if not fs.rename(src, dst):
            raise OSError(f"{staged} could not be moved to {path}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the session's checkpoint folder
    and continue from that table.

    One job computes and writes the rows once (an RDD checkpoint would run
    the plan a second time to write it); the data lives in the shared folder,
    not on executors, so it survives executor loss, and later plans start
    from the table, so lineage stays short in iterative jobs.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"cut-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub folder of the checkpoint folder for intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``feedloom`` importable in the executors' Python workers.

    Python UDFs (pandas UDFs, grouped state functions, plug-ins) refer to
    this package; the workers import it.  The package is zipped once per
    session into the checkpoint folder and added with ``addPyFile``, which
    distributes it to every executor, including executors added later.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    import shutil

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    target = scratch_path(spark, f"pyfiles-{uuid.uuid4().hex}")
    if "://" not in target or target.startswith("file:"):
        local = target.replace("file://", "").replace("file:", "")
        os.makedirs(local, exist_ok=True)
        archive = shutil.make_archive(os.path.join(local, "feedloom"), "zip",
                                      root_dir=os.path.dirname(pkg_dir), base_dir="feedloom")
    else:  # a shared (remote) checkpoint folder: build locally, Spark ships it
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "feedloom"), "zip",
                                      root_dir=os.path.dirname(pkg_dir), base_dir="feedloom")
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)

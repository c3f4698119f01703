"""Session settings and shared-storage helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "incidex", cpus: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the single-node bench; a cluster brings its own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_fallback: dict[str, str] = {}  # of local sessions without a setting, by application


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only a local master may fall back to a machine-local folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _fallback[app]


_made: list[str] = []  # scratch folders of this process, oldest first


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder of the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files.

    The result survives executor loss, is evaluated once, and has a true size, so
    later joins are planned from facts.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_folders() -> Iterator[list[str]]:
    """Collects the scratch folders made inside the block."""
    start, found = len(_made), []
    try:
        yield found
    finally:
        found.extend(_made[start:])


def drop_folders(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes scratch folders that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        if path in _made:
            _made.remove(path)
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def release(*tables: DataFrame) -> None:
    """Deletes the stored tables that ``cut_lineage`` returned, once their last reader has run."""
    for df in tables:
        names = {f.split("/stage-", 1)[1].split("/", 1)[0] for f in df.inputFiles() if "/stage-" in f}
        drop_folders(df.sparkSession, [p for p in list(_made) if p.rsplit("/stage-", 1)[-1] in names])

"""Session settings, table access and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that every job of this engine wants; partition counts stay the cluster's.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("corpusmill")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine gets a temporary folder of its own, removed at the end; on a cluster a
    machine's own folder would lose what other machines wrote, so that is refused.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if folder is None and current.isDefined():
        folder = current.get()
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="corpusmill-")
        atexit.register(shutil.rmtree, folder, True)
    if not current.isDefined():
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` materialised in the shared checkpoint folder, with its lineage cut: a lost executor loses nothing of it.

    With ``spark.cleaner.referenceTracking.cleanCheckpoints`` the files go when nothing refers to the result any more.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def removed_at_end(spark: SparkSession, path: str) -> None:
    """Has ``path`` removed when the session's Python ends."""

    def remove() -> None:
        try:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # noqa: BLE001 - the session has gone, and its folder is the cluster's to clean
            pass

    atexit.register(remove)


def kept(df: DataFrame) -> DataFrame:
    """``df`` written as a compressed table in the shared checkpoint folder and read back, for rows that are read often.

    The table is removed when the session's Python ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    removed_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)

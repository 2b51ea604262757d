"""Session settings the library relies on, and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def build_session(app: str = "tieout", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Suites build many small plans; recording the Python line of every expression slows that down.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def settled(df: DataFrame) -> DataFrame:
    """A small table of metadata (one row per column, table or check) computed once and kept as literal rows.

    Rules build on each other's results; without this every rule would carry the plans, and rerun the
    scans, of all the rules before it.
    """
    return df.sparkSession.createDataFrame(df.toArrow())


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one the cluster names in ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="tieout-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


@dataclass(frozen=True)
class Kept:
    """An intermediate table written to the shared folder."""

    path: str
    schema: StructType

    def read(self, spark: SparkSession, *more: "Kept") -> DataFrame:
        """The table, followed by others of the same columns. The schema is known, so none is inferred."""
        return spark.read.schema(self.schema).parquet(self.path, *[k.path for k in more])

    def drop(self, spark: SparkSession) -> None:
        """Delete the table's files. Nothing that still has to be computed may read it."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> Kept:
    """Write an intermediate table once to the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/tieout-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return Kept(path, df.schema)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of a job: the table is computed once, written, and read back.

    Whatever is lost later is read again from the written table. (``DataFrame.checkpoint`` would
    compute its input twice, once to count it and once to write it.)
    """
    return stored(df).read(df.sparkSession)

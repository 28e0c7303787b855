"""Session helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Advice for a cluster session; a running session is never changed by the library.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
}


def local_session(name: str = "lineweave", cpus: str = "8", shuffle_partitions: int = 8, **conf) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    settings = {**RECOMMENDED, "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.ui.enabled": "false",
                "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", **conf}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a session in one JVM (``local[n]``, as in tests and bench) gets a temporary folder where
    none is named; on a cluster executors could not see it, so a missing setting is an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="lineweave-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return base.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables, below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table below the shared folder and read it again: a compressed cut of the lineage."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Folder:
    """Small files of a folder on whatever file system Spark sees, by its Hadoop client on the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self.path = spark._jvm, path.rstrip("/")
        self._fs = self._at().getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _at(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._at())] if self._fs.exists(self._at()) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """A new file that is there whole or not at all; one of this name that exists is an error."""
        draft = self._at(f".{name}.{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(text.encode())
        stream.close()
        if not self._fs.rename(draft, self._at(name)):
            raise FileExistsError(f"{self.path}/{name}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

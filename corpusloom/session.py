"""Session helpers: local test session, shared scratch tables, worker imports."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def local_session(cores: str | int = "*", memory: str = "20g", app: str = "corpusloom", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def let_workers_import(spark: SparkSession) -> None:
    """Put this checkout on the import path of Python workers started from now on.

    Enough where every node sees the checkout (local mode, a shared folder); otherwise ship the
    package with ``--py-files``.
    """
    env = spark.sparkContext.environment
    paths = [p for p in (ROOT, env.get("PYTHONPATH", ""), os.environ.get("PYTHONPATH", "")) if p]
    env["PYTHONPATH"] = os.pathsep.join(dict.fromkeys(os.pathsep.join(paths).split(os.pathsep)))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode (tests), on a cluster an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


class Scratch:
    """Intermediate tables as Parquet in the shared folder: lineage is cut and a lost executor loses no data.

    A table is dropped by ``drop`` as soon as its successor is written; what the returned plan still
    reads stays until the Python process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/corpusloom-{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.clear)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def files(self, name: str) -> dict[int, str]:
        """The files of a table by the number of the task that wrote them, for workers to read."""
        sc = self.spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        names = [f.getPath().getName() for f in at.getFileSystem(sc._jsc.hadoopConfiguration()).listStatus(at)]
        return {int(m[1]): f"{self.root}/{name}/{n}" for n in names if (m := re.match(r"part-(\d+)-", n))}

    def drop(self, name: str) -> None:
        self._delete(f"{self.root}/{name}")

    def clear(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session may be gone already
            pass

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        if sc._jsc is None:
            return
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)

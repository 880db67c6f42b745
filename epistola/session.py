"""Session helpers: building a session, lineage cuts in the shared checkpoint folder and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest plan-estimated size (bytes) of a side that an operator may broadcast by hint. Estimates of stored tables are of compressed files.
BROADCAST_LIMIT = 4 << 20


def build_session(app: str = "epistola", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for; a cluster's own settings stay as they are."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``. Where that is unset, a temporary folder in local mode; on a cluster, whose
    executors would each write to a disk of their own, an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named
    if not (sc.master or "").split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="epistola-checkpoint-")
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir() or own


class Scratch:
    """Tables written to the shared checkpoint folder to cut lineage.

    Every table is a compressed Parquet folder that any executor can read, so the loss of an executor never costs a
    recomputation of the loop that wrote it. ``drop`` removes a table that nothing reads any more; what is left is
    removed when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{checkpoint_dir(spark).rstrip('/')}/epistola-{name}-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self.close)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def save(self, df: DataFrame, files: int | None = None) -> DataFrame:
        path = f"{self.base}/{self.n}"
        self.n += 1
        (df.coalesce(files) if files else df).write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *dfs: DataFrame | None) -> None:
        """Removes tables that ``save`` returned; other frames are left alone."""
        for df in dfs:
            if df is not None and (path := vars(df).get("scratch_path")):
                self._delete(path)

    def close(self) -> None:
        try:
            self._delete(self.base)
        except Exception:  # the JVM may be gone already
            pass


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a frame, without running it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """A broadcast hint only if the planned size is proven below ``limit``; otherwise the frame as it is, for a shuffle join."""
    return F.broadcast(df) if plan_bytes(df) <= limit else df


def multiplied(df: DataFrame) -> DataFrame:
    """A join side whose rows an explode has multiplied, for a sort-merge join. The planner counts such a side as large as the table before the explode
    and would broadcast it; built in the driver, it is many times that."""
    return df.hint("merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))

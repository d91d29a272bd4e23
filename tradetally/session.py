"""Session construction and shared-folder helpers."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession


def build_session(master: str | None = None, partitions: int | None = None,
                  app: str = "tradetally", extra: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster, pass nothing and let spark-submit decide."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (b.config("spark.sql.session.timeZone", "UTC")
          .config("spark.ui.enabled", "false")
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true")
          .config("spark.ui.showConsoleProgress", "false")
          # generated methods above HotSpot's 8000-bytecode JIT limit would run
          # interpreted; split such stages into per-operator code instead
          .config("spark.sql.codegen.hugeMethodLimit", "8000")
          # a table with few partition values is written without a sort of its rows by them
          .config("spark.sql.maxConcurrentOutputFileWriters", "8"))
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Read from the session. Where it is unset, a scratch folder serves local
    mode (one machine, as in tests); a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return _scratch(spark.sparkContext.applicationId)


@cache
def _scratch(application: str) -> str:
    return tempfile.mkdtemp(prefix="tradetally-shared-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder of the shared folder for written intermediate tables: no
    call finds what another one wrote."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"

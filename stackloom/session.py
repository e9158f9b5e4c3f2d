"""Session settings and the shared scratch area."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC, AQE on, Arrow on.

    ``master`` and any other setting are only given where the launcher has not
    already chosen them (spark-submit on a cluster passes its own).
    """
    builder = SparkSession.builder.appName("stackloom")
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Where that is unset a temporary folder is used, but only on a local master:
    on a cluster such a folder would exist on one machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="stackloom-")
    spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    return f"file://{folder}"


def materialize(df: DataFrame, label: str = "stage", by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage like a reliable checkpoint, survives the loss of
    executors, and being columnar and compressed takes less disk than one.
    Later readers prune columns and push filters; ``by`` names columns whose
    values get folders of their own, which a filter on them leaves unread. The
    files go with ``release``, at the latest when the driver process ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    atexit.register(_drop, spark, path)
    got = spark.read.schema(df.schema).parquet(path)
    got._stackloom_path = path
    return got


def release(df: DataFrame) -> None:
    """Delete the files of a materialized table that no result depends on any more."""
    path = getattr(df, "_stackloom_path", None)
    if path:
        _drop(df.sparkSession, path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:
        pass  # the session is gone already

"""SparkSession with the settings the operators are designed for, and the folder that a cluster shares."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("quillspark")
    if master:
        builder = builder.master(master)
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, one of this machine if Spark runs in this process alone, else an error."""
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or _own.get(context.applicationId)
    if not at:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="quillspark-")
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` by way of the shared folder: it is computed once, whatever reads it and whichever executor is lost."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

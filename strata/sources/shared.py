"""Tables written to the folder that the whole cluster shares, to cut lineage, and code sent to it."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where the session names none (tests, notebooks), a
    temporary one of the application's own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="strata-")
        root = _OWN[app]
    return f"{root.rstrip('/')}/strata-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: computed once, however often it is used, and
    independent of the executors that computed it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove what this application has written to the shared folder; results not yet read are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once in an application, for sessions whose workers
    cannot import it by themselves."""
    context = spark.sparkContext
    if getattr(context, "_strata_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    at = os.path.join(tempfile.mkdtemp(prefix="strata-code-"), "strata-code.zip")
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(at)
    context._strata_shipped = True

"""Folders that the driver and all executors see, and intermediate results kept in them."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from turnloom.sources.files import _fs


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name under the cluster's checkpoint folder; in local mode, where that may be
    unset, under a temporary one, which is set for the process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        root = "file://" + tempfile.mkdtemp(prefix="turnloom-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` as Parquet, and read from there."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate results of one call, which are deleted when the ``with`` block ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, shared_dir(spark, "scratch"), 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        fs, target = _fs(self.spark, self.path)
        fs.delete(target, True)

    def cut(self, df: DataFrame) -> DataFrame:
        """``df`` made once, whatever uses it: written and read again, which also ends its lineage."""
        self.n += 1
        return written(df, f"{self.path}/{self.n}")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, for clusters whose
    machines don't have it installed."""
    context = spark.sparkContext
    if _SHIPPED.get("app") == context.applicationId:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="turnloom-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    _SHIPPED["app"] = context.applicationId


_SHIPPED: dict[str, str] = {}

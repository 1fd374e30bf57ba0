"""Helpers the training-data operators share: shared folders, staging, ASCII words."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.sources.shared import ship

#: The white space that separates words, U+0020 and U+0009 to U+000D,
#: which is also what ``bytes.split()`` splits at.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


#: Bytes of an Arrow batch, or one row that is longer.
ARROW_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(column: Column) -> Column:
    """Lower-case A-Z only, unlike ``lower``, which maps all of Unicode."""
    return F.translate(column, UPPER, LOWER)


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name under the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` is read from the session. Only where it is unset in local mode, as
    in tests, is a folder of this process taken and set; on a cluster that raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        root = "file://" + tempfile.mkdtemp(prefix="turnloom-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut of the lineage that survives
    the loss of any executor, and a guard against running what is above twice."""
    spark = df.sparkSession
    path = path or shared_dir(spark, label)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of jobs whose results are written: it does so when the
    driver's heap is collected, which may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with a number behind it if ``df`` has such a column."""
    taken, made = {x.lower() for x in df.columns}, []
    for name in names:
        made.append(next(x for x in (name, *(f"{name}_{k}" for k in range(len(taken) + 1))) if x.lower() not in taken))
    return made


def arrow_rows(spark: SparkSession, rows: int = 1000) -> None:
    """Rows of an Arrow batch: whole texts can be long, so the default of 10,000 is too many, and
    a batch is bounded in bytes as well."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))

"""Readers and writers of run files: strict JSON lines, frozen files, content manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Records of JSON lines; a truncated or malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def fingerprint(rows: DataFrame) -> tuple[int, int]:
    """Rows and an order-free checksum of their canonical JSON, added up by the tasks."""
    line = F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]))
    got = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64(line).cast("decimal(38,0)"))).first()
    return got[0], int(got[1] or 0)


def write_frozen(rows: DataFrame, path: str) -> bool:
    """Write ``rows`` unless ``path`` holds the same already; other rows there raise."""
    spark = rows.sparkSession
    fs, target = _fs(spark, path)
    if fs.exists(target):
        if fingerprint(spark.read.schema(rows.schema).parquet(path)) != fingerprint(rows):
            raise ValueError(f"{path} is frozen with other rows")
        return False
    rows.write.parquet(path)
    return True


def verify_manifest(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """name, problem of files that differ from ``manifest`` (name, sha256), are missing or extra."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    found = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("got"))
    rows = manifest.join(found, "name", "full")
    problem = F.when(F.col("got").isNull(), "missing").when(F.col("sha256").isNull(), "extra").when(F.col("got") != F.col("sha256"), "changed")
    return rows.select("name", problem.alias("problem")).where("problem IS NOT NULL")


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target

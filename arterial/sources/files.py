"""Looking for inputs through Spark's own readers, so that any store it reads will do."""

from pyspark.sql import SparkSession


def exists(spark: SparkSession, path: str) -> bool:
    """Is there a file or folder at a path of any file system that Spark knows?"""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def first_there(spark: SparkSession, paths: list[str | None]) -> str | None:
    """The first of some paths, in order of trust, that exists; None stands for none given."""
    return next((p for p in paths if p and exists(spark, p)), None)

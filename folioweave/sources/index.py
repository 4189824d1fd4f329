"""A collection of vectors on disk: created, filled source by source, scanned in pages, dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import fusion

FIELDS = T.StructType([
    T.StructField("uid", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("sparse", T.MapType(T.IntegerType(), T.FloatType())),
    T.StructField("source", T.StringType()),
])


class VectorCollection:
    """Vectors below one folder, a partition for each source, so that a source is replaced or searched alone."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self) -> bool:
        fs, p = self._fs()
        return fs.exists(p)

    def create(self, again: bool = False) -> VectorCollection:
        """An empty collection; one that is there is an error, or goes with `again`."""
        if self.exists():
            if not again:
                raise ValueError(f"there is a collection at {self.path}")
            self.drop()
        self.spark.createDataFrame([], FIELDS).write.partitionBy("source").parquet(self.path)
        return self

    def drop(self) -> None:
        fs, p = self._fs()
        fs.delete(p, True)

    def read(self) -> DataFrame:
        if not self.exists():
            raise ValueError(f"no collection at {self.path}")
        return self.spark.read.schema(FIELDS).parquet(self.path)

    def upsert(self, rows: DataFrame, key: str = "uid") -> None:
        """Replace the partitions of the sources in `rows` by their rows, the last one of a key; other sources stay.

        Rows have the columns of FIELDS; what is missing is null. Null keys and sources drop out.
        """
        have = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in FIELDS])
        have = have.where(F.col(key).isNotNull() & F.col("source").isNotNull()).dropDuplicates([key, "source"])
        have.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(self.path)

    def pages(self, size: int, key: str = "uid") -> DataFrame:
        """All rows in the order of their key with page, `size` rows each; no task numbers them alone."""
        return fusion.numbered(self.read(), [key], "_n").withColumn("page", F.floor(F.col("_n") / size)).drop("_n")

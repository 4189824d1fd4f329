"""Sources and sinks: files of many formats, a catalogue of datasets, tolerant readers, resumable writers."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Reader by file extension; a fixed value.
FORMATS = {"json": "json", "jsonl": "json", "csv": "csv", "parquet": "parquet", "txt": "text", "orc": "orc"}

_PAGES = ("page_no", "orig_page_no")
_META = ("unique_id", "parent_id", "child_id", "chunk_level", "source", *_PAGES, "lang", "content_hash")
METADATA = T.StructType([T.StructField(c, T.IntegerType() if c in _PAGES else T.StringType()) for c in _META])
DOCUMENT = T.StructType([T.StructField("page_content", T.StringType()), T.StructField("metadata", METADATA)])
ALPACA = T.StructType([T.StructField(c, T.StringType()) for c in ("instruction", "input", "output", "system")])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of page_content and metadata; missing fields are null, texts ''. Blank lines are skipped."""
    return spark.read.schema(DOCUMENT).json(path).withColumn("page_content", F.coalesce("page_content", F.lit(""))).where("metadata is not null or page_content <> ''")


def read_tolerant(spark: SparkSession, path: str, schema: T.StructType, required: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of a JSON-lines file: unreadable lines, and rows lacking a required field, go to the second.

    Each of the two reads the file; all fields are read with the mark of unreadable lines, so neither has to be kept.
    """
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    d = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    ok = F.col("_corrupt").isNull()
    for c in required:
        ok = ok & F.col(c).isNotNull()
    return d.where(ok).drop("_corrupt"), d.where(~ok)


def read_stop_words(spark: SparkSession, path: str, most: int = 100_000) -> list[str]:
    """The words of a stop-word file, one a line, in lower case; a list on the driver, `most` at most."""
    words = spark.read.text(path).select(F.lower(F.trim("value")).alias("w")).where("w <> ''").distinct().limit(most + 1).collect()
    if len(words) > most:
        raise ValueError(f"more than {most} stop words")
    return sorted(r["w"] for r in words)


def roll_back(spark: SparkSession, path: str, batch: int, column: str = "batch_id") -> None:
    """Take back the results of one batch of `resumable`: its partition goes."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{column}={batch}")
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read_qa(spark: SparkSession, array_path: str, lines_path: str, schema: T.StructType) -> DataFrame:
    """Questions and answers of a JSON array and of JSON lines in one table; the first of equal ids, array before lines."""
    both = spark.read.schema(schema).option("multiLine", True).json(array_path).withColumn("_o", F.lit(0)).unionByName(spark.read.schema(schema).json(lines_path).withColumn("_o", F.lit(1)))
    key = schema.fields[0].name
    rest = [f.name for f in schema.fields[1:]]
    g = both.groupBy(key).agg(F.min_by(F.struct(*rest), "_o").alias("_v"))
    return g.select(key, *[F.col("_v")[c].alias(c) for c in rest])


def looks_like_array(spark: SparkSession, path: str) -> bool:
    """Whether a JSON file is one array rather than lines: by its first character that is no white space."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    return bool(first) and first[0].value.lstrip().startswith("[")


def read_json_any(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A JSON array or JSON lines."""
    r = spark.read.option("mode", "FAILFAST")
    r = r.schema(schema) if schema else r
    return r.option("multiLine", looks_like_array(spark, path)).json(path)


def read_by_extension(spark: SparkSession, paths: list[str], schema: T.StructType | None = None) -> DataFrame:
    """Files of one format, told by their extension; several formats at once are an error."""
    kinds = {FORMATS.get(os.path.splitext(p)[1].lstrip(".").lower()) for p in paths}
    if len(kinds) != 1 or None in kinds:
        raise ValueError(f"files must be of one known format: {sorted(map(str, kinds))}")
    kind = kinds.pop()
    if kind == "json" and len(paths) == 1:
        return read_json_any(spark, paths[0], schema)
    r = spark.read.format(kind)
    r = r.schema(schema) if schema else r
    return (r.option("header", "true") if kind == "csv" else r).load(paths)


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256): files whole; parsers attach as Arrow-batched functions."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return d.select("path", F.octet_length("content").alias("bytes"), F.sha2("content", 256).alias("sha256"))


class Catalogue:
    """Datasets by name: where each one is, its format and column names.

    An entry holds file_name, and may hold formatting, split, subset, ranking, num_samples and columns (from our
    names to its own). `root` is the folder of the files.
    """

    def __init__(self, entries: dict, root: str = ""):
        self.entries, self.root = entries, root

    @classmethod
    def load(cls, path: str) -> Catalogue:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f), os.path.dirname(path))

    @classmethod
    def from_table(cls, df: DataFrame, root: str = "") -> Catalogue:
        """From a table of entries; a catalogue is a driver-side registry of at most 10,000 names."""
        return cls({r["name"]: {k: v for k, v in r.asDict().items() if v is not None and k != "name"} for r in df.limit(10_000).collect()}, root)

    def read(self, spark: SparkSession, name: str, stage: str | None = None) -> DataFrame:
        e = self.entries.get(name)
        if e is None:
            raise KeyError(f"unknown dataset {name}; known: {sorted(self.entries)}")
        if stage and bool(e.get("ranking")) != (stage in ("rm", "dpo", "pairwise")):
            raise ValueError(f"dataset {name} does not fit stage {stage}")
        if not e.get("file_name"):
            raise ValueError(f"dataset {name} has no file; hub sources are out of reach here")
        df = read_by_extension(spark, [os.path.join(self.root, e["file_name"])])
        for ours, theirs in (e.get("columns") or e.get("columns_map") or {}).items():
            if theirs in df.columns and ours not in df.columns:
                df = df.withColumnRenamed(theirs, ours)
        return df


def write_by_source(df: DataFrame, path: str, by: tuple = ("source",)) -> None:
    """Replace the partitions that `df` has, and no other."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_results(df: DataFrame, path: str) -> None:
    """Append; readers see whole commits only."""
    df.write.mode("append").parquet(path)


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON object a line, UTF-8."""
    df.write.mode("overwrite").json(path)


def buckets(df: DataFrame, table: str, key: str, n: int) -> None:
    """A bucketed table, so that joins on `key` need no shuffle."""
    df.write.mode("overwrite").bucketBy(n, key).sortBy(key).format("parquet").saveAsTable(table)

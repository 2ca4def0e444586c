
from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException, SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import scalars as S

#: The names a feature table may have, in order of preference.
FEATURE_NAMES = ("radiomics_features.parquet", "features.parquet", "feature_table.parquet", "radiomics_features.csv", "features.csv", "feature_table.csv")
#: Fixed value: the columns of a content-hash index.
INDEX_SCHEMA = "sample_id string, uri string, content_hash string, size long, last_modified string, version_id string, etag string"


def table_format(path: str, strict: bool = True) -> str:
    """SRC-01 to SRC-03: by extension; unless ``strict``, anything but Parquet counts as CSV."""
    low = path.lower()
    if low.endswith(".parquet"):
        return "parquet"
    if low.endswith(".csv") or not strict:
        return "csv"
    raise ValueError(f"not a Parquet or CSV table: {path}")


def read_table(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """A Parquet table, or a CSV table with header, inferred types and unchanged names."""
    if (fmt or table_format(path)) == "parquet":
        return spark.read.parquet(path)
    return spark.read.csv(path, header=True, inferSchema=True)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """SRC-10, SRC-11: (uri, size, last_modified) of all files below ``root``; a missing folder is empty. Contents are not read."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "uri string, size long, last_modified timestamp")
    return files.select(F.col("path").alias("uri"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))


def image_files(spark: SparkSession, root: str) -> DataFrame:
    """SRC-19: image files, without names that begin with a dot, in the order of their paths, with their sample ids."""
    name = S.base_name(F.col("uri"))
    found = listing(spark, root).where(name.rlike(S.EXTENSIONS) & ~name.startswith("."))
    return found.withColumn("sample_id", S.sample_id(F.col("uri"))).orderBy("uri")


def dicom_folders(spark: SparkSession, root: str) -> DataFrame:
    """SRC-22: folders that hold a ``.dcm`` file or one without an extension."""
    name = S.base_name(F.col("uri"))
    found = listing(spark, root).where(F.lower(name).endswith(".dcm") | ~name.contains("."))
    return found.select(F.regexp_replace("uri", "/[^/]*$", "").alias("folder")).distinct().orderBy("folder")


def feature_file(spark: SparkSession, root: str) -> str:
    """SRC-07: the feature table below ``root``: a known name in its top folder, else the first table in the order of paths."""
    if root.lower().endswith((".parquet", ".csv")):
        return root
    base = F.col("uri")
    tables = listing(spark, root).where(F.lower(base).rlike(r"\.(parquet|csv)$"))
    folder = root.rstrip("/").split("/")[-1]
    top = F.element_at(F.split(base, "/"), -2) == folder
    rank = F.when(top, F.array_position(F.array(*map(F.lit, FEATURE_NAMES)), S.base_name(base)))
    row = tables.agg(F.min(F.struct(F.coalesce(F.nullif(rank, F.lit(0)), F.lit(99)).alias("rank"), base.alias("uri"))).alias("m")).first()
    if row["m"] is None:
        raise FileNotFoundError(f"no feature table below {root}")
    return row["m"]["uri"]


def read_hash_index(spark: SparkSession, uri: str) -> DataFrame:
    """SRC-09: the index at ``uri``; a missing or unreadable one is empty and has all columns."""
    try:
        spark.read.parquet(uri)  # reads a footer, so that a file of another kind is found out here
    except (AnalysisException, Py4JJavaError, SparkRuntimeException, PySparkException):
        return spark.createDataFrame([], INDEX_SCHEMA)
    return spark.read.schema(INDEX_SCHEMA).parquet(uri)


def write_hash_index(index: DataFrame, uri: str) -> None:
    """SNK-01: last writer wins. Must not be derived from the files at ``uri``."""
    index.select(*[f.split()[0] for f in INDEX_SCHEMA.split(", ")]).write.mode("overwrite").parquet(uri)


def hashed(spark: SparkSession, root: str) -> DataFrame:
    """The files below ``root`` as an index. SHA-256 is computed where the file is read; a file must fit an executor's row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("path").rlike(S.EXTENSIONS))
    return files.select(
        S.sample_id(F.col("path")).alias("sample_id"), F.col("path").alias("uri"), F.sha2("content", 256).alias("content_hash"), F.col("length").alias("size"),
        F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_modified"), F.lit(None).cast("string").alias("version_id"), F.lit(None).cast("string").alias("etag"),
    )

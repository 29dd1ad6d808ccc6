"""Files in and out: CSV with fixed schemas, images, tables that grow by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", rows: int | None = None, order: str | None = None) -> DataFrame:
    """CSV with doubled quotes. A row limit needs the column that orders the rows."""
    wide = T.StructType.fromDDL(schema).add("_corrupt", T.StringType())
    df = spark.read.schema(wide).csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt").drop("_corrupt")
    if rows is None:
        return df
    if order is None:
        raise ValueError("a limit without an order isn't determinate")
    return df.orderBy(order).limit(rows)


def read_keyed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with every text stripped."""
    df = read_csv(spark, path, schema)
    return df.withColumns({c: text.strip(F.col(c)) for c, t in df.dtypes if t == "string"})


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").csv(path, header=True, sep=sep, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def append_csv(df: DataFrame, path: str, schema: str) -> None:
    """Append rows to a folder of CSV files; nothing is written for none, and columns that differ raise.

    Every file has a header, so readers know its columns; rows that a failed
    job left half written aren't among the folder's files.
    """
    check_schema(df, T.StructType.fromDDL(schema))
    if not df.isEmpty():
        df.write.mode("append").csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_sheet(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Records of a staged sheet as text, empty where a cell is, and its headers in order."""
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    return df.na.fill(""), df.columns


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose key isn't stored yet; the stored schema must be the same."""
    spark = df.sparkSession
    if exists(spark, path):
        stored = spark.read.parquet(path)
        check_schema(df, stored.schema)
        df = df.join(stored.select(*keys), keys, "left_anti")
    df.dropDuplicates(keys).write.mode("append").parquet(path)


def before_batch(spark: SparkSession, path: str, batch: int, schema: str) -> DataFrame:
    """Rows that the batches before this one stored below ``path/batch=<number>``."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, batch int").parquet(path).filter(F.col("batch") < batch).drop("batch")


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(location)


def check_schema(df: DataFrame, schema: T.StructType) -> None:
    """Raise if names, order or types differ."""
    have, want = [(f.name, f.dataType) for f in df.schema], [(f.name, f.dataType) for f in schema]
    if have != want:
        raise ValueError(f"columns {have} are not {want}")


def with_image_names(images: DataFrame) -> DataFrame:
    """Names for images that have none, where both parts of the name are known."""
    empty = F.coalesce(F.col("image_name"), F.lit("")) == ""
    known = (F.coalesce(F.col("source_id"), F.lit("")) != "") & (F.coalesce(F.col("image_url"), F.lit("")) != "")
    return images.withColumn("image_name", F.when(empty & known, text.image_name(F.col("source_id"), F.col("image_url"))).otherwise(F.col("image_name")))


def write_failures(state: DataFrame, path: str) -> None:
    """All failures, most attempts first."""
    write_csv(state.orderBy(F.desc("attempts"), "source_id"), path)


def project(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns in order; missing ones are empty, others are left out."""
    return df.select(*(F.col(n) if n in df.columns else F.lit("").alias(n) for n in names))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, name, content, mime and base64 of image files."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return df.select("path", name.alias("name"), "content", mime(name).alias("mime"), F.base64("content").alias("base64"), is_image(F.col("content")).alias("valid"))


def mime(name: Column) -> Column:
    kind = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    return F.when(kind == ".png", "image/png").when(kind == ".webp", "image/webp").when(kind == ".gif", "image/gif").otherwise("image/jpeg")


def is_image(content: Column) -> Column:
    """Whether the first bytes are those of JPEG, PNG, GIF or RIFF."""
    head = F.hex(F.substring(content, 1, 4))
    return F.coalesce(F.startswith(head, F.lit("FFD8")) | head.isin("89504E47", "47494638", "52494646"), F.lit(False))


def to_json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))

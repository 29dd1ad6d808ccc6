"""Pages that arrive as files: micro-batches into keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest, labels
from ..sources import files, pages, schemas
from ..sources.tables import VersionedTable


def page_stream(spark: SparkSession, path: str, schema: str = "url string, html string", files_at_a_time: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_a_time).parquet(path)


def ingest_batch(batch: DataFrame, number: int, folder: str, least_images: int = 2) -> None:
    """Listings, images and log of one batch of pages, each row stored once.

    Images already stored are not counted, so a listing that is met again
    without new photos is of low quality. Rows are written below the batch's
    number, over what an earlier run of it wrote, and only the batches before
    it are read; so a batch that runs again counts what it counted.
    """
    spark = batch.sparkSession
    before = lambda table, schema: files.before_batch(spark, f"{folder}/{table}", number, schema)
    read = pages.listing_fields(batch.filter("url is not null").dropDuplicates(["url"]), photos=True).persist()
    try:
        images = read.select("source_id", F.col("url").alias("listing_url"), F.explode("photos").alias("image_url"), F.lit(None).cast("string").alias("image_name"))
        images = files.with_image_names(images).join(before("images", schemas.IMAGES).select("source_id", "image_url"), ["source_id", "image_url"], "left_anti").dropDuplicates(["source_id", "image_url"])
        counts = images.groupBy("source_id").agg(F.count("*").cast("int").alias("image_count"))
        error = F.when(F.col("price_man_yen").isNull(), F.lit("no price"))
        told = read.drop("photos").join(counts, "source_id", "left").withColumn("image_count", F.coalesce("image_count", F.lit(0)))
        told = told.withColumn("status", ingest.listing_status(F.col("image_count"), error, least_images)).withColumn("reason", error)
        fresh = ingest.new_rows(told.filter("status = 'ok'").drop("status", "reason"), before("listings", schemas.LISTINGS), ["source_id"])
        write = lambda df, table: df.write.mode("overwrite").parquet(f"{folder}/{table}/batch={number}")
        write(project(fresh, schemas.LISTINGS), "listings")
        write(images.select("source_id", "listing_url", "image_url", "image_name"), "images")
        write(told.select("source_id", "url", "status", F.substring(F.coalesce("reason", "status"), 1, 240).alias("reason"), F.current_timestamp().alias("at")), "log")
    finally:
        read.unpersist()


def project(df: DataFrame, schema: str) -> DataFrame:
    return df.select(*(c.split()[0] for c in schema.split(", ")))


def run(spark: SparkSession, source: str, folder: str, checkpoint: str | None = None) -> StreamingQuery:
    """Take in what is there and stop; a later run goes on where this one ended. The checkpoint numbers the batches, so it belongs to the folder."""
    stream = page_stream(spark, source).writeStream.foreachBatch(lambda df, number: ingest_batch(df, number, folder))
    return stream.option("checkpointLocation", checkpoint or f"{folder}/_checkpoint").trigger(availableNow=True).start()


def failed_listings(spark: SparkSession, folder: str) -> DataFrame:
    """Listings whose last attempt failed, with their attempts."""
    log = spark.read.parquet(f"{folder}/log")
    return ingest.failures(log, "source_id", F.col("status") != "ok", F.col("status") == "ok", "at", "reason")


def label_stream(spark: SparkSession, source: str, schema: str, table: str, key: str, checkpoint: str) -> StreamingQuery:
    """Label changes that arrive as JSON files, merged into a versioned table by key.

    Of changes to one key the last counts: that of the file that was written
    last, then the one that stands last in its file. A batch writes its own
    version and puts it in force last, so one that runs again leaves the same
    table.
    """
    versions = VersionedTable(spark, table)
    where = ("_written", "_file", "_block", "_place")

    def merge(batch: DataFrame, number: int) -> None:
        if versions.version() == number:  # in force, but not marked as done
            return
        placed = batch.withColumn("_place", F.monotonically_increasing_id())
        base = spark.read.parquet(versions.location(number - 1)) if number and versions.version() is not None else batch.drop(*where).limit(0)
        last = ingest.last_wins(placed, [key], [F.col(c).desc_nulls_last() for c in where]).drop(*where)
        versions.publish(labels.upsert(base, last, key), number)

    met = (F.col(f"_metadata.{n}").alias(c) for n, c in zip(("file_modification_time", "file_path", "file_block_start"), where))
    changes = spark.readStream.schema(schema).json(source).select("*", *met)
    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

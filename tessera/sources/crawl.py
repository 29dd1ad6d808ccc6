"""Result pages as a stream, and the crawl that follows them.

``paged_source`` makes a streaming data source over a chain of result pages. Its
offsets are cursors: the number of pages read so far. A page is fetched once, on
the driver, as each names the next; it is written to the source's folder before
an offset covers it, and tasks read it from there. So any batch can be read
again as it was, whatever the site shows by then, and a new run goes on behind
the last stored page.

``run`` takes each batch of result pages into tables: listings worth trying
again, then those that the pages name and that aren't stored, up to the target;
their pages, photos, downloads and failures. A batch writes each table's rows
below its own number, over what an earlier run of it wrote, and reads only the
batches before it, so a batch that runs again leaves the same tables.

Defined results: a page without a following one ends the chain until it is
fetched again by a later run; a result page that fails ``patience`` times ends
the run, and a later one tries it again; a listing that can't be fetched, whose
page can't be read, or that has too few new images is a failure, and gives no
listing row; repeated links count once; NULL links are left out.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X
from ..operators import ingest
from ..session import cut
from . import files, frontier, images, pages, schemas

PAGE = "page int, url string, html string"
LEAST_IMAGES = 2
MOST_ATTEMPTS = 5
RETRIES = 20  # failures tried again beside a batch's own listings
REFUSALS = 3  # refused answers within a page that lengthen the pause


class Stored:
    """Result pages in a folder that driver and executors reach, numbered from 0."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.store.create_dir(self.root, recursive=True)

    def _path(self, page: int) -> str:
        return f"{self.root}/{page:08d}.json"

    def get(self, page: int) -> dict | None:
        from pyarrow import fs

        if self.store.get_file_info(self._path(page)).type != fs.FileType.File:
            return None
        with self.store.open_input_stream(self._path(page)) as f:
            return json.loads(f.read())

    def put(self, page: int, row: dict) -> None:
        aside = f"{self.root}/.{uuid.uuid4().hex}"
        with self.store.open_output_stream(aside) as out:
            out.write(json.dumps(row).encode())
        self.store.move(aside, self._path(page))


def following(html: str, url: str) -> str | None:
    """Address of the page after a result page."""
    from urllib.parse import urljoin

    named = pages.read_page(html).next
    return urljoin(url, named) if named else None


def paged_source(fetch: pages.Fetch, start: str, folder: str, pages_at_a_time: int = 1, attempts: int = 6, patience: int = 3, cooldown: float = 300.0, least_pause: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> type[DataSource]:
    """A streaming data source ``result_pages`` over the chain that begins at ``start``."""

    class Reader(DataSourceStreamReader):
        def __init__(self) -> None:
            self.stored, self.page, self.pause = Stored(folder), 0, least_pause
            self.ended = False

        def initialOffset(self) -> dict:
            return {"page": 0}

        def _fetch(self, url: str) -> str | None:
            """Body of a result page; None after ``patience`` failures with a rest between them."""
            for nth in range(patience):
                refused: list[int] = []
                try:
                    status, html = pages.fetched(fetch, url, attempts, 1.5, sleep, refused.append)
                    if status == 200:
                        many = refused.count(503) >= REFUSALS
                        self.pause = ingest.next_delay(self.pause, many, least_pause)
                        sleep(cooldown if many else self.pause)
                        return html
                except OSError:
                    pass
                if nth + 1 < patience:
                    sleep(cooldown)
            return None

        def latestOffset(self) -> dict:
            """Up to ``pages_at_a_time`` pages more than the last time, each stored before it is told."""
            for _ in range(pages_at_a_time):
                row = None if self.ended else self.stored.get(self.page)
                if row is None and not self.ended:
                    last = self.stored.get(self.page - 1) if self.page else None
                    url = start if self.page == 0 else following(last["html"], last["url"])
                    html = self._fetch(url) if url else None
                    if html is None:
                        self.ended = True  # for this run
                    else:
                        self.stored.put(self.page, row := {"url": url, "html": html})
                if row is None:
                    break
                self.page += 1
            return {"page": self.page}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            self.page = max(self.page, end["page"])
            return [InputPartition(n) for n in range(start["page"], end["page"])]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            row = Stored(folder).get(partition.value)
            yield partition.value, row["url"], row["html"]

    class ResultPages(DataSource):
        @classmethod
        def name(cls) -> str:
            return "result_pages"

        def schema(self) -> str:
            return PAGE

        def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
            return Reader()

    return ResultPages


def carry_failures(before: DataFrame, log: DataFrame) -> DataFrame:
    """Failing listings after a batch's results: attempts go on, successes leave."""
    last = log.groupBy("source_id").agg(F.max_by("url", "at").alias("url"), F.max("at").alias("last_at"), F.max_by("reason", "at").alias("last_reason"), F.bool_or(F.col("status") == "ok").alias("ok"))
    both = before.alias("b").join(last.alias("n"), "source_id", "full").filter(~F.coalesce("n.ok", F.lit(False)))
    failed = F.col("n.last_at").isNotNull()
    latest = lambda c: F.when(failed, F.col(f"n.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
    return both.select("source_id", latest("url"), (F.coalesce("b.attempts", F.lit(0)) + failed.cast("int")).alias("attempts"), latest("last_reason"), latest("last_at"))


def take_in(batch: DataFrame, number: int, folder: str, fetch: pages.Fetch, fetch_image: images.FetchImage, target: int, most_probes: int = 0, parallel: int = 1, hosts: tuple[str, ...] = ()) -> None:
    """One batch of result pages into the tables below ``folder``."""
    spark = batch.sparkSession
    stored = files.before_batch(spark, f"{folder}/listings", number, schemas.LISTINGS).filter(F.col("image_count") >= LEAST_IMAGES).select("source_id").distinct()
    remaining = target - stored.count()
    if remaining <= 0:
        return
    failing = files.before_batch(spark, f"{folder}/failing", number, schemas.FAILING + ", of int").filter(F.col("of") == number - 1).drop("of")
    retry = failing.filter(F.col("attempts") < MOST_ATTEMPTS).join(stored, "source_id", "left_anti").orderBy("attempts", "source_id").limit(min(RETRIES, remaining)).select("url")
    fresh = pages.detail_links(batch.filter("html is not null")).select(F.col("link").alias("url")).withColumn("source_id", X.source_id(F.col("url")))
    fresh = fresh.join(stored, "source_id", "left_anti").select("url")
    chosen = ingest.candidates(retry, fresh, "url", remaining).select("url")
    # written once: another fetch may answer otherwise
    got = cut(pages.fetch_pages(chosen, fetch, parallel)).withColumn("source_id", X.source_id(F.col("url")))
    right = got.filter("status = 200 and html is not null")
    fields = cut(pages.listing_fields(right, photos=True))
    met = fields.select("source_id", "url", "photos")
    if most_probes:
        load = lambda urls: pages.fetch_pages(urls, fetch, parallel).select("url", F.when(F.col("status") == 200, F.col("html")).alias("html"))
        met = frontier.collect_photos(right, load, most_probes, hosts).select("source_id", "url", "photos")
    found = met.select("source_id", F.col("url").alias("listing_url"), F.explode("photos").alias("image_url"), F.lit(None).cast("string").alias("image_name"))
    found = files.with_image_names(found).join(files.before_batch(spark, f"{folder}/images", number, schemas.IMAGES), ["source_id", "image_url"], "left_anti").dropDuplicates(["source_id", "image_url"])
    had = images.download(found, fetch_image, f"{folder}/photos", f"{folder}/manifests/{number}").drop("bytes")
    counts = had.groupBy("source_id").agg(F.count("*").cast("int").alias("image_count"))
    told = got.select("source_id", "url", "status", "error").dropDuplicates(["source_id"]).join(counts, "source_id", "left").withColumn("image_count", F.coalesce("image_count", F.lit(0)))
    error = F.when(F.col("error").isNotNull(), F.concat(F.lit("fetch_failed:"), F.col("error"))).when(F.col("status") != 200, F.concat(F.lit("fetch_failed:"), F.col("status").cast("string")))
    status = ingest.listing_status(F.col("image_count"), error, LEAST_IMAGES)
    reason = F.when(status == "low_quality", F.concat(F.lit("low_images:"), F.col("image_count").cast("string"))).otherwise(error)
    log = cut(told.select("source_id", "url", status.alias("status"), X.truncated(reason).alias("reason"), F.current_timestamp().alias("at"), "image_count"))
    ok = log.filter("status = 'ok'").select("source_id", "image_count")
    write = lambda df, table: df.write.mode("overwrite").parquet(f"{folder}/{table}/batch={number}")
    write(fields.drop("photos").dropDuplicates(["source_id"]).join(ok, "source_id"), "listings")
    write(had.join(ok.select("source_id"), "source_id", "left_semi"), "images")
    write(log.drop("image_count"), "log")
    write(carry_failures(failing, log.drop("image_count")).withColumn("of", F.lit(number)), "failing")


def run(spark: SparkSession, start: str, folder: str, fetch: pages.Fetch, fetch_image: images.FetchImage, target: int = 22_000, pages_at_a_time: int = 1, most_probes: int = 0, parallel: int = 1, hosts: tuple[str, ...] = (), **source) -> StreamingQuery:
    """The crawl as a streaming query; ``processAllAvailable`` waits until the chain of pages ends. A later run goes on."""
    spark.dataSource.register(paged_source(fetch, start, f"{folder}/_pages", pages_at_a_time, **source))
    stream = spark.readStream.format("result_pages").load()
    take = lambda batch, number: take_in(batch, number, folder, fetch, fetch_image, target, most_probes, parallel, hosts)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/_checkpoint").start()


def listings(spark: SparkSession, folder: str) -> DataFrame:
    return files.before_batch(spark, f"{folder}/listings", 1 << 30, schemas.LISTINGS)


def failing(spark: SparkSession, folder: str) -> DataFrame:
    """Listings that fail now, as the last batch left them."""
    every = files.before_batch(spark, f"{folder}/failing", 1 << 30, schemas.FAILING + ", of int")
    return every.join(F.broadcast(every.agg(F.max("of").alias("of"))), "of").drop("of")

"""Image download as a data source that is written to.

A task fetches each image, writes it aside and moves it to ``root/<source_id>/<image_name>``,
so a file of that name is always whole, and one that is there isn't fetched
again. Beside the files a task writes one manifest of what it has; the job's
commit moves the tasks' manifests into the table of downloaded images, and an
abort deletes them. So a task that fails, or runs twice, leaves no image counted
that its job didn't commit.

Defined results: rows with a null or empty source_id, image_name or image_url
are left out; an answer that isn't 200, or whose content type is neither of
images nor a plain stream, is no image and is left out; a fetch that raises
counts as no answer; equal rows are counted once a task.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

# status, content type, body; the second argument is the page that the image was met on
FetchImage = Callable[[str, str], tuple[int, str | None, bytes]]
MANIFEST = "source_id string, listing_url string, image_url string, image_name string, bytes bigint"


def is_image_type(kind: str | None) -> bool:
    """Whether a content type may be an image's; an absent one may."""
    low = (kind or "").lower()
    return not low or "image" in low or "octet-stream" in low


@dataclass
class Written(WriterCommitMessage):
    manifest: str
    images: int


def image_sink(fetch: FetchImage) -> type[DataSource]:
    """A data source ``images`` that fetches with ``fetch``; its options are ``root`` and ``manifest``, folders that all executors reach."""

    class Writer(DataSourceWriter):
        def __init__(self, options: dict[str, str]):
            self.root, self.told = options["root"].rstrip("/"), options["manifest"].rstrip("/")
            self.job = uuid.uuid4().hex

        def _store(self, folder: str):
            from pyarrow import fs

            return fs.FileSystem.from_uri(folder)

        def _save(self, row: Row) -> int | None:
            """Bytes of the image, fetched unless its file is there; None without one."""
            from pyarrow import fs

            store, root = self._store(self.root)
            at = f"{root}/{row.source_id}/{row.image_name}"
            info = store.get_file_info(at)
            if info.type == fs.FileType.File:
                return info.size
            try:
                status, kind, body = fetch(row.image_url, row.listing_url)
            except Exception:  # noqa: BLE001  whatever the fetcher raises
                return None
            if status != 200 or not is_image_type(kind):
                return None
            store.create_dir(f"{root}/{row.source_id}", recursive=True)
            aside = f"{root}/{row.source_id}/.{uuid.uuid4().hex}"
            with store.open_output_stream(aside) as out:
                out.write(body)
            store.move(aside, at)
            return len(body)

        def write(self, iterator: Iterator[Row]) -> Written:
            store, told = self._store(self.told)
            store.create_dir(f"{told}/_staged-{self.job}", recursive=True)
            name, met = f"_staged-{self.job}/{uuid.uuid4().hex}.json", set()
            with store.open_output_stream(f"{told}/{name}") as out:
                for row in iterator:
                    key = (row.source_id, row.image_url)
                    if key in met or not (row.source_id and row.image_name and row.image_url):
                        continue
                    size = self._save(row)
                    if size is not None:
                        met.add(key)
                        line = {"source_id": row.source_id, "listing_url": row.listing_url, "image_url": row.image_url, "image_name": row.image_name, "bytes": size}
                        out.write((json.dumps(line) + "\n").encode())
            return Written(name, len(met))

        def commit(self, messages: list[WriterCommitMessage | None]) -> None:
            store, told = self._store(self.told)
            for m in messages:
                if m is not None and m.images:
                    store.move(f"{told}/{m.manifest}", f"{told}/{m.manifest.rpartition('/')[2]}")
            self._clean()

        def abort(self, messages: list[WriterCommitMessage | None]) -> None:
            self._clean()

        def _clean(self) -> None:
            from pyarrow import fs

            store, told = self._store(self.told)
            if store.get_file_info(f"{told}/_staged-{self.job}").type == fs.FileType.Directory:
                store.delete_dir(f"{told}/_staged-{self.job}")

    class Images(DataSource):
        @classmethod
        def name(cls) -> str:
            return "images"

        def schema(self) -> str:
            return "source_id string, listing_url string, image_url string, image_name string"

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            return Writer(self.options)

    return Images


def download(images: DataFrame, fetch: FetchImage, root: str, manifest: str) -> DataFrame:
    """Fetch the images of a table and return what this job has, from the manifests of ``manifest``."""
    spark = images.sparkSession
    spark.dataSource.register(image_sink(fetch))
    rows = images.select("source_id", "listing_url", "image_url", "image_name")
    rows.write.format("images").mode("append").option("root", root).option("manifest", manifest).save()
    return downloaded(spark, manifest)


def downloaded(spark: SparkSession, manifest: str) -> DataFrame:
    """Images that committed jobs have downloaded, one row for each listing and address."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(manifest)
    if store.get_file_info(path).type != fs.FileType.Directory:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(manifest).dropDuplicates(["source_id", "image_url"]).select(*(F.col(c.split()[0]) for c in MANIFEST.split(", ")))

"""Versions that are swapped whole, migration of old tables, and downloads that count when their job commits."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.sources import files, images, schemas, tables


def test_a_crash_before_the_pointer_moves_leaves_the_last_version(spark, tmp_path, monkeypatch):
    table = tables.VersionedTable(spark, f"{tmp_path}/t")
    assert table.version() is None
    with pytest.raises(FileNotFoundError):
        table.read()
    table.publish(spark.range(3))
    monkeypatch.setattr(table, "point", lambda version: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError):
        table.publish(spark.range(5))
    monkeypatch.undo()
    again = tables.VersionedTable(spark, f"{tmp_path}/t")
    assert (again.version(), again.read().count()) == (0, 3)
    assert again.publish(spark.range(7)) == 1 and again.read().count() == 7  # over what the crash left
    with pytest.raises(ValueError):
        again.publish(spark.range(1), version=1)
    again.publish(spark.range(8))
    again.drop_old(keep=1)
    assert sorted(n for n in os.listdir(f"{tmp_path}/t") if n.startswith("v")) == ["v1", "v2"]


def test_old_image_tables_gain_names_and_others_raise(spark, tmp_path):
    old = spark.createDataFrame([("1", "l", "https://h/a.PNG"), ("", "l", "https://h/b.jpg"), ("2", "l", "")], "source_id string, listing_url string, image_url string")
    files.write_csv(old, f"{tmp_path}/csv")
    table = tables.VersionedTable(spark, f"{tmp_path}/images")
    tables.import_csv(table, f"{tmp_path}/csv", "source_id string, listing_url string, image_url string")
    got = {r.image_url: r.image_name for r in tables.ensure(table, schemas.IMAGES, tables.IMAGE_FILLS).collect()}
    assert got["https://h/a.PNG"].startswith("1_") and got["https://h/a.PNG"].endswith(".png")
    assert [v for k, v in got.items() if k != "https://h/a.PNG"] == [None, None]
    assert table.version() == 1 and tables.ensure(table, schemas.IMAGES, tables.IMAGE_FILLS).count() == 3 and table.version() == 1
    with pytest.raises(ValueError):
        tables.ensure(table, schemas.IMAGES + ", extra int")
    with pytest.raises(ValueError):
        tables.ensure(table, schemas.IMAGES.replace("image_name string", "image_name int"))
    assert table.version() == 1
    fresh = tables.VersionedTable(spark, f"{tmp_path}/fresh")
    assert tables.ensure(fresh, schemas.LISTINGS).columns == [c.split()[0] for c in schemas.LISTINGS.split(", ")] and fresh.read().count() == 0


def _rows(spark, n):
    made = [(str(i % 3), "https://h/l", f"https://h/{i}.jpg", f"{i % 3}_{i}.jpg") for i in range(n)]
    return spark.createDataFrame(made + [(None, "l", "https://h/n.jpg", "n"), ("1", "l", "", "x"), made[0]], schemas.IMAGES)


def test_only_images_of_committed_jobs_count(spark, tmp_path):
    root, manifest = f"file://{tmp_path}/img", f"file://{tmp_path}/told"
    assert images.downloaded(spark, manifest).count() == 0

    def fetch(url, referer):
        if url.endswith("/3.jpg"):
            return 200, "text/html", b"no"
        if url.endswith("/4.jpg"):
            raise OSError("gone")
        return (404, None, b"") if url.endswith("/5.jpg") else (200, None if url.endswith("/6.jpg") else "IMAGE/jpeg", b"x" * 7)

    got = images.download(_rows(spark, 8).repartition(3), fetch, root, manifest).collect()
    assert sorted(r.image_url for r in got) == [f"https://h/{i}.jpg" for i in (0, 1, 2, 6, 7)] and {r.bytes for r in got} == {7}
    assert (tmp_path / "img" / "0" / "0_0.jpg").read_bytes() == b"x" * 7

    def other(url, referer):
        raise AssertionError("it is there")

    again = images.download(_rows(spark, 3), other, root, manifest)
    assert again.count() == 5  # files that are there aren't fetched and count once


def test_a_job_that_fails_half_way_counts_nothing(spark, tmp_path):
    root, manifest = f"file://{tmp_path}/img", f"file://{tmp_path}/told"
    broken = F.udf(lambda n: n if int(n.split("_")[1].split(".")[0]) < 9 else 1 / 0, "string")
    rows = spark.createDataFrame([("1", "l", f"https://h/{i}.jpg", f"1_{i}.jpg") for i in range(12)], schemas.IMAGES).coalesce(1)
    with pytest.raises(Exception):
        images.download(rows.withColumn("image_name", broken("image_name")), lambda u, r: (200, "image/png", b"x"), root, manifest)
    assert images.downloaded(spark, manifest).count() == 0 and not [n for n in os.listdir(tmp_path / "told") if n.startswith("_staged")]
    assert images.download(rows, lambda u, r: (200, "image/png", b"x"), root, manifest).count() == 12

import pytest
from pyspark.sql import functions as F

from tessera.operators import ingest
from tessera.sources import files, pages, schemas, tables
from tessera.streaming import ingest as stream

LISTING = """<html><body><table><tr><th>価格</th><td>4980万円</td></tr><tr><th> 間取り </th><td>3LDK</td></tr><tr><td>x</td></tr></table>
<dl><dt>専有面積（壁芯）</dt><dd>70.5m2</dd><dt>完成時期（築年月）</dt><dd>2008年3月</dd></dl><dl><dt>a</dt></dl>
<p>住所
東京都中野区 交通</p><p>「中野」徒歩5分</p><p>所在階/構造・階建 3階/RC10階建</p>
<img src="/photo/a.jpg"><img data-src="//h.example/photo/b.png"><img src="logo.png"><script>var x="https:\\/\\/h.example\\/image\\/c.webp";</script>
<a href="/ms/chuko/nc_7/?x=1">l</a><a href="next.html">次へ</a></body></html>"""


def test_listing_page(spark):
    df = spark.createDataFrame([("https://h.example/ms/chuko/nc_123/", LISTING), ("https://h.example/empty", None)], "url string, html string")
    got = {r.url: r for r in pages.listing_fields(df).collect()}
    r = got["https://h.example/ms/chuko/nc_123/"]
    assert (r.source_id, r.price_man_yen, r.layout, r.area_sqm, r.year_built, r.floor_number, r.floors_total) == ("123", 4980, "3LDK", 70.5, 2008, 3, 10)
    assert (r.address, r.nearest_station, r.walk_minutes) == ("東京都中野区", "中野駅", 5)
    assert got["https://h.example/empty"].price_man_yen is None
    assert pages.page_pairs(LISTING) == [("価格", "4980万円"), ("間取り", "3LDK"), ("専有面積（壁芯）", "70.5m2"), ("完成時期（築年月）", "2008年3月")]
    photos = [r.p for r in df.select(pages.page_photos("html", "url").alias("p")).collect()]
    assert photos[0] == ["https://h.example/photo/a.jpg", "https://h.example/photo/b.png", "https://h.example/image/c.webp"] and photos[1] == []
    assert [r.link for r in pages.detail_links(df).collect()] == ["https://h.example/ms/chuko/nc_7/"]
    assert df.select(pages.next_page("html", "url")).first()[0] == "https://h.example/ms/chuko/nc_123/next.html"


def test_fetching_tries_again():
    calls, waits = [], []

    def fetch(url):
        calls.append(url)
        return (503, "", 9.0) if len(calls) < 3 else (200, "body", None)

    assert pages.fetched(fetch, "u", sleep=waits.append) == (200, "body")
    assert waits[0] == 9.0 and waits[1] >= 9.0 and len(calls) == 3
    with pytest.raises(OSError):
        pages.fetched(lambda u: (500, "", None), "u", attempts=2, sleep=lambda s: None)


def test_fetch_pages_and_geocode(spark):
    urls = spark.createDataFrame([("a",), ("b",)], "url string")
    got = {r.url: (r.status, r.html, r.error) for r in pages.fetch_pages(urls, lambda u: (200, u * 2, None) if u == "a" else (404, "", None)).collect()}
    assert got == {"a": (200, "aa", None), "b": (404, "", None)}
    homes = spark.createDataFrame([("x",), ("x",), ("bad",), (None,)], "address string")
    found = {r.address: (r.latitude, r.longitude) for r in pages.geocode(homes, lambda a: {"x": (1.0, 2.0)}[a]).collect()}
    assert found == {"x": (1.0, 2.0), "bad": (None, None)}


def test_csv_round_trip_and_limits(spark, tmp_path):
    df = spark.createDataFrame([("1", "u", 'say "a", b\nc', " n ")], schemas.IMAGES)
    files.write_csv(df, f"{tmp_path}/i", sep=";")
    assert files.read_csv(spark, f"{tmp_path}/i", schemas.IMAGES, sep=";").collect() == df.collect()
    files.write_csv(df, f"{tmp_path}/k")
    assert files.read_keyed(spark, f"{tmp_path}/k", schemas.IMAGES).first().image_name == "n"
    with pytest.raises(ValueError):
        files.read_csv(spark, f"{tmp_path}/k", schemas.IMAGES, rows=1)
    assert files.read_csv(spark, f"{tmp_path}/k", schemas.IMAGES, rows=1, order="source_id").count() == 1


def test_append_is_idempotent_and_checked(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, x string")
    for _ in range(2):
        files.append_new(df, f"{tmp_path}/t", ["id"])
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2
    with pytest.raises(ValueError):
        files.append_new(df.withColumnRenamed("x", "y"), f"{tmp_path}/t", ["id"])


def test_images(spark, tmp_path):
    (tmp_path / "a.PNG").write_bytes(b"\x89PNGxxxx")
    (tmp_path / "b.jpg").write_bytes(b"text")
    got = {r.name: (r.mime, r.valid) for r in files.read_images(spark, str(tmp_path)).collect()}
    assert got == {"a.PNG": ("image/png", True), "b.jpg": ("image/jpeg", False)}
    named = files.with_image_names(spark.createDataFrame([("1", "l", "http://h/a.jpg", ""), ("", "l", "u", None), ("1", "l", "u", "kept")], schemas.IMAGES)).collect()
    assert named[0].image_name.startswith("1_") and named[1].image_name is None and named[2].image_name == "kept"
    assert files.project(spark.range(1), ["x", "id"]).columns == ["x", "id"]
    assert files.to_json_rows(spark.range(1)).first().value == '{"id":0}'


def test_stream_takes_each_listing_once(spark, tmp_path):
    page = lambda n, html=LISTING: (f"https://h.example/ms/chuko/nc_{n}/", html)
    schema = "url string, html string"
    for round_ in ([page(1), page(1), page(2, "<p>no price</p>")], [page(1), page(3), page(2, "<p>still none</p>")]):
        spark.createDataFrame(round_, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert sorted(r.source_id for r in spark.read.parquet(f"{tmp_path}/out/listings").collect()) == ["1", "3"]
    assert spark.read.parquet(f"{tmp_path}/out/images").count() == 6
    failed = {r.source_id: r.attempts for r in stream.failed_listings(spark, f"{tmp_path}/out").collect()}
    assert failed["2"] == 2 and ingest.retry_pick(stream.failed_listings(spark, f"{tmp_path}/out"), "source_id", 5, 10).count() == len(failed)


def test_label_stream(spark, tmp_path):
    import json
    import os

    (tmp_path / "in").mkdir()
    # the last change of a key counts, in the later file and further down in a file, whatever its letters
    batches = ([[("a", "yes"), ("b", "yes"), ("b", "no")]], [[("b", "z"), ("c", "no")], [("b", "x"), ("b", "a")]])
    at = 0
    for rows in batches:
        for file in rows:
            path = tmp_path / "in" / f"{9 - at}.json"
            path.write_text("\n".join(json.dumps({"url": u, "label": v}) for u, v in file))
            os.utime(path, (1_700_000_000 + at, 1_700_000_000 + at))
            at += 1
        stream.label_stream(spark, f"{tmp_path}/in", "url string, label string", f"{tmp_path}/t", "url", f"{tmp_path}/state").awaitTermination()
    table = tables.VersionedTable(spark, f"{tmp_path}/t")
    assert table.version() == 1 and sorted(map(tuple, table.read().collect())) == [("a", "yes"), ("b", "a"), ("c", "no")]
    assert sorted(map(tuple, spark.read.parquet(table.location(0)).collect())) == [("a", "yes"), ("b", "no")]


def test_a_batch_of_pages_that_runs_again_counts_what_it_counted(spark, tmp_path):
    page = lambda n: (f"https://h.example/ms/chuko/nc_{n}/", LISTING)
    first = spark.createDataFrame([page(1), page(2)], "url string, html string")
    second = spark.createDataFrame([page(2), page(3)], "url string, html string")
    folder = f"{tmp_path}/out"
    stream.ingest_batch(first, 0, folder)
    stream.ingest_batch(second, 1, folder)
    state = lambda: {t: sorted(r.source_id for r in spark.read.parquet(f"{folder}/{t}").collect()) for t in ("listings", "images", "log")}
    counts = lambda: sorted((r.source_id, r.image_count) for r in spark.read.parquet(f"{folder}/listings").collect())
    before, had = state(), counts()
    stream.ingest_batch(second, 1, folder)
    assert state() == before and counts() == had and [x for x, _ in had] == ["1", "2", "3"]
    failed = {r.source_id for r in stream.failed_listings(spark, folder).collect()}
    assert failed == {"2"}


def test_appended_csv_and_sheets(spark, tmp_path):
    schema, path = "a string, b int", f"{tmp_path}/c"
    files.append_csv(spark.createDataFrame([("x, y", 1)], schema), path, schema)
    files.append_csv(spark.createDataFrame([('say "z"', None)], schema), path, schema)
    files.append_csv(spark.createDataFrame([], schema), path, schema)
    assert sorted(map(tuple, files.read_csv(spark, path, schema).collect()), key=str) == [('say "z"', None), ("x, y", 1)]
    with pytest.raises(ValueError):
        files.append_csv(spark.createDataFrame([(1,)], "b int"), path, schema)
    records, headers = files.read_sheet(spark, path)
    assert headers == ["a", "b"] and {r.b for r in records.collect()} == {"1", ""}

"""A made site of linked pages: the crawl ends in the same tables however it is cut."""

import sys

import pytest
from pyspark import cloudpickle

from tessera.sources import crawl

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests

HOST = "https://h.example"


def listing(n):
    photos = "".join(f'<img src="/photo/{n}_{i}.jpg">' for i in range(n % 4 + 1))
    return f"<html><table><tr><th>価格</th><td>{1000 + n}万円</td></tr></table>{photos}</html>"


def made_site(pages=4, per_page=3):
    site = {}
    for p in range(pages):
        links = "".join(f'<a href="/ms/chuko/nc_{p * per_page + i}/?from=list">l</a>' for i in range(per_page))
        after = f'<a rel="next" href="?page={p + 1}">次へ</a>' if p + 1 < pages else ""
        site[f"{HOST}/list" + (f"?page={p}" if p else "")] = f"<html>{links}{links}{after}</html>"
    for n in range(pages * per_page):
        site[f"{HOST}/ms/chuko/nc_{n}/"] = listing(n)
    return site


def fetcher(site, refuse=()):
    def fetch(url):
        if url in refuse:
            return 500, "", None
        return (200, site[url], None) if url in site else (404, "", None)

    return fetch


def image(url, referer):
    return (404, None, b"") if url.endswith("/7_0.jpg") else (200, "image/jpeg", url.encode())


def tables(spark, folder):
    listings = sorted((r.source_id, r.price_man_yen, r.image_count) for r in crawl.listings(spark, folder).collect())
    images = sorted((r.source_id, r.image_url) for r in spark.read.parquet(f"{folder}/images").collect())
    failing = sorted((r.source_id, r.last_reason) for r in crawl.failing(spark, folder).collect())
    return listings, images, failing


def crawled(spark, folder, site, stop_after=None, refuse=(), **more):
    query = crawl.run(spark, f"{HOST}/list", f"file://{folder}", fetcher(site, refuse), image, sleep=lambda s: None, attempts=1, patience=1, **more)
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_a_stop_in_the_middle_ends_in_the_same_tables(spark, tmp_path):
    site = made_site()
    crawled(spark, tmp_path / "a", site)
    whole = tables(spark, f"file://{tmp_path}/a")
    good = [n for n in range(12) if n % 4 >= 1]
    assert [x[0] for x in whole[0]] == sorted(map(str, good)) and ("7", 1007, 3) in whole[0]
    assert len(whole[1]) == sum(n % 4 + 1 for n in good) - 1
    assert whole[2] == sorted((str(n), "low_images:1") for n in range(12) if n % 4 == 0)
    # the third result page can't be had at first, so the run ends there
    crawled(spark, tmp_path / "b", site, refuse=(f"{HOST}/list?page=2",))
    assert len(tables(spark, f"file://{tmp_path}/b")[0]) < len(whole[0])
    crawled(spark, tmp_path / "b", site)
    assert tables(spark, f"file://{tmp_path}/b") == whole


def test_a_batch_that_runs_again_reads_the_stored_pages(spark, tmp_path):
    site = made_site(pages=2)
    crawled(spark, tmp_path / "a", site)
    whole = tables(spark, f"file://{tmp_path}/a")
    newest = max((tmp_path / "a" / "_checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    newest.unlink()
    (newest.parent / f".{newest.name}.crc").unlink(missing_ok=True)
    changed = {u: h for u, h in site.items() if "/list" not in u} | {f"{HOST}/list": "<html></html>"}
    crawled(spark, tmp_path / "a", changed)  # the batch is read from the folder, not from the site
    assert tables(spark, f"file://{tmp_path}/a") == whole


def test_target_and_attempts(spark, tmp_path):
    site = made_site(pages=3)
    crawled(spark, tmp_path / "t", site, target=4)
    # the last page's one place goes to the failure of the first, so 8 isn't reached
    assert [x[0] for x in tables(spark, f"file://{tmp_path}/t")[0]] == ["1", "2", "3"]
    broken = {u: h for u, h in site.items() if "nc_1/" not in u}
    crawled(spark, tmp_path / "f", broken)
    got = {r.source_id: (r.attempts, r.last_reason) for r in crawl.failing(spark, f"file://{tmp_path}/f").collect()}
    assert got["1"] == (3, "fetch_failed:404") and got["8"] == (1, "low_images:1")


def test_cursor_and_following_page():
    assert crawl.following('<a rel="next" href="?p=2">x</a>', f"{HOST}/l?p=1") == f"{HOST}/l?p=2" and crawl.following("<p>", HOST) is None
    with pytest.raises(TypeError):
        crawl.paged_source()

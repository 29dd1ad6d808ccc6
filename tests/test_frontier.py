"""Probing by rounds against a walk of one listing after another."""

import random
import re
from urllib.parse import urljoin

from pyspark.sql import functions as F

from tessera.sources import frontier, pages

HOST = "https://h.example"


def walk(url, html, sid, site, most):
    """Photos and visited pages, one listing at a time with a queue."""
    photos = list(pages.photo_urls(html, url))
    queue, visited = [], []

    def add(candidates):
        for u in candidates:
            if len(queue) >= most:
                return
            if u != url and u not in visited and u not in queue:
                queue.append(u)

    page = pages.read_page(html)
    add(pages.photo_pages(page, url) + pages.data_urls(page, html, url, sid, (), most))
    while queue and len(visited) < most:
        probe = queue.pop(0)
        visited.append(probe)
        if probe not in site:
            continue
        page = pages.read_page(site[probe])
        photos += [p for p in pages.photo_urls(site[probe], probe) if p not in photos]
        add(pages.data_urls(page, site[probe], probe, sid, (), 4))
        if "/nc_" in probe:
            add(pages.photo_pages(page, probe))
    return photos, visited


def made_site(rnd, listings):
    names = [f"{HOST}/ms/chuko/nc_{n}/{w}" for n in range(listings) for w in ("", "photo/", "gallery/", "image/2/", "x/")] + [f"{HOST}/api/{n}.json" for n in range(6)]

    def html():
        parts = []
        for _ in range(rnd.randint(0, 7)):
            u = rnd.choice(names)
            parts.append(rnd.choice([f'<img src="/photo/{rnd.randint(0, 30)}.jpg">', f'<a href="{u}">写真</a>', f'<a href="{u}">x</a>', f'<script src="{u}"></script>', f'<iframe src="{u}"></iframe>', f'<p>"{u}"</p>', '<link href="/media/a.css">']))
        return "<html>" + "".join(parts) + "</html>"

    return {u: html() for u in names if rnd.random() < 0.8}


def test_rounds_equal_a_walk_with_a_queue(spark):
    rnd = random.Random(3)
    site = made_site(rnd, 12)
    stored = spark.createDataFrame(list(site.items()), "url string, html string")
    load = lambda urls: urls.join(stored, "url", "left")
    listings = [(f"{HOST}/ms/chuko/nc_{n}/", site.get(f"{HOST}/ms/chuko/nc_{n}/")) for n in range(12)] + [(None, "x"), (f"{HOST}/other", '<a href="photo/1">画像</a>')]
    for most in (1, 3, 8):
        got = frontier.collect_photos(spark.createDataFrame(listings, "url string, html string"), load, most).collect()
        assert len(got) == 13
        for r in got:
            want = walk(r.url, dict(listings)[r.url], r.source_id, site, most)
            assert (r.photos, r.visited) == want, (r.url, most)
        assert any(len(r.visited) == most for r in got)


def test_a_page_that_many_listings_name_is_loaded_once(spark):
    asked = []

    def load(urls):
        asked.append(sorted(r.url for r in urls.collect()))
        return urls.withColumn("html", F.lit('<img src="/photo/s.jpg">'))

    page = '<script src="https://h.example/api/shared.json"></script>'
    listings = spark.createDataFrame([(f"{HOST}/a/{n}", page) for n in range(5)], "url string, html string")
    got = frontier.collect_photos(listings, load, most=8).collect()
    assert all(r.photos[-1] == "https://h.example/photo/s.jpg" for r in got)
    assert sum(urls.count("https://h.example/api/shared.json") for urls in asked) == 1
    assert all(len(urls) == len(set(urls)) for urls in asked)


def test_empty_table(spark):
    none = spark.createDataFrame([], "url string, html string")
    assert frontier.collect_photos(none, lambda urls: urls.withColumn("html", F.lit(None).cast("string"))).collect() == []


def test_pages_of_few_bytes_are_read_in_many_parts(spark):
    listings = spark.range(400).selectExpr("concat('https://h.example/ms/chuko/nc_', id, '/') url", "'<p>x</p>' html").coalesce(1)
    assert pages.listing_fields(listings).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_addresses_are_joined_as_by_the_library():
    for base in ("https://h.example/ms/nc_1/", "http://h.x:80/a?b#c", "//h/x", "", "https://u@h/x", "https://H.x/y"):
        for a in ("/photo/1_2.jpg", "/a//b", "/a/../b", "/./a", "//h2/a", "/", "/a?b#c", "a/b", "https://z/x", "/a;b/", "/-x/.y", ""):
            assert pages.X.joined(base, a) == urljoin(base, a), (base, a)


PLAIN = '<div style="a:url(/photo/1.jpg)"><img src="/photo/2.jpg" data-src="/x/logo.png"/><a href="/nc_1/photo/">x</a><img srcset="/photo/3.webp 2x, /photo/4.webp"><br></div> /media/5'


def test_a_plain_page_is_not_parsed_for_its_photos(monkeypatch):
    def parsed(html):
        raise AssertionError("parsed")

    want = [f"{HOST}/photo/{n}" for n in ("1.jpg", "2.jpg", "3.webp", "4.webp")]
    assert pages.read_page(PLAIN).media == ["/photo/1.jpg", "/photo/2.jpg", "/x/logo.png", "/photo/3.webp", "/photo/4.webp"]
    monkeypatch.setattr(pages, "read_page", parsed)
    assert pages.photo_urls(PLAIN, HOST + "/a/")[:4] == want


def test_plain_tags_are_read_as_by_the_library(monkeypatch):
    rnd = random.Random(5)
    words = [PLAIN, "<img src=/photo/6.jpg>", "<img src='/photo/7.jpg'>", '<IMG SRC="/photo/8.jpg">', '<img src="a" src="/photo/b.png">', '<img src="/a&amp;b.jpg">', "<script>'<img src=\"/photo/c.jpg\">'</script>", "<script src=\"/api/d.js\"/>", "<!-- <img src=\"/photo/e.jpg\"> -->", "&lt;", "<title><img src=\"/photo/f.jpg\"></title>", "<iframe src=\"/g/\">", "<tr><th>k</th><td>v<br/></td></tr>", "<", ">", '"', "<p", "</p", '<img src="/photo/h.jpg', "<dl><dt>a</dt><dd>b</dd></dl>"]
    made = ["".join(rnd.choices(words, k=rnd.randint(0, 6))) for _ in range(400)]
    told = lambda: [[vars(pages.read_page(h))[k] for k in ("media", "scripts", "links", "rows", "lists", "texts", "next")] for h in made]
    ours, shown = told(), [pages.media(h) for h in made]
    monkeypatch.setattr(pages, "_START", re.compile("(?!)"))
    assert ours == told()
    assert shown == [x[0] for x in ours]
    assert any(pages._PLAIN_PAGE.fullmatch(h) for h in made) and not all(pages._PLAIN_PAGE.fullmatch(h) for h in made)


def test_a_shared_page_names_to_each_listing_its_own_addresses(spark):
    shared = "".join(f'<script src="{HOST}/e/{n}.js"></script>' for n in (31, 32, 33))
    site = {f"{HOST}/api/s.json": shared, **{f"{HOST}/e/{n}.js": f'<img src="/photo/{n}.jpg">' for n in (31, 32, 33)}}
    stored = spark.createDataFrame(list(site.items()), "url string, html string")
    # the guesses are first, so the shared page is the seventh
    listings = [(f"{HOST}/ms/chuko/nc_{n}/", f'<script src="{HOST}/api/s.json"></script>') for n in (31, 32)]
    unasked = spark.createDataFrame([(None, "<p>x</p>"), (HOST + "/y", PLAIN)], "url string, html string")
    got = frontier.collect_photos(spark.createDataFrame(listings, "url string, html string"), lambda urls: urls.join(stored, "url").unionByName(unasked), 8).collect()
    assert sorted((r.source_id, r.photos, r.visited[6:]) for r in got) == [(str(n), [f"{HOST}/photo/{n}.jpg"], [f"{HOST}/api/s.json", f"{HOST}/e/{n}.js"]) for n in (31, 32)]
    for r in got:
        assert (r.photos, r.visited) == walk(r.url, dict(listings)[r.url], r.source_id, site, 8)

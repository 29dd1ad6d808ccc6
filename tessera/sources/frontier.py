"""Bounded probing: further pages of a listing that may show photos, one of each listing in a round.

The frontier is a table with a row for each listing: its photos and its pages in
the order in which they are probed, ``most`` at most. Round n takes the nth page
of every listing, loads the distinct pages of the round once, however many
listings name them, and reads each loaded page once. What they show and name is
joined to their listings; a round that loads nothing leaves the table as it is,
and pages are read for the addresses that they name only while a listing has
room for more. What a listing has already isn't added again. Rounds end when
nothing waits or after ``most`` of them, so the result is that of a walk of each
listing alone, in the same order.

Defined results: a listing without html has no photos and guesses its pages
alone; a page that can't be loaded counts as visited and shows nothing;
listings that repeat are walked each by itself; a null url gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import kept, spread
from . import pages

Load = Callable[[DataFrame], DataFrame]  # url -> url, html (null where it can't be loaded)
FIELDS = ("photos", "photo_pages", "data_urls", "lower")
STRINGS = pa.list_(pa.string())


def _read(hosts: tuple[str, ...], most: int, enough: float) -> Callable[..., Column]:
    """Reader of pages: photos, and unless ``enough`` pages are guessed, photo pages and ``named_urls`` with what they are in lower case."""

    @F.arrow_udf(", ".join(f"{c} array<string>" for c in FIELDS))
    def read(html: pa.Array, url: pa.Array) -> pa.Array:
        photos, further, named, lower = [], [], [], []
        for h, u in zip(html.to_pylist(), url.to_pylist()):
            more, data, page, raw = pages.photo_guesses(u) if enough else [], {}, None, pages.addresses(h)
            if len(more) < enough:
                page = pages.read_page(h)
                more, data = pages.photo_pages(page, u), pages.named_urls(page, h, u, hosts, most, raw)
            photos.append(pages.photo_urls(h, u, hosts, page, raw))
            further.append(more if page else more[:most])
            named.append(list(data))
            lower.append(list(data.values()) if any(data.values()) else None)
        return pa.StructArray.from_arrays([pa.array(x, STRINGS) for x in (photos, further, named, lower)], names=list(FIELDS))

    return read


def _data_urls(most: int) -> Column:
    """The first of a page's addresses that may hold data of the listing ``source_id``."""
    of_listing = F.filter("page.data_urls", lambda x, i: F.coalesce(F.contains(F.get("page.lower", i), F.col("source_id")), F.lit(True)))
    return F.slice(F.when(F.col("page.lower").isNull(), F.col("page.data_urls")).otherwise(of_listing), 1, most)


def collect_photos(listings: DataFrame, load: Load, most: int = 8, hosts: tuple[str, ...] = (), url: str = "url", html: str = "html") -> DataFrame:
    """url, source_id, photos (in the order they are met) and visited (pages probed) of each listing."""
    key = F.col(url)
    first = listings.filter(key.isNotNull()).select(key.alias("url"), X.source_id(key).alias("source_id"), F.col(html).alias("html"))
    first = spread(first).withColumn("page", _read(hosts, most, most)("html", "url"))
    told = F.array_except(F.array_distinct(F.concat("page.photo_pages", _data_urls(most))), F.array("url"))
    state = first.select("url", "source_id", F.col("page.photos").alias("photos"), F.slice(told, 1, most).alias("pages"))
    state = met = kept(state.withColumn("n", F.size("pages")), "frontier")  # ``met`` has the photos of all rounds, ``state`` is what they are told from
    for done in range(most):
        waiting, growing = state.agg(F.count_if(F.col("n") > done), F.count_if((F.col("n") > done) & (F.col("n") < most))).first()
        if not waiting:
            break
        asked = spread(state.filter(F.col("n") > done).select(F.get("pages", F.lit(done)).alias("url")), "url").distinct()
        loaded = spread(load(asked).select("url", "html"), "url").filter("url is not null and html is not null")
        shown = loaded.select(F.col("url").alias("probe"), _read(hosts, 4, math.inf if growing else 0)("html", "url").alias("page"))
        shown = kept(shown, "frontier")
        if shown.isEmpty():
            continue
        met = _joined(met, shown, done, most if growing else 0)
        if growing:
            state = met = kept(met, "frontier")
    return met.select("url", "source_id", "photos", F.slice("pages", 1, most).alias("visited"))


def _joined(state: DataFrame, shown: DataFrame, done: int, most: int) -> DataFrame:
    """``state`` with what its pages of the round show and, up to ``most`` pages, name."""
    none = F.array().cast("array<string>")
    probe = F.coalesce(F.get("pages", F.lit(done)), F.col("url"))  # the address only spreads the listings that have no page in the round
    met = state.join(shown, (probe == F.col("probe")) & (F.col("n") > done), "left")
    met = met.withColumn("photos", F.array_distinct(F.concat("photos", F.coalesce("page.photos", none))))
    if most:
        of_listing = F.when(F.contains("probe", F.lit("/nc_")), F.col("page.photo_pages")).otherwise(none)
        named = F.coalesce(F.concat(_data_urls(4), of_listing), none)
        fresh = F.array_except(F.array_distinct(named), F.concat(F.array("url"), F.col("pages")))
        met = met.withColumn("pages", F.slice(F.concat("pages", fresh), 1, most)).withColumn("n", F.size("pages"))
    return met.select("url", "source_id", "photos", "pages", "n")

"""Search by similarity of vectors together with range filters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors


def with_similarity(images: DataFrame, query: Column, vector: str = "embedding", out: str = "similarity") -> DataFrame:
    """Dot product with the query vector, a literal array; 0 for vectors that aren't there."""
    return images.withColumn(out, vectors.dot(F.col(vector), query))


def top_k(scored: DataFrame, k: int, tie: str, score: str = "similarity") -> DataFrame:
    """The k rows of largest score, the earlier of equals: each task keeps k rows."""
    return scored.orderBy(F.desc(score), F.asc(tie)).limit(k)


def in_ranges(df: DataFrame, most: dict[str, float] | None = None, least: dict[str, float] | None = None) -> DataFrame:
    """Rows within all bounds; a NULL is out of bounds."""
    for column, bound in (most or {}).items():
        df = df.filter(F.col(column) <= bound)
    for column, bound in (least or {}).items():
        df = df.filter(F.col(column) >= bound)
    return df


def first_child(children: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key."""
    return children.withColumn("_nth", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("_nth = 1").drop("_nth")


def with_first_image(listings: DataFrame, images: DataFrame, key: str, order: list[str], take: list[str]) -> DataFrame:
    """Listings with the first of their images, if they have any."""
    return listings.join(first_child(images, key, order).select(key, *take), key, "left")


def search(images: DataFrame, listings: DataFrame, query: Column | None, key: str, tie: str, k: int = 10, most: dict[str, float] | None = None, least: dict[str, float] | None = None, good_deals: bool = False) -> DataFrame:
    """Listings of the k nearest images that are within bounds; all within bounds if there is no query.

    The k images are taken before bounds apply, so fewer listings may come.
    """
    found = in_ranges(listings, most, least)
    if good_deals:
        found = found.filter(F.col("deal") == "Good Deal")
    if query is None:
        return found
    return found.join(top_k(with_similarity(images, query), k, tie).select(key), key, "left_semi")


# Adjectives of a search and the score that each speaks of, and whether it asks for a high one.
ADJECTIVES = {
    "expensive": ("luxury", True), "cheap": ("luxury", False), "bright": ("brightness", True), "dark": ("brightness", False),
    "new": ("condition", True), "used": ("condition", False), "spacious": ("spaciousness", True), "small": ("spaciousness", False),
}
ROOMS = ("bathroom", "bedroom", "kitchen", "living room", "toilet")


def wished(prompt: str) -> list[tuple[str, bool]]:
    """Score columns that a prompt such as "Bright bedroom, new toilet" names, and whether each is to be high.

    An adjective speaks of the next room; several before one room all do. Words
    that are neither are passed over, and so is an adjective without a room.
    """
    words, waiting, out = re.findall(r"\w+", prompt.lower()), [], []
    for at, word in enumerate(words):
        room = "living room" if words[at : at + 2] == ["living", "room"] else word
        if word in ADJECTIVES:
            waiting.append(ADJECTIVES[word])
        elif room in ROOMS:
            out += [(f"{score}_{room}".replace(" ", "_"), high) for score, high in waiting]
            waiting = []
    return list(dict.fromkeys(out))


def by_prompt(listings: DataFrame, prompt: str, edge: float = 0.5) -> DataFrame:
    """Listings whose scores are above the edge where the prompt asks for much, and not above it where it asks for little; one without the score is left out."""
    for column, high in wished(prompt):
        score = F.col(column)
        listings = listings.filter(score > edge if high else score <= edge)
    return listings


def deal(price: Column, predicted: Column) -> Column:
    """Good Deal below the predicted price, else Fair; NULL if either is missing."""
    return F.when(price < predicted, "Good Deal").when(price >= predicted, "Fair")

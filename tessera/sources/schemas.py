"""Schemas of the stored tables."""

from __future__ import annotations

LISTINGS = "source_id string, url string, price_man_yen int, layout string, area_sqm double, year_built int, floor_number int, floors_total int, address string, nearest_station string, walk_minutes int, image_count int"
IMAGES = "source_id string, listing_url string, image_url string, image_name string"
FAILED = "source_id string, listing_url string, attempts int, last_reason string, last_error_at timestamp"
LABELS = "source_id string, listing_url string, image_url string, RoomType string, Luxury string, Brightness string, Condition string, image_name string, image_path string, default_image int, room_type string, scoring_dict string"
PLACES = "address string, latitude double, longitude double"
EMBEDDINGS = "source_id string, image_url string, room_type string, embedding string"
LOG = "source_id string, url string, status string, reason string, at timestamp"
FAILING = "source_id string, url string, attempts int, last_reason string, last_at timestamp"

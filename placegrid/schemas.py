"""Column lists and schemas of the stored tables."""

from pyspark.sql import types as T

# Column names, their order and the named profiles.
LISTING_FIELDS = (
    "name", "rating", "review_count", "category", "status", "address", "phone",
    "website", "latitude", "longitude", "image_urls", "source_url", "hours",
    "price_level", "plus_code", "photo_count", "total_photos", "about",
    "amenities", "menu_link", "latest_review_date",
)
LEAN = (
    "name", "rating", "review_count", "category", "status", "address", "phone",
    "latitude", "longitude", "source_url",
)
PROFILES = {
    "lean": LEAN,
    "rich": LISTING_FIELDS,
    "reviews-only": ("name", "rating", "review_count", "latest_review_date", "source_url"),
    "default": LEAN,
}
LISTING_COLUMNS = ("place_id", *LISTING_FIELDS)
DISCOVERED_COLUMNS = ("place_id", "cell_id", "query", "form", "lat", "lng", "discovered_at")
STATE_COLUMNS = {
    "cells": ("cell_id", "query", "status", "last_attempted_at", "place_count", "error_msg"),
    "places": ("place_id", "status", "attempts", "last_error", "updated_at"),
    "dead_letter": ("place_id", "url", "error_class", "error_msg", "attempted_at"),
    "images": ("place_id", "expected", "saved", "completed_at"),
}
ATTRIBUTE_COLUMNS = (
    "share_link", "price_range_text", "price_min", "price_max", "price_currency",
    "price_reported_by", "has_menu_tab", "popular_times", "hours", "links",
    "menu_items", "amenities",
)
ERROR_TEXT_LIMIT = 500


def strings(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


SEARCH_BODY = "places array<struct<id:string>>, nextPageToken string"
USAGE_LEDGER = "map<string,map<string,bigint>>"
HEARTBEAT = (
    "event string, run_id string, ts timestamp, elapsed_s double, discovered bigint, "
    "scraped bigint, errors bigint, queue_depth bigint, rps_inst double, api_calls bigint, "
    "cost_usd double, discovery_rps double, active_keys bigint, cells_done bigint, "
    "cells_failed bigint, cells_partial bigint, cells_in_flight bigint, cells_total bigint, "
    "grid_cells_total bigint, queries_total bigint, placeids_total bigint, "
    "placeids_done bigint, placeids_failed bigint, placeids_pending bigint"
)
LIVE_STATE = HEARTBEAT + (
    ", workers array<struct<id:string,phase:int,state:string,task:string>>"
    ", api_keys array<struct<alias:string,available:boolean,exhausted:boolean,run_count:bigint>>"
)
RUN_CONFIG = (
    "run_id string, started_at string, schema_version int, selected_columns array<string>, "
    "osm_relation_id bigint, osm_type string, city_name string, grid_size_meters int, "
    "queries array<string>, discovery_backend string, places_tier string, "
    "num_consumer_threads int"
)
SKELETON = (
    "key string, prompt string, images array<string>, optional_images array<string>, "
    "generation_config string"
)
JOBS = (
    "name string, display_name string, state string, model string, create_time string, update_time string, "
    "request_count bigint, pending_request_count bigint, dest_file string, error string"
)
JOB_FILES = "name string, display_name string, size_bytes bigint"

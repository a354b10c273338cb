"""Schemas of the data model, fixed token lists and the default category table."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, I, B, L = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType(), T.LongType()

RAW_LISTING = T.StructType([
    T.StructField("part_name", S), T.StructField("scraped_category", S),
    T.StructField("category_slug", S), T.StructField("price_pkr", D),
    T.StructField("price_original_pkr", D), T.StructField("available", B),
    T.StructField("product_url", S), T.StructField("website", S),
    T.StructField("source_base", S), T.StructField("part_brand", S),
    T.StructField("part_type", S), T.StructField("compatible_make", S),
    T.StructField("compatible_model", S), T.StructField("year_from", I),
    T.StructField("year_to", I), T.StructField("condition", S),
    T.StructField("description", S),
    # optional extras
    T.StructField("sku", S), T.StructField("_status", S), T.StructField("price_note", S),
    T.StructField("position", L),          # first-seen order, stored by the raw sink
])

ALTERNATIVE = T.StructType([
    T.StructField("part_name", S), T.StructField("part_brand", S),
    T.StructField("price_pkr", D), T.StructField("product_url", S),
])

STRING_COLS = ["part_name", "part_type", "part_brand", "scraped_category",
               "compatible_make", "compatible_model"]

CLEAN_COLS = ["part_name", "part_type", "part_brand", "scraped_category", "compatible_make",
              "compatible_model", "year_from", "year_to", "price_pkr", "price_original_pkr",
              "condition", "available", "website", "product_url", "description"]

CLEAN_TYPES = {"year_from": "int", "year_to": "int", "price_pkr": "double",
               "price_original_pkr": "double", "available": "boolean"}

CLEAN_LISTING = T.StructType(
    [T.StructField(c, {"int": I, "double": D, "boolean": B}.get(CLEAN_TYPES.get(c), S))
     for c in CLEAN_COLS] + [T.StructField("alternatives", T.ArrayType(ALTERNATIVE))])

FINAL_LISTING = T.StructType(
    [f for f in CLEAN_LISTING.fields if f.name != "alternatives"]
    + [T.StructField("alternatives_count", I)])

CHECKPOINT = T.StructType([
    T.StructField("timestamp", S), T.StructField("count", L),
    T.StructField("metadata", T.StructType([T.StructField("completed_slugs", T.ArrayType(S))])),
    T.StructField("data", T.ArrayType(RAW_LISTING)),
])

RESPONSE_FIELDS = ["part_brand", "part_type", "compatible_make", "compatible_model",
                   "year_from", "year_to", "condition"]

PAGES = T.StructType([
    T.StructField("category_slug", S), T.StructField("page_no", I),
    T.StructField("url", S), T.StructField("status", I), T.StructField("html", S),
])

# The missing-value tokens pandas' CSV reader turns into null.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null")

# Default category table, slug -> display name, in source order.
DEFAULT_CATEGORIES = [
    ("car-parts/back-lights", "Back Lights"),
    ("car-parts/head-lights", "Head Lights"),
    ("car-parts/mud-flap", "Mud Flaps"),
    ("car-parts/side-mirrors", "Side Mirrors"),
    ("car-parts/spark-plugs", "Spark Plugs"),
    ("car-parts/wiper-blades", "Wiper Blades"),
    ("car-filters/ac-filter", "AC Cabin Filter"),
    ("car-filters/air-filters", "Air Filter"),
    ("car-filters/fuel-filter", "Fuel Filter"),
    ("car-filters/oil-filters", "Oil Filter"),
    ("oils-and-additives/brake-oils", "Brake Oil"),
    ("oils-and-additives/engine-oil", "Engine Oil"),
    ("oils-and-additives/oil-additives", "Oil Additives"),
    ("oils-and-additives/steering-oil", "Steering Oil"),
    ("oils-and-additives/transmission-oils", "Transmission Oil"),
    ("car-accessories/mats/floor-mats", "Floor Mats"),
    ("car-accessories/mats/dash-mats", "Dash Mats"),
    ("car-accessories/interior-accessories/seat-covers-and-cushions", "Seat Covers"),
    ("car-accessories/interior-accessories/steering-wheel-accessories", "Steering Accessories"),
    ("car-accessories/interior-accessories/sun-shades", "Sun Shades"),
    ("car-accessories/exterior-accessories/top-covers", "Car Top Covers"),
    ("car-accessories/exterior-accessories/body-kits", "Body Kits"),
    ("car-accessories/exterior-accessories/chrome-products", "Chrome Parts"),
    ("car-accessories/exterior-accessories/horns", "Horns"),
    ("car-accessories/exterior-accessories/mufflers", "Mufflers"),
    ("car-accessories/exterior-accessories/performance-parts", "Performance Parts"),
    ("car-accessories/exterior-accessories/airpress", "Air Press / Wind Deflectors"),
    ("led-lights/drl-fog-lamps", "DRL & Fog Lamps"),
    ("led-lights/hid-led-smd-lights", "HID / LED / SMD Lights"),
    ("led-lights/led-head-lights", "LED Head Lights"),
    ("led-lights/led-tail-lights", "LED Tail Lights"),
    ("car-electronics/car-camera", "Car Cameras"),
    ("car-electronics/stereo-systems", "Stereo Systems"),
    ("car-electronics/speakers-and-amplifiers", "Speakers & Amplifiers"),
    ("car-electronics/security-systems", "Security Systems"),
    ("tyres-and-wheels/tyres", "Tyres"),
    ("tyres-and-wheels/wheel-covers", "Wheel Covers"),
    ("batteries", "Batteries"),
    ("tools/basic-tools", "Basic Tools"),
    ("tools/tool-kits", "Tool Kits"),
    ("tools/air-compressor", "Air Compressors"),
    ("tools/cable-and-jump-starter", "Jump Starters"),
    ("car-care/carcare-exterior/tire-care", "Tire Care Products"),
    ("car-care/coolants", "Coolants"),
]

# Pipeline constants.
BATCH_SIZE = 15
RECHECK_PASSES = 2
MAX_ALTERNATIVES = 10
MAX_PAGES_PER_CATEGORY = 60
DESCRIPTION_CHARS = 500


def categories_df(spark, rows=None):
    return spark.createDataFrame(rows or DEFAULT_CATEGORIES, "slug string, name string")

"""Crawl output as a table: pages(category_slug, page_no, url, status, html).

``crawl_pages`` maps the driver's generic ``pages`` table onto that shape:
the host is the category, pages are numbered by their path id within the
host, a URL with a ``#top`` fragment stands for a failed fetch (404) and the
number of ``<li`` tags stands in for the product cards found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewright.sources.listings import read_table


def crawl_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    path_id = F.regexp_extract("url", r"/([0-9]+)", 1).try_cast("bigint")
    w = Window.partitionBy("category_slug").orderBy("_path_id", "page_id")
    return (p.withColumn("category_slug", host).withColumn("_path_id", path_id)
            .withColumn("page_no", F.row_number().over(w).cast("bigint"))
            .withColumn("status", F.when(F.col("url").endswith("#top"), F.lit(404)).otherwise(F.lit(200)))
            .withColumn("n_cards", F.when(F.col("html").isNull(), F.lit(0)).otherwise(
                ((F.length("html") - F.length(F.replace("html", F.lit("<li"), F.lit("")))) / 3).cast("bigint")))
            .select("page_id", "category_slug", "page_no", "url", "status", "n_cards", "html"))


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A crawl dump in the documented shape (any Spark file format)."""
    from pricewright.schemas import PAGES
    return spark.read.format(fmt).schema(PAGES).load(path)

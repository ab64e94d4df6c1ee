"""Seeds: pages that a fresh installation may ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The market's tags and their numbers of pages.
ITCH_TAGS = (("tag-vrchat", 15), ("tag-udon", 10), ("tag-vrchat-avatar", 10))

# Candidate jobs, as URL, platform, least delay (ms) and purpose. They grant nothing.
CANDIDATES = (
    ("https://vrchat-community.github.io/template-package/index.json", "vpm", 1000, "discovery"),
    ("https://raw.githubusercontent.com/vrchat-community/template-package-listing/main/source.json", "vpm", 1000, "discovery"),
    ("https://booth.pm/ja/items/456789", "booth", 1500, "metadata"),
    ("https://gumroad.com/l/sample-vrc-asset", "gumroad", 3000, "metadata"),
    ("https://jinxxy.com/p/sample-vrc-tool", "jinxxy", 2000, "metadata"),
    ("https://sellfy.com/p/sample-vrc-prefab/", "sellfy", 2000, "metadata"),
    ("https://payhip.com/b/sample-vrc-item", "custom_domain", 2000, "metadata"),
)


def candidate_jobs(spark: SparkSession) -> DataFrame:
    """Candidate jobs of a fresh installation (S-14), with their origin."""
    rows = spark.createDataFrame(list(CANDIDATES), "url string, platform string, min_delay_ms long, purpose string")
    return rows.withColumn("origin", F.regexp_extract("url", "^https://[^/]+", 0))


def itch_seed_urls(spark: SparkSession) -> DataFrame:
    """The market's tag pages (S-14)."""
    tags = spark.createDataFrame(list(ITCH_TAGS), "tag string, pages int")
    pages = tags.select("tag", F.explode(F.sequence(F.lit(1), "pages")).alias("page"))
    return pages.select(F.concat(F.lit("https://itch.io/tools/"), "tag", F.lit("?page="), "page").alias("url"))


def new_seeds(seeds: DataFrame, jobs: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Seeds that no job and no suppression knows (J-14)."""
    return seeds.join(jobs.select("url").unionByName(suppressed.select("url")), "url", "left_anti")

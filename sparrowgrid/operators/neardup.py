"""Near-duplicate detection by SimHash blocks (D-26, J-16)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import BLOCKS, blocks, hamming


def banded(rows: DataFrame, key: str, hashed: str) -> DataFrame:
    """A row for each block of each hash: (key, hash, band, block)."""
    return rows.select(F.col(key), F.col(hashed), F.posexplode(blocks(F.col(hashed))).alias("band", "block"))


def classes(rows: DataFrame, key: str, hashed: str = "hash") -> DataFrame:
    """(hash, representative, members): rows of equal hashes are one class, which its least key stands for. Rows without a hash are in none."""
    return rows.filter(F.col(hashed).isNotNull()).groupBy(F.col(hashed).alias("hash")).agg(F.min(key).alias("representative"), F.count(F.lit(1)).alias("members"))


def near_classes(left: DataFrame, right: DataFrame, most: int = 3) -> DataFrame:
    """(left_hash, right_hash, distance) of the distinct hashes of two frames (column ``hash``) that differ in ``most`` bits at most.

    Blocks prove this for fewer bits than there are blocks, so a larger ``most`` is refused. The join is on band and block together, so that a
    frequent block meets its own band only; a pair that shares several is found in the first of them and in no other.
    """
    if not 0 <= most < BLOCKS:
        raise ValueError(f"{BLOCKS} blocks find pairs of fewer than {BLOCKS} differing bits")
    a = banded(left.select("hash").distinct(), "hash", "hash").select(F.col("hash").alias("left_hash"), "band", "block")
    b = banded(right.select("hash").distinct(), "hash", "hash").select(F.col("hash").alias("right_hash"), "band", "block")
    same = F.transform(F.arrays_zip(blocks(F.col("left_hash")).alias("x"), blocks(F.col("right_hash")).alias("y")), lambda z: z["x"] == z["y"])
    first = F.array_position(same, True) - 1 == F.col("band")
    return a.join(b, ["band", "block"]).filter(first).withColumn("distance", hamming(F.col("left_hash"), F.col("right_hash"))).filter(F.col("distance") <= most).select("left_hash", "right_hash", "distance")


def near_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, hashed: str = "hash", most: int = 3) -> DataFrame:
    """(left key, right key, distance) of pairs that differ in ``most`` bits at most, each once: a search of ``right`` rows in ``left`` ones.

    Equal hashes are compared once; the rows of both sides come back by equality of hashes.
    """
    a, b = (x.select(F.col(k), F.col(hashed).alias("hash")) for x, k in ((left, left_key), (right, right_key)))
    found = near_classes(a, b, most)
    return found.join(a.withColumnRenamed("hash", "left_hash"), "left_hash").join(b.withColumnRenamed("hash", "right_hash"), "right_hash").select(left_key, right_key, "distance").distinct()


def search(queries: DataFrame, rows: DataFrame, key: str, most: int = 3) -> DataFrame:
    """(key, representative, members, distance): the classes near to each query row. A row is no member of the class it finds, so a class of
    itself alone is left out."""
    own = classes(rows, key)
    hits = queries.select(key, F.col("hash").alias("left_hash")).join(near_classes(queries, own, most), "left_hash").join(own.withColumnRenamed("hash", "right_hash"), "right_hash")
    return hits.withColumn("members", F.col("members") - (F.col("distance") == 0).cast("long")).filter("members > 0").select(key, "representative", "members", "distance")


def by_distance(found: DataFrame, key: str, other: str) -> DataFrame:
    """Each key's candidates in order of distance, ties by ``other``, with their ``place`` from 1 (O-10)."""
    return found.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("distance", other)).cast("long"))

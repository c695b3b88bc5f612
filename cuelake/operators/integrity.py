"""Checking files against a manifest of digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEX_DIGEST = "^[0-9a-fA-F]{64}$"


def hashed(assets: DataFrame) -> DataFrame:
    return assets.withColumn("digest", F.sha2("content", 256)).drop("content")


def verdict_of(digests: DataFrame, manifest: DataFrame) -> DataFrame:
    """Verdict of every path in either table, from digests."""
    joined = digests.select("path", "size", "digest").join(manifest, "path", "full_outer")
    verdict = (F.when(F.col("size").isNull(), "MISSING").when(F.col("sha256").isNull(), "UNEXPECTED")
               .when(~F.col("sha256").rlike(HEX_DIGEST), "BAD_DIGEST")
               .when(F.col("size") > F.col("max_bytes"), "TOO_LARGE")
               .when(F.lower("digest") != F.lower("sha256"), "MISMATCH").otherwise("OK"))
    return joined.select("path", verdict.alias("verdict"))


def asset_verify(assets: DataFrame, manifest: DataFrame) -> DataFrame:
    """Contents are hashed where they are read; only digests are shuffled."""
    return verdict_of(hashed(assets), manifest)


def incremental_verify(assets: DataFrame, manifest: DataFrame, checked: DataFrame) -> DataFrame:
    """Trust recorded checks of unchanged files and verify the rest.

    ``checked`` holds ``path, size, mtime, sha256`` of files found good before; a record
    counts only while size, time and expected digest are unchanged.  Listings without
    contents decide which files are left; only those are hashed, where they are read.
    """
    fingerprint = ["path", "size", "mtime"]
    expected = manifest.select("path", F.lower("sha256").alias("_now"))
    valid = checked.join(expected, "path").where(F.lower("sha256") == F.col("_now")).select(*fingerprint)
    listing = assets.select(*fingerprint)
    cached = listing.join(valid, fingerprint, "left_semi")
    left = listing.join(valid, fingerprint, "left_anti").select("path", F.lit(True).alias("_left"))
    digests = hashed(assets.join(left, "path")).drop("_left")
    todo = manifest.join(cached, "path", "left_anti")
    return (verdict_of(digests, todo).withColumn("cached", F.lit(False))
            .unionByName(cached.select("path", F.lit("OK").alias("verdict"), F.lit(True).alias("cached"))))

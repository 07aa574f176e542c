"""Release names and addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import latest_release

PREFIX = r"<Prefix>([^<]*)</Prefix>"


def names(listing: DataFrame, column: str = "xml") -> DataFrame:
    """Prefixes of an object listing, without their closing slash."""
    found = F.explode(F.regexp_extract_all(F.col(column), F.lit(PREFIX), F.lit(1)))
    return listing.select(found.alias("p")).select(F.regexp_extract("p", r"([^/]+)/?$", 1).alias("release"))


def latest(releases: DataFrame, strict: bool = True) -> DataFrame:
    return releases.agg(latest_release(F.col("release"), strict).alias("release"))


def resolve(spark: SparkSession, given: str | None, listing: DataFrame | None = None) -> str:
    """The release asked for, else the latest of a listing."""
    if given:
        return given
    if listing is None or (found := latest(names(listing), strict=False).first()[0]) is None:
        raise LookupError("no release found")
    return found


def tile_url(base: str, release: str, theme: str = "buildings") -> str:
    return f"{base.rstrip('/')}/{release}/{theme}.pmtiles"

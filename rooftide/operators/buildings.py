"""Features to buildings: drop what is underground, split into polygons, merge fragments, resolve heights.

Input columns of a feature table: ``feature_id``, ``z``, ``x``, ``y``,
``extent``, ``rings`` (array of rings of struct<px,py>), ``source_idx``,
``feat_idx``, and the attributes named in :data:`ATTRIBUTES`; missing attributes
count as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, kernels, rings
from ..functions.config import HeightConfig, cascade

ATTRIBUTES = {
    "height": "double", "min_height": "double", "roof_height": "double", "num_floors": "bigint", "num_floors_underground": "bigint",
    "min_floor": "bigint", "level": "bigint", "roof_shape": "string", "roof_material": "string", "roof_color": "string", "facade_material": "string",
    "facade_color": "string", "subtype": "string", "class": "string", "name": "string", "gers_id": "string", "is_underground": "boolean", "has_parts": "boolean",
}
KEPT = ("gers_id", "class", "subtype", "name", "height", "min_height", "roof_height", "num_floors", "roof_shape")
ORDER = ("source_idx", "feat_idx", "poly_idx")


def complete(features: DataFrame) -> DataFrame:
    """The table with all attribute columns."""
    return features.withColumns({c: F.lit(None).cast(t) for c, t in ATTRIBUTES.items() if c not in features.columns})


def above_ground() -> Column:
    """Not flagged underground and not on a negative level; nulls stay."""
    return ~(F.coalesce(F.col("is_underground"), F.lit(False)) | F.coalesce(F.col("level") < 0, F.lit(False)))


def density(features: DataFrame, per: tuple[str, ...] = (), sources: DataFrame | None = None) -> DataFrame:
    """Mean number of features per source tile, underground ones included, over all tiles or for each ``per`` key.

    ``sources`` adds tiles that hold no feature; without it, tiles are those with features.
    """
    tile = F.struct("z", "x", "y")
    counted = features.select(*per, tile.alias("source_tile"), F.lit(1).alias("n"))
    if sources is not None:
        counted = counted.unionByName(sources.select(*per, tile.alias("source_tile"), F.lit(0).alias("n")))
    by_tile = counted.groupBy(*per, "source_tile").agg(F.sum("n").alias("n"))
    return by_tile.groupBy(*per).agg((F.sum("n") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("mean_features"))


def key(feature_id: Column, *alone: Column) -> Column:
    """A text that names a building and sorts by its id; features without an id come last, by the columns that tell them apart."""
    own = F.concat(F.lit("1:"), F.concat_ws(":", *(F.lpad(c.cast("string"), 12, "0") for c in alone))) if alone else F.lit(None).cast("string")
    return F.coalesce(F.concat(F.lit("0:"), F.lpad(feature_id.cast("string"), 20, "0")), own)


def fragments(features: DataFrame, per_polygon: tuple[str, ...] = ()) -> DataFrame:
    """One row per polygon of the features above ground, with its area in square metres and its mean vertex in degrees."""
    rows = complete(features).where(above_ground())
    rows = rows.select("*", F.posexplode(kernels.measured(F.col("rings"))).alias("poly_idx", "m"))
    ring = lambda i: rings.strip_closure(F.get(F.col("rings"), i))
    polygon = F.struct(ring(F.col("m.outer")).alias("outer"), F.transform("m.holes", ring).alias("holes"))
    east, south = geo.pixel_scale(F.col("z"), F.col("x"), F.col("y"), F.col("extent"))
    at = geo.pixel_to_lonlat(F.col("z"), F.col("x"), F.col("y"), F.col("extent"), F.col("m.px"), F.col("m.py"))
    rows = rows.withColumns({"polygon": polygon, "area_m2": F.col("m.area") * east * south, "center": at})
    return rows.drop("m", "rings", *per_polygon)


def merge(parts: DataFrame, order: tuple[str, ...] = ORDER, per: tuple[str, ...] = (), with_rings: bool = False, also: tuple[str, ...] = ()) -> DataFrame:
    """Fragments of one feature id to one row; fragments without an id stay alone.

    Areas are summed, the centre is weighted by area ((0, 0) if the weights are
    0), attributes, and the columns in ``also``, are those of the first fragment in ``order``.  Sums and the
    first fragment combine before the shuffle, so a feature of very many
    fragments costs no more than its partial results; ``with_rings`` collects
    outlines as well and is meant for features of ordinary size.
    """
    first = F.struct(*order)
    alone = F.when(F.col("feature_id").isNull(), F.struct("source_idx", "feat_idx", "poly_idx"))
    props = F.struct(*KEPT, *also, F.col("area_m2").alias("first_area_m2"), F.struct("z", "x", "y", "extent").alias("tile"))
    area = F.sum("area_m2")
    weighted = lambda c: F.coalesce(F.sum(F.col(f"center.{c}") * F.col("area_m2")) / F.nullif(area, F.lit(0.0)), F.lit(0.0)).alias(c)
    more = [F.transform(F.sort_array(F.collect_list(F.struct(first.alias("at"), F.struct("z", "x", "y", "extent", "polygon").alias("part")))), lambda s: s["part"]).alias("parts")] if with_rings else []
    grouped = parts.groupBy(*per, "feature_id", alone.alias("alone")).agg(
        area.alias("merged_area_m2"), weighted("lon"), weighted("lat"), F.count(F.lit(1)).alias("n_fragments"), F.min(F.struct(first.alias("first"), props.alias("p"))).alias("least"), *more
    )
    name = key(F.col("feature_id"), *(F.col(f"alone.{c}") for c in ("source_idx", "feat_idx", "poly_idx"))).alias("building")
    return grouped.select(*per, "feature_id", name, F.col("merged_area_m2").cast("float").alias("footprint_m2"), "lon", "lat", "n_fragments", "least.first", *(F.col(f"least.p.{c}").alias(c) for c in (*KEPT, *also, "first_area_m2", "tile")), *(["parts"] if with_rings else []))


def resolve(buildings: DataFrame, cfg: HeightConfig, level: Column, area: Column | None = None) -> DataFrame:
    """Add ``height_m``, ``height_method`` and ``source_height_m``; ``area`` is the merged footprint unless given."""
    area = F.col("footprint_m2") if area is None else area
    found = cascade(cfg, F.col("height"), F.col("num_floors"), F.col("class"), F.col("subtype"), area.cast("double"), level)
    measured = F.when((F.col("height") > 0) & ~F.isnan("height"), F.col("height"))
    return buildings.withColumn("h", found).withColumn("source_height_m", measured.cast("float")).withColumn("height_m", F.col("h.height_m").cast("float")).withColumn("height_method", F.col("h.height_method")).drop("h")


def extract_buildings(features: DataFrame, cfg: HeightConfig | None = None, order: tuple[str, ...] = ORDER, density_per: tuple[str, ...] = (), height_area: str = "merged", sources: DataFrame | None = None, with_rings: bool = False) -> DataFrame:
    """The building table.

    Density is over all sources unless ``density_per`` names keys (the tile's,
    for rendering).  ``height_area`` is ``merged`` or ``first_fragment``.
    """
    merged = merge(fragments(features), order, density_per, with_rings)
    return with_heights(merged, density(features, density_per, sources), cfg, density_per, height_area)


def with_heights(merged: DataFrame, means: DataFrame, cfg: HeightConfig | None = None, density_per: tuple[str, ...] = (), height_area: str = "merged") -> DataFrame:
    """Merged buildings with the heights that a parameter set gives them at these densities."""
    cfg = cfg or HeightConfig()
    # One row of means, or one for each key: the former is a scalar subquery, the latter an equi-join.
    joined = merged.join(means, list(density_per)) if density_per else merged.withColumn("mean_features", means.scalar())
    area = F.col("footprint_m2") if height_area == "merged" else F.col("first_area_m2").cast("float")
    return resolve(joined, cfg, cfg.level(F.col("mean_features")), area)


def export_columns(buildings: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and the 13 columns of the export, nulls as their sentinels and floors cut off at 16 bits."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    number = lambda c, name=None: F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float")).alias(name or c)
    ground = number("ground_elev") if "ground_elev" in buildings.columns else F.lit(0.0).cast("float").alias("ground_elev")
    return buildings.select(
        *keys, F.coalesce(F.col("feature_id").cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")).alias("feature_id"),
        *map(text, ("gers_id", "name", "subtype", "class")), number("height_m", "height"), number("source_height_m", "source_height"), text("height_method"),
        number("min_height"), number("roof_height"), ground, F.least(F.coalesce("num_floors", F.lit(0)), F.lit(65535)).cast("int").alias("num_floors"), text("roof_shape"),
    )

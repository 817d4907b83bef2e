"""Measurements and verdicts over a table of pixels ``image_id, y, x, r, g, b, a``.

A pixel table is dense: a row for each position of each image. ``images`` has
``image_id, width, height``. Every image is a group of its own; images without
pixels have no row in a result unless the docstring says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.color import bound, hex_channel, hex_of, hsv, hue_distance, to_byte, to_linear, topology
from tessera.operators.tiles import beside_zero

KEY = ["image_id", "y", "x"]
BOX = "struct<x:int,y:int,width:int,height:int>"


def box_where(condition: Column) -> Column:
    """Aggregate: the smallest rectangle that holds the pixels of a condition; null for none."""
    x0, x1 = F.min(F.when(condition, F.col("x"))), F.max(F.when(condition, F.col("x")))
    y0, y1 = F.min(F.when(condition, F.col("y"))), F.max(F.when(condition, F.col("y")))
    return F.when(x0.isNotNull(), F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0 + 1).alias("width"), (y1 - y0 + 1).alias("height")).cast(BOX))


def border_means(pixels: DataFrame, images: DataFrame, depth: int = 4) -> DataFrame:
    """``image_id, lr, lg, lb``: mean linear colour of the border."""
    if depth < 1:
        raise ValueError("depth must be at least 1")
    d = F.greatest(F.lit(1), F.least(F.lit(depth), F.floor(F.least("width", "height") / 2))).cast("int")
    rows = pixels.join(images.select("image_id", "width", "height", d.alias("d")), "image_id")
    border = (F.col("y") < F.col("d")) | (F.col("y") >= F.greatest(F.col("d"), F.col("height") - F.col("d")))
    border |= (F.col("x") < F.col("d")) | (F.col("x") >= F.greatest(F.col("d"), F.col("width") - F.col("d")))
    # linear light is a multiple of 2**-35, so these sums are exact in any order
    means = [(F.sum((to_linear(F.col(c)) * 2.0**35).cast("long")).cast("double") / F.count(F.lit(1)) / 2.0**35).alias(f"l{c}") for c in "rgb"]
    return rows.where(border).groupBy("image_id").agg(*means)


def keys_of(pixels: DataFrame, images: DataFrame, key: str = "auto", sidecars: DataFrame | None = None, depth: int = 4) -> DataFrame:
    """``image_id, key, key_source, kind, channel, strength``: the colour to remove from each image.

    key: "auto" (the border's mean), "from-sidecar" (``sidecars(image_id, color)``), or
    ``#rrggbb``. The topology is the key's; where the border has the same one, its
    strength counts. An image whose sidecar has no colour is an error."""
    border = border_means(pixels, images, depth)
    if key == "auto":
        named = border.withColumn("key", hex_of(*(to_byte(F.col(f"l{c}")) for c in "rgb"))).withColumn("key_source", F.lit("auto"))
    elif key == "from-sidecar":
        if sidecars is None:
            raise ValueError("from-sidecar needs sidecars")
        colour = F.when(F.col("color").rlike("^#[0-9a-fA-F]{6}$"), F.lower("color")).otherwise(F.raise_error(F.lit("a sidecar has no key colour")))
        named = border.join(sidecars.select("image_id", "color"), "image_id", "left").withColumn("key", colour).withColumn("key_source", F.lit("sidecar"))
    else:
        from tessera.functions.color import parse_hex

        parse_hex(key)
        named = border.withColumn("key", F.lit(key.lower())).withColumn("key_source", F.lit("explicit"))
    linear = bound(F.col("key"), lambda key: F.struct(*(to_linear(hex_channel(key, k)).alias(c) for k, c in enumerate("rgb"))))
    own = bound(linear, lambda v: topology(v["r"], v["g"], v["b"]))
    edge = bound(F.struct("lr", "lg", "lb"), lambda v: topology(v["lr"], v["lg"], v["lb"]))
    named = named.withColumn("t", own).withColumn("e", edge)
    same = (F.col("t.kind") == F.col("e.kind")) & (F.col("t.channel") == F.col("e.channel"))
    strength = F.when(same, F.col("e.strength")).otherwise(F.col("t.strength"))
    return named.select("image_id", "key", "key_source", F.col("t.kind").alias("kind"), F.col("t.channel").alias("channel"), strength.alias("strength"))


def mask_stats(masks: DataFrame) -> DataFrame:
    """``image_id, removed_pixels, removed_fraction``: pixels of alpha below 128."""
    removed = F.count_if(F.col("a") < 128)
    return masks.groupBy("image_id").agg(removed.alias("removed_pixels"), F.coalesce(F.try_divide(removed, F.count(F.lit(1))), F.lit(0.0)).alias("removed_fraction"))


def alpha_boxes(pixels: DataFrame) -> DataFrame:
    """``image_id, bbox``: rectangle of alpha above 0, null if empty."""
    return pixels.groupBy("image_id").agg(box_where(F.col("a") > 0).alias("bbox"))


def framecheck(pixels: DataFrame, images: DataFrame, threshold: int = 128, tolerance: int = 2, axes: str = "horizontal") -> DataFrame:
    """Whether each image's subject is centred: its boxes, margins, deltas, edge contact and
    verdict. The subject is the solid box (alpha of ``threshold`` or more), else any
    alpha; an empty image is centred."""
    if not 1 <= threshold <= 255 or tolerance < 0 or axes not in ("horizontal", "vertical", "both"):
        raise ValueError("threshold 1..255, tolerance >= 0, axes horizontal, vertical or both")
    boxes = pixels.groupBy("image_id").agg(box_where(F.col("a") > 0).alias("any_bbox"), box_where(F.col("a") >= threshold).alias("solid_bbox"))
    rows = images.select("image_id", "width", "height").join(boxes, "image_id", "left").withColumn("box", F.coalesce("solid_bbox", "any_bbox"))
    left, top = F.col("box.x"), F.col("box.y")
    right, bottom = F.col("width") - left - F.col("box.width"), F.col("height") - top - F.col("box.height")
    rows = rows.select("image_id", "width", "height", "any_bbox", "solid_bbox", left.alias("left"), right.alias("right"), top.alias("top"), bottom.alias("bottom"))
    h, v = F.abs(F.col("left") - F.col("right")), F.abs(F.col("top") - F.col("bottom"))
    fits = {"horizontal": h <= tolerance, "vertical": v <= tolerance, "both": (h <= tolerance) & (v <= tolerance)}[axes]
    touch = [(F.col(s) == 0).alias(s) for s in ("left", "right", "top", "bottom")]
    some = F.col("left").isNotNull()
    return rows.select(
        "image_id", "width", "height", "any_bbox", "solid_bbox", F.col("any_bbox").isNull().alias("empty"),
        F.when(some, F.struct("left", "right", "top", "bottom")).alias("margins"),
        F.when(some, F.struct(h.alias("horizontal"), v.alias("vertical"))).alias("deltas"),
        F.when(some, F.struct(*touch)).alias("edge_contact"),
        F.when(~some | fits, "centered").otherwise("offset").alias("verdict"),
    )


def with_edges(pixels: DataFrame) -> DataFrame:
    """Adds ``edge``: a present pixel beside one of alpha 0 within the image."""
    return beside_zero(pixels)


def with_residue(pixels: DataFrame, keys: DataFrame, hue_tolerance: float = 20, min_saturation: float = 0.35, min_value: float = 0.25) -> DataFrame:
    """Adds ``edge``, as :func:`with_edges`, and ``residue``: a present pixel of the key's hue. ``keys`` has
    ``image_id, key``; a key that is no colour or has no hue is an error. Keys come with the pixels of a tile."""
    kh = hsv(*(hex_channel(F.col("key"), k) for k in range(3)))[0]
    hue = F.coalesce(kh, F.raise_error(F.concat(F.lit("a key without a hue: "), F.coalesce("key", F.lit("null")))).cast("double"))
    rows = beside_zero(pixels, keys.select("image_id", hue.alias("key_hue")))
    h, s, v = hsv(F.col("r"), F.col("g"), F.col("b"))
    near = h.isNotNull() & (s >= min_saturation) & (v >= min_value) & (hue_distance(h, F.col("key_hue")) <= hue_tolerance)
    return rows.withColumn("residue", (F.col("a") > 0) & F.coalesce(near, F.lit(False))).drop("key_hue")


def keycheck(pixels: DataFrame, keys: DataFrame, hue_tolerance: float = 20, min_saturation: float = 0.35, min_value: float = 0.25, max_edge_residue_fraction: float = 0.02, max_interior_residue_pixels: int = 0) -> DataFrame:
    """Key residue of each image: counts on edges and inside, fractions, box and verdict."""
    if not (0 <= hue_tolerance <= 180 and 0 <= min_saturation <= 1 and 0 <= min_value <= 1 and 0 <= max_edge_residue_fraction <= 1 and max_interior_residue_pixels >= 0):
        raise ValueError("a limit is out of range")
    rows = with_residue(pixels, keys, hue_tolerance, min_saturation, min_value)
    both = F.col("residue") & F.col("edge")
    out = rows.groupBy("image_id").agg(
        F.count_if(F.col("a") > 0).alias("present_pixels"), F.count_if("edge").alias("edge_pixels"), F.count_if("residue").alias("residue_pixels"),
        F.count_if(both).alias("edge_residue_pixels"), box_where(F.col("residue")).alias("worst_bbox"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    out = out.withColumn("interior_residue_pixels", F.col("residue_pixels") - F.col("edge_residue_pixels"))
    out = out.withColumn("edge_residue_fraction", share("edge_residue_pixels", "edge_pixels")).withColumn("residue_fraction", share("residue_pixels", "present_pixels"))
    clean = (F.col("edge_residue_fraction") <= max_edge_residue_fraction) & (F.col("interior_residue_pixels") <= max_interior_residue_pixels)
    return out.withColumn("verdict", F.when(clean, "clean").otherwise("residue"))


def keycheck_heatmap(pixels: DataFrame, keys: DataFrame, **limits) -> DataFrame:
    """Pixels that show the residue: red on edges, orange inside, other present ones grey."""
    rows = with_residue(pixels, keys, **limits)
    bad, there = F.col("residue"), F.col("a") > 0
    pick = lambda residue, other: F.when(bad, residue).when(there, other).otherwise(0).cast("int")
    g = F.when(F.col("edge"), 0).otherwise(128)
    return rows.select(*KEY, pick(255, 90).alias("r"), pick(g, 90).alias("g"), pick(0, 90).alias("b"), pick(255, 110).alias("a"))

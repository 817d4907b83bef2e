"""Placing images: plans (a row for each image) and the pixels they lead to."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.color import half_up, parse_hex
from tessera.operators.compose import dilate
from tessera.operators.measure import KEY, alpha_boxes
from tessera.operators import tiles
from tessera.operators.packing import attached, folded, matched
from tessera.operators.tiles import weighed
from tessera.plans.staging import dealt, staged

#: Share of the free width and height that is left of and above an image, by gravity.
SHARES = {f"{v}{h}" or "center": (x, y) for v, y in (("", 0.5), ("north", 0.0), ("south", 1.0)) for h, x in (("", 0.5), ("west", 0.0), ("east", 1.0))}
GRAVITIES = tuple(SHARES)
MAX_TOP = 16384


def canvas(plan: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """A row for each position of each planned image: the plan's columns and ``y, x``."""
    rows = dealt(plan.where((F.col(width) > 0) & (F.col(height) > 0)), "image_id")
    rows = rows.withColumn("y", F.explode(F.sequence(F.lit(0), (F.col(height) - 1).cast("int"))))
    return rows.withColumn("x", F.explode(F.sequence(F.lit(0), (F.col(width) - 1).cast("int"))))


def trim_plan(pixels: DataFrame, margin: float = 0.08, square: bool = False) -> DataFrame:
    """``image_id, bbox, margin_px, pad_left, pad_top, width, height``; an image without
    content has a null box and sizes, and no output."""
    if not 0 <= margin <= 1:
        raise ValueError("margin must be in 0..1")
    rows = alpha_boxes(pixels)
    w, h = F.col("bbox.width"), F.col("bbox.height")
    px = half_up(F.lit(margin) * F.greatest(w, h)).cast("int")
    extra = (F.greatest(w, h) - w, F.greatest(w, h) - h) if square else (F.lit(0), F.lit(0))
    left, top = (px + F.floor(e / 2).cast("int") for e in extra)
    return rows.select("image_id", "bbox", px.alias("margin_px"), left.alias("pad_left"), top.alias("pad_top"), (w + 2 * px + extra[0]).cast("int").alias("width"), (h + 2 * px + extra[1]).cast("int").alias("height"))


def trim(pixels: DataFrame, margin: float = 0.08, square: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pixels cropped to their content with a transparent margin, and the plan. Pixels are moved, and
    those of the margin made, without a join of the two."""
    plan = staged(trim_plan(pixels, margin, square), "trim_plan")
    to = plan.where("bbox is not null").select("image_id", "bbox", "pad_left", "pad_top", "width", "height")
    span = lambda c, start, size: F.col(c).between(start, start + size - 1)
    rows = pixels.join(to.drop("width", "height"), "image_id")
    rows = rows.where(span("x", F.col("bbox.x"), F.col("bbox.width")) & span("y", F.col("bbox.y"), F.col("bbox.height")))
    moved = rows.select("image_id", (F.col("y") - F.col("bbox.y") + F.col("pad_top")).cast("int").alias("y"), (F.col("x") - F.col("bbox.x") + F.col("pad_left")).cast("int").alias("x"), *(F.col(c).cast("int").alias(c) for c in "rgba"))
    content = span("x", F.col("pad_left"), F.col("bbox.width")) & span("y", F.col("pad_top"), F.col("bbox.height"))
    return moved.union(canvas(to).where(~content).select(*KEY, *(F.lit(0).alias(c) for c in "rgba"))), plan


def filled(places: DataFrame, pixels: DataFrame) -> DataFrame:
    """Pixels on a canvas; where there is none, transparent black."""
    return matched(places.select(*KEY), pixels.select(*KEY, *"rgba"), tiles.TILE).select(*KEY, *(F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in "rgba"))


def anchor(gravity: Column, base_w: Column, base_h: Column, top_w: Column, top_h: Column) -> tuple[Column, Column]:
    """Where the top's corner goes on the base; outside of it where the top is larger."""
    shares = F.create_map(*(F.lit(v) for name, (x, y) in SHARES.items() for v in (name, [x, y])))
    share = lambda k: F.element_at(F.element_at(shares, gravity), k)
    return half_up((base_w - top_w) * share(1)).cast("int"), half_up((base_h - top_h) * share(2)).cast("int")


def fit_longer(width: Column, height: Column, longer: Column) -> tuple[Column, Column]:
    """Sizes whose longer side is given and whose aspect is kept."""
    aspect = width / height
    short = lambda c: F.greatest(F.lit(1), half_up(c)).cast("int")
    wide = width >= height
    return F.when(wide, longer).otherwise(short(longer * aspect)).cast("int"), F.when(wide, short(longer / aspect)).otherwise(longer).cast("int")


def fit_inside(width: Column, height: Column, fit_w: int = 1024, fit_h: int = 1024) -> Column:
    """struct(applied, width, height): shrunk to fit, never enlarged."""
    scale = F.least(F.lit(fit_w) / width, F.lit(fit_h) / height)
    applied = (width > fit_w) | (height > fit_h)
    size = lambda c: F.when(applied, F.greatest(F.lit(1), half_up(c * scale))).otherwise(c).cast("int")
    return F.struct(applied.alias("applied"), size(width).alias("width"), size(height).alias("height"))


def layer_plan(pairs: DataFrame, gravity: str = "center", scale: float | None = None, top_offset: tuple[int, int] | None = None) -> DataFrame:
    """``pairs(base_id, top_id, base_w, base_h, top_w, top_h)`` with ``out_w, out_h, dest_x, dest_y,
    status``: ok, too_small, too_large (scaled size) or outside (nothing of it shows)."""
    if gravity not in GRAVITIES or (scale is not None and scale <= 0):
        raise ValueError("unknown gravity, or scale not above 0")
    rows = pairs
    if scale is None:
        rows = rows.withColumn("longer", F.greatest("top_w", "top_h")).withColumn("out_w", F.col("top_w")).withColumn("out_h", F.col("top_h"))
    else:
        rows = rows.withColumn("longer", half_up(F.lit(scale) * F.least("base_w", "base_h")).cast("int"))
        w, h = fit_longer(F.col("top_w"), F.col("top_h"), F.col("longer"))
        rows = rows.withColumn("out_w", w).withColumn("out_h", h)
    if top_offset is None:
        x, y = anchor(F.lit(gravity), F.col("base_w"), F.col("base_h"), F.col("out_w"), F.col("out_h"))
    else:
        x, y = map(F.lit, top_offset)
    rows = rows.withColumn("dest_x", x).withColumn("dest_y", y)
    shown = (F.col("dest_x") < F.col("base_w")) & (F.col("dest_y") < F.col("base_h")) & (F.col("dest_x") + F.col("out_w") > 0) & (F.col("dest_y") + F.col("out_h") > 0)
    status = F.when(F.lit(scale is not None) & (F.col("longer") < 1), "too_small").when(F.lit(scale is not None) & (F.col("longer") > MAX_TOP), "too_large").when(~shown, "outside").otherwise("ok")
    return rows.withColumn("status", status).drop("longer")


def _over(top: dict[str, Column], under: dict[str, Column]) -> list[Column]:
    """Bytes of a pixel laid over another one with straight alpha."""
    t, u = top["a"] / 255, under["a"] / 255
    alpha = t + u * (1 - t)
    mixed = [F.when(alpha > 0, half_up((top[c] * t + under[c] * u * (1 - t)) / F.when(alpha > 0, alpha))).otherwise(0).cast("int").alias(c) for c in "rgb"]
    return [*mixed, half_up(alpha * 255).cast("int").alias("a")]


def _laid(under: dict[str, np.ndarray], top: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """:func:`_over` on arrays."""
    t, u = top["a"] / 255, under["a"] / 255
    alpha = t + u * (1 - t)
    safe = np.where(alpha > 0, alpha, 1.0)
    mixed = {c: np.where(alpha > 0, np.floor((top[c] * t + under[c] * u * (1 - t)) / safe + 0.5), 0).astype(np.int64) for c in "rgb"}
    return {**mixed, "a": np.floor(alpha * 255 + 0.5).astype(np.int64)}


def source_over(base: DataFrame, top: DataFrame, plan: DataFrame) -> DataFrame:
    """Tops (already at their planned size) laid over ``base`` with straight alpha; a row for each
    base pixel, as ``image_id`` the base's; bases without a top come as they are.

    Several tops of a base are laid over it one after the other, rounded each time, by the plan's
    ``position`` (null first; all alike if it has none), of equal ones by ``top_id``. The tops
    that cover a pixel are gathered for it, so as many as there are at most.
    Rounding may differ by 1 from other compositors."""
    order = (F.col("position") if "position" in plan.columns else F.lit(0)).asc_nulls_first()
    rank = F.row_number().over(Window.partitionBy("base_id").orderBy(order, "top_id", "dest_y", "dest_x"))
    where = staged(plan.where("status = 'ok'").select(F.col("top_id").alias("image_id"), "base_id", rank.alias("position"), "dest_y", "dest_x"), "placed")
    moved = attached(top.select(*KEY, *"rgba"), where, ["image_id"])
    return laid_over(base, moved, where.where("position > 1").isEmpty())


def laid_over(base: DataFrame, tops: DataFrame, single: bool) -> DataFrame:
    """``tops(base_id, position, dest_y, dest_x, y, x, r, g, b, a)`` laid over their bases by ``position``; ``single``: a base has
    one at most."""
    moved = tops.select(F.col("base_id").alias("image_id"), (F.col("y") + F.col("dest_y")).alias("y"), (F.col("x") + F.col("dest_x")).alias("x"), "position", *"rgba")
    base = base.select(*KEY, *"rgba")
    if single:
        rows = matched(base, moved.select(*KEY, *(F.col(c).alias(f"t{c}") for c in "rgba")), tiles.TILE)
        return rows.select(*KEY, *_over({c: F.coalesce(f"t{c}", F.lit(0)) for c in "rgba"}, {c: F.col(c) for c in "rgba"}))
    # a pixel that no top covers is rounded as the others are: without alpha it has no colour
    return folded(base.select(*KEY, *(F.col(c).cast("int").alias(c) for c in "rgba")), moved, tiles.TILE, "position", _laid)


def _cut(length: Column, core: int, margin: int) -> Column:
    """Of one side: an array of its tiles' number, core and feed, each as start and size. Cores
    part the side; a feed is the core with a margin, as far as the side goes."""
    many = F.ceil(length / core).cast("int")

    def one(k: Column) -> Column:
        start, feed = k * core, F.greatest(F.lit(0), k * core - margin)
        return F.struct(
            k.alias("number"), start.alias("core"), F.least(F.lit(core), length - start).alias("core_size"),
            feed.alias("feed"), (F.least(length, start + core + margin) - feed).alias("feed_size"),
        )

    return F.transform(F.sequence(F.lit(0), many - 1), one)


def plan_tiles(images: DataFrame, tile: int = 256, overlap: int = 32) -> DataFrame:
    """``image_id, row, col`` of each tile with its core (``core_y, core_x, core_h, core_w``), the
    part of the image that is its own, and its feed (``feed_y, feed_x, feed_h, feed_w``), the
    core with up to ``overlap`` pixels around it."""
    core = tile - 2 * overlap
    if overlap < 0 or core < 8:
        raise ValueError("a tile must be wider than its overlaps by 8 or more")
    rows = images.where("width > 0 and height > 0")
    rows = rows.select("image_id", "width", F.explode(_cut(F.col("height"), core, overlap)).alias("v")).withColumn("h", F.explode(_cut(F.col("width"), core, overlap)))
    side = lambda of, name: [F.col(f"{of}.{c}").cast("int").alias(f"{c.partition('_')[0]}_{name[c]}") for c in ("core", "core_size", "feed", "feed_size")]
    down, across = {"core": "y", "core_size": "h", "feed": "y", "feed_size": "h"}, {"core": "x", "core_size": "w", "feed": "x", "feed_size": "w"}
    return rows.select("image_id", F.col("v.number").alias("row"), F.col("h.number").alias("col"), *side("v", down), *side("h", across))


def tile_pixels(pixels: DataFrame, tiles: DataFrame, tile: int = 256, overlap: int = 32) -> DataFrame:
    """Each pixel in every tile that is fed it: ``image_id, row, col, y, x, r, g, b, a``, positions
    within the feed, with the tile's columns. A pixel's tiles are worked out, so the join is an equi-join."""
    core = tile - 2 * overlap
    near = lambda c: F.sequence(F.floor(F.greatest(F.lit(0), F.col(c) - overlap) / core).cast("int"), F.floor((F.col(c) + overlap) / core).cast("int"))
    rows = pixels.withColumn("row", F.explode(near("y"))).withColumn("col", F.explode(near("x")))
    rows = attached(rows, tiles, ["image_id", "row", "col"])
    y, x = F.col("y") - F.col("feed_y"), F.col("x") - F.col("feed_x")
    return rows.withColumns({"y": y, "x": x}).where("y >= 0 and y < feed_h and x >= 0 and x < feed_w")


def stitch(tiled: DataFrame, scale: int = 1) -> DataFrame:
    """Whole images from the pixels of feeds (scaled by ``scale``): the cores, each position once."""
    y, x = F.col("y") + F.col("feed_y") * scale, F.col("x") + F.col("feed_x") * scale
    own = lambda c, n: (F.col(c) >= F.col(f"core_{c}") * scale) & (F.col(c) < (F.col(f"core_{c}") + F.col(f"core_{n}")) * scale)
    return tiled.withColumns({"y": y, "x": x}).where(own("y", "h") & own("x", "w")).select("image_id", "y", "x", "r", "g", "b", "a")


def pad_to_multiple(pixels: DataFrame, images: DataFrame, multiple: int = 8) -> tuple[DataFrame, DataFrame]:
    """Images continued to the right and below to a multiple of a number of pixels, mirrored with
    the edge repeated, and their new sizes (``image_id, width, height``)."""
    if multiple < 1:
        raise ValueError("multiple must be at least 1")

    def copies(c: str, size: str) -> Column:
        """Places that a pixel has in its row or column: its own, and those that show it in the mirror."""
        n, own = F.col(size), F.col(c)
        last = (F.ceil(n / multiple) * multiple - 1).cast("int")
        again = lambda first: F.when(first <= last, F.sequence(first, F.greatest(first, last), 2 * n)).otherwise(F.array().cast("array<int>"))
        # up to the side again, a pixel shows once in the mirror at most
        once = F.when(2 * n - 1 - own <= last, F.array(own, 2 * n - 1 - own)).otherwise(F.array(own))
        return F.when(last < 2 * n, once).otherwise(F.concat(again(own), again(2 * n - 1 - own)))

    sizes = images.select("image_id", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"))
    rows = pixels.select("image_id", *(F.col(c).cast("int").alias(c) for c in "yx"), *"rgba")
    rows = attached(rows, sizes, ["image_id"]).withColumn("x", F.explode(copies("x", "width"))).withColumn("y", F.explode(copies("y", "height")))
    padded = sizes.select("image_id", *((F.ceil(F.col(c) / multiple) * multiple).cast("int").alias(c) for c in ("width", "height")))
    return rows.select("image_id", "y", "x", "r", "g", "b", "a"), padded


def sheet_plan(sheets: DataFrame, cols: int | None = None, cell: int = 256, gap: int = 16) -> DataFrame:
    """``sheets(sheet_id, pos, image_id, readable)`` -> the readable ones with ``place, cols, rows, left, top,
    width, height``; the sheet's size is the same in all its rows."""
    if cell < 1 or gap < 0 or (cols is not None and cols < 1):
        raise ValueError("cell and cols must be at least 1, gap not negative")
    order, whole = Window.partitionBy("sheet_id").orderBy("pos", "image_id"), Window.partitionBy("sheet_id")
    rows = sheets.where("readable").withColumn("place", F.row_number().over(order) - 1).withColumn("placed", F.count(F.lit(1)).over(whole))
    many = F.lit(cols) if cols else F.ceil(F.sqrt("placed")).cast("int")
    rows = rows.withColumn("cols", many).withColumn("rows", F.ceil(F.col("placed") / F.col("cols")).cast("int"))
    left = gap + (F.col("place") % F.col("cols")) * (cell + gap)
    top = gap + F.floor(F.col("place") / F.col("cols")) * (cell + gap)
    return rows.select("sheet_id", "image_id", "place", "cols", "rows", left.cast("int").alias("left"), top.cast("int").alias("top"), (F.col("cols") * (cell + gap) + gap).alias("width"), (F.col("rows") * (cell + gap) + gap).alias("height"))


def sheet_report(sheets: DataFrame, cols: int | None = None, cell: int = 256, gap: int = 16) -> DataFrame:
    """``sheet_id, count, placed, skipped, cols, rows, width, height``; sizes are null where nothing can be placed."""
    skipped = F.array_sort(F.collect_list(F.when(~F.col("readable"), F.struct("pos", "image_id"))))
    counts = sheets.groupBy("sheet_id").agg(F.count(F.lit(1)).alias("count"), F.count_if("readable").alias("placed"), F.transform(skipped, lambda s: s["image_id"]).alias("skipped"))
    sizes = sheet_plan(sheets, cols, cell, gap).where("place = 0").select("sheet_id", "cols", "rows", "width", "height")
    return counts.join(sizes, "sheet_id", "left")


def shadow_plan(images: DataFrame, blur: float = 12, offset: tuple[int, int] = (0, 8), spread: int = 0, keep_canvas: bool = False) -> DataFrame:
    """``image_id, pad, canvas_w, canvas_h, subject_x, subject_y, shadow_x, shadow_y``."""
    if not (blur == 0 or 0.3 <= blur <= 1000) or not all(-10000 <= v <= 10000 for v in offset) or not 0 <= spread <= 1024:
        raise ValueError("blur, offset or spread out of range")
    pad = spread + (-int(-3 * blur // 1) if blur > 0 else 0)
    x, y, w, h = F.lit(offset[0] - pad), F.lit(offset[1] - pad), F.col("width"), F.col("height")
    if keep_canvas:
        zero = F.lit(0)
        return images.select("image_id", F.lit(pad).alias("pad"), w.alias("canvas_w"), h.alias("canvas_h"), zero.alias("subject_x"), zero.alias("subject_y"), x.alias("shadow_x"), y.alias("shadow_y"))
    mx, my = F.least(F.lit(0), x), F.least(F.lit(0), y)
    cw, ch = F.greatest(w, x + w + 2 * pad) - mx, F.greatest(h, y + h + 2 * pad) - my
    return images.select("image_id", F.lit(pad).alias("pad"), cw.alias("canvas_w"), ch.alias("canvas_h"), (-mx).alias("subject_x"), (-my).alias("subject_y"), (x - mx).alias("shadow_x"), (y - my).alias("shadow_y"))


def gaussian(masks: DataFrame, sigma: float) -> DataFrame:
    """Gaussian blur of one channel over rows and columns; the kernel ends at 3 sigma and is
    weighed anew where it leaves the image. Results are ours to within rounding of other kernels."""
    return weighed(masks, np.array(gaussian_weights(sigma), float))


def gaussian_weights(sigma: float) -> list[int]:
    """The kernel in whole parts of its middle's, so that sums don't hang on their order."""
    reach = math.ceil(3 * sigma)
    return [round(math.exp(-(k**2) / (2 * sigma**2)) * (1 << 30)) for k in range(-reach, reach + 1)]


def shadow(pixels: DataFrame, images: DataFrame, blur: float = 12, offset: tuple[int, int] = (0, 8), color: str = "#000000", opacity: float = 0.35, spread: int = 0, keep_canvas: bool = False) -> DataFrame:
    """Images over their drop shadow: alpha dilated by ``spread``, blurred, tinted and moved."""
    if not 0 < opacity <= 1:
        raise ValueError("opacity must be in (0, 1]")
    tint = parse_hex(color)
    plan = shadow_plan(images, blur, offset, spread, keep_canvas)
    sized = plan.join(images.select("image_id", "width", "height"), "image_id")
    padded = canvas(sized.select("image_id", (F.col("width") + 2 * F.col("pad")).alias("width"), (F.col("height") + 2 * F.col("pad")).alias("height"))).select(*KEY)
    alpha = pixels.join(plan.select("image_id", "pad"), "image_id").select("image_id", (F.col("y") + F.col("pad")).alias("y"), (F.col("x") + F.col("pad")).alias("x"), "a")
    mask = matched(padded, alpha, tiles.TILE).select(*KEY, F.coalesce("a", F.lit(0)).alias("a"))
    mask = dilate(mask, spread) if spread else mask
    mask = mask.withColumn("a", half_up(F.col("a") * opacity).cast("int"))
    mask = gaussian(mask, blur) if blur > 0 else mask
    cast = mask.join(plan, "image_id").select("image_id", (F.col("y") + F.col("shadow_y")).alias("y"), (F.col("x") + F.col("shadow_x")).alias("x"), *(F.lit(t).alias(c) for t, c in zip(tint, "rgb", strict=True)), "a")
    places = canvas(plan.select("image_id", F.col("canvas_w").alias("width"), F.col("canvas_h").alias("height"))).select(*KEY)
    below = filled(places, cast)
    at = plan.select(F.col("image_id").alias("base_id"), F.col("image_id").alias("top_id"), F.col("subject_x").alias("dest_x"), F.col("subject_y").alias("dest_y"), F.lit("ok").alias("status"))
    return source_over(below, pixels, at)

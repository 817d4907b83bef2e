"""Masks from a key, their algebra, and composing images with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.color import half_up, linear_table, parse_hex, spill_alpha, to_byte, to_linear
from tessera.operators.measure import KEY, keys_of, mask_stats
from tessera.operators import tiles
from tessera.operators.packing import attached, matched
from tessera.operators.tiles import REACH, box_blurred, dilated
from tessera.plans.staging import staged

PAIR = ["image_id", "y", "x"]


def same_size(a: DataFrame, b: DataFrame) -> DataFrame:
    """``image_id, a_width, a_height, b_width, b_height`` of images whose sizes differ or
    which one side lacks."""
    left = a.select("image_id", F.col("width").alias("a_width"), F.col("height").alias("a_height"))
    right = b.select("image_id", F.col("width").alias("b_width"), F.col("height").alias("b_height"))
    both = left.join(right, "image_id", "full")
    return both.where(~(F.col("a_width").eqNullSafe(F.col("b_width")) & F.col("a_height").eqNullSafe(F.col("b_height"))))


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two rasters joined by position. A position that one of them lacks (sizes differ, or an
    image is missing) is an error when the rows are worked out. Columns but the position differ."""
    return matched(a, b, tiles.TILE, "exact")


def chroma_mask(pixels: DataFrame, images: DataFrame, key: str = "auto", sidecars: DataFrame | None = None, preserve_interior: bool = False, border_sample: int = 4, saturation_ratio: float = 0.82) -> tuple[DataFrame, DataFrame]:
    """Masks (``image_id, y, x, a``) that remove each image's key, and statistics."""
    if not 0 < saturation_ratio <= 1:
        raise ValueError("saturation_ratio must be in (0, 1]")
    keys = keys_of(pixels, images, key, sidecars, border_sample)
    rows = attached(pixels.select(*KEY, "r", "g", "b"), keys.select("image_id", "kind", "channel", "strength"), ["image_id"])
    rows = rows.withColumns({f"l{c}": to_linear(F.col(c)) for c in "rgb"})
    alpha = spill_alpha(F.col("lr"), F.col("lg"), F.col("lb"), F.col("kind"), F.col("channel"), F.col("strength"), saturation_ratio)
    masks = rows.select(*KEY, alpha.alias("a"))
    if preserve_interior:
        from tessera.operators.components import preserve_interior as keep

        masks = keep(masks, images)
    stats = mask_stats(masks).join(keys.select("image_id", "key", "key_source"), "image_id")
    return masks, stats


def combine(op: str, a: DataFrame, b: DataFrame | None = None, radius: float = 1) -> DataFrame:
    """Mask algebra: union, intersect and subtract of two masks, invert and feather of one."""
    if op in ("union", "intersect", "subtract"):
        if b is None:
            raise ValueError(f"{op} needs two masks")
        both = aligned(a.select(*PAIR, F.col("a").alias("p")), b.select(*PAIR, F.col("a").alias("q")))
        value = {"union": F.greatest("p", "q"), "intersect": F.least("p", "q"), "subtract": F.greatest(F.col("p") - F.col("q"), F.lit(0))}[op]
        return both.select(*PAIR, value.alias("a"))
    if b is not None:
        raise ValueError(f"{op} takes one mask")
    if op == "invert":
        return a.select(*PAIR, (255 - F.col("a")).alias("a"))
    if op == "feather":
        return feather(a, radius)
    raise ValueError(f"unknown operation {op!r}")


def feather(masks: DataFrame, radius: float = 1) -> DataFrame:
    """Box blur: floor(radius) passes of a 3-tap mean over rows, then over columns, rounded each time.

    Up to ``tiles.REACH`` passes run within a task, on a tile and as many pixels around it, after
    one shuffle; further ones after another, between staged tables. A null value gives nothing to its
    neighbours."""
    if not 0 <= radius <= 1024:
        raise ValueError("radius must be in 0..1024")
    out, left = masks.select(*PAIR, "a"), int(radius)
    while left:
        passes = min(left, REACH)
        out, left = box_blurred(out, passes), left - passes
        if left:
            out = staged(out, "feather")
    return out


def dilate(masks: DataFrame, radius: int) -> DataFrame:
    """``image_id, y, x, a``: the largest value within ``radius`` in both directions, first along rows."""
    if radius < 0:
        raise ValueError("radius must not be negative")
    return dilated(masks, radius)


def alpha_floor(pixels: DataFrame, threshold: int = 5) -> tuple[DataFrame, DataFrame]:
    """Pixels whose faint alpha (below ``threshold``) is 0 now, and ``floored_pixels`` of each image."""
    if not 0 <= threshold <= 255:
        raise ValueError("threshold must be in 0..255")
    faint = (F.col("a") > 0) & (F.col("a") < max(threshold, 1))
    counts = pixels.groupBy("image_id").agg(F.count_if(faint).alias("floored_pixels"))
    return pixels.withColumn("a", F.when(faint, 0).otherwise(F.col("a"))), counts


def without_bleed(r: Column, g: Column, b: Column, a: Column, key: str) -> tuple[Column, Column, Column]:
    """Bytes of a pixel without the light of a background, by the kind of its key.

    primary: the key's channel is held to the larger of the others. secondary: what both
    others have over the suppressed channel goes. No hue: a half-transparent pixel is
    solved for its own colour. Where a is 0 nothing changes but the two roundings."""
    spark_key = [F.lit(linear) for linear in _linear(key)]
    kind = _topology(_linear(key))
    c = [to_linear(x) for x in (r, g, b)]
    if kind is None:
        alpha = a / 255
        inside = (a > 0) & (a < 255) & (alpha > 0.05)
        safe = F.when(inside, alpha)
        solved = [F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - (1 - alpha) * k) / safe)).cast("float").cast("double") for x, k in zip(c, spark_key, strict=True)]
        return tuple(to_byte(F.when(inside, s).otherwise(x)) for s, x in zip(solved, c, strict=True))
    name, at, _ = kind
    others = [k for k in range(3) if k != at]
    out = list(c)
    if name == "primary":
        out[at] = F.when(a > 0, F.least(c[at], F.greatest(*(c[k] for k in others)))).otherwise(c[at])
    else:
        excess = F.least(*(c[k] for k in others)) - c[at]
        for k in others:
            out[k] = F.when((a > 0) & (excess > 0), F.greatest(F.lit(0.0), c[k] - excess).cast("float").cast("double")).otherwise(c[k])
    return tuple(to_byte(x) for x in out)


def _linear(key: str) -> list[float]:
    table = linear_table()
    return [table[x] for x in parse_hex(key)]


def _topology(v: list[float]) -> tuple[str, int, float] | None:
    top, low = max(v), min(v)
    mid = v[0] + v[1] + v[2] - top - low
    if top < 0.05:
        return None
    if top - mid >= mid - low and top - mid >= 0.05:
        return "primary", v.index(top), top
    if mid - low > top - mid and mid - low >= 0.05:
        return "secondary", v.index(low), mid - low
    return None


def over_spec(over: str | DataFrame) -> tuple[str, object]:
    """What to put below: ("transparent", None), ("color", bytes) or ("image", pixels)."""
    if isinstance(over, DataFrame):
        return "image", over
    if over == "transparent":
        return "transparent", None
    if len(over) == 6 and all(c in "0123456789abcdefABCDEF" for c in over):
        raise ValueError(f"a colour needs a #: {over!r}")
    return "color", parse_hex(over)


def compose(pixels: DataFrame, masks: DataFrame, over: str | DataFrame = "transparent", remove_bleed: str | None = None) -> DataFrame:
    """Each image cut out by its mask, or laid over a colour or over other images' pixels.

    Images, masks and what is below are joined by position; where sizes differ it is an error."""
    kind, below = over_spec(over)
    rows = aligned(pixels.select(*KEY, "r", "g", "b"), masks.select(*KEY, F.col("a").alias("m")))
    r, g, b, m = (F.col(c) for c in "rgbm")
    if remove_bleed:
        r, g, b = without_bleed(r, g, b, m, remove_bleed)
        rows = rows.select(*KEY, "m", r.alias("r"), g.alias("g"), b.alias("b"))
        r, g, b = (F.col(c) for c in "rgb")
    if kind == "transparent":
        return rows.select(*KEY, *(F.when(m > 0, c).otherwise(0).cast("int").alias(n) for c, n in zip((r, g, b), "rgb", strict=True)), m.cast("int").alias("a"))
    t = m / 255
    if kind == "color":
        under = [F.lit(x) for x in below]
    else:
        rows = aligned(rows, below.select(*KEY, *(F.col(c).alias(f"o{c}") for c in "rgb")))
        under = [F.col(f"o{c}") for c in "rgb"]
    mixed = [half_up(c * t + u * (1 - t)).cast("int").alias(n) for c, u, n in zip((r, g, b), under, "rgb", strict=True)]
    return rows.select(*KEY, *mixed, F.lit(255).alias("a"))

"""Colour arithmetic on columns: sRGB and linear light, HSV, and the topology of a key.

Bytes are integers 0..255. Linear values are doubles that hold float32 results, as
rasters keep linear light in single precision."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A channel is the key's if it leads (or trails) by this much in linear light; a key darker than this is none.
LEAST_GAP = LEAST_STRENGTH = 0.05


def parse_hex(text: str) -> tuple[int, int, int]:
    """``#rrggbb`` -> bytes; anything else is an error."""
    if not isinstance(text, str) or not re.fullmatch(r"#[0-9a-fA-F]{6}", text):
        raise ValueError(f"not a #rrggbb colour: {text!r}")
    return tuple(int(text[k : k + 2], 16) for k in (1, 3, 5))


def is_hex(c: Column) -> Column:
    return c.rlike("^#[0-9a-fA-F]{6}$")


def normalized_hex(c: Column) -> Column:
    """Lower case where it is a colour, else null."""
    return F.when(is_hex(c), F.lower(c))


def hex_channel(c: Column, k: int) -> Column:
    """Byte k of a ``#rrggbb`` column; null where it is none."""
    return F.when(is_hex(c), F.conv(F.substring(c, 2 + 2 * k, 2), 16, 10).cast("int"))


def hex_of(*channels: Column) -> Column:
    return F.concat(F.lit("#"), *(F.lpad(F.lower(F.hex(c.cast("long"))), 2, "0") for c in channels))


def linear_table() -> list[float]:
    """Linear light of each byte, rounded to single precision."""
    c = np.arange(256) / 255
    return np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4).astype(np.float32).astype(float).tolist()


def to_linear(c: Column) -> Column:
    return F.element_at(F.expr("array(" + ", ".join(f"{v!r}D" for v in linear_table()) + ")"), c + 1)


def half_up(c: Column) -> Column:
    """Rounding with halves upwards, negative ones too."""
    return F.floor(c + 0.5)


def bound(value: Column, fn) -> Column:
    """``fn(value)`` with the value worked out once, however often ``fn`` uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def to_byte(c: Column) -> Column:
    """Linear light -> sRGB byte; not finite or below 0 gives 0."""
    s = F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(F.greatest(c, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)
    value = F.least(F.lit(255), F.greatest(F.lit(0), half_up(s * 255)))
    return F.when(c.isNull() | F.isnan(c) | (c <= 0), 0).when(c >= 1, F.when(c == float("inf"), 0).otherwise(255)).otherwise(value).cast("int")


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in [0, 360) (null for grey), saturation and value in [0, 1]."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = (top - low).cast("double")
    safe = F.when(d > 0, d)
    h = F.when(top == r, (g - b) / safe).when(top == g, (b - r) / safe + 2).otherwise((r - g) / safe + 4) * 60
    h = F.when(h < 0, h + 360).otherwise(h)
    return h, F.when(top > 0, d / F.when(top > 0, top)).otherwise(F.lit(0.0)), top / 255


def hue_distance(a: Column, b: Column) -> Column:
    d = F.abs(a - b) % 360
    return F.when(d > 180, 360 - d).otherwise(d)


def topology(r: Column, g: Column, b: Column) -> Column:
    """Of a key in linear light: struct(kind, channel, strength); null if it has no hue.

    primary: one channel leads the middle one by at least LEAST_GAP and as much as the
    middle leads the last; its strength is its value. secondary: one channel trails;
    the strength is the gap. Of equal channels the first counts."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    mid = r + g + b - top - low
    first = lambda v: F.when(r == v, 0).when(g == v, 1).otherwise(2)
    leads, trails = top - mid, mid - low
    primary = F.struct(F.lit("primary").alias("kind"), first(top).alias("channel"), top.alias("strength"))
    secondary = F.struct(F.lit("secondary").alias("kind"), first(low).alias("channel"), trails.alias("strength"))
    return F.when(top < LEAST_STRENGTH, None).when((leads >= trails) & (leads >= LEAST_GAP), primary).when((trails > leads) & (trails >= LEAST_GAP), secondary)


def pick(channel: Column, shift: int, r: Column, g: Column, b: Column) -> Column:
    """The colour channel ``shift`` places after the given one."""
    at = (channel + shift) % 3
    return F.when(at == 0, r).when(at == 1, g).otherwise(b)


def spill_alpha(r: Column, g: Column, b: Column, kind: Column, channel: Column, strength: Column, ratio: float) -> Column:
    """Alpha of a pixel in linear light by how much of the key's spill it has; 255 for a null kind."""
    own, one, two = (pick(channel, k, r, g, b) for k in range(3))
    spill = F.when(kind == "primary", own - F.greatest(one, two)).otherwise(F.least(one, two) - own)
    share = (spill / strength) * (1 / max(0.001, min(1.0, ratio)))
    return F.when(kind.isNull() | (spill <= 0), 255).when(share >= 1, 0).otherwise(half_up((1 - share) * 255)).cast("int")

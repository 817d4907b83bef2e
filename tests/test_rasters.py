"""Operators on small rasters, against plain Python."""

import numpy as np
import pytest

from tessera.functions.color import hsv, parse_hex, to_byte, to_linear
from tessera.operators import components, compose, geometry, layers, measure, resample, tiles
from tessera.operators.components import connected
from pyspark.sql import functions as F

from tessera.sources import files

SCHEMA = "image_id long, y int, x int, r int, g int, b int, a int"


def table(spark, rasters):
    """Rasters (h, w, 4) by number -> pixels and images."""
    rows = [(k, y, x, *map(int, m[y, x])) for k, m in rasters.items() for y in range(m.shape[0]) for x in range(m.shape[1])]
    sizes = [(k, m.shape[1], m.shape[0]) for k, m in rasters.items()]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(sizes, "image_id long, width int, height int")


def alpha(values):
    a = np.array(values)
    return np.dstack([np.full_like(a, 9)] * 3 + [a])


def back(df, shape, channel="a"):
    out = np.full(shape, -1)
    for r in df.collect():
        out[r["y"], r["x"]] = r[channel]
    return out.tolist()


def flood(mask, connectivity):
    """Label of each present pixel: the first of its component in scan order."""
    h, w = mask.shape
    label = np.full((h, w), -1)
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if connectivity == 8 else [])
    for y in range(h):
        for x in range(w):
            if mask[y, x] and label[y, x] < 0:
                stack, label[y, x] = [(y, x)], y * w + x
                while stack:
                    p, q = stack.pop()
                    for dy, dx in steps:
                        v, u = p + dy, q + dx
                        if 0 <= v < h and 0 <= u < w and mask[v, u] and label[v, u] < 0:
                            label[v, u] = y * w + x
                            stack.append((v, u))
    return label


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components_equal_flood_fill(spark, connectivity):
    rng = np.random.default_rng(5)
    rasters = {k: alpha(np.where(rng.random((rng.integers(8, 24), rng.integers(8, 24))) < 0.5, 200, 0)) for k in range(12)}
    pixels, images = table(spark, rasters)
    got = {(r["image_id"], r["y"], r["x"]): r["label"] for r in connected(pixels, images, 1, connectivity).collect()}
    want = {(k, y, x): v for k, m in rasters.items() for (y, x), v in np.ndenumerate(flood(m[..., 3] > 0, connectivity)) if v >= 0}
    assert got == want


@pytest.mark.parametrize(("connectivity", "tile"), [(4, 3), (8, 3), (4, 5), (8, 5), (8, 256)])
def test_components_across_tiles_equal_flood_fill(spark, monkeypatch, connectivity, tile):
    monkeypatch.setattr(tiles, "TILE", tile)
    rng = np.random.default_rng(tile)
    rasters = {k: alpha(np.where(rng.random((rng.integers(1, 17), rng.integers(1, 17))) < 0.35 + k % 4 * 0.15, 200, 0)) for k in range(12)}
    spiral = np.zeros((15, 15), int)
    for k in range(0, 7, 2):
        spiral[k, k : 15 - k] = spiral[k : 15 - k, 14 - k] = spiral[14 - k, k : 15 - k] = spiral[k + 2 : 15 - k, k] = 9
        spiral[k + 2, k : k + 2] = 9
    pixels, images = table(spark, rasters | {20: alpha(spiral)})
    got = {(r["image_id"], r["y"], r["x"]): r["label"] for r in connected(pixels, images, 1, connectivity).collect()}
    want = {(k, y, x): v for k, m in (rasters | {20: alpha(spiral)}).items() for (y, x), v in np.ndenumerate(flood(m[..., 3] > 0, connectivity)) if v >= 0}
    assert got == want


def test_despeckle_removes_small_components_and_is_idempotent(spark):
    pixels, images = table(spark, {1: alpha([[9, 0, 3, 0], [9, 0, 0, 0], [0, 0, 0, 9]]), 2: alpha([[0, 0], [0, 0]])})
    out, report = components.despeckle(pixels, images, 5, 2, 4)
    assert back(out.where("image_id = 1"), (3, 4)) == [[9, 0, 0, 0], [9, 0, 0, 0], [0, 0, 0, 0]]
    again, _ = components.despeckle(out, images, 5, 2, 4)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))
    r = {x["image_id"]: x for x in report.collect()}
    assert (r[1]["floored_pixels"], r[1]["components"], r[1]["removed_components"], r[1]["removed_pixels"]) == (1, 2, 1, 1)
    assert r[2]["components"] == 0 and r[2]["bbox_after"] is None


def test_largest_component_of_equals_is_the_first(spark):
    pixels, images = table(spark, {1: alpha([[9, 0, 9], [9, 0, 9]])})
    assert back(components.despeckle(pixels, images, keep="largest")[0], (2, 3)) == [[9, 0, 0], [9, 0, 0]]


def test_holes_become_opaque_and_bays_do_not(spark):
    pixels, images = table(spark, {1: alpha([[255, 255, 255, 0], [255, 0, 255, 0], [255, 255, 255, 255]])})
    assert back(components.preserve_interior(pixels, images), (3, 4)) == [[255, 255, 255, 0], [255, 255, 255, 0], [255, 255, 255, 255]]


def test_linear_light_and_back(spark):
    rows = spark.range(256).select(F.col("id").cast("int").alias("b")).select("b", to_byte(to_linear(F.col("b"))).alias("again"))
    assert rows.where("b <> again").count() == 0


def test_hsv(spark):
    h, s, v = hsv(*(F.col(c) for c in "rgb"))
    rows = spark.createDataFrame([(255, 0, 0), (0, 255, 0), (255, 0, 255), (7, 7, 7), (0, 0, 0)], "r int, g int, b int").select(h.alias("h"), s.alias("s"), v.alias("v")).collect()
    assert [r["h"] for r in rows] == [0, 120, 300, None, None] and [r["s"] for r in rows] == [1, 1, 1, 0, 0] and rows[4]["v"] == 0


@pytest.mark.parametrize("key, kind, channel", [("#00ff00", "primary", 1), ("#ff00ff", "secondary", 1), ("#808080", None, None), ("#000000", None, None)])
def test_mask_of_explicit_keys(spark, key, kind, channel):
    raster = np.zeros((6, 6, 4), int) + [*parse_hex(key), 255]
    raster[2:4, 2:4] = [200, 30, 10, 255]
    pixels, images = table(spark, {1: raster})
    row = measure.keys_of(pixels, images, key, depth=1).first()
    assert (row["kind"], row["channel"]) == (kind, channel)
    masks, stats = compose.chroma_mask(pixels, images, key, border_sample=1)
    assert stats.first()["removed_pixels"] == (32 if kind else 0)


@pytest.mark.parametrize("bad", ["00ff00", "#00ff0", "#gg0000", None])
def test_colours_need_their_form(bad):
    with pytest.raises(ValueError):
        parse_hex(bad)


def test_bleed_of_a_secondary_key_goes(spark):
    pixels, _ = table(spark, {1: np.array([[[200, 40, 200, 255], [40, 200, 40, 255]]])})
    masks = pixels.select("image_id", "y", "x", "a")
    rows = compose.compose(pixels, masks, "transparent", "#ff00ff").orderBy("x").collect()
    assert rows[0]["r"] == rows[0]["b"] == rows[0]["g"] == 40 and rows[1]["g"] == 200


def test_feather_rounds_each_pass(spark):
    pixels, _ = table(spark, {1: alpha([[0, 255, 0]])})
    assert back(compose.feather(pixels.select("image_id", "y", "x", "a")), (1, 3)) == [[128, 85, 128]]


def plain_feather(a, passes):
    for _ in range(passes):
        for axis in (1, 0):
            there = np.ones_like(a)
            pad = [(0, 0), (0, 0)]
            pad[axis] = (1, 1)
            v, n = np.pad(a, pad), np.pad(there, pad)
            cut = lambda m, k: m[:, k : k + a.shape[1]] if axis == 1 else m[k : k + a.shape[0]]  # noqa: E731, B023
            a = np.floor(sum(cut(v, k) for k in range(3)) / sum(cut(n, k) for k in range(3)) + 0.5).astype(int)
    return a


@pytest.mark.parametrize(("radius", "tile", "reach"), [(1, 256, 64), (7, 5, 3), (6, 8, 2), (13.9, 256, 64), (5, 4, 5)])
def test_feather_over_tiles_equals_whole_images(spark, monkeypatch, radius, tile, reach):
    monkeypatch.setattr(tiles, "TILE", tile)
    monkeypatch.setattr(compose, "REACH", reach)
    rng = np.random.default_rng(tile)
    rasters = {k: rng.integers(0, 256, size) for k, size in enumerate(((11, 17), (1, 30), (16, 3), (1, 1)))}
    pixels, _ = table(spark, {k: alpha(v) for k, v in rasters.items()})
    out = compose.feather(pixels.select("image_id", "y", "x", "a"), radius)
    for k, v in rasters.items():
        assert back(out.where(f"image_id = {k}"), v.shape) == plain_feather(v, int(radius)).tolist()


@pytest.mark.parametrize("radius", [0, 1, 4, 40])
def test_dilation_equals_the_largest_of_windows(spark, monkeypatch, radius):
    monkeypatch.setattr(tiles, "BAND", 4)
    rng = np.random.default_rng(radius)
    rasters = {k: rng.integers(0, 256, size) for k, size in enumerate(((11, 17), (1, 30), (16, 3), (1, 1)))}
    pixels, _ = table(spark, {k: alpha(v) for k, v in rasters.items()})
    out = compose.dilate(pixels.select("image_id", "y", "x", "a"), radius)
    for k, v in rasters.items():
        want = [[int(v[max(0, y - radius) : y + radius + 1, max(0, x - radius) : x + radius + 1].max()) for x in range(v.shape[1])] for y in range(v.shape[0])]
        assert back(out.where(f"image_id = {k}"), v.shape) == want


def test_trim_of_an_empty_image_has_no_pixels(spark):
    pixels, _ = table(spark, {1: alpha([[0, 0]]), 2: alpha([[0, 0, 0], [0, 7, 0]])})
    out, plan = geometry.trim(pixels, 0)
    assert {r["image_id"]: r["bbox"] and tuple(r["bbox"]) for r in plan.collect()} == {1: None, 2: (1, 1, 1, 1)}
    assert [tuple(r) for r in out.collect()] == [(2, 0, 0, 9, 9, 9, 7)]


def test_tiles_partition_the_canvas_and_upscale_equals_one_pass(spark):
    rng = np.random.default_rng(1)
    raster = np.dstack([rng.integers(0, 256, (21, 13, 3)), np.full((21, 13), 255)])
    pixels, images = table(spark, {1: raster})
    tiles = geometry.plan_tiles(images, 16, 4)
    assert tiles.selectExpr("sum(core_w * core_h)").first()[0] == 21 * 13
    out = resample.map_tiles(pixels, tiles, lambda t: t.repeat(4, 0).repeat(4, 1), 4, 16, 4)
    for k, c in enumerate("rgb"):
        assert back(out, (84, 52), c) == raster[..., k].repeat(4, 0).repeat(4, 1).tolist()


@pytest.mark.parametrize("kernel", ["nearest", "cubic", "mitchell", "lanczos2", "lanczos3"])
def test_resizing_a_flat_image_keeps_its_colour(spark, kernel):
    pixels, images = table(spark, {1: np.zeros((6, 8, 4), int) + [10, 200, 30, 255]})
    out = resample.resize(pixels, images, 5, kernel)
    assert {tuple(r)[3:] for r in out.collect()} == {(10, 200, 30, 255)} and out.count() == 20


def test_shadow_canvas_grows(spark):
    pixels, images = table(spark, {1: alpha([[255, 255], [255, 255]])})
    out = geometry.shadow(pixels, images, blur=0, offset=(1, 1), color="#000000", opacity=1)
    assert back(out, (3, 3)) == [[255, 255, 0], [255, 255, 255], [0, 255, 255]]


def test_limits_are_checked(spark):
    pixels, images = table(spark, {1: alpha([[1]])})
    for call in (lambda: compose.feather(pixels, 1025), lambda: components.despeckle(pixels, images, keep="some"), lambda: measure.framecheck(pixels, images, 0), lambda: resample.resize(pixels, images, 0), lambda: geometry.trim(pixels, 2), lambda: compose.combine("union", pixels)):
        with pytest.raises(ValueError):
            call()


def test_size_pyramid_makes_each_entry(spark):
    pixels, images = table(spark, {1: np.zeros((8, 8, 4), int) + 255})
    entries = spark.createDataFrame([("a", 4), ("b", 4), ("c", 2)], "entry string, size int")
    counts = {r["entry"]: r["count"] for r in resample.size_pyramid(pixels, images, entries, least_master=8).groupBy("entry").count().collect()}
    assert counts == {"a": 16, "b": 16, "c": 4}


def kernel_1d(name, d):
    d = abs(d)
    if name in ("cubic", "mitchell"):
        b, c = (0, 0.5) if name == "cubic" else (1 / 3, 1 / 3)
        if d < 1:
            return ((12 - 9 * b - 6 * c) * d**3 + (-18 + 12 * b + 6 * c) * d**2 + 6 - 2 * b) / 6
        return ((-b - 6 * c) * d**3 + (6 * b + 30 * c) * d**2 + (-12 * b - 48 * c) * d + 8 * b + 24 * c) / 6 if d < 2 else 0
    n = int(name[-1])
    return np.sinc(d) * np.sinc(d / n) if d < n else 0


def matrix(name, src, dst):
    scale = src / dst
    wide = max(scale, 1)
    w = np.array([[kernel_1d(name, (k + 0.5 - (o + 0.5) * scale) / wide) for k in range(src)] for o in range(dst)])
    return w / w.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("kernel", ["cubic", "mitchell", "lanczos2", "lanczos3"])
@pytest.mark.parametrize("size", [(7, 5), (19, 23)])
def test_kernels_equal_matrices(spark, kernel, size):
    rng = np.random.default_rng(11)
    raster = rng.integers(0, 256, (13, 17, 4))
    raster[..., 3] = np.where(rng.random((13, 17)) < 0.3, 0, raster[..., 3])
    pixels, images = table(spark, {1: raster})
    w, h = size
    out = resample.resize_to(pixels, images.selectExpr("*", f"{w} AS out_w", f"{h} AS out_h"), kernel)
    a = raster[..., 3].astype(float)
    down, across = matrix(kernel, 13, h), matrix(kernel, 17, w)
    alpha_ = down @ a @ across.T
    for k, c in enumerate("rgb"):
        mixed = down @ (raster[..., k] * a) @ across.T
        want = np.where(alpha_ > 0, mixed / np.where(alpha_ > 0, alpha_, 1), 0)
        assert np.abs(np.array(back(out, (h, w), c)) - np.clip(np.floor(want + 0.5), 0, 255)).max() <= 1
    assert np.abs(np.array(back(out, (h, w))) - np.clip(np.floor(alpha_ + 0.5), 0, 255)).max() <= 1


def blurred(a, sigma):
    k = int(np.ceil(3 * sigma))
    w = np.exp(-(np.arange(-k, k + 1) ** 2) / (2 * sigma**2))
    same = lambda v: np.convolve(v, w)[k : k + len(v)]
    for axis in (1, 0):
        one = np.apply_along_axis(same, axis, np.ones_like(a, float))
        a = np.floor(np.apply_along_axis(same, axis, a.astype(float)) / one + 0.5)
    return a


@pytest.mark.parametrize("sigma", [0.5, 1.3, 9])
def test_gaussian_equals_convolution(spark, monkeypatch, sigma):
    monkeypatch.setattr(tiles, "BAND", 5)
    a = np.random.default_rng(3).integers(0, 256, (12, 15))
    pixels, _ = table(spark, {1: alpha(a)})
    assert np.abs(np.array(back(geometry.gaussian(pixels.select("image_id", "y", "x", "a"), sigma), (12, 15))) - blurred(a, sigma)).max() <= 1


def test_blurred_shadow_equals_numpy(spark):
    a = np.zeros((9, 9), int)
    a[3:6, 2:7] = 255
    pixels, images = table(spark, {1: alpha(a)})
    out = geometry.shadow(pixels, images, blur=1, offset=(2, 1), color="#ff0000", opacity=0.5)
    cast = blurred(np.floor(np.pad(a, 3) * 0.5 + 0.5), 1)
    canvas = np.zeros((3 + 9 + 1 + 2, 3 + 9 + 2 + 2))
    canvas = np.zeros((max(9 + 2, 1 - 3 + 15) + 2, max(9, 2 - 3 + 15) + 1))
    canvas[0 : cast.shape[0], 0 : cast.shape[1]] = cast
    subject = np.zeros_like(canvas)
    subject[2 : 2 + 9, 1 : 1 + 9] = a
    t, u = subject / 255, canvas / 255
    want = np.floor((t + u * (1 - t)) * 255 + 0.5)
    assert np.abs(np.array(back(out, canvas.shape)) - want).max() <= 1


def test_images_of_different_sizes_are_an_error(spark):
    pixels, images = table(spark, {1: alpha([[1, 2, 3]])})
    mask, sizes = table(spark, {1: alpha([[1, 2]])})
    for call in (lambda: compose.compose(pixels, mask), lambda: compose.combine("union", mask, pixels), lambda: compose.compose(pixels, pixels, mask)):
        with pytest.raises(Exception, match="different sizes"):
            call().collect()
    assert tuple(compose.same_size(images, sizes).first())[1:] == (3, 1, 2, 1)


def test_components_of_many_nominally_large_images(spark):
    rows = spark.range(0, 200, 1, 200)
    pixels = rows.selectExpr("id AS image_id", "0 AS y", "0 AS x", "0 AS r", "0 AS g", "0 AS b", "9 AS a")
    images = rows.selectExpr("id AS image_id", "8192 AS width", "8192 AS height")
    got = connected(pixels, images).collect()
    assert len(got) == 200 and {r["label"] for r in got} == {0}


def test_layers(spark):
    base, images = table(spark, {1: np.zeros((4, 6, 4), int) + [10, 20, 30, 255], 2: np.zeros((4, 6, 4), int) + [10, 20, 30, 0]})
    top, _ = table(spark, {7: np.zeros((3, 3, 4), int) + [200, 100, 50, 128]})
    pairs = images.selectExpr("image_id AS base_id", "7L AS top_id", "width AS base_w", "height AS base_h", "3 AS top_w", "3 AS top_h")
    out, plan = layers.layer(base, top, pairs, "northeast", 0.5)
    assert {(r["out_w"], r["out_h"], r["dest_x"], r["dest_y"]) for r in plan.collect()} == {(2, 2, 4, 0)}
    rows = {(r["image_id"], r["y"], r["x"]): tuple(r)[3:] for r in out.collect()}
    t = 128 / 255
    assert rows[1, 0, 5] == (*(int(v * t + u * (1 - t) + 0.5) for v, u in ((200, 10), (100, 20), (50, 30))), 255)
    assert rows[2, 0, 5] == (200, 100, 50, 128) and rows[1, 2, 5] == rows[1, 0, 3] == (10, 20, 30, 255) and rows[2, 3, 0][3] == 0
    for bad in ({"scale": 0.01}, {"top_offset": (6, 0)}, {"top_offset": (0, -3)}):
        with pytest.raises(ValueError, match="top 7 on base 1"):
            layers.layer(base, top, pairs, **bad)


def test_tops_are_laid_in_their_order(spark):
    rng = np.random.default_rng(4)
    arrays = {k: rng.integers(0, 256, (4, 5, 4)) for k in range(6)}
    arrays[1][..., 3] = 0
    rows = [(k, y, x, *map(int, v[y, x])) for k, v in arrays.items() for y in range(4) for x in range(5)]
    pixels = spark.createDataFrame(rows, "image_id int, y int, x int, r int, g int, b int, a int")
    # base 0 under 3, 4 and 4 again, base 1 (without alpha) under 5 and 3, base 2 under none
    pairs = spark.createDataFrame([(0, 4, 7), (0, 3, 1), (0, 4, 7), (1, 3, 2), (1, 5, None)], "base_id int, top_id int, position int")
    pairs = pairs.select("*", *(F.lit(n).alias(c) for c, n in (("base_w", 5), ("base_h", 4), ("top_w", 5), ("top_h", 4))))
    got = layers.layer(pixels.where("image_id < 3"), pixels, pairs, top_offset=(1, -1))[0].collect()
    want = {}
    for k, tops in ((0, (3, 4, 4)), (1, (5, 3)), (2, ())):
        below = arrays[k].astype(float)
        for top in tops or (None,):
            above = np.zeros((4, 5, 4))
            if top is not None:
                above[:3, 1:] = arrays[top][1:, :4]
            t, u = above[..., 3:] / 255, below[..., 3:] / 255
            alpha = t + u * (1 - t)
            colour = np.where(alpha > 0, np.floor((above[..., :3] * t + below[..., :3] * u * (1 - t)) / np.where(alpha > 0, alpha, 1) + 0.5), 0)
            below = np.concatenate((colour, np.floor(alpha * 255 + 0.5)), axis=2)
        want |= {(k, y, x): tuple(map(int, below[y, x])) for y in range(4) for x in range(5)}
    assert len(got) == 60 and {tuple(r)[:3]: tuple(r)[3:] for r in got} == want


def test_what_lies_below(spark):
    pixels, _ = table(spark, {1: alpha([[1]])})
    assert compose.over_spec("transparent") == ("transparent", None) and compose.over_spec("#0a0B0c") == ("color", (10, 11, 12))
    assert compose.over_spec(pixels)[0] == "image"
    for bad in ("0a0b0c", "red", "#12345"):
        with pytest.raises(ValueError):
            compose.over_spec(bad)


@pytest.mark.parametrize("gravity, want", [("center", (2, 1)), ("north", (2, 0)), ("southeast", (3, 2)), ("west", (0, 1)), ("northwest", (0, 0)), ("south", (2, 2))])
def test_gravities(spark, gravity, want):
    row = spark.range(1).select(*geometry.anchor(F.lit(gravity), F.lit(8), F.lit(6), F.lit(5), F.lit(4))).first()
    assert tuple(row) == want  # 1.5 is rounded up


def test_mirrored_padding_of_a_narrow_image(spark):
    pixels, images = table(spark, {1: alpha([[1, 2, 3]])})
    out, sizes = geometry.pad_to_multiple(pixels, images, 8)
    assert tuple(sizes.first()) == (1, 8, 8)
    assert back(out, (8, 8)) == [[1, 2, 3, 3, 2, 1, 1, 2]] * 8
    tiles = geometry.plan_tiles(images, 16, 4)
    seen = resample.map_tiles(pixels, tiles, lambda t: t if t.shape == (8, 8, 3) else t[:0], 1, 16, 4, 8)
    assert seen.count() == 3


def test_gradient_plates(spark):
    plates = spark.createDataFrame([(1, 20, 1.0, 0.0, "#000000", "#ffffff", 90, "rect"), (2, 20, 0.5, 0.5, "#ff0000", "#ff0000", 0, "rect"), (3, 20, 0.5, 0.5, "#ff0000", "#ff0000", 0, "squircle"), (4, 20, 1.0, 0.0, "#000000", "#ffffff", 0, "rect")], "image_id long, size int, content double, radius double, from_color string, to_color string, angle int, shape string")
    rows = {(r["image_id"], r["y"], r["x"]): r for r in layers.gradient_plates(plates).collect()}
    assert [rows[1, 7, x]["r"] for x in (0, 10, 19)] == [int(255 * (x + 0.5) / 20 + 0.5) for x in (0, 10, 19)] and rows[1, 0, 0]["a"] == 255
    assert [rows[4, y, 3]["r"] for y in (0, 19)] == [int(255 * (19 - y + 0.5) / 20 + 0.5) for y in (0, 19)]
    area = {k: sum(rows[k, y, x]["a"] for y in range(20) for x in range(20)) / 255 for k in (2, 3)}
    assert abs(area[2] - np.pi * 25) < 1.5 and area[2] + 5 < area[3] < 100 and rows[2, 0, 0]["a"] == 0


def test_sheet_cells_hold_whole_images(spark):
    pixels, images = table(spark, {1: np.zeros((4, 8, 4), int) + [9, 9, 9, 255], 2: np.zeros((8, 4, 4), int) + [9, 9, 9, 255]})
    sheets = spark.createDataFrame([(5, 0, 1, True), (5, 1, 2, True), (5, 2, 3, False)], "sheet_id long, pos int, image_id long, readable boolean")
    out, report = layers.contact_sheet(pixels, images, sheets, cell=4, gap=1)
    assert back(out, (6, 11)) == [[0] * 11, [0] * 7 + [255, 255, 0, 0], [0, *[255] * 4, 0, 0, 255, 255, 0, 0], [0, *[255] * 4, 0, 0, 255, 255, 0, 0], [0] * 7 + [255, 255, 0, 0], [0] * 11]
    assert (report.first()["placed"], report.first()["skipped"]) == (2, [3])


def test_pixels_of_wide_and_empty_images(spark):
    wide = bytes(range(256)) * 1000
    rows = [("w", 64_000, 1, 4, wide), ("h", 1, 85_000, 3, wide[:255_000]), ("g", 256, 1000, 1, wide), ("none", 0, 0, 3, b"")]
    images = spark.createDataFrame(rows, "image_id string, width int, height int, nChannels int, data binary")
    got = files.explode_pixels(images)
    assert {r["image_id"]: r["count"] for r in got.groupBy("image_id").count().collect()} == {"w": 64_000, "h": 85_000, "g": 256_000}
    picked = got.where("(image_id = 'w' and x = 63999) or (image_id = 'h' and y = 84999) or (image_id = 'g' and y = 999 and x = 7)").orderBy("image_id").collect()
    assert [tuple(r) for r in picked] == [("g", 999, 7, 7, 7, 7, 255), ("h", 84999, 0, *(wide[254_999 - k] for k in range(3)), 255), ("w", 0, 63999, 254, 253, 252, 255)]

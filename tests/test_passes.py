"""Steps on pixels: few Python passes, and the same results however parts are cut."""

import numpy as np
import pytest

from __spark_entry__ import queries
from tessera.operators import compose, geometry, resample, tiles
from tessera.plans import fixtures
from tessera.sources import files

from tests.test_rasters import back, matrix, table

BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_of_pixels_are_counted_and_others_measured(spark, sf):
    queries()["mask_dilate"](spark, sf)
    assert spark.conf.get(BYTES) == "2147483647b" and int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2048
    queries()["verdicts"](spark, sf)
    assert spark.conf.get(BYTES, None) is None


@pytest.mark.parametrize(("name", "most"), [("mask_dilate", 2), ("mask_feather", 2), ("key_check", 2), ("key_check_heatmap", 2), ("size_pyramid_nearest", 2), ("resize_lanczos", 2), ("tiles_mapped", 2), ("upscale_nearest", 7), ("contact_sheet_lanczos", 5), ("drop_shadow", 15), ("layer_stack", 7)])
def test_pixels_go_through_few_python_tasks(spark, sf, name, most):
    plan = queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("MapInArrow") <= most


def rasters(seed, *sizes):
    rng = np.random.default_rng(seed)
    return {k: rng.integers(0, 256, (*size, 4)) for k, size in enumerate(sizes)}


@pytest.mark.parametrize("reach", [0, 64])
def test_dilation_and_blur_over_tiles_and_bands(spark, monkeypatch, reach):
    monkeypatch.setattr(tiles, "REACH", reach)
    monkeypatch.setattr(tiles, "TILE", 5)
    monkeypatch.setattr(tiles, "BAND", 3)
    made = rasters(1, (11, 17), (1, 30), (16, 3), (1, 1))
    masks = table(spark, made)[0].select("image_id", "y", "x", "a")
    weights = np.array(geometry.gaussian_weights(1.3), float)
    k = len(weights) // 2
    same = lambda v: np.convolve(v, weights)[k : k + len(v)]
    wide, soft = compose.dilate(masks, 2), geometry.gaussian(masks, 1.3)
    for i, v in made.items():
        a = v[..., 3]
        want = [[int(a[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3].max()) for x in range(a.shape[1])] for y in range(a.shape[0])]
        assert back(wide.where(f"image_id = {i}"), a.shape) == want
        for axis in (1, 0):
            a = np.floor(np.apply_along_axis(same, axis, a.astype(float)) / np.apply_along_axis(same, axis, np.ones(a.shape)) + 0.5)
        assert back(soft.where(f"image_id = {i}"), a.shape) == a.tolist()


def test_resizing_in_bands_equals_whole_images_and_gaps_stay(spark, monkeypatch):
    made = rasters(2, (9, 14), (4, 3))
    pixels, images = table(spark, made)
    pixels = pixels.where("image_id = 0 or (y < 1 and x < 1)")
    jobs = images.selectExpr("*", "7 AS out_w", "5 AS out_h", "'a' AS job").union(images.selectExpr("*", "20 AS out_w", "23 AS out_h", "'b' AS job"))
    plain = lambda df: sorted(tuple(r) for r in df.collect())
    whole = plain(resample.resized(pixels, jobs, "cubic"))
    monkeypatch.setattr(resample, "AT_ONCE", 1)
    monkeypatch.setattr(resample, "BAND", 4)
    assert plain(resample.resized(pixels, jobs, "cubic")) == whole
    big = [r for r in whole if r[0] == 0]
    assert len(big) == 7 * 5 + 20 * 23
    # a lone pixel gives to the outputs whose windows reach it
    across, down = matrix("cubic", 3, 20) != 0, matrix("cubic", 4, 23) != 0
    assert {r[1:3] for r in whole if r[0] == 1 and r[-1] == "b"} >= {(y, x) for y in np.flatnonzero(down[:, 0]).tolist() for x in np.flatnonzero(across[:, 0]).tolist()}
    a = made[0][..., 3].astype(float)
    want = np.clip(np.floor(matrix("cubic", 9, 23) @ a @ matrix("cubic", 14, 20).T + 0.5), 0, 255)
    got = np.zeros((23, 20))
    for r in big:
        if r[-1] == "b":
            got[r[1], r[2]] = r[6]
    assert np.abs(got - want).max() <= 1


def test_layers_are_laid_one_after_another(spark):
    made = rasters(3, (6, 7), (5, 5), (3, 4))
    pixels, _ = table(spark, made)
    order = [(0, 2, 2, 1), (0, 1, 5, -2), (0, 1, 7, 1)]  # base, top, position, shift
    plan = spark.createDataFrame([(b, t, p, d, d + 1, "ok") for b, t, p, d in order], "base_id long, top_id long, position int, dest_y int, dest_x int, status string")
    out = geometry.source_over(pixels, pixels, plan)
    want = made[0].astype(float)
    for k, (_, top, _, d) in enumerate(order):
        over = np.zeros_like(want)
        for y in range(made[top].shape[0]):
            for x in range(made[top].shape[1]):
                if 0 <= y + d < 6 and 0 <= x + d + 1 < 7:
                    over[y + d, x + d + 1] = made[top][y, x]
        there = np.zeros(want.shape[:2], bool)
        h, w = made[top].shape[:2]
        there[max(0, d) : h + d, max(0, d + 1) : w + d + 1] = True
        t, u = over[..., 3:] / 255, want[..., 3:] / 255
        alpha = t + u * (1 - t)
        colour = np.where(alpha > 0, np.floor((over[..., :3] * t + want[..., :3] * u * (1 - t)) / np.where(alpha > 0, alpha, 1) + 0.5), 0)
        want = np.where(there[..., None] | (k == 0), np.dstack([colour, np.floor(alpha * 255 + 0.5)]), want)
    for k, c in enumerate("rgba"):
        assert back(out.where("image_id = 0"), (6, 7), c) == want[..., k].tolist()


@pytest.mark.parametrize("multiple", [1, 8, 50])
def test_padding_mirrors_again_and_again(spark, multiple):
    made = rasters(4, (3, 5), (8, 1))
    pixels, images = table(spark, made)
    out, sizes = geometry.pad_to_multiple(pixels, images, multiple)
    for r in sizes.collect():
        v = made[r["image_id"]]
        want = np.pad(v, ((0, r["height"] - v.shape[0]), (0, r["width"] - v.shape[1]), (0, 0)), "symmetric")
        for k, c in enumerate("rgba"):
            assert back(out.where(f"image_id = {r['image_id']}"), want.shape[:2], c) == want[..., k].tolist()


@pytest.mark.parametrize("name", ["files_listed", "images_written_and_read"])
def test_many_files_are_read_folder_by_folder(spark, sf, monkeypatch, name):
    seen, load = [], files.read_images

    def read(spark, path):
        good, bad = load(spark, path)
        seen.append(len(set(good.inputFiles())))
        return good, bad

    monkeypatch.setattr(fixtures, "FOLDER_FILES", 60)
    monkeypatch.setattr(files, "read_images", read)
    out = queries()[name](spark, sf)
    assert len(seen) == 4 and sum(seen) == 200 and not any(f.endswith(".png") for f in out.inputFiles())
    assert out.count() == (200 if name == "files_listed" else 196)
    if name == "files_listed":
        assert out.where("readable = (p_partkey % 50 <> 7) and short = (p_partkey % 50 = 7)").count() == 200

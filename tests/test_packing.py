"""Rows that travel packed equal plain joins."""

import random

from tessera.operators import compose, geometry, packing
from tessera.plans.fixtures import images, pixels


def rows(spark, seed, name):
    draw = random.Random(seed)
    spots = [(k, y, x) for k in ("one", "two", "three") for y in range(-3, 9) for x in range(11)]
    values = [(*s, draw.choice([None, 3, 255, -7, 1 << 40]), draw.random() < 0.5) for s in draw.sample(spots, 250)]
    return spark.createDataFrame(values, f"image_id string, y int, x int, {name} long, {name}_flag boolean")


def plain(df):
    return sorted(map(repr, df.collect()))


def test_matched_equals_a_join(spark, monkeypatch):
    monkeypatch.setattr(packing, "AT_ONCE", 40)
    a, b = rows(spark, 1, "p"), rows(spark, 2, "q")
    assert plain(packing.matched(a, b, 4)) == plain(a.join(b, ["image_id", "y", "x"], "left"))
    stacks = {(r["image_id"], r["y"], r["x"]): r["stack"] for r in packing.matched(a, b.union(b), 4, "stack").collect()}
    want = {(r["image_id"], r["y"], r["x"]): (r["q"], r["q_flag"]) for r in b.collect()}
    assert len(stacks) == 250
    for at, stack in stacks.items():
        assert (stack is None) == (at not in want) and all((s["q"], s["q_flag"]) == want[at] for s in stack or []) and len(stack or [1, 1]) == 2


def test_attached_equals_a_join(spark, monkeypatch):
    monkeypatch.setattr(packing, "AT_ONCE", 40)
    a = rows(spark, 3, "p")
    table = spark.createDataFrame([("one", 1), ("one", 2), ("three", None), ("four", 4)], "image_id string, n int")
    assert plain(packing.attached(a, table, ["image_id"])) == plain(a.join(table, "image_id"))


def test_no_pixels_are_broadcast_and_the_source_is_dealt(spark, sf):
    px, sizes = pixels(spark, sf), images(spark, sf)
    assert px.rdd.getNumPartitions() > 1  # the file is one task's
    few = geometry.filled(px.select("image_id", "y", "x"), px)
    tiles = geometry.plan_tiles(sizes, 16, 4)
    for df in (few, compose.aligned(px, px.selectExpr("image_id", "y", "x", "a as m")), geometry.tile_pixels(px, tiles, 16, 4)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()

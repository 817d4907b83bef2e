import numpy as np

from tessera.llm import embed_dup

SCHEMA = "vec_id long, embedding array<float>, label int, node long, cell int, a string"


def found(spark, rows):
    frame = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, 1, 2, "x") for i, v, label in rows], SCHEMA)
    return embed_dup.near_vectors(frame.repartition(5)).collect()


def near(draw, x, cosine):
    """A vector at this cosine to x."""
    y = draw.standard_normal(len(x))
    y -= (y @ x) / (x @ x) * x
    return cosine * x / np.linalg.norm(x) + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y)


def brute_force(rows):
    """Links of each row, and the smallest vec_id that it reaches by links or an equal vec_id."""
    x = np.array([v for _, v, _ in rows], np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([n for *_, n in rows])
    link = (x @ x.T >= embed_dup.COSINE) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    ids = np.array([i for i, *_ in rows])
    join, least = link | (ids[:, None] == ids[None, :]), ids.copy()
    while True:
        now = np.array([least[row].min() for row in join])
        if (now == least).all():
            return link.sum(axis=1), least
        least = now


def test_planted_pairs_at_the_threshold_are_found(spark):
    draw = np.random.default_rng(5)
    rows, planted = [], 0
    for k in range(900):
        x = draw.standard_normal(64)
        rows.append((3 * k, x, k % 3))
        if k % 2:
            rows.append((3 * k + 1, near(draw, x, 0.9301 + 0.01 * (k % 5 == 0)), k % 3))
            planted += 1
        if k % 9 == 0:
            rows += [(3 * k + 2, near(draw, x, 0.9295), k % 3), (9000 + k, 7.5 * x, k % 3), (20000 + k, x, (k + 1) % 3)]
    links, least = brute_force(rows)
    got = {r["vec_id"]: r for r in found(spark, rows)}
    have = sum(got[i]["n_links"] for i, *_ in rows)
    assert have <= links.sum() and have >= 0.99 * links.sum() > 0.99 * 2 * planted
    wrong = sum(got[i]["component_id"] != c or got[i]["n_links"] != n for (i, *_), c, n in zip(rows, least, links, strict=True))
    assert wrong <= 0.02 * len(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_one_id_for_several_vectors(spark):
    draw = np.random.default_rng(6)
    a, b = draw.standard_normal(16), draw.standard_normal(16)
    rows = [(1, a, 0), (1, b, 0), (2, a, 0), (3, near(draw, a, 0.99), 0), (4, near(draw, b, 0.995), 0), (5, near(draw, b, 0.995), 0), (6, draw.standard_normal(16), 0), (6, b, 1)]
    links, least = brute_force(rows)
    want = sorted((i, int(n), int(c), i == c) for (i, *_), n, c in zip(rows, links, least, strict=True))
    assert want[2] == (2, 2, 1, False)
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in found(spark, rows)) == want


def test_unsound_vectors_link_with_nothing(spark):
    one, inf, nan = [1.0, 2.0], [float("inf"), 1.0], [float("nan"), 1.0]
    rows = [(1, one, 0), (2, one, None), (3, one, None), (4, None, 0), (5, [], 0), (6, [0.0, 0.0], 0), (7, inf, 0), (8, inf, 0), (9, nan, 0), (10, [None, 1.0], 0), (None, one, 0), (11, [1.0, 2.0, 0.0], 0), (12, one, 0), (12, one, 0)]
    got = sorted(((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in found(spark, rows)))
    alone = [(i, 0, i, True) for i in (2, 3, 4, 5, 6, 7, 8, 9, 10, 11)]
    assert got == sorted([(-1, 0, None, True), (1, 2, 1, True), *alone, (12, 2, 1, False), (12, 2, 1, False)], key=lambda r: (r[0], r[1]))
    assert found(spark, []) == []


def test_a_large_group_counts_all_its_links(spark):
    draw = np.random.default_rng(8)
    centre = draw.standard_normal(32)
    rows = [(k, near(draw, centre, 0.9995), 4) for k in range(1500)] + [(5000 + k, centre, 4) for k in range(300)]
    got = found(spark, rows)
    assert all(r["component_id"] == 0 and r["n_links"] == 1799 for r in got)

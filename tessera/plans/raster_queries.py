"""Queries on rasters: each operator over an image of every part, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.color import hsv, linear_table
from tessera.operators import components, compose, geometry, layers, measure, resample
from tessera.plans.fixtures import PIXELS_SQL, digest, digest_sql, images, matte, pixels, png_files, table
from tessera.plans.staging import counted_batches, new_path, staged
from tessera.sources import files

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        def run(spark, sf_dir):
            counted_batches(spark)
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def with_pixels(*ctes: str, then: str) -> str:
    return "WITH " + ",\n".join((PIXELS_SQL, *ctes)) + "\n" + then


def byte_sql(c: str) -> str:
    return f"(CASE WHEN {c} <= 0 THEN 0 WHEN {c} >= 1 THEN 255 ELSE CAST(floor((CASE WHEN {c} <= 0.0031308 THEN {c} * 12.92 ELSE 1.055 * pow({c}, 1 / 2.4) - 0.055 END) * 255 + 0.5) AS INTEGER) END)"


LUT_SQL = f"lut AS (SELECT {linear_table()}::DOUBLE[] AS l)"
BORDER_SQL = """border AS (SELECT image_id, {m}
  FROM {{source}}, lut WHERE y < 4 OR y >= 28 OR x < 4 OR x >= 28 GROUP BY image_id),
named AS (SELECT *, {r} AS kr, {g} AS kg, {b} AS kb FROM border)""".format(
    m=", ".join(f"sum(CAST(l[{c} + 1] * 34359738368 AS BIGINT))::DOUBLE / count(*) / 34359738368 AS l{c}" for c in "rgb"), r=byte_sql("lr"), g=byte_sql("lg"), b=byte_sql("lb")
)


def topology_sql(name: str, source: str, r: str, g: str, b: str) -> str:
    return f"""{name}_v AS (SELECT *, greatest({r}, {g}, {b}) AS hi, least({r}, {g}, {b}) AS lo, {r} + {g} + {b} - greatest({r}, {g}, {b}) - least({r}, {g}, {b}) AS mid FROM {source}),
{name}_k AS (SELECT *, CASE WHEN hi < 0.05 THEN NULL WHEN hi - mid >= mid - lo AND hi - mid >= 0.05 THEN 'primary' WHEN mid - lo > hi - mid AND mid - lo >= 0.05 THEN 'secondary' END AS kind FROM {name}_v),
{name} AS (SELECT *, CASE kind WHEN 'primary' THEN (CASE hi WHEN {r} THEN 0 WHEN {g} THEN 1 ELSE 2 END) WHEN 'secondary' THEN (CASE lo WHEN {r} THEN 0 WHEN {g} THEN 1 ELSE 2 END) END AS channel,
  CASE kind WHEN 'primary' THEN hi WHEN 'secondary' THEN mid - lo END AS strength FROM {name}_k)"""


def keys_sql(source: str = "px") -> str:
    return ",\n".join((
        LUT_SQL, BORDER_SQL.format(source=source),
        topology_sql("own", "(SELECT image_id, kr, kg, kb, l[kr + 1] AS lr, l[kg + 1] AS lg, l[kb + 1] AS lb FROM named, lut)", "lr", "lg", "lb"),
        topology_sql("edge", "border", "lr", "lg", "lb"),
        """keyed AS (SELECT own.image_id, format('#{:02x}{:02x}{:02x}', kr, kg, kb) AS key, own.kind, own.channel,
  CASE WHEN own.kind = edge.kind AND own.channel = edge.channel THEN edge.strength ELSE own.strength END AS strength FROM own JOIN edge USING (image_id))""",
    ))


KEYS_SQL = keys_sql()


def _pick(shift: int) -> str:
    return f"(CASE (channel + {shift}) % 3 WHEN 0 THEN l[r + 1] WHEN 1 THEN l[g + 1] ELSE l[b + 1] END)"


def mask_sql(source: str = "px") -> str:
    return keys_sql(source) + f""",
spilled AS (SELECT p.image_id, y, x, kind, strength, CASE WHEN kind = 'primary' THEN {_pick(0)} - greatest({_pick(1)}, {_pick(2)}) ELSE least({_pick(1)}, {_pick(2)}) - {_pick(0)} END AS spill
  FROM {source} p JOIN keyed USING (image_id), lut),
mask AS (SELECT image_id, y, x, CASE WHEN kind IS NULL OR spill <= 0 THEN 255 WHEN (spill / strength) * CAST({1 / 0.82!r} AS DOUBLE) >= 1 THEN 0
  ELSE CAST(floor((1 - (spill / strength) * CAST({1 / 0.82!r} AS DOUBLE)) * 255 + 0.5) AS INTEGER) END AS a FROM spilled)"""


MASK_SQL = mask_sql()


def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.chroma_mask(pixels(spark, sf_dir), images(spark, sf_dir))[0]


@query(with_pixels(KEYS_SQL, then="SELECT image_id, key, 'auto' AS key_source, kind, CAST(channel AS INTEGER) AS channel, round(strength, 6) AS strength FROM keyed"))
def border_key(spark, sf_dir):
    return measure.keys_of(pixels(spark, sf_dir), images(spark, sf_dir)).withColumn("strength", F.round("strength", 6))


@query(with_pixels(MASK_SQL, then="""SELECT image_id, CAST(count(*) FILTER (a < 128) AS BIGINT) AS removed_pixels, round(count(*) FILTER (a < 128) / count(*), 6) AS removed_fraction,
  any_value(key) AS key, 'auto' AS key_source FROM mask JOIN keyed USING (image_id) GROUP BY image_id"""))
def chroma_mask_stats(spark, sf_dir):
    stats = compose.chroma_mask(pixels(spark, sf_dir), images(spark, sf_dir))[1]
    return stats.withColumn("removed_fraction", F.round("removed_fraction", 6))


@query(with_pixels(MASK_SQL, "done AS (SELECT image_id, y, x, " + ", ".join(f"CASE WHEN mask.a > 0 THEN {c} ELSE 0 END AS {c}" for c in "rgb") + ", mask.a FROM px JOIN mask USING (image_id, y, x))", then=digest_sql("done")))
def chroma_cutout(spark, sf_dir):
    return digest(compose.compose(pixels(spark, sf_dir), _mask(spark, sf_dir)))


def _over_sql(under: tuple[str, str, str]) -> str:
    mixed = ", ".join(f"CAST(floor(px.{c} * (m.a / 255) + {u} * (1 - m.a / 255) + 0.5) AS INTEGER) AS {c}" for c, u in zip("rgb", under, strict=True))
    return f"done AS (SELECT px.image_id, px.y, px.x, {mixed}, 255 AS a FROM px JOIN cut m USING (image_id, y, x))"


@query(with_pixels(_over_sql(("18", "52", "86")), then=digest_sql("done")))
def compose_over_color(spark, sf_dir):
    return digest(compose.compose(pixels(spark, sf_dir), pixels(spark, sf_dir, True), "#123456"))


@query(with_pixels(_over_sql(("px.b", "px.r", "px.g")), then=digest_sql("done")))
def compose_over_image(spark, sf_dir):
    below = pixels(spark, sf_dir).select("image_id", "y", "x", F.col("b").alias("r"), F.col("r").alias("g"), F.col("g").alias("b"))
    return digest(compose.compose(pixels(spark, sf_dir), pixels(spark, sf_dir, True), below))


@query(with_pixels(LUT_SQL, f"""clean AS (SELECT px.image_id, px.y, px.x, {byte_sql('l[px.r + 1]')} AS r, {byte_sql('CASE WHEN m.a > 0 THEN least(l[px.g + 1], greatest(l[px.r + 1], l[px.b + 1])) ELSE l[px.g + 1] END')} AS g,
  {byte_sql('l[px.b + 1]')} AS b, m.a FROM px JOIN cut m USING (image_id, y, x), lut)""", "done AS (SELECT image_id, y, x, CASE WHEN a > 0 THEN r ELSE 0 END AS r, CASE WHEN a > 0 THEN g ELSE 0 END AS g, CASE WHEN a > 0 THEN b ELSE 0 END AS b, a FROM clean)", then=digest_sql("done")))
def bleed_removal(spark, sf_dir):
    return digest(compose.compose(pixels(spark, sf_dir), pixels(spark, sf_dir, True), "transparent", "#00ff00"))


@query(with_pixels(MASK_SQL, "done AS (SELECT image_id, y, x, greatest(mask.a, cut.a) AS u, least(mask.a, cut.a) AS i, greatest(mask.a - cut.a, 0) AS s, 255 - mask.a AS v FROM mask JOIN cut USING (image_id, y, x))", then=digest_sql("done", "uisv")))
def mask_algebra(spark, sf_dir):
    mask, other = staged(_mask(spark, sf_dir), "mask"), pixels(spark, sf_dir, True)
    out = None
    for name, df in (("u", compose.combine("union", mask, other)), ("i", compose.combine("intersect", mask, other)), ("s", compose.combine("subtract", mask, other)), ("v", compose.combine("invert", mask))):
        sums = digest(df, "a").withColumnRenamed("a_sum", f"{name}_sum")
        out = sums if out is None else out.join(sums.drop("pixels"), "image_id")
    return out


def _box(rows: str, n: int) -> str:
    return f"w{n}a AS (SELECT image_id, y, x, CAST(floor(avg(a) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) + 0.5) AS INTEGER) AS a FROM {rows}), w{n} AS (SELECT image_id, y, x, CAST(floor(avg(a) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) + 0.5) AS INTEGER) AS a FROM w{n}a)"


@query(with_pixels(_box("cut", 1), _box("w1", 2), then=digest_sql("w2", "a")))
def mask_feather(spark, sf_dir):
    return digest(compose.combine("feather", pixels(spark, sf_dir, True), radius=2), "a")


@query(with_pixels("h AS (SELECT image_id, y, x, max(a) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS a FROM cut)", "v AS (SELECT image_id, y, x, max(a) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS a FROM h)", then=digest_sql("v", "a")))
def mask_dilate(spark, sf_dir):
    return digest(compose.dilate(pixels(spark, sf_dir, True).select("image_id", "y", "x", "a"), 2), "a")


@query("""WITH m AS (SELECT vec_id AS image_id, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x, embedding[i] AS v FROM embeddings, range(1, 65) AS t(i)),
a AS (SELECT image_id, y, x, CAST(least(255, greatest(0, floor((CAST(v AS DOUBLE) + 0.25) * 512))) AS INTEGER) AS a FROM m WHERE v IS NOT NULL),
done AS (SELECT image_id, y, x, CASE WHEN a > 0 AND a < 40 THEN 0 ELSE a END AS a, a > 0 AND a < 40 AS faint FROM a)
SELECT image_id, count(*) AS pixels, CAST(sum(a * (y * 64 + x + 1)) AS BIGINT) AS a_sum, CAST(count(*) FILTER (faint) AS BIGINT) AS floored_pixels FROM done GROUP BY image_id""")
def alpha_floor(spark, sf_dir):
    out, counts = compose.alpha_floor(matte(spark, sf_dir), 40)
    return digest(out, "a").join(counts, "image_id")


BOXES_SQL = "boxes AS (SELECT image_id, min(x) FILTER (a > 0) AS ax0, max(x) FILTER (a > 0) AS ax1, min(y) FILTER (a > 0) AS ay0, max(y) FILTER (a > 0) AS ay1, min(x) FILTER (a >= 128) AS sx0, max(x) FILTER (a >= 128) AS sx1, min(y) FILTER (a >= 128) AS sy0, max(y) FILTER (a >= 128) AS sy1 FROM cut GROUP BY image_id)"


@query(with_pixels(BOXES_SQL, "m AS (SELECT image_id, coalesce(sx0, ax0) AS l, 31 - coalesce(sx1, ax1) AS r, coalesce(sy0, ay0) AS t, 31 - coalesce(sy1, ay1) AS b FROM boxes)",
    then="SELECT image_id, CAST(l AS INTEGER) AS l, CAST(r AS INTEGER) AS r, CAST(t AS INTEGER) AS t, CAST(b AS INTEGER) AS b, l = 0 AS touches_left, CASE WHEN l IS NULL OR (abs(l - r) <= 2 AND abs(t - b) <= 2) THEN 'centered' ELSE 'offset' END AS verdict FROM m"))
def frame_check(spark, sf_dir):
    out = measure.framecheck(pixels(spark, sf_dir, True), images(spark, sf_dir), axes="both")
    m = F.col("margins")
    return out.select("image_id", m.left.alias("l"), m.right.alias("r"), m.top.alias("t"), m.bottom.alias("b"), F.col("edge_contact.left").alias("touches_left"), "verdict")


EDGES_SQL = """edged AS (SELECT *, a > 0 AND (coalesce(lag(a) OVER h = 0, false) OR coalesce(lead(a) OVER h = 0, false) OR coalesce(lag(a) OVER v = 0, false) OR coalesce(lead(a) OVER v = 0, false)) AS edge FROM cut
  WINDOW h AS (PARTITION BY image_id, y ORDER BY x), v AS (PARTITION BY image_id, x ORDER BY y)),
light AS (SELECT *, greatest(r, g, b) AS hi, CAST(greatest(r, g, b) - least(r, g, b) AS DOUBLE) AS d FROM edged),
hued AS (SELECT *, CASE WHEN d = 0 THEN NULL WHEN hi = r THEN (g - b) / d WHEN hi = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END * 60 AS h0 FROM light),
res AS (SELECT *, a > 0 AND coalesce(d / hi >= 0.35 AND hi / 255 >= 0.25 AND abs((CASE WHEN h0 < 0 THEN h0 + 360 ELSE h0 END) - 120) <= 20, false) AS residue FROM hued)"""


@query(with_pixels(EDGES_SQL, "c AS (SELECT image_id, count(*) FILTER (a > 0) AS p, count(*) FILTER (edge) AS e, count(*) FILTER (residue) AS q, count(*) FILTER (residue AND edge) AS eq, min(x) FILTER (residue) AS bx FROM res GROUP BY image_id)",
    then="SELECT image_id, p AS present_pixels, e AS edge_pixels, q AS residue_pixels, eq AS edge_residue_pixels, q - eq AS interior_residue_pixels, coalesce(round(eq / nullif(e, 0), 6), 0.0) AS edge_residue_fraction, CAST(bx AS INTEGER) AS box_x, CASE WHEN coalesce(eq / nullif(e, 0), 0) <= 0.02 AND q - eq <= 0 THEN 'clean' ELSE 'residue' END AS verdict FROM c"))
def key_check(spark, sf_dir):
    keys = images(spark, sf_dir).select("image_id", F.lit("#00ff00").alias("key"))
    out = measure.keycheck(pixels(spark, sf_dir, True), keys)
    return out.select("image_id", "present_pixels", "edge_pixels", "residue_pixels", "edge_residue_pixels", "interior_residue_pixels", F.round("edge_residue_fraction", 6).alias("edge_residue_fraction"), F.col("worst_bbox.x").alias("box_x"), "verdict")


@query(with_pixels(EDGES_SQL, """done AS (SELECT image_id, y, x, CASE WHEN residue THEN 255 WHEN a > 0 THEN 90 ELSE 0 END AS r, CASE WHEN residue AND edge THEN 0 WHEN residue THEN 128 WHEN a > 0 THEN 90 ELSE 0 END AS g,
  CASE WHEN residue THEN 0 WHEN a > 0 THEN 90 ELSE 0 END AS b, CASE WHEN residue THEN 255 WHEN a > 0 THEN 110 ELSE 0 END AS a FROM res)""", then=digest_sql("done")))
def key_check_heatmap(spark, sf_dir):
    keys = images(spark, sf_dir).select("image_id", F.lit("#00ff00").alias("key"))
    return digest(measure.keycheck_heatmap(pixels(spark, sf_dir, True), keys))


@query(with_pixels(EDGES_SQL, then="SELECT r, g, b, round(CASE WHEN h0 < 0 THEN h0 + 360 ELSE h0 END, 6) AS h, round(CASE WHEN hi > 0 THEN d / hi ELSE 0 END, 6) AS s, round(hi / 255, 6) AS v, count(*) AS pixels FROM hued GROUP BY ALL"))
def color_census(spark, sf_dir):
    counts = pixels(spark, sf_dir, True).groupBy("r", "g", "b").agg(F.count(F.lit(1)).alias("pixels"))
    h, s, v = hsv(F.col("r"), F.col("g"), F.col("b"))
    return counts.select("r", "g", "b", F.round(h, 6).alias("h"), F.round(s, 6).alias("s"), F.round(v, 6).alias("v"), "pixels")


TRIM_SQL = BOXES_SQL + """, plan AS (SELECT *, ax1 - ax0 + 1 AS w, ay1 - ay0 + 1 AS h, CAST(floor(0.08 * greatest(ax1 - ax0 + 1, ay1 - ay0 + 1) + 0.5) AS INTEGER) AS m FROM boxes WHERE ax0 IS NOT NULL),
sized AS (SELECT *, m + (greatest(w, h) - w) // 2 AS pl, m + (greatest(w, h) - h) // 2 AS pt, greatest(w, h) + 2 * m AS side FROM plan)"""


@query(with_pixels(TRIM_SQL, """spread AS (SELECT image_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, pl, pt, ax0, ay0, ax1, ay1 FROM sized, range(64) AS ty(y), range(64) AS tx(x) WHERE y < side AND x < side)""",
    "done AS (SELECT s.image_id, s.y, s.x, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b, coalesce(a, 0) AS a FROM spread s LEFT JOIN cut c ON c.image_id = s.image_id AND c.x = s.x - pl + ax0 AND c.y = s.y - pt + ay0 AND c.x BETWEEN ax0 AND ax1 AND c.y BETWEEN ay0 AND ay1)", then=digest_sql("done")))
def trim_square(spark, sf_dir):
    return digest(geometry.trim(pixels(spark, sf_dir, True), square=True)[0])


def runs_sql(source: str, present: str, reach: int) -> str:
    return f"""islands AS (SELECT image_id, y, x, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS isle FROM {source} WHERE {present}),
seg AS (SELECT image_id, y, min(x) AS x0, max(x) AS x1, min(y * 32 + x) AS node FROM islands GROUP BY image_id, y, isle),
half AS (SELECT p.image_id, p.node AS u, q.node AS v FROM seg p JOIN seg q ON p.image_id = q.image_id AND p.y + 1 = q.y AND p.x0 <= q.x1 + {reach} AND q.x0 <= p.x1 + {reach}),
link AS (SELECT * FROM half UNION ALL SELECT image_id, v, u FROM half),
reached AS (SELECT image_id, node, node AS label FROM seg UNION SELECT r.image_id, r.node, l.v FROM reached r JOIN link l ON l.image_id = r.image_id AND l.u = r.label),
labelled AS (SELECT s.image_id, s.y, s.x0, s.x1, n.label FROM seg s JOIN (SELECT image_id, node, min(label) AS label FROM reached GROUP BY ALL) n USING (image_id, node))"""


def recursive(sql: str) -> str:
    return sql.replace("WITH", "WITH RECURSIVE", 1)


@query(recursive(with_pixels(runs_sql("cut", "a >= 5", 1), then="SELECT image_id, CAST(label AS BIGINT) AS label, CAST(sum(x1 - x0 + 1) AS BIGINT) AS area FROM labelled GROUP BY image_id, label")))
def component_sizes(spark, sf_dir):
    found = components.connected(pixels(spark, sf_dir, True), images(spark, sf_dir), 5)
    return found.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("area"))


@query(recursive(with_pixels(runs_sql("cut", "a >= 5", 1), "sizes AS (SELECT image_id, label, sum(x1 - x0 + 1) AS area FROM labelled GROUP BY ALL)", "best AS (SELECT image_id, label FROM sizes QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY area DESC, label) = 1)",
    "kept AS (SELECT image_id, y, x0, x1 FROM labelled JOIN best USING (image_id, label))", "done AS (SELECT c.image_id, c.y, c.x, c.r, c.g, c.b, CASE WHEN k.x0 IS NULL THEN 0 ELSE c.a END AS a FROM cut c LEFT JOIN kept k ON c.image_id = k.image_id AND c.y = k.y AND c.x BETWEEN k.x0 AND k.x1)", then=digest_sql("done"))))
def despeckle_largest(spark, sf_dir):
    return digest(components.despeckle(pixels(spark, sf_dir, True), images(spark, sf_dir), keep="largest")[0])


@query(recursive(with_pixels(runs_sql("cut", "a >= 5", 1), "sizes AS (SELECT image_id, label, sum(x1 - x0 + 1) AS area FROM labelled GROUP BY ALL)",
    "s AS (SELECT image_id, count(*) AS components, count(*) FILTER (area < 4) AS removed_components, CAST(coalesce(sum(area) FILTER (area < 4), 0) AS BIGINT) AS removed_pixels FROM sizes GROUP BY image_id)",
    "f AS (SELECT image_id, count(*) FILTER (a > 0 AND a < 5) AS floored_pixels FROM cut GROUP BY image_id)", then="SELECT f.image_id, floored_pixels, coalesce(components, 0) AS components, coalesce(removed_components, 0) AS removed_components, coalesce(removed_pixels, 0) AS removed_pixels FROM f LEFT JOIN s USING (image_id)")))
def despeckle_report(spark, sf_dir):
    report = components.despeckle(pixels(spark, sf_dir, True), images(spark, sf_dir), min_area=4)[1]
    return report.select("image_id", "floored_pixels", "components", "removed_components", "removed_pixels")


@query(recursive(with_pixels(runs_sql("cut", "a < 128", 0), "holes AS (SELECT image_id, label FROM labelled GROUP BY ALL HAVING NOT bool_or(y = 0 OR y = 31 OR x0 = 0 OR x1 = 31))",
    "hole AS (SELECT image_id, y, x0, x1 FROM labelled JOIN holes USING (image_id, label))", "done AS (SELECT c.image_id, c.y, c.x, CASE WHEN h.x0 IS NULL THEN c.a ELSE 255 END AS a FROM cut c LEFT JOIN hole h ON c.image_id = h.image_id AND c.y = h.y AND c.x BETWEEN h.x0 AND h.x1)", then=digest_sql("done", "a"))))
def preserve_interior(spark, sf_dir):
    return digest(components.preserve_interior(pixels(spark, sf_dir, True), images(spark, sf_dir)), "a")


@query(with_pixels("done AS (SELECT image_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, r, g, b, a FROM range(20) AS ty(y), range(20) AS tx(x), (SELECT image_id, y AS sy, x AS sx, r, g, b, a FROM cut) s WHERE sy = CAST(floor((y + 0.5) * 1.6) AS INTEGER) AND sx = CAST(floor((x + 0.5) * 1.6) AS INTEGER))", then=digest_sql("done")))
def resize_nearest(spark, sf_dir):
    return digest(resample.resize(pixels(spark, sf_dir, True), images(spark, sf_dir), 20, "nearest"))


def resized_sql(name: str, src: int, dst: int) -> str:
    """``cut`` from sides of ``src`` to ``dst`` pixels by the lanczos3 kernel, in whole parts of weights."""
    kernel = "CASE WHEN x = 0 THEN 1.0 ELSE 3 * sin(x) * sin(x / 3) / (x * x) END"
    centre = f"(slot + 0.5) * {src / dst!r}::DOUBLE"
    taps = f"SELECT slot, src, abs((src + 0.5 - {centre}) / {src / dst!r}::DOUBLE) * 3.141592653589793 AS x FROM range({dst}) AS i(slot), range({src}) AS j(src) WHERE abs(src + 0.5 - {centre}) <= {3 * src / dst!r}::DOUBLE"
    sums = lambda scale: ", ".join(f"sum({c} * w) AS {c}" if scale == 1 else f"CAST(floor(CAST(sum({c} * w) AS DOUBLE) / {scale} + 0.5) AS BIGINT) AS {c}" for c in "rgba")
    byte = lambda v: f"CAST(least(255, greatest(0, floor({v} + 0.5))) AS INTEGER)"
    return f"""{name}_w AS (SELECT slot, src, CAST(floor(k / sum(k) OVER (PARTITION BY slot) * {resample.UNIT} + 0.5) AS BIGINT) AS w FROM (SELECT slot, src, {kernel} AS k FROM ({taps}))),
{name}_x AS (SELECT image_id, y, slot AS x, {sums(resample.UNIT // resample.PART)} FROM (SELECT image_id, y, x, CAST(r * a AS BIGINT) AS r, CAST(g * a AS BIGINT) AS g, CAST(b * a AS BIGINT) AS b, CAST(a AS BIGINT) AS a FROM cut) JOIN {name}_w ON src = x GROUP BY image_id, y, slot),
{name}_y AS (SELECT image_id, slot AS y, x, {sums(1)} FROM {name}_x JOIN {name}_w ON src = y GROUP BY image_id, slot, x),
{name} AS (SELECT image_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, {", ".join(f"CASE WHEN a > 0 THEN {byte(f'CAST({c} AS DOUBLE) / CAST(a AS DOUBLE)')} ELSE 0 END AS {c}" for c in "rgb")}, {byte(f"CAST(a AS DOUBLE) / {resample.UNIT * resample.PART}")} AS a FROM {name}_y)"""


@query(with_pixels(resized_sql("done", 32, 16), then=digest_sql("done")))
def resize_lanczos(spark, sf_dir):
    return digest(resample.resize(pixels(spark, sf_dir, True), images(spark, sf_dir), 16))


@query(with_pixels(then=digest_sql("cut")))
def tile_round_trip(spark, sf_dir):
    tiles = geometry.plan_tiles(images(spark, sf_dir), 16, 4)
    return digest(geometry.stitch(geometry.tile_pixels(pixels(spark, sf_dir, True), tiles, 16, 4)))


def _sized(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), (40 + F.col("p_size") * 13).cast("int").alias("width"), (30 + F.col("p_partkey") % 700).cast("int").alias("height"))


SIZED_SQL = "WITH sized AS (SELECT p_partkey AS image_id, CAST(40 + p_size * 13 AS INTEGER) AS width, CAST(30 + p_partkey % 700 AS INTEGER) AS height FROM part)"


@query(SIZED_SQL + """, t AS (SELECT *, i, j, CAST(j * 192 AS INTEGER) AS cy, CAST(i * 192 AS INTEGER) AS cx FROM sized, range(8) AS a(i), range(8) AS b(j) WHERE i * 192 < width AND j * 192 < height),
u AS (SELECT *, least(192, height - cy) AS ch, least(192, width - cx) AS cw, greatest(0, cy - 32) AS fy, greatest(0, cx - 32) AS fx FROM t)
SELECT image_id, CAST(j AS INTEGER) AS row, CAST(i AS INTEGER) AS col, cy AS core_y, ch AS core_h, fy AS feed_y, least(height, cy + ch + 32) - fy AS feed_h, cx AS core_x, cw AS core_w, fx AS feed_x, least(width, cx + cw + 32) - fx AS feed_w FROM u""")
def tile_plan(spark, sf_dir):
    return geometry.plan_tiles(_sized(spark, sf_dir))


@query(SIZED_SQL + """, s AS (SELECT *, least(CAST(256 AS DOUBLE) / width, CAST(256 AS DOUBLE) / height) AS k, width > 256 OR height > 256 AS applied FROM sized)
SELECT image_id, applied, CASE WHEN applied THEN CAST(greatest(1, floor(width * k + 0.5)) AS INTEGER) ELSE width END AS width, CASE WHEN applied THEN CAST(greatest(1, floor(height * k + 0.5)) AS INTEGER) ELSE height END AS height FROM s""")
def fit_inside(spark, sf_dir):
    return _sized(spark, sf_dir).select("image_id", geometry.fit_inside(F.col("width"), F.col("height"), 256, 256).alias("f")).select("image_id", "f.*")


@query(SIZED_SQL + """, p AS (SELECT b.image_id AS base_id, t.image_id AS top_id, b.width AS base_w, b.height AS base_h, t.width AS top_w, t.height AS top_h, CAST(floor(0.5 * least(b.width, b.height) + 0.5) AS INTEGER) AS n FROM sized b JOIN sized t ON t.image_id = b.image_id + 1),
q AS (SELECT *, CASE WHEN top_w >= top_h THEN n ELSE CAST(greatest(1, floor(n * (top_w / top_h) + 0.5)) AS INTEGER) END AS out_w, CASE WHEN top_w >= top_h THEN CAST(greatest(1, floor(n / (top_w / top_h) + 0.5)) AS INTEGER) ELSE n END AS out_h FROM p)
SELECT base_id, top_id, base_w, base_h, top_w, top_h, out_w, out_h, base_w - out_w AS dest_x, base_h - out_h AS dest_y, 'ok' AS status FROM q""")
def layer_plan(spark, sf_dir):
    b = _sized(spark, sf_dir)
    base = b.select(F.col("image_id").alias("base_id"), F.col("width").alias("base_w"), F.col("height").alias("base_h"))
    top = b.select(F.col("image_id").alias("top_id"), F.col("width").alias("top_w"), F.col("height").alias("top_h"))
    pairs = base.withColumn("top_id", F.col("base_id") + 1).join(top, "top_id").select("base_id", "top_id", "base_w", "base_h", "top_w", "top_h")
    return geometry.layer_plan(pairs, "southeast", 0.5)


@query(with_pixels("done AS (SELECT p.image_id, p.y, p.x, coalesce(t.b, p.r) AS r, coalesce(t.r, p.g) AS g, coalesce(t.g, p.b) AS b, 255 AS a FROM px p LEFT JOIN px t ON t.image_id = p.image_id AND t.y = p.y - 7 AND t.x = p.x + 5)", then=digest_sql("done")))
def layer_opaque(spark, sf_dir):
    base = pixels(spark, sf_dir)
    top = base.select("image_id", "y", "x", F.col("b").alias("r"), F.col("r").alias("g"), F.col("g").alias("b"), "a")
    pairs = images(spark, sf_dir).select(F.col("image_id").alias("base_id"), F.col("image_id").alias("top_id"), *(F.lit(32).alias(c) for c in ("base_w", "base_h", "top_w", "top_h")))
    return digest(geometry.source_over(base, top, geometry.layer_plan(pairs, top_offset=(-5, 7))))


@query(SIZED_SQL + " SELECT image_id, 40 AS pad, width + 80 AS canvas_w, height + 80 AS canvas_h, 35 AS subject_x, 32 AS subject_y, 0 AS shadow_x, 0 AS shadow_y FROM sized")
def shadow_plan(spark, sf_dir):
    return geometry.shadow_plan(_sized(spark, sf_dir), 12, (5, 8), 4)


def _sheets(spark, sf_dir):
    return table(spark, sf_dir, "part").select((F.col("p_partkey") / 40).cast("long").alias("sheet_id"), F.col("p_partkey").alias("pos"), F.col("p_partkey").alias("image_id"), (F.col("p_partkey") % 7 != 0).alias("readable"))


@query("""WITH s AS (SELECT p_partkey // 40 AS sheet_id, p_partkey AS image_id, p_partkey % 7 <> 0 AS readable FROM part), c AS (SELECT sheet_id, count(*) AS count, count(*) FILTER (readable) AS placed, count(*) FILTER (NOT readable) AS n_skipped FROM s GROUP BY sheet_id),
d AS (SELECT *, CAST(ceil(sqrt(placed)) AS INTEGER) AS cols FROM c), e AS (SELECT *, CAST(ceil(placed / nullif(cols, 0)) AS INTEGER) AS rows FROM d)
SELECT sheet_id, count, placed, n_skipped, CASE WHEN placed > 0 THEN cols END AS cols, rows, CASE WHEN placed > 0 THEN cols * 272 + 16 END AS width, rows * 272 + 16 AS height FROM e""")
def sheet_report(spark, sf_dir):
    out = geometry.sheet_report(_sheets(spark, sf_dir))
    return out.withColumn("n_skipped", F.size("skipped").cast("long")).drop("skipped")


SHEET_SQL = """placed AS (SELECT p_partkey // 40 AS sheet_id, p_partkey AS image_id, row_number() OVER (PARTITION BY p_partkey // 40 ORDER BY p_partkey) - 1 AS place,
  CAST(ceil(sqrt(count(*) OVER (PARTITION BY p_partkey // 40))) AS INTEGER) AS cols, count(*) OVER (PARTITION BY p_partkey // 40) AS many FROM part WHERE p_partkey % 7 <> 0)"""


@query("WITH " + SHEET_SQL + """ SELECT sheet_id, image_id, CAST(place AS INTEGER) AS place, cols, CAST(ceil(many / cols) AS INTEGER) AS rows, CAST(16 + place % cols * 272 AS INTEGER) AS "left", CAST(16 + place // cols * 272 AS INTEGER) AS top,
CAST(cols * 272 + 16 AS INTEGER) AS width, CAST(CAST(ceil(many / cols) AS INTEGER) * 272 + 16 AS INTEGER) AS height FROM placed""")
def sheet_positions(spark, sf_dir):
    return geometry.sheet_plan(_sheets(spark, sf_dir))


@query(with_pixels(SHEET_SQL, "spread AS (SELECT sheet_id, image_id, CAST(2 + place // cols * 18 + y AS INTEGER) AS y, CAST(2 + place % cols * 18 + x AS INTEGER) AS x, 2 * y + 1 AS py, 2 * x + 1 AS px FROM placed, range(16) AS ty(y), range(16) AS tx(x))",
    "tiles AS (SELECT s.sheet_id, s.y, s.x, c.r, c.g, c.b, c.a FROM spread s JOIN cut c ON c.image_id = s.image_id AND c.y = s.py AND c.x = s.px)",
    "ground AS (SELECT sheet_id, CAST(ty.y AS INTEGER) AS y, CAST(tx.x AS INTEGER) AS x FROM (SELECT sheet_id, cols, CAST(ceil(many / cols) AS INTEGER) AS rows FROM placed WHERE place = 0), range(200) AS ty(y), range(200) AS tx(x) WHERE ty.y < rows * 18 + 2 AND tx.x < cols * 18 + 2)",
    "done AS (SELECT g.sheet_id AS image_id, g.y, g.x, coalesce(r, 0) AS r, coalesce(t.g, 0) AS g, coalesce(b, 0) AS b, coalesce(a, 0) AS a FROM ground g LEFT JOIN tiles t USING (sheet_id, y, x))", then=digest_sql("done")))
def contact_sheet(spark, sf_dir):
    return digest(layers.contact_sheet(pixels(spark, sf_dir, True), images(spark, sf_dir), _sheets(spark, sf_dir), cell=16, gap=2, kernel="nearest")[0])


@query(with_pixels(SHEET_SQL, resized_sql("small", 32, 12), "spread AS (SELECT sheet_id, image_id, CAST(2 + place // cols * 14 AS INTEGER) AS top, CAST(2 + place % cols * 14 AS INTEGER) AS lft FROM placed)",
    "tiles AS (SELECT s.sheet_id, s.top + c.y AS y, s.lft + c.x AS x, c.r, c.g, c.b, c.a FROM spread s JOIN small c USING (image_id))",
    "ground AS (SELECT sheet_id, CAST(ty.y AS INTEGER) AS y, CAST(tx.x AS INTEGER) AS x FROM (SELECT sheet_id, cols, CAST(ceil(many / cols) AS INTEGER) AS rows FROM placed WHERE place = 0), range(200) AS ty(y), range(200) AS tx(x) WHERE ty.y < rows * 14 + 2 AND tx.x < cols * 14 + 2)",
    "done AS (SELECT g.sheet_id AS image_id, g.y, g.x, " + ", ".join(f"CAST(floor(coalesce(t.{c}, 0) * (coalesce(a, 0) / 255) + {u} * (1 - coalesce(a, 0) / 255) + 0.5) AS INTEGER) AS {c}" for c, u in zip("rgb", (32, 64, 96), strict=True)) + ", 255 AS a FROM ground g LEFT JOIN tiles t USING (sheet_id, y, x))", then=digest_sql("done")))
def contact_sheet_lanczos(spark, sf_dir):
    return digest(layers.contact_sheet(pixels(spark, sf_dir, True), images(spark, sf_dir), _sheets(spark, sf_dir), cell=12, gap=2, background="#204060")[0])


@query("""WITH m AS (SELECT vec_id AS image_id, i - 1 AS i, embedding[i] AS v FROM embeddings, range(1, 65) AS t(i))
SELECT image_id, CAST(sum((i + 1) * CAST(floor(255 / (1 + exp(-CAST(v AS DOUBLE) * 8)) + 0.5) AS BIGINT)) AS BIGINT) AS a_sum FROM m WHERE v IS NOT NULL GROUP BY image_id""")
def logits_to_alpha(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "v"))
    a = resample.logits_to_alpha(F.col("v").cast("double") * 8)
    return rows.where("v is not null").groupBy("image_id").agg(F.sum((F.col("i") + 1) * a.cast("long")).alias("a_sum"))


@query(with_pixels(then=digest_sql("px")))
def feature_round_trip(spark, sf_dir):
    return digest(resample.from_features(resample.to_features(pixels(spark, sf_dir), normalize=False)))


#: The opaque rasters with a magenta and with a grey ground.
TURNED_SQL = "turned AS (SELECT image_id, y, x, g AS r, r AS g, g AS b, a FROM px)"
GREY_SQL = "grey AS (SELECT image_id, y, x, g AS r, g, g AS b, a FROM px)"


def _turned(spark, sf_dir, grey: bool = False):
    rows = pixels(spark, sf_dir)
    return rows.select("image_id", "y", "x", F.col("g").alias("r"), F.col("g" if grey else "r").alias("g"), F.col("g").alias("b"), "a")


STATS_SQL = """SELECT image_id, CAST(count(*) FILTER (a < 128) AS BIGINT) AS removed_pixels, round(count(*) FILTER (a < 128) / count(*), 6) AS removed_fraction,
  any_value(key) AS key, any_value(kind) AS kind FROM mask JOIN keyed USING (image_id) GROUP BY image_id"""


def _turned_stats(spark, sf_dir, grey):
    rows = _turned(spark, sf_dir, grey)
    stats = compose.chroma_mask(rows, images(spark, sf_dir))[1].withColumn("removed_fraction", F.round("removed_fraction", 6))
    return stats.join(measure.keys_of(rows, images(spark, sf_dir)).select("image_id", "kind"), "image_id").drop("key_source")


@query(with_pixels(TURNED_SQL, mask_sql("turned"), then=STATS_SQL))
def secondary_mask_stats(spark, sf_dir):
    return _turned_stats(spark, sf_dir, False)


@query(with_pixels(GREY_SQL, mask_sql("grey"), then=STATS_SQL))
def achromatic_mask_stats(spark, sf_dir):
    return _turned_stats(spark, sf_dir, True)


def _bleed_sql(source: str, linear: tuple[str, str, str], *more: str) -> str:
    clean = ", ".join(f"CASE WHEN m.a > 0 THEN {byte_sql(v)} ELSE 0 END AS {c}" for c, v in zip("rgb", linear, strict=True))
    return with_pixels(source, LUT_SQL, *more, f"done AS (SELECT p.image_id, p.y, p.x, {clean}, m.a FROM lit p JOIN cut m USING (image_id, y, x))", then=digest_sql("done"))


def _lit(source: str) -> str:
    return f"lit AS (SELECT image_id, y, x, l[r + 1] AS lr, l[g + 1] AS lg, l[b + 1] AS lb FROM {source}, lut)"


_EXCESS = "CAST(CAST(greatest(0.0::DOUBLE, {c} - greatest(0.0::DOUBLE, least(lr, lb) - lg)) AS FLOAT) AS DOUBLE)"


@query(_bleed_sql(TURNED_SQL, (_EXCESS.format(c="lr"), "lg", _EXCESS.format(c="lb")), _lit("turned")))
def bleed_removal_secondary(spark, sf_dir):
    return digest(compose.compose(_turned(spark, sf_dir), pixels(spark, sf_dir, True), "transparent", "#ff00ff"))


def _solved(c: str) -> str:
    k = f"CAST({linear_table()[128]!r} AS DOUBLE)"
    return f"CASE WHEN m.a < 255 AND m.a / 255 > 0.05 THEN CAST(CAST(least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({c} - (1 - m.a / 255) * {k}) / (m.a / 255))) AS FLOAT) AS DOUBLE) ELSE {c} END"


@query(_bleed_sql(GREY_SQL, tuple(f"({_solved(c)})" for c in ("lr", "lg", "lb")), _lit("grey")))
def bleed_removal_achromatic(spark, sf_dir):
    return digest(compose.compose(_turned(spark, sf_dir, True), pixels(spark, sf_dir, True), "transparent", "#808080"))


@query(with_pixels("done AS (SELECT image_id, y, x, CAST(floor(0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b + 0.5) AS INTEGER) AS a FROM px)", then=digest_sql("done", "a")))
def mask_from_image(spark, sf_dir):
    return digest(files.as_mask(pixels(spark, sf_dir)), "a")


@query(with_pixels(then=digest_sql("cut")))
def pixels_written_and_read(spark, sf_dir):
    path = new_path(spark, "pixels")
    files.write_pixels(pixels(spark, sf_dir, True), path)
    return digest(spark.read.parquet(path))


@query(with_pixels("c AS (SELECT image_id, c.* FROM (SELECT image_id, unnest([{'channel': 0, 'v': (r / 255 - 0.485) / 0.229, 'w': y * 64 + x}, {'channel': 1, 'v': (g / 255 - 0.456) / 0.224, 'w': y * 64 + x}, {'channel': 2, 'v': (b / 255 - 0.406) / 0.225, 'w': y * 64 + x}]) AS c FROM px))",
    then="SELECT image_id, channel, count(*) AS pixels, CAST(sum(CAST(floor(v * 10000 + 0.5) AS BIGINT) * (w + 1)) AS BIGINT) AS value_sum FROM c GROUP BY image_id, channel"))
def feature_planes(spark, sf_dir):
    rows = resample.to_features(pixels(spark, sf_dir))
    value = F.floor(F.col("value") * 10000 + 0.5) * (F.col("y") * 64 + F.col("x") + 1)
    return rows.groupBy("image_id", "channel").agg(F.count(F.lit(1)).alias("pixels"), F.sum(value).cast("long").alias("value_sum"))


@query("""WITH m AS (SELECT vec_id AS image_id, CAST((i - 1) // 8 AS INTEGER) AS sy, CAST((i - 1) % 8 AS INTEGER) AS sx, CAST(least(255, greatest(0, floor((CAST(embedding[i] AS DOUBLE) + 0.25) * 512))) AS INTEGER) AS a FROM embeddings, range(1, 65) AS t(i)),
done AS (SELECT image_id, ty.y, tx.x, a FROM m, range(20) AS ty(y), range(20) AS tx(x) WHERE sy = CAST(floor((ty.y + 0.5) * 0.4) AS INTEGER) AND sx = CAST(floor((tx.x + 0.5) * 0.4) AS INTEGER) AND a IS NOT NULL)
SELECT image_id, count(*) AS pixels, CAST(sum(a * (y * 64 + x + 1)) AS BIGINT) AS a_sum FROM done GROUP BY image_id""")
def resize_matte_nearest(spark, sf_dir):
    sizes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(20).alias("out_w"), F.lit(20).alias("out_h"))
    return digest(resample.resize_to(matte(spark, sf_dir).where("a is not null"), sizes, "nearest", "a"), "a")


@query(with_pixels("""entries AS (SELECT * FROM (VALUES ('small', 8), ('middle', 16), ('other', 16), ('same', 32)) AS e(entry, size))""",
    "done AS (SELECT image_id || ':' || entry AS image_id, ty.y, tx.x, r, g, b, a FROM entries, range(32) AS ty(y), range(32) AS tx(x), (SELECT image_id, y AS sy, x AS sx, r, g, b, a FROM cut) WHERE ty.y < size AND tx.x < size AND sy = CAST(floor((ty.y + 0.5) * 32 / size) AS INTEGER) AND sx = CAST(floor((tx.x + 0.5) * 32 / size) AS INTEGER))", then=digest_sql("done")))
def size_pyramid_nearest(spark, sf_dir):
    entries = spark.createDataFrame([("small", 8), ("middle", 16), ("other", 16), ("same", 32)], "entry string, size int")
    out = resample.size_pyramid(pixels(spark, sf_dir, True), images(spark, sf_dir), entries, 32, "nearest")
    return digest(out.withColumn("image_id", F.concat_ws(":", "image_id", "entry")))


@query(with_pixels("done AS (SELECT image_id, CAST(y * 2 + dy AS INTEGER) AS y, CAST(x * 2 + dx AS INTEGER) AS x, r, g, b, 255 AS a FROM px, range(2) AS j(dy), range(2) AS i(dx))", then=digest_sql("done")))
def tiles_mapped(spark, sf_dir):
    tiles = geometry.plan_tiles(images(spark, sf_dir), 20, 3)
    return digest(resample.map_tiles(pixels(spark, sf_dir), tiles, lambda rgb: rgb.repeat(2, axis=0).repeat(2, axis=1), 2, 20, 3, 8))


@query(with_pixels("done AS (SELECT c.image_id, CAST(ty.y AS INTEGER) AS y, CAST(tx.x AS INTEGER) AS x, r, g, b, a FROM cut c, range(48) AS ty(y), range(48) AS tx(x) WHERE c.y = CAST(floor(floor((ty.y + 0.5) * 128 / 48) / 4) AS INTEGER) AND c.x = CAST(floor(floor((tx.x + 0.5) * 128 / 48) / 4) AS INTEGER))", then=digest_sql("done")))
def upscale_nearest(spark, sf_dir):
    repeat = lambda rgb: rgb.repeat(4, axis=0).repeat(4, axis=1)
    return digest(resample.upscale(pixels(spark, sf_dir, True), images(spark, sf_dir), repeat, 48, "nearest", 20, 3))


@query(with_pixels("""done AS (SELECT p.image_id, CAST(ty.y AS INTEGER) AS y, CAST(tx.x AS INTEGER) AS x, r, g, b, a FROM cut p, range(36) AS ty(y), range(36) AS tx(x)
  WHERE p.y = CASE WHEN ty.y < 32 THEN ty.y ELSE 63 - ty.y END AND p.x = CASE WHEN tx.x < 32 THEN tx.x ELSE 63 - tx.x END)""", then=digest_sql("done")))
def mirror_padding(spark, sf_dir):
    return digest(geometry.pad_to_multiple(pixels(spark, sf_dir, True), images(spark, sf_dir), 18)[0])


@query(with_pixels("""done AS (SELECT p.image_id, p.y, p.x, coalesce(t.b, p.r) AS r, coalesce(t.r, p.g) AS g, coalesce(t.g, p.b) AS b, 255 AS a
  FROM px p LEFT JOIN px t ON t.image_id = p.image_id + 1 AND p.y >= 16 AND p.x >= 16 AND t.y = (p.y - 16) * 2 + 1 AND t.x = (p.x - 16) * 2 + 1 WHERE p.image_id < (SELECT max(image_id) FROM px))""", then=digest_sql("done")))
def layer_scaled(spark, sf_dir):
    base = pixels(spark, sf_dir)
    top = base.select("image_id", "y", "x", F.col("b").alias("r"), F.col("r").alias("g"), F.col("g").alias("b"), "a")
    ids = images(spark, sf_dir).select(F.col("image_id").alias("top_id")).where("top_id > 0")
    pairs = ids.select((F.col("top_id") - 1).alias("base_id"), "top_id", *(F.lit(32).alias(c) for c in ("base_w", "base_h", "top_w", "top_h")))
    return digest(layers.layer(base.join(pairs.select(F.col("base_id").alias("image_id")), "image_id"), top, pairs, "southeast", 0.5, kernel="nearest")[0])


@query("""WITH plates AS (SELECT p_partkey AS k, 0.5::DOUBLE + p_size % 4 * 0.125 AS content, p_partkey % 5 * 0.1::DOUBLE AS radius, p_partkey % 8 * 45 AS angle, CASE p_partkey % 2 WHEN 0 THEN 2 ELSE 4 END AS power FROM part),
spots AS (SELECT *, content * 24 / 2 AS half, radius * 2 * (content * 24 / 2) AS corner, ty.y AS y, tx.x AS x FROM plates, range(24) AS ty(y), range(24) AS tx(x)),
points AS (SELECT *, abs(x + (2 * i + 1) / 8 - 12) AS fx, abs(y + (2 * j + 1) / 8 - 12) AS fy FROM spots, range(4) AS a(i), range(4) AS b(j)),
inside AS (SELECT k, y, x, count(*) FILTER (fx <= half AND fy <= half AND (fx <= half - corner OR fy <= half - corner OR pow(fx - (half - corner), power) + pow(fy - (half - corner), power) <= pow(corner, power))) AS n FROM points GROUP BY ALL),
shaded AS (SELECT k, y, x, CAST(floor(n / 16 * 255 + 0.5) AS INTEGER) AS a, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.5 + ((x + 0.5 - 12 + half) / (2 * half) - 0.5) * sin(radians(angle)) - ((y + 0.5 - 12 + half) / (2 * half) - 0.5) * cos(radians(angle)))) AS t FROM spots JOIN inside USING (k, y, x))
SELECT k AS image_id, count(*) AS pixels, CAST(sum(CASE WHEN a > 0 THEN 1 ELSE 0 END) AS BIGINT) AS shown, CAST(sum(a * (y * 64 + x + 1)) AS BIGINT) AS a_sum, round(avg(CASE WHEN a > 0 THEN floor(16 * (1 - t) + 235 * t + 0.5) ELSE 0 END), 1) AS r_mean FROM shaded GROUP BY k""")
def gradient_plates(spark, sf_dir):
    k = F.col("p_partkey")
    plates = table(spark, sf_dir, "part").select(k.alias("image_id"), F.lit(24).alias("size"), (0.5 + F.col("p_size") % 4 * 0.125).alias("content"), (k % 5 * 0.1).alias("radius"), F.lit("#10ff20").alias("from_color"), F.lit("#eb0020").alias("to_color"), (k % 8 * 45).alias("angle"), F.when(k % 2 == 0, "rect").otherwise("squircle").alias("shape"))
    at = F.col("y") * 64 + F.col("x") + 1
    rows = layers.gradient_plates(plates)
    return rows.groupBy("image_id").agg(F.count(F.lit(1)).alias("pixels"), F.sum((F.col("a") > 0).cast("long")).alias("shown"), F.sum(F.col("a") * at).cast("long").alias("a_sum"), F.round(F.avg("r"), 1).alias("r_mean"))


def _laid_sql(name: str, under: str, top: str, dy: int, dx: int) -> str:
    """``under`` with ``top`` over it, moved, rounded to bytes."""
    colour = lambda c: f"CASE WHEN o.a + u.a > 0 THEN CAST(floor((o.{c} * (o.a / 255) + u.{c} * (u.a / 255) * (1 - o.a / 255)) / (o.a / 255 + u.a / 255 * (1 - o.a / 255)) + 0.5) AS INTEGER) ELSE 0 END AS {c}"
    over = f"(SELECT u.image_id, u.y, u.x, coalesce(t.r, 0) AS r, coalesce(t.g, 0) AS g, coalesce(t.b, 0) AS b, coalesce(t.a, 0) AS a FROM {under} u LEFT JOIN {top} t ON t.image_id = u.image_id AND t.y = u.y - ({dy}) AND t.x = u.x - ({dx}))"
    return f"{name} AS (SELECT u.image_id, u.y, u.x, {', '.join(map(colour, 'rgb'))}, CAST(floor((o.a / 255 + u.a / 255 * (1 - o.a / 255)) * 255 + 0.5) AS INTEGER) AS a FROM {under} u JOIN {over} o USING (image_id, y, x))"


STACK_SQL = "glass AS (SELECT image_id, y, x, b AS r, r AS g, g AS b, CAST((x * 7 + y * 13 + image_id) % 256 AS INTEGER) AS a FROM px)"


@query(with_pixels(STACK_SQL, _laid_sql("once", "cut", "glass", 3, -4), _laid_sql("twice", "once", "glass", 3, -4), _laid_sql("done", "twice", "px", 3, -4), then=digest_sql("done")))
def layer_stack(spark, sf_dir):
    """A base under three tops: a half-transparent one twice, then an opaque one."""
    base, top = pixels(spark, sf_dir, True), pixels(spark, sf_dir)
    glass = top.select((-1 - F.col("image_id")).alias("image_id"), "y", "x", F.col("b").alias("r"), F.col("r").alias("g"), F.col("g").alias("b"), ((F.col("x") * 7 + F.col("y") * 13 + F.col("image_id")) % 256).cast("int").alias("a"))
    ids, sides = images(spark, sf_dir).select(F.col("image_id").alias("base_id")), [F.lit(32).alias(c) for c in ("base_w", "base_h", "top_w", "top_h")]
    tops = F.explode(F.array(*(F.struct(F.lit(p).alias("position"), id_.alias("top_id")) for p, id_ in ((2, -1 - F.col("base_id")), (9, F.col("base_id")), (1, -1 - F.col("base_id"))))))
    pairs = ids.withColumn("t", tops).select("base_id", "t.*", *sides)
    return digest(layers.layer(base, glass.union(top), pairs, top_offset=(-4, 3))[0])


def _blur_sql(name: str, source: str, by: str, along: str) -> str:
    weights = geometry.gaussian_weights(1)
    at = lambda k: "a" if k == 3 else f"{'lag' if k < 3 else 'lead'}(a, {abs(k - 3)}) OVER w"
    total = " + ".join(f"{w}::BIGINT * coalesce({at(k)}, 0)" for k, w in enumerate(weights))
    taps = " + ".join(f"CASE WHEN {at(k)} IS NULL THEN 0 ELSE {w}::BIGINT END" for k, w in enumerate(weights))
    return f"{name} AS (SELECT image_id, y, x, CAST(floor(CAST({total} AS DOUBLE) / CAST({taps} AS DOUBLE) + 0.5) AS BIGINT) AS a FROM {source} WINDOW w AS (PARTITION BY image_id, {by} ORDER BY {along}))"


SHADOW_SQL = (
    "ground AS (SELECT p_partkey AS image_id, CAST(ty.y AS INTEGER) AS y, CAST(tx.x AS INTEGER) AS x FROM part, range(40) AS ty(y), range(40) AS tx(x))",
    "padded AS (SELECT image_id, g.y, g.x, coalesce(c.a, 0) AS a FROM ground g LEFT JOIN (SELECT image_id, y + 4 AS y, x + 4 AS x, a FROM cut) c USING (image_id, y, x))",
    "wide AS (SELECT image_id, y, x, max(a) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS a FROM padded)",
    "high AS (SELECT image_id, y, x, CAST(floor(max(a) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) * 0.35::DOUBLE + 0.5) AS BIGINT) AS a FROM wide)",
    _blur_sql("once_x", "high", "y", "x"), _blur_sql("once_y", "once_x", "x", "y"), "below AS (SELECT image_id, y, x, 0 AS r, 0 AS g, 0 AS b, CAST(a AS INTEGER) AS a FROM once_y)", _laid_sql("done", "below", "cut", 1, 2),
)


@query(with_pixels(*SHADOW_SQL, then=digest_sql("done")))
def drop_shadow(spark, sf_dir):
    return digest(geometry.shadow(pixels(spark, sf_dir, True), images(spark, sf_dir), 1, (2, 3), spread=1))


@query("""WITH d AS (SELECT doc_id, hex(encode(text)) AS h, CAST(CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 4 END AS INTEGER) AS n, CAST(5 + doc_id % 7 AS INTEGER) AS w FROM documents),
s AS (SELECT *, length(h) // 2 // (w * n) AS ht FROM d), p AS (SELECT *, unnest(range(0, w * ht)) AS i FROM s WHERE ht > 0),
v AS (SELECT doc_id, n, i // w AS y, i % w AS x, h[2 * n * i + 1 : 2 * n * (i + 1)] AS c FROM p),
done AS (SELECT doc_id AS image_id, y, x, """ + ", ".join(f"(instr('123456789ABCDEF', c[{2 * k + 1}]) * 16 + instr('123456789ABCDEF', c[{2 * k + 2}]))".join((f"CASE WHEN n = 1 THEN (instr('123456789ABCDEF', c[1]) * 16 + instr('123456789ABCDEF', c[2])) ELSE ", f" END AS {name}")) for name, k in (("r", 2), ("g", 1), ("b", 0))) + """,
 CASE WHEN n = 4 THEN (instr('123456789ABCDEF', c[7]) * 16 + instr('123456789ABCDEF', c[8])) ELSE 255 END AS a FROM v)
""" + digest_sql("done"))
def bytes_exploded(spark, sf_dir):
    """The bytes of each document as an image of 1, 3 or 4 channels."""
    k, wide = F.col("doc_id"), F.col("width") * F.col("nChannels")
    rows = table(spark, sf_dir, "documents").select(k.alias("image_id"), F.encode("text", "utf-8").alias("data"), (5 + k % 7).cast("int").alias("width"), F.when(k % 3 == 0, 1).when(k % 3 == 1, 3).otherwise(4).alias("nChannels"))
    return digest(files.explode_pixels(rows.withColumn("height", F.floor(F.octet_length("data") / wide).cast("int"))))


@query(SIZED_SQL + """ SELECT image_id, CASE WHEN image_id % 5 <> 0 THEN width END AS a_width, CASE WHEN image_id % 5 <> 0 THEN height END AS a_height, CASE WHEN image_id % 7 <> 0 THEN width + CAST(image_id % 2 AS INTEGER) END AS b_width, CASE WHEN image_id % 7 <> 0 THEN height END AS b_height
FROM sized WHERE (image_id % 5 <> 0 OR image_id % 7 <> 0) AND (image_id % 5 = 0 OR image_id % 7 = 0 OR image_id % 2 = 1)""")
def size_mismatches(spark, sf_dir):
    sized, k = _sized(spark, sf_dir), F.col("image_id")
    return compose.same_size(sized.where(k % 5 != 0), sized.where(k % 7 != 0).withColumn("width", F.col("width") + (k % 2).cast("int")))


@query(with_pixels(then=digest_sql("cut WHERE image_id % 50 <> 7")))
def images_written_and_read(spark, sf_dir):
    """PNG files of all cutouts, decoded; those that are cut off are listed apart."""
    key = F.regexp_extract("image_id", r"(\d+)\.png$", 1).cast("long")

    def decoded(folder: str) -> DataFrame:
        return digest(files.explode_pixels(files.read_images(spark, folder)[0]).withColumn("image_id", key))

    return files.by_folder(spark, png_files(spark, sf_dir), decoded)


@query("SELECT p_partkey, 'png' AS format, CASE WHEN p_partkey % 50 <> 7 THEN 32 END AS width, CASE WHEN p_partkey % 50 <> 7 THEN 32 END AS height, p_partkey % 50 = 7 AS short, p_partkey % 50 <> 7 AS readable FROM part")
def files_listed(spark, sf_dir):
    """The inventory of these files, and whether each can be decoded."""
    key = lambda c: F.regexp_extract(c, r"(\d+)\.png$", 1).cast("long")

    def listed(folder: str) -> DataFrame:
        bad = files.read_images(spark, folder)[1].select(key("origin").alias("p_partkey"), F.lit(False).alias("readable"))
        rows = files.inventory(spark, folder).select(key("path").alias("p_partkey"), "format", "width", "height", (F.col("length") == 10).alias("short"))
        return rows.join(bad, "p_partkey", "left").na.fill(True, ["readable"])

    return files.by_folder(spark, png_files(spark, sf_dir), listed)

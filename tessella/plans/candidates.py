"""Queries on candidates of measurement passes: composites by component, masks, densities, matches of two sensors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import grid
from .views import FRAME, MEAS, TILE, WIDTH, clt, frame, meas, table, tile

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


COMPONENTS = ("quad", "hor", "vert")
_COMP = """comp AS (SELECT l_partkey AS n_tile, CASE l_returnflag WHEN 'A' THEN 'quad' WHEN 'N' THEN 'hor' ELSE 'vert' END AS component, l_quantity + round(l_discount - 0.05, 4) / 0.85 AS disparity, round(l_tax * 10, 4) AS strength,
  (abs(round(l_discount - 0.05, 4)), l_linenumber, l_orderkey, l_quantity, l_extendedprice) AS by_resid, (-round(l_tax * 10, 4), l_linenumber, l_orderkey, l_quantity, l_extendedprice) AS by_strength FROM lineitem WHERE l_extendedprice / 120000 <= 0.8),
ranged AS (SELECT * FROM comp WHERE disparity BETWEEN 2 AND 48), composite AS (SELECT n_tile"""
for _c in COMPONENTS:
    for _v in ("disparity", "strength"):
        _COMP += f""",
  coalesce(min_by({_v}, by_resid) FILTER (component = '{_c}' AND strength >= 0.4), min_by({_v}, by_strength) FILTER (component = '{_c}' AND strength < 0.4)) AS {_c}_{_v}"""
_COMP += " FROM ranged GROUP BY n_tile)"


def _composite(spark, sf_dir):
    """Per tile and component, of the passes that aren't overexposed and lie in range: among the strong ones the
    least residual, else the strongest weak one. One shuffle, by tile, for all components."""
    m = table(spark, sf_dir, "lineitem").where(F.col("l_extendedprice") / 120000 <= 0.8)
    resid, strength = F.round(F.col("l_discount") - 0.05, 4), F.round(F.col("l_tax") * 10, 4)
    m = m.select(F.col("l_partkey").alias("n_tile"), F.col("l_returnflag").alias("flag"), (F.col("l_quantity") + resid / 0.85).alias("disparity"), strength.alias("strength"), F.abs(resid).alias("resid"), "l_linenumber", "l_orderkey", "l_quantity", "l_extendedprice").where("disparity between 2 and 48")
    ties = ("l_linenumber", "l_orderkey", "l_quantity", "l_extendedprice")
    found = []
    for c, flag in zip(COMPONENTS, (F.col("flag") == "A", F.col("flag") == "N", ~F.col("flag").isin("A", "N")), strict=True):
        strong = F.when(flag & (F.col("strength") >= 0.4), F.struct("resid", *ties))
        weak = F.when(flag & (F.col("strength") < 0.4), F.struct((-F.col("strength")).alias("s"), *ties))
        value = F.struct("disparity", "strength")
        found.append(F.coalesce(F.min_by(value, strong), F.min_by(value, weak)).alias(c))
    best = m.groupBy("n_tile").agg(*found)
    return best.select("n_tile", *(F.col(f"{c}.{v}").alias(f"{c}_{v}") for c in COMPONENTS for v in ("disparity", "strength")))


@query(f"WITH {_COMP} SELECT n_tile, {', '.join(f'round({c}_disparity, 6) AS {c}_disparity, {c}_strength' for c in COMPONENTS)} FROM composite")
def composite_scan(spark, sf_dir):
    """The best measurement of each component over all passes."""
    return _composite(spark, sf_dir).select("n_tile", *(x for c in COMPONENTS for x in (F.round(f"{c}_disparity", 6).alias(f"{c}_disparity"), F.col(f"{c}_strength"))))


_OVER = {"quad": 0.5, "hor": 0.4, "vert": 0.45}


@query(f"""WITH {_COMP}, o AS (SELECT n_tile, {', '.join(f"CASE WHEN (n_tile % {WIDTH} + n_tile // {WIDTH}) % 4 <> 0 OR ({c}_disparity >= 8 AND {c}_strength > {s}) THEN {c}_disparity END AS {c}" for c, s in _OVER.items())} FROM composite)
SELECT n_tile, round(quad, 6) AS quad, round(hor, 6) AS hor, round(vert, 6) AS vert, coalesce(quad, hor, vert) IS NOT NULL AS measured FROM o""")
def over_background(spark, sf_dir):
    """On background tiles a component stays only where it is near and strong enough; a tile without any isn't
    measured."""
    background = (F.col("n_tile") % WIDTH + F.expr(f"n_tile div {WIDTH}")) % 4 == 0
    o = _composite(spark, sf_dir).select("n_tile", *(F.when(~background | ((F.col(f"{c}_disparity") >= 8) & (F.col(f"{c}_strength") > s)), F.col(f"{c}_disparity")).alias(c) for c, s in _OVER.items()))
    return o.select("n_tile", *(F.round(c, 6).alias(c) for c in COMPONENTS), F.coalesce(*COMPONENTS).isNotNull().alias("measured"))


@query(f"""WITH {_COMP}, h AS (SELECT *, coalesce(hor_disparity < 40 AND hor_strength > 0.3 AND hor_strength > 1.1 * coalesce(quad_strength, 0) - 0.1 AND hor_strength > 0.9 * coalesce(vert_strength, 0) - 0.05, false) AS by_hor FROM composite),
s AS (SELECT *, CASE WHEN by_hor THEN hor_disparity ELSE quad_disparity END AS d, CASE WHEN by_hor THEN hor_strength ELSE quad_strength END AS w FROM h),
v AS (SELECT *, coalesce(vert_disparity < 40 AND vert_strength > 0.3 AND vert_strength > 1.1 * coalesce(w, 0) - 0.1 AND vert_strength > 0.9 * coalesce(hor_strength, 0) - 0.05, false) AS by_vert FROM s)
SELECT n_tile, round(CASE WHEN by_vert THEN vert_disparity ELSE d END, 6) AS disparity, CASE WHEN by_vert THEN vert_strength ELSE w END AS strength, by_hor::INT + 2 * by_vert::INT AS replaced FROM v""")
def ortho_combined(spark, sf_dir):
    """Horizontal, then vertical pairs replace a tile's disparity where they are strong against it and each other;
    bits 1 and 2 say which did."""

    def stronger(c, now, other):
        s = F.col(f"{c}_strength")
        rest = (s > 1.1 * F.coalesce(now, F.lit(0)) - 0.1) & (s > 0.9 * F.coalesce(F.col(f"{other}_strength"), F.lit(0)) - 0.05)
        return F.coalesce((F.col(f"{c}_disparity") < 40) & (s > 0.3) & rest, F.lit(False))

    t = _composite(spark, sf_dir).withColumns({"d": F.col("quad_disparity"), "w": F.col("quad_strength"), "replaced": F.lit(0)})
    for bit, c, other in ((1, "hor", "vert"), (2, "vert", "hor")):
        t = t.withColumn("by", stronger(c, F.col("w"), other))
        t = t.withColumns({"d": F.when(F.col("by"), F.col(f"{c}_disparity")).otherwise(F.col("d")), "w": F.when(F.col("by"), F.col(f"{c}_strength")).otherwise(F.col("w")), "replaced": F.col("replaced") + F.when(F.col("by"), bit).otherwise(0)})
    return t.select("n_tile", F.round("d", 6).alias("disparity"), F.col("w").alias("strength"), "replaced")


@query(f"""WITH {TILE}, s AS (SELECT sx, sy, strength, disparity FROM tile, LATERAL (SELECT unnest([(x + 4) // 8 - 1, (x + 4) // 8]) AS sx), LATERAL (SELECT unnest([(y + 4) // 8 - 1, (y + 4) // 8]) AS sy) WHERE strength >= 0.7 AND n_tile % 3 <> 0)
SELECT sx, sy, count(*) AS tiles, round(sum(strength), 4) AS strength FROM s WHERE sx >= 0 AND sy >= 0 GROUP BY sx, sy""")
def supertile_windows(spark, sf_dir):
    """Selected tiles of each supertile's window of twice its side, and the sum of their strengths; none, no row."""
    near = lambda c: F.explode(F.array(F.expr(f"({c} + 4) div 8") - 1, F.expr(f"({c} + 4) div 8")))
    t = tile(spark, sf_dir).where("strength >= 0.7 and n_tile % 3 <> 0")
    s = t.select("x", "y", "strength", near("x").alias("sx")).select("*", near("y").alias("sy")).where("sx >= 0 and sy >= 0")
    return s.groupBy("sx", "sy").agg(F.count("*").alias("tiles"), F.round(F.sum("strength"), 4).alias("strength"))


#: Zones of a disparity histogram: step and end of the far zone, end and step of the near one, from MIN on.
_MIN, _FAR, _FAR_END, _NEAR_END, _NEAR = 1.0, 1.0, 8.0, 24.0, 4.0
_BIN = f"CASE WHEN d < {_FAR_END} THEN floor(d / {_FAR} + 0.5) WHEN d < {_NEAR_END} THEN floor({_FAR_END} / {_FAR} * (ln(d / {_FAR_END}) + 1) + 0.5) ELSE floor({_FAR_END} / {_FAR} * (ln({_NEAR_END} / {_FAR_END}) + 1) + (d - {_NEAR_END}) / {_NEAR} + 0.5) END"


@query(f"""WITH {MEAS}, s AS (SELECT sx, sy, target - {_MIN} AS d, strength AS w FROM meas, LATERAL (SELECT unnest([(x + 4) // 8 - 1, (x + 4) // 8]) AS sx), LATERAL (SELECT unnest([(y + 4) // 8 - 1, (y + 4) // 8]) AS sy) WHERE strength > 0),
h AS (SELECT sx, sy, ({_BIN})::INT AS bin, sum(w) AS w FROM s WHERE sx >= 0 AND sy >= 0 GROUP BY ALL)
SELECT sx, sy, bin, round(w / sum(w) OVER (PARTITION BY sx, sy), 6) AS part, round(sum(w) OVER (PARTITION BY sx, sy) / 64, 5) AS strength FROM h""")
def lapped_histograms(spark, sf_dir):
    """Disparity histograms of supertiles over windows that overlap by half: bins linear, logarithmic, linear; parts
    of the window's whole weight, and that weight by tile."""
    near = lambda c: F.explode(F.array(F.expr(f"({c} + 4) div 8") - 1, F.expr(f"({c} + 4) div 8")))
    m = meas(spark, sf_dir).where("strength > 0").withColumn("d", F.col("target") - _MIN).withColumn("bin", F.expr(_BIN).cast("int"))
    m = m.groupBy("x", "y", "bin").agg(F.sum("strength").alias("w"))
    s = m.select("*", near("x").alias("sx")).select("*", near("y").alias("sy")).where("sx >= 0 and sy >= 0")
    h, w = s.groupBy("sx", "sy", "bin").agg(F.sum("w").alias("w")), Window.partitionBy("sx", "sy")
    return h.select("sx", "sy", "bin", F.round(F.col("w") / F.sum("w").over(w), 6).alias("part"), F.round(F.sum("w").over(w) / 64, 5).alias("strength"))


_RADIUS, _HEIGHT = 0.6, 40


@query(f"""WITH {TILE} SELECT n_tile, x >= {int(WIDTH * (1 - _RADIUS) / 2)} AND x < {int(WIDTH * (1 + _RADIUS) / 2)} AND y >= {int(_HEIGHT * (1 - _RADIUS) / 2)} AND y < {int(_HEIGHT * (1 + _RADIUS) / 2)} AS central,
  CASE WHEN v = 0 THEN [7, 0, 1][h + 1] WHEN v = 2 THEN [5, 4, 3][h + 1] ELSE [6, -1, 2][h + 1] END AS segment FROM (SELECT *, CASE WHEN x < {WIDTH // 4} THEN 0 WHEN x >= {3 * WIDTH // 4} THEN 2 ELSE 1 END AS h, CASE WHEN y < {_HEIGHT // 4} THEN 0 WHEN y >= {3 * _HEIGHT // 4} THEN 2 ELSE 1 END AS v FROM tile)""")
def tile_zones(spark, sf_dir):
    """Whether a tile lies in the centred rectangle, and its border zone: by compass from 0 at the top, -1 inside."""
    inside = lambda c, n: (F.col(c) >= int(n * (1 - _RADIUS) / 2)) & (F.col(c) < int(n * (1 + _RADIUS) / 2))
    up, down = F.col("y") < _HEIGHT // 4, F.col("y") >= 3 * _HEIGHT // 4
    left, right = F.col("x") < WIDTH // 4, F.col("x") >= 3 * WIDTH // 4
    by_side = lambda a, b, c: F.when(left, a).when(right, c).otherwise(b)
    zone = F.when(up, by_side(7, 0, 1)).when(down, by_side(5, 4, 3)).otherwise(by_side(6, -1, 2))
    return tile(spark, sf_dir).select("n_tile", (inside("x", WIDTH) & inside("y", _HEIGHT)).alias("central"), zone.alias("segment"))


@query(f"""WITH {TILE}, s AS (SELECT x, y FROM tile WHERE strength >= 0.8 AND (x * 7 + y * 3) % 11 = 0)
SELECT x, y FROM tile t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.x = t.x AND s.y = t.y) AND EXISTS (SELECT 1 FROM s WHERE abs(s.x - t.x) <= 2 AND abs(s.y - t.y) <= 2)""")
def added_cells(spark, sf_dir):
    """The cells that two steps of growth in all eight directions add to a selection."""
    t = tile(spark, sf_dir)
    s = t.where("strength >= 0.8 and (x * 7 + y * 3) % 11 = 0").select("x", "y")
    reach = F.explode(grid.offsets([(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3)]))
    grown = s.select("x", "y", reach.alias("o")).select((F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y")).distinct()
    return t.select("x", "y").join(grown, ["x", "y"], "left_semi").join(s, ["x", "y"], "left_anti")


@query("""WITH t AS (SELECT vec_id AS n_tile, embedding::DOUBLE[] AS t FROM embeddings), p AS (SELECT n_tile, t, list_transform(range(64), lambda i: t[i + 1] * t[i + 1] + t[((8 - i // 8) % 8) * 8 + (8 - i % 8) % 8 + 1] * t[((8 - i // 8) % 8) * 8 + (8 - i % 8) % 8 + 1]) AS p FROM t)
SELECT n_tile, array_to_string(list_filter(range(64), lambda i: t[i + 1] > 0.2), ',') AS lit, list_position(t, list_max(t)) - 1 AS brightest, list_position(p, list_max(p)) - 1 AS paired FROM p""")
def bright_pixels(spark, sf_dir):
    """Pixels of a tile above a level, its first brightest one, and the first whose power with that of its mirror
    about the centre is greatest."""
    t = clt(spark, sf_dir)
    at = lambda i: F.element_at("tile", i.cast("int") + 1)
    mirror = lambda i: ((8 - F.floor(i / 8)) % 8) * 8 + (8 - i % 8) % 8
    places = F.sequence(F.lit(0), F.lit(63))
    power = F.transform(places, lambda i: at(i) * at(i) + at(mirror(i)) * at(mirror(i)))
    first = lambda a: F.array_position(a, F.array_max(a)) - 1
    lit = F.array_join(F.transform(F.filter(places, lambda i: at(i) > 0.2), lambda i: i.cast("string")), ",")
    return t.select("n_tile", "tile", lit.alias("lit"), power.alias("p")).select("n_tile", "lit", first(F.col("tile")).alias("brightest"), first(F.col("p")).alias("paired"))


@query("""SELECT o_custkey AS series, bool_or(o_orderstatus <> 'P') AND bool_or(left(o_orderpriority, 1)::INT > 3) AS valid FROM orders GROUP BY o_custkey""")
def valid_series(spark, sf_dir):
    """Whether any image of a series is selected and any of its modes is on."""
    on = F.bool_or(F.col("o_orderstatus") != "P") & F.bool_or(F.substring("o_orderpriority", 1, 1).cast("int") > 3)
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("series")).agg(on.alias("valid"))


@query(f"""WITH {MEAS} SELECT s.scan, n_tile, pass_id, src, target, row_number() OVER (PARTITION BY s.scan, n_tile ORDER BY target DESC, pass_id, src, price) AS place FROM meas, LATERAL (SELECT unnest(range(pass_id, 8)) AS scan) s WHERE strength >= 0.6""")
def measurements_so_far(spark, sf_dir):
    """For each tile and scan, the trusted measurements of it and older scans from near to far."""
    m = meas(spark, sf_dir).where("strength >= 0.6").withColumn("scan", F.explode(F.sequence(F.col("pass_id").cast("long"), F.lit(7).cast("long"))))
    near_first = Window.partitionBy("scan", "n_tile").orderBy(F.desc("target"), "pass_id", "src", "price")
    return m.select("scan", "n_tile", "pass_id", "src", "target", F.row_number().over(near_first).alias("place"))


@query(f"""WITH {FRAME}, f AS (SELECT channel, frame_id, ts, row_number() OVER (PARTITION BY channel ORDER BY ts, frame_id) - 1 AS n FROM frame), r AS (SELECT * FROM f WHERE channel = 0),
o AS (SELECT f.channel, f.n AS shift, abs(epoch_us(f.ts) - epoch_us(r.ts)) AS dt FROM f, r WHERE r.n = 0 AND f.n <= 3 UNION ALL SELECT f.channel, -r.n, abs(epoch_us(f.ts) - epoch_us(r.ts)) FROM f, r WHERE f.n = 0 AND r.n BETWEEN 1 AND 3),
b AS (SELECT channel, min_by(shift, (dt, abs(shift), shift)) AS shift FROM o WHERE dt <= 14400000000 GROUP BY channel)
SELECT f.channel, f.frame_id, r.frame_id AS reference, b.shift FROM f JOIN b USING (channel) JOIN r ON r.n = f.n - b.shift""")
def matched_frames(spark, sf_dir):
    """Channels lined up with a reference channel: of at most three frames of offset either way the one whose times
    differ least; a channel beyond the greatest mismatch has none. Frames then pair up by shifted number."""
    f = frame(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("channel").orderBy("ts", "frame_id")) - 1)
    f = f.select("channel", "frame_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "n")
    r = f.where("channel = 0")
    # A few rows of the reference go into one, which every channel's first frames meet.
    starts = r.where("n <= 3").agg(*(F.min(F.when(F.col("n") == k, F.col("t"))).alias(f"r{k}") for k in range(4)))
    first = f.where("n <= 3").groupBy("channel").agg(*(F.min(F.when(F.col("n") == k, F.col("t"))).alias(f"c{k}") for k in range(4)))
    ways = [(k, F.abs(F.col(f"c{k}") - F.col("r0"))) for k in range(4)] + [(-k, F.abs(F.col("c0") - F.col(f"r{k}"))) for k in range(1, 4)]
    tried = F.array(*(F.struct(dt.alias("dt"), F.lit(abs(k)).alias("far"), F.lit(k).cast("long").alias("shift")) for k, dt in ways))
    shift = F.array_min(F.filter(tried, lambda s: s["dt"] <= 14_400_000_000))["shift"]
    b = first.crossJoin(F.broadcast(starts)).select("channel", shift.alias("shift")).where("shift is not null")
    moved = f.join(b, "channel").withColumn("m", F.col("n") - F.col("shift"))
    return moved.join(r.select(F.col("n").alias("m"), F.col("frame_id").alias("reference")), "m").select("channel", "frame_id", "reference", "shift")


_RIG = f"""{MEAS}, main AS (SELECT n_tile, x, y, avg(target) AS d, max(strength) AS s FROM meas WHERE pass_id = 1 GROUP BY ALL), rig AS (SELECT n_tile, x, y, avg(target) AS r FROM meas WHERE pass_id = 2 GROUP BY ALL)"""


def _two(spark, sf_dir):
    m = meas(spark, sf_dir).where("pass_id in (1, 2)")
    is_main = F.col("pass_id") == 1
    return m.groupBy("n_tile", "x", "y").agg(F.avg(F.when(is_main, F.col("target"))).alias("d"), F.max(F.when(is_main, F.col("strength"))).alias("s"), F.avg(F.when(~is_main, F.col("target"))).alias("r"))


@query(f"""WITH {_RIG}, j AS (SELECT coalesce(m.n_tile, g.n_tile) AS n_tile, coalesce(m.x, g.x) AS x, coalesce(m.y, g.y) AS y, CASE WHEN abs(d - r) <= 6 THEN d END AS d, r FROM main m FULL JOIN rig g ON g.n_tile = m.n_tile),
n AS (SELECT a.n_tile, sum(b.d * w) / sum(w) AS near FROM j a JOIN j b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.n_tile <> b.n_tile AND abs(b.d - a.r) <= 8, LATERAL (SELECT CASE WHEN a.x <> b.x AND a.y <> b.y THEN 0.7 ELSE 1.0 END AS w) GROUP BY a.n_tile)
SELECT n_tile, round(CASE WHEN d IS NOT NULL THEN d WHEN r IS NOT NULL THEN coalesce(near, r) END, 6) AS disparity, d IS NOT NULL AS confirmed FROM j LEFT JOIN n USING (n_tile)""")
def confirmed_disparity(spark, sf_dir):
    """Disparities that a second sensor confirms; where it doesn't, the mean of confirmed neighbours near the second
    sensor's value, else that value."""
    j = _two(spark, sf_dir).withColumn("d", F.when(F.abs(F.col("d") - F.col("r")) <= 6, F.col("d"))).drop("s")
    near = grid.pairs(j, ["d"]).join(j.select("x", "y", "r"), ["x", "y"]).where("abs(n_d - r) <= 8")
    w = F.when((F.col("dx") != 0) & (F.col("dy") != 0), 0.7).otherwise(1.0)
    near = near.groupBy("x", "y").agg((F.sum(w * F.col("n_d")) / F.sum(w)).alias("near"))
    value = F.coalesce("d", F.when(F.col("r").isNotNull(), F.coalesce("near", "r")))
    return j.join(near, ["x", "y"], "left").select("n_tile", F.round(value, 6).alias("disparity"), F.col("d").isNotNull().alias("confirmed"))


@query(f"""WITH {_RIG}, e AS (SELECT g.x, g.y, min(b.r) AS lo, max(b.r) AS hi FROM rig g JOIN rig b ON abs(g.x - b.x) <= 1 AND abs(g.y - b.y) <= 1 GROUP BY g.x, g.y),
o AS (SELECT m.*, CASE WHEN r IS NULL OR abs(d - r) > 6 THEN 1 ELSE 0 END AS alone FROM main m LEFT JOIN rig g ON g.n_tile = m.n_tile)
SELECT o.n_tile, min(e.x - o.x) AS steps FROM o JOIN e ON e.y = o.y AND e.x - o.x BETWEEN 1 AND 6 AND o.d + 1.5 * (e.x - o.x) BETWEEN e.lo - 0.5 AND least(e.hi + 0.5, 30) WHERE alone = 1 AND s >= 0.4 GROUP BY o.n_tile""")
def occluded_tiles(spark, sf_dir):
    """Strong tiles that only the first sensor sees and the second's view of nearer ones hides: walking right, the
    disparity asked for grows by step and falls within that of a neighbourhood."""
    t = _two(spark, sf_dir)
    rig = t.where("r is not null").select("x", "y", "r")
    around = F.explode(grid.offsets([(0, 0), *grid.RING8]))
    e = rig.select("r", around.alias("o"), "x", "y").select((F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), "r")
    e = e.groupBy("x", "y").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).join(rig.select("x", "y"), ["x", "y"], "left_semi")
    walk = t.where("d is not null and s >= 0.4 and (r is null or abs(d - r) > 6)").select("n_tile", "x", "y", "d", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("k"))
    walk = walk.select("n_tile", (F.col("x") + F.col("k")).alias("x"), "y", (F.col("d") + 1.5 * F.col("k")).alias("d"), F.col("k").cast("long").alias("k"))
    return walk.join(e, ["x", "y"]).where("d between lo - 0.5 and least(hi + 0.5, 30)").groupBy("n_tile").agg(F.min("k").alias("steps"))


@query(f"""WITH {TILE}, w AS (SELECT DISTINCT y FROM tile) SELECT w.y * 56 + g.x AS place, coalesce(floor(disparity / 10)::BIGINT, -1) AS layer FROM w CROSS JOIN range(56) g(x) LEFT JOIN tile t ON t.x = g.x AND t.y = w.y""")
def padded_layers(spark, sf_dir):
    """Layers of tiles on a grid that whole supertiles cover; -1 where there is no tile."""
    t = tile(spark, sf_dir).select("x", "y", F.floor(F.col("disparity") / 10).alias("layer"))
    padded = t.select("y").distinct().withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(55).cast("long"))))
    return padded.join(t, ["x", "y"], "left").select((F.col("y") * 56 + F.col("x")).alias("place"), F.coalesce("layer", F.lit(-1)).alias("layer"))


@query(f"""WITH {MEAS}, p AS (SELECT x // 8 AS sx, y // 8 AS sy, count(DISTINCT floor(target / 10)) AS planes FROM meas WHERE strength >= 0.8 AND n_tile % 5 = 0 GROUP BY ALL),
d AS (SELECT * FROM (VALUES (-1, 0, 0), (0, 0, -1), (1, 1, -1), (2, 1, 0), (3, 1, 1), (4, 0, 1), (5, -1, 1), (6, -1, 0), (7, -1, -1)) v(dir, dx, dy)),
c AS (SELECT a.sx, a.sy, d.dir, coalesce(b.planes, 0) AS planes FROM p a CROSS JOIN d LEFT JOIN p b ON b.sx = a.sx + d.dx AND b.sy = a.sy + d.dy)
SELECT sx, sy, dir, CASE WHEN planes > 0 THEN sum(planes) OVER (PARTITION BY sx, sy ORDER BY dir) - planes ELSE -1 END::BIGINT AS first_surface FROM c""")
def surface_numbers(spark, sf_dir):
    """The number of the first surface that a supertile takes from itself (-1) and from each neighbour by compass:
    planes of all before; -1 where it has none."""
    p = meas(spark, sf_dir).where("strength >= 0.8 and n_tile % 5 = 0").groupBy(F.expr("x div 8").alias("x"), F.expr("y div 8").alias("y")).agg(F.countDistinct(F.floor(F.col("target") / 10)).alias("planes"))
    counts = grid.pairs(p, ["planes"]).groupBy("x", "y").agg(*(F.coalesce(F.sum(F.when((F.col("dx") == dx) & (F.col("dy") == dy), F.col("n_planes"))), F.lit(0)).alias(f"p{d}") for d, (dx, dy) in enumerate(grid.RING8)))
    wide = p.join(counts, ["x", "y"], "left").fillna(0)
    names = ["planes", *(f"p{d}" for d in range(8))]
    before = [reduce(lambda a, b: a + b, (F.col(n) for n in names[:k]), F.lit(0).cast("long")) for k in range(9)]
    rows = F.array(*(F.struct(F.lit(k - 1).alias("dir"), F.when(F.col(n) > 0, b).otherwise(-1).alias("first_surface")) for k, (n, b) in enumerate(zip(names, before, strict=True))))
    return wide.select(F.col("x").alias("sx"), F.col("y").alias("sy"), F.explode(rows).alias("r")).select("sx", "sy", "r.dir", "r.first_surface")


@query(f"""WITH {MEAS}, c AS (SELECT x // 8 AS sx, y // 8 AS sy, pass_id, n_tile, max(strength) AS s FROM meas WHERE target < 20 GROUP BY ALL), k AS (SELECT * FROM c QUALIFY s > 0.6 * max(s) OVER (PARTITION BY sx, sy, pass_id)),
n AS (SELECT sx, sy, pass_id, count(*) AS n FROM k GROUP BY ALL), o AS (SELECT a.sx, a.sy, a.pass_id AS p, b.pass_id AS q, count(*) AS common FROM k a JOIN k b ON a.n_tile = b.n_tile AND a.pass_id < b.pass_id GROUP BY ALL)
SELECT o.sx, o.sy, p, q, common, round(common / n.n, 6) AS overlap FROM o JOIN n ON n.sx = o.sx AND n.sy = o.sy AND n.pass_id = p WHERE common < 0.5 * n.n""")
def merge_by_overlap(spark, sf_dir):
    """Pairs of a supertile's planes whose strong cells overlap little, against the first one's cells. A tile has at
    most as many cells as there are planes, so its pairs are few."""
    c = meas(spark, sf_dir).where("target < 20").groupBy(F.expr("x div 8").alias("sx"), F.expr("y div 8").alias("sy"), "pass_id", "n_tile").agg(F.max("strength").alias("s"))
    top = c.groupBy("sx", "sy", "pass_id").agg(F.max("s").alias("top"))
    k = c.join(top, ["sx", "sy", "pass_id"]).where("s > 0.6 * top").select("sx", "sy", "n_tile", "pass_id")
    n = k.groupBy("sx", "sy", F.col("pass_id").alias("p")).agg(F.count("*").alias("n"))
    o = k.withColumnRenamed("pass_id", "p").join(k.withColumnRenamed("pass_id", "q"), ["sx", "sy", "n_tile"]).where("p < q").groupBy("sx", "sy", "p", "q").agg(F.count("*").alias("common"))
    return o.join(n, ["sx", "sy", "p"]).where("common < 0.5 * n").select("sx", "sy", "p", "q", "common", F.round(F.col("common") / F.col("n"), 6).alias("overlap"))


@query(f"""WITH {MEAS}, k AS (SELECT n_tile, strength AS w, target AS u, target + resid AS v FROM meas WHERE strength > 0.1), s AS (SELECT n_tile, count(*) AS n, sum(w) AS sw, sum(w * u) / sum(w) AS mu, sum(w * v) / sum(w) AS mv FROM k GROUP BY n_tile),
f AS (SELECT n_tile, sum(w * (u - mu) * (v - mv)) AS cov, sum(w * (u - mu) * (u - mu)) AS var FROM k JOIN s USING (n_tile) GROUP BY n_tile), l AS (SELECT n_tile, n, sw, cov / var AS slope, mv - cov / var * mu AS shift FROM s JOIN f USING (n_tile) WHERE var > 1e-6)
SELECT n_tile, any_value(n) AS n, round(any_value(sw), 4) AS weight, round(any_value(slope), 5) AS slope, round(any_value(shift), 4) + 0.0 AS intercept, round(sqrt(sum(w * (v - slope * u - shift) ** 2) / any_value(sw)), 4) AS rms FROM k JOIN l USING (n_tile) GROUP BY n_tile""")
def scan_regression(spark, sf_dir):
    """Weighted line of measured over programmed disparity by tile, with what it leaves: moments in one shuffle, about
    a fixed middle so that little cancels."""
    u, v, w = F.col("target") - 25, F.col("target") + F.col("resid") - 25, F.col("strength")
    moments = {"sw": w, "su": w * u, "sv": w * v, "suu": w * u * u, "suv": w * u * v, "svv": w * v * v}
    s = meas(spark, sf_dir).where("strength > 0.1").groupBy("n_tile").agg(F.count("*").alias("n"), *(F.sum(m).alias(k) for k, m in moments.items()))
    s = s.selectExpr("n_tile", "n", "sw", "su / sw as mu", "sv / sw as mv", "suu - su * su / sw as var", "suv - su * sv / sw as cov", "svv - sv * sv / sw as left_over").where("var > 1e-6")
    s = s.withColumn("slope", F.col("cov") / F.col("var"))
    return s.select("n_tile", "n", F.round("sw", 4).alias("weight"), F.round("slope", 5).alias("slope"), (F.round(F.expr("mv + 25 - slope * (mu + 25)"), 4) + F.lit(0.0)).alias("intercept"), F.round(F.sqrt(F.expr("greatest(left_over - slope * cov, 0) / sw")), 4).alias("rms"))


@query(f"""WITH {TILE}, s AS (SELECT CASE WHEN x % 17 = 0 THEN -1 WHEN y % 13 = 0 THEN -2 WHEN strength < 0.75 THEN 0 ELSE 1 + floor(disparity / 10)::INT END AS state FROM tile)
SELECT count(*) FILTER (state > 0) AS assigned, count(*) FILTER (state = 0) AS unassigned, count(*) FILTER (state = -1) AS prohibited, count(*) FILTER (state = -2) AS impossible, count(DISTINCT state) FILTER (state > 0) AS layers FROM s""")
def assignment_counts(spark, sf_dir):
    """Tiles that are assigned to a layer, open, prohibited and impossible, and the layers in use."""
    state = F.when(F.col("x") % 17 == 0, -1).when(F.col("y") % 13 == 0, -2).when(F.col("strength") < 0.75, 0).otherwise(1 + F.floor(F.col("disparity") / 10))
    s = tile(spark, sf_dir).groupBy(state.alias("state")).agg(F.count("*").alias("n"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    is_ = F.col("state")
    return s.agg(total(is_ > 0).alias("assigned"), total(is_ == 0).alias("unassigned"), total(is_ == -1).alias("prohibited"), total(is_ == -2).alias("impossible"), F.count_if(is_ > 0).alias("layers"))


@query(f"WITH {MEAS} SELECT pass_id, count(*) AS n, count(DISTINCT n_tile) AS tiles FROM meas WHERE pass_id < 5 GROUP BY pass_id")
def first_passes(spark, sf_dir):
    """The passes before one, with what they hold."""
    return meas(spark, sf_dir).where("pass_id < 5").groupBy("pass_id").agg(F.count("*").alias("n"), F.countDistinct("n_tile").alias("tiles"))


def _spiral(radius: int):
    """(place, ring, dx, dy) of the cells around one, ring by ring, clockwise from the corner at the top right."""
    cells = [(0, 0, 0)]
    for r in range(1, radius + 1):
        side = range(2 * r)
        cells += [(r, r, -r + k) for k in side] + [(r, r - k, r) for k in side] + [(r, -r, r - k) for k in side] + [(r, -r + k, -r) for k in side]
    return [(place, *c) for place, c in enumerate(cells)]


_NEED, _REACH = 4, 3


@query(f"""WITH {TILE}, o AS (SELECT * FROM (VALUES {', '.join(map(str, _spiral(_REACH)))}) v(place, ring, dx, dy)),
c AS (SELECT a.n_tile, o.place, o.ring, o.dx * o.dx + o.dy * o.dy AS r2, (b.strength >= 0.8 AND (b.n_tile * 13) % 7 < 3)::INT AS good FROM tile a CROSS JOIN o JOIN tile b ON b.x = a.x + o.dx AND b.y = a.y + o.dy),
g AS (SELECT *, sum(good) OVER (PARTITION BY n_tile ORDER BY place) - good AS so_far FROM c), s AS (SELECT n_tile, sum(good) AS sd, sum(good * r2) AS sdr, count(*) AS s0, sum(r2) AS sr, CASE WHEN sum(good) >= {_NEED} THEN max(ring) ELSE {_REACH + 1} END AS r FROM g WHERE so_far < {_NEED} GROUP BY n_tile)
SELECT n_tile, round(CASE WHEN 2 * r * r * s0 - sr > 0 THEN (2 * r * r * sd - sdr) / (2 * r * r * s0 - sr) ELSE 0 END, 6) AS density FROM s""")
def trusted_density(spark, sf_dir):
    """Density of trusted tiles: outward along a spiral until enough are found or the reach ends, nearer cells count
    more. Each tile goes to the cells within reach, a fixed number; a cell's tiles are bits by place on the spiral, so nothing
    is sorted and a tile is two numbers."""
    spiral = _spiral(_REACH)
    t = tile(spark, sf_dir).select("n_tile", "x", "y", (F.coalesce((F.col("strength") >= 0.8) & ((F.col("n_tile") * 13) % 7 < 3), F.lit(False))).alias("good"))
    cells = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip((1 << c[0], *c[2:]), ("bit", "dx", "dy"), strict=True))) for c in spiral))
    sent = t.select("good", "x", "y", F.explode(cells).alias("o")).select((F.col("x") - F.col("o.dx")).alias("x"), (F.col("y") - F.col("o.dy")).alias("y"), F.col("o.bit").cast("long").alias("bit"), "good")
    seen = sent.groupBy("x", "y").agg(F.bit_or("bit").alias("there"), F.bit_or(F.when(F.col("good"), F.col("bit")).otherwise(F.lit(0).cast("long"))).alias("good"))
    c = t.select("n_tile", "x", "y").join(seen, ["x", "y"])
    last = "good"  # less its lowest bits, so that the lowest one left is that of the last tile needed
    for _ in range(_NEED - 1):
        last = f"({last} & ({last} - 1))"
    c = c.withColumn("last", F.expr(f"({last}) & -({last})"))
    c = c.withColumn("part", F.expr("case when last = 0 then there else there & (last | (last - 1)) end"))
    bits = lambda f, v: sum(1 << c[0] for c in spiral if f(c) == v)
    r2 = lambda c: c[2] ** 2 + c[3] ** 2
    by_r2 = lambda of: " + ".join(f"{v} * bit_count({of} & {bits(r2, v)}L)" for v in sorted({r2(c) for c in spiral}))
    ring = " ".join(f"when part & {bits(lambda c: c[1], k)}L <> 0 then {k}" for k in range(_REACH, -1, -1))
    sums = {"sd": "bit_count(part & good)", "sdr": by_r2("part & good"), "s0": "bit_count(part)", "sr": by_r2("part"), "r": f"case when last = 0 then {_REACH + 1} {ring} end"}
    s = c.select("n_tile", *(F.expr(v).cast("long").alias(k) for k, v in sums.items()))
    num, den = F.expr("2 * r * r * sd - sdr"), F.expr("2 * r * r * s0 - sr")
    return s.select("n_tile", F.round(F.when(den > 0, num / den).otherwise(0), 6).alias("density"))


@query(f"""WITH {MEAS}, t AS (SELECT n_tile, x, y, avg(target) AS d, max(strength) AS w FROM meas WHERE pass_id = 3 GROUP BY ALL), k AS (SELECT * FROM (VALUES (0, 0, 0), {', '.join(str((i + 1, *d)) for i, d in enumerate(grid.RING8))}) v(mask, ux, uy)),
p AS (SELECT a.n_tile, mask, sum(b.w) AS sw, sum(b.w * b.d) AS sd, sum(b.w * b.d * b.d) AS sdd FROM t a JOIN t b ON abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 CROSS JOIN k WHERE (b.x - a.x) * ux + (b.y - a.y) * uy >= 0 AND b.w >= 0.2 GROUP BY ALL),
v AS (SELECT n_tile, mask, sd / sw AS mean, round(sdd / sw - (sd / sw) ** 2, 5) AS var FROM p)
SELECT n_tile, min_by(mask, (var, mask)) AS mask, round(min_by(mean, (var, mask)), 5) AS mean FROM v WHERE mean BETWEEN 5 AND 27 GROUP BY n_tile""")
def far_masks(spark, sf_dir):
    """The best of a whole neighbourhood and its eight halves for each tile: mean within the far range, least
    variance. All nine come out of one grouping."""
    t = meas(spark, sf_dir).where("pass_id = 3").groupBy("n_tile", "x", "y").agg(F.avg("target").alias("d"), F.max("strength").alias("w"))
    around = F.explode(grid.offsets([(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3)]))
    sent = t.where("w >= 0.2").select("d", "w", "x", "y", around.alias("o")).select((F.col("x") - F.col("o.dx")).alias("x"), (F.col("y") - F.col("o.dy")).alias("y"), "o.dx", "o.dy", "d", "w")
    sums = []
    for k, (ux, uy) in enumerate(((0, 0), *grid.RING8)):
        inside = F.col("dx") * ux + F.col("dy") * uy >= 0
        sums += [F.sum(F.when(inside, v)).alias(f"{n}{k}") for n, v in (("sw", F.col("w")), ("sd", F.col("w") * F.col("d")), ("sdd", F.col("w") * F.col("d") * F.col("d")))]
    p = t.select("n_tile", "x", "y").join(sent, ["x", "y"]).groupBy("n_tile").agg(*sums)
    mean = lambda k: F.col(f"sd{k}") / F.col(f"sw{k}")
    masks = F.array(*(F.struct(F.round(F.col(f"sdd{k}") / F.col(f"sw{k}") - mean(k) * mean(k), 5).alias("var"), F.lit(k).alias("mask"), mean(k).alias("mean")) for k in range(9)))
    best = F.array_min(F.filter(masks, lambda m: (m["mean"] >= 5) & (m["mean"] <= 27)))
    return p.select("n_tile", best.alias("b")).where("b is not null").select("n_tile", "b.mask", F.round("b.mean", 5).alias("mean"))


@query(f"""WITH {MEAS}, t AS (SELECT n_tile, x, y, avg(target) AS d, max(strength) AS w FROM meas WHERE pass_id = 4 AND strength > 0 GROUP BY ALL), s AS (SELECT a.x, a.y, b.d, b.w FROM t a JOIN t b ON abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2),
h AS (SELECT x, y, floor(d / 4)::INT AS bin, round(sum(w), 5) AS w FROM s GROUP BY ALL), n AS (SELECT *, CASE WHEN lag(bin) OVER o = bin - 1 THEN lag(w) OVER o ELSE 0 END AS a, CASE WHEN lead(bin) OVER o = bin + 1 THEN lead(w) OVER o ELSE 0 END AS b FROM h WINDOW o AS (PARTITION BY x, y ORDER BY bin)),
p AS (SELECT x, y, min_by(4 * (bin + 0.5 + CASE WHEN a + b - 2 * w < 0 THEN 0.5 * (a - b) / (a + b - 2 * w) ELSE 0 END), bin) AS peak FROM n WHERE w > a AND w >= b GROUP BY x, y)
SELECT x, y, round(any_value(peak), 5) AS peak, count(*) AS n, round(sum(w * d) / sum(w), 5) AS disparity FROM s JOIN p USING (x, y) WHERE abs(d - peak) <= 3.1416 GROUP BY x, y""")
def farthest_peak(spark, sf_dir):
    """The farthest local maximum of each tile's neighbourhood histogram, refined, and the weighted mean around it."""
    t = meas(spark, sf_dir).where("pass_id = 4 and strength > 0").groupBy("n_tile", "x", "y").agg(F.avg("target").alias("d"), F.max("strength").alias("w"))
    around = F.explode(grid.offsets([(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3)]))
    sent = t.select("d", "w", "x", "y", around.alias("o")).select((F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), "d", "w")
    s = sent.join(t.select("x", "y"), ["x", "y"], "left_semi")
    h = s.groupBy("x", "y", F.floor(F.col("d") / 4).cast("int").alias("bin")).agg(F.round(F.sum("w"), 5).alias("w"))
    o = Window.partitionBy("x", "y").orderBy("bin")
    a = F.when(F.lag("bin").over(o) == F.col("bin") - 1, F.lag("w").over(o)).otherwise(0.0)
    b = F.when(F.lead("bin").over(o) == F.col("bin") + 1, F.lead("w").over(o)).otherwise(0.0)
    n = h.withColumn("a", a).withColumn("b", b).where("w > a and w >= b")
    peak = F.expr("4 * (bin + 0.5 + case when a + b - 2 * w < 0 then 0.5 * (a - b) / (a + b - 2 * w) else 0 end)")
    p = n.groupBy("x", "y").agg(F.min_by(peak, "bin").alias("peak"))
    near = s.join(p, ["x", "y"]).where("abs(d - peak) <= 3.1416")
    return near.groupBy("x", "y").agg(F.round(F.first("peak"), 5).alias("peak"), F.count("*").alias("n"), F.round(F.sum(F.col("w") * F.col("d")) / F.sum("w"), 5).alias("disparity"))

"""Queries on lenses: distortion and its inverse, places in the world, planes and sensors of a rig."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry
from .views import MEAS, meas

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


#: Corners of the image lie past the table's end.
CAMERA = geometry.Camera(most=1.1)
_STEP, _LAST = CAMERA.step, len(geometry.reverse_table(CAMERA)) - 1


def _ratio(r: str) -> str:
    c, b, a = CAMERA.coefficients
    return f"((({a!r} * ({r}) + {b!r}) * ({r}) + {c!r}) * ({r}) + {1 - a - b - c!r})"


def _slope(r: str) -> str:
    c, b, a = CAMERA.coefficients
    return f"(((4 * {a!r} * ({r}) + 3 * {b!r}) * ({r}) + 2 * {c!r}) * ({r}) + {1 - a - b - c!r})"


#: Pixels of the stand-in, and the table by 40 Newton steps for each radius.
_SEEN = f"""{MEAS}, seen AS (SELECT n_tile, pass_id, src, target, resid, price % 2592 AS px, (n_tile * 7 + pass_id * 31) % 1936 + 0.5 AS py FROM meas),
tab AS (SELECT k, CASE WHEN k = 0 THEN 1 / {_ratio('0.0')} ELSE list_reduce([k * {_STEP}] || list_transform(range(40), lambda i: 0.0), lambda r, i: r - (r * {_ratio('r')} - k * {_STEP}) / {_slope('r')}) / (k * {_STEP}) END AS v FROM (SELECT unnest(range({_LAST + 1})) AS k))"""


def _inverse(name: str, source: str, height: int) -> str:
    """{name}: source with ax, ay, the pixel from the middle as an ideal lens shows it."""
    return f"""{name}_r AS (SELECT *, px - {CAMERA.width / 2} AS dx, py - {height / 2} AS dy, sqrt((px - {CAMERA.width / 2}) ** 2 + (py - {height / 2}) ** 2) * {CAMERA.scale!r} AS r FROM {source}),
{name} AS (SELECT s.*, dx * k AS ax, dy * k AS ay FROM (SELECT s.*, CASE WHEN floor(r / {_STEP}) < {_LAST} THEN t.v + (u.v - t.v) * (r / {_STEP} - floor(r / {_STEP})) ELSE 'nan'::DOUBLE END AS k
  FROM {name}_r s LEFT JOIN tab t ON t.k = floor(r / {_STEP})::BIGINT LEFT JOIN tab u ON u.k = floor(r / {_STEP})::BIGINT + 1) s)"""


def _seen(spark, sf_dir):
    m = meas(spark, sf_dir)
    return m.select("n_tile", "pass_id", "src", "target", "resid", (F.col("price") % 2592).alias("px"), ((F.col("n_tile") * 7 + F.col("pass_id") * 31) % 1936 + 0.5).alias("py"))


_BASE, _DEPTH = 0.001 * CAMERA.base, CAMERA.focal / (0.001 * CAMERA.pixel)


@query(f"""WITH {_SEEN}, {_inverse('a', 'seen', CAMERA.height)},
w AS (SELECT *, {_BASE!r} / target * ax AS wx, -{_BASE!r} / target * ay AS wy, -{_BASE!r} / target * {_DEPTH!r} AS wz FROM a),
b AS (SELECT *, sqrt(ax ** 2 + ay ** 2) * {CAMERA.scale!r} AS q FROM w)
SELECT n_tile, pass_id, src, target, round(px, 4) AS px, round(wx, 6) AS wx, round(wy, 6) AS wy, round(wz, 6) AS wz, round(target, 6) AS back_disparity, round(ax * {_ratio('q')} + {CAMERA.width / 2}, 4) AS back_px, round(ay * {_ratio('q')} + {CAMERA.height / 2}, 4) AS back_py FROM b""")
def distorted_world(spark, sf_dir):
    """Pixels through the lens into the world and back; NaN where the table of the lens ends."""
    s = _seen(spark, sf_dir)
    w = geometry.world(CAMERA, F.col("px"), F.col("py"), F.col("target"))
    s = s.select("*", *(v.alias(n) for v, n in zip(w, ("wx", "wy", "wz"), strict=True)))
    back = geometry.image(CAMERA, F.col("wx"), F.col("wy"), F.col("wz"))
    return s.select("n_tile", "pass_id", "src", "target", F.round("px", 4).alias("px"), *(F.round(n, 6).alias(n) for n in ("wx", "wy", "wz")), F.round(back[0], 6).alias("back_disparity"), F.round(back[1], 4).alias("back_px"), F.round(back[2], 4).alias("back_py"))


def _port(k: int) -> str:
    x, y = CAMERA.ports[k]
    across, below = f"(ax - target * {x})", f"(ay - target * {y})"
    bend = _ratio(f"sqrt({across} ** 2 + {below} ** 2) * {CAMERA.scale!r}")
    return f"round({across} * {bend} + {CAMERA.width / 2}, 4) AS x{k}, round({below} * {bend} + {CAMERA.width / 2}, 4) AS y{k}"


@query(f"WITH {_SEEN}, {_inverse('a', 'seen', CAMERA.width)} SELECT n_tile, pass_id, src, round(px, 4) AS px, {', '.join(_port(k) for k in range(4))} FROM a")
def ideal_ports(spark, sf_dir):
    """Pixels that four sensors see of what the middle sees."""
    ports = geometry.port_pixels(CAMERA, F.col("px"), F.col("py"), F.col("target"))
    at = [F.round(v, 4).alias(f"{n}{k}") for k, port in enumerate(ports) for v, n in zip(port, "xy", strict=True)]
    return _seen(spark, sf_dir).select("n_tile", "pass_id", "src", F.round("px", 4).alias("px"), *at)


@query(f"""WITH {_SEEN}, {_inverse('a', 'seen', CAMERA.height)}
SELECT n_tile, pass_id, src, round(px, 4) AS px, round(({_BASE!r} * ax * resid * 10 - {_BASE!r} * ay * 0.2 - {_BASE!r} * {_DEPTH!r} * -(target + 1)) / ((resid * 10) ** 2 + 0.2 ** 2 + (target + 1) ** 2), 6) AS disparity FROM a""")
def plane_disparities(spark, sf_dir):
    """Disparity at which a pixel's ray meets a tilted plane."""
    normal = (F.col("resid") * 10, F.lit(0.2), -(F.col("target") + 1))
    return _seen(spark, sf_dir).select("n_tile", "pass_id", "src", F.round("px", 4).alias("px"), F.round(geometry.plane_disparity(CAMERA, normal, F.col("px"), F.col("py")), 6).alias("disparity"))

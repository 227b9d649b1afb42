"""Vectors, matrices, boxes and Bezier segments as columns.

A vector is struct(x, y), a matrix an array (a, b, c, d, e, f) that maps (x, y) to
(a x + c y + e, b x + d y + f), a box struct(x0, y0, x1, y1) with x0 <= x1 and y0 <= y1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Num = Column | float | int


def _c(x: Num) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def vec(x: Num, y: Num) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def vec_add(p: Column, q: Column) -> Column:
    return vec(p["x"] + q["x"], p["y"] + q["y"])


def vec_sub(p: Column, q: Column) -> Column:
    return vec(p["x"] - q["x"], p["y"] - q["y"])


def vec_scale(p: Column, k: Num) -> Column:
    return vec(p["x"] * _c(k), p["y"] * _c(k))


def vec_neg(p: Column) -> Column:
    return vec(-p["x"], -p["y"])


def dot(p: Column, q: Column) -> Column:
    return p["x"] * q["x"] + p["y"] * q["y"]


def mat(*xs: Num) -> Column:
    """A matrix from six numbers; without any, the identity."""
    return F.array(*[_c(x).cast("double") for x in xs or (1, 0, 0, 1, 0, 0)])


def valid_mat(m: Column) -> Column:
    """m if it has six elements, none of them null; else null."""
    return F.when((F.size(m) == 6) & F.forall(m, lambda x: x.isNotNull()), m)


def mat_vec(m: Column, p: Column) -> Column:
    return vec(m[0] * p["x"] + m[2] * p["y"] + m[4], m[1] * p["x"] + m[3] * p["y"] + m[5])


def let(f, *xs: Column) -> Column:
    """f of xs, each of which is computed once, however often f uses it."""
    bound = F.struct(*[x.alias(f"v{i}") for i, x in enumerate(xs)])
    return F.transform(F.array(bound), lambda s: f(*[s[f"v{i}"] for i in range(len(xs))]))[0]


def mat_mul(m: Column, n: Column) -> Column:
    """The matrix that applies n first, then m."""
    return let(_product, m, n)


def _product(m: Column, n: Column) -> Column:
    out = []
    for k in (0, 2, 4):
        shift = (m[4], m[5]) if k == 4 else (F.lit(0.0), F.lit(0.0))
        out += [m[r] * n[k] + m[r + 2] * n[k + 1] + shift[r] for r in (0, 1)]
    return F.array(*out)


def det(m: Column) -> Column:
    return m[0] * m[3] - m[1] * m[2]


def inverse(m: Column) -> Column:
    """The inverse; null where the determinant is 0."""
    return let(_inverse, m)


def _inverse(m: Column) -> Column:
    d = det(m)
    rows = (m[3], -m[1], -m[2], m[0], m[2] * m[5] - m[3] * m[4], m[1] * m[4] - m[0] * m[5])
    return F.when(d != 0, F.array(*[F.try_divide(x, d) for x in rows]))


def box(x0: Num, y0: Num, x1: Num, y1: Num) -> Column:
    """The box of two opposite corners."""
    a, b, c, d = (_c(v).cast("double") for v in (x0, y0, x1, y1))
    return F.struct(F.least(a, c).alias("x0"), F.least(b, d).alias("y0"), F.greatest(a, c).alias("x1"), F.greatest(b, d).alias("y1"))


def box_w(b: Column) -> Column:
    return b["x1"] - b["x0"]


def box_h(b: Column) -> Column:
    return b["y1"] - b["y0"]


def box_ll(b: Column) -> Column:
    return vec(b["x0"], b["y0"])


def box_ur(b: Column) -> Column:
    return vec(b["x1"], b["y1"])


def mat_box(m: Column, b: Column) -> Column:
    """The box of a box's transformed corners."""
    return let(_corners, m, b)


def _corners(m: Column, b: Column) -> Column:
    ps = [mat_vec(m, vec(b[x], b[y])) for x in ("x0", "x1") for y in ("y0", "y1")]
    xs, ys = [p["x"] for p in ps], [p["y"] for p in ps]
    return F.struct(F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"))


def box_add(a: Column, b: Column) -> Column:
    """The least box that holds both; least and greatest skip nulls."""
    return F.struct(F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"))


def box_scale(b: Column, k: Num) -> Column:
    """The box scaled about its centre."""
    cx, cy = (b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2
    hw, hh = box_w(b) / 2 * _c(k), box_h(b) / 2 * _c(k)
    return box(cx - hw, cy - hh, cx + hw, cy + hh)


def box_meet(a: Column, b: Column) -> Column:
    """The greatest box within both, null if they don't touch."""
    x0, y0 = F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"])
    x1, y1 = F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"])
    return F.when((x0 <= x1) & (y0 <= y1), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def vec_in_box(p: Column, b: Column) -> Column:
    return p["x"].between(b["x0"], b["x1"]) & p["y"].between(b["y0"], b["y1"])


def box_in_box(a: Column, b: Column) -> Column:
    return vec_in_box(box_ll(a), b) & vec_in_box(box_ur(a), b)


def box_to_box(target: Column, source: Column) -> Column:
    """The matrix that maps source onto target."""
    sx, sy = F.try_divide(box_w(target), box_w(source)), F.try_divide(box_h(target), box_h(source))
    return mat(sx, 0, 0, sy, target["x0"] - sx * source["x0"], target["y0"] - sy * source["y0"])


def default_box(kind: Column, crop: Column, media: Column, form: Column) -> Column:
    """Of a page its crop box or else its media box, of a form its own, of an image the unit square."""
    return F.when(kind == "Page", F.coalesce(crop, media)).when(kind == "Form", form).when(kind == "Image", box(0, 0, 1, 1))


# Bezier segments: control points p0..p3 as vectors, or their symmetric form: middle q of the chord, half
# chord r, and the even and odd parts b and f of the inner control points.


def cross(p: Column, q: Column) -> Column:
    return p["x"] * q["y"] - p["y"] * q["x"]


def bezier_symmetric(p0: Column, p1: Column, p2: Column, p3: Column) -> Column:
    ends, inner = vec_add(p0, p3), vec_add(p1, p2)
    return F.struct(
        vec_scale(ends, 0.5).alias("q"),
        vec_scale(vec_sub(p3, p0), 0.5).alias("r"),
        vec_scale(vec_sub(inner, ends), 0.5).alias("b"),
        vec_scale(vec_sub(vec_sub(p0, p1), vec_sub(p3, p2)), 0.5).alias("f"),
    )


def bezier_points(z: Column) -> Column:
    """The control points of a symmetric form, as an array of vectors."""
    start, end = vec_sub(z["q"], z["r"]), vec_add(z["q"], z["r"])
    return F.array(start, vec_add(start, vec_sub(z["b"], z["f"])), vec_add(end, vec_add(z["b"], z["f"])), end)


def points_of(xs: Column) -> Column:
    """Numbers x0, y0, x1, y1 .. as vectors; an odd one out is dropped."""
    n = F.floor(F.size(xs) / 2).cast("int")
    at = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    return F.when(n > 0, F.transform(at, lambda i: vec(F.element_at(xs, i * 2 - 1), F.element_at(xs, i * 2)))).otherwise(F.array().cast("array<struct<x:double,y:double>>"))


def numbers_of(ps: Column) -> Column:
    """Vectors as numbers x0, y0, x1, y1 .."""
    return F.flatten(F.transform(ps, lambda p: F.array(p["x"], p["y"])))


def bezier_area(z: Column) -> Column:
    """Area that the line from the origin to the curve's point sweeps."""
    return let(_area, z)


def _area(z: Column) -> Column:
    return cross(z["q"], z["r"]) + cross(z["b"], z["r"]) * 1.2 + cross(z["b"], z["f"]) * 0.3


def bezier_scale_for_area(z: Column, area: Column) -> Column:
    """Factor k, nearest 1, by which b and f are scaled for the curve to sweep area; null if there is none."""
    terms = lambda x: F.array(cross(x["q"], x["r"]), cross(x["b"], x["r"]) * 1.2, cross(x["b"], x["f"]) * 0.3)
    return let(_scale, let(terms, z), area)


def _scale(terms: Column, area: Column) -> Column:
    base, lin, quad = terms[0] - area, terms[1], terms[2]
    disc = lin * lin - quad * base * 4
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    one, two = F.try_divide(root - lin, quad * 2), F.try_divide(-root - lin, quad * 2)
    near = F.when(F.abs(one - 1) <= F.abs(two - 1), one).otherwise(two)
    return F.when((quad == 0) & (lin != 0), F.try_divide(-base, lin)).when((quad != 0) & (disc >= 0), near)


def box_grown(b: Column, p: Column) -> Column:
    """The box enlarged to hold a point."""
    return box_add(b, F.struct(p["x"].alias("x0"), p["y"].alias("y0"), p["x"].alias("x1"), p["y"].alias("y1")))


def horner(coefficients: Column, x: Column) -> Column:
    """The polynomial at x; the first coefficient belongs to the highest power."""
    return F.aggregate(coefficients, F.lit(0.0), lambda acc, k: acc * x + k)


def ocr_baseline(y0: Column, y1: Column) -> Column:
    """Baseline of a recognised line: four fifths of the way from y0 to y1."""
    return (y1 * 4 + y0) / 5


def ocr_to_page(rotate: Column, zone: Column, page: Column) -> Column:
    """Matrix from the pixels of a recognised page (zone) to the page's box, by the page's rotation."""
    w, h = box_w(zone), box_h(zone)
    turned = rotate.isin(90, 270)
    sx = F.try_divide(box_w(page), F.when(turned, h).otherwise(w))
    sy = F.try_divide(box_h(page), F.when(turned, w).otherwise(h))
    turn = F.when(rotate == 90, mat(0, 1, -1, 0, h, 0)).when(rotate == 180, mat(-1, 0, 0, -1, w, h)).when(rotate == 270, mat(0, -1, 1, 0, 0, w)).otherwise(mat())
    fit = mat(sx, 0, 0, sy, page["x0"], page["y0"])
    return mat_mul(mat_mul(fit, turn), mat(1, 0, 0, 1, -zone["x0"], -zone["y0"]))

"""Box, camera and point geometry over columns; vectors are arrays of doubles, matrices row-major."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rewardloom.functions.bind import let


def _sum3(f) -> Column:
    return f(0) + f(1) + f(2)


def _rotation(box: Column) -> Column:
    """R = Ry Rx Rz, row-major, for the box angles (x, y, z) at places 6, 7, 8."""
    angle = lambda i: F.coalesce(F.get(box, F.lit(i)), F.lit(0.0))
    trig = F.struct(*[f(angle(i)).alias(n) for i, a in ((6, "x"), (7, "y"), (8, "z")) for f, n in ((F.cos, f"c{a}"), (F.sin, f"s{a}"))])
    return let(trig, lambda t: F.array(
        t["cy"] * t["cz"] + t["sy"] * t["sx"] * t["sz"], t["sy"] * t["sx"] * t["cz"] - t["cy"] * t["sz"], t["sy"] * t["cx"],
        t["cx"] * t["sz"], t["cx"] * t["cz"], -t["sx"],
        t["cy"] * t["sx"] * t["sz"] - t["sy"] * t["cz"], t["sy"] * t["sz"] + t["cy"] * t["sx"] * t["cz"], t["cy"] * t["cx"],
    ))


def hull(box: Column) -> Column:
    """Axis-aligned hull (lo, hi) of a rotated box [x, y, z, w, h, l, rx, ry, rz].

    The half extent along an axis is the sum of the absolute rotated half sizes.
    """
    at = lambda i: F.get(box, F.lit(i))
    reach = lambda r, i: _sum3(lambda j: F.abs(F.get(r, F.lit(3 * i + j))) * at(3 + j) / 2)
    halves = let(_rotation(box), lambda r: F.array(*[reach(r, i) for i in range(3)]))
    side = lambda h, sign: F.array(*[at(i) + F.get(h, F.lit(i)) * sign for i in range(3)])
    return let(halves, lambda h: F.struct(side(h, -1.0).alias("lo"), side(h, 1.0).alias("hi")))


def _volume(lo, hi) -> Column:
    out = F.lit(1.0)
    for i in range(3):
        out = out * F.greatest(hi(i) - lo(i), F.lit(0.0))
    return out


def giou(a: Column, b: Column) -> Column:
    """Generalised overlap of two hulls, in [-1, 1]."""
    at = lambda h, side, i: F.get(h[side], F.lit(i))
    size = lambda h: _volume(lambda i: at(h, "lo", i), lambda i: at(h, "hi", i))
    shared = _volume(lambda i: F.greatest(at(a, "lo", i), at(b, "lo", i)), lambda i: F.least(at(a, "hi", i), at(b, "hi", i)))
    around = _volume(lambda i: F.least(at(a, "lo", i), at(b, "lo", i)), lambda i: F.greatest(at(a, "hi", i), at(b, "hi", i)))
    parts = F.struct((size(a) + size(b)).alias("both"), shared.alias("shared"), around.alias("around"))

    def ratio(p: Column) -> Column:
        union = p["both"] - p["shared"]
        iou = F.when(union == 0, 0.0).otherwise(p["shared"] / union)
        return F.when(p["around"] == 0, iou).otherwise(iou - (p["around"] - union) / p["around"])

    return let(parts, ratio)


def giou_matrix(rows: Column, columns: Column) -> Column:
    """giou of every row hull with every column hull of one sample."""
    return F.transform(rows, lambda r: F.transform(columns, lambda c: giou(r, c)))


def greedy_match(matrix: Column) -> Column:
    """For each matrix row in turn the best unused column (ties to the first): array of (row, column, score).

    Rows must not outnumber columns, so every row finds one."""
    start = F.struct(F.array().cast("array<int>").alias("used"),
                     F.array().cast("array<struct<r:int,c:int,s:double>>").alias("out"))

    def step(acc: Column, row: Column) -> Column:
        scored = F.transform(row, lambda s, c: F.struct(s.alias("s"), (-c).alias("c")))
        best = F.array_max(F.filter(scored, lambda x: ~F.array_contains(acc["used"], -x["c"])))
        n = F.size(acc["out"])
        hit = F.struct(n.cast("int").alias("r"), (-best["c"]).cast("int").alias("c"), best["s"].alias("s"))
        found = best.isNotNull()
        return F.struct(
            F.when(found, F.concat(acc["used"], F.array((-best["c"]).cast("int")))).otherwise(acc["used"]).alias("used"),
            F.when(found, F.concat(acc["out"], F.array(hit))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(matrix, start, step, lambda acc: acc["out"])


def corners(box: Column) -> Column:
    """Eight corner points of a rotated box."""
    signs = [(x, y, z) for z in (-1.0, 1.0) for y in (-1.0, 1.0) for x in (-1.0, 1.0)]
    at = lambda i: F.get(box, F.lit(i))
    entry = lambda r, i, s: _sum3(lambda j: F.get(r, F.lit(3 * i + j)) * at(3 + j) / 2 * s[j]) + at(i)
    return let(_rotation(box), lambda r: F.array(*[F.array(*[entry(r, i, s) for i in range(3)]) for s in signs]))


def transform_point(matrix: Column, point: Column) -> Column:
    """First three rows of a 4x4 matrix times a point."""
    m = lambda i, j: F.get(matrix, F.lit(4 * i + j))
    return F.array(*[_sum3(lambda j, i=i: m(i, j) * F.get(point, F.lit(j))) + m(i, 3) for i in range(3)])


def inverse_rigid(pose: Column, point: Column) -> Column:
    """World point in the frame of a camera-to-world pose: transposed rotation of (point - translation)."""
    m = lambda i, j: F.get(pose, F.lit(4 * i + j))
    return F.array(*[_sum3(lambda i, j=j: m(i, j) * (F.get(point, F.lit(i)) - m(i, 3))) for j in range(3)])


def project_box(box: Column, k: Column, extrinsic: Column) -> Column:
    """Image box (u0, v0, u1, v1) of the projected corners; null when all lie behind the camera."""
    return _image_box(F.transform(corners(box), lambda p: transform_point(extrinsic, p)), k)


def _image_box(seen: Column, k: Column) -> Column:
    kk = lambda i, j: F.get(k, F.lit(3 * i + j))
    row = lambda p, i: _sum3(lambda j: kk(i, j) * F.get(p, F.lit(j)))

    def pixels(points: Column) -> Column:
        rows = F.transform(points, lambda p: F.array(row(p, 0), row(p, 1), row(p, 2), F.get(p, F.lit(2))))
        depth = lambda q: F.get(q, F.lit(2)) + 1e-8
        return F.transform(rows, lambda q: F.struct((F.get(q, F.lit(0)) / depth(q)).alias("u"), (F.get(q, F.lit(1)) / depth(q)).alias("v"),
                                                    F.get(q, F.lit(3)).alias("z")))

    side = lambda uv, f, c: f(F.transform(uv, lambda x: x[c]))
    box = lambda uv: F.when(side(uv, F.array_max, "z") > 0, F.struct(
        side(uv, F.array_min, "u").alias("u0"), side(uv, F.array_min, "v").alias("v0"),
        side(uv, F.array_max, "u").alias("u1"), side(uv, F.array_max, "v").alias("v1")))
    return let(pixels(seen), box)


def iou_2d(a: Column, b: Column) -> Column:
    w = F.least(a["u1"], b["u1"]) - F.greatest(a["u0"], b["u0"])
    h = F.least(a["v1"], b["v1"]) - F.greatest(a["v0"], b["v0"])
    area = lambda x: (x["u1"] - x["u0"]) * (x["v1"] - x["v0"])
    union = area(a) + area(b) - w * h
    return F.when((w <= 0) | (h <= 0) | (union == 0), 0.0).otherwise(w * h / union)


def visible(box: Column, width: Column, height: Column) -> Column:
    out = (box["u1"] < 0) | (box["u0"] > width) | (box["v1"] < 0) | (box["v0"] > height)
    flat = (box["u1"] <= box["u0"]) | (box["v1"] <= box["v0"])
    return box.isNotNull() & ~out & ~flat


def reproject(u: Column, v: Column, depth: Column, k1: Column, pose1: Column, k2: Column, pose2: Column) -> Column:
    """Pixel and depth in view 2 of a view-1 pixel with known depth: (u, v, z)."""
    kk = lambda k, i, j: F.get(k, F.lit(3 * i + j))
    camera = F.array((u - kk(k1, 0, 2)) * depth / kk(k1, 0, 0), (v - kk(k1, 1, 2)) * depth / kk(k1, 1, 1), depth)
    row = lambda p, i: _sum3(lambda j: kk(k2, i, j) * F.get(p, F.lit(j)))
    image = lambda p: F.array(row(p, 0), row(p, 1), row(p, 2), F.get(p, F.lit(2)))
    at = lambda q, i: F.get(q, F.lit(i))
    scale = lambda q: F.when(F.abs(at(q, 2)) < 1e-8, 1e-8).otherwise(at(q, 2))
    pixel = lambda q: F.struct((at(q, 0) / scale(q)).alias("u"), (at(q, 1) / scale(q)).alias("v"), at(q, 3).alias("z"))
    world = let(camera, lambda c: transform_point(pose1, c))
    return let(let(let(world, lambda w: inverse_rigid(pose2, w)), image), pixel)

"""Image overlap of matched boxes for a whole Arrow batch, as ``geometry`` spells it for one row.

Only rows of plain numbers are answered; a row with nulls, short lists or numbers that are not finite is null here and left to the expressions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_CORNERS = np.array([(x, y, z) for z in (-1.0, 1.0) for y in (-1.0, 1.0) for x in (-1.0, 1.0)])


def _lengths(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Length of each list, 0 for null, and where its values begin."""
    sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    return sizes, np.cumsum(sizes) - sizes


def _numbers(lists: pa.Array, width: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the first ``width`` numbers, 0 beyond the end, and which lists have ``least`` and no odd ones."""
    sizes, starts = _lengths(lists)
    flat = np.append(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), 0.0)
    places = np.arange(width)[:, None]
    found = np.where(places < sizes, flat[np.minimum(starts + places, len(flat) - 1)], 0.0)
    return found, (sizes >= least) & np.isfinite(found).all(0)


def _sum3(f) -> np.ndarray:
    return f(0) + f(1) + f(2)


def _seen(box: np.ndarray, k: np.ndarray, extrinsic: np.ndarray) -> tuple[np.ndarray, ...]:
    """Image box u0, v0, u1, v1, whether a corner lies before the camera, depth of the middle, and whether all is finite."""
    (cx, cy, cz), (sx, sy, sz) = np.cos(box[6:9]), np.sin(box[6:9])
    turn = (cy * cz + sy * sx * sz, sy * sx * cz - cy * sz, sy * cx, cx * sz, cx * cz, -sx, cy * sx * sz - sy * cz, sy * sz + cy * sx * cz, cy * cx)
    place = lambda point, i: _sum3(lambda j: extrinsic[4 * i + j] * point[j]) + extrinsic[4 * i + 3]
    us, vs, zs = [], [], []
    for s in _CORNERS:
        corner = [_sum3(lambda j, i=i: turn[3 * i + j] * box[3 + j] / 2 * s[j]) + box[i] for i in range(3)]
        point = [place(corner, i) for i in range(3)]
        row = [_sum3(lambda j, i=i: k[3 * i + j] * point[j]) for i in range(3)]
        us.append(row[0] / (row[2] + 1e-8))
        vs.append(row[1] / (row[2] + 1e-8))
        zs.append(point[2])
    edges = [np.min(us, 0), np.min(vs, 0), np.max(us, 0), np.max(vs, 0)]
    depth = place(box, 2)
    return *edges, np.max(zs, 0) > 0, depth, np.isfinite(us).all(0) & np.isfinite(vs).all(0) & np.isfinite(zs).all(0) & np.isfinite(depth)


def _rewards(predicted: pa.Array, gold: pa.Array, matches: pa.Array, cameras: pa.Array, min_iou: float, depth_scale: float) -> pa.Array:
    rows = len(matches)
    odd = np.logical_or.reduce([x.is_null().to_numpy(zero_copy_only=False) for x in (predicted, gold, matches, cameras)])
    (per_match, first_match), (per_camera, first_camera) = _lengths(matches), _lengths(cameras)
    matched, seen_by = matches.flatten(), cameras.flatten()
    pairs = np.where(odd, 0, per_match * per_camera)
    row = np.repeat(np.arange(rows), pairs)
    at = np.arange(len(row)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    match, camera = first_match[row] + at % per_match[row], first_camera[row] + at // per_match[row]
    good = (matched.is_valid().to_numpy(zero_copy_only=False))[match] & seen_by.is_valid().to_numpy(zero_copy_only=False)[camera]
    pick = lambda values: values.to_numpy(zero_copy_only=False).astype(np.float64)
    boxes = []
    for lists, name in ((predicted, "pred"), (gold, "gold")):
        sizes, starts = _lengths(lists)
        numbers, plain = _numbers(lists.flatten(), 9, 6)
        own = pick(matched.field(name))[match]
        there = (own >= 0) & (own < sizes[row])
        index = np.where(there, starts[row] + np.where(there, own, 0).astype(np.int64), 0)
        good &= there
        if len(plain):
            good &= plain[index]
        boxes.append(numbers[:, index] if len(plain) else np.zeros((9, len(row))))
    k, plain_k = _numbers(seen_by.field("k"), 9, 9)
    extrinsic, plain_e = _numbers(seen_by.field("extrinsic"), 12, 12)
    width, height = pick(seen_by.field("width"))[camera], pick(seen_by.field("height"))[camera]
    good &= plain_k[camera] & plain_e[camera] & np.isfinite(width) & np.isfinite(height)
    with np.errstate(all="ignore"):
        (pu0, pv0, pu1, pv1, before, zp, fine_p), (u0, v0, u1, v1, gold_before, zg, fine_g) = (_seen(b, k[:, camera], extrinsic[:, camera]) for b in boxes)
        good &= fine_p & fine_g
        w, h = np.minimum(pu1, u1) - np.maximum(pu0, u0), np.minimum(pv1, v1) - np.maximum(pv0, v0)
        union = (pu1 - pu0) * (pv1 - pv0) + (u1 - u0) * (v1 - v0) - w * h
        iou = np.where((w <= 0) | (h <= 0) | (union == 0), 0.0, w * h / union)
        seen = before & gold_before & ~((u1 < 0) | (u0 > width) | (v1 < 0) | (v0 > height)) & ~((u1 <= u0) | (v1 <= v0))
        deep = seen & (iou > min_iou) & (zp > 0) & (zg > 0)
        score = 1.0 / (1.0 + np.abs(zp - zg) / (zg + 1e-6) / depth_scale)
        means = []
        for values, on in ((iou, seen), (score, deep)):
            n = np.bincount(row, on, rows)
            means.append(np.where(n > 0, np.bincount(row, np.where(on, values, 0.0), rows) / n, 0.0))
    odd |= np.bincount(row, ~good | (seen & ~np.isfinite(iou)) | (deep & ~np.isfinite(score)), rows) > 0
    return pa.StructArray.from_arrays([pa.array(m) for m in means], names=["overlap", "depth"], mask=pa.array(odd))


def projected(predicted: Column, gold: Column, matches: Column, cameras: Column, min_iou: float, depth_scale: float) -> Column:
    """(overlap, depth): mean image overlap and depth score of each row; null where a row is not plain."""

    def run(p: pa.Array, g: pa.Array, m: pa.Array, c: pa.Array) -> pa.Array:
        return _rewards(p, g, m, c, min_iou, depth_scale)

    return F.arrow_udf(lambda p, g, m, c: run(p, g, m, c), "struct<overlap:double,depth:double>")(predicted, gold, matches, cameras)

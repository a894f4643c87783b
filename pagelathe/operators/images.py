"""Kernels on grey and colour planes: one numpy step a row, sizes known from the row.

An image is width, height and its bytes row by row (grey: one a pixel; colour:
four, red green blue alpha).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
MAGIC = {"jpeg": "FFD8FF", "png": "89504E470D0A1A0A", "gif": "47494638", "bmp": "424D"}
STEEPEST, COARSE, FINE, LEAST_SKEW, LEAST_CONTRAST = 15.0, 0.5, 0.05, 2.0, 1.5
HEAD, CURVE = 512, 1024


def image_type(content: Column) -> Column:
    """jpeg, png, gif, bmp or webp by the first bytes, else null."""
    head = F.hex(F.substring(content, 1, 12))
    webp = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
    return F.coalesce(*[F.when(head.startswith(m), F.lit(k)) for k, m in MAGIC.items()], webp)


def grey(rgba: np.ndarray) -> np.ndarray:
    """(77 red + 150 green + 29 blue) / 256 of (h, w, 4)."""
    p = rgba.astype(np.uint32)
    return ((77 * p[..., 0] + 150 * p[..., 1] + 29 * p[..., 2]) >> 8).astype(np.uint8)


def otsu(plane: np.ndarray) -> int:
    """The level that separates dark and light best; the lowest of equals."""
    count = np.bincount(plane.ravel(), minlength=256).astype(float)
    below, low = np.cumsum(count), np.cumsum(count * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where((below > 0) & (above > 0), below * above * (low / below - (low[-1] - low) / above) ** 2, -1.0)
    return int(score.argmax()) if score.max() >= 0 else 0


def box_mean(plane: np.ndarray, r: int, unit: int = 1) -> np.ndarray:
    """Mean of the square of radius r around each pixel, clipped at the borders; of a plane of whole numbers it is rounded once, also where these count parts of a unit."""
    h, w = plane.shape
    table = np.zeros((h + 1, w + 1))
    table[1:, 1:] = plane.astype(float).cumsum(0).cumsum(1)
    y0, y1 = np.maximum(np.arange(h) - r, 0)[:, None], np.minimum(np.arange(h) + r + 1, h)[:, None]
    x0, x1 = np.maximum(np.arange(w) - r, 0)[None], np.minimum(np.arange(w) + r + 1, w)[None]
    return (table[y1, x1] - table[y0, x1] - table[y1, x0] + table[y0, x0]) / ((y1 - y0) * (x1 - x0) * unit)


def extreme(plane: np.ndarray, r: int, largest: bool = True) -> np.ndarray:
    """Largest or smallest value of the square of radius r, clipped at the borders."""
    pick = np.maximum if largest else np.minimum
    for axis in (0, 1):
        out = plane.copy()
        for k in range(1, r + 1):
            ahead, back = [slice(None)] * 2, [slice(None)] * 2
            ahead[axis], back[axis] = slice(k, None), slice(None, -k)
            if plane.shape[axis] > k:
                out[tuple(back)] = pick(out[tuple(back)], plane[tuple(ahead)])
                out[tuple(ahead)] = pick(out[tuple(ahead)], plane[tuple(back)])
        plane = out
    return plane


def paint(rgba: np.ndarray, rects: list[tuple], color: tuple = (0, 0, 0)) -> np.ndarray:
    """Rectangles (0 to 1) filled, rounded outwards."""
    h, w = rgba.shape[:2]
    out = rgba.copy()
    for x0, y0, x1, y1 in rects:
        out[max(0, int(np.floor(y0 * h))) : int(np.ceil(y1 * h)), max(0, int(np.floor(x0 * w))) : int(np.ceil(x1 * w))] = [*color, 255]
    return out


def homography(quad: list[tuple], width: float, height: float) -> np.ndarray:
    """The 3x3 map of the rectangle width x height onto a quad (corners clockwise from the upper left)."""
    rows, right = [], []
    for (x, y), (u, v) in zip([(0, 0), (width, 0), (width, height), (0, height)], quad, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1).reshape(3, 3)


def warp(rgba: np.ndarray, quad: list[tuple], width: int, height: int) -> np.ndarray:
    """The quad's content as a rectangle, bilinear, white outside."""
    m = homography(quad, width, height)
    y, x = np.mgrid[0:height, 0:width] + 0.5
    u, v, z = np.tensordot(m, np.stack([x, y, np.ones_like(x)]), 1)
    u, v = u / z - 0.5, v / z - 0.5
    h, w = rgba.shape[:2]
    x0, y0 = np.floor(u).astype(int), np.floor(v).astype(int)
    out = np.zeros((height, width, 4))
    for dx in (0, 1):
        for dy in (0, 1):
            px, py = x0 + dx, y0 + dy
            inside = (px >= 0) & (px < w) & (py >= 0) & (py < h)
            color = np.where(inside[..., None], rgba[np.clip(py, 0, h - 1), np.clip(px, 0, w - 1)], 255)
            out += color * ((1 - abs(u - px)) * (1 - abs(v - py)))[..., None]
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def text_skew(plane: np.ndarray) -> float | None:
    """Degrees that lines of dark text are turned; 0 below 2, null without clear lines."""
    y, x = np.nonzero(plane < otsu(plane) + 1)
    if len(y) < 50:
        return None

    def energy(angle: float) -> float:
        rows = np.rint(y - x * np.tan(np.radians(angle))).astype(int)
        lines = np.bincount(rows - rows.min()).astype(float)
        return float((np.diff(lines) ** 2).sum())

    coarse = np.arange(-STEEPEST, STEEPEST + COARSE / 2, COARSE)
    found = np.array([energy(a) for a in coarse])
    if found.max() < LEAST_CONTRAST * np.sort(found)[len(found) // 2]:
        return None
    near = coarse[found.argmax()] + np.arange(-COARSE, COARSE + FINE / 2, FINE)
    best = float(near[np.argmax([energy(a) for a in near])])
    return 0.0 if abs(best) < LEAST_SKEW else round(best, 2)


def largest_region(mask: np.ndarray) -> tuple[int, tuple | None]:
    """Pixels and box (x0, y0, x1, y1) of the largest 4-connected region."""
    label, best = np.zeros(mask.shape, int), (0, None)
    for y, x in zip(*np.nonzero(mask), strict=True):
        if label[y, x]:
            continue
        stack, ys, xs = [(y, x)], [], []
        label[y, x] = 1
        while stack:
            b, a = stack.pop()
            ys.append(b)
            xs.append(a)
            for q, p in ((b - 1, a), (b + 1, a), (b, a - 1), (b, a + 1)):
                if 0 <= q < mask.shape[0] and 0 <= p < mask.shape[1] and mask[q, p] and not label[q, p]:
                    label[q, p] = 1
                    stack.append((q, p))
        if len(ys) > best[0]:
            best = (len(ys), (min(xs), min(ys), max(xs) + 1, max(ys) + 1))
    return best


def pgm(plane: np.ndarray) -> bytes:
    """A binary grey map whose head is filled up to HEAD bytes by a comment."""
    tail = f"\n{plane.shape[1]} {plane.shape[0]}\n255\n"
    return f"P5\n#{' ' * (HEAD - 4 - len(tail))}{tail}".encode() + plane.tobytes()


def tone_curve(black: Column, white: Column, gamma: Column) -> Column:
    """CURVE levels of a tone curve, for brightness from 0 to 1.5."""
    level = lambda i: F.least(F.greatest((i / (CURVE - 1) * 1.5 - black) / (white - black), F.lit(0.0)), F.lit(1.0))
    return F.transform(F.sequence(F.lit(0), F.lit(CURVE - 1)), lambda i: F.floor(255 * F.pow(level(i), gamma) + 0.5).cast("bigint"))


def _planes(images: DataFrame, work, schema: str) -> DataFrame:
    """image_id and what work gives of each plane, as columns of schema."""
    names = [c.split()[0] for c in schema.split(", ")]

    def batch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [work(np.frombuffer(d, np.uint8).reshape(h, w)) for d, w, h in zip(pdf["data"], pdf["width"], pdf["height"], strict=True)]
            yield pd.DataFrame({"image_id": pdf["image_id"], **{c: [r[k] for r in rows] for k, c in enumerate(names)}})

    return images.select("image_id", "width", "height", "data").mapInPandas(batch, f"image_id bigint, {schema}")


def filtered(images: DataFrame, r: int) -> DataFrame:
    """image_id, blur, high, low: box means and local extremes of radius r, row by row."""
    return _planes(images, lambda p: (box_mean(p, r).ravel(), extreme(p, r).ravel().astype(float), extreme(p, r, False).ravel().astype(float)), "blur array<double>, high array<double>, low array<double>")


def regions(images: DataFrame, level: int) -> DataFrame:
    """image_id, largest: pixels of the largest region at least as bright as level."""
    return _planes(images, lambda p: (largest_region(p >= level)[0],), "largest int")


def grey_maps(images: DataFrame) -> DataFrame:
    return _planes(images, lambda p: (pgm(p),), "content binary")


def measure(images: DataFrame) -> DataFrame:
    """image_id, width, height, data (grey) -> threshold, mean, skew."""

    def batch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            planes = [np.frombuffer(d, np.uint8).reshape(h, w) for d, w, h in zip(pdf["data"], pdf["width"], pdf["height"], strict=True)]
            yield pd.DataFrame({"image_id": pdf["image_id"], "threshold": [otsu(p) for p in planes], "mean": [float(p.mean()) for p in planes], "skew": [text_skew(p) for p in planes]})

    return images.select("image_id", "width", "height", "data").mapInPandas(batch, "image_id bigint, threshold int, mean double, skew double")

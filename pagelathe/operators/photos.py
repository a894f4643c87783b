"""Shadows taken out of grey photos by the brightness of their paper, tile by tile.

A photo is rows of tiles: image_id, width, height (of the photo), top, left, rows, cols
and data, the tile's bytes with one more pixel on each side that the photo has. Only
block maxima, at most 480 a side, of one photo meet in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .images import CURVE, box_mean, extreme

# Side of the reduced photo; floors of the paper's brightness; strength and least of the calming; ink of black and white; black, white and gamma of the others.
SMALL, REGION, BRIGHTEST, CALM, LEAST_CALM, INK = 320, 0.6, 0.35, 1.8, 0.05, 0.75
TONES = {"document": (0.4, 0.9, 1.5), "enhance": (0.12, 0.95, 1.1)}
FILTERS = ("document", "enhance", "bw")

TILE = "image_id bigint, width int, height int, top int, left int, rows int, cols int"
_PLACE = ["image_id", "width", "height", "top", "left", "rows", "cols"]


def block_of(width: int, height: int) -> int:
    return max(1, int(np.floor(max(width, height) / SMALL + 0.5)))


def tiles(images: DataFrame, side: int = 1024) -> DataFrame:
    """images (image_id, width, height, data) -> tiles of side pixels, more where the photo's blocks ask for it; none of an empty or null photo."""

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for image_id, w, h, data in zip(pdf["image_id"], pdf["width"], pdf["height"], pdf["data"], strict=True):
                plane = np.frombuffer(data, np.uint8).reshape(h, w)
                step = -(-side // block_of(w, h)) * block_of(w, h)
                for top in range(0, h, step):
                    out = [(image_id, w, h, top, left, min(step, h - top), min(step, w - left), plane[max(0, top - 1) : top + step + 1, max(0, left - 1) : left + step + 1].tobytes()) for left in range(0, w, step)]
                    yield pd.DataFrame(out, columns=[*_PLACE, "data"])

    return images.where("width > 0 AND height > 0 AND data IS NOT NULL").select("image_id", "width", "height", "data").mapInPandas(cut, f"{TILE}, data binary")


def _opened(tile) -> tuple[np.ndarray, slice, slice]:
    """The tile with its halo, and where its own pixels are in it."""
    y, x = min(1, tile.top), min(1, tile.left)
    tall, wide = y + tile.rows + (tile.top + tile.rows < tile.height), x + tile.cols + (tile.left + tile.cols < tile.width)
    return np.frombuffer(tile.data, np.uint8).reshape(tall, wide), slice(y, y + tile.rows), slice(x, x + tile.cols)


def paper(small: np.ndarray) -> tuple[np.ndarray, float]:
    """Brightness of the paper by block, at least 1, and that of the brightest region.

    Closing takes out ink, a mean smooths; a share of the region's mean is the floor, so large dark areas stay dark.
    """
    smooth = box_mean(extreme(extreme(small.astype(float), 2), 2, False), 1)
    # clipped squares hold 1, 2, 3, 4, 6 or 9 pixels, so their means are whole in 36ths and those of the regions are rounded once
    region = box_mean(np.rint(smooth * 36), max(4, int(np.floor(max(small.shape) / 4 + 0.5))), 36)
    brightest = max(1.0, float(region.max()))
    return np.maximum(np.maximum(smooth, region * REGION), max(brightest * BRIGHTEST, 1.0)), brightest


def papers(pieces: DataFrame) -> DataFrame:
    """tiles -> image_id, paper (by block, row by row), columns, brightest."""

    def maxima(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for t in pdf.itertuples():
                plane, ys, xs = _opened(t)
                block = block_of(t.width, t.height)
                if t.top % block or t.left % block:
                    raise ValueError(f"tiles of this photo must begin at multiples of {block}")
                high = np.maximum.reduceat(np.maximum.reduceat(plane[ys, xs], np.arange(0, t.rows, block), 0), np.arange(0, t.cols, block), 1)
                out.append((t.image_id, t.width, t.height, t.top // block, t.left // block, *high.shape, high.tobytes()))
            yield pd.DataFrame(out, columns=[*_PLACE, "data"])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        block = block_of(pdf["width"][0], pdf["height"][0])
        small = np.zeros((-(-pdf["height"][0] // block), -(-pdf["width"][0] // block)), np.uint8)
        for t in pdf.itertuples():
            small[t.top : t.top + t.rows, t.left : t.left + t.cols] = np.frombuffer(t.data, np.uint8).reshape(t.rows, t.cols)
        level, brightest = paper(small)
        return pd.DataFrame({"image_id": pdf["image_id"][:1], "paper": [level.ravel()], "columns": [level.shape[1]], "brightest": [brightest]})

    return pieces.mapInPandas(maxima, f"{TILE}, data binary").groupBy("image_id").applyInPandas(whole, "image_id bigint, paper array<double>, columns int, brightest double")


def enlarged(level: np.ndarray, block: int, ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """The block levels at pixels, bilinear between the blocks' middles."""

    def near(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        f = np.clip((at + 0.5) / block - 0.5, 0, n - 1)
        low = f.astype(int)
        return low, np.minimum(low + 1, n - 1), f - low

    (y0, y1, ty), (x0, x1, tx) = near(ys, level.shape[0]), near(xs, level.shape[1])
    across = lambda y: level[y][:, x0] + (level[y][:, x1] - level[y][:, x0]) * tx
    return across(y0) + (across(y1) - across(y0)) * ty[:, None]


def calmed(plane: np.ndarray, level: np.ndarray, brightest: float) -> np.ndarray:
    """Pixels mixed with the weighted mean around them the more the darker their paper; the outermost stay."""
    out = plane.astype(float)
    if min(plane.shape) > 2:
        p = plane.astype(float)
        rows = p[:-2] + 2 * p[1:-1] + p[2:]
        soft = (rows[:, :-2] + 2 * rows[:, 1:-1] + rows[:, 2:]) / 16
        mix = (1 - level[1:-1, 1:-1] / brightest) * CALM
        out[1:-1, 1:-1] += np.where(mix > LEAST_CALM, (soft - p[1:-1, 1:-1]) * np.minimum(mix, 1), 0)
    return np.clip(np.rint(out), 0, 255)


def toned(grey: np.ndarray, level: np.ndarray, kind: str) -> np.ndarray:
    if kind == "bw":
        return np.where(grey < level * INK, 0, 255)
    black, white, gamma = TONES[kind]
    t = np.clip((np.arange(CURVE) * 1.5 / (CURVE - 1) - black) / (white - black), 0, 1)
    return np.floor(255 * t**gamma + 0.5)[np.minimum(CURVE - 1, (grey / level) * ((CURVE - 1) / 1.5)).astype(int)]


def filtered(pieces: DataFrame, kind: str) -> DataFrame:
    """tiles -> the tiles' places, data: their own pixels without shadows as document, enhance or bw (FILTERS); colour is not kept."""
    if kind not in FILTERS:
        raise ValueError(f"unknown filter {kind}")

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for t in pdf.itertuples():
                plane, ys, xs = _opened(t)
                block = block_of(t.width, t.height)
                at = lambda start, own, n: np.arange(start - own.start, start - own.start + n)
                level = enlarged(np.asarray(t.paper).reshape(-1, t.columns), block, at(t.top, ys, plane.shape[0]), at(t.left, xs, plane.shape[1]))
                grey = plane if kind == "enhance" else calmed(plane, level, t.brightest)
                out.append(toned(grey[ys, xs], level[ys, xs], kind).astype(np.uint8).tobytes())
            yield pd.DataFrame({**{c: pdf[c] for c in _PLACE}, "data": out})

    return pieces.join(papers(pieces), "image_id").select(*_PLACE, "data", "paper", "columns", "brightest").mapInPandas(work, f"{TILE}, data binary")

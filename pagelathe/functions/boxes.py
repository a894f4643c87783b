"""Rectangles on a page, as structs of x0, y0, x1, y1 between 0 and 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SMALLEST = 0.005


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def _unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def normalize(r: Column) -> Column:
    """Corners in order, within the page; null if a side is too short."""
    x0, x1 = _unit(F.least(r["x0"], r["x1"])), _unit(F.greatest(r["x0"], r["x1"]))
    y0, y1 = _unit(F.least(r["y0"], r["y1"])), _unit(F.greatest(r["y0"], r["y1"]))
    return F.when((x1 - x0 >= SMALLEST) & (y1 - y0 >= SMALLEST), box(x0, y0, x1, y1))


def rotate(r: Column, degrees: Column) -> Column:
    """The rectangle after the page turns clockwise by 0, 90, 180 or 270 degrees."""
    one = F.lit(1.0)
    return (
        F.when(degrees == 90, box(one - r["y1"], r["x0"], one - r["y0"], r["x1"]))
        .when(degrees == 180, box(one - r["x1"], one - r["y1"], one - r["x0"], one - r["y0"]))
        .when(degrees == 270, box(r["y0"], one - r["x1"], r["y1"], one - r["x0"]))
        .otherwise(box(r["x0"], r["y0"], r["x1"], r["y1"]))
    )


def pad(r: Column, width: Column, height: Column, share: float = 0.15) -> Column:
    """Grown by a share of its height on all sides, within the page."""
    extra = (r["y1"] - r["y0"]) * share
    wide = extra * height / width
    return box(F.greatest(F.lit(0.0), r["x0"] - wide), F.greatest(F.lit(0.0), r["y0"] - extra), F.least(F.lit(1.0), r["x1"] + wide), F.least(F.lit(1.0), r["y1"] + extra))


def overlaps(a: dict, b: dict) -> Column:
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def inside(a: dict, b: dict) -> Column:
    return (a["x0"] >= b["x0"]) & (a["x1"] <= b["x1"]) & (a["y0"] >= b["y0"]) & (a["y1"] <= b["y1"])


def under(a: dict, b: dict) -> Column:
    """A text box under a rectangle: shared width over 0.001 and over 30 % of its height."""
    return (F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]) > 0.001) & (F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]) > (a["y1"] - a["y0"]) * 0.3)


def columns(alias: str) -> dict:
    return {k: F.col(f"{alias}.{k}") for k in ("x0", "y0", "x1", "y1")}


def area(points: Column) -> Column:
    """Shoelace area of array<struct<x, y>>."""
    n = F.size(points)
    terms = F.transform(points, lambda p, i: p["x"] * F.get(points, (i + 1) % n)["y"] - F.get(points, (i + 1) % n)["x"] * p["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)) / 2


# Page sizes in points.
SHEETS = {"a4": (595.28, 841.89), "letter": (612.0, 792.0)}


def layout_page(width: Column, height: Column, sheet: str, margin: float) -> Column:
    """struct<width, height, x, y, w, h>: an image on a sheet, or on a sheet of its own shape (`fit`)."""

    def made(w: Column, h: Column, pw: Column, ph: Column) -> Column:
        return F.struct(pw.alias("width"), ph.alias("height"), ((pw - w) / 2).alias("x"), ((ph - h) / 2).alias("y"), w.alias("w"), h.alias("h"))

    if sheet == "fit":
        scale = F.lit(SHEETS["a4"][0]) / F.least(width, height)
        return made(width * scale, height * scale, width * scale + margin * 2, height * scale + margin * 2)
    small, large = map(F.lit, SHEETS[sheet])
    pw, ph = F.when(width > height, large).otherwise(small), F.when(width > height, small).otherwise(large)
    scale = F.least((pw - margin * 2) / width, (ph - margin * 2) / height)
    return made(width * scale, height * scale, pw, ph)

"""Image kernels against plain definitions."""

import numpy as np
import pytest

from pagelathe.operators import images, photos


def test_grey_and_threshold(spark):
    rgba = np.zeros((2, 2, 4), np.uint8)
    rgba[0, 0] = [255, 255, 255, 255]
    assert images.grey(rgba).tolist() == [[255, 0], [0, 0]]
    plane = np.array([[10] * 6 + [200] * 6] * 2, np.uint8)
    assert images.otsu(plane) == 10
    assert images.otsu(np.zeros((2, 2), np.uint8)) == 0
    got = images.measure(spark.createDataFrame([(1, 12, 2, bytearray(plane.tobytes()))], "image_id bigint, width int, height int, data binary")).first()
    assert (got.threshold, got.mean, got.skew) == (10, 105.0, None)


@pytest.mark.parametrize("r", [1, 3])
def test_windows(r):
    plane = np.random.default_rng(1).integers(0, 256, (9, 7)).astype(np.uint8)
    for y in range(9):
        for x in range(7):
            part = plane[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1]
            assert images.box_mean(plane, r)[y, x] == pytest.approx(part.mean())
            assert images.extreme(plane, r)[y, x] == part.max()
            assert images.extreme(plane, r, False)[y, x] == part.min()


def test_warp_and_paint():
    rgba = np.random.default_rng(2).integers(0, 256, (8, 10, 4)).astype(np.uint8)
    assert (images.warp(rgba, [(0, 0), (10, 0), (10, 8), (0, 8)], 10, 8) == rgba).all()
    assert (images.warp(rgba, [(10, 0), (10, 8), (0, 8), (0, 0)], 8, 10) == np.rot90(rgba)).all()
    out = images.paint(rgba, [(0.25, 0.3, 0.5, 0.5)])
    assert (out[2:4, 2:5, :3] == 0).all() and (out[4:] == rgba[4:]).all()


@pytest.mark.parametrize("angle", [0, 5, -7])
def test_skew(angle):
    plane = np.full((300, 300), 255, np.uint8)
    x = np.arange(20, 280)
    for line in range(40, 260, 20):
        y = np.rint(line + (x - 150) * np.tan(np.radians(angle))).astype(int)
        for k in range(4):
            plane[np.clip(y + k, 0, 299), x] = 0
    assert images.text_skew(plane) == pytest.approx(angle, abs=0.3)


def test_regions_and_types(spark):
    mask = np.zeros((6, 6), bool)
    mask[0, 0] = mask[2:5, 1:3] = True
    assert images.largest_region(mask) == (6, (1, 2, 3, 5))
    heads = [b"\xff\xd8\xff\xe0", b"\x89PNG\r\n\x1a\n", b"GIF89a", b"BM00", b"RIFF0000WEBP", b"xx", None]
    rows = spark.createDataFrame([(i, bytearray(h) if h else None) for i, h in enumerate(heads)], "i int, c binary")
    assert [r[0] for r in rows.orderBy("i").select(images.image_type(rows.c)).collect()] == ["jpeg", "png", "gif", "bmp", "webp", None, None]
    made = images.pgm(np.zeros((1, 2), np.uint8))
    assert len(made) == 514 and made.startswith(b"P5\n#  ") and made.endswith(b"\n2 1\n255\n\0\0")


def test_shadows_by_tiles(spark):
    """Tiles give what one whole photo gives; a shadow over paper goes, ink stays."""
    y, x = np.mgrid[0:500, 0:700]
    rng = np.random.default_rng(3)
    plane = 220 - 110 * (x > 350) + rng.integers(-6, 7, (500, 700))
    plane[100:400:25, 60:640] = plane[100:400:25, 60:640] // 5
    rows = [(1, 700, 500, bytearray(plane.astype(np.uint8).tobytes())), (2, 1, 1, bytearray(b"\0")), (3, 3, 2, bytearray(range(6))), (4, 0, 0, bytearray()), (5, 2, 2, None)]
    frame = spark.createDataFrame(rows, "image_id bigint, width int, height int, data binary")

    def put(side, kind):
        out = {}
        for t in photos.filtered(photos.tiles(frame, side), kind).collect():
            out.setdefault(t.image_id, np.zeros((t.height, t.width), np.uint8))[t.top : t.top + t.rows, t.left : t.left + t.cols] = np.frombuffer(t.data, np.uint8).reshape(t.rows, t.cols)
        return out

    for kind in photos.FILTERS:
        whole, cut = put(4096, kind), put(129, kind)
        assert set(whole) == {1, 2, 3} == set(cut) and all((whole[k] == cut[k]).all() for k in whole)
    assert cut[1][110:114, 100:300].min() == cut[1][110:114, 400:600].min() == 255
    assert cut[1][100, 60:340].max() == cut[1][100, 360:640].max() == 0
    with pytest.raises(ValueError):
        photos.filtered(photos.tiles(frame), "sepia")


def test_paper_rounds_once():
    """Levels that meet a limit exactly must not fall beside it: means of regions against fractions."""
    from fractions import Fraction

    rng = np.random.default_rng(4)
    mean = lambda p, r: [[sum((v := [v for row in p[max(0, y - r) : y + r + 1] for v in row[max(0, x - r) : x + r + 1]]), Fraction()) / len(v) for x in range(8)] for y in range(8)]
    for _ in range(20):
        plane = rng.integers(0, 256, (8, 8)).astype(np.uint8)
        closed = images.extreme(images.extreme(plane, 2), 2, False)
        region = mean(mean([[Fraction(int(v)) for v in row] for row in closed], 1), 4)
        assert photos.paper(plane)[1] == float(max(map(max, region)))

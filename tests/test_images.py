"""Image operators against plain loops and drawn pages."""

import math

import numpy as np
import pytest

from docengine.operators import images as I
from docengine.operators import ocr


@pytest.fixture(scope="module")
def noisy():
    rng = np.random.default_rng(0)
    return rng.integers(0, 256, (37, 53), dtype=np.uint8)


def window(image, y, x, n, fill=None):
    h, w = image.shape
    lo = -(n // 2)
    for dy in range(lo, lo + n):
        for dx in range(lo, lo + n):
            yy, xx = y + dy, x + dx
            if fill is None:
                yield image[min(max(yy, 0), h - 1), min(max(xx, 0), w - 1)]
            elif 0 <= yy < h and 0 <= xx < w:
                yield image[yy, xx]


def test_grey():
    px = np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [10, 20, 30]]], dtype=np.uint8)
    assert I.grey(px).tolist() == [[29, 150, 76, 22]] and I.swap_channels(px)[0, 3].tolist() == [30, 20, 10]
    assert I.grey(px[..., 0]) is not None and I.to_channels(px[..., 0]).shape == (1, 4, 3)


def test_median(noisy):
    out = I.median(noisy)
    assert all(out[y, x] == sorted(window(noisy, y, x, 3))[4] for y in range(37) for x in range(53))


def test_adaptive_threshold(noisy):
    sigma = 0.3 * ((11 - 1) * 0.5 - 1) + 0.8
    k = [math.exp(-((i - 5) ** 2) / (2 * sigma**2)) for i in range(11)]
    out, h, w = I.adaptive_threshold(noisy), *noisy.shape
    for y in (0, 5, 36):
        for x in (0, 20, 52):
            mean = sum(k[a] * k[b] * int(noisy[min(max(y + a - 5, 0), h - 1), min(max(x + b - 5, 0), w - 1)]) for a in range(11) for b in range(11)) / sum(k) ** 2
            assert out[y, x] == (255 if noisy[y, x] > round(mean) - 2 else 0)
    assert set(np.unique(I.adaptive_threshold(np.full((20, 20), 90, np.uint8)))) == {255}


def test_opening(noisy):
    binary = np.where(noisy > 120, 255, 0).astype(np.uint8)
    out = I.opening(binary)
    h, w = binary.shape
    want = np.zeros_like(binary)  # all windows that are white as a whole; a window may begin outside, at the top and left
    for y in range(-1, h - 1):
        for x in range(-1, w - 1):
            cells = [(a, b) for a in (y, y + 1) for b in (x, x + 1) if 0 <= a < h and 0 <= b < w]
            if all(binary[c] for c in cells):
                for c in cells:
                    want[c] = 255
    assert np.array_equal(out, want)
    line = np.zeros((9, 40), np.uint8)
    line[3, 5:30], line[6, 5:12] = 255, 255
    assert np.flatnonzero(I.opening(line, 1, 10).any(axis=1)).tolist() == [3]


def test_shrink():
    a = np.arange(48, dtype=np.uint8).reshape(6, 8)
    assert I.shrink(a, 3, 4).tolist() == np.rint(a.reshape(3, 2, 4, 2).mean(axis=(1, 3))).tolist()
    assert I.shrink(np.full((100, 77), 9, np.uint8), 41, 30).tolist() == np.full((41, 30), 9).tolist()


@pytest.mark.parametrize("diagonal", [True, False])
def test_components(noisy, diagonal):
    mask = noisy > 140
    got = I.components(mask, diagonal)
    want, n = np.zeros(mask.shape, int), 0
    for y, x in np.argwhere(mask):
        if want[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        while todo:
            a, b = todo.pop()
            if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not want[a, b]:
                want[a, b] = n
                todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if diagonal or not (i and j)]
    assert np.array_equal(got, want)
    assert I.components(np.zeros((3, 3), bool)).max() == 0


def test_edges():
    page = np.full((60, 60), 255, np.uint8)
    page[20:40, 20:40] = 0
    found = I.edges(page) > 0
    ys, xs = np.nonzero(found)
    assert 60 <= found.sum() <= 90 and ys.min() >= 18 and ys.max() <= 41 and xs.min() >= 18 and xs.max() <= 41
    assert not I.edges(np.full((30, 30), 7, np.uint8)).any()


def test_profile():
    white = I.profile(np.full((200, 200, 3), 255, np.uint8))
    assert white["std"] < 28 and white["edge_ratio"] == 0 and white["needs_full_preprocess"]
    page = np.full((600, 500), 255, np.uint8)
    page[100:130:6, 60:400] = 0
    text = I.profile(page)
    assert text["std"] < 28 or not text["needs_full_preprocess"] or text["edge_ratio"] > 0.08
    dark = np.full((100, 100), 255, np.uint8)
    dark[:50] = 0
    assert I.profile(dark)["dark_ratio"] == 0.5 and I.profile(dark)["needs_full_preprocess"]


def test_contrast():
    rng = np.random.default_rng(1)
    faint = rng.integers(110, 140, (64, 80)).astype(np.uint8)
    assert I.contrast(faint).std() > 1.3 * faint.std()
    assert I.contrast(np.full((50, 61), 100, np.uint8)).std() == 0


def lines_page(h=400, w=500):
    page = np.full((h, w), 255, np.uint8)
    for y in range(60, 340, 24):
        for x in range(60, 420, 14):
            page[y : y + 8, x : x + 9] = 0
    return page


@pytest.mark.parametrize("turn", [-7.0, -2.0, 3.0, 10.0])
def test_deskew(turn):
    page = lines_page()
    crooked = np.where(I.rotate(page, turn) < 128, 0, 255).astype(np.uint8)
    upright, angle = I.deskew(crooked)
    rows = lambda p: ((p < 128).sum(axis=1) > 20).sum()
    assert abs(abs(angle) - abs(turn)) < 0.7
    assert I.deskew(page)[1] == 0 and I.deskew(np.full((20, 20), 255, np.uint8))[1] == 0
    if angle * turn < 0:
        assert abs(rows(upright) - rows(page)) < 0.2 * rows(page)


def test_text_pixels():
    page = lines_page(h=400, w=500)
    before = len(I.text_pixels(page))
    page[10, 20:480], page[380:382, 390], page[385, 5:9] = 0, 0, 0  # a rule and specks
    assert len(I.text_pixels(page)) == before == int((lines_page() < 128).sum())


def test_hull_and_outline():
    rng = np.random.default_rng(2)
    p = rng.integers(0, 40, (200, 2))
    c = I.hull(p)
    d = np.roll(c, -1, axis=0) - c
    for q in p:
        cross = d[:, 0] * (q[1] - c[:, 1]) - d[:, 1] * (q[0] - c[:, 0])
        assert (cross >= 0).all()
    square = np.ones((10, 10), bool)
    square[3:6, 3:6] = False
    assert I.filled(square).all() and I.outline_area(I.filled(square)) == 81.0


def test_stamps():
    page = lines_page()
    before = page.copy()
    y, x = np.mgrid[0:400, 0:500]
    spread = (np.abs((y - 200) - (x - 250)) < 6) | (np.abs((y - 200) + (x - 250)) < 6)
    spread &= (np.abs(y - 200) < 120) & (np.abs(x - 250) < 120)
    blot = np.full_like(page, 255)
    blot[spread] = 0  # a large cross: fills little of its hull
    assert (I.without_stamps(blot) == 255).all()
    blot[:] = 255
    blot[100:300, 100:300] = 0  # a full square stays
    assert np.array_equal(I.without_stamps(blot), blot) and np.array_equal(I.without_stamps(before), before)


def test_preprocess():
    out, meta = I.preprocess(I.to_channels(lines_page()))
    assert out.shape == (400, 500, 3) and set(np.unique(out)) <= {0, 255} and meta["preprocess_mode"] in ("light", "full")
    light, meta = I.preprocess(lines_page(), light=True)
    assert meta["preprocess_mode"] == "light"
    assert I.gujarati_preprocess(I.to_channels(lines_page())).shape == (400, 500)


def ruled():
    page = np.zeros((200, 300), np.uint8)
    for y in (20, 40, 60, 120, 140, 160):
        page[y : y + 2, 10:290] = 255
    for x in (10, 100, 200, 288):
        page[20:162, x : x + 2] = 255
    return page


def test_grid(spark):
    rows, cols = I.scanned_grid(ruled())
    assert rows == [20, 40, 60, 120, 140, 160] and cols == [10, 100, 200, 288]
    assert I.scanned_grid(np.zeros((50, 50), np.uint8)) is None
    df = spark.createDataFrame([(1, 1, ruled().tobytes(), 200, 300, 1), (1, 2, bytes(2500), 50, 50, 1)], "doc_id long, page int, image binary, height int, width int, channels int")
    found = I.grids(df)
    assert found.count() == 1 and I.profiles(df).count() == 2
    box = lambda x, y: [(x, y), (x + 10.0, y), (x + 10.0, y + 4), (x, y + 4)]
    tokens = [(1, 1, 0, box(20.0, 25.0), "A", 0.9), (1, 1, 1, box(110.0, 25.0), "B", 0.9), (1, 1, 2, box(20.0, 45.0), "c", 0.9), (1, 1, 3, box(210.0, 145.0), "z", 0.9), (1, 1, 4, box(110.0, 125.0), "y", 0.9), (1, 1, 5, box(0.0, 0.0), "out", 0.9)]
    t = ocr.placed(spark.createDataFrame(tokens, "doc_id long, page int, ord int, box array<struct<x double, y double>>, text string, conf double"))
    got = {r.table_index: r for r in ocr.scanned_tables(found, t, ["doc_id", "page"]).collect()}
    assert (got[0].headers, got[0].rows) == (["A", "B", ""], [["c", "", ""]]) and got[0].accuracy == 0.5
    assert (got[1].headers, got[1].rows) == (["", "y", ""], [["", "", "z"]]) and got[1].extraction_method == "ocr-grid"

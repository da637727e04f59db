"""Page images by NumPy: arrays of bytes, grey (h, w) or blue-green-red (h, w, 3); 255 is white."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import atan2, degrees

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# fixed values: sizes, gates and weights of the published rules
SAMPLE_WIDTH, FLAT, DARK, DARK_SHARE, EDGE_SHARE, CANNY = 384, 28.0, 180, 0.20, 0.08, (50, 150)
BLOCK, OFFSET, KERNEL, MAX_ANGLE, MIN_ANGLE, SKEW_EDGES = 11, 2, 2, 45, 0.3, 0.02
FAINT, SMOOTH_STD, SMOOTH_DARK, CLIP, TILES = 50.0, 20.0, 0.35, 2.0, 8
STAMP_AREA, STAMP_SOLIDITY, LINE_SHARE, RULE_PART = 0.02, 0.5, 0.5, 4
SPECK, BLOT, RULE_THIN, RULE_LONG, SPARSE, SPARSE_LONG = 12, 0.08, 2, 0.25, 0.03, 0.2


def grey(image: np.ndarray) -> np.ndarray:
    """0.114 blue, 0.587 green, 0.299 red, rounded in 14-bit fixed point."""
    if image.ndim == 2:
        return image
    b, g, r = (image[..., i].astype(np.int64) for i in range(3))
    return ((b * 1868 + g * 9617 + r * 4899 + 8192) >> 14).astype(np.uint8)


def swap_channels(image: np.ndarray) -> np.ndarray:
    return image[..., ::-1].copy()


def to_channels(image: np.ndarray) -> np.ndarray:
    return np.repeat(image[..., None], 3, axis=2)


def _windows(image: np.ndarray, size: int) -> np.ndarray:
    edge = np.pad(image, size // 2, mode="edge")
    return np.lib.stride_tricks.sliding_window_view(edge, (size, size))


def median(image: np.ndarray) -> np.ndarray:
    """3 x 3, edges repeated."""
    return np.median(_windows(image, 3).reshape(*image.shape, 9), axis=2).astype(np.uint8)


def _gauss(size: int) -> np.ndarray:
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    return k / k.sum()


def _blur(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    half = len(kernel) // 2
    out = image.astype(np.float64)
    for axis in (0, 1):
        pad = [(half, half) if a == axis else (0, 0) for a in (0, 1)]
        edge = np.pad(out, pad, mode="edge")
        n = out.shape[axis]
        out = sum(w * np.take(edge, range(i, i + n), axis=axis) for i, w in enumerate(kernel))
    return out


def adaptive_threshold(image: np.ndarray, size: int = BLOCK, offset: int = OFFSET) -> np.ndarray:
    """White where a pixel is over its Gaussian mean, rounded, less the offset."""
    mean = np.rint(_blur(image, _gauss(size)))
    return np.where(image > mean - offset, 255, 0).astype(np.uint8)


def _slide(image: np.ndarray, height: int, width: int, least: bool, origin: tuple[int, int]) -> np.ndarray:
    """Least or greatest value of a height x width window whose place `origin` is the pixel; outside counts for nothing."""
    f, fill = (np.minimum, 255) if least else (np.maximum, 0)
    out = image
    for axis, (n, at) in enumerate(zip((height, width), origin)):
        pad = [(at, n - 1 - at) if a == axis else (0, 0) for a in (0, 1)]
        edge, size = np.pad(out, pad, constant_values=fill), out.shape[axis]
        reach, acc = 1, edge
        while reach < n:  # windows of twice the length out of two that meet or overlap
            step = min(reach, n - reach)
            m = acc.shape[axis] - step
            acc = f(np.take(acc, range(m), axis=axis), np.take(acc, range(step, step + m), axis=axis))
            reach += step
        out = np.take(acc, range(size), axis=axis)
    return out


def opening(image: np.ndarray, height: int = KERNEL, width: int = KERNEL) -> np.ndarray:
    """The greatest of the least values: white spots smaller than the window go."""
    at = (height // 2, width // 2)
    return _slide(_slide(image, height, width, True, at), height, width, False, (height - 1 - at[0], width - 1 - at[1]))


def shrink(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the areas that new pixels cover."""

    def weights(n: int, m: int) -> np.ndarray:
        edge = np.arange(m + 1) * (n / m)
        lo, hi = edge[:-1, None], edge[1:, None]
        px = np.arange(n)[None, :]
        return np.clip(np.minimum(hi, px + 1) - np.maximum(lo, px), 0, None) * (m / n)

    return np.rint(weights(image.shape[0], height) @ image.astype(np.float64) @ weights(image.shape[1], width).T).astype(np.uint8)


def edges(image: np.ndarray, low: int = CANNY[0], high: int = CANNY[1]) -> np.ndarray:
    """Thin edges by gradients of 3 x 3 differences: ridges over `high`, and those over `low` that hang together with them."""
    p = np.pad(image.astype(np.int64), 1, mode="edge")
    dx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    dy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    size = np.abs(dx) + np.abs(dy)
    s = np.pad(size, 1)
    at = lambda y, x: s[1 + y : 1 + y + size.shape[0], 1 + x : 1 + x + size.shape[1]]
    ax, ay = np.abs(dx), np.abs(dy)
    flat, steep = ay < 0.4142135623730951 * ax, ay > 2.414213562373095 * ax
    same = (dx >= 0) == (dy >= 0)
    ridge = np.where(
        flat, (size > at(0, -1)) & (size >= at(0, 1)),
        np.where(steep, (size > at(-1, 0)) & (size >= at(1, 0)), np.where(same, (size > at(-1, -1)) & (size > at(1, 1)), (size > at(-1, 1)) & (size > at(1, -1)))),
    )
    weak, strong = ridge & (size > low), ridge & (size > high)
    label = components(weak)
    good = np.zeros(label.max() + 1, dtype=bool)
    good[label[strong]] = True
    good[0] = False
    return np.where(good[label], 255, 0).astype(np.uint8)


def components(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Labels from 1 of connected areas, by their first pixel; 0 outside. Runs of rows are united, not pixels."""
    h, w = mask.shape
    flips = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(flips == 1)
    last = np.nonzero(flips == -1)[1] - 1
    n = len(row)
    out = np.zeros((h, w), dtype=np.int64)
    if not n:
        return out
    # a run touches those of the row above whose ends are at most `reach` columns away
    reach = int(diagonal)
    key_first, key_last, width = row * (w + 3) + first + 1, row * (w + 3) + last + 1, w + 3
    lo = np.searchsorted(key_last, key_first - width - reach)
    hi = np.searchsorted(key_first, key_last - width + reach, side="right")
    count = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(n), count)
    b = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        parent = np.arange(n)
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(parent[parent], parent):
            parent = parent[parent]
        label = parent[label]
    _, label = np.unique(label, return_inverse=True)
    out[mask] = np.repeat(label + 1, last - first + 1)
    return out


def profile(image: np.ndarray) -> dict:
    """std, dark_ratio, edge_ratio of a reduced image, and whether it needs the full path: a flat one does, any other if dark or full of edges."""
    g = grey(image)
    h, w = g.shape
    width = min(SAMPLE_WIDTH, w)
    sample = shrink(g, max(1, int(h * (width / max(w, 1)))), width)
    std, dark = float(sample.std()), float((sample < DARK).mean())
    if std < FLAT:
        return {"std": std, "dark_ratio": dark, "edge_ratio": 0.0, "needs_full_preprocess": True}
    edge = float((edges(sample) > 0).mean())
    return {"std": std, "dark_ratio": dark, "edge_ratio": edge, "needs_full_preprocess": dark > DARK_SHARE or edge > EDGE_SHARE}


def contrast(image: np.ndarray, clip: float = CLIP, tiles: int = TILES) -> np.ndarray:
    """Histograms of tiles, clipped and made even, mixed by the distance to the tiles' middles."""
    h, w = image.shape
    p = np.pad(image, ((0, -h % tiles), (0, -w % tiles)), mode="reflect") if h % tiles or w % tiles else image
    th, tw = p.shape[0] // tiles, p.shape[1] // tiles
    area = th * tw
    limit = max(int(clip * area / 256), 1)
    maps = np.empty((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            n = np.bincount(p[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            over = int(np.maximum(n - limit, 0).sum())
            n = np.minimum(n, limit) + over // 256
            left = over % 256
            if left:
                n[:: max(256 // left, 1)][:left] += 1
            maps[i, j] = np.clip(np.rint(np.cumsum(n) * (255 / area)), 0, 255)

    def near(size: int, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(size) / tile - 0.5
        low = np.floor(at).astype(np.int64)
        return np.clip(low, 0, tiles - 1), np.clip(low + 1, 0, tiles - 1), at - low

    (y0, y1, fy), (x0, x1, fx) = near(h, th), near(w, tw)
    pick = lambda y, x: maps[y[:, None], x[None, :], image]
    top = pick(y0, x0) * (1 - fx) + pick(y0, x1) * fx
    low = pick(y1, x0) * (1 - fx) + pick(y1, x1) * fx
    return np.clip(np.rint(top * (1 - fy)[:, None] + low * fy[:, None]), 0, 255).astype(np.uint8)


def boxes(label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """top, left, height, width, area of each labelled area."""
    y, x = np.nonzero(label)
    of, n = label[y, x] - 1, int(label.max(initial=0))
    top, left, low, right = np.full(n, label.shape[0]), np.full(n, label.shape[1]), np.full(n, -1), np.full(n, -1)
    np.minimum.at(top, of, y)
    np.minimum.at(left, of, x)
    np.maximum.at(low, of, y)
    np.maximum.at(right, of, x)
    return top, left, low - top + 1, right - left + 1, np.bincount(of, minlength=n)


def text_pixels(binary: np.ndarray) -> np.ndarray:
    """(row, column) of dark pixels in areas like characters: no specks, no blots, no thin rules, nothing large and sparse."""
    label = components(binary < 128)
    h, w = binary.shape
    _, _, bh, bw, area = boxes(label)
    rule = ((bh <= RULE_THIN) & (bw > w * RULE_LONG)) | ((bw <= RULE_THIN) & (bh > h * RULE_LONG))
    sparse = (area / np.maximum(bh * bw, 1) < SPARSE) & (np.maximum(bh, bw) > max(h, w) * SPARSE_LONG)
    keep = (area >= SPECK) & (area <= h * w * BLOT) & ~rule & ~sparse
    return np.argwhere(np.append(False, keep)[label])


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of integer points, in order."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p
    # of each first coordinate only the ends can be corners
    first = np.unique(p[:, 0], return_index=True)[1]
    p = p[np.unique(np.concatenate([first, np.append(first[1:], len(p)) - 1]))]

    def chain(rows: list) -> list:
        out: list = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    rows = p.tolist()
    return np.array(chain(rows) + chain(rows[::-1])) if len(rows) > 2 else p


def skew(points: np.ndarray) -> float:
    """Degrees from 0 to 90 of a side of the smallest rectangle around points."""
    corners = hull(points).astype(np.float64)
    if len(corners) < 2:
        return 0.0
    best, angle = np.inf, 0.0
    for d in np.roll(corners, -1, axis=0) - corners:
        u = d / np.hypot(*d)
        a, b = corners @ u, corners @ np.array([-u[1], u[0]])
        area = (a.max() - a.min()) * (b.max() - b.min())
        if area < best - 1e-9:
            best, angle = area, degrees(atan2(u[1], u[0])) % 90
    return angle


def rotate(image: np.ndarray, angle: float) -> np.ndarray:
    """Turned about the middle, counter-clockwise, mixing four neighbours; edges are repeated."""
    h, w = image.shape
    cy, cx, t = h // 2, w // 2, np.deg2rad(angle)
    y, x = np.mgrid[0:h, 0:w]
    sx = np.cos(t) * (x - cx) - np.sin(t) * (y - cy) + cx
    sy = np.sin(t) * (x - cx) + np.cos(t) * (y - cy) + cy
    x0, y0 = np.floor(sx).astype(np.int64), np.floor(sy).astype(np.int64)
    fx, fy = sx - x0, sy - y0
    at = lambda yy, xx: image[np.clip(yy, 0, h - 1), np.clip(xx, 0, w - 1)].astype(np.float64)
    out = (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy
    return np.rint(out).astype(np.uint8)


def deskew(binary: np.ndarray) -> tuple[np.ndarray, float]:
    """The image turned upright and by how many degrees; under MIN_ANGLE or over MAX_ANGLE it is left as it is."""
    points = text_pixels(binary)
    if not len(points):
        points = np.argwhere(binary < 128)
        if not len(points):
            return binary, 0.0
    angle = skew(points)
    angle = angle - 90 if angle > 45 else angle
    if abs(angle) > MAX_ANGLE:
        return binary, angle
    if abs(angle) < MIN_ANGLE:
        return binary, 0.0
    return rotate(binary, angle), angle


def without_stamps(binary: np.ndarray) -> np.ndarray:
    """Large dark areas whose outline fills under half of its hull made white, with what they enclose."""
    label = components(binary < 128)
    out, least = binary.copy(), binary.size * STAMP_AREA
    top, left, bh, bw, _ = boxes(label)
    for i in np.flatnonzero(bh * bw >= least).tolist():
        part = np.s_[top[i] : top[i] + bh[i], left[i] : left[i] + bw[i]]
        own = filled(label[part] == i + 1)
        area, corners = outline_area(own), hull(np.argwhere(own)).astype(np.float64)
        after = np.roll(corners, -1, axis=0)
        whole = abs(np.sum(corners[:, 0] * after[:, 1] - corners[:, 1] * after[:, 0])) / 2
        if area >= least and whole and area / whole < STAMP_SOLIDITY:
            out[part][own] = 255
    return out


def filled(mask: np.ndarray) -> np.ndarray:
    """An area with its holes."""
    around = components(~np.pad(mask, 1), diagonal=False)
    return (around != around[0, 0])[1:-1, 1:-1]


def outline_area(area: np.ndarray) -> float:
    """Of an area without holes, what the line through the middles of its outermost pixels encloses (Pick's theorem)."""
    p = np.pad(area, 1)
    inner = p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]
    return float(area.sum()) - float((area & ~inner).sum()) / 2 - 1


def preprocess(image: np.ndarray, stamps: bool = True, straighten: bool = True, light: bool = False, quality: dict | None = None) -> tuple[np.ndarray, dict]:
    """The image ready for an engine, in three channels, and what was done to it.

    Light: threshold, straightened if it has edges, opened. Full: before that more contrast for a faint image and a median for a flat
    or dark one, after the threshold stamps go.
    """
    g = grey(image)
    q = quality or profile(g)
    light = light or not q["needs_full_preprocess"]
    if not light and q["std"] < FAINT:
        g = contrast(g)
    if not light and (q["std"] < SMOOTH_STD or q["dark_ratio"] > SMOOTH_DARK):
        g = median(g)
    binary = adaptive_threshold(g)
    if not light and stamps:
        binary = without_stamps(binary)
    angle = 0.0
    if straighten and (not light or q["edge_ratio"] > SKEW_EDGES):
        binary, angle = deskew(binary)
    return to_channels(opening(binary)), {"quality": q, "preprocess_mode": "light" if light else "full", "deskew_angle": angle}


def gujarati_preprocess(image: np.ndarray) -> np.ndarray:
    """Grey of a red-green-blue image, median, threshold."""
    return adaptive_threshold(median(grey(swap_channels(image) if image.ndim == 3 else image)))


def cluster(positions: list[int], gap: int = 10) -> list[int]:
    out: list[int] = []
    for p in positions:
        if not out or p - out[-1] > gap:
            out.append(p)
    return out


def grid(binary: np.ndarray) -> tuple[list[int], list[int]] | None:
    """Rows and columns of rules: dark runs of a quarter of the image that fill over half of a row or column; null under two of either."""
    h, w = binary.shape[:2]
    dark = 255 - binary
    across = (opening(dark, 1, max(w // RULE_PART, 1)) > 128).sum(axis=1)
    down = (opening(dark, max(h // RULE_PART, 1), 1) > 128).sum(axis=0)
    rows, cols = cluster(np.flatnonzero(across > w * LINE_SHARE).tolist()), cluster(np.flatnonzero(down > h * LINE_SHARE).tolist())
    return (rows, cols) if len(rows) >= 2 and len(cols) >= 2 else None


def scanned_grid(image: np.ndarray) -> tuple[list[int], list[int]] | None:
    """`grid` of a page image, thresholded the other way round first, as the published rule has it: its rules are light runs."""
    return grid(np.where(grey(image) > 128, 0, 255).astype(np.uint8))


def over_images(images: DataFrame, work: Callable[[np.ndarray], dict], schema: str, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """keys and what `work` gives for each image (columns image binary, height, width, channels); images are not shuffled."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for data, h, w, c in zip(frame["image"], frame["height"], frame["width"], frame["channels"]):
                shape = (h, w) if c == 1 else (h, w, c)
                out.append(work(np.frombuffer(data, dtype=np.uint8).reshape(shape)))
            yield pd.concat([frame[list(keys)].reset_index(drop=True), pd.DataFrame(out, index=range(len(out)))], axis=1)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in images.select(*keys).schema)
    return images.select(*keys, "image", "height", "width", "channels").mapInPandas(run, f"{fields}, {schema}")


def profiles(images: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    return over_images(images, profile, "std double, dark_ratio double, edge_ratio double, needs_full_preprocess boolean", keys)


def _grid_row(image: np.ndarray) -> dict:
    found = scanned_grid(image)
    return {"row_ys": found[0] if found else None, "col_xs": found[1] if found else None}


def grids(images: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """keys, row_ys, col_xs of images with a grid, for `ocr.scanned_tables`."""
    return over_images(images, _grid_row, "row_ys array<int>, col_xs array<int>", keys).where("row_ys IS NOT NULL")

"""Pixel operators on numpy matrices, and their Arrow stages.

Images are uint8 matrices, rows x columns (gray) or rows x columns x 3 (blue, green, red).
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np

from docfields.config import Preprocess, Quality


def gray(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    b, g, r = (image[..., i].astype(np.uint32) for i in range(3))
    return ((b * 1868 + g * 9617 + r * 4899 + 8192) >> 14).astype(np.uint8)


def _mirrored(x: np.ndarray, n: int) -> np.ndarray:
    """Edges continued by reflection about the edge pixels."""
    return np.pad(x, n, mode="reflect") if min(x.shape) > n else np.pad(x, n, mode="symmetric" if min(x.shape) >= n else "edge")


def laplacian_variance(g: np.ndarray) -> float:
    p = _mirrored(g.astype(np.float64), 1)
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]
    return float(lap.var())


def empty(g: np.ndarray, least: float) -> bool:
    """Too few pixels that are not black, or not white."""
    return np.count_nonzero(g) / g.size < least or np.count_nonzero(g != 255) / g.size < least


def exposure(g: np.ndarray) -> tuple[float, float]:
    """Shares of pixels in 246-255 and in 0-9."""
    h = np.bincount(g.ravel(), minlength=256)
    return h[246:].sum() / g.size, h[:10].sum() / g.size


def largest_component(mask: np.ndarray) -> int:
    """Pixels of the largest 8-connected component, by union of the runs of neighbouring rows."""
    parent: list[int] = []
    size: list[int] = []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above: list[tuple[int, int, int]] = []
    for row in mask:
        d = np.diff(np.concatenate([[0], row.astype(np.int8), [0]]))
        now = []
        j = 0
        for a, b in zip(np.flatnonzero(d == 1).tolist(), np.flatnonzero(d == -1).tolist(), strict=True):
            me = len(parent)
            parent.append(me)
            size.append(b - a)
            while j < len(above) and above[j][1] < a:
                j += 1
            k = j
            while k < len(above) and above[k][0] <= b:
                x, y = find(above[k][2]), find(me)
                if x != y:
                    parent[x] = y
                    size[y] += size[x]
                k += 1
            now.append((a, b, me))
        above = now
    return max((size[i] for i in range(len(parent)) if parent[i] == i), default=0)


def glare(g: np.ndarray, share: float = 0.05) -> bool:
    return largest_component(g > 240) > share * g.size


def quality(image: np.ndarray | None, config: Quality = Quality()) -> dict:
    """usable, blur_score, is_blurry, is_overexposed, document_detected; blur and exposure never reject an image."""
    out = {"usable": False, "blur_score": 0.0, "is_blurry": False, "is_overexposed": False, "document_detected": True}
    if image is None or image.size == 0:
        return out | {"is_blurry": True, "document_detected": False}
    if image.shape[1] < config.minimum_width or image.shape[0] < config.minimum_height:
        return out | {"document_detected": False}
    g = gray(image)
    if empty(g, config.empty_image_threshold):
        return out | {"document_detected": False}
    blur = laplacian_variance(g)
    bright = exposure(g)[0] > config.overexposure_fraction
    return out | {"usable": True, "blur_score": blur, "is_blurry": blur < config.blur_threshold, "is_overexposed": bool(bright)}


def upright(image: np.ndarray) -> tuple[np.ndarray, bool]:
    """Turned clockwise if wider than high."""
    wide = image.shape[1] > image.shape[0]
    return (np.ascontiguousarray(np.rot90(image, -1)) if wide else image), wide


def _kernel(n: int, sigma: float) -> np.ndarray:
    if sigma <= 0:
        sigma = 0.3 * ((n - 1) * 0.5 - 1) + 0.8
    x = np.arange(n) - (n - 1) / 2
    k = np.exp(-(x**2) / (2 * sigma**2))
    return k / k.sum()


def blurred(g: np.ndarray, n: int, sigma: float) -> np.ndarray:
    """Separable Gaussian, as floats."""
    k, r = _kernel(n, sigma), n // 2
    p = _mirrored(g.astype(np.float64), r)
    rows = sum(w * p[i : i + g.shape[0]] for i, w in enumerate(k))
    return sum(w * rows[:, i : i + g.shape[1]] for i, w in enumerate(k))


def _bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def denoised(g: np.ndarray, n: int = 3, sigma: float = 1.0) -> np.ndarray:
    return _bytes(blurred(g, n, sigma))


def clahe(g: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Histogram equalisation in tiles with clipped histograms, blended between tile centres."""
    h, w = g.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    p = np.pad(g, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect" if min(h, w) > max(th, tw) else "edge")
    blocks = p.reshape(tiles, th, tiles, tw).transpose(0, 2, 1, 3).reshape(tiles * tiles, -1)
    tables = np.empty((tiles * tiles, 256))
    limit = max(1, int(clip * th * tw / 256))
    for i, b in enumerate(blocks):
        hist = np.bincount(b, minlength=256)
        over = int(np.maximum(hist - limit, 0).sum())
        hist = np.minimum(hist, limit) + over // 256
        rest = over % 256
        if rest:
            hist[:: max(256 // rest, 1)][:rest] += 1
        tables[i] = _bytes(np.cumsum(hist) * (255.0 / (th * tw)))
    tables = tables.reshape(tiles, tiles, 256)
    y, x = np.arange(h) / th - 0.5, np.arange(w) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    clamp = lambda v: np.clip(v, 0, tiles - 1)
    at = lambda a, b: tables[clamp(a)[:, None], clamp(b)[None, :], g]
    top = at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx
    low = at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx
    return _bytes(top * (1 - fy) + low * fy)


def adaptive_threshold(g: np.ndarray, block: int = 11, c: float = 2.0) -> np.ndarray:
    return np.where(g > _bytes(blurred(g, block, 0)).astype(np.float64) - c, 255, 0).astype(np.uint8)


def edges(g: np.ndarray, low: float, high: float) -> np.ndarray:
    """Gradient edges, thinned across the gradient, with weak ones kept where they touch strong ones."""
    p = _mirrored(g.astype(np.int32), 1)
    dx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    dy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    m = np.abs(dx) + np.abs(dy)
    q = np.pad(m, 1)
    ax, ay = np.abs(dx), np.abs(dy)
    flat, steep = ay < ax * 0.4142, ay > ax * 2.4142
    same = (dx ^ dy) >= 0
    n1 = np.where(flat, q[1:-1, :-2], np.where(steep, q[:-2, 1:-1], np.where(same, q[:-2, :-2], q[:-2, 2:])))
    n2 = np.where(flat, q[1:-1, 2:], np.where(steep, q[2:, 1:-1], np.where(same, q[2:, 2:], q[2:, :-2])))
    thin = (m > n1) & (m >= n2)
    weak, on = thin & (m > low), thin & (m > high)
    while True:
        more = weak & dilated(on)
        if (more == on).all():
            return on
        on = more


def dilated(mask: np.ndarray) -> np.ndarray:
    p = np.pad(mask, 1)
    h, w = mask.shape
    return np.logical_or.reduce([p[i : i + h, j : j + w] for i in range(3) for j in range(3)])


def _components(mask: np.ndarray) -> list[np.ndarray]:
    """Points (x, y) of each 8-connected component, by least labels spread along rows and columns."""
    labels = np.where(mask, np.arange(mask.size).reshape(mask.shape), mask.size)
    while True:
        p = np.pad(labels, 1, constant_values=mask.size)
        h, w = mask.shape
        least = np.minimum.reduce([p[i : i + h, j : j + w] for i in range(3) for j in range(3)])
        least = np.where(mask, least, mask.size)
        flat = np.append(least.ravel(), mask.size)
        flat = flat[flat]  # a label's own label
        new = np.where(mask, flat[:-1].reshape(mask.shape), mask.size)
        if (new == labels).all():
            break
        labels = new
    ys, xs = np.nonzero(mask)
    own = labels[ys, xs]
    order = np.argsort(own, kind="stable")
    return np.split(np.stack([xs, ys], 1)[order], np.flatnonzero(np.diff(own[order])) + 1) if len(xs) else []


def _hull(points: np.ndarray) -> np.ndarray:
    pts = sorted(set(map(tuple, points.tolist())))
    if len(pts) < 3:
        return np.array(pts)

    def half(ps):
        out = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def _simplified(poly: np.ndarray, eps: float) -> np.ndarray:
    """Closed polygon with points nearer than ``eps`` to their chord left out."""

    def run(p: np.ndarray) -> list:
        if len(p) < 3:
            return p[:-1].tolist()
        a, b = p[0].astype(float), p[-1].astype(float)
        d = b - a
        n = np.hypot(*d)
        far = np.abs(d[0] * (p[:, 1] - a[1]) - d[1] * (p[:, 0] - a[0])) / n if n else np.hypot(*(p - a).T)
        i = int(far.argmax())
        return run(p[: i + 1]) + run(p[i:]) if far[i] > eps else p[:1].tolist()

    a = int(np.hypot(*(poly - poly[0]).T).argmax())
    return np.array(run(poly[: a + 1]) + run(np.concatenate([poly[a:], poly[:1]])))


def ordered(points: np.ndarray) -> np.ndarray:
    """Top left, top right, bottom right, bottom left."""
    p = points[np.lexsort((points[:, 0], points[:, 1]))]
    top, bottom = (h[np.lexsort((h[:, 1], h[:, 0]))] for h in (p[:2], p[2:]))
    return np.array([top[0], top[1], bottom[1], bottom[0]])


def _area(p: np.ndarray) -> float:
    x, y = p[:, 0].astype(float), p[:, 1].astype(float)
    return abs(float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())) / 2


def page_type(ratio: float) -> str:
    if ratio <= 0:
        return "unknown"
    a4 = 1 / np.sqrt(2.0)
    return "A4" if abs((1 / ratio if ratio > 1 else ratio) - a4) / a4 <= 0.15 else "unknown"


def detect(g: np.ndarray, config: Preprocess = Preprocess()) -> dict:
    """found, corners, rect, page_type, aspect_ratio, confidence of the largest four-sided outline.

    Outlines are convex hulls of edge components, so a page whose edge is broken or dented is found too.
    """
    none = {"found": False, "corners": [], "rect": None, "page_type": "unknown", "aspect_ratio": 0.0, "confidence": 0.0}
    on = dilated(edges(_bytes(blurred(g, 5, 0)), config.canny_low, config.canny_high))
    best, most = None, config.min_contour_area_fraction * g.size
    for part in _components(on):
        hull = _hull(part)
        if len(hull) < 4 or _area(hull) <= most:
            continue
        around = float(np.hypot(*(hull - np.roll(hull, -1, 0)).T).sum())
        for eps in (0.02, 0.05):
            quad = _simplified(hull, eps * around)
            if len(quad) == 4 and _area(quad) > most:
                best, most = quad, _area(quad)
            if len(quad) <= 4:
                break
    if best is None:
        return none
    c = ordered(best)
    side = lambda i, j: float(np.hypot(*(c[i] - c[j])))
    wide, tall = (side(0, 1) + side(3, 2)) / 2, (side(0, 3) + side(1, 2)) / 2
    ratio = wide / tall if tall > 0 else 0.0
    lo, hi = c.min(0), c.max(0)
    rect = [int(v) for v in (*lo, *(hi - lo))]
    return {"found": True, "corners": c.tolist(), "rect": rect, "page_type": page_type(ratio), "aspect_ratio": ratio, "confidence": min(1.0, most / g.size)}


def _cubic(t: np.ndarray) -> list[np.ndarray]:
    a = -0.75
    near = lambda x: ((a + 2) * x - (a + 3)) * x * x + 1
    far = lambda x: ((a * x - 5 * a) * x + 8 * a) * x - 4 * a
    return [far(1 + t), near(t), near(1 - t), far(2 - t)]


def warped(image: np.ndarray, corners: np.ndarray, width: int, height: int, rows: int = 256) -> np.ndarray | None:
    """The quadrilateral drawn as a rectangle, with cubic samples, black outside the image; null where it has no area."""
    c = np.asarray(corners, float)
    if c.shape != (4, 2) or width <= 0 or height <= 0 or image.size == 0:
        return None
    to = [(0, 0), (width - 1, 0), (width - 1, height - 1), (0, height - 1)]
    system, right = [], []
    for (u, v), (x, y) in zip(to, c, strict=True):
        system += [[u, v, 1, 0, 0, 0, -u * x, -v * x], [0, 0, 0, u, v, 1, -u * y, -v * y]]
        right += [x, y]
    try:
        m = np.append(np.linalg.solve(np.array(system, float), np.array(right)), 1.0)
    except np.linalg.LinAlgError:
        return None
    planes = image if image.ndim == 3 else image[..., None]
    h, w = image.shape[:2]
    out = np.empty((height, width, planes.shape[2]), np.uint8)
    u = np.arange(width)
    for start in range(0, height, rows):  # so that memory does not grow with the page
        v = np.arange(start, min(height, start + rows))[:, None]
        z = m[6] * u + m[7] * v + m[8]
        x, y = (m[0] * u + m[1] * v + m[2]) / z, (m[3] * u + m[4] * v + m[5]) / z
        x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
        wx, wy = _cubic(x - x0), _cubic(y - y0)
        total = np.zeros((*x.shape, planes.shape[2]))
        for i in range(4):
            for j in range(4):
                xi, yi = x0 + j - 1, y0 + i - 1
                inside = (xi >= 0) & (xi < w) & (yi >= 0) & (yi < h)
                px = planes[np.clip(yi, 0, h - 1), np.clip(xi, 0, w - 1)]
                total += (wy[i] * wx[j] * inside)[..., None] * px
        out[start : start + rows] = _bytes(total)
    return out if image.ndim == 3 else out[..., 0]


def process(image: np.ndarray | None, config: Preprocess = Preprocess()) -> tuple[np.ndarray, dict] | None:
    """(image for recognition, detection), or None for an empty image."""
    if image is None or image.size == 0:
        return None
    work = upright(image)[0] if config.enable_orientation_correction else image
    g = gray(work)
    better = denoised(g, config.gaussian_kernel, config.gaussian_sigma) if config.enable_denoise else g
    if config.enable_contrast_enhancement:
        better = clahe(better, config.clahe_clip_limit, config.clahe_tile_size)
    if config.enable_adaptive_threshold:
        better = adaptive_threshold(better, config.adaptive_threshold_block, config.adaptive_threshold_c)
    plain = better if config.enable_adaptive_threshold else g
    found = detect(plain, config) if config.enable_document_detection else {"found": False, "corners": [], "rect": None, "page_type": "unknown", "aspect_ratio": 0.0, "confidence": 0.0}
    if found["found"] and config.enable_perspective_correction:
        flat = warped(plain, np.array(found["corners"]), config.target_width, config.target_height)
        if flat is not None:
            return flat, found
    return (better if config.enable_grayscale else np.repeat(better[..., None], 3, axis=2)), found


def enhanced(image: np.ndarray | None, config: Preprocess = Preprocess()) -> np.ndarray | None:
    """``process`` without anything that changes the geometry."""
    done = process(image, replace(config, enable_document_detection=False, enable_perspective_correction=False, enable_orientation_correction=False))
    return None if done is None else done[0]

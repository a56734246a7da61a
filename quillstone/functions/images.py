"""Pixel kernels in numpy: grey, blur, resize, masks, connected shapes, marks, strokes."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np

# Hue (0 to 179), saturation and value limits of each colour, both ends included.
HSV_RANGES = {
    "red": [((0, 50, 50), (10, 255, 255)), ((170, 50, 50), (180, 255, 255))],
    "brown": [((10, 30, 30), (30, 255, 255))],
    "orange": [((0, 100, 100), (20, 255, 255))],
    "blue": [((100, 50, 50), (130, 255, 255))],
    "green": [((40, 50, 50), (80, 255, 255))],
    "purple": [((120, 30, 30), (160, 255, 255))],
}


def gray(image: np.ndarray, swapped: bool = False) -> np.ndarray:
    """Luminance of a BGR image; swapped takes it for RGB."""
    if image.ndim == 2:
        return image
    weights = np.array([0.299, 0.587, 0.114] if swapped else [0.114, 0.587, 0.299])
    return np.clip(np.rint(image[..., :3] @ weights), 0, 255).astype(np.uint8)


def _weighed(padded: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """Sums along an axis under a sliding kernel."""
    n = padded.shape[axis] - len(kernel) + 1
    return sum(k * (padded[i : i + n] if axis == 0 else padded[:, i : i + n]) for i, k in enumerate(kernel))


def blur(image: np.ndarray, size: int = 3) -> np.ndarray:
    """Binomial smoothing of 3 or 5 pixels each way, edges mirrored."""
    kernel = {3: np.array([1, 2, 1]) / 4, 5: np.array([1, 4, 6, 4, 1]) / 16}[size]
    out, r = image.astype(float), size // 2
    for axis in (0, 1):
        padded = np.pad(out, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="reflect" if out.shape[axis] > r else "edge")
        out = _weighed(padded, kernel, axis)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def resize(image: np.ndarray, width: int = 800, height: int = 600) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    def grid(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    y0, y1, fy = grid(image.shape[0], height)
    x0, x1, fx = grid(image.shape[1], width)
    rows = image.astype(float)
    top = rows[y0][:, x0] * (1 - fx) + rows[y0][:, x1] * fx
    low = rows[y1][:, x0] * (1 - fx) + rows[y1][:, x1] * fx
    return np.clip(np.rint(top * (1 - fy)[:, None] + low * fy[:, None]), 0, 255).astype(np.uint8)


def equalised(image: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited histogram equalisation by tiles, bilinear between their centres."""
    h, w = image.shape
    ys, xs = np.linspace(0, h, tiles + 1).astype(int), np.linspace(0, w, tiles + 1).astype(int)
    maps = np.zeros((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            part = image[ys[i] : max(ys[i + 1], ys[i] + 1), xs[j] : max(xs[j + 1], xs[j] + 1)]
            hist, limit = np.bincount(part.ravel(), minlength=256).astype(float), max(1.0, clip * part.size / 256)
            over = np.maximum(hist - limit, 0).sum()
            maps[i, j] = np.cumsum(np.minimum(hist, limit) + over / 256) * 255 / max(part.size, 1)
    fy, fx = np.clip((np.arange(h) + 0.5) * tiles / h - 0.5, 0, tiles - 1), np.clip((np.arange(w) + 0.5) * tiles / w - 0.5, 0, tiles - 1)
    y0, x0 = np.floor(fy).astype(int), np.floor(fx).astype(int)
    y1, x1, wy, wx = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1), (fy - y0)[:, None], fx - x0
    pick = lambda a, b: maps[a[:, None], b[None, :], image]
    out = (pick(y0, x0) * (1 - wx) + pick(y0, x1) * wx) * (1 - wy) + (pick(y1, x0) * (1 - wx) + pick(y1, x1) * wx) * wy
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def normalise(image: np.ndarray, width: int = 800, height: int = 600, swapped: bool = False) -> np.ndarray:
    return resize(equalised(blur(gray(image, swapped), 3)), width, height)


def quality(image: np.ndarray, least: tuple[int, int] = (100, 100)) -> bool:
    """Large enough, more than one value, variance of 10 or more."""
    if image.size == 0 or image.shape[1] < least[0] or image.shape[0] < least[1]:
        return False
    return bool(image.min() != image.max() and image.astype(float).var() >= 10)


def hsv(image: np.ndarray) -> np.ndarray:
    """Hue 0 to 179, saturation and value 0 to 255 of a BGR image."""
    b, g, r = (image[..., k].astype(float) for k in range(3))
    top, low = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
    span = np.where(top > low, top - low, 1)
    hue = np.where(top == r, (g - b) / span, np.where(top == g, 2 + (b - r) / span, 4 + (r - g) / span)) * 30
    hue = np.where(top == low, 0, np.where(hue < 0, hue + 180, hue))
    return np.stack([np.rint(hue) % 180, np.where(top > 0, np.rint((top - low) * 255 / np.where(top > 0, top, 1)), 0), top], -1)


def color_mask(image: np.ndarray, color: str, hues: np.ndarray | None = None) -> np.ndarray:
    """Pixels of a colour; hues, the image's hsv(), if it is there already."""
    if color not in HSV_RANGES:
        raise ValueError(f"unknown colour {color}")
    planes = np.moveaxis(hsv(image) if hues is None else hues, -1, 0)
    out = np.zeros(planes.shape[1:], bool)
    for lo, hi in HSV_RANGES[color]:
        inside = np.ones(out.shape, bool)
        for x, a, b in zip(planes, lo, hi, strict=True):
            inside &= (x >= a) & (x <= b)
        out |= inside
    return out


_ELLIPSE = np.array([[0, 0, 1, 0, 0], [1, 1, 1, 1, 1], [1, 1, 1, 1, 1], [1, 1, 1, 1, 1], [0, 0, 1, 0, 0]], bool)


def _spread(mask: np.ndarray, value: bool) -> np.ndarray:
    padded = np.pad(mask == value, 2)
    out = np.zeros(mask.shape, bool)
    for i, j in zip(*np.nonzero(_ELLIPSE), strict=True):
        out |= padded[i : i + mask.shape[0], j : j + mask.shape[1]]
    return out == value


def close_open(mask: np.ndarray) -> np.ndarray:
    """Gaps of an ellipse of five pixels filled, then specks of that size removed."""
    grown = _spread(mask, True)
    closed = _spread(grown, False)
    return _spread(_spread(closed, False), True)


def components(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 of 8-connected parts, by the runs of each row joined through a forest; numbered top to bottom."""
    h, w = mask.shape
    out = np.zeros((h, w), np.int32)
    # a row and a blank: runs end within it, and places of one row lie before those of the next
    flat = np.zeros((h, w + 1), np.int8)
    flat[:, :w] = mask
    edge = np.flatnonzero(np.diff(flat.ravel(), prepend=np.int8(0)))
    first, end = edge[::2], edge[1::2]
    # runs of the row above that touch a run, corners included
    low = np.searchsorted(end, first - (w + 1), "left")
    high = np.searchsorted(first, end - (w + 1), "right")
    touch = np.maximum(high - low, 0)
    ends = np.cumsum(touch)
    above = np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - ends + touch, touch)
    root = list(range(len(first)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for j, k in zip(above.tolist(), np.repeat(np.arange(len(first)), touch).tolist(), strict=True):
        j, k = find(j), find(k)
        if j != k:
            root[max(j, k)] = min(j, k)
    if root:
        names = np.unique([find(k) for k in range(len(root))], return_inverse=True)[1] + 1
        out[mask] = np.repeat(names, end - first)
    return out


def shapes(mask: np.ndarray) -> list[dict]:
    """For each outer shape its box, area, perimeter, aspect, circularity and solidity. The area is that of the polygon through
    the border pixels, so a little less than the pixel count."""
    labels, out = components(mask), []
    n = int(labels.max(initial=0))
    ys, xs = np.nonzero(labels)
    order = np.argsort(labels[ys, xs], kind="stable")
    parts = np.split(order, np.cumsum(np.bincount(labels[ys, xs], minlength=n + 1)[1:])[:-1]) if n else []
    for part in parts:
        y, x = ys[part], xs[part]
        box = int(x.min()), int(y.min()), int(x.max()) + 1, int(y.max()) + 1
        piece = np.zeros((box[3] - box[1] + 2, box[2] - box[0] + 2), bool)
        piece[y - box[1] + 1, x - box[0] + 1] = True
        outside = components(~piece)
        solid = outside != outside[0, 0]
        inner = solid.copy()
        inner[1:-1, 1:-1] &= solid[:-2, 1:-1] & solid[2:, 1:-1] & solid[1:-1, :-2] & solid[1:-1, 2:]
        border = int((solid & ~inner).sum())
        area = max(float(solid.sum()) - border / 2 - 1, 0.0)
        w, h = box[2] - box[0], box[3] - box[1]
        steps = border * (1 + (np.sqrt(2) - 1) * min(1.0, max(0.0, 1 - area / max(w * h, 1)) * 2))
        around = _hull_area(x, y)
        out.append({"box": box, "area": area, "perimeter": float(steps), "aspect": w / h, "circularity": float(min(4 * np.pi * area / steps**2, 1.0)) if steps else 0.0, "solidity": min(area / around, 1.0) if around else 0.0, "extent": area / (w * h)})
    return out


def hull(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Corners of the convex hull in turn; none of less than three points."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    x, y = x[new], y[new]
    if len(x) < 3:
        return []
    # corners are among the least and the greatest y of each x
    new = np.ones(len(x) + 1, bool)
    new[1:-1] = x[1:] != x[:-1]
    some = new[1:] | new[:-1]
    points = list(zip(x[some].tolist(), y[some].tolist(), strict=True))

    def half(ps):
        out = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1])


def _hull_area(x: np.ndarray, y: np.ndarray) -> float:
    ring = hull(x, y)
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def ink(image: np.ndarray, size: int = 11, offset: float = 2.0) -> np.ndarray:
    """Pixels darker than the Gaussian mean around them by more than offset."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    kernel = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    kernel /= kernel.sum()
    g = gray(image).astype(float)
    mean = g
    for axis in (0, 1):
        padded = np.pad(mean, [(size // 2, size // 2) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        mean = _weighed(padded, kernel, axis)
    return g <= np.rint(mean) - offset


ABSENT = {"present": False, "kind": None, "confidence": 0.9, "box": None}


def _is_tick(s: dict) -> bool:
    return 0.3 < s["aspect"] < 3 and s["solidity"] > 0.3 and s["circularity"] < 0.5


# What a shape is taken for and how surely, by three sets of rules; the first that holds counts. share is the shape's area in the image.
MARK_RULES = {
    "wide": [
        ("tick", 0.85, _is_tick),
        ("cross", 0.80, lambda s: 0.5 < s["aspect"] < 2 and s["circularity"] < 0.4),
        ("circle", 0.75, lambda s: 0.7 < s["circularity"] < 1 or (0.7 < s["aspect"] < 1.4 and s["circularity"] > 0.6)),
        ("tick", 0.70, lambda s: s["share"] < 0.01),
        ("square", 0.65, lambda s: True),
    ],
    "plain": [("tick", 0.85, _is_tick), ("circle", 0.75, lambda s: s["circularity"] > 0.6), ("square", 0.65, lambda s: True)],
    "scored": [
        ("tick", 0.85, _is_tick),
        ("cross", 0.80, lambda s: 0.4 < s["aspect"] < 2.5 and s["circularity"] < 0.4),
        ("circle", 0.75, lambda s: s["circularity"] > 0.6 and 0.5 < s["aspect"] < 2),
        ("small_mark", 0.65, lambda s: s["area"] < 1000),
        ("unknown", 0.50, lambda s: True),
    ],
}


def mark_kind(shape: dict, rules: str = "scored") -> tuple[str, float]:
    """Kind and confidence of a shape; the scored rules add 0.1 for a solid one and 0.05 for one far from round, up to 0.95."""
    kind, sure = next((k, c) for k, c, holds in MARK_RULES[rules] if holds(shape))
    if rules == "scored":
        sure = min(sure + 0.1 * (shape["solidity"] > 0.5) + 0.05 * (shape["circularity"] < 0.3), 0.95)
    return kind, sure


def marks(image: np.ndarray, rules: str = "plain", region: tuple[int, int, int, int] | None = None, low: float = 0.001, high: float = 0.05) -> list[dict]:
    """Ticks, crosses, circles and the like whose area is a small part of the image or region, boxes in the image's own places; one absent if there is none."""
    height, width = image.shape[:2]
    x1, y1, x2, y2 = region or (0, 0, width, height)
    x1, y1, x2, y2 = max(0, x1), max(0, y1), min(width, x2), min(height, y2)
    if x2 <= x1 or y2 <= y1:
        return [ABSENT]
    part, out = gray(image)[y1:y2, x1:x2], []
    for s in shapes(ink(blur(part, 3))):
        s["share"] = s["area"] / part.size
        if low <= s["share"] <= high:
            kind, sure = mark_kind(s, rules)
            a, b, c, d = s["box"]
            out.append({"present": True, "kind": kind, "confidence": sure, "box": (a + x1, b + y1, c + x1, d + y1)})
    return out or [ABSENT]


def single_mark(image: np.ndarray, region: tuple[int, int, int, int] | None = None) -> dict:
    return marks(image, "scored", region)[0]


def padded_marks(image: np.ndarray, margin: int = 10) -> list[tuple[int, int, int, int]]:
    """Boxes of the marks with a margin, inside the image."""
    return [padded(m["box"], margin, image) for m in marks(image, "scored") if m["present"]]


def padded(box: tuple[int, int, int, int], margin: int, image: np.ndarray) -> tuple[int, int, int, int]:
    height, width = image.shape[:2]
    return max(0, box[0] - margin), max(0, box[1] - margin), min(width, box[2] + margin), min(height, box[3] + margin)


def power_by_mark(image: np.ndarray, read, margin: int = 50) -> dict | None:
    """The first number of two or three digits from 15 to 100 that read(crop), a text, has around the first tick that has one."""
    for m in marks(image, "plain"):
        if m["present"] and m["kind"] == "tick":
            x1, y1, x2, y2 = padded(m["box"], margin, image)
            for n in re.findall(r"\d{2,3}", read(image[y1:y2, x1:x2]) or ""):
                if 15 <= int(n) <= 100:
                    return {"value": int(n), "confidence": 0.85, "box": m["box"], "source": "visual"}
    return None


def signature(image: np.ndarray, start: float = 0.75) -> dict:
    """present, confidence, box: the first large shape of ink in the bottom part that is neither thin nor a block, or is wide."""
    top = int(image.shape[0] * start)
    foot = image[top:]
    for s in shapes(ink(blur(gray(foot), 5))):
        x1, y1, x2, y2 = s["box"]
        wide = x2 - x1 > 2 * (y2 - y1)
        if s["area"] > 0.05 * foot.shape[0] * foot.shape[1] and (0.1 < s["aspect"] < 1 or wide):
            return {"present": True, "confidence": min(0.7 + 0.15 * wide + 0.1 * (s["aspect"] > 0.3), 1.0), "box": (x1, y1 + top, x2, y2 + top)}
    return {"present": False, "confidence": 0.9, "box": None}


def stamp(image: np.ndarray, where: str = "footer") -> dict:
    """present, confidence, box: the first shape of moderate size that is about as wide as high, or ring-like; where is footer (bottom right), right or all."""
    height, width = image.shape[:2]
    top, left = {"footer": (int(height * 0.75), int(width * 0.6)), "right": (0, int(width * 0.7))}.get(where, (0, 0))
    part = gray(image)[top:, left:]
    for s in shapes(ink(blur(part, 3))) if part.size else []:
        even, ring = 0.7 < s["aspect"] < 1.4, 0.6 < s["circularity"] < 0.9
        if 0.01 < s["area"] / part.size < 0.15 and (even or ring):
            x1, y1, x2, y2 = s["box"]
            return {"present": True, "confidence": min(0.75 + 0.15 * ring + 0.1 * even, 1.0), "box": (x1 + left, y1 + top, x2 + left, y2 + top)}
    return {"present": False, "confidence": 0.9, "box": None}


def red_ink(image: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes of red or brown regions; none on grey images."""
    if image.ndim == 2 or image.shape[2] < 3:
        return []
    hues = hsv(image)
    mask = color_mask(image, "red", hues) | color_mask(image, "brown", hues)
    if not mask.any():
        return []
    mask = close_open(mask)
    return [s["box"] for s in shapes(mask) if 0.005 <= s["area"] / mask.size <= 0.15 and 0.5 <= s["aspect"] <= 2]


def chosen_stamp(image: np.ndarray, compat: bool = False) -> dict:
    """With red ink a stamp anywhere, else one in the footer. If the whole image shows none, the first three red regions
    are looked at; compat looks at the whole image again instead, to no effect."""
    red = red_ink(image)
    found = stamp(image, "all" if red else "footer")
    for x1, y1, x2, y2 in red[:3] if not found["present"] and not compat else []:
        inner = stamp(image[y1:y2, x1:x2], "all")
        if inner["present"]:
            a, b, c, d = inner["box"]
            return inner | {"box": (a + x1, b + y1, c + x1, d + y1)}
    return found


def circular(image: np.ndarray, box: tuple[int, int, int, int]) -> bool:
    """Whether the largest bright shape in the box is round."""
    x1, y1, x2, y2 = box
    found = shapes(gray(image[y1:y2, x1:x2]) > 127)
    return bool(found) and max(found, key=lambda s: s["area"])["circularity"] > 0.6


def skew(image: np.ndarray) -> float:
    """Degrees by which the largest dark shape of a grey page leans, from -45 to 45: the side of its smallest enclosing rectangle."""
    found = shapes(image <= otsu(image))
    if not found:
        return 0.0
    labels = components(image <= otsu(image))
    largest = np.bincount(labels.ravel())[1:].argmax() + 1
    y, x = np.nonzero(labels == largest)
    ring = np.array(hull(x, y), float)
    if len(ring) < 3:
        return 0.0
    sides = np.roll(ring, -1, 0) - ring
    angles = np.unique(np.round((np.degrees(np.arctan2(sides[:, 1], sides[:, 0])) + 45) % 90 - 45, 6))

    def size(angle: float) -> float:
        c, s_ = np.cos(np.radians(angle)), np.sin(np.radians(angle))
        turned = ring @ np.array([[c, -s_], [s_, c]])
        return float(np.prod(turned.max(0) - turned.min(0)))

    return float(min(angles, key=lambda a: (size(a), abs(a))))


def otsu(image: np.ndarray) -> int:
    """The limit that parts dark from bright with the largest variance between them."""
    hist = np.bincount(image.ravel(), minlength=256).astype(float)
    below, total = np.cumsum(hist), hist.sum()
    sums = np.cumsum(hist * np.arange(256))
    inside = (below > 0) & (below < total)
    spread = np.where(inside, (sums[-1] * below / total - sums) ** 2 / np.where(inside, below * (total - below), 1), 0)
    return int(spread.argmax())


def deskewed(image: np.ndarray, least: float = 0.5) -> np.ndarray:
    """A grey page turned upright if it leans by more than least degrees; bilinear, edges repeated."""
    angle = skew(image)
    if abs(angle) <= least:
        return image
    height, width = image.shape
    c, s_ = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    yy, xx = np.mgrid[:height, :width] - np.array([height // 2, width // 2])[:, None, None]
    x = np.clip(c * xx - s_ * yy + width // 2, 0, width - 1)
    y = np.clip(s_ * xx + c * yy + height // 2, 0, height - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1, fx, fy = np.minimum(x0 + 1, width - 1), np.minimum(y0 + 1, height - 1), x - x0, y - y0
    g = image.astype(float)
    out = (g[y0, x0] * (1 - fx) + g[y0, x1] * fx) * (1 - fy) + (g[y1, x0] * (1 - fx) + g[y1, x1] * fx) * fy
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def color_regions(image: np.ndarray, color: str = "red", low: float = 0.005, high: float = 0.15, morphology: bool = True, hues: np.ndarray | None = None) -> tuple[list[tuple], float]:
    """Boxes of a colour's regions and how sure that is; grey images have none, at 0.5. hues goes to color_mask."""
    if image.ndim == 2 or image.shape[2] < 3:
        return [], 0.5
    mask = color_mask(image, color, hues)
    if not mask.any():
        return [], 0.5
    found = [s for s in shapes(close_open(mask) if morphology else mask) if low <= s["area"] / mask.size <= high and 0.3 <= s["aspect"] <= 3]
    good = sum(0.5 < s["aspect"] < 2 for s in found)
    return [s["box"] for s in found], 0.7 + 0.2 * good / len(found) if good else 0.5


def stamps(image: np.ndarray) -> list[dict]:
    """Red and brown regions as stamps, or one absent."""
    out = [{"present": True, "color": c, "confidence": sure, "box": b, "is_circular": circular(image, b)} for c, sure in (("red", 0.8), ("brown", 0.75)) for b in color_regions(image, c)[0]]
    return out or [{"present": False, "color": None, "confidence": 0.9, "box": None, "is_circular": False}]


def any_stamp(image: np.ndarray) -> dict:
    """The surest of the stamps by colour, the first of equals."""
    return max(stamps(image), key=lambda s: s["confidence"])


def strokes_scored(region: np.ndarray) -> dict:
    """handwritten, confidence and width by the older rule: confidence rises with the variance of the bright parts' areas."""
    if region.size == 0:
        return {"handwritten": False, "confidence": 0.0, "width": 0.0}
    areas = np.bincount(components(gray(region) > 127).ravel())[1:].astype(float)
    if not len(areas):
        return {"handwritten": False, "confidence": 0.5, "width": 0.0}
    nv = float(areas.var() / areas.mean() ** 2)
    return {"handwritten": nv > 0.1, "confidence": min(0.5 + 2 * nv, 0.9), "width": float(np.sqrt(areas.mean()))}


def is_handwritten(region: np.ndarray, threshold: float = 0.5) -> bool:
    found = strokes(region)
    return found["handwritten"] and found["confidence"] >= threshold


def block_strokes(image: np.ndarray, box: tuple[int, int, int, int]) -> dict:
    """strokes() of a box, as far as it lies in the image."""
    x1, y1, x2, y2 = padded(box, 0, image)
    if x2 <= x1 or y2 <= y1:
        return {"handwritten": False, "confidence": 0.5, "width": 0.0, "variance": 0.0, "parts": 0}
    return strokes(image[y1:y2, x1:x2])


def blocks_strokes(image: np.ndarray, boxes: list[tuple[int, int, int, int]]) -> list[dict]:
    return [block_strokes(image, b) for b in boxes]


def _written(image: np.ndarray, top: int, bottom: int, fits, value_fits) -> dict | None:
    """The surest handwritten shape in a band of rows; its value is the whole part of its area, which stands in for a reading."""
    part, found = gray(image)[top:bottom], []
    for s in shapes(ink(blur(part, 3))) if part.size else []:
        x1, y1, x2, y2 = s["box"]
        pen = strokes_scored(part[y1:y2, x1:x2])
        if fits(s) and pen["handwritten"] and value_fits(int(s["area"])):
            found.append({"value": int(s["area"]), "confidence": pen["confidence"], "box": (x1, y1 + top, x2, y2 + top), "width": pen["width"]})
    return max(found, key=lambda f: f["confidence"], default=None)


def written_power(image: np.ndarray) -> dict | None:
    height = image.shape[0]
    return _written(image, int(height * 0.3), int(height * 0.7), lambda s: 50 <= s["area"] <= 2000 and 0.3 < s["aspect"] < 1.5, lambda v: 20 <= v <= 100)


def written_cost(image: np.ndarray) -> dict | None:
    height = image.shape[0]
    return _written(image, int(height * 0.7), height, lambda s: 500 < s["area"] <= 5000, lambda v: True)


def strokes(region: np.ndarray) -> dict:
    """Whether bright parts differ in area as handwriting does: normalised variance above 0.1."""
    labels = components(gray(region) > 127)
    areas = np.bincount(labels.ravel())[1:].astype(float)
    if not len(areas) or areas.mean() == 0:
        return {"handwritten": False, "confidence": 0.5, "width": 0.0, "variance": 0.0, "parts": 0}
    nv = float(areas.var() / areas.mean() ** 2)
    sure = 0.9 if nv > 0.3 else 0.75 if nv > 0.2 else 0.6 if nv > 0.1 else 0.4
    if (nv > 0.1 and len(areas) > 10) or (nv <= 0.1 and len(areas) < 3):
        sure = min(sure + 0.1, 0.95)
    return {"handwritten": nv > 0.1, "confidence": sure, "width": float(np.sqrt(areas.mean())), "variance": min(10 * nv, 1.0), "parts": len(areas)}


def png(image: np.ndarray) -> bytes:
    """A grey or BGR image as a PNG file."""
    rows = image[..., ::-1] if image.ndim == 3 else image
    raw = np.zeros((rows.shape[0], rows.shape[1] * (1 if rows.ndim == 2 else 3) + 1), np.uint8)
    raw[:, 1:] = rows.reshape(rows.shape[0], -1)
    part = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", rows.shape[1], rows.shape[0], 8, 0 if rows.ndim == 2 else 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw.tobytes())) + part(b"IEND", b"")

"""Pixel-level functions over sample planes, vectorised per image."""

from __future__ import annotations

import numpy as np

MIN_PIXELS, POOL_PIXELS = 500_000, 1


def pack_bilevel(gray: bytes, width: int, height: int) -> bytes | None:
    """Eight pixels a byte, rows padded; None unless every sample is 0 or 255."""
    pixels = np.frombuffer(gray, np.uint8)
    if len(pixels) != width * height or not np.isin(pixels, (0, 255)).all():
        return None
    return np.packbits(pixels.reshape(height, width) == 255, axis=1).tobytes()


def unpack_bilevel(packed: bytes, width: int, height: int) -> bytes:
    rows = np.frombuffer(packed, np.uint8).reshape(height, -1)
    return (np.unpackbits(rows, axis=1)[:, :width] * np.uint8(255)).tobytes()


def bilevel_cost(size: int, group4: bool, dictionary_bytes: int) -> int:
    """Bytes of an encoded bilevel stream with the dictionary entries its codec needs."""
    return size + (dictionary_bytes if group4 else 0)


def _box(hit: np.ndarray) -> tuple[int, int, int, int] | None:
    rows, columns = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
    if not len(rows):
        return None
    return int(columns[0]), int(rows[0]), int(columns[-1] - columns[0] + 1), int(rows[-1] - rows[0] + 1)


def alpha_crop(alpha: bytes, width: int, height: int) -> tuple[int, int, int, int] | None:
    """x, y, width, height of what isn't wholly transparent; None if all is."""
    return _box(np.frombuffer(alpha, np.uint8, width * height).reshape(height, width) != 0)


def border_sample(data: bytes, width: int, height: int, components: int, percent: int = 35) -> bytes | None:
    """The most frequent sample of the border if at least `percent` of the border has it; ties to the least."""
    if not (width and height and components):
        return None
    image = np.frombuffer(data, np.uint8, width * height * components).reshape(height, width, components)
    edge = np.ones((height, width), bool)
    edge[1:-1, 1:-1] = False
    samples, counts = np.unique(image[edge], axis=0, return_counts=True)
    best = int(counts.argmax())
    return samples[best].tobytes() if counts[best] * 100 >= edge.sum() * percent else None


def background_crop(data: bytes, width: int, height: int, components: int, background: bytes, tolerance: int) -> tuple[int, int, int, int] | None:
    """The box of samples that differ from the background by more than the tolerance; None if none do."""
    image = np.frombuffer(data, np.uint8, width * height * components).reshape(height, width, components).astype(np.int16)
    return _box((np.abs(image - np.frombuffer(background, np.uint8)) > tolerance).any(2))


def lower_median(histogram: np.ndarray) -> int | None:
    total = int(histogram.sum())
    return int(np.searchsorted(np.cumsum(histogram), -(-total // 2))) if total else None


def paper_background(rgb: bytes, least_pixels: int = MIN_PIXELS, pool_pixels: int = POOL_PIXELS) -> tuple[int, int, int] | None:
    """The paper's colour of a scanned page: per-channel lower medians of bright neutral pixels.

    None unless the image is large, four fifths near white and neutral, and at most 15 % dark.
    """
    if len(rgb) % 3 or len(rgb) // 3 < least_pixels:
        return None
    p = np.frombuffer(rgb, np.uint8).reshape(-1, 3)
    total, span, n = p.sum(1, dtype=np.int32), np.ptp(p.astype(np.int16), axis=1), len(p)
    pool = p[(total >= 630) & (span <= 18)]
    if len(pool) < pool_pixels or (total >= 660).sum() * 100 < n * 80 or (span <= 20).sum() * 100 < n * 80 or (total < 384).sum() * 100 > n * 15:
        return None
    return tuple(lower_median(np.bincount(pool[:, c], minlength=256)) for c in range(3))


def quantise(rgb: bytes, colours: int = 256, most_error: float = 6.0) -> tuple[bytes, bytes, float] | None:
    """(palette, indexes, mean squared error) by median cut; None if the error is above `most_error`."""
    p = np.frombuffer(rgb, np.uint8).reshape(-1, 3)
    distinct, which, counts = np.unique(p, axis=0, return_inverse=True, return_counts=True)
    boxes = [np.arange(len(distinct))]
    while len(boxes) < colours:
        spans = [np.ptp(distinct[b].astype(np.int16), axis=0).max() * (len(b) > 1) for b in boxes]
        k = int(np.argmax(spans))
        if not spans[k]:
            break
        box = boxes.pop(k)
        axis = int(np.ptp(distinct[box].astype(np.int16), axis=0).argmax())
        box = box[np.argsort(distinct[box, axis], kind="stable")]
        half = int(np.searchsorted(np.cumsum(counts[box]), counts[box].sum() / 2)) + 1
        half = min(max(1, half), len(box) - 1)
        boxes += [box[:half], box[half:]]
    palette = np.array([np.round(np.average(distinct[b], axis=0, weights=counts[b])) for b in boxes], np.uint8)
    index = np.empty(len(distinct), np.int64)
    for k, b in enumerate(boxes):
        index[b] = k
    error = float(((p.astype(np.int32) - palette[index[which.ravel()]]) ** 2).sum(1).mean()) if len(p) else 0.0
    return None if error > most_error else (palette.tobytes(), index[which.ravel()].astype(np.uint8).tobytes(), error)
